"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "textlab") -> SparkSession:
    """Create (or reuse) a session with AQE on, the UI off and UTC time.

    On a cluster the master and the checkpoint folder come from the launcher;
    locally we default to ``local[*]`` and a scratch checkpoint folder.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TEXTLAB_DRIVER_MEMORY", "16g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only when unset.

    A cluster names its shared folder in ``spark.checkpoint.dir``; we never
    override it, and without it a cluster run is an error: executors would write
    to their own disks. Local masters get a fresh folder under the temp dir.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        path = tempfile.mkdtemp(prefix="textlab-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():  # set once; each call would add a folder
        spark.sparkContext.setCheckpointDir(path)
    return path


#: A table is broadcast only if its measured rows times its row size stay under this.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` staged, and marked for broadcast if its counted size allows; else left to a shuffle join."""
    from pyspark.sql import functions as F
    df = stage(df, "small")
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


#: What stages and tables are made inside each open ``scratch``: (kind, name) lists, innermost last.
_open: list[list[tuple[str, str]]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Delete the staged tables that are made inside, files and catalogue entries, when the block ends.

    Results made inside read them until then, so write or collect results before the block ends. Without an open
    block stages stay until the checkpoint folder is cleared. Blocks nest; a stage belongs to the innermost one.
    """
    made: list[tuple[str, str]] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for kind, name in reversed(made):
            if kind == "table":
                spark.sql(f"DROP TABLE IF EXISTS `{name}`")
            else:
                p = jvm.org.apache.hadoop.fs.Path(name)
                p.getFileSystem(conf).delete(p, True)


def made(kind: str, name: str) -> None:
    """Note a staged ``path`` or ``table`` for the innermost open ``scratch`` block."""
    if _open:
        _open[-1].append((kind, name))


def stage(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Cuts lineage (an executor loss re-reads the files instead of replaying the
    whole plan) and keeps the columnar layout, so later scans still prune
    columns and push filters. Used before iterative loops.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root, "stages", f"{name}-{uuid.uuid4().hex}")
    made("path", path)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # known schema: no footer job
