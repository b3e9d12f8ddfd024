"""Incremental jobs on Structured Streaming.

File sources with an explicit schema; ``trigger(availableNow=True)`` turns
them into resumable batch jobs: the checkpoint remembers which files were
processed, so a rerun adds nothing. Sinks are idempotent per batch id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textlab.operators.aggregate import progress_summary
from textlab.operators.joins import pending_rows
from textlab.session import stage


def _batch_sink(out_dir: str, partition_cols=("batch_id",)):
    """foreachBatch writer that is idempotent on replay: a batch id always
    overwrites its own partition (dynamic partition overwrite)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*partition_cols).parquet(out_dir))
    return write


def source_of(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """(folder, file name filter) of a table that is a folder of parts (or a pattern), or one file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if fs.exists(p) and fs.getFileStatus(p).isFile():
        return p.getParent().toString(), p.getName()
    return path, None


def _stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    folder, name = source_of(spark, path)
    r = spark.readStream.schema(schema).format(fmt).option("ignoreCorruptFiles", False)
    if name:
        r = r.option("pathGlobFilter", name)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(folder)


def table_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A given table as a file stream, whether it is one file or a folder of parts."""
    return _stream(spark, path, spark.read.parquet(path).schema, max_files=max_files)


def score_new_files(spark: SparkSession, src: str, schema: StructType, out_dir: str,
                    checkpoint: str, score: Callable[[DataFrame], DataFrame],
                    max_files_per_trigger: int = 1000, column: str | None = None):
    """Score each arriving parquet file once; a rerun with the same checkpoint takes new files only.

    The stream carries file names (at most ``max_files_per_trigger`` a batch). One job reads the footers of a batch, its
    data is read once. A file without ``column`` (the schema's first by default), or one with fewer rows than its
    footer says, is skipped and reported in ``out_dir + "-report"`` (path, reason, batch_id); it does not stop the
    others, and none of its rows is kept.
    """
    from textlab.sources.files import footers, read_whole
    column = column or schema.fieldNames()[0]
    files = _stream(spark, src, "path string, modificationTime timestamp, length long, content binary", "binaryFile",
                    max_files_per_trigger).select("path")
    sink, report = _batch_sink(out_dir), _batch_sink(out_dir + "-report")

    def write(batch: DataFrame, batch_id: int) -> None:
        paths = sorted(r["path"] for r in batch.collect())
        found = footers(spark, paths)
        skipped = [(p, "unreadable" if f is None else f"no column {column}") for p, f in found.items()
                   if f is None or column not in f[0]]
        whole = {p: f[1] for p, f in found.items() if f is not None and column in f[0]}
        if whole:
            rows, bad = read_whole(spark, whole, schema.fieldNames(), schema)
            skipped += [(p, "damaged") for p in bad]
            sink(score(rows), batch_id)
        report(spark.createDataFrame(skipped, "path string, reason string"), batch_id)

    q = (files.writeStream.foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


#: A slice is split over tasks of this many rows, at most one for each core.
TASK_ROWS = 256


def resume_generation(todo: DataFrame, out_dir: str, key: str,
                      generate: Callable[[DataFrame], DataFrame], slice_rows: int = 25) -> int:
    """R2 (batch form): generate only rows whose key is not yet in ``out_dir``, appended in hash slices of about
    ``slice_rows`` rows, so an interruption loses one slice of that size at most, however many rows there are.
    A slice is a job: choose ``slice_rows`` by the work that may be lost. Returns slices written."""
    spark = todo.sparkSession
    done = _written(spark, out_dir)
    pending = todo if done is None else pending_rows(todo, done.select(key), key)
    n_slices = -(-pending.count() // slice_rows)
    if not n_slices:
        return 0
    # the pending rows are written once, split by slice; each slice then reads its own files, of which it has one for each
    # core (or ``TASK_ROWS`` rows), as the slices follow each other
    sliced = pending.withColumn("_slice", F.pmod(F.xxhash64(F.col(key)), F.lit(n_slices)).cast("int"))
    files = max(1, min(spark.sparkContext.defaultParallelism, slice_rows // TASK_ROWS))
    part = F.pmod(F.xxhash64(F.lit("part"), F.col(key)), F.lit(files))
    sliced = stage(sliced.repartition(files * (4 + n_slices // 16), "_slice", part), "resume-slices", ["_slice"])
    for s in range(n_slices):
        generate(sliced.where(F.col("_slice") == s).drop("_slice")).write.mode("append").parquet(out_dir)
    return n_slices


def streaming_progress(spark: SparkSession, src_dir: str, schema: StructType, out_dir: str,
                       checkpoint: str, label_col: str = "label", per_label: int = 3,
                       order_by: tuple[str, ...] | None = None, max_files: int = 1):
    """The G5 counts of each micro-batch, and the first ``per_label`` rows of each label so far.

    Both are written keyed by batch id. The examples are a state of at most ``per_label`` rows a label: a batch merges
    its own first rows with those of the batch before, so a batch costs its rows and the state, and the last state is
    the first rows of all batches by ``order_by`` (all columns by default), however files are batched. A replayed batch
    overwrites its own counts and state. See ``running_totals`` and ``first_examples``."""
    from pyspark.sql import Window
    sink, states = _batch_sink(out_dir + "/summary"), _batch_sink(out_dir + "/examples")
    w = Window.partitionBy(label_col).orderBy(*(order_by or schema.fieldNames()), *schema.fieldNames())

    def first(df: DataFrame) -> DataFrame:
        return df.where(F.col(label_col).isNotNull()).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= per_label)

    def write(batch: DataFrame, batch_id: int) -> None:
        sink(progress_summary(batch, label_col).withColumn("kind", F.lit("summary")), batch_id)
        before = first_examples(spark, out_dir, batch_id)
        rows = first(batch).drop("pick")
        if before is not None:
            rows = rows.unionByName(before.drop("pick"))
        states(first(rows), batch_id)

    q = (_stream(spark, src_dir, schema, max_files=max_files).writeStream.foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def first_examples(spark: SparkSession, out_dir: str, before: int | None = None) -> DataFrame | None:
    """The first rows of each label (``pick`` from 1) over all batches, or over those before a batch id; None if there
    is no such batch."""
    states = _written(spark, out_dir + "/examples")
    if states is not None and before is not None:
        states = states.where(F.col("batch_id") < before)
    last = None if states is None else states.agg(F.max("batch_id")).first()[0]
    return None if last is None else states.where(F.col("batch_id") == last).drop("batch_id")


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    """A sink's table, None if nothing is written yet."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def running_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """Cumulative counts after each batch, from the per-batch summaries."""
    from pyspark.sql import Window
    s = spark.read.parquet(out_dir + "/summary")
    w = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)  # one row per batch
    return s.select(F.col("batch_id").cast("bigint").alias("batch_id"),
                    *[F.sum(c).over(w).cast("bigint").alias(f"cum_{c}")
                                  for c in ("total", "positives", "negatives", "nulls")])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def streaming_dedup(stream: DataFrame, key: str, order_col: str, out_dir: str, checkpoint: str) -> DataFrame:
    """D1 on arriving rows: of the rows with one key, the one that is first by ``order_col``.

    The first row of each key is keyed state of a stateful aggregation, in a state store on disk that the checkpoint
    folder backs; a batch reads and writes the state of its own keys only, and a lost executor's state is loaded again.
    There is no time limit, so the answer does not depend on how files arrive or are batched. Each batch appends its
    keys' first rows so far to ``out_dir``; the kept rows are the first of those. Nulls come first, ties in ``order_col`` go
    to the smallest row; a null key is a key.
    """
    spark = stream.sparkSession
    cols = stream.columns
    place = F.struct(F.col(order_col).alias("_o"), F.struct(*cols).alias("_r"))  # nulls come first, as in min

    def first(df: DataFrame) -> DataFrame:
        return df.groupBy(key).agg(F.min(place).alias("_m")).select("_m._r.*")

    option = "spark.sql.streaming.stateStore.providerClass"
    given = spark.conf.get(option)
    if given.endswith(".HDFSBackedStateStoreProvider"):  # the default, which holds all state in memory
        spark.conf.set(option, ROCKSDB)
    try:
        q = (first(stream).writeStream.outputMode("update").foreachBatch(_batch_sink(out_dir))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(option, given)
    q.awaitTermination()
    return first(spark.read.parquet(out_dir).select(*cols))
