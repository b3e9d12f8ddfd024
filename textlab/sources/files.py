"""Sources and sinks (S1-S9): CSV/parquet readers with explicit schemas,
tolerant multi-path scans, partitioned writers, reusable stages."""

from __future__ import annotations

import hashlib
import json
import logging
import re
import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textlab.functions.text import null_tokens_to_null
from textlab.session import stage

log = logging.getLogger(__name__)

POSTS_SCHEMA = StructType([StructField("title", StringType()),
                           StructField("selftext_or_url_reference", StringType()),
                           StructField("retrieved_on", StringType())])


def read_posts(spark: SparkSession, path, schema: StructType = POSTS_SCHEMA,
               map_null_tokens: bool = True) -> DataFrame:
    """CSV with a header, quoted fields that hold newlines and quotes, no type inference, from a file,
    a folder or a list of paths. Files may order their columns differently: each header's files are read
    with its own layout and joined by name. Pandas' null markers ('', 'NA', 'NaN', 'null', ...) become null."""
    paths = [path] if isinstance(path, str) else list(path)
    files = [f for p in paths for f in _list_files(spark, p, ".csv")]
    if not files:
        raise ValueError(f"no CSV file under {paths}")
    wanted = {f.name: f for f in schema.fields}
    headers = csv_headers(spark, files)
    for f, names in headers.items():
        missing = [n for n in wanted if n not in (names or [])]
        if missing:
            raise ValueError(f"{f} lacks columns {missing}")
    df = _by_layout(spark, headers, list(wanted), schema)
    if map_null_tokens:
        for f in schema.fields:
            if isinstance(f.dataType, StringType):
                df = df.withColumn(f.name, null_tokens_to_null(F.col(f.name)))
    return df


def _by_layout(spark: SparkSession, headers: Mapping[str, list[str]], columns: Sequence[str],
               schema: StructType | None = None, source_file: bool = False) -> DataFrame:
    """One scan per header layout (Spark maps a CSV schema by position), united by name."""
    layouts: dict[tuple, list[str]] = {}
    for f, names in headers.items():
        layouts.setdefault(tuple(names), []).append(f)
    typed = {f.name: f for f in schema.fields} if schema else {}
    keep = [*columns, *([F.col("_metadata.file_path").alias("source_file")] if source_file else [])]
    parts = [spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
             .schema(StructType([typed.get(n, StructField(n, StringType())) for n in names])).csv(fs).select(*keep)
             for names, fs in layouts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _each(fn, items: Sequence) -> list:
    """Apply ``fn`` to all items, some at a time: file heads wait for the store, not for the driver."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(fn, items))


def csv_headers(spark: SparkSession, paths: Sequence[str], head_bytes: int = 1 << 16) -> dict[str, list[str] | None]:
    """The column names of each CSV file (None if unreadable), from its first bytes; no Spark job runs."""
    import csv
    import io
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def head(path: str):
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            stream = p.getFileSystem(conf).open(p)
            try:
                data = bytes(stream.readNBytes(head_bytes))
            finally:
                stream.close()
            return next(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"), newline="")), None)
        except Exception as e:  # noqa: BLE001 - reported by the caller
            log.warning("unreadable file %s: %s", path, e)
            return None

    return dict(zip(paths, _each(head, paths)))


def _footer(source) -> tuple[list[str], int] | None:
    """(column names, rows) of a parquet file by its footer; None if it has none."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    try:
        meta = pq.read_metadata(source)
        return meta.schema.to_arrow_schema().names, meta.num_rows
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, EOFError):
        return None


def _footers_here(batches):
    """(path, columns, rows) of parquet files, read where the task runs; columns are null if a file has no footer or is not
    there. A store that does not answer is an error of the task, not of the file."""
    import pandas as pd
    from pyarrow.fs import FileSystem
    for batch in batches:
        out = []
        for path, uri in zip(batch["path"], batch["uri"]):
            store, name = FileSystem.from_uri(uri)
            try:
                with store.open_input_file(name) as f:
                    found = _footer(f)
            except FileNotFoundError:
                found = None
            out.append((path, *(found or (None, None))))
        yield pd.DataFrame(out, columns=["path", "columns", "rows"]).astype({"rows": "Int64"})


def _footer_bytes(spark: SparkSession, path: str):
    """The footer of a file as a small parquet file of its own, by Hadoop's FileSystem: for stores that only the JVM
    can open. None if the file is not there or too short."""
    import io
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return None
    length = fs.getFileStatus(p).getLen()
    stream = fs.open(p)
    try:
        def tail(n: int) -> bytes:
            stream.seek(length - n)
            return bytes(stream.readNBytes(n))
        if length < 12:
            return None
        size = int.from_bytes(tail(8)[:4], "little") + 8
        return io.BytesIO(b"PAR1" + tail(size)) if size <= length else None
    finally:
        stream.close()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, encoded, ``file:/a`` written as ``file:///a``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return _slashes(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString())


def _slashes(uri: str) -> str:
    """Spark names files with one slash or three after the scheme, as they were listed."""
    return re.sub(r"^(\w+):/(?!/)", r"\1:///", uri)


#: Footers that one task reads.
FOOTERS_A_TASK = 64


def footers(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[list[str], int] | None]:
    """(column names, rows) of each parquet file by its footer, None if it has none: one Spark job, whatever the number of
    files. Where only the JVM can open the store, the driver reads the last bytes of the files, several at a time."""
    from pyarrow.fs import FileSystem
    if not paths:
        return {}
    try:
        FileSystem.from_uri(qualified(spark, paths[0]))
    except Exception as e:  # noqa: BLE001 - a scheme or a library that Python lacks; the files are read below
        log.info("footers are read by the driver: %s", e)
        tails = _each(lambda p: _footer_bytes(spark, p), paths)
        return {p: _footer(t) if t else None for p, t in zip(paths, tails)}
    rows = spark.createDataFrame([(p, qualified(spark, p)) for p in paths], "path string, uri string")
    got = rows.repartition(-(-len(paths) // FOOTERS_A_TASK)).mapInPandas(
        _footers_here, "path string, columns array<string>, rows long").collect()
    return {r["path"]: (list(r["columns"]), r["rows"]) if r["columns"] is not None else None for r in got}


def read_whole(spark: SparkSession, rows_of: Mapping[str, int], columns: Sequence[str],
               schema: StructType | None = None) -> tuple[DataFrame, list[str]]:
    """(rows with ``source_file`` of the parquet files that are whole, the files that are not).

    The files are read once, into a stage; a file whose rows in the stage are not as many as its footer says
    (``rows_of``) is read a second time, so that a short outage of the store costs nothing, and is damaged if it comes
    up short again: none of its rows is kept. Three jobs, three more if a file came up short, whatever the number of
    files. With ``schema`` columns that a file lacks are null.
    """
    named = {qualified(spark, p): p for p in rows_of}

    def attempt(paths: list[str]) -> tuple[DataFrame, dict[str, str | None]]:
        """The rows, and the files that came up short with the name they have in ``source_file`` (None without rows)."""
        r = spark.read.option("ignoreCorruptFiles", True)
        r = r.schema(schema) if schema else r
        df = stage(r.parquet(*paths).select(*columns, F.col("_metadata.file_path").alias("source_file")), "source-rows")
        got = {named[_slashes(x["source_file"])]: x for x in df.groupBy("source_file").agg(F.count("*").alias("n")).collect()}
        return df, {p: got[p]["source_file"] if p in got else None for p in paths if (got[p]["n"] if p in got else 0) != rows_of[p]}

    def without(df: DataFrame, names) -> DataFrame:
        some = [(n,) for n in names if n]
        return df.join(spark.createDataFrame(some, "source_file string"), "source_file", "left_anti").select(*df.columns) if some else df

    df, short = attempt(list(rows_of))
    if not short:
        return df, []
    again, damaged = attempt(list(short))
    for p in damaged:
        log.warning("damaged file %s", p)
    return without(df, short.values()).unionByName(without(again, damaged.values())), list(damaged)


def _list_files(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """List data files under ``path`` through Hadoop's FileSystem (any store)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    if fs.getFileStatus(p).isFile():
        return [p.toString()]
    out = []
    it = fs.listFiles(p, True)
    while it.hasNext():
        s = it.next().getPath().toString()
        name = s.rsplit("/", 1)[-1]
        if s.endswith(suffix) and not name.startswith(("_", ".")):
            out.append(s)
    return sorted(out)


def file_schema(spark: SparkSession, path: str, fmt: str = "parquet") -> StructType | None:
    """Schema of one file (parquet footer / CSV header only); None if unreadable."""
    try:
        r = spark.read
        if fmt == "csv":
            r = r.option("header", True).option("inferSchema", False)
        return r.format(fmt).load(path).schema
    except Exception as e:  # noqa: BLE001
        log.warning("unreadable file %s: %s", path, e)
        return None


def _columns(spark: SparkSession, paths: Sequence[str], fmt: str) -> dict[str, list[str] | None]:
    """Column names by file, None if its head or footer cannot be read."""
    if fmt == "csv":
        return csv_headers(spark, paths)
    if fmt == "parquet":
        return {p: f and f[0] for p, f in footers(spark, paths).items()}
    schemas = _each(lambda p: file_schema(spark, p, fmt), paths)
    return {p: s.fieldNames() if s is not None else None for p, s in zip(paths, schemas)}


def require_column(spark: SparkSession, paths: Sequence[str], column: str, fmt: str = "parquet"):
    """Keep the files whose schema has ``column``.

    Returns (valid paths, report rows (path, reason) for the skipped ones).
    Only footers / headers are read here, in one job; the data is read by one scan later.
    """
    return _with_column(_columns(spark, paths, fmt), paths, column)


def _with_column(found: Mapping[str, list[str] | None], paths: Sequence[str], column: str):
    valid = [p for p in paths if found[p] is not None and column in found[p]]
    skipped = [(p, "unreadable" if found[p] is None else f"no column {column}") for p in paths if p not in set(valid)]
    return valid, skipped


def tolerant_union(spark: SparkSession, paths: Sequence[str], columns: Sequence[str],
                   fmt: str = "csv", schema: StructType | None = None):
    """Skip unreadable files or files missing a needed column, scan the
    rest in **one** multi-path read (per header layout for CSV), and return (DataFrame with
    ``source_file``, report DataFrame of skipped paths). Parquet data is read once, and files that hold fewer
    rows than their footer says are in the report, too. Errors only when no file is valid."""
    feet = footers(spark, paths) if fmt == "parquet" else {}
    found = {p: f and f[0] for p, f in feet.items()} or _columns(spark, paths, fmt)
    valid, skipped = [], []
    for p in paths:
        missing = None if found[p] is None else [c for c in columns if c not in found[p]]
        if missing is None:
            skipped.append((p, "unreadable"))
        elif missing:
            skipped.append((p, "missing " + ",".join(missing)))
        else:
            valid.append(p)
    df, bad = read_whole(spark, {p: feet[p][1] for p in valid}, columns) if feet and valid else (None, [])
    skipped += [(p, "damaged") for p in bad]
    if len(valid) == len(bad):
        raise ValueError("No valid files among %d paths" % len(paths))
    report = spark.createDataFrame(skipped, "path string, reason string")
    if fmt == "csv":
        return _by_layout(spark, {p: found[p] for p in valid}, columns, schema, source_file=True), report
    if df is None:
        df = spark.read.format(fmt).option("ignoreCorruptFiles", False).load(valid).select(
            *columns, F.col("_metadata.file_path").alias("source_file"))
    return df, report


def read_messages_dir(spark: SparkSession, path: str, column: str = "Message",
                      out_col: str = "sentence"):
    """S2 + S5: every parquet file under ``path`` that has ``column``; null
    rows dropped; renamed to ``out_col``. Returns (DataFrame, skipped report); a file
    with a damaged body is in the report too, none of its rows in the DataFrame."""
    files = _list_files(spark, path, ".parquet")
    feet = footers(spark, files)
    valid, skipped = _with_column({p: f and f[0] for p, f in feet.items()}, files, column)
    df, bad = read_whole(spark, {p: feet[p][1] for p in valid}, [column]) if valid else (None, [])
    skipped += [(p, "damaged") for p in bad]
    if len(valid) == len(bad):
        raise ValueError(f"No parquet file under {path} has column {column}")
    df = df.select(F.col(column).alias(out_col), "source_file").where(F.col(out_col).isNotNull())
    return df, spark.createDataFrame(skipped, "path string, reason string")


def read_columns(spark: SparkSession, path, columns: Sequence[str]) -> DataFrame:
    """S3: column-pruned CSV read of a file or a list of files; a missing column is an error."""
    paths = [path] if isinstance(path, str) else list(path)
    headers = csv_headers(spark, paths)
    for p, names in headers.items():
        if names is None:
            raise ValueError(f"unreadable: {p}")
        missing = [c for c in columns if c not in names]
        if missing:
            raise ValueError(f"{p} lacks columns {missing}")
    return _by_layout(spark, headers, columns)


def write_labelled(df: DataFrame, path: str, partition_cols: Sequence[str] = ("source",),
                   fmt: str = "parquet") -> None:
    """Overwrite per partition (source, params ...); other partitions stay."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).format(fmt).save(path))


def write_predictions(df: DataFrame, path: str) -> None:
    """One predictions table partitioned by model (with ``correct``)."""
    out = df if "correct" in df.columns else df.withColumn("correct", F.col("label") == F.col("prediction"))
    write_labelled(out, path, ("model",))


def stage_path(root: str, name: str, params: Mapping, inputs: Sequence = ()) -> str:
    key = hashlib.sha1(json.dumps([params, list(inputs)], sort_keys=True, default=str).encode()).hexdigest()[:16]
    return f"{root.rstrip('/')}/{name}-{key}"


def input_state(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int, int]]:
    """(path, length, modification time) of every file under the paths: what a stage was built from."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        it = p.getFileSystem(conf).listFiles(p, True)
        while it.hasNext():
            f = it.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of a stage (``data``, ``owner``, ``expires``), None if the stage is not published."""
    p, fs = _file_system(spark, path + ".manifest")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, manifest: Mapping) -> bool:
    """Publish a stage by a rename, which is one step: readers see no manifest or a whole one. False if it is published."""
    part, fs = _file_system(spark, f"{path}.manifest-{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    try:
        won = fs.rename(part, _file_system(spark, path + ".manifest")[0])
    except spark.sparkContext._jvm.java.io.IOException:
        won = False
    if not won or read_manifest(spark, path) != manifest:  # stores whose rename replaces: the last one counts for all
        fs.delete(part, False)
        return False
    return True


def materialize_stage(spark: SparkSession, root: str, name: str, params: Mapping, build: Callable[[], DataFrame],
                      inputs: Sequence[str] = (), owner: str = "", expires_after: float | None = None) -> DataFrame:
    """Reuse a prepared dataset keyed by (name, params, state of the input files) if it is published, else build it,
    write it once and re-read it (which also cuts the lineage).

    Each writer writes a folder of its own and publishes it by a manifest (data folder, ``owner``, time of expiry);
    of two writers the first to publish wins, the other one drops its folder and reads the winner's. A stage past its
    expiry is built anew, under a new folder: readers of the old one are not disturbed until ``drop_stages``.
    """
    path = stage_path(root, name, params, input_state(spark, inputs))
    found = read_manifest(spark, path)
    if found is not None and found["expires"] is not None and found["expires"] <= time.time():
        p, fs = _file_system(spark, path + ".manifest")
        fs.rename(p, _file_system(spark, f"{path}.expired-{uuid.uuid4().hex}")[0])
        found = None
    if found is None:
        data = f"{path}-{uuid.uuid4().hex}"
        build().write.parquet(data)
        found = {"data": data, "owner": owner, "expires": None if expires_after is None else time.time() + expires_after}
        if not _publish(spark, path, found):
            p, fs = _file_system(spark, data)
            fs.delete(p, True)
            found = read_manifest(spark, path)
    return spark.read.parquet(found["data"])


def drop_stages(spark: SparkSession, root: str, owner: str | None = None, now: float | None = None) -> list[str]:
    """Delete the stages under ``root`` that have expired, and all stages of ``owner`` if given; returns their folders.
    The manifest goes first, so nobody starts to read what is being deleted."""
    now = time.time() if now is None else now
    p, fs = _file_system(spark, root)
    dropped = []
    for status in fs.listStatus(p) if fs.exists(p) else []:
        m = re.fullmatch(r"(.*)\.(manifest|expired-\w+)", status.getPath().getName())
        if not m:
            continue
        stream = fs.open(status.getPath())
        try:
            manifest = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        past = manifest["expires"] is not None and manifest["expires"] <= now
        if past or owner is not None and manifest["owner"] == owner:
            fs.delete(status.getPath(), False)
            data, store = _file_system(spark, manifest["data"])
            store.delete(data, True)
            dropped.append(manifest["data"])
    return dropped


def append_trial_log(df: DataFrame, path: str) -> None:
    """Append finished-trial rows."""
    df.write.mode("append").parquet(path)
