"""Row scoring with a caller's function.

Reply functions are applied with ``mapInArrow`` to parts of Arrow batches, scorers with ``mapInPandas``; one Python
worker per task, initialised once per task (``init``), never per row. A
failing row becomes a row with a status, not a failed task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textlab.functions.parse import json_reply, two_line_reply
from textlab.operators.joins import pending_rows

#: The function sees rows of about this many bytes at a time: whole Arrow batches of long texts fill a worker's memory.
CALL_BYTES = 1 << 20

ReplyFn = Callable[[pd.DataFrame], pd.Series]


def apply_reply_fn(df: DataFrame, reply_fn: ReplyFn, out_col: str = "reply",
                   init: Callable[[], object] | None = None) -> DataFrame:
    """Add ``out_col`` (string) from ``reply_fn(batch) -> Series`` and a
    ``status`` column ('ok' / 'error: ...'). ``init()`` (e.g. model load)
    runs once per task and is passed as ``reply_fn.state``."""
    schema = StructType(list(df.schema.fields)).add(out_col, "string").add("status", "string")

    def replied(pdf: pd.DataFrame, state) -> tuple[list, list]:
        call = (lambda x: reply_fn(x)) if state is None else (lambda x: reply_fn(x, state))  # type: ignore[call-arg]
        try:
            return call(pdf).astype(object).tolist(), ["ok"] * len(pdf)
        except Exception:  # noqa: BLE001 - fall back to row by row
            vals, stats = [], []
            for i in range(len(pdf)):
                try:
                    vals.append(call(pdf.iloc[i:i + 1]).iloc[0])
                    stats.append("ok")
                except Exception as e:  # noqa: BLE001
                    vals.append(None)
                    stats.append(f"error: {type(e).__name__}")
            return vals, stats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = init() if init else None
        for batch in batches:
            step = max(1, CALL_BYTES * batch.num_rows // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                vals, stats = replied(part.to_pandas(), state)
                vals = pa.array([None if v is None or v is pd.NA or v != v else v for v in vals], pa.string())
                yield pa.record_batch([*part.columns, vals, pa.array(stats, pa.string())], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def label_with_reply_model(df: DataFrame, reply_fn: ReplyFn, text_col: str = "text") -> DataFrame:
    """Classify every row with a reply model, parse its two-line reply
    (T1) into ``label`` (null on failure) and ``explanation``."""
    r = apply_reply_fn(df, reply_fn)
    parsed = r.withColumn("_p", two_line_reply("reply"))
    return parsed.withColumn("label", F.col("_p.label")).withColumn("explanation", F.col("_p.explanation")).drop("_p")


def generate_pairs(todo: DataFrame, done: DataFrame | None, reply_fn: ReplyFn, key: str,
                   retry_errors: bool = False) -> DataFrame:
    """One generated reply per pending row (E2 anti join against
    ``done``), parsed as JSON (T2) into ``DM`` / ``Sentiment`` / ``parse``.
    Rows already done are kept as they are; with ``retry_errors`` done rows
    whose parse failed are generated again."""
    if done is not None:
        keep = done.where(F.col("parse") == "ok") if retry_errors else done
        pending = pending_rows(todo, keep, key)
    else:
        keep, pending = None, todo
    r = apply_reply_fn(pending, reply_fn)
    p = r.withColumn("_p", json_reply("reply"))
    new = p.withColumn("DM", F.col("_p.dm")).withColumn("Sentiment", F.col("_p.sentiment")).withColumn("parse", F.col("_p.status")).drop("_p")
    return new if keep is None else keep.unionByName(new, allowMissingColumns=True)


def batch_score(df: DataFrame, score_fn: Callable[[pd.DataFrame], pd.Series],
                out_col: str = "score") -> DataFrame:
    """Pluggable batch scorer (double output) over Arrow batches."""
    schema = StructType(list(df.schema.fields)).add(out_col, "double")

    def run(it):
        for pdf in it:
            pdf[out_col] = score_fn(pdf).astype("float64")
            yield pdf

    return df.mapInPandas(run, schema)
