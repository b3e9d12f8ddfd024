"""Registered queries that run the incremental jobs (R1, R4) over the given
tables as file sources with ``availableNow`` triggers. Output goes to parquet
under the shared checkpoint folder and is read back (nothing is collected)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from textlab.functions.hashing import hfrac
from textlab.plans.registry import register
from textlab.session import ensure_checkpoint_dir
from textlab.streaming.jobs import first_examples, running_totals, score_new_files, streaming_dedup, streaming_progress


def _scratch(spark, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")


@register("stream_score_files", """SELECT event_id, user_id,
  CAST((CAST(('0x' || substr(md5('score' || ':' || CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0) > 0.5
       AS INTEGER) AS prediction
FROM events""")
def stream_score_files(spark, d):
    """Score each file of the events table once (file source, availableNow,
    idempotent per-batch sink)."""
    src = spark.read.parquet(f"{d}/events.parquet")
    root = _scratch(spark, "score")

    def score(df):
        return df.select("event_id", "user_id",
                         (hfrac("score", F.col("event_id")) > 0.5).cast("int").alias("prediction"))

    score_new_files(spark, f"{d}/events.parquet", src.schema, root + "/out", root + "/ck", score)
    return spark.read.parquet(root + "/out").select("event_id", "user_id", "prediction")


@register("stream_dedup_events", """SELECT user_id, event_type, arg_min(event_id, {'ts': ts, 'event_id': event_id}) AS event_id
FROM events GROUP BY user_id, event_type""")
def stream_dedup_events(spark, d):
    """Dedup of arriving events on (user, event type): the first event of each by (ts, event_id)."""
    from textlab.streaming.jobs import table_stream
    root = _scratch(spark, "dedup")
    stream = (table_stream(spark, f"{d}/events.parquet")
              .withColumn("key", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
              .withColumn("at", F.struct("ts", "event_id")))
    return streaming_dedup(stream, "key", "at", root + "/out", root + "/ck").select("user_id", "event_type", "event_id")


@register("stream_progress_totals", """SELECT count(*) AS cum_total,
  count(*) FILTER (WHERE quality = 1) AS cum_positives, count(*) FILTER (WHERE quality = 0) AS cum_negatives,
  count(*) FILTER (WHERE quality IS NULL) AS cum_nulls FROM labels""")
def stream_progress_totals(spark, d):
    """Labelling progress per micro-batch (G5 counts + first examples per label, keyed by batch id) over the labels
    table as a file source; the totals after the last batch come from the per-batch sink (the examples:
    ``stream_progress_examples``)."""
    src = spark.read.parquet(f"{d}/labels.parquet")
    root = _scratch(spark, "progress")
    streaming_progress(spark, f"{d}/labels.parquet", src.schema, root + "/out", root + "/ck", label_col="quality")
    totals = running_totals(spark, root + "/out")
    return totals.orderBy(F.desc("batch_id")).limit(1).drop("batch_id")


@register("stream_progress_examples", """SELECT quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id, toxic NULLS FIRST)::INTEGER AS pick,
  doc_id, toxic FROM labels WHERE quality IS NOT NULL QUALIFY pick <= 5""")
def stream_progress_examples(spark, d):
    """The first five rows of each label over all batches, from the state that batches merge."""
    src = spark.read.parquet(f"{d}/labels.parquet")
    root = _scratch(spark, "examples")
    streaming_progress(spark, f"{d}/labels.parquet", src.schema, root + "/out", root + "/ck", label_col="quality",
                       per_label=5, order_by=("doc_id", "toxic"))
    return first_examples(spark, root + "/out").select("quality", "pick", "doc_id", "toxic")


def _resume_sql() -> str:
    from textlab.plans.queries_text import _json_replies_sql
    return f"""WITH {_json_replies_sql()}
SELECT post_id, CASE WHEN post_id % 4 = 0 THEN 'done' ELSE DM END AS DM,
       CASE WHEN post_id % 4 = 0 THEN 'done' ELSE Sentiment END AS Sentiment,
       CASE WHEN post_id % 4 = 0 THEN 'ok' ELSE parse END AS parse FROM jparsed"""


def resume_generation_slices(spark, d):
    """R2: resumable generation. Rows already in the output folder (the
    ``done_rows`` fixture) are skipped; the rest are generated with the reply
    function and appended in hash slices, so an interruption loses one slice."""
    from textlab.functions.parse import json_reply
    from textlab.operators.scoring import apply_reply_fn
    from textlab.plans import fixture_models as FM
    from textlab.streaming.jobs import resume_generation

    todo = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("post_id"), "text")
    out = _scratch(spark, "resume") + "/out"
    (todo.where(F.col("post_id") % 4 == 0)
     .select("post_id", F.lit("done").alias("DM"), F.lit("done").alias("Sentiment"), F.lit("ok").alias("parse"))
     .write.mode("overwrite").parquet(out))

    def generate(df):
        r = apply_reply_fn(df, FM.json_reply_model).select("post_id", json_reply("reply").alias("p"))
        return r.select("post_id", F.col("p.dm").alias("DM"), F.col("p.sentiment").alias("Sentiment"), F.col("p.status").alias("parse"))

    resume_generation(todo, out, "post_id", generate, slice_rows=4096)
    return spark.read.parquet(out).select("post_id", "DM", "Sentiment", "parse")


register("resume_generation_slices", _resume_sql())(resume_generation_slices)
