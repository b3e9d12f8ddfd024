"""Registered round trips through the sources and sinks (S1-S9) and the per-file load report.

Given tables are written to the shared scratch folder as several files (different column orders, one
without the wanted column, one that is no data file at all) and read back through ``textlab.sources``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from textlab.functions.text import PANDAS_NULL_TOKENS
from textlab.operators import aggregate as G
from textlab.plans import adapters as A
from textlab.plans import oracles as O
from textlab.plans.registry import register
from textlab.session import ensure_checkpoint_dir, small
from textlab.sources import files as S


def _scratch(spark, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "sources", f"{name}-{uuid.uuid4().hex}")


def _csv(df, path: str) -> None:
    (df.write.option("header", True).option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def _junk(spark, path: str) -> None:
    """A file that ends like a data file and holds none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(b"no data here"))
    out.close()


def _by_folder(report):
    """(folder, reason) of the skipped files, each once: a folder has as many files as its write had tasks."""
    return report.select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"), "reason").distinct()


_NULLS = "(" + ", ".join(f"'{t}'" for t in PANDAS_NULL_TOKENS) + ")"


@register("source_read_posts", f"""WITH {O.POSTS_CTE.strip()}
SELECT CASE WHEN title IN {_NULLS} THEN NULL ELSE title END AS title,
       CASE WHEN body IN {_NULLS} THEN NULL ELSE body END AS selftext_or_url_reference, retrieved_on FROM posts""")
def source_read_posts(spark, d):
    """A folder of CSVs whose files order their columns differently."""
    root = _scratch(spark, "posts")
    p = A.posts(spark, d).select("post_id", "title", F.col("body").alias("selftext_or_url_reference"), "retrieved_on")
    _csv(p.where("post_id % 2 = 0").select("title", "selftext_or_url_reference", "retrieved_on"), root + "/a")
    _csv(p.where("post_id % 2 = 1").select("retrieved_on", "post_id", "selftext_or_url_reference", "title"), root + "/b")
    return S.read_posts(spark, root)


@register("source_read_messages_dir", f"""WITH {O.MESSAGES_CTE.strip()}
SELECT 'row' AS kind, Message AS value FROM messages WHERE conv_id % 3 <> 2 AND Message IS NOT NULL
UNION ALL SELECT 'skipped', 'no column Message' UNION ALL SELECT 'skipped', 'unreadable'""")
def source_read_messages_dir(spark, d):
    """S2 + S5: every parquet file of a folder that has the column; the others are reported."""
    root = _scratch(spark, "messages")
    m = A.messages(spark, d).select("conv_id", "Message")
    m.where("conv_id % 3 = 0").write.parquet(root + "/a")
    m.where("conv_id % 3 = 1").write.parquet(root + "/b")
    m.where("conv_id % 3 = 2").withColumnRenamed("Message", "other").write.parquet(root + "/c")
    _junk(spark, root + "/broken.parquet")
    rows, report = S.read_messages_dir(spark, root)
    return (rows.select(F.lit("row").alias("kind"), F.col("sentence").alias("value"))
            .unionByName(_by_folder(report).select(F.lit("skipped").alias("kind"), F.col("reason").alias("value"))))


@register("source_read_columns", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS VARCHAR) AS quality FROM labels""")
def source_read_columns(spark, d):
    """S3: two columns of a wider CSV."""
    root = _scratch(spark, "columns")
    _csv(A.table(spark, d, "labels"), root)
    return S.read_columns(spark, S._list_files(spark, root, ".csv"), ["doc_id", "quality"])


@register("source_tolerant_union", f"""WITH {O.MESSAGES_CTE.strip()}
SELECT 'row' AS kind, CAST(message_id AS VARCHAR) AS a, Message AS b FROM messages WHERE message_id % 3 <> 2
UNION ALL SELECT 'skipped', 'missing Message', NULL UNION ALL SELECT 'skipped', 'unreadable', NULL""")
def source_tolerant_union(spark, d):
    """Files with the needed columns in any order are united, the rest reported."""
    root = _scratch(spark, "union")
    m = A.messages(spark, d).select("message_id", F.col("Message"), "role")
    parts = {"a": m.where("message_id % 3 = 0"), "b": m.where("message_id % 3 = 1").select("role", "Message", "message_id"),
             "c": m.where("message_id % 3 = 2").select("message_id", "role")}
    for name, df in parts.items():
        df.write.parquet(f"{root}/{name}")
    _junk(spark, root + "/broken.parquet")
    rows, report = S.tolerant_union(spark, S._list_files(spark, root, ".parquet"), ["message_id", "Message"], "parquet")
    return (rows.select(F.lit("row").alias("kind"), F.col("message_id").cast("string").alias("a"), F.col("Message").alias("b"))
            .unionByName(_by_folder(report).select(F.lit("skipped").alias("kind"), F.col("reason").alias("a"),
                                                   F.lit(None).cast("string").alias("b"))))


@register("source_write_labelled", f"""SELECT doc_id, source, CAST({O.DOMAIN_SQL} = 'positive' AS INTEGER) AS label FROM documents
UNION ALL SELECT -1, 'src1', 9""")
def source_write_labelled(spark, d):
    """Partitions are overwritten one by one: the second write replaces src1, the third only adds to it."""
    root = _scratch(spark, "labelled")
    x = A.documents(spark, d).select("doc_id", "source", (F.col("domain") == "positive").cast("int").alias("label"))
    S.write_labelled(x.withColumn("label", F.lit(7)), root)
    S.write_labelled(x, root)
    extra = x.where("source = 'src1'").unionByName(spark.range(1).select(
        F.lit(-1).cast("long").alias("doc_id"), F.lit("src1").alias("source"), F.lit(9).alias("label")))
    S.write_labelled(extra, root)
    return spark.read.parquet(root).select("doc_id", "source", "label")


@register("source_write_predictions", f"""WITH {O.PREDICTIONS_CTE.strip()}
SELECT model, doc_id, label, prediction, label = prediction AS correct FROM predictions""")
def source_write_predictions(spark, d):
    """One table partitioned by model, with ``correct``."""
    root = _scratch(spark, "predictions")
    S.write_predictions(A.predictions(spark, d).select("model", "doc_id", "label", "prediction"), root)
    return spark.read.parquet(root).select("model", "doc_id", "label", "prediction", "correct")


@register("source_materialize_stage", "SELECT doc_id, quality, toxic, 1 AS builds FROM labels")
def source_materialize_stage(spark, d):
    """The second call reads what the first one wrote."""
    root, builds = _scratch(spark, "stage"), []

    def build():
        builds.append(1)
        return A.table(spark, d, "labels")
    S.materialize_stage(spark, root, "labels", {"v": 1}, build, [f"{d}/labels.parquet"])
    out = S.materialize_stage(spark, root, "labels", {"v": 1}, build, [f"{d}/labels.parquet"])
    return out.withColumn("builds", F.lit(len(builds)))


@register("source_append_trial_log", f"WITH {O.TRIAL_LOG_CTE.strip()}\nSELECT trial, step, eval_f1 FROM trial_log")
def source_append_trial_log(spark, d):
    """Trials appended in two writes."""
    root = _scratch(spark, "trials")
    t = A.trial_log(spark, d)
    S.append_trial_log(t.where("trial % 2 = 0"), root)
    S.append_trial_log(t.where("trial % 2 = 1"), root)
    return spark.read.parquet(root).select("trial", "step", "eval_f1")


@register("load_report_files", f"""WITH x AS (
  SELECT CASE WHEN d.doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS file, d.text,
         CAST(trunc(TRY_CAST(CAST(l.quality AS VARCHAR) AS DOUBLE)) AS INTEGER) AS lab
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
y AS (SELECT *, (text IS NOT NULL AND {O.strip("text")} <> '' AND lab IS NOT NULL) AS kept FROM x)
SELECT file, count(*) AS loaded, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS removed,
       count(*) FILTER (WHERE kept AND lab = 1) AS positives, count(*) FILTER (WHERE kept AND lab = 0) AS negatives,
       NULL::VARCHAR AS reason
FROM y GROUP BY ROLLUP (file)
UNION ALL SELECT 'c', NULL, NULL, NULL, NULL, NULL, 'missing text'""")
def load_report_files(spark, d):
    """G4 by the file each row came from; a skipped file is a row with its reason."""
    root = _scratch(spark, "report")
    lab = small(A.table(spark, d, "labels").select("doc_id", "quality"), 24)  # the texts stay where they are if it is
    x = A.table(spark, d, "documents").select("doc_id", "text").join(lab, "doc_id", "left")
    x.where("doc_id % 3 = 0").write.parquet(root + "/a")
    x.where("doc_id % 3 <> 0").write.parquet(root + "/b")
    x.drop("text").write.parquet(root + "/c")
    rows, skipped = S.tolerant_union(spark, S._list_files(spark, root, ".parquet"), ["text", "quality"], "parquet")
    name = lambda c: F.regexp_extract(c, r"/([abc])/[^/]*$", 1)
    report = G.load_report(rows.withColumn("file", name("source_file")), "file", "text", "quality")
    return report.withColumn("reason", F.lit(None).cast("string")).unionByName(
        _by_folder(skipped).withColumnRenamed("folder", "file"), allowMissingColumns=True)
