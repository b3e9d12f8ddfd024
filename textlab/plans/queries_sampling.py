"""Registered queries: splits, samples, shuffles (Q1-Q6, Q8, Q11, Q12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.functions.hashing import hash_order
from textlab.operators import sampling as Q
from textlab.operators.windows import topk_per_group
from textlab.plans import adapters as A
from textlab.plans import oracles as O
from textlab.plans.registry import register

H = O.horder


@register("stratified_split", f"""WITH t AS (SELECT doc_id, quality FROM labels),
cc AS (SELECT quality, count(*) AS n_c FROM t GROUP BY quality),
tot AS (SELECT sum(n_c) AS n, (sum(n_c) * 1 + 5 - 1) // 5 AS n_val FROM cc),
q AS (SELECT quality, (n_c * n_val) // n AS base, (n_c * n_val) % n AS rem FROM cc, tot),
q2 AS (SELECT quality, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, quality)
         <= (SELECT n_val FROM tot) - (SELECT sum(base) FROM q) THEN 1 ELSE 0 END AS quota FROM q),
r AS (SELECT t.*, row_number() OVER (PARTITION BY t.quality ORDER BY {H('t.doc_id', 42, 'split')}, t.doc_id) AS rn
      FROM t)
SELECT r.doc_id, r.quality, CASE WHEN r.rn <= q2.quota THEN 'val' ELSE 'train' END AS split
FROM r JOIN q2 USING (quality)""")
def stratified_split(spark, d):
    lab = A.table(spark, d, "labels").select("doc_id", "quality")
    return Q.stratified_split(lab, "quality", "doc_id", frac=0.2)


@register("sample_n", f"""SELECT doc_id, lang FROM documents
ORDER BY {H('doc_id', 42, 'sample')}, doc_id LIMIT 500""")
def sample_n(spark, d):
    return Q.sample_n(A.table(spark, d, "documents").select("doc_id", "lang"), 500, "doc_id")


@register("balanced_sample", f"""SELECT doc_id, quality, {H('doc_id', 42, 'shuffle')} AS order_key FROM (
  SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {H('doc_id', 42, 'balanced')}, doc_id) AS rn
  FROM labels) WHERE rn <= 50""")
def balanced_sample(spark, d):
    lab = A.table(spark, d, "labels").select("doc_id", "quality")
    return Q.balanced_sample(lab, "quality", 50, "doc_id")


@register("sample_per_domain", f"""SELECT doc_id, domain, {H('doc_id', 42, 'shuffle')} AS order_key FROM (
  SELECT doc_id, {O.DOMAIN_SQL} AS domain,
         row_number() OVER (PARTITION BY {O.DOMAIN_SQL} ORDER BY {H('doc_id', 42, 'balanced')}, doc_id) AS rn
  FROM documents) WHERE rn <= 100""")
def sample_per_domain(spark, d):
    docs = A.documents(spark, d).select("doc_id", "domain")
    return Q.balanced_sample(docs, "domain", 100, "doc_id")


@register("bootstrap_per_lang", f"""WITH t AS (SELECT doc_id, lang FROM documents),
sz AS (SELECT lang, count(*) AS size FROM t GROUP BY lang),
rk AS (SELECT t.*, sz.size, CAST(row_number() OVER (PARTITION BY t.lang ORDER BY {H('t.doc_id', 42, 'boot')}, t.doc_id) AS INTEGER) AS rk
       FROM t JOIN sz USING (lang)),
big AS (SELECT lang, doc_id, rk AS draw FROM rk WHERE size >= 300 AND rk <= 300),
dr AS (SELECT lang, size, CAST(j AS INTEGER) AS draw FROM sz, range(1, 301) r(j) WHERE size < 300),
dr2 AS (SELECT lang, draw, CAST(CAST(('0x' || substr(md5('42:draw:' || lang || ':' || CAST(draw AS VARCHAR)), 1, 8)) AS BIGINT) % size + 1 AS INTEGER) AS rk FROM dr)
SELECT lang, doc_id, draw FROM big
UNION ALL SELECT dr2.lang, rk.doc_id, dr2.draw FROM dr2 JOIN rk ON dr2.lang = rk.lang AND dr2.rk = rk.rk""")
def bootstrap_per_lang(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "lang")
    return Q.bootstrap_per_group(docs, "lang", 300, "doc_id").select("lang", "doc_id", "draw")


@register("binary_few_shot", f"""SELECT doc_id, quality, {H('doc_id', 42, 'shuffle')} AS order_key FROM (
  SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {H('doc_id', 42, 'fewshot')}, doc_id) AS rn
  FROM labels) WHERE rn <= 5""")
def binary_few_shot(spark, d):
    lab = A.table(spark, d, "labels").select("doc_id", "quality")
    return Q.binary_few_shot(lab, 5, "doc_id", "quality")


@register("random_balanced", f"""WITH r AS (
  SELECT doc_id, quality, {H('doc_id', 42, 'rb')} AS h,
         row_number() OVER (PARTITION BY quality ORDER BY {H('doc_id', 42, 'rb')}, doc_id) AS rn FROM labels),
first AS (SELECT doc_id, quality, h FROM r WHERE rn <= 4),
fill AS (SELECT doc_id, quality, h FROM r WHERE doc_id NOT IN (SELECT doc_id FROM first)
         ORDER BY h, doc_id LIMIT (9 - (SELECT count(*) FROM first)))
SELECT doc_id, quality, {H('doc_id', 42, 'shuffle')} AS order_key FROM (SELECT * FROM first UNION ALL SELECT * FROM fill)""")
def random_balanced(spark, d):
    lab = A.table(spark, d, "labels").select("doc_id", "quality")
    return Q.random_balanced(lab, 9, "doc_id", "quality")


@register("shuffle", f"""SELECT doc_id, {H('doc_id', 42, 'shuffle')} AS order_key FROM documents""")
def shuffle(spark, d):
    return Q.shuffle(A.table(spark, d, "documents").select("doc_id"), "doc_id")


def _sample_errors_sql() -> str:
    return O.pool_sql("""SELECT w.model, w.doc_id, w.label, w.prediction, w.confidence, pool.cluster,
       pool.original_label, d.text
FROM w LEFT JOIN pool ON pool.id = w.doc_id JOIN documents d ON d.doc_id = w.doc_id WHERE w.rn <= 20""",
                      O.PREDICTIONS_CTE.strip() + f""",
w AS (SELECT p.model, p.doc_id, p.label, p.prediction, p.prob AS confidence,
             row_number() OVER (PARTITION BY p.model ORDER BY {H('p.doc_id', 42, 'errors')}, p.doc_id) AS rn
      FROM predictions p WHERE p.label <> p.prediction)""")


def sample_errors(spark, d):
    """Q11: up to 20 wrong rows per model in hash order, with confidence, the
    row's cluster and original label (null without a vector) and its text;
    ids are picked first, the pool and the wide text are joined last."""
    from textlab.plans.audit import labelled_pool
    p = A.predictions(spark, d).where(F.col("label") != F.col("prediction"))
    x = p.withColumn("_h", hash_order("doc_id", 42, "errors"))
    top = topk_per_group(x, ["model"], [F.col("_h"), F.col("doc_id")], 20, "_r")
    pool = labelled_pool(spark, d).select(F.col("id").alias("doc_id"), "cluster", "original_label")
    docs = A.table(spark, d, "documents").select("doc_id", "text")
    return (top.join(pool, "doc_id", "left").join(docs, "doc_id")
            .select("model", "doc_id", "label", "prediction", F.col("prob").alias("confidence"),
                    "cluster", "original_label", "text"))


register("sample_errors", _sample_errors_sql())(sample_errors)
