"""Registered queries of trained models and projections (H1, H6, H7, H9-H12). H6 and H9 have one least value, which SQL
reaches by other steps; where there is no SQL, tests compare with Spark ML or assert bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.operators.cluster import pca, prototype_clusters
from textlab.operators.metrics import binary_metrics, rank_auc
from textlab.operators.models import (batch_score, domain_shift_auc, featurize_pipeline, sweep,
                                      tfidf_terms, train_weighted_classifier)
from textlab.operators.sampling import stratified_split
from textlab.operators.trials import best_trial
from textlab.plans import adapters as A
from textlab.plans import oracles as O
from textlab.plans.registry import register


#: Mean-free products, then 40 squarings of the matrix (2^40 power steps); the row of the largest diagonal entry is the
#: axis with its largest loading positive. The second axis comes from what the first leaves.
PCA_SQL = f"""WITH RECURSIVE {O.VECTORS_CTE.strip()},
x AS (SELECT id, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM v),
c AS (SELECT id, pos, v - avg(v) OVER (PARTITION BY pos) AS v FROM x),
rowsum AS (SELECT a.pos AS i, b.pos AS j, sum(a.v * b.v) AS s FROM c a JOIN c b USING (id) GROUP BY a.pos, b.pos),
raw AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS r FROM rowsum GROUP BY i)),
top AS (SELECT sum(s) AS trace FROM rowsum WHERE i = j),
base AS (SELECT list_transform(m, lambda r: list_transform(r, lambda v: v / trace)) AS m FROM raw, top),
p1(k, m) AS (SELECT 0, m FROM base UNION ALL
  SELECT k + 1, list_transform(q, lambda r: list_transform(r, lambda v: v / t)) FROM (
    SELECT k, q, list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i][i])) AS t FROM (
      SELECT k, list_transform(m, lambda r: list_transform(m, lambda s: list_dot_product(r, s))) AS q FROM p1 WHERE k < 40))),
d1 AS (SELECT m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS diag FROM p1 WHERE k = 40),
r1 AS (SELECT m[list_position(diag, list_max(diag))] AS r FROM d1),
a1 AS (SELECT list_transform(r, lambda v: v / sqrt(list_dot_product(r, r))) AS a FROM r1),
left1 AS (SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j:
    m[i][j] - list_dot_product(a, list_transform(m, lambda r: list_dot_product(r, a))) * a[i] * a[j])) AS m FROM base, a1),
p2(k, m) AS (SELECT 0, m FROM left1 UNION ALL
  SELECT k + 1, list_transform(q, lambda r: list_transform(r, lambda v: v / t)) FROM (
    SELECT k, q, list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i][i])) AS t FROM (
      SELECT k, list_transform(m, lambda r: list_transform(m, lambda s: list_dot_product(r, s))) AS q FROM p2 WHERE k < 40))),
d2 AS (SELECT m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS diag FROM p2 WHERE k = 40),
r2 AS (SELECT m[list_position(diag, list_max(diag))] AS r FROM d2),
a2 AS (SELECT list_transform(r, lambda v: v / sqrt(list_dot_product(r, r))) AS a FROM r2),
cent AS (SELECT id, list(v ORDER BY pos) AS v FROM c GROUP BY id)
SELECT id, domain, original_label, round(list_dot_product(cent.v, a1.a), 6) AS pc1, round(list_dot_product(cent.v, a2.a), 6) AS pc2
FROM v JOIN cent USING (id), a1, a2"""

#: The same objective (reg 0.01, standardised dimensions, class weights) by 4,000 accelerated gradient steps.
SHIFT_SQL = f"""WITH RECURSIVE {O.VECTORS_CTE.strip()},
t AS (SELECT id, embedding, CASE WHEN domain = 'positive' THEN 1 ELSE 0 END AS label FROM v),
cc AS (SELECT label, count(*) AS n_c FROM t GROUP BY label),
tot AS (SELECT sum(n_c) AS n, (sum(n_c) * 1 + 5 - 1) // 5 AS n_val FROM cc),
q AS (SELECT label, (n_c * n_val) // n AS base, (n_c * n_val) % n AS rem FROM cc, tot),
q2 AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, label)
         <= (SELECT n_val FROM tot) - (SELECT sum(base) FROM q) THEN 1 ELSE 0 END AS quota FROM q),
r AS (SELECT t.*, row_number() OVER (PARTITION BY label ORDER BY {O.horder('id', 42, 'split')}, id) <= quota AS val
      FROM t JOIN q2 USING (label)),
tr AS (SELECT id, label, embedding, sqrt(count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY label))) AS w FROM r WHERE NOT val),
x AS (SELECT id, w, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM tr),
mean AS (SELECT pos, sum(w * v) / sum(w) AS m FROM x GROUP BY pos),
sd AS (SELECT pos, any_value(m) AS m, sqrt(sum(w * (v - m) * (v - m)) / (sum(w) - sum(w * w) / sum(w))) AS s
       FROM x JOIN mean USING (pos) GROUP BY pos),
z AS (SELECT id, pos, CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END AS v FROM x JOIN sd USING (pos)
      UNION ALL SELECT id, 1000000, 1.0 FROM tr),
data AS (SELECT (SELECT list(l ORDER BY id) FROM (SELECT id, list(v ORDER BY pos) AS l FROM z GROUP BY id)) AS zr,
  (SELECT list(l ORDER BY pos) FROM (SELECT pos, list(v ORDER BY id) AS l FROM z GROUP BY pos)) AS zc,
  (SELECT list(label::DOUBLE ORDER BY id) FROM tr) AS y, (SELECT list(w / (SELECT sum(w) FROM tr) ORDER BY id) FROM tr) AS w,
  (SELECT count(*) FROM sd) AS d),
fit(k, b, u) AS (SELECT 0, list_transform(range(0, d + 1), lambda i: 0.0::DOUBLE), list_transform(range(0, d + 1), lambda i: 0.0::DOUBLE) FROM data
  UNION ALL SELECT k + 1, b2, list_transform(range(1, d + 2), lambda j: b2[j] + mom * (b2[j] - b[j])) FROM (
    SELECT k, b, d, (sqrt(lip) - 0.1) / (sqrt(lip) + 0.1) AS mom, list_transform(range(1, d + 2), lambda j:
      u[j] - (list_dot_product(zc[j], e) + CASE WHEN j <= d THEN 0.01::DOUBLE * u[j] ELSE 0.0::DOUBLE END) / lip) AS b2 FROM (
      SELECT k, b, u, d, zc, 0.25::DOUBLE * (d + 1) + 0.01::DOUBLE AS lip, list_transform(range(1, len(zr) + 1), lambda i:
        w[i] * (1 / (1 + exp(-list_dot_product(zr[i], u))) - y[i])) AS e FROM fit, data WHERE k < 4000))),
beta AS (SELECT b FROM fit WHERE k = 4000),
vx AS (SELECT id, label, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM r WHERE val),
scored AS (SELECT id, any_value(label) AS label, 1 / (1 + exp(-(sum(CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END * b[pos + 1]) + any_value(b[len(b)])))) AS prob
  FROM vx JOIN sd USING (pos), beta GROUP BY id),
ranks AS (SELECT label, prob, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0::DOUBLE AS mid FROM scored),
n AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n0, sum(mid) FILTER (label = 1) AS ranks,
  count(*) FILTER (prob > 0.5 AND label = 1) AS tp, count(*) FILTER (prob > 0.5 AND label = 0) AS fp,
  count(*) FILTER (prob <= 0.5 AND label = 1) AS fn, count(*) FILTER (prob <= 0.5 AND label = 0) AS tn FROM ranks)
SELECT round((ranks - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * n0), 6) AS auc, round((tp + tn) / (p + n0)::DOUBLE, 6) AS accuracy,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0.0::DOUBLE END, 6) AS f1, tp, fp, fn, tn FROM n"""


@register("tfidf_features", """WITH t AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_\\p{M}]+'), lambda x: x <> '') AS toks
  FROM documents),
u AS (SELECT doc_id, unnest(list_distinct(toks)) AS term FROM t),
rare AS (SELECT term FROM u GROUP BY term HAVING count(*) < (SELECT count(*) FROM documents))
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(len(list_distinct(toks)) AS INTEGER) AS n_terms,
  CASE WHEN doc_id IN (SELECT doc_id FROM u JOIN rare USING (term)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM t""")
def tfidf_features(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "text")
    m = featurize_pipeline("text").fit(docs)
    out = m.transform(docs)
    weights = F.unwrap_udt("features")["values"]
    norm = F.sqrt(F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w * w))
    return out.select("doc_id", F.size(F.col("_tok")).alias("n_tokens"),
                      F.size(F.array_distinct(F.col("_tok"))).alias("n_terms"), F.round(norm, 6).alias("norm"))


@register("tfidf_terms", """WITH t AS (
  SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_\\p{M}]+'), lambda x: x <> '')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, tf * ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) AS w FROM tf JOIN df USING (term)),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY doc_id)
SELECT doc_id, term, round(coalesce(w / nullif(n, 0), 0.0), 6) AS weight FROM w JOIN n USING (doc_id)""")
def tfidf_terms_q(spark, d):
    return tfidf_terms(A.table(spark, d, "documents")).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@register("pca_projection", PCA_SQL)
def pca_projection(spark, d):
    v = A.vectors(spark, d)
    out, _ev = pca(v, "embedding", 2)
    return out.select("id", "domain", "original_label", F.round(F.col("pca")[0], 6).alias("pc1"),
                      F.round(F.col("pca")[1], 6).alias("pc2"))


@register("prototype_clusters")
def prototype_clusters_q(spark, d):
    v = A.two_class_vectors(spark, d)
    return prototype_clusters(v, "embedding", 4).select("id", "label", "cluster")


def _labelled_vectors(spark, d):
    v = A.two_class_vectors(spark, d).select("id", "embedding", F.col("original_label").alias("label"))
    return stratified_split(v, "label", "id", frac=0.2)


@register("domain_shift_auc", SHIFT_SQL)
def domain_shift_auc_q(spark, d):
    """H9: can a simple classifier tell the positive domain from the others?
    (accuracy / AUC near 0.5 = no shift)."""
    from textlab.functions.text import label_from_source
    v = A.vectors(spark, d).select("id", "embedding", label_from_source("domain").alias("label"))
    s = stratified_split(v, "label", "id", frac=0.2)
    return domain_shift_auc(s.where("split = 'train'"), s.where("split = 'val'"), "label", "embedding")


@register("rank_auc", f"""WITH {O.PREDICTIONS_CTE.strip()},
r AS (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY prob) + (count(*) OVER (PARTITION BY model, prob) - 1) / 2.0::DOUBLE AS mid
      FROM predictions WHERE prob IS NOT NULL AND label IS NOT NULL),
s AS (SELECT model, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n, sum(mid) FILTER (label = 1) AS ranks FROM r GROUP BY model)
SELECT model, p AS positives, n AS negatives, round((ranks - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * n), 9) AS auc FROM s""")
def rank_auc_q(spark, d):
    """H9's measure on the scored table: exact AUC per model."""
    return rank_auc(A.predictions(spark, d), ["model"]).select("model", "positives", "negatives", F.round("auc", 9).alias("auc"))


@register("sweep_best_trial")
def sweep_best_trial(spark, d):
    s = _labelled_vectors(spark, d)
    trials, _model, _threshold = sweep(s.where("split = 'train'"), s.where("split = 'val'"))
    return best_trial(trials, "trial", "eval_f1")


@register("weighted_text_classifier")
def weighted_text_classifier(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "text")
    lab = A.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    s = stratified_split(docs.join(lab, "doc_id"), "label", "doc_id", frac=0.2)
    model = train_weighted_classifier(s.where("split = 'train'"), "label", "text")
    scored = batch_score(model, s.where("split = 'val'"))
    return binary_metrics(scored.withColumn("model", F.lit("tfidf_lr")), ["model"])
