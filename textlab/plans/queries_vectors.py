"""Registered queries over vectors: centroids, clusters, kNN, few-shot
selection, silhouette (G16, G17, G20, G21, E1, E3, E8, H3-H5, H8, H13, Q7,
Q9, Q10, D3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.operators import aggregate as G
from textlab.operators.dedup import stack_embeddings
from textlab.operators.fewshot import (near_centroid_sample, quadrant_few_shot, retrieve_and_classify,
                                       semantic_balanced)
from textlab.operators.joins import attach_cluster_label
from textlab.operators.knn import knn, silhouette, silhouette_closed
from textlab.operators.vectors import (attach_centroid, domain_nn_distance, domain_similarity, group_mean_vector,
                                       median_flag)
from textlab.plans import adapters as A
from textlab.plans import oracles as O
from textlab.plans.audit import clustered_vectors, labelled_pool
from textlab.plans.registry import register

H = O.horder

EX = """ex AS (SELECT vec_id AS id, label, unnest(range(1, len(embedding) + 1)) AS dim,
                CAST(unnest(embedding) AS DOUBLE) AS val FROM embeddings),
cent AS (SELECT label, dim, avg(val) AS c FROM ex GROUP BY label, dim),
dist AS (SELECT ex.id, ex.label, sqrt(sum((ex.val - cent.c) * (ex.val - cent.c))) AS dist
         FROM ex JOIN cent ON ex.label = cent.label AND ex.dim = cent.dim GROUP BY ex.id, ex.label)"""


@register("group_mean_vector", """WITH x AS (SELECT label, unnest(range(0, len(embedding))) AS pos,
       CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(v), 6) AS v FROM x GROUP BY label, pos""")
def group_mean_vector_q(spark, d):
    e = A.table(spark, d, "embeddings")
    c = group_mean_vector(e, "label")
    return c.select("label", F.posexplode("centroid").alias("pos", "v")).select(
        "label", F.col("pos").cast("int"), F.round("v", 6).alias("v"))


@register("attach_centroid", f"WITH {EX}\nSELECT id, label, round(dist, 6) AS dist FROM dist")
def attach_centroid_q(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    c = group_mean_vector(e, "label")
    return attach_centroid(e, c, "label").select("id", "label", F.round("dist", 6).alias("dist"))


@register("near_centroid_sample", f"""WITH {EX},
r1 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, id) AS rn1 FROM dist),
r2 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H('id', 42, 'near')}, id) AS rn2
       FROM r1 WHERE rn1 <= 15)
SELECT id, label FROM r2 WHERE rn2 <= 5""")
def near_centroid_sample_q(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return near_centroid_sample(e, "label", 5, 3).select("id", "label")


@register("median_flag", """SELECT doc_id, CAST(n_chars > (SELECT median(n_chars) FROM documents) AS INTEGER)
  AS long_text FROM documents""")
def median_flag_q(spark, d):
    x = A.table(spark, d, "documents").select("doc_id", "n_chars")
    return median_flag(x, "n_chars").select("doc_id", "long_text")


@register("domain_similarity", f"""WITH x AS (
  SELECT {O.DOMAIN_SQL} AS domain, unnest(range(1, len(e.embedding) + 1)) AS dim,
         CAST(unnest(e.embedding) AS DOUBLE) AS v
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id),
c AS (SELECT domain, dim, avg(v) AS v FROM x GROUP BY domain, dim),
n AS (SELECT domain, sqrt(sum(v * v)) AS nrm FROM c GROUP BY domain),
p AS (SELECT a.domain AS group_a, b.domain AS group_b, sum(a.v * b.v) AS dt
      FROM c a JOIN c b ON a.dim = b.dim GROUP BY a.domain, b.domain)
SELECT group_a, group_b, round(dt / (na.nrm * nb.nrm), 6) AS cosine
FROM p JOIN n na ON p.group_a = na.domain JOIN n nb ON p.group_b = nb.domain""")
def domain_similarity_q(spark, d):
    return domain_similarity(A.vectors(spark, d), "domain")


@register("domain_nn_distance", f"""WITH t AS (
  SELECT e.vec_id AS id, {O.DOMAIN_SQL} AS domain, CAST(e.embedding AS DOUBLE[]) AS v
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id),
p AS (SELECT a.id, a.domain AS group_a, b.domain AS group_b,
        min(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))) AS m
      FROM t a JOIN t b ON a.id <> b.id GROUP BY ALL)
SELECT group_a, group_b, round(avg(m), 6) AS distance FROM p GROUP BY ALL""")
def domain_nn_distance_q(spark, d):
    return domain_nn_distance(A.vectors(spark, d).select("id", "domain", "embedding"))


@register("stack_embeddings", """SELECT vec_id AS id, CASE WHEN label < 5 THEN 'group_a' ELSE 'group_b' END AS domain,
  CAST(len(embedding) AS INTEGER) AS dims, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings""")
def stack_embeddings_q(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    out = stack_embeddings([("group_a", e.where("label < 5")), ("group_b", e.where("label >= 5"))])
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("id", "domain", F.size("embedding").alias("dims"), F.round(total, 4).alias("total"))


@register("cosine_to_centroid", f"""WITH {EX},
d AS (SELECT ex.id, ex.label, sum(ex.val * cent.c) AS dt, sqrt(sum(ex.val * ex.val)) AS nv, sqrt(sum(cent.c * cent.c)) AS nc
      FROM ex JOIN cent ON ex.label = cent.label AND ex.dim = cent.dim GROUP BY ex.id, ex.label)
SELECT id, label, round(dt / (nv * nc), 6) AS cosine FROM d""")
def cosine_to_centroid(spark, d):
    """Each vector's cosine with its group's mean."""
    from textlab.functions.vector import cosine
    from textlab.session import small
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    c = small(group_mean_vector(e, "label"), 1024)
    return e.join(c, "label").select("id", "label", F.round(cosine("embedding", "centroid"), 6).alias("cosine"))


@register("bincount_clusters", O.kmeans_sql(
    "CASE WHEN domain = 'positive' THEN 0 ELSE 1 END",
    "SELECT c.cluster, count(a.id) AS n FROM (SELECT unnest([0, 1]) AS cluster) c "
    "LEFT JOIN assigned a ON a.cluster = c.cluster GROUP BY c.cluster"))
def bincount_clusters(spark, d):
    return G.bincount(clustered_vectors(spark, d, "domain"), "cluster", 2)


@register("cluster_labels", O.pool_sql("SELECT id, cluster, original_label, label FROM pool"))
def cluster_labels_q(spark, d):
    return labelled_pool(spark, d).select("id", "cluster", "original_label", "label")


@register("attach_cluster_label", O.kmeans_sql(
    "CASE WHEN domain = 'positive' THEN 0 ELSE 1 END",
    "SELECT d.doc_id, d.lang, a.cluster, CAST(1 - a.cluster AS INTEGER) AS label "
    "FROM documents d JOIN assigned a ON d.doc_id = a.id"))
def attach_cluster_label_q(spark, d):
    a = clustered_vectors(spark, d, "domain").select(F.col("id").alias("doc_id"), "cluster")
    docs = A.table(spark, d, "documents").select("doc_id", "lang")
    return attach_cluster_label(docs, a, "doc_id").select("doc_id", "lang", "cluster", "label")


@register("quadrant_report", O.pool_sql("""SELECT q.cluster, q.original_label,
  count(p.id) AS n, CAST(sum(count(p.id)) OVER () AS BIGINT) AS total, count(p.id) = 0 AS empty,
  CASE WHEN q.cluster + q.original_label = 1 THEN 'pattern' ELSE 'exception' END AS quadrant
FROM (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(cluster, original_label)) q
LEFT JOIN pool p ON p.cluster = q.cluster AND p.original_label = q.original_label
GROUP BY q.cluster, q.original_label"""))
def quadrant_report_q(spark, d):
    return G.quadrant_report(labelled_pool(spark, d), "cluster", "original_label")


QUAD_SQL = f"""SELECT id, quadrant, kind, order_key FROM (
  SELECT *, row_number() OVER (PARTITION BY quadrant ORDER BY {H('id', 42, 'near')}, id) AS rn2 FROM (
    SELECT *, row_number() OVER (PARTITION BY quadrant ORDER BY dist, id) AS rn1 FROM (
      SELECT p.id, p.quadrant, p.kind, p.quota, p.oversample, {H('p.id', 42, 'shuffle')} AS order_key,
             sqrt(sum((x.v - c.v) * (x.v - c.v))) AS dist
      FROM qp p JOIN qx x ON p.id = x.id JOIN qc c ON c.quadrant = p.quadrant AND c.dim = x.dim
      GROUP BY ALL)) WHERE rn1 <= quota * oversample) WHERE rn2 <= quota"""


@register("quadrant_few_shot", O.pool_sql(QUAD_SQL, f"""
pcl AS (SELECT positive_cluster FROM pc),
qq AS (SELECT * FROM (VALUES ('0_1', 3, 1), ('1_0', 3, 5), ('0_0', 1, 5), ('1_1', 1, 5)) t(quadrant, quota, oversample)),
qp AS (SELECT a.id, a.embedding, a.rc || '_' || CAST(a.original_label AS VARCHAR) AS quadrant,
              CASE WHEN a.rc_i + a.original_label = 1 THEN 'pattern' ELSE 'exception' END AS kind, qq.quota, qq.oversample
       FROM (SELECT pool.*, CASE WHEN pool.cluster = pcl.positive_cluster THEN '0' ELSE '1' END AS rc,
                    CASE WHEN pool.cluster = pcl.positive_cluster THEN 0 ELSE 1 END AS rc_i FROM pool, pcl) a
       JOIN qq ON qq.quadrant = a.rc || '_' || CAST(a.original_label AS VARCHAR)),
qx AS (SELECT id, unnest(range(1, len(embedding) + 1)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM qp),
qc AS (SELECT p.quadrant, x.dim, avg(x.v) AS v FROM qp p JOIN qx x ON p.id = x.id GROUP BY ALL)"""))
def quadrant_few_shot_q(spark, d):
    pool = labelled_pool(spark, d)  # carries the H3 positive_cluster column
    picked = quadrant_few_shot(pool, 3, 3, positive_cluster=F.col("positive_cluster"))
    return picked.select("id", "quadrant", "kind", "order_key")


KNN_SQL = """WITH t AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, CAST(label < 5 AS INTEGER) AS label FROM embeddings),
pairs AS (SELECT a.id AS target_id, b.id AS neighbor_id, b.label,
  list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS sim
  FROM t a JOIN t b ON a.id <> b.id),
nb AS (SELECT *, CAST(row_number() OVER (PARTITION BY target_id ORDER BY sim DESC, neighbor_id) AS INTEGER) AS rank
       FROM pairs QUALIFY rank <= 8)"""


def _two_class(spark, d):
    return A.two_class_vectors(spark, d).select("id", "embedding", F.col("original_label").alias("label"))


@register("knn_pool", KNN_SQL + "\nSELECT target_id, neighbor_id, rank, round(sim, 6) AS sim FROM nb")
def knn_pool(spark, d):
    v = _two_class(spark, d)
    nb = knn(v, v, 8, "id", "embedding")
    return nb.select("target_id", "neighbor_id", "rank", F.round("sim", 6).alias("sim"))


SEM_SQL = KNN_SQL + """,
c1 AS (SELECT *, row_number() OVER (PARTITION BY target_id, label ORDER BY rank) AS rc FROM nb),
c2 AS (SELECT *, rc <= 2 AS chosen FROM c1),
c3 AS (SELECT *, 4 - sum(CAST(chosen AS INTEGER)) OVER (PARTITION BY target_id) AS missing,
              row_number() OVER (PARTITION BY target_id, chosen ORDER BY rank) AS rr FROM c2),
sel AS (SELECT * FROM c3 WHERE chosen OR rr <= missing)"""


@register("semantic_balanced", SEM_SQL + "\nSELECT target_id, neighbor_id, label, rank FROM sel")
def semantic_balanced_q(spark, d):
    v = _two_class(spark, d)
    nb = knn(v, v, 8, "id", "embedding", ["label"])
    return semantic_balanced(nb, 4, "label").select("target_id", "neighbor_id", "label", "rank")


def _retrieve_sql() -> str:
    from textlab.functions import lexicon as L
    from textlab.plans.queries_text import RULES_SQL, TARGET_SQL
    rules = RULES_SQL + " || chr(10) || 'Cue words: " + ", ".join(L.KEYWORDS) + "'"
    sem = SEM_SQL.replace(
        "WITH t AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, CAST(label < 5 AS INTEGER) AS label FROM embeddings)",
        "WITH t AS (SELECT e.vec_id AS id, CAST(e.embedding AS DOUBLE[]) AS e, CAST(e.label < 5 AS INTEGER) AS label, "
        "d.text FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id)")
    return sem + f""",
agg AS (SELECT target_id, sum(CASE WHEN label = 1 THEN greatest(sim, 0.0) ELSE 0.0 END) AS s1,
               sum(CASE WHEN label = 0 THEN greatest(sim, 0.0) ELSE 0.0 END) AS s0,
               count(*) AS n FROM sel GROUP BY target_id),
res AS (SELECT target_id, CAST(s1 > s0 AS INTEGER) AS prediction,
               CASE WHEN s1 + s0 > 0 THEN s1 / (s1 + s0) ELSE 0.5 END AS p1, CAST(n AS INTEGER) AS examples_used FROM agg),
blk AS (SELECT sel.target_id, string_agg(chr(10) || 'Message: "' || t.text || '"' || chr(10) ||
               'Answer: ' || CAST(sel.label AS VARCHAR), '' ORDER BY sel.rank) AS ex
        FROM sel JOIN t ON t.id = sel.neighbor_id GROUP BY sel.target_id)
SELECT t.id AS target_id, coalesce(prediction, 0) AS prediction,
       coalesce(round(greatest(p1, 1 - p1), 6), 0.0) AS confidence,
       coalesce(round(p1, 6), 0.5) AS p_positive, coalesce(examples_used, 0) AS examples_used,
       CASE WHEN examples_used > 0 THEN 'ok' ELSE 'no examples' END AS status,
       {rules} || chr(10) || chr(10) || '### Examples' || coalesce(blk.ex, '') || {TARGET_SQL.format(text='t.text')} AS prompt
FROM t LEFT JOIN res ON t.id = res.target_id LEFT JOIN blk ON t.id = blk.target_id"""


def retrieve_and_classify_q(spark, d):
    v = A.vectors(spark, d).select("id", "embedding", F.col("original_label").alias("label"), "text")
    return retrieve_and_classify(v, v, 4, "id", "embedding", "label", text_col="text")


register("retrieve_and_classify", _retrieve_sql())(retrieve_and_classify_q)


def _silhouette_sql(distance: str) -> str:
    return O.kmeans_sql(
        "CASE WHEN domain = 'positive' THEN 0 ELSE 1 END", """
SELECT round(avg(CASE WHEN n_own <= 1 OR b IS NULL THEN 0.0 WHEN greatest(a, b) = 0 THEN 0.0
                      ELSE (b - a) / greatest(a, b) END), 6) AS silhouette,
       count(*) AS n_points, count(DISTINCT own) AS n_clusters FROM sc""", """
pts AS (SELECT id, cluster, CAST(embedding AS DOUBLE[]) AS e FROM assigned),
sz AS (SELECT cluster, count(*) AS n FROM pts GROUP BY cluster),
ps AS (SELECT a.id, a.cluster AS own, b.cluster AS c, sum(DISTANCE) AS s
       FROM pts a JOIN pts b ON true GROUP BY a.id, a.cluster, b.cluster),
per AS (SELECT ps.id, ps.own,
          max(CASE WHEN c = own THEN sz.n END) AS n_own, max(CASE WHEN c = own THEN s END) AS s_own,
          min(CASE WHEN c <> own THEN s / sz.n END) AS b
        FROM ps JOIN sz ON ps.c = sz.cluster GROUP BY ps.id, ps.own),
sc AS (SELECT *, s_own / (n_own - 1) AS a FROM per)""".replace("DISTANCE", distance))


@register("silhouette", _silhouette_sql("list_distance(a.e, b.e)"))
def silhouette_q(spark, d):
    return silhouette(clustered_vectors(spark, d, "domain"), "cluster", "id", "embedding")


@register("silhouette_squared", _silhouette_sql("list_distance(a.e, b.e) * list_distance(a.e, b.e)"))
def silhouette_squared_q(spark, d):
    """H5 in linear time: the closed form with squared distances."""
    return silhouette_closed(clustered_vectors(spark, d, "domain"), "cluster", "embedding")


# Quadrant -> section of the cluster prompt and its answer.
QUADRANT_GROUPS = [("0_1", 1, 1), ("1_0", 2, 0), ("0_0", 3, 1), ("1_1", 4, 0)]


def _quadrant_prompt_sql() -> str:
    from textlab.functions import lexicon as L
    from textlab.plans.queries_text import RULES_SQL, TARGET_SQL, _any, _indicators_sql, _reason_sql, hits_sql
    low = lambda x: x.replace("lower(text)", "lower(t)")
    hits = hits_sql(A.TEST_LEXICON, "lower(t)")
    pct = lambda c: f"CAST(CAST(round(100 * {c}, 0) AS INTEGER) AS VARCHAR) || '%'"
    tone = f"CASE WHEN {_any(L.TONE_MARKERS, 'lower(t)')} THEN 'negative' ELSE 'neutral' END"
    groups = " ".join(f"WHEN '{q}' THEN {g}" for q, g, _ in QUADRANT_GROUPS)
    answers = " ".join(f"WHEN '{q}' THEN '{a}'" for q, _, a in QUADRANT_GROUPS)
    heads = ["### Pattern: cue words, positive", "### Pattern: no cue words, negative",
             "### Exception: no cue words, positive", "### Exception: cue words, negative"]
    sections = " || ".join(f"coalesce(chr(10) || chr(10) || '{h}' || string_agg(msg || chr(10) || 'Reasoning: ' || reasoning "
                           f"|| ans, '' ORDER BY order_key, id) FILTER (g = {i}), '')" for i, h in enumerate(heads, 1))
    extra = f"""
pcl AS (SELECT positive_cluster FROM pc),
qq AS (SELECT * FROM (VALUES ('0_1', 3, 1), ('1_0', 3, 5), ('0_0', 1, 5), ('1_1', 1, 5)) t(quadrant, quota, oversample)),
qp AS (SELECT a.id, a.embedding, a.rc || '_' || CAST(a.original_label AS VARCHAR) AS quadrant,
              CASE WHEN a.rc_i + a.original_label = 1 THEN 'pattern' ELSE 'exception' END AS kind, qq.quota, qq.oversample
       FROM (SELECT pool.*, CASE WHEN pool.cluster = pcl.positive_cluster THEN '0' ELSE '1' END AS rc,
                    CASE WHEN pool.cluster = pcl.positive_cluster THEN 0 ELSE 1 END AS rc_i FROM pool, pcl) a
       JOIN qq ON qq.quadrant = a.rc || '_' || CAST(a.original_label AS VARCHAR)),
qx AS (SELECT id, unnest(range(1, len(embedding) + 1)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM qp),
qc AS (SELECT p.quadrant, x.dim, avg(x.v) AS v FROM qp p JOIN qx x ON p.id = x.id GROUP BY ALL),
sel AS ({QUAD_SQL}),
kw AS (SELECT {_any(A.TEST_LEXICON, 'lower(d.text)')} AS k, l.quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
n AS (SELECT count(*) FILTER (k) AS nk, count(*) FILTER (k AND y = 1) AS kp, count(*) FILTER (NOT k) AS nn,
             count(*) FILTER (NOT k AND y = 0) AS nneg FROM kw),
r AS (SELECT round(coalesce(kp / nullif(nk, 0), 0.0), 6) AS pk, round(CASE WHEN nk > 0 THEN 1 - kp / nk ELSE 0.0 END, 6) AS qk,
             round(coalesce(nneg / nullif(nn, 0), 0.0), 6) AS pn, round(CASE WHEN nn > 0 THEN 1 - nneg / nn ELSE 0.0 END, 6) AS qn
      FROM n),
ex AS (SELECT sel.id, sel.order_key, d.text AS t, CASE sel.quadrant {groups} END AS g,
              chr(10) || 'Message: "' || d.text || '"' AS msg, chr(10) || 'Answer: ' || CASE sel.quadrant {answers} END AS ans
       FROM sel JOIN documents d ON d.doc_id = sel.id),
lines AS (SELECT ex.*, CASE g
    WHEN 1 THEN 'cue words present: ' || {hits} || '; follows the pattern (' || {pct('pk')} || ' of messages with cue words are positive).'
    WHEN 2 THEN 'no cue words; follows the pattern (' || {pct('pn')} || ' of messages without cue words are negative).'
    WHEN 3 THEN 'no cue words, yet indicators: ' || {low(_indicators_sql())} || '; an exception (' || {pct('qn')}
                || ' of messages without cue words are positive).'
    ELSE 'cue words present: ' || {hits} || '; an exception (' || {pct('qk')} || ' of messages with cue words are negative); reason: '
         || {low(_reason_sql())} || '.' END AS reasoning,
  CASE g WHEN 1 THEN 'cue words present: ' || {hits} || '; tone: ' || {tone} || '; follows the pattern (' || {pct('pk')}
                     || '), and the context bears it out.'
         WHEN 3 THEN 'no cue words; indicators: ' || {low(_indicators_sql())} || '; an exception (' || {pct('qn')}
                     || '), which context and tone bear out.' END AS lead
  FROM ex, r),
blk AS (SELECT coalesce(chr(10) || chr(10) || '### Worked example' || first(msg || chr(10) || 'Reasoning: ' || lead || ans
                 ORDER BY g, order_key, id) FILTER (lead IS NOT NULL), '') || {sections} AS examples FROM lines)"""
    cues = ", ".join(A.TEST_LEXICON)
    return O.pool_sql(f"""SELECT b.item_id, {RULES_SQL} || chr(10) || 'Cue words: {cues}'
  || chr(10) || 'Most messages with a cue word belong to it (' || {pct('pk')} || '), and most without one do not (' || {pct('pn')}
  || '). There are exceptions both ways: read the whole message.' || blk.examples || {TARGET_SQL.format(text='b.text')} AS prompt
FROM benchmark b, blk, r""", extra)


def quadrant_prompt(spark, d):
    """T8 (cluster path): Q7 examples in four headed sections, each with T3-T6 reasoning and the rates of the
    cue words (G14) in the labelled data, a worked example first. The examples and the rates are one bounded value
    each (scalar subqueries, computed once). Ids are chosen first; the text is joined last."""
    from textlab.functions import lexicon as L
    from textlab.functions import prompts as P
    from textlab.operators.metrics import keyword_priors
    pool = labelled_pool(spark, d)
    picked = quadrant_few_shot(pool, 3, 3, positive_cluster=F.col("positive_cluster"))
    table = A.table(spark, d, "documents")
    docs = table.select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    lab = A.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    rates = keyword_priors(table.join(lab, "doc_id").select(L.has_keyword("text", A.TEST_LEXICON).alias("has_keyword"), "label"))
    rates = rates.select(F.struct("*").alias("r"))
    ex = picked.select("id", "quadrant", "order_key").join(docs, "id").withColumn("r", rates.scalar())
    q, grp, answer = F.col("quadrant"), F.lit(None), F.lit(None)
    for code, g, a in reversed(QUADRANT_GROUPS):
        grp = F.when(q == code, F.lit(g)).otherwise(grp)
        answer = F.when(q == code, F.lit(a)).otherwise(answer)
    ex = ex.select("id", "order_key", "t", "r", grp.alias("grp"), answer.alias("answer"))
    g, r = F.col("grp"), F.col("r")
    one = P.example("order_key", "id", "t", "answer", g, P.quadrant_reasoning("t", g, r, A.TEST_LEXICON),
                    P.quadrant_lead("t", g, r, A.TEST_LEXICON))
    examples = ex.agg(F.array_sort(F.collect_list(one)).alias("examples")).scalar()  # bounded by the quotas
    rules = F.concat(F.lit(P.system_rules(keywords=A.TEST_LEXICON)), P.pattern_note(rates.scalar()))
    b = A.table(spark, d, "benchmark").withColumn("examples", examples)
    return b.select("item_id", P.few_shot_prompt("text", F.col("examples"), rules, P.SECTIONS).alias("prompt"))


register("quadrant_prompt", _quadrant_prompt_sql())(quadrant_prompt)
