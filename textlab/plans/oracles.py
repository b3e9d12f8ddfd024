"""Independent DuckDB SQL for the registered queries.

Written from the operator definitions, not generated from the Spark plans.
Adapters are repeated here as SQL expressions over the pre-registered views.
"""

from __future__ import annotations

DOMAIN_SQL = ("CASE CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 3 "
              "WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral_a' ELSE 'neutral_b' END")

STRIP_RE = "'^\\s+|\\s+$'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {STRIP_RE}, '', 'g')"


def hfrac(salt_sql: str, key_sql: str) -> str:
    return (f"(CAST(('0x' || substr(md5({salt_sql} || ':' || CAST({key_sql} AS VARCHAR)), 1, 8)) "
            f"AS BIGINT) / 4294967296.0)")


def horder(key_sql: str, seed: int = 42, salt: str = "") -> str:
    return f"md5('{seed}' || ':' || '{salt}' || ':' || CAST({key_sql} AS VARCHAR))"


VECTORS_CTE = f"""
v AS (
  SELECT e.vec_id AS id, d.text, e.embedding, {DOMAIN_SQL} AS domain,
         CAST(e.label < 5 AS INTEGER) AS original_label
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id)"""

POSTS_CTE = f"""
posts AS (
  SELECT doc_id AS post_id,
         CASE WHEN doc_id % 17 = 0 THEN NULL ELSE split_part(text, chr(10), 1) END AS title,
         CASE WHEN doc_id % 13 = 0 THEN NULL
              WHEN doc_id % 19 = 0 THEN '  ' || chr(10) || ' '
              WHEN strpos(text, chr(10)) = 0 THEN ''
              ELSE substr(text, strpos(text, chr(10)) + 1) END AS body,
         CASE WHEN doc_id % 23 = 0 THEN NULL ELSE md5(text) END AS retrieved_on,
         {DOMAIN_SQL} AS domain, source
  FROM documents)"""

MESSAGES_CTE = """
messages AS (
  SELECT conv_id * 1000 + turn AS message_id, conv_id, turn, role,
         CASE WHEN (conv_id * 1000 + turn) % 11 = 0 THEN NULL ELSE text END AS Message
  FROM conversations)"""

PREDICTIONS_CTE = f"""
models AS (SELECT * FROM (VALUES ('m1', 0.1), ('m2', 0.2), ('m3', 0.3), ('m4', 0.4), ('m5', 0.5)) t(model, w)),
predictions AS (
  SELECT model, doc_id, label, prob, CAST(prob > 0.5 AS INTEGER) AS prediction FROM (
    SELECT m.model, l.doc_id, l.quality AS label,
           (1 - CAST(m.w AS DOUBLE)) * {hfrac('m.model', 'l.doc_id')} + CAST(m.w AS DOUBLE) * l.quality AS prob
    FROM labels l, models m))"""

TRIAL_LOG_CTE = """
trial_log AS (
  SELECT user_id AS trial,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS step,
         CASE WHEN event_type = 'error' THEN NULL ELSE value / 1000.0 END AS eval_f1
  FROM events)"""


def kmeans_sql(seed_sql: str, select_sql: str, extra_ctes: str = "") -> str:
    """Seeded 2-means over (id, dim, value), as a recursive CTE of centroids that ends when they
    repeat (to 1e-12, the noise of a parallel average); an empty cluster keeps its centroid;
    ties -> lower id."""
    def assign(cents: str) -> str:
        return (f"SELECT id, cluster FROM (SELECT x.id, c.cluster, sum((x.val - c.val) * (x.val - c.val)) AS dist "
                f"FROM x JOIN {cents} c ON x.dim = c.dim GROUP BY x.id, c.cluster) "
                f"QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, cluster) = 1")

    parts = [VECTORS_CTE.strip(),
             f"vs AS (SELECT *, CAST({seed_sql} AS INTEGER) AS seed FROM v)",
             "x AS MATERIALIZED (SELECT id, unnest(range(1, len(embedding) + 1)) AS dim, "
             "CAST(unnest(embedding) AS DOUBLE) AS val FROM vs)",
             "km AS (SELECT 0 AS step, vs.seed AS cluster, x.dim, avg(x.val) AS val "
             "FROM x JOIN vs USING (id) GROUP BY ALL UNION ALL "
             f"(WITH a AS ({assign('km')}), "
             "n AS (SELECT a.cluster, x.dim, avg(x.val) AS val FROM x JOIN a USING (id) GROUP BY ALL) "
             "SELECT km.step + 1, km.cluster, km.dim, coalesce(n.val, km.val) "
             "FROM km LEFT JOIN n ON n.cluster = km.cluster AND n.dim = km.dim "
             "WHERE EXISTS (SELECT 1 FROM km k JOIN n ON n.cluster = k.cluster AND n.dim = k.dim "
             "WHERE abs(n.val - k.val) > 1e-12)))",
             "cents AS (SELECT * FROM km WHERE step = (SELECT max(step) FROM km))",
             f"final AS ({assign('cents')})",
             "assigned AS (SELECT vs.*, CAST(final.cluster AS INTEGER) AS cluster "
             "FROM vs JOIN final USING (id))"]
    if extra_ctes.strip():
        parts.append(extra_ctes.strip().strip(","))
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select_sql


def flagship_sql() -> str:
    return kmeans_sql(
        "CASE WHEN domain = 'positive' THEN 0 ELSE 1 END",
        "SELECT cluster, "
        "CAST(count(*) FILTER (WHERE domain = 'positive') AS BIGINT) AS positive, "
        "CAST(count(*) FILTER (WHERE domain = 'neutral_a') AS BIGINT) AS neutral_a, "
        "CAST(count(*) FILTER (WHERE domain = 'neutral_b') AS BIGINT) AS neutral_b "
        "FROM assigned GROUP BY cluster")


def pool_sql(select_sql: str, extra_ctes: str = "") -> str:
    """The labelled pool (cluster from seeded 2-means on original_label, H3/H4 label)."""
    ctes = ("pc AS (SELECT CASE WHEN count(*) FILTER (WHERE cluster = 0 AND original_label = 1) > "
            "count(*) FILTER (WHERE cluster = 1 AND original_label = 1) THEN 0 ELSE 1 END AS positive_cluster "
            "FROM assigned),\n"
            "pool AS (SELECT a.id, a.text, a.embedding, a.domain, a.original_label, a.cluster, "
            "CAST(a.cluster = pc.positive_cluster AS INTEGER) AS label FROM assigned a, pc)")
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip().strip(",")
    return kmeans_sql("CASE WHEN original_label = 1 THEN 0 ELSE 1 END", select_sql, ctes)
