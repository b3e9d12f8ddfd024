"""Registered queries: projections, cleaning, dedup, unions, counts, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.functions import text as T
from textlab.functions.emoji import demojize
from textlab.operators import aggregate as G
from textlab.operators.dedup import dedup_first, union_sources
from textlab.operators.joins import pending_rows, resume_merge
from textlab.operators.windows import head, row_index
from textlab.plans import adapters as A
from textlab.plans import oracles as O
from textlab.plans.registry import register

S = O.strip


@register("compose_sentence", f"""WITH {O.POSTS_CTE.strip()}
SELECT post_id, concat({S("coalesce(title, '')")}, '. ', {S("coalesce(body, '')")}) AS sentence,
       domain FROM posts""")
def compose_sentence(spark, d):
    p = A.posts(spark, d)
    return p.select("post_id", T.compose_sentence("title", "body").alias("sentence"), "domain")


@register("compose_post_dedup", f"""WITH {O.POSTS_CTE.strip()},
k AS (SELECT post_id, retrieved_on, title || chr(10) || body AS post,
             row_number() OVER (PARTITION BY retrieved_on ORDER BY post_id) AS rn
      FROM posts WHERE title IS NOT NULL AND body IS NOT NULL)
SELECT post_id, retrieved_on, post FROM k WHERE rn = 1""")
def compose_post_dedup(spark, d):
    p = (A.posts(spark, d).dropna(subset=["title", "body"])
         .select("post_id", "retrieved_on", T.compose_post("title", "body").alias("post")))
    return dedup_first(p, "retrieved_on", "post_id", nulls="collapse")


@register("format_submission", f"""WITH {O.POSTS_CTE.strip()}
SELECT post_id, 'Title: ' || coalesce(title, 'No title') || chr(10) || 'Content: ' ||
       coalesce(body, 'No content') AS submission FROM posts""")
def format_submission(spark, d):
    p = A.posts(spark, d)
    return p.select("post_id", T.format_submission("title", "body").alias("submission"))


@register("drop_blank_messages", f"""WITH {O.MESSAGES_CTE.strip()}
SELECT message_id, Message AS sentence FROM messages
WHERE Message IS NOT NULL AND {S("Message")} <> ''""")
def drop_blank_messages(spark, d):
    m = A.messages(spark, d)
    return m.where(~T.is_blank("Message")).select("message_id", F.col("Message").alias("sentence"))


@register("drop_short_posts", f"""WITH {O.POSTS_CTE.strip()},
s AS (SELECT post_id, domain, concat({S("coalesce(title, '')")}, '. ', {S("coalesce(body, '')")}) AS sentence
      FROM posts)
SELECT post_id, CAST(length(sentence) AS INTEGER) AS n_chars,
       CAST(CASE WHEN domain = 'positive' THEN 1 ELSE 0 END AS INTEGER) AS label
FROM s WHERE length({S("sentence")}) > 5""")
def drop_short_posts(spark, d):
    s = A.posts(spark, d).select("post_id", "domain",
                                 T.compose_sentence("title", "body").alias("sentence"))
    return (s.where(F.length(T.ustrip("sentence")) > 5)
            .select("post_id", T.text_length("sentence").alias("n_chars"),
                    T.label_from_source("domain").alias("label")))


@register("preview_text", f"""SELECT doc_id,
  CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview,
  lang || ' | ' || {O.DOMAIN_SQL} AS grp FROM documents""")
def preview_text(spark, d):
    x = A.documents(spark, d)
    return x.select("doc_id", T.preview("text", 100).alias("preview"),
                    T.composite_group("lang", "domain").alias("grp"))


@register("prompt_budget", f"""WITH s AS (SELECT doc_id, {S("text")} AS t FROM documents),
k AS (SELECT doc_id, t, string_split_regex(t, '\\s+') AS toks FROM s)
SELECT doc_id,
  CAST(CASE WHEN t = '' THEN 0 ELSE len(toks) END AS INTEGER) AS n_tokens,
  (CASE WHEN t = '' THEN 0 ELSE len(toks) END) >= 128 AS over_limit,
  CAST(length(CASE WHEN (CASE WHEN t = '' THEN 0 ELSE len(toks) END) >= 128
       THEN array_to_string(list_slice(toks, 1, 128), ' ') ELSE t END) AS INTEGER) AS cut_chars
FROM k""")
def prompt_budget(spark, d):
    x = A.table(spark, d, "documents")
    n, over, cut = T.prompt_budget("text", 128)
    return x.select("doc_id", n.cast("int").alias("n_tokens"), over.alias("over_limit"),
                    F.length(cut).cast("int").alias("cut_chars"))


_EMOJI_NAMES = [":grinning_face:", ":red_heart:", ":face_with_tears_of_joy:", ":thumbs_up:", ":fire:"]


def _emoji_sql() -> str:
    e = "text || CASE doc_id % 6 " + " ".join(
        f"WHEN {i} THEN '{em}'" for i, em in enumerate(A.TEST_EMOJI, start=1)) + " ELSE '' END"
    out = f"({e})"
    for em, name in zip(A.TEST_EMOJI, _EMOJI_NAMES):
        out = f"replace({out}, '{em}', '{name}')"
    return f"SELECT doc_id, {out} AS text FROM documents"


@register("emoji_to_text", _emoji_sql())
def emoji_to_text(spark, d):
    return A.emoji_text(spark, d).select("doc_id", demojize("text").alias("text"))


@register("cast_label_variants", """WITH r AS (
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN CAST(quality AS VARCHAR) || '.0'
                                 WHEN 1 THEN CAST(quality AS VARCHAR)
                                 WHEN 2 THEN CAST(quality AS VARCHAR) || '.9'
                                 WHEN 3 THEN '-' || CAST(quality AS VARCHAR) || '.5'
                                 WHEN 4 THEN '-1.9'
                                 ELSE 'x' END AS raw FROM labels)
SELECT doc_id, raw, CAST(trunc(TRY_CAST(raw AS DOUBLE)) AS INTEGER) AS label FROM r""")
def cast_label_variants(spark, d):
    lab = A.table(spark, d, "labels")
    q = F.col("quality").cast("string")
    m = F.col("doc_id") % 6
    raw = (F.when(m == 0, F.concat(q, F.lit(".0"))).when(m == 1, q)
           .when(m == 2, F.concat(q, F.lit(".9"))).when(m == 3, F.concat(F.lit("-"), q, F.lit(".5")))
           .when(m == 4, F.lit("-1.9")).otherwise(F.lit("x")))
    return lab.select("doc_id", raw.alias("raw")).withColumn("label", T.cast_label("raw"))


@register("null_to_empty", f"""WITH {O.MESSAGES_CTE.strip()}
SELECT message_id, coalesce(Message, '') AS text, coalesce(CAST(turn AS VARCHAR), '') AS turn FROM messages""")
def null_to_empty_q(spark, d):
    """Nulls become empty text, everything else its text form."""
    return A.messages(spark, d).select("message_id", T.null_to_empty("Message").alias("text"), T.null_to_empty("turn").alias("turn"))


@register("value_counts_domain", f"""SELECT {O.DOMAIN_SQL} AS domain, count(*) AS n
FROM documents GROUP BY 1""")
def value_counts_domain(spark, d):
    return G.value_counts(A.documents(spark, d), "domain")


@register("value_shares_lang", """SELECT lang, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY lang""")
def value_shares_lang(spark, d):
    return G.value_shares(A.table(spark, d, "documents"), "lang")


@register("load_report", f"""WITH x AS (
  SELECT d.source, d.text, CAST(trunc(TRY_CAST(CAST(l.quality AS VARCHAR) AS DOUBLE)) AS INTEGER) AS lab
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
y AS (SELECT *, (text IS NOT NULL AND {S("text")} <> '' AND lab IS NOT NULL) AS kept FROM x)
SELECT source, count(*) AS loaded, count(*) FILTER (WHERE kept) AS kept,
       count(*) FILTER (WHERE NOT kept) AS removed,
       count(*) FILTER (WHERE kept AND lab = 1) AS positives,
       count(*) FILTER (WHERE kept AND lab = 0) AS negatives
FROM y GROUP BY ROLLUP (source)""")
def load_report(spark, d):
    docs = A.table(spark, d, "documents")
    lab = A.table(spark, d, "labels").select("doc_id", "quality")
    return G.load_report(docs.join(lab, "doc_id", "left"), "source", "text", "quality")


@register("union_sources", f"""WITH {O.POSTS_CTE.strip()}, {O.MESSAGES_CTE.strip()}
SELECT post_id AS id, concat({S("coalesce(title, '')")}, '. ', {S("coalesce(body, '')")}) AS sentence,
       domain, title, NULL::BIGINT AS conv_id FROM posts
UNION ALL SELECT message_id, Message, 'messages', NULL, conv_id FROM messages
UNION ALL SELECT item_id, text, 'benchmark', NULL, NULL FROM benchmark""")
def union_sources_q(spark, d):
    p = A.posts(spark, d).select(F.col("post_id").alias("id"),
                                 T.compose_sentence("title", "body").alias("sentence"), "domain", "title")
    m = A.messages(spark, d).select(F.col("message_id").alias("id"), F.col("Message").alias("sentence"),
                                    F.lit("messages").alias("domain"), "conv_id")
    b = A.table(spark, d, "benchmark").select(F.col("item_id").alias("id"),
                                              F.col("text").alias("sentence"),
                                              F.lit("benchmark").alias("domain"))
    return union_sources([p, m, b])


@register("resume_pending", f"""WITH {O.POSTS_CTE.strip()},
done AS (SELECT post_id FROM posts WHERE post_id % 4 = 0)
SELECT post_id, 'done' AS status FROM done
UNION ALL SELECT post_id, 'new' FROM posts WHERE post_id NOT IN (SELECT post_id FROM done)""")
def resume_pending(spark, d):
    posts = A.posts(spark, d)
    done = posts.where(F.col("post_id") % 4 == 0).select("post_id", F.lit("done").alias("status"))
    new = pending_rows(posts, done, "post_id").select("post_id", F.lit("new").alias("status"))
    return resume_merge(done, new)


@register("row_index", """SELECT doc_id, source,
  CAST(row_number() OVER (ORDER BY source, doc_id) - 1 AS BIGINT) AS idx FROM documents""")
def row_index_q(spark, d):
    x = A.table(spark, d, "documents").select("doc_id", "source")
    return row_index(x, ["source", "doc_id"])


@register("head_longest", """SELECT doc_id, n_chars FROM documents
ORDER BY n_chars DESC, doc_id LIMIT 10""")
def head_longest(spark, d):
    x = A.table(spark, d, "documents").select("doc_id", "n_chars")
    return head(x, 10, [F.desc("n_chars"), F.asc("doc_id")])
