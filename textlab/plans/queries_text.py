"""Registered queries: reply parsing, lexicon features, paraphrase, prompts,
labelling progress (T1-T12, G5, G14, W3, W4, H14, H15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.functions import lexicon as L
from textlab.functions import prompts as P
from textlab.functions.parse import json_reply, two_line_reply
from textlab.operators import aggregate as G
from textlab.operators.fewshot import augment
from textlab.operators.metrics import keyword_priors
from textlab.operators.sampling import binary_few_shot
from textlab.operators.scoring import generate_pairs, label_with_reply_model
from textlab.operators.windows import batch_examples, cumulative_progress, row_index
from textlab.plans import adapters as A
from textlab.plans import fixture_models as FM
from textlab.plans import oracles as O
from textlab.plans.registry import register

S = O.strip


_TEST_HIT = ("len(list_filter([" + ", ".join(f"'{w}'" for w in A.TEST_LEXICON)
             + "], lambda k: contains(lower(coalesce(text, '')), k))) > 0")

REPLIES_CTE = f"""replies AS (
  SELECT doc_id, text, CASE length(w) % 5
    WHEN 0 THEN 'Reads as: ' || w || chr(10) || lab
    WHEN 1 THEN 'Label ' || lab || ' because ' || w
    WHEN 2 THEN 'Unsure: ' || w
    WHEN 3 THEN ''
    ELSE w || chr(10) || '   ' || lab || '  ' END AS reply
  FROM (SELECT *, coalesce(text, '') AS w, CAST(CAST({_TEST_HIT} AS INTEGER) AS VARCHAR) AS lab
        FROM (SELECT doc_id, text FROM documents
              UNION ALL SELECT 10000000000 + conv_id * 1000 + turn, text FROM conversations)))"""

_LB = "'\\r\\n|[\\n\\x0B\\x0C\\r\\x{85}\\x{2028}\\x{2029}]'"

PARSED_CTE = REPLIES_CTE + f""",
p0 AS (SELECT doc_id, {S("coalesce(reply, '')")} AS r FROM replies),
p1 AS (SELECT doc_id, r, list_filter(list_transform(string_split_regex(r, {_LB}), lambda x: {S('x')}), lambda x: x <> '') AS lines,
              regexp_extract(r, '(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])([01])(?:$|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', 1) AS digit FROM p0),
p2 AS (SELECT doc_id, r, lines, digit, len(lines) AS n,
              CASE WHEN len(lines) > 0 THEN lines[len(lines)] END AS last,
              {S("array_to_string(lines[1:len(lines) - 1], ' ')")} AS earlier FROM p1),
parsed AS (SELECT doc_id,
  CAST(CASE WHEN n = 0 THEN NULL WHEN last IN ('0', '1') THEN last WHEN digit <> '' THEN digit END AS INTEGER) AS label,
  CASE WHEN n = 0 THEN NULL WHEN last IN ('0', '1') THEN earlier
       WHEN digit <> '' THEN CASE WHEN earlier <> '' THEN earlier ELSE {S("replace(r, digit, '')")} END
       END AS explanation FROM p2)"""


@register("parse_two_line_reply", f"WITH {PARSED_CTE}\nSELECT doc_id, label, explanation FROM parsed")
def parse_two_line(spark, d):
    r = A.replies(spark, d)
    return r.select("doc_id", two_line_reply("reply").alias("p")).select("doc_id", "p.label", "p.explanation")


@register("label_with_reply_model", f"WITH {PARSED_CTE}\nSELECT doc_id, label, explanation FROM parsed")
def label_with_reply_model_q(spark, d):
    return label_with_reply_model(A.reply_texts(spark, d), FM.two_line_reply_model).select("doc_id", "label", "explanation")


def _json_replies_sql() -> str:
    sent = f"CASE WHEN {_TEST_HIT} THEN 'positive' ELSE 'negative' END"
    body = f"CAST(json_object('DM', coalesce(text, ''), 'Sentiment', {sent}) AS VARCHAR)"
    short = "CAST(json_object('DM', coalesce(text, '')) AS VARCHAR)"
    return f"""json_replies AS (
  SELECT doc_id AS post_id, CASE length(coalesce(text, '')) % 5
    WHEN 0 THEN {body}
    WHEN 1 THEN '```json' || chr(10) || {body} || chr(10) || '```'
    WHEN 2 THEN chr(10) || '```json' || chr(10) || {body} || chr(10) || '```'
    WHEN 3 THEN {short}
    ELSE left({short}, -1) || ', "Sentiment": ' END AS reply FROM documents),
j0 AS (SELECT post_id, {S(f"regexp_replace(regexp_replace({S('reply')}, '^```(json)?', ''), '```$', '')")} AS body
       FROM json_replies),
jp AS (SELECT post_id, (json_valid(body) AND starts_with(body, '{{')) AS ok, body FROM j0),
jparsed AS (SELECT post_id,
  CASE WHEN ok THEN coalesce(json_extract_string(body, '$.DM'), '') ELSE 'Error: invalid JSON' END AS DM,
  CASE WHEN ok THEN coalesce(json_extract_string(body, '$.Sentiment'), '') ELSE 'Unknown' END AS Sentiment,
  CASE WHEN ok THEN 'ok' ELSE 'error' END AS parse FROM jp)"""


@register("parse_json_reply", f"WITH {_json_replies_sql()}\nSELECT post_id, DM, Sentiment, parse FROM jparsed")
def parse_json(spark, d):
    r = A.json_replies(spark, d)
    return r.select("post_id", json_reply("reply").alias("p")).select(
        "post_id", F.col("p.dm").alias("DM"), F.col("p.sentiment").alias("Sentiment"), F.col("p.status").alias("parse"))


@register("generate_pairs_resume", f"""WITH {_json_replies_sql()}
SELECT post_id, CASE WHEN post_id % 4 = 0 THEN 'done' ELSE DM END AS DM,
       CASE WHEN post_id % 4 = 0 THEN 'done' ELSE Sentiment END AS Sentiment,
       CASE WHEN post_id % 4 = 0 THEN 'ok' ELSE parse END AS parse FROM jparsed""")
def generate_pairs_resume(spark, d):
    """H15 + E2: rows already generated (``done_rows``) are kept, the rest
    are generated and parsed."""
    todo = A.table(spark, d, "documents").select(F.col("doc_id").alias("post_id"), "text")
    done = (todo.where(F.col("post_id") % 4 == 0)
            .select("post_id", F.lit("done").alias("DM"), F.lit("done").alias("Sentiment"),
                    F.lit("ok").alias("parse")))
    out = generate_pairs(todo, done, FM.json_reply_model, "post_id")
    return out.select("post_id", "DM", "Sentiment", "parse")


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(words, x="lower(text)") -> str:
    return f"len(list_filter({_list(words)}, lambda k: contains({x}, k))) > 0"


def _indicators_sql() -> str:
    arr = "list_filter([" + ", ".join(
        f"CASE WHEN {_any(ws)} THEN '{name}' END" for name, ws in L.CONTEXT_INDICATORS) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({arr}) > 0 THEN array_to_string({arr}, ', ') ELSE 'none' END"


def _reason_sql() -> str:
    out = "CASE " + " ".join(f"WHEN {_any(ws)} THEN '{name}'" for name, ws in L.EXCEPTION_REASONS)
    return out + f" ELSE '{L.EXCEPTION_DEFAULT}' END"


@register("keyword_features", f"""SELECT doc_id,
  array_to_string(list_filter({_list(A.TEST_LEXICON)}, lambda k: contains(lower(text), k)), ',') AS hits,
  CAST(len(list_filter({_list(A.TEST_LEXICON)}, lambda k: contains(lower(text), k))) AS INTEGER) AS n_hits,
  CASE WHEN {_any(L.TONE_MARKERS)} THEN 'negative' ELSE 'neutral' END AS tone,
  {_indicators_sql()} AS indicators,
  {_reason_sql()} AS reason
FROM documents""")
def keyword_features(spark, d):
    # lower-case each (long) text once; every lexicon test reads that column
    x = A.table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    return x.select("doc_id", L.keyword_hits_joined("low", A.TEST_LEXICON, ",", lowered=True).alias("hits"),
                    L.keyword_count("low", A.TEST_LEXICON, lowered=True).cast("int").alias("n_hits"),
                    L.tone("low", lowered=True).alias("tone"),
                    L.context_indicators("low", lowered=True).alias("indicators"),
                    L.exception_reason("low", lowered=True).alias("reason"))


@register("keyword_priors", f"""WITH x AS (
  SELECT {_any(A.TEST_LEXICON, 'lower(d.text)')} AS k, l.quality AS y
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT count(*) FILTER (WHERE k) AS n_kw, count(*) FILTER (WHERE k AND y = 1) AS kw_pos,
             count(*) FILTER (WHERE NOT k) AS n_nokw, count(*) FILTER (WHERE NOT k AND y = 0) AS nokw_neg FROM x)
SELECT n_kw, n_nokw,
  round(coalesce(kw_pos / nullif(n_kw, 0), 0.0), 6) AS p_pos_given_kw,
  round(CASE WHEN n_kw > 0 THEN 1 - kw_pos / n_kw ELSE 0.0 END, 6) AS p_neg_given_kw,
  round(coalesce(nokw_neg / nullif(n_nokw, 0), 0.0), 6) AS p_neg_given_nokw,
  round(CASE WHEN n_nokw > 0 THEN 1 - nokw_neg / n_nokw ELSE 0.0 END, 6) AS p_pos_given_nokw
FROM c""")
def keyword_priors_q(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "text")
    lab = A.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    x = docs.join(lab, "doc_id").select(L.has_keyword("text", A.TEST_LEXICON).alias("has_keyword"), "label")
    return keyword_priors(x)


def _paraphrase_sql(text="text", key="CAST(doc_id AS VARCHAR)") -> str:
    h = f"CAST(('0x' || substr(md5('para:' || {key}), 1, 8)) AS BIGINT)"
    out = text
    for word, alts in reversed(L.PARAPHRASES):
        out = (f"CASE WHEN contains(lower({text}), '{word}') THEN "
               f"replace({text}, '{word}', {_list(alts)}[{h} % {len(alts)} + 1]) ELSE {out} END")
    return out


@register("paraphrase", f"SELECT doc_id, {_paraphrase_sql()} AS text FROM documents")
def paraphrase(spark, d):
    x = A.table(spark, d, "documents")
    return x.select("doc_id", L.paraphrase_one("text", "doc_id").alias("text"))


@register("augment_selected", f"""WITH v AS (
  SELECT doc_id, 0 AS variant, text FROM documents
  UNION ALL
  SELECT doc_id, 1, {_paraphrase_sql('text', "CAST(doc_id AS VARCHAR) || ':1'")} FROM documents)
SELECT doc_id, variant, md5(text) AS text_md5 FROM v WHERE variant = 0 OR length(text) > 10""")
def augment_selected(spark, d):
    x = A.table(spark, d, "documents").select("doc_id", "text")
    v = augment(x, 2, "text", "doc_id", min_chars=10)
    return v.select("doc_id", F.col("variant").cast("int").alias("variant"), F.md5("text").alias("text_md5"))


_PREFIX = "Classify the message below.\nMessage: "
_SUFFIX = "\nAnswer with 1 or 0."


@register("render_prompt", f"""SELECT item_id, '{_PREFIX.replace(chr(10), "' || chr(10) || '")}' || coalesce(text, '')
  || '{_SUFFIX.replace(chr(10), "' || chr(10) || '")}' AS prompt FROM benchmark""")
def render_prompt(spark, d):
    b = A.table(spark, d, "benchmark")
    return b.select("item_id", P.render_prompt("text", _PREFIX, _SUFFIX).alias("prompt"))


def _sql_lit(s: str) -> str:
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


@register("fallback_prompt", f"""SELECT item_id, {_sql_lit(
    "Decide whether a message belongs to the positive class. Answer 1 or 0. Cue words: "
    + ", ".join(L.KEYWORDS) + ".")} || chr(10) || chr(10) || '### Target' || chr(10) || 'Message: \"'
    || coalesce(text, '') || '\"' || chr(10) || 'Answer:' AS prompt FROM benchmark""")
def fallback_prompt(spark, d):
    b = A.table(spark, d, "benchmark")
    return b.select("item_id", P.fallback_prompt("text").alias("prompt"))


# The prompts' fixed texts, spelled out for SQL.
RULES_SQL = ("'Decide whether a message belongs to the positive class.' || chr(10) || "
             "'Answer with a single digit: 1 for yes, 0 for no.' || chr(10)")
TARGET_SQL = ("chr(10) || chr(10) || '### Target' || chr(10) || 'Message: \"' || coalesce({text}, '') || '\"' || chr(10) "
              "|| 'Answer:'")


def hits_sql(words, x: str = "lower(text)") -> str:
    return f"array_to_string(list_filter({_list(words)}, lambda k: contains({x}, k)), ', ')"


@register("few_shot_prompt", f"""WITH ex AS (
  SELECT d.doc_id, d.text, l.quality, {O.horder('d.doc_id', 42, 'shuffle')} AS order_key,
         row_number() OVER (PARTITION BY l.quality ORDER BY {O.horder('d.doc_id', 42, 'fewshot')}, d.doc_id) AS rn
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
few AS (SELECT *, chr(10) || 'Message: "' || text || '"' AS msg, chr(10) || 'Answer: ' || CAST(quality AS VARCHAR) AS ans
        FROM ex WHERE rn <= 2),
blk AS (SELECT string_agg(msg || ans, '' ORDER BY order_key) AS examples,
               coalesce(chr(10) || chr(10) || '### Worked example' || first(msg || chr(10)
                 || 'Reasoning: cue words present: ' || coalesce(nullif({hits_sql(A.TEST_LEXICON)}, ''), 'none')
                 || '; tone: ' || CASE WHEN {_any(L.TONE_MARKERS_BINARY)} THEN 'negative' ELSE 'neutral' END
                 || '; indicators: ' || {_indicators_sql()} || '.' || ans ORDER BY order_key) FILTER (quality = 1), '') AS lead
        FROM few)
SELECT b.item_id, {RULES_SQL} || blk.lead || chr(10) || chr(10) || '### Examples' || blk.examples
       || {TARGET_SQL.format(text='b.text')} AS prompt FROM benchmark b, blk""")
def few_shot_prompt(spark, d):
    """T8 (binary path): rules, a worked example with its reasoning, all examples in order, the target. The
    examples are one bounded value, a scalar subquery computed once; ids are joined first, the text last."""
    docs = A.table(spark, d, "documents").select("doc_id", "text")
    lab = A.table(spark, d, "labels").select("doc_id", "quality")
    ex = binary_few_shot(docs.join(lab, "doc_id"), 2, "doc_id", "quality")
    one = P.example("order_key", "doc_id", "text", "quality", lead=P.binary_lead("text", "quality", A.TEST_LEXICON))
    examples = ex.agg(F.array_sort(F.collect_list(one)).alias("examples")).scalar()
    b = A.table(spark, d, "benchmark").withColumn("examples", examples)
    return b.select("item_id", P.few_shot_prompt("text", F.col("examples"), F.lit(P.system_rules(with_keywords=False))).alias("prompt"))


@register("progress_summary", f"""WITH {PARSED_CTE},
c AS (SELECT count(*) AS total, count(*) FILTER (WHERE label = 1) AS positives,
             count(*) FILTER (WHERE label = 0) AS negatives, count(*) FILTER (WHERE label IS NULL) AS nulls FROM parsed)
SELECT total, positives, negatives, nulls,
  round(coalesce(100.0 * positives / nullif(total, 0), 0.0), 6) AS pct_positives,
  round(coalesce(100.0 * negatives / nullif(total, 0), 0.0), 6) AS pct_negatives,
  round(coalesce(100.0 * nulls / nullif(total, 0), 0.0), 6) AS pct_nulls FROM c""")
def progress_summary(spark, d):
    return G.progress_summary(parse_two_line(spark, d), "label")


@register("batch_examples", f"""WITH {PARSED_CTE},
ix AS (SELECT doc_id, label, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM parsed),
b AS (SELECT *, CAST(floor(idx / 100) AS BIGINT) AS batch FROM ix
      WHERE floor(idx / 100) < floor((SELECT count(*) FROM ix) / 100) AND label IS NOT NULL),
r AS (SELECT batch, label, doc_id, CAST(row_number() OVER (PARTITION BY batch, label ORDER BY idx) AS INTEGER) AS pick FROM b)
SELECT * FROM r WHERE pick <= 3""")
def batch_examples_q(spark, d):
    p = row_index(parse_two_line(spark, d), ["doc_id"], "idx")
    out = batch_examples(p, "idx", "label", 100, 3)
    return out.select("batch", "label", "doc_id", F.col("pick").cast("int").alias("pick"))


@register("cumulative_progress", f"""WITH {PARSED_CTE},
ix AS (SELECT doc_id, label, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM parsed),
per AS (SELECT CAST(floor(idx / 100) AS BIGINT) AS batch, count(*) AS rows,
  count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives,
  count(*) FILTER (WHERE label IS NULL) AS nulls FROM ix GROUP BY 1)
SELECT batch,
  CAST(sum(rows) OVER (ORDER BY batch) AS BIGINT) AS cum_rows,
  CAST(sum(positives) OVER (ORDER BY batch) AS BIGINT) AS cum_positives,
  CAST(sum(negatives) OVER (ORDER BY batch) AS BIGINT) AS cum_negatives,
  CAST(sum(nulls) OVER (ORDER BY batch) AS BIGINT) AS cum_nulls FROM per""")
def cumulative_progress_q(spark, d):
    p = row_index(parse_two_line(spark, d), ["doc_id"], "idx")
    return cumulative_progress(p, "idx", "label", 100)
