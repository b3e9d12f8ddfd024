"""Secret scans: fixed patterns, plus character Markov models compared by likelihood ratio (native).

Patterns (``assign``, ``access``, ``hex``) give the base spans. Two first-order character models are
then trained from labelled samples of the corpus itself: values that the patterns found are the
*random* class, plain identifiers of documents are the *ordinary* class. A token of 20 or more
characters whose log-likelihood ratio (random over ordinary, in nats) reaches ``min_ratio`` is added
as a ``markov`` span unless it overlaps a base span. Base spans are never changed.

The models are fitted on bounded samples (``sample_docs`` documents, ``sample_tokens`` tokens a
class, in hash order); every document's whole text is scanned. Only column functions run; there is no shuffle of
texts. Positions are code points, end exclusive.

Defined results: null text counts as empty (no spans); repeated rows each get their result; spans that begin at one place
are listed by kind; texts of any length are scanned whole (the work grows with the square of the matches in one text); an empty
table gives an empty result and untrained (uniform) models. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import double_array, hash_sample
from textlab.session import stage

# The three base patterns, the least length of what they must hold, and their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run is taken whole, so shorter runs can be left out in the pattern
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_]{5,}"
_K = len(ALPHABET) + 1
EMPTY = "array<struct<start:int,rank:int,end:int,value:string>>"


def spans(text: Column, pattern: str, rank: int, group: int = 0) -> Column:
    """All leftmost non-overlapping matches with their places: start, rank, end, value.

    Spark returns matches without places; the pieces between them (``split``) and the matches' own
    lengths give every place by a running sum. Texts without a match pay for one search only.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    steps = F.zip_with(F.arrays_zip(whole.alias("w"), value.alias("v")), gaps,
                       lambda m, g: F.struct(g.alias("gap"), F.length(m["w"]).alias("len"), m["v"].alias("value")))
    steps = F.filter(steps, lambda s: s["len"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(EMPTY).alias("out"))

    def put(acc, s):
        a = acc["at"] + s["gap"]
        one = F.struct(a.alias("start"), F.lit(rank).alias("rank"), (a + s["len"]).alias("end"),
                       s["value"].alias("value"))
        return F.struct((a + s["len"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    found = F.aggregate(steps, start, put, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(EMPTY))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns by start, then kind; failing matches are dropped."""
    assign = F.filter(spans(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    access = F.filter(spans(text, ACCESS, 1), lambda s: F.length(s["value"]) >= ACCESS_LEAST)
    return F.array_sort(F.concat(assign, access, spans(text, HEX, 2)))


def pairs(token: Column) -> Column:
    """The token's character pairs as one number each."""
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""),
                        lambda c: F.call_function("locate", c, F.lit(ALPHABET)))
    return F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))),
                      F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))),
                      lambda a, b: a * _K + b)


def labelled_tokens(docs: DataFrame, id_col: str, text_col: str, sample_docs: int,
                    sample_tokens: int) -> DataFrame:
    """(random, token): values the patterns found, and identifiers that several clean documents use."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    some = hash_sample(docs.select(F.col(id_col).alias("id"), body.alias("text")), [F.col("id")], sample_docs)
    some = stage(some.select("text", base_spans(F.col("text")).alias("found")), "secret-sample")
    yes = some.select(F.lit(True).alias("random"), F.explode("found.value").alias("token"))
    no = (some.filter(F.size("found") == 0)
          .select(F.lit(False).alias("random"),
                  F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)))).alias("token")))
    # an identifier is a name that several texts use; a random string that no pattern found is in one
    no = no.groupBy("random", "token").count().filter("count > 1").select("random", "token")
    return yes.orderBy(F.xxhash64("token"), "token").limit(sample_tokens).unionByName(no.orderBy(F.xxhash64("token")).limit(sample_tokens))


def log_ratios(tokens: DataFrame, backoff: float = 8.0) -> list[float]:
    """log P(next | this, random) - log P(next | this, ordinary), by pair number.

    A pair's probability backs off to the next character's own frequency (add-one smoothed) with
    the weight of ``backoff`` observations, so pairs unseen in both samples still tell an unusual
    character from a usual one. Counting runs in Spark; the driver gets one row of ``_K * _K``
    numbers.
    """
    counts = (tokens.select("random", F.explode(pairs(F.col("token"))).alias("pair"))
              .groupBy("pair").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o")))
    every = tokens.sparkSession.range(_K * _K).select(F.col("id").alias("pair"))
    full = (every.join(counts, "pair", "left").na.fill(0, ["r", "o"])
            .withColumns({"a": F.floor(F.col("pair") / _K), "b": F.col("pair") % _K}))
    rows = full.groupBy("a").agg(F.sum("r").alias("ra"), F.sum("o").alias("oa"))
    cols = full.groupBy("b").agg(F.sum("r").alias("rb"), F.sum("o").alias("ob"))
    sums = full.agg(F.sum("r"), F.sum("o")).first()

    def chance(n, a, b, total):
        alone = (F.col(b) + 1) / float(total + _K)
        return F.ln((F.col(n) + backoff * alone) / (F.col(a) + backoff))

    scored = full.join(rows, "a").join(cols, "b").select(
        "pair", (chance("r", "ra", "rb", sums[0]) - chance("o", "oa", "ob", sums[1])).alias("x"))
    best = scored.agg(F.sort_array(F.collect_list(F.struct("pair", "x"))).alias("m")).first()["m"]
    return [round(r["x"], 4) for r in best]


def log_ratio(token: Column, model: Column) -> Column:
    """The token's log-likelihood ratio, random over ordinary, in nats."""
    return F.aggregate(F.transform(pairs(token), lambda p: F.get(model, p)), F.lit(0.0), lambda a, x: a + x)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 4000,
         sample_tokens: int = 20_000, min_ratio: float = 8.0) -> DataFrame:
    """One row per input row: id, base (spans), added (markov spans)."""
    ratios = log_ratios(stage(labelled_tokens(docs, id_col, text_col, sample_docs, sample_tokens), "secret-tokens"))
    model = double_array(ratios)
    body = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("id"), base_spans(body).alias("base"),
                        spans(body, TOKEN, 3).alias("long"))
    free = F.filter("long", lambda s: ~F.exists(
        F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    added = F.filter(free, lambda s: log_ratio(s["value"], model) >= min_ratio)
    return found.select("id", "base", F.when(F.size("long") > 0, added).otherwise(F.col("long")).alias("added"))


def joined(found: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    kinds = F.array(F.lit("assign"), F.lit("access"), F.lit("hex"), F.lit("markov"))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
