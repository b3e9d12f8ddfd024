"""Lexicon column functions.

Matching is *substring* matching on the lower-cased text (not word matching),
as in the reference. Lists are parameters; the defaults below are the
reference's fixed values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- Fixed values (must equal the reference for the same prompts) ----------
KEYWORDS = ["loneliness", "lonely", "social isolation", "solitude", "miserable"]
TONE_MARKERS = ["😔", "😞", "😭", "💔", "sad", "miserable", "stuck", "done"]
TONE_MARKERS_BINARY = ["😔", "😞", "😭", "💔", "sad", "miserable", "stuck", "done", "anxious", "scared"]
CONTEXT_INDICATORS = [
    ("social isolation", ["no friends", "no family", "alone", "isolated", "missing"]),
    ("desire for connection", ["want", "need", "wish", "hope"]),
    ("negative emotions", ["😔", "😞", "😭", "💔", "sad", "depressed"]),
]
EXCEPTION_REASONS = [
    ("explicit negation", ["not lonely", "never lonely", "not miserable"]),
    ("referencing media/art", ["song", "music", "lyrics", "quote"]),
    ("humorous context", ["joke", "funny", "lol", "haha"]),
]
EXCEPTION_DEFAULT = "neutral/positive context"
PARAPHRASES = [
    ("lonely", ["isolated", "alone", "solitary"]),
    ("sad", ["unhappy", "depressed", "miserable"]),
    ("miss", ["long for", "yearn for", "want"]),
    ("friend", ["companion", "buddy", "pal"]),
    ("talk", ["chat", "converse", "speak"]),
    ("weekend", ["weekend", "days off", "free time"]),
    ("home", ["house", "place", "apartment"]),
]
# ---------------------------------------------------------------------------


def _lits(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _low(text, lowered: bool) -> Column:
    return _col(text) if lowered else F.lower(_col(text))


def keyword_hits(text, lexicon: Sequence[str] = KEYWORDS, lowered: bool = False) -> Column:
    """Lexicon entries that are substrings of lower(text), in lexicon order.
    Pass ``lowered=True`` with a column lower-cased once upstream when several
    lexicon functions read the same long text."""
    low = _low(text, lowered)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in lexicon]))


def keyword_hits_joined(text, lexicon: Sequence[str] = KEYWORDS, sep: str = ",",
                        lowered: bool = False) -> Column:
    """T3 as one string (``concat_ws`` skips the misses); fully code-generated."""
    low = _low(text, lowered)
    return F.concat_ws(sep, *[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in lexicon])


def keyword_count(text, lexicon: Sequence[str] = KEYWORDS, lowered: bool = False) -> Column:
    low = _low(text, lowered)
    out = F.lit(0)
    for w in lexicon:
        out = out + F.contains(low, F.lit(w)).cast("int")
    return out


def has_keyword(text, lexicon: Sequence[str] = KEYWORDS, lowered: bool = False) -> Column:
    """Any entry is a substring of lower(text): an OR chain of ``contains``
    (code-generated, short-circuits; no lambda per row)."""
    low = _low(text, lowered)
    out = F.lit(False)
    for w in lexicon:
        out = out | F.contains(low, F.lit(w))
    return out


def tone(text, markers: Sequence[str] = TONE_MARKERS, lowered: bool = False) -> Column:
    """T4: 'negative' if any marker occurs, else 'neutral'."""
    return F.when(has_keyword(text, markers, lowered), F.lit("negative")).otherwise(F.lit("neutral"))


def context_indicators(text, indicators=CONTEXT_INDICATORS, lowered: bool = False) -> Column:
    """T5: names of the indicators present, in order, joined by ', '; 'none' if empty."""
    # concat_ws skips the nulls of the indicators that are absent; each
    # indicator is tested once and the whole expression is code-generated
    joined = F.concat_ws(", ", *[F.when(has_keyword(text, words, lowered), F.lit(name))
                                 for name, words in indicators])
    return F.when(joined == F.lit(""), F.lit("none")).otherwise(joined)


def exception_reason(text, reasons=EXCEPTION_REASONS, default: str = EXCEPTION_DEFAULT,
                     lowered: bool = False) -> Column:
    """First matching reason in order, else the default."""
    out = F.lit(default)
    for name, words in reversed(list(reasons)):
        out = F.when(has_keyword(text, words, lowered), F.lit(name)).otherwise(out)
    return out


def paraphrase_one(text, key, table=PARAPHRASES, salt: str = "para") -> Column:
    """The first table word found in lower(text) is replaced (case-
    sensitively, every occurrence) by one of its alternatives, chosen by
    ``hash(salt, key) mod len(alternatives)``; then stop. A match found only
    in another case ("Lonely") leaves the text unchanged, as in the reference.
    """
    t = _col(text)
    low = F.lower(t)
    h = F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), _col(key).cast("string"))), 1, 8), 16, 10) \
        .cast("bigint")
    out = t
    for word, alts in reversed(table):
        alt = F.element_at(_lits(alts), (h % F.lit(len(alts)) + 1).cast("int"))
        out = F.when(F.contains(low, F.lit(word)), F.replace(t, F.lit(word), alt)).otherwise(out)
    return out


def quadrant_tag(cluster, original_label, positive_cluster=0) -> Column:
    """(cluster relative to the positive cluster, original label) ->
    'pattern' for (0, 1) and (1, 0), 'exception' for (0, 0) and (1, 1)."""
    rel = F.when(_col(cluster) == (positive_cluster if isinstance(positive_cluster, Column)
                                   else F.lit(positive_cluster)), 0).otherwise(1)
    return F.when(rel + _col(original_label) == 1, F.lit("pattern")).otherwise(F.lit("exception"))


def cluster_of(df_columns: Sequence[str]) -> Column:
    """T13 column choice: ``cluster_id``, else ``cluster``, else 0."""
    if "cluster_id" in df_columns:
        return F.col("cluster_id")
    if "cluster" in df_columns:
        return F.col("cluster")
    return F.lit(0)


def original_label_of(df_columns: Sequence[str]) -> Column:
    """``original_label`` when present, else ``label``."""
    return F.col("original_label") if "original_label" in df_columns else F.col("label")
