"""Text column expressions (JVM-side, whole-stage-codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Python's str.strip() removes Unicode whitespace; Spark's trim removes only
# spaces. (?U) makes \s the Unicode White_Space class.
_STRIP_RE = r"(?U)\A\s+|\s+\z"


def ustrip(c) -> Column:
    """Strip leading/trailing Unicode whitespace (like Python ``str.strip()``)."""
    return F.regexp_replace(_col(c), _STRIP_RE, "")


def null_to_empty(c) -> Column:
    """Null -> '' and everything else -> its string form."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def compose_sentence(title, body, sep: str = ". ") -> Column:
    """``strip(title or '') + sep + strip(body or '')``.

    ``concat`` (not ``concat_ws``) so a missing part still leaves the separator,
    as in the reference (a null body gives ``"title. "``).
    """
    return F.concat(ustrip(F.coalesce(_col(title), F.lit(""))), F.lit(sep),
                    ustrip(F.coalesce(_col(body), F.lit(""))))


def compose_post(title, body, sep: str = "\n") -> Column:
    """``title + sep + body``; callers drop rows with a null part first."""
    return F.concat(_col(title), F.lit(sep), _col(body))


def format_submission(title, content, default_title: str = "No title",
                      default_content: str = "No content") -> Column:
    """``"Title: ..\\nContent: .."`` with defaults for a missing value."""
    return F.concat(F.lit("Title: "), F.coalesce(_col(title), F.lit(default_title)),
                    F.lit("\nContent: "), F.coalesce(_col(content), F.lit(default_content)))


def submission_of(df, title: str = "title", content: str = "content", default_title: str = "No title",
                  default_content: str = "No content") -> Column:
    """P3 for a table: a title or content column that ``df`` does not have counts as missing in every row."""
    have = set(df.columns)
    part = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    return format_submission(part(title), part(content), default_title, default_content)


def is_blank(c) -> Column:
    """True when null or only whitespace (P5 keeps the complement)."""
    return _col(c).isNull() | (ustrip(c) == F.lit(""))


def text_length(c) -> Column:
    """Character count."""
    return F.length(_col(c))


def preview(c, n: int = 100, ellipsis: str = "...") -> Column:
    """First ``n`` characters, plus ``...`` when the text is longer."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ellipsis))).otherwise(c)


def composite_group(*cols, sep: str = " | ") -> Column:
    """``a | b`` grouping label."""
    return F.concat_ws(sep, *[_col(c).cast("string") for c in cols])


def label_from_source(domain, positive: str = "positive") -> Column:
    """1 for the positive source, 0 otherwise."""
    return F.when(_col(domain) == F.lit(positive), F.lit(1)).otherwise(F.lit(0)).cast("int")


def cast_label(c) -> Column:
    """text/number label -> int by truncation; unparsable -> null.

    ``try_cast`` to double first so '1.0' works under ANSI mode, then the
    double -> int cast truncates (1.9 -> 1), as pandas ``astype(int)`` does.
    """
    return _col(c).cast("string").try_cast("double").try_cast("int")


def word_count(c) -> Column:
    """Whitespace-token count (0 for blank text)."""
    s = ustrip(c)
    return F.when(s == F.lit(""), F.lit(0)).otherwise(F.size(F.split(s, r"(?U)\s+")))


def prompt_budget(c, limit: int):
    """(n_tokens, over_limit, cut_text) on whitespace tokens."""
    s = ustrip(c)
    toks = F.split(s, r"(?U)\s+")
    n = F.when(s == F.lit(""), F.lit(0)).otherwise(F.size(toks))
    cut = F.when(n >= F.lit(limit), F.array_join(F.slice(toks, 1, limit), " ")).otherwise(s)
    return n, (n >= F.lit(limit)), cut


# Pandas' default CSV null markers (read_csv na_values); fixed values.
PANDAS_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


def null_tokens_to_null(c) -> Column:
    """Map pandas' CSV null markers to SQL null."""
    c = _col(c)
    return F.when(c.isin(PANDAS_NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)
