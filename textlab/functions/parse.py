"""Reply parsers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlab.functions.text import ustrip


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def two_line_reply(reply) -> Column:
    """T1 as one struct (label, explanation): every step is bound once, so a long reply is split once."""
    def result(x):
        last, many = F.try_element_at(x["lines"], F.lit(-1)), F.size(x["lines"]) > 0
        plain = last.isin("0", "1")
        tail = F.struct(
            ustrip(F.array_join(F.slice(x["lines"], 1, F.greatest(F.size(x["lines"]) - 1, F.lit(0))), " ")).alias("earlier"),
            F.when(plain, last).otherwise(F.nullif(F.regexp_extract(x["r"], r"(?U)\b([01])\b", 1), F.lit(""))).alias("digit"))
        return bind(tail, lambda t: F.struct(
            F.when(many, t["digit"]).cast("int").alias("label"),
            F.when(~many | t["digit"].isNull(), F.lit(None).cast("string")).when(plain | (t["earlier"] != F.lit("")), t["earlier"])
            .otherwise(ustrip(F.replace(x["r"], t["digit"], F.lit("")))).alias("explanation")))

    whole = ustrip(F.coalesce(_col(reply), F.lit("")))
    split = lambda r: F.filter(F.transform(F.split(r, r"\R"), lambda x: ustrip(x)), lambda x: x != F.lit(""))
    return bind(whole, lambda r: bind(F.struct(r.alias("r"), split(r).alias("lines")), result))


def parse_two_line_reply(reply) -> tuple[Column, Column]:
    """(label int or null, explanation or null) from a model reply.

    Non-blank stripped lines; if the last line is exactly '0' or '1' it is the
    label and the earlier lines joined by a space are the explanation. Else
    the first standalone 0/1 anywhere is the label and the explanation is the
    earlier lines, or (when empty) the reply with every occurrence of that
    digit removed. Else (null, null). ``two_line_reply`` gives both at once.
    """
    both = two_line_reply(reply)
    return both["label"], both["explanation"]


def strip_code_fence(reply) -> Column:
    """Remove a leading ```json / ``` fence and a trailing ``` (the fence
    itself, not a character set)."""
    r = ustrip(F.coalesce(_col(reply), F.lit("")))
    r = F.regexp_replace(r, r"\A```(?:json)?", "")
    r = F.regexp_replace(r, r"```\z", "")
    return ustrip(r)


def json_reply(reply, dm_key: str = "DM", sentiment_key: str = "Sentiment") -> Column:
    """T2 as one struct (dm, sentiment, status): the fence is cut and the JSON parsed once."""
    def result(x):
        ok = x["v"].isNotNull() & x["body"].startswith("{")
        part = lambda key: F.coalesce(F.try_variant_get(x["v"], f"$.{key}", "string"), F.lit(""))
        return F.struct(F.when(ok, part(dm_key)).otherwise(F.lit("Error: invalid JSON")).alias("dm"),
                        F.when(ok, part(sentiment_key)).otherwise(F.lit("Unknown")).alias("sentiment"),
                        F.when(ok, F.lit("ok")).otherwise(F.lit("error")).alias("status"))

    return bind(strip_code_fence(reply), lambda body: bind(F.struct(body.alias("body"), F.try_parse_json(body).alias("v")), result))


def parse_json_reply(reply, dm_key: str = "DM", sentiment_key: str = "Sentiment"):
    """(dm, sentiment, status). Valid JSON object -> its ``DM`` and
    ``Sentiment`` (missing -> ''), status 'ok'; otherwise dm 'Error: invalid
    JSON', sentiment 'Unknown', status 'error'. ``json_reply`` gives all at once."""
    x = json_reply(reply, dm_key, sentiment_key)
    return x["dm"], x["sentiment"], x["status"]
