"""Sharding by rendezvous hashing of stable record keys over weighted shards (native).

Every record scores every shard, ``-ln(u) / weight`` with ``u`` a uniform number drawn from
md5(key, shard); the smallest score wins. A score depends on one key and one shard only, so a
further shard takes rows only into itself, and a shard's share follows its weight.

Defined results: a null key counts as the text ``\\N`` (all such rows share a shard, as the law
demands: the key alone decides); null text has size 1 and crc32 0; repeated rows each get their
own slot; rows of equal key, size and text crc get theirs in no set order; an empty table gives an empty result; texts of any
length are read whole. Only the key and text columns are read, so extra columns are not returned and cannot clash; a
key column named like an output column comes back with ``_key`` behind its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textlab.session import stage

#: 52 bits of md5, moved off zero so that the logarithm is finite.
_BITS = 52


def uniform(key: Column, shard: Column) -> Column:
    """A number in (0, 1) that depends on the key and the shard only."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("\\N")), shard.cast("string")))
    whole = F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("double")
    return (whole + 0.5) / float(2 ** _BITS)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (int) with the smallest weighted score; equal scores go to the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    scores = [F.struct((-F.ln(uniform(key, F.lit(s))) / F.lit(float(w))).alias("score"), F.lit(s).alias("shard"))
              for s, w in enumerate(weights)]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"].cast("int")


def number_slots(df: DataFrame, shard: str, order: list[str], out: str = "slot") -> DataFrame:
    """Gapless numbers from 0 in every shard, in the given order, without a window over a shard.

    Rows are range-partitioned by the order columns (a row number breaks ties, so that one key
    with a third of the rows is split too), staged once, numbered inside each (slice, shard) and
    shifted by the counts of the slices before: a table of slices x shards rows.
    """
    cols = df.columns
    mixed = df.withColumn("_tie", F.monotonically_increasing_id())
    slices = (mixed.repartitionByRange(*[F.col(c) for c in order], F.col("_tie"))
              .sortWithinPartitions(*order, "_tie")
              .withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    rows = stage(slices, "shard-slots").withColumn("_slice", F.shiftright("_at", 33))
    counts = rows.groupBy(shard, "_slice").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(shard).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    base = counts.select(F.col(shard).alias("_s"), F.col("_slice").alias("_b"),
                         F.coalesce(before, F.lit(0)).cast("long").alias("_base"))
    inside = F.row_number().over(W.partitionBy(shard, "_slice").orderBy("_at"))
    return (rows.withColumn("_in", inside.cast("long"))
            .join(base, (F.col(shard) == F.col("_s")) & (F.col("_slice") == F.col("_b")))
            .select(*cols, (F.col("_base") + F.col("_in") - 1).alias(out)))


def shard_documents(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text",
                    grown_weight: float | None = None) -> DataFrame:
    """Shard, size and slot of every row, with the shard it would have after one more shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    small = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, grown_weight or weights[-1]]).alias("grown_shard"))
    out = number_slots(small, "shard", ["_key", "text_crc32", "size"])
    taken = {c.lower() for c in out.columns}
    return out.withColumnRenamed("_key", key if key.lower() not in taken else f"{key}_key")
