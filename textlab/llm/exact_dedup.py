"""Exact dedup by an extendible-hash index on shared files (native).

1. Rows get a 64-bit hash of their text. Their digests are staged; they carry a row to its answer instead of its text.
2. The *directory* says which bucket owns a hash: a bucket is a key range, all hashes with one prefix. Doubling
   starts from one bucket of everything and splits overfull ones, so a bucket's local depth is the smallest at which
   it holds at most ``capacity`` entries (distinct hashes). Entry counts at every depth are added up in Spark, and the directory stays
   a table; no key, count or bucket comes to the driver. At the greatest depth (``depth_for``) a bucket keeps what it has.
3. Rows are dealt to the owner tasks of their buckets. An owner chains the different texts that share a hash,
   comparing their bytes (the texts themselves are the grouping key, hashes only say where), counts each text
   and picks the row to keep. Rows of a hash with more than 1/1000 of all rows (at most 1000 hashes, by counting) are not
   dealt: their copies are added up where they are, and the sums are chained.
4. Owners write their entries, (bucket, hash, place in the chain, digest, size, row to keep), to shared files bucketed by owner; rows look
   their answer up there by (bucket, hash, digest). Entries of large groups are broadcast (at most 1000, by counting).

Defined results: null text equals the empty text; of equal texts the row with the largest id stays
(null ids are smallest); of repeated rows with that same id exactly one is kept; an empty table
gives an empty result; texts of any length are compared whole. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textlab.llm.common import bucketed, fresh
from textlab.session import small, stage

#: One hash, or group, in so many rows is hot; there are at most so many hot ones.
HOT_SHARE = 1000
#: Bytes of text, and rows of the index, that a task is dealt.
OWNER_BYTES = 64 << 20
INDEX_ROWS = 1 << 20


def bucket_of(depth: int) -> Column:
    """The directory slot of a hash at a global depth: its leading bits, as a number."""
    return F.shiftrightunsigned(F.col("h"), 64 - depth) if depth else F.lit(0).cast("long")


def depth_for(n: int, capacity: int) -> int:
    """Where doubling ends for ``n`` entries: 16 times as many slots as full buckets, 2^14 at least."""
    return max(14, (-(-n // capacity)).bit_length() + 4)


def build_directory(hashes: DataFrame, capacity: int, depth: int) -> DataFrame:
    """(slot, bucket, local) of every slot in use at the global ``depth``; ``hashes`` has the distinct hashes ``h``.

    ``bucket`` numbers the prefix of ``local`` bits that the slot's bucket covers, unlike any other bucket's.
    """
    counts = stage(hashes.groupBy(bucket_of(depth).alias("slot")).agg(F.count("*").alias("n")), "exact-slots")
    at = counts.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local"))
    at = at.withColumn("prefix", F.expr(f"shiftright(slot, {depth} - local)"))
    fits = (at.groupBy("local", "prefix").agg(F.sum("n").alias("n"))
            .filter((F.col("n") <= capacity) | (F.col("local") == depth)).select("local", "prefix"))
    first = at.join(fits, ["local", "prefix"]).groupBy("slot").agg(F.min("local").alias("local"))
    return first.select("slot", F.expr(f"shiftleft(1L, local) + shiftright(slot, {depth} - local)").alias("bucket"), "local")


def chained(rows: DataFrame) -> DataFrame:
    """The chains of all hashes: one entry per different text, in byte order, with its copies and the row to keep.

    Rows that are dealt by bucket stay in their owner task; the sort by (bucket, hash, text) serves both steps.
    """
    entries = rows.groupBy("bucket", "h", "text").agg(
        F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("keep"))
    place = F.row_number().over(W.partitionBy("bucket", "h").orderBy("text"))
    return entries.withColumn("place", place).withColumn("sha", F.sha2("text", 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = 10_000, max_depth: int | None = None, row_col: str | None = None,
                 hash_of=F.xxhash64) -> DataFrame:
    """One row per input row: id, row, keep_id, group_size, kept, text_sha256.

    ``row_col`` names a unique row number of ``docs``, which is staged then; without it the texts are staged here with one.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("id"), body.alias("text"), hash_of(body).cast("long").alias("h"),
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).cast("long").alias("row"))
    if not row_col:
        keyed = stage(keyed, "exact-texts")
    rows = stage(keyed.select("id", "row", "h", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("bytes")),
                 "exact-rows")
    n_rows, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashes = stage(rows.groupBy("h").agg(F.count("*").alias("n")), "exact-hashes")
    depth = max_depth if max_depth is not None else depth_for(hashes.count(), capacity)
    directory = small(build_directory(hashes, capacity, depth), 24)
    share = max(1, n_rows // HOT_SHARE)
    hot_hashes = F.broadcast(hashes.filter(F.col("n") > share).select("h"))
    placed = keyed.withColumn("slot", bucket_of(depth)).join(directory, "slot")
    # every row to the owner of its bucket; copies under a hot hash are added up before they move
    dealt = placed.join(hot_hashes, "h", "left_anti").repartition(max(least, -(-n_bytes // OWNER_BYTES)), "bucket")
    entries = chained(dealt).unionByName(chained(placed.join(hot_hashes, "h", "left_semi"))).select(
        "bucket", "h", "place", "sha", "group_size", F.col("keep.id").alias("keep_id"), F.col("keep.row").alias("keep_row"))
    index = bucketed(entries, "bucket", "exact_index", parts=max(least, -(-n_rows // INDEX_ROWS)))
    on = ["bucket", "h", "sha"]
    asked = rows.withColumn("slot", bucket_of(depth)).join(directory, "slot").select(*on, "id", "row")
    looked = asked.join(F.broadcast(index.filter(F.col("group_size") > share)), on, "left")
    known = looked.filter(F.col("group_size").isNotNull())
    rest = (looked.filter(F.col("group_size").isNull()).select(*on, "id", "row")
            .join(index.filter(F.col("group_size") <= share), on))
    return known.unionByName(rest).select(
        "id", "row", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    row = fresh(docs, "_row")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "exact-docs")
    kept = exact_groups(numbered, id_col, text_col, row_col=row).filter("kept").select(F.col("row").alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)
