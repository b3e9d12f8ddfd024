"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

1. Texts are cut into pre-tokens. A *block* of about ``BLOCK_BYTES`` of texts keeps the positions (for
   each pre-token its place in the block's list of distinct words) and explodes the distinct words into
   one list per word partition (a hash of the word). Blocks are staged, bucketed by block.
2. The lists are shuffled by word partition. Every distinct word lies in one partition, where it is
   encoded exactly once, however many blocks and documents hold it; a frequent word costs a
   partition one entry per block.
3. The ids are joined back by block, and each block reassembles its documents by position.
4. Decoding joins ids with the token-byte table, one row per token of the vocabulary (a bounded
   table that travels with the function).

Lists, ids and positions travel as compressed arrays, many to a row. Within a block, words are told apart by
64-bit hashes. Blocks are bounded (a single longer text is a block of its own) and cut a slice at a
time; word partitions number ``spark.sql.shuffle.partitions``; no step holds more than a block's
positions or one partition's words.

Defined results: null text counts as empty (no ids); ties and repeated rows are encoded row by row; an
empty table gives an empty result. Only the id and text columns are read. A token id outside
the table makes decoding fail.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm import pretoken
from textlab.llm.common import bucketed, release

BLOCK_BYTES = 8 << 20
SLICE_BYTES = 1 << 20
#: Ids handled at a time when documents are put together.
OUT_IDS = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, of a public rank file (on the driver's disk)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their bytes gathered by significance, compressed."""
    import zstandard
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(len(values).to_bytes(8, "little") + planes.tobytes())


def unpack(data) -> np.ndarray:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 8).reshape(4, n).T).view("<u4").ravel()


def pack_words(words: list[bytes]) -> bytes:
    import zstandard
    sizes = np.fromiter(map(len, words), "<u4", len(words))
    return zstandard.ZstdCompressor(level=3).compress(
        len(words).to_bytes(8, "little") + sizes.tobytes() + b"".join(words))


def unpack_words(data) -> list[bytes]:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    at = 8 + 4 * n + np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<u4", n, 8), dtype=np.int64)))
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


class Block:
    """The distinct words of some texts, and the positions of each."""

    def __init__(self):
        self.index, self.words, self.hashes = pretoken.Index(), [], []
        self.places, self.counts, self.often = [], [], np.empty(0, np.int64)

    def add(self, texts: list[str]) -> None:
        joined, start, stop, h, counts = pretoken.cut(texts)
        h, first, place, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        number, new = self.index.find(h)
        first = first[new]
        self.words += [joined[a:b].encode() for a, b in zip(start[first].tolist(), stop[first].tolist())]
        self.hashes.append(h[new])
        self.often = np.concatenate((self.often, np.zeros(int(new.sum()), np.int64)))
        self.often[number] += times
        self.places.append(number[place])
        self.counts.append(counts)

    def row(self, block: int, ids, kind, parts: int) -> pa.RecordBatch:
        """Positions are numbered by how often a word comes, which packs well; ``order`` leads from there to
        the words' places in the lists, where they stand by partition and then by their bytes."""
        part = (np.concatenate([np.empty(0, np.uint64), *self.hashes]) % np.uint64(parts)).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[by_part], np.arange(parts + 1))
        lists, where, at = [], np.empty(len(part), np.uint32), 0
        for p in np.flatnonzero(np.diff(cut)).tolist():
            own = sorted(by_part[cut[p]:cut[p + 1]].tolist(), key=self.words.__getitem__)
            where[own] = np.arange(at, at + len(own))
            at += len(own)
            lists.append({"part": p, "words": pack_words([self.words[i] for i in own])})
        ranked = np.argsort(-self.often, kind="stable")
        rank = np.empty(len(ranked), np.uint32)
        rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
        places = np.concatenate([np.empty(0, np.uint32), *(rank[x] for x in self.places)])
        return pa.record_batch([
            pa.array([block], pa.int64()), pa.array([ids], pa.list_(kind)),
            pa.array([pack(np.concatenate([np.empty(0, np.int64), *self.counts]))], pa.binary()),
            pa.array([pack(places)], pa.binary()), pa.array([pack(where[ranked])], pa.binary()),
            pa.array([lists], pa.list_(pa.struct([("part", pa.int32()), ("words", pa.binary())])))],
            names=["block", "ids", "counts", "places", "order", "words"])


def blocks(docs: DataFrame, parts: int, id_col: str, text_col: str) -> DataFrame:
    """block, ids (of its documents), counts, places, order, words (a list for each word partition)."""
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    schema = (f"block long, ids array<{id_type}>, counts binary, places binary, order binary, "
              "words array<struct<part:int,words:binary>>")

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        block, ids, size, kind = Block(), [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b, texts in pretoken.text_chunks(batch.column(1), SLICE_BYTES):
                block.add(texts)
                ids += batch.column(0).slice(a, b - a).to_pylist()
                size += sum(map(len, texts))
                if size >= BLOCK_BYTES:
                    yield block.row(number, ids, kind, parts)
                    number, block, ids, size = number + 1, Block(), [], 0
        if ids:
            yield block.row(number, ids, kind, parts)
        release()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decoder(tokens: list[bytes]):
    """A function from ids to the concatenated bytes of their tokens."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    begin, flat = np.cumsum(size) - size, np.frombuffer(b"".join(tokens), np.uint8)

    def run(ids: np.ndarray) -> bytes:
        return b"".join(pretoken.gather(begin[part], size[part], flat).tobytes()
                        for part in (ids[k:k + OUT_IDS] for k in range(0, len(ids), OUT_IDS)))
    return run


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    """The token-byte table: the bytes of token 0, 1, 2, ..."""
    order = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in order] != list(range(len(order))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [t for t, _ in order]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
           text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """One row per input row: id, ids (little-endian u32 bytes); ``with_decoded`` adds the ids' bytes as
    ``decode`` gives them, in the same pass."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = spark.sparkContext.broadcast(ranks)  # the vocabulary: a bounded table
    tokens = spark.sparkContext.broadcast(token_table(ranks)) if with_decoded else None
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    staged = bucketed(blocks(docs, parts, id_col, text_col), "block", "bpe_blocks", spread=False)
    lists = staged.select("block", F.explode("words").alias("w")).select("block", "w.part", "w.words")

    def encode_words(group):
        import tiktoken
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        answers = []
        for data in group["words"]:
            words = unpack_words(data.as_buffer())
            for w in words:
                if w not in known:
                    known[w] = encoding.encode_ordinary(w.decode())
            found = [known[w] for w in words]
            size = np.fromiter(map(len, found), np.uint32, len(found))
            answers.append({"sizes": pack(size), "ids": pack(
                np.fromiter((i for f in found for i in f), np.uint32, int(size.sum())))})
        release()
        return pa.table({"block": group["block"], "part": group["part"],
                         "sizes": pa.array([x["sizes"] for x in answers], pa.binary()),
                         "ids": pa.array([x["ids"] for x in answers], pa.binary())})

    answers = lists.groupBy("part").applyInArrow(encode_words, "block long, part int, sizes binary, ids binary")
    per_block = answers.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("part", "sizes", F.col("ids").alias("word_ids")))).alias("answers"))

    def reassemble(batches):
        read = decoder(tokens.value) if tokens else None
        for batch in batches:
            for names, counts, places, order, got in zip(*(batch.column(k) for k in range(5))):
                got = got.values if got.is_valid else None
                parts = [[unpack(x.as_buffer()) for x in (got.field(f) if got is not None else [])]
                         for f in ("sizes", "word_ids")]
                sizes, flat = (np.concatenate([np.empty(0, np.uint32), *x]) for x in parts)
                order = unpack(order.as_buffer())
                begin = (np.cumsum(sizes, dtype=np.int64) - sizes)[order]
                sizes = sizes[order]
                places = unpack(places.as_buffer())
                upto = np.concatenate(([0], np.cumsum(unpack(counts.as_buffer()), dtype=np.int64)))
                a = 0
                while a < len(upto) - 1:
                    b = max(a + 1, int(np.searchsorted(upto, upto[a] + OUT_IDS, "right")) - 1)
                    own = places[upto[a]:upto[b]]
                    size = sizes[own].astype(np.int64)
                    ids = pretoken.gather(begin[own], size, flat)
                    cut = np.concatenate(([0], np.cumsum(size)))[upto[a:b + 1] - upto[a]].tolist()
                    own = [ids[x:y] for x, y in zip(cut[:-1], cut[1:])]
                    out = [names.values.slice(a, b - a), pa.array([x.tobytes() for x in own], pa.binary())]
                    if read:
                        out.append(pa.array([read(x) for x in own], pa.binary()))
                    yield pa.record_batch(out, names=["id", "ids", "decoded"][:len(out)])
                    a = b
        release()

    return (staged.select("block", F.col("ids").alias("names"), "counts", "places", "order")
            .join(per_block.hint("shuffle_hash"), "block", "left")
            .select("names", "counts", "places", "order", "answers")
            .mapInArrow(reassemble, f"id {id_type}, ids binary" + ", decoded binary" * with_decoded))


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with a further column ``decoded`` (binary): the bytes of its ids."""
    tokens = encoded.sparkSession.sparkContext.broadcast(token_table(ranks))
    at = encoded.columns.index("ids")

    def run(batches):
        read = decoder(tokens.value)
        for batch in batches:
            out = [read(np.frombuffer(x.as_buffer(), "<u4")) for x in batch.column(at)]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])
        release()

    return encoded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
                              + ", decoded binary")
