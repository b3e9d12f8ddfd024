"""Token-ID files: zstandard frames per document under one shared, trained dictionary.

Writing: documents are range-partitioned by id (a row number breaks ties, so one id with a third of
the rows is split), sorted inside each slice, encoded, and packed into *chunks*. A chunk is a
self-contained binary:

    "TIDZ", version u8, bytes per id u8, 2 spare bytes, SHA-256 of the dictionary (32 bytes),
    n u32, ids in this slice before the chunk u64,
    n + 1 frame offsets u64, n id counts u32, then n zstandard frames

so one document is read by seeking to its frame. Chunks are stored through Spark's own writer (a
``payload`` column of Parquet parts, one row per chunk), which reaches every store the cluster
reaches; the dictionary is stored beside them and readers check its hash.

The dictionary is trained on serialized id arrays of a bounded sample: ``sample_docs`` documents in hash
order, at most ``SLICES`` pieces of ``SLICE_IDS`` ids of each. Everything else covers all rows and whole
texts. Distinct pre-tokens are encoded by the tokenizers library, once per worker as long as they
fit its cache: byte-level BPE merges never cross pre-tokens.

Defined results: null text counts as empty, so it has the end id alone; null ids come first; repeated
rows are written once each; an empty table gives empty files. Ids are those of the plain library call with
``add_special_tokens=False``: a string of an added token inside a text is that token, and a text that holds one is encoded
whole by the library. Memory follows the longest text. Only the id and text columns are read, so other columns cannot clash.
The tokenizer's file is read by the driver and sent to the tasks.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textlab.llm import pretoken
from textlab.llm.common import hash_sample
from textlab.session import ensure_checkpoint_dir

MAGIC, VERSION = b"TIDZ", 1
HEAD = "<4sBBH32sIQ"
CHUNK_BYTES = 4 << 20
SLICES, SLICE_IDS = 4, 1024
DICT_BYTES = 64 << 10
CACHE_WORDS = 2_000_000
LEVEL = 3
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Whole texts to ids with the tokenizers library, one call per new distinct pre-token.

    Known words are found by their 64-bit hash; at ``CACHE_WORDS`` words the cache starts anew.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.index = pretoken.Index()
        self.begin, self.size = np.empty(0, np.int64), np.empty(0, np.int32)
        self.flat = np.empty(0, np.uint32)

    @classmethod
    def of(cls, spec: str) -> "Encoder":
        """The worker's encoder of a tokenizer file's content."""
        key = hashlib.sha256(spec.encode()).hexdigest()
        if key not in _encoders:
            _encoders[key] = cls(spec)
        return _encoders[key]

    def _learn(self, words: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(size, dtype=np.int64) - size))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, flat))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The u32 ids of each text, in order; callers bound the texts they pass at once."""
        special = {k: t for k, t in enumerate(texts) if any(a in t for a in self.added)}
        if special:
            plain = self._plain(["" if k in special else t for k, t in enumerate(texts)])
            for k, t in special.items():
                plain[k] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            return plain
        return self._plain(texts)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        joined, start, stop, h, counts = pretoken.cut(texts)
        words, first, place = np.unique(h, return_index=True, return_inverse=True)
        if len(self.index.keys) + len(words) > CACHE_WORDS:
            self.forget()
        number, new = self.index.find(words)
        if new.any():
            first = first[new]
            self._learn([joined[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist())])
        number = number[place]
        size = self.size[number]
        ids = pretoken.gather(self.begin[number], size, self.flat)
        upto = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[np.concatenate(([0], np.cumsum(counts)))]
        return [ids[upto[k]:upto[k + 1]] for k in range(len(texts))]


def id_width(spec: str) -> int:
    """Bytes per id on disk: 2 if every id of the vocabulary fits."""
    return 2 if max(Encoder.of(spec).tokenizer.get_vocab().values()) < 1 << 16 else 4


def train_dictionary(docs: DataFrame, spec, id_col: str, text_col: str, sample_docs: int,
                     width: int) -> bytes:
    """A dictionary from slices of a bounded sample's id arrays (at most ``SLICES`` x ``SLICE_IDS`` x width bytes of a document).

    ``spec`` is the broadcast content of the tokenizer's file.
    """
    import zstandard
    some = hash_sample(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
                       [F.col("id")], sample_docs)

    def run(batches):
        encoder = Encoder.of(spec.value)
        for batch in batches:
            out = []
            for ids in (x for _, _, texts in pretoken.text_chunks(batch.column(1)) for x in encoder.encode(texts)):
                step = max(SLICE_IDS, -(-len(ids) // SLICES))
                out += [ids[k:k + SLICE_IDS].astype(f"<u{width}").tobytes() for k in range(0, len(ids), step)]
            yield pa.record_batch([pa.array(out, pa.binary())], names=["piece"])

    pieces = sorted(r[0] for r in some.mapInArrow(run, "piece binary").toLocalIterator())
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they serve as plain content
        return b"".join(pieces)[:DICT_BYTES]


def dictionary(data: bytes):
    import zstandard
    return zstandard.ZstdCompressionDict(data) if data else None


def write(docs: DataFrame, tokenizer: str, root: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = 0, sample_docs: int = 1000) -> None:
    """Write ``root/chunks`` and ``root/dictionary``; ``tokenizer`` is the path of a tokenizer file at the driver."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    width = id_width(spec.value)
    trained = train_dictionary(docs, spec, id_col, text_col, sample_docs, width)
    digest = hashlib.sha256(trained).digest()
    spark.range(1).select(F.lit(bytearray(trained)).alias("data"), F.lit(digest.hex()).alias("sha256")) \
        .write.parquet(f"{root}/dictionary")
    id_type = docs.select(id_col).schema[0].dataType
    schema = f"shard int, part int, n_ids long, ids array<{id_type.simpleString()}>, payload binary"

    def run(batches):
        import zstandard
        encoder = Encoder.of(spec.value)
        known = dictionary(trained)
        if known:
            known.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known)
        shard = TaskContext.get().partitionId()
        part = before = size = 0
        names, frames, counts = [], [], []

        def pack():
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype("<u8")
            head = struct.pack(HEAD, MAGIC, VERSION, width, 0, digest, len(frames), before)
            payload = b"".join((head, offsets.tobytes(), np.array(counts, "<u4").tobytes(), *frames))
            return pa.record_batch([pa.array([shard], pa.int32()), pa.array([part], pa.int32()),
                                    pa.array([sum(counts)], pa.int64()), pa.array([names], pa.list_(kind)),
                                    pa.array([payload], pa.binary())],
                                   names=["shard", "part", "n_ids", "ids", "payload"])
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            every = (x for _, _, texts in pretoken.text_chunks(batch.column(1)) for x in encoder.encode(texts))
            for name, ids in zip(batch.column(0).to_pylist(), every):
                raw = np.append(ids, np.uint32(end_id)).astype(f"<u{width}")
                frames.append(packer.compress(raw.tobytes()))
                names.append(name)
                counts.append(len(raw))
                size += len(frames[-1])
                if size >= CHUNK_BYTES:
                    yield pack()
                    part, before, size = part + 1, before + sum(counts), 0
                    names, frames, counts = [], [], []
        if frames:
            yield pack()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.monotonically_increasing_id().alias("tie"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    rows.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{root}/chunks")


def read_dictionary(spark, root: str) -> bytes:
    row = spark.read.parquet(f"{root}/dictionary").first()
    data = bytes(row["data"])
    if hashlib.sha256(data).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary does not match its hash")
    return data


def index(payload: bytes, digest: bytes | None = None):
    """(bytes per id, ids before, frame offsets, id counts, where frames begin) of a chunk."""
    magic, version, width, _, sha, n, before = struct.unpack_from(HEAD, payload)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token chunk")
    if digest is not None and sha != digest:
        raise ValueError("the chunk was written with another dictionary")
    at = struct.calcsize(HEAD)
    offsets = np.frombuffer(payload, "<u8", n + 1, at)
    counts = np.frombuffer(payload, "<u4", n, at + 8 * (n + 1))
    return width, before, offsets, counts, at + 8 * (n + 1) + 4 * n


def read_document(payload: bytes, k: int, trained: bytes) -> np.ndarray:
    """The ids of the k-th document of a chunk: one frame is read, no other."""
    import zstandard
    width, _, offsets, counts, base = index(payload, hashlib.sha256(trained).digest())
    frame = payload[base + int(offsets[k]):base + int(offsets[k + 1])]
    raw = zstandard.ZstdDecompressor(dict_data=dictionary(trained)).decompress(frame, int(counts[k]) * width)
    return np.frombuffer(raw, f"<u{width}").astype(np.uint32)


def read(spark, root: str) -> DataFrame:
    """From the files: doc id, start (ids of all documents before it), n_tokens, ids (u32 bytes)."""
    trained = read_dictionary(spark, root)
    digest = hashlib.sha256(trained).digest()
    chunks = spark.read.parquet(f"{root}/chunks")
    id_type = chunks.schema["ids"].dataType.elementType

    def run(batches):
        import zstandard
        opener = zstandard.ZstdDecompressor(dict_data=dictionary(trained))
        for batch in batches:
            shards, names = batch.column(0).to_pylist(), batch.column(1)
            for row, (shard, payload) in enumerate(zip(shards, batch.column(2))):
                payload = payload.as_buffer()
                width, before, offsets, counts, base = index(payload, digest)
                own = names[row].values
                starts = before + np.cumsum(counts, dtype=np.int64) - counts
                view = memoryview(payload)
                for a in range(0, len(counts), 512):
                    b = min(a + 512, len(counts))
                    raw = [np.frombuffer(opener.decompress(
                        view[base + int(offsets[k]):base + int(offsets[k + 1])], int(counts[k]) * width), f"<u{width}")
                        .astype("<u4").tobytes() for k in range(a, b)]
                    yield pa.record_batch([
                        pa.array(np.full(b - a, shard, np.int32)), own.slice(a, b - a),
                        pa.array(starts[a:b], pa.int64()), pa.array(counts[a:b].astype(np.int64)),
                        pa.array(raw, pa.binary())], names=["shard", "id", "inside", "n_tokens", "ids"])

    rows = chunks.select("shard", "ids", "payload").mapInArrow(
        run, f"shard int, id {id_type.simpleString()}, inside long, n_tokens long, ids binary")
    # ids of the slices before: a table of one row per slice of the range partitioning
    before = F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    base = (chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
            .select("shard", F.coalesce(before, F.lit(0)).cast("long").alias("base")))
    return rows.join(F.broadcast(base), "shard").select(
        "id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids")


def scratch(spark, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "stages", f"{name}-{uuid.uuid4().hex}")

