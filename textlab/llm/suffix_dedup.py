"""Removal of repeated byte strings by a difference-cover suffix order, built block by block.

A byte is removed if it lies in a string of ``width`` bytes that also starts anywhere else in the corpus. The
suffixes that matter are those that share their first ``width`` bytes with another one.

* **Cover sample.** Positions whose residue modulo ``v`` is in a difference cover of Z_v are the sample. For any
  two positions some shift below ``v`` puts both in the sample, so two equal strings of ``width`` bytes always
  hold, at one shift, two equal sample strings of ``width - v + 1`` bytes. Sample suffixes are ranked on that
  many bytes, where a rank is a name: equal strings, equal names.
* **Buckets.** Names are dealt to buckets by their leading bits; a task sorts one bucket at a time, so the
  memory for sorting is a bucket, not the text. It answers which names occur more than once.
* **Ties.** A suffix with no repeated sample name within ``v`` bytes is unique, and most suffixes end here. The
  rest (long ties) are resolved by names of their whole ``width`` bytes, composed from running sums, and sorted
  by bucket in the same way. Suffixes that share a name and its check there are repeats.

Only equality of the first ``width`` bytes matters here, so buckets and ties are ordered by name (56 mixed bits
of a polynomial hash with random byte values) instead of by the bytes themselves; texts need not follow their
suffixes into a bucket. Before bytes go, the suffixes of one name are told apart by a check, 32 bits of a second name
under other random byte values: two different strings share both with probability 2^-88. A false pair of sample
names only makes one more suffix a tie. A list of names is sent as counts of their leading 16 bits, which rise, and the
other 40 bits of each.

Texts are packed into *blocks* of about ``BLOCK`` bytes, staged once in a table bucketed by block, so that
answers are joined to their block without moving texts again. A block sends a bucket its distinct names
only, with a mark on those it holds twice: a string that a third of all documents share costs a bucket one entry
per block.

Defined results: null text counts as empty; matches never cross texts; texts shorter than ``width`` lose nothing;
repeated rows are repeats of each other; an empty table gives an empty result. Only the id and text columns are
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.bytesops import BYTE, CHUNK, covered, prefix, runs, spans, table
from textlab.llm.common import bucketed, release

#: Byte values of the checks.
CHECK = table(2)
BLOCK = 4 << 20
#: Bytes of the blocks that a task reads on average.
PART = 4 * BLOCK
#: Names a bucket holds on average; it is sorted in the memory of one task.
BUCKET_NAMES = 2_000_000
#: Leading bits of a name that are kept: what ``packed`` sends.
NAME_BITS = 56


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """(v, cover): the known construction from steps 1, r+1, 2r+1, 4r+3, 2r+2, 1 with v = 24r^2 + 36r + 13."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.concatenate(([0], np.cumsum(steps)))


def cover_for(width: int) -> tuple[int, np.ndarray]:
    """The largest cover whose sample strings keep at least half of the width (v = 1 if there is none)."""
    r = 0
    while 24 * (r + 1) ** 2 + 36 * (r + 1) + 13 <= width // 2 + 1:
        r += 1
    return difference_cover(r) if 13 <= width // 2 + 1 else (1, np.array([0]))


def pieces(texts: list[bytes], overlap: int, chunk: int):
    """(text number, where the piece begins, bytes) of pieces of at most ``chunk`` starts each."""
    for i, t in enumerate(texts):
        for at in range(0, len(t), chunk):
            yield i, at, t[at:at + chunk + overlap]


def joined(texts: list[bytes], overlap: int, chunk: int):
    """Pieces laid end to end, about ``chunk`` bytes at a time: bytes, sizes, text numbers, offsets."""
    data, where, size = [], [], 0
    for i, at, piece in pieces(texts, overlap, chunk):
        if size and size + len(piece) > 2 * chunk:
            yield _packed(data, where)
            data, where, size = [], [], 0
        data.append(piece)
        where.append((i, at))
        size += len(piece)
    if data:
        yield _packed(data, where)


def _packed(data, where):
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    text, at = np.array(where, np.int64).T
    return np.frombuffer(b"".join(data), np.uint8), sizes, text, at


def places(sizes: np.ndarray, length: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in joined pieces where a string of ``length`` bytes begins, among the first ``most`` of its
    piece, and ends inside the piece; their pieces."""
    n = np.clip(sizes - length + 1, 0, most)
    of = np.repeat(np.arange(len(sizes)), n)
    begin = np.cumsum(sizes) - sizes
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[of], of


class Cover:
    """Sample names and long ties of a block's texts."""

    def __init__(self, width: int, chunk: int = CHUNK, name_bits: int = NAME_BITS):
        self.width, self.chunk = width, chunk
        self.rest = np.uint64(64 - name_bits)
        self.v, cover = cover_for(width)
        self.least = width - self.v + 1
        self.inside = np.zeros(self.v, bool)
        self.inside[cover % self.v] = True

    def named(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return spans(sums, start, stop) >> self.rest << self.rest

    def samples(self, texts: list[bytes], beyond: int = 0):
        """For each part of the block: its bytes, their sums, pieces, sample places and their names.

        The bytes after the first ``chunk`` of a piece are the next piece's too; samples among ``beyond`` of them
        are only wanted for the suffixes before them.
        """
        for raw, sizes, text, at in joined(texts, self.width - 1, self.chunk):
            sums = prefix(BYTE[raw])
            p, of = places(sizes, self.least, self.chunk + beyond)
            begin = np.cumsum(sizes) - sizes
            # residues of positions in the text, looked up in the cover laid out again and again
            laid = np.tile(self.inside, int(sizes.max()) // self.v + 2)
            p = p[laid[p - (begin - at % self.v)[of]]]
            yield raw, sums, sizes, text, at, p, self.named(sums, p, p + self.least)

    def ties(self, texts: list[bytes], repeated: np.ndarray):
        """Text numbers, positions, whole-width names and checks of suffixes near a repeated sample name."""
        for raw, sums, sizes, text, at, p, names in self.samples(texts, self.v - 1):
            hit = p[among(names, repeated)]
            if not len(hit):
                continue
            near = np.zeros(len(sums), np.int32)  # the v places up to each repeated sample
            np.add.at(near, np.maximum(hit - self.v + 1, 0), 1)
            np.add.at(near, hit + 1, -1)
            q, qof = places(sizes, self.width, self.chunk)
            near = (np.cumsum(near) > 0)[q]
            q, qof = q[near], qof[near]
            begin = np.cumsum(sizes) - sizes
            if len(q):
                yield (text[qof], q - begin[qof] + at[qof], self.named(sums, q, q + self.width),
                       (spans(prefix(CHECK[raw]), q, q + self.width) >> np.uint64(32)).astype(np.uint32))


def among(names: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which names are in a sorted array."""
    if not len(known):
        return np.zeros(len(names), bool)
    at = np.searchsorted(known, names)
    return known[np.minimum(at, len(known) - 1)] == names


def distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct names, and which of them occur more than once."""
    names = np.sort(np.concatenate([np.empty(0, np.uint64), *parts]))
    new = np.concatenate(([True], names[1:] != names[:-1])) if len(names) else np.empty(0, bool)
    first = np.flatnonzero(new)
    return names[first], np.diff(np.append(first, len(names))) > 1


def in_order(names: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The order by name, then check, and which rows of that order equal the row before them."""
    order = np.argsort(names)
    same = np.zeros(len(names), bool)
    same[1:] = names[order[1:]] == names[order[:-1]]
    if check is not None:
        other = np.zeros(len(names), bool)
        other[1:] = check[order[1:]] != check[order[:-1]]
        if (same & other).any():  # one name, several strings
            order = np.lexsort((check, names))
            same[1:] = (names[order[1:]] == names[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
    return order, same


def ties_in_order(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names and checks of a block's ties, their order, and which rows of that order equal the row before them."""
    names, check = np.concatenate([x[2] for x in found]), np.concatenate([x[3] for x in found])
    return names, check, *in_order(names, check)


def distinct_ties(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (name, check) of a block's ties by name, then check, and which of them occur more than once."""
    names, check, order, same = ties_in_order(found)
    first = np.flatnonzero(~same)
    return names[order[first]], check[order[first]], np.diff(np.append(first, len(names))) > 1


def packed(names: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted names as their first leading 16 bits, the counts of these and the following ones, and the next 40 bits."""
    lead = (names >> np.uint64(48)).astype(np.int64)
    counts = np.bincount(lead - lead[0]).astype("<u4")
    return int(lead[0]), counts.tobytes(), names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 1:6].tobytes()


def unpacked(first: int, counts, rest) -> np.ndarray:
    counts = np.frombuffer(counts, "<u4")
    out = np.zeros((len(rest) // 5, 8), np.uint8)
    out[:, 1:6] = np.frombuffer(rest, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel() | (np.repeat(np.arange(len(counts), dtype=np.uint64) + np.uint64(first), counts) << np.uint64(48))


def lists(block: int, names: np.ndarray, check: np.ndarray | None, twice: np.ndarray, n_buckets: int):
    """Rows (bucket, block, packed names, check, twice) of a block: a bucket is a range of names."""
    bucket = (((names >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(names)]
    some, cut = bucket[cut[:-1]], list(zip(cut[:-1], cut[1:]))
    sent = [packed(names[a:b]) for a, b in cut]
    return pa.record_batch([
        pa.array(some.astype(np.int32)), pa.array([block] * len(some), pa.int64()),
        pa.array([x[0] for x in sent], pa.int32()), pa.array([x[1] for x in sent], pa.binary()),
        pa.array([x[2] for x in sent], pa.binary()),
        pa.array([None if check is None else check[a:b].tobytes() for a, b in cut], pa.binary()),
        pa.array([np.packbits(twice[a:b]).tobytes() for a, b in cut], pa.binary())],
        names=["bucket", "block", "first", "counts", "rest", "check", "twice"])


LISTS = "bucket int, block long, first int, counts binary, rest binary, check binary, twice binary"


def sort_bucket(group: pa.Table) -> pa.Table:
    """Sort one bucket's names and checks; answer every block which of them occur more than once overall."""
    parts = [unpacked(f.as_py(), c.as_buffer(), r.as_buffer()) for f, c, r in zip(group["first"], group["counts"], group["rest"])]
    names = np.concatenate(parts)
    sizes = np.array([len(x) for x in parts])
    twice = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n)
                            for x, n in zip(group["twice"], sizes)]).astype(bool)
    check = None if group["check"].null_count else np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in group["check"]])
    order, same = in_order(names, check)
    repeat = same.copy()
    repeat[:-1] |= same[1:]
    out = twice
    out[order] |= repeat
    cut = np.cumsum(sizes) - sizes
    release()
    return pa.table({"block": group["block"], "bucket": group["bucket"], "n": pa.array(sizes, pa.int32()),
                     "repeated": pa.array([np.packbits(out[a:a + n]).tobytes() for a, n in zip(cut, sizes)], pa.binary())})


def marked(answers) -> np.ndarray:
    """Which names of a block (sorted, distinct) the buckets' answers mark, in bucket order."""
    bits = [np.frombuffer(x.as_buffer(), np.uint8) for x in (answers.field("repeated") if len(answers) else [])]
    n = [int(x.as_py()) for x in (answers.field("n") if len(answers) else [])]
    return np.concatenate([np.empty(0, np.uint8)] + [np.unpackbits(b, count=k) for b, k in zip(bits, n)]).astype(bool)


def one_bucket(batches):
    """The work of a task: all rows of one bucket."""
    rows = [b for b in batches if b.num_rows]
    if rows:
        yield from sort_bucket(pa.Table.from_batches(rows)).to_batches()


def answered(sent: DataFrame, name: str, n_buckets: int, parts: int) -> DataFrame:
    """(block, answers): one task for each bucket; answers gathered by block in bucket order, in a table bucketed like
    the blocks, so that they meet their block without a shuffle."""
    got = sent.repartitionById(n_buckets, F.col("bucket")).mapInArrow(one_bucket, "block long, bucket int, n int, repeated binary")
    lists = got.repartition(parts, "block").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "n", "repeated"))).alias(name))
    return bucketed(lists, "block", "suffix_answers", spread=False, parts=parts)


def block_table(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Texts packed into blocks, staged once and bucketed by block: block, ids, texts, bytes; number of parts, which
    follows the bytes."""
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            upto = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)))
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + BLOCK, "right")) - 1)
                whole = pa.array([0, b - a], pa.int32())
                yield pa.record_batch([
                    pa.array([block], pa.int64()), pa.ListArray.from_arrays(whole, ids.slice(a, b - a)),
                    pa.ListArray.from_arrays(whole, texts.slice(a, b - a)), pa.array([int(upto[b] - upto[a])], pa.int64())],
                    names=["block", "ids", "texts", "bytes"])
                a, block = b, block + 1

    packed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")) \
        .mapInArrow(run, f"block long, ids array<{id_type}>, texts array<binary>, bytes long")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    parts = max(1, -(-size // PART))
    return bucketed(packed, "block", "suffix_blocks", spread=False, parts=parts), parts


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400,
                   chunk: int = CHUNK, name_bits: int = NAME_BITS) -> DataFrame:
    """One row per input row: id, n_bytes, kept (the bytes left), spans (maximal removed runs).

    ``name_bits``: leading bits of the names that are used, at most ``NAME_BITS``; with few, one name stands for many strings and the
    checks alone tell them apart.
    """
    blocks, parts = block_table(docs, id_col, text_col)
    total = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    cover = Cover(width, chunk, name_bits)
    share = cover.inside.sum() / cover.v
    n_samples = max(1, int(total * share) // BUCKET_NAMES + 1)
    n_ties = max(1, total // 4 // BUCKET_NAMES + 1)
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def texts_of(batch, k):
        return [x.as_buffer().to_pybytes() for x in batch.column("texts")[k].values]

    def sample_names(texts):
        return distinct([names for *_, names in cover.samples(texts)])

    def send_samples(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                names, twice = sample_names(texts_of(batch, k))
                yield lists(batch.column("block")[k].as_py(), names, None, twice, n_samples)

    first = answered(blocks.select("block", "texts").mapInArrow(send_samples, LISTS), "first", n_samples, parts)

    def block_ties(batch, k, texts):
        got = batch.column("first")[k].values
        if got is None:
            return []
        repeated = sample_names(texts)[0][marked(got)]
        return list(cover.ties(texts, repeated)) if len(repeated) else []

    def send_ties(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                found = block_ties(batch, k, texts_of(batch, k))
                if found:
                    yield lists(batch.column("block")[k].as_py(), *distinct_ties(found), n_ties)
        release()

    with_first = blocks.join(first.hint("shuffle_hash"), "block", "left").select("block", "texts", "first")
    second = answered(with_first.mapInArrow(send_ties, LISTS), "second", n_ties, parts)

    def remove(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                texts = texts_of(batch, k)
                starts: dict[int, list] = {}
                found = block_ties(batch, k, texts) if batch.column("second")[k].is_valid else []
                if found:
                    order, same = ties_in_order(found)[2:]
                    repeated = np.empty(len(order), bool)
                    repeated[order] = marked(batch.column("second")[k].values)[np.cumsum(~same) - 1]
                    for text, at, names, _ in found:
                        yes, repeated = repeated[:len(names)], repeated[len(names):]
                        for i in np.unique(text[yes]):
                            starts.setdefault(int(i), []).append(at[yes & (text == i)])
                yield from _cut(batch.column("ids")[k].values, texts, starts, width)
        release()

    both = (blocks.join(first.hint("shuffle_hash"), "block", "left").join(second.hint("shuffle_hash"), "block", "left")
            .select("block", "ids", "texts", "first", "second"))
    return both.mapInArrow(remove, f"id {id_type}, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")


def _cut(ids, texts: list[bytes], starts: dict[int, list], width: int):
    """Output rows of a block: what is left of each text, and the removed runs."""
    kept, found = [], []
    for i, text in enumerate(texts):
        if i not in starts:
            kept.append(text)
            found.append([])
            continue
        mask = covered(np.concatenate(starts[i]), width, len(text))
        a, b = runs(mask)
        kept.append(np.frombuffer(text, np.uint8)[~mask].tobytes())
        found.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
    yield pa.record_batch([
        ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(kept, pa.binary()),
        pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
        names=["id", "n_bytes", "kept", "spans"])
