"""SimHash near-duplicates by anchor-point covering.

**Fingerprints.** A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, and every shingle of four words
(repeats included, joined by spaces; all words of a shorter text) votes with the bits of its XXH64 (seed 42). A bit
is set if over half the votes set it; a text without a word has fingerprint zero, which links like any other.

**Anchors.** The 64 bits are cut into blocks of 23, 23 and 18. The anchors of a block are the words of a covering
code: the perfect Golay code [23,12] (covering radius 3) twice, and the perfect Hamming code [15,11] with three free
bits (radius 1). Two fingerprints that differ in ``threshold`` bits differ in at most ``threshold // 3`` bits of some
block. There, one lies within the covering radius of its nearest anchor, its *home*, and the other within
the radius plus the block's threshold of that anchor. So every fingerprint is copied to its home and to every anchor
within radius plus threshold (about 5, 5 and 11 anchors for four bits), and each anchor compares its homes with
its visitors on all 64 bits. No pair is missed, whatever the data. One code over all 64 bits would need
thousands of copies of each fingerprint for four bits, so the blocks keep the copies few.

**Bounded work.** Equal fingerprints are one class, whatever its size. Rows of an anchor are counted first (the number
of anchors is fixed by the codes), and both sides of a crowded one are dealt to tiles of about ``tile`` rows,
each pair of tiles a group of its own. A group returns one edge for each member of a local component, not
its pairs. Components of the whole are found by label propagation on staged tables.

Defined results: null text counts as empty; texts are read in slices, so memory does not grow with a text's number of
words; ties do not occur (a half is not over half); repeated rows share a class; rows with a null id
get a component like others but never name one unless all ids in it are null; an empty table gives an empty
result. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.bytesops import mix
from textlab.llm.ngram_join import connected
from textlab.session import stage

WIDTH, SEED = 4, 42
SLICE = 1 << 20
TILE = 4096
#: Cells of the comparison matrix that are held at once.
CELLS = 1 << 21
HOT_SHARE = 1000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)
_PLACE = np.arange(8, dtype=np.int64) * 256


# ---- fingerprints --------------------------------------------------------------------------------

def shingle_digests(text: bytes, size: int = SLICE):
    """XXH64 digests (8 big-endian bytes each) of the shingles of a text, one slice of the text at a time."""
    digest, words, at, some = xxhash.xxh64_digest, [], 0, False
    while at < len(text):
        end = _SPACE.search(text, at + size)
        end = end.start() if end else len(text)
        words += text[at:end].translate(_LOWER).split()
        at = end
        if len(words) >= WIDTH:
            joined = b" ".join(words)
            starts = [0, *accumulate(len(w) + 1 for w in words)]
            yield b"".join([digest(joined[a:b - 1], SEED) for a, b in zip(starts, starts[WIDTH:])])
            words, some = words[1 - WIDTH:], True
    if words and not some:
        yield digest(b" ".join(words), SEED)


def fingerprint(text: bytes, size: int = SLICE) -> bytes:
    """The 64 bits as 8 big-endian bytes."""
    votes, n = np.zeros(2048, np.int64), 0
    for digests in shingle_digests(text, size):
        seen = np.frombuffer(digests, np.uint8).reshape(-1, 8)
        votes += np.bincount((seen + _PLACE).ravel(), minlength=2048)
        n += len(seen)
    return np.packbits(2 * (votes.reshape(8, 256) @ _BITS).ravel() > n).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the 64 bits as a long) of every row."""
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            made = b"".join([fingerprint(x.as_buffer().to_pybytes()) for x in batch.column(1)])
            yield pa.record_batch([batch.column(0), pa.array(np.frombuffer(made, ">i8").astype(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")) \
        .mapInArrow(run, f"id {id_type}, fp long")


# ---- codes ---------------------------------------------------------------------------------------

class Code:
    """A linear code on bits ``shift`` .. ``shift + length`` of a fingerprint, by its syndromes.

    ``checks`` holds the syndrome of each single bit (zero for a free bit), ``radius`` the covering radius.
    """

    def __init__(self, shift: int, checks: list[int], radius: int):
        self.shift, self.length, self.radius = np.uint64(shift), len(checks), radius
        self.mask = np.uint64((1 << self.length) - 1)
        self.checks = np.array(checks, np.int64)

    def patterns(self, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """All error patterns of at most ``reach`` bits, lightest first for each syndrome: (starts, patterns)."""
        found = layer = {0}
        for _ in range(reach):
            layer = {e | 1 << b for e in layer for b in range(self.length)} - found
            found = found | layer
        e = np.array(sorted(found, key=lambda x: (x.bit_count(), x)), np.int64)
        s = self.syndromes(e)
        order = np.argsort(s, kind="stable")
        return np.searchsorted(s[order], np.arange(int(np.bitwise_or.reduce(self.checks)) + 2)), e[order]

    def syndromes(self, part: np.ndarray) -> np.ndarray:
        out = np.zeros(len(part), np.int64)
        for b, check in enumerate(self.checks):
            out ^= ((part >> b) & 1) * check
        return out

    def anchors(self, fp: np.ndarray, reach: int, table: tuple[np.ndarray, np.ndarray]):
        """Anchors within ``reach`` of each fingerprint: (place of the fingerprint, anchor, is it the home)."""
        part = ((fp >> self.shift) & self.mask).astype(np.int64)
        starts, e = table
        s = self.syndromes(part)
        n = starts[s + 1] - starts[s]
        of = np.repeat(np.arange(len(fp)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        return of, part[of] ^ e[starts[s][of] + nth], nth == 0


def golay_checks() -> list[int]:
    """Remainders of x^b modulo the generator polynomial of the Golay code, b = 0..22."""
    generator = 0b110001110101  # fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
    out, r = [], 1
    for _ in range(23):
        out.append(r)
        r <<= 1
        if r >> 11:
            r ^= generator
    return out


def codes() -> list[Code]:
    return [Code(0, golay_checks(), 3), Code(23, golay_checks(), 3), Code(46, [*range(1, 16), 0, 0, 0], 1)]


class Covering:
    """Where fingerprints go: keys of anchors number the codes and their words in one range."""

    def __init__(self, threshold: int):
        self.codes = codes()
        self.near = threshold // len(self.codes)
        self.tables = [c.patterns(c.radius + self.near) for c in self.codes]
        self.first = [0, *accumulate(1 << c.length for c in self.codes)]

    def visits(self, fp: np.ndarray):
        """(place, key, home) of all visits of the fingerprints (unsigned)."""
        parts = [c.anchors(fp, c.radius + self.near, t) for c, t in zip(self.codes, self.tables)]
        return (np.concatenate([p[0] for p in parts]),
                np.concatenate([p[1] + k for p, k in zip(parts, self.first)]), np.concatenate([p[2] for p in parts]))


# ---- comparison ----------------------------------------------------------------------------------

def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of the pairs (a, b); labels are the smallest members, kept flat."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            flat = label[label]
            if (flat == label).all():
                break
            label[:] = flat


def linked(homes: np.ndarray, visitors: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that link in this group, and the local component of each (a number)."""
    nodes, where = np.unique(np.concatenate([homes, visitors]), return_inverse=True)
    h, v = where[:len(homes)], where[len(homes):]
    label, rows = np.arange(len(nodes)), max(1, CELLS // max(len(visitors), 1))
    for x in range(0, len(homes), rows):
        near = np.bitwise_count(homes[x:x + rows, None] ^ visitors[None, :]) <= threshold
        i, j = np.nonzero(near)
        unite(label, h[x + i], v[j])
    size = np.bincount(label, minlength=len(nodes))[label]
    return nodes[size > 1], label[size > 1]


def links(classes: DataFrame, threshold: int, tile: int) -> DataFrame:
    """(row, hub): fingerprints and the local components that hold them, of two or more members."""
    cover = Covering(threshold)

    def count(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            _, key, home = cover.visits(fp)
            some, at, n = np.unique(key, return_inverse=True, return_counts=True)
            yield pa.record_batch([pa.array(some), pa.array(np.bincount(at, home, len(some)).astype(np.int64)), pa.array(n)],
                                  names=["key", "homes", "visitors"])

    # one row for each anchor, and the codes fix their number: 2 * 2^12 + 2^14
    seen = (classes.select("fp").mapInArrow(count, "key long, homes long, visitors long").groupBy("key")
            .agg(F.sum("homes").alias("homes"), F.sum("visitors").alias("visitors"))
            .filter("homes > 0 and visitors > 1").toArrow())
    order = np.argsort(seen["key"].to_numpy())
    known, homes, visitors = (seen[c].to_numpy()[order] for c in ("key", "homes", "visitors"))
    tiles = np.stack([-(-homes // tile), -(-visitors // tile)]).astype(np.int64)
    shared = classes.sparkSession.sparkContext.broadcast((known, tiles))

    def deal(batches):
        known, tiles = shared.value
        for batch in batches:
            for x in range(0, batch.num_rows, 1 << 14):
                fp = batch.column(0).slice(x, 1 << 14).to_numpy().view(np.uint64)
                of, key, home = cover.visits(fp)
                at = np.searchsorted(known, key)
                ok = known[np.minimum(at, len(known) - 1)] == key if len(known) else np.zeros(len(key), bool)
                of, at, home = of[ok], at[ok], home[ok]
                spread = (mix(fp[of]) >> np.uint64(8)).astype(np.int64)
                for is_home in (False, True):  # a home row meets every tile of visitors, a visitor every tile of homes
                    mine, other = (tiles[0], tiles[1]) if is_home else (tiles[1], tiles[0])
                    k = np.flatnonzero(home) if is_home else np.arange(len(of))
                    n = other[at[k]]
                    again = np.repeat(k, n)
                    nth = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
                    own = spread[again] % mine[at[again]]
                    h, v = (own, nth) if is_home else (nth, own)
                    yield pa.record_batch([
                        pa.array(known[at[again]]), pa.array(h.astype(np.int32)), pa.array(v.astype(np.int32)),
                        pa.array(np.full(len(again), is_home)), pa.array(fp[of[again]].view(np.int64))],
                        names=["key", "h", "v", "home", "fp"])

    def compare(batches):
        hub = TaskContext.get().partitionId() << 40  # staged once: a number of its own for each local component
        for keys, home, fp in whole_groups(batches):
            cut = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True])))
            rows, hubs = [], []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                is_home = home[a:b]
                if b - a > 2 and is_home.any():
                    found, part = linked(fp[a:b][is_home], fp[a:b][~is_home], threshold)
                    if len(found):
                        rows.append(found)
                        hubs.append(part + hub)
                        hub += b - a
            if rows:
                yield pa.record_batch([pa.array(np.concatenate(rows).view(np.int64)), pa.array(np.concatenate(hubs))], names=["row", "hub"])

    group = ["key", "h", "v"]
    return (classes.select("fp").mapInArrow(deal, "key long, h int, v int, home boolean, fp long")
            .repartition(*group).sortWithinPartitions(*group).mapInArrow(compare, "row long, hub long"))


def whole_groups(batches):
    """Sorted batches cut where the group changes, so that no group is split: (keys, home, fp) arrays.

    What is carried over is the rows of one group, which tiles bound.
    """
    left = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if left is not None:
            table = pa.concat_tables([left, table])
        keys = np.stack([table[c].to_numpy().astype(np.int64) for c in ("key", "h", "v")], axis=1)
        if not len(keys):
            continue
        last = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys[0] != keys[-1]).any() else 0
        if last:
            yield _arrays(table.slice(0, last), keys[:last])
        left = table.slice(last).combine_chunks()
    if left is not None and left.num_rows:
        yield _arrays(left, np.stack([left[c].to_numpy().astype(np.int64) for c in ("key", "h", "v")], axis=1))


def _arrays(table: pa.Table, keys: np.ndarray):
    return keys, table["home"].to_numpy(), table["fp"].to_numpy().view(np.uint64)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 4, tile: int = TILE) -> DataFrame:
    """One row per input row: id, fp, component_id (the smallest id that its fingerprint reaches by links)."""
    prints = stage(fingerprints(docs, id_col, text_col), "simhash-prints")
    classes = stage(prints.groupBy("fp").agg(F.min("id").alias("class_id"), F.count("*").alias("weight")), "simhash-classes")
    labels = connected(links(classes, threshold, tile)).withColumnsRenamed({"row": "fp"})
    full = classes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    first = full.groupBy("label").agg(F.min("class_id").alias("component_id"))
    full = stage(full.join(first, "label").select("fp", "weight", "component_id"), "simhash-full")
    total = full.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    hot_at = max(1, total // HOT_SHARE)  # at most 1000 classes are larger
    looked = prints.join(F.broadcast(full.filter(F.col("weight") > hot_at)), "fp", "left")
    rest = looked.filter("weight is null").select("id", "fp").join(full.filter(F.col("weight") <= hot_at).drop("weight"), "fp")
    return looked.filter("weight is not null").select("id", "fp", "component_id").unionByName(rest.select("id", "fp", "component_id"))
