"""Phrase collocation mining by best-first branch-and-bound growth over blocks of word numbers.

For each language, phrases of 2 to 4 words with a count ``a`` of ``least`` or more are candidates. A cut after the
first k words gives ``l`` and ``r``, the counts of both parts, and the score ``floor(2000000 a / (l + r))``; the
lowest cut counts. Candidates inside a longer candidate that is nearly as frequent (80 %) go; the best ``top`` by
(score, a, phrase) are returned.

**Blocks and buckets.** Texts become word numbers in *blocks* of one language, staged once. At each length, a block
sends its distinct phrases and their counts to *buckets* (a hash of the phrase); a bucket is one task, adds up the
counts, numbers the frequent phrases and answers every block that asked. Phrases of n words are told apart by (number of
their first n - 1 words, number of the last word), so nothing rests on hashes being distinct. Only a block that holds a
phrase ever needs its count, and has it.

**Growth.** A count never exceeds the counts of its parts, so with ``m`` the smaller count of the two parts that
overlap in all but one word, a phrase and all that begin with it score at most ``2000000 m / (m + f(first word))``,
and all that end with it at most ``2000000 m / (m + f(last word))``. The frontier is expanded best first in waves:
a wave settles, for each language, all phrases that can score ``bound`` or more. The first bound is the score of
the ``top``-th pair of words, the next ones of the pairs at four times that rank, then zero. Phrases of three and
four words are counted only if

* their own bound, or that of longer phrases that begin or end with them, reaches ``bound`` (growth), or
* they extend a phrase that scores ``bound`` or more and may be frequent enough to drop it (survival).

A language is settled when ``top`` phrases with a score of ``bound`` or more survive: all others score less, ties
included. Only languages that are not settled go into the next wave, which counts their longer phrases anew.

Dropping looks one word ahead only: if a phrase two words longer drops a candidate, the one between does so, too.

Memory: a block holds ``block_words`` words (longer texts go over several blocks; the last three words before a
block are repeated at its head as context and not counted again), a bucket about ``bucket_keys`` phrases. Counts must
stay under 2^52 and each length under 2^31 frequent phrases.

Defined results: null text counts as empty, a null language as ``und``; repeated rows count each time; ties are ordered
as above and are all settled before the cut at ``top``; languages without candidates give no row; an empty table
gives an empty result. Only the language and text columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.llm.bytesops import mix
from textlab.llm.common import bucketed, release
from textlab.session import stage

BLOCK_WORDS = 1_000_000
BUCKET_KEYS = 2_000_000
SLICE = 1 << 20
LONGEST = 4
#: Ranks of the pairs of words whose scores bound the waves grow by this factor.
WIDEN = 4

_TO = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c for c in range(256))
_CUT = re.compile(rb"[\x20\x09-\x0D.,;:!?]")
_LEFT = np.uint64(1 << 63)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def dice(a: np.ndarray, both: np.ndarray) -> np.ndarray:
    """floor(2000000 a / both), exact for a < 2^52 and 2 a <= both < 2^53: no step passes 63 bits."""
    x = a * 2000
    return x // both * 1000 + x % both * 1000 // both


def pack(x: np.ndarray) -> bytes:
    """Compressed 64-bit numbers, byte planes apart."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(raw: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).ravel()


# ---- blocks --------------------------------------------------------------------------------------

class Numbers(dict):
    """A number for each new word: 0 for the empty string between two spaces, 1 for the end of a piece."""

    def __init__(self):
        self[b""], self[b"\n"] = 0, 1

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Packer:
    """Word numbers of one language, until a block is full."""

    def __init__(self):
        self.numbers, self.parts, self.size, self.lead = Numbers(), [], 0, 0

    def add(self, text: bytes):
        tokens = text.translate(_TO).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens))
        ids = ids[ids > 0] - 1
        self.parts.append(ids)
        self.size += len(ids)

    def flush(self, block: int, lang: str, whole: bool):
        """The block as a row; unless the text is ``whole``, its last words begin the next block as context."""
        ids, words = np.concatenate(self.parts), list(self.numbers)[2:]
        # words in the order of their hashes: those of one bucket stand together, however many buckets there are
        order = np.argsort(word_hashes(words))
        place = np.zeros(len(words) + 1, np.int32)
        place[1 + order] = np.arange(1, len(words) + 1)
        ids, words = place[ids], [words[i] for i in order.tolist()]
        row = pa.record_batch([
            pa.array([block], pa.int64()), pa.array([lang]), pa.array([words], pa.list_(pa.binary())),
            pa.array([pack(ids.astype(np.int64))], pa.binary()), pa.array([self.lead], pa.int32()),
            pa.array([int((ids[self.lead:] > 0).sum())], pa.int64())],
            names=["block", "lang", "words", "ids", "lead", "n"])
        tail = [] if whole else ids[1 - LONGEST:].tolist()
        self.__init__()
        if tail:
            self.parts.append(np.array([self.numbers[words[i - 1]] - 1 if i else 0 for i in tail], np.int32))
            self.size = self.lead = len(tail)
        return row


def block_table(docs: DataFrame, lang_col: str, text_col: str, block_words: int, slice_bytes: int) -> tuple[DataFrame, int]:
    """Blocks, staged and bucketed by number: block, lang, words, ids, lead, n (words that count); number of buckets."""

    def run(batches):
        block, held = TaskContext.get().partitionId() << 32, {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw, at = text.as_buffer().to_pybytes(), 0
                while at < len(raw):
                    cut = _CUT.search(raw, at + slice_bytes)
                    end = cut.start() if cut else len(raw)
                    if lang not in held:
                        held[lang] = Packer()
                    held[lang].add(raw[at:end] + (b"\n" if end == len(raw) else b""))
                    at = end
                    # a full block goes, and the largest one if blocks of many languages wait
                    full = lang if held[lang].size >= block_words else None
                    if full is None and sum(p.size for p in held.values()) >= 4 * block_words:
                        full = max(held, key=lambda x: held[x].size)
                    if full is not None:
                        yield held[full].flush(block, full, whole=full != lang or end == len(raw))
                        block += 1
                        if not held[full].size:
                            del held[full]
        for lang, packer in held.items():
            yield packer.flush(block, lang, whole=True)
            block += 1
        release()

    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    packed = texts.mapInArrow(run, "block long, lang string, words array<binary>, ids binary, lead int, n long")
    parts = max(1, size // (3 * 6 * block_words))  # about three blocks each
    return bucketed(packed, "block", "phrase_blocks", spread=False, parts=parts), parts


# ---- buckets -------------------------------------------------------------------------------------

def summed(n_buckets: int, least: int, by_word: bool):
    """The work of a bucket: add up counts, number what is frequent, answer the blocks."""

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        got = pa.Table.from_batches(rows).combine_chunks()
        bucket = got["bucket"][0].as_py()
        assert pc.all(pc.equal(got["bucket"], bucket)).as_py(), "one bucket for each task"
        counts = [unpack(x.as_buffer()) for x in got["counts"]]
        sizes = np.array([len(x) for x in counts])
        if by_word:
            lists = got["words"].combine_chunks()
            lang = np.repeat(pc.dictionary_encode(got["lang"]).combine_chunks().indices.to_numpy(), sizes)
            word = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
            keys = lang.astype(np.int64) << 40 | word
        else:
            keys = np.concatenate([unpack(x.as_buffer(), np.uint64) for x in got["keys"]])
        some, first, at = np.unique(keys, return_index=True, return_inverse=True)
        # halves of the counts keep float sums exact
        n = np.concatenate(counts)
        total = np.bincount(at, n >> 26, len(some)).astype(np.int64) << 26
        total += np.bincount(at, n & (1 << 26) - 1, len(some)).astype(np.int64)
        often = total >= least
        number = np.where(often, (np.cumsum(often) - 1) * n_buckets + bucket + 1, 0)
        if len(number) and number.max() >= 1 << 31:
            raise ValueError("more than 2^31 frequent phrases of one length")
        total = np.where(often, total, 0)
        own = np.zeros(len(keys), bool)
        own[first[often]] = True
        cut = np.concatenate(([0], np.cumsum(sizes)))
        for i in range(got.num_rows):
            a, b = cut[i], cut[i + 1]
            yield pa.record_batch([
                got["block"].slice(i, 1).combine_chunks(), got["bucket"].slice(i, 1).combine_chunks(),
                pa.array([pack(number[at[a:b]])], pa.binary()), pa.array([pack(total[at[a:b]])], pa.binary()),
                pa.array([np.packbits(own[a:b]).tobytes()], pa.binary())],
                names=["block", "bucket", "number", "total", "own"])
        release()

    return run


def answered(sent: DataFrame, name: str, n_buckets: int, least: int, parts: int, by_word: bool = False) -> DataFrame:
    """(block, answers): one task for each bucket; answers gathered by block in bucket order, in a table bucketed like
    the blocks, so that they meet their block again and again without a shuffle."""
    got = sent.repartitionById(n_buckets, F.col("bucket")).mapInArrow(
        summed(n_buckets, least, by_word), "block long, bucket int, number binary, total binary, own binary")
    lists = got.repartition(parts, "block").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "number", "total", "own"))).alias(name))
    return bucketed(lists, "block", "phrase_answers", spread=False, parts=parts)


def buckets_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return in_range(mix(keys), n_buckets)


def in_range(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets are equal ranges of 64-bit hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)


def sent_lists(block: int, keys: np.ndarray, counts: np.ndarray, n_buckets: int):
    """Rows (bucket, block, keys, counts) of a block's sorted distinct keys."""
    if not len(keys):
        return None
    bucket = buckets_of(keys, n_buckets)
    order = np.argsort(bucket, kind="stable")
    b, keys, counts = bucket[order], keys[order], counts[order]
    cut = [*np.flatnonzero(np.diff(b, prepend=-1)).tolist(), len(b)]
    return pa.record_batch([
        pa.array(b[cut[:-1]].astype(np.int32)), pa.array([block] * (len(cut) - 1), pa.int64()),
        pa.array([pack(keys[x:y]) for x, y in zip(cut, cut[1:])], pa.binary()),
        pa.array([pack(counts[x:y]) for x, y in zip(cut, cut[1:])], pa.binary())],
        names=["bucket", "block", "keys", "counts"])


LISTS = "bucket int, block long, keys binary, counts binary"


def replies(bucket: np.ndarray, answers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, total, own) of a block's keys, from the answers in bucket order."""
    number, total, own = (np.zeros(len(bucket), kind) for kind in (np.int64, np.int64, bool))
    if len(bucket):
        order = np.argsort(bucket, kind="stable")
        parts = [unpack(x.as_buffer()) for x in answers.field("number")]
        number[order] = np.concatenate(parts)
        total[order] = np.concatenate([unpack(x.as_buffer()) for x in answers.field("total")])
        own[order] = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(p))
                                     for x, p in zip(answers.field("own"), parts)]).astype(bool)
    return number, total, own


# ---- phrases of a block --------------------------------------------------------------------------

class Length:
    """Phrases of one length in a block: their places, sorted distinct keys, and (once answered) numbers and counts
    at every place of the block; ``known`` marks the places that were counted."""

    def __init__(self, places: np.ndarray, keys: np.ndarray, counts: np.ndarray, n_places: int):
        self.places, self.n_places = places, n_places
        self.keys, self.first, self.at = np.unique(keys, return_index=True, return_inverse=True)
        self.counts = np.bincount(self.at, counts, len(self.keys)).astype(np.int64)

    def answer(self, answers, n_buckets: int):
        number, total, self.own = replies(buckets_of(self.keys, n_buckets), answers)
        self.number, self.total = np.zeros(self.n_places, np.int64), np.zeros(self.n_places, np.int64)
        self.known = np.zeros(self.n_places, bool)
        self.number[self.places], self.total[self.places], self.known[self.places] = number[self.at], total[self.at], True
        return self

    def owned(self) -> np.ndarray:
        """One place for each frequent phrase that this block speaks for."""
        return self.places[self.first[self.own]]


class Block:
    """Word numbers and counts at every place of a block; phrases of two, three and four words on demand."""

    def __init__(self, row: dict, n_buckets: int):
        self.row, self.n_buckets, self.bound = row, n_buckets, 0
        self.block, self.lang = row["block"].as_py(), row["lang"].as_py()
        self.ids, self.lead = unpack(row["ids"].as_buffer()), row["lead"].as_py()
        self.words = row["words"].values if "words" in row else None

    def with_words(self):
        answers = self.row["a1"].values  # words and answers stand in the order of the buckets
        for name in ("number", "total"):
            of_word = np.concatenate([[0], *(unpack(x.as_buffer()) for x in answers.field(name))])
            setattr(self, name, of_word[self.ids])
        return self

    def counted(self, places: np.ndarray, length: int) -> np.ndarray:
        """Phrases that end in the context at the head were counted before."""
        return places + length - 1 >= self.lead

    def answers(self, name: str):
        x = self.row[name]
        return x.values if x.is_valid else None

    def pairs(self) -> Length:
        p = np.flatnonzero((self.number[:-1] > 0) & (self.number[1:] > 0))
        key = (self.number[p] << 32 | self.number[p + 1]).view(np.uint64)
        return Length(p, key, self.counted(p, 2), len(self.ids))

    def with_pairs(self):
        self.two = self.pairs().answer(self.answers("a2"), self.n_buckets)
        return self

    def reach(self, m: np.ndarray, one: np.ndarray) -> np.ndarray:
        return dice(m, m + one) >= self.bound

    def drops(self, m: np.ndarray, a: np.ndarray, score: np.ndarray) -> np.ndarray:
        """May an extension with at most ``m`` occurrences drop a phrase (a, score) that matters?"""
        return (score >= self.bound) & (100 * m >= 80 * a)

    def triples(self) -> Length:
        two, f = self.two, self.total
        p = np.flatnonzero((two.number[:-1] > 0) & (two.number[1:] > 0))
        x, y = two.total[p], two.total[p + 1]
        m = np.minimum(x, y)
        want = self.reach(m, f[p]) | self.reach(m, f[p + 2])
        want |= self.drops(m, x, dice(x, f[p] + f[p + 1])) | self.drops(m, y, dice(y, f[p + 1] + f[p + 2]))
        p = p[want]
        return Length(p, (two.number[p] << 32 | self.number[p + 2]).view(np.uint64), self.counted(p, 3), len(self.ids))

    def with_triples(self):
        self.three = self.triples().answer(self.answers("a3"), self.n_buckets)
        return self

    def cuts3(self, p: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(self.total[p], self.two.total[p + 1]), (self.two.total[p], self.total[p + 2])]

    def cuts4(self, p: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(self.total[p], self.three.total[p + 1]), (self.two.total[p], self.two.total[p + 2]),
                (self.three.total[p], self.total[p + 3])]

    def score3(self, p: np.ndarray) -> np.ndarray:
        return lowest(self.three.total[p], self.cuts3(p))[0]

    def fours(self) -> Length:
        """By (number of the first three words, last word), or where these were not counted, by (number of the last
        three words, first word), which is needed to see whether the last three survive."""
        two, three = self.two, self.three
        n = len(self.ids)
        p = np.flatnonzero((two.number[:-2] > 0) & (two.number[1:-1] > 0) & (two.number[2:] > 0)) if n > 2 else np.empty(0, np.int64)
        p = p[(three.number[p] > 0) | ~three.known[p]]
        p = p[(three.number[p + 1] > 0) | ~three.known[p + 1]]
        left, right = three.known[p], three.known[p + 1]
        p, left, right = (x[left | right] for x in (p, left, right))
        x, y = three.total[p], three.total[p + 1]
        m = np.minimum(np.where(left, x, two.total[p]), np.where(right, y, two.total[p + 2]))
        want = np.zeros(len(p), bool)
        both = left & right
        want[both] = lowest(m[both], self.cuts4(p[both]))[0] >= self.bound
        for side, q, a in ((left, p, x), (right, p + 1, y)):
            want[side] |= self.drops(m[side], a[side], self.score3(q[side]))
        p, left = p[want], left[want]
        key = np.where(left, three.number[p] << 32 | self.number[p + 3], three.number[p + 1] << 32 | self.number[p]).view(np.uint64)
        key = np.where(left, key, key | _LEFT)
        return Length(p, key, self.counted(p, 4), n)

    def with_fours(self):
        self.four = self.fours().answer(self.answers("a4"), self.n_buckets)
        return self

    def candidates(self, length: int, part: Length, p: np.ndarray, cuts) -> pa.RecordBatch:
        """Rows of the phrases at the places ``p``."""
        a = part.total[p]
        score, k = lowest(a, cuts)
        l, r = (np.stack([c[side] for c in cuts])[k, np.arange(len(p))] for side in (0, 1))
        ok = score >= self.bound
        p, ids = p[ok], self.ids
        words = [self.words.take(pa.array(ids[p + i] - 1)) for i in range(length)]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary()))
        return rows(self.lang, length, part.number[p], a[ok], phrase, l[ok], r[ok], score[ok])

    def dropped(self, length: int, numbers: np.ndarray) -> pa.RecordBatch:
        numbers = np.unique(numbers)
        return rows(self.lang, length, numbers, *[None] * 5)


def lowest(a: np.ndarray, cuts) -> tuple[np.ndarray, np.ndarray]:
    """The lowest score of the cuts, and which cut it is (the first of equal ones)."""
    scores = np.stack([dice(a, l + r) for l, r in cuts])
    return scores.min(axis=0), scores.argmin(axis=0)


FOUND = "lang string, length int, number long, a long, phrase binary, l long, r long, score long"


def rows(lang, length, number, a, phrase, l, r, score) -> pa.RecordBatch:  # noqa: E741
    n = len(number)
    put = lambda x, kind: pa.nulls(n, kind) if x is None else pa.array(x, kind)
    return pa.record_batch([
        pa.array([lang] * n, pa.string()), pa.array(np.full(n, length, np.int32)), pa.array(number, pa.int64()),
        put(a, pa.int64()), pa.nulls(n, pa.binary()) if phrase is None else phrase.cast(pa.binary()),
        put(l, pa.int64()), put(r, pa.int64()), put(score, pa.int64())],
        names=["lang", "length", "number", "a", "phrase", "l", "r", "score"])


def survivors_of(block: Block):
    """What a block speaks for in a wave: candidates of three and four words, and marks (score null) on phrases that a
    longer one drops."""
    two, three, four = block.two, block.three, block.four
    p = three.owned()
    yield block.candidates(3, three, p, block.cuts3(p))
    a = three.total[p]
    yield block.dropped(2, np.concatenate([two.number[q][100 * a >= 80 * two.total[q]] for q in (p, p + 1)]))
    p = four.owned()
    both = p[three.known[p] & three.known[p + 1]]
    yield block.candidates(4, four, both, block.cuts4(both))
    a = four.total[p]
    yield block.dropped(3, np.concatenate([
        three.number[q][three.known[q] & (100 * a >= 80 * three.total[q])] for q in (p, p + 1)]))


def each(function):
    """A mapInArrow function that makes batches from each block row; batches without rows are left out."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                for out in function({c: batch.column(c)[k] for c in batch.schema.names}):
                    if out is not None and out.num_rows:
                        yield out
        release()

    return run


def top_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, top: int = 2000,
                block_words: int = BLOCK_WORDS, bucket_keys: int = BUCKET_KEYS, slice_bytes: int = SLICE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n (words of the language), score: the best phrases of each language."""
    blocks, parts = block_table(docs, lang_col, text_col, block_words, slice_bytes)
    total, distinct = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    n_words, n_keys = 1 + distinct // bucket_keys, 1 + total // (2 * bucket_keys)
    sizes = stage(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-sizes")

    def send_words(row):
        block = Block(row, n_keys)
        counts = np.bincount(block.ids[block.lead:], minlength=len(block.words) + 1)[1:]
        bucket = in_range(word_hashes(block.words.to_pylist()), n_words)
        cut = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
        n = len(cut) - 1
        yield pa.record_batch([
            pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array([block.block] * n, pa.int64()), pa.array([block.lang] * n),
            pa.ListArray.from_arrays(pa.array(cut, pa.int32()), block.words),
            pa.array([pack(counts[x:y]) for x, y in zip(cut, cut[1:])], pa.binary())],
            names=["bucket", "block", "lang", "words", "counts"])

    a1 = answered(blocks.mapInArrow(each(send_words), "bucket int, block long, lang string, words array<binary>, counts binary"),
                  "a1", n_words, least, parts, by_word=True)
    joined = blocks.join(a1, "block")

    def send_pairs(row):
        block = Block(row, n_keys).with_words()
        part = block.pairs()
        yield sent_lists(block.block, part.keys, part.counts, n_keys)

    a2 = answered(joined.drop("words").mapInArrow(each(send_pairs), LISTS), "a2", n_keys, least, parts)
    joined = joined.join(a2, "block")

    def pair_rows(row):
        block = Block(row, n_keys).with_words().with_pairs()
        p = block.two.owned()
        yield block.candidates(2, block.two, p, [(block.total[p], block.total[p + 1])])

    pairs = stage(joined.mapInArrow(each(pair_rows), FOUND), "phrase-pairs")
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    spark, rank, done = docs.sparkSession, top, []
    langs = [r.lang for r in sizes.select("lang").collect()]  # one row for each language
    while langs:
        # the score of the rank-th pair of each language, or zero: all that score as much are settled in this wave
        ranked = (pairs.filter(F.col("lang").isin(langs)).withColumn("k", F.row_number().over(by_score)).filter(F.col("k") <= rank)
                  .groupBy("lang").agg(F.min("score").alias("score"), F.count("*").alias("pairs")).collect())
        bound = dict.fromkeys(langs, 0) | {r.lang: r.score for r in ranked if r.pairs >= rank}
        found = stage(wave(joined, n_keys, least, parts, bound), "phrase-wave")
        limits = spark.createDataFrame(list(bound.items()), "lang string, bound long")
        candidates = (pairs.join(F.broadcast(limits), "lang").filter(F.col("score") >= F.col("bound")).drop("bound")
                      .unionByName(found.filter("score is not null")))
        marks = found.filter("score is null").select("length", "number").distinct()
        left = stage(candidates.join(marks, ["length", "number"], "left_anti"), "phrase-left")
        enough = {r.lang for r in left.groupBy("lang").count().filter(F.col("count") >= top).select("lang").collect()}
        settled = [x for x in langs if x in enough or bound[x] == 0]
        if settled:
            done.append(left.filter(F.col("lang").isin(settled)))
        langs = [x for x in langs if x not in settled]
        rank *= WIDEN
    kept = done[0] if done else pairs.limit(0)
    for more in done[1:]:
        kept = kept.unionByName(more)
    return (kept.withColumn("phrase", F.col("phrase").cast("string")).withColumn("rank", F.row_number().over(best).cast("long"))
            .filter(F.col("rank") <= top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def wave(joined: DataFrame, n_keys: int, least: int, parts: int, bound: dict[str, int]) -> DataFrame:
    """Count the phrases of three and four words that can matter above the bound of their language."""

    def opened(row):
        block = Block(row, n_keys).with_words().with_pairs()
        block.bound = bound[block.lang]
        return block

    def send_triples(row):
        block = opened(row)
        part = block.triples()
        yield sent_lists(block.block, part.keys, part.counts, n_keys)

    def send_fours(row):
        block = opened(row).with_triples()
        part = block.fours()
        yield sent_lists(block.block, part.keys, part.counts, n_keys)

    def found(row):
        yield from survivors_of(opened(row).with_triples().with_fours())

    joined = joined.filter(F.col("lang").isin(list(bound)))
    a3 = answered(joined.drop("words").mapInArrow(each(send_triples), LISTS), "a3", n_keys, least, parts)
    joined = joined.join(a3, "block")
    a4 = answered(joined.drop("words").mapInArrow(each(send_fours), LISTS), "a4", n_keys, least, parts)
    joined = joined.join(a4, "block", "left")
    return joined.mapInArrow(each(found), FOUND)
