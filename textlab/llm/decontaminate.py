"""Benchmark decontamination: Aho-Corasick over normalised test items, in word numbers.

Words are runs of letters, digits and non-ASCII characters with A-Z lowered. Every window of 13
consecutive item words (an item of fewer words, but not none, is one window) is looked for. The benchmark's
words are numbered, a word is one symbol of the automaton, and each item is cut into blocks of 7 words,
end to end: a window of 13 words holds a whole block wherever it begins. The automaton thus holds every item word
once instead of 13 times. It scans a text once; at each block found, the up to 6 words on both sides are
compared with those around the block in the items (equal surroundings are kept once), and runs of 13 or more equal
words are hit. Word numbers are mapped to places in the original text.

The benchmark is a stated test set, not part of the corpus. It is read in parts of ``PART_BYTES``, which bounds the symbols an
automaton needs, and ``PASS_PARTS`` parts travel to the tasks as one broadcast; a worker builds their automata
once (about 25 bytes for each byte of benchmark) and keeps them for its later tasks. More parts than that take
further scans, with the hits so far staged between them, so that memory does not grow with the benchmark. Items
over ``PART_BYTES`` are cut into overlapping pieces. One scan is narrow: no shuffle, one Arrow batch in memory.

Defined results: null text and null items have no words; repeated items count once; items with a
null id mark words but are not counted or listed; an empty benchmark hits nothing; texts of any length are scanned
whole; a word in several windows is hit once. ``scan`` reads the id and text columns only, so other columns cannot clash;
``keep_clean`` returns all columns as they were.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.bytesops import TO_WORDS
from textlab.llm.common import fresh
from textlab.llm.pretoken import text_chunks
from textlab.session import stage

#: Distinct words of so many bytes fit the symbols: 27,060 words have 1 or 2 bytes, 1.03 million more take 4 with a space.
PART_BYTES = 4 << 20
PASS_PARTS = 4
#: Pairs of a place in a text and a place in the items that are compared at a time.
PAIRS = 1 << 18
NO_WORD = np.uint32(0xFFFFFFFF)
_known: dict[str, list["Matcher"]] = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


def symbol(number: int) -> str:
    """The character that stands for a word number; 0 and surrogates are left out."""
    return chr(number + 1 if number + 1 < 0xD800 else number + 0x801)


class Matcher:
    """The automaton of one part of the benchmark: (item id or None, words) pairs."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int):
        import ahocorasick
        self.block = (width + 1) // 2
        self.side = side = width - self.block
        self.width = width
        self.symbols: dict[bytes, str] = {}
        self.names: list[str] = []
        number: dict[str, int] = {}
        rows: dict[tuple[str, str], int] = {}  # (pattern, its surroundings or "") -> row
        row_of, item_of = array("q"), array("q")
        edge = "\0" * side  # no word of an item is symbol 0
        for name, words in items:
            for w in words:
                if w not in self.symbols:
                    self.symbols[w] = symbol(len(self.symbols))
            line = "".join([self.symbols[w] for w in words])
            if len(line) < width:
                found = [(line, "")] if line else []
            else:
                padded = edge + line + edge
                found = [(line[k:k + self.block], padded[k:k + self.block + 2 * side])
                         for k in range(0, len(line) - self.block + 1, self.block)]
            who = number.setdefault(name, len(number)) if name is not None else -1
            for key in found:
                row = rows.setdefault(key, len(rows))
                if who >= 0:
                    row_of.append(row)
                    item_of.append(who)
        self.names = list(number)
        # rows in the order of their patterns
        order = sorted(rows, key=lambda k: k[0])
        place = np.empty(len(rows), np.int64)
        place[[rows[k] for k in order]] = np.arange(len(order))
        self.size = np.array([len(p) for p, _ in order], np.int64)
        self.whole = np.array([not s for _, s in order], bool)
        blank = "\0" * (self.block + 2 * side)
        flat = "".join([s or blank for _, s in order]).encode("utf-32-le")
        self.around = np.frombuffer(flat, np.uint32).reshape(len(order), -1).copy()
        self.around[self.around == 0] = NO_WORD
        at = place[np.frombuffer(row_of, np.int64)] if row_of else np.empty(0, np.int64)
        by = np.argsort(at, kind="stable")
        self.items = np.frombuffer(item_of, np.int64)[by] if item_of else at
        self.item_from = np.searchsorted(at[by], np.arange(len(order) + 1))
        self.automaton = ahocorasick.Automaton()
        first = [k for k in range(len(order)) if not k or order[k][0] != order[k - 1][0]]
        for p, k in enumerate(first):
            self.automaton.add_word(order[k][0], p)
        self.begin = np.array([*first, len(order)], np.int64)
        if first:
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, set[str]]:
        """Starts and ends (word numbers) of the hit runs, and the ids of the items found."""
        none = np.empty(0, np.int64)
        if len(self.begin) == 1:
            return none, none, set()
        get = self.symbols.get
        line = "".join([get(w, "\0") for w in words])
        found = list(self.automaton.iter(line))
        if not found:
            return none, none, set()
        end, pattern = np.array(found, np.int64).T
        pad = np.zeros(self.side, np.uint32)
        text = np.concatenate((pad, np.frombuffer(line.encode("utf-32-le"), np.uint32), pad))
        many = self.begin[pattern + 1] - self.begin[pattern]
        upto = np.concatenate(([0], np.cumsum(many)))
        starts, stops, rows = [], [], []
        a = 0
        while a < len(end):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, "right")) - 1)
            n = many[a:b]
            row = np.arange(int(n.sum())) + np.repeat(self.begin[pattern[a:b]] - (upto[a:b] - upto[a]), n)
            start = np.repeat(end[a:b], n) + 1 - self.size[row]
            left, right = self._sides(text, start, row)
            ok = self.whole[row] | (left + right + self.block >= self.width)
            starts.append((start - left)[ok])
            stops.append((start + self.size[row] + right)[ok])
            rows.append(np.unique(row[ok]))
            a = b
        row = np.unique(np.concatenate(rows))
        who = {self.names[i] for r in row.tolist()
               for i in self.items[self.item_from[r]:self.item_from[r + 1]].tolist()}
        return np.concatenate(starts), np.concatenate(stops), who

    def _sides(self, text: np.ndarray, start: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words on the left and on the right of a block are equal (none for whole items)."""
        out = []
        for text_at, around_at, step in ((start + self.side - 1, self.side - 1, -1),
                                         (start + self.side + self.block, self.side + self.block, 1)):
            n = np.zeros(len(start), np.int64)
            live = np.flatnonzero(~self.whole[row])
            for k in range(self.side):
                live = live[text[text_at[live] + step * k] == self.around[row[live], around_at + step * k]]
                n[live] += 1
            out.append(n)
        return out[0], out[1]


def pieces(name: str | None, words: list[bytes], width: int) -> Iterator[tuple[int, tuple]]:
    """(bytes, (name, words)) of an item, cut where it passes ``PART_BYTES``, with ``width - 1`` words in common."""
    size, a = 0, 0
    for b, w in enumerate(words):
        if size + len(w) + 1 > PART_BYTES and b - a >= width:
            yield size, (name, words[a:b])
            a = b - width + 1
            size = sum(len(x) + 1 for x in words[a:b])
        size += len(w) + 1
    if words:
        yield size, (name, words[a:])


def passes(benchmark: DataFrame, item_col: str, item_text: str, width: int) -> Iterator[list[list[tuple]]]:
    """The benchmark in groups of at most ``PASS_PARTS`` parts; the driver holds one group at a time."""
    parts: list[list[tuple]] = [[]]
    filled = 0
    rows = benchmark.select(F.col(item_col).cast("string"), item_text).distinct()
    for name, text in rows.toLocalIterator():
        for size, piece in pieces(name, words_of(text), width):
            if filled and filled + size > PART_BYTES:
                if len(parts) == PASS_PARTS:
                    yield parts
                    parts = []
                parts.append([])
                filled = 0
            parts[-1].append(piece)
            filled += size
    yield parts


def matchers(key: str, parts: list[list[tuple]], width: int) -> list[Matcher]:
    """The automata of a group, built once per worker."""
    if key not in _known:
        _known.clear()
        _known[key] = [Matcher(p, width) for p in parts if p]
    return _known[key]


def hits(text: str | None, scanners: list[Matcher], before: list[int] | None = None) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, mask of words inside a window's occurrence, ids of the items found.

    ``before`` lists the edges of runs that are hit already.
    """
    words = words_of(text)
    step = np.zeros(len(words) + 1, np.int64)
    ids: set[str] = set()
    for start, stop, who in (m.hits(words) for m in scanners):
        np.add.at(step, start, 1)
        np.add.at(step, stop, -1)
        ids |= who
    if before:
        np.add.at(step, before[0::2], 1)
        np.add.at(step, before[1::2], -1)
    return len(words), np.cumsum(step[:-1]) > 0, ids


def edges(mask: np.ndarray) -> np.ndarray:
    """Start, end, start, end ... of the runs of a mask."""
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in the original text's UTF-8 bytes."""
    raw = np.frombuffer((text.encode() + b" ").translate(TO_WORDS), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (raw != 32).view(np.int8)))))
    return edge[0::2], edge[1::2]


def _scanned(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text: str, width: int,
             emit, schema) -> DataFrame:
    """``emit(batch, results)`` over all batches, with (text, n, mask, ids) of every row after the last pass.

    Passes before the last one add two columns, the runs hit and the items found so far, and are staged.
    """
    at, n_cols = docs.columns.index(text_col), len(docs.columns)
    runs_col, ids_col = fresh(docs, "_runs"), fresh(docs, "_items")
    sc = docs.sparkSession.sparkContext
    middle = T.StructType([*docs.schema.fields, T.StructField(runs_col, T.ArrayType(T.LongType())),
                           T.StructField(ids_col, T.ArrayType(T.StringType()))])

    def results(batch, scanners):
        had = batch.num_columns > n_cols
        row = 0
        for text in (t for _, _, texts in text_chunks(batch.column(at)) for t in texts):
            n, mask, ids = hits(text, scanners, batch.column(n_cols)[row].as_py() if had else None)
            if had:
                ids |= set(batch.column(n_cols + 1)[row].as_py())
            yield text, n, mask, ids
            row += 1

    def marked(batch, found):
        runs, ids = [], []
        for _, _, mask, who in found:
            runs.append(edges(mask).tolist())
            ids.append(sorted(who))
        yield pa.record_batch([*batch.columns[:n_cols], pa.array(runs, pa.list_(pa.int64())),
                               pa.array(ids, pa.list_(pa.string()))], names=middle.names)

    def one(df, parts, out, out_schema):
        packed, key = sc.broadcast(parts), uuid.uuid4().hex

        def run(batches):
            scanners = matchers(key, packed.value, width)
            for batch in batches:
                yield from out(batch, results(batch, scanners))
        return df.mapInArrow(run, out_schema)

    groups = passes(benchmark, item_col, item_text, width)
    parts, df = next(groups), docs
    for later in groups:
        df = stage(one(df, parts, marked, middle), "decontaminate")
        parts = later
    return one(df, parts, emit, schema)


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", width: int = 13) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted ids), spans of hit words (bytes)."""
    schema = (f"id {docs.select(id_col).schema[0].dataType.simpleString()}, n_words long, n_hit long, "
              "items array<string>, spans array<struct<start:long,end:long>>")

    def emit(batch, found):
        out = [], [], [], []
        for text, n, mask, ids in found:
            out[0].append(n)
            out[1].append(int(mask.sum()))
            out[2].append(sorted(ids))
            out[3].append(_spans(text, mask) if out[1][-1] else [])
        yield pa.record_batch([
            batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
            pa.array(out[2], pa.list_(pa.string())),
            pa.array(out[3], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["id", "n_words", "n_hit", "items", "spans"])

    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _scanned(two, "text", benchmark, item_col, item_text, width, emit, schema)


def _spans(text: str, mask: np.ndarray) -> list[dict]:
    """Places of the hit runs in the original text's bytes, from the first word's start."""
    start, stop = word_places(text)
    edge = edges(mask)
    return [{"start": int(start[a]), "end": int(stop[b - 1])} for a, b in zip(edge[0::2], edge[1::2])]


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text", width: int = 13) -> DataFrame:
    """The rows that are not contaminated (hit words under a twentieth of all, or none), unchanged."""
    schema = docs.schema

    def emit(batch, found):
        keep = []
        for _, n, mask, _ in found:
            k = int(mask.sum())
            keep.append(not (k and 20 * k >= n))
        batch = batch.select(list(range(len(schema))))
        yield batch.filter(pa.array(keep, pa.bool_()))

    return _scanned(docs, text_col, benchmark, item_col, item_text, width, emit, schema)
