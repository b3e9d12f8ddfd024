"""Hard negatives by an inverted multi-index, visited best cell first and stopped on certified windows.

Vectors become integers (each component ``floor(256 x)``, x as double); a score is the integer inner product. For each
anchor, its *positives* are the best ``n_positives`` other rows of its label, and each positive's *window* holds the
rows of other labels with ``50 p <= 100 s <= 95 p`` (p the positive's score, s the row's). The best ``n_negatives``
rows of each window are returned. Higher scores come first, ties by smaller id.

**Index.** Both halves of a vector have a codebook of their own (k-means on at most ``SAMPLE`` rows); a row's two codes
are its cell, and every row is in one. The radius of a code is the largest distance of any row to its centroid, so
no row of cell (i, j) scores more than ``a1.c_i + |a1| r_i + a2.c_j + |a2| r_j``. The number of cells follows the
number of rows.

**Visits.** A heap over the two sorted lists of half bounds (multi-sequence) gives an anchor's cells in the order of
their bounds. Work goes in rounds: an anchor visits its next cells, at most ``first`` of them in the first round and
four times as many in each later one, and only while their bound can reach what it still looks for: the score of its
last positive, or in the second phase the last score kept in some window that is not yet certified. When no anchor
has a cell left to visit, every window is certified, and the result is that of comparing all rows.

**Work.** Rows stand on shelves by their first code; a shelf is cut into tiles of about ``tile`` rows, and an anchor
goes to a shelf's tiles once a round with the list of its cells there. A task holds one tile at a time and lets the
anchors pass by in batches, comparing each with its cells' rows. A tile returns a few rows for each anchor. If vectors
do not cluster, the bounds prune little and the work tends to anchors times rows.

Defined results: rows with a null id or label, a null vector, or a null or non-finite component take no part; shorter
vectors are filled up with zeros (an empty one scores zero); repeated rows are rows of their own, ordered by where
they stand after score and id; all of a label's other rows are positives if there are fewer; an empty table gives an
empty result; other columns are not read. Components so large that a score could pass 2^50 are an error.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.llm.common import hash_sample
from textlab.session import stage

#: Rows that train the codebooks, at most; a code stands for eight of them or more.
SAMPLE = 1 << 16
#: Rows of an average cell.
CELL_ROWS = 64
TILE = 1024
STEPS = 8
#: Rows of anchors that are compared at once.
CHUNK = 512
#: No score may pass this, and no tile may hold as many rows as ``PLACES`` (they are dealt by hash, a quarter of it on
#: average): composite keys of score and place stay under 63 bits.
MOST = 1 << 50
PLACES = 1 << 12


def vectors(table: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """row, id, label, vec (integers): the rows that take part, staged so that row numbers stay."""
    odd = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull() & ~odd
    return stage(table.filter(ok).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * 256)).alias("vec")), "negatives-rows")


def matrix(vec, dims: int) -> np.ndarray:
    """A list column as a matrix of exact doubles, filled up with zeros."""
    out = np.zeros((len(vec), dims))
    flat, n = vec.flatten().to_numpy(zero_copy_only=False), vec.value_lengths().to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(vec)), n)
    out[of, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids of the sample: a few Lloyd steps from rows evenly spaced in the order given."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].astype(float)
    for _ in range(STEPS):
        code = nearest(x, centres)[0]
        n = np.bincount(code, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, code, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the distance to it."""
    code, rows = np.zeros(len(x), np.int64), max(1, (1 << 20) // max(len(centres), 1))
    half = (centres ** 2).sum(axis=1) / 2
    for a in range(0, len(x), rows):
        code[a:a + rows] = (half - x[a:a + rows] @ centres.T).argmin(axis=1)
    return code, np.sqrt(((x - centres[code]) ** 2).sum(axis=1))


class Index:
    """Codebooks and radii of the two halves: what the tasks need to find an anchor's next cells."""

    def __init__(self, centres, radii, dims: int):
        self.centres, self.radii, self.dims, self.cut = centres, radii, dims, (dims + 1) // 2

    def halves(self, x: np.ndarray):
        return x[:, :self.cut], x[:, self.cut:]

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """Upper bounds of the half scores: an array (rows, codes) for each half. Codes without rows have -inf; a little is
        added for rounding."""
        out = []
        for part, centres, radii in zip(self.halves(x), self.centres, self.radii):
            some = radii > -np.inf
            s = np.full((len(x), len(radii)), -np.inf)
            s[:, some] = part @ centres[some].T + np.sqrt((part ** 2).sum(axis=1))[:, None] * radii[some]
            s[:, some] += 1e-6 + 1e-9 * np.abs(s[:, some])
            out.append(s)
        return out


def best_first(one: np.ndarray, two: np.ndarray):
    """(bound, i, j) of all cells by descending sum of the half bounds: the multi-sequence heap."""
    a, b = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
    x, y = one[a].tolist(), two[b].tolist()
    i_of, j_of = a.tolist(), b.tolist()
    heap, n, m = [(-(x[0] + y[0]), 0, 0)], len(x), len(y)
    while heap:
        s, p, q = heapq.heappop(heap)
        if s == float("inf"):
            return
        yield -s, i_of[p], j_of[q]
        # (p, q + 1) follows (p, q); (p + 1, 0) follows (p, 0): each cell enters the heap once
        if q + 1 < m:
            heapq.heappush(heap, (-(x[p] + y[q + 1]), p, q + 1))
        if q == 0 and p + 1 < n:
            heapq.heappush(heap, (-(x[p + 1] + y[0]), p + 1, 0))


def built(rows: DataFrame, cell_rows: int) -> tuple[Index, DataFrame, int]:
    """The index, its rows with their codes (staged), and the number of rows."""
    n, dims, most = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", lambda x: F.abs(x))))).first()
    dims = max(dims or 0, 2)
    if dims * (most or 0) ** 2 >= MOST:
        raise ValueError(f"components up to {most} in {dims} dimensions: a score could pass 2^50")
    sample = hash_sample(rows.select("row", "id", "vec"), [F.col("id")], SAMPLE).toArrow()
    order = np.lexsort((sample["row"].to_numpy(), sample["id"].to_numpy()))
    x = matrix(sample["vec"].combine_chunks(), dims)[order]
    k = max(1, min(int(np.ceil(np.sqrt(n / cell_rows))), len(x) // 8))
    cut = (dims + 1) // 2
    centres = [codebook(part, k) if len(part) else np.zeros((1, part.shape[1])) for part in (x[:, :cut], x[:, cut:])]

    def assign(batches):
        for batch in batches:
            x = matrix(batch.column("vec"), dims)
            (i, d), (j, e) = (nearest(part, c) for part, c in zip((x[:, :cut], x[:, cut:]), centres))
            yield pa.record_batch([*batch.columns, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(d), pa.array(e)],
                                  names=[*batch.schema.names, "i", "j", "d", "e"])

    coded = stage(rows.mapInArrow(assign, "row long, id long, label long, vec array<long>, i int, j int, d double, e double"), "negatives-index")
    # one row for each code
    radii = []
    for code, far in (("i", "d"), ("j", "e")):
        r = np.full(len(centres[0]), -np.inf)
        for row in coded.groupBy(code).agg(F.max(far).alias("far")).collect():
            r[row[code]] = row.far
        radii.append(r)
    return Index(centres, radii, dims), coded.drop("d", "e"), n


def look(index: Index, coded: DataFrame, anchors: DataFrame, goals: DataFrame, keep: int, positives: bool, first: int, tile: int) -> DataFrame:
    """anchor, slot, score, id, row: the best ``keep`` rows of each goal (anchor, slot, lo, hi).

    A goal wants rows with lo <= score <= hi, of the anchor's own label (``positives``) or of other labels.
    """
    spark = coded.sparkSession
    shelves = F.broadcast(stage(coded.groupBy("i").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "negatives-shelves"))
    blank = [F.lit(None).cast(kind).alias(name) for name, kind in (("js", "array<int>"), ("goals", "array<struct<slot:int,lo:long,hi:long>>"))]
    shelved = stage(coded.join(shelves, "i").select(
        "i", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int").alias("t"), F.lit(0).alias("kind"), "row", "id", "label", "vec", "j", *blank),
        "negatives-shelved")
    shared = spark.sparkContext.broadcast(index)

    def frontier(done: int, width: int):
        def run(batches):
            index = shared.value
            for batch in batches:
                x = matrix(batch.column("vec"), index.dims)
                bounds = index.bounds(x)
                at, shelf, cells = [], [], []
                for k, least in enumerate(batch.column("least").to_pylist()):
                    mine: dict[int, list] = {}
                    for n, (bound, i, j) in enumerate(best_first(bounds[0][k], bounds[1][k])):
                        if n >= done + width or least is not None and bound < least:
                            break
                        if n >= done:
                            mine.setdefault(i, []).append(j)
                    at += [k] * len(mine)
                    shelf += mine
                    cells += mine.values()
                take = pa.array(at, pa.int64())
                yield pa.record_batch([
                    pa.array(shelf, pa.int32()), pa.array(cells, pa.list_(pa.int32())),
                    *[batch.column(c).take(take) for c in ("row", "id", "label", "vec", "goals")]],
                    names=["i", "js", "row", "id", "label", "vec", "goals"])
        return run

    def compare(batches):
        here = Tile(shared.value.dims)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("i", "t", "kind")], axis=1)
            cut = [*np.flatnonzero((np.diff(key, axis=0, prepend=key[:1] - 1) != 0).any(axis=1)).tolist(), len(key)]
            for a, b in zip(cut, cut[1:]):
                part = batch.slice(a, b - a)
                if key[a][2] == 0:
                    here.add(tuple(key[a][:2]), part)
                elif here.of == tuple(key[a][:2]):
                    for c in range(0, b - a, CHUNK):
                        yield here.best(part.slice(c, CHUNK), keep, positives)

    best, done, width = None, 0, first
    by = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    while True:
        # a goal that has all it wants needs cells that can beat its last score; another one all that can reach lo
        if best is None:
            open_goals = goals.withColumn("need", F.col("lo"))
        else:
            last = best.groupBy("anchor", "slot").agg(F.min("score").alias("last"), F.count("*").alias("n"))
            open_goals = goals.join(last, ["anchor", "slot"], "left").withColumn(
                "need", F.when(F.col("n") >= keep, F.greatest("last", F.col("lo"))).otherwise(F.col("lo")))
        wanted = open_goals.groupBy("anchor").agg(
            F.min(F.coalesce("need", F.lit(-2 * MOST))).alias("least"), F.sort_array(F.collect_list(F.struct("slot", "lo", "hi"))).alias("goals"))
        # a goal's number of slots is fixed, and an anchor is one row: nothing here is a group of unknown size
        visits = stage(anchors.join(wanted, anchors["row"] == wanted["anchor"]).select("row", "id", "label", "vec", "goals", "least")
                       .mapInArrow(frontier(done, width), "i int, js array<int>, row long, id long, label long, vec array<long>, "
                                   "goals array<struct<slot:int,lo:long,hi:long>>"), "negatives-visits")
        if visits.isEmpty():
            return best
        passing = visits.join(shelves, "i").select(
            "i", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"), F.lit(1).alias("kind"), "row", "id", "label", "vec",
            F.lit(None).cast("int").alias("j"), "js", "goals")
        seen = (shelved.unionByName(passing).repartition("i", "t").sortWithinPartitions("i", "t", "kind")
                .mapInArrow(compare, "anchor long, slot int, score long, id long, row long"))
        if best is not None:
            seen = seen.unionByName(best)
        best = stage(seen.withColumn("k", F.row_number().over(by)).filter(F.col("k") <= keep).drop("k"), "negatives-best")
        done, width = done + width, 4 * width


class Tile:
    """The rows of one tile, in the order of their ids, and the comparison of passing anchors with them."""

    def __init__(self, dims: int):
        self.dims, self.of, self.parts, self.ready = dims, None, [], False

    def add(self, key, part: pa.RecordBatch):
        if key != self.of:
            self.of, self.parts = key, []
        self.parts.append(part)
        self.ready = False

    def open(self):
        table = pa.Table.from_batches(self.parts).combine_chunks()
        order = np.lexsort((table["row"].to_numpy(), table["id"].to_numpy()))
        self.row, self.id, self.label, self.j = (table[c].to_numpy()[order] for c in ("row", "id", "label", "j"))
        self.x = matrix(table["vec"].combine_chunks(), self.dims)[order]
        assert len(order) < PLACES, "a tile is too large"
        self.cells = {int(j): np.flatnonzero(self.j == j) for j in np.unique(self.j)}
        self.ready = True

    def best(self, part: pa.RecordBatch, keep: int, positives: bool) -> pa.RecordBatch:
        if not self.ready:
            self.open()
        n, size = part.num_rows, len(self.row)
        row, label = (part.column(c).to_numpy() for c in ("row", "label"))
        x, js = matrix(part.column("vec"), self.dims), part.column("js")
        of = np.repeat(np.arange(n), js.value_lengths().to_numpy())
        j = js.flatten().to_numpy()
        none = -(1 << 62)
        key = np.full((n, size), none, np.int64)
        for cell, places in self.cells.items():
            who = of[j == cell]
            if len(who):  # exact: whole numbers under 2^50
                key[np.ix_(who, places)] = x[who] @ self.x[places].T
        same = label[:, None] == self.label[None, :]
        key[same != positives] = none
        key[row[:, None] == self.row[None, :]] = none
        goals = part.column("goals")
        flat, many = goals.flatten(), goals.value_lengths().to_numpy()
        anchor = np.repeat(np.arange(n), many)
        slot = flat.field("slot").to_numpy()
        low, high = (flat.field(c).fill_null(d).to_numpy() for c, d in (("lo", none + 1), ("hi", -none)))
        place = size - 1 - np.arange(size)  # of equal scores the smaller id (then row) has the larger key
        out = []
        for a in range(0, len(anchor), CHUNK):
            g = slice(a, a + CHUNK)
            s = key[anchor[g]]
            fit = (s >= low[g, None]) & (s <= high[g, None]) & (s > none)
            s = np.where(fit, s * PLACES + place, none)
            top = np.argpartition(-s, min(keep, size) - 1, axis=1)[:, :keep]
            who, nth = np.nonzero(np.take_along_axis(s, top, axis=1) > none)
            out.append((who + a, top[who, nth]))
        goal, at = (np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in (0, 1))
        return pa.record_batch([pa.array(v) for v in (row[anchor[goal]], slot[goal], key[anchor[goal], at], self.id[at], self.row[at])],
                               names=["anchor", "slot", "score", "id", "row"])


def hard_negatives(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
                   anchor: Column | None = None, n_positives: int = 5, n_negatives: int = 3, tile: int = TILE,
                   cell_rows: int = CELL_ROWS, first: int = 64) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``label`` is the label's column expression (``label``), ``anchor`` the condition that makes a row an anchor (all rows).
    """
    rows = vectors(table, id_col, vector_col, F.col("label") if label is None else label)
    index, coded, n = built(rows, cell_rows)
    anchors = stage(coded.filter(F.lit(True) if anchor is None else anchor).select("row", "id", "label", "vec"), "negatives-anchors")
    nothing = F.lit(None).cast("long")
    any_score = anchors.select(F.col("row").alias("anchor"), F.lit(0).alias("slot"), nothing.alias("lo"), nothing.alias("hi"))
    empty = "anchor long, slot int, score long, id long, row long"
    found = look(index, coded, anchors, any_score, n_positives, True, first, tile)
    if found is None:
        found = table.sparkSession.createDataFrame([], empty)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    positives = stage(found.select("anchor", F.row_number().over(order).alias("slot"), F.col("score").alias("positive_score"),
                                   F.col("id").alias("positive_id")), "negatives-positives")
    p = F.col("positive_score")
    # 50 p <= 100 s <= 95 p in whole numbers; nothing fits below zero
    windows = positives.filter(p >= 0).select("anchor", "slot", F.expr("(positive_score + 1) div 2").alias("lo"),
                                              F.expr("positive_score * 95 div 100").alias("hi")).filter("lo <= hi")
    got = look(index, coded, anchors, stage(windows, "negatives-windows"), n_negatives, False, first, tile)
    if got is None:
        got = table.sparkSession.createDataFrame([], empty)
    rank = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    return (got.withColumn("rank", F.row_number().over(rank)).withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).drop("row")
            .join(positives, ["anchor", "slot"]).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
