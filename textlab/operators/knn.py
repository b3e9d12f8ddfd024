"""Exact vector search and all-pairs work: kNN by a two-level cell index (E3) and the exact silhouette (H5).

**kNN.** The pool is split into about sqrt(n) cells around sampled centres (no fewer than ``CELL_ROWS`` rows each on average),
and the centres again into groups, which makes a tree of two levels. Each cell and group has its exact radius: the largest
distance of any member to its centre, so ``t.c + |t| r`` bounds the similarity of a target to every member. A target
visits cells best bound first, groups before cells, in rounds: one cell, then four, sixteen and so on, and only while the
bound can reach its k-th similarity so far. When no target has a cell left to visit, the result is that of comparing
all rows. Cells are cut into tiles of about ``TILE_ROWS`` rows; a task holds one tile and lets targets pass by in batches, so
the pool is never copied, and a target goes to the tiles of the cells it visits only.

**Silhouette.** Vectors are dealt to tiles, and a task compares one tile with another, once for the points of both, keeping only per-cluster sums.

The driver holds the centres, at most ``session.BROADCAST_BYTES`` of them, and one number for each cell; never the pool.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType)

from textlab.functions.vector import as_double_array
from textlab.session import BROADCAST_BYTES, small, stage

TILE_ROWS = 16384
#: Rows of an average cell, at least: a cell fills a tile, so a target that must visit every cell is copied to no more
#: tiles than there are.
CELL_ROWS = 16384
# Largest targets x tile matrix one task builds at a time (float64 bytes).
MATMUL_BYTES = 16 << 20
#: Columns of which only the largest is looked at to bound the k-th value.
BLOCK = 64


def _matrix(vs) -> np.ndarray:
    return np.asarray(np.stack([np.asarray(v, dtype=np.float64) for v in vs]), dtype=np.float64)


def _unit(vs) -> np.ndarray:
    m = _matrix(vs)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _row_chunks(n: int, width: int) -> Iterator[slice]:
    step = max(1, MATMUL_BYTES // (8 * max(width, 1)))
    return (slice(i, i + step) for i in range(0, n, step))


def _top_k(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest finite values of each row; ties go to the lower column. The k-th largest of the
    maxima of blocks of columns is not above the k-th largest value, so only what reaches it is ordered."""
    kk, n = min(k, s.shape[1]), s.shape[1] // BLOCK * BLOCK
    least = s[:, :n].reshape(len(s), -1, BLOCK).max(axis=2) if n >= 4 * kk * BLOCK else s
    if least is not s and np.isnan(least).any():
        least = s
    kth = -np.partition(-least, kk - 1, axis=1)[:, kk - 1]
    r, c = np.nonzero(s >= kth[:, None])
    v = s[r, c]
    fine = np.isfinite(v)
    r, c, v = r[fine], c[fine], v[fine]
    order = np.lexsort((c, -v, r))
    r, c = r[order], c[order]
    rank = np.arange(len(r)) - np.searchsorted(r, np.arange(len(s)))[r]
    return r[rank < kk], c[rank < kk]


class Tree:
    """Cells around ``centres`` and groups of cells around some of the centres."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        self.tops = centres[:: max(1, math.isqrt(len(centres)))]
        self.parent = self._nearest(centres, self.tops)
        self.children = [np.flatnonzero(self.parent == g) for g in range(len(self.tops))]

    @staticmethod
    def _nearest(u: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return (2 * u @ centres.T - (centres ** 2).sum(axis=1)[None]).argmax(axis=1)

    def cells(self, u: np.ndarray) -> np.ndarray:
        """A cell for each vector: the nearest of its nearest group (one of a group without cells is never nearest)."""
        group = self._nearest(u, self.tops)
        out = np.zeros(len(u), np.int64)
        for g in np.unique(group):
            mine, cells = group == g, self.children[g]
            out[mine] = cells[self._nearest(u[mine], self.centres[cells])]
        return out

    def measured(self, size: np.ndarray, radius: np.ndarray) -> Tree:
        """With the number of members and the radius of each cell."""
        self.size, self.radius = size, radius
        reach = np.linalg.norm(self.centres - self.tops[self.parent], axis=1) + radius
        self.full = [c[size[c] > 0] for c in self.children]
        self.top_radius = np.array([reach[c].max() if len(c) else -np.inf for c in self.full])
        return self

    def best_first(self, u: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) of the cells with members, best bound first; a little is added for rounding."""
        norm = float(np.linalg.norm(u))
        heap = [(-float(b), g, -1) for g, b in enumerate(self.tops @ u + norm * np.where(np.isfinite(self.top_radius), self.top_radius, 0) + 1e-9)
                if len(self.full[g])]
        heapq.heapify(heap)
        while heap:
            bound, g, cell = heapq.heappop(heap)
            if cell >= 0:
                yield -bound, cell
                continue
            own = self.full[g]
            for c, b in zip(own.tolist(), (self.centres[own] @ u + norm * self.radius[own] + 1e-9).tolist()):
                heapq.heappush(heap, (-b, g, c))


def _lists(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _units(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a matrix of unit vectors (zero stays zero)."""
    return _unit(_lists(column)) if len(column) else np.empty((0, 0))


def _match(visits: DataFrame, pool: DataFrame, k: int, schema: StructType, extra: list[str], exclude_self: bool) -> DataFrame:
    """The k best pool rows of each target within every tile of the cells it visits."""
    keys = ["_cell", "_tile"]
    blank = lambda df, cols: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols]
    left = pool.select(*keys, F.lit(0).alias("_kind"), F.col("_pid").alias("_id"), F.col("_pu").alias("_u"), *extra)
    right = visits.select(*keys, F.lit(1).alias("_kind"), F.col("_tid").alias("_id"), F.col("_tu").alias("_u"), *blank(pool, extra))

    def run(batches):
        at, parts, tile = None, [], None
        for batch in batches:
            cell, number, kind = (batch.column(c).to_numpy() for c in (*keys, "_kind"))
            edge = np.ones(len(cell), bool)
            edge[1:] = (cell[1:] != cell[:-1]) | (number[1:] != number[:-1]) | (kind[1:] != kind[:-1])
            cut = [*np.flatnonzero(edge).tolist(), len(cell)]
            for a, b in zip(cut, cut[1:]):
                here, part = (cell[a], number[a]), batch.slice(a, b - a)
                if kind[a] == 0:
                    parts, at, tile = ([*parts, part] if here == at else [part]), here, None
                elif here == at:
                    if tile is None:  # columns in the order of the ids: ties go to the smaller one
                        rows = pa.Table.from_batches(parts).combine_chunks()
                        rows = rows.take(pc.sort_indices(rows["_id"]))
                        tile = rows, rows["_id"].to_numpy(), _units(rows["_u"].combine_chunks())
                    yield from compare(*tile, part)

    def compare(rows: pa.Table, ids: np.ndarray, u: np.ndarray, part: pa.RecordBatch):
        tids, tu = part.column("_id").to_numpy(), _units(part.column("_u"))
        for some in _row_chunks(len(tids), len(ids)):
            s = tu[some] @ u.T
            if exclude_self:
                s = np.where(tids[some][:, None] == ids[None, :], -np.inf, s)
            r, c = _top_k(s, k)
            yield pa.record_batch([pa.array(tids[some][r]), pa.array(ids[c]), pa.array(s[r, c]),
                                   *[rows[x].combine_chunks().take(pa.array(c)) for x in extra]], names=schema.fieldNames())

    return left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "_kind").mapInArrow(run, schema)


def knn(targets: DataFrame, pool: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding",
        pool_extra: list[str] | None = None, exclude_self: bool = True,
        tile_rows: int = TILE_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """For each target, the ``k`` most cosine-similar pool rows.

    Output ``(target_id, neighbor_id, sim, rank, *pool_extra)``; rank 1 is the
    most similar; ties are broken by the smaller neighbour id. With
    ``exclude_self`` a target never lists its own id. An empty pool or no targets give no rows.
    """
    extra = list(pool_extra or [])
    spark = targets.sparkSession
    types = {f.name: f.dataType for f in pool.schema.fields}
    schema = StructType([StructField("target_id", LongType()), StructField("neighbor_id", LongType()),
                         StructField("sim", DoubleType())] + [StructField(c, types[c]) for c in extra])
    # vectors travel as they are and are made unit vectors where they are compared; floats stay floats
    same = targets.schema[vec_col].dataType == pool.schema[vec_col].dataType == ArrayType(FloatType())
    unit = ArrayType(FloatType() if same else DoubleType())
    p = stage(pool.select(F.col(id_col).cast("long").alias("_pid"), F.col(vec_col).cast(unit).alias("_v"), *extra), "knn-pool")
    n, dims = p.agg(F.count(F.lit(1)), F.max(F.size("_v"))).first()
    if not n:
        return spark.createDataFrame([], StructType(list(schema.fields)).add("rank", IntegerType()))
    n_cells = max(1, min(math.isqrt(n), n // cell_rows, BROADCAST_BYTES // (8 * max(dims, 1))))
    picked = p.orderBy(F.xxhash64("_pid"), "_pid").select("_v").limit(n_cells).collect()
    tree = Tree(_unit([r["_v"] for r in picked]))

    def cells(it):
        for pdf in it:
            if len(pdf):
                u = _unit(pdf["_v"])
                pdf["_cell"] = tree.cells(u)
                pdf["_far"] = np.linalg.norm(u - tree.centres[pdf["_cell"]], axis=1)
                yield pdf.rename(columns={"_v": "_pu"})

    fields = [StructField("_pu", unit) if f.name == "_v" else f for f in p.schema.fields]
    p = stage(p.mapInPandas(cells, StructType(fields + [StructField("_cell", LongType()), StructField("_far", DoubleType())])), "knn-cells")
    size, radius = np.zeros(n_cells, np.int64), np.zeros(n_cells)
    for r in p.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_far").alias("r")).collect():  # one row a cell
        size[r["_cell"]], radius[r["_cell"]] = r["n"], r["r"]
    shared = spark.sparkContext.broadcast(tree.measured(size, radius))
    counts = small(p.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("_tiles")), 16)
    p = stage(p.drop("_far").join(counts, "_cell").withColumn("_tile", F.pmod(F.xxhash64("_pid"), F.col("_tiles"))).drop("_tiles"), "knn-tiles")

    t = stage(targets.select(F.col(id_col).cast("long").alias("_tid"), F.col(vec_col).cast(unit).alias("_tu")), "knn-targets")

    def next_cells(done: int, width: int):
        def run(batches):
            tree = shared.value
            for batch in batches:
                kth = batch.column("_kth").fill_null(-np.inf).to_numpy()
                at, found = [], []
                for i, u in enumerate(_units(batch.column("_tu"))):
                    for rank, (bound, cell) in enumerate(tree.best_first(u)):
                        if rank >= done + width or bound < kth[i]:
                            break
                        if rank >= done:
                            at.append(i)
                            found.append(cell)
                take = pa.array(at, pa.int64())
                yield pa.record_batch([batch.column("_tid").take(take), batch.column("_tu").take(take), pa.array(found, pa.int64())],
                                      names=["_tid", "_tu", "_cell"])
        return run

    w = Window.partitionBy("target_id").orderBy(F.desc("sim"), F.asc("neighbor_id"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
    best, done, width = None, 0, 1
    while done < n_cells:
        kth = t.withColumn("_kth", F.lit(None).cast("double"))
        if best is not None:
            last = best.where(F.col("rank") == k).select(F.col("target_id").alias("_tid"), F.col("sim").alias("_kth"))
            kth = t.join(last.groupBy("_tid").agg(F.min("_kth").alias("_kth")), "_tid", "left")
        visits = stage(kth.mapInArrow(next_cells(done, width), StructType([*t.schema.fields, StructField("_cell", LongType())])), "knn-visits")
        if best is not None and visits.isEmpty():
            break
        visits = visits.join(counts, "_cell").withColumn("_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)))
        found = _match(visits, p, k, schema, extra, exclude_self)
        if n_cells == 1:
            return ranked(found)
        best = stage(ranked(found if best is None else found.unionByName(best.drop("rank"))), "knn-best")
        done, width = done + width, 4 * width
    return best


def silhouette(df: DataFrame, cluster_col: str = "cluster", id_col: str = "id",
               vec_col: str = "embedding", tile_rows: int = TILE_ROWS) -> DataFrame:
    """H5 (exact): mean silhouette with Euclidean distances over all pairs.

    Every point gets, per cluster, the sum of its distances to that
    cluster's points, tile by tile (points x k x tiles partial sums,
    never points x points rows). ``a`` = own-cluster mean over n - 1 others,
    ``b`` = smallest mean to another cluster, ``s = (b - a) / max(a, b)``;
    a point alone in its cluster scores 0. Returns one row
    ``(silhouette, n_points, n_clusters)``; no points give (null, 0, 0).
    """
    schema = StructType([StructField("_id", LongType()), StructField("_own", LongType()),
                         StructField("_c", LongType()), StructField("_sum", DoubleType())])
    x = stage(df.select(F.col(id_col).cast("long").alias("_id"), F.col(cluster_col).cast("long").alias("_own"),
                        F.col(vec_col).alias("_v")), "silhouette")
    tiles = max(1, math.ceil(x.count() / tile_rows))
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)).cast("array<long>"))
    mine = F.pmod(F.xxhash64("_id"), F.lit(tiles))
    # a pair of tiles is compared once, for the points of both
    left = x.withColumn("_i", mine).withColumn("_j", every).where("_i <= _j")
    right = x.withColumn("_j", mine).withColumn("_i", every).where("_i <= _j")

    def run(key, t: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(t) or not len(p):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        # points in the order of their clusters, which makes a cluster a range
        t, p = t.sort_values("_own", kind="stable"), p.sort_values("_own", kind="stable")
        (tc, ta), (pc, pa_) = (np.unique(y["_own"].to_numpy(dtype=np.int64), return_index=True) for y in (t, p))
        tm, pm = _matrix(t["_v"]), _matrix(p["_v"])
        tsq, psq = (tm * tm).sum(axis=1), (pm * pm).sum(axis=1)
        rows_of, cols_of = np.empty((len(t), len(pc))), np.zeros((len(tc), len(p)))
        both = key[0] != key[1]
        for rows in _row_chunks(len(t), len(p)):
            dist = tm[rows] @ (-2.0 * pm.T)
            dist += tsq[rows][:, None]
            dist += psq
            np.sqrt(np.maximum(dist, 0.0, out=dist), out=dist)
            rows_of[rows] = np.add.reduceat(dist, pa_, axis=1)
            if both:
                first = rows.start
                for j, at in enumerate(ta):
                    end = ta[j + 1] if j + 1 < len(ta) else len(t)
                    if at < first + len(dist) and end > first:
                        cols_of[j] += dist[max(at - first, 0):max(end - first, 0)].sum(axis=0)
        sides = [(t, pc, rows_of)] + ([(p, tc, cols_of.T)] if both else [])
        return pd.concat([pd.DataFrame({
            "_id": np.repeat(y["_id"].to_numpy(), len(c)), "_own": np.repeat(y["_own"].to_numpy(), len(c)),
            "_c": np.tile(c, len(y)), "_sum": found.ravel()}) for y, c, found in sides])

    sums = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInPandas(run, schema)
    sums = sums.groupBy("_id", "_own", "_c").agg(F.sum("_sum").alias("_sum"))
    sizes = x.groupBy(F.col("_own").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    per = sums.join(sizes, "_c").groupBy("_id", "_own").agg(
        F.max(F.when(F.col("_c") == F.col("_own"), F.col("_n"))).alias("n_own"),
        F.max(F.when(F.col("_c") == F.col("_own"), F.col("_sum"))).alias("s_own"),
        F.min(F.when(F.col("_c") != F.col("_own"), F.col("_sum") / F.col("_n"))).alias("b"))
    a = F.col("s_own") / F.nullif(F.col("n_own") - 1, F.lit(0))
    s = (F.when((F.col("n_own") <= 1) | F.col("b").isNull(), F.lit(0.0))
         .when(F.greatest(a, F.col("b")) == 0, F.lit(0.0))
         .otherwise((F.col("b") - a) / F.greatest(a, F.col("b"))))
    return per.agg(F.round(F.avg(s), 6).alias("silhouette"),
                   F.count(F.lit(1)).alias("n_points"),
                   F.countDistinct("_own").alias("n_clusters"))


def silhouette_closed(df: DataFrame, cluster_col: str = "cluster", vec_col: str = "embedding",
                      at_once: int = BROADCAST_BYTES) -> DataFrame:
    """H5 (linear time): the mean silhouette with *squared* Euclidean distances, in closed form.

    With n, the sum S and the sum of squares Q of a cluster, a point's distances to it add up to
    ``n |x|^2 - 2 x.S + Q``, so one pass sums the clusters and one scores the points. A different number from the exact
    one with plain distances, so it has its own name. A point alone in its cluster scores 0; rows without a cluster
    take no part. One row ``(silhouette, n_points, n_clusters)``. Sums are taken around the mean of all points, which keeps
    the differences exact for data far from zero. The sums of about ``at_once`` bytes of clusters travel to the points in
    one pass; more clusters take more passes.
    """
    x = stage(df.select(F.monotonically_increasing_id().alias("_i"), F.col(cluster_col).alias("_own"), as_double_array(vec_col).alias("_v"))
              .where("_own is not null"), "silhouette")
    each = x.select("_own", F.posexplode("_v").alias("_d", "_x"))
    sums = each.groupBy("_own", "_d").agg(F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_x")).alias("_q"))
    n_of = x.groupBy("_own").agg(F.count(F.lit(1)).alias("_n"))
    n = x.agg(F.count(F.lit(1))).scalar()
    middle = sums.groupBy("_d").agg((F.sum("_s") / n).alias("_m"))
    # around the middle m: the sum of (x - m) is S - n m, the sum of squares Q - 2 m S + n m^2
    s, q, m, size = (F.col(c) for c in ("_s", "_q", "_m", "_n"))
    clusters = stage(sums.join(middle, "_d").join(n_of, "_own").groupBy("_own", "_n").agg(
        F.sort_array(F.collect_list(F.struct("_d", (s - size * m).alias("s"), m.alias("m")))).alias("a"),
        F.sum(q - 2 * m * s + size * m * m).alias("q")).select(
        F.col("_own").alias("c"), F.col("_n").alias("n"), "q", F.col("a.s").alias("s"), F.col("a.m").alias("m")), "silhouette-sums")
    k, dims = clusters.agg(F.count(F.lit(1)), F.max(F.size("s"))).first()
    passes = max(1, -(-k * (16 * (dims or 0) + 64) // at_once))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, p: acc + p)
    seen = None
    for i in range(passes):
        some = clusters.where(F.pmod(F.xxhash64("c"), F.lit(passes)) == i).agg(F.collect_list(F.struct("c", "n", "q", "s", "m"))).scalar()
        near = x.select("_i", "_own", "_v", F.explode(some).alias("c")).select(
            "_i", "_own", "c", F.zip_with("_v", "c.m", lambda a, b: a - b).alias("_y"))
        total = F.col("c.n") * dot("_y", "_y") - 2 * dot("_y", F.col("c.s")) + F.col("c.q")
        near = near.select("_i", (F.col("_own") == F.col("c.c")).alias("_in"), F.col("c.n").alias("_n"), F.greatest(total, F.lit(0.0)).alias("_sum"))
        seen = near if seen is None else seen.unionByName(near)
    per = seen.groupBy("_i").agg(
        F.max(F.when(F.col("_in"), F.col("_n"))).alias("_n"), F.max(F.when(F.col("_in"), F.col("_sum"))).alias("_s"),
        F.min(F.when(~F.col("_in"), F.col("_sum") / F.col("_n"))).alias("_b"))
    a, b = F.col("_s") / F.nullif(F.col("_n") - 1, F.lit(0)), F.col("_b")
    score = F.when((F.col("_n") <= 1) | b.isNull() | (F.greatest(a, b) == 0), F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    return per.agg(F.round(F.avg(score), 6).alias("silhouette"), F.count(F.lit(1)).alias("n_points"), F.lit(k).cast("long").alias("n_clusters"))


def silhouette_squared(df: DataFrame, cluster_col: str = "cluster", vec_col: str = "embedding") -> float:
    """H5 (linear time): Spark ML's silhouette with *squared* Euclidean
    distance. A different number from the exact one; reported under its own
    name."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector
    v = df.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"),
                  F.col(cluster_col).cast("double").alias("prediction"))
    return ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(v)
