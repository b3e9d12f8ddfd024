"""Clustering and projection: seeded k-means (H2), positive-cluster resolution
(H3), cluster labels (H4), PCA (H6), prototype clusters (H7)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from textlab.functions.vector import as_double_array
from textlab.operators.logistic import stacked, task_sums
from textlab.session import stage


@dataclass
class KMeansResult:
    """Assignments (input columns + ``cluster`` + ``sqdist``) and the model."""
    assignments: DataFrame
    centroids: list[list[float]]
    n_iter: int
    shifts: list[float]

    def inertia(self) -> float:
        return float(self.assignments.agg(F.sum("sqdist")).first()[0] or 0.0)


def _nearest(x: np.ndarray, cents: np.ndarray):
    """Nearest centroid by squared Euclidean distance, lowest id on ties."""
    d = np.empty((x.shape[0], cents.shape[0]))
    for j in range(cents.shape[0]):
        diff = x - cents[j]
        d[:, j] = (diff * diff).sum(axis=1)
    lab = d.argmin(axis=1)
    return lab, d[np.arange(len(lab)), lab]


#: A vector table is dealt to tasks of about this many rows.
TASK_ROWS = 8192
#: Bytes of rows near a border that the driver takes over, and their largest share of all rows.
BORDER_BYTES, BORDER_SHARE = 32 << 20, 1 / 8
#: The margins of rows are counted in this many bins, eight an octave; bin ``_ONE`` begins at 1.
_BINS, _ONE = 512, 400

_SUMS = "c long, n long, moved long, s array<double>"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of vectors of ``dim`` components as a matrix (null components are NaN)."""
    if column.null_count or not pc.all(pc.equal(pc.list_value_length(column), dim)).as_py():
        raise ValueError(f"a vector is null or has not {dim} components")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def _margin(x: np.ndarray, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid, and by how much the second nearest one is farther."""
    d = np.empty((len(x), len(cents)))
    for j in range(len(cents)):
        diff = x - cents[j]
        d[:, j] = (diff * diff).sum(axis=1)
    lab, near = d.argmin(axis=1), np.sqrt(np.partition(d, min(1, len(cents) - 1), axis=1)[:, :2])
    return lab, near[:, 1] - near[:, 0] if len(cents) > 1 else np.full(len(x), np.inf)


class _Sums:
    """Count, rows that changed and vector sum of each cluster; and how many rows have which margin."""

    def __init__(self, k: int, dim: int):
        self.n, self.moved, self.s = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dim))
        self.margins = np.zeros(_BINS)

    def add(self, x: np.ndarray, lab: np.ndarray, changed: np.ndarray, margin: np.ndarray | None = None):
        for j in range(len(self.n)):
            m = lab == j
            self.n[j] += int(m.sum())
            self.moved[j] += int(changed[m].sum())
            self.s[j] += x[m].sum(axis=0)
        if margin is not None:
            m = np.log2(margin, out=np.full(len(margin), -np.inf), where=margin > 0)  # not a number: the first bin
            self.margins += np.bincount(np.clip(np.floor(8 * m) + _ONE, 0, _BINS - 1).astype(np.int64), minlength=_BINS)

    def columns(self) -> list[pa.Array]:
        keep, k = np.nonzero(self.n > 0)[0], len(self.n)
        return [pa.array([*keep, k], pa.int64()), pa.array([*self.n[keep], 0], pa.int64()), pa.array([*self.moved[keep], 0], pa.int64()),
                pa.array([*self.s[keep].tolist(), self.margins.tolist()], pa.list_(pa.float64()))]

    def collected(self, part: DataFrame) -> _Sums:
        """With the tasks' rows, one for each cluster and task of about ``TASK_ROWS`` rows or more: one stage, no
        shuffle, as there are many steps. Only sums and bins reach the driver."""
        got = part.select("c", "n", "moved", "s").toArrow()
        for c, n, moved, v in zip(*(got[x].to_pylist() for x in ("c", "n", "moved")), got["s"]):
            if c == len(self.n):
                self.margins += v.values.to_numpy()
            else:
                self.n[c] += n
                self.moved[c] += moved
                self.s[c] += v.values.to_numpy()
        return self

    def slack(self, rows: float) -> float:
        """A margin that no more than about ``rows`` rows have or go below."""
        return float(2.0 ** ((np.searchsorted(np.cumsum(self.margins), rows, "right") - _ONE) / 8))


def _changed(x: np.ndarray, lab: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    return np.ones(len(lab), bool) if before is None else _nearest(x, before)[0] != lab


def _lloyd_step(rows: DataFrame, vec_col: str, dim: int, cents: np.ndarray | None,
                before: np.ndarray | None = None, label_col: str | None = None, k: int = 0) -> _Sums:
    """One assign pass over ``rows``: the sums of the clusters, and how many rows changed theirs since the centroids
    ``before``. With ``cents=None`` rows are grouped by ``label_col`` (0..k-1) instead (the seed means)."""
    k = len(cents) if cents is not None else k

    def run(batches):
        sums = _Sums(k, dim)
        for batch in batches:
            x, margin = _matrix(batch.column(0), dim), None
            if cents is None:
                lab = batch.column(1).to_numpy().astype(np.int64)
            else:
                lab, margin = _margin(x, cents)
            sums.add(x, lab, _changed(x, lab, before), margin)
        yield pa.record_batch(sums.columns(), names=["c", "n", "moved", "s"])

    return _Sums(k, dim).collected(rows.select(vec_col, *([label_col] if cents is None else [])).mapInArrow(run, _SUMS))


def _near_border(base: DataFrame, vec_col: str, dim: int, cents: np.ndarray, before: np.ndarray, slack: float) -> DataFrame:
    """One pass over all rows, staged: the rows whose cluster may change while the centroids move by ``slack`` (the two
    that move most, together), in ``v``, and each task's sums of the others (``v`` null). A centroid that moves by m
    changes a distance by m at most; a little is added for rounding."""
    def run(batches):
        sums = _Sums(len(cents), dim)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            lab, margin = _margin(x, cents)
            sure = margin > slack * (1 + 1e-9) + 1e-9  # not a number: not sure
            sums.add(x[sure], lab[sure], _changed(x[sure], lab[sure], before))
            v = x[~sure]
            if len(v):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dim), pa.int32()), pa.array(v.ravel()))
                yield pa.record_batch([*(pa.nulls(len(v), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()))), lists],
                                      names=["c", "n", "moved", "s", "v"])
        own = sums.columns()
        yield pa.record_batch([*own, pa.nulls(len(own[0]), pa.list_(pa.float64()))], names=["c", "n", "moved", "s", "v"])

    return stage(base.select(vec_col).mapInArrow(run, _SUMS + ", v array<double>"), "kmeans-border")


def assign_clusters(df: DataFrame, vec_col: str, centroids: list[list[float]]) -> DataFrame:
    """Add ``cluster`` (int) and ``sqdist`` with the same NumPy arithmetic as
    the Lloyd steps (so the final labels match the last update exactly)."""
    cents = np.asarray(centroids, dtype=np.float64)
    schema = StructType(list(df.schema.fields)).add("cluster", IntegerType()).add("sqdist", DoubleType())

    def run(batches):
        for batch in batches:
            lab, dist = _nearest(_matrix(batch.column(vec_col), cents.shape[1]), cents)
            yield pa.record_batch([*batch.columns, pa.array(lab, pa.int32()), pa.array(dist)], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def seeded_kmeans(df: DataFrame, vec_col: str = "embedding", seed_col: str | None = "seed",
                  init_centroids: list[list[float]] | None = None, k: int = 2,
                  max_iter: int | None = None) -> KMeansResult:
    """H2: Lloyd's k-means with given initial centroids, run until no row changes its cluster.

    Initial centroid ``j`` is the mean of the rows whose ``seed_col == j``
    (e.g. 0 = positive source, 1 = the rest), or ``init_centroids``.
    An iteration is one Spark job: per Arrow batch a NumPy nearest-centroid
    (squared Euclidean, lowest id on ties), compared with the assignment before, and
    per-task sums. More rows take more iterations, in which few
    rows near a border still change. Once the last shift is small enough, one pass picks
    the rows whose cluster can change while the centroids move by ``slack`` (``BORDER_BYTES``,
    ``BORDER_SHARE`` of all rows, at most), and sums the others, which keep theirs; the
    iterations read these few rows on the driver until the centroids have moved by more.
    This gives what reading all rows gives. Else the
    driver holds only sums; lineage does not grow with the iterations. An
    empty cluster keeps its previous centroid. Assignments are written once and
    read from there. ``max_iter`` is a caller's own bound; there is none by default
    (the within-cluster sum falls with every step, so the loop ends).
    """
    base = stage(df, "kmeans-input")
    n, dim = base.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vec_col)), F.lit(0))).first()
    if n >= 2 * TASK_ROWS:
        base = stage(base.repartition(n // TASK_ROWS), "kmeans-dealt")
    if init_centroids is None:
        seeded = base.where(F.col(seed_col).isNotNull() & (F.col(seed_col) >= 0) & (F.col(seed_col) < k))
        got = _lloyd_step(seeded, vec_col, dim, None, None, seed_col, k)
        missing = [j for j in range(k) if not got.n[j]]
        if missing:
            raise ValueError(f"seed groups {missing} are empty")
        cents = got.s / got.n[:, None]
    else:
        cents = np.array(init_centroids, dtype=np.float64)
        k = len(cents)
    before: np.ndarray | None = None
    shifts: list[float] = []
    few = min(BORDER_BYTES / (8 * max(dim, 1)), n * BORDER_SHARE)
    slack, at, held, rest = 0.0, cents, None, None
    while max_iter is None or len(shifts) < max_iter:
        rested = 0
        if held is not None and not np.sort(np.sqrt(((cents - at) ** 2).sum(axis=1)))[-2:].sum() <= slack:
            held = None
        if held is None and n >= TASK_ROWS and shifts and slack >= 3 * shifts[-1]:
            border = _near_border(base, vec_col, dim, cents, before, slack)
            rest = _Sums(k, dim).collected(border.where("v is null"))
            if n - rest.n.sum() <= 2 * few:
                held = border.where("v is not null").select("v").toArrow()["v"].combine_chunks()
                held, at, rested = _matrix(held, dim), cents, rest.moved.sum()
        if held is None:
            got = _lloyd_step(base, vec_col, dim, cents, before)
            slack = got.slack(few)
        else:
            got, lab = _Sums(k, dim), _nearest(held, cents)[0]
            got.add(held, lab, _changed(held, lab, before))
            got.n, got.s = got.n + rest.n, got.s + rest.s
        new = np.where(got.n[:, None] > 0, got.s / np.maximum(got.n, 1)[:, None], cents)
        shifts.append(float(np.sqrt(((new - cents) ** 2).sum(axis=1)).max()))
        before, cents = cents, new
        if not got.moved.sum() + rested:
            break
    assigned = stage(assign_clusters(base, vec_col, cents.tolist()), "kmeans-assigned")
    return KMeansResult(assigned, cents.tolist(), len(shifts), shifts)


def resolve_positive_cluster(df: DataFrame, cluster_col: str = "cluster",
                             positive_col: str = "original_label") -> DataFrame:
    """H3: one row ``positive_cluster``: 0 when cluster 0 holds strictly more
    positive-source rows than cluster 1, else 1."""
    c = df.agg(
        F.count_if((F.col(cluster_col) == 0) & (F.col(positive_col) == 1)).alias("p0"),
        F.count_if((F.col(cluster_col) == 1) & (F.col(positive_col) == 1)).alias("p1"),
    )
    return c.select(F.when(F.col("p0") > F.col("p1"), 0).otherwise(1).cast("int")
                    .alias("positive_cluster"))


def cluster_labels(df: DataFrame, cluster_col: str = "cluster",
                   positive_col: str = "original_label") -> DataFrame:
    """H4: ``label = (cluster == positive_cluster)``; the one-row H3 result is
    broadcast."""
    pc = resolve_positive_cluster(df, cluster_col, positive_col).scalar()  # scalar subquery
    return (df.withColumn("positive_cluster", pc)
            .withColumn("label", (F.col(cluster_col) == F.col("positive_cluster")).cast("int")))


@dataclass
class PcaModel:
    """A centred PCA fitted once (H6); ``project`` applies it to any frame."""
    mean: np.ndarray
    components: np.ndarray
    explained_variance: list[float]
    vec_col: str = "embedding"

    def project(self, df: DataFrame, out_col: str = "pca") -> DataFrame:
        """``df`` with its coordinates; null for a null vector."""
        mean, axes = self.mean, self.components

        @F.pandas_udf("array<double>")
        def coordinates(vectors: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
            have = vectors.notna()
            if have.any():
                out[have] = pd.Series(((stacked(vectors[have]) - mean) @ axes).tolist(), index=vectors.index[have])
            return out

        return df.withColumn(out_col, coordinates(F.col(self.vec_col)))


def fit_pca(df: DataFrame, vec_col: str = "embedding", k: int = 2) -> PcaModel:
    """H6: centred PCA from sums: the mean, then the covariance of centred rows, both added up by task in Spark; the d x d
    matrix is decomposed on the driver. Signs are fixed so the largest-magnitude loading of each component is
    positive. Rows with a null vector take no part; no rows are an error. Fit once, then project every frame with the model."""
    rows = stage(df.select(as_double_array(vec_col).alias("v")).dropna(), "pca-input")
    n, dim = rows.agg(F.count("v"), F.max(F.size("v"))).first()
    if not n:
        raise ValueError("no vectors to fit a PCA on")
    mean = task_sums(rows, dim, lambda pdf: stacked(pdf["v"]).sum(axis=0)) / n
    upper = np.triu_indices(dim)

    def products(pdf):
        x = stacked(pdf["v"]) - mean
        return (x.T @ x)[upper]

    cov = np.zeros((dim, dim))
    cov[upper] = task_sums(rows, len(upper[0]), products) / max(n - 1, 1)
    values, axes = np.linalg.eigh(cov + np.triu(cov, 1).T)
    values, axes = np.maximum(values[::-1], 0.0), axes[:, ::-1][:, :k]
    lead = axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]
    share = values / values.sum() if values.sum() > 0 else values
    return PcaModel(mean, axes * np.where(lead < 0, -1.0, 1.0), share[:k].tolist(), vec_col)


def pca(df: DataFrame, vec_col: str = "embedding", k: int = 2, out_col: str = "pca"):
    """H6 convenience: fit on ``df`` and project it. Returns (projected
    DataFrame, explained variance list)."""
    m = fit_pca(df, vec_col, k)
    return m.project(df, out_col), m.explained_variance


def prototype_clusters(df: DataFrame, vec_col: str | None = "embedding", k: int = 4,
                       dims: int = 50, seed: int = 42, len_col: str = "n_chars",
                       label_col: str = "label", id_col: str = "id") -> DataFrame:
    """H7: centred PCA to <= ``dims`` then k-means, from Spark ML's k-means|| centres until no row changes
    its cluster (``seeded_kmeans``); without vectors fall back to ``2 * (len > median) + label``; without
    either, a hash bucket."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if vec_col and vec_col in df.columns:
        first = df.select(F.size(vec_col)).first()
        if first is None:
            return df.withColumn("cluster", F.lit(0))
        p = fit_pca(df, vec_col, min(dims, first[0])).project(df, "_proj")
        start = KMeans(k=k, seed=seed, maxIter=0, featuresCol="_v").fit(
            p.select(array_to_vector("_proj").alias("_v")))  # the initial centres only
        centres = [c.tolist() for c in start.clusterCenters()]
        return seeded_kmeans(p, "_proj", init_centroids=centres).assignments.drop("_proj", "sqdist")
    if len_col in df.columns and label_col in df.columns:
        from textlab.operators.vectors import median_flag
        return (median_flag(df, len_col, "_long")
                .withColumn("cluster", (2 * F.col("_long") + F.col(label_col)).cast("int"))
                .drop("_long"))
    from textlab.functions.hashing import hash_bucket
    return df.withColumn("cluster", hash_bucket(id_col, k, seed, "cluster"))
