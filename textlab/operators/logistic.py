"""Elastic-net logistic regression on sums that Spark adds up (H9, H10), and the sums themselves (H6 uses them too).

Each step is one job over the staged rows for all parameter sets together. A task adds up the loss, the gradient and
the curvature of its rows; Spark adds the tasks' sums by position; the driver holds d^2 numbers a set, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.session import stage


def task_sums(df: DataFrame, size: int, add: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``add(batch)``, a vector of ``size`` numbers: one partial vector a task, added up in
    Spark by position."""
    def run(it):
        total = np.zeros(size)
        for pdf in it:
            if len(pdf):
                total += add(pdf)
        yield pd.DataFrame({"s": [total.tolist()]})

    rows = (df.mapInPandas(run, "s array<double>").select(F.posexplode("s").alias("pos", "v"))
            .groupBy("pos").agg(F.sum("v").alias("v")).collect())
    out = np.zeros(size)
    for r in rows:
        out[r["pos"]] = r["v"]
    return out


def stacked(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


@dataclass
class LogisticModel:
    """P(label = 1) = 1 / (1 + exp(-(coefficients . vector + intercept)))."""
    coefficients: np.ndarray
    intercept: float
    steps: int

    def transform(self, df: DataFrame, vec_col: str = "embedding", out_col: str = "prob") -> DataFrame:
        """``df`` with the probability; null for a null vector."""
        return probabilities(df, [self], vec_col, "_p").withColumn(out_col, F.col("_p")[0]).drop("_p")


def probabilities(df: DataFrame, models: Sequence[LogisticModel], vec_col: str, out_col: str) -> DataFrame:
    """``df`` with an array of every model's probability, in one pass (null for a null vector)."""
    b = np.array([m.coefficients for m in models]).T
    b0 = np.array([m.intercept for m in models])

    @F.pandas_udf("array<double>")
    def score(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
        have = vectors.notna()
        if have.any():
            z = stacked(vectors[have]) @ b + b0
            out[have] = pd.Series((0.5 * (1 + np.tanh(z / 2))).tolist(), index=vectors.index[have])
        return out

    return df.withColumn(out_col, score(F.col(vec_col)))


def _scales(rows: DataFrame, dim: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of weights, weighted mean and weighted unbiased standard deviation of each dimension (two passes)."""
    def first(pdf):
        w = pdf["w"].to_numpy()
        return np.concatenate(([w.sum(), (w * w).sum()], w @ stacked(pdf["v"])))

    s = task_sums(rows, dim + 2, first)
    total, mean = s[0], s[2:] / s[0]
    squares = task_sums(rows, dim, lambda pdf: pdf["w"].to_numpy() @ (stacked(pdf["v"]) - mean) ** 2)
    rest = total - s[1] / total
    std = np.sqrt(squares / rest) if rest > 0 else np.zeros(dim)
    return total, mean, np.where(std > 1e-12 * np.abs(mean), std, 0.0)  # below: rounding of the mean


def _move(g: np.ndarray, h: np.ndarray, b: np.ndarray, ridge: float, lasso: float) -> np.ndarray:
    """Where the quadratic model of the loss around ``b`` plus the penalty is least. The last entry, the intercept, is
    not penalised. Coordinate descent if there is an absolute-value part, else a linear system."""
    d = len(b)
    free = np.full(d, ridge)
    free[-1] = 0.0
    if lasso == 0:
        return b - np.linalg.lstsq(h + np.diag(free), g + free * b, rcond=1e-13)[0]
    new, pull = b.copy(), g.copy()  # pull: the gradient of the quadratic model at ``new``
    for _ in range(10_000):
        largest = 0.0
        for j in range(d):
            a = h[j, j] + free[j]
            if a <= 0:
                continue
            c = h[j, j] * new[j] - pull[j]
            to = c / a if j == d - 1 else np.sign(c) * max(abs(c) - lasso, 0.0) / a
            if to != new[j]:
                pull += h[:, j] * (to - new[j])
                largest = max(largest, abs(to - new[j]))
                new[j] = to
        if largest < 1e-13:
            break
    return new


def fit_logistic(df: DataFrame, params: Sequence[tuple[float, float]], label_col: str = "label", vec_col: str = "embedding",
                 weight_col: str | None = None, max_steps: int = 100, tol: float = 1e-12) -> list[LogisticModel]:
    """One model for each (regParam, elasticNetParam), by proximal Newton steps that all sets take together.

    Least is: weighted mean log loss + reg * (l1 * sum |b| + (1 - l1) / 2 * sum b^2) over coefficients of standardised
    dimensions, the intercept left out: the objective that Spark ML's LogisticRegression states. A set ends when a
    step would lower it by less than ``tol``; a step that raises it is halved. Without a penalty, separable data has no
    least value: the loss tends to zero and the set ends the same way. Constant dimensions get 0. Rows with a null
    label, vector or weight take no part. The curvature is d^2 numbers a set and task: for vectors of up to about a
    thousand dimensions.
    """
    rows = stage(df.select(F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("double").alias("y"),
                           (F.col(weight_col) if weight_col else F.lit(1.0)).cast("double").alias("w")).dropna(), "logistic-input")
    dim = int(rows.select(F.max(F.size("v"))).first()[0] or 0)
    if not dim:
        raise ValueError("no labelled vectors")
    total, mean, std = _scales(rows, dim)
    inverse = np.where(std > 0, 1 / np.where(std > 0, std, 1), 0.0)
    d = dim + 1
    upper = np.triu_indices(d)
    size = 1 + d + len(upper[0])

    def penalty(p, b):
        reg, l1 = params[p]
        return reg * (l1 * np.abs(b[:-1]).sum() + (1 - l1) / 2 * (b[:-1] ** 2).sum())

    def sums(at: dict[int, np.ndarray]) -> dict[int, tuple]:
        """(objective, gradient, curvature) of each set at its coefficients, in one job."""
        sets = list(at)

        def add(pdf):
            x = np.hstack([(stacked(pdf["v"]) - mean) * inverse, np.ones((len(pdf), 1))])
            y, w = pdf["y"].to_numpy(), pdf["w"].to_numpy()
            out = []
            for p in sets:
                z = x @ at[p]
                prob = 0.5 * (1 + np.tanh(z / 2))
                loss = w @ (np.logaddexp(0, z) - y * z)
                curve = (x * (w * prob * (1 - prob))[:, None]).T @ x
                out += [[loss], (w * (prob - y)) @ x, curve[upper]]
            return np.concatenate(out)

        got = task_sums(rows, size * len(sets), add).reshape(len(sets), size) / total
        result = {}
        for p, s in zip(sets, got):
            h = np.zeros((d, d))
            h[upper] = s[1 + d:]
            result[p] = (s[0] + penalty(p, at[p]), s[1:1 + d], h + np.triu(h, 1).T)
        return result

    best = {p: np.zeros(d) for p in range(len(params))}
    found = sums(best)
    steps, aim, settled = dict.fromkeys(best, 0), {}, set()
    for _ in range(max_steps):
        for p in set(best) - settled - set(aim):
            reg, l1 = params[p]
            obj, g, h = found[p]
            to = _move(g, h, best[p], reg * (1 - l1), reg * l1)
            move = to - best[p]
            gain = -(g @ move + move @ h @ move / 2 + penalty(p, to) - penalty(p, best[p]))
            if not np.isfinite(gain) or gain < tol:
                settled.add(p)
                if np.isfinite(gain) and gain >= 0 and reg > 0:
                    best[p] = to
            else:
                aim[p] = to
        if not aim:
            break
        for p, new in sums(aim).items():
            if new[0] < found[p][0]:
                best[p], found[p] = aim.pop(p), new
                steps[p] += 1
            else:
                aim[p] = (aim[p] + best[p]) / 2
                if np.abs(aim[p] - best[p]).max() < 1e-12:
                    aim.pop(p)
                    settled.add(p)
    return [LogisticModel(b[:-1] * inverse, float(b[-1] - (b[:-1] * inverse) @ mean), steps[p]) for p, b in best.items()]
