"""Hard negatives against comparing all rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from textlab.llm import hard_negatives as H
from pyspark.sql import functions as F

ROW = "vec_id long, embedding array<float>, label int, row string, j int"


def brute(rows, step, n_positives=5, n_negatives=3):
    dims = max([len(v) for _, v, _ in rows if v is not None] + [0])
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (dims - len(v)), lab, at) for at, (i, v, lab) in enumerate(rows)
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, lab, at in good:
        if i % step:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other, l2) for j, w, l2, other in good if other != at)
        for s, j, _, l2 in [x for x in scored if x[3] == lab][:n_positives]:
            fit = [x for x in scored if x[3] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit[:n_negatives])]
    return sorted(out)


def mined(spark, rows, step, **more):
    table = spark.createDataFrame([(*r, "x", 7) for r in rows], ROW).coalesce(1)
    return sorted(tuple(r) for r in H.hard_negatives(table, anchor=F.col("id") % step == 0, **more).collect())


def clustered(seed, n=260, dims=6, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims)) / 3
    return [(i, (centres[rng.integers(8)] + rng.normal(size=dims) / 20).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("seed,tile,cell_rows,first", [(1, 1024, 64, 64), (2, 7, 3, 2)])
def test_equals_comparing_all_rows(spark, seed, tile, cell_rows, first):
    rows = clustered(seed)
    assert mined(spark, rows, 10, tile=tile, cell_rows=cell_rows, first=first) == brute(rows, 10)


def test_odd_rows(spark):
    """Nulls, non-finite and missing components, repeated rows and ids, ties, negative scores, a crowd of copies."""
    rng = random.Random(4)
    rows = [(None, [1.0, 1.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [1.0, float("nan")], 0), (4, [float("inf"), 0.0], 0),
            (5, [0.5, 0.5], None), (10, [], 0), (20, [1.0], 0), (30, [0.0, 0.0], 1), (30, [0.0, 0.0], 1), (40, [-1.0, -1.0], 2)]
    rows += [(50 + i, [0.5, 0.25], i % 3) for i in range(60)]
    rows += [(200 + i, [rng.choice([-0.5, 0.1, 0.25, 0.3]), rng.choice([-1.0, 0.2, 0.5])], rng.randrange(4)) for i in range(80)]
    assert mined(spark, rows, 10, tile=9, cell_rows=6, first=2) == brute(rows, 10)


def test_cells_come_in_the_order_of_their_bounds():
    rng = np.random.default_rng(5)
    one, two = rng.normal(size=9), rng.normal(size=7)
    two[3] = -np.inf
    got = list(H.best_first(one, two))
    assert len({(i, j) for _, i, j in got}) == len(got) == 54
    assert all(a >= b for (a, *_), (b, *_) in zip(got, got[1:])) and all(abs(b - one[i] - two[j]) < 1e-12 for b, i, j in got)


def test_bounds_hold_and_certified_windows_stop_early(spark, monkeypatch):
    """No row scores over its cell's bound; on clustered rows most cells are never visited."""
    rng = np.random.default_rng(6)  # 40 tight groups, labels by group
    centres = rng.normal(size=(40, 4))
    rows = [(i, (centres[i % 40] + rng.normal(size=4) / 50).tolist(), i % 40 % 4) for i in range(400)]
    table = H.vectors(spark.createDataFrame([(*r, "x", 7) for r in rows], ROW), "vec_id", "embedding", F.col("label"))
    index, coded, n = H.built(table, 4)
    got = coded.collect()
    x = np.array([r.vec for r in got], float)
    one, two = index.bounds(x)
    i, j = np.array([r.i for r in got]), np.array([r.j for r in got])
    assert n == 400 and (np.bincount(i) > 0).all() and (x @ x.T <= one[:, i] + two[:, j]).all()
    goals = coded.filter("id % 10 = 0").select(F.col("row").alias("anchor"), F.lit(0).alias("slot"), F.lit(None).cast("long").alias("lo"),
                                               F.lit(None).cast("long").alias("hi"))
    seen = []
    stage = H.stage
    monkeypatch.setattr(H, "stage", lambda df, name: seen.append((name, out := stage(df, name))) or out)
    H.look(index, coded, coded.filter("id % 10 = 0").select("row", "id", "label", "vec"), goals, 5, True, 4, 64)
    cells = set(zip(i.tolist(), j.tolist()))  # the heap passes empty cells, too
    visited = [(r.row, r.i, c) for name, t in seen if name == "negatives-visits" for r in t.collect() for c in r.js if (r.i, c) in cells]
    assert len(visited) == len(set(visited)) and 0 < len(visited) < 40 * len(cells) / 2


def test_too_large_components_are_an_error(spark):
    with pytest.raises(ValueError, match="2\\^50"):
        mined(spark, [(0, [1e9], 1), (1, [1.0], 1)], 1)


def test_empty_table(spark):
    assert mined(spark, [], 10) == [] == mined(spark, [(1, [0.5], 1), (2, [0.5], 1)], 10)
