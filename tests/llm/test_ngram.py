"""The chosen-path join against all pairs."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np

from textlab.llm import ngram_join as N
from textlab.llm.bytesops import shingle_sets
from tests.conftest import SF01

DOC = "doc_id long, text string, row long, bucket long, weight int, _row long"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 7, 7, 7, 7) for i, t in zip(ids or range(len(texts)), texts)], DOC)


def grams(text, n=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(texts, threshold=0.8):
    """For each text: links to other texts, and the smallest index of its component."""
    sets = [grams(t) for t in texts]
    by = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            by[g].add(i)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    links = defaultdict(set)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in by[g] if j > i}:
            common = len(s & sets[j])
            if common >= threshold * (len(s) + len(sets[j]) - common) - 1e-9:
                links[i].add(j)
                links[j].add(i)
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(links[i]) for i in range(len(texts))], [find(i) for i in range(len(texts))], sets


def check(spark, texts, **kw):
    got = {r.id: r for r in N.similar_groups(docs(spark, texts), **kw).collect()}
    links, root, sets = brute(texts)
    assert len(got) == len(texts)
    assert [got[i].n_links for i in range(len(texts))] == links
    assert [got[i].group_id for i in range(len(texts))] == root
    assert [got[i].kept for i in range(len(texts))] == [i == r for i, r in enumerate(root)]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s if s else i, i)
        assert got[i].class_id == first[s if s else i]


def test_shingle_sets_match_python():
    texts = ["", "a", "A b", "a b c d e f", "É-é x é x é x é x é x", "1 2 3 4 5 1 2 3 4 5", "..."]
    h, n = shingle_sets([t.encode() for t in texts], 5)
    assert n.tolist() == [len(grams(t)) for t in texts]


def test_join_matches_all_pairs(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").orderBy("doc_id").select("text").collect()]
    check(spark, texts)


def test_join_splits_and_tiles(spark):
    """Small limits force the deeper levels and several tiles; a shared passage fills large buckets."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    texts = [passage + " " + " ".join(word() for _ in range(rnd.randint(20, 60))) for _ in range(120)]
    base = [word() for _ in range(120)]
    for _ in range(90):  # a cluster with some pairs above and some below the threshold
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), "", None, "", "one two", "One, two!", "x " * 80_000]
    check(spark, texts, limit=10, tile=16)


def test_cases(spark):
    assert N.similar_groups(docs(spark, [])).count() == 0
    d = docs(spark, ["a b c d e f", "a b c d e f", None, "A B C D E F"], [None, 5, 5, 3])
    got = sorted(((r.id or 0), r.n_links, r.class_size, r.kept) for r in N.similar_groups(d).collect())
    assert got == [(0, 2, 3, True), (3, 2, 3, False), (5, 0, 1, True), (5, 2, 3, False)]
    kept = N.keep_one(d)
    assert kept.columns == d.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 5]
    assert all((r.row, r._row) == (7, 7) for r in kept.collect())


def test_runs_reach_the_recall():
    assert N.runs_needed(0.8, 0.99999, 4) >= N.runs_needed(0.8, 0.99, 4) >= 3
    rng = np.random.default_rng(0)
    missed = 0
    for _ in range(400):  # pairs just at the threshold, first level only
        x = rng.integers(1, 2 ** 63, 90, dtype=np.uint64)
        y = np.concatenate((x[10:], rng.integers(1, 2 ** 63, 10, dtype=np.uint64)))
        keys = [{k for r in range(N.runs_needed(0.8, 0.99, 1)) for k in N._picked(
            N._draw(s, r + 1), N._limits(np.array([90]), N.PICK)[0], r + 1)[1].tolist()} for s in (x, y)]
        missed += not (keys[0] & keys[1])
    assert missed <= 12
