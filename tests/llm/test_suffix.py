"""Repeated byte strings against a set of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from textlab.llm import suffix_dedup as S
from textlab.llm.queries import QUERIES
from tests.conftest import SF01

DOC = "doc_id long, text string, block long, texts string, first int"


def brute(texts, width):
    """(kept bytes, spans) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter()
    for t in raw:
        seen.update(hashlib.md5(t[i:i + width]).digest() for i in range(len(t) - width + 1))
    out = []
    for t in raw:
        mask = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - width + 1):
            if seen[hashlib.md5(t[i:i + width]).digest()] > 1:
                mask[i:i + width] = True
        edge = np.flatnonzero(np.diff(mask.astype(int), prepend=0))
        out.append((bytes(b for b, m in zip(t, mask) if not m), [tuple(x) for x in edge.reshape(-1, 2).tolist()]))
    return out


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 7, "x", 7) for i, t in zip(ids or range(len(texts)), texts)], DOC)


@pytest.mark.parametrize("r", [0, 1, 2, 3])
def test_difference_cover(r):
    v, cover = S.difference_cover(r)
    assert {(int(a) - int(b)) % v for a in cover for b in cover} == set(range(v))


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()
    want = brute([r.text for r in rows], 400)
    got = {r.doc_id: r for r in QUERIES["op1_suffix_dedup"](spark, SF01).collect()}
    assert any(s for _, s in want)
    for r, (kept, spans) in zip(rows, want):
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans) == (len(r.text.encode()), len(r.text.encode()) - len(kept), len(spans))
        assert g.kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("width,chunk", [(400, 1 << 21), (40, 97), (20, 50), (5, 8)])
def test_cases(spark, width, chunk):
    """Small pieces force the cuts inside texts; widths below 26 have no cover to speak of."""
    rnd = random.Random(width)
    say = lambda n: "".join(rnd.choice("abé") for _ in range(n))
    a, b = say(3 * width), say(width - 1)
    texts = [a, say(width) + a[3:] + say(9), b, "x" + b + "y", "z" * (3 * width), None, "", a[:width], say(50), a, a]
    texts += [say(rnd.randint(0, 4 * width)) + a[rnd.randint(0, width):rnd.randint(width, 3 * width)] for _ in range(20)]
    texts += [long := say(30_000), long[1_000:1_000 + 2 * width]]
    ids = [None, 3, 3, *range(10, 10 + len(texts) - 3)]
    got = S.repeated_spans(docs(spark, texts, ids), width=width, chunk=chunk).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.id, bytes(r.kept), [tuple(s) for s in r.spans]) for r in got), key=key) == \
        sorted(((i, k, s) for i, (k, s) in zip(ids, brute(texts, width))), key=key)


def test_planted_passages(spark, tmpdir_fresh):
    """A passage of 57 words that two documents hold goes at 400 bytes and stays at 399."""
    rnd = random.Random(57)
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    at, under = say(57) + "xy", say(57) + "z"
    assert (len(at), len(under)) == (400, 399)
    texts = [f"{say(90)}{i}{p}{i}{say(70)}" for i, p in enumerate([at, under, at, under, say(57)])] + [None]
    docs(spark, texts).select("doc_id", "text").write.parquet(f"{tmpdir_fresh}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op1_suffix_dedup"](spark, tmpdir_fresh).collect()}
    assert [got[i].n_removed for i in range(6)] == [400, 0, 400, 0, 0, 0]
    assert [got[i].n_spans for i in range(6)] == [1, 0, 1, 0, 0, 0]
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert got[i].n_bytes == len(raw)
        assert got[i].kept_sha256 == hashlib.sha256(raw.replace(at.encode(), b"")).hexdigest()


@pytest.mark.parametrize("bits", [0, 4, 12])
def test_weak_names_are_told_apart_by_their_checks(spark, bits):
    """With 2^bits names most different strings share one; no clean byte may go for that."""
    rnd = random.Random(bits)
    say = lambda n: "".join(rnd.choice("abcdé") for _ in range(n))
    a = say(200)
    texts = [say(300) for _ in range(30)] + [say(20) + a + say(7), a[10:] + say(3), a, a] + [say(2_000)]
    got = S.repeated_spans(docs(spark, texts).repartition(3), width=40, name_bits=bits).collect()
    want = brute(texts, 40)
    assert sum(bool(s) for _, s in want) == 4
    assert [(bytes(r.kept), [tuple(s) for s in r.spans]) for r in sorted(got, key=lambda r: r.id)] == want


def test_names_and_checks_in_order():
    names, check = np.array([9, 3, 3, 9, 3], np.uint64), np.array([2, 7, 1, 2, 7], np.uint32)
    order, same = S.in_order(names, check)
    assert [(int(names[i]), int(check[i])) for i in order] == [(3, 1), (3, 7), (3, 7), (9, 2), (9, 2)]
    assert same.tolist() == [False, False, True, False, True]
    assert not len(S.in_order(names[:0], check[:0])[0])


def test_packed_names():
    rnd = np.random.default_rng(4)
    for names in (np.array([0], np.uint64), np.array([5 << 8, 1 << 48, ((1 << 56) - 1) << 8], np.uint64),
                  np.sort(rnd.integers(0, 1 << 56, 5_000, np.uint64)) << np.uint64(8)):
        assert S.unpacked(*S.packed(names)).tolist() == names.tolist()


def test_empty(spark):
    assert S.repeated_spans(docs(spark, ["a"]).limit(0)).count() == 0
    assert [r.n_bytes for r in S.repeated_spans(docs(spark, [""])).collect()] == [0]
