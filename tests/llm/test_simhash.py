"""SimHash fingerprints and anchor covering against plain loops."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from textlab.llm import simhash_anchors as S
from textlab.llm.queries import QUERIES
from tests.conftest import SF001

DOC = "doc_id long, text string, fp string, label int, row long"


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, threshold=4):
    """{place: smallest id reachable} by comparing all pairs."""
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= threshold:
                label[root(i)] = root(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            best[root(i)] = min(best.get(root(i), doc_id), doc_id)
    return [best.get(root(i)) for i in range(len(rows))]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, 7) for i, t in rows], DOC)


def check(rows, out):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    want = sorted(((i, f, c) for (i, f), c in zip(prints, plain_components(prints))), key=str)
    got = sorted(((r.id, r.fp & (1 << 64) - 1, r.component_id) for r in out.collect()), key=str)
    assert got == want


@pytest.mark.parametrize("code", S.codes())
def test_codes_cover_their_space(code):
    """Every word of the block has a home within the radius, and all anchors within reach are listed."""
    reach = code.radius + 1
    fp = np.random.default_rng(1).integers(0, 1 << 63, 300, dtype=np.uint64)
    of, anchor, home = code.anchors(fp, reach, code.patterns(reach))
    part = ((fp >> code.shift) & code.mask).astype(np.int64)
    assert (code.syndromes(anchor) == 0).all()
    far = np.bitwise_count(anchor ^ part[of])
    assert far[home].max() <= code.radius and (np.bincount(of[home], minlength=300) == 1).all()
    words = np.arange(1 << code.length, dtype=np.int64)
    words = words[code.syndromes(words) == 0]
    for i in range(20):
        assert sorted(anchor[of == i]) == words[np.bitwise_count(words ^ part[i]) <= reach].tolist()


@pytest.mark.parametrize("tile", [4, 4096])
def test_pairs_within_the_threshold(spark, tile):
    """Planted fingerprints at 1 to 6 bits from others, chains and a crowd around one anchor."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for bits in (1, 2, 3, 4, 5, 6):
            fps.add(b ^ sum(1 << x for x in rng.sample(range(64), bits)))
    crowd = rng.getrandbits(64)
    fps |= {crowd ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(4))) for _ in range(150)}
    fps = sorted(fps | {0, (1 << 64) - 1, 0b111})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = S.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, tile)
    labels = {r["row"]: r["label"] for r in S.connected(edges).collect()}
    want = plain_components(list(enumerate(fps)))
    for i, f in enumerate(signed):
        assert fps.index(labels.get(f, f) & (1 << 64) - 1) in range(len(fps))
        assert want[fps.index(labels.get(f, f) & (1 << 64) - 1)] == want[i]
    assert len({labels.get(f, f) for f in signed}) == len(set(want))


def test_texts_of_all_kinds(spark):
    rng = random.Random(5)
    vocab = ["alpha", "Béta", "GAMMA", "δelta", "x", "…", "no break"]
    long = " ".join(rng.choice(vocab) for _ in range(3000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three"), (6, "ONE two\x0bthree"), (7, "one two three four"),
            (8, long), (9, long + " tail"), (10, long), (None, long), (None, None), (11, "w" * 5000), (12, "a\x00b c d e f")]
    rows += [(100 + i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    check(rows, S.near_groups(docs(spark, rows)))


def test_slices_do_not_change_a_fingerprint():
    rng = random.Random(6)
    text = " ".join("w" * rng.randrange(1, 30) + str(rng.randrange(50)) for _ in range(400)).encode()
    for size in (1, 7, 64, 1000):
        assert S.fingerprint(text, size) == S.fingerprint(text)
    assert int.from_bytes(S.fingerprint(text), "big") == plain_fingerprint(text.decode())


def test_empty_table(spark):
    assert S.near_groups(docs(spark, [])).collect() == []


def test_query_on_the_small_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    want = {(i, f"{f:016x}", c) for (i, f), c in zip(prints, plain_components(prints))}
    assert {tuple(r) for r in QUERIES["op11_simhash"](spark, SF001).select("doc_id", "fingerprint", "component_id").collect()} == want
