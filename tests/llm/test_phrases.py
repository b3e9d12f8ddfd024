"""Phrase mining against counting everything."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from textlab.llm import phrases as P

DOC = "doc_id long, text string, lang string, phrase string, score int"


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if j - i < len(p) and 100 * a >= 80 * count[p[i:j]]}
        best = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


def mined(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, lang, "x", 7) for i, (lang, t) in enumerate(rows)], DOC)
    return sorted(tuple(r) for r in P.top_phrases(docs, **more).collect())


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(25)] + ["Éa", "The", "x\x00y", "δ", "a-b"]
    fixed = ["the w1 w2 w3", "new York CITY", "w4 the", "δ Éa δ Éa δ", "w7 w7 w7 w7"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else vocab[min(int(rng.expovariate(0.2)), len(vocab) - 1)]
                 for _ in range(rng.randrange(60))]
        rows.append((rng.choice(["en", "en", "en", "fr", None]),
                     "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for x in parts)))
    return rows + [("en", None), ("en", ""), ("de", " .,; "), ("es", "one"), (None, "The w1 w2 w3 " * 40)]


@pytest.mark.parametrize("seed,top,block_words,bucket_keys,slice_bytes", [
    (1, 2000, 1_000_000, 2_000_000, 1 << 20), (2, 3, 50, 40, 7), (3, 8, 200, 15, 30), (4, 1, 9, 1000, 1)])
def test_equals_counting_everything(spark, seed, top, block_words, bucket_keys, slice_bytes):
    rows = corpus(seed)
    got = mined(spark, rows, least=5, top=top, block_words=block_words, bucket_keys=bucket_keys, slice_bytes=slice_bytes)
    assert got == brute(rows, 5, top)


def test_waves_lower_the_bound_until_enough_survive(spark, monkeypatch):
    """Pairs that longer phrases drop leave too few in the first wave."""
    rows = [("en", " . ".join(f"a{i} b{i} c{i} d{i}" for i in range(12)))] * 9 + [("en", "p q . p z")] * 6
    bounds = []
    wave = P.wave
    monkeypatch.setattr(P, "wave", lambda *a: bounds.append(a[-1]["en"]) or wave(*a))
    assert mined(spark, rows, least=5, top=13) == brute(rows, 5, 13)
    assert len(bounds) > 1 and bounds[0] > bounds[-1]


def test_one_very_long_text(spark):
    rng = random.Random(8)
    rows = [("en", " ".join(rng.choice("abcdefg") * rng.randrange(1, 3) for _ in range(20000)))]
    got = mined(spark, rows, least=30, top=40, block_words=700, bucket_keys=100, slice_bytes=512)
    assert got == brute(rows, 30, 40)


def test_scores_are_exact_beyond_64_bits():
    rng = random.Random(2)
    for _ in range(500):
        a = rng.randrange(1, 1 << 52)
        both = rng.randrange(2 * a, min(1 << 53, 4 * a) + 1) if 2 * a < 1 << 53 else 2 * a
        assert P.dice(np.array([a]), np.array([both]))[0] == 2000000 * a // both


def test_empty_table(spark):
    assert mined(spark, []) == []
