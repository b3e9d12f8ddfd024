"""The CRF against brute force over all label sequences, and its held-out accuracy."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np

from textlab.llm import lang_crf as L
from textlab.llm.queries import QUERIES
from tests.conftest import SF01


def test_posteriors_match_brute_force():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 4, 7, 2])
    scores, trans = rng.normal(size=(sizes.sum(), 3)), rng.normal(size=(3, 3))
    want, at = [], 0
    for n in sizes:
        post = np.zeros((n, 3))
        for ys in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(scores[at + i, y] for i, y in enumerate(ys)) + sum(trans[a, b] for a, b in zip(ys, ys[1:])))
            for i, y in enumerate(ys):
                post[i, y] += w
        want.append(post / post.sum(axis=1, keepdims=True))
        at += n
    want = np.concatenate(want)
    assert np.allclose(L.marginals(scores, sizes, trans)[0], want)
    for segment in (1, 2, 3, 256):
        assert np.allclose(L.posteriors(scores, sizes, trans, segment), want)


def test_gradient_pieces():
    rng = np.random.default_rng(1)
    sizes = np.array([5, 3])
    scores, trans = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    z = lambda s, t: L.marginals(s, sizes, t)[2].sum()
    post, pair, _ = L.marginals(scores, sizes, trans)
    for i, j in ((0, 1), (6, 2)):
        d = np.zeros_like(scores)
        d[i, j] = 1e-5
        assert abs((z(scores + d, trans) - z(scores - d, trans)) / 2e-5 - post[i, j]) < 1e-6
    d = np.zeros_like(trans)
    d[1, 2] = 1e-5
    assert abs((z(scores, trans + d) - z(scores, trans - d)) / 2e-5 - pair[1, 2]) < 1e-6


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op10_language_id"](spark, SF01).collect()
    assert len(got) == len(truth)
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_cases_and_code_switching(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = L.fit(docs, sample_docs=100)
    langs = {k: docs.filter(f"lang = '{k}' and n_chars > 2000").orderBy("doc_id").first().text[:700] for k in ("en", "de")}
    lab = L.Labeller(*model)
    post, counts = lab.words([langs["en"] + " " + langs["de"]])
    best = [model[0][i] for i in post.argmax(axis=1)]
    half = len(L.words_of(langs["en"]))
    assert np.mean([b == "en" for b in best[:half]]) > 0.9 and np.mean([b == "de" for b in best[half:]]) > 0.9
    rows = [(1, None, 1, 2.0), (2, "", 1, 2.0), (3, "12 \u0301!? ", 1, 2.0), (None, langs["de"], 1, 2.0), (4, langs["en"], 1, 2.0),
            (4, langs["en"], 1, 2.0), (5, langs["de"] * 300, 1, 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred int, score double")
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in L.label(df, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[None][0] == got[5][0] == "de" and got[4][0] == "en"
    assert sorted((r.doc_id or 0, r.lang_pred, r.score) for r in L.keep_known(df, model).collect()) == [
        (i, 1, 2.0) for i in (0, 4, 4, 5)]
    assert L.label(df.limit(0), model).count() == 0
    none = L.fit(df.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in L.label(df, none).collect()} == {"und"}


def test_unknown_languages_go_and_mixed_texts_stay(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = L.fit(docs)
    rnd = random.Random(1)
    say = lambda a, b, n: " ".join("".join(chr(rnd.randrange(a, b)) for _ in range(rnd.randint(2, 9))) for _ in range(n))
    scripts = [(97, 123), (0x430, 0x450), (0x4E00, 0x9FA5)]
    noise = [say(a, b, n) for a, b in scripts for n in (10, 30, 2000)]
    noise.append("Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.")
    by = {k: [r.text[:200] for r in docs.filter(f"lang = '{k}' and n_chars > 400").orderBy("doc_id").limit(20).collect()]
          for k in model[0]}
    mixed = [" ".join(by[k][i] for k in model[0]) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(noise + mixed)), "doc_id long, text string")
    assert {r.doc_id for r in L.keep_known(df, model).collect()} == set(range(len(noise), len(noise) + len(mixed)))
    scores = {r.doc_id: r.lang_score for r in L.label(df, model).collect()}
    assert max(scores[i] for i in range(len(noise))) < 0.1
    rest = L.fit(docs.filter("lang <> 'es'"))
    assert L.keep_known(docs.filter("lang = 'es'"), rest).count() < 0.1 * docs.filter("lang = 'es'").count()
    assert L.keep_known(docs.filter("lang <> 'es'"), rest).count() == docs.filter("lang <> 'es'").count()


def test_sample_is_the_smallest_hashes(spark):
    rows = [(i, f"w{i} x", "a" if i % 3 else "b") for i in range(3000)] + [(7, "same", "c")] * 500 + [(8, None, "d"), (9, "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.labelled_sample(df, "doc_id", "text", "lang", 20, 120)
    hashed = {(r.text, r.lang): r.h for r in df.selectExpr("text", "lang", "xxhash64(doc_id) h").collect()}
    for lang in ("a", "b"):
        want = sorted((t for t, g in hashed if g == lang), key=lambda t: hashed[t, lang])[:20]
        assert [t for t, g in got if g == lang] == sorted(want)
    assert [t for t, g in got if g == "c"] == ["same"] * 20 and {g for _, g in got} == {"a", "b", "c"}
