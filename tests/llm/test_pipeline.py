"""Each stage of the pipeline against brute force on its own input."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from tests.conftest import SF01
from tests.llm.test_ngram import brute
from tests.llm.test_tokens import brute_hits
from textlab.llm import bpe_shuffle


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    columns = docs.columns
    got = {}
    before = sorted(docs.collect(), key=lambda r: r.doc_id)
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF01)
        rows = sorted(out.collect(), key=lambda r: r.doc_id)
        got[name] = rows
        ids = {r.doc_id for r in rows}
        if name == "language_id":
            assert len(before) - len(rows) <= len(before) // 100
            assert all(any(c.isalpha() for c in r.text) for r in rows)
        elif name == "exact_dedup":
            keep = {}
            for r in before:
                keep[r.text] = max(keep.get(r.text, r.doc_id), r.doc_id)
            assert ids == set(keep.values())
        elif name == "ngram_jaccard":
            roots = brute([r.text for r in before])[1]
            assert ids == {before[i].doc_id for i in set(roots)}
        elif name == "decontaminate":
            items = [tuple(r) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").select("item_id", "text").collect()]
            grams = {w for _, t in items for w in t.lower().split()}
            for r in before:
                if len(grams & set(r.text.lower().split())) < 8:
                    assert r.doc_id in ids  # cannot hold a window of 13 of these words' kinds unless repeated
            some = [r for r in before if r.doc_id not in ids] + before[:40]
            for r in some:
                n, hit, _ = brute_hits(r.text, items)
                assert (r.doc_id in ids) == (not (hit and 20 * hit >= n))
        if name != "bpe":
            assert out.columns == columns
            for r in rows:
                assert r.text is not None
            docs, before = spark.createDataFrame(rows, docs.schema), rows
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                            mergeable_ranks=bpe_shuffle.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))
    assert [r.doc_id for r in got["bpe"]] == [r.doc_id for r in before]
    for r, b in zip(got["bpe"], before):
        ids = np.array(enc.encode_ordinary(b.text), "<u4").tobytes()
        assert bytes(r.ids) == ids and r.n_tokens == len(ids) // 4
        assert r.decoded_sha256 == hashlib.sha256(b.text.encode()).hexdigest()
    assert [r.doc_id for r in got["bpe"]] == sorted(r.doc_id for r in C.run(spark, SF01).collect())


def test_clashing_columns_nulls_and_empty(spark):
    rows = [(1, None, "en"), (1, "", "en"), (None, "x y z", None), (2, "Thon er the of in and.", "en"), (2, "Thon er the of in and.", "en")]
    df = spark.createDataFrame([(i, t, g, "s", 3, 1, 1, 1) for i, t, g in rows],
                               "doc_id long, text string, lang string, source string, n_chars long, row long, label long, weight long")
    for name, stage in C.STAGES:
        assert stage(spark, df.limit(0), SF01).count() == 0
        out = stage(spark, df, SF01)
        assert out.count() <= len(rows)
        if name != "bpe":
            assert out.columns == df.columns
