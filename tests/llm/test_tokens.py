"""Pre-tokens, token files, BPE by distinct words and decontamination against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import tempfile
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from textlab.llm import bpe_shuffle as B
from textlab.llm import decontaminate as D
from textlab.llm import pretoken
from textlab.llm import token_files as T
from textlab.llm.queries import QUERIES
from tests.conftest import SF01

ODD = ["", "'s don't we'll 'tis  '", "  \n\n x", "\n", "   ", "a  b\n c\t\td  ", "x''s y'", "I'Ve've'd12'm", "é'll𝄞 𝄞'd 1½x",
       "　　a  b'", "'s's's", "\x00a\x00 b", "\x1c\x1d x", "a​ b́c", " '", "x\r\n\r\ny ", None,
       "<|endoftext|> x", "same", "same", "long " * 60_000]
DOC = "doc_id long, text string, lang string, ids long, block long, tie long, part long, shard long"


def docs(spark, texts, ids=None):
    ids = ids or [*range(len(texts))]
    return spark.createDataFrame([(i, t, None, 7, 7, 7, 7, 7) for i, t in zip(ids, texts)], DOC)


def texts01(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()]


def test_pretokens_match_the_pattern():
    rnd, pat = random.Random(1), regex.compile(P.PATTERN)
    texts = [t or "" for t in ODD] + ["".join(rnd.choice("ab'strevld 1\n\t.é, ") for _ in range(rnd.randint(0, 30)))
                                      for _ in range(20_000)]
    words, place, counts = pretoken.distinct(texts)
    at = 0
    for t, n in zip(texts, counts):
        assert [words[i] for i in place[at:at + n]] == pat.findall(t)
        at += n


@pytest.fixture(scope="module")
def encodings():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = B.read_ranks(path)
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_row(enc, text):
    ids = np.array(enc.encode_ordinary(text or ""), "<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_query_matches_library(spark, encodings):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op5_bpe"](spark, SF01).collect()}
    assert got == {i: bpe_row(encodings[1], t) for i, t in texts01(spark)}


def test_bpe_cases(spark, encodings):
    ranks, enc = encodings
    out = B.decode(B.encode(docs(spark, ODD, [None, *range(1, len(ODD))]), ranks, P.PATTERN), ranks).collect()
    got = sorted((r.id is None, r.id or 0, bytes(r.ids), bytes(r.decoded)) for r in out)
    want = sorted((i == 0, i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode())
                  for i, t in enumerate(ODD))
    assert got == want
    assert B.encode(docs(spark, ODD).limit(0), ranks, P.PATTERN).count() == 0


def test_token_files_query(spark):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, want = 0, {}
    for i, t in sorted(texts01(spark)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op3_token_files"](spark, SF01).collect()}
    assert got == want


def test_token_files_cases(spark, monkeypatch):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = [5, 5, 5, None, None, *range(100, 100 + len(ODD) - 5)]
    root = tempfile.mkdtemp(prefix="token-files-") + "/x"
    T.write(docs(spark, ODD, ids), P.path("byte_bpe_50k.json"), root)
    rows = T.read(spark, root).collect()
    want = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
            for i, t in zip(ids, ODD)]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.id, bytes(r.ids)) for r in rows), key=key) == sorted(want, key=key)
    rows.sort(key=lambda r: r.start)
    assert [r.id for r in rows] == sorted(ids, key=lambda i: (i is not None, i))
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows]).tolist()][:-1]
    trained = T.read_dictionary(spark, root)
    chunk = spark.read.parquet(f"{root}/chunks").orderBy("shard", "part").first()
    assert T.read_document(bytes(chunk.payload), 0, trained).tobytes() == bytes(rows[0].ids)
    with pytest.raises(ValueError):
        T.read_document(bytes(chunk.payload), 0, trained + b"x")
    T.write(docs(spark, ODD).limit(0), P.path("byte_bpe_50k.json"), root + "0")
    assert T.read(spark, root + "0").count() == 0


def test_token_files_special_strings(spark):
    """A text with strings of added tokens gets the ids of the plain library call."""
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext", "plain", None]
    root = tempfile.mkdtemp(prefix="token-files-") + "/x"
    T.write(docs(spark, texts), P.path("byte_bpe_50k.json"), root)
    got = {r.id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in T.read(spark, root).collect()}
    assert got == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert 50256 in got[0]


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, hit, ids = words(text), set(), set()
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            win = w[k:k + 13]
            for p in range(len(doc) - len(win) + 1):
                if doc[p:p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    ids |= {str(i)} if i is not None else set()
    return len(doc), len(hit), sorted(ids)


def test_decontaminate_cases(spark):
    rnd = random.Random(2)
    vocab = ["a", "b", "É", "x1", "Z"]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(1, say(20)), (2, say(3)), (3, say(14)), (None, say(13)), (4, ""), (5, None), (3, say(14)), (6, "...")]
    texts = [say(rnd.randint(0, 60)) for _ in range(60)] + [f"q, {items[0][1].replace(' ', '--')}! end", None, "", "?!",
                                                            items[2][1].lower(), items[1][1], "w " * 50_000 + items[3][1]]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_hit int")
    got = {r.id: r for r in D.scan(docs(spark, texts), bench).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_hit, got[i].items) == brute_hits(t, items), t
    hit = got[60].spans[0]
    assert texts[60].encode()[hit.start:hit.end].decode().replace("--", " ") == items[0][1]
    kept = {r.doc_id for r in D.keep_clean(docs(spark, texts), bench).collect()}
    assert kept == {i for i, r in got.items() if not (r.n_hit and 20 * r.n_hit >= r.n_words)}
    assert D.scan(docs(spark, []).limit(0), bench).count() == 0
    assert D.scan(docs(spark, texts), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_decontaminate_parts_and_passes(spark, monkeypatch):
    """Parts of 300 bytes, two a pass: many automata, several staged passes and cut items give the brute-force rows."""
    monkeypatch.setattr(D, "PART_BYTES", 300)
    monkeypatch.setattr(D, "PASS_PARTS", 2)
    rnd = random.Random(5)
    say = lambda n, k: " ".join(f"v{rnd.randrange(k)}" for _ in range(n))
    items = [(f"i{i}", say(rnd.choice([2, 7, 12, 13, 14, 40, 300]), rnd.choice([3, 50]))) for i in range(30)]
    texts = [say(rnd.randint(0, 80), rnd.choice([3, 50])) for _ in range(30)]
    texts += [say(5, 50) + " " + t[k:k + 200] + " " + say(5, 50) for _, t in items for k in (0, 30)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    frame = docs(spark, texts)
    assert len(list(D.passes(bench, "item_id", "text", 13))) > 3
    got = {r.id: (r.n_words, r.n_hit, r.items) for r in D.scan(frame, bench).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    kept = {r.doc_id for r in D.keep_clean(frame, bench).collect()}
    assert kept == {i for i, (n, k, _) in got.items() if not (k and 20 * k >= n)}


def test_decontaminate_memory():
    """An automaton takes under 60 bytes for each byte of a benchmark of random words."""
    import psutil
    rnd = random.Random(6)
    vocab = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(3, 9))) for _ in range(20_000)]
    items = [(str(i), [w.encode() for w in rnd.choices(vocab, k=200)]) for i in range(1600)]
    size = sum(len(w) + 1 for _, ws in items for w in ws)
    before = psutil.Process().memory_info().rss
    matcher = D.Matcher(items, 13)
    assert psutil.Process().memory_info().rss - before < 60 * size
    start, stop, who = matcher.hits([b"q", *items[7][1][20:50], b"q"])
    assert (start.min(), stop.max(), who) == (1, 31, {"7"})
