"""Language ID by a linear-chain conditional random field over the words of a text.

Every word of a text gets a language by the chain's posterior marginals (forward-backward), so a
code-switched text can change language at any word. A word's features are its affixes (prefixes and
suffixes of 1 to 3 characters), its character 3-grams and its whole form (the lexicon), hashed into
one weight table; transitions between languages are learned with them. A document's language is the
one with the largest mean marginal over its words.

The marginals of a closed set of languages say nothing of texts in none of them, so a background model goes with
the chain (``Background``): the share of a word's character 4-grams (its ends included) that the training sample
holds in any language. Trained on one half of the sample and applied to the other, it gives for each language
the mean share of its own texts, and, as background, the larger of two: the mean share of its words with shuffled letters, and
of its words when the sample of the language itself is left out (what another real language would look like).
Between the two lies a logistic curve, P(known). ``score`` is the mean marginal times P(known).

Training runs on a bounded sample: at most ``sample_docs`` labelled documents per language, those of smallest
id hash, found in one pass over all languages, and at most ``sample_words`` consecutive words from the middle of each. Words take their
document's label; each training chain joins pieces of several documents, of one language or more, so the
transitions see switches. The sample is the only thing that reaches the driver. Prediction reads
nothing but the text and covers every word of every document, one Arrow batch at a time; a word's
emissions are computed once per batch and distinct word.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if
no labelled text exists; a language with fewer than two documents in the sample has no background (P(known) is 1); more
than ``max_langs`` languages are an error (the weights would not fit); very long texts cost memory in proportion to their words;
 equal posteriors go to the language that sorts first; repeated rows each
get the same result; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textlab.llm.bytesops import mix, prefix, spans
from textlab.llm.common import hash_sample
from textlab.llm.pretoken import text_chunks

TABLE = 1 << 16
GRAM = 4
#: A text's share counts as if so many further words were like those of its language: short texts stay.
PRIOR_WORDS = 3
BATCH_BYTES = 1 << 21
_letters: np.ndarray | None = None


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, end to end, and how many each word has."""
    joined = "".join(words)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    begin = end - size
    every, owner = [], []
    who = np.arange(len(words))

    def add(kind: int, first: np.ndarray, length: int, of: np.ndarray) -> None:
        h = np.full(len(first), kind, np.uint64)
        for k in range(length):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + points[first + k])
        every.append(h)
        owner.append(of)

    for n in (1, 2, 3):
        ok = size >= n
        add(n, begin[ok], n, who[ok])
        add(10 + n, end[ok] - n, n, who[ok])
    inner = np.repeat(who, np.maximum(size - 2, 0))
    first = np.arange(len(inner)) - np.repeat(np.cumsum(np.maximum(size - 2, 0)) - np.maximum(size - 2, 0),
                                              np.maximum(size - 2, 0)) + begin[inner]
    add(20, first, 3, inner)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(
        points + np.uint64(77) * (np.arange(len(points)) - np.repeat(begin, size)).astype(np.uint64)))))
    every.append(mix(sums[end] - sums[begin]))  # the whole form
    owner.append(who)
    h, owner = np.concatenate(every), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (h[order] % np.uint64(TABLE)).astype(np.int64), np.bincount(owner, minlength=len(words))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character 4-grams of all words, ends marked, end to end, and how many each word has."""
    joined = "".join([f"\x01{w}\x02" for w in words])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    n = np.maximum(size - GRAM + 1, 0)
    first = np.repeat(np.cumsum(size) - size - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    h = np.full(len(first), 7, np.uint64)
    for k in range(GRAM):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + points[first + k])
    return h, n


def seen_shares(words: list[str], known: np.ndarray) -> np.ndarray:
    """The share of each word's 4-grams among ``known`` (sorted hashes); NaN for words without one."""
    h, n = grams(words)
    if len(known):
        inside = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    else:
        inside = np.zeros(len(h), bool)
    upto = np.concatenate(([0], np.cumsum(inside)))
    end = np.cumsum(n)
    with np.errstate(invalid="ignore"):
        return np.where(n > 0, (upto[end] - upto[end - n]) / np.where(n > 0, n, 1), np.nan)


def _mean_share(words: list[str], known: np.ndarray) -> float:
    share = seen_shares(words, known)
    share = share[~np.isnan(share)]
    return float(share.mean()) if len(share) else float("nan")


class Background:
    """P(known) of a text from the mean share of seen 4-grams over its words, by the language it is given."""

    def __init__(self, known: np.ndarray, own: np.ndarray, bound: np.ndarray, slope: np.ndarray):
        self.known, self.own, self.bound, self.slope = known, own, bound, slope

    @classmethod
    def train(cls, samples: list[tuple[list[str], int]], k: int, seed: int = 0) -> "Background":
        """From (words, language number) of every sample document."""
        rng = np.random.default_rng(seed)
        halves: list[list[list[str]]] = [[[], []] for _ in range(k)]
        seen_docs = [0] * k
        for words, lang in samples:
            halves[lang][seen_docs[lang] % 2] += words
            seen_docs[lang] += 1
        first = [np.unique(grams(h[0])[0]) for h in halves]
        every, holders = np.unique(np.concatenate([*first, np.empty(0, np.uint64)]), return_counts=True)
        own, bound, slope = np.ones(k), np.full(k, -1.0), np.zeros(k)
        for lang, (_, rest) in enumerate(halves):
            mine = _mean_share(rest, every)
            shuffled = ["".join(rng.permutation(list(w))) for w in rest]
            left_out = every[(holders > 1) | ~np.isin(every, first[lang], assume_unique=True)]
            back = np.fmax(_mean_share(shuffled, every), _mean_share(rest, left_out))
            if mine - back > 0.01:
                own[lang], bound[lang], slope[lang] = mine, back + 0.4 * (mine - back), 10 / (mine - back)
        known = np.unique(np.concatenate([grams(w)[0] for w, _ in samples] or [np.empty(0, np.uint64)]))
        return cls(known, own, bound, slope)

    def chance(self, share_sum: np.ndarray, n: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """P(known) of texts with ``n`` words of the given share sums, each under its language."""
        share = (share_sum + PRIOR_WORDS * self.own[lang]) / (n + PRIOR_WORDS)
        return np.where(self.slope[lang] > 0, 1 / (1 + np.exp(-self.slope[lang] * (share - self.bound[lang]))), 1.0)


def emissions(weights: np.ndarray, words: list[str]) -> np.ndarray:
    """Scores of every language for each word (rows), means over its features."""
    if not words:
        return np.empty((0, weights.shape[1]))
    ids, n = features(words)
    return np.add.reduceat(weights[ids], np.cumsum(n) - n, axis=0) / n[:, None]


def marginals(scores: np.ndarray, sizes: np.ndarray, trans: np.ndarray):
    """Forward-backward over short chains laid end to end, as training needs it.

    Chains run side by side, longest first, so a step handles all chains that still have words.
    Returns (posteriors, expected transitions, log normalisers).
    """
    k = scores.shape[1]
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    length = sizes[order]
    top = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(top), "left")  # chains longer than t
    shift = scores.max(axis=1, keepdims=True)
    emit = np.exp(scores - shift)
    move = np.exp(trans)
    fwd = np.empty_like(emit)
    logz = np.zeros(len(sizes))
    alpha = np.full((len(sizes), k), 1.0 / k)
    for t in range(top):
        n = live[t]
        at = start[:n] + t
        a = (alpha[:n] @ move if t else alpha[:n]) * emit[at]
        z = a.sum(axis=1, keepdims=True)
        a /= z
        alpha[:n] = a
        fwd[at] = a
        logz[:n] += np.log(z[:, 0]) + shift[at, 0]
    post = np.empty_like(emit)
    pair = np.zeros((k, k))
    beta = np.ones((len(sizes), k))
    for t in range(top - 1, -1, -1):
        n = live[t]
        at = start[:n] + t
        more = live[t + 1] if t + 1 < top else 0
        if more:
            b = emit[at[:more] + 1] * beta[:more]
            joint = fwd[at[:more]][:, :, None] * move[None] * b[:, None, :]
            pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = b @ move.T
            beta[:more] = b / b.sum(axis=1, keepdims=True)
        p = fwd[at] * beta[:n]
        post[at] = p / p.sum(axis=1, keepdims=True)
    return post, pair, logz


def train(samples: list[tuple[str, str]], sample_words: int, chain_words: int = 60, steps: int = 60,
          seed: int = 0) -> tuple[list[str], np.ndarray, np.ndarray, Background]:
    """(languages, feature weights, transitions, background) from (text, language) pairs, by full-batch Adam."""
    langs = sorted({lang for _, lang in samples})
    rng = np.random.default_rng(seed)
    pieces, own_words = [], []
    for text, lang in samples:
        words = words_of(text)
        cut = max(0, (len(words) - sample_words) // 2)
        words = words[cut:cut + sample_words]
        own_words.append((words, langs.index(lang)))
        pieces += [(words[a:a + 20], langs.index(lang)) for a in range(0, len(words), 20)]
    rng.shuffle(pieces)
    chains, labels = [], []
    while pieces:  # a chain: three pieces, all of the first one's language two times out of three
        first = pieces.pop()
        mixed = rng.random() < 1 / 3
        chain, label = list(first[0]), [first[1]] * len(first[0])
        while pieces and len(chain) < chain_words:
            k = next((i for i in range(len(pieces) - 1, max(-1, len(pieces) - 40), -1)
                      if mixed or pieces[i][1] == first[1]), None)
            if k is None:
                break
            words, lang = pieces.pop(k)
            chain += words
            label += [lang] * len(words)
        chains.append(chain)
        labels += label
    flat = [w for c in chains for w in c]
    background = Background.train(own_words, len(langs), seed)
    if not flat:
        return [], np.zeros((TABLE, 1)), np.zeros((1, 1)), background
    sizes = np.array([len(c) for c in chains])
    vocab = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    word = np.fromiter((vocab[w] for w in flat), np.int64, len(flat))
    ids, n = features(list(vocab))
    share = np.repeat(1.0 / n, n)
    of_word = np.repeat(np.arange(len(vocab)), n)
    begin = np.cumsum(n) - n
    y = np.array(labels)
    k = len(langs)
    gold = np.zeros((len(flat), k))
    gold[np.arange(len(flat)), y] = 1
    inside = np.ones(len(flat), bool)
    inside[np.cumsum(sizes) - 1] = False
    gold_pair = np.zeros((k, k))
    np.add.at(gold_pair, (y[inside], y[np.flatnonzero(inside) + 1]), 1)
    params = np.zeros(TABLE * k + k * k)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, t = params[:TABLE * k].reshape(TABLE, k), params[TABLE * k:].reshape(k, k)
        per_word = np.add.reduceat(w[ids], begin, axis=0) / n[:, None]
        post, pair, _ = marginals(per_word[word], sizes, t)
        diff = np.stack([np.bincount(word, (gold - post)[:, j], len(vocab)) for j in range(k)], axis=1)
        each = diff[of_word] * share[:, None]
        grad_w = np.stack([np.bincount(ids, each[:, j], TABLE) for j in range(k)], axis=1)
        grad = np.concatenate((grad_w.ravel(), (gold_pair - pair).ravel())) / len(flat) - 1e-7 * params
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        params = params + 0.2 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return langs, params[:TABLE * k].reshape(TABLE, k), params[TABLE * k:].reshape(k, k), background


def letters() -> np.ndarray:
    """2 for letters, 1 for marks, 0 for other code points. Made once per process."""
    global _letters
    if _letters is None:
        kinds = {"L": 2, "M": 1}
        _letters = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
    return _letters


def cut(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the lower-cased texts: joined text, starts, ends, hashes, and each text's count.

    A word is a run of letters and marks with a letter in it.
    """
    lowered = [(t or "").lower() for t in texts]
    joined = "\x00".join(lowered) + "\x00"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = letters()[points]
    inside = np.zeros(len(points) + 1, np.int8)
    inside[1:] = kind > 0
    edge = np.flatnonzero(np.diff(inside))
    start, stop = edge[0::2], edge[1::2]
    if (kind == 1).any() and len(start):
        lettered = np.maximum.reduceat(kind, start) == 2  # what follows a word up to the next one is 0
        start, stop = start[lettered], stop[lettered]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    counts = np.diff(np.searchsorted(start, ends, "left"), prepend=0)
    sums = prefix(mix(points.astype(np.uint64) + np.uint64(1)))
    return joined, start, stop, spans(sums, start, stop), counts


def words_of(text: str | None) -> list[str]:
    joined, start, stop, _, _ = cut([text])
    return [joined[a:b] for a, b in zip(start.tolist(), stop.tolist())]


def posteriors(scores: np.ndarray, sizes: np.ndarray, trans: np.ndarray, segment: int = 256) -> np.ndarray:
    """Forward-backward posteriors of chains laid end to end, in segments that run side by side.

    The transfer matrix of every segment is built first; chains are then followed from segment to segment
    (one step each), which gives what enters a segment from either side; with that, all segments are
    filled in together. Long chains thus cost steps in proportion to ``segment``, not to their length.
    """
    k = scores.shape[1]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    move = np.exp(trans).astype(emit.dtype)
    parts = -(-sizes // segment)
    chain = np.repeat(np.arange(len(sizes)), parts)
    first = np.cumsum(parts) - parts
    number = np.arange(len(chain)) - first[chain]
    begin = (np.cumsum(sizes) - sizes)[chain] + number * segment
    length = np.minimum(sizes[chain] - number * segment, segment)
    many = parts[chain] > 1
    # transfer matrices, of segments in chains of several
    own = np.flatnonzero(many)
    own = own[np.argsort(-length[own], kind="stable")]
    live = np.searchsorted(-length[own], -np.arange(segment), "left")
    matrix = np.empty((len(chain), k, k), emit.dtype)
    m = np.where((number[own] == 0)[:, None, None], np.eye(k, dtype=emit.dtype), move)
    for t in range(segment):
        n = live[t]
        if not n:
            break
        x = (m[:n] @ move if t else m[:n]) * emit[begin[own[:n]] + t][:, None, :]
        m[:n] = x / x.sum(axis=(1, 2), keepdims=True)
    matrix[own] = m
    enter = np.full((len(chain), k), 1.0 / k, emit.dtype)
    leave = np.ones((len(chain), k), emit.dtype)
    for s in range(1, int(parts.max()) if len(parts) else 0):
        at = first[parts > s] + s
        x = (enter[at - 1][:, None, :] @ matrix[at - 1])[:, 0]
        enter[at] = x / x.sum(axis=1, keepdims=True)
    for s in range(int(parts.max()) - 1 if len(parts) else 0, 0, -1):
        at = first[parts > s] + s
        x = (matrix[at] @ leave[at][:, :, None])[:, :, 0]
        leave[at - 1] = x / x.sum(axis=1, keepdims=True)
    # all segments together
    order = np.argsort(-length, kind="stable")
    begin, length, head = begin[order], length[order], (number == 0)[order]
    live = np.searchsorted(-length, -np.arange(segment), "left")
    a = enter[order]
    post = np.empty_like(emit)
    for t in range(segment):
        n = live[t]
        if not n:
            break
        at = begin[:n] + t
        x = a[:n] @ move
        if not t:
            x[head] = 1.0 / k
        x *= emit[at]
        x /= x.sum(axis=1, keepdims=True)
        a[:n] = x
        post[at] = x
    b = leave[order]
    for t in range(segment - 1, -1, -1):
        n = live[t]
        if not n:
            continue
        at = begin[:n] + t
        x = post[at] * b[:n]
        post[at] = x / x.sum(axis=1, keepdims=True)
        x = (emit[at] * b[:n]) @ move.T
        b[:n] = x / x.sum(axis=1, keepdims=True)
    return post


class Labeller:
    """Applies a trained model to batches of texts."""

    def __init__(self, langs: list[str], weights: np.ndarray, trans: np.ndarray, background: Background):
        self.langs, self.weights, self.trans, self.background = langs, weights, trans, background

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The posterior of every language at every word, and each text's number of words."""
        return self._words(texts)[:2]

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joined, start, stop, h, counts = cut(texts)
        _, first, place = np.unique(h, return_index=True, return_inverse=True)
        known = [joined[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist())]
        scores = emissions(self.weights, known)[place].astype(np.float32)
        return posteriors(scores, counts[counts > 0], self.trans), counts, seen_shares(known, self.background.known)[place]

    def judge(self, column: pa.Array) -> tuple[list[str], list[float], list[float]]:
        """Language, mean marginal and P(known) of every text."""
        langs, means, known = ["und"] * len(column), [0.0] * len(column), [0.0] * len(column)
        for a, _, texts in text_chunks(column, BATCH_BYTES) if self.langs else []:
            post, counts, share = self._words(texts)
            some = np.flatnonzero(counts)
            if not len(some):
                continue
            n = counts[some]
            begin = np.cumsum(n) - n
            mean = np.add.reduceat(post.astype(np.float64), begin, axis=0) / n[:, None]
            best = mean.argmax(axis=1)
            chance = self.background.chance(np.add.reduceat(np.nan_to_num(share), begin),
                                            np.add.reduceat((~np.isnan(share)).astype(np.int64), begin), best)
            for i, lang, m, p in zip(some.tolist(), best.tolist(), mean.max(axis=1).tolist(), chance.tolist()):
                langs[a + i], means[a + i], known[a + i] = self.langs[lang], min(1.0, m), p
        return langs, means, known

    def predict(self, column: pa.Array) -> tuple[list[str], list[float]]:
        langs, means, known = self.judge(column)
        return langs, [m * p for m, p in zip(means, known)]


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int,
                    sample_words: int, max_langs: int = 200) -> list[tuple[str, str]]:
    """(text, language) of the ``sample_docs`` documents of each language with the smallest id hash; texts are cut
    to their middle (about ``sample_words`` words) before they leave the tasks. Over ``max_langs`` languages is an error.

    One pass counts the languages, one keeps the hashes under a bound that about twice as many documents as needed
    pass in each language, and ranks those. A language that comes out short (its rows share few ids) is drawn alone.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) \
        .filter("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy("lang").limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not counts:
        return []
    width = 12 * sample_words
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - width) / 2)).cast("int")
    share = {lang: min(1.0, (2 * sample_docs + 50) / n) for lang, n in counts.items()}
    bound = F.get(F.array(*[F.lit(int(-2 ** 63 + v * (2 ** 64 - 1)) if v < 1 else 2 ** 63 - 1) for v in share.values()]),
                  F.array_position(F.array(*[F.lit(k) for k in share]), F.col("lang")).cast("int") - 1)
    h = F.xxhash64("id")
    place = F.row_number().over(W.partitionBy("lang").orderBy("h", "piece"))
    found: dict[str, list[str]] = {lang: [] for lang in counts}
    for r in (rows.filter(h <= bound).select("lang", h.alias("h"), F.substr("text", middle, F.lit(width)).alias("piece"))
              .withColumn("place", place).filter(F.col("place") <= sample_docs).select("lang", "piece").collect()):
        found[r[0]].append(r[1])
    out = []
    for lang, n in counts.items():
        pieces = found[lang]
        if len(pieces) < min(n, sample_docs):
            own = hash_sample(rows.filter(F.col("lang") == lang), [F.col("id")], sample_docs)
            pieces = [r[0] for r in own.select(F.substr("text", middle, F.lit(width))).collect()]
        out += [(piece, lang) for piece in sorted(pieces)]
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_docs: int = 400, sample_words: int = 120):
    return train(labelled_sample(docs, id_col, text_col, lang_col, sample_docs, sample_words), sample_words)


def label(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """``docs`` with two further columns, ``lang_pred`` and ``lang_score`` (replaced if there)."""
    docs = docs.drop("lang_pred", "lang_score")
    at = docs.columns.index(text_col)
    langs, weights, trans, background = model
    packed = docs.sparkSession.sparkContext.broadcast((langs, weights.astype(np.float32), trans, background))

    def run(batches):
        labeller = Labeller(*packed.value)
        for batch in batches:
            pred, score = labeller.predict(batch.column(at))
            yield pa.record_batch([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                  names=[*batch.schema.names, "lang_pred", "lang_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, fields + ", lang_pred string, lang_score double")


def keep_known(docs: DataFrame, model, min_known: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose language the model knows, unchanged: not ``und`` and P(known) at least ``min_known``.

    The marginals take no part, so texts that mix several known languages stay.
    """
    at = docs.columns.index(text_col)
    langs, weights, trans, background = model
    packed = docs.sparkSession.sparkContext.broadcast((langs, weights.astype(np.float32), trans, background))

    def run(batches):
        labeller = Labeller(*packed.value)
        for batch in batches:
            pred, _, known = labeller.judge(batch.column(at))
            yield batch.filter(pa.array([p != "und" and k >= min_known for p, k in zip(pred, known)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
