"""NumPy helpers on whole batches of texts: rolling hashes, words, shingles, coverage.

All run inside tasks on one Arrow batch at a time. Arrays are processed in chunks of at most
``CHUNK`` bytes, so memory does not grow with a batch or with one very long text.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20
_M = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.empty(size, np.uint64)
        out[0] = 1
        k = 1
        while k < size:  # doubling: the second half is the first times base**k
            m = min(k, size - k)
            np.multiply(out[:m], np.uint64(pow(base, k, 1 << 64)), out=out[k:k + m])
            k += m
        _powers[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table(seed: int, n: int = 256) -> np.ndarray:
    """A random 64-bit value for each symbol."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64((0xD1342543DE82EF95 * (2 * seed + 1)) & _M))


BYTE = table(1)


def prefix(values: np.ndarray) -> np.ndarray:
    """Running sums of values[k] * BASE**k, with a zero in front. ``values`` is overwritten."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    values *= powers(BASE, len(values))
    np.cumsum(values, out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each span, wherever it stands."""
    h = (sums[stop] - sums[start]) * powers(INVERSE, len(sums))[start]
    return mix(h + (stop - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


# ---- words -------------------------------------------------------------------------------------
# A word is a run of ASCII letters, digits and non-ASCII characters, with A-Z in lower case: the
# bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing. Bytes of a multi-byte character are
# all 0x80 or more, so words of bytes are words of characters.

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IN_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
#: Turns every byte outside words into a space and lowers the rest.
TO_WORDS = bytes(_LOWER[c] if _IN_WORD[_LOWER[c]] else 32 for c in range(256))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and how many words each text has."""
    joined = b"\x00".join(texts).translate(_LOWER) + b"\x00"
    raw = np.frombuffer(joined, np.uint8)
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[1:] = _IN_WORD[raw]
    edges = np.flatnonzero(np.diff(inside))
    start, stop = edges[0::2], edges[1::2]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    counts = np.diff(np.searchsorted(start, ends, "left"), prepend=0)
    if not len(start):
        return np.empty(0, np.uint64), counts
    return spans(prefix(BYTE[raw]), start, stop), counts


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word-shingle hashes of each text, sorted within it, and how many each has.

    A text of fewer words, but not none, has one shingle: all its words.
    """
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    begin = ends - counts
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    owner = np.repeat(np.arange(len(texts)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[owner]
    h = np.zeros(len(place), np.uint64)
    for k in range(width):
        ok = place + k < ends[owner]
        at = np.minimum(place + k, max(len(words) - 1, 0))
        add = mix(words[at] + np.uint64(k + 1)) * np.uint64(pow(BASE, k + 1, 1 << 64)) if len(words) else h
        h += np.where(ok, add, np.uint64(0))
    h = mix(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[first], owner[first]
    return h, np.bincount(owner, minlength=len(texts))


# ---- coverage ----------------------------------------------------------------------------------

def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of ``width`` that begins at one of the starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[0::2], edge[1::2]
