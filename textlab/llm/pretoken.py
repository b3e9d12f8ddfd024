r"""Pre-tokens of byte-level BPE, cut for a whole batch of texts at once with NumPy.

The cuts are those of the public pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+

worked out on arrays of code points: characters fall into letters, numbers, white space and the
rest; a maximal run of one class is a pre-token, with these corrections:
* a run of white space before something else gives its last character away: a plain space goes to
  the next run, any other character is a pre-token of its own; what is left before it is one;
* a lone apostrophe that no space precedes, followed by s, t, re, ve, m, ll or d, takes these
  letters, and the letters after them begin a new pre-token.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow.compute as pc

from textlab.llm.bytesops import prefix, spans, table

_LETTER, _NUMBER, _SPACE, _OTHER, _BREAK = 0, 1, 2, 3, 4
# The code points with the White_Space property.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: np.ndarray | None = None
_values = table(2, 1 << 12)


def classes() -> np.ndarray:
    """The class of every code point, made once per process."""
    global _classes
    if _classes is None:
        kinds = {"L": _LETTER, "N": _NUMBER}
        _classes = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)),
                               np.uint8, 0x110000)
        _classes[_WHITE] = _SPACE
    return _classes


def cut(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pre-tokens of the texts: joined text, starts, ends, hashes, and the count in each text.

    Texts are joined with a NUL between them, which belongs to no pre-token.
    """
    joined = "\x00".join(texts) + "\x00"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    breaks = np.cumsum(sizes + 1) - 1
    kind = classes()[points]
    kind[breaks] = _BREAK
    begin = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == _BREAK))))
    end = np.append(begin[1:], len(points))
    k = kind[begin]
    after = np.append(k[1:], _BREAK)
    start, stop = begin.copy(), end.copy()
    # white space before something else loses its last character
    gives = (k == _SPACE) & (after != _BREAK)
    stop[gives] -= 1
    plain = gives & (points[end - 1] == 32)
    takes = np.append(False, plain[:-1])
    start[takes] -= 1
    alone = gives & ~plain
    # contractions
    quote = np.flatnonzero((k == _OTHER) & (end - begin == 1) & (points[begin] == 39) & ~takes & (after == _LETTER))
    if len(quote):
        a = points[begin[quote] + 1]
        b = points[np.minimum(begin[quote] + 2, len(points) - 1)]
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)  # s t m d
        two = ~one & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))  # re ve ll
        more = one.astype(np.int64) + 2 * two
        stop[quote] += more
        start[quote + 1] += more
    start = np.concatenate((start, end[alone] - 1))
    stop = np.concatenate((stop, end[alone]))
    real = np.concatenate((k != _BREAK, np.ones(int(alone.sum()), bool))) & (stop > start)
    start, stop = start[real], stop[real]
    if alone.any():
        order = np.argsort(start, kind="stable")
        start, stop = start[order], stop[order]
    sums = prefix(_values[points & np.uint32(0xFFF)] + points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    counts = np.diff(np.searchsorted(start, breaks, "left"), prepend=0)
    return joined, start, stop, spans(sums, start, stop) if len(start) else np.empty(0, np.uint64), counts


def distinct(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pre-tokens of the texts, the place among them of every pre-token, and counts."""
    joined, start, stop, h, counts = cut(texts)
    _, first, place = np.unique(h, return_index=True, return_inverse=True)
    return [joined[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist())], place, counts


class Index:
    """Numbers for words met so far, by their 64-bit hashes: a sorted array, 12 bytes a word."""

    def __init__(self):
        self.keys = np.empty(0, np.uint64)
        self.numbers = np.empty(0, np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the hashes, which are new); new ones are numbered on, in the given order."""
        at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        new = self.keys[at] != h if len(self.keys) else np.ones(len(h), bool)
        numbers = np.empty(len(h), np.int32)
        numbers[~new] = self.numbers[at[~new]] if len(self.keys) else 0
        n = int(new.sum())
        if n:
            numbers[new] = np.arange(len(self.keys), len(self.keys) + n)
            keys = np.concatenate((self.keys, h[new]))
            order = np.argsort(keys, kind="stable")  # two sorted runs: a merge
            self.numbers = np.concatenate((self.numbers, numbers[new]))[order]
            self.keys = keys[order]
        return numbers, new


def gather(begin: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Concatenate pieces of ``flat``, given where each begins and how long it is."""
    jump = np.repeat(begin - (np.cumsum(size) - size), size)
    jump += np.arange(len(jump))
    return flat[jump]


def text_chunks(column, size: int = 1 << 20):
    """(a, b, texts) of slices of an Arrow string column with about ``size`` bytes each; null is empty.

    Only one slice at a time is turned into Python strings.
    """
    sizes = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    upto = np.concatenate(([0], np.cumsum(sizes)))
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + size, "right")) - 1)
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]
        a = b
