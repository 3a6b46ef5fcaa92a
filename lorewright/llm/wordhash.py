"""Words of whole text batches as 64-bit hashes, computed column-wise with NumPy.

A word is a maximal run of letters and digits after NFKC, without invisible format characters (category Cf), in lower
case. A batch of texts is handled as one array of code points, so the cost per character is a few array passes and
no Python object is made per word. Hashes depend only on the word, never on process, batch or position.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

_SEP = "﷐"  # a noncharacter; stands between texts and is a blank inside them
_U = np.uint64


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: 0 neither, 1 letter or digit, 2 format character; and whether it is a blank."""
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    blank = np.zeros(sys.maxunicode + 1, bool)
    for i in range(0x30000):
        c = chr(i)
        if c.isalnum():
            kind[i] = 1
        elif unicodedata.category(c) == "Cf":
            kind[i] = 2
        blank[i] = c.isspace()
    for i in range(0x30000, 0x3FFFF):
        kind[i] = chr(i).isalnum()
    kind[0xE0001] = 2
    kind[0xE0020:0xE0080] = 2
    return kind, blank


def blanks() -> np.ndarray:
    """Boolean table over code points: white space."""
    return _tables()[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift-multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def normalize(text: str) -> str:
    if text.isascii():
        return text
    return text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)


@lru_cache(8)
def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, _U(base), _U)
    p[0] = _U(1)
    return np.multiply.accumulate(p)


@lru_cache(1)
def _values() -> np.ndarray:
    """A mixed 64-bit value per code point."""
    return mix(np.arange(sys.maxunicode + 1, dtype=_U) + _U(0x9E3779B97F4A7C15))


def word_hashes(texts: list[str | None], part: int = 120_000) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the words of text i are hashes[offsets[i]:offsets[i + 1]], in order. Null counts as empty.

    Texts are joined to parts of about ``part`` characters to bound memory; a longer text is a part of its own."""
    counts, hashes, at = [], [], 0
    while at < len(texts):
        n, to = 0, at
        while to < len(texts) and (to == at or n + len(texts[to] or "") <= part):
            n += len(texts[to] or "") + 1
            to += 1
        c, h = _part(texts[at:to])
        counts.append(c)
        hashes.append(h)
        at = to
    offsets = np.zeros(len(texts) + 1, np.int64)
    if counts:
        np.cumsum(np.concatenate(counts), out=offsets[1:])
    return offsets, np.concatenate(hashes) if hashes else np.zeros(0, _U)


def _part(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    joined = _SEP.join([normalize(t.replace(_SEP, " ")) if t else "" for t in texts])
    cp = code_points(joined.lower())
    kind = _tables()[0][cp]
    if (kind == 2).any():
        keep = kind != 2
        cp, kind = cp[keep], kind[keep]
    is_word = kind == 1
    edge = np.diff(is_word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(np.flatnonzero(cp == ord(_SEP)), start)
    counts = np.bincount(doc, minlength=len(texts))
    if not len(start):
        return counts, np.zeros(0, _U)
    # a polynomial over mixed code points; the prefix sums are taken once, each word is shifted back to position 0
    n = len(cp)
    size = max(1 << 18, 1 << (n - 1).bit_length())
    total = np.zeros(n + 1, _U)
    np.cumsum(_values()[cp] * _powers(size, _B)[:n], out=total[1:])
    h = (total[end] - total[start]) * _powers(size, _BINV)[start]
    return counts, mix(h + (end - start).astype(_U))


def ngrams(offsets: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of the n-word sequences of each text."""
    counts = np.maximum(np.diff(offsets) - (n - 1), 0)
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=out[1:])
    if len(words) < n:
        return out, np.zeros(0, _U)
    m = len(words) - n + 1
    h = np.zeros(m, _U)
    for i in range(n):
        h = mix(h * _U(3) + words[i : i + m] + _U(i + 1))
    # an n-gram counts where it ends in the text in which it starts
    at = np.repeat(offsets[:-1], counts) + (np.arange(int(out[-1])) - np.repeat(out[:-1], counts))
    return out, h[at]


def distinct_rows(offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) with each text's values distinct and ascending."""
    v = values.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a > 1:
            v[a:b].sort()
    r = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = np.ones(len(v), bool)
    keep[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    r, v = r[keep], v[keep]
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(r, minlength=len(offsets) - 1), out=out[1:])
    return out, v
