"""Problem 2: oversized texts cut to pieces at natural boundaries, with overlap.

Every boundary has a strength (paragraph 5, line 4, sentence end 3, clause 2, blank 1). The strongest cut of each
permissible length window comes from a sparse-table range-maximum index over the boundaries of the text, ties going to the
right; the next piece starts an overlap further back, itself at the strongest boundary near that point.

Defined results: null, empty and short texts give no pieces; a window without any boundary is cut at the limit (forced); the
overlap is less where the end of a run of nearly the limit comes into reach by that, and none only where the run has exactly
the limit; lengths are Unicode code points; every character lies in a piece, no piece exceeds the limit; repeated rows of a key give the same
pieces, returned once. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm import wordhash as wh

_STOP = np.array([ord(c) for c in "。！？"], np.uint32)
_SENTENCE = np.array([ord(c) for c in ".!?…"], np.uint32)
_CLAUSE = np.array([ord(c) for c in ",;:，；：、"], np.uint32)


class RangeMax:
    """Sparse table over int64 values: the maximum of any range in two look-ups."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        n, w = len(values), 1
        while 2 * w <= n:
            prev = self.levels[-1]
            self.levels.append(np.maximum(prev[: n - 2 * w + 1], prev[w : n - w + 1]))
            w *= 2

    def query(self, a: int, b: int) -> int:
        """Maximum of values[a:b], a < b."""
        k = (b - a).bit_length() - 1
        t = self.levels[k]
        return int(max(t[a], t[b - (1 << k)]))


def boundaries(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, strengths) of the cuts inside a text of code points; position i lies before character i."""
    blank = wh.blanks()[np.minimum(cp, 0x10FFFF)]
    nl = cp == 10
    n = len(cp)
    s = np.zeros(n + 1, np.int8)
    after = np.zeros(n + 1, bool)
    after[1:] = blank  # a cut stands after a blank
    s[after] = 1
    prev_clause = np.isin(cp, _CLAUSE)
    prev_stop = np.isin(cp, _SENTENCE)
    s[2:][blank[1:] & prev_clause[:-1]] = 2
    s[2:][blank[1:] & prev_stop[:-1]] = 3
    s[1:][np.isin(cp, _STOP)] = 3
    s[1:][nl] = 4
    s[2:][nl[1:] & nl[:-1]] = 5
    # before a blank, too, so that a run of exactly the limit still ends at a boundary
    before = np.flatnonzero(blank)
    s[before] = np.maximum(s[before], 1)
    at = np.flatnonzero(s[:n])
    at = at[at > 0]
    return at, s[at]


def longest_run(cp: np.ndarray) -> int:
    """Most characters in a row without white space and without any of 。！？."""
    stops = np.flatnonzero(wh.blanks()[np.minimum(cp, 0x10FFFF)] | np.isin(cp, _STOP))
    edges = np.concatenate(([-1], stops, [len(cp)]))
    return int((np.diff(edges) - 1).max())


def cut(cp: np.ndarray, limit: int = 4000, overlap: int = 200, least: float = 0.5) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of the pieces. A cut is sought in the window [least * limit, limit] after the start, and only
    where that holds no boundary nearer to the start."""
    n = len(cp)
    if n <= limit:
        return [(0, n, False)] if n else []
    at, strength = boundaries(cp)
    key = strength.astype(np.int64) * (n + 1) + at  # the maximum is the strongest, of these the rightmost
    index = RangeMax(key) if len(key) else None

    def strongest(lo: int, hi: int) -> int | None:
        a, b = np.searchsorted(at, lo), np.searchsorted(at, hi, "right")
        return index.query(int(a), int(b)) % (n + 1) if index is not None and a < b else None

    pieces, start, done = [], 0, 0  # done: characters before it are in a piece
    while True:
        if n - start <= limit:
            pieces.append((start, n, False))
            return pieces
        lo = max(start + int(limit * least), done + 1)
        end = strongest(lo, start + limit)
        if end is None:
            end = strongest(max(start + 1, done + 1), start + limit)
        if end is None and start < done and not pieces[-1][2]:
            after = int(np.searchsorted(at, done, "right"))
            run = int(at[after]) if after < len(at) else n  # the end of the run that begins at the last cut
            if run - done <= limit:  # with less overlap it is in reach
                start = strongest(run - limit, done - 1) or run - limit
                continue
        forced = end is None
        if forced:
            end = start + limit
        pieces.append((start, end, forced))
        done = end
        back = strongest(max(start + 1, end - overlap - overlap // 4), end - overlap + overlap // 4) if overlap else end
        start = max(start + 1, end - overlap) if back is None else back


def split_texts(df: DataFrame, key: str, text: str, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """(key, piece, start_pos, end_pos, piece_text, cut_kind, kind): the pieces of each text longer than limit, in order.

    cut_kind says how the piece ends (natural, forced, end); kind is forced for all pieces of a text that holds more than
    limit characters in a row without a place to cut, else natural. Rows are cut where they are read, without a shuffle."""
    schema = f"`{key}` bigint, piece int, start_pos int, end_pos int, piece_text string, cut_kind string, kind string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cp = wh.code_points(t)
                kind = "forced" if longest_run(cp) > limit else "natural"
                pieces = cut(cp, limit, overlap)
                for i, (s, e, forced) in enumerate(pieces):
                    how = "end" if i == len(pieces) - 1 else "forced" if forced else "natural"
                    out.append((k, i, s, e, t[s:e], how, kind))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f) for c, f in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()))],
                    names=[key, "piece", "start_pos", "end_pos", "piece_text", "cut_kind", "kind"],
                )

    return df.select(F.col(key).cast("bigint"), F.col(text)).where(F.length(text) > limit).mapInArrow(run, schema)


def oversized(df: DataFrame, key: str, text: str, limit: int = 4000) -> DataFrame:
    """(key, kind) of the texts that split_texts cuts."""
    return split_texts(df, key, text, limit).where("piece = 0").select(key, "kind").distinct()
