"""Problem 8: evaluation questions and passages that stand in training documents.

Wu-Manber multi-pattern search over words: the patterns are all sequences of m consecutive words of the test items, a block
is two words. A shift table tells from the block under the window how far the window may jump; where it may not, the suffix
hash selects the patterns of that bucket, and comparison word by word confirms. Many windows of a batch move at once.

The patterns are cut from the items where they are read and dealt by the hash of their last words to parts of about
``max_patterns``, in the shared folder; the tables of one part at a time are built and broadcast, of a size so bounded, and
each part is one more pass over the documents. The shift table has at least four slots for each block. Documents are scanned
where they are read.

Defined results: null and blank documents hold nothing; items with fewer than m words can't leak; a document that holds
several sequences of an item, or an item told twice, gives one row; repeated rows count once; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm import wordhash as wh
from lorewright.storage import materialize

_U = np.uint64
_SHIFT_BITS = 18  # at least


class WuManber:
    """Patterns of m words each; owner[i] is the number of the item that pattern i belongs to."""

    def __init__(self, patterns: np.ndarray, owner: np.ndarray):
        self.m = m = patterns.shape[1]
        order = np.lexsort((owner, self._suffix(patterns)))
        self.patterns, self.owner = patterns[order], owner[order]
        self.suffix = self._suffix(self.patterns)
        self.buckets, self.first = np.unique(self.suffix, return_index=True)
        self.last = np.append(self.first[1:], len(self.suffix))
        self.bits = max(_SHIFT_BITS, int(4 * len(patterns) * (m - 1)).bit_length())
        self.shift = np.full(1 << self.bits, m - 1, np.uint8 if m < 256 else np.int64)
        for j in range(m - 1):  # the block of words j, j + 1 ends m - 2 - j before the end of the window
            # by falling shift, so that the least one stays
            self.shift[self._block(self.patterns[:, j], self.patterns[:, j + 1])] = m - 2 - j

    def _block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (wh.mix(a * _U(3) + b) >> _U(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _suffix(p: np.ndarray) -> np.ndarray:
        """Hash of the last four words."""
        h = p[:, -1].copy()
        for j in range(2, min(5, p.shape[1] + 1)):
            h = wh.mix(h * _U(3) + p[:, -j])
        return h

    def find(self, text: np.ndarray, lane: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(positions, items) of the occurrences; positions are those of the first word."""
        n, m = len(text), self.m
        if n < m or not len(self.patterns):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        jump = self.shift[self._block(text[:-1], text[1:])].astype(np.int64)  # by the first word of the block
        ends = np.arange(m - 1, n, lane)  # each window runs over its lane of end positions
        limit = np.minimum(ends + lane, n)
        at, hits = ends, []
        while len(at):
            s = jump[at - 1]
            stop = s == 0
            if stop.any():
                hits.append(at[stop])
            at = at + np.maximum(s, 1)
            on = at < limit
            at, limit = at[on], limit[on]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.concatenate(hits) - (m - 1)
        suffix = self._suffix(np.stack([text[start + m - 4 + j] if m >= 4 else text[start + j] for j in range(min(4, m))], axis=1))
        slot = np.searchsorted(self.buckets, suffix)
        slot[slot == len(self.buckets)] = 0
        ok = self.buckets[slot] == suffix
        start, slot = start[ok], slot[ok]
        count = self.last[slot] - self.first[slot]
        which = np.repeat(self.first[slot], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        pos = np.repeat(start, count)
        ok = np.ones(len(pos), bool)
        for j in range(m):
            ok &= text[pos + j] == self.patterns[which, j]
        return pos[ok], self.owner[which[ok]]


def item_patterns(items: list[tuple[int, list[str | None]]], m: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, owner): the distinct m-word sequences of each item's texts."""
    texts = [t for _, ts in items for t in ts]
    ids = np.array([i for i, ts in items for _ in ts], np.int64)
    o, w = wh.word_hashes(texts)
    rows, owner = [], []
    for k in range(len(texts)):
        x = w[o[k] : o[k + 1]]
        if len(x) >= m:
            rows.append(np.lib.stride_tricks.sliding_window_view(x, m))
            owner.append(np.full(len(x) - m + 1, ids[k]))
    if not rows:
        return np.zeros((0, m), _U), np.zeros(0, np.int64)
    p, own = np.concatenate(rows), np.concatenate(owner)
    both = np.unique(np.column_stack([p, own.view(_U)]), axis=0)
    return np.ascontiguousarray(both[:, :m]), both[:, m].copy().view(np.int64)


def pattern_parts(items: DataFrame, key: str, texts: list[str], m: int, max_patterns: int) -> list[DataFrame]:
    """The distinct (item, m words as bytes) of all items, in parts of about max_patterns; equal patterns share a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), zip(*(c.to_pylist() for c in b.columns[1:]))))
            for s in range(0, len(rows), 64):
                p, owner = item_patterns(rows[s : s + 64], m)
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array([x.tobytes() for x in p], pa.binary())], names=["item", "pattern"])

    kept = items.select(F.col(key).cast("bigint").alias("_key"), *[F.col(t).cast("string").alias(f"_t{i}") for i, t in enumerate(texts)]).where("_key is not null")
    all_ = materialize(kept.mapInArrow(run, "item bigint, pattern binary").distinct(), "patterns")
    parts = max(1, -(-all_.count() // max_patterns))
    return [all_.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == i) for i in range(parts)]


def leaked_items(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_texts: list[str], m: int = 13, max_patterns: int = 500_000) -> DataFrame:
    """(key, item_key): documents that hold at least m consecutive words of a text of the item."""
    spark = docs.sparkSession
    found = []
    for part in pattern_parts(items, item_key, item_texts, m, max_patterns):
        rows = part.collect()  # about max_patterns x (m + 1) x 8 bytes
        words = np.frombuffer(b"".join(r.pattern for r in rows), _U).reshape(-1, m)
        machine = spark.sparkContext.broadcast(WuManber(words, np.array([r.item for r in rows], np.int64)))

        def run(batches: Iterator[pa.RecordBatch], machine=machine) -> Iterator[pa.RecordBatch]:
            wm = machine.value
            for b in batches:
                o, w = wh.word_hashes(b.column(1).to_pylist())
                # a stranger stands between texts, so that no sequence crosses
                gap = len(o) - 1
                text = np.zeros(len(w) + gap, _U)
                doc = np.repeat(np.arange(gap), np.diff(o))
                text[np.arange(len(w)) + doc] = w
                start = o[:-1] + np.arange(gap)
                pos, item = wm.find(text)
                if not len(pos):
                    continue
                d = np.searchsorted(start, pos, "right") - 1
                hit = np.unique(np.column_stack([d, item]), axis=0)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hit[:, 0])), pa.array(hit[:, 1])], names=[key, item_key])

        kept = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text")).where("_key is not null and _text is not null")
        found.append(kept.mapInArrow(run, f"`{key}` bigint, `{item_key}` bigint"))
    return reduce(DataFrame.union, found).distinct()
