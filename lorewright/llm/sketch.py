"""Token frequency classes from a count sketch of fixed size over all rows.

Each task counts its tokens in 2**bits buckets; the counts are added up by block of buckets in two steps and come to the
driver as one byte per bucket: the frequency class round(2 * log2(count)). A bucket may hold several tokens, so a class is
never too low. Orders and filters built on it are exact whatever the collisions; only their cost depends on them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK = 1 << 14


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def frequency_classes(texts: DataFrame, tokens: Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]], bits: int = 20) -> np.ndarray:
    """Class per bucket (uint8). texts: one string column; tokens: texts to (offsets, hashes), distinct per text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            _, h = tokens(b.column(0).to_pylist())
            c = np.bincount(bucket(h, bits), minlength=1 << bits)
            total = c if total is None else total + c
        if total is not None:
            part = TaskContext.get().partitionId() % 64
            blocks = [zlib.compress(x.astype(np.int64).tobytes(), 1) for x in total.reshape(-1, min(_BLOCK, 1 << bits))]
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(blocks)), pa.int32()), "part": pa.array([part] * len(blocks), pa.int32()), "counts": pa.array(blocks, pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for x in pdf["counts"]:
            total = total + np.frombuffer(zlib.decompress(x), np.int64)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": pdf["part"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "block int, part int, counts binary"
    parts = texts.mapInArrow(count, schema).groupBy("block", "part").applyInPandas(add, schema)
    rows = parts.groupBy("block").applyInPandas(add, schema).collect()  # 2**bits counters in all
    out = np.zeros(1 << bits, np.int64)
    size = min(_BLOCK, 1 << bits)
    for r in rows:
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return np.minimum(np.round(2 * np.log2(np.maximum(out, 1))), 255).astype(np.uint8)


def ranked(offsets: np.ndarray, h: np.ndarray, classes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, class) of all tokens, each row's tokens from rare to frequent, ties by hash. h ascends within each row."""
    cls = classes[bucket(h, bits)]
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    order = np.argsort((row << 8) | cls, kind="stable")
    return order, cls


def text_column(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.col(text).cast("string"))
