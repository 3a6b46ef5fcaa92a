"""Problem 7: texts filled into containers of a fixed number of tokens.

Bounded-space online best-fit: a task keeps a fixed number of open containers. A bitset has a bit per amount of free space;
one shift and one lowest-bit look-up give the container that an item fits best. Where nothing fits and all containers are
open, the fullest closes. An item is cut only if it alone exceeds a container: to whole containers and a remainder.

Every task packs the rows it reads, in their order, so there is no shuffle and a repeated task gives the same result; each
task leaves at most ``open_bins`` containers partly filled.

Defined results: null and empty texts have no tokens and no container (one row, container null); ties between containers
of equal free space go to the one filled last; repeated rows are packed as often as they come; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.functions.text import encoding

#: pre-tokenization pattern that belongs to the default vocabulary (see its folder)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def tokenizer(path: str = TOKENIZER, pattern: str = PATTERN):
    """A byte-level BPE from a file of ranks."""
    return encoding(path, pattern)


class BestFit:
    """Open containers keyed by free space."""

    def __init__(self, capacity: int, open_bins: int, name: str):
        self.capacity, self.open_bins, self.name = capacity, open_bins, name
        self.mask, self.open, self.made = 0, 0, 0
        self.at: dict[int, list[int]] = {}

    def put(self, size: int) -> str:
        """The container of an item of that size (1 to capacity)."""
        rest = self.mask >> size
        if rest:
            free = size + (rest & -rest).bit_length() - 1
            one = self._take(free)
        else:
            if self.open == self.open_bins:  # the fullest closes
                self._take((self.mask & -self.mask).bit_length() - 1)
                self.open -= 1
            one, free = self.made, self.capacity
            self.made += 1
            self.open += 1
        free -= size
        if free:
            self.at.setdefault(free, []).append(one)
            self.mask |= 1 << free
        else:
            self.open -= 1
        return f"{self.name}-{one}"

    def _take(self, free: int) -> int:
        stack = self.at[free]
        one = stack.pop()
        if not stack:
            del self.at[free]
            self.mask &= ~(1 << free)
        return one


def pack(df: DataFrame, key: str, text: str, capacity: int = 2048, open_bins: int = 256, path: str = TOKENIZER, pattern: str = PATTERN, run_name: str = "") -> DataFrame:
    """(key, piece, token_start, n_tokens, container): where each text, or each piece of a text longer than a container, goes.
    Containers are named by task and number; ``run_name`` sets apart runs that go to one table. path: a file of ranks that
    every executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = tokenizer(path, pattern)
        bins = BestFit(capacity, open_bins, f"{run_name}{TaskContext.get().partitionId()}")
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[tuple] = []
            for k, t in zip(ids, texts):
                n = len(enc.encode_ordinary(t)) if t else 0
                if not n:
                    out.append((k, 0, 0, 0, None))
                for piece, at in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - at)
                    out.append((k, piece, at, size, bins.put(size)))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out), kinds)], names=[key, "piece", "token_start", "n_tokens", "container"])

    return df.select(F.col(key).cast("bigint").alias(key), F.col(text)).mapInArrow(run, f"`{key}` bigint, piece int, token_start bigint, n_tokens int, container string")


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(containers, tokens, fill): how many containers, and the share of their room that is used."""
    per = packed.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * capacity)).alias("fill"))


def checks(packed: DataFrame, key: str, capacity: int = 2048) -> DataFrame:
    """(key, pieces_right): whether a text lies in containers whole, or cut to full ones and a remainder, none overfull."""
    used = packed.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("used"))
    p = packed.join(used, "container", "left")
    return p.groupBy(key).agg(
        F.bool_and((F.coalesce("used", F.lit(0)) <= capacity) & (F.col("token_start") == F.col("piece") * capacity) & (F.col("container").isNotNull() == (F.col("n_tokens") > 0))).alias("right"),
        F.count_if((F.col("n_tokens") < capacity)).alias("short"),
    ).select(key, (F.col("right") & (F.col("short") <= 1)).alias("pieces_right"))
