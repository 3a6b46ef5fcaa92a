"""Exact vector search for a stated query set, rank metrics, negatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.storage import materialize


def usable_vectors(df: DataFrame, vector: str, dim: int) -> Column:
    """Whether a vector has the right length, no missing or infinite value, and is not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(col: pa.Array, dim: int, unit: bool) -> np.ndarray:
    x = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if unit else x


def _keep_best(q: np.ndarray, d: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score, then smaller id) of each query."""
    order = np.lexsort((d, -s, q))
    q, d, s = q[order], d[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], d[keep], s[keep]


def top_k(queries: DataFrame, docs: DataFrame, key: str, vector: str, dim: int, k: int = 20, scale: float = 100.0, cosine: bool = False, others: bool = True, block: int = 8192) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query by inner product (times ``scale``) or cosine.

    Queries are dealt to blocks of about ``block``; a task holds one block and its best documents so far and reads all
    documents as a stream, so neither queries nor documents pass the driver. Ties go to the smaller id. others: a query never
    finds the document with its own id. Vectors must be usable."""
    row = lambda d: d.select(F.col(key).cast("bigint").alias("d"), F.col(vector).cast("array<double>").alias("v")).dropDuplicates(["d"])
    q = materialize(row(queries), "queries")
    parts = max(1, -(-q.count() // block))
    seen = q.select(F.pmod(F.xxhash64("d"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "d", "v").unionByName(
        row(docs).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "d", "v")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, x = None, np.zeros(0, np.int64), np.zeros((0, dim))
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        best, floor = none, np.zeros(0)

        def out() -> Iterator[pa.RecordBatch]:
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "doc_id", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            p, kind, own, y = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3), dim, cosine)
            edges = np.flatnonzero((np.diff(p) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(p)]):
                if p[s] != part:
                    yield from out()
                    part, ids, x, best = p[s], np.zeros(0, np.int64), np.zeros((0, dim)), none
                if kind[s] == 0:
                    ids, x = np.concatenate([ids, own[s:e]]), np.concatenate([x, y[s:e]])
                    floor = np.full(len(ids), -np.inf)  # the score of each query's k-th best
                    continue
                got = [best]
                for i in range(0, len(ids), 1024):
                    m = (x[i : i + 1024] @ y[s:e].T) * scale
                    if others:
                        m[ids[i : i + 1024, None] == own[None, s:e]] = -np.inf
                    r, c = np.nonzero((m >= floor[i : i + 1024, None]) & np.isfinite(m))
                    got.append(_keep_best(r + i, own[s:e][c], m[r, c], k))
                best = _keep_best(*(np.concatenate(z) for z in zip(*got)), k)
                count = np.bincount(best[0], minlength=len(ids))
                full = count == k
                floor[full] = best[2][np.cumsum(count)[full] - 1]
        yield from out()

    found = seen.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(run, "query_id bigint, doc_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


# metrics on ranked lists held in arrays


def hit_at(ranked: Column, gold: Column, k: int) -> Column:
    return F.array_contains(F.slice(ranked, 1, k), gold)


def all_in_top(ranked: Column, gold: Column, k: int) -> Column:
    return F.size(F.array_except(gold, F.slice(ranked, 1, k))) == 0


def overlap_at(ranked: Column, gold: Column, k: int) -> Column:
    """Shared documents over the smaller of the two counts; null where either is empty."""
    top = F.slice(ranked, 1, k)
    return F.size(F.array_intersect(top, gold)) / F.nullif(F.least(F.size(top), F.size(gold)), F.lit(0))


def ndcg_at(ranked: Column, gold: Column, k: int) -> Column:
    """Binary relevance; the ideal has all gold documents first; 0 without gold. Shorter lists count the ranks there are."""
    gain = F.aggregate(F.transform(F.slice(ranked, 1, k), lambda d, i: F.when(F.array_contains(gold, d), 1 / F.log2((i + 2).cast("double"))).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    n = F.least(F.size(gold), F.lit(k))
    best = F.aggregate(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: 1 / F.log2((i + 1).cast("double"))), F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(gain / F.nullif(best, F.lit(0.0)), F.lit(0.0))


def complete_positives(positives: DataFrame, docs: DataFrame, query: str, doc: str) -> DataFrame:
    """Pairs of queries all of whose positive documents exist."""
    known = docs.select(doc).distinct().withColumn("_known", F.lit(1))
    p = positives.select(query, doc).distinct().join(known, doc, "left")
    whole = p.groupBy(query).agg(F.count("*").alias("_n"), F.count("_known").alias("_m")).where("_n = _m").select(query)
    return p.drop("_known").join(whole, query, "left_semi")


def hard_negatives(found: DataFrame, positives: DataFrame, n: int) -> DataFrame:
    """(query_id, doc_id, rank, negative): of the 3n nearest documents of each query the n nearest that are no positives;
    queries left with fewer are dropped. found: top_k result; positives: (query_id, doc_id)."""
    near = found.where(F.col("rank") <= 3 * n).join(positives.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")
    w = Window.partitionBy("query_id")
    ranked = near.withColumn("negative", F.row_number().over(w.orderBy("rank"))).withColumn("_n", F.count("*").over(w))
    return ranked.where((F.col("negative") <= n) & (F.col("_n") >= n)).select("query_id", "doc_id", "rank", "negative")


def margin_loss(positive: Column, negative: Column, margin: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), margin - (positive - negative))
