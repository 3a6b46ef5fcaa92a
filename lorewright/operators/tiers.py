"""Reproducible tiers of documents: per source all, the longest, or a keyed random sample, cumulative over tiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """What a tier adds: ``all``, ``random`` or ``length`` (longest by tokens) documents per source, n of them; source and
    path_prefix narrow it."""

    tier: int
    rule: str
    n: int = 0
    source: str | None = None
    path_prefix: str = ""


def sample_rank(key: str, seed: int) -> Column:
    """A pseudo-random order that depends on seed and key alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def keyed_sample(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows per group without replacement; the filter on row_number runs as a limit per group before the shuffle."""
    w = Window.partitionBy(group).orderBy(sample_rank(key, seed), key)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def first_tiers(df: DataFrame, spec: list[Rule], seed: int = 42, key: str = "doc_id", source: str = "source", path: str = "rel_path", length: str = "n_tokens") -> DataFrame:
    """(source, key, first_tier) of all documents that some rule takes. A rule's share of each source is cut down before it
    is shuffled; the tiers are united by their least number."""
    found = []
    for r in spec:
        d = df if r.source is None else df.where(F.col(source) == r.source)
        if r.path_prefix:
            d = d.where(F.col(path).startswith(r.path_prefix))
        if r.rule == "random":
            d = keyed_sample(d, source, key, r.n, seed)
        elif r.rule == "length":
            w = Window.partitionBy(source).orderBy(F.desc(length), key)
            d = d.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= r.n)
        elif r.rule != "all":
            raise ValueError(f"unknown rule {r.rule!r}")
        found.append(d.select(source, key, F.lit(r.tier).alias("tier")))
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    return out.groupBy(source, key).agg(F.min("tier").alias("first_tier"))


def members(first: DataFrame, tiers: int, source: str = "source", key: str = "doc_id") -> DataFrame:
    """(tier, source, key): every tier holds the documents of those before it."""
    return first.select(F.explode(F.sequence("first_tier", F.lit(tiers))).alias("tier"), source, key)


def minus(first: DataFrame, tiers: int, less: int = 1, source: str = "source", key: str = "doc_id") -> DataFrame:
    """Members of each later tier that are not in tier ``less``."""
    return members(first.where(F.col("first_tier") > less), tiers, source, key).where(F.col("tier") > less)
