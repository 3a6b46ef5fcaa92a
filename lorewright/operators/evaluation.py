"""Scores of citations and answers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def citation_counts(generated: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(key, both, only_generated, only_gold) of distinct (doc, sen) citations. One full outer join, pre-aggregated sides."""
    g = generated.select(key, "doc", "sen").distinct().withColumn("g", F.lit(1))
    s = gold.select(key, "doc", "sen").distinct().withColumn("s", F.lit(1))
    j = g.join(s, [key, "doc", "sen"], "full_outer")
    return j.groupBy(key).agg(F.count_if(F.col("g").isNotNull() & F.col("s").isNotNull()).alias("both"), F.count_if(F.col("s").isNull()).alias("only_generated"), F.count_if(F.col("g").isNull()).alias("only_gold"))


def prf(both: Column, only_generated: Column, only_gold: Column) -> dict[str, Column]:
    """precision, recall and f1, 0 where undefined."""
    p = F.coalesce(both / F.nullif(both + only_generated, F.lit(0)), F.lit(0.0))
    r = F.coalesce(both / F.nullif(both + only_gold, F.lit(0)), F.lit(0.0))
    return {"precision": p, "recall": r, "f1": F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))}


def similar_ids(a: str, b: str, most: int = 2) -> bool:
    """At most ``most`` differing places, the gap in length included."""
    gap = abs(len(a) - len(b))
    return gap <= most and gap + sum(x != y for x, y in zip(a, b)) <= most


def fuzzy_counts(generated: dict[str, set[int]], gold: dict[str, set[int]], most: int = 2) -> tuple[int, int, int]:
    """Counts with forgiven document ids: equal ids count their common sentences only; ids left over are matched one to one,
    first come first served in id order, and of these the differences count, too."""
    left, right = sorted(generated.keys() - gold.keys()), sorted(gold.keys() - generated.keys())
    both = sum(len(generated[d] & gold[d]) for d in generated.keys() & gold.keys())
    more = less = 0
    for d in left:
        m = next((x for x in right if similar_ids(d, x, most)), None)
        if m is not None:
            right.remove(m)
        other = gold[m] if m is not None else set()
        both += len(generated[d] & other)
        more += len(generated[d] - other)
        less += len(other - generated[d])
    return both, more, less + sum(len(gold[d]) for d in right)


def fuzzy_citation_counts(df: DataFrame, key: str, generated: str, gold: str) -> DataFrame:
    """(key, both, only_generated, only_gold) by fuzzy_counts. generated and gold: array of (doc, sens)."""
    kind = df.schema[key].dataType.simpleString()

    def as_sets(x) -> dict[str, set[int]]:
        out: dict[str, set[int]] = {}
        for c in x or ():
            out.setdefault(c["doc"], set()).update(c["sens"])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fuzzy_counts(as_sets(g), as_sets(s)) for g, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[key, "both", "only_generated", "only_gold"])

    return df.select(key, generated, gold).mapInArrow(run, f"`{key}` {kind}, both bigint, only_generated bigint, only_gold bigint")


def percent(score: Column) -> Column:
    """Mean score in percent with two decimals."""
    return F.round(F.avg(score) * 100, 2)


def consistency(total: Column, sentences: Column) -> Column:
    """Judged sentences over gold sentences, null without any."""
    return total / F.nullif(sentences, F.lit(0))


def leave_one_out(clues: Column) -> Column:
    """One numbered list per clue, each without that clue and numbered anew."""
    from lorewright.functions.text import numbered

    return F.transform(clues, lambda x, i: F.struct((i + 1).alias("removed"), numbered(F.filter(clues, lambda y, j: j != i)).alias("prompt")))
