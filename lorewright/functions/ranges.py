"""Id lists such as ``3-5,9``: expand, compress, count. All are column expressions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = r"\d+(?:\s*-\s*\d+)?"
#: ids that one range may stand for; what a model writes beyond it (1-9999999999) is no list of ids and stands for none
WIDEST = 100_000


def _bounds(tok: Column) -> tuple[Column, Column]:
    a = F.regexp_extract(tok, r"^(\d+)", 1).try_cast("bigint")
    b = F.coalesce(F.nullif(F.regexp_extract(tok, r"-\s*(\d+)$", 1), F.lit("")).try_cast("bigint"), a)
    return a, b


def tokens(s: Column) -> Column:
    """The numbers and ranges of a list, as strings in order."""
    return F.regexp_extract_all(s, F.lit(_TOKEN), F.lit(0))


def expand(s: Column) -> Column:
    """Sorted distinct ids; reversed bounds are swapped. Null gives null, no id an empty array."""

    def one(tok: Column) -> Column:
        a, b = _bounds(tok)
        return F.when(F.abs(b - a) < WIDEST, F.sequence(F.least(a, b), F.greatest(a, b))).otherwise(F.array().cast("array<bigint>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens(s), one))))


def expand_strict(s: Column) -> Column:
    """Sorted distinct ids; a range with reversed bounds is skipped."""

    def one(tok: Column) -> Column:
        a, b = _bounds(tok)
        return F.when((a <= b) & (b - a < WIDEST), F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens(s), one))))


def too_wide(s: Column) -> Column:
    """How many ranges of a list are wider than ids can be; expand leaves these out."""

    def wide(tok: Column) -> Column:
        a, b = _bounds(tok)
        return ~F.coalesce(F.abs(b - a) < WIDEST, F.lit(False))

    return F.size(F.filter(tokens(s), wide))


def expanded_count(s: Column) -> Column:
    """How many ids a list stands for, without merging repeats or swapping bounds (a reversed range counts 0 or less)."""

    def one(tok: Column) -> Column:
        a, b = _bounds(tok)
        return b - a + 1

    return F.aggregate(F.transform(tokens(s), one), F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def compress(ids: Column, run: int, sep: str) -> Column:
    """Sorted distinct ids to text; runs of at least ``run`` become ``a-b``."""
    starts = F.filter(ids, lambda x: ~F.array_contains(ids, x - 1))
    ends = F.filter(ids, lambda x: ~F.array_contains(ids, x + 1))

    def text(a: Column, b: Column) -> Column:
        joined = F.concat_ws("-", a.cast("string"), b.cast("string"))
        single = F.array_join(F.sequence(a, b).cast("array<string>"), sep)
        return F.when(b - a + 1 >= run, joined).otherwise(single)

    return F.array_join(F.zip_with(starts, ends, text), sep)


def compress_facts(ids: Column) -> Column:
    """Runs of two or more become ranges, joined by commas."""
    return compress(ids, 2, ",")


def compress_citations(ids: Column) -> Column:
    """Runs of three or more become ranges, joined by comma and blank."""
    return compress(ids, 3, ", ")
