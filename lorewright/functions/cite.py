"""Citation markers: parsing, rewriting and sentence spans, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorewright.functions import ranges

_CLUE = r"\[Clue\s+([^\]]+)\]"
_DOC = r"\[Doc ([^\]]*?),\s*Sen ([^\]]*)\]"


def citations(text: Column) -> Column:
    """``[Doc d, Sen a, b-c]`` markers as an array of (doc, sens); sens sorted, reversed ranges skipped. A doc id ends at the
    first ``, Sen`` and holds no bracket; one doc may occur in several elements."""
    return F.zip_with(
        F.regexp_extract_all(text, F.lit(_DOC), F.lit(1)),
        F.regexp_extract_all(text, F.lit(_DOC), F.lit(2)),
        lambda d, s: F.struct(F.trim(d).alias("doc"), ranges.expand_strict(s).alias("sens")),
    )


def clue_ids(text: Column) -> Column:
    """Sorted distinct ids of all ``[Clue ...]`` markers."""
    return ranges.expand(F.array_join(F.regexp_extract_all(text, F.lit(_CLUE), F.lit(1)), ","))


def sentence_ids(text: Column) -> Column:
    """Sorted distinct ids of all ``[Sen ...]`` markers."""
    return ranges.expand(F.array_join(F.regexp_extract_all(text, F.lit(r"\[Sen\s+([^\]]+)\]"), F.lit(1)), ","))


def rewrite_clues(text: Column, clues: Column) -> Column:
    """Replace ``[Clue ...]`` by ``[Doc d, Sen ...]`` markers. clues: array of struct(clue, doc, sens). Documents are in
    order, sentences merged per document; a marker without a known clue stays as it is."""

    def marker(m: Column) -> Column:
        ids = ranges.expand_strict(F.regexp_extract(m, _CLUE, 1))
        hit = F.filter(clues, lambda c: F.array_contains(ids, c["clue"]))
        docs = F.array_sort(F.array_distinct(F.transform(hit, lambda c: c["doc"])))

        def one(d: Column) -> Column:
            sens = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(hit, lambda c: c["doc"] == d), lambda c: c["sens"]))))
            return F.concat(F.lit("[Doc "), d, F.lit(", Sen "), ranges.compress_citations(sens), F.lit("]"))

        return F.when(F.size(docs) > 0, F.array_join(F.transform(docs, one), "")).otherwise(m)

    parts = F.split(text, r"\[Clue\s+[^\]]+\]", -1)
    markers = F.transform(F.regexp_extract_all(text, F.lit(_CLUE), F.lit(0)), marker)
    return F.array_join(F.zip_with(parts, markers, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
