"""Parsers of model output: tagged blocks as column expressions, nested JSON as Arrow UDFs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from lorewright.functions import ranges
from lorewright.functions.text import trimmed


def _all(t: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(t, F.lit(pattern), F.lit(group))


def _one(t: Column, pattern: str, group: int = 1) -> Column:
    """Trimmed group of the first match, null without one."""
    return F.when(t.rlike(pattern), trimmed(F.regexp_extract(t, pattern, group)))


_FACT = r"(?s)<detailed-desc>(.*?)</detailed-desc>\s*<sentences-used>\[Sen\s*([^\]]+)\]</sentences-used>"


def facts(t: Column) -> Column:
    """array of (fact, sens): description, and the sentence numbers as text, runs of two or more as ranges. Numbers are taken
    one by one, so a range given as 1-3 stands for its two ends."""

    def sens(s: Column) -> Column:
        ids = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("bigint"))))
        return ranges.compress_facts(ids)

    return F.zip_with(_all(t, _FACT, 1), _all(t, _FACT, 2), lambda d, s: F.struct(trimmed(d).alias("fact"), sens(s).alias("sens")))


_D = r"<tuple_delimiter>"
_ENTITY = rf'\("entity"{_D}(.*?){_D}(.*?)\)'
_RELATION = rf'\("relationship"{_D}(.*?){_D}(.*?){_D}(.*?){_D}(.*?)\)'


def entities(t: Column) -> Column:
    return F.zip_with(_all(t, _ENTITY, 1), _all(t, _ENTITY, 2), lambda n, d: F.struct(n.alias("entity_name"), d.alias("entity_description")))


def relationships(t: Column) -> Column:
    def numbers(s: Column) -> Column:
        return F.array_join(F.regexp_extract_all(s, F.lit(r"\d+-\d+|\d+"), F.lit(0)), ",")

    cols = F.arrays_zip(*[_all(t, _RELATION, i).alias(f"g{i}") for i in (1, 2, 3, 4)])
    return F.transform(
        cols,
        lambda x: F.struct(
            trimmed(x["g1"]).alias("source_entity_name"),
            trimmed(x["g2"]).alias("target_entity_name"),
            trimmed(x["g3"]).alias("relationship_description"),
            numbers(x["g4"]).alias("sentences_used"),
        ),
    )


def is_complete(t: Column) -> Column:
    return t.contains("<completion_delimiter>")


def questions(t: Column, clue_tag: str = "objective-facts") -> Column:
    """array of (category, question, clues, reasoning, answer): the first whole question of each numbered category; of a
    category that comes again the last one counts; categories without a whole question are dropped."""
    block = r"(?s)\d+\.\s*<([^>]+-questions)>(.*?)(?=\d+\.\s*<[^>]+-questions>|\z)"
    item = rf"(?s)<question>(.*?)</question>\s*<{clue_tag}>(.*?)</{clue_tag}>\s*<reasoning>(.*?)</reasoning>\s*<answer>(.*?)</answer>"

    def one(c: Column, body: Column) -> Column:
        names = ("question", "clues", "reasoning", "answer")
        return F.struct(trimmed(c).alias("category"), *[_one(body, item, i + 1).alias(n) for i, n in enumerate(names)])

    whole = F.filter(F.zip_with(_all(t, block, 1), _all(t, block, 2), one), lambda x: x["question"].isNotNull())
    return F.filter(whole, lambda x, i: ~F.exists(F.slice(whole, i + 2, F.size(whole)), lambda y: y["category"] == x["category"]))


def transformations(t: Column, indented: bool = False) -> Column:
    """array of (transformation, explanation, result, answer); the number stands at the start of its line unless indented."""
    tags = ("transformed-action", "transformed-explanation", "transformed-question", "transformed-answer")
    p = ("(?ms)" + (r"^\s*" if indented else "^") + r"\d+\.\s*") + r"\s*".join(rf"<{x}>(.*?)</{x}>" for x in tags)
    names = ("transformation", "explanation", "result", "answer")
    cols = F.arrays_zip(*[_all(t, p, i + 1).alias(n) for i, n in enumerate(names)])
    return F.transform(cols, lambda x: F.struct(*[trimmed(x[n]).alias(n) for n in names]))


def reorderings(t: Column) -> Column:
    """array of (step, reordered_question, same_meaning)."""
    p = r"(?s)<question-(\d+)>\s*<transformed-question>(.*?)</transformed-question>\s*<same-meaning-with-origin>(True|False)</same-meaning-with-origin>\s*</question-\d+>"
    cols = F.arrays_zip(*[_all(t, p, i).alias(f"g{i}") for i in (1, 2, 3)])
    return F.transform(cols, lambda x: F.struct(x["g1"].try_cast("int").alias("step"), trimmed(x["g2"]).alias("reordered_question"), (x["g3"] == "True").alias("same_meaning")))


def final_answers(t: Column) -> Column:
    """struct(short(reason, answer), long(reason, answer)); nulls where a block is missing."""

    def block(name: str) -> Column:
        p = rf"(?s)<answer-{name}>\s*<reason>(.*?)</reason>\s*<answer>(.*?)</answer>\s*</answer-{name}>"
        return F.struct(_one(t, p, 1).alias("reason"), _one(t, p, 2).alias("answer"))

    return F.struct(block("short").alias("short"), block("long").alias("long"))


def answer_reason(t: Column) -> Column:
    """struct(answer, reason): with one of them only, that is the answer; with neither, the whole text."""
    a = F.nullif(_one(t, r"(?s)<answer>(.*?)</answer>"), F.lit(""))
    r = F.nullif(_one(t, r"(?s)<reason>(.*?)</reason>"), F.lit(""))
    return F.struct(F.coalesce(a, r, t).alias("answer"), F.when(a.isNotNull(), r).alias("reason"))


def reasoning_score(t: Column) -> Column:
    """struct(reasoning, score); nulls unless both are there and the score is an integer."""
    r = _one(t, r"(?i)Reasoning[ \t]*:\s*([^\n]*)")
    s = _one(t, r"(?i)Score[ \t]*:\s*([^\n]*)")
    n = F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("int"))
    ok = r.isNotNull() & n.isNotNull()
    return F.struct(F.when(ok, r).alias("reasoning"), F.when(ok, n).alias("score"))


def judgements(t: Column) -> Column:
    """struct(items array of (reason, score), total): a verdict counts 1 if it says true."""
    rs, vs = _all(t, r"(?s)<reason>(.*?)</reason>", 1), _all(t, r"<judge>(.*?)</judge>", 1)
    n = F.least(F.size(rs), F.size(vs))
    items = F.zip_with(F.slice(rs, F.lit(1), n), F.slice(vs, F.lit(1), n), lambda r, v: F.struct(trimmed(r).alias("reason"), F.lower(v).contains("true").cast("int").alias("score")))
    return F.struct(items.alias("items"), F.aggregate(items, F.lit(0), lambda a, x: a + x["score"]).alias("total"))


def _first_block(s: str | None) -> str | None:
    depth = start = 0
    for i, c in enumerate(s or ""):
        if c == "{":
            start = i if not depth else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return s[start : i + 1]
    return None


def _largest_value(s: str | None) -> str | None:
    """The longest substring between matching brackets that parses as JSON; each candidate is parsed from where it opens."""
    open_at: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for i, c in enumerate(s or ""):
        if c in "{[":
            open_at.append((c, i))
        elif c in "}]" and open_at:
            o, at = open_at.pop()
            if o + c in ("{}", "[]"):
                found.append((at, i + 1))
    for a, z in sorted(found, key=lambda x: (x[0] - x[1], x[1])):
        try:
            json.loads(s[a:z])
            return s[a:z]
        except ValueError:
            continue
    return None


@pandas_udf(StringType())
def first_json_block(s: pd.Series) -> pd.Series:
    """The first balanced {} block."""
    return s.map(_first_block)


@pandas_udf(StringType())
def largest_json(s: pd.Series) -> pd.Series:
    """The longest parseable JSON object or array in the text, null without one."""
    return s.map(_largest_value)
