"""Model stages: what is asked, how the output is read, and which output counts.

A stage is a template in our own words with the columns that fill it, a parser to a column, and the least that a valid output
must show. ``run`` asks for the keys that the stage's table lacks, in batches with a commit each, so that an interrupted
run loses at most one batch of calls."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.functions import parse, providers, text
from lorewright.sources import files


@dataclass(frozen=True)
class Stage:
    """needs: regular expression that an output must match, else it is asked for again, ``attempts`` times in all; skip: an
    error that isn't worth another attempt."""

    template: str
    inputs: tuple[str, ...]
    parsed: Callable[[Column], Column]
    needs: str = r"\S"
    attempts: int = 3
    skip: str | None = r"(?i)content (?:policy|filter)|maximum context|too long"

    def prompt(self, **values: Column) -> Column:
        return text.fill(F.lit(self.template), **{n.upper(): F.coalesce(values.get(n, F.col(n)), F.lit("")) for n in self.inputs})

    def provider(self, make: Callable[[], providers.Provider]) -> Callable[[], providers.Provider]:
        needs, attempts, skip = self.needs, self.attempts, self.skip
        return lambda: providers.Retrying(make(), attempts, lambda _, out: re.search(needs, out) is not None, skip)


def _summary(out: Column) -> Column:
    kind = "summary string, faq array<struct<question: string, answer: string>>, valid_document boolean"
    return F.from_json(parse.largest_json(out), kind)


_JUDGE = "Question:\n[[QUESTION]]\n\n[[BASIS]]\n\nAnswer to be judged:\n[[ANSWER]]\n\nGo through the answer sentence by sentence. For each write <reason>why</reason><judge>True or False</judge>. "
_STRICT = "A sentence counts as true only if everything it says is borne out."
_LENIENT = "A sentence counts as true if its main point is borne out."
_FAMILIES = {
    "consistent": "True means that the cited sentences say what the answer says.",
    "partly_unknown": "Part of the question can't be answered. True means that the answer says so for that part and answers the rest by the rules.",
    "unknown": "The question can't be answered. True means that the answer says so and makes nothing up.",
}

STAGES: dict[str, Stage] = {
    # the error text decides whether a chunk is asked for again, up to six times
    "clean": Stage("Copy the text below as plain Markdown. Leave out menus, advertising and what is said twice; change nothing else.\n\n[[CHUNK]]", ("chunk",), lambda o: text.trimmed(text.strip_think(o)), attempts=6),
    "summarize": Stage(
        'Read the page. Write JSON with "summary" (three sentences at most), "faq" (a list of {"question", "answer"}) and "valid_document" (false for an error page, a menu or an empty page).\n\n[[PAGE]]', ("page",), _summary, needs=r"\{[\s\S]*\}"
    ),
    "criteria": Stage(
        "A question was rewritten so that only part of it can be answered.\nBefore: [[PREVIOUS_QUESTION]]\nIts answer: [[PREVIOUS_ANSWER]]\nAfter: [[RESULT]]\nRules so far:\n[[RULES]]\n\nSay in one sentence what an answer must admit not to know.",
        ("previous_question", "previous_answer", "result", "rules"),
        text.trimmed,
    ),
    "relevance": Stage("How much does the passage help to answer the question, from 1 to 5?\nQuestion: [[QUESTION]]\nPassage: [[PASSAGE]]\n\nReasoning: why\nScore: number", ("question", "passage"), parse.reasoning_score, needs=r"(?i)score"),
    "similarity": Stage("How alike in meaning are the clue and the question, from 1 to 5?\nQuestion: [[QUESTION]]\nClue: [[CLUE]]\n\nReasoning: why\nScore: number", ("question", "clue"), parse.reasoning_score, needs=r"(?i)score"),
    **{f"judge_{f}_{how}": Stage(f"{_JUDGE}{said} {rule}", ("question", "basis", "answer"), parse.judgements, needs=r"<judge>") for f, said in _FAMILIES.items() for how, rule in (("strict", _STRICT), ("lenient", _LENIENT))},
}


def run(name: str, df: DataFrame, key: str, out: str | None = None, make: Callable[[], providers.Provider] = providers.Stub, every: int = 10_000, **values: Column) -> DataFrame:
    """(key, output, parsed) of a stage over df. With ``out``, the table there is taken up where it broke off, ``every`` keys
    a commit; without, nothing is kept."""
    s = STAGES[name]
    asked = df.select(key, s.prompt(**values).alias("_prompt"))

    def work(d: DataFrame) -> DataFrame:
        return providers.complete(d, "_prompt", "output", s.provider(make)).select(key, "output", s.parsed(F.col("output")).alias("parsed"))

    return work(asked) if out is None else files.resume_append(asked, out, [key], every, work)


def criteria_input(variants: DataFrame) -> DataFrame:
    """Variants that get a scoring criterion: partial rewritings, and of hybrid ones the partial steps, but every step where the
    question comes from the entity graph. variants: (variant_id, variant_kind, transformation, flavour, ...)."""
    partial = F.coalesce(F.lower("transformation").contains("partial"), F.lit(False))
    return variants.where((F.col("variant_kind") == "part") | (F.col("variant_kind") == "hybrid") & ((F.col("flavour") == "entity_graph") | partial))
