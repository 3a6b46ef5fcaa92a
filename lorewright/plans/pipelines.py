"""The three lines of processing, each one declarative plan from tables to tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.functions import parse, providers, text
from lorewright.operators import annotate, builders, chunks, retrieval, tiers
from lorewright.sources import files


@dataclass(frozen=True)
class Config:
    """What the stages share; paths are templates with {dataset} and {tier}."""

    chunk_size: int = 1200
    chunk_overlap: int = 100
    top_k: int = 20
    prompt_k: int = 3
    seed: int = 42
    template: str = "Documents:\n[[CLUES]]\nQuestion: [[QUESTION]]"

    @staticmethod
    def path(template: str, dataset: str, tier: int) -> str:
        return template.format(dataset=dataset, tier=tier)


def prepare_corpus(documents: DataFrame, spec: list[tiers.Rule], tier: int, cfg: Config = Config()) -> DataFrame:
    """Documents to numbered chunks of one tier: clean, choose, cut, annotate. Texts are shuffled once, to meet their tier."""
    d = documents.withColumn("text", text.strip_number_lines(text.collapse_newlines(F.col("text"))))
    d = d.withColumn("n_tokens", text.token_count(F.coalesce("text", F.lit(""))))
    chosen = tiers.first_tiers(d.select("source", "doc_id", "rel_path", "n_tokens"), spec, cfg.seed).where(F.col("first_tier") <= tier)
    kept = d.join(chosen.select("doc_id"), "doc_id", "left_semi").withColumn("file_path", F.concat_ws("/", "source", "rel_path"))
    c = chunks.token_chunks(kept.select("doc_id", "source", "file_path", "text"), "text", "file_path", cfg.chunk_size, cfg.chunk_overlap)
    c = c.withColumnRenamed("chunk", "origin_context")
    return c.withColumn("context", annotate.annotate(F.col("origin_context")))


def stage(df: DataFrame, key: str, prompt: Column, parsed: Callable[[Column], Column], out: str, make=providers.Stub, every: int | None = 10_000) -> DataFrame:
    """One model stage that takes up where it broke off: rows whose key the table at ``out`` lacks are asked, parsed and
    appended, ``every`` keys a commit. Returns the whole table (key, output, parsed)."""
    work = lambda d: providers.complete(d, "_prompt", "output", make).select(key, "output", parsed(F.col("output")).alias("parsed"))
    return files.resume_append(df.select(key, prompt.alias("_prompt")), out, [key], every, work)


def retrieve(queries: DataFrame, corpus: DataFrame, query_id: str, query: str, doc_id: str, doc: str, dim: int, cfg: Config = Config(), make=providers.embed_stub) -> DataFrame:
    """(query_id, rank, doc_id, score) of texts by their embeddings. Keys must be numbers."""
    q = providers.embed(queries.select(F.col(query_id).alias("k"), query), query, "vector", make)
    c = providers.embed(corpus.select(F.col(doc_id).alias("k"), doc), doc, "vector", make)
    ok = lambda d: d.where(retrieval.usable_vectors(d, "vector", dim)).select("k", "vector")
    return retrieval.top_k(ok(q), ok(c), "k", "vector", dim, cfg.top_k, others=False)


def generate(questions: DataFrame, corpus: DataFrame, cfg: Config = Config(), make=providers.Stub) -> DataFrame:
    """(question_id, prompt, answer, reason) from questions with their ranked documents."""
    p = builders.prompts(questions, corpus, cfg.template, cfg.prompt_k, "question_id", "question", "top_k_documents")
    d = providers.complete(p, "prompt", "output", make)
    return d.select("question_id", "prompt", parse.answer_reason(F.col("output")).alias("x")).select("question_id", "prompt", "x.answer", "x.reason")
