"""Chunks of documents: sliding windows of tokens, whole files, ids and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.functions import text as T


def chunk_id(path: Column, i: Column) -> Column:
    return F.concat(F.translate(path, "/", "_"), F.lit("_chunk_"), i.cast("string"))


def token_chunks(df: DataFrame, text: str, path: str, size: int = 1200, overlap: int = 100, tokenize=T.tokens) -> DataFrame:
    """df's columns with chunk_no, chunk_id, start_char_pos, end_char_pos, n_tokens and chunk: windows of ``size`` tokens that
    overlap by ``overlap``; the last one may hold nothing but overlap. Null and empty texts give no chunk. tokenize: column of
    texts to column of the tokens that they are made of."""
    step = size - overlap
    keep = [c for c in df.columns if c != text]
    tok = df.where(F.col(text).isNotNull() & (F.col(text) != "")).withColumn("_tok", tokenize(F.col(text)))
    # characters of each step's tokens, then of all steps before: linear in the tokens, and no chunk carries the whole text
    numbers = F.sequence(F.lit(0), F.floor((F.size("_tok") - 1) / step).cast("int"))
    lengths = F.transform(numbers, lambda i: F.aggregate(F.slice("_tok", i * step + 1, step), F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)))
    tok = tok.withColumn("_len", lengths)

    def one(i: Column) -> Column:
        part = F.slice("_tok", i * step + 1, size)
        before = F.aggregate(F.slice("_len", F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.struct(i.alias("chunk_no"), before.alias("start_char_pos"), F.size(part).alias("n_tokens"), F.array_join(part, "").alias("chunk"))

    c = tok.select(*keep, F.explode(F.transform(numbers, one)).alias("_c"))
    c = c.select(*keep, "_c.chunk_no", chunk_id(F.col(path), F.col("_c.chunk_no")).alias("chunk_id"), "_c.start_char_pos", "_c.n_tokens", "_c.chunk")
    return c.withColumn("end_char_pos", F.col("start_char_pos") + F.length("chunk"))


def whole_chunks(df: DataFrame, text: str, path: Column) -> DataFrame:
    """One chunk per file."""
    return df.where(F.col(text).isNotNull()).select(
        *[c for c in df.columns if c != text],
        F.lit(0).alias("chunk_no"),
        chunk_id(path, F.lit(0)).alias("chunk_id"),
        F.lit(0).alias("start_char_pos"),
        F.length(text).alias("end_char_pos"),
        F.col(text).alias("chunk"),
    )
