"""Cleaning, splitting and packing of text as column expressions."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

BLANK = r"[ \t\n\r\f\x0B]"
#: default tokens: blanks cling to what follows, so that the tokens of a text are a partition of it
TOKEN = r"[ \t\n\r\f]*[A-Za-z0-9]+|[ \t\n\r\f]*[^A-Za-z0-9 \t\n\r\f]|[ \t\n\r\f]+"


def collapse_newlines(t: Column) -> Column:
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def strip_number_lines(t: Column) -> Column:
    """Remove runs of digits-and-newline; they may also end a prose line."""
    return F.regexp_replace(t, r"(?:[0-9]+\n)+", "")


def link_targets(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"\[([^\]\n]*)\]\(([^)\n]*)\)"), F.lit(2))


def rewrite_links(t: Column, base: Column, images: bool = False) -> Column:
    """Local link targets get the base URL (scheme kept, doubled slashes and backslashes mended); absolute ones stay. Text
    links to pages or PDF files point to their Markdown."""
    head = r"(!\[[^\]\n]*\]\()" if images else r"((?<!!)\[[^\]\n]*\]\()"
    local = r"(?!https?:|#|mailto:)[/\\]*([^)\n]*)\)"
    out = F.regexp_replace(t, head + local, "$1\x01/$2)")
    if not images:
        out = F.regexp_replace(out, r"(\x01/[^)\n]*\.(?:pdf|html|htm))\)", "$1.md)")
    out = F.regexp_replace(out, r"\\(?=[^()\n]*\))", "/")
    return F.replace(out, F.lit("\x01"), F.regexp_replace(base, "/+$", ""))


def paragraphs(t: Column) -> Column:
    return F.split(t, rf"{BLANK}*\n{BLANK}*\n{BLANK}*", -1)


def sentences_at_blank(p: Column) -> Column:
    """Split after . ! ? where blanks follow."""
    return F.split(p, rf"(?<=[.!?]){BLANK}+", -1)


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{BLANK}+|{BLANK}+$", "")


def line_sentences(t: Column) -> Column:
    """Sentences of each trimmed line, in order, without empty ones."""
    lines = F.transform(F.split(t, "\n", -1), trimmed)
    return F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, rf"(?<=[.!?])(?:{BLANK}+|$)", -1))), lambda x: x != "")


def tokens(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))


def bpe_tokens(ranks: str, pattern: str) -> Callable[[Column], Column]:
    """A tokenizer by the byte-pair ranks of a file (a token in base64 and its rank a line) that every executor can read.
    Texts are cut where their tokens begin; a token that ends inside a character goes with the next one."""

    @pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        enc = encoding(ranks, pattern)
        return s.map(lambda x: None if x is None else _pieces(enc, x))

    return cut


@lru_cache(2)
def encoding(ranks: str, pattern: str):
    """A byte-level BPE from a file of ranks, loaded once per process."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _pieces(enc, t: str) -> list[str]:
    out, held = [], b""
    for b in enc.decode_tokens_bytes(enc.encode_ordinary(t)):
        held += b
        try:
            out.append(held.decode())
            held = b""
        except UnicodeDecodeError:
            continue
    return out


def token_count(t: Column, tokenize: Callable[[Column], Column] = tokens) -> Column:
    return F.size(tokenize(t))


def truncate(t: Column, n: int, tokenize: Callable[[Column], Column] = tokens) -> Column:
    """The first n tokens."""
    return F.array_join(F.slice(tokenize(t), 1, n), "")


def strip_think(t: Column) -> Column:
    return F.regexp_replace(t, r"(?s)<think>.*?</think>", "")


def numbered(items: Column, start: int = 1) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + start).cast("string"), F.lit(". "), x)), "\n")


def documents_block(items: Column) -> Column:
    """``[Doc i] text`` lines, counted from 0."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("[Doc "), i.cast("string"), F.lit("] "), x)), "\n")


def sentences_block(sentences: Column) -> Column:
    """``[Sen n] text`` lines of (number, text)."""
    return F.array_join(F.transform(sentences, lambda x: F.concat(F.lit("[Sen "), x["sen_id"].cast("string"), F.lit("] "), x["text"])), "\n")


def rules_block(rules: Column) -> Column:
    """``Rule n: text`` lines, counted from 1; blank rules are left out."""
    kept = F.filter(rules, lambda r: F.coalesce(trimmed(r), F.lit("")) != "")
    return F.array_join(F.transform(kept, lambda r, i: F.concat(F.lit("Rule "), (i + 1).cast("string"), F.lit(": "), trimmed(r))), "\n")


def fill(template: Column, **values: Column) -> Column:
    """Literal substitution of ``[[NAME]]``."""
    for k, v in values.items():
        template = F.replace(template, F.lit(f"[[{k}]]"), v)
    return template


def packed(t: Column, limit: int = 4000, tokenize: Callable[[Column], Column] = tokens) -> Column:
    """Greedy packing to chunks of at most ``limit`` tokens, paragraph by paragraph; a paragraph beyond the limit goes sentence
    by sentence. What closes a chunk decides how its parts are joined: a sentence ". ", a paragraph a newline, the end of the
    text a blank; an overflow before anything is held gives an empty chunk."""

    def units(p: Column) -> Column:
        n = token_count(p, tokenize)
        whole = F.array(F.struct(p.alias("t"), n.alias("n"), F.lit("\n").alias("sep")))
        cut = F.transform(sentences_at_blank(p), lambda s: F.struct(s.alias("t"), token_count(s, tokenize).alias("n"), F.lit(". ").alias("sep")))
        return F.when(n > limit, cut).otherwise(whole)

    empty = F.array().cast("array<string>")
    zero = F.struct(empty.alias("done"), empty.alias("now"), F.lit(0).alias("n"))

    def step(a: Column, u: Column) -> Column:
        over = a["n"] + u["n"] > limit
        one = F.array(u["t"])
        closed = F.when(u["sep"] == ". ", F.array_join(a["now"], ". ")).otherwise(F.array_join(a["now"], "\n"))
        return F.struct(
            F.when(over, F.concat(a["done"], F.array(closed))).otherwise(a["done"]).alias("done"),
            F.when(over, one).otherwise(F.concat(a["now"], one)).alias("now"),
            F.when(over, u["n"]).otherwise(a["n"] + u["n"]).alias("n"),
        )

    return F.aggregate(
        F.flatten(F.transform(paragraphs(t), units)),
        zero,
        step,
        lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(F.array_join(a["now"], " ")))).otherwise(a["done"]),
    )
