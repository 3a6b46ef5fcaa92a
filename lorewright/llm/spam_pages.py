"""Problem 9: pages of keywords, links or product tags instead of sentences.

What a page repeats is told by the compression ratio of its blocks, divided by the ratio that prose of the same length and
language has; that ratio is measured in a first pass over all pages (``prose_ratios``). The lines of a page are told apart by
the density of sentence punctuation outside link targets, and lines of either kind are gathered to blocks of about 900 bytes.
A block of lines without sentences, links and tags as well as keywords, is stuffing where it is redundant; a block of
sentences only where it is extremely redundant and three words make up most of it (sentences that repeat one name). Link
targets count with their lines, images don't. A page is reported if such blocks hold more than half of its characters other
than blanks.

Defined results: null, empty and blank texts are no cases, nor are texts too short to be redundant (48 bytes); tables and
headings count as page content but never as stuffing; a null language is one of its own; repeated rows count once; whole
texts are read; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINK = re.compile(r"<a\s[^>]*>(.*?)</a>|\[([^\]\n]*)\]\([^)\s]*\)|(?:https?://|www\.)[^\s<>)\]]+", re.I)
_STOP = re.compile(r"[.!?…](?=[\s\"'”»)\]*_]|$)|[。！？]")
_IMAGE = re.compile(r"!\[[^\]\n]*\]\([^)\s]*\)")
_MARKER = re.compile(r"^\s*(?:\d+[.)]|[-*•+])\s+")
_TABLE = re.compile(r"^\s*\|.*\|\s*$")
_HEADING = re.compile(r"^\s*#{1,6}\s+\S")
_WORD = re.compile(r"[^\W_]+")
_HAN = re.compile(r"[㐀-鿿]")

#: Sizes in bytes at which the ratio of prose is measured.
SIZES = (64, 128, 256, 512, 1024)
#: What stands in for prose of a script that a collection hardly has: medians of well-punctuated text at these sizes.
USUAL = {"other": (1.0, 0.867, 0.71, 0.629, 0.56), "han": (1.1, 1.04, 0.857, 0.737, 0.632)}


def script(text: str) -> str:
    return "han" if not text.isascii() and len(_HAN.findall(text)) > 0.15 * len(text) else "other"


class Prose:
    """Compression ratio of prose by script, language and size; of a language with too few blocks, that of its script."""

    def __init__(self, measured: list[tuple[str, str, int, int, float]] = (), few: int = 30):
        """measured: (script, language, index of the size, blocks, sum of their ratios)."""
        self.known: dict[tuple[str, str], list[float]] = {}
        n = Counter()
        total = Counter()
        for kind, lang, i, k, r in measured:
            for name in {lang, ""}:
                n[kind, name, i] += k
                total[kind, name, i] += r
        for kind, usual in USUAL.items():
            self.known[kind, ""] = [total[kind, "", i] / n[kind, "", i] if n[kind, "", i] >= few else usual[i] for i in range(len(SIZES))]
        for kind, lang in {(a, b) for a, b, _ in n}:
            own = self.known[kind, ""]
            self.known[kind, lang] = [total[kind, lang, i] / n[kind, lang, i] if n[kind, lang, i] >= few else own[i] for i in range(len(SIZES))]

    def redundancy(self, text: str, lang: str = "") -> float:
        """Compression ratio over that of prose of the same length and language: about 1 for prose, near 0 for repetition."""
        raw = text.encode("utf-8", "replace")
        if len(raw) < 48:
            return 1.0
        kind = script(text)
        r = self.known.get((kind, lang)) or self.known[kind, ""]
        x = min(max(np.log2(len(raw)) - 6, 0), len(r) - 1.001)
        i = int(x)
        return len(zlib.compress(raw, 6)) / len(raw) / (r[i] + (r[i + 1] - r[i]) * (x - i))


def _blocks(lines: list[tuple[str, int]], size: int = 900) -> Iterator[tuple[str, int]]:
    """(text, weight) of blocks of lines; long lines are cut."""
    now, n, weight = [], 0, 0
    for line, w in lines:
        parts = [line[i : i + size] for i in range(0, len(line), size)] or [""]
        if len(parts) > 1 and len(parts[-1]) < size // 3:
            parts[-2:] = [parts[-2] + parts[-1]]
        for p in parts:
            if n and n + len(p) > size * 1.3:
                yield "\n".join(now), weight
                now, n, weight = [], 0, 0
            now.append(p)
            n += len(p)
            weight += w * len(p) / max(len(line), 1)
    if now:
        yield "\n".join(now), weight


def _dominated(block: str) -> bool:
    """Whether three words make up most of a block's sentences, as a name told over and over does. Sentences of one pattern
    (a glossary, a repeated notice) are redundant, too, but not so."""
    words = _WORD.findall(block.lower())
    return len(words) >= 8 and sum(n for _, n in Counter(words).most_common(3)) > 0.38 * len(words)


def parted(text: str) -> tuple[int, list[tuple[str, int]], list[tuple[str, int]]]:
    """(characters other than blanks, lines without sentences, lines of sentences), each line with its characters."""
    total, bare, prose = 0, [], []
    for line in text.split("\n"):
        size = len("".join(line.split()))
        if not size:
            continue
        total += size
        if _TABLE.match(line):
            continue
        if "![" in line:
            line = _IMAGE.sub(" ", line)
            if not line.strip():
                continue
        line = plain = _MARKER.sub("", line)
        if "http" in line or "](" in line or "<a " in line or "www." in line:
            plain = _LINK.sub(lambda m: f" {m[1] or m[2] or ''} ", line)
        stops = len(_STOP.findall(plain))
        if stops and stops >= len(plain) / 400:
            prose.append((plain, size))
        elif not _HEADING.match(line):
            bare.append((line, size))
    return total, bare, prose


def stuffed_share(text: str | None, lang: str = "", prose: Prose | None = None, bare: float = 0.9, repeated: float = 0.55) -> float:
    """Share of a page's characters, blanks apart, that is keywords, bare links, tags or repeated names."""
    if not text:
        return 0.0
    ratios = prose or Prose()
    total, lines, sentences = parted(text)
    stuffed = 0.0
    for block, weight in _blocks(lines):
        if ratios.redundancy(block, lang) < bare:
            stuffed += weight
    for block, weight in _blocks(sentences):
        if ratios.redundancy(block, lang) < (repeated if len(block) >= 400 else 0.8) and _dominated(block):
            stuffed += weight
    return stuffed / total if total else 0.0


def _language(lang: str | None) -> str:
    return (lang or "").strip().lower()[:2]


def prose_ratios(pages: DataFrame, text: str, lang: str | None) -> Prose:
    """The ratios of the collection's own prose, from the sentences of all pages that are mostly sentences. One row per
    script, language (two letters) and size comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = Counter(), Counter()
        for b in batches:
            for t, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                size, _, sentences = parted(t)
                if sum(w for _, w in sentences) < 0.8 * size:
                    continue
                for block, _ in _blocks(sentences):
                    raw, kind = block.encode("utf-8", "replace"), script(block)
                    for i, s in enumerate(SIZES):
                        if len(raw) < s:
                            break
                        n[kind, _language(code), i] += 1
                        total[kind, _language(code), i] += len(zlib.compress(raw[:s], 6)) / s
        rows = [(*k, n[k], total[k]) for k in n]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f) for i, f in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64(), pa.float64()))], names=["script", "lang", "i", "n", "total"])

    per = pages.select(text, F.col(lang) if lang else F.lit(None).cast("string")).mapInArrow(run, "script string, lang string, i int, n bigint, total double")
    return Prose([tuple(r) for r in per.groupBy("script", "lang", "i").agg(F.sum("n"), F.sum("total")).collect()])


def spam_pages(df: DataFrame, key: str, text: str, lang: str | None = None, share: float = 0.5) -> DataFrame:
    """(key, stuffed) of the pages of which more than ``share`` is stuffing. Pages are judged where they are read."""
    kept = df.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("_lang"))
    kept = kept.where("_key is not null and _text is not null")
    prose = df.sparkSession.sparkContext.broadcast(prose_ratios(kept, "_text", "_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([stuffed_share(t, _language(code), prose.value) for t, code in zip(b.column(1).to_pylist(), b.column(2).to_pylist())])
            keep = pa.array(s > share)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), pa.array(s).filter(keep)], names=[key, "stuffed"])

    return kept.mapInArrow(run, f"`{key}` bigint, stuffed double").distinct()
