"""Problem 1: records of evaluation splits that recur, the same or nearly so, in the training split.

The evaluation records are sharded. Each shard builds one Aho-Corasick automaton over its normalised passages, all runs of
three words of its records (a shorter record is one run), and scans every training text of the shard from end to end in
reading order. The matched intervals of a text are merged per evaluation record to its coverage: the share of the record's
words that stand in passages of the training text.

Which records are alike as sets of words, in whatever order, is decided on the sets. Passages can't decide that: a text
may have all words and no common run, and records made by one pattern share nearly all runs but not the words that matter
(the README has figures). So a training text meets a shard by its leading words, rare ones first (count sketch over all
rows): the first word that two sets with Jaccard of at least t share stands within the first size - overlap + 1 words of
both. The exact similarity of each pair that meets so, and its coverage, come out.

Records with equal sets are one class per split, so a hot text is scanned once. A shard that very many rows of either side
reach is dealt to a grid of cells, blocks of evaluation records by blocks of training texts: a task holds a bounded number
of both whatever the size of the collection or the frequency of a word.

Defined results: null and blank texts have no words and match nothing; null ids and splits take no part; case and outer
blanks of split are ignored; repeated rows count once; of records with equal sets of words the coverage is that of one of
them; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm import wordhash as wh
from lorewright.llm import sketch
from lorewright.storage import materialize

_WORD = re.compile(r"[^\W_]+")


@lru_cache(1)
def _format_chars() -> dict[int, None]:
    return {i: None for i in range(0x110000) if unicodedata.category(chr(i)) == "Cf"}


def words(text: str | None) -> list[str]:
    """Words as in wordhash, as strings."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_format_chars())
    return _WORD.findall(text.lower())


def _word_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return wh.distinct_rows(*wh.word_hashes(texts))


def _hashes(ws: list[str]) -> np.ndarray:
    return wh.word_hashes([" ".join(ws)])[1]


def passages(records: DataFrame, t: float, classes, bits: int, known, known_bits: int = 20) -> DataFrame:
    """(record_id, train, cls, passage, size, lead, place): the class of each record's word set, and, once per task for each
    class, its normalised text, the number of its distinct words, and the hashes of its leading words, rare ones first, with
    their places, among which two similar passages must meet. Of a training passage only those leading words count that may
    lead an evaluation passage, too (``known``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[bool, int]] = set()
        for b in batches:
            said = [words(x) for x in b.column(2).to_pylist()]
            ws = [list(dict.fromkeys(w)) for w in said]
            train = b.column(1).to_pylist()
            o, h = wh.word_hashes([" ".join(w) for w in ws])
            c = classes.value[sketch.bucket(h, bits)]
            ids, out, sizes, leads, places = [], [], [], [], []
            for i, w in enumerate(ws):
                a, z = int(o[i]), int(o[i + 1])
                hi = h[a:z]
                cls = int(wh.mix(wh.mix(np.sort(hi)).sum(dtype=np.uint64)[None] + np.uint64(len(w))).view(np.int64)[0])
                ids.append(cls if w else None)
                sizes.append(len(w))
                if not w or (train[i], cls) in seen:
                    out.append(None)
                    leads.append(None)
                    places.append(None)
                    continue
                seen.add((train[i], cls))
                lead = hi[np.lexsort((hi, c[a:z]))[: len(w) - int(np.ceil(t * len(w) - 1e-9)) + 1]]
                place = np.arange(len(lead))
                if train[i] and known is not None:
                    place = place[known.value[sketch.bucket(lead, known_bits)]]
                    lead = lead[place]
                out.append(" ".join(said[i]))
                leads.append(lead.view(np.int64).tolist())
                places.append(place.tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(ids, pa.int64()), pa.array(out, pa.string()), pa.array(sizes, pa.int32()), pa.array(leads, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                names=["record_id", "train", "cls", "passage", "size", "lead", "place"],
            )

    schema = "record_id bigint, train boolean, cls bigint, passage string, size int, lead array<bigint>, place array<int>"
    return records.select("record_id", "train", "text").mapInArrow(run, schema)


def leading_words(evals: DataFrame, bits: int = 20) -> np.ndarray:
    """Bit per bucket: whether a word that leads some evaluation passage falls into it. Fixed size."""
    w = evals.select(F.explode("lead").alias("w"))
    b = w.select(F.shiftrightunsigned("w", 64 - bits).alias("b")).distinct()
    # at most 2**bits numbers in all, packed by task
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = np.zeros(1 << bits, bool)
        for x in batches:
            bit[x.column(0).to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bit).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(1 << bits, bool)
    for r in b.repartition(8).mapInArrow(pack, "bits binary").collect():  # 8 rows of 2**bits / 8 bytes
        out |= np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(bool)
    return out


RUN = 3  # words of a passage


class Passages:
    """The evaluation passages of a shard: an automaton over their runs, and the words of each record."""

    def __init__(self, texts: list[str]):
        import ahocorasick

        self.sets, self.runs, number = [], [], {}
        for text in texts:
            ws = text.split(" ")
            n = min(RUN, len(ws))
            self.sets.append(frozenset(ws))
            self.runs.append(frozenset(number.setdefault(" ".join(ws[i : i + n]), len(number)) for i in range(len(ws) - n + 1)))
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for run, i in number.items():
            self.machine.add_word(f" {run} ", i)
        self.sizes = {i: run.count(" ") + 1 for run, i in number.items()}
        if number:
            self.machine.make_automaton()

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(first word, last word, run) of all passages in the text, in the order of their ends."""
        out, last, at = [], -1, 0
        for end, run in self.machine.iter(f" {text} "):
            last += text.count(" ", at, end - 1) + (not at)  # blanks before the end: the number of the last word
            at = end - 1
            out.append((last - self.sizes[run] + 1, last, run))
        return out

    def coverage(self, e: int, found: list[tuple[int, int, int]], text: list[str]) -> float:
        """Share of the words of record e that stand in its merged passages in the text."""
        upto, covered = -1, set()
        for first, last, run in found:
            if run in self.runs[e]:
                covered.update(text[max(first, upto + 1) : last + 1])
                upto = max(upto, last)
        return len(covered & self.sets[e]) / len(self.sets[e])


def meet(evals: list[tuple[int, str, list[int]]], trains: Iterator[tuple[int, str, int, list[int], list[int]]], t: float, shard: int, shards: int) -> Iterator[tuple[int, int, float, float]]:
    """(evaluation class, training class, coverage, jaccard) of the pairs that meet in this shard and reach t. evals: (cls,
    passage, lead); trains: (cls, passage, size, lead, place)."""
    shelf = Passages([p for _, p, _ in evals])
    post: dict[int, dict[tuple[int, int], list[int]]] = {}  # leading word: (size, place): evaluation records
    for e, (_, _, lead) in enumerate(evals):
        for i, x in enumerate(lead):
            if x % shards == shard:
                post.setdefault(x, {}).setdefault((len(shelf.sets[e]), i), []).append(e)
    ends = {(a, i) for g in post.values() for a, i in g}
    share = t / (1 + t)

    @lru_cache(None)
    def fit(b: int, j: int) -> frozenset[tuple[int, int]]:
        """The sizes and places of an evaluation word that may be the first one shared with place j of a set of b words."""
        need = {a: int(np.ceil(share * (a + b) - 1e-9)) for a, _ in ends}
        return frozenset((a, i) for a, i in ends if i <= a - need[a] and j <= b - need[a])

    for cls, passage, size, lead, place in trains:
        found: set[int] = set()
        for x, j in zip(lead, place):
            for at, p in post.get(x, {}).items():
                if at in fit(size, j):
                    found.update(p)
        if not found:
            continue
        text = passage.split(" ")
        own, hits = frozenset(text), None
        for e in found:
            c = len(shelf.sets[e] & own)
            jac = c / (len(shelf.sets[e]) + size - c)
            if jac >= t - 1e-12:
                hits = shelf.scan(passage) if hits is None else hits
                yield evals[e][0], cls, shelf.coverage(e, hits, text), jac


def class_overlaps(evals: DataFrame, trains: DataFrame, t: float, per_shard: int = 20_000, per_block: int = 20_000) -> DataFrame:
    """(e, r, coverage, jaccard): evaluation class, training class, share of the evaluation record's words that stand in its
    passages in the training text, and similarity. evals and trains: (cls, passage, size, lead, place)."""
    spark = evals.sparkSession
    total = evals.select(F.sum(F.size("lead"))).first()[0] or 0
    shards = max(1, -(-total // per_shard))
    to = F.array_distinct(F.transform("lead", lambda x: F.pmod(x, F.lit(shards)).cast("int")))

    def dealt(d: DataFrame) -> DataFrame:
        # a class comes once from each task that met it; one copy is enough
        x = d.withColumn("shard", F.explode(to)).groupBy("shard", "cls").agg(F.first(F.struct("passage", "size", "lead", "place")).alias("x"))
        return materialize(x.select("shard", "cls", "x.*"), "dealt")

    ev, tr = dealt(evals), dealt(trains)
    blocks = lambda d, to: d.groupBy("shard").agg(F.ceil(F.count("*") / per_block).cast("int").alias(to))
    grid = materialize(blocks(ev, "ne").join(blocks(tr, "nt"), "shard"), "grid")  # one row per shard that both sides reach
    cells = grid.agg(F.sum(F.col("ne") * F.col("nt"))).first()[0] or 1
    own = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = ["shard", "i", "j"]
    ev = ev.join(grid, "shard").withColumn("i", own("ne")).withColumn("j", all_of("nt")).select(*at, "cls", "passage", "lead")
    tr = tr.join(grid, "shard").withColumn("i", all_of("ne")).withColumn("j", own("nt")).select(*at, "cls", "passage", "size", "lead", "place")

    def cell(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(meet(list(zip(*(left[c].to_pylist() for c in ("cls", "passage", "lead")))), zip(*(right[c].to_pylist() for c in ("cls", "passage", "size", "lead", "place"))), t, key[0].as_py(), shards))
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate((("e", pa.int64()), ("r", pa.int64()), ("coverage", pa.float64()), ("jaccard", pa.float64())))})

    # so many partitions that each has about one cell; they are not merged to larger ones
    return (
        ev.repartition(cells, *at)
        .groupBy(*at)
        .cogroup(tr.repartition(cells, *at).groupBy(*at))
        .applyInArrow(cell, "e bigint, r bigint, coverage double, jaccard double")
        .groupBy("e", "r")
        .agg(F.max("coverage").alias("coverage"), F.max("jaccard").alias("jaccard"))
    )


def cross_split_overlaps(records: DataFrame, t: float = 0.75, bits: int = 18) -> DataFrame:
    """(eval_id, train_id, coverage, jaccard): all pairs of an evaluation and a training record whose sets of distinct words
    have a Jaccard similarity of at least t. records: (record_id, train boolean, text)."""
    if not 0 < t <= 1:
        raise ValueError("t must lie above 0 and be at most 1")
    spark = records.sparkSession
    records = records.where("record_id is not null and train is not null and text is not null")
    classes = spark.sparkContext.broadcast(sketch.frequency_classes(records.select("text"), _word_sets, bits))
    ev = materialize(passages(records.where("not train"), t, classes, bits, None).where("cls is not null"), "evaluation")
    cols = ["cls", "passage", "size", "lead", "place"]
    ev_lead = ev.where("passage is not null").select(*cols)
    known = spark.sparkContext.broadcast(leading_words(ev_lead))
    tr = materialize(passages(records.where("train"), t, classes, bits, known).where("cls is not null"), "training")
    tr_lead = tr.where("passage is not null and size(lead) > 0").select(*cols)
    pairs = class_overlaps(ev_lead, tr_lead, t)
    e = ev.select(F.col("cls").alias("e"), F.col("record_id").alias("eval_id")).distinct()
    r = tr.select(F.col("cls").alias("r"), F.col("record_id").alias("train_id")).distinct()
    return pairs.join(e, "e").join(r, "r").select("eval_id", "train_id", "coverage", "jaccard")


def split_records(proposed: DataFrame, rephrased: DataFrame) -> DataFrame:
    """(record_id, source, split, train, text) of both tables; other splits than train, dev and test take no part."""
    a = proposed.select(F.col("question_id").alias("record_id"), "source", "split", F.col("question").alias("text"))
    b = rephrased.select(F.col("variant_id").alias("record_id"), "source", "split", F.col("result").alias("text"))
    s = F.regexp_replace(F.lower("split"), r"(?U)^\s+|\s+$", "")
    return a.unionByName(b).withColumn("split", s).where(F.col("split").isin("train", "dev", "test")).withColumn("train", F.col("split") == "train")


def overlap_report(records: DataFrame, t: float = 0.75, bits: int = 18) -> DataFrame:
    """(split, source, records, overlapping, pairs, mean_coverage): per evaluation split and source the records, those that
    recur in training, the pairs, and the mean over overlapping records of their best coverage."""
    ids = records.where("not train").select("record_id", "split", "source").distinct()
    o = cross_split_overlaps(records, t, bits).groupBy("eval_id").agg(F.count("*").alias("pairs"), F.max("coverage").alias("coverage"))
    return (
        ids.join(o, ids.record_id == o.eval_id, "left")
        .groupBy("split", "source")
        .agg(F.count("*").alias("records"), F.count("eval_id").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.avg("coverage").alias("mean_coverage"))
    )
