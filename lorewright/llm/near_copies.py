"""Problem 5: groups of texts that share most of their word sequences.

Exact set-similarity join on the distinct n-word sequences of each text, by token-combination prefixes. Tokens are ordered
from rare to frequent (count sketch over all rows). Two sets with Jaccard of at least t share a token within their
prefixes, and k tokens within prefixes that are k - 1 longer; tokens of rare classes are indexed one by one, tokens of
frequent classes only as k-token combinations (k = 2), so no posting list of a frequent token ever exists. A token is
frequent if more than one text in 600 (and more than 64 texts) holds it: relative to the collection, so that neither the
entries of a text nor the error of the sketch (a sixth of that bound, for sets of about 300) changes with its size.

A posting list is read in the order of set sizes: an entry looks only at the larger sets that its position still allows, so a
sequence that very many texts share costs no more than its entries unless they may be similar. A list that may exceed 50,000
entries is dealt to blocks, and each pair of blocks meets in a task of its own. A parity bitmap prunes pairs, and the full
sets decide.

Texts with equal sets are one class, and only the least key of a class is indexed: a group of copies costs one class however
large it is, and is expanded only where a result asks for pairs of rows.

Defined results: null and blank texts, and texts of fewer words than a sequence, are alone in their class and have no
links; repeated rows of a key count once; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm import wordhash as wh
from lorewright.llm import sketch
from lorewright.llm.components import link_components
from lorewright.storage import materialize

BITMAP_WORDS = 8  # 512 bits
_U = np.uint64


def _sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    return wh.distinct_rows(*wh.ngrams(*wh.word_hashes(texts), n))


def _sum_rows(offsets: np.ndarray, v: np.ndarray) -> np.ndarray:
    total = np.zeros(len(v) + 1, v.dtype)
    np.cumsum(v, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _set_ids(offsets: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    s = _sum_rows(offsets, wh.mix(h ^ _U(0x5BF03635F0935AD1)))
    return wh.mix(s + wh.mix(np.diff(offsets).astype(_U))).view(np.int64)


def _parity(offsets: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Per row a bitmap whose bits are the parities of the tokens that fall on them, as bytes."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    bits = BITMAP_WORDS * 64
    at = row * bits + (wh.mix(h ^ _U(0xD6E8FEB86659FD93)) % _U(bits)).astype(np.int64)
    odd = np.bincount(at, minlength=rows * bits) & 1
    return np.packbits(odd.astype(bool).reshape(rows, bits), axis=1)


def _binary(a: np.ndarray) -> pa.Array:
    w = a.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(0, (len(a) + 1) * w, w, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(a))])


def signatures(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, cls, size, bits): class, number of distinct sequences and parity bitmap of each text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o, h = _sets(b.column(1).to_pylist(), n)
            size = np.diff(o)
            keep = size > 0
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(pa.array(keep)), pa.array(_set_ids(o, h)[keep]), pa.array(size[keep].astype(np.int32)), _binary(_parity(o, h)[keep])],
                names=["key", "cls", "size", "bits"],
            )

    return df.select(F.col(key).cast("bigint").alias("key"), text).where(F.col("key").isNotNull()).mapInArrow(run, "key bigint, cls bigint, size int, bits binary")


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def entries(df: DataFrame, text: str, n: int, t: float, classes, bits: int, frequent: int, block: int = 50_000) -> DataFrame:
    """(sig, cls, size, pos, side): the index entries of each text. A single carries the position of its token, a combination
    the position of its first token. Where the rarer token of an entry may be told by more than ``block`` texts, the entry
    goes to a cell for each block of its list: there it meets its own block (side 0) or, from side 1 or 2, the other side; the
    side of combinations is 4 more."""
    k = 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls_of = classes.value
        for b in batches:
            o, h = _sets(b.column(0).to_pylist(), n)
            ids, size = _set_ids(o, h), np.diff(o)
            order, fc = sketch.ranked(o, h, cls_of, bits)
            h, fc = h[order], fc[order]
            prefix = size - _ceil(t * size) + 1
            pos = np.arange(len(h)) - np.repeat(o[:-1], size)
            row = np.repeat(np.arange(len(ids)), size)
            inside = pos < prefix[row] + (k - 1)
            single = inside & (fc <= frequent) & (pos < prefix[row])  # a rare token shared at all: the first one shared is rare
            sig, r, p, rare = [h[single]], [row[single]], [pos[single]], [fc[single]]
            often = np.flatnonzero(inside & (fc > frequent))
            step = 1
            while len(often) > step:  # combinations of the i-th with the (i + step)-th frequent token of a row
                a, c = often[:-step], often[step:]
                same = row[a] == row[c]
                if not same.any():
                    break
                a, c = a[same], c[same]
                sig.append(wh.mix(np.minimum(h[a], h[c]) * _U(3) + wh.mix(np.maximum(h[a], h[c]))))
                r.append(row[a])
                p.append(pos[a])
                rare.append(fc[a])
                step += 1
            sig, r, p, rare = np.concatenate(sig), np.concatenate(r), np.concatenate(p), np.concatenate(rare)
            side = np.repeat([0, 4], [int(single.sum()), len(sig) - int(single.sum())]).astype(np.int8)
            cells = np.ceil(2.0 ** ((rare + 0.5) / 2) / block).astype(np.int64)  # the count of a class at most, in blocks
            if (cells > 1).any():
                at = np.repeat(np.arange(len(sig)), cells)
                other = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
                m = cells[at]
                own = (wh.mix(ids[r[at]].view(_U)) % m.astype(_U)).astype(np.int64)
                cell = np.minimum(own, other) * m + np.maximum(own, other)
                sig = np.where(m > 1, wh.mix(sig[at] ^ wh.mix(cell.astype(_U) + _U(1))), sig[at])
                side = side[at] + np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.int8)
                r, p = r[at], p[at]
            for s in range(0, len(sig), 200_000):
                x = slice(s, s + 200_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig[x].view(np.int64)), pa.array(ids[r[x]]), pa.array(size[r[x]].astype(np.int32)), pa.array(p[x].astype(np.int32)), pa.array(side[x])],
                    names=["sig", "cls", "size", "pos", "side"],
                )

    return df.select(text).mapInArrow(run, "sig bigint, cls bigint, size int, pos int, side tinyint")


def meetings(sig: np.ndarray, cls: np.ndarray, size: np.ndarray, pos: np.ndarray, side: np.ndarray, t: float, most: int = 2_000_000) -> Iterator[np.ndarray]:
    """Index entries in the order (sig, size, cls) to pairs of classes that may still reach t. Each entry looks at the larger
    sets of its list up to the size that its position allows; about ``most`` pairs are held at a time."""
    share = t / (1 + t)
    fresh = np.ones(len(sig), bool)  # an entry told twice is one
    fresh[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1]) | (side[1:] != side[:-1])
    sig, cls, size, pos, side = (x[fresh] for x in (sig, cls, size.astype(np.int64), pos.astype(np.int64), side))
    group = np.cumsum(np.diff(sig, prepend=sig[:1]) != 0)
    wide = int(size.max()) + 2
    upto = np.minimum(np.floor((size - pos) / share - size + 1e-9), wide - 1).astype(np.int64)
    end = np.searchsorted(group * wide + size, group * wide + np.maximum(upto, 0), "right")
    count = np.maximum(end - np.arange(len(sig)) - 1, 0)
    done = np.cumsum(count)
    s = 0
    while s < len(sig):
        e = max(s + 1, int(np.searchsorted(done, (done[s - 1] if s else 0) + most, "right")))
        c = count[s:e]
        i = np.repeat(np.arange(s, e), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        need = _ceil(share * (size[i] + size[j]))
        ok = (pos[j] <= size[j] - need) & (need <= size[i]) & (cls[i] != cls[j]) & ((side[i] & 3 == 0) | (side[i] != side[j]))
        if ok.any():
            a, b = cls[i[ok]], cls[j[ok]]
            yield np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        s = e


def _meet(t: float):
    """Entries in the order (sig, size, cls) to pairs; a list that runs over several batches is held until it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            for p in meetings(*(np.concatenate(x) for x in zip(*parts)), t):
                yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            now = tuple(b.column(c).to_numpy() for c in range(5))
            last = int(np.searchsorted(now[0], now[0][-1], "left"))  # where the list that may go on begins
            if held and now[0][0] != held[-1][0][-1] or last:
                yield from out([*held, tuple(x[:last] for x in now)] if last else held)
                held = [tuple(x[last:] for x in now)]
            else:
                held.append(now)
        if held:
            yield from out(held)

    return run


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sa, sb) to (a, b, jaccard); sa and sb are ascending 64-bit tokens as bytes."""
    for b in batches:
        jac = np.zeros(b.num_rows)
        for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
            u, v = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
            both = np.concatenate([u, v])
            both.sort()
            c = int((both[1:] == both[:-1]).sum())
            jac[i] = c / (len(u) + len(v) - c)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(jac)], names=["a", "b", "jaccard"])


def one_each(df: DataFrame, key: str, text: str, sigs: DataFrame, light: DataFrame, few: int = 100_000) -> DataFrame:
    """(key, text) of the least key of each class. The other keys are left out by a join that is broadcast only where they are
    at most ``few``; a key that is told twice may come twice."""
    d = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    copies = materialize(sigs.select("key", "cls").distinct().join(light.where("copies > 1").select("cls", F.col("key").alias("least")), "cls").where("key <> least").select("key"), "copies")
    n = copies.count()
    return d if not n else d.join(F.broadcast(copies) if n <= few else copies, "key", "left_anti")


def frequent_class(texts: int, share: int = 600, least: int = 64) -> int:
    """The highest frequency class (2 * log2 of the count) whose tokens are indexed one by one."""
    return round(2 * np.log2(max(texts / share, least)))


def class_links(df: DataFrame, key: str, text: str, n: int, t: float, sigs: DataFrame, bits: int = 20, share: int = 600, least: int = 64) -> DataFrame:
    """(a, b, jaccard): all pairs of different classes with Jaccard of at least t. sigs: materialized signatures of df."""
    if not 0.5 < t <= 1:
        raise ValueError("t must lie above 0.5 and be at most 1")
    light, index = index_of(df, key, text, n, t, sigs, bits, share, least)
    pairs = index.repartition("sig").sortWithinPartitions("sig", "size", "cls").mapInArrow(_meet(t), "a bigint, b bigint").distinct()
    la = light.select(F.col("cls").alias("a"), F.col("size").alias("na"), F.col("bits").alias("ba"))
    lb = light.select(F.col("cls").alias("b"), F.col("size").alias("nb"), F.col("bits").alias("bb"))

    part = t / (1 + t)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, BITMAP_WORDS) for c in (3, 5))
            na, nb = b.column(2).to_numpy().astype(np.int64), b.column(4).to_numpy().astype(np.int64)
            apart = np.bitwise_count(x ^ y).sum(axis=1)  # at most the symmetric difference
            ok = pa.array(apart <= na + nb - 2 * _ceil(part * (na + nb)))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    likely = materialize(pairs.join(la, "a").join(lb, "b").select("a", "b", "na", "ba", "nb", "bb").mapInArrow(prune, "a bigint, b bigint"), "likely")
    wanted = likely.select(F.col("a").alias("cls")).union(likely.select(F.col("b").alias("cls"))).distinct()
    reps = light.join(wanted, "cls", "left_semi").select("key", "cls")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o, h = _sets(b.column(1).to_pylist(), n)
            h = np.ascontiguousarray(h).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h[8 * s : 8 * e] for s, e in zip(o[:-1].tolist(), o[1:].tolist())], pa.binary())], names=["cls", "tokens"])

    sets = (
        df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
        .join(reps, "key")
        .dropDuplicates(["key"])
        .select("cls", "text")
        .mapInArrow(full, "cls bigint, tokens binary")
    )
    sets = materialize(sets, "sets")
    return (
        likely.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("sa")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
        .mapInArrow(_overlap, "a bigint, b bigint, jaccard double")
        .where(F.col("jaccard") >= t - 1e-12)
    )


def index_of(df: DataFrame, key: str, text: str, n: int, t: float, sigs: DataFrame, bits: int, share: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(classes with size, bitmap, least key and number of keys; index entries of one text per class)."""
    spark = df.sparkSession
    light = materialize(sigs.groupBy("cls").agg(F.first("size").alias("size"), F.first("bits").alias("bits"), F.min("key").alias("key"), F.count_distinct("key").alias("copies")), "classes")
    one = one_each(df, key, text, sigs, light)
    classes = spark.sparkContext.broadcast(sketch.frequency_classes(one.select("text"), functools.partial(_sets, n=n), bits))  # 2**bits bytes
    return light, entries(one, "text", n, t, classes, bits, frequent_class(light.count(), share, least))


def index_profile(df: DataFrame, key: str, text: str, n: int = 5, t: float = 0.8, bits: int = 20) -> DataFrame:
    """(kind, texts, entries, lists, longest) of the index: single tokens, and combinations of frequent ones."""
    sigs = materialize(signatures(df, key, text, n), "signatures")
    light, index = index_of(df, key, text, n, t, sigs, bits, 600, 64)
    per = index.groupBy("sig", F.when(F.col("side") < 4, "single").otherwise("combination").alias("kind")).count()
    return per.groupBy("kind").agg(F.lit(light.count()).alias("texts"), F.sum("count").alias("entries"), F.count("*").alias("lists"), F.max("count").alias("longest"))


def near_pairs(df: DataFrame, key: str, text: str, n: int = 5, t: float = 0.8, bits: int = 20) -> DataFrame:
    """(a, b): all pairs of keys, a < b, whose texts have Jaccard of at least t, copies included."""
    sigs = materialize(signatures(df, key, text, n), "signatures")
    links = class_links(df, key, text, n, t, sigs, bits).select("a", "b")
    m = sigs.select("key", "cls").distinct()
    ma, mb = m.select(F.col("cls").alias("a"), F.col("key").alias("ka")), m.select(F.col("cls").alias("b"), F.col("key").alias("kb"))
    across = links.join(ma, "a").join(mb, "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    copies = ma.join(mb, F.col("a") == F.col("b")).where("ka < kb").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    return across.where("a <> b").union(copies).distinct()


def near_groups(df: DataFrame, key: str, text: str, n: int = 5, t: float = 0.8, bits: int = 20) -> DataFrame:
    """(key, class_id, group_id, copies, links), one row per key with a text long enough: its class (least key with the same
    set), its group (least key linked directly or through others), the rows of its class and the classes linked to it."""
    sigs = materialize(signatures(df, key, text, n), "signatures")
    links = materialize(class_links(df, key, text, n, t, sigs, bits).select("a", "b"), "links")
    ends = links.select(F.col("a").alias("cls")).union(links.select(F.col("b").alias("cls"))).groupBy("cls").count().withColumnRenamed("count", "links")
    m = sigs.select("key", "cls").distinct()
    per = m.groupBy("cls").agg(F.min("key").alias("class_id"), F.count("*").alias("copies"))
    comp = link_components(links, "a", "b").select(F.col("vertex").alias("cls"), F.col("component").alias("comp"))
    c = per.join(ends, "cls", "left").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = c.groupBy("comp").agg(F.min("class_id").alias("group_id"))
    c = c.join(least, "comp").select("cls", "class_id", "group_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return m.join(c, "cls").select(F.col("key").alias(key), "class_id", "group_id", "copies", "links")
