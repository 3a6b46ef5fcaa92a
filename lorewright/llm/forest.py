"""Problem 3: the k most similar vectors of every vector, by a forest of hash strings.

Each tree gives every vector a string of 63 bits: the number of its nearest centre (7 to 11 bits, about one centre for 400
vectors, in the order of their main direction, so that near ones share a prefix), the nearest of that centre's 16 sub-centres
(4 bits), and the sides of random hyperplanes through the sub-centre. The centres are fitted per tree on a bounded sample of
vectors (``sample``, at most 32,768 by default); every vector is indexed.

A tree is the sorted array of its strings. A vector descends in every tree to its longest matching prefix and then ascends in
all trees at once, bit by bit, until the prefixes reached hold ``candidates`` vectors in all; how many vectors a prefix holds
is told by a table of trees x 2**15 exact counts at most (below them a plane halves what there is). A prefix of more than four
times that many vectors is not ascended to, which bounds the work of a subtree at any size of the collection. Subtrees are
the unit of distribution: each is brought together once per tree, sorted, and every vector is compared with the range of the
array that shares its prefix; cosines are exact. The best of all trees are merged per vector.

Cost is vectors x (centres + candidates). What is lost are neighbours that share no reached prefix in any tree; it is
measured by ``recall`` against an exact search (figures in the README, with the share of pairs compared).

Defined results: vectors that are null, of another length, all zero or not finite take no part; equal vectors are one class,
searched once and expanded to at most k neighbours each; ties go to the smaller id; repeated rows count once; fewer than
k other vectors give as many rows as there are; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewright.storage import materialize

BITS, NARROW = 63, 4  # of a string, of the sub-centre
_U = np.uint64


def _unit(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the usable vectors of a list column."""
    size = np.asarray(col.value_lengths().fill_null(-1))
    rows = np.flatnonzero(size == dim)
    x = col.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim) if len(rows) else np.zeros((0, dim))
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        ok = np.isfinite(norm) & (norm > 0)
        x = x[ok] / norm[ok, None]
    return rows[ok], x.astype(np.float32)


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, cls, v): unit vectors as float32 bytes; cls names equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = _unit(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([r.tobytes() for r in x], pa.binary())], names=["key", "v"])

    kept = df.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<float>")).where(F.col("key").isNotNull())
    return kept.mapInArrow(run, "key bigint, v binary").withColumn("cls", F.xxhash64("v"))


def _vectors(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dim)


# ---------------------------------------------------------------- the strings


def _centres(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 2) -> np.ndarray:
    """k spherical centres of x (fewer where x has fewer rows), in the order of their main direction. After few rounds the
    centres of different trees still differ, and with them the vectors that lie between two of them."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        of = np.argmax(x @ c.T, axis=1)
        order = np.argsort(of, kind="stable")
        first = np.flatnonzero(np.diff(of[order], prepend=-1))
        total = np.add.reduceat(x[order], first, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c[of[order][first]] = np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), c[of[order][first]])
    return c[np.argsort(np.linalg.svd(c - c.mean(axis=0), full_matrices=False)[0][:, 0], kind="stable")]


class Tree:
    """The hash functions of one tree."""

    def __init__(self, sample: np.ndarray, tree: int, seed: int, wide: int):
        rng = np.random.default_rng([seed, tree])
        self.leaf_bits, self.signs = wide + NARROW, BITS - wide - NARROW
        self.top = _centres(sample, 1 << wide, rng)
        of = np.argmax(sample @ self.top.T, axis=1)
        self.sub = []
        for i, c in enumerate(self.top):
            own = sample[of == i]
            if len(own) < 2 << NARROW:  # too few to tell sub-centres: the nearest of the sample stand in
                own = sample[np.argsort(-(sample @ c), kind="stable")[: 2 << NARROW]]
            self.sub.append(_centres(own, 1 << NARROW, rng, 4))
        self.planes = rng.standard_normal((sample.shape[1], self.signs)).astype(np.float32)

    def code(self, x: np.ndarray) -> np.ndarray:
        a = np.argmax(x @ self.top.T, axis=1)
        b, side = np.zeros(len(x), np.int64), np.zeros((len(x), self.signs), bool)
        order = np.argsort(a, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
            if len(at):
                c = self.sub[a[at[0]]]
                b[at] = np.argmax(x[at] @ c.T, axis=1)
                side[at] = (x[at] - c[b[at]]) @ self.planes > 0
        return (((a.astype(np.int64) << NARROW) | b) << self.signs) | (side @ (1 << np.arange(self.signs - 1, -1, -1, dtype=np.int64)))


def fit(one: DataFrame, dim: int, trees: int | None, seed: int, sample: int) -> list[Tree]:
    """The trees, each fitted in a task of its own on the same at most ``sample`` vectors (those with the least hash). The
    number of centres, and where none is given that of trees (7 to 15), grows with the logarithm of the number of vectors."""
    spark = one.sparkSession
    rows = one.select(F.approx_count_distinct("cls")).first()[0]
    wide = min(max(round(np.log2(max(rows, 1) / 400)), 7), 11)
    trees = trees or 7 + 2 * (wide - 7)
    got = one.orderBy(F.xxhash64("cls"), "cls").limit(sample).select("v").collect()  # bounded: sample x dim x 4 bytes
    if not got:
        return []
    held = spark.sparkContext.broadcast(np.frombuffer(b"".join(r.v for r in got), np.float32).reshape(-1, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([pickle.dumps(Tree(held.value, t, seed, wide), 5)], pa.binary())], names=["id", "tree"])

    import pickle

    rows = spark.range(0, trees, 1, trees).mapInArrow(run, "id bigint, tree binary").collect()  # at most (2**11 + 2**15) x dim x 4 bytes each
    return [pickle.loads(r.tree) for r in sorted(rows, key=lambda r: r.id)]


def strings(one: DataFrame, dim: int, forest) -> DataFrame:
    """(cls, v, codes): the strings of each vector in all trees. forest: broadcast trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column(1), dim)
            codes = np.stack([t.code(x) for t in forest.value], axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], names=["cls", "v", "codes"])

    return one.select("cls", "v").mapInArrow(run, "cls bigint, v binary, codes array<bigint>")


class Levels:
    """How many vectors the prefixes of each length hold: exactly up to the leaf, halved by each plane below."""

    def __init__(self, leaves: np.ndarray, candidates: int, cap: int):
        self.candidates, self.cap = candidates, cap
        self.leaf_bits = leaves.shape[1].bit_length() - 1
        self.size = [leaves.reshape(len(leaves), 1 << bits, -1).sum(axis=2) for bits in range(self.leaf_bits + 1)]

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(root, stop), each rows x trees: the shortest prefix that a subtree may have, and the length to which a vector
        ascends there: the same in all trees but where the root is longer."""
        n, trees = codes.shape
        deep = self.leaf_bits
        held = np.zeros((BITS + 1, n))  # vectors in all trees, by length of the prefix
        root = np.full((n, trees), BITS, np.int64)
        for t in range(trees):
            leaf = codes[:, t] >> (BITS - deep)
            for bits in range(BITS, -1, -1):
                s = self.size[bits][t, leaf >> (deep - bits)] if bits <= deep else self.size[deep][t, leaf] / 2.0 ** (bits - deep)
                held[bits] += s
                root[s <= self.cap, t] = bits
        enough = held - trees >= self.candidates  # without itself
        enough[0] = True
        stop = BITS - np.argmax(enough[::-1], axis=0)
        return root, np.maximum(stop[:, None], root)


def leaf_counts(coded: DataFrame, trees: int, leaf_bits: int) -> np.ndarray:
    """Vectors per tree and leaf; at most trees x 2**15 numbers whatever the size."""
    leaf = F.posexplode(F.transform("codes", lambda c: F.shiftright(c, BITS - leaf_bits))).alias("tree", "leaf")
    out = np.zeros((trees, 1 << leaf_bits), np.int64)
    for r in coded.select(leaf).groupBy("tree", "leaf").count().collect():
        out[r.tree, r.leaf] = r["count"]
    return out


def subtrees(coded: DataFrame, levels) -> DataFrame:
    """(g, code, stop, cls, v): each vector in its subtree g of every tree. levels: broadcast Levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1), np.int64)
            root, stop = levels.value.of(codes)
            for t in range(codes.shape[1]):
                g = (codes[:, t] >> (BITS - root[:, t])) * 64 * codes.shape[1] + root[:, t] * codes.shape[1] + t
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(codes[:, t]), pa.array(stop[:, t].astype(np.int32)), b.column(0), b.column(1)], names=["g", "code", "stop", "cls", "v"])

    return coded.select("cls", "v", "codes").mapInArrow(run, "g bigint, code bigint, stop int, cls bigint, v binary")


def ranges(code: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[lo, hi) of the entries of a sorted array of strings that share the first ``stop`` bits with each entry."""
    c, shift = code.astype(_U), (BITS - stop).astype(_U)
    first = (c >> shift) << shift
    return np.searchsorted(c, first, "left"), np.searchsorted(c, first + (_U(1) << shift) - _U(1), "right")


def _best(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, least: float | None, tile: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour, cosine) of each row's k best others in its range."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for i in range(0, len(x), tile):
        j = min(i + tile, len(x))
        a, z = int(lo[i:j].min()), int(hi[i:j].max())
        m = x[i:j] @ x[a:z].T
        col = np.arange(a, z)
        m[(col < lo[i:j, None]) | (col >= hi[i:j, None]) | (col == np.arange(i, j)[:, None])] = -3
        if least is not None:
            row, c = np.nonzero(m >= least)
        else:
            kk = min(k, m.shape[1])
            c = np.argpartition(-m, kk - 1, axis=1)[:, :kk].ravel()
            row = np.repeat(np.arange(j - i), kk)
        cos = m[row, c]
        ok = cos > -2
        row, c, cos = row[ok], c[ok], cos[ok]
        order = np.lexsort((-cos, row))
        row, c, cos = row[order], c[order], cos[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((row[keep] + i, c[keep] + a, cos[keep]))
    return tuple(np.concatenate(p) for p in zip(*out))


def _by_subtree(use):
    """Rows sorted by (g, code) to what ``use`` makes of each subtree; a subtree may run over several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(g)) + 1
            if held and held[-1].column(0)[0].as_py() != g[0]:
                yield use(held)
                held = []
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(g)]):
                held.append(b.slice(s, e - s))
                if e < len(g):
                    yield use(held)
                    held = []
        if held:
            yield use(held)

    return run


def _arrays(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    t = pa.Table.from_batches(held)
    return t.column(1).to_numpy(), t.column(2).to_numpy(), t.column(3).to_numpy(), t.column(4)


def _coded(df: DataFrame, key: str, vector: str, dim: int, trees: int | None, candidates: int, sample: int, seed: int):
    """(vectors, subtrees): the usable vectors, and their places in the forest; None without any."""
    spark = df.sparkSession
    vectors = materialize(usable(df, key, vector, dim), "vectors")
    one = vectors.groupBy("cls").agg(F.first("v").alias("v"))
    forest = fit(one, dim, trees, seed, sample)
    if not forest:
        return vectors, None
    coded = materialize(strings(one, dim, spark.sparkContext.broadcast(forest)), "strings")
    levels = spark.sparkContext.broadcast(Levels(leaf_counts(coded, len(forest), forest[0].leaf_bits), candidates, 4 * candidates))
    return vectors, subtrees(coded, levels).repartition("g").sortWithinPartitions("g", "code")


def neighbours(df: DataFrame, key: str, vector: str, dim: int = 96, k: int = 10, trees: int | None = None, candidates: int = 2500, least: float | None = None, sample: int = 32768, seed: int = 7) -> DataFrame:
    """(key, neighbour, cosine, rank): the k most similar other vectors of every usable vector, best first; with ``least``
    only those of at least that cosine."""
    vectors, places = _coded(df, key, vector, dim, trees, candidates, sample, seed)
    if places is None:
        return vectors.sparkSession.createDataFrame([], f"`{key}` bigint, neighbour bigint, cosine float, rank int")

    def use(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        code, stop, cls, v = _arrays(held)
        r, c, cos = _best(_vectors(v, dim), *ranges(code, stop), k, least)
        return pa.RecordBatch.from_arrays([pa.array(cls[r]), pa.array(cls[c]), pa.array(cos)], names=["a", "b", "cosine"])

    near = places.mapInArrow(_by_subtree(use), "a bigint, b bigint, cosine float")
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    near = near.repartition("a").dropDuplicates(["a", "b"]).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    return _expanded(vectors, near, key, k)


def compared(df: DataFrame, key: str, vector: str, dim: int = 96, trees: int | None = None, candidates: int = 2500, sample: int = 32768, seed: int = 7) -> DataFrame:
    """(vectors, compared, share): cosines that neighbours computes in all trees, and their share of all ordered pairs."""
    vectors, places = _coded(df, key, vector, dim, trees, candidates, sample, seed)
    if places is None:
        return vectors.sparkSession.createDataFrame([(0, 0, None)], "vectors bigint, compared bigint, share double")

    def use(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        code, stop, _, _ = _arrays(held)
        lo, hi = ranges(code, stop)
        return pa.RecordBatch.from_arrays([pa.array([int((hi - lo - 1).sum())])], names=["m"])

    per = places.mapInArrow(_by_subtree(use), "m bigint").agg(F.sum("m").alias("compared"))
    per = vectors.agg(F.count_distinct("cls").alias("vectors")).crossJoin(per)  # one row each
    return per.withColumn("share", F.col("compared") / (F.col("vectors") * (F.col("vectors") - 1)))


def _expanded(vectors: DataFrame, near: DataFrame, key: str, k: int) -> DataFrame:
    """(key, neighbour, cosine, rank) of the k best of every vector, from those of every class: near (a, b, cosine)."""
    member = vectors.select("key", "cls").distinct()
    few = member.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("key"))).where(F.col("r") <= k + 1)
    own = vectors.select(F.col("cls").alias("a")).distinct()
    pairs = near.union(own.select("a", F.col("a").alias("b"), F.lit(1.0).cast("float").alias("cosine")))
    to = pairs.join(few.select(F.col("cls").alias("b"), F.col("key").alias("neighbour")), "b")
    top = Window.partitionBy("key").orderBy(F.desc("cosine"), "neighbour")
    return (
        member.select(F.col("cls").alias("a"), "key")
        .join(to, "a")
        .where("key <> neighbour")
        .withColumn("rank", F.row_number().over(top))
        .where(F.col("rank") <= k)
        .select(F.col("key").alias(key), "neighbour", "cosine", "rank")
    )


# ---------------------------------------------------------------- exact search, to measure against


def exact(queries: DataFrame, df: DataFrame, key: str, vector: str, dim: int = 96, k: int = 10, block: int = 4096) -> DataFrame:
    """As neighbours, for the rows of ``queries`` (a stated set) by comparing each with all rows of df. Queries are dealt to
    blocks of about ``block``; a task holds one block and reads all rows as a stream, keeping its k best."""
    q = materialize(usable(queries, key, vector, dim).dropDuplicates(["key"]).select("key", "v"), "queries")
    parts = max(1, -(-q.count() // block))
    rows = usable(df, key, vector, dim).dropDuplicates(["key"]).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "key", "v")
    seen = q.select(F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "key", "v").unionByName(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, x, best = None, [], [], None

        def out() -> Iterator[pa.RecordBatch]:
            if best is not None and len(ids):
                s, c = best
                r, i = np.nonzero(s > -2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(c[r, i]), pa.array(s[r, i])], names=["key", "neighbour", "cosine"])

        for b in batches:
            p, kind, key_, v = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _vectors(b.column(3), dim)
            edges = np.flatnonzero((np.diff(p) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(p)]):
                if s == e:
                    continue
                if p[s] != part:
                    yield from out()
                    part, ids, x, best = p[s], np.zeros(0, np.int64), np.zeros((0, dim), np.float32), None
                if kind[s] == 0:
                    ids, x = np.concatenate([ids, key_[s:e]]), np.concatenate([x, v[s:e]])
                    best = np.full((len(x), k), -3, np.float32), np.zeros((len(x), k), np.int64)
                elif len(ids):
                    for i in range(0, len(ids), 1024):
                        m = x[i : i + 1024] @ v[s:e].T
                        m[ids[i : i + 1024, None] == key_[None, s:e]] = -3
                        both = np.concatenate([best[0][i : i + 1024], m], axis=1)
                        name = np.concatenate([best[1][i : i + 1024], np.broadcast_to(key_[s:e], m.shape)], axis=1)
                        at = np.argpartition(-both, k - 1, axis=1)[:, :k]
                        best[0][i : i + 1024], best[1][i : i + 1024] = np.take_along_axis(both, at, 1), np.take_along_axis(name, at, 1)
        yield from out()

    found = seen.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(run, "key bigint, neighbour bigint, cosine float")
    top = Window.partitionBy("key").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).withColumnRenamed("key", key)


def recall(found: DataFrame, truth: DataFrame, key: str, least: float | None = None) -> DataFrame:
    """(queries, true_neighbours, found_neighbours, recall) of found against an exact search for some of its keys."""
    t = truth.where(F.col("cosine") >= least) if least is not None else truth
    hit = t.select(key, "neighbour").join(found.select(key, "neighbour").withColumn("hit", F.lit(1)), [key, "neighbour"], "left")
    return hit.agg(F.countDistinct(key).alias("queries"), F.count("*").alias("true_neighbours"), F.count("hit").alias("found_neighbours"), (F.count("hit") / F.count("*")).alias("recall"))
