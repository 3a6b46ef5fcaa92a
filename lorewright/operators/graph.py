"""Entities: ids, name resolution, relationships, incidence, bounded subgraphs, threshold components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.storage import drop_stage, materialize, write_stage


def running_ids(df: DataFrame, order: list[str], to: str) -> DataFrame:
    """0-based number in the given order over all rows, without a window over one partition: a range partitioning sorts the
    rows, each partition counts its own, and a table of one row per partition holds the offsets."""
    d = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    sizes = d.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return d.join(F.broadcast(offsets.drop("_n")), "_part").withColumn(to, F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def group_names(entities: DataFrame, name: str = "entity_name", key: str = "entity_id") -> DataFrame:
    """(name, entities, first_id): how many ids share a name, and the least of them. Counts and minima are pre-aggregated, so
    a name that a third of the rows bears is no matter."""
    return entities.where(F.col(name).isNotNull()).groupBy(name).agg(F.count_distinct(key).alias("entities"), F.min(key).alias("first_id"))


def same_name_map(entities: DataFrame, name: str = "entity_name", key: str = "entity_id") -> DataFrame:
    """(entity_id, canonical_id): each id with the least id of its name; ids without a name stand for themselves."""
    first = entities.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(key).alias("canonical_id"))
    named = entities.select(key, name).distinct().join(first, name, "left")
    return named.groupBy(key).agg(F.min(F.coalesce("canonical_id", key)).alias("canonical_id"))


def compose(stage1: DataFrame, stage2: DataFrame, faithful: bool = False) -> DataFrame:
    """One map out of two (entity_id, canonical_id): what stage 1 maps to is mapped on by stage 2. With faithful, stage 2
    only overlays stage 1, id by id, and chains stay open."""
    if faithful:
        s2 = stage2.withColumnRenamed("canonical_id", "c2")
        return stage1.join(s2, "entity_id", "full_outer").select("entity_id", F.coalesce("c2", "canonical_id").alias("canonical_id"))
    s2 = stage2.select(F.col("entity_id").alias("canonical_id"), F.col("canonical_id").alias("c2"))
    chained = stage1.join(s2, "canonical_id", "left").select("entity_id", F.coalesce("c2", "canonical_id").alias("canonical_id"))
    return chained.unionByName(stage2.join(stage1, "entity_id", "left_anti"))


def rewrite_ids(edges: DataFrame, canonical: DataFrame, left: str, right: str) -> DataFrame:
    """Both ends of each edge replaced by their canonical ids, unmapped ones passed through."""
    for c in (left, right):
        m = canonical.select(F.col("entity_id").alias(c), F.col("canonical_id").alias("_c"))
        edges = edges.join(m, c, "left").withColumn(c, F.coalesce("_c", c)).drop("_c")
    return edges


def merge_entities(entities: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row per canonical entity: names, the first description that says something, and the chunks it stands in."""
    e = entities.join(canonical, "entity_id", "left").withColumn("id", F.coalesce("canonical_id", "entity_id"))
    said = F.when(F.trim("entity_description") != "", F.struct("entity_id", "entity_description"))
    return e.groupBy("id").agg(F.min("entity_name").alias("entity_name"), F.min(said)["entity_description"].alias("entity_description"), F.count_distinct("chunk_key").alias("chunks"), F.array_sort(F.collect_set("chunk_key")).alias("chunk_keys"))


def similar_entities(vectors: DataFrame, key: str, vector: str, group: Column, least: float) -> DataFrame:
    """(left_id, right_id, score): pairs of vectors of one group with a cosine of at least ``least``, smaller id first. Vectors
    must be usable. A group is dealt to blocks of about 2,000, and each pair of blocks meets in a task of its own, so a hot
    group is no matter; the pairs within the bound come out, not all of a group."""
    d = materialize(vectors.select(group.alias("g"), F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("g is not null and id is not null").dropDuplicates(["g", "id"]), "similar")
    n = d.groupBy("g").agg(F.ceil(F.count("*") / 2000).cast("int").alias("n"))
    own = d.join(n, "g").withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    cell = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cell = cell.select("g", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "id", "v")

    def meet(t: pa.Table) -> pa.Table:
        i, j, b, ids = (t[c].to_numpy() for c in ("i", "j", "b", "id"))
        x = np.array(t["v"].to_pylist(), np.float64)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        out = []
        for s in range(0, len(x), 1024):
            m = np.clip(x[s : s + 1024] @ x.T, -1, 1)
            r, c = np.nonzero(m >= least)
            ok = (ids[s + r] < ids[c]) & ((i[0] == j[0]) | (b[s + r] != b[c]))
            out.append((ids[s + r[ok]], ids[c[ok]], m[r[ok], c[ok]]))
        return pa.table(dict(zip(("left_id", "right_id", "score"), (np.concatenate(z) for z in zip(*out)))))

    return cell.groupBy("g", "i", "j").applyInArrow(meet, "left_id bigint, right_id bigint, score double").distinct()


def id_check(asked: DataFrame, answered: DataFrame, group: str, member: str) -> DataFrame:
    """(group, missing, extra): how many ids of each group an answer lacks, and how many it has that weren't asked."""
    a, b = (d.select(group, member).distinct().withColumn(n, F.lit(1)) for d, n in ((asked, "_asked"), (answered, "_told")))
    j = a.join(b, [group, member], "full_outer")
    return j.groupBy(group).agg(F.count_if(F.col("_told").isNull()).alias("missing"), F.count_if(F.col("_asked").isNull()).alias("extra"))


def incidence(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(vertex, other, out, ...): each edge at both of its ends (a loop twice); ends that are null are skipped."""
    rest = [c for c in edges.columns if c not in (left, right)]
    a = edges.select(F.col(left).alias("vertex"), F.col(right).alias("other"), F.lit(True).alias("outgoing"), *rest)
    b = edges.select(F.col(right).alias("vertex"), F.col(left).alias("other"), F.lit(False).alias("outgoing"), *rest)
    return a.unionByName(b).where("vertex is not null and other is not null")


def bounded_subgraph(edges: DataFrame, left: str, right: str, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, vertex, depth): vertices within ``depth`` steps of each seed, with their distance. seeds: (seed). Each step
    writes only what it reaches first."""
    spark = edges.sparkSession
    nb = incidence(edges.select(left, right).distinct(), left, right).select("vertex", "other").distinct()
    steps = [write_stage(seeds.where("seed is not null").select("seed", F.col("seed").alias("vertex"), F.lit(0).alias("depth")).distinct(), "reached")]
    for d in range(1, depth + 1):
        front = spark.read.parquet(steps[-1]).join(nb, "vertex").select("seed", F.col("other").alias("vertex"), F.lit(d).alias("depth")).distinct()
        # a vertex next to the front lies in it, in the step before, or is new
        new = front.join(spark.read.parquet(*steps[-2:]).select("seed", "vertex"), ["seed", "vertex"], "left_anti")
        steps.append(write_stage(new, "reached"))
    return spark.read.parquet(*steps)


def _min_parents(e: DataFrame) -> DataFrame:
    """(x, p): each vertex of the edges (a < b) with the least label among itself and its neighbours. Hubs pre-aggregate."""
    up = e.select(F.col("b").alias("x"), F.col("a").alias("p"))
    low = e.select(F.col("a").alias("x"), F.col("a").alias("p"))
    return up.union(low).groupBy("x").agg(F.min("p").alias("p"))


def _jump(m: DataFrame) -> DataFrame:
    """Pointer jumping: p becomes p's parent."""
    t = m.select(F.col("x").alias("p"), F.col("p").alias("pp"))
    return m.join(t, "p", "left").select("x", F.coalesce("pp", "p").alias("p"))


def link_components(edges: DataFrame, left: str, right: str, max_rounds: int = 200) -> DataFrame:
    """(vertex, component): every vertex that has a link to another one, with the least vertex of its component. Least labels
    travel along the edges and jump to the label of their label; each round contracts the graph of the one before and is a
    table in the shared folder, and the rounds end when no edge is left. The maps of all rounds, each a fraction of the one
    before, are composed at the end. Null ids and self links link nothing; repeated or reversed links count once."""
    spark = edges.sparkSession
    read = spark.read.parquet
    e = (
        edges.select(F.col(left).alias("l"), F.col(right).alias("r"))
        .where("l <> r")
        .select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"))
        .distinct()
    )
    at, maps = write_stage(e, "edges"), []
    for _ in range(max_rounds):
        e = read(at)
        maps.append(write_stage(_jump(_min_parents(e)), "parents"))
        m = read(maps[-1])
        pa = m.select(F.col("x").alias("a"), F.col("p").alias("pa"))
        pb = m.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        contracted = (
            e.join(pa, "a")
            .where("pa <> b")
            .select("b", "pa")
            .distinct()  # a hub's links to one vertex shrink before the second join
            .join(pb, "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct()
        )
        after = write_stage(contracted, "edges")
        drop_stage(spark, at)
        at = after
        if read(at).isEmpty():
            drop_stage(spark, at)
            break
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    label = read(maps[-1])
    for path in reversed(maps[:-1]):
        later = label.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        label = read(path).join(later, "p", "left").select("x", F.coalesce("pp", "p").alias("p"))
    return label.select(F.col("x").alias("vertex"), F.col("p").alias("component"))


def threshold_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(vertex, component) of the graph of similar pairs; clustering by density where every point is a core point is the
    same."""
    return link_components(edges, left, right)


def filter_relationships(rel: DataFrame, entities: DataFrame, chunk: str, left_name: str, right_name: str, name: str = "entity_name", key: str = "entity_id") -> DataFrame:
    """Relationships whose ends are both entities of their own chunk, with the ids; of a name told twice in a chunk the
    last id counts."""
    ids = entities.where(F.col(name).isNotNull() & F.col(chunk).isNotNull()).groupBy(chunk, name).agg(F.max(key).alias("_id"))
    for c, to in ((left_name, "source_entity_id"), (right_name, "target_entity_id")):
        rel = rel.join(ids.select(chunk, F.col(name).alias(c), F.col("_id").alias(to)), [chunk, c])
    return rel


def select_relationships(inc: DataFrame, vertex: str, chunk: str, order: str, rank: Column, most: int = 10, least: int = 2) -> DataFrame:
    """For a question about a vertex: of its relationships the first of each chunk, of these a keyed sample of at most
    ``most``, for vertices with at least ``least``."""
    first = inc.groupBy(vertex, chunk).agg(F.min_by(F.struct(*[c for c in inc.columns if c not in (vertex, chunk)]), order).alias("_r")).select(vertex, chunk, "_r.*")
    w = Window.partitionBy(vertex).orderBy(rank, order)
    kept = first.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= most)
    enough = kept.groupBy(vertex).agg(F.count("*").alias("picked")).where(F.col("picked") >= least)
    return kept.join(enough, vertex)


def _valid_answers(lots: DataFrame, resolver, attempts: int) -> DataFrame:
    """(member, into) of the lots whose answer names members of the lot only; the others are asked again."""
    out, open_ = None, lots
    for _ in range(attempts):
        said = materialize(resolver(open_).select("member", "into"), "said")
        at = open_.select("group", "lot", "member")
        told = said.join(at, "member", "left").join(at.select(F.col("group").alias("g2"), F.col("lot").alias("l2"), F.col("member").alias("into")), "into", "left")
        bad = told.where("group is not null and not coalesce(group = g2 and lot = l2, false)").select("group", "lot").distinct()
        bad = materialize(bad, "invalid")
        good = said.join(at, "member").join(bad, ["group", "lot"], "left_anti").select("member", "into")
        out = good if out is None else out.unionByName(good)
        if bad.isEmpty():
            break
        open_ = open_.join(bad, ["group", "lot"], "left_semi")
    return out


def resolve_groups(groups: DataFrame, resolver, size: int = 10, max_merges: int = 5, idle: int = 2, attempts: int = 3) -> DataFrame:
    """Merge the members of each group with a resolver until it finds nothing more. groups: (group, member, text).

    Each round deals the live members of a group to lots of ``size`` in an order that changes with the round; ``resolver``
    takes a frame (group, lot, member, text) and returns (member, into). A lot whose answer names a member that isn't in it, or
    one as part of itself, is asked again, ``attempts`` times in all; what is still invalid then stays as it was. A group leaves after ``max_merges`` rounds that merged in it or ``idle`` that didn't,
    whatever the other groups do; ends when no group is left. Returns (member, canonical)."""
    spark = groups.sparkSession
    none = F.lit(0)
    at = write_stage(groups.select("group", "member", "text", F.col("member").alias("canonical"), none.alias("merged"), none.alias("quiet")), "resolve")
    active = (F.col("merged") < max_merges) & (F.col("quiet") < idle)
    for turn in range(max_merges + idle):
        now = spark.read.parquet(at)
        live = now.where(active & (F.col("canonical") == F.col("member")))
        # a group is dealt by hash to shares of about a hundred lots, so that no window holds a whole group
        shares = live.groupBy("group").agg(F.ceil(F.count("*") / F.lit(100 * size)).alias("shares"))
        turned = F.md5(F.concat(F.lit(f"{turn}:"), F.col("member").cast("string")))
        w = Window.partitionBy("group", "share").orderBy("turned", "member")
        dealt = live.join(shares, "group").withColumn("turned", turned).withColumn("share", F.pmod(F.xxhash64("turned"), F.col("shares")))
        lots = dealt.withColumn("lot", F.concat_ws("-", "share", F.floor((F.row_number().over(w) - 1) / size))).select("group", "lot", "member", "text")
        lots = materialize(lots, "lots")
        if lots.isEmpty():
            break
        said = _valid_answers(lots, resolver, attempts)
        ok = said.join(lots.select("member", "group", "lot"), "member").join(lots.select(F.col("member").alias("into"), F.col("group").alias("g2"), F.col("lot").alias("l2")), "into")
        ok = ok.where("group = g2 and lot = l2 and into < member").groupBy("group", "member").agg(F.min("into").alias("into"))
        ok = materialize(ok, "merged")
        hit = ok.select(F.col("group").alias("g2"), F.lit(True).alias("hit")).distinct()
        # chains inside a round are closed by following each answer until it stands still
        for _ in range(0 if ok.isEmpty() else 64):
            t = ok.select("group", F.col("member").alias("into"), F.col("into").alias("on"))
            nxt = materialize(ok.join(t, ["group", "into"], "left").select("group", "member", F.coalesce("on", "into").alias("into"), F.col("on").isNotNull().alias("moved")), "merged")
            ok = nxt.select("group", "member", "into")
            if nxt.where("moved").isEmpty():
                break
        m = ok.select("group", F.col("member").alias("canonical"), "into")
        one, merges = F.when(active, 1).otherwise(0), F.col("hit").isNotNull()
        after = now.join(m, ["group", "canonical"], "left").join(hit, F.col("group") == F.col("g2"), "left")
        at2 = write_stage(
            after.select(
                "group",
                "member",
                "text",
                F.coalesce("into", "canonical").alias("canonical"),
                (F.col("merged") + F.when(merges, one).otherwise(0)).alias("merged"),
                (F.col("quiet") + F.when(merges, 0).otherwise(one)).alias("quiet"),
            ),
            "resolve",
        )
        drop_stage(spark, at)
        at = at2
    return spark.read.parquet(at).select("member", "canonical")
