"""Queries over entities and their matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.operators import graph, tiers
from lorewright.plans.registry import query, table

_ENT = "e AS (SELECT DISTINCT entity_id, entity_name, entity_description, chunk_key, source FROM entities)"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entities").select("entity_id", "entity_name", "entity_description", "chunk_key", "source").distinct()


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches as relationships between entities."""
    m = table(spark, sf_dir, "entity_matches")
    return m.select("match_id", "left_entity_id", "right_entity_id", "is_same", "score", "judge").distinct()


_EDGES = "m AS (SELECT DISTINCT match_id, left_entity_id, right_entity_id, is_same, score, judge FROM entity_matches)"


@query(f"WITH {_ENT} SELECT entity_id, row_number() OVER (ORDER BY chunk_key NULLS FIRST, entity_id) - 1 AS running_id FROM e")
def entity_running_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.running_ids(_entities(spark, sf_dir).select("entity_id", "chunk_key"), ["chunk_key", "entity_id"], "running_id").select("entity_id", "running_id")


@query(f"WITH {_ENT} SELECT entity_name, count(DISTINCT entity_id) AS entities, min(entity_id) AS first_id FROM e WHERE entity_name IS NOT NULL GROUP BY entity_name")
def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.group_names(table(spark, sf_dir, "entities"))


_CANON = f"""{_ENT}, f AS (SELECT entity_name, min(entity_id) AS c FROM e WHERE entity_name IS NOT NULL GROUP BY entity_name),
k AS (SELECT entity_id, min(coalesce(c, entity_id)) AS canonical_id FROM e LEFT JOIN f USING (entity_name) GROUP BY entity_id)"""


@query(f"WITH {_CANON} SELECT entity_id, canonical_id FROM k")
def entity_same_name_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.same_name_map(table(spark, sf_dir, "entities"))


@query(
    f"""WITH {_CANON}
SELECT canonical_id AS id, min(entity_name) AS entity_name,
       arg_min(entity_description, (e.entity_id, entity_description)) FILTER (trim(entity_description) <> '') AS entity_description, count(DISTINCT chunk_key) AS chunks,
       coalesce(array_to_string(list_sort(list(DISTINCT chunk_key) FILTER (chunk_key IS NOT NULL)), ','), '') AS chunk_keys
FROM e JOIN k USING (entity_id) GROUP BY canonical_id"""
)
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entities(spark, sf_dir)
    return graph.merge_entities(e, graph.same_name_map(e)).withColumn("chunk_keys", F.array_join("chunk_keys", ","))


@query(
    f"""WITH {_CANON}, {_EDGES}
SELECT match_id, coalesce(a.canonical_id, left_entity_id) AS left_entity_id, coalesce(b.canonical_id, right_entity_id) AS right_entity_id
FROM m LEFT JOIN k a ON a.entity_id = left_entity_id LEFT JOIN k b ON b.entity_id = right_entity_id"""
)
def entity_edges_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    canonical = graph.same_name_map(table(spark, sf_dir, "entities"))
    return graph.rewrite_ids(_edges(spark, sf_dir).select("match_id", "left_entity_id", "right_entity_id"), canonical, "left_entity_id", "right_entity_id")


_INC = f"""{_EDGES}, i AS (SELECT match_id, left_entity_id AS vertex, right_entity_id AS other, true AS outgoing FROM m
  UNION ALL SELECT match_id, right_entity_id, left_entity_id, false FROM m), inc AS (SELECT * FROM i WHERE vertex IS NOT NULL AND other IS NOT NULL)"""


@query(f"WITH {_INC} SELECT match_id, vertex, other, outgoing FROM inc")
def graph_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.incidence(_edges(spark, sf_dir).select("match_id", "left_entity_id", "right_entity_id"), "left_entity_id", "right_entity_id")


@query(f"WITH {_INC} SELECT vertex, count(*) AS degree, count(DISTINCT other) AS neighbours FROM inc GROUP BY vertex")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = graph.incidence(_edges(spark, sf_dir).select("match_id", "left_entity_id", "right_entity_id"), "left_entity_id", "right_entity_id")
    return i.groupBy("vertex").agg(F.count("*").alias("degree"), F.count_distinct("other").alias("neighbours"))


@query(
    f"""WITH RECURSIVE {_INC}, nb AS (SELECT DISTINCT vertex, other FROM inc),
bfs(seed, vertex, depth) AS (SELECT DISTINCT entity_id, entity_id, 0 FROM entities WHERE entity_id IS NOT NULL
  UNION SELECT seed, other, depth + 1 FROM bfs JOIN nb USING (vertex) WHERE depth < 2)
SELECT seed, vertex, min(depth) AS depth FROM bfs GROUP BY seed, vertex"""
)
def subgraph_depth_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around every entity."""
    seeds = table(spark, sf_dir, "entities").select(F.col("entity_id").alias("seed"))
    return graph.bounded_subgraph(_edges(spark, sf_dir), "left_entity_id", "right_entity_id", seeds, 2)


@query(
    f"""WITH RECURSIVE {_EDGES}, s AS (SELECT left_entity_id AS a, right_entity_id AS b FROM m WHERE score >= 0.9 AND left_entity_id <> right_entity_id),
b AS (SELECT a, b FROM s UNION SELECT b, a FROM s), reach(a, b) AS (SELECT a, b FROM b UNION SELECT reach.a, b.b FROM reach JOIN b ON reach.b = b.a)
SELECT a AS vertex, least(a, min(b)) AS component FROM reach GROUP BY a"""
)
def entity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the graph of pairs with a score of 0.9 or more."""
    return graph.threshold_components(_edges(spark, sf_dir).where("score >= 0.9"), "left_entity_id", "right_entity_id")


_REL = """rel AS (SELECT DISTINCT m.match_id, a.chunk_key, a.entity_name AS source_entity_name, b.entity_name AS target_entity_name
  FROM entity_matches m JOIN entities a ON a.entity_id = m.left_entity_id JOIN entities b ON b.entity_id = m.right_entity_id)"""


@query(
    f"""WITH {_REL}, ids AS (SELECT chunk_key, entity_name, max(entity_id) AS id FROM entities WHERE entity_name IS NOT NULL AND chunk_key IS NOT NULL GROUP BY ALL)
SELECT r.match_id, r.chunk_key, s.id AS source_entity_id, t.id AS target_entity_id FROM rel r
JOIN ids s ON s.chunk_key = r.chunk_key AND s.entity_name = source_entity_name JOIN ids t ON t.chunk_key = r.chunk_key AND t.entity_name = target_entity_name"""
)
def relation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities")
    m = table(spark, sf_dir, "entity_matches").select("match_id", "left_entity_id", "right_entity_id")
    a = e.select(F.col("entity_id").alias("left_entity_id"), "chunk_key", F.col("entity_name").alias("source_entity_name"))
    b = e.select(F.col("entity_id").alias("right_entity_id"), F.col("entity_name").alias("target_entity_name"))
    rel = m.join(a, "left_entity_id").join(b, "right_entity_id").select("match_id", "chunk_key", "source_entity_name", "target_entity_name").distinct()
    return graph.filter_relationships(rel, e, "chunk_key", "source_entity_name", "target_entity_name").select("match_id", "chunk_key", "source_entity_id", "target_entity_id")


@query(
    f"""WITH {_INC}, c AS (SELECT DISTINCT entity_id AS other, chunk_key FROM entities WHERE chunk_key IS NOT NULL),
f AS (SELECT vertex, chunk_key, min(match_id) AS match_id FROM inc JOIN c USING (other) GROUP BY vertex, chunk_key),
r AS (SELECT *, row_number() OVER (PARTITION BY vertex ORDER BY md5('11:' || match_id), match_id, chunk_key) AS pick FROM f),
k AS (SELECT * FROM r WHERE pick <= 10), n AS (SELECT vertex, count(*) AS picked FROM k GROUP BY vertex)
SELECT vertex, chunk_key, match_id, picked FROM k JOIN n USING (vertex) WHERE picked >= 2"""
)
def relation_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = graph.incidence(_edges(spark, sf_dir).select("match_id", "left_entity_id", "right_entity_id"), "left_entity_id", "right_entity_id")
    c = table(spark, sf_dir, "entities").where("chunk_key is not null").select(F.col("entity_id").alias("other"), "chunk_key").distinct()
    inc = i.join(c, "other").select("vertex", "chunk_key", "match_id")
    return graph.select_relationships(inc, "vertex", "chunk_key", "match_id", F.struct(tiers.sample_rank("match_id", 11), "match_id", "chunk_key")).select("vertex", "chunk_key", "match_id", "picked")


@query(f"WITH {_EDGES} SELECT judge, count(*) AS pairs, round(avg(CASE WHEN is_same THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM m WHERE is_same IS NOT NULL GROUP BY judge")
def resolution_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _edges(spark, sf_dir).where("is_same is not null")
    return m.groupBy("judge").agg(F.count("*").alias("pairs"), F.round(F.avg(F.when(F.col("is_same"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query(
    f"""WITH {_CANON}, a AS (SELECT DISTINCT e.entity_name || ' -> ' || t.entity_name AS line FROM e JOIN k USING (entity_id)
JOIN (SELECT entity_id, min(entity_name) AS entity_name FROM e GROUP BY entity_id) t ON t.entity_id = canonical_id WHERE e.entity_name IS NOT NULL AND t.entity_name IS NOT NULL)
SELECT line FROM a"""
)
def name_map_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entities(spark, sf_dir)
    k = graph.same_name_map(e)
    t = e.groupBy(F.col("entity_id").alias("canonical_id")).agg(F.min("entity_name").alias("to"))
    return e.join(k, "entity_id").join(t, "canonical_id").where("entity_name is not null and to is not null").select(F.concat_ws(" -> ", "entity_name", "to").alias("line")).distinct()


@query()
def entity_resolution_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same-name groups merged by a stand-in resolver that takes equal descriptions (case and blanks aside) for the same."""
    e = _entities(spark, sf_dir).where("entity_name is not null").groupBy(F.col("entity_name").alias("group"), F.col("entity_id").alias("member")).agg(F.min(F.lower(F.trim("entity_description"))).alias("text"))

    def resolver(lots: DataFrame) -> DataFrame:
        first = lots.where("text is not null").groupBy("group", "lot", "text").agg(F.min("member").alias("into"))
        return lots.join(first, ["group", "lot", "text"]).where("member <> into").select("member", "into")

    return graph.resolve_groups(e, resolver)


@query(
    f"""WITH {_CANON}, {_EDGES}, s2 AS (SELECT right_entity_id AS entity_id, min(left_entity_id) AS canonical_id FROM m WHERE is_same AND left_entity_id < right_entity_id GROUP BY right_entity_id)
SELECT k.entity_id, coalesce(s2.canonical_id, k.canonical_id) AS canonical_id FROM k LEFT JOIN s2 ON s2.entity_id = k.canonical_id
UNION ALL SELECT entity_id, canonical_id FROM s2 WHERE entity_id NOT IN (SELECT entity_id FROM k)"""
)
def map_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same-name ids mapped on by the judges' matches."""
    s1 = graph.same_name_map(table(spark, sf_dir, "entities"))
    m = _edges(spark, sf_dir).where("is_same and left_entity_id < right_entity_id")
    s2 = m.groupBy(F.col("right_entity_id").alias("entity_id")).agg(F.min("left_entity_id").alias("canonical_id"))
    return graph.compose(s1, s2)


@query(f"WITH {_EDGES} SELECT judge, is_same, match_id, row_number() OVER (PARTITION BY judge ORDER BY is_same DESC NULLS LAST, score DESC NULLS LAST, match_id) AS place FROM m QUALIFY place <= 20")
def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 surest matches of each judge."""
    from pyspark.sql import Window

    w = Window.partitionBy("judge").orderBy(F.col("is_same").desc_nulls_last(), F.col("score").desc_nulls_last(), "match_id")
    return _edges(spark, sf_dir).withColumn("place", F.row_number().over(w)).where("place <= 20").select("judge", "is_same", "match_id", "place")


@query(
    """WITH v AS (SELECT DISTINCT vec_id, chunk_key, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE len(embedding) = 96),
u AS (SELECT * FROM v WHERE NOT list_bool_or(list_transform(e, lambda x: isnan(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))), g AS (SELECT DISTINCT vec_id, source, e FROM u JOIN corpus USING (chunk_key) WHERE source IS NOT NULL)
SELECT DISTINCT a.vec_id AS left_id, b.vec_id AS right_id FROM g a JOIN g b ON a.source = b.source AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.5"""
)
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of one source with a cosine of at least 0.5."""
    from lorewright.operators.retrieval import usable_vectors

    v = table(spark, sf_dir, "chunk_vectors")
    c = table(spark, sf_dir, "corpus").where("source is not null").select("chunk_key", "source").distinct()
    u = v.where(usable_vectors(v, "embedding", 96)).select("vec_id", "chunk_key", "embedding").join(c, "chunk_key")
    return graph.similar_entities(u, "vec_id", "embedding", F.col("source"), 0.5).select("left_id", "right_id").distinct()


@query(
    """WITH a AS (SELECT DISTINCT source, entity_id FROM entities WHERE source IS NOT NULL), b AS (SELECT DISTINCT e.source, m.right_entity_id AS entity_id FROM entity_matches m JOIN entities e ON e.entity_id = m.left_entity_id
  WHERE e.source IS NOT NULL AND m.right_entity_id IS NOT NULL)
SELECT source, count(*) FILTER (b.entity_id IS NULL) AS missing, count(*) FILTER (a.entity_id IS NULL) AS extra FROM a FULL JOIN b USING (source, entity_id) GROUP BY source"""
)
def answer_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, entities that no match of its entities names, and named ones of other sources."""
    e = table(spark, sf_dir, "entities").where("source is not null").select("source", "entity_id")
    m = table(spark, sf_dir, "entity_matches").where("right_entity_id is not null").select(F.col("left_entity_id").alias("entity_id"), "right_entity_id")
    told = m.join(e.distinct(), "entity_id").select("source", F.col("right_entity_id").alias("entity_id"))
    return graph.id_check(e, told, "source", "entity_id")


@query("SELECT DISTINCT entity_id, entity_name, dense_rank() OVER (ORDER BY entity_name, entity_id) - 1 AS place FROM entities WHERE entity_name IS NOT NULL AND entity_id IS NOT NULL")
def entities_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities in the order of their names, each with its place, as a sink writes them."""
    e = table(spark, sf_dir, "entities").where("entity_name is not null and entity_id is not null").select("entity_id", "entity_name").distinct()
    return graph.running_ids(e, ["entity_name", "entity_id"], "place").select("entity_id", "entity_name", "place")
