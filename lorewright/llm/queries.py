"""The subpackage's queries and, where SQL can express them, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.llm import components, containers, forest, leaks, near_copies, overlap, pairs, spam_pages, splitting
from lorewright.storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(_table(spark, sf_dir, "corpus"), "chunk_key", "origin_context")


SQL["p2_found"] = r"""
SELECT DISTINCT chunk_key,
       CASE WHEN list_max(list_transform(string_split_regex(origin_context, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}。！？]'),
                                         lambda r: length(r))) > 4000
            THEN 'forced' ELSE 'natural' END AS kind
FROM corpus WHERE length(origin_context) > 4000
"""


@query
def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_texts(_table(spark, sf_dir, "corpus"), "chunk_key", "origin_context").distinct()


@query
def p2_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cut text its length, and whether the pieces are in order, within the limit, without a gap, and each overlaps the
    next by 1 to 250 characters (0 only after a run of exactly the limit)."""
    corpus = _table(spark, sf_dir, "corpus")
    p = splitting.split_texts(corpus, "chunk_key", "origin_context").distinct()
    a = p.groupBy("chunk_key").agg(F.array_sort(F.collect_list(F.struct("piece", "start_pos", "end_pos", F.length("piece_text").alias("n")))).alias("x"))  # bounded by the pieces of a text
    step = F.transform(F.sequence(F.lit(1), F.size("x") - 1), lambda i: F.struct((F.get("x", i - 1)["end_pos"] - F.get("x", i)["start_pos"]).alias("o"), F.get("x", i)["n"].alias("n")))
    return a.select(
        "chunk_key",
        F.element_at("x", -1)["end_pos"].alias("chars"),
        (F.get("x", F.lit(0))["start_pos"] == 0).alias("whole"),
        F.forall("x", lambda y: (y["n"] <= 4000) & (y["n"] == y["end_pos"] - y["start_pos"])).alias("within"),
        F.forall(step, lambda s: (s["o"] > 0) & (s["o"] <= 250) | (s["o"] == 0) & (s["n"] == 4000)).alias("overlapping"),
    )


SQL["p2_checks"] = "SELECT DISTINCT chunk_key, length(origin_context)::INT AS chars, true AS whole, true AS within, true AS overlapping FROM corpus WHERE length(origin_context) > 4000"


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.linked_entities(_table(spark, sf_dir, "entities"), _table(spark, sf_dir, "entity_matches"))


_P6 = """
WITH RECURSIVE known AS (SELECT DISTINCT entity_id FROM entities WHERE entity_id IS NOT NULL),
e AS (
  SELECT DISTINCT least(left_entity_id, right_entity_id) AS a, greatest(left_entity_id, right_entity_id) AS b
  FROM entity_matches WHERE is_same AND left_entity_id <> right_entity_id
    AND left_entity_id IN (SELECT entity_id FROM known) AND right_entity_id IN (SELECT entity_id FROM known)),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM s UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a)
"""
SQL["p6_found"] = _P6 + "SELECT min(b) AS group_id, a AS entity_id FROM reach GROUP BY a"


@query
def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.entity_groups(_table(spark, sf_dir, "entities"), _table(spark, sf_dir, "entity_matches"))


SQL["p6_groups"] = _P6 + """, g AS (SELECT min(b) AS group_id, a FROM reach GROUP BY a)
SELECT entity_id, coalesce(group_id, entity_id) AS group_id FROM known LEFT JOIN g ON a = entity_id"""


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective_pairs(_table(spark, sf_dir, "rephrased_questions"), _table(spark, sf_dir, "preference_pairs"))


@query
def p4_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many defective texts the rules, a longer version among the responses, and a length limit tell."""
    return pairs.evidence(pairs.pair_records(_table(spark, sf_dir, "rephrased_questions"), _table(spark, sf_dir, "preference_pairs")))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies.near_pairs(_table(spark, sf_dir, "corpus"), "chunk_key", "origin_context", n=3, t=0.6)
    return found.select(F.col("a").alias("chunk_key_a"), F.col("b").alias("chunk_key_b"))


@query
def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_groups(_table(spark, sf_dir, "corpus"), "chunk_key", "origin_context", n=3, t=0.6)


@query
def p5_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries and lists of either kind the index of p5_found has."""
    return near_copies.index_profile(_table(spark, sf_dir, "corpus"), "chunk_key", "origin_context", n=3, t=0.6)


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.split_records(_table(spark, sf_dir, "proposed_questions"), _table(spark, sf_dir, "rephrased_questions"))


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlap.cross_split_overlaps(_splits(spark, sf_dir))
    return found.select(F.least("eval_id", "train_id").alias("record_id_a"), F.greatest("eval_id", "train_id").alias("record_id_b")).distinct()


@query
def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(_splits(spark, sf_dir))


@query
def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of p1_report."""
    return overlap.overlap_report(_splits(spark, sf_dir)).select("split", "source", "records", "overlapping", "pairs")


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "test_items"), "item_id", ["question", "passage"])


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = forest.neighbours(_table(spark, sf_dir, "chunk_vectors"), "vec_id", "embedding", least=0.85)
    return near.select(F.least("vec_id", "neighbour").alias("vec_id_a"), F.greatest("vec_id", "neighbour").alias("vec_id_b")).distinct()


@query
def p3_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = forest.neighbours(_table(spark, sf_dir, "chunk_vectors"), "vec_id", "embedding")
    return near.groupBy("vec_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))), lambda x: x.neighbour), ",").alias("top"))


@query
def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the true neighbours of the vectors whose id is divisible by 20, against all vectors, the share that p3_top10 and
    p3_found have (both have the same forest), and the share of all pairs that the forest compared."""
    v = _table(spark, sf_dir, "chunk_vectors")
    truth = materialize(forest.exact(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding"), "truth")
    near = materialize(forest.neighbours(v, "vec_id", "embedding"), "near")
    rows = [forest.recall(near, truth, "vec_id", least).withColumn("measured", F.lit(name)) for name, least in (("p3_top10", None), ("p3_found", 0.85))]
    return rows[0].unionByName(rows[1]).crossJoin(forest.compared(v, "vec_id", "embedding").select("share"))  # one row


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages.spam_pages(_table(spark, sf_dir, "documents"), "doc_id", "text", "lang").select("doc_id").distinct()


@query
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.pack(_table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document whether it lies in containers as it should."""
    packed = materialize(containers.pack(_table(spark, sf_dir, "documents"), "doc_id", "text"), "packed")  # the plan uses it twice
    return containers.checks(packed, "doc_id")


SQL["p7_checks"] = "SELECT doc_id, true AS pieces_right FROM documents"


@query
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers there are, and how much of their room is used."""
    return containers.fill(containers.pack(_table(spark, sf_dir, "documents"), "doc_id", "text"))


# ---------------------------------------------------------------- SQL by brute force, for the small tables

# NFKC as far as SQL has it: composed letters, full-width forms, ligatures
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_W = "regexp_extract_all(lower(regexp_replace(nfc_normalize(replace(replace(translate({0}, '" + _WIDE[0] + "', '" + _WIDE[1].replace("{", "{{").replace("}", "}}") + r"'), 'ﬁ', 'fi'), 'ﬂ', 'fl')), '\p{{Cf}}', '', 'g')), '[\p{{L}}\p{{N}}]+')"
_EDGE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

SQL["p1_found"] = f"""
WITH r AS (SELECT question_id AS id, split, question AS t FROM proposed_questions UNION ALL SELECT variant_id, split, result FROM rephrased_questions),
s AS (SELECT DISTINCT id, regexp_replace(lower(split), '^{_EDGE}+|{_EDGE}+$', '', 'g') AS split, list_distinct({_W.format("t")}) AS w FROM r WHERE id IS NOT NULL AND t IS NOT NULL),
e AS (SELECT id, len(w) AS n, unnest(w) AS x FROM s WHERE split IN ('dev', 'test')), t AS (SELECT id, len(w) AS n, unnest(w) AS x FROM s WHERE split = 'train'),
c AS (SELECT e.id AS a, t.id AS b, e.n AS na, t.n AS nb, count(*) AS shared FROM e JOIN t USING (x) GROUP BY ALL)
SELECT DISTINCT least(a, b) AS record_id_a, greatest(a, b) AS record_id_b FROM c WHERE shared >= 0.75 * (na + nb - shared) - 1e-9"""

SQL["p1_counts"] = SQL["p1_found"].split("SELECT DISTINCT least(a, b)")[0] + f""",
k AS (SELECT DISTINCT a, b FROM c WHERE shared >= 0.75 * (na + nb - shared) - 1e-9), o AS (SELECT a, count(*) AS n FROM k GROUP BY a),
q AS (SELECT question_id AS id, split, source FROM proposed_questions UNION SELECT variant_id, split, source FROM rephrased_questions),
i AS (SELECT DISTINCT id, regexp_replace(lower(split), '^{_EDGE}+|{_EDGE}+$', '', 'g') AS split, source FROM q)
SELECT split, source, count(*) AS records, count(o.a) AS overlapping, coalesce(sum(n), 0)::BIGINT AS pairs FROM i LEFT JOIN o ON o.a = i.id WHERE split IN ('dev', 'test') GROUP BY split, source"""

SQL["p3_found"] = """
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE len(embedding) = 96),
u AS (SELECT * FROM v WHERE NOT list_bool_or(list_transform(e, lambda x: isnan(x) OR isinf(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id),
k AS (SELECT a, b, s FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 10)
SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM k WHERE s >= 0.85"""

_P5 = f"""
WITH w AS (SELECT DISTINCT chunk_key, {_W.format("origin_context")} AS w FROM corpus WHERE chunk_key IS NOT NULL AND origin_context IS NOT NULL),
g AS (SELECT chunk_key, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w WHERE len(w) >= 3),
x AS (SELECT chunk_key, len(g) AS n, unnest(g) AS x FROM g),
c AS (SELECT a.chunk_key AS a, b.chunk_key AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM x a JOIN x b ON a.x = b.x AND a.chunk_key < b.chunk_key GROUP BY ALL),
f AS (SELECT a, b, shared = na AND shared = nb AS same FROM c WHERE shared >= 0.6 * (na + nb - shared) - 1e-9)"""
SQL["p5_found"] = _P5 + " SELECT a AS chunk_key_a, b AS chunk_key_b FROM f"

SQL["p5_groups"] = (
    _P5.replace("WITH w AS", "WITH RECURSIVE w AS", 1)
    + """,
cl AS (SELECT g.chunk_key, coalesce(min(a), g.chunk_key) AS class_id FROM g LEFT JOIN f ON b = g.chunk_key AND same GROUP BY g.chunk_key),
s AS (SELECT a, b, same FROM f UNION ALL SELECT b, a, same FROM f), reach(a, b) AS (SELECT a, b FROM s UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a),
gr AS (SELECT a, min(b) AS m FROM reach GROUP BY a), n AS (SELECT class_id, count(*) AS copies FROM cl GROUP BY class_id),
l AS (SELECT s.a, count(DISTINCT cl.class_id) AS links FROM s JOIN cl ON cl.chunk_key = s.b WHERE NOT same GROUP BY s.a)
SELECT cl.chunk_key, cl.class_id, least(coalesce(m, cl.chunk_key), cl.chunk_key) AS group_id, copies, coalesce(links, 0) AS links
FROM cl JOIN n USING (class_id) LEFT JOIN gr ON gr.a = cl.chunk_key LEFT JOIN l ON l.a = cl.chunk_key"""
)

SQL["p8_found"] = f"""
WITH d AS (SELECT doc_id, {_W.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS x FROM d WHERE len(w) >= 13),
i AS (SELECT item_id, {_W.format("question")} AS w FROM test_items WHERE question IS NOT NULL UNION SELECT item_id, {_W.format("passage")} FROM test_items WHERE passage IS NOT NULL),
ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS x FROM i WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (x) WHERE item_id IS NOT NULL"""
