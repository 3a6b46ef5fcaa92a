"""Queries over questions, retrieval results, vectors and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.functions import cite, distributions, ranges
from lorewright.operators import evaluation, retrieval
from lorewright.plans.registry import query, table

_Q = """q AS (SELECT DISTINCT question_id, flavour, lower(trim(split, E' \\t\\n\\r')) AS split, source, question, objective_facts, answer, top_k_documents, chunk_key FROM proposed_questions),
g AS (SELECT DISTINCT chunk_key, id FROM corpus),
r AS (SELECT q.*, g.id AS gold FROM q JOIN g USING (chunk_key) WHERE top_k_documents IS NOT NULL)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "proposed_questions")
    s = F.lower(F.regexp_replace("split", r"^[ \t\n\r]+|[ \t\n\r]+$", ""))
    return q.withColumn("split", s).select("question_id", "flavour", "split", "source", "question", "objective_facts", "answer", "top_k_documents", "chunk_key").distinct()


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "corpus").select("chunk_key", F.col("id").alias("gold")).distinct()
    return _questions(spark, sf_dir).where("top_k_documents is not null").join(g, "chunk_key")


@query(f"WITH {_Q} SELECT question_id, k, list_contains(top_k_documents[1:k], gold) AS hit FROM r, (SELECT unnest([1, 3, 5, 10]) AS k)")
def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ks = F.array(*[F.struct(F.lit(k).alias("k"), retrieval.hit_at(F.col("top_k_documents"), F.col("gold"), k).alias("hit")) for k in (1, 3, 5, 10)])
    return _retrieved(spark, sf_dir).select("question_id", F.inline(ks))


@query(
    f"""WITH {_Q} SELECT question_id, len(list_filter([gold], lambda x: NOT list_contains(top_k_documents[1:3], x))) = 0 AS in_top_3,
len(list_filter([gold], lambda x: NOT list_contains(top_k_documents[1:5], x))) = 0 AS in_top_5 FROM r"""
)
def all_in_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, top = F.array("gold"), F.col("top_k_documents")
    return _retrieved(spark, sf_dir).select("question_id", retrieval.all_in_top(top, gold, 3).alias("in_top_3"), retrieval.all_in_top(top, gold, 5).alias("in_top_5"))


_GOLDS = """,
s AS (SELECT source, list(DISTINCT gold ORDER BY gold) AS golds FROM r GROUP BY source)"""


@query(
    f"""WITH {_Q}, n AS (SELECT chunk_key, list_sort(list(DISTINCT gold2)) AS golds FROM
  (SELECT a.chunk_key, unnest([a.id, b.id]) AS gold2 FROM (SELECT DISTINCT chunk_key, id, file_path, start_char_pos FROM corpus) a
   JOIN (SELECT DISTINCT id, file_path, start_char_pos FROM corpus) b ON a.file_path = b.file_path) GROUP BY chunk_key)
SELECT question_id, round(len(list_intersect(top_k_documents[1:5], golds)) / nullif(least(len(top_k_documents[1:5]), len(golds)), 0)::DOUBLE, 6) AS overlap_5,
round(coalesce(list_sum(list_transform(range(1, len(top_k_documents[1:5]) + 1), lambda i: CASE WHEN list_contains(golds, top_k_documents[i]) THEN 1 / log2(i + 1) ELSE 0 END))
  / nullif(list_sum(list_transform(range(1, least(len(golds), 5) + 1), lambda i: 1 / log2(i + 1))), 0), 0), 6) AS ndcg_5
FROM r JOIN n USING (chunk_key)"""
)
def overlap_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold documents: all chunks of the file that the question's chunk belongs to."""
    c = table(spark, sf_dir, "corpus").select("chunk_key", "id", "file_path").distinct()
    n = c.groupBy("file_path").agg(F.array_sort(F.collect_set("id")).alias("golds"))  # bounded by the chunks of a file
    g = c.join(n, "file_path").select("chunk_key", "golds").dropDuplicates(["chunk_key"])
    top, gold = F.col("top_k_documents"), F.col("golds")
    return _retrieved(spark, sf_dir).join(g, "chunk_key").select("question_id", F.round(retrieval.overlap_at(top, gold, 5), 6).alias("overlap_5"), F.round(retrieval.ndcg_at(top, gold, 5), 6).alias("ndcg_5"))


@query(
    f"""WITH {_Q}, v AS (SELECT flavour, coalesce(split, 'none') AS split, k, CASE WHEN list_contains(top_k_documents[1:k], gold) THEN 1.0 ELSE 0.0 END AS hit,
  CASE WHEN list_contains(top_k_documents[1:k], gold) THEN 1 / log2(list_position(top_k_documents, gold) + 1) ELSE 0.0 END AS ndcg FROM r, (SELECT unnest([1, 3, 5, 10, 20]) AS k))
SELECT flavour, split, k, count(*) AS questions, round(avg(hit) * 100, 2) AS hit, round(avg(ndcg) * 100, 2) AS ndcg FROM v GROUP BY flavour, split, k"""
)
def metric_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of all cut-offs in one aggregation."""
    top, gold = F.col("top_k_documents"), F.array("gold")
    ks = F.array(*[F.struct(F.lit(k).alias("k"), retrieval.hit_at(top, F.col("gold"), k).cast("int").alias("h"), retrieval.ndcg_at(top, gold, k).alias("n")) for k in (1, 3, 5, 10, 20)])
    d = _retrieved(spark, sf_dir).select("flavour", F.coalesce("split", F.lit("none")).alias("split"), F.inline(ks))
    return d.groupBy("flavour", "split", "k").agg(F.count("*").alias("questions"), evaluation.percent(F.col("h")).alias("hit"), evaluation.percent(F.col("n")).alias("ndcg"))


_V = """v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, a.e AS x, b.e AS y FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "chunk_vectors")
    return v.where(retrieval.usable_vectors(v, "embedding", 96)).select("vec_id", "embedding")


@query(
    f"""WITH {_V}, d AS (SELECT query_id, doc_id, list_dot_product(x, y) * 100 AS score FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM d)
SELECT query_id, rank, doc_id, round(score, 4) AS score FROM k WHERE rank <= 20"""
)
def topk_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries (ids divisible by 20) against all vectors."""
    v = _vectors(spark, sf_dir)
    return retrieval.top_k(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 96).withColumn("score", F.round("score", 4))


@query(
    f"""WITH {_V}, d AS (SELECT query_id, doc_id, list_cosine_similarity(x, y) AS score FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM d)
SELECT query_id, rank, doc_id, round(score, 5) AS score FROM k WHERE rank <= 5"""
)
def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return retrieval.top_k(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 96, k=5, scale=1.0, cosine=True).withColumn("score", F.round("score", 5))


@query(
    f"""WITH {_V}, src AS (SELECT DISTINCT vec_id, c.source FROM chunk_vectors JOIN (SELECT DISTINCT chunk_key, source FROM corpus WHERE source IS NOT NULL) c USING (chunk_key)),
d AS (SELECT query_id, doc_id, list_dot_product(x, y) * 100 AS score FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM d),
p AS (SELECT DISTINCT a.vec_id AS query_id, b.vec_id AS doc_id FROM src a JOIN src b USING (source)),
n AS (SELECT k.query_id, k.doc_id, k.rank FROM k WHERE rank <= 15 AND NOT EXISTS (SELECT 1 FROM p WHERE p.query_id = k.query_id AND p.doc_id = k.doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS negative, count(*) OVER (PARTITION BY query_id) AS have FROM n)
SELECT query_id, doc_id, rank, negative FROM r WHERE negative <= 5 AND have >= 5"""
)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives of a query: all vectors of its source."""
    v = _vectors(spark, sf_dir)
    found = retrieval.top_k(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 96, k=15)
    c = table(spark, sf_dir, "corpus").where("source is not null").select("chunk_key", "source").distinct()
    s = table(spark, sf_dir, "chunk_vectors").select("vec_id", "chunk_key").distinct().join(c, "chunk_key").select("vec_id", "source")
    near = found.join(s.select(F.col("vec_id").alias("query_id"), F.col("source").alias("sq")), "query_id").join(s.select(F.col("vec_id").alias("doc_id"), F.col("source").alias("sd")), "doc_id")
    return retrieval.hard_negatives(found, near.where("sq = sd"), 5)


@query("WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) SELECT vec_id, round(sqrt(list_dot_product(e, e)), 5) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 5) AS first FROM v")
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).dropDuplicates(["vec_id"])
    e = F.col("embedding")
    return v.select("vec_id", F.round(distributions.norm(e), 5).alias("norm"), F.round(F.get(distributions.normalized(e), 0), 5).alias("first"))


@query(
    """WITH c AS (SELECT DISTINCT question_id, chunk_key FROM proposed_questions), d AS (SELECT DISTINCT chunk_key FROM corpus),
p AS (SELECT c.question_id, count(*) AS n, count(d.chunk_key) AS m FROM c LEFT JOIN d USING (chunk_key) GROUP BY c.question_id)
SELECT c.question_id, c.chunk_key FROM c JOIN p USING (question_id) WHERE n = m"""
)
def complete_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "proposed_questions").select("question_id", "chunk_key")
    return retrieval.complete_positives(q, table(spark, sf_dir, "corpus"), "question_id", "chunk_key")


# ---------------------------------------------------------------- citations

_CLUES = r"""
a AS (SELECT DISTINCT question_id, answer, objective_facts FROM proposed_questions WHERE answer IS NOT NULL),
t AS (SELECT question_id, unnest(regexp_extract_all(array_to_string(regexp_extract_all(answer, '\[Clue\s+([^\]]+)\]', 1), ','), '\d+(?:\s*-\s*\d+)?')) AS tok FROM a),
b AS (SELECT question_id, regexp_extract(tok, '^(\d+)', 1)::BIGINT AS x, coalesce(nullif(regexp_extract(tok, '-\s*(\d+)$', 1), '')::BIGINT, regexp_extract(tok, '^(\d+)', 1)::BIGINT) AS y FROM t),
cited AS (SELECT DISTINCT question_id, unnest(generate_series(least(x, y), greatest(x, y))) AS clue FROM b),
ft AS (SELECT question_id, unnest(regexp_extract_all(objective_facts, '\d+(?:\s*-\s*\d+)?')) AS tok FROM a),
fb AS (SELECT question_id, regexp_extract(tok, '^(\d+)', 1)::BIGINT AS x, coalesce(nullif(regexp_extract(tok, '-\s*(\d+)$', 1), '')::BIGINT, regexp_extract(tok, '^(\d+)', 1)::BIGINT) AS y FROM ft),
gold AS (SELECT DISTINCT question_id, unnest(generate_series(least(x, y), greatest(x, y))) AS clue FROM fb)"""


@query(f"WITH {_CLUES} SELECT question_id, clue FROM cited")
def clue_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "proposed_questions").where("answer is not null").select("question_id", "answer").distinct()
    return q.select("question_id", F.explode(cite.clue_ids(F.col("answer"))).alias("clue"))


_COUNTS = f"""WITH {_CLUES}, j AS (SELECT coalesce(c.question_id, g.question_id) AS question_id, c.clue IS NOT NULL AS c, g.clue IS NOT NULL AS g FROM cited c FULL JOIN gold g ON c.question_id = g.question_id AND c.clue = g.clue),
n AS (SELECT question_id, count(*) FILTER (c AND g) AS b, count(*) FILTER (c AND NOT g) AS o, count(*) FILTER (g AND NOT c) AS m FROM j GROUP BY question_id),
p AS (SELECT *, coalesce(b / nullif(b + o, 0)::DOUBLE, 0.0) AS precision, coalesce(b / nullif(b + m, 0)::DOUBLE, 0.0) AS recall FROM n)"""


@query(f"{_COUNTS} SELECT question_id, b AS both, o AS only_generated, m AS only_gold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM p")
def citation_prf_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "proposed_questions").where("answer is not null").select("question_id", "answer", "objective_facts").distinct()
    gen = q.select("question_id", F.lit("").alias("doc"), F.explode(cite.clue_ids(F.col("answer"))).alias("sen"))
    gold = q.select("question_id", F.lit("").alias("doc"), F.explode(ranges.expand(F.col("objective_facts"))).alias("sen"))
    c = evaluation.citation_counts(gen, gold, "question_id")
    return c.select("*", *[F.round(v, 6).alias(k) for k, v in evaluation.prf(F.col("both"), F.col("only_generated"), F.col("only_gold")).items()])


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their clues as (clue, doc, sens): clue n stands in the n-th retrieved document, in turn, sentences n and n + 1."""
    q = table(spark, sf_dir, "proposed_questions").where("answer is not null and size(top_k_documents) > 0").select("question_id", "answer", "objective_facts", "top_k_documents").distinct()
    clue = lambda c: F.struct(c.alias("clue"), F.element_at("top_k_documents", (F.pmod(c, F.size("top_k_documents")) + 1).cast("int")).alias("doc"), F.array(c, c + 1).alias("sens"))
    return q.withColumn("clues", F.transform(ranges.expand(F.col("objective_facts")), clue))


_REWRITE = r"""
q AS (SELECT DISTINCT question_id, answer, objective_facts, top_k_documents FROM proposed_questions WHERE answer IS NOT NULL AND len(top_k_documents) > 0),
ft AS (SELECT question_id, unnest(regexp_extract_all(objective_facts, '\d+(?:\s*-\s*\d+)?')) AS tok FROM q),
fb AS (SELECT question_id, regexp_extract(tok, '^(\d+)', 1)::BIGINT AS x, coalesce(nullif(regexp_extract(tok, '-\s*(\d+)$', 1), '')::BIGINT, regexp_extract(tok, '^(\d+)', 1)::BIGINT) AS y FROM ft),
cl AS (SELECT DISTINCT f.question_id, f.clue, q.top_k_documents[f.clue % len(q.top_k_documents) + 1] AS doc FROM (SELECT question_id, unnest(generate_series(least(x, y), greatest(x, y))) AS clue FROM fb) f JOIN q USING (question_id)),
mk AS (SELECT question_id, i, m[i] AS marker FROM (SELECT question_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT question_id, regexp_extract_all(answer, '\[Clue\s+[^\]]+\]') AS m FROM q))),
mt AS (SELECT question_id, i, unnest(regexp_extract_all(marker, '\d+(?:\s*-\s*\d+)?')) AS tok FROM mk),
mb AS (SELECT question_id, i, regexp_extract(tok, '^(\d+)', 1)::BIGINT AS x, coalesce(nullif(regexp_extract(tok, '-\s*(\d+)$', 1), '')::BIGINT, regexp_extract(tok, '^(\d+)', 1)::BIGINT) AS y FROM mt),
me AS (SELECT DISTINCT question_id, i, unnest(generate_series(x, y)) AS clue FROM mb WHERE x <= y),
ms AS (SELECT DISTINCT question_id, i, doc, unnest([clue, clue + 1]) AS sen FROM me JOIN cl USING (question_id, clue)),
mg AS (SELECT *, sen - row_number() OVER (PARTITION BY question_id, i, doc ORDER BY sen) AS island FROM ms),
mr AS (SELECT question_id, i, doc, min(sen) AS a, max(sen) AS z FROM mg GROUP BY question_id, i, doc, island),
md AS (SELECT question_id, i, doc, string_agg(CASE WHEN z - a >= 2 THEN a || '-' || z ELSE array_to_string(generate_series(a, z), ', ') END, ', ' ORDER BY a) AS sens FROM mr GROUP BY question_id, i, doc),
mm AS (SELECT question_id, i, string_agg('[Doc ' || doc || ', Sen ' || sens || ']', '' ORDER BY doc) AS cite FROM md GROUP BY question_id, i),
al AS (SELECT mk.question_id, mk.i, coalesce(cite, marker) AS cite FROM mk LEFT JOIN mm USING (question_id, i)),
pt AS (SELECT question_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT question_id, string_split_regex(answer, '\[Clue\s+[^\]]+\]') AS p FROM q)),
out AS (SELECT pt.question_id, string_agg(p[pt.i] || coalesce(cite, ''), '' ORDER BY pt.i) AS answer FROM pt LEFT JOIN al ON al.question_id = pt.question_id AND al.i = pt.i GROUP BY pt.question_id)"""


@query(f"WITH {_REWRITE} SELECT question_id, answer FROM out")
def citation_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir).select("question_id", cite.rewrite_clues(F.col("answer"), F.col("clues")).alias("answer"))


@query(f"WITH {_REWRITE} SELECT question_id, doc, sen FROM (SELECT DISTINCT question_id, doc, sen FROM ms)")
def citation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations read back from the rewritten answers."""
    d = _cited(spark, sf_dir).select("question_id", F.explode(cite.citations(cite.rewrite_clues(F.col("answer"), F.col("clues")))).alias("c"))
    return d.select("question_id", F.col("c.doc").alias("doc"), F.explode("c.sens").alias("sen")).distinct()


@query()
def citation_prf_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against gold citations whose document ids lost their last character."""
    d = _cited(spark, sf_dir)
    gen = cite.citations(cite.rewrite_clues(F.col("answer"), F.col("clues")))
    gold = F.transform("clues", lambda c: F.struct(F.substr(c["doc"], F.lit(1), F.length(c["doc"]) - 1).alias("doc"), c["sens"].alias("sens")))
    return evaluation.fuzzy_citation_counts(d.select("question_id", gen.alias("generated"), gold.alias("gold")), "question_id", "generated", "gold")


# ---------------------------------------------------------------- distributions

_H = """
h AS (SELECT user_id, list(n ORDER BY event_type) AS p FROM (SELECT u.user_id, t.event_type, count(e.event_id)::DOUBLE + 1 AS n
  FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY ALL) GROUP BY user_id),
g AS (SELECT list(n ORDER BY event_type) AS q FROM (SELECT event_type, count(*)::DOUBLE AS n FROM events GROUP BY event_type)),
z AS (SELECT user_id, p, q, list_transform(p, lambda x: x / list_sum(p)) AS pn, list_transform(q, lambda x: x / list_sum(q)) AS qn FROM h, g)"""


def _histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, p, q): event counts plus one by type of each user, and of all, in the order of the types."""
    e = table(spark, sf_dir, "events")
    n = e.groupBy("user_id", "event_type").count()
    own = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("own"))  # as many as types
    all_ = n.groupBy("event_type").agg(F.sum("count").alias("n")).agg(F.array_sort(F.collect_list(F.struct("event_type", F.col("n").cast("double").alias("n")))).alias("all"))
    d = own.crossJoin(all_)  # one row
    return d.select("user_id", F.transform("all", lambda t: F.coalesce(F.try_element_at("own", t["event_type"]), F.lit(0)) + F.lit(1.0)).alias("p"), F.transform("all", lambda t: t["n"]).alias("q"))


@query(
    f"""WITH {_H}, m AS (SELECT *, list_transform(list_zip(pn, qn), lambda x: (x[1] + x[2]) / 2) AS mn FROM z)
SELECT user_id, round(list_sum(list_transform(list_zip(pn, qn), lambda x: x[1] * ln(x[1] / x[2]))), 6) AS kl,
round((list_sum(list_transform(list_zip(pn, mn), lambda x: x[1] * ln(x[1] / x[2]))) + list_sum(list_transform(list_zip(qn, mn), lambda x: x[1] * ln(x[1] / x[2])))) / 2, 6) AS js,
round(sqrt((list_sum(list_transform(list_zip(pn, mn), lambda x: x[1] * ln(x[1] / x[2]))) + list_sum(list_transform(list_zip(qn, mn), lambda x: x[1] * ln(x[1] / x[2])))) / 2), 5) AS js_distance,
round(list_sum(list_transform(list_zip(pn, qn), lambda x: (x[1] + 1e-10) * ln((x[1] + 1e-10) / (x[2] + 1e-10)) - x[1] + x[2])), 6) AS kl_elementwise FROM m"""
)
def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    pn, qn = distributions.scaled(p, distributions.total(p)), distributions.scaled(q, distributions.total(q))
    h = _histograms(spark, sf_dir)
    return h.select(
        "user_id",
        F.round(distributions.kl(p, q), 6).alias("kl"),
        F.round(distributions.jensen_shannon(p, q), 6).alias("js"),
        F.round(distributions.jensen_shannon_distance(p, q), 5).alias("js_distance"),
        F.round(distributions.kl_elementwise(pn, qn), 6).alias("kl_elementwise"),
    )


@query(f"WITH {_H}, x AS (SELECT user_id, list_transform(pn, lambda v: exp(v * 2.0)) AS e FROM z) SELECT user_id, round(list_max(e) / list_sum(e), 6) AS largest FROM x")
def softmax_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    return _histograms(spark, sf_dir).select("user_id", F.round(F.array_max(distributions.softmax(distributions.scaled(p, distributions.total(p)), 2.0)), 6).alias("largest"))


@query("SELECT event_type, round(exp(avg(value / 1000)), 6) AS perplexity FROM events WHERE value IS NOT NULL GROUP BY event_type")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.groupBy("event_type").agg(F.round(distributions.perplexity(F.avg(F.col("value") / 1000)), 6).alias("perplexity"))


@query(
    """WITH c AS (SELECT DISTINCT id FROM corpus), k AS (SELECT id, list_transform(range(1, length(id) + 1), lambda i: substr(id, i, 1)) AS a FROM c),
p AS (SELECT id, lead(id) OVER (ORDER BY id) AS other FROM c)
SELECT id, other, (list_sum(list_transform(range(1, least(length(id), length(other)) + 1), lambda i: CASE WHEN substr(id, i, 1) <> substr(other, i, 1) THEN 1 ELSE 0 END)) + abs(length(id) - length(other)))::BIGINT AS apart FROM p WHERE other IS NOT NULL"""
)
def positional_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between ids that follow each other; neighbours are found by their running number, not by one window."""
    from lorewright.operators.graph import running_ids

    c = running_ids(table(spark, sf_dir, "corpus").select("id").distinct(), ["id"], "n")
    p = c.join(c.select((F.col("n") - 1).alias("n"), F.col("id").alias("other")), "n")
    return p.select("id", "other", distributions.positional_difference(F.col("id"), F.col("other")).cast("bigint").alias("apart"))
