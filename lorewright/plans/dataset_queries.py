"""Queries that parse model output and build training and review rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.functions import parse, providers, text
from lorewright.operators import annotate, builders, evaluation, html, tiers
from lorewright.plans.registry import query, table

_BL = " ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '"


def _trim(c: str) -> str:
    return f"trim({c}, '{_BL}')"


def _proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "proposed_questions").select("question_id", "question_key", "flavour", "chunk_key", "source", "question", "objective_facts", "reasoning", "answer", "top_k_documents", "all_in_top_3", "all_in_top_5").distinct()


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rephrased_questions").select("variant_id", "question_id", "variant_kind", "step", "source", "transformation", "explanation", "result", "answer", "reordered_question", "reordered_same_meaning_with_origin", "scoring_criteria").distinct()


_P = "p AS (SELECT DISTINCT question_id, question_key, flavour, chunk_key, source, question, objective_facts, reasoning, answer, top_k_documents, all_in_top_3, all_in_top_5 FROM proposed_questions)"
_R = "v AS (SELECT DISTINCT variant_id, question_id, variant_kind, step, source, transformation, explanation, result, answer, reordered_question, reordered_same_meaning_with_origin, scoring_criteria FROM rephrased_questions)"


# ---------------------------------------------------------------- model output, written in its grammar and read back


@query(
    f"""WITH {_P} SELECT question_id, {_trim("question_key")} AS category, {_trim("question")} AS question, {_trim("objective_facts")} AS clues, {_trim("coalesce(reasoning, '')")} AS reasoning, {_trim("coalesce(answer, '')")} AS answer
FROM p WHERE question IS NOT NULL"""
)
def parse_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), F.coalesce(c, F.lit("")), F.lit(f"</{name}>\n"))
    out = F.concat(
        F.lit("Execution:\n1. <"), F.col("question_key"), F.lit(">\n"), tag("question", F.col("question")), tag("objective-facts", F.col("objective_facts")), tag("reasoning", F.col("reasoning")), tag("answer", F.col("answer")),
        F.lit("2. <empty-questions>\nnothing here\n"),
    )
    d = _proposed(spark, sf_dir).where("question is not null").select("question_id", F.inline(parse.questions(out)))
    return d.select("question_id", "category", "question", "clues", "reasoning", "answer")


@query(f"""WITH {_R} SELECT variant_id, {_trim("coalesce(transformation, '')")} AS transformation, {_trim("coalesce(explanation, '')")} AS explanation, {_trim("coalesce(result, '')")} AS result, {_trim("coalesce(answer, '')")} AS answer FROM v""")
def parse_transformations(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (("transformed-action", "transformation"), ("transformed-explanation", "explanation"), ("transformed-question", "result"), ("transformed-answer", "answer"))
    out = F.concat(F.lit("Steps\n1. "), *[F.concat(F.lit(f"<{t}>"), F.coalesce(c, F.lit("")), F.lit(f"</{t}>\n")) for t, c in names])
    return _variants(spark, sf_dir).select("variant_id", F.inline(parse.transformations(out)))


@query(f"""WITH {_R} SELECT variant_id, step, {_trim("reordered_question")} AS reordered_question, reordered_same_meaning_with_origin AS same_meaning FROM v WHERE reordered_question IS NOT NULL AND reordered_same_meaning_with_origin IS NOT NULL""")
def parse_reorderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("step").cast("string")
    flag = F.when(F.col("reordered_same_meaning_with_origin"), "True").otherwise("False")
    out = F.concat(F.lit("<question-"), n, F.lit("> <transformed-question>"), F.col("reordered_question"), F.lit("</transformed-question>\n<same-meaning-with-origin>"), flag, F.lit("</same-meaning-with-origin>\n</question-"), n, F.lit(">"))
    return _variants(spark, sf_dir).where("reordered_question is not null and reordered_same_meaning_with_origin is not null").select("variant_id", F.inline(parse.reorderings(out)))


@query(f"""WITH {_P} SELECT question_id, {_trim("answer")} AS short_answer, {_trim("coalesce(reasoning, '')")} AS short_reason, NULL::VARCHAR AS long_answer FROM p WHERE answer IS NOT NULL""")
def parse_final_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.concat(F.lit("<answer-short>\n<reason>"), F.coalesce("reasoning", F.lit("")), F.lit("</reason>\n<answer>"), F.col("answer"), F.lit("</answer></answer-short>"))
    d = _proposed(spark, sf_dir).where("answer is not null").select("question_id", parse.final_answers(out).alias("x"))
    return d.select("question_id", F.col("x.short.answer").alias("short_answer"), F.col("x.short.reason").alias("short_reason"), F.col("x.long.answer").alias("long_answer"))


@query(
    f"""WITH {_P}, a AS (SELECT question_id, nullif({_trim("answer")}, '') AS a, nullif({_trim("reasoning")}, '') AS r FROM p)
SELECT question_id, coalesce(a, r, 'neither') AS answer, CASE WHEN a IS NOT NULL THEN r END AS reason FROM a"""
)
def parse_answer_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.concat_ws("\n", F.concat(F.lit("<answer>"), F.col("answer"), F.lit("</answer>")), F.concat(F.lit("<reason>"), F.col("reasoning"), F.lit("</reason>")))
    blank = (F.coalesce(text.trimmed(F.col("answer")), F.lit("")) == "") & (F.coalesce(text.trimmed(F.col("reasoning")), F.lit("")) == "")
    return _proposed(spark, sf_dir).select("question_id", parse.answer_reason(F.when(blank, F.lit("neither")).otherwise(tags)).alias("x")).select("question_id", "x.answer", "x.reason")


@query(f"""WITH {_P} SELECT question_id, CASE WHEN question_id % 3 > 0 THEN 'about ' || source END AS reasoning, CASE WHEN question_id % 3 > 0 THEN (question_id % 5)::INT END AS score FROM p""")
def parse_reasoning_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third output has no integer score."""
    score = F.when(F.col("question_id") % 3 > 0, (F.col("question_id") % 5).cast("string")).otherwise("high")
    out = F.concat(F.lit("reasoning: about "), F.col("source"), F.lit("\nSCORE : "), score)
    return _proposed(spark, sf_dir).select("question_id", parse.reasoning_score(out).alias("x")).select("question_id", "x.reasoning", "x.score")


@query("""WITH p AS (SELECT DISTINCT question_id, list_slice(top_k_documents, 1, 5) AS t, chunk_key FROM proposed_questions WHERE top_k_documents IS NOT NULL), g AS (SELECT DISTINCT chunk_key, id FROM corpus)
SELECT question_id, len(t) AS judged, len(list_filter(t, lambda x: x = id)) AS total FROM p JOIN g USING (chunk_key)""")
def parse_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "corpus").select("chunk_key", "id").distinct()
    d = _proposed(spark, sf_dir).where("top_k_documents is not null").select("question_id", "chunk_key", F.slice("top_k_documents", 1, 5).alias("t")).join(g, "chunk_key")
    out = F.array_join(F.transform("t", lambda x: F.concat(F.lit("<reason>"), x, F.lit("</reason><judge>"), F.when(x == F.col("id"), "It is TRUE").otherwise("no"), F.lit("</judge>"))), "\n")
    return d.select("question_id", parse.judgements(out).alias("x")).select("question_id", F.size("x.items").alias("judged"), F.col("x.total").alias("total"))


@query(
    r"""WITH e AS (SELECT DISTINCT entity_id, entity_name, coalesce(entity_description, '') AS d FROM entities WHERE entity_name IS NOT NULL)
SELECT entity_id, entity_name, d AS entity_description FROM e"""
)
def parse_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").where("entity_name is not null").select("entity_id", "entity_name", F.coalesce("entity_description", F.lit("")).alias("d")).distinct()
    out = F.concat(F.lit('("entity"<tuple_delimiter>'), F.col("entity_name"), F.lit("<tuple_delimiter>"), F.col("d"), F.lit(")<record_delimiter>\n<completion_delimiter>"))
    return e.select("entity_id", F.inline(parse.entities(out)), parse.is_complete(out).alias("ok")).where("ok").drop("ok")


@query(
    r"""WITH m AS (SELECT DISTINCT e.match_id, a.entity_name AS s, b.entity_name AS t, e.judge FROM entity_matches e JOIN entities a ON a.entity_id = left_entity_id JOIN entities b ON b.entity_id = right_entity_id
  WHERE a.entity_name IS NOT NULL AND b.entity_name IS NOT NULL)
SELECT match_id, trim(s) AS source_entity_name, trim(t) AS target_entity_name, judge AS relationship_description, '1-3,' || (match_id % 7) AS sentences_used FROM m"""
)
def parse_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").where("entity_name is not null")
    m = table(spark, sf_dir, "entity_matches").select("match_id", "left_entity_id", "right_entity_id", "judge")
    m = m.join(e.select(F.col("entity_id").alias("left_entity_id"), F.col("entity_name").alias("s")), "left_entity_id").join(e.select(F.col("entity_id").alias("right_entity_id"), F.col("entity_name").alias("t")), "right_entity_id")
    d = F.lit("<tuple_delimiter>")
    out = F.concat(F.lit('("relationship"'), d, F.col("s"), d, F.col("t"), d, F.col("judge"), d, F.lit("[Sen 1-3, Sen "), (F.col("match_id") % 7).cast("string"), F.lit("])"))
    return m.select("match_id", "s", "t", "judge").distinct().select("match_id", F.inline(parse.relationships(out)))


@query(
    r"""WITH c AS (SELECT DISTINCT chunk_key, context FROM corpus WHERE context IS NOT NULL), n AS (SELECT chunk_key, len(regexp_extract_all(context, '\[Sen \d+\]')) AS n FROM c)
SELECT chunk_key, 'a fact of ' || chunk_key AS fact, CASE WHEN n = 4 THEN '1-4' WHEN n > 4 THEN '1-3,' || n WHEN n = 0 THEN '0-3' ELSE '1-3' END AS sens FROM n"""
)
def parse_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "corpus").where("context is not null").select("chunk_key", "context").distinct()
    n = F.size(annotate.marker_ids(F.col("context")))
    out = F.concat(F.lit("<detailed-desc> a fact of "), F.col("chunk_key").cast("string"), F.lit("</detailed-desc>\n<sentences-used>[Sen 3, Sen 1, Sen 2, Sen "), n.cast("string"), F.lit("]</sentences-used>"))
    return c.select("chunk_key", F.inline(parse.facts(out)))


@query(
    """WITH p AS (SELECT DISTINCT question_id, answer FROM proposed_questions WHERE answer IS NOT NULL)
SELECT question_id, CASE question_id % 4 WHEN 0 THEN answer WHEN 1 THEN answer || '<think>open' WHEN 2 THEN answer || '!' ELSE '</think>' || answer END AS text FROM p"""
)
def strip_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of thought before the answer, one that never closes, two around it, and one inside another."""
    a = F.col("answer")
    said = [
        F.concat(F.lit("<think>step\none < two</think>"), a),
        F.concat(a, F.lit("<think>open")),
        F.concat(F.lit("<think></think>"), a, F.lit("<think>b\n\n</think>!")),
        F.concat(F.lit("<think>a <think>b</think></think>"), a),
    ]
    q = _proposed(spark, sf_dir).where("answer is not null").select("question_id", "answer")
    return q.select("question_id", text.strip_think(F.element_at(F.array(*said), (F.col("question_id") % 4 + 1).cast("int"))).alias("text")).distinct()


@query(
    """WITH p AS (SELECT DISTINCT pair_id, top_k_value AS k FROM preference_pairs), x AS (SELECT *, pair_id % 5 AS kind FROM p)
SELECT pair_id, CASE kind WHEN 0 THEN '{"a": 1}' WHEN 2 THEN '{"a": {"b": ' || pair_id || '}}' WHEN 3 THEN '{"k": ' || k || '}' WHEN 4 THEN '{not json}' END AS first_block,
  CASE kind WHEN 0 THEN '{"pair": ' || pair_id || ', "k": [' || k || ', 2]}' WHEN 2 THEN '{"a": {"b": ' || pair_id || '}}' WHEN 3 THEN '[1, {"k": ' || k || '}]' WHEN 4 THEN '[' || pair_id || ']' END AS largest FROM x"""
)
def json_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON among text: several blocks, none that closes, nested ones, a bracket inside a string, and what isn't JSON."""
    said = [
        F.format_string('text {"a": 1} more {"pair": %d, "k": [%d, 2]} {broken', "pair_id", "top_k_value"),
        F.format_string("no block {closes %d [here %d", "pair_id", "top_k_value"),
        F.format_string('```json\n{"a": {"b": %d}} tail } ]', "pair_id"),
        F.format_string('[1, {"k": %d}] and {"x": "}"}', "top_k_value"),
        F.format_string("{not json} then [%d]", "pair_id"),
    ]
    p = table(spark, sf_dir, "preference_pairs").select("pair_id", "top_k_value").distinct()
    out = F.element_at(F.array(*said), (F.col("pair_id") % 5 + 1).cast("int"))
    return p.select("pair_id", parse.first_json_block(out).alias("first_block"), parse.largest_json(out).alias("largest"))


# ---------------------------------------------------------------- preference and chat rows


@query(f"""WITH {_P} SELECT question_id, 'Q: ' || question || chr(10) || 'Facts: ' || coalesce(objective_facts, '') AS prompt FROM p WHERE question IS NOT NULL""")
def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lit("Q: [[QUESTION]]\nFacts: [[FACTS]]")
    return _proposed(spark, sf_dir).where("question is not null").select("question_id", text.fill(t, QUESTION=F.col("question"), FACTS=F.coalesce("objective_facts", F.lit(""))).alias("prompt"))


_TOP = f"""{_P}, c AS (SELECT id, min(context) AS context FROM corpus GROUP BY id),
t AS (SELECT question_id, question, r, top_k_documents[r] AS id FROM (SELECT *, unnest(range(1, least(len(top_k_documents), 3) + 1)) AS r FROM p WHERE question IS NOT NULL AND top_k_documents IS NOT NULL)),
d AS (SELECT question_id, question, string_agg('[Doc ' || id || '] ' || context, chr(10) ORDER BY r) AS docs, count(*) FILTER (context IS NULL) AS missing FROM t LEFT JOIN c USING (id) GROUP BY question_id, question),
pr AS (SELECT question_id, 'Documents:' || chr(10) || docs || chr(10) || 'Question: ' || question AS prompt FROM d WHERE missing = 0)"""
_TEMPLATE = "Documents:\n[[CLUES]]\nQuestion: [[QUESTION]]"


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "corpus").groupBy("id").agg(F.min("context").alias("context"))
    q = _proposed(spark, sf_dir).where("question is not null and top_k_documents is not null")
    return builders.prompts(q, c, _TEMPLATE, 3, "question_id", "question", "top_k_documents")


@query(f"WITH {_TOP} SELECT question_id, md5(prompt) AS digest, length(prompt) AS n FROM pr")
def generation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("question_id", F.md5("prompt").alias("digest"), F.length("prompt").alias("n"))


_PHRASES = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in builders.REJECTIONS) + "]"
_PICK = f"({_PHRASES})[(ascii(md5(record_id::VARCHAR)) * 7 + ascii(substr(md5(record_id::VARCHAR), 2, 1))) % {len(builders.REJECTIONS)} + 1]"


@query(
    f"""WITH {_TOP}, {_R}, gen AS (SELECT question_id, min(rejected) AS generated FROM preference_pairs GROUP BY question_id),
s AS (SELECT question_id AS record_id, flavour, NULL::VARCHAR AS variant, prompt, answer AS standard, generated, all_in_top_3 AS found FROM p JOIN pr USING (question_id) JOIN gen USING (question_id)
  UNION ALL SELECT variant_id, flavour, variant_kind, prompt, v.answer, generated, all_in_top_3 FROM v JOIN p USING (question_id) JOIN pr USING (question_id) JOIN gen USING (question_id)),
o AS (SELECT * FROM s WHERE generated <> '' AND found IS NOT NULL)
SELECT record_id, md5(prompt) AS prompt, standard AS chosen, generated AS rejected, coalesce(variant, 'original') || '-retrieval_true-positive_are_standard-negative_are_generated' AS data_gen_type, 3 AS top_k_value FROM o WHERE found AND standard <> ''
UNION ALL SELECT record_id, md5(prompt), {_PICK}, generated, coalesce(variant, 'original') || '-retrieval_false-positive_are_reject-negative_are_generated', 3 FROM o WHERE NOT found AND (variant IS NULL OR flavour = 'entity_graph')"""
)
def preference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gen = table(spark, sf_dir, "preference_pairs").groupBy("question_id").agg(F.min("rejected").alias("generated"))
    q = _proposed(spark, sf_dir).join(_prompts(spark, sf_dir), "question_id").join(gen, "question_id")
    own = q.select(F.col("question_id").alias("record_id"), "flavour", F.lit(None).cast("string").alias("variant"), "prompt", F.col("answer").alias("standard"), "generated", F.col("all_in_top_3").alias("found"))
    v = _variants(spark, sf_dir).select("variant_id", "question_id", "variant_kind", F.col("answer").alias("standard"))
    re = v.join(q.drop("answer"), "question_id").select(F.col("variant_id").alias("record_id"), "flavour", F.col("variant_kind").alias("variant"), "prompt", "standard", "generated", F.col("all_in_top_3").alias("found"))
    return builders.preference_rows(own.unionByName(re), 3).withColumn("prompt", F.md5("prompt"))


_PP = "pp AS (SELECT DISTINCT pair_id, source, prompt, chosen, rejected FROM preference_pairs)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "preference_pairs").select("pair_id", "source", "prompt", "chosen", "rejected").distinct()


@query(f"WITH {_PP} SELECT pair_id FROM pp WHERE length(prompt) + length(chosen) <= 800 AND length(prompt) + length(rejected) <= 800")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.length_filter(_pairs(spark, sf_dir), 800).select("pair_id")


@query(f"WITH {_PP} SELECT pair_id, 0 AS turn, 'user' AS role, prompt AS content FROM pp UNION ALL SELECT pair_id, 1, 'assistant', chosen FROM pp")
def sft_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = builders.chat_messages(_pairs(spark, sf_dir)).select("pair_id", F.posexplode("messages").alias("turn", "m"))
    return m.select("pair_id", "turn", "m.role", "m.content")


@query(f"WITH {_R}, l AS (SELECT question_id, variant_kind, max((step, variant_id)) AS x FROM v GROUP BY question_id, variant_kind) SELECT v.variant_id, v.question_id, v.variant_kind, v.step FROM v JOIN l ON v.question_id = l.question_id AND v.variant_kind = l.variant_kind AND (v.step, v.variant_id) = l.x")
def last_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.last_variants(_variants(spark, sf_dir)).select("variant_id", "question_id", "variant_kind", "step")


@query(
    f"""WITH {_R}, q AS (SELECT question_id, min(question) AS question FROM proposed_questions GROUP BY question_id)
SELECT variant_id, coalesce(lag(result) OVER w, CASE WHEN row_number() OVER w = 1 THEN question END) AS previous_result FROM v JOIN q USING (question_id) WINDOW w AS (PARTITION BY question_id, variant_kind ORDER BY step, variant_id)"""
)
def previous_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "proposed_questions").groupBy("question_id").agg(F.min("question").alias("question"))
    return builders.previous_text(_variants(spark, sf_dir), q).select("variant_id", "previous_result")


@query(
    f"""WITH {_R} SELECT variant_id, coalesce(string_agg(scoring_criteria, chr(10) ORDER BY step, variant_id) FILTER (transformation LIKE '%artial%') OVER (PARTITION BY question_id, variant_kind ORDER BY step, variant_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS rules FROM v"""
)
def variant_prefix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("question_id", "variant_kind").orderBy("step", "variant_id").rowsBetween(Window.unboundedPreceding, 0)
    rule = F.when(F.col("transformation").contains("artial"), F.col("scoring_criteria"))
    return _variants(spark, sf_dir).select("variant_id", F.array_join(F.collect_list(rule).over(w), "\n").alias("rules"))


@query(f"WITH {_R} SELECT variant_id, coalesce(reordered_question, result) AS question_text FROM v WHERE step IN (1, 3)")
def variant_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and third step of each rewriting, reordered text where there is one."""
    return _variants(spark, sf_dir).where(F.col("step").isin(1, 3)).select("variant_id", F.coalesce("reordered_question", "result").alias("question_text"))


@query(
    f"""WITH {_P}, {_R}, a AS (SELECT question_id AS record_id, 'original' AS category, 0 AS step, question AS text FROM p UNION ALL
SELECT variant_id, variant_kind, step, CASE WHEN variant_kind = 'full' THEN result ELSE reordered_question END FROM v)
SELECT record_id, category, step, text || '</s>' AS query FROM a WHERE text IS NOT NULL AND {_trim('text')} <> ''"""
)
def retrieval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _proposed(spark, sf_dir).select(F.col("question_id").alias("record_id"), F.lit("original").alias("category"), F.lit(0).alias("step"), F.col("question").alias("text"))
    t = F.when(F.col("variant_kind") == "full", F.col("result")).otherwise(F.col("reordered_question"))
    re = _variants(spark, sf_dir).select(F.col("variant_id").alias("record_id"), F.col("variant_kind").alias("category"), "step", t.alias("text"))
    d = own.unionByName(re).where(F.col("text").isNotNull() & (text.trimmed(F.col("text")) != ""))
    return d.select("record_id", "category", "step", F.concat("text", F.lit("</s>")).alias("query"))


@query(
    """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('3:' || doc_id), doc_id) - 1 AS k FROM documents)
SELECT source, doc_id, k // 16 AS batch_no, k // 64 AS step_no FROM r"""
)
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    return builders.batches(d, "source", tiers.sample_rank("doc_id", 3), "doc_id", 16, 4).select("source", "doc_id", "batch_no", "step_no")


@query(
    f"""WITH {_P}, {_R}, c AS (SELECT chunk_key, min(context) AS context FROM corpus GROUP BY chunk_key), done AS (SELECT DISTINCT variant_id FROM rephrased_questions WHERE scoring_criteria IS NOT NULL)
SELECT variant_id, question AS original_question, coalesce(reordered_question, result) AS rephrased_question, v.answer AS standard_answer, length(context) AS context_chars
FROM v JOIN p USING (question_id) LEFT JOIN c USING (chunk_key) WHERE variant_id NOT IN (SELECT variant_id FROM done)"""
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "corpus").groupBy("chunk_key").agg(F.min("context").alias("context"))
    v = _variants(spark, sf_dir)
    d = builders.review_queue(_proposed(spark, sf_dir), v, c, v.where("scoring_criteria is not null"))
    return d.select("variant_id", "original_question", "rephrased_question", "standard_answer", F.length("context").alias("context_chars"))


@query("WITH pp AS (SELECT DISTINCT pair_id, chosen, rejected FROM preference_pairs) SELECT pair_id, 'a' AS model, 3 AS k, chosen AS answer FROM pp WHERE chosen IS NOT NULL UNION ALL SELECT pair_id, 'b', 5, rejected FROM pp WHERE rejected IS NOT NULL")
def answers_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "preference_pairs").select("pair_id", F.col("chosen").alias("a-top_k_value-3-answer"), F.col("rejected").alias("b-top_k_value-5-answer")).distinct()
    return builders.long_answers(p, ["pair_id"])


@query(
    """WITH c AS (SELECT DISTINCT chunk_key, source FROM corpus), k AS (SELECT chunk_key, list_sort(list(DISTINCT entity_name)) AS names FROM entities WHERE entity_name IS NOT NULL AND chunk_key IS NOT NULL GROUP BY chunk_key),
e AS (SELECT chunk_key, names, unnest(range(1, len(names) + 1)) AS r FROM k)
SELECT chunk_key, r AS removed, coalesce(array_to_string(list_transform(range(1, len(names)), lambda i: i || '. ' || list_concat(names[1:r - 1], names[r + 1:])[i]), chr(10)), '') AS prompt FROM e"""
)
def leave_one_out_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a chunk as clues, each left out once."""
    e = table(spark, sf_dir, "entities").where("entity_name is not null and chunk_key is not null")
    k = e.groupBy("chunk_key").agg(F.array_sort(F.collect_set("entity_name")).alias("names"))  # bounded by the distinct names of a chunk
    return k.select("chunk_key", F.inline(evaluation.leave_one_out(F.col("names"))))


@query(
    f"""WITH {_R}, n AS (SELECT variant_id, variant_kind, len(regexp_extract_all(answer, '\\[Clue')) AS total, len(regexp_extract_all(answer, '[.!?]')) AS sentences FROM v WHERE answer IS NOT NULL)
SELECT variant_kind, count(*) AS variants, round(avg(total / nullif(sentences, 0)::DOUBLE) * 100, 2) AS consistency FROM n GROUP BY variant_kind"""
)
def consistency_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited over all sentence ends as the judged total."""
    v = _variants(spark, sf_dir).where("answer is not null")
    total, n = F.size(F.regexp_extract_all("answer", F.lit(r"\[Clue"), F.lit(0))), F.size(F.regexp_extract_all("answer", F.lit("[.!?]"), F.lit(0)))
    return v.groupBy("variant_kind").agg(F.count("*").alias("variants"), evaluation.percent(evaluation.consistency(total, n)).alias("consistency"))


@query(
    f"""WITH {_R}, s AS (SELECT variant_kind, CASE WHEN lower(answer) LIKE '%sorry%' THEN 1 ELSE 0 END AS said, transformation LIKE '%artial%' AS part FROM v WHERE answer IS NOT NULL)
SELECT coalesce(variant_kind, 'pooled') AS kind, count(*) AS answers, sum(said)::BIGINT AS admits, sum(CASE WHEN part THEN said ELSE 0 END)::BIGINT AS admits_part FROM s GROUP BY GROUPING SETS ((variant_kind), ())"""
)
def unknown_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often answers admit not to know, by kind of variant and pooled, in one grouping."""
    said = F.lower("answer").like("%sorry%").cast("int")
    d = _variants(spark, sf_dir).where("answer is not null").select("variant_kind", said.alias("said"), F.coalesce(F.col("transformation").like("%artial%"), F.lit(False)).alias("part"))
    return d.rollup("variant_kind").agg(F.count("*").alias("answers"), F.sum("said").alias("admits"), F.sum(F.when(F.col("part"), F.col("said")).otherwise(0)).alias("admits_part")).select(F.coalesce("variant_kind", F.lit("pooled")).alias("kind"), "answers", "admits", "admits_part")


# ---------------------------------------------------------------- providers, pages


@query("WITH p AS (SELECT DISTINCT question_id, question FROM proposed_questions WHERE question IS NOT NULL) SELECT question_id, md5('Answer: ' || question) AS answer, (length(question) + 8)::VARCHAR AS reason FROM p")
def provider_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in model asked once per distinct prompt, its output parsed."""
    q = _proposed(spark, sf_dir).where("question is not null").select("question_id", F.concat(F.lit("Answer: "), F.col("question")).alias("prompt")).distinct()
    d = providers.complete(q, "prompt", "output")
    return d.select("question_id", parse.answer_reason(F.col("output")).alias("x")).select("question_id", "x.answer", "x.reason")


@query()
def provider_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").select("entity_name").where("entity_name is not null").distinct()
    return providers.embed(e, "entity_name", "vector").select("entity_name", F.size("vector").alias("dim"), F.round(F.get("vector", 0).cast("double"), 5).alias("first"))


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(translate(x, chr(160) || chr(8203) || chr(65279), '   '), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))), lambda x: x <> '')"


@query(
    f"""WITH l AS (SELECT doc_id, {_LINES} AS p FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, p, doc_id % 4 AS kind FROM l WHERE len(p) > 0)
SELECT doc_id, CASE kind WHEN 0 THEN '# ' || doc_id || chr(10) || chr(10) || array_to_string(p, chr(10) || chr(10))
  WHEN 1 THEN array_to_string(list_transform(p, lambda x: '- ' || x), chr(10))
  WHEN 2 THEN '| ' || array_to_string(p, ' |' || chr(10) || '| ') || ' |'
  ELSE '**' || array_to_string(p, '**' || chr(10) || '**') || '**' END AS text FROM k"""
)
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text, escaped, as a page of one of four kinds of sites: paragraphs, a list, a table, or bold
    lines in unclosed tags; navigation and scripts around the main part must go, the text must come back."""
    plain = F.translate("text", "\xa0\u200b\ufeff", "   ")
    lines = F.filter(F.transform(F.split(plain, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"[\s\x0b\x1c-\x1f\x85\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))), lambda x: x != "")
    safe = F.transform(lines, lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))
    wrap = lambda a, z: F.concat(F.lit(a), F.array_join(safe, z + a), F.lit(z))
    main = [
        F.concat(F.lit('<main class="page__main wide"><h1>'), F.col("doc_id").cast("string"), F.lit("</h1>"), wrap("<p>", "</p>"), F.lit("<script>var x = \"<p>\";</script></main>")),
        F.concat(F.lit('<div id="content" class="x ddc-main-content"><ul>'), wrap("<li>", "</li>"), F.lit("</ul></div>")),
        F.concat(F.lit('<article id="main-content"><table>'), wrap("<tr><td>", "</td></tr>"), F.lit("</table></article>")),
        F.concat(F.lit('<div class="card card-lg">'), wrap("<b>", "</b><br>"), F.lit("</div>")),
    ]
    site = F.element_at(F.array(*[F.lit(x) for x in ("wiki", "drugs", "clinic", "webcopy")]), (F.col("doc_id") % 4 + 1).cast("int"))
    body = F.element_at(F.array(*main), (F.col("doc_id") % 4 + 1).cast("int"))
    page = F.concat(F.lit('<html><head><title>x</title></head><body><nav><a href="/">Home</a><ul><li>one<li>two</ul></nav>'), body, F.lit("<footer>end</body></html>"))
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & (F.size(lines) > 0)).select("doc_id", page.alias("html"), site.alias("site"))
    return html.pages_to_markdown(d, "doc_id", "html", "site")


@query(
    f"""WITH {_R}, {_P}, l AS (SELECT question_id, variant_kind, max((step, variant_id)) AS x FROM v GROUP BY question_id, variant_kind),
a AS (SELECT p.source, v.result AS query, p.chunk_key, v.variant_id FROM v JOIN l ON v.question_id = l.question_id AND v.variant_kind = l.variant_kind AND (v.step, v.variant_id) = l.x JOIN p ON p.question_id = v.question_id
  WHERE v.result IS NOT NULL AND p.chunk_key IS NOT NULL)
SELECT source, query, arg_max(chunk_key, variant_id) AS chunk_key FROM a GROUP BY source, query"""
)
def query_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last variants as queries with their positive chunk; of equal queries of a source the last one counts."""
    last = builders.last_variants(_variants(spark, sf_dir)).select("variant_id", "question_id", F.col("result").alias("query"))
    p = _proposed(spark, sf_dir).select("question_id", "source", "chunk_key")
    d = last.join(p, "question_id").where("query is not null and chunk_key is not null")
    return d.groupBy("source", "query").agg(F.max_by("chunk_key", "variant_id").alias("chunk_key"))


@query(f"WITH {_R} SELECT source, variant_kind, count(*) AS examples FROM v GROUP BY source, variant_kind")
def example_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).groupBy("source", "variant_kind").agg(F.count("*").alias("examples"))


@query(
    f"""WITH {_R} SELECT question_id, string_agg(CASE WHEN variant_kind = 'part' THEN 'Partial: ' ELSE 'Equivalent: ' END || coalesce(transformation, ''), '; ' ORDER BY (variant_kind = 'part'), step, variant_id) AS steps
FROM v WHERE variant_kind IN ('full', 'part') GROUP BY question_id"""
)
def variant_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equivalent steps followed by partial ones, relabelled."""
    part = F.col("variant_kind") == "part"
    label = F.concat(F.when(part, "Partial: ").otherwise("Equivalent: "), F.coalesce("transformation", F.lit("")))
    v = _variants(spark, sf_dir).where(F.col("variant_kind").isin("full", "part"))
    g = v.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(part.alias("p"), "step", "variant_id", label.alias("l")))).alias("x"))  # bounded by the steps of a question
    return g.select("question_id", F.array_join(F.transform("x", lambda s: s["l"]), "; ").alias("steps"))


@query("WITH r AS (SELECT source, doc_id, epoch, row_number() OVER (PARTITION BY epoch, source ORDER BY md5((42 + epoch) || ':' || doc_id), doc_id) AS place FROM documents, (SELECT unnest([0, 1]) AS epoch)) SELECT * FROM r WHERE place <= 20")
def epoch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 documents of each source in the order of each epoch."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    out = None
    for epoch in (0, 1):
        w = Window.partitionBy("source").orderBy(tiers.sample_rank("doc_id", 42 + epoch), "doc_id")
        e = d.withColumn("epoch", F.lit(epoch)).withColumn("place", F.row_number().over(w)).where("place <= 20")
        out = e if out is None else out.unionByName(e)
    return out


@query(r"WITH t AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '\[([^\]\n]*)\]\(([^)\n]*)\)', 2)) AS target FROM documents WHERE text IS NOT NULL), f AS (SELECT DISTINCT source, '/' || regexp_replace(rel_path, '\.md$', '') AS page FROM documents) SELECT doc_id, target, page IS NOT NULL AS known FROM t LEFT JOIN f ON f.source = t.source AND f.page = regexp_replace(target, '\.(md|html|htm)$', '')")
def link_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a link's target is a document of its site, converted suffixes aside."""
    d = table(spark, sf_dir, "documents")
    t = d.select("doc_id", "source", F.explode(text.link_targets(F.col("text"))).alias("target")).withColumn("page", F.regexp_replace("target", r"\.(md|html|htm)$", ""))
    f = d.select("source", F.concat(F.lit("/"), F.regexp_replace("rel_path", r"\.md$", "")).alias("page")).distinct().withColumn("hit", F.lit(True))
    return t.join(f, ["source", "page"], "left").select("doc_id", "target", F.col("hit").isNotNull().alias("known"))


@query(
    """WITH s AS (SELECT question_id, avg(score) FILTER (is_same) AS pos, avg(score) FILTER (NOT is_same) AS neg FROM (SELECT DISTINCT left_entity_id AS question_id, match_id, is_same, score FROM entity_matches WHERE score IS NOT NULL AND left_entity_id IS NOT NULL) GROUP BY question_id)
SELECT question_id AS entity_id, round(greatest(0, 0.5 - (pos - neg)), 6) AS loss FROM s WHERE pos IS NOT NULL AND neg IS NOT NULL"""
)
def margin_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of an entity's confirmed matches against that of its refused ones."""
    from lorewright.operators.retrieval import margin_loss

    m = table(spark, sf_dir, "entity_matches").where("score is not null and left_entity_id is not null").select(F.col("left_entity_id").alias("entity_id"), "match_id", "is_same", "score").distinct()
    s = m.groupBy("entity_id").agg(F.avg(F.when(F.col("is_same"), F.col("score"))).alias("pos"), F.avg(F.when(~F.col("is_same"), F.col("score"))).alias("neg")).where("pos is not null and neg is not null")
    return s.select("entity_id", F.round(margin_loss(F.col("pos"), F.col("neg"), 0.5), 6).alias("loss"))
