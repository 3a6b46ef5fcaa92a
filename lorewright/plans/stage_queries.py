"""Queries of the model stages and of what feeds and joins them, with the stand-in model."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.functions import parse, providers, text
from lorewright.operators import builders
from lorewright.plans import stages
from lorewright.plans.registry import query, table
from lorewright.sources import files


def _sql(template: str, **values: str) -> str:
    """The SQL of a prompt."""
    e = "'" + template.replace("'", "''") + "'"
    for k, v in values.items():
        e = f"replace({e}, '[[{k.upper()}]]', {v})"
    return e


def _stub(template: str):
    return functools.partial(providers.Stub, template)


@query(f"WITH d AS (SELECT doc_id, {_sql(stages.STAGES['clean'].template, chunk='text')} AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, '# ' || md5(p) || ' ' || length(p) AS cleaned FROM d")
def stage_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    out = stages.run("clean", d, "doc_id", make=_stub("<think>so\nso</think>\n# {digest} {length}\n\n"), chunk=F.col("text"))
    return out.select("doc_id", F.col("parsed").alias("cleaned"))


@query(
    f"""WITH d AS (SELECT doc_id, {_sql(stages.STAGES['summarize'].template, page='text')} AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(p) AS summary, 1 AS questions, length(p)::VARCHAR AS answer, true AS valid_document FROM d"""
)
def stage_summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries read from JSON that stands among other braces."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    out = stages.run("summarize", d, "doc_id", make=_stub('Sure {{ here: {{"summary": "{digest}", "faq": [{{"question": "q", "answer": "{length}"}}], "valid_document": true}} }}'), page=F.col("text"))
    return out.select("doc_id", "parsed.summary", F.size("parsed.faq").alias("questions"), F.get("parsed.faq", F.lit(0))["answer"].alias("answer"), "parsed.valid_document")


@query(
    """WITH v AS (SELECT DISTINCT variant_id, question_id, variant_kind, transformation FROM rephrased_questions), q AS (SELECT question_id, min(flavour) AS flavour FROM proposed_questions GROUP BY question_id)
SELECT variant_id FROM v JOIN q USING (question_id) WHERE variant_kind = 'part' OR (variant_kind = 'hybrid' AND (flavour = 'entity_graph' OR lower(transformation) LIKE '%partial%'))"""
)
def criteria_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "rephrased_questions").select("variant_id", "question_id", "variant_kind", "transformation").distinct()
    q = table(spark, sf_dir, "proposed_questions").groupBy("question_id").agg(F.min("flavour").alias("flavour"))
    return stages.criteria_input(v.join(q, "question_id")).select("variant_id")


_J = {n: stages.STAGES[n].template for n in ("judge_consistent_strict", "judge_consistent_lenient")}


@query(
    "WITH p AS (SELECT DISTINCT question_id, question, answer, objective_facts FROM proposed_questions WHERE question IS NOT NULL AND answer IS NOT NULL) "
    + " UNION ALL ".join(f"SELECT question_id, '{n}' AS judge, 2 AS judged, 1 AS total, md5({_sql(t, question='question', basis="coalesce(objective_facts, '')", answer='answer')}) AS reason FROM p" for n, t in _J.items())
)
def stage_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two judges of a family over the same answers, side by side."""
    p = table(spark, sf_dir, "proposed_questions").where("question is not null and answer is not null").select("question_id", "question", "answer", "objective_facts").distinct()
    out = None
    for n in _J:
        one = stages.run(n, p, "question_id", make=_stub("<reason>{digest}</reason><judge>It is True</judge>\n<reason>b</reason><judge>no</judge><reason>open"), basis=F.col("objective_facts"))
        one = one.select("question_id", F.lit(n).alias("judge"), F.size("parsed.items").alias("judged"), F.col("parsed.total").alias("total"), F.get("parsed.items", F.lit(0))["reason"].alias("reason"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """WITH p AS (SELECT DISTINCT pair_id, chosen, rejected FROM preference_pairs), l AS (SELECT pair_id, 'chosen_answer' AS name, chosen AS answer FROM p UNION ALL SELECT pair_id, 'rejected_answer', rejected FROM p)
SELECT pair_id, name, answer FROM l WHERE answer IS NOT NULL AND NOT (pair_id % 3 = 0 AND name = 'chosen_answer')"""
)
def scoring_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers still to be scored, where the chosen ones of every third pair are."""
    p = table(spark, sf_dir, "preference_pairs").select("pair_id", F.col("chosen").alias("chosen_answer"), F.col("rejected").alias("rejected_answer"), F.lit(1).alias("chosen_answer_score"), F.lit("r").alias("chosen_answer_reason")).distinct()
    done = p.where("pair_id % 3 = 0").select("pair_id", F.lit("chosen_answer").alias("name"))
    return builders.relevance_tasks(p, ["pair_id"], done)


@query(
    """WITH v AS (SELECT DISTINCT variant_id, question_id, variant_kind, step, result FROM rephrased_questions)
SELECT variant_id, CASE WHEN step <= 2 THEN 'again ' || step || ' ' || question_id END AS reordered_question, CASE WHEN step <= 2 THEN step = 1 END AS same_meaning FROM v"""
)
def reordered_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reordered questions joined back by their number; the model answers the first two steps, the first one twice."""
    v = table(spark, sf_dir, "rephrased_questions").select("variant_id", "question_id", "variant_kind", "step", "result").distinct()
    one = lambda n, said, flag: F.concat(F.lit(f"<question-{n}> <transformed-question>{said} "), F.col("question_id").cast("string"), F.lit(f"</transformed-question>\n<same-meaning-with-origin>{flag}</same-meaning-with-origin>\n</question-{n}>\n"))
    out = v.select("question_id").distinct().withColumn("items", parse.reorderings(F.concat(one(1, "first", "False"), one(2, "again 2", "False"), one(1, "again 1", "True"))))
    return builders.reordered_back(v, out).select("variant_id", "reordered_question", "same_meaning")


@query(
    """WITH d AS (SELECT doc_id, rel_path, title, text FROM documents), s AS (SELECT rel_path, min('about ' || title) AS summary, min(length(text)) >= 200 AS valid FROM documents WHERE doc_id % 7 > 0 GROUP BY rel_path)
SELECT doc_id, coalesce(valid, false) AS published, CASE WHEN valid THEN '# ' || coalesce(title, '') || coalesce(chr(10) || chr(10) || summary, '') || chr(10) || chr(10) || '1. what is it?' || chr(10) || 'a page' END AS faq FROM d LEFT JOIN s USING (rel_path)"""
)
def published_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined with the summary of their path; of every seventh there is none."""
    d = table(spark, sf_dir, "documents").select("doc_id", "rel_path", "title", "text")
    s = d.where("doc_id % 7 > 0").groupBy("rel_path").agg(F.min(F.concat(F.lit("about "), F.col("title"))).alias("summary"), (F.min(F.length("text")) >= 200).alias("valid"))
    faq = F.array(F.struct(F.lit("what is it?").alias("question"), F.lit("a page").alias("answer")))
    kept, out = files.publish(d, s, "rel_path", F.col("valid"))
    left = d.join(out.distinct(), "rel_path", "left_semi").join(kept.select("doc_id"), "doc_id", "left_anti")
    return kept.select("doc_id", F.lit(True).alias("published"), files.faq_text(F.col("title"), F.col("summary"), faq).alias("faq")).unionByName(left.select("doc_id", F.lit(False).alias("published"), F.lit(None).cast("string").alias("faq")))


@query(
    """WITH v AS (SELECT question_id, list(scoring_criteria ORDER BY step, variant_id) FILTER (trim(scoring_criteria, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS r FROM (SELECT DISTINCT variant_id, question_id, step, scoring_criteria FROM rephrased_questions) GROUP BY question_id)
SELECT question_id, coalesce(array_to_string(list_transform(range(1, len(r) + 1), lambda i: 'Rule ' || i || ': ' || trim(r[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), chr(10)), '') AS rules FROM v"""
)
def rules_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "rephrased_questions").select("variant_id", "question_id", "step", "scoring_criteria").distinct()
    r = v.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("step", "variant_id", "scoring_criteria"))).alias("x"))  # bounded by the steps of a question
    return r.select("question_id", text.rules_block(F.transform("x", lambda s: s["scoring_criteria"])).alias("rules"))


@query(
    """WITH p AS (SELECT DISTINCT question_id, flavour, answer, all_in_top_3, all_in_top_5 FROM proposed_questions), g AS (SELECT question_id, min(rejected) AS generated FROM preference_pairs GROUP BY question_id),
v AS (SELECT DISTINCT variant_id, question_id, variant_kind, step, answer FROM rephrased_questions),
s AS (SELECT question_id AS record_id, flavour, NULL::VARCHAR AS variant, NULL::INT AS step, answer AS standard, generated, all_in_top_3, all_in_top_5 FROM p JOIN g USING (question_id)
  UNION ALL SELECT variant_id, flavour, variant_kind, step, v.answer, generated, all_in_top_3, all_in_top_5 FROM v JOIN p USING (question_id) JOIN g USING (question_id)),
o AS (SELECT s.*, k, CASE WHEN k = 3 THEN all_in_top_3 ELSE all_in_top_5 END AS found FROM s, (SELECT unnest([3, 5]) AS k) WHERE generated <> '' AND (variant IS NULL OR (variant = 'full' AND step IN (1, 3)) OR (variant = 'hybrid' AND step = 2)))
SELECT record_id, k AS top_k_value, coalesce(variant, 'original') || CASE WHEN found THEN '-retrieval_true-positive_are_standard' ELSE '-retrieval_false-positive_are_reject' END || '-negative_are_generated' AS data_gen_type
FROM o WHERE (found AND standard <> '') OR (NOT found AND (variant IS NULL OR flavour = 'entity_graph'))"""
)
def preference_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference rows over two depths and the chosen steps of the rewritings."""
    gen = table(spark, sf_dir, "preference_pairs").groupBy("question_id").agg(F.min("rejected").alias("g"))
    p = table(spark, sf_dir, "proposed_questions").select("question_id", "flavour", "answer", "all_in_top_3", "all_in_top_5").distinct().join(gen, "question_id")
    v = table(spark, sf_dir, "rephrased_questions").select("variant_id", "question_id", "variant_kind", "step", F.col("answer").alias("va")).distinct()
    own = p.select(F.col("question_id").alias("record_id"), "flavour", F.lit(None).cast("string").alias("variant"), F.lit(None).cast("int").alias("step"), F.col("answer").alias("standard"), "g", "all_in_top_3", "all_in_top_5")
    re = v.join(p, "question_id").select(F.col("variant_id").alias("record_id"), "flavour", F.col("variant_kind").alias("variant"), "step", F.col("va").alias("standard"), "g", "all_in_top_3", "all_in_top_5")
    both = lambda a, b: F.create_map(F.lit(3), a, F.lit(5), b)
    d = own.unionByName(re).select("record_id", "flavour", "variant", "step", "standard", both(F.lit("p"), F.lit("p")).alias("prompts"), both(F.col("g"), F.col("g")).alias("generated"), both(F.col("all_in_top_3"), F.col("all_in_top_5")).alias("found"))
    return builders.preference_driver(d, [3, 5], {"full": [1, 3], "hybrid": [2]}).select("record_id", "top_k_value", "data_gen_type")
