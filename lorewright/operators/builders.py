"""Rows for training and review, built from questions, retrieval and generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions import text as T

#: our own ways to say that nothing was found
REJECTIONS = [
    "I could not find anything about this in the documents.",
    "The documents at hand do not cover this.",
    "Nothing I was given answers this question.",
    "There is no passage here that settles this.",
    "I have no source that speaks to this.",
    "This is not answered by the material provided.",
    "None of the documents mention what is asked.",
    "I lack a document from which to answer.",
]


def rejection(key: Column) -> Column:
    """A phrase that depends on the key alone."""
    h = F.md5(key.cast("string"))
    at = F.pmod(F.ascii(h) * 7 + F.ascii(F.substring(h, 2, 1)), F.lit(len(REJECTIONS))) + 1
    return F.element_at(F.array(*[F.lit(x) for x in REJECTIONS]), at.cast("int"))


def prompts(questions: DataFrame, corpus: DataFrame, template: str, k: int, key: str, question: str, ranked: str, doc: str = "id", context: str = "context") -> DataFrame:
    """(key, prompt): the template with the question and the k best documents, in rank order. A question with a document
    that is missing gets no prompt."""
    top = questions.select(key, question, F.posexplode(F.slice(ranked, 1, k)).alias("rank", doc)).join(corpus.select(doc, context), doc, "left")
    docs = top.groupBy(key, question).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(doc).alias("d"), F.col(context).alias("c")))).alias("docs"), F.count_if(F.col(context).isNull()).alias("missing"))
    block = F.array_join(F.transform("docs", lambda x: F.concat(F.lit("[Doc "), x["d"], F.lit("] "), x["c"])), "\n")
    return docs.where("missing = 0").select(key, T.fill(F.lit(template), QUESTION=F.col(question), CLUES=block).alias("prompt"))


def preference_rows(df: DataFrame, k: int) -> DataFrame:
    """Preference rows from (record_id, flavour, variant, prompt, standard, generated, found): where retrieval found all gold
    documents the standard answer is chosen, else a rejection; rewritten content questions whose retrieval failed give no
    row; neither do rows without prompt or generated answer. variant is null for original questions."""
    kind = F.coalesce("variant", F.lit("original"))
    d = df.where("prompt is not null and generated is not null and generated <> '' and found is not null")
    good = d.where("found and standard is not null and standard <> ''").select("record_id", "prompt", F.col("standard").alias("chosen"), F.col("generated").alias("rejected"), F.concat(kind, F.lit("-retrieval_true-positive_are_standard-negative_are_generated")).alias("data_gen_type"))
    bad = d.where("not found and (variant is null or flavour = 'entity_graph')").select("record_id", "prompt", rejection(F.col("record_id")).alias("chosen"), F.col("generated").alias("rejected"), F.concat(kind, F.lit("-retrieval_false-positive_are_reject-negative_are_generated")).alias("data_gen_type"))
    return good.unionByName(bad).withColumn("top_k_value", F.lit(k))


def length_filter(df: DataFrame, most: int) -> DataFrame:
    """Rows whose prompt with chosen and prompt with rejected both have at most ``most`` characters."""
    return df.where((F.length("prompt") + F.length("chosen") <= most) & (F.length("prompt") + F.length("rejected") <= most))


def chat_messages(df: DataFrame) -> DataFrame:
    """df with messages: the prompt of the user and the chosen answer."""
    m = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return df.withColumn("messages", F.array(m("user", "prompt"), m("assistant", "chosen")))


def last_variants(variants: DataFrame, question: str = "question_id", kind: str = "variant_kind", step: str = "step", key: str = "variant_id") -> DataFrame:
    """The last step of each question and kind."""
    last = variants.groupBy(question, kind).agg(F.max_by(key, F.struct(step, key)).alias(key))
    return variants.join(last.select(key), key, "left_semi").dropDuplicates([key])


def previous_text(variants: DataFrame, originals: DataFrame, question: str = "question_id", kind: str = "variant_kind", step: str = "step") -> DataFrame:
    """variants with previous_result: the text of the step before, of the first step the original question."""
    w = Window.partitionBy(question, kind).orderBy(step, "variant_id")
    return variants.join(originals, question).withColumn("previous_result", F.coalesce(F.lag("result").over(w), F.when(F.row_number().over(w) == 1, F.col("question"))))


def batches(df: DataFrame, corpus: str, rank: Column, key: str, size: int, world: int) -> DataFrame:
    """df with batch_no and step_no: rows of one corpus in a keyed order cut to batches of ``size``, batches to steps of
    ``world``. Rows are dealt to as many lots as a corpus needs first, so no window holds a whole corpus."""
    n = df.groupBy(corpus).agg(F.count("*").alias("_n"))
    d = df.join(n, corpus).withColumn("_rank", rank)
    lots = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(1_000_000)))
    d = d.withColumn("_lot", F.floor(F.conv(F.substring("_rank", 1, 8), 16, 10).cast("double") / 4294967296.0 * lots))
    sizes = d.groupBy(corpus, "_lot").agg(F.count("*").alias("_m"))
    w0 = Window.partitionBy(corpus).orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_m").over(w0), F.lit(0))).drop("_m")
    w = Window.partitionBy(corpus, "_lot").orderBy("_rank", key)
    d = d.join(before, [corpus, "_lot"]).withColumn("_at", F.col("_before") + F.row_number().over(w) - 1)
    d = d.withColumn("batch_no", F.floor(F.col("_at") / size)).withColumn("step_no", F.floor(F.col("batch_no") / world))
    return d.drop("_n", "_rank", "_lot", "_before", "_at")


def review_queue(questions: DataFrame, variants: DataFrame, corpus: DataFrame, done: DataFrame) -> DataFrame:
    """What a reviewer sees of each variant that is not tagged yet: original and rewritten question, standard answer, context."""
    q = questions.select("question_id", F.col("question").alias("original_question"), "chunk_key")
    v = variants.select("variant_id", "question_id", F.coalesce("reordered_question", "result").alias("rephrased_question"), F.col("answer").alias("standard_answer"))
    return v.join(done.select("variant_id").distinct(), "variant_id", "left_anti").join(q, "question_id").join(corpus.select("chunk_key", "context"), "chunk_key", "left")


def long_answers(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model, k, answer) from columns named <model>-top_k_value-<k>-answer: dynamic columns become rows, in one pass."""
    cols = [c for c in df.columns if c.endswith("-answer") and "-top_k_value-" in c]
    if not cols:
        return df.select(*keys, F.lit(None).cast("string").alias("model"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("string").alias("answer")).limit(0)
    items = F.array(*[F.struct(F.lit(c.split("-top_k_value-")[0]).alias("model"), F.lit(int(c.split("-top_k_value-")[1].removesuffix("-answer"))).alias("k"), F.col(f"`{c}`").alias("answer")) for c in cols])
    return df.select(*keys, F.inline(items)).where("answer is not null")


def preference_driver(df: DataFrame, ks: list[int], positions: dict[str, list[int]]) -> DataFrame:
    """preference_rows over all k and the chosen steps of each kind of variant, one row set per k. df: (record_id, flavour,
    variant, step, standard, prompts map<int, string>, generated map<int, string>, found map<int, boolean>); original questions
    (variant null) always take part, of the variants those whose step is listed for their kind."""
    chosen = F.col("variant").isNull()
    for kind, steps in positions.items():
        chosen = chosen | (F.col("variant") == kind) & F.col("step").isin(steps)
    d = df.where(F.coalesce(chosen, F.lit(False)))
    at = lambda c, k: F.try_element_at(c, F.lit(k)).alias({"prompts": "prompt"}.get(c, c))
    out = None
    for k in ks:
        one = preference_rows(d.select("record_id", "flavour", "variant", "standard", at("prompts", k), at("generated", k), at("found", k)), k)
        out = one if out is None else out.unionByName(one)
    return out


def relevance_tasks(answers: DataFrame, keys: list[str], scored: DataFrame) -> DataFrame:
    """(keys, name, answer) still to be scored: one row per column whose name holds "answer" but neither "score" nor "reason", of
    the rows that have one, without what ``scored`` (keys, name) has."""
    cols = [c for c in answers.columns if "answer" in c and "score" not in c and "reason" not in c and c not in keys]
    items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("answer")) for c in cols]) if cols else F.array().cast("array<struct<name: string, answer: string>>")
    long = answers.select(*keys, F.inline(items)).where("answer is not null")
    return long.join(scored.select(*keys, "name").distinct(), [*keys, "name"], "left_anti")


def reordered_back(variants: DataFrame, outputs: DataFrame, question: str = "question_id", step: str = "step") -> DataFrame:
    """variants with reordered_question and same_meaning from the parsed outputs (question, array of (step, reordered_question,
    same_meaning)), joined by their ordinal; of an ordinal told twice the last one counts, variants without one keep null."""
    told = outputs.select(question, F.posexplode("items").alias("_at", "_x")).select(question, F.col("_x.step").cast("int").alias(step), "_at", F.struct("_x.reordered_question", "_x.same_meaning").alias("_x"))
    last = told.groupBy(question, step).agg(F.max_by("_x", "_at").alias("_x"))
    rest = [c for c in variants.columns if c not in ("reordered_question", "same_meaning")]
    return variants.select(*rest).join(last, [question, step], "left").select(*rest, "_x.reordered_question", "_x.same_meaning")
