import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright.llm import forest, pairs

Q = "Which signed form must be sent to Dafo before Miru renews the visa letter?"
A = "Dafo decides about the signed form, while Miru only keeps the letter on file for 12 months."


@pytest.mark.parametrize(
    ("text", "question", "want"),
    [
        (None, Q, "empty"),
        ("", Q, "empty"),
        (" ​﻿\n", Q, "empty"),
        ("**Answer:**", Q, "empty"),
        ("[Clue 1] [Clue 2-3].", Q, "empty"),
        ("N/A", Q, "empty"),
        ("<br/>", Q, "empty"),
        ("(no answer)", Q, "empty"),
        ("&nbsp;", Q, "empty"),
        ("Yes.", Q, None),
        ("467", Q, None),
        ("Dafo Miru, 12 days", Q, None),
        (A, Q, None),
        (A[:-1] + " [Clue 3, 6].", Q, None),
        (A + " [Clue 3]", Q, None),
        (A[:50], Q, "truncated"),
        (A + " [Clue ", Q, "truncated"),
        ("It is as follows:\n- form: signed\n- letter: late", Q, None),
        (Q, Q, "copy"),
        (Q.upper(), Q, "copy"),
        (f"Question: {Q}\nAnswer: {Q}", Q, "copy"),
        (f"{Q} [Clue 2]", Q, "copy"),
        (f"{Q} {A}", Q, None),
        ("I'm sorry, but I can't help with that request. Try a different question.", Q, "refusal"),
        ("Das kann ich leider nicht beantworten.", Q, "refusal"),
        ("抱歉，我无法回答这个问题。", Q, "refusal"),
        (f"Sorry to hear that. {A}", Q, None),
        ("You cannot replace the form after the deadline, but Dafo accepts a late letter.", Q, None),
        ("Der Antrag von Dafo wird nach 12 Tagen geprüft, sobald die Liste vorliegt. Das gilt nicht für Miru.", Q, "other_language"),
        ("只有 Dafo 可以修改表格，因为 Miru 已经把它交给了办公室。", Q, "other_language"),
        (A, None, None),
    ],
)
def test_rules(text, question, want):
    assert pairs.rule(text, question) == want


@pytest.mark.parametrize(
    "text",
    [
        "I'm unable to help with that.",
        "I am unable to answer this question.",
        "Je ne peux répondre.",
        "Je ne puis vous aider.",
        "I cant answer that.",
        "I'm sorry, but I can't help with this request, because what you have asked me for here concerns, as far as I can see, the letter that Dafo has signed and that Miru has kept on file in the office ever since the twelve months were over.",
        "I must decline.",
        "I'd rather not say.",
        "That is beyond what I can tell.",
        "The documents are silent on that.",
        "Dazu liegen mir keine Daten vor.",
        "Les textes n'en disent rien.",
        "Los textos no dicen nada de eso.",
        "Eso no puedo responder.",
    ],
)
def test_every_way_to_decline(text):
    assert pairs.rule(text, Q) == "refusal"


def test_shortened_versions():
    full = "The letter stays valid for 365 weeks. Dafo signs it."
    assert pairs._shortened_of(full[:20], full)
    assert not pairs._shortened_of(full[:37], full)  # ends with the sentence
    assert not pairs._shortened_of("12", "125")
    assert not pairs._shortened_of(full, full + " [Clue 2]")
    assert pairs._shortened_of("Version 5.", "Version 5.3 of the tool adds a filter.")


def test_defects_over_a_collection(spark):
    full = "Dafo Miru signs the letter"
    rows = [(1, "answer", full + ".", Q), (1, "answer", full + ".", Q), (2, "answer", "Dafo Miru", Q), (3, "chosen", None, None), (3, "rejected", A, None)]
    df = spark.createDataFrame(rows, "record_id bigint, field string, text string, question string")
    assert {tuple(r) for r in pairs.defects(df).collect()} == {(2, "answer", "truncated"), (3, "chosen", "empty")}
    assert pairs.defects(df.limit(0)).collect() == []


def test_shortened_versions_behind_followers_that_do_not_count(spark):
    t = ["Dafo Miru", "Dafo Miru [Clue 3].", "Dafo Miru\nholds it", "Dafo Miru.", "Dafo Miru signs", "Dafo Miru signs [Clue 1]", "Dafo Miru signs the letter.", "Dafo Mirus"]
    t += ["Wasi", *(f"Wasi [Clue {i}]." for i in range(400)), "Wasi keeps the list."]
    df = spark.createDataFrame([(x,) for x in t], "text string").withColumn("h", F.expr("xxhash64(text)"))
    want = {"Dafo Miru", "Dafo Miru signs", "Wasi"}
    for whole in ("true", "false"):  # in one partition; Wasi's followers over several
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", whole)
        try:
            got = {r.text for r in pairs.shortened(df.select("text")).distinct().join(df, "h").collect()}
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert got == want


def test_tables_and_intended_refusals(spark):
    no = "I can't help with that request."
    r = spark.createDataFrame([(1, Q, A), (2, None, no), (2, None, no)], "variant_id bigint, result string, answer string")
    p = spark.createDataFrame(
        [(7, f"Read.\n[Doc 0] text\n\n## Question\n{Q}", no, Q, "x-positive_are_reject-y"), (8, f"Read.\nQuestion: {Q}", no, A, "standard"), (9, None, A, None, None)],
        "pair_id bigint, prompt string, chosen string, rejected string, data_gen_type string",
    )
    assert {tuple(x) for x in pairs.defective_pairs(r, p).collect()} == {(2, "answer", "refusal"), (7, "rejected", "copy"), (8, "chosen", "refusal"), (9, "rejected", "empty")}


def judged(spark, lengths):
    return spark.createDataFrame([(i, "answer", None, o, n) for i, (n, o) in enumerate(lengths)], "record_id bigint, field string, defect string, open boolean, n int")


def test_length_limits(spark):
    plain = [(150 + i % 40, False) for i in range(400)] + [(150 + i, True) for i in range(0, 40, 3)]
    assert pairs.length_limits(judged(spark, plain)) == []
    assert pairs.length_limits(judged(spark, plain + [(200, True)] * 9)) == [("answer", 200)]  # nine are enough
    assert pairs.length_limits(judged(spark, [(n // 4, o) for n, o in plain] + [(50, True)] * 40)) == [("answer", 50)]  # so is a short limit
    assert pairs.length_limits(judged(spark, plain + [(20, True)] * 60)) == []  # short answers of one length: most texts are longer
    assert pairs.length_limits(judged(spark, [])) == []


def test_words_of_a_language_are_learned(spark):
    en = [f"The signed {w} is sent to the office before it closes, and the clerk keeps it." for w in ("form", "letter", "list", "map") * 5]
    fr = [f"Le clerc garde la {w} dans le bureau et il la rend après deux semaines." for w in ("lettre", "liste", "carte", "note") * 5]
    index = pairs.language_words(spark.createDataFrame([(t,) for t in [*en, *fr, "12 Dafo", None]], "text string"))
    assert index["clerk"] == {"en"} and index["semaines"] == {"fr"} and index["the"] == {"en"} and "dafo" not in index and "12" not in index
    assert pairs.rule("Clerc bureau semaines rend garde deux.", "The clerk keeps the signed office list?", index) == "other_language"
    assert pairs.language_words(spark.createDataFrame([], "text string")) == pairs._INDEX


def test_comparable_texts():
    assert pairs.comparable(pairs._plain("**Answer:** The  map [Clue 3-5] .\n\n Next")) == "the map.\nnext"


def test_evidence(spark):
    full = "Dafo Miru signs the letter"
    rows = [(1, "answer", full + ".", Q), (2, "answer", "**dafo  miru** [Clue 2]", Q), (3, "chosen", None, None), (4, "answer", full + " and the", Q)]
    got = {(r.defect, r.by_rule, r.by_neighbour, r.by_limit): r.texts for r in pairs.evidence(spark.createDataFrame(rows, "record_id bigint, field string, text string, question string")).collect()}
    assert got == {("truncated", False, True, False): 1, ("empty", True, False, False): 1, ("truncated", True, False, False): 1}


def vectors(n=400, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n // 4, dim))
    return np.concatenate([x + 0.15 * rng.standard_normal(x.shape) for _ in range(4)]).astype(np.float32) * rng.uniform(0.5, 3, (n, 1)).astype(np.float32)


def test_forest_finds_what_brute_force_finds(spark):
    x = vectors(2000)
    df = spark.createDataFrame([(i, v.tolist(), 5) for i, v in enumerate(x)], "vec_id bigint, v array<float>, rank int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    args = {"dim": 16, "trees": 6, "candidates": 600}
    near = forest.neighbours(df, "vec_id", "v", k=5, **args)
    got = {(r.vec_id, r.neighbour) for r in near.collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert forest.compared(df, "vec_id", "v", **args).first().share < 0.5
    truth = forest.exact(df.where("vec_id % 20 = 0"), df, "vec_id", "v", dim=16, k=5, block=7)
    assert {(r.vec_id, r.neighbour) for r in truth.collect()} == {p for p in want if p[0] % 20 == 0}
    assert forest.recall(near, truth, "vec_id").first().recall >= 0.9
    close = {(i, int(j)) for i, j in want if s[i, j] >= 0.95}
    assert {(r.vec_id, r.neighbour) for r in forest.neighbours(df, "vec_id", "v", k=5, least=0.95, **args).collect()} >= close


def test_forest_takes_only_usable_vectors(spark):
    good = [1.0, 0.0, 0.0]
    rows = [(1, good), (1, good), (2, [2.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [1.0, 2.0]), (8, [1.0, 0.1, 0.0]), (None, good), (9, [1.0, None, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<float>")
    got = [tuple(r) for r in forest.neighbours(df, "vec_id", "v", dim=3, k=10).select("vec_id", "rank", "neighbour").orderBy("vec_id", "rank").collect()]
    assert got == [(1, 1, 2), (1, 2, 8), (2, 1, 1), (2, 2, 8), (8, 1, 1), (8, 2, 2)]
    assert forest.neighbours(df.limit(0), "vec_id", "v", dim=3).collect() == []
    assert forest.compared(df.limit(0), "vec_id", "v", dim=3).first().compared == 0
    assert forest.exact(df.limit(0), df, "vec_id", "v", dim=3).collect() == []


def test_copies_are_one_class(spark):
    rows = [(i, [1.0, 1.0]) for i in range(300)] + [(1000, [1.0, 0.9])]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<float>")
    got = forest.neighbours(df, "vec_id", "v", dim=2, k=3, candidates=2).collect()
    assert len(got) == 301 * 3
    assert {r.neighbour for r in got if r.vec_id == 250} == {0, 1, 2} and {r.neighbour for r in got if r.vec_id == 1} == {0, 2, 3}


def test_ranges_are_those_that_share_the_prefix():
    rng = np.random.default_rng(0)
    code = np.sort(rng.integers(0, 1 << 63, 500))
    stop = rng.choice([0, 1, 3, 7, 11, 40, 63], 500)
    lo, hi = forest.ranges(code, stop)
    for i in range(0, 500, 7):
        same = [j for j in range(500) if (int(code[j]) >> (63 - int(stop[i]))) == (int(code[i]) >> (63 - int(stop[i])))]
        assert (lo[i], hi[i] - 1) == (same[0], same[-1])


def test_all_trees_ascend_together_and_no_prefix_grows_beyond_its_bound():
    rng = np.random.default_rng(1)
    leaves = rng.integers(0, 40, (3, 1 << 11))
    levels = forest.Levels(leaves, candidates=500, cap=300)
    codes = rng.integers(0, 1 << 63, (50, 3))
    root, stop = levels.of(codes)
    for i in range(50):
        for t in range(3):
            size = lambda b: levels.size[b][t, codes[i, t] >> (63 - b)] if b <= 11 else levels.size[11][t, codes[i, t] >> 52] / 2 ** (b - 11)  # noqa: E731,B023
            assert size(root[i, t]) <= 300 and (root[i, t] == 0 or size(root[i, t] - 1) > 300) and stop[i, t] >= root[i, t]
        free = [t for t in range(3) if stop[i, t] > root[i, t]]
        assert len({stop[i, t] for t in free}) <= 1
