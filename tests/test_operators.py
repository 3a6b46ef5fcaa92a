import math

import pytest
from pyspark.sql import functions as F

from lorewright.functions import providers
from lorewright.operators import annotate, builders, chunks, evaluation, graph, html, retrieval, tiers
from lorewright.sources import files


def test_annotation_goldens(spark):
    cases = {
        "Hi there. Bye": "Hi there [Sen 1]. Bye [Sen 2]",
        "Hi there. Bye\n\nlast?": "Hi there [Sen 1]. Bye [Sen 2]\n\nlast [Sen 3]?",
        "One. Two!\n| a b. | c \\| d |  |\n![x](y.png)tail": "One [Sen 1]. Two [Sen 2]!\n\n| a b [Sen 3]. | c \\| d [Sen 4] |\n![x](y.png) [Sen 5]\ntail [Sen 6]",
        "| a | b |\n|---|---|\n| x. y | z |\nEnd.": "| a [Sen 1] | b [Sen 2] |\n| --- [Sen 3] | --- [Sen 4] |\n| x [Sen 5]. y [Sen 6] | z [Sen 7] |\nEnd [Sen 8].",
        "![a](b)![c](d)": "![a](b) [Sen 1]\n![c](d) [Sen 2]",
        "": "",
        "\n": "\n",
        None: None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    assert {r.k: r.context for r in annotate.annotated(df, "k", "t").collect()} == dict(enumerate(cases.values()))
    plain = [t for t in cases if t is None or "|" not in t and "!" not in t]
    assert [r.c for r in spark.createDataFrame([(t,) for t in plain], "t string").select(annotate.annotate_plain(F.col("t")).alias("c")).collect()] == [cases[t] for t in plain]


def test_sentence_spans(spark):
    df = spark.createDataFrame([(1, "ab[Sen 1]cde[Sen 2]")], "k int, c string")
    assert [tuple(r)[1:] for r in annotate.sentence_spans(df, "k", "c").orderBy("sen_id").collect()] == [(1, 0, 2), (2, 9, 12)]


def test_sliding_chunks(spark):
    df = spark.createDataFrame([(1, "w " * 1150, "a/b.md"), (2, None, "x"), (3, "", "y")], "doc_id int, text string, rel_path string")
    got = chunks.token_chunks(df, "text", "rel_path").orderBy("chunk_no").collect()
    assert [r.n_tokens for r in got] == [1151 - 0 if i == 0 else 51 for i in range(2)]  # the last blank is a token
    assert [r.chunk_id for r in got] == ["a_b.md_chunk_0", "a_b.md_chunk_1"]
    t = "w " * 1150
    assert all(t[r.start_char_pos : r.end_char_pos] == r.chunk for r in got)


def test_tiers_are_cumulative(spark):
    df = spark.createDataFrame([(i, "s" if i % 3 else "t", f"p{i}", i) for i in range(40)], "doc_id int, source string, rel_path string, n_tokens int")
    spec = [tiers.Rule(1, "random", 2), tiers.Rule(2, "length", 3), tiers.Rule(3, "all", source="t")]
    first = tiers.first_tiers(df, spec)
    m = {t: {r.doc_id for r in tiers.members(first, 3).where(F.col("tier") == t).collect()} for t in (1, 2, 3)}
    assert m[1] < m[2] < m[3] and len(m[1]) == 4
    assert {r.doc_id for r in tiers.minus(first, 3).where("tier = 3").collect()} == m[3] - m[1]
    with pytest.raises(ValueError):
        tiers.first_tiers(df, [tiers.Rule(1, "other")])


def test_rank_metrics(spark):
    d = spark.createDataFrame([(["a", "x"], ["a", "b", "c"], ["a", "b", "c"], ["b"], [])], "t array<string>, g array<string>, r array<string>, one array<string>, none array<string>")
    r = d.select(
        retrieval.overlap_at(F.col("t"), F.col("g"), 2).alias("o"),
        retrieval.ndcg_at(F.col("r"), F.col("one"), 3).alias("n"),
        retrieval.ndcg_at(F.col("r"), F.col("none"), 3).alias("z"),
        retrieval.overlap_at(F.col("t"), F.col("none"), 2).alias("u"),
        retrieval.all_in_top(F.col("r"), F.col("one"), 1).alias("a"),
        retrieval.hit_at(F.col("r"), F.lit("b"), 2).alias("h"),
    ).first()
    assert (r.o, r.n, r.z, r.u, r.a, r.h) == (0.5, pytest.approx(1 / math.log2(3)), 0.0, None, False, True)


def test_top_k_ties_and_passes(spark):
    rows = [(i, [1.0, float(i % 2)]) for i in range(8)]
    df = spark.createDataFrame(rows, "k bigint, v array<double>")
    got = {(r.query_id, r.rank): r.doc_id for r in retrieval.top_k(df.where("k < 3"), df, "k", "v", 2, k=3, block=2).collect()}
    assert [got[0, i] for i in (1, 2, 3)] == [1, 2, 3] and [got[1, i] for i in (1, 2, 3)] == [3, 5, 7]
    assert retrieval.top_k(df.limit(0), df, "k", "v", 2).collect() == []
    assert retrieval.top_k(df, df.limit(0), "k", "v", 2).collect() == []


def test_top_k_against_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(3).integers(-3, 4, (90, 4)).astype(float) + 0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] * 2, "k bigint, v array<double>")
    m = x @ x.T
    want = {(i, r + 1): j for i in range(90) for r, j in enumerate([j for j in np.lexsort((np.arange(90), -m[i])) if j != i][:5])}
    assert {(r.query_id, r.rank): r.doc_id for r in retrieval.top_k(df, df, "k", "v", 4, k=5, scale=1.0, block=17).collect()} == want


def test_hard_negatives_need_enough(spark):
    found = spark.createDataFrame([(1, i, 10 + i, 1.0) for i in range(1, 7)] + [(2, i, 10 + i, 1.0) for i in range(1, 4)], "query_id bigint, rank int, doc_id bigint, score double")
    pos = spark.createDataFrame([(1, 11), (1, 12), (2, 11), (2, 12)], "query_id bigint, doc_id bigint")
    assert [(r.query_id, r.doc_id, r.negative) for r in retrieval.hard_negatives(found, pos, 2).orderBy("negative").collect()] == [(1, 13, 1), (1, 14, 2)]


def test_citation_counts(spark):
    assert evaluation.fuzzy_counts({"d": {1, 2}}, {"d": {2, 3}}) == (1, 0, 0)
    assert evaluation.fuzzy_counts({"doc_1": {1}, "far": {5}}, {"doc_2": {1, 4}}) == (1, 1, 1)
    g = spark.createDataFrame([(1, "d", 1), (1, "d", 2)], "k int, doc string, sen int")
    s = spark.createDataFrame([(1, "d", 2), (1, "d", 3)], "k int, doc string, sen int")
    c = evaluation.citation_counts(g, s, "k")
    assert tuple(c.first()) == (1, 1, 1, 1)
    assert c.select(evaluation.prf(F.col("both"), F.col("only_generated"), F.col("only_gold"))["f1"]).first()[0] == 0.5


def test_leave_one_out(spark):
    d = spark.createDataFrame([(["a", "b", "c"],)], "c array<string>")
    assert [tuple(r) for r in d.select(F.inline(evaluation.leave_one_out(F.col("c")))).collect()] == [(1, "1. b\n2. c"), (2, "1. a\n2. c"), (3, "1. a\n2. b")]


def test_graph_examples(spark):
    e = spark.createDataFrame([(0, 1, "x"), (1, 2, "y"), (4, 4, "z"), (None, 1, "n")], "s bigint, t bigint, d string")
    inc = graph.incidence(e, "s", "t")
    assert inc.where("vertex = 4").count() == 2 and inc.where("vertex = 1").count() == 2
    seed = spark.createDataFrame([(0,)], "seed bigint")
    for depth, want in ((0, {0}), (1, {0, 1}), (2, {0, 1, 2})):
        assert {r.vertex for r in graph.bounded_subgraph(e, "s", "t", seed, depth).collect()} == want
    assert {tuple(r) for r in graph.threshold_components(e.where("s is not null"), "s", "t").collect()} == {(0, 0), (1, 0), (2, 0)}


def test_names_resolve_to_the_least_id(spark):
    e = spark.createDataFrame([(5, "X"), (3, "X"), (9, "X"), (4, None)], "entity_id bigint, entity_name string")
    assert {tuple(r) for r in graph.same_name_map(e).collect()} == {(5, 3), (3, 3), (9, 3), (4, 4)}
    a = spark.createDataFrame([(5, 3), (3, 3)], "entity_id bigint, canonical_id bigint")
    b = spark.createDataFrame([(3, 1), (8, 2)], "entity_id bigint, canonical_id bigint")
    assert {tuple(r) for r in graph.compose(a, b).collect()} == {(5, 1), (3, 1), (8, 2)}
    assert {tuple(r) for r in graph.compose(a, b, faithful=True).collect()} == {(5, 3), (3, 1), (8, 2)}


def test_running_ids(spark):
    df = spark.createDataFrame([(i * 7 % 100,) for i in range(100)], "k int")
    assert [(r.k, r.n) for r in graph.running_ids(df, ["k"], "n").orderBy("k").collect()] == [(i, i) for i in range(100)]


def test_resolution_rounds(spark):
    g = spark.createDataFrame([("n", i, f"t{i % 3}") for i in range(30)], "group string, member bigint, text string")

    def resolver(lots):
        first = lots.groupBy("group", "lot", "text").agg(F.min("member").alias("into"))
        return lots.join(first, ["group", "lot", "text"]).where("member <> into").select("member", "into")

    got = {r.member: r.canonical for r in graph.resolve_groups(g, resolver, size=10).collect()}
    assert len(got) == 30 and set(got.values()) == {0, 1, 2} and all(got[i] % 3 == i % 3 for i in got)


def test_resolution_counts_rounds_per_group(spark):
    g = spark.createDataFrame([(n, 100 * k + i, "t") for k, n in enumerate("abc") for i in range(9)], "group string, member bigint, text string")
    seen = []

    def resolver(lots):
        """One member less a round: in a at once, in b from the second round on, in c never."""
        seen.append({r.group for r in lots.select("group").distinct().collect()})
        pair = lots.groupBy("group", "lot").agg(F.max("member").alias("member"), F.min("member").alias("into"))
        return pair.where("group = 'a'" if len(seen) == 1 else "group in ('a', 'b')").select("member", "into")

    got = {r.member: r.canonical for r in graph.resolve_groups(g, resolver).collect()}
    assert len(got) == 27 and seen == [set("abc")] * 2 + [set("ab")] * 3 + [{"b"}]
    assert [sum(got[100 * k + i] != 100 * k + i for i in range(9)) for k in range(3)] == [5, 5, 0]


def test_preference_rows(spark):
    rows = [(1, "content", None, "p", "good", "bad", True), (2, "content", None, "p", "good", "bad", False), (3, "content", "full", "p", "good", "bad", False), (4, "entity_graph", "full", "p", "good", "bad", False), (5, "content", None, "p", "good", None, True)]
    df = spark.createDataFrame(rows, "record_id bigint, flavour string, variant string, prompt string, standard string, generated string, found boolean")
    got = {r.record_id: (r.chosen in builders.REJECTIONS, r.data_gen_type.split("-")[0]) for r in builders.preference_rows(df, 3).collect()}
    assert got == {1: (False, "original"), 2: (True, "original"), 4: (True, "full")}


def test_long_answers(spark):
    df = spark.createDataFrame([(1, "x", None)], "k int, `m-top_k_value-3-answer` string, `n-top_k_value-5-answer` string")
    assert [tuple(r) for r in builders.long_answers(df, ["k"]).collect()] == [(1, "m", 3, "x")]
    assert builders.long_answers(df.select("k"), ["k"]).collect() == []


def test_html():
    page = '<nav>menu</nav><div id="content" class="ddc-main-content x"><h2>Dose</h2><p>Take <b>one</b>.<ul><li>a<li>b</ul><a href="/x.html">more</a><script>no()</script></div>'
    assert html.main_content(page, "drugs") == "## Dose\n\nTake **one**.\n\n- a\n- b\n\n[more](/x.html)"
    assert html.main_content(page, "wiki") == ""
    assert html.main_content("<article id='main-content'>text</article>", "clinic") == "text"
    assert html.main_content("<h1 class='page-title'>T</h1><div class='card card-lg'>c</div>", "webcopy") == "# T\n\nc"
    assert html.to_markdown("<div>" * 5000 + "deep") == "deep"


def test_providers_retry_and_ask_once(spark):
    calls = []

    def flaky(prompts):
        calls.append(len(prompts))
        if len(calls) == 1:
            raise OSError
        return [None if p == "b" and len(calls) == 2 else p.upper() for p in prompts]

    assert providers.Retrying(flaky, 3)(["a", "b"]) == ["A", "B"] and calls == [2, 2, 1]
    df = spark.createDataFrame([(1, "p"), (2, "p"), (3, None)], "k int, prompt string")
    got = {r.k: r.out for r in providers.complete(df, "prompt", "out").collect()}
    assert got[1] == got[2] is not None and got[3] is None


def test_files_round_trip(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "a").mkdir(parents=True)
    (root / "a" / "x.md").write_text("one\ntwo")
    (root / "a" / "valid_document_index.md").write_text("no")
    (root / "y.txt").write_text("no")
    assert [r.text for r in files.read_texts(spark, str(root)).collect()] == ["one\ntwo"]
    (tmp_path / "o.json").write_text('{"k1": {"a": 1}, "k2": {"a": 2}}')
    assert {(r.key, r.value.a) for r in files.read_json_object(spark, str(tmp_path / "o.json"), "struct<a: int>").collect()} == {("k1", 1), ("k2", 2)}
    (tmp_path / "l.json").write_text('[\n{"a": 1},\n{"a": 2}\n]')
    assert files.read_json_array(spark, str(tmp_path / "l.json"), "a int").count() == 2
    d = spark.createDataFrame([(1, "ü")], "k int, t string")
    files.write_json_lines(d, str(tmp_path / "w"))
    assert files.read_json_lines(spark, str(tmp_path / "w"), "k int, t string").collect() == d.collect()
    files.write_text(d, F.col("t"), str(tmp_path / "t"))
    out = str(tmp_path / "resume")
    assert files.resume_append(d, out, ["k"]).count() == 1
    assert files.resume_append(spark.createDataFrame([(1, "again"), (2, "new")], "k int, t string"), out, ["k"]).count() == 2


def test_tree_fold(spark):
    df = spark.createDataFrame([("a/b/x", "1"), ("a/b/y", "2"), ("a/z", "3"), ("c", None)], "p string, v string")
    got = {r.path: r.value for r in files.fold_tree(df, "p", "v", lambda vs: F.concat(F.lit("("), F.array_join(vs, "+"), F.lit(")"))).collect()}
    assert got == {"a/b/x": "1", "a/b/y": "2", "a/b": "(1+2)", "a/z": "3", "a": "((1+2)+3)"}


def test_script_mirrors_are_left_out(spark):
    rows = [(1, "a/page.html"), (2, "a/page.js.html"), (3, "b/x.js.htm"), (4, "b/js.html?y"), (5, None), (6, "c/js.html/z")]
    df = spark.createDataFrame([(k, "<p>text</p>", "none", p) for k, p in rows], "k int, html string, site string, path string")
    assert {r.k for r in html.pages_to_markdown(df, "k", "html", "site", "path").collect()} == {1, 4, 5, 6}


def test_lots_of_a_hot_group_are_of_bounded_size(spark):
    g = spark.createDataFrame([("hot", i, str(i)) for i in range(3000)] + [("cold", 5000 + i, "same") for i in range(3)], "group string, member bigint, text string")
    sizes = []

    def resolver(lots):
        sizes.extend(r["count"] for r in lots.groupBy("group", "lot").count().collect())
        return lots.where("group = 'cold' and member > 5000").select("member", F.lit(5000).cast("bigint").alias("into"))

    got = {r.member: r.canonical for r in graph.resolve_groups(g, resolver, max_merges=1, idle=1).collect()}
    assert max(sizes) <= 10 and len(sizes) < 400
    assert {k for k, v in got.items() if k != v} == {5001, 5002}


def test_long_documents_are_cut_to_chunks_that_meet(spark):
    t = " ".join(f"word{i}," for i in range(6000))
    got = chunks.token_chunks(spark.createDataFrame([(t, "p")], "text string, path string"), "text", "path", size=500, overlap=50).orderBy("chunk_no").collect()
    assert [r.start_char_pos for r in got][0] == 0 and all(t[r.start_char_pos : r.end_char_pos] == r.chunk for r in got)
    assert len(got) == -(-12000 // 450) and all(b.start_char_pos < a.end_char_pos for a, b in zip(got, got[1:]))


def test_shared_folder_must_be_set_on_a_cluster():
    from types import SimpleNamespace as N

    from lorewright import storage

    on = lambda master, path: N(conf=N(get=lambda k, d: path), sparkContext=N(master=master))
    assert storage.shared_dir(on("spark://host:7077", "hdfs:///x/")) == "hdfs:///x"
    with pytest.raises(RuntimeError):
        storage.shared_dir(on("local-cluster[2,1,1024]", None))
