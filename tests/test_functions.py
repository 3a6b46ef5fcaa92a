import math

import pytest
from pyspark.sql import functions as F

from lorewright.functions import cite, distributions, parse, ranges, text


def value(spark, col, **data):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in data.items()) or "x int"
    row = tuple(v for _, v in data.values()) or (1,)
    return spark.createDataFrame([row], schema).select(col.alias("r")).first().r


def s(v):
    return ("string", v)


@pytest.mark.parametrize(("ids", "want"), [("7-5, 2,2", [2, 5, 6, 7]), ("3-5,9", [3, 4, 5, 9]), ("", []), ("none", [])])
def test_expand(spark, ids, want):
    assert value(spark, ranges.expand(F.col("t")), t=s(ids)) == want


def test_count_after_expansion(spark):
    assert value(spark, ranges.expanded_count(F.col("t")), t=s("7-5")) == -1
    assert value(spark, ranges.expanded_count(F.col("t")), t=s("1-2,2")) == 3


@pytest.mark.parametrize(("ids", "facts", "citations"), [([4, 5, 9], "4-5,9", "4, 5, 9"), ([4, 5, 6, 9], "4-6,9", "4-6, 9"), ([1, 2, 3, 5], "1-3,5", "1-3, 5"), ([], "", "")])
def test_compress(spark, ids, facts, citations):
    assert value(spark, ranges.compress_facts(F.col("a")), a=("array<bigint>", ids)) == facts
    assert value(spark, ranges.compress_citations(F.col("a")), a=("array<bigint>", ids)) == citations


def test_citations(spark):
    got = value(spark, cite.citations(F.col("t")), t=s("x [Doc a, Sen 2, 4-5][Doc b, Sen 1] [Doc a, Sen 6-4]"))
    assert [(c.doc, c.sens) for c in got] == [("a", [2, 4, 5]), ("b", [1]), ("a", [])]


def test_clue_rewriting(spark):
    clues = ("array<struct<clue: bigint, doc: string, sens: array<bigint>>>", [(1, "d", [1]), (2, "d", [2]), (3, "a", [7, 8, 9])])
    for t, want in (("ok [Clue 1-2]", "ok [Doc d, Sen 1, 2]"), ("ok [Clue 9]", "ok [Clue 9]"), ("[Clue 2, 3] end", "[Doc a, Sen 7-9][Doc d, Sen 2] end"), ("none", "none")):
        assert value(spark, cite.rewrite_clues(F.col("t"), F.col("c")), t=s(t), c=clues) == want


def test_number_lines_and_newlines(spark):
    assert value(spark, text.strip_number_lines(F.col("t")), t=s("a\n1\n2\nb 7\nc")) == "a\nb c"
    assert value(spark, text.collapse_newlines(F.col("t")), t=s("a\n\n\n\nb\n\nc")) == "a\n\nb\n\nc"


def test_link_rewriting(spark):
    t = "[a](/x//y.html) ![i](img\\p.png) [b](https://z.example/q) [c](d.md)"
    col = text.rewrite_links(text.rewrite_links(F.col("t"), F.lit("https://s.example/"), images=True), F.lit("https://s.example/"))
    assert value(spark, col, t=s(t)) == "[a](https://s.example/x//y.html.md) ![i](https://s.example/img/p.png) [b](https://z.example/q) [c](https://s.example/d.md)"


def test_tokens_are_a_partition(spark):
    t = "  Ünï code, two\nlines 漢字!  "
    assert "".join(value(spark, text.tokens(F.col("t")), t=s(t))) == t


def test_packing(spark):
    t = "a b c\n\nd e\n\nf g h i. j k l m. n\n\no"
    assert value(spark, text.packed(F.col("t"), 5), t=s(t)) == ["a b c. d e", "f g h i.", "j k l m.", "n o"]  # a sentence closed the first
    assert value(spark, text.packed(F.col("t"), 2), t=s("a b c d")) == ["", "a b c d"]


def test_json_blocks(spark):
    t = s('x {"a":1} {"bb":22}')
    assert value(spark, parse.first_json_block(F.col("t")), t=t) == '{"a":1}'
    assert value(spark, parse.largest_json(F.col("t")), t=t) == '{"bb":22}'
    assert value(spark, parse.largest_json(F.col("t")), t=s('bad {x} [1, {"a": [2]}] {')) == '[1, {"a": [2]}]'
    assert value(spark, parse.largest_json(F.col("t")), t=s("none")) is None


def test_question_blocks(spark):
    q = lambda n: f"<question> q{n} </question> <objective-facts>1-2</objective-facts>\n<reasoning>r</reasoning><answer>a{n}</answer>"
    t = f"1. <one-questions>{q(1)} {q(2)}\n2. <two-questions>half <question>x</question>\n3. <one-questions>{q(3)}"
    got = value(spark, parse.questions(F.col("t")), t=s(t))
    assert [(x.category, x.question, x.answer) for x in got] == [("one-questions", "q3", "a3")]


def test_score_and_judgement(spark):
    assert tuple(value(spark, parse.reasoning_score(F.col("t")), t=s("Reasoning: fine\nScore: 4"))) == ("fine", 4)
    assert tuple(value(spark, parse.reasoning_score(F.col("t")), t=s("Reasoning: fine\nScore: four"))) == (None, None)
    j = value(spark, parse.judgements(F.col("t")), t=s("<reason>a</reason><judge>True</judge><reason>b</reason><judge>no</judge><reason>c</reason>"))
    assert j.total == 1 and [(x.reason, x.score) for x in j["items"]] == [("a", 1), ("b", 0)]


def test_answer_fallbacks(spark):
    f = lambda t: tuple(value(spark, parse.answer_reason(F.col("t")), t=s(t)))
    assert f("<answer>a</answer><reason>r</reason>") == ("a", "r")
    assert f("<reason>r</reason>") == ("r", None) and f("<answer> a </answer>") == ("a", None) and f("plain") == ("plain", None)


def test_distributions(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    d = {"p": ("array<double>", p), "q": ("array<double>", q)}
    kl = sum(a * math.log(a / b) for a, b in zip(p, q) if a)
    assert value(spark, distributions.kl(F.col("p"), F.col("q")), **d) == pytest.approx(kl)
    m = [(a + b) / 2 for a, b in zip(p, q)]
    js = sum(a * math.log(a / b) for v in (p, q) for a, b in zip(v, m) if a) / 2
    assert value(spark, distributions.jensen_shannon(F.col("p"), F.col("q")), **d) == pytest.approx(js, abs=1e-8)
    assert value(spark, distributions.jensen_shannon_distance(F.col("p"), F.col("q")), **d) == pytest.approx(js**0.5)
    e = [math.exp(2 * x) for x in q]
    assert value(spark, distributions.softmax(F.col("q"), 2.0), **d) == pytest.approx([x / sum(e) for x in e])
    with pytest.raises(ValueError):
        distributions.softmax(F.col("q"), 0)


def test_cosine_is_bounded(spark):
    a = ("array<double>", [3.0, 4.0])
    assert value(spark, distributions.cosine(F.col("a"), F.col("a")), a=a) == 0.999
    assert value(spark, distributions.cosine(F.col("a"), F.col("b")), a=a, b=("array<double>", [0.0, 0.0])) == 0.0


@pytest.mark.parametrize(("a", "b", "n"), [("abc", "abd", 1), ("abc", "ab", 1), ("", "xy", 2), ("abcd", "bcda", 4)])
def test_positional_difference(spark, a, b, n):
    assert value(spark, distributions.positional_difference(F.col("a"), F.col("b")), a=s(a), b=s(b)) == n


def test_ranges_too_wide_are_left_out(spark):
    assert value(spark, ranges.expand(F.col("t")), t=s("2-3, 1-9999999999, 7")) == [2, 3, 7]
    assert value(spark, ranges.expand_strict(F.col("t")), t=s("1-9999999999,4")) == [4]
    assert value(spark, ranges.too_wide(F.col("t")), t=s("2-3, 1-9999999999, 99999999999999999999999, 7")) == 2
