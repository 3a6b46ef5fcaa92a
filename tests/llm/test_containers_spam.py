import os
import random

import pytest

from lorewright.llm import containers, spam_pages

needs_vocabulary = pytest.mark.skipif(not os.path.exists(containers.TOKENIZER), reason="no tokenizer files")


def test_best_fit_never_overfills_and_reuses_room():
    b = containers.BestFit(100, 4, "x")
    rng = random.Random(0)
    used = {}
    for _ in range(2000):
        s = rng.randrange(1, 101)
        k = b.put(s)
        used[k] = used.get(k, 0) + s
        assert used[k] <= 100 and b.open <= 4
    assert sum(used.values()) / (100 * len(used)) > 0.85


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    b = containers.BestFit(10, 2, "x")
    assert [b.put(6), b.put(8), b.put(2), b.put(9)] == ["x-0", "x-1", "x-1", "x-2"]
    assert b.put(5) == "x-3"  # 0 (4 free) and 2 (1 free) are open; 2 closes
    assert b.put(4) == "x-0"


@needs_vocabulary
def test_pack(spark):
    rows = [(1, "one two three " * 40), (2, "word " * 700), (3, None), (4, ""), (5, "x"), (5, "x"), (None, "y")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, piece int").coalesce(1)
    got = containers.pack(df, "doc_id", "text", capacity=256).collect()
    per = {}
    for r in got:
        if r.container:
            per[r.container] = per.get(r.container, 0) + r.n_tokens
    assert max(per.values()) <= 256
    two = sorted((r.piece, r.token_start, r.n_tokens) for r in got if r.doc_id == 2)
    n = len(containers.tokenizer().encode_ordinary("word " * 700))
    assert [x[1] for x in two] == list(range(0, n, 256)) and sum(x[2] for x in two) == n
    assert [r.container for r in got if r.doc_id in (3, 4)] == [None, None]
    assert sum(r.doc_id == 1 for r in got) == 1 and sum(r.doc_id == 5 for r in got) == 2
    assert containers.fill(containers.pack(df, "doc_id", "text", capacity=256), 256).first().containers == len(per)
    assert containers.pack(df.limit(0), "doc_id", "text").collect() == []


PROSE = "The office keeps a copy of the map for the guests. Nobody could say why the gate was counted twice. Most readers compare the old shield with the new one before they write to the guild. "
CASES = [
    ("cheap rune buy rune online rune best rune price " * 12, True),
    (" | ".join(["rune cheap", "Dafo rune", "rune", "shield order now", "Dafo shield cheap", "shield"] * 12), True),
    ("\n".join(f"https://site{i}.example/page{i * 7919 % 977}" for i in range(30)), True),
    ("\n".join(f"1. [rune {w}](https://a{i}.example/b)" for i, w in enumerate(["cheap", "best", "price", "online"] * 10)), True),
    (" ".join(f"#{a}{b}" for a in ("rune", "shield", "map") for b in ("cheap", "best", "now", "sale", "deal")), True),
    ("Dafo rune is Dafo rune for Dafo rune users who want Dafo rune. Get Dafo rune, only Dafo rune, now Dafo rune! " * 15, True),
    (PROSE * 2, False),
    ("A short note without end", False),
    ("| a | b |\n|---|---|\n" + "\n".join(f"| name{i} | {i * 37} |" for i in range(60)), False),
    ("\n".join(f"**term{i}**: what the word number {i * 7} means in this place, told at some length." for i in range(20)), False),
    ("\n".join(f"- [page {i}](https://a.example/{i}): tells the reader where item {i * 13} is kept and by whom." for i in range(12)), False),
    (PROSE * 3 + "\n\n" + "rune cheap " * 20, False),
    ("# Heading\n\n" + PROSE + "\n\n" + "cheap rune buy rune online rune best rune price " * 20, True),
    ("", False),
    (None, False),
    ("   \n ", False),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_share(text, want):
    assert (spam_pages.stuffed_share(text) > 0.5) is want


def test_spam_pages(spark):
    rows = [(i, t, 0.5) for i, (t, _) in enumerate(CASES)]
    df = spark.createDataFrame([*rows, rows[0], (None, CASES[0][0], 0.1)], "doc_id bigint, text string, stuffed double")
    got = sorted(r.doc_id for r in spam_pages.spam_pages(df, "doc_id", "text").collect())
    assert got == [i for i, (_, w) in enumerate(CASES) if w]
    assert spam_pages.spam_pages(df.limit(0), "doc_id", "text").collect() == []


def test_ratios_are_those_of_the_collection(spark):
    odd = "Zyx qwv kjh gfd. " * 60  # prose of this collection repeats itself
    df = spark.createDataFrame([(i, odd, "EN ") for i in range(40)] + [(100, PROSE * 4, "de"), (101, None, None)], "doc_id bigint, text string, lang string")
    p = spam_pages.prose_ratios(df.where("text is not null"), "text", "lang")
    assert p.known["other", "en"][3] < 0.2 < p.known["other", "de"][0] and p.known["han", ""] == list(spam_pages.USUAL["han"])
    assert abs(p.redundancy(odd[:512], "en") - 1) < 0.1 and spam_pages.Prose().redundancy(odd[:512], "en") < 0.2
    assert p.redundancy("short") == 1
