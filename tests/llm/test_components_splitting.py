import random

import numpy as np
import pytest

from lorewright.llm import wordhash as wh
from lorewright.llm import components, splitting


def union_find(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        up[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in up}


def test_components_chain_star_and_random(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(900 - i, 1000) for i in range(50)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)]
    edges += [(5, 5), (None, 3), (3, None), (7, 6), (6, 7), (7, 6)]
    df = spark.createDataFrame([(a, b, "x") for a, b in edges], "l bigint, r bigint, component string")
    got = {r.vertex: r.component for r in components.link_components(df, "l", "r").collect()}
    assert got == union_find([(a, b) for a, b in edges if a is not None and b is not None and a != b])


def test_components_of_nothing(spark):
    assert components.link_components(spark.createDataFrame([], "l bigint, r bigint"), "l", "r").collect() == []


def test_entity_groups_only_link_known_entities(spark):
    e = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None), (4, "d"), (None, "x")], "entity_id bigint, group_id string")
    m = spark.createDataFrame(
        [(1, 2, True), (2, 1, False), (3, 99, True), (99, 4, True), (3, 3, True), (4, None, True), (3, 4, None), (2, 3, False)],
        "left_entity_id bigint, right_entity_id bigint, is_same boolean",
    )
    assert {tuple(r) for r in components.linked_entities(e, m).select("group_id", "entity_id").collect()} == {(1, 1), (1, 2)}
    assert {tuple(r) for r in components.entity_groups(e, m).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}


@pytest.mark.parametrize(
    "text",
    [
        "word " * 3000,
        "x" * 9000,
        "x" * 4000 + " " + "y" * 4000,
        "x" * 4000 + "。" + "y" * 3999,
        "a. " + "x" * 4001 + " end",
        ("One sentence here. " * 30 + "\n\n") * 40,
        "汉字" * 1500 + "。" + "汉字" * 3000,
        "\n" * 5000,
        "𝔘" * 4100 + " é",
    ],
)
def test_pieces_cover_the_text(text):
    pieces = splitting.cut(wh.code_points(text))
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (s, e, _), nxt in zip(pieces, [*pieces[1:], None]):
        assert 0 < e - s <= 4000
        if nxt:
            assert s < nxt[0] <= e < nxt[1]


def test_overlap_and_strongest_cut():
    text = "".join(f"Sentence number {i} is here. " + ("\n\n" if i % 40 == 39 else "") for i in range(400))
    pieces = splitting.cut(wh.code_points(text))
    assert all(text[e - 2 : e] == "\n\n" for _, e, _ in pieces[:-1])
    assert all(100 <= e - s2 <= 300 for (_, e, _), (s2, _, _) in zip(pieces, pieces[1:]))
    assert not any(f for *_, f in pieces)


def test_forced_cuts_keep_the_overlap():
    assert splitting.cut(wh.code_points("x" * 10000)) == [(0, 4000, True), (3800, 7800, True), (7600, 10000, False)]
    for text in ("a b. " * 300 + "x" * 8000 + " c" * 50, "x" * 4100 + " " + "y" * 9000, "x" * 11700, "x" * 7900 + " end. " * 900):
        pieces = splitting.cut(wh.code_points(text))
        assert any(f for *_, f in pieces)
        for (_, e, forced), (s, _, _) in zip(pieces, pieces[1:]):
            assert not forced or 150 <= e - s <= 250
    # a run just under the limit after a boundary: less overlap, and the piece ends at the run's end
    assert not any(f for *_, f in splitting.cut(wh.code_points("x" * 4000 + " " + "y" * 4000)))
    pieces = splitting.cut(wh.code_points("w " * 2500 + "x" * 3990 + " " + "y " * 100))
    assert any(s < 5000 and e >= 8990 for s, e, _ in pieces) and not any(f for *_, f in pieces)
    assert all(0 < e - s <= 250 for (_, e, _), (s, _, _) in zip(pieces, pieces[1:]))


def test_range_max_against_brute_force():
    v = np.random.default_rng(0).integers(0, 50, 200)
    r = splitting.RangeMax(v)
    for a in range(0, 200, 7):
        for b in range(a + 1, 201, 5):
            assert r.query(a, b) == v[a:b].max()


def test_split_texts_nulls_repeats_and_kinds(spark):
    rows = [(1, "a " * 3000), (1, "a " * 3000), (2, "x" * 4001), (3, None), (4, ""), (5, "short"), (6, "x" * 4000 + " y"), (None, "b " * 3000)]
    df = spark.createDataFrame([(k, t, "z") for k, t in rows], "chunk_key bigint, t string, kind string")
    got = {(r[0], r[1]) for r in splitting.oversized(df, "chunk_key", "t").collect()}
    assert got == {(1, "natural"), (2, "forced"), (6, "natural"), (None, "natural")}
    p = splitting.split_texts(df, "chunk_key", "t").where("chunk_key = 2").orderBy("piece").collect()
    assert [r.cut_kind for r in p] == ["forced", "end"] and all(len(r.piece_text) <= 4000 for r in p)
    assert splitting.split_texts(df.limit(0), "chunk_key", "t").collect() == []
