import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright.functions import providers, text
from lorewright.operators import builders, graph
from lorewright.plans import stages
from lorewright.sources import files


class Noting:
    """Answers and notes each prompt in a file; fails once so many were asked."""

    def __init__(self, log, most):
        self.log, self.most = log, most

    def __call__(self, prompts):
        with open(self.log, "a+") as f:
            f.seek(0)
            if self.most is not None and len(f.read().splitlines()) + len(prompts) > self.most:
                raise SystemExit("out of budget")
            f.writelines(p.replace("\n", " ") + "\n" for p in prompts)
        return ["fine" for _ in prompts]


def test_a_broken_run_loses_one_batch_only(spark, tmp_path):
    d = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "k bigint, chunk string")
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    with pytest.raises(Exception):
        stages.run("clean", d, "k", out, make=lambda: Noting(log, 25), every=8)
    kept = spark.read.parquet(out).count()
    asked = len(open(log).read().splitlines())
    assert 0 < kept < 40 and asked - kept <= 16  # what was asked and isn't kept belongs to the batch that broke
    whole = stages.run("clean", d, "k", out, make=lambda: Noting(log, None), every=8)
    assert whole.count() == whole.select("k").distinct().count() == 40
    assert len(open(log).read().splitlines()) - asked == 40 - kept  # only the rest is asked
    assert stages.run("clean", d, "k", out, make=lambda: Noting(log, 0), every=8).count() == 40


def test_retrying_asks_alone_skips_and_validates():
    calls = []

    def provider(prompts):
        calls.append(list(prompts))
        if "bad" in prompts:
            raise ValueError("content policy")
        if "flaky" in prompts and sum("flaky" in c for c in calls) < 4:
            raise ValueError("timeout")
        return ["" if p == "blank" else p.upper() for p in prompts]

    r = providers.Retrying(provider, attempts=4, valid=lambda p, o: o != "", skip="policy")
    assert r(["a", "bad", "flaky", "blank"]) == ["A", None, "FLAKY", None]
    assert sum(c == ["bad"] for c in calls) == 1 and sum("a" in c for c in calls) == 2


def test_every_stage_runs(spark):
    d = spark.createDataFrame([(1, "x"), (2, None)], "k int, t string")
    for name, s in stages.STAGES.items():
        out = "<reason>r</reason><judge>True</judge> reasoning: r\nscore: 3 {{\"summary\": \"s\", \"faq\": [], \"valid_document\": true}}"
        got = stages.run(name, d, "k", make=lambda o=out: providers.Stub(o), **{n: F.col("t") for n in s.inputs}).collect()
        assert len(got) == 2 and all(r.output and r.parsed is not None for r in got), name
        assert "[[" not in spark.range(1).select(s.prompt(**{n: F.lit("v") for n in s.inputs}).alias("p")).first().p


def test_http_provider():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"choices": [{"message": {"content": said["messages"][0]["content"][::-1] + said["model"]}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert providers.Http(f"http://127.0.0.1:{server.server_port}/", "m", threads=2)(["ab", "cd", "e"]) == ["bam", "dcm", "em"]
    finally:
        server.shutdown()


def test_files_in_and_out(spark, tmp_path):
    d = spark.createDataFrame([(2, "b", None), (1, "ä", [1])], "k int, t string, a array<int>")
    files.write_json_document(d, str(tmp_path / "doc"), ["k"])
    got = "".join(open(p).read() for p in (tmp_path / "doc").glob("part-*"))
    import json

    assert json.loads(got) == [{"a": [1], "k": 1, "t": "ä"}, {"a": None, "k": 2, "t": "b"}] and "ä" in got and '    "a"' in got
    files.write_json_document(d.limit(0), str(tmp_path / "none"), ["k"])
    assert json.loads("".join(open(p).read() for p in (tmp_path / "none").glob("part-*"))) == []
    (tmp_path / "v").mkdir()
    np.save(tmp_path / "v" / "a.npy", np.arange(6.0).reshape(3, 2))
    assert [(r.row, r.vector) for r in files.read_npy(spark, str(tmp_path / "v")).orderBy("row").collect()] == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5])]
    (tmp_path / "v" / "deep").mkdir()
    (tmp_path / "v" / "deep" / "x.bin").write_bytes(b"\x00\x01")
    copied = files.copy_files(spark, str(tmp_path / "v"), str(tmp_path / "w")).collect()
    assert len(copied) == 2 and (tmp_path / "w" / "deep" / "x.bin").read_bytes() == b"\x00\x01"


def test_similar_entities_of_a_hot_group(spark):
    x = np.random.default_rng(0).standard_normal((2600, 3))
    df = spark.createDataFrame([(i, v.tolist(), "hot" if i < 2500 else None if i > 2590 else "cold") for i, v in enumerate(x)], "id bigint, v array<double>, g string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for a, z in ((0, 2500), (2500, 2591)) for i, j in zip(*np.nonzero(np.triu(u[a:z] @ u[a:z].T, 1) >= 0.9999))}
    got = {(r.left_id % 2500, r.right_id % 2500) for r in graph.similar_entities(df, "id", "v", F.col("g"), 0.9999).collect()}
    assert got == want and want
    assert graph.similar_entities(df.limit(0), "id", "v", F.col("g"), 0.9).collect() == []


def test_an_invalid_lot_is_asked_again(spark):
    g = spark.createDataFrame([("a", i, "t") for i in range(4)] + [("b", i, "t") for i in range(10, 14)], "group string, member bigint, text string")
    asked = []

    def resolver(lots):
        rows = lots.collect()
        asked.append({r.group for r in rows})
        out = [(r.member, 0 if r.group == "a" else 99 if len(asked) < 3 else 10) for r in rows if r.member not in (0, 10)]
        return spark.createDataFrame(out, "member bigint, into bigint")

    got = {r.member: r.canonical for r in graph.resolve_groups(g, resolver, max_merges=1, idle=1).collect()}
    assert asked[:3] == [{"a", "b"}, {"b"}, {"b"}] and set(got.values()) == {0, 10}


def test_id_check_and_tasks_and_reorderings(spark):
    a = spark.createDataFrame([("g", 1), ("g", 2), ("h", 3)], "g string, m int")
    b = spark.createDataFrame([("g", 2), ("g", 7), ("h", 3)], "g string, m int")
    assert {tuple(r) for r in graph.id_check(a, b, "g", "m").collect()} == {("g", 1, 1), ("h", 0, 0)}
    t = spark.createDataFrame([(1, "x", None, 3), (2, "y", "z", None)], "k int, `m-answer` string, answer string, `m-answer-score` int")
    done = spark.createDataFrame([(1, "m-answer")], "k int, name string")
    assert {tuple(r) for r in builders.relevance_tasks(t, ["k"], done).collect()} == {(2, "m-answer", "y"), (2, "answer", "z")}
    assert builders.relevance_tasks(t.select("k"), ["k"], done).collect() == []


def test_bpe_tokens_are_a_partition(spark):
    ranks = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    cut = text.bpe_tokens(ranks, pattern)
    rows = ["Hello world, hello!", "汉字 𝔘 é\n\nend", "", None]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", cut("t").alias("x"), text.token_count(F.col("t"), cut).alias("n"), text.truncate(F.col("t"), 2, cut).alias("two")).collect()
    assert ["".join(r.x) if r.x is not None else None for r in got] == rows and got[0].n == 5 and got[0].two == "Hello world"
    from lorewright.operators import chunks

    c = chunks.token_chunks(spark.createDataFrame([(rows[0] * 40, "p")], "text string, path string"), "text", "path", 20, 5, cut).orderBy("chunk_no").collect()
    assert len(c) > 5 and all((rows[0] * 40)[r.start_char_pos : r.end_char_pos] == r.chunk for r in c)
