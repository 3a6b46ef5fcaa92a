import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lorewright.functions import providers
from lorewright.operators import tiers
from lorewright.plans import pipelines
from lorewright.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_stream_takes_each_document_once(spark, tmp_path):
    d = spark.createDataFrame([(i % 5, "w " * 20, f"p{i}", "2024-01-01 00:00:00") for i in range(10)], "doc_id bigint, text string, rel_path string, t string").withColumn("fetched_at", F.to_timestamp("t")).drop("t")
    d.write.parquet(str(tmp_path / "in"))
    s = ingest.chunk_stream(ingest.read_documents(spark, str(tmp_path / "in"), d.schema), size=10, overlap=0)
    for _ in range(2):
        q = ingest.append(s, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).groupBy("doc_id").agg(F.countDistinct("chunk_no").alias("n"), F.count("*").alias("m")).where("n <> m").count() == 0


def test_late_events(spark, tmp_path):
    rows = [("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("b", "2024-01-01 03:00:00")]
    d = spark.createDataFrame(rows, "event_type string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    d.write.parquet(str(tmp_path / "in"))
    s = ingest.windowed_counts(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")))
    q = ingest.append(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [(r.event_type, r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 2)]


def test_pipelines(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "rel_path", "text")
    c = pipelines.prepare_corpus(docs, [tiers.Rule(1, "random", 2)], 1).cache()
    assert c.count() > 0 and c.where("context is null").count() == 0
    k = c.select(F.monotonically_increasing_id().alias("k"), "origin_context")
    r = pipelines.retrieve(k.limit(3), k, "k", "origin_context", "k", "origin_context", 16)
    assert {x.doc_id for x in r.where("rank = 1").collect()} <= {x.k for x in k.collect()}
    out = str(tmp_path / "stage")
    d = spark.createDataFrame([(1, "x"), (2, "y")], "k int, t string")
    run = lambda n: pipelines.stage(d.limit(n), "k", F.col("t"), lambda o: F.length(o), out, providers.Stub)
    assert run(1).count() == 1 and run(2).count() == 2
    q = spark.createDataFrame([(1, "why", ["a", "b"]), (2, "what", ["a", "gone"])], "question_id int, question string, top_k_documents array<string>")
    g = pipelines.generate(q, spark.createDataFrame([("a", "A"), ("b", "B")], "id string, context string")).collect()
    assert [x.question_id for x in g] == [1] and g[0].prompt == "Documents:\n[Doc a] A\n[Doc b] B\nQuestion: why"


def test_entry_and_catalog(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["corpus_token_stats", "token_chunks", "tier_cumulative", "citation_rewrite", "metric_grid", "entity_merge", "preference_rows"])
def test_against_sql(spark, name):
    from verify import rows

    con = duckdb.connect()
    for t in "documents corpus chunk_vectors proposed_questions rephrased_questions preference_pairs entities entity_matches test_items events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())
