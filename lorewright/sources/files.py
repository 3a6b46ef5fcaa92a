"""File sources and sinks, incremental work, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_texts(spark: SparkSession, root: str, pattern: str = "*.md", without: str | None = "valid_document_index") -> DataFrame:
    """(path, text): whole files under root, found recursively; names holding ``without`` are left out."""
    d = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    d = d.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return d.where(~F.col("path").contains(without)) if without else d


def read_binary(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of files that need a converter."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length", "content")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of files that hold a JSON array (or one object) each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_object(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(file, key, value) of files that hold one JSON object keyed by id."""
    d = spark.read.format("text").option("wholetext", True).load(path)
    return d.select(F.col("_metadata.file_path").alias("file"), F.explode(F.from_json("value", f"map<string, {value_schema}>")).alias("key", "value"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object per line, UTF-8 unescaped."""
    df.write.mode(mode).json(path)


def write_text(df: DataFrame, line: Column, path: str, mode: str = "overwrite") -> None:
    df.select(line.alias("value")).write.mode(mode).text(path)


def write_json_document(df: DataFrame, path: str, order: list[str], indent: int = 4) -> None:
    """All rows as one pretty-printed JSON array, sorted, in a single file: for reports, whose rows are few. The rows are
    formatted in the tasks that hold them, and written as a stream by one task."""
    import json

    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(json.loads(x), ensure_ascii=False, indent=indent, sort_keys=True) for x in b.column(0).to_pylist()], pa.string())], names=["value"])

    rows = df.orderBy(*order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).mapInArrow(run, "value string")
    n = rows.coalesce(1).withColumn("i", F.monotonically_increasing_id())
    last = df.count() - 1
    if last < 0:
        df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    n.select(F.concat(F.when(F.col("i") == 0, "[\n").otherwise(""), "value", F.when(F.col("i") == last, "\n]").otherwise(","))).write.mode("overwrite").text(path)


def read_npy(spark: SparkSession, root: str, pattern: str = "*.npy") -> DataFrame:
    """(path, row, vector): the rows of NumPy matrices, whole files each read by one task."""
    import io

    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False)).astype(np.float32)
                for s in range(0, len(x), 4096):
                    part = x[s : s + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(part)), pa.array(np.arange(s, s + len(part))), pa.array(list(part), pa.list_(pa.float32()))], names=["path", "row", "vector"])

    return read_binary(spark, root, pattern).select("path", "content").mapInArrow(run, "path string, row bigint, vector array<float>")


def write_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vectors as Parquet, each with its key; the place of a row means nothing."""
    df.write.mode(mode).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def remaining(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df that are not in ``done``: what an interrupted run still has to do."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def resume_append(df: DataFrame, path: str, keys: list[str], every: int | None = None, work=None) -> DataFrame:
    """Append ``work`` of the rows of df whose keys the table at path lacks, and return the whole table. With ``every``, the
    rows are dealt by their keys to batches of about that many, each a job with a commit of its own: a run that breaks off
    loses no more than the batch it was at, and the next one takes up the rest. work: rows to rows, with the keys; none keeps
    them as they are."""
    from lorewright.storage import materialize

    spark, work = df.sparkSession, work or (lambda d: d)
    schema = work(df).schema
    todo = remaining(df, spark.read.schema(schema).parquet(path), keys) if _exists(spark, path) else df
    if every is None:
        work(todo).write.mode("append").parquet(path)
    else:
        todo = materialize(todo, "todo")
        n = max(1, -(-todo.count() // every))
        for i in range(n):
            work(todo.where(F.pmod(F.xxhash64(*keys), F.lit(n)) == i)).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def publish(documents: DataFrame, summaries: DataFrame, path: str, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(documents with their summary that are to be published, paths that are left out): each document is joined with the
    summary of its path; those without one, or whose summary is not ``ok``, are left out."""
    d = documents.join(summaries, path, "left")
    kept = F.coalesce(ok, F.lit(False))
    return d.where(kept), d.where(~kept).select(path)


def faq_text(title: Column, summary: Column, faq: Column) -> Column:
    """Title, summary and the numbered questions with their answers, as one text."""
    items = F.transform(faq, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["question"], F.lit("\n"), x["answer"]))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce(title, F.lit(""))), summary, F.nullif(F.array_join(items, "\n"), F.lit("")))


def copy_files(spark: SparkSession, root: str, to: str, pattern: str = "*") -> DataFrame:
    """(path, target): files under root copied byte for byte to the same place under ``to``, each by the task that read it."""
    if "://" in to.removeprefix("file://"):
        raise ValueError("to must be a folder that every executor mounts")
    base, target = root.removeprefix("file://").rstrip("/"), to.removeprefix("file://").rstrip("/")

    def run(batches):
        import os

        import pyarrow as pa

        for b in batches:
            done = []
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = target + p.split(base, 1)[1]
                os.makedirs(os.path.dirname(out), exist_ok=True)
                with open(f"{out}.part", "wb") as f:
                    f.write(content)
                os.replace(f"{out}.part", out)  # a repeated task writes the same file again
                done.append(out)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], names=["path", "target"])

    return read_binary(spark, root, pattern).select("path", "content").mapInArrow(run, "path string, target string")


def split_by(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that match, rows to be copied through)."""
    ok = F.coalesce(keep, F.lit(False))
    return df.where(ok), df.where(~ok)


def paired_path(path: Column, old: str, new: str) -> Column:
    """The file that belongs to another one by a change of one name component."""
    return F.regexp_replace(path, f"(^|/){old}(/|$)", f"$1{new}$2")


def _nodes(df: DataFrame, path: str) -> DataFrame:
    s = F.split(path, "/", -1)
    return df.withColumn("_s", s).withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("_s")))).withColumn("path", F.array_join(F.slice("_s", F.lit(1), F.col("depth")), "/"))


def tree(df: DataFrame, path: str) -> DataFrame:
    """(path, depth, line, is_file): all folders and files, the name indented by its depth."""
    n = _nodes(df.select(path).distinct(), path)
    name = F.element_at("_s", F.col("depth"))
    return n.select("path", "depth", F.concat(F.repeat(F.lit("    "), F.col("depth") - 1), name).alias("line"), (F.col("depth") == F.size("_s")).alias("is_file")).distinct()


def rollup(df: DataFrame, path: str) -> DataFrame:
    """(path, depth, files, chunks, chars) of every folder and file: children are summed into all folders above them in one
    aggregation instead of level by level."""
    return _nodes(df, path).groupBy("path", "depth").agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"), F.sum("chars").alias("chars"))


def fold_tree(df: DataFrame, path: str, value: str, reduce) -> DataFrame:
    """Bottom-up fold of a folder tree with a reducer that is no plain sum (a summary of summaries): level by level from the
    deepest, ``reduce`` gets the column of a folder's child values in path order. Returns (path, depth, value)."""
    from lorewright.storage import materialize

    leaves = df.select(F.col(path).alias("path"), F.size(F.split(path, "/", -1)).alias("depth"), F.col(value).alias("value")).where("value is not null")
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    done, now = leaves, leaves.where(F.col("depth") == deepest)
    for d in range(deepest, 1, -1):
        up = now.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "value"))), lambda x: x["value"]).alias("vs"))
        folders = materialize(up.select("path", F.lit(d - 1).alias("depth"), reduce(F.col("vs")).alias("value")), "level")
        done = done.unionByName(folders)
        now = leaves.where(F.col("depth") == d - 1).unionByName(folders)
    return done
