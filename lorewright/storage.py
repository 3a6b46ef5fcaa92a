"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where it is unset on one machine (``local`` master) a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lorewright-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def write_stage(df: DataFrame, name: str = "stage") -> str:
    """Write df as a Parquet table in the shared folder and return its path. Executor loss after this costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").option("compression", "zstd").parquet(path)
    if not _made:
        atexit.register(drop_stages)
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """df, computed once and read back from the shared folder."""
    return df.sparkSession.read.schema(df.schema).parquet(write_stage(df, name))


def drop_stage(spark: SparkSession, path: str) -> None:
    """Remove a table of write_stage that no later plan reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made[:] = [x for x in _made if x[1] != path]


def drop_stages() -> None:
    """Remove what is left of this process's tables."""
    for spark, path in list(_made):
        try:
            drop_stage(spark, path)
        except Exception:  # the session may be gone
            pass
    _made.clear()
