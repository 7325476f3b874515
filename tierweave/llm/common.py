"""Helpers shared by the training-data operators: shared storage, lineage cuts, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierweave.llm.storage import system


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only on a single machine, and where the session sets none, is a temporary one chosen.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tierweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Folders that this driver has written tables to; whoever has written out a result calls ``release``.
WRITTEN: list[str] = []


def cut(df: DataFrame, label: str = "cut", **options) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, with the writer's ``options``, and read it back.

    Later stages read the table, so a lost executor costs its own tasks only, and the
    plan above is computed once however often the result is used. The table stays until ``release``, for a result is read only when it is used.
    """
    return _stored(df, label, **options)[0]


def _stored(df: DataFrame, label: str, **options) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.options(**options).parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(path: str) -> None:
    """Delete a table that nothing reads any more."""
    filesystem, own = system(path)
    if filesystem.get_file_info(own).type.name == "Directory":
        filesystem.delete_dir(own)
    if path in WRITTEN:
        WRITTEN.remove(path)


def release() -> int:
    """Delete all intermediate tables of this driver, once results that rest on them are written; returns their number."""
    paths = list(WRITTEN)
    for path in paths:
        drop(path)
    return len(paths)


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large and small stars.

    Returns ``node, component`` (the smallest node) for every node with an edge to another
    node. Self loops, repeated edges and nulls are ignored. Every round is written to the
    shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    pair = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, path = _stored(pair.distinct(), label)
    before = None

    def next_(rows: DataFrame, old: str) -> tuple[DataFrame, str]:
        """The next round's table; the one before it is done with."""
        out = _stored(rows, label)
        drop(old)
        return out

    while True:
        n, h = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, h) == before or n == 0:
            break
        before = (n, h)
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        now, path = next_(large, path)
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        small = now.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v"))
        now, path = next_(small.where("u <> v").distinct(), path)
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
