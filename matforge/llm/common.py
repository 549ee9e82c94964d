"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matforge.session import scratch_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that only Spark opens."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder of ``spark.checkpoint.dir`` and read them again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_remainder(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; -1 for a null id, so that it belongs to no fold."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % mod, F.lit(-1)).cast("int")


def partitions_for(rows: int, per_task: int) -> int:
    """As many partitions as give each at most about ``per_task`` rows."""
    return max(1, -(-rows // per_task))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: two long columns a, b (any order, repeats allowed, a = b ignored). Returns (node, root), one row for each
    node that has an edge, root being the smallest node reachable. Every round is an aggregate and a join on node, is
    written to the shared folder, and only its row count and checksum reach the driver; the number of edges never
    grows, so a group of any size costs rounds logarithmic in it and no pair list.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    cur = edges.where(F.col("a") != F.col("b")).select(hi.alias("a"), lo.alias("b")).distinct()
    cur, mark = written(cur, f"{name}-edges"), None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).select(hi.alias("a"), lo.alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        cur = written(small.where(F.col("a") != F.col("b")).distinct(), f"{name}-star")
        now = cur.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            break
        mark = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
