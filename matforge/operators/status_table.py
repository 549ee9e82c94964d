"""R4 as a table: the latest status of every request, kept on storage and updated by deltas of the change log.

The table is Parquet in ``buckets`` folders by hash of the id. A delta reads and rewrites the buckets that its ids fall into, and no
others, by dynamic partition overwrite; a rewritten bucket is one compact set of files, so no small files pile up. The latest change
of an id wins whatever order deltas come in, so a delta that is applied again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matforge.session import path_exists, written

BUCKETS = 64
SCHEMA = "id bigint, status string, ts timestamp_ntz, seq bigint, bucket int"


def read_status_table(spark: SparkSession, root: str) -> DataFrame:
    """(id, status, ts, seq, bucket); empty if nothing was applied yet."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(root)


def apply_delta(spark: SparkSession, delta: DataFrame, root: str, buckets: int = BUCKETS) -> list[int]:
    """Merge changes (id, ts, seq, status) into the table below ``root``; returns the buckets that were rewritten.

    Changes without an id are left out. The number of buckets must stay what it was when the table was made.
    """
    own = delta.where("id IS NOT NULL").select("id", F.struct("ts", "seq", "status").alias("change")).groupBy("id").agg(F.max("change").alias("change"))
    own = written(own.select("id", "change.*", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket")), "status-delta")
    touched = sorted(r[0] for r in own.select("bucket").distinct().collect())  # at most ``buckets``
    if not touched:
        return []
    old = read_status_table(spark, root).where(F.col("bucket").isin(touched))  # prunes the other folders
    rows = old.select("id", "ts", "seq", "status", "bucket").unionByName(own.select("id", "ts", "seq", "status", "bucket"))
    new = rows.groupBy("bucket", "id").agg(F.max(F.struct("ts", "seq", "status")).alias("c")).select("id", "c.status", "c.ts", "c.seq", "bucket")
    # Written aside first: a failure half-way leaves the old buckets whole.
    written(new, "status-merged").repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(root)
    return touched
