"""Spark session helpers and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "matforge", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session with AQE on, UI off and a UTC clock (dates never shift).

    ``master`` and ``shuffle_partitions`` are set only when given (or named by MATFORGE_MASTER and
    MATFORGE_SHUFFLE_PARTITIONS), so that ``spark-submit`` and the cluster's defaults decide otherwise.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master := master or os.environ.get("MATFORGE_MASTER"):
        b = b.master(master)
    if parts := shuffle_partitions or os.environ.get("MATFORGE_SHUFFLE_PARTITIONS"):
        b = b.config("spark.sql.shuffle.partitions", str(parts))
    if memory := os.environ.get("MATFORGE_DRIVER_MEMORY"):
        b = b.config("spark.driver.memory", memory)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    On a cluster it must be configured: a machine-local folder would differ on every node, so a missing setting
    raises. A local master has one machine only, and gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="matforge-", dir=os.environ.get("MATFORGE_SCRATCH"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir() or shared


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)  # the texts of a scratch table take less room than by the default
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_in_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``written``, in buckets of ``key``, as many as there are shuffle partitions: what is joined by the key meets the rows where they lie."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = "scratch_" + path.rsplit("/", 1)[-1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(table)
    return spark.table(table)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads; an error of the storage stays an error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
