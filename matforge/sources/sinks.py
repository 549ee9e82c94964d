"""Sinks (S9): tables written with a fixed column order and types.

Writers overwrite a whole directory in one job (Spark's commit protocol makes the output
appear atomically per job), so a re-run after an executor loss never leaves half a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matforge.session import scratch_path


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, fmt: str = "parquet",
                partition_by: list[str] | None = None) -> str:
    out = df.select(*columns) if columns else df
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_line_files(lines: DataFrame, path: str, head: str, size: int = 1000) -> str:
    """Lines of text as many files of at most ``size`` lines below the line ``head``, packed by gzip.

    A task makes files of its own lines as they come, so no line is moved or sorted for it and no task holds more than a file and a batch.
    """
    def files(batches):
        import pyarrow as pa

        one = lambda part: pa.RecordBatch.from_pydict({"value": ["\n".join([head, *part])]})
        held = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            full = len(held) - len(held) % size
            for at in range(0, full, size):
                yield one(held[at:at + size])
            held = held[full:]
        if held:
            yield one(held)

    lines.mapInArrow(files, "value string").write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)
    return path


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """The rows as a table bucketed and sorted by ``key`` in the shared folder, one file a bucket.

    Tables with one number of buckets join on the key without moving either; anything else that joins them is moved once. The name is
    made unique, as the catalogue is the session's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"{name}_{path.rsplit('-', 1)[-1]}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def read_back(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A table that ``write_table`` wrote, with the columns and types of ``schema``. CSV is read as text and cast; an empty field is null, a quoted
    empty one an empty text."""
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(path)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    empty = "\u0001"  # the reader takes an empty text for null unless it has a value of its own
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("emptyValue", empty).schema(text).csv(path)
    own = lambda f: F.when(F.col(f"`{f.name}`") == empty, F.lit("")).otherwise(F.col(f"`{f.name}`"))
    return df.select(*(own(f).cast(f.dataType).alias(f.name) for f in schema))


def round_trip(df: DataFrame, path: str, fmt: str = "csv") -> DataFrame:
    """The rows of a table after it was written and read again."""
    write_table(df, path, fmt=fmt)
    return read_back(df.sparkSession, path, df.schema, fmt)
