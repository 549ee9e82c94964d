"""File sources (S1, S2, S6, S7, S8): line items, tasks, predictions.

Raw line-item fields carry currency signs, separators and units, so every field is read
as text (no schema inference pass over the data) and typed later by the cleaning
expressions. Columns absent from a file are added as typed nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matforge.config import LINE_ITEM_COLUMNS
from matforge.session import path_exists


def csv_reader(spark: SparkSession, multi_line: bool = True):
    """Header CSV as other programs write it: quotes doubled inside quotes, line ends allowed there.

    A file whose quoted fields may hold line ends cannot be split, so give large feeds as many files (or Parquet), or say
    ``multi_line=False`` where no field has one.
    """
    return spark.read.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"').option("multiLine", multi_line)


def _strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def read_line_items(spark: SparkSession, path: str, fmt: str = "csv", columns: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """Header CSV (or Parquet) of line items, every known column present, raw fields as text.

    ``columns`` selects a subset (S2): Catalogue's column pruning reaches the scan.
    """
    if fmt == "csv":
        df = csv_reader(spark, multi_line).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    df = _strip_headers(df)
    want = list(columns) if columns else list(LINE_ITEM_COLUMNS)
    out = []
    for c in want:
        if c == "id":
            out.append((F.col(c).try_cast("bigint") if c in df.columns else F.lit(None).cast("bigint")).alias(c))
        else:
            out.append((F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c))
    extra = [F.col(c) for c in df.columns if c not in want] if not columns else []
    return df.select(*out, *extra)


def read_tasks(spark: SparkSession, path: str | None, required: bool = False) -> DataFrame:
    """Procurement task table with trimmed headers; absent -> empty 4-column table (or error)."""
    if path and path_exists(spark, path):
        return _strip_headers(csv_reader(spark).csv(path))
    if required:
        raise FileNotFoundError(f"no task table at {path}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in
                           ("MasterItemNo", "ItemDescription", "QtyShipped", "needed_by_date")])
    return spark.createDataFrame([], schema)


def read_plan_items(spark: SparkSession, predictions_path: str | None, tasks_path: str | None) -> DataFrame:
    """Predictions if they are there, else the task table; ``Qty`` renamed to ``QtyShipped``. A file that is there but
    cannot be read is an error, not a reason to take the other."""
    for p in (predictions_path, tasks_path):
        if p and path_exists(spark, p):
            df = _strip_headers(csv_reader(spark).csv(p))
            return df.withColumnRenamed("Qty", "QtyShipped") if "QtyShipped" not in df.columns else df
    raise FileNotFoundError(f"neither source is there: {predictions_path}, {tasks_path}")


def validate_predictions(df: DataFrame, required=("id", "MasterItemNo", "QtyShipped")) -> DataFrame:
    """Non-empty with the required columns, else a clear error (one-row probe, not a count)."""
    missing = [c for c in required if c not in df.columns]
    if missing or not df.limit(1).take(1):
        raise ValueError(f"predictions must have columns {list(required)} and contain rows; "
                         f"found columns {df.columns}")
    return df
