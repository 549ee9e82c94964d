"""Category codes (J7): values of categorical columns as dense integers, learned on one table and applied to others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matforge.operators.scan import sequential_ids
from matforge.session import written

# Fixed value: what a missing category counts as.
MISSING = "__MISSING__"


def fit_category_codes(train: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, code): the distinct values of each column, null as ``__MISSING__``, numbered from 0 in order.

    One distinct over all columns (combined map-side) and one numbering; a column's first number comes from an aggregate with one row
    per column.
    """
    held = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("value")) for c in cols))
    values = train.select(F.explode(held).alias("x")).select("x.*").distinct()
    numbered = sequential_ids(values, ["column", "value"], name="at", start=0)
    first = numbered.groupBy("column").agg(F.min("at").alias("first"))  # one row per column
    # Written, so that the joins know its size: Spark takes a join for as large as the product of its sides.
    return written(numbered.join(F.broadcast(first), "column").select("column", "value", (F.col("at") - F.col("first")).alias("code")), "category-codes")


def apply_category_codes(df: DataFrame, codes: DataFrame, cols: list[str], suffix: str = "_code") -> DataFrame:
    """A column ``<name><suffix>`` (double) for each of ``cols``; a value that was not seen gets the number of known values."""
    sizes = codes.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    one = sizes.agg(*(F.coalesce(F.max(F.when(F.col("column") == c, F.col("n"))), F.lit(0)).alias(f"_n_{c}") for c in cols))  # one row
    out = df.crossJoin(F.broadcast(one))
    for c in cols:
        own = codes.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        out = out.join(own, F.coalesce(out[c].cast("string"), F.lit(MISSING)) == own[f"_v_{c}"], "left")
        out = out.withColumn(c + suffix, F.coalesce(F.col(f"_c_{c}"), F.col(f"_n_{c}")).cast("double")).drop(f"_v_{c}", f"_c_{c}", f"_n_{c}")
    return out
