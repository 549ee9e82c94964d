"""Line-item preprocessing and basic features.

Two passes over the data at most: one global aggregate (medians and the size
threshold, one row, broadcast back) and one projection. Absent columns are legal:
every step is skipped when its input column is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matforge.config import CATEGORICAL_COLUMNS, CURRENCY_COLUMNS, DATE_COLUMNS, QUANTITY_COLUMNS, PlanConfig
from matforge.functions.cleaning import (calendar_features, clean_currency, clean_text, col_or_null, day_diff,
                                         is_numeric_type, parse_timestamp, safe_ratio, safe_to_numeric, to_numeric)
from matforge.operators.stats import project_frequency, quantile_row
from matforge.session import written


def clean_columns(df: DataFrame) -> DataFrame:
    """``*_clean`` numbers, ``*_dt`` dates, calendar and derived features."""
    new = {}
    for c in CURRENCY_COLUMNS:
        if c in df.columns:
            new[f"{c}_clean"] = clean_currency(F.col(c), is_numeric_type(df, c))
    for c in QUANTITY_COLUMNS:
        if c in df.columns:
            new[f"{c}_clean"] = safe_to_numeric(F.col(c), is_numeric_type(df, c))
    for c in DATE_COLUMNS:
        if c in df.columns:
            new[f"{c}_dt"] = parse_timestamp(F.col(c))
    df = df.withColumns(new)
    new = {}
    if "invoiceDate_dt" in df.columns:
        new.update(calendar_features(F.col("invoiceDate_dt"), "invoiceDate"))
    if {"CONSTRUCTION_START_DATE_dt", "SUBSTANTIAL_COMPLETION_DATE_dt"} <= set(df.columns):
        new["project_duration_days"] = day_diff(F.col("SUBSTANTIAL_COMPLETION_DATE_dt"), F.col("CONSTRUCTION_START_DATE_dt"))
    if {"invoiceDate_dt", "CONSTRUCTION_START_DATE_dt"} <= set(df.columns):
        new["project_age_days"] = day_diff(F.col("invoiceDate_dt"), F.col("CONSTRUCTION_START_DATE_dt"))
    if {"SIZE_BUILDINGSIZE_clean", "NUMFLOORS_clean"} <= set(df.columns):
        new["size_per_floor"] = safe_ratio(F.col("SIZE_BUILDINGSIZE_clean"), F.col("NUMFLOORS_clean"))
    if {"ExtendedPrice_clean", "ExtendedQuantity_clean"} <= set(df.columns):
        per = safe_ratio(F.col("ExtendedPrice_clean"), F.col("ExtendedQuantity_clean"))
        if "QtyShipped_clean" in df.columns:
            per = F.coalesce(per, safe_ratio(F.col("ExtendedPrice_clean"), F.col("QtyShipped_clean")))
        new["material_cost_per_unit"] = per
    new["ItemDescription_clean"] = clean_text(col_or_null(df, "ItemDescription"))
    return df.withColumns(new)


def preprocess(df: DataFrame, cfg: PlanConfig = PlanConfig(), drop: tuple[str, ...] = ()) -> DataFrame:
    """C1-C12 + A6 + A7: clean, derive, flag large projects, impute ``*_clean`` medians.

    The rows are cleaned once and written, without the raw columns ``drop``: all that follows reads numbers. The 75th percentile
    and every median come from ONE distributed exact quantile pass over them (computed before imputation, as the reference does),
    joined back as a single row.
    """
    df = written(clean_columns(df).drop(*drop), "cleaned-lines")
    num_clean = [c for c in df.columns if c.endswith("_clean") and is_numeric_type(df, c)]
    specs = [(f"_med_{i}", F.col(c), 0.5) for i, c in enumerate(num_clean)]
    has_size = "SIZE_BUILDINGSIZE_clean" in df.columns
    if has_size:
        specs.append(("_p75", F.col("SIZE_BUILDINGSIZE_clean"), 0.75))
    if not specs:
        return df
    stats_row = written(quantile_row(df, specs), "medians")  # one row, made once for all that is derived from the result
    out = df.crossJoin(F.broadcast(stats_row))  # one row
    if has_size:
        out = out.withColumn("is_large_project",
                             F.coalesce((F.col("SIZE_BUILDINGSIZE_clean") > F.col("_p75")).cast("int"), F.lit(0)))
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_med_{i}")) for i, c in enumerate(num_clean)})
    return out.drop(*[f"_med_{i}" for i in range(len(num_clean))], *(["_p75"] if has_size else []))


def basic_features(df: DataFrame, frequency: bool = True) -> DataFrame:
    """C13 + A8: categoricals (null -> 'missing'), numeric size (unparsable -> 0), project frequency (not if it is left to the caller)."""
    cols = {c: F.coalesce(col_or_null(df, c).cast("string"), F.lit("missing")) for c in CATEGORICAL_COLUMNS}
    size = to_numeric(col_or_null(df, "SIZE_BUILDINGSIZE"), is_numeric_type(df, "SIZE_BUILDINGSIZE"))
    cols["SIZE_BUILDINGSIZE_num"] = F.coalesce(size, F.lit(0.0))
    out = df.withColumns(cols)
    if not frequency:
        return out
    if "PROJECTNUMBER" in df.columns:
        out = project_frequency(out)
    else:
        out = out.withColumn("PROJECT_FREQ", F.lit(0).cast("bigint"))
    return out


def drop_unlabelled(df: DataFrame, label: str = "MasterItemNo") -> DataFrame:
    """C14: rows with a label only; the label trimmed into ``label_raw``."""
    return df.where(F.col(label).isNotNull()).withColumn("label_raw", F.trim(F.col(label).cast("string")))
