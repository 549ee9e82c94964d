"""Scoring of predictions (J1, M12-M14): accuracy, macro F1, MAE-based score.

All metrics are aggregates over the joined pairs; per-label F1 is one extra group-by
over labels (bounded by the label count), never a driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matforge.config import SCORE_WEIGHTS


def join_truth_prediction(truth: DataFrame, pred: DataFrame, key: str = "id") -> DataFrame:
    """Inner join on id, value columns suffixed ``_true`` / ``_pred``."""
    t = truth.select(F.col(key), *[F.col(c).alias(f"{c}_true") for c in truth.columns if c != key])
    p = pred.select(F.col(key), *[F.col(c).alias(f"{c}_pred") for c in pred.columns if c != key])
    return t.join(p, key, "inner")


def per_label_f1(pairs: DataFrame, t: str = "MasterItemNo_true", p: str = "MasterItemNo_pred") -> DataFrame:
    """M13 detail: tp / fp / fn and F1 for every label seen as truth or prediction."""
    tt = F.col(t).cast("string")
    pp = F.col(p).cast("string")
    hits = pairs.select(F.explode(F.array(
        F.struct(tt.alias("label"), (tt == pp).cast("int").alias("tp"), F.lit(0).alias("fp"), (tt != pp).cast("int").alias("fn")),
        F.struct(pp.alias("label"), F.lit(0).alias("tp"), (tt != pp).cast("int").alias("fp"), F.lit(0).alias("fn")),
    )).alias("h")).select("h.*")
    agg = hits.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return agg.withColumn("f1", F.when(den > 0, 2 * F.col("tp") / den).otherwise(F.lit(0.0)))


def scores(pairs: DataFrame, t_item: str = "MasterItemNo_true", p_item: str = "MasterItemNo_pred",
           t_qty: str = "QtyShipped_true", p_qty: str = "QtyShipped_pred") -> DataFrame:
    """One row with accuracy, macro F1, MAE, range-normalised score and the final blend."""
    wa, wf, wr = SCORE_WEIGHTS
    base = pairs.agg(
        F.avg((F.col(t_item).cast("string") == F.col(p_item).cast("string")).cast("double")).alias("accuracy"),
        F.avg(F.abs(F.col(t_qty).cast("double") - F.col(p_qty).cast("double"))).alias("mae"),
        (F.max(t_qty) - F.min(t_qty)).cast("double").alias("_range"))
    f1 = per_label_f1(pairs, t_item, p_item).agg(F.avg("f1").alias("f1_macro"))
    out = base.crossJoin(f1)  # both one row
    norm = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("mae") / F.col("_range")))
    reg = F.when(F.col("_range").isNull() | (F.col("_range") == 0), F.lit(1.0)).otherwise(1.0 - norm)
    out = out.withColumn("reg_score", reg)
    out = out.withColumn("final_score", wa * F.col("accuracy") + wf * F.col("f1_macro") + wr * F.col("reg_score"))
    return out.select("accuracy", "f1_macro", "mae", "reg_score", "final_score")
