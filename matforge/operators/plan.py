"""Procurement plan (V8-V11): one projection after two lookups.

Per-item lookups (description, vendor) are reduced to one row per item first; the plan
rows (one per prediction line) stream through joins whose small side AQE may broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matforge.config import (CYCLE_SINGLE, CYCLE_STAGED, CYCLE_TWO_STAGE, MITIGATION_IMPORT, MITIGATION_LONG_LEAD,
                             MITIGATION_NO_VENDOR, RISK_IMPORT, RISK_LONG_LEAD, RISK_NO_VENDOR, PlanConfig)
from matforge.functions.cleaning import canonical_item_key, col_or_null, empty_to_null, plan_qty
from matforge.operators.schedule import default_phase_row, known_phases, phase_expr
from matforge.operators.stats import mode_description, top_k_values
from matforge.operators.vendors import plan_policy

PLAN_COLUMNS = ("MasterItemNo", "ItemDescription", "PredictedQty", "SafetyStock", "RecommendedOrderQty", "Vendor",
                "VendorContact", "VendorLeadDays", "ProcurementStart", "ProcurementFinish", "NeededBy", "ProjectPhase",
                "ProcurementCycle", "RiskNotes", "Mitigations")


def plan_input(items: DataFrame) -> DataFrame:
    """Trimmed headers; ``Qty`` stands in for ``QtyShipped`` when that is absent."""
    items = items.toDF(*[c.strip() for c in items.columns])
    if "QtyShipped" not in items.columns and "Qty" in items.columns:
        items = items.withColumnRenamed("Qty", "QtyShipped")
    if "MasterItemNo" not in items.columns:
        raise ValueError(f"plan input needs a MasterItemNo column, found {items.columns}")  # S8
    return items


def order_cycle(order_qty, cfg: PlanConfig = PlanConfig()):
    """V9: staged above 1000, two-stage above 100, else a single order."""
    return (F.when(order_qty > cfg.staged_above, F.lit(CYCLE_STAGED))
            .when(order_qty > cfg.two_stage_above, F.lit(CYCLE_TWO_STAGE)).otherwise(F.lit(CYCLE_SINGLE)))


def _join_notes(*pairs):
    arr = F.array(*[F.when(cond, F.lit(text)) for cond, text in pairs])
    return F.concat_ws("; ", F.filter(arr, lambda x: x.isNotNull()))


def procurement_plan(items: DataFrame, schedule: DataFrame, vendors_flat: DataFrame, train: DataFrame | None = None,
                     cfg: PlanConfig = PlanConfig()) -> DataFrame:
    """One plan row per input line (quantity, phase, vendor, dates, safety stock, cycle, risks)."""
    items = plan_input(items)
    default = default_phase_row(schedule, cfg.default_phase)
    qty_src = col_or_null(items, "QtyShipped") if "QtyShipped" in items.columns else F.lit(1.0)
    base = items.select(col_or_null(items, "MasterItemNo").alias("MasterItemNo"),
                        canonical_item_key(F.col("MasterItemNo")).alias("item_key"),
                        plan_qty(qty_src, cfg.min_order_qty).alias("PredictedQty"),
                        col_or_null(items, "ItemDescription").cast("string").alias("_own_desc"),
                        col_or_null(items, "Item").cast("string").alias("_item_text"))
    if train is not None:  # J3: description from the line items (modal per item)
        base = base.join(mode_description(train).withColumnRenamed("ItemDescription", "_train_desc"), "item_key", "left")
    else:
        base = base.withColumn("_train_desc", F.lit(None).cast("string"))
    desc = F.coalesce(empty_to_null(F.col("_own_desc")), empty_to_null(F.col("_train_desc")),
                      empty_to_null(F.col("_item_text")), F.lit(""))
    base = base.withColumn("ItemDescription", desc)
    # Q4: a missing description takes the default phase (documented divergence)
    base = base.crossJoin(F.broadcast(default)).withColumn(
        "ProjectPhase", phase_expr(F.col("ItemDescription"), cfg.plan_keywords, F.col("_default"))).drop("_default")
    # First schedule row of the phase, else the latest finish
    phases = schedule.groupBy("Task").agg(F.min_by("Finish", "ord").alias("_pf")).withColumnRenamed("Task", "ProjectPhase")
    bounds = schedule.agg(F.min("Start").alias("_p0"), F.max("Finish").alias("_p1"))
    phases = known_phases(phases, default, cfg.plan_keywords, "ProjectPhase")
    j = base.join(F.broadcast(phases), "ProjectPhase", "left").crossJoin(F.broadcast(bounds))
    j = j.withColumn("NeededBy", F.coalesce("_pf", "_p1"))
    # J2 + V5
    j = j.join(plan_policy(vendors_flat, cfg.plan_default_lead), "item_key", "left")
    has = F.coalesce(F.col("_has_vendor"), F.lit(False))
    lead = F.when(has, F.col("VendorLeadDays")).otherwise(F.lit(cfg.plan_default_lead))
    j = j.withColumn("VendorLeadDays", lead.cast("int"))
    start = F.date_sub(F.col("NeededBy"), F.col("VendorLeadDays") + F.lit(cfg.buffer_days))
    safety = F.greatest(F.lit(1), F.ceil(F.col("PredictedQty").cast("double") * F.lit(float(cfg.safety_stock_pct))))
    j = (j.withColumn("ProcurementStart", F.greatest(start, F.col("_p0")))
          .withColumn("ProcurementFinish", F.col("NeededBy"))
          .withColumn("SafetyStock", safety.cast("bigint")))
    j = j.withColumn("RecommendedOrderQty", F.greatest(F.lit(cfg.min_order_qty).cast("bigint"),
                                                        F.col("PredictedQty") + F.col("SafetyStock")))
    j = j.withColumn("ProcurementCycle", order_cycle(F.col("RecommendedOrderQty"), cfg))
    no_vendor = ~has
    long_lead = F.col("VendorLeadDays") >= cfg.long_lead_days
    imported = has & F.lower(F.coalesce(F.col("_source"), F.lit(""))).contains("import")
    j = j.withColumn("RiskNotes", _join_notes((no_vendor, RISK_NO_VENDOR), (long_lead, RISK_LONG_LEAD),
                                              (imported, RISK_IMPORT)))
    j = j.withColumn("Mitigations", _join_notes((no_vendor, MITIGATION_NO_VENDOR), (long_lead, MITIGATION_LONG_LEAD),
                                                (imported, MITIGATION_IMPORT)))
    return j.select(F.col("item_key").alias("MasterItemNo"), *PLAN_COLUMNS[1:])


def plan_summary(plan: DataFrame) -> DataFrame:
    """One row: plan lines, distinct vendors (A10), total predicted quantity."""
    return plan.agg(F.count(F.lit(1)).alias("total_items"), F.countDistinct("Vendor").alias("unique_vendors"),
                    F.sum("PredictedQty").cast("bigint").alias("total_qty"))


def top_risks(plan: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent risk texts; blanks are counted, then not shown."""
    top = top_k_values(plan, F.col("RiskNotes"), k, "RiskNotes")
    return top.where(F.col("RiskNotes").isNotNull() & (F.col("RiskNotes") != ""))


def plan_sample(plan: DataFrame, n: int = 20) -> DataFrame:
    """First n plan rows in an explicit order (item, then every other column)."""
    return plan.orderBy(*[F.col(c).asc_nulls_last() for c in plan.columns]).limit(n)
