"""Project schedule, phase assignment and procurement dates.

The schedule and the keyword list are small dimensions: the keyword list is compiled into
one ``CASE WHEN`` expression (no join at all) and the schedule (checked to be small) is
broadcast; the data-sized side is never shuffled for them.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matforge.config import (DEFAULT_PHASE, PHASE_RESOURCE, PHASE_TYPE, PROCUREMENT_TYPE, TASK_PREFIX,
                             UNKNOWN_VENDOR, PlanConfig)
from matforge.functions.cleaning import (canonical_item_key, col_or_null, empty_to_null, parse_date,
                                         timeline_task_name, zero_to_null)
from matforge.operators.stats import demand_per_item
from matforge.sources.readers import csv_reader
from matforge.operators.vendors import schedule_policy, tasks_policy, with_schedule_vendor

SCHEDULE_SCHEMA = T.StructType([
    T.StructField("Task", T.StringType()), T.StructField("Start", T.DateType()),
    T.StructField("Finish", T.DateType()), T.StructField("ord", T.IntegerType()),
])


def default_schedule(spark: SparkSession, cfg: PlanConfig = PlanConfig()) -> DataFrame:
    """The five-phase schedule counted in days from ``cfg.as_of`` (no wall clock)."""
    rows = [(name, cfg.as_of + _dt.timedelta(days=a), cfg.as_of + _dt.timedelta(days=b), i)
            for i, (name, a, b) in enumerate(cfg.phases)]
    return spark.createDataFrame(rows, SCHEDULE_SCHEMA)


def normalize_schedule(df: DataFrame) -> DataFrame | None:
    """Trim headers, accept ``task_name/start_date/end_date``; None when columns are missing."""
    df = df.toDF(*[c.strip() for c in df.columns])
    ren = {"task_name": "Task", "start_date": "Start", "end_date": "Finish"}
    for a, b in ren.items():
        if a in df.columns and b not in df.columns:
            df = df.withColumnRenamed(a, b)
    if not {"Task", "Start", "Finish"} <= set(df.columns):
        return None
    ordc = F.col("ord").cast("int") if "ord" in df.columns else F.monotonically_increasing_id().cast("int")
    return df.select(F.col("Task").cast("string").alias("Task"), parse_date(F.col("Start")).alias("Start"),
                     parse_date(F.col("Finish")).alias("Finish"), ordc.alias("ord"))


def read_schedule(spark: SparkSession, path: str | None, cfg: PlanConfig = PlanConfig()) -> DataFrame:
    """Schedule CSV if it exists and has the needed columns, else the default schedule."""
    if path:
        try:
            raw = csv_reader(spark).csv(path)
            norm = normalize_schedule(raw)
            if norm is not None:
                return norm.orderBy("ord")
        except Exception:  # noqa: BLE001 - a missing/unreadable file falls back like the reference
            pass
    return default_schedule(spark, cfg)


def default_phase_row(schedule: DataFrame, preferred: str = DEFAULT_PHASE) -> DataFrame:
    """One row with the phase used when no keyword matches: ``preferred`` if scheduled or nothing is, else the first task."""
    return schedule.agg(F.coalesce(F.max(F.when(F.col("Task") == preferred, F.col("Task"))), F.min_by("Task", "ord"), F.lit(preferred)).alias("_default"))


def known_phases(phases: DataFrame, default_row: DataFrame, keywords, name: str = "Phase") -> DataFrame:
    """The rows of ``phases`` that a lookup can ask for: those of a keyword list and the default, whatever the schedule's size."""
    names = [p for p, _ in keywords]
    return phases.join(F.broadcast(default_row), F.col(name).isin(names) | (F.col(name) == F.col("_default"))).drop("_default")


def phase_expr(text: Column, keywords, default: str | Column) -> Column:
    """First phase (in priority order) whose keyword occurs in ``text`` (lower-cased)."""
    s = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for phase, words in keywords:
        cond = None
        for w in words:
            c = s.contains(w.lower())
            cond = c if cond is None else (cond | c)
        if cond is None:
            continue
        out = F.when(cond, F.lit(phase)) if out is None else out.when(cond, F.lit(phase))
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def keyword_phases(texts: DataFrame, text: str, keywords: DataFrame, default: str) -> DataFrame:
    """J6 with the keywords as a table (priority, phase, keyword) of any size: (text, phase) for every distinct text.

    The substrings of a text that have the length of some keyword meet the keywords in an equality join, and the smallest priority wins: the
    same as ``phase_expr`` over the keywords in that order, without a branch for each. The lengths (a few integers) are read first;
    a text or keyword counts in lower case, an empty keyword never.
    """
    words = keywords.select("priority", "phase", F.lower("keyword").alias("gram")).where(F.length("gram") > 0)
    lengths = sorted(r[0] for r in words.select(F.length("gram")).distinct().collect())
    own = texts.select(F.col(text).alias("text")).distinct()
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))

    def pieces(n: int) -> Column:
        starts = F.when(F.length(low) >= n, F.sequence(F.lit(1), F.length(low) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(low, i, F.lit(n)))

    grams = [pieces(n) for n in lengths]
    held = own.select("text", F.explode(F.array_distinct(F.flatten(F.array(*grams)))).alias("gram")) if grams else own.select("text", F.lit("").alias("gram"))
    # Spark sizes an explode like the file below it: merged, never broadcast.
    found = held.hint("merge").join(words, "gram").groupBy(F.col("text").alias("_text")).agg(F.min_by("phase", F.struct("priority", "phase")).alias("phase"))
    return own.join(found, F.col("text") == F.col("_text"), "left").select("text", F.coalesce("phase", F.lit(default)).alias("phase"))


def needed_by_expr(df: DataFrame, candidates=("needed_by_date", "needed_by", "needed_by_dt", "NeededBy")) -> Column:
    """First present column whose value parses as a date."""
    cols = [parse_date(F.col(c)) for c in candidates if c in df.columns]
    return F.coalesce(*cols) if cols else F.lit(None).cast("date")


def procurement_tasks(pred: DataFrame, vendors_flat: DataFrame, cfg: PlanConfig = PlanConfig(),
                      project_start: _dt.date | None = None) -> DataFrame:
    """V1: demand per item -> first vendor -> procurement window before installation.

    install = start + design + procurement days; window ends the day before and is at
    least ``tasks_min_lead`` days long. The reported lead is the vendor's own.
    """
    start = project_start or cfg.as_of
    install = _dt.date.fromordinal(start.toordinal() + cfg.design_days + cfg.procurement_days)
    agg = demand_per_item(pred)
    pol = tasks_policy(vendors_flat, cfg.tasks_default_lead)
    j = agg.join(pol, "item_key", "left")
    lead = F.coalesce(F.col("lead_days"), F.lit(cfg.tasks_default_lead))
    end = F.lit(install - _dt.timedelta(days=1))
    return j.select(
        F.col("item_key").alias("MasterItemNo"), F.col("Qty"),
        F.coalesce(F.when(F.col("vendor_name") != "", F.col("vendor_name")), F.lit("TBD")).alias("preferred_vendor"),
        lead.cast("int").alias("lead_time_days"),
        F.date_sub(end, F.greatest(lead, F.lit(cfg.tasks_min_lead))).alias("procurement_start"),
        end.alias("procurement_end"), F.lit(install).alias("expected_delivery"))


def align_schedule(tasks: DataFrame, schedule: DataFrame, vendors_flat: DataFrame,
                   cfg: PlanConfig = PlanConfig()) -> DataFrame:
    """V6: phase by keyword, needed-by = request date else phase finish, vendor lead + buffer
    back from it, never before the project start. Returns the 14 enriched-schedule columns."""
    default = default_phase_row(schedule, cfg.default_phase)
    desc = F.coalesce(empty_to_null(col_or_null(tasks, "ItemDescription")), empty_to_null(col_or_null(tasks, "Item")), F.lit(""))
    key_raw = col_or_null(tasks, "MasterItemNo")
    qty = F.coalesce(*[zero_to_null(col_or_null(tasks, c).try_cast("double"))
                       for c in ("QtyShipped", "Qty", "Quantity")])
    base = tasks.select(desc.alias("ItemDescription"), key_raw.cast("string").alias("MasterItemNo"),
                        canonical_item_key(key_raw).alias("item_key"), qty.alias("Qty"),
                        needed_by_expr(tasks).alias("_req_needed"))
    text = F.concat(F.col("ItemDescription"), F.lit(" "), F.coalesce(F.col("MasterItemNo"), F.lit("")))
    base = base.crossJoin(F.broadcast(default)).withColumn("Phase", phase_expr(text, cfg.schedule_keywords, F.col("_default"))).drop("_default")
    bounds = schedule.agg(F.min("Start").alias("_p0"), F.max("Finish").alias("_p1"))
    # Q14: a duplicated Task keeps its last row (dict semantics of the lookup)
    phases = schedule.groupBy("Task").agg(F.max_by(F.struct("Start", "Finish"), "ord").alias("_s")) \
        .select(F.col("Task").alias("Phase"), F.col("_s.Start").alias("PhaseStart"), F.col("_s.Finish").alias("PhaseFinish"))
    phases = known_phases(phases, default, cfg.schedule_keywords)
    j = base.join(F.broadcast(phases), "Phase", "left").crossJoin(F.broadcast(bounds))
    j = j.withColumn("PhaseStart", F.coalesce("PhaseStart", "_p0")).withColumn("PhaseFinish", F.coalesce("PhaseFinish", "_p1"))
    j = j.withColumn("NeededBy", F.coalesce(F.col("_req_needed"), F.col("PhaseFinish")))
    j = with_schedule_vendor(j, schedule_policy(vendors_flat), cfg.schedule_placeholder_lead, cfg.schedule_default_lead)
    start = F.date_sub(F.col("NeededBy"), F.col("VendorLeadDays") + F.lit(cfg.buffer_days))
    j = j.withColumn("ProcurementStart", F.greatest(start, F.col("_p0"))).withColumn("ProcurementFinish", F.col("NeededBy"))
    return j.select("Phase", "PhaseStart", "PhaseFinish", "ItemDescription", "MasterItemNo", "Qty", "VendorCompany",
                    "VendorSource", "VendorContact", "VendorURL", "VendorLeadDays", "ProcurementStart",
                    "ProcurementFinish", "NeededBy")


def timeline(schedule: DataFrame, enriched: DataFrame, row_id: str | None = None) -> DataFrame:
    """V7 + W6: phase bars and procurement bars in one table (Task, Start, Finish, Resource, Type).

    A procurement row with only one date gets a one-day bar; a row with none is dropped.
    """
    phases = schedule.select("Task", "Start", "Finish", F.lit(PHASE_RESOURCE).alias("Resource"),
                             F.lit(PHASE_TYPE).alias("Type"))
    rid = F.col(row_id) if row_id else F.lit(None).cast("string")
    s0 = F.col("ProcurementStart").cast("date")
    f0 = F.col("ProcurementFinish").cast("date")
    proc = enriched.select(
        timeline_task_name(F.col("ItemDescription"), F.col("MasterItemNo"), rid, TASK_PREFIX).alias("Task"),
        F.coalesce(s0, F.date_sub(f0, 1)).alias("Start"), F.coalesce(f0, F.date_add(s0, 1)).alias("Finish"),
        F.coalesce(F.when(F.col("VendorCompany") != "", F.col("VendorCompany")), F.lit(UNKNOWN_VENDOR)).alias("Resource"),
        F.lit(PROCUREMENT_TYPE).alias("Type"))
    proc = proc.where(F.col("Start").isNotNull() | F.col("Finish").isNotNull())
    return phases.unionByName(proc)
