"""Registered queries: one per operator of the inventory, over the driver's tables.

Each query takes (spark, sf_dir) and returns a DataFrame whose column names equal the
oracle SQL's (see ``matforge.plans.oracle_sql``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matforge.config import CURRENCY_COLUMNS, QUANTITY_COLUMNS, PlanConfig
from matforge.sources import fixtures as fx
from matforge.operators import schedule as sch
from matforge.operators import stats, vendors

CFG = PlanConfig()
QUERIES: dict = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _vendors(spark, sf):
    return vendors.flatten_catalogue(_catalogue_items(spark, sf))


def _catalogue_items(spark, sf):
    lines = fx.vendor_catalogue_json(spark, sf)
    return lines.select(F.from_json("value", vendors.CATALOGUE_ITEM).alias("d")).select("d.*")


@register("v1_procurement_tasks")
def v1_procurement_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return sch.procurement_tasks(fx.predictions(spark, sf), _vendors(spark, sf), CFG)


@register("a1_demand_per_item")
def a1_demand_per_item(spark: SparkSession, sf: str) -> DataFrame:
    return stats.demand_per_item(fx.line_items(spark, sf).select(
        "MasterItemNo", F.regexp_replace("QtyShipped", "[^0-9.]", "").alias("QtyShipped")))


# ---------------------------------------------------------------------------
# Shared inputs
# ---------------------------------------------------------------------------

# Keyword dimension for the test tables (part names are adjective + one of eight nouns).
TEST_KEYWORDS = (
    ("Electrical & HVAC", ("bolt", "rod")),
    ("IT Infrastructure", ("gear", "gizmo")),
    ("Foundation & Civil Works", ("plate", "anvil")),
    ("Design & Planning", ("ring",)),
)
TEST_CFG = PlanConfig(schedule_keywords=TEST_KEYWORDS, plan_keywords=TEST_KEYWORDS)

from matforge.functions import cleaning as C  # noqa: E402
from matforge.operators import classify as cl  # noqa: E402
from matforge.operators import encode as en  # noqa: E402
from matforge.operators import evaluate as ev  # noqa: E402
from matforge.operators import plan as pl  # noqa: E402
from matforge.operators import preprocess as pp  # noqa: E402
from matforge.operators import requests as rq  # noqa: E402
from matforge.operators import status_table as st  # noqa: E402
from matforge.operators.scan import sequential_ids  # noqa: E402


def _li(spark, sf):
    return fx.line_items(spark, sf)


def _clean(spark, sf):
    return pp.clean_columns(_li(spark, sf))


# ---------------------------------------------------------------------------
# C: scalar cleaning
# ---------------------------------------------------------------------------

@register("c1_clean_currency")
def c1(spark, sf):
    d = _li(spark, sf)
    return d.select(*[C.clean_currency(F.col(c)).alias(f"{c}_clean") for c in
                      ("invoiceTotal", "UnitPrice", "ExtendedPrice", "REVISED_ESTIMATE")])


@register("c2_safe_to_numeric")
def c2(spark, sf):
    d = _li(spark, sf)
    return d.select(*[C.safe_to_numeric(F.col(c)).alias(f"{c}_clean") for c in
                      ("QtyShipped", "ExtendedQuantity", "NUMFLOORS", "SIZE_BUILDINGSIZE")])


@register("c3_to_numeric")
def c3(spark, sf):
    d = _li(spark, sf)
    return d.select(C.to_numeric(F.col("SIZE_BUILDINGSIZE")).alias("size_num"),
                    C.to_numeric(F.col("QtyShipped")).alias("qty_num"),
                    C.to_numeric(F.col("ExtendedQuantity")).alias("ext_qty_num"))


@register("c4_plan_qty")
def c4(spark, sf):
    r = fx.requests(spark, sf)
    return r.select("id", C.plan_qty(F.col("qty")).alias("qty_plan"), C.plan_qty(F.concat("id", F.lit("e30"))).alias("too_large"),
                    C.plan_qty(F.concat(F.col("id").cast("string"), F.lit(".5"))).alias("half_even"))


@register("c5_link_qty")
def c5(spark, sf):
    r = fx.requests(spark, sf)
    return r.select("id", C.link_qty(F.col("qty")).alias("qty_int"))


@register("c6_item_key")
def c6(spark, sf):
    r = fx.requests(spark, sf)
    return r.select("id", "item", C.canonical_item_key(F.col("item")).alias("item_key"),
                    C.canonical_item_key(F.concat(F.lit(" 00"), "id", F.lit(" "))).alias("padded_key"),
                    C.canonical_item_key(F.concat("id", F.lit("E5"))).alias("letter_key"),
                    C.master_item_int(F.col("item")).alias("master_item"))


@register("c7_parse_dates")
def c7(spark, sf):
    d = _li(spark, sf)
    ship = fx.table(spark, sf, "lineitem").select("l_shipdate")
    more = {"iso": "yyyy-MM-dd'T'HH:mm:ss", "slash": "yyyy/MM/dd", "minute": "yyyy-MM-dd HH:mm"}
    dates = d.select(*[C.parse_date(F.col(c)).alias(f"{c}_dt") for c in
                       ("invoiceDate", "CONSTRUCTION_START_DATE", "SUBSTANTIAL_COMPLETION_DATE")], *[F.lit(None).cast("date").alias(f"{c}_dt") for c in more])
    written = ship.select(*[F.lit(None).cast("date").alias(c) for c in dates.columns[:3]],
                          *[C.parse_date(F.date_format("l_shipdate", f)).alias(f"{c}_dt") for c, f in more.items()])
    return dates.unionByName(written.toDF(*dates.columns))


@register("c8_calendar_features")
def c8(spark, sf):
    return _clean(spark, sf).select("invoiceDate_month", "invoiceDate_dow", "invoiceDate_week", "invoiceDate_quarter")


@register("c9_project_days")
def c9(spark, sf):
    return _clean(spark, sf).select("project_duration_days", "project_age_days")


@register("c10_size_per_floor")
def c10(spark, sf):
    return _clean(spark, sf).select("SIZE_BUILDINGSIZE_clean", "NUMFLOORS_clean", "size_per_floor")


@register("c11_cost_per_unit")
def c11(spark, sf):
    return _clean(spark, sf).select("ExtendedPrice_clean", "material_cost_per_unit")


@register("c12_clean_text")
def c12(spark, sf):
    return _clean(spark, sf).select("ItemDescription", "ItemDescription_clean")


@register("c13_basic_features")
def c13(spark, sf):
    return pp.basic_features(_li(spark, sf)).select(
        "PROJECT_CITY", "PROJECT_TYPE", "CORE_MARKET", "UOM", "SIZE_BUILDINGSIZE_num", "PROJECT_FREQ")


@register("c14_labelled_rows")
def c14(spark, sf):
    return pp.drop_unlabelled(_li(spark, sf)).select("label_raw")


@register("c15_short_label")
def c15(spark, sf):
    items = stats.demand_per_item(fx.predictions(spark, sf)).select("item_key")
    desc = stats.mode_description(_li(spark, sf), blank_as_value=True)
    j = items.join(desc, "item_key", "left")
    return j.select("item_key", C.short_label(F.col("ItemDescription"), F.col("item_key")).alias("label"))


@register("c16_timeline_task_name")
def c16(spark, sf):
    d = _li(spark, sf)
    return d.select(C.timeline_task_name(F.col("ItemDescription"), F.col("MasterItemNo"), F.lit(None)).alias("Task"))


@register("c17_finalize_predictions")
def c17(spark, sf):
    r = fx.requests(spark, sf)
    return r.select(F.col("id").cast("bigint").alias("id"),
                    F.coalesce(C.master_item_int(F.col("item")), F.lit(0).cast("bigint")).alias("MasterItemNo"),
                    F.coalesce(C.to_numeric(F.col("qty")), F.lit(0.0)).alias("QtyShipped"))


@register("c18_sequential_ids")
def c18(spark, sf):
    d = _li(spark, sf)
    return sequential_ids(d, d.columns, name="id", start=1)


# ---------------------------------------------------------------------------
# A: aggregations
# ---------------------------------------------------------------------------

def _train_qty(spark, sf):
    """Line items with the quantity cleaned to plain number text."""
    d = _li(spark, sf)
    return d.withColumn("QtyShipped", C.safe_to_numeric(F.col("QtyShipped")).cast("string"))


@register("a2_median_per_item")
def a2(spark, sf):
    return stats.median_per_item(_train_qty(spark, sf))


@register("a3_global_median")
def a3(spark, sf):
    return stats.global_median(_train_qty(spark, sf))


@register("a4_mode_description")
def a4(spark, sf):
    return stats.mode_description(_li(spark, sf))


@register("a5_most_frequent_item")
def a5(spark, sf):
    return stats.most_frequent_item(_li(spark, sf))


@register("a6_large_project_flag")
def a6(spark, sf):
    d = _clean(spark, sf)
    return stats.large_project_flag(d, "SIZE_BUILDINGSIZE_clean").select("SIZE_BUILDINGSIZE_clean", "is_large_project")


@register("a7_median_imputation")
def a7(spark, sf):
    d = _li(spark, sf)
    raw = d.select(*(c for c in (*CURRENCY_COLUMNS, *QUANTITY_COLUMNS) if c in d.columns))
    out = pp.preprocess(raw, CFG, drop=tuple(raw.columns))
    return out.select(*[c for c in out.columns if c.endswith("_clean") and c != "ItemDescription_clean"],
                      "is_large_project")


@register("a8_project_frequency")
def a8(spark, sf):
    return stats.project_frequency(_li(spark, sf)).select("PROJECTNUMBER", "PROJECT_FREQ")


@register("a9_top_items")
def a9(spark, sf):
    return stats.top_k_values(fx.predictions(spark, sf), F.col("MasterItemNo").cast("string"), 20, "MasterItemNo")


@register("a10_distinct_vendors")
def a10(spark, sf):
    return stats.count_distinct(_vendors(spark, sf), "company", name="unique_vendors")


@register("a14_label_codes")
def a14(spark, sf):
    return stats.label_codes(_li(spark, sf).select(C.canonical_item_key(F.col("MasterItemNo")).alias("MasterItemNo")))


# ---------------------------------------------------------------------------
# J / W: joins, lookups, vendor choice
# ---------------------------------------------------------------------------

def _items(spark, sf):
    return stats.demand_per_item(fx.predictions(spark, sf)).select("item_key")


@register("j1_join_truth_prediction")
def j1(spark, sf):
    t, p = fx.score_pairs(spark, sf)
    return ev.join_truth_prediction(t, p)


@register("j2_item_vendor_lookup")
def j2(spark, sf):
    pol = vendors.plan_policy(_vendors(spark, sf))
    return _items(spark, sf).join(pol, "item_key", "left").select("item_key", "Vendor", "VendorContact", "VendorLeadDays")


@register("j3_item_description_lookup")
def j3(spark, sf):
    return _items(spark, sf).join(stats.mode_description(_li(spark, sf)), "item_key", "left")


@register("j4_item_median_lookup")
def j4(spark, sf):
    return _items(spark, sf).join(stats.median_per_item(_train_qty(spark, sf)), "item_key", "left")


@register("j2_bucketed_lookups")
def j2_bucketed(spark, sf, buckets: int = 16):
    """J2-J4 over item tables that are bucketed once: every prediction line with its vendor, description and median; only the lines move."""
    train = written(_train_qty(spark, sf).select("MasterItemNo", "ItemDescription", "QtyShipped"), "line-items")  # made by joins and read twice
    tables = [sk.write_bucketed(t, n, "item_key", buckets) for n, t in (
        ("item_vendor", vendors.plan_policy(_vendors(spark, sf)).select("item_key", "Vendor", "VendorContact", "VendorLeadDays")),
        ("item_description", stats.mode_description(train)), ("item_median", stats.median_per_item(train)))]
    lines = fx.predictions(spark, sf).select(C.canonical_item_key(F.col("MasterItemNo")).alias("item_key"), "QtyShipped").repartition(buckets, "item_key")
    for t in tables:
        lines = lines.join(t.hint("merge"), "item_key", "left")
    return lines.select("item_key", "QtyShipped", "Vendor", "VendorContact", "VendorLeadDays", "ItemDescription", "median_qty")


def _phased_lines(spark, sf):
    d = _li(spark, sf)
    return d.select(C.canonical_item_key(F.col("MasterItemNo")).alias("item_key"), "ItemDescription",
                    sch.phase_expr(F.col("ItemDescription"), TEST_KEYWORDS, "Electrical & HVAC").alias("Phase"))


@register("j5_phase_window_lookup")
def j5(spark, sf):
    s = sch.default_schedule(spark, CFG)
    lines = _phased_lines(spark, sf)
    ph = s.select(F.col("Task").alias("Phase"), F.col("Start").alias("PhaseStart"), F.col("Finish").alias("PhaseFinish"))
    return lines.join(F.broadcast(ph), "Phase", "left").select("item_key", "Phase", "PhaseStart", "PhaseFinish")


@register("j6_keyword_phase")
def j6(spark, sf):
    return _phased_lines(spark, sf).select("item_key", "ItemDescription", "Phase")


@register("j6_keyword_table")
def j6_table(spark, sf):
    """Phases by a keyword table made of the words of all part names, by item description."""
    word = F.explode(F.split("p_name", " "))
    words = fx.table(spark, sf, "part").select(word.alias("keyword")).where(F.length("keyword") > 2).distinct()
    keywords = words.select(F.md5(F.col("keyword").cast("binary")).alias("priority"), F.concat(F.lit("Phase "), F.upper("keyword")).alias("phase"), "keyword")
    return sch.keyword_phases(_li(spark, sf), "ItemDescription", keywords, "Other")


@register("j7_category_codes")
def j7(spark, sf):
    """Codes learned on all line items, applied to rows of which some have a missing or a new city."""
    d = _li(spark, sf)
    cols = ["PROJECT_CITY", "PROJECT_TYPE", "CORE_MARKET", "UOM"]
    codes = en.fit_category_codes(d, cols)
    city = F.when(F.col("NUMFLOORS") == "5", F.concat("PROJECT_CITY", F.lit(" (new)"))).when(F.col("NUMFLOORS") != "6", F.col("PROJECT_CITY"))
    out = en.apply_category_codes(d.select(city.alias("PROJECT_CITY"), *cols[1:]).distinct(), codes, cols)
    return out.select(*cols, *(F.col(f"{c}_code").cast("bigint").alias(f"{c}_code") for c in cols))


@register("j8_vendors_for_top_items")
def j8(spark, sf):
    """The vendors of every item that has one of the largest predicted lines."""
    asked = fx.predictions(spark, sf).where(F.col("QtyShipped") >= 49).select(C.canonical_item_key(F.col("MasterItemNo")).alias("item_key"))
    return vendors.vendors_for_item(_vendors(spark, sf), asked).select(
        "item_key", "pos", "company", "url", "contact", "lead_time_days", "source")


@register("j9_unlinked_anti_join")
def j9(spark, sf):
    r = fx.requests(spark, sf)
    linked = r.where("linked_to_procurement").select("id")
    return rq.approved_unlinked(r.drop("linked_to_procurement"), linked).select("id")


@register("w1_first_vendor")
def w1(spark, sf):
    return vendors.first_vendor(_vendors(spark, sf)).select("item_key", "pos", "company", "lead_time_days")


@register("w2_min_lead_vendor")
def w2(spark, sf):
    return vendors.min_lead_vendor(_vendors(spark, sf)).select("item_key", "pos", "company", "lead_time_days")


# ---------------------------------------------------------------------------
# V: composite procurement jobs
# ---------------------------------------------------------------------------

@register("v3_tasks_vendor_policy")
def v3(spark, sf):
    return vendors.tasks_policy(_vendors(spark, sf))


@register("v4_schedule_vendor_policy")
def v4(spark, sf):
    pol = vendors.schedule_policy(_vendors(spark, sf))
    j = vendors.with_schedule_vendor(_items(spark, sf), pol)
    return j.select("item_key", "VendorCompany", "VendorSource", "VendorContact", "VendorURL", "VendorLeadDays")


@register("v5_plan_vendor_policy")
def v5(spark, sf):
    return vendors.plan_policy(_vendors(spark, sf)).select("item_key", "Vendor", "VendorContact", "VendorLeadDays")


def _linked_tasks(spark, sf):
    tasks = sch.procurement_tasks(fx.predictions(spark, sf), _vendors(spark, sf), TEST_CFG)
    r = fx.requests(spark, sf)
    linked = r.where("linked_to_procurement").select("id")
    out, _ = rq.link_requests(tasks, r.drop("linked_to_procurement"), linked, F.lit(None).cast("timestamp"))
    return out


def _descr_tasks(spark, sf, catalogue):
    """Tasks (V1) with the modal description per item (J3), then the linked request rows."""
    tasks = sch.procurement_tasks(fx.predictions(spark, sf), catalogue, TEST_CFG)
    tasks = tasks.join(stats.mode_description(_li(spark, sf)).withColumnRenamed("item_key", "MasterItemNo"),
                       "MasterItemNo", "left")
    r = fx.requests(spark, sf)
    linked = r.where("linked_to_procurement").select("id")
    out, _ = rq.link_requests(tasks, r.drop("linked_to_procurement"), linked, F.lit(None).cast("timestamp"))
    return out


@register("v6_schedule_alignment")
def v6(spark, sf):
    s = sch.default_schedule(spark, TEST_CFG)
    catalogue = written(vendors.first_vendor(_vendors(spark, sf)), "vendors")  # both policies read it, and of it an item's first vendor
    return sch.align_schedule(_descr_tasks(spark, sf, catalogue), s, catalogue, TEST_CFG)


@register("v7_timeline")
def v7(spark, sf):
    return sch.timeline(sch.default_schedule(spark, TEST_CFG), v6(spark, sf)).orderBy("Start")  # W3, W6


@register("w3_timeline_order")
def w3(spark, sf):
    """The place of every bar in the timeline sorted by start (ties by task, finish and the rest)."""
    bars = v7(spark, sf)
    return sequential_ids(bars, ["Start", "Task", "Finish", "Resource", "Type"], name="ordinal").select("ordinal", "Start", "Task", "Finish")


def _plan(spark, sf):
    s = sch.default_schedule(spark, TEST_CFG)
    return pl.procurement_plan(fx.predictions(spark, sf), s, _vendors(spark, sf), _li(spark, sf), TEST_CFG)


@register("v8_procurement_plan")
def v8(spark, sf):
    return _plan(spark, sf)


@register("v9_order_cycle")
def v9(spark, sf):
    """Over the demand of whole items, which reaches all three cycles."""
    s = sch.default_schedule(spark, TEST_CFG)
    total = F.sum("QtyShipped")
    demand = fx.predictions(spark, sf).groupBy("MasterItemNo").agg(total.alias("QtyShipped"))
    demand = demand.withColumn("QtyShipped", F.when(F.col("MasterItemNo") % 3 == 0, F.floor(F.col("QtyShipped") / 10)).otherwise(F.col("QtyShipped")))
    plan = pl.procurement_plan(demand, s, _vendors(spark, sf), _li(spark, sf), TEST_CFG)
    return plan.groupBy("ProcurementCycle").agg(F.count(F.lit(1)).alias("n"),
                                                              F.min("RecommendedOrderQty").alias("min_order"),
                                                              F.max("RecommendedOrderQty").alias("max_order"))


@register("v10_risk_notes")
def v10(spark, sf):
    return _plan(spark, sf).groupBy("RiskNotes", "Mitigations").agg(F.count(F.lit(1)).alias("n"))


@register("v11_plan_summary")
def v11(spark, sf):
    return pl.plan_summary(_plan(spark, sf))


@register("a12_top_risks")
def a12(spark, sf):
    return pl.top_risks(_plan(spark, sf))


@register("w4_plan_sample")
def w4(spark, sf):
    return pl.plan_sample(_plan(spark, sf), 20)


@register("v12_needed_by_resolution")
def v12(spark, sf):
    t = _linked_tasks(spark, sf)
    return t.select("MasterItemNo", sch.needed_by_expr(t).alias("NeededBy"))


# ---------------------------------------------------------------------------
# R: request workflow
# ---------------------------------------------------------------------------

@register("r1_parse_requests")
def r1(spark, sf):
    raw = rq.parse_requests(fx.requests_json(spark, sf))
    return raw.select("id", "item", "qty", "needed_by", "notes", "status", "created_at", "linked_to_procurement")


@register("r2_new_request_ids")
def r2(spark, sf):
    existing = fx.requests(spark, sf)
    e = fx.table(spark, sf, "events")
    ev_ = e.where(F.col("event_type") == "purchase").select(
        "event_id", "ts", F.concat(F.lit("Item "), F.col("user_id").cast("string")).alias("item"))
    out = rq.new_request_ids(existing, ev_, ["ts", "event_id"])
    return out.select("id", "event_id", "item", "status")


@register("r3_running_id_fold")
def r3(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    raw = o.select(k.alias("pos"), F.when(k % 5 == 0, F.lit(None).cast("string"))
                   .when(k % 7 == 0, F.concat(F.lit("x"), k.cast("string")))
                   .otherwise(k.cast("string")).alias("id"))
    return rq.normalize_requests(raw, ["pos"]).select("pos", "id", "status")


@register("r4_latest_status")
def r4(spark, sf):
    return rq.latest_status(fx.request_feed(spark, sf)).select("id", "status")


@register("r4_status_table")
def r4_table(spark, sf):
    """R4 kept as a bucketed table: the feed in four deltas, one of them applied again."""
    root = scratch_path(spark, "status_table")
    feed = written(fx.request_feed(spark, sf).withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(4))), "feed")
    for part in (0, 1, 2, 3, 1):
        st.apply_delta(spark, feed.where(F.col("part") == part), root)
    return st.read_status_table(spark, root).select("id", "status", F.col("ts").alias("status_ts"))


@register("r5_approved_unlinked")
def r5(spark, sf):
    r = fx.requests(spark, sf)
    return rq.approved_unlinked(r).select("id", "item", "qty", "status")


@register("r6_request_task_rows")
def r6(spark, sf):
    return rq.request_task_rows(rq.approved_unlinked(fx.requests(spark, sf)))


@register("r7_link_requests")
def r7(spark, sf):
    return _linked_tasks(spark, sf)


# ---------------------------------------------------------------------------
# X: extraction from stored pages and documents
# ---------------------------------------------------------------------------
from matforge.operators import pages as pg  # noqa: E402


@register("x1_page_vendors")
def x1(spark, sf):
    return pg.page_vendors(fx.table(spark, sf, "pages"))


@register("x1_result_blocks")
def x1_blocks(spark, sf):
    return pg.result_blocks(fx.listing_pages(spark, sf))


# Words that the links of the test pages have.
TEST_LINK_WORDS = ("tion", "and", "the")


@register("x2_loose_links")
def x2(spark, sf):
    return pg.loose_links(fx.table(spark, sf, "pages"), words=TEST_LINK_WORDS)


@register("x3_contact_mining")
def x3(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", pg.contact_of(F.col("text")).alias("contact"))


@register("x4_company_fallback")
def x4(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", pg.company_fallback(F.col("text")).alias("company"))


@register("x5_source_preference")
def x5(spark, sf):
    rp = fx.result_pages(spark, sf)
    found = pg.page_vendors(rp, keep=("page_id", "item_key", "provider_rank")).select(
        "item_key", F.col("provider_rank").alias("source_rank"), "company", "url")
    cat = _vendors(spark, sf).select("item_key", F.lit(3).alias("source_rank"), "company", "url")
    return vendors.prefer_sources(found.unionByName(cat))


@register("v2_page_vendor_dedupe")
def v2(spark, sf):
    v = pg.page_vendors(fx.table(spark, sf, "pages"))
    return v.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_vendors"), F.max("rank").alias("max_rank"))


# ---------------------------------------------------------------------------
# S: sources and sinks (written to the shared scratch folder, read back)
# ---------------------------------------------------------------------------
from matforge.session import ensure_checkpoint_dir, scratch_path, written  # noqa: E402
from matforge.sources import readers as rd  # noqa: E402
from matforge.sources import sinks as sk  # noqa: E402


def _quoted_lines(spark, sf):
    """Line items whose descriptions have inch marks, commas and line ends."""
    end = F.when(F.length("ItemDescription") % 3 == 0, F.lit('\nline "two", end')).otherwise(F.lit(', 2" SCH40'))
    return _li(spark, sf).withColumn("ItemDescription", F.concat("ItemDescription", end))


@register("s1_line_item_csv_scan")
def s1(spark, sf):
    """CSV text made field by field, not by Spark's CSV writer: packed files with a header of their own, of a thousand lines each and fewer at a task's end."""
    path = scratch_path(spark, "line_items_csv")
    d = _quoted_lines(spark, sf)
    field = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))
    lines = d.select(F.concat_ws(",", *[field(c) for c in d.columns]).alias("line"))
    sk.write_line_files(lines, path, ",".join(f'"{c}"' for c in d.columns))
    return rd.read_line_items(spark, path)


@register("s2_pruned_item_scan")
def s2(spark, sf):
    """Over Parquet, of which only the two columns are read."""
    path = scratch_path(spark, "line_items")
    sk.write_table(_li(spark, sf), path)
    return rd.read_line_items(spark, path, fmt="parquet", columns=["MasterItemNo", "ItemDescription"])


def _order_schedule(spark, sf):
    """A schedule file from the orders: one phase per priority, under the other accepted headers."""
    path = scratch_path(spark, "schedule_csv")
    o = fx.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias(" task_name ")).agg(
        F.date_format(F.min("o_orderdate"), "MM/dd/yyyy").alias("start_date"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("end_date "))
    sk.write_table(o.orderBy(" task_name "), path, fmt="csv")
    return sch.read_schedule(spark, path, CFG)


@register("s5_schedule_scan")
def s5(spark, sf):
    return _order_schedule(spark, sf).select("Task", "Start", "Finish")


@register("a13_schedule_bounds")
def a13(spark, sf):
    return stats.schedule_bounds(_order_schedule(spark, sf))


@register("s7_plan_source")
def s7(spark, sf):
    """No predictions file: the task table stands in, its Qty as QtyShipped."""
    path = scratch_path(spark, "plan_tasks_csv")
    sk.write_table(sch.procurement_tasks(fx.predictions(spark, sf), _vendors(spark, sf), CFG), path, fmt="csv")
    return rd.read_plan_items(spark, path + "-missing", path).select("MasterItemNo", F.col("QtyShipped").cast("double").alias("QtyShipped"))


@register("s8_validated_predictions")
def s8(spark, sf):
    o = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("MasterItemNo"), F.col("l_quantity").alias("QtyShipped"))
    return rd.validate_predictions(o)


@register("s3_vendor_catalogue_scan")
def s3(spark, sf):
    """Single objects, lists, documents with items, and documents keyed by item."""
    path, keyed = scratch_path(spark, "vendors_json"), scratch_path(spark, "vendors_keyed_json")
    lines = written(fx.vendor_catalogue_json(spark, sf).withColumn("shape", F.pmod(F.xxhash64("value"), F.lit(4))), "vendor-lines")
    lines.where("shape < 3").select(F.when(F.col("shape") == 0, F.col("value")).when(F.col("shape") == 1, F.concat(F.lit(" ["), "value", F.lit("]")))
                                    .otherwise(F.concat(F.lit('{"items":['), "value", F.lit("]}"))).alias("value")).write.mode("overwrite").text(path)
    item, vendor = F.get_json_object("value", "$.MasterItemNo"), F.get_json_object("value", "$.vendors")
    lines.where("shape = 3").select(F.concat(F.lit('{"'), item, F.lit('":'), vendor, F.lit("}")).alias("value")).write.mode("overwrite").text(keyed)
    return vendors.read_catalogue(spark, path).unionByName(vendors.read_catalogue(spark, keyed, shape="keyed")).select(
        "item_key", "pos", "company", "url", "location", "contact", "lead_time_days", "min_order_qty", "source")


@register("s9_predictions_sink")
def s9_predictions(spark, sf):
    return sk.round_trip(m11(spark, sf), scratch_path(spark, "predictions_csv"))


@register("s9_preprocessed_sink")
def s9_preprocessed(spark, sf):
    return sk.round_trip(a7(spark, sf), scratch_path(spark, "preprocessed"), fmt="parquet")


@register("s9_schedule_sink")
def s9_schedule(spark, sf):
    return sk.round_trip(v6(spark, sf), scratch_path(spark, "schedule_csv"))


@register("s9_plan_sink")
def s9_plan(spark, sf):
    return sk.round_trip(v8(spark, sf), scratch_path(spark, "plan_csv"))


@register("s9_tasks_sink_roundtrip")
def s9(spark, sf):
    path = scratch_path(spark, "tasks_csv")
    tasks = sch.procurement_tasks(fx.predictions(spark, sf), _vendors(spark, sf), CFG)
    sk.write_table(tasks, path, fmt="csv")
    back = rd.read_tasks(spark, path, required=True)
    return back.select(F.col("MasterItemNo"), F.col("Qty").cast("double"), "preferred_vendor",
                       F.col("lead_time_days").cast("int"),
                       *[F.to_date(c).alias(c) for c in ("procurement_start", "procurement_end", "expected_delivery")])


@register("s10_vendor_catalogue_write")
def s10(spark, sf):
    path = scratch_path(spark, "vendors_nested")
    vendors.write_catalogue(_vendors(spark, sf), path)
    back = vendors.read_catalogue(spark, path)
    return back.groupBy("item_key").agg(
        F.count(F.lit(1)).alias("n_vendors"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "company"))), lambda x: x["company"]),
                     "|").alias("companies"))


# ---------------------------------------------------------------------------
# M: text, models, scoring
# ---------------------------------------------------------------------------
from matforge.operators import models as md  # noqa: E402
from matforge.operators import text as tx  # noqa: E402


@register("m1_tfidf")
def m1(spark, sf):
    _, w = tx.fit_tfidf(fx.table(spark, sf, "documents"))
    return w.select("doc_id", "term", F.round("weight", 9).alias("weight"))


@register("m3_tfidf_transform")
def m3(spark, sf):
    vocab, _ = tx.fit_tfidf(fx.table(spark, sf, "documents"))
    bench = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    w = tx.transform_tfidf(bench, vocab)
    return w.select(F.col("doc_id").alias("item_id"), "term", F.round("weight", 9).alias("weight"))


def _labelled_docs(spark, sf):
    d = fx.table(spark, sf, "documents")
    lab = fx.table(spark, sf, "labels")
    return d.join(lab, "doc_id")


@register("m4_target_encoding")
def m4(spark, sf):
    enc = md.fit_target_encoding(_labelled_docs(spark, sf), ["source", "lang"], "quality")
    return enc.select("column", "value", "n", F.round("encoding", 9).alias("encoding"))


@register("m5_group_folds")
def m5(spark, sf):
    p = _li(spark, sf).select("PROJECTNUMBER").distinct()
    return p.select("PROJECTNUMBER", md.group_fold(F.col("PROJECTNUMBER")).alias("fold"))


@register("m9_quantity_fallback")
def m9(spark, sf):
    r = fx.requests(spark, sf).select("id", C.canonical_item_key(F.col("item")).alias("item_key"))
    return md.quantity_fallback(r, _train_qty(spark, sf)).select("id", "item_key", "QtyShipped")


@register("m10_item_decode")
def m10(spark, sf):
    codes = stats.label_codes(_li(spark, sf))
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4500).alias("pred_code"))
    return md.decode_items(o, codes).select("id", "pred_code", "MasterItemNo")


@register("m11_baseline_predictions")
def m11(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return md.baseline_predictions(o, _train_qty(spark, sf))


def _pairs(spark, sf):
    t, p = fx.score_pairs(spark, sf)
    return ev.join_truth_prediction(t, p)


@register("m12_accuracy")
def m12(spark, sf):
    return ev.scores(_pairs(spark, sf)).select(F.round("accuracy", 9).alias("accuracy"))


@register("m13_macro_f1")
def m13(spark, sf):
    return ev.per_label_f1(_pairs(spark, sf)).select("label", "tp", "fp", "fn", F.round("f1", 9).alias("f1"))


@register("m14_scores")
def m14(spark, sf):
    s = ev.scores(_pairs(spark, sf))
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


def _doc_svd(spark, sf, k: int = tx.SVD_COMPONENTS):
    vocab, w = tx.fit_tfidf_blocks(fx.table(spark, sf, "documents"), tx.TRAIN_MAX_FEATURES)
    w = written(w, "document-weights")  # read by the decomposition and the projection
    vsize = vocab.count()
    k = max(1, min(k, vsize - 1))
    comps, _ = tx.fit_svd(w, vsize, k)
    return written(tx.project(w, comps, k), "document-vectors"), k


@register("m2_truncated_svd")
def m2(spark, sf):
    proj, _ = _doc_svd(spark, sf)
    return proj


@register("m6_fold_classifier")
def m6(spark, sf):
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import VectorAssembler, VectorSizeHint
    from pyspark.ml.functions import array_to_vector

    proj, k = _doc_svd(spark, sf)
    # Of the documents only the categories go on: the texts are in the vectors.
    docs = fx.table(spark, sf, "documents").select("doc_id", "source", "lang").join(proj, "doc_id", "left")
    # The components stay one vector, not k columns to put together again for every row and pass.
    docs = docs.withColumn("svd", array_to_vector(F.coalesce("svd", F.array_repeat(F.lit(0.0), k))))
    lab = docs.join(fx.table(spark, sf, "labels"), "doc_id")
    enc = written(md.fit_target_encoding(_labelled_docs(spark, sf), ["source", "lang"], "quality"), "encodings")  # a row a category, read six times
    sized = VectorSizeHint(inputCol="svd", size=k, handleInvalid="optimistic")
    va = PipelineModel([sized, VectorAssembler(inputCols=["source_te", "lang_te", "svd"], outputCol="features", handleInvalid="keep")])
    train = va.transform(md.apply_target_encoding(lab, enc, ["source", "lang"]))
    train = train.select("features", md.group_fold(F.col("source")).alias("fold"), F.col("quality").cast("double").alias("label"))
    train = written(train, "fold-rows")  # four fold fits read it
    models = [NaiveBayes(featuresCol="features", labelCol="label", modelType="gaussian").fit(train.where(F.col("fold") != f))
              for f in range(md.N_FOLDS)]
    allf = va.transform(md.apply_target_encoding(docs, enc, ["source", "lang"])).select("doc_id", "features")
    return md.predict_fold_average(models, allf, ["doc_id"]).select("doc_id", "prediction")


@register("m5_balanced_folds")
def m5_balanced(spark, sf):
    """Groups and rows of each fold of the projects, balanced by rows."""
    return md.balanced_folds(_li(spark, sf), "PROJECTNUMBER").groupBy("fold").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"))


@register("m6_item_classifier")
def m6_items(spark, sf):
    """The item of every distinct description, by the term classifier of four project folds over all line items."""
    t = _li(spark, sf).withColumn("item_key", C.canonical_item_key(F.col("MasterItemNo")))
    model = cl.fit_term_classifier(t, "item_key", "ItemDescription", md.group_fold(F.col("PROJECTNUMBER")))
    return cl.classify_texts(model, t, "ItemDescription").select("text", F.col("label").alias("item_key"), "score")


CODED = ("PROJECT_CITY", "PROJECT_TYPE", "CORE_MARKET", "UOM")


def _reg_features(spark, sf):
    """The features and their names. What the features are made of is written once, and so are they: each pass reads numbers."""
    raw = _li(spark, sf).select("PROJECTNUMBER", "MasterItemNo", "QtyShipped", "NUMFLOORS", "UnitPrice", "SIZE_BUILDINGSIZE", *CODED)
    t = pp.preprocess(raw, CFG, drop=("QtyShipped", "NUMFLOORS", "UnitPrice"))
    t = pp.basic_features(t, frequency=False)
    counts = stats.project_counts(t)
    t = en.apply_category_codes(t, en.fit_category_codes(t, list(CODED)), list(CODED)).withColumn("item_key", C.canonical_item_key(F.col("MasterItemNo")))
    own = ["SIZE_BUILDINGSIZE_num", "PROJECT_FREQ", "is_large_project", "NUMFLOORS_clean", "UnitPrice_clean"]
    cols = [*own, *(f"{c}_code" for c in CODED)]
    # Where the projects are many, the join with their counts deals all rows by project: by then they are numbers.
    t = stats.project_frequency(t.select("item_key", "PROJECTNUMBER", "QtyShipped_clean", *(c for c in cols if c != "PROJECT_FREQ")), counts=counts)
    return written(t, "feature-rows"), cols


@register("m7_global_regressor")
def m7(spark, sf):
    """Boosting ends when the projects of fold 0 no longer gain."""
    t, cols = _reg_features(spark, sf)
    t = written(t.select("item_key", "QtyShipped_clean", *cols, (md.group_fold(F.col("PROJECTNUMBER")) == 0).alias("held_out")), "regressor-rows")
    model = md.fit_global_regressor(t, cols, "QtyShipped_clean", "held_out")
    return model.transform(t).select("item_key", "QtyShipped_clean", "prediction")


@register("m7_one_round_stump")
def m7_stump(spark, sf):
    """M7 with one round of one split, for which the fit has a closed form: the split of floors, market or type that leaves the least error."""
    d = _li(spark, sf).select(C.to_numeric(F.col("NUMFLOORS")).alias("floors"), "CORE_MARKET", "PROJECT_TYPE",
                              (C.safe_to_numeric(F.col("QtyShipped")) * (1 + C.to_numeric(F.col("NUMFLOORS")) % 3)).alias("q"))
    cols = ["CORE_MARKET", "PROJECT_TYPE"]
    t = en.apply_category_codes(d, en.fit_category_codes(d, cols), cols)
    model = md.fit_global_regressor(t, ["floors", "CORE_MARKET_code", "PROJECT_TYPE_code"], "q", max_iter=1, depth=1)
    keys = t.select("floors", *cols, "CORE_MARKET_code", "PROJECT_TYPE_code").distinct()
    return model.transform(keys).select("floors", *cols, F.round("prediction", 6).alias("prediction"))


@register("m8_item_regressors")
def m8(spark, sf):
    t, cols = _reg_features(spark, sf)
    return md.fit_item_regressors(t, "item_key", cols, "QtyShipped_clean")


@register("j10_item_model_scoring")
def j10(spark, sf):
    t, cols = _reg_features(spark, sf)
    coefs = md.fit_item_regressors(t, "item_key", cols, "QtyShipped_clean")
    return md.score_linear(t, coefs, "item_key", cols, "q_item").select("item_key", "QtyShipped_clean", "q_item")


def _floor_rows(spark, sf):
    return _li(spark, sf).select(C.canonical_item_key(F.col("MasterItemNo")).alias("item_key"), C.to_numeric(F.col("NUMFLOORS")).alias("x"),
                                 C.safe_to_numeric(F.col("QtyShipped")).alias("q"))


@register("m8_one_feature_regressors")
def m8_one(spark, sf):
    """M8 with one feature, for which the fit has a closed form."""
    coefs = md.fit_item_regressors(_floor_rows(spark, sf), "item_key", ["x"], "q")
    return coefs.select("item_key", *[F.round(F.col("coef")[i], 6).alias(f"b{i}") for i in (0, 1)])


@register("m8_item_statistics")
def m8_statistics(spark, sf):
    """X'X and X'y of every item over three features, from which the models are solved."""
    d = _li(spark, sf).select(C.canonical_item_key(F.col("MasterItemNo")).alias("item_key"), C.to_numeric(F.col("NUMFLOORS")).alias("floors"),
                              C.safe_to_numeric(F.col("SIZE_BUILDINGSIZE")).alias("size"), C.clean_currency(F.col("UnitPrice")).alias("price"), C.safe_to_numeric(F.col("QtyShipped")).alias("q"))
    out = md.item_statistics(d, "item_key", ["floors", "size", "price"], "q")
    return out.select("item_key", "n", *(F.round(F.col(c), 4).alias(c) for c in out.columns[2:]))


@register("m9_model_chain")
def m9_chain(spark, sf):
    """All four steps of M9: the item's model where it has one and the row a feature, a global model for items of some keys, the item's
    median, the global median."""
    t = _floor_rows(spark, sf)
    coefs = md.fit_item_regressors(t, "item_key", ["x"], "q").where(F.col("item_key").cast("bigint") % 3 == 0)
    r = fx.requests(spark, sf).select("id", C.canonical_item_key(F.col("item")).alias("item_key"), (F.col("id") % 7).cast("double").alias("x"))
    r = md.score_linear(r, coefs, "item_key", ["x"], "q_item").withColumn("q_global", F.when(F.col("id") % 5 == 0, F.col("x") + 0.5))
    return md.quantity_fallback(r, _train_qty(spark, sf), model_cols=("q_item", "q_global")).select("id", "item_key", F.round("q_item", 6).alias("q_item"), "QtyShipped")


@register("j10_one_feature_scoring")
def j10_one(spark, sf):
    t = _floor_rows(spark, sf)
    coefs = md.fit_item_regressors(t, "item_key", ["x"], "q")
    return md.score_linear(t, coefs, "item_key", ["x"], "q_item").select("item_key", "x", F.round("q_item", 6).alias("q_item"))


@register("m15_end_to_end_prediction")
def m15(spark, sf):
    """Train on the line items, predict every line item (id, item code, quantity)."""
    from matforge.plans import jobs

    li = _li(spark, sf)
    m = jobs.train_models(li, CFG)
    # As two programs do it: one saves the models, the other reads them.
    root = scratch_path(spark, "models")
    jobs.save_models(m, root)
    return jobs.predict(jobs.load_models(spark, root), li, CFG)


# ---------------------------------------------------------------------------
# T: streaming
# ---------------------------------------------------------------------------

@register("t1_request_stream_link")
def t1(spark, sf):
    from matforge.streaming.request_feed import run_request_stream

    root = scratch_path(spark, "request_stream")
    feed_dir = f"{root}/feed"
    last = fx.last_event(spark, sf)
    feed = fx.request_feed(spark, sf).withColumn("part", F.floor(F.col("seq") * 4 / (last + 1)))
    stores = max(4, last // 100_000)  # by the changes that the state is made of
    reqs = fx.requests(spark, sf).drop("status", "linked_to_procurement")
    for part in range(4):  # the stream stops and goes on, and requests change their status across its runs
        feed.where(F.col("part") == part).drop("part").write.mode("append").parquet(feed_dir)
        rows = run_request_stream(spark, feed_dir, reqs, root, state_partitions=stores)
    return rows.drop("batch_id")
