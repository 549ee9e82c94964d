"""Vendor catalogue: flattening, per-item policies, lookups.

Policies reduce the flat vendor table to one row per item with ``min_by`` (a map-side
combinable aggregate) *before* any join, so the join side is bounded by the item count
and a hot item never becomes a hot join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matforge.config import PLACEHOLDER_COMPANY, PLACEHOLDER_SOURCE
from matforge.functions.cleaning import canonical_item_key

VENDOR_FIELDS = ("company", "url", "services", "location", "contact", "lead_time_days", "min_order_qty", "source")

VENDOR_STRUCT = T.StructType([
    T.StructField("company", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("Vendor", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("services", T.StringType()),
    T.StructField("location", T.StringType()), T.StructField("contact", T.StringType()),
    T.StructField("lead_time_days", T.StringType()), T.StructField("lead_time", T.StringType()),
    T.StructField("lead", T.StringType()),
    T.StructField("min_order_qty", T.StringType()), T.StructField("source", T.StringType()),
])
CATALOGUE_ITEM = T.StructType([
    T.StructField("MasterItemNo", T.StringType()),
    T.StructField("vendors", T.ArrayType(VENDOR_STRUCT)),
])


def _int_text(c):
    return F.when(F.trim(c).rlike(r"^[+-]?\d+(\.0*)?$"), F.trim(c).try_cast("double").try_cast("int"))


def flatten_catalogue(items: DataFrame, key: str = "MasterItemNo", vendors: str = "vendors") -> DataFrame:
    """One row per (item, vendor) with the vendor's list position ``pos``."""
    e = items.select(canonical_item_key(F.col(key)).alias("item_key"),
                     F.posexplode_outer(vendors).alias("pos", "v")).where(F.col("v").isNotNull())
    v = F.col("v")
    fields = {f.name for f in items.schema[vendors].dataType.elementType.fields}

    def g(name, dtype="string"):
        return v[name].cast(dtype) if name in fields else F.lit(None).cast(dtype)

    return e.select(
        "item_key", F.col("pos").cast("int").alias("pos"),
        g("company").alias("company"), g("name").alias("name"), g("Vendor").alias("vendor_label"),
        g("url").alias("url"), g("services").alias("services"), g("location").alias("location"),
        g("contact").alias("contact"),
        _int_text(g("lead_time_days")).alias("lead_time_days"), _int_text(g("lead_time")).alias("lead_time"),
        _int_text(g("lead")).alias("lead"), _int_text(g("min_order_qty")).alias("min_order_qty"),
        g("source").alias("source"))


def parse_catalogue_lines(lines: DataFrame, shape: str = "items", col: str = "value") -> DataFrame:
    """S3 over JSON text: ``items`` = one ``{"MasterItemNo":..,"vendors":[..]}`` per line, or a whole
    ``{"items":[..]}`` or ``[..]`` document; ``keyed`` = ``{"<item>": [vendors..]}``."""
    if shape == "keyed":
        m = F.from_json(F.col(col), T.MapType(T.StringType(), T.ArrayType(VENDOR_STRUCT)))
        items = lines.select(F.explode(m).alias("MasterItemNo", "vendors"))
        return flatten_catalogue(items)
    doc = F.from_json(F.col(col), T.StructType(CATALOGUE_ITEM.fields + [T.StructField("items", T.ArrayType(CATALOGUE_ITEM))]))
    is_list = F.ltrim(F.col(col)).startswith("[")
    d = lines.select(F.when(~is_list, doc).alias("d"), F.when(is_list, F.from_json(F.col(col), T.ArrayType(CATALOGUE_ITEM))).alias("l"))
    single = F.when(F.col("d").isNotNull(), F.array(F.struct("d.MasterItemNo", "d.vendors")))
    return flatten_catalogue(d.select(F.explode(F.coalesce("l", "d.items", single)).alias("i")).select("i.*"))


def read_catalogue(spark, path: str, shape: str = "items", multiline: bool = False) -> DataFrame:
    """S3: vendor catalogue JSON file(s) -> flat vendor rows.

    Large feeds should be one item per line (splittable); ``multiline=True`` reads whole
    documents such as a single ``{"items": [..]}`` file.
    """
    reader = spark.read.option("wholetext", multiline)
    return parse_catalogue_lines(reader.text(path), shape=shape)


def nest_catalogue(flat: DataFrame) -> DataFrame:
    """Flat vendor rows -> one row per item with its vendors in list order."""
    vend = F.struct(*[F.col(c) for c in VENDOR_FIELDS if c in flat.columns])
    return flat.groupBy("item_key").agg(F.sort_array(F.collect_list(F.struct(F.col("pos"), vend.alias("v")))).alias("_vs")) \
        .select(F.col("item_key").alias("MasterItemNo"), F.transform("_vs", lambda x: x["v"]).alias("vendors"))


def write_catalogue(flat: DataFrame, path: str) -> str:
    """Write the nested catalogue as JSON lines (numeric keys as numbers)."""
    nested = nest_catalogue(flat)
    key = F.col("MasterItemNo")
    key_json = F.when(key.rlike(r"^\d+$"), key).otherwise(F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2))
    nested.select(F.concat(F.lit('{"MasterItemNo":'), key_json, F.lit(',"vendors":'), F.to_json("vendors"), F.lit("}")).alias("value")) \
        .write.mode("overwrite").text(path)
    return path


def first_vendor(flat: DataFrame) -> DataFrame:
    """The vendor at the first list position of each item."""
    cols = [c for c in flat.columns if c not in ("item_key",)]
    return flat.groupBy("item_key").agg(F.min_by(F.struct(*cols), F.col("pos")).alias("_v")).select("item_key", "_v.*")


def min_lead_vendor(flat: DataFrame, default_lead: int = 21) -> DataFrame:
    """The vendor with the smallest lead time (missing counts as ``default_lead``); ties -> first listed."""
    cols = [c for c in flat.columns if c not in ("item_key",)]
    order = F.struct(F.coalesce(F.col("lead_time_days"), F.lit(default_lead)).alias("l"), F.col("pos").alias("p"))
    return flat.groupBy("item_key").agg(F.min_by(F.struct(*cols), order).alias("_v")).select("item_key", "_v.*")


def tasks_policy(flat: DataFrame, default_lead: int = 14) -> DataFrame:
    """V3: first vendor; its lead time, else ``default_lead``."""
    v = first_vendor(flat)
    return v.select("item_key", F.col("company").alias("vendor_name"),
                    F.coalesce(F.col("lead_time_days"), F.lit(default_lead)).alias("lead_days"))


def _opt(df: DataFrame, name: str, dtype: str = "string"):
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def schedule_policy(flat: DataFrame) -> DataFrame:
    """V4: first vendor with the fields the schedule shows (a placeholder is added at the join)."""
    v = first_vendor(flat)
    lead = F.coalesce(F.when(_opt(v, "lead_time_days", "int") != 0, _opt(v, "lead_time_days", "int")),
                      F.when(_opt(v, "lead_time", "int") != 0, _opt(v, "lead_time", "int")))
    return v.select("item_key", _opt(v, "company").alias("VendorCompany"), _opt(v, "source").alias("VendorSource"),
                    _opt(v, "contact").alias("VendorContact"), _opt(v, "url").alias("VendorURL"),
                    lead.alias("_lead"), F.lit(True).alias("_has_vendor"))


def with_schedule_vendor(df: DataFrame, policy: DataFrame, placeholder_lead: int = 14, default_lead: int = 21) -> DataFrame:
    """J2 + V4: left lookup; items without a vendor get the placeholder vendor."""
    j = df.join(policy, "item_key", "left")
    has = F.coalesce(F.col("_has_vendor"), F.lit(False))
    return (j.withColumn("VendorCompany", F.when(has, F.col("VendorCompany")).otherwise(F.lit(PLACEHOLDER_COMPANY)))
             .withColumn("VendorSource", F.when(has, F.col("VendorSource")).otherwise(F.lit(PLACEHOLDER_SOURCE)))
             .withColumn("VendorLeadDays", F.coalesce(
                 F.col("_lead"),
                 F.when(F.col("VendorSource") == PLACEHOLDER_SOURCE, F.lit(placeholder_lead)).otherwise(F.lit(default_lead))
             ).cast("int"))
             .drop("_lead", "_has_vendor"))


def plan_policy(flat: DataFrame, default_lead: int = 21) -> DataFrame:
    """V5: smallest-lead vendor; name company/name/'Vendor', contact or url, lead default 21."""
    v = min_lead_vendor(flat, default_lead)
    name = F.coalesce(F.when(_opt(v, "company") != "", _opt(v, "company")), F.when(_opt(v, "name") != "", _opt(v, "name")),
                      F.lit("Vendor"))
    lead_cols = [c for c in ("lead_time_days", "lead_time", "lead") if c in flat.columns]
    lead = F.coalesce(*[F.when(F.col(c) != 0, F.col(c)) for c in lead_cols], F.lit(default_lead))
    return v.select("item_key", name.alias("Vendor"),
                    F.coalesce(F.when(_opt(v, "contact") != "", _opt(v, "contact")),
                               F.when(_opt(v, "url") != "", _opt(v, "url"))).alias("VendorContact"),
                    lead.cast("int").alias("VendorLeadDays"), _opt(v, "source").alias("_source"),
                    F.lit(True).alias("_has_vendor"))


def vendors_for_item(flat: DataFrame, item_keys: DataFrame) -> DataFrame:
    """Every vendor row of the requested items (semi-join keeps the item table unshuffled when small)."""
    return flat.join(item_keys.select("item_key").distinct(), "item_key", "left_semi")


def prefer_sources(ranked: DataFrame, rank_col: str = "source_rank") -> DataFrame:
    """Per item keep the vendor rows of its best available source (lowest rank).

    min(rank) per item is an aggregate + join (AQE splits a hot item), not a window that
    would hold one item's rows in one task.
    """
    best = ranked.groupBy("item_key").agg(F.min(rank_col).alias("_best"))
    return ranked.join(best, "item_key").where(F.col(rank_col) == F.col("_best")).drop("_best")
