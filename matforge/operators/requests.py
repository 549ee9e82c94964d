"""Request workflow.

Requests are an append-only change log; the current state of a request is the latest
log entry (``max_by`` per id, map-side combinable). Linking is idempotent because the
linked ids are a table and new links are found with an anti-join, not a flag rewritten
in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matforge.functions.cleaning import col_or_null, empty_to_null, first_truthy, link_qty, master_item_int
from matforge.operators.scan import running_id_fold, sequential_ids

# JSON keys read from a request; keys that differ from another only by case get a distinct
# column name (Spark resolves column names case-insensitively).
REQUEST_FIELDS = ("id", "item", "Item", "item_description", "qty", "quantity", "QtyShipped", "needed_by", "NeededBy",
                  "notes", "status", "created_at", "linked_to_procurement", "linked_at")
_COLNAME = {"Item": "item_alt"}
TASK_COLUMNS = ("MasterItemNo", "ItemDescription", "QtyShipped", "needed_by_date")


def _variant_text(v: Column, path: str) -> Column:
    # scalar at path as text (strings unquoted, numbers/booleans as written)
    return F.try_variant_get(v, path, "string")


def parse_requests(lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON documents in any accepted shape -> one row per request (text fields).

    Shapes: ``{"requests": [..]}``, ``{"data": [..]}``, ``[..]``, an object of requests by any keys, a single
    object, a JSON string holding an object, or a bare scalar (-> ``{"id": value, "status": "Pending"}``).
    ``seq`` keeps document order: (line position, element position).
    """
    doc = F.try_parse_json(F.col(col))
    d = lines.select(F.monotonically_increasing_id().alias("_line"), doc.alias("_d")).where(F.col("_d").isNotNull())
    # an object of objects that look like requests holds one request under each of its keys
    fields = F.try_variant_get("_d", "$", "map<string, variant>")
    inner = F.filter(F.map_values(fields), lambda v: F.schema_of_variant(v).startswith("OBJECT")
                     & F.coalesce(F.try_variant_get(v, "$.item", "string"), F.try_variant_get(v, "$.id", "string")).isNotNull())
    own = F.coalesce(*[F.try_variant_get("_d", f"$.{f}", "string") for f in REQUEST_FIELDS]).isNotNull()
    arr = F.coalesce(F.try_variant_get("_d", "$.requests", "array<variant>"),
                     F.try_variant_get("_d", "$.data", "array<variant>"),
                     F.try_variant_get("_d", "$", "array<variant>"),
                     F.when(~own & (F.size(inner) > 0), inner),
                     F.array(F.col("_d")))
    e = d.select("_line", F.posexplode(arr).alias("_pos", "_r"))
    # an element that is a JSON string holding a document is parsed once more
    inner = F.try_parse_json(F.try_variant_get("_r", "$", "string"))
    e = e.withColumn("_r", F.when(F.schema_of_variant("_r") == "STRING",
                                  F.coalesce(inner, F.col("_r"))).otherwise(F.col("_r")))
    is_obj = F.schema_of_variant("_r").startswith("OBJECT")
    out = e.select(
        "_line", "_pos",
        *[F.when(is_obj, _variant_text(F.col("_r"), f"$.{f}")).alias(_COLNAME.get(f, f)) for f in REQUEST_FIELDS if f != "id"],
        F.when(is_obj, _variant_text(F.col("_r"), "$.id")).otherwise(_variant_text(F.col("_r"), "$")).alias("id"))
    return out.withColumn("status", F.coalesce(F.col("status"), F.lit("Pending")))


def normalize_requests(raw: DataFrame, order: list[str]) -> DataFrame:
    """R1 + R3: integer ids (missing or unparsable ids get the next id of a running max in
    document ``order``), status default 'Pending'."""
    rid = F.trim(F.col("id").cast("string"))
    r = raw.withColumn("_raw_id", F.when(rid.rlike(r"^[+-]?\d+$"), rid.try_cast("bigint"))
                       .when(rid.rlike(r"^[+-]?\d+\.0*$"), rid.try_cast("double").try_cast("bigint")))
    r = running_id_fold(r.drop("id"), order, "_raw_id", "id").drop("_raw_id")
    return r.withColumn("status", F.coalesce(col_or_null(r, "status"), F.lit("Pending")))


def new_request_ids(existing: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """R2: new requests get max(existing id) + 1, + 2, ... in ``order``; status Pending."""
    mx = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_mx"))
    seq = sequential_ids(new, order, name="_seq", start=1)
    return seq.crossJoin(F.broadcast(mx)).withColumn("id", (F.col("_mx") + F.col("_seq")).cast("bigint")) \
        .withColumn("status", F.lit("Pending")).drop("_mx", "_seq")


def latest_status(feed: DataFrame, key: str = "id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Latest status per request from the change log (ties on time -> larger seq)."""
    return feed.groupBy(key).agg(F.max_by("status", F.struct(F.col(ts), F.col(seq))).alias("status"),
                                 F.max(ts).alias("status_ts"))


def apply_status(requests: DataFrame, latest: DataFrame) -> DataFrame:
    """Requests with their status replaced by the latest logged transition, if any."""
    l2 = latest.select(F.col("id").alias("_lid"), F.col("status").alias("_new"))
    j = requests.join(l2, requests["id"] == l2["_lid"], "left")
    return j.withColumn("status", F.coalesce(F.col("_new"), F.col("status"))).drop("_lid", "_new")


def approved_unlinked(requests: DataFrame, linked_ids: DataFrame | None = None) -> DataFrame:
    """R5 + J9: approved (trimmed, any case) and not yet linked.

    ``linked_ids`` (a table of ids) replaces the per-request flag: the anti-join makes a
    re-run find nothing new.
    """
    ok = F.lower(F.trim(F.col("status").cast("string"))) == "approved"
    flag = F.coalesce(col_or_null(requests, "linked_to_procurement", T.BooleanType()).cast("boolean"), F.lit(False))
    r = requests.where(ok & ~flag)
    if linked_ids is not None:
        r = r.join(linked_ids.select("id").distinct(), "id", "left_anti")
    return r


def request_task_rows(requests: DataFrame) -> DataFrame:
    """Request -> task row (item text, integer item key or '', integer qty, needed-by text)."""
    alt = "item_alt" if "item_alt" in requests.columns else "Item"
    itm = F.coalesce(first_truthy(col_or_null(requests, "item"), col_or_null(requests, alt),
                                  col_or_null(requests, "item_description")), F.lit(""))
    master = master_item_int(itm)
    qty = link_qty(col_or_null(requests, "qty"), col_or_null(requests, "quantity"), col_or_null(requests, "QtyShipped"))
    nb = F.coalesce(empty_to_null(col_or_null(requests, "needed_by").cast("string")),
                    empty_to_null(col_or_null(requests, "NeededBy").cast("string")), F.lit(""))
    return requests.select(F.col("id"), F.coalesce(master.cast("string"), F.lit("")).alias("MasterItemNo"),
                           itm.cast("string").alias("ItemDescription"), qty.alias("QtyShipped"), nb.alias("needed_by_date"))


def append_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Union by column name, existing columns first, new columns after; no de-duplication."""
    cols = list(existing.columns) + [c for c in new.columns if c not in existing.columns]
    out = existing.unionByName(new, allowMissingColumns=True)
    return out.select(*cols)


def link_requests(tasks: DataFrame, requests: DataFrame, linked_ids: DataFrame | None = None,
                  linked_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(tasks with the new request rows appended, newly linked ids with their link time)."""
    new = approved_unlinked(requests, linked_ids)
    rows = request_task_rows(new)
    at = linked_at if linked_at is not None else F.current_timestamp()
    newly = rows.select("id", at.alias("linked_at"))
    tasks_str = tasks.select(*[F.col(c).cast("string").alias(c) if c in ("MasterItemNo",) else F.col(c) for c in tasks.columns])
    return append_rows(tasks_str, rows.drop("id")), newly
