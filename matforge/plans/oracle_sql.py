"""Oracle SQL per registered query (DuckDB dialect)."""

from __future__ import annotations

from matforge.plans.oracle import KEY, with_ctes

ORACLE: dict[str, str] = {}

ORACLE["v1_procurement_tasks"] = with_ctes(["predictions", "vendor_rows"], f"""
, agg AS (SELECT {KEY('MasterItemNo')} AS item_key, sum(CAST(QtyShipped AS DOUBLE)) AS Qty
          FROM predictions WHERE {KEY('MasterItemNo')} IS NOT NULL GROUP BY 1)
, firstv AS (SELECT item_key, company, lead_time_days FROM vendor_rows WHERE pos = 0)
SELECT a.item_key AS MasterItemNo, a.Qty,
  coalesce(CASE WHEN f.company <> '' THEN f.company END, 'TBD') AS preferred_vendor,
  CAST(coalesce(f.lead_time_days, 14) AS INTEGER) AS lead_time_days,
  CAST(DATE '1998-03-31' - CAST(greatest(coalesce(f.lead_time_days, 14), 7) AS INTEGER) AS DATE) AS procurement_start,
  DATE '1998-03-31' AS procurement_end, DATE '1998-04-01' AS expected_delivery
FROM agg a LEFT JOIN firstv f ON a.item_key = f.item_key""")

ORACLE["a1_demand_per_item"] = with_ctes(["line_items"], f"""
SELECT {KEY('MasterItemNo')} AS item_key,
  sum(TRY_CAST(regexp_replace(QtyShipped, '[^0-9.]', '', 'g') AS DOUBLE)) AS Qty
FROM line_items WHERE {KEY('MasterItemNo')} IS NOT NULL GROUP BY 1""")

from matforge.plans.oracle import (LINKQTY, MASTER_INT, NUMTXT, PDATE, PHASE, PLANQTY, STRIP_NUM,  # noqa: E402
                                   TRUTHY)

# ---------------------------------------------------------------------------
# C
# ---------------------------------------------------------------------------
ORACLE["c1_clean_currency"] = with_ctes(["line_items"], "SELECT " + ", ".join(
    f"{STRIP_NUM(c)} AS {c}_clean" for c in ("invoiceTotal", "UnitPrice", "ExtendedPrice", "REVISED_ESTIMATE"))
    + " FROM line_items")

ORACLE["c2_safe_to_numeric"] = with_ctes(["line_items"], "SELECT " + ", ".join(
    f"{STRIP_NUM(c)} AS {c}_clean" for c in ("QtyShipped", "ExtendedQuantity", "NUMFLOORS", "SIZE_BUILDINGSIZE"))
    + " FROM line_items")

ORACLE["c3_to_numeric"] = with_ctes(["line_items"], f"""
SELECT {NUMTXT('SIZE_BUILDINGSIZE')} AS size_num, {NUMTXT('QtyShipped')} AS qty_num,
       {NUMTXT('ExtendedQuantity')} AS ext_qty_num FROM line_items""")

ORACLE["c4_plan_qty"] = with_ctes(["requests"], f"""
SELECT id, {PLANQTY('qty')} AS qty_plan, CAST(1 AS BIGINT) AS too_large, {PLANQTY("CAST(id AS VARCHAR) || '.5'")} AS half_even FROM requests""")

ORACLE["c5_link_qty"] = with_ctes(["requests"], f"SELECT id, {LINKQTY('qty')} AS qty_int FROM requests")

ORACLE["c6_item_key"] = with_ctes(["requests"], f"""
SELECT id, item, {KEY('item')} AS item_key, '00' || CAST(id AS VARCHAR) AS padded_key, CAST(id AS VARCHAR) || 'E5' AS letter_key, {MASTER_INT('item')} AS master_item FROM requests""")

ORACLE["c7_parse_dates"] = with_ctes(["line_items"], "SELECT " + ", ".join(
    f"{PDATE(c)} AS {c}_dt" for c in ("invoiceDate", "CONSTRUCTION_START_DATE", "SUBSTANTIAL_COMPLETION_DATE"))
    + ", NULL::DATE AS iso_dt, NULL::DATE AS slash_dt, NULL::DATE AS minute_dt FROM line_items UNION ALL"
    + " SELECT NULL, NULL, NULL, CAST(l_shipdate AS DATE), CAST(l_shipdate AS DATE), CAST(l_shipdate AS DATE) FROM lineitem")

_CLEAN = f"""
, cleaned AS (SELECT *, {PDATE('invoiceDate')} AS inv_dt, {PDATE('CONSTRUCTION_START_DATE')} AS start_dt,
   {PDATE('SUBSTANTIAL_COMPLETION_DATE')} AS end_dt,
   {STRIP_NUM('SIZE_BUILDINGSIZE')} AS SIZE_BUILDINGSIZE_clean, {STRIP_NUM('NUMFLOORS')} AS NUMFLOORS_clean,
   {STRIP_NUM('ExtendedPrice')} AS ExtendedPrice_clean, {STRIP_NUM('ExtendedQuantity')} AS ExtendedQuantity_clean,
   {STRIP_NUM('QtyShipped')} AS QtyShipped_clean
   FROM line_items)"""

ORACLE["c8_calendar_features"] = with_ctes(["line_items"], _CLEAN + """
SELECT CAST(month(inv_dt) AS INTEGER) AS invoiceDate_month, CAST(isodow(inv_dt) - 1 AS INTEGER) AS invoiceDate_dow,
       CAST(week(inv_dt) AS INTEGER) AS invoiceDate_week, CAST(quarter(inv_dt) AS INTEGER) AS invoiceDate_quarter
FROM cleaned""")

ORACLE["c9_project_days"] = with_ctes(["line_items"], _CLEAN + """
SELECT CAST(date_diff('day', start_dt, end_dt) AS INTEGER) AS project_duration_days,
       CAST(date_diff('day', start_dt, inv_dt) AS INTEGER) AS project_age_days FROM cleaned""")

ORACLE["c10_size_per_floor"] = with_ctes(["line_items"], _CLEAN + """
SELECT SIZE_BUILDINGSIZE_clean, NUMFLOORS_clean, SIZE_BUILDINGSIZE_clean / nullif(NUMFLOORS_clean, 0) AS size_per_floor
FROM cleaned""")

ORACLE["c11_cost_per_unit"] = with_ctes(["line_items"], _CLEAN + """
SELECT ExtendedPrice_clean, coalesce(ExtendedPrice_clean / nullif(ExtendedQuantity_clean, 0),
                                     ExtendedPrice_clean / nullif(QtyShipped_clean, 0)) AS material_cost_per_unit
FROM cleaned""")

ORACLE["c12_clean_text"] = with_ctes(["line_items"], """
SELECT ItemDescription, trim(regexp_replace(regexp_replace(lower(coalesce(ItemDescription, '')), '[^a-z0-9 ]', ' ', 'g'),
                                            '\\s+', ' ', 'g')) AS ItemDescription_clean FROM line_items""")

ORACLE["c13_basic_features"] = with_ctes(["line_items"], f"""
SELECT coalesce(PROJECT_CITY, 'missing') AS PROJECT_CITY, coalesce(PROJECT_TYPE, 'missing') AS PROJECT_TYPE,
       coalesce(CORE_MARKET, 'missing') AS CORE_MARKET, coalesce(UOM, 'missing') AS UOM,
       coalesce({NUMTXT('SIZE_BUILDINGSIZE')}, 0.0) AS SIZE_BUILDINGSIZE_num,
       count(*) OVER (PARTITION BY coalesce(PROJECTNUMBER, 'NA')) AS PROJECT_FREQ
FROM line_items""")

ORACLE["c14_labelled_rows"] = with_ctes(["line_items"], """
SELECT trim(MasterItemNo) AS label_raw FROM line_items WHERE MasterItemNo IS NOT NULL""")

_MODE_BLANK = f"""
, dcount AS (SELECT {KEY('MasterItemNo')} AS item_key, coalesce(ItemDescription, '') AS d, count(*) AS n
             FROM line_items WHERE {KEY('MasterItemNo')} IS NOT NULL GROUP BY 1, 2)
, dmode AS (SELECT item_key, d AS ItemDescription FROM (
    SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY n DESC, d ASC) AS rn FROM dcount) WHERE rn = 1)"""

_MODE = f"""
, mcount AS (SELECT {KEY('MasterItemNo')} AS item_key, ItemDescription AS d, count(*) AS n
             FROM line_items WHERE {KEY('MasterItemNo')} IS NOT NULL AND ItemDescription IS NOT NULL GROUP BY 1, 2)
, mmode AS (SELECT item_key, d AS ItemDescription FROM (
    SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY n DESC, d ASC) AS rn FROM mcount) WHERE rn = 1)"""

_ITEMS = f"""
, items AS (SELECT DISTINCT {KEY('MasterItemNo')} AS item_key FROM predictions WHERE {KEY('MasterItemNo')} IS NOT NULL)"""

ORACLE["c15_short_label"] = with_ctes(["line_items", "predictions"], _MODE_BLANK + _ITEMS + """
SELECT i.item_key, array_to_string(list_slice(list_filter(string_split_regex(
    trim(coalesce(m.ItemDescription, 'Item ' || i.item_key)), '\\s+'), lambda x: x <> ''), 1, 5), ' ') AS label
FROM items i LEFT JOIN dmode m ON i.item_key = m.item_key""")

ORACLE["c16_timeline_task_name"] = with_ctes(["line_items"], """
SELECT 'Procure: ' || coalesce(nullif(substr(ItemDescription, 1, 40), ''), nullif(substr(MasterItemNo, 1, 40), ''),
                               'row_' || NULL) AS Task FROM line_items""")

ORACLE["c17_finalize_predictions"] = with_ctes(["requests"], f"""
SELECT CAST(id AS BIGINT) AS id, coalesce({MASTER_INT('item')}, CAST(0 AS BIGINT)) AS MasterItemNo,
       coalesce({NUMTXT('qty')}, 0.0) AS QtyShipped FROM requests""")

_LI_COLS = ["PROJECTNUMBER", "PROJECT_CITY", "PROJECT_TYPE", "CORE_MARKET", "UOM", "MasterItemNo", "ItemDescription",
            "QtyShipped", "ExtendedQuantity", "ExtendedPrice", "UnitPrice", "invoiceTotal", "REVISED_ESTIMATE",
            "NUMFLOORS", "SIZE_BUILDINGSIZE", "invoiceDate", "CONSTRUCTION_START_DATE", "SUBSTANTIAL_COMPLETION_DATE"]

ORACLE["c18_sequential_ids"] = with_ctes(["line_items"], "SELECT *, row_number() OVER (ORDER BY "
                                         + ", ".join(f"{c} ASC NULLS FIRST" for c in _LI_COLS)
                                         + ") AS id FROM line_items")

# ---------------------------------------------------------------------------
# A
# ---------------------------------------------------------------------------
ORACLE["a2_median_per_item"] = with_ctes(["line_items"], f"""
SELECT {KEY('MasterItemNo')} AS item_key, median({STRIP_NUM('QtyShipped')}) AS median_qty
FROM line_items WHERE {KEY('MasterItemNo')} IS NOT NULL GROUP BY 1""")

ORACLE["a3_global_median"] = with_ctes(["line_items"], f"""
SELECT coalesce(median({STRIP_NUM('QtyShipped')}), 1.0) AS global_median FROM line_items""")

ORACLE["a4_mode_description"] = with_ctes(["line_items"], _MODE + " SELECT item_key, ItemDescription FROM mmode")

ORACLE["a5_most_frequent_item"] = with_ctes(["line_items"], f"""
SELECT item_key FROM (SELECT {KEY('MasterItemNo')} AS item_key, count(*) AS n FROM line_items
                      WHERE {KEY('MasterItemNo')} IS NOT NULL GROUP BY 1)
ORDER BY n DESC, TRY_CAST(item_key AS DOUBLE) IS NULL, TRY_CAST(item_key AS DOUBLE), item_key LIMIT 1""")

ORACLE["a6_large_project_flag"] = with_ctes(["line_items"], _CLEAN + """
SELECT SIZE_BUILDINGSIZE_clean,
       coalesce(CAST(SIZE_BUILDINGSIZE_clean > quantile_cont(SIZE_BUILDINGSIZE_clean, 0.75) OVER () AS INTEGER), 0)
         AS is_large_project
FROM cleaned""")

_A7_COLS = {"invoiceTotal": "c", "UnitPrice": "c", "ExtendedPrice": "c", "REVISED_ESTIMATE": "c",
            "QtyShipped": "q", "ExtendedQuantity": "q", "NUMFLOORS": "q", "SIZE_BUILDINGSIZE": "q"}
ORACLE["a7_median_imputation"] = with_ctes(["line_items"], "\n, a7 AS (SELECT " + ", ".join(
    f"{STRIP_NUM(c)} AS {c}_clean" for c in _A7_COLS) + " FROM line_items)\nSELECT " + ", ".join(
    f"coalesce({c}_clean, median({c}_clean) OVER ()) AS {c}_clean" for c in _A7_COLS)
    + ", coalesce(CAST(SIZE_BUILDINGSIZE_clean > quantile_cont(SIZE_BUILDINGSIZE_clean, 0.75) OVER () AS INTEGER), 0)"
      " AS is_large_project FROM a7")

ORACLE["a8_project_frequency"] = with_ctes(["line_items"], """
SELECT PROJECTNUMBER, count(*) OVER (PARTITION BY coalesce(PROJECTNUMBER, 'NA')) AS PROJECT_FREQ FROM line_items""")

ORACLE["a9_top_items"] = with_ctes(["predictions"], """
SELECT CAST(MasterItemNo AS VARCHAR) AS MasterItemNo, count(*) AS count FROM predictions
GROUP BY 1 ORDER BY count DESC, MasterItemNo ASC LIMIT 20""")

ORACLE["a10_distinct_vendors"] = with_ctes(["vendor_rows"], "SELECT count(DISTINCT company) AS unique_vendors FROM vendor_rows")

ORACLE["a14_label_codes"] = with_ctes(["line_items"], f"""
SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS code,
       CAST(dense_rank() OVER (ORDER BY label) AS BIGINT) AS code1
FROM (SELECT DISTINCT {KEY('MasterItemNo')} AS label FROM line_items WHERE MasterItemNo IS NOT NULL)""")

# ---------------------------------------------------------------------------
# J / W
# ---------------------------------------------------------------------------
ORACLE["j1_join_truth_prediction"] = with_ctes(["truth", "pred"], """
SELECT t.id, t.MasterItemNo AS MasterItemNo_true, t.QtyShipped AS QtyShipped_true,
       p.MasterItemNo AS MasterItemNo_pred, p.QtyShipped AS QtyShipped_pred
FROM truth t JOIN pred p ON t.id = p.id""")

_PLANV = """
, planv AS (SELECT item_key, coalesce(CASE WHEN company <> '' THEN company END, 'Vendor') AS Vendor,
      coalesce(CASE WHEN contact <> '' THEN contact END, CASE WHEN url <> '' THEN url END) AS VendorContact,
      CAST(coalesce(nullif(lead_time_days, 0), 21) AS INTEGER) AS VendorLeadDays, source
    FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY coalesce(lead_time_days, 21), pos) AS rn
          FROM vendor_rows) WHERE rn = 1)"""

ORACLE["j2_item_vendor_lookup"] = with_ctes(["predictions", "vendor_rows"], _ITEMS + _PLANV + """
SELECT i.item_key, v.Vendor, v.VendorContact, v.VendorLeadDays FROM items i LEFT JOIN planv v ON i.item_key = v.item_key""")

ORACLE["j3_item_description_lookup"] = with_ctes(["predictions", "line_items"], _ITEMS + _MODE + """
SELECT i.item_key, m.ItemDescription FROM items i LEFT JOIN mmode m ON i.item_key = m.item_key""")

ORACLE["j4_item_median_lookup"] = with_ctes(["predictions", "line_items"], _ITEMS + f"""
, med AS (SELECT {KEY('MasterItemNo')} AS item_key, median({STRIP_NUM('QtyShipped')}) AS median_qty
          FROM line_items WHERE {KEY('MasterItemNo')} IS NOT NULL GROUP BY 1)
SELECT i.item_key, m.median_qty FROM items i LEFT JOIN med m ON i.item_key = m.item_key""")

ORACLE["j5_phase_window_lookup"] = with_ctes(["line_items", "schedule"], f"""
, lines AS (SELECT {KEY('MasterItemNo')} AS item_key, {PHASE('ItemDescription')} AS Phase FROM line_items)
SELECT l.item_key, l.Phase, s."Start" AS PhaseStart, s.Finish AS PhaseFinish
FROM lines l LEFT JOIN schedule s ON l.Phase = s.Task""")

ORACLE["j6_keyword_phase"] = with_ctes(["line_items"], f"""
SELECT {KEY('MasterItemNo')} AS item_key, ItemDescription, {PHASE('ItemDescription')} AS Phase FROM line_items""")

_CODED = ("PROJECT_CITY", "PROJECT_TYPE", "CORE_MARKET", "UOM")
ORACLE["j7_category_codes"] = with_ctes(["line_items"], ", te AS (SELECT DISTINCT CASE WHEN NUMFLOORS = '5' THEN PROJECT_CITY || ' (new)' WHEN NUMFLOORS <> '6' THEN PROJECT_CITY END AS PROJECT_CITY, PROJECT_TYPE, CORE_MARKET, UOM FROM line_items)\n"
    + "".join(f", {c}_c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce({c}, '__MISSING__') AS v FROM line_items))\n" for c in _CODED)
    + "SELECT te.*, " + ", ".join(f"CAST(coalesce({c}_c.code, (SELECT count(*) FROM {c}_c)) AS BIGINT) AS {c}_code" for c in _CODED)
    + " FROM te " + " ".join(f"LEFT JOIN {c}_c ON coalesce(te.{c}, '__MISSING__') = {c}_c.v" for c in _CODED))

ORACLE["j8_vendors_for_top_items"] = with_ctes(["predictions", "vendor_rows"], f"""
, asked AS (SELECT DISTINCT {KEY('MasterItemNo')} AS item_key FROM predictions WHERE QtyShipped >= 49)
SELECT item_key, pos, company, url, contact, lead_time_days, source FROM vendor_rows
WHERE item_key IN (SELECT item_key FROM asked)""")

ORACLE["j9_unlinked_anti_join"] = with_ctes(["requests"], """
SELECT id FROM requests WHERE lower(trim(status)) = 'approved'
AND id NOT IN (SELECT id FROM requests WHERE linked_to_procurement)""")

ORACLE["w1_first_vendor"] = with_ctes(["vendor_rows"], "SELECT item_key, pos, company, lead_time_days FROM vendor_rows WHERE pos = 0")

ORACLE["w2_min_lead_vendor"] = with_ctes(["vendor_rows"], """
SELECT item_key, pos, company, lead_time_days FROM (
  SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY coalesce(lead_time_days, 21), pos) AS rn FROM vendor_rows)
WHERE rn = 1""")

# ---------------------------------------------------------------------------
# V
# ---------------------------------------------------------------------------
ORACLE["v3_tasks_vendor_policy"] = with_ctes(["vendor_rows"], """
SELECT item_key, company AS vendor_name, coalesce(lead_time_days, 14) AS lead_days FROM vendor_rows WHERE pos = 0""")

_SCHEDV = """
, firstv AS (SELECT * FROM vendor_rows WHERE pos = 0)"""

ORACLE["v4_schedule_vendor_policy"] = with_ctes(["predictions", "vendor_rows"], _ITEMS + _SCHEDV + """
SELECT i.item_key,
  CASE WHEN f.item_key IS NOT NULL THEN f.company ELSE 'Placeholder Vendor' END AS VendorCompany,
  CASE WHEN f.item_key IS NOT NULL THEN f.source ELSE 'placeholder' END AS VendorSource,
  f.contact AS VendorContact, f.url AS VendorURL,
  CAST(coalesce(nullif(f.lead_time_days, 0),
       CASE WHEN (CASE WHEN f.item_key IS NOT NULL THEN f.source ELSE 'placeholder' END) = 'placeholder' THEN 14 ELSE 21 END)
       AS INTEGER) AS VendorLeadDays
FROM items i LEFT JOIN firstv f ON i.item_key = f.item_key""")

ORACLE["v5_plan_vendor_policy"] = with_ctes(["vendor_rows"], _PLANV + " SELECT item_key, Vendor, VendorContact, VendorLeadDays FROM planv")

# V1 tasks + modal description + linked request rows
_TASKS = f"""
, agg AS (SELECT {KEY('MasterItemNo')} AS item_key, sum(CAST(QtyShipped AS DOUBLE)) AS Qty
          FROM predictions WHERE {KEY('MasterItemNo')} IS NOT NULL GROUP BY 1)
, tfirst AS (SELECT item_key, company, lead_time_days FROM vendor_rows WHERE pos = 0)
, tasks AS (SELECT a.item_key AS MasterItemNo, a.Qty,
    coalesce(CASE WHEN f.company <> '' THEN f.company END, 'TBD') AS preferred_vendor,
    CAST(coalesce(f.lead_time_days, 14) AS INTEGER) AS lead_time_days,
    CAST(DATE '1998-03-31' - CAST(greatest(coalesce(f.lead_time_days, 14), 7) AS INTEGER) AS DATE) AS procurement_start,
    DATE '1998-03-31' AS procurement_end, DATE '1998-04-01' AS expected_delivery
  FROM agg a LEFT JOIN tfirst f ON a.item_key = f.item_key)
, newreq AS (SELECT * FROM requests WHERE lower(trim(status)) = 'approved'
             AND id NOT IN (SELECT id FROM requests WHERE linked_to_procurement))
, reqrows AS (SELECT id, coalesce(CAST({MASTER_INT(f"coalesce({TRUTHY('item')}, '')")} AS VARCHAR), '') AS MasterItemNo,
    CAST(coalesce({TRUTHY('item')}, '') AS VARCHAR) AS ItemDescription, {LINKQTY('qty')} AS QtyShipped,
    coalesce(nullif(needed_by, ''), '') AS needed_by_date FROM newreq)"""

ORACLE["r7_link_requests"] = with_ctes(["predictions", "vendor_rows", "requests"], _TASKS + """
SELECT MasterItemNo, Qty, preferred_vendor, lead_time_days, procurement_start, procurement_end, expected_delivery,
       NULL::VARCHAR AS ItemDescription, NULL::BIGINT AS QtyShipped, NULL::VARCHAR AS needed_by_date FROM tasks
UNION ALL
SELECT MasterItemNo, NULL, NULL, NULL, NULL, NULL, NULL, ItemDescription, QtyShipped, needed_by_date FROM reqrows""")

ORACLE["v12_needed_by_resolution"] = with_ctes(["predictions", "vendor_rows", "requests"], _TASKS + f"""
SELECT MasterItemNo, CAST(NULL AS DATE) AS NeededBy FROM tasks
UNION ALL SELECT MasterItemNo, {PDATE('needed_by_date')} AS NeededBy FROM reqrows""")

_ENRICHED = _TASKS + _MODE + f"""
, alltasks AS (
  SELECT t.MasterItemNo, t.Qty, m.ItemDescription, NULL::BIGINT AS QtyShipped, NULL::VARCHAR AS needed_by_date
  FROM tasks t LEFT JOIN mmode m ON t.MasterItemNo = m.item_key
  UNION ALL SELECT MasterItemNo, NULL, ItemDescription, QtyShipped, needed_by_date FROM reqrows)
, base AS (SELECT coalesce(nullif(ItemDescription, ''), '') AS ItemDescription, MasterItemNo,
    {KEY('MasterItemNo')} AS item_key,
    coalesce(nullif(TRY_CAST(QtyShipped AS DOUBLE), 0), nullif(TRY_CAST(Qty AS DOUBLE), 0)) AS Qty,
    {PDATE('needed_by_date')} AS req_needed FROM alltasks)
, phased AS (SELECT *, {PHASE("ItemDescription || ' ' || coalesce(MasterItemNo, '')")} AS Phase FROM base)
, sfirst AS (SELECT * FROM vendor_rows WHERE pos = 0)
, enriched AS (
  SELECT p.Phase, s."Start" AS PhaseStart, s.Finish AS PhaseFinish, p.ItemDescription, p.MasterItemNo, p.Qty,
    CASE WHEN f.item_key IS NOT NULL THEN f.company ELSE 'Placeholder Vendor' END AS VendorCompany,
    CASE WHEN f.item_key IS NOT NULL THEN f.source ELSE 'placeholder' END AS VendorSource,
    f.contact AS VendorContact, f.url AS VendorURL,
    CAST(coalesce(nullif(f.lead_time_days, 0),
      CASE WHEN (CASE WHEN f.item_key IS NOT NULL THEN f.source ELSE 'placeholder' END) = 'placeholder' THEN 14 ELSE 21 END)
      AS INTEGER) AS VendorLeadDays,
    coalesce(p.req_needed, s.Finish) AS NeededBy
  FROM phased p LEFT JOIN schedule s ON p.Phase = s.Task LEFT JOIN sfirst f ON p.item_key = f.item_key)
, enriched2 AS (SELECT *, greatest(CAST(NeededBy - (VendorLeadDays + 3) AS DATE), DATE '1998-01-01') AS ProcurementStart,
    NeededBy AS ProcurementFinish FROM enriched)"""

ORACLE["v6_schedule_alignment"] = with_ctes(["predictions", "vendor_rows", "requests", "line_items", "schedule"],
                                            _ENRICHED + """
SELECT Phase, PhaseStart, PhaseFinish, ItemDescription, MasterItemNo, Qty, VendorCompany, VendorSource, VendorContact,
       VendorURL, VendorLeadDays, ProcurementStart, ProcurementFinish, NeededBy FROM enriched2""")

ORACLE["v7_timeline"] = with_ctes(["predictions", "vendor_rows", "requests", "line_items", "schedule"], _ENRICHED + """
SELECT Task, "Start", Finish, 'Project Phase' AS Resource, 'Phase' AS Type FROM schedule
UNION ALL
SELECT 'Procure: ' || coalesce(nullif(substr(ItemDescription, 1, 40), ''), nullif(substr(MasterItemNo, 1, 40), ''),
                               'row_' || NULL) AS Task,
  coalesce(ProcurementStart, CAST(ProcurementFinish - 1 AS DATE)) AS "Start",
  coalesce(ProcurementFinish, CAST(ProcurementStart + 1 AS DATE)) AS Finish,
  coalesce(nullif(VendorCompany, ''), 'Unknown Vendor') AS Resource, 'Procurement' AS Type
FROM enriched2 WHERE ProcurementStart IS NOT NULL OR ProcurementFinish IS NOT NULL""")

_PLAN = _MODE + _PLANV + f"""
, pbase AS (SELECT {KEY('MasterItemNo')} AS item_key, {PLANQTY('QtyShipped')} AS PredictedQty FROM predictions)
, pdesc AS (SELECT b.*, coalesce(nullif(m.ItemDescription, ''), '') AS ItemDescription
            FROM pbase b LEFT JOIN mmode m ON b.item_key = m.item_key)
, pphase AS (SELECT *, {PHASE('ItemDescription')} AS ProjectPhase FROM pdesc)
, pj AS (SELECT p.*, coalesce(s.Finish, DATE '1998-04-21') AS NeededBy, v.Vendor, v.VendorContact,
           v.item_key IS NOT NULL AS has_vendor, v.source AS vsource,
           CAST(CASE WHEN v.item_key IS NOT NULL THEN v.VendorLeadDays ELSE 21 END AS INTEGER) AS VendorLeadDays
         FROM pphase p LEFT JOIN schedule s ON p.ProjectPhase = s.Task LEFT JOIN planv v ON p.item_key = v.item_key)
, pk AS (SELECT *, CAST(greatest(1, ceil(CAST(PredictedQty AS DOUBLE) * CAST(0.1 AS DOUBLE))) AS BIGINT) AS SafetyStock FROM pj)
, plan AS (SELECT item_key AS MasterItemNo, ItemDescription, PredictedQty, SafetyStock,
    greatest(CAST(1 AS BIGINT), PredictedQty + SafetyStock) AS RecommendedOrderQty, Vendor, VendorContact, VendorLeadDays,
    greatest(CAST(NeededBy - (VendorLeadDays + 3) AS DATE), DATE '1998-01-01') AS ProcurementStart,
    NeededBy AS ProcurementFinish, NeededBy, ProjectPhase,
    CASE WHEN PredictedQty + SafetyStock > 1000 THEN 'Multiple orders (staged deliveries)'
         WHEN PredictedQty + SafetyStock > 100 THEN 'Consider 2-stage procurement' ELSE 'Single order' END AS ProcurementCycle,
    concat_ws('; ', CASE WHEN NOT has_vendor THEN 'No vendor in DB — sourcing risk' END,
                    CASE WHEN VendorLeadDays >= 30 THEN 'Long supplier lead time' END,
                    CASE WHEN has_vendor AND contains(lower(coalesce(vsource, '')), 'import') THEN 'Import dependency' END)
      AS RiskNotes,
    concat_ws('; ', CASE WHEN NOT has_vendor THEN 'Identify alternate vendors; consider higher safety stock; allow longer lead time' END,
                    CASE WHEN VendorLeadDays >= 30 THEN 'Pre-book orders; negotiate faster lead time or local stocking' END,
                    CASE WHEN has_vendor AND contains(lower(coalesce(vsource, '')), 'import')
                         THEN 'Account for customs and transport delays; increase safety stock' END) AS Mitigations
  FROM pk)"""

_PLAN_NEEDS = ["predictions", "vendor_rows", "line_items", "schedule"]
ORACLE["v8_procurement_plan"] = with_ctes(_PLAN_NEEDS, _PLAN + " SELECT * FROM plan")
ORACLE["v9_order_cycle"] = with_ctes(_PLAN_NEEDS, """, totals AS (SELECT MasterItemNo, sum(QtyShipped) AS q FROM predictions GROUP BY 1)
, demand AS (SELECT MasterItemNo, CASE WHEN MasterItemNo % 3 = 0 THEN floor(q / 10) ELSE q END AS QtyShipped FROM totals)""" + _PLAN.replace(
    "FROM predictions)", "FROM demand)") + """
SELECT ProcurementCycle, count(*) AS n, min(RecommendedOrderQty) AS min_order, max(RecommendedOrderQty) AS max_order
FROM plan GROUP BY 1""")
ORACLE["v10_risk_notes"] = with_ctes(_PLAN_NEEDS, _PLAN + " SELECT RiskNotes, Mitigations, count(*) AS n FROM plan GROUP BY 1, 2")
ORACLE["v11_plan_summary"] = with_ctes(_PLAN_NEEDS, _PLAN + """
SELECT count(*) AS total_items, count(DISTINCT Vendor) AS unique_vendors, CAST(sum(PredictedQty) AS BIGINT) AS total_qty
FROM plan""")
ORACLE["a12_top_risks"] = with_ctes(_PLAN_NEEDS, _PLAN + """
SELECT * FROM (SELECT RiskNotes, count(*) AS count FROM plan GROUP BY 1 ORDER BY count DESC, RiskNotes ASC LIMIT 10)
WHERE RiskNotes <> ''""")
ORACLE["w4_plan_sample"] = with_ctes(_PLAN_NEEDS, _PLAN + " SELECT * FROM plan ORDER BY " + ", ".join(
    f"{c} ASC NULLS LAST" for c in ("MasterItemNo", "ItemDescription", "PredictedQty", "SafetyStock",
                                    "RecommendedOrderQty", "Vendor", "VendorContact", "VendorLeadDays",
                                    "ProcurementStart", "ProcurementFinish", "NeededBy", "ProjectPhase",
                                    "ProcurementCycle", "RiskNotes", "Mitigations")) + " LIMIT 20")

# ---------------------------------------------------------------------------
# R
# ---------------------------------------------------------------------------
ORACLE["r1_parse_requests"] = with_ctes(["requests"], """
SELECT CAST(id AS VARCHAR) AS id, item, qty, needed_by, notes, coalesce(status, 'Pending') AS status, created_at,
       CAST(linked_to_procurement AS VARCHAR) AS linked_to_procurement FROM requests""")

ORACLE["r2_new_request_ids"] = """
SELECT CAST((SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS id,
       event_id, 'Item ' || CAST(user_id AS VARCHAR) AS item, 'Pending' AS status
FROM events WHERE event_type = 'purchase'"""

ORACLE["r3_running_id_fold"] = """
WITH r AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey END AS x
           FROM orders),
s AS (SELECT pos, x, sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS e FROM r),
t AS (SELECT pos, x, e, max(x - e) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS m FROM s)
SELECT pos, CAST(CASE WHEN x IS NOT NULL THEN x ELSE e + greatest(0, coalesce(m, 0)) END AS BIGINT) AS id,
       'Pending' AS status FROM t"""

ORACLE["r4_latest_status"] = with_ctes(["request_feed"], """
SELECT id, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) AS rn FROM request_feed)
WHERE rn = 1""")

ORACLE["r5_approved_unlinked"] = with_ctes(["requests"], """
SELECT id, item, qty, status FROM requests WHERE lower(trim(status)) = 'approved' AND NOT coalesce(linked_to_procurement, false)""")

ORACLE["r6_request_task_rows"] = with_ctes(["requests"], f"""
SELECT id, coalesce(CAST({MASTER_INT(f"coalesce({TRUTHY('item')}, '')")} AS VARCHAR), '') AS MasterItemNo,
       CAST(coalesce({TRUTHY('item')}, '') AS VARCHAR) AS ItemDescription, {LINKQTY('qty')} AS QtyShipped,
       coalesce(nullif(needed_by, ''), '') AS needed_by_date
FROM requests WHERE lower(trim(status)) = 'approved' AND NOT coalesce(linked_to_procurement, false)""")

# ---------------------------------------------------------------------------
# X
# ---------------------------------------------------------------------------
_ANCHOR = """(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>"'']+)[^>]*>(.*?)</a>"""


def _html_text(x: str) -> str:
    s = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        s = f"replace({s}, '{a}', '{b}')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


_ANCHORS = f"""
anchors AS (
  SELECT page_id, url AS page_url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin,
         regexp_replace(unnest(regexp_extract_all(html, '{_ANCHOR}', 1)), '^["'']|["'']$', '', 'g') AS href,
         unnest(regexp_extract_all(html, '{_ANCHOR}', 2)) AS atext,
         generate_subscripts(regexp_extract_all(html, '{_ANCHOR}', 1), 1) AS apos
  FROM pages),
named AS (SELECT *, {_html_text('atext')} AS company FROM anchors),
firsts AS (SELECT *, row_number() OVER (PARTITION BY page_id, company || href ORDER BY apos) AS krn
           FROM named WHERE company <> ''),
kept AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY apos) AS rank FROM firsts WHERE krn = 1),
pv AS (SELECT page_id, CAST(rank AS INTEGER) AS rank, company,
              CASE WHEN starts_with(href, 'http') THEN href ELSE origin || href END AS url,
              regexp_extract(page_url, '^https?://([^/?#]+)', 1) AS source
       FROM kept)"""

ORACLE["x1_page_vendors"] = "WITH " + _ANCHORS + "\nSELECT * FROM pv"
ORACLE["v2_page_vendor_dedupe"] = "WITH " + _ANCHORS + """
SELECT page_id, count(*) AS n_vendors, max(rank) AS max_rank FROM pv GROUP BY 1"""

ORACLE["x2_loose_links"] = "WITH " + _ANCHORS + """
, loose AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY apos) AS rank FROM named
            WHERE (contains(href, 'tion') OR contains(href, 'and') OR contains(href, 'the')) AND company <> '')
SELECT page_id, CAST(rank AS INTEGER) AS rank, company,
       CASE WHEN starts_with(href, 'http') THEN href ELSE origin || href END AS url
FROM loose"""

_PHONE = "(\\+?\\p{Nd}{2,4}[-\\t\\n\\f\\r ]?)?(\\p{Nd}{6,12})"
_EMAIL = "[\\p{L}\\p{N}_.-]+@[\\p{L}\\p{N}_.-]+\\.[\\p{L}\\p{N}_]+"
ORACLE["x3_contact_mining"] = f"""
SELECT doc_id, CASE WHEN p <> '' AND e <> '' THEN p || '; ' || e WHEN p <> '' THEN p WHEN e <> '' THEN e END AS contact
FROM (SELECT doc_id, regexp_extract(text, '{_PHONE}', 0) AS p, regexp_extract(text, '{_EMAIL}', 0) AS e FROM documents)"""

def _PLAIN(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


# The blocks of the listing pages are what they were made of: one for each different link of a page.
ORACLE["x1_result_blocks"] = f"""
WITH l AS (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) AS href,
   unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) AS t, generate_subscripts(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2), 1) AS ord FROM pages)
, b AS (SELECT page_id, page_url, ord, CASE WHEN page_id % 4 <> 2 THEN href END AS href, {_PLAIN('t')} AS t, substr(regexp_extract(page_url, '^https?://([^/?#]+)', 1), 1, 12) AS city,
   ' Tel 80' || lpad(CAST(page_id AS VARCHAR), 7, '0') || ' sales' || CAST(page_id AS VARCHAR) || '@example.com' AS more FROM l)
, x AS (SELECT *, trim(t || CASE WHEN page_id % 4 = 2 THEN ' - offers ' ELSE ' ' END || city || more) AS text FROM b)
, n AS (SELECT *, CASE WHEN page_id % 4 <> 2 AND t <> '' THEN t ELSE substr(split_part(text, ' - ', 1), 1, 100) END AS company,
   regexp_extract(text, '{_PHONE}', 0) AS p, regexp_extract(text, '{_EMAIL}', 0) AS e FROM x)
, f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY page_id, company || coalesce(href, '') ORDER BY ord) = 1)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord) AS INTEGER) AS rank, company,
  CASE WHEN starts_with(href, 'http') THEN href ELSE regexp_extract(page_url, '^(https?://[^/?#]+)', 1) || href END AS url,
  CASE WHEN p <> '' AND e <> '' THEN p || '; ' || e WHEN p <> '' THEN p WHEN e <> '' THEN e END AS contact, city AS location,
  regexp_extract(page_url, '^https?://([^/?#]+)', 1) AS source
FROM f"""

ORACLE["x4_company_fallback"] = """
SELECT doc_id, coalesce(nullif(substr(split_part(text, ' - ', 1), 1, 100), ''), 'Vendor') AS company FROM documents"""

ORACLE["x5_source_preference"] = with_ctes(["vendor_rows"], "", [_ANCHORS.strip()]) + """
, found AS (SELECT CAST(page_id // 2 AS VARCHAR) AS item_key, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END AS source_rank,
                   company, url FROM pv)
, ranked AS (SELECT * FROM found UNION ALL SELECT item_key, 3, company, url FROM vendor_rows)
SELECT r.* FROM ranked r JOIN (SELECT item_key, min(source_rank) AS b FROM ranked GROUP BY 1) m
  ON r.item_key = m.item_key AND r.source_rank = m.b"""

# ---------------------------------------------------------------------------
# S
# ---------------------------------------------------------------------------
ORACLE["s1_line_item_csv_scan"] = with_ctes(["line_items"], """
SELECT NULL::BIGINT AS id, MasterItemNo,
       ItemDescription || CASE WHEN length(ItemDescription) % 3 = 0 THEN chr(10) || 'line "two", end' ELSE ', 2" SCH40' END AS ItemDescription, QtyShipped, UOM, PROJECTNUMBER, PROJECT_CITY, PROJECT_TYPE,
       CORE_MARKET, SIZE_BUILDINGSIZE, NUMFLOORS, NULL::VARCHAR AS NUMROOMS, NULL::VARCHAR AS NUMBEDS, NULL::VARCHAR AS MW,
       invoiceDate, CONSTRUCTION_START_DATE, SUBSTANTIAL_COMPLETION_DATE, invoiceTotal, UnitPrice, ExtendedPrice,
       ExtendedQuantity, REVISED_ESTIMATE FROM line_items""")

ORACLE["s2_pruned_item_scan"] = with_ctes(["line_items"], "SELECT MasterItemNo, ItemDescription FROM line_items")

ORACLE["s3_vendor_catalogue_scan"] = with_ctes(["vendor_rows"], """
SELECT item_key, pos, company, url, location, contact, lead_time_days, min_order_qty, source FROM vendor_rows""")

ORACLE["s9_tasks_sink_roundtrip"] = ORACLE["v1_procurement_tasks"]

ORACLE["s10_vendor_catalogue_write"] = with_ctes(["vendor_rows"], """
SELECT item_key, count(*) AS n_vendors, string_agg(company, '|' ORDER BY pos) AS companies FROM vendor_rows GROUP BY 1""")

# ---------------------------------------------------------------------------
# M
# ---------------------------------------------------------------------------
_TOK = "[\\p{L}\\p{N}_]{2,}"


def _tf(src: str, id_col: str) -> str:
    return f"""
{src}_tok AS (SELECT {id_col} AS doc_id,
    unnest(regexp_extract_all(lower(coalesce(text, '')), '{_TOK}')) AS tok,
    generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '{_TOK}'), 1) AS pos FROM {src}),
{src}_terms AS (SELECT doc_id, tok AS term FROM {src}_tok
    UNION ALL SELECT doc_id, bi AS term FROM (
      SELECT doc_id, tok || ' ' || lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS bi FROM {src}_tok) WHERE bi IS NOT NULL),
{src}_tf AS (SELECT doc_id, term, count(*) AS tf FROM {src}_terms GROUP BY 1, 2)"""


_VOCAB = """
vocab AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM (
    SELECT term, sum(tf) AS cf, count(*) AS df FROM documents_tf GROUP BY 1  ))"""


def _weights(src: str) -> str:
    return f"""
{src}_w AS (SELECT t.doc_id, t.term, t.tf * v.idf AS w FROM {src}_tf t JOIN vocab v ON t.term = v.term),
{src}_n AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM {src}_w GROUP BY 1)"""


ORACLE["m1_tfidf"] = "WITH " + _tf("documents", "doc_id") + "," + _VOCAB + "," + _weights("documents") + """
SELECT w.doc_id, w.term, round(w.w / n.nrm, 9) AS weight FROM documents_w w JOIN documents_n n ON w.doc_id = n.doc_id"""

ORACLE["m3_tfidf_transform"] = ("WITH " + _tf("documents", "doc_id") + "," + _VOCAB + "," + _tf("benchmark", "item_id")
                                + "," + _weights("benchmark") + """
SELECT w.doc_id AS item_id, w.term, round(w.w / n.nrm, 9) AS weight FROM benchmark_w w JOIN benchmark_n n ON w.doc_id = n.doc_id""")

ORACLE["m4_target_encoding"] = """
WITH ld AS (SELECT d.source, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
pr AS (SELECT avg(CAST(quality AS DOUBLE)) AS prior FROM ld),
st AS (SELECT 'source' AS "column", CAST(source AS VARCHAR) AS value, count(*) AS n, avg(CAST(quality AS DOUBLE)) AS mean
       FROM ld GROUP BY 2
       UNION ALL SELECT 'lang', CAST(lang AS VARCHAR), count(*), avg(CAST(quality AS DOUBLE)) FROM ld GROUP BY 2)
SELECT "column", value, n, round(CASE WHEN n = 1 THEN prior ELSE
    prior * (1.0 - 1.0 / (1.0 + exp(-(n - 20) / 10.0))) + mean * (1.0 / (1.0 + exp(-(n - 20) / 10.0))) END, 9) AS encoding
FROM st, pr"""

ORACLE["m5_group_folds"] = with_ctes(["line_items"], """
SELECT PROJECTNUMBER, CAST(CAST(('0x' || substr(md5(coalesce(PROJECTNUMBER, 'NA')), 1, 8)) AS BIGINT) % 4 AS INTEGER) AS fold
FROM (SELECT DISTINCT PROJECTNUMBER FROM line_items)""")

_FOLD = "CAST(CAST(('0x' || substr(md5(coalesce(PROJECTNUMBER, 'NA')), 1, 8)) AS BIGINT) % 4 AS INTEGER)"
ORACLE["m6_item_classifier"] = with_ctes(["line_items"], f"""
, r AS (SELECT {KEY('MasterItemNo')} AS label, coalesce(ItemDescription, '') AS text, {_FOLD} AS fold FROM line_items WHERE {KEY('MasterItemNo')} IS NOT NULL)
, tok AS (SELECT label, fold, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM r)
, cnt AS (SELECT label, fold, term, count(*) AS c FROM tok GROUP BY ALL)
, weight AS (SELECT term, label, """ + " + ".join(f"ln(sum(c) - coalesce(sum(c) FILTER (fold = {f}), 0) + 1)" for f in range(4)) + """ AS w FROM cnt GROUP BY ALL)
, size AS (SELECT count(DISTINCT term) AS v FROM cnt)
, tot AS (SELECT count(DISTINCT label) AS labels, """ + ", ".join(f"count(*) FILTER (fold <> {f}) AS n{f}" for f in range(4)) + """ FROM r)
, mass AS (SELECT label, """ + ", ".join(f"sum(c) FILTER (fold <> {f}) AS m{f}" for f in range(4)) + """ FROM cnt GROUP BY label)
, own AS (SELECT label, """ + ", ".join(f"count(*) FILTER (fold <> {f}) AS o{f}" for f in range(4)) + """ FROM r GROUP BY label)
, lab AS (SELECT own.label, """ + " + ".join(f"ln((o{f} + 1) / (n{f} + labels))" for f in range(4)) + " AS prior, "
    + " + ".join(f"ln(coalesce(m{f}, 0) + v)" for f in range(4)) + f""" AS mass FROM own LEFT JOIN mass ON own.label = mass.label CROSS JOIN tot CROSS JOIN size)
, t AS (SELECT DISTINCT coalesce(ItemDescription, '') AS text FROM line_items)
, tf AS (SELECT text, term, count(*) AS tf FROM (SELECT text, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM t) GROUP BY ALL)
, len AS (SELECT text, sum(tf) AS n FROM tf WHERE term IN (SELECT term FROM cnt) GROUP BY text)
, s AS (SELECT tf.text, w.label, sum(tf.tf * w.w) AS s FROM tf JOIN weight w ON tf.term = w.term GROUP BY ALL)
, scored AS (SELECT s.text, s.label, round(lab.prior - len.n * lab.mass + s.s, 6) AS score FROM s JOIN lab ON s.label = lab.label JOIN len ON s.text = len.text)
, best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY text ORDER BY score DESC, label) = 1)
, common AS (SELECT label FROM lab ORDER BY round(prior, 6) DESC, label LIMIT 1)
SELECT t.text, coalesce(best.label, common.label) AS item_key, best.score FROM t LEFT JOIN best ON t.text = best.text CROSS JOIN common""")

ORACLE["m7_one_round_stump"] = with_ctes(["line_items"], f"""
, d AS (SELECT {NUMTXT('NUMFLOORS')} AS floors, CORE_MARKET, PROJECT_TYPE, {STRIP_NUM('QtyShipped')} * (1 + {NUMTXT('NUMFLOORS')} % 3) AS q,
   dense_rank() OVER (ORDER BY CORE_MARKET) - 1 AS mc, dense_rank() OVER (ORDER BY PROJECT_TYPE) - 1 AS tc FROM line_items)
, v AS (SELECT f, x, count(*) AS n, sum(q) AS s FROM (SELECT 'floors' AS f, floors AS x, q FROM d UNION ALL SELECT 'market', mc, q FROM d UNION ALL SELECT 'type', tc, q FROM d) GROUP BY f, x)
, cum AS (SELECT f, x, sum(n) OVER up AS nl, sum(s) OVER up AS sl, sum(n) OVER (PARTITION BY f) AS n, sum(s) OVER (PARTITION BY f) AS s FROM v WINDOW up AS (PARTITION BY f ORDER BY x))
, best AS (SELECT * FROM cum WHERE nl < n ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC LIMIT 1)
SELECT DISTINCT d.floors, d.CORE_MARKET, d.PROJECT_TYPE,
  round(CASE WHEN (CASE best.f WHEN 'floors' THEN d.floors WHEN 'market' THEN d.mc ELSE d.tc END) <= best.x THEN best.sl / best.nl ELSE (best.s - best.sl) / (best.n - best.nl) END, 6) AS prediction
FROM d CROSS JOIN best""")

ORACLE["m9_quantity_fallback"] = with_ctes(["line_items", "requests"], f"""
, med AS (SELECT {KEY('MasterItemNo')} AS item_key, median({STRIP_NUM('QtyShipped')}) AS mq
          FROM line_items WHERE {KEY('MasterItemNo')} IS NOT NULL GROUP BY 1)
, gm AS (SELECT coalesce(median({STRIP_NUM('QtyShipped')}), 1.0) AS g FROM line_items)
SELECT r.id, {KEY('r.item')} AS item_key, greatest(1.0, round_even(coalesce(m.mq, gm.g), 0)) AS QtyShipped
FROM requests r LEFT JOIN med m ON {KEY('r.item')} = m.item_key CROSS JOIN gm""")

ORACLE["m10_item_decode"] = with_ctes(["line_items"], f"""
, codes AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS code, dense_rank() OVER (ORDER BY label) AS code1
            FROM (SELECT DISTINCT trim(MasterItemNo) AS label FROM line_items WHERE MasterItemNo IS NOT NULL))
SELECT o.o_orderkey AS id, o.o_custkey % 4500 AS pred_code,
       CAST(coalesce(c.code1, {MASTER_INT('CAST(o.o_custkey % 4500 AS VARCHAR)')}, 0) AS BIGINT) AS MasterItemNo
FROM orders o LEFT JOIN codes c ON o.o_custkey % 4500 = c.code""")

ORACLE["m11_baseline_predictions"] = with_ctes(["line_items"], f"""
, top AS (SELECT k FROM (SELECT CAST(CAST({NUMTXT('MasterItemNo')} AS BIGINT) AS VARCHAR) AS k, count(*) AS n
                         FROM line_items WHERE {NUMTXT('MasterItemNo')} IS NOT NULL GROUP BY 1)
          ORDER BY n DESC, TRY_CAST(k AS DOUBLE), k LIMIT 1)
, gm AS (SELECT coalesce(median({STRIP_NUM('QtyShipped')}), 1.0) AS g FROM line_items)
SELECT o.o_orderkey AS id, coalesce((SELECT CAST(k AS BIGINT) FROM top), 101) AS MasterItemNo, (SELECT g FROM gm) AS QtyShipped
FROM orders o""")

_PAIRS = with_ctes(["truth", "pred"], "", ["""pairs AS (SELECT t.id, t.MasterItemNo AS it, t.QtyShipped AS qt,
    p.MasterItemNo AS ip, p.QtyShipped AS qp FROM truth t JOIN pred p ON t.id = p.id)""",
    """lab AS (SELECT it AS label, CASE WHEN it = ip THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN it <> ip THEN 1 ELSE 0 END AS fn
             FROM pairs UNION ALL SELECT ip, 0, CASE WHEN it <> ip THEN 1 ELSE 0 END, 0 FROM pairs)""",
    """perlab AS (SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn
                FROM lab GROUP BY 1)""",
    """f1s AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM perlab)""",
    """sc AS (SELECT avg(CASE WHEN it = ip THEN 1.0 ELSE 0.0 END) AS accuracy, (SELECT avg(f1) FROM f1s) AS f1_macro,
                   avg(abs(qt - qp)) AS mae, max(qt) - min(qt) AS rng FROM pairs)""",
    """sc2 AS (SELECT accuracy, f1_macro, mae, CASE WHEN rng IS NULL OR rng = 0 THEN 1.0
                   ELSE 1.0 - least(1.0, greatest(0.0, mae / rng)) END AS reg_score FROM sc)"""])

ORACLE["m12_accuracy"] = _PAIRS + " SELECT round(CAST(accuracy AS DOUBLE), 9) AS accuracy FROM sc2"
ORACLE["m13_macro_f1"] = _PAIRS + " SELECT label, tp, fp, fn, round(f1, 9) AS f1 FROM f1s"
ORACLE["m14_scores"] = _PAIRS + """
SELECT round(CAST(accuracy AS DOUBLE), 9) AS accuracy, round(f1_macro, 9) AS f1_macro, round(mae, 9) AS mae,
       round(reg_score, 9) AS reg_score,
       round(0.25 * CAST(accuracy AS DOUBLE) + 0.25 * f1_macro + 0.5 * reg_score, 9) AS final_score FROM sc2"""


ORACLE["t1_request_stream_link"] = with_ctes(["requests", "request_feed"], f"""
, f AS (SELECT *, floor(seq * 4 / ((SELECT max(event_id) FROM events) + 1)) AS part FROM request_feed)
, ends AS (SELECT f.id, f.status, row_number() OVER (PARTITION BY f.id, b.b ORDER BY f.ts DESC, f.seq DESC) AS rn
           FROM f JOIN (SELECT unnest([0, 1, 2, 3]) AS b) b ON f.part <= b.b)
, linked AS (SELECT DISTINCT id FROM ends WHERE rn = 1 AND lower(trim(status)) = 'approved')
SELECT r.id, coalesce(CAST({MASTER_INT(f"coalesce({TRUTHY('item')}, '')")} AS VARCHAR), '') AS MasterItemNo,
       CAST(coalesce({TRUTHY('item')}, '') AS VARCHAR) AS ItemDescription, {LINKQTY('qty')} AS QtyShipped,
       coalesce(nullif(needed_by, ''), '') AS needed_by_date
FROM requests r JOIN linked l ON r.id = l.id""")

_SCHED = "SELECT o_orderpriority AS Task, CAST(min(o_orderdate) AS DATE) AS \"Start\", CAST(max(o_orderdate) AS DATE) AS Finish FROM orders GROUP BY 1"
ORACLE["s5_schedule_scan"] = _SCHED
ORACLE["a13_schedule_bounds"] = f'SELECT min("Start") AS project_start, max(Finish) AS project_finish FROM ({_SCHED})'
ORACLE["s7_plan_source"] = f"SELECT MasterItemNo, CAST(Qty AS DOUBLE) AS QtyShipped FROM ({ORACLE['v1_procurement_tasks']})"
ORACLE["s8_validated_predictions"] = "SELECT l_orderkey AS id, l_partkey AS MasterItemNo, l_quantity AS QtyShipped FROM lineitem"

_ONE = f""", t AS (SELECT {KEY('MasterItemNo')} AS item_key, CAST(NUMFLOORS AS DOUBLE) AS x, {STRIP_NUM('QtyShipped')} AS q FROM line_items)
, s AS (SELECT item_key, count(*) + 0.001 AS a, sum(coalesce(x, 0)) AS b, sum(coalesce(x, 0) * coalesce(x, 0)) + 0.001 AS c, sum(q) AS sy, sum(coalesce(x, 0) * q) AS sxy
        FROM t GROUP BY 1 HAVING count(*) >= 20)
, fit AS (SELECT item_key, (c * sy - b * sxy) / (a * c - b * b) AS b0, (a * sxy - b * sy) / (a * c - b * b) AS b1 FROM s)"""
ORACLE["m8_one_feature_regressors"] = with_ctes(["line_items"], _ONE + " SELECT item_key, round(b0, 6) AS b0, round(b1, 6) AS b1 FROM fit")
ORACLE["j10_one_feature_scoring"] = with_ctes(["line_items"], _ONE + """
SELECT t.item_key, t.x, round(b0 + b1 * t.x, 6) AS q_item FROM t LEFT JOIN fit ON t.item_key = fit.item_key""")

for _name, _of in (("s9_predictions_sink", "m11_baseline_predictions"), ("s9_preprocessed_sink", "a7_median_imputation"),
                   ("s9_schedule_sink", "v6_schedule_alignment"), ("s9_plan_sink", "v8_procurement_plan")):
    ORACLE[_name] = ORACLE[_of]

ORACLE["w3_timeline_order"] = ('SELECT row_number() OVER (ORDER BY "Start" NULLS FIRST, Task NULLS FIRST, Finish NULLS FIRST, Resource NULLS FIRST, Type NULLS FIRST) AS ordinal, '
                               '"Start", Task, Finish FROM (' + ORACLE["v7_timeline"] + ")")

_XS = ("1.0", "coalesce(floors, 0)", "coalesce(size, 0)", "coalesce(price, 0)")
ORACLE["m8_item_statistics"] = with_ctes(["line_items"], f"""
, d AS (SELECT {KEY('MasterItemNo')} AS item_key, {NUMTXT('NUMFLOORS')} AS floors, {STRIP_NUM('SIZE_BUILDINGSIZE')} AS size, {STRIP_NUM('UnitPrice')} AS price, {STRIP_NUM('QtyShipped')} AS q FROM line_items)
SELECT item_key, count(*) AS n, """ + ", ".join(f"round(sum({_XS[i]} * {_XS[j]}), 4) AS xx_{i}_{j}" for i in range(4) for j in range(i, 4))
    + ", " + ", ".join(f"round(sum({x} * q), 4) AS xy_{i}" for i, x in enumerate(_XS)) + " FROM d GROUP BY item_key")

ORACLE["m9_model_chain"] = with_ctes(["line_items", "requests"], _ONE + f"""
, med AS (SELECT {KEY('MasterItemNo')} AS item_key, median({STRIP_NUM('QtyShipped')}) AS mq FROM line_items WHERE {KEY('MasterItemNo')} IS NOT NULL GROUP BY 1)
, gm AS (SELECT coalesce(median({STRIP_NUM('QtyShipped')}), 1.0) AS g FROM line_items)
, rq AS (SELECT id, {KEY('item')} AS item_key, CAST(id % 7 AS DOUBLE) AS rx FROM requests)
, sc AS (SELECT rq.*, b0 + b1 * rx AS q_item FROM rq LEFT JOIN fit ON rq.item_key = fit.item_key AND TRY_CAST(fit.item_key AS BIGINT) % 3 = 0)
SELECT sc.id, sc.item_key, round(q_item, 6) AS q_item, greatest(1.0, round_even(coalesce(q_item, CASE WHEN id % 5 = 0 THEN rx + 0.5 END, med.mq, gm.g), 0)) AS QtyShipped
FROM sc LEFT JOIN med ON sc.item_key = med.item_key CROSS JOIN gm""")

ORACLE["j6_keyword_table"] = with_ctes(["line_items"], """
, k AS (SELECT DISTINCT w AS keyword FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE length(w) > 2)
, t AS (SELECT DISTINCT ItemDescription AS text FROM line_items)
, f AS (SELECT t.text, 'Phase ' || upper(k.keyword) AS phase, row_number() OVER (PARTITION BY t.text ORDER BY md5(k.keyword)) AS rn FROM t JOIN k ON contains(lower(t.text), lower(k.keyword)))
SELECT t.text, coalesce(f.phase, 'Other') AS phase FROM t LEFT JOIN f ON t.text = f.text AND f.rn = 1""")

ORACLE["r4_status_table"] = with_ctes(["request_feed"], """
SELECT id, status, ts AS status_ts FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) AS rn FROM request_feed)
WHERE rn = 1""")

_LIGHTEST = "CASE WHEN l0 <= l1 AND l0 <= l2 AND l0 <= l3 THEN 0 WHEN l1 <= l2 AND l1 <= l3 THEN 1 WHEN l2 <= l3 THEN 2 ELSE 3 END"
ORACLE["m5_balanced_folds"] = with_ctes(["line_items"], """
, g AS (SELECT n, row_number() OVER (ORDER BY n DESC, p) AS rn FROM (SELECT coalesce(PROJECTNUMBER, 'NA') AS p, count(*) AS n FROM line_items GROUP BY 1))
, steps AS (SELECT * FROM walk)
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows FROM walk WHERE rn > 0 GROUP BY fold""").replace("WITH ", "WITH RECURSIVE ", 1).replace(
    ", steps AS (SELECT * FROM walk)", f""", walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS n, 0 AS fold, CAST(0 AS BIGINT) AS l0, CAST(0 AS BIGINT) AS l1, CAST(0 AS BIGINT) AS l2, CAST(0 AS BIGINT) AS l3
  UNION ALL
  SELECT g.rn, g.n, {_LIGHTEST} AS fold, """ + ", ".join(f"l{f} + CASE WHEN {_LIGHTEST} = {f} THEN g.n ELSE 0 END" for f in range(4)) + """
  FROM walk JOIN g ON g.rn = walk.rn + 1)""")

ORACLE["j2_bucketed_lookups"] = with_ctes(["predictions", "vendor_rows", "line_items"], _ITEMS + _PLANV + _MODE + f"""
, med AS (SELECT {KEY('MasterItemNo')} AS item_key, median({STRIP_NUM('QtyShipped')}) AS median_qty
          FROM line_items WHERE {KEY('MasterItemNo')} IS NOT NULL GROUP BY 1)
SELECT {KEY('p.MasterItemNo')} AS item_key, p.QtyShipped, v.Vendor, v.VendorContact, v.VendorLeadDays, m.ItemDescription, med.median_qty
FROM predictions p LEFT JOIN planv v ON {KEY('p.MasterItemNo')} = v.item_key LEFT JOIN mmode m ON {KEY('p.MasterItemNo')} = m.item_key
LEFT JOIN med ON {KEY('p.MasterItemNo')} = med.item_key""")
