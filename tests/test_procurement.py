"""V1-V11 and R1-R7 against the golden rows of the sample run."""

import datetime as dt

from pyspark.sql import functions as F

from matforge.config import PlanConfig
from matforge.operators import plan as pl
from matforge.operators import requests as rq
from matforge.operators import schedule as sch
from matforge.operators import vendors as vd

D = dt.date


def _vendors(spark, rows):
    schema = "item_key string, pos int, company string, url string, contact string, lead_time_days int, source string"
    return spark.createDataFrame(rows, schema)


def test_task_dates_golden(spark):
    pred = spark.createDataFrame([(1, 258.0, 400.0), (2, 258.0, 415.0), (3, 9.0, 5.0)], "id int, MasterItemNo double, QtyShipped double")
    v = _vendors(spark, [("258", 0, "Acme", None, None, 14, "local"), ("258", 1, "Zed", None, None, 3, "local")])
    out = {r["MasterItemNo"]: r for r in sch.procurement_tasks(pred, v, PlanConfig(), D(2025, 10, 1)).collect()}
    assert out["258"]["Qty"] == 815.0 and out["258"]["preferred_vendor"] == "Acme"
    assert (out["258"]["procurement_start"], out["258"]["procurement_end"], out["258"]["expected_delivery"]) == \
        (D(2025, 12, 15), D(2025, 12, 29), D(2025, 12, 30))
    assert out["9"]["preferred_vendor"] == "TBD" and out["9"]["lead_time_days"] == 14


def test_schedule_alignment_golden(spark):
    cfg = PlanConfig(as_of=D(2025, 9, 14))
    s = sch.default_schedule(spark, cfg)
    tasks = spark.createDataFrame(
        [("1", "cable tray 50mm", 10.0, None), ("2", "widget", 2.0, "2025-10-15"), ("3", "x", 5.0, "2025-11-01"),
         ("4", "y", 5.0, "2025-10-10")],
        "MasterItemNo string, ItemDescription string, QtyShipped double, needed_by_date string")
    out = {r["MasterItemNo"]: r for r in sch.align_schedule(tasks, s, _vendors(spark, []), cfg).collect()}
    # phase 'Electrical & HVAC' finishes 2025-12-03 (as_of + 80); placeholder lead 14, buffer 3
    assert out["1"]["Phase"] == "Electrical & HVAC" and out["1"]["NeededBy"] == D(2025, 12, 3)
    assert out["1"]["ProcurementStart"] == D(2025, 11, 16) and out["1"]["VendorCompany"] == "Placeholder Vendor"
    assert [out[k]["ProcurementStart"] for k in "234"] == [D(2025, 9, 28), D(2025, 10, 15), D(2025, 9, 23)]


def test_plan_rows_golden(spark):
    cfg = PlanConfig(as_of=D(2025, 9, 14))
    s = sch.default_schedule(spark, cfg)
    items = spark.createDataFrame([("1", 5.0), ("2", 69.0), ("3", 137.0), ("4", 212.0), ("5", 2.5)],
                                  "MasterItemNo string, QtyShipped double")
    v = _vendors(spark, [("1", 0, "A", None, "+91 1", None, "local"), ("2", 0, "B", "u", None, 35, "Import desk")])
    out = {r["MasterItemNo"]: r for r in pl.procurement_plan(items, s, v, None, cfg).collect()}
    got = [(out[k]["PredictedQty"], out[k]["SafetyStock"], out[k]["RecommendedOrderQty"], out[k]["ProcurementCycle"])
           for k in "1234"]
    assert got == [(5, 1, 6, "Single order"), (69, 7, 76, "Single order"),
                   (137, 14, 151, "Consider 2-stage procurement"), (212, 22, 234, "Consider 2-stage procurement")]
    assert out["1"]["ProcurementStart"] == D(2025, 11, 9)  # finish 12-03, lead 21 (missing), buffer 3
    assert out["1"]["VendorContact"] == "+91 1" and out["2"]["VendorContact"] == "u"
    assert out["2"]["RiskNotes"] == "Long supplier lead time; Import dependency"
    assert out["3"]["RiskNotes"].startswith("No vendor in DB")
    assert out["5"]["PredictedQty"] == 2  # half-even


def test_vendor_policies(spark):
    v = _vendors(spark, [("1", 0, "first", None, None, None, "s"), ("1", 1, "fast", None, None, 5, "s"),
                         ("1", 2, "fast2", None, None, 5, "s"), ("2", 0, "only", None, None, 0, "s")])
    first = {r["item_key"]: r["company"] for r in vd.first_vendor(v).collect()}
    fastest = {r["item_key"]: r["company"] for r in vd.min_lead_vendor(v).collect()}
    assert first == {"1": "first", "2": "only"}
    assert fastest == {"1": "fast", "2": "only"}


def test_link_requests_idempotent(spark):
    reqs = spark.createDataFrame(
        [(1, "12,345", "10", " Approved ", "2025-10-15"), (2, "9", "4", "Pending", ""),
         (3, "Item 9", "2.7", "approved", "2025-11-01"), (4, "7", "1", "rejected", ""),
         (5, "258.0", None, "APPROVED", "2025-10-10")],
        "id long, item string, qty string, status string, needed_by string")
    tasks = spark.createDataFrame([("1", 5.0)], "MasterItemNo string, Qty double")
    out, linked = rq.link_requests(tasks, reqs, None, F.lit(None).cast("timestamp"))
    new = out.where(F.col("QtyShipped").isNotNull()).orderBy("QtyShipped").collect()
    assert [(r["MasterItemNo"], r["QtyShipped"]) for r in new] == [("258", 1), ("", 2), ("12345", 10)]
    again, _ = rq.link_requests(out, reqs, linked, F.lit(None).cast("timestamp"))
    assert again.count() == out.count()  # a second run appends nothing
    second_new = rq.approved_unlinked(reqs, linked)
    assert second_new.count() == 0


def test_running_id_fold(spark):
    raw = spark.createDataFrame([(0, None), (1, "5"), (2, None), (3, "2"), (4, "x")], "pos int, id string")
    got = [r["id"] for r in rq.normalize_requests(raw, ["pos"]).orderBy("pos").collect()]
    assert got == [1, 5, 6, 2, 7]


def test_running_id_fold_many_partitions(spark):
    import random

    random.seed(7)
    vals = [None if random.random() < 0.3 else str(random.randint(0, 400)) for _ in range(500)]
    raw = spark.createDataFrame(list(enumerate(vals)), "pos int, id string")
    got = [r["id"] for r in rq.normalize_requests(raw, ["pos"], ).orderBy("pos").collect()]
    m, want = 0, []
    for v in vals:
        if v is None:
            m += 1
            want.append(m)
        else:
            m = max(m, int(v))
            want.append(int(v))
    assert got == want


def test_parse_request_shapes(spark):
    lines = spark.createDataFrame([
        ('{"requests": [{"id": 1, "item": "a"}, {"item": "b"}]}',), ('{"data": [{"id": "7", "status": "Approved"}]}',),
        ('[{"id": 3}]',), ('{"id": 4, "item": "d"}',), ('"{\\"id\\": 5}"',), ('42',), ('not json',)], "value string")
    rows = rq.parse_requests(lines).orderBy("_line", "_pos").collect()
    assert [r["id"] for r in rows] == ["1", None, "7", "3", "4", "5", "42"]
    assert [r["status"] for r in rows] == ["Pending", "Pending", "Approved", "Pending", "Pending", "Pending", "Pending"]


def test_anchors_in_any_case_and_quoting(spark):
    from matforge.operators.pages import page_vendors

    html = """<A class=x HREF='/one'>One &amp; Co</A> <a href="/two" id=2>Two</a><a href=/three>Three</a><a href="/two">Two</a><a name=z>no link</a><a href="/empty"> </a>""" + "".join(
        f'<a href="/m{i}">M{i}</a>' for i in range(40))
    got = page_vendors(spark.createDataFrame([(1, "https://a.example/x", html)], "page_id long, url string, html string")).orderBy("rank").collect()
    assert [(r.company, r.url) for r in got[:3]] == [("One & Co", "https://a.example/one"), ("Two", "https://a.example/two"), ("Three", "https://a.example/three")]
    assert len(got) == 43 and [r.rank for r in got] == list(range(1, 44))
