"""S5-S8 readers on small files written to a fresh scratch folder."""

import datetime as dt
import os
import tempfile

import pytest

from matforge.config import PlanConfig
from matforge.operators import schedule as sch
from matforge.sources import readers as rd


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_schedule_csv_with_renamed_columns(spark):
    d = tempfile.mkdtemp(prefix="mf-src-")
    p = _write(d, "sched.csv", "project_id,task_name ,start_date,end_date,duration_days\n"
                               "1,Design & Planning,2025-10-01,2025-10-21,20\n1,Electrical & HVAC,2025-11-01,2025-12-03,32\n")
    s = sch.read_schedule(spark, p)
    rows = [(r["Task"], r["Start"], r["Finish"]) for r in s.orderBy("ord").collect()]
    assert rows == [("Design & Planning", dt.date(2025, 10, 1), dt.date(2025, 10, 21)),
                    ("Electrical & HVAC", dt.date(2025, 11, 1), dt.date(2025, 12, 3))]


def test_schedule_falls_back_to_default(spark):
    d = tempfile.mkdtemp(prefix="mf-src-")
    p = _write(d, "bad.csv", "a,b\n1,2\n")
    s = sch.read_schedule(spark, p, PlanConfig(as_of=dt.date(2025, 9, 14)))
    got = {r["Task"]: (r["Start"], r["Finish"]) for r in s.collect()}
    assert got["Electrical & HVAC"] == (dt.date(2025, 11, 4), dt.date(2025, 12, 3))
    assert len(got) == 5


def test_tasks_header_trim_and_absent(spark):
    d = tempfile.mkdtemp(prefix="mf-src-")
    p = _write(d, "tasks.csv", " MasterItemNo , Qty\n258,815\n")
    t = rd.read_tasks(spark, p)
    assert t.columns == ["MasterItemNo", "Qty"]
    empty = rd.read_tasks(spark, None)
    assert empty.columns == ["MasterItemNo", "ItemDescription", "QtyShipped", "needed_by_date"] and empty.count() == 0
    with pytest.raises(FileNotFoundError):
        rd.read_tasks(spark, None, required=True)


def test_plan_items_prefers_predictions_and_renames_qty(spark):
    d = tempfile.mkdtemp(prefix="mf-src-")
    tasks = _write(d, "tasks.csv", "MasterItemNo,Qty\n1,5\n")
    items = rd.read_plan_items(spark, os.path.join(d, "missing.csv"), tasks)
    assert "QtyShipped" in items.columns and items.count() == 1
    preds = _write(d, "preds.csv", "id,MasterItemNo,QtyShipped\n1,2,3\n")
    assert rd.read_plan_items(spark, preds, tasks).columns == ["id", "MasterItemNo", "QtyShipped"]


def test_validate_predictions(spark):
    ok = spark.createDataFrame([(1, 2, 3.0)], "id int, MasterItemNo int, QtyShipped double")
    assert rd.validate_predictions(ok) is ok
    with pytest.raises(ValueError):
        rd.validate_predictions(ok.where("id < 0"))
    with pytest.raises(ValueError):
        rd.validate_predictions(ok.drop("QtyShipped"))


def test_line_item_csv_missing_columns(spark):
    d = tempfile.mkdtemp(prefix="mf-src-")
    p = _write(d, "li.csv", "MasterItemNo,QtyShipped,UnitPrice\n258,\"1,200 EA\",$ 3.50\n")
    li = rd.read_line_items(spark, p)
    r = li.first()
    assert r["MasterItemNo"] == "258" and r["QtyShipped"] == "1,200 EA" and r["UnitPrice"] == "$ 3.50"
    assert r["MW"] is None and r["id"] is None


def test_csv_of_another_program(spark, tmp_path):
    import csv

    from matforge.sources import readers as rd

    rows = [("258", 'PIPE 2" SCH40, GALV', "3"), ("259", 'two\nlines "quoted"', "4"), ("260", "", "5")]
    with open(tmp_path / "items.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow([" MasterItemNo ", "ItemDescription", "QtyShipped"])
        w.writerows(rows)
    got = rd.read_line_items(spark, str(tmp_path / "items.csv"), columns=["MasterItemNo", "ItemDescription", "QtyShipped"])
    assert sorted((r[0], r[1] or "", r[2]) for r in got.collect()) == rows
    assert [r[0] for r in rd.read_tasks(spark, str(tmp_path / "items.csv"), required=True).select("QtyShipped").orderBy("MasterItemNo").collect()] == ["3", "4", "5"]


def test_catalogue_and_request_shapes(spark):
    from matforge.operators import requests as rq
    from matforge.operators import vendors

    docs = ['[{"MasterItemNo":"1.0","vendors":[{"company":"a","lead_time_days":"99999999999"}]},{"MasterItemNo":2,"vendors":[{"company":"b"}]}]',
            '{"items":[{"MasterItemNo":3,"vendors":[{"company":"c"}]}]}', '{"MasterItemNo":4,"vendors":[{"company":"d","lead_time_days":7}]}', "[]", "no json"]
    got = vendors.parse_catalogue_lines(spark.createDataFrame([(d,) for d in docs], "value string"))
    assert sorted((r.item_key, r.company, r.lead_time_days) for r in got.collect()) == [("1", "a", None), ("2", "b", None), ("3", "c", None), ("4", "d", 7)]
    keyed = vendors.parse_catalogue_lines(spark.createDataFrame([('{"5":[{"company":"e"},{"company":"f"}]}',)], "value string"), shape="keyed")
    assert sorted((r.item_key, r.pos, r.company) for r in keyed.collect()) == [("5", 0, "e"), ("5", 1, "f")]
    reqs = rq.parse_requests(spark.createDataFrame([('{"a":{"id":7,"item":"x"},"b":{"item":"y","status":"Approved"},"note":"z"}',), ('{"id":8,"item":"w"}',)], "value string"))
    assert sorted((r.id or "", r.item, r.status) for r in reqs.collect()) == [("", "y", "Approved"), ("7", "x", "Pending"), ("8", "w", "Pending")]


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from matforge.session import ensure_checkpoint_dir

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
