"""Tables on storage: the bucketed status table and the sinks."""

import datetime as dt

from pyspark.sql import functions as F

from matforge.operators import status_table as st
from matforge.session import scratch_path
from matforge.sources import sinks as sk


def _files(spark, root):
    return {r[0].split("/")[-2] + "/" + r[0].split("/")[-1] for r in spark.read.parquet(root).select(F.input_file_name()).distinct().collect()}


def _delta(spark, *rows):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, day + dt.timedelta(days=d), s, v) for i, d, s, v in rows], "id long, ts timestamp_ntz, seq long, status string")


def test_only_touched_buckets_are_rewritten(spark):
    root = scratch_path(spark, "status-test")
    assert st.read_status_table(spark, root).count() == 0
    first = st.apply_delta(spark, _delta(spark, *((i, 0, i, "pending") for i in range(200))), root, buckets=16)
    assert first == list(range(16))
    before = _files(spark, root)
    change = _delta(spark, (3, 2, 500, "approved"), (3, 1, 400, "rejected"), (5, -1, 1, "old"), (None, 9, 9, "x"))
    touched = st.apply_delta(spark, change, root, buckets=16)
    after = _files(spark, root)
    assert len(touched) <= 2 and {f for f in before - after} and all(int(f.split("/")[0].split("=")[1]) in touched for f in before ^ after)
    got = {r.id: r.status for r in st.read_status_table(spark, root).collect()}
    assert len(got) == 200 and got[3] == "approved" and got[5] == "pending"
    assert st.apply_delta(spark, change, root, buckets=16) == touched  # replayed
    assert {r.id: r.status for r in st.read_status_table(spark, root).collect()} == got
    assert st.apply_delta(spark, change.limit(0), root, buckets=16) == []


def test_csv_round_trip_keeps_nulls_quotes_and_types(spark):
    rows = [(1, 'say "x", y', None, dt.date(2024, 1, 2), 1.5), (2, "", "two\nlines", None, None), (None, "a\\b", " pad ", dt.date(1999, 12, 31), -0.0)]
    df = spark.createDataFrame(rows, "id long, a string, b string, d date, q double")
    back = sk.round_trip(df, scratch_path(spark, "csv-test"))
    assert back.schema == df.schema and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_bucketed_items_do_not_move(spark):
    """Three joins on the item key: the only exchange is that of the lines."""
    from __spark_entry__ import queries
    from tests.conftest import SF001

    plan = queries()["j2_bucketed_lookups"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("SortMergeJoin") == 3 and plan.count("Bucketed: true") == 3
