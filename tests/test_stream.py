"""The streaming linker equals the batch linker when the feed arrives in one batch, never links an id twice
across batches, runs or replays, and forgets an id after its retention."""

import datetime as dt

from pyspark.sql import functions as F

from matforge.operators import requests as rq
from matforge.session import scratch_path
from matforge.sources import fixtures as fx
from matforge.streaming import request_feed as rf
from matforge.streaming.request_feed import run_request_stream
from tests.conftest import SF001


def _requests(spark):
    return fx.requests(spark, SF001).drop("status", "linked_to_procurement")


def _changes(spark, path, *rows):
    """Append one file of changes (id, day, seq, status)."""
    day = dt.datetime(2024, 1, 1)
    data = [(i, None if d is None else day + dt.timedelta(days=d), s, status) for i, d, s, status in rows]
    spark.createDataFrame(data, rf.FEED_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch(spark):
    root = scratch_path(spark, "t1-test")
    feed = fx.request_feed(spark, SF001)
    feed.coalesce(1).write.parquet(f"{root}/feed")
    reqs = _requests(spark)
    got = run_request_stream(spark, f"{root}/feed", reqs, root).drop("batch_id")
    latest = rq.latest_status(feed)
    want = rq.request_task_rows(reqs.join(rq.apply_status(reqs.withColumn("status", F.lit(None).cast("string")), latest)
                                          .where(F.lower(F.trim("status")) == "approved").select("id"), "id", "left_semi"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_links_once(spark):
    root = scratch_path(spark, "t1-test-multi")
    feed = fx.request_feed(spark, SF001)
    feed.repartition(3, "seq").write.parquet(f"{root}/feed")
    got = run_request_stream(spark, f"{root}/feed", _requests(spark), root, max_files_per_trigger=1)
    assert got.groupBy("id").count().where("count > 1").count() == 0


def test_late_and_repeated_changes(spark):
    root, reqs = scratch_path(spark, "t1-test-late"), _requests(spark)
    a, b, c, d = (r.id for r in reqs.select("id").orderBy("id").limit(4).collect())
    linked = lambda: sorted((r.batch_id, r.id) for r in run_request_stream(spark, f"{root}/feed", reqs, root).collect())
    _changes(spark, f"{root}/feed", (a, 3, 9, " Approved "), (b, 3, 1, "pending"), (c, 2, 2, "approved"), (c, 2, 3, "rejected"), (None, 1, 1, "approved"), (d, None, 1, "approved"))
    first = linked()
    assert [i for _, i in first] == [a]
    # Older changes do not undo or approve; a repeated approval links nothing; a new one links once.
    _changes(spark, f"{root}/feed", (a, 1, 1, "rejected"), (b, 1, 0, "approved"), (c, 4, 4, "APPROVED"), (c, 4, 4, "APPROVED"), (a, 3, 9, " Approved "))
    second = linked()
    assert [i for _, i in second] == [a, c] and second[0] == first[0]
    _changes(spark, f"{root}/feed", (c, 5, 6, "rejected"), (c, 6, 7, "approved"), (a, 7, 8, "approved"))
    assert linked() == second


def test_state_expires_after_retention(spark):
    root, reqs = scratch_path(spark, "t1-test-expiry"), _requests(spark)
    a, b = (r.id for r in reqs.select("id").orderBy("id").limit(2).collect())
    run = lambda: sorted(r.id for r in run_request_stream(spark, f"{root}/feed", reqs, root, retention_days=10, lateness="1 day").collect())
    _changes(spark, f"{root}/feed", (a, 0, 1, "approved"))
    assert run() == [a]
    _changes(spark, f"{root}/feed", (a, 5, 2, "approved"))  # within the retention
    assert run() == [a]
    _changes(spark, f"{root}/feed", (b, 60, 3, "approved"))  # the watermark passes the end of a's retention
    assert run() == [a, b]
    _changes(spark, f"{root}/feed", (a, 61, 4, "approved"), (b, 2, 1, "rejected"))  # a is new again; b's change is too late
    assert run() == [a, a, b]


def test_replayed_batch_rewrites_its_folder(spark):
    root, reqs = scratch_path(spark, "t1-test-replay"), _requests(spark)
    ids = [r.id for r in reqs.select("id").orderBy("id").limit(3).collect()]
    new = lambda *on: spark.createDataFrame([(i,) for i in on], "id long")
    run = rf.link_batch(reqs, root)
    linked = lambda: sorted((r.batch_id, r.id) for r in spark.read.parquet(f"{root}/tasks").collect())
    run(new(ids[0], ids[1]), 0)
    run(new(ids[2]), 1)
    want = [(0, ids[0]), (0, ids[1]), (1, ids[2])]
    assert linked() == want
    run(new(ids[2]), 1)
    run(new(ids[0], ids[1]), 0)
    assert linked() == want
