"""Prefix scans, scoring, SVD, target encoding and the stream against brute force."""

import numpy as np
from pyspark.sql import functions as F

from matforge.operators import evaluate as ev
from matforge.operators import models as md
from matforge.operators import text as tx
from matforge.operators.scan import sequential_ids


def test_sequential_ids_dense(spark):
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000).drop("id")
    got = sorted((r["k"], r["rid"]) for r in sequential_ids(df, ["k"], name="rid").collect())
    assert [r for _, r in got] == list(range(1, 1001))
    assert all(k + 1 == r for k, r in got)


def test_scores_hand_worked(spark):
    pairs = spark.createDataFrame([("a", "a", 10.0, 12.0), ("b", "c", 20.0, 20.0), ("c", "c", 30.0, 25.0)],
                                  "MasterItemNo_true string, MasterItemNo_pred string, QtyShipped_true double, "
                                  "QtyShipped_pred double")
    r = ev.scores(pairs).first()
    assert abs(r["accuracy"] - 2 / 3) < 1e-12
    assert abs(r["f1_macro"] - (1 + 0 + 2 / 3) / 3) < 1e-12
    assert abs(r["mae"] - 7 / 3) < 1e-12
    assert abs(r["reg_score"] - (1 - (7 / 3) / 20)) < 1e-12
    assert abs(r["final_score"] - (0.25 * r["accuracy"] + 0.25 * r["f1_macro"] + 0.5 * r["reg_score"])) < 1e-12


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.random((40, 30)) * (rng.random((40, 30)) < 0.3)
    rows = [(int(i), int(j), float(a[i, j])) for i in range(40) for j in range(30) if a[i, j] != 0]
    w = spark.createDataFrame(rows, "doc_id long, idx int, weight double")
    comps, s = tx.fit_svd(w, 30, 5)
    exact = np.linalg.svd(a, compute_uv=False)[:5]
    assert np.allclose(s, exact, rtol=1e-9)
    v = np.zeros((30, 5))
    for r in comps.collect():
        v[r["idx"], r["comp"]] = r["value"]
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-9) and np.allclose(np.linalg.norm(a @ v, axis=0), exact, rtol=1e-9)


def test_tfidf_small_corpus(spark):
    docs = spark.createDataFrame([(1, "Cable tray cable"), (2, "cable duct"), (3, "a")], "doc_id long, text string")
    vocab, w = tx.fit_tfidf(docs, 100)
    got = {(r["doc_id"], r["term"]): r["weight"] for r in w.collect()}
    n = 3
    idf = {t: np.log((1 + n) / (1 + d)) + 1 for t, d in
           {"cable": 2, "tray": 1, "cable tray": 1, "tray cable": 1, "duct": 1, "cable duct": 1}.items()}
    d1 = {"cable": 2 * idf["cable"], "tray": idf["tray"], "cable tray": idf["cable tray"], "tray cable": idf["tray cable"]}
    norm = np.sqrt(sum(v * v for v in d1.values()))
    for t, v in d1.items():
        assert abs(got[(1, t)] - v / norm) < 1e-12
    assert (3, "a") not in got  # single-character tokens are not terms


def test_target_encoding_rule(spark):
    df = spark.createDataFrame([("x", 1.0)] * 30 + [("y", 0.0)] * 5 + [("z", 1.0)], "c string, t double")
    enc = {r["value"]: r["encoding"] for r in md.fit_target_encoding(df, ["c"], "t").collect()}
    prior = 31 / 36
    wx = 1 / (1 + np.exp(-(30 - 20) / 10))
    assert abs(enc["x"] - (prior * (1 - wx) + 1.0 * wx)) < 1e-12
    assert enc["z"] == prior  # seen once -> prior


def test_group_folds_never_split(spark):
    df = spark.createDataFrame([(str(i % 17),) for i in range(200)], "p string")
    folds = df.select("p", md.group_fold(F.col("p")).alias("f")).distinct().groupBy("p").count()
    assert folds.where("count > 1").count() == 0


def test_quantile_row_matches_numpy(spark):
    from matforge.operators.stats import quantile_row

    rng = np.random.default_rng(3)
    a = rng.integers(0, 50, 777).astype(float)
    b = rng.random(777) * 1000
    b[::7] = np.nan  # missing values are skipped
    df = spark.createDataFrame([(float(x), None if np.isnan(y) else float(y)) for x, y in zip(a, b)], "a double, b double")
    r = quantile_row(df, [("a50", F.col("a"), 0.5), ("b50", F.col("b"), 0.5), ("b75", F.col("b"), 0.75),
                          ("a10", F.col("a"), 0.1)]).first()
    bb = b[~np.isnan(b)]
    for got, want in ((r["a50"], np.quantile(a, 0.5)), (r["b50"], np.quantile(bb, 0.5)),
                      (r["b75"], np.quantile(bb, 0.75)), (r["a10"], np.quantile(a, 0.1))):
        assert abs(got - want) < 1e-9 * max(1.0, abs(want))


def test_sequential_ids_unique_under_downstream_joins(spark):
    # ids feed a join and an aggregate in the same plan: positions must come from one copy
    df = spark.range(0, 3000).select((F.col("id") % 97).alias("k"), (F.col("id") % 13).alias("g"))
    ids = sequential_ids(df, ["k"], name="rid")
    counts = ids.groupBy("g").count()
    joined = ids.join(counts, "g")
    assert joined.select("rid").distinct().count() == 3000
    assert joined.agg(F.min("rid"), F.max("rid")).first() == (1, 3000)


def test_quantile_row_of_many_rows_and_heavy_values(spark):
    from matforge.operators.stats import quantile_row

    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).cast("double").alias("a"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.rand(1)).alias("b"))
    p = df.toPandas()
    specs = [(f"{c}{q}", F.col(c), q) for c in ("a", "b") for q in (0.0, 0.1, 0.5, 0.75, 1.0)]
    got = quantile_row(df, [(n.replace(".", "_"), e, q) for n, e, q in specs]).first()
    assert all(abs(got[n.replace(".", "_")] - np.quantile(p[n[0]], q)) < 1e-9 * 1e5 for n, _, q in specs)
    assert quantile_row(df.where("false"), [("x", F.col("a"), 0.5)]).first()["x"] is None


def test_large_ids_keep_all_digits(spark):
    from matforge.operators.requests import normalize_requests

    raw = spark.createDataFrame([(1, "9007199254740993"), (2, None), (3, "5"), (4, "x")], "pos long, id string")
    assert [r.id for r in normalize_requests(raw, ["pos"]).orderBy("pos").collect()] == [9007199254740993, 9007199254740994, 5, 9007199254740995]


def test_svd_takes_few_passes_and_projection_equals_numpy(spark):
    rng = np.random.default_rng(5)
    a = rng.random((150, 120)) * (rng.random((150, 120)) < 0.2)  # a slow spectrum: a method of single vectors reads the rows over 60 times
    a[7] = 0.0  # a document without a known term
    w = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "doc_id long, idx int, weight double")
    w = tx.packed(w).cache()
    sc = spark.sparkContext
    sc.setJobGroup("svd-passes", "")
    comps, s = tx.fit_svd(w, 120, 20)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("svd-passes")) <= 40
    _, exact, vt = np.linalg.svd(a)
    assert np.allclose(s, exact[:20], rtol=1e-9)
    v = vt[:20].T * np.sign(vt[:20].T[np.abs(vt[:20]).argmax(axis=1), range(20)])
    got = {r["doc_id"]: r["svd"] for r in tx.project(w, comps, 20).collect()}
    assert len(got) == 149 and all(np.allclose(got[i], a[i] @ v, atol=1e-6) for i in got)
    w.unpersist()


def test_svd_of_a_matrix_of_low_rank(spark):
    rows = [(i, j, float((i % 2 + 1) * (j + 1))) for i in range(6) for j in range(9)]
    w = spark.createDataFrame(rows, "doc_id long, idx int, weight double")
    comps, s = tx.fit_svd(w, 9, 4)
    a = np.array([r[2] for r in rows]).reshape(6, 9)
    assert len(s) == 1 and np.isclose(s[0], np.linalg.norm(a))
    assert all(len(r["svd"]) == 4 and np.isclose(r["svd"][0], np.linalg.norm(a[r["doc_id"]])) and not any(r["svd"][1:]) for r in tx.project(w, comps, 4).collect())


def test_counts_of_terms_deal_whole_texts(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, None)], "doc_id long, text string")
    plan = tx.term_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(doc_id#" in plan and "term#" not in plan.split("Exchange")[1].splitlines()[0]
