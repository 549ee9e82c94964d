"""Item classifier, category codes, folds, medians, and models that are saved and loaded."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from matforge.operators import classify as cl
from matforge.operators import encode as en
from matforge.operators import models as md
from matforge.operators import schedule as sch
from matforge.operators import stats
from matforge.plans import jobs
from matforge.session import scratch_path
from matforge.sources import fixtures as fx
from tests.conftest import SF001


def test_classifier_equals_dense_naive_bayes(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(f"item{k}", " ".join(rng.choice(words[k % 7 * 4:k % 7 * 4 + 6]) for _ in range(rng.randrange(0, 6))), rng.randrange(3)) for k in (rng.randrange(20) for _ in range(600))]
    rows += [("rare", "zebra", 1), (None, "w1", 0), ("item1", None, 2)]
    frame = spark.createDataFrame(rows, "item string, text string, fold int")
    model = cl.fit_term_classifier(frame, "item", "text", F.col("fold"), n_folds=3)
    ask = ["w1 w2", "w9 w9 w30 unknown", "zebra w1", "", "nothing known"]
    got = {r.text: r for r in cl.classify_texts(model, spark.createDataFrame([(t,) for t in ask] + [(None,)], "t string"), "t").collect()}
    labelled = [(k, t or "", f) for k, t, f in rows if k is not None]
    labels = sorted({k for k, _, _ in labelled})
    tok = lambda t: [w for w in t.split() if len(w) > 1]
    vocab = {w for _, t, _ in labelled for w in tok(t)}
    holds = defaultdict(set)
    for k, t, _ in labelled:
        for w in tok(t):
            holds[w].add(k)

    def score(text, label):
        out = 0.0
        for f in range(3):
            own = [(k, t) for k, t, g in labelled if g != f]
            c = Counter(w for k, t in own if k == label for w in tok(t))
            out += math.log((sum(k == label for k, _ in own) + 1) / (len(own) + len(labels)))
            out += sum(math.log((c[w] + 1) / (sum(c.values()) + len(vocab))) for w in tok(text) if w in vocab)
        return out

    for t in ask[:3]:
        able = sorted(set().union(*(holds[w] for w in tok(t))))
        best = min(able, key=lambda k: (-round(score(t, k), 6), k))
        assert got[t].label == best and math.isclose(got[t].score, score(t, best), abs_tol=1e-5)
    common = min(labels, key=lambda k: (-round(score("", k), 6), k))
    assert got[""].label == got["nothing known"].label == common and got[""].score is None
    none = cl.fit_term_classifier(frame.limit(0), "item", "text", F.col("fold"))
    assert [r.label for r in cl.classify_texts(none, frame.limit(1), "text").collect()] == [None]


def test_category_codes(spark):
    train = spark.createDataFrame([("b", "x"), ("a", None), (None, "y"), ("b", "x")], "c string, d string")
    codes = en.fit_category_codes(train, ["c", "d"])
    test = spark.createDataFrame([("a", "y"), ("new", None), (None, "z")], "c string, d string")
    got = [tuple(r) for r in en.apply_category_codes(test, codes, ["c", "d"]).select("c_code", "d_code").collect()]
    assert sorted(got) == [(0.0, 3.0), (1.0, 2.0), (3.0, 0.0)]  # __MISSING__ sorts before letters; unseen is the number of values
    none = en.fit_category_codes(train.limit(0), ["c", "d"])
    assert {tuple(r) for r in en.apply_category_codes(test, none, ["c", "d"]).select("c_code", "d_code").collect()} == {(0.0, 0.0)}


def test_spread_equals_one_group_at_a_time():
    rng = random.Random(8)
    for _ in range(2000):
        n = rng.randrange(1, 6)
        loads, size, m = [rng.randrange(0, 30) for _ in range(n)], rng.randrange(1, 9), rng.randrange(0, 25)
        want, now = [0] * n, list(loads)
        for _ in range(m):
            f = min(range(n), key=lambda i: (now[i], i))
            want[f] += 1
            now[f] += size
        assert md._spread(loads, size, m) == want, (loads, size, m)


def test_balanced_folds_put_each_group_in_one_fold(spark):
    rows = [(f"p{k}",) for k in range(40) for _ in range(1 + k * k % 11)] + [(None,)] * 30
    got = md.balanced_folds(spark.createDataFrame(rows, "p string"), "p").collect()
    assert len(got) == len({r.group for r in got}) == 41 and sum(r.n for r in got) == len(rows)
    loads = Counter()
    for r in got:
        loads[r.fold] += r.n
    assert set(loads) == {0, 1, 2, 3} and max(loads.values()) - min(loads.values()) <= max(r.n for r in got)
    assert md.balanced_folds(spark.createDataFrame([], "p string"), "p").count() == 0


@pytest.mark.parametrize("sizes", [(1, 2, 3, 4, 0), (5000, 7, 4001)])
def test_grouped_median_is_exact(spark, sizes):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for k, n in enumerate(sizes):
        v = np.round(rng.normal(size=n), 2 if k % 2 else 6).tolist()
        rows += [(k, x) for x in v] + [(k, None)]
        want[k] = float(np.median(v)) if n else None
    got = {r.k: r.median for r in stats.grouped_median(spark.createDataFrame(rows, "k int, v double"), "k", "v").collect()}
    assert got.keys() == want.keys() and all(got[k] is None if want[k] is None else math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    plan = stats.grouped_median(spark.createDataFrame(rows, "k int, v double"), "k", "v")._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "collect_list" not in plan


def test_keyword_table_equals_the_expression(spark):
    words = (("A", ("cab", "Duct")), ("B", ("le", "tray")), ("C", ("x",)))
    table = [(i * 10 + j, p, w) for i, (p, ws) in enumerate(words) for j, w in enumerate(ws)] + [(99, "D", "")]
    texts = spark.createDataFrame([("cable TRAY",), ("steel",), ("DUCT x",), ("",), (None,), ("box",), ("none",), ("box",)], "t string")
    got = {r.text: r.phase for r in sch.keyword_phases(texts, "t", spark.createDataFrame(table, "priority int, phase string, keyword string"), "Z").collect()}
    want = {r.t: r.p for r in texts.select("t", sch.phase_expr(F.col("t"), words, "Z").alias("p")).collect()}
    assert got == want
    none = sch.keyword_phases(texts, "t", spark.createDataFrame([], "priority int, phase string, keyword string"), "Z")
    assert {r.phase for r in none.collect()} == {"Z"}


def test_prediction_from_disk_equals_prediction_in_memory(spark):
    li = fx.line_items(spark, SF001)
    m = jobs.train_models(li, svd_k=4, max_rounds=3)
    root = scratch_path(spark, "models-test")
    first = jobs.save_models(m, root)
    assert first.endswith("version=1") and jobs.save_models(m, root).endswith("version=2")
    here = sorted(map(tuple, jobs.predict(m, li).collect()))
    there = sorted(map(tuple, jobs.predict(jobs.load_models(spark.newSession(), root, 1), li).collect()))
    assert here == there and len(here) == li.count()
    assert {r[0] for r in here} == set(range(1, len(here) + 1)) and all(r[2] >= 1 for r in here)
    codes = {r.code1 for r in m.codes.collect()}
    assert {r[1] for r in here} <= codes and len({r[1] for r in here}) > 3
    with pytest.raises(FileNotFoundError):
        jobs.load_models(spark, root, 7)
    with pytest.raises(FileNotFoundError):
        jobs.load_models(spark, scratch_path(spark, "nothing"))


def test_boosting_ends_without_gain(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 2 * 3.0).alias("y"), (F.col("id") % 5 == 0).alias("held"))
    model = md.fit_global_regressor(df, ["x"], "y", "held")
    assert model.stages[-1].getNumTrees < 10 and model.transform(df).where(F.abs(F.col("prediction") - F.col("y")) > 0.01).count() == 0


def test_item_statistics_equal_sums_and_keep_rows_narrow(spark):
    rng = np.random.default_rng(9)
    rows = [(None if k % 11 == 0 else f"i{k % 7}", None if k % 5 == 0 else float(rng.integers(9)), float(rng.integers(9)), None if k % 7 == 3 or k % 4 == 0 else float(rng.integers(9))) for k in range(30_000)]
    frame = spark.createDataFrame(rows + [("one", 1.0, 2.0, None)], "item string, a double, b double, q double").repartition(5)
    out = md.item_statistics(frame, "item", ["a", "b"], "q")
    xs = [F.lit(1.0), F.coalesce("a", F.lit(0.0)), F.col("b")]
    want = frame.groupBy("item").agg(F.count(F.lit(1)).alias("n"), *(F.sum(xs[i] * xs[j]).alias(f"xx_{i}_{j}") for i in range(3) for j in range(i, 3)), *(F.sum(x * F.col("q")).alias(f"xy_{i}") for i, x in enumerate(xs)))
    assert out.columns == want.columns and sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan and "HashAggregate" not in plan
    solved = {r.item: r.coef for r in md.fit_item_regressors(frame, "item", ["a", "b"], "q").collect()}
    s = {r.item: r for r in want.collect()}
    for k, coef in solved.items():
        a = np.array([[s[k][f"xx_{min(i, j)}_{max(i, j)}"] for j in range(3)] for i in range(3)]) + 1e-3 * np.eye(3)
        if s[k].xy_0 is None:
            assert k == "i3" and all(x is None or np.isnan(x) for x in coef)  # no quantity: no number, so the next step of the chain counts
        else:
            assert np.allclose(coef, np.linalg.solve(a, [s[k][f"xy_{i}"] for i in range(3)]))
    assert len(solved) == 8 and "one" not in solved
    assert md.item_statistics(frame.limit(0), "item", ["a"], "q").count() == 0


def test_features_read_counts_medians_and_codes_from_tables(spark):
    """The joins meet tables of known size, so a hot project or category is no task of its own, and nothing is derived again for each of them."""
    from matforge.operators import preprocess as pp
    from matforge.plans.queries import CFG

    raw = fx.line_items(spark, SF001).select("PROJECTNUMBER", "MasterItemNo", "QtyShipped", "SIZE_BUILDINGSIZE", "UOM")
    t = pp.basic_features(pp.preprocess(raw, CFG))
    t = en.apply_category_codes(t, en.fit_category_codes(t, ["UOM"]), ["UOM"])
    plan = t.select("PROJECT_FREQ", "UOM_code", "QtyShipped_clean")._jdf.queryExecution().optimizedPlan().toString()
    assert all(any(f"/{name}-" in f for f in t.inputFiles()) for name in ("project-counts", "category-codes", "medians"))
    assert "percentile_approx" not in plan


def test_customers_meet_orders_before_lines(spark):
    plan = fx.line_items(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    depth = lambda text: next(len(x) - len(x.lstrip(" :+-")) for x in lines if text in x)
    assert depth("c_custkey") > depth("(l_orderkey#")


def test_copies_of_a_text_count_like_rows(spark):
    """Components of distinct texts with their counts equal those of all rows, of which the jobs see few."""
    from matforge.operators import text as tx

    pool = ["red bolt steel", "blue bolt", "red ring large ring", "plate", "steel plate blue", ""]
    rows = [(i, pool[i * i % 6]) for i in range(90)]
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    few = whole.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    vocab, w = tx.fit_tfidf(whole, 100)
    vocab2, w2 = tx.fit_tfidf(few, 100, copies="n")
    assert sorted(map(tuple, vocab.select("term", "idx", "idf").collect())) == sorted(map(tuple, vocab2.select("term", "idx", "idf").collect()))
    n = vocab.count()
    _, s = tx.fit_svd(w, n, 3)
    _, s2 = tx.fit_svd(w2.withColumn("weight", F.col("weight") * F.sqrt("copies")), n, 3)
    assert np.allclose(s, s2, rtol=1e-9)
    t = whole.withColumnRenamed("text", "ItemDescription")
    assert jobs._texts(t).count() == len({x for _, x in rows}) and jobs._texts(t).agg(F.sum("n")).first()[0] == 90
