"""Steps that were mended for the findings of round 3."""

import gzip
import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matforge.operators import classify as cl
from matforge.operators import models as md
from matforge.operators import stats
from matforge.operators import text as tx
from matforge.plans import queries as q
from matforge.session import scratch_path
from matforge.sources import fixtures as fx
from matforge.sources import sinks as sk
from tests.conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _names(monkeypatch, module):
    """(name, columns) of the tables that a module writes from here on."""
    made, real = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: made.append((name, df.columns)) or real(df, name))
    return made


def test_median_of_a_large_group_by_ranges(spark, monkeypatch):
    """Groups of more values than one task orders: the same medians."""
    rng = random.Random(3)
    rows = [(k, rng.choice([None, float(rng.randrange(300 * (k or 0) + 1))])) for k in (0, 1, 2, 3, None) for _ in range(900)]
    df = spark.createDataFrame(rows, "k int, v double")
    want = {k: float(np.median(v)) for k in (0, 1, 2, 3) for v in [[x for j, x in rows if j == k and x is not None]]}
    monkeypatch.setattr(stats, "GROUP_VALUES", 150)
    made = _names(monkeypatch, stats)
    got = {r.k: r.median for r in stats.grouped_median(df, "k", "v").collect() if r.k is not None}
    assert got == want
    assert [n for n, _ in made] == ["value-counts", "full-sets", "large-groups"]


def test_rows_of_medians_are_read_once(spark, tmp_path, monkeypatch):
    """The rows come to both medians of M9 from one written table, and to a group's median in one pass."""
    spark.createDataFrame([("1", "2"), ("1", "5"), ("2", "4")], "MasterItemNo string, QtyShipped string").write.parquet(str(tmp_path / "t"))
    train = spark.read.parquet(str(tmp_path / "t"))
    assert str(tmp_path) not in _plan(stats.median_per_item(train))
    out = md.quantity_fallback(spark.createDataFrame([("1",), ("9",)], "item_key string"), train)
    assert str(tmp_path) not in _plan(out)
    assert {r.item_key: r.QtyShipped for r in out.collect()} == {"1": 4.0, "9": 4.0}


def test_vendor_documents_are_dealt_by_part_once(spark):
    """After the pairs met their suppliers, one shuffle serves the positions and the documents."""
    plan = _plan(fx.vendor_catalogue_json(spark, SF001))
    assert "hashpartitioning(l_partkey" in plan and "hashpartitioning(item_key" not in plan


def test_schedule_keeps_the_first_vendors(spark, monkeypatch):
    made = _names(monkeypatch, q)
    q.v6(spark, SF001)
    (path,) = [c for n, c in made if n == "vendors"]
    rows = q.vendors.first_vendor(q._vendors(spark, SF001))
    assert path == rows.columns and q.vendors.first_vendor(rows).exceptAll(rows).isEmpty()
    assert q.vendors.schedule_policy(rows).exceptAll(q.vendors.schedule_policy(q._vendors(spark, SF001))).isEmpty()


def test_line_items_carry_no_names_through_the_joins(spark):
    """The names of nation and region come after the joins of the large tables."""
    plan = fx.line_items(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    deep = lambda name: next(len(x) - len(x.lstrip(" :+-")) for x in plan.splitlines() if "Relation" in x and name in x)
    assert deep("r_name") < deep("n_name") < deep("p_name") < deep("o_custkey")


def test_line_files_hold_every_line_once(spark):
    lines = spark.range(0, 2345, 1, 2).select(F.concat(F.lit("x"), "id").alias("line"))
    path = sk.write_line_files(lines, scratch_path(spark, "lines"), "head", 100)
    files = [gzip.open(f, "rt").read().splitlines() for f in glob.glob(path.removeprefix("file:") + "/*.gz")]
    assert len(files) == 24 and all(f[0] == "head" and 1 < len(f) <= 101 for f in files)
    assert sorted(x for f in files for x in f[1:]) == sorted(f"x{i}" for i in range(2345))


def test_csv_scan_moves_no_text(spark, monkeypatch):
    plans = []
    real = sk.write_line_files
    monkeypatch.setattr(sk, "write_line_files", lambda lines, *a: plans.append(_plan(lines)) or real(lines, *a))
    assert q.s1(spark, SF001).count() == fx.table(spark, SF001, "lineitem").count()
    assert "collect_list" not in plans[0] and "hashpartitioning(file" not in plans[0]


def test_fold_classifier_carries_no_texts(spark, monkeypatch):
    made = _names(monkeypatch, q)
    out = q.m6(spark, SF001)
    assert not any("text" in c for n, c in made) and [c for n, c in made if n == "fold-rows"] == [["features", "fold", "label"]]
    assert out.count() == fx.table(spark, SF001, "documents").count()


def test_tokens_are_made_once(spark):
    """Not for each of their uses inside the explode, which shares no expressions."""
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, None)], "doc_id long, text string")
    plan = tx.term_counts(docs)._jdf.queryExecution().optimizedPlan().toString()
    (line,) = [x for x in plan.splitlines() if "Generate" in x]
    assert "regexp_extract_all" not in line and plan.count("regexp_extract_all") == 1
    assert sorted(tuple(r) for r in tx.term_counts(docs).collect()) == [(1, "aa", 2), (1, "aa bb", 1), (1, "bb", 1), (1, "bb aa", 1)]


@pytest.mark.parametrize("rows", [7, 50_000])
def test_classifier_by_blocks(spark, monkeypatch, rows):
    """Blocks of any size give the labels of the plain join of texts and weights, and no pair of them is shuffled."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(25)}"
    data = [(f"i{rng.randrange(40)}", " ".join(word() for _ in range(rng.randrange(5))), rng.randrange(4)) for _ in range(700)]
    frame = spark.createDataFrame(data, "item string, text string, fold int")
    model = cl.fit_term_classifier(frame, "item", "text", F.col("fold"))
    ask = spark.createDataFrame([(" ".join(word() for _ in range(n)),) for n in (1, 2, 3, 4) for _ in range(30)] + [("W1 w2",), ("w2 W1",), ("none",)], "t string")
    monkeypatch.setattr(cl, "BLOCK_ROWS", rows)
    out = cl.classify_texts(model, ask, "t")
    got = {r.text: (r.label, r.score) for r in out.collect()}
    w, labels = {}, {r.label: r for r in model.labels.collect()}
    for r in model.weights.collect():
        w.setdefault(r.term, {})[r.label] = r.weight
    for t in (r.t for r in ask.distinct().collect()):
        terms = [x for x in t.lower().split() if x in w]
        able = {k for x in terms for k in w[x]}
        if not able:
            assert got[t][1] is None
            continue
        score = {k: round(labels[k].prior - len(terms) * labels[k].mass + sum(w[x].get(k, 0.0) for x in terms), 6) for k in able}
        best = min(able, key=lambda k: (-score[k], k))
        assert got[t][0] == best and abs(got[t][1] - score[best]) < 2e-6, t
    assert "hashpartitioning(text" not in _plan(out) and "hashpartitioning(label" in _plan(out)


# ---- F5, F9: term weights over every term

def _term_docs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["pipe", "valve", "Übermaß", "x", "naïve", "42", "a_b", "cable"], k=rng.randrange(40)))) for i in range(60)]
    rows += [(7, "pipe pipe valve"), (None, "cable valve"), (None, "valve"), (100, None), (101, ""), (102, "only once here")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def _rounded(df, *key):
    return sorted(((*(r[k] for k in key), round(r["weight"], 9)) for r in df.collect()), key=str)


@pytest.mark.parametrize("lot_tokens, range_terms", [(1 << 20, 2_000_000), (50, 10), (1, 3)])
def test_term_lots_equal_joins(spark, lot_tokens, range_terms):
    docs = _term_docs(spark)
    tf = tx.term_counts(docs)
    vocab = tx.fit_vocabulary(tf, docs.agg(F.count(F.lit(1)).alias("n_docs")))
    lots = tx.TermLots(tx._dealt(docs, "doc_id", "text", neighbours=True), lot_tokens, range_terms)
    assert _rounded(lots.weights(), "doc_id", "term") == _rounded(tx.tfidf_weights(tf, vocab), "doc_id", "term")
    by = lambda df: sorted((r.term, r.df, round(r.idf, 12)) for r in df.collect())
    assert by(lots.vocabulary()) == by(vocab)
    other = spark.createDataFrame([("a", "pipe valve unseen pipe"), ("b", "nothing known"), ("c", None), (None, "cable valve")], "doc_id string, text string")
    want = tx.transform_tfidf(other, vocab)
    assert _rounded(tx.transform_tfidf(other, lots), "doc_id", "term") == _rounded(want, "doc_id", "term") and want.count() > 5


def test_term_lots_of_nothing(spark):
    none = _term_docs(spark).where("doc_id < 0")
    vocab, w = tx.fit_tfidf(none)
    assert w.count() == 0 and vocab.vocabulary().count() == 0 and tx.transform_tfidf(_term_docs(spark), vocab).count() == 0


def test_tfidf_moves_no_document_term_rows(spark):
    for name in ("m1_tfidf", "m3_tfidf_transform"):
        plan = _plan(q.QUERIES[name](spark, SF001))
        assert "SortMergeJoin" not in plan and "Window" not in plan, name


def test_rows_of_features_are_cleaned_once(spark):
    """j10, m7, m8 (F7): lines are cleaned and written, the quantiles read numbers, and the passes over the features read a written table."""
    from matforge.operators import preprocess as pp

    t, cols = q._reg_features(spark, SF001)
    assert all("/feature-rows-" in f for f in t.inputFiles()) and set(cols) < set(t.columns)
    raw = fx.line_items(spark, SF001).select("QtyShipped", "SIZE_BUILDINGSIZE", "PROJECTNUMBER")
    done = pp.preprocess(raw, q.CFG, drop=("QtyShipped",))
    assert "QtyShipped" not in done.columns and "QtyShipped_clean" in done.columns
    assert "regexp_replace" not in done._jdf.queryExecution().optimizedPlan().toString()
    # The sketch and the counts inside its brackets: two passes, none for the number of values.
    one = stats.quantile_row(spark.read.parquet(f"{SF001}/part.parquet"), [("m", F.col("p_size"), 0.5), ("none", F.lit(None).cast("double"), 0.5)])
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and "lambda" not in plan
    row = one.first()
    assert row["m"] == np.median(spark.read.parquet(f"{SF001}/part.parquet").toPandas()["p_size"]) and row["none"] is None


def test_item_sums_of_many_batches_and_models_without_a_target(spark):
    """Sums of items that lie across batches, one of them without an item and one without a quantity."""
    rows = [(None if i % 7 == 0 else f"i{i % 7}", float(i % 5), None if i % 7 == 3 else 2.0 * (i % 5) + 1) for i in range(700)]
    df = spark.createDataFrame(rows, "item string, x double, q double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {r["item"]: r["coef"] for r in md.fit_item_regressors(df, "item", ["x"], "q").collect()}
        scored = md.score_linear(df, md.fit_item_regressors(df, "item", ["x"], "q"), "item", ["x"]).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {None, "i1", "i2", "i3", "i4", "i5", "i6"} and all(x is None or np.isnan(x) for x in got["i3"])
    assert all(np.allclose(c, [1.0, 2.0], atol=1e-3) for k, c in got.items() if k != "i3")
    known = scored[scored["item"].notna() & (scored["item"] != "i3")]
    assert np.allclose(known["q_item"], known["q"], atol=1e-2) and scored[scored["item"].isna()]["q_item"].isna().all()
