"""Steps that were mended for the findings of round 4."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matforge.functions import cleaning as C
from matforge.operators import preprocess as pp
from matforge.operators import scan as sc
from matforge.operators import term_lots as tl
from matforge.operators import text as tx
from matforge.plans import jobs
from matforge.plans import queries as q
from matforge.sources import fixtures as fx
from tests.conftest import SF001


# ---- F1: end-to-end prediction

def _method_sizes(df):
    """The largest generated method of each stage of the plan, in bytes; the JVM compiles none over 8,000."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        it, out = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan()).iterator(), []
        while it.hasNext():
            out.append(it.next()._3().maxMethodCodeSize())
        return out
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_cleaning_is_compiled(spark):
    sizes = _method_sizes(pp.clean_columns(fx.line_items(spark, SF001)))
    assert sizes and max(sizes) < 8000


def test_every_date_format_is_read(spark):
    texts = ["04/05/2000", "4/5/2000", " 2000-04-05 ", "2000-04-05 10:11:12", "2000-04-05T10:11:12Z", "4/5/00", "2000/04/05", "not a date", "13/45/2000", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.parse_date(F.col("t"))).collect()]
    assert got == [dt.date(2000, 4, 5)] * 7 + [None] * 4


def test_jobs_carry_only_what_is_read(spark, monkeypatch):
    """Prices and dates end with the cleaning, and text components stay one vector a row."""
    made, real = {}, jobs.written
    monkeypatch.setattr(jobs, "written", lambda df, name: made.update({name: df.columns}) or real(df, name))
    li = fx.line_items(spark, SF001).limit(900)
    m = jobs.train_models(li, svd_k=3, max_rounds=2)
    assert set(made["train-rows"]) == {"MasterItemNo", "ItemDescription", "PROJECTNUMBER", "SIZE_BUILDINGSIZE", "QtyShipped_clean", "item_key", *jobs.CATEGORICAL_COLUMNS}
    assert set(made["train-features"]) == {"item_key", "QtyShipped_clean", "svd", "held_out", *jobs.ITEM_FEATURES}
    got = jobs.predict(m, li.withColumn("ItemDescription", F.lit("zzz unseen")))
    assert got.count() == 900 and got.where("QtyShipped < 1").count() == 0  # a text of no known term has a vector too


# ---- F2, F3: components of documents

def _docs(spark):
    rng = np.random.default_rng(5)
    words = ["pipe", "valve", "Übermaß", "naïve", "42", "a_b", "cable", "of", "ab", "abc"]
    rows = [(int(i), " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(150)]
    rows += [(7, "pipe pipe valve"), (None, "cable valve"), (None, "valve"), (200, None), (201, ""), (202, "unique words")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("lot_tokens, range_terms, size", [(1 << 20, 2_000_000, 25), (60, 10, 25), (1, 3, 1000)])
def test_blocks_equal_joins(spark, monkeypatch, lot_tokens, range_terms, size):
    """Weights over the most frequent terms, ties at the last place by term, are those of the joins, and so are the components."""
    docs, defaults = _docs(spark), tl.TermLots.__init__.__defaults__
    monkeypatch.setattr(tl.TermLots.__init__, "__defaults__", (lot_tokens, range_terms))
    monkeypatch.setattr(tl, "BLOCK_DOCS", 7)
    vocab, blocks = tx.fit_tfidf_blocks(docs, size)
    assert defaults == (tl.LOT_TOKENS, tl.RANGE_TERMS)
    want_vocab, want = tx.fit_tfidf(docs, size)
    by = lambda v: [(r.idx, r.term, r.df, round(r.idf, 12)) for r in v.orderBy("idx").collect()]
    assert by(vocab) == by(want_vocab)
    got = []
    for r in blocks.collect():
        at, idx, weight = (np.frombuffer(r[c], t) for c, t in (("sizes", "<i4"), ("idx", "<i4"), ("weight", "<f8")))
        assert len(r.ids) == len(at) <= 7 and at.sum() == len(idx) == len(weight)
        got += [(i, int(j), round(float(w), 9)) for i, j, w in zip(np.repeat(np.array(r.ids, object), at), idx, weight)]
    assert sorted(got, key=str) == sorted(((r.doc_id, r.idx, round(r.weight, 9)) for r in want.collect()), key=str)
    n = vocab.count()
    comps, sing = tx.fit_svd(blocks, n, 3)
    comps2, sing2 = tx.fit_svd(want, n, 3)
    assert np.allclose(sing, sing2, rtol=1e-9)
    vec = lambda w, c: {r.doc_id: r.svd for r in tx.project(w, c, 3).collect()}
    a, b = vec(blocks, comps), vec(want, comps2)
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-6) for k in a)


def test_documents_of_no_terms_have_no_components(spark):
    none = _docs(spark).where("doc_id = 200")
    vocab, blocks = tx.fit_tfidf_blocks(none, 10)
    assert vocab.count() == 0 and blocks.count() == 0


def test_components_move_no_document_term_rows(spark, monkeypatch):
    """Of the documents only distinct terms of a lot are shuffled on the way to the decomposition."""
    plans, real = {}, q.written
    monkeypatch.setattr(q, "written", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or real(df, name))
    assert q.m2(spark, SF001).count() > 100
    assert "Exchange" not in plans["document-weights"] and "Exchange" not in plans["document-vectors"]


def test_fold_classifier_keeps_components_whole(spark):
    """The predictions' plan has no column for each component."""
    plan = q.m6(spark, SF001)._jdf.queryExecution().analyzed().toString()
    assert "svd_0" not in plan and "svd#" in plan


# ---- F5: sequential ids

def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("thin, pack", [(1, 64 << 20), (3, 2000), (10**9, 1000)])
def test_packed_ranges_number_in_order(spark, monkeypatch, thin, pack):
    """Nulls, text beyond ASCII, dates, equal rows and a value that half the rows have: ids in Spark's own order, whatever the sample and the packs."""
    monkeypatch.setattr(sc, "THIN", thin)
    monkeypatch.setattr(sc, "PACK_BYTES", pack)
    rng = np.random.default_rng(2)
    pick = lambda *v: v[rng.integers(len(v))]
    rows = [(pick("hot", "hot", None, "", "Z", "a", "é", "\U0001f600", "￿", "a b"), pick(None, -3, 0, 7, 1 << 40), pick(None, dt.date(1999, 1, 2), dt.date(2020, 5, 6)), pick(True, False, None), i, float(i)) for i in range(900)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "s string, n long, d date, b boolean, i int, x double").repartition(3)
    order = ["s", "n", "d", "b", "i"]
    out = sc.sequential_ids(df, order, num_partitions=5)
    assert out.drop("id").exceptAll(df).isEmpty() and out.count() == 950
    got = [tuple(r)[:5] for r in out.orderBy("id").collect()]
    assert got == [tuple(r)[:5] for r in df.orderBy(*order).collect()]
    assert sorted(r.id for r in out.collect()) == list(range(1, 951))
    assert sc.sequential_ids(df.limit(0), order).count() == 0


def test_wide_rows_are_shuffled_packed(spark, monkeypatch):
    plans, real = {}, sc.written
    monkeypatch.setattr(sc, "written", lambda df, name: plans.update({name: _plan(df)}) or real(df, name))
    assert q.c18(spark, SF001).count() == fx.table(spark, SF001, "lineitem").count()
    assert "rangepartitioning" not in plans["numbered-rows"] and plans["numbered-rows"].count("MapInArrow") == 2
    assert "Join" not in plans["numbered-rows"]  # nor are the joins made anew for the ends of the ranges


# ---- F4: term weights over every term

def test_lots_stay_where_they_are(spark):
    """Only asked terms and their totals are shuffled by lot, not the lots; and their size does not grow with the ranges as text does."""
    plan = _plan(q.m1(spark, SF001))
    lots = [x for x in plan.splitlines() if "FileScan parquet" in x and "term_lots" in x]
    assert "Exchange" not in plan[:plan.index(lots[0])] and "ids" in lots[0] and "Bucketed: true" in lots[0] and "ShuffledHashJoin" in plan
    ids = np.arange(200)
    toks = [[f"w{i * j % 997}" for j in range(60)] for i in ids.tolist()]
    lot = tl._lot(0, pa.array(ids), pa.array(toks, pa.list_(pa.string())))
    size = lambda ranges: sum(len(w.as_py()) for b in tl._ask(ranges, True)(iter([lot])) for w in b["words"])
    text = sum(len(w) + 4 for w in tl._row(lot, 0)["words"].to_pylist())
    assert size(1) < text / 2
