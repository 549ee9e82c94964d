"""End-to-end jobs: training (E1), saved models, and prediction (E2, M15) over line items.

Items come from the term classifier of the group folds; quantities follow the fallback chain per-item linear model ->
global boosted trees -> item median -> global median. The regressors see category codes, numeric size, project
frequency and the description's text components. A model is a set of tables and one fitted pipeline, so what one session trains another
loads from storage.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matforge.config import CATEGORICAL_COLUMNS, CURRENCY_COLUMNS, DATE_COLUMNS, QUANTITY_COLUMNS, PlanConfig
from matforge.functions.cleaning import canonical_item_key
from matforge.operators import classify as cl
from matforge.operators import encode as en
from matforge.operators import models as md
from matforge.operators import preprocess as pp
from matforge.operators import text as tx
from matforge.operators.scan import sequential_ids
from matforge.operators.stats import global_median, label_codes, median_per_item
from matforge.session import path_exists, written

NUMERIC_FEATURES = ["SIZE_BUILDINGSIZE_num", "PROJECT_FREQ"]
ITEM_FEATURES = [f"{c}_code" for c in CATEGORICAL_COLUMNS] + NUMERIC_FEATURES
#: Raw columns that nothing reads once they are cleaned.
RAW = tuple(c for c in (*CURRENCY_COLUMNS, *QUANTITY_COLUMNS, *DATE_COLUMNS) if c != "SIZE_BUILDINGSIZE")
TABLES = ("weights", "labels", "terms", "codes", "categories", "vocab", "components", "item_coefs", "medians", "typical")


@dataclass
class TrainedModels:
    """Tables: classifier (weights, labels, terms), item codes, category codes, text components, per-item coefficients, medians; and the
    boosted trees."""

    weights: DataFrame
    labels: DataFrame
    terms: DataFrame
    codes: DataFrame
    categories: DataFrame
    vocab: DataFrame
    components: DataFrame
    item_coefs: DataFrame
    medians: DataFrame
    typical: DataFrame
    regressor: object
    k: int

    @property
    def classifier(self) -> cl.TermClassifier:
        return cl.TermClassifier(self.weights, self.labels, self.terms)

    @property
    def features(self) -> list[str]:
        return [*ITEM_FEATURES, "svd"]


def _read(df: DataFrame, *more: str) -> DataFrame:
    """The columns of preprocessed rows that codes, classifier and features read, and ``more``, of those that are there: no other goes on."""
    names = ["MasterItemNo", "ItemDescription", "PROJECTNUMBER", *CATEGORICAL_COLUMNS, "SIZE_BUILDINGSIZE", *more]
    return df.select(*(c for c in dict.fromkeys(names) if c in df.columns))


def _texts(df: DataFrame) -> DataFrame:
    """(doc_id, text, n): the distinct descriptions and their rows. Equal texts have equal vectors, which are made once."""
    own = df.groupBy(F.coalesce("ItemDescription", F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return written(own.withColumn("doc_id", F.monotonically_increasing_id()), "distinct-texts")


def _features(df: DataFrame, texts: DataFrame, categories: DataFrame, vocab: DataFrame, comps: DataFrame, k: int) -> DataFrame:
    """Category codes, size, project frequency and the text components (``svd``, a vector) of rows, the latter by ``texts``, the distinct
    descriptions. The vectors are made once a text and stay whole: as columns they are a struct of k numbers to put together again for every row and pass."""
    base = en.apply_category_codes(pp.basic_features(df), categories, list(CATEGORICAL_COLUMNS))
    vectors = tx.project(tx.transform_tfidf(texts, vocab), comps, k)
    svd = array_to_vector(F.coalesce("svd", F.array_repeat(F.lit(0.0), k)))  # no known term
    # Written, so that the join knows its size.
    vectors = written(texts.join(vectors, "doc_id", "left").select(F.col("text").alias("_text"), svd.alias("svd")), "text-vectors")
    return base.join(vectors, F.coalesce("ItemDescription", F.lit("")) == F.col("_text")).drop("_text")


def train_models(train_raw: DataFrame, cfg: PlanConfig = PlanConfig(), svd_k: int = tx.SVD_COMPONENTS, max_rounds: int = md.MAX_ROUNDS) -> TrainedModels:
    """Preprocess -> item codes -> fold classifier -> category codes and text components -> regressors.

    The projects of fold 0 measure when boosting of the global trees ends.
    """
    t = pp.preprocess(train_raw, cfg, drop=RAW).where(F.col("MasterItemNo").isNotNull())
    t = t.withColumn("item_key", canonical_item_key(F.col("MasterItemNo"))).where(F.col("item_key").isNotNull())
    t = written(_read(t, "item_key", "QtyShipped_clean"), "train-rows")  # read by every fit
    codes = label_codes(t.select(F.col("item_key").alias("MasterItemNo"))).select("label", "code", "code1")
    fold = md.group_fold(F.col("PROJECTNUMBER"))
    items = cl.fit_term_classifier(t, "item_key", "ItemDescription", fold)
    categories = en.fit_category_codes(pp.basic_features(t), list(CATEGORICAL_COLUMNS))
    texts = _texts(t)
    vocab, w = tx.fit_tfidf(texts, tx.TRAIN_MAX_FEATURES, copies="n")
    w = w.withColumn("weight", F.col("weight") * F.sqrt("copies"))  # a row of A'A counts as often as its text occurs
    vocab = written(vocab, "train-vocabulary")
    size = vocab.count()
    k = max(1, min(svd_k, size - 1))
    comps, _ = tx.fit_svd(w, size, k)
    feats = _features(t, texts, categories, vocab, comps, k).select("item_key", "QtyShipped_clean", *ITEM_FEATURES, "svd", (fold == 0).alias("held_out"))
    feats = written(feats, "train-features")
    reg = md.fit_global_regressor(feats.where(F.col("QtyShipped_clean").isNotNull()), [*ITEM_FEATURES, "svd"], "QtyShipped_clean", "held_out", max_rounds, vectors={"svd": k})
    coefs = md.fit_item_regressors(feats, "item_key", ITEM_FEATURES, "QtyShipped_clean")
    qty = t.select("MasterItemNo", F.col("QtyShipped_clean").cast("string").alias("QtyShipped"))
    return TrainedModels(items.weights, items.labels, items.terms, codes, categories, vocab, comps, coefs,
                         median_per_item(qty), global_median(qty, "QtyShipped", md.DEFAULT_QTY), reg, k)


def save_models(m: TrainedModels, root: str) -> str:
    """Write a new version below ``root``: one Parquet folder for each table, the pipeline, and last the description that makes
    the version valid. Returns its folder; an interrupted save leaves no version behind that ``load_models`` would take."""
    spark = m.labels.sparkSession
    number = 1 + max(_versions(spark, root), default=0)
    path = f"{root.rstrip('/')}/version={number}"
    for name in TABLES:
        getattr(m, name).write.mode("overwrite").parquet(f"{path}/{name}")
    m.regressor.write().overwrite().save(f"{path}/regressor")
    spark.createDataFrame([(json.dumps({"k": m.k, "tables": list(TABLES)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return path


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the version folders below ``root``, finished or not."""
    if not path_exists(spark, root):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    names = [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]


def load_models(spark: SparkSession, root: str, version: int | None = None) -> TrainedModels:
    """A saved version, the last finished one if none is named."""
    from pyspark.ml import PipelineModel

    done = [v for v in _versions(spark, root) if path_exists(spark, f"{root.rstrip('/')}/version={v}/meta/_SUCCESS")]
    if not done or version is not None and version not in done:
        raise FileNotFoundError(f"no finished model version {version or ''} below {root}")
    path = f"{root.rstrip('/')}/version={version or max(done)}"
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    return TrainedModels(**tables, regressor=PipelineModel.load(f"{path}/regressor"), k=meta["k"])


def predict(m: TrainedModels, test_raw: DataFrame, cfg: PlanConfig = PlanConfig()) -> DataFrame:
    """(id, MasterItemNo, QtyShipped) for every test row; the item is its 1-based code."""
    order = ["MasterItemNo", "ItemDescription", "PROJECTNUMBER", "invoiceDate", "QtyShipped"]
    t = pp.preprocess(test_raw, cfg, drop=tuple(c for c in RAW if c not in order))  # which writes the rows: what follows reads them from there
    if "id" not in t.columns or t.select("id").where(F.col("id").isNotNull()).limit(1).count() == 0:
        t = sequential_ids(_read(t, *order), order, name="id")
    t = _read(t, "id")
    best = cl.classify_texts(m.classifier, t, "ItemDescription").select(F.col("text").alias("_text"), F.col("label").alias("item_key"))
    best = written(best, "text-items")
    feats = _features(t, _texts(t), m.categories, m.vocab, m.components, m.k)
    feats = feats.join(best, F.coalesce("ItemDescription", F.lit("")) == F.col("_text"), "left").drop("_text")
    feats = feats.join(m.codes.select(F.col("label").alias("item_key"), "code1"), "item_key", "left")
    feats = m.regressor.transform(feats).withColumnRenamed("prediction", "q_global")
    feats = md.score_linear(feats, m.item_coefs, "item_key", ITEM_FEATURES, "q_item")
    q = md.quantity_chain(feats, m.medians, m.typical, "item_key", ("q_item", "q_global"))
    return q.select(F.col("id").cast("bigint").alias("id"),
                    F.coalesce(F.col("code1"), F.lit(0)).cast("bigint").alias("MasterItemNo"),
                    F.coalesce(F.col("QtyShipped"), F.lit(0.0)).alias("QtyShipped"))
