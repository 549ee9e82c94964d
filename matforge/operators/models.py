"""Models and prediction (M4-M11, J10, M15) on Spark ML and DataFrame aggregates.

* Target encoding and per-item linear models are built from grouped sufficient
  statistics (counts, sums, X'X, X'y): map-side combinable, exact, and a hot item only
  contributes one partial row per map task — no group is collected into one task.
* Per-item coefficients and label codes join through a shuffle join that AQE may turn
  into a broadcast at run time; only one-row frames are broadcast outright.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matforge.functions.cleaning import canonical_item_key, master_item_int, numeric_text
from matforge.operators.scan import sequential_ids
from matforge.operators.stats import global_median, median_per_item, most_frequent_item
from matforge.session import written

# Defaults of the fallbacks.
DEFAULT_ITEM = 101
DEFAULT_QTY = 1.0
N_FOLDS = 4
MIN_ITEM_ROWS = 20


# ---------------------------------------------------------------------------
# M4 target encoding
# ---------------------------------------------------------------------------

def fit_target_encoding(df: DataFrame, cols: list[str], target: str, min_samples_leaf: int = 20,
                        smoothing: float = 10.0) -> DataFrame:
    """(column, value, encoding): mean target blended with the prior by a sigmoid of the count;
    a value seen once gets the prior. One aggregate per column, combined map-side."""
    prior = written(df.agg(F.avg(F.col(target).cast("double")).alias("prior")), "target-prior")  # one row, computed once
    parts = []
    for c in cols:
        s = df.groupBy(F.col(c).cast("string").alias("value")).agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("mean"))
        parts.append(s.select(F.lit(c).alias("column"), "value", "n", "mean"))
    stats = parts[0]
    for p in parts[1:]:
        stats = stats.unionByName(p)
    stats = stats.crossJoin(F.broadcast(prior))  # one row
    w = 1.0 / (1.0 + F.exp(-(F.col("n") - F.lit(min_samples_leaf)) / F.lit(float(smoothing))))
    enc = F.col("prior") * (1.0 - w) + F.col("mean") * w
    return stats.select("column", "value", "n", F.when(F.col("n") == 1, F.col("prior")).otherwise(enc).alias("encoding"),
                        "prior")


def apply_target_encoding(df: DataFrame, enc: DataFrame, cols: list[str], suffix: str = "_te") -> DataFrame:
    """Replace categories by their encoding; unseen or missing values get the prior."""
    prior = enc.select("prior").limit(1)
    out = df.crossJoin(F.broadcast(prior.withColumnRenamed("prior", "_prior")))
    for c in cols:
        e = enc.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("encoding").alias(f"_e_{c}"))
        out = out.join(e, out[c].cast("string") == e[f"_v_{c}"], "left")
        out = out.withColumn(c + suffix, F.coalesce(F.col(f"_e_{c}"), F.col("_prior"))).drop(f"_v_{c}", f"_e_{c}")
    return out.drop("_prior")


# ---------------------------------------------------------------------------
# M5 group folds
# ---------------------------------------------------------------------------

def group_fold(group: Column, n_folds: int = N_FOLDS) -> Column:
    """Fold of a group (e.g. project): first 32 bits of md5 modulo n. A group never spans folds."""
    g = F.coalesce(group.cast("string"), F.lit("NA"))
    return (F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("bigint") % n_folds).cast("int")


def _spread(loads: list[int], size: int, m: int) -> list[int]:
    """How many of m groups of one size each fold gets when each goes to the fold with the least load (ties: the first)."""
    count = lambda t: [max(0, (t - x) // size + 1) if t >= x else 0 for x in loads]
    lo, hi = min(loads) - 1, max(loads) + size * m
    while hi - lo > 1:  # the largest load at which groups are still placed: all placements below it, then the first folds at it
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if sum(count(mid)) < m else (lo, mid)
    out = count(lo) if lo >= min(loads) else [0] * len(loads)
    for f, x in enumerate(loads):
        if sum(out) < m and hi >= x and (hi - x) % size == 0:
            out[f] += 1
    return out


def balanced_folds(df: DataFrame, group: str, n_folds: int = N_FOLDS) -> DataFrame:
    """M5 balanced by rows: (group, n, fold), one row per group; the largest groups first, each to the fold with the fewest rows.

    Groups of one size are alike, so only the histogram of sizes is gone through in order (its length is at most the square root of twice
    the rows), in one task; which of the groups of a size go to a fold follows from their order by name. A missing group is 'NA'.
    """
    key = F.coalesce(F.col(group).cast("string"), F.lit("NA"))
    sizes = written(df.groupBy(key.alias("group")).agg(F.count(F.lit(1)).alias("n")), "group-sizes")

    def shares(batches):
        loads = [0] * n_folds
        for pdf in batches:
            rows = []
            for n, m in zip(pdf["n"].tolist(), pdf["m"].tolist()):
                got = _spread(loads, n, m)
                loads = [x + n * k for x, k in zip(loads, got)]
                rows.append((n, list(np.cumsum(got).tolist())))
            yield pd.DataFrame(rows, columns=["n", "ends"])

    histogram = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    ends = histogram.coalesce(1).sortWithinPartitions(F.desc("n")).mapInPandas(shares, "n long, ends array<long>")
    numbered = sequential_ids(sizes, ["n", "group"], name="_at", start=0)
    first = numbered.groupBy("n").agg(F.min("_at").alias("_first"))
    placed = numbered.join(first.join(ends, "n"), "n").withColumn("_rank", F.col("_at") - F.col("_first"))
    fold = F.size(F.filter("ends", lambda e: e <= F.col("_rank"))).cast("int")
    return placed.select("group", "n", fold.alias("fold"))


# ---------------------------------------------------------------------------
# M6 classifier (one model per fold, averaged)
# ---------------------------------------------------------------------------

def predict_fold_average(models, df: DataFrame, keep: list[str]) -> DataFrame:
    """Average the fold models' class probabilities and take the arg-max (ties -> lowest class).

    A fold without the last labels gives a shorter vector; its missing classes have probability 0.

    The fold models are applied one after another to the same rows (each writes its own
    probability column), so the average is one projection: no joins, no shuffle.
    """
    from pyspark.ml.functions import vector_to_array

    out = df.select(*keep, "features")
    probs = []
    for i, m in enumerate(models):
        m = m.copy()
        m.setProbabilityCol(f"_pv{i}").setRawPredictionCol(f"_raw{i}").setPredictionCol(f"_pred{i}")
        out = m.transform(out).withColumn(f"_p{i}", vector_to_array(f"_pv{i}")).drop(f"_pv{i}", f"_raw{i}", f"_pred{i}")
        probs.append(f"_p{i}")
    avg = F.col(probs[0])
    for p in probs[1:]:
        avg = F.zip_with(avg, F.col(p), lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    avg = F.transform(avg, lambda x: x / float(len(probs)))
    out = out.select(*keep, avg.alias("probability"))
    best = F.array_position(F.col("probability"), F.array_max(F.col("probability"))) - 1
    return out.select(*keep, "probability", best.cast("double").alias("prediction"))


# ---------------------------------------------------------------------------
# M7 global regressor
# ---------------------------------------------------------------------------

#: Boosting rounds at most, the improvement of the held-out error under which boosting ends, and the depth of a tree.
MAX_ROUNDS, LEAST_GAIN, DEPTH = 400, 0.01, 5


def fit_global_regressor(df: DataFrame, feature_cols: list[str], target: str, held_out: str | None = None, max_iter: int = MAX_ROUNDS,
                         depth: int = DEPTH, max_bins: int = 32, seed: int = 42, vectors: dict[str, int] | None = None):
    """Gradient-boosted trees on assembled numeric features and category codes (missing target -> median upstream). ``vectors`` names the features
    that are vector columns, with their lengths.

    With ``held_out``, a boolean column, those rows only measure the error, and boosting ends when a round no longer lowers it by
    ``LEAST_GAIN``; without it all ``max_iter`` rounds are run on all rows.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler, VectorSizeHint
    from pyspark.ml.regression import GBTRegressor

    trees = GBTRegressor(featuresCol="_x", labelCol=target, maxIter=max_iter, maxDepth=depth, maxBins=max_bins, seed=seed, lossType="squared")
    if held_out:
        trees = trees.setValidationIndicatorCol(held_out).setParams(validationTol=LEAST_GAIN)
    sizes = [VectorSizeHint(inputCol=c, size=n, handleInvalid="optimistic") for c, n in (vectors or {}).items()]
    return Pipeline(stages=[*sizes, VectorAssembler(inputCols=feature_cols, outputCol="_x", handleInvalid="keep"), trees]).fit(df)


# ---------------------------------------------------------------------------
# M8 per-item linear models from sufficient statistics; J10 scoring
# ---------------------------------------------------------------------------

def top_items(df: DataFrame, item: str, k: int | None = None, min_rows: int = MIN_ITEM_ROWS) -> DataFrame:
    """Items that have at least ``min_rows`` rows; with ``k`` the k most frequent of them (ties by key)."""
    top = df.groupBy(item).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    return top if k is None else top.orderBy(F.col("n").desc(), F.col(item).asc()).limit(k)


def item_statistics(df: DataFrame, item: str, feature_cols: list[str], target: str) -> DataFrame:
    """(item, n, xx_i_j, xy_i): the sums X'X and X'y of each item over (1, features), a missing feature as 0; exact.

    The rows are dealt by item with few numbers each (a row of sums is many times as wide), where a partition that one item makes too large is split
    by AQE, and added up in arrays; the sums of an item's parts are added after a second shuffle of one row for each item and part.
    """
    pairs = _pairs(len(feature_cols) + 1)
    s = F.col("_sums")
    xy = [F.when(s[1] > 0, s[2 + len(pairs) + i]).alias(f"xy_{i}") for i in range(len(feature_cols) + 1)]
    sums = _item_sums(df, item, feature_cols, target)
    return sums.select(F.col("_item").alias(item), s[0].cast("bigint").alias("n"), *(s[2 + k].alias(f"xx_{i}_{j}") for k, (i, j) in enumerate(pairs)), *xy)


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def _item_sums(df: DataFrame, item: str, feature_cols: list[str], target: str) -> DataFrame:
    """(_item, _sums): an item's rows, those with a target, X'X and X'y, in one array."""
    pairs = _pairs(len(feature_cols) + 1)
    own = df.select(F.col(item).alias("_item"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(feature_cols, 1)),
                    F.col(target).cast("double").alias("_y"))
    kind = T.StructType([T.StructField("_item", df.schema[item].dataType), T.StructField("_sums", T.ArrayType(T.DoubleType()))])

    def products(batch):
        """n, rows with a target, X'X and X'y of single rows, which are the columns here."""
        x = [np.ones(batch.num_rows)] + [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:-1]]
        y = batch.columns[-1]
        has = y.is_valid().to_numpy(zero_copy_only=False)
        y = np.where(has, y.to_numpy(zero_copy_only=False), 0.0)
        out = np.empty((2 + len(pairs) + len(x), batch.num_rows))
        out[0], out[1] = x[0], has
        for k, (i, j) in enumerate(pairs, 2):
            np.multiply(x[i], x[j], out=out[k])
        for k, v in enumerate(x, 2 + len(pairs)):
            np.multiply(np.where(has, v, 0.0), y, out=out[k])
        return out

    def stored(batch):
        return batch.columns[1].flatten().to_numpy().reshape(batch.num_rows, -1).T

    # By a number, which sorts several times as fast as text; items of one hash may alternate, and their parts are added up below.
    parts = own.hint("rebalance", "_item").sortWithinPartitions(F.xxhash64("_item")).mapInArrow(_added(products), kind)
    return parts.repartition("_item").sortWithinPartitions("_item").mapInArrow(_added(stored), kind)


def _added(numbers):
    """A task that adds up ``numbers`` (one array column for each row of a batch) of equal neighbours in the first column, across batches too."""
    import pyarrow as pa

    def rows(keys, sums):
        ends = pa.array(np.arange(0, sums.size + 1, sums.shape[0]), pa.int32())
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(ends, pa.array(sums.T.ravel()))], names=["_item", "_sums"])

    def task(batches):
        last = None  # the last item of the batches so far and its sums: the next batch may go on with it
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            sums = np.add.reduceat(numbers(batch), first, axis=1)
            keys = keys.take(pa.array(first))
            if last is not None:
                if last[0][0].as_py() == keys[0].as_py():
                    sums[:, 0] += last[1][:, 0]
                else:
                    yield rows(*last)
            last = keys[-1:], sums[:, -1:]
            if len(first) > 1:
                yield rows(keys[:-1], sums[:, :-1])
        if last is not None:
            yield rows(*last)

    return task


def fit_item_regressors(df: DataFrame, item: str, feature_cols: list[str], target: str, ridge: float = 1e-3,
                        k: int | None = None, min_rows: int = MIN_ITEM_ROWS) -> DataFrame:
    """(item, coef array) ridge fits for every item with ``min_rows`` rows (with ``k``: the k most frequent).

    X'X and X'y are those of ``item_statistics``, left in their arrays: as columns they make a method too large for the JVM to compile. Only the
    d x d solves run in pandas, those of a batch of items at once. The fits are written: what they are joined with meets a table of known size.
    """
    d = len(feature_cols) + 1
    n = F.col("_sums")[0]
    stats = _item_sums(df, item, feature_cols, target).where(n >= min_rows)
    if k is not None:
        stats = stats.orderBy(n.desc(), F.col("_item").asc()).limit(k)
    upper = np.triu_indices(d)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.vstack(pdf["_sums"])
        a = np.zeros((len(pdf), d, d))
        a[:, upper[0], upper[1]] = s[:, 2:-d]
        a[:, upper[1], upper[0]] = a[:, upper[0], upper[1]]
        b = np.where(s[:, 1:2] > 0, s[:, -d:], np.nan)  # an item without a target has no model
        coef = np.linalg.solve(a + ridge * np.eye(d), b[:, :, None])[:, :, 0]
        return pd.DataFrame({item: pdf["_item"], "coef": list(coef)})

    schema = T.StructType([T.StructField(item, df.schema[item].dataType), T.StructField("coef", T.ArrayType(T.DoubleType()))])
    return written(stats.mapInPandas(lambda it: (solve(p) for p in it if len(p)), schema), "item-models")


def score_linear(df: DataFrame, coefs: DataFrame, item: str, feature_cols: list[str], name: str = "q_item") -> DataFrame:
    """Dot product with the item's coefficients (null when the item has no model)."""
    xs = [F.lit(1.0), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in feature_cols)]
    j = df.join(coefs.withColumnRenamed(item, "_ci"), df[item] == F.col("_ci"), "left")
    dot = F.lit(0.0)
    for i, x in enumerate(xs):  # written out: Spark compiles no lambdas
        dot = dot + F.get("coef", F.lit(i)) * x
    return j.withColumn(name, F.when(F.col("coef").isNotNull(), dot)).drop("_ci", "coef")


# ---------------------------------------------------------------------------
# M9-M11 fallbacks and decoding
# ---------------------------------------------------------------------------

def quantity_chain(pred: DataFrame, medians: DataFrame, typical: DataFrame, item_key: str = "item_key", model_cols=()) -> DataFrame:
    """M9 over stored tables: the first of ``model_cols`` that is not null, the item's median, the global median; then
    max(1, round half-even)."""
    med = medians.select(F.col("item_key").alias("_mk"), "median_qty")
    j = pred.join(med, pred[item_key] == F.col("_mk"), "left").crossJoin(F.broadcast(typical))  # one row
    q = F.coalesce(*[F.when(~F.isnan(F.col(c)), F.col(c)) for c in model_cols], F.col("median_qty"), F.col("global_median"))
    return j.withColumn("QtyShipped", F.greatest(F.lit(1.0), F.rint(q))).drop("_mk", "median_qty", "global_median")


def quantity_fallback(pred: DataFrame, train: DataFrame, item_key: str = "item_key", model_cols=(),
                      train_item: str = "MasterItemNo", train_qty: str = "QtyShipped") -> DataFrame:
    """M9: per-item model -> global model -> item median -> global median (default 1), from training rows,
    of which the two columns are written once, as both medians read them."""
    train = written(train.select(train_item, train_qty), "training-quantities")
    return quantity_chain(pred, median_per_item(train, train_item, train_qty), global_median(train, train_qty, DEFAULT_QTY), item_key, model_cols)


def decode_items(pred: DataFrame, codes: DataFrame, code_col: str = "pred_code") -> DataFrame:
    """Class code -> raw label -> 1-based code; else the code parsed as an integer; else 0."""
    c = codes.select(F.col("code").alias("_code"), F.col("code1").alias("_code1"))
    j = pred.join(c, pred[code_col] == F.col("_code"), "left")
    parsed = master_item_int(F.col(code_col).cast("string"))
    return j.withColumn("MasterItemNo", F.coalesce(F.col("_code1"), parsed, F.lit(0).cast("bigint"))).drop("_code", "_code1")


def baseline_predictions(test: DataFrame, train: DataFrame, id_col: str = "id") -> DataFrame:
    """Every test row gets the modal item (ties -> smallest number) and the median quantity."""
    top = most_frequent_item(train.withColumn("MasterItemNo", numeric_text(F.col("MasterItemNo")).try_cast("bigint")))
    med = global_median(train, "QtyShipped", DEFAULT_QTY)
    const = top.crossJoin(med).select(
        F.coalesce(F.col("item_key").try_cast("bigint"), F.lit(DEFAULT_ITEM).cast("bigint")).alias("MasterItemNo"),
        F.col("global_median").alias("QtyShipped"))
    return test.select(F.col(id_col).cast("bigint").alias("id")).crossJoin(F.broadcast(const))  # one row

