"""Aggregations.

Every aggregate is declared with ``groupBy().agg()`` so Spark combines map-side before
the shuffle; hot keys (a null project, one dominant item) only cost one partial row per
map task. Global statistics are one-row frames joined back with ``crossJoin`` of a
single row (a proven size bound).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matforge.functions.cleaning import canonical_item_key, numeric_text
from matforge.operators.scan import numbered, sequential_ids
from matforge.session import written


def demand_per_item(pred: DataFrame, item: str = "MasterItemNo", qty: str = "QtyShipped") -> DataFrame:
    """A1: total predicted quantity per item (rows without an item are dropped, as groupby does)."""
    return (pred.select(canonical_item_key(F.col(item)).alias("item_key"), F.col(qty).cast("double").alias("_q"))
            .where(F.col("item_key").isNotNull())
            .groupBy("item_key").agg(F.sum("_q").alias("Qty")))


#: Different values of a group that one task orders; those of a larger group are ordered in ranges. Sets of groups counted to find the large ones.
GROUP_VALUES, GROUP_SETS = 100_000, 65_536


def grouped_median(df: DataFrame, key: str, value: str, name: str = "median") -> DataFrame:
    """(key, name): exact median of each group; null values do not count, a group without others gets null.

    The rows are counted by group and value, combined map-side, in one pass over ``df``; the counts are written and added up in the order of the
    values. A group with more than ``GROUP_VALUES`` different values is not ordered by one task: its values are dealt by range and a range starts
    at the sum of those before it.
    """
    own = df.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"))
    counts = written(own.groupBy("_k", "_v").agg(F.count("_v").alias("_c")), "value-counts")
    n = F.sum("_c").over(Window.partitionBy("_k"))
    upto = F.sum("_c").over(Window.partitionBy("_k").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    large = _large_groups(counts)
    small = counts if large is None else counts.join(F.broadcast(large), "_k", "left_anti")
    found = _middle(small.withColumns({"_upto": upto, "_n": n}))
    if large is not None:
        found = found.unionByName(_middle(_upto_by_range(counts.join(F.broadcast(large), "_k"))))
    return found.select(F.col("_k").alias(key), (F.col("_lo") + (F.col("_hi") - F.col("_lo")) / 2).alias(name))


def _large_groups(counts: DataFrame) -> DataFrame | None:
    """(_k): the groups with more than ``GROUP_VALUES`` rows of counts, or None. Only groups of a set that has as many are counted one by one."""
    sets = counts.withColumn("_set", F.pmod(F.xxhash64("_k"), F.lit(GROUP_SETS)))
    many = F.count(F.lit(1)) > GROUP_VALUES
    full = written(sets.groupBy("_set").agg(many.alias("_many")).where("_many").select("_set"), "full-sets")
    if full.isEmpty():
        return None
    large = written(sets.join(F.broadcast(full), "_set").where(F.col("_k").isNotNull()).groupBy("_k").agg(many.alias("_many")).where("_many").select("_k"), "large-groups")
    return None if large.isEmpty() else large


def _upto_by_range(counts: DataFrame) -> DataFrame:
    """The counts with their group's sum up to them (``_upto``) and in all (``_n``), through one row for each group and range."""
    s = numbered(counts, ["_k", "_v"])
    own = F.sum("_c").over(Window.partitionBy("_pid", "_k").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum("_c").over(Window.partitionBy("_k").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    parts = s.groupBy("_k", "_pid").agg(F.sum("_c").alias("_c"))
    parts = parts.select("_k", "_pid", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy("_k")).alias("_n"))
    s = s.withColumn("_own", own).join(F.broadcast(parts), ["_k", "_pid"])  # at most a row for each range and each large group
    return s.select("_k", "_v", "_c", (F.col("_before") + F.col("_own")).alias("_upto"), "_n")


def _middle(ranked: DataFrame) -> DataFrame:
    """(_k, _lo, _hi): the values at the middle ranks."""
    at = [F.min(F.when((F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r), F.col("_v"))) for r in (F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2))]
    return ranked.groupBy("_k").agg(at[0].alias("_lo"), at[1].alias("_hi"))


def median_per_item(train: DataFrame, item: str = "MasterItemNo", qty: str = "QtyShipped") -> DataFrame:
    """A2: median numeric quantity per item; unparsable quantities ignored."""
    own = train.select(canonical_item_key(F.col(item)).alias("item_key"), numeric_text(F.col(qty)).alias("_q")).where(F.col("item_key").isNotNull())
    return grouped_median(own, "item_key", "_q", "median_qty")


def global_median(train: DataFrame, qty: str = "QtyShipped", default: float = 1.0) -> DataFrame:
    """A3: one-row frame with the median numeric quantity (``default`` when none parses)."""
    med = quantile_row(train, [("_m", numeric_text(F.col(qty)), 0.5)])
    return med.select(F.coalesce(F.col("_m"), F.lit(float(default))).alias("global_median"))


def mode_per_key(df: DataFrame, key: Column, value: Column, key_name: str = "item_key",
                 value_name: str = "mode_value") -> DataFrame:
    """A4: most frequent non-null value per key, ties -> smallest value.

    Two aggregations (count per (key, value), then ``min_by`` per key) keep a hot key
    to one partial row per map task instead of one large in-memory map.
    """
    counted = (df.select(key.alias(key_name), value.alias("_v")).where(F.col("_v").isNotNull())
               .groupBy(key_name, "_v").agg(F.count(F.lit(1)).alias("_n")))
    return counted.groupBy(key_name).agg(
        F.min_by("_v", F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v"))).alias(value_name))


def mode_description(train: DataFrame, item: str = "MasterItemNo", desc: str = "ItemDescription",
                     blank_as_value: bool = False) -> DataFrame:
    """A4 over line items: item_key -> most frequent description.

    ``blank_as_value=True`` first turns missing descriptions into '' (the vendor lookup page
    does this), otherwise they are ignored (the plan does this).
    """
    d = F.coalesce(F.col(desc), F.lit("")) if blank_as_value else F.col(desc)
    out = mode_per_key(train.where(canonical_item_key(F.col(item)).isNotNull()),
                       canonical_item_key(F.col(item)), d, "item_key", "ItemDescription")
    return out


def most_frequent_item(train: DataFrame, item: str = "MasterItemNo") -> DataFrame:
    """A5: one row with the modal item; ties -> smallest number, then smallest text."""
    k = canonical_item_key(F.col(item))
    counted = train.select(k.alias("item_key")).where(F.col("item_key").isNotNull()).groupBy("item_key").count()
    return counted.agg(F.min_by("item_key", F.struct(
        (-F.col("count")).alias("n"), F.col("item_key").try_cast("double").isNull().alias("text"),
        F.col("item_key").try_cast("double").alias("num"),
        F.col("item_key").alias("k"))).alias("item_key"))


def top_k_values(df: DataFrame, value: Column, k: int, name: str = "value") -> DataFrame:
    """Value counts, highest first, ties by value; a top-k report (limit is the feature)."""
    return (df.select(value.alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(name).asc_nulls_last()).limit(k))


def large_project_flag(df: DataFrame, size_col: str, q: float = 0.75) -> DataFrame:
    """``is_large_project`` = size above the 75th percentile (missing -> 0)."""
    th = quantile_row(df, [("_th", F.col(size_col), q)])
    out = df.crossJoin(F.broadcast(th))  # one row
    out = out.withColumn("is_large_project", F.coalesce((F.col(size_col) > F.col("_th")).cast("int"), F.lit(0)))
    return out.drop("_th")


def project_counts(df: DataFrame, project: str = "PROJECTNUMBER", name: str = "PROJECT_FREQ") -> DataFrame:
    """(_proj, name): the rows of each project, written."""
    key = F.coalesce(F.col(project).cast("string"), F.lit("NA"))
    return written(df.groupBy(key.alias("_proj")).agg(F.count(F.lit(1)).alias(name)), "project-counts")


def project_frequency(df: DataFrame, project: str = "PROJECTNUMBER", name: str = "PROJECT_FREQ", counts: DataFrame | None = None) -> DataFrame:
    """Rows per project on every row (missing project counted as 'NA'); ``counts`` are those of ``project_counts``, if they are there.

    Aggregate-then-join rather than a window: the count is combined map-side, and written,
    so that its size is known: a small table is broadcast and the rows stay where they are. With a large one
    AQE splits a hot project's partition (as that of the rows without a project), which it does
    only if both sides come to the join straight from a shuffle, not from an aggregate.
    """
    key = F.coalesce(F.col(project).cast("string"), F.lit("NA"))
    counts = project_counts(df, project, name) if counts is None else counts
    return df.withColumn("_proj", key).join(counts, "_proj").drop("_proj")


def count_distinct(df: DataFrame, col: str, name: str = "n_distinct") -> DataFrame:
    """A10: distinct non-null values."""
    return df.agg(F.countDistinct(col).alias(name))


def schedule_bounds(schedule: DataFrame) -> DataFrame:
    """One row (project_start, project_finish) = (min Start, max Finish)."""
    return schedule.agg(F.min("Start").alias("project_start"), F.max("Finish").alias("project_finish"))


def label_codes(df: DataFrame, label: str = "MasterItemNo") -> DataFrame:
    """Distinct trimmed labels -> dense codes in sorted order (0-based ``code``, 1-based ``code1``)."""
    labels = df.select(F.trim(F.col(label).cast("string")).alias("label")).where(F.col("label").isNotNull()).distinct()
    out = sequential_ids(labels, ["label"], name="code", start=0)
    return out.withColumn("code1", F.col("code") + 1)


#: Rank error of the sketches that bracket a quantile, as a share of the rows: 1 / BRACKET.
BRACKET = 10_000


def quantile_row(df: DataFrame, specs: list[tuple[str, Column, float]]) -> DataFrame:
    """One-row frame of exact global quantiles, ``specs`` = [(alias, value expression, q), ...].

    A quantile sketch, combined map-side, brackets each target rank: its error is a known share of the rows, and the
    bracket is twice as wide. A second aggregate counts the rows below each bracket and those of each value inside it,
    so only the few values around the target are ordered, and the neighbouring ranks are interpolated
    (lo + (hi - lo) * frac). Nothing is sorted, collected or checkpointed, and no job runs before the action.
    """
    values = [F.when(~F.isnan(e.cast("double")), e.cast("double")) for _, e, _ in specs]
    held = df.select(*(v.alias(f"v{k}") for k, v in enumerate(values)))
    near = [F.percentile_approx(f"v{k}", F.array(F.lit(max(0.0, q - 2 / BRACKET)), F.lit(min(1.0, q + 2 / BRACKET))), F.lit(BRACKET)).alias(f"b{k}")
            for k, (_, _, q) in enumerate(specs)]
    bounds = held.agg(*near, *(F.count(f"v{k}").alias(f"n{k}") for k in range(len(specs))))
    # With few rows a share of them is less than one rank: then every value is inside.
    few = [F.col(f"n{k}") < 4 * BRACKET for k in range(len(specs))]
    edges = [F.when(f, F.array(F.lit(float("-inf")), F.lit(float("inf")))).otherwise(F.col(f"b{k}")).alias(f"b{k}") for k, f in enumerate(few)]
    bounds = bounds.select(*edges, *(f"n{k}" for k in range(len(specs))))
    rows = held.crossJoin(F.broadcast(bounds))  # one row
    each = [x for k in range(len(specs)) for x in (F.lit(k), F.col(f"v{k}"), F.col(f"b{k}")[0], F.col(f"b{k}")[1], F.col(f"n{k}"))]
    part = rows.select(F.stack(F.lit(len(specs)), *each)).toDF("k", "v", "lo", "hi", "n").where(F.col("v") <= F.col("hi"))
    # The number of values goes along with the counts: the bounds are read in one place, or the rows would be read once more for it.
    counts = part.groupBy("k", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    upto = F.sum("c").over(Window.partitionBy("k").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto)
    out = []
    for k, (name, _, q) in enumerate(specs):
        own = F.col("k") == k
        pos = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = (F.min(F.when(own & F.col("v").isNotNull() & (F.col("upto") > r) & (F.col("upto") - F.col("c") <= r), F.col("v"))) for r in (F.floor(pos), F.ceil(pos)))
        value = lo + (hi - lo) * F.max(F.when(own, pos - F.floor(pos)))
        # A rank outside its bracket would be a fault of the sketch; it must not pass as a value.
        out.append(F.when(F.max(F.when(own, F.col("n"))) > 0, F.coalesce(value, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))).alias(name))
    return ranked.agg(*out)
