"""Ordered scans without a single-partition window.

``Window.orderBy`` with no partition key moves every row into one task. Here the
rows are range-partitioned on the order key, each partition is scanned locally,
and only one small row per partition (its totals) is combined across partitions;
that offset table is bounded by the partition count, so broadcasting it is safe. The
locally numbered rows are written once (shared storage, survives executor loss) so
that partition-dependent positions are computed exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matforge.session import written

_POS_BITS = 33  # monotonically_increasing_id = partition id << 33 | row position


#: Bytes of rows that a task packs at once; columns from which rows are packed. Of every THIN rows one may be of the sample that ends the ranges, of a task at
#: most TASK_SAMPLE, and RANGE_SAMPLE for each range.
PACK_BYTES, PACK_COLUMNS, THIN, TASK_SAMPLE, RANGE_SAMPLE = 64 << 20, 5, 64, 500, 300
#: Types whose order in Arrow is that of Spark (null first, text by its bytes), and others that a row may have.
_ORDERED = [T.StringType(), T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType(), T.BooleanType(), T.DateType(), T.TimestampType()]
_CARRIED = [*_ORDERED, T.DoubleType(), T.FloatType(), T.BinaryType()]


def _range_sorted(df: DataFrame, order: list[Column | str], num_partitions: int | None) -> DataFrame:
    n = num_partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = {f.name: f.dataType for f in df.schema}
    if len(known) >= PACK_COLUMNS and all(t in _CARRIED for t in known.values()) and all(isinstance(c, str) and known.get(c) in _ORDERED for c in order):
        return _packed_ranges(df, order, n).sortWithinPartitions(*order)
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def _packed_ranges(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The rows in ``n`` ranges of the columns ``order``, shuffled as sorted columns of many rows, compressed: row by row, wide texts take several times as much.

    The ranges' ends come from a sample, as Spark's do; what a range holds does not. The rows are written first, or all that they are derived from would
    be shuffled again for the sample.
    """
    df = written(df, "unsorted-rows")
    spark, schema = df.sparkSession, df.schema
    bounds = _bounds(df.select(*dict.fromkeys(order)), order, n)
    held = spark.sparkContext.broadcast(bounds)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            rows.append(batch)
            size += batch.nbytes
            if size >= PACK_BYTES:
                yield from _pack(pa.Table.from_batches(rows), held.value, order)
                rows, size = [], 0
        if rows:
            yield from _pack(pa.Table.from_batches(rows), held.value, order)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch["rows"]:
                yield from pq.read_table(pa.BufferReader(blob.as_buffer())).to_batches()

    packed = df.mapInArrow(pack, "range int, rows binary")
    return packed.repartitionById(n, packed["range"]).mapInArrow(unpack, schema)


def _sorted(table: pa.Table, order: list[str]) -> np.ndarray:
    return pc.sort_indices(table, sort_keys=[(c, "ascending") for c in dict.fromkeys(order)], null_placement="at_start").to_numpy()


def _bounds(keys: DataFrame, order: list[str], n: int) -> pa.Table:
    """At most n - 1 different keys that part the rows about evenly."""
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Some rows of the task, those of the least random numbers, each with how many rows it stands for."""
        from pyspark import TaskContext

        rng, rows, marks, seen = np.random.default_rng(TaskContext.get().partitionId()), [], np.zeros(0), 0
        for batch in batches:
            seen += batch.num_rows
            rows, marks = pa.Table.from_batches([*rows, batch]), np.concatenate([marks, rng.random(batch.num_rows)])
            few = np.argsort(marks)[:TASK_SAMPLE]
            rows, marks = rows.take(pa.array(few)).combine_chunks().to_batches(), marks[few]
        for batch in rows:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, seen / len(marks)))], names=[*batch.schema.names, "_stands"])

    kind = T.StructType([*keys.schema.fields, T.StructField("_stands", T.DoubleType())])
    found = keys.where(F.rand(7) * THIN < 1).mapInArrow(sample, kind).orderBy(F.rand(7)).limit(RANGE_SAMPLE * n).toArrow()
    found = found.take(pa.array(_sorted(found, order)))
    at = np.zeros(0, np.int64)
    if found.num_rows:
        upto = np.cumsum(found["_stands"].to_numpy())
        at = np.unique(np.minimum(np.searchsorted(upto, upto[-1] * np.arange(1, n) / n), found.num_rows - 1))
    return _distinct(found.drop_columns(["_stands"]).take(pa.array(at)).combine_chunks())


def _distinct(rows: pa.Table) -> pa.Table:
    """Sorted rows without those that equal the one before."""
    same = np.ones(max(0, rows.num_rows - 1), bool)
    for c in rows.columns:
        a, b = c.slice(0, rows.num_rows - 1), c.slice(1)
        same &= pc.fill_null(pc.equal(a, b), False).to_numpy() | (a.is_null().to_numpy() & b.is_null().to_numpy())
    return rows.filter(pa.array(np.concatenate([[True], ~same])[:rows.num_rows]))


def _pack(rows: pa.Table, bounds: pa.Table, order: list[str]) -> Iterator[pa.RecordBatch]:
    """A row (range, rows) for each range that has some: the rows after the bound before it, up to its own."""
    rows = rows.combine_chunks()
    keys = rows.select(list(dict.fromkeys(order)))
    # The bounds come last, so behind the rows that equal them: the sort keeps the order of equal rows.
    at = _sorted(pa.concat_tables([keys, bounds.cast(keys.schema)]).combine_chunks(), order)
    ends = np.flatnonzero(at >= rows.num_rows)
    rows = rows.take(pa.array(np.delete(at, ends))).combine_chunks()
    ends = [*(ends - np.arange(len(ends))).tolist(), rows.num_rows]
    for part, (start, end) in enumerate(zip([0, *ends], ends)):
        if end > start:
            sink = pa.BufferOutputStream()
            pq.write_table(rows.slice(start, end - start), sink, compression="zstd", write_statistics=False, store_schema=False)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["range", "rows"])


def numbered(df: DataFrame, order: list[Column | str], num_partitions: int | None = None) -> DataFrame:
    """Rows in range partitions of ``order``, with the partition (``_pid``) and the place in it (``_pos``), written once.

    Both depend on the physical partition a row was read in, so the per-partition totals and the rows they are added to must come
    from the same copy, whatever plan each branch gets.
    """
    s = _range_sorted(df, order, num_partitions).withColumn("_mid", F.monotonically_increasing_id())
    s = s.withColumn("_pid", F.shiftright("_mid", _POS_BITS)).withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid"), _POS_BITS))
    return written(s.drop("_mid"), "numbered-rows")


def sequential_ids(df: DataFrame, order: list[Column | str], name: str = "id", start: int = 1,
                   num_partitions: int | None = None) -> DataFrame:
    """Ids start, start+1, ... in ``order`` (ties: any order among equal keys).

    Two-level prefix count: rows get their position inside a range partition, partitions
    get an offset from the counts of the partitions before them.
    """
    s = numbered(df, order, num_partitions)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = s.join(F.broadcast(offsets), "_pid")  # one row per partition
    return out.withColumn(name, (F.col("_off") + F.col("_pos") + F.lit(start)).cast("bigint")).drop("_pid", "_pos", "_off")


def running_id_fold(df: DataFrame, order: list[Column | str], raw_id: str, name: str = "id",
                    num_partitions: int | None = None) -> DataFrame:
    """Give rows without a usable integer id the next id of a running maximum.

    Sequential rule: keep m = 0; a row with id x sets m = max(m, x); a row without one
    gets m + 1 and sets m to it. Closed form: with e_i = missing rows up to i,
    m_i = e_i + max(0, max over id rows j <= i of (x_j - e_j)); both are prefix scans, computed by windows
    inside each range partition and combined through a per-partition offset table. ``order`` must be unique per row.
    """
    s = numbered(df.withColumn("_x", F.col(raw_id).cast("bigint")), order, num_partitions)
    upto = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_e", F.sum(F.col("_x").isNull().cast("bigint")).over(upto))
    s = s.withColumn("_m", F.max(F.col("_x") - F.col("_e")).over(upto))
    tot = s.groupBy("_pid").agg(F.max("_e").alias("_ce"), F.max("_m").alias("_cm"))
    pw = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    tot = tot.select("_pid", "_cm", F.coalesce(F.sum("_ce").over(pw), F.lit(0)).alias("_pe"))
    # G_p = max over earlier partitions q of (cm_q - E_q)
    tot = tot.select("_pid", "_pe", F.max(F.col("_cm") - F.col("_pe")).over(pw).alias("_pg"))
    out = s.join(F.broadcast(tot), "_pid")  # one row per partition
    m_glob = F.greatest(F.lit(0), F.coalesce(F.col("_pg"), F.lit(0)), F.coalesce(F.col("_m") - F.col("_pe"), F.lit(0)))
    out = out.withColumn(name, F.coalesce(F.col("_x"), F.col("_pe") + F.col("_e") + m_glob).cast("bigint"))
    return out.drop("_x", "_pid", "_pos", "_e", "_m", "_pe", "_pg")
