"""SimHash near-duplicate groups by deletion-variant signatures (operator 8).

A fingerprint of 64 bits is cut into floor(k / 2) + 1 segments, one less than plain pigeonholing needs for k
differing bits, so that in any linked pair at least one segment differs by at most one bit. Each segment is indexed
under its one-wildcard variants (the segment with one bit blanked, and which bit); pairs come from equal variants
and are verified on the whole fingerprint. Only distinct fingerprints take part: copies share one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from matforge.llm.common import components, partitions_for, read, written

BITS = 64
SHINGLE = 3
MAX_DISTANCE = 2
#: A variant shared by more fingerprints than this takes the exact path for crowded variants.
CROWD = 256
#: Distinct fingerprints whose variants one task makes, about.
PER_TASK = 20_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of one text; 0 for null, empty or blank texts.

    Words are maximal runs without ASCII white space, A-Z in lower case. A shingle is ``shingle`` words joined by one
    space, repeats included; a shorter text is one shingle. A bit is 1 if more than half of the XXH64 values
    (UTF-8, seed 42) have it.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        parts = iter([b" ".join(words)])
        n = 1
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(p, 42) for p in parts), dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, 1 << 15):
        ones += np.unpackbits(h[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """Column of ``fingerprint`` for a text column."""
    @F.pandas_udf(T.LongType())
    def udf(s: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, shingle) for x in s], dtype="int64")
    return udf(text)


def variants(fp: Column, distance: int) -> Column:
    """Array of (segment, blanked bit, remaining segment bits): the one-wildcard variants of every segment."""
    cuts = distance // 2 + 1
    edges = [BITS * i // cuts for i in range(cuts + 1)]
    out = []
    for s, (start, end) in enumerate(zip(edges, edges[1:])):
        mask = (1 << (end - start)) - 1
        segment = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit(mask)) if end - start < BITS else fp
        for bit in range(end - start):
            rest = segment.bitwiseAND(F.lit(_signed(mask & ~(1 << bit))))
            out.append(F.struct(F.lit(s * BITS + bit).cast("int").alias("slot"), rest.alias("rest")))
    return F.array(*out)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, distance: int = MAX_DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose connected components are those of all links of at most
    ``distance`` differing bits.

    fps: one long column fp without repeats. A variant with at most ``crowd`` fingerprints gives every pair in it that
    verification keeps. Fingerprints of a more crowded variant are instead compared through the values at most
    ceil(distance / 2) bit flips away from each: two fingerprints are linked through such a value exactly if they are
    close enough, so each bucket is a clique (odd distances: a verified one) of bounded size and yields a star, not
    pairs. No link is lost and no bucket is enumerated quadratically.
    """
    keyed = fps.select("fp", F.explode(variants(F.col("fp"), distance)).alias("v")).select("fp", "v.slot", "v.rest")
    keyed = keyed.withColumn("n", F.count("*").over(Window.partitionBy("slot", "rest"))).where("n > 1")
    keyed = written(keyed, "simhash-variants")
    cold = keyed.where(F.col("n") <= crowd)
    x, y = cold.select("slot", "rest", F.col("fp").alias("a")), cold.select("slot", "rest", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = x.join(y, ["slot", "rest"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    hot = keyed.where(F.col("n") > crowd).select("fp").distinct()
    radius = (distance + 1) // 2
    around = [0]
    for _ in range(radius):
        around = sorted({m ^ (1 << b) for m in around for b in range(BITS)} | set(around))
    point = hot.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in around))).alias("m")).select(
        F.col("fp").bitwiseXOR(F.col("m")).alias("at"), "fp")
    if distance % 2 == 0:
        star = point.withColumn("a", F.min("fp").over(Window.partitionBy("at"))).select("a", F.col("fp").alias("b"))
        star = star.where(F.col("a") != F.col("b"))
    else:
        star = point.select("at", F.col("fp").alias("a")).join(point.select("at", F.col("fp").alias("b")), "at")
        star = star.where((F.col("a") < F.col("b")) & near).select("a", "b")
    return pairs.unionByName(star)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = MAX_DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Group documents whose fingerprints are connected by links of at most ``distance`` bits.

    Returns (id_col, fingerprint, component_id, root_fingerprint), one row per input row, repeated rows included. component_id
    is the smallest non-null id of the group, null if the group has none; groups share it where ids are null or repeat, so
    only root_fingerprint, one fingerprint of the group, names a group. Null, empty and blank texts have fingerprint zero
    and link like any other. Other columns of the input are ignored; an empty input gives an empty result.
    """
    own = docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), shingle).alias("fp"))
    own = written(own, "simhash-fingerprints")
    fps = written(own.select("fp").distinct(), "simhash-distinct")
    fps = fps.repartition(partitions_for(fps.count(), PER_TASK))
    roots = components(links(fps, distance, crowd), "simhash")
    low = own.groupBy("fp").agg(F.min("id").alias("low"))
    root = F.coalesce("root", "fp")
    low = low.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", root.alias("root"), "low")
    least = low.groupBy("root").agg(F.min("low").alias("component_id"))
    named = low.join(least, "root").select("fp", "component_id", "root")
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return own.join(named, "fp").select(
        F.col("id").alias(id_col), digits("fp").alias("fingerprint"), "component_id", digits("root").alias("root_fingerprint"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: three-word shingles, links at two or fewer differing bits."""
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
