"""Corpus pipeline: ordered stages over ``documents``, each written as Parquet and reread as the next one's input.

Every stage reads all that its predecessor kept. Columns of ``documents`` that the stages do not know pass through; helper
columns have names of their own and are dropped again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matforge.llm import decontaminate, packing, repeats, simhash, toxicity
from matforge.llm.common import id_remainder, read, written

#: Documents of at least this toxicity score go.
TOXIC = 0.3
#: Repeated strings of so many bytes are looked for, and cut where they run over so many words. Fifty words of the shortest kind
#: (two letters and a space) have 150 bytes.
REPEAT_BYTES, REPEAT_GRAM, REPEAT_WORDS = 150, 32, 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC`` by a lexicon learned outside the held-out quarter of the labels. Null and empty
    texts score as texts without a hit; repeated rows are each scored; an empty table stays empty."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(id_remainder(F.col("doc_id"), 4) != 2)
    lexicon = toxicity.learn(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, lexicon, out_col="__score").where(F.col("__score") < TOXIC).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that of the smallest id, and of several with it that of the smallest
    fingerprint. Repeated rows count as copies."""
    groups = simhash.near_duplicates(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fingerprint")
    first = groups.groupBy("root_fingerprint").agg(F.min(order).alias("first")).select("first.*")
    key = lambda c: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), c)
    keep = first.select(key(F.col("fingerprint")).alias("__key"))
    own = docs.withColumn("__key", key(F.lpad(F.lower(F.hex(simhash.fingerprints(F.col("text")))), 16, "0")))
    return own.join(keep, "__key").dropDuplicates(["__key"]).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages of ``REPEAT_WORDS`` words or more. The first place of a passage stays (in the order in
    which the table is read), so no passage vanishes from the corpus. Null and empty texts stay as they are; of repeated rows the first stays whole. A document of
    which no word is left goes, one that had none stays."""
    rest = [c for c in docs.columns if c != "text"]
    out = repeats.remove_repeats(docs, length=REPEAT_BYTES, gram=REPEAT_GRAM, carry=rest, keep_first=True, min_words=REPEAT_WORDS)
    out = out.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"\S"))
    changed = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("carried.n_chars"))
               if "n_chars" in docs.columns else None}
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"carried.`{c}`") for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; rows with null or repeated ids are told apart by their
    texts, and repeated rows share their fate."""
    own = docs.withColumn("__row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(F.coalesce("text", F.lit("")), 256)))
    found = decontaminate.contaminated(own, read(spark, sf_dir, "benchmark"), id_col="__row").select(F.col("doc_id").alias("__row")).distinct()
    return own.join(found, "__row", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents in sequences of at most 2048 ids, one row per piece. Null and empty texts are one closing id;
    repeated rows are each packed."""
    return packing.pack(docs, **packing.public_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: SQL expresses none of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
