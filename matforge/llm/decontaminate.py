"""Benchmark decontamination by a BM25 inverted index with block-max WAND (operator 1).

The index holds the test items; every passage of every document is a query against it. Impacts are BM25 weights
divided by the item's own score against itself, so a score is the share of the item that the passage covers and one
threshold fits items of any length. Passages overlap by half and are twice as long as the longest item, so a copied item
lies inside one of them. Pairs above the threshold are verified by the overlap of word shingles, of the item's question
and of its answer separately.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matforge.llm.common import partitions_for, read, written

K1, B = 1.2, 0.75
#: Least share of an item's own BM25 score, and least shares of question and answer shingles.
THRESHOLD, OVERLAP = 0.5, 0.5
SHINGLE = 3
BLOCK = 4
#: Items of one index; a larger benchmark is cut into shards, and documents are run against each, by tasks of so many documents, about.
ITEMS, DOCS_PER_TASK = 2_000, 100_000
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer: the last sentence or line answers; a single sentence is halved."""
    parts = [w for s in _SENTENCE.split(text) if (w := words(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    only = parts[0] if parts else []
    return only[:len(only) // 2], only[len(only) // 2:]


def _shingles(ws: list[str], n: int) -> set:
    return {tuple(ws[i:i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def overlap(part: list[str], passage: list[str], n: int = SHINGLE) -> float:
    """Share of the part's shingles that the passage has; 1 for a part without words."""
    n = min(n, len(part)) or 1
    own = _shingles(part, n)
    return len(own & _shingles(passage, n)) / len(own) if own else 1.0


@dataclass(frozen=True)
class Item:
    """An item with its terms, their counts in it and the number of items that have them, by term."""

    id: int | None
    text: str
    terms: tuple[str, ...]
    counts: tuple[int, ...]
    df: tuple[int, ...]


def describe(items: list[tuple]) -> tuple[list[Item], int, int, int]:
    """(items, their number, words in all, words of the longest) of a benchmark that is at hand as (id, text); items without words are left out."""
    bags = [(i, t, Counter(words(t))) for i, t in items if words(t)]
    df = Counter(t for *_, b in bags for t in b)
    out = [Item(i, t, tuple(sorted(b)), tuple(b[k] for k in sorted(b)), tuple(df[k] for k in sorted(b))) for i, t, b in bags]
    sizes = [sum(x.counts) for x in out]
    return out, len(out), sum(sizes), max(sizes, default=1)


class Index:
    """Postings by term, in item order, in blocks of item numbers with the largest impact of each. All statistics (number of
    items, their words, the longest, and the items of a term) are the whole benchmark's, whichever items are indexed."""

    def __init__(self, items: list[Item], n: int, total: int, width: int, block: int = BLOCK):
        self.items, self.block, self.width = [(x.id, x.text) for x in items], block, max(1, width)
        mean = total / n if n else 1.0
        self.term = {t: i for i, t in enumerate(sorted({t for x in items for t in x.terms}))}
        post: dict[int, list] = defaultdict(list)
        for number, x in enumerate(items):
            size = sum(x.counts)
            own = [math.log(1 + (n - d + 0.5) / (d + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for f, d in zip(x.counts, x.df)]
            whole = sum(own)
            for t, w in zip(x.terms, own):
                post[self.term[t]].append((number, w / whole))
        m = len(self.term)
        self.ids = [[i for i, _ in post[t]] for t in range(m)]
        self.impacts = [[w for _, w in post[t]] for t in range(m)]
        self.block_max = np.zeros((m, -(-len(items) // block)), dtype=np.float32)
        for t in range(m):
            for i, w in post[t]:
                self.block_max[t, i // block] = max(self.block_max[t, i // block], np.float32(w))
        self.term_max = self.block_max.max(axis=1) if items else np.zeros(0, np.float32)

    def search(self, terms: list[int], blocks: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND over the postings of ``terms``: all items of at least ``threshold``, with their scores.

        blocks: the terms' block maxima, summed. Cursors stand in item order; the pivot is the first item that the term maxima up to it
        can lift to the threshold; a pivot whose block cannot reach it sends the cursors past the block.
        """
        ids, impacts, ub = [self.ids[t] for t in terms], [self.impacts[t] for t in terms], [float(self.term_max[t]) for t in terms]
        at, live, found, slack = [0] * len(terms), list(range(len(terms))), [], threshold - 1e-6
        while live:
            live.sort(key=lambda i: ids[i][at[i]])
            reach, pivot = 0.0, -1
            for k, i in enumerate(live):
                reach += ub[i]
                if reach >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = ids[live[pivot]][at[live[pivot]]]
            if blocks[item // self.block] < slack:
                goal = (item // self.block + 1) * self.block
                while goal // self.block < len(blocks) and blocks[goal // self.block] < slack:
                    goal += self.block
            elif ids[live[0]][at[live[0]]] == item:
                score = 0.0
                for i in live:
                    if ids[i][at[i]] != item:
                        break
                    score += impacts[i][at[i]]
                if score >= slack:
                    found.append((item, score))
                goal = item + 1
            else:
                goal = item
            for i in live:
                if ids[i][at[i]] < goal:
                    at[i] = bisect.bisect_left(ids[i], goal, at[i])
            live = [i for i in live if at[i] < len(ids[i])]
        return found

    def passages(self, n: int) -> tuple[int, int, int]:
        """(number, step, size) of the passages of a text of n words."""
        return max(1, -(-n // self.width) - 1), self.width, 2 * self.width

    def query(self, ws: list[str], threshold: float) -> Iterator[tuple[int, int, float]]:
        """(passage, item, score) for every passage of a document and item at or above the threshold."""
        count, step, _ = self.passages(len(ws))
        v = len(self.term)
        if not v or not ws:
            return
        term = np.fromiter(map(self.term.get, ws, repeat(-1)), dtype=np.int64, count=len(ws))
        pos = np.flatnonzero(term >= 0)
        term, own = term[pos], pos // step
        first, second = own < count, own > 0
        key = np.unique(np.concatenate([own[first] * v + term[first], (own[second] - 1) * v + term[second]]))
        passage, term = key // v, key % v
        able = np.bincount(passage, weights=self.term_max[term], minlength=count) >= threshold - 1e-6
        keep = able[passage]
        passage, term = passage[keep], term[keep]
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        for lo in range(0, len(starts), 4096):
            part = starts[lo:lo + 4096]
            end = starts[lo + 4096] if lo + 4096 < len(starts) else len(term)
            sums = np.add.reduceat(self.block_max[term[part[0]:end]], part - part[0], axis=0)
            for j in np.flatnonzero((sums >= threshold - 1e-5).any(axis=1)):
                stop = part[j + 1] if j + 1 < len(part) else end
                for item, score in self.search(term[part[j]:stop].tolist(), sums[j] + 1e-5, threshold):
                    yield int(passage[part[j]]), item, score


_FOUND = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]


def _verified(index: Index, parts: list[tuple], ids: pa.Array, texts: pa.Array, threshold: float, least: float) -> pa.RecordBatch:
    """Rows of _FOUND: passages of documents and the items that they hold."""
    cols: list[list] = [[] for _ in range(5)]
    for row, text in enumerate(texts):
        ws = words(text.as_py())
        _, step, size = index.passages(len(ws))
        for p, item, score in index.query(ws, threshold):
            passage = ws[p * step:p * step + size]
            q, a = (overlap(x, passage) for x in parts[item])
            if q >= least and a >= least:
                for col, x in zip(cols, (row, item, min(score, 1.0), q, a)):
                    col.append(x)
    own = pa.array([index.items[i][0] for i in cols[1]], pa.int64())
    return pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), own, *(pa.array(c, pa.float64()) for c in cols[2:])], _FOUND)


def _matches(items: list[Item], stats: tuple, block: int, threshold: float, least: float):
    """Documents against items that the task was given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, *stats, block)
        parts = [question_and_answer(t) for _, t in index.items]
        for batch in batches:
            yield _verified(index, parts, batch["doc_id"], batch["text"], threshold, least)
    return run


def _shard_matches(stats: tuple, block: int, threshold: float, least: float):
    """Documents against the items of their shard, which come before them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, items, index, parts = None, [], None, []
        for batch in batches:
            kinds, places = batch["kind"].to_pylist(), list(zip(batch["shard"].to_pylist(), batch["share"].to_pylist()))
            at = 0
            while at < len(batch):
                end = at
                while end < len(batch) and (kinds[end], places[end]) == (kinds[at], places[at]):
                    end += 1
                if places[at] != place:
                    place, items, index = places[at], [], None
                rows = batch.slice(at, end - at)
                if kinds[at] == 0:
                    items += [Item(r["item_id"], r["text"], tuple(r["terms"]), tuple(r["counts"]), tuple(r["df"])) for r in rows.to_pylist()]
                elif items:
                    if index is None:
                        index = Index(items, *stats, block)
                        parts = [question_and_answer(t) for _, t in index.items]
                    yield _verified(index, parts, rows["doc_id"], rows["text"], threshold, least)
                at = end
    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, t, k, f) for i, t in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist()) for k, f in sorted(Counter(words(t)).items())]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()))], ["item_id", "text", "term", "n"])


def described_items(tests: DataFrame) -> DataFrame:
    """(item_id, text, terms, counts, df) of every different item with words; df counts the items that have a term."""
    terms = written(tests.dropDuplicates(["item_id", "text"]).mapInArrow(_item_terms, "item_id long, text string, term string, n long"), "benchmark-terms")
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    held = F.sort_array(F.collect_list(F.struct("term", "n", "df")))
    items = terms.join(df, "term").groupBy("item_id", "text").agg(held.alias("held"))
    return written(items.select("item_id", "text", F.col("held.term").alias("terms"), F.col("held.n").alias("counts"), F.col("held.df").alias("df")), "benchmark-items")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: float = OVERLAP, block: int = BLOCK, items: int = ITEMS,
                 id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", per_task: int = DOCS_PER_TASK) -> DataFrame:
    """Pairs of a document and a test item that one of its passages holds.

    Returns (doc_id, item_id, score, question_overlap, answer_overlap, n_passages), one row per pair of ids with the best passage's
    figures: every pair whose normalised BM25 score and both overlaps reach their thresholds. Spark counts the statistics over all
    items once, so the pairs do not depend on ``items``. Up to so many items travel with the tasks; of a larger benchmark each shard of
    about so many is sent, as a table, to the tasks that read documents against it. Null, empty and wordless texts and items match nothing;
    repeated rows of an item are one; ids may be null or repeat; other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(own.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id long, score double, question_overlap double, answer_overlap double"
    tests = described_items(benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL"))
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    stats = tuple(tests.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(1))).first())
    cuts = partitions_for(stats[0], items)
    if cuts == 1:
        held = sorted((Item(r["item_id"], r["text"], tuple(r["terms"]), tuple(r["counts"]), tuple(r["df"])) for r in tests.collect()), key=lambda x: (x.id is None, x.id, x.text))
        found = own.mapInArrow(_matches(held, stats, block, threshold, least), schema)
    else:
        shares = partitions_for(own.count(), per_task)
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        none = lambda frame, c: F.lit(None).cast(dict(frame.dtypes)[c]).alias(c)
        rows = tests.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(cuts)).cast("int")).withColumn("share", each(shares)).select(
            "shard", "share", F.lit(0).alias("kind"), none(own, "doc_id"), "item_id", "text", "terms", "counts", "df")
        rows = rows.unionByName(own.withColumn("share", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shares)).cast("int")).withColumn("shard", each(cuts)).select(
            "shard", "share", F.lit(1).alias("kind"), "doc_id", none(tests, "item_id"), "text", *(none(tests, c) for c in ("terms", "counts", "df"))))
        found = rows.repartition(cuts * shares, "shard", "share").sortWithinPartitions("shard", "share", "kind", "item_id").mapInArrow(
            _shard_matches(stats, block, threshold, least), schema)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best"), F.count("*").cast("int").alias("n_passages")).select("doc_id", "item_id", "best.*", "n_passages")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
