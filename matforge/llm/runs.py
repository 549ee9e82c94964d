"""Periodic runs of words by an enhanced suffix array (operator 12).

The texts of a batch become one sequence of symbols. A symbol is a word of one document, so no two documents share one,
and each document ends in a symbol of its own. Over it stand:

* the suffix array and its inverse, by prefix doubling; a suffix that is told apart leaves the later rounds. The ranks of every
  round are kept: equal ranks of round k are equal strings of 2^k words;
* the common prefixes of neighbours in the array, from those ranks;
* the LCP intervals, as the binary splits of each interval at a boundary of least common prefix, found through range minima.

The branching-tandem test goes through the suffixes i of the smaller child of every interval of depth d: where ISA[i + d] or
ISA[i - d] lies in the other child, a square of period d stands there that the word after it ends. Each square is rotated to the left as far as it
goes, which gives a maximal run; of several periods of one run the smallest counts. The smaller children hold O(n log n)
suffixes in all, every step works on whole arrays, and no node of a tree is made.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matforge.llm.common import read

#: A run has at least so many words, and at least so many periods.
MIN_LENGTH = 6
MIN_PERIODS = 4
#: Words of the documents that are sorted together, about; a longer document is sorted alone.
BATCH_WORDS = 400_000
#: Suffixes of smaller children that are tested at once.
TEST_BLOCK = 1 << 20


def ranks(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks by round): equal ranks of round k mean equal strings of 2^k symbols.

    symbols: integers from 0, of which the last occurs once.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    own = symbols[order]
    new = np.empty(n, dtype=bool)
    new[0], new[1:] = True, own[1:] != own[:-1]
    rank = np.empty(n, dtype=np.int32)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first
    rounds, width = [rank], 1
    alone = new.copy()
    alone[:-1] &= new[1:]
    active = np.flatnonzero(~alone)  # places of the array that are not settled
    while len(active):
        at = order[active]
        # A string that repeats never reaches the end of its document, so at + width is within the sequence.
        key = rank[at].astype(np.int64) * n + rank[at + width]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[active] = at
        new = np.empty(len(at), dtype=bool)
        new[0], new[1:] = True, key[1:] != key[:-1]
        rank = rank.copy()
        rank[at] = active[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rounds.append(rank)
        alone = new.copy()
        alone[:-1] &= new[1:]
        active, width = active[~alone], 2 * width
    return order, rounds


def extend(rounds: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """Length of the longest common string that starts at, or if ``back`` ends before, the places a and b."""
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        step, rank = 1 << k, rounds[k]
        if back:
            low = np.minimum(a, b) >= step
            same = low & (rank[np.where(low, a - step, 0)] == rank[np.where(low, b - step, 0)])
            move = np.where(same, -step, 0)
        else:
            same = rank[a] == rank[b]
            move = np.where(same, step, 0)
        a += move
        b += move
        out += np.abs(move)
    return out


def intervals(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary j in ``at``: the first and last place of the interval that lcp[j] splits, between its left child [lo, j) and
    its right child [j, hi]. Of equal values in one interval the leftmost splits first."""
    table = [lcp]
    longest = int(np.diff(np.flatnonzero(np.concatenate([[True], lcp[1:] == 0, [True]]))).max(initial=1))
    while 1 << len(table) <= longest:
        half, prev = 1 << (len(table) - 1), table[-1]
        table.append(np.minimum(prev[:-half], prev[half:]) if len(prev) > half else prev[:0])
    depth = lcp[at]
    lo, hi = at.copy(), at.copy()
    for k in range(len(table) - 1, -1, -1):
        step, low = 1 << k, table[k]
        if not len(low):
            continue
        # To the left over greater values, to the right over greater or equal ones.
        start = lo - step
        fits = start >= 0
        lo = np.where(fits & (low[np.where(fits, start, 0)] > depth), start, lo)
        start = hi + 1
        fits = start < len(low)
        hi = np.where(fits & (low[np.where(fits, start, 0)] >= depth), hi + step, hi)
    return lo - 1, hi


def squares(order: np.ndarray, rounds: list[np.ndarray], lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching tandem repeat."""
    n = len(order)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    bounds = np.flatnonzero(lcp > 0)
    if not len(bounds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = intervals(lcp, bounds)
    left = bounds - lo <= hi - bounds + 1
    size = np.where(left, bounds - lo, hi - bounds + 1)
    ends = np.cumsum(size)
    starts, periods = [], []
    at = 0
    while at < len(bounds):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + TEST_BLOCK, side="right")))
        take = np.arange(at, to)
        which = np.repeat(take, size[take])
        off = np.arange(len(which)) - np.repeat(ends[take] - size[take] - base, size[take])
        child = np.where(left[which], lo[which], bounds[which])
        i, d = order[child + off], lcp[bounds[which]].astype(np.int64)
        # The other child, first and last place.
        first = np.where(left[which], bounds[which], lo[which])
        last = np.where(left[which], hi[which], bounds[which] - 1)
        for sign in (1, -1):
            j = i + sign * d
            inside = (j >= 0) & (j < n)
            p = place[np.where(inside, j, 0)]
            hit = inside & (p >= first) & (p <= last)
            starts.append(np.minimum(i, j)[hit])
            periods.append(d[hit])
        at = to
    return np.concatenate(starts), np.concatenate(periods)


def find_runs(symbols: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """Rows (start, length, smallest period) of all maximal runs that are long enough, by start, then period.

    symbols: integers from 0; the last one, and the last one of each document, occurs once.
    """
    if len(symbols) < 2:
        return np.zeros((0, 3), np.int64)
    order, rounds = ranks(symbols)
    lcp = np.zeros(len(order), dtype=np.int32)
    near = np.flatnonzero(rounds[0][order[1:]] == rounds[0][order[:-1]]) + 1
    lcp[near] = extend(rounds, order[near - 1], order[near])
    start, period = squares(order, rounds, lcp)
    end = start + 2 * period
    start = start - extend(rounds, start, start + period, back=True)
    long = end - start >= np.maximum(min_length, min_periods * period)
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    out = np.column_stack([start, end - start, period])[first]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


class _Numbers(dict):
    """Words by number, in the order met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def batch_runs(texts: list[list[bytes]], min_length: int, min_periods: int) -> Iterator[np.ndarray]:
    """The runs of each list of words."""
    number = _Numbers()
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(sizes + 1)])
    word = np.zeros(start[-1], dtype=np.int64)
    for a, words in zip(start.tolist(), texts):
        word[a:a + len(words)] = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    doc = np.repeat(np.arange(len(texts)), sizes + 1)
    word[start[1:] - 1] = len(number)
    found = find_runs(doc * (len(number) + 1) + word, min_length, min_periods)
    at = np.searchsorted(found[:, 0], start)
    for a, lo, hi in zip(start.tolist(), at[:-1], at[1:]):
        own = found[lo:hi].copy()
        own[:, 0] -= a
        yield own


def best(own: np.ndarray) -> tuple[int, int, int]:
    """The run with the greatest exact length / period; ties by start, then period."""
    top = 0
    rows = own.tolist()
    for k in range(1, len(rows)):
        if rows[k][1] * rows[top][2] > rows[top][1] * rows[k][2]:
            top = k
    return tuple(rows[top])


def collapse(words: list[bytes], own: np.ndarray) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    out, at = [], 0
    for a, b in sorted((s + q, s + n) for s, n, q in own.tolist()):
        out += words[at:a]
        at = max(at, b)
    return out + words[at:]


_OUT = T.StructType([T.StructField("n_runs", T.LongType()), T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
                     T.StructField("best", T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])), T.StructField("collapsed", T.StringType())])


def _runs(prepare: Callable | None, min_length: int, min_periods: int, batch_words: int):
    run_kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def out(carried: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        rows: list[list] = [[], [], [], []]
        for words, own in zip(texts, batch_runs(texts, min_length, min_periods)):
            rows[0].append(len(own))
            rows[1].append([dict(zip(("start", "length", "period"), r)) for r in own.tolist()])
            rows[2].append(dict(zip(("start", "length", "period"), best(own))) if len(own) else None)
            rows[3].append(b" ".join(collapse(words, own) if len(own) else words).decode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(carried), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.list_(run_kind)),
                                           pa.array(rows[2], run_kind), pa.array(rows[3], pa.string())], ["carried", *_OUT.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size = [], [], 0
        for batch in batches:
            at = 0
            for k, (key, text) in enumerate(zip(batch["id"].to_pylist(), batch["text"])):
                text = text.as_py()
                words = text.encode("utf-8", "replace").split() if text else []
                if prepare:
                    words = prepare(key, words)
                texts.append(words)
                size += len(words) + 1
                if size >= batch_words:
                    yield out([*held, batch["carried"].slice(at, k + 1 - at)], texts)
                    held, texts, size, at = [], [], 0, k + 1
            if at < len(batch):
                held.append(batch["carried"].slice(at))
        if texts:
            yield out(held, texts)
    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, prepare: Callable | None = None,
                  min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS, batch_words: int = BATCH_WORDS) -> DataFrame:
    """The periodic runs of the words of every whole text.

    Words are maximal runs without ASCII white space. A run is a stretch of words with smallest period q, of at least ``min_length``
    words and ``min_periods`` * q, that no neighbouring word extends keeping period q. ``prepare(id, words)`` may replace a text's
    words first. Returns (carried, n_runs, runs, best, collapsed), one row per input row: carried is a struct of the columns named in
    ``carry`` (the id if none are); runs holds (start, length, period) by start, then period; best is the one of the greatest length /
    period (ties: smallest start, then period), null if there is none; collapsed the words, joined by one space, without those that a run
    contains after its first period. Null and empty texts have no words; ids may be null or repeat, repeated rows are each
    scanned, an empty input gives no rows. No shuffle; a task holds about 200 bytes for each word of the longest document.
    """
    if min_periods < 2:
        raise ValueError("a run has at least two periods")
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                      F.struct(*(F.col(f"`{c}`") for c in carry or [id_col])).alias("carried"))
    return own.mapInArrow(_runs(prepare, min_length, min_periods, batch_words), T.StructType([own.schema["carried"], *_OUT]))


def repeat_tail(doc_id, words: list[bytes]) -> list[bytes]:
    """The words of a document of crc32(id) % 10 = 0 with a periodic tail, as the query defines it; others unchanged.
    A null id has no number, and its words stay."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, the given tenth with periodic tails."""
    top = lambda c: F.col(f"best.{c}")
    line = lambda r: F.concat(*(x for c, e in (("start", ","), ("length", ","), ("period", "\n")) for x in (r[c].cast("string"), F.lit(e))))
    return periodic_runs(read(spark, sf_dir, "documents"), prepare=repeat_tail).select(
        "carried.doc_id", "n_runs", top("start").alias("start"), top("length").alias("length"), top("period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


#: Equal words at every distance up to a quarter of the text; crc32 bit by bit.
OP12_SQL = r"""
WITH w0 AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) AS h FROM documents),
w1 AS (SELECT *, len(w) AS n, h // 10 AS g FROM w0),
w2 AS (SELECT *, g % greatest(n, 1) AS a FROM w1),
w3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w2),
d AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1])) ELSE w END AS w FROM w3),
x AS (SELECT r, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM d),
e AS (SELECT x.r, x.i, y.i - x.i AS q FROM x JOIN x y ON y.r = x.r AND y.word = x.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
st AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM e) GROUP BY r, q, k),
runs AS (SELECT r, start, length, min(q) AS period FROM st WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
lists AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY r),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
drops AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.i) AS t FROM x LEFT JOIN drops ON drops.r = x.r AND drops.i = x.i WHERE drops.i IS NULL GROUP BY x.r)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start, best.length, best.period, 1000 * best.length // best.period AS exponent_milli,
  sha256(coalesce(lists.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN lists ON lists.r = d.r LEFT JOIN best ON best.r = d.r LEFT JOIN kept ON kept.r = d.r
"""
