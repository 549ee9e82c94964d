"""Best-fit packing of tokenised documents by exact-complement hashing (operator 6).

The plan is made on the histogram of piece lengths, which has at most as many rows as a sequence has tokens: index the
sums of single lengths, pairs and triples, consume combinations that fill the gap beside a length exactly as often as
the counts allow, then place what is left best-fit decreasing. A plan line stands for any number of equal sequences;
pieces take their places by their rank within their length, which is counted in two levels.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matforge.llm.common import read, written

CAPACITY = 2048
END = 0
#: Distinct space-separated strings whose ids a task keeps at hand before it starts anew.
CACHED = 300_000
_WHOLE = re.compile(r"\s \s|\s \Z")
_LONG_SPACE = re.compile(r"\s{5000}")


class Encoder:
    """Ids of whole texts, as the tokenizer file gives them without special tokens added.

    ``ranks`` is the same vocabulary as a table of byte strings, which encodes faster: a space before a non-space always
    starts a new word of this tokenizer, so texts are cut there and ids looked up by word. Texts that hold a special
    token's string, or white space that such a cut would split, are encoded whole.
    """

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks and pattern:
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        encode = self._bytes

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= CACHED:
                    self.clear()
                self[word] = ids = encode(" " + word)
                return ids

        self.words = Words()

    def _bytes(self, text: str) -> bytes:
        return np.asarray(self.fast.encode_ordinary(text), dtype="<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.fast is None or any(s in text for s in self.special) or _LONG_SPACE.search(text):
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if _WHOLE.search(text):
            return self._bytes(text)
        first, *rest = text.split(" ")
        return (self._bytes(first) if first else b"") + b"".join(map(self.words.__getitem__, rest))


def _pieces(tokenizer: str, ranks: str | None, pattern: str | None, capacity: int):
    """Rows (doc_id, piece, start, length, ids_crc32, lot, rank): rank counts the lot's pieces of that length."""
    end = np.asarray([END], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, lot, seen = Encoder(tokenizer, ranks, pattern), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            row = []
            for i, text in enumerate(batch["text"]):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                cut = n % capacity or capacity
                starts = [0, *range(cut, n, capacity)]
                for p, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    for col, v in zip(cols, (p, a, b - a, zlib.crc32(ids[4 * a:4 * b]), lot, seen[b - a])):
                        col.append(v)
                    seen[b - a] += 1
                    row.append(i)
            ids_of = batch["doc_id"].take(pa.array(row, pa.int64()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids_of, *(pa.array(c, t) for c, t in zip(cols, kinds))],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "lot", "rank"])
    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences get each; every piece of ``counts`` is used exactly once."""
    have = [0] * (capacity + 1)
    for length, n in counts.items():
        have[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    if have[capacity]:
        out.append(((capacity,), have[capacity]))
        have[capacity] = 0
    at = [s - 1 for s in range(capacity + 1)]  # index of pair sums: the larger part to try next; counts only fall

    def pair(s: int) -> tuple[int, int] | None:
        while at[s] * 2 >= s and s > 1:
            a = at[s]
            if have[a] and have[s - a] and (a != s - a or have[a] > 1):
                return a, s - a
            at[s] -= 1
        return None

    def take(parts: tuple[int, ...]) -> int:
        need = Counter(parts)
        n = min(have[k] // c for k, c in need.items())
        if n:
            out.append((parts, n))
            for k, c in need.items():
                have[k] -= n * c
        return n

    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        if have[length] and have[gap]:
            take((length, gap))
        while have[length] and (two := pair(gap)) and take((length, *two)):
            pass
        third = gap - 2
        while have[length] and third > 0:
            if not (have[third] and (two := pair(gap - third)) and take((length, third, *two))):
                third -= 1
    bins: dict[int, list] = defaultdict(list)  # by room left: [pattern, sequences]
    room: list[int] = []  # sorted
    import bisect

    def put(parts: tuple[int, ...], n: int, left: int) -> None:
        if not bins[left]:
            bisect.insort(room, left)
        bins[left].append([parts, n])

    for length in range(capacity, 0, -1):
        while have[length]:
            i = bisect.bisect_left(room, length)
            if i < len(room):
                left = room[i]
                parts, n = bins[left][-1]
                m = min(n, have[length])
                bins[left][-1][1] -= m
                if not bins[left][-1][1]:
                    bins[left].pop()
                    if not bins[left]:
                        room.pop(i)
                put((*parts, length), m, left - length)
                have[length] -= m
            else:
                q = capacity // length
                m, q = (have[length] // q, q) if have[length] >= q else (1, have[length])
                put((length,) * q, m, capacity - q * length)
                have[length] -= m * q
    out += [(parts, n) for left in bins.values() for parts, n in left]
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), sorted; ranks from there on go to the next sequences."""
    used, slots, base = Counter(), defaultdict(list), 0
    for parts, n in patterns:
        offset = 0
        for length in parts:
            slots[length].append((used[length], base, offset))
            used[length] += n
            offset += length
        base += n
    return {k: np.array(v, dtype=np.int64) for k, v in slots.items()}


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, capacity: int = CAPACITY,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    A document is its ids and then id 0; a longer one is cut into pieces of ``capacity``, of which the first may be shorter.
    Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece. Null and empty texts are
    one id long; ids may be null or repeat, every row is packed; other columns are ignored. Only the
    histogram of lengths, at most ``capacity`` rows, reaches the driver, and the plan made of it the tasks.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(own.dtypes)["doc_id"]
    pieces = written(own.mapInArrow(_pieces(tokenizer, ranks, pattern, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, lot int, rank long"),
                     "packing-pieces")
    lots = pieces.groupBy("lot", "length").agg(F.count("*").alias("n"))
    lots = written(lots, "packing-lots")
    slots = places(plan({r["length"]: r["n"] for r in lots.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Lots times lengths grow with the input: merged, not broadcast.
    ranked = pieces.join(lots.select("lot", "length", before.alias("before")).hint("merge"), ["lot", "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy() + batch["before"].to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                mine, table = length == n, slots[int(n)]
                i = np.searchsorted(table[:, 0], rank[mine], side="right") - 1
                seq[mine], off[mine] = table[i, 1] + rank[mine] - table[i, 0], table[i, 2]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def public_vocabulary() -> dict[str, str]:
    """Arguments of ``pack`` for the public byte-level vocabulary of 50 thousand ids."""
    import public_tokenizers as files

    return {"tokenizer": files.path("byte_bpe_50k.json"), "ranks": files.path("byte_bpe_50k.tiktoken"), "pattern": files.PATTERN}


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    return pack(read(spark, sf_dir, "documents"), **public_vocabulary())
