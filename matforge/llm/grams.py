"""Corpus-wide totals of hashed keys for lots of documents that hold only their own part of them.

A lot of bounded size sends each of its distinct keys once, sorted, packed and cut by range of the key; a range adds the counts of
all lots and sends back to each lot the totals of the keys it asked for, in the order asked. No table of all keys is
built anywhere, a frequent key is one entry of each lot, and a task holds one range at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from matforge.llm.common import written

ASK = "range long, lot long, keys binary, counts binary"
ANSWER = "lot long, range long, totals binary, owner binary"
STATS = "n long, v long, n1 long, n2 long"
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def pack(a: np.ndarray) -> bytes:
    """Integers as bytes, planes of equal significance together, compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def mix(before: np.ndarray | np.uint64, word: np.ndarray) -> np.ndarray:
    """64-bit hash of a hashed context and the hash that follows it."""
    h = before * _MIX[0] + word
    h ^= h >> np.uint64(31)
    h *= _MIX[1]
    return h ^ (h >> np.uint64(29))


def distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, the number of each value among them) of integers from 0; places are sorted along with the values where
    both fit one word, which is several times faster than sorting indirectly."""
    n = len(code)
    bits = max(1, n.bit_length())
    if not n or int(code.max()).bit_length() + bits > 62:
        return np.unique(code, return_inverse=True)
    both = np.sort((code.astype(np.int64) << bits) | np.arange(n))
    value, at = both >> bits, both & ((1 << bits) - 1)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = value[1:] != value[:-1]
    where = np.empty(n, dtype=np.int64)
    where[at] = np.cumsum(fresh) - 1
    return value[fresh], where


def ask(lot: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows of ASK: the distinct keys of a lot, sorted, in 2^bits ranges."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    ends = [*cut[1:].tolist(), len(keys)]
    kind = "<u4" if int(counts.max(initial=0)) >> 32 == 0 else "<u8"
    counts = counts.astype(kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(part[cut]), pa.array([lot] * len(cut), pa.int64()),
         pa.array([pack(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in zip(cut.tolist(), ends)], pa.binary()),
         pa.array([kind[2:].encode() + pack(counts[a:b]) for a, b in zip(cut.tolist(), ends)], pa.binary())], ["range", "lot", "keys", "counts"])


def _answers(stats: bool):
    def out(part: int, rows: list) -> pa.RecordBatch:
        keys = [np.cumsum(unpack(k, "<u8"), dtype=np.uint64) for _, k, _ in rows]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        count = np.concatenate([unpack(c[1:], f"<u{c[:1].decode()}").astype(np.int64) for _, _, c in rows])
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")  # merges the lots' sorted keys; the first lot of a key owns it
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = np.diff(key[order]) != 0
        total = np.add.reduceat(count[order], np.flatnonzero(fresh))
        where, owner = np.empty(len(key), dtype=np.int64), np.empty(len(key), dtype=bool)
        where[order] = np.cumsum(fresh) - 1
        owner[order] = fresh
        cols: list[list] = [[r[0] for r in rows], [part] * len(rows), [pack(x) for x in np.split(total[where], ends)], [np.packbits(x).tobytes() for x in np.split(owner, ends)]]
        if stats:
            for col in cols:
                col.append(None)
            cols[1][-1] = part
            sums = (int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum()))
            cols += [[None] * len(rows) + [x] for x in sums]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
        names = ["lot", "range", "totals", "owner", "n", "v", "n1", "n2"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names[:len(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = None, []
        for batch in batches:
            for part, lot, k, c in zip(*(batch[x].to_pylist() for x in ("range", "lot", "keys", "counts"))):
                if rows and own != part:
                    yield out(own, rows)
                    rows = []
                own = part
                rows.append((lot, k, c))
        if rows:
            yield out(own, rows)
    return run


def answers(asked: DataFrame, bits: int, name: str, stats: bool = False) -> DataFrame:
    """Rows of ANSWER for rows of ASK: 64-bit totals, and which keys the lot owns (the first lot of a key).

    With ``stats`` a row of null lot for each range besides: the sum of its totals, and how many are positive, 1 and 2.
    """
    dealt = asked.repartitionById(1 << bits, asked["range"].cast("int")).sortWithinPartitions("range", "lot")
    return written(dealt.mapInArrow(_answers(stats), f"{ANSWER}, {STATS}" if stats else ANSWER), name)


def range_bits(keys: int, per_task: int) -> int:
    """So many bits of the key that a range has at most about ``per_task`` of the keys sent."""
    return max(0, -(-keys // per_task) - 1).bit_length()
