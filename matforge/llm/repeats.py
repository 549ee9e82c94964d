"""Exact repeated strings by column-wise multi-document suffix sorting (operator 5).

Every byte covered by a string of ``length`` bytes that starts at two or more places of the collection is found as
follows, each step a Spark job over the whole table:

1. Lots. Documents are kept in lots of bounded size. In every window of ``length`` bytes the leftmost smallest hash of a
   ``gram``-byte string is an anchor. The rule sees the window only, so two equal windows have anchors with equal grams at the same place
   in them. The totals of all grams come to each lot from key ranges (``grams``); anchors whose gram occurs once cannot
   take part; the rest are few.
2. Segments. The bytes around an anchor that any window over it can hold. The totals of segments (gram and segment hash, 64
   bits each) come to the lots in the same way. Windows of a segment that occurs twice are all repeats, which the lots see by themselves;
   a segment whose gram occurs more often than itself may share windows with others, and one lot sends its bytes.
3. Columns. The different segments of one gram meet in one partition, aligned at the anchor, as a document collection.
   From the last column to the first, each round inserts one symbol of every segment: the suffix order is
   updated by a stable distribution of the inserted symbols (the Burrows-Wheeler symbols of that round, read through the
   order of the round before) and the common prefixes by range minima between neighbours with equal symbol. The columns
   are read from a sequential external file. A window is a repeat if the common prefix with a neighbour
   in the order reaches ``length``.
4. A gram with more than ``crowd`` different segments is split by content until each part is small enough: its windows are
   cut into ranges by their distance before the anchor, and the segments meet by the string that all windows of a range
   share. Segments that agree on all of a range's windows are repeats at once and go on as one; a string
   of its own goes no further. So a string that is in half of all documents is settled in a few rounds.
"""

from __future__ import annotations

import hashlib
import io
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matforge.llm import grams
from matforge.llm.common import partitions_for, read, written

LENGTH = 400
GRAM = 48
#: Segments that one column-wise task gets, about, and beyond which one gram's different segments are split by content; bytes of text in a lot; keys that one range gets, about.
PER_TASK = CROWD = 20_000
LOT_BYTES = 2 << 20
KEYS_PER_TASK = 2_000_000
_BLOCK = 1 << 18
_TABLE = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = np.random.default_rng(11).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hash of every ``gram``-byte string of ``data`` (uint8), by doubling."""
    power, size, at, level = _TABLE[data], 1, 0, 0
    whole, rest = None, gram
    while rest:
        if rest & size:
            part = power[at:len(power)]
            whole = part if whole is None else whole[:len(part)] * _ODD[level + 1] + part
            at, rest = at + size, rest - size
        if rest:
            power = power[:-size] * _ODD[level] + power[size:] if len(power) > size else power[:0]
            power ^= power >> np.uint64(31)
            size, level = size * 2, level + 1
    n = max(0, len(data) - gram + 1)
    h = whole[:n].copy()
    h ^= h >> np.uint64(29)
    h *= _ODD[15]
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors of all windows of ``length`` bytes; none if there is no window."""
    w, found, hashes = length - gram + 1, [], []
    for start in range(0, max(0, len(data) - length + 1), _BLOCK):
        h = gram_hashes(data[start:start + _BLOCK + length - 1], gram)
        m = len(h)
        low = np.uint64((1 << 20) - 1)
        key = (h & ~low) | np.arange(m, dtype=np.uint64)  # ties: the leftmost
        padded = np.full(-(-m // w) * w, ~np.uint64(0))
        padded[:m] = key
        grid = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = m - w + 1
        at = (np.minimum(back[:n], ahead[w - 1:w - 1 + n]) & low).astype(np.int64)
        at = at[np.flatnonzero(np.diff(at, prepend=-1))]
        found.append(at + start)
        hashes.append(h[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pos, first = np.unique(np.concatenate(found), return_index=True)
    return pos, np.concatenate(hashes)[first]


_LOT = "lot long, docs binary, sizes binary, places binary, gram binary, seg binary"


def _lots(length: int, gram: int, lot_bytes: int):
    """Rows of _LOT: documents (carried, text) as one compressed block, and their anchors with gram and segment."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lot, size = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        counts: list[int] = []
        marks: list[list[np.ndarray]] = [[], [], []]

        def out() -> pa.RecordBatch:
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for b in held:
                    w.write_batch(b)
            join = lambda parts, kind: grams.pack(np.concatenate([np.zeros(0, kind), *parts]).astype(kind))
            cols = [sink.getvalue(), grams.pack(np.array(counts, "<i4")), join(marks[0], "<i4"), join(marks[1], "<u8"), join(marks[2], "<i8")]
            return pa.RecordBatch.from_arrays([pa.array([lot], pa.int64()), *(pa.array([c], pa.binary()) for c in cols)],
                                              ["lot", "docs", "sizes", "places", "gram", "seg"])

        for batch in batches:
            body, at = batch.select(["carried", "text"]), 0
            for i, text in enumerate(batch["text"]):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                pos, h = anchors(np.frombuffer(raw, dtype=np.uint8), length, gram)
                seg = np.fromiter((xxhash.xxh3_64_intdigest(raw[max(0, a - reach):a + length], min(a, reach)) for a in pos.tolist()), np.uint64, len(pos))
                counts.append(len(pos))
                # An anchor has the smallest of many hashes: by these nearly all would fall into the first key range.
                for col, v in zip(marks, (pos, grams.mix(np.uint64(0), h), seg.view(np.int64))):
                    col.append(v)
                size += len(raw)
                if size >= lot_bytes:
                    held.append(body.slice(at, i + 1 - at))
                    yield out()
                    lot, size, at = lot + 1, 0, i + 1
                    held.clear(), counts.clear(), [m.clear() for m in marks]
            if at < len(batch):
                held.append(body.slice(at))
        if held:
            yield out()
    return run


def _documents(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _keys(gram: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """One hash of gram and segment."""
    return grams.mix(gram, seg.view(np.uint64))


class Marks:
    """Anchors of a lot with the totals of their grams and, where these occur more than once, of their segments."""

    def __init__(self, row: dict, totals: dict[int, list[bytes]], owner: list[bytes] | None = None):
        self.gram, self.pos, self.seg = grams.unpack(row["gram"], "<u8"), grams.unpack(row["places"], "<i4"), grams.unpack(row["seg"], "<i8")
        self.sizes = grams.unpack(row["sizes"], "<i4")
        if GRAMS not in totals:
            return
        _, where = np.unique(self.gram, return_inverse=True)
        total = np.concatenate([np.zeros(0, np.int64), *(grams.unpack(t, "<i8") for t in totals[GRAMS])])[where]
        self.take = np.flatnonzero(total > 1)  # in reading order
        self.total = total[self.take]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)[self.take]
        self.key = _keys(self.gram[self.take], self.seg[self.take])
        if SEGMENTS not in totals:
            return
        keys, first, where = np.unique(self.key, return_index=True, return_inverse=True)
        back = [grams.unpack(t, "<i8") for t in totals[SEGMENTS]]
        self.alike = np.concatenate([np.zeros(0, np.int64), *back])[where]
        own = [np.unpackbits(np.frombuffer(o, np.uint8))[:len(t)] for o, t in zip(owner, back)]
        mine = np.concatenate([np.zeros(0, np.uint8), *own]).astype(bool)
        self.first = np.zeros(len(self.take), dtype=bool)  # the first place of a segment in the whole table
        self.first[first[mine]] = True


GRAMS, SEGMENTS, FLAGS, SELF = 0, 1, 2, 3


def _lots_with(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict[int, list[bytes]], list[bytes], list[dict]]]:
    """Each lot with the totals, owner bits and flags that came before it."""
    totals: dict[int, list[bytes]] = {GRAMS: [], SEGMENTS: []}
    owner: list[bytes] = []
    flags: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == SELF:
                yield row, totals, owner, flags
                totals, owner, flags = {GRAMS: [], SEGMENTS: []}, [], []
            elif row["kind"] == FLAGS:
                flags.append(row)
            else:
                totals[row["kind"]].append(row["totals"])
                if row["kind"] == SEGMENTS:
                    owner.append(row["owner"])


def _ask_grams(bits: int):
    """Rows of grams.ASK: the different grams of each lot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot, gram in zip(batch["lot"].to_pylist(), batch["gram"].to_pylist()):
                keys, counts = np.unique(grams.unpack(gram, "<u8"), return_counts=True)
                if len(keys):
                    yield grams.ask(lot, keys, counts, bits)
    return run


def _ask_segments(bits: int):
    """Rows of grams.ASK: the different segments of each lot whose gram occurs more than once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, totals, _, _ in _lots_with(batches):
            keys, counts = np.unique(Marks(row, {GRAMS: totals[GRAMS]}).key, return_counts=True)
            if len(keys):
                yield grams.ask(row["lot"], keys, counts, bits)
    return run


_BODY = "gram long, seg long, lot long, doc int, pos int, many boolean, left int, body binary"
_BODY_NAMES = [c.split()[0] for c in _BODY.split(", ")]


def _body_rows(length: int, gram: int):
    """Rows of _BODY: the segments whose first place is in a lot and whose gram has others; many: they occur more than once."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, totals, owner, _ in _lots_with(batches):
            m = Marks(row, totals, owner)
            want = np.flatnonzero(m.first & (m.total > m.alike))
            if not len(want):
                continue
            texts, held, raw, out = _documents(row["docs"])["text"], -1, b"", []
            at = m.take[want]
            for doc, pos, g, seg, alike in zip(m.doc[want].tolist(), m.pos[at].tolist(), m.gram[at].view(np.int64).tolist(), m.seg[at].tolist(), m.alike[want].tolist()):
                if doc != held:  # they come document by document
                    held, raw = doc, texts[doc].as_py().encode("utf-8", "replace")
                out.append((g, seg, row["lot"], doc, pos, alike > 1, min(pos, reach), raw[max(0, pos - reach):pos + length]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], _BODY_NAMES)
    return run


def insert_columns(columns: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Column-wise construction over aligned strings: which windows equal one of another row at the same column.

    columns: (width, rows) symbols, one contiguous row of the file for each column; row i has symbols in
    [start[i], end[i]). Returns two (width - length + 1, rows) boolean arrays: repeated windows, and those of them whose row has
    the smallest ``place`` (default: the row) of the rows with that window.
    """
    width, m = columns.shape
    place = np.arange(m) if place is None else place
    order, lcp = np.arange(m), np.zeros(m + 1, dtype=np.int32)
    found = np.zeros((width - length + 1, m), dtype=bool)
    first = np.zeros_like(found)
    for c in range(width - 1, -1, -1):
        sym = columns[c].astype(np.uint16)
        sym[(c < start) | (c >= end)] = 256
        own = sym[order]
        perm = np.argsort(own, kind="stable")
        own = own[perm]
        same = np.zeros(m + 1, dtype=bool)
        same[1:m] = (own[1:] == own[:-1]) & (own[1:] != 256)
        new = np.zeros(m + 1, dtype=np.int32)
        j = np.flatnonzero(same)
        lo, hi = perm[j - 1] + 1, perm[j]
        new[j] = lcp[hi]
        far = np.flatnonzero(hi > lo)
        if len(far):
            # Ranges end before the last slot of lcp, so the odd entries of reduceat are only spacers.
            new[j[far]] = np.minimum.reduceat(lcp, np.column_stack([lo[far], hi[far] + 1]).ravel())[::2]
        new[j] += 1
        order, lcp = order[perm], new
        if c < len(found):
            tie = lcp >= length
            hit = tie[:-1] | tie[1:]
            if hit.any():
                found[c, order[hit]] = True
                head = np.flatnonzero(hit & ~tie[:-1])  # where a class of equal windows begins
                member = np.flatnonzero(hit)
                least = np.minimum.reduceat(place[order[member]], np.searchsorted(member, head))
                first[c, order[member]] = place[order[member]] == np.repeat(least, np.diff(np.append(np.searchsorted(member, head), len(member))))
    return found, first


_FLAG = "lot long, doc int, pos int, lo int, hi int"


def _repeat_rows(length: int, gram: int, keep_first: bool):
    """Rows of _FLAG: byte ranges around the anchor at ``pos`` whose windows are repeats; with ``keep_first`` only those that have an equal
    window at an earlier place. Segments that occur twice are repeats as a whole, and without ``keep_first`` are left out."""
    reach, width = length - gram, 2 * length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        with tempfile.TemporaryFile() as rows, tempfile.TemporaryFile() as cols:
            start, end, places, silent = [], [], [], []
            for batch in batches:
                for lot, doc, pos, many, left, body in zip(*(batch[c].to_pylist() for c in ("lot", "doc", "pos", "many", "left", "body"))):
                    if (lot, doc, pos) not in seen:
                        seen.add((lot, doc, pos))
                        start.append(reach - left)
                        end.append(reach - left + len(body))
                        places.append((lot, doc, pos))
                        silent.append(many and not keep_first)
                        rows.write((b"\0" * (reach - left) + body).ljust(width, b"\0"))
            m = len(places)
            if not m:
                return
            rows.flush()
            by_row = np.memmap(rows, dtype=np.uint8, mode="r", shape=(m, width))
            for c in range(0, width, 64):
                cols.write(np.ascontiguousarray(by_row[:, c:c + 64].T).tobytes())
            cols.flush()
            by_col = np.memmap(cols, dtype=np.uint8, mode="r", shape=(width, m))
            place = np.empty(m, np.int64)
            place[sorted(range(m), key=places.__getitem__)] = np.arange(m)
            found, first = insert_columns(by_col, np.array(start), np.array(end), length, place)
            del by_row, by_col
        if keep_first:
            found &= ~first
        found[:, np.array(silent)] = False
        own = np.array(places, dtype=np.int64).reshape(-1, 3)
        edge = np.diff(found.astype(np.int8), axis=0, prepend=0, append=0)
        row, c0 = np.nonzero(edge.T == 1)
        c1 = np.nonzero(edge.T == -1)[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(own[row, 0]), pa.array(own[row, 1].astype(np.int32)), pa.array(own[row, 2].astype(np.int32)),
             pa.array((c0 - reach).astype(np.int32)), pa.array((c1 - 1 - reach + length).astype(np.int32))], ["lot", "doc", "pos", "lo", "hi"])
    return run


_NODE = "gram long, x0 int, x1 int, core long, whole long, lo int, hi int, lot long, doc int, pos int, many boolean"
#: Parts that a range of windows is cut into in one round.
CUTS = 2


def _cut_ranges(length: int):
    """Rows of _NODE: the windows [x0, x1] (by their distance before the anchor) of each segment in ``CUTS`` ranges, with the hash of the
    bytes that all windows of a range share, that of all its bytes, and where they begin and end."""
    names, kinds = zip(*(c.split() for c in _NODE.split(", ")))
    types = [{"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                body, left, lowest, n = r["body"], r["left"], r["x0"], r["x1"] - r["x0"] + 1
                for c in range(CUTS):
                    x0, x1 = lowest + n * c // CUTS, lowest + n * (c + 1) // CUTS - 1
                    near, far = max(x0, length - (len(body) - left)), min(x1, left)
                    if x0 <= x1 and near <= far:
                        core = xxhash.xxh3_64_intdigest(body[left - x0:left - x1 + length], 1) - (1 << 63)
                        whole = xxhash.xxh3_64_intdigest(body[left - far:left - near + length], far) - (1 << 63)
                        out.append((r["gram"], x0, x1, core, whole, -far, length - near, r["lot"], r["doc"], r["pos"], r["many"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(types), types)], list(names))
    return run


def _split(bodies: DataFrame, length: int, gram: int, crowd: int, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    """(parts, flags) of the crowded grams' segments: parts of at most ``crowd`` segments, with a column part, and the flags of segments
    that agree on whole ranges. Every round cuts the ranges of crowded parts into ``CUTS``, so there are as many as ``length`` has
    digits to that base; the bytes of segments do not travel with their ranges."""
    key, place = ["gram", "x0", "x1", "core"], ["lot", "doc", "pos"]
    hot, parts, flags = bodies.withColumn("x0", F.lit(0)).withColumn("x1", F.lit(length - gram)), [], []
    while True:
        node = written(hot.select("x0", "x1", *_BODY_NAMES).mapInArrow(_cut_ranges(length), _NODE), "repeats-ranges")
        kinds = node.groupBy(*key, "whole").agg(F.count("*").alias("alike"), F.min(F.struct(*place)).alias("head"))
        kinds = written(kinds.select(*key, "whole", "alike", "head"), "repeats-alike")
        # Written, so that Spark can split the rows of one key in the joins below.
        alike = written(kinds.where("alike > 1").select(*key, "whole", "head"), "repeats-same")
        same = node.join(alike, [*key, "whole"])
        same = same.where(F.struct(*place) != F.col("head")) if keep_first else same.where(~F.col("many"))
        flags.append(same.select(*place, "lo", "hi"))
        sizes = written(kinds.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1"), "repeats-sizes")
        heads = written(kinds.select(*key, "head.*").join(sizes, key), "repeats-heads")
        parts.append(heads.where(F.col("size") <= crowd).select(F.xxhash64(*key).alias("part"), *place).distinct())
        crowded = heads.where(F.col("size") > crowd).select(*place, "x0", "x1")
        if crowded.isEmpty():
            return reduce(DataFrame.unionByName, parts).join(bodies.hint("merge"), place), reduce(DataFrame.unionByName, flags)
        hot = bodies.join(crowded, place)


def covered(n: int, ends: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes of a text of n bytes that the ranges cover."""
    runs: list[tuple[int, int]] = []
    for lo, hi in sorted((max(0, lo), min(n, hi)) for lo, hi in ends):
        if runs and lo <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], hi))
        elif hi > lo:
            runs.append((lo, hi))
    return runs


def _to_lots(lots: DataFrame, columns: list[str], count: int, *before: tuple[int, DataFrame]) -> DataFrame:
    """The rows that go to each lot, kind by kind, and then the lot itself with the given columns."""
    frames = [rows.withColumn("kind", F.lit(kind)) for kind, rows in before] + [lots.select("lot", *columns).withColumn("kind", F.lit(SELF))]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    order = [c for c in ("range", "doc") if c in out.columns]
    return out.repartition(max(1, count), "lot").sortWithinPartitions("lot", "kind", *order)


def repeated_ranges(lots: DataFrame, count: int, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, per_task: int = PER_TASK,
                    keys_per_task: int = KEYS_PER_TASK, keep_first: bool = False) -> list[tuple[int, DataFrame]]:
    """What each lot needs to tell its repeats: totals of its grams and segments, and _FLAG rows of windows that segments share."""
    marks = lots.agg(F.coalesce(F.sum(F.length("gram")), F.lit(0))).first()[0] // 8
    bits = grams.range_bits(marks, keys_per_task)
    names = ["sizes", "places", "gram", "seg"]
    some = grams.answers(lots.select("lot", "gram").mapInArrow(_ask_grams(bits), grams.ASK), bits, "repeats-grams").select("lot", "range", "totals")
    asked = _to_lots(lots, names, count, (GRAMS, some)).mapInArrow(_ask_segments(bits), grams.ASK)
    same = grams.answers(asked, bits, "repeats-segments").select("lot", "range", "totals", "owner")
    bodies = _to_lots(lots, ["docs", *names], count, (GRAMS, some), (SEGMENTS, same)).mapInArrow(_body_rows(length, gram), _BODY)
    bodies = written(bodies, "repeats-bodies")
    crowded = written(bodies.groupBy("gram").agg(F.count("*").alias("kinds")).where(F.col("kinds") > crowd).select("gram"), "repeats-crowded")
    flags = []
    if crowded.isEmpty():
        calm = bodies.withColumn("part", F.xxhash64("gram"))
    else:
        calm = bodies.join(crowded, "gram", "left_anti").withColumn("part", F.xxhash64("gram"))
        parts, alike = _split(written(bodies.join(crowded, "gram", "left_semi"), "repeats-crowded-bodies"), length, gram, crowd, keep_first)
        calm, flags = calm.unionByName(parts.select(*calm.columns)), [alike]
    dealt = calm.repartition(partitions_for(bodies.count(), per_task), "part")
    flags.append(dealt.mapInArrow(_repeat_rows(length, gram, keep_first), _FLAG))
    return [(GRAMS, some), (SEGMENTS, same), (FLAGS, reduce(DataFrame.unionByName, flags))]


_RESULT = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType())]


def _results(length: int, gram: int, keep_first: bool, min_words: int):
    reach = length - gram

    def out(texts: pa.ChunkedArray, ranges: dict[int, list[tuple[int, int]]]) -> list[pa.Array]:
        cols: list[list] = [[] for _ in _RESULT]
        for doc, text in enumerate(texts):
            text = text.as_py()
            raw = text.encode("utf-8", "replace") if text else b""
            runs = covered(len(raw), ranges.get(doc, []))
            if min_words:
                runs = [(lo, hi) for lo, hi in runs if len(raw[lo:hi].split()) >= min_words]
            kept, at = [], 0
            for lo, hi in runs:
                kept.append(raw[at:lo])
                at = hi
            rest = b"".join([*kept, raw[at:]])
            row = (len(raw), sum(h - l for l, h in runs), len(runs), hashlib.sha256(rest).hexdigest(),
                   text if not runs else rest.decode("utf-8", "ignore"))
            for col, v in zip(cols, row):
                col.append(v)
        return [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, totals, owner, flags in _lots_with(batches):
            m = Marks(row, totals, owner)
            ranges: dict[int, list[tuple[int, int]]] = {}
            whole = np.flatnonzero((m.alike > 1) & ~m.first if keep_first else m.alike > 1)
            for doc, pos in zip(m.doc[whole].tolist(), m.pos[m.take[whole]].tolist()):
                ranges.setdefault(doc, []).append((pos - reach, pos + length))
            for f in flags:
                ranges.setdefault(f["doc"], []).append((f["pos"] + f["lo"], f["pos"] + f["hi"]))
            docs = _documents(row["docs"])
            yield pa.RecordBatch.from_arrays([docs["carried"].combine_chunks(), *out(docs["text"], ranges)], ["carried", *(c for c, _ in _RESULT)])
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   crowd: int = CROWD, per_task: int = PER_TASK, carry: list[str] | None = None, keep_first: bool = False, min_words: int = 0,
                   lot_bytes: int = LOT_BYTES, keys_per_task: int = KEYS_PER_TASK) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that starts at two or more places of the collection.

    Returns, for each input row, (carried, n_bytes, n_removed, n_spans, kept_sha256, kept_text); carried is a struct of the
    columns named in ``carry`` (the id if none are), so that clashing names do no harm. Texts are UTF-8 bytes,
    null is empty (its kept_text is null); matches lie inside one document, may overlap and are judged on the
    input. A repeated row is another place. kept_text leaves out a character of which only a part remains.
    With ``keep_first`` the first place of each string stays, in the order in which the table is read, and
    bytes go that a string covers which also starts at an earlier place. Runs that touch fewer than
    ``min_words`` words stay. Ids may be null or repeat; an empty input gives no rows.
    """
    if length <= gram:
        raise ValueError("length must exceed gram")
    own = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in carry or [id_col])).alias("carried"))
    lots = written(own.mapInArrow(_lots(length, gram, lot_bytes), _LOT), "repeats-lots")
    count = lots.count()
    ranges = repeated_ranges(lots, count, length, gram, crowd, per_task, keys_per_task, keep_first)
    schema = T.StructType([own.schema["carried"], *(T.StructField(c, k) for c, k in _RESULT)])
    return _to_lots(lots, ["docs", "sizes", "places", "gram", "seg"], count, *ranges).mapInArrow(_results(length, gram, keep_first, min_words), schema)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, strings of 400 bytes."""
    return remove_repeats(read(spark, sf_dir, "documents")).select("carried.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Every window of 400 bytes, as hexadecimal text, by its digest.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM d WHERE len(h) >= 800)),
twice AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
s AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM w WHERE m IN (SELECT m FROM twice)),
runs AS (SELECT r, min(i) AS lo, max(i) + 400 AS hi FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM s) GROUP BY r, g),
gone AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r),
edges AS (SELECT r, lo, hi FROM runs UNION ALL SELECT r, len(h) // 2, len(h) // 2 FROM d),
parts AS (SELECT r, lo, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo, hi), 0) AS a FROM edges),
kept AS (SELECT p.r, string_agg(substr(d.h, 2 * p.a + 1, 2 * greatest(p.lo - p.a, 0)), '' ORDER BY p.lo, p.a) AS k FROM parts p JOIN d ON d.r = p.r GROUP BY p.r)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept ON kept.r = d.r LEFT JOIN gone ON gone.r = d.r
"""
