"""Term counts of documents that stay in lots of bounded size (M1, M3 without a vocabulary of a given size).

A lot sends each of its distinct terms once, as text and with the number of its documents that have it, to a range of terms; the
range adds up the lots and sends back numbers only, in the order asked. No (document, term) row is shuffled, written or sorted as text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matforge.session import written_in_buckets

#: Tokens of a lot, and distinct terms that a range gets from the lots, about.
LOT_TOKENS, RANGE_TERMS = 1 << 21, 2_000_000
_INTS = ["first", "second", "sizes", "term", "tf"]
LOT = "lot long, docs long, terms long, ids array<{kind}>, words binary, " + ", ".join(f"{c} binary" for c in _INTS)
ASK = "range int, lot long, words binary, first binary, second binary, df binary"
ANSWER = "lot long, range int, totals binary"


def _one(values: pa.Array) -> pa.ListArray:
    """The values as the only row of a list column."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _pack(values: np.ndarray) -> bytes:
    """Integers of 32 bits by their differences, planes of equal significance together, compressed."""
    planes = np.diff(values.astype("<i4"), prepend=np.int32(0)).view(np.uint8).reshape(-1, 4).T
    return len(values).to_bytes(8, "little") + pa.Codec("zstd").compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed[8:], 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel(), dtype=np.int32)


def _lot(lot: int, ids: pa.Array, toks: pa.ListArray) -> pa.RecordBatch:
    """A row of LOT. Term t is the word ``first[t]``, or with ``second[t]`` the pair; terms are in the order of their words. Rows of one id,
    which are neighbours, are one document."""
    coded = ids.dictionary_encode(null_encoding="encode")
    size = pc.fill_null(pc.list_value_length(toks), 0).to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    flat = toks.flatten().dictionary_encode()
    order = pc.sort_indices(flat.dictionary).to_numpy()
    words, rank = flat.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    word, width = rank[flat.indices.to_numpy()], len(order) + 1
    pair = np.flatnonzero(row[1:] == row[:-1])
    doc = coded.indices.to_numpy().astype(np.int64)[row]
    terms, term = np.unique(np.concatenate([word * width, word[pair] * width + word[pair + 1] + 1]), return_inverse=True)
    entry, tf = np.unique(np.concatenate([doc, doc[pair]]) * max(1, len(terms)) + term, return_counts=True)
    doc, term = np.divmod(entry, max(1, len(terms)))
    cols = (terms // width, terms % width - 1, np.bincount(doc, minlength=len(coded.dictionary)), term, tf)
    return pa.RecordBatch.from_arrays(
        [*(pa.array([n], pa.int64()) for n in (lot, len(ids), len(terms))), _one(coded.dictionary), pa.array([_blob(words)], pa.binary()), *(pa.array([_pack(c)], pa.binary()) for c in cols)],
        ["lot", "docs", "terms", "ids", "words", *_INTS])


def _lots(lot_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lot, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            code = held["id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            ends = np.cumsum(pc.fill_null(pc.list_value_length(held["toks"]), 0).to_numpy())
            cut = 0
            for at in (np.flatnonzero(code[1:] != code[:-1]) + 1).tolist():  # where another document begins
                if ends[at - 1] - (ends[cut - 1] if cut else 0) >= lot_tokens:
                    yield _lot(lot, *(held[c].combine_chunks().slice(cut, at - cut) for c in ("id", "toks")))
                    lot, cut = lot + 1, at
            held = held.slice(cut)
        if held is not None and len(held):
            yield _lot(lot, *(held[c].combine_chunks() for c in ("id", "toks")))
    return run


def _row(batch: pa.RecordBatch, i: int) -> dict:
    """Row i with its integers as numpy, words as Arrow."""
    return {"words": _words(batch["words"][i].as_py()), **{c: _unpack(batch[c][i].as_py()) for c in _INTS if c in batch.schema.names}}


def _ranges(lot: dict, ranges: int) -> np.ndarray:
    """The range of each term, by a hash of its text."""
    word = np.array([zlib.crc32(w.encode()) + 1 for w in lot["words"].to_pylist()] + [0], dtype=np.uint64)  # the last: no second word
    h = word[lot["first"]] * np.uint64(0x9E3779B97F4A7C15) + word[lot["second"]]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return ((h >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32)


def _texts(lot: dict, at: np.ndarray) -> pa.Array:
    """The terms with the given numbers as text."""
    one, two = lot["first"][at], lot["second"][at]
    first, second = lot["words"].take(pa.array(one)), lot["words"].take(pa.array(two, mask=two < 0))
    return pc.coalesce(pc.binary_join_element_wise(first, second, " "), first)


def _blob(words: pa.Array) -> bytes:
    """Sorted words, each by what it does not share with the one before."""
    sink = pa.BufferOutputStream()
    pq.write_table(pa.table({"word": words}), sink, compression="zstd", use_dictionary=False, column_encoding={"word": "DELTA_BYTE_ARRAY"}, write_statistics=False, store_schema=False)
    return sink.getvalue().to_pybytes()


def _words(blob: bytes) -> pa.Array:
    return pq.read_table(pa.BufferReader(blob))["word"].combine_chunks()


def _open(row: dict) -> dict:
    """What a lot sent to a range: its words as Arrow, and first, second and df."""
    return {"words": _words(row["words"]), **{c: _unpack(row[c]) for c in ("first", "second", "df", "cf") if c in row}}


def _ask(ranges: int, counted: bool, times: bool = False):
    """Rows of ASK; not ``counted``: the lots only ask, and their documents do not add to the totals; with ``times`` a further column ``cf``, how often
    the lot has each term."""
    names = [c.split()[0] for c in ASK.split(", ")] + ["cf"] * times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, lot in enumerate(batch["lot"].to_pylist()):
                own = _row(batch, i)
                part = _ranges(own, ranges)
                order = np.argsort(part, kind="stable")
                df = np.bincount(own["term"], minlength=len(part))  # a document has a term once
                cf = np.bincount(own["term"], own["tf"], len(part)) if times else None
                for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    if not len(at):
                        continue
                    first, second = own["first"][at], own["second"][at]
                    used = np.unique(np.concatenate([first, second[second >= 0]]))
                    second = np.where(second < 0, -1, np.searchsorted(used, second))
                    cols = (_blob(own["words"].take(pa.array(used))), _pack(np.searchsorted(used, first)), _pack(second), _pack(df[at] * counted))
                    cols += (_pack(cf[at]),) if times else ()
                    yield pa.RecordBatch.from_arrays([pa.array([part[at[0]]], pa.int32()), pa.array([lot], pa.int64()), *(pa.array([c], pa.binary()) for c in cols)], names)
    return run


def _added(answer):
    """A task that adds up each range, whose rows are neighbours, and gives ``answer`` (range, lots, how many terms each sent, which these are, distinct
    terms, totals, and those of ``cf`` if it was sent)."""
    def close(part: int, rows: list[dict]) -> pa.RecordBatch:
        own = [_open(r) for r in rows]
        coded = pa.concat_arrays([_texts(o, np.arange(len(o["df"]))) for o in own]).dictionary_encode()
        where, totals = coded.indices.to_numpy(), []
        for c in ("df", "cf"):
            if c in own[0]:
                totals.append(np.zeros(len(coded.dictionary), np.int64))
                np.add.at(totals[-1], where, np.concatenate([o[c] for o in own]))
        return answer(part, [r["lot"] for r in rows], [len(o["df"]) for o in own], where, coded.dictionary, *totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["range"] != rows[0]["range"]:
                    yield close(rows[0]["range"], rows)
                    rows = []
                rows.append(row)
        if rows:
            yield close(rows[0]["range"], rows)
    return run


def _totals(part, lots, sent, where, terms, total) -> pa.RecordBatch:
    """Rows of ANSWER."""
    blobs = [_pack(x) for x in np.split(total[where], np.cumsum(sent)[:-1])]
    return pa.RecordBatch.from_arrays([pa.array(lots, pa.int64()), pa.array([part] * len(lots), pa.int32()), pa.array(blobs, pa.binary())], names=["lot", "range", "totals"])


def _vocabulary(part, lots, sent, where, terms, total) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([terms, pa.array(total)], names=["term", "df"])


def _most_frequent(size: int):
    """The ``size`` terms of the range that occur most often, ties by term."""
    def answer(part, lots, sent, where, terms, df, cf) -> pa.RecordBatch:
        least = np.partition(cf, -size)[-size] if len(cf) > size else 0
        ties = np.flatnonzero(cf == least)
        ties = ties[pc.sort_indices(terms.take(pa.array(ties))).to_numpy()]
        more = np.flatnonzero(cf > least)
        own = np.concatenate([more, ties[:size - len(more)]])
        return pa.RecordBatch.from_arrays([terms.take(pa.array(own)), pa.array(df[own]), pa.array(cf[own])], names=["term", "df", "cf"])
    return answer


#: Documents of a block, and what a block is.
BLOCK_DOCS = 64
BLOCK = "ids array<{kind}>, sizes binary, idx binary, weight binary"


def _packed_blocks(held):
    """Rows of BLOCK: the weights of documents over a vocabulary of numbered terms, ``held`` as (terms, idf) by number.

    Documents whose most frequent terms are the same are neighbours: a block then has fewer different terms, and products with it are smaller.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = held.value
        for batch in batches:
            for i in range(batch.num_rows):
                own, ids = _row(batch, i), batch["ids"][i].values
                place = pc.fill_null(pc.index_in(_texts(own, np.arange(len(own["first"]))), value_set=terms), -1).to_numpy()
                idx, doc = place[own["term"]], np.repeat(np.arange(len(ids)), own["sizes"])
                has = idx >= 0
                idx, doc, tf = idx[has], doc[has], own["tf"][has]
                weight = tf * idf[idx]
                weight /= np.sqrt(np.bincount(doc, weight * weight, len(ids)))[doc]
                size = np.bincount(doc, minlength=len(ids))
                ends = np.cumsum(size)
                top = np.append(idx[np.lexsort((tf, doc))], -1)  # of each document by frequency, and what is no term
                first, second = (np.where(size > k, top[np.maximum(ends - 1 - k, -1)], -1) for k in (0, 1))
                docs = np.lexsort((second, first))
                docs = docs[size[docs] > 0]
                take = np.repeat((ends - size)[docs] - np.cumsum(size[docs]) + size[docs], size[docs]) + np.arange(len(idx))
                idx, weight, size, ids = idx[take].astype("<i4"), weight[take], size[docs].astype("<i4"), ids.take(pa.array(docs))
                starts = list(range(0, len(docs), BLOCK_DOCS))
                stops = [*starts[1:], len(docs)]
                cuts = np.concatenate([[0], np.cumsum(size)])
                cols = [pa.ListArray.from_arrays(pa.array([*starts, len(docs)], pa.int32()), ids), pa.array([size[a:b].tobytes() for a, b in zip(starts, stops)], pa.binary()),
                        *(pa.array([c[cuts[a]:cuts[b]].tobytes() for a, b in zip(starts, stops)], pa.binary()) for c in (idx, weight))]
                yield pa.RecordBatch.from_arrays(cols, names=["ids", "sizes", "idx", "weight"])
    return run


def _weigh(ranges: int, n_docs: int, kind: str):
    """(doc_id, term, weight) of each lot, which has its totals with it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, answers = _row(batch, i), {a["range"]: a["totals"] for a in batch["answers"][i].as_py()}
                part = _ranges(own, ranges)
                order, df = np.argsort(part, kind="stable"), np.zeros(len(part), np.int64)
                df[order] = np.concatenate([np.zeros(0, np.int64), *(_unpack(answers[p]) for p in sorted(answers))])
                known = df > 0
                ids, ends = batch["ids"][i].values, np.concatenate([[0], np.cumsum(own["sizes"])])
                idf = np.log((1.0 + n_docs) / (1.0 + df)) + 1.0
                for a, b in zip(range(0, len(ids), 256), range(256, len(ids) + 256, 256)):
                    size = own["sizes"][a:b]
                    lo, hi = ends[a], ends[min(b, len(ids))]
                    if lo == hi:
                        continue
                    term, doc = own["term"][lo:hi], np.repeat(np.arange(len(size)), size)
                    has = known[term]
                    term, doc = term[has], doc[has]
                    w = own["tf"][lo:hi][has] * idf[term]
                    norm = np.sqrt(np.bincount(doc, w * w, len(size)))
                    yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(doc)), _texts(own, term), pa.array(w / norm[doc])], names=["doc_id", "term", "weight"])
    return run


class TermLots:
    """The written lots of documents (doc_id, toks), and what is derived from all of them. Rows of one id count as one document with terms, and each as one of ``n_docs``."""

    def __init__(self, docs: DataFrame, lot_tokens: int = LOT_TOKENS, range_terms: int = RANGE_TERMS):
        self.kind = docs.schema["doc_id"].dataType.simpleString()
        dealt = docs.select(F.col("doc_id").alias("id"), "toks")
        # In buckets of lots: their totals come to them, and no lot is shuffled.
        self.lots = written_in_buckets(dealt.mapInArrow(_lots(lot_tokens), LOT.format(kind=self.kind)), "term-lots", "lot")
        one = self.lots.agg(F.count(F.lit(1)), F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        self.count, self.n_docs, terms = one
        self.ranges = max(1, -(-terms // range_terms))

    def _asked(self, ranges: int, counted: bool = True, times: bool = False) -> DataFrame:
        own = self.lots.select("lot", "words", "first", "second", "term", *(["tf"] if times else []))
        return own.mapInArrow(_ask(ranges, counted, times), ASK + ", cf binary" * times)

    def vocabulary(self) -> DataFrame:
        """(term, df, idf): every term with smooth idf ln((1 + n) / (1 + df)) + 1."""
        found = _dealt(self._asked(self.ranges), self.ranges).mapInArrow(_added(_vocabulary), "term string, df long")
        return found.withColumn("idf", F.log((1.0 + self.n_docs) / (1.0 + F.col("df"))) + 1.0)

    def most_frequent(self, size: int) -> DataFrame:
        """(term, df, cf): the ``size`` terms that occur most often, ties by term; a range gives no more of them."""
        found = _dealt(self._asked(self.ranges, times=True), self.ranges).mapInArrow(_added(_most_frequent(size)), "term string, df long, cf long")
        return found.orderBy(F.col("cf").desc(), F.col("term").asc()).limit(size)

    def blocks(self, vocab: DataFrame) -> DataFrame:
        """The documents' weights in rows of BLOCK, tf * idf, L2-normalised over the terms of ``vocab`` (term, idf, idx), which every task holds; a
        document without any of them is left out. No lot is shuffled."""
        table = vocab.select("term", "idf", "idx").toArrow().sort_by("idx").combine_chunks()
        terms = table["term"].combine_chunks() if table.num_rows else pa.array([], pa.string())
        held = self.lots.sparkSession.sparkContext.broadcast((terms, table["idf"].to_numpy()))
        return self.lots.select("ids", "words", "first", "second", "sizes", "term", "tf").mapInArrow(_packed_blocks(held), BLOCK.format(kind=self.kind))

    def weights(self, of: TermLots | None = None) -> DataFrame:
        """(doc_id, term, weight): tf * idf, L2-normalised per document over the terms of these lots; with ``of``, for the documents of those."""
        of, ranges, asked = of or self, self.ranges, self._asked(self.ranges)
        if of is not self:
            asked = asked.drop("lot").withColumn("lot", F.lit(None).cast("long")).select(*asked.columns).unionByName(of._asked(ranges, False))
        totals = _dealt(asked, ranges).mapInArrow(_added(_totals), ANSWER).where(F.col("lot").isNotNull())
        answers = totals.groupBy("lot").agg(F.collect_list(F.struct("range", "totals")).alias("answers"))
        rows = of.lots.select("lot", "ids", "words", *_INTS).join(answers.hint("shuffle_hash"), "lot").drop("lot")  # the lots pass by, unsorted
        return rows.mapInArrow(_weigh(ranges, self.n_docs, of.kind), f"doc_id {of.kind}, term string, weight double")


def _dealt(asked: DataFrame, ranges: int) -> DataFrame:
    return asked.repartitionById(ranges, asked["range"]).sortWithinPartitions("range", "lot")
