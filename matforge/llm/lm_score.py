"""Language-model scores by a weighted backoff automaton of smoothed word n-grams (operator 7).

States are the root, one for each word and one for each pair of words that training has seen ``min_pair`` times or
more: the contexts of no, one and two words. An arc of a state reads a word that training has seen after the context, and leads to the
state of the longest context that the text then ends in; what the context has not seen takes the failure arc, to the state of the
context without its first word. Weights are log10 probabilities, c being training counts and p1 the word frequencies by absolute discounting, with
one unknown word that gets the discounted mass:

    p2(w | v) = (c(v w) + K p1(w)) / (c(v) + K)            failure arc of v:    K / (c(v) + K)
    p3(w | u v) = (c(u v w) + L p2(w | v)) / (c(u v) + L)  failure arc of u v:  L / (c(u v) + L)

so every state's probabilities sum to one. A text is read once from left to right from the state of the closing token: its state is
carried on, failure arcs are followed until an arc reads the word, and the weights add up.

The model is as large as the corpus, so no task holds it. Documents are kept in lots of bounded size; a lot asks for the training
totals of its distinct words and pairs by key range (``grams``), then for those of the three-word strings whose first pair is a state, and
builds the part of the automaton that its texts can visit. Words and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matforge.llm import grams
from matforge.llm.common import id_remainder, read, written

#: K and L: a context seen so often trusts its own counts and the shorter context equally.
CONTEXT_WEIGHT, PAIR_WEIGHT = 400.0, 20.0
#: Training occurrences from which a pair of words is a state.
MIN_PAIR = 4
#: Bytes of text in a lot, and keys that one range gets, about.
LOT_BYTES = 6 << 20
KEYS_PER_TASK = 2_000_000
#: Words of a text that are read in a row.
STRETCH = 256
END = b""


class _Numbers(dict):
    """Words by number, in the order met; the closing token is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_LOT = "lot long, docs binary, sizes binary, vocabulary binary, stream binary"


def _lots(lot_bytes: int):
    """Rows of _LOT: documents (doc_id, held_out) as one block, their token counts, the distinct words and the token numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lot, size = TaskContext.get().partitionId() << 32, 0
        number, held, ids = _Numbers({END: 0}), [], []

        def out() -> pa.RecordBatch:
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, held[0].schema) as w:
                for b in held:
                    w.write_batch(b)
            zip_ = zstandard.ZstdCompressor(level=1).compress
            cols = [zip_(sink.getvalue()), grams.pack(np.array([len(x) for x in ids], "<i4")), zip_(b"\n".join(list(number)[1:])), grams.pack(np.concatenate(ids))]
            return pa.RecordBatch.from_arrays([pa.array([lot], pa.int64()), *(pa.array([c], pa.binary()) for c in cols)], ["lot", "docs", "sizes", "vocabulary", "stream"])

        for batch in batches:
            keys, at = batch.select(["doc_id", "held_out"]), 0
            for i, text in enumerate(batch["text"]):
                text = text.as_py()
                words = text.encode("utf-8", "replace").lower().split() if text else []
                words.append(END)
                ids.append(np.fromiter(map(number.__getitem__, words), dtype="<i4", count=len(words)))
                size += 6 * len(words)
                if size >= lot_bytes:
                    held.append(keys.slice(at, i + 1 - at))
                    yield out()
                    lot, size, at = lot + 1, 0, i + 1
                    number, held, ids = _Numbers({END: 0}), [], []
            if at < len(batch):
                held.append(keys.slice(at))
        if held:
            yield out()
    return run


class Lot:
    """Tokens of a lot and its distinct words, pairs and three-word strings."""

    def __init__(self, row: dict):
        unzip = zstandard.ZstdDecompressor().decompress
        self.docs = pa.ipc.open_stream(unzip(row["docs"])).read_all()
        self.sizes = grams.unpack(row["sizes"], "<i4").astype(np.int64)
        raw = unzip(row["vocabulary"])
        words = [END, *(raw.split(b"\n") if raw else [])]
        self.v = len(words)
        self.ids = grams.unpack(row["stream"], "<i4").astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        train = np.repeat(~np.array(self.docs["held_out"], dtype=bool), self.sizes)
        self.hash = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=self.v)
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[self.start] = 0
        self.pairs, self.pair = grams.distinct(before * self.v + self.ids)
        key = lambda a, b: grams.mix(grams.mix(np.full(1, 2, np.uint64), self.hash[a]), self.hash[b])
        self.pair_keys = key(self.pairs // self.v, self.pairs % self.v)
        self.train = train
        # A word's key has the top bit 0, a pair's 1, so that a range holds one kind and its statistics are those of words.
        low = np.uint64((1 << 63) - 1)
        keys = np.concatenate([grams.mix(np.full(1, 1, np.uint64), self.hash) & low, self.pair_keys | ~low])
        counts = np.concatenate([np.bincount(self.ids, weights=train, minlength=self.v), np.bincount(self.pair, weights=train, minlength=len(self.pairs))])
        self.order = np.argsort(keys)
        self.keys, self.counts = keys[self.order], counts.astype(np.int64)[self.order]

    def totals(self, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Training totals of the words and of the pairs."""
        out = np.empty(len(self.keys), np.int64)
        out[self.order] = np.concatenate([grams.unpack(t, "<i8") for t in packed])
        return out[:self.v], out[self.v:]

    def triples(self, pair_totals: np.ndarray, min_pair: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct three-word strings whose first pair is a state, as pair * words + word, sorted; the number of each token's
        string among them, -1 where it has none; their keys and training counts."""
        last = np.ones(len(self.ids), dtype=bool)
        last[self.start] = False
        last = np.flatnonzero(last)
        last = last[pair_totals[self.pair[last - 1]] >= min_pair]
        code, where = grams.distinct(self.pair[last - 1] * self.v + self.ids[last])
        number = np.full(len(self.ids), -1, np.int64)
        number[last] = where
        counts = np.bincount(where, weights=self.train[last], minlength=len(code)).astype(np.int64)
        return code, number, grams.mix(self.pair_keys[code // self.v], self.hash[code % self.v]), counts


@dataclass
class Automaton:
    """States 0 (root), 1 + word, 1 + words + pair. The root has an arc for every word; the arcs of a word's state are the pairs that begin with it,
    those of a pair's state the three-word strings that do, by their numbers; an arc that training has not seen has weight NaN and is none."""

    words: int
    root: np.ndarray
    pair_weight: np.ndarray
    pair_target: np.ndarray
    triple_weight: np.ndarray
    triple_target: np.ndarray
    fail_weight: np.ndarray
    fail_state: np.ndarray

    @classmethod
    def build(cls, words: np.ndarray, pairs: np.ndarray, pair_totals: np.ndarray, triples: np.ndarray, triple_totals: np.ndarray,
              stats: tuple, context_weight: float, pair_weight: float, min_pair: int) -> Automaton:
        """words, pairs and triples: totals of each word number, of each pair first * words + last (sorted), and of each
        string pair number * words + word (sorted)."""
        n, v, n1, n2 = stats
        size = len(words)
        off = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 + 2 * n2 else 0.5
        p1 = np.where(words > 0, (words - off) / max(n, 1), off * v / n if n else 1.0)
        first, last = pairs // size, pairs % size
        p2 = (pair_totals + context_weight * p1[last]) / (words[first] + context_weight)
        # A pair that ends a text is no context.
        state = np.where((pair_totals >= min_pair) & (last > 0), 1 + size + np.arange(len(pairs)), 1 + last)
        pair, word = triples // size, triples % size
        tail = np.searchsorted(pairs, last[pair] * size + word)  # the pair of the last two words
        p3 = (triple_totals + pair_weight * p2[tail]) / (pair_totals[pair] + pair_weight)
        fail = np.concatenate([[1.0], context_weight / (words + context_weight), pair_weight / (pair_totals + pair_weight)])
        arc = lambda total, p: np.where(total > 0, np.log10(p), np.nan)
        return cls(size, np.log10(p1), arc(pair_totals, p2), state, arc(triple_totals, p3), state[tail], np.log10(fail),
                   np.concatenate([[0], np.zeros(size, np.int64), 1 + last]))

    def step(self, state: np.ndarray, word: np.ndarray, pair: np.ndarray, triple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, next state) of reading one word in each state; pair and triple are the numbers of the strings that the word ends, -1 for none."""
        state, out = state.copy(), np.empty(len(state), np.int64)
        weight = np.zeros(len(state))
        # States of pairs: an arc, or the failure arc to the state of the last word.
        live = np.flatnonzero(state > self.words)
        arc = np.full(len(live), np.nan)
        known = triple[live] >= 0
        arc[known] = self.triple_weight[triple[live[known]]]
        hit = arc == arc
        got, down = live[hit], live[~hit]
        weight[got], out[got] = arc[hit], self.triple_target[triple[got]]
        weight[down] += self.fail_weight[state[down]]
        state[down] = self.fail_state[state[down]]
        state[got] = -1  # these have read
        # States of words: an arc, or the failure arc to the root.
        live = np.flatnonzero(state > 0)
        arc = np.full(len(live), np.nan)
        known = pair[live] >= 0
        arc[known] = self.pair_weight[pair[live[known]]]
        hit = arc == arc
        got, down = live[hit], live[~hit]
        weight[got] += arc[hit]
        out[got] = self.pair_target[pair[got]]
        weight[down] += self.fail_weight[state[down]]
        state[down], state[got] = 0, -1
        top = np.flatnonzero(state == 0)
        weight[top] += self.root[word[top]]
        out[top] = 1 + word[top]
        return weight, out

    def walk(self, ids: np.ndarray, pair: np.ndarray, triple: np.ndarray, start: np.ndarray, sizes: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
        """Log10 probability of every text (pair, triple: the numbers of the strings that each token ends).

        Texts are read from left to right, one word of each at a time. A long one is read in stretches side by side: a stretch begins in the
        state that the words before it lead to, which their last pair tells.
        """
        count = -(-sizes // stretch)
        text = np.repeat(np.arange(len(sizes)), count)
        part = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        begin, length = start[text] + part * stretch, np.minimum(stretch, sizes[text] - part * stretch)
        state = np.where(part > 0, self.pair_target[pair[np.maximum(begin - 1, 0)]], 1)  # 1: the closing token's
        by = np.argsort(-length, kind="stable")
        begin, state, score = begin[by], state[by], np.zeros(len(by))
        live = np.searchsorted(-length[by], -np.arange(1, int(length.max(initial=0)) + 1), side="right")
        for t, k in enumerate(live.tolist()):
            at = begin[:k] + t
            weight, state[:k] = self.step(state[:k], ids[at], pair[at], triple[at])
            score[:k] += weight
        return np.bincount(text[by], weights=score, minlength=len(sizes))


def _ask(bits: int):
    """Rows of grams.ASK: words and pairs of each lot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lot = Lot(row)
                yield grams.ask(row["lot"], lot.keys, lot.counts, bits)
    return run


PAIRS, TRIPLES, SELF = 0, 1, 2


def _lots_with_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict[int, list[bytes]]]]:
    held: dict[int, list[bytes]] = {PAIRS: [], TRIPLES: []}
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == SELF:
                yield row, held
                held = {PAIRS: [], TRIPLES: []}
            else:
                held[row["kind"]].append(row["totals"])


def _ask_triples(bits: int, min_pair: int):
    """Rows of grams.ASK: three-word strings of each lot whose first pair is a state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, held in _lots_with_totals(batches):
            lot = Lot(row)
            _, _, keys, counts = lot.triples(lot.totals(held[PAIRS])[1], min_pair)
            if len(keys):
                order = np.argsort(keys)
                yield grams.ask(row["lot"], keys[order], counts[order], bits)
    return run


def _scores(stats: tuple, context_weight: float, pair_weight: float, min_pair: int):
    n, v, _, _ = stats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, held in _lots_with_totals(batches):
            lot = Lot(row)
            words, pairs = lot.totals(held[PAIRS])
            code, triple, keys, _ = lot.triples(pairs, min_pair)
            total = np.empty(len(code), np.int64)
            total[np.argsort(keys)] = np.concatenate([np.zeros(0, np.int64), *(grams.unpack(t, "<i8") for t in held[TRIPLES])])
            auto = Automaton.build(words, lot.pairs, pairs, code, total, stats, context_weight, pair_weight, min_pair)
            seen = words[lot.ids]
            base = np.add.reduceat(np.log10((seen + 0.5) / (n + 0.5 * (v + 1))), lot.start)
            known = np.add.reduceat((seen > 0).astype(np.int64), lot.start)
            cols = [lot.docs["doc_id"].combine_chunks(), lot.docs["held_out"].combine_chunks(), pa.array(lot.sizes), pa.array(known),
                    pa.array(np.full(len(known), n, np.int64)), pa.array(base), pa.array(auto.walk(lot.ids, lot.pair, triple, lot.start, lot.sizes))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def lm_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", context_weight: float = CONTEXT_WEIGHT,
              pair_weight: float = PAIR_WEIGHT, min_pair: int = MIN_PAIR, lot_bytes: int = LOT_BYTES, keys_per_task: int = KEYS_PER_TASK) -> DataFrame:
    """Log10 probability of every text under the backoff automaton learned from the rows that are not ``held_out``.

    held_out: a boolean column. Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input
    row. Null and empty texts are one closing token; without training rows every word has probability one. Ids may be null or
    repeat; other columns are ignored; an empty input gives no rows. Only six sums reach the driver. A task holds about 200 bytes for each
    word of a lot, or of the longest document.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = dict(own.dtypes)["doc_id"]
    lots = written(own.mapInArrow(_lots(lot_bytes), _LOT), "lm-lots")
    count = lots.count()
    bits = 1 + grams.range_bits(count * lot_bytes // 8, keys_per_task)
    pairs = grams.answers(lots.mapInArrow(_ask(bits), grams.ASK), bits, "lm-pairs", stats=True)
    sums = pairs.where(f"lot IS NULL AND range < {1 << (bits - 1)}").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "n1", "n2"))).first()
    cols = lots.columns[1:]

    def visits(*totals: DataFrame) -> DataFrame:
        """The totals of each lot in the order of the ranges, and then the lot."""
        none = lambda c: F.lit(None).cast("binary").alias(c)
        rows = lots.select("lot", F.lit(SELF).alias("kind"), F.lit(0).cast("long").alias("range"), none("totals"), *cols)
        for k, t in enumerate(totals):
            rows = rows.unionByName(t.where("lot IS NOT NULL").select("lot", F.lit(k).alias("kind"), "range", "totals", *map(none, cols)))
        return rows.repartition(max(1, count), "lot").sortWithinPartitions("lot", "kind", "range")

    triples = grams.answers(visits(pairs).mapInArrow(_ask_triples(bits, min_pair), grams.ASK), bits, "lm-triples")
    return visits(pairs, triples).mapInArrow(_scores(tuple(sums), context_weight, pair_weight, min_pair),
                                             f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the fold of remainder 1 is held out."""
    return lm_scores(read(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 5) == 1)
