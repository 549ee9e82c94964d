"""Collocations by best-first branch-and-bound growth (operator 13).

Phrases of each language grow from word pairs to three and four words. Documents are kept in lots of bounded size as word numbers; the
totals of all words and pairs come to each lot from key ranges (``grams``), so nothing of the corpus's size is ever broadcast.

A cut of a phrase scores 2000000 a / (l + r); its lowest cut counts, and a is at most the count of any part. So the
counts of a prefix bound every phrase that it can grow into: a phrase that starts with the words x y scores at most the rate of c in
f(x) + c, c being the count of its rarest known pair; the last word bounds it the same way, and each cut between known pairs
bounds it further. Best first: a round expands, in each language that is not settled, the prefixes whose bound reaches a
score, the score of the best ``rank`` pairs at first and lower ones (eight times as many pairs) in later rounds. All phrases of at least that score are then counted
exactly, and so are the longer phrases, of any score, that can absorb one of them. A language is settled once so many of its phrases survive at
or above the score; ties are all among them, as every phrase of the last surviving score is known. Scores and counts
are exact integers; three- and four-word phrases meet as strings, words and pairs as 64-bit hashes with the language in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matforge.llm import grams
from matforge.llm.common import read, written

#: Least count of a phrase, phrases of each language, and the percentage of a phrase's count at which a longer one absorbs it.
LEAST, TOP, ABSORB = 30, 2_000, 80
#: Pairs whose score sets the bound of the first round, in multiples of the phrases wanted, and the growth of that in each later round.
AHEAD, WIDER = 4, 8
#: Bytes of text in a lot, and keys that one range gets, about.
LOT_BYTES = 8 << 20
KEYS_PER_TASK = 2_000_000
SCALE = 2_000_000
#: Ends of pieces (. , ; : ! ? and the line ends), and A-Z in lower case, as one byte table; 255 is in no UTF-8 text.
_TABLE = bytes(255 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b + 32 if 65 <= b <= 90 else b for b in range(256))
BREAK = b"\xff"
BOUNDS, TOTALS, WORDS = 0, 1, 2


class _Numbers(dict):
    """Words by number from 1, in the order met; the end of a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def pieces(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, with a break at each end of a piece and at the end."""
    raw = text.encode("utf-8", "replace").translate(_TABLE) if text else b""
    return [*raw.replace(BREAK, b" \xff ").split(), BREAK]


_LOT = "lot long, parts array<struct<lang:string,size:long,words:long>>, vocabulary binary, stream binary"


def _lots(lot_bytes: int):
    """Rows of _LOT: the word numbers of documents, language by language."""
    part = pa.list_(pa.struct([("lang", pa.string()), ("size", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lot = TaskContext.get().partitionId() << 32
        number, own, size = _Numbers({BREAK: 0}), {}, 0

        def out() -> pa.RecordBatch:
            ids = {lang: np.concatenate(v) for lang, v in sorted(own.items())}
            parts = [{"lang": lang, "size": len(x), "words": int((x > 0).sum())} for lang, x in ids.items()]
            words = zstandard.ZstdCompressor(level=1).compress(b"\n".join(list(number)[1:]))
            return pa.RecordBatch.from_arrays([pa.array([lot], pa.int64()), pa.array([parts], part), pa.array([words], pa.binary()),
                                               pa.array([grams.pack(np.concatenate(list(ids.values())))], pa.binary())], ["lot", "parts", "vocabulary", "stream"])

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                words = pieces(text.as_py())
                own.setdefault(lang, []).append(np.fromiter(map(number.__getitem__, words), dtype="<i4", count=len(words)))
                size += 6 * len(words)
                if size >= lot_bytes:
                    yield out()
                    lot, number, own, size = lot + 1, _Numbers({BREAK: 0}), {}, 0
        if own:
            yield out()
    return run


class Lot:
    """The word numbers of a lot and its distinct words and pairs by language."""

    def __init__(self, parts: list[dict], vocabulary: bytes, stream: bytes):
        raw = zstandard.ZstdDecompressor().decompress(vocabulary)
        self.words = [BREAK, *(raw.split(b"\n") if raw else [])]
        self.langs = [p["lang"] for p in parts]
        self.ids = np.split(grams.unpack(stream, "<i4").astype(np.int64), np.cumsum([p["size"] for p in parts])[:-1])
        h = np.fromiter(map(xxhash.xxh64_intdigest, self.words), dtype=np.uint64, count=len(self.words))
        self.single, self.pair, self.where, keys, counts = [], [], [], [], []
        for lang, ids in zip(self.langs, self.ids):
            seed = np.full(1, xxhash.xxh64_intdigest(lang.encode("utf-8", "replace")), dtype=np.uint64)
            n = np.bincount(ids, minlength=len(self.words))
            n[0] = 0
            single = np.flatnonzero(n)
            at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            pair, where = grams.distinct(ids[at] * len(self.words) + ids[at + 1])
            c = np.bincount(where, minlength=len(pair))
            first = grams.mix(seed, h)
            keys += [first[single], grams.mix(first[pair // len(self.words)], h[pair % len(self.words)])]
            counts += [n[single], c]
            self.single.append(single), self.pair.append(pair), self.where.append((at, where))
        keys, self.counts = np.concatenate(keys), np.concatenate(counts)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def ask(self, lot: int, bits: int) -> pa.RecordBatch:
        return grams.ask(lot, self.keys, self.counts[self.order], bits)

    def totals(self, totals: list[bytes], owner: list[bytes]) -> Iterator[tuple]:
        """(lang, word numbers, totals of words by number, distinct pairs, their totals, owned, places of pairs, their pairs) by language."""
        total, own = np.empty(len(self.keys), np.int64), np.empty(len(self.keys), bool)
        back = [grams.unpack(t, "<i8") for t in totals]
        total[self.order] = np.concatenate(back) if back else []
        own[self.order] = np.concatenate([np.unpackbits(np.frombuffer(o, np.uint8))[:len(t)] for o, t in zip(owner, back)]).astype(bool) if back else []
        at = 0
        for k, lang in enumerate(self.langs):
            f1 = np.zeros(len(self.words), np.int64)
            f1[self.single[k]] = total[at:at + len(self.single[k])]
            at += len(self.single[k])
            end = at + len(self.pair[k])
            yield lang, self.ids[k], f1, self.pair[k], total[at:end], own[at:end], *self.where[k]
            at = end


def _ask(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield Lot(row["parts"], row["vocabulary"], row["stream"]).ask(row["lot"], bits)
    return run


def rate(a: np.ndarray, total: np.ndarray) -> np.ndarray:
    """floor(2000000 a / total), exact: in two steps, so that no product passes 64 bits below counts of 10^15."""
    half = SCALE // 2000
    q, rest = np.divmod(a * half, np.maximum(total, 1))
    return q * 2000 + rest * 2000 // np.maximum(total, 1)


def _rows(lang: str, phrases: list[bytes], words: int, n: np.ndarray, parts: list) -> pa.RecordBatch:
    k = len(phrases)
    cols = [pa.array([lang] * k, pa.string()), pa.array([words] * k, pa.int32()), pa.array([p.decode("utf-8", "replace") for p in phrases], pa.string()), pa.array(n.astype(np.int64))]
    cols += [pa.nulls(k, pa.int64()) if p is None else pa.array(p.astype(np.int64)) for p in parts]
    return pa.RecordBatch.from_arrays(cols, ["lang", "words", "phrase", "n", "l1", "r1", "l2", "r2", "l3", "r3"])


_GROWN = "lang string, words int, phrase string, n long, l1 long, r1 long, l2 long, r2 long, l3 long, r3 long"


def _pairs(lot: Lot, totals: list, least: int) -> Iterator[pa.RecordBatch]:
    """The pairs that a lot owns, with their totals."""
    size = len(lot.words)
    for lang, _, f1, pair, f2, own, _, _ in lot.totals(*totals):
        take = np.flatnonzero(own & (f2 >= least))
        x, y = pair[take] // size, pair[take] % size
        text = [lot.words[a] + b" " + lot.words[b] for a, b in zip(x.tolist(), y.tolist())]
        yield _rows(lang, text, 2, f2[take], [f1[x], f1[y], None, None, None, None])


def _growth(lot: Lot, totals: list, bounds: dict[str, int], least: int, absorb: int) -> Iterator[pa.RecordBatch]:
    """Three- and four-word phrases of a lot that grow from a prefix whose bound reaches the language's score."""
    size = len(lot.words)
    for lang, ids, f1, pair, f2, _, at, where in lot.totals(*totals):
        bound = bounds.get(lang)
        if bound is None or not len(at):
            continue
        n2 = np.zeros(len(ids) + 2, np.int64)
        n2[at] = f2[where]
        index = np.zeros(len(ids) + 2, np.int64)
        index[at] = where
        # Three words x y z at i, all rules by totals alone, so that every lot agrees on a phrase.
        i = np.flatnonzero((n2[:-1] >= least) & (n2[1:] >= least))
        x, y, z, xy, yz = f1[ids[i]], f1[ids[i + 1]], f1[ids[i + 2]], n2[i], n2[i + 1]
        m = np.minimum(xy, yz)
        best = np.minimum(rate(m, x + yz), rate(m, xy + z))
        grows = (rate(m, x + m) >= bound) | (rate(m, m + z) >= bound)
        takes = (100 * m >= absorb * xy) & (rate(xy, x + y) >= bound) | (100 * m >= absorb * yz) & (rate(yz, y + z) >= bound)
        good = np.zeros(len(ids) + 2, bool)
        good[i] = best >= bound
        keep = np.flatnonzero(grows | takes)
        third, first, c = np.unique(index[i[keep]] * size + ids[i[keep] + 2], return_index=True, return_counts=True)
        k = keep[first]
        a = pair[third // size]
        text = [b" ".join((lot.words[p], lot.words[q], lot.words[r])) for p, q, r in zip((a // size).tolist(), (a % size).tolist(), (third % size).tolist())]
        yield _rows(lang, text, 3, c, [x[k], yz[k], xy[k], z[k], None, None])
        # Four words w x y z at i.
        whole = np.zeros(len(ids) + 2, bool)
        whole[i] = True
        i = np.flatnonzero(whole[:-1] & whole[1:])
        w, z, wx, xy, yz = f1[ids[i]], f1[ids[i + 3]], n2[i], n2[i + 1], n2[i + 2]
        m = np.minimum(np.minimum(wx, xy), yz)
        best = np.minimum(np.minimum(rate(m, w + m), rate(m, wx + yz)), rate(m, m + z))
        keep = np.flatnonzero((best >= bound) | good[i] | good[i + 1])
        left, right = index[i[keep]], index[i[keep] + 2]
        fourth, first, c = np.unique(left * len(pair) + right, return_index=True, return_counts=True)
        k = keep[first]
        a, b = pair[fourth // len(pair)], pair[fourth % len(pair)]
        text = [b" ".join((lot.words[p], lot.words[q], lot.words[r], lot.words[s]))
                for p, q, r, s in zip((a // size).tolist(), (a % size).tolist(), (b // size).tolist(), (b % size).tolist())]
        yield _rows(lang, text, 4, c, [w[k], None, wx[k], yz[k], None, z[k]])


def _visit(grow: bool, least: int, absorb: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds: dict[str, int] = {}
        totals: tuple[list, list] = ([], [])
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == BOUNDS:
                    bounds[row["lang"]] = row["bound"]
                elif row["kind"] == TOTALS:
                    totals[0].append(row["a"]), totals[1].append(row["b"])
                else:
                    if bounds or not grow:
                        lot = Lot(row["parts"], row["a"], row["b"])
                        yield from _growth(lot, totals, bounds, least, absorb) if grow else _pairs(lot, totals, least)
                    bounds, totals = {}, ([], [])
    return run


def _visits(lots: DataFrame, totals: DataFrame, bounds: DataFrame | None, count: int) -> DataFrame:
    """Rows that bring each lot its bounds, then its totals in the order of the ranges, then itself."""
    none = lambda kind: F.lit(None).cast(kind)
    parts = dict(lots.dtypes)["parts"]
    rows = totals.select("lot", F.lit(TOTALS).alias("kind"), "range", F.col("totals").alias("a"), F.col("owner").alias("b"),
                         none(parts).alias("parts"), none("string").alias("lang"), none("long").alias("bound"))
    rows = rows.unionByName(lots.select("lot", F.lit(WORDS).alias("kind"), F.lit(0).cast("long").alias("range"), F.col("vocabulary").alias("a"), F.col("stream").alias("b"),
                                        "parts", none("string").alias("lang"), none("long").alias("bound")))
    if bounds is not None:
        held = lots.select("lot", F.explode("parts.lang").alias("lang")).join(bounds.select("lang", "bound"), "lang")
        rows = rows.unionByName(held.select("lot", F.lit(BOUNDS).alias("kind"), F.lit(0).cast("long").alias("range"), none("binary").alias("a"), none("binary").alias("b"),
                                            none(parts).alias("parts"), "lang", "bound"))
    return rows.repartition(max(1, count), "lot").sortWithinPartitions("lot", "kind", "range")


def _rate(a: Column | str, total: Column) -> Column:
    """floor(2000000 a / total) by decimal division."""
    a = F.col(a) if isinstance(a, str) else a
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * a.cast("decimal(20,0)"), total.cast("decimal(20,0)")).cast("long")


def _bounds(steps: DataFrame, rank: int) -> DataFrame:
    """(lang, bound): the score that at least ``rank`` pairs of the language reach, 0 if there are fewer. steps has one row for each
    language and score, at most a million and one of a language."""
    up = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("upto", F.sum("pairs").over(up)).groupBy("lang").agg(
        F.coalesce(F.max(F.when(F.col("upto") >= rank, F.col("score"))), F.lit(0)).alias("bound"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, least: int = LEAST, absorb: int = ABSORB,
                 ahead: int = AHEAD, lot_bytes: int = LOT_BYTES, keys_per_task: int = KEYS_PER_TASK) -> DataFrame:
    """The best phrases of two to four words of each language: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and those at spaces and tabs into words. a is the count of a phrase within pieces, at
    least ``least``; its score floor(2000000 a / (l + r)) that of its lowest cut into two counted parts, ties to the
    shortest first part; n counts the language's words. A phrase inside a longer one of at least ``absorb`` percent of its count is left
    out. The first ``top`` of each language by score, a (both descending) and phrase. A null language is ``und``; null and empty texts have no words;
    ids are not used, so repeated rows count each time; other columns are ignored; an empty input gives no rows.
    """
    if least < 1 or not 0 < absorb <= 100:
        raise ValueError("least must be positive and absorb a percentage")
    own = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    lots = written(own.mapInArrow(_lots(lot_bytes), _LOT), "collocations-lots")
    words = lots.select(F.explode("parts").alias("p")).groupBy("p.lang").agg(F.sum("p.words").alias("n"))
    count, total = lots.select(F.count("*"), F.coalesce(F.sum(F.aggregate("parts.words", F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0))).first()
    bits = grams.range_bits(total, keys_per_task)
    totals = grams.answers(lots.mapInArrow(_ask(bits), grams.ASK), bits, "collocations-totals")
    pairs = _visits(lots, totals, None, count).mapInArrow(_visit(False, least, absorb), _GROWN)
    pairs = written(pairs.select("lang", F.lit(2).alias("words"), "phrase", F.col("n").alias("a"), F.col("l1").alias("l"), F.col("r1").alias("r"),
                                 _rate("n", F.col("l1") + F.col("r1")).alias("score")), "collocations-pairs")
    steps = written(pairs.groupBy("lang", "score").agg(F.count("*").alias("pairs")), "collocations-scores")
    rank, open_, done = ahead * top, None, None
    while True:
        bounds = _bounds(steps, rank)
        bounds = written(bounds if open_ is None else bounds.join(open_, "lang", "left_semi"), "collocations-bounds")
        grown = _visits(lots, totals, bounds, count).mapInArrow(_visit(True, least, absorb), _GROWN)
        grown = grown.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("a"), *(F.max(c).alias(c) for c in ("l1", "r1", "l2", "r2", "l3", "r3"))).where(F.col("a") >= least)
        grown = written(grown, "collocations-grown")
        alive = written(_survivors(pairs, grown, bounds, absorb), "collocations-alive")
        ready = alive.groupBy("lang").agg(F.count("*").alias("k")).join(bounds, "lang", "right").where((F.col("bound") == 0) | (F.coalesce("k", F.lit(0)) >= top)).select("lang")
        ready = written(ready, "collocations-settled")
        part = alive.join(ready, "lang", "left_semi")
        done = part if done is None else done.unionByName(part)
        open_ = written(bounds.join(ready, "lang", "left_anti").select("lang"), "collocations-open")
        if open_.isEmpty():
            break
        rank *= WIDER
    # Only what reaches the last score that is wanted, and of that the best of each share of a language first (many may tie).
    last = _bounds(done.groupBy("lang", "score").agg(F.count("*").alias("pairs")), top)
    done = done.join(last, "lang").where(F.col("score") >= F.col("bound"))
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = Window.partitionBy("lang", "share").orderBy(*by)
    best = done.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _survivors(pairs: DataFrame, grown: DataFrame, bounds: DataFrame, absorb: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases that reach their language's score and that no longer one absorbs."""
    cut = lambda k, l, r: F.struct(_rate("a", F.col(l) + F.col(r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))
    three = grown.where("words = 3").withColumn("cut", F.least(cut(1, "l1", "r1"), cut(2, "l2", "r2")))
    head, tail = F.substring_index("phrase", " ", 3), F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    four = grown.where("words = 4").drop("r1", "l3").withColumn("head", head).withColumn("tail", tail)
    for side, name in (("head", "l3"), ("tail", "r1")):
        four = four.join(grown.where("words = 3").select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    four = four.withColumn("cut", F.least(cut(1, "l1", "r1"), cut(2, "l2", "r2"), cut(3, "l3", "r3")))
    known = pairs.select("lang", "phrase", "a", "l", "r", "score")
    for longer in (three, four):
        known = known.unionByName(longer.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    known = known.join(bounds, "lang").where(F.col("score") >= F.col("bound")).drop("bound")
    inside = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), tail)
    longer = grown.select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return known.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < absorb * F.col("a"), F.lit(True))).drop("longer")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language of all documents."""
    return collocations(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE k > 1 AND a >= 30),
cuts AS (
  SELECT lang, k, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)),
rated AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.j, h.a AS l, t.a AS r, (2000000::HUGEINT * c.a) // (h.a + t.a) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
low AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_parts AS (
  SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS part
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand))),
longer AS (SELECT lang, part, max(a) AS longest FROM inner_parts GROUP BY lang, part),
kept AS (SELECT low.* FROM low LEFT JOIN longer g ON g.lang = low.lang AND g.part = low.phrase WHERE g.longest IS NULL OR 100 * g.longest < 80 * low.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
