"""SimHash groups, repeated strings, packing, scores, search, chats and the pipeline against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from matforge.llm import chat, grams, lm_score, mtree, packing, repeats, runs, simhash
from matforge.llm.common import components, id_remainder, read

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 20_000
EDGE = [(None, "x y"), (None, None), (1, None), (2, ""), (3, " \n\t"), (3, " \n\t"), (4, LONG), (5, LONG), (5, LONG)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string").select(
        "*", *(F.lit(i).alias(c) for i, c in enumerate(("component_id", "fingerprint", "spans", "k", "carried", "length", "lot", "rank", "held_out", "id", "fp"))))


# ---- SimHash

def _fingerprint(text):
    ws = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    parts = [b" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(fps, distance):
    """Smallest id reachable, by all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= distance:
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(fps):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return [low.get(find(i)) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark):
    docs = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    fps = [(d, _fingerprint(t)) for d, t in docs]
    want = sorted((d, f"{f:016x}", c) for (d, f), c in zip(fps, _groups(fps, 2)))
    assert sorted(map(tuple, simhash.op8_simhash_near_dedup(spark, SF).collect())) == want


@pytest.mark.parametrize("distance", [1, 2, 3, 4])
@pytest.mark.parametrize("crowd", [1, 4, 256])
def test_links_have_all_components(spark, distance, crowd):
    rng = random.Random(distance)
    fps = {0}
    while len(fps) < 150:
        x = rng.choice(sorted(fps)) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance, crowd)
    root = {r.node: r.root for r in components(edges, "t").collect()}
    got = Counter(frozenset(i for i, x in enumerate(signed) if root.get(x, x) == r) for r in {root.get(x, x) for x in signed})
    by = {}
    for i, c in enumerate(_groups(list(enumerate(fps)), distance)):
        by.setdefault(c, []).append(i)
    assert got == Counter(frozenset(v) for v in by.values())


def test_components_of_a_long_path(spark):
    n = 300
    got = {r.node: r.root for r in components(spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), "t").collect()}
    assert got == {i: 0 for i in range(n + 1)}
    assert components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b")), "t").count() == 0


def test_simhash_edges(spark, edge):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(edge).collect()), key=str)
    zero = "0" * 16
    assert got.count((3, zero, 1)) == 2 and (None, zero, 1) in got and (2, zero, 1) in got and [g[2] for g in got].count(4) == 3
    assert [g for g in got if g[0] is None and g[1] != zero][0][2] is None
    assert simhash.near_duplicates(edge.limit(0)).count() == 0


# ---- repeated strings

def _kept(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[p:p + length] for p in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                cover[p] += 1
                cover[p + length] -= 1
        gone = np.cumsum(cover)[:len(b)] > 0
        a = np.frombuffer(b, np.uint8)
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(a[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def _repeat_rows(seed):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(30, 120))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [rng.choice([rng.choice(shared), "".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 90))), "ab" * rng.randint(1, 60), rng.choice(shared)[5:]])
                 for _ in range(rng.randint(0, 6))]
        rows.append((i, "".join(parts)))
    return rows + [(None, rows[3][1]), (5, rows[5][1]), (900, None), (901, ""), (None, None)]


@pytest.mark.parametrize("length, gram, crowd, per_task", [(40, 12, 50_000, 20_000), (40, 12, 2, 50), (25, 24, 3, 7)])
def test_repeats_equal_brute_force(spark, length, gram, crowd, per_task):
    rows = _repeat_rows(3)
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length, gram=gram, crowd=crowd, per_task=per_task)
    got = sorted(((r.carried.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=str)
    assert got == _kept(rows, length) and sum(g[2] for g in got) > 1000


def test_key_ranges_of_anchors_are_even(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abcdefghij ", k=6000))) for i in range(60)]
    own = spark.createDataFrame(rows, "doc_id long, text string").select(F.struct("doc_id").alias("carried"), "text")
    lots = own.mapInArrow(repeats._lots(150, 32, 1 << 20), repeats._LOT)
    asked = lots.select("lot", "gram").mapInArrow(repeats._ask_grams(3), grams.ASK).collect()
    keys = Counter()
    for r in asked:
        keys[r["range"]] += len(grams.unpack(r["keys"], "<u8"))
    assert len(keys) == 8 and max(keys.values()) < 0.2 * sum(keys.values()) and sum(keys.values()) > 4000


@pytest.mark.parametrize("query, sql", [(repeats.op5_suffix_array_dedup, repeats.OP5_SQL), (runs.op12_periodic_runs, runs.OP12_SQL)])
def test_queries_equal_their_sql(spark, query, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got, want = query(spark, SMALL).toPandas(), con.execute(sql).df()
    by = lambda d: [tuple(None if x is None or x != x else int(x) if isinstance(x, float) else x for x in r) for r in d.sort_values("doc_id")[got.columns].itertuples(index=False)]
    assert by(got) == by(want)


def test_op5_equals_brute_force(spark):
    docs = [tuple(r) for r in read(spark, SMALL, "documents").select("doc_id", "text").collect()]
    got = sorted(map(tuple, repeats.op5_suffix_array_dedup(spark, SMALL).collect()), key=str)
    assert got == _kept(docs, 400)


def test_column_insertion_equals_sorting():
    rng = np.random.default_rng(1)
    cols = rng.integers(97, 99, (30, 80)).astype(np.uint8)
    cols[:, 40:] = cols[:, :40]
    cols[rng.integers(0, 30, 25), rng.integers(40, 80, 25)] = 120
    start, end = rng.integers(0, 4, 80), 30 - rng.integers(0, 4, 80)
    place = rng.permutation(80)
    got, first = repeats.insert_columns(cols, start, end, 9, place)
    for c in range(22):
        own = [bytes(cols[c:c + 9, i]) if start[i] <= c and c + 9 <= end[i] else None for i in range(80)]
        n = Counter(w for w in own if w)
        assert [bool(w) and n[w] > 1 for w in own] == got[c].tolist()
        least = {w: min(place[i] for i in range(80) if own[i] == w) for w in n}
        assert [bool(w) and n[w] > 1 and least[w] == place[i] for i, w in enumerate(own)] == first[c].tolist()


@pytest.mark.parametrize("length, gram, crowd, per_task, lot", [(40, 12, 5000, 20_000, 4 << 20), (40, 12, 2, 50, 500), (25, 24, 3, 7, 1), (60, 8, 4, 20_000, 2000)])
def test_first_places_stay(spark, length, gram, crowd, per_task, lot):
    """Against windows taken one by one: a byte goes if a string covers it that also starts at an earlier place."""
    docs = spark.createDataFrame(_repeat_rows(4), "doc_id long, text string")
    rows = sorted((r.key, r.doc_id is None, r.doc_id or 0, (r.text or "").encode()) for r in docs.withColumn("key", F.monotonically_increasing_id()).collect())
    seen, want = set(), []
    for _, none, d, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p:p + length] in seen:
                gone[p:p + length] = True
            seen.add(b[p:p + length])
        want.append((None if none else d, int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    out = repeats.remove_repeats(docs, length=length, gram=gram, crowd=crowd, per_task=per_task, keep_first=True, lot_bytes=lot, keys_per_task=500).collect()
    assert sorted(((r.carried.doc_id, r.n_removed, r.kept_sha256) for r in out), key=str) == sorted(want, key=str)
    assert sum(w[1] for w in want) > 500


def test_short_runs_stay_where_words_are_asked_for(spark):
    a, b = " ".join(f"one{i}" for i in range(60)), "x" * 300 + " short"
    docs = spark.createDataFrame([(1, f"{a} {b} end"), (2, f"other {a}"), (3, f"more {b}")], "doc_id long, text string")
    out = {r.carried.doc_id: r.kept_text for r in repeats.remove_repeats(docs, length=100, gram=32, keep_first=True, min_words=50).collect()}
    assert out[3] == f"more {b}" and sorted(len(t) for t in out.values()) != sorted(len(r.text) for r in docs.collect())
    assert sum(a in t for t in out.values()) == 1


def test_a_hot_gram_is_split(spark):
    """One string in all documents, followed by different texts: parts stay small, the result whole."""
    rng = random.Random(9)
    hot = "".join(rng.choice("abcdef ") for _ in range(50))
    rows = [(i, "".join(rng.choice("ghij") for _ in range(rng.randint(0, 30))) + hot + "".join(rng.choice("kl") for _ in range(rng.randint(0, 30)))) for i in range(300)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=52, gram=16, crowd=5)
    assert sorted(((r.carried.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=str) == _kept(rows, 52)


def test_repeats_edges(spark, edge):
    got = sorted(((r.carried.doc_id, r.carried.k, r.n_bytes, r.n_removed, r.kept_text) for r in repeats.remove_repeats(edge, carry=["doc_id", "k"]).collect()), key=str)
    n = len(LONG)
    assert [g for g in got if g[2] == n] == [(4, 3, n, n, ""), (5, 3, n, n, ""), (5, 3, n, n, "")] and len(got) == len(EDGE) and (1, 3, 0, 0, None) in got
    assert repeats.remove_repeats(edge.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(edge, length=10, gram=10)


# ---- packing

def test_encoder_is_the_tokenizer(spark):
    from tokenizers import Tokenizer

    v = packing.public_vocabulary()
    enc, tok = packing.Encoder(**v), Tokenizer.from_file(v["tokenizer"])
    texts = ["a  b", "a   b", " a", "a ", "a \n b", "a\n \nb", "\n \n x", "<|endoftext|> a <|endoftext|>b", "  ", "x  y", "it's  we'll \t \t z", " \n", "a\n ", "é è 日本 語  x", "a\x1c b \x1c", "\x85 a",
             " " * 6000 + "x"] + [r.text for r in read(spark, SF, "documents").select("text").collect()]
    assert all(list(np.frombuffer(enc(t), "<u4")) == tok.encode(t or "", add_special_tokens=False).ids for t in texts)


def test_plan_uses_every_piece_once_and_fills():
    rng = random.Random(4)
    for _ in range(20):
        counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
        got = packing.plan(counts, 64)
        used = Counter()
        for parts, n in got:
            assert sum(parts) <= 64 and n > 0
            for p in parts:
                used[p] += n
        assert used == Counter(counts)
        # Best fit never needs as much as twice the least number.
        assert sum(n for _, n in got) <= 2 * -(-sum(k * v for k, v in counts.items()) // 64)
    assert sum(n for _, n in packing.plan({30: 10, 34: 10, 20: 5, 22: 10, 10: 5}, 64)) == 16


def test_packing_of_all_documents(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.public_vocabulary()["tokenizer"])
    got = packing.op6_best_fit_packing(spark, SF).toPandas()
    for doc, text in [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = got[got.doc_id == doc].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(ids) and (own.length[1:] == 2048).all()
        assert own.start.tolist() == (own.length.cumsum() - own.length).tolist()
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s:s + n].tobytes()) for s, n in zip(own.start, own.length)]
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id").length.cumsum() - g.length == g.offset).all() and g.groupby("sequence_id").length.sum().max() <= 2048
    assert got.sequence_id.nunique() <= 1.02 * -(-got.length.sum() // 2048)


def test_packing_edges(spark, edge):
    got = packing.pack(edge, **packing.public_vocabulary()).toPandas()
    assert (got.groupby(["sequence_id", "offset"]).size() == 1).all() and got[got.doc_id == 5].length.sum() == 2 * got[got.doc_id == 4].length.sum()
    assert got[got.doc_id.isin([1, 2])].length.tolist() == [1, 1]
    assert packing.pack(edge.limit(0), **packing.public_vocabulary()).count() == 0


# ---- language model

@pytest.mark.parametrize("lot_bytes, keys, min_pair", [(16 << 20, 2_000_000, 4), (50_000, 3_000, 1), (200_000, 10_000, 20)])
def test_scores_equal_a_walk_by_hand(spark, lot_bytes, keys, min_pair):
    """One automaton over all training texts, with arcs in a dictionary, walked word by word."""
    docs = [tuple(r) for r in read(spark, SMALL, "documents").select("doc_id", "text").collect()] + [(9001, "one\u00a0two \x1cthree"), (9002, "")]
    cut = lambda t: [w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w] + [None]
    c, b, tri = Counter(), Counter(), Counter()
    for d, t in docs:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            ws = cut(t)
            c.update(ws)
            b.update(zip([None, *ws], ws))
            tri.update(zip([None, *ws], ws, ws[1:]))
    n, v, n1, n2 = sum(c.values()), len(c), sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    off, k, m = n1 / (n1 + 2 * n2), lm_score.CONTEXT_WEIGHT, lm_score.PAIR_WEIGHT
    p1 = lambda w: (c[w] - off) / n if c[w] else off * v / n
    p2 = lambda x, w: (b[x, w] + k * p1(w)) / (c[x] + k)
    assert math.isclose(sum(p1(w) for w in c) + p1("unknown"), 1)
    state = lambda *h: h if len(h) == 1 or b[h] >= min_pair and h[1] is not None else h[1:]
    arcs, fail = {}, {}
    for (x, w), f in b.items():
        arcs[(x,), w] = math.log10(p2(x, w)), state(x, w)
    for (x, y, w), f in tri.items():
        if len(state(x, y)) == 2:
            arcs[(x, y), w] = math.log10((f + m * p2(y, w)) / (b[x, y] + m)), state(y, w)
    got = {r.doc_id: r for r in lm_score.lm_scores(spark.createDataFrame(docs, "doc_id long, text string"), id_remainder(F.col("doc_id"), 5) == 1,
                                                   min_pair=min_pair, lot_bytes=lot_bytes, keys_per_task=keys).collect()}
    fails = 0
    for d, t in docs:
        ws, r = cut(t), got[d]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        at, score = (None,), 0.0
        for w in ws:
            while at and (at, w) not in arcs:
                score += math.log10(m / (b[at] + m) if len(at) == 2 else k / (c[at[0]] + k))
                at, fails = at[1:], fails + 1
            weight, at = arcs[at, w] if at else (math.log10(p1(w)), (w,))
            score += weight
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, zlib.crc32(str(d).encode()) % 5 == 1)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9)
    assert fails > 100


def test_every_state_of_the_automaton_sums_to_one():
    """Over all words and the unknown one, which has number 4 and no count."""
    words, pairs = np.array([3, 5, 4, 2, 0]), {(0, 1): 2, (0, 2): 1, (1, 2): 3, (1, 3): 1, (1, 1): 1, (2, 1): 2, (2, 3): 1, (2, 0): 1, (3, 0): 2}
    triples = {(0, 1, 2): 1, (0, 1, 1): 1, (1, 2, 1): 1, (1, 2, 3): 1, (1, 2, 0): 1, (2, 1, 2): 1, (2, 1, 3): 1}
    every = {(a, b): pairs.get((a, b), 0) for a in range(5) for b in range(5)}
    code = np.array(sorted(a * 5 + b for a, b in every))
    auto = lm_score.Automaton.build(words, code, np.array([every[c // 5, c % 5] for c in code]), np.array(sorted((a * 5 + b) * 5 + w for a, b, w in triples)),
                                    np.array([triples[k] for k in sorted(triples, key=lambda x: (x[0] * 5 + x[1]) * 5 + x[2])]), (14, 4, 0, 1), 7.0, 3.0, 2)
    strings = sorted((a * 5 + b) * 5 + w for a, b, w in triples)
    for state in (0, 1, 2, 3, 4, 6 + 1, 6 + 7, 6 + 11):
        last = (state - 6) % 5 if state > 5 else state - 1  # the last word of the context
        pair = np.array([last * 5 + w if state else -1 for w in range(5)])
        triple = np.array([strings.index((state - 6) * 5 + w) if state > 5 and (state - 6) * 5 + w in strings else -1 for w in range(5)])
        weight, _ = auto.step(np.full(5, state), np.arange(5), pair, triple)
        assert math.isclose((10 ** weight).sum(), 1, rel_tol=1e-9), state


def test_held_out_texts_score_better_than_by_single_words(spark):
    got = lm_score.op7_lm_scoring(spark, SF).where("held_out").toPandas()
    assert len(got) > 150 and got.score.sum() > 0.8 * got.base_score.sum() and (got.score > got.base_score).mean() > 0.9


def test_score_edges(spark, edge):
    got = lm_score.lm_scores(edge, F.lit(False)).toPandas()
    assert len(got) == len(EDGE) and (got.n_tokens[got.n_tokens < 1000] <= 3).all() and np.isfinite(got.score).all()
    none = lm_score.lm_scores(edge, F.lit(True)).toPandas()
    assert (none.train_tokens == 0).all() and (none.score == 0).all() and (none.base_score == 0).all()
    assert lm_score.lm_scores(edge.limit(0), F.lit(None).cast("boolean")).count() == 0


# ---- top-k search

def test_search_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(db.execute(mtree.OP9_SQL).fetchall())
    emb = read(spark, SF, "embeddings")
    for more in ({}, {"cell": 60, "leaf": 8, "fan": 3, "block": 4, "seeds": 5}):
        assert sorted(map(tuple, mtree.top_k(emb, F.col("vec_id") % 50 == 0, **more).collect())) == want


def test_search_edges(spark):
    rows = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.1, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0]), (None, [9.0, 9.0]),
            (9, [-1.0, 0.001]), (1, [0.5, 0.5])] + [(100 + i, [0.25, 0.25]) for i in range(400)]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("score", F.lit(1))
    got = sorted(map(tuple, mtree.top_k(vecs, F.col("vec_id").isin(0, 3, 9), leaf=16, cell=100).collect()))
    assert got[:5] == [(0, 1, 1, 32768), (0, 2, 1, 32768), (0, 3, 2, 32768), (0, 4, 8, 32768), (0, 5, 100, 16384)]
    assert [g[2] for g in got[5:]] == [7, 100, 101, 102, 103] and len(got) == 10
    assert mtree.top_k(vecs.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("size", [2.0 ** 17, 2.0 ** 20, 5452595.0])
def test_search_keeps_large_vectors_exactly(spark, size):
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-99, 99) + (size if i % 3 == 0 else 0)) * rng.choice((1, 1, -1)) for _ in range(4)]) for i in range(200)]
    want = []
    for q, x in rows:
        if q % 10 == 0:
            scores = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(x, y)), i) for i, y in rows if i != q)
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:5], 1)]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, mtree.top_k(vecs, F.col("vec_id") % 10 == 0, leaf=16, cell=70).collect())) == sorted(want)


# ---- chats

def test_chats_equal_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert sorted(map(tuple, chat.op10_chat_format(spark, SF).collect())) == sorted(db.execute(chat.OP10_SQL).fetchall())


def test_snapshots_collapse(spark):
    logs = {1: ["a"], 2: ["a", "b"], 3: ["a", "b", "c"], 4: ["a", "x"], 5: ["a", "x"], 6: ["b"], 7: [""], 8: [None], None: ["a", "b", "c", "d"]}
    rows = [(c, t, "User " if t % 2 else None, x, "z") for c, ts in logs.items() for t, x in enumerate(ts)] * 2
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")
    got = {r.conv_id: r.rendered for r in chat.format_chats(frame).collect()}
    assert set(got) == {None, 4, 6, 7, 8} and got[4] == "<|unknown|>\na<|end|>\n<|user|>\nx<|end|>\n" and got[7] == got[8]
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_long_chat_is_split_and_whole(spark):
    rows = [(1, i, "user", str(i)) for i in range(1000)] + [(2, i, "user", str(i)) for i in range(700)] + [(3, None, "user", "0"), (3, None, None, None)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), span=64).collect()
    one = sorted((r.part, r.rendered) for r in got if r.conv_id == 1)
    assert [p for p, _ in one] == list(range(16)) and "".join(t for _, t in one) == "".join(f"<|user|>\n{i}<|end|>\n" for i in range(1000))
    assert {r.conv_id for r in got} == {1, 3} and all(r.n_parts == 16 for r in got if r.conv_id == 1)
    plan = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_turns_without_or_with_restarting_numbers_are_split(spark):
    """One conversation of null turns, and one whose numbers start anew: positions follow the order, over ranges of bounded size."""
    rows = [(None, None, "user", f"{i:05d}") for i in range(3000)] + [(7, i % 3, "user", f"{i:05d}") for i in range(2000)] + [(8, 1, "user", "x" * 200_000), (8, 2, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    hashed = chat.prefix_hashes(frame).collect()
    of = lambda c: [(r.pos, r.text) for r in sorted(hashed, key=lambda r: r.pos) if r.conv_id == c]
    assert of(None) == [(i + 1, f"{i:05d}") for i in range(3000)]
    assert [t for _, t in of(7)] == [f"{i:05d}" for m in range(3) for i in range(2000) if i % 3 == m]
    assert [t for _, t in of(8)] == ["x" * 200_000, None]


# ---- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from matforge.llm import decontaminate, toxicity

    docs = read(spark, SF, "documents").where("doc_id < 400")
    extra = spark.createDataFrame([(None, None), (9001, ""), (9002, "plain words here"), (9002, "plain words here")], "doc_id long, text string")
    docs = docs.withColumn("score", F.lit("x")).withColumn("item_id", F.lit(1)).unionByName(extra, allowMissingColumns=True)
    n = {}
    for name, stage in P.STAGES[:-1]:
        before = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        n[name] = docs.count()
        if name != "suffix_array_dedup":
            assert after <= before
    assert [r.doc_id for r in docs.where("text = 'plain words here'").collect()] == [9002]
    assert docs.where("text IS NULL OR text = ''").count() == 1
    # What is left is clean by each stage's own measure.
    assert decontaminate.contaminated(docs, read(spark, SF, "benchmark")).count() == 0
    insult = "idiot|moron|stupid|scum|loser|clown|trash|pathetic|worthless|disgusting"
    assert docs.where(F.size(F.split("text", insult)) > 3).count() == 0
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert n["toxicity"] < 404 and n["simhash_near_dedup"] < n["toxicity"]


def test_pipeline_cuts_repeated_passages(spark):
    """Every stretch of 51 words that stands in several places stands in one afterwards; other documents are untouched."""
    import corpus_pipeline as P

    def places(rows):
        seen = Counter()
        for r in rows:
            at = [m.span() for m in re.finditer(r"\S+", r.text or "")]
            seen.update(r.text[at[i][0]:at[i + 50][1]] for i in range(len(at) - 50))
        return seen

    docs = P.drop_near_copies(spark, read(spark, SF, "documents"), SF).cache()
    before, rows = places(docs.collect()), {r.doc_id: r.text for r in docs.collect()}
    out = P.cut_repeats(spark, docs, SF).collect()
    often = {p for p, n in before.items() if n > 1 and len(p.encode()) >= P.REPEAT_BYTES}
    after = places(out)
    assert len(often) > 100 and max(after[p] for p in often) == 1
    changed = [r.doc_id for r in out if r.text != rows[r.doc_id]]
    assert 0 < len(changed) < len(rows) / 4
    assert len(out) >= len(rows) - 5


def test_pipeline_keeps_unrelated_texts_without_or_with_one_id(spark):
    import corpus_pipeline as P

    rows = [(None, "the harbour lies still under a pale morning sky"), (None, "seven engineers measured pressure in every pipe of the plant"),
            (7, "bread is baked twice a week in the old village oven"), (7, "quarterly figures rose because exports to the north grew"),
            (8, "bread is baked twice a week in the old village oven"), (None, "the harbour lies still under a pale morning sky")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in P.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted(rows[:4], key=str)


def test_pipeline_run_and_empty(spark):
    import corpus_pipeline as P

    got = P.run(spark, SMALL)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 100
    none = read(spark, SMALL, "documents").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, none, SMALL)
        assert out.count() == 0
        none = out if out.columns == none.columns else none
