"""Secret scans, periodic runs and collocations against brute force, and their edge cases."""

import hashlib
import random
import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from matforge.llm import collocations as C
from matforge.llm import runs as R
from matforge.llm import secrets as S
from matforge.llm.common import read

SF = "/root/testdata/sf0.01"
EDGE = [(None, "x y", None), (1, None, "en"), (2, "", "en"), (3, " \n\t", "de"), (3, " \n\t", "de"), (4, "word " * 30_000, "en")]


@pytest.fixture(scope="module")
def edge(spark):
    """Null ids, texts and languages, empty, repeated and very long texts, and columns named like those the operators add."""
    return spark.createDataFrame(EDGE, "doc_id long, text string, lang string").select(
        "*", *(F.lit(i).alias(c) for i, c in enumerate(("score", "carried", "findings", "spans", "best", "runs", "rank", "phrase", "id", "a", "n"))))


# ---- secrets

def base_by_hand(text):
    """The base patterns without regular expressions: leftmost matches, then the length test."""
    word = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    names = ("password", "passwd", "secret", "token", "apikey", "api_key")
    low = "".join(c.lower() if c.isascii() else c for c in text)
    out, i = [], 0
    while i < len(text):
        j = next((i + len(n) for n in names if low.startswith(n, i)), None)
        end = None
        if j is not None:
            at = j + (text[j:j + 1] in ('"', "'") and text[j:j + 1] != "")
            while text[at:at + 1] == " ":
                at += 1
            if text[at:at + 1] in (":", "="):
                at += 1
                while text[at:at + 1] == " ":
                    at += 1
                at += text[at:at + 1] in ('"', "'") and text[at:at + 1] != ""
                end = at
                while end < len(text) and text[end] in word:
                    end += 1
                if end - at >= 8:
                    out.append((i, 0, end))
                end = end if end > at else None
        i = end or i + 1
    for kind, chars, head, least in ((1, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), "AKIA", 16), (2, set("0123456789abcdef"), "", 32)):
        i = 0
        while i < len(text):
            end = i + len(head)
            while text.startswith(head, i) and end < len(text) and text[end] in chars:
                end += 1
            if end > i + len(head):
                if end - i >= least:
                    out.append((i, kind, end))
                i = end
            else:
                i += 1
    return sorted(out)


def test_base_findings_equal_a_scan_by_hand(spark):
    rng = random.Random(5)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "ToKeN", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIAABCDEFGHIJKL", "ABCD1234",
            "0123456789abcdef", "deadbeef" * 4, "xyz", "é", "ſecret", "toKen", "\n", "12345678", "short", "+/_.=-"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    texts += [r.text for r in read(spark, SF, "documents").select("text").collect()]
    for t in texts:
        got = sorted((f.start, S.KINDS.index(f.kind), f.end) for f in S.base_findings(t))
        assert got == base_by_hand(t), t


@pytest.mark.parametrize("text, want", [
    ('k = "Zx81!kq9$$pLm2"\nclient_secret = k', ["Zx81!kq9$$pLm2"]),  # constant
    ('const dbPassword: string = base;\nbase = "qq!!ww@@99"', ["qq!!ww@@99"]),  # constant further down, typed name
    ('a = "x9!kq#Lz0"\nb = a\nc = b\nauth_token = c', ["x9!kq#Lz0"]),  # several steps
    ('a="Abc!"\nb="123#$%z9"\napi_key = a + b', ["Abc!", "123#$%z9"]),  # sum
    ("token: ${TOK}\nTOK=ab#cd9x!z0", ["ab#cd9x!z0"]),  # reference
    ("<password>Zq!8s%kk2</password>", ["Zq!8s%kk2"]),
    ("postgres://bob:hu!nter22@db/x", ["hu!nter22"]),
    ("cfg[\"secret\"] = 'x!9#kdLq02'", ["x!9#kdLq02"]),
    ('put("password", "p@ss!w0rd99")', ["p@ss!w0rd99"]),
    ('#define API_SECRET "k!k2j3h4g5"', ["k!k2j3h4g5"]),
    ('{"dbPass": "q!w@e#r$t%", "user": "bob!jones#1"}', ["q!w@e#r$t%"]),
    ("a = b\nb = a\npassword = a", []),  # leads back to itself
    ('password_hint = "x!9#kdLq02"', []), ('password = "changeme!!"', []), ('secret = getenv("x!9#kdLq02")', []),
    ("The key: something here is nice", []), ("colour = \"x!9#kdLq02\"", []), ("don't say pass, isn't it: so", []),
])
def test_literals_of_sensitive_targets(text, want):
    assert [text[f.start:f.end] for f in S.findings(text) if f.kind == "literal"] == want


def test_base_findings_stay_and_hold_literals():
    t = 'password = "hunter2hunter2"; token = "abcdefgh!ijkl#99"'
    assert [(f.kind, t[f.start:f.end]) for f in S.findings(t)] == [
        ("assign", 'password = "hunter2hunter2'), ("assign", 'token = "abcdefgh'), ("literal", "abcdefgh!ijkl#99")]


@pytest.mark.parametrize("unit", ["9", "a", '"', "\\\"'", "password", "a=b ", "a = a + b\n", "password=", "<a>", 'x = "', "a:", "password ", 'a = "b" + \\\n', "password = password\n"])
def test_long_texts_take_linear_time(unit):
    text = unit * (200_000 // len(unit))
    start = time.perf_counter()
    S.findings(text)
    S.findings("password" + unit + " " * 200_000)
    assert time.perf_counter() - start < 5


def test_secret_query_digests(spark):
    rows = {r.doc_id: r for r in S.op11_secret_scan(spark, SF).collect()}
    docs = {r.doc_id: r.text for r in read(spark, SF, "documents").collect()}
    assert rows.keys() == docs.keys() and sum(r.n_hex for r in rows.values()) > 0
    for k, r in rows.items():
        base = base_by_hand(docs[k])
        text = ",".join(f"{S.KINDS[kind]}:{a}:{b}" for a, kind, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == i for x in base) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_secret_edges(spark, edge):
    out = S.scan(edge, carry=["doc_id", "findings", "carried"])
    assert out.count() == len(EDGE) and out.where(F.size("findings") > 0).count() == 0
    assert S.scan(edge.limit(0)).count() == 0
    assert S.findings(None) == S.findings("") == []


# ---- periodic runs

def runs_by_hand(w, least, periods):
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q), q)
            i = max(i, j) + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least, periods", [(6, 4), (2, 2), (9, 3)])
def test_runs_equal_brute_force(least, periods):
    rng = random.Random(7)
    for _ in range(400):
        texts = [[bytes([97 + rng.randrange(rng.choice([1, 2, 2, 3]))]) for _ in range(rng.randrange(0, 40))] for _ in range(rng.randrange(1, 4))]
        for w, own in zip(texts, R.batch_runs(texts, least, periods)):
            assert [tuple(r) for r in own.tolist()] == runs_by_hand(w, least, periods), w


def test_run_query_equals_brute_force(spark):
    rows = {r.doc_id: r for r in R.op12_periodic_runs(spark, SF).collect()}
    planted = 0
    for d in read(spark, SF, "documents").collect():
        w = d.text.encode().split()
        h = zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        elif len(w) > 1500:
            continue  # too slow by hand; planted ones are all compared
        found, r = runs_by_hand(w, 6, 4), rows[d.doc_id]
        drop = {i for s, n, q in found for i in range(s + q, s + n)}
        top = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        planted += len(found) > 0
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest()
    assert planted > 20


def test_run_edges(spark, edge):
    out = {(r.carried.doc_id, r.n_runs): r for r in R.periodic_runs(edge, prepare=R.repeat_tail).collect()}
    assert R.periodic_runs(edge).count() == len(EDGE) and out[4, 1].best.period == 1 and out[4, 1].best.length == 30_000
    assert out[4, 1].collapsed == "word" and out[1, 0].best is None and out[1, 0].runs == [] and out[2, 0].collapsed == ""
    assert R.periodic_runs(edge.limit(0)).count() == 0
    small = R.periodic_runs(edge, carry=["doc_id", "best", "n"], batch_words=1)  # every text a batch of its own
    assert sorted(r.n_runs for r in small.collect()) == [0, 0, 0, 0, 0, 1]
    assert R.repeat_tail(None, [b"a"]) == [b"a"]


# ---- collocations

def by_sql(tables, top=2000):
    con = duckdb.connect()
    con.register("documents", tables)
    return con.sql(C.OP13_SQL.replace("rank <= 2000", f"rank <= {top}")).df().sort_values(["lang", "rank"]).reset_index(drop=True)


@pytest.mark.parametrize("top, ahead, lot, keys", [(2000, 4, 8 << 20, 2_000_000), (3, 1, 1 << 16, 20_000), (40, 1, 1 << 18, 50_000)])
def test_collocations_equal_sql(spark, top, ahead, lot, keys):
    docs = read(spark, SF, "documents")
    got = C.collocations(docs, top=top, ahead=ahead, lot_bytes=lot, keys_per_task=keys).toPandas().sort_values(["lang", "rank"]).reset_index(drop=True)
    want = by_sql(docs.select("lang", "text").toPandas(), top)
    assert len(got) > 4 and got.equals(want[got.columns])


def test_collocations_in_hand_made_texts(spark):
    rows = [("a b c d e. " * 40 + "x Y! " * 30 + "p q\n" * 29, None), ("a b " * 35 + "c d\tz " * 3, "en"), ("m n o p " * 31, "en"), ("m n", "en"), (None, "en"), ("", "fr")]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("rank", F.lit(1))
    got = C.collocations(docs, top=10, ahead=1).toPandas().sort_values(["lang", "rank"]).reset_index(drop=True)
    want = by_sql(docs.select("lang", "text").toPandas(), 10)
    assert got.equals(want[got.columns])
    assert list(got[got.lang == "und"].phrase) == ["a b c d", "b c d e", "x y"]


def test_collocation_scores_are_exact():
    import numpy as np

    a = np.array([1, 10**12, 3 * 10**14, 7], dtype=np.int64)
    t = np.array([2, 2 * 10**12 + 1, 10**15, 14], dtype=np.int64)
    assert C.rate(a, t).tolist() == [2_000_000 * x // y for x, y in zip(a.tolist(), t.tolist())]


def test_collocation_edges(spark, edge):
    out = C.collocations(edge).collect()
    assert [(r.lang, r.phrase) for r in out] == [("en", "word word word word")]  # absorbs the shorter ones
    assert C.collocations(edge.limit(0)).count() == 0
    twice = C.collocations(edge.unionByName(edge)).collect()
    assert twice[0].a == 2 * out[0].a and twice[0].n == 2 * out[0].n
