"""Toxicity scores from a weighted lexicon matched by Aho-Corasick (operator 2).

Texts are folded first (homoglyphs to Latin letters, digits and signs that stand for letters, invisible characters
dropped, lower case). Lexicon entries are whole words or word beginnings with a weight, learned from labelled
documents; exception phrases cancel the hits inside them. One automaton pass gives the weighted hits of a text, which
are normalised by its length and turned into a probability by a small logistic model.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matforge.llm.common import id_remainder, read, written

# Letters of other scripts that look like a Latin letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ո": "n", "ս": "u", "օ": "o",
}
# Digits and signs written for a letter.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
#: Phrases in which a lexicon word is harmless; callers may give their own.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "rodeo clown", "class clown", "kill time", "kill switch", "kill two birds",
    "painkiller", "killer whale", "dead end", "dead line", "dead sea", "dead battery", "drop dead date", "die cast", "die hard", "dumb bell", "dumb waiter",
    "dummy variable", "dummy data", "crash test dummy", "idiot proof", "idiot light", "stupid simple", "moron mountain", "loser bracket", "sore loser",
    "pig iron", "guinea pig", "piggy bank", "rat race", "lab rat", "scum line", "pond scum", "garbage collector", "garbage collection", "garbage truck",
    "rubbish bin", "ugly duckling", "hate crime law", "pest control", "parasite host", "toxic waste", "toxic asset", "shut up and take my money",
    "trampa de basura", "cubo de basura", "poubelle de tri", "mülleimer", "papierkorb")
#: Labelled documents that the lexicon and the logistic model are fitted on at most (smallest hashes of the id).
SAMPLE = 20_000
#: Lexicon entries at most, the strongest first, and the documents that must hold an entry.
ENTRIES, SUPPORT = 1_000, 3
#: An entry is at least so many times as frequent in toxic text.
RATIO = 4.0
PREFIX = range(3, 13)

_MAP = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(k.upper()): v for k, v in HOMOGLYPHS.items() if len(k.upper()) == 1}
_MAP |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF10 + i: str(i) for i in range(10)}
_MAP |= dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_ODD = re.compile("[­ıɐ-ʯͰ-֏​-‍⁠﻿０-ｚ]")
_SIGN = re.compile(r"[0134578@$!|9]")
#: A sign before a letter, or a digit after one: the word around it is read as letters.
_BESIDE = re.compile(r"[0-9@$!|][^\W\d_]|[^\W\d_][0-9]")
_REST = re.compile(r"[\w@$!|]*")
_AS_LETTER = str.maketrans(SUBSTITUTES)
SUBSTITUTES_AND_DIGITS = frozenset(SUBSTITUTES) | frozenset("0123456789")
_LETTERS = re.compile(r"[\W\d_]+")


def _as_letters(text: str) -> str:
    """Words that hold a sign beside a letter, read as letters. One pass: a word is looked at once, however long it is."""
    out, done = [], 0
    m = _BESIDE.search(text)
    while m:
        start = m.start()
        while start > done and text[start - 1] in SUBSTITUTES_AND_DIGITS:
            start -= 1
        while start > done and text[start - 1].isalnum():
            start -= 1
        end = _REST.match(text, m.start()).end()
        word = text[start:end].rstrip("@$!|")
        out += [text[done:start], word.translate(_AS_LETTER)]
        done = end
        m = _BESIDE.search(text, end)
    return "".join([*out, text[done:]])


def fold(text: str | None) -> str:
    """Words of the folded text, lower case, one space around each; ' ' for null or no words.

    A digit or sign is read as a letter only beside letters of the same word, so numbers and trailing punctuation
    stay what they are.
    """
    if not text:
        return " "
    if not text.isascii() and _ODD.search(text):
        text = text.translate(_MAP)
    if _SIGN.search(text):
        text = _as_letters(text)
    return f" {_LETTERS.sub(' ', text.lower()).strip()} ".replace("  ", " ")


@dataclass
class Lexicon:
    """entries: ' word ' or ' beginning' to weight; exceptions: folded phrases; coef: of the logistic model."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coef: list[float] = field(default_factory=lambda: [-2.0, 1.0, 0.0, 0.0, 0.0])

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for p in self.exceptions:
            a.add_word(key := fold(p), (len(key), None))
        for p, w in self.entries.items():
            # A '1' is folded to i but may stand for l: the spelling with i for l is an entry as well.
            for key in {p, p.replace("l", "i")}:
                if key not in a:
                    a.add_word(key, (len(key), w))
        a.make_automaton()
        return a


def features(a: ahocorasick.Automaton, text: str | None) -> tuple[float, float, float, float]:
    """(weighted hits a word, log of 1 + weighted hits, log of 1 + hits, log of 1 + words) of one text."""
    t = fold(text)
    words, hits, total, free = t.count(" ") - 1, 0, 0.0, -1
    found = [(end - n + 1, end, w) for end, (n, w) in a.iter(t)] if len(a) and words > 0 else []
    spans = sorted((s, e) for s, e, w in found if w is None)
    starts, reach = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
    for s, e, w in found:
        if w is not None and not ((k := bisect_right(starts, s)) and reach[k - 1] >= e):
            hits, total = hits + 1, total + w
    return 10 * total / (words + 10), math.log1p(total), math.log1p(hits), math.log1p(max(words, 0))


def probability(x: np.ndarray, coef: list[float]) -> np.ndarray:
    z = np.clip(coef[0] + x @ np.asarray(coef[1:]), -30, 30)
    return 1 / (1 + np.exp(-z))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> list[float]:
    """Logistic regression by Newton steps."""
    x1 = np.hstack([np.ones((len(x), 1)), x])
    b, pen = np.zeros(x1.shape[1]), np.diag([1e-3] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ b, -30, 30)))
        step = np.linalg.solve(x1.T @ (x1 * (p * (1 - p))[:, None]) + pen, x1.T @ (y - p) - pen @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return [float(v) for v in b]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences of words and word beginnings by (entry, fold, label); partial sums. A document vouches for an entry with at most three
    occurrences, so that no single text makes a lexicon."""
    seen: Counter = Counter()

    def out():
        rows = [(k, f, y, n) for (k, f, y), n in seen.items()]
        seen.clear()
        return pd.DataFrame(rows, columns=["entry", "half", "toxic", "n"])

    for pdf in batches:
        for text, half, toxic in zip(pdf["text"], pdf["half"], pdf["toxic"]):
            words = fold(text).split()
            seen["", half, toxic] += len(words)
            own: Counter = Counter(words)
            pre: Counter = Counter()
            for w, c in own.items():
                for k in PREFIX:
                    if k > len(w):
                        break
                    pre[w[:k]] += c
            for w, c in own.items():
                seen[f" {w} ", half, toxic] += min(c, 3)
            for w, c in pre.items():
                seen[f" {w}", half, toxic] += min(c, 3)
            if len(seen) > 400_000:
                yield out()
    yield out()


def choose(counts: dict[str, tuple[float, float]], words: tuple[float, float], size: int, ratio: float, support: int) -> dict[str, float]:
    """Weighted entries from occurrences in (clean, toxic) text and the words of each.

    Entries are taken by the strength of their evidence; of entries that begin with one another only the strongest
    stays. The weight is the log of how much more frequent the entry is in toxic text.
    """
    scored = []
    for p, (c, t) in counts.items():
        w = math.log(((t + 0.5) / (words[1] + 1)) / ((c + 0.5) / (words[0] + 1)))
        if t >= support and w >= math.log(ratio):
            expect = (c + t) * words[1] / max(words[0] + words[1], 1)
            scored.append((t * math.log(t / expect) - (t - expect) + 0.001 * len(p), p, w))
    taken: dict[str, float] = {}
    begun: set[str] = set()
    for s, p, w in sorted(scored, reverse=True):
        bare = p.rstrip()
        if s < 6 or len(taken) >= size or bare in begun or any(bare[:i] in taken for i in range(2, len(bare) + 1)):
            continue
        taken[p] = min(w, 6.0)
        begun.update(bare[:i] for i in range(2, len(bare) + 1))
    return taken


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = ENTRIES, ratio: float = RATIO, support: int = SUPPORT,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Fit a lexicon and its logistic model on labelled documents (0 / 1; null labels are left out).

    At most ``sample`` labelled ids, those with the smallest hash, are read. Occurrences are counted by Spark, which also weighs the
    evidence: every entry that passes ``support``, ``ratio`` and the evidence test reaches the driver, bounded by the
    sample, and ``size`` of them are kept by strength. The logistic model is fitted on features of the half of the sample that did not choose the entries, and the other way
    round. Without a toxic or a clean example the lexicon is empty and scores are the share of toxic labels.
    """
    ids = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    ids = ids.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int")
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").select("text", "toxic", half.alias("half"))
    train = written(train, "toxicity-sample")
    counted = written(train.mapInPandas(_count, "entry string, half int, toxic int, n long").groupBy("entry").agg(*(
        F.sum(F.when((F.col("half") == h) & (F.col("toxic") == y), F.col("n")).otherwise(0)).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1))), "toxicity-counts")
    cols = ["n00", "n01", "n10", "n11"]
    total = counted.where("entry = ''").select(*cols).first()
    total = [float(v) for v in total] if total else [0.0] * 4
    clean, toxic = F.col("n00") + F.col("n10"), F.col("n01") + F.col("n11")
    if not (total[0] + total[2]) or not (total[1] + total[3]):
        share = train.agg(F.avg("toxic")).first()[0]
        share = min(max(share if share is not None else 0.0, 1e-3), 1 - 1e-3)
        return Lexicon({}, exceptions, [math.log(share / (1 - share)), 0.0, 0.0, 0.0, 0.0])
    def strong(i: tuple[int, ...], j: tuple[int, ...]):
        """The tests of ``choose`` as a column, a little wider, so that rounding loses nothing."""
        c, t = (sum((F.col(cols[k]) for k in ks[1:]), F.col(cols[ks[0]])).cast("double") for ks in (i, j))
        nc, nt = sum(total[k] for k in i), sum(total[k] for k in j)
        expect = (c + t) * nt / max(nc + nt, 1)
        evidence = t * F.log(t / expect) - (t - expect) + 0.001 * F.length("entry")
        return (t >= support) & ((t + 0.5) / (nt + 1) >= 0.999 * ratio * (c + 0.5) / (nc + 1)) & (evidence >= 5.999)

    folds = [((0, 2), (1, 3)), ((2,), (3,)), ((0,), (1,))]
    best = counted.where((F.col("entry") != "") & (strong(*folds[0]) | strong(*folds[1]) | strong(*folds[2]))).collect()
    pick = lambda i, j: choose({r["entry"]: (sum(r[cols[k]] for k in i), sum(r[cols[k]] for k in j)) for r in best},
                               (sum(total[k] for k in i), sum(total[k] for k in j)), size, ratio, support)
    entries = pick(*folds[0])
    beginnings = [p[1:] for p in entries if not p.endswith(" ")]
    learned: tuple[str, ...] = ()
    if beginnings:
        word = F.trim("entry")
        innocent = counted.where(F.col("entry").endswith(" ") & word.rlike("^(?:" + "|".join(map(re.escape, beginnings)) + ")") & (clean >= 5)
                                 & ((toxic + 0.5) / (total[1] + total[3] + 1) < (clean + 0.5) / (total[0] + total[2] + 1)))
        learned = tuple(r[0] for r in innocent.select(word).orderBy(F.desc(clean), word).limit(size).collect())
    halves = [pick(*folds[1]), pick(*folds[2])]  # by half: the entries that the other half chose

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        autos = [Lexicon(h, exceptions + learned).automaton() for h in halves]
        for pdf in batches:
            yield pd.DataFrame([(*features(autos[h], t), y) for t, h, y in zip(pdf["text"], pdf["half"], pdf["toxic"])], columns=["a", "b", "c", "d", "y"])

    xy = np.array([tuple(r) for r in train.mapInPandas(rows, "a double, b double, c double, d double, y double").collect()], dtype=float).reshape(-1, 5)
    return Lexicon(entries, exceptions + learned, _fit(xy[:, :4], xy[:, 4]))


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", out_col: str = "toxicity_score") -> DataFrame:
    """``docs`` with a column ``out_col`` (0 to 1; null and empty texts get that of a text without hits)."""
    @F.pandas_udf("double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = lexicon.automaton()
        for s in batches:
            yield pd.Series(probability(np.array([features(a, t) for t in s], dtype=float).reshape(-1, 4), lexicon.coef))
    return docs.withColumn(out_col, udf(F.col(text_col)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels outside the held-out quarter and scores every whole text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    lexicon = learn(docs, labels.where(id_remainder(F.col("doc_id"), 4) != 2))
    out = score(docs, lexicon)
    return out.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("toxicity_score").alias("score"),
                      (F.col("toxicity_score") >= 0.3).cast("int").alias("predicted"))
