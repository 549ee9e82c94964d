"""Secret scans by assignment-aware lexing (operator 11).

A text is read twice. Three fixed patterns give the base findings. Beside them the text is lexed as source or configuration
code into names, string literals, bare words and operators, and parsed into pairs of a target name and the literal that
it is given: ``name = "x"``, ``name: x``, ``"name" => 'x'``, ``name := x``, ``cfg["name"] = x``, ``name: type = x``,
``--name=x``, ``#define NAME x``, ``put("name", "x")``, ``<name>x</name>``, ``scheme://user:x@host``. Names given a literal are constants
of the text: where a target is given another name, ``${name}`` or a sum, the literals behind it are found through any
number of steps, also when the constant stands further down. A literal is a finding if the words of its target name are
sensitive enough for what the literal looks like. Every step is one linear pass over the whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matforge.llm.common import read

#: Kinds in the order of the report; the first three are the base patterns.
KINDS = ("assign", "access", "hex", "literal")
BASE = KINDS[:3]
#: Findings by the lexer need this score.
THRESHOLD = 0.5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: How much a word, or two words in a row, of a target name say that it holds a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pwd": 0.9, "pass": 0.8, "pw": 0.7, "secret": 0.95, "secrets": 0.8, "token": 0.85,
    "tokens": 0.7, "apikey": 0.95, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "authorization": 0.7, "auth": 0.55, "key": 0.45,
    "signature": 0.55, "salt": 0.55, "private": 0.45, "cookie": 0.45, "session": 0.4, "pin": 0.4, "otp": 0.55,
}
SENSITIVE_PAIRS = {
    ("api", "key"): 0.95, ("private", "key"): 1.0, ("access", "key"): 0.95, ("secret", "key"): 1.0, ("encryption", "key"): 0.95,
    ("signing", "key"): 0.95, ("master", "key"): 0.9, ("account", "key"): 0.9, ("shared", "key"): 0.9, ("client", "secret"): 1.0,
    ("connection", "string"): 0.6, ("ssh", "key"): 0.9, ("license", "key"): 0.7,
}
#: Words that turn such a name into one of something about the secret.
ABOUT = frozenset("""name id ids url uri path file dir field label type length len size min max count limit policy hint prompt placeholder
    regex pattern header index column table prefix suffix expires expiry expiration ttl timeout enabled required reset format
    algorithm endpoint provider class public""".split())
#: Literals that stand for a secret without being one.
STAND_INS = re.compile(r"change.?me|example|sample|dummy|placeholder|redacted|insert|replace|your|todo|fixme|undefined|secret|password|passwd|"
                       r"(?:none|null|nil|true|false|test|string|token|default)$", re.I)

#: A quote opens a literal unless it follows a word character (an apostrophe) or a backslash, so no quote is tried twice.
_TOKEN = re.compile(
    r"""(?P<str>(?<![\w\\])(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`))"""
    r"""|(?P<name>[^\W\d][\w$]*(?:[.-][\w$]+)*)|(?P<tag></?[A-Za-z_][\w.-]*>)|(?P<op>:=|\?=|=>|==|!=|<=|>=|->|::|[=:+&,;()\[\]{}<>#\\])|(?P<nl>\n)|(?P<word>[^\s"'`,;()\[\]{}<>=:+&#\\]+)""")
_GIVES = frozenset((":=", "?=", "=>", "=", ":"))
_BARE = re.compile(r"[^\s\"'`,;()\[\]{}<>&]+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_REFERENCE = re.compile(r"\$(\{)?([A-Za-z_][\w.-]*)(?(1)\})")
_USER = re.compile(r"://[^\s:/@]+:([^\s:/@]+)@")


class Finding(NamedTuple):
    kind: str
    start: int
    end: int
    name: str | None
    score: float


class Literal(NamedTuple):
    start: int
    end: int
    value: str


def base_findings(text: str) -> list[Finding]:
    """Leftmost non-overlapping matches of each base pattern, the too short ones dropped afterwards."""
    out = [Finding("assign", m.start(), m.end(), m[1], 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [Finding("access", m.start(), m.end(), None, 1.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [Finding("hex", m.start(), m.end(), None, 1.0) for m in _HEX.finditer(text)]
    return out


def sensitivity(name: str) -> float:
    """0 to 1: how much a target name says that its literal is a secret."""
    words = [w.lower() for w in _PARTS.findall(name)]
    best = max([SENSITIVE.get(w, 0.0) for w in words] + [SENSITIVE_PAIRS.get(p, 0.0) for p in zip(words, words[1:])], default=0.0)
    return best * 0.3 if ABOUT.intersection(words) else best


def strength(value: str) -> float:
    """0 to 1: how much a literal looks like a secret rather than a word, a sentence, a reference or a stand-in."""
    n = len(value)
    if n < 6 or STAND_INS.match(value) or any(m in value for m in ("${", "{{", "}}", "%s", "$(", "<", ">")):
        return 0.0
    counts = Counter(value)
    if len(counts) < 4:
        return 0.0
    bits = n * math.log2(n) - sum(c * math.log2(c) for c in counts.values())
    out = min(1.0, bits / 24)
    if any(map(str.isspace, value)):
        out *= 0.3
    elif value.isalpha() and (value.islower() or value.isupper() or value.istitle()):
        out *= 0.5
    return out


def score(name: str, value: str) -> float:
    return sensitivity(name) * strength(value)


def assignments(text: str) -> list[tuple[str, list[Literal | str]]]:
    """(target name, its parts) in the order of the text; a part is a literal or the name of a constant."""
    tokens = [(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]
    tokens += [("nl", "\n", len(text), len(text))] * 2
    out: list[tuple[str, list[Literal | str]]] = []
    taken = 0

    def literal(t: tuple) -> Literal | str:
        kind, s, a, b = t
        if kind == "str":
            s, a, b = s[1:-1], a + 1, b - 1
        m = _REFERENCE.fullmatch(s)
        return m[2] if m else Literal(a, b, s)

    def expression(i: int) -> list[Literal | str]:
        """The sum of literals and names from token i on; empty for a call, a bracket or nothing."""
        nonlocal taken
        parts: list[Literal | str] = []
        while True:
            while parts and tokens[i][1] in ("\\", "\n") and i + 1 < len(tokens) and tokens[i][2] < len(text):
                i += 1
            kind, s, a, b = tokens[i]
            if kind == "str":
                parts.append(literal(tokens[i]))
                i += 1
            elif m := _REFERENCE.match(text, a):
                parts.append(m[2])
                while tokens[i][2] < m.end():
                    i += 1
            elif kind in ("name", "word"):
                m = _BARE.match(text, a)  # a bare word of configuration goes on over operators
                end = m.end() if m else b
                if kind == "name" and end == b:
                    if tokens[i + 1][1] == "(":
                        return []
                    parts.append(s)
                    i += 1
                else:
                    parts.append(Literal(a, end, text[a:end]))
                    taken = end  # what stands in a bare word is no assignment of its own
                    return parts
            else:
                return parts
            if tokens[i][1] in ("+", "&"):
                i += 1
            elif not (tokens[i][0] == "str" and kind == "str"):
                return parts

    def target(i: int) -> str | None:
        """The name that ends at token i."""
        kind, s, _, _ = tokens[i]
        if s == "]" and i >= 2 and tokens[i - 1][0] in ("str", "name"):
            i, (kind, s, _, _) = i - 1, tokens[i - 1]
        if kind == "str":
            return s[1:-1]
        if kind == "name" and i >= 2 and tokens[i - 1][1] == ":" and tokens[i - 2][0] == "name":
            return tokens[i - 2][1]
        return s if kind in ("name", "word") else None

    for i, (kind, s, a, b) in enumerate(tokens[:-2]):
        if a < taken:
            continue
        if kind == "op" and s in _GIVES and i:
            name = target(i - 1)
            if name and (parts := expression(i + 1)):
                out.append((name, parts))
        elif kind == "name" and s == "define" and i and tokens[i - 1][1] == "#" and tokens[i + 1][0] == "name":
            if parts := expression(i + 2):
                out.append((tokens[i + 1][1], parts))
        elif s == "," and i and tokens[i - 1][0] == "str" and tokens[i + 1][0] == "str":
            out.append((tokens[i - 1][1][1:-1], [literal(tokens[i + 1])]))
        elif kind == "tag" and s[1] != "/":
            end = text.find("<", b)
            if end > b and text.startswith(f"</{s[1:]}", end):
                out.append((s[1:-1], [literal(("word", text[b:end], b, end))]))
    out += [("password", [Literal(m.start(1), m.end(1), m[1])]) for m in _USER.finditer(text)]
    return out


def literals(pairs: list[tuple[str, list[Literal | str]]], threshold: float) -> Iterator[tuple[str, float, Literal]]:
    """(target name, score, literal) of every literal that a sensitive enough target is given, directly or through
    constants; each literal once, with the first such target.

    A name stands for what it was last given before its use, or else for what it is given last in the text; a dotted name is also known by
    its last part. A sum is judged by the first 64 characters of the whole. Every assignment is walked once, so a chain
    of any length, or one that leads back to itself, takes linear time.
    """
    last: dict[str, int] = {}
    refs: list[list[Literal | str | int]] = []
    for name, parts in pairs:
        refs.append([last.get(p, p) if isinstance(p, str) else p for p in parts])
        last[name] = last[name.rsplit(".", 1)[-1]] = len(refs) - 1
    values: list[str] = []
    for i, parts in enumerate(refs):
        refs[i] = parts = [last.get(p, -1) if isinstance(p, str) else p for p in parts]
        if len(parts) == 1 and isinstance(parts[0], Literal):
            values.append(parts[0].value)
        else:
            values.append("".join(p.value[:64] if isinstance(p, Literal) else values[p][:64] if 0 <= p < i else "" for p in parts[:64])[:64])
    for i in range(len(refs) - 1, -1, -1):
        if len(refs[i]) == 1 and isinstance(refs[i][0], int) and refs[i][0] > i:
            values[i] = values[refs[i][0]]  # a constant that stands further down
    seen: set[int] = set()
    for i, (name, _) in enumerate(pairs):
        if not sensitivity(name):
            continue
        if (s := score(name, values[i])) < threshold:
            continue
        todo = [i]
        while todo:
            if (at := todo.pop()) in seen or at < 0:
                continue
            seen.add(at)
            for p in refs[at]:
                if isinstance(p, Literal):
                    yield name, s, p
                else:
                    todo.append(p)


def findings(text: str | None, threshold: float = THRESHOLD) -> list[Finding]:
    """All findings of a text by start, then kind: those of the base patterns, and the literals of sensitive
    targets that no base finding holds."""
    if not text:
        return []
    out = base_findings(text)
    if "=" in text or ":" in text or "<" in text or '",' in text or "'," in text or "#define" in text:
        best: dict[tuple[int, int], Finding] = {}
        for name, s, x in literals(assignments(text), threshold):
            best.setdefault((x.start, x.end), Finding("literal", x.start, x.end, name, s))
        spans = sorted((f.start, f.end) for f in out)
        reach, at, held = -1, 0, []
        for f in sorted(best.values(), key=lambda f: f.start):
            while at < len(spans) and spans[at][0] <= f.start:
                reach, at = max(reach, spans[at][1]), at + 1
            if f.end > reach:
                held.append(f)
        out += held
    return sorted(out, key=lambda f: (f.start, KINDS.index(f.kind)))


_FINDINGS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                      T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())]))


def _scan(threshold: float):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[f._asdict() for f in findings(t.as_py(), threshold)] for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["carried"], pa.array(found, kind)], ["carried", "findings"])
    return run


def scan(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Findings of every whole text: (carried, findings), one row per input row.

    carried is a struct of the columns named in ``carry`` (doc_id if none are), so clashing names do no harm; findings an array of (kind,
    start, end, name, score) by start, then kind, in code points, end exclusive. Null and empty texts have an empty array; ids may be null
    or repeat and repeated rows are each scanned; an empty input gives no rows. No shuffle.
    """
    own = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in carry or ["doc_id"])).alias("carried"))
    return own.mapInArrow(_scan(threshold), T.StructType([own.schema["carried"], T.StructField("findings", _FINDINGS)]))


def span_list(found: Column) -> Column:
    """kind:start:end of every finding, joined by commas."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: counts and digest of the base findings, and all spans."""
    f = F.col("findings")
    of = lambda k: F.size(F.filter(f, lambda x: x["kind"] == k)).cast("long")
    base = F.filter(f, lambda x: x["kind"].isin(*BASE))
    return scan(read(spark, sf_dir, "documents")).select(
        "carried.doc_id", *(of(k).alias(f"n_{k}") for k in BASE), F.sha2(span_list(base), 256).alias("base_sha256"), span_list(f).alias("spans"))
