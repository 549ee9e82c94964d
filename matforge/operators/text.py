"""Text features (M1-M3): TF-IDF over unigrams + bigrams, truncated SVD, transform.

TF-IDF is declared as DataFrame aggregation: tokens are exploded, counted per
(document, term) — combined map-side because a document's tokens come from one row —
then per term. The vocabulary holds every term unless a size is given, so it joins by shuffle;
AQE broadcasts it where it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matforge.operators.term_lots import TermLots
from matforge.session import written

# Token rule (two or more word characters) and the vocabulary size of the decomposition.
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
TRAIN_MAX_FEATURES = 15000
SVD_COMPONENTS = 50


def tokens(text: Column) -> Column:
    """Lower-cased word tokens of the whole text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_RE), 0)


def uni_bigrams(toks: Column) -> Column:
    """Unigrams followed by bigrams of consecutive tokens ('a b')."""
    n = F.greatest(F.size(toks) - 1, F.lit(0))
    bi = F.zip_with(F.slice(toks, 1, n), F.slice(toks, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(toks, bi)


def _dealt(docs: DataFrame, doc_id: str, text: str, copies: str | None = None, neighbours: bool = False) -> DataFrame:
    """(doc_id, copies if named, toks): the tokens of whole texts, dealt by document; with ``neighbours`` rows of one id are neighbours."""
    more = ["copies"] if copies else []
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *(F.col(copies).alias(c) for c in more)).repartition("doc_id")
    own = own.sortWithinPartitions("doc_id") if neighbours else own
    return own.select("doc_id", *more, tokens(F.col("text")).alias("toks"))


def term_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", copies: str | None = None) -> DataFrame:
    """(doc_id, term, tf): raw term counts per document; with ``copies``, a count of equal documents that a row stands for, this too.

    The whole texts are dealt by document, which spreads the work of a file that Spark cannot split and spares a shuffle of all terms. A text's tokens
    are a column of their own: inside the explode they would be made anew for each of their uses.
    """
    more = ["copies"] if copies else []
    e = _dealt(docs, doc_id, text, copies).select("doc_id", *more, F.explode(uni_bigrams(F.col("toks"))).alias("term"))
    return e.groupBy("doc_id", *more, "term").agg(F.count(F.lit(1)).alias("tf"))


def fit_vocabulary(tf: DataFrame, n_docs: DataFrame, max_features: int | None = None) -> DataFrame:
    """(term, df, idf): every term, or the top ``max_features`` by corpus count (ties by term), with smooth idf
    ln((1 + n) / (1 + df)) + 1. A vocabulary of a given size also has ``idx``, its terms numbered alphabetically from 0."""
    copies = F.col("copies") if "copies" in tf.columns else F.lit(1)
    stats = tf.groupBy("term").agg(F.sum(F.col("tf") * copies).alias("cf"), F.sum(copies).alias("df"))
    top = stats if max_features is None else stats.orderBy(F.col("cf").desc(), F.col("term").asc()).limit(max_features)
    vocab = _with_idf(top.crossJoin(F.broadcast(n_docs)), F.col("n_docs"))
    return vocab if max_features is None else _numbered(vocab)


def _with_idf(stats: DataFrame, n_docs: Column) -> DataFrame:
    return stats.select("term", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def _numbered(vocab: DataFrame) -> DataFrame:
    """A vocabulary of a given size, over which one ordered window is bounded, with ``idx``."""
    return vocab.withColumn("idx", (F.dense_rank().over(Window.orderBy("term")) - 1).cast("int"))


def tfidf_weights(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, term, weight, idx if the vocabulary has it, and copies if the counts have them): tf * idf, L2-normalised per document over kept terms."""
    idx = [c for c in ("idx",) if c in vocab.columns]
    # A numbered vocabulary has a bounded size and is sent to the counts. Without a bound both sides grow with the texts, and Spark sizes
    # an explode like the file below it: merged, never broadcast.
    known = vocab.select("term", "idf", *idx)
    joined = tf.join(F.broadcast(known), "term") if idx else tf.hint("merge").join(known, "term")
    w = joined.withColumn("w", F.col("tf") * F.col("idf"))
    # a document's terms come from one text: the window is bounded by it
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    more = [c for c in ("copies",) if c in tf.columns]
    return w.select("doc_id", "term", *idx, *more, (F.col("w") / norm).alias("weight"))


def fit_tfidf(docs: DataFrame, max_features: int | None = None, doc_id: str = "doc_id",
              text: str = "text", copies: str | None = None) -> tuple[DataFrame | TermLots, DataFrame]:
    """M1: (vocabulary table, long weight table). The counts are written once, as both tables read them. A vocabulary of every term
    grows with the texts and stays in lots of documents: ``TermLots``, whose ``vocabulary()`` is the table."""
    if max_features is None and copies is None:
        lots = TermLots(_dealt(docs, doc_id, text, neighbours=True))
        return lots, lots.weights()
    tf = written(term_counts(docs, doc_id, text, copies), "term-counts")
    n_docs = docs.agg((F.coalesce(F.sum(copies), F.lit(0)) if copies else F.count(F.lit(1))).alias("n_docs"))
    vocab = fit_vocabulary(tf, n_docs, max_features)
    return vocab, tfidf_weights(tf, vocab)


def fit_tfidf_blocks(docs: DataFrame, max_features: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """M1 for a decomposition: (vocabulary of ``max_features`` terms, written; weights in blocks of documents). The counts stay in lots of
    documents, of which only the distinct terms are shuffled."""
    lots = TermLots(_dealt(docs, doc_id, text, neighbours=True))
    vocab = written(_numbered(_with_idf(lots.most_frequent(max_features), F.lit(lots.n_docs))), "vocabulary")
    return vocab, lots.blocks(vocab)


def transform_tfidf(docs: DataFrame, vocab: DataFrame | TermLots, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """M3 (first half): weights of new documents under a stored vocabulary, or one that stays in lots."""
    if isinstance(vocab, TermLots):
        return vocab.weights(TermLots(_dealt(docs, doc_id, text, neighbours=True)))
    return tfidf_weights(term_counts(docs, doc_id, text), vocab)


def _is_packed(weights: DataFrame) -> bool:
    return "e" in weights.columns or "sizes" in weights.columns


def packed(weights: DataFrame) -> DataFrame:
    """(doc_id, e): one row per document with its entries (idx, weight) by idx; a frame that is packed already, or in blocks, stays as it is."""
    if _is_packed(weights):
        return weights
    return weights.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("e"))


def _blocks(batch, docs: int = 64):
    """(document number, idx, weight) arrays of at most ``docs`` documents of an Arrow batch of packed entries, or of its blocks, and how many they are."""
    import numpy as np

    if "sizes" in batch.schema.names:
        for row in zip(*(batch[c] for c in ("sizes", "idx", "weight"))):
            size, idx, weight = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row, ("<i4", "<i4", "<f8")))
            yield np.repeat(np.arange(len(size)), size), idx, weight, len(size)
        return
    column = batch["e"]
    ends = column.offsets.to_numpy()
    flat = column.values.slice(ends[0], ends[-1] - ends[0])
    idx, weight, ends = flat.field("idx").to_numpy(), flat.field("weight").to_numpy(), ends - ends[0]
    for at in range(0, len(ends) - 1, docs):
        part = ends[at:at + docs + 1]
        yield np.repeat(np.arange(len(part) - 1), np.diff(part)), idx[part[0]:part[-1]], weight[part[0]:part[-1]], len(part) - 1


def _dense(doc, idx, weight, n_docs: int, n: int):
    """The documents as a dense matrix over the terms that they have, and these terms."""
    import numpy as np

    seen = np.zeros(n, dtype=bool)
    seen[idx] = True
    d = np.zeros((n_docs, int(seen.sum())))
    d[doc, (np.cumsum(seen) - 1)[idx]] = weight
    return d, np.flatnonzero(seen)


def _gram_product(rows: DataFrame, q, piece: int = 1000):
    """A'(A q) for the packed rows of A: every task adds up its documents, and the tasks' sums are added by pieces of terms."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    n, b = q.shape
    sc = rows.sparkSession.sparkContext
    held = sc.broadcast(q)

    def multiply(batches):
        out, mine = np.zeros((n, b)), held.value
        for batch in batches:
            for doc, idx, weight, n_docs in _blocks(batch):
                d, terms = _dense(doc, idx, weight, n_docs, n)
                out[terms] += d.T @ (d @ mine[terms])
        starts = range(0, n, piece)
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([out[i:i + piece].tobytes() for i in starts], pa.binary())], names=["at", "sums"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": pdf["at"][:1], "sums": [sum(np.frombuffer(x) for x in pdf["sums"]).tobytes()]})

    try:
        # A task's sums are as large as q, so there are no more tasks than run at once.
        parts = rows.select(*(c for c in ("e", "sizes", "idx", "weight") if c in rows.columns)).coalesce(max(1, sc.defaultParallelism)).mapInArrow(multiply, "at int, sums binary")
        got = parts.groupBy("at").applyInPandas(total, "at int, sums binary").collect()
    finally:
        held.destroy()
    out = np.zeros((n, b))
    for r in got:
        out[r["at"]:r["at"] + piece] = np.frombuffer(r["sums"]).reshape(-1, b)
    return out


#: Residual of a component, as a share of its eigenvalue, at which it counts as found; components asked for besides the k; columns kept at most, in k + MORE.
SVD_TOL, MORE, HELD_BLOCKS = 1e-8, 14, 10


def fit_svd(weights: DataFrame, vocab_size: int, k: int = SVD_COMPONENTS) -> tuple[DataFrame, list[float]]:
    """M2: truncated SVD of the documents x terms matrix A by a block Krylov method on A'A, until every component's residual is within ``SVD_TOL``.

    A round multiplies all rows in parallel by a block of k + ``MORE`` vectors, so a few rounds do. The driver holds at most
    ``HELD_BLOCKS`` such blocks, and the result, bounded by the vocabulary's size and k. Returns (V as (idx, comp, value), singular values); the sign of
    a component is that which makes its largest entry positive. Components beyond the matrix's rank are left out.
    """
    import numpy as np
    import pyarrow as pa

    n = max(1, int(vocab_size))
    k = max(1, min(k, n - 1))
    b = min(n, k + MORE)
    rows = packed(weights)
    rows = rows if _is_packed(weights) else written(rows, "svd-rows")  # read in every round
    block = np.random.default_rng(0).standard_normal((n, b))
    q = w = np.zeros((n, 0))  # the orthonormal columns so far, and A'A of them
    while True:
        for _ in range(2):  # the second time for the digits that the first one loses
            block = block - q @ (q.T @ block)
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            block = u[:, s > 1e-10]
        if not block.shape[1]:
            break  # nothing is left outside
        q, w = np.hstack([q, block]), np.hstack([w, _gram_product(rows, block)])
        t = q.T @ w
        theta, y = np.linalg.eigh((t + t.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        lead = min(b, len(theta))
        residual = w @ y[:, :lead] - q @ y[:, :lead] * theta[:lead]
        size = np.linalg.norm(residual, axis=0)
        left = size > SVD_TOL * np.abs(theta[:lead]) + 1e-13 * theta[0]
        if not left[:k].any():
            break
        block = residual[:, left] / size[left]
        if q.shape[1] + block.shape[1] > max(HELD_BLOCKS * b, 2 * b):
            q, w = q @ y[:, :2 * b], w @ y[:, :2 * b]
    t = q.T @ w
    theta, y = np.linalg.eigh((t + t.T) / 2)
    theta, y = theta[::-1][:k], y[:, ::-1][:, :k]
    found = theta > n * np.finfo(float).eps * max(theta[0], 0.0)
    v, sing = q @ y[:, found], np.sqrt(theta[found])
    flip = np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])
    v = v * np.where(flip == 0, 1.0, flip)
    ii, jj = np.meshgrid(np.arange(n), np.arange(v.shape[1]), indexing="ij")
    table = pa.table({"idx": ii.ravel().astype("int32"), "comp": jj.ravel().astype("int32"), "value": v.ravel()})
    return weights.sparkSession.createDataFrame(table, "idx int, comp int, value double"), [float(x) for x in sing]


def project(weights: DataFrame, comps: DataFrame, k: int) -> DataFrame:
    """M3 (second half): document vectors = weights · V, a block of documents at a time (V is held by every task: at most
    ``TRAIN_MAX_FEATURES`` x k doubles)."""
    import numpy as np
    import pyarrow as pa

    rows = packed(weights)
    table = comps.toArrow()
    idx, comp, value = (table.column(c).to_numpy() for c in ("idx", "comp", "value"))
    n = int(idx.max()) + 1 if len(idx) else 1
    v = np.zeros((n, k))
    v[idx, comp] = value
    held = comps.sparkSession.sparkContext.broadcast(v)
    kind = (rows.schema["doc_id"].dataType if "e" in rows.columns else rows.schema["ids"].dataType.elementType).simpleString()

    def vectors(batches):
        mine = held.value
        for batch in batches:
            out = []
            for doc, at, weight, n_docs in _blocks(batch):
                has = at < n  # a term beyond the components has none
                d, terms = _dense(doc[has], at[has], weight[has], n_docs, n)
                out.append(d @ mine[terms])
            flat = pa.array(np.concatenate(out).ravel() if out else np.zeros(0))
            svd = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k), pa.int32()), flat)
            ids = batch["doc_id"] if "doc_id" in batch.schema.names else batch["ids"].flatten()
            yield pa.RecordBatch.from_arrays([ids, svd], names=["doc_id", "svd"])

    return rows.mapInArrow(vectors, f"doc_id {kind}, svd array<double>")
