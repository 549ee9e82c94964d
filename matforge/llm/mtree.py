"""Exact top-k inner products by best-first search in M-trees (operator 9).

Vectors get one more coordinate that makes all of one length, so the largest inner product is the smallest Euclidean
distance, which is a metric. Every cell of rows is an M-tree of pages: a page has a routing vector, its covering radius and
its distance to the parent's routing vector, and a leaf's entries their distances to the routing vector of the leaf. A search
opens pages in the order of their least possible distance and stops when none can hold a better answer; stored parent distances
spare the computation of distances that the triangle inequality already rules out.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matforge.llm.common import partitions_for, read, written

SCALE = 256
#: Vectors of one tree, of one leaf, children of an inner page, and queries of one block.
CELL, LEAF, FAN = 20_000, 256, 16
QUERIES = 4_096
#: Vectors sampled as seeds of the cells at most; they only decide which rows share a tree.
SEEDS = 128
#: Sums of products below this are exact in doubles, and those below the next in longs; larger ones are summed as Python integers.
EXACT, LONG = 2.0 ** 53, 2.0 ** 62


def quantise(vectors: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row numbers, integer vectors): floor(scale * x) of rows without null, NaN or infinite components."""
    rows, out = [], []
    for i, v in enumerate(vectors):
        v = v.as_py()
        if v is None or any(x is None for x in v):
            continue
        x = np.floor(scale * np.asarray(v, dtype=np.float64))
        if np.isfinite(x).all():
            rows.append(i)
            out.append(x)
    return np.array(rows, dtype=np.int64), out


def _packed(x: np.ndarray) -> bytes:
    """Integral doubles as bytes: four each if all fit, eight otherwise."""
    return x.astype("<i4" if (np.abs(x) < 2.0 ** 31).all() else "<f8").tobytes()


def _integers(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vs = quantise(batch["embedding"], scale)
            yield pa.RecordBatch.from_arrays([batch["vec_id"].take(pa.array(rows)), pa.array([_packed(v) for v in vs], pa.binary()),
                                              pa.array([float(v @ v) for v in vs], pa.float64()), pa.array([len(v) for v in vs], pa.int32())], ["vec_id", "v", "norm", "dim"])
    return run


def _matrix(blobs: list[tuple[bytes, int]], dim: int) -> np.ndarray:
    """Rows of packed vectors (bytes, length) as doubles; shorter ones are filled with zeros."""
    out = np.zeros((len(blobs), dim))
    for i, (b, n) in enumerate(blobs):
        v = np.frombuffer(b, dtype="<f8" if len(b) > 4 * n else "<i4")
        out[i, :len(v)] = v
    return out


def build(x: np.ndarray, ids: np.ndarray, leaf: int = LEAF, fan: int = FAN, seed: int = 0) -> list[dict]:
    """Pages of an M-tree over the rows of ``x`` (the last column makes all rows equally long), the root first.

    page: parent (-1 for the root), routing vector, covering radius, distance to the parent's routing vector; a leaf also
    has the ids, vectors and distances to its routing vector, by distance. Rows that cannot be told apart are cut evenly.
    """
    rng = np.random.default_rng(seed)
    pages: list[dict] = []
    work = [(np.arange(len(x)), -1, None)]
    while work:
        rows, parent, near = work.pop()
        center = x[rows].mean(axis=0) if near is None else near
        d = np.sqrt(((x[rows] - center) ** 2).sum(axis=1))
        page = {"parent": parent, "center": center, "radius": float(d.max()) if len(d) else 0.0,
                "parent_distance": float(np.linalg.norm(center - pages[parent]["center"])) if parent >= 0 else 0.0, "rows": None, "distance": None}
        pages.append(page)
        me = len(pages) - 1
        if len(rows) <= leaf:
            order = np.argsort(d, kind="stable")
            page["rows"], page["distance"] = rows[order], d[order]
            continue
        k = min(fan, -(-len(rows) // leaf) + 1)
        seeds = x[rows[rng.choice(len(rows), k, replace=False)]]
        to = (seeds ** 2).sum(axis=1)[None, :] - 2 * x[rows] @ seeds.T
        own = to.argmin(axis=1)
        groups = [rows[own == g] for g in range(k)]
        groups = [g for g in groups if len(g)]
        if len(groups) == 1:
            groups = np.array_split(rows, -(-len(rows) // leaf))
        work += [(g, me, x[g].mean(axis=0)) for g in groups]
    for p in pages:
        if p["rows"] is not None:
            p["ids"], p["vectors"] = ids[p["rows"]], x[p["rows"]]
    return pages


def _page_rows(dim: int, longest: float, leaf: int, fan: int):
    """Rows (tree, page, parent, radius, parent_distance, center, ids, vectors, distances): all pages of each cell's tree."""
    def out(tree: int, ids: list, blobs: list) -> pa.RecordBatch:
        x = _matrix(blobs, dim)
        full = np.hstack([x, np.sqrt(np.maximum(longest - (x ** 2).sum(axis=1), 0))[:, None]])
        pages = build(full, np.array(ids, dtype=np.int64), leaf, fan, tree & 0x7FFFFFFF)
        is_leaf = [p["rows"] is not None for p in pages]
        cols = [pa.array([tree] * len(pages), pa.int64()), pa.array(range(len(pages)), pa.int32()), pa.array([p["parent"] for p in pages], pa.int32()),
                pa.array([p["radius"] for p in pages], pa.float64()), pa.array([p["parent_distance"] for p in pages], pa.float64()),
                pa.array([p["center"].tobytes() for p in pages], pa.binary()),
                pa.array([p["ids"].tobytes() if f else None for p, f in zip(pages, is_leaf)], pa.binary()),
                pa.array([_packed(p["vectors"][:, :-1]) if f else None for p, f in zip(pages, is_leaf)], pa.binary()),
                pa.array([p["distance"].tobytes() if f else None for p, f in zip(pages, is_leaf)], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["tree", "page", "parent", "radius", "parent_distance", "center", "ids", "vectors", "distances"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, ids, blobs = None, [], []
        for batch in batches:
            for t, i, b, n in zip(batch["tree"].to_pylist(), batch["vec_id"].to_pylist(), batch["v"], batch["dim"].to_pylist()):
                if ids and t != tree:
                    yield out(tree, ids, blobs)
                    ids, blobs = [], []
                tree = t
                ids.append(i)
                blobs.append((b.as_py(), n))
        if ids:
            yield out(tree, ids, blobs)
    return run


class Tree:
    """Pages of one tree, ready to search."""

    def __init__(self, rows: list[dict], dim: int):
        self.pages = rows
        self.children: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            r["center"] = np.frombuffer(r["center"])
            if r["parent"] >= 0:
                self.children.setdefault(r["parent"], []).append(i)
            if r["ids"] is not None:
                r["ids"] = np.frombuffer(r["ids"], dtype=np.int64)
                wide = len(r["vectors"]) > 4 * dim * len(r["ids"])
                r["vectors"] = np.frombuffer(r["vectors"], dtype="<f8" if wide else "<i4").reshape(len(r["ids"]), dim).astype(np.float64)
                r["most"] = float(np.sqrt((r["vectors"] ** 2).sum(axis=1).max(initial=0.0)))
                r["distances"] = np.frombuffer(r["distances"])
        self.inner = {p: (np.array(c), np.array([rows[i]["center"] for i in c]), np.array([rows[i]["radius"] for i in c]),
                          np.array([rows[i]["parent_distance"] for i in c])) for p, c in self.children.items()}

    def search(self, own: int, q: np.ndarray, k: int, longest: float, cut: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, -vec_id) of the tree for one query, its own id left out, of those that score ``cut`` or more.

        Score s and distance d belong together by d^2 = |q|^2 + longest - 2 s; a page is passed over only if its
        least possible distance exceeds that of the k-th best by more than rounding can explain.
        """
        full = np.append(q, 0.0)
        own_length = float(np.sqrt(q @ q))
        far = float(q @ q) + longest
        slack = 1e-6 * np.sqrt(far) + 1e-6
        best: list[tuple[int, int]] = []

        def reach() -> float:
            s = max(cut, best[0][0] if len(best) == k else -np.inf)
            return np.inf if s == -np.inf else np.sqrt(max(far - 2 * s, 0.0)) + slack

        if not self.pages:
            return []
        root = self.pages[0]
        d0 = float(np.linalg.norm(full - root["center"]))
        queue = [(max(d0 - root["radius"], 0.0), 0, d0)]
        while queue:
            least, page, d = heapq.heappop(queue)
            limit = reach()
            if least > limit:
                break
            p = self.pages[page]
            if p["ids"] is not None:
                near = np.abs(d - p["distances"]) <= limit
                near &= p["ids"] != own
                bound = own_length * p["most"]
                if bound < EXACT:
                    scores = p["vectors"][near] @ q
                elif bound < LONG:
                    scores = p["vectors"][near].astype(np.int64) @ q.astype(np.int64)
                else:
                    whole = [int(x) for x in q]
                    scores = np.array([sum(int(x) * y for x, y in zip(v, whole)) for v in p["vectors"][near]], dtype=object)
                ids = p["ids"][near]
                if len(best) == k:
                    hit = (scores >= best[0][0]).astype(bool)
                    scores, ids = scores[hit], ids[hit]
                if len(scores) > k:
                    top = np.lexsort((ids, -scores))[:k] if scores.dtype != object else sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k]
                    scores, ids = scores[top], ids[top]
                for s, i in zip(map(int, scores.tolist()), ids.tolist()):
                    if s >= cut:
                        (heapq.heappush if len(best) < k else heapq.heappushpop)(best, (s, -i))
            else:
                kids, centers, radii, parent = self.inner[page]
                able = np.abs(d - parent) - radii <= limit
                dist = np.sqrt(((centers[able] - full) ** 2).sum(axis=1))
                for c, x, r in zip(kids[able].tolist(), dist.tolist(), radii[able].tolist()):
                    if x - r <= limit:
                        heapq.heappush(queue, (max(x - r, 0.0), c, x))
        return best


def _query_blocks(block: int):
    """Rows (block, asked): queries (vec_id, v, dim), at most ``block`` of them in one binary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), block):
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, batch.schema) as w:
                    w.write_batch(batch.slice(at, block))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue()], pa.binary())], ["block", "asked"])
                number += 1
    return run


PAGE, QUERY = 0, 1


def _answers(dim: int, longest: float, k: int):
    """The k best of each tree for each query: a tree's pages come first, then the blocks of queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows, tree = None, [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["tree"] != place:
                    place, rows, tree = r["tree"], [], None
                if r["kind"] == PAGE:
                    rows.append(r)
                    continue
                tree = tree or Tree(rows, dim)
                asked = pa.ipc.open_stream(r["asked"]).read_all().to_pydict()
                found = [(i, -v, s) for i, q in zip(asked["vec_id"], _matrix(list(zip(asked["v"], asked["dim"])), dim)) for s, v in tree.search(i, q, k, longest, -np.inf)]
                cols = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])
    return run


def _nearest(seeds: np.ndarray, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(list(zip(batch["v"].to_pylist(), batch["dim"].to_pylist())), dim)
            cell = ((seeds ** 2).sum(axis=1)[None, :] - 2 * x @ seeds.T).argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], batch["dim"], pa.array(cell, pa.int64())], ["vec_id", "v", "dim", "cell"])
    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, cell: int = CELL,
          leaf: int = LEAF, fan: int = FAN, block: int = QUERIES, seeds: int = SEEDS) -> DataFrame:
    """The k largest integer inner products of every query row with all other rows, ties to the smaller id.

    is_query: a boolean column. Components are floor(scale * x). Returns (query_id, rank from 1, vec_id, score); fewer rows
    if there are fewer candidates. Rows whose vector is null, holds null or non-finite components, and rows without
    an id, take no part; a score of the result that no long holds is an error, as in SQL; shorter vectors are filled with zeros; a candidate
    with the query's own id is left out; a repeated row is a candidate of its own. Rows go to trees of at most about ``cell`` by nearest seed and,
    where many share a seed, by hash. Queries are a table of blocks of at most ``block``, which visits every tree; none pass the driver. An empty input
    gives no rows.
    """
    own = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("q"))
    ints = written(own.select("vec_id", "embedding").mapInArrow(_integers(scale), "vec_id long, v binary, norm double, dim int"), "mtree-integers")
    count, longest, dim = ints.agg(F.count("*"), F.max("norm"), F.max("dim")).first()
    dim, longest = dim or 0, longest or 0.0
    some = [tuple(r) for r in ints.where("dim > 0").orderBy(F.xxhash64("vec_id"), "vec_id").select("v", "dim").limit(seeds).collect()]
    centers = _matrix(some, dim) if some else np.zeros((1, dim))
    placed = written(ints.mapInArrow(_nearest(centers, dim), "vec_id long, v binary, dim int, cell long"), "mtree-cells")
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    splits = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for c, n in sizes.items() for x in (c, partitions_for(n, cell)))), F.col("cell")), F.lit(1)) if sizes else F.lit(1)
    trees = placed.withColumn("tree", F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("vec_id", "v"), splits))
    pages = trees.repartition(partitions_for(count, cell), "tree").sortWithinPartitions("tree").mapInArrow(
        _page_rows(dim, longest, leaf, fan), "tree long, page int, parent int, radius double, parent_distance double, center binary, ids binary, vectors binary, distances binary")
    pages = written(pages, "mtree-pages")
    asked = ints.join(own.where("q").select("vec_id").distinct(), "vec_id", "left_semi").dropDuplicates(["vec_id"])
    asked = written(asked.select("vec_id", "v", "dim").mapInArrow(_query_blocks(block), "block long, asked binary"), "mtree-queries")
    # The given query set against all rows: every block of queries goes to every tree.
    none = lambda frame, c: F.lit(None).cast(dict(frame.dtypes)[c]).alias(c)
    rest = [c for c in pages.columns if c not in ("tree", "page")]
    visits = pages.select("tree", F.lit(PAGE).alias("kind"), "page", *rest, none(asked, "block"), none(asked, "asked")).unionByName(
        pages.select("tree").distinct().crossJoin(asked).select("tree", F.lit(QUERY).alias("kind"), none(pages, "page"), *(none(pages, c) for c in rest), "block", "asked"))
    visits = visits.repartition(partitions_for(count, cell // 4), "tree").sortWithinPartitions("tree", "kind", "page", "block")
    out = visits.mapInArrow(_answers(dim, longest, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all others."""
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP9_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
