"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph (each vector with its nearest by inner product) is cut into balanced partitions by
recursive bisection: a spectral order of the graph's vertices is halved and improved by swaps that cut fewer edges. A small
softmax classifier learns vector -> partition. Every vector of the table is indexed under its most probable partition; a
query goes to its most probable ones, as many as the sample needed for the wanted recall, and is ranked exactly there. Where
these hold too few different ids, it takes further ones in the same order until they can give every neighbour asked for.

Partitions are searched in blocks (``BLOCK`` candidates against ``QUERIES`` queries), so a hot partition or a vector that
repeats is many tasks, and each block returns its best per query only.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite numbers take no part;
a vec_id that repeats counts once per query with its best score; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

#: Bounds of the fitted sample and of the number of partitions; the index itself holds every row.
SAMPLE, PARTITIONS, MEAN_SIZE = 6000, 128, 2000
NEIGHBOURS, WANTED_RECALL, BLOCK, QUERIES = 16, 0.97, 4096, 2048


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, v (array of double) of all rows that take part."""
    v = F.col(embedding).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return rows.where(F.exists("v", lambda x: x != 0) & ~F.exists("v", bad))


# -- fitting, on the sample ------------------------------------------------------------------------------------------

def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest inner products of each row with the others, in blocks."""
    out = np.zeros((len(x), k), np.int64)
    for s in range(0, len(x), 1024):
        scores = x[s:s + 1024] @ x.T
        scores[np.arange(len(scores)), np.arange(s, s + len(scores))] = -np.inf
        out[s:s + 1024] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def balanced_partitions(graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A partition per vertex; sizes differ by the rounding of the halvings only (``parts`` is a power of two)."""
    n, k = graph.shape
    label = np.zeros(n, np.int64)
    source, target = np.repeat(np.arange(n), k), graph.ravel()
    rng = np.random.default_rng(seed)
    for level in range(parts.bit_length() - 1):
        new = label * 2
        same = label[source] == label[target]
        a, b = np.concatenate([source[same], target[same]]), np.concatenate([target[same], source[same]])
        degree = np.bincount(a, minlength=n) + 1.0
        f = rng.standard_normal(n)
        for _ in range(60):  # lazy random walk, centred within each part: the second eigenvector of each part's graph
            f = 0.5 * f + 0.5 * np.bincount(a, weights=f[b], minlength=n) / degree
            mass = np.bincount(label, weights=degree, minlength=1 << level)
            f -= (np.bincount(label, weights=f * degree, minlength=1 << level) / np.maximum(mass, 1e-9))[label]
            f /= np.sqrt(np.bincount(label, weights=f * f, minlength=1 << level) + 1e-12)[label]
        order = np.lexsort((f, label))
        rank = np.empty(n, np.int64)
        sizes = np.bincount(label, minlength=1 << level)
        rank[order] = np.arange(n) - (np.cumsum(sizes) - sizes)[label[order]]
        side = (rank >= (sizes[label] + 1) // 2).astype(np.int64)
        for _ in range(6):  # swap the vertices that gain most by changing sides, as many from either side
            toward = np.bincount(a, weights=side[b] != side[a], minlength=n) - np.bincount(a, weights=side[b] == side[a], minlength=n)
            for p in range(1 << level):
                own = np.flatnonzero((label == p) & (toward > 0))
                left, right = own[side[own] == 0], own[side[own] == 1]
                m = min(len(left), len(right)) // 2
                if m:
                    side[left[np.argsort(-toward[left])[:m]]] = 1
                    side[right[np.argsort(-toward[right])[:m]]] = 0
        label = new + side
    return label


def fit_router(x: np.ndarray, label: np.ndarray, parts: int, steps: int = 300, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by full-batch gradient steps with momentum."""
    scale = 1.0 / max(np.sqrt((x * x).sum(1).mean()), 1e-12)
    z, w, c = x * scale, np.zeros((x.shape[1], parts)), np.zeros(parts)
    goal = np.eye(parts)[label]
    mw, mc = np.zeros_like(w), np.zeros_like(c)
    for _ in range(steps):
        s = z @ w + c
        p = np.exp(s - s.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - goal) / len(z)
        mw, mc = 0.9 * mw + z.T @ g + 1e-5 * w, 0.9 * mc + g.sum(0)
        w, c = w - rate * 10 * mw, c - rate * mc
    return w * scale, c


def probes_needed(x: np.ndarray, home: np.ndarray, w: np.ndarray, c: np.ndarray, k: int, wanted: float, density: float) -> int:
    """Fewest partitions per query that hold ``wanted`` of the true neighbours of the sample's rows."""
    near = neighbour_graph(x, min(max(k, int(k * density)), len(x) - 1))
    order = np.argsort(-(x @ w + c), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape).copy(), 1)
    depth = np.take_along_axis(place, home[near], 1)
    share = np.cumsum(np.bincount(depth.ravel(), minlength=order.shape[1])) / depth.size
    return int(np.searchsorted(share, wanted) + 1)


class Router:
    """What the tasks need: dimension, weights, and how many partitions a query probes."""

    def __init__(self, sample: np.ndarray, rows: int, k: int):
        parts = 1 << max(0, int(np.log2(max(1, min(PARTITIONS, rows / MEAN_SIZE, len(sample) / 32)))))
        self.dim, self.parts, self.probes = sample.shape[1], parts, 1
        self.w, self.c = np.zeros((self.dim, parts)), np.zeros(parts)
        if parts > 1:
            label = balanced_partitions(neighbour_graph(sample, min(NEIGHBOURS, len(sample) - 1)), parts)
            half = np.arange(len(sample)) % 2 == 0  # probes are chosen on the half that was not fitted
            self.w, self.c = fit_router(sample[half], label[half], parts)
            home = np.argmax(sample @ self.w + self.c, axis=1)
            self.probes = min(parts, probes_needed(sample[~half], home[~half], self.w, self.c, k, WANTED_RECALL, 1.0))

    def routes(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(x @ self.w + self.c), axis=1, kind="stable")[:, :n]

    def wide_routes(self, x: np.ndarray, held: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """Partitions in order, and how many of them each row takes: ``probes``, more while they hold too few ids (``held``)."""
        order = self.routes(x, self.parts)
        short = (np.cumsum(held[order], axis=1) < enough).sum(1)
        return order, np.minimum(np.maximum(short + 1, self.probes), self.parts)


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), np.float64)


# -- search ----------------------------------------------------------------------------------------------------------

def search(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for every usable row that fulfils the condition ``is_query`` on ``id``."""
    rows = usable(vectors, vec_id, embedding)
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], schema)
    dim, total = dims[0]
    rows = rows.where(F.size("v") == dim)
    taken = rows.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(SAMPLE).collect()  # SAMPLE rows at most
    router = Router(np.array([r[0] for r in taken]), total, k)

    def routed(n: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    to = router.routes(_matrix(b["v"]), n)
                    yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), n), "v": b["v"].repeat(n).to_numpy(), "part": to.ravel().astype(np.int32)})
        return run

    cells = rows.mapInPandas(routed(1), "id long, v array<double>, part int")
    # different ids of each partition; an id with several vectors may lie in several, so an id counts at its least partition only
    own = cells.groupBy("id").agg(F.min("part").alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    held = np.zeros(router.parts, np.int64)
    for r in own.collect():  # PARTITIONS rows at most
        held[r["part"]] = r["n"]

    def asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                order, n = router.wide_routes(_matrix(b["v"]), held, k + 1)
                to = order[np.arange(router.parts) < n[:, None]]
                yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), n), "v": b["v"].repeat(n).to_numpy(), "part": to.astype(np.int32)})

    asked = rows.where(is_query).mapInPandas(asking, "id long, v array<double>, part int")
    sizes = {r["part"]: r["n"] for r in cells.groupBy("part").agg(F.count("*").alias("n")).collect()}  # PARTITIONS rows at most
    loads = {r["part"]: r["n"] for r in asked.groupBy("part").agg(F.count("*").alias("n")).collect()}
    blocks = spark.createDataFrame([(p, max(1, -(-n // BLOCK)), max(1, -(-loads.get(p, 0) // QUERIES))) for p, n in sizes.items()], "part int, cb int, qb int")
    blocks = F.broadcast(blocks)  # PARTITIONS rows at most
    of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(blocks, "part").select("part", of("qb").alias("qi"), each("cb").alias("ci"), "id", "v")
    right = cells.join(blocks, "part").select("part", each("qb").alias("qi"), of("cb").alias("ci"), "id", "v")

    def rank(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        q = q.drop_duplicates("id") if len(q) else q
        out = []
        if len(q) and len(c):
            ids, x = c["id"].to_numpy(), _matrix(c["v"])
            for s in range(0, len(q), 256):
                block = q.iloc[s:s + 256]
                scores = _matrix(block["v"]) @ x.T
                scores[block["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
                for i, ident in enumerate(block["id"].to_numpy()):
                    order = np.lexsort((ids, -scores[i])) if len(ids) <= 4 * k else _best(scores[i], ids, k)
                    order = order[np.isfinite(scores[i][order])]
                    _, first = np.unique(ids[order], return_index=True)  # a repeated id counts once
                    order = order[np.sort(first)][:k]
                    exact = (x[order] * _matrix(block["v"].iloc[[i]])).sum(1) if len(order) else np.zeros(0)
                    out.append(pd.DataFrame({"query_id": ident, "vec_id": ids[order], "score": exact}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    keys = ["part", "qi", "ci"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of all scores at least as large as the k-th of different ids needs, best first, ties by id."""
    m = 4 * k
    while True:
        cut = np.partition(scores, len(scores) - m)[len(scores) - m] if m < len(scores) else -np.inf
        at = np.flatnonzero(scores >= cut)
        if m >= len(scores) or len(np.unique(ids[at])) >= k:
            return at[np.lexsort((ids[at], -scores[at]))]
        m *= 4


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
