"""n-gram Jaccard join by T-occurrence search.

Sets are distinct 4-word shingles, as 64-bit hashes. Two sets of n and m shingles with Jaccard of at least t share
T = ceil(t / (1 + t) * (n + m)) of them. Steps:

1. Shingles are dealt to buckets by their hash, packed per task; a bucket keeps those that occur in two different sets.
   Equal sets are one class and count once.
2. A class can have a partner only if enough of its shingles are shared; the rest goes (exact, as T >= t * n).
3. Of two partners one's first n - ceil(t * n) + 1 shingles, rarest first, meets the other's; unshared shingles fill these
   places first. Classes that meet there form blocks: connected components, found by star contraction on ids.
4. Each block is searched: every class probes the inverted lists of its shared shingles by DivideSkip: the longest lists
   are set aside, the short ones are merged and classes with T minus their number of occurrences are kept, and only those are
   looked up in the long lists by binary search. Classes that are known to be connected are not searched again.
   A block of more than ``TILE`` classes is cut into tiles by size; only pairs of tiles whose sizes can reach t meet.
5. The links found span the components; smallest ids follow by star contraction.

Defined results: null texts and texts without words have an empty set and link with nothing; equal rows share every result;
rows of one id with different texts are one node; an empty table gives an empty result; further columns are carried along,
columns named like the results are replaced. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from specmill.llm import shared

SHINGLE, THRESHOLD = 4, Fraction(85, 100)
#: Classes of one search task; text bytes of one bucket; share of a set's lists that count as long.
TILE, BUCKET_BYTES, LONG = 4096, 16 << 20, 0.06
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, and n+1 places. ``raw`` holds the texts one after the other."""
    n_docs = len(offsets) - 1
    low = _LOWER[raw]
    inside = ~_SPACE[low]
    starts_ = inside.copy()
    starts_[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts_[first] = inside[first]  # a word never reaches over the border of two texts
    begin = np.flatnonzero(starts_)
    stops = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])) + 1 if len(raw) else begin
    border = np.zeros(len(raw) + 1, bool)
    border[offsets] = True
    cut = np.flatnonzero(inside[:-1] & inside[1:] & border[1:-1]) + 1 if len(raw) > 1 else begin[:0]
    end = np.sort(np.concatenate([stops, cut]))
    word = shared.Spans(low).of(begin, end)
    ahead = np.searchsorted(begin, offsets)
    count = np.diff(ahead)
    doc = np.repeat(np.arange(n_docs), count)
    at = np.cumsum(count) - count
    weights = shared.powers(0xC2B2AE3D27D4EB4F | 1, k + 1)[1:]
    full = np.zeros(len(word), np.uint64)
    rank = np.arange(len(word)) - at[doc] if len(word) else at[:0]
    whole = rank <= count[doc] - k if len(word) else np.zeros(0, bool)
    short = (count[doc] < k) & (rank == 0) if len(word) else whole
    padded = np.concatenate([word, np.zeros(k, np.uint64)])
    left = count[doc] - rank if len(word) else at[:0]
    for j in range(k):
        full += np.where(j < left, padded[j:j + len(word)] * weights[j], np.uint64(0))
    size = np.minimum(left, k).astype(np.uint64)
    value = shared.mixed(full + size)
    take = whole | short
    value, owner = value[take], doc[take]
    order = np.argsort(value)
    order = order[np.argsort(owner[order].astype(np.uint16 if n_docs < 1 << 16 else np.int64), kind="stable")]
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_docs))]).astype(np.int64)


def _sums(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return total[places[1:]] - total[places[:-1]]


def signatures(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, the same for equal sets whatever their order."""
    return shared.mixed(_sums(shared.mixed(values ^ np.uint64(0x5851F42D4C957F2D)), places) + np.diff(places).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _columns(batch: pa.RecordBatch, text: str):
    raw, offsets = shared.text_bytes(batch.column(batch.schema.get_field_index(text)))
    values, places = shingle_sets(raw, offsets)
    return values, places, np.diff(places), signatures(values, places)


def sized(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, n (set size), sig per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.by_bytes(batches, 1):
            _, _, n, sig = _columns(b, "text")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(shared.signed(sig))], names=["id", "n", "sig"])
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, sig long")


def dealt(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """Shingles by bucket, packed: names of sets, their sizes and counts, their shingles. One row per Arrow batch and bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.by_bytes(batches, 0):
            values, places, n, sig = _columns(b, "text")
            _, first = np.unique(sig, return_index=True)  # equal sets of a batch once
            keep = np.zeros(len(sig), bool)
            keep[first] = True
            owner = np.repeat(np.arange(len(sig)), n)
            use = keep[owner]
            values, owner = values[use], owner[use]
            bucket = ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")  # owners stay ascending
            values, owner, bucket = values[order], owner[order], bucket[order]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            out = {"bucket": [], "sigs": [], "sizes": [], "counts": [], "values": []}
            for s, e in zip(edge, [*edge[1:], len(bucket)], strict=True):
                own = owner[s:e]
                at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                out["bucket"].append(int(bucket[s]))
                out["sigs"].append(sig[own[at]].tobytes())
                out["sizes"].append(n[own[at]].astype(np.uint32).tobytes())
                out["counts"].append(np.diff(np.append(at, e - s)).astype(np.uint32).tobytes())
                # the bucket is given by the leading bits: the trailing 6 bytes tell shingles of one bucket apart
                out["values"].append(values[s:e].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=schema)
    schema = pa.schema([("bucket", pa.int64()), ("sigs", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("values", pa.binary())])
    return docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, sigs binary, sizes binary, counts binary, values binary")


def shared_shingles(rows: DataFrame, ranges: int) -> DataFrame:
    """Shingles that several sets have, packed by bucket and range of set names: names, sizes, how many shared shingles of the
    bucket each has, the shingles, and in how many sets each is. One row per bucket and range, whatever the sets."""
    def run(t: pa.Table) -> pa.Table:
        sigs, sizes, counts = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()]) for c, kind in (("sigs", np.uint64), ("sizes", np.uint32), ("counts", np.uint32)))
        six = np.frombuffer(b"".join(t.column("values").to_pylist()), np.uint8).reshape(-1, 6)
        values = np.zeros((len(six), 8), np.uint8)
        values[:, :6] = six
        values = values.view("<u8").ravel() | (np.uint64(t.column("bucket")[0].as_py() & 0xFFFF) << np.uint64(48))
        names, first, which = np.unique(sigs, return_index=True, return_inverse=True)
        sizes = sizes[first]
        owner = np.repeat(which, counts)
        order = np.argsort(values)
        twice = values[order][1:] == values[order][:-1]
        order = order[np.concatenate([[False], twice]) | np.concatenate([twice, [False]])] if len(order) else order
        values, owner = values[order], owner[order]
        order = np.lexsort((owner, values))
        values, owner = values[order], owner[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[new], owner[new]
        first = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        df = np.bincount(group)[group] if len(group) else group
        use = df > 1
        values, owner, df = values[use], owner[use], df[use]
        order = np.argsort(owner, kind="stable")  # names are sorted, so owners of a range lie together
        values, owner, df = values[order], owner[order], df[order].astype(np.uint32)
        at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
        held = np.diff(np.append(at, len(owner))).astype(np.uint32)
        own = owner[at] if len(owner) else at
        part = _range(names[own], ranges)
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else at
        ends, places = [*edge[1:], len(part)], np.append(at, len(owner))
        cut = [(s, e, places[s], places[e]) for s, e in zip(edge, ends, strict=True)] if len(edge) else []
        return pa.table({"part": pa.array(part[edge], pa.int64()), "sigs": pa.array([names[own[s:e]].tobytes() for s, e, _, _ in cut], pa.binary()),
                         "sizes": pa.array([sizes[own[s:e]].tobytes() for s, e, _, _ in cut], pa.binary()), "held": pa.array([held[s:e].tobytes() for s, e, _, _ in cut], pa.binary()),
                         "tokens": pa.array([values[x:y].tobytes() for _, _, x, y in cut], pa.binary()), "dfs": pa.array([df[x:y].tobytes() for _, _, x, y in cut], pa.binary())})
    return rows.groupBy("bucket").applyInArrow(run, "part long, sigs binary, sizes binary, held binary, tokens binary, dfs binary")


def _range(names: np.ndarray, ranges: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def able_sets(found: DataFrame, threshold: Fraction) -> DataFrame:
    """sig, tokens, dfs of the sets of which enough is shared for a partner."""
    def run(t: pa.Table) -> pa.Table:
        sigs, sizes, held, tokens, dfs = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()])
                                          for c, kind in (("sigs", np.uint64), ("sizes", np.uint32), ("held", np.uint32), ("tokens", np.uint64), ("dfs", np.uint32)))
        names, first, which = np.unique(sigs, return_index=True, return_inverse=True)
        total = np.bincount(which, weights=held, minlength=len(names)).astype(np.int64)
        enough = total * threshold.denominator >= sizes[first].astype(np.int64) * threshold.numerator
        owner = np.repeat(which, held)
        use = enough[owner]
        owner, tokens, dfs = owner[use], tokens[use], dfs[use]
        order = np.lexsort((tokens, owner))
        tokens, dfs = tokens[order], dfs[order]
        ends = np.cumsum(total[enough])
        cut = list(zip([0, *ends[:-1]], ends, strict=True)) if len(ends) else []
        return pa.table({"sig": pa.array(shared.signed(names[enough])), "tokens": pa.array([tokens[s:e].tobytes() for s, e in cut], pa.binary()),
                         "dfs": pa.array([dfs[s:e].tobytes() for s, e in cut], pa.binary())})
    return found.groupBy("part").applyInArrow(run, "sig long, tokens binary, dfs binary")


def prefixes(classes: DataFrame, threshold: Fraction) -> DataFrame:
    """id, token: shingles of a class at which it can meet a partner. ``classes``: id, n, tokens, dfs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for ident, n, tokens, dfs in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                t, d = np.frombuffer(tokens, np.uint64), np.frombuffer(dfs, np.uint32)
                places = n - _ceil(threshold * n) + 1 - (n - len(t))
                if places > 0:
                    out.append(t[np.lexsort((t, d))[:places]])
                    ids.append(np.full(len(out[-1]), ident, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64)), pa.array(shared.signed(np.concatenate(out)) if out else np.zeros(0, np.int64))], names=["id", "token"])
    return classes.select("id", "n", "tokens", "dfs").mapInArrow(run, "id long, token long")


def _ceil(x: Fraction) -> int:
    return -(-x.numerator // x.denominator)


class Forest:
    """Union-find over the classes of a task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def t_occurrence(sets: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, threshold: Fraction) -> list[tuple[int, int]]:
    """Links that span the components among ``sets`` (sorted shared shingles; ``sizes`` count the unshared ones too).

    ``side`` is 0 or 1; if both occur, only pairs of different sides are searched. A set probes those before it in the order
    of sizes, so partners have at most its size and at least t times it.
    """
    order = np.argsort(sizes, kind="stable")
    flat = np.concatenate([sets[i] for i in order]) if len(order) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(order)), [len(sets[i]) for i in order])
    tokens, token = np.unique(flat, return_inverse=True)
    by_token = np.argsort(token, kind="stable")  # owners stay ascending within a list
    lists, heads = owner[by_token], np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(tokens)))])
    places = np.concatenate([[0], np.cumsum([len(sets[i]) for i in order])])
    n, both = sizes[order], len(np.unique(side)) > 1
    side = side[order]
    forest, links = Forest(len(order)), []
    p, q = threshold.numerator, threshold.denominator
    for i in range(len(order)):
        own = token[places[i]:places[i + 1]]
        lowest = np.searchsorted(n, -(-p * int(n[i]) // q))  # partners from here on are large enough
        if lowest >= i or not len(own):
            continue
        need_least = -(-p * int(n[i] + n[lowest]) // (p + q))
        length = heads[own + 1] - heads[own]
        rank = np.argsort(-length, kind="stable")
        long_ = min(int(LONG * len(own)) + max(0, need_least // 2), need_least - 1)
        far, near = own[rank[:long_]], own[rank[long_:]]
        found = _gathered(lists, heads, near)
        found = found[(found >= lowest) & (found < i)]
        if both:
            found = found[side[found] != side[i]]
        if not len(found):
            continue
        hits = np.bincount(found - lowest, minlength=i - lowest)
        need = -((-p * (n[i] + n[lowest:i])) // (p + q))
        for c in np.flatnonzero(hits >= need - len(far))[::-1]:
            j = int(c) + int(lowest)
            if hits[c] == 0 or forest.root(i) == forest.root(j):
                continue
            have = int(hits[c])
            for at, f in enumerate(far):  # binary search in the long lists
                if have >= need[c] or have + len(far) - at < need[c]:
                    break
                s, e = heads[f], heads[f + 1]
                k = s + np.searchsorted(lists[s:e], j)
                have += bool(k < e and lists[k] == j)
            if have >= need[c]:
                forest.join(i, j)
                links.append((int(order[i]), int(order[j])))
    return links


def _gathered(lists: np.ndarray, heads: np.ndarray, which: np.ndarray) -> np.ndarray:
    size = heads[which + 1] - heads[which]
    ends = np.cumsum(size)
    return lists[np.arange(ends[-1]) + np.repeat(heads[which] - (ends - size), size)] if len(which) else lists[:0]


def _search(threshold: Fraction):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(t, np.uint64) for t in rows["tokens"]]
        two = rows["side"].nunique() > 1
        side = rows["side"].to_numpy() if two else np.zeros(len(rows), np.int64)
        ids = rows["id"].to_numpy()
        links = t_occurrence(sets, rows["n"].to_numpy(np.int64), side, threshold)
        return pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, dtype=np.int64)
    return run


def _tiled(members: DataFrame, threshold: Fraction) -> DataFrame:
    """Task keys (block, x, y) with side 0 or 1: one task for a block of a tile, else pairs of tiles that can link.

    Tiles are runs of classes by size; tile x meets y >= x only while the smallest set of y may link with the largest of x.
    """
    counts = members.groupBy("block").agg(F.count("*").alias("classes"))
    small = members.join(counts.where(F.col("classes") <= TILE).select("block"), "block", "left_semi")
    small = small.select("id", "n", "tokens", "block", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"))
    large = members.join(counts.where(F.col("classes") > TILE).select("block"), "block", "left_semi")
    place = large.select("block", "id", F.floor((F.row_number().over(W.partitionBy("block").orderBy("n", "id")) - 1) / (TILE // 2)).cast("int").alias("tile"), "n")
    tiles = place.groupBy("block", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    one, two = tiles.alias("p"), tiles.alias("q")
    able = (F.col("p.block") == F.col("q.block")) & (F.col("p.tile") <= F.col("q.tile")) & (F.col("q.low") * threshold.numerator <= F.col("p.high") * threshold.denominator)
    met = one.join(two, able).select(F.col("p.block").alias("block"), F.col("p.tile").alias("x"), F.col("q.tile").alias("y"))
    sides = met.select("block", "x", "y", F.col("x").alias("tile"), F.lit(0).alias("side")).union(met.where("x < y").select("block", "x", "y", F.col("y").alias("tile"), F.lit(1).alias("side")))
    big = large.join(place.select("id", "tile"), "id").join(sides, ["block", "tile"]).select("id", "n", "tokens", "block", "x", "y", "side")
    return small.union(big)


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id."""
    spark = docs.sparkSession
    folder = shared.shared_folder(spark)
    sizes = shared.written(sized(docs, doc_id, text), folder, "sizes")
    classes = shared.written(sizes.where("n > 0 and id is not null").groupBy("sig").agg(F.min("id").alias("id"), F.first("n").alias("n")), folder, "classes")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(16, -(-total // BUCKET_BYTES))
    found = able_sets(shared_shingles(dealt(docs, text, buckets), buckets), threshold)
    able = shared.written(found.join(classes, "sig").select("id", "n", "tokens", "dfs"), folder, "able")
    meet = shared.written(prefixes(able, threshold), folder, "prefixes")
    hub = meet.groupBy("token").agg(F.min("id").alias("hub"))
    blocks = shared.components(meet.join(hub, "token").select(F.col("id").alias("a"), F.col("hub").alias("b")), f"{folder}/blocks")
    inner = blocks.select("node", F.col("component").alias("block")).union(blocks.select(F.col("component"), F.col("component")).distinct())
    members = able.join(inner.withColumnRenamed("node", "id"), "id").select("id", "n", "tokens", "block")
    tasks = _tiled(shared.written(members, folder, "members"), threshold)
    links = tasks.groupBy("block", "x", "y").applyInPandas(_search(threshold), "a long, b long")
    same = sizes.where("n > 0 and id is not null").join(classes.select("sig", F.col("id").alias("b")), "sig").select(F.col("id").alias("a"), "b")
    parts = shared.components(shared.written(links, folder, "links").union(same), f"{folder}/parts")
    rows = sizes.join(parts.withColumnRenamed("node", "id"), "id", "left")
    return rows.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
