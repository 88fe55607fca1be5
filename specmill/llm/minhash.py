"""MinHash near-dedup by fast similarity sketching.

1. Equal shingle sets are one class, named by their smallest document. A class is sketched in rounds: each round throws every shingle into a
   hashed bin with a hashed value, the smallest value of a bin's first round stays; from round ``COORDINATES`` on, round i fills
   bin i - ``COORDINATES`` with all shingles, so that every coordinate fills and is concentrated about the similarity.
2. Bands of ``ROWS`` coordinates are hashed. Classes of one band key meet its smallest class only (a star), and these pairs
   are verified on full sets. The links found name components.
3. Where the classes of a band key lie in different components, the rest must meet too: they form blocks (connected by shared
   keys), and a block's classes that share a key but no component are verified on full sets. Blocks that are too large for
   a task are cut into tiles by size; members of a block's largest component need not meet one another, so that a crowd of
   copies of one text costs only its star.
4. Links and equal sets give components; smallest ids follow by star contraction.

At the threshold a link shares none of the ``BANDS`` bands with a chance of (1 - 0.85**4)**32, some 6e-11; nothing else is left to chance
but the 64 bits of a shingle's hash, and nothing is capped.

Defined results: null texts and texts without words have an empty set and link with nothing; equal rows share every result;
rows of one id with different texts are one node; rows without doc_id are linked with nothing and kept; an empty table gives an
empty result; only ``doc_id`` and ``text`` are read, other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from specmill.llm import shared
from specmill.llm.jaccard_join import Forest, shingle_sets

SHINGLE, PERCENT = 3, 85
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Classes and shingles of a tile; a step between size classes, at which partners are in the same or in neighbouring ones.
TILE, TILE_SHINGLES, STEP = 4096, 2_000_000, 1.18
#: Rows of one band key that go to a task together.
SALTS = 64


def sketches(values: np.ndarray, places: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """One row of ``t`` coordinates per set; ``values`` holds the sets one after the other. Empty sets have no meaning here."""
    count = len(places) - 1
    out = np.full(count * t, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(count), np.diff(places))
    empty = np.ones(count * t, bool)
    open_ = np.diff(places) > 0
    rounds = 0
    while rounds < 2 * t and len(owner):
        hashed = shared.mixed(values ^ shared.mixed(np.array([rounds + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0])
        if rounds < t:
            cell = owner * t + ((hashed >> np.uint64(40)) % np.uint64(t)).astype(np.int64)
        else:
            cell = owner * t + (rounds - t)
        free = empty[cell]
        cell, hashed = cell[free], hashed[free]
        np.minimum.at(out, cell, hashed)
        empty[cell] = False
        rounds += 1
        still = empty.reshape(count, t).any(axis=1) & open_
        if rounds < t or rounds % 8 == 0:
            keep = still[owner]
            if not keep.all():
                values, owner = values[keep], owner[keep]
    return out.reshape(count, t)


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """A key per set and band."""
    weights = shared.powers(0xC2B2AE3D27D4EB4F | 1, ROWS + 1)[1:]
    each = (coordinates.reshape(-1, BANDS, ROWS) * weights).sum(axis=2, dtype=np.uint64)
    return shared.mixed(each + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _names(values: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shared.mixed(values ^ np.uint64(seed)), dtype=np.uint64)])
    return shared.mixed(total[places[1:]] - total[places[:-1]] + np.diff(places).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sets(batch: pa.RecordBatch):
    raw, offsets = shared.text_bytes(batch.column(1))
    values, places = shingle_sets(raw, offsets, SHINGLE)
    return values, places, [_names(values, places, seed) for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]


def sketched(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, n (set size), name and proof (128 bits that name the set), keys (one per band, none of an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.by_bytes(batches, 1, 2 << 20):
            values, places, (name, proof) = _sets(b)
            n = np.diff(places)
            keys = band_keys(sketches(values, places))
            ends = np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(shared.signed(keys[n > 0].ravel())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(shared.signed(name)), pa.array(shared.signed(proof)), keys], names=["id", "n", "name", "proof", "keys"])
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, name long, proof long, keys array<long>")


def full_sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """id, name, shingles of the classes in ``wanted`` (id, name), each once.

    Texts go where their ids go at every size: Spark's choice to send the ids to all tasks would hold for small tables only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.by_bytes(batches, 1, 2 << 20):
            values, places, (name, _) = _sets(b)
            sets = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(shared.signed(values)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.signed(name)), sets], names=["id", "name", "shingles"])
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    made = rows.join(wanted.select("id").distinct().hint("merge"), "id", "left_semi").mapInArrow(run, "id long, name long, shingles array<long>")
    return made.join(wanted.select("id", "name"), ["id", "name"], "left_semi").groupBy("id", "name").agg(F.first("shingles").alias("shingles"))


def meetings(classes: DataFrame) -> DataFrame:
    """name and hub (the smallest name) of every band key that several classes share.

    Rows of a key are dealt to ``SALTS`` tasks, and the hub goes to those that hold some.
    """
    rows = classes.select("name", F.explode("keys").alias("key")).withColumn("salt", F.pmod("name", F.lit(SALTS)))
    each = rows.groupBy("key", "salt").agg(F.min("name").alias("least"), F.max("name").alias("most"))
    top = each.groupBy("key").agg(F.min("least").alias("hub"), F.max("most").alias("most")).where("hub < most").select("key", "hub")
    hubs = each.select("key", "salt").join(top, "key")
    return rows.join(hubs, ["key", "salt"]).select("name", "hub").distinct()


def similar(met: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b (ids) of the pairs (name, hub) that are similar on full sets."""
    left = sets.select(F.col("name"), F.col("id").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("name").alias("hub"), F.col("id").alias("b"), F.col("shingles").alias("t"))
    both = met.where("name <> hub").join(left, "name").join(right, "hub")
    x, y, shares = F.size("s"), F.size("t"), F.size(F.array_intersect("s", "t"))
    return both.where((100 * F.least(x, y) >= PERCENT * F.greatest(x, y)) & (100 * shares >= PERCENT * (x + y - shares))).select("a", "b")


def tiled(members: DataFrame) -> DataFrame:
    """Tasks (block, x, y) with side 0 or 1. ``members``: id, name, n, keys, shingles, block, label, main (of the largest component)."""
    size = F.floor(F.log("n") / float(np.log(STEP))).cast("int")
    members = members.withColumn("s", size)
    blocks = members.groupBy("block").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
    large = blocks.where((F.col("c") > TILE) | (F.col("m") > TILE_SHINGLES)).select("block", F.lit(True).alias("large"))
    marked = members.join(large, "block", "left")
    small = marked.where("large is null").select("block", F.lit("all").alias("x"), F.lit("all").alias("y"), F.lit(0).alias("side"), "id", "n", "keys", "shingles", "label")
    big = marked.where("large")
    runs = big.groupBy("block", "main", "s").agg(F.greatest(F.ceil(F.count("*") / (TILE / 2)), F.ceil(F.sum("n") / (TILE_SHINGLES / 2))).cast("int").alias("k"))
    tiles = runs.select("block", "main", "s", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("t")).withColumn("tile", F.concat_ws(".", F.col("main").cast("int"), "s", "t"))
    one, two = tiles.alias("p"), tiles.alias("q")
    able = (F.col("p.block") == F.col("q.block")) & (F.abs(F.col("p.s") - F.col("q.s")) <= 1) & (F.col("p.tile") <= F.col("q.tile")) & ~(F.col("p.main") & F.col("q.main"))
    met = one.join(two, able).select(F.col("p.block").alias("block"), F.col("p.tile").alias("x"), F.col("q.tile").alias("y"))
    sides = met.select("block", "x", "y", F.col("x").alias("tile"), F.lit(0).alias("side")).union(met.where("x < y").select("block", "x", "y", F.col("y").alias("tile"), F.lit(1).alias("side")))
    placed = big.join(runs, ["block", "main", "s"]).withColumn("tile", F.concat_ws(".", F.col("main").cast("int"), "s", F.pmod(F.xxhash64("id", "name"), F.col("k"))))
    return small.union(placed.join(sides, ["block", "tile"]).select("block", "x", "y", "side", "id", "n", "keys", "shingles", "label"))


def links_of_task(rows: pd.DataFrame) -> pd.DataFrame:
    """Spanning links (a, b) among classes that share a band key but no component, verified on full sets."""
    rows = rows.sort_values(["n", "id"], kind="stable").reset_index(drop=True)
    count = len(rows)
    ids, n, side = rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rows["side"].to_numpy()
    two = len(np.unique(side)) > 1
    forest, links = Forest(count), []
    first: dict[int, int] = {}
    for i, label in enumerate(rows["label"].tolist()):
        forest.join(i, first.setdefault(label, i))
    flat = np.concatenate(rows["shingles"].tolist()) if count else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    words, flat = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(words), bool)
    keys = np.stack(rows["keys"].tolist())
    order = np.argsort(keys, axis=0, kind="stable")  # within a key, by size
    again = [np.take_along_axis(keys, order, 0)[:, band] for band in range(keys.shape[1])]
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(count)[:, None], order.shape), 0)
    heads = [np.searchsorted(a, a, side="left") for a in again]
    root = np.array([forest.root(i) for i in range(count)])
    for i in range(count):
        low = np.searchsorted(n, -(-PERCENT * int(n[i]) // 100))
        met = [order[heads[band][place[i, band]]:place[i, band], band] for band in range(len(heads))]
        met = np.unique(np.concatenate(met))
        met = met[(met >= low) & (root[met] != root[i])]
        if two:
            met = met[side[met] != side[i]]
        if not len(met):
            continue
        own = flat[ends[i]:ends[i + 1]]
        mark[own] = True
        size = n[met]
        stops = np.cumsum(size)
        shares = np.add.reduceat(mark[flat[np.arange(stops[-1]) + np.repeat(ends[met] - (stops - size), size)]].astype(np.int64), stops - size)
        mark[own] = False
        for j in met[100 * shares >= PERCENT * (size + n[i] - shares)].tolist():
            if root[j] != root[i]:
                links.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id."""
    folder = shared.shared_folder(docs.sparkSession)
    rows = shared.written(sketched(docs, doc_id, text), folder, "rows")
    some = rows.where("n > 0 and id is not null")
    classes = some.groupBy("name", "proof").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = shared.written(classes, folder, "classes")
    met = shared.written(meetings(classes), folder, "met")
    names = met.select("name").union(met.select("hub")).distinct()
    wanted = shared.written(classes.join(names, "name"), folder, "wanted")
    sets = shared.written(full_sets(docs, doc_id, text, wanted), folder, "sets")
    stars = shared.written(similar(met, sets).distinct(), folder, "stars")
    known = shared.components(stars, f"{folder}/known")
    known = known.select(F.col("node").alias("id"), F.col("component").alias("label"))
    blocks = shared.components(met.select(F.col("name").alias("a"), F.col("hub").alias("b")), f"{folder}/blocks")
    blocks = blocks.select(F.col("node").alias("name"), F.col("component").alias("block")).union(blocks.select("component", "component").distinct())
    members = wanted.select("id", "name").join(blocks, "name").join(known, "id", "left").select("id", "name", "block", F.coalesce("label", "id").alias("label"))
    members = shared.written(members, folder, "members")
    counts = members.groupBy("block", "label").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("block").agg(F.max_by("label", "c").alias("most"), F.count("*").alias("labels")).where("labels > 1").select("block", "most")
    open_ = members.join(mixed, "block").select("id", "name", "block", "label", (F.col("label") == F.col("most")).alias("main"))
    open_ = open_.join(wanted.select("id", "name", "n", "keys"), ["id", "name"]).join(sets, ["id", "name"])
    tasks = tiled(shared.written(open_, folder, "open"))
    more = tasks.groupBy("block", "x", "y").applyInPandas(links_of_task, "a long, b long")
    same = some.join(classes.select("name", "proof", F.col("id").alias("b")), ["name", "proof"]).where("id <> b").select(F.col("id").alias("a"), "b")
    parts = shared.components(stars.union(shared.written(more, folder, "more")).union(same), f"{folder}/parts")
    out = rows.join(parts.withColumnRenamed("node", "id"), "id", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
