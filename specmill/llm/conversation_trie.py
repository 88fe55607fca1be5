"""Conversation prefix trie by ternary search trees over dictionary-encoded turns.

1. Every distinct (role, text) gets an id from a written dictionary; texts do not move after that, only their ids and sizes.
2. Conversations are rebuilt as id sequences; equal sequences become one row with their smallest conversation and their number.
   The digests of members that end together are hashed in one sorted pass, in pieces, so that no group is held in memory.
3. Distinct sequences are dealt to range shards. A shard inserts them into a ternary search tree, medians first, so that
   the search among siblings is balanced; an iterative traversal sums members, leaves and savings.
4. Only nodes on a shard's first and last sequence can lie in several shards. They are merged by prefix: two sequences per
   shard. All other nodes are final but for the name of a parent on such a path.

Defined results: turns are ordered by turn (null first), equal turns by the hash of role and text; repeated rows count as often as
they occur; rows without conv_id belong to no conversation; an empty table has no nodes; only ``conv_id``, ``turn``, ``role`` and
``text`` are read, other columns do not matter. One conversation must fit in a row, as ids; nothing else is bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from specmill.llm import shared

#: Turns of a shard; conversations of a run that borrow the first one's start; the start's length is below ``STARTS``.
SHARD_TURNS, FAMILY, STARTS = 200_000, 5, 9
#: Members whose digest text is one row.
CHUNK = 16384
_EMPTY = hashlib.sha256().hexdigest()
_NODE = "key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, head long, final boolean"


def encoded(conversations: DataFrame, folder: str) -> DataFrame:
    """conv_id, turns: array of (id, size) in order. Ids are places in a written dictionary of distinct turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    rows = shared.written(rows, folder, "digests")
    words = shared.written(rows.groupBy("digest").agg(F.first("size").alias("size")), folder, "distinct_turns")
    words = shared.written(words.select("digest", F.monotonically_increasing_id().alias("id")), folder, "dictionary")
    turns = rows.join(words, "digest").select("conv_id", F.struct("turn", "digest", "id", "size").alias("t"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"))).alias("turns"))


def rebuilt(sequences: DataFrame) -> DataFrame:
    """conv_id, turns, key: each conversation with the start of its family's first one in place of its own start."""
    starts = sequences.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, STARTS - 1).alias("start"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % STARTS).cast("int")
    own = sequences.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"), h.alias("h"))
    none = F.array().cast("array<struct<id:bigint,size:bigint>>")
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    turns = F.concat(F.slice(F.coalesce("start", none), F.lit(1), F.col("h")), rest)
    made = own.join(starts, "first", "left").select("conv_id", turns.alias("turns"))
    return made.withColumn("key", F.unhex(F.sha2(F.array_join(F.transform("turns", lambda x: x["id"].cast("string")), ",").cast("binary"), 256)))


def ends(members: DataFrame) -> DataFrame:
    """key, ends_sha256 of the sorted members of a sequence: packed by range, then hashed piece by piece."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            out, s = [], 0
            for e in range(1, len(keys) + 1):
                if e == len(keys) or keys[e] != keys[s] or e - s == CHUNK:
                    out.append((keys[s], ids[s], ",".join(map(str, ids[s:e]))))
                    s = e
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["key", "lowest", "part"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = None
        for b in batches:
            keys, out = [], []
            for key, part in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key == now:
                    state.update(b"," + part.encode())
                    continue
                if now is not None:
                    keys.append(now)
                    out.append(state.hexdigest())
                now, state = key, hashlib.sha256(part.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], names=["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    parts = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(packed, "key binary, lowest long, part string")
    return parts.repartition("key").sortWithinPartitions("key", "lowest").mapInArrow(hashed, "key binary, ends_sha256 string")


class Tree:
    """A ternary search tree over turn ids: ``lo`` and ``hi`` lead to siblings, ``eq`` to the next turn. Node 0 is the root."""

    def __init__(self):
        self.value, self.lo, self.eq, self.hi, self.size, self.up = [-1], [0], [0], [0], [0], [-1]
        self.members, self.least, self.head, self.border = [0], [None], [None], [False]

    def _node(self, value: int, size: int, up: int) -> int:
        for column, x in zip((self.value, self.lo, self.eq, self.hi, self.size, self.up, self.members, self.least, self.head, self.border), (value, 0, 0, 0, size, up, 0, None, None, False), strict=True):
            column.append(x)
        return len(self.value) - 1

    def insert(self, ids: list[int], sizes: list[int], head: int, count: int, border: bool) -> None:
        value, lo, eq, hi = self.value, self.lo, self.eq, self.hi
        at = 0
        self._count(0, head, count, border)
        for x, size in zip(ids, sizes, strict=True):
            up, n = at, eq[at]
            if not n:
                n = eq[at] = self._node(x, size, up)
            while value[n] != x:
                side = lo if x < value[n] else hi
                if not side[n]:
                    side[n] = self._node(x, size, up)
                n = side[n]
            at = n
            self._count(at, head, count, border)
        self.head[at] = head

    def _count(self, n: int, head: int, count: int, border: bool) -> None:
        self.members[n] += count
        if self.least[n] is None or head < self.least[n]:
            self.least[n] = head
        self.border[n] = self.border[n] or border

    def rows(self) -> pd.DataFrame:
        """All nodes; those on a border hold only what their inner children give, and their own part is added after merging."""
        total = len(self.value)
        depth, keys, order, stack = [0] * total, {}, [], [0]
        while stack:  # before its children, each node once
            n = stack.pop()
            order.append(n)
            if self.border[n]:
                keys[n] = hashlib.sha256(keys[self.up[n]] + self.value[n].to_bytes(8, "big", signed=True)).digest() if n else bytes(32)
            below = [self.eq[n]] if self.eq[n] else []
            while below:
                c = below.pop()
                depth[c] = depth[n] + 1
                stack.append(c)
                below += [x for x in (self.lo[c], self.hi[c]) if x]
        children, leaves, saved = [0] * total, [0] * total, [0] * total
        for n in reversed(order):  # after its children
            if self.border[n]:
                continue
            leaves[n] += not children[n]
            saved[n] += (self.members[n] - 1) * self.size[n]
            up = self.up[n]
            children[up] += 1
            leaves[up] += leaves[n]
            saved[up] += saved[n]
        inner = [not b for b in self.border]
        up = self.up
        known = [n > 0 and not self.border[up[n]] for n in range(total)]
        return pd.DataFrame({
            "key": [keys.get(n) for n in range(total)], "parent_key": [keys.get(up[n]) for n in range(total)], "depth": depth, "conv_id": self.least,
            "parent_conv_id": pd.array([self.least[up[n]] if known[n] else None for n in range(total)], "Int64"), "n_convs": self.members, "n_children": children,
            "n_leaves": leaves, "saved_tokens": saved, "size": self.size, "head": pd.array(self.head, "Int64"), "final": inner})


def _medians(n: int) -> Iterator[int]:
    """0 to n-1, each range's median before its halves."""
    stack = [(0, n)]
    while stack:
        s, e = stack.pop()
        if s < e:
            m = (s + e) // 2
            yield m
            stack += [(s, m), (m + 1, e)]


def shards(sequences: DataFrame, count: int) -> DataFrame:
    """Nodes of each range shard. ``sequences``: turns, head, n, distinct by turns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, heads, ns = [], [], [], []
        for b in batches:
            for turns in b.column(0):
                flat = turns.values
                ids.append(flat.field(0).to_pylist())
                sizes.append(flat.field(1).to_pylist())
            heads += b.column(1).to_pylist()
            ns += b.column(2).to_pylist()
        if not ids:
            return
        tree, last = Tree(), len(ids) - 1
        for i in _medians(len(ids)):
            tree.insert(ids[i], sizes[i], heads[i], ns[i], i in (0, last))
        yield from pa.Table.from_pandas(tree.rows(), schema=schema, preserve_index=False).to_batches(max_chunksize=20000)

    schema = pa.schema([(n, {"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in _NODE.split(", "))])
    return sequences.repartitionByRange(count, "turns").sortWithinPartitions("turns").mapInArrow(run, _NODE)


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes on the shards' borders: parts of a prefix are added, then sums go up from the deepest node."""
    rows = rows.groupby("key", sort=False).agg({"parent_key": "first", "depth": "first", "conv_id": "min", "n_convs": "sum", "n_children": "sum", "n_leaves": "sum", "saved_tokens": "sum", "size": "first", "head": "first"}).reset_index()
    place = {k: i for i, k in enumerate(rows["key"])}
    up = np.array([place.get(k, -1) for k in rows["parent_key"]], np.int64)
    children, leaves, saved = (rows[c].to_numpy(np.int64).copy() for c in ("n_children", "n_leaves", "saved_tokens"))
    own = (rows["n_convs"].to_numpy(np.int64) - 1) * rows["size"].to_numpy(np.int64)
    for n in np.argsort(-rows["depth"].to_numpy(np.int64), kind="stable").tolist():
        leaves[n] += not children[n]
        saved[n] += own[n]
        if up[n] >= 0:
            children[up[n]] += 1
            leaves[up[n]] += leaves[n]
            saved[up[n]] += saved[n]
    ids = rows["conv_id"].to_numpy(np.int64)
    parents = pd.array([ids[u] if u >= 0 else None for u in up.tolist()], "Int64")
    return rows.assign(n_children=children, n_leaves=leaves, saved_tokens=saved, parent_conv_id=parents, head=rows["head"].astype("Int64"))[[x.split()[0] for x in _MERGED.split(", ")]]


_MERGED = "key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, head long"


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    folder = shared.shared_folder(conversations.sparkSession)
    whole = shared.written(rebuilt(shared.written(encoded(conversations, folder), folder, "sequences")), folder, "rebuilt")
    heads = whole.groupBy("key").agg(F.min("conv_id").alias("head"), F.count("*").alias("n"))
    heads = shared.written(heads, folder, "heads")
    alone = whole.select("conv_id", "turns").join(heads.select("head", "n"), F.col("conv_id") == F.col("head")).select("turns", "head", "n")
    alone = shared.written(alone, folder, "distinct")
    turns = alone.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    nodes = shared.written(shards(alone, max(1, -(-turns // SHARD_TURNS))), folder, "nodes")
    border = nodes.where("not final").select(F.lit(0).alias("all"), "key", "parent_key", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size", "head")
    border = shared.written(border.groupBy("all").applyInPandas(_merged, _MERGED), folder, "border")
    inner = nodes.where("final")
    held = inner.where("parent_key is null")
    hung = inner.where("parent_key is not null").drop("parent_conv_id").join(border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key")
    kept = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "head"]
    every = border.select(kept).union(held.select(kept)).union(hung.select(kept))
    digests = ends(whole).join(heads.select("key", "head"), "key").select("head", "ends_sha256")
    return every.join(digests, "head", "left").select(*kept[:-1], F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: A node is named by its depth and smallest member; sums run over the paths of the smallest members.
SQL = r"""
WITH crc AS MATERIALIZED (
  SELECT list(list_reduce(range(8)::BIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i::BIGINT) ORDER BY i) AS t
  FROM range(256) AS r(i)),
own AS MATERIALIZED (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hs AS (
  SELECT c, s, (xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: unicode(x)::BIGINT), lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 9)::INT AS h
  FROM own, crc),
whole AS MATERIALIZED (
  SELECT hs.c, list_concat(coalesce(own.s, [])[1:hs.h], hs.s[hs.h + 1:]) AS s FROM hs LEFT JOIN own ON own.c = hs.c - hs.c % 5),
steps AS MATERIALIZED (SELECT c, d, len(s) AS n, s[1:d] AS p, CASE WHEN d > 0 THEN strlen(s[d].t) ELSE 0 END AS b FROM whole, unnest(range(0, len(s) + 1)) AS u(d)),
nodes AS MATERIALIZED (
  SELECT d, p, min(c) AS m, count(*) AS k, any_value(b) AS b, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS e
  FROM steps GROUP BY d, p),
paths AS MATERIALIZED (SELECT c, steps.d, m FROM steps JOIN nodes ON steps.d = nodes.d AND steps.p = nodes.p),
kids AS (SELECT p.d, p.m, count(*) AS n FROM nodes x JOIN paths p ON p.c = x.m AND p.d = x.d - 1 GROUP BY ALL),
full_ AS MATERIALIZED (SELECT nodes.*, coalesce(kids.n, 0) AS kid FROM nodes LEFT JOIN kids USING (d, m)),
sums AS (
  SELECT p.d, p.m, sum(CASE WHEN x.kid = 0 THEN 1 ELSE 0 END) AS leaves, sum((x.k - 1) * x.b) AS saved
  FROM full_ x JOIN paths p ON p.c = x.m AND p.d <= x.d GROUP BY ALL)
SELECT f.m AS conv_id, f.d::BIGINT AS depth, p.m AS parent_conv_id, f.k::BIGINT AS n_convs, f.kid::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, f.e AS ends_sha256
FROM full_ f JOIN sums s USING (d, m) LEFT JOIN paths p ON p.c = f.m AND p.d = f.d - 1
"""
