"""Conversation trie, MinHash near copies and spelling variants against brute force and their SQL."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from specmill.llm import conversation_trie, minhash, spelling

from test_text_operators import LOWER, prose, variants

TURNS = "conv_id long, turn long, role string, text string, key string, head long"


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            order = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), order, (role, text)))
    own = {c: [x[2] for x in sorted(s)] for c, s in own.items()}
    whole = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + s[h:]
    nodes = {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        kids = [q for q in nodes if len(q) == len(p) + 1 and q[:len(p)] == p]
        leaf = [q for q in below if not any(r[:len(q)] == q and len(r) == len(q) + 1 for r in below)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(p))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [200_000, 5])
def test_conversation_trie(spark, monkeypatch, shard):
    monkeypatch.setattr(conversation_trie, "SHARD_TURNS", shard)
    monkeypatch.setattr(conversation_trie, "CHUNK", 3)
    r = np.random.default_rng(1)
    rows = []
    for c in range(60):
        for t in range(int(r.integers(1, 12))):
            rows.append((c, t, str(r.choice(["user", "assistant"])), str(r.choice(["a", "é🙂", "long " * 50]))))
    rows += [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(3)]  # copies and a hot first turn
    rows += [(200, t, "user", "x") for t in range(400)] + [(205, None, None, None), (205, None, "user", None), (205, 1, "", "z"), (205, 1, "", "y"), (205, 1, "", "y")]
    rows += [(7, 3, "user", "a"), (None, 1, "user", "nobody"), (211, 0, "user", "q" * 100_000)]
    table = spark.createDataFrame([(*x, "k", 5) for x in rows], TURNS).repartition(5)
    got = {tuple(x) for x in conversation_trie.trie(table).collect()}
    assert got == brute_trie(rows)
    assert conversation_trie.trie(table.limit(0)).count() == 0
    assert conversation_trie.trie(table.where("conv_id is null")).count() == 0


def test_medians_make_a_low_tree():
    order = list(conversation_trie._medians(1000))
    assert sorted(order) == list(range(1000))
    tree = conversation_trie.Tree()
    for i in order:
        tree.insert([i], [1], i, 1, False)

    def height(n):
        return 1 + max((height(x) for x in (tree.lo[n], tree.hi[n]) if x), default=0)
    assert height(tree.eq[0]) <= 10


def brute_classes(rows, k=3):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, s in enumerate(sets):
        for b, t in enumerate(sets[:a]):
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = root(rows[a][0]), root(rows[b][0])
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for (i, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("tile", [4096, 6])
def test_minhash(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    texts = [None, "", " \n", "one", "ONE", "one two", "one two three", "one two three four", *variants(1, prose(1, 120), 60), *variants(2, prose(2, 60), 30),
             *variants(4, prose(4, 20), 20), prose(3, 4000), prose(3, 4000) + " end", "é È", "é è", "a " * 50, "a " * 60]
    rows = list(enumerate(texts)) + [(9, texts[9]), (9, texts[70]), (9, "alone here now and then")]
    d = spark.createDataFrame([(*x, 1, "k") for x in rows] + [(None, texts[9], 1, "k")], "doc_id long, text string, n long, keys string").repartition(3)
    found = minhash.components(d).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in found if r.id is not None) == brute_classes(rows)
    nobody = [r for r in found if r.id is None]
    assert len(nobody) == 1 and nobody[0].component_id is None
    assert tile < 4096 or minhash.components(d.limit(0)).count() == 0


def test_sketches_fill_and_follow_similarity():
    r = np.random.default_rng(3)
    base = r.integers(1, 2**62, 400).astype(np.uint64)
    sets = [np.unique(base[:n]) for n in (1, 2, 50, 400)] + [np.unique(np.concatenate([base[:340], r.integers(1, 2**62, 60).astype(np.uint64)]))]
    places = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = minhash.sketches(np.concatenate(sets), places, 512)
    assert got.shape == (5, 512) and (got < np.iinfo(np.uint64).max).all()
    assert abs((got[3] == got[4]).mean() - 340 / 460) < 0.08 and abs((got[2] == got[3]).mean() - 50 / 400) < 0.08
    alone = minhash.sketches(sets[2], np.array([0, len(sets[2])]), 512)
    assert (alone[0] == got[2]).all()  # whatever else is in the batch


def brute_words(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def one(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    near = {w: [v for v in words if one(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) if v else None for w, v in near.items()}
    form = {w: b if b and words[b] >= 2 * words[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w
    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def test_spelling_variants(spark):
    r = np.random.default_rng(5)
    stems = ["".join(r.choice(list("abcdeéß"), r.integers(4, 8))) for _ in range(25)]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = stems[int(r.integers(0, 25)) if i % 3 else int(r.integers(0, 3))]
            if r.random() < 0.3:
                at = int(r.integers(0, len(w)))
                w = w[:at] + str(r.choice(["", "x", "é", w[at] * 2])) + w[at + 1:]
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, " ".join(words)))
    rows += [(None, None), (500, ""), (None, "hello hello hello"), (501, "hallo-hallo_hallo1hallo"), (501, "hallo-hallo_hallo1hallo"), (502, "z" * 100_000 + " " + "z" * 99_999), (502, "z" * 100_000), (503, "z" * 100_000 + " " + "z" * 99_999 + " " + "z" * 99_999)]
    table = spark.createDataFrame([(*x, "w", 1) for x in rows], "doc_id long, text string, word string, n long").repartition(4)
    got = {tuple(x) for x in spelling.variants(table).collect()}
    want = brute_words(rows)
    assert got == want and any(x[1] for x in want) and any(x[1] and x[2] != x[1] for x in want)
    assert spelling.variants(table.limit(0)).count() == 0


@pytest.mark.parametrize("module,table", [(spelling, "documents"), (conversation_trie, "conversations")])
def test_sql(spark, module, table):
    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = module.query(spark, folder)
    listed = sorted(df.columns)
    want = c.execute(f"SELECT {', '.join(listed)} FROM ({module.SQL})").fetchall()
    assert want and Counter(map(tuple, df.select(*[F.col(x) for x in listed]).collect())) == Counter(want)
