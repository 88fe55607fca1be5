"""WARC, URL filter, toxicity and nearest neighbours: round trips, rules, held-out accuracy, recall against brute force."""

import base64
import hashlib

import numpy as np
from pyspark.sql import functions as F

from specmill.llm import ann, shared, toxicity, url_filter, warc


def test_warc_round_trip(spark):
    long_ = "é🙂\r\n\r\nWARC/1.1\r\n" * 60000
    rows = [(1, "http://a/\r\nx", "b"), (2, None, None), (3, "", ""), (4, "u", long_), (5, "u", "b"), (6, "u", long_), (5, "u", "b"), (None, "n", "b"), (None, "n", "solo")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    folder = shared.shared_folder(spark)
    warc.write_monolithic(pages, f"{folder}/m")
    index = warc.normalise(spark, f"{folder}/m", f"{folder}/a")
    got = warc.read_indexed(index, f"{folder}/a").collect()
    want, first = [], {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, _, h in rows:
        p, f = (h or "").encode(), first.get(h or "")
        revisit = f is not None and f != i
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", f if revisit else None, b"" if revisit else p))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    one = warc.read_indexed(index.where("record_id = '<urn:page:4>'"), f"{folder}/a").collect()
    assert len(one) == 1 and bytes(one[0].payload) == long_.encode()
    warc.write_monolithic(pages.limit(0), f"{folder}/m0")
    assert warc.read_indexed(warc.normalise(spark, f"{folder}/m0", f"{folder}/a0"), f"{folder}/a0").count() == 0


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/1", "http://www.example.com/en/1", "http://a.www.example.com/en/", "http://example.com", "http://notexample.com/en/x", "x://a.net/es/?q", "x://a.net/ES/",
            "ftp://com/", "http://b.org?x/y", "http://casino-win.example.org/en/1", "http://www.city-library.example.org/en/1", "http://É.com/é", "a://b://c.net/fr/" + "x" * 20000, "http://free-casino.com/"]
    rows = url_filter.annotate(spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")).orderBy("page_id").collect()
    got = [(r.host, r.path[:9], r.rule, r.verdict) for r in rows]
    assert got[:3] == [("", "", None, "allow")] * 3
    assert got[3] == ("example.com", "/en/1", "example.com/en/", "block") and got[4][2:] == got[5][2:] == ("www.example.com/en/", "allow")
    assert got[6][:3] == ("example.com", "", None) and got[7][2] == "com/" and got[8][:3] == ("a.net", "/es/", "net/es/") and got[9][2] is None
    assert got[10][2:] == ("com/", "allow") and got[11][:3] == ("b.org", "", None) and got[12][3] == "block" and got[13][3] == "allow"
    assert got[14][:3] == ("É.com", "/é", "com/") and got[15][2] is None and got[16][2:] == ("com/", "allow")


def test_toxicity_held_out(spark):
    r = np.random.default_rng(5)
    syllables = ["ta", "lo", "mi", "sen", "kor", "ba", "nu", "fel", "dra", "vi"]
    word = lambda: "".join(r.choice(syllables, r.integers(1, 4)))
    insults = ["grumblewit", "zogface", "quibhead"]
    texts, marks = [], []
    for i in range(900):
        w = [word() for _ in range(40)]
        if toxic := i % 4 == 0:
            w[int(r.integers(0, 40))] = str(r.choice(insults))
        texts.append((i, " ".join(w), int(toxic)))
        marks.append(int(toxic))
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxicity int")
    scorer = toxicity.fit(docs, docs.select("doc_id", F.col("toxicity").alias("toxic")).where("doc_id < 600"))
    rows = toxicity.score(docs.where("doc_id >= 600"), scorer).collect()
    assert np.mean([(x.toxicity >= 0.5) == bool(marks[x.doc_id]) for x in rows]) > 0.97
    odd = [(1, None), (2, ""), (3, "talo mi sen"), (4, "talo grumble-wit mi"), (5, "talo z o g f a c e mi"), (6, "mi " * 30000 + "zogfface"), (6, "mi " * 30000 + "zogfface"), (7, "x" * 100000)]
    got = [x.toxicity for x in toxicity.score(spark.createDataFrame(odd, "doc_id long, text string"), scorer).orderBy("doc_id").collect()]
    assert [g >= 0.5 for g in got] == [False, False, False, True, True, True, True, False] and all(0 <= g <= 1 for g in got)
    assert toxicity.fit(docs, docs.select("doc_id", F.lit(0).alias("toxic"))) is None
    assert toxicity.score(docs.limit(0), scorer).count() == 0


def test_toxicity_words_of_clean_texts_too(spark):
    r = np.random.default_rng(6)
    syllables = ["ta", "lo", "mi", "sen", "kor", "ba", "nu", "fel", "dra", "vi"]
    texts = []
    for i in range(1500):  # 10 % toxic by one word, which stands in 10 of the 1350 clean texts as well
        w = ["".join(r.choice(syllables, r.integers(1, 4))) for _ in range(30)]
        if i % 10 == 0 or i % 150 == 1:
            w[int(r.integers(0, 30))] = "grumblewit"
        texts.append((i, " ".join(w), int(i % 10 == 0)))
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, docs.select("doc_id", "toxic"))).collect()
    assert np.mean([x.toxicity >= 0.5 for x in rows if x.toxic]) > 0.95
    assert np.mean([x.toxicity >= 0.5 for x in rows if not x.toxic]) < 0.03


def brute_nearest(rows, k):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.setdefault(i, []).append(np.array(v, float))
    out = {}
    for i in usable:
        if i % 20 == 0:
            best = sorted(((-max(float(a @ b) for a in usable[i] for b in own), j) for j, own in usable.items() if j != i))[:k]
            out[i] = [j for _, j in best]
    return out


def test_ann_small(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(8).tolist(), 1) for i in range(300)] + [(400, None, 1), (420, [0.0] * 8, 1), (440, [float("nan")] * 8, 1), (460, [None] * 8, 1), (480, [1.0] * 8, 1), (None, [1.0] * 8, 1)]
    rows += [(500 + i, [2.0] * 8, 1) for i in range(60)] + [(7, rows[7][1], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for x in ann.search(table, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    want = brute_nearest([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v, _ in rows], 20)
    assert got == want
    assert ann.search(table.limit(0), F.lit(True)).count() == 0
    assert ann.search(table.where("vec_id = 0"), F.lit(True)).count() == 0


def test_ann_recall_with_partitions(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((12, 16)) * 2
    x = (centres[r.integers(0, 12, 16000)] + r.standard_normal((16000, 16))).astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hit = 0
    rows = ann.search(table, F.col("id") % 200 == 0).collect()
    for q in range(0, 16000, 200):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & {o.vec_id for o in rows if o.query_id == q})
    assert hit / (80 * 20) >= 0.9


def test_ann_small_partitions(spark, monkeypatch):
    class Uneven(ann.Router):  # the partitions of all queries but one hold few rows
        def __init__(self, sample, rows, k):
            self.dim, self.parts, self.probes = 4, 4, 1
            self.w, self.c = np.eye(4), np.zeros(4)
    monkeypatch.setattr(ann, "Router", Uneven)
    r = np.random.default_rng(7)
    x = r.random((400, 4)) * 0.1
    x[:, 0] += 1
    for i, axis in ((20, 1), (21, 1), (40, 2), (60, 3)):
        x[i, axis] += 2
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(21, x[21].tolist())] * 30, "vec_id long, embedding array<double>")
    rows = ann.search(table, F.col("id").isin(20, 40, 60, 80)).collect()
    for q in (20, 40, 60, 80):
        assert sorted(o.rank for o in rows if o.query_id == q) == list(range(1, 21))
        assert len({o.vec_id for o in rows if o.query_id == q} - {q}) == 20
    few = ann.search(table.where("vec_id in (20, 21, 40, 60, 80)"), F.col("id") == 40).collect()
    assert {o.vec_id for o in few} == {20, 21, 60, 80}


def test_balanced_partitions():
    r = np.random.default_rng(4)
    x = r.standard_normal((1000, 8))
    sizes = np.bincount(ann.balanced_partitions(ann.neighbour_graph(x, 8), 8))
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 8
