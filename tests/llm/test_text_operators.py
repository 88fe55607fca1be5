"""Operators on whole texts against brute force, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from specmill.llm import decontaminate, jaccard_join, license_scan, packing, secret_scan, suffix_dedup, url_filter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, {extra} string"


def docs_of(spark, texts, extra="lang"):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS.format(extra=extra))


def prose(seed, n, vocabulary=400):
    r = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in r.integers(0, vocabulary, n))


# -- decontamination ----------------------------------------------------------------------------------------------------

def brute_hits(texts, items):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = {}
    for ident, t in items:
        w = words(t)
        k = min(len(w), 13)
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault((k, tuple(w[i:i + k])), set()).add(str(ident))
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for k in {k for k, _ in windows}:
            for i in range(len(w) - k + 1):
                if own := windows.get((k, tuple(w[i:i + k]))):
                    hit |= set(range(i, i + k))
                    ids |= own
        out.append((len(w), len(hit), sorted(ids)))
    return out


def test_decontaminate(spark):
    items = [(1, prose(1, 40)), (2, prose(2, 13)), (3, "Short item É"), (4, ""), (5, None), (6, prose(1, 40)), (7, "a a a a a a a a a a a a a a a a a")]
    long_ = f"{prose(9, 3000)} {prose(1, 40)} {prose(8, 3000)}"
    texts = [None, "", prose(1, 40), " ".join(prose(1, 40).split()[5:17]), " ".join(prose(1, 40).split()[5:18]), f"x {prose(2, 13).upper()} y", "ein short item É da",
             "short item é", long_, "a " * 300, prose(3, 50), prose(1, 20) + " z " + prose(2, 13), prose(1, 40)]
    d = decontaminate.annotate(docs_of(spark, texts, "decon"), spark.createDataFrame(items, "item_id long, text string"))
    assert d.columns == ["doc_id", "text", "decon"]
    got = [(r.n_words, r.n_hit, list(r["items"])) for r in d.orderBy("doc_id").select("decon.*").collect()]
    assert got == brute_hits(texts, items)
    none = decontaminate.annotate(docs_of(spark, texts), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("decon.n_hit > 0").count() == 0 and none.count() == len(texts)
    assert decontaminate.annotate(docs_of(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontaminate_repeated_rows(spark):
    d = spark.createDataFrame([(1, prose(1, 40))] * 3 + [(1, "other text")], "doc_id long, text string")
    got = decontaminate.annotate(d, spark.createDataFrame([(1, prose(1, 40))], "item_id long, text string")).select("decon.n_hit").collect()
    assert sorted(r[0] for r in got) == [0, 40, 40, 40]


# -- licences -----------------------------------------------------------------------------------------------------------

def test_license_scan(spark):
    texts = [None, "", "All Rights Reserved. all rights, reserved", "the GNU General Public License, version 3", "CC BY-NC 4.0 and cc-by", "mit license" + " filler" * 5000,
             "general public", "rights reserved all", "cc cc by by", "all rights reserved" * 2, "all rights reserved"]
    phrases = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
    rows = license_scan.annotate(docs_of(spark, texts, "licences")).orderBy("doc_id").select("licences.*").collect()
    for t, r in zip(texts, rows, strict=True):
        w = WORD.findall((t or "").translate(LOWER))
        at = [(i, label) for label, p in phrases.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert list(r.base_labels) == sorted({label for _, label in at}) and set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert "mit" in rows[5].labels and "gnu-gpl-3" in rows[3].labels
    assert license_scan.annotate(docs_of(spark, [])).count() == 0


# -- secrets ------------------------------------------------------------------------------------------------------------

def brute_base(t):
    kinds = [("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    return sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(kinds) for m in re.finditer(p, t or "") if len(m[g]) >= n)


def test_licence_labels_hang_on_the_key_alone(spark):
    texts = ["permission is hereby granted free of charge to somebody", "cc0", "apache license, some other version", "general public", "cc by"]
    rows = license_scan.annotate(docs_of(spark, texts, "other")).orderBy("doc_id").select("licences.*").collect()
    assert [r.labels for r in rows] == [["mit-grant"], ["cc0"], ["apache-2.0"], [], ["cc-by"]]
    assert all(0 <= r.score <= 1 for r in rows) and rows[0].score < 1 and rows[4].score == 1


@pytest.mark.parametrize("operator", ["suffix_dedup", "license_scan", "secret_scan", "decontaminate", "url_filter"])
def test_no_column_of_the_input_clashes(spark, operator):
    names = ["k", "_k", "_n", "_p", "_tf", "_x", "_runs", "_hits", "_text", "_cover", "_host", "n_base", "anchor", "pos", "word", "left", "spans_", "in0_", "DOC"]
    rows = [(i, t, *[f"{c} {i}" for c in names]) for i, t in enumerate([None, "", "all rights reserved password=abcdefgh https://a.b/c", "x" * 300])]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    run = {"suffix_dedup": suffix_dedup.annotate, "license_scan": license_scan.annotate, "secret_scan": secret_scan.annotate,
           "decontaminate": lambda d: decontaminate.annotate(d, spark.createDataFrame([("i", "all rights reserved")], "item_id string, text string")),
           "url_filter": lambda d: url_filter.annotate(d, "text")}[operator]
    got = run(df)
    assert got.columns[:len(df.columns)] == df.columns and len(got.columns) > len(df.columns)
    assert sorted(map(tuple, got.select(df.columns).collect())) == rows


def test_secret_scan(spark):
    key, hexes = "AKIA" + "Q7" * 8, "0123456789abcdef" * 2
    texts = [None, "", f"é🙂 password={hexes} x", f"{key} {key}", "secret=token:abcdefgh", "API_KEY : 'abc.def=' token=short", "x" * 50000 + f" passwd='{hexes}'",
             f"login: admin01 then Ab3dEf6hIj9lMn2pQr5tUv8x", "Ab3dEf6hIj9lMn2pQr5tUv8x alone", f"{hexes}" * 3, f"password={hexes} x", "PassWord=ABCDEF" + "g" * 10]
    rows = secret_scan.annotate(docs_of(spark, texts, "secrets")).orderBy("doc_id").collect()
    for t, r in zip(texts, rows, strict=True):
        assert [(s["start"], s["order"] - 1, s["end"]) for s in r.secrets if s["order"] <= 3] == brute_base(t)
    assert {s["kind"] for s in rows[7].secrets} == {"ident", "weak"} and not rows[8].secrets
    assert secret_scan.annotate(docs_of(spark, [])).count() == 0
    clean = secret_scan.annotate(docs_of(spark, texts)).select("doc_id", secret_scan.redacted(F.col("text"), F.col("secrets")).alias("t")).orderBy("doc_id").collect()
    assert clean[0].t is None and clean[2].t == "é🙂 [assign] x" and clean[3].t == "[access] [access]" and hexes not in clean[6].t and clean[8].t == texts[8]


def test_secret_scan_repeated_rows(spark):
    d = spark.createDataFrame([(1, "token=abcdef0 token=abcdef1")] * 2, "doc_id long, text string")
    assert [len(r.secrets) for r in secret_scan.annotate(d).collect()] == [2, 2]


# -- packing ------------------------------------------------------------------------------------------------------------

def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = [None, "", "Hello  World\n\nÉté\x1cx y", prose(1, 6000), "<|endoftext|> a", "it's don't", prose(2, 900), prose(2, 900), "é ́x", "ΑΣ ς\tq\r\nz"]
    rows = packing.packed(docs_of(spark, texts, "piece"), with_ids=True).collect()
    for i, t in enumerate(texts):
        want = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == want and all(r.length == len(r.ids) for r in own)
        assert [r.start for r in own] == list(range(0, len(want), 2048))
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    check_places(rows)
    assert packing.packed(docs_of(spark, [])).count() == 0


def check_places(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_bins(lengths):
    b = packing.Bins(np.array(lengths, np.int64), 20)
    b.best_fit()
    first = sum(f * f for f in b.fill)
    b.search()
    number, offset = b.places()
    assert sum(f * f for f in b.fill) >= first
    for k in set(number.tolist()):
        own = sorted((int(offset[i]), lengths[i]) for i in np.flatnonzero(number == k))
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 20


@pytest.mark.parametrize("low,high", [(300, 900), (500, 900), (1, 900)])
def test_bins_search_empties_bins(low, high):
    sizes = np.random.default_rng(1).integers(low, high + 1, 1500)
    b = packing.Bins(sizes, 2048)
    b.best_fit()
    before = len(b.bins)
    b.search()
    after = sum(1 for own in b.bins if own)
    assert after <= before and (low == 1 or after < before) and not b._round()
    assert sorted(i for own in b.bins for i in own) == list(range(1500)) and all(sum(int(sizes[i]) for i in own) == f <= 2048 for own, f in zip(b.bins, b.fill, strict=True))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bins_against_optimum(lengths):
    def least(todo, free):  # the fewest bins, by trying every bin for every piece
        if not todo:
            return len(free)
        n, rest = todo[0], todo[1:]
        return min([least(rest, [*free[:k], f - n, *free[k + 1:]]) for k, f in enumerate(free) if f >= n] + [least(rest, [*free, 20 - n])])
    b = packing.Bins(np.array(lengths, np.int64), 20)
    b.best_fit()
    b.search()
    best = least(sorted(lengths, reverse=True), [])
    assert best <= sum(1 for own in b.bins if own) <= best + 1


# -- suffix dedup -------------------------------------------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80))
def test_suffix_array(values):
    t = np.array([*values, 0], np.int32)
    b = bytes(t.tolist())
    assert suffix_dedup.suffix_array(t, 258).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def brute_dedup(texts):
    seen, out = {}, []
    for d, t in enumerate(texts):
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - 99):
            if b[s:s + 100] in seen:
                gone[s:s + 100] = [True] * 100
            seen.setdefault(b[s:s + 100], (d, s))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone], strict=False)), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark):
    p, q = prose(1, 120), prose(2, 300, 3)
    texts = [None, "", "short", p, p, f"abc {p[50:400]} xyz", "a" * 500, "b" + "a" * 300, q, q[::-1], "é🙂" * 200, f"{p[:150]}{p[:150]}", p[:99], p[:100], p[1:101], prose(3, 8000) + p, f"{prose(4, 50)} {q[300:700]} {prose(5, 50)}"]
    d = suffix_dedup.annotate(docs_of(spark, texts, "spans")).orderBy("doc_id")
    rows = d.collect()
    assert d.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute_dedup(texts)
    assert suffix_dedup.annotate(docs_of(spark, [])).count() == 0
    twice = spark.createDataFrame([(1, p), (1, p), (2, p), (None, p)], "doc_id long, text string")
    assert sorted((r.doc_id or 9, r.n_removed) for r in suffix_dedup.annotate(twice).collect()) == [(1, 0), (1, 0), (2, len(p)), (9, len(p))]


@pytest.mark.parametrize("hot", [20, 5])
def test_suffix_dedup_hot_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    p, q = prose(1, 120), prose(2, 300, 3)
    texts = [f"{prose(100 + i, 40)} {p} {prose(300 + i, 40)}" for i in range(60)] + [p] * 40 + [None, "", q, q, f"abc {p[50:400]} xyz", "a" * 500, p[1:101], f"{p[:150]}{p[:150]}"]
    docs = docs_of(spark, texts).repartition(5)
    keyed = suffix_dedup._keyed(docs, "doc_id", "text")
    many = suffix_dedup.hot_anchors(keyed)
    assert len(many)
    held = spark.sparkContext.broadcast(many)
    rows = suffix_dedup.anchored(keyed, 16, held).collect()
    buckets = {}
    for r in rows:
        for a in np.frombuffer(r.anchor, np.uint64)[np.isin(np.frombuffer(r.anchor, np.uint64), many)].tolist():
            buckets.setdefault(a, []).append(r.bucket)
    assert all(len(set(b)) > 1 for b in buckets.values())  # no hot anchor is one task
    rows = suffix_dedup.annotate(docs).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute_dedup(texts)
    twice = spark.createDataFrame([(1, p), (2, p), (None, p)] * 30, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id or 9, r.n_removed) for r in suffix_dedup.annotate(twice).collect()) == [(1, 0)] * 30 + [(2, len(p))] * 30 + [(9, len(p))] * 30


# -- Jaccard join -------------------------------------------------------------------------------------------------------

def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 85 * len(a | b)]
    up = list(range(len(sets)))
    for _ in up:
        for i, j in links:
            up[i] = up[j] = min(up[i], up[j])
    return [(len(s), u) for s, u in zip(sets, up, strict=True)]


def variants(seed, base, n):
    r, out = np.random.default_rng(seed), []
    for _ in range(n):
        w = base.split()
        for i in r.integers(0, len(w), r.integers(0, 7)):
            w[i] = f"z{r.integers(0, 30)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("tile", [4096, 6])
def test_jaccard_join(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    texts = [None, "", " \n", "one", "ONE", "one two", "one two three four", "one two three four five", *variants(1, prose(1, 120), 40), *variants(2, prose(2, 60), 20), prose(3, 4000), prose(3, 4000) + " end", "é È", "é è"]
    d = docs_of(spark, texts, "component_id")
    rows = jaccard_join.components(d).orderBy("id").collect()
    assert [(r.n_shingles, r.component_id) for r in rows] == brute_components(texts)
    assert jaccard_join.components(docs_of(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=10), max_size=14))
def test_t_occurrence(sets):
    links = jaccard_join.t_occurrence([np.array(sorted(s), np.uint64) for s in sets], np.array([len(s) for s in sets], np.int64), np.zeros(len(sets), np.int64), Fraction(85, 100))
    up = list(range(len(sets)))
    for i, j in links:
        assert 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    for _ in sets:
        for i, j in links:
            up[i] = up[j] = min(up[i], up[j])
    assert all(up[i] == up[j] for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * len(a & b) >= 85 * len(a | b))


# -- pipeline -----------------------------------------------------------------------------------------------------------

def test_near_copies_lose_no_text(spark):
    import corpus_pipeline
    base, other = prose(1, 120), prose(2, 90)
    rows = [(1, base, "a"), (5, base, "a"), (5, prose(7, 60), "a"), (None, "x", "a"), (None, "x", "b"), (6, other, "a"), (5, other + " z", "a"), (6, other, "a"), (8, "", "a"), (8, None, "a")]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:9], r.lang) for r in kept) == sorted(
        [(1, base[:9], "a"), (5, rows[2][1][:9], "a"), (0, "x", "a"), (0, "x", "b"), (5, other[:9], "a"), (8, "", "a"), (8, "", "a")])
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    r = np.random.default_rng(3)
    syllables = ["ta", "lo", "mi", "sen", "kor", "ba", "nu", "fel", "dra", "vi"]
    clean = lambda n: " ".join("".join(r.choice(syllables, r.integers(1, 4))) for _ in range(n))
    texts, toxic = [], []
    for i in range(500):
        w = clean(40).split()
        if i % 4 == 0:
            w[int(r.integers(0, 40))] = str(r.choice(["grumblewit", "zogface", "quibhead"]))
        texts.append(" ".join(w))
        toxic.append(int(i % 4 == 0))
    item = clean(30)
    base = clean(200)
    extra = [base, base, base + " tail", None, "", "", f"{clean(20)} {item}", f"{clean(900)} {item}", f"{clean(20)} password=abcdef99 AKIA{'Q7' * 8} {clean(9)}", clean(3000)]
    texts += extra
    docs = [(i, t, "en", "web", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [d for d in docs if d[0] >= len(toxic) or not toxic[d[0]]]
    kept = [d for d, (_, c), at in zip(left, brute_components([d[1] for d in left]), range(len(left)), strict=True) if c == at]
    want = {}
    for d, (n, hit, _) in zip(kept, brute_hits([d[1] for d in kept], [(1, item)]), strict=True):
        if not (hit and 20 * hit >= n):
            want[d[0]] = d[1] or ""
    secret = len(texts) - 2
    want[secret] = want[secret].replace("password=abcdef99", "[assign]").replace("AKIA" + "Q7" * 8, "[access]")
    assert len(texts) - 3 in want and len(texts) - 4 not in want and secret in want  # diluted, contaminated, redacted

    import public_tokenizers
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    pieces = {}
    for i, t in want.items():
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s:s + 2048], "<u4")
            pieces[i, p] = (s, len(part), zlib.crc32(part.tobytes()))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == pieces and len(rows) == len(pieces)
    check_places(rows)
