import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from specmill.functions import exprs as E
from specmill.operators import compare as C
from specmill.operators import matching as M
from specmill.operators import profile as P
from specmill.operators import tree as T
from specmill.plans import pipeline, registry
from specmill.sources import store
from specmill.sources.adapter import Tables


def _coats(spark, *rows):
    return spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)],
                                 "record_id string, type string, type_he string, name string, standard string, thickness string, rohs boolean")


def _catalog(spark, *rows):
    return spark.createDataFrame([(i, f"m{i}", *r, "", "", "", "x\\y") for i, r in enumerate(rows)],
                                 "ordinal int, master_id string, desc string, standard string, thickness string, color string, col5 string, rohs string, full_name string")


def test_scores(spark):
    coats = _coats(spark, ("ZINC PLATING", "", "ZINC PLATING CLEAR", "ASTM B633 TYPE II", "5-10 mic", True))
    cat = _catalog(spark, ("HARD ANODIZE", "MIL-A-8625 TYPE III", "50 mic"), ("BLUE/WHITE ZINC-RoHS", "ASTM-B633D TYPE II", "5-10 mic"),
                   ("BLUE/WHITE ZINC-RoHS", "ASTM-B633 TYPE II", "5-10 mic"))
    got = M.match_catalog(coats, cat).orderBy("rank").collect()
    assert [(r.master_id, r.rank) for r in got] == [("m1", 1), ("m2", 2)]
    assert got[0].score == 30 + 20 + 50 + 8 + 15 + 12


def test_candidates_equal_all_pairs(spark):
    kinds = ["ZINC", "NICKEL", "ELECTROLESS NICKEL HIGH PHOSPHORUS", "ANODIZE BLACK", "HARD ANODIZE", "EPOXY", "CHEM FILM CLEAR RoHS", "BLACK RoHS", "BLACK", "RoHS", ""]
    stds = ["ASTM B633 TYPE II", "AMS-C-26074 CLASS 4", "", "MIL-A-8625 TYPE III"]
    thick = ["5-10 mic", "", "0.5 mm", "15", "8-200 mic", "0", "10-5"]
    coats = _coats(spark, *[(k, "", k, s, t, (i + j) % 2 == 0) for i, k in enumerate(kinds) for j, s in enumerate(stds) for t in thick])
    cat = _catalog(spark, *[(k, s, t) for _ in range(2) for k in kinds for s in stds for t in thick])
    a = M.coating_features(coats).select(F.col("record_id"), F.struct(*M._FEATURES).alias("a"))
    b = M.catalog_features(cat).select("ordinal", F.struct(*M._FEATURES).alias("b"))
    terms = M.score_terms()
    every = a.crossJoin(b).withColumn("s", sum(terms.values(), F.lit(0.0))).where("s >= 15")
    want = {}
    for r in every.select("record_id", F.bround("s", 1).alias("s"), "ordinal").collect():
        want.setdefault(r.record_id, []).append((-r.s, r.ordinal))
    got = {}
    for r in M.match_catalog(coats, cat).select("record_id", "rank", "score", "master_id").collect():
        got.setdefault(r.record_id, {})[r.rank] = (-r.score, int(r.master_id[1:]))
    assert {k: sorted(v)[:3] for k, v in want.items()} == {k: [v[i] for i in sorted(v)] for k, v in got.items()}


def test_levels_meet_each_pair_once_and_stop(spark):
    coats = _coats(spark, *[("ZINC", "", "ZINC YELLOW", "ASTM B633 TYPE II", "5-10 mic", True)] * 3, ("ZINC", "", "", "", "", False))
    cat = _catalog(spark, *[("YELLOW ZINC RoHS", "ASTM B633 TYPE II", t) for t in ("5-10 mic", "5-11 mic", "5-12 mic")], ("ZINC", "", ""), ("NICKEL", "ASTM B633", ""))
    whole = F.to_json(F.struct(*M._FEATURES))
    left = M._distinct_features(M.coating_features(coats).withColumn("combo", whole), True)
    right = M._distinct_features(M.catalog_features(cat).withColumn("combo", whole), False)
    pairs = [(r.a.combo, r.b.combo) for level in M._LEVELS for r in M.catalog_candidates(left, right, level).collect()]
    assert len(pairs) == len(set(pairs)) == 9
    used = []
    find = M.catalog_candidates
    M.catalog_candidates = lambda a, b, level: used.append(a.count()) or find(a, b, level)
    try:
        got = M.match_catalog(coats, cat, keep=store.materialise).collect()
    finally:
        M.catalog_candidates = find
    # the full coating stops after level 1; the plain one has nothing but its kind, so level 3 cannot add to level 2
    assert used == [2, 1, 0] and len(got) == 12


DRAWINGS = "batch_id string, pos bigint, record_id string, source_filename string, part_number string, drawing_number string, assembly_role string, title string, material string, quantity string, notes string"
BOM = "batch_id string, parent_record_id string, parent_pos bigint, pos bigint, item_no string, part_number string, description string, qty string"


def _batch(spark):
    d = spark.createDataFrame([
        ("b", -1, "i", "image1.png", "image1", "", "Assembly Overview Image", "", "", "", ""),
        ("b", 0, "a", "a.pdf", "BN1B", "BN1B", "ASSEMBLY", "TOP", "", "1", ""),
        ("b", 1, "s", "s.pdf", "BP2A", "", "ASSEMBLY", "SUB", "STEEL", "1", ""),
        ("b", 2, "p", "p.pdf", "bp3a", "D3", "PART", "PART3", "", "2", "MARK PART NUMBER BP9999Z"),
        ("b", 3, "o", "o.pdf", "BP7A", "", "PART", "ALONE", "", "", ""),
    ], DRAWINGS)
    bom = spark.createDataFrame([
        ("b", "a", 0, 1, "1", "BP2A", "SUB ASSY", "1"), ("b", "a", 0, 2, "2", "BP3A", "", "4"), ("b", "a", 0, 3, "3", "SCREW-1", "", ""),
        ("b", "s", 1, 1, "1", "50370634", "BAR STEEL", "1"),
    ], BOM)
    return d, bom


def test_tree(spark):
    d, bom = _batch(spark)
    d, bom = store.materialise(d, "d"), store.materialise(bom, "bom")
    edges = store.materialise(T.demote_nested_roots(T.filter_overview_roots(T.derive_edges(d, bom), d)), "edges")
    assert {r.parent_pn for r in edges.collect()} == {"BN1B"}
    rows = {(r.level, r.part_number): r for r in T.product_tree(d, bom, T.roots_of(edges), edges, store.materialise).collect()}
    assert set(rows) == {(0, "BN1B"), (1, "BP2A"), (1, "BP3A"), (1, "SCREW-1"), (0, "BP7A"), (1, "50370634")}
    assert rows[(1, "BP2A")].material == "STEEL" and rows[(1, "BP3A")].description == "PART3"
    assert rows[(1, "50370634")].parent_part_number == "BP2A" and rows[(0, "BP7A")].qty == "1"
    none = edges.where("1 = 0")
    flat = {(r.level, r.part_number) for r in T.product_tree(d, bom, T.roots_of(none), none).collect()}
    assert flat == {(0, "BN1B"), (1, "BP2A"), (1, "bp3a"), (0, "BP7A")}  # no purchased parts without roots
    assert {r.part_number for r in T.orphans(d, edges).collect()} == {"BP7A"}
    assert {r.part_number for r in T.missing_children(edges).collect()} == {"SCREW-1"}
    assert [r.value for r in T.marking_xref(d, edges).collect()] == ["BP9999Z"]
    assert T.tree_integrity(d, bom, edges, d.select("batch_id").distinct()).count() == 0
    changed = edges.withColumn("qty", F.when(F.col("child_pn") == "BP3A", "5").otherwise(F.col("qty"))).where("child_pn <> 'BP2A'")
    got = {(r.type, r.value) for r in T.tree_integrity(d, bom, changed, d.select("batch_id").distinct()).collect()}
    assert got == {("MISSING_BOM_ITEMS", "BP2A"), ("QTY_MISMATCH", "BP3A: tree=5, bom=4")}


def test_overview_links(spark):
    d, bom = _batch(spark)
    edges = T.demote_nested_roots(T.derive_edges(d, bom))
    balloons = spark.createDataFrame([("b", "i", "1", "", "x", "1"), ("b", "i", "9", "bp3a", "y", "1"), ("b", "i", "", "", "z", "1")],
                                     "batch_id string, parent_record_id string, item_no string, part_number string, description string, qty string")
    got = {r.description: (r.method, r.part_number, r.linked_pn, r.uploaded) for r in T.link_overview_items(balloons, d, bom, edges).collect()}
    assert got == {"x": ("item_no", "BP2A", "BP2A", True), "y": ("part_number", "bp3a", "BP3A", True), "z": ("", "", "", False)}


def test_diff_and_two_pass(spark, records):
    a = records({"part_number": "P1", "revision": "A", "standards": ["X", "Y"], "machining_processes": [("1", "TURN", "", "old")]})
    b = records({"part_number": "P1", "revision": "B", "standards": ["Y", "Z"], "machining_processes": [("1", "TURN", "", "new")], "material": "AL"})
    d = C.diff_revisions(a, b)
    got = {(r.category, r.field, r.type, r.key) for r in C.explode_changes(d).collect()}
    assert got == {("identity", "revision", "modified", ""), ("material", "material", "added", ""), ("standards", "standards", "removed", "X"),
                   ("standards", "standards", "added", "Z"), ("machining", "machining_processes", "modified", "1 | TURN")}
    s = C.diff_summary(d).first()
    assert s.total_changes == 5 and s.label_a == "P1 Rev A" and s.categories == "identity,material,machining,standards"
    assert C.diff_summary(C.diff_revisions(a, a)).first().total_changes == 0
    p = spark.createDataFrame([("x", '{"c":"RAL 7035"}', '{"c":"RAL 7036"}'), ("y", '{"c":"RAL 7035"}', '{"c":"RAL 7035 BY"}')], "pair_id string, json_1 string, json_2 string")
    r = {x.pair_id: x for x in C.two_pass_compare(p).collect()}
    assert r["x"].merged == '{"c":"[VERIFY: RAL 7035]"}' and [f.type for f in r["x"].findings] == ["RAL_MISMATCH"]
    assert r["y"].findings == []


def test_diff_keeps_similar_items_and_unpaired_records(spark, records):
    start = "x" * 60
    step = lambda *tails: [("", "", "", start + t) for t in tails]
    a = records({"record_id": "both", "machining_processes": step("1", "2")}, {"record_id": "old", "standards": ["X"], "part_number": "P"})
    b = records({"record_id": "both", "machining_processes": step("2", "3")}, {"record_id": "new", "material": "AL"})
    d = C.diff_revisions(a, b)
    got = sorted((r.record_id, r.field, r.type) for r in C.explode_changes(d).collect())
    assert got == [("both", "machining_processes", "added"), ("both", "machining_processes", "removed"), ("new", "material", "added"), ("new", "packaging_notes", "modified"),
                   ("old", "packaging_notes", "modified"), ("old", "part_number", "removed"), ("old", "standards", "removed")]
    assert {r.record_id: (r.label_a, r.label_b) for r in d.collect()}["old"] == ("P Rev ?", "? Rev ?")


def test_first_of_content_without_fingerprint(spark, records):
    r = records(*[{"record_id": f"r{i}", "source_filename": f"{9 - i}.pdf", "fingerprint": f} for i, f in enumerate(["a", "a", None, None])])
    assert {x.record_id: x._first for x in P.first_of_content(r, ["batch_id"]).collect()} == {"r0": False, "r1": True, "r2": True, "r3": True}


def test_diff_of_repeated_null_and_many_items(spark, records):
    a = records({"standards": ["X", "X", None, "Y"], "machining_processes": [("1", "TURN", "", "a"), ("1", "TURN", "", "b")]},
                {"standards": [f"S{i}" for i in range(400)]})
    b = records({"standards": ["Y", "X"], "machining_processes": [("1", "TURN", "", "b"), ("1", "TURN", "", "c")]},
                {"standards": [f"S{i}" for i in range(399, 0, -1)] + ["T"]})
    got = {(r.record_id, r.type, r.key) for r in C.explode_changes(C.diff_revisions(a, b)).collect()}
    assert got == {("r0", "modified", "1 | TURN"), ("r1", "removed", "S0"), ("r1", "added", "T")}


def test_tree_facts_per_identifier(spark):
    """A part under two assemblies, a repeated drawing, an overview image known by its file stem, a purchased part."""
    d = spark.createDataFrame(
        [("b", 0, "a1", "BP1", "D1", "ASSEMBLY", "", "A", "1", "f.pdf"), ("b", 1, "a2", "BP2", "D2", "ASSEMBLY", "", "B", "1", "g.pdf"),
         ("b", 2, "p", "BP3", "D3", "PART", "STEEL", "P", "2", "h.pdf"), ("b", 3, "p2", "bp3", "D3", "PART", "BRASS", "P", "2", "h2.pdf"),
         ("b", 4, "o", "", "", "Assembly Overview Image", "", "", "", "PIC7.png"), ("b", 5, "x", "pic7.tif", "", "PART", "", "", "", "i.pdf")],
        "batch_id string, pos int, record_id string, part_number string, drawing_number string, assembly_role string, material string, title string, quantity string, source_filename string")
    bom = spark.createDataFrame(
        [("b", "a1", 0, 0, "1", "BP3", "", "4"), ("b", "a2", 1, 0, "1", "BP3", "late", "9"), ("b", "a2", 1, 1, "2", "BUY1", "BOLT", "8")],
        "batch_id string, parent_record_id string, parent_pos int, pos int, item_no string, part_number string, description string, qty string")
    edges = store.materialise(T.tree_edges(d, bom, store.materialise), "edges")
    tree = lambda e: T.product_tree(d, bom, T.roots_of(e), e, store.materialise)
    rows = lambda e: sorted((r.level, r.part_number, r.qty, r.material, r.hierarchy_path) for r in tree(e).collect())
    assert rows(edges) == [(0, "BP1", "1", "", "BP1"), (0, "BP2", "1", "", "BP2"), (1, "BP3", "4", "BRASS", "BP1 > BP3"), (1, "BP3", "9", "BRASS", "BP2 > BP3"),
                           (1, "BUY1", "8", "", "BP2 > BUY1")]
    # without edges the first BOM row gives the parent, and batches without roots have no purchased parts
    assert rows(edges.where("1 = 0")) == [(0, "BP1", "1", "", "BP1"), (0, "BP2", "1", "", "BP2"), (1, "BP3", "4", "STEEL", "BP1 > BP3")]


def test_derived_tables_write_nothing(spark, monkeypatch):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables")
    spark.__dict__.pop("_specmill_plans", None)
    monkeypatch.setattr(store, "new_path", lambda *a: pytest.fail("a table was written"))
    t = Tables(spark, "/root/testdata/sf0.001")
    assert t.drawings().groupBy("batch_id").count().count() > 0
    assert t.bom().where("pos = 1").count() > 0


def test_edges_are_made_once(spark):
    """Parents are judged before they meet their rows: what is written are the rows of batches with several parents."""
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables")
    t = Tables(spark, "/root/testdata/sf0.001")
    d, bom, kept = t.drawings(), t.bom(), {}
    keep = lambda df, name: kept.setdefault(name, store.materialise(df, name))
    got = T.tree_edges(d, bom, keep)
    want = T.demote_nested_roots(T.filter_overview_roots(T.derive_edges(d, bom), d))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want)
    assert list(kept) == ["children_of_several"] and kept["children_of_several"].count() < bom.count() / 2


def test_batch_pipeline_makes_what_is_asked(spark):
    """Edges are written once, with their texts repaired; states and BOM items only if the integrity is asked for."""
    d = spark.createDataFrame(
        [("b", 0, "a1", "1SO1 TOP", "D1", "ASSEMBLY", "", "A", "1", "f.pdf", ""), ("b", 1, "a2", "BP2", "D2", "ASSEMBLY", "", "B", "1", "g.pdf", ""),
         ("b", 2, "p", "BP3", "D3", "PART", "STEEL", "P", "2", "h.pdf", ""), ("c", 1, "x", "BP9", "D9", "PART", "AL", "X", "", "x.pdf", ""),
         ("c", 2, "y", "bp9", "D8", "PART", "CU", "Y", "3", "y.pdf", "")],
        "batch_id string, pos int, record_id string, part_number string, drawing_number string, assembly_role string, material string, title string, quantity string, source_filename string, notes string")
    bom = spark.createDataFrame(
        [("b", "a1", 0, 0, "1", "BP2", "BBO", "4"), ("b", "a2", 1, 0, "1", "BP3", "late", "9"), ("b", "a1", 0, 1, "2", "1SO7", "BOLT", "8")],
        "batch_id string, parent_record_id string, parent_pos int, pos int, item_no string, part_number string, description string, qty string")
    names = []
    keep = lambda df, name: names.append(name) or store.materialise(df, name)
    got = pipeline.process_batches(d, bom, keep, ("tree", "edges"))
    assert list(got) == ["tree", "edges"] and not {"states", "bom_items", "shown_edges"} & set(names) and names.count("edges") == 1
    assert {(r.parent_pn, r.child_pn, r.description) for r in got["edges"].collect()} == {("ISO1 TOP", "BP2", "BB0"), ("ISO1 TOP", "ISO7", "BOLT")}
    rows = sorted((r.level, r.part_number, r.qty, r.material) for r in got["tree"].where("batch_id = 'c'").collect())
    assert rows == [(0, "BP9", "1", "AL"), (0, "bp9", "3", "CU")]  # one identifier, two stand-alone drawings
    given = T.product_tree(d, bom, T.roots_of(got["edges"]), got["edges"], store.materialise)
    none = T.product_tree(d, bom, None, got["edges"], store.materialise)
    assert sorted(map(str, given.collect())) == sorted(map(str, none.collect()))
    assert set(pipeline.process_batches(d, bom, keep)) == set(pipeline.BATCH_TABLES) and "states" in names


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was_set = shuffles(), spark.conf.get(name)
    got = store.materialise(spark.range(1000).selectExpr("id % 7 AS k", "id").repartition(5, "id").groupBy("k").count(), "counts")
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before and spark.conf.get(name) == was_set
    assert got.count() == 7


def test_strip_of_written_columns(spark):
    texts = [None, "", " ", "A", " A", "A ", "\u3000A\u00a0", "\tA B\n", "\x85", "A\u2003", "\u00c9", "a\u00e9 ", "~", "!", "\x7fA", "A\x1f", "\u05d0\u05d1"]
    df = spark.createDataFrame([(t,) for t in texts], "c string").select(E.strip(F.col("c")).alias("a"), E.strip_kept(F.col("c")).alias("b"), E.key_kept(F.col("c")).alias("k"))
    assert all(r.a == r.b and r.k == r.a.upper() for r in df.collect())


def test_tree_queries_derive_their_inputs_once(spark, monkeypatch):
    """Line items are shuffled once for drawings and BOM, which are then read from files, however often the tree needs them."""
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables")
    names, new_path = [], store.new_path
    monkeypatch.setattr(store, "new_path", lambda s, name: names.append(name) or new_path(s, name))
    for query in ("j7_demote_nested_roots", "t1_tree_from_bom"):
        spark.__dict__.pop("_specmill_plans", None)
        names.clear()
        plan = registry.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert names.count("tree_drawings") == names.count("tree_bom") == 1 and "row_number()" not in plan, query


def test_steps_of_the_tree_are_written_apart(spark):
    d, bom = _batch(spark)
    d, bom, names = store.materialise(d, "d"), store.materialise(bom, "bom"), []
    keep = lambda df, name: names.append(name) or store.materialise(df, name)
    edges = T.tree_edges(d, bom, store.materialise)
    T.product_tree(d, bom, None, edges, keep)
    assert "assembly_items" in names
    balloons = spark.createDataFrame([("b", "i", "1", "", "x", "1"), ("b", "i", "9", "bp3a", "y", "1"), ("b", "i", "", "", "z", "1"), ("b", None, None, None, None, None)],
                                     "batch_id string, parent_record_id string, item_no string, part_number string, description string, qty string")
    rows = lambda *keep: sorted(map(str, T.link_overview_items(balloons, d, bom, edges, *keep).collect()))
    assert rows(keep) == rows() and {"main_rows", "linked_balloons"} <= set(names)


def test_edges_of_repeated_and_null_rows(spark):
    """Children meet the drawings before their parents: repeated parents repeat edges, and unknown ones make none."""
    d, bom = _batch(spark)
    more = spark.createDataFrame([("b", 9, "a", "a2.pdf", "BN1B", None, "assembly", None, None, None, None), (None, 0, "n", "n.pdf", "BP2A", "", "ASSEMBLY", "", "", "", "")], DRAWINGS)
    lines = spark.createDataFrame([("b", "a", 0, 9, None, " bp3a\t", None, None), (None, "n", 0, 1, "1", "BP3A", "", "1"), ("b", None, 0, 1, "1", "BP3A", "", "1"), ("b", "zz", 0, 1, "1", "BP3A", "", "1")], BOM)
    got = T.derive_edges(d.unionByName(more), bom.unionByName(lines)).where("parent_record_id = 'a'").select("root_pos", "parent_dwg", "pos", "child_pn", "child_dwg", "found").collect()
    want = [(1, "BP2A", "", True), (2, "BP3A", "D3", True), (3, "SCREW-1", "", False), (9, "bp3a", "D3", True)]
    assert sorted(map(tuple, got)) == sorted((p, "BN1B" if p == 0 else "", *w) for p in (0, 9) for w in want)
