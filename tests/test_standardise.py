from pyspark.sql import functions as F

from specmill.operators import standardise as N
from specmill.plans import pipeline


def test_collapse_repeats():
    assert N.collapse_repeats("SCREW 0.250 NOM. SIZE 0.218 NOM. SIZE 0.218 NOM. SIZE 0.218") == "SCREW 0.250 NOM. SIZE 0.218"
    assert N.collapse_repeats("HEAD HEAD HEAD HEAD BOLT") == "HEAD BOLT"
    assert N.collapse_repeats("A B A B") == "A B A B"
    assert N.collapse_repeats("") == ""
    assert N.collapse_repeats("x  y") == "x  y"
    assert N.collapse_repeats("A A A B A A A B A A A B") == "A A A B".replace("A A A", "A")


def _slow(text):
    """The same rule, word by word."""
    words = text.split()
    for size in range(max(1, len(words) // 3), 0, -1):
        i, changed = 0, False
        while i <= len(words) - size * 3:
            n, j = 1, i + size
            while words[j:j + size] == words[i:i + size] and j + size <= len(words):
                n, j = n + 1, j + size
            if n >= 3:
                words = words[:i + size] + words[j:]
                changed = True
                i += size
            else:
                i += 1
        if changed:
            return _slow(" ".join(words))
    return text


def test_collapse_repeats_against_slow_rule():
    import random

    rng = random.Random(1)
    for _ in range(400):
        t = " ".join(rng.choice("AB") for _ in range(rng.randrange(1, 25)))
        assert N.collapse_repeats(t) == _slow(t), t


def test_candidates(spark):
    names = [("B2BDraw_AB12345A-A-PD.pdf", "AB12345A", "AB12345A-A"), ("_asm_temp_1234-567-00.pdf", "", "1234-567-00"), ("_asm_temp_1234-567-00-RevA.pdf", "", "1234-567-00-REVA"),
             ("ABC1242544-(157529).PDF", "ABC1242544", "ABC1242544"), ("330-53-14-J8409-201_DRILL.pdf", "", "330-53-14-J8409-201"),
             ("CX145-08120.pdf", "", "CX145-08120"), ("107594360.pdf", "", "107594360"),
             ("30-168217-E-PDM-30-168217E.pdf", "", "30-168217-E"), ("notes.pdf", "", "")]
    df = spark.createDataFrame(names, "source_filename string, want_narrow string, want_generic string")
    for r in N.identifier_candidates(df).collect():
        assert r.narrow == r.want_narrow, r
        if r.source_filename not in ("B2BDraw_AB12345A-A-PD.pdf",):
            assert r.generic == r.want_generic, r


def _dims(spark):
    cage = spark.createDataFrame([("1A11A", "Northwind Optics Ltd.")], "cage string, customer string")
    default = spark.createDataFrame([("Northwind Optics Ltd.", "1A11A")], "customer string, cage string")
    alias = spark.createDataFrame([(0, "NORTHWIND", "Northwind Optics Ltd."), (1, "NWO", "Northwind Optics Ltd.")], "ordinal int, alias string, customer string")
    prefix = spark.createDataFrame([(0, "BN", "Blue Ridge"), (1, "BP", "Blue Ridge")], "ordinal int, prefix string, customer string")
    spec = spark.createDataFrame([("Kite Works", r"^I-\d+")], "customer string, pattern string")
    return {"cage": cage, "default_cage": default, "alias": alias, "pn_prefix": prefix, "internal_spec": spec}


def test_seven_scenarios(spark, records):
    df = records(
        {"source_filename": "BN80760B.pdf", "part_number": "BNB0760B", "drawing_number": "BNB0760B"},
        {"material": "AL 5052-H32 PER SAE-AMS-4016 (FORMERLY AMS QQ-A-250/8)"},
        {"customer": "Kite Works", "standards": ["I-1234", "AWI-STD-1916"]},
        {"revision": "RC"},
        {"part_number": "XY12345", "assembly_role": "ASSEMBLY", "bom_items": [("1", "XY12345", "SELF", "1")]},
        {"customer": "nwo"},
        {"source_filename": "FTG1242544.pdf", "part_number": "YT35 MD FTG1242544", "drawing_number": "YT35 MD FTG1242544"},
        {"customer": "Northwind - Plant 7", "cage_code": "x!"},
    )
    texts = spark.createDataFrame([], "record_id string, text string")
    done = pipeline.process_records(df, texts, _dims(spark))
    r = {x.record_id: x for x in done.collect()}
    assert (r["r0"].part_number, r["r0"].drawing_number) == ("BN80760B", "BN80760B")
    assert r["r1"].material == "AL 5052-H32 PER SAE-AMS-4016" and r["r1"].material_formerly == "AMS QQ-A-250/8"
    assert [f.value for f in r["r2"]._findings if f.type == "SUSPICIOUS_STANDARD"] == ["AWI-STD-1916"]
    assert r["r3"].revision == "C"
    assert r["r4"].bom_items == [] and r["r4"].assembly_role == "PART"
    assert r["r5"].customer == "Northwind Optics Ltd." and r["r5"].cage_code == "1A11A"
    assert (r["r6"].part_number, r["r6"].drawing_number) == ("FTG1242544", "FTG1242544")
    assert r["r7"].customer == "Northwind Optics Ltd."


def test_material_from_text(spark):
    rows = [("a", "TITLE\nMATERIAL:\n\nSAME MATERIAL\n AL 6061-T6 \n"), ("b", "MATL - STEEL 4140"), ("c", "made of STAINLESS STEEL 303 PER AMS-5640"),
            ("d", "MATERIAL\nQTY\nDATE\nSCALE\nBRASS"), ("e", "nothing"), ("f", "MATERIAL: " + "STEEL " * 100)]
    got = {r.record_id: r.text_material for r in N.material_from_text(spark.createDataFrame(rows, "record_id string, text string")).collect()}
    assert got["a"] == "AL 6061-T6" and got["b"] == "STEEL 4140" and got["c"].startswith("STAINLESS STEEL 303 PER AMS-5640")
    assert got["d"] is None and got["e"] is None and got["f"] == " ".join(["STEEL"] * 100)


def test_phrases(spark, records):
    df = N.normalise_phrases(records(
        {"notes": "PER ZO SQUEGLIA, NQE VALUE", "standards": ["PSSOO100", "TO-PS-DOC0002945"],
         "machining_processes": [("1", "V25.4 AMS-C-26074", "", "")]}, {"notes": "plain"}))
    r = {x.record_id: x for x in df.collect()}
    assert r["r0"].notes == "PER Z0 SQUEGLIA, INDEX VALUE" and r["r0"].standards == ["PS500100", "PS-DOC0002945"]
    assert r["r0"].machining_processes[0].name_en == "SAE-AMS-C-26074" and len(r["r0"].phrase_fixes) >= 4
    assert r["r1"].phrase_fixes == [] and r["r1"].notes == "plain"


def test_bom_text_and_edits(spark, records):
    base = records({"part_number": "P1", "standards": ["A"], "_review_status": "pending",
                    "bom_items": [("1", "X", "HEAD HEAD HEAD BOLT", "1"), ("2", "Y", "OK", "1")]})
    out = N.clean_bom_text(base).first()
    assert [b.description for b in out.bom_items] == ["HEAD BOLT", "OK"] and out.bom_fixed == 1
    edits = spark.createDataFrame([("r0", 1, "part_number", "P2"), ("r0", 2, "part_number", "P3"), ("r0", 3, "standards", "A, B"), ("r0", 4, "material", "")],
                                  "record_id string, ts bigint, field string, value string")
    r = N.apply_review_edits(base, edits).first()
    assert r.part_number == "P3" and r.standards == ["A", "B"] and r._review_status == "edited"
    assert r._user_edits == {"part_number": "P1", "standards": "A"}


def test_corrections(spark, records):
    before = records({"part_number": "BNB0760B", "source_filename": "BN80760B.pdf"})
    after = N.reconcile_identifiers(N.identifier_candidates(before))
    c = N.corrections(before, after, ["part_number", "drawing_number"], "n2").collect()
    assert [(x.field, x.old, x.new) for x in c] == [("part_number", "BNB0760B", "BN80760B")]


def test_long_material_is_kept_whole(spark):
    long_ = "ALUMINUM ALLOY " + "6061-T6 BAR " * 30 + "END"
    got = N.material_from_text(spark.createDataFrame([("a", f"MATERIAL: {long_}\nx")], "record_id string, text string")).first()
    assert len(long_) > 300 and got.text_material == long_
