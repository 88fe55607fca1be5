import pytest
from pyspark.sql import functions as F

from specmill.operators import rules as V


def _types(df, *rules):
    out = {}
    for r in V.collect_findings(df, {f"r{i}": x for i, x in enumerate(rules)}).collect():
        out.setdefault(r.record_id, []).append((r.type, r.value))
    return out


def paint(name, std=""):
    return ("25.1", "PAINT", "", name, "", std, False, "")


def test_paint_and_coating(records):
    df = records({"painting_processes": [paint("RAL 7035"), paint("x RAL 123", "RAL9999")], "standards": ["RAL 9005"]},
                 {"painting_processes": [paint("EPOXY BY UNKNOWNCO"), paint("TOP BY TAMBOUR")]},
                 {"coating_processes": [paint("EPOXY PRIMER"), paint("MASK THREADS"), paint("ZINC PLATING PRIMER")]})
    got = _types(df, V.ral_codes, V.paint_brands, V.coating_class)
    assert got["r0"] == [("INVALID_RAL", "RAL 0123"), ("INVALID_RAL", "RAL 9999")]
    assert [t for t, _ in got["r1"]] == ["UNKNOWN_PAINT_BRAND"]
    assert got["r2"] == [("MISCLASSIFIED_COATING", "EPOXY PRIMER"), ("MISCLASSIFIED_COATING", "MASK THREADS")]


@pytest.mark.parametrize("standard,ok", [
    ("MIL-DTL-5541", True), ("PS- 111.21", True), ("Y14. 6", False), ("FED. STD. 595A", True), ("AWI-STD-1916", False),
    ("RoHS DIRECTIVE 2011/65", True), ("RAL 7035", True), ("ISO STANDARDS", True), ("A-A-56032", True), ("GEN_1111-1", True)])
def test_standards(records, standard, ok):
    df = records({"standards": [standard]}).withColumn("_own_patterns", F.array().cast("array<string>"))
    assert (_types(df, V.standards_body) == {}) == ok


def test_packing(records):
    note = lambda t: {"packaging_notes": ("", t, "")}
    df = V.with_packing_ratio(records(
        note("[NO_PACKING_REQUIREMENT_IN_DRAWING]"), note(""), note("EACH PART SHALL BE INDIVIDUALLY PACKED."), note("qwzx 12345 vvv kkk jj"),
        note("EACH PART SHALL BE PACKED INDIVIDUALLY")))
    got = {k: v[0][0] for k, v in _types(df, V.packing).items()}
    assert got == {"r0": "NO_PACKING_REQUIREMENT_IN_DRAWING", "r1": "MISSING_PACKING", "r3": "UNUSUAL_PACKING_NOTE"}


def test_gaps_and_completeness(records):
    df = records({"notes": "PICKLING FIRST", "assembly_role": "PART", "final_approval": [("1", "VISUAL", "", "")]},
                 {"notes": "STRESS RELIEF", "additional_processes": [("1", "", "", "stress relief bake")]})
    got = _types(df, V.process_gaps, V.part_completeness)
    assert [t for t, _ in got["r0"]] == ["MISSING_SURFACE_PREP", "MISSING_PACKING", "MISSING_SERVICEABILITY_TAG", "MISSING_GENERAL_INSTRUCTIONS"]
    assert "r1" not in got


def test_grounding(spark, records):
    texts = spark.createDataFrame([("r0", "per mil dtl 5541 and ASTM-B633"), ("r1", "  ")], "record_id string, text string")
    df = V.ground_standards(records({"standards": ["MIL-DTL-5541", "ASTM B633 TYPE II", "XYZ 1"]}, {"standards": ["XYZ 1"]}, {"standards": ["Q"]}), texts)
    r = {x.record_id: (x.standards, x._flagged) for x in df.collect()}
    assert r == {"r0": (["MIL-DTL-5541", "ASTM B633 TYPE II"], ["XYZ 1"]), "r1": (["XYZ 1"], []), "r2": (["Q"], [])}


def test_owner_and_hints(spark, records):
    prefix = spark.createDataFrame([("B", "Bee"), ("BAS", "Bass Aero")], "prefix string, customer string")
    df = V.with_pn_owner(records({"part_number": "BAS123", "customer": "Other"}, {"part_number": "BAS123", "customer": "BASS AERO LTD"}), prefix)
    assert list(_types(df, V.party_prefix)) == ["r0"]
    f = spark.createDataFrame([("MISSING_PACKING", "MEDIUM"), ("DWG_PREFIX_MISSING", "WARN"), ("OTHER", None)], "type string, severity string")
    hints = {r.type: r.hint for r in V.explain_findings(f).collect()}
    assert len(set(hints.values())) == 3


def test_failing_rule_does_not_stop_others(records):
    good, skipped = V.usable_rules(records({}), V.ALL_RULES)
    assert set(skipped) == {"standards_body", "internal_specs", "party_prefix", "packing"} and "ral_codes" in good


def test_a_broken_pattern_costs_no_other_finding(spark, records):
    df = records({"customer": "A", "standards": ["Q1", "NOBODY-7"]}, {"customer": "B", "standards": ["Z9", "a1b1", "a1b2"]},
                 {"customer": "", "standards": ["Q1"]})
    spec = spark.createDataFrame([("A", "Q[0-9]"), ("A", "(("), ("A", r"\Qx"), ("B", "Z9"), ("B", r"(.)1(.)\2"), ("B", r"a([0-9])b\1"), ("", "Q"), ("B", None)],
                                 "customer string, pattern string")
    assert {(r.customer, r.pattern, r.reason) for r in V.broken_patterns(spec).collect()} == {
        ("A", "((", "does not compile"), ("A", r"\Qx", "does not compile"), ("", "Q", "blank customer"), ("B", None, "no pattern")}
    own = V.with_own_patterns(df, spec)
    assert {r.record_id: r._own_patterns and len(r._own_patterns) for r in own.collect()} == {"r0": 1, "r1": 3, "r2": None}
    got = _types(own, V.standards_body, V.internal_specs)
    assert got["r0"] == [("SUSPICIOUS_STANDARD", "NOBODY-7"), ("CUSTOMER_INTERNAL_SPEC", "Q1")]
    assert got["r1"] == [("SUSPICIOUS_STANDARD", "a1b2"), ("CUSTOMER_INTERNAL_SPEC", "Z9"), ("CUSTOMER_INTERNAL_SPEC", "a1b1")]
    assert got["r2"] == [("SUSPICIOUS_STANDARD", "Q1")]
