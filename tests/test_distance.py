"""Identifier distance and the blocked join against a plain Python reading of the four patterns."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from specmill import refdata as R
from specmill.functions import distance as D
from specmill.functions import exprs as E
from specmill.operators import matching as M

PAIRS = {(p[0], p[1]) for p in R.LOOKALIKE_PAIRS} | {(p[1], p[0]) for p in R.LOOKALIKE_PAIRS}


def plain(a: str, b: str) -> int:
    if not a or not b:
        return 99
    if a == b:
        return 0

    def look(x, y):
        if not x or len(x) != len(y):
            return 99
        d = [(p, q) for p, q in zip(x, y) if p != q]
        return len(d) if all(t in PAIRS for t in d) else 99

    best = look(a, b)
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        if len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]:
            best = 1
    if abs(len(a) - len(b)) == 1:
        lo, sh = (a, b) if len(a) > len(b) else (b, a)
        if any(lo[:i] + lo[i + 1:] == sh for i in range(len(lo))):
            best = 1
        if lo[-1].isalpha():
            best = min(best, look(lo[:-1], sh))
    return best


def test_known_pairs(spark):
    cases = [("BNB0760B", "BN80760B", 1), ("BBJ10223A", "BB1J0223A", 1), ("BP7053A", "BP70534A", 1), ("8070689", "BP70689A", 2),
             ("AB1", "AB1", 0), ("BP1", "BX1", 99), ("ABC", "ABCDE", 99), ("", "A", 99), ("BP12", "BP123", 1), ("EL0498", "EI0498", 1)]
    df = spark.createDataFrame(cases, "a string, b string, want int").withColumn("got", D.identifier_distance(F.col("a"), F.col("b")))
    for r in df.collect():
        assert min(r.got, 99) == r.want, r


def _mutate(rng, s):
    kind = rng.randrange(5)
    i = rng.randrange(len(s))
    if kind == 0:
        opts = [q for p, q in PAIRS if p == s[i]]
        return s[:i] + rng.choice(opts) + s[i + 1:] if opts else s
    if kind == 1 and i + 1 < len(s):
        return s[:i] + s[i + 1] + s[i] + s[i + 2:]
    if kind == 2:
        return s[:i] + s[i + 1:] or s
    if kind == 3:
        return s[:i] + rng.choice("AB18O0") + s[i:]
    return s + rng.choice("ABI")


def test_blocked_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "CROWDED", 3)  # so that the split path is used as well
    rng = random.Random(5)
    alphabet = "B8O0I1PS5Z"
    base = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 5, 7, 8]))) for _ in range(120)]
    base += ["".join(rng.choice(alphabet) for _ in range(30)) for _ in range(10)]
    left = {(f"b{i % 2}", _mutate(rng, _mutate(rng, s))) for i, s in enumerate(base * 2)}
    right = {(f"b{i % 2}", s) for i, s in enumerate(base)}
    want = {}
    for (bl, a), (br, b) in itertools.product(left, right):
        if bl == br and 1 <= plain(a, b) <= 2:
            want[(bl, a)] = min(want.get((bl, a), (99, "")), (plain(a, b), b))
    got = M.nearest_identifier(spark.createDataFrame(sorted(left), "batch_id string, pn string"),
                               spark.createDataFrame(sorted(right), "batch_id string, pn string"))
    assert {(r.batch_id, r.pn): (r.distance, r.nearest) for r in got.collect()} == want
    assert len(want) > 50


def test_crowded_class_stays_small(spark):
    """Thousands of identifiers of one look-alike class in one batch: pairs grow with the rows, not with their square."""
    import itertools as it

    many = ["X" + "".join(p) for p in it.islice(it.product("O0DQ", repeat=6), 3000)]
    right = spark.createDataFrame([("b", s) for s in many], "batch_id string, pn string")
    left = spark.createDataFrame([("b", "X" + "P" * 6), ("b", "XOOOOOI")], "batch_id string, pn string")
    got = {r.pn: (r.distance, r.nearest) for r in M.nearest_identifier(left, right).collect()}
    want = {a: min(((plain(a, b), b) for b in many if 1 <= plain(a, b) <= 2), default=None) for a in ("XPPPPPP", "XOOOOOI")}
    assert got == {k: v for k, v in want.items() if v}


def test_both_directions(spark):
    drawings = spark.createDataFrame(
        [("b", 0, "a", "BP70616A", "BP70616A"), ("b", 1, "p", "BP70689A", ""), ("b", 2, "q", "BNB0760B", "BNB0760B"), ("c", 1, "z", "BP70689A", "")],
        "batch_id string, pos bigint, record_id string, part_number string, drawing_number string")
    bom = spark.createDataFrame([("b", "a", 0, 1, "8070689"), ("b", "a", 0, 2, "BN80760B"), ("b", "a", 0, 3, "")],
                                "batch_id string, parent_record_id string, parent_pos bigint, pos bigint, part_number string")
    fixed = M.correct_bom(bom, drawings)
    assert {r.pos: r.part_number for r in fixed.collect()} == {1: "BP70689A", 2: "BN80760B", 3: ""}
    out = {(r.batch_id, r.record_id): (r.part_number, r.drawing_number) for r in M.correct_drawings(drawings, fixed.drop("bom_fix_distance")).collect()}
    assert out[("b", "q")] == ("BN80760B", "BN80760B")
    assert out[("b", "p")] == ("BP70689A", "") and out[("c", "z")] == ("BP70689A", "")


def test_shared_sequence(spark):
    df = spark.createDataFrame([("THR1510712", "TH15012", False), ("AB-1234", "X1234", True), ("AB", "AB", False)], "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", E.share_sequence(F.col("a"), F.col("b"))).collect())


def test_digits_only_identifiers_share_no_key(spark):
    ids = spark.createDataFrame([("b", f"{i:06d}7") for i in range(3000)], "batch_id string, pn string")
    from pyspark.sql import functions as F
    from specmill.functions import distance as D
    for keys in (D.left_keys, D.right_keys):
        most = ids.select(F.explode(keys(F.col("pn"))).alias("e")).groupBy("e.k").count().agg(F.max("count")).first()[0]
        assert most <= 300


def test_small_batches_meet_without_keys(spark, monkeypatch):
    left = spark.createDataFrame([("s", "BP1O1A"), ("l", "BP1O1A"), ("s", "XX")], "batch_id string, pn string")
    small = [("s", "BP101A"), ("s", "QQ99")]
    want = {("s", "BP1O1A", "BP101A", 1)}
    many = [("l", "BP101A")] + [("l", f"ZZ{i:05d}") for i in range(M.CROWDED)]
    rows = lambda right: {tuple(r) for r in M.nearest_identifier(left, spark.createDataFrame(right, "batch_id string, pn string")).collect()}
    assert rows(small + many) == want | {("l", "BP1O1A", "BP101A", 1)}
    monkeypatch.setattr(M, "_meet_by_keys", lambda *a: pytest.fail("keys for small batches"))
    assert rows(small) == want


def test_identifier_forms_name_their_column_once():
    assert str(E.key(F.col("qqq"))).count("qqq") == 1
