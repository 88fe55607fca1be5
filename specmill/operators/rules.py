"""Validation rules. A rule is a column expression giving the findings of one record as an array.

Rules are evaluated side by side in one pass over the records and exploded
once, so the number of rules does not change the number of scans or shuffles.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmill import refdata as R
from specmill.functions import distance as D
from specmill.functions import exprs as E

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EMPTY = E.no_findings
_ANY_BODY = "(?i)^(?:" + "|".join(f"(?:{p})" for p in R.STANDARD_BODIES) + ")"


def _typed(c: Column) -> Column:
    return F.coalesce(c.cast(E.NO_FINDINGS), _EMPTY())


# ------------------------------------------------------------------ V1, V2, V3
def ral_codes() -> Column:
    """V1 INVALID_RAL: colour codes in paint names, paint standards and standards that no table knows."""
    painting = F.flatten(F.transform("painting_processes", lambda p: F.array(
        F.struct(F.coalesce(p["step_no"], F.lit("painting")).alias("src"), p["name"].alias("txt")),
        F.struct(F.coalesce(p["step_no"], F.lit("painting")).alias("src"), p["standard"].alias("txt")),
    )))
    standards = F.transform("standards", lambda s: F.struct(F.lit("standards").alias("src"), s.alias("txt")))
    codes = lambda t: F.transform(
        F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"(?i)RAL\s*(\d{3,4})"), 1), lambda c: F.lpad(c, 4, "0")
    )
    out = F.flatten(F.transform(F.concat(painting, standards), lambda t: F.transform(
        F.filter(codes(t["txt"]), lambda c: ~c.isin(R.RAL_CODES)),
        lambda c: E.finding("INVALID_RAL", "CRITICAL", t["src"], F.concat(F.lit("RAL "), c),
                            F.concat(F.lit("not a RAL code: "), c)),
    )))
    return _typed(out)


def paint_brands() -> Column:
    """V2 UNKNOWN_PAINT_BRAND: "X BY Y" with an unknown maker and no known brand in the name."""
    def one(p: Column) -> Column:
        name = F.coalesce(p["name"], F.lit(""))
        match = F.regexp_extract(name, "(?iU)" + R.BRAND_BY, 0)
        maker = F.upper(F.regexp_extract(name, "(?iU)" + R.BRAND_BY, 2))
        bad = ~E.contains_any(F.upper(name), R.PAINT_BRANDS) & (match != "") & ~maker.isin(R.PAINT_BRANDS)
        return F.when(bad, E.finding("UNKNOWN_PAINT_BRAND", "HIGH", F.coalesce(p["step_no"], F.lit("painting")), match,
                                     F.concat(F.lit("unknown maker "), maker)))
    return _typed(F.filter(F.transform("painting_processes", one), lambda x: x.isNotNull()))


def coating_class() -> Column:
    """V3 MISCLASSIFIED_COATING: paint or masking steps listed as coatings."""
    def one(p: Column) -> Column:
        name = F.upper(F.coalesce(p["name"], F.lit("")))
        src = F.coalesce(p["step_no"], F.lit("coating"))
        paint = E.contains_any(name, R.PAINT_WORDS) & ~E.contains_any(name, R.PLATING_WORDS)
        return (
            F.when(paint, E.finding("MISCLASSIFIED_COATING", "HIGH", src, name, "belongs to painting"))
            .when(E.contains_any(name, R.MASKING_WORDS),
                  E.finding("MISCLASSIFIED_COATING", "MEDIUM", src, name, "belongs to additional processes"))
        )
    return _typed(F.filter(F.transform("coating_processes", one), lambda x: x.isNotNull()))


# ------------------------------------------------------------------ V4, V5
def normal_standard(c: Column) -> Column:
    out = E.squeeze(c)
    out = F.regexp_replace(out, r"(?i)([A-Z])-\s+(\d)", "$1-$2")
    out = F.regexp_replace(out, r"(?U)(\w)\.\s+(\d)", "$1.$2")
    return F.upper(out)


def _own_spec(std: Column) -> Column:
    """Does the standard start with one of the customer's own patterns (column ``_own_patterns``)?"""
    return F.coalesce(
        F.exists("_own_patterns", lambda p: F.regexp_like(std, F.concat(F.lit("(?i)^(?:"), p, F.lit(")")))), F.lit(False)
    )


def standards_body() -> Column:
    """V4 SUSPICIOUS_STANDARD: no known issuing body, not ignorable, not a colour, not the customer's own code."""
    def bad(s: Column) -> Column:
        t = E.strip(s)
        n = normal_standard(s)
        return (
            (t != "") & ~n.isin(R.STANDARD_IGNORE) & ~t.rlike(R.STANDARD_IGNORE_PATTERN) & ~t.rlike(R.RAL_AS_STANDARD)
            & ~n.rlike(_ANY_BODY) & ~_own_spec(t)
        )
    return _typed(F.transform(F.filter("standards", bad), lambda s: E.finding(
        "SUSPICIOUS_STANDARD", "HIGH", "standards", E.strip(s), F.concat(F.lit("no known issuing body: "), E.strip(s)))))


def internal_specs() -> Column:
    """V5 CUSTOMER_INTERNAL_SPEC: standards that are the customer's own codes."""
    hit = F.filter(F.transform("standards", E.strip), lambda s: (s != "") & _own_spec(s))
    return _typed(F.transform(hit, lambda s: E.finding(
        "CUSTOMER_INTERNAL_SPEC", "INFO", "standards", s, F.concat(F.lit("own code of the customer: "), s))))


# ------------------------------------------------------------------ V6, V7
def process_gaps() -> Column:
    """V6: a preparation or post-process keyword in the notes that no additional process mentions."""
    text = F.upper(F.concat_ws(" | ", F.flatten(F.transform("additional_processes", lambda p: F.array(
        *[F.coalesce(p[c], F.lit("")) for c in ("name_en", "name_he", "details")])))))
    notes = F.coalesce("notes", F.lit(""))
    gap = lambda pattern: notes.rlike(pattern) & ~F.coalesce(text.rlike(pattern), F.lit(False))
    return F.concat(
        E.findings_if(gap(R.SURFACE_PREP), E.finding("MISSING_SURFACE_PREP", "HIGH", "additional_processes", F.lit(
            "Pickling / surface preparation"), "in the notes but not among the processes")),
        E.findings_if(gap(R.POST_PROCESS), E.finding("MISSING_POST_PROCESS", "HIGH", "additional_processes", F.lit(
            "Hydrogen Embrittlement / post-plate treatment"), "in the notes but not among the processes")),
    )


def party_prefix() -> Column:
    """V7 CUSTOMER_PREFIX_MISMATCH: the longest known part-number prefix belongs to another customer (``_pn_owner``)."""
    pn, cust = E.key(F.col("part_number")), E.strip(F.col("customer"))
    owner = F.col("_pn_owner")
    bad = (
        (pn != "") & (cust != "") & owner.isNotNull()
        & ~F.upper(cust).contains(F.upper(owner)) & ~F.upper(owner).contains(F.upper(cust))
    )
    value = F.concat(F.lit("PN="), pn, F.lit(", customer='"), cust, F.lit("'"))
    return E.findings_if(bad, E.finding("CUSTOMER_PREFIX_MISMATCH", "HIGH", "customer", value,
                                        F.concat(F.lit("prefix belongs to "), owner)))


# ------------------------------------------------------------------ V8
_TEMPLATES = tuple(t.upper() for t in R.PACKING_TEMPLATES)


@F.pandas_udf(T.DoubleType())
def _best_template_ratio(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in parts:
        # packing notes recur: each text of a batch is compared once
        done = {s: max(SequenceMatcher(None, s, t).ratio() for t in _TEMPLATES) for s in {s for s in batch if s is not None}}
        yield batch.map(lambda s: None if s is None else done[s]).astype("float64")


def packing_text() -> Column:
    en = F.coalesce(F.col("packaging_notes")["en"], F.lit(""))
    return E.strip(F.when(en != "", en).otherwise(F.col("packaging_notes")["he"]))


def with_packing_ratio(records: DataFrame) -> DataFrame:
    """Adds ``_packing_ratio``; only texts that no cheaper test decides reach Python."""
    t = F.upper(packing_text())
    open_case = (F.length(t) >= 10) & ~t.contains("NO_PACKING_REQUIREMENT") & ~E.contains_any(t, R.PACKING_TEMPLATES)
    return records.withColumn("_packing_ratio", _best_template_ratio(F.when(open_case, t)))


def packing() -> Column:
    """V8: explicit none, missing, or unlike every known packing note (``_packing_ratio`` below 0.45)."""
    t = packing_text()
    none = F.upper(t).contains("NO_PACKING_REQUIREMENT")
    src = "packaging_notes"
    return (
        F.when(none, F.array(E.finding("NO_PACKING_REQUIREMENT_IN_DRAWING", "INFO", src, t,
                                       "marked as having none")))
        .when(F.length(t) < 10, F.array(E.finding("MISSING_PACKING", "MEDIUM", src, F.lit("(empty)"), "no packing note")))
        .when(F.col("_packing_ratio") < 0.45, F.array(E.finding(
            "UNUSUAL_PACKING_NOTE", "HIGH", src, t, "unlike the known notes")))
        .otherwise(_EMPTY())
    ).cast(E.NO_FINDINGS)


# ------------------------------------------------------------------ V9
def ground_standards(records: DataFrame, texts: DataFrame) -> DataFrame:
    """V9: keep the standards found in the source text; ``_flagged`` holds the others.

    Standards stay in their array, so a text meets its record once whatever the
    number of standards. Records without text keep their standards.
    """
    grep = texts.select("record_id", E.plain_grounding(F.col("text")).alias("_text")).where("_text <> ''")
    df = records.join(grep, "record_id", "left")
    std = F.filter(F.transform("standards", E.strip), lambda s: s != "")

    def found(s: Column) -> Column:
        plain = E.plain_grounding(s)
        core = E.plain_grounding(F.try_element_at(F.split(s, r"(?i)\s+(?:TYPE|CLASS|GRADE|METHOD)\b", 2), F.lit(1)))
        return ((plain != "") & F.col("_text").contains(plain)) | ((F.length(core) >= 6) & F.col("_text").contains(core))

    checked = F.col("_text").isNotNull() & (F.size("standards") > 0)
    none = F.array().cast("array<string>")
    return df.withColumns({
        "_flagged": F.when(checked, F.filter(std, lambda s: ~found(s))).otherwise(none),
        "standards": F.when(checked, F.filter(std, found)).otherwise(F.col("standards")),
    }).select(*records.columns, "_flagged")


def grounding() -> Column:
    return _typed(F.transform("_flagged", lambda s: E.finding(
        "POSSIBLE_HALLUCINATION", "WARN", "standards", s, F.concat(F.lit("not in the source text: "), s))))


# ------------------------------------------------------------------ V10 .. V13
def spec_prefix() -> Column:
    """V10 LOWERCASE_SPEC_PREFIX."""
    hit = F.filter(F.transform("standards", E.strip), lambda s: s.rlike(R.LOWERCASE_SPEC))
    return _typed(F.transform(hit, lambda s: E.finding("LOWERCASE_SPEC_PREFIX", "WARN", "standards", s, "prefix in lower case")))


def part_completeness() -> Column:
    """Packing, serviceability tag and general instructions of PART records."""
    part = E.key(F.col("assembly_role")) == "PART"
    en, he = E.strip(F.col("packaging_notes")["en"]), E.strip(F.col("packaging_notes")["he"])
    explicit = F.upper(en).contains("NO_PACKING_REQUIREMENT") | F.upper(he).contains("NO_PACKING_REQUIREMENT")
    final = F.upper(F.concat_ws(" ", F.transform("final_approval", lambda s: F.concat_ws(" ", s["name_en"], s["name_he"]))))
    tag = (F.size("final_approval") > 0) & ~final.contains("SERVICEABILITY") & ~final.contains("תקינות")
    info = lambda t, src, msg: E.finding(t, "INFO", src, F.lit(""), msg)
    return F.concat(
        E.findings_if(part & explicit, info("NO_PACKING_REQUIREMENT_IN_DRAWING", "packaging_notes", "marked as having none")),
        E.findings_if(part & ~explicit & (en == "") & (he == ""), info("MISSING_PACKING", "packaging_notes", "no packing section")),
        E.findings_if(part & tag, info("MISSING_SERVICEABILITY_TAG", "final_approval", "no serviceability tag step")),
        E.findings_if(part & (F.size("general_instructions") <= 0),
                      info("MISSING_GENERAL_INSTRUCTIONS", "general_instructions", "no general instructions")),
    )


def obsolete_spec() -> Column:
    """V12 POSSIBLE_OBSOLETE_SPEC: a QQ- specification in the material."""
    m = E.strip(F.col("material"))
    return E.findings_if(m.rlike(r"(?i)\bQQ-[A-Z]"), E.finding("POSSIBLE_OBSOLETE_SPEC", "INFO", "material", m, "often replaced"))


def filename_mismatch() -> Column:
    """V13 FILENAME_PN_MISMATCH: the file name holds another part number (needs column ``narrow``)."""
    pn, nar = E.strip(F.col("part_number")), F.col("narrow")
    bad = (
        (nar != "") & (pn != "") & (F.upper(nar) != F.upper(pn))
        & (D.identifier_distance(F.upper(pn), F.upper(nar)) > 2)
    )
    return E.findings_if(F.coalesce(bad, F.lit(False)), E.finding(
        "FILENAME_PN_MISMATCH", "WARN", "source_filename", pn, F.concat(F.lit("file name contains "), nar)))


def role_changes() -> Column:
    """Findings of the role step (column ``role_rule``)."""
    return E.findings_if(F.col("role_rule") != "", F.struct(
        F.col("role_rule").alias("type"), F.lit("INFO").alias("severity"), F.lit("assembly_role").alias("source"),
        F.col("assembly_role").alias("value"), F.lit("role set from the BOM").alias("message")))


def prefix_changes() -> Column:
    """Findings of the drawing-prefix step (columns ``prefix_finding``, ``prefix_used``)."""
    sev = F.when(F.col("prefix_finding") == "DWG_PREFIX_REORDERED", "INFO").otherwise("WARN")
    return E.findings_if(F.col("prefix_finding") != "", F.struct(
        F.col("prefix_finding").alias("type"), sev.alias("severity"), F.lit("drawing_number").alias("source"),
        F.col("drawing_number").alias("value"), F.concat(F.lit("customer prefix "), F.col("prefix_used")).alias("message")))


# ------------------------------------------------------------------ dimension columns used by rules
def _compiles(pattern: Column) -> Column:
    """Can the pattern be used, on its own and as part of a larger one? Told on the JVM, without failing the query."""
    at_start = F.concat(F.lit("(?i)^(?:"), pattern, F.lit(")"))
    ok = lambda c: F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), c).isNotNull()
    return F.coalesce(ok(pattern) & ok(at_start), F.lit(False))


def broken_patterns(internal_spec: DataFrame) -> DataFrame:
    """Dimension rows that no rule can use, with the reason; all other rows keep working."""
    blank = E.strip(F.col("customer")) == ""
    reason = F.when(blank, "blank customer").when(F.col("pattern").isNull(), "no pattern").when(~_compiles(F.col("pattern")), "does not compile")
    return internal_spec.select("customer", "pattern", reason.alias("reason")).where("reason IS NOT NULL")


def with_own_patterns(records: DataFrame, internal_spec: DataFrame) -> DataFrame:
    """Adds ``_own_patterns``: the internal patterns of the record's customer, null if there are none.

    Each dimension row is compiled once here, and rows that do not compile are left out (see ``broken_patterns``), so that one
    of them cannot fail the findings of all records. A customer's patterns become one alternation; only those that refer to
    groups stay apart. Records without customer are spread, as they match nothing.
    """
    p = F.col("pattern")
    apart = p.rlike(r"\\[1-9k]|\(\?<[A-Za-z]")
    sets = internal_spec.where((E.strip(F.col("customer")) != "") & _compiles(p)).groupBy(F.col("customer").alias("_cust")).agg(
        F.sort_array(F.collect_set(F.when(~apart, p))).alias("plain"), F.sort_array(F.collect_set(F.when(apart, p))).alias("apart"))
    one = F.array(F.concat_ws("|", F.transform("plain", lambda x: F.concat(F.lit("(?:"), x, F.lit(")")))))
    per = sets.select("_cust", F.when(F.size("plain") > 0, F.concat(one, "apart")).otherwise(F.col("apart")).alias("_own_patterns"))
    return records.withColumn("_cust", E.join_key(E.strip(F.col("customer")))).join(per, "_cust", "left").drop("_cust")


def with_pn_owner(records: DataFrame, pn_prefix: DataFrame) -> DataFrame:
    """Adds ``_pn_owner``, the customer of the longest known prefix of the part number.

    Every leading substring of a distinct part number is an equi-join key, so
    no pair of part number and prefix is formed that does not match. Records
    without part number have no owner and are spread.
    """
    df = records.withColumn("_pn", E.key(F.col("part_number")))
    lead = F.transform(F.sequence(F.lit(1), F.length("_pn")), lambda n: F.substr("_pn", F.lit(1), n))
    owner = (
        df.select("_pn").where("_pn <> ''").distinct()
        .select("_pn", F.explode(lead).alias("prefix"))
        .join(pn_prefix.select("prefix", "customer"), "prefix")
        .groupBy("_pn").agg(F.max_by("customer", F.length("prefix")).alias("_pn_owner"))
    )
    return df.withColumn("_pn", E.join_key(F.col("_pn"))).join(owner, "_pn", "left").drop("_pn")


# ------------------------------------------------------------------ V16, V17, V18
Rule = Callable[[], Column]
DEFAULT_RULES: dict[str, Rule] = {
    "standards_body": standards_body, "process_gaps": process_gaps, "ral_codes": ral_codes,
    "paint_brands": paint_brands, "coating_class": coating_class,
}
ALL_RULES: dict[str, Rule] = {**DEFAULT_RULES, "internal_specs": internal_specs, "party_prefix": party_prefix, "packing": packing}


def usable_rules(records: DataFrame, rules: dict[str, Rule]) -> tuple[dict[str, Rule], dict[str, str]]:
    """Rules whose columns exist, and the reason for each that must be left out."""
    good, skipped = {}, {}
    for name, rule in rules.items():
        try:
            records.select(rule())
            good[name] = rule
        except AnalysisException as e:
            skipped[name] = str(e).split("\n")[0]
    return good, skipped


def collect_findings(records: DataFrame, rules: dict[str, Rule], keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """The findings of all rules, one row each, in one pass over the records."""
    arrays = [r() for r in rules.values()]
    return records.select(*keep, F.explode(F.concat(*arrays)).alias("f")).select(*keep, "f.*")


def findings_from_strings(records: DataFrame, keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """``[SEVERITY][TYPE] message`` strings as findings columns."""
    p = r"^\[([^\]]+)\]\[([^\]]+)\]\s*(.*)$"
    return records.select(*keep, F.explode("_pn_warnings").alias("w")).select(
        *keep,
        F.regexp_extract("w", p, 2).alias("type"),
        F.regexp_extract("w", p, 1).alias("severity"),
        F.regexp_extract("w", r"'([^']+)'", 1).alias("value"),
        F.regexp_extract("w", p, 3).alias("message"),
    )


def batch_findings(records: DataFrame) -> DataFrame:
    """Record-level findings raised to the batch, with the file they come from."""
    return findings_from_strings(records, ("batch_id", "source_filename"))


def explain_findings(findings: DataFrame) -> DataFrame:
    """Severity label and what to check: exact type, else the first hint contained in the type, else a default."""
    t = F.upper(F.trim(F.coalesce("type", F.lit(""))))
    exact = E.first_of(F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in R.ACTION_HINTS]), lambda h: h["k"] == t
    ))["v"]
    part = E.first_of(F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in R.ACTION_HINTS]), lambda h: t.contains(h["k"])
    ))["v"]
    sev = F.upper(F.coalesce("severity", F.lit("LOW")))
    label = F.lit(R.SEVERITY_LABELS[-1][1])
    for k, v in R.SEVERITY_LABELS:
        label = F.when(sev == k, v).otherwise(label)
    return findings.withColumns({"severity_label": label, "hint": F.coalesce(exact, part, F.lit(R.DEFAULT_HINT))})


def retry_queue(records: DataFrame) -> DataFrame:
    """Records with at least two of part number, material and drawing number empty."""
    empty = sum((E.strip(F.col(c)) == "").cast("int") for c in ("part_number", "material", "drawing_number"))
    return records.withColumn("n_empty", empty.cast("bigint")).where("n_empty >= 2")
