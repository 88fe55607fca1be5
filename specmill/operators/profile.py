"""Profiles of record tables: completeness, frequencies, quality scores, flat export tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmill import refdata as R
from specmill import schemas
from specmill.functions import exprs as E

COMPLETENESS_FIELDS = ["part_number", "drawing_number", "customer", "material", "revision", "cage_code", "title"]
LIST_FIELDS = ["standards", "bom_items", "machining_processes", "coating_processes", "additional_processes", "revisions_history"]
PROCESS_LISTS = [*schemas.STEP_LISTS, *schemas.COATING_LISTS]


def _size(c: str) -> Column:
    return F.coalesce(F.size(F.col(c)), F.lit(0)).cast("bigint")


def _unpivot(row: DataFrame, names: list[str], parts: list[str], label: str) -> DataFrame:
    """One-row wide aggregate with columns ``<name>__<part>`` to one row per name."""
    items = F.array(*[F.struct(F.lit(n).alias(label), *[F.col(f"{n}__{p}").alias(p) for p in parts]) for n in names])
    return row.select(F.explode(items).alias("x")).select("x.*")


# ------------------------------------------------------------------ A7, A8, A9, A10
def field_completeness(records: DataFrame, fields: list[str] = COMPLETENESS_FIELDS) -> DataFrame:
    """Filled / total / percent per field, in one aggregation."""
    agg = [F.count_if(~E.key(F.col(f)).isin(*[m for m in R.EMPTY_MARKERS if m != "NULL"])).alias(f"{f}__filled") for f in fields]
    row = records.agg(F.count("*").alias("n"), *agg)
    row = row.withColumns({f"{f}__n": F.col("n") for f in fields}).withColumns(
        {f"{f}__percent": F.floor(F.col(f"{f}__filled") * 100 / F.col("n")).cast("bigint") for f in fields})
    return _unpivot(row, fields, ["filled", "n", "percent"], "field")


def list_field_stats(records: DataFrame, fields: list[str] = LIST_FIELDS) -> DataFrame:
    """Total, empties, average (one decimal) and maximum per list field."""
    agg = []
    for f in fields:
        n = _size(f)
        agg += [F.sum(n).alias(f"{f}__total"), F.count_if(n == 0).alias(f"{f}__empty"),
                F.round(F.sum(n) / F.count("*"), 1).alias(f"{f}__avg"), F.max(n).alias(f"{f}__max")]
    return _unpivot(records.agg(*agg), fields, ["total", "empty", "avg", "max"], "field")


def findings_by_type(findings: DataFrame) -> DataFrame:
    """Findings and records per severity and type (grouping sets), most frequent first within a kind."""
    g = findings.select("record_id", F.coalesce("severity", F.lit("?")).alias("severity"), F.coalesce("type", F.lit("?")).alias("type"))
    out = g.groupingSets([["severity"], ["type"]], "severity", "type").agg(
        F.grouping("type").alias("gt"), F.count("*").alias("count"), F.count_distinct("record_id").alias("records"))
    return out.select(F.when(F.col("gt") == 1, "severity").otherwise("type").alias("kind"),
                      F.when(F.col("gt") == 1, F.col("severity")).otherwise(F.col("type")).alias("value"), "count", "records")


def severity_card(records: DataFrame) -> DataFrame:
    """A9 per record: counts of the four shown severities; anything else counts as LOW."""
    sev = F.transform("_validation_warnings", lambda w: F.upper(F.coalesce(w["severity"], F.lit("LOW"))))
    shown = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    norm = F.transform(sev, lambda s: F.when(s.isin(shown), s).otherwise("LOW"))
    count = lambda v: F.size(F.filter("_s", lambda s: s == v)).cast("bigint").alias(v.lower())
    return records.withColumn("_s", norm).select("record_id", *[count(v) for v in shown])


def value_frequencies(records: DataFrame, field: str) -> DataFrame:
    """A10: non-empty values of a field with counts and the share of records, most frequent first."""
    v = records.select("record_id", E.strip(F.col(field)).alias("value")).where("value <> ''")
    return v.groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")


def flagged_frequencies(findings: DataFrame, records: DataFrame, top: int = 20) -> DataFrame:
    """A10: the ``top`` flagged values (a report), with records affected and the share of all records."""
    n = records.agg(F.count("*")).scalar()
    per = findings.groupBy("value").agg(F.count("*").alias("count"), F.count_distinct("record_id").alias("records"))
    return per.orderBy(F.desc("count"), "value").limit(top).select(
        "value", "count", "records", F.round(F.col("records") * 100 / F.greatest(n, F.lit(1)), 1).alias("percent"))


# ------------------------------------------------------------------ A11, A12, A13
def _weight(c: str) -> Column:
    q, u = F.coalesce(F.col(c)["qty"], F.lit("")), F.coalesce(F.col(c)["unit"], F.lit(""))
    return F.trim(F.concat_ws(" ", q, u))


def record_summary(records: DataFrame) -> DataFrame:
    """One row per record with list sizes, weights and the joined environment text."""
    sizes = {"bom_count": "bom_items", "standard_count": "standards", **{f"{c}_count": c for c in PROCESS_LISTS if c not in ("final_approval", "additional_processes")}}
    return records.select(
        "record_id", "source_filename", "part_number", "drawing_number", "revision", "customer", "title", "material", "quantity",
        "catalog_number", "cage_code", _weight("raw_weight").alias("raw_weight"), _weight("part_weight").alias("part_weight"),
        "alternative_material", "material_formerly", "os_level",
        F.concat_ws("; ", F.filter("environment_requirements", lambda x: x != "")).alias("environment"), "assembly_role",
        *[_size(c).alias(n) for n, c in sizes.items()], F.coalesce("_ocr_used", F.lit(False)).alias("ocr_used"),
        F.col("_cost_info.total_cost_usd").cast("double").alias("cost_usd"))


def flatten_bom(records: DataFrame) -> DataFrame:
    return records.select(F.col("part_number").alias("parent_part_number"), "source_filename", "record_id", F.posexplode("bom_items").alias("pos", "b")).select(
        "record_id", "parent_part_number", "source_filename", F.col("pos").cast("bigint").alias("pos"), "b.*")


def flatten_process(records: DataFrame, field: str) -> DataFrame:
    """One row per step of a process list, with its file and part number."""
    return records.select("record_id", "source_filename", "part_number", F.posexplode(field).alias("pos", "s")).select(
        "record_id", "source_filename", "part_number", F.col("pos").cast("bigint").alias("pos"), "s.*")


def flatten_standards(records: DataFrame) -> DataFrame:
    return records.select("record_id", "source_filename", "part_number", F.explode("standards").alias("standard"))


def flatten_extras(records: DataFrame) -> DataFrame:
    """Additional steps, packaging and notes in one typed table, from one pass."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    row = lambda kind, en, he, details: F.struct(F.lit(kind).alias("kind"), en.alias("en"), he.alias("he"), details.alias("details"))
    steps = F.transform("additional_processes", lambda s: row(
        "process", blank(s["name_en"]), blank(s["name_he"]),
        F.when((blank(s["step_no"]) != "") | (blank(s["details"]) != ""),
               F.btrim(F.concat(blank(s["step_no"]), F.lit(" | "), blank(s["details"])), F.lit(" |"))).otherwise("")))
    p = F.col("packaging_notes")
    pack = F.array(F.when((blank(p["en"]) != "") | (blank(p["he"]) != ""), row("packaging", blank(p["en"]), blank(p["he"]), blank(p["step_no"]))))
    notes = F.array(F.when(E.strip(F.col("notes")) != "", row("notes", F.lit(""), E.strip(F.col("notes")), F.lit(""))))
    return records.select("record_id", "source_filename", "part_number", F.explode(F.concat(steps, pack, notes)).alias("x")).where(
        "x IS NOT NULL").select("record_id", "source_filename", "part_number", "x.*")


# ------------------------------------------------------------------ A15, A16, W4
def quality_score(records: DataFrame) -> DataFrame:
    """0-100 points per record in six groups."""
    has = lambda c: E.strip(F.col(c)) != ""
    pts = lambda cond, n: F.when(cond, n).otherwise(0)
    in_name = E.plain_batch(F.col("source_filename")).contains(E.plain_batch(F.col("part_number")))
    identity = (pts(has("part_number"), 6) + pts(has("part_number") & in_name, 3) + pts(has("drawing_number"), 4)
                + pts(has("customer"), 6) + pts(has("title"), 3) + pts(has("revision"), 3))
    mat = E.strip(F.col("material"))
    material = pts(mat != "", 8) + pts(F.length(mat) > 20, 4) + pts(mat.rlike(r"(?i)\b(?:AMS|ASTM|MIL|QQ|SAE|EN)[\s\-\d]"), 3)
    n = _size("standards")
    hits = lambda mark: F.size(F.filter("_pn_warnings", lambda w: w.contains(mark)))
    clean = F.greatest(n - hits("SUSPICIOUS_STANDARD") - hits("POSSIBLE_HALLUCINATION"), F.lit(0))
    standards = F.when(n > 0, 5 + F.floor(clean * 10 / n)).otherwise(0)
    role = F.upper(F.coalesce("assembly_role", F.lit(""))) == "ASSEMBLY"
    processes = F.lit(0)
    for c, w in R.QUALITY_PROCESS_POINTS:
        half = pts(role, w // 2) if c in ("machining_processes", "coating_processes", "painting_processes") else F.lit(0)
        processes = processes + F.when(_size(c) > 0, w).otherwise(half)
    processes = F.least(processes, F.lit(25))
    revs = _size("revisions_history")
    meta = pts(F.coalesce("_ocr_used", F.lit(False)), 3) + pts(revs > 0, 3) + pts(revs > 1, 1) + pts(has("cage_code"), 3)
    warnings = F.greatest(F.lit(0), 10 - 2 * F.size(F.filter("_pn_warnings", lambda w: w.contains("[HIGH]"))))
    parts = {"identity": identity, "material": material, "standards": standards, "processes": processes, "meta": meta, "warnings": warnings}
    df = records.select("record_id", "source_filename", *[p.cast("bigint").alias(f"pts_{k}") for k, p in parts.items()])
    return df.withColumn("total", sum((F.col(f"pts_{k}") for k in parts), F.lit(0)).cast("bigint"))


def quality_distribution(scores: DataFrame, order: list[str], latest: int = 10) -> DataFrame:
    """A16 + W4: average, upper median, best and worst of the ``latest`` scored records."""
    last = scores.orderBy(*[F.desc(c) for c in order]).limit(latest)
    arr = F.sort_array(F.collect_list("total"))
    return last.agg(arr.alias("t")).where("size(t) > 0").select(
        F.size("t").cast("bigint").alias("n"), F.round(F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + x) / F.size("t"), 1).alias("average"),
        F.get("t", F.floor(F.size("t") / 2).cast("int")).alias("median"), F.array_max("t").alias("best"), F.array_min("t").alias("worst"))


# ------------------------------------------------------------------ A17, A18, A22
def first_of_content(records: DataFrame, scope: list[str]) -> DataFrame:
    """Adds ``_first``: is this the first record, by file name, of its content within the scope?

    The first record is found by map-side aggregation and joined back on its own
    ``record_id``, so thousands of copies of one file never meet in one task. A
    record without fingerprint is a content of its own.
    """
    first = records.where("fingerprint IS NOT NULL").groupBy(*scope, "fingerprint").agg(
        F.min(F.struct("source_filename", "record_id"))["record_id"].alias("record_id"))
    joined = records.join(first.select("record_id", F.lit(True).alias("_first")), "record_id", "left")
    return joined.withColumn("_first", F.coalesce("_first", F.col("fingerprint").isNull()))


def batch_issues(records: DataFrame, texts: DataFrame, clues: list[str] = R.CUSTOMER_CLUES_DEFAULT) -> DataFrame:
    """(batch_id, source_filename, issue, value) for fifteen kinds of issue.

    One record per content: later files with the same fingerprint are reported
    as duplicates only. Each text is reduced beside its record; issues come from
    one pass over the joined rows.
    """
    df = first_of_content(records, ["batch_id"])
    again = df.where("NOT _first").select("batch_id", "source_filename", F.lit("duplicates").alias("issue"), F.lit("").alias("value"))
    df = df.where("_first")
    src = texts.select("record_id", F.upper("text").alias("_text"))
    df = df.join(src, "record_id", "left").withColumns({
        "_compact": E.plain_text(F.col("_text")), "_pn": E.plain_text(F.col("part_number"))})
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    issue = lambda cond, name, value=F.lit(""): F.array(F.when(cond, F.struct(F.lit(name).alias("issue"), value.alias("value"))))
    clue = F.lit("?")
    for c in reversed(clues):
        clue = F.when(F.col("_text").contains(c), c).otherwise(clue)
    quoted = lambda mark, name: F.transform(
        F.filter("_pn_warnings", lambda x: x.contains(mark) & x.rlike(r"'[^']+'")),
        lambda x: F.struct(F.lit(name).alias("issue"), F.regexp_extract(x, r"'([^']+)'", 1).alias("value")))
    marked = lambda cond, name: F.transform(F.filter("_pn_warnings", cond), lambda x: F.struct(F.lit(name).alias("issue"), F.lit("").alias("value")))
    std = lambda cond, name: F.transform(F.filter("standards", cond), lambda s: F.struct(F.lit(name).alias("issue"), s.alias("value")))
    found = df.select("batch_id", "source_filename", F.explode(F.concat(
        issue(~blank("part_number") & ~F.coalesce((F.col("_pn") != "") & F.col("_compact").contains(F.col("_pn")), F.lit(False)), "pn_not_in_text", F.col("part_number")),
        issue(blank("customer"), "customer_empty_but_clue", clue),
        issue(blank("cage_code"), "cage_empty"), issue(blank("material"), "material_empty"), issue(blank("title"), "title_empty"),
        issue(~F.coalesce("_ocr_used", F.lit(False)), "ocr_false"), issue(_size("revisions_history") == 0, "revisions_empty"),
        quoted("SUSPICIOUS_STANDARD", "suspicious_standards"), quoted("POSSIBLE_HALLUCINATION", "possible_hallucination"),
        marked(lambda x: x.contains("MISSING_SERVICEABILITY_TAG"), "missing_serviceability"),
        marked(lambda x: x.contains("MISSING_PACKING") & ~x.contains("NO_PACKING"), "missing_packing"),
        std(lambda s: F.regexp_extract(F.upper(E.strip(s)), r"^(\S*)", 1).isin(R.TEST_METHODS), "misclass_test_method_as_std"),
        std(lambda s: E.key(s) == "ISO STANDARDS", "standards_is_generic"),
        std(lambda s: s.rlike(r"PS[\s\-]\s+|\s+PS[\s\-]"), "spec_prefix_issue"),
    )).alias("x")).where("x IS NOT NULL").select("batch_id", "source_filename", "x.issue", "x.value")
    return found.unionByName(again)


def issue_report(issues: DataFrame) -> DataFrame:
    return issues.groupBy("batch_id", "issue").agg(F.count("*").alias("count"), F.count_distinct("value").alias("values"))


def suspicious_values(records: DataFrame) -> DataFrame:
    """Short or lower-case customers, short materials, long revisions, generic part numbers."""
    cu, ma, re_, pn = (E.strip(F.col(c)) for c in ("customer", "material", "revision", "part_number"))
    hit = lambda cond, name, v: F.when(cond, F.struct(F.lit(name).alias("kind"), v.alias("value")))
    return records.select("record_id", "source_filename", F.explode(F.array(
        hit((cu != "") & (F.length(cu) < 4), "SHORT_CUSTOMER", cu),
        hit((F.length(cu) > 1) & (F.lower(cu) == cu) & cu.rlike(r"\p{L}"), "LOWERCASE_CUSTOMER", cu),
        hit((ma != "") & (F.length(ma) < 5), "SHORT_MATERIAL", ma),
        hit(F.length(re_) > 3, "WEIRD_REVISION", re_),
        hit(pn.rlike(r"(?i)^(?:ITEM|PART)\s+\d+$"), "GENERIC_PN", pn),
    )).alias("x")).where("x IS NOT NULL").select("record_id", "source_filename", "x.*")


def batch_profile(records: DataFrame) -> DataFrame:
    """One profile row per distinct file content, with "part number appears in the file name"."""
    pn = F.coalesce("part_number", F.lit(""))
    return first_of_content(records, []).where("_first").select(
        "batch_id", "record_id", "source_filename", "part_number", "revision", "customer", "cage_code",
        _size("bom_items").alias("bom"), _size("revisions_history").alias("revisions"), _size("standards").alias("standards"),
        _size("_pn_warnings").alias("warnings"), F.col("_cost_info.total_cost_usd").alias("cost_usd"), "assembly_role",
        ((pn != "") & E.plain_batch(F.col("source_filename")).contains(E.plain_batch(pn))).alias("pn_in_filename"))


def profile_totals(profile: DataFrame) -> DataFrame:
    filled = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return profile.groupBy("batch_id").agg(
        F.count("*").alias("n"), filled("customer").alias("customer_set"), filled("cage_code").alias("cage_set"),
        F.count_if("pn_in_filename").alias("pn_in_filename"), F.sum("bom").alias("bom_items"), F.sum("warnings").alias("warnings"),
        F.sum("cost_usd").cast("double").alias("cost_usd"))


# ------------------------------------------------------------------ A21, W6
def result_inventory(files: DataFrame) -> DataFrame:
    """Files and megabytes per stored version; ``files`` has name and length."""
    v = F.regexp_extract("name", r"^(v\d+)_", 1)
    return files.groupBy(v.alias("version")).agg(
        F.count("*").alias("count"), F.round(F.sum("length") / F.lit(1024.0 * 1024.0), 2).alias("size_mb"))


def stale_results(files: DataFrame, keep: int = 1) -> DataFrame:
    """Files of all but the ``keep`` newest numeric versions.

    Versions are ranked after reduction to their distinct values, so no window
    sees the files themselves.
    """
    v = files.withColumn("version", F.regexp_extract("name", r"^v(\d+)_", 1).try_cast("bigint")).where("version IS NOT NULL")
    newest = v.groupBy("version").agg(F.lit(1).alias("one")).orderBy(F.desc("version")).limit(keep).select("version")
    return v.join(newest, "version", "left_anti").select("name", "version")


def export_table_set(records: DataFrame, tree: DataFrame | None = None, image_tree: DataFrame | None = None) -> dict[str, DataFrame]:
    """The named tables of the export; of a batch also its product tree and its linked overview items."""
    from specmill.operators import ledger

    out = {"summary": record_summary(records), "bom": flatten_bom(records), "standards": flatten_standards(records),
           "extras": flatten_extras(records), "costs": ledger.cost_sheet(records)}
    for c in PROCESS_LISTS:
        if c != "additional_processes":
            out[c] = flatten_process(records, c)
    return out | {k: v for k, v in (("tree", tree), ("image_tree", image_tree)) if v is not None}
