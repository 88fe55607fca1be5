"""Queries and checking SQL for ledgers and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from specmill import refdata as R
from specmill.functions import exprs as E  # noqa: F401
from specmill.operators import ledger as L
from specmill.operators import profile as P
from specmill.plans.sqltext import check, inn, key, lit, strip
from specmill.sources.adapter import Tables

QUERIES = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = check(sql)
        return fn
    return keep


def _dbl(df, *cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


PRICED = """pc AS (SELECT *, CASE WHEN contains(lower(model), 'mini') THEN 0.15 WHEN contains(lower(model), '5.4') OR contains(lower(model), 'gpt-5') THEN 2.50 ELSE 2.50 END AS pi,
 CASE WHEN contains(lower(model), 'mini') THEN 0.60 WHEN contains(lower(model), '5.4') OR contains(lower(model), 'gpt-5') THEN 15.00 ELSE 10.00 END AS po FROM calls),
pd AS (SELECT *, CAST(input_tokens AS DECIMAL(18,0)) * CAST(pi AS DECIMAL(6,2)) * 1.20 AS ri, CAST(output_tokens AS DECIMAL(18,0)) * CAST(po AS DECIMAL(6,2)) * 1.20 AS ro FROM pc),
pr AS (SELECT *, round(ri * CAST(0.000001 AS DECIMAL(7,6)), 6) AS ci, round(ro * CAST(0.000001 AS DECIMAL(7,6)), 6) AS co, CAST(round((ri + ro) * CAST(0.000001 AS DECIMAL(7,6)), 6) AS DECIMAL(18,6)) AS ct FROM pd)"""


@query("a1_price_calls", f"WITH {PRICED} SELECT call_id, model, CAST(ci AS DOUBLE) AS input_cost_usd, CAST(co AS DOUBLE) AS output_cost_usd, CAST(ct AS DOUBLE) AS total_cost_usd FROM pr")
def a1(spark, sf):
    df = L.price_calls(Tables(spark, sf).flat("calls"))
    return _dbl(df, "input_cost_usd", "output_cost_usd", "total_cost_usd").select("call_id", "model", "input_cost_usd", "output_cost_usd", "total_cost_usd")


for _name, _by in (("a1_costs_per_record", ["record_id"]), ("a1_costs_per_stage", ["stage", "model"])):
    _g = ", ".join(_by)

    def _make(by):
        def fn(spark, sf):
            return _dbl(L.rollup_costs(L.price_calls(Tables(spark, sf).flat("calls")), by), "total_cost_usd", "total_cost_ils")
        return fn

    query(_name, f"""WITH {PRICED} SELECT {_g}, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    CAST(sum(ct) AS DOUBLE) AS total_cost_usd, CAST(round(sum(ct) * 3.7, 4) AS DOUBLE) AS total_cost_ils FROM pr GROUP BY {_g}""")(_make(_by))


@query("a2_cost_summary", f"""WITH {PRICED} SELECT count(*) AS count, CAST(round(sum(ct), 4) AS DOUBLE) AS total_cost_usd, CAST(round(CAST(sum(ct) AS DOUBLE) / count(*), 4) AS DOUBLE) AS avg_cost_usd,
CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens FROM pr HAVING count(*) > 0""")
def a2(spark, sf):
    return _dbl(L.cost_summary(L.price_calls(Tables(spark, sf).flat("calls"))), "total_cost_usd", "avg_cost_usd")


_H = "hh AS (SELECT coalesce(mode, 'unknown') AS mode, coalesce(review_status, 'pending') AS st, cost_usd AS c, cache_hit AS h FROM history)"
_HA = "count(*) AS count, CAST(sum(c) AS DOUBLE) AS total_cost_usd, round(CAST(sum(c) AS DOUBLE) / count(*), 6) AS avg_cost_usd, count(*) FILTER (h) AS cache_hits, round(count(*) FILTER (h) / count(*), 3) AS cache_hit_rate FROM hh"


@query("a3_history_summary", f"WITH {_H} SELECT 'total' AS kind, '' AS value, {_HA} UNION ALL SELECT 'mode', mode, {_HA} GROUP BY mode UNION ALL SELECT 'review_status', st, {_HA} GROUP BY st")
def a3(spark, sf):
    return _dbl(L.history_summary(Tables(spark, sf).flat("history")), "total_cost_usd", "avg_cost_usd", "cache_hit_rate")


@query("a4_daily_costs", "SELECT strftime(timestamp, '%Y-%m-%d') AS day, CAST(round(sum(cost_usd), 4) AS DOUBLE) AS cost_usd, count(*) AS count FROM history GROUP BY 1")
def a4(spark, sf):
    return _dbl(L.daily_costs(Tables(spark, sf).flat("history")), "cost_usd")


@query("a5_roi_summary", """WITH a AS (SELECT count(*) AS n, CAST(sum(cost_usd) AS DOUBLE) AS c FROM history)
SELECT n AS count, n * 20 / 60.0::DOUBLE AS saved_hours, n * 20 / 60.0::DOUBLE * 80 AS saved_money, c AS cost_usd, n * 20 / 60.0::DOUBLE * 80 - c AS net_savings, (n * 20 / 60.0::DOUBLE * 80) / c AS multiple FROM a""")
def a5(spark, sf):
    return L.roi_summary(Tables(spark, sf).flat("history"))


@query("a6_audit_summary", """SELECT 'action' AS kind, action AS value, count(*) AS count FROM audit GROUP BY 2
UNION ALL SELECT 'user', "user", count(*) FROM audit WHERE "user" <> '' GROUP BY 2 UNION ALL SELECT 'total', '', count(*) FROM audit""")
def a6(spark, sf):
    return L.audit_summary(Tables(spark, sf).flat("audit"))


@query("w2_newest_history", "SELECT event_id, filename, mode FROM history ORDER BY timestamp DESC, event_id DESC LIMIT 200")
def w2(spark, sf):
    return L.newest(Tables(spark, sf).flat("history"), 200, ["timestamp", "event_id"]).select("event_id", "filename", "mode")


@query("w2_newest_audit", "SELECT event_id, action, subject FROM audit WHERE action = 'export' AND \"user\" = 'u7' ORDER BY timestamp DESC, event_id DESC LIMIT 100")
def w2_audit(spark, sf):
    a = Tables(spark, sf).flat("audit").where("action = 'export' AND user = 'u7'")
    return L.newest(a, 100, ["timestamp", "event_id"]).select("event_id", "action", "subject")


# --- A7 .. A10
_MARKS = [m for m in R.EMPTY_MARKERS if m != "NULL"]


@query("a7_field_completeness", " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) FILTER ({key(f)} NOT IN {inn(_MARKS)}) AS filled, count(*) AS n, CAST(count(*) FILTER ({key(f)} NOT IN {inn(_MARKS)}) * 100 // count(*) AS BIGINT) AS percent FROM records"
    for f in P.COMPLETENESS_FIELDS))
def a7(spark, sf):
    return P.field_completeness(Tables(spark, sf).records())


@query("a8_list_field_stats", " UNION ALL ".join(
    f"SELECT '{f}' AS field, CAST(sum(len({f})) AS BIGINT) AS total, count(*) FILTER (len({f}) = 0) AS empty, round(sum(len({f})) / count(*), 1) AS avg, CAST(max(len({f})) AS BIGINT) AS max FROM records"
    for f in P.LIST_FIELDS))
def a8(spark, sf):
    return P.list_field_stats(Tables(spark, sf).records())


_W = "ww AS (SELECT record_id, w.type AS type, w.severity AS severity FROM (SELECT record_id, unnest(_validation_warnings) AS w FROM records))"


@query("a9_findings_by_type", f"WITH {_W} SELECT 'severity' AS kind, coalesce(severity, '?') AS value, count(*) AS count, count(DISTINCT record_id) AS records FROM ww GROUP BY 2 UNION ALL SELECT 'type', type, count(*), count(DISTINCT record_id) FROM ww GROUP BY 2")
def a9(spark, sf):
    f = Tables(spark, sf).records().select("record_id", F.explode("_validation_warnings").alias("w")).select("record_id", "w.*")
    return P.findings_by_type(f)


@query("a9_severity_card", "SELECT record_id, " + ", ".join(
    f"CAST(len(list_filter(_validation_warnings, lambda w: {c})) AS BIGINT) AS {n}" for n, c in (
        ("critical", "w.severity = 'CRITICAL'"), ("high", "w.severity = 'HIGH'"), ("medium", "w.severity = 'MEDIUM'"),
        ("low", "coalesce(w.severity, 'LOW') NOT IN ('CRITICAL', 'HIGH', 'MEDIUM')"))) + " FROM records")
def a9_card(spark, sf):
    return P.severity_card(Tables(spark, sf).records())


@query("a10_value_frequencies", f"SELECT 'customer' AS field, {strip('customer')} AS value, count(*) AS count FROM records WHERE {strip('customer')} <> '' GROUP BY 2 UNION ALL SELECT 'cage_code', {strip('cage_code')}, count(*) FROM records WHERE {strip('cage_code')} <> '' GROUP BY 2")
def a10(spark, sf):
    r = Tables(spark, sf).records()
    return P.value_frequencies(r, "customer").select(F.lit("customer").alias("field"), "value", "count").unionByName(
        P.value_frequencies(r, "cage_code").select(F.lit("cage_code").alias("field"), "value", "count"))


@query("a10_flagged_frequencies", """WITH f AS (SELECT record_id, unnest(standards) AS value FROM records)
SELECT value, count(*) AS count, count(DISTINCT record_id) AS records, round(count(DISTINCT record_id) * 100 / (SELECT count(*) FROM records), 1) AS percent
FROM f GROUP BY 1 ORDER BY count DESC, value LIMIT 20""")
def a10_flagged(spark, sf):
    r = Tables(spark, sf).records()
    return P.flagged_frequencies(r.select("record_id", F.explode("standards").alias("value")), r)


# --- A11 .. A14
@query("a11_record_summary", """SELECT record_id, source_filename, part_number, drawing_number, revision, customer, title, material, quantity, catalog_number, cage_code,
trim(raw_weight.qty || ' ' || raw_weight.unit) AS raw_weight, trim(part_weight.qty || ' ' || part_weight.unit) AS part_weight, alternative_material, material_formerly, os_level,
array_to_string(list_filter(environment_requirements, lambda x: x <> ''), '; ') AS environment, assembly_role, CAST(len(bom_items) AS BIGINT) AS bom_count, CAST(len(standards) AS BIGINT) AS standard_count,
""" + ", ".join(f"CAST(len({c}) AS BIGINT) AS {c}_count" for c in P.PROCESS_LISTS if c not in ("final_approval", "additional_processes")) + """, _ocr_used AS ocr_used, CAST(_cost_info.total_cost_usd AS DOUBLE) AS cost_usd FROM records""")
def a11(spark, sf):
    return P.record_summary(Tables(spark, sf).records())


@query("a12_flatten_bom", """SELECT record_id, part_number AS parent_part_number, source_filename, CAST(i - 1 AS BIGINT) AS pos, b.item_no AS item_no, b.part_number AS part_number, b.description AS description, b.qty AS qty
FROM (SELECT record_id, part_number, source_filename, unnest(bom_items) AS b, generate_subscripts(bom_items, 1) AS i FROM records)""")
def a12(spark, sf):
    return P.flatten_bom(Tables(spark, sf).records())


_STEP = "SELECT '{c}' AS process, record_id, source_filename, part_number, CAST(i - 1 AS BIGINT) AS pos, s.step_no AS step_no, s.name_en AS name_en, s.name_he AS name_he, s.details AS details FROM (SELECT record_id, source_filename, part_number, unnest({c}) AS s, generate_subscripts({c}, 1) AS i FROM records)"
_STEPS = ["machining_processes", "welding_processes", "heat_treatment_processes", "ndt_processes", "inspection_processes", "final_approval"]


@query("a12_flatten_steps", " UNION ALL ".join(_STEP.format(c=c) for c in _STEPS))
def a12_steps(spark, sf):
    r = Tables(spark, sf).records()
    out = None
    for c in _STEPS:
        one = P.flatten_process(r, c).select(F.lit(c).alias("process"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("a12_flatten_coatings", " UNION ALL ".join(
    f"SELECT '{c}' AS process, record_id, source_filename, part_number, CAST(i - 1 AS BIGINT) AS pos, s.step_no AS step_no, s.type AS type, s.name AS name, s.thickness AS thickness, s.standard AS standard, s.rohs AS rohs "
    f"FROM (SELECT record_id, source_filename, part_number, unnest({c}) AS s, generate_subscripts({c}, 1) AS i FROM records)" for c in ("coating_processes", "painting_processes")))
def a12_coatings(spark, sf):
    r = Tables(spark, sf).records()
    cols = ["process", "record_id", "source_filename", "part_number", "pos", "step_no", "type", "name", "thickness", "standard", "rohs"]
    a, b = (P.flatten_process(r, c).select(F.lit(c).alias("process"), "*").select(*cols) for c in ("coating_processes", "painting_processes"))
    return a.unionByName(b)


@query("a12_flatten_standards", "SELECT record_id, source_filename, part_number, unnest(standards) AS standard FROM records")
def a12_standards(spark, sf):
    return P.flatten_standards(Tables(spark, sf).records())


@query("a13_flatten_extras", """SELECT record_id, source_filename, part_number, 'process' AS kind, s.name_en AS en, s.name_he AS he,
 CASE WHEN s.step_no <> '' OR s.details <> '' THEN trim(s.step_no || ' | ' || s.details, ' |') ELSE '' END AS details FROM (SELECT *, unnest(additional_processes) AS s FROM records)
UNION ALL SELECT record_id, source_filename, part_number, 'packaging', packaging_notes.en, packaging_notes.he, packaging_notes.step_no FROM records WHERE packaging_notes.en <> '' OR packaging_notes.he <> ''
UNION ALL SELECT record_id, source_filename, part_number, 'notes', '', trim(notes), '' FROM records WHERE trim(notes) <> ''""")
def a13(spark, sf):
    return P.flatten_extras(Tables(spark, sf).records())


@query("a14_cost_sheet", """WITH c AS (SELECT source_filename, part_number, _cost_info AS x FROM records)
SELECT 'record' AS kind, source_filename, part_number, x.input_tokens AS input_tokens, x.output_tokens AS output_tokens, CAST(x.total_cost_usd AS DOUBLE) AS cost_usd, CAST(x.total_cost_ils AS DOUBLE) AS cost_ils FROM c
UNION ALL SELECT 'total', '', '', NULL, NULL, CAST(round(sum(x.total_cost_usd), 4) AS DOUBLE), CAST(round(sum(x.total_cost_usd) * 3.7, 2) AS DOUBLE) FROM c""")
def a14(spark, sf):
    return L.cost_sheet(Tables(spark, sf).records())


# --- A15, A16
def _quality_sql() -> str:
    pb = lambda x: f"regexp_replace(upper({x}), '[\\s\\-.,/_]', '', 'g')"
    b = lambda c, n: f"CASE WHEN {c} THEN {n} ELSE 0 END"
    f = lambda c: f"{strip(c)} <> ''"
    hits = lambda m: f"len(list_filter(_pn_warnings, lambda w: contains(w, '{m}')))"
    proc = " + ".join(
        f"CASE WHEN len({c}) > 0 THEN {w} WHEN {'upper(assembly_role) = ' + lit('ASSEMBLY') if c in ('machining_processes', 'coating_processes', 'painting_processes') else 'FALSE'} THEN {w // 2} ELSE 0 END"
        for c, w in R.QUALITY_PROCESS_POINTS)
    parts = {
        "identity": " + ".join([b(f("part_number"), 6), b(f"{f('part_number')} AND contains({pb('source_filename')}, {pb('part_number')})", 3), b(f("drawing_number"), 4),
                                b(f("customer"), 6), b(f("title"), 3), b(f("revision"), 3)]),
        "material": " + ".join([b(f("material"), 8), b("length(trim(material)) > 20", 4), b("regexp_matches(trim(material), '(?i)\\b(?:AMS|ASTM|MIL|QQ|SAE|EN)[\\s\\-\\d]')", 3)]),
        "standards": f"CASE WHEN len(standards) > 0 THEN 5 + greatest(len(standards) - {hits('SUSPICIOUS_STANDARD')} - {hits('POSSIBLE_HALLUCINATION')}, 0) * 10 // len(standards) ELSE 0 END",
        "processes": f"least(25, {proc})",
        "meta": " + ".join([b("_ocr_used", 3), b("len(revisions_history) > 0", 3), b("len(revisions_history) > 1", 1), b(f("cage_code"), 3)]),
        "warnings": f"greatest(0, 10 - 2 * {hits('[HIGH]')})",
    }
    cols = ", ".join(f"CAST({v} AS BIGINT) AS pts_{k}" for k, v in parts.items())
    return f"qs AS (SELECT record_id, source_filename, {cols} FROM records), qt AS (SELECT *, CAST({' + '.join('pts_' + k for k in parts)} AS BIGINT) AS total FROM qs)"


@query("a15_quality_score", f"WITH {_quality_sql()} SELECT * FROM qt")
def a15(spark, sf):
    return P.quality_score(Tables(spark, sf).records())


@query("a16_quality_distribution", f"""WITH {_quality_sql()}, l AS (SELECT total FROM qt ORDER BY record_id DESC LIMIT 10), o AS (SELECT list(total ORDER BY total) AS t FROM l)
SELECT CAST(len(t) AS BIGINT) AS n, round(list_sum(t) / len(t), 1) AS average, t[len(t) // 2 + 1] AS median, list_max(t) AS best, list_min(t) AS worst FROM o""")
def a16(spark, sf):
    return P.quality_distribution(P.quality_score(Tables(spark, sf).records()), ["record_id"])


# --- A17, A18, A22
_PT = "regexp_replace(upper({}), '[\\s\\-.,/]', '', 'g')"


@query("a17_batch_issues", f"""
WITH r0 AS (SELECT r.*, upper(t.text) AS tx, row_number() OVER (PARTITION BY batch_id, fingerprint ORDER BY source_filename, record_id) AS n FROM records r LEFT JOIN texts t USING (record_id)),
r1 AS (SELECT * FROM r0 WHERE n = 1), wn AS (SELECT batch_id, source_filename, unnest(_pn_warnings) AS w FROM r1), sd AS (SELECT batch_id, source_filename, unnest(standards) AS s FROM r1)
SELECT batch_id, source_filename, 'pn_not_in_text' AS issue, part_number AS value FROM r1 WHERE part_number <> '' AND NOT coalesce({_PT.format('part_number')} <> '' AND contains({_PT.format('tx')}, {_PT.format('part_number')}), FALSE)
UNION ALL SELECT batch_id, source_filename, 'customer_empty_but_clue', CASE WHEN contains(tx, 'SUPPLIER') THEN 'SUPPLIER' WHEN contains(tx, 'WORKS') THEN 'WORKS' ELSE '?' END FROM r1 WHERE customer = ''
UNION ALL SELECT batch_id, source_filename, 'cage_empty', '' FROM r1 WHERE cage_code = ''
UNION ALL SELECT batch_id, source_filename, 'material_empty', '' FROM r1 WHERE material = ''
UNION ALL SELECT batch_id, source_filename, 'title_empty', '' FROM r1 WHERE title = ''
UNION ALL SELECT batch_id, source_filename, 'ocr_false', '' FROM r1 WHERE NOT _ocr_used
UNION ALL SELECT batch_id, source_filename, 'revisions_empty', '' FROM r1 WHERE len(revisions_history) = 0
UNION ALL SELECT batch_id, source_filename, 'suspicious_standards', regexp_extract(w, '''([^'']+)''', 1) FROM wn WHERE contains(w, 'SUSPICIOUS_STANDARD') AND regexp_matches(w, '''[^'']+''')
UNION ALL SELECT batch_id, source_filename, 'possible_hallucination', regexp_extract(w, '''([^'']+)''', 1) FROM wn WHERE contains(w, 'POSSIBLE_HALLUCINATION') AND regexp_matches(w, '''[^'']+''')
UNION ALL SELECT batch_id, source_filename, 'missing_serviceability', '' FROM wn WHERE contains(w, 'MISSING_SERVICEABILITY_TAG')
UNION ALL SELECT batch_id, source_filename, 'missing_packing', '' FROM wn WHERE contains(w, 'MISSING_PACKING') AND NOT contains(w, 'NO_PACKING')
UNION ALL SELECT batch_id, source_filename, 'misclass_test_method_as_std', s FROM sd WHERE regexp_extract(upper(trim(s)), '^(\\S*)', 1) IN {inn(R.TEST_METHODS)}
UNION ALL SELECT batch_id, source_filename, 'standards_is_generic', s FROM sd WHERE upper(trim(s)) = 'ISO STANDARDS'
UNION ALL SELECT batch_id, source_filename, 'spec_prefix_issue', s FROM sd WHERE regexp_matches(s, 'PS[\\s\\-]\\s+|\\s+PS[\\s\\-]')
UNION ALL SELECT batch_id, source_filename, 'duplicates', '' FROM r0 WHERE n > 1""")
def a17(spark, sf):
    t = Tables(spark, sf)
    return P.batch_issues(t.records(), t.flat("texts"))


@query("a17_issue_report", "SELECT batch_id, issue, count(*) AS count, count(DISTINCT value) AS \"values\" FROM (" + "WITH " + CHECKS["a17_batch_issues"][5:] + ") GROUP BY 1, 2")
def a17_report(spark, sf):
    return P.issue_report(a17(spark, sf))


@query("a18_suspicious_values", f"""
SELECT record_id, source_filename, 'SHORT_CUSTOMER' AS kind, trim(customer) AS value FROM records WHERE trim(customer) <> '' AND length(trim(customer)) < 4
UNION ALL SELECT record_id, source_filename, 'LOWERCASE_CUSTOMER', trim(customer) FROM records WHERE length(trim(customer)) > 1 AND lower(trim(customer)) = trim(customer) AND regexp_matches(customer, '\\p{{L}}')
UNION ALL SELECT record_id, source_filename, 'SHORT_MATERIAL', trim(material) FROM records WHERE trim(material) <> '' AND length(trim(material)) < 5
UNION ALL SELECT record_id, source_filename, 'WEIRD_REVISION', trim(revision) FROM records WHERE length(trim(revision)) > 3
UNION ALL SELECT record_id, source_filename, 'GENERIC_PN', trim(part_number) FROM records WHERE regexp_matches(trim(part_number), '(?i)^(?:ITEM|PART)\\s+\\d+$')""")
def a18(spark, sf):
    return P.suspicious_values(Tables(spark, sf).records())


_PB = "regexp_replace(upper({}), '[\\s\\-.,/_]', '', 'g')"
_PROFILE = f"""pf AS (SELECT batch_id, record_id, source_filename, part_number, revision, customer, cage_code, CAST(len(bom_items) AS BIGINT) AS bom, CAST(len(revisions_history) AS BIGINT) AS revisions,
 CAST(len(standards) AS BIGINT) AS standards, CAST(len(_pn_warnings) AS BIGINT) AS warnings, _cost_info.total_cost_usd AS cost, assembly_role,
 part_number <> '' AND contains({_PB.format('source_filename')}, {_PB.format('part_number')}) AS pn_in_filename
 FROM records QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY source_filename, record_id) = 1)"""


@query("a22_batch_profile", f"WITH {_PROFILE} SELECT * EXCLUDE (cost), CAST(cost AS DOUBLE) AS cost_usd FROM pf")
def a22(spark, sf):
    return _dbl(P.batch_profile(Tables(spark, sf).records()), "cost_usd")


@query("a22_profile_totals", f"""WITH {_PROFILE} SELECT batch_id, count(*) AS n, count(*) FILTER (customer <> '') AS customer_set, count(*) FILTER (cage_code <> '') AS cage_set, count(*) FILTER (pn_in_filename) AS pn_in_filename,
CAST(sum(bom) AS BIGINT) AS bom_items, CAST(sum(warnings) AS BIGINT) AS warnings, CAST(sum(cost) AS DOUBLE) AS cost_usd FROM pf GROUP BY 1""")
def a22_totals(spark, sf):
    return P.profile_totals(P.batch_profile(Tables(spark, sf).records()))


# --- A19, A23
@query("a19_batch_outcome", """WITH d AS (SELECT *, CASE WHEN assembly_role = 'Assembly Overview Image' THEN 0 ELSE 1 END AS o FROM drawings)
SELECT batch_id, count(*) AS total, count(*) FILTER (NOT failed) AS succeeded, count(*) FILTER (failed) AS failed, CAST(coalesce(sum(cost_usd) FILTER (NOT failed), 0) AS DOUBLE) AS cost_usd,
CAST(coalesce(sum(warning_count) FILTER (NOT failed), 0) AS BIGINT) AS warning_count,
coalesce(arg_min(part_number, (o, pos, record_id)) FILTER (NOT failed AND upper(assembly_role) = 'ASSEMBLY'), arg_min(part_number, (o, pos, record_id)) FILTER (NOT failed), '') AS part_number,
coalesce(sum(cost_usd) FILTER (NOT failed), 0) = 0 AS cache_hit FROM d GROUP BY 1""")
def a19(spark, sf):
    return L.batch_outcome(Tables(spark, sf).drawings())


@query("a23_review_progress", """WITH p AS (SELECT batch_id, CASE WHEN part_number <> '' THEN part_number ELSE source_filename END AS pn, row_number() OVER (PARTITION BY batch_id ORDER BY pos, record_id) AS rn FROM drawings WHERE review_status <> 'reviewed'),
q AS (SELECT batch_id, string_agg(pn, ', ' ORDER BY rn) AS pending FROM p WHERE rn <= 5 GROUP BY 1)
SELECT c.batch_id, c.reviewed, c.total, coalesce(q.pending, '') AS pending FROM (SELECT batch_id, count(*) FILTER (review_status = 'reviewed') AS reviewed, count(*) AS total FROM drawings GROUP BY 1) c LEFT JOIN q USING (batch_id)""")
def a23(spark, sf):
    return L.review_progress(Tables(spark, sf).drawings())


# --- A21, W6: stored results, one per document
_FILES = "'v' || CAST(CAST(substr(source, 4) AS INT) % 7 + 20 AS {s}) || '_base_' || md5(text) || '.json' AS name, n_chars AS length"


@query("a21_result_inventory", f"WITH f AS (SELECT {_FILES.format(s='VARCHAR')} FROM documents) SELECT regexp_extract(name, '^(v\\d+)_', 1) AS version, count(*) AS count, round(sum(length) / (1024.0::DOUBLE * 1024.0), 2) AS size_mb FROM f GROUP BY 1")
def a21(spark, sf):
    return P.result_inventory(Tables(spark, sf).source("documents").selectExpr(_FILES.format(s="STRING").split(", n_chars")[0], "n_chars AS length"))


@query("w6_stale_results", f"WITH f AS (SELECT {_FILES.format(s='VARCHAR')} FROM documents), v AS (SELECT name, CAST(regexp_extract(name, '^v(\\d+)_', 1) AS BIGINT) AS version FROM f) SELECT name, version FROM v WHERE version NOT IN (SELECT DISTINCT version FROM v ORDER BY version DESC LIMIT 2)")
def w6(spark, sf):
    return P.stale_results(Tables(spark, sf).source("documents").selectExpr(_FILES.format(s="STRING").split(", n_chars")[0]), 2)


# --- S8: row counts of the export tables
@query("s8_export_table_set", " UNION ALL ".join(
    [f"SELECT '{n}' AS table_name, CAST(sum(len({c})) AS BIGINT) AS n_rows FROM records" for n, c in
     [("bom", "bom_items"), ("standards", "standards"), *[(c, c) for c in P.PROCESS_LISTS if c != "additional_processes"]]]
    + ["SELECT 'summary' AS table_name, count(*) AS n_rows FROM records", "SELECT 'costs', count(*) + 1 FROM records",
       "SELECT 'extras', CAST(sum(len(additional_processes) + (packaging_notes.en <> '' OR packaging_notes.he <> '')::INT + (trim(notes) <> '')::INT) AS BIGINT) FROM records"]))
def s8(spark, sf):
    out = None
    for name, df in P.export_table_set(Tables(spark, sf).records()).items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


# --- W4
@query("w4_latest_results", "SELECT record_id, source_filename FROM records ORDER BY record_id DESC LIMIT 10")
def w4(spark, sf):
    return L.newest(Tables(spark, sf).records().select("record_id", "source_filename"), 10, ["record_id"])
