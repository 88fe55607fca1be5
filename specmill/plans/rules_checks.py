"""Queries and checking SQL for the validation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from specmill import refdata as R
from specmill.functions import exprs as E
from specmill.operators import rules as V
from specmill.operators import standardise as N
from specmill.plans.sqltext import anyof, cap, check, distance, inn, key, lit, lst, rx, strip, sub
from specmill.plans.standardise_checks import CANDIDATES
from specmill.sources.adapter import Tables

QUERIES = {}
CHECKS: dict[str, str] = {}
COLS = ["record_id", "type", "severity", "source", "value"]


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = check(sql)
        return fn
    return keep


def _run(df, **rules):
    return V.collect_findings(df, rules).select(*COLS)


def _f(type_: str, sev: str, src: str, value: str) -> str:
    return f"record_id, {type_} AS type, {sev} AS severity, {src} AS source, {value} AS value"


_RAL = f"""SELECT record_id, 'INVALID_RAL' AS type, 'CRITICAL' AS severity, source, 'RAL ' || code AS value FROM (
 SELECT record_id, source, lpad(unnest(regexp_extract_all(coalesce(txt, ''), '(?i)RAL\\s*(\\d{{3,4}})', 1)), 4, '0') AS code FROM (
  SELECT record_id, coalesce(p.step_no, 'painting') AS source, p.name AS txt FROM (SELECT record_id, unnest(painting_processes) AS p FROM records)
  UNION ALL SELECT record_id, coalesce(p.step_no, 'painting'), p.standard FROM (SELECT record_id, unnest(painting_processes) AS p FROM records)
  UNION ALL SELECT record_id, 'standards', unnest(standards) FROM records)) WHERE code NOT IN {inn(R.RAL_CODES)}"""


@query("v1_ral_codes", _RAL)
def v1(spark, sf):
    return _run(Tables(spark, sf).records(), ral=V.ral_codes)


_BRAND = f"""SELECT record_id, 'UNKNOWN_PAINT_BRAND' AS type, 'HIGH' AS severity, coalesce(p.step_no, 'painting') AS source, {cap('p.name', '(?i)' + R.BRAND_BY, 0)} AS value
FROM (SELECT record_id, unnest(painting_processes) AS p FROM records) WHERE NOT {anyof('upper(p.name)', R.PAINT_BRANDS)}
AND {cap('p.name', '(?i)' + R.BRAND_BY, 0)} <> '' AND upper({cap('p.name', '(?i)' + R.BRAND_BY, 2)}) NOT IN {inn(R.PAINT_BRANDS)}"""


@query("v2_paint_brands", _BRAND)
def v2(spark, sf):
    return _run(Tables(spark, sf).records(), brand=V.paint_brands)


_COAT = f"""SELECT record_id, 'MISCLASSIFIED_COATING' AS type, severity, source, n AS value FROM (
 SELECT record_id, coalesce(p.step_no, 'coating') AS source, upper(p.name) AS n,
 CASE WHEN {anyof('upper(p.name)', R.PAINT_WORDS)} AND NOT {anyof('upper(p.name)', R.PLATING_WORDS)} THEN 'HIGH'
 WHEN {anyof('upper(p.name)', R.MASKING_WORDS)} THEN 'MEDIUM' END AS severity
 FROM (SELECT record_id, unnest(coating_processes) AS p FROM records)) WHERE severity IS NOT NULL"""


@query("v3_coating_class", _COAT)
def v3(spark, sf):
    return _run(Tables(spark, sf).records(), coat=V.coating_class)


_NORM_STD = sub(sub("trim(regexp_replace(s, '\\s+', ' ', 'g'))", r"(?i)([A-Z])-\s+(\d)", r"\1-\2"), r"(\w)\.\s+(\d)", r"\1.\2")
_STD = f"""SELECT record_id, 'SUSPICIOUS_STANDARD' AS type, 'HIGH' AS severity, 'standards' AS source, t AS value FROM (
 SELECT record_id, customer, {strip('s')} AS t, upper({_NORM_STD}) AS n FROM (SELECT record_id, customer, unnest(standards) AS s FROM records)) x
WHERE t <> '' AND n NOT IN {inn(R.STANDARD_IGNORE)} AND NOT {rx('t', R.STANDARD_IGNORE_PATTERN)} AND NOT {rx('t', R.RAL_AS_STANDARD)}
AND NOT ({' OR '.join(rx('n', '(?i)^' + p) for p in R.STANDARD_BODIES)})
AND NOT EXISTS (SELECT 1 FROM dim_internal_spec d WHERE d.customer = trim(x.customer) AND regexp_matches(x.t, '(?i)' || d.pattern))"""


@query("v4_standards_body", _STD)
def v4(spark, sf):
    t = Tables(spark, sf)
    return _run(V.with_own_patterns(t.records(), t.flat("dim_internal_spec")), std=V.standards_body)


_OWN = """SELECT record_id, 'CUSTOMER_INTERNAL_SPEC' AS type, 'INFO' AS severity, 'standards' AS source, x.t AS value FROM (
 SELECT record_id, customer, trim(unnest(standards)) AS t FROM records) x JOIN dim_internal_spec d
 ON d.customer = trim(x.customer) AND regexp_matches(x.t, '(?i)' || d.pattern) WHERE x.t <> ''"""


@query("v5_internal_specs", _OWN)
def v5(spark, sf):
    t = Tables(spark, sf)
    return _run(V.with_own_patterns(t.records(), t.flat("dim_internal_spec")), own=V.internal_specs)


_GAPS = f"""SELECT record_id, type, 'HIGH' AS severity, 'additional_processes' AS source, value FROM (
 SELECT record_id, notes, upper(array_to_string(flatten(list_transform(additional_processes, lambda p: [p.name_en, p.name_he, p.details])), ' | ')) AS a FROM records) r,
 (VALUES ('MISSING_SURFACE_PREP', 'Pickling / surface preparation', {lit(R.SURFACE_PREP)}),
  ('MISSING_POST_PROCESS', 'Hydrogen Embrittlement / post-plate treatment', {lit(R.POST_PROCESS)})) k(type, value, p)
 WHERE regexp_matches(notes, p) AND NOT regexp_matches(a, p)"""


@query("v6_process_gaps", _GAPS)
def v6(spark, sf):
    return _run(Tables(spark, sf).records(), gaps=V.process_gaps)


_OWNER = f"""SELECT record_id, 'CUSTOMER_PREFIX_MISMATCH' AS type, 'HIGH' AS severity, 'customer' AS source,
 'PN=' || pn || ', customer=''' || cu || '''' AS value FROM (
 SELECT record_id, {key('part_number')} AS pn, {strip('r.customer')} AS cu, arg_max(d.customer, length(d.prefix)) AS owner
 FROM records r JOIN dim_pn_prefix d ON starts_with({key('r.part_number')}, d.prefix) GROUP BY 1, 2, 3)
 WHERE cu <> '' AND NOT contains(upper(cu), upper(owner)) AND NOT contains(upper(owner), upper(cu))"""


@query("v7_party_prefix", _OWNER)
def v7(spark, sf):
    t = Tables(spark, sf)
    return _run(V.with_pn_owner(t.records(), t.flat("dim_pn_prefix")), owner=V.party_prefix)


@query("v8_packing")
def v8(spark, sf):
    return _run(V.with_packing_ratio(Tables(spark, sf).records()), packing=V.packing)


_PLAIN = "regexp_replace(upper({}), '[\\s\\-._/]+', '', 'g')"
GROUND = f"""g AS (SELECT r.record_id, s, contains(tx, {_PLAIN.format('s')}) OR
  (length({_PLAIN.format('core')}) >= 6 AND contains(tx, {_PLAIN.format('core')})) AS ok FROM (
  SELECT r.record_id, trim(unnest(r.standards)) AS s, {_PLAIN.format('t.text')} AS tx FROM records r JOIN texts t USING (record_id)) r,
  LATERAL (SELECT regexp_split_to_array(s, '(?i)\\s+(?:TYPE|CLASS|GRADE|METHOD)\\b')[1] AS core) WHERE s <> '' AND tx <> '')"""


@query("v9_grounding", f"WITH {GROUND} SELECT record_id, 'POSSIBLE_HALLUCINATION' AS type, 'WARN' AS severity, 'standards' AS source, s AS value FROM g WHERE NOT ok")
def v9(spark, sf):
    t = Tables(spark, sf)
    return _run(V.ground_standards(t.records(), t.flat("texts")), ground=V.grounding)


@query("v9_kept_standards", f"""WITH {GROUND}, k AS (SELECT record_id, string_agg(s, '|' ORDER BY s) AS kept FROM g WHERE ok GROUP BY 1),
h AS (SELECT DISTINCT record_id FROM g)
SELECT r.record_id, CASE WHEN h.record_id IS NOT NULL THEN coalesce(k.kept, '') ELSE array_to_string(list_sort(r.standards), '|') END AS standards
FROM records r LEFT JOIN h USING (record_id) LEFT JOIN k USING (record_id)""")
def v9_kept(spark, sf):
    t = Tables(spark, sf)
    return V.ground_standards(t.records(), t.flat("texts")).select("record_id", E.joined_sorted(F.col("standards")).alias("standards"))


@query("v10_spec_prefix", f"SELECT record_id, 'LOWERCASE_SPEC_PREFIX' AS type, 'WARN' AS severity, 'standards' AS source, s AS value FROM (SELECT record_id, trim(unnest(standards)) AS s FROM records) WHERE {rx('s', R.LOWERCASE_SPEC)}")
def v10(spark, sf):
    return _run(Tables(spark, sf).records(), low=V.spec_prefix)


@query("v11_part_completeness", f"""
WITH p AS (SELECT *, trim(packaging_notes.en) AS en, trim(packaging_notes.he) AS he,
 upper(array_to_string(list_transform(final_approval, lambda s: s.name_en || ' ' || s.name_he), ' ')) AS fin FROM records WHERE {key('assembly_role')} = 'PART'),
e AS (SELECT *, contains(upper(en), 'NO_PACKING_REQUIREMENT') OR contains(upper(he), 'NO_PACKING_REQUIREMENT') AS ex FROM p)
SELECT record_id, 'NO_PACKING_REQUIREMENT_IN_DRAWING' AS type, 'INFO' AS severity, 'packaging_notes' AS source, '' AS value FROM e WHERE ex
UNION ALL SELECT record_id, 'MISSING_PACKING', 'INFO', 'packaging_notes', '' FROM e WHERE NOT ex AND en = '' AND he = ''
UNION ALL SELECT record_id, 'MISSING_SERVICEABILITY_TAG', 'INFO', 'final_approval', '' FROM e WHERE len(final_approval) > 0 AND NOT contains(fin, 'SERVICEABILITY') AND NOT contains(fin, 'תקינות')
UNION ALL SELECT record_id, 'MISSING_GENERAL_INSTRUCTIONS', 'INFO', 'general_instructions', '' FROM e WHERE len(general_instructions) = 0""")
def v11(spark, sf):
    return _run(Tables(spark, sf).records(), part=V.part_completeness)


@query("v12_obsolete_spec", "SELECT record_id, 'POSSIBLE_OBSOLETE_SPEC' AS type, 'INFO' AS severity, 'material' AS source, trim(material) AS value FROM records WHERE regexp_matches(material, '(?i)\\bQQ-[A-Z]')")
def v12(spark, sf):
    return _run(Tables(spark, sf).records(), qq=V.obsolete_spec)


@query("v13_filename_mismatch", f"""WITH {CANDIDATES}, u AS (SELECT record_id, {strip('part_number')} AS pn, {key('part_number')} AS pu, upper(narrow) AS nu FROM cand)
SELECT record_id, 'FILENAME_PN_MISMATCH' AS type, 'WARN' AS severity, 'source_filename' AS source, pn AS value FROM u WHERE nu <> '' AND pu <> '' AND {distance('pu', 'nu')} > 2""")
def v13(spark, sf):
    return _run(N.identifier_candidates(Tables(spark, sf).records()), name=V.filename_mismatch)


@query("v16_collect_findings", " UNION ALL ".join(f"SELECT record_id, type, severity, source, value FROM ({s})" for s in (_STD, _GAPS, _RAL, _BRAND, _COAT, _OWN, _OWNER)))
def v16(spark, sf):
    t = Tables(spark, sf)
    df = V.with_pn_owner(V.with_own_patterns(t.records(), t.flat("dim_internal_spec")), t.flat("dim_pn_prefix"))
    rules, _ = V.usable_rules(df, V.ALL_RULES)  # the packing rule needs its ratio column and is left out here
    return V.collect_findings(df, rules).select(*COLS)


_P = "^\\[([^\\]]+)\\]\\[([^\\]]+)\\]\\s*(.*)$"


@query("v16_batch_findings", f"""SELECT batch_id, source_filename, {cap('w', _P, 2)} AS type, {cap('w', _P, 1)} AS severity,
regexp_extract(w, '''([^'']+)''', 1) AS value, {cap('w', _P, 3)} AS message FROM (SELECT batch_id, source_filename, unnest(_pn_warnings) AS w FROM records)""")
def v16_batch(spark, sf):
    return V.batch_findings(Tables(spark, sf).records())


_HINTS = lst(k for k, _ in R.ACTION_HINTS)
_TEXTS = lst(v for _, v in R.ACTION_HINTS)


@query("v17_explain_findings", f"""
WITH f AS (SELECT record_id, unnest(_validation_warnings) AS w FROM records),
g AS (SELECT record_id, w.type AS type, upper(coalesce(w.severity, 'LOW')) AS sev FROM f),
h AS (SELECT *, coalesce(list_position({_HINTS}, upper(type)), list_position({_HINTS}, list_filter({_HINTS}, lambda k: contains(upper(type), k))[1])) AS p FROM g)
SELECT record_id, type, CASE sev {' '.join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in R.SEVERITY_LABELS)} ELSE {lit(R.SEVERITY_LABELS[-1][1])} END AS severity_label,
CASE WHEN p IS NULL THEN {lit(R.DEFAULT_HINT)} ELSE {_TEXTS}[p] END AS hint FROM h""")
def v17(spark, sf):
    f = Tables(spark, sf).records().select("record_id", F.explode("_validation_warnings").alias("w")).select("record_id", "w.*")
    return V.explain_findings(f).select("record_id", "type", "severity_label", "hint")


@query("v18_retry_queue", """SELECT * FROM (SELECT record_id, batch_id,
CAST((trim(part_number) = '')::INT + (trim(material) = '')::INT + (trim(drawing_number) = '')::INT AS BIGINT) AS n_empty FROM records) WHERE n_empty >= 2""")
def v18(spark, sf):
    return V.retry_queue(Tables(spark, sf).records()).select("record_id", "batch_id", "n_empty")
