"""Queries over the derived tables for the standardisation jobs, each with its checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmill import refdata as R
from specmill.functions import exprs as E
from specmill.operators import standardise as N
from specmill.plans.sqltext import (
    anyof, bare, cap, check, distance, groups, inn, jaccard, key, lit, lst, rx, shares4, stem, strip, sub,
)
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


# --- N1
def _narrow_sql(src: str, name: str) -> str:
    """Adds column ``narrow``."""
    s = f"SELECT *, upper({stem(name)}) AS s0 FROM {src}"
    for p in R.NARROW_DECORATIONS:
        s = f"SELECT * REPLACE (CASE WHEN starts_with(s0, {lit(p)}) THEN substr(s0, {len(p) + 1}) ELSE s0 END AS s0) FROM ({s})"
    s = (
        f"SELECT *, list_filter(flatten(list_transform(regexp_split_to_array(s0, '[-_()\\s]+'), lambda g: "
        f"regexp_extract_all(g, {lit(R.PN_NARROW)}, 1))), lambda c: length(c) BETWEEN 5 AND 15 AND NOT "
        f"{anyof('c', R.PN_BLACKLIST)}) AS found FROM ({s})"
    )
    listed = f"list_filter(found, lambda c: {' OR '.join(f'starts_with(c, {lit(p)})' for p in R.PN_PREFIXES)})"
    top = "list_max(list_transform(found, lambda c: length(c)))"
    return (
        f"SELECT * EXCLUDE (s0, found), coalesce({listed}[1], CASE WHEN {top} >= 6 THEN "
        f"list_filter(found, lambda c: length(c) = {top})[1] END, '') AS narrow FROM ({s})"
    )


def _generic_sql(src: str, name: str) -> str:
    """Adds column ``generic``."""
    cut = "CASE " + " ".join(f"WHEN starts_with(s0, {lit(p)}) THEN substr(s0, {len(p) + 1})" for p in R.GENERIC_DECORATIONS) + " ELSE s0 END"
    clean = sub(sub(sub(cut, r"-?\(\d{4,}\)$", ""), r"_(DRILL|PART|SHEET|PAS|\d{2})$", ""), r"#[^#]+#[^#]+#[^#]+_?\d*$", "")
    s = f"SELECT *, upper({stem(name)}) AS s0 FROM {src}"
    s = f"SELECT *, trim({clean}, '-_ .') AS s1 FROM ({s})"
    s = f"SELECT *, trim({sub('s1', R.PN_TAIL, '')}, '-_ .') AS s2, trim({cap('s1', R.PN_CORE)}, '-_ .') AS core FROM ({s})"

    def hit(x: str) -> str:
        return "coalesce(" + ", ".join(
            f"CASE WHEN length({cap(x, p)}) BETWEEN 5 AND 30 THEN {cap(x, p)} END" for p in R.PN_GENERIC
        ) + ")"

    return (
        f"SELECT * EXCLUDE (s0, s1, s2, core), coalesce(trim({hit('s1')}, '-_ .'), CASE WHEN length(core) BETWEEN 5 AND 30 THEN core END, "
        f"CASE WHEN s2 <> '' AND s2 <> s1 THEN {hit('s2')} END, '') AS generic FROM ({s})"
    )


CANDIDATES = f"cand AS ({_generic_sql('(' + _narrow_sql('records', 'source_filename') + ')', 'source_filename')})"


@query("n1_identifier_candidates", f"WITH {CANDIDATES} SELECT record_id, source_filename, narrow, generic FROM cand")
def n1(spark: SparkSession, sf: str) -> DataFrame:
    return N.identifier_candidates(Tables(spark, sf).records()).select("record_id", "source_filename", "narrow", "generic")


# --- N2
def _suspicious_sql(x: str) -> str:
    p, b = f"upper({x})", f"regexp_replace(upper({x}), '[ -]', '', 'g')"
    return (
        f"({x} <> '' AND ({rx(p, R.PN_ITEM_CELL)} OR {p} IN {inn(R.PN_HEADER_WORDS)} OR contains({x}, ' ') OR length({b}) < 5 "
        f"OR (regexp_full_match({b}, '\\d+') AND length({b}) < 7)))"
    )


def _n2_sql() -> str:
    digits = lambda x: f"length(regexp_extract({x}, '^\\p{{L}}{{2}}(\\d*)', 1))"
    compact = lambda x: f"regexp_replace(upper({x}), '[\\-\\s\\.]', '', 'g')"
    s = f"SELECT *, {strip('part_number')} AS pn, {strip('drawing_number')} AS dn FROM cand"
    s = f"SELECT *, pn AS pn0, dn AS dn0, upper(pn) AS pu, upper(narrow) AS nu, upper(generic) AS gu FROM ({s})"
    s = f"SELECT *, {distance('pu', 'nu')} AS d1, {distance('pu', 'gu')} AS d2 FROM ({s})"
    s = (
        "SELECT *, CASE WHEN pn = '' THEN NULL WHEN narrow <> '' AND d1 = 0 THEN NULL WHEN narrow <> '' AND d1 <= 2 THEN narrow "
        f"WHEN generic <> '' AND generic <> narrow AND d2 BETWEEN 1 AND 2 THEN generic END AS fix FROM ({s})"
    )
    s = f"SELECT * REPLACE (coalesce(fix, pn) AS pn, CASE WHEN fix IS NOT NULL AND dn = pn THEN fix ELSE dn END AS dn), CASE WHEN fix IS NOT NULL THEN 'distance' ELSE '' END AS pn_rule FROM ({s})"
    s = f"SELECT * EXCLUDE (pu), upper(pn) AS pu, upper(dn) AS du FROM ({s})"
    s = (
        "SELECT *, pn0 <> '' AND dn <> '' AND pn <> dn AND length(du) = length(pu) + 1 AND starts_with(du, pu) AND regexp_matches(du, '\\p{L}$') AS t1, "
        f"pn0 <> '' AND dn <> '' AND pn <> dn AND length(pu) = length(du) + 1 AND starts_with(pu, du) AND regexp_matches(pu, '\\p{{L}}$') AS t2 FROM ({s})"
    )
    s = (
        "SELECT * REPLACE (CASE WHEN t1 THEN dn ELSE pn END AS pn, CASE WHEN t2 THEN pn ELSE dn END AS dn, "
        f"CASE WHEN t1 THEN 'trailing_letter' ELSE pn_rule END AS pn_rule) FROM ({s})"
    )
    s = f"SELECT * EXCLUDE (pu, du), upper(pn) AS pu, upper(dn) AS du FROM ({s})"
    s = f"SELECT *, pn0 <> '' AND dn <> '' AND pn <> dn AND {distance('pu', 'du')} = 1 AS one FROM ({s})"
    s = f"SELECT *, one AND {digits('dn')} > {digits('pn')} AS take FROM ({s})"
    s = (
        "SELECT * REPLACE (CASE WHEN take THEN dn ELSE pn END AS pn, CASE WHEN one AND NOT take THEN pn ELSE dn END AS dn, "
        f"CASE WHEN take THEN 'unify' ELSE pn_rule END AS pn_rule) FROM ({s})"
    )
    s = f"SELECT * EXCLUDE (pu, du), upper(pn) AS pu, upper(dn) AS du, regexp_replace(upper(pn), '[-\\s]?[A-Z0-9]$', '') AS cut FROM ({s})"
    s = (
        f"SELECT *, pn0 <> '' AND generic <> '' AND gu <> pu AND NOT ({compact('pn')} <> '' AND contains({compact('generic')}, {compact('pn')})) "
        f"AND length(cut) >= 6 AND contains(gu, cut) AND length(generic) >= length(pn) + 2 AS hit FROM ({s})"
    )
    s = (
        "SELECT * REPLACE (CASE WHEN hit THEN generic ELSE pn END AS pn, CASE WHEN hit AND du = pu THEN generic ELSE dn END AS dn, "
        f"CASE WHEN hit THEN 'substring' ELSE pn_rule END AS pn_rule) FROM ({s})"
    )
    s = f"SELECT * EXCLUDE (pu, du, hit), upper(pn) AS pu, upper(dn) AS du, {bare('pn')} AS bp, {bare('generic')} AS bg FROM ({s})"
    s = (
        f"SELECT *, {distance('pu', 'gu')} AS far, {shares4('bp', 'bg')} AS shared, {_suspicious_sql('pn')} AS sus, {_suspicious_sql('dn')} AS dsus, "
        "list_filter(range(1, length(pu) + 1), lambda i: substr(pu, i, 1) <> substr(nu, i, 1)) AS diffs, "
        "regexp_extract_all(pn, '\\d+') AS dga, regexp_extract_all(generic, '\\d+') AS dgb, "
        f"list_filter(regexp_split_to_array(bp, ''), lambda c: c <> '') AS ca, list_filter(regexp_split_to_array(bg, ''), lambda c: c <> '') AS cb FROM ({s})"
    )
    s = (
        "SELECT *, pn0 <> '' AND generic <> '' AND gu <> pu AS live, narrow <> '' AND nu <> pu AND length(narrow) = length(pn) AND len(diffs) = 1 "
        "AND regexp_full_match(substr(pu, diffs[1], 1), '\\d') AND regexp_full_match(substr(nu, diffs[1], 1), '\\d') AS digit, "
        f"length(generic) >= 5 AND {jaccard('dga', 'dgb')} < 0.15 AND {jaccard('ca', 'cb')} < 0.4 AND NOT shared AND far > 3 AS r2, "
        "length(generic) >= 6 AND length(pn) >= 5 AND regexp_matches(ltrim(pn, '-_ '), '^\\p{L}') AND regexp_matches(ltrim(generic, '-_ '), '^\\d') AND NOT shared AS r25, "
        "length(pn) <= 8 AND length(generic) >= length(pn) + 2 AND len(list_filter(ca, lambda c: contains(bg, c)))::DOUBLE / greatest(length(bp), 1) >= 0.75 "
        f"AND far > 2 AND NOT shared AS r3 FROM ({s})"
    )
    s = (
        "SELECT *, CASE WHEN NOT live THEN NULL WHEN sus THEN generic WHEN digit THEN narrow WHEN r2 OR r25 OR r3 THEN generic END AS ov FROM (" + s + ")"
    )
    s = (
        "SELECT *, CASE WHEN pn0 = '' THEN CASE WHEN dn0 <> '' THEN dn0 ELSE narrow END WHEN ov IS NOT NULL THEN ov ELSE pn END AS p_out, "
        "CASE WHEN ov IS NOT NULL AND (du = pu OR (sus AND dsus)) THEN ov ELSE dn END AS d_out, "
        "CASE WHEN pn0 = '' AND (dn0 <> '' OR narrow <> '') THEN 'filled' WHEN ov IS NOT NULL THEN 'override' ELSE pn_rule END AS rule_out FROM (" + s + ")"
    )
    return f"WITH {CANDIDATES} SELECT record_id, p_out AS part_number, d_out AS drawing_number, rule_out AS pn_rule FROM ({s})"


@query("n2_reconcile_identifiers", _n2_sql())
def n2(spark, sf):
    return N.reconcile_identifiers(N.identifier_candidates(Tables(spark, sf).records())).select(
        "record_id", "part_number", "drawing_number", "pn_rule"
    )


_N2_WIDE = _n2_sql().replace(
    "SELECT record_id, p_out AS part_number, d_out AS drawing_number, rule_out AS pn_rule FROM", ", z AS (SELECT * FROM", 1
) + ")"


@query("n2_corrections", _N2_WIDE.replace(" , z AS", ", z AS", 1) + """
SELECT record_id, 'part_number' AS field, 'reconcile_identifiers' AS rule, part_number AS old, p_out AS new
FROM z WHERE part_number IS DISTINCT FROM p_out
UNION ALL
SELECT record_id, 'drawing_number', 'reconcile_identifiers', drawing_number, d_out FROM z WHERE drawing_number IS DISTINCT FROM d_out""")
def n2_corrections(spark, sf):
    job = lambda df: N.reconcile_identifiers(N.identifier_candidates(df))
    return N.job_corrections(job, Tables(spark, sf).records(), ["part_number", "drawing_number"], "reconcile_identifiers")


# --- N3, N4
@query("n3_fill_drawing_number", f"""
SELECT record_id, CASE WHEN {strip('part_number')} <> '' AND {key('drawing_number')} IN {inn(R.EMPTY_MARKERS)}
THEN {strip('part_number')} ELSE drawing_number END AS drawing_number FROM records""")
def n3(spark, sf):
    return N.fill_drawing_number(Tables(spark, sf).records()).select("record_id", "drawing_number")


@query("n4_reconcile_revisions", f"""
WITH a AS (SELECT *, {key('revision')} AS r FROM records),
b AS (SELECT *, CASE WHEN r = '' OR length(r) > 6 THEN revision
  WHEN regexp_full_match(r, 'R[A-Z]') THEN substr(r, 2)
  WHEN regexp_full_match(r, 'REV\\s+[A-Z0-9]+') THEN regexp_extract(r, 'REV\\s+(.*)', 1)
  WHEN regexp_full_match(r, 'REV[._-]\\s*[A-Z0-9]+') THEN regexp_extract(r, 'REV[._-]\\s*(.*)', 1) ELSE revision END AS r2,
  {strip('revisions_history[len(revisions_history)].rev')} AS last_rev,
  upper(regexp_extract({stem('source_filename')}, '(?i)(?:^|[_#\\-\\s])Rev\\.?[\\s_\\-]?([A-Z0-9]{{1,3}})(?:[_#\\-\\s.]|$)', 1)) AS file_rev FROM a)
SELECT record_id, CASE WHEN {key('r2')} NOT IN {inn(R.EMPTY_MARKERS)} THEN r2
  WHEN {key('last_rev')} NOT IN {inn(R.EMPTY_MARKERS)} THEN last_rev WHEN file_rev <> '' THEN file_rev ELSE r2 END AS revision FROM b""")
def n4(spark, sf):
    return N.reconcile_revisions(Tables(spark, sf).records()).select("record_id", "revision")


# --- N5
_PKEY = "trim(regexp_replace(regexp_replace(upper(coalesce({x}, '')), '[.,_/\\-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
PARTIES = f"""p1 AS (SELECT *, CASE WHEN regexp_full_match({key('cage_code')}, '[A-Z0-9]{{3,6}}') THEN {key('cage_code')} ELSE '' END AS cage1 FROM records),
p2 AS (SELECT p1.*, CASE WHEN {strip('p1.customer')} = '' THEN coalesce(c.customer, p1.customer) ELSE p1.customer END AS cust1
  FROM p1 LEFT JOIN dim_cage c ON c.cage = p1.cage1),
p3 AS (SELECT *, {_PKEY.format(x='cust1')} AS k FROM p2),
p4 AS (SELECT p3.*, coalesce((SELECT min(customer) FROM dim_alias a WHERE a.alias = p3.k),
  (SELECT arg_min(customer, ordinal) FROM dim_alias a WHERE length(alias) >= 6 AND starts_with(p3.k, a.alias || ' ')), {strip('cust1')}) AS cust2 FROM p3),
p5 AS (SELECT p4.*, CASE WHEN cage1 = '' THEN coalesce(d.cage, '') ELSE cage1 END AS cage2
  FROM p4 LEFT JOIN dim_default_cage d ON d.customer = p4.cust2)"""


@query("n5_normalise_parties", f"WITH {PARTIES} SELECT record_id, cust2 AS customer, cage2 AS cage_code FROM p5")
def n5(spark, sf):
    t = Tables(spark, sf)
    return N.normalise_parties(t.records(), t.flat("dim_cage"), t.flat("dim_default_cage"), t.flat("dim_alias")).select(
        "record_id", "customer", "cage_code")


# --- N6 (word-loop, rows only), N7
@query("n6_clean_bom_text")
def n6(spark, sf):
    df = N.clean_bom_text(Tables(spark, sf).records())
    return df.select("record_id", "bom_fixed", F.concat_ws("|", F.transform("bom_items", lambda b: b["description"])).alias("descriptions"))


def _phrases_sql(x: str) -> str:
    for p, r, _ in R.PHRASE_FIXES:
        x = sub(x, p, groups(r))
    return x


@query("n7_normalise_phrases", f"""
SELECT record_id, {_phrases_sql('notes')} AS notes,
array_to_string(list_transform(standards, lambda s: {_phrases_sql('s')}), '|') AS standards FROM records""")
def n7(spark, sf):
    df = N.normalise_phrases(Tables(spark, sf).records())
    return df.select("record_id", "notes", F.concat_ws("|", "standards").alias("standards"))


# every label, counted on the text as the earlier fixes left it
def _labels_sql() -> str:
    cur, parts = "s", []
    for p, r, label in R.PHRASE_FIXES:
        n = f"len(regexp_extract_all({cur}, {lit(p)}))"
        parts.append(f"CASE WHEN {n} > 0 THEN {lit(label + ' ×')} || CAST({n} AS VARCHAR) END")
        cur = sub(cur, p, groups(r))
    return "list_filter([" + ", ".join(parts) + "], lambda z: z IS NOT NULL)"


@query("n7_phrase_labels", f"""
WITH leaves AS (SELECT record_id, notes AS s FROM records UNION ALL SELECT record_id, unnest(standards) FROM records),
lab AS (SELECT record_id, unnest({_labels_sql()}) AS label FROM leaves)
SELECT label, count(DISTINCT record_id) AS n_records FROM lab GROUP BY label""")
def n7_labels(spark, sf):
    df = N.normalise_phrases(Tables(spark, sf).records())
    return df.select("record_id", F.explode("phrase_fixes").alias("label")).groupBy("label").agg(F.count("*").alias("n_records"))


# --- N8
def _looks(x: str) -> str:
    return anyof(f"upper({x})", R.MATERIAL_WORDS)


def _material_sql() -> str:
    noise = lambda u: anyof(u, R.MATERIAL_NOISE)
    direct = "coalesce(" + ", ".join(
        f"CASE WHEN length({c}) > 6 AND {_looks(c)} THEN {c} END"
        for c in (f"regexp_replace(trim({cap('text', p, 0)}, E' \\t\\n\\r'), '\\s+', ' ', 'g')" for p in R.MATERIAL_DIRECT)
    ) + ")"
    return f"""
ln AS (SELECT record_id, i, trim(line, E' \\t\\n\\r') AS line FROM (
  SELECT record_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e]')) AS line,
  generate_subscripts(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e]'), 1) AS i FROM texts)
  WHERE trim(line, E' \\t\\n\\r') <> ''),
lu AS (SELECT *, upper(line) AS u FROM ln),
lc AS (SELECT *, CASE WHEN NOT {noise('u')} AND u NOT IN {inn(R.MATERIAL_SKIP_LABELS)} AND length(line) >= 4
   AND regexp_matches(line, '\\p{{L}}') AND {_looks('line')} THEN line END AS cand,
   trim({cap('line', R.MATERIAL_LINE)}, E' \\t\\n\\r') AS inl FROM lu),
lw AS (SELECT *, lead(cand, 1) OVER w AS c1, lead(cand, 2) OVER w AS c2, lead(cand, 3) OVER w AS c3 FROM lc
   WINDOW w AS (PARTITION BY record_id ORDER BY i)),
lf AS (SELECT record_id, i, CASE WHEN {noise('u')} THEN NULL WHEN u IN {inn(R.MATERIAL_LABELS)} THEN coalesce(c1, c2, c3)
   WHEN inl <> '' AND NOT {noise('upper(inl)')} AND {_looks('inl')} THEN inl END AS m FROM lw),
lab AS (SELECT record_id, arg_min(m, i) AS labelled FROM lf WHERE m IS NOT NULL GROUP BY record_id),
tm AS (SELECT t.record_id, coalesce(l.labelled, {direct}) AS text_material FROM texts t LEFT JOIN lab l USING (record_id))"""


MATERIAL = _material_sql()
_INSTR = (
    f"({strip('material')} <> '' AND (" + " OR ".join(f"starts_with({key('material')}, {lit(p)})" for p in R.MATERIAL_INSTRUCTIONS)
    + f") AND NOT {_looks(strip('material'))})"
)


@query("n8_resolve_material", f"""
WITH {MATERIAL}, m1 AS (SELECT record_id, CASE WHEN {_INSTR} THEN '' ELSE material END AS material FROM records)
SELECT m1.record_id, CASE WHEN {strip('material')} = '' THEN coalesce(text_material, material) ELSE material END AS material
FROM m1 LEFT JOIN tm USING (record_id)""")
def n8(spark, sf):
    t = Tables(spark, sf)
    return N.resolve_material(t.records(), t.flat("texts")).select("record_id", "material")


@query("n8_material_from_text", f"WITH {MATERIAL} SELECT record_id, text_material FROM tm")
def n8_text(spark, sf):
    return N.material_from_text(Tables(spark, sf).flat("texts"))


# --- N9
@query("n9_split_formerly", f"""
WITH a AS (SELECT *, {strip('material')} AS m, {strip('material_formerly')} AS f FROM records),
b AS (SELECT *, f = '' AND {rx('m', R.FORMERLY)} AS hit FROM a)
SELECT record_id, CASE WHEN hit THEN rtrim(trim(regexp_replace(trim({sub('m', R.FORMERLY, '')}), '\\s{{2,}}', ' ', 'g')), '.,;') ELSE material END AS material,
CASE WHEN hit THEN rtrim(trim({cap('m', R.FORMERLY)}), '.,; ') ELSE material_formerly END AS material_formerly FROM b""")
def n9(spark, sf):
    return N.split_formerly(Tables(spark, sf).records()).select("record_id", "material", "material_formerly")


# --- N10
@query("n10_infer_roles", f"""
WITH e AS (SELECT record_id, {key('part_number')} AS pn, {strip('assembly_role')} AS role, len(bom_items) AS n,
  list_filter(list_transform(bom_items, lambda b: {key('b.part_number')}), lambda p: p <> '') AS items FROM records),
f AS (SELECT *, len(list_filter(items, lambda p: p <> pn)) AS others FROM e)
SELECT record_id, CASE WHEN pn <> '' AND len(items) > 0 AND others = 0 THEN 'PART' WHEN role <> '' THEN role
  WHEN others > 0 THEN 'ASSEMBLY' ELSE 'PART' END AS assembly_role,
CASE WHEN pn <> '' AND len(items) > 0 AND others = 0 THEN 'SELF_REF_BOM' WHEN role = '' THEN 'ROLE_AUTODETECTED' ELSE '' END AS role_rule,
CAST(CASE WHEN pn <> '' AND len(items) > 0 AND others = 0 THEN 0 ELSE n END AS BIGINT) AS bom_size FROM f""")
def n10(spark, sf):
    return N.infer_roles(Tables(spark, sf).records()).select(
        "record_id", "assembly_role", "role_rule", F.size("bom_items").cast("bigint").alias("bom_size"))


# --- N11
@query("n11_conform_drawing_prefix", f"""
WITH r AS (SELECT record_id, {strip('drawing_number')} AS d, {key('drawing_number')} AS du, {key('customer')} AS cu,
  {key('part_number')} AS pu, drawing_number FROM records),
own AS (SELECT upper(customer) AS cu, list(upper(prefix) ORDER BY ordinal, prefix) AS ps, min(ordinal) AS o FROM dim_pn_prefix GROUP BY 1),
imp AS (SELECT r.record_id, arg_min(o.ps, o.o) AS ps FROM r JOIN dim_pn_prefix p ON starts_with(r.pu, p.prefix) JOIN own o ON o.cu = upper(p.customer) GROUP BY 1),
j AS (SELECT r.*, coalesce(own.ps, imp.ps) AS ps FROM r LEFT JOIN own ON own.cu = r.cu LEFT JOIN imp ON imp.record_id = r.record_id),
k AS (SELECT *, d <> '' AND ps IS NOT NULL AND len(list_filter(ps, lambda p: starts_with(du, p))) = 0 AS applies,
  list_filter(ps, lambda p: contains(du, p))[1] AS hit FROM j)
SELECT record_id,
 CASE WHEN applies AND hit IS NOT NULL AND suffix(du, hit) THEN hit || substr(d, 1, length(d) - length(hit)) ELSE drawing_number END AS drawing_number,
 CASE WHEN NOT applies THEN '' WHEN hit IS NULL THEN 'DWG_PREFIX_MISSING' WHEN suffix(du, hit) THEN 'DWG_PREFIX_REORDERED' ELSE 'DWG_PREFIX_MISMATCH' END AS prefix_finding
FROM k""")
def n11(spark, sf):
    t = Tables(spark, sf)
    return N.conform_drawing_prefix(t.records(), t.flat("dim_pn_prefix")).select("record_id", "drawing_number", "prefix_finding")


# --- N12, N13
@query("n12_complete_overview_records", f"""
SELECT record_id, CASE WHEN {strip('part_number')} = '' THEN {stem('source_filename')} ELSE part_number END AS part_number, source_filename,
'Assembly Overview Image' AS assembly_role, coalesce(material, '') AS material, CAST(len(bom_items) AS BIGINT) AS bom_size, FALSE AS ocr_used FROM records""")
def n12(spark, sf):
    return N.complete_overview_records(Tables(spark, sf).records()).select(
        "record_id", "part_number", "source_filename", "assembly_role", "material",
        F.size("bom_items").cast("bigint").alias("bom_size"), F.col("_ocr_used").alias("ocr_used"))


def _relfix(x: str) -> str:
    for p, r in R.RELATION_FIXES:
        x = sub(x, p, groups(r))
    return x


_DAMAGED = "replace(replace(part_number, 'BP10', 'MIR-10'), 'BN', '1SO11833 BBO ')"


@query("n13_fix_relationship_text", f"SELECT batch_id, record_id, {_relfix(_DAMAGED)} AS part_number FROM drawings")
def n13(spark, sf):
    df = Tables(spark, sf).drawings().selectExpr("batch_id", "record_id", f"{_DAMAGED} AS part_number")
    return N.fix_relationship_text(df, ["part_number"])


# --- N14: edits come from the event log (one edit or approval per event, spread over the records)
_EDITS = """SELECT 'R' || lpad(CAST(user_id AS STRING), 10, '0') AS record_id, event_id AS ts,
CASE event_type WHEN 'click' THEN 'part_number' WHEN 'view' THEN 'material' WHEN 'error' THEN 'standards'
  WHEN 'signup' THEN 'packaging_notes.en' ELSE '_approve' END AS field,
CASE event_type WHEN 'error' THEN 'STD A, ,STD ' || CAST(event_id % 3 AS STRING) WHEN 'click' THEN ' BP10001A ' WHEN 'purchase' THEN ''
  ELSE 'NEW ' || CAST(event_id % 5 AS STRING) END AS value FROM {events}"""


@query("n14_apply_review_edits", f"""
WITH ed AS ({_EDITS.format(events='events')}),
lv AS (SELECT record_id, field, arg_max(value, ts) AS value, max(ts) AS ts FROM ed GROUP BY 1, 2),
w AS (SELECT record_id, max(CASE WHEN field = 'part_number' THEN trim(value) END) AS e_pn, max(CASE WHEN field = 'material' THEN trim(value) END) AS e_mat,
  max(CASE WHEN field = 'standards' THEN value END) AS e_std, max(CASE WHEN field = 'packaging_notes.en' THEN trim(value) END) AS e_pk,
  max(CASE WHEN field = '_approve' THEN ts END) AS appr, max(CASE WHEN field <> '_approve' THEN ts END) AS edit FROM lv GROUP BY 1),
j AS (SELECT r.record_id, r.part_number, r.material, r.packaging_notes.en AS pk, array_to_string(list_transform(r.standards, lambda s: trim(s)), ', ') AS std,
  r._review_status AS st, w.* EXCLUDE (record_id), array_to_string(list_filter(list_transform(str_split(e_std, ','), lambda s: trim(s)), lambda s: s <> ''), ', ') AS n_std
  FROM records r LEFT JOIN w USING (record_id)),
c AS (SELECT *, coalesce(e_pn <> trim(part_number), FALSE) AS c1, coalesce(e_mat <> trim(material), FALSE) AS c2,
  coalesce(e_std IS NOT NULL AND n_std <> std, FALSE) AS c3, coalesce(e_pk <> trim(coalesce(pk, '')), FALSE) AS c4 FROM j)
SELECT record_id, CASE WHEN c1 THEN e_pn ELSE part_number END AS part_number, CASE WHEN c2 THEN e_mat ELSE material END AS material,
 CASE WHEN c3 THEN n_std ELSE std END AS standards, CASE WHEN c4 THEN e_pk ELSE pk END AS packaging_en,
 CAST(c1::INT + c2::INT + c3::INT + c4::INT AS BIGINT) AS n_edits,
 CASE WHEN appr IS NOT NULL AND (NOT (c1 OR c2 OR c3 OR c4) OR appr >= edit) THEN 'reviewed' WHEN c1 OR c2 OR c3 OR c4 THEN 'edited' ELSE coalesce(st, 'pending') END AS review_status,
 coalesce(CASE WHEN c1 THEN part_number END, '') AS old_part_number FROM c""")
def n14(spark, sf):
    t = Tables(spark, sf)
    t.source("events").createOrReplaceTempView("n14_events")
    edits = spark.sql(_EDITS.format(events="n14_events"))
    df = N.apply_review_edits(t.records(), edits)
    return df.select(
        "record_id", "part_number", "material", F.concat_ws(", ", F.transform("standards", E.strip)).alias("standards"),
        F.col("packaging_notes.en").alias("packaging_en"), F.size("_user_edits").cast("bigint").alias("n_edits"),
        F.col("_review_status").alias("review_status"),
        F.coalesce(F.try_element_at("_user_edits", F.lit("part_number")), F.lit("")).alias("old_part_number"))


# --- W7, W9
@query("w7_last_revision_row", "SELECT record_id, revisions_history[len(revisions_history)].rev AS last_rev, CAST(len(revisions_history) AS BIGINT) AS n FROM records")
def w7(spark, sf):
    return Tables(spark, sf).records().select(
        "record_id", F.try_element_at(F.col("revisions_history"), F.lit(-1))["rev"].alias("last_rev"), F.size("revisions_history").cast("bigint").alias("n"))


@query("w9_labelled_material", f"WITH {MATERIAL} SELECT t.record_id, lab.labelled FROM texts t LEFT JOIN lab USING (record_id)")
def w9(spark, sf):
    return Tables(spark, sf).flat("texts").select("record_id", N.labelled_material(F.col("text")).alias("labelled"))
