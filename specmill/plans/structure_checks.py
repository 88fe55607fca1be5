"""Queries and checking SQL for the fuzzy joins, catalog matching and product structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from specmill import refdata as R
from specmill.functions import exprs as E
from specmill.operators import matching as M
from specmill.operators import profile as P
from specmill.operators import tree as T
from specmill.plans.sqltext import check, distance, first_label, key, lit, lookalike, rx, stem, strip  # noqa: F401
from specmill.sources import store, writers
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


# --- U2, J1, J2 (brute force within a batch)
KB = f"kb AS (SELECT DISTINCT batch_id, {key('part_number')} AS a FROM bom WHERE {strip('part_number')} <> '')"
KD = f"kd AS (SELECT DISTINCT batch_id, {key('part_number')} AS b FROM drawings WHERE {strip('part_number')} <> '')"
J1 = f"""{KB}, {KD},
j1p AS (SELECT kb.batch_id, kb.a, kd.b, {distance('kb.a', 'kd.b')} AS dist FROM kb JOIN kd USING (batch_id)
 WHERE NOT regexp_matches(kb.a, '\\p{{L}}') AND regexp_matches(kd.b, '\\p{{L}}')
 AND NOT EXISTS (SELECT 1 FROM kd x WHERE x.batch_id = kb.batch_id AND x.b = kb.a)),
j1 AS (SELECT batch_id, a AS pn, arg_min(b, (dist, b)) AS nearest, CAST(min(dist) AS BIGINT) AS distance FROM j1p WHERE dist BETWEEN 1 AND 2 GROUP BY 1, 2)"""
J2 = f"""{J1},
kb2 AS (SELECT DISTINCT kb.batch_id, coalesce(j1.nearest, kb.a) AS b FROM kb LEFT JOIN j1 ON j1.batch_id = kb.batch_id AND j1.pn = kb.a),
j2p AS (SELECT kd.batch_id, kd.b AS a, kb2.b, {distance('kd.b', 'kb2.b')} AS dist FROM kd JOIN kb2 USING (batch_id)
 WHERE NOT EXISTS (SELECT 1 FROM kb2 x WHERE x.batch_id = kd.batch_id AND x.b = kd.b)),
j2 AS (SELECT batch_id, a AS pn, arg_min(b, (dist, b)) AS nearest, CAST(min(dist) AS BIGINT) AS distance FROM j2p WHERE dist BETWEEN 1 AND 2 GROUP BY 1, 2)"""


@query("u2_bom_identifiers", f"WITH {KB} SELECT batch_id, a AS pn FROM kb")
def u2(spark, sf):
    return M.bom_identifiers(Tables(spark, sf).bom())


@query("j1_fuzzy_bom_to_drawing", f"WITH {J1} SELECT batch_id, pn, nearest, distance FROM j1")
def j1(spark, sf):
    t = Tables(spark, sf)
    return M.bom_to_drawing(t.bom(), t.drawings(), store.materialise)


@query("j1_corrected_bom", f"""WITH {J1} SELECT b.batch_id, b.parent_record_id, b.pos, b.item_no, coalesce(j1.nearest, b.part_number) AS part_number, j1.distance AS bom_fix_distance
FROM bom b LEFT JOIN j1 ON j1.batch_id = b.batch_id AND j1.pn = {key('b.part_number')}""")
def j1_bom(spark, sf):
    t = Tables(spark, sf)
    return M.correct_bom(t.bom(), t.drawings(), store.materialise).select("batch_id", "parent_record_id", "pos", "item_no", "part_number", "bom_fix_distance")


def _corrected_bom(t: Tables):
    return M.correct_bom(t.bom(), t.drawings(), store.materialise).drop("bom_fix_distance")


@query("j2_fuzzy_drawing_to_bom", f"WITH {J2} SELECT batch_id, pn, nearest, distance FROM j2")
def j2(spark, sf):
    t = Tables(spark, sf)
    return M.drawing_to_bom(t.drawings(), _corrected_bom(t), store.materialise)


@query("j2_corrected_drawings", f"""WITH {J2} SELECT d.batch_id, d.record_id, coalesce(j2.nearest, d.part_number) AS part_number,
CASE WHEN j2.nearest IS NOT NULL AND {key('d.drawing_number')} = {key('d.part_number')} THEN j2.nearest ELSE d.drawing_number END AS drawing_number
FROM drawings d LEFT JOIN j2 ON j2.batch_id = d.batch_id AND j2.pn = {key('d.part_number')}""")
def j2_drawings(spark, sf):
    t = Tables(spark, sf)
    return M.correct_drawings(t.drawings(), _corrected_bom(t), store.materialise).select(
        "batch_id", "record_id", "part_number", "drawing_number")


# --- J3, W1
def _features_sql(src: str, text: str, thick1: str, thick2: str, rohs: str, strict: bool) -> str:
    codes = (f"list_sort(list_distinct(list_transform(regexp_extract_all(tx, {lit(R.STD_CODE)}), lambda m: "
             "regexp_replace(regexp_replace(upper(m), '[ -]', '', 'g'), '(\\d)[A-Z]$', '\\1'))))")
    toks = "list_sort(list_distinct(list_transform(list_concat(list_concat(" + ", ".join(
        f"regexp_extract_all(tx, {lit(p)})" for p in R.TYPE_TOKENS[:2]) + f"), regexp_extract_all(tx, {lit(R.TYPE_TOKENS[2])})), lambda m: replace(upper(m), ' ', ''))))"
    s = f"SELECT *, {text} AS tx FROM {src}"
    s = f"SELECT *, upper(trim(regexp_replace(tx, '\\s+', ' ', 'g'))) AS ux, lower({thick1}) AS h1, lower({thick2}) AS h2 FROM ({s})"
    second = R.THICKNESS_WITH_UNIT if strict else R.THICKNESS

    def one(i: int) -> str:
        return (f"TRY_CAST(CASE WHEN regexp_matches(h1, '\\d') THEN regexp_extract(h1, {lit(R.THICKNESS)}, {i}) "
                f"ELSE regexp_extract(h2, {lit(second)}, {i}) END AS DOUBLE)")

    inch = rx("h", R.INCH_WORD) if strict else "contains(h, 'in')"
    mul = (f"CASE WHEN {inch} AND NOT contains(h, 'mic') AND NOT contains(h, 'µ') THEN 25400.0::DOUBLE "
           "WHEN contains(h, 'mm') THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END")
    s = (f"SELECT *, {codes} AS codes, {toks} AS toks, {first_label('ux', R.COATING_KINDS)} AS kind, {first_label('ux', R.COATING_COLORS)} AS hue, "
         f"CASE WHEN NOT contains(ux, 'PHOSPHOR') THEN NULL WHEN contains(ux, 'HIGH') THEN 'high' WHEN contains(ux, 'MEDIUM') OR contains(ux, 'MED ') OR contains(ux, 'MID') THEN 'medium' WHEN contains(ux, 'LOW') THEN 'low' END AS phos, "
         f"{rohs} AS ro, CASE WHEN regexp_matches(h1, '\\d') THEN h1 ELSE h2 END AS h FROM ({s})")
    s = f"SELECT *, {one(1)} AS g1, {one(2)} AS g2, {one(3)} AS g3, {mul} AS mu FROM ({s})"
    return f"SELECT *, CASE WHEN g1 IS NOT NULL THEN g1 * mu ELSE g3 * mu * 0.85::DOUBLE END AS lo, CASE WHEN g1 IS NOT NULL THEN g2 * mu ELSE g3 * mu * 1.15::DOUBLE END AS hi FROM ({s})"


def _j3_sql(strict: bool) -> str:
    coats = """(SELECT record_id, CAST(i - 1 AS BIGINT) AS pos, c.type AS type, c.type_he AS type_he, c.name AS name, c.standard AS std, c.thickness AS thk, c.rohs AS crohs FROM (
      SELECT record_id, unnest(coating_processes) AS c, generate_subscripts(coating_processes, 1) AS i FROM records))"""
    a = _features_sql(coats, "concat_ws(' ', coalesce(type, ''), coalesce(type_he, ''), coalesce(name, ''), coalesce(std, ''), coalesce(thk, ''))",
                      "thk", "tx", "coalesce(crohs, FALSE)", strict)
    b = _features_sql("catalog", "\"desc\" || ' ' || standard", "thickness", "standard", "contains(upper(tx), 'ROHS')", strict)
    s = R.SCORE
    d = lambda v: f"{v}::DOUBLE"
    rel = " OR ".join(f"(a.kind = '{x}' AND b.kind = '{y}') OR (a.kind = '{y}' AND b.kind = '{x}')" for x, y in R.RELATED_KINDS)
    inter = "list_intersect({0}, {1})"
    both = "len(a.codes) > 0 AND len(b.codes) > 0"
    ov = "(least(a.hi, b.hi) - greatest(a.lo, b.lo))"
    span = "(((a.hi - a.lo) + (b.hi - b.lo)) / 2)"
    terms = [
        f"CASE WHEN {both} THEN len({inter.format('a.codes', 'b.codes')})::DOUBLE / greatest(len(a.codes), 1) * {d(s['code'])} ELSE 0 END",
        f"CASE WHEN {both} THEN len(list_filter(b.codes, lambda z: NOT list_contains(a.codes, z)))::DOUBLE * {d(s['code_extra'])} ELSE 0 END",
        f"CASE WHEN len(a.toks) > 0 AND len(b.toks) > 0 THEN len({inter.format('a.toks', 'b.toks')})::DOUBLE / greatest(len(a.toks), 1) * {d(s['type_class'])} ELSE 0 END",
        f"CASE WHEN a.kind IS NULL THEN 0 WHEN b.kind IS NULL THEN {d(s['kind_missing'])} WHEN a.kind = b.kind THEN {d(s['kind'])} WHEN {rel} THEN {d(s['kind_related'])} ELSE {d(s['kind_other'])} END",
        f"CASE WHEN a.hue = b.hue THEN {d(s['color'])} ELSE 0 END",
        f"CASE WHEN a.lo IS NULL OR b.lo IS NULL OR {ov} <= 0 THEN 0 ELSE least(1.0::DOUBLE, {ov} / CASE WHEN {span} = 0 THEN 1.0::DOUBLE ELSE {span} END) * {d(s['thickness'])} END",
        f"CASE WHEN NOT a.ro THEN 0 WHEN b.ro THEN {d(s['rohs'])} ELSE {d(s['rohs_missing'])} END",
        f"CASE WHEN a.phos IS NULL OR b.phos IS NULL THEN 0 WHEN a.phos = b.phos THEN {d(s['phosphorus'])} ELSE {d(s['phosphorus_other'])} END",
    ]
    total = "0::DOUBLE + " + " + ".join(f"({t})" for t in terms)
    return f"""WITH fa AS ({a}), fb AS ({b}),
sc AS (SELECT a.record_id, a.pos, b.ordinal, b.master_id, {total} AS raw FROM fa a CROSS JOIN fb b),
rk AS (SELECT *, round_even(raw, 1) AS score FROM sc WHERE raw >= 15),
rr AS (SELECT *, CAST(row_number() OVER (PARTITION BY record_id, pos ORDER BY score DESC, ordinal) AS BIGINT) AS rank FROM rk)
SELECT record_id, pos, rank, master_id, score FROM rr WHERE rank <= 3"""


@query("j3_match_catalog_compat", _j3_sql(False))
def j3_compat(spark, sf):
    t = Tables(spark, sf)
    return M.match_catalog(M.explode_coatings(t.records()), t.flat("catalog"), strict=False, keep=store.materialise).select("record_id", "pos", "rank", "master_id", "score")


@query("j3_match_catalog", _j3_sql(True))
def j3(spark, sf):
    t = Tables(spark, sf)
    return M.match_catalog(M.explode_coatings(t.records()), t.flat("catalog"), keep=store.materialise).select("record_id", "pos", "rank", "master_id", "score")


@query("j3_catalog_details", "SELECT master_id, \"desc\", replace(full_name, '\\', ' | ') AS full_name FROM catalog")
def j3_details(spark, sf):
    c = Tables(spark, sf).flat("catalog")
    return M.catalog_details(c.select("master_id"), c).select("master_id", "desc", "full_name")


# --- U1: codes of a coating against each master that shares one
@query("u1_code_sets", f"""WITH fa AS (SELECT DISTINCT list_sort(list_distinct(list_transform(regexp_extract_all(c.standard, {lit(R.STD_CODE)}), lambda m: regexp_replace(regexp_replace(upper(m), '[ -]', '', 'g'), '(\\d)[A-Z]$', '\\1')))) AS a FROM (SELECT unnest(coating_processes) AS c FROM records)),
fb AS (SELECT ordinal, list_sort(list_distinct(list_transform(regexp_extract_all("desc" || ' ' || standard, {lit(R.STD_CODE)}), lambda m: regexp_replace(regexp_replace(upper(m), '[ -]', '', 'g'), '(\\d)[A-Z]$', '\\1')))) AS b FROM catalog)
SELECT array_to_string(a, ',') AS codes, ordinal, array_to_string(list_sort(list_intersect(a, b)), ',') AS common, array_to_string(list_filter(b, lambda z: NOT list_contains(a, z)), ',') AS extra FROM fa, fb WHERE len(list_intersect(a, b)) > 0""")
def u1(spark, sf):
    t = Tables(spark, sf)
    a = M.explode_coatings(t.records()).select(M.standard_codes(F.coalesce("standard", F.lit(""))).alias("a")).distinct()
    b = t.flat("catalog").select("ordinal", M.standard_codes(F.concat_ws(" ", "desc", "standard")).alias("b"))
    both = a.select("a", F.explode("a").alias("code")).join(b.select("ordinal", "b", F.explode("b").alias("code")), "code")
    both = both.where(F.col("code") == F.array_min(F.array_intersect("a", "b")))
    return both.select(F.concat_ws(",", "a").alias("codes"), "ordinal", E.joined_sorted(F.array_intersect("a", "b"), ",").alias("common"),
                       F.concat_ws(",", F.array_except("b", "a")).alias("extra"))


# --- J5, J9: stored results are named after their version, mode and content
_STORED = """SELECT 'v' || CAST(18 + p_partkey % 3 AS {s}) || '_' || CASE p_partkey % 2 WHEN 0 THEN 'assembly' ELSE 'single' END || '_' || md5('part-' || CAST(p_partkey AS {s})) AS result_name,
 'v' || CAST(18 + p_partkey % 3 AS {s}) AS version, 'base' AS model, md5('part-' || CAST(p_partkey AS {s})) AS fingerprint,
 CASE p_partkey % 2 WHEN 0 THEN 'assembly' ELSE 'single' END AS mode, p_retailprice AS price FROM {part}"""
_MANIFEST_COLS = ("'v19' AS version", "'base' AS model", "'assembly' AS mode")


def _stored(spark, t):
    t.source("part").createOrReplaceTempView("stored_parts")
    return spark.sql(_STORED.format(s="STRING", part="stored_parts"))


@query("j5_source_lookup", f"""WITH st AS ({_STORED.format(s='VARCHAR', part='part')}), nm AS (SELECT fingerprint, max(source_filename) AS source_filename FROM records GROUP BY 1)
SELECT st.result_name, st.version, st.fingerprint, nm.source_filename FROM st LEFT JOIN nm USING (fingerprint)""")
def j5(spark, sf):
    t = Tables(spark, sf)
    return M.source_lookup(_stored(spark, t).select("result_name"), t.records()).select("result_name", "version", "fingerprint", "source_filename")


@query("j9_pending_files", f"""WITH st AS ({_STORED.format(s='VARCHAR', part='part')})
SELECT record_id, fingerprint FROM records r WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.version = 'v19' AND st.model = 'base' AND st.mode = 'assembly' AND st.fingerprint = r.fingerprint)""")
def j9(spark, sf):
    t = Tables(spark, sf)
    m = t.records().selectExpr("record_id", "fingerprint", *_MANIFEST_COLS)
    return M.pending_files(m, _stored(spark, t)).select("record_id", "fingerprint")


@query("j9_stored_results", f"""WITH st AS ({_STORED.format(s='VARCHAR', part='part')})
SELECT record_id, st.result_name, TRUE AS cache_hit FROM records r JOIN st ON st.version = 'v19' AND st.mode = 'assembly' AND st.fingerprint = r.fingerprint""")
def j9_hits(spark, sf):
    t = Tables(spark, sf)
    m = t.records().selectExpr("record_id", "fingerprint", *_MANIFEST_COLS)
    return M.stored_results(m, _stored(spark, t)).select("record_id", "result_name", F.col("_cache_hit").alias("cache_hit"))


# --- W5, W8
@query("w5_last_drawing_per_identifier", f"""SELECT batch_id, {key('part_number')} AS k, arg_max(record_id, (pos, record_id)) AS last_record, arg_min(record_id, (pos, record_id)) AS first_record
FROM drawings WHERE {strip('part_number')} <> '' GROUP BY 1, 2""")
def w5(spark, sf):
    d = T.keyed(Tables(spark, sf).drawings()).where("k <> ''")
    order = F.struct("pos", "record_id")
    return d.groupBy("batch_id", "k").agg(F.max_by("record_id", order).alias("last_record"), F.min_by("record_id", order).alias("first_record"))


@query("w8_first_record_of_batch", """SELECT batch_id, arg_min(record_id, (CASE WHEN assembly_role = 'Assembly Overview Image' THEN 0 ELSE 1 END, pos, record_id)) AS first_record FROM drawings GROUP BY 1""")
def w8(spark, sf):
    order = F.struct(F.when(T.is_overview(F.col("assembly_role")), 0).otherwise(1), "pos", "record_id")
    return Tables(spark, sf).drawings().groupBy("batch_id").agg(F.min_by("record_id", order).alias("first_record"))


# --- J4, J13, J7, J8
IDX = f"""idx AS (SELECT batch_id, {key('part_number')} AS k, arg_max(title, (pos, record_id)) AS i_title, arg_max(material, (pos, record_id)) AS i_mat,
 arg_max(drawing_number, (pos, record_id)) AS i_dwg FROM drawings WHERE {strip('part_number')} <> '' GROUP BY 1, 2)"""


def _phr(x: str) -> str:
    t = f"list_transform(regexp_extract_all({x}, {lit(R.MATERIAL_PHRASES)}), lambda m: upper(trim(regexp_replace(m, '\\s+', ' ', 'g'))))"
    return f"array_to_string(list_filter({t}, lambda m, i: list_position({t}, m) = i), ', ')"


@query("j4_bom_lookup", f"""WITH {IDX} SELECT b.batch_id, b.parent_record_id, b.pos, b.part_number,
CASE WHEN b.description <> '' THEN b.description ELSE coalesce(i_title, '') END AS description, b.qty,
CASE WHEN coalesce(i_mat, '') <> '' THEN i_mat ELSE {_phr('b.description')} END AS material, idx.k IS NOT NULL AS uploaded
FROM bom b LEFT JOIN idx ON idx.batch_id = b.batch_id AND idx.k = {key('b.part_number')}""")
def j4(spark, sf):
    t = Tables(spark, sf)
    return T.bom_lookup(t.bom(), t.drawings()).select(
        "batch_id", "parent_record_id", "pos", "part_number", "description", "qty", "material", "uploaded")


EDGES = f"""{IDX}, ed AS MATERIALIZED (SELECT b.batch_id, d.pos AS root_pos, b.parent_record_id, trim(d.part_number) AS parent_pn, trim(d.drawing_number) AS parent_dwg, b.pos, b.item_no,
 trim(b.part_number) AS child_pn, coalesce(idx.i_dwg, '') AS child_dwg, b.description, b.qty, idx.k IS NOT NULL AS found
 FROM bom b JOIN drawings d ON d.batch_id = b.batch_id AND d.record_id = b.parent_record_id AND d.assembly_role = 'ASSEMBLY'
 LEFT JOIN idx ON idx.batch_id = b.batch_id AND idx.k = upper(trim(b.part_number)) WHERE trim(b.part_number) <> '')"""
OV = f"""ovi AS MATERIALIZED (SELECT DISTINCT batch_id, v FROM (SELECT batch_id, unnest([v0, {stem('v0')}]) AS v FROM (
 SELECT batch_id, unnest([lower(trim(part_number)), lower(trim(drawing_number)), lower(trim(source_filename))]) AS v0 FROM drawings WHERE assembly_role = 'Assembly Overview Image') WHERE v0 <> ''))"""


def _is_ov(alias: str, col: str) -> str:
    x = f"lower(trim({alias}.{col}))"
    known = " OR ".join(f"EXISTS (SELECT 1 FROM ovi WHERE ovi.batch_id = {alias}.batch_id AND ovi.v = {v})" for v in (x, stem(x)))
    return f"({x} <> '' AND (contains({x}, 'asm_temp_image') OR contains({x}, 'overview image') OR starts_with({x}, 'image') OR {known}))"


ROOTS = f"""{EDGES}, {OV}, e8 AS MATERIALIZED (SELECT * FROM ed e WHERE NOT {_is_ov('e', 'parent_pn')} AND NOT {_is_ov('e', 'parent_dwg')}),
nr AS (SELECT batch_id, count(DISTINCT parent_record_id) AS n FROM e8 GROUP BY 1),
e7 AS MATERIALIZED (SELECT e.* FROM e8 e JOIN nr USING (batch_id) WHERE nr.n <= 1 OR NOT EXISTS (SELECT 1 FROM e8 x WHERE x.batch_id = e.batch_id AND upper(x.child_pn) = upper(e.parent_pn)))"""
_EDGE_OUT = ["batch_id", "parent_record_id", "parent_pn", "parent_dwg", "pos", "child_pn", "child_dwg", "description", "qty", "found"]


def _inputs(t: Tables):
    """Drawings and BOM written once, for jobs that read them several times: deriving them shuffles every line item anew."""
    return t.written("tree_drawings", lambda: t.drawings().select(*T.DRAWING_INPUT), spread=False), t.written("tree_bom", t.bom, spread=False)


def _edges(t: Tables):
    return T.derive_edges(t.drawings(), t.bom())


def _final_edges(t: Tables):
    """Written as they come from their last join, which deals them out by parent: for jobs that read them several times."""
    return t.written("edges", lambda: T.tree_edges(*_inputs(t), store.materialise), spread=False)


@query("j13_derive_relationships", f"WITH {EDGES} SELECT {', '.join(_EDGE_OUT)} FROM ed")
def j13(spark, sf):
    return _edges(Tables(spark, sf)).select(*_EDGE_OUT)


@query("j13_orphans", f"""WITH {EDGES} SELECT batch_id, record_id, part_number, drawing_number FROM drawings d WHERE assembly_role = 'PART' AND trim(part_number) <> ''
AND NOT EXISTS (SELECT 1 FROM ed WHERE ed.batch_id = d.batch_id AND upper(ed.child_pn) = {key('d.part_number')})""")
def j13_orphans(spark, sf):
    t = Tables(spark, sf)
    return T.orphans(t.drawings(), _edges(t))


@query("j13_missing_children", f"WITH {EDGES} SELECT batch_id, parent_pn AS needed_by, child_pn AS part_number, description, qty FROM ed WHERE NOT found")
def j13_missing(spark, sf):
    return T.missing_children(_edges(Tables(spark, sf)))


@query("j7_demote_nested_roots", f"WITH {ROOTS} SELECT {', '.join(_EDGE_OUT)} FROM e7")
def j7(spark, sf):
    t = Tables(spark, sf)
    return T.tree_edges(*_inputs(t), store.materialise).select(*_EDGE_OUT)


# overview images are given as parents too, so that there is something to drop
@query("j8_filter_overview_roots", f"""WITH {OV}, pe AS (SELECT batch_id, part_number AS parent_pn, drawing_number AS parent_dwg, record_id FROM drawings)
SELECT batch_id, record_id, parent_pn, parent_dwg FROM pe e WHERE NOT {_is_ov('e', 'parent_pn')} AND NOT {_is_ov('e', 'parent_dwg')}""")
def j8(spark, sf):
    t = Tables(spark, sf)
    roots = t.drawings().selectExpr("batch_id", "record_id", "part_number AS parent_pn", "drawing_number AS parent_dwg")
    return T.filter_overview_roots(roots, t.drawings())


# --- T1
def _dash(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN {x} ELSE '—' END"


TREE = f"""{ROOTS},
rt AS MATERIALIZED (SELECT DISTINCT batch_id, root_pos, parent_pn, parent_dwg FROM e7),
am AS MATERIALIZED (SELECT batch_id, record_id, pos AS asm_pos, trim(part_number) AS parent FROM drawings d WHERE assembly_role = 'ASSEMBLY' AND trim(part_number) <> '' AND NOT {_is_ov('d', 'part_number')}),
it AS MATERIALIZED (SELECT b.*, am.asm_pos, am.parent, {key('b.part_number')} AS k FROM bom b JOIN am ON am.batch_id = b.batch_id AND am.record_id = b.parent_record_id WHERE trim(b.part_number) <> ''),
fi AS MATERIALIZED (SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY batch_id, k ORDER BY asm_pos, parent_record_id, pos) = 1),
rs AS MATERIALIZED (SELECT d.*, {key('d.part_number')} AS k FROM drawings d WHERE trim(part_number) <> '' AND NOT {_is_ov('d', 'part_number')}
  AND NOT EXISTS (SELECT 1 FROM e7 WHERE e7.batch_id = d.batch_id AND upper(e7.child_pn) = {key('d.part_number')})
  AND NOT EXISTS (SELECT 1 FROM rt WHERE rt.batch_id = d.batch_id AND upper(rt.parent_pn) = {key('d.part_number')})),
rp AS MATERIALIZED (SELECT rs.*, fi.parent, fi.qty AS f_qty, fi.description AS f_desc FROM rs LEFT JOIN fi ON fi.batch_id = rs.batch_id AND fi.k = rs.k),
un AS MATERIALIZED (SELECT * FROM rp WHERE parent IS NOT NULL QUALIFY row_number() OVER (PARTITION BY batch_id, k ORDER BY pos, record_id) = 1),
al AS MATERIALIZED (SELECT * FROM rp WHERE parent IS NULL),
ad AS MATERIALIZED (SELECT batch_id, parent, pos, record_id FROM un QUALIFY row_number() OVER (PARTITION BY batch_id, upper(parent) ORDER BY pos, record_id) = 1),
tr AS (
SELECT rt.batch_id, 0 AS level, {_dash('parent_pn')} AS part_number, CASE WHEN parent_dwg <> '' THEN parent_dwg ELSE coalesce(i_dwg, '') END AS drawing_number, '' AS description, '1' AS qty,
  coalesce(i_mat, '') AS material, '' AS parent_part_number, {_dash('parent_pn')} AS root_part_number, {_dash('parent_pn')} AS hierarchy_path FROM rt LEFT JOIN idx ON idx.batch_id = rt.batch_id AND idx.k = upper(parent_pn)
UNION ALL SELECT e.batch_id, 1, child_pn, child_dwg, CASE WHEN description <> '' THEN description ELSE coalesce(i_title, '') END, CASE WHEN trim(qty) <> '' THEN trim(qty) ELSE '1' END,
  CASE WHEN coalesce(i_mat, '') <> '' THEN i_mat ELSE {_phr('e.description')} END, {_dash('parent_pn')}, {_dash('parent_pn')}, {_dash('parent_pn')} || ' > ' || child_pn FROM e7 e LEFT JOIN idx ON idx.batch_id = e.batch_id AND idx.k = upper(child_pn)
UNION ALL SELECT batch_id, 1, trim(part_number), trim(drawing_number), f_desc, CASE WHEN f_qty <> '' THEN f_qty WHEN quantity <> '' THEN quantity ELSE '1' END, material, parent, parent, parent || ' > ' || trim(part_number) FROM un
UNION ALL SELECT batch_id, 0, trim(part_number), trim(drawing_number), '', CASE WHEN quantity <> '' THEN quantity ELSE '1' END, material, '', trim(part_number), trim(part_number) FROM al
UNION ALL SELECT ad.batch_id, 0, ad.parent, coalesce(i_dwg, ''), '', '1', coalesce(i_mat, ''), '', ad.parent, ad.parent FROM ad LEFT JOIN idx ON idx.batch_id = ad.batch_id AND idx.k = upper(ad.parent)
  WHERE NOT EXISTS (SELECT 1 FROM rt WHERE rt.batch_id = ad.batch_id AND upper(rt.parent_pn) = upper(ad.parent))
  AND NOT EXISTS (SELECT 1 FROM al WHERE al.batch_id = ad.batch_id AND al.k = upper(ad.parent) AND (al.pos, al.record_id) <= (ad.pos, ad.record_id))
UNION ALL SELECT fi.batch_id, 1, trim(fi.part_number), '', CASE WHEN fi.description = '' AND fi.qty = '' THEN '[OCR_UNREADABLE]' WHEN fi.description = '' THEN '[PURCHASED PART / NO DRAWING]' ELSE fi.description END,
  CASE WHEN fi.qty <> '' THEN fi.qty ELSE '—' END, '', fi.parent, fi.parent, fi.parent || ' > ' || trim(fi.part_number) FROM fi
  WHERE fi.batch_id IN (SELECT batch_id FROM rt) AND NOT EXISTS (SELECT 1 FROM e7 WHERE e7.batch_id = fi.batch_id AND upper(e7.child_pn) = fi.k)
  AND NOT EXISTS (SELECT 1 FROM rt WHERE rt.batch_id = fi.batch_id AND upper(rt.parent_pn) = fi.k) AND NOT EXISTS (SELECT 1 FROM rs WHERE rs.batch_id = fi.batch_id AND rs.k = fi.k))"""
_TREE_OUT = "batch_id, CAST(level AS BIGINT) AS level, part_number, drawing_number, description, qty, material, parent_part_number, root_part_number, hierarchy_path"


@query("t1_product_tree", f"WITH {TREE} SELECT {_TREE_OUT} FROM tr")
def t1(spark, sf):
    t = Tables(spark, sf)
    e = _final_edges(t)
    return T.product_tree(*_inputs(t), None, e, store.materialise)


# the tree without any roots: everything comes from the drawings and their BOM rows
@query("t1_tree_from_bom", f"WITH {TREE.replace('FROM e7),', 'FROM e7 WHERE 1 = 0),', 1).replace('e7 AS MATERIALIZED (SELECT e.*', 'e7x AS MATERIALIZED (SELECT e.*', 1)}".replace(
    "rt AS MATERIALIZED (SELECT DISTINCT", "e7 AS (SELECT * FROM e7x WHERE 1 = 0), rt AS MATERIALIZED (SELECT DISTINCT", 1) + f" SELECT {_TREE_OUT} FROM tr")
def t1_bom(spark, sf):
    t = Tables(spark, sf)
    none = _edges(t).where("1 = 0")
    return T.product_tree(*_inputs(t), T.roots_of(none), none, store.materialise)


# --- J6
@query("j6_link_overview_items", f"""WITH {ROOTS},
rp AS MATERIALIZED (SELECT batch_id, upper(arg_min(parent_pn, (root_pos, parent_record_id))) AS root_pn FROM e7 GROUP BY 1),
ca AS (SELECT d.batch_id, d.record_id FROM drawings d LEFT JOIN rp USING (batch_id) WHERE d.assembly_role = 'ASSEMBLY'
  AND ({key('d.part_number')} = rp.root_pn OR EXISTS (SELECT 1 FROM bom b WHERE b.batch_id = d.batch_id AND b.parent_record_id = d.record_id))
  QUALIFY row_number() OVER (PARTITION BY d.batch_id ORDER BY CASE WHEN {key('d.part_number')} = rp.root_pn THEN 0 ELSE 1 END, d.pos, d.record_id) = 1),
mb AS (SELECT b.* FROM bom b JOIN ca ON ca.batch_id = b.batch_id AND ca.record_id = b.parent_record_id),
mi AS (SELECT * FROM mb WHERE item_no <> '' QUALIFY row_number() OVER (PARTITION BY batch_id, item_no ORDER BY pos) = 1),
mp AS (SELECT *, {key('part_number')} AS pk FROM mb WHERE trim(part_number) <> '' QUALIFY row_number() OVER (PARTITION BY batch_id, {key('part_number')} ORDER BY pos) = 1),
bl AS (SELECT l.*, d.source_filename AS image_file, d.part_number AS image_pn, CASE WHEN mi.batch_id IS NOT NULL THEN 'item_no' WHEN mp.batch_id IS NOT NULL THEN 'part_number' ELSE '' END AS method,
  CASE WHEN mi.batch_id IS NOT NULL THEN mi.part_number ELSE coalesce(mp.part_number, '') END AS mpn, CASE WHEN mi.batch_id IS NOT NULL THEN mi.qty ELSE coalesce(mp.qty, '') END AS mq,
  CASE WHEN mi.batch_id IS NOT NULL THEN mi.description ELSE coalesce(mp.description, '') END AS md
  FROM balloons l JOIN drawings d ON d.batch_id = l.batch_id AND d.record_id = l.parent_record_id LEFT JOIN mi ON mi.batch_id = l.batch_id AND mi.item_no = l.item_no
  LEFT JOIN mp ON mp.batch_id = l.batch_id AND mp.pk = {key('l.part_number')})
SELECT bl.batch_id, image_file, image_pn, item_no, CASE WHEN mpn <> '' AND (part_number = '' OR method = 'item_no') THEN mpn ELSE part_number END AS part_number, description, qty,
 CASE WHEN idx.k IS NOT NULL THEN mpn ELSE '' END AS linked_pn, coalesce(i_dwg, '') AS linked_dwg, mq AS bom_qty, coalesce(i_mat, '') AS linked_material, md AS bom_description, method, idx.k IS NOT NULL AS uploaded
FROM bl LEFT JOIN idx ON idx.batch_id = bl.batch_id AND idx.k = upper(trim(mpn))""")
def j6(spark, sf):
    t = Tables(spark, sf)
    return T.link_overview_items(t.flat("balloons"), *_inputs(t), _final_edges(t), store.materialise)


# --- S8: the export of all records and trees, committed twice under one name, and what is read back of it
_EXPORT = " UNION ALL ".join(
    [f"SELECT '{n}' AS table_name, CAST(sum(len({c})) AS BIGINT) AS n_rows FROM records" for n, c in
     [("bom", "bom_items"), ("standards", "standards"), *[(c, c) for c in P.PROCESS_LISTS if c != "additional_processes"]]]
    + ["SELECT 'summary', count(*) FROM records", "SELECT 'costs', count(*) + 1 FROM records", "SELECT 'tree', count(*) FROM tr",
       "SELECT 'image_tree', count(*) FROM balloons l JOIN drawings d ON d.batch_id = l.batch_id AND d.record_id = l.parent_record_id",
       "SELECT 'extras', CAST(sum(len(additional_processes) + (packaging_notes.en <> '' OR packaging_notes.he <> '')::INT + (trim(notes) <> '')::INT) AS BIGINT) FROM records"])


@query("s8_committed_tables", f"""WITH {TREE}, listed AS ({_EXPORT})
SELECT table_name, n_rows, n_rows AS n_read, CASE table_name WHEN 'tree' THEN (SELECT CAST(sum(level) AS BIGINT) FROM tr)
  WHEN 'bom' THEN (SELECT CAST(sum(len(trim(i.part_number))) AS BIGINT) FROM (SELECT unnest(bom_items) AS i FROM records)) END AS content FROM listed""")
def s8_committed(spark, sf):
    t = Tables(spark, sf)
    e = _final_edges(t)
    tree = store.materialise(T.product_tree(*_inputs(t), None, e, store.materialise), "tree")
    images = store.materialise(T.link_overview_items(t.flat("balloons"), *_inputs(t), e, store.materialise), "image_tree")
    tables, folder = P.export_table_set(t.records(), tree, images), store.new_path(spark, "export")
    for _ in range(2):
        writers.commit_table_set(tables, folder, "all")
    sums = {"tree": F.sum("level"), "bom": F.sum(F.char_length(E.strip(F.col("part_number"))))}
    out = None
    for name, df in writers.read_table_set(spark, folder, "all").items():
        one = df.agg(F.count("*").alias("n_read"), sums.get(name, F.lit(None)).cast("bigint").alias("content")).withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return writers.committed_tables(spark, folder).join(out, "table_name").select("table_name", "n_rows", "n_read", "content")


# --- V14, V15, U3
@query("v14_marking_xref", f"""WITH {EDGES},
pa AS (SELECT batch_id, upper(child_pn) AS k, arg_max(upper(parent_pn), (root_pos, pos)) AS parent FROM ed WHERE parent_pn <> '' GROUP BY 1, 2),
mk AS (SELECT batch_id, record_id, {key('part_number')} AS k, rtrim(upper(trim(unnest(list_concat({', '.join(f"regexp_extract_all(notes, {lit(p)}, 1)" for p in R.MARK_PN)})))), '.,;:') AS value FROM drawings WHERE trim(part_number) <> '')
SELECT mk.batch_id, record_id, 'MARKING_PN_CROSS_REF' AS type, 'INFO' AS severity, 'notes' AS source, value FROM mk LEFT JOIN pa ON pa.batch_id = mk.batch_id AND pa.k = mk.k
WHERE length(value) >= 5 AND value <> mk.k AND (pa.parent IS NULL OR pa.parent <> value)""")
def v14(spark, sf):
    t = Tables(spark, sf)
    return T.marking_xref(t.drawings(), _edges(t))


# process steps made of each drawing's own columns: one names its drawing number, one its own number, one another part
_STEPS = {"machining_processes": ("10.3", "title", "'MARK PART NUMBER ' || drawing_number || '.'"),
          "inspection_processes": ("60.2", "''", "'marking pn: ' || part_number"),
          "final_approval": ("70.4", "'MARK P/N: X' || record_id", "quantity")}


@query("v14_marking_steps", f"""WITH {EDGES},
pa AS (SELECT batch_id, upper(child_pn) AS k, arg_max(upper(parent_pn), (root_pos, pos)) AS parent FROM ed WHERE parent_pn <> '' GROUP BY 1, 2),
tx AS (SELECT batch_id, record_id, {key('part_number')} AS k, 'notes' AS source, notes AS text FROM drawings
{' '.join(f"UNION ALL SELECT batch_id, record_id, {key('part_number')}, '{no}', concat_ws(' ', coalesce({name}, ''), '', coalesce({details}, '')) FROM drawings" for no, name, details in _STEPS.values())}),
mk AS (SELECT batch_id, record_id, k, source, rtrim(upper(trim(unnest(list_concat({', '.join(f"regexp_extract_all(text, {lit(p)}, 1)" for p in R.MARK_PN)})))), '.,;:') AS value FROM tx WHERE k <> '')
SELECT mk.batch_id, record_id, 'MARKING_PN_CROSS_REF' AS type, 'INFO' AS severity, source, value FROM mk LEFT JOIN pa ON pa.batch_id = mk.batch_id AND pa.k = mk.k
WHERE length(value) >= 5 AND value <> mk.k AND (pa.parent IS NULL OR pa.parent <> value)""")
def v14_steps(spark, sf):
    t = Tables(spark, sf)
    step = lambda no, name, details: F.array(F.struct(F.lit(no).alias("step_no"), F.expr(name).alias("name_en"), F.lit("").alias("name_he"), F.expr(details).alias("details")))
    return T.marking_xref(t.drawings().withColumns({c: step(*s) for c, s in _STEPS.items()}), _edges(t))


INTEGRITY = f"""{ROOTS},
bt AS (SELECT DISTINCT batch_id FROM drawings), nn AS (SELECT bt.batch_id, count(DISTINCT parent_record_id) AS n, max(upper(parent_pn)) AS root_pn FROM bt LEFT JOIN e7 USING (batch_id) GROUP BY 1),
ca AS (SELECT d.batch_id, d.record_id FROM drawings d JOIN nn USING (batch_id) WHERE nn.n = 1 AND d.assembly_role = 'ASSEMBLY'
  AND ({key('d.part_number')} = nn.root_pn OR EXISTS (SELECT 1 FROM bom b WHERE b.batch_id = d.batch_id AND b.parent_record_id = d.record_id))
  QUALIFY row_number() OVER (PARTITION BY d.batch_id ORDER BY CASE WHEN {key('d.part_number')} = nn.root_pn THEN 0 ELSE 1 END, d.pos, d.record_id) = 1),
ki AS (SELECT e7.*, upper(child_pn) AS k FROM e7 JOIN ca ON ca.batch_id = e7.batch_id),
mb AS (SELECT b.*, {key('b.part_number')} AS k FROM bom b JOIN ca ON ca.batch_id = b.batch_id AND ca.record_id = b.parent_record_id WHERE trim(b.part_number) <> ''),
lq AS (SELECT batch_id, k, arg_max(trim(qty), pos) AS q FROM mb GROUP BY 1, 2),
vv AS (SELECT batch_id, 'TREE_STRUCTURE' AS type, 'CRITICAL' AS severity, CAST(n AS VARCHAR) AS value FROM nn WHERE n <> 1
UNION ALL SELECT batch_id, 'TREE_BOM_SOURCE', 'HIGH', '' FROM nn WHERE n = 1 AND batch_id NOT IN (SELECT batch_id FROM ca)
UNION ALL SELECT DISTINCT batch_id, 'MISSING_BOM_ITEMS', 'CRITICAL', k FROM mb WHERE NOT EXISTS (SELECT 1 FROM ki WHERE ki.batch_id = mb.batch_id AND ki.k = mb.k)
UNION ALL SELECT ki.batch_id, 'QTY_MISMATCH', 'CRITICAL', ki.k || ': tree=' || trim(ki.qty) || ', bom=' || q FROM ki JOIN lq ON lq.batch_id = ki.batch_id AND lq.k = ki.k WHERE trim(ki.qty) <> '' AND q <> '' AND trim(ki.qty) <> q
UNION ALL SELECT batch_id, 'PN_DWG_MISMATCH', 'HIGH', k || ' / ' || upper(trim(child_dwg)) FROM ki WHERE child_dwg <> '' AND k <> upper(trim(child_dwg)) AND starts_with(k, 'BP') AND starts_with(upper(trim(child_dwg)), 'BP'))"""


@query("v15_tree_integrity", f"WITH {INTEGRITY} SELECT batch_id, type, severity, value FROM vv")
def v15(spark, sf):
    t = Tables(spark, sf)
    d, bom = _inputs(t)
    return T.tree_integrity(d, bom, _final_edges(t), d.select("batch_id").distinct(), store.materialise)


# a tree that lacks BOM rows: here the children that were not uploaded are left out of the edges
@query("u3_missing_bom_items", f"WITH {INTEGRITY.replace('e7 AS MATERIALIZED (SELECT e.* FROM e8 e JOIN nr', 'e7 AS MATERIALIZED (SELECT e.* FROM (SELECT * FROM e8 WHERE found) e JOIN nr', 1)} SELECT batch_id, type, severity, value FROM vv")
def u3(spark, sf):
    t = Tables(spark, sf)
    d, bom = _inputs(t)
    return T.tree_integrity(d, bom, _final_edges(t).where("found"), d.select("batch_id").distinct(), store.materialise)
