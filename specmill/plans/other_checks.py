"""Queries and checking SQL for comparison, dimensions, sources, sinks, streams and the pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from specmill import refdata as R
from specmill import schemas
from specmill.functions import exprs as E
from specmill.operators import compare as C
from specmill.operators import dimensions as D
from specmill.operators import rules as V
from specmill.operators import standardise as N
from specmill.plans import pipeline, report_checks, rules_checks
from specmill.plans.sqltext import check, key, lit, rx, stem, strip
from specmill.plans.standardise_checks import _n2_sql
from specmill.sources import readers, store, writers
from specmill.sources.adapter import FLAT, Dialect, Tables
from specmill.streaming import jobs

QUERIES = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = check(sql)
        return fn
    return keep


# --- J10
_STRUCTS = {"raw_weight", "part_weight", "packaging_notes"}


def _list_fields():
    return [(c, f) for c, fs in R.DIFF_CATEGORIES.items() for f in fs if schemas.RECORD_TYPES[f].startswith("array")]


def _diff_sql() -> str:
    parts = []
    for c, fs in R.DIFF_CATEGORIES.items():
        for f in fs:
            t = schemas.RECORD_TYPES[f]
            if t.startswith("array"):
                continue
            if f in _STRUCTS:
                parts.append(f"SELECT record_id, '{c}' AS category, '{f}' AS field, 'modified' AS type, '' AS key FROM records a FULL JOIN records2 b USING (record_id) WHERE coalesce(CAST(a.{f} AS VARCHAR), '') <> coalesce(CAST(b.{f} AS VARCHAR), '')")
            else:
                x, y = f"coalesce(trim(a.{f}), '')", f"coalesce(trim(b.{f}), '')"
                parts.append(f"SELECT record_id, '{c}' AS category, '{f}' AS field, CASE WHEN {x} = '' THEN 'added' WHEN {y} = '' THEN 'removed' ELSE 'modified' END AS type, '' AS key FROM records a FULL JOIN records2 b USING (record_id) WHERE {x} <> {y}")
    for c, f in _list_fields():
        t = schemas.RECORD_TYPES[f]
        names = [n for n in R.DIFF_KEYS if f"{n}:" in t]
        kx = "concat_ws(' | ', " + ", ".join(f"CASE WHEN x.{n} <> '' THEN trim(x.{n}) END" for n in names) + ")" if names else "x"
        side = lambda src: (
            f"(SELECT record_id, k, CAST(x AS VARCHAR) AS v FROM (SELECT record_id, x, i, {kx} AS k FROM (SELECT record_id, unnest({f}) AS x, generate_subscripts({f}, 1) AS i FROM {src})) QUALIFY row_number() OVER (PARTITION BY record_id, k ORDER BY i DESC) = 1)")
        parts.append(
            f"SELECT coalesce(a.record_id, b.record_id) AS record_id, '{c}' AS category, '{f}' AS field, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'modified' END AS type, coalesce(a.k, b.k) AS key "
            f"FROM {side('records')} a FULL OUTER JOIN {side('records2')} b ON a.record_id = b.record_id AND a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v")
    return " UNION ALL ".join(p for p in parts if p)


def _runs(t: Tables):
    a, b = t.records(), t.second_run()
    return a.select(*[c for c in a.columns if c in b.columns]), b


@query("j10_diff_revisions", _diff_sql())
def j10(spark, sf):
    a, b = _runs(Tables(spark, sf))
    return C.explode_changes(C.diff_revisions(a, b)).select("record_id", "category", "field", "type", "key")


@query("j10_diff_summary", f"""WITH ch AS ({_diff_sql()}), s AS (SELECT record_id, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS cats FROM ch GROUP BY 1),
 lb AS (SELECT record_id, CASE WHEN trim(a.part_number) <> '' THEN trim(a.part_number) ELSE '?' END || ' Rev ' || CASE WHEN trim(a.revision) <> '' THEN trim(a.revision) ELSE '?' END AS label_a,
 CASE WHEN trim(b.part_number) <> '' THEN trim(b.part_number) ELSE '?' END || ' Rev ' || CASE WHEN trim(b.revision) <> '' THEN trim(b.revision) ELSE '?' END AS label_b FROM records a FULL JOIN records2 b USING (record_id))
SELECT lb.record_id, label_a, label_b, coalesce(n, 0) AS total_changes, coalesce(cats, '') AS categories FROM lb LEFT JOIN s USING (record_id)""")
def j10_summary(spark, sf):
    a, b = _runs(Tables(spark, sf))
    df = C.diff_summary(C.diff_revisions(a, b))
    return df.withColumn("categories", F.concat_ws(",", F.sort_array(F.split("categories", ","))))


# --- J11
def _blank(s: str, f: str) -> str:
    return f"len({s}.{f}) = 0" if f == "revisions_history" else f"trim({s}.{f}) = ''"


@query("j11_run_changes", " UNION ALL ".join(
    [f"SELECT a.record_id, '{f}' AS field, '{n}' AS change FROM records a JOIN records2 b USING (record_id) WHERE {c}"
     for f in C._TRACKED for n, c in (("gained", f"{_blank('a', f)} AND NOT {_blank('b', f)}"), ("lost", f"NOT {_blank('a', f)} AND {_blank('b', f)}"))]
    + [f"SELECT a.record_id, '{f}', 'changed' FROM records a JOIN records2 b USING (record_id) WHERE a.{f} IS DISTINCT FROM b.{f}" for f in ("part_number", "drawing_number")]
    + ["SELECT a.record_id, 'customer', 'renamed' FROM records a JOIN records2 b USING (record_id) WHERE a.customer <> '' AND b.customer <> '' AND a.customer <> b.customer"]))
def j11(spark, sf):
    return C.run_changes(*_runs(Tables(spark, sf)))


def _metrics_sql() -> str:
    pt = "regexp_replace(upper({}), '[\\s\\-.,/]', '', 'g')"

    def m(s: str) -> dict[str, str]:
        pn, nm = pt.format(f"{s}.part_number"), pt.format(stem("a.source_filename"))
        out = {f"{f.replace('_history', '').replace('_code', '')}_empty": f"count(*) FILTER ({_blank(s, f)})" for f in C._TRACKED}
        out |= {"pn_truncated": f"count(*) FILTER (length({pn}) >= 6 AND NOT contains({nm}, {pn}))", "warnings": f"sum(len({s}._pn_warnings))",
                "sus_standards": f"sum(len(list_filter({s}._pn_warnings, lambda w: contains(w, 'SUSPICIOUS_STANDARD'))))",
                "bom_items_total": f"sum(len({s}.bom_items))", "rev_entries_total": f"sum(len({s}.revisions_history))", "cost": f"sum({s}._cost_info.total_cost_usd)"}
        return out

    a, b = m("a"), m("b")
    return " UNION ALL ".join(
        f"SELECT '{k}' AS metric, CAST({a[k]} AS DOUBLE) AS first_run, CAST({b[k]} AS DOUBLE) AS second_run, round(CAST({b[k]} AS DOUBLE) - CAST({a[k]} AS DOUBLE), 6) AS delta FROM records a JOIN records2 b USING (record_id)" for k in a)


@query("j11_run_metrics", _metrics_sql())
def j11_metrics(spark, sf):
    return C.run_metrics(*_runs(Tables(spark, sf)))


# --- J12: one turn of a conversation against the next
_PASS = """SELECT CAST(a.conv_id AS {s}) || '-' || CAST(a.turn AS {s}) AS pair_id, {m1} AS json_1, {m2} AS json_2 FROM {c} a JOIN {c} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""
_MARK = "{t}.text || ' RAL ' || CAST(7030 + length({t}.text) % 3 AS {s}) || CASE length({t}.text) % 4 WHEN 0 THEN ' EPOXY BY JOTUN' WHEN 1 THEN ' TOPCOAT BY TAMBOUR RAL7001' ELSE '' END"


def _passes(c: str, s: str) -> str:
    return _PASS.format(c=c, s=s, m1=_MARK.format(t="a", s=s), m2=_MARK.format(t="b", s=s))


_SET = "list_sort(list_distinct(regexp_extract_all({}, {})))"
_R1, _R2 = _SET.format("json_1", lit(R.RAL_ANY)), _SET.format("json_2", lit(R.RAL_ANY))
_B1, _B2 = _SET.format("json_1", lit(R.BRAND_STRICT)), _SET.format("json_2", lit(R.BRAND_STRICT))


def _two_pass(spark, sf):
    Tables(spark, sf).source("conversations").createOrReplaceTempView("two_pass_turns")
    return C.two_pass_compare(spark.sql(_passes("two_pass_turns", "STRING")))


@query("j12_two_pass_compare", f"""WITH ps AS ({_passes('conversations', 'VARCHAR')}), st AS (SELECT pair_id, {_R1} AS r1, {_R2} AS r2, {_B1} AS b1, {_B2} AS b2 FROM ps)
SELECT pair_id, 'RAL_MISMATCH' AS type, 'CRITICAL' AS severity, '1: ' || array_to_string(r1, ', ') || ' | 2: ' || array_to_string(r2, ', ') AS value FROM st WHERE r1 <> r2
UNION ALL SELECT pair_id, 'BRAND_MISMATCH', 'HIGH', '1: ' || array_to_string(b1, ', ') || ' | 2: ' || array_to_string(b2, ', ') FROM st WHERE b1 <> b2""")
def j12(spark, sf):
    return _two_pass(spark, sf).select("pair_id", F.explode("findings").alias("f")).select("pair_id", "f.type", "f.severity", "f.value")


@query("j12_merged", f"""WITH ps AS ({_passes('conversations', 'VARCHAR')})
SELECT pair_id, md5(CASE WHEN {_R1} <> {_R2} THEN regexp_replace(json_1, {lit('(' + R.RAL_ANY + ')')}, '[VERIFY: \\1]', 'g') ELSE json_1 END) AS merged_md5 FROM ps""")
def j12_merged(spark, sf):
    return _two_pass(spark, sf).select("pair_id", F.md5("merged").alias("merged_md5"))


@query("j12_gate", f"""WITH g AS (SELECT record_id, len(painting_processes) AS n, CAST(painting_processes AS VARCHAR) || ' ' || CAST(standards AS VARCHAR) || ' ' || notes AS tx FROM records)
SELECT record_id, n > 0 AND ({rx('tx', R.RAL_ANY)} OR {rx('tx', R.BRAND_STRICT)}) AS second_pass FROM g""")
def j12_gate(spark, sf):
    text = F.concat_ws(" ", F.to_json("painting_processes"), F.to_json("standards"), F.col("notes"))
    return Tables(spark, sf).records().select("record_id", C.needs_second_pass(F.col("painting_processes"), text).alias("second_pass"))


# --- S3, N15, A20
def _dims(t: Tables):
    return {"cage": t.flat("dim_cage"), "default_cage": t.flat("dim_default_cage"), "alias": t.flat("dim_alias"),
            "pn_prefix": t.flat("dim_pn_prefix"), "internal_spec": t.flat("dim_internal_spec")}


# customers with codes of every kind, some malformed
_CODE = "CASE c_custkey % 5 WHEN 0 THEN 'C!' || CAST(c_custkey AS {s}) WHEN 1 THEN '' WHEN 2 THEN 'TOOLONG' || CAST(c_custkey AS {s}) ELSE substr('K' || lpad(CAST(c_custkey AS {s}), 8, '0'), 4) END"


@query("s3_dimension_violations", f"""WITH c AS (SELECT c_name, {_CODE.format(s='VARCHAR')} AS code FROM customer)
SELECT 'cage' AS "table", 'blank' AS rule, code AS key, c_name AS value FROM c WHERE code = '' UNION ALL SELECT 'cage', 'cage', code, c_name FROM c WHERE NOT regexp_matches(code, '(?i)^[A-Z0-9]{{3,6}}$')
UNION ALL SELECT 'default_cage', 'blank', c_name, code FROM c WHERE code = '' UNION ALL SELECT 'default_cage', 'cage', c_name, code FROM c WHERE NOT regexp_matches(code, '(?i)^[A-Z0-9]{{3,6}}$')""")
def s3(spark, sf):
    t = Tables(spark, sf)
    c = t.source("customer").selectExpr("c_name AS customer", f"{_CODE.format(s='STRING')} AS cage")
    return D.violations({**_dims(t), "cage": c, "default_cage": c})


_OP = "CASE WHEN s_nationkey % 3 = 0 THEN 'delete' ELSE 'upsert' END"
_OLD = "'Supplier Works ' || lpad(CAST(s_suppkey AS {s}), 6, '0') || ' Ltd.'"
_NEW = "CASE WHEN s_nationkey % 3 = 1 THEN 'Renamed ' || CAST(s_suppkey AS {s}) ELSE " + _OLD + " END"


def _changes(spark, t: Tables):
    s = "STRING"
    return t.source("supplier").where("s_acctbal > 4000").selectExpr(
        f"{_OP} AS op", f"CASE WHEN {_OP} = 'delete' THEN {_OLD.format(s=s)} ELSE {_NEW.format(s=s)} END AS name", f"{_OLD.format(s=s)} AS original_name",
        "array('n' || CAST(s_suppkey AS STRING), '', 'C00001') AS cage_codes", "'n' || CAST(s_suppkey AS STRING) AS default_cage",
        "array('alias ' || CAST(s_suppkey AS STRING)) AS aliases", "array('q' || CAST(s_suppkey AS STRING)) AS pn_prefixes", "array('^Q[0-9]+', ' ') AS spec_patterns"
    ).withColumn("cage_codes", F.filter("cage_codes", lambda x: x != "C00001"))


_CHG = f"""ch AS (SELECT {_OP} AS op, CASE WHEN {_OP} = 'delete' THEN {_OLD.format(s='VARCHAR')} ELSE {_NEW.format(s='VARCHAR')} END AS name, {_OLD.format(s='VARCHAR')} AS old, CAST(s_suppkey AS VARCHAR) AS k FROM supplier WHERE s_acctbal > 4000),
gn AS (SELECT name AS customer FROM ch UNION SELECT old FROM ch),
mc AS (SELECT cage, customer FROM dim_cage WHERE customer NOT IN (SELECT customer FROM gn) AND cage NOT IN (SELECT 'N' || k FROM ch WHERE op = 'upsert') UNION ALL SELECT 'N' || k, name FROM ch WHERE op = 'upsert'),
md AS (SELECT customer, cage FROM dim_default_cage WHERE customer NOT IN (SELECT customer FROM gn) UNION ALL SELECT name, 'N' || k FROM ch WHERE op = 'upsert'),
ma AS (SELECT alias, customer FROM dim_alias WHERE customer NOT IN (SELECT customer FROM gn) UNION ALL SELECT 'ALIAS ' || k, name FROM ch WHERE op = 'upsert'),
mp AS (SELECT prefix, customer FROM dim_pn_prefix WHERE customer NOT IN (SELECT customer FROM gn) AND prefix NOT IN (SELECT 'Q' || k FROM ch WHERE op = 'upsert') UNION ALL SELECT 'Q' || k, name FROM ch WHERE op = 'upsert'),
ms AS (SELECT customer, pattern FROM dim_internal_spec WHERE customer NOT IN (SELECT customer FROM gn) UNION ALL SELECT name, '^Q[0-9]+' FROM ch WHERE op = 'upsert')"""


@query("n15_merge_dimension", f"""WITH {_CHG} SELECT 'cage' AS "table", cage AS key, customer AS value FROM mc UNION ALL SELECT 'default_cage', customer, cage FROM md UNION ALL SELECT 'alias', alias, customer FROM ma
UNION ALL SELECT 'pn_prefix', prefix, customer FROM mp UNION ALL SELECT 'internal_spec', customer, pattern FROM ms""")
def n15(spark, sf):
    t = Tables(spark, sf)
    out = None
    for name, df in D.merge_dimensions(_dims(t), _changes(spark, t)).items():
        k, v = D.TABLES[name]
        one = df.select(F.lit(name).alias("table"), F.col(k).alias("key"), F.col(v).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a20_dimension_rollup", f"""WITH {_CHG}, al AS (SELECT customer, 'c' AS t, cage AS v FROM mc UNION ALL SELECT customer, 'd', cage FROM md UNION ALL SELECT customer, 'a', alias FROM ma UNION ALL SELECT customer, 'p', prefix FROM mp UNION ALL SELECT customer, 's', pattern FROM ms)
SELECT customer, {', '.join(f"coalesce(string_agg(DISTINCT v, '|' ORDER BY v) FILTER (t = '{c}'), '') AS {n}" for c, n in (('c', 'cage'), ('d', 'default_cage'), ('a', 'alias'), ('p', 'pn_prefix'), ('s', 'internal_spec')))} FROM al GROUP BY 1""")
def a20(spark, sf):
    t = Tables(spark, sf)
    return D.dimension_rollup(D.merge_dimensions(_dims(t), _changes(spark, t)))


# --- S2, S5, S7, S9
_BAD = "event_type = 'error' AND user_id % 2 = 0"


def _lines(spark, t: Tables):
    h = t.flat("history").join(t.source("events").select("event_id", F.expr(_BAD).alias("bad")), "event_id")
    body = F.to_json(F.struct(*[c for c in t.flat("history").columns if c != "event_id"]))
    return h.select(F.col("event_id").alias("line"), F.when(F.col("bad"), F.substr(body, F.lit(1), F.lit(40))).otherwise(body).alias("value"))


@query("s2_read_ledger", f"""SELECT h.event_id AS line, strftime(h.timestamp, '%Y-%m-%d') AS day, h.filename, h.mode, h.review_status, CAST(h.cost_usd AS DOUBLE) AS cost_usd, h.cache_hit FROM history h JOIN events e USING (event_id) WHERE NOT ({_BAD})""")
def s2(spark, sf):
    df = readers.parse_ledger(_lines(spark, Tables(spark, sf)), schemas.HISTORY_DDL)
    return df.select("line", F.to_date("timestamp").cast("string").alias("day"), "filename", "mode", "review_status",
                     F.col("cost_usd").cast("double").alias("cost_usd"), "cache_hit")


@query("s5_file_manifest", """SELECT url AS path, regexp_extract(url, '([^/\\\\]*)$', 1) AS source_filename, CAST(octet_length(encode(html)) AS BIGINT) AS length, md5(html) AS fingerprint,
 lower(regexp_extract(url, '\\.([^./\\\\?#]+)$', 1)) AS suffix, CASE WHEN regexp_matches(url, '(?i)\\.pdf$') THEN 'pdf' WHEN regexp_matches(url, '(?i)\\.(png|jpe?g|tiff?|bmp|webp)$') THEN 'image' ELSE 'other' END AS route,
 CASE WHEN regexp_matches(url, '(?i)\\.pdf$') THEN 'bad_magic' ELSE '' END AS rejected FROM (SELECT CASE page_id % 3 WHEN 0 THEN url || '.PDF' WHEN 1 THEN url || '.png' ELSE url END AS url, html FROM pages)""")
def s5(spark, sf):
    files = Tables(spark, sf).source("pages").selectExpr(
        "CASE page_id % 3 WHEN 0 THEN url || '.PDF' WHEN 1 THEN url || '.png' ELSE url END AS path", "CAST(html AS BINARY) AS content").withColumn("length", F.length("content"))
    return readers.manifest_columns(files).select("path", "source_filename", "length", "fingerprint", "suffix", "route", "rejected")


@query("s5_manifest_of_table_files")
def s5_files(spark, sf):
    return readers.file_manifest(spark, sf).select("source_filename", "length", "fingerprint", "suffix", "route", "rejected")


@query("s7_ledger_lines", """SELECT event_id, action, CASE WHEN "user" <> '' THEN "user" ELSE 'system' END AS "user", details IS NOT NULL AS has_details, model <> '' AS has_model, cost_usd <> 0 AS has_cost FROM audit""")
def s7(spark, sf):
    a = Tables(spark, sf).flat("audit")
    lines = writers.ledger_lines(writers.audit_rows(a))
    g = lambda f: F.get_json_object("value", f"$.{f}")
    return lines.select(g("event_id").cast("bigint").alias("event_id"), g("action").alias("action"), g("user").alias("user"),
                        g("details").isNotNull().alias("has_details"), g("model").isNotNull().alias("has_model"), g("cost_usd").isNotNull().alias("has_cost"))


@query("s9_flagged_rows", f"SELECT r.source_filename AS file, replace(f.value, ',', ';') AS flagged_standard FROM ({rules_checks._STD}) f JOIN records r USING (record_id)")
def s9(spark, sf):
    t = Tables(spark, sf)
    r = V.with_own_patterns(t.records(), t.flat("dim_internal_spec"))
    return writers.flagged_rows(V.collect_findings(r, {"std": V.standards_body}), t.records())


# written as two saves, one of them twice, and read back: every column is compared, texts with SQL and lists with the original
_SAVED = {c: schemas.RECORD_TYPES.get(c, "") for c, _ in FLAT["records"][1][-1](Dialect(True))}
_TEXTS = [c for c, t in _SAVED.items() if t == "string"]
_LISTS = [c for c, t in _SAVED.items() if t.startswith("array")]


@query("s6_saved_records", f"""SELECT {', '.join(f'"{c}"' for c in _TEXTS)}, {', '.join(f'CAST(len("{c}") AS BIGINT) AS "n_{c}"' for c in _LISTS)},
TRUE AS saved, TRUE AS same FROM records""")
def s6(spark, sf):
    records = Tables(spark, sf).records()
    out = store.new_path(spark, "s6")
    odd = F.pmod(F.xxhash64("record_id"), F.lit(2)) == 1
    writers.write_records(records.where(odd), out, save_id="odd")
    for _ in range(2):
        writers.write_records(records.where(~odd), out, save_id="even")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)
    got = readers.read_saved(spark, out, ddl + ", _saved_at timestamp")
    both = got.join(records.select("record_id", F.struct(*records.columns).alias("o")), "record_id", "left")
    same = F.struct(*[F.col(c) for c in records.columns]).eqNullSafe(F.col("o"))
    return both.select(*_TEXTS, *[F.size(c).cast("bigint").alias(f"n_{c}") for c in _LISTS], F.col("_saved_at").isNotNull().alias("saved"), same.alias("same"))


# appended as two saves, one of them twice, and read back
@query("s7_append_ledger", """SELECT event_id, action, CASE WHEN "user" <> '' THEN "user" ELSE 'system' END AS "user", subject, CASE WHEN details <> '' THEN details END AS details, CASE WHEN model <> '' THEN model END AS model, cost_usd <> 0 AND cost_usd IS NOT NULL AS has_cost FROM audit""")
def s7_append(spark, sf):
    rows = writers.audit_rows(Tables(spark, sf).flat("audit"))
    out = store.new_path(spark, "s7")
    odd = F.col("event_id") % 2 == 1
    writers.append_ledger(rows.where(odd), out, save_id="odd")
    for _ in range(2):
        writers.append_ledger(rows.where(~odd), out, save_id="even")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    got = readers.read_ledger(spark, out, ddl)
    return got.select("event_id", "action", "user", "subject", "details", "model", F.col("cost_usd").isNotNull().alias("has_cost"))


@query("s4_read_catalog", f"SELECT {', '.join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in [f'"{x}"' for x in readers.CATALOG_COLUMNS])} FROM catalog")
def s4(spark, sf):
    out = store.new_path(spark, "s4")
    Tables(spark, sf).flat("catalog").select(*readers.CATALOG_COLUMNS).write.option("header", True).csv(out)
    return readers.read_catalog(spark, out).select(*readers.CATALOG_COLUMNS)


# --- X1, X2, X3: the streams run to the end of the files at hand
def _events_stream(spark, t: Tables):
    schema = t.source("events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)


def _in_turn(spark, df, by: str, parts: int, path: str) -> None:
    """Writes ``df`` as ``parts`` files, one after the other by ranges of ``by``, so that a file stream takes them in order."""
    edges = df.approxQuantile(by, [i / parts for i in range(1, parts)], 0.01)
    for i, (low, high) in enumerate(zip([None, *edges], [*edges, None], strict=True)):
        part = df if low is None else df.where(F.col(by) > low)
        (part if high is None else part.where(F.col(by) <= high)).coalesce(1).write.mode("append").parquet(path)


# the records arrive in two micro-batches; of each (part number, revision) the first is repaired and stored whole
@query("x1_stream_new_records", f"""WITH one AS (SELECT min(record_id) AS record_id FROM records GROUP BY part_number, revision)
SELECT n.record_id, n.part_number, n.drawing_number, n.pn_rule, r.batch_id, r.fingerprint, r.source_filename, r.revision, r.title, r.notes
FROM one JOIN ({_n2_sql()}) n ON n.record_id = one.record_id JOIN records r ON r.record_id = one.record_id""")
def x1(spark, sf):
    t = Tables(spark, sf)
    out = store.new_path(spark, "x1")
    _in_turn(spark, t.source("part"), "p_partkey", 2, out + "/in")
    source = spark.readStream.schema(t.source("part").schema).option("maxFilesPerTrigger", 1).parquet(out + "/in")
    # a micro-batch is one small file, so one task: its rows are dealt out before they become wide records
    source = source.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    records = t.typed_records(t.project(source, FLAT["records"][1]))
    repair = lambda df: N.reconcile_identifiers(N.identifier_candidates(df))
    jobs.new_records(records, out + "/table", out + "/checkpoint", ["part_number", "revision"], repair, F.col("record_id")).awaitTermination()
    return spark.read.parquet(out + "/table").select(
        "record_id", "part_number", "drawing_number", "pn_rule", "batch_id", "fingerprint", "source_filename", "revision", "title", "notes")


@query("x2_stream_daily_costs", """WITH d AS (SELECT strftime(timestamp, '%Y-%m-%d') AS day, coalesce(mode, 'unknown') AS mode, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd, count(*) AS count, date_trunc('day', timestamp) AS st FROM history GROUP BY 1, 2, 5)
SELECT day, mode, cost_usd, count FROM d WHERE st + INTERVAL 1 DAY <= (SELECT max(timestamp) FROM history) - INTERVAL 1 DAY""")
def x2(spark, sf):
    t = Tables(spark, sf)
    out = store.new_path(spark, "x2")
    history = t.project(_events_stream(spark, t), FLAT["history"][1])
    jobs.append_to_table(jobs.daily_costs(history), out + "/table", out + "/checkpoint").awaitTermination()
    df = spark.read.parquet(out + "/table")
    return df.select(F.col("day").cast("string").alias("day"), "mode", F.col("cost_usd").cast("double").alias("cost_usd"), "count")


# the open days too: every day's total so far, and whether it can still change
@query("x2_stream_daily_costs_live", """SELECT strftime(timestamp, '%Y-%m-%d') AS day, coalesce(mode, 'unknown') AS mode, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd, count(*) AS count,
date_trunc('day', any_value(timestamp)) + INTERVAL 1 DAY <= (SELECT max(timestamp) FROM history) - INTERVAL 1 DAY AS final FROM history GROUP BY 1, 2""")
def x2_live(spark, sf):
    t = Tables(spark, sf)
    out = store.new_path(spark, "x2")
    history = t.project(_events_stream(spark, t), FLAT["history"][1])
    jobs.upsert_to_table(jobs.running_daily_costs(history), out + "/table", out + "/checkpoint").awaitTermination()
    return jobs.latest_daily_costs(spark, out + "/table").select(
        F.col("day").cast("string").alias("day"), "mode", F.col("cost_usd").cast("double").alias("cost_usd"), "count", "final")


@query("x3_stream_batch_outcome", """SELECT batch_id, count(*) AS total, count(*) FILTER (NOT failed) AS succeeded, count(*) FILTER (failed) AS failed, CAST(coalesce(sum(cost_usd) FILTER (NOT failed), 0) AS DOUBLE) AS cost_usd FROM drawings GROUP BY 1""")
def x3(spark, sf):
    t = Tables(spark, sf)
    schema = t.written_drawings().schema
    out = store.new_path(spark, "x3")
    stream = spark.readStream.schema(schema).parquet(t.path_of("drawings"))
    jobs.upsert_to_table(jobs.batch_outcome(stream), out + "/table", out + "/checkpoint").awaitTermination()
    return jobs.latest(spark, out + "/table", ["batch_id"]).withColumn("cost_usd", F.col("cost_usd").cast("double"))


# --- the pipelines end to end (rows only: they contain the word loop of the BOM texts)
@query("pipeline_record_findings")
def pipeline_records(spark, sf):
    t = Tables(spark, sf)
    done = pipeline.process_records(t.records(), t.flat("texts"), _dims(t), "all", store.materialise)
    return pipeline.pipeline_findings(done).groupBy("type", "severity").agg(F.count("*").alias("count"), F.count_distinct("record_id").alias("records"))


@query("pipeline_batch_tree")
def pipeline_batches(spark, sf):
    t = Tables(spark, sf)
    return pipeline.process_batches(t.drawings(), t.bom(), store.materialise, ("tree",))["tree"]
