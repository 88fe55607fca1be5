"""Comparison of two versions of the same records. One join on the record key; everything else stays in the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmill import refdata as R
from specmill.functions import exprs as E

_CHANGE = "array<struct<category:string,field:string,type:string,key:string,old:string,new:string>>"


# ------------------------------------------------------------------ J10
def _change(category: str, field: str, type_: Column | str, key: Column, old: Column, new: Column) -> Column:
    t = F.lit(type_) if isinstance(type_, str) else type_
    return F.struct(F.lit(category).alias("category"), F.lit(field).alias("field"), t.alias("type"), key.alias("key"),
                    old.alias("old"), new.alias("new"))


def _entries(items: Column, element: T.DataType, side: int) -> Column:
    """(key, side, order, text) of every item; the last of equal keys comes first. Null items do not count.

    The key joins the filled key fields; an item without any is known by its whole text.
    """
    if isinstance(element, T.StructType):
        names = [f for f in R.DIFF_KEYS if f in element.fieldNames()]
        text = lambda x: F.to_json(x)
        key = lambda x: F.coalesce(
            E.nullif_blank(F.concat_ws(" | ", *[F.when(x[n] != "", E.strip(x[n])) for n in names])),
            F.to_json(x))
    else:
        text = key = lambda x: x.cast("string")
    filled = F.filter(F.coalesce(items, F.array().cast(T.ArrayType(element))), lambda x: x.isNotNull())
    return F.transform(filled, lambda x, i: F.struct(key(x).alias("k"), F.lit(side).alias("side"), (-i).alias("order"), text(x).alias("v")))


def _list_changes(category: str, field: str, a: Column, b: Column, element: T.DataType) -> Column:
    """Both lists sorted together by key: an entry's partner is its neighbour, so the work is that of one sort.

    A repeated key keeps its last item; equal lists are not looked into.
    """
    none, change = F.lit(None).cast("string"), lambda t, e, old, new: _change(category, field, t, e["k"], old, new)
    beside = lambda es, i, e: F.coalesce(F.get(es, i)["k"] == e["k"], F.lit(False))
    last = lambda es: F.filter(es, lambda e, i: ~(beside(es, i - 1, e) & (F.get(es, i - 1)["side"] == e["side"])) | (i == 0))
    changes = lambda es: F.transform(es, lambda e, i: F.when(
        e["side"] == 1, F.when(~beside(es, i - 1, e), change("added", e, none, e["v"]))
    ).when(~beside(es, i + 1, e), change("removed", e, e["v"], none)
    ).when(F.get(es, i + 1)["v"] != e["v"], change("modified", e, e["v"], F.get(es, i + 1)["v"])))
    both = F.array_sort(F.concat(_entries(a, element, 0), _entries(b, element, 1)))
    found = F.filter(E.let(E.let(both, last), changes), lambda c: c.isNotNull())
    return F.when(a.eqNullSafe(b), F.array().cast(_CHANGE)).otherwise(found.cast(_CHANGE))


def diff_revisions(a: DataFrame, b: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, label_a, label_b, changes) per pair of versions; ``changes`` holds category, field, type, key, old, new.

    A record on one side only is compared with an empty one; a struct that is missing there counts as modified.
    """
    fields = {f.name: f.dataType for f in a.schema if f.name in b.columns}
    wanted = [(c, f) for c, fs in R.DIFF_CATEGORIES.items() for f in fs if f in fields]
    labels = ["part_number", "revision"]
    cols = list(dict.fromkeys([f for _, f in wanted] + labels))
    j = a.select(key, F.struct(*cols).alias("a")).join(b.select(key, F.struct(*cols).alias("b")), key, "full")
    parts = []
    for category, f in wanted:
        x, y = F.col(f"a.{f}"), F.col(f"b.{f}")
        if isinstance(fields[f], T.ArrayType):
            parts.append(_list_changes(category, f, x, y, fields[f].elementType))
            continue
        if isinstance(fields[f], T.StructType):
            x, y = F.coalesce(F.to_json(x), F.lit("")), F.coalesce(F.to_json(y), F.lit(""))
            kind = F.lit("modified")
        else:
            x, y = E.strip(x), E.strip(y)
            kind = F.when(x == "", "added").when(y == "", "removed").otherwise("modified")
        parts.append(F.when(x != y, F.array(_change(category, f, kind, F.lit(""), x, y))).otherwise(F.array()).cast(_CHANGE))
    mark = lambda side, c: F.when(E.strip(F.col(f"{side}.{c}")) != "", E.strip(F.col(f"{side}.{c}"))).otherwise("?")
    label = lambda side: F.concat(mark(side, "part_number"), F.lit(" Rev "), mark(side, "revision"))
    return j.select(key, label("a").alias("label_a"), label("b").alias("label_b"), F.concat(*parts).alias("changes"))


def explode_changes(diff: DataFrame, key: str = "record_id") -> DataFrame:
    return diff.select(key, F.explode("changes").alias("c")).select(key, "c.*")


def diff_summary(diff: DataFrame, key: str = "record_id") -> DataFrame:
    """Changes and changed categories per pair, counted inside the row."""
    return diff.select(
        key, "label_a", "label_b", F.size("changes").cast("bigint").alias("total_changes"),
        F.concat_ws(",", F.array_distinct(F.transform("changes", lambda c: c["category"]))).alias("categories"))


# ------------------------------------------------------------------ J11
_TRACKED = ["customer", "cage_code", "material", "title", "revisions_history"]


def _blank(side: str, f: str, t: T.DataType) -> Column:
    c = F.col(f"{side}.{f}")
    return (F.size(c) <= 0) | c.isNull() if isinstance(t, T.ArrayType) else E.strip(c) == ""


def _run_pairs(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    return first.select(key, F.struct("*").alias("a")).join(second.select(key, F.struct("*").alias("b")), key)


def run_changes(first: DataFrame, second: DataFrame, key: str = "record_id") -> DataFrame:
    """Fields gained, lost or changed between two runs over the same files."""
    types = {f.name: f.dataType for f in first.schema}
    items = []
    add = lambda cond, field, change: items.append(F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(change).alias("change"))))
    for f in _TRACKED:
        ea, eb = _blank("a", f, types[f]), _blank("b", f, types[f])
        add(ea & ~eb, f, "gained")
        add(~ea & eb, f, "lost")
    for f in ("part_number", "drawing_number"):
        add(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f, "changed")
    add((F.col("a.customer") != "") & (F.col("b.customer") != "") & (F.col("a.customer") != F.col("b.customer")), "customer", "renamed")
    return _run_pairs(first, second, key).select(key, F.explode(F.array(*items)).alias("x")).where("x IS NOT NULL").select(key, "x.*")


def run_metrics(first: DataFrame, second: DataFrame, key: str = "record_id") -> DataFrame:
    """Metric totals of both runs and their difference, from one aggregation."""
    types = {f.name: f.dataType for f in first.schema}

    def metric(side: str) -> dict[str, Column]:
        n = lambda f: F.sum(F.coalesce(F.size(F.col(f"{side}.{f}")), F.lit(0)).cast("bigint"))
        pn = E.plain_text(F.col(f"{side}.part_number"))
        name = E.plain_text(E.stem(E.file_name(F.col("a.source_filename"))))
        out = {f"{f.replace('_history', '').replace('_code', '')}_empty": F.count_if(_blank(side, f, types[f])) for f in _TRACKED}
        out["pn_truncated"] = F.count_if((F.length(pn) >= 6) & ~name.contains(pn))
        out["warnings"] = n("_pn_warnings")
        out["sus_standards"] = F.sum(F.size(F.filter(F.col(f"{side}._pn_warnings"), lambda w: w.contains("SUSPICIOUS_STANDARD"))).cast("bigint"))
        out["bom_items_total"] = n("bom_items")
        out["rev_entries_total"] = n("revisions_history")
        out["cost"] = F.sum(F.col(f"{side}._cost_info.total_cost_usd"))
        return {k: v.cast("double") for k, v in out.items()}

    ma, mb = metric("a"), metric("b")
    row = _run_pairs(first, second, key).agg(*[v.alias(f"a_{k}") for k, v in ma.items()], *[v.alias(f"b_{k}") for k, v in mb.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"a_{k}").alias("first_run"), F.col(f"b_{k}").alias("second_run")) for k in ma])
    return row.select(F.explode(rows).alias("x")).select("x.*").withColumn("delta", F.round(F.col("second_run") - F.col("first_run"), 6))


# ------------------------------------------------------------------ J12
def needs_second_pass(painting: Column, text: Column) -> Column:
    """Only records with painting and a colour or brand are worth a second pass."""
    return (F.size(painting) > 0) & (text.rlike(R.RAL_ANY) | text.rlike(R.BRAND_STRICT))


def two_pass_compare(passes: DataFrame) -> DataFrame:
    """``passes`` is (pair_id, json_1, json_2). Adds ``findings`` and ``merged``.

    Colour sets that differ mark every colour of the first pass once with
    ``[VERIFY: …]``.
    """
    found = lambda c, p: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(p), 0)))
    df = passes.withColumns({"_r1": found(F.col("json_1"), R.RAL_ANY), "_r2": found(F.col("json_2"), R.RAL_ANY),
                             "_b1": found(F.col("json_1"), R.BRAND_STRICT), "_b2": found(F.col("json_2"), R.BRAND_STRICT)})
    show = lambda a, b: F.concat(F.lit("1: "), F.concat_ws(", ", a), F.lit(" | 2: "), F.concat_ws(", ", b))
    ral, brand = F.col("_r1") != F.col("_r2"), F.col("_b1") != F.col("_b2")
    findings = F.concat(
        E.findings_if(ral, E.finding("RAL_MISMATCH", "CRITICAL", "two_pass", show(F.col("_r1"), F.col("_r2")), "colours differ")),
        E.findings_if(brand, E.finding("BRAND_MISMATCH", "HIGH", "two_pass", show(F.col("_b1"), F.col("_b2")), "brands differ")))
    merged = F.when(ral, F.regexp_replace("json_1", "(" + R.RAL_ANY + ")", "[VERIFY: $1]")).otherwise(F.col("json_1"))
    return df.withColumns({"findings": findings, "merged": merged}).select(*passes.columns, "findings", "merged")
