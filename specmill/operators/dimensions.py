"""The five lookup tables: integrity, changes and roll-up per customer."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmill.functions import exprs as E

# table -> (key column, value column); the customer is one of the two
TABLES = {
    "cage": ("cage", "customer"),
    "default_cage": ("customer", "cage"),
    "alias": ("alias", "customer"),
    "pn_prefix": ("prefix", "customer"),
    "internal_spec": ("customer", "pattern"),
}
_CAGE = "(?i)^[A-Z0-9]{3,6}$"


def violations(dims: dict[str, DataFrame]) -> DataFrame:
    """S3: (table, rule, key, value) of blank entries and malformed CAGE codes."""
    out = None
    for name, (k, v) in TABLES.items():
        df = dims[name].select(F.lit(name).alias("table"), F.col(k).alias("key"), F.col(v).alias("value"))
        rules = [F.when((E.strip(F.col("key")) == "") | (E.strip(F.col("value")) == ""), "blank")]
        if name == "cage":
            rules.append(F.when(~F.col("key").rlike(_CAGE), "cage"))
        if name == "default_cage":
            rules.append(F.when(~F.col("value").rlike(_CAGE), "cage"))
        bad = df.withColumn("rule", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull()))).select("table", "rule", "key", "value")
        out = bad if out is None else out.unionByName(bad)
    return out


def require_valid(dims: dict[str, DataFrame]) -> None:
    """Fail loud: any violation, or a pattern that does not compile, aborts."""
    bad = violations(dims).limit(5).collect()
    if bad:
        raise ValueError("invalid dimension rows: " + "; ".join(f"{r.table}/{r.rule}: {r.key!r} -> {r.value!r}" for r in bad))
    try:
        dims["internal_spec"].select(F.regexp_like(F.lit("x"), F.col("pattern")).alias("ok")).where("ok IS NULL").count()
    except (PySparkException, Py4JJavaError) as e:
        raise ValueError(f"invalid pattern in internal_spec: {str(e)[:500]}") from e


def merge_dimensions(dims: dict[str, DataFrame], changes: DataFrame) -> dict[str, DataFrame]:
    """Upsert, rename and delete customers.

    ``changes`` is (op, name, original_name, cage_codes, default_cage, aliases,
    pn_prefixes, spec_patterns), one row per customer. All rows of the old and
    the new name go; new rows replace rows with the same key.
    """
    name, old = E.strip(F.col("name")), E.strip(F.col("original_name"))
    gone = changes.select(F.explode(F.array(name, old)).alias("customer")).where("customer <> ''").distinct()
    up = changes.where("op = 'upsert'")
    vals = lambda c, upper: up.select(name.alias("customer"), F.explode(F.transform(c, (lambda x: E.key(x)) if upper else (lambda x: E.strip(x)))).alias("v")).where("v <> ''").distinct()
    new = {
        "cage": vals("cage_codes", True).select(F.col("v").alias("cage"), "customer"),
        "default_cage": up.select(name.alias("customer"), E.key(F.col("default_cage")).alias("cage")).where("cage <> ''"),
        "alias": vals("aliases", True).select(F.col("v").alias("alias"), "customer"),
        "pn_prefix": vals("pn_prefixes", True).select(F.col("v").alias("prefix"), "customer"),
        "internal_spec": vals("spec_patterns", False).select("customer", F.col("v").alias("pattern")),
    }
    out = {}
    for t, (k, v) in TABLES.items():
        kept = dims[t].select(k, v).join(gone, "customer", "left_anti")
        if t != "internal_spec":
            kept = kept.join(new[t].select(k), k, "left_anti")
        out[t] = kept.select(k, v).unionByName(new[t].select(k, v))
    return out


def update_dimensions(dims: dict[str, DataFrame], changes: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> dict[str, DataFrame]:
    """N15 with S3: the merged tables, written by ``keep`` under new names and validated there.

    A violation or a pattern that does not compile raises ``ValueError``; the old tables are never touched, so a failed change
    leaves them in use.
    """
    merged = {t: keep(df, f"dim_{t}") for t, df in merge_dimensions(dims, changes).items()}
    require_valid(merged)
    return merged


def dimension_rollup(dims: dict[str, DataFrame]) -> DataFrame:
    """One row per customer named anywhere, with sorted codes, aliases, prefixes and patterns."""
    tagged = None
    for t, (k, v) in TABLES.items():
        value = v if k == "customer" else k
        one = dims[t].select("customer", F.lit(t).alias("t"), F.col(value).alias("value"))
        tagged = one if tagged is None else tagged.unionByName(one)
    lists = lambda t: E.joined_sorted(F.collect_set(F.when(F.col("t") == t, F.col("value")))).alias(t)
    return tagged.where("trim(customer) <> ''").groupBy("customer").agg(*[lists(t) for t in TABLES])
