"""Cost, history and audit ledgers: pricing, roll-ups and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specmill import refdata as R

USD = "decimal(18,6)"
_DEC = "decimal(38,12)"


# ------------------------------------------------------------------ A1
def _price(model: Column, which: int) -> Column:
    out = None
    for mark, *prices in R.PRICES:
        value = F.lit(prices[which]).cast("decimal(10,4)")
        cond = F.lit(False)
        for m in mark.split("|"):
            cond = cond | F.lower(model).contains(m)
        out = F.when(cond, value) if out is None else (out.when(cond, value) if mark else out.otherwise(value))
    return out


def price_calls(calls: DataFrame, surcharge: bool = True) -> DataFrame:
    """A1: USD per call (six decimals; the total is rounded from the unrounded parts)."""
    factor = F.lit(R.SURCHARGE if surcharge else "1").cast("decimal(6,2)")
    part = lambda tokens, i: (F.col(tokens).cast("decimal(18,0)") * _price(F.col("model"), i) * factor).cast(_DEC) / F.lit(1000000)
    i, o = part("input_tokens", 0).cast(_DEC), part("output_tokens", 1).cast(_DEC)
    return calls.withColumns({
        "input_cost_usd": i.cast(USD), "output_cost_usd": o.cast(USD), "total_cost_usd": (i + o).cast(USD),
    })


def rollup_costs(priced: DataFrame, by: list[str]) -> DataFrame:
    """A1: tokens, USD and ILS per group."""
    df = priced.groupBy(*by).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("total_cost_usd").cast(USD).alias("total_cost_usd"))
    return df.withColumn("total_cost_ils", (F.col("total_cost_usd") * F.lit(R.ILS_PER_USD).cast("decimal(4,2)")).cast("decimal(18,4)"))


# ------------------------------------------------------------------ A2 .. A6
def cost_summary(costs: DataFrame) -> DataFrame:
    """A2: count, total, average and tokens; no row for an empty ledger."""
    return costs.agg(
        F.count("*").alias("count"), F.round(F.coalesce(F.sum("total_cost_usd"), F.lit(0)), 4).alias("total_cost_usd"),
        F.round((F.sum("total_cost_usd") / F.count("*")), 4).alias("avg_cost_usd"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output_tokens"),
    ).where("count > 0")


def history_summary(history: DataFrame) -> DataFrame:
    """A3: totals, and counts per mode and review status, from one grouping-sets aggregation.

    ``kind`` is total, mode or review_status.
    """
    h = history.select(
        F.coalesce("mode", F.lit("unknown")).alias("mode"), F.coalesce("review_status", F.lit("pending")).alias("review_status"),
        F.coalesce("cost_usd", F.lit(0).cast(USD)).alias("cost_usd"), F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"))
    g = h.groupingSets([[], ["mode"], ["review_status"]], "mode", "review_status").agg(
        F.grouping("mode").alias("gm"), F.grouping("review_status").alias("gs"), F.count("*").alias("count"),
        F.sum("cost_usd").alias("total"), F.count_if("cache_hit").alias("cache_hits"))
    total = (F.col("gm") == 1) & (F.col("gs") == 1)
    return g.where("count > 0").select(
        F.when(total, "total").when(F.col("gm") == 0, "mode").otherwise("review_status").alias("kind"),
        F.when(total, "").when(F.col("gm") == 0, F.col("mode")).otherwise(F.col("review_status")).alias("value"),
        "count", F.round("total", 6).alias("total_cost_usd"), F.round(F.col("total") / F.col("count"), 6).alias("avg_cost_usd"),
        "cache_hits", F.round(F.col("cache_hits") / F.col("count"), 3).alias("cache_hit_rate"))


def daily_costs(history: DataFrame) -> DataFrame:
    """A4: cost and count per day."""
    return history.where("timestamp IS NOT NULL").groupBy(F.to_date("timestamp").cast("string").alias("day")).agg(
        F.round(F.sum(F.coalesce("cost_usd", F.lit(0).cast(USD))), 4).alias("cost_usd"), F.count("*").alias("count"))


def roi_summary(history: DataFrame, minutes: int = 20, hourly_rate: int = 80) -> DataFrame:
    """A5: hours and money saved against the cost of the analyses."""
    a = history.agg(F.count("*").alias("count"), F.sum("cost_usd").alias("cost")).where("count > 0")
    hours = F.col("count") * minutes / F.lit(60.0)
    money = hours * hourly_rate
    cost = F.col("cost").cast("double")
    return a.select(
        "count", hours.alias("saved_hours"), money.alias("saved_money"), cost.alias("cost_usd"), (money - cost).alias("net_savings"),
        F.when(cost > 0, money / cost).otherwise(F.lit(float("inf"))).alias("multiple"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """Events per action, with the total and the distinct users of all events."""
    per_action = audit.groupBy(F.coalesce("action", F.lit("?")).alias("value")).agg(F.count("*").alias("count")).select(F.lit("action").alias("kind"), "value", "count")
    users = audit.where("user <> ''").groupBy(F.col("user").alias("value")).agg(F.count("*").alias("count")).select(F.lit("user").alias("kind"), "value", "count")
    total = audit.agg(F.count("*").alias("count")).select(F.lit("total").alias("kind"), F.lit("").alias("value"), "count")
    return per_action.unionByName(users).unionByName(total)


# ------------------------------------------------------------------ W2, A14, A19, A23
def newest(ledger: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """The newest ``limit`` rows (the limit is the report's own)."""
    return ledger.orderBy(*[F.desc(c) for c in order]).limit(limit)


def cost_sheet(records: DataFrame) -> DataFrame:
    """One cost row per record and a grand total (USD four decimals, ILS two)."""
    c = records.where("_cost_info IS NOT NULL").select("record_id", "source_filename", "part_number", "_cost_info.*")
    rows = c.select(F.lit("record").alias("kind"), "source_filename", "part_number", F.col("input_tokens"), F.col("output_tokens"),
                    F.col("total_cost_usd").cast("double").alias("cost_usd"), F.col("total_cost_ils").cast("double").alias("cost_ils"))
    total = c.agg(F.count("*").alias("n"), F.sum(F.coalesce("total_cost_usd", F.lit(0).cast(USD))).alias("s")).where("n > 0").select(
        F.lit("total").alias("kind"), F.lit("").alias("source_filename"), F.lit("").alias("part_number"),
        F.lit(None).cast("bigint").alias("input_tokens"), F.lit(None).cast("bigint").alias("output_tokens"),
        F.round("s", 4).cast("double").alias("cost_usd"), F.round(F.col("s") * F.lit(R.ILS_PER_USD).cast("decimal(4,2)"), 2).cast("double").alias("cost_ils"))
    return rows.unionByName(total)


def batch_outcome(drawings: DataFrame) -> DataFrame:
    """Per batch total / succeeded / failed, cost, findings, representative part number, cache hit.

    The representative is the first ASSEMBLY, else the first record, overview
    images first (W8). Failed records carry neither cost nor findings.
    """
    ok = ~F.col("failed")
    order = F.struct(F.when(F.col("assembly_role") == R.OVERVIEW_ROLE, 0).otherwise(1), "pos", "record_id")
    asm = F.upper("assembly_role") == "ASSEMBLY"
    g = drawings.groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if("failed").alias("failed"),
        F.sum(F.when(ok, F.col("cost_usd")).otherwise(F.lit(0).cast(USD))).alias("cost"),
        F.sum(F.when(ok, F.col("warning_count")).otherwise(0)).alias("warning_count"),
        F.min_by(F.when(ok & asm, F.col("part_number")), F.when(ok & asm, order)).alias("pn_asm"),
        F.min_by(F.when(ok, F.col("part_number")), F.when(ok, order)).alias("pn_first"))
    return g.select("batch_id", "total", "succeeded", "failed", F.col("cost").cast("double").alias("cost_usd"), "warning_count",
                    F.coalesce("pn_asm", "pn_first", F.lit("")).alias("part_number"), (F.col("cost") == 0).alias("cache_hit"))


def review_progress(drawings: DataFrame, show: int = 5) -> DataFrame:
    """Reviewed / total per batch and the first ``show`` pending identifiers.

    Ranking keeps only ``show`` rows per batch before they are put together.
    """
    pending = drawings.where("review_status IS NULL OR review_status <> 'reviewed'").select(
        "batch_id", "pos", "record_id",
        F.when(F.coalesce("part_number", F.lit("")) != "", F.col("part_number")).otherwise(F.coalesce("source_filename", F.lit("?"))).alias("pn"))
    first = pending.withColumn("rn", F.row_number().over(W.partitionBy("batch_id").orderBy("pos", "record_id"))).where(F.col("rn") <= show)
    names = first.groupBy("batch_id").agg(F.concat_ws(", ", F.transform(F.sort_array(F.collect_list(F.struct("rn", "pn"))), lambda x: x["pn"])).alias("pending"))
    counts = drawings.groupBy("batch_id").agg(F.count_if(F.col("review_status") == "reviewed").alias("reviewed"), F.count("*").alias("total"))
    return counts.join(names, "batch_id", "left").select("batch_id", "reviewed", "total", F.coalesce("pending", F.lit("")).alias("pending"))
