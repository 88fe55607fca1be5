"""File-stream variants of three jobs. Every run is restartable from its checkpoint folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from specmill.sources import store


def new_records(
    source: DataFrame, stored: str, checkpoint: str, keys: list[str],
    process: Callable[[DataFrame], DataFrame] = lambda df: df, order: Column | None = None, buckets: int = 256,
) -> StreamingQuery:
    """Process only records whose key is not stored yet, and append the results to the Parquet table ``stored``.

    Of records of one key in a micro-batch the first by ``order`` counts; null is a key like any other. The keys that were
    processed lie in ``stored_keys``, by hash bucket: a micro-batch reads the buckets it touches, keys only,
    never what the jobs made of them. Each micro-batch writes folders of its own and replaces them when replayed after a
    failure, and a replay does not see its own keys. ``process`` may change any column, the keys too.
    """
    def handle(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        row = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_none"))
        pick = F.first(row) if order is None else F.min_by(row, order)
        first = batch.groupBy(*keys).agg(pick.alias("_row")).withColumn("bucket", key_bucket(keys, buckets))
        fresh = first.persist()
        try:
            known = seen_keys(batch.sparkSession, stored, epoch, [r[0] for r in first.select("bucket").distinct().collect()])
            if known is not None:
                fresh = first.join(known.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]),
                                   reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]), "left_anti")
            fresh.select("bucket", *keys).write.mode("overwrite").partitionBy("bucket").parquet(f"{stored}_keys/epoch={epoch}")
            process(fresh.select(*keys, *[f"_row.{c}" for c in rest]).select(batch.columns)).write.mode("overwrite").parquet(f"{stored}/epoch={epoch}")
        finally:
            first.unpersist()

    return (
        source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def key_bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def seen_keys(spark: SparkSession, stored: str, epoch: int, touched: list[int]) -> DataFrame | None:
    """Keys of other micro-batches in the buckets ``touched`` (as many as there are buckets at most); none before the first."""
    path = f"{stored}_keys"
    if not store.exists(spark, path):
        return None
    return spark.read.parquet(path).where((F.col("epoch") != epoch) & F.col("bucket").isin(touched)).drop("bucket", "epoch")


def daily_costs(history: DataFrame, delay: str = "1 day") -> DataFrame:
    """Cost and count per day and mode over event time; a day is final once the watermark passed it."""
    return (
        history.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", "1 day").alias("w"), F.coalesce("mode", F.lit("unknown")).alias("mode"))
        .agg(F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("count"))
        .select(F.to_date("w.start").alias("day"), "mode", "cost_usd", "count")
    )


def running_daily_costs(history: DataFrame, delay: str = "1 day") -> DataFrame:
    """X2 with its open days: cost and count per day and mode so far, for update mode; ``last`` is the newest event.

    Rows older than the watermark are late and do not count, as in ``daily_costs``; all others do, at once.
    """
    return (
        history.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", "1 day").alias("w"), F.coalesce("mode", F.lit("unknown")).alias("mode"))
        .agg(F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("count"), F.max("timestamp").alias("last"))
        .select(F.to_date("w.start").alias("day"), "mode", "cost_usd", "count", "last")
    )


def latest_daily_costs(spark: SparkSession, path: str, delay: str = "1 day") -> DataFrame:
    """The newest row per day and mode, and whether it is final: the day ended before the newest event minus ``delay``."""
    rows = latest(spark, path, ["day", "mode"])
    newest = rows.agg((F.max("last") - F.expr(f"INTERVAL {delay}")).alias("_mark"))
    ends = F.date_add("day", 1).cast("timestamp")
    return rows.join(F.broadcast(newest)).select("day", "mode", "cost_usd", "count", (ends <= F.col("_mark")).alias("final"))  # one row


def append_to_table(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def batch_outcome(drawings: DataFrame) -> DataFrame:
    """Running totals per batch."""
    return drawings.groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if(~F.col("failed")).alias("succeeded"), F.count_if("failed").alias("failed"),
        F.sum(F.when(F.col("failed"), F.lit(0)).otherwise(F.col("cost_usd"))).cast("decimal(28,6)").alias("cost_usd"))


def upsert_to_table(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Changed groups of every micro-batch, one folder per epoch; ``latest`` reads the newest row of each key."""
    def handle(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        result.writeStream.foreachBatch(handle).outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in (*keys, "epoch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(*keys, "r.*")
