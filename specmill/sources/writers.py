"""Sinks: results, ledgers, the export table set and the flagged-standards file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def with_saved_at(df: DataFrame) -> DataFrame:
    return df.withColumn("_saved_at", F.current_timestamp())


def _save(df: DataFrame, path: str, fmt: str, save_id: str | None, partition_by: list[str] | None = None, **options) -> None:
    """Appends, or, with a ``save_id``, commits under that name: the same save run again replaces itself and adds nothing."""
    if save_id is None:
        w, parts = df.write.mode("append"), list(partition_by or [])
    else:
        w = df.withColumn("save_id", F.lit(save_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        parts = ["save_id", *(partition_by or [])]
    (w.partitionBy(*parts) if parts else w).format(fmt).options(**options).save(path)


def write_records(records: DataFrame, path: str, fmt: str = "json", relationships: DataFrame | None = None, partition_by: list[str] | None = None,
                  save_id: str | None = None) -> None:
    """Results with their time of saving. The combined payload of a batch is two folders, ``drawings`` and
    ``relationships``, both keyed by ``batch_id``: no batch is gathered into one object.

    A ``save_id`` names the commit, so that a job that is run again after a failure leaves every record once.
    """
    if relationships is None:
        _save(with_saved_at(records), path, fmt, save_id, partition_by)
    else:
        _save(with_saved_at(records), f"{path}/drawings", fmt, save_id, partition_by)
        _save(with_saved_at(relationships), f"{path}/relationships", fmt, save_id, partition_by)


def history_rows(df: DataFrame) -> DataFrame:
    """History rows with every field present and defaults filled."""
    d = {"filename": "", "part_number": "", "json_path": "", "review_status": "pending"}
    return df.withColumns({
        **{c: F.coalesce(F.col(c), F.lit(v)) for c, v in d.items()},
        "drawing_count": F.coalesce("drawing_count", F.lit(1)), "warning_count": F.coalesce("warning_count", F.lit(0)),
        "cost_usd": F.round(F.coalesce("cost_usd", F.lit(0)), 6).cast("decimal(18,6)"), "cache_hit": F.coalesce("cache_hit", F.lit(False)),
    })


def audit_rows(df: DataFrame, default_user: str = "system") -> DataFrame:
    """Audit rows: optional fields are null, and so not written, when empty or zero."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return df.withColumns({
        "user": F.coalesce(blank("user"), F.lit(default_user)), "subject": F.coalesce("subject", F.lit("")),
        "details": blank("details"), "model": blank("model"), "cost_usd": F.when(F.col("cost_usd") != 0, F.round("cost_usd", 6).cast("decimal(18,6)")),
    })


def append_ledger(df: DataFrame, path: str, save_id: str | None = None) -> None:
    """Append JSON lines; null fields are left out. With a ``save_id``, appending the same rows again adds nothing."""
    _save(df, path, "json", save_id, ignoreNullFields=True)


def ledger_lines(df: DataFrame) -> DataFrame:
    """The lines ``append_ledger`` writes, as a column."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_table_set(tables: dict[str, DataFrame], folder: str, single: bool = False) -> None:
    """Every table of the export in its own folder; a single record has no tree tables."""
    for name, df in tables.items():
        if not (single and name in ("tree", "image_tree")):
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def commit_table_set(tables: dict[str, DataFrame], folder: str, save_id: str, single: bool = False) -> None:
    """S8 under one commit: the tables below ``folder/save_id``, and, once all are there, their list with row counts.

    The counts are observed while the tables are written, so no table is read twice. The list is written last: a job that
    fails leaves none, its tables are not read by ``read_table_set``, and the same save run again replaces them.
    """
    spark = next(iter(tables.values())).sparkSession
    listed = []
    for name, df in tables.items():
        if single and name in ("tree", "image_tree"):
            continue
        seen = Observation(f"rows of {name}")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/{save_id}/{name}")
        listed.append((save_id, name, int(seen.get.get("n", 0))))
    done = spark.createDataFrame(listed, "save_id string, table_name string, n_rows long").coalesce(1)
    _save(done.drop("save_id"), f"{folder}/_commits", "parquet", save_id)


def committed_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(save_id, table_name, n_rows) of every committed table."""
    return spark.read.schema("table_name string, n_rows long, save_id string").parquet(f"{folder}/_commits")


def read_table_set(spark: SparkSession, folder: str, save_id: str) -> dict[str, DataFrame]:
    """The tables of a commit by name; a save that was not committed raises ``ValueError``."""
    names = [r.table_name for r in committed_tables(spark, folder).where(F.col("save_id") == save_id).collect()]
    if not names:
        raise ValueError(f"no commit {save_id!r} in {folder}")
    return {n: spark.read.parquet(f"{folder}/{save_id}/{n}") for n in names}


def flagged_rows(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(file, flagged_standard) with commas replaced."""
    return findings.join(files.select("record_id", F.col("source_filename").alias("file")), "record_id").select(
        "file", F.regexp_replace("value", ",", ";").alias("flagged_standard"))


def export_flagged_csv(findings: DataFrame, files: DataFrame, path: str) -> None:
    flagged_rows(findings, files).write.mode("overwrite").option("header", True).csv(path)
