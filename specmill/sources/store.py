"""Cut lineage by writing a table to the shared checkpoint folder and reading it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, else one below the warehouse; never a machine's own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/specmill-tables"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/specmill/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write(df: DataFrame, path: str) -> None:
    """Writes a table; the shuffle files of this one job go as soon as it has ended, not when the driver next collects garbage.

    Nothing reads them again, and the steps of a long job would otherwise pile theirs up on the executors' disks.
    """
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The same rows read from Parquet: survives lost executors and is computed once however often it is used."""
    spark = df.sparkSession
    path = new_path(spark, name)
    write(df, path)
    return spark.read.schema(df.schema).parquet(path)
