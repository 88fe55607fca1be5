"""A cleaning pipeline over ``documents``: toxicity, near duplicates, benchmark passages, secrets, packing.

Each stage works on all rows that its predecessor kept; every stage is written as Parquet and read again, so a lost executor
repeats one stage at most. Rows without doc_id or without words can be no one's copy and stay; rows of one doc_id with different texts are different
documents; all else is as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from specmill.llm import decontaminate, jaccard_join, packing, secret_scan, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the kernel machine calls toxic go; it learns from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(~toxicity.held_out())), out="_toxicity")
    return scored.where("_toxicity < 0.5").drop("_toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id stays; rows without doc_id or without words all stay.

    Rows are told apart by a number of their own, not by doc_id: rows of one id with different texts are different documents.
    """
    rows = shared.written(docs.withColumn("_row", F.monotonically_increasing_id()), shared.shared_folder(spark), "numbered")
    named = rows.where("doc_id is not null").select("_row", "doc_id", "text")
    groups = jaccard_join.components(named, "_row").where("n_shingles > 0").select(F.col("id").alias("_row"), "component_id")
    groups = shared.written(groups.join(named.select("_row", "doc_id"), "_row"), shared.shared_folder(spark), "groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("first"))
    copies = groups.join(first, "component_id").where("_row <> first._row").select("_row")
    return rows.join(copies, "_row", "left_anti").select(docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    marked = decontaminate.annotate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out="_decon")
    return marked.where(~decontaminate.contaminated("_decon")).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and access identifiers are replaced by their kind; every document stays."""
    found = secret_scan.annotate(docs, out="_secrets")
    found = found.withColumn("_clean", secret_scan.redacted(F.col("text"), F.col("_secrets")))
    size = F.when(F.size("_secrets") > 0, F.char_length("_clean").cast("long"))
    own = {"text": F.col("_clean").alias("text")} | ({"n_chars": F.coalesce(size, "n_chars").alias("n_chars")} if "n_chars" in docs.columns else {})
    return found.select(*[own.get(c, F.col(c)) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_benchmark_passages),
    ("secret_scan", redact_secrets),
    ("pack", pack),
]

#: Learning, components and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared.shared_folder(spark)
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), folder, name)
    return docs
