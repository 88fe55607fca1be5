"""Sources: record files, ledgers, dimension file, catalog, binary manifest."""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specmill import schemas
from specmill.functions import md5
from specmill.operators import dimensions
from specmill.sources import store

SETTINGS_FILE = "_runtime_settings.json"
MAX_BYTES = 50 * 1024 * 1024
IMAGE_SUFFIXES = ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"]


def _readable(corrupt: str, other: str) -> Column:
    """True for rows that parsed. ``other`` is read as well: the JSON source refuses plans that read only the corrupt column."""
    return F.col(corrupt).isNull() & (F.length(F.coalesce(F.col(other).cast("string"), F.lit(""))) >= 0)


def _place() -> Column:
    """Place of a row in its file. Spark may read the blocks of a file in any order, so the number alone, which rises
    only within a block, does not tell."""
    return F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_saved(spark: SparkSession, path: str, ddl: str, fmt: str = "json") -> DataFrame:
    """S6 read back: the rows of every save below ``path`` as they were written."""
    return spark.read.schema(ddl).format(fmt).load(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Result JSON files of a folder, one object per file; unreadable and non-object files are skipped.

    ``final_approval`` and ``packaging_notes`` may be plain strings and
    ``item_no`` / ``qty`` numbers: such fields arrive as text and are coerced.
    """
    loose = ", ".join(
        f"`{n}` {'string' if n in ('final_approval', 'packaging_notes') else t}" for n, t in schemas.RECORD_TYPES.items()
    ) + ", _corrupt_record string"
    df = (
        spark.read.schema(loose).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
        .select("*", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("_file"))
    )
    df = df.where((F.col("_file") != SETTINGS_FILE) & _readable("_corrupt_record", "part_number"))
    approval = F.when(F.col("final_approval").startswith("["), F.from_json("final_approval", f"array<{schemas.STEP}>")).when(
        F.col("final_approval").startswith("{"), F.array(F.from_json("final_approval", schemas.STEP)))
    packing = F.when(
        F.col("packaging_notes").startswith("{"), F.from_json("packaging_notes", schemas.RECORD_TYPES["packaging_notes"])
    ).when(F.col("packaging_notes") != "", F.struct(F.lit("").alias("step_no"), F.col("packaging_notes").alias("en"), F.lit("").alias("he")))
    return df.withColumns({"final_approval": approval, "packaging_notes": packing}).drop("_corrupt_record", "_file")


def parse_ledger(lines: DataFrame, ddl: str, value: str = "value") -> DataFrame:
    """Ledger rows of a table of JSON lines; lines that do not parse or are no objects are dropped."""
    parsed = F.from_json(value, ddl + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    df = lines.where(F.trim(F.col(value)) != "").withColumn("_r", parsed)
    ok = F.col("_r").isNotNull() & F.col("_r._bad").isNull() & F.trim(F.col(value)).startswith("{")
    rest = [c for c in lines.columns if c != value]
    return df.where(ok).select(*rest, "_r.*").drop("_bad")


def read_ledger(spark: SparkSession, path: str, ddl: str, limit: int | None = None, order: str = "timestamp", **equals: str) -> DataFrame:
    """Ledger rows, newest first, filtered before the limit. Bad lines are skipped."""
    df = (
        spark.read.schema(ddl + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
        .select("*", F.col("_metadata.file_path").alias("_file"), _place().alias("_line"))
    )
    df = df.where(_readable("_bad", df.columns[0])).drop("_bad"
    )
    for column, value in equals.items():
        df = df.where(F.col(column) == value)
    df = df.orderBy(F.desc(order), F.desc("_file"), F.desc("_line"))
    return (df.limit(limit) if limit is not None else df).drop("_file", "_line")


def read_dimensions(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """S3: the five lookup tables of one JSON object; any violation aborts."""
    raw = spark.read.schema(schemas.DIMENSION_DDL).option("multiLine", True).option("mode", "FAILFAST").json(path)
    keys = ["cage_to_customer", "customer_to_default_cage", "customer_aliases", "pn_prefix_to_customer", "customer_internal_spec_patterns"]
    missing = raw.select(*[F.coalesce(F.bool_or(F.col(k).isNull()), F.lit(True)).alias(k) for k in keys]).first()
    if any(missing[k] for k in keys):
        raise KeyError("missing in the dimension file: " + ", ".join(k for k in keys if missing[k]))

    def table(source: str, key: str, value: str, ordinal: bool = False) -> DataFrame:
        df = raw.select(F.posexplode(F.map_entries(source)).alias("ordinal", "e"))
        return df.select(*(["ordinal"] if ordinal else []), F.col("e.key").alias(key), F.col("e.value").alias(value))

    dims = {
        "cage": table(keys[0], "cage", "customer"),
        "default_cage": table(keys[1], "customer", "cage"),
        "alias": table(keys[2], "alias", "customer", True),
        "pn_prefix": table(keys[3], "prefix", "customer", True),
        "internal_spec": table(keys[4], "customer", "patterns").select("customer", F.explode("patterns").alias("pattern")),
    }
    dimensions.require_valid(dims)
    return dims


CATALOG_COLUMNS = ["master_id", "desc", "standard", "thickness", "color", "col5", "rohs", "full_name"]


def read_catalog(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The eight catalog columns as strings, missing values empty, with their file order."""
    if fmt == "csv":
        df = spark.read.schema(", ".join(f"`{c}` string" for c in CATALOG_COLUMNS)).option("header", True).csv(path)
    else:
        df = spark.read.format(fmt).load(path).toDF(*CATALOG_COLUMNS)
    text = [F.when(F.col(c).cast("string").isin("nan", "None"), "").otherwise(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in CATALOG_COLUMNS]
    return df.select(F.struct(F.col("_metadata.file_path").alias("file"), _place().alias("place")).alias("ordinal"), *text)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\?#]+)$", 1))


def _verdicts(df: DataFrame, max_bytes: int) -> DataFrame:
    pdf = F.col("suffix") == "pdf"
    return df.withColumns({
        "route": F.when(pdf, "pdf").when(F.col("suffix").isin(IMAGE_SUFFIXES), "image").otherwise("other"),
        "rejected": F.when(F.col("length") > max_bytes, "too_large")
        .when(pdf & (F.col("magic") != F.lit(b"%PDF-")), "bad_magic").otherwise(""),
    })


def _named(fingerprint: Column, magic: Column) -> list[Column | str]:
    return ["path", F.regexp_extract("path", r"([^/\\]*)$", 1).alias("source_filename"), F.col("length").cast("bigint").alias("length"),
            fingerprint.alias("fingerprint"), magic.alias("magic"), suffix(F.col("path")).alias("suffix")]


def manifest_columns(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Fingerprint, size, magic and route of (path, length, content) rows.

    Every file has a fingerprint, since later joins need it; the size limit only decides ``rejected``.
    """
    return _verdicts(files.select(*_named(F.md5("content"), F.substring("content", 1, 5))), max_bytes)


WHOLE_BYTES = 256 * 1024 * 1024  # the most of one file that one task takes
_PIECE = 1024 * 1024
_LINE = 64 * 1024 * 1024  # longer lines are cut before they leave the JVM; each cut copies its line once
_BOM = b"\xef\xbb\xbf"
# files that the line reader would unpack: their fingerprint is that of the packed bytes
_PACKED = r"(?i)\.(gz|deflate|bz2|snappy|lz4|zstd?|passthrough)$"
_HASHED = "file string, length long, block long, row long, content binary, magic binary"


def _runs(batch):
    """The contents of each block in a batch. The lines of a block stand together, so equal ends make one run."""
    places = batch.select(["file", "length", "block"])
    ends = places.take([0, batch.num_rows - 1]).to_pylist()
    if ends[0] == ends[1]:
        yield ends[0], batch.column("content")
        return
    at = 0
    for place, run in groupby(places.to_pylist()):
        n = sum(1 for _ in run)
        yield place, batch.column("content").slice(at, n)
        at += n


def _glue(batches):
    """Lines of a block, which come in order, as pieces of ``_PIECE`` bytes; the last piece may be shorter."""
    here, row, held = None, 0, b""

    def piece(content):
        return pa.RecordBatch.from_pylist([here | {"row": row, "content": content}])

    for batch in batches:
        for place, lines in _runs(batch) if batch.num_rows else ():
            if place != here:
                if held:
                    yield piece(held)
                here, row, held = place, 0, b""
            held = b"".join([held, *lines.to_pylist()])
            whole = len(held) // _PIECE * _PIECE
            for i in range(0, whole, _PIECE):
                yield piece(held[i:i + _PIECE])
                row += 1
            held = held[whole:]
    if held:
        yield piece(held)


def _advance(batches):
    """The state of every file after its pieces: its last state comes first, the pieces follow in order."""
    now = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] < 0:
                if now:
                    yield pa.RecordBatch.from_pylist([now])
                now = row
                continue
            data = row["content"][:now["length"] - md5.n_bytes(now["content"])]
            now |= {"content": md5.update(now["content"], data), "magic": (now["magic"] + data[:5])[:5]}
    if now:
        yield pa.RecordBatch.from_pylist([now])


def _long_fingerprints(spark: SparkSession, path: str, long: Column, step: int, rounds: int) -> DataFrame:
    """MD5 and magic of files too long for one task, as (file, fingerprint, magic).

    The line reader splits a file and leaves its bytes as they are. They are written once, by rounds of ``step`` bytes.
    An MD5 needs the bytes in order, so each round takes up the states of the one before; a task reads one round of one file.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path).where(long)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length"),
                         F.col("_metadata.file_block_start").alias("block"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"))
    last = F.floor((F.length("line") - 1) / _LINE).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("line", i * _LINE + 1, F.lit(_LINE)))
    lines = lines.select("file", "length", "block", F.explode_outer(F.when(last == 0, F.array("line")).otherwise(cut)).alias("content"))
    pieces = lines.mapInArrow(_glue, "file string, length long, block long, row long, content binary")
    out = store.new_path(spark, "s5-pieces")
    (pieces.withColumns({"n": F.length("content"), "round": F.floor(F.col("block") / step).cast("int")})
     .write.partitionBy("round").parquet(out))
    pieces = spark.read.schema(_HASHED + ", n int, round int").parquet(out)
    # the reader drops a byte order mark, and every line has been given an end
    over = F.sum("n") - F.col("length")
    start = (F.when(over.isin(0, 1), F.lit(md5.START)).when(over.isin(-3, -2), F.lit(md5.update(md5.START, _BOM)))
             .otherwise(F.raise_error(F.concat(F.lit("not read byte by byte: "), F.col("file"))).cast("binary")))
    state = pieces.groupBy("file", "length").agg(start.alias("content"), F.when(over < 0, F.lit(_BOM)).otherwise(F.lit(b"")).alias("magic"))
    state = state.selectExpr("file", "length", "-1L AS block", "0L AS row", "content", "magic")
    for k in range(rounds):
        rows = state.unionByName(pieces.where(F.col("round") == k).drop("n", "round"))
        rows = rows.repartition("file").sortWithinPartitions("file", "block", "row")
        state = store.materialise(rows.mapInArrow(_advance, _HASHED), f"s5-states-{k}")
    digest = F.udf(lambda s, n: md5.hexdigest(s) if md5.n_bytes(s) == n else None, "string")("content", "length")
    missing = F.raise_error(F.concat(F.lit("bytes missing: "), F.col("file"))).cast("string")
    return state.select("file", F.coalesce(digest, missing).alias("fingerprint"), "magic")


def file_manifest(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """S5 over a folder of files. Files of more than ``whole_bytes`` are hashed piece by piece."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    long = (F.col("_metadata.file_size") > whole_bytes) & ~F.col("_metadata.file_path").rlike(_PACKED)
    short = manifest_columns(files.where(~long).select("path", "length", "content"), max_bytes)
    named = files.where(long).select("path", "length", F.col("_metadata.file_path").alias("file"))
    longest = named.agg(F.max("length")).first()[0]
    if longest is None:
        return short
    hashed = _long_fingerprints(spark, path, long, whole_bytes, -(-longest // whole_bytes))
    return short.unionByName(_verdicts(named.join(hashed, "file").select(*_named(F.col("fingerprint"), F.col("magic"))), max_bytes))
