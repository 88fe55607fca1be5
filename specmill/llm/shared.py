"""What several operators of this package use: word columns, row keys, shared tables, components, byte batches."""

from __future__ import annotations

import functools
import inspect
import string
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word: ASCII letters and digits, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once per row and hands it to ``body``; a plain reference inside a lambda is evaluated per element."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; null stays null."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """The words of a text in lower case; none for null."""
    return F.regexp_extract_all(F.coalesce(ascii_lower(text), F.lit("")), F.lit(WORD), F.lit(0))


def row_key(ident: str = "doc_id", text: str = "text") -> Column:
    """A key that tells apart rows of one id with different texts; equal rows share it, and they share every result."""
    return F.xxhash64(F.col(ident), F.col(text))


def apart(*named: str) -> Callable:
    """Runs an operator on input columns renamed to names of their own, so that none can clash with its inner columns.

    ``named`` are its parameters that hold column names. The input's columns come back under their names, before the results;
    a column named like a result is replaced.
    """
    def wrap(operator: Callable) -> Callable:
        @functools.wraps(operator)
        def run(df: DataFrame, *args, **kwargs) -> DataFrame:
            call = inspect.signature(operator).bind(df, *args, **kwargs)
            call.apply_defaults()
            inner = [f"in{i}_" for i in range(len(df.columns))]
            own = dict(zip((c.lower() for c in df.columns), inner))
            call.arguments.update({p: own[call.arguments[p].lower()] for p in named})
            call.arguments[next(iter(call.arguments))] = df.toDF(*inner)
            out, back = operator(*call.args, **call.kwargs), dict(zip(inner, df.columns))
            results = [c for c in out.columns if c not in back]
            taken = {c.lower() for c in results}
            return out.select(*[F.col(c).alias(back[c]) for c in inner if c in out.columns and back[c].lower() not in taken], *results)
        return run
    return wrap


def empty_array(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def shared_folder(spark: SparkSession) -> str:
    """A new folder on storage that driver and executors share: below spark.checkpoint.dir, else below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(hadoop)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return str(files.makeQualified(place).toString())


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a table once and reads it back, so that later jobs neither repeat the work nor depend on lost executors."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """Connected components of ``a``-``b`` edges (long ids): ``node``, ``component`` (smallest id), by star contraction.

    Each round hangs every node's larger neighbours, then its smaller ones, on its smallest neighbour. The rounds are
    logarithmic in the longest chain; a round only groups and joins on node ids, and its edges never grow in number.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    done, step = written(edges, folder, "edges0"), 0
    state = None
    while True:
        both = done.select(F.col("a").alias("u"), F.col("b").alias("v")).union(done.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        small = small.where("a <> b").distinct()
        step += 1
        done = written(small, folder, f"edges{step}")
        now = done.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(now) == state:
            return done.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = tuple(now)


# -- byte batches: vectorised work on the UTF-8 bytes of whole texts inside Arrow tasks ------------------------------

_TABLE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column one after the other, and n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def longs(column) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy())


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a column holds about ``limit`` bytes in each; a longer single text is a batch of its own."""
    for b in batches:
        sizes = np.nan_to_num(pa.compute.binary_length(b.column(column)).to_numpy(zero_copy_only=False).astype(float))
        part = np.cumsum(sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if e > s or not b.num_rows:
                yield b.slice(s, e - s)


_KEPT: dict[int, np.ndarray] = {}


def kept_powers(base: int, n: int) -> np.ndarray:
    """The first n powers; a worker keeps the first 2 million of each base (16 MB), whatever it works on later."""
    if n > 2 << 20:
        return powers(base, n)
    if base not in _KEPT or len(_KEPT[base]) < n:
        _KEPT[base] = powers(base, min(max(n, 1 << 16) * 2, 2 << 20))
    return _KEPT[base][:n]


class Spans:
    """Hashes of any byte spans of one buffer in constant time each, from prefix sums modulo 2**64."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[raw] * kept_powers(_BASE, len(raw)), out=self.sums[1:])
        self.back = kept_powers(_INVERSE, len(raw) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        body = (self.sums[end] - self.sums[start]) * self.back[start]
        return mixed(body + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
