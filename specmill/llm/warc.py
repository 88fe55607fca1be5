"""WARC archives: monolithic gzip writer, normaliser, indexed reader.

``write_monolithic`` writes one record per page through Spark's text writer, so every file is one gzip stream, as many
crawlers leave them. ``normalise`` streams each file once: it inflates chunk by chunk, cuts records by their Content-Length,
writes every record as a gzip member of its own, and returns the sidecar index (file, offset, length, id), stored as a
table. ``read_indexed`` opens archives at the indexed offsets. Memory is bounded by the largest record, not by a file.

Files are written under a name of the attempt and renamed when complete; a repeated task replaces equal content, so lost
executors cost time only. Storage is reached through Arrow's file systems by URI, for our own output folder only.

Defined results: a null payload is empty; of equal payloads of at least ``LEAST`` bytes that with the smallest page_id is the
response and others revisit it (repeated rows of it stay responses); a null page_id never answers for others and, where all
ids of a payload are null, every record is a response; an empty table gives an empty result; other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from specmill.llm import shared

#: Payloads of fewer bytes are always responses.
LEAST = 0
CHUNK = 1 << 20
_END = b"\r\n\r\n"
_INDEX = "archive string, position long, size long, record_id string"
_RECORD = "record_id string, page_id long, target string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: 160 bits are 32 digits of 5 bits, no padding."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = F.concat(*[F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 2), 20, "0") for i in range(8)])
    digit = lambda i: F.substring(F.lit(alphabet), F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1))
    return F.concat(*[digit(i) for i in range(32)])


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """Column ``value``: the WARC record of every page, without the blank lines that end it.

    Equal payloads meet by their digest; the smallest id per digest is aggregated before it shuffles, and joined back by an
    equi-join whose hot digests Spark can split.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("d"), F.octet_length(payload).alias("n"))
    first = rows.groupBy("d").agg(F.min("id").alias("first"))
    rows = rows.join(first, "d", "left")
    revisit = (F.col("n") >= least) & F.coalesce(F.col("first") != F.col("id"), F.col("first").isNotNull())
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    target = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "")
    rows = rows.withColumn("digest", _base32(F.col("d")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Target-URI", target), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), line("X-Payload-Length", F.col("n").cast("string")),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))).otherwise(""),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("n").cast("string"))), F.lit("\r\n\r\n"))
    return rows.select(F.concat(head, F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))


def write_monolithic(pages: DataFrame, folder: str, **names) -> None:
    """Archives below ``folder``, each one gzip stream for the whole file."""
    records(pages, **names).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(folder)


def _opened(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def _split(stream) -> Iterator[tuple[str, bytes]]:
    """(id, raw record with its end) of a monolithic gzip stream, inflated once."""
    inflate, have, open_ = zlib.decompressobj(31), bytearray(), True
    while open_ or have:
        chunk = stream.read(CHUNK) if open_ else b""
        open_ = bool(chunk)
        while chunk:  # several members in a row are as good as one
            have += inflate.decompress(chunk)
            chunk = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
        at = 0
        while (head := have.find(_END, at)) >= 0:
            fields = _fields(bytes(have[at:head]))
            end = head + 4 + int(fields["content-length"]) + 4
            if end > len(have):
                break
            yield fields["warc-record-id"], bytes(have[at:end])
            at = end
        del have[:at]
        if not open_ and have:
            raise ValueError("an archive ends within a record")


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in head.decode().split("\r\n")[1:])}


def normalise(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Rewrites every archive of ``folder`` below ``target``, a member per record; returns the written sidecar index."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path")
    names = names.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "path")

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["path"]:
                system, place = _opened(uri)
                sink, base = _opened(target)
                system.create_dir(base, recursive=True)
                name = posixpath.basename(place).split(".")[0] + ".warc.gz"
                trial = f"{base}/.{name}.{uuid.uuid4().hex}"
                index, at = [], 0
                with system.open_input_stream(place, compression=None) as stream, sink.open_output_stream(trial, compression=None) as out:
                    for ident, record in _split(stream):
                        deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                        member = deflate.compress(record) + deflate.flush()
                        out.write(member)
                        index.append((name, at, len(member), ident))
                        at += len(member)
                        if len(index) >= 10_000:
                            yield pd.DataFrame(index, columns=["archive", "position", "size", "record_id"])
                            index = []
                sink.move(trial, f"{base}/{name}")
                yield pd.DataFrame(index, columns=["archive", "position", "size", "record_id"])

    return shared.written(names.mapInPandas(rewrite, _INDEX), posixpath.dirname(target), posixpath.basename(target) + "-index")


def read_indexed(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records at the indexed places; any subset of the index may be asked for. Digests of responses are verified."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _opened(folder)
        for batch in batches:
            for archive, places in batch.sort_values(["archive", "position"]).groupby("archive", sort=False):
                rows, held = [], 0
                with system.open_input_file(f"{base}/{archive}") as source:
                    for at, n in zip(places["position"], places["size"], strict=True):
                        source.seek(int(at))
                        rows.append(_record(zlib.decompress(source.read(int(n)), 31), with_payload))
                        held += len(rows[-1][-1] or b"")
                        if held > 32 * CHUNK:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    columns = [c.split()[0] for c in _RECORD.split(", ")]
    return index.mapInPandas(read, _RECORD)


def _record(raw: bytes, with_payload: bool) -> tuple:
    head, _, rest = raw.partition(_END)
    f = _fields(head)
    payload = rest[:int(f["content-length"])]
    digest = f["warc-payload-digest"].removeprefix("sha1:")
    if f["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"the payload of {f['warc-record-id']} differs from its digest")
    ident = lambda x: None if x is None or x == "<urn:page:none>" else int(x[10:-1])
    size = len(payload) if f["warc-type"] == "response" else int(f["x-payload-length"])
    return (f["warc-record-id"], ident(f["warc-record-id"]), f["warc-target-uri"], f["warc-type"], ident(f.get("warc-refers-to")), size, digest, payload if with_payload else None)


def query(spark, sf_dir: str) -> DataFrame:
    folder = shared.shared_folder(spark)
    write_monolithic(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{folder}/monolithic")
    index = normalise(spark, f"{folder}/monolithic", f"{folder}/archive")
    rows = read_indexed(index, f"{folder}/archive", with_payload=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
