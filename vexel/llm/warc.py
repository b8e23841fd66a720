"""Web archive records in ZIP packages, written and read back without extraction.

Each package holds two stored members: archive/data.warc.gz, whose records are compressed one by one, and
indexes/index.cdx, a line of offset, length and type per record. A reader parses the package's central (or ZIP64)
directory, locates both members, and reads each record as a range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm import zip_archive as za
from vexel.plans.storage import shared_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Compressed bytes of records after which a package is closed.
PACKAGE_BYTES = 32 << 20
#: Payloads of at least this many bytes are revisited.
LEAST_BYTES = 0
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed. A revisit keeps the response's HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def parse(data: bytes) -> dict[str, object]:
    """A record's fields; length and digest of a response are those of the payload that was read."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a record")
    h = _fields(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = h["warc-type"] == "revisit"
    return {
        "page_id": _page(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": h["warc-type"],
        "payload_bytes": int(_fields(http)["content-length"]) if revisit else len(payload),
        "payload_digest": h["warc-payload-digest"].removeprefix("sha1:") if revisit else payload_digest(payload),
        "refers_to": _page(h.get("warc-refers-to")), "payload": None if revisit else payload,
    }


def with_types(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """(id, url, html, digest, first): first is the smallest key of the records with an equal payload that is shared.

    Only the digests of shared payloads are joined back; Spark broadcasts them where they are small, and else splits
    a digest that many pages share.
    """
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long_enough = rows.where(F.octet_length("html") >= least)
    shared = long_enough.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return rows.join(shared, "digest", "left").select("id", "url", "html", "digest", "first")


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", zip64: bool = False, package_bytes: int = PACKAGE_BYTES, least: int = LEAST_BYTES) -> DataFrame:
    """Write packages under path (a folder that all executors share) and return (package, records, bytes).

    A package appears by one rename under a name that its partition decides, so a task that runs again replaces what
    it wrote with the same bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = opened(path)
        store.create_dir(root, recursive=True)
        data: list[bytes] = []
        index: list[str] = []
        size, packages = 0, 0

        def close() -> pa.RecordBatch:
            nonlocal size, packages
            name = f"part-{context.partitionId():06d}-{packages:05d}.zip"
            hidden = f"{root}/_{name}.{context.taskAttemptId()}"
            with store.open_output_stream(hidden) as out:
                for piece in za.build([(DATA, b"".join(data)), (INDEX, "".join(index).encode())], zip64):
                    out.write(piece)
            store.move(hidden, f"{root}/{name}")
            done = pa.RecordBatch.from_pydict({"package": [name], "records": [len(index)], "bytes": [size]})
            data.clear()
            index.clear()
            size, packages = 0, packages + 1
            return done

        for b in batches:
            for k, u, h, d, first in zip(*(b.column(i) for i in range(5)), strict=True):
                k, first, payload = k.as_py(), first.as_py(), h.as_py().encode("utf-8")
                revisit = first is not None and k != first
                squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                digest = base64.b32encode(bytes.fromhex(d.as_py())).decode()
                packed = squeeze.compress(record(k, u.as_py(), payload, digest, first, revisit)) + squeeze.flush()
                index.append(f"{size} {len(packed)} {'revisit' if revisit else 'response'}\n")
                data.append(packed)
                size += len(packed)
                if size >= package_bytes:
                    yield close()
        if index:
            yield close()

    return with_types(pages, key, url, html, least).mapInArrow(run, "package string, records long, bytes long")


def entries(f, size: int) -> tuple[int, list[tuple[int, int]]]:
    """Where a package's record member begins, and (offset, length) of each record by its index member."""
    found = za.directory(f, size)
    index = found[INDEX]
    lines = za.read_range(f, za.data_start(f, index), 0, index.size).decode().splitlines()
    return za.data_start(f, found[DATA]), [(int(a), int(b)) for a, b, *_ in (x.split(" ") for x in lines)]


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the packages under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.zip").load(path).select("path", "length")
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split(" ")[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict[str, object]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

        for b in batches:
            for uri, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, at = opened(uri)
                with store.open_input_file(at) as f:
                    start, index = entries(f, size)
                    rows, held = [], 0
                    for offset, n in index:
                        r = parse(zlib.decompress(za.read_range(f, start, offset, n), 31))
                        rows.append(r)
                        held += len(r["payload"] or b"")
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield out(rows)
                            rows, held = [], 0
                    if rows:
                        yield out(rows)

    return files.mapInArrow(run, schema)


def round_trip(pages: DataFrame, path: str | None = None, zip64: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, read from the packages that
    were written for pages.

    Null html is an empty payload, null keys and addresses are left out of a record. Of records with equal payloads,
    that with the smallest key is the response (each of its rows, if it repeats; all of them, if no key is known); the
    others revisit it. Empty table: no packages, no rows. Columns other than page_id, url and html are not read.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    store, root = opened(path)
    store.create_dir(root, recursive=True)
    write(pages, path, zip64=zip64).write.format("noop").mode("overwrite").save()
    return read(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
