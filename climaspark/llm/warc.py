"""WARC: a gzip member for each record, written and read in sequence, with length framing and verified digests."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, written

CHUNK = 1 << 20
DATE = "2020-01-01T00:00:00Z"
CHUNKS = "archive long, chunk long, data binary"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, record_id string, refers_to_id string, payload binary"
#: An archive is closed at about so many bytes, and the next begins; an inflating step gives at most so many bytes from at most so many.
ROLL, INFLATED, FED = 64 << 20, 1 << 20, 1 << 14


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header of its response, length included, and no body."""
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join([*head, "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


class BrokenArchive(ValueError):
    """Framing or a digest doesn't hold."""


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Each gzip member's content, decompressed as the chunks arrive, in small steps; chunks may end anywhere."""
    unpacker, parts, fresh = zlib.decompressobj(31), [], True
    for chunk in chunks:
        view = memoryview(chunk)
        for begin in range(0, len(view), FED):
            data: bytes = view[begin : begin + FED]
            while data:
                parts.append(unpacker.decompress(data, INFLATED))
                fresh, data = False, unpacker.unconsumed_tail
                if unpacker.eof:
                    yield b"".join(parts)
                    data, unpacker, parts, fresh = unpacker.unused_data, zlib.decompressobj(31), [], True
    if not fresh:
        raise BrokenArchive("the archive ends within a record")


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogateescape").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def page_of(urn: str | None) -> int | None:
    """The page of a record id as member() writes them; null for others."""
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def holds(told: str, data: bytes) -> bool:
    """Whether data has the digest that is told as algorithm:value, in base32 or hexadecimal; true for algorithms that are not known here."""
    name, _, value = told.partition(":")
    if name.lower() not in ("sha1", "sha256", "sha512", "md5"):
        return True
    found = hashlib.new(name.lower(), data, usedforsecurity=False).digest()
    return value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=") or value.lower() == found.hex()


def record(content: bytes) -> tuple:
    """RECORDS of one record of any writer; lengths, and the digests that are there, are checked.

    The payload is an HTTP message's body as it was sent, or the whole block of other records; a revisit has none, but the length
    that its HTTP header tells, if any. A payload's digest is its writer's, or computed if there is none; one of a body that was
    sent in an encoding is not checked, as writers differ in what they digest.
    """
    head, _, rest = content.lstrip(b"\r\n").partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise BrokenArchive("no WARC record begins here")
    f = fields(head)
    name, size = f.get("warc-record-id"), f.get("content-length", "")
    if not size.isdigit():
        raise BrokenArchive(f"{name} has no content length")
    block = rest[: int(size)]
    if len(block) != int(size) or rest[int(size) :] != b"\r\n\r\n":
        raise BrokenArchive(f"the content length of {name} doesn't hold")
    if not holds(f.get("warc-block-digest", ""), block):
        raise BrokenArchive(f"the block digest of {name} doesn't hold")
    kind, payload, told, as_sent = f.get("warc-type"), block, None, False
    if f.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        sent = fields(http)
        told, as_sent = sent.get("content-length"), bool(sent.keys() & {"transfer-encoding", "content-encoding"})
    told = int(told) if told and told.isdigit() else None
    digest = f.get("warc-payload-digest")
    if kind == "revisit":
        payload = None
    elif digest and not as_sent and not holds(digest, payload):
        raise BrokenArchive(f"the payload of {name} doesn't hold")
    length = told if payload is None else len(payload)
    digest = digest.partition(":")[2] if digest else None if payload is None else base32_sha1(payload)
    return page_of(name), f.get("warc-target-uri"), kind, page_of(f.get("warc-refers-to")), length, digest, name, f.get("warc-refers-to"), payload


def with_reference(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): the largest page_id of equal payloads of `least` bytes and more, null for that page itself.

    A null html is an empty payload. Only digests that occur more than once are joined to the pages, from a written table:
    Spark broadcasts it if its size allows, else it joins by shuffle and splits hot digests.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("_digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    large = rows.where(F.octet_length("html") >= least)
    repeated = large.groupBy("_digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").select("_digest", "_last")
    joined = rows.join(written(repeated, "payloads"), "_digest", "left")
    return joined.select("page_id", "url", "html", F.when((F.col("_last") != F.coalesce("page_id", F.lit(-1))) & (F.octet_length("html") >= least), F.col("_last")).alias("refers_to"))


def archives(pages: DataFrame, level: int = 6, least: int = 0) -> DataFrame:
    """The pages' archives as chunks of about 1 MB of gzip members, in order: each task writes archives one after another, of about ROLL bytes each.

    Null urls are empty, null htmls empty payloads; repeated rows are records each, and so are rows without a page_id. No rows: no archive.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        archive, chunk, held, size = TaskContext.get().partitionId() << 24, 0, [], 0
        for pdf in batches:
            for page_id, url, html, refers_to in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
                one = member(None if pd.isna(page_id) else int(page_id), url, html.encode("utf-8", "surrogatepass"), None if pd.isna(refers_to) else int(refers_to), level)
                held.append(one)
                size += len(one)
                if size >= CHUNK:
                    yield pd.DataFrame({"archive": [archive], "chunk": [chunk], "data": [b"".join(held)]})
                    chunk, held, size = chunk + 1, [], 0
                    if chunk * CHUNK >= ROLL:
                        archive, chunk = archive + 1, 0
        if held:
            yield pd.DataFrame({"archive": [archive], "chunk": [chunk], "data": [b"".join(held)]})

    return small_batches(with_reference(pages, least)).mapInPandas(run, CHUNKS)


def _rows(archive: Iterator[bytes], payloads: bool) -> Iterator[pd.DataFrame]:
    """One archive's records, a few megabytes of them at a time."""
    names = [c.split()[0] for c in RECORDS.split(", ")][: None if payloads else -1]
    out, size = [], 0
    for content in members(archive):
        out.append(record(content)[: len(names)])
        size += len(content)
        if size > 4 * CHUNK:
            yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})
            out, size = [], 0
    yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})


def _schema(payloads: bool) -> str:
    return RECORDS if payloads else RECORDS.rsplit(", ", 1)[0]


def read(chunks: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives given as (archive, chunk, data), each archive in one sequence; a broken one raises BrokenArchive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = ((a, d) for pdf in batches for a, d in zip(pdf["archive"], pdf["data"], strict=True))
        held = next(parts, None)
        while held is not None:
            archive = held[0]

            def one() -> Iterator[bytes]:
                nonlocal held
                while held is not None and held[0] == archive:  # noqa: B023
                    data = held[1]
                    held = next(parts, None)
                    yield bytes(data)

            yield from _rows(one(), payloads)

    # A task an archive, about, however many they are: one number comes to the driver.
    width = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks.select("archive").distinct().count())
    return chunks.repartition(width, "archive").sortWithinPartitions("archive", "chunk").mapInPandas(run, _schema(payloads))


def read_files(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of .warc.gz files of any writer: a file is opened where it lies and read in sequence by one task, a megabyte at a time.

    Spark lists the files; tasks open them with Arrow's file systems (local, HDFS, S3, GCS). A store that only Spark's own readers reach
    is read by Spark, each file whole.
    """
    from pyarrow import fs

    files = spark.read.format("binaryFile").load(path)
    first = files.select("path").first()
    try:
        reached = first is None or fs.FileSystem.from_uri(_uri(first["path"]))[0] is not None
    except (ValueError, OSError):
        reached = False
    if not reached:
        whole = files.select(F.xxhash64("path").alias("archive"), F.lit(0).cast("long").alias("chunk"), F.col("content").alias("data"))
        return read(whole, payloads)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["path"]:
                store, at = fs.FileSystem.from_uri(_uri(name))
                with store.open_input_stream(at, compression=None) as stream:
                    yield from _rows(iter(lambda s=stream: s.read(CHUNK), b""), payloads)

    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), files.select("path").count())
    return files.select("path").repartition(width, "path").mapInPandas(run, _schema(payloads))


def _uri(path: str) -> str:
    """Hadoop writes file:/a for file:///a."""
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path
