"""WARC archives with an embedded Zstandard dictionary.

Pages become WARC/1.1 records. Of pages with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the
smallest page_id is a response and the others are revisits that refer to it. Every task writes archives of
bounded size: it trains a dictionary on records of the archive, puts it in a leading skippable frame (magic
0x184D2A5D) and compresses each record as a frame of its own, so a record can be read alone.

An archive is a row (name, index, content) of a Parquet table in the shared folder, written by Spark's own
committer; a lost executor repeats its task and never leaves a half archive. ``content`` is the bytes of a
``.warc.zst`` file (``export_files`` writes such files), ``index`` the offset of every record frame, for reading some of them.

Defined cases: a null html is an empty payload; a null url is the target ``about:blank``; a page with a null
page_id is a revisit if a page with an id has its payload, else a response; equal page_ids with equal
payloads are all responses when that id is the smallest; an empty table writes no archive; control
characters in a url are percent-encoded; a page whose payload alone exceeds the archive size gets
an archive of its own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, hot_group_aggregate, hot_lookup, materialise, scratch_path, table

REVISIT_BYTES = 100
#: Uncompressed bytes after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 32 << 10
#: Record bytes that train a dictionary, dealt over the whole archive; about a hundred times its size is the library's advice.
TRAINING_BYTES = 100 * DICTIONARY_BYTES
#: Bytes of one training record; longer ones give evenly spaced parts.
TRAINING_PART = 16 << 10
LEVEL = 3
#: Fixed values of the WARC and Zstandard dictionary formats.
SKIPPABLE_MAGIC = 0x184D2A5D
SKIPPABLE_FAMILY = 0x184D2A50
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6f0c1f0e-5a53-5a8e-9d1b-0d6a3a0c9b11")
WARC_DATE = "2024-01-01T00:00:00Z"

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html and the response each page refers to (null for responses)."""
    keyed = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    slim = materialise(keyed.where(F.col("size") >= REVISIT_BYTES).select("page_id", "digest"))
    firsts = hot_group_aggregate(slim, ["digest"], ["page_id"], {"first": (F.min("page_id"), "min")})
    revisits = firsts.where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first").distinct()
    joined = keyed.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select("page_id", "url", "html", F.col("first").alias("refers_to"))


def record_id(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}')}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(NAMESPACE, 'null ' + url)}>"


def format_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit carries the payload's digest and length but not the payload."""
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "about:blank"
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, target)}",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to, '')}", f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple:
    """Fields of RECORD; the payload's digest and length are checked against the headers of a response."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    page = int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None
    length, digest, payload = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of page {page} does not match its headers")
    refers = int(fields["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in fields else None
    return page, length, digest, fields["WARC-Type"], refers, fields["WARC-Target-URI"], payload


def _training_set(records: list[bytes]) -> list[bytes]:
    """Parts of records from all over the archive, ``TRAINING_BYTES`` at most."""
    parts = []
    for r in records:
        n = -(-len(r) // TRAINING_PART)
        parts += [r[i * len(r) // n : i * len(r) // n + TRAINING_PART] for i in range(n)] if n > 1 else [r]
    room = sum(map(len, parts))
    step = max(1.0, room / TRAINING_BYTES)
    return [parts[int(i * step)] for i in range(int(len(parts) / step))]


def build_archive(records: list[bytes]) -> tuple[bytes, list[int]]:
    """Content of one ``.warc.zst`` file and the offset of every record's frame."""
    sample = _training_set(records)
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=LEVEL)
    except zstandard.ZstdError:  # too few or too short records to train on: their raw content is the dictionary
        dictionary = zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = dictionary.as_bytes()
    out = bytearray(struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    index = []
    for r in records:
        index.append(len(out))
        out += compressor.compress(r)
    return bytes(out), index


def frame_end(content: bytes, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, told by its headers alone."""
    magic, size = struct.unpack_from("<II", content, at)
    if magic & ~0xF == SKIPPABLE_FAMILY:
        return at + 8 + size
    checksum = 4 * (content[at + 4] >> 2 & 1)
    at += zstandard.frame_header_size(content[at : at + 18])
    last = False
    while not last:
        head = int.from_bytes(content[at : at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)  # a block of one repeated byte stores that byte
    return at + checksum


def read_archive(content: bytes, index: list[int] | None = None) -> Iterator[bytes]:
    """Records of an archive, each decompressed alone with the embedded dictionary; all, or those that ``index`` names."""
    magic, size = struct.unpack_from("<II", content) if len(content) >= 8 else (0, 0)
    begin, dictionary = 0, None
    if magic == SKIPPABLE_MAGIC:
        begin, raw = 8 + size, content[8 : 8 + size]
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    if index is not None:
        yield from (reader.decompress(content[at : frame_end(content, at)]) for at in index)
        return
    while begin < len(content):
        end = frame_end(content, begin)
        yield reader.decompress(content[begin:end])
        begin = end


def write_archives(planned: DataFrame, path: str) -> None:
    """Write the pages of ``plan_records`` as archives into the table at ``path``."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        size = 0

        def close() -> pd.DataFrame:
            content, index = build_archive(held)
            name = f"{hashlib.sha256(content).hexdigest()[:32]}.warc.zst"
            return pd.DataFrame({"name": [name], "index": [index], "content": [content]})

        for pdf in batches:
            for page, url, html, refers in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"]):
                none = lambda v: None if pd.isna(v) else int(v)
                record = format_record(none(page), url, (html or "").encode("utf-8"), none(refers))
                if held and size + len(record) > ARCHIVE_BYTES:
                    yield close()
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield close()

    exact = planned.select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"))
    with bounded_batches(planned.sparkSession):
        exact.mapInPandas(write, "name string, index array<long>, content binary").write.parquet(path)


def export_files(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """The archives at ``path`` as ``.warc.zst`` files of a folder that all executors reach (a pyarrow file system URI): name, bytes.

    Names are digests of the content and a file appears by a rename, so a repeated task writes the same file again.
    """

    def export(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write(content)
                files.move(part, f"{base}/{name}")
            yield pd.DataFrame({"name": pdf["name"], "bytes": pdf["content"].map(len)})

    return materialise(spark.read.parquet(path).select("name", "content").mapInPandas(export, "name string, bytes long"))


def read_files(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the ``.warc.zst`` files of a folder, frame by frame."""
    return _records(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content"), with_payload)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives at ``path``: the columns of RECORD (no payload unless asked)."""
    return _records(spark.read.parquet(path).select("content"), with_payload)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` read with payload, in which a revisit has the payload of the response it refers to."""
    responses = records.where(F.col("record_type") == "response").groupBy("page_id").agg(F.first("payload").alias("_payload"))
    found = hot_lookup(records.withColumnRenamed("payload", "_own"), "refers_to", responses.withColumnRenamed("page_id", "refers_to"), ["page_id", "url"])
    return found.withColumn("payload", F.coalesce("_own", "_payload")).select(*records.columns)


def _records(archives: DataFrame, with_payload: bool) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = [parse_record(r) for r in read_archive(content)]
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
                out[["page_id", "refers_to"]] = out[["page_id", "refers_to"]].astype("Int64")
                yield out if with_payload else out.drop(columns="payload")

    schema = RECORD if with_payload else RECORD.rpartition(", ")[0]
    return archives.mapInPandas(read, schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written to dictionary-compressed archives and read back."""
    path = scratch_path(spark, "warc")
    write_archives(plan_records(table(spark, sf_dir, "pages")), path)
    with bounded_batches(spark):
        result = materialise(read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    discard(spark, path)
    return result


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
