"""Interleaved document sequences with media columns.

A page's HTML is parsed into its ordered items: runs of text, and references to media with their captions. Media
live in a content-addressed store, keyed by the SHA-256 of their payload; a join on that digest resolves the
references, and every item keeps its position and caption.

``store_texts`` makes such pages of a table of texts: the UTF-8 bytes, padded with spaces to a multiple of
192, become the 8-bit samples of a grey map (PGM, 192 wide) whose comment holds the unpadded length. The
store is a Parquet table in the shared folder. A task stores a payload once; copies that several tasks stored meet
when the decoded values are grouped by digest, so no payload is ever shuffled.

Defined cases: null html has no items, null texts are empty payloads (192 spaces); unclosed tags are read
as far as they go; script, style, title, noscript, template and comments are no text; of nested figures the innermost captions its media; a source set gives its first source; a reference without a digest or with an unknown one stays, unresolved (null columns);
repeated rows are repeated; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, hot_lookup, materialise, scratch_path, table

WIDTH = 192
SCHEME = "sha256:"
ITEM = "struct<position:int,kind:string,text:string,src:string,digest:string,caption:string>"
MEDIA_TAGS = {"img": "image", "video": "video", "audio": "audio", "source": "source", "embed": "embed", "iframe": "frame", "object": "object"}
#: Elements whose text is not the page's.
SILENT_TAGS = ("script", "style", "title", "noscript", "template")
#: Digests a task remembers, to store a payload once.
REMEMBERED = 200_000
BINS = 16


class _Interleaver(HTMLParser):
    """Collects text runs and media references in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.silent = 0
        self.figures: list[int] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        said = re.sub(r"\s+", " ", "".join(self.text)).strip()
        self.text = []
        if said:
            self.items.append({"kind": "text", "text": said, "src": None, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT_TAGS:
            self.silent += 1
        elif tag == "figure":
            self.flush()
            self.figures.append(len(self.items))
        elif tag == "figcaption":
            self.caption = []
        elif tag in MEDIA_TAGS:
            at = dict(attrs)
            src = at.get("src") or at.get("data") or ((at.get("srcset") or "").split() or [None])[0]
            digest = at.get("data-digest") or (src.removeprefix(SCHEME) if src and src.startswith(SCHEME) else None)
            self.flush()
            self.items.append({"kind": MEDIA_TAGS[tag], "text": None, "src": src, "digest": digest, "caption": at.get("alt") or at.get("title")})
        elif tag in ("p", "br", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "tr"):
            self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT_TAGS:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            said, self.caption = re.sub(r"\s+", " ", "".join(self.caption)).strip(), None
            self.flush()
            for item in self.items[self.figures[-1] if self.figures else len(self.items) :]:
                if item["kind"] != "text" and not item.get("captioned"):
                    item["caption"], item["captioned"] = said, True
        elif tag == "figure":
            self.flush()
            if self.figures:
                self.figures.pop()
        elif tag in ("p", "div", "article", "section"):
            self.text.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def interleave_html(html: str | None) -> list[dict]:
    """Ordered items of a page."""
    if not html:
        return []
    parser = _Interleaver()
    parser.feed(html)
    parser.close()
    if parser.caption:
        parser.text += parser.caption
    parser.flush()
    return [{"position": i} | {k: v for k, v in item.items() if k != "captioned"} for i, item in enumerate(parser.items)]


def interleave(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``items``, an array of ITEM, in place of the html column."""

    @F.pandas_udf(f"array<{ITEM}>")
    def parse(column: pd.Series) -> pd.Series:
        return column.map(interleave_html)

    return pages.withColumn("items", parse(html)).drop(html)


def resolve(sequences: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """One row per item, its media columns joined by digest; ``media`` has one row a digest.

    A sequence without items has one row, without position.     ``key`` names a column that tells the rows of ``sequences`` apart.
    """
    items = sequences.select(key, F.explode_outer("items").alias("item")).select(key, "item.*")
    return hot_lookup(items, "digest", media, [key, "position"])


def collect(resolved: DataFrame, key: str) -> DataFrame:
    """Items of each sequence gathered again, by position; a sequence without items has none."""
    rest = [c for c in resolved.columns if c not in (key, "position")]
    item = F.when(F.col("position").isNotNull(), F.struct("position", *rest))
    return resolved.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))


def encode_samples(payload: bytes, n_bytes: int) -> bytes:
    """A payload of whole rows as a grey map."""
    return b"P5\n# bytes %d\n%d %d\n255\n" % (n_bytes, WIDTH, len(payload) // WIDTH) + payload


def decode_samples(stored: bytes) -> tuple[bytes, int]:
    """Payload and unpadded length of a stored grey map."""
    m = re.match(rb"P5\n# bytes (\d+)\n(\d+) (\d+)\n255\n", stored)
    if not m:
        raise ValueError("not a stored grey map")
    payload = stored[m.end() :]
    if len(payload) != int(m[2]) * int(m[3]):
        raise ValueError("samples are missing")
    return payload, int(m[1])


def feature_of(payload: bytes) -> str:
    """Mean, deviation, mean step between neighbours, and a histogram in thousandths."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    counts = np.bincount(samples, minlength=256)
    values = np.arange(256)
    mean = float(counts @ values) / len(samples)
    spread = max(0.0, float(counts @ (values * values)) / len(samples) - mean * mean) ** 0.5
    up, low = np.maximum(samples[1:], samples[:-1]), np.minimum(samples[1:], samples[:-1])
    step = int((up - low).sum(dtype=np.int64)) / max(1, len(samples) - 1)
    bins = counts.reshape(BINS, -1).sum(axis=1) * 1000 // len(samples)
    return f"mean={mean:.3f};dev={spread:.3f};step={step:.3f};hist={','.join(map(str, bins))}"


def store_texts(documents: DataFrame, path: str) -> None:
    """Write row, doc_id, html, digest and (once a task) media for every text to the table at ``path``."""

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for pdf in batches:
            pages, digests, media = [], [], []
            for text in pdf["text"]:
                raw = (text or "").encode("utf-8")
                payload = raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)
                sha = hashlib.sha256(payload)
                key = sha.digest() + len(raw).to_bytes(8, "big")
                digests.append(name := hashlib.sha256(key).hexdigest())
                pages.append(f'<article><p>{len(raw)} bytes</p><figure><img src="{SCHEME}{name}" alt="text"><figcaption>{sha.hexdigest()}</figcaption></figure></article>')
                media.append(None if key in seen else encode_samples(payload, len(raw)))
                if len(seen) < REMEMBERED:
                    seen.add(key)
            yield pd.DataFrame({"row": pdf["row"], "doc_id": pdf["doc_id"], "html": pages, "digest": digests, "media": media})

    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string"), "text")
    stored = rows.mapInPandas(store, "row long, doc_id string, html string, digest string, media binary")
    with bounded_batches(documents.sparkSession):
        stored.write.option("compression", "zstd").parquet(path)


def decoded_media(spark: SparkSession, path: str) -> DataFrame:
    """One row a digest of the store: lengths, digests and feature of what is read back."""
    names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for digest, stored in zip(pdf["digest"], pdf["media"]):
                payload, n = decode_samples(stored)
                rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(payload)))
            yield pd.DataFrame(rows, columns=names)

    kept = spark.read.parquet(path).select("digest", "media").where(F.col("media").isNotNull())
    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    values = kept.mapInPandas(decode, schema)
    return values.groupBy("digest").agg(*[F.first(c).alias(c) for c in names[1:]])


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` stored as samples, referenced from a page, resolved and read back."""
    path = scratch_path(spark, "media")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    store_texts(documents, path)
    pages = spark.read.parquet(path)
    resolved = resolve(interleave(pages.select("row", "doc_id", "html")).withColumn("key", F.struct("row", "doc_id")), decoded_media(spark, path), "key")
    images = resolved.where(F.col("kind") == "image")
    # the caption travels with its reference: it must name the payload that the digest resolved to
    checked = F.when(F.col("caption") == F.col("payload_sha256"), F.col("payload_sha256")).otherwise(F.raise_error(F.lit("a caption lost its payload")))
    out = images.select(F.col("key.doc_id").cast(documents.schema["doc_id"].dataType).alias("doc_id"), "n_bytes", "payload_bytes", checked.alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature")
    with bounded_batches(spark):
        result = materialise(out)
    discard(spark, path)
    return result
