"""Content-defined chunking, deduplication, page hashes, compression policy and integrity checks."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "array<struct<offset:long,length:int,hash:string>>"


def gear_table(seed: int = 2024) -> np.ndarray:
    """256 fixed 64-bit values, from a seeded generator rather than a list."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


GEAR = gear_table()


def _rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash at every byte over the 32 bytes that end there: sum of gear[b] << age, doubled by halves."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        moved = np.zeros_like(h)
        moved[shift:] = h[:-shift]
        h = h + (moved << np.uint64(shift))
    return h


def cut_points(data: bytes, least: int, average: int, most: int) -> list[int]:
    """Ends of content-defined chunks with normalised sizes; a tail shorter than ``least`` is one chunk.

    The hash at a byte depends on the 32 bytes up to it only, so boundaries do not depend on how bytes arrive.
    """
    if len(data) <= least:
        return [len(data)] if data else []
    bits = max(1, average.bit_length() - 1)
    h = _rolling(np.frombuffer(data, dtype=np.uint8)) >> np.uint64(8)
    strict = np.flatnonzero((h & np.uint64((1 << (bits + 1)) - 1)) == 0) + 1
    loose = np.flatnonzero((h & np.uint64((1 << (bits - 1)) - 1)) == 0) + 1
    ends, at = [], 0
    while len(data) - at > least:
        end = min(len(data), at + most)
        normal = min(end, at + average)
        i = np.searchsorted(strict, at + least)
        if i < len(strict) and strict[i] < normal:
            end = int(strict[i])
        else:
            i = np.searchsorted(loose, normal)
            if i < len(loose) and loose[i] < end:
                end = int(loose[i])
        ends.append(end)
        at = end
    if at < len(data):
        ends.append(len(data))
    return ends


def chunked(rows: DataFrame, content: Column, least: int = 256 << 10, average: int = 1 << 20, most: int = 4 << 20) -> DataFrame:
    """``rows`` with ``chunks``: offset, length and content hash of every chunk of ``content`` (binary)."""

    @F.pandas_udf(CHUNK)
    def cut(column: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> list[dict]:
            out, at = [], 0
            for end in cut_points(data or b"", least, average, most):
                out.append({"offset": at, "length": end - at, "hash": hashlib.sha256(data[at:end]).hexdigest()})
                at = end
            return out

        return column.map(one)

    return rows.withColumn("chunks", cut(content))


def dedup_ratio(chunks: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Logical and unique bytes of chunks that are equal by ``keys``."""
    unique = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(size).alias("_s"))
    return unique.agg(F.sum("_n").alias("chunks"), F.count(F.lit(1)).alias("unique_chunks"), F.sum(F.col("_n") * F.col("_s")).cast("long").alias("logical_bytes"), F.sum("_s").cast("long").alias("unique_bytes"))


def parts_of(text: Column, width: int) -> Column:
    """A text in parts of ``width`` characters, in one pass; an empty text is one empty part."""
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0)))


def fixed_blocks(rows: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Fixed-width blocks of a text's characters: key, block number, block."""
    return rows.select(key, F.posexplode(parts_of(F.col(text), width)).alias("block_no", "block"))


def merkle_root(hashes: Column) -> Column:
    """Root over an ordered array of hex hashes; an odd last one moves up as it is."""
    pair = lambda level: F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(level) / 2).cast("int") - 1),
        lambda i: F.when(F.get(level, i * 2 + 1).isNull(), F.get(level, i * 2)).otherwise(F.sha2(F.concat(F.get(level, i * 2), F.get(level, i * 2 + 1)).cast("binary"), 256)),
    )
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.size(hashes), F.lit(1)).cast("double"))).cast("int")))
    return F.get(F.aggregate(rounds, hashes, lambda level, _: F.when(F.size(level) > 1, pair(level)).otherwise(level)), 0)


def merkle_proof(hashes: Column, at: Column) -> Column:
    """The path from leaf ``at`` to the root: an array of (hash, left), from the leaf up; a level at which the node has no neighbour gives none."""
    pairs = lambda level: F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(level) / 2).cast("int") - 1),
        lambda i: F.when(F.get(level, i * 2 + 1).isNull(), F.get(level, i * 2)).otherwise(F.sha2(F.concat(F.get(level, i * 2), F.get(level, i * 2 + 1)).cast("binary"), 256)),
    )
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.size(hashes), F.lit(1)).cast("double"))).cast("int")))
    start = F.struct(hashes.alias("level"), at.cast("int").alias("at"), F.array().cast("array<struct<hash:string,left:boolean>>").alias("path"))

    def up(a: Column, _: Column) -> Column:
        left = a["at"] % 2 == 1
        other = F.get(a["level"], F.when(left, a["at"] - 1).otherwise(a["at"] + 1))
        path = F.when(other.isNull(), a["path"]).otherwise(F.concat(a["path"], F.array(F.struct(other.alias("hash"), left.alias("left")))))
        return F.struct(F.when(F.size(a["level"]) > 1, pairs(a["level"])).otherwise(a["level"]).alias("level"), F.floor(a["at"] / 2).cast("int").alias("at"), path.alias("path"))

    return F.aggregate(rounds, start, up, lambda a: a["path"])


def proven_root(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(proof, leaf, lambda h, x: F.sha2(F.when(x["left"], F.concat(x["hash"], h)).otherwise(F.concat(h, x["hash"])).cast("binary"), 256))


def hash_groups(pages: DataFrame, key: str, width: int) -> DataFrame:
    """Digests of groups of ``width`` page hashes (key, page_no, hash): key, group_no, pages, digest."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "hash"))), lambda x: x["hash"])
    grouped = pages.groupBy(key, F.floor(F.col("page_no") / width).cast("int").alias("group_no")).agg(F.count(F.lit(1)).alias("pages"), ordered.alias("_h"))
    return grouped.select(key, "group_no", "pages", F.sha2(F.array_join("_h", "").cast("binary"), 256).alias("digest"))


def compression_policy(rows: DataFrame, content: Column, mode: str = "sample", samples: int = 4, least_bytes: int = 64, least_percent: int = 5) -> DataFrame:
    """``rows`` with ``compress``: whether evenly spaced samples save enough; never and always need no look."""
    if mode != "sample":
        return rows.withColumn("compress", F.lit(mode == "always"))

    # samples are cut before Python, which never holds a content
    n = F.octet_length(content)
    width = F.least(F.greatest(F.floor(n / 64).cast("int"), F.lit(256)), F.lit(65_536), n)
    step = F.greatest(F.lit(1), F.floor((n - width) / max(1, samples - 1)).cast("int"))
    seen = F.aggregate(F.sequence(F.lit(0), n - width, step), F.lit(b""), lambda a, at: F.concat(a, F.substring(content, at + 1, width)))

    @F.pandas_udf("boolean")
    def decide(column: pd.Series, sizes: pd.Series) -> pd.Series:
        def one(seen: bytes | None, size: int) -> bool:
            if not seen:
                return False
            saved = len(seen) - len(zlib.compress(seen, 1))
            return saved * int(size) >= max(least_bytes * len(seen), least_percent * int(size) * len(seen) // 100)

        return pd.Series([one(s, n) for s, n in zip(column, sizes)], dtype=bool)

    return rows.withColumn("compress", decide(F.when(n > 0, seen), F.coalesce(n, F.lit(0))))


def interval_issues(extents: DataFrame, sizes: DataFrame) -> DataFrame:
    """Findings on mapped streams: gap, overlap, short, long, bad_source, beyond_source.

    ``extents`` has stream_id, lo, hi, chunk_id, raw_size (null for an unknown chunk); ``sizes`` stream_id, size.
    """
    order = Window.partitionBy("stream_id").orderBy("lo", "hi")
    before = F.lag("hi", 1, 0).over(order)
    local = extents.withColumn("_before", before)
    code = F.when(F.col("lo") > F.col("_before"), "gap").when(F.col("lo") < F.col("_before"), "overlap")
    found = local.select("stream_id", code.alias("code")).where("code IS NOT NULL")
    source = F.when(F.col("raw_size").isNull(), "bad_source").when(F.col("hi") - F.col("lo") > F.col("raw_size"), "beyond_source")
    found = found.unionAll(local.select("stream_id", source.alias("code")).where("code IS NOT NULL"))
    ends = extents.groupBy("stream_id").agg(F.max("hi").alias("_end"))
    whole = sizes.join(ends, "stream_id", "left")
    length = F.when(F.coalesce("_end", F.lit(0)) < F.col("size"), "short").when(F.col("_end") > F.col("size"), "long")
    return found.unionAll(whole.select("stream_id", length.alias("code")).where("code IS NOT NULL"))


def verify_content(rows: DataFrame, content: Column, expected: str, size: str) -> DataFrame:
    """Rows whose content no longer has its recorded length or hash, with the code of what failed."""
    code = F.when(content.isNull(), "missing").when(F.octet_length(content) != F.col(size), "length").when(F.sha2(content, 256) != F.col(expected), "hash")
    return rows.withColumn("code", code).where("code IS NOT NULL")


def pages_of(rows: DataFrame, key: str, content: Column, width: int) -> DataFrame:
    """Fixed pages of binary content with their hashes."""
    n = F.ceil(F.octet_length(content) / width).cast("int")
    numbered = rows.where(F.octet_length(content) > 0).select(key, content.alias("_c"), F.explode(F.sequence(F.lit(0), n - 1)).alias("page_no"))
    page = F.substring(F.col("_c"), F.col("page_no") * width + 1, F.lit(width))
    return numbered.select(key, "page_no", F.sha2(page, 256).alias("hash"), F.octet_length(page).cast("long").alias("bytes"))


def windowed_cut(blocks: Iterator[bytes], least: int, average: int, most: int) -> Iterator[bytes]:
    """Chunks of a byte stream that arrives in blocks, the same as of the whole buffer."""
    held = b""
    for block in blocks:
        held += block
        if len(held) >= 2 * most + 64:
            ends = cut_points(held, least, average, most)
            # the hash needs 32 bytes of the past; keep enough behind the last safe cut
            safe = [e for e in ends if len(held) - e >= most]
            at = 0
            for e in safe:
                yield held[at:e]
                at = e
            held = held[at:]
    at = 0
    for e in cut_points(held, least, average, most):
        yield held[at:e]
        at = e
