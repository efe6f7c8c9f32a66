"""Chunking, deduplication, digests and integrity over texts and extents."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytecairn.functions import text as fx
from bytecairn.operators import content as ct
from bytecairn.sources import model as m
from bytecairn.sources.model import sql, table


def document_exact_dedup(spark, d):
    """Whole-content deduplication by digest and size, per source."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    return docs.groupBy("source", "hash", "size").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


def fixed_block_dedup(spark, d):
    blocks = ct.fixed_blocks(table(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text", 256)
    hashed = blocks.select(F.sha2(F.col("block").cast("binary"), 256).alias("hash"), F.octet_length("block").cast("long").alias("size"))
    return ct.dedup_ratio(hashed, ["hash", "size"], "size")


def cdc_chunk_dedup(spark, d):
    """Content-defined chunks of all texts and pages, at sizes scaled to these texts."""
    docs = table(spark, d, "documents").select(F.col("text").cast("binary").alias("content")).unionAll(table(spark, d, "pages").select(F.col("html").cast("binary")))
    chunks = ct.chunked(docs, F.col("content"), 256, 1024, 4096).select(F.explode("chunks").alias("c")).select(F.col("c.hash").alias("hash"), F.col("c.length").cast("long").alias("size"))
    return ct.dedup_ratio(chunks, ["hash", "size"], "size")


def multipart_etag(spark, d):
    """ETags of texts uploaded in parts of 1000 characters."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", fx.multipart_etag(ct.parts_of(F.col("text"), 1000)).alias("etag"))


def page_hashes(spark, d):
    return ct.pages_of(table(spark, d, "pages"), "page_id", F.col("html").cast("binary"), 4096)


def merkle_roots(spark, d):
    hashed = ct.pages_of(table(spark, d, "pages"), "page_id", F.col("html").cast("binary"), 1024)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "hash"))), lambda x: x["hash"])
    return hashed.groupBy("page_id").agg(ordered.alias("hashes")).select("page_id", F.size("hashes").cast("long").alias("leaves"), ct.merkle_root(F.col("hashes")).alias("root"))


def page_groups(spark, d):
    """Digests of groups of 256 page hashes, pages being 16 bytes at the scale of these texts."""
    hashed = ct.pages_of(table(spark, d, "pages"), "page_id", F.col("html").cast("binary"), 16)
    return ct.hash_groups(hashed, "page_id", 256)


def merkle_proofs(spark, d):
    """The root of every page, told from its last leaf and that leaf's proof alone."""
    hashed = ct.pages_of(table(spark, d, "pages"), "page_id", F.col("html").cast("binary"), 1024)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "hash"))), lambda x: x["hash"])
    leaves = hashed.groupBy("page_id").agg(ordered.alias("hashes")).withColumn("at", F.size("hashes") - 1)
    proven = leaves.select("page_id", F.size("hashes").cast("long").alias("leaves"), F.get("hashes", F.col("at")).alias("leaf"), ct.merkle_proof(F.col("hashes"), F.col("at")).alias("proof"))
    return proven.select("page_id", "leaves", ct.proven_root(F.col("leaf"), F.col("proof")).alias("root"))


def more_checksums(spark, d):
    """CRC-32 and XXH64 (seed 42) of whole texts; SQL has neither, so it is tested against other libraries."""
    return table(spark, d, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc32"), F.xxhash64("text").alias("xxh64"))


def range_digests(spark, d):
    """Chained digests of the extents of every stream."""
    spans = m.extents(spark, d).groupBy("stream_id").agg(F.sort_array(F.collect_set(F.struct("lo", "hi", "chunk_id"))).alias("s"))
    parts = F.transform("s", lambda x: F.concat_ws(":", x["lo"].cast("string"), x["hi"].cast("string"), x["chunk_id"].cast("string")))
    return spans.select("stream_id", fx.range_digest(parts).alias("digest"))


def checksums(spark, d):
    b = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", F.md5(b).alias("md5"), F.sha1(b).alias("sha1"), F.sha2(b, 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


def compression_policy(spark, d):
    docs = table(spark, d, "documents").select("source", F.col("text").cast("binary").alias("content"))
    decided = ct.compression_policy(docs, F.col("content"))
    return decided.groupBy("compress").agg(F.count(F.lit(1)).alias("objects"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


def _mapped(spark, d):
    e = m.extents(spark, d).select("stream_id", "lo", "hi", "chunk_id").distinct()
    return e.join(m.chunks(spark, d).where("kind <> 'pending'").select("chunk_id", "raw_size"), "chunk_id", "left").select("stream_id", "lo", "hi", "chunk_id", "raw_size")


MAPPED = ", mapped AS (SELECT e.*, raw_size FROM (SELECT DISTINCT stream_id, lo, hi, chunk_id FROM extents) e LEFT JOIN (SELECT * FROM chunks WHERE kind <> 'pending') c USING (chunk_id))"


def integrity_gaps(spark, d):
    """Where a stream's next interval does not start at the end of the one before it."""
    spans = m.extents(spark, d).groupBy("stream_id", "lo").agg(F.max("hi").alias("hi"))
    from pyspark.sql import Window

    before = F.lag("hi", 1, 0).over(Window.partitionBy("stream_id").orderBy("lo"))
    return spans.withColumn("expected", before).where("lo <> expected").select("stream_id", "expected", "lo")


def integrity_bounds(spark, d):
    over = _mapped(spark, d).where("hi - lo > raw_size OR raw_size IS NULL")
    return over.groupBy(F.when(F.col("raw_size").isNull(), "bad_source").otherwise("beyond_source").alias("code")).agg(F.count(F.lit(1)).alias("extents"), F.countDistinct("stream_id").alias("streams"))


def _issues(spark, d):
    # lo and hi do not order repeated intervals alone, so one extent stands for each
    one = _mapped(spark, d).groupBy("stream_id", "lo", "hi").agg(F.min("chunk_id").alias("chunk_id"), F.min("raw_size").alias("raw_size"))
    sizes = m.objects(spark, d).select(F.col("object_id").alias("stream_id"), (F.col("size") % 160).alias("size"))
    return ct.interval_issues(one, sizes)


def issue_histogram(spark, d):
    return _issues(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("stream_id").alias("streams"))


def content_check(spark, d):
    """Texts checked against a record in which some lengths and hashes are wrong."""
    b = F.col("text").cast("binary")
    wrong = F.col("doc_id") % 40 == 3
    rows = table(spark, d, "documents").select("doc_id", "text", F.when(wrong, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(b, 256)).alias("expected"), F.when(F.col("doc_id") % 50 == 7, F.octet_length("text") + 1).otherwise(F.octet_length("text")).alias("size"))
    return ct.verify_content(rows, F.col("text").cast("binary"), "expected", "size").select("doc_id", "code")


def orphan_files(spark, d):
    """Listed files that no index row names."""
    listed = table(spark, d, "supplier").select((F.col("s_suppkey") * 31 % 2003).alias("file"))
    return listed.join(table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("file")), "file", "left_anti")


def stripe_location(spark, d):
    """Which data slot and offset of an erasure-coded payload hold a byte: four data shards, 64-byte units."""
    asked = m.objects(spark, d).select("object_id", (F.col("size") % 100_000).alias("byte"))
    unit = F.floor(F.col("byte") / 64).cast("long")
    return asked.select("object_id", (unit % 4).alias("slot"), (F.floor(unit / 4).cast("long") * 64 + F.col("byte") % 64).alias("offset"))


MERKLE = (
    "WITH RECURSIVE p AS (SELECT page_id, encode(html) AS c FROM pages WHERE octet_length(encode(html)) > 0), h AS (SELECT page_id, list(sha256(c[n * 1024 + 1 : n * 1024 + 1024]) ORDER BY n) AS l FROM (SELECT page_id, c, unnest(range(0, CAST(ceil(octet_length(c) / 1024.0) AS BIGINT))) AS n FROM p) GROUP BY page_id), "
    "t AS (SELECT page_id, len(l) AS leaves, l FROM h UNION ALL SELECT page_id, leaves, list_transform(range(0, (len(l) + 1) // 2), lambda i: CASE WHEN 2 * i + 2 <= len(l) THEN sha256(l[2 * i + 1] || l[2 * i + 2]) ELSE l[2 * i + 1] END) FROM t WHERE len(l) > 1) "
    "SELECT page_id, leaves, l[1] AS root FROM t WHERE len(l) = 1"
)
RANGE_DIGESTS = sql(", s AS (SELECT stream_id, list(lo || ':' || hi || ':' || chunk_id ORDER BY lo, hi, chunk_id) AS parts FROM (SELECT DISTINCT stream_id, lo, hi, chunk_id FROM extents) GROUP BY stream_id) SELECT stream_id, list_reduce(list_prepend('', parts), lambda a, x: sha256(a || x)) AS digest FROM s", "extents")
QUERIES = {
    "document_exact_dedup": (document_exact_dedup, "SELECT source, sha256(text) AS hash, octet_length(encode(text)) AS size, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY source, sha256(text), octet_length(encode(text)) HAVING count(*) > 1"),
    "fixed_block_dedup": (
        fixed_block_dedup,
        "WITH b AS (SELECT substr(text, n * 256 + 1, 256) AS block FROM (SELECT text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 256.0) AS BIGINT)))) AS n FROM documents WHERE text IS NOT NULL)), u AS (SELECT block, octet_length(encode(block)) AS s, count(*) AS n FROM b GROUP BY block) SELECT CAST(sum(n) AS BIGINT) AS chunks, count(*) AS unique_chunks, CAST(sum(n * s) AS BIGINT) AS logical_bytes, CAST(sum(s) AS BIGINT) AS unique_bytes FROM u",
    ),
    "cdc_chunk_dedup": (cdc_chunk_dedup, None),
    "multipart_etag": (
        multipart_etag,
        "WITH p AS (SELECT doc_id, n, md5(substr(text, n * 1000 + 1, 1000)) AS h FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT)))) AS n FROM documents WHERE text IS NOT NULL)) SELECT doc_id, md5(unhex(string_agg(h, '' ORDER BY n))) || '-' || count(*) AS etag FROM p GROUP BY doc_id",
    ),
    "page_hashes": (
        page_hashes,
        "WITH p AS (SELECT page_id, encode(html) AS c FROM pages), n AS (SELECT page_id, c, CAST(unnest(range(0, CAST(ceil(octet_length(c) / 4096.0) AS BIGINT))) AS INTEGER) AS page_no FROM p), s AS (SELECT page_id, page_no, c[page_no * 4096 + 1 : page_no * 4096 + 4096] AS part FROM n) SELECT page_id, page_no, sha256(part) AS hash, octet_length(part) AS bytes FROM s",
    ),
    "merkle_roots": (merkle_roots, MERKLE),
    "merkle_proofs": (merkle_proofs, MERKLE),
    "page_groups": (
        page_groups,
        "WITH p AS (SELECT page_id, encode(html) AS c FROM pages), n AS (SELECT page_id, c, unnest(range(0, CAST(ceil(octet_length(c) / 16.0) AS BIGINT))) AS i FROM p), h AS (SELECT page_id, i, sha256(c[i * 16 + 1 : i * 16 + 16]) AS hash FROM n) SELECT page_id, CAST(i // 256 AS INTEGER) AS group_no, count(*) AS pages, sha256(string_agg(hash, '' ORDER BY i)) AS digest FROM h GROUP BY page_id, i // 256",
    ),
    "more_checksums": (more_checksums, None),
    # one query under two names
    "range_digests": (range_digests, RANGE_DIGESTS),
    "range_digests_whole": (range_digests, RANGE_DIGESTS),
    "checksums": (checksums, "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, octet_length(encode(text)) AS bytes FROM documents"),
    "compression_policy": (compression_policy, None),
    "integrity_gaps": (
        integrity_gaps,
        sql(", s AS (SELECT stream_id, lo, max(hi) AS hi FROM extents GROUP BY stream_id, lo), l AS (SELECT *, lag(hi, 1, 0) OVER (PARTITION BY stream_id ORDER BY lo) AS expected FROM s) SELECT stream_id, CAST(expected AS BIGINT) AS expected, lo FROM l WHERE lo <> expected", "extents"),
    ),
    "integrity_bounds": (
        integrity_bounds,
        sql(MAPPED + " SELECT CASE WHEN raw_size IS NULL THEN 'bad_source' ELSE 'beyond_source' END AS code, count(*) AS extents, count(DISTINCT stream_id) AS streams FROM mapped WHERE hi - lo > raw_size OR raw_size IS NULL GROUP BY 1", "extents", "chunks"),
    ),
    "issue_histogram": (
        issue_histogram,
        sql(MAPPED + """, one AS (SELECT stream_id, lo, hi, min(raw_size) AS raw_size FROM mapped GROUP BY stream_id, lo, hi), l AS (SELECT *, lag(hi, 1, 0) OVER (PARTITION BY stream_id ORDER BY lo, hi) AS before FROM one),
z AS (SELECT object_id AS stream_id, size % 160 AS size, (SELECT max(hi) FROM one WHERE one.stream_id = object_id) AS e FROM objects),
i AS (SELECT stream_id, CASE WHEN lo > before THEN 'gap' WHEN lo < before THEN 'overlap' END AS code FROM l UNION ALL SELECT stream_id, CASE WHEN raw_size IS NULL THEN 'bad_source' WHEN hi - lo > raw_size THEN 'beyond_source' END FROM l
UNION ALL SELECT stream_id, CASE WHEN coalesce(e, 0) < size THEN 'short' WHEN e > size THEN 'long' END FROM z) SELECT code, count(*) AS issues, count(DISTINCT stream_id) AS streams FROM i WHERE code IS NOT NULL GROUP BY code""", "objects", "extents", "chunks"),
    ),
    "content_check": (
        content_check,
        "SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN doc_id % 50 = 7 THEN 'length' ELSE 'hash' END AS code FROM documents WHERE text IS NULL OR doc_id % 50 = 7 OR doc_id % 40 = 3",
    ),
    "orphan_files": (orphan_files, "SELECT s_suppkey * 31 % 2003 AS file FROM supplier WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = s_suppkey * 31 % 2003 AND p_size > 5)"),
    "stripe_location": (stripe_location, sql('SELECT object_id, size % 100000 // 64 % 4 AS slot, size % 100000 // 256 * 64 + size % 64 AS "offset" FROM (SELECT object_id, size % 100000 AS size FROM objects)', "objects")),
}
