"""The catalogue's entities as views over the star-schema tables, and the same views as SQL text.

One place defines what a bucket, object, extent, chunk, pack and change is here; every query reads these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets(spark: SparkSession, d: str) -> DataFrame:
    """bucket_id, project_id, used_limit (bytes; null is unlimited, 0 forbids)."""
    limit = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None)).otherwise(F.floor(F.greatest(F.lit(0.0), F.col("c_acctbal"))) * 100)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("bucket_id"), F.col("c_nationkey").alias("project_id"), "c_name", limit.cast("long").alias("used_limit"))


def objects(spark: SparkSession, d: str) -> DataFrame:
    """object_id, bucket_id, key, size, modified."""
    key = F.concat_ws("/", "o_orderpriority", "o_orderstatus", F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("object_id"), F.col("o_custkey").alias("bucket_id"), key.alias("key"), F.floor("o_totalprice").cast("long").alias("size"), F.col("o_orderdate").alias("modified"), F.col("o_orderstatus").alias("state")
    )


def extents(spark: SparkSession, d: str) -> DataFrame:
    """Half-open byte intervals [lo, hi) of chunks, by stream."""
    lo = (F.col("l_linenumber") - 1).cast("long") * 16
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stream_id"), F.col("l_partkey").alias("chunk_id"), lo.alias("lo"), (lo + F.floor("l_quantity").cast("long")).alias("hi"), F.col("l_suppkey").alias("source_id"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """chunk_id, raw_size, kind (pending, encoding or pack), source (what holds it), stored."""
    kind = F.when(F.col("p_size") % 10 == 0, "pending").when(F.col("p_size") % 2 == 0, "encoding").otherwise("pack")
    source = F.when(kind == "encoding", F.concat(F.lit("e"), F.col("p_partkey").cast("string"))).when(kind == "pack", F.col("p_brand"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), (F.col("p_size").cast("long") * 16).alias("raw_size"), kind.alias("kind"), source.alias("source"), F.floor("p_retailprice").cast("long").alias("stored"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))


def raw_sources(spark: SparkSession, d: str) -> DataFrame:
    """source_id, size, state (writing or ready), owner_stream (null when nobody owns it)."""
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("source_id"), F.floor(F.abs("s_acctbal")).cast("long").alias("size"), F.when(F.col("s_nationkey") % 5 == 0, "writing").otherwise("ready").alias("state"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("owner_stream")
    )


def raw_ranges(spark: SparkSession, d: str) -> DataFrame:
    """stream_id, source_id; a negative stream is not published."""
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_suppkey % 3 < 2")
    return rows.select(F.when(F.col("l_suppkey") % 3 == 0, F.col("l_orderkey")).otherwise(-F.col("l_orderkey")).alias("stream_id"), F.col("l_suppkey").alias("source_id"))


def raw_references(spark: SparkSession, d: str) -> DataFrame:
    """Raw sources that a bucket's objects refer to, each once: bucket_id, project_id, source_id, size."""
    owned = objects(spark, d).select(F.col("object_id").alias("stream_id"), "bucket_id")
    used = raw_ranges(spark, d).join(owned, "stream_id").select("bucket_id", "source_id").distinct()
    return used.join(raw_sources(spark, d).select("source_id", "size"), "source_id").join(buckets(spark, d).select("bucket_id", "project_id"), "bucket_id")


def quotas(spark: SparkSession, d: str) -> DataFrame:
    """bucket_id, used_bytes (extents and raw sources), object_count."""
    owner = objects(spark, d).select("object_id", "bucket_id")
    extent = extents(spark, d).join(owner, F.col("stream_id") == F.col("object_id")).select("bucket_id", (F.col("hi") - F.col("lo")).alias("bytes"), F.lit(0).alias("objects"))
    raw = raw_references(spark, d).select("bucket_id", "size", F.lit(0))
    return extent.unionAll(raw).unionAll(owner.select("bucket_id", F.lit(0).cast("long"), F.lit(1))).groupBy("bucket_id").agg(F.sum("bytes").alias("used_bytes"), F.sum("objects").alias("object_count"))


def physical(spark: SparkSession, d: str) -> DataFrame:
    """Everything stored for chunks: source_type, source, state, stored, garbage."""
    c, part = chunks(spark, d), table(spark, d, "part")
    used = extents(spark, d).select("chunk_id").distinct()
    ready = c.where("kind = 'encoding'").join(used.withColumn("_used", F.lit(True)), "chunk_id", "left").select(F.lit("chunk").alias("source_type"), "source", F.lit("ready").alias("state"), "stored", F.col("_used").isNull().alias("garbage"))
    old = part.where("p_size % 7 = 0").select(F.lit("chunk"), F.concat(F.lit("r"), F.col("p_partkey").cast("string")), F.lit("retired"), F.floor(F.col("p_retailprice") / 2).cast("long"), F.lit(True))
    new = part.where("p_size % 11 = 0").select(F.lit("chunk"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")), F.lit("uploading"), F.floor("p_retailprice").cast("long"), F.lit(False))
    packs = c.where("kind = 'pack'").groupBy("source").agg(F.sum("stored").alias("stored")).select(F.lit("pack"), "source", F.lit("ready"), "stored", F.lit(False))
    even = F.col("r_regionkey") % 2 == 0
    more = table(spark, d, "region").select(F.lit("pack"), F.concat(F.lit("old"), F.col("r_regionkey").cast("string")), F.when(even, "retired").otherwise("preparing"), ((F.col("r_regionkey") + 1) * 1000).cast("long"), even)
    return ready.unionAll(old).unionAll(new).unionAll(packs).unionAll(more)


def changes(spark: SparkSession, d: str) -> DataFrame:
    """An ordered change log: bucket, key, seq, op, stamp, size."""
    return table(spark, d, "events").select(
        (F.col("user_id") % 5).alias("bucket"), F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.col("ts").alias("stamp"), F.floor(F.col("value") * 100).cast("long").alias("size"), F.col("event_type").alias("kind")
    )


def journal(spark: SparkSession, d: str) -> DataFrame:
    """A journal a user, with generations and with faults in some of them: bucket, key, seq, op, generation, size."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    n, i = F.row_number().over(order), F.col("event_id")
    op = F.when(n == 1, "start").when(n == 4, "ready").when((i % 23 == 0) & (n > 8), "start").when((i % 23 == 1) & (n > 8), "ready").when(i % 131 == 2, "drop").when(i % 29 == 3, "pause").when(i % 29 == 4, "resume").when(F.col("event_type") == "error", "delete").otherwise("put")
    rows = table(spark, d, "events").withColumn("n", n).withColumn("op", op)
    drops = F.sum(F.when(F.col("op") == "drop", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    life = Window.partitionBy("user_id", "drops").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    lived = rows.withColumn("drops", F.coalesce(drops, F.lit(0))).withColumn("opened", F.sum(F.when(F.col("op") == "start", 1).otherwise(0)).over(life))
    seq = F.col("n") + F.max(F.when(F.col("event_id") % 997 == 5, 1).otherwise(0)).over(past)
    generation = F.col("opened") + F.when(F.col("event_id") % 613 == 6, 1).otherwise(0)
    return lived.select(F.col("user_id").alias("bucket"), (F.col("event_id") % 7).alias("key"), seq.cast("long").alias("seq"), "op", generation.cast("long").alias("generation"), F.floor(F.col("value") * 100).cast("long").alias("size"))


VIEWS = {
    "journal": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        o AS (SELECT *, CASE WHEN n = 1 THEN 'start' WHEN n = 4 THEN 'ready' WHEN event_id % 23 = 0 AND n > 8 THEN 'start' WHEN event_id % 23 = 1 AND n > 8 THEN 'ready' WHEN event_id % 131 = 2 THEN 'drop'
          WHEN event_id % 29 = 3 THEN 'pause' WHEN event_id % 29 = 4 THEN 'resume' WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op FROM n),
        l AS (SELECT *, coalesce(sum(CASE WHEN op = 'drop' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS drops,
          max(CASE WHEN event_id % 997 = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS late FROM o)
        SELECT user_id AS bucket, event_id % 7 AS key, CAST(n + late AS BIGINT) AS seq, op,
          CAST(sum(CASE WHEN op = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, drops ORDER BY event_id ROWS UNBOUNDED PRECEDING) + CASE WHEN event_id % 613 = 6 THEN 1 ELSE 0 END AS BIGINT) AS generation,
          CAST(floor(value * 100) AS BIGINT) AS size FROM l""",
    "buckets": """SELECT c_custkey AS bucket_id, c_nationkey AS project_id, c_name,
        CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(floor(greatest(0.0, c_acctbal)) AS BIGINT) * 100 END AS used_limit FROM customer""",
    "objects": """SELECT o_orderkey AS object_id, o_custkey AS bucket_id,
        o_orderpriority || '/' || o_orderstatus || '/' || CAST(o_orderkey AS VARCHAR) AS key,
        CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderdate AS modified, o_orderstatus AS state FROM orders""",
    "extents": """SELECT l_orderkey AS stream_id, l_partkey AS chunk_id, CAST(l_linenumber - 1 AS BIGINT) * 16 AS lo,
        CAST(l_linenumber - 1 AS BIGINT) * 16 + CAST(floor(l_quantity) AS BIGINT) AS hi, l_suppkey AS source_id FROM lineitem""",
    "chunks": """SELECT p_partkey AS chunk_id, CAST(p_size AS BIGINT) * 16 AS raw_size,
        CASE WHEN p_size % 10 = 0 THEN 'pending' WHEN p_size % 2 = 0 THEN 'encoding' ELSE 'pack' END AS kind,
        CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'e' || CAST(p_partkey AS VARCHAR) ELSE p_brand END AS source,
        CAST(floor(p_retailprice) AS BIGINT) AS stored, p_brand AS brand, p_type AS type FROM part""",
    "changes": """SELECT user_id % 5 AS bucket, user_id AS key, event_id AS seq,
        CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, ts AS stamp,
        CAST(floor(value * 100) AS BIGINT) AS size, event_type AS kind FROM events""",
    "raw_sources": """SELECT s_suppkey AS source_id, CAST(floor(abs(s_acctbal)) AS BIGINT) AS size,
        CASE WHEN s_nationkey % 5 = 0 THEN 'writing' ELSE 'ready' END AS state, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS owner_stream FROM supplier""",
    "raw_ranges": """SELECT CASE WHEN l_suppkey % 3 = 0 THEN l_orderkey ELSE -l_orderkey END AS stream_id, l_suppkey AS source_id
        FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 3 < 2""",
    "raw_references": """SELECT DISTINCT o.bucket_id, b.project_id, r.source_id, r.size FROM objects o JOIN buckets b USING (bucket_id)
        JOIN raw_ranges e ON e.stream_id = o.object_id JOIN raw_sources r USING (source_id)""",
    "quotas": """SELECT bucket_id, sum(bytes) AS used_bytes, sum(n) AS object_count FROM (
        SELECT bucket_id, hi - lo AS bytes, 0 AS n FROM used UNION ALL SELECT bucket_id, size, 0 FROM raw_references
        UNION ALL SELECT bucket_id, 0, 1 FROM objects) GROUP BY bucket_id""",
    "physical": """SELECT 'chunk' AS source_type, source, 'ready' AS state, stored, chunk_id NOT IN (SELECT chunk_id FROM extents) AS garbage FROM chunks WHERE kind = 'encoding'
        UNION ALL SELECT 'chunk', 'r' || p_partkey, 'retired', CAST(floor(p_retailprice / 2) AS BIGINT), true FROM part WHERE p_size % 7 = 0
        UNION ALL SELECT 'chunk', 'u' || p_partkey, 'uploading', CAST(floor(p_retailprice) AS BIGINT), false FROM part WHERE p_size % 11 = 0
        UNION ALL SELECT 'pack', source, 'ready', sum(stored), false FROM chunks WHERE kind = 'pack' GROUP BY source
        UNION ALL SELECT 'pack', 'old' || r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 'retired' ELSE 'preparing' END, (r_regionkey + 1) * 1000, r_regionkey % 2 = 0 FROM region""",
    "used": """SELECT bucket_id, chunk_id, lo, hi FROM extents JOIN objects ON stream_id = object_id""",
}


def sql(body: str, *views: str) -> str:
    """``body`` behind the named views; a body that starts with further common tables says so by a leading comma."""
    heads = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
    body = body.strip()
    if body.startswith(","):
        return f"WITH {heads} {body}"
    return f"WITH {heads} {body}" if heads else body
