"""Garbage copies, quotas with reservations, reserved media, and image sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytecairn.functions import image
from bytecairn.operators import lifecycle as lc
from bytecairn.sources import model as m
from bytecairn.sources.model import sql, table

#: The instant asked about, in seconds, and a day.
NOW = 952_000_000
DAY = 86_400


def _day(col):
    return F.floor(F.unix_micros(col.cast("timestamp")) / 1_000_000).cast("long")


def _copies(spark, d):
    li = table(spark, d, "lineitem")
    state = F.when(F.col("l_returnflag") == "R", "retired").when(F.col("l_returnflag") == "A", "deleting").when(F.col("l_linenumber") == 7, "deleted").otherwise("ready")
    shipped = _day(F.col("l_shipdate"))
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("address"), (F.col("l_suppkey") % 10).alias("storage"), state.alias("state"), F.when(F.col("l_quantity") == 1, F.col("l_orderkey")).alias("owner"), shipped.alias("unreferenced"),
        F.when(F.col("l_linenumber") % 3 > 0, shipped - 200 * DAY).alias("stored"), F.when(F.col("l_linenumber") == 5, shipped + 30 * DAY).alias("activated"), (F.col("l_quantity") > 49).alias("recovering"),
    )


def garbage_copies(spark, d):
    """Copies past their grace and least time of storage, by storage."""
    kept = table(spark, d, "part").where("p_size <= 5").select(F.col("p_partkey").alias("address"))
    rows = lc.garbage_copies(_copies(spark, d), kept, NOW, 90 * DAY, 365 * DAY)
    return rows.groupBy("storage", "state").agg(F.count(F.lit(1)).alias("copies"), F.min("unreferenced").alias("oldest"), F.count_if("age_unknown").alias("unknown"))


def quota_effective(spark, d):
    """Buckets and projects: what is used and what is in flight (open objects), against their limits."""
    o, b = m.objects(spark, d), m.buckets(spark, d)
    flight = F.col("state") == "O"
    sums = o.groupBy("bucket_id").agg(F.coalesce(F.sum(F.when(~flight, F.col("size"))), F.lit(0)).alias("used"), F.coalesce(F.sum(F.when(flight, F.col("size"))), F.lit(0)).alias("reserved"))
    by_bucket = b.select("bucket_id", "project_id", "used_limit").join(sums, "bucket_id")
    limits = table(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.when(F.col("n_nationkey") % 5 != 4, F.col("n_nationkey") * 5_000_000).cast("long").alias("used_limit"))
    projects = by_bucket.groupBy("project_id").agg(F.sum("used").alias("used"), F.sum("reserved").alias("reserved")).join(limits, "project_id")
    scopes = by_bucket.select(F.lit("bucket").alias("scope"), F.col("bucket_id").cast("long").alias("scope_id"), "used", "reserved", "used_limit").unionAll(projects.select(F.lit("project"), F.col("project_id").cast("long"), "used", "reserved", "used_limit"))
    return lc.quota_state(scopes)


def reserved_by_medium(spark, d):
    """Bytes that writes have set aside on each medium and that its accounting has not taken over."""
    li = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("medium"), F.floor("l_extendedprice").cast("long").alias("bytes"), (F.col("l_linestatus") == "F").alias("complete"), F.when(F.col("l_linenumber") < 6, F.col("l_suppkey") % 3).alias("boot"), F.col("l_orderkey").alias("revision"),
        F.lit(1).alias("seen_boot"), F.lit(3000).alias("seen_revision"),
    )
    return lc.reserved_by(li, "medium")


#: The limits of the styles.
LIMITS = ["150i", "150p", "300i", "300p", "300x", "500i", "500x", "600p", "1000i", "1000x", "1200p"]


def image_sizes(spark, d):
    """Dimensions of every image (a part of some width and height) under every style."""
    images = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 60).alias("width"), (F.col("p_partkey") % 40 * 50 + 50).cast("int").alias("height"))
    styles = F.explode(F.array(*[F.lit(f"q80.{x}.webp") for x in LIMITS], F.lit("webp"))).alias("style")
    rows = images.select("*", styles).withColumn("to", image.fitted(F.col("width"), F.col("height"), F.col("style")))
    return rows.select("p_partkey", "style", F.col("to.width").alias("width"), F.col("to.height").alias("height"))


_SHIPPED = "CAST(floor(epoch_us(l_shipdate) / 1000000) AS BIGINT)"
QUERIES = {
    "garbage_copies": (
        garbage_copies,
        f"""WITH c AS (SELECT l_partkey AS address, l_suppkey % 10 AS storage, CASE WHEN l_returnflag = 'R' THEN 'retired' WHEN l_returnflag = 'A' THEN 'deleting' WHEN l_linenumber = 7 THEN 'deleted' ELSE 'ready' END AS state, l_quantity = 1 AS owned, {_SHIPPED} AS unreferenced,
CASE WHEN l_linenumber % 3 > 0 THEN {_SHIPPED} - {200 * DAY} END AS stored, CASE WHEN l_linenumber = 5 THEN {_SHIPPED} + {30 * DAY} END AS activated, l_quantity > 49 AS recovering FROM lineitem)
SELECT storage, state, count(*) AS copies, min(unreferenced) AS oldest, count(*) FILTER (WHERE stored IS NULL OR recovering) AS unknown FROM c WHERE (state IN ('retired', 'deleting') OR (state = 'deleted' AND recovering)) AND NOT owned AND unreferenced < {NOW - 90 * DAY}
AND (stored IS NULL OR stored <= {NOW - 365 * DAY}) AND (activated IS NULL OR activated <= {NOW - 365 * DAY}) AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = address AND p_size <= 5) GROUP BY storage, state""",
    ),
    "quota_effective": (
        quota_effective,
        sql(
            """, s AS (SELECT bucket_id, project_id, used_limit, CAST(coalesce(sum(size) FILTER (WHERE state <> 'O'), 0) AS BIGINT) AS used, CAST(coalesce(sum(size) FILTER (WHERE state = 'O'), 0) AS BIGINT) AS reserved FROM objects JOIN buckets USING (bucket_id) GROUP BY ALL),
a AS (SELECT 'bucket' AS scope, CAST(bucket_id AS BIGINT) AS scope_id, used, reserved, used_limit FROM s UNION ALL SELECT 'project', CAST(project_id AS BIGINT), CAST(sum(used) AS BIGINT), CAST(sum(reserved) AS BIGINT), CASE WHEN project_id % 5 <> 4 THEN CAST(project_id AS BIGINT) * 5000000 END FROM s GROUP BY project_id)
SELECT *, used_limit - used - reserved AS "left", used_limit IS NULL OR used + reserved <= used_limit AS allowed FROM a""",
            "objects",
            "buckets",
        ),
    ),
    "reserved_by_medium": (
        reserved_by_medium,
        "SELECT l_suppkey % 10 AS medium, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS bytes, count(*) AS reservations FROM lineitem WHERE NOT (l_linestatus = 'F' AND l_linenumber < 6 AND (l_suppkey % 3 <> 1 OR l_orderkey <= 3000)) GROUP BY 1",
    ),
    "image_sizes": (
        image_sizes,
        "WITH i AS (SELECT p_partkey, p_size * 60 AS w, CAST(p_partkey % 40 * 50 + 50 AS INTEGER) AS h FROM part), s AS (SELECT unnest(["
        + ", ".join(f"{{'n': 'q80.{x}.webp', 'm': {x[:-1]}, 'a': '{x[-1]}'}}" for x in LIMITS)
        + ", {'n': 'webp', 'm': 999999, 'a': 'x'}]) AS s), f AS (SELECT p_partkey, s.n AS style, w, h, least(1.0, CASE WHEN s.a <> 'i' THEN s.m / CAST(w AS DOUBLE) ELSE 1 END, CASE WHEN s.a <> 'p' THEN s.m / CAST(h AS DOUBLE) ELSE 1 END) AS k FROM i, s) SELECT p_partkey, style, CAST(greatest(1, round(w * k)) AS INTEGER) AS width, CAST(greatest(1, round(h * k)) AS INTEGER) AS height FROM f",
    ),
}
