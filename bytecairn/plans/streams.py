"""Streaming queries, which equal their batch forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bytecairn.plans.history import GENERATIONS
from bytecairn.plans.storage import HOURLY
from bytecairn.sources.model import sql
from bytecairn.streaming import jobs


def _events(spark, d):
    """The events table, a folder of files or a single one, as a stream of files."""
    rows = spark.read.parquet(f"{d}/events.parquet")
    single = all(f.endswith("/events.parquet") for f in rows.inputFiles())
    files = spark.readStream.schema(rows.schema)
    return files.option("pathGlobFilter", "events.parquet").parquet(d) if single else files.parquet(f"{d}/events.parquet")


def _newest(keys, order):
    def pick(rows):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
        return rows.withColumn("_r", rank).where("_r = 1").drop("_r", "_batch")

    return pick


def stream_hourly(spark, d):
    out = jobs.drain(spark, jobs.hourly_access(_events(spark, d)), ["event_type", "hour"], _newest(["event_type", "hour"], "_batch"), "update")
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def stream_replay(spark, d):
    """The journal's catalogue from a stream in which changes come in any order, equal to the batch form."""
    e = _events(spark, d)
    small = F.col("user_id") < 20
    op = F.when((F.col("event_type") == "signup") & small, "start").when((F.col("event_type") == "purchase") & small, "ready").when(F.col("event_type") == "error", "delete").otherwise("put")
    # generations are not on the events: they are told by the few that open one, which are read once as a table
    opens = spark.read.parquet(f"{d}/events.parquet").where((F.col("event_type") == "signup") & small)
    counted = opens.select((F.col("user_id") % 5).alias("_b"), F.col("event_id").alias("_from")).withColumn("_g", F.row_number().over(Window.partitionBy("_b").orderBy("_from")).cast("long"))
    spans = counted.withColumn("_until", F.lead("_from").over(Window.partitionBy("_b").orderBy("_from")))
    rows = e.select((F.col("user_id") % 5).alias("bucket"), F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.floor(F.col("value") * 100).cast("long").alias("size"))
    inside = (F.col("bucket") == F.col("_b")) & (F.col("seq") >= F.col("_from")) & (F.col("_until").isNull() | (F.col("seq") < F.col("_until")))
    changes = rows.join(spans, inside, "left").select("bucket", "key", "seq", "op", "size", F.coalesce("_g", F.lit(0).cast("long")).alias("generation"))
    keys = ["bucket", "generation", "key", "op"]
    slots = jobs.drain(spark, jobs.replay(changes), keys, lambda r: r.drop("_batch"), "update")
    return jobs.replayed(slots).select("bucket", "key", "seq", "size")


def stream_rates(spark, d):
    """Growth of a node's counters, summed; a user's events stand for its samples."""
    e = _events(spark, d).select(
        F.col("user_id").alias("node"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1).cast("long").alias("boot"), F.col("event_id").alias("sequence"), (F.col("event_id") * 10).alias("uptime"), (F.col("event_id") * 3).alias("requests"), F.floor(F.col("event_id") / 7).cast("long").alias("hits")
    )
    out = jobs.drain(spark, jobs.counter_rates(e, ["requests", "hits"], 50_000, "40 days"), [], lambda r: r.drop("_batch"), "append")
    return out.where("kind = 'rate'").groupBy("node").agg(F.count(F.lit(1)).alias("rated"), F.sum("d_requests").alias("requests"), F.sum("d_hits").alias("hits"), F.sum("seconds").alias("seconds"))


QUERIES = {
    "stream_hourly": (stream_hourly, HOURLY),
    "stream_replay": (stream_replay, sql(GENERATIONS + " SELECT bucket, key, seq, size FROM kept WHERE rn = 1 AND op = 'put'", "changes")),
    "stream_rates": (
        stream_rates,
        "WITH s AS (SELECT user_id AS node, event_id AS q, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), g AS (SELECT *, (q - p) * 10 AS sec FROM s WHERE q > p AND (q - p) * 10 <= 50000) SELECT node, count(*) AS rated, CAST(sum((q - p) * 3) AS BIGINT) AS requests, CAST(sum(q // 7 - p // 7) AS BIGINT) AS hits, CAST(sum(sec) AS BIGINT) AS seconds FROM g GROUP BY node",
    ),
}
