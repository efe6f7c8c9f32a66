"""Counters, gauges and latencies over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Latency buckets end at 1, 2, 4, ... 2^23 ms; whatever is longer falls into one last bucket.
LAST_BUCKET = 24


def counter_deltas(samples: DataFrame, counters: list[str], max_seconds: int) -> DataFrame:
    """Each sample's counter growth since its node's previous one, and the seconds between.

    No growth is told across a restart (another boot), a repeated or older sequence, a zero or too long
    interval, or where a counter went backwards.
    """
    by_node = Window.partitionBy("node").orderBy("received", "sequence")
    previous = {c: F.lag(c).over(by_node) for c in ["boot", "sequence", "uptime", *counters]}
    seconds = F.col("uptime") - previous["uptime"]
    growth = {c: F.col(c) - previous[c] for c in counters}
    valid = (F.col("boot") == previous["boot"]) & (F.col("sequence") > previous["sequence"]) & (seconds > 0) & (seconds <= max_seconds)
    for c in counters:
        valid = valid & (growth[c] >= 0)
    marked = samples.withColumns({f"d_{c}": g for c, g in growth.items()} | {"seconds": seconds, "valid": F.coalesce(valid, F.lit(False))})
    return marked.where("valid").drop("valid")


def cluster_rates(samples: DataFrame, now: Column, max_age: int, max_seconds: int) -> DataFrame:
    """One row: nodes reporting in time, the sum of their rates, and gauges that need every node."""
    counters = ["requests", "read_bytes", "hits", "lookups"]
    newest = Window.partitionBy("node").orderBy(F.desc("received"), F.desc("sequence"))
    latest = samples.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
    timely = latest.where((now - F.col("received") <= max_age) & (now >= F.col("received")))
    deltas = counter_deltas(samples, counters, max_seconds).select("node", "received", "sequence", "seconds", *[f"d_{c}" for c in counters])
    joined = timely.join(deltas, ["node", "received", "sequence"], "left")
    rate = lambda c: F.round(F.sum(F.col(f"d_{c}") / F.col("seconds")), 6)
    return joined.agg(
        F.count(F.lit(1)).alias("reported"),
        F.count("seconds").alias("rate_nodes"),
        rate("requests").alias("requests_per_second"),
        rate("read_bytes").alias("read_bytes_per_second"),
        F.round(F.least(F.lit(1.0), F.try_divide(F.sum("d_hits"), F.sum("d_lookups"))), 6).alias("hit_ratio"),
        F.sum("cache_bytes").alias("cache_bytes"),
        F.when(F.count("rss_bytes") == F.count(F.lit(1)), F.sum("rss_bytes")).alias("rss_bytes"),
        F.when(F.count("queue_waiting") == F.count(F.lit(1)), F.sum("queue_waiting")).alias("queue_waiting"),
    )


def latency_bucket(ms: Column) -> Column:
    """Index of the power-of-two bucket that a latency falls into."""
    return F.least(F.lit(LAST_BUCKET), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(ms, F.lit(1.0)))))).cast("int")


def latency_percentiles(rows: DataFrame, keys: list[str], ms: Column, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Upper bounds of percentiles from the histogram; null where the rank falls into the overflow bucket."""
    counts = rows.groupBy(*keys, latency_bucket(ms).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_n").over(Window.partitionBy(*keys))
    ranked = counts.withColumns({"_c": F.sum("_n").over(order), "_t": total})
    bound = lambda p: F.min(F.when(F.col("_c") >= F.ceil(F.col("_t") * p / 100), F.col("_b")))
    out = ranked.groupBy(*keys).agg(F.sum("_n").alias("n"), *[bound(p).alias(f"_p{p}") for p in percents])
    value = lambda p: F.when(F.col(f"_p{p}") < LAST_BUCKET, F.pow(F.lit(2), F.col(f"_p{p}")).cast("long"))
    return out.select(*keys, "n", *[value(p).alias(f"p{p}") for p in percents])


def hourly_windows(events: DataFrame, keys: list[str]) -> DataFrame:
    """Hourly counters; works on a batch or a stream."""
    hour = F.window("ts", "1 hour")
    return events.groupBy(*keys, hour).agg(F.count(F.lit(1)).alias("reads"), F.sum("bytes").alias("bytes")).select(*keys, F.col("window.start").alias("hour"), "reads", "bytes")


def coverage_gaps(samples: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Stretches of more than ``limit`` seconds without a sample."""
    before = F.lag("ts").over(Window.partitionBy(*keys).orderBy("ts", "event_id"))
    length = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return samples.select(*keys, before.alias("gap_from"), F.col("ts").alias("gap_to"), length.alias("micros")).where(F.col("micros") > limit * 1_000_000)


def accumulate(table: DataFrame, batch: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Additive upsert: the batch's counters added to the table's."""
    both = table.select(*keys, *sums).unionByName(batch.select(*keys, *sums))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
