"""Interval algebra over half-open [lo, hi): union, segments and coverage.

Every step is a window or an equi-join on the chunk, so work partitions by chunk. Distinct intervals are
reduced to islands before anything is joined, and the containment join only meets islands of one chunk.

What a task holds does not grow with the table: ordered and grouped steps take ``parts``, the number of tasks that
``parts_for`` finds for the rows, and are dealt to as many; without it Spark's own number holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a task in an ordered step; sorts, windows and groups hold some 500 bytes for each.
TASK_ROWS = 1 << 19


def parts_for(rows: DataFrame) -> int:
    """Tasks for the whole of ``rows``, which is counted (a Parquet table by its footers), but no fewer than cores."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` in ``parts`` partitions, which Spark does not put together again; without a number, as it sees fit."""
    return rows.repartition(parts, *keys) if parts else rows.repartition(*keys)


def merge_intervals(rows: DataFrame, keys: list[str], ways: int = 1, parts: int | None = None) -> DataFrame:
    """Islands: the union of each key's intervals. Touching intervals merge; empty ones are dropped.

    The running maximum, not the previous end, keeps nested intervals in one island. Union is associative:
    with several ``ways`` every key is first merged in as many parts by a salt, and then the parts' islands, so that a key
    with a large share of all rows is spread over tasks and only its islands meet.
    """
    if ways > 1:
        salted = rows.withColumn("_way", F.pmod(F.xxhash64("lo", "hi"), F.lit(ways)))
        return merge_intervals(merge_intervals(salted, [*keys, "_way"], parts=parts), keys, parts=parts)
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0)
    # of intervals that begin alike the longest says all; repeats meet as groups, before any is sorted
    longest = dealt(rows.where("lo < hi").select(*keys, "lo", "hi"), parts, *keys, "lo").groupBy(*keys, "lo").agg(F.max("hi").alias("hi"))
    flagged = dealt(longest, parts, *keys).withColumn("_open", opens)
    island = F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def boundary_segments(islands: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Elementary segments between neighbouring island ends of one key; ``parts`` is that of the islands, which have two ends."""
    ends = islands.select(key, F.explode(F.array("lo", "hi")).alias("point"))
    points = _points(ends, key, parts)
    nxt = F.lead("point").over(Window.partitionBy(key).orderBy("point"))
    return points.select(key, F.col("point").alias("lo"), nxt.alias("hi")).where(F.col("hi").isNotNull())


def _points(ends: DataFrame, key: str, parts: int | None) -> DataFrame:
    """Each (key, point) once, dealt by key: equal ones meet first, so that a key's distinct points alone are in one task."""
    parts = 2 * parts if parts else None
    return dealt(dealt(ends, parts, key, "point").distinct(), parts, key)


def coverage(islands: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Islands' owners by the segments inside them."""
    inner = segments.select(key, F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"))
    joined = islands.join(inner, key).where((F.col("lo") <= F.col("s_lo")) & (F.col("s_hi") <= F.col("hi")))
    return joined.drop("lo", "hi").withColumnsRenamed({"s_lo": "lo", "s_hi": "hi"})


def covered_counts(islands: DataFrame, key: str, owner: str, parts: int | None = None) -> DataFrame:
    """By (owner, key): how many segments, and bytes, ``coverage`` finds in the owner's islands, from the ranks of their ends alone."""
    ends = F.array(F.struct(F.col("lo").alias("point"), F.lit(-1).alias("turn")), F.struct(F.col("hi").alias("point"), F.lit(1).alias("turn")))
    rows = islands.select(owner, key, F.inline(ends))
    ranks = _points(rows.select(key, "point"), key, parts).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("point")))
    ranked = dealt(rows.join(ranks, [key, "point"]), 2 * parts if parts else None, owner, key)
    return ranked.groupBy(owner, key).agg(F.sum(F.col("turn") * F.col("rank")).alias("segments"), F.sum(F.col("turn") * F.col("point")).alias("bytes"))
