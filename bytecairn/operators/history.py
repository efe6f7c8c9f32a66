"""Versions, point-in-time states, restore plans and change-log replay over (key, seq, op) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(changes: DataFrame, keys: list[str], cut: Column | None = None) -> DataFrame:
    """Each key's last change at or before the cut, deletions included."""
    rows = changes if cut is None else changes.where(F.col("seq") <= cut)
    rest = [c for c in changes.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_last")).select(*keys, "_last.*")


def live(changes: DataFrame, keys: list[str], cut: Column | None = None) -> DataFrame:
    return as_of(changes, keys, cut).where("op = 'put'")


def with_latest_flag(changes: DataFrame, keys: list[str]) -> DataFrame:
    return changes.withColumn("latest", F.col("seq") == F.max("seq").over(Window.partitionBy(*keys)))


def restore_plan(source: DataFrame, current: DataFrame, keys: list[str], missing: Column, in_place: bool) -> DataFrame:
    """What a restore does with every key: missing, remove, add, replace or skip; nothing where neither side has it.

    ``source`` and ``current`` hold live keys with ``seq``; ``missing`` tells of a source row whose payload is gone.
    """
    s = source.withColumn("_missing", missing).select(*keys, F.col("seq").alias("source_seq"), "_missing")
    c = current.select(*keys, F.col("seq").alias("current_seq"))
    both = s.join(c, keys, "full_outer")
    has, had = F.col("source_seq").isNotNull(), F.col("current_seq").isNotNull()
    state = F.when(has & F.col("_missing"), "missing")
    state = state.when(~has & had, F.lit("remove") if in_place else F.lit(None))
    state = state.when(has & ~had, "add")
    if in_place:
        state = state.when(F.col("source_seq") != F.col("current_seq"), "replace")
    state = state.when(has & had, "skip")
    return both.select(*keys, "source_seq", "current_seq", state.alias("state")).where(F.col("state").isNotNull())


def replay(changes: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Final catalogue of a log with generations: ``start`` opens one, ``ready`` makes it the only one, ``drop`` ends the bucket.

    A batch form of sequential replay: the last ready generation of a bucket and the last change of each key in it. After a drop
    generations begin anew, so what lies before it does not count.
    """
    of_bucket = changes.groupBy(bucket).agg(
        F.max(F.when(F.col("op") == "ready", F.struct("seq", "generation"))).alias("_ready"), F.max(F.when(F.col("op") == "drop", F.col("seq"))).alias("_drop")
    )
    kept = changes.where(F.col("op").isin("put", "delete")).join(of_bucket, bucket)
    alive = (F.col("_ready").isNotNull()) & (F.col("generation") == F.col("_ready.generation")) & (F.col("_drop").isNull() | ((F.col("_drop") < F.col("_ready.seq")) & (F.col("_drop") < F.col("seq"))))
    return live(kept.where(alive).drop("_ready", "_drop"), [bucket, "key"])


def sequence_gaps(changes: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Places in each bucket's log where the next sequence number does not follow the one before."""
    before = F.lag("seq").over(Window.partitionBy(bucket).orderBy("seq"))
    return changes.select(bucket, "seq", before.alias("before")).where("before IS NOT NULL AND seq <> before + 1")


def mint_sequences(rows: DataFrame, bucket: str, order: list[str], last: Column) -> DataFrame:
    """Gap-free numbers behind each bucket's last one."""
    return rows.withColumn("seq", last + F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))


def outside_gaps(points: DataFrame, gaps: DataFrame, at: str) -> DataFrame:
    """Points not strictly inside any gap of their bucket; ends of a gap are outside it."""
    return points.join(gaps, (points["bucket"] == gaps["gap_bucket"]) & (points[at] > gaps["gap_from"]) & (points[at] < gaps["gap_to"]), "left_anti")


CONTROL = ["start", "ready", "drop", "pause", "resume"]


def replay_violations(changes: DataFrame, bucket: str = "bucket") -> DataFrame:
    """The first change of each bucket that a strict reader of the journal refuses: bucket, failed_at, reason.

    A bucket's numbers run 1, 2, 3, ... without gap or repeat. ``start`` opens the generation behind the newest one (behind none after a
    drop); every other change belongs to the newest generation, and ``ready`` comes once in it. Only the control changes,
    which are few, are put in order; predecessors are found by a join on (bucket, number).
    """
    numbers = changes.groupBy(bucket, "seq").agg(F.count(F.lit(1)).alias("_n"))
    before = numbers.select(F.col(bucket).alias("_b"), (F.col("seq") + 1).alias("_after"))
    gap = numbers.where("seq <> 1").join(before, (F.col(bucket) == F.col("_b")) & (F.col("seq") == F.col("_after")), "left_anti").select(bucket, "seq")
    order = gap.unionByName(numbers.where("_n > 1").select(bucket, "seq")).select(bucket, "seq", F.lit(0).alias("_rank"), F.lit("sequence").alias("reason"))
    past = Window.partitionBy(bucket).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("op").isin("start", "drop"), F.struct("seq", F.when(F.col("op") == "start", F.col("generation")).otherwise(0).alias("generation"))), ignorenulls=True).over(past)
    control = changes.where(F.col("op").isin(CONTROL)).select(bucket, "seq", "op", "generation").withColumns({"_open": opened, "_ready": F.last(F.when(F.col("op") == "ready", F.col("seq")), ignorenulls=True).over(past)})
    newest = F.coalesce("_open.generation", F.lit(0))
    wrong = (
        F.when((F.col("op") == "start") & (F.col("generation") != newest + 1), "generation")
        .when((F.col("op") != "start") & (newest == 0), "baseline")
        .when((F.col("op") != "start") & (F.col("generation") != newest), "identity")
        .when((F.col("op") == "ready") & (F.col("_ready") > F.col("_open.seq")), "published")
    )
    of_control = control.select(bucket, "seq", F.lit(1).alias("_rank"), wrong.alias("reason")).where("reason IS NOT NULL")
    # puts and deletes meet the generation that was open at their number
    until = F.lead("seq").over(Window.partitionBy(bucket).orderBy("seq"))
    spans = control.where("op IN ('start', 'drop')").select(F.col(bucket).alias("_b"), F.col("seq").alias("_from"), until.alias("_until"), F.when(F.col("op") == "start", F.col("generation")).alias("_generation"))
    rows = changes.where(~F.col("op").isin(CONTROL))
    met = rows.join(spans, (F.col(bucket) == F.col("_b")) & (F.col("seq") > F.col("_from")) & (F.col("_until").isNull() | (F.col("seq") < F.col("_until"))), "left")
    lost = F.when(F.col("_generation").isNull(), "baseline").when(F.col("generation") != F.col("_generation"), "identity")
    of_rows = met.select(bucket, "seq", F.lit(1).alias("_rank"), lost.alias("reason")).where("reason IS NOT NULL")
    every = order.unionByName(of_control).unionByName(of_rows)
    return every.groupBy(bucket).agg(F.min(F.struct("seq", "_rank", "reason")).alias("_v")).select(bucket, F.col("_v.seq").alias("failed_at"), F.col("_v.reason").alias("reason"))


def replay_strict(changes: DataFrame, bucket: str = "bucket") -> tuple[DataFrame, DataFrame]:
    """What ``replay`` gives of each bucket's changes before the first one that is refused, and per bucket that change (null where none is) and whether it is paused."""
    refused = replay_violations(changes, bucket)
    valid = changes.join(refused.select(F.col(bucket).alias("_b"), "failed_at"), F.col(bucket) == F.col("_b"), "left").where("failed_at IS NULL OR seq < failed_at").drop("_b", "failed_at")
    # a new generation is not paused
    switch = F.max(F.when(F.col("op").isin("start", "pause", "resume", "drop"), F.struct("seq", "op")))
    state = valid.groupBy(bucket).agg((F.coalesce(switch["op"], F.lit("")) == "pause").alias("paused"))
    buckets = changes.select(bucket).distinct().join(refused, bucket, "left").join(state, bucket, "left")
    return replay(valid, bucket), buckets.select(bucket, "failed_at", "reason", F.coalesce("paused", F.lit(False)).alias("paused"))
