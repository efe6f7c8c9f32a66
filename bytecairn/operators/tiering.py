"""Which physical units may move to cold storage, and what tiers hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidates(references: DataFrame, now: int, coverage_since: int, flushed: int, stale: int, units: DataFrame | None = None, most: int = 1024) -> DataFrame:
    """One reason per physical unit, the first that applies in a fixed order; ``eligible`` if none does.

    ``units`` (physical) names units beyond those referred to. A unit without a reference, or with more than ``most``, is ``references_unconfirmed``.

    ``references`` has physical, stored_bytes, visible, ready, created, observed, last_read, state, cold_storage,
    cool_after, residency; a unit's strictest reference counts. A reference without policy (null cold_storage)
    is incompatible.
    """
    incompatible = F.col("cold_storage").isNull() | (F.coalesce("state", F.lit("")) != "active")
    unit = references.groupBy("physical").agg(
        F.max("stored_bytes").alias("stored_bytes"),
        F.max("last_read").alias("last_read"),
        F.max("created").alias("age"),
        F.greatest(F.max("observed"), F.lit(coverage_since)).alias("observed"),
        F.min("observed").alias("_first"),
        F.bool_or(~F.col("ready") | ~F.col("visible")).alias("_busy"),
        (F.bool_or(incompatible) | (F.min("cold_storage") != F.max("cold_storage"))).alias("_shared"),
        F.coalesce(F.max("cool_after"), F.lit(0)).alias("_cool"),
        F.coalesce(F.max("residency"), F.lit(0)).alias("_dwell"),
        F.count(F.lit(1)).alias("_n"),
    )
    if units is not None:
        unit = units.select("physical").distinct().join(unit, "physical", "left")
    no_clock = coverage_since <= 0 or now - flushed > stale or flushed > now
    gap = F.lit(no_clock) | (F.col("_first") <= 0) | (now - F.col("observed") < F.col("_cool"))
    reason = (
        F.when(F.col("_n").isNull() | (F.col("_n") > most), "references_unconfirmed")
        .when(F.col("_busy"), "source_busy")
        .when(F.coalesce("_shared", F.lit(True)), "shared_policy")
        .when(gap, "observation_gap")
        .when(now - F.col("age") < F.greatest("_dwell", "_cool"), "minimum_residency")
        .when(F.col("last_read").isNotNull() & (now - F.col("last_read") < F.col("_cool")), "recent_read")
        .otherwise("eligible")
    )
    return unit.select("physical", F.coalesce("stored_bytes", F.lit(0)).alias("stored_bytes"), reason.alias("reason"))


def heat(units: DataFrame, unit_reads: DataFrame, member_reads: DataFrame) -> DataFrame:
    """Newest read of a unit or any of its members."""
    own = unit_reads.groupBy("physical").agg(F.max("at_seconds").alias("_own"))
    inner = member_reads.groupBy("physical").agg(F.max("at_seconds").alias("_inner"))
    return units.join(own, "physical", "left").join(inner, "physical", "left").withColumn("last_read", F.greatest("_own", "_inner")).drop("_own", "_inner")


def placement_usage(copies: DataFrame) -> DataFrame:
    """Bytes by what a copy is: hot, cold, a duplicate of one in the other tier, or retiring."""
    tiers = copies.where("NOT retiring").groupBy("physical").agg(F.bool_or(F.col("tier") == "hot").alias("_hot"), F.bool_or(F.col("tier") == "cold").alias("_cold"))
    joined = copies.join(tiers, "physical", "left")
    role: Column = F.when(F.col("retiring"), "retiring").when(F.col("_hot") & F.col("_cold") & (F.col("tier") == "cold"), "duplicate").otherwise(F.col("tier"))
    return joined.groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("copies"), F.sum("bytes").alias("bytes"))


def promotion_pressure(reads: DataFrame, window_seconds: int, threshold: int) -> DataFrame:
    """Per unit, the windows with at least ``threshold`` reads. A window begins at the first read after the one before has expired.

    Reads of one second are counted first; a unit's seconds are then walked in order, so what is gathered of it is bounded by the time told of.
    """
    seconds = reads.groupBy("physical", "at_seconds").agg(F.count(F.lit(1)).alias("n"))
    walked = seconds.groupBy("physical").agg(F.array_sort(F.collect_list(F.struct("at_seconds", "n"))).alias("s"))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(None).cast("long").alias("since"), zero.alias("n"), zero.alias("hot"), zero.alias("most"))
    state = lambda since, n, hot, most: F.struct(since.alias("since"), n.alias("n"), hot.alias("hot"), most.alias("most"))
    warm = lambda a: a["n"] >= threshold
    hot, most = lambda a: a["hot"] + F.when(warm(a), 1).otherwise(0), lambda a: F.when(warm(a), F.greatest(a["most"], a["n"])).otherwise(a["most"])
    goes_on = lambda a, x: F.coalesce(x["at_seconds"] < a["since"] + window_seconds, F.lit(False))
    step = lambda a, x: F.when(goes_on(a, x), state(a["since"], a["n"] + x["n"], a["hot"], a["most"])).otherwise(state(x["at_seconds"], x["n"], hot(a), most(a)))
    done = F.aggregate("s", start, step, lambda a: F.struct(hot(a).alias("hot_windows"), most(a).alias("most")))
    return walked.select("physical", done.alias("_d")).select("physical", "_d.*").where("hot_windows > 0")
