"""Byte attribution: fair shares by prefix sums, usage by bucket, project and whole, and the physical bridge.

A segment of a chunk that several projects use costs each the same, and within a project each bucket that uses it
the same. Its bytes over projects over buckets are integrated along the chunk once; the share of an island is the difference of that integral
at its ends. So an island costs two rows, however many segments it spans: there is no join of islands and segments. What is
ordered in one task are a chunk's distinct (project, point) pairs, not its islands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytecairn.operators.intervals import dealt


def _ends(islands: DataFrame, *keys: str) -> DataFrame:
    """Two rows an island: its ends, +1 where it begins and -1 where it ends."""
    ends = F.array(F.struct(F.col("lo").alias("point"), F.lit(1).alias("turn")), F.struct(F.col("hi").alias("point"), F.lit(-1).alias("turn")))
    return islands.select(*keys, F.inline(ends))


def integrals(islands: DataFrame, key: str, group: str, parts: int | None = None) -> DataFrame:
    """By (key, group, point): ``whole``, the integral up to the point of one over the groups that cover it; ``own``, the same divided by the
    group's owners, where it has any; ``covered``, the group's bytes up to the point, and ``union``, those of all groups. ``parts``: ``parts_for`` the islands."""
    parts = 2 * parts if parts else None  # an island has two ends
    points = dealt(_ends(islands, key, group), parts, key, group, "point").groupBy(key, group, "point").agg(F.sum("turn").alias("turn"))
    # all that follows is ordered by key, and is dealt by it once
    points = dealt(points, parts, key)
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    within, along = Window.partitionBy(key, group).orderBy("point"), Window.partitionBy(key).orderBy("point", group)
    counted = points.withColumn("owners", F.sum("turn").over(until(within)))
    opens = F.when((F.col("owners") > 0) & (F.col("owners") == F.col("turn")), 1).when((F.col("owners") == 0) & (F.col("turn") < 0), -1).otherwise(0)
    # rows of one point lie at no distance from each other, so only the last of them, which has counted all, weighs
    stepped = counted.withColumn("opens", opens).withColumn("groups", F.sum("opens").over(until(along)))
    length = F.coalesce(F.lead("point").over(along) - F.col("point"), F.lit(0))
    pieces = stepped.withColumn("piece", F.when(F.col("groups") > 0, length / F.col("groups")).otherwise(0.0)).withColumn("span", F.when(F.col("groups") > 0, length).otherwise(0))
    summed = pieces.withColumn("whole", F.coalesce(F.sum("piece").over(before(along)), F.lit(0.0))).withColumn("union", F.coalesce(F.sum("span").over(before(along)), F.lit(0)))
    used = F.col("owners") > 0
    share = F.when(used, (F.lead("whole").over(within) - F.col("whole")) / F.col("owners")).otherwise(0.0)
    bytes_ = F.when(used, F.lead("point").over(within) - F.col("point")).otherwise(0)
    parts = summed.withColumn("share", share).withColumn("bytes", bytes_)
    return parts.select(
        key, group, "point", "whole", "union", F.coalesce(F.sum("share").over(before(within)), F.lit(0.0)).alias("own"), F.coalesce(F.sum("bytes").over(before(within)), F.lit(0)).alias("covered")
    )


def shares(islands: DataFrame, integral: DataFrame, key: str, group: str, owner: str, parts: int | None = None) -> DataFrame:
    """By (owner, group, key): ``unique_bytes`` of the owner's islands and the ``share`` of them that it accounts for; ``covered`` and ``union`` as far as they reach."""
    ends = _ends(islands, owner, key, group).join(integral.select(key, group, "point", "own", "covered", "union"), [key, group, "point"])
    # the join's sorts and the groups are in tasks of their own
    return dealt(ends, 2 * parts if parts else None, owner, group, key).groupBy(owner, group, key).agg(
        F.sum(-F.col("turn") * F.col("point")).alias("unique_bytes"), F.sum(-F.col("turn") * F.col("own")).alias("share"), F.max("covered").alias("covered"), F.max("union").alias("union")
    )


def scope_rows(bucket_shares: DataFrame, key: str, group: str, owner: str) -> DataFrame:
    """``shares`` at every scope (scope, scope_id, key, unique_bytes, share): a bucket's, a project's and the whole, whose uniques are unions.

    Somebody's island ends where a project's cover, and the whole's, ends, so the furthest that any of them reaches is all of it.
    """
    sets = bucket_shares.groupingSets([[key, group, owner], [key, group], [key]], key, group, owner).agg(
        F.sum("unique_bytes").alias("_own"), F.sum("share").alias("share"), F.max("covered").alias("_covered"), F.max("union").alias("_union"), F.grouping_id(key, group, owner).alias("_set")
    )
    bucket, project = F.col("_set") == 0, F.col("_set") == 1
    scope_id = F.when(bucket, F.col(owner).cast("string")).when(project, F.col(group).cast("string"))
    unique = F.when(bucket, F.col("_own")).when(project, F.col("_covered")).otherwise(F.col("_union"))
    return sets.select(F.when(bucket, "bucket").when(project, "project").otherwise("global").alias("scope"), scope_id.alias("scope_id"), key, unique.alias("unique_bytes"), "share")


def encoded_rates(bucket_shares: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """By chunk in use: source_type, source and ``rate``, the stored bytes of its source by raw byte; null where none holds it yet.

    ``chunks`` has chunk_id, source_type, source and stored (each source's stored bytes being the sum over its chunks).
    """
    used = bucket_shares.groupBy(key).agg(F.max("union").alias("bytes"))
    sourced = chunks.join(used, key, "left")
    rate = sourced.where(F.col("source").isNotNull()).groupBy("source_type", "source").agg((F.sum("stored") / F.sum("bytes")).alias("rate"))
    return sourced.where(F.col("bytes").isNotNull()).select(key, "source_type", "source").join(rate, ["source_type", "source"], "left")


def raw_shares(references: DataFrame) -> DataFrame:
    """``references`` (bucket_id, project_id, source_id, size; distinct) with ``attributed``: the size over the source's projects, then over the project's buckets."""
    within = Window.partitionBy("source_id", "project_id")
    lead = F.when(F.row_number().over(within.orderBy("bucket_id")) == 1, 1)
    marked = references.withColumns({"_buckets": F.count(F.lit(1)).over(within), "_lead": lead})
    return marked.withColumn("attributed", F.col("size") / F.count("_lead").over(Window.partitionBy("source_id")) / F.col("_buckets")).drop("_buckets", "_lead")


def raw_scopes(raw: DataFrame) -> DataFrame:
    """By scope: bytes of the raw sources it uses, each once, and what it accounts for of them."""
    scopes = F.array(
        F.struct(F.lit("bucket").alias("scope"), F.col("bucket_id").cast("string").alias("scope_id")), F.struct(F.lit("project").alias("scope"), F.col("project_id").cast("string").alias("scope_id")), F.struct(F.lit("global").alias("scope"), F.lit(None).cast("string").alias("scope_id"))
    )
    each = raw.select("source_id", "size", "attributed", F.inline(scopes)).groupBy("scope", "scope_id", "source_id").agg(F.max("size").alias("size"), F.sum("attributed").alias("attributed"))
    return each.groupBy("scope", "scope_id").agg(F.sum("size").alias("raw_unique"), F.sum("attributed").alias("raw_share"))


def logical_scopes(buckets: DataFrame, quotas: DataFrame) -> DataFrame:
    """By scope: buckets, objects and logical bytes; ``quotas`` has bucket_id, used_bytes, object_count."""
    joined = buckets.select("bucket_id", "project_id").join(quotas, "bucket_id", "left")
    sets = joined.groupingSets([["bucket_id"], ["project_id"], []], "bucket_id", "project_id").agg(
        F.count(F.lit(1)).alias("buckets"), F.coalesce(F.sum("object_count"), F.lit(0)).alias("objects"), F.coalesce(F.sum("used_bytes"), F.lit(0)).alias("logical_bytes"), F.grouping_id("bucket_id", "project_id").alias("_set")
    )
    scope = F.when(F.col("_set") == 1, "bucket").when(F.col("_set") == 2, "project").otherwise("global")
    return sets.select(scope.alias("scope"), F.coalesce("bucket_id", "project_id").cast("string").alias("scope_id"), "buckets", "objects", "logical_bytes")


def bridge(physical: DataFrame, selected: DataFrame, raw_inventory: DataFrame) -> DataFrame:
    """One row: bytes of everything stored, by what becomes of it.

    ``physical``: source_type, source, state, stored, garbage; ``selected``: source_type, source of what is in use;
    ``raw_inventory``: size, state, selected, garbage. Indexed bytes are selected, retained and garbage ones together; unconfirmed ones are beside them.
    """
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    in_use = selected.select("source_type", "source").distinct().withColumn("_used", F.lit(True))
    units = physical.join(in_use, ["source_type", "source"], "left").withColumn("_used", F.coalesce("_used", F.lit(False)))
    there = F.col("state").isin("ready", "retired", "deleting")
    of_units = units.agg(
        zero(F.when(there, F.col("stored"))).alias("u_indexed"), zero(F.when(F.col("_used"), F.col("stored"))).alias("u_selected"), zero(F.when(~F.col("_used") & there & ~F.col("garbage"), F.col("stored"))).alias("u_retained"), zero(F.when(~F.col("_used") & F.col("garbage"), F.col("stored"))).alias("u_gc"),
        zero(F.when(F.col("state").isin("preparing", "uploading"), F.col("stored"))).alias("u_unconfirmed"), F.count_if(there & (F.col("source_type") == "chunk")).alias("chunk_objects"), F.count_if(there & (F.col("source_type") == "pack")).alias("pack_objects"),
    )
    writing = F.col("state") == "writing"
    of_raw = raw_inventory.agg(
        zero(F.when(~writing, F.col("size"))).alias("r_indexed"), zero(F.when(F.col("selected"), F.col("size"))).alias("r_selected"), zero(F.when(~F.col("selected") & ~F.col("garbage") & ~writing, F.col("size"))).alias("r_retained"), zero(F.when(~F.col("selected") & F.col("garbage"), F.col("size"))).alias("r_gc"),
        zero(F.when(writing, F.col("size"))).alias("r_unconfirmed"), F.count(F.lit(1)).alias("raw_objects"),
    )
    both = of_units.crossJoin(of_raw)  # one row each
    total = lambda name: (F.col(f"u_{name}") + F.col(f"r_{name}")).alias(f"{name}_bytes")
    return both.select(*[total(name) for name in ("indexed", "selected", "retained", "gc", "unconfirmed")], "chunk_objects", "raw_objects", "pack_objects")


def raw_inventory(sources: DataFrame, ranges: DataFrame, streams: DataFrame) -> DataFrame:
    """``sources`` (source_id, size, state, owner_stream) with ``selected``: an object's stream refers to it; ``garbage``: none does and nobody owns it."""
    published = streams.select("stream_id").distinct().withColumn("_published", F.lit(True))
    by_source = ranges.select("source_id", "stream_id").distinct().join(published, "stream_id", "left").groupBy("source_id").agg(F.bool_or(F.coalesce("_published", F.lit(False))).alias("_selected"))
    joined = sources.join(by_source, "source_id", "left")
    return joined.select("source_id", "size", "state", F.coalesce("_selected", F.lit(False)).alias("selected"), (F.col("owner_stream").isNull() & F.col("_selected").isNull()).alias("garbage"))


def summary(logical: DataFrame, rows: DataFrame, rates: DataFrame, raw: DataFrame, whole: DataFrame, key: str = "chunk_id") -> DataFrame:
    """A row a scope, from ``logical_scopes``, ``scope_rows``, ``encoded_rates``, ``raw_scopes`` and ``bridge``.

    ``encoded_bytes`` and ``encoding_savings`` are null while any of the scope's bytes are pending. The bridge stands in the global row alone.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    # by source first, so that packs are counted without a distinct
    joined = rows.join(rates, key)
    by_source = joined.groupBy("scope", "scope_id", "source_type", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("unique_bytes").alias("unique_bytes"), F.sum("share").alias("share"), F.sum(F.col("share") * F.col("rate")).alias("encoded"), F.bool_and(F.col("rate").isNotNull()).alias("complete")
    )
    pack = F.col("source_type") == "pack"
    sums = by_source.groupBy("scope", "scope_id").agg(
        F.sum("n").alias("chunks"), F.count_if(pack).alias("packs"), F.sum("unique_bytes").alias("unique_bytes"), F.sum("share").alias("share"), F.sum("encoded").alias("encoded"), F.bool_and("complete").alias("complete"),
        F.sum(F.when(pack, F.col("unique_bytes")).otherwise(0)).alias("packed_bytes"), F.sum(F.when(~F.col("complete"), F.col("unique_bytes")).otherwise(0)).alias("pending_bytes"),
    )
    same = lambda other: logical["scope"].eqNullSafe(other["scope"]) & logical["scope_id"].eqNullSafe(other["scope_id"])
    all_ = logical.join(sums, same(sums), "left").drop(sums["scope"], sums["scope_id"]).join(raw, same(raw), "left").drop(raw["scope"], raw["scope_id"])
    unique = zero(F.col("unique_bytes")) + zero(F.col("raw_unique"))
    attributed, known = zero(F.col("share")) + zero(F.col("raw_share")), zero(F.col("encoded")) + zero(F.col("raw_share"))
    complete, r = F.coalesce("complete", F.lit(True)), lambda c: F.round(c, 6)
    scopes = all_.select(
        "scope", "scope_id", "buckets", "objects", "logical_bytes", unique.cast("long").alias("unique_bytes"), r(attributed).alias("attributed_raw_bytes"), F.when(complete, r(known)).alias("encoded_bytes"), r(known).alias("encoded_known_bytes"),
        (F.col("logical_bytes") - unique).cast("long").alias("local_savings"), r(unique - attributed).alias("shared_savings"), F.when(complete, r(attributed - known)).alias("encoding_savings"),
        zero(F.col("chunks")).alias("chunks"), zero(F.col("packs")).alias("packs"), zero(F.col("packed_bytes")).cast("long").alias("packed_bytes"), zero(F.col("pending_bytes")).cast("long").alias("pending_bytes"),
    )
    return scopes.join(F.broadcast(whole.withColumn("_scope", F.lit("global"))), F.col("scope") == F.col("_scope"), "left").drop("_scope")


def conserved(usage: DataFrame, tolerance: float = 1e-5) -> Column:
    """Whether a scope's savings make up the difference of its logical and encoded bytes."""
    savings = usage["local_savings"] + usage["shared_savings"] + usage["encoding_savings"]
    return F.abs(usage["logical_bytes"] - usage["encoded_bytes"] - savings) <= tolerance
