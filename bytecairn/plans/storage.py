"""Telemetry, tiers and packs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bytecairn.operators import intervals as iv, packs, telemetry as tm, tiering
from bytecairn.sources import model as m
from bytecairn.sources.model import sql, table

NOW = 1_706_600_000
DAY = 86_400


def _seconds(col):
    return F.floor(F.unix_micros(col.cast("timestamp")) / 1_000_000).cast("long")


SECONDS_SQL = "CAST(floor(epoch_us({0}) / 1000000) AS BIGINT)"


def latest_two_samples(spark, d):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, d, "events").withColumn("rank", rank).where("rank <= 2").select("user_id", "event_id", "rank")


def _samples(spark, d):
    """Cumulative counters by node, which a signup resets (a new boot)."""
    e = table(spark, d, "events").withColumn("node", F.col("user_id") % 5)
    order = Window.partitionBy("node").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    boot = F.sum(F.when((F.col("event_type") == "signup") & (F.col("user_id") < 30), 1).otherwise(0)).over(order)
    booted = e.withColumn("boot", boot)
    life = Window.partitionBy("node", "boot").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(F.lit(1)).over(life)
    return booted.select(
        "node", "boot", F.col("event_id").alias("sequence"), _seconds(F.col("ts")).alias("received"), (n * 60).alias("uptime"), n.alias("requests"), (n * 100).alias("read_bytes"),
        F.count_if(F.col("event_type") == "view").over(life).alias("hits"), n.alias("lookups"), F.floor(F.col("value")).cast("long").alias("cache_bytes"), (F.col("user_id") * 10).alias("rss_bytes"),
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("queue_waiting"),
    )


SAMPLES = f"""WITH e AS (SELECT *, user_id % 5 AS node, sum(CASE WHEN event_type = 'signup' AND user_id < 30 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 5 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS boot FROM events),
s AS (SELECT node, boot, event_id AS sequence, {SECONDS_SQL.format('ts')} AS received, count(*) OVER w AS n, count(*) FILTER (WHERE event_type = 'view') OVER w AS hits,
  CAST(floor(value) AS BIGINT) AS cache_bytes, user_id * 10 AS rss_bytes, CASE WHEN event_type <> 'error' THEN user_id END AS queue_waiting
  FROM e WINDOW w AS (PARTITION BY node, boot ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, lag(boot) OVER o AS pb, lag(sequence) OVER o AS ps, lag(n) OVER o AS pn, lag(hits) OVER o AS ph, row_number() OVER (PARTITION BY node ORDER BY received DESC, sequence DESC) AS rn FROM s WINDOW o AS (PARTITION BY node ORDER BY received, sequence)),
v AS (SELECT *, coalesce(boot = pb AND sequence > ps AND n > pn AND hits >= ph AND (n - pn) * 60 <= 3600, false) AS valid FROM p)"""


def cluster_rates(spark, d):
    return tm.cluster_rates(_samples(spark, d), F.lit(NOW), 400 * DAY, 3600)


def counter_resets(spark, d):
    """Intervals per node that give a rate, and those that do not."""
    s = _samples(spark, d)
    good = tm.counter_deltas(s, ["requests", "hits"], 3600).groupBy("node").agg(F.count(F.lit(1)).alias("rated"), F.sum("d_requests").alias("requests"))
    every = s.groupBy("node").agg(F.count(F.lit(1)).alias("samples"), F.max("boot").alias("boots"))
    return every.join(good, "node", "left").select("node", "samples", "boots", "rated", "requests")


def latency_percentiles(spark, d):
    return tm.latency_percentiles(table(spark, d, "events"), ["event_type"], F.col("value") * 20)


def hourly_access_windows(spark, d):
    rows = table(spark, d, "events").select("event_type", "ts", F.floor(F.col("value") * 100).cast("long").alias("bytes"))
    return tm.hourly_windows(rows, ["event_type"])


HOURLY = "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS reads, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY event_type, date_trunc('hour', ts)"


def access_coverage_gaps(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("node"), "event_type", "ts", "event_id")
    return tm.coverage_gaps(e, ["node", "event_type"], 18_000)


def capacity_history_capped(spark, d):
    """The newest 48 hourly points of the capacity history, in ascending order of time."""
    points = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.sum(F.floor(F.col("value") * 100).cast("long")).alias("bytes"), F.count(F.lit(1)).alias("samples"))
    return points.orderBy(F.desc("hour")).limit(48).orderBy("hour")


def access_accumulate(spark, d):
    """Hourly counters of the first half, with the second half added to them."""
    rows = table(spark, d, "events").select("event_id", "event_type", "ts", F.floor(F.col("value") * 100).cast("long").alias("bytes"))
    half = lambda c: tm.hourly_windows(rows.where(c), ["event_type"])
    return tm.accumulate(half("event_id % 2 = 0"), half("event_id % 2 = 1"), ["event_type", "hour"], ["reads", "bytes"])


def demand_by_request(spark, d):
    """Reads of a unit within one request count once: bytes add up, any from the origin marks it."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.floor("l_quantity").cast("long").alias("bytes"), (F.col("l_returnflag") == "R").alias("origin"))
    request = li.groupBy("l_orderkey", "l_partkey").agg(F.sum("bytes").alias("bytes"), F.bool_or("origin").alias("origin"))
    return request.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("reads"), F.sum("bytes").alias("bytes"), F.count_if("origin").alias("origins"))


def _references(spark, d):
    o, e, c = m.objects(spark, d), m.extents(spark, d), m.chunks(spark, d)
    created = _seconds(F.col("modified"))
    j = e.join(o, F.col("stream_id") == F.col("object_id")).join(c.select("chunk_id", "kind", "stored"), "chunk_id")
    policy = F.when(F.col("bucket_id") % 97 != 0, F.floor(F.col("chunk_id") / 100).cast("long"))
    return j.select(
        F.col("chunk_id").alias("physical"), F.col("stored").alias("stored_bytes"), (F.col("bucket_id") % 101 != 0).alias("visible"), (F.col("kind") != "pending").alias("ready"), created.alias("created"), F.when(F.col("chunk_id") % 13 == 0, F.lit(0)).otherwise(created).alias("observed"),
        F.when(F.col("lo") > 60, created + 30 * DAY).alias("last_read"), F.when(F.col("chunk_id") % 17 == 0, "paused").otherwise("active").alias("state"), policy.alias("cold_storage"), (F.col("chunk_id") % 4 * 3000 * DAY).alias("cool_after"), (F.col("chunk_id") % 3 * 3500 * DAY).alias("residency"),
    )


def tier_candidates(spark, d):
    """Of all chunks; more references than a unit may have, at these tables' scale, is forty."""
    return tiering.candidates(_references(spark, d), NOW, 1, NOW - 60, 900, m.chunks(spark, d).select(F.col("chunk_id").alias("physical")), 40)


CREATED = SECONDS_SQL.format("modified")
TIER = f""", r AS (SELECT chunk_id AS physical, stored AS stored_bytes, bucket_id % 101 <> 0 AS visible, kind <> 'pending' AS ready, {CREATED} AS created, CASE WHEN chunk_id % 13 = 0 THEN 0 ELSE {CREATED} END AS observed,
CASE WHEN lo > 60 THEN {CREATED} + {30 * DAY} END AS last_read, CASE WHEN chunk_id % 17 = 0 THEN 'paused' ELSE 'active' END AS state, CASE WHEN bucket_id % 97 <> 0 THEN chunk_id // 100 END AS cold, chunk_id % 4 * {3000 * DAY} AS cool, chunk_id % 3 * {3500 * DAY} AS dwell
FROM extents JOIN objects ON stream_id = object_id JOIN chunks USING (chunk_id)),
u AS (SELECT physical, count(*) AS n, max(stored_bytes) AS stored_bytes, max(last_read) AS last_read, max(created) AS age, greatest(max(observed), 1) AS observed, min(observed) AS first, bool_or(NOT ready OR NOT visible) AS busy,
bool_or(cold IS NULL OR state <> 'active') OR coalesce(min(cold) <> max(cold), true) AS shared, max(cool) AS cool, max(dwell) AS dwell FROM r GROUP BY physical)
SELECT c.chunk_id AS physical, coalesce(u.stored_bytes, 0) AS stored_bytes, CASE WHEN n IS NULL OR n > 40 THEN 'references_unconfirmed' WHEN busy THEN 'source_busy' WHEN shared THEN 'shared_policy' WHEN first <= 0 OR {NOW} - observed < cool THEN 'observation_gap' WHEN {NOW} - age < greatest(dwell, cool) THEN 'minimum_residency'
WHEN last_read IS NOT NULL AND {NOW} - last_read < cool THEN 'recent_read' ELSE 'eligible' END AS reason FROM chunks c LEFT JOIN u ON u.physical = c.chunk_id"""


def tier_heat(spark, d):
    """Newest read of a pack: its own or any member's."""
    packed = m.chunks(spark, d).where("kind = 'pack'").select("chunk_id", F.col("source").alias("physical"))
    e = m.extents(spark, d).join(m.objects(spark, d), F.col("stream_id") == F.col("object_id")).select("chunk_id", _seconds(F.col("modified")).alias("at_seconds"))
    inner = e.join(packed, "chunk_id")
    own = table(spark, d, "supplier").select(F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 30 + 1).cast("string")).alias("physical"), (F.col("s_suppkey") * 10_000_000).alias("at_seconds"))
    return tiering.heat(packed.select("physical").distinct(), own, inner)


def tier_placement_usage(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("physical"), F.when(F.col("l_linestatus") == "O", "hot").otherwise("cold").alias("tier"), (F.col("l_returnflag") == "R").alias("retiring")).distinct()
    return tiering.placement_usage(li.join(m.chunks(spark, d).select(F.col("chunk_id").alias("physical"), F.col("stored").alias("bytes")), "physical"))


def tier_family(spark, d):
    """Storages that belong together: same nation, or a nation of the same region."""
    nation, region = table(spark, d, "nation"), table(spark, d, "supplier")
    own = region.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("storage"))
    peers = nation.alias("a").join(nation.alias("b"), F.col("a.n_regionkey") == F.col("b.n_regionkey")).select(F.col("a.n_nationkey").alias("nation"), F.col("b.n_nationkey").alias("peer"))
    near = own.select(F.col("nation").alias("peer"), "storage").join(peers, "peer").select("nation", "storage")
    return own.union(near).distinct().groupBy("nation").agg(F.count(F.lit(1)).alias("storages"), F.min("storage").alias("first"))


def promotion_pressure(spark, d):
    reads = table(spark, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("physical"), _seconds(F.col("ts")).alias("at_seconds"))
    return tiering.promotion_pressure(reads, 2 * DAY, 3)


def pack_layout(spark, d):
    packed = m.chunks(spark, d).where("kind = 'pack'")
    return packs.layout(packed, "source", "chunk_id", "stored").select("source", "chunk_id", "stored", "offset")


def pack_first_fit(spark, d):
    uses = m.extents(spark, d).groupBy("chunk_id").agg(F.countDistinct("stream_id").alias("streams"))
    rows = m.extents(spark, d).join(m.chunks(spark, d).select("chunk_id", "raw_size", "kind"), "chunk_id").join(uses, "chunk_id")
    c = rows.select("stream_id", "chunk_id", F.col("lo").alias("offset"), "raw_size", (F.col("kind") != "pending").alias("eligible"), (F.col("kind") == "pack").alias("packed"), (F.col("streams") > 40).alias("shared"))
    return packs.select_members(c, "stream_id", 1200)


def coalesced_gets(spark, d):
    return packs.coalesced_gets(m.extents(spark, d), ["stream_id", "chunk_id"]).groupBy("stream_id").agg(F.sum("gets").alias("gets"), F.sum("bytes").alias("bytes"))


def adjacent_runs(spark, d):
    return packs.adjacent_runs(m.extents(spark, d).withColumn("pack", F.col("chunk_id") % 3), ["stream_id", "pack"])


def repack_gain(spark, d):
    """Reads that a stream needs now less those after its chunks move into one pack, by requests: one pass by chunk of a stream, one by stream."""
    e = m.extents(spark, d)
    parts = iv.parts_for(e)
    spans = iv.dealt(e.where("lo < hi").select("stream_id", "chunk_id", "lo", "hi"), parts, "stream_id", "chunk_id").withColumn("open", packs.begins_run(["stream_id", "chunk_id"]))
    members = spans.groupBy("stream_id", "chunk_id").agg(F.sum("open").alias("gets"), F.max(F.col("hi") - F.col("lo")).alias("length"))
    laid = packs.layout(iv.dealt(members, parts, "stream_id"), "stream_id", "chunk_id", "length").select("stream_id", "gets", F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"))
    reads = laid.withColumn("open", packs.begins_run(["stream_id"])).groupBy("stream_id").agg(F.sum("gets").alias("before"), F.sum("open").alias("after"))
    requests = m.objects(spark, d).select(F.col("object_id").alias("stream_id"), (F.col("bucket_id") % 9 + 1).alias("requests"))
    return reads.join(requests, "stream_id").select("stream_id", "before", "after", (F.col("requests") * (F.col("before") - F.col("after"))).alias("gain"))


def read_shapes(spark, d):
    return m.extents(spark, d).groupBy("chunk_id", "lo", "hi").agg(F.count(F.lit(1)).alias("requests")).where("requests > 1")


def overlap_join(spark, d):
    """Extents that overlap a requested byte range of the same chunk."""
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), (F.col("p_size") * 2).cast("long").alias("first"), (F.col("p_size") * 2 + 20).cast("long").alias("last"))
    return m.extents(spark, d).join(asked, "chunk_id").where("lo < last AND hi > first").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("extents"), F.sum(F.least("hi", "last") - F.greatest("lo", "first")).alias("bytes"))


def budgeted_batch(spark, d):
    return packs.budgeted(m.chunks(spark, d).where("raw_size > 0"), ["brand"], ["chunk_id"], "raw_size", 4000).select("brand", "chunk_id", "raw_size")


def top_n_per_bucket_lateral(spark, d):
    """The two largest objects of each bucket."""
    best = F.row_number().over(Window.partitionBy("bucket_id").orderBy(F.desc("size"), "object_id"))
    return m.objects(spark, d).join(m.buckets(spark, d).select("bucket_id"), "bucket_id", "left_semi").withColumn("rank", best).where("rank <= 2").select("bucket_id", "object_id", "size", "rank")


def nonce_forecast(spark, d):
    """Days until each node's counter space runs out, at the rate of its sampled history."""
    s = table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("node")).agg(F.count(F.lit(1)).alias("used"), F.min(_seconds(F.col("ts"))).alias("since"), F.max(_seconds(F.col("ts"))).alias("until"))
    per_day = F.try_divide(F.col("used") * DAY, F.col("until") - F.col("since"))
    return s.select("node", "used", F.round(per_day, 4).alias("per_day"), F.round(F.try_divide(F.lit(1_000_000) - F.col("used"), per_day), 3).alias("days_left"))


QUERIES = {
    "latest_two_samples": (latest_two_samples, "SELECT user_id, event_id, CAST(rank AS INTEGER) AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 2"),
    "cluster_rates": (
        cluster_rates,
        SAMPLES + f" SELECT count(*) AS reported, count(*) FILTER (WHERE valid) AS rate_nodes, round(sum((n - pn) / ((n - pn) * 60.0)) FILTER (WHERE valid), 6) AS requests_per_second, round(sum((n - pn) * 100 / ((n - pn) * 60.0)) FILTER (WHERE valid), 6) AS read_bytes_per_second, round(least(1.0, sum(hits - ph) FILTER (WHERE valid) / CAST(sum(n - pn) FILTER (WHERE valid) AS DOUBLE)), 6) AS hit_ratio, CAST(sum(cache_bytes) AS BIGINT) AS cache_bytes, CAST(CASE WHEN count(rss_bytes) = count(*) THEN sum(rss_bytes) END AS BIGINT) AS rss_bytes, CAST(CASE WHEN count(queue_waiting) = count(*) THEN sum(queue_waiting) END AS BIGINT) AS queue_waiting FROM v WHERE rn = 1 AND {NOW} - received <= {400 * DAY} AND received <= {NOW}",
    ),
    "counter_resets": (counter_resets, SAMPLES + " SELECT node, count(*) AS samples, CAST(max(boot) AS BIGINT) AS boots, nullif(count(*) FILTER (WHERE valid), 0) AS rated, CAST(sum(n - pn) FILTER (WHERE valid) AS BIGINT) AS requests FROM v GROUP BY node"),
    "latency_percentiles": (
        latency_percentiles,
        "WITH b AS (SELECT event_type, CAST(least(24, greatest(0, ceil(log2(greatest(value * 20, 1.0))))) AS INTEGER) AS b FROM events), c AS (SELECT event_type, b, count(*) AS n FROM b GROUP BY event_type, b), r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY b ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER (PARTITION BY event_type) AS t FROM c), p AS (SELECT event_type, CAST(sum(n) AS BIGINT) AS n, min(b) FILTER (WHERE c >= ceil(t * 50 / 100)) AS p50, min(b) FILTER (WHERE c >= ceil(t * 95 / 100)) AS p95, min(b) FILTER (WHERE c >= ceil(t * 99 / 100)) AS p99 FROM r GROUP BY event_type) SELECT event_type, n, CAST(CASE WHEN p50 < 24 THEN pow(2, p50) END AS BIGINT) AS p50, CAST(CASE WHEN p95 < 24 THEN pow(2, p95) END AS BIGINT) AS p95, CAST(CASE WHEN p99 < 24 THEN pow(2, p99) END AS BIGINT) AS p99 FROM p",
    ),
    "hourly_access_windows": (hourly_access_windows, HOURLY),
    "access_coverage_gaps": (
        access_coverage_gaps,
        "WITH g AS (SELECT user_id % 5 AS node, event_type, lag(ts) OVER w AS gap_from, ts AS gap_to FROM events WINDOW w AS (PARTITION BY user_id % 5, event_type ORDER BY ts, event_id)) SELECT *, epoch_us(gap_to) - epoch_us(gap_from) AS micros FROM g WHERE epoch_us(gap_to) - epoch_us(gap_from) > 18000000000",
    ),
    "capacity_history_capped": (
        capacity_history_capped,
        "SELECT * FROM (SELECT date_trunc('hour', ts) AS hour, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS bytes, count(*) AS samples FROM events GROUP BY date_trunc('hour', ts) ORDER BY hour DESC LIMIT 48) ORDER BY hour",
    ),
    "access_accumulate": (access_accumulate, HOURLY),
    "demand_by_request": (
        demand_by_request,
        "WITH r AS (SELECT l_orderkey, l_partkey, sum(CAST(floor(l_quantity) AS BIGINT)) AS bytes, bool_or(l_returnflag = 'R') AS origin FROM lineitem GROUP BY l_orderkey, l_partkey) SELECT l_partkey, count(*) AS reads, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (WHERE origin) AS origins FROM r GROUP BY l_partkey",
    ),
    "tier_candidates": (tier_candidates, sql(TIER, "objects", "extents", "chunks")),
    "tier_heat": (
        tier_heat,
        sql(f", p AS (SELECT chunk_id, source AS physical FROM chunks WHERE kind = 'pack'), i AS (SELECT physical, max({CREATED}) AS t FROM extents JOIN objects ON stream_id = object_id JOIN p USING (chunk_id) GROUP BY physical), o AS (SELECT 'Brand#' || (s_suppkey % 30 + 1) AS physical, max(s_suppkey * 10000000) AS t FROM supplier GROUP BY 1) SELECT physical, greatest(o.t, i.t) AS last_read FROM (SELECT DISTINCT physical FROM p) LEFT JOIN o USING (physical) LEFT JOIN i USING (physical)", "objects", "extents", "chunks"),
    ),
    "tier_placement_usage": (
        tier_placement_usage,
        sql(", c AS (SELECT DISTINCT l_partkey AS physical, CASE WHEN l_linestatus = 'O' THEN 'hot' ELSE 'cold' END AS tier, l_returnflag = 'R' AS retiring FROM lineitem), b AS (SELECT c.*, stored AS bytes FROM c JOIN chunks ON chunk_id = physical), r AS (SELECT bytes, CASE WHEN retiring THEN 'retiring' WHEN tier = 'cold' AND EXISTS (SELECT 1 FROM b x WHERE x.physical = b.physical AND NOT x.retiring AND x.tier = 'hot') THEN 'duplicate' ELSE tier END AS role FROM b) SELECT role, count(*) AS copies, CAST(sum(bytes) AS BIGINT) AS bytes FROM r GROUP BY role", "chunks"),
    ),
    "tier_family": (
        tier_family,
        "WITH f AS (SELECT s_nationkey AS nation, s_suppkey AS storage FROM supplier UNION SELECT a.n_nationkey, s_suppkey FROM supplier JOIN nation b ON s_nationkey = b.n_nationkey JOIN nation a ON a.n_regionkey = b.n_regionkey) SELECT nation, count(*) AS storages, min(storage) AS first FROM f GROUP BY nation",
    ),
    "promotion_pressure": (
        promotion_pressure,
        f"WITH RECURSIVE r AS (SELECT user_id AS physical, {SECONDS_SQL.format('ts')} AS t, count(*) AS c FROM events WHERE event_type = 'view' GROUP BY ALL), "
        f"x AS (SELECT *, min(t) OVER (PARTITION BY physical ORDER BY t RANGE BETWEEN {2 * DAY} FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM r), "
        "w AS (SELECT physical, min(t) AS s FROM r GROUP BY physical UNION ALL SELECT w.physical, x.after FROM w JOIN x ON x.physical = w.physical AND x.t = w.s WHERE x.after IS NOT NULL), "
        f"n AS (SELECT w.physical, w.s, sum(c) AS reads FROM w JOIN r ON r.physical = w.physical AND r.t >= w.s AND r.t < w.s + {2 * DAY} GROUP BY w.physical, w.s) "
        "SELECT physical, count(*) AS hot_windows, CAST(max(reads) AS BIGINT) AS most FROM n WHERE reads >= 3 GROUP BY physical",
    ),
    "pack_layout": (pack_layout, sql("SELECT source, chunk_id, stored, CAST(sum(stored) OVER (PARTITION BY source ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) - stored + 8 AS BIGINT) AS offset FROM chunks WHERE kind = 'pack'".replace(" AS offset", ' AS "offset"'), "chunks")),
    "pack_first_fit": (
        pack_first_fit,
        "WITH RECURSIVE " + sql(""", uses AS (SELECT chunk_id, count(DISTINCT stream_id) AS streams FROM extents GROUP BY chunk_id),
firsts AS (SELECT stream_id, chunk_id, min(lo) AS lo, any_value(raw_size) AS raw_size FROM extents JOIN chunks USING (chunk_id) JOIN uses USING (chunk_id) WHERE kind = 'encoding' AND streams <= 40 GROUP BY stream_id, chunk_id),
c AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY lo, chunk_id) AS n FROM firsts),
walk AS (SELECT DISTINCT stream_id, CAST(NULL AS BIGINT) AS chunk_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS chosen, false AS closed, false AS taken, CAST(0 AS BIGINT) AS size FROM c
UNION ALL SELECT w.stream_id, c.chunk_id, c.n, CASE WHEN NOT closed AND total + raw_size <= 1200 THEN total + raw_size ELSE total END, CASE WHEN NOT closed AND total + raw_size <= 1200 THEN chosen + 1 ELSE chosen END,
  closed OR (total + raw_size > 1200 AND chosen > 0), NOT closed AND total + raw_size <= 1200, raw_size FROM walk w JOIN c ON c.stream_id = w.stream_id AND c.n = w.n + 1)
SELECT stream_id, chunk_id, CAST(chosen - 1 AS INTEGER) AS position, total - size AS start FROM walk WHERE taken""", "extents", "chunks").removeprefix("WITH "),
    ),
    "coalesced_gets": (
        coalesced_gets,
        sql(", s AS (SELECT DISTINCT stream_id, chunk_id, lo, hi FROM extents WHERE lo < hi), o AS (SELECT *, CASE WHEN lag(hi) OVER (PARTITION BY stream_id, chunk_id ORDER BY lo, hi) = lo THEN 0 ELSE 1 END AS opens FROM s) SELECT stream_id, CAST(sum(opens) AS BIGINT) AS gets, CAST(sum(hi - lo) AS BIGINT) AS bytes FROM o GROUP BY stream_id", "extents"),
    ),
    "adjacent_runs": (
        adjacent_runs,
        sql(", s AS (SELECT DISTINCT stream_id, chunk_id % 3 AS pack, lo, hi FROM extents WHERE lo < hi), o AS (SELECT *, CASE WHEN lag(hi) OVER (PARTITION BY stream_id, pack ORDER BY lo, hi) = lo THEN 0 ELSE 1 END AS opens FROM s) SELECT stream_id, pack, CAST(sum(opens) AS BIGINT) AS gets, CAST(sum(hi - lo) AS BIGINT) AS bytes FROM o GROUP BY stream_id, pack", "extents"),
    ),
    "repack_gain": (
        repack_gain,
        sql(", s AS (SELECT DISTINCT stream_id, chunk_id, lo, hi FROM extents WHERE lo < hi), o AS (SELECT *, CASE WHEN lag(hi) OVER (PARTITION BY stream_id, chunk_id ORDER BY lo, hi) = lo THEN 0 ELSE 1 END AS opens FROM s), b AS (SELECT stream_id, CAST(sum(opens) AS BIGINT) AS before FROM o GROUP BY stream_id) SELECT stream_id, before, CAST(1 AS BIGINT) AS after, (bucket_id % 9 + 1) * (before - 1) AS gain FROM b JOIN objects ON stream_id = object_id", "extents", "objects"),
    ),
    "read_shapes": (read_shapes, sql("SELECT chunk_id, lo, hi, count(*) AS requests FROM extents GROUP BY chunk_id, lo, hi HAVING count(*) > 1", "extents")),
    "overlap_join": (
        overlap_join,
        sql(", a AS (SELECT p_partkey AS chunk_id, CAST(p_size * 2 AS BIGINT) AS f, CAST(p_size * 2 + 20 AS BIGINT) AS l FROM part) SELECT chunk_id, count(*) AS extents, CAST(sum(least(hi, l) - greatest(lo, f)) AS BIGINT) AS bytes FROM extents JOIN a USING (chunk_id) WHERE lo < l AND hi > f GROUP BY chunk_id", "extents"),
    ),
    "budgeted_batch": (
        budgeted_batch,
        sql(", b AS (SELECT *, sum(raw_size) OVER (PARTITION BY brand ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) - raw_size AS before FROM chunks WHERE raw_size > 0) SELECT brand, chunk_id, raw_size FROM b WHERE before < 4000 OR before = 0", "chunks"),
    ),
    "top_n_per_bucket_lateral": (
        top_n_per_bucket_lateral,
        sql(", r AS (SELECT bucket_id, object_id, size, CAST(row_number() OVER (PARTITION BY bucket_id ORDER BY size DESC, object_id) AS INTEGER) AS rank FROM objects JOIN buckets USING (bucket_id)) SELECT * FROM r WHERE rank <= 2", "objects", "buckets"),
    ),
    "nonce_forecast": (
        nonce_forecast,
        f"WITH s AS (SELECT user_id % 5 AS node, count(*) AS used, min({SECONDS_SQL.format('ts')}) AS since, max({SECONDS_SQL.format('ts')}) AS until FROM events GROUP BY user_id % 5) SELECT node, used, round(used * {DAY} / CAST(nullif(until - since, 0) AS DOUBLE), 4) AS per_day, round((1000000 - used) / (used * {DAY} / CAST(nullif(until - since, 0) AS DOUBLE)), 3) AS days_left FROM s",
    ),
}
