"""Who is accountable for which bytes: interval union, fair shares, attribution and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytecairn.operators import intervals as iv
from bytecairn.operators import usage as us
from bytecairn.sources import io
from bytecairn.sources import model as m
from bytecairn.sources.model import sql, table


def _used(spark: SparkSession, d: str) -> DataFrame:
    """Extents with the bucket that uses them."""
    owner = m.objects(spark, d).select("object_id", "bucket_id")
    return m.extents(spark, d).join(owner, F.col("stream_id") == F.col("object_id")).select("bucket_id", "chunk_id", "lo", "hi")


def inventory_physical(spark, d):
    part = table(spark, d, "part").select(F.lit("chunk").alias("source_type"), (F.col("p_size") % 3).cast("string").alias("state"), F.floor("p_retailprice").cast("long").alias("bytes"))
    supplier = table(spark, d, "supplier").select(F.lit("pack"), (F.col("s_nationkey") % 4).cast("string"), F.floor(F.abs("s_acctbal")).cast("long"))
    orders = table(spark, d, "orders").select(F.lit("raw"), F.col("o_orderstatus"), F.floor("o_totalprice").cast("long"))
    every = part.unionAll(supplier).unionAll(orders)
    return every.groupBy("source_type", "state").agg(F.count(F.lit(1)).alias("count"), F.sum("bytes").alias("bytes"), F.min("bytes").alias("smallest"), F.max("bytes").alias("largest"))


INVENTORY_PHYSICAL = """
SELECT source_type, state, count(*) AS count, CAST(sum(bytes) AS BIGINT) AS bytes, min(bytes) AS smallest, max(bytes) AS largest FROM (
  SELECT 'chunk' AS source_type, CAST(p_size % 3 AS VARCHAR) AS state, CAST(floor(p_retailprice) AS BIGINT) AS bytes FROM part
  UNION ALL SELECT 'pack', CAST(s_nationkey % 4 AS VARCHAR), CAST(floor(abs(s_acctbal)) AS BIGINT) FROM supplier
  UNION ALL SELECT 'raw', o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) FROM orders
) GROUP BY source_type, state"""


def _islands(spark, d):
    """Islands by bucket and chunk, and the number of tasks that they are dealt to."""
    parts = iv.parts_for(m.extents(spark, d))
    return iv.merge_intervals(_used(spark, d), ["bucket_id", "chunk_id"], parts=parts), parts


ISLANDS = """, du AS (SELECT DISTINCT bucket_id, chunk_id, lo, hi FROM used WHERE lo < hi),
flagged AS (SELECT *, CASE WHEN max(hi) OVER w IS NULL OR lo > max(hi) OVER w THEN 1 ELSE 0 END AS opens FROM du
  WINDOW w AS (PARTITION BY bucket_id, chunk_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY bucket_id, chunk_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
islands AS (SELECT bucket_id, chunk_id, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY bucket_id, chunk_id, island)"""
SEGMENTS = (
    ISLANDS
    + """, points AS (SELECT chunk_id, lo AS point FROM islands UNION SELECT chunk_id, hi FROM islands),
paired AS (SELECT chunk_id, point AS lo, lead(point) OVER (PARTITION BY chunk_id ORDER BY point) AS hi FROM points),
segments AS (SELECT * FROM paired WHERE hi IS NOT NULL)"""
)
COVERED = SEGMENTS + ", covered AS (SELECT i.bucket_id, s.chunk_id, s.lo, s.hi FROM islands i JOIN segments s ON i.chunk_id = s.chunk_id AND i.lo <= s.lo AND s.hi <= i.hi)"
SHARES = (
    COVERED
    + """, owned AS (SELECT c.*, b.project_id FROM covered c JOIN buckets b USING (bucket_id)),
by_project AS (SELECT chunk_id, lo, hi, project_id, count(*) AS owners, count(*) OVER (PARTITION BY chunk_id, lo, hi) AS projects FROM owned GROUP BY chunk_id, lo, hi, project_id),
shares AS (SELECT o.*, (o.hi - o.lo) / CAST(projects AS DOUBLE) / owners AS share FROM owned o JOIN by_project USING (chunk_id, lo, hi, project_id))"""
)
USAGE_VIEWS = ("objects", "extents", "buckets", "chunks", "used")


def merged_intervals(spark, d):
    return _islands(spark, d)[0]


def interval_segments(spark, d):
    islands, parts = _islands(spark, d)
    return iv.boundary_segments(islands, "chunk_id", parts)


def interval_coverage(spark, d):
    """Segments, and their bytes, inside the islands of each bucket: by the ranks of an island's ends among its chunk's points, without a join of islands and segments."""
    islands, parts = _islands(spark, d)
    return iv.covered_counts(islands, "chunk_id", "bucket_id", parts).groupBy("bucket_id").agg(F.sum("segments").alias("segments"), F.sum("bytes").alias("bytes"))


def _shared(spark, d):
    """Each bucket's share of each chunk, from islands with their project and the integrals of their chunks."""
    islands, parts = _islands(spark, d)
    islands = islands.join(m.buckets(spark, d).select("bucket_id", "project_id"), "bucket_id")
    return us.shares(islands, us.integrals(islands, "chunk_id", "project_id", parts), "chunk_id", "project_id", "bucket_id", parts)


def fair_share_bytes(spark, d):
    return _shared(spark, d).groupBy("project_id").agg(F.round(F.sum("share"), 3).alias("fair_bytes"), F.sum("unique_bytes").alias("unique_bytes"), F.countDistinct("bucket_id").alias("buckets"))


def usage_summary(spark, d):
    """Flagship: per bucket, project and the whole, from logical bytes to what they cost physically, raw sources included."""
    shares = io.materialised(_shared(spark, d))  # read by every scope and for the rates: computed once, a row a bucket and chunk
    chunks = m.chunks(spark, d).select("chunk_id", F.when(F.col("kind") == "encoding", "chunk").otherwise(F.col("kind")).alias("source_type"), "source", "stored")
    rates = us.encoded_rates(shares, chunks)
    raw = us.raw_shares(m.raw_references(spark, d))
    streams = m.objects(spark, d).select(F.col("object_id").alias("stream_id"))
    inventory = us.raw_inventory(m.raw_sources(spark, d), m.raw_ranges(spark, d), streams)
    whole = us.bridge(m.physical(spark, d), rates.where(F.col("source").isNotNull()), inventory)
    rows = us.scope_rows(shares, "chunk_id", "project_id", "bucket_id")
    return us.summary(us.logical_scopes(m.buckets(spark, d), m.quotas(spark, d)), rows, rates, us.raw_scopes(raw), whole)


RAW = """, raw_projects AS (SELECT source_id, count(DISTINCT project_id) AS n FROM raw_references GROUP BY source_id),
raw_shared AS (SELECT r.*, size / CAST(n AS DOUBLE) / count(*) OVER (PARTITION BY source_id, project_id) AS attributed FROM raw_references r JOIN raw_projects USING (source_id))"""
USAGE_SUMMARY = (
    SHARES
    + RAW
    + """, alloc AS (SELECT project_id, bucket_id, chunk_id, sum(share) AS share, sum(hi - lo) AS uniq FROM shares GROUP BY ALL),
by_scope AS (SELECT 'bucket' AS scope, CAST(bucket_id AS VARCHAR) AS scope_id, chunk_id, uniq, share FROM alloc
  UNION ALL SELECT 'project', CAST(project_id AS VARCHAR), chunk_id, u.uniq, a.share FROM (SELECT project_id, chunk_id, sum(hi - lo) AS uniq FROM (SELECT DISTINCT project_id, chunk_id, lo, hi FROM shares) GROUP BY ALL) u JOIN (SELECT project_id, chunk_id, sum(share) AS share FROM alloc GROUP BY ALL) a USING (project_id, chunk_id)
  UNION ALL SELECT 'global', NULL, chunk_id, sum(hi - lo), sum(hi - lo) FROM (SELECT DISTINCT chunk_id, lo, hi FROM shares) GROUP BY chunk_id),
held AS (SELECT chunk_id, CASE kind WHEN 'encoding' THEN 'chunk' ELSE kind END AS source_type, source, stored FROM chunks),
union_bytes AS (SELECT chunk_id, uniq FROM by_scope WHERE scope = 'global'),
rates AS (SELECT source_type, source, sum(stored) / CAST(sum(uniq) AS DOUBLE) AS rate FROM held LEFT JOIN union_bytes USING (chunk_id) WHERE source IS NOT NULL GROUP BY ALL),
sums AS (SELECT scope, scope_id, count(*) AS chunks, count(DISTINCT CASE WHEN source_type = 'pack' THEN source END) AS packs, sum(uniq) AS uniq, sum(share) AS share, sum(share * rate) AS encoded, bool_and(rate IS NOT NULL) AS complete,
  sum(CASE WHEN source_type = 'pack' THEN uniq ELSE 0 END) AS packed, sum(CASE WHEN rate IS NULL THEN uniq ELSE 0 END) AS pending
  FROM by_scope JOIN held USING (chunk_id) LEFT JOIN rates USING (source_type, source) GROUP BY ALL),
raw_each AS (SELECT scope, scope_id, source_id, max(size) AS size, sum(attributed) AS attributed FROM (
  SELECT 'bucket' AS scope, CAST(bucket_id AS VARCHAR) AS scope_id, source_id, size, attributed FROM raw_shared UNION ALL SELECT 'project', CAST(project_id AS VARCHAR), source_id, size, attributed FROM raw_shared UNION ALL SELECT 'global', NULL, source_id, size, attributed FROM raw_shared) GROUP BY ALL),
raw_scoped AS (SELECT scope, scope_id, sum(size) AS uniq, sum(attributed) AS attributed FROM raw_each GROUP BY ALL),
logical AS (SELECT CASE WHEN grouping(bucket_id) = 0 THEN 'bucket' WHEN grouping(project_id) = 0 THEN 'project' ELSE 'global' END AS scope, CAST(coalesce(bucket_id, project_id) AS VARCHAR) AS scope_id, count(*) AS buckets, coalesce(sum(object_count), 0) AS objects, coalesce(sum(used_bytes), 0) AS bytes
  FROM buckets LEFT JOIN quotas USING (bucket_id) GROUP BY GROUPING SETS ((bucket_id), (project_id), ())),
units AS (SELECT p.*, EXISTS (SELECT 1 FROM held h JOIN union_bytes USING (chunk_id) WHERE h.source_type = p.source_type AND h.source = p.source) AS in_use, state IN ('ready', 'retired', 'deleting') AS there FROM physical p),
raws AS (SELECT r.*, EXISTS (SELECT 1 FROM raw_ranges e JOIN objects o ON o.object_id = e.stream_id WHERE e.source_id = r.source_id) AS selected, owner_stream IS NULL AND NOT EXISTS (SELECT 1 FROM raw_ranges e WHERE e.source_id = r.source_id) AS garbage FROM raw_sources r),
u AS (SELECT coalesce(sum(stored) FILTER (WHERE there), 0) AS i, coalesce(sum(stored) FILTER (WHERE in_use), 0) AS s, coalesce(sum(stored) FILTER (WHERE NOT in_use AND there AND NOT garbage), 0) AS r, coalesce(sum(stored) FILTER (WHERE NOT in_use AND garbage), 0) AS g,
  coalesce(sum(stored) FILTER (WHERE state IN ('preparing', 'uploading')), 0) AS w, count(*) FILTER (WHERE there AND source_type = 'chunk') AS chunk_objects, count(*) FILTER (WHERE there AND source_type = 'pack') AS pack_objects FROM units),
v AS (SELECT coalesce(sum(size) FILTER (WHERE state <> 'writing'), 0) AS i, coalesce(sum(size) FILTER (WHERE selected), 0) AS s, coalesce(sum(size) FILTER (WHERE NOT selected AND NOT garbage AND state <> 'writing'), 0) AS r, coalesce(sum(size) FILTER (WHERE NOT selected AND garbage), 0) AS g,
  coalesce(sum(size) FILTER (WHERE state = 'writing'), 0) AS w, count(*) AS raw_objects FROM raws),
whole AS (SELECT CAST(u.i + v.i AS BIGINT) AS indexed_bytes, CAST(u.s + v.s AS BIGINT) AS selected_bytes, CAST(u.r + v.r AS BIGINT) AS retained_bytes, CAST(u.g + v.g AS BIGINT) AS gc_bytes, CAST(u.w + v.w AS BIGINT) AS unconfirmed_bytes, chunk_objects, raw_objects, pack_objects FROM u, v),
n AS (SELECT l.*, s.chunks, s.packs, s.packed, s.pending, coalesce(s.complete, true) AS complete, coalesce(s.uniq, 0) + coalesce(r.uniq, 0) AS uniq, coalesce(s.share, 0) + coalesce(r.attributed, 0) AS attributed, coalesce(s.encoded, 0) + coalesce(r.attributed, 0) AS known
  FROM logical l LEFT JOIN sums s ON s.scope = l.scope AND s.scope_id IS NOT DISTINCT FROM l.scope_id LEFT JOIN raw_scoped r ON r.scope = l.scope AND r.scope_id IS NOT DISTINCT FROM l.scope_id)"""
)
USAGE_ROWS = """ SELECT scope, scope_id, buckets, CAST(objects AS BIGINT) AS objects, CAST(bytes AS BIGINT) AS logical_bytes, CAST(uniq AS BIGINT) AS unique_bytes, round(attributed, 6) AS attributed_raw_bytes, CASE WHEN complete THEN round(known, 6) END AS encoded_bytes,
round(known, 6) AS encoded_known_bytes, CAST(bytes - uniq AS BIGINT) AS local_savings, round(uniq - attributed, 6) AS shared_savings, CASE WHEN complete THEN round(attributed - known, 6) END AS encoding_savings, coalesce(chunks, 0) AS chunks, coalesce(packs, 0) AS packs,
CAST(coalesce(packed, 0) AS BIGINT) AS packed_bytes, CAST(coalesce(pending, 0) AS BIGINT) AS pending_bytes, indexed_bytes, selected_bytes, retained_bytes, gc_bytes, unconfirmed_bytes, chunk_objects, raw_objects, pack_objects
FROM n LEFT JOIN whole ON scope = 'global'"""
SUMMARY_VIEWS = ("objects", "extents", "buckets", "chunks", "used", "raw_sources", "raw_ranges", "raw_references", "quotas", "physical")


def conservation_check(spark, d):
    """Logical less encoded is local dedup plus sharing plus encoding savings, for every complete scope; and what is indexed is selected, retained or garbage."""
    u = usage_summary(spark, d)
    complete, bridged = F.col("encoded_bytes").isNotNull(), F.col("selected_bytes") + F.col("retained_bytes") + F.col("gc_bytes") == F.col("indexed_bytes")
    return u.agg(F.count_if(complete).alias("scopes"), F.count_if(complete & ~us.conserved(u)).alias("broken"), F.count_if(~bridged).alias("unbridged"))


def raw_shared_attribution(spark, d):
    """Raw sources by bucket: a source's size is split over the projects that use it, then over a project's buckets, so shares add up to the sizes."""
    return us.raw_shares(m.raw_references(spark, d)).groupBy("bucket_id").agg(F.round(F.sum("attributed"), 6).alias("raw_share"), F.sum("size").alias("used_bytes"), F.count(F.lit(1)).alias("sources"))


def inventory_live(spark, d):
    used = m.extents(spark, d).select("chunk_id").distinct()
    chunks = m.chunks(spark, d).join(used.withColumn("_u", F.lit(True)), "chunk_id", "left").withColumn("live", F.coalesce("_u", F.lit(False)))
    return chunks.groupBy("kind").agg(
        F.count_if("live").alias("live"), F.count_if(~F.col("live")).alias("dead"), F.coalesce(F.sum(F.when(F.col("live"), F.col("raw_size"))), F.lit(0)).alias("live_raw_bytes"), F.coalesce(F.sum(F.when(F.col("live") & (F.col("kind") != "pending"), F.col("stored"))), F.lit(0)).alias("live_stored_bytes")
    )


def inventory_unreferenced(spark, d):
    """Chunks that no large extent uses, old enough by their own grace."""
    big = m.extents(spark, d).where("hi - lo >= 45").select("chunk_id").distinct()
    grace = F.when(F.col("kind") == "pack", 40).otherwise(20)
    return m.chunks(spark, d).join(big, "chunk_id", "left_anti").where(F.col("chunk_id") % 50 < grace).groupBy("kind").agg(F.count(F.lit(1)).alias("chunks"), F.sum("stored").alias("bytes"))


def reclaimable_bytes(spark, d):
    big = m.extents(spark, d).where("hi - lo >= 40").select("chunk_id").distinct()
    chunks = m.chunks(spark, d).where("kind <> 'pending'")
    dead = chunks.join(big, "chunk_id", "left_anti")
    by_pack = chunks.where("kind = 'pack'").join(big.withColumn("_u", F.lit(1)), "chunk_id", "left").groupBy("source").agg(F.sum("stored").alias("stored"), F.sum(F.when(F.col("_u") == 1, F.col("stored")).otherwise(0)).alias("live"))
    loose = dead.where("kind = 'encoding'").select(F.lit("encoding").alias("source_type"), F.col("stored").alias("bytes"))
    packed = by_pack.select(F.lit("pack"), (F.col("stored") - F.col("live")).alias("bytes"))
    return loose.unionAll(packed).groupBy("source_type").agg(F.sum("bytes").alias("bytes"), F.count_if(F.col("bytes") > 0).alias("sources"))


def cleanup_eligible(spark, d):
    """Seven kinds of expirable rows, with their count and oldest."""
    e, o = table(spark, d, "events"), table(spark, d, "orders")
    kinds = [e.where(F.col("event_type") == k).select(F.lit(f"event_{k}").alias("section"), F.col("ts").alias("stamp")) for k in ("view", "signup", "error", "click", "purchase")]
    kinds += [o.where(F.col("o_orderstatus") == s).select(F.lit(f"order_{s}").alias("section"), F.col("o_orderdate").alias("stamp")) for s in ("F", "O")]
    every = kinds[0]
    for k in kinds[1:]:
        every = every.unionAll(k)
    return every.where(F.col("stamp") < F.lit("2024-01-20").cast("timestamp_ntz")).groupBy("section").agg(F.count(F.lit(1)).alias("n_rows"), F.min("stamp").alias("oldest"))


def state_histogram_json(spark, d):
    counts = m.objects(spark, d).groupBy("bucket_id", "state").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("state", "n")))
    return counts.groupBy("bucket_id").agg(F.to_json(F.map_from_entries(entries)).alias("states"))


def bucket_totals_rollup(spark, d):
    joined = m.objects(spark, d).join(m.buckets(spark, d), "bucket_id").select("project_id", "size")
    return joined.groupingSets([["project_id"], []], "project_id").agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"), F.grouping("project_id").cast("int").alias("is_total"))


def storage_scope_inventory(spark, d):
    joined = m.buckets(spark, d).join(m.objects(spark, d), "bucket_id", "left")
    return joined.groupBy("project_id").agg(F.countDistinct("bucket_id").alias("buckets"), F.countDistinct(F.when(F.col("size") > 150000, F.col("bucket_id"))).alias("large_buckets"), F.count("object_id").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def rewrite_needed_counts(spark, d):
    chunks = m.chunks(spark, d)
    stale = F.col("type").startswith("S")
    used = m.extents(spark, d).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("uses"))
    joined = chunks.join(used, "chunk_id", "left")
    state = F.when(F.col("kind") == "pending", "blocked").when(F.coalesce("uses", F.lit(0)) == 0, "unused").when(stale, "needed").otherwise("current")
    return joined.groupBy("kind").agg(*[F.sum((state == s).cast("long")).alias(s) for s in ("blocked", "unused", "needed", "current")])


def rewrite_pack_candidate(spark, d):
    """Packs whose members all lie above a cursor and that hold enough."""
    packed = m.chunks(spark, d).where("kind = 'pack'")
    return packed.groupBy("source").agg(F.min("chunk_id").alias("first_chunk"), F.count(F.lit(1)).alias("members"), F.sum("stored").alias("stored")).where("first_chunk > 10 AND members >= 2")


def protection_quorum(spark, d):
    """Stripes with enough distinct pieces; payloads by how many of their stripes are readable."""
    pieces = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("payload"), F.col("l_linenumber").alias("stripe"), (F.col("l_suppkey") % 3).alias("shard"))
    stripes = pieces.groupBy("payload", "stripe").agg(F.countDistinct("shard").alias("pieces"))
    payloads = stripes.groupBy("payload").agg(F.min("pieces").alias("weakest"), F.bool_and(F.col("pieces") >= 2).alias("readable"), F.count(F.lit(1)).alias("stripes"))
    return payloads.groupBy("weakest").agg(F.count(F.lit(1)).alias("payloads"), F.count_if("readable").alias("readable"), F.sum("stripes").alias("stripes"))


def write_backlog_oldest(spark, d):
    li = table(spark, d, "lineitem")
    parts = [li.where(c).select((F.col("l_suppkey") % 10).alias("storage"), F.lit(k).alias("kind"), F.col("l_shipdate").alias("stamp")) for k, c in (("fresh", "l_linestatus = 'O'"), ("returned", "l_returnflag = 'R'"), ("large", "l_quantity >= 48"), ("free", "l_discount = 0"))]
    every = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    return every.groupBy("storage").agg(F.min("stamp").alias("oldest"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("kind") == "large").alias("large"))


def quota_breaches(spark, d):
    """Buckets beyond their limit; a null limit is unlimited, zero forbids everything."""
    used = m.objects(spark, d).groupBy("bucket_id").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("objects"))
    return m.buckets(spark, d).join(used, "bucket_id").where(F.col("used") > F.col("used_limit")).select("bucket_id", "used", "objects", "used_limit", (F.col("used") - F.col("used_limit")).alias("over"))


def set_fingerprint(spark, d):
    """A set's order-free fingerprint: exclusive-or and sum of its ids."""
    return m.objects(spark, d).groupBy("state").agg(F.bit_xor("object_id").alias("xor"), F.sum("object_id").alias("total"), F.count(F.lit(1)).alias("n"))


def verified_backlog(spark, d):
    o = m.objects(spark, d)
    verified = F.col("state") == "F"
    return o.groupBy((F.col("bucket_id") % 20).alias("storage")).agg(
        F.count_if(verified).alias("verified"), F.count_if(~verified).alias("owed"), F.coalesce(F.sum(F.when(~verified, F.col("size"))), F.lit(0)).alias("owed_bytes"), F.min(F.when(~verified, F.col("modified"))).alias("oldest_owed"), F.max(F.when(verified, F.col("modified"))).alias("newest_verified")
    )


def upload_progress(spark, d):
    """Per stream: parts received, bytes, whether any part is out of range, from pre-aggregated sides."""
    parts = m.extents(spark, d).groupBy("stream_id").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.col("hi") - F.col("lo")).alias("received"))
    bad = m.extents(spark, d).join(m.chunks(spark, d).select("chunk_id", "raw_size"), "chunk_id").where("hi > raw_size").select("stream_id").distinct()
    joined = m.objects(spark, d).select("object_id", "state").join(parts, F.col("object_id") == F.col("stream_id"), "left").drop("stream_id").join(bad.withColumn("_bad", F.lit(True)), F.col("object_id") == F.col("stream_id"), "left")
    status = F.when(F.col("parts").isNull(), "waiting").when(F.coalesce("_bad", F.lit(False)), "broken").when(F.col("state") == "O", "open").otherwise("done")
    return joined.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("streams"), F.coalesce(F.sum("parts"), F.lit(0)).alias("parts"), F.coalesce(F.sum("received"), F.lit(0)).alias("received"))


QUERIES = {
    "inventory_physical": (inventory_physical, INVENTORY_PHYSICAL),
    "merged_intervals": (merged_intervals, sql(ISLANDS + " SELECT * FROM islands", "objects", "extents", "used")),
    "interval_segments": (interval_segments, sql(SEGMENTS + " SELECT * FROM segments", "objects", "extents", "used")),
    "interval_coverage": (interval_coverage, sql(COVERED + " SELECT bucket_id, count(*) AS segments, CAST(sum(hi - lo) AS BIGINT) AS bytes FROM covered GROUP BY bucket_id", "objects", "extents", "used")),
    "fair_share_bytes": (fair_share_bytes, sql(SHARES + " SELECT project_id, round(sum(share), 3) AS fair_bytes, CAST(sum(hi - lo) AS BIGINT) AS unique_bytes, count(DISTINCT bucket_id) AS buckets FROM shares GROUP BY project_id", *USAGE_VIEWS)),
    "usage_summary": (usage_summary, sql(USAGE_SUMMARY + USAGE_ROWS, *SUMMARY_VIEWS)),
    "conservation_check": (
        conservation_check,
        sql(
            USAGE_SUMMARY
            + " SELECT count(*) FILTER (WHERE complete) AS scopes, count(*) FILTER (WHERE complete AND abs((bytes - known) - ((bytes - uniq) + (uniq - attributed) + (attributed - known))) > 0.00001) AS broken, (SELECT count(*) FROM whole WHERE selected_bytes + retained_bytes + gc_bytes <> indexed_bytes) AS unbridged FROM n",
            *SUMMARY_VIEWS,
        ),
    ),
    "raw_shared_attribution": (
        raw_shared_attribution,
        sql(RAW + " SELECT bucket_id, round(sum(attributed), 6) AS raw_share, CAST(sum(size) AS BIGINT) AS used_bytes, count(*) AS sources FROM raw_shared GROUP BY bucket_id", "objects", "buckets", "raw_sources", "raw_ranges", "raw_references"),
    ),
    "inventory_live": (
        inventory_live,
        sql(", c AS (SELECT *, EXISTS (SELECT 1 FROM extents e WHERE e.chunk_id = chunks.chunk_id) AS live FROM chunks) SELECT kind, count(*) FILTER (WHERE live) AS live, count(*) FILTER (WHERE NOT live) AS dead, CAST(coalesce(sum(raw_size) FILTER (WHERE live), 0) AS BIGINT) AS live_raw_bytes, CAST(coalesce(sum(stored) FILTER (WHERE live AND kind <> 'pending'), 0) AS BIGINT) AS live_stored_bytes FROM c GROUP BY kind", "extents", "chunks"),
    ),
    "inventory_unreferenced": (
        inventory_unreferenced,
        sql("SELECT kind, count(*) AS chunks, CAST(sum(stored) AS BIGINT) AS bytes FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM extents e WHERE e.chunk_id = c.chunk_id AND hi - lo >= 45) AND chunk_id % 50 < CASE WHEN kind = 'pack' THEN 40 ELSE 20 END GROUP BY kind", "extents", "chunks"),
    ),
    "reclaimable_bytes": (
        reclaimable_bytes,
        sql(", big AS (SELECT DISTINCT chunk_id FROM extents WHERE hi - lo >= 40), u AS (SELECT 'encoding' AS source_type, stored AS bytes FROM chunks WHERE kind = 'encoding' AND chunk_id NOT IN (SELECT chunk_id FROM big) UNION ALL SELECT 'pack', sum(stored) - coalesce(sum(stored) FILTER (WHERE chunk_id IN (SELECT chunk_id FROM big)), 0) FROM chunks WHERE kind = 'pack' GROUP BY source) SELECT source_type, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (WHERE bytes > 0) AS sources FROM u GROUP BY source_type", "extents", "chunks"),
    ),
    "cleanup_eligible": (
        cleanup_eligible,
        "SELECT section, count(*) AS n_rows, min(stamp) AS oldest FROM (SELECT 'event_' || event_type AS section, ts AS stamp FROM events WHERE event_type IN ('view','signup','error','click','purchase') UNION ALL SELECT 'order_' || o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus IN ('F','O')) WHERE stamp < TIMESTAMP '2024-01-20' GROUP BY section",
    ),
    "state_histogram_json": (
        state_histogram_json,
        sql(", c AS (SELECT bucket_id, state, count(*) AS n FROM objects GROUP BY bucket_id, state) SELECT bucket_id, '{' || string_agg('\"' || state || '\":' || n, ',' ORDER BY state) || '}' AS states FROM c GROUP BY bucket_id", "objects"),
    ),
    "bucket_totals_rollup": (bucket_totals_rollup, sql("SELECT project_id, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes, CAST(grouping(project_id) AS INTEGER) AS is_total FROM objects JOIN buckets USING (bucket_id) GROUP BY GROUPING SETS ((project_id), ())", "objects", "buckets")),
    "storage_scope_inventory": (
        storage_scope_inventory,
        sql("SELECT project_id, count(DISTINCT b.bucket_id) AS buckets, count(DISTINCT CASE WHEN size > 150000 THEN b.bucket_id END) AS large_buckets, count(object_id) AS objects, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM buckets b LEFT JOIN objects o ON o.bucket_id = b.bucket_id GROUP BY project_id", "objects", "buckets"),
    ),
    "rewrite_needed_counts": (
        rewrite_needed_counts,
        sql(", s AS (SELECT kind, CASE WHEN kind = 'pending' THEN 'blocked' WHEN NOT EXISTS (SELECT 1 FROM extents e WHERE e.chunk_id = chunks.chunk_id) THEN 'unused' WHEN type LIKE 'S%' THEN 'needed' ELSE 'current' END AS state FROM chunks) SELECT kind, count(*) FILTER (WHERE state = 'blocked') AS blocked, count(*) FILTER (WHERE state = 'unused') AS unused, count(*) FILTER (WHERE state = 'needed') AS needed, count(*) FILTER (WHERE state = 'current') AS current FROM s GROUP BY kind", "extents", "chunks"),
    ),
    "rewrite_pack_candidate": (rewrite_pack_candidate, sql("SELECT source, min(chunk_id) AS first_chunk, count(*) AS members, CAST(sum(stored) AS BIGINT) AS stored FROM chunks WHERE kind = 'pack' GROUP BY source HAVING min(chunk_id) > 10 AND count(*) >= 2", "chunks")),
    "protection_quorum": (
        protection_quorum,
        "WITH s AS (SELECT l_orderkey, l_linenumber, count(DISTINCT l_suppkey % 3) AS pieces FROM lineitem GROUP BY ALL), p AS (SELECT l_orderkey, min(pieces) AS weakest, bool_and(pieces >= 2) AS readable, count(*) AS stripes FROM s GROUP BY l_orderkey) SELECT weakest, count(*) AS payloads, count(*) FILTER (WHERE readable) AS readable, CAST(sum(stripes) AS BIGINT) AS stripes FROM p GROUP BY weakest",
    ),
    "write_backlog_oldest": (
        write_backlog_oldest,
        "SELECT storage, min(stamp) AS oldest, count(*) AS n_rows, count(*) FILTER (WHERE kind = 'large') AS large FROM (SELECT l_suppkey % 10 AS storage, 'fresh' AS kind, l_shipdate AS stamp FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT l_suppkey % 10, 'returned', l_shipdate FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_suppkey % 10, 'large', l_shipdate FROM lineitem WHERE l_quantity >= 48 UNION ALL SELECT l_suppkey % 10, 'free', l_shipdate FROM lineitem WHERE l_discount = 0) GROUP BY storage",
    ),
    "quota_breaches": (quota_breaches, sql(", u AS (SELECT bucket_id, CAST(sum(size) AS BIGINT) AS used, count(*) AS objects FROM objects GROUP BY bucket_id) SELECT bucket_id, used, objects, used_limit, used - used_limit AS over FROM buckets JOIN u USING (bucket_id) WHERE used > used_limit", "objects", "buckets")),
    "set_fingerprint": (set_fingerprint, sql("SELECT state, bit_xor(object_id) AS xor, CAST(sum(object_id) AS BIGINT) AS total, count(*) AS n FROM objects GROUP BY state", "objects")),
    "verified_backlog": (
        verified_backlog,
        sql("SELECT bucket_id % 20 AS storage, count(*) FILTER (WHERE state = 'F') AS verified, count(*) FILTER (WHERE state <> 'F') AS owed, CAST(coalesce(sum(size) FILTER (WHERE state <> 'F'), 0) AS BIGINT) AS owed_bytes, min(modified) FILTER (WHERE state <> 'F') AS oldest_owed, max(modified) FILTER (WHERE state = 'F') AS newest_verified FROM objects GROUP BY bucket_id % 20", "objects"),
    ),
    "upload_progress": (
        upload_progress,
        sql(", p AS (SELECT stream_id, count(*) AS parts, sum(hi - lo) AS received FROM extents GROUP BY stream_id), s AS (SELECT parts, received, CASE WHEN parts IS NULL THEN 'waiting' WHEN EXISTS (SELECT 1 FROM extents e JOIN chunks c USING (chunk_id) WHERE e.stream_id = o.object_id AND hi > raw_size) THEN 'broken' WHEN state = 'O' THEN 'open' ELSE 'done' END AS status FROM objects o LEFT JOIN p ON p.stream_id = o.object_id) SELECT status, count(*) AS streams, CAST(coalesce(sum(parts), 0) AS BIGINT) AS parts, CAST(coalesce(sum(received), 0) AS BIGINT) AS received FROM s GROUP BY status", "objects", "extents", "chunks"),
    ),
}
