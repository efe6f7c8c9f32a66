"""Versions, states at a time, restore plans, replay and snapshots of the change log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bytecairn.functions import text as fx
from bytecairn.operators import history as h
from bytecairn.sources import model as m
from bytecairn.sources.model import sql, table

#: Part of every log taken as its past, by sequence number over the log's length.
CUT = 0.6


def _cut(spark, d):
    """The sequence number at the cut, as a one-row table that is broadcast."""
    return F.broadcast(m.changes(spark, d).agg(F.floor(F.max("seq") * CUT).cast("long").alias("cut")))


def _until(spark, d):
    return m.changes(spark, d).crossJoin(_cut(spark, d)).where("seq <= cut").drop("cut")


CUT_SQL = f", cut AS (SELECT CAST(floor(max(seq) * {CUT}) AS BIGINT) AS cut FROM changes)"
LAST = ", last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY seq DESC) AS rn FROM changes) WHERE rn = 1)"
OLD = CUT_SQL + ", old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY seq DESC) AS rn FROM changes WHERE seq <= (SELECT cut FROM cut)) WHERE rn = 1)"


def versions_latest_flag(spark, d):
    """Every version of every key, with whether it is the latest."""
    return h.with_latest_flag(m.changes(spark, d), ["bucket", "key"]).select("bucket", "key", "seq", "op", "latest")


def as_of_state(spark, d):
    return h.live(_until(spark, d), ["bucket", "key"]).select("bucket", "key", "seq", "size")


def _plan(spark, d, in_place=True):
    source = h.live(_until(spark, d), ["bucket", "key"])
    current = h.live(m.changes(spark, d), ["bucket", "key"])
    return h.restore_plan(source, current, ["bucket", "key"], F.col("size") % 7 == 0, in_place)


def restore_plan(spark, d):
    return _plan(spark, d)


def restore_plan_counts(spark, d):
    here = _plan(spark, d).select(F.lit("in place").alias("mode"), "state")
    there = _plan(spark, d, in_place=False).select(F.lit("elsewhere"), "state")
    return here.unionAll(there).groupBy("mode", "state").agg(F.count(F.lit(1)).alias("keys"))


PLAN = (
    OLD
    + LAST
    + """, s AS (SELECT bucket, key, seq, size % 7 = 0 AS gone FROM old WHERE op = 'put'), c AS (SELECT bucket, key, seq FROM last WHERE op = 'put'),
j AS (SELECT bucket, key, s.seq AS source_seq, c.seq AS current_seq, gone FROM s FULL JOIN c USING (bucket, key))"""
)
STATE = "CASE WHEN source_seq IS NOT NULL AND gone THEN 'missing' WHEN source_seq IS NULL THEN 'remove' WHEN current_seq IS NULL THEN 'add' WHEN source_seq <> current_seq THEN 'replace' ELSE 'skip' END"
ELSEWHERE = "CASE WHEN source_seq IS NOT NULL AND gone THEN 'missing' WHEN source_seq IS NULL THEN NULL WHEN current_seq IS NULL THEN 'add' ELSE 'skip' END"


def recovery_window_gaps(spark, d):
    """Daily recovery points outside the gaps that large errors of one hour leave in a bucket's log."""
    c = m.changes(spark, d)
    gaps = c.where("op = 'delete' AND size > 5000").groupBy("bucket", F.date_trunc("hour", "stamp").alias("range")).agg(F.min("seq").alias("gap_from"), F.max("seq").alias("gap_to")).where("gap_to > gap_from").select(F.col("bucket").alias("gap_bucket"), "gap_from", "gap_to")
    points = c.groupBy("bucket", F.date_trunc("day", "stamp").alias("day")).agg(F.max("seq").alias("point"))
    return h.outside_gaps(points, gaps, "point").groupBy("bucket").agg(F.count(F.lit(1)).alias("points"), F.max("point").alias("latest"))


def _generations(spark, d):
    """The change log as a journal with generations: signups of small keys open one, purchases of small keys make it ready."""
    c = m.changes(spark, d)
    opens = (F.col("kind") == "signup") & (F.col("key") < 20)
    ready = (F.col("kind") == "purchase") & (F.col("key") < 20)
    op = F.when(opens, "start").when(ready, "ready").otherwise(F.col("op"))
    # only the changes that open a generation, which are few, are put in order; the others fall between two of them
    order = Window.partitionBy("_b").orderBy("_from")
    starts = c.where(opens).select(F.col("bucket").alias("_b"), F.col("seq").alias("_from"))
    spans = starts.withColumns({"_g": F.row_number().over(order).cast("long"), "_until": F.lead("_from").over(order)})
    inside = (F.col("bucket") == F.col("_b")) & (F.col("seq") >= F.col("_from")) & (F.col("_until").isNull() | (F.col("seq") < F.col("_until")))
    return c.join(spans, inside, "left").select("bucket", "key", "seq", op.alias("op"), F.coalesce("_g", F.lit(0).cast("long")).alias("generation"), "size")


GENERATIONS = """, g AS (SELECT bucket, key, seq, size, CASE WHEN kind = 'signup' AND key < 20 THEN 'start' WHEN kind = 'purchase' AND key < 20 THEN 'ready' ELSE op END AS op,
CAST(sum(CASE WHEN kind = 'signup' AND key < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY bucket ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS generation FROM changes),
ready AS (SELECT bucket, arg_max(generation, seq) AS generation FROM g WHERE op = 'ready' GROUP BY bucket),
kept AS (SELECT g.*, row_number() OVER (PARTITION BY g.bucket, key ORDER BY seq DESC) AS rn FROM g JOIN ready ON g.bucket = ready.bucket AND g.generation = ready.generation WHERE op IN ('put', 'delete'))"""


def replay_catalog(spark, d):
    return h.replay(_generations(spark, d)).select("bucket", "key", "seq", "size")


def replay_strict(spark, d):
    """Per bucket of a journal with faults: the first change a strict reader refuses, and what is in the catalogue before it."""
    rows, buckets = h.replay_strict(m.journal(spark, d))
    kept = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("keys"), F.sum("size").alias("bytes"))
    return buckets.join(kept, "bucket", "left").select("bucket", "failed_at", "reason", "paused", F.coalesce("keys", F.lit(0)).alias("keys"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


STRICT = """, o AS (SELECT *, seq = 1 OR lag(seq) OVER b IS NOT DISTINCT FROM seq - 1 AS follows,
  arg_max(CASE op WHEN 'start' THEN generation ELSE 0 END, seq) FILTER (WHERE op IN ('start', 'drop')) OVER p AS newest, max(seq) FILTER (WHERE op IN ('start', 'drop')) OVER p AS opened, max(seq) FILTER (WHERE op = 'ready') OVER p AS published
  FROM journal WINDOW b AS (PARTITION BY bucket ORDER BY seq), p AS (PARTITION BY bucket ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CASE WHEN NOT follows THEN 'sequence' WHEN op = 'start' AND generation <> coalesce(newest, 0) + 1 THEN 'generation' WHEN op <> 'start' AND coalesce(newest, 0) = 0 THEN 'baseline'
  WHEN op <> 'start' AND generation <> newest THEN 'identity' WHEN op = 'ready' AND published > opened THEN 'published' END AS reason FROM o),
v AS (SELECT bucket, min(seq) AS failed_at, arg_min(reason, seq) AS reason FROM f WHERE reason IS NOT NULL GROUP BY bucket),
ok AS (SELECT j.* FROM journal j LEFT JOIN v USING (bucket) WHERE failed_at IS NULL OR seq < failed_at),
z AS (SELECT bucket, arg_max(generation, seq) FILTER (WHERE op = 'ready') AS ready, max(seq) FILTER (WHERE op = 'ready') AS ready_at, coalesce(max(seq) FILTER (WHERE op = 'drop'), 0) AS dropped, coalesce(arg_max(op, seq) FILTER (WHERE op IN ('start', 'pause', 'resume', 'drop')) = 'pause', false) AS paused FROM ok GROUP BY bucket),
k AS (SELECT ok.*, row_number() OVER (PARTITION BY ok.bucket, key ORDER BY seq DESC) AS rn FROM ok JOIN z USING (bucket) WHERE op IN ('put', 'delete') AND generation = ready AND ready_at > dropped AND seq > dropped),
s AS (SELECT bucket, count(*) AS keys, sum(size) AS bytes FROM k WHERE rn = 1 AND op = 'put' GROUP BY bucket)
SELECT bucket, failed_at, reason, coalesce(paused, false) AS paused, coalesce(keys, 0) AS keys, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT bucket FROM journal) LEFT JOIN v USING (bucket) LEFT JOIN z USING (bucket) LEFT JOIN s USING (bucket)"""


def replay_sequence_check(spark, d):
    return h.sequence_gaps(m.changes(spark, d)).groupBy("bucket").agg(F.count(F.lit(1)).alias("gaps"), F.max(F.col("seq") - F.col("before")).alias("widest"))


def snapshot_plus_tail(spark, d):
    """The snapshot at the cut with the log behind it gives the same catalogue as the whole log."""
    snapshot = h.as_of(_until(spark, d), ["bucket", "key"])
    tail = m.changes(spark, d).crossJoin(_cut(spark, d)).where("seq > cut").drop("cut")
    return h.live(snapshot.unionByName(tail), ["bucket", "key"]).select("bucket", "key", "seq", "size")


def snapshot_deltas(spark, d):
    """What a new snapshot writes over its parent: changed slots, and old ones carried on."""
    last = h.as_of(m.changes(spark, d), ["bucket", "key"]).crossJoin(_cut(spark, d))
    kind = F.when(F.col("seq") > F.col("cut"), "delta").when(F.col("op") == "delete", "tombstone").otherwise("carried")
    return last.groupBy("bucket", kind.alias("kind")).agg(F.count(F.lit(1)).alias("slots"), F.sum("size").alias("bytes"))


def snapshot_waste_score(spark, d):
    """Per family of keys: live and superseded bytes, and the share that is waste."""
    flagged = h.with_latest_flag(m.changes(spark, d), ["bucket", "key"])
    kept = F.col("latest") & (F.col("op") == "put")
    sums = flagged.groupBy((F.col("key") % 16).alias("family")).agg(F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).alias("live"), F.coalesce(F.sum(F.when(~kept, F.col("size"))), F.lit(0)).alias("superseded"))
    return sums.withColumn("waste", F.round(F.try_divide(F.col("superseded"), F.col("live") + F.col("superseded")), 6))


def snapshot_slots(spark, d):
    """Slots of a snapshot: keys that start with a tilde are escaped."""
    parts = table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "~").otherwise(""), F.col("p_name")).alias("key"))
    return parts.select("p_partkey", fx.slot(F.col("key")).alias("slot"))


def overlay_drafts(spark, d):
    """Drafts override the inputs that have the same key."""
    inputs = m.changes(spark, d).where("kind = 'view'").groupBy("key").agg(F.max("seq").alias("seq")).select("key", "seq", F.lit("input").alias("origin"))
    drafts = m.changes(spark, d).where("kind = 'purchase' AND size > 9000").groupBy("key").agg(F.max("seq").alias("seq")).select("key", "seq", F.lit("draft").alias("origin"))
    return drafts.unionByName(inputs.join(drafts.select("key"), "key", "left_anti"))


def mint_sequences(spark, d):
    last = F.col("bucket_id") * 1000
    return h.mint_sequences(m.objects(spark, d), "bucket_id", ["modified", "object_id"], last).select("bucket_id", "object_id", "seq")


def prioritised_alternative(spark, d):
    """The preferred change of each key by kind, then by newest."""
    rank = F.when(F.col("kind") == "purchase", 0).when(F.col("kind") == "click", 1).when(F.col("kind") == "view", 2).otherwise(3)
    best = F.row_number().over(Window.partitionBy("key").orderBy(rank, F.desc("seq")))
    return m.changes(spark, d).withColumn("_r", best).where("_r = 1").select("key", "kind", "seq")


def orphan_history(spark, d):
    """Keys with history but no live head, that no customer with a debt stands for either."""
    c = m.changes(spark, d)
    heads = h.live(c, ["bucket", "key"]).select("key")
    named = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("key"))
    return c.join(heads, "key", "left_anti").join(named, "key", "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("versions"), F.max("seq").alias("last_seq"))


def reconcile_diff(spark, d):
    """Each object's source size against what its extents hold at the target."""
    target = m.extents(spark, d).groupBy("stream_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("held"))
    source = m.objects(spark, d).where("object_id % 4 <> 1").select("object_id", (F.col("size") % 200).alias("size"))
    both = source.join(target, F.col("object_id") == F.col("stream_id"), "full_outer")
    outcome = F.when(F.col("object_id").isNull(), "extra").when(F.col("stream_id").isNull(), "absent").when(F.col("size") == F.col("held"), "same").when(F.col("size") > F.col("held"), "behind").otherwise("conflict")
    return both.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("held"), F.lit(0)).alias("held"))


def replica_lag(spark, d):
    """Namespaces whose source revision is ahead of the replica's."""
    c = m.changes(spark, d)
    source = c.groupBy("key").agg(F.max("seq").alias("revision"))
    replica = c.where("kind IN ('view', 'click')").groupBy("key").agg(F.max("seq").alias("applied"))
    return source.join(replica, "key", "left").where(F.col("revision") > F.coalesce("applied", F.lit(0))).select("key", "revision", (F.col("revision") - F.coalesce("applied", F.lit(0))).alias("lag"))


def coalesced_changes(spark, d):
    """One pending change per task and key: the newest, with how many it stands for."""
    return m.changes(spark, d).groupBy("bucket", "key").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("merged"))


def keep_newest(spark, d):
    """All but each key's three newest versions, which retention deletes."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return m.changes(spark, d).withColumn("_r", rank).where("_r > 3").groupBy("key").agg(F.count(F.lit(1)).alias("expired"), F.max("seq").alias("newest_expired"))


def two_hop_links(spark, d):
    """Neighbours of neighbours over replication links, from both ends."""
    links = table(spark, d, "nation").select(F.col("n_nationkey").alias("a"), F.pmod(F.col("n_nationkey") * 7 + 3, F.lit(25)).alias("b"))
    both = links.union(links.select("b", "a")).distinct()
    far = both.alias("x").join(both.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
    return both.union(far).where("a <> b").distinct().groupBy("a").agg(F.count(F.lit(1)).alias("reach"), F.sum("b").cast("long").alias("total"))


LATEST = sql("SELECT bucket, key, seq, op, seq = max(seq) OVER (PARTITION BY bucket, key) AS latest FROM changes", "changes")
QUERIES = {
    # one query under two names
    "versions_latest_flag": (versions_latest_flag, LATEST),
    "versions_latest_flag_whole": (versions_latest_flag, LATEST),
    "as_of_state": (as_of_state, sql(OLD + " SELECT bucket, key, seq, size FROM old WHERE op = 'put'", "changes")),
    "restore_plan": (restore_plan, sql(PLAN + f" SELECT bucket, key, source_seq, current_seq, {STATE} AS state FROM j", "changes")),
    "restore_plan_counts": (restore_plan_counts, sql(PLAN + f", u AS (SELECT 'in place' AS mode, {STATE} AS state FROM j UNION ALL SELECT 'elsewhere', {ELSEWHERE} FROM j) SELECT mode, state, count(*) AS keys FROM u WHERE state IS NOT NULL GROUP BY mode, state", "changes")),
    "recovery_window_gaps": (
        recovery_window_gaps,
        sql(", gaps AS (SELECT bucket, min(seq) AS lo, max(seq) AS hi FROM changes WHERE op = 'delete' AND size > 5000 GROUP BY bucket, date_trunc('hour', stamp) HAVING max(seq) > min(seq)), p AS (SELECT bucket, max(seq) AS point FROM changes GROUP BY bucket, date_trunc('day', stamp)) SELECT bucket, count(*) AS points, max(point) AS latest FROM p WHERE NOT EXISTS (SELECT 1 FROM gaps g WHERE g.bucket = p.bucket AND point > lo AND point < hi) GROUP BY bucket", "changes"),
    ),
    "replay_catalog": (replay_catalog, sql(GENERATIONS + " SELECT bucket, key, seq, size FROM kept WHERE rn = 1 AND op = 'put'", "changes")),
    "replay_strict": (replay_strict, sql(STRICT, "journal")),
    "replay_sequence_check": (replay_sequence_check, sql(", l AS (SELECT bucket, seq, lag(seq) OVER (PARTITION BY bucket ORDER BY seq) AS before FROM changes) SELECT bucket, count(*) AS gaps, max(seq - before) AS widest FROM l WHERE before IS NOT NULL AND seq <> before + 1 GROUP BY bucket", "changes")),
    "snapshot_plus_tail": (snapshot_plus_tail, sql(LAST + " SELECT bucket, key, seq, size FROM last WHERE op = 'put'", "changes")),
    "snapshot_deltas": (snapshot_deltas, sql(CUT_SQL + LAST + ", k AS (SELECT bucket, size, CASE WHEN seq > (SELECT cut FROM cut) THEN 'delta' WHEN op = 'delete' THEN 'tombstone' ELSE 'carried' END AS kind FROM last) SELECT bucket, kind, count(*) AS slots, CAST(sum(size) AS BIGINT) AS bytes FROM k GROUP BY bucket, kind", "changes")),
    "snapshot_waste_score": (
        snapshot_waste_score,
        sql(", f AS (SELECT key % 16 AS family, size, seq = max(seq) OVER (PARTITION BY bucket, key) AND op = 'put' AS kept FROM changes), s AS (SELECT family, CAST(coalesce(sum(size) FILTER (WHERE kept), 0) AS BIGINT) AS live, CAST(coalesce(sum(size) FILTER (WHERE NOT kept), 0) AS BIGINT) AS superseded FROM f GROUP BY family) SELECT *, round(superseded / CAST(nullif(live + superseded, 0) AS DOUBLE), 6) AS waste FROM s", "changes"),
    ),
    "snapshot_slots": (snapshot_slots, "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '~~' || p_name ELSE p_name END AS slot FROM part"),
    "overlay_drafts": (
        overlay_drafts,
        sql(", i AS (SELECT key, max(seq) AS seq, 'input' AS origin FROM changes WHERE kind = 'view' GROUP BY key), dr AS (SELECT key, max(seq) AS seq, 'draft' AS origin FROM changes WHERE kind = 'purchase' AND size > 9000 GROUP BY key) SELECT * FROM dr UNION ALL SELECT * FROM i WHERE key NOT IN (SELECT key FROM dr)", "changes"),
    ),
    "mint_sequences": (mint_sequences, sql("SELECT bucket_id, object_id, bucket_id * 1000 + row_number() OVER (PARTITION BY bucket_id ORDER BY modified, object_id) AS seq FROM objects", "objects")),
    "prioritised_alternative": (
        prioritised_alternative,
        sql(", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE kind WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, seq DESC) AS rn FROM changes) SELECT key, kind, seq FROM r WHERE rn = 1", "changes"),
    ),
    "orphan_history": (
        orphan_history,
        sql(LAST + " SELECT key, count(*) AS versions, max(seq) AS last_seq FROM changes c WHERE NOT EXISTS (SELECT 1 FROM last WHERE last.key = c.key AND op = 'put') AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = c.key AND c_acctbal < 0) GROUP BY key", "changes"),
    ),
    "reconcile_diff": (
        reconcile_diff,
        sql(", t AS (SELECT stream_id, sum(hi - lo) AS held FROM extents GROUP BY stream_id), s AS (SELECT object_id, size % 200 AS size FROM objects WHERE object_id % 4 <> 1), j AS (SELECT *, CASE WHEN object_id IS NULL THEN 'extra' WHEN stream_id IS NULL THEN 'absent' WHEN size = held THEN 'same' WHEN size > held THEN 'behind' ELSE 'conflict' END AS outcome FROM s FULL JOIN t ON object_id = stream_id) SELECT outcome, count(*) AS keys, CAST(coalesce(sum(held), 0) AS BIGINT) AS held FROM j GROUP BY outcome", "objects", "extents"),
    ),
    "replica_lag": (
        replica_lag,
        sql(", s AS (SELECT key, max(seq) AS revision, max(seq) FILTER (WHERE kind IN ('view', 'click')) AS applied FROM changes GROUP BY key) SELECT key, revision, revision - coalesce(applied, 0) AS lag FROM s WHERE revision > coalesce(applied, 0)", "changes"),
    ),
    "coalesced_changes": (coalesced_changes, sql("SELECT bucket, key, arg_max(op, seq) AS op, max(seq) AS seq, count(*) AS merged FROM changes GROUP BY bucket, key", "changes")),
    "keep_newest": (keep_newest, sql(", r AS (SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM changes) SELECT key, count(*) AS expired, max(seq) AS newest_expired FROM r WHERE rn > 3 GROUP BY key", "changes")),
    "two_hop_links": (
        two_hop_links,
        "WITH l AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), b AS (SELECT a, b FROM l UNION SELECT b, a FROM l), f AS (SELECT a, b FROM b UNION SELECT x.a, y.b FROM b x JOIN b y ON x.b = y.a) SELECT a, count(*) AS reach, CAST(sum(b) AS BIGINT) AS total FROM f WHERE a <> b GROUP BY a",
    ),
}
