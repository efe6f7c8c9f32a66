"""Browsing the catalogue: filters, search, folders, export previews, keys and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytecairn.functions import text as fx
from bytecairn.sources import model as m
from bytecairn.sources.model import sql, table


def catalog_filter(rows, *, prefix=None, exact=None, contains=None, category=None, public=None, smallest=None, largest=None, since=None, until=None, through=None, after=None):
    """Optional conditions on objects. ``exact``, like a search, is taken behind the prefix; ``through`` includes its instant, ``until`` does not;
    ``after`` is the last key of the page before. ``category`` and ``public`` need columns of these names."""
    if exact is not None:
        rows = rows.where(F.col("key") == (prefix or "") + exact)
    if contains is not None:
        rows = rows.where(fx.contains(F.col("key"), contains))
    if category is not None:
        rows = rows.where(F.col("category") == category)
    if public is not None:
        rows = rows.where(F.col("public") == F.lit(public))
    if through is not None:
        rows = rows.where(F.col("modified") <= F.lit(through).cast("timestamp_ntz"))
    if prefix is not None:
        rows = rows.where(F.col("key").startswith(prefix))
    if smallest is not None:
        rows = rows.where(F.col("size") >= smallest)
    if largest is not None:
        rows = rows.where(F.col("size") <= largest)
    if since is not None:
        rows = rows.where(F.col("modified") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        rows = rows.where(F.col("modified") < F.lit(until).cast("timestamp_ntz"))
    if after is not None:
        rows = rows.where(F.col("key") > after)
    return rows


def catalog_filtered(spark, d):
    """Three filtered pages in one: by prefix, size, time and visibility; by exact name; by search and category."""
    rows = m.objects(spark, d).withColumns({"public": F.col("object_id") % 3 == 0, "category": F.col("state")})
    first = rows.where(F.col("key").startswith("1-URGENT/O/")).agg(F.min("object_id").alias("first"))
    ranged = catalog_filter(rows, prefix="2-HIGH/", smallest=100000, largest=300000, public=True, since="1996-01-01", through="1999-06-30")
    named = rows.join(F.broadcast(first), F.col("key") == F.concat(F.lit("1-URGENT/O/"), F.col("first").cast("string")), "left_semi")
    searched = catalog_filter(rows, contains="SPECI", category="P")
    return ranged.unionAll(named).unionAll(searched).select("object_id", "key", "size").distinct()


def json_containment(spark, d):
    """Rows whose JSON has a key, and those of them in which it has a value."""
    held = F.from_json("props", "map<string,bigint>")
    rows = table(spark, d, "events").select("event_type", held.alias("held")).where(F.map_contains_key("held", "k"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("held")["k"] == 7).alias("sevens"))


def residual_left_join(spark, d):
    """Where extents are read from: an encoding of their own, else their place in a pack, else nowhere yet."""
    c = m.chunks(spark, d)
    own = c.where("kind = 'encoding' AND stored % 3 <> 0").select(F.col("chunk_id").alias("l_chunk"), F.col("stored").alias("own"))
    members = c.where("kind = 'pack' OR (kind = 'encoding' AND chunk_id % 2 = 0)").select(F.col("chunk_id").alias("p_chunk"), F.col("stored").alias("packed"))
    first = m.extents(spark, d).join(own, F.col("chunk_id") == F.col("l_chunk"), "left")
    joined = first.join(members, F.col("l_chunk").isNull() & (F.col("chunk_id") == F.col("p_chunk")), "left")
    source = F.when(F.col("own").isNotNull(), "chunk").when(F.col("packed").isNotNull(), "pack").otherwise("pending")
    return joined.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("extents"), F.coalesce(F.sum(F.coalesce("own", "packed")), F.lit(0)).alias("bytes"))


def catalog_browse_name(spark, d):
    """A page by name: one row beyond the page says that there is more."""
    page = catalog_filter(m.objects(spark, d), prefix="1-URGENT/", smallest=50000, after="1-URGENT/F/1")
    return page.orderBy("key").limit(51).select("key", "size", "object_id")


def catalog_browse_size(spark, d):
    rows = catalog_filter(m.objects(spark, d), smallest=1000).where("size < 400000 OR (size = 400000 AND key > '2')")
    return rows.orderBy(F.desc("size"), "key").limit(51).select("key", "size", "object_id")


def catalog_browse_modified(spark, d):
    rows = catalog_filter(m.objects(spark, d), since="1993-01-01", until="1998-01-01")
    return rows.orderBy(F.desc("modified"), "key").limit(51).select("key", "modified", "object_id")


def catalog_contains(spark, d):
    """Literal search, Unicode lower-cased, in whole texts and in the names of parts."""
    docs = table(spark, d, "documents").where(fx.contains(F.col("text"), "ÉLLE")).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    parts = table(spark, d, "part").where(fx.contains(F.col("p_name"), "RED")).select(F.lit("part"), F.col("p_partkey"))
    short = table(spark, d, "part").where(fx.contains(F.col("p_type"), "S")).select(F.lit("prefix"), F.col("p_partkey"))
    return docs.unionAll(parts).unionAll(short)


def catalog_category(spark, d):
    pages = table(spark, d, "pages")
    key = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.element_at(F.array(*[F.lit(x) for x in ("", ".PNG", ".mp4", ".ogg", ".zip", ".pdf", ".bin")]), (F.col("page_id") % 7 + 1).cast("int")))
    mime = F.when(F.col("page_id") % 5 == 0, "text/html").when(F.col("page_id") % 11 == 0, "video/mp4").otherwise("application/octet-stream")
    return pages.select("page_id", fx.category(key, mime).alias("category"))


def list_common_prefixes(spark, d):
    rows = m.objects(spark, d).select(fx.common_prefix(F.col("key"), "").alias("prefix"), "size")
    below = m.objects(spark, d).where(F.col("key").startswith("2-HIGH/")).select(fx.common_prefix(F.col("key"), "2-HIGH/").alias("prefix"), "size")
    return rows.unionAll(below).groupBy("prefix").agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"))


def export_preview(spark, d):
    """The first ten keys of an export and its totals, which every row repeats."""
    chosen = m.objects(spark, d).where(F.col("key").startswith("3-MEDIUM/O/"))
    totals = chosen.agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"))
    return chosen.orderBy("key").limit(10).select("key", "size").crossJoin(F.broadcast(totals))


def _paths(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return table(spark, d, "pages").select(F.rtrim(path, F.lit("/")).alias("path")).distinct()


def path_collisions(spark, d):
    """Keys that are a file and also a folder of another key."""
    paths = _paths(spark, d)
    folders = paths.select(F.explode(fx.ancestors(F.col("path"))).alias("path")).distinct()
    hosts = paths.select(F.substring_index("path", "/", 1).alias("path")).distinct()
    return paths.unionAll(hosts).distinct().join(folders, "path", "left_semi")


def export_targets(spark, d):
    """Where each key lands: prefix stripped and joined; keys with empty, dot or dot-dot parts are refused."""
    rest = F.substring(F.col("path"), F.instr("path", "/") + 1, F.length("path"))
    bad = F.exists(F.split(rest, "/"), lambda p: p.isin("", ".", ".."))
    return _paths(spark, d).select("path", F.when(~bad, F.concat(F.lit("export/"), rest)).alias("target"))


def percent_encoded_keys(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" +%~/*é中")).alias("key"))
    urls = table(spark, d, "pages").select(-F.col("page_id") - 1, F.col("url"))
    return names.unionAll(urls).select("id", fx.percent_encode(F.col("key")).alias("encoded"))


def audit_filtered(spark, d):
    """Audit rows with long details cut, one kind, newest first."""
    detail = F.when(F.length("props") <= 8, F.col("props")).otherwise(F.lit('{"truncated":true}'))
    rows = table(spark, d, "events").where(F.col("event_type").isin("purchase", "error") & (F.col("user_id") > 20))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(201).select("event_id", "event_type", detail.alias("detail"))


def audit_export(spark, d):
    """The export keeps details whole and reads a number out of them."""
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.length("props").cast("long").alias("chars")).where("k > 50")


def json_membership(spark, d):
    """A condition over an array inside a JSON text."""
    doc = F.to_json(F.struct(F.array(F.col("user_id") % 7, F.col("user_id") % 11).alias("storages")))
    listed = F.from_json(doc, "storages array<bigint>")["storages"]
    return table(spark, d, "events").where(F.exists(listed, lambda x: x == 3)).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def visible_scope_mask(spark, d):
    """Objects a session may see: a permission bit, a list of buckets, sizes only for administrators."""
    may = F.col("c_custkey").bitwiseAND(F.lit(4)) != 0
    seen = table(spark, d, "customer").where(may & F.col("c_nationkey").isin(1, 3, 5, 7)).select(F.col("c_custkey").alias("bucket_id"), (F.col("c_custkey") % 3 == 0).alias("admin"))
    return m.objects(spark, d).join(seen, "bucket_id").select("object_id", "bucket_id", F.when(F.col("admin"), F.col("size")).alias("size"))


def empty_scope(spark, d):
    """An empty list of buckets is no bucket, not every bucket."""
    none = spark.createDataFrame([], "bucket_id bigint")
    return m.objects(spark, d).join(F.broadcast(none), "bucket_id", "left_semi").agg(F.count(F.lit(1)).alias("objects"))


def suffix_theta_join(spark, d):
    """Reserved-suffix collisions: part names that end with one of a fixed list of styles behind a delimiter."""
    styles = spark.createDataFrame([("ring", 1), ("bolt", 2), ("gear", 3), ("g", 4), ("1", 5)], "style string, style_id int")
    parts = table(spark, d, "part").select("p_partkey", F.translate("p_name", " #", "__").alias("key"))
    hit = F.col("key").endswith(F.concat(F.lit("_"), F.col("style"))) | F.col("key").endswith(F.concat(F.lit("-"), F.col("style")))
    return parts.join(F.broadcast(styles), hit).select("p_partkey", "style_id")


def duration_size_parse(spark, d):
    values = [("30s", 0), ("5m", 0), ("2h", 0), ("1d", 0), ("0s", 0), ("-1s", 0), ("x", 0), ("16MiB", 1), ("4KiB", 1), ("7B", 1), ("3GiB", 1), ("5mb", 1), ("9999999999999TiB", 1)]
    q = spark.createDataFrame(values, "quantity string, kind int")
    parsed = q.select("quantity", F.when(F.col("kind") == 0, fx.seconds(F.col("quantity"))).otherwise(fx.size_bytes(F.col("quantity"))).alias("value"))
    spread = table(spark, d, "part").select(F.concat((F.col("p_size") + 1).cast("string"), F.element_at(F.array(*[F.lit(u) for u in ("s", "m", "h", "d")]), F.col("p_size") % 4 + 1)).alias("quantity")).distinct()
    return parsed.unionAll(spread.select("quantity", fx.seconds(F.col("quantity"))))


def backoff_schedule(spark, d):
    attempts = table(spark, d, "events").groupBy("user_id").agg(F.least(F.count_if(F.col("event_type") == "error"), F.lit(12)).cast("int").alias("attempts"))
    steps = attempts.where("attempts > 0").select("user_id", F.explode(F.sequence(F.lit(1), F.col("attempts"))).alias("attempt"))
    return steps.select("user_id", "attempt", fx.backoff(F.col("attempt")).alias("delay"))


def wanted_probe(spark, d):
    """A parameter table of (bucket, state) pairs met with the objects."""
    wanted = spark.createDataFrame([(i, s) for i in range(1, 40) for s in ("F", "O")], "bucket_id bigint, state string")
    return m.objects(spark, d).join(F.broadcast(wanted), ["bucket_id", "state"]).groupBy("bucket_id", "state").agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"))


def positions_join(spark, d):
    """Ordered parts of every request met with stored parts by position."""
    asked = m.extents(spark, d).groupBy("stream_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("chunks"))
    placed = asked.select("stream_id", F.posexplode("chunks").alias("position", "chunk_id"))
    return placed.join(m.chunks(spark, d).select("chunk_id", "raw_size"), "chunk_id").where("position < raw_size / 100").select("stream_id", "position", "chunk_id")


_KEY = "regexp_replace(url, '[?#].*$', '') || ['', '.PNG', '.mp4', '.ogg', '.zip', '.pdf', '.bin'][page_id % 7 + 1]"
_MIME = "CASE WHEN page_id % 5 = 0 THEN 'text/html' WHEN page_id % 11 = 0 THEN 'video/mp4' ELSE 'application/octet-stream' END"
_PATHS = "paths AS (SELECT DISTINCT rtrim(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS path FROM pages)"

POSITIONS = sql(", p AS (SELECT stream_id, chunk_id, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY chunk_id) - 1 AS INTEGER) AS position FROM (SELECT DISTINCT stream_id, chunk_id FROM extents)) SELECT stream_id, position, chunk_id FROM p JOIN chunks USING (chunk_id) WHERE position < raw_size / 100.0", "extents", "chunks")
QUERIES = {
    "catalog_browse_name": (catalog_browse_name, sql("SELECT key, size, object_id FROM objects WHERE starts_with(key, '1-URGENT/') AND size >= 50000 AND key > '1-URGENT/F/1' ORDER BY key LIMIT 51", "objects")),
    "catalog_browse_size": (catalog_browse_size, sql("SELECT key, size, object_id FROM objects WHERE size >= 1000 AND (size < 400000 OR (size = 400000 AND key > '2')) ORDER BY size DESC, key LIMIT 51", "objects")),
    "catalog_browse_modified": (catalog_browse_modified, sql("SELECT key, modified, object_id FROM objects WHERE modified >= TIMESTAMP '1993-01-01' AND modified < TIMESTAMP '1998-01-01' ORDER BY modified DESC, key LIMIT 51", "objects")),
    "catalog_contains": (
        catalog_contains,
        "SELECT 'document' AS kind, doc_id AS id FROM documents WHERE contains(lower(text), 'élle') UNION ALL SELECT 'part', p_partkey FROM part WHERE contains(lower(p_name), 'red') UNION ALL SELECT 'prefix', p_partkey FROM part WHERE starts_with(lower(p_type), 's')",
    ),
    "catalog_category": (
        catalog_category,
        f"WITH p AS (SELECT page_id, lower({_KEY}) AS key, {_MIME} AS mime FROM pages) SELECT page_id, CASE "
        + " ".join(f"WHEN regexp_matches(mime, '{types}') OR regexp_matches(key, '{extensions}') THEN '{name}'" for name, types, extensions in fx.CATEGORIES)
        + " ELSE 'other' END AS category FROM p",
    ),
    "list_common_prefixes": (
        list_common_prefixes,
        sql("SELECT prefix, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT split_part(key, '/', 1) || '/' AS prefix, size FROM objects UNION ALL SELECT '2-HIGH/' || split_part(key, '/', 2) || '/', size FROM objects WHERE starts_with(key, '2-HIGH/')) GROUP BY prefix", "objects"),
    ),
    "export_preview": (export_preview, sql(", c AS (SELECT * FROM objects WHERE starts_with(key, '3-MEDIUM/O/')) SELECT key, size, (SELECT count(*) FROM c) AS objects, (SELECT CAST(sum(size) AS BIGINT) FROM c) AS bytes FROM c ORDER BY key LIMIT 10", "objects")),
    "path_collisions": (
        path_collisions,
        f"WITH {_PATHS}, everything AS (SELECT path FROM paths UNION SELECT split_part(path, '/', 1) FROM paths) SELECT path FROM everything a WHERE EXISTS (SELECT 1 FROM paths b WHERE starts_with(b.path, a.path || '/')) OR (NOT contains(path, '/') AND EXISTS (SELECT 1 FROM paths b WHERE b.path = a.path))",
    ),
    "export_targets": (
        export_targets,
        f"WITH {_PATHS}, r AS (SELECT path, substr(path, instr(path, '/') + 1) AS rest FROM paths) SELECT path, CASE WHEN NOT list_has_any(string_split(rest, '/'), ['', '.', '..']) THEN 'export/' || rest END AS target FROM r",
    ),
    "percent_encoded_keys": (
        percent_encoded_keys,
        "SELECT id, replace(url_encode(key), '%2F', '/') AS encoded FROM (SELECT p_partkey AS id, p_name || ' +%~/*é中' AS key FROM part UNION ALL SELECT -page_id - 1, url FROM pages)",
    ),
    "audit_filtered": (
        audit_filtered,
        "SELECT event_id, event_type, CASE WHEN length(props) <= 8 THEN props ELSE '{\"truncated\":true}' END AS detail FROM events WHERE event_type IN ('purchase', 'error') AND user_id > 20 ORDER BY ts DESC, event_id DESC LIMIT 201",
    ),
    "audit_export": (audit_export, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, length(props) AS chars FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50"),
    "json_membership": (json_membership, "SELECT event_type, count(*) AS events FROM events WHERE user_id % 7 = 3 OR user_id % 11 = 3 GROUP BY event_type"),
    "visible_scope_mask": (
        visible_scope_mask,
        sql("SELECT object_id, bucket_id, CASE WHEN bucket_id % 3 = 0 THEN size END AS size FROM objects JOIN buckets USING (bucket_id) WHERE (bucket_id & 4) <> 0 AND project_id IN (1, 3, 5, 7)", "objects", "buckets"),
    ),
    "empty_scope": (empty_scope, "SELECT count(*) AS objects FROM orders WHERE o_custkey IN (NULL)"),
    "suffix_theta_join": (
        suffix_theta_join,
        "WITH s(style, style_id) AS (VALUES ('ring', 1), ('bolt', 2), ('gear', 3), ('g', 4), ('1', 5)) SELECT p_partkey, style_id FROM part JOIN s ON ends_with(translate(p_name, ' #', '__'), '_' || style) OR ends_with(translate(p_name, ' #', '__'), '-' || style)",
    ),
    "duration_size_parse": (
        duration_size_parse,
        "WITH v(quantity, value) AS (VALUES ('30s', 30), ('5m', 300), ('2h', 7200), ('1d', 86400), ('0s', NULL), ('-1s', NULL), ('x', NULL), ('16MiB', 16777216), ('4KiB', 4096), ('7B', 7), ('3GiB', 3221225472), ('5mb', NULL), ('9999999999999TiB', NULL)) SELECT quantity, CAST(value AS BIGINT) AS value FROM v UNION ALL SELECT DISTINCT (p_size + 1) || ['s', 'm', 'h', 'd'][p_size % 4 + 1], CAST((p_size + 1) * [1, 60, 3600, 86400][p_size % 4 + 1] AS BIGINT) FROM part",
    ),
    "backoff_schedule": (
        backoff_schedule,
        "WITH a AS (SELECT user_id, least(count(*) FILTER (WHERE event_type = 'error'), 12) AS n FROM events GROUP BY user_id), s AS (SELECT user_id, CAST(unnest(range(1, n + 1)) AS INTEGER) AS attempt FROM a) SELECT user_id, attempt, CAST(least(300, pow(2, least(attempt, 8))) AS BIGINT) AS delay FROM s",
    ),
    "wanted_probe": (
        wanted_probe,
        sql(", wanted AS (SELECT unnest(range(1, 40)) AS bucket_id) SELECT bucket_id, state, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM objects JOIN wanted USING (bucket_id) WHERE state IN ('F', 'O') GROUP BY bucket_id, state", "objects"),
    ),
    # one query under two names
    "positions_join": (positions_join, POSITIONS),
    "positions_join_whole": (positions_join, POSITIONS),
    "catalog_filtered": (
        catalog_filtered,
        sql("SELECT object_id, key, size FROM objects WHERE (starts_with(key, '2-HIGH/') AND size BETWEEN 100000 AND 300000 AND object_id % 3 = 0 AND modified >= TIMESTAMP '1996-01-01' AND modified <= TIMESTAMP '1999-06-30') OR key = '1-URGENT/O/' || (SELECT min(object_id) FROM objects WHERE starts_with(key, '1-URGENT/O/')) OR (contains(lower(key), 'speci') AND state = 'P')", "objects"),
    ),
    "json_containment": (json_containment, "SELECT event_type, count(*) AS events, count(*) FILTER (WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 7) AS sevens FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY event_type"),
    "residual_left_join": (
        residual_left_join,
        sql(", l AS (SELECT chunk_id, stored FROM chunks WHERE kind = 'encoding' AND stored % 3 <> 0), p AS (SELECT chunk_id, source, stored FROM chunks WHERE kind = 'pack' OR (kind = 'encoding' AND chunk_id % 2 = 0)), j AS (SELECT e.stream_id, l.stored AS own, p.stored AS packed FROM extents e LEFT JOIN l ON l.chunk_id = e.chunk_id LEFT JOIN p ON l.chunk_id IS NULL AND p.chunk_id = e.chunk_id) SELECT CASE WHEN own IS NOT NULL THEN 'chunk' WHEN packed IS NOT NULL THEN 'pack' ELSE 'pending' END AS source, count(*) AS extents, CAST(coalesce(sum(coalesce(own, packed)), 0) AS BIGINT) AS bytes FROM j GROUP BY 1", "extents", "chunks"),
    ),
}
