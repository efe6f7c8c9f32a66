"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

Two lines are duplicates when their edit distance (code points) is at most ``EDITS`` (one; ``dedup_lines`` also takes none and two). A line occurrence is kept
if no earlier occurrence, in order of (doc_id, text hash, line number), is a duplicate of it; every other
occurrence is dropped. Lines of fewer than ``MIN_CHARS`` characters go only as exact repeats, since one edit turns one short
word into another; with ``min_chars=1`` the edit bound holds for every line. Blank lines are always kept.

How the join stays small without losing a link. An edit changes one place, so of two duplicate lines cut
into segments at the same places, all but one segment agree. Lines whose prefix half or suffix half no
other line shares are out; for the few left the same is asked of sixteenths. Only then are the deletion
variants emitted, and only those inside the one segment where the edit can be. Equal variants meet under a
128-bit key of everything outside the segment and the variant:

- same length: all lines that lose the same position to the same variant differ there only, so they are
  mutual duplicates and the earliest of them stands for the group;
- lengths one apart: the longer line's variant equals the shorter line's segment.

Hence the earliest duplicate is a minimum over groups; no pairs within a group are made. The edit distance
of every accepted pair is then verified on its segments, all else being equal.

Defined cases: null texts stay null and have no lines; a null doc_id orders first; repeated rows (same
doc_id and text) count as one document and keep the same lines; lines that end in a carriage return keep
it. Extra columns, whatever their names, pass through ``dedup_lines``, but for n_lines and n_dropped, which it sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_parallel, materialise, packed, table, unpacked

MIN_CHARS = 20
SEGMENTS = 16
EDITS = 1
#: Lines that may have a near duplicate are looked up by broadcast up to this many (of some 40 bytes each), by shuffle beyond it.
BROADCAST_ROWS = 1_000_000
#: An exclusive-or that makes a join key of its own, so that both sides are dealt anew and Spark can split a hot one.
DEAL = 0x5DEECE66D


def _key(*parts: Column) -> Column:
    """128 bits of the parts, told apart by their lengths."""
    sized = [x for p in parts for x in (F.length(p), p)]
    return F.struct(F.xxhash64(*sized).alias("a"), F.xxhash64(F.lit(7), *sized).alias("b"))


def _cut(j: Column, m: Column, segments: int) -> Column:
    return F.floor(j * m / F.lit(segments)).cast("int")


def _half_keys(line: Column) -> Column:
    """What two lines within one edit share: a half, for ``m`` as the shorter length of the pair.

    Element ``2 * longer + j`` stands outside half ``j``; a line of length L is the shorter or equal one of
    a pair for m = L and the longer one for m = L - 1.
    """
    keys = []
    for longer in (0, 1):
        m = F.length(line) - longer
        half = _cut(F.lit(1), m, 2)
        keys.append(F.xxhash64(m, F.lit(0), F.substring(line, F.length(line) - (m - half) + 1, m - half)))
        keys.append(F.xxhash64(m, F.lit(1), F.substring(line, F.lit(1), half)))
    return F.array(*keys)


def _lines(documents: DataFrame) -> DataFrame:
    """All lines but blank ones: place (doc_id, h, no), line."""
    numbered = in_parallel(documents.select("doc_id", "text")).select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return numbered.where(F.trim("line") != "").select(F.struct("doc_id", "h", "no").alias("place"), "line")


def _distinct_lines(documents: DataFrame, min_chars: int) -> DataFrame:
    """Each distinct line: its first place and its half keys (none for a short line); no texts."""
    halves = F.when(F.length("line") >= min_chars, _half_keys(F.col("line"))).otherwise(F.array().cast("array<bigint>"))
    keyed = _lines(documents).select(_key(F.col("line")).alias("id"), "place", halves.alias("halves"))
    return keyed.groupBy("id").agg(F.min("place").alias("place"), F.first("halves").alias("halves"))


def _with_partner(rows: DataFrame, key: str, tag: Column) -> DataFrame:
    """Rows whose key also occurs with another tag."""
    shared = rows.groupBy(key).agg(F.min(tag).alias("lo"), F.max(tag).alias("hi")).where(F.col("lo") != F.col("hi"))
    return rows.withColumn("_deal", F.col(key).bitwiseXOR(F.lit(DEAL))).join(shared.select(F.col(key).bitwiseXOR(F.lit(DEAL)).alias("_deal")), "_deal", "left_semi").drop("_deal")


def _suspects(documents: DataFrame, distinct: DataFrame) -> DataFrame:
    """Lines that share a half with another line, with their texts: place, line, longer, j."""
    halves = distinct.select("id", "place", F.posexplode("halves").alias("c", "half"))
    found = materialise(_with_partner(halves, "half", F.col("id.a")).select("place", "c"))
    by_doc = found.groupBy(F.col("place.doc_id").alias("_doc"), F.col("place.h").alias("_h")).agg(F.collect_list(F.struct(F.col("place.no").alias("no"), "c")).alias("_want"))
    if found.count() <= BROADCAST_ROWS:
        by_doc = F.broadcast(by_doc)
    keyed = documents.select("doc_id", "text", F.xxhash64("text").alias("h"))
    joined = keyed.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")), "inner")
    lines = joined.select("doc_id", "h", F.split("text", "\n").alias("_lines"), F.explode("_want").alias("_w"))
    c = F.col("_w.c")
    return lines.select(F.struct("doc_id", "h", F.col("_w.no").alias("no")).alias("place"), F.get("_lines", F.col("_w.no")).alias("line"), F.floor(c / 2).cast("int").alias("longer"), (c % 2).alias("j"))


def _segments(suspects: DataFrame) -> DataFrame:
    """The sixteenths of the half that may differ: place, longer, outside (128 bits), w (the segment)."""
    half = SEGMENTS // 2
    cut = suspects.withColumn("n", F.length("line")).withColumn("m", F.col("n") - F.col("longer"))
    cut = cut.withColumn("s", F.explode(F.sequence(F.col("j") * half, F.col("j") * half + half - 1)))
    cut = cut.withColumn("lo", _cut(F.col("s"), F.col("m"), SEGMENTS)).withColumn("hi", F.col("m") - _cut(F.col("s") + 1, F.col("m"), SEGMENTS))
    before, behind = F.substring(F.col("line"), F.lit(1), F.col("lo")), F.substring(F.col("line"), F.col("n") - F.col("hi") + 1, F.col("hi"))
    outside = _key(F.col("m").cast("string"), F.col("s").cast("string"), before, behind)
    return cut.select("place", "longer", outside.alias("outside"), F.substring(F.col("line"), F.col("lo") + 1, F.col("n") - F.col("lo") - F.col("hi")).alias("w")).withColumn("oa", F.col("outside.a"))


def _row(df: DataFrame, role: int, *parts: Column) -> DataFrame:
    """Role 0: all rows of a key are duplicates of each other; roles 1 and 2: each of one is a duplicate of each of the other."""
    return df.select("place", "w", _key(*parts).alias("key"), F.lit(role).alias("role"))


def _earlier(keys: DataFrame, edits: int) -> DataFrame:
    """Places whose key some earlier line of the fitting role has, the edit distance being verified."""
    group = Window.partitionBy("key")
    best = lambda role: F.min(F.when(F.col("role") == role, F.struct("place", "w"))).over(group)
    met = keys.select("place", "w", "role", best(0).alias("b0"), best(1).alias("b1"), best(2).alias("b2"))
    other = F.when(F.col("role") == 0, F.col("b0")).when(F.col("role") == 1, F.col("b2")).otherwise(F.col("b1"))
    near = met.withColumn("other", other).where(F.col("other.place") < F.col("place"))
    return near.where(F.levenshtein(F.col("w"), F.col("other.w")) <= edits).select("place").distinct()


def _without(text: Column, at: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text)))


def near_duplicates(documents: DataFrame, distinct: DataFrame) -> DataFrame:
    """Distinct lines, by place, with an earlier line within one edit."""
    segments = materialise(_with_partner(_segments(_suspects(documents, distinct)), "oa", F.xxhash64("place")))
    cut = segments.where(F.length("w") > 0).withColumn("p", F.explode(F.sequence(F.lit(1), F.length("w"))))
    variant = _without(F.col("w"), F.col("p"))
    base = [F.col("outside.a").cast("string"), F.col("outside.b").cast("string")]
    same = _row(cut.where(F.col("longer") == 0), 0, *base, F.lit("="), F.col("p").cast("string"), variant)
    long = _row(cut.where(F.col("longer") == 1), 1, *base, F.lit("+"), variant)
    short = _row(segments.where(F.col("longer") == 0), 2, *base, F.lit("+"), F.col("w"))
    return _earlier(same.unionByName(long).unionByName(short), 1)


def near_duplicates_of_two(documents: DataFrame, min_chars: int) -> DataFrame:
    """Distinct lines, by place, with an earlier line within two edits, from the variants of one and two deletions of whole lines.

    A line gives rows by the square of its length, so this is for tables of short lines. Of two edits, two substitutions leave equal
    rests at equal places; an insertion and a deletion leave equal rests; a substitution and a deletion leave equal rests
    with the substituted place at the same index of the rest; two deletions leave the shorter line.
    """
    lines = _lines(documents).where(F.length("line") >= min_chars)
    firsts = lines.groupBy(_key(F.col("line")).alias("id")).agg(F.min(F.struct("place", "line")).alias("first")).select("first.place", F.col("first.line").alias("w"))
    one = firsts.where(F.length("w") > 0).withColumn("p", F.explode(F.sequence(F.lit(1), F.length("w")))).withColumn("v", _without(F.col("w"), F.col("p")))
    two = one.where(F.col("p") <= F.length("v")).withColumn("q", F.explode(F.sequence(F.col("p"), F.length("v")))).withColumn("v2", _without(F.col("v"), F.col("q")))
    text = lambda c: F.col(c).cast("string")
    rows = [
        _row(one, 0, F.lit("1="), F.col("v")), _row(two, 0, F.lit("2="), text("p"), text("q"), F.col("v2")),
        _row(one, 1, F.lit("1+"), F.col("v")), _row(firsts, 2, F.lit("1+"), F.col("w")),
        _row(two, 1, F.lit("2+"), F.col("v2")), _row(firsts, 2, F.lit("2+"), F.col("w")),
        # q counts in the rest of the first deletion already, so both places are indices of the common rest
        _row(two, 1, F.lit("1s"), text("p"), F.col("v2")), _row(two, 1, F.lit("1s"), text("q"), F.col("v2")), _row(one, 2, F.lit("1s"), text("p"), F.col("v")),
    ]
    keys = rows[0]
    for more in rows[1:]:
        keys = keys.unionByName(more)
    return _earlier(keys, 2)


def kept_places(documents: DataFrame, min_chars: int = MIN_CHARS, edits: int = EDITS) -> DataFrame:
    """The place of every line occurrence that stays."""
    distinct = materialise(_distinct_lines(documents, min_chars))
    kept = distinct.select("place")
    if edits:
        near = near_duplicates(documents, distinct) if edits == 1 else near_duplicates_of_two(documents, min_chars)
        kept = kept.join(near, "place", "left_anti")
    return kept.select("place.doc_id", F.col("place.h").alias("_text_hash"), F.col("place.no").alias("_no"))


def _marks(kept: Column, n_lines: Column) -> Column:
    """One character a line, '1' for kept, from the sorted line numbers: linear in both."""
    gap = lambda k, i: k - F.coalesce(F.get(kept, i - 1), F.lit(-1)) - 1
    marks = F.array_join(F.transform(kept, lambda k, i: F.concat(F.repeat(F.lit("0"), gap(k, i)), F.lit("1"))), "")
    return F.split(F.rpad(marks, n_lines, F.lit("0")), "")


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, edits: int = EDITS) -> DataFrame:
    """``documents`` with duplicate lines (up to ``edits``, 0 to 2) removed from ``text``, plus n_lines and n_dropped."""
    if edits not in (0, 1, 2):
        raise ValueError("the edit bound is 0, 1 or 2")
    kept = kept_places(documents.select("doc_id", "text"), min_chars, edits).groupBy(F.col("doc_id").alias("_doc"), F.col("_text_hash").alias("_hash")).agg(F.sort_array(F.collect_set("_no")).alias("_kept"))
    keyed = packed(documents, F.col("doc_id").alias("_key"), F.xxhash64("text").alias("_text_key"))
    joined = keyed.join(kept, F.col("_key").eqNullSafe(F.col("_doc")) & F.col("_text_key").eqNullSafe(F.col("_hash")), "left")
    lines = F.split(F.col("row.text"), "\n")
    marks = _marks(F.coalesce("_kept", F.array().cast("array<int>")), F.size(lines))
    # lines and marks are walked side by side; a mask looked up inside the function would be made anew for every line
    stays = lambda x, mark: F.when((F.trim(x) == "") | (mark == "1"), x)
    left = F.filter(F.zip_with(lines, marks, stays), lambda x: x.isNotNull())
    # the generator is a fence: what follows reads the result and does not repeat the work
    fenced = joined.select("row", F.inline(F.array(F.struct(left.alias("_left"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("_n")))))
    n_lines = F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.col("_n")).cast("long")
    n_left = F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.size("_left")).cast("long")
    return unpacked(fenced, documents.columns, text=F.array_join("_left", "\n"), n_lines=n_lines, n_dropped=n_lines - n_left)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` with near-duplicate lines removed: doc_id, text, n_lines, n_dropped."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_dropped")


SQL = r"""
WITH l AS (
  SELECT doc_id, CAST(pos AS INTEGER) AS no, lines[pos] AS line
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
), e AS (SELECT * FROM l WHERE trim(line) <> ''),
o AS (SELECT doc_id, no, line, row_number() OVER (ORDER BY doc_id, no) AS ord FROM e),
f AS (SELECT line, min(ord) AS ord, length(line) AS n FROM o GROUP BY line),
-- two lines within one edit share the first or the last half of the shorter one
k AS (
  SELECT line, ord, n, m, 'p' AS side, left(line, m // 2) AS part FROM (SELECT *, unnest([n, n - 1]) AS m FROM f WHERE n >= 20)
  UNION ALL
  SELECT line, ord, n, m, 's' AS side, right(line, m - (m + 1) // 2) AS part FROM (SELECT *, unnest([n, n - 1]) AS m FROM f WHERE n >= 20)
),
c AS (
  SELECT DISTINCT a.ord AS early, a.line AS a, a.n AS na, b.ord AS late, b.line AS b, b.n AS nb
  FROM k a JOIN k b ON a.m = b.m AND a.side = b.side AND a.part = b.part AND a.ord < b.ord
  WHERE least(a.n, b.n) = a.m
),
near AS (
  SELECT DISTINCT late FROM (SELECT *, unnest(range(0, least(na, nb) + 1)) AS p FROM c)
  WHERE left(a, p) = left(b, p)
    AND substr(a, p + 1 + CAST(na >= nb AS INTEGER)) = substr(b, p + 1 + CAST(nb >= na AS INTEGER))
),
kept AS (
  SELECT doc_id, no FROM o JOIN f ON o.line = f.line AND o.ord = f.ord WHERE f.ord NOT IN (SELECT late FROM near)
),
r AS (
  SELECT l.doc_id, l.no, l.line, (trim(l.line) = '' OR kept.no IS NOT NULL) AS stays
  FROM l LEFT JOIN kept ON l.doc_id = kept.doc_id AND l.no = kept.no
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE stays), '') AS text,
       CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE NOT stays) AS BIGINT) AS n_dropped
FROM r GROUP BY doc_id
"""
