"""Benchmark decontamination with DataFrame functions only.

Every window of ``n`` consecutive benchmark words is hashed; the hash set is broadcast while its size is
within a checked bound. Documents are scanned window by window inside one code-generated stage (explode positions,
hash the slice at every window length, probe), hits are verified word by word, and the hit positions mark words,
spans or whole documents. Beyond the bound positions and hashes are shuffled, never words: what a text sends is in
proportion to its length, and candidates are verified on the text they came from.

Defined cases: null and empty texts have no words and are clean; items of fewer than ``n`` words (but not
none) are one window of their own length; items without words never occur; repeated items and repeated
documents are each treated alone; null item ids cannot be named in the result but their windows still
hit; an empty benchmark leaves everything clean. Rows that agree in doc_id and text share one result. Other columns,
whatever their names, pass through ``decontaminate`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_parallel, lower_ascii, materialise, packed, table, unpacked

#: Bytes that separate words once A-Z is folded; fixed by the contract.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NGRAM = 10
#: Largest benchmark, in characters of text, whose windows are broadcast; a larger one is joined by shuffle.
BROADCAST_CHARS = 16 << 20


def words_of(text: Column) -> Column:
    """Words of a text; none for null."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """Distinct windows: ``_hash`` of the words, ``_len``, the words themselves (``_window``) and, apart, ids by window."""
    items = benchmark.select(F.col("item_id").alias("_item"), words_of(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    length = F.least(F.size("_w"), F.lit(n))
    spots = items.select("_item", "_w", length.alias("_len"), F.explode(F.sequence(F.lit(1), F.size("_w") - length + 1)).alias("_at"))
    return spots.select("_item", "_len", F.slice("_w", F.col("_at"), F.col("_len")).alias("_window")).withColumn("_hash", F.xxhash64("_window"))


def find_hits(documents: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """One row per document key and verified hit: doc_id, _text_hash, _at (from 1), _len, _window."""
    windows = benchmark_windows(benchmark, n)
    distinct = windows.groupBy("_hash", "_len", "_window").agg(F.lit(1).alias("_one")).drop("_one").withColumnRenamed("_len", "_wlen")
    chars = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()["chars"]
    lengths = sorted(r[0] for r in windows.select("_len").distinct().collect())  # n values at most
    keyed = in_parallel(documents.select("doc_id", "text")).select("doc_id", "text", F.xxhash64("text").alias("_text_hash"))
    places = keyed.select("doc_id", "_text_hash", words_of(F.col("text")).alias("_w")).select("doc_id", "_text_hash", "_w", F.posexplode("_w").alias("_pos", "_word"))
    at = lambda length: F.slice("_w", F.col("_pos") + 1, length)
    probe = lambda length: F.struct(F.lit(length).alias("_len"), F.xxhash64(at(F.lit(length))).alias("_probe"))
    # one scan for all lengths
    spots = places.select("doc_id", "_text_hash", "_w", "_pos", F.inline(F.array(*[probe(length) for length in lengths or [n]])))
    spots = spots.where(F.col("_pos") + F.col("_len") <= F.size("_w"))
    same = (F.col("_probe") == F.col("_hash")) & (F.col("_len") == F.col("_wlen"))
    hit = ["doc_id", "_text_hash", (F.col("_pos") + 1).alias("_at"), "_len", "_window"]
    if chars <= BROADCAST_CHARS:
        return spots.join(F.broadcast(distinct), same & (at(F.col("_len")) == F.col("_window")), "inner").select(*hit)
    # positions and hashes are shuffled, never the words; candidates meet their texts again and are verified there
    found = spots.select("doc_id", "_text_hash", "_pos", "_len", "_probe").join(distinct, same, "inner").select(*hit)
    by_doc = found.groupBy("doc_id", "_text_hash").agg(F.collect_set(F.struct("_at", "_len", "_window")).alias("_found")).withColumnsRenamed({"doc_id": "_doc", "_text_hash": "_hash"})
    met = keyed.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash")), "inner")
    verified = met.select("doc_id", "_text_hash", words_of(F.col("text")).alias("_w"), "_found").select("doc_id", "_text_hash", "_w", F.inline("_found"))
    return verified.where(F.slice("_w", F.col("_at"), F.col("_len")) == F.col("_window")).drop("_w")


def _covered(spans: Column) -> Column:
    """Words covered by sorted spans of (start, end exclusive), counted once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).cast("long").alias("n"), F.greatest(acc["end"], s["end"]).alias("end")
    )
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """Per distinct (doc_id, text) with hits: spans, n_hit, the sorted item ids."""
    hits = find_hits(documents, benchmark, n)
    # the scan runs once: both the spans and the item names are read from this
    per_doc = materialise(hits.groupBy("doc_id", "_text_hash").agg(F.sort_array(F.collect_set(F.struct(F.col("_at").alias("start"), (F.col("_at") + F.col("_len")).alias("end")))).alias("_spans"), F.collect_set("_window").alias("_windows")))
    items = benchmark_windows(benchmark, n).where(F.col("_item").isNotNull()).groupBy("_window").agg(F.collect_set(F.col("_item").cast("string")).alias("_ids"))
    named = (
        per_doc.select("doc_id", "_text_hash", F.explode("_windows").alias("_window"))
        .join(items, "_window", "inner")
        .select("doc_id", "_text_hash", F.explode("_ids").alias("_id"))
        .groupBy("doc_id", "_text_hash")
        .agg(F.sort_array(F.collect_set("_id")).alias("_items"))
        .select(F.col("doc_id").alias("_d"), F.col("_text_hash").alias("_t"), "_items")
    )
    joined = per_doc.join(named, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_text_hash").eqNullSafe(F.col("_t")), "left")
    return joined.select(F.col("doc_id").alias("_doc"), F.col("_text_hash").alias("_hash"), "_spans", _covered(F.col("_spans")).alias("_n_hit"), F.coalesce("_items", F.array().cast("array<string>")).alias("_items"))


def report(documents: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """One row per document: how many of its words lie in a benchmark window, and which items occur."""
    found = contamination(documents, benchmark, n)
    docs = in_parallel(documents.select("doc_id", "text")).select("doc_id", F.xxhash64("text").alias("_text_hash"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash")), "left")
    items = F.coalesce("_items", F.array().cast("array<string>"))
    n_hit = F.coalesce("_n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = NGRAM, mode: str = "documents") -> DataFrame:
    """Remove contaminated documents, or (``mode='spans'``) only the words inside hits.

    In spans mode a contaminated text is rebuilt from its remaining normalised words, joined by one space.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is 'documents' or 'spans'")
    found = contamination(documents, benchmark, n)
    keyed = packed(documents, F.col("doc_id").alias("_key"), F.xxhash64("text").alias("_text_key"))
    same = F.col("_text_key").eqNullSafe(F.col("_hash")) & F.col("_key").eqNullSafe(F.col("_doc"))
    if mode == "documents":
        return unpacked(keyed.join(found, same, "left_anti"), documents.columns)
    # the generator is a fence: the words are made once a text, not once a run
    words = F.when(F.col("_spans").isNotNull(), words_of(F.col("row.text")))
    joined = keyed.join(found, same, "left").select("row", "_spans", F.inline(F.array(F.struct(words.alias("_w")))))
    # the spans of one text are few next to its words; runs between them are sliced, never tested word by word
    past = F.size("_w") + 1
    fence = F.concat(F.col("_spans"), F.array(F.struct(past.alias("start"), past.alias("end"))))
    steps = F.aggregate(
        fence,
        F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("runs"), F.lit(1).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] > acc["at"], F.concat(acc["runs"], F.array(F.struct(acc["at"].alias("a"), s["start"].alias("b"))))).otherwise(acc["runs"]).alias("runs"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: acc["runs"],
    )
    cut = F.array_join(F.transform(steps, lambda r: F.array_join(F.slice("_w", r["a"], r["b"] - r["a"]), " ")), " ")
    return unpacked(joined, documents.columns, text=F.when(F.col("_spans").isNull(), F.col("row.text")).otherwise(cut))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words found in the whole ``documents`` table."""
    return report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents
), b AS (
  SELECT item_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, i, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hits AS (SELECT rid, dw.n, i, item_id FROM dw JOIN bw ON dw.win = bw.win),
nh AS (SELECT rid, count(DISTINCT i + o) AS n_hit FROM (SELECT rid, i, unnest(range(0, n)) AS o FROM hits) GROUP BY rid),
ni AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
       FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (rid) LEFT JOIN ni USING (rid)
"""
