"""A corpus from raw documents to packed sequences; every stage works on all its predecessor kept.

``run`` writes each stage as Parquet into the shared folder and reads it back as the next one's input; but for the last one,
these tables are removed at the end.

Columns: every stage but the last takes and gives doc_id, text, lang, source and n_chars; other columns of ``documents``, whatever their names, are not
carried. The last gives a row a piece: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.

Defined cases: a null or empty text, or one without a letter, is in no language and goes in the first stage, as does every
text whose language is told with less than ``LEAST_SCORE``; so later stages meet no null text from ``run``, and alone take it as empty.
A null doc_id is kept until near-dedup, where it stays only if its whole component has no id. Repeated rows (same doc_id and text) keep the same lines
and stay once. Of equal lines and of near copies the one of the smallest doc_id stays. Very long texts are never cut short. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytecairn.llm import decontaminate, langid, linededup, packing, simhash
from bytecairn.llm.common import bounded_batches, fold_of, only_kept, scratch_path, table

#: Below this probability a document counts as being in no learned language.
LEAST_SCORE = 0.5


def _columns(documents: DataFrame) -> DataFrame:
    """The columns of ``documents``, with n_chars of the text as it now is."""
    return documents.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; ``lang`` becomes the predicted one.

    Written here, while batches are bounded, since the texts go through Python.
    """
    model = langid.fit(docs, fold_of(F.col("doc_id"), 3) != 1)
    kept = langid.identify(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    path = scratch_path(spark, "languages")
    with bounded_batches(spark):
        _columns(kept.withColumn("lang", F.col("lang_pred"))).write.parquet(path)
    return spark.read.parquet(path)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines, and documents of which nothing but blanks is left by that."""
    result = linededup.dedup_lines(docs)
    return _columns(result.where((F.col("n_dropped") == 0) | (F.trim("text") != "")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate component stays: five-word shingles, a similarity of 0.8 or more."""
    return _columns(simhash.keep_one_per_component(docs, simhash.NEAR_SHINGLE, simhash.NEAR))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return _columns(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces, with their token ids, placed in sequences."""
    return packing.packed_corpus(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the network of the first stage; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with only_kept(spark) as keep:
        for _, stage in STAGES:
            path = scratch_path(spark, "stage")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
        keep(path)
    return docs
