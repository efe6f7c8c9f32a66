"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII-only case folding, as every contract here states it.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Ways in which a possibly hot key is split before anything is gathered by it.
SALTS = 64

#: Used only where nothing names a folder and driver and executors are one machine, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/bytecairn"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's setting, else the context's; a local one in local mode only."""
    context = spark.sparkContext
    chosen = context._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and chosen.isDefined():
        base = chosen.get().rpartition("/")[0]  # the context appends a folder of its own
    if base is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        base = LOCAL_CHECKPOINTS
    if not chosen.isDefined():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: reliable checkpoint in the shared folder, so that no lost executor undoes it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Scratch tables that this process has named and not removed.
_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new, unused path in the shared folder."""
    _SCRATCH.append(f"{shared_dir(spark)}/bytecairn-{what}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in _SCRATCH:
            _SCRATCH.remove(p)


@contextmanager
def only_kept(spark: SparkSession) -> Iterator[Callable[[str], None]]:
    """Removes, at the end, the scratch tables named since the beginning, but for those given to the function it yields."""
    before, kept = set(_SCRATCH), set()
    try:
        yield kept.add
    finally:
        discard(spark, *[p for p in _SCRATCH if p not in before and p not in kept])


def byte_slices(texts: pa.Array, size: int = 8 << 20) -> Iterator[list[str | None]]:
    """A batch's texts, some megabytes at a time, for workers of lazy scorers, whose batches the session bounds."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(ends // size, prepend=0)) if len(ends) else []
    for a, b in zip([0, *cuts], [*cuts, len(texts)]):
        if b > a:
            yield texts.slice(a, b - a).to_pylist()


#: Bytes of an Arrow batch that goes to a Python worker, for the sake of very long texts.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, actions send batches of bounded size to Python workers; the session's setting comes back after it."""
    before = spark.conf.get(_BATCH_SETTING, None)
    spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_SETTING)
        else:
            spark.conf.set(_BATCH_SETTING, before)


def give_back() -> None:
    """Freed memory goes back to the system, for the end of a task: Spark keeps its Python worker, beside those of other stages, and its memory with it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def in_parallel(rows: DataFrame) -> DataFrame:
    """``rows`` of a table in fewer files than there are cores, dealt anew, since a file may be one row group; others as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])) if 0 < len(rows.inputFiles()) < cores else rows


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def packed(df: DataFrame, *keys: Column) -> DataFrame:
    """All columns in one struct ``row``, beside some keys, so that no name of the input meets a working column."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *keys)


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The packed columns again, those named in ``new`` put in place or added."""
    kept = [new.pop(c).alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns]
    return df.select(*kept, *[v.alias(k) for k, v in new.items()])


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def spread(*cols: Column, ways: int = SALTS) -> Column:
    """A salt that only depends on the row, so that a repeated task deals the same."""
    return F.pmod(F.xxhash64(*cols), F.lit(ways)).cast("int")


def hot_group_aggregate(rows: DataFrame, keys: list[str], salt_on: list[str], aggs: dict[str, tuple[Column, str]]) -> DataFrame:
    """``rows`` with whole-group aggregates attached, safe for a key that holds any share of the rows.

    ``aggs`` maps a new column to (partial aggregate, name of the SQL function that combines partials).
    A salt splits every group; the partials (``SALTS`` rows a key at most) are combined in a window
    and joined back on key and salt, so no task gathers a whole group. Keys join null-safe.
    """
    salted = rows.withColumn("_salt", spread(*[F.col(c) for c in salt_on]))
    partial = salted.groupBy(*keys, "_salt").agg(*[part.alias(f"_p_{name}") for name, (part, _) in aggs.items()])
    whole = Window.partitionBy(*keys)
    combined = partial.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_salt").alias("_k__salt"),
        *[F.expr(f"{combine}(_p_{name})").over(whole).alias(name) for name, (_, combine) in aggs.items()],
    )
    cond = F.col("_salt").eqNullSafe(F.col("_k__salt"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return salted.join(combined, cond, "inner").drop("_salt", "_k__salt", *[f"_k_{k}" for k in keys])


def slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Pieces of a very long text, cut at a space or line end only, so that no helper holds all its words."""
    start = 0
    while len(text) - start > size:
        cuts = [c for c in (text.find(" ", start + size), text.find("\n", start + size)) if c >= 0]
        if not cuts:
            break
        yield text[start : min(cuts) + 1]
        start = min(cuts) + 1
    yield text[start:] if start else text


def hot_lookup(rows: DataFrame, key: str, lookup: DataFrame, salt_on: list[str]) -> DataFrame:
    """Left join of ``rows`` with ``lookup`` (one row a key), safe for a key that holds any share of ``rows``.

    The lookup meets each key once for every salt that occurs with it, then rows join on key and salt.
    ``rows`` is read twice and should be narrow. A null key finds nothing.
    """
    salted = rows.withColumn("_salt", spread(*[F.col(c) for c in salt_on]))
    pairs = salted.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col("_salt").alias("_s")).distinct()
    found = pairs.join(lookup.withColumnRenamed(key, "_lk"), F.col("_k") == F.col("_lk"), "inner").drop("_lk")
    return salted.join(found, (F.col(key) == F.col("_k")) & (F.col("_salt") == F.col("_s")), "left").drop("_salt", "_k", "_s")
