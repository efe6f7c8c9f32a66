"""What one task holds: steps over ranges are dealt by the number of rows, and contents stay out of Python."""

import zlib

import pytest
from pyspark.sql import functions as F

from bytecairn.operators import content as ct
from bytecairn.operators import intervals as iv
from bytecairn.operators import packs
from bytecairn.plans import catalogue
from bytecairn.sources import model as m


def tasks(df):
    return df.rdd.getNumPartitions()


@pytest.mark.parametrize("name", ["merged_intervals", "interval_segments", "interval_coverage", "fair_share_bytes", "usage_summary", "conservation_check", "repack_gain"])
def test_more_rows_are_more_tasks(spark, data, monkeypatch, name):
    """The steps by key take as many tasks as there are rows for."""
    dealt, seen = iv.dealt, []
    monkeypatch.setattr(iv, "TASK_ROWS", 250)
    monkeypatch.setattr(iv, "dealt", lambda rows, parts, *keys: seen.append(parts) or dealt(rows, parts, *keys))
    monkeypatch.setattr("bytecairn.operators.usage.dealt", iv.dealt)
    catalogue.queries()[name](spark, data)
    least = -(-m.extents(spark, data).count() // 250)
    assert seen and min(seen) >= least > spark.sparkContext.defaultParallelism


def test_dealt_steps_stay_dealt(spark):
    rows = spark.range(1000).select((F.col("id") % 90).alias("k"), F.col("id").alias("lo"), (F.col("id") + 5).alias("hi"))
    islands = iv.merge_intervals(rows, ["k"], parts=37)
    assert tasks(islands) == 37
    assert tasks(iv.boundary_segments(islands, "k", 37)) == 74


def test_repeats_open_no_run(spark):
    rows = [("s", 0, 4), ("s", 0, 4), ("s", 4, 6), ("s", 4, 6), ("s", 7, 9), ("s", 7, 9), ("s", 7, 8)]
    df = spark.createDataFrame(rows, "k string, lo long, hi long")
    opened = df.withColumn("open", packs.begins_run(["k"])).agg(F.sum("open")).first()[0]
    assert opened == packs.adjacent_runs(df, ["k"]).first()["gets"] == 3


def whole(data, samples=4, least_bytes=64, least_percent=5):
    if not data:
        return False
    width = min(max(len(data) // 64, 256), 65_536, len(data))
    step = max(1, (len(data) - width) // max(1, samples - 1)) if len(data) > width else len(data)
    seen = b"".join(data[at : at + width] for at in range(0, len(data) - width + 1, step))
    saved = len(seen) - len(zlib.compress(seen, 1))
    return saved * len(data) >= max(least_bytes * len(seen), least_percent * len(data) * len(seen) // 100)


def test_compression_reads_samples_only(spark, monkeypatch):
    import random

    rng = random.Random(5)
    contents = [None, b""] + [rng.choice([rng.randbytes(n), b"abc " * (n // 4 + 1), (b"x" * (n // 2)) + rng.randbytes(n - n // 2)]) for n in [1, 2, 255, 256, 257, 258, 261, 264, 300, 1000, 16384, 16385, 20_000, 300_000, 5_000_000] * 3]
    df = spark.createDataFrame(list(enumerate(contents)), "i int, content binary")
    decided = ct.compression_policy(df, F.col("content"))
    assert {r["i"]: r["compress"] for r in decided.select("i", "compress").collect()} == {i: whole(c) for i, c in enumerate(contents)}
    given, real = [], F.pandas_udf

    def spied(kind):
        return lambda f: (lambda *cols: given.append(cols) or real(f, kind)(*cols))

    monkeypatch.setattr(ct.F, "pandas_udf", spied)
    ct.compression_policy(df, F.col("content"))
    assert df.select(F.max(F.octet_length(given[0][0]))).first()[0] <= 6 * 65_536
