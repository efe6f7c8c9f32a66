"""Helpers for hot keys, null keys and clashing names."""

import pytest
from pyspark.sql import functions as F

from bytecairn.llm import common


def test_hot_group_aggregate(spark):
    rows = [("hot", i) for i in range(500)] + [("cold", 7), (None, 3), (None, 4)]
    out = common.hot_group_aggregate(spark.createDataFrame(rows, "k string, v long"), ["k"], ["v"], {"least": (F.min("v"), "min"), "n": (F.count(F.lit(1)), "sum")})
    assert sorted(((r["k"], r["v"], r["least"], r["n"]) for r in out.collect()), key=str) == sorted(((k, v, {"hot": 0, "cold": 7, None: 3}[k], {"hot": 500, "cold": 1, None: 2}[k]) for k, v in rows), key=str)


def test_hot_lookup(spark):
    rows = spark.createDataFrame([("a", i) for i in range(300)] + [("b", 1), (None, 2)], "k string, v long")
    lookup = spark.createDataFrame([("a", "A"), ("c", "C")], "k string, x string")
    got = common.hot_lookup(rows, "k", lookup, ["v"]).collect()
    assert len(got) == 302 and all(r["x"] == ("A" if r["k"] == "a" else None) for r in got)


def test_packed_keeps_any_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], "row long, `a.b` long, text long")
    out = common.unpacked(common.packed(df, F.col("row").alias("_key")), df.columns, text=F.lit(9), new=F.col("_key"))
    assert out.columns == ["row", "a.b", "text", "new"] and tuple(out.first()) == (1, 2, 9, 1)


def test_fold_matches_crc32(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in (0, 1, 12345, -7)] + [(None,)], "k long")
    assert [(r["k"], r["f"]) for r in df.select("k", common.fold_of(F.col("k"), 7).alias("f")).collect()] == [(i, zlib.crc32(str(i).encode()) % 7) for i in (0, 1, 12345, -7)] + [(None, 0)]


def test_shared_dir_is_that_of_the_context(spark):
    """A local folder only where neither the session nor the context names one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    chosen = common.shared_dir(spark)
    assert named is None or chosen == named.rstrip("/")
    bare = lambda path: path.removeprefix("file:").replace("//", "/")
    assert bare(spark.sparkContext._jsc.sc().getCheckpointDir().get()).startswith(bare(chosen))
    assert common.scratch_path(spark, "x").startswith(chosen)


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("N", (), {"isDefined": staticmethod(lambda: False)}))}))})

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_scratch_is_removed_and_settings_come_back(spark):
    path = common.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    common.discard(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with common.bounded_batches(spark):
        assert spark.conf.get(key) == str(common.BATCH_BYTES)
    assert spark.conf.get(key) == before
