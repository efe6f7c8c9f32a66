import pytest
from pyspark.sql import functions as F

from bytecairn.functions import text as fx


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("given,wanted", [("a +%中", "a%20%2B%25%E4%B8%AD"), ("a/b~c*-_.", "a/b~c%2A-_."), ("", "")])
def test_percent_encode(spark, given, wanted):
    assert one(spark, given, fx.percent_encode) == wanted


@pytest.mark.parametrize("given,wanted", [("30s", 30), ("5m", 300), ("2h", 7200), ("1d", 86400), ("0s", None), ("s", None), ("5 m", None), ("99999999999999999999d", None)])
def test_seconds(spark, given, wanted):
    assert one(spark, given, fx.seconds) == wanted


def test_size_bytes(spark):
    assert one(spark, "16MiB", fx.size_bytes) == 16 << 20
    assert one(spark, "9999999999999TiB", fx.size_bytes) is None


def test_successor():
    assert fx.successor("abc/") == "abc0"
    assert fx.successor("a\U0010ffff") == "b"
    assert fx.successor("\U0010ffff") is None
    assert fx.successor("퟿") == ""


@pytest.mark.parametrize("key,mime,wanted", [("a.PNG", "application/pdf", "image"), ("a.pdf", None, "document"), ("a.bin", "text/html", "document"), ("a.tar", "", "archive"), ("a", None, "other")])
def test_category(spark, key, mime, wanted):
    row = spark.createDataFrame([(key, mime)], "k string, m string").select(fx.category(F.col("k"), F.col("m")).alias("r")).first()
    assert row["r"] == wanted


def test_contains_degrades_to_prefix(spark):
    assert one(spark, "xab", lambda c: fx.contains(c, "ab")) is False
    assert one(spark, "abx", lambda c: fx.contains(c, "AB")) is True
    assert one(spark, "x/École.txt", lambda c: fx.contains(c, "ÉCOLE")) is True
    assert one(spark, "a%b_c%d", lambda c: fx.contains(c, "abc%")) is False


def test_slot_and_prefix(spark):
    assert one(spark, "~m", fx.slot) == "~~m"
    assert one(spark, "a/b/c", lambda c: fx.common_prefix(c, "a/")) == "a/b/"
    assert one(spark, "a/b", lambda c: fx.common_prefix(c, "a/")) == "a/b"
    assert one(spark, "a/b/c", fx.ancestors) == ["a", "a/b"]
