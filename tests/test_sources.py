import json

import pytest
from pyspark.sql import functions as F

from bytecairn.sources import io


def test_change_log_round_trip(spark, tmp_path):
    rows = [{"bucket": "b", "name": "n", "generation": 1, "seq": 3, "op": "put", "key": "k", "attributes": {"size": 4, "etag": "e", "metadata": {"a": "b"}, "modified_us": 5}, "ranges": [{"material": "m", "offset": 0, "source_offset": 0, "length": 4}]}]
    (tmp_path / "log.json").write_text("\n".join(map(json.dumps, rows)))
    got = io.change_log(spark, str(tmp_path)).first()
    assert (got["seq"], got["attributes"]["metadata"], got["ranges"][0]["length"]) == (3, {"a": "b"}, 4)
    assert io.change_log(spark, str(tmp_path), stream=True).isStreaming


def test_listing_and_export_modes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.bin").write_bytes(b"12345")
    assert [r["length"] for r in io.listing(spark, str(tmp_path / "in")).collect()] == [5]
    rows = spark.range(3)
    io.export(rows, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists"):
        io.export(rows, str(tmp_path / "out"))
    io.export(spark.range(9), str(tmp_path / "out"), "skip")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    io.export(spark.range(9), str(tmp_path / "out"), "overwrite")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9


def test_keyset_pages_walk_everything(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(10)], "a long, b long")
    seen, after = [], None
    while True:
        page = [tuple(r) for r in io.keyset_page(rows, ["a", "b"], after, 4).collect()]
        seen += page[:4]
        if len(page) <= 4:
            break
        after = page[3]
    assert seen == sorted((i % 3, i) for i in range(10))


def test_accumulate_versions(spark, tmp_path):
    batch = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    io.accumulate_into(spark, None, batch, ["k"], ["n"], str(tmp_path / "1"))
    out = io.accumulate_into(spark, str(tmp_path / "1"), batch, ["k"], ["n"], str(tmp_path / "2"))
    assert {r["k"]: r["n"] for r in out.collect()} == {"a": 2, "b": 4}


def test_pack_files(spark, tmp_path):
    members = spark.createDataFrame([(1, 2, bytearray(b"bb")), (1, 1, bytearray(b"a"))], "pack long, member long, c binary").withColumn("length", F.octet_length("c"))
    io.write_packs(members, F.col("c"), str(tmp_path / "p"))
    row = spark.read.parquet(str(tmp_path / "p")).first()
    assert bytes(row["body"]) == b"PACKFILEabb" and [(m["member"], m["offset"]) for m in row["members"]] == [(1, 8), (2, 9)]


def test_snapshot_bound(spark):
    assert io.up_to(spark.range(10), "id", 4).count() == 5
    assert io.up_to(spark.range(10), "id").count() == 10
