from pyspark.sql import functions as F

from bytecairn.operators import history as h

LOG = "bucket long, key string, seq long, op string, generation long, size long"


def test_as_of_and_live(spark):
    rows = spark.createDataFrame([(1, "a", 1, "put", 0, 5), (1, "a", 4, "delete", 0, 0), (1, "b", 2, "put", 0, 7)], LOG)
    assert {r["key"] for r in h.live(rows, ["bucket", "key"], F.lit(3)).collect()} == {"a", "b"}
    assert {r["key"] for r in h.live(rows, ["bucket", "key"]).collect()} == {"b"}


def test_restore_plan_states(spark):
    source = spark.createDataFrame([("keep", 1), ("old", 1), ("gone", 1), ("lost", 1)], "key string, seq long")
    current = spark.createDataFrame([("keep", 1), ("old", 2), ("new", 3)], "key string, seq long")
    plan = lambda in_place: {r["key"]: r["state"] for r in h.restore_plan(source, current, ["key"], F.col("key") == "lost", in_place).collect()}
    assert plan(True) == {"keep": "skip", "old": "replace", "gone": "add", "lost": "missing", "new": "remove"}
    assert plan(False) == {"keep": "skip", "old": "skip", "gone": "add", "lost": "missing"}


def sequential_replay(rows):
    """One change after the other, as a journal reader would."""
    buckets = {}
    for bucket, key, seq, op, generation, size in sorted(rows, key=lambda r: (r[0], r[2])):
        state = buckets.setdefault(bucket, {"ready": None, "slots": {}})
        if op == "start":
            state["slots"].setdefault(generation, {})
        elif op == "ready":
            state["ready"] = generation
        elif op == "drop":
            buckets[bucket] = {"ready": None, "slots": {}}
        elif op == "put":
            state["slots"].setdefault(generation, {})[key] = (seq, size)
        elif op == "delete":
            state["slots"].setdefault(generation, {}).pop(key, None)
    return {(b, k, *v) for b, s in buckets.items() if s["ready"] is not None for k, v in s["slots"].get(s["ready"], {}).items()}


def test_replay_equals_sequential(spark):
    rows = [
        (1, None, 1, "start", 1, 0), (1, "a", 2, "put", 1, 3), (1, "b", 3, "put", 1, 4), (1, None, 4, "ready", 1, 0), (1, "a", 5, "delete", 1, 0), (1, "c", 6, "put", 1, 9), (1, None, 7, "start", 2, 0), (1, "a", 8, "put", 2, 8),
        (2, None, 1, "start", 1, 0), (2, "a", 2, "put", 1, 1), (3, None, 1, "start", 1, 0), (3, "a", 2, "put", 1, 1), (3, None, 3, "ready", 1, 0), (3, None, 4, "drop", 1, 0),
    ]
    got = {(r["bucket"], r["key"], r["seq"], r["size"]) for r in h.replay(spark.createDataFrame(rows, LOG)).collect()}
    assert got == sequential_replay(rows)


def test_gaps_keep_their_ends(spark):
    points = spark.createDataFrame([(1, p) for p in (119, 120, 121, 150, 179, 180, 181)], "bucket long, point long")
    gaps = spark.createDataFrame([(1, 120, 180)], "gap_bucket long, gap_from long, gap_to long")
    assert sorted(r["point"] for r in h.outside_gaps(points, gaps, "point").collect()) == [119, 120, 180, 181]


def test_sequence_gaps(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 5), (2, 9)], "bucket long, seq long")
    assert [(r["bucket"], r["seq"], r["before"]) for r in h.sequence_gaps(rows).collect()] == [(1, 5, 2)]
