"""Interval union and attribution: small cases, the golden case and brute force."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bytecairn.operators import intervals as iv
from bytecairn.operators import usage as us


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_merge_nested_touching_and_empty(spark):
    rows = [("n", 0, 10), ("n", 2, 4), ("n", 5, 12), ("t", 0, 4), ("t", 4, 8), ("g", 0, 4), ("g", 5, 8), ("e", 3, 3), ("d", 1, 2), ("d", 1, 2)]
    merged = iv.merge_intervals(spark.createDataFrame(rows, "k string, lo long, hi long"), ["k"])
    assert rows_of(merged, "k", "lo", "hi") == [("d", 1, 2), ("g", 0, 4), ("g", 5, 8), ("n", 0, 12), ("t", 0, 8)]


def test_merge_in_parts_is_the_same(spark):
    rows = [("hot", (i * 37) % 500, (i * 37) % 500 + i % 7) for i in range(400)] + [("cold", 1, 2)]
    df = spark.createDataFrame(rows, "k string, lo long, hi long")
    assert rows_of(iv.merge_intervals(df, ["k"], ways=8), "k", "lo", "hi") == rows_of(iv.merge_intervals(df, ["k"]), "k", "lo", "hi")


def test_merge_of_no_rows(spark):
    assert iv.merge_intervals(spark.createDataFrame([], "k string, lo long, hi long"), ["k"]).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(0, 8)), max_size=30))
def test_merge_is_the_union(spark, rows):
    data = [(k, lo, lo + n) for k, lo, n in rows]
    merged = iv.merge_intervals(spark.createDataFrame(data, "k long, lo long, hi long"), ["k"]).collect()
    want = {(k, p) for k, lo, hi in data for p in range(lo, hi)}
    got = [(r["k"], p) for r in merged for p in range(r["lo"], r["hi"])]
    assert len(got) == len(set(got)) and set(got) == want


def brute_shares(rows):
    """{(bucket, chunk): (unique bytes, share)}, byte by byte."""
    users = {}
    for bucket, project, chunk, lo, hi in rows:
        for p in range(lo, hi):
            users.setdefault((chunk, p), set()).add((project, bucket))
    out = {}
    for (chunk, _), who in users.items():
        projects = {p for p, _ in who}
        for p, b in who:
            n, share = out.get((b, chunk), (0, 0.0))
            out[b, chunk] = n + 1, share + 1 / len(projects) / sum(q == p for q, _ in who)
    return out


def shared(spark, rows):
    islands = iv.merge_intervals(spark.createDataFrame(rows, "bucket string, project string, chunk_id long, lo long, hi long"), ["bucket", "project", "chunk_id"])
    integral = us.integrals(islands, "chunk_id", "project")
    return islands, us.shares(islands, integral, "chunk_id", "project", "bucket")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 1), st.integers(0, 25), st.integers(0, 12)), max_size=30))
def test_shares_match_brute_force(spark, rows):
    data = [(f"b{b}", f"p{b % 3}", c, lo, lo + n) for b, c, lo, n in rows]
    islands, shares = shared(spark, data)
    got = {(r["bucket"], r["chunk_id"]): (r["unique_bytes"], r["share"]) for r in shares.collect()}
    want = brute_shares(data)
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    counts = {(r["bucket"], r["chunk_id"]): (r["segments"], r["bytes"]) for r in iv.covered_counts(islands, "chunk_id", "bucket").collect()}
    covered = iv.coverage(islands, iv.boundary_segments(islands, "chunk_id"), "chunk_id").groupBy("bucket", "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hi") - F.col("lo")).alias("b"))
    assert counts == {(r["bucket"], r["chunk_id"]): (r["n"], r["b"]) for r in covered.collect()}


UNIT = 131072
PROJECTS = {"alpha": "A", "beta": "B", "gamma": "A", "delta": "D", "epsilon": "E"}
REFERENCES = [("alpha", 1, 0, 16), ("alpha", 1, 0, 16), ("alpha", 5, 0, 4), ("beta", 1, 0, 16), ("beta", 2, 0, 16), ("gamma", 1, 0, 4), ("gamma", 1, 2, 4), ("delta", 3, 0, 2), ("epsilon", 4, 0, 4)]
PHYSICAL = [("chunk", "5", "ready", 2 * UNIT, False), ("chunk", "6", "retired", 5 * UNIT, True), ("pack", "1", "ready", 8 * UNIT, False), ("pack", "2", "ready", 8 * UNIT, False)]


def golden(spark, physical=(), raw=(), raw_ranges=(), extra=()):
    """The golden case in bytes; with further physical rows, raw sources (id, size) and their ranges (stream, source)."""
    used = [(b, PROJECTS[b], c, o * UNIT, (o + n) * UNIT) for b, c, o, n in REFERENCES]
    _, shares = shared(spark, used)
    quotas = [(b, sum(n for x, _, _, n in REFERENCES if x == b) * UNIT, sum(x == b for x, *_ in REFERENCES)) for b in PROJECTS]
    buckets = spark.createDataFrame(list(PROJECTS.items()), "bucket_id string, project_id string")
    # a pack's stored bytes stand at one of its chunks
    chunks = spark.createDataFrame([(1, "pack", "1", 8 * UNIT), (2, "pack", "1", 0), (3, "pack", "2", 8 * UNIT), (4, "pending", None, None), (5, "chunk", "5", 2 * UNIT), (6, "pack", "2", 0)], "chunk_id long, source_type string, source string, stored long")
    sources = spark.createDataFrame([(i, n, "ready", None) for i, n in raw], "source_id long, size long, state string, owner_stream long")
    ranges = spark.createDataFrame(list(raw_ranges), "stream_id string, source_id long")
    streams = spark.createDataFrame([(s,) for s in extra], "stream_id string")
    sizes = dict(raw)
    references = spark.createDataFrame(sorted({(s, PROJECTS[s], i, sizes[i]) for s, i in raw_ranges if s in PROJECTS}), "bucket_id string, project_id string, source_id long, size long")
    whole = us.bridge(spark.createDataFrame([*PHYSICAL, *physical], "source_type string, source string, state string, stored long, garbage boolean"), chunks.where("chunk_id IN (1, 2, 3, 5)"), us.raw_inventory(sources, ranges, streams))
    usage = us.summary(
        us.logical_scopes(buckets, spark.createDataFrame(quotas, "bucket_id string, used_bytes long, object_count long")), us.scope_rows(shares, "chunk_id", "project", "bucket"),
        us.encoded_rates(shares, chunks), us.raw_scopes(us.raw_shares(references)), whole,
    )
    return {r["scope_id"] or "global": r for r in usage.collect()}


def test_golden_attribution(spark):
    got = golden(spark)
    units = lambda scope, field: got[scope][field] / UNIT
    assert set(got) == {*PROJECTS, *PROJECTS.values(), "global"}
    assert (units("alpha", "unique_bytes"), units("alpha", "local_savings"), units("alpha", "encoded_bytes")) == (20, 16, 3.625)
    assert units("beta", "encoded_bytes") == 6 and (units("gamma", "unique_bytes"), units("gamma", "encoded_bytes")) == (6, 0.375)
    assert units("delta", "encoding_savings") == -6
    assert (got["epsilon"]["encoded_bytes"], got["epsilon"]["encoding_savings"], units("epsilon", "pending_bytes")) == (None, None, 4)
    assert (units("A", "unique_bytes"), units("A", "encoded_bytes")) == (20, 4)
    assert (units("global", "unique_bytes"), units("global", "encoded_known_bytes")) == (42, 18)
    assert (units("global", "indexed_bytes"), units("global", "selected_bytes"), units("global", "gc_bytes")) == (23, 18, 5)
    assert sum(got[b]["encoded_bytes"] or 0 for b in PROJECTS) == 18 * UNIT
    assert all(r["indexed_bytes"] is None for k, r in got.items() if k != "global")
    assert [got[k]["buckets"] for k in ("alpha", "A", "global")] == [1, 2, 5] and got["A"]["objects"] == 5
    for r in got.values():
        if r["encoded_bytes"] is not None:
            assert r["logical_bytes"] - r["encoded_bytes"] == pytest.approx(r["local_savings"] + r["shared_savings"] + r["encoding_savings"], abs=1e-5)


def test_retained_copies_are_no_savings(spark):
    whole = golden(spark, physical=[("chunk", "7", "retired", 4 * UNIT, True)])["global"]
    assert whole["selected_bytes"] + whole["retained_bytes"] + whole["gc_bytes"] == whole["indexed_bytes"] == 27 * UNIT


def test_raw_sources(spark):
    """Sources of 7, 5 and 3 bytes: used by two projects, by an unpublished stream, by nobody."""
    before = golden(spark)
    after = golden(spark, raw=[(1, 7), (2, 5), (3, 3)], raw_ranges=[("alpha", 1), ("beta", 1), ("unpublished", 2)], extra=["alpha", "beta"])
    for field, added in (("indexed_bytes", 15), ("selected_bytes", 7), ("retained_bytes", 5), ("gc_bytes", 3)):
        assert after["global"][field] == before["global"][field] + added
    assert after["alpha"]["attributed_raw_bytes"] == before["alpha"]["attributed_raw_bytes"] + 3.5
    assert after["global"]["unique_bytes"] == before["global"]["unique_bytes"] + 7 == after["beta"]["unique_bytes"] - before["beta"]["unique_bytes"] + before["global"]["unique_bytes"]
