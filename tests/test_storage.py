import hashlib
import random

import pytest
from pyspark.sql import functions as F

from bytecairn.operators import content as ct
from bytecairn.operators import packs, tiering
from bytecairn.operators import telemetry as tm

SAMPLE = "node string, boot string, sequence long, received long, uptime long, requests long, read_bytes long, hits long, lookups long, cache_bytes long, rss_bytes long, queue_waiting long"


def samples(**change):
    rows = {
        "a2": ["a", "x", 2, 99, 120, 60, 6000, 1, 1, 10, 1000, 4], "a1": ["a", "x", 1, 39, 60, 0, 0, 0, 0, 10, 1000, 4],
        "b2": ["b", "x", 2, 99, 120, 300, 30000, 9, 99, 10, 1000, 4], "b1": ["b", "x", 1, 39, 60, 0, 0, 0, 0, 10, 1000, 4],
    }
    for row, (at, value) in change.items():
        rows[row][at] = value
    return [tuple(r) for r in rows.values()]


def rates(spark, rows):
    return tm.cluster_rates(spark.createDataFrame(rows, SAMPLE), F.lit(100), 150, 150).first()


def test_rates_are_sums_and_the_ratio_is_of_sums(spark):
    r = rates(spark, samples())
    assert (r["reported"], r["rate_nodes"], r["requests_per_second"], r["read_bytes_per_second"], r["hit_ratio"], r["cache_bytes"], r["rss_bytes"], r["queue_waiting"]) == (2, 2, 6.0, 600.0, 0.1, 20, 2000, 8)


def test_rates_guard_restarts_and_missing_gauges(spark):
    assert (lambda r: (r["rate_nodes"], r["requests_per_second"]))(rates(spark, samples(b2=(1, "y")))) == (1, 1.0)
    assert rates(spark, samples(b2=(11, None)))["queue_waiting"] is None
    assert rates(spark, samples(a2=(3, -60), a1=(3, -90)))["reported"] == 1
    assert rates(spark, samples(a2=(5, -1)))["rate_nodes"] == 1
    assert rates(spark, [])["cache_bytes"] is None


def test_latency_percentiles(spark):
    rows = spark.createDataFrame([("k", float(v)) for v in [0.5, 1, 2, 3, 100, 1 << 24]], "k string, ms double")
    r = tm.latency_percentiles(rows, ["k"], F.col("ms")).first()
    assert (r["n"], r["p50"], r["p95"], r["p99"]) == (6, 2, None, None)


REFERENCE = "physical string, stored_bytes long, visible boolean, ready boolean, created long, observed long, last_read long, state string, cold_storage string, cool_after long, residency long"


@pytest.mark.parametrize(
    "change,wanted",
    [({}, "eligible"), ({"ready": False, "state": "paused"}, "source_busy"), ({"state": "paused"}, "shared_policy"), ({"cold_storage": None}, "shared_policy"), ({"observed": 0}, "observation_gap"), ({"observed": 950}, "observation_gap"), ({"residency": 990}, "minimum_residency"), ({"last_read": 950}, "recent_read"), ({"last_read": 900}, "eligible")],
)
def test_tier_reasons(spark, change, wanted):
    base = dict(physical="u", stored_bytes=1, visible=True, ready=True, created=100, observed=100, last_read=None, state="active", cold_storage="c", cool_after=100, residency=100)
    rows = spark.createDataFrame([tuple((base | change).values())], REFERENCE)
    assert tiering.candidates(rows, 1000, 1, 995, 30).first()["reason"] == wanted


def greedy(rows, maximum):
    chosen, seen, total = [], set(), 0
    for chunk, size, eligible in rows:
        if not eligible or chunk in seen:
            continue
        seen.add(chunk)
        if total + size > maximum:
            if not chosen:
                continue
            break
        chosen.append(chunk)
        total += size
    return chosen


def test_member_selection_is_greedy(spark):
    rng = random.Random(3)
    streams = {s: [(rng.randint(1, 9), rng.randint(1, 70), rng.random() < 0.8) for _ in range(12)] for s in range(20)}
    rows = [(s, c, i, size, ok, False, False) for s, cs in streams.items() for i, (c, size, ok) in enumerate(cs)]
    df = spark.createDataFrame(rows, "stream long, chunk_id long, offset long, raw_size long, eligible boolean, packed boolean, shared boolean")
    got = {}
    for r in packs.select_members(df, "stream", 60).orderBy("stream", "position").collect():
        got.setdefault(r["stream"], []).append(r["chunk_id"])
    assert got == {s: c for s, cs in streams.items() if (c := greedy(cs, 60))}


def test_coalesced_gets(spark):
    rows = [(1, 0, 4), (1, 4, 8), (1, 4, 8), (1, 9, 10), (1, 5, 5), (2, 0, 6), (2, 6, 12), (2, 0, 40)]
    got = {r["pack"]: (r["gets"], r["bytes"]) for r in packs.coalesced_gets(spark.createDataFrame(rows, "pack long, lo long, hi long"), ["pack"], 10).collect()}
    assert got == {1: (2, 9), 2: (2, 12)}


def test_budget_keeps_the_first(spark):
    rows = spark.createDataFrame([(1, 1, 50), (1, 2, 10), (2, 1, 5), (2, 2, 5), (2, 3, 5)], "k long, o long, size long")
    assert [(r["k"], r["o"]) for r in packs.budgeted(rows, ["k"], ["o"], "size", 10).orderBy("k", "o").collect()] == [(1, 1), (2, 1), (2, 2)]


def test_chunks_tile_and_survive_a_shift(spark):
    data = random.Random(1).randbytes(60_000)
    ends = ct.cut_points(data, 256, 1024, 4096)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and all(256 <= s <= 4096 for s in sizes[:-1])

    def cut(d):
        e = ct.cut_points(d, 256, 1024, 4096)
        return {d[a:b] for a, b in zip([0, *e], e)}

    assert len(cut(data) & cut(b"xyz" + data)) >= 0.8 * len(ends)
    assert list(ct.windowed_cut((data[i : i + 777] for i in range(0, len(data), 777)), 256, 1024, 4096)) == [data[a:b] for a, b in zip([0, *ends], ends)]
    assert ct.cut_points(b"", 256, 1024, 4096) == [] and ct.cut_points(b"abc", 256, 1024, 4096) == [3]
    row = ct.chunked(spark.createDataFrame([(bytearray(data),), (None,)], "c binary"), F.col("c"), 256, 1024, 4096).collect()
    assert [c["hash"] for c in row[0]["chunks"]] == [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip([0, *ends], ends)] and row[1]["chunks"] == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_merkle_root(spark, n):
    level = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    df = spark.createDataFrame([(level,)], "h array<string>")
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[i + 1]).encode()).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    assert df.select(ct.merkle_root(F.col("h")).alias("r")).first()["r"] == level[0]


def test_page_hashes_and_verification(spark):
    df = spark.createDataFrame([(1, bytearray(b"a" * 10)), (2, bytearray(b""))], "k long, c binary")
    assert [(r["page_no"], r["bytes"]) for r in ct.pages_of(df, "k", F.col("c"), 4).collect()] == [(0, 4), (1, 4), (2, 2)]
    good = hashlib.sha256(b"x").hexdigest()
    rows = spark.createDataFrame([(1, bytearray(b"x"), good, 1), (2, bytearray(b"y"), good, 1), (3, bytearray(b"xx"), good, 1), (4, None, good, 1)], "k long, c binary, e string, s long")
    assert {r["k"]: r["code"] for r in ct.verify_content(rows, F.col("c"), "e", "s").collect()} == {2: "hash", 3: "length", 4: "missing"}


def test_chunk_query_matches_plain_code(spark, data):
    from bytecairn.plans import content as plan

    texts = [(r[0] or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()] + [(r[0] or "").encode() for r in spark.read.parquet(f"{data}/pages.parquet").select("html").collect()]
    chunks = [t[a:b] for t in texts for a, b in (lambda e: zip([0, *e], e))(ct.cut_points(t, 256, 1024, 4096))]
    got = plan.cdc_chunk_dedup(spark, data).first()
    assert (got["chunks"], got["unique_chunks"], got["logical_bytes"], got["unique_bytes"]) == (len(chunks), len(set(chunks)), sum(map(len, chunks)), sum(map(len, set(chunks))))


def test_compression_policy(spark):
    rows = [(1, bytearray(b"repeated words " * 500)), (2, bytearray(random.Random(1).randbytes(8000))), (3, None), (4, bytearray())]
    df = spark.createDataFrame(rows, "k long, c binary")
    assert {r["k"]: r["compress"] for r in ct.compression_policy(df, F.col("c")).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert {r["compress"] for r in ct.compression_policy(df, F.col("c"), "always").collect()} == {True}


def test_promotion_and_placement(spark):
    reads = spark.createDataFrame([("u", t) for t in (0, 1, 2, 10, 11, 12, 30)] + [("v", 5)], "physical string, at_seconds long")
    assert [tuple(r) for r in tiering.promotion_pressure(reads, 10, 3).collect()] == [("u", 2, 3)]
    copies = spark.createDataFrame([("a", "hot", 5, False), ("a", "cold", 5, False), ("b", "cold", 7, False), ("c", "hot", 1, True)], "physical string, tier string, bytes long, retiring boolean")
    assert {r["role"]: r["bytes"] for r in tiering.placement_usage(copies).collect()} == {"hot": 5, "duplicate": 5, "cold": 7, "retiring": 1}
