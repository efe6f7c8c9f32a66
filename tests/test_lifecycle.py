"""Garbage copies, quotas, promotion windows, strict replay, streaming rates and image sizes: small cases and brute force."""

import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from bytecairn.functions import image
from bytecairn.operators import content as ct
from bytecairn.operators import history as h
from bytecairn.operators import lifecycle as lc
from bytecairn.operators import tiering
from bytecairn.plans import catalogue
from bytecairn.streaming import jobs


def test_garbage_copies(spark):
    schema = "id long, address long, storage long, state string, owner long, unreferenced long, stored long, activated long, recovering boolean"
    base = dict(id=1, address=1, storage=0, state="retired", owner=None, unreferenced=0, stored=0, activated=None, recovering=False)
    rows = [base, base | {"id": 2, "state": "ready"}, base | {"id": 3, "owner": 9}, base | {"id": 4, "unreferenced": 950}, base | {"id": 5, "stored": 600}, base | {"id": 6, "stored": None}, base | {"id": 7, "activated": 600}, base | {"id": 8, "state": "deleted", "recovering": True}, base | {"id": 9, "state": "deleted"}, base | {"id": 10, "address": 77}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    kept = spark.createDataFrame([(77,)], "address long")
    got = {r["id"]: r["age_unknown"] for r in lc.garbage_copies(df, kept, 1000, 100, 500).collect()}
    assert got == {1: False, 6: True, 8: True}
    assert {r["id"] for r in lc.garbage_copies(df, kept, 1000, 100, 0).collect()} == {1, 5, 6, 7, 8}


def test_quota_counts_what_is_reserved(spark):
    rows = spark.createDataFrame([("a", 10, 0, None), ("b", 5, 5, 10), ("c", 5, 6, 10), ("d", 0, 0, 0), ("e", 1, 0, 0)], "scope_id string, used long, reserved long, used_limit long")
    assert {r["scope_id"]: r["allowed"] for r in lc.quota_state(rows).collect()} == {"a": True, "b": True, "c": False, "d": True, "e": False}


def brute_windows(reads, width, threshold):
    out = {}
    for unit in {u for u, _ in reads}:
        since, n, counts = None, 0, []
        for t in sorted(t for u, t in reads if u == unit):
            if since is not None and since + width > t:
                n += 1
            else:
                counts += [n] if since is not None else []
                since, n = t, 1
        hot = [c for c in [*counts, n] if c >= threshold]
        if hot:
            out[unit] = (len(hot), max(hot))
    return out


def test_promotion_windows_begin_at_the_first_read_after_the_last(spark):
    """Reads at 0, 15 and 22: the second window begins at 15, not at 10, so it holds two."""
    rng = random.Random(3)
    reads = [("told", t) for t in (0, 15, 22)] + [(f"u{i % 5}", rng.randrange(300)) for i in range(200)]
    got = {r["physical"]: (r["hot_windows"], r["most"]) for r in tiering.promotion_pressure(spark.createDataFrame(reads, "physical string, at_seconds long"), 10, 2).collect()}
    assert got == brute_windows(reads, 10, 2) and got["told"] == (1, 2)


def test_units_that_nobody_or_too_many_refer_to(spark):
    schema = "physical long, stored_bytes long, visible boolean, ready boolean, created long, observed long, last_read long, state string, cold_storage long, cool_after long, residency long"
    row = lambda p: (p, 7, True, True, 1, 1, None, "active", 3, 10, 10)
    rows = spark.createDataFrame([row(1), row(2), row(2), row(2)], schema)
    got = tiering.candidates(rows, 1000, 1, 990, 900, spark.createDataFrame([(1,), (2,), (3,)], "physical long"), 2)
    assert {r["physical"]: (r["stored_bytes"], r["reason"]) for r in got.collect()} == {1: (7, "eligible"), 2: (7, "references_unconfirmed"), 3: (0, "references_unconfirmed")}


def read_strictly(rows):
    """One change after the other; the first refusal ends a bucket."""
    out = {}
    for bucket in {r[0] for r in rows}:
        mark, newest, visible, slots, paused, why = 0, 0, None, {}, False, None
        ready = False
        own = sorted((r for r in rows if r[0] == bucket), key=lambda r: r[2])
        numbers = [r[2] for r in own]
        for _, key, seq, op, generation, size in own:
            if seq != mark + 1 or numbers.count(seq) > 1:
                why = (seq, "sequence")
            elif op == "start" and generation != newest + 1:
                why = (seq, "generation")
            elif op != "start" and newest == 0:
                why = (seq, "baseline")
            elif op != "start" and generation != newest:
                why = (seq, "identity")
            elif op == "ready" and ready:
                why = (seq, "published")
            if why:
                break
            mark = seq
            if op == "start":
                newest, ready, paused = generation, False, False
                slots[generation] = {}
            elif op == "ready":
                visible, ready = generation, True
            elif op == "drop":
                newest, visible, slots, ready, paused = 0, None, {}, False, False
            elif op in ("pause", "resume"):
                paused = op == "pause"
            elif op == "put":
                slots[generation][key] = (seq, size)
            else:
                slots[generation].pop(key, None)
        keys = {(bucket, k, *v) for k, v in slots.get(visible, {}).items()} if visible else set()
        out[bucket] = (why or (None, None), paused, keys)
    return out


LOG = "bucket long, key string, seq long, op string, generation long, size long"


def journals():
    start, ready, drop = (lambda g, s: (None, s, "start", g)), (lambda g, s: (None, s, "ready", g)), (lambda g, s: (None, s, "drop", g))
    cases = [
        [start(1, 1), ("a", 2, "put", 1), ready(1, 3), ("b", 4, "put", 1)], [start(1, 1), ("a", 3, "put", 1)], [start(2, 1)], [("a", 1, "put", 1)], [start(1, 1), ready(1, 2), ready(1, 3)],
        [start(1, 1), ("a", 2, "put", 1), ready(1, 3), start(2, 4), ("a", 5, "put", 1)], [start(1, 1), ("a", 2, "put", 1), ready(1, 3), drop(1, 4), start(1, 5), ("b", 6, "put", 1), ready(1, 7), (None, 8, "pause", 1)],
        [start(1, 1), ready(1, 2), ("a", 3, "put", 1), ("a", 3, "put", 1)], [start(1, 1), ready(1, 2), drop(1, 3), ("a", 4, "put", 1)], [start(1, 1), ("a", 2, "put", 1), start(2, 3), ("b", 4, "put", 2), ready(2, 5), (None, 6, "pause", 2), (None, 7, "resume", 2)], [start(1, 2)],
    ]
    rows = [(b, k, s, op, g, 10 * s) for b, case in enumerate(cases) for k, s, op, g in case]
    rng = random.Random(12)
    for bucket in range(100, 130):
        seq, generation = 0, 0
        for _ in range(rng.randint(1, 25)):
            seq += 2 if rng.random() < 0.02 else 1
            op = "start" if seq == 1 else rng.choice(["put", "put", "put", "delete", "start", "ready", "drop", "pause", "resume"])
            generation += op == "start"
            rows.append((bucket, rng.choice("abc") if op in ("put", "delete") else None, seq, op, generation + (rng.random() < 0.02), seq))
            generation = 0 if op == "drop" else generation
    return rows


def test_strict_replay_equals_a_sequential_reader(spark):
    rows = journals()
    catalogue_rows, buckets = h.replay_strict(spark.createDataFrame(rows, LOG))
    want = read_strictly(rows)
    assert {r["bucket"]: ((r["failed_at"], r["reason"]), r["paused"]) for r in buckets.collect()} == {b: (why, paused) for b, (why, paused, _) in want.items()}
    assert {(r["bucket"], r["key"], r["seq"], r["size"]) for r in catalogue_rows.collect()} == set().union(*(keys for *_, keys in want.values()))
    assert {why[1] for why, *_ in want.values()} == {None, "sequence", "generation", "baseline", "identity", "published"}


def test_streaming_rates_count_losses_and_forget_silent_nodes(spark, tmp_path):
    schema = "node long, ts timestamp, boot long, sequence long, uptime long, requests long"
    from datetime import datetime, timedelta

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    batches = [
        [(1, at(0), 1, 1, 0, 0), (1, at(60), 1, 2, 60, 30), (2, at(0), 1, 1, 0, 5), (3, at(0), 1, 1, 0, 0)],
        [(1, at(120), 1, 3, 120, 90), (1, at(50), 1, 2, 60, 30), (2, at(60), 2, 2, 60, 50), (3, at(60), 1, 2, 60, 1)],
        [(2, at(120), 2, 3, 120, 40), (2, at(180), 2, 4, 180, 45), (9, at(100_000), 1, 1, 0, 0)],
        [(9, at(100_060), 1, 2, 60, 6)],
        [(3, at(100_100), 1, 3, 120, 9), (9, at(100_120), 1, 3, 120, 7)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = jobs.drain(spark, jobs.counter_rates(stream, ["requests"], 3600, "10 seconds", 5000), [], lambda r: r, "append").collect()
    rates = {(r["node"], r["sequence"]): (r["seconds"], r["d_requests"]) for r in out if r["kind"] == "rate"}
    assert rates == {(1, 2): (60, 30), (1, 3): (60, 60), (3, 2): (60, 1), (2, 4): (60, 5), (9, 2): (60, 6), (9, 3): (60, 1)}
    assert sum(r["n"] for r in out if r["kind"] == "dropped") == 1
    assert {r["node"] for r in out if r["kind"] == "expired"} >= {1, 2, 3}


def test_streaming_replay_takes_changes_in_any_order(spark, tmp_path):
    rows = [r for r in journals() if r[0] < 3 or r[0] in (6, 9)]
    random.Random(5).shuffle(rows)
    for k in range(3):
        spark.createDataFrame(rows[k::3], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    slots = jobs.drain(spark, jobs.replay(stream), [], lambda r: r.drop("_batch"), "update")
    key = lambda df: sorted((r["bucket"], r["key"], r["seq"], r["size"]) for r in df.collect())
    assert key(jobs.replayed(slots)) == key(h.replay(spark.createDataFrame(rows, LOG)))


#: Sizes of a wide, a tall and a small image under every limit.
SIZES = {"150i": ("300x150", "75x150"), "150p": ("150x75", "150x300"), "300i": ("600x300", "150x300"), "300p": ("300x150", "300x600"), "300x": ("300x150", "150x300"), "500i": ("1000x500", "250x500"), "500x": ("500x250", "250x500"), "600p": ("600x300", "600x1200"), "1000i": ("2000x1000", "500x1000"), "1000x": ("1000x500", "500x1000"), "1200p": ("1200x600", "1200x2400"), None: ("2400x1200", "1200x2400")}


def test_image_sizes(spark):
    """All fifty styles: two qualities of every limit in two formats, and both formats without quality and limit."""
    styles = [(f"q{q}.{limit + '.' if limit else ''}{form}", limit) for q in (80, 90) for limit in SIZES for form in ("jpeg", "webp")] + [("jpeg", None), ("webp", None)]
    assert len(styles) == 50
    rows = [(style, *SIZES[limit], w, h_, name) for style, limit in styles for w, h_, name in ((2400, 1200, "wide"), (1200, 2400, "tall"), (100, 50, "small"))]
    df = spark.createDataFrame(rows, "style string, wide string, tall string, w int, h int, name string").withColumn("to", image.fitted(F.col("w"), F.col("h"), F.col("style")))
    for r in df.collect():
        assert f"{r['to']['width']}x{r['to']['height']}" == {"wide": r["wide"], "tall": r["tall"], "small": "100x50"}[r["name"]], r["style"]


def test_more_checksums(spark, data):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r["text"] is not None}
    got = {r["doc_id"]: (r["crc32"], r["xxh64"] % (1 << 64)) for r in catalogue.queries()["more_checksums"](spark, data).collect() if r["doc_id"] in texts}
    assert got == {d: (zlib.crc32(t), xxhash.xxh64_intdigest(t, 42)) for d, t in texts.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_every_leaf_proves_the_root(spark, n):
    df = spark.createDataFrame([([f"{i:064x}" for i in range(n)], at) for at in range(n)], "hashes array<string>, at int")
    out = df.select(ct.merkle_root(F.col("hashes")).alias("root"), ct.proven_root(F.get("hashes", F.col("at")), ct.merkle_proof(F.col("hashes"), F.col("at"))).alias("proven"))
    assert all(r["root"] == r["proven"] for r in out.collect())
