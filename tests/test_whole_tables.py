"""Queries over whole tables against brute force."""

import hashlib
from collections import defaultdict

from bytecairn.plans import catalogue
from bytecairn.sources import model as m


def rows(spark, data, name):
    return sorted(tuple(r) for r in catalogue.queries()[name](spark, data).collect())


def test_range_digests_whole(spark, data):
    spans = defaultdict(set)
    for r in m.extents(spark, data).collect():
        spans[r["stream_id"]].add((r["lo"], r["hi"], r["chunk_id"]))
    want = []
    for stream, parts in spans.items():
        digest = ""
        for part in sorted(parts):
            digest = hashlib.sha256((digest + ":".join(map(str, part))).encode()).hexdigest()
        want.append((stream, digest))
    assert rows(spark, data, "range_digests_whole") == sorted(want)


def test_positions_join_whole(spark, data):
    asked, sizes = defaultdict(set), {r["chunk_id"]: r["raw_size"] for r in m.chunks(spark, data).collect()}
    for r in m.extents(spark, data).collect():
        asked[r["stream_id"]].add(r["chunk_id"])
    want = [(s, k, c) for s, chunks in asked.items() for k, c in enumerate(sorted(chunks)) if sizes.get(c) is not None and k < sizes[c] / 100]
    assert rows(spark, data, "positions_join_whole") == sorted(want)


def test_versions_latest_flag_whole(spark, data, monkeypatch):
    log = [(key % 3, key, seq, "put") for seq, key in enumerate([1, 39, 40, 41, 1, 40, 900])]  # the table's smallest form has no keys from 40 on
    monkeypatch.setattr(m, "changes", lambda *_: spark.createDataFrame(log, "bucket long, key long, seq long, op string"))
    want = [(*r, not any(x[:2] == r[:2] and x[2] > r[2] for x in log)) for r in log]
    assert rows(spark, data, "versions_latest_flag_whole") == sorted(want)
