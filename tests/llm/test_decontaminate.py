"""Decontamination against brute force and SQL."""

import hashlib
import re

import duckdb
import pytest

from bytecairn.llm import decontaminate as dc

from .conftest import edge_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = {i: i + 32 for i in range(65, 91)}
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def brute(docs, items, n=10):
    out = []
    for doc, text in docs:
        own, hit, ids = words(text), set(), set()
        for item, item_text in items:
            w = words(item_text)
            size = min(n, len(w))
            for i in range(len(w) - size + 1 if w else 0):
                for at in range(len(own) - size + 1):
                    if own[at : at + size] == w[i : i + size]:
                        hit |= set(range(at, at + size))
                        if item is not None:
                            ids.add(str(item))
        out.append((doc, len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


DOCS = [
    (1, f"before {PASSAGE.upper()} after"), (2, PASSAGE), (3, "one two three four five six seven eight nine"), (4, f"{PASSAGE} {PASSAGE}"), (5, "a tiny item"), (6, "tiny item"), (7, None), (8, ""), (9, "..."),
    (10, "é" + PASSAGE), (2, PASSAGE), (2, "other text of the same id"), (None, PASSAGE), (11, "one-two.three/four five\nsix\tseven:eight nine9 ten"), (12, "ça va bien, " + PASSAGE.replace("seven", "seven!!")),
]
ITEMS = [(10, PASSAGE), (9, PASSAGE), (1, "Tiny ITEM"), (2, ""), (3, None), (4, "!!"), (None, "tiny item"), (5, "ça va"), (10, PASSAGE)]


def test_report_matches_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted((tuple(r) for r in dc.report(docs, items).collect()), key=str) == brute(DOCS, ITEMS)


def test_the_shuffled_way_agrees(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_CHARS", 0)
    rows = [*DOCS, (90, " ".join(f"w{i % 977}" for i in range(20_000)) + " " + PASSAGE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted((tuple(r) for r in dc.report(docs, items).collect()), key=str) == brute(rows, ITEMS)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = dc.find_hits(docs, items)._jdf.queryExecution().explainString(mode)
    sent = re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[(.*?)\]", plan)
    assert sent and not any("_w#" in columns for columns in sent)


@pytest.mark.parametrize("mode", ["documents", "spans"])
def test_removal(spark, mode):
    docs = spark.createDataFrame([(1, f"left {PASSAGE} right", "k"), (2, "clean, Text", "k")], "doc_id long, text string, _hash string")
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs, items, mode=mode).collect()}
    assert got == ({2: "clean, Text"} if mode == "documents" else {1: "left right", 2: "clean, Text"})


def test_edges(spark, edge, no_documents):
    items = spark.createDataFrame([(1, "words in it"), (2, None)], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert sorted((tuple(r) for r in dc.report(edge, items).collect()), key=str) == brute(rows, [(1, "words in it"), (2, None)])
    assert dc.report(edge, none).where("contaminated").count() == 0
    assert dc.report(no_documents, items).count() == 0
    kept = dc.decontaminate(edge, items)
    assert kept.columns == edge.columns and kept.count() == len(rows) - 1
    assert dc.decontaminate(edge, items, mode="spans").count() == len(rows)


def test_matches_sql(spark, data):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    assert sorted(tuple(r) for r in dc.op6_decontamination(spark, data).collect()) == sorted(con.sql(dc.SQL).fetchall())
