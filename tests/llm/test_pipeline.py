"""The pipeline, stage by stage, against brute force on its own inputs."""

import re

import pytest

import corpus_pipeline as cp
from bytecairn.llm import common, simhash

from .conftest import LONG
from .test_dedup import brute_components, brute_lines, jaccard, shingles
from .test_decontaminate import brute as brute_hits

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    """Rows that go into and come out of every stage."""
    base, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{data}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        stage(spark, docs, data).write.parquet(str(base / name))
        after = spark.read.parquet(str(base / name))
        out[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "best_fit_packing"]
    assert all(stages[n][2] == COLUMNS for n, _ in cp.STAGES[:-1])
    assert cp.ORACLE_SQL is None


def test_language_stage_keeps_clean_documents(stages):
    before, after, _ = stages["language_id"]
    kept = {r["doc_id"] for r in after}
    assert {r["doc_id"] for r in before if re.search(r"[^\W\d_]", r["text"] or "")} == kept
    assert all(r["text"] == next(b["text"] for b in before if b["doc_id"] == r["doc_id"]) for r in after)


def test_line_stage(stages):
    before, after, _ = stages["line_dedup"]
    want = brute_lines([(r["doc_id"], r["text"]) for r in before], 20)
    left = {d: t for (d, text), t in want.items() if t == text or t.strip(" ")}
    assert {r["doc_id"]: r["text"] for r in after} == left
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_simhash_stage(stages):
    """What stays is one of every component of the links that the signatures find, and no two texts far apart are one."""
    before, after, _ = stages["simhash_dedup"]
    fps = [[simhash.simhash(r["text"], 5, 2)[k] for k in (0, 1)] for r in before]
    texts, kept = {r["doc_id"]: r["text"] for r in before}, {r["doc_id"] for r in after}
    whole = [a << 64 | b for a, b in fps]
    least = brute_components([r["doc_id"] for r in before], whole, simhash.NEAR.distance)
    assert {r["doc_id"] for r, least_id in zip(before, least) if r["doc_id"] == least_id} <= kept
    for r, least_id in zip(before, least):
        if r["doc_id"] not in kept:
            others = [d for d, other in zip(texts, least) if other == least_id and d != r["doc_id"]]
            assert max(jaccard(shingles(r["text"]), shingles(texts[d])) for d in others) > 0.5
    # copies at a similarity of 0.8 or more: nine in ten go
    sets = [shingles(r["text"]) for r in before]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if 0.8 * max(len(sets[a]), len(sets[b])) <= min(len(sets[a]), len(sets[b])) and jaccard(sets[a], sets[b]) >= 0.8]
    both = [before[a]["doc_id"] in kept and before[b]["doc_id"] in kept for a, b in near]
    assert sum(both) <= 0.1 * len(near)


def test_decontamination_stage(stages, spark, data):
    before, after, _ = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute_hits([(r["doc_id"], r["text"]) for r in before], items) if not r[5]}
    assert {r["doc_id"] for r in after} == clean


def test_packing_stage_and_run(stages, spark, data):
    before, after, _ = stages["best_fit_packing"]
    assert {r["doc_id"] for r in before} == {r["doc_id"] for r in after}
    named = set(common._SCRATCH)
    again = cp.run(spark, data)
    assert len([p for p in common._SCRATCH if p not in named]) == 1  # what it wrote on the way is gone
    strip = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert strip(again.collect()) == strip(after)


def test_stages_take_empty_tables(spark, data):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, data)
        assert out.count() == 0, name


#: Ids that every stage keeps, of the rows below, when it alone takes them.
NULLS = [(None, None, None, None, None), (1, "some text in a language that is known here", "en", None, 3), (2, "", "en", "s", None), (3, LONG, "en", "s", 1), (3, LONG, "en", "s", 1), (4, None, "en", "s", 1)]
KEPT = {
    "language_id": [1, 3, 3],
    "line_dedup": [None, 1, 2, 3, 3, 4],
    "simhash_dedup": [1, 2, 3],  # the three texts without words are one component
    "decontamination": [None, 1, 2, 3, 3, 4],
}


def test_stages_take_nulls_long_texts_and_clashing_columns(spark, data):
    docs = spark.createDataFrame([(*r, "x", "y", 7) for r in NULLS], "doc_id long, text string, lang string, source string, n_chars long, _key string, `row` string, _no int")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == COLUMNS
        rows = out.collect()
        assert sorted((r["doc_id"] for r in rows), key=str) == sorted(KEPT[name], key=str), name
        assert all(r["text"] == LONG for r in rows if r["doc_id"] == 3), name
    pieces = cp.STAGES[-1][1](spark, docs, data).collect()
    assert {r["doc_id"] for r in pieces} == {None, 1, 2, 3, 4}
    assert all(len(r["ids"]) == r["length"] for r in pieces)
