"""Tokens against the whole tokenizer, and packing invariants."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bytecairn.llm import packing as pk

from .conftest import LONG, edge_rows

PATH = public_tokenizers.path(pk.VOCABULARY)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_word_by_word_gives_the_same_ids(tokenizer):
    own = pk.WordTokenizer(PATH)
    rng = random.Random(2)
    letters = "abzAÉéßŞİıΣσςàé \n\t  .,!'<|>19٣中\x1c -_endoftext#$"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["<|endoftext|>", "a <|startoftext|>b", "it's don't we'll 'S'S", "ǅ ŉ ǰ", "ﬁ Ωmega", "A" * 3000, LONG[:5000]]
    for t in texts:
        assert np.frombuffer(own.text(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_long_texts_are_cut_between_words(tokenizer, monkeypatch):
    text = "word " * 300_000 + "x" * 1_200_000
    parts = list(pk.slices(text))
    assert "".join(parts) == text and len(parts) == 2
    assert list(pk.slices("")) == [""] and list(pk.slices("x" * 3_000_000)) == ["x" * 3_000_000]


def brute_best_fit(lengths, capacity):
    bins = []
    for i, n in enumerate(lengths):
        fits = [b for b in bins if b[0] + n <= capacity]
        if fits:
            best = max(fits, key=lambda b: b[0])
            best[0] += n
            best[1].append(i)
        else:
            bins.append([n, [i]])
    return bins


def test_best_fit_fills_like_brute_force():
    rng = random.Random(3)
    for _ in range(20):
        lengths = sorted((rng.randint(1, 100) for _ in range(200)), reverse=True)
        got = pk.best_fit(lengths, 100)
        assert sorted(sum(lengths[i] for i in b) for b in got) == sorted(b[0] for b in brute_best_fit(lengths, 100))
        assert sorted(i for b in got for i in b) == list(range(200))


def check(rows, want, capacity):
    """Every piece once, sequences gapless and within capacity."""
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def expected(tokenizer, rows, capacity):
    out = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


@pytest.mark.parametrize("partitions,fan_in", [(1, 8), (13, 2)])
def test_edges_and_tree(spark, edge, tokenizer, partitions, fan_in):
    rows = pk.pack(pk.pieces(edge.repartition(partitions), 128), 128, fan_in).collect()
    n = check(rows, expected(tokenizer, [(r[0], r[1]) for r in edge_rows()], 128), 128)
    assert n <= -(-sum(r["length"] for r in rows) // 128) + 1


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def test_bins_that_cannot_merge(spark):
    rows = spark.createDataFrame([(i, 0, 0, 60, 0) for i in range(500)], SCHEMA).repartition(9)
    packed = pk.pack(rows, 100, 3).collect()
    assert check(packed, [(i, 0, 0, 60, 0) for i in range(500)], 100) == 500


@pytest.mark.parametrize("seed,fan_in,local,most", [(1, 2, 20_000, 1.02), (2, 3, 5000, 1.04), (3, 8, 2000, 1.08)])
def test_tree_of_rounds(spark, monkeypatch, seed, fan_in, local, most):
    """Many partitions and several levels: every piece placed once; partitions of a few bins each cost some sequences."""
    monkeypatch.setattr(pk, "LOCAL_TOKENS", local)
    rng = random.Random(seed)
    want = [(i, 0, 0, rng.choice([rng.randint(1, 100), rng.randint(1, 20), 100, 51, 33]), 0) for i in range(1500)]
    rows = spark.createDataFrame(spark.sparkContext.parallelize(want, 17), SCHEMA)
    n = check(pk.pack(rows, 100, fan_in).collect(), want, 100)
    lengths = sorted((w[3] for w in want), reverse=True)
    assert n <= most * len(brute_best_fit(lengths, 100)) + 1


def test_other_columns_travel(spark):
    rows = spark.createDataFrame([(None, 0, 0, 3, 7, [1, 2, 3]), (2, 0, 0, 1, 8, [5])], SCHEMA + ", ids array<int>")
    assert sorted((r["ids_crc32"], r["doc_id"], r["ids"]) for r in pk.pack(rows, 8).collect()) == [(7, None, [1, 2, 3]), (8, 2, [5])]


def test_plan_is_best_fit():
    rng = random.Random(6)
    for case in range(40):
        lengths = sorted((rng.choice([rng.randint(1, 100), 60, 7]) for _ in range(rng.randint(0, 300))), reverse=True)
        seen, places = defaultdict(int), defaultdict(list)
        plan, bins = pk.best_fit_plan(Counter(lengths), 100)
        for n in lengths:
            rank, seen[n] = seen[n], seen[n] + 1
            _, start, sequence, each, at = max(row for row in plan if row[0] == n and row[1] <= rank)
            places[sequence + (rank - start) // each].append((at + (rank - start) % each * n, n))
        assert sorted(places) == list(range(len(places)))
        for sequence in places.values():
            end = 0
            for offset, n in sorted(sequence):
                assert offset == end
                end += n
        fills = sorted(sum(n for _, n in s) for s in places.values())
        assert fills == sorted(b[0] for b in brute_best_fit(lengths, 100)), case
        assert fills == sorted(f for f, _, n in bins for _ in range(n))
        assert sorted(s for _, first, n in bins for s in range(first, first + n)) == list(range(len(places)))


def test_short_pieces_fill_sequences_of_other_partitions(spark, monkeypatch):
    """Long pieces in some partitions, short ones in others: as few sequences as best fit over all of them gives, or nearly, in many partitions."""
    want = [(i, 0, 0, 60 if i < 200 else 20, 0) for i in range(600)]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    rows = spark.createDataFrame(spark.sparkContext.parallelize(want, 6), schema)
    assert check(pk.pack(rows, 100).collect(), want, 100) == 200
    monkeypatch.setattr(pk, "LOCAL_TOKENS", 5000)
    assert check(pk.pack(rows, 100).collect(), want, 100) <= 208


def test_tables(spark, no_documents, data, tokenizer):
    assert pk.pack(pk.pieces(no_documents)).count() == 0
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows = pk.op10_packing(spark, data).collect()
    n = check(rows, expected(tokenizer, docs, pk.CAPACITY), pk.CAPACITY)
    assert n <= -(-sum(r["length"] for r in rows) // pk.CAPACITY) * 1.02 + 1


def test_ids_come_with_pieces_on_request(spark, tokenizer):
    row = pk.pieces(spark.createDataFrame([(1, "Hello there")], "doc_id long, text string"), with_ids=True).first()
    assert row["ids"] == tokenizer.encode("Hello there", add_special_tokens=False).ids + [1]


def test_packed_corpus_holds_its_ids(spark, edge, tokenizer):
    rows = pk.packed_corpus(edge, 128).collect()
    check(rows, expected(tokenizer, [(r[0], r[1]) for r in edge_rows()], 128), 128)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in rows)
