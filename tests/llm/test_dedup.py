"""Line and SimHash dedup against brute force."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from bytecairn.llm import linededup as ld
from bytecairn.llm import simhash as sh

from .conftest import edge_rows


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_lines(rows, least, edits=1):
    """{(doc_id, text): text left}, by comparing every line with every earlier one."""
    seen, out = [], {}
    near = {0: lambda a, b: a == b, 1: within_one, 2: lambda a, b: abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2}[edits]
    order = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    for doc, text in order:
        left = []
        for line in text.split("\n"):
            if not line.strip(" "):
                left.append(line)
                continue
            if not any(line == s or (min(len(line), len(s)) >= least and near(line, s)) for s in seen):
                left.append(line)
            seen.append(line)
        out[doc, text] = "\n".join(left)
    return out


def mutated(rng, line):
    i = rng.randrange(len(line) + 1)
    return rng.choice([line[:i] + rng.choice("abé ") + line[i:], line[: max(0, i - 1)] + line[i:], line[: max(0, i - 1)] + "z" + line[i:]])


def corpus(seed):
    rng = random.Random(seed)
    lines = ["".join(rng.choice("abcdé 中") for _ in range(rng.randint(18, 70))) for _ in range(25)]
    rows = []
    for doc in range(60):
        own = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(lines)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line = mutated(rng, line)
            own.append(line)
        rows.append((doc, "\n".join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_match_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute_lines(rows, ld.MIN_CHARS)
    got = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"]): r["text"] for r in got} == {d: t for (d, _), t in want.items()}


def test_template_lines_differ_by_one_place(spark):
    """A family of lines that differ in one digit: the first stands for all, without their pairs."""
    rows = [(i, f"user number {i // 10}{i % 10} has logged in from the office") for i in range(100)]
    want = brute_lines(rows, ld.MIN_CHARS)
    got = {r["doc_id"]: r["text"] for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: t for (d, _), t in want.items()}


def test_lines_edges(spark, edge, no_documents):
    out = ld.dedup_lines(edge)
    assert out.columns == [*edge.columns, "n_dropped"]
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    want = brute_lines(edge_rows(), ld.MIN_CHARS)
    assert got == sorted(((r[0], want.get((r[0], r[1]))) for r in edge_rows()), key=str)
    assert all(r["_salt"].startswith("_salt-") for r in out.collect())
    assert ld.dedup_lines(no_documents).count() == 0


def test_exact_repeats_of_short_lines_go(spark):
    """Short lines: exact repeats go, near ones stay; a later copy of a document keeps nothing."""
    whole = "a line that is long enough to be compared\nShort.\n\nNo. 1"
    rows = [(1, whole), (2, whole + "\nNo. 2"), (3, "Short.\nshort.\nShort.\nan exact nineteenth\nan exact nineteenthx"), (4, whole)]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (whole, 0), 2: ("\nNo. 2", 3), 3: ("short.\nan exact nineteenth\nan exact nineteenthx", 2), 4: ("", 3)}


@pytest.mark.parametrize("edits,least", [(0, 1), (1, 1), (2, 1), (2, 20)])
def test_other_bounds_match_brute_force(spark, edits, least):
    rng = random.Random(edits * 7 + least)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 26))) for _ in range(12)]
    rows = []
    for doc in range(40):
        own = []
        for _ in range(rng.randint(1, 4)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                line = mutated(rng, line)
            own.append(line)
        rows.append((doc, "\n".join(own)))
    want = brute_lines(rows, least, edits)
    got = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least, edits).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {d: t for (d, _), t in want.items()}
    with pytest.raises(ValueError, match="bound"):
        ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least, 3)


def test_lines_match_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = sorted(con.sql(ld.SQL.strip()).fetchall())
    got = sorted(tuple(r) for r in ld.op8_line_dedup(spark, data).select("doc_id", "text", "n_lines", "n_dropped").collect())
    assert got == want


def slow_fingerprint(text, k=4):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, distance=4):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(fps)):
        groups[root(i)].append(ids[i])
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(fps))]


def test_fingerprint():
    for *_, text, _, _ in [(r[0], r[1], 0, 0) for r in edge_rows()]:
        if text is None or len(text) < 1000:
            assert sh.simhash64(text) == slow_fingerprint(text)
    assert sh.simhash64("A b\x0bC\tD") == slow_fingerprint("a B c d")
    assert sh.simhash64("à B") == xxhash.xxh64_intdigest("à b".encode(), 42)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_large_groups_keep_components(seed):
    """Leaders and cross checks keep exactly the components of the link relation."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = []
    for c in centres:
        x = int(c)
        for _ in range(40):
            if rng.random() < 0.4:
                x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            fps.append(x)
    fps = np.unique(np.array(fps, dtype=np.uint64))
    links = [(int(a), int(b)) for aa, bb in sh._links_of_large(fps[:, None]) for a, b in zip(aa[:, 0], bb[:, 0])]
    assert all((a ^ b).bit_count() <= sh.EXACT.distance for a, b in links) and len(links) < len(fps)
    parent = {int(x): int(x) for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    want = brute_components(list(range(len(fps))), [int(x) for x in fps])
    got = defaultdict(set)
    for i, x in enumerate(fps):
        got[root(int(x))].add(want[i])
    assert all(len(s) == 1 for s in got.values()) and len(got) == len(set(want))


def test_signatures_find_every_pair(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {*base}
    for x in base:
        for n in range(1, 6):
            y = x
            for b in rng.sample(range(64), n):
                y ^= 1 << b
            fps.add(y)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = sh.link_pairs(spark.createDataFrame(signed, "f0 long"))
    got = {frozenset((r["a0"] % (1 << 64), r["b0"] % (1 << 64))) for r in links.collect()}
    want = {frozenset((a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 4}
    assert got == want


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101)]
    out = {r["node"]: r["root"] for r in sh.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(1, 41)) and out[103] == out[101] == 100


def test_simhash_edges(spark, edge, no_documents):
    rows = sorted(sh.near_duplicates(edge).collect(), key=str)
    ids, fps = [r[0] for r in edge_rows()], [sh.simhash64(r[1]) for r in edge_rows()]
    want = sorted(((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, brute_components(ids, fps))), key=str)
    assert sorted((tuple(r) for r in rows), key=str) == want
    kept = sh.keep_one_per_component(edge)
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c for *_, c in want if c is not None})
    assert sh.near_duplicates(no_documents).count() == 0 and sh.keep_one_per_component(no_documents).count() == 0


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, edits):
    out = list(words)
    for i in rng.sample(range(len(out)), edits):
        out[i] = f"new{rng.randrange(10**6)}"
    return out


def test_near_scheme_against_jaccard(spark):
    """Of pairs at 0.8 or more nine in ten are in one component, and no two texts below 0.5 are."""
    rng = random.Random(11)
    texts, pairs = [], []
    for _ in range(250):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(words))
        for share in (0.004, 0.012, 0.02, 0.12):
            texts.append(" ".join(edited(rng, words, max(1, int(len(words) * share)))))
    sets = [shingles(t) for t in texts]
    for base in range(0, len(texts), 5):
        pairs += [(base, base + k, jaccard(sets[base], sets[base + k])) for k in range(1, 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sh.near_duplicates(df, sh.NEAR_SHINGLE, sh.NEAR).collect()
    group = {r["doc_id"]: r["component_id"] for r in rows}
    near = [group[a] == group[b] for a, b, j in pairs if j >= 0.8]
    edge_pairs = [group[a] == group[b] for a, b, j in pairs if 0.8 <= j < 0.85]
    assert len(near) > 400 and np.mean(near) >= 0.95 and len(edge_pairs) > 30 and np.mean(edge_pairs) >= 0.85
    assert not any(group[a] == group[b] for a, b, j in pairs if j < 0.5)
    assert len({g // 5 for g in group.values()}) == 250 and all(g // 5 == d // 5 for d, g in group.items())
    assert all(len(r["fingerprint"]) == 32 for r in rows)


def test_wide_fingerprints_in_large_groups():
    """Leaders keep the components of the link relation for fingerprints of several words too."""
    rng = np.random.default_rng(8)
    fps = []
    for centre in rng.integers(0, 1 << 63, (4, 2), dtype=np.uint64):
        for _ in range(60):
            x = centre.copy()
            for b in rng.integers(0, 128, rng.integers(0, 24)):
                x[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
            fps.append(x)
    fps = np.unique(np.array(fps), axis=0)
    wide = [int(a) << 64 | int(b) for a, b in fps]
    parent = {x: x for x in wide}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for aa, bb in sh._links_of_large(fps, sh.NEAR):
        for a, b in zip(aa, bb):
            a, b = int(a[0]) << 64 | int(a[1]), int(b[0]) << 64 | int(b[1])
            assert (a ^ b).bit_count() <= sh.NEAR.distance
            parent[root(a)] = root(b)
    for a in wide:
        for b in wide:
            if (a ^ b).bit_count() <= sh.NEAR.distance:
                assert root(a) == root(b)
