"""Language ID, quality and language model: held-out accuracy, exact counts, brute-force inference."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytecairn.llm import langid, maxent, quality
from bytecairn.llm.common import fold_of

from .conftest import edge_rows


def fold(doc, n):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % n


@pytest.fixture(scope="module")
def small(data):
    return data.replace("sf0.001", "sf0.01")


def test_language_held_out(spark, small):
    got = langid.op5_language_id(spark, small).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(got) == len(truth) and all(r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, edge, no_documents):
    model = langid.fit(edge, F.lit(True))
    out = langid.identify(edge, model)
    assert out.columns == edge.columns
    for r in out.collect():
        no_letter = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == no_letter and 0 <= r["score"] <= 1 and r["_p"].startswith("_p-")
    assert langid.fit(no_documents, F.lit(True)) is None
    assert langid.identify(no_documents, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(edge, None).collect()} == {"und"}


def test_every_language_is_learned_from_distinct_texts(spark):
    rows = [(i, f"words of language {i} and more", f"l{i:03}") for i in range(230)]
    rows += [(1000 + i, "the same text again and again", "copies") for i in range(900)] + [(2000 + i, f"own text {i}", "copies") for i in range(5)]
    sample = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), 10)
    assert {r["lang"] for r in sample.collect()} == {r[2] for r in rows}
    assert sample.where("lang = 'copies'").count() == 6
    windows = langid.training_windows(spark.createDataFrame([("x", "abc " * 100_000)], "lang string, text string")).first()["windows"]
    assert len(windows) == langid.WINDOWS_PER_DOCUMENT * langid.WINDOW


def test_window_scores_match_direct_convolution():
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b"], [rng.normal(size=(k, 256, langid.FILTERS)).astype(np.float32) for k in langid.WIDTHS], rng.normal(size=24).astype(np.float32), rng.normal(size=(24, 2)).astype(np.float32), rng.normal(size=2).astype(np.float32))
    windows = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    pooled, _ = langid._responses(model.filters, windows)
    z = np.maximum(pooled + model.bias, 0) @ model.out + model.out_bias
    assert np.allclose(langid.Scorer(model).log_probabilities(windows), np.log(langid._softmax(z)), atol=1e-3)


def test_prediction_matches_the_definition():
    """Whole texts: every window by direct convolution, weighted by the bytes it adds."""
    rng = np.random.default_rng(6)
    model = langid.Model(["a", "b", "c"], [rng.normal(size=(k, 256, langid.FILTERS)).astype(np.float32) for k in langid.WIDTHS], rng.normal(size=24).astype(np.float32), rng.normal(size=(24, 3)).astype(np.float32) / 3, rng.normal(size=3).astype(np.float32))
    texts = ["Short", "Ä word " * 90, "".join(chr(97 + i * i % 26) for i in range(3 * langid.WINDOW)), "x" * (langid.WINDOW + 1)]
    names, p = langid.Scorer(model).predict(texts)
    for text, name, best in zip(texts, names, p):
        data = text.lower().encode()
        spans = [(a, langid.WINDOW) for a in range(0, len(data) - langid.WINDOW + 1, langid.WINDOW)] if len(data) > langid.WINDOW else [(0, len(data))]
        windows = [data[a : a + n] for a, n in spans]
        if len(data) > langid.WINDOW and len(data) % langid.WINDOW:
            windows.append(data[-langid.WINDOW :])
            spans.append((len(data) - langid.WINDOW, len(data) % langid.WINDOW))
        total = np.zeros(3)
        for w, (_, n) in zip(windows, spans):
            w = (w * (langid.WINDOW // len(w) + 1))[: langid.WINDOW]
            pooled = [max(sum(float(bank[j, w[at + j], f]) for j in range(len(bank))) for at in range(len(w) - len(bank) + 1)) for bank in model.filters for f in range(langid.FILTERS)]
            z = np.maximum(np.array(pooled) + model.bias, 0) @ model.out + model.out_bias
            total += n * (z - z.max() - np.log(np.exp(z - z.max()).sum()))
        want = langid._softmax((total / len(data))[None])[0]
        assert name == model.languages[want.argmax()] and best == pytest.approx(want.max(), abs=2e-3)


def test_windows_cover_every_byte():
    for n in (1, 383, 384, 385, 768, 1000):
        data = bytes(i % 251 for i in range(n))
        w, weight = langid.windows_of(data)
        assert weight.sum() == n
        if n > langid.WINDOW:
            whole = w[weight == langid.WINDOW].tobytes() + (w[-1][-(n % langid.WINDOW) :].tobytes() if n % langid.WINDOW else b"")
            assert whole == data


def test_quality_held_out(spark, small):
    got = {r["doc_id"]: r for r in quality.op2_quality(spark, small).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{small}/labels.parquet").collect()]
    held = [(d, q) for d, q in labels if fold(d, 3) == 1]
    assert all(r["held_out"] == (fold(d, 3) == 1) and r["predicted"] == int(r["score"] >= 0.5) for d, r in got.items())
    assert np.mean([got[d]["predicted"] == q for d, q in held]) > 0.95
    bad = [got[d]["score"] for d, q in held if q == 0]
    assert bad and np.mean([got[d]["score"] for d, q in held if q == 1]) > np.mean(bad) + 0.3


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(2)
    transition, start, counts = rng.normal(size=(2, 2)), rng.normal(size=2), np.array([3, 0, 1, 5])
    score = rng.normal(size=counts.sum())
    good, pairs = quality.forward_backward(score, counts, transition, start)
    want, seen, at = [], np.zeros((2, 2)), 0
    for n in counts:
        total, marginal, joint = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)) if n else []:
            w = math.exp(start[y[0]] + sum(score[at + i] for i in range(n) if y[i]) + sum(transition[a, b] for a, b in zip(y, y[1:])))
            total += w
            marginal += w * np.array(y)
            for a, b in zip(y, y[1:]):
                joint[a, b] += w
        if n:
            want += list(marginal / total)
            seen += joint / total
        at += n
    assert np.allclose(good, want) and np.allclose(pairs, seen)


def test_quality_edges(spark, edge, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (5, 1, 0), (None, 1, 0), (7, None, 0), (8, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    crf = quality.fit(edge, labels, F.lit(True))
    out = quality.score_quality(edge, crf)
    assert out.columns == [*edge.columns, "predicted"]
    rows = out.collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert {round(r["score"], 6) for r in rows if not (r["text"] or "").strip()} == {round(crf.share, 6)}
    none = quality.fit(edge, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score_quality(edge, none).collect()} == {0.5}
    one = quality.fit(edge, labels.where("quality = 1 AND doc_id <> 8"), F.lit(True))
    assert all(r["score"] > 0.99 for r in quality.score_quality(edge, one).collect())
    assert quality.score_quality(no_documents, crf).count() == 0


def test_quality_score_matches_the_definition():
    """Whole scores: labels of all lines enumerated, marginals weighted by line length, then the logistic."""
    rng = np.random.default_rng(9)
    crf = quality.Crf(rng.normal(size=quality.N_EMISSION) / 3, rng.normal(size=(2, 2)), rng.normal(size=2), 0.7, -0.2, 0.4)
    texts = ["One line only.", "First line!\n\n  \nSECOND 22 $$\nthird third third", "", "a\nb b\nC?\nd d d d\n" * 2]
    for text, got in zip(texts, quality.quality_of(crf, texts)):
        x, size, counts = quality.line_features([text])
        if not len(x):
            assert got == crf.share
            continue
        zero = np.zeros(quality.N_FEATURES)
        score = [np.concatenate([x[i], x[i - 1] if i else zero, x[i + 1] if i + 1 < len(x) else zero]) @ crf.emission for i in range(len(x))]
        total, good = 0.0, np.zeros(len(x))
        for y in itertools.product((0, 1), repeat=len(x)):
            w = math.exp(crf.start[y[0]] + sum(s for s, label in zip(score, y) if label) + sum(crf.transition[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
        raw = float(good / total @ size / size.sum())
        assert got == pytest.approx(1 / (1 + math.exp(-(crf.scale * math.log(raw / (1 - raw)) + crf.shift))), abs=1e-6)


def test_neighbours_stay_within_a_text():
    x = np.arange(1, 6, dtype=np.float32)[:, None] * np.ones((1, quality.N_FEATURES), np.float32)
    wide = quality.with_neighbours(x, np.array([2, 0, 3]))
    assert wide[:, quality.N_FEATURES].tolist() == [0, 1, 0, 3, 4] and wide[:, -1].tolist() == [2, 0, 4, 5, 0]


def brute_counts(rows):
    c = Counter()
    for doc, text in rows:
        if fold(doc, 7) != 2:
            c.update([*(text or "").encode().lower().split(), b""])
    n, v = sum(c.values()), len(c)
    out = []
    for doc, text in rows:
        w = [*(text or "").encode().lower().split(), b""]
        out.append((doc, fold(doc, 7) == 2, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return out


def compare(got, want):
    key = lambda r: str(r[:5])
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want])


def test_model_counts_and_gain(spark, small):
    got = maxent.op3_lm_score(spark, small).collect()
    compare(got, brute_counts([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]))
    held = [r for r in got if r["held_out"]]
    gain = (sum(r["score"] for r in held) - sum(r["base_score"] for r in held)) / sum(r["n_tokens"] for r in held)
    assert gain > 0.25
    assert all(r["score"] < 0 for r in got)


ROWS = 64
LM_ROWS = [(i, " ".join(f"w{(i * 7 + k * k) % 13}" for k in range(i % 9))) for i in range(40)] + [(40, None), (None, "w1 w2"), (41, "x" * 90 + " w3")]


def slow_features(words, at):
    """Hashes of the three features of a position, with Python integers."""
    code = lambda k: zlib.crc32(words[k]) if k >= 0 else maxent.BEGIN
    wrap = (1 << 64) - 1

    def mix(x):
        x = x * 0x9E3779B97F4A7C15 & wrap
        return (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & wrap

    one, two = code(at - 1), code(at - 2)
    return [mix(one + (1 << 32)), mix(two + (2 << 32)), mix(mix(one) ^ (two + (3 << 32)))]


class SlowModel:
    """The model by its definition, position by position."""

    def __init__(self, texts, rounds):
        self.c = Counter(w for t in texts for w in t)
        self.n, self.v = sum(self.c.values()), len(self.c)
        mass = [1.0] * maxent.LEAVES
        for w, n in self.c.items():
            mass[self.leaf(w)] += n + 1
        self.mass = np.array(mass).reshape(maxent.CLASSES, maxent.SLOTS)
        self.bias = np.log(self.mass.sum(axis=1) / self.mass.sum())
        self.word_bias = np.log(self.mass / self.mass.sum(axis=1, keepdims=True))
        self.w = [np.zeros((ROWS, maxent.CLASSES)), np.zeros((ROWS, maxent.SLOTS))]
        spots = [(t, k) for t in texts for k in range(len(t))]
        observed = [np.zeros_like(x) for x in self.w]
        for t, k in spots:
            cls, slot = divmod(self.leaf(t[k]), maxent.SLOTS)
            for f, g in zip(*self.rows(t, k, cls)):
                observed[0][f, cls] += 1
                observed[1][g, slot] += 1
        prior = [np.tile(np.exp(self.bias), (ROWS, 1)), np.array([np.exp(self.word_bias[g % maxent.CLASSES]) for g in range(ROWS)])]
        for _ in range(rounds):
            expected = [np.zeros_like(x) for x in self.w]
            for t, k in spots:
                cls = self.leaf(t[k]) // maxent.SLOTS
                p, q = self.shares(t, k, cls)
                for f, g in zip(*self.rows(t, k, cls)):
                    expected[0][f] += p
                    expected[1][g] += q
            for w, o, e, b in zip(self.w, observed, expected, prior):
                taken = maxent.DISCOUNT * (o > 0).sum(axis=1, keepdims=True)
                w += np.log((np.maximum(o - maxent.DISCOUNT, 0) + (taken + maxent.PRIOR) * b) / (e + maxent.PRIOR * b)) / maxent.DAMPING

    @staticmethod
    def leaf(word):
        return int(maxent.leaves_of(np.array([zlib.crc32(word)], np.uint64))[0])

    @staticmethod
    def rows(t, k, cls):
        f = slow_features(t, k)
        return [x >> 40 & ROWS - 1 for x in f], [(x >> 12 & ROWS // maxent.CLASSES - 1) * maxent.CLASSES + cls for x in f]

    def shares(self, t, k, cls):
        f, g = self.rows(t, k, cls)
        z, z2 = np.exp(self.bias + sum(self.w[0][x] for x in f)), np.exp(self.word_bias[cls] + sum(self.w[1][x] for x in g))
        return z / z.sum(), z2 / z2.sum()

    def probability(self, t, k):
        cls, slot = divmod(self.leaf(t[k]), maxent.SLOTS)
        p, q = self.shares(t, k, cls)
        return p[cls] * q[slot] * (self.c[t[k]] + 1) / self.mass[cls, slot]


def tokens_of_text(text):
    return [*maxent.words_of(text), maxent.END]


@pytest.mark.parametrize("partitions", [1, 5])
def test_scores_match_the_definition(spark, partitions):
    """Two rounds over every position of every training text, and every score, against plain Python; dealing texts otherwise changes nothing."""
    df = spark.createDataFrame(LM_ROWS, "doc_id long, text string").repartition(partitions)
    got = maxent.score(df, fold_of(F.col("doc_id"), 7) == 2, ROWS).collect()
    compare(got, brute_counts([(d, t) for d, t in LM_ROWS]))
    slow = SlowModel([tokens_of_text(t) for d, t in LM_ROWS if fold(d, 7) != 2], maxent.ROUNDS)
    want = {(d, t): sum(math.log10(slow.probability(tokens_of_text(t), k)) for k in range(len(tokens_of_text(t)))) for d, t in LM_ROWS}
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(want.values()), rel=1e-4)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert all(by_id[d] == pytest.approx(s, rel=1e-4) for (d, _), s in want.items())


def test_model_is_a_distribution():
    """All words seen and one unseen word per leaf add up to one in any context."""
    slow = SlowModel([tokens_of_text(t) for _, t in LM_ROWS], 2)
    known = sum(slow.probability([b"w1", b"w2", w], 2) for w in slow.c)
    unseen = 0.0
    for cls in range(maxent.CLASSES):
        p, q = slow.shares([b"w1", b"w2", b""], 2, cls)
        unseen += sum(p[cls] * q / slow.mass[cls])
    assert known + unseen == pytest.approx(1)


def test_a_text_id_is_kept(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", None)], "doc_id string, text string")
    assert sorted(r["doc_id"] for r in maxent.score(df, F.lit(False)).collect()) == ["a", "b"]


def test_model_edges(spark, edge, no_documents):
    got = maxent.score(edge, fold_of(F.col("doc_id"), 7) == 2).collect()
    compare(got, brute_counts([(r[0], r[1]) for r in edge_rows()]))
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert maxent.score(no_documents, fold_of(F.col("doc_id"), 7) == 2).count() == 0
    alone = maxent.score(edge.where("doc_id = 1"), F.lit(True)).collect()
    assert [r["train_tokens"] for r in alone] == [0] and np.isfinite(alone[0]["score"])


def test_sums_by_row():
    rng = np.random.default_rng(4)
    for n, rows in ((1, 4), (300, 5), (500, 4000)):
        at, values = rng.integers(0, rows, (n, 3)), rng.normal(size=(n, 2)).astype(np.float32)
        got, want = np.zeros((rows, 2), np.float32), np.zeros((rows, 2))
        maxent._add_by_row(got, at, values)
        for r, v in zip(at, values):
            for x in r:
                want[x] += v
        assert np.allclose(got, want, atol=1e-3)


def test_features_do_not_cross_texts():
    both = maxent.Tokens([[b"a"], [], [b"b", b"c"]])
    apart = [maxent.Tokens([t]) for t in ([b"a"], [], [b"b", b"c"])]
    assert both.one.tolist() == [x for t in apart for x in t.one.tolist()]
    assert both.two.tolist() == [x for t in apart for x in t.two.tolist()]


def test_rows_grow_with_the_vocabulary():
    vocab = lambda v: maxent.Vocabulary(v, v, 1, np.zeros(maxent.LEAVES), np.zeros(maxent.LEAVES))
    assert [maxent.rows_for(vocab(v)) for v in (0, 10_000, 10**9)] == [maxent.LEAST_ROWS, 1 << 15, maxent.MOST_ROWS]
