"""Document quality from a linear-chain conditional random field over lines.

Every line of a text gets a hidden label, good or bad. A line's emission looks at features of the line and of
its two neighbours; transitions couple neighbouring labels. Forward and backward passes give each line's marginal
probability of being good; their mean, weighted by line length, is the document's raw quality, which a
two-parameter logistic maps to a probability.

Training takes document labels as the labels of their lines. It sees at most about ``PER_CLASS`` labelled
documents of each class (by a hash threshold set from the class's count) and of each at most ``TRAIN_LINES``
consecutive lines, starting at a place the text's hash picks; the bound does not grow with the tables. Every
document is scored on its whole text. Only the text is an input.

Defined cases: null and empty texts have no lines and score the training rows' share of label 1; rows
without a label, with a null label or a null doc_id are not learned from, a doc_id labelled twice counts by
its lower label; with no labelled row, or one class only, every score is the share of label 1 (0.5 with none); repeated
rows are repeated. ``score_quality`` keeps all columns and adds score and predicted (replacing columns of
those names).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, byte_slices, fold_of, materialise, packed, table, unpacked

PER_CLASS = 1500
TRAIN_LINES = 128
STEPS = 400
BATCH = 64
#: Bytes of text whose features are computed together.
CHUNK = 4 << 20

# byte classes
UPPER, LOWER, DIGIT, SPACE, EXCLAIM, STOP, SYMBOL, OTHER, HIGH = range(9)


def _byte_classes() -> np.ndarray:
    table = np.full(256, OTHER, dtype=np.int64)
    for cls, chars in ((UPPER, bytes(range(65, 91))), (LOWER, bytes(range(97, 123))), (DIGIT, b"0123456789"), (SPACE, b" \t\r\n\x0b\x0c"), (EXCLAIM, b"!"), (STOP, b".,;:?'\"-()"), (SYMBOL, b"#$%&*@^~+=<>_|\\{}[]/")):
        table[list(chars)] = cls
    table[128:] = HIGH
    return table


CLASSES = _byte_classes()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines, f) of all non-blank lines, their lengths in bytes, and the number of lines of each text."""
    lines, counts = [], []
    for text in texts:
        own = [line for line in text.split("\n") if line and not line.isspace()] if text else []
        lines += own
        counts.append(len(own))
    if not lines:
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0), np.array(counts)
    encoded = [line.encode("utf-8") for line in lines]
    size = np.fromiter(map(len, encoded), np.int64, len(encoded))
    raw = np.frombuffer(b"".join(encoded), np.uint8)
    owner = np.repeat(np.arange(len(lines)) * 9, size)
    by_class = np.bincount(owner + CLASSES[raw], minlength=9 * len(lines)).reshape(-1, 9).astype(np.float32)
    split = [line.split() for line in encoded]
    words = np.fromiter(map(len, split), np.float32, len(split))
    distinct = np.fromiter((len(set(w)) for w in split), np.float32, len(split))
    again = np.fromiter((sum(map(eq, w, w[1:])) for w in split), np.float32, len(split))
    n, w = size.astype(np.float32), np.maximum(words, 1)
    letters = np.maximum(by_class[:, UPPER] + by_class[:, LOWER] + by_class[:, HIGH], 1)
    first = np.fromiter((x[0] for x in encoded), np.uint8, len(encoded))
    last = np.fromiter((x.rstrip()[-1] for x in encoded), np.uint8, len(encoded))
    upper, symbol, exclaim, repeat, variety = by_class[:, UPPER] / letters, by_class[:, SYMBOL] / n, by_class[:, EXCLAIM] / n, again / w, distinct / w
    columns = [
        np.ones(len(n), np.float32), np.log1p(n) / 6, upper, by_class[:, DIGIT] / n, symbol, exclaim, by_class[:, STOP] / n, by_class[:, OTHER] / n,
        by_class[:, HIGH] / n, by_class[:, SPACE] / n, variety, repeat, by_class.sum(axis=1) / w / 20,
        CLASSES[last] == STOP, (CLASSES[first] == UPPER) | (CLASSES[first] == HIGH), n < 20,
        upper > 0.5, symbol > 0.03, symbol > 0.1, exclaim > 0.03, repeat > 0.1, repeat > 0.4, (variety < 0.5) & (words > 8), words < 3,
    ]
    return np.stack([np.asarray(c, np.float32) for c in columns], axis=1), size.astype(np.float64), np.array(counts)


N_FEATURES = 24
N_EMISSION = 3 * N_FEATURES


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and behind it in the same text (zeros where there is none)."""
    before, behind = np.zeros_like(x), np.zeros_like(x)
    before[1:], behind[:-1] = x[:-1], x[1:]
    ends = np.cumsum(counts)
    full = counts > 0
    before[(ends - counts)[full]] = 0
    behind[ends[full] - 1] = 0
    return np.hstack([x, before, behind])


@dataclass
class Crf:
    emission: np.ndarray  # (N_EMISSION,): score of good over bad
    transition: np.ndarray  # (2, 2)
    start: np.ndarray  # (2,)
    scale: float = 1.0
    shift: float = 0.0
    share: float = 0.5

    def marginals(self, score: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(good) of every line; texts advance side by side."""
        good, _ = forward_backward(score, counts, self.transition, self.start)
        return good


def _lse(a: np.ndarray) -> np.ndarray:
    return np.logaddexp(a[..., 0], a[..., 1])


def forward_backward(score: np.ndarray, counts: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of good for every line, and the expected transitions summed over all texts.

    Texts are ordered by length, longest first, so step t only touches those that still have a line t.
    """
    full = np.flatnonzero(counts)
    order = full[np.argsort(-counts[full], kind="stable")]
    first, length = (np.cumsum(counts) - counts)[order], counts[order]
    emit = np.stack([np.zeros_like(score), score], axis=1)
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alive = [int(np.searchsorted(-length, -t, side="left")) for t in range(length[0] if len(length) else 0)]
    for t, k in enumerate(alive):
        at = first[:k] + t
        if t == 0:
            alpha[at] = start + emit[at]
        else:
            alpha[at] = _lse((alpha[at - 1][:, :, None] + transition[None]).transpose(0, 2, 1)) + emit[at]
    pairs = np.zeros((2, 2))
    for t in range(len(alive) - 1, 0, -1):
        at = first[: alive[t]] + t
        beta[at - 1] = _lse(transition[None] + (emit[at] + beta[at])[:, None, :])
    total = _lse(alpha + beta)
    good = np.exp(alpha[:, 1] + beta[:, 1] - total)
    for t in range(1, len(alive)):
        at = first[: alive[t]] + t
        joint = alpha[at - 1][:, :, None] + transition[None] + (emit[at] + beta[at])[:, None, :] - total[at][:, None, None]
        pairs += np.exp(joint).sum(axis=0)
    return good, pairs


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], weights: list[float], seed: int = 5) -> Crf:
    """Adam on the conditional likelihood; each sample is (features, line bytes, label)."""
    rng = np.random.default_rng(seed)
    labels = np.array([y for *_, y in samples])
    share = float(np.average(labels, weights=weights))
    if len(set(labels)) < 2:
        return Crf(np.zeros(N_EMISSION), np.zeros((2, 2)), np.zeros(2), 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))), share)
    by_class = [np.flatnonzero(labels == c) for c in (0, 1)]
    params = [np.zeros(N_EMISSION), np.zeros((2, 2)), np.zeros(2)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    ready = [with_neighbours(x, np.array([len(x)])).astype(np.float64) for x, _, _ in samples]
    for step in range(1, STEPS + 1):
        rows = np.concatenate([rng.choice(by_class[c], BATCH // 2) for c in (0, 1)])
        counts = np.array([len(ready[r]) for r in rows])
        x, y = np.vstack([ready[r] for r in rows]), np.repeat(labels[rows], counts)
        good, pairs = forward_backward(x @ params[0], counts, params[1], params[2])
        seen = np.zeros((2, 2))
        for r in rows:
            seen[labels[r], labels[r]] += len(ready[r]) - 1
        firsts = np.cumsum(counts) - counts
        start = np.array([((1 - good[firsts]) - (1 - y[firsts])).sum(), (good[firsts] - y[firsts]).sum()])
        grads = [x.T @ (good - y) / len(y) + 1e-4 * params[0], (pairs - seen) / len(y) + 1e-2 * params[1], start / len(rows) + 1e-2 * params[2]]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            params[i] -= 0.05 * (1 - step / (STEPS + 1)) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    crf = Crf(*params, share=share)
    raw = np.array([raw_quality(crf, x, size, np.array([len(x)]))[0] for x, size, _ in samples])
    crf.scale, crf.shift = _logistic(_logit(raw), labels, np.array(weights))
    return crf


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of a regularised one-variable logistic fit."""
    a = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        grad = x.T @ (weight * (p - y)) + np.array([1.0, 0.1]) * (a - np.array([1.0, 0.0]))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1.0, 0.1])
        a = a - np.linalg.solve(hess, grad)
    return max(0.0, float(a[0])), float(a[1])


def raw_quality(crf: Crf, x: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals; nan for texts without lines."""
    good = crf.marginals(with_neighbours(x, counts) @ crf.emission, counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    weight = np.bincount(owner, size, len(counts))
    return np.bincount(owner, size * good, len(counts)) / np.where(weight > 0, weight, np.nan)


def quality_of(crf: Crf, texts: list[str]) -> np.ndarray:
    """Scores of whole texts, computed some megabytes at a time."""
    out, held, room = [], [], 0

    def flush() -> None:
        if held:
            raw = raw_quality(crf, *line_features(held))
            p = 1 / (1 + np.exp(-np.clip(crf.scale * _logit(np.nan_to_num(raw, nan=0.5)) + crf.shift, -30, 30)))
            out.append(np.where(np.isnan(raw), crf.share, p))
            held.clear()

    for text in texts:
        held.append(text or "")
        room += len(held[-1])
        if room >= CHUNK:
            flush()
            room = 0
    flush()
    return np.concatenate(out) if out else np.zeros(0)


def fit(documents: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> Crf:
    """Learn from labelled documents; ``learn`` is a condition on doc_id."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {c: min(1.0, per_class / n) for c, n in counts.items()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    bound = F.when(F.col("quality") == 0, F.lit(share.get(0, 0.0))).otherwise(F.lit(share.get(1, 0.0)))
    sample = F.broadcast(marked.where(place < bound).select(F.col("doc_id").alias("_id"), "quality"))  # about 2 * per_class rows

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, label, start in zip(pdf["text"], pdf["quality"], pdf["start"]):
                x, size, _ = line_features([text])
                if len(x):
                    at = int(start) % max(1, len(x) - TRAIN_LINES + 1)
                    rows.append((x[at : at + TRAIN_LINES].tobytes(), size[at : at + TRAIN_LINES].tobytes(), int(label)))
            yield pd.DataFrame(rows, columns=["x", "size", "label"])

    rows = documents.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("_id"), "inner").where(F.length("text") > 0)
    rows = rows.select("text", "quality", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("start"))
    with bounded_batches(documents.sparkSession):
        got = sorted((r["label"], bytes(r["x"]), bytes(r["size"])) for r in rows.mapInPandas(features, "x binary, size binary, label int").collect())
    if not got:
        return Crf(np.zeros(N_EMISSION), np.zeros((2, 2)), np.zeros(2), 0.0, 0.0, 0.5)
    samples = [(np.frombuffer(x, np.float32).reshape(-1, N_FEATURES), np.frombuffer(s, np.float64), y) for y, x, s in got]
    return train(samples, [1 / share[y] / max(counts.values()) * per_class for *_, y in samples])


def score_quality(documents: DataFrame, crf: Crf) -> DataFrame:
    """``documents`` with score (probability of label 1) and predicted."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [quality_of(crf, part) for part in byte_slices(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    scored = packed(documents).withColumn("_score", score("row.text"))
    return unpacked(scored, documents.columns, score=F.col("_score"), predicted=(F.col("_score") >= 0.5).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``, learned from two thirds of the labelled ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    crf = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), ~held_out)
    with bounded_batches(spark):
        return materialise(score_quality(docs, crf).select("doc_id", held_out.alias("held_out"), "score", "predicted"))
