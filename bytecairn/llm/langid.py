"""Language identification by a byte convolutional network, trained and applied in numpy.

Texts are lower-cased, encoded and cut into windows of ``WINDOW`` bytes that cover the whole text. Filters
of widths 2, 3 and 4 slide over the bytes, each keeps its maximum over the window, and a softmax layer turns
the rectified maxima into log-probabilities. A text's prediction is the mean over its windows, weighted by
the bytes each window adds. A filter is a sum of per-position byte tables, so two neighbouring positions
are folded into one table of byte pairs and a window batch is scored by table look-ups.

Training sees every language, at most about ``PER_LANGUAGE`` distinct texts of each (those whose hash falls under a
threshold set from the language's count of distinct texts, so the bound does not grow with the table) and at most
``WINDOWS_PER_DOCUMENT`` windows of each, which are cut in the tasks. Every row is scored on its whole text.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows with a null language
are not learned from; with no labelled row everything is ``und``; a text shorter than a window is repeated
to fill it; repeated rows are repeated. ``identify`` keeps all columns and adds lang_pred and score
(replacing columns of those names).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, byte_slices, fold_of, give_back, materialise, packed, table, unpacked

WINDOW = 384
WIDTHS = (2, 3, 4)
FILTERS = 8
PER_LANGUAGE = 300
WINDOWS_PER_DOCUMENT = 8
STEPS = 400
BATCH = 96
#: Windows scored together.
SCORE_BATCH = 4096
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    filters: list[np.ndarray]  # per width: (width, 256, FILTERS)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out: np.ndarray  # (features, languages)
    out_bias: np.ndarray


def windows_of(data: bytes, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n, width) that cover all bytes, and the bytes each adds."""
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(raw)
    if n <= width:
        return np.resize(raw, (1, width)), np.array([float(n)])
    whole = n // width
    out, weight = raw[: whole * width].reshape(whole, width), np.full(whole, float(width))
    if n % width:
        out, weight = np.vstack([out, raw[None, -width:]]), np.append(weight, float(n % width))
    return out, weight


def _responses(filters: list[np.ndarray], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum of every filter over each window, and where it is; for training."""
    best, where = [], []
    for bank in filters:
        k, last = len(bank), windows.shape[1] - len(bank) + 1
        total = sum(bank[j][windows[:, j : j + last]] for j in range(k))
        at = total.argmax(axis=1)
        where.append(at)
        best.append(np.take_along_axis(total, at[:, None, :], axis=1)[:, 0])
    return np.hstack(best), np.hstack(where)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: list[np.ndarray], languages: list[str], seed: int = 7) -> Model:
    """Adam on cross-entropy; gradients reach only the bytes at each maximum."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    x, y = np.vstack(windows), np.repeat([names.index(lang) for lang in languages], [len(w) for w in windows])
    by_class = [np.flatnonzero(y == c) for c in range(len(names))]
    n_features = len(WIDTHS) * FILTERS
    params = [rng.normal(0, 0.3, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS]
    params += [np.zeros(n_features, np.float32), rng.normal(0, 0.3, (n_features, len(names))).astype(np.float32), np.zeros(len(names), np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        classes = rng.integers(0, len(names), BATCH)
        rows = np.array([rng.choice(by_class[c]) for c in classes])
        xb, yb = x[rows], y[rows]
        pooled, at = _responses(params[: len(WIDTHS)], xb)
        hidden = np.maximum(pooled + params[-3], 0)
        p = _softmax(hidden @ params[-2] + params[-1])
        p[np.arange(BATCH), yb] -= 1
        p /= BATCH
        back = (p @ params[-2].T) * (hidden > 0)
        grads = [np.zeros_like(b) for b in params[: len(WIDTHS)]]
        for g, bank in enumerate(grads):
            for f in range(FILTERS):
                col = g * FILTERS + f
                for j in range(len(bank)):
                    np.add.at(bank[j, :, f], xb[np.arange(BATCH), at[:, col] + j], back[:, col])
        grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
        rate = 0.02 * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.99 * v[i] + 0.01 * grad * grad
            params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)
    return Model(names, params[: len(WIDTHS)], params[-3], params[-2], params[-1])


class Scorer:
    """A model with its filters folded into byte-pair tables."""

    def __init__(self, model: Model):
        self.model = model
        pair = lambda a, b: (a[None, :, :] + b[:, None, :]).reshape(65536, -1)  # noqa: E731  little-endian pairs: first byte low
        self.banks = []
        for bank in model.filters:
            tables = [(j, True, pair(bank[j], bank[j + 1])) for j in range(0, len(bank) - 1, 2)]
            if len(bank) % 2:
                tables.append((len(bank) - 1, False, np.ascontiguousarray(bank[-1])))
            self.banks.append((len(bank), tables))

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        byte = np.ascontiguousarray(windows.T)
        length, n = byte.shape
        pairs = byte[:-1].astype(np.uint16) | (byte[1:].astype(np.uint16) << 8)
        pooled = []
        term, total = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.float32)
        for k, tables in self.banks:
            best = np.full((n, FILTERS), -np.inf, np.float32)
            for p in range(length - k + 1):
                for i, (j, paired, tab) in enumerate(tables):
                    np.take(tab, pairs[p + j] if paired else byte[p + j], axis=0, out=term if i else total, mode="clip")
                    if i:
                        total += term
                np.maximum(best, total, out=best)
            pooled.append(best)
        z = np.maximum(np.hstack(pooled) + self.model.bias, 0) @ self.model.out + self.model.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and probability of each text, every one with at least a byte."""
        totals, weights = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if held:
                w, weight, owner = (np.concatenate(c) for c in zip(*held))
                np.add.at(totals, owner, self.log_probabilities(w) * weight[:, None])
                np.add.at(weights, owner, weight)
                held.clear()

        count = 0
        for i, text in enumerate(texts):
            w, weight = windows_of(text.lower().encode("utf-8"))
            for a in range(0, len(w), SCORE_BATCH):
                held.append((w[a : a + SCORE_BATCH], weight[a : a + SCORE_BATCH], np.full(len(w[a : a + SCORE_BATCH]), i)))
                count += len(held[-1][1])
                if count >= SCORE_BATCH:
                    flush()
                    count = 0
        flush()
        p = _softmax(totals / np.maximum(weights, 1)[:, None])
        best = p.argmax(axis=1)
        return [self.model.languages[b] for b in best], p[np.arange(len(texts)), best]


def training_sample(documents: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """About ``per_language`` distinct texts of each language at most: (text, lang); ``learn`` is a condition on doc_id."""
    rows = documents.select("doc_id", "text", "lang").where(learn & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = rows.select("lang", F.xxhash64("text").alias("_h")).distinct().groupBy("lang").count()
    share = F.broadcast(counts.select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), F.lit(per_language) / F.col("count")).alias("_share")))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(share, F.col("lang") == F.col("_lang")).where(place < F.col("_share")).select("text", "lang").dropDuplicates(["text", "lang"])


def training_windows(sample: DataFrame) -> DataFrame:
    """The windows learned from each text, cut in the tasks: (lang, windows)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                data = text.lower().encode("utf-8")
                w, _ = windows_of(data)
                out.append(w[np.random.default_rng(zlib.crc32(data)).permutation(len(w))[:WINDOWS_PER_DOCUMENT]].tobytes())
            yield pd.DataFrame({"lang": pdf["lang"], "windows": out})

    return sample.select("lang", "text").mapInPandas(cut, "lang string, windows binary")


def fit(documents: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Model | None:
    with bounded_batches(documents.sparkSession):
        sample = training_windows(training_sample(documents, learn, per_language)).collect()
    rows = sorted((r["lang"], bytes(r["windows"])) for r in sample)
    return train([np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for _, w in rows], [lang for lang, _ in rows]) if rows else None


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """``documents`` with lang_pred and score."""
    rows = packed(documents)
    if model is None:
        return unpacked(rows, documents.columns, lang_pred=F.lit(UNKNOWN), score=F.lit(0.0))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a column a language

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            names, scores = [], []
            for part in byte_slices(texts):
                got, p = scorer.predict(part)
                names += got
                scores += p.tolist()
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        give_back()

    has_letter = F.coalesce(F.col("row.text").rlike(r"\p{L}"), F.lit(False))
    scored = rows.withColumn("_p", predict(F.when(has_letter, F.col("row.text")).otherwise(F.lit("-"))))
    return unpacked(scored, documents.columns, lang_pred=F.when(has_letter, F.col("_p.lang_pred")).otherwise(UNKNOWN), score=F.when(has_letter, F.col("_p.score")).otherwise(0.0))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learned from two thirds of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    scored = identify(docs.drop("lang"), fit(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
    with bounded_batches(spark):
        return materialise(scored)
