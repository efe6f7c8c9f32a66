"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Counting. Texts are dealt into blocks of some megabytes (a table in the shared folder). Each block gives its distinct
words once, with their counts in its training texts; a shuffle by word sums them over the corpus and the block's words go back
to the block, so what is shuffled are block vocabularies, not tokens. Counts cover every training text.

Model. P(word | context) = P(class | context) P(slot | class, context) P(word | class, slot). A word's hash names its
class (of ``CLASSES``) and its slot there (of ``SLOTS``); this holds for every word, the end of a text and unseen words
included. Features are hashed n-grams and skips: the previous word, the word before it, and the two together. A
class score is a bias plus the sum of three feature rows of ``Weights.rows``, a slot score the same with rows of
``Weights.word_rows`` hashed from feature and class. What words share a slot is (c + 1) / (N_slot + V_slot + 1), so unseen words have mass.

Training. The biases are the unigram model. Each of ``ROUNDS`` rounds is synchronous and runs over every position of every training
text: tasks sum the gradient's two halves by feature row, how often each class followed (observed) and the
model's expectation of it, and the sums over all tasks move every weight by log(observed / expected) / ``DAMPING``, both smoothed: the
gradient step of iterative scaling, which needs no rate. Observed counts are discounted by ``DISCOUNT``, so that what was seen once
is not believed outright. The first round's expectation is that of the biases and needs no pass of its own.
The rows grow with the training vocabulary up to ``MOST_ROWS``, the bound of what is broadcast (32 MB then).
Sums do not depend on how texts are dealt to tasks, nor do scores, but for the rounding of floats.

Scoring runs over every token of every text in numpy batches.

Defined cases: null texts are empty and are one token, the end; a null doc_id counts as training; repeated rows count
and are scored each; with no training text N is 0 and the model is uniform; a text beyond a block's size is
a block of its own; a word of more than ``LONG_WORD`` bytes is told by its digest; doc_id may be of any type that a cast to string
and back keeps. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, fold_of, in_parallel, materialise, scratch_path, table

#: Bytes of text in a block.
BLOCK_BYTES = 12 << 20
CLASSES, SLOTS = 32, 32
LEAVES = CLASSES * SLOTS
#: Bounds of the number of feature rows, of which each of the two tables has as many.
LEAST_ROWS, MOST_ROWS = 1 << 10, 1 << 17
ROUNDS = 2
#: Active features of a position less one: a step of iterative scaling is divided by at most their number.
DAMPING = 2.0
DISCOUNT = 0.5
#: Pseudo-counts of the bias distribution in every row.
PRIOR = 2.0
#: Tokens prepared together, and those scored together, so that their scores stay in the processor's cache.
BATCH, STEP = 1 << 16, 1 << 12
#: Bound of every trained weight.
LIMIT = 20.0
#: Feature rows that travel together when sums are merged.
PART = 1 << 12
#: Tasks whose sums are merged before those of others, and tokens below which a round takes no further task.
MERGE, TASK_TOKENS = 32, 1 << 24
BEGIN = 0x9E3779B9
END = b""
LONG_WORD = 64


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z folded; a very long one as its digest, which no short word equals."""
    if not text:
        return []
    words = text.encode("utf-8").lower().split()
    if max(map(len, words), default=0) > LONG_WORD:
        words = [w if len(w) <= LONG_WORD else b"sha512 " + hashlib.sha512(w).digest() for w in words]
    return words


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def leaves_of(code: np.ndarray) -> np.ndarray:
    """Class and slot of words by their crc32, as class * SLOTS + slot."""
    return ((_mix(code) >> np.uint64(32)) & np.uint64(LEAVES - 1)).astype(np.int64)


@dataclass
class Vocabulary:
    """What every task needs of the counts: totals by leaf."""

    n: int
    v: int
    end_count: int
    tokens: np.ndarray  # (LEAVES,)
    types: np.ndarray

    @property
    def mass(self) -> np.ndarray:
        """Smoothed tokens of every leaf: one more a type, one for all unseen words."""
        return self.tokens + self.types + 1


@dataclass
class Weights:
    bias: np.ndarray  # (CLASSES,)
    rows: np.ndarray  # (rows, CLASSES)
    word_bias: np.ndarray  # (CLASSES, SLOTS)
    word_rows: np.ndarray  # (rows, SLOTS), the class being the row modulo CLASSES


def blocks(documents: DataFrame, held_out: Column, path: str) -> DataFrame:
    """The texts dealt into blocks: block, doc_id (as string), held, text."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, number, room = TaskContext.get().partitionId() << 32, 0, 0
        for pdf in batches:
            own = []
            for text in pdf["text"]:
                size = len(text or "")
                if room and room + size > BLOCK_BYTES:
                    number, room = number + 1, 0
                room += size
                own.append(base + number)
            yield pd.DataFrame({"block": own, "doc_id": pdf["doc_id"], "held": pdf["held"], "text": pdf["text"]})

    rows = in_parallel(documents.select(F.col("doc_id").cast("string").alias("doc_id"), held_out.alias("held"), "text"))
    rows.mapInPandas(deal, "block long, doc_id string, held boolean, text string").write.option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.parquet(path)


def block_words(dealt: DataFrame) -> DataFrame:
    """Distinct words of every block with their count in its training texts and their leaf."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, learned, other = None, Counter(), set()

        def out() -> Iterator[pd.DataFrame]:
            words = [*learned, *(w for w in other if w not in learned)]
            for at in range(0, len(words), 100_000):
                part = words[at : at + 100_000]
                code = np.fromiter(map(zlib.crc32, part), np.uint64, len(part))
                yield pd.DataFrame({"block": current, "word": part, "tf": [learned.get(w, 0) for w in part], "leaf": leaves_of(code).astype(np.int16)})

        for pdf in batches:
            for block, held, text in zip(pdf["block"], pdf["held"], pdf["text"]):
                if block != current:
                    yield from out()
                    current, learned, other = block, Counter(), set()
                if held:
                    other.update(words_of(text))
                else:
                    learned.update(words_of(text))
        yield from out()

    return dealt.select("block", "held", "text").mapInPandas(gather, "block long, word binary, tf long, leaf short")


def corpus_counts(dealt: DataFrame, path: str) -> DataFrame:
    """Words of every block with ``c``, their count over all training texts; ``lead`` marks one row a word.

    A word has a row a block at most, so the commonest word's group holds as many rows as the corpus has blocks.
    """
    by_word = Window.partitionBy("word")
    counted = block_words(dealt).select("block", "word", "leaf", F.sum("tf").over(by_word).alias("c"), (F.row_number().over(by_word.orderBy("block", "tf")) == 1).alias("lead"))
    counted.write.option("compression", "zstd").parquet(path)
    return dealt.sparkSession.read.parquet(path)


def vocabulary(dealt: DataFrame, counted: DataFrame) -> Vocabulary:
    """Totals; the driver gets a row a leaf."""
    ends = dealt.where(~F.col("held")).count()
    tokens, types = np.zeros(LEAVES), np.zeros(LEAVES)
    for r in counted.where(F.col("lead") & (F.col("c") > 0)).groupBy("leaf").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens[r["leaf"]], types[r["leaf"]] = r["n"], r["v"]
    n, v = int(tokens.sum()) + ends, int(types.sum()) + (ends > 0)
    own = leaves_of(np.array([zlib.crc32(END)], np.uint64))[0]
    tokens[own] += ends
    types[own] += ends > 0
    return Vocabulary(n, v, ends, tokens, types)


def rows_for(vocab: Vocabulary) -> int:
    """Feature rows, a power of two that grows with the training vocabulary."""
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << (2 * vocab.v).bit_length()))


def initial_weights(vocab: Vocabulary, rows: int) -> Weights:
    """The unigram model: classes and slots by their share."""
    mass = vocab.mass.reshape(CLASSES, SLOTS)
    bias, word_bias = np.log(mass.sum(axis=1) / mass.sum()), np.log(mass / mass.sum(axis=1, keepdims=True))
    return Weights(bias.astype(np.float32), np.zeros((rows, CLASSES), np.float32), word_bias.astype(np.float32), np.zeros((rows, SLOTS), np.float32))


def contexts(code: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the word before each token and of the one before that, within its text."""
    starts = np.cumsum(sizes) - sizes
    one, two = np.empty_like(code), np.empty_like(code)
    one[1:], two[2:] = code[:-1], code[:-2]
    one[starts] = BEGIN
    two[starts] = BEGIN
    two[starts[sizes > 1] + 1] = BEGIN
    return one, two


def features(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hashed features (n, 3) of contexts: n-gram, skip and both."""
    u = np.uint64
    return np.stack([_mix(one + u(1 << 32)), _mix(two + u(2 << 32)), _mix(_mix(one) ^ (two + u(3 << 32)))], axis=1)


def class_rows(f: np.ndarray, rows: int) -> np.ndarray:
    return (f >> np.uint64(40)).astype(np.int64) & (rows - 1)


def slot_rows(f: np.ndarray, cls: np.ndarray, rows: int) -> np.ndarray:
    """Rows of the slots of one class: a feature has a row for every class."""
    return ((f >> np.uint64(12)).astype(np.int64) & (rows // CLASSES - 1)) * CLASSES + cls[:, None]


class Lexicon:
    """Distinct words with what a token needs of its word, the end of a text first."""

    def __init__(self, words: Iterable[bytes]):
        words = [END, *words]
        self.place = dict(zip(words, count()))
        self.code = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        self.leaf = leaves_of(self.code)


class Tokens:
    """Texts as arrays: one entry per token, the end included."""

    def __init__(self, texts: list[list[bytes]], lexicon: Lexicon | None = None):
        flat: list[bytes] = []
        for words in texts:
            flat += words
            flat.append(END)
        self.sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        if lexicon is None:
            code = np.fromiter(map(zlib.crc32, flat), np.uint64, len(flat))
            self.leaf = leaves_of(code)
        else:
            self.index = np.fromiter(map(lexicon.place.__getitem__, flat), np.int64, len(flat))
            code, self.leaf = _rows(lexicon.code, self.index), _rows(lexicon.leaf, self.index)
        self.one, self.two = contexts(code, self.sizes)

    def steps(self, rows: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Slices of the tokens with their classes, slots, class rows and slot rows."""
        for a in range(0, len(self.leaf), STEP):
            at = slice(a, a + STEP)
            f, cls, slot = features(self.one[at], self.two[at]), self.leaf[at] // SLOTS, self.leaf[at] % SLOTS
            yield at, cls, slot, class_rows(f, rows), slot_rows(f, cls, rows)


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of a table; a take that need not check its indices is more than twice as fast as indexing."""
    return table.take(at, axis=0, mode="clip")


def _shares(rows: np.ndarray, f: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the scores in each context, and their sums. Weights are bounded (``LIMIT``), so they are finite."""
    z = _rows(rows, f[:, 0])
    z += _rows(rows, f[:, 1])
    z += _rows(rows, f[:, 2])
    z += bias
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def log_probabilities(tokens: Tokens, weights: Weights, word_log: np.ndarray) -> np.ndarray:
    """Natural log-probability of every token; ``word_log`` is a word's log share in its leaf."""
    out = np.empty(len(tokens.leaf))
    for at, cls, slot, f, g in tokens.steps(len(weights.rows)):
        own = np.arange(len(cls))
        (e, total), (e2, total2) = _shares(weights.rows, f, weights.bias), _shares(weights.word_rows, g, _rows(weights.word_bias, cls))
        out[at] = np.log(e[own, cls].astype(np.float64) * e2[own, slot] / (total.astype(np.float64) * total2)) + word_log[at]
    return out


def _add_by_row(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """table[row] += value for every row (n, 3) of each value (n, d)."""
    n, k = rows.shape
    bits = max(1, (n - 1).bit_length())
    packed = ((rows << bits) | np.arange(n)[:, None]).ravel()
    packed.sort()
    row = packed >> bits
    ordered = _rows(values, packed & ((1 << bits) - 1))
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    sizes = np.diff(np.append(starts, len(row)))
    by_size = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by_size], sizes[by_size]
    # rows met once or a few times are summed side by side, the few long ones each at a stroke
    sums = _rows(ordered, starts)
    long = int(np.searchsorted(-sizes, -16, side="left"))
    for i in range(long):
        sums[i] = ordered[starts[i] : starts[i] + sizes[i]].sum(axis=0)
    for j in range(1, 16):
        alive = int(np.searchsorted(-sizes, -j, side="left"))
        if alive <= long:
            break
        sums[long:alive] += _rows(ordered, starts[long:alive] + j)
    at = row[starts]
    table[at] = _rows(table, at) + sums


def local_sums(texts: Iterator[str | None], n_rows: int, weights: Weights | None) -> tuple[np.ndarray, np.ndarray]:
    """By class row and by slot row: what followed at every position of the texts, or, given weights, what the model expected to."""
    rows, word_rows = np.zeros((n_rows, CLASSES), np.float32), np.zeros((n_rows, SLOTS), np.float32)

    def add(tokens: Tokens) -> None:
        for _, cls, slot, f, g in tokens.steps(n_rows):
            if weights is None:
                np.add.at(rows.reshape(-1), (f * CLASSES + cls[:, None]).ravel(), np.float32(1))
                np.add.at(word_rows.reshape(-1), (g * SLOTS + slot[:, None]).ravel(), np.float32(1))
            else:
                (e, total), (e2, total2) = _shares(weights.rows, f, weights.bias), _shares(weights.word_rows, g, _rows(weights.word_bias, cls))
                e /= total[:, None]
                e2 /= total2[:, None]
                _add_by_row(rows, f, e)
                _add_by_row(word_rows, g, e2)

    for held in _batches(texts):
        add(Tokens(held))
    return rows, word_rows


def _batches(texts: Iterable[str | None]) -> Iterator[list[list[bytes]]]:
    held, room = [], 0
    for text in texts:
        held.append(words_of(text))
        room += len(held[-1]) + 1
        if room >= BATCH:
            yield held
            held, room = [], 0
    if held:
        yield held


def _sum_parts(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in pdf["sums"])
    return pd.DataFrame({"name": [key[0]], "part": [key[1]], "sums": [total.astype(np.float32).tobytes()]})


def sums_over(dealt: DataFrame, n: int, n_rows: int, weights: Weights | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``local_sums`` over all training texts (``n`` tokens). Every task gives the touched parts of the tables once; the driver gets their sums."""
    spark = dealt.sparkSession
    tasks = min(spark.sparkContext.defaultParallelism, n // TASK_TOKENS + 1)
    shared = None if weights is None else spark.sparkContext.broadcast(weights)  # 2 * MOST_ROWS rows at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = local_sums((t for pdf in batches for t in pdf["text"]), n_rows, shared and shared.value)
        task = TaskContext.get().partitionId() // MERGE
        for name, whole in zip(("rows", "word_rows"), sums):
            for part, at in enumerate(range(0, len(whole), PART)):
                if (own := whole[at : at + PART]).any():
                    yield pd.DataFrame({"name": [name], "part": [part], "sums": [own.tobytes()], "task": [task]})

    own = dealt.where(~F.col("held")).select("text")
    sums = own.coalesce(tasks).mapInPandas(run, "name string, part int, sums binary, task int")
    schema = "name string, part int, sums binary"
    if tasks > MERGE:
        sums = sums.groupBy("name", "part", "task").applyInPandas(lambda key, pdf: _sum_parts(key[:2], pdf), schema)
    out = np.zeros((n_rows, CLASSES), np.float32), np.zeros((n_rows, SLOTS), np.float32)
    for r in sums.groupBy("name", "part").applyInPandas(_sum_parts, schema).collect():  # a row a part: the size of the model
        whole = out[r["name"] == "word_rows"]
        at = slice(r["part"] * PART, (r["part"] + 1) * PART)
        whole[at] = np.frombuffer(r["sums"], np.float32).reshape(whole[at].shape)
    if shared:
        shared.destroy()
    return out


def _step(weights: np.ndarray, observed: np.ndarray, expected: np.ndarray, prior: np.ndarray) -> None:
    """Moves weights along the gradient of iterative scaling; ``prior`` is what a row without counts expects."""
    for a in range(0, len(weights), PART):
        at = slice(a, a + PART)
        o = observed[at].astype(np.float64)
        # what the discount takes from the classes seen goes to all by the prior, so observed and expected have equal sums
        taken = DISCOUNT * (o > 0).sum(axis=1, keepdims=True)
        o = np.maximum(o - DISCOUNT, 0) + (taken + PRIOR) * prior[at]
        weights[at] = np.clip(weights[at] + np.log(o / (expected[at] + PRIOR * prior[at])) / DAMPING, -LIMIT / 3, LIMIT / 3)


def train(dealt: DataFrame, vocab: Vocabulary, rows: int | None = None, rounds: int = ROUNDS) -> Weights:
    """Weights after ``rounds`` synchronous rounds over every position of all training texts."""
    weights = initial_weights(vocab, rows or rows_for(vocab))
    if not vocab.n or not rounds:
        return weights
    observed = sums_over(dealt, vocab.n, len(weights.rows))
    prior = np.broadcast_to(np.exp(weights.bias), observed[0].shape), np.tile(np.exp(weights.word_bias), (len(observed[1]) // CLASSES, 1))
    # before the first step every row expects its classes by the biases
    expected = tuple(o.sum(axis=1, keepdims=True) * p for o, p in zip(observed, prior))
    for number in range(rounds):
        if number:
            expected = sums_over(dealt, vocab.n, len(weights.rows), weights)
        _step(weights.rows, observed[0], expected[0], prior[0])
        _step(weights.word_rows, observed[1], expected[1], prior[1])
    return weights


def score_block(texts: Iterable[str | None], words: list[bytes], c: np.ndarray, vocab: Vocabulary, weights: Weights) -> list[tuple]:
    """(n_tokens, n_known, base_score, score) of every text; ``words`` are the block's, ``c`` their counts."""
    out, lexicon = [], Lexicon(words)
    c = np.append(vocab.end_count, c).astype(np.float64)
    known_word, base_log = (c > 0).astype(np.int64), np.log10(c + 1) - np.log10(vocab.n + vocab.v + 1)
    word_log = np.log((c + 1) / vocab.mass[lexicon.leaf])
    for held in _batches(texts):
        tokens = Tokens(held, lexicon)
        log_p = log_probabilities(tokens, weights, _rows(word_log, tokens.index)) / np.log(10)
        starts = np.cumsum(tokens.sizes) - tokens.sizes
        sums = (np.add.reduceat(x, starts).tolist() for x in (_rows(known_word, tokens.index), _rows(base_log, tokens.index), log_p))
        out.extend(zip(tokens.sizes.tolist(), *sums))
    return out


def score(documents: DataFrame, held_out: Column, rows: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``rows``, a power of two and a multiple of ``CLASSES``, overrides the number of feature rows.
    """
    spark, id_type = documents.sparkSession, documents.schema["doc_id"].dataType
    paths = [scratch_path(spark, what) for what in ("lm-blocks", "lm-counts")]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    with bounded_batches(spark):
        dealt = blocks(documents, held_out, paths[0])
        counted = corpus_counts(dealt, paths[1])
        vocab = vocabulary(dealt, counted)
        weights = train(dealt, vocab, rows)
        shared = spark.sparkContext.broadcast((vocab, weights))

        def run(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
            vocab, weights = shared.value
            words = words.drop_duplicates("word")  # a block that two tasks read gives its words twice
            rows = score_block(docs["text"], list(words["word"]), words["c"].to_numpy(), vocab, weights)
            return pd.DataFrame([(d, h, t, k, vocab.n, b, s) for d, h, (t, k, b, s) in zip(docs["doc_id"], docs["held"], rows)], columns=names)

        both = dealt.groupBy("block").cogroup(counted.select("block", "word", "c").groupBy("block"))
        scored = both.applyInPandas(run, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        result = materialise(scored.withColumn("doc_id", F.col("doc_id").cast(id_type)))
    shared.destroy()
    discard(spark, *paths)
    return result


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` scored by a model of six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fold_of(F.col("doc_id"), 7) == 2)
