"""Best-fit packing by hierarchical residual merging.

Documents are tokenized and cut into pieces, and these (a few numbers each, no ids) are dealt evenly to partitions of about ``LOCAL_TOKENS``
tokens, so that each has its share of long and short ones however the table is laid out. Every partition packs its own pieces best-fit, longest first. Bins filled
to ``NEARLY_FULL`` are sequences; underfull bins become items of a next best-fit round in groups of ``FAN_IN`` partitions, what
is underfull there items of the next, and so on up the tree until one group is left, whose bins are sequences whatever their fill.

Items of one size are alike to packing, so a group is packed by its counts of sizes (``CAPACITY`` of them at most,
however many items it has): its plan says for ranges of a size's items which bins they go to. Nothing is left out of a
round, no group holds its items, and what goes up the tree are ranges of bins. A piece has its number among those
of its length in its partition, and finds its place by following the plans of its partition's groups upward.
Numbered pieces are checkpointed, so that a repeated task gives the same numbers.

Tokenizing goes word by word: this tokenizer never joins text across white space, so the ids of a text are
those of its space-separated words, which bounded caches hold.

Defined cases: null and empty texts are one piece, the end id alone; texts of any length are cut into
``CAPACITY``-token pieces; repeated rows and null ids are packed like any other; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import string
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded_batches, give_back, in_parallel, materialise, scratch_path, slices, table

CAPACITY = 4096
END_ID = 1
#: Share of the capacity from which a bin is a sequence before the last round.
NEARLY_FULL = 0.999
#: Partitions, then groups, whose underfull bins are merged together.
FAN_IN = 8
#: Tokens, and pieces, of a partition that is packed locally.
LOCAL_TOKENS, LOCAL_PIECES = 1 << 24, 1 << 20
#: Bytes of ids that a task holds before it writes them.
ROW_GROUP = 16 << 20
CACHE_WORDS = 500_000
CACHE_PARTS = 300_000
VOCABULARY = "word_bpe_49k.json"

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: How the byte-level alphabet writes a byte: printable Latin-1 as itself, the rest from U+0100 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
#: Letters up to here are the same to Python and to the tokenizer's expressions.
LAST_LATIN = "\u024f"


class WordTokenizer(dict):
    """Ids of single space-free words, as little-endian unsigned 32-bit integers, kept as they are asked for.

    Most words are Latin letters with ASCII punctuation behind them. The tokenizer lower-cases those and splits
    them into the letters and the punctuation, each of which its model then merges; the parts repeat
    across cases and endings, so they are kept on their own. Any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}

    def part(self, text: str) -> bytes:
        if (got := self.parts.get(text)) is None:
            if len(self.parts) >= CACHE_PARTS:
                self.parts.clear()
            written = text if text.isascii() else text.encode("utf-8").decode("latin-1").translate(ALPHABET)
            got = self.parts[text] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(written)])
        return got

    def __missing__(self, word: str) -> bytes:
        got = self.parts.get(word) if word.islower() else None
        if got is not None:
            self[word] = got
            return got
        letters = word.rstrip(string.punctuation)
        if letters.isalpha() and (letters.isascii() or max(letters) <= LAST_LATIN):
            lower = letters.lower()
            if lower.isalpha() and unicodedata.is_normalized("NFC", lower):
                got = self.part(lower) + (self.part(word[len(letters) :]) if len(letters) < len(word) else b"")
        if got is None:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            got = pack_ids(f"<{len(ids)}I", *ids)
        self[word] = got
        return got

    def text(self, text: str) -> bytes:
        out = []
        for part in slices(text):
            if len(self) > CACHE_WORDS:
                self.clear()
            out.append(b"".join(map(self.__getitem__, part.replace("\n", " ").split(" "))))
        return b"".join(out)


def pieces(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves on request."""
    file = path or public_tokenizers.path(VOCABULARY)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = WordTokenizer(file)  # its caches go with the task
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ids = tokenizer.text(text or "") + END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out if with_ids else out.drop(columns="ids")
        del tokenizer
        give_back()

    return in_parallel(documents.select("doc_id", "text")).select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, PIECE + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers; items go in the order given, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while a bin with r free exists
    for i, n in enumerate(lengths):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins


Plan = list[tuple[int, int, int, int, int]]


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[Plan, list[tuple[int, int, int]]]:
    """What ``best_fit`` does to sorted lengths, from their counts: rows (length, rank, sequence, each, start), and the sequences (fill, first, n).

    From its ``rank`` on, the pieces of a length go ``each`` to a sequence into the sequences from ``sequence`` on,
    the first of a sequence standing at ``start``. Sequences of equal room are kept as ranges, so the work depends on the
    number of lengths and ranges, not on that of pieces.
    """
    plan: Plan = []
    by_room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # ranges (first sequence, sequences)
    rooms = 0  # bit r is set while a sequence with r free exists
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        nonlocal rooms
        if n:
            by_room[room].append((first, n))
            if room:
                rooms |= 1 << room

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fitting = rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                first, n = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            # a sequence that took a piece is the fullest that takes the next, as long as it does
            each = room // length
            filled, rest = min(n, left // each), 0
            if filled < n:
                rest = left - filled * each
            plan.append((length, rank, first, each, capacity - room))
            put(room - each * length, first, filled)
            if rest:
                put(room - rest * length, first + filled, 1)
            put(room, first + filled + (rest > 0), n - filled - (rest > 0))
            rank, left = rank + filled * each + rest, left - filled * each - rest
    return plan, [(capacity - room, first, n) for room, ranges in enumerate(by_room) for first, n in ranges]


def _numbered(rows: DataFrame) -> DataFrame:
    """Pieces with their partition (``part``) and their number, in it, among those of their length (``k``)."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for pdf in batches:
            lengths = pdf["length"]
            counts = lengths.value_counts()
            yield pdf.assign(doc_id=pdf["doc_id"].astype("Int64"), part=part, k=lengths.groupby(lengths).cumcount() + lengths.map(seen.__getitem__))
            seen.update(dict(zip(counts.index.tolist(), counts.tolist())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(number, schema + ", part long, k long")


#: Ranges of items and where a group puts them (child, fill, first, n, at, sequence, each, start), and its bins (no child; fill, first, n).
GROUP = "node long, child long, fill long, first long, n long, at long, sequence long, each long, start long"
#: Items of level 0 are pieces, numbered within their length; this tells equal numbers of different lengths apart.
LENGTH_SHIFT = 40


def _pack_group(items: pd.DataFrame, capacity: int) -> list[tuple]:
    """Rows of GROUP, without the node, for the items (child, fill, first, n) of one group."""
    counts = items.groupby("fill")["n"].sum()
    plan, bins = best_fit_plan({int(f): int(n) for f, n in counts.items()}, capacity)
    ends = {}
    for (fill, rank, *_), after in zip(plan, [*plan[1:], None]):
        ends[fill, rank] = after[1] if after and after[0] == fill else int(counts[fill])
    out = [(None, fill, first, n, None, None, None, None) for fill, first, n in bins]
    ranges = items.sort_values(["fill", "child", "first"], ascending=[False, True, True])
    steps, rank, current = iter(plan), 0, None
    step = next(steps, None)
    for child, fill, first, n in zip(ranges["child"].tolist(), ranges["fill"].tolist(), ranges["first"].tolist(), ranges["n"].tolist()):
        if fill != current:
            rank, current = 0, fill
        while n:
            while step[0] != fill or ends[step[0], step[1]] <= rank:
                step = next(steps)
            taken = min(n, ends[step[0], step[1]] - rank)
            out.append((child, fill, first, taken, rank - step[1], *step[2:]))
            rank, first, n = rank + taken, first + taken, n - taken
    return out


def _merged(items: DataFrame, capacity: int) -> DataFrame:
    """One round: GROUP rows of every node, from items (node, child, fill, first, n)."""
    names = [c.split()[0] for c in GROUP.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row) for row in _pack_group(pdf, capacity)], columns=names).astype({c: "Int64" for c in names})

    return materialise(items.groupBy("node").applyInPandas(run, GROUP))


def _placed(pieces: pd.DataFrame, plans: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of one partition's pieces, following the plans of its groups level by level."""
    place = (pieces["length"].to_numpy() << LENGTH_SHIFT) + pieces["k"].to_numpy()
    sequence, offset, open_ = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64), np.arange(len(place))
    for _, level in plans.sort_values(["level", "first"]).groupby("level"):
        fill, first, n, at, start_at, each, start, base = (level[c].to_numpy().astype(np.int64) for c in ("fill", "first", "n", "at", "sequence", "each", "start", "base"))
        row = np.searchsorted(first, place[open_], "right") - 1
        met = (row >= 0) & (place[open_] < first[row] + n[row])
        open_, row = open_[met], row[met]
        item = at[row] + place[open_] - first[row]
        place[open_] = start_at[row] + item // each[row]
        offset[open_] += start[row] + item % each[row] * fill[row]
        sequence[open_] = base[row] + place[open_]
    return sequence, offset


def pack(rows: DataFrame, capacity: int = CAPACITY, fan_in: int = FAN_IN) -> DataFrame:
    """Sequences of pieces: the columns of ``rows`` (those of PIECE and any others) with sequence_id and offset."""
    with bounded_batches(rows.sparkSession):
        cut = materialise(rows)
    facts = cut.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("pieces")).first()
    numbered = materialise(_numbered(cut.repartition(max(1, -(-facts["tokens"] // LOCAL_TOKENS), -(-facts["pieces"] // LOCAL_PIECES)))))
    sizes = materialise(numbered.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    parts = sizes.select("part").distinct()
    nodes, groups = [F.col("part")], parts.count()
    items = sizes.select(F.col("part").alias("node"), F.col("part").alias("child"), F.col("length").alias("fill"), F.shiftleft("length", LENGTH_SHIFT).alias("first"), "n")
    levels = [_merged(items, capacity)]
    while groups > 1:
        groups = -(-groups // fan_in)
        up = lambda node: F.pmod(F.xxhash64(node), F.lit(groups)) if len(levels) == 1 else F.floor(node / fan_in)  # noqa: B023, E731
        nodes.append(up(nodes[-1]))
        underfull = levels[-1].where(F.col("child").isNull() & (F.col("fill") < NEARLY_FULL * capacity))
        levels.append(_merged(underfull.select(up(F.col("node")).alias("node"), F.col("node").alias("child"), "fill", "first", "n"), capacity))
    # every group numbers its bins from a base of its own; a row a group goes through the window
    every = levels[0].withColumn("level", F.lit(0))
    for k, more in enumerate(levels[1:], 1):
        every = every.unionByName(more.withColumn("level", F.lit(k)))
    used = every.where(F.col("child").isNull()).groupBy("level", "node").agg(F.max(F.col("first") + F.col("n")).alias("_used"))
    base = used.select("level", "node", (F.sum("_used").over(Window.orderBy("level", "node")) - F.col("_used")).alias("base"))
    based = every.where(F.col("child").isNotNull()).join(base, ["level", "node"])
    path = parts.select("part", F.posexplode(F.array(F.col("part"), *nodes[:-1])).alias("level", "child"))
    plans = path.join(based, ["level", "child"]).select(F.col("part").alias("_part"), "level", "fill", "first", "n", "at", "sequence", "each", "start", "base")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"

    def place(pieces: pd.DataFrame, plans: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = _placed(pieces, plans)
        return pieces.drop(columns=["part", "k"]).assign(doc_id=pieces["doc_id"].astype("Int64"), sequence_id=sequence, offset=offset)

    return numbered.groupBy("part").cogroup(plans.groupBy("_part")).applyInPandas(place, schema)


def packed_corpus(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All documents as pieces with their token ids, placed in sequences. The ids wait in a scratch table while their lengths are packed."""
    spark = documents.sparkSession
    path = scratch_path(spark, "pieces")
    with bounded_batches(spark):
        pieces(documents, capacity, with_ids=True).withColumn("_row", F.monotonically_increasing_id()).write.option("compression", "zstd").option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    stored = spark.read.parquet(path)
    placed = pack(stored.drop("ids"), capacity).select("_row", "sequence_id", "offset")
    return stored.join(placed, "_row").drop("_row")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 4096 tokens."""
    return pack(pieces(table(spark, sf_dir, "documents").select("doc_id", "text")))
