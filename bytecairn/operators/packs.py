"""Packs of chunks: layout, selection, coalesced reads, and what repacking gains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A pack's header, most members, and the widest range that one read fetches.
HEADER_BYTES = 8
MAX_MEMBERS = 4096
MAX_RANGE = 32 << 20


def layout(members: DataFrame, pack: str, order: str, length: str) -> DataFrame:
    """Where each member stands: behind the header and the members before it."""
    before = F.sum(length).over(Window.partitionBy(pack).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(length)
    return members.withColumn("offset", before + HEADER_BYTES)


def select_members(candidates: DataFrame, stream: str, maximum: int, repack: bool = False, most: int = MAX_MEMBERS) -> DataFrame:
    """Order-preserving first-fit choice of one pack's members per stream.

    Candidates go by offset. Ineligible ones, packed or shared ones (unless repacking) and repeats of a chunk are
    passed over; one too large for an empty pack is passed over too; the first that no longer fits ends
    the choice. A stream's rows are streamed in order, and only the choice's sums are held.
    """
    schema = f"{stream} long, chunk_id long, position int, start long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, seen, total, full = None, set(), 0, False
        for pdf in batches:
            rows = []
            for owner, chunk, size, eligible, packed, shared in zip(pdf[stream], pdf["chunk_id"], pdf["raw_size"], pdf["eligible"], pdf["packed"], pdf["shared"]):
                if owner != current:
                    current, seen, total, full, chosen = owner, set(), 0, False, 0
                if full or not eligible or (not repack and (packed or shared)) or chunk in seen:
                    continue
                seen.add(chunk)
                if total + size > maximum or chosen == most:
                    full = chosen > 0
                    continue
                rows.append((owner, chunk, chosen, total))
                total, chosen = total + size, chosen + 1
            yield pd.DataFrame(rows, columns=[stream, "chunk_id", "position", "start"])

    dealt = candidates.repartition(stream).sortWithinPartitions(stream, "offset", "chunk_id")
    return dealt.select(stream, "chunk_id", "raw_size", "eligible", "packed", "shared").mapInPandas(run, schema)


def coalesced_gets(ranges: DataFrame, keys: list[str], max_range: int = MAX_RANGE) -> DataFrame:
    """Reads per key after merging exactly adjacent ranges of one pack while a read stays within ``max_range``.

    Empty and over-wide ranges are dropped and equal ones merged first. ``keys`` name whose reads are counted (and
    end with the pack). A sorted stream per key holds one open run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, start, end, gets, total = None, 0, 0, 0, 0
        for pdf in batches:
            rows = []
            for key, lo, hi in zip(pdf[keys].itertuples(index=False, name=None), pdf["lo"], pdf["hi"]):
                if key != open_key:
                    if open_key is not None:
                        rows.append((*open_key, gets, total))
                    open_key, start, end, gets, total = key, lo, hi, 1, hi - lo
                elif lo == end and hi - start <= max_range:
                    end, total = hi, total + hi - lo
                else:
                    start, end, gets, total = lo, hi, gets + 1, total + hi - lo
            if rows:
                yield pd.DataFrame(rows, columns=[*keys, "gets", "bytes"])
        if open_key is not None:
            yield pd.DataFrame([(*open_key, gets, total)], columns=[*keys, "gets", "bytes"])

    spans = ranges.where((F.col("lo") < F.col("hi")) & (F.col("hi") - F.col("lo") <= max_range)).select(*keys, "lo", "hi").distinct()
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in spans.select(*keys).schema] + ["gets long", "bytes long"])
    return spans.repartition(*keys).sortWithinPartitions(*keys, "lo", "hi").mapInPandas(run, schema)


def begins_run(keys: list[str]) -> Column:
    """1 where a range (``lo`` < ``hi``) begins a read of its key, 0 where it is adjacent to the one before it or repeats it."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    lo, hi = F.lag("lo").over(order), F.lag("hi").over(order)
    return F.when(hi.eqNullSafe(F.col("lo")) | (lo.eqNullSafe(F.col("lo")) & hi.eqNullSafe(F.col("hi"))), 0).otherwise(1)


def adjacent_runs(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The same where only adjacency matters, as islands in SQL windows."""
    spans = ranges.where("lo < hi").select(*keys, "lo", "hi").distinct().withColumn("_open", begins_run(keys))
    return spans.groupBy(*keys).agg(F.sum("_open").alias("gets"), F.sum(F.col("hi") - F.col("lo")).alias("bytes"))


def budgeted(rows: DataFrame, keys: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Rows of a batch while what stands before them is under the budget; the first always stays."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_before", F.sum(size).over(w) - F.col(size)).where((F.col("_before") < budget) | (F.col("_before") == 0)).drop("_before")
