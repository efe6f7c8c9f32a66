"""What may be deleted, what is still allowed, and what is set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def garbage_copies(copies: DataFrame, kept: DataFrame, now: int, grace: int, minimum: int) -> DataFrame:
    """Copies that may go, oldest first in line: retired or deleting, owned by nobody, out of use for ``grace`` seconds, and stored and active for ``minimum``.

    ``copies``: id, address, storage, state, owner, unreferenced, stored (null: unknown, which does not hold a copy back), activated (null: never moved), recovering.
    ``kept``: addresses that a journal, a transfer, a running read or a move protects. ``age_unknown`` asks to look the age up before deletion.
    """
    out_of_use = F.col("state").isin("retired", "deleting") | ((F.col("state") == "deleted") & F.col("recovering"))
    old = F.lit(minimum == 0) | F.col("stored").isNull() | (F.col("stored") <= now - minimum)
    settled = F.col("activated").isNull() | (F.col("activated") <= now - minimum)
    free = copies.where(out_of_use & F.col("owner").isNull() & (F.col("unreferenced") < now - grace) & old & settled)
    held = kept.select(F.col("address").alias("_kept")).distinct()
    return free.join(held, F.col("address") == F.col("_kept"), "left_anti").withColumn("age_unknown", F.col("stored").isNull() | F.col("recovering"))


def quota_state(scopes: DataFrame) -> DataFrame:
    """``scopes`` (scope, scope_id, used, reserved, used_limit) with ``left`` and ``allowed``: used and reserved bytes together within the limit; a null limit is none, zero forbids."""
    taken = F.col("used") + F.col("reserved")
    return scopes.withColumn("left", F.col("used_limit") - taken).withColumn("allowed", F.col("used_limit").isNull() | (taken <= F.col("used_limit")))


def reserved_by(reservations: DataFrame, key: str) -> DataFrame:
    """Bytes set aside by ``key``, and those of finished work that its accounting has not taken over yet (``boot`` and ``revision`` against ``seen_boot``, ``seen_revision``)."""
    settled = F.col("complete") & F.col("boot").isNotNull() & ((F.col("boot") != F.col("seen_boot")) | (F.col("revision") <= F.col("seen_revision")))
    left = reservations.where(~F.coalesce(settled, F.lit(False)))
    return left.groupBy(key).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("reservations"))
