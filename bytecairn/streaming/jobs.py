"""Structured Streaming forms of the hourly counters, the counter rates and the log replay.

Each takes a streaming DataFrame and returns one; ``drain`` runs a query over what is there now and returns the sink
table, with its state and output in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bytecairn.operators import history, telemetry
from bytecairn.sources import io

def hourly_access(events: DataFrame, lateness: str = "40 days") -> DataFrame:
    """Hourly counters by event type; repeated event ids count once, events later than ``lateness`` are dropped."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    rows = marked.select("event_type", "ts", F.floor(F.col("value") * 100).cast("long").alias("bytes"))
    return telemetry.hourly_windows(rows, ["event_type"])


def replay(changes: DataFrame) -> DataFrame:
    """The log (bucket, generation, key, seq, op, size) as the last change of every key in every generation: what ``replayed`` reads.

    Aggregated in the JVM, in update mode: the newest sequence wins in whatever order changes come. State is a row a key and generation;
    control changes, which have no key, are a row a bucket, generation and kind.
    """
    kind = F.when(F.col("op").isin("put", "delete"), F.lit("row")).otherwise(F.col("op")).alias("kind")
    named = changes.select("bucket", "generation", F.when(F.col("op").isin("put", "delete"), F.col("key")).alias("key"), kind, "seq", "op", "size")
    last = F.max_by(F.struct("op", "size"), "seq")
    return named.groupBy("bucket", "generation", "key", "kind").agg(F.max("seq").alias("seq"), last.alias("last")).select("bucket", "generation", "key", "seq", "last.*")


def replayed(slots: DataFrame) -> DataFrame:
    """The catalogue that the sink of ``replay`` tells of: the same as ``history.replay`` of the whole log."""
    return history.replay(slots)


#: What is kept of a node between batches.
NODE_STATE = "boot long, sequence long, uptime long, counters array<long>"


def counter_rates(samples: DataFrame, counters: list[str], max_seconds: int, lateness: str = "1 hour", silence_seconds: int = 86_400) -> DataFrame:
    """Growth of counters between a node's samples (node, ts, boot, sequence, uptime and the counters), as ``telemetry.counter_deltas`` tells it.

    Rows: node, kind, sequence, seconds, n and d_<counter>. ``rate`` rows carry growth (n is 1). A sample that is not behind its node's newest
    one comes too late and is dropped; ``dropped`` rows count them, so that no loss goes untold. A node silent for ``silence_seconds`` of
    event time behind the watermark is forgotten (``expired``); its next sample gives no growth. So state is a row a node heard of lately.
    """
    names = [f"d_{c}" for c in counters]
    schema = "node long, kind string, sequence long, seconds long, n long, " + ", ".join(f"{c} long" for c in names)

    def apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "expired", None, None, 1, *[None] * len(names))], columns=["node", "kind", "sequence", "seconds", "n", *names]).astype({c: "Int64" for c in ["sequence", "seconds", *names]})
            return
        boot, sequence, uptime, before = state.get if state.exists else (None, None, None, None)
        rows, dropped, newest = [], 0, 0
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "sequence"], kind="stable")
        for at, b, q, up, *now in pdf[["ts", "boot", "sequence", "uptime", *counters]].itertuples(index=False):
            newest = max(newest, int(at.timestamp() * 1000))
            if boot == b and q <= sequence:
                dropped += 1
                continue
            growth = [int(x) - y for x, y in zip(now, before)] if boot == b else None
            if growth and 0 < up - uptime <= max_seconds and min(growth) >= 0:
                rows.append((key[0], "rate", int(q), int(up - uptime), 1, *growth))
            boot, sequence, uptime, before = int(b), int(q), int(up), [int(x) for x in now]
        if dropped:
            rows.append((key[0], "dropped", None, None, dropped, *[None] * len(names)))
        state.update((boot, sequence, uptime, before))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + silence_seconds * 1000)
        yield pd.DataFrame(rows, columns=["node", "kind", "sequence", "seconds", "n", *names]).astype({c: "Int64" for c in ["sequence", "seconds", "n", *names]})

    marked = samples.select("node", "ts", "boot", "sequence", "uptime", *counters).withWatermark("ts", lateness)
    return marked.groupBy("node").applyInPandasWithState(apply, schema, NODE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drain(spark: SparkSession, stream: DataFrame, keys: list[str], newest: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Run ``stream`` over all input present; the sink's rows, of which ``newest`` picks each key's last."""
    place = f"{io.shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/out/number={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    state = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/state")
    state.getFileSystem(spark._jsc.hadoopConfiguration()).delete(state, True)  # this query does not run again
    return newest(spark.read.option("basePath", f"{place}/out").parquet(f"{place}/out").drop("number"))
