"""Reading catalogues, listings and change logs; writing reports, exports, accumulators and pack files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytecairn.operators import packs, telemetry

CHANGE = "bucket string, name string, generation long, seq long, op string, key string, attributes struct<size: long, etag: string, metadata: map<string, string>, modified_us: bigint>, ranges array<struct<material: string, offset: long, source_offset: long, length: long>>"
CLASHES = {"skip": "ignore", "overwrite": "overwrite", "verify": "errorifexists"}


def catalogue_table(spark: SparkSession, location: str, name: str, *, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16) -> DataFrame:
    """A metadata table from Parquet under ``location`` or over JDBC, there in ranges of ``key`` if its bounds are known."""
    if not location.startswith("jdbc:"):
        return spark.read.parquet(f"{location}/{name}.parquet")
    reader = spark.read.format("jdbc").option("url", location).option("dbtable", name)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def change_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON-lines change log with a fixed schema; malformed lines fail the read."""
    reader = (spark.readStream if stream else spark.read).schema(CHANGE).option("mode", "FAILFAST")
    return reader.json(path)


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under a path of any store that Spark reads: path, length, modified; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def contents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def keyset_page(rows: DataFrame, order: list[str], after: tuple | None, n: int) -> DataFrame:
    """The page of ``n`` rows behind the last one seen, and one more as a sign that there is more."""
    if after is not None:
        last = F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, after)])
        rows = rows.where(F.struct(*order) > last)
    return rows.orderBy(*order).limit(n + 1)


def up_to(rows: DataFrame, key: str, upper: int | None = None) -> DataFrame:
    """A scan that later rows do not join: bounded by the largest key when it begins."""
    if upper is None:
        upper = rows.agg(F.max(key)).first()[0]
    return rows.where(F.col(key) <= F.lit(upper))


def under_prefix(rows: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    return rows.where(F.col(key).startswith(prefix))


def write_report(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines."""
    findings.write.mode("overwrite").json(path)


def export(rows: DataFrame, path: str, clash: str = "verify", by: list[str] | None = None) -> None:
    """An export that skips, overwrites or refuses what is there already."""
    writer = rows.write.mode(CLASHES[clash])
    (writer.partitionBy(*by) if by else writer).parquet(path)


def accumulate_into(spark: SparkSession, current: str | None, batch: DataFrame, keys: list[str], sums: list[str], target: str) -> DataFrame:
    """Additive upsert of a batch into the counters at ``current``, written as a new version at ``target``."""
    before = spark.read.parquet(current) if current else batch.limit(0)
    telemetry.accumulate(before, batch, keys, sums).write.parquet(target)
    return spark.read.parquet(target)


def write_packs(members: DataFrame, content: Column, path: str, header: bytes = b"PACKFILE") -> None:
    """Pack files as rows (pack, members, body): a header and the members' contents in order of their offset.

    ``members`` has pack, member, length; a pack is bounded (``packs.MAX_MEMBERS``), so its members fit a task.
    """
    placed = packs.layout(members.withColumn("_content", content), "pack", "member", "length")
    gathered = placed.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("offset", "member", "length", F.hex("_content").alias("body")))).alias("m"))
    body = F.unhex(F.concat(F.lit(header.hex()), F.array_join(F.transform("m", lambda x: x["body"]), "")))
    gathered.select("pack", F.transform("m", lambda x: F.struct(x["member"].alias("member"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("members"), body.alias("body")).write.parquet(path)


#: Used only where nothing names a folder and driver and executors are one machine, as in tests.
LOCAL_FOLDER = "file:///tmp/checkpoints/bytecairn-tables"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's setting, else the context's; a local one in local mode only."""
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (chosen.get().rpartition("/")[0] if chosen.isDefined() else None)
    if base is None and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    return (base or LOCAL_FOLDER).rstrip("/")


def materialised(df: DataFrame) -> DataFrame:
    """``df`` computed once: a reliable checkpoint in the shared folder, so that no lost executor undoes it."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
