"""A bar table in which one symbol can be replaced: hash buckets, and a log that names the live folders.

Layout: ``data/<generation>/timeframe=T/bucket=B`` holds bars, ``live`` holds one JSON row per live folder and version.
A write puts its bars into a new generation and only then appends the next version to the log, as one file that appears
whole when its job commits. A write that dies before leaves the version in force as it was; its folders are never read.
One writer at a time. Folders that no version in force names stay until someone removes them (``stale_folders``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firstprint.schemas import BAR_SCHEMA, validate_bars
from firstprint.session import materialise
from firstprint.sources.tables import path_exists

#: Buckets of a timeframe: a refresh rewrites the buckets of its symbols, about one part in so many each.
BUCKETS = 64
LIVE_SCHEMA = "version long, timeframe string, bucket int, generation string, buckets int"


def bucket_of(symbol: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.upper(symbol)), F.lit(buckets)).cast("int")


def live_folders(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest version: a row per timeframe, bucket and generation. Empty before the first write."""
    if not path_exists(spark, f"{path}/live"):
        return spark.createDataFrame([], LIVE_SCHEMA)
    log = spark.read.schema(LIVE_SCHEMA).json(f"{path}/live")
    newest = log.agg(F.max("version").alias("_newest"))  # one row
    return log.join(F.broadcast(newest), F.col("version") == F.col("_newest")).drop("_newest")


def read_store(spark: SparkSession, path: str, timeframe: str, symbols: list[str] | None = None) -> DataFrame:
    """Live bars of a timeframe. ``symbols`` opens their buckets only and keeps their rows."""
    live = live_folders(spark, path).where(F.col("timeframe") == timeframe)
    if symbols is not None:
        hashes = F.array(*[F.xxhash64(F.upper(F.lit(s))) for s in symbols]).cast("array<bigint>")
        live = live.where(F.exists(hashes, lambda h: F.pmod(h, F.col("buckets")) == F.col("bucket")))
    folders = [f"{path}/data/{r['generation']}/timeframe={timeframe}/bucket={r['bucket']}"
               for r in live.select("generation", "bucket").orderBy("bucket", "generation").collect()]  # buckets x generations
    if not folders:
        return spark.createDataFrame([], BAR_SCHEMA)
    bars = spark.read.schema(BAR_SCHEMA).parquet(*folders)
    return bars if symbols is None else bars.where(F.col("symbol").isin([s.upper() for s in symbols]))


def _write_generation(bars: DataFrame, path: str, timeframe: str, buckets: int) -> tuple[str, list[int]]:
    """Writes bars into a generation of their own: its name and its buckets. A hot bucket is split over many tasks."""
    generation = uuid.uuid4().hex
    kept = bars.select(*[F.col(f.name).cast(f.dataType) if f.name in bars.columns else F.lit(None).cast(f.dataType).alias(f.name)
                         for f in BAR_SCHEMA.fields])
    (kept.withColumns({"symbol": F.upper("symbol"), "timeframe": F.lit(timeframe), "bucket": bucket_of(F.col("symbol"), buckets)})
     .repartitionByRange("bucket", "symbol", "ts").sortWithinPartitions("bucket", "symbol", "ts")
     .write.mode("errorifexists").partitionBy("timeframe", "bucket").parquet(f"{path}/data/{generation}"))
    spark = bars.sparkSession
    written = spark.read.schema("symbol string, timeframe string, bucket int").parquet(f"{path}/data/{generation}")
    return generation, sorted(r[0] for r in written.select("bucket").distinct().collect())  # at most `buckets`


def _publish(spark: SparkSession, path: str, live: list[tuple], version: int) -> None:
    """Appends a version to the log, as one file."""
    spark.createDataFrame([(version, *r) for r in live], LIVE_SCHEMA).coalesce(1).write.mode("append").json(f"{path}/live")


def ingest(incoming: DataFrame, path: str, timeframe: str, force_refresh: bool = False, buckets: int = BUCKETS,
           publish=_publish) -> DataFrame:
    """Stores the symbols of ``incoming``: (symbol, rows, from_cache).

    Without ``force_refresh`` stored symbols are served as they are and the others are appended to their buckets. With it
    the incoming symbols replace what is stored, and only the buckets they fall into are rewritten. ``buckets`` counts
    for a new store; later writes take the number the store was made with. Bars without a symbol take no part. An empty
    table changes nothing. ``publish`` puts the new version in force.
    """
    validate_bars(incoming, timeframe)
    spark = incoming.sparkSession
    incoming = materialise(incoming.where("symbol is not null").withColumn("symbol", F.upper("symbol")), "incoming")
    live = [tuple(r) for r in live_folders(spark, path).collect()]  # buckets x generations
    version = max((r[0] for r in live), default=0)
    live = [r[1:] for r in live]
    buckets = next((r[3] for r in live if r[0] == timeframe), buckets)
    wanted = incoming.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    stored = read_store(spark, path, timeframe)
    if force_refresh:
        touched = {r[0] for r in wanted.select(bucket_of(F.col("symbol"), buckets)).distinct().collect()}  # at most `buckets`
        gone = [r for r in live if r[0] == timeframe and r[1] in touched]
        if gone:
            old = spark.read.schema(BAR_SCHEMA).parquet(*[f"{path}/data/{r[2]}/timeframe={timeframe}/bucket={r[1]}" for r in gone])
            incoming = old.join(wanted.select("symbol"), "symbol", "left_anti").unionByName(incoming, allowMissingColumns=True)
        live = [r for r in live if r not in gone]
        answer = wanted.withColumn("from_cache", F.lit(False))
    else:
        # written: the answer must not look at the store after it has changed
        known = materialise(stored.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")), "known")
        incoming = incoming.join(known.select("symbol"), "symbol", "left_anti")
        answer = known.join(wanted.select("symbol"), "symbol", "left_semi").withColumn("from_cache", F.lit(True)).unionByName(
            wanted.join(known.select("symbol"), "symbol", "left_anti").withColumn("from_cache", F.lit(False)))
    generation, written = _write_generation(incoming, path, timeframe, buckets)
    if written:
        publish(spark, path, live + [(timeframe, b, generation, buckets) for b in written], version + 1)
    return answer


def compact(spark: SparkSession, path: str, timeframe: str, most: int = 4) -> int:
    """Rewrites each bucket that is spread over more than ``most`` generations into one; returns their number."""
    live = [tuple(r) for r in live_folders(spark, path).collect()]  # buckets x generations
    version, rows = max((r[0] for r in live), default=0), [r[1:] for r in live]
    own = [r for r in rows if r[0] == timeframe]
    spread = {b for b in {r[1] for r in own} if sum(r[1] == b for r in own) > most}
    gone = [r for r in own if r[1] in spread]
    if gone:
        bars = spark.read.schema(BAR_SCHEMA).parquet(*[f"{path}/data/{r[2]}/timeframe={timeframe}/bucket={r[1]}" for r in gone])
        generation, written = _write_generation(bars, path, timeframe, own[0][3])
        _publish(spark, path, [r for r in rows if r not in gone] + [(timeframe, b, generation, own[0][3]) for b in written], version + 1)
    return len(spread)


def stale_folders(spark: SparkSession, path: str) -> DataFrame:
    """(folder): bucket folders with bars that the version in force does not name; safe to remove when nothing reads or writes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{path}/data")
    folder = F.regexp_extract("path", r"/data/([^/]+/timeframe=[^/]+/bucket=\d+)/[^/]+$", 1)
    live = live_folders(spark, path).select(F.format_string("%s/timeframe=%s/bucket=%d", "generation", "timeframe", "bucket").alias("folder"))
    return files.select(folder.alias("folder")).distinct().join(live, "folder", "left_anti")
