"""Bar tables, CSV and JSON sinks, incremental ingest and content hashes."""

from __future__ import annotations

import ctypes
import sys
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firstprint.schemas import BAR_SCHEMA, BAR_TABLE_SCHEMA, validate_bars

# Task functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_bars(spark: SparkSession, path: str, timeframe: str | None = None) -> DataFrame:
    """Bars of the partitioned dataset; a timeframe reads only its partition."""
    df = spark.read.schema(BAR_TABLE_SCHEMA).parquet(path)
    return df if timeframe is None else df.where(F.col("timeframe") == timeframe)


def write_bars(df: DataFrame, path: str, timeframe: str) -> None:
    """Replaces one timeframe partition; files are clustered by symbol and sorted by time.

    A range partitioning on (symbol, ts) also splits a symbol that holds much of the data, and
    leaves row-group statistics that let a symbol filter skip most of the files.
    """
    validate_bars(df, timeframe)
    bars = df.select(*BAR_SCHEMA.fieldNames()[:7], *[c for c in ("vwap", "trade_count") if c in df.columns])
    (
        bars.withColumns({"symbol": F.upper("symbol"), "timeframe": F.lit(timeframe)})
        .repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("timeframe").parquet(path)
    )


def write_bucketed_bars(df: DataFrame, table: str, buckets: int) -> None:
    """Bars as a table bucketed by symbol: per-symbol windows then need no shuffle."""
    (df.withColumn("symbol", F.upper("symbol")).write.mode("overwrite").bucketBy(buckets, "symbol")
     .sortBy("symbol", "ts").format("parquet").saveAsTable(table))


def save_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").limit(1).count()
        return True
    except Exception as err:  # noqa: BLE001 - Spark raises AnalysisException for a missing path
        if "PATH_NOT_FOUND" in str(err):
            return False
        raise


def ingest_bars(incoming: DataFrame, path: str, timeframe: str, force_refresh: bool = False) -> DataFrame:
    """Appends the symbols not stored yet (or replaces the incoming ones); returns (symbol, rows, from_cache).

    Symbols are the cache unit: a stored symbol is served from the table, whatever its dates.
    """
    spark = incoming.sparkSession
    incoming = incoming.withColumn("symbol", F.upper("symbol"))
    wanted = incoming.select("symbol").distinct()
    stored = read_bars(spark, path, timeframe).drop("timeframe") if path_exists(spark, path) else None
    if stored is None:
        fresh, old = incoming, None
        write_bars(fresh, path, timeframe)
    elif force_refresh:
        from firstprint.session import materialise

        old = stored.limit(0)
        merged = materialise(
            stored.join(wanted, "symbol", "left_anti").unionByName(incoming, allowMissingColumns=True), "merge")
        fresh = incoming
        write_bars(merged, path, timeframe)
    else:
        from firstprint.session import materialise

        known = materialise(stored.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")), "known")
        fresh = incoming.join(known, "symbol", "left_anti")
        validate_bars(fresh, timeframe)
        (fresh.withColumn("timeframe", F.lit(timeframe)).repartitionByRange("symbol", "ts")
         .sortWithinPartitions("symbol", "ts").write.mode("append").partitionBy("timeframe").parquet(path))
        cached = known.join(wanted, "symbol", "left_semi").withColumn("from_cache", F.lit(True))
        return cached.unionByName(
            incoming.join(known, "symbol", "left_anti").groupBy("symbol")
            .agg(F.count(F.lit(1)).alias("rows")).withColumn("from_cache", F.lit(False)))
    return fresh.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")).withColumn("from_cache", F.lit(False))


def unprocessed(todo: DataFrame, processed: DataFrame, key: str = "symbol") -> DataFrame:
    """Rows whose key is not in the processed table yet (resume after a stop)."""
    return todo.join(processed.select(key), key, "left_anti")


def mark_processed(done: DataFrame, path: str, key: str = "symbol") -> None:
    done.select(key).distinct().write.mode("append").parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """Metric rows as JSON lines; manifests hold a handful of rows, so one file is right."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, content_hash): first 16 hex digits of each file's SHA-256.

    Files of up to one split are digested whole, in parallel. A SHA-256 of a larger one needs the state after all that
    lies before, so its splits are read one after the other, each in a task of its own that starts from the state of the
    last one: no task reads or holds more than a split. Several large files go on side by side.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    split = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")))
    large = files.where(F.col("length") > split).select("path", "length").collect()  # names only, of files above a split
    with ThreadPoolExecutor(8) as pool:
        chained = list(pool.map(lambda r: (r["path"], _chained_sha256(spark, r["path"], r["length"])), large))
    whole = files.where(F.col("length") <= split)
    unread = [p for p, sha in chained if sha is None]
    if unread:
        whole = whole.unionByName(spark.read.format("binaryFile").load(unread))
    hashes = whole.select("path", F.sha2("content", 256).alias("_sha"))
    if len(chained) > len(unread):
        hashes = hashes.unionByName(spark.createDataFrame([r for r in chained if r[1]], "path string, _sha string"))
    return hashes.select("path", F.substring("_sha", 1, 16).alias("content_hash"))


def _crypto():
    """The library behind ``hashlib``, whose SHA-256 keeps its state in a plain block of bytes; None if it has none."""
    import _hashlib

    try:
        lib = ctypes.CDLL(_hashlib.__file__)
        return lib if lib.SHA256_Init and lib.SHA256_Update and lib.SHA256_Final else None
    except (OSError, AttributeError):
        return None


_STATE_BYTES = 256  # the state takes 112


def _chained_sha256(spark: SparkSession, path: str, length: int) -> str | None:
    """SHA-256 of one file, split by split; None where the splits do not add up to the file (it is not read as it is).

    Lines are only a way to read a part of a file as it is: they end at byte 10 and nowhere else, and each is put back behind
    that byte. So a file with no such byte for 2 GB cannot be read.
    """
    crypto = _crypto()
    if crypto is None:
        return None
    lines = spark.read.option("lineSep", "\n").text(path).select(F.concat(F.lit(b"\n"), F.col("value").cast("binary")).alias("line"))
    state, done = ctypes.create_string_buffer(_STATE_BYTES), 0
    crypto.SHA256_Init(state)
    for part in range(lines.rdd.getNumPartitions()):
        step = lines.mapInArrow(_sha256_step(state.raw, done == 0), "state binary, done bigint").rdd
        raw, more = spark.sparkContext.runJob(step, list, [part])[0]
        state, done = ctypes.create_string_buffer(bytes(raw), _STATE_BYTES), done + more
    if done == length - 1:  # the last line ends, too
        crypto.SHA256_Update(state, b"\n", ctypes.c_size_t(1))
    elif done != length:
        return None
    digest = ctypes.create_string_buffer(32)
    crypto.SHA256_Final(digest, state)
    return digest.raw.hex()


def _sha256_step(before: bytes, first: bool):
    """Takes the state ``before`` a split on to the one behind it; ``first``: no line end comes before its first line."""

    def step(batches):
        crypto, state, done = _crypto(), ctypes.create_string_buffer(before, _STATE_BYTES), 0
        skip = int(first)
        for batch in batches:
            lines = batch.column(0)
            if not len(lines):
                continue
            ends = np.frombuffer(lines.buffers()[1], np.int32, len(lines) + 1, lines.offset * 4)
            data = np.frombuffer(lines.buffers()[2], np.uint8)[ends[0] + skip:ends[-1]]
            crypto.SHA256_Update(state, ctypes.c_void_p(data.ctypes.data), ctypes.c_size_t(len(data)))
            skip, done = 0, done + len(data)
        yield pa.RecordBatch.from_pydict({"state": [state.raw], "done": [done]}, pa.schema([("state", pa.binary()), ("done", pa.int64())]))

    return step


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, content_hash) of the row set: independent of row order and file layout.

    The sum of row hashes tells repeated rows apart, which an xor would cancel.
    """
    row = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row).cast("string").alias("content_hash"))
