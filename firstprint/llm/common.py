"""What several operators share: input columns, word hashes, grouping by shared keys, components."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firstprint.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

#: Rounds of `bucket_components` in which an id meets one other at most, and the leaders a bucket names in each later round.
MEETINGS, LEADERS = 3, 32
#: Rows a task of an iteration takes at least: rounds over few rows are not spread over thousands of tasks.
TASK_ROWS = 50_000
#: Longs of an odd sketch.
SKETCH_LONGS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator on texts reads, under fixed names; other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def put(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` with columns replaced in place, in the same order and types."""
    return docs.withColumns({k: v.cast(docs.schema[k].dataType) for k, v in columns.items() if k in docs.columns})


def plus(schema: T.StructType, **columns: str) -> T.StructType:
    """A copy of ``schema`` with columns added (``add`` would change the schema of the DataFrame it came from)."""
    return T.StructType([*schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in columns.items())])


# ---------------------------------------------------------------- hashes inside tasks

class Words(dict):
    """Hash of a word (bytes), remembered while a task runs; forgotten when it grows beyond 200,000 words (some 25 MB)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a finaliser of two multiply-xorshift steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words; of the whole sequence when it is shorter; none of none."""
    n = min(n, len(words))
    if not n:
        return words
    factors, out, spread = odd_constants(n, seed + n), np.zeros(len(words) - n + 1, np.uint64), mixed(words)
    for i in range(n):
        out += spread[i : len(words) - n + 1 + i] * factors[i]
    return mixed(out)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lists(values: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    """A list column from one array a row."""
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def kept_small(df: DataFrame, rows: int, label: str) -> DataFrame:
    """Written and read back, by no more tasks than ``rows`` rows are worth."""
    tasks = rows // TASK_ROWS + 1
    return materialise(df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df, label)


# ---------------------------------------------------------------- bounded filters of hashes

def hash_filter(hashes: DataFrame, most_bits: int) -> np.ndarray:
    """A bit for each value of the leading bits of the hashes (column hash): 32 bits or more a row, 2 ** most_bits at most.

    No hash of ``hashes`` is ever lost; a fuller filter lets others through. At most 2 ** most_bits / 64 rows reach the driver.
    """
    width = max(6, min(most_bits, (32 * hashes.count()).bit_length()))
    at = F.shiftrightunsigned("hash", 64 - width)
    rows = (hashes.select(F.shiftrightunsigned(at, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - width}) & 63L as int))").alias("bit"))
            .groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow())
    bits = np.zeros(1 << (width - 6), np.int64)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return bits.view(np.uint8)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter of `hash_filter` lets through."""
    at = hashes >> np.uint64(65 - (8 * len(bits)).bit_length())
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


# ---------------------------------------------------------------- components

def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, comp) for each vertex of an edge list; comp is the smallest vertex that can be reached.

    Every round each vertex takes the label of the neighbour (or itself) that comes first in a random
    order, and the graph is contracted; the order changes each round, so chains shrink as fast as stars.
    Minima combine before the shuffle; joins on a hot vertex are joins of Spark's that it can split.
    """
    kind = edges.schema[u].dataType
    edges = materialise(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "edges")
    labels, step, n = None, 0, edges.count()
    rows = n
    while n:
        order = lambda c: F.struct(F.xxhash64(c, F.lit(step)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        near = (edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
                .groupBy("u").agg(F.min(order("v")).alias("m"))
                .select("u", F.least("m", order("u"))["id"].alias("l")))
        near = kept_small(near, 2 * n, "labels")
        labels = near.toDF("id", "l") if labels is None else kept_small(
            labels.join(near.toDF("l", "n"), "l", "left").select("id", F.coalesce("n", "l").alias("l")), 2 * rows, "labels")
        edges = kept_small(edges.join(near.toDF("u", "lu"), "u").join(near.toDF("v", "lv"), "v")
                           .where("lu <> lv").select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v"))
                           .distinct(), n, "edges")
        step, n = step + 1, edges.count()
    if labels is None:
        return edges.sparkSession.createDataFrame([], T.StructType([T.StructField("id", kind), T.StructField("comp", kind)]))
    first = labels.groupBy("l").agg(F.min("id").alias("comp"))
    return kept_small(labels.join(first, "l").select("id", "comp"), 2 * rows, "components")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, id), the distinct ones whose key another id has too. Holds one batch and one row."""
    held, held_twin = None, False
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        if not rows.num_rows:
            continue
        key = rows["key"].combine_chunks()
        same_key = pc.equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
        ids = rows["id"].combine_chunks()
        repeat = same_key & pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
        keep = np.r_[True, ~repeat]
        rows, key = rows.filter(pa.array(keep)).combine_chunks(), key.filter(pa.array(keep))
        same_key = pc.equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
        twin = np.r_[held_twin if held is not None else False, same_key] | np.r_[same_key, False]
        last = rows.slice(rows.num_rows - 1).combine_chunks()
        held, held_twin = last.to_batches()[0], bool(twin[-1])
        if twin[:-1].any():
            yield from rows.slice(0, rows.num_rows - 1).filter(pa.array(twin[:-1])).to_batches()
    if held is not None and held_twin:
        yield held


def shared_buckets(rows: DataFrame) -> DataFrame:
    """Of (key, id, n) rows, the distinct ones whose key at least two ids have. One shuffle, streamed in key order."""
    return (rows.select("key", "id", "n").repartition("key").sortWithinPartitions("key", "id")
            .mapInArrow(_shared, rows.select("key", "id", "n").schema))


def odd_distance(x: Column, y: Column) -> Column:
    """In how many bits two odd sketches differ: never in more than the elements in which their sets do."""
    return sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(SKETCH_LONGS)), F.lit(0))


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """The parity of how many values fall on each bit, as longs: each value more or less turns one bit over."""
    bits = np.bincount((values % (64 * SKETCH_LONGS)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def bucket_components(live: DataFrame, fits: Callable[[Column, Column], Column],
                      confirm: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, comp) of all ids linked to another one. ``live``: a written table of (key, id, n), see `shared_buckets`;
    n is whatever ``fits`` compares, a size or a struct.

    A link joins two ids that share a key, whose sizes fit and that ``confirm`` (pairs with columns a, b in,
    those that hold out) accepts. A bucket is never paired with itself as a whole. In the first MEETINGS rounds each id
    outside the largest component of a bucket meets a single member of such a component, so copies join at a cost of
    one pair an id. After that each bucket names up to LEADERS of its outsiders; a leader meets all that share any
    bucket with it and are not yet in its component, and then leaves every bucket. A bucket ends when one component
    is left in it, so no link that joins two components is missed, and no cap is needed.
    """
    comp, step, rows = None, 0, live.count()
    while True:
        if comp is not None:
            live = live.join(comp, "id", "left").select("key", "id", "n", F.coalesce("comp", "id").alias("comp"))
        else:
            live = live.withColumn("comp", F.col("id"))
        sizes = live.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(
            F.max(F.struct("c", "comp"))["comp"].alias("main"), F.count("*").alias("comps"), (F.sum("c") - F.max("c")).alias("others"))
        live = kept_small(live.join(sizes.where("comps > 1").select("key", "main", "others"), "key"), rows, "buckets")
        rows = live.count()
        if not rows:
            break
        spread, outside = F.xxhash64("id", F.lit(step)), live.where("comp <> main")
        if step < MEETINGS:
            heads = live.where("comp = main").groupBy("key").agg(F.min(F.struct(spread.alias("h"), "id", "n", "comp")).alias("head"))
            first = outside.join(heads, "key").where(fits(F.col("head.n"), F.col("n"))).groupBy("id", "comp").agg(F.min("head").alias("head"))
            met, gone = first.select("id", "comp", F.col("head.id").alias("hid"), F.col("head.comp").alias("hcomp")), None
        else:
            slot = F.when(F.col("others") <= LEADERS, spread).otherwise(F.pmod(spread, F.lit(LEADERS)))
            gone = kept_small(outside.groupBy("key", slot.alias("slot")).agg(F.min("id").alias("id")).select("id").distinct(), rows, "leaders")
            heads = live.join(gone, "id").select("key", F.col("id").alias("hid"), F.col("n").alias("hn"), F.col("comp").alias("hcomp"))
            met = live.join(heads, "key").where((F.col("hcomp") != F.col("comp")) & fits(F.col("hn"), F.col("n")))
        swap = F.col("hid") < F.col("id")
        pairs = met.select(F.when(swap, F.col("hid")).otherwise(F.col("id")).alias("a"),
                           F.when(swap, F.col("id")).otherwise(F.col("hid")).alias("b"),
                           F.when(swap, F.col("hcomp")).otherwise(F.col("comp")).alias("ca"),
                           F.when(swap, F.col("comp")).otherwise(F.col("hcomp")).alias("cb")).distinct()
        joined = components(confirm(pairs), "ca", "cb")
        if comp is None:
            comp = joined
        else:
            comp = comp.join(joined.toDF("comp", "better"), "comp", "left").select("id", F.coalesce("better", "comp").alias("comp"))
            comp = kept_small(comp.unionByName(joined.join(comp, "id", "left_anti")), comp.count(), "components")
        live = live.select("key", "id", "n") if gone is None else live.select("key", "id", "n").join(gone, "id", "left_anti")
        step += 1
    if comp is None:
        comp = components(live.select(F.col("id").alias("u"), F.col("comp").alias("v")))
    return comp
