"""MinHash near-dedup by tensored banding."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstprint.llm.common import Words, bucket_components, grams, lists, odd_constants, odd_distance, odd_sketch, shared_buckets, texts
from firstprint.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Values in each of the two collections; keys are all pairs of one from each, so SIDE * SIDE tables.
SIDE = 12
#: Minhashes joined in one value, so a table key stands for 2 * WIDTH of them.
WIDTH = 3
_CHUNK = 2048


def shingle_set(text: str | None, words: Words, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a whole text; A-Z count as a-z."""
    return np.unique(grams(words.of((text or "").encode().lower().split()), width))


def collections(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """2 * SIDE values, each joined from ``width`` minhashes: 2 * SIDE * width minhashes for SIDE ** 2 keys."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), _CHUNK):
        block = shingles[start : start + _CHUNK, None] ^ b
        block *= a
        np.minimum(low, block.min(axis=0), out=low)
    joined = low.reshape(-1, width)
    out = np.zeros(len(joined), np.uint64)
    for i in range(width):
        out = (out ^ (joined[:, i] >> np.uint64(7))) * odd_constants(1, 90 + i)[0]
    return out


def signatures(docs: DataFrame, shingle_words: int = 3, side: int = SIDE, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, set_id (fingerprint of the set; null when empty), left and right (hash collections)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, a, b = Words(), odd_constants(2 * side * width, 1), odd_constants(2 * side * width, 2)
        for batch in batches:
            sizes, prints, left, right = [], [], [], []
            for text in batch["text"].to_pylist():
                own = shingle_set(text, words, shingle_words)
                sizes.append(len(own))
                prints.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                both = collections(own, a, b, width).view(np.int64) if len(own) else np.empty(0, np.int64)
                left.append(both[:side])
                right.append(both[side:])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), lists(left), lists(right)],
                ["doc_id", "n_shingles", "set_id", "left", "right"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, left array<long>, right array<long>")


def shingle_sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            sets = [shingle_set(text, words, shingle_words) for text in batch["text"].to_pylist()]
            sketches = lists([odd_sketch(s) for s in sets])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists([s.view(np.int64) for s in sets]), sketches], ["id", "shingles", "sketch"])

    return docs.mapInArrow(run, "id long, shingles array<long>, sketch array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                    percent: int = 85, side: int = SIDE, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    Two documents are linked when 100 * |A n B| >= percent * |A u B| on their full shingle sets. Documents
    with equal sets form one class, of which only the smallest id goes on. Two collections of ``side``
    values (each joins ``width`` minhashes) are combined in pairs into side ** 2 table keys; classes that share a
    key are candidates, every candidate is verified on the full sets (`bucket_components`).
    A link at similarity s is missed with probability 1 - (1 - (1 - s**width)**side)**2: 2e-5 at 0.85 as set here.

    Null text and texts without words: no shingles, linked with nothing. Rows with a null id: left out, as nothing
    can name them. Repeated rows: each comes back, with equal values. An id is taken to name one text
    only. Other columns of ``docs`` play no part.
    """
    own = texts(docs, id_col, text_col).where("doc_id is not null")
    signed = materialise(signatures(own, shingle_words, side, width), "signatures")
    first = signed.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    classes = signed.join(first, ["set_id", "doc_id"], "left_semi")
    left = classes.select("doc_id", "n_shingles", "right", F.posexplode("left").alias("i", "x"))
    rows = (left.select("doc_id", "n_shingles", "i", "x", F.posexplode("right").alias("j", "y"))
            .select(F.xxhash64("i", "j", "x", "y").alias("key"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n")))
    live = materialise(shared_buckets(rows), "buckets")
    need = live.select(F.col("id").alias("doc_id")).distinct()
    sets = materialise(shingle_sets(own.join(need, "doc_id", "left_semi"), shingle_words), "sets")
    live = live.join(sets.select("id", "sketch"), "id").select("key", "id", F.struct("n", "sketch").alias("n"))

    def fits(x, y):
        """Sizes that allow the similarity, and no more differing bits than it allows differing shingles."""
        a, b = x["n"], y["n"]
        return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (
            (100 + percent) * odd_distance(x["sketch"], y["sketch"]) <= (100 - percent) * (a + b))

    def confirm(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("sa", "sb"))
        near = 100 * both >= percent * (F.size("sa") + F.size("sb") - both)
        one, two = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"), sets.select(F.col("id").alias("a_id"), F.col("shingles").alias("sa"))
        return one.join(two, (F.col("a") == F.col("a_id")) & near)

    comp = bucket_components(live, fits, confirm)
    named = first.join(comp.toDF("doc_id", "comp"), "doc_id").select("set_id", "comp")
    lone = F.when(F.col("set_id").isNull(), F.col("doc_id"))
    component = F.coalesce("comp", "first_id", lone)
    return (signed.select("doc_id", "n_shingles", "set_id")
            .join(first.toDF("set_id", "first_id"), "set_id", "left").join(named, "set_id", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept")))
