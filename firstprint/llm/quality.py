"""Quality filter by importance resampling with hashed n-gram models."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstprint.llm.common import Words, grams, plus
from firstprint.operators.ordering import global_position
from firstprint.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Buckets of the hashed n-gram models, and the longest n-gram (words).
BUCKETS, LONGEST = 10_000, 2
#: Share of the target documents that may score below the cut that sets the size of the sample.
LOSS = 0.0005
#: Most labelled ids that are broadcast to mark target documents (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def buckets(text: str | None, words: Words) -> np.ndarray:
    """The bucket of each word and each run of up to LONGEST words; A-Z count as a-z."""
    own = words.of((text or "").encode().lower().split())
    parts = [grams(own, n, seed=31) for n in range(1, LONGEST + 1) if len(own) >= n]
    return (np.concatenate(parts) % np.uint64(BUCKETS)).astype(np.int64) if parts else np.empty(0, np.int64)


def importance(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """log p_target - log p_raw of each bucket: target are the documents labelled 1, raw are all documents.

    Counts cover every document; one is added to each bucket. A document labelled twice is a target if one label is 1.
    Without target documents the ratio is 0 everywhere.
    """
    good = (labels.where(F.col(label_col).cast("int") == 1).select(F.col(id_col).cast("long").alias("good_id"))
            .where("good_id is not null").distinct())
    good = materialise(good, "targets")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    side = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    marked = own.join(side, own["doc_id"] == side["good_id"], "left").select("text", F.col("good_id").isNotNull().alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, target in zip(batch["text"].to_pylist(), batch["target"].to_pylist(), strict=True):
                own = np.bincount(buckets(text, words), minlength=BUCKETS)
                counts[0] += own
                if target:
                    counts[1] += own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(counts[0]), pa.array(counts[1])], ["bucket", "raw", "target"])

    sums = marked.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in sums.collect():  # BUCKETS rows
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if target.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def with_scores(docs: DataFrame, ratio: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with n_grams and log_weight, the sum of the log ratio over the n-grams of the whole text; null text: 0 and 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            sizes, weights = [], []
            for text in batch[text_col]:  # a text at a time: a batch may hold long ones
                own = buckets(text.as_py(), words)
                sizes.append(len(own))
                weights.append(float(ratio[own].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(weights, pa.float64())],
                                             [*batch.schema.names, "n_grams", "log_weight"])

    if clash := {"n_grams", "log_weight"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist")
    return docs.mapInArrow(run, plus(docs.schema, n_grams="long", log_weight="double"))


def gumbel(id_col: str, seed: int) -> Column:
    """Standard Gumbel noise, drawn from a hash of the id: the same in each run and however the rows are dealt."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("long"), F.lit(seed)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def threshold(scored: DataFrame, k: int) -> float:
    """The ``k``-th largest sample_key, over an exact distributed order."""
    if k <= 0:
        return float("inf")
    placed = global_position(scored.select((-F.col("sample_key")).alias("at")), ["at"])
    row = placed.where(F.col("pos") == k - 1).first()
    return float("-inf") if row is None else -row["at"]


def sample_size(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", loss: float = LOSS) -> int:
    """How many documents weigh at least as much as all but ``loss`` of the target documents do; all, without targets."""
    good = labels.where(F.col(label_col).cast("int") == 1).select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    cut = scored.join(good, "doc_id", "left_semi").agg(F.percentile_approx("log_weight", loss, 100_000)).first()[0]
    return scored.count() if cut is None else scored.where(F.col("log_weight") >= cut).count()


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             k: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(scores, kept): doc_id, n_grams, log_weight, sample_key, selected for each row; and the rows of ``docs`` that are selected.

    Gumbel top-k draws k documents without replacement with odds by their importance weight: the k largest
    log_weight + noise are selected, ties at the edge included. Without ``k`` the sample is as large as `sample_size` says,
    so documents like the targets stay and those that the target model finds far less likely than the raw one go.

    Null and empty texts weigh 1 (log 0). Null ids share one draw. Repeated rows share theirs. An empty table gives none.
    """
    ratio = importance(docs, labels, id_col, text_col, label_col)
    key = (F.col("log_weight") + gumbel(id_col, seed)).alias("sample_key")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = materialise(with_scores(slim, ratio).select("doc_id", "n_grams", "log_weight", (F.col("log_weight") + gumbel("doc_id", seed)).alias("sample_key")), "scores")
    least = threshold(scored, sample_size(scored, labels, id_col, label_col) if k is None else k)
    scores = scored.withColumn("selected", F.col("sample_key") >= least)
    kept = with_scores(docs, ratio, text_col).where(key >= least).select(*docs.columns)
    return scores, kept
