"""The corpus pipeline: quality, repeated lines, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on; all but the last keep the columns of
documents. `run` writes each result as Parquet in the shared folder and reads it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firstprint.llm import byte_bpe, decontamination, quality
from firstprint.llm.common import table
from firstprint.llm.line_dedup import dedup_lines
from firstprint.llm.near_dedup import near_duplicates
from firstprint.session import materialise

#: The rank file of the last stage: a .tiktoken file of the driver, or any that Spark can read.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards the documents labelled good; what is not drawn goes."""
    return quality.resample(docs, table(spark, sf_dir, "labels"))[1]


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that nearly repeat an earlier one go from the texts; no document goes."""
    return dedup_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one with the smallest id stays.

    Documents without words have no shingles, so none of them is a copy; they and rows without an id stay.
    """
    found = near_duplicates(docs, shingle_words=5, percent=80, side=14)
    return docs.join(found.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a twentieth or more go."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.where("contaminated").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, decoded_sha256, intact (the ids decode to the text)."""
    ranks = byte_bpe.load_ranks(spark, RANKS)
    encoded = byte_bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, bytes_to="bytes")
    intact = (F.col("bytes") == F.coalesce("text", F.lit("")).cast("binary")).alias("intact")
    return encoded.select("doc_id", "ids", *byte_bpe.digest_columns(), intact)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: Edit distances, similarity components, sampled models and merges are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
