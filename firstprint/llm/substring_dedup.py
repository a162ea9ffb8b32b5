"""Removal of repeated passages by FM-indexes over shards of the corpus."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstprint.llm.common import Words, grams, texts
from firstprint.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of the anchor that decides a window's shard, and the most windows in one segment.
ANCHOR, RUN = 12, 48


# ---------------------------------------------------------------- index of one shard

class WaveletTree:
    """Balanced wavelet tree over symbols below 2 ** bits, as one bit vector with rank counts a level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        current = symbols.astype(np.int64)
        for level in range(bits - 1, -1, -1):
            bit = (current >> level & 1).astype(np.uint8)
            words = np.zeros((len(bit) >> 6) + 1, np.uint64)
            packed = np.packbits(bit, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.r_[0, np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)]
            zeros = len(bit) - int(bit.sum())
            self.levels.append((words, before, zeros))
            current = np.r_[current[bit == 0], current[bit == 1]]  # stable by this bit: the matrix form

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position, for arrays of both."""
        low, high = np.zeros_like(at), at.copy()
        for level, (words, before, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            def ones(p):
                word, bit = p >> 6, (p & 63).astype(np.uint64)
                return before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)  # noqa: B023
            one = (symbols >> level & 1).astype(bool)
            a, b = ones(low), ones(high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low


class FmIndex:
    """FM-index of word sequences, each ended by a separator; the transform is kept in a wavelet tree."""

    def __init__(self, symbols: np.ndarray, depth: int):
        """``symbols``: words from 2 on, 1 behind each sequence, 0 at the very end. Suffixes are told apart up to ``depth``."""
        n = len(symbols)
        rank, width = symbols.astype(np.int64), 1
        while True:  # prefix doubling
            key = rank * (int(rank.max()) + 2) + np.r_[rank[width:] + 1, np.zeros(min(width, n), np.int64)][:n]
            order = np.argsort(key, kind="stable")
            change = np.r_[False, key[order][1:] != key[order][:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(change)
            width *= 2
            if width >= depth and (width >= 2 * depth or rank[order[-1]] == n - 1):
                break
        self.order = order
        bits = max(1, int(symbols.max()).bit_length())
        self.tree = WaveletTree(symbols[order - 1], bits)
        self.first = np.r_[0, np.cumsum(np.bincount(symbols, minlength=1 << bits))]

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the suffix ranges of symbol + pattern, from those of the patterns."""
        return self.first[symbols] + self.tree.rank(symbols, low), self.first[symbols] + self.tree.rank(symbols, high)


def first_owners(segments: list[np.ndarray], owners: np.ndarray, window: int) -> list[np.ndarray]:
    """For each window of each segment, the smallest owner among the segments of this shard that hold it.

    One index over all segments; every segment is then streamed against it from its end, all of them in step.
    A backward step adds the word in front; the range of a match that has grown beyond the threshold is widened to the
    range of its first ``window`` words, so the state is the matching statistic cut at the threshold.
    """
    lengths = np.array([len(s) for s in segments])
    vocabulary, flat = np.unique(np.concatenate(segments), return_inverse=True)
    ends = np.cumsum(lengths)
    symbols = np.ones(len(flat) + len(segments) + 1, np.int64)
    places = np.arange(len(flat)) + np.repeat(np.arange(len(segments)), lengths)
    symbols[places] = flat + 2
    symbols[-1] = 0
    index = FmIndex(symbols, window)
    n = len(symbols)
    # the owner and the words left in its segment, of each suffix in order
    owner, left = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    owner[places] = np.repeat(owners, lengths)
    left[places] = np.repeat(ends, lengths) - np.arange(len(flat))
    owner, left = owner[index.order], left[index.order]
    # groups of suffixes that share their first `window` words
    text = np.r_[symbols, np.zeros(window, np.int64)]
    power = np.uint64(0x9E3779B97F4A7C15)
    code = np.zeros(n, np.uint64)
    for i in range(window):
        code = code * power + (text[i : i + n].astype(np.uint64) + np.uint64(0x632BE5AB)) * np.uint64(0xD6E8FEB86659FD93)
    code = code[index.order]
    opens = np.r_[True, (code[1:] != code[:-1]) | (left[1:] < window)]
    group = np.cumsum(opens) - 1
    starts = np.flatnonzero(opens)
    stops = np.r_[starts[1:], n]
    smallest = np.minimum.reduceat(owner, starts)
    out = [np.empty(max(0, m - window + 1), np.int64) for m in lengths]
    by_length = np.argsort(-lengths, kind="stable")
    begins = ends - lengths
    low, high = np.zeros(len(segments), np.int64), np.full(len(segments), n, np.int64)
    for step in range(int(lengths.max())):
        live = by_length[: np.searchsorted(-lengths[by_length], -step, "left")]  # segments longer than step
        at = lengths[live] - 1 - step
        low[live], high[live] = index.extend(flat[begins[live] + at] + 2, low[live], high[live])
        if step + 1 >= window:  # every live segment matches at least `window` words here: its own
            found = group[low[live]]
            low[live], high[live] = starts[found], stops[found]
            for s, a, o in zip(live.tolist(), at.tolist(), smallest[found].tolist(), strict=True):
                out[s][a] = o
    return out


# ---------------------------------------------------------------- the operator

def anchors(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, anchor, start, windows: runs of windows (all of a document's) whose smallest ANCHOR-word hash is the same."""
    size = min(ANCHOR, window)
    span = window - size + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ids, keys, starts, counts = [], [], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                tokens = (text or "").encode().split()
                if len(tokens) < window:
                    continue
                low, reach = grams(words.of(tokens), size), 1
                while reach < span:  # sliding minimum by doubling
                    step = min(reach, span - reach)
                    low = np.minimum(low[:-step], low[step:])
                    reach += step
                change = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
                cuts = np.unique(np.concatenate([change, np.concatenate([np.arange(a, b, RUN) for a, b in zip(change, np.r_[change[1:], len(low)], strict=True)])]))
                ids.append(np.full(len(cuts), doc))
                keys.append(low[cuts])
                starts.append(cuts)
                counts.append(np.diff(np.r_[cuts, len(low)]))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(keys).view(np.int64)),
                     pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate(counts), pa.int32())],
                    ["doc_id", "anchor", "start", "windows"])

    return docs.mapInArrow(run, "doc_id long, anchor long, start int, windows int")


def segments(docs: DataFrame, window: int) -> DataFrame:
    """From doc_id, text, runs (anchor, start, windows): a row for each run, with the hashes of its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ids, keys, starts, own = [], [], [], []
            for doc, text, runs in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["runs"].to_pylist(), strict=True):
                tokens = words.of(text.encode().split()).view(np.int64)
                for r in runs:
                    ids.append(doc)
                    keys.append(r["anchor"])
                    starts.append(r["start"])
                    own.append(tokens[r["start"] : r["start"] + r["windows"] + window - 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(starts, pa.int32()),
                                              pa.array(own, pa.binary())], ["doc_id", "anchor", "start", "words"])

    return docs.mapInArrow(run, "doc_id long, anchor long, start int, words binary")


def repeated_words(own: DataFrame, window: int) -> DataFrame:
    """doc_id, at: the sorted starts of the windows of a document that also start in one with a smaller doc_id."""
    spark = own.sparkSession
    runs = materialise(anchors(own, window), "anchors")
    twice = (runs.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"))
    again = runs.join(twice, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("runs"))
    pieces = materialise(segments(own.join(again, "doc_id"), window), "segments")
    # equal segments meet the index once, with their smallest owner
    classes = (pieces.groupBy("anchor", "words").agg(F.min("doc_id").alias("owner"))
               .select("anchor", "words", "owner", F.xxhash64("words").alias("piece")))
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 4

    def index(frame: pd.DataFrame) -> pd.DataFrame:
        words = [np.frombuffer(w, np.int64) for w in frame["words"]]
        firsts = first_owners(words, frame["owner"].to_numpy(np.int64), window)
        return pd.DataFrame({"anchor": frame["anchor"], "piece": frame["piece"], "firsts": [f.tolist() for f in firsts]})

    firsts = (classes.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard")
              .applyInPandas(index, "anchor long, piece long, firsts array<long>"))
    hits = pieces.select("doc_id", "start", "anchor", F.xxhash64("words").alias("piece")).join(firsts, ["anchor", "piece"])
    later = F.filter(F.transform("firsts", lambda f, i: F.when(f < F.col("doc_id"), F.col("start") + i)), lambda p: p.isNotNull())
    hits = hits.select("doc_id", later.alias("at")).where(F.size("at") > 0)
    return hits.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: a row for each row of ``docs``.

    A word goes when a window of ``window`` consecutive words covers it whose word sequence also starts in a
    document with a smaller doc_id, judged on the input; repeats inside one document stay. Words are separated by ASCII
    white space; the kept ones are joined by one space.

    Windows are dealt to shards by their anchor (the smallest hash of ANCHOR words in them), so equal windows meet in one
    shard; only anchors of several documents go on, as segments of words. Each shard gets an FM-index.

    Null text: no words. Null id: nothing is removed, and nothing of others for its sake. Repeated rows (one id, one
    text) come back each, alike; a document never repeats itself. Other columns play no part.
    """
    own = texts(docs, id_col, text_col)
    cuts = repeated_words(own.where("doc_id is not null"), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, removed, kept = [], [], []
            for text, at in zip(batch["text"].to_pylist(), batch["at"].to_pylist(), strict=True):
                tokens = (text or "").encode().split()
                keep = np.ones(len(tokens), bool)
                if at:
                    edge = np.zeros(len(tokens) + 1, np.int64)
                    at = np.unique(at)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                words.append(len(tokens))
                removed.append(int((~keep).sum()))
                kept.append(b" ".join(t for t, k in zip(tokens, keep.tolist(), strict=True) if k) if at is not None else b" ".join(tokens))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return own.join(cuts, "doc_id", "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
