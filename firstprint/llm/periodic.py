"""Periodic runs of words by string synchronising sets at dyadic scales."""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstprint.llm.common import mixed, odd_constants, texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A run spans at least this many periods. The method below needs four: a smaller factor would lose runs.
EXPONENT = 4
#: Documents are worked on together up to so many words; a longer one is worked on alone, as a whole.
WORDS_AT_ONCE = 1 << 17
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values, by doubling."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        x = np.minimum(x[:-step], x[step:])
        reach += step
    return x


def synchronising_set(prints: np.ndarray, scale: int, periodic: np.ndarray) -> np.ndarray:
    """Positions chosen by the words that follow them alone: equal stretches of 2 * scale words are chosen alike.

    ``prints`` are hashes of the ``scale`` words from each position on. A position counts when the smallest print of the
    scale + 1 positions from it on is its own or the last one's. Positions in ``periodic`` (what follows has a period of at
    most scale / 4) have no print, which keeps the set sparse; a stretch without members lies in such a region.
    """
    prints = np.where(periodic, _NEVER, prints)
    least = sliding_min(prints, scale + 1)
    ends = len(prints) - scale
    return np.flatnonzero(((least == prints[:ends]) | (least == prints[scale:])) & (least != _NEVER))


def primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] if n > 1 else out


def primitive(x: np.ndarray, start: int, period: int) -> bool:
    """No shorter period holds: the first ``period`` words are not a power of a shorter sequence."""
    return not any(np.array_equal(x[start : start + period], x[start + d : start + d + period]) for d in (period // p for p in primes(period)))


def reach(x: np.ndarray, at: int, period: int, step: int) -> int:
    """How far words ``period`` apart agree from ``at`` on, to the right (step 1) or to the left (step -1); ever longer blocks."""
    own, block, found = len(x) - period, max(16, period), 0
    while True:
        low, high = (at + found, min(own, at + found + block)) if step > 0 else (max(0, at - found - block + 1), at - found + 1)
        if high <= low:
            return found
        differ = np.flatnonzero(x[low:high] != x[low + period : high + period])
        if len(differ):
            return found + (int(differ[0]) if step > 0 else high - low - 1 - int(differ[-1]))
        found += high - low
        block *= 2


def runs_of(x: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of EXPONENT periods or more in sequences laid end to end.

    ``x`` holds the word numbers of the sequences, longest first, with a number of its own (found nowhere else) behind each;
    ``lengths`` are the sequences' lengths. Periods below 4 are found by comparing words directly. For the scales
    t = 4, 8, ...: a run with a period from t to 2t - 1 has a synchronising position among its first t, and the same one again
    a period later, as four periods leave room for both contexts of 2t words. So members of the set with equal contexts
    at such a distance propose the period, and the words themselves decide. Regions with periods up to t / 4, in which
    the set has no members, are runs found at smaller scales.
    """
    found: list[tuple[int, int, int]] = []
    for q in (1, 2, 3):
        same = np.r_[False, x[q:] == x[:-q], False] if len(x) > q else np.zeros(2, bool)
        edges = np.flatnonzero(same[1:] != same[:-1])
        starts, ends = edges[::2], edges[1::2] + q
        long = ends - starts >= EXPONENT * q
        found += [(s, e, q) for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True) if q == 1 or primitive(x, s, q)]
    a, b = odd_constants(2, 77)
    spans = np.cumsum(lengths + 1)
    prints, scale = mixed(x.astype(np.uint64)), 1
    while True:
        # only sequences that have room for a run of this scale
        full = int(np.searchsorted(-lengths, -EXPONENT * scale, "right"))
        size = int(spans[full - 1]) if full else 0
        prints = prints[:size]
        if size <= 2 * scale:
            return found
        double = mixed(prints[:-scale] * a + prints[scale:] * b)  # of 2 * scale words from each position on
        if scale >= 4:
            edge = np.zeros(len(prints) + 1, np.int32)
            for s, e, q in found:
                if EXPONENT * q <= scale <= e - s and s < size:
                    edge[s] += 1
                    edge[e - scale + 1] -= 1
            members = synchronising_set(prints, scale, np.cumsum(edge[:-1]) > 0)
            contexts, proposals, k = double[members], [], 1
            while k < len(members):
                apart = members[k:] - members[:-k]
                if not (apart < 2 * scale).any():
                    break
                hit = (apart >= scale) & (apart < 2 * scale) & (contexts[k:] == contexts[:-k])
                proposals += zip(apart[hit].tolist(), members[:-k][hit].tolist(), strict=True)
                k += 1
            own, last, until = x[:size], 0, 0
            for q, at in sorted(proposals):
                if q == last and at < until:
                    continue  # within the stretch just measured
                right = reach(own, at, q, 1)
                left = reach(own, at - 1, q, -1) if at else 0
                start, end = at - left, at + right + q
                last, until = q, end - q
                if right and end - start >= EXPONENT * q and primitive(own, start, q):
                    found.append((start, end, q))
        prints, scale = double, 2 * scale


def slices(texts_: list[str | None]) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Row numbers and words of rows, together up to WORDS_AT_ONCE words (or one row)."""
    rows, words, n = [], [], 0
    for row, text in enumerate(texts_):
        own = (text or "").encode().split()
        if rows and n + len(own) > WORDS_AT_ONCE:
            yield rows, words
            rows, words, n = [], [], 0
        rows.append(row)
        words.append(own)
        n += len(own)
    if rows:
        yield rows, words


def runs_in(words: list[list[bytes]], shortest: int) -> list[list[tuple[int, int, int]]]:
    """For each sequence its runs as (start, length, period), by start, then period."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(-lengths, kind="stable")
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__  # words are numbered as they come: equal numbers mean equal words
    flat = np.full(int(lengths.sum()) + len(words), -1, np.int64)
    begins = np.cumsum(np.r_[0, lengths[order] + 1])
    for place, row in zip(begins.tolist(), order.tolist()):  # noqa: B905 - one begin more than rows
        own = words[row]
        flat[place : place + len(own)] = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
    gaps = np.flatnonzero(flat < 0)
    flat[gaps] = len(number) + np.arange(len(gaps))
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for s, e, q in runs_of(flat, lengths[order]):
        if e - s >= shortest:
            at = int(np.searchsorted(begins, s, "right")) - 1
            out[order[at]].append((s - int(begins[at]), e - s, q))
    return [sorted(own, key=lambda r: (r[0], r[2])) for own in out]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period), collapsed_text: a row for each row of ``docs``.

    A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
    max(shortest, EXPONENT * q) words that cannot grow at either side. Words are separated by ASCII white space and numbered
    from 0. The collapsed text leaves out what any run has after its first period; words joined by one space.

    Whole texts, each in one task; short ones share the array work. Null and empty texts: no words, no runs, empty collapsed text.
    Null ids and repeated rows come back as they are; an empty table gives none. Other columns play no part, so none can clash.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for rows, words in slices(batch["text"].to_pylist()):
                found, kept = runs_in(words, shortest), []
                for own, runs in zip(words, found, strict=True):
                    if runs:
                        edge = np.zeros(len(own) + 1, np.int64)
                        for start, length, period in runs:
                            edge[start + period] += 1
                            edge[start + length] -= 1
                        own = [w for w, drop in zip(own, np.cumsum(edge[:-1]).tolist(), strict=True) if not drop]
                    kept.append(b" ".join(own))
                listed = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(rows[0], len(rows)), pa.array(list(map(len, words)), pa.int64()), pa.array(listed, kind),
                     pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed_text"])

    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a run written into every tenth text, by h = crc32 of the decimal id and g = h div 10.

    If h % 10 is 0, each word from a = g % n on becomes word a + (i - a) % p of the original, p = 1 + (n - a) div (3 + g % 8).
    Texts without words and rows without an id stay.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(h % 10 == 0, F.lit(False)).alias("plant"),
                       F.floor(h / 10).cast("long").alias("g"))
    parts = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    rows = rows.withColumn("words", F.when(F.col("plant"), parts)).withColumn("n", F.size("words"))
    a = F.col("g") % F.greatest(F.col("n"), F.lit(1))
    rows = rows.withColumn("a", a.cast("int")).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    text = F.array_join(F.transform("words", lambda w, i: F.get("words", at(i))), " ")
    return rows.select("doc_id", F.when(F.col("plant") & (F.col("n") > 0), text).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
                    F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
                    F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"), "n_words"))
