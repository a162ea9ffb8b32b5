"""Near-duplicate lines by a segment-partition edit-distance join."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstprint.llm.common import bucket_components, hash_filter, lists, mixed, odd_distance, odd_sketch, passes, put, shared_buckets, texts
from firstprint.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Edits up to which two lines are near copies, and the shortest lines (code points) for which that is asked; shorter lines
#: are duplicates only of equal lines.
EDITS, SHORTEST = 2, 40
_PAIRS_AT_ONCE = 8192
#: Most bits of the filter of lines that share a bucket (32 MB), which is sent to the tasks.
FILTER_BITS = 28


def probes(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, width) of all substrings of a line that are looked up or indexed.

    A line is cut into edits + 1 segments; if a line of l <= length code points is within ``edits``, one of its
    segments occurs unchanged. Starts follow the multi-match-aware bounds: for segment i, at most i edits to its
    left and edits - i to its right. The line's own segments are those with l = length and no shift.
    """
    out = []
    for size in range(max(edits + 1, length - edits), length + 1):
        gap, base, longer = length - size, size // (edits + 1), size % (edits + 1)
        start = 0
        for i in range(edits + 1):
            width = base + (i >= edits + 1 - longer)
            low = max(0, start - i, start + gap - (edits - i))
            high = min(length - width, start + i, start + gap + (edits - i))
            out += [(size, i, at, width) for at in range(low, high + 1)]
            start += width
    return out


def digest(line: str) -> bytes:
    return hashlib.blake2b(line.encode(), digest_size=16).digest()


def short(marks: list[bytes]) -> np.ndarray:
    """The first eight bytes of digests, as whole numbers. What shares a bucket is named by these; lines keep the whole digest."""
    return np.frombuffer(b"".join(m[:8] for m in marks), np.int64)


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 0), id (digest of the text), n (code points) of all lines that are not blank."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, marks, sizes = [], [], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for k, line in enumerate((text or "").split("\n")):
                    if line.strip():
                        ids.append(doc)
                        at.append(k)
                        marks.append(digest(line))
                        sizes.append(len(line))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(marks, pa.binary()),
                                              pa.array(sizes, pa.int64())], ["doc_id", "line", "id", "n"])

    return docs.mapInArrow(run, "doc_id long, line int, id binary, n long")


def keys(docs: DataFrame, edits: int, shortest: int) -> DataFrame:
    """key, id, n: the segments and probes of each line, as hashes of (indexed length, segment, content); id is short, n plays no part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, list] = {}
        seen: set[bytes] = set()
        for batch in batches:
            marks, found, repeats = [], [], []
            for text in batch["text"].to_pylist():
                for line in (text or "").split("\n"):
                    if len(line) < shortest or not line.strip():
                        continue
                    mark = digest(line)
                    if mark in seen:  # a copy met before in this task says nothing new
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(mark)
                    plan = plans.get(len(line))
                    if plan is None:
                        plan = plans[len(line)] = probes(len(line), edits)
                    marks.append(mark)
                    repeats.append(len(plan))
                    found += [xxhash.xxh3_64_intdigest(line[at : at + width].encode(), size << 8 | i) for size, i, at, width in plan]
            own = np.repeat(short(marks), repeats)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.uint64).view(np.int64)), pa.array(own), pa.nulls(len(own), pa.int8())],
                                             ["key", "id", "n"])

    return docs.mapInArrow(run, "key long, id long, n byte")


def within(left: list[str], right: list[str], edits: int) -> np.ndarray:
    """Which pairs are at most ``edits`` edits apart: a band of 2 * edits + 1 diagonals as bits, all pairs in step.

    Bit b of row state k says that the prefixes i and i + b - edits can be matched with at most k edits; matches move
    a bit along its diagonal, an edit spreads it to its neighbours.
    """
    n = len(left)
    a_len = np.fromiter(map(len, left), np.int64, n)
    b_len = np.fromiter(map(len, right), np.int64, n)
    gap = b_len - a_len
    width = 2 * edits + 1
    out = np.abs(gap) <= edits
    if not n or not out.any():
        return out
    top = int(a_len.max())
    a = np.zeros((top, n), np.uint32)
    b = np.zeros((top + width + 1, n), np.uint32)
    for k in np.flatnonzero(out):
        a[: a_len[k], k] = np.frombuffer(left[k].encode("utf-32-le"), np.uint32)
        b[edits : edits + b_len[k], k] = np.frombuffer(right[k].encode("utf-32-le"), np.uint32)[: top + width + 1 - edits]
    full = np.uint64((1 << width) - 1)
    one = np.uint64(1)
    state = [np.full(n, np.uint64(((1 << (k + 1)) - 1) << edits) & full) for k in range(edits + 1)]  # after no code point of a: insertions only
    result = np.zeros(n, bool)
    goal = one << np.where(out, gap + edits, 0).astype(np.uint64)
    for i in range(top + 1):
        done = a_len == i
        if done.any():
            result[done] = (state[edits][done] & goal[done]) > 0
        if i == top:
            break
        same = np.zeros(n, np.uint64)
        for d in range(width):
            same |= (a[i] == b[i + d]).astype(np.uint64) << np.uint64(d)
        fresh = []
        for k in range(edits + 1):
            now = state[k] & same
            if k:
                now |= state[k - 1]  # substitution
                now |= state[k - 1] >> one  # a code point of a is dropped
                now |= (fresh[k - 1] << one) & full  # one of b is put in
            fresh.append(now)
        state = fresh
    return result & out


def letter_pairs(line: str) -> np.ndarray:
    """Odd sketch of the pairs of neighbouring code points, each as often as it occurs."""
    code = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return odd_sketch(mixed(code[:-1] << np.uint64(32) | code[1:]))


def near_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """(id, comp): lines (by digest) that are within ``edits`` of another one, and the smallest digest of their component."""
    live = materialise(shared_buckets(keys(docs, edits, shortest)), "buckets")
    need = materialise(live.select("id").distinct(), "needed")
    # only lines that share a bucket are read again: a filter of bounded size first, the exact join behind it
    sent = docs.sparkSession.sparkContext.broadcast(hash_filter(need.select(F.col("id").alias("hash")), FILTER_BITS))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {digest(x): x for text in batch["text"].to_pylist() for x in (text or "").split("\n") if len(x) >= shortest and x.strip()}
            marks = list(own)
            near = short(marks)
            found = np.flatnonzero(passes(sent.value, near.view(np.uint64)))
            marks = [marks[k] for k in found.tolist()]
            kept = [own[m] for m in marks]
            yield pa.RecordBatch.from_arrays(
                [pa.array(marks, pa.binary()), pa.array(near[found]), pa.array(list(map(len, kept)), pa.int64()), pa.array(kept, pa.string()),
                 lists([letter_pairs(x) for x in kept])], ["id", "short", "n", "line", "sketch"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch["la"].to_pylist(), batch["lb"].to_pylist()
            near = np.zeros(len(left), bool)
            order = np.argsort(np.fromiter(map(len, left), np.int64, len(left)), kind="stable")
            start = 0
            while start < len(order):  # pairs of like length together, a bounded number of code points at a time
                stop = start + 1
                while stop < len(order) and stop - start < _PAIRS_AT_ONCE and (stop - start + 1) * len(left[order[stop]]) < 8 << 20:
                    stop += 1
                part = order[start:stop]
                near[part] = within([left[k] for k in part], [right[k] for k in part], edits)
                start = stop
            yield from pa.Table.from_batches([batch]).select(["a", "b", "ca", "cb"]).filter(pa.array(near)).to_batches()

    found = (docs.select("text").mapInArrow(lines, "id binary, short long, n long, line string, sketch array<long>")
             .join(need.withColumnRenamed("id", "short"), "short", "left_semi"))
    table = materialise(found.groupBy("id").agg(*[F.first(c).alias(c) for c in ("short", "n", "line", "sketch")]), "lines")
    live = (live.select("key", F.col("id").alias("short")).join(table.select("id", "short", "n", "sketch"), "short")
            .select("key", "id", F.struct("n", "sketch").alias("n")))

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(table.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b").join(table.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").select("a", "b", "ca", "cb", "la", "lb")
        return both.mapInArrow(compare, "a binary, b binary, ca binary, cb binary")

    def fits(x, y):
        """Lengths that allow so few edits, and sketches of code point pairs: an edit takes two away and adds two at most."""
        return (F.abs(x["n"] - y["n"]) <= edits) & (odd_distance(x["sketch"], y["sketch"]) <= 4 * edits)

    return bucket_components(live, fits, confirm)


def removed_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, drop (sorted line numbers): all lines but the first (by doc_id, line) of each class of near-equal lines."""
    occurrences = materialise(line_table(docs), "occurrences")
    comp = near_lines(docs, edits, shortest)
    named = occurrences.join(comp, "id", "left").select("doc_id", "line", F.coalesce("comp", "id").alias("comp"))
    place = F.struct("doc_id", "line")
    # written, so that the join back has a shuffle of its own on both sides, which Spark splits where a common line is hot
    first = materialise(named.groupBy("comp").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").select("comp", "first"), "first")
    later = named.join(first, "comp").where(place != F.col("first"))
    return later.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with columns n_lines, n_removed added and the text without its repeated lines; n_chars follows, if there.

    Lines are separated by line feeds. Two lines are near copies when they are at most ``edits`` insertions, deletions
    or substitutions of code points apart and both have at least ``shortest`` code points; equal lines are copies at any
    length. Lines linked so (directly or over others) form a class; its first line by (doc_id, line number) stays,
    all others go, within a document too. Blank lines stay.

    Null text stays null (no lines). Rows with a null id stay as they are. Repeated rows: the rows of one id
    are treated alike. An empty table gives none. Columns named n_lines or n_removed are an error, all others go along.
    """
    if clash := {"n_lines", "n_removed"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist")
    own = texts(docs, id_col, text_col).where("doc_id is not null and text is not null")
    drop = removed_lines(own, edits, shortest).select(F.col("doc_id").alias("_line_dedup_id"), F.col("drop").alias("_line_dedup_drop"))
    gone, lines = F.col("_line_dedup_drop"), F.split(text_col, "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains(gone, i), F.lit(False)))
    text = F.when(gone.isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    joined = docs.join(drop, F.col(id_col).cast("long") == F.col("_line_dedup_id"), "left").drop("_line_dedup_id")
    counted = joined.withColumns({"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"),
                                  "n_removed": F.coalesce(F.greatest(F.size(gone), F.lit(0)), F.lit(0)).cast("long"), text_col: text})
    return put(counted.drop("_line_dedup_drop"), n_chars=F.length(text_col))
