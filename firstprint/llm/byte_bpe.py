"""Byte-level BPE by a rank queue with a hierarchical bitmap."""

from __future__ import annotations

import base64
import sys
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firstprint.llm.common import lists, plus

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pre-tokens up to this length are remembered in a task, in two generations of so many; longer ones are encoded each time.
REMEMBERED_CHARS, REMEMBERED = 64, 200_000
#: Pairs of tokens whose rank is remembered.
PAIRS = 200_000
#: Characters of text worked on together; a longer text is worked on alone, as a whole.
CHARS_AT_ONCE = 1 << 21
#: Largest rank file that is sent to the executors as a whole.
MAX_RANK_FILE_BYTES = 64 << 20
_RIGHT = 32  # bits of a token id in a pair


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file (base64 token, rank). A local path is read by the driver alone, any other by Spark."""
    if path.startswith("file:") or "://" not in path:
        with open(path.removeprefix("file://"), "rb") as file:
            data = file.read(MAX_RANK_FILE_BYTES + 1)
    else:
        size, = spark.read.format("binaryFile").load(path).select(F.sum("length")).first()
        data = b" " * (MAX_RANK_FILE_BYTES + 1)
        if (size or 0) <= MAX_RANK_FILE_BYTES:
            data = "\n".join(r.value for r in spark.read.text(path).collect()).encode()
    if len(data) > MAX_RANK_FILE_BYTES:
        raise ValueError(f"{path} has more than {MAX_RANK_FILE_BYTES} bytes; ranks are broadcast")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class Encoder:
    """Encodes pre-tokens, many at once, and remembers short ones for a while.

    The pre-tokens of a call are laid end to end, with a barrier between them, and merged by one queue. ``buckets`` has the
    positions that wait for a merge rank, leftmost first; ``marks`` has a bit for each rank in use, in words of 256, and ``top`` a
    bit for each word in use. Find-first-set on ``top`` and then on its word gives the next rank in constant time, however long the
    sequence; positions whose pair has changed since are stale and skipped.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.first_pairs = np.full((256, 256), -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first_pairs[token[0], token[1]] = rank
        self.marks = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        self.buckets: dict[int, list[int]] = {}
        self.pairs: dict[int, int] = {}
        self.fresh: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The token ids of texts given as their pre-tokens."""
        if len(self.fresh) > REMEMBERED:
            self.old, self.fresh = self.fresh, {}
        fresh, old, new = self.fresh, self.old, []
        for piece in set().union(*texts):
            if piece not in fresh:
                known = old.get(piece)
                if known is None:
                    new.append(piece)
                else:
                    fresh[piece] = known
        fresh.update(zip(new, self.merge_all([p.encode() for p in new]), strict=True))
        out = [np.frombuffer(b"".join(map(fresh.__getitem__, text)), "<i4") for text in texts]
        for piece in new:
            if len(piece) > REMEMBERED_CHARS:
                del fresh[piece]
        return out

    def rank_of(self, left: int, right: int) -> int:
        """Rank of the token that two tokens make together; -1 if none. Remembered."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        rank = self.pairs[left << _RIGHT | right] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return rank

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit integers. A piece that is a token as a whole is that token."""
        whole = [self.ranks.get(p) for p in pieces]
        todo = [p for p, rank in zip(pieces, whole, strict=True) if rank is None]
        merged = iter(self._merge(todo))
        return [next(merged) if rank is None else rank.to_bytes(4, "little") for rank in whole]

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8)
        stops = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        codes = self.single[data]
        if len(codes) and codes.min() < 0:
            raise ValueError("a byte has no token")
        first = np.full(len(data), -1, np.int64)
        first[:-1] = self.first_pairs[data[:-1], data[1:]]
        first[stops - 1] = -1  # barriers
        n, buckets, marks, top = len(data), self.buckets, self.marks, 0
        waiting = np.flatnonzero(first >= 0)
        waiting = waiting[np.argsort(first[waiting], kind="stable")]
        ranks, begins = np.unique(first[waiting], return_index=True)
        cuts = [*begins.tolist(), len(waiting)]
        positions = waiting.tolist()
        for k, rank in enumerate(ranks.tolist()):
            buckets[rank] = positions[cuts[k] : cuts[k + 1]]
            marks[rank >> 8] |= 1 << (rank & 255)
            top |= 1 << (rank >> 8)
        ids, waits = codes.tolist(), first.tolist()
        follow = np.arange(1, n + 1)
        follow[stops - 1] = n  # nothing follows in the same piece
        lead = np.arange(-1, n - 1)
        lead[stops[:-1]] = -1
        lead[0] = -1
        after, before = follow.tolist(), lead.tolist()
        known, rank_of = self.pairs.get, self.rank_of
        while top:
            word = (top & -top).bit_length() - 1
            bits = marks[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            bucket, i = buckets[rank], 0
            while i < len(bucket):
                at = bucket[i]
                i += 1
                if waits[at] != rank:
                    continue  # stale: the pair at this position has changed since
                gone = after[at]
                ids[at], follows = rank, after[gone]
                ids[gone] = waits[gone] = waits[at] = -1
                after[at] = follows
                lower = False
                if follows < n:
                    before[follows] = at
                    pair = known(rank << _RIGHT | ids[follows])
                    if pair is None:
                        pair = rank_of(rank, ids[follows])
                    waits[at] = pair
                    if pair >= 0:
                        held = buckets.get(pair)
                        if held is None:
                            buckets[pair] = [at]
                            marks[pair >> 8] |= 1 << (pair & 255)
                            top |= 1 << (pair >> 8)
                        elif pair == rank:
                            insort(held, at, i)
                        elif at < held[-1]:
                            insort(held, at)
                        else:
                            held.append(at)
                        lower = pair < rank
                left = before[at]
                if left >= 0:
                    pair = known(ids[left] << _RIGHT | rank)
                    if pair is None:
                        pair = rank_of(ids[left], rank)
                    waits[left] = pair
                    if pair >= 0:
                        held = buckets.get(pair)
                        if held is None:
                            buckets[pair] = [left]
                            marks[pair >> 8] |= 1 << (pair & 255)
                            top |= 1 << (pair >> 8)
                        elif pair == rank:
                            insort(held, left, i)
                        elif left < held[-1]:
                            insort(held, left)
                        else:
                            held.append(left)
                        lower = lower or pair < rank
                if lower:
                    break  # a merge of lower rank has come up: it goes first
            if i < len(bucket):
                del bucket[:i]
            else:
                del buckets[rank]
                bits = marks[word] & ~(1 << (rank & 255))
                marks[word] = bits
                if not bits:
                    top &= ~(1 << word)
        left_over = np.array(ids, "<i4")
        alive = left_over >= 0
        kept, ends = left_over[alive].tobytes(), (4 * np.cumsum(alive)[stops - 1]).tolist()
        return [kept[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def in_slices(rows: list[str | None]) -> Iterator[list[str]]:
    """Rows that together have up to CHARS_AT_ONCE characters, or one row."""
    held, size = [], 0
    for text in rows:
        text = text or ""
        if held and size + len(text) > CHARS_AT_ONCE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", to: str = "ids", bytes_to: str | None = None) -> DataFrame:
    """``docs`` with a column of token ids: each match of ``pattern`` is merged separately, no special tokens.

    With ``bytes_to`` the ids are decoded again in the same pass, into a binary column of that name (see `decode`).
    Null and empty texts give no ids. Whole texts, however long; a row in, a row out, repeated rows too, all other columns as they
    were; an empty table gives none. A column named as ``to`` or ``bytes_to`` is an error: name another.
    """
    if clash := {to, bytes_to} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist; name others with to= and bytes_to=")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # one rank file, at most MAX_RANK_FILE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split = Encoder(sent.value), regex.compile(pattern).findall
        token = encoder.tokens.__getitem__
        for batch in batches:
            at = 0
            for texts in in_slices(batch[text_col].to_pylist()):
                ids = encoder.ids([split(text) for text in texts])
                part = batch.slice(at, len(texts))
                at += len(texts)
                columns, names = [*part.columns, lists(ids, pa.int32())], [*part.schema.names, to]
                if bytes_to:
                    columns.append(pa.array([b"".join(map(token, own.tolist())) for own in ids], pa.binary()))
                    names.append(bytes_to)
                yield pa.RecordBatch.from_arrays(columns, names)

    added = {to: "array<int>"} | ({bytes_to: "binary"} if bytes_to else {})
    return docs.mapInArrow(run, plus(docs.schema, **added))


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", to: str = "bytes") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for. Null ids give empty bytes; an unknown id is an error.

    A row in, a row out; an empty table gives none. A column named as ``to`` is an error: name another.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {rank: token for token, rank in sent.value.items()}.__getitem__
        for batch in batches:
            column = batch[ids_col]
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            known = column.is_valid().to_numpy(zero_copy_only=False)
            out = [b"".join(map(of, flat[a:b].tolist())) if ok else b"" for a, b, ok in zip(ends[:-1], ends[1:], known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, to])

    if to in encoded.columns:
        raise ValueError(f"column {to} exists; name another with to=")
    return encoded.mapInArrow(run, plus(encoded.schema, **{to: "binary"}))


def digest_columns() -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 from columns ids and bytes."""
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
            F.sha2("bytes", 256).alias("decoded_sha256")]
