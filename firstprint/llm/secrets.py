"""Secret scan: fixed patterns, plus strings that a character Markov model of random strings explains better."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstprint.llm.common import texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The base patterns, in the order in which spans at one place are listed: kind, pattern, the group that holds the secret,
#: the shortest secret, and lower-case words of which a text must hold one to match at all.
BASE = [
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
     ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    ("hex", r"[0-9a-f]+", 0, 24, ()),
]
KINDS = [kind for kind, *_ in BASE] + ["random"]
#: Strings the models look at, and the shortest of them that can be reported.
STRINGS, SHORTEST = r"[A-Za-z0-9+/_=-]{8,}", 20
#: Symbols of the models: the characters of STRINGS, and 0 for the start of a string.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SYMBOLS = len(ALPHABET) + 1
#: A string is reported from this mean log-likelihood ratio a character on.
PER_CHAR = 0.75
#: Weight, in occurrences, of the single-symbol frequencies in the odds of what follows a symbol.
BACK_OFF = 4.0

_CODE = np.zeros(256, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(1, SYMBOLS)


def base_spans(text: str, rules: list) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the secret itself) of each match of the base patterns that is long enough."""
    out, low = [], text.lower()
    for number, (pattern, group, shortest, words) in enumerate(rules):
        if words and not any(w in low for w in words):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= shortest:
                out.append((m.start(), number, m.end(), m.start(group)))
    return out


def compiled() -> list:
    # [0-9a-f]+ of 24 and more is the same as [0-9a-f]{24,}: runs are maximal, short ones are dropped
    return [(re.compile(p if kind != "hex" else rf"[0-9a-f]{{{least},}}"), g, least, w) for kind, p, g, least, w in BASE]


def pair_codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol pairs of all strings, each led by the start symbol, and where each string begins among them."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    codes = _CODE[np.frombuffer("".join(strings).encode("latin-1", "replace"), np.uint8)]
    begins = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64) if len(strings) else np.empty(0, np.int64)
    before = np.r_[0, codes[:-1]] if len(codes) else codes
    before[begins] = 0
    return before * SYMBOLS + codes, begins


def ordinary(text: str, spans: list, find, shortest: int = 0) -> Iterator[tuple[int, str]]:
    """(start, string) of the strings of a text that no base span touches."""
    taken = sorted((a, b) for a, _, b, _ in spans)
    at = 0
    for m in find(text):
        a, b = m.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if b - a >= shortest and not (at < len(taken) and taken[at][0] < b):
            yield a, m.group()


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log-likelihood ratio (random over ordinary) of each symbol pair, from all documents.

    The labelled samples: what a base pattern found is a random string, every other string of eight or more
    characters is ordinary. Each task sends one table of counts. Rare pairs back off to how frequent a symbol is
    alone, and without any sample of a kind its model is uniform. Random strings may use symbols that no sample has: their model is mixed
    evenly with the uniform one.
    """
    cells = SYMBOLS * SYMBOLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, find, counts = compiled(), re.compile(STRINGS).finditer, np.zeros((2, cells), np.int64)
        for batch in batches:
            secret, plain = [], []
            for text in batch["text"].to_pylist():
                if text:
                    spans = base_spans(text, rules)
                    secret += [text[s:b] for _, _, b, s in spans]
                    plain += [s for _, s in ordinary(text, spans, find)]
            for row, strings in enumerate((secret, plain)):
                counts[row] += np.bincount(pair_codes(strings)[0], minlength=cells)
        used = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])],
                                         ["cell", "secret", "plain"])

    found = (texts(docs, id_col, text_col).select("text").mapInArrow(run, "cell long, secret long, plain long")
             .groupBy("cell").agg(F.sum("secret").alias("secret"), F.sum("plain").alias("plain")).collect())  # <= cells rows
    counts = np.zeros((2, SYMBOLS, SYMBOLS))
    for r in found:
        counts[0, r.cell // SYMBOLS, r.cell % SYMBOLS] += r.secret
        counts[1, r.cell // SYMBOLS, r.cell % SYMBOLS] += r.plain
    counts = counts[:, :, 1:]
    single = counts.sum(axis=1, keepdims=True) + 0.5
    single /= single.sum(axis=2, keepdims=True)
    odds = (counts + BACK_OFF * single) / (counts.sum(axis=2, keepdims=True) + BACK_OFF)
    odds[0] = (odds[0] + 1 / (SYMBOLS - 1)) / 2
    logs = np.log(odds)
    ratio = np.zeros((SYMBOLS, SYMBOLS))
    ratio[:, 1:] = logs[0] - logs[1]
    return ratio.ravel()


def find_secrets(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
                 per_char: float = PER_CHAR) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) by start, then kind: one row for each row of ``docs``.

    Base spans are all matches of the base patterns, none is ever taken back. The models add, as kind ``random``,
    each string of at least SHORTEST characters that touches no base span and whose mean log-likelihood ratio
    is at least ``per_char``. Null and empty texts have no spans; null ids and repeated rows come back as they are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, find = compiled(), re.compile(rf"[{re.escape(ALPHABET)}]{{{SHORTEST},}}").finditer
        for batch in batches:
            out = []
            rows, starts, strings = [], [], []
            for row, text in enumerate(batch["text"].to_pylist()):
                spans = base_spans(text, rules) if text else []
                out.append([(a, k, b) for a, k, b, _ in spans])
                for a, s in ordinary(text or "", spans, find, SHORTEST):
                    rows.append(row)
                    starts.append(a)
                    strings.append(s)
            if strings:
                pairs, begins = pair_codes(strings)
                mean = np.add.reduceat(ratio[pairs], begins) / np.fromiter(map(len, strings), np.int64, len(strings))
                for i in np.flatnonzero(mean >= per_char):
                    out[rows[i]].append((starts[i], len(BASE), starts[i] + len(strings[i])))
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(own)] for own in out]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, kind)], ["doc_id", "spans"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans and all spans as text."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = joined(F.filter("spans", lambda s: s["kind"] != "random"))
    return found.select("doc_id", *(count(kind) for kind, *_ in BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"),
                        joined("spans").alias("spans"), count("random"))
