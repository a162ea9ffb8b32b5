"""Toxic spans by a linear-chain conditional random field."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstprint.llm.common import texts
from firstprint.llm.near_dedup import near_duplicates
from firstprint.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled documents of each class that the model is fitted on, the first by a hash of their id. Their whole texts are
#: read in tasks; the driver gets bounded sequences of them: of a document at most MARKED with a toxic token and PLAIN
#: (clean document, toxic document) without, drawn by a hash of the text.
SAMPLE, MARKED, PLAIN = 2500, 8, (24, 3)
#: A feature marks a token as toxic when so many toxic documents have it, this share of all documents that have it is toxic
#: (both classes weighed alike), and chance would mark any such feature with at most this probability.
SEEN, PURE, CHANCE = 3, 0.97, 0.05
#: Weights of hashed token features; features of a token at most; tokens in a training sequence; passes and step of the fit.
BUCKETS, WIDTH, SEQUENCE, PASSES, STEP = 1 << 16, 5, 24, 6, 0.3
#: Partitions of the sampled documents.
PARTS = 32
TOKEN = r"\w+"
_BLOCK = 1 << 20  # padded tokens scored at once


def features(token: str) -> list[str]:
    """Names of what a token is known by: itself, its beginnings and its ending."""
    return ["w" + token, *(f"{n}" + token[:n] for n in (3, 4, 5) if len(token) > n), "e" + token[-3:]]


def hashed(token: str) -> list[int]:
    return [xxhash.xxh3_64_intdigest(f.encode()) % (BUCKETS - 1) + 1 for f in features(token)]


class Crf:
    """Two states (0 clean, 1 toxic). ``emit`` is the log-odds a feature gives state 1, ``step`` scores transitions."""

    def __init__(self, emit: np.ndarray, step: np.ndarray, start: float):
        self.emit, self.step, self.start = emit, step, start

    def passes(self, odds: np.ndarray, mask: np.ndarray):
        """Forward and backward log-odds of state 1 for rows of token odds; masked tokens stand at the end of rows."""
        (t00, t01), (t10, t11) = self.step
        n, width = odds.shape
        forward, backward = np.empty_like(odds), np.zeros_like(odds)
        forward[:, 0] = odds[:, 0] + self.start
        for t in range(1, width):
            r = forward[:, t - 1]
            forward[:, t] = odds[:, t] + np.logaddexp(t01, r + t11) - np.logaddexp(t00, r + t10)
        for t in range(width - 2, -1, -1):
            r = np.where(mask[:, t + 1], backward[:, t + 1] + odds[:, t + 1], 0.0)
            step = np.logaddexp(t10, r + t11) - np.logaddexp(t00, r + t01)
            backward[:, t] = np.where(mask[:, t + 1], step, 0.0)
        return forward, backward

    def marginals(self, odds: np.ndarray, mask: np.ndarray) -> np.ndarray:
        forward, backward = self.passes(odds, mask)
        return np.where(mask, 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500))), 0.0)


class Remembered(dict):
    """Values of a function of a token, remembered while a task runs; forgotten when there are more than 100,000."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, token: str):
        if len(self) > 100_000:
            self.clear()
        value = self[token] = self.of(token)
        return value


def feature_counts(sample: DataFrame) -> DataFrame:
    """feature, n, m: in how many toxic and clean documents of the sample (text, toxic) a feature stands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, counts = re.compile(TOKEN), (Counter(), Counter())

        def told() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[k][f] for f in names], pa.int64()) for k in (1, 0))],
                                             ["feature", "n", "m"])
            for c in counts:
                c.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"].to_pylist(), strict=True):
                counts[toxic].update({f for t in set(token.findall(text.as_py().lower())) for f in features(t)})
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield told()
        yield told()

    parts = sample.select("text", "toxic").mapInArrow(run, "feature string, n long, m long")
    return parts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def token_labels(sample: DataFrame) -> list[str]:
    """The features that mark a token of a toxic document as toxic: next to absent elsewhere, and not so by chance.

    Were a feature no sign of toxicity, its n + m documents would be toxic at the rate of the sample, and n or more of
    them would be with a probability of at most exp(-(n + m) * divergence) (Chernoff). This must stay below CHANCE divided
    by the number of features tried, so rare words are learned as soon as the evidence is there, at any sample size.
    """
    sides = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sides) < 2:
        return []
    tried = materialise(feature_counts(sample).where(f"n >= {SEEN} and left(feature, 1) <> 'e'"), "features")
    rate = sides[1] / (sides[0] + sides[1])
    n, m = F.col("n"), F.col("m")
    evidence = n * F.log(n / ((n + m) * rate)) + F.when(m > 0, m * F.log(m / ((n + m) * (1 - rate)))).otherwise(0.0)
    share = (n / sides[1]) / (n / sides[1] + m / sides[0])
    sure = float(np.log(max(1, tried.count()) / CHANCE))
    return sorted(r.feature for r in tried.where((share >= PURE) & (evidence >= sure)).select("feature").collect())


def sequences(sample: DataFrame, marks: list[str], seed: int = 5) -> list[tuple[bytes, bytes]]:
    """Hashed features (WIDTH a token) and labels of the tokens of the sequences drawn from whole texts, in a fixed order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, known = re.compile(TOKEN), set(marks)
        marked = Remembered(lambda t: not known.isdisjoint(features(t)))

        for batch in batches:
            out: list[tuple] = []
            for text, toxic, digest in zip(batch["text"], batch["toxic"].to_pylist(), batch["digest"].to_pylist(), strict=True):
                tokens = token.findall(text.as_py().lower())
                own = np.fromiter((bool(toxic) and marked[t] for t in tokens), bool, len(tokens))
                if toxic and not own.any():
                    continue  # nothing in it is known to be the cause
                cuts = np.arange(0, len(tokens), SEQUENCE)
                hit = np.array([own[c : c + SEQUENCE].any() for c in cuts], bool)
                rng = np.random.default_rng([seed, int(digest[:16], 16)])
                drawn = [*rng.permutation(cuts[hit])[:MARKED], *rng.permutation(cuts[~hit])[: PLAIN[toxic]]]
                for c in sorted(drawn):
                    x = np.zeros((len(tokens[c : c + SEQUENCE]), WIDTH), np.int32)
                    for row, t in zip(x, tokens[c : c + SEQUENCE], strict=True):
                        at = hashed(t)
                        row[: len(at)] = at
                    out.append((digest, int(c), x.tobytes(), own[c : c + SEQUENCE].astype(np.int8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))],
                                             ["digest", "at", "x", "y"])

    drawn = sample.select("text", "toxic", "digest").mapInArrow(run, "digest string, at long, x binary, y binary")
    rows = drawn.collect()  # at most 2 * SAMPLE * max(sum of MARKED and PLAIN) sequences of SEQUENCE tokens
    return [(bytes(r.x), bytes(r.y)) for r in sorted(rows, key=lambda r: (r.digest, r.at, bytes(r.y)))]


def fit_sequences(rows: list[tuple[bytes, bytes]], seed: int = 5) -> Crf:
    """Fits the chain by gradient ascent (Adagrad) on the likelihood of labelled token sequences."""
    model, rng = Crf(np.zeros(BUCKETS), np.zeros((2, 2)), 0.0), np.random.default_rng(seed)
    if not rows:
        return model
    x, y, mask = np.zeros((len(rows), SEQUENCE, WIDTH), np.int32), np.zeros((len(rows), SEQUENCE)), np.zeros((len(rows), SEQUENCE), bool)
    for i, (tokens, own) in enumerate(rows):
        n = len(own)
        x[i, :n] = np.frombuffer(tokens, np.int32).reshape(n, WIDTH)
        y[i, :n], mask[i, :n] = np.frombuffer(own, np.int8), True
    grad_sq, step_sq, bias_sq = np.full(BUCKETS, 1e-4), np.full((2, 2), 1e-4), 1e-4
    for _ in range(PASSES):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 256)):
            px, py, pm = x[part], y[part], mask[part]
            used = px > 0
            odds = np.where(pm, (model.emit[px] * used).sum(axis=2), 0.0)
            forward, backward = model.passes(odds, pm)
            p = np.where(pm, 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500))), 0.0)
            miss = np.where(pm, py - p, 0.0)
            grad = np.bincount(px.ravel(), (miss[:, :, None] * used).ravel(), BUCKETS) - 1e-3 * model.emit
            # pair marginals: state at t given by forward, state at t + 1 by its odds and backward
            a, b = forward[:, :-1], odds[:, 1:] + backward[:, 1:]
            joint = np.stack([np.zeros_like(a) + model.step[0, 0], b + model.step[0, 1], a + model.step[1, 0], a + b + model.step[1, 1]])
            joint = np.exp(joint - joint.max(axis=0))
            joint /= joint.sum(axis=0)
            linked = pm[:, 1:]
            had, has = py[:, :-1], py[:, 1:]
            truth = np.stack([(1 - had) * (1 - has), (1 - had) * has, had * (1 - has), had * has])
            step = ((truth - joint) * linked).sum(axis=(1, 2)).reshape(2, 2)
            bias = miss[:, 0].sum()
            grad_sq += grad**2
            step_sq += step**2
            bias_sq += bias**2
            model.emit += STEP * grad / np.sqrt(grad_sq)
            model.step += STEP * step / np.sqrt(step_sq)
            model.start += STEP * bias / np.sqrt(bias_sq)
    model.emit[0] = 0.0
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = SAMPLE) -> Crf:
    """A chain fitted on at most ``sample`` labelled documents of each class.

    Labels name documents, not tokens; token labels come from what sets toxic documents apart (`token_labels`).
    Whole texts are read. Rows without a label, id or text are not used; a document labelled twice counts by its larger
    label, an id with several texts by the one of smallest digest, near copies (five words, 0.8) once a class. Without documents of both
    classes, or without a feature that tells them apart, the model scores every text with words 0.5 or less.
    """
    marks = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
             .where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    chosen = [r for toxic in (0, 1) for r in marks.where(F.col("toxic") == toxic)
              .orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample).collect()]  # ids only
    chosen = docs.sparkSession.createDataFrame(chosen or [], "doc_id long, toxic int")
    own = texts(docs, id_col, text_col).where("text <> ''").join(F.broadcast(chosen), "doc_id")  # at most 2 * sample ids
    one = own.groupBy("doc_id").agg(F.min(F.struct(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text", "toxic")).alias("r"))
    distinct = materialise(one.select("doc_id", "r.*").repartition(PARTS, "doc_id"), "sample")
    # near copies are no evidence of their own: one document of each group and class
    groups = near_duplicates(distinct, shingle_words=5, percent=80, side=14).select("doc_id", "component_id")
    first = distinct.join(groups, "doc_id").groupBy("component_id", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    picked = materialise(distinct.join(first, "doc_id", "left_semi").repartition(PARTS, "digest"), "sample")
    return fit_sequences(sequences(picked, token_labels(picked)))


def score(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text", tagged: float = 0.5) -> DataFrame:
    """doc_id, score, spans (code-point offsets of runs of tokens whose marginal is at least ``tagged``): a row for a row.

    Forward-backward over the tokens of the whole text gives the marginal of each; the score is the largest.
    Null or empty texts and texts without words: score 0, no spans. Null ids and repeated rows come back as they are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = re.compile(TOKEN)
        emit = model.emit.tolist()

        class Odds(dict):
            def __missing__(self, word: str) -> float:
                if len(self) > 500_000:
                    self.clear()
                value = self[word] = sum(emit[i] for i in hashed(word))
                return value

        known = Odds()
        for batch in batches:
            rows = batch["text"].to_pylist()
            odds = [np.fromiter(map(known.__getitem__, token.findall(text.lower())), np.float64) if text else np.empty(0) for text in rows]
            lengths = np.array([len(x) for x in odds])
            scores, hits = np.zeros(len(rows)), {}
            order = np.argsort(lengths, kind="stable")[::-1]
            order = order[lengths[order] > 0]
            while len(order):
                width = lengths[order[0]]
                part, order = order[: max(1, _BLOCK // width)], order[max(1, _BLOCK // width) :]
                block, mask = np.zeros((len(part), width)), np.arange(width) < lengths[part][:, None]
                block[mask] = np.concatenate([odds[i] for i in part])
                p = model.marginals(block, mask)
                scores[part] = p.max(axis=1)
                for k in np.flatnonzero(scores[part] >= tagged):
                    hits[part[k]] = np.flatnonzero(p[k] >= tagged)
            spans = []
            for i in range(len(rows)):
                own = []
                if i in hits:
                    at, low = [m.span() for m in token.finditer(rows[i])], set(hits[i].tolist())
                    if len(at) != lengths[i]:  # lower-casing changed the tokens: offsets of the lower-cased text
                        at = [m.span() for m in token.finditer(rows[i].lower())]
                    for k in sorted(low):
                        if own and k - 1 in low:
                            own[-1]["end"] = at[k][1]
                        else:
                            own.append({"start": at[k][0], "end": at[k][1]})
                spans.append(own)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int>>")
