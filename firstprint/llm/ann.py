"""Nearest neighbours over learned partitions of a neighbour graph."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstprint.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors on which the partitions are learned, at most: the only ones that the driver holds.
SAMPLE = 8192
#: Vectors of a partition aimed at, and the most partitions.
PARTITION_ROWS, MAX_PARTITIONS = 1024, 256
#: Neighbours in the graph, hidden units, passes and step of the classifier.
GRAPH_K, HIDDEN, PASSES, STEP = 10, 128, 40, 3e-3
#: Share of the graph neighbours that the probed partitions have to hold, among sample vectors held out of the router; sets the number of probes.
COVER = 0.97
#: One vector of the sample in so many is held out.
HELD = 4
#: Rows and queries of one search task.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 1024


def usable(vec: str) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def nearest_rows(a: np.ndarray, b: np.ndarray, k: int, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``a`` the k nearest rows of ``b`` in order, equal distances by ``ids`` (default: position), and exact distances.

    Matrix products of the rows less a common centre give squared distances up to a proven rounding bound. Whatever lies
    within the bounds of the k-th is measured by differences, in slices, so neither rounding nor ties can lose a neighbour.
    """
    k, dim = min(k, len(b)), b.shape[1]
    if not len(a) or not k:
        return np.empty((len(a), k), np.int64), np.empty((len(a), k))
    ids = np.arange(len(b)) if ids is None else ids
    with np.errstate(over="ignore", invalid="ignore"):
        centre = b.mean(axis=0)
        left, right = a - centre, b - centre
        aa, bb = (left * left).sum(axis=1)[:, None], (right * right).sum(axis=1)[None]
        rough = aa + bb - 2 * (left @ right.T)
        # u = eps / 2: centring errs by 2u (|a| + |b|)^2, sums and product by (dim + 3)u, measuring and its root by (dim + 6)u
        bound = (dim + 12) * (np.finfo(np.float64).eps * (np.sqrt(aa) + np.sqrt(bb)) ** 2 + np.finfo(np.float64).tiny)
        last = np.partition(rough + bound, k - 1, axis=1)[:, k - 1 : k]
        i, j = np.nonzero(~(rough - bound > last))  # what is not finite is measured too
        far, step = np.empty(len(i)), max(1, (1 << 21) // dim)
        for start in range(0, len(i), step):
            cut = slice(start, start + step)
            far[cut] = np.sqrt(((a[i[cut]] - b[j[cut]]) ** 2).sum(axis=1))
    order = np.lexsort((ids[j], far, i))
    first = np.searchsorted(i, np.arange(len(a)))[:, None] + np.arange(k)[None]
    return j[order][first], far[order][first]


def balanced(graph: np.ndarray, vectors: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Splits a neighbour graph into ``parts`` parts of nearly equal size with few edges between them.

    Starts from the nearest of ``parts`` drawn vectors, then lets every vertex move to the part of most of its neighbours
    (in both directions), the surest first, while the part has room; what finds none goes to the next best.
    """
    n = len(graph)
    room = int(np.ceil(1.1 * n / parts))
    centres = vectors[rng.choice(n, parts, replace=False)]
    for _ in range(8):
        near = ((vectors[:, None, :] - centres[None]) ** 2).sum(axis=2) if n * parts < 1 << 21 else np.stack([((vectors - c) ** 2).sum(axis=1) for c in centres], axis=1)
        label = fill(-near, room)
        centres = np.stack([vectors[label == p].mean(axis=0) if (label == p).any() else centres[p] for p in range(parts)])
    for _ in range(20):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), label[graph.ravel()]), 1.0)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1.0)
        votes[np.arange(n), label] += 0.5
        moved = fill(votes, room)
        if (moved == label).mean() > 0.999:
            break
        label = moved
    return label


def fill(score: np.ndarray, room: int) -> np.ndarray:
    """Each row's best column, the rows with the clearest preference first, no column more than ``room`` times."""
    n, parts = score.shape
    if parts == 1:
        return np.zeros(n, np.int64)
    top = np.partition(score, parts - 2, axis=1)
    order, ranked = np.argsort(top[:, -2] - top[:, -1], kind="stable"), np.argsort(-score, axis=1, kind="stable")
    label, used = np.empty(n, np.int64), [0] * parts
    for i in order.tolist():
        for p in ranked[i].tolist():
            if used[p] < room:
                label[i] = p
                used[p] += 1
                break
    return label


class Router:
    """A small network from vectors to odds over partitions."""

    def __init__(self, mean, scale, layers):
        self.mean, self.scale, self.layers = mean, scale, layers

    def odds(self, x: np.ndarray) -> np.ndarray:
        (w1, b1), (w2, b2) = self.layers
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    @classmethod
    def fit(cls, x: np.ndarray, soft: np.ndarray, rng: np.random.Generator) -> Router:
        """Cross-entropy against the partitions of each vector and its graph neighbours, by Adam."""
        mean, scale = x.mean(axis=0), x.std() + 1e-9
        z = (x - mean) / scale
        sizes = [x.shape[1], HIDDEN, soft.shape[1]]
        params = [p for a, b in zip(sizes, sizes[1:]) for p in (rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(PASSES):
            for part in np.array_split(rng.permutation(len(z)), max(1, len(z) // 256)):
                w1, b1, w2, b2 = params
                hidden = np.maximum(z[part] @ w1 + b1, 0)
                out = hidden @ w2 + b2
                p = np.exp(out - out.max(axis=1, keepdims=True))
                miss = (p / p.sum(axis=1, keepdims=True) - soft[part]) / len(part)
                back = (miss @ w2.T) * (hidden > 0)
                t += 1
                for i, g in enumerate((z[part].T @ back + 1e-4 * w1, back.sum(axis=0), hidden.T @ miss + 1e-4 * w2, miss.sum(axis=0))):
                    first[i] += 0.1 * (g - first[i])
                    second[i] += 0.001 * (g * g - second[i])
                    params[i] = params[i] - STEP * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
        return cls(mean, scale, [(params[0], params[1]), (params[2], params[3])])


def learn(vectors: DataFrame, parts: int, seed: int = 9) -> tuple[Router, int]:
    """The router and the number of partitions to probe, from at most SAMPLE vectors chosen by a hash of their id.

    The neighbour graph of the sample is made in tasks, a block of vectors against the sample each. It is split
    on the driver. The router is fitted without every HELD-th vector of the sample, and the probes are the fewest that
    hold COVER of the neighbours that these vectors have among themselves: both ends are new to it, as nearly all vectors are.
    """
    picked = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE).select("vec").toPandas()["vec"]
    x = np.array(picked.tolist(), np.float64)
    spark, rng = vectors.sparkSession, np.random.default_rng(seed)
    sent = spark.sparkContext.broadcast(x)  # at most SAMPLE vectors

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sent.value
        for batch in batches:
            rows = batch["id"].to_numpy()
            at, far = nearest_rows(every[rows], every, GRAPH_K + 1)
            far[at == rows[:, None]] = np.inf
            best = np.take_along_axis(at, np.argsort(far, axis=1, kind="stable")[:, :GRAPH_K], axis=1)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(best.tolist(), pa.list_(pa.int64()))], ["id", "near"])

    rows = spark.range(len(x)).repartition(max(1, len(x) // 512)).mapInArrow(block, "id long, near array<long>").toPandas().sort_values("id")
    graph = np.array(rows["near"].tolist(), np.int64)
    label = balanced(graph, x, parts, rng)
    soft = np.zeros((len(x), parts))
    soft[np.arange(len(x)), label] += GRAPH_K / 2
    np.add.at(soft, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 1.0)
    kept = np.arange(len(x)) % HELD != 0  # the sample is in hash order
    router = Router.fit(x[kept], (soft / soft.sum(axis=1, keepdims=True))[kept], rng)
    odds = router.odds(x)
    own, ranked = odds.argmax(axis=1), np.argsort(-odds, axis=1)
    place = np.empty_like(ranked)
    np.put_along_axis(place, ranked, np.arange(parts)[None, :].repeat(len(x), axis=0), axis=1)
    asks, near = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    new = ~kept[asks] & ~kept[near]
    needed = np.sort(place[asks[new], own[near[new]]])
    if not len(needed):
        return router, parts
    return router, int(needed[int(np.ceil(COVER * len(needed))) - 1]) + 1


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest rows found of each row that ``queries`` selects, itself left out.

    Nearness is Euclidean distance in double precision on the vectors as given; ties go to the smaller vec_id. Partitions
    are learned on a bounded sample (`learn`); every vector is indexed in its most probable partition, a query looks into
    the most probable ones and measures all vectors there, in blocks of bounded size. Equal vectors are one entry with
    their k + 1 smallest ids, which is all that any query can need. Queries that find fewer than k (and fewer than
    there are) look into every partition. Up to two partitions' worth of vectors are searched as one, that is exactly.

    Null ids and vectors that are null, empty, zero or hold null or non-finite components take no part; nor do
    vectors of another length than most have. Repeated rows of an id count once. Other columns play no part.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), queries.alias("asks"))
    own = own.where(F.col("vec_id").isNotNull() & usable("vec"))
    sizes = own.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    own = own.where(F.size("vec") == (sizes["dim"] if sizes else 0)).dropDuplicates(["vec_id"])
    own = materialise(own, "vectors")
    by_vec = Window.partitionBy("vec").orderBy("vec_id")
    held = own.withColumn("r", F.row_number().over(by_vec)).where(F.col("r") <= k + 1)
    entries = materialise(held.groupBy("vec").agg(F.min("vec_id").alias("vec_id"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")
    n = entries.count()
    parts = min(MAX_PARTITIONS, n // PARTITION_ROWS)
    if parts < 2:
        router, probes, parts = None, 1, 1
    else:
        router, probes = learn(entries, parts)

    def routed(df: DataFrame, top: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if router is None:
                    best = np.zeros((batch.num_rows, 1), np.int64)
                else:
                    best = np.argsort(-router.odds(np.array(batch["vec"].to_pylist(), np.float64).reshape(batch.num_rows, -1)), axis=1)[:, :top]
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["vec"], pa.array(best.tolist(), pa.list_(pa.int32()))], ["vec_id", "vec", "parts"])

        return df.select("vec_id", "vec").mapInArrow(run, "vec_id long, vec array<double>, parts array<int>")

    index = materialise(routed(entries, 1).select("vec_id", "vec", F.col("parts")[0].alias("part")), "index")
    blocks = index.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("row_blocks"))

    def search(asking: DataFrame, top: int) -> DataFrame:
        asked = routed(asking, top).select("vec_id", "vec", F.explode("parts").alias("part"))
        asked = materialise(asked, "probes")
        counts = asked.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("query_blocks")).join(blocks, "part")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        deal = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(c)).cast("int")
        key = ["part", "rb", "qb"]
        left = asked.join(counts, "part").withColumn("qb", deal("query_blocks")).withColumn("rb", every("row_blocks")).select(*key, "vec_id", "vec")
        right = index.join(counts, "part").withColumn("rb", deal("row_blocks")).withColumn("qb", every("query_blocks")).select(*key, "vec_id", "vec")

        def block(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(r):
                return pd.DataFrame({"query_id": [], "entry": [], "score": []}).astype({"query_id": "int64", "entry": "int64", "score": "float64"})
            rows, ids, out = np.array(r["vec"].tolist(), np.float64), r["vec_id"].to_numpy(), []
            for start in range(0, len(q), 128):
                part = q.iloc[start : start + 128]
                at, far = nearest_rows(np.array(part["vec"].tolist(), np.float64), rows, k + 1, ids)
                out.append(pd.DataFrame({"query_id": np.repeat(part["vec_id"].to_numpy(), at.shape[1]), "entry": ids[at].ravel(), "score": far.ravel()}))
            return pd.concat(out)

        pairs = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(block, "query_id long, entry long, score double")
        named = pairs.join(entries.select(F.col("vec_id").alias("entry"), "ids"), "entry").select("query_id", "score", F.explode("ids").alias("vec_id"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        found = named.where("query_id <> vec_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return materialise(found.select("query_id", "rank", "vec_id", "score"), "found")

    asking = own.where("asks").select("vec_id", "vec")
    found = search(asking, probes)
    if probes < parts:
        all_there = min(k, own.count() - 1)
        short = (asking.join(found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("c")), "vec_id", "left")
                 .where(F.coalesce("c", F.lit(0)) < all_there).select("vec_id", "vec"))
        short = materialise(short, "short")
        if not short.isEmpty():
            found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(search(short, parts))
    return found
