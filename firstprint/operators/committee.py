"""Ridge + nearest-neighbour committee, fitted for many training sets at once.

A *fit* is one training set with one feature subset. Rows carry an integer ``fit`` key (a row may
belong to many fits) and a dense ``vec`` array. Features a fit does not use get scale 0, which
removes them from both the ridge system and the distances.

Ridge is fitted on all rows, and neighbours are looked for among all rows. Up to MODEL_BYTES the training rows go to every task
and the rows to be scored stay where they lie; beyond, tiles of both are dealt to tasks (`with_nearest`). Both ways compare the
same pairs with the same arithmetic, so they give the same scores.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firstprint.session import materialise

# Task functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def feature_vector(features: list[str], log_features=()) -> Column:
    """Dense array of the feature columns; ``log_features`` pass through log1p."""
    return F.array(*[
        (F.log1p(F.col(c)) if c in log_features else F.col(c)).cast("double") for c in features
    ])


def standardised(df: DataFrame, features: list[str], reference: DataFrame | None = None) -> DataFrame:
    """Columns scaled by mean and population deviation of ``reference`` (zero deviation: divide by 1)."""
    stats = (reference if reference is not None else df).agg(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(f"_st_{c}") for c in features
    ])
    scaled = {c: (F.col(c) - F.col(f"_st_{c}.mean")) / F.when(F.col(f"_st_{c}.sd") > 0, F.col(f"_st_{c}.sd")).otherwise(1.0)
              for c in features}
    return df.join(F.broadcast(stats)).withColumns(scaled).drop(*[f"_st_{c}" for c in features])  # one row


# ---- moments and ridge --------------------------------------------------------------------------

@dataclass(frozen=True)
class FitParams:
    """Scaler and ridge solution of one fit; the fits are few and p-sized, so they live on the driver."""

    mean: np.ndarray
    inv_sd: np.ndarray
    coef: np.ndarray
    intercept: float
    n: int


def _second_moments(train: DataFrame, centre: np.ndarray, scale: np.ndarray) -> DataFrame:
    """(fit, i, j, v, lo, hi): sums of products of (1, scaled features, y), one partial per task and fit; at i = j the range of the column."""

    def partials(batches):
        sums: dict = {}
        lows: dict = {}
        highs: dict = {}
        for pdf in batches:
            x = (np.stack(pdf["vec"].to_numpy()) - centre) * scale
            a = np.column_stack([np.ones(len(x)), x, pdf["y"].to_numpy(dtype=float)])
            for fit, at in pdf.groupby("fit").indices.items():
                part = a[at]
                sums[fit] = sums.get(fit, 0.0) + part.T @ part
                lows[fit] = np.minimum(lows.get(fit, np.inf), part.min(axis=0))
                highs[fit] = np.maximum(highs.get(fit, -np.inf), part.max(axis=0))
        for fit, m in sums.items():
            i, j = np.triu_indices(len(m))
            yield pd.DataFrame({"fit": fit, "i": i, "j": j, "v": m[i, j], "lo": lows[fit][i], "hi": highs[fit][j]})

    return (
        train.select("fit", "vec", "y").mapInPandas(partials, "fit bigint, i int, j int, v double, lo double, hi double")
        .groupBy("fit", "i", "j").agg(F.sum("v").alias("v"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )


def fit_ridge(train: DataFrame, width: int, alpha: float = 1000.0, used: dict[int, np.ndarray] | None = None,
              parts: dict[int, list[int]] | None = None) -> dict[int, FitParams]:
    """Ridge on standardised features with a free intercept, for every fit in ``train`` (fit, vec, y).

    One pass collects shift-and-scale constants, a second the second moments of all fits; each
    system is p x p and solved from its sums. ``used`` masks features per fit. Fits that share rows
    need not repeat them: with ``parts`` the ``fit`` column names disjoint pieces, and each fit's
    moments are the sum over its pieces. A feature with one value in all rows of a fit counts for nothing: that is told
    from its range, as the deviation from sums is rounding noise then.
    """
    idx = range(width)
    first = train.select(*[F.get("vec", F.lit(i)).alias(f"x{i}") for i in idx]).agg(
        *[F.avg(f"x{i}").alias(f"m{i}") for i in idx], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in idx]
    ).first()
    centre = np.array([first[f"m{i}"] or 0.0 for i in idx])
    spread = np.array([first[f"s{i}"] or 0.0 for i in idx])
    scale = 1.0 / np.where(spread > 0, spread, 1.0)
    sums: dict[int, np.ndarray] = {}
    lows: dict[int, np.ndarray] = {}
    highs: dict[int, np.ndarray] = {}
    for r in _second_moments(train, centre, scale).toLocalIterator():  # fits x p^2 numbers
        m = sums.setdefault(r["fit"], np.zeros((width + 2, width + 2)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
        if r["i"] == r["j"]:
            lows.setdefault(r["fit"], np.full(width + 2, np.inf))[r["i"]] = r["lo"]
            highs.setdefault(r["fit"], np.full(width + 2, -np.inf))[r["i"]] = r["hi"]
    if parts is not None:
        there = {f: [c for c in pieces if c in sums] for f, pieces in parts.items()}
        lows = {f: np.min([lows[c] for c in own], axis=0) for f, own in there.items() if own}
        highs = {f: np.max([highs[c] for c in own], axis=0) for f, own in there.items() if own}
        sums = {f: sum(sums[c] for c in pieces if c in sums) for f, pieces in parts.items() if any(c in sums for c in pieces)}
    out = {}
    for fit, m in sums.items():
        n = m[0, 0]
        mu, mean_y = m[0, 1:-1] / n, m[0, -1] / n
        cov = m[1:-1, 1:-1] / n - np.outer(mu, mu)
        cross = m[1:-1, -1] / n - mu * mean_y
        sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
        live = (sd > 1e-12) & (highs[fit] > lows[fit])[1:-1]
        if used is not None:
            live = live & used[fit]
        inv = np.where(live, 1.0 / np.where(live, sd, 1.0), 0.0)
        gram = cov * np.outer(inv, inv) * n
        coef = np.linalg.solve(gram + alpha * np.eye(width), cross * inv * n)
        out[fit] = FitParams(centre + mu / scale, inv * scale, coef, mean_y, int(n))
    return out


def _scaled(pdf: pd.DataFrame, params: dict[int, FitParams]) -> np.ndarray:
    x = np.stack(pdf["vec"].to_numpy()).astype(float)
    out = np.empty_like(x)
    for fit, at in pdf.groupby("fit").indices.items():
        out[at] = (x[at] - params[fit].mean) * params[fit].inv_sd
    return out


def apply_ridge(rows: DataFrame, params: dict[int, FitParams]) -> DataFrame:
    """(fit, row_id, z, ridge) for rows (fit, row_id, vec); z is the scaled vector."""

    def score(batches):
        for pdf in batches:
            if len(pdf):
                z = _scaled(pdf, params)
                ridge = np.array([z_i @ params[f].coef + params[f].intercept for z_i, f in zip(z, pdf["fit"])])
                yield pd.DataFrame({"fit": pdf["fit"], "row_id": pdf["row_id"], "z": list(z), "ridge": ridge})

    id_type = rows.schema["row_id"].dataType.simpleString()
    return rows.select("fit", "row_id", "vec").mapInPandas(
        score, f"fit bigint, row_id {id_type}, z array<double>, ridge double")


def scale_rows(rows: DataFrame, params: dict[int, FitParams], keep=("y",)) -> DataFrame:
    def scaled(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf[["fit", "row_id", *keep]].assign(z=list(_scaled(pdf, params)))

    kept = rows.select("fit", "row_id", "vec", *keep)
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("row_id", *keep))
    return kept.mapInPandas(scaled, f"fit bigint, {types}, z array<double>")


# ---- nearest neighbours ----------------------------------------------------------------------------

MODEL_BYTES = 256 << 20  # largest table of training rows that is sent to the tasks
TRAIN_TILE = 65_536      # training rows that one task compares with asked ones, where they are too many to be sent
ASKED_TILE = 32_768      # asked rows of such a task
SLICE = 4_096            # training rows measured at once
BLOCK = 1 << 20          # distances held at once
EXACT = 1 << 20          # numbers of candidate rows held at once when they are measured again
ASKED_ROWS = 16_384      # scorings a task is given, whatever the number of files the rows come from


def drawn(train: DataFrame, most: int) -> DataFrame:
    """``train`` with ``_h``, md5 of row_id: of each fit the ``most`` rows that come first by (_h, row_id); all, if no more.

    Only for callers that ask for a draw. It depends on row ids alone, so it is repeatable, the same however rows are dealt,
    and the draws of nested training sets are nested. A cut on the hash that lets through a few more
    than ``most`` rows of a fit comes before the exact order, so no task sorts a whole fit.
    """
    hashed = train.withColumn("_h", F.md5(F.col("row_id").cast("string")))
    sizes = {r["fit"]: r["n"] for r in train.groupBy("fit").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per fit
    large = {f: n for f, n in sizes.items() if n > most}
    if not large:
        return hashed
    lead, slack = F.substring("_h", 1, 12), 8.0
    while True:
        share = {f: min(1.0, (most + slack * math.sqrt(most)) / n) for f, n in large.items()}
        bar = F.element_at(F.create_map(*[F.lit(x) for f, s in share.items() for x in (f, f"{int(s * (16 ** 12 - 1)):012x}")]), F.col("fit"))
        near = hashed.where(~F.col("fit").isin(*large) | (lead <= bar))
        found = {r["fit"]: r["n"] for r in near.where(F.col("fit").isin(*large)).groupBy("fit").agg(F.count(F.lit(1)).alias("n")).collect()}
        if all(found.get(f, 0) >= most for f in large):
            break
        slack *= 8
    place = F.row_number().over(Window.partitionBy("fit").orderBy("_h", "row_id"))
    return near.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


@dataclass(frozen=True)
class Neighbours:
    """Training rows in row_id order, and which of them each fit uses."""

    rows: np.ndarray
    y: np.ndarray
    members: dict[int, np.ndarray]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=float).reshape(len(column), len(flat) // max(1, len(column)))


def labelled(train: DataFrame, vec: str = "vec", most: int | None = None) -> DataFrame:
    """(row_id, ``vec``, y, fits, _h), written: every row of ``train`` once, whatever its fits; with ``most``, the rows of the draw.

    A row has one vector and one y in all its fits.
    """
    rows = train.select("fit", "row_id", vec, "y")
    rows = rows.withColumn("_h", F.lit(None).cast("string")) if most is None else drawn(rows, most)
    return materialise(rows.groupBy("row_id").agg(
        F.first("_h").alias("_h"), F.first(vec).alias(vec), F.first("y").cast("double").alias("y"),
        F.sort_array(F.collect_set("fit")).alias("fits")), "neighbours")


def model_bytes(rows: DataFrame, vec: str = "vec") -> int:
    return rows.agg(F.sum(8 * (F.size(vec) + F.size("fits")) + 64)).first()[0] or 0


def _sendable(rows: DataFrame, parts: dict[int, list[int]] | None, most: int | None, vec: str, limit: int | None = None) -> Neighbours:
    size, limit = model_bytes(rows, vec), MODEL_BYTES if limit is None else limit
    if size > limit:
        raise ValueError(f"the neighbour model takes {size} bytes, {limit} may be sent")
    table = rows.orderBy("row_id").toArrow()  # at most ``limit`` bytes
    fits = table["fits"].combine_chunks()
    sizes = np.diff(fits.offsets.to_numpy()) if len(table) else np.zeros(0, int)
    place, of = np.repeat(np.arange(len(table)), sizes), fits.flatten().to_numpy(zero_copy_only=False)
    pieces = {int(f): place[of == f] for f in np.unique(of)}
    hashes = None if most is None else np.array(table["_h"].to_pylist(), dtype=object)
    members = {}
    for fit, own in (parts or {f: [f] for f in pieces}).items():
        at = np.concatenate([pieces[c] for c in own if c in pieces] or [np.zeros(0, int)]).astype(int)
        if most is not None and len(at) > most:
            at = at[np.lexsort((at, hashes[at]))[:most]]
        if len(at):
            members[fit] = np.sort(at)
    return Neighbours(_matrix(table[vec]), table["y"].to_numpy(), members)


def neighbour_rows(train: DataFrame, parts: dict[int, list[int]] | None = None, most: int | None = None, limit: int = MODEL_BYTES,
                   vec: str = "vec") -> Neighbours:
    """Collects the neighbour model of ``train`` (fit, row_id, ``vec``, y), which must not take more than ``limit`` bytes.

    With ``parts`` the fit column names disjoint pieces and a fit is made of several. With ``most``, pieces are drawn, and the rows of
    a fit are the first ``most`` of theirs, which is the draw from their union.
    """
    return _sendable(labelled(train, vec, most), parts, most, vec, limit)


def nearest(asked: np.ndarray, rows: np.ndarray, k: int, digits: int, members: np.ndarray | None = None,
            own: FitParams | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``asked`` the k nearest ``rows``: distances rounded to ``digits`` and places, nearest first, ties to the earlier row.

    ``members`` picks rows (places count among them), ``own`` scales them. Where there are fewer than k, or for vectors with NaN, the
    rest is (inf, number of rows). Rows pass in slices, distances of a slice come from a matrix product. In floating point the error of
    such a square is below (p + 4) * 2^-52 * (|a|^2 + |b|^2) for vectors of p numbers. All rows that may reach the k-th distance found
    so far within that, what measuring itself may lose, and rounding, are measured again by differences; so none is lost.
    """
    n, width, unit = len(rows) if members is None else len(members), rows.shape[1], 10.0 ** -digits
    best_d, best_at = np.full((len(asked), k), np.inf), np.full((len(asked), k), n)
    lengths, some = (asked * asked).sum(axis=1), max(1, EXACT // max(1, width))
    for low in range(0, n, SLICE):
        part = rows[low:low + SLICE] if members is None else rows[members[low:low + SLICE]]
        if own is not None:
            part = (part - own.mean) * own.inv_sd
        norms = (part * part).sum(axis=1)
        step = max(1, BLOCK // len(part))
        for s in range(0, len(asked), step):
            q = asked[s:s + step]
            rough = q @ part.T
            rough *= -2.0
            rough += norms
            rough += lengths[s:s + step, None]
            error = (width + 8) * 2.0 ** -50 * (lengths[s:s + step] + np.fmax.reduce(norms))
            reach = (best_d[s:s + step, -1] + unit) ** 2 + error
            hits = rough <= reach[:, None]
            if len(part) > k and np.count_nonzero(hits) > 4 * k * len(q):  # the first slice, or a much nearer one
                kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
                reach = np.fmin(reach, (np.sqrt(np.maximum(kth + error, 0.0)) + unit) ** 2 + error)
                hits = rough <= reach[:, None]
            at, near = np.nonzero(hits)
            if not len(at):
                continue
            d = np.concatenate([np.sqrt(((q[at[i:i + some]] - part[near[i:i + some]]) ** 2).sum(axis=1)) for i in range(0, len(at), some)])
            met = np.unique(at)
            to = np.r_[at, np.repeat(met, k)]
            far = np.r_[np.round(d, digits), best_d[s + met].ravel()]
            place = np.r_[low + near, best_at[s + met].ravel()]
            order = np.lexsort((place, far, to))
            first = order[np.searchsorted(to[order], met)[:, None] + np.arange(k)]
            best_d[s + met], best_at[s + met] = far[first], place[first]
    return best_d, best_at


def _mean_at(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean of ``y`` at the places of each row of ``at`` that exist; NaN where none does."""
    found = at < len(y)
    sums = np.where(found, np.r_[y, 0.0][np.minimum(at, len(y))], 0.0).sum(axis=1)
    return np.where(found.any(axis=1), sums / np.maximum(found.sum(axis=1), 1), np.nan)


def mean_of_nearest(asked: np.ndarray, rows: np.ndarray, y: np.ndarray, k: int, digits: int, members: np.ndarray | None = None,
                    own: FitParams | None = None) -> np.ndarray:
    """Mean y of the k rows nearest to each row of ``asked`` (see `nearest`); of all, where there are fewer."""
    return _mean_at(y if members is None else y[members], nearest(asked, rows, k, digits, members, own)[1])


def _by_key(of: dict, key: str) -> Column:
    """The entry of a few literals for the value of ``key``, null where there is none."""
    values = [F.array(*[F.lit(x).cast("bigint") for x in v]) if isinstance(v, list) else F.lit(v).cast("bigint") for v in of.values()]
    return F.try_element_at(F.create_map(*[x for f, v in zip(of, values) for x in (F.lit(f).cast("bigint"), v)]), F.col(key))


def with_nearest(rows: DataFrame, asked: DataFrame, k: int, digits: int, params: dict[int, FitParams] | None = None,
                 parts: dict[int, list[int]] | None = None, vec: str = "vec") -> DataFrame:
    """``asked`` (fit, ``vec``, any other columns) with knn, the mean y of the k nearest of all ``rows`` (`labelled`); null without any.

    Every fit's asked rows and every piece's training rows are dealt by hash to tiles of about ASKED_TILE and TRAIN_TILE rows; each tile
    of the one meets each tile of the other in a task, and the k nearest of all an asked row's tasks are kept. So a task holds two
    tiles, however many the rows; every pair is compared, which is quadratic, as is the exact answer.
    """
    asked = materialise(asked.withColumn("_ask", F.monotonically_increasing_id()), "asked")
    flat = rows.withColumn("_piece", F.explode("fits")).drop("fits", "_h")
    stored = {r["_piece"]: r["count"] for r in flat.groupBy("_piece").count().collect()}  # one row a piece
    wanted = {r["fit"]: r["count"] for r in asked.groupBy("fit").count().collect()}  # one row a fit
    of = {f: [c for c in own if c in stored] for f, own in (parts or {c: [c] for c in stored}).items() if f in wanted}
    of = {f: own for f, own in of.items() if own}
    if not of:
        return asked.drop("_ask").withColumn("knn", F.lit(None).cast("double"))
    users = {c: [f for f, own in of.items() if c in own] for c in stored}
    users = {c: fits for c, fits in users.items() if fits}
    asked_tiles = {f: -(-wanted[f] // ASKED_TILE) for f in of}
    train_tiles = {c: -(-stored[c] // TRAIN_TILE) for c in users}
    one = F.lit(1).cast("bigint")

    def each(tiles, key):
        return F.explode(F.sequence(0 * one, _by_key(tiles, key) - one))

    left = (asked.select("_ask", "fit", vec, F.explode(_by_key(of, "fit")).alias("_piece"))
            .withColumn("_a", F.pmod(F.xxhash64("_ask"), _by_key(asked_tiles, "fit"))).withColumn("_t", each(train_tiles, "_piece")))
    right = (flat.withColumn("fit", F.explode(_by_key(users, "_piece")))
             .withColumn("_t", F.pmod(F.xxhash64("row_id"), _by_key(train_tiles, "_piece"))).withColumn("_a", each(asked_tiles, "fit")))
    id_type = rows.schema["row_id"].dataType

    def compare(asks: pa.Table, train: pa.Table) -> pa.Table:
        train = train.sort_by("row_id")
        own = params[asks["fit"][0].as_py()] if params is not None and len(asks) else None
        z = _matrix(asks[vec]) if own is None else (_matrix(asks[vec]) - own.mean) * own.inv_sd
        d, at = nearest(z, _matrix(train[vec]), k, digits, own=own)
        found = at < len(train)
        return pa.table({"_ask": np.repeat(asks["_ask"].to_numpy(), found.sum(axis=1)), "d": d[found],
                         "row_id": train["row_id"].take(pa.array(at[found])), "y": train["y"].take(pa.array(at[found]))})

    keys = ["fit", "_piece", "_a", "_t"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        compare, f"_ask bigint, d double, row_id {id_type.simpleString()}, y double")
    best = near.groupBy("_ask").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "row_id", "y"))), 1, k).alias("_near"))
    mean = F.aggregate("_near", F.lit(0.0), lambda s, x: s + x["y"]) / F.size("_near")
    return asked.join(best, "_ask", "left").withColumn("knn", mean).drop("_ask", "_near")


def _plain(value) -> tuple | None:
    """The fields of a dataclass: broadcast values are pickled by reference, and executors need not have this package."""
    return None if value is None else tuple(vars(value).values())


def dealt(rows: DataFrame, fits: int = 1) -> DataFrame:
    """``rows`` dealt by row_id to tasks of about ASKED_ROWS scorings, when each row is scored by ``fits`` fits.

    Scoring costs a thousand times what reading a row does, so the few files that hold the rows must not set the number of tasks.
    """
    tasks = -(-rows.count() * fits // ASKED_ROWS)
    return rows.repartition(tasks, "row_id") if tasks > 1 else rows


def nearest_targets(train: DataFrame, test: DataFrame, k: int = 7, digits: int = 10, fit_rows: int | None = None) -> DataFrame:
    """(fit, row_id, knn): mean target of the k nearest training rows of the fit; ties go to the lower row_id.

    ``train`` holds (fit, row_id, z, y), ``test`` (fit, row_id, z). Test rows of a fit without training rows are left out. A row of
    ``train`` that two fits share has one z here. ``fit_rows`` asks for a draw of that many training rows a fit in place of all.
    """
    rows = labelled(train, "z", fit_rows)
    test = test.select("fit", "row_id", "z")
    if fit_rows is None and model_bytes(rows, "z") > MODEL_BYTES:
        fits = [r[0] for r in rows.select(F.explode("fits")).distinct().collect()]  # one row a fit
        found = with_nearest(rows, test.where(F.col("fit").isin(fits)), k, digits, vec="z")
        return found.select("fit", "row_id", F.coalesce("knn", F.lit(float("nan"))).alias("knn"))
    sent = test.sparkSession.sparkContext.broadcast(_plain(_sendable(rows, None, fit_rows, "z")))  # at most MODEL_BYTES

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Neighbours(*sent.value)
        for batch in batches:
            z, fits = _matrix(batch["z"]) if len(batch) else None, batch["fit"].to_numpy()
            knn = np.full(len(batch), np.nan)
            for fit in np.unique(fits):
                at, members = np.flatnonzero(fits == fit), model.members.get(int(fit))
                if members is not None:
                    knn[at] = mean_of_nearest(z[at], model.rows, model.y, k, digits, members)
            known = pa.array(np.isin(fits, list(model.members)))
            yield pa.RecordBatch.from_arrays([batch["fit"], batch["row_id"], pa.array(knn)], ["fit", "row_id", "knn"]).filter(known)

    id_type = test.schema["row_id"].dataType.simpleString()
    return test.mapInArrow(score, f"fit bigint, row_id {id_type}, knn double")


def committee_scores(train: DataFrame, test: DataFrame, width: int, alpha: float = 1000.0, k: int = 7,
                     used: dict[int, np.ndarray] | None = None, parts: dict[int, list[int]] | None = None,
                     fit_rows: int | None = None, digits: int = 10) -> DataFrame:
    """``test`` (fit, vec, any other columns) without vec, with ridge, knn and their mean, score.

    Ridge moments and neighbours cover all rows of ``train`` (fit, row_id, vec, y); ``fit_rows`` asks for a draw of that many rows a fit
    for the neighbours. With ``parts`` the fit column of ``train`` names disjoint pieces, and a fit is made of several of them. Up to
    MODEL_BYTES both models go to the tasks and each test row is scored where it lies, without shuffle or join; beyond, neighbours
    are found first (`with_nearest`). Rows of fits without training rows are left out.
    """
    params = fit_ridge(train, width, alpha, used, parts)
    rows = labelled(train, "vec", fit_rows)
    model, kept = None, [f for f in test.schema.fields if f.name != "vec"]
    if fit_rows is None and model_bytes(rows) > MODEL_BYTES:
        test = materialise(with_nearest(rows, test.where(F.col("fit").isin(list(params))), k, digits, params, parts), "nearest")
    else:
        model = _sendable(rows, parts, fit_rows, "vec")
    sent = test.sparkSession.sparkContext.broadcast(({f: _plain(p) for f, p in params.items()}, _plain(model)))  # at most MODEL_BYTES, and p numbers a fit

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solved, held = sent.value
        params, model = {f: FitParams(*p) for f, p in solved.items()}, None if held is None else Neighbours(*held)
        fitted = list(params if model is None else params.keys() & model.members.keys())
        for batch in batches:
            fits, ridge, knn = batch["fit"].to_numpy(), np.full(len(batch), np.nan), np.full(len(batch), np.nan)
            vec = _matrix(batch["vec"]) if len(batch) else None
            if model is None:
                knn = batch["knn"].to_numpy(zero_copy_only=False).astype(float)
            for fit in np.unique(fits):
                at, own = np.flatnonzero(fits == fit), params.get(int(fit))
                if int(fit) not in fitted:
                    continue
                z = (vec[at] - own.mean) * own.inv_sd
                ridge[at] = z @ own.coef + own.intercept
                if model is not None:
                    knn[at] = mean_of_nearest(z, model.rows, model.y, k, digits, model.members[int(fit)], own)
            known = pa.array(np.isin(fits, fitted))
            columns = [batch[f.name] for f in kept] + [pa.array(ridge), pa.array(knn), pa.array((ridge + knn) / 2)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + ["ridge", "knn", "score"]).filter(known)

    extra = [T.StructField(c, T.DoubleType()) for c in ("ridge", "knn", "score")]
    return test.mapInArrow(score, T.StructType(kept + extra))
