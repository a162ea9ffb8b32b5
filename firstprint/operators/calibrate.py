"""Score calibrators fitted for many groups at once: Platt, isotonic and binned.

``group`` is one key column (a fold, a replicate, a fit id). Each calibrator first reduces the rows
to (group, score) levels with counts, so ties and hot score values shuffle once as one row, and all
groups are fitted by the same few jobs. A fitted calibrator is a table keyed by the group.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firstprint.operators.metrics import brier, climatology_brier, skill
from firstprint.operators.ordering import exact_quantiles, running_totals, temporal_blocks
from firstprint.session import materialise

# Task functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

METHODS = ("platt", "isotonic", "binned")
#: Levels of one task that deals draws, and replicates it holds at once.
LEVELS, REPLICATES = 4096, 50
#: Rounds of pooling whole runs before single steps; ranges merged by one task.
PASSES, FAN = 64, 16
#: Segments in a packed block, and bytes of a model that may be broadcast.
BLOCK, BROADCAST_BYTES = 256, 64 << 20


def weight_of(weight: str | None):
    """How often a row counts: the column ``weight``, or once."""
    return (F.col(weight) if weight else F.lit(1)).cast("double")


def score_levels(df: DataFrame, score: str, label: str, group: str, weight: str | None = None) -> DataFrame:
    w = weight_of(weight)
    return df.groupBy(group, F.col(score).alias("score")).agg(
        F.sum(w).alias("n"), F.sum(w * F.col(label).cast("double")).alias("pos")
    )


# ---- Platt ------------------------------------------------------------------------------------

def fit_platt(df: DataFrame, score: str, label: str, group: str, c: float = 1.0,
              max_iter: int = 50, tol: float = 1e-12, weight: str | None = None) -> DataFrame:
    """(group, slope, intercept, converged) of the L2-penalised logistic fit (intercept unpenalised).

    Newton steps: each is one aggregation of six sums per group over the levels; only the two
    parameters of each group travel through the driver. A group of one class has no finite fit: it gets slope 0, the
    log-odds with half a count added to each class, and ``converged`` false, as does one that ``max_iter`` steps leave open.
    """
    spark = df.sparkSession
    levels = materialise(score_levels(df, score, label, group, weight), "platt")
    key_type = levels.schema[group].dataType
    schema = T.StructType([T.StructField(group, key_type), T.StructField("w", T.DoubleType()), T.StructField("b", T.DoubleType())])
    fitted = T.StructType([T.StructField(group, key_type), T.StructField("slope", T.DoubleType()),
                           T.StructField("intercept", T.DoubleType()), T.StructField("converged", T.BooleanType())])
    totals = levels.groupBy(group).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()  # one row per group
    params = {r[0]: (0.0, float(np.log((r["pos"] + 0.5) / (r["n"] - r["pos"] + 0.5)))) for r in totals}
    s = F.col("score")
    p = 1 / (1 + F.exp(-(F.col("w") * s + F.col("b"))))
    resid, weight = F.col("n") * F.col("p") - F.col("pos"), F.col("n") * F.col("p") * (1 - F.col("p"))
    sums = [F.sum(resid * s).alias("gw"), F.sum(resid).alias("gb"), F.sum(weight * s * s).alias("hww"),
            F.sum(weight * s).alias("hwb"), F.sum(weight).alias("hbb")]
    lone = {r[0] for r in totals if not 0 < r["pos"] < r["n"]}
    open_groups = set(params) - lone
    for _ in range(max_iter if open_groups else 0):
        current = spark.createDataFrame([(g, *params[g]) for g in open_groups], schema)
        rows = levels.join(F.broadcast(current), group).withColumn("p", p).groupBy(group).agg(*sums).collect()
        for r in rows:
            w, b = params[r[0]]
            hess = np.array([[c * r["hww"] + 1.0, c * r["hwb"]], [c * r["hwb"], c * r["hbb"] + 1e-12]])
            step = np.linalg.solve(hess, np.array([c * r["gw"] + w, c * r["gb"]]))
            params[r[0]] = (float(w - step[0]), float(b - step[1]))
            if np.max(np.abs(step)) < tol * (1 + abs(w) + abs(b)):
                open_groups.discard(r[0])
        if not open_groups:
            break
    return spark.createDataFrame([(g, *v, g not in lone and g not in open_groups) for g, v in params.items()], fitted)


def apply_platt(df: DataFrame, model: DataFrame, score: str, group: str, name: str = "p") -> DataFrame:
    # one model row per group
    z = F.col("slope") * F.col(score) + F.col("intercept")
    return df.join(F.broadcast(model), group).withColumn(name, 1 / (1 + F.exp(-z))).drop("slope", "intercept", "converged")


# ---- isotonic -----------------------------------------------------------------------------------

def _pool(lo, hi, n, pos):
    """Pools neighbours whose means do not rise; arrays sorted by score, and so is the result.

    Whole falling runs are pooled at once. What many passes leave open (a long cascade) is settled one by one.
    """
    lo, hi, n, pos = (np.asarray(a, float) for a in (lo, hi, n, pos))
    for _ in range(PASSES):
        falls = pos[:-1] * n[1:] >= pos[1:] * n[:-1]
        if not falls.any():
            return lo, hi, n, pos
        start = np.flatnonzero(np.r_[True, ~falls])
        end = np.r_[start[1:], len(n)] - 1
        lo, hi, n, pos = lo[start], hi[end], np.add.reduceat(n, start), np.add.reduceat(pos, start)
    out = []
    for row in zip(lo, hi, n, pos):
        out.append(list(row))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, b2, m2, s2 = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = b2, out[-1][2] + m2, out[-1][3] + s2
    return tuple(np.array(c, float) for c in zip(*out))


def merge_pools(pools: DataFrame, group: str, parts: int) -> DataFrame:
    """(group, lo, hi, n, pos) from pools of ``_part``s, which are consecutive score ranges of about ``parts`` numbers.

    A merge tree: FAN neighbouring ranges are pooled into one until each group is one list. Pooling neighbours first
    cannot change the result, so a task only ever holds what FAN pooled ranges leave over.
    """
    types = f"`{group}` {pools.schema[group].dataType.simpleString()}, _part long, lo double, hi double, n double, pos double"

    def merge(key, pdf):
        pdf = pdf.sort_values("lo")
        lo, hi, n, pos = _pool(pdf["lo"], pdf["hi"], pdf["n"], pdf["pos"])
        return pd.DataFrame({group: key[0], "_part": key[1], "lo": lo, "hi": hi, "n": n, "pos": pos})

    while parts > FAN:
        parts = -(-parts // FAN)
        pools = pools.withColumn("_part", F.floor(F.col("_part") / FAN)).groupBy(group, "_part").applyInPandas(merge, types)
    return pools.withColumn("_part", F.lit(0).cast("bigint")).groupBy(group, "_part").applyInPandas(merge, types).drop("_part")


def isotonic_pools(df: DataFrame, score: str, label: str, group: str, weight: str | None = None) -> DataFrame:
    """(group, lo, hi, n, pos): the pools of the increasing least-squares fit, value = pos / n.

    Contiguous score ranges are pooled where they lie, then merged along a tree (``merge_pools``). With 0/1 labels a
    group of N rows keeps at most O(N^(2/3)) pools, so the last merge is small even when one group holds most rows.
    """
    levels = score_levels(df, score, label, group, weight)
    schema = f"`{group}` {levels.schema[group].dataType.simpleString()}, _part long, lo double, hi double, n double, pos double"

    def pool_ranges(batches):
        part, held = TaskContext.get().partitionId(), None

        def frame():
            return pd.DataFrame({group: held[0], "_part": part, **dict(zip(("lo", "hi", "n", "pos"), held[1]))})

        for pdf in batches:
            for g, rows in pdf.groupby(group, sort=False):
                new = [rows[c].to_numpy(float) for c in ("score", "score", "n", "pos")]
                if held and held[0] == g:
                    new = [np.concatenate(both) for both in zip(held[1], new)]
                elif held:
                    yield frame()
                held = (g, _pool(*new))
        if held:
            yield frame()

    local = (
        levels.repartitionByRange(group, "score").sortWithinPartitions(group, "score")
        .mapInPandas(pool_ranges, schema)
    )
    return merge_pools(local, group, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def isotonic_segments(pools: DataFrame, group: str) -> DataFrame:
    """(group, x0, x1, p0, p1): spans (x0, x1] covering the whole line; values clamp at both ends.

    The window runs over the pools of a group, whose number is bounded as in ``isotonic_pools``.
    """
    w = Window.partitionBy(group).orderBy("lo")
    value = F.col("pos") / F.col("n")
    last_hi, last_v = F.lag("hi").over(w), F.lag(value).over(w)
    inf = float("inf")
    led = F.lead("lo").over(w)
    spans = pools.select(group, "lo", "hi", value.alias("v"), last_hi.alias("ph"), last_v.alias("pv"), led.alias("nx"))

    def span(x0, x1, p0, p1):
        return F.struct(x0.alias("x0"), x1.alias("x1"), p0.alias("p0"), p1.alias("p1"))

    pieces = F.array(
        span(F.coalesce("ph", F.lit(-inf)), F.col("lo"), F.coalesce("pv", "v"), F.col("v")),
        F.when(F.col("hi") > F.col("lo"), span(F.col("lo"), F.col("hi"), F.col("v"), F.col("v"))),
        F.when(F.col("nx").isNull(), span(F.col("hi"), F.lit(inf), F.col("v"), F.col("v"))),
    )
    return spans.select(group, F.inline(F.array_compact(pieces)))


def _first_at_least(sorted_array, x, size: int):
    """0-based index of the first element that is >= x in an ascending array of at most ``size``: its length if none is.

    Binary search as an expression: descending powers of two are taken while the element before the step is below x.
    """
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(size.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(sorted_array, at + step - 1) < x, step).otherwise(0))


def apply_isotonic(df: DataFrame, segments: DataFrame, score: str, group: str, name: str = "p", block: int = BLOCK) -> DataFrame:
    """Linear interpolation inside the segment of each score, found by two binary searches.

    The segments of a group, sorted, are packed into blocks of ``block``; the last bound of each block is an array per
    group, so a row finds its block and then its segment in about log2 of their number steps, however unevenly the
    scores lie. Blocks are broadcast if they fit into BROADCAST_BYTES, else joined on (group, block). Rows of a group
    without segments are left out; a null or NaN score gives null.
    """
    placed = segments.withColumn("_iso_block", F.floor((F.row_number().over(Window.partitionBy(group).orderBy("x1")) - 1) / block))
    packed = materialise(
        placed.groupBy(group, "_iso_block").agg(F.sort_array(F.collect_list(F.struct("x1", "x0", "p0", "p1"))).alias("_iso_segs"))
        .withColumn("_iso_ends", F.col("_iso_segs.x1")), "segments")
    tops = materialise(
        packed.select(group, F.element_at("_iso_ends", -1).alias("_iso_top"))
        .groupBy(group).agg(F.sort_array(F.collect_list("_iso_top")).alias("_iso_tops")), "tops")
    n_blocks, total, most = packed.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.size("_iso_segs")), F.lit(0)), F.coalesce(F.max("_iso_block"), F.lit(0))).first()
    s = F.col(score).cast("double")

    def hinted(side, size):
        return F.broadcast(side) if size <= BROADCAST_BYTES else side

    at = hinted(tops.withColumnRenamed(group, "_iso_g"), 8 * n_blocks)
    rows = df.join(at, F.col(group) == F.col("_iso_g")).withColumn("_iso_b", _first_at_least(F.col("_iso_tops"), s, int(most) + 1).cast("bigint")).drop("_iso_g", "_iso_tops")
    # a null or NaN score has no segment: it takes the first block and gets null there
    rows = rows.withColumn("_iso_b", F.when(s.isNull() | F.isnan(s), 0).otherwise(F.col("_iso_b")).cast("bigint"))
    blocks = hinted(packed.withColumnRenamed(group, "_iso_g"), 40 * total)
    found = rows.join(blocks, (F.col(group) == F.col("_iso_g")) & (F.col("_iso_b") == F.col("_iso_block"))).withColumn(
        "_iso_s", F.get("_iso_segs", _first_at_least(F.col("_iso_ends"), s, block)))
    x0, x1, p0, p1 = (F.col(f"_iso_s.{c}") for c in ("x0", "x1", "p0", "p1"))
    value = F.when(s.isNull() | F.isnan(s), F.lit(None)).when(p0 == p1, p1).otherwise(p0 + (p1 - p0) * (s - x0) / (x1 - x0))
    return found.withColumn(name, value).drop("_iso_b", "_iso_g", "_iso_block", "_iso_segs", "_iso_ends", "_iso_s")


# ---- binned --------------------------------------------------------------------------------------

def _monotone_pass(df: DataFrame, names: list[str], strict: bool) -> DataFrame:
    """One forward pass that averages each falling run; ``strict`` repeats until nothing can fall."""
    n = len(names)
    for _ in range(n if strict else 1):
        for i in range(n - 1):
            first = F.col(names[i])
            falls = first > F.col(names[i + 1])
            run = F.lit(True)
            members = []
            for j in range(i + 1, n):
                run = run & (F.col(names[j]) < first)
                members.append(run)
            total, count = first, F.lit(1)
            for j, inside in zip(range(i + 1, n), members):
                total = total + F.when(inside, F.col(names[j])).otherwise(0.0)
                count = count + F.when(inside, 1).otherwise(0)
            changed = {"_mean": total / count, "_falls": falls}
            df = df.withColumns({**changed, **{f"_in{j}": m for j, m in zip(range(i + 1, n), members)}})
            df = df.withColumns({
                names[i]: F.when(F.col("_falls"), F.col("_mean")).otherwise(F.col(names[i])),
                **{names[j]: F.when(F.col("_falls") & F.col(f"_in{j}"), F.col("_mean")).otherwise(F.col(names[j]))
                   for j in range(i + 1, n)},
            }).drop("_mean", "_falls", *[f"_in{j}" for j in range(i + 1, n)])
    return df


def fit_binned(df: DataFrame, score: str, label: str, group: str, n_bins: int = 4, alpha: float = 1.0,
               strict: bool = False, weight: str | None = None) -> DataFrame:
    """(group, edges, probs): inner quantile edges and Laplace-smoothed, monotone-passed bin rates."""
    edges = exact_quantiles(df, score, [i / n_bins for i in range(1, n_bins)], [group], weight).withColumnRenamed("quantiles", "edges")
    return fit_bins_on_edges(df, edges, score, label, group, n_bins, alpha, strict, weight)


def fit_bins_on_edges(df: DataFrame, edges: DataFrame, score: str, label: str, group: str, n_bins: int = 4,
                      alpha: float = 1.0, strict: bool = False, weight: str | None = None) -> DataFrame:
    binned = df.join(F.broadcast(edges), group).withColumn("_bin", bin_index(F.col("edges"), F.col(score)))  # one row per group
    y, w = F.col(label).cast("double"), weight_of(weight)
    aggs = []
    for i in range(n_bins):
        here = F.col("_bin") == i
        rate = (F.coalesce(F.sum(F.when(here, w * y)), F.lit(0.0)) + alpha) / (F.sum(F.when(here, w).otherwise(0.0)) + 2 * alpha)
        aggs.append(rate.alias(f"_p{i}"))
    names = [f"_p{i}" for i in range(n_bins)]
    rates = binned.groupBy(group).agg(F.first("edges").alias("edges"), *aggs)
    return _monotone_pass(rates, names, strict).select(group, "edges", F.array(*names).alias("probs"))


def bin_index(edges, score):
    return F.size(F.filter(edges, lambda e: score >= e))


def apply_binned(df: DataFrame, model: DataFrame, score: str, group: str, name: str = "p") -> DataFrame:
    at = bin_index(F.col("edges"), F.col(score)) + 1
    return df.join(F.broadcast(model), group).withColumn(name, F.element_at("probs", at)).drop("edges", "probs")  # one row per group


# ---- selection ------------------------------------------------------------------------------------

def fit_apply(method: str, train: DataFrame, rows: DataFrame, score: str, label: str, group: str, name: str = "p",
              weight: str | None = None) -> DataFrame:
    """Fits ``method`` per group on ``train`` (rows counted ``weight`` times) and adds the calibrated ``name`` to ``rows``."""
    if method == "platt":
        return apply_platt(rows, fit_platt(train, score, label, group, weight=weight), score, group, name)
    if method == "isotonic":
        pools = materialise(isotonic_pools(train, score, label, group, weight), "pools")
        return apply_isotonic(rows, isotonic_segments(pools, group), score, group, name)
    if method == "binned":
        return apply_binned(rows, materialise(fit_binned(train, score, label, group, weight=weight), "bins"), score, group, name)
    raise ValueError(f"unknown calibrator {method!r}")


def expanding_members(df: DataFrame, block: str, n_folds: int, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, test): fold k = 1..n_folds trains on blocks below k and is tested on block k."""
    b = F.col(block)
    train = df.where(b < n_folds).withColumn(fold, F.explode(F.sequence(b + 1, F.lit(n_folds))))
    test = df.where(b >= 1).withColumn(fold, b)
    return train, test


def oof_calibrated(df: DataFrame, score: str, label: str, order: list[str], n_folds: int = 3,
                   methods=METHODS, group: str | None = None) -> DataFrame:
    """Out-of-fold calibrated probabilities of every method, long: (..., fold, method, p).

    With ``group`` (an integer key), every group gets its own blocks; group x fold is one fit key,
    so all groups and folds are fitted together.
    """
    base = df if group else df.withColumn("_one", F.lit(0))
    g = group or "_one"
    blocks = materialise(temporal_blocks(base, order, n_folds + 1, [g], "_block"), "blocks")
    return oof_on_blocks(blocks, score, label, n_folds, g, methods).drop("_block", *([] if group else ["_one"]))


def oof_on_blocks(blocks: DataFrame, score: str, label: str, n_folds: int, group: str, methods=METHODS,
                  weight: str | None = None) -> DataFrame:
    """As ``oof_calibrated`` for rows whose ``_block`` (0..n_folds) is known; ``weight`` says how often a row counts."""
    keyed = lambda d: d.withColumn("_fit", F.col(group) * (n_folds + 1) + F.col("fold"))
    train, test = (keyed(d) for d in expanding_members(blocks, "_block", n_folds))
    out = None
    for m in methods:
        part = fit_apply(m, train, test, score, label, "_fit", weight=weight).withColumn("method", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out.drop("_fit")


def skill_by_method(oof: DataFrame, label: str, group=(), weight: str | None = None) -> DataFrame:
    """(group..., method, brier, brier_climatology, bss) against the out-of-fold mean outcome."""
    w, miss = weight_of(weight), F.col("p") - F.col(label)
    mean = F.sum(w * F.col(label)) / F.sum(w)
    out = oof.groupBy(*group, "method").agg(
        (F.sum(w * miss * miss) / F.sum(w)).alias("brier"), (mean * (1 - mean)).alias("brier_climatology")
    )
    return out.withColumn("bss", skill(F.col("brier"), F.col("brier_climatology")))


def best_method(skills: DataFrame, group=()) -> DataFrame:
    """(group..., selected): highest skill; platt, isotonic, binned in that order win ties."""
    rank = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    return skills.groupBy(*group).agg(F.max_by("method", F.struct("bss", -rank)).alias("selected"))


def holdout_skills(train: DataFrame, val: DataFrame, score: str, label: str) -> DataFrame:
    """Skill of each method fitted on ``train`` and tested on ``val``, against the train base rate."""
    t, v = train.withColumn("_g", F.lit(0)), val.withColumn("_g", F.lit(0))
    base = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
    out = None
    for m in METHODS:
        part = fit_apply(m, t, v, score, label, "_g").withColumn("method", F.lit(m))
        out = part if out is None else out.unionByName(part)
    skills = out.groupBy("method").agg(
        brier("p", label).alias("brier"), climatology_brier(label, F.lit(base)).alias("brier_climatology")
    )
    return skills.withColumn("bss", skill(F.col("brier"), F.col("brier_climatology")))


# ---- bootstrap -------------------------------------------------------------------------------------

def _share(cum, at, total, n_rep, seed, kind):
    """Draws of each replicate that fall on chunk ``at``, and on the chunks before it.

    The draws are halved from the whole down to the chunk. Each half has its own seed, so all tasks agree without asking.
    """
    a, b, n, before = 0, len(cum) - 1, np.full(n_rep, total, np.int64), np.zeros(n_rep, np.int64)
    while b - a > 1:
        mid, rng = (a + b) // 2, np.random.default_rng([seed, a, b])
        first, rest = cum[mid] - cum[a], cum[b] - cum[mid]
        left = rng.binomial(n, first / (first + rest)) if kind == "multinomial" else rng.hypergeometric(first, rest, n)
        if at < mid:
            b, n = mid, left
        else:
            a, n, before = mid, n - left, before + left
    return n, before


def dealt(levels: DataFrame, keys: list[str], total: int, n_rep: int, seed: int, kind: str,
          whole: list[str] | None = None, summary=None, schema: str | None = None) -> DataFrame:
    """(rep, keys..., _c, times): in each of ``n_rep`` replicates, ``total`` draws dealt over levels of ``_c`` rows each.

    ``kind`` is "multinomial" (with replacement) or "multivariate_hypergeometric" (without; numpy takes fewer than 10^9
    rows for it). Levels are cut into chunks of about LEVELS in key order; rows equal in ``whole`` share a chunk. The
    draws are halved down to chunks, then dealt inside each, which is the same distribution, so no draw exists as a row
    and only the levels are shuffled, once. Chunks have their own seeds: partitioning changes nothing.

    With ``summary(chunk, reps, before, levels, times)`` a task hands out what that returns (columns as in ``schema``)
    for each slice of REPLICATES replicates: ``times`` has a row a replicate and a column a level, ``before`` counts the
    draws of each replicate that fall on earlier chunks.
    """
    from firstprint.operators.ordering import global_position

    placed = global_position(levels.select(*keys, "_c"), keys, None, "_pos").withColumn("_chunk", F.floor(F.col("_pos") / LEVELS))
    if whole:  # a window holds the few levels that differ in the other keys only
        placed = placed.withColumn("_chunk", F.min("_chunk").over(Window.partitionBy(*whole)))
    placed = materialise(placed, "levels")
    sizes = placed.groupBy("_chunk").agg(F.sum("_c").alias("_c")).orderBy("_chunk").collect()  # one row per LEVELS levels
    index = {r["_chunk"]: i for i, r in enumerate(sizes)}
    cum = np.cumsum([0, *[r["_c"] for r in sizes]], dtype=np.int64)

    def listed(chunk, reps, before, part, times):
        out = pd.concat([part[[*keys, "_c"]]] * len(reps), ignore_index=True)
        return out.assign(rep=np.repeat(reps, len(part)), times=times.ravel())[["rep", *keys, "_c", "times"]]

    def in_chunk(key, part):
        part = part.sort_values("_pos", ignore_index=True)
        counts = part["_c"].to_numpy(np.int64)
        drawn, before = _share(cum, index[key[0]], total, n_rep, seed, kind)
        out = []
        for at in range(0, n_rep, REPLICATES):
            reps = np.arange(at, min(at + REPLICATES, n_rep))
            rng = [np.random.default_rng([seed, r, key[0] + 1]) for r in reps]
            if kind == "multinomial":
                times = np.stack([g.multinomial(n, counts / counts.sum()) for g, n in zip(rng, drawn[reps])])
            else:
                times = np.stack([g.multivariate_hypergeometric(counts, n, method="marginals") for g, n in zip(rng, drawn[reps])])
            out.append((summary or listed)(key[0], reps, before[reps], part, times))
        return pd.concat(out, ignore_index=True)

    types = ", ".join(f"`{k}` {placed.schema[k].dataType.simpleString()}" for k in keys)
    return placed.groupBy("_chunk").applyInPandas(in_chunk, schema or f"rep int, {types}, _c long, times long")


def resamples(df: DataFrame, n_boot: int, seed: int, keep: list[str], **kw) -> DataFrame:
    """n_boot draws with replacement of the whole table: (rep, times, keep...), one row per distinct ``keep`` drawn.

    Rows equal in ``keep`` are one level with a count, so no row order is needed. Levels with the same first column share
    a chunk. ``summary`` and ``schema`` are those of ``dealt`` and replace the rows.
    """
    levels = df.groupBy(*keep).agg(F.count(F.lit(1)).alias("_c"))
    got = dealt(levels, keep, df.count(), n_boot, seed, "multinomial", keep[:1], **kw)
    return got if kw else got.where("times > 0").select("rep", "times", *keep)


def _by_score(part, times, score, label):
    """Distinct scores of a chunk, and per replicate how often each was drawn, at all and with outcome 1."""
    scores = part[score].to_numpy(float)
    start = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
    return scores[start], np.add.reduceat(times, start, axis=1), np.add.reduceat(times * part[label].to_numpy(float), start, axis=1)


def bootstrap_pools(df: DataFrame, score: str, label: str, n_boot: int, seed: int) -> DataFrame:
    """(rep, lo, hi, n, pos): isotonic pools of every resample. Tasks pool what they deal, so no level leaves them."""
    def pooled(chunk, reps, before, part, times):
        scores, n, pos = _by_score(part, times, score, label)
        frames = []
        for i, rep in enumerate(reps):
            drawn = n[i] > 0
            if drawn.any():
                lists = _pool(scores[drawn], scores[drawn], n[i, drawn], pos[i, drawn])
                frames.append(pd.DataFrame({"rep": rep, "_part": chunk, **dict(zip(("lo", "hi", "n", "pos"), lists))}))
        return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=["rep", "_part", "lo", "hi", "n", "pos"])

    schema = "rep int, _part long, lo double, hi double, n double, pos double"
    lists = materialise(resamples(df, n_boot, seed, [score, label], summary=pooled, schema=schema), "chunk-pools")
    parts = lists.agg(F.coalesce(F.max("_part"), F.lit(0))).first()[0] + 1
    return merge_pools(lists, "rep", parts)


def bootstrap_bins(df: DataFrame, score: str, label: str, n_boot: int, seed: int, n_bins: int = 4, alpha: float = 1.0) -> DataFrame:
    """(rep, v, n, pos): bins of the binned calibrator fitted on every resample, with their fitted value.

    The draws are dealt twice with the same seeds: first the chunk that holds a wanted rank names its score, which gives
    the quantile edges of every replicate; then each chunk counts its draws by bin. No level leaves its task.
    """
    total = df.count()
    x = [(total - 1) * i / n_bins for i in range(1, n_bins)]
    ranks = sorted({int(f(v)) for v in x for f in (np.floor, np.ceil)})

    def at_ranks(chunk, reps, before, part, times):
        scores, n, _ = _by_score(part, times, score, label)
        ends = before[:, None] + np.cumsum(n, axis=1)
        rows = [(rep, rank, scores[np.searchsorted(ends[i], rank, side="right")])
                for i, rep in enumerate(reps) for rank in ranks if before[i] <= rank < ends[i, -1]]
        return pd.DataFrame(rows, columns=["rep", "rank", "value"])

    found = resamples(df, n_boot, seed, [score, label], summary=at_ranks, schema="rep int, rank long, value double")
    edges = np.zeros((n_boot, n_bins - 1))
    if total:
        values = {(r["rep"], r["rank"]): r["value"] for r in found.collect()}  # at most two per edge and replicate
        for i, v in enumerate(x):
            f = v - np.floor(v)
            for rep in range(n_boot):
                a, b = values[rep, int(np.floor(v))], values[rep, int(np.ceil(v))]
                edges[rep, i] = b - (b - a) * (1 - f) if f >= 0.5 else a + (b - a) * f

    def by_bin(chunk, reps, before, part, times):
        scores, n, pos = _by_score(part, times, score, label)
        frames = []
        for i, rep in enumerate(reps):
            at = np.searchsorted(edges[rep], scores, side="right")
            frames.append(pd.DataFrame({"rep": rep, "bin": np.arange(n_bins), "n": np.bincount(at, n[i], n_bins),
                                        "pos": np.bincount(at, pos[i], n_bins)}))
        return pd.concat(frames, ignore_index=True)

    counted = resamples(df, n_boot, seed, [score, label], summary=by_bin, schema="rep int, bin int, n double, pos double")
    wide = counted.groupBy("rep").agg(*[
        F.coalesce(F.sum(F.when(F.col("bin") == i, F.col(c))), F.lit(0.0)).alias(f"_{c}{i}") for i in range(n_bins) for c in ("n", "pos")])
    names = [f"_v{i}" for i in range(n_bins)]
    rates = wide.withColumns({f"_v{i}": (F.col(f"_pos{i}") + alpha) / (F.col(f"_n{i}") + 2 * alpha) for i in range(n_bins)})
    return _monotone_pass(rates, names, False).select("rep", F.inline(F.array(*[
        F.struct(F.col(f"_v{i}").alias("v"), F.col(f"_n{i}").alias("n"), F.col(f"_pos{i}").alias("pos")) for i in range(n_bins)])))


def bootstrap_skills(df: DataFrame, score: str, label: str, order: list[str], method: str,
                     n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """(rep, bss) of ``method`` refitted on and scored against each resample.

    Rows without a score or label take no part, resamples with a single outcome are left out. The fit is constant inside
    a pool or bin, so the Brier score follows from their sums and no row is scored individually; what leaves a task are
    pools or bins, not draws. ``order`` plays no part, as equal rows are one level.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    if method == "isotonic":
        sums = bootstrap_pools(rows, score, label, n_boot, seed).withColumn("v", F.col("pos") / F.col("n"))
    elif method == "binned":
        sums = bootstrap_bins(rows, score, label, n_boot, seed)
    else:
        raise ValueError(f"bootstrap is defined for isotonic and binned, not {method!r}")
    v, n, pos = F.col("v"), F.col("n"), F.col("pos")
    per_rep = sums.groupBy("rep").agg(
        F.sum(n * v * v - 2 * v * pos + pos).alias("_sse"), F.sum("n").alias("_n"), F.sum("pos").alias("_pos")
    )
    mean = F.col("_pos") / F.col("_n")
    return per_rep.where((F.col("_pos") > 0) & (F.col("_pos") < F.col("_n"))).select(
        "rep", (1 - (F.col("_sse") / F.col("_n")) / (mean * (1 - mean))).alias("bss")
    )


def bootstrap_interval(df: DataFrame, score: str, label: str, order: list[str], method: str,
                       n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """One row: median skill and its 95 % interval over the replicates."""
    q = bootstrap_skills(df, score, label, order, method, n_boot, seed).agg(
        F.percentile("bss", F.array(F.lit(0.5), F.lit(0.025), F.lit(0.975))).alias("q"), F.count("bss").alias("replicates")
    )
    return q.select(F.lit(method).alias("method"), F.col("q")[0].alias("bss_median"), F.col("q")[1].alias("ci_lo"),
                    F.col("q")[2].alias("ci_hi"), "replicates")


def hardened_selection(df: DataFrame, score: str, label: str, order: list[str], n_folds: int = 3,
                       gap: float = 0.03, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """One row: isotonic when it beats binned by ``gap`` and its bootstrap interval excludes 0, else binned."""
    skills = skill_by_method(oof_calibrated(df, score, label, order, n_folds), label)
    wide = skills.agg(*[F.max(F.when(F.col("method") == m, F.col("bss"))).alias(f"bss_{m}") for m in METHODS])
    iso = bootstrap_interval(df, score, label, order, "isotonic", n_boot, seed).select(
        F.col("ci_lo").alias("isotonic_ci_lo"), F.col("ci_hi").alias("isotonic_ci_hi"))
    binned = bootstrap_interval(df, score, label, order, "binned", n_boot, seed).select(
        F.col("ci_lo").alias("binned_ci_lo"), F.col("ci_hi").alias("binned_ci_hi"))
    joined = wide.join(F.broadcast(iso)).join(F.broadcast(binned))  # single rows
    wins = (F.col("bss_isotonic") - F.col("bss_binned") >= gap) & (F.col("isotonic_ci_lo") > 0)
    return joined.withColumn("selected", F.when(wins, "isotonic").otherwise("binned"))


# ---- leakage checks ---------------------------------------------------------------------------------

def permuted_labels(df: DataFrame, label: str, order: list[str], n_perm: int, seed: int) -> DataFrame:
    """Each replicate's labels in a fresh exact permutation: (rep, order..., others..., label).

    Row i of a replicate takes the label whose random key ranks i-th; both sides are ranked by the
    distributed ordering, then joined on (rep, rank).
    """
    from firstprint.operators.ordering import global_position

    numbered = materialise(global_position(df, order, None, "_pos"), "numbered")
    reps = F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("rep")
    keyed = numbered.select(reps, F.col(label).alias("_label"), F.col("_pos").alias("_from")).withColumn(
        "_key", F.xxhash64("rep", "_from", F.lit(seed)))
    shuffled = global_position(keyed, ["_key", "_from"], ["rep"], "_to").select("rep", "_to", "_label")
    rows = numbered.drop(label).select("*", reps)
    return (
        rows.join(shuffled.withColumnRenamed("rep", "_rep"), (F.col("rep") == F.col("_rep")) & (F.col("_pos") == F.col("_to")))
        .withColumnRenamed("_label", label).drop("_rep", "_to", "_pos")
    )


def permuted_levels(df: DataFrame, score: str, label: str, order: list[str], n_perm: int, n_folds: int, seed: int) -> DataFrame:
    """(rep, _block, score, label, times): how often each label falls on each score of each block under a fresh permutation."""
    blocks = temporal_blocks(df, order, n_folds + 1, name="_block")
    levels = materialise(blocks.groupBy("_block", score).agg(
        F.count(F.lit(1)).alias("_c"), F.sum(F.col(label).cast("bigint")).alias("_pos")), "cells")
    events = levels.agg(F.coalesce(F.sum("_pos"), F.lit(0))).first()[0]
    got = dealt(levels, ["_block", score], events, n_perm, seed, "multivariate_hypergeometric")
    both = F.array(F.struct(F.lit(1).alias(label), F.col("times")), F.struct(F.lit(0).alias(label), (F.col("_c") - F.col("times")).alias("times")))
    return got.select("rep", "_block", score, F.inline(both)).where("times > 0")


def shuffle_test(df: DataFrame, score: str, label: str, order: list[str], n_perm: int = 100, n_folds: int = 3,
                 seed: int = 42) -> DataFrame:
    """One row: real best skill, mean and 95th percentile under label shuffling, and the p-value.

    Labels are 0 or 1. A permutation only decides how many events each (block, score) level gets, so these counts are
    drawn, without replacement. All replicates, folds and methods are fitted together on the weighted levels.
    """
    real = skill_by_method(oof_calibrated(df, score, label, order, n_folds), label).agg(F.max("bss").alias("real_bss"))
    perms = materialise(permuted_levels(df, score, label, order, n_perm, n_folds, seed), "perms")
    shuffled = skill_by_method(oof_on_blocks(perms, score, label, n_folds, "rep", weight="times"), label, ["rep"], "times")
    best = shuffled.groupBy("rep").agg(F.max("bss").alias("bss"))
    return (
        best.join(F.broadcast(real))  # one row
        .agg(F.first("real_bss").alias("real_bss"), F.avg("bss").alias("shuffle_bss_mean"),
             F.percentile("bss", F.lit(0.95)).alias("shuffle_bss_p95"),
             F.avg((F.col("bss") >= F.col("real_bss")).cast("double")).alias("p_value"))
        .withColumn("leakage_detected", F.col("p_value") > 0.5)
    )
