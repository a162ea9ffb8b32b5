"""Action policy: thresholds, reports and exact one-pass threshold search."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstprint.functions import columns as X
from firstprint.functions import vocab
from firstprint.operators.ordering import exact_quantiles


@dataclass(frozen=True)
class ActionThresholds:
    fold_min: float = 0.60
    small_bet_min: float = 0.30


@dataclass(frozen=True)
class Constraints:
    """Limits a threshold pair must meet; None leaves a limit out."""

    max_false_safe_rate: float = 0.10
    min_size_up_pct: float | None = None
    min_small_bet_pct: float | None = None
    max_fold_pct: float | None = None

    def met(self, r) -> Column:
        ok = r["false_safe_rate"] <= self.max_false_safe_rate
        if self.min_size_up_pct is not None:
            ok = ok & (r["size_up_pct"] >= self.min_size_up_pct)
        if self.min_small_bet_pct is not None:
            ok = ok & (r["small_bet_pct"] >= self.min_small_bet_pct)
        if self.max_fold_pct is not None:
            ok = ok & (r["fold_pct"] <= self.max_fold_pct)
        return ok


COVERED = Constraints(min_size_up_pct=0.10, min_small_bet_pct=0.0, max_fold_pct=0.80)
# grid of the threshold search
FOLD_GRID = tuple(float(x) for x in np.arange(0.30, 0.85, 0.05))
SMALL_BET_GRID = tuple(float(x) for x in np.arange(0.10, 0.60, 0.05))

REPORT = ("fold_pct", "small_bet_pct", "size_up_pct", "false_safe_rate", "adverse_detection_rate")


def with_action(df: DataFrame, p: str = "p_tail", thresholds: ActionThresholds = ActionThresholds()) -> DataFrame:
    return df.withColumn("action", X.action_of(F.col(p), F.lit(thresholds.fold_min), F.lit(thresholds.small_bet_min)))


def action_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def report_columns(action: str = "action", severe: str = "severe_30", adverse: str = "adverse_20") -> list[Column]:
    """n, action mix, false-safe rate and adverse detection as aggregates."""
    a, sev, adv = F.col(action), F.col(severe) == 1, F.col(adverse) == 1
    n = F.count(F.lit(1))
    return [
        n.alias("n"),
        X.ratio(F.count_if(a == "FOLD"), n).alias("fold_pct"),
        X.ratio(F.count_if(a == "SMALL_BET"), n).alias("small_bet_pct"),
        X.ratio(F.count_if(a == "SIZE_UP"), n).alias("size_up_pct"),
        X.ratio(F.count_if(sev & (a == "SIZE_UP")), F.count_if(sev)).alias("false_safe_rate"),
        X.ratio(F.count_if(adv & (a == "FOLD")), F.count_if(adv)).alias("adverse_detection_rate"),
    ]


def coverage_report(df: DataFrame, group=(), **names) -> DataFrame:
    return df.groupBy(*group).agg(*report_columns(**names))


def false_safe_rate(df: DataFrame, group=(), where: Column | None = None) -> DataFrame:
    """Share of severe rows labelled SIZE_UP, optionally within ``where`` (e.g. one sector)."""
    scope = F.lit(True) if where is None else where
    sev = scope & (F.col("severe_30") == 1)
    rate = X.ratio(F.count_if(sev & (F.col("action") == "SIZE_UP")), F.count_if(sev))
    return df.groupBy(*group).agg(rate.alias("false_safe_rate"))


def feasibility_report(df: DataFrame, max_false_safe_rate: float = 0.10, severe: str = "severe_30") -> DataFrame:
    """One row: severe share, best possible false-safe rate at four SIZE_UP shares, largest feasible share."""
    p = F.avg(F.col(severe).cast("double"))
    row = df.agg(p.alias("p_severe"))
    cols = {}
    for c in (0.20, 0.30, 0.40, 0.50):
        pct = int(c * 100)
        best = X.min_false_safe_rate(F.col("p_severe"), F.lit(c))
        cols[f"min_fsr_at_{pct}pct_sizeup"] = best
        cols[f"feasible_at_{pct}pct_sizeup"] = (best <= max_false_safe_rate).cast("double")
    cols["max_feasible_sizeup"] = F.greatest(F.lit(0.0), 1 - F.col("p_severe") * (1 - F.lit(max_false_safe_rate)))
    return row.withColumns(cols)


def enough_events(df: DataFrame, severe: str = "severe_30", minimum: int = vocab.MIN_SEVERE_EVENTS) -> DataFrame:
    n = F.coalesce(F.sum(F.col(severe).cast("bigint")), F.lit(0))
    return df.agg(n.alias("n_severe"), (n >= minimum).alias("should_calibrate"))


@dataclass(frozen=True)
class GridPoint:
    ord: int
    fold_min: float
    small_bet_min: float
    fold_label: float
    small_bet_label: float


def _search(df: DataFrame, score: str, points: list[GridPoint], constraints: Constraints, group: list[str],
            severe: str, adverse: str) -> DataFrame:
    """Report of every grid point per group, from one pass over the rows.

    Rows fall into at most (number of distinct cuts + 1) slots per group; that histogram is built
    map-side, and each grid point is a sum over it. Rows never meet the grid.
    """
    cuts = sorted({c for p in points for c in (p.fold_min, p.small_bet_min)})
    slot_of = {c: i + 1 for i, c in enumerate(cuts)}
    slot = sum((F.when(F.col(score) >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    hist = (
        df.groupBy(*group, slot.alias("_slot")).agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col(severe) == 1).alias("sev"),
            F.count_if(F.col(adverse) == 1).alias("adv"),
        )
        .groupBy(*group).agg(F.collect_list(F.struct("_slot", "n", "sev", "adv")).alias("_hist"))
    )
    # The grid is one literal: a JSON array keeps the exact doubles and parses once.
    rows_json = json.dumps([{"ord": p.ord, "fold_min": p.fold_label, "small_bet_min": p.small_bet_label,
                             "_f": slot_of[p.fold_min], "_s": slot_of[p.small_bet_min]} for p in points])
    grid = F.from_json(F.lit(rows_json), "array<struct<ord:int,fold_min:double,small_bet_min:double,_f:int,_s:int>>")

    def total(field: str, keep) -> Column:
        return F.aggregate(
            F.filter("_hist", keep), F.lit(0).cast("bigint"), lambda acc, b: acc + b[field]
        ).cast("double")

    def everything(b):
        return F.lit(True)

    def folded(b):
        return b["_slot"] >= F.col("_f")

    def sized_up(b):
        return b["_slot"] < F.col("_s")

    rows = hist.select(*group, "_hist", F.inline(grid))
    n, n_fold, n_up = total("n", everything), total("n", folded), total("n", sized_up)
    return rows.select(
        *group, "ord", "fold_min", "small_bet_min", n.cast("bigint").alias("n"),
        X.ratio(n_fold, n).alias("fold_pct"),
        X.ratio(n - n_fold - n_up, n).alias("small_bet_pct"),
        X.ratio(n_up, n).alias("size_up_pct"),
        X.ratio(total("sev", sized_up), total("sev", everything)).alias("false_safe_rate"),
        X.ratio(total("adv", folded), total("adv", everything)).alias("adverse_detection_rate"),
    ).withColumn("feasible", constraints.met({c: F.col(c) for c in REPORT}))


def _pick(reports: DataFrame, group: list[str], floor_is_default: bool) -> DataFrame:
    """The feasible point with most SIZE_UP (first wins ties); the default (ord -1) stays unless beaten.

    ``floor_is_default``: a point must exceed the default's own SIZE_UP share, whether or not the
    default meets the limits. Otherwise any feasible point replaces it.
    """
    fields = ["fold_min", "small_bet_min", "n", *REPORT, "feasible"]
    candidate = F.when(
        (F.col("ord") >= 0) & F.col("feasible"),
        F.struct(F.col("size_up_pct").alias("_up"), (-F.col("ord")).alias("_first"), *fields),
    )
    default = F.when(F.col("ord") == -1, F.struct(*fields))
    best = reports.groupBy(*group).agg(F.max(candidate).alias("_best"), F.max(default).alias("_default"))
    better = F.col("_best").isNotNull()
    if floor_is_default:
        better = better & (F.col("_best._up") > F.col("_default.size_up_pct"))
    return best.select(*group, *[
        F.when(better, F.col(f"_best.{f}")).otherwise(F.col(f"_default.{f}")).alias(f) for f in fields
    ])


def threshold_grid(fold_grid=FOLD_GRID, small_bet_grid=SMALL_BET_GRID,
                   default: ActionThresholds = ActionThresholds()) -> list[GridPoint]:
    points = [GridPoint(-1, default.fold_min, default.small_bet_min, default.fold_min, default.small_bet_min)]
    for f in fold_grid:
        for s in small_bet_grid:
            if s < f:
                points.append(GridPoint(len(points) - 1, f, s, f, s))
    return points


def grid_reports(df: DataFrame, p: str = "p_tail", constraints: Constraints = COVERED, group=(),
                 severe: str = "severe_30", adverse: str = "adverse_20", **grids) -> DataFrame:
    return _search(df, p, threshold_grid(**grids), constraints, list(group), severe, adverse)


def optimise_thresholds(df: DataFrame, p: str = "p_tail", constraints: Constraints = COVERED, group=(),
                        severe: str = "severe_30", adverse: str = "adverse_20", **grids) -> DataFrame:
    """Best threshold pair per group; ``feasible`` says whether the pair returned meets the limits."""
    return _pick(grid_reports(df, p, constraints, group, severe, adverse, **grids), list(group), True)


def rank_grid() -> list[tuple[float, float]]:
    """Quantile pairs of the ranking policy, in search order."""
    return [(float(f), float(s)) for f in np.arange(0.50, 0.96, 0.05) for s in np.arange(0.20, f, 0.05)]


def optimise_rank_policy(df: DataFrame, score: str, constraints: Constraints = COVERED,
                         severe: str = "severe_30", adverse: str = "adverse_20") -> DataFrame:
    """Best quantile pair of the ranking policy; falls back to (0.75, 0.50) when none is feasible.

    ``fold_min`` and ``small_bet_min`` of the result are quantile levels.
    """
    pairs = [(0.75, 0.50), *rank_grid()]
    levels = sorted({q for pair in pairs for q in pair})
    values = exact_quantiles(df, score, [min(max(q, 0.0), 1.0) for q in levels]).first()["quantiles"]
    cut = dict(zip(levels, values))
    points = [GridPoint(i - 1, cut[f], cut[s], f, s) for i, (f, s) in enumerate(pairs)]
    return _pick(_search(df, score, points, constraints, [], severe, adverse), [], False)


def assign_by_rank(df: DataFrame, score: str, fold_quantile: float = 0.75, small_bet_quantile: float = 0.50,
                   reference: DataFrame | None = None) -> DataFrame:
    """Actions from score quantiles of ``reference`` (default: the rows themselves)."""
    cuts = exact_quantiles(reference if reference is not None else df, score, [fold_quantile, small_bet_quantile])
    named = cuts.select(F.col("quantiles")[0].alias("_fold"), F.col("quantiles")[1].alias("_sbet"))
    return (
        df.join(F.broadcast(named))  # one row
        .withColumn("action", X.action_of(F.col(score), F.col("_fold"), F.col("_sbet"))).drop("_fold", "_sbet")
    )


def challenger_gates(reports: DataFrame, min_levels: int = 8, sbet_range=(0.10, 0.40)) -> DataFrame:
    """Adds granularity, coverage and overall gates to challenger rows (null ``n_unique`` passes)."""
    granular = F.coalesce(F.col("n_unique") >= min_levels, F.lit(True))
    covered = F.col("small_bet_pct").between(*sbet_range)
    return reports.withColumns({
        "granularity_ok": granular, "coverage_ok": covered, "gate_passed": granular & covered,
    })


def select_champion(challengers: DataFrame) -> DataFrame:
    """The passing challenger with the lowest false-safe rate, then most SIZE_UP, then best skill.

    A challenger without a skill score comes last among equals. Empty when none passes.
    """
    return (
        challengers.where("gate_passed")
        .orderBy("false_safe_rate", F.desc("size_up_pct"), F.desc_nulls_last("bss"), "name").limit(1)
    )


def require_champion(challengers: DataFrame) -> str:
    row = select_champion(challengers).first()
    if row is None:
        raise RuntimeError("no challenger passed its gates")
    return row["name"]
