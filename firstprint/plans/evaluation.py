"""Expanding-fold evaluation of the committee: all folds, variants and blocks in a few Spark jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstprint.functions import columns as X
from firstprint.functions import vocab
from firstprint.operators import calibrate as K
from firstprint.operators import committee as CM
from firstprint.operators import metrics as M
from firstprint.operators import policy as P
from firstprint.operators.ordering import rolled, temporal_blocks, temporal_split
from firstprint.operators.snapshots import feature_columns
from firstprint.session import materialise
from firstprint.sources.tables import content_hash

ONE_HOTS = [f"preflop_sector_{s}" for s in vocab.ONE_HOT_SECTORS]
FILING_COLS = ["preflop_s1_lead_days", "preflop_exchange_nyse", "preflop_exchange_nasdaq"]
AMENDMENT_COLS = ["preflop_s1a_count", "preflop_days_since_last_amendment"]
V1_COLS = ONE_HOTS + FILING_COLS + AMENDMENT_COLS
VARIANTS = {
    "baseline": [],
    "A_full": V1_COLS,
    "B_no_amend_time": ONE_HOTS + FILING_COLS + ["preflop_s1a_count"],
    "C_no_amendments": ONE_HOTS + FILING_COLS,
}
STABILITY = P.Constraints(0.03, min_size_up_pct=0.10, min_small_bet_pct=0.12, max_fold_pct=0.80)
FALSIFICATION = P.Constraints(0.05, min_size_up_pct=0.10, min_small_bet_pct=0.12, max_fold_pct=0.80)
CHALLENGER = P.Constraints(0.05, min_size_up_pct=0.10, min_small_bet_pct=0.0, max_fold_pct=0.80)


@dataclass(frozen=True)
class FoldPlan:
    """Expanding yearly folds: train on years up to ``train_end``, test on ``test_year``."""

    folds: tuple = ((2021, 2022), (2022, 2023), (2023, 2024), (2024, 2025))
    oof_splits: int = 3
    alpha: float = 1000.0
    k: int = 7
    constraints: P.Constraints = field(default=STABILITY)


def river_rows(snapshots: DataFrame, features: list[str], target: str = "risk_severity", keep=()) -> DataFrame:
    """(row_id, asof_date, yr, sector, y, adverse_20, severe_30, vec) of labelled last-street rows."""
    return snapshots.where((F.col("street") == "RIVER") & F.col(target).isNotNull()).select(
        F.col("symbol").alias("row_id"), "asof_date", F.year("asof_date").alias("yr"), "sector",
        F.col(target).alias("y"), "adverse_20", "severe_30", CM.feature_vector(features).alias("vec"), *keep)


def fold_members(rows: DataFrame, folds) -> DataFrame:
    """Each row once per fold it takes part in: (fold_id, test_year, role, ...). A literal fold list is
    exploded against the row's year; nothing is joined."""
    specs = F.array(*[F.struct(F.lit(i).alias("fold_id"), F.lit(te).alias("train_end"), F.lit(ty).alias("test_year"))
                      for i, (te, ty) in enumerate(folds)])
    wide = rows.withColumn("_f", F.explode(specs))
    role = F.when(F.col("yr") <= F.col("_f.train_end"), "train").when(F.col("yr") == F.col("_f.test_year"), "test")
    return wide.withColumns({"fold_id": F.col("_f.fold_id"), "test_year": F.col("_f.test_year"), "role": role}).where(
        F.col("role").isNotNull()).drop("_f")


def _scored_folds(rows: DataFrame, plan: FoldPlan, features: list[str], variants: dict[str, list[str]]) -> DataFrame:
    """(variant, fold_id, part, row columns, score) with part 'oof' or 'test'.

    One fit key encodes (variant, fold, block); every ridge and neighbour model of the whole
    evaluation is fitted in the same jobs.
    """
    splits, n_folds = plan.oof_splits, len(plan.folds)
    members = fold_members(rows, plan.folds)
    train = materialise(
        temporal_blocks(members.where(F.col("role") == "train"), ["asof_date", "row_id"], splits + 1, ["fold_id"]), "train")
    test = members.where(F.col("role") == "test")
    final = splits + 1
    names = list(variants)

    b = F.col("block")
    oof_rows = train.where(b >= 1).withColumns({"_k": b, "part": F.lit("oof")})
    test_rows = test.withColumns({"_k": F.lit(final), "part": F.lit("test")})
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_v") + 1)
    ask = (CM.dealt(oof_rows.unionByName(test_rows, allowMissingColumns=True), len(names))
           .withColumn("_v", F.explode(F.array(*[F.lit(i) for i in range(len(names))])))
           .withColumns({"fit": (F.col("_v") * n_folds * 10 + F.col("fold_id") * 10 + F.col("_k")).cast("bigint"), "variant": label})
           .withColumn("pf", F.floor(F.col("fit") / 10)))

    # Rows are taken once per fold and block; a fit sums the moments and unites the draws of the blocks it trains on.
    pieces = train.withColumn("fit", (F.col("fold_id") * 10 + b).cast("bigint")).select("fit", "row_id", "vec", "y")
    used, parts = {}, {}
    for i, name in enumerate(names):
        mask = np.array([c in variants[name] or c not in V1_COLS for c in features])
        for f in range(n_folds):
            for k in range(1, final + 1):
                fit = i * n_folds * 10 + f * 10 + k
                used[fit], parts[fit] = mask, [f * 10 + j for j in range(k)]
    asked = ask.select("fit", "pf", "row_id", "part", "variant", "fold_id", "test_year", "asof_date", "sector", "y", "adverse_20", "severe_30", "vec")
    scores = CM.committee_scores(pieces, asked, len(features), plan.alpha, plan.k, used, parts)
    return materialise(scores.drop("ridge", "knn"), "scores")


def evaluate_folds_detailed(snapshots: DataFrame, plan: FoldPlan = FoldPlan(), features: list[str] | None = None,
                            variants: dict[str, list[str]] | None = None) -> DataFrame:
    """Test rows of every variant and fold with p_tail, thresholds and action."""
    variants = variants or {"A_full": V1_COLS}
    labelled = snapshots.where((F.col("street") == "RIVER") & F.col("risk_severity").isNotNull())
    features = features or feature_columns(labelled)
    rows = materialise(river_rows(snapshots, features), "river")
    scored = _scored_folds(rows, plan, features, variants)
    oof = scored.where(F.col("part") == "oof")
    calibrated = materialise(K.fit_apply("isotonic", oof, scored, "score", "adverse_20", "pf", "p_tail"), "p_tail")
    best = P.optimise_thresholds(calibrated.where(F.col("part") == "oof"), "p_tail", plan.constraints, ["pf"]).select(
        "pf", "fold_min", "small_bet_min", F.col("false_safe_rate").alias("oof_fsr"))
    # one threshold row per variant and fold
    tested = calibrated.where(F.col("part") == "test").join(F.broadcast(best), "pf")
    return tested.withColumn("action", X.action_of(F.col("p_tail"), F.col("fold_min"), F.col("small_bet_min"))).select(
        "variant", "fold_id", "test_year", "row_id", "sector", "score", "p_tail", "action", "severe_30", "adverse_20",
        "fold_min", "small_bet_min", "oof_fsr")


def fold_metrics(detailed: DataFrame) -> DataFrame:
    """One row per variant and fold: thresholds, mix, false-safe rate, detection, skill."""
    keys = ["variant", "fold_id", "test_year", "fold_min", "small_bet_min", "oof_fsr"]
    return M.policy_metrics(detailed, keys)


def stability_report(snapshots: DataFrame, plan: FoldPlan = FoldPlan(), **kw) -> tuple[DataFrame, DataFrame]:
    """(fold metrics, acceptance gates)."""
    metrics = materialise(fold_metrics(evaluate_folds_detailed(snapshots, plan, **kw)), "folds")
    return metrics, M.acceptance_gates(metrics, ["variant"])


def ablation_report(snapshots: DataFrame, plan: FoldPlan = FoldPlan(), **kw) -> tuple[DataFrame, DataFrame]:
    """(metrics per variant and fold with deltas to the baseline, done-criteria per variant)."""
    metrics = materialise(fold_metrics(evaluate_folds_detailed(snapshots, plan, variants=VARIANTS, **kw)), "ablation")
    return M.deltas_to_baseline(metrics), M.ablation_gates(metrics, len(plan.folds) - 1)


# ---- one split: train+val against test -----------------------------------------------------------

def oof_scores(rows: DataFrame, width: int, n_splits: int = 3, alpha: float = 1000.0, k: int = 7) -> DataFrame:
    """Out-of-fold committee scores over expanding blocks: (row_id, ..., fold_id, ridge, knn, score)."""
    blocks = materialise(temporal_blocks(rows, ["asof_date", "row_id"], n_splits + 1), "blocks")
    keyed = blocks.withColumn("fit", F.col("block").cast("bigint")).drop("block")
    parts = {k: list(range(k)) for k in range(1, n_splits + 1)}
    scores = CM.committee_scores(keyed.select("fit", "row_id", "vec", "y"), CM.dealt(keyed.where("fit >= 1")), width, alpha, k, parts=parts)
    return scores.withColumn("fold_id", F.col("fit").cast("int")).drop("fit")


def committee_on_split(rows: DataFrame, is_train, width: int, alpha: float = 1000.0, k: int = 7) -> DataFrame:
    """Scores of every row (train and held out) under the committee fitted on the ``is_train`` rows."""
    one = rows.withColumn("fit", F.lit(0).cast("bigint"))
    return CM.committee_scores(one.where(is_train).select("fit", "row_id", "vec", "y"), CM.dealt(one), width, alpha, k).drop("fit")


def challengers(snapshots_split: DataFrame, features: list[str], n_splits: int = 3, n_cal_folds: int = 3,
                constraints: P.Constraints = CHALLENGER) -> DataFrame:
    """Calibrated and ranking challengers on nested out-of-fold scores, with their gates.

    Below the gate on severe events nothing is calibrated: the ranking challenger alone is tuned, on all out-of-fold scores.
    """
    rows = materialise(river_rows(snapshots_split, features), "river")
    oof = materialise(oof_scores(rows, len(features), n_splits), "oof")

    def ranked(scores: DataFrame) -> DataFrame:
        return P.optimise_rank_policy(scores, "score", constraints).withColumns({
            "name": F.lit("ranking"), "brier": F.lit(None).cast("double"), "bss": F.lit(None).cast("double"),
            "n_unique": F.lit(None).cast("bigint")})

    if not P.enough_events(rows).first()["should_calibrate"]:
        return P.challenger_gates(ranked(oof))
    order = ["asof_date", "row_id"]
    cal = materialise(K.oof_calibrated(oof, "score", "adverse_20", order, n_cal_folds), "cal")
    skills = K.skill_by_method(cal, "adverse_20")
    levels = cal.groupBy("method").agg(M.distinct_levels("p").alias("n_unique"))
    best = P.optimise_thresholds(cal, "p", constraints, ["method"])
    calibrated = best.join(skills.select("method", "brier", "bss"), "method").join(levels, "method").withColumnRenamed("method", "name")
    return P.challenger_gates(calibrated.unionByName(ranked(cal.where(F.col("method") == "binned"))))


def holdout_evaluation(snapshots: DataFrame, features: list[str], champion: dict, is_train, n_splits: int = 3) -> DataFrame:
    """One-look report of the champion on held-out rows.

    A ranking champion takes its thresholds from the train scores' quantiles; a calibrated one is
    refitted on all out-of-fold scores.
    """
    rows = materialise(river_rows(snapshots, features, keep=(is_train.alias("_train"),)), "split")
    scored = materialise(committee_on_split(rows, F.col("_train"), len(features)), "final")
    held = scored.where(~F.col("_train"))
    if champion["name"] == "ranking":
        acted = P.assign_by_rank(held, "score", champion["fold_min"], champion["small_bet_min"],
                                 reference=scored.where("_train")).withColumn("p_tail", F.col("score"))
    else:
        oof = oof_scores(rows.where("_train").drop("_train"), len(features), n_splits).withColumn("_g", F.lit(0))
        p = K.fit_apply(champion["name"], oof, held.withColumn("_g", F.lit(0)), "score", "adverse_20", "_g", "p_tail")
        acted = P.with_action(p, "p_tail", P.ActionThresholds(champion["fold_min"], champion["small_bet_min"]))
    report = M.policy_metrics(acted, [])
    if champion["name"] == "ranking":
        report = report.withColumn("bss", F.lit(None).cast("double"))
    return report.withColumn("champion", F.lit(champion["name"]))


def shift_test(oof: DataFrame, score: str, label: str, order: list[str], shift: int = 5, n_folds: int = 3) -> DataFrame:
    """One row: best skill with the labels moved ``shift`` rows on, next to the real one."""
    real = K.skill_by_method(K.oof_calibrated(oof, score, label, order, n_folds), label).agg(F.max("bss").alias("real_bss"))
    moved = rolled(oof, order, label, shift, "_moved").drop(label).withColumnRenamed("_moved", label)
    shifted = K.skill_by_method(K.oof_calibrated(moved, score, label, order, n_folds), label).agg(F.max("bss").alias("shift_bss"))
    return real.join(F.broadcast(shifted)).withColumn("shift_destroys_signal", F.col("shift_bss") < F.col("real_bss"))  # single rows


def street_baselines(train: DataFrame, test: DataFrame, label: str = "risk_severity", event: str = "adverse_20") -> DataFrame:
    """Constant-mean error and climatology Brier per street, fitted on train and scored on test."""
    fitted = train.where(F.col(label).isNotNull()).groupBy("street").agg(
        F.avg(label).alias("mean"), F.avg(F.col(event).cast("double")).alias("base"))
    err = F.col(label) - F.col("mean")
    gap = F.col(event) - F.col("base")
    # three rows, one per street
    return test.where(F.col(label).isNotNull()).join(F.broadcast(fitted), "street").groupBy("street").agg(
        F.count(F.lit(1)).alias("n_test"), F.avg(F.abs(err)).alias("constant_mae"), F.avg(err * err).alias("constant_mse"),
        F.avg(gap * gap).alias("brier_climatology"))


def river_baselines(rows: DataFrame, is_train, width: int, alpha: float = 1000.0, k: int = 7) -> DataFrame:
    """Ridge and neighbour errors, and the Brier skill of the clipped linear probability, on held-out rows."""
    base = rows.where(is_train).agg(F.avg(F.col("adverse_20").cast("double"))).first()[0]
    scored = committee_on_split(rows.withColumn("_train", is_train), F.col("_train"), width, alpha, k).where(~F.col("_train"))
    long = scored.select("y", "adverse_20", F.inline(F.array(
        F.struct(F.lit("ridge").alias("model"), F.col("ridge").alias("pred")),
        F.struct(F.lit("knn").alias("model"), F.col("knn").alias("pred")))))
    err = F.col("pred") - F.col("y")
    out = long.withColumn("p", X.crude_probability(F.col("pred"))).groupBy("model").agg(
        F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), M.brier("p", "adverse_20").alias("brier"),
        M.climatology_brier("adverse_20", F.lit(base)).alias("brier_climatology"))
    return out.withColumn("bss", M.skill(F.col("brier"), F.col("brier_climatology")))


# ---- the whole run, from snapshots to a manifest row ------------------------------------------------

FULL_RUN = P.Constraints(0.10, min_size_up_pct=0.10, min_small_bet_pct=0.0, max_fold_pct=0.80)


def full_run(snapshots: DataFrame, features: list[str] | None = None, *, n_splits: int = 3, n_boot: int = 1000,
             n_perm: int = 100, seed: int = 42, tune_on: str = "in_sample", train_frac: float = 0.6,
             val_frac: float = 0.2) -> DataFrame:
    """One manifest row: split sizes, row-set hash of each split, calibrator, thresholds, held-out metrics, leakage checks.

    Train and val rows fit and tune, test rows are looked at once. With fewer severe events than
    the gate asks for, the rank policy takes the place of calibration. ``tune_on`` picks the
    thresholds on in-sample probabilities or on the out-of-fold ones.
    """
    split = materialise(temporal_split(snapshots, train_frac, val_frac), "split")
    fit_part = F.col("split") != "test"
    labelled = (F.col("street") == "RIVER") & F.col("risk_severity").isNotNull()
    features = features or feature_columns(split.where(labelled & fit_part), exclude=(*vocab.NON_FEATURES, "split"))
    rows = materialise(river_rows(split, features, keep=("split",)), "river")
    sizes = rows.agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")]).first()
    oof = materialise(oof_scores(rows.where(fit_part), len(features), n_splits), "oof")
    scored = materialise(committee_on_split(rows, fit_part, len(features)).withColumn("_g", F.lit(0)), "final")
    trained, tested = scored.where(fit_part), scored.where(~fit_part)
    order = ["asof_date", "row_id"]
    calibrated = P.enough_events(rows.where(fit_part)).first()["should_calibrate"]
    skills = {m: None for m in K.METHODS}
    chosen, thresholds, bss = None, None, None
    if calibrated:
        pick = K.hardened_selection(oof, "score", "adverse_20", order, n_splits, n_boot=n_boot, seed=seed).first()
        chosen, skills = pick["selected"], {m: pick[f"bss_{m}"] for m in K.METHODS}
        fitted = oof.withColumn("_g", F.lit(0))
        tuned_rows = trained if tune_on == "in_sample" else fitted
        tuned = K.fit_apply(chosen, fitted, tuned_rows, "score", "adverse_20", "_g", "p_tail")
        best = P.optimise_thresholds(tuned, "p_tail", FULL_RUN).first()
        thresholds = P.ActionThresholds(best["fold_min"], best["small_bet_min"])
        held = K.fit_apply(chosen, fitted, tested, "score", "adverse_20", "_g", "p_tail")
        acted = P.with_action(held, "p_tail", thresholds)
    else:
        acted = P.assign_by_rank(tested, "score", reference=trained).withColumn("p_tail", F.col("score"))
    acted = materialise(acted, "acted")
    report = M.policy_metrics(acted, [])
    actions = acted.agg(*[F.count_if(F.col("action") == a).alias(f"n_{a.lower()}") for a in ("FOLD", "SMALL_BET", "SIZE_UP")])
    hashes = {s: content_hash(split.where(F.col("split") == s)).first()["content_hash"] for s in ("train", "val", "test")}
    shuffled = shuffle_columns(oof, order, n_perm, n_splits, seed)
    shifted = shift_test(oof, "score", "adverse_20", order, 5, n_splits).select("shift_bss", "shift_destroys_signal")
    bss = F.col("bss") if calibrated else F.lit(None).cast("double")
    return report.join(F.broadcast(actions)).join(F.broadcast(shuffled)).join(F.broadcast(shifted)).select(  # single rows
        F.lit(seed).alias("seed"), *[F.lit(sizes[s]).alias(f"river_{s}") for s in ("train", "val", "test")],
        *[F.lit(hashes[s]).cast("string").alias(f"dataset_hash_{s}") for s in hashes],
        F.lit(len(features)).alias("n_features"),
        F.array(*[F.lit(c) for c in features]).alias("feature_cols"),
        F.lit("calibrated" if calibrated else "ranking").alias("calibration_mode"), F.lit(chosen).cast("string").alias("calibrator"),
        *[F.lit(skills[m]).cast("double").alias(f"oof_bss_{m}") for m in K.METHODS],
        F.lit(thresholds.fold_min if thresholds else None).cast("double").alias("fold_min"),
        F.lit(thresholds.small_bet_min if thresholds else None).cast("double").alias("small_bet_min"),
        bss.alias("test_bss"), F.col("fsr").alias("test_false_safe_rate"), F.col("detection").alias("test_adverse_detection"),
        "n_fold", "n_small_bet", "n_size_up", "fold_pct", "small_bet_pct", "size_up_pct", "real_bss", "p_value", "shift_bss", "shift_destroys_signal")


def shuffle_columns(oof: DataFrame, order: list[str], n_perm: int, n_splits: int, seed: int) -> DataFrame:
    return K.shuffle_test(oof, "score", "adverse_20", order, n_perm, n_splits, seed).select("real_bss", "p_value")
