"""Scores, drift diagnostics and acceptance gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstprint.functions import columns as X
from firstprint.operators.policy import report_columns


def brier(p: str, y: str) -> Column:
    return F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))


def climatology_brier(y: str, base: Column | None = None) -> Column:
    """Brier score of always saying ``base`` (default: the rows' own mean)."""
    mean = F.avg(F.col(y).cast("double"))
    if base is None:
        return mean * (1 - mean)
    return base * base - 2 * base * mean + F.avg((F.col(y) * F.col(y)).cast("double"))


def skill(bs: Column, climatology: Column) -> Column:
    return F.when(climatology > 0, 1 - bs / climatology).otherwise(0.0)


def brier_report(df: DataFrame, p: str, y: str, group=(), base_rate: float | None = None) -> DataFrame:
    out = df.groupBy(*group).agg(
        brier(p, y).alias("brier"),
        climatology_brier(y, None if base_rate is None else F.lit(base_rate)).alias("brier_climatology"),
    )
    return out.withColumn("bss", skill(F.col("brier"), F.col("brier_climatology")))


def distinct_levels(p: str, digits: int = 4) -> Column:
    return F.count_distinct(F.bround(p, digits))


def error_report(df: DataFrame, pred: str, label: str, group: str) -> DataFrame:
    """MAE and MSE per group and over all rows (group ``_overall``), one rollup."""
    err = F.col(pred) - F.col(label)
    return (
        df.withColumn("_g", F.col(group).cast("string")).rollup("_g")
        .agg(F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), F.grouping("_g").alias("_all"))
        .select(F.when(F.col("_all") == 1, "_overall").otherwise(F.col("_g")).alias("group_value"), "mae", "mse")
    )


def base_rates(df: DataFrame, labels=("adverse_20", "severe_30"), by: str = "street") -> DataFrame:
    """(label, street, n_pos, n, rate) over labelled rows; one pass, labels unpivoted after."""
    row = df.groupBy(by).agg(*[
        F.struct(F.sum(F.col(c).cast("bigint")).alias("n_pos"), F.count(c).alias("n")).alias(c) for c in labels
    ])
    rows = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"{c}.n_pos"), F.col(f"{c}.n")) for c in labels])
    return (
        row.select(by, F.inline(rows)).where(F.col("n") > 0)
        .withColumn("rate", F.col("n_pos").cast("double") / F.col("n"))
    )


def sector_report(df: DataFrame, group=("fold_id", "sector")) -> DataFrame:
    """Per-sector rates and action mix; detection and false-safe rate are null without events."""
    a, sev, adv = F.col("action"), F.col("severe_30") == 1, F.col("adverse_20") == 1
    n = F.count(F.lit(1))
    share = {name: X.ratio(F.count_if(a == name), n) for name in ("FOLD", "SMALL_BET", "SIZE_UP")}
    return df.groupBy(*group).agg(
        n.alias("n"),
        F.avg(F.col("severe_30").cast("double")).alias("severe_rate"),
        F.avg(F.col("adverse_20").cast("double")).alias("adverse_rate"),
        F.try_divide(F.count_if(adv & (a == "FOLD")).cast("double"), F.count_if(adv).cast("double")).alias("detection"),
        F.try_divide(F.count_if(sev & (a == "SIZE_UP")).cast("double"), F.count_if(sev).cast("double")).alias("false_safe_rate"),
        share["FOLD"].alias("fold_pct"), share["SMALL_BET"].alias("small_bet_pct"), share["SIZE_UP"].alias("size_up_pct"),
    )


def calibration_by_fold(df: DataFrame, p: str = "p_tail", y: str = "adverse_20", group: str = "fold_id") -> DataFrame:
    """Mean forecast against mean outcome, and the slope as sample covariance over population variance."""
    yd = F.col(y).cast("double")
    var = F.var_pop(p)
    return df.groupBy(group).agg(
        F.avg(p).alias("mean_p"), F.avg(yd).alias("mean_y"),
        F.when(F.avg(yd) > 0, F.avg(p) / F.avg(yd)).alias("ratio"),
        F.when(var > 0, F.covar_samp(F.col(p), yd) / var).alias("slope"),
        F.regr_slope(yd, F.col(p)).alias("ols_slope"),
    )


def reweighted_detection(df: DataFrame, target_fold: int, fold: str = "fold_id", sector: str = "sector") -> DataFrame:
    """Detection of each earlier fold under the target fold's sector mix, with its actual detection.

    Sectors without adverse rows in the source fold are skipped and the weights renormalised.
    Both join sides are aggregates of at most folds x sectors rows.
    """
    adv = F.col("adverse_20") == 1
    cells = df.groupBy(fold, sector).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(adv).alias("n_adv"),
        F.count_if(adv & (F.col("action") == "FOLD")).alias("n_hit"),
    )
    weights = cells.where(F.col(fold) == target_fold).select(sector, F.col("n").cast("double").alias("w"))
    w = F.when(F.col("n_adv") > 0, F.col("w"))
    return (
        cells.where(F.col(fold) < target_fold).join(weights, sector, "left")
        .groupBy(fold).agg(
            X.ratio(F.sum("n_hit"), F.sum("n_adv")).alias("actual_detection"),
            X.ratio(F.sum(w * F.col("n_hit") / F.col("n_adv")), F.sum(w)).alias("reweighted_detection"),
        )
    )


def acceptance_gates(folds: DataFrame, group=(), max_median_fsr=0.10, max_worst_fsr=0.15, min_median_small=0.10) -> DataFrame:
    """Stability gates over fold metrics (a handful of rows)."""
    def median(c: str) -> Column:
        return F.percentile(c, F.lit(0.5))

    out = folds.groupBy(*group).agg(
        (median("fsr") <= max_median_fsr).alias("med_fsr_pass"),
        (F.max("fsr") <= max_worst_fsr).alias("worst_fsr_pass"),
        (median("bss") > 0).alias("med_bss_pass"),
        (median("small_bet_pct") >= min_median_small).alias("med_small_pass"),
    )
    names = ["med_fsr_pass", "worst_fsr_pass", "med_bss_pass", "med_small_pass"]
    return out.withColumn("all_pass", F.forall(F.array(*names), lambda g: g))


def deltas_to_baseline(metrics: DataFrame, values=("bss",), variant: str = "variant", fold: str = "fold_id",
                       baseline: str = "baseline") -> DataFrame:
    """Adds ``d_{value}``: the variant's value minus the baseline's in the same fold."""
    base = metrics.where(F.col(variant) == baseline).select(fold, *[F.col(v).alias(f"_b_{v}") for v in values])
    return (
        metrics.join(base, fold, "left")
        .withColumns({f"d_{v}": F.col(v) - F.col(f"_b_{v}") for v in values})
        .drop(*[f"_b_{v}" for v in values])
    )


def ablation_gates(metrics: DataFrame, last_fold: int = 3, max_fsr=0.10, min_lift=0.05, min_small=0.08) -> DataFrame:
    """Done-criteria per variant: worst false-safe rate, last-fold skill lift, sector safety, small-bet share."""
    full = deltas_to_baseline(metrics, ("bss", "tech_fsr"))
    last = F.col("fold_id") == last_fold
    out = full.where(F.col("variant") != "baseline").groupBy("variant").agg(
        F.max("fsr").alias("worst_fsr"),
        F.max(F.when(last, F.col("d_bss"))).alias("last_fold_lift"),
        F.max(F.when(last, F.col("d_tech_fsr"))).alias("last_fold_d_tech_fsr"),
        F.percentile("small_bet_pct", F.lit(0.5)).alias("median_small_bet"),
    )
    gates = {
        "fsr_pass": F.col("worst_fsr") <= max_fsr,
        "lift_pass": F.col("last_fold_lift") >= min_lift,
        "tech_pass": F.col("last_fold_d_tech_fsr") <= 0,
        "small_pass": F.col("median_small_bet") >= min_small,
    }
    return out.withColumns(gates).withColumn("all_pass", F.forall(F.array(*gates), lambda g: g))


def policy_metrics(df: DataFrame, group: list[str], p: str = "p_tail", y: str = "adverse_20",
                   watched_sector: str = "technology") -> DataFrame:
    """Action mix, false-safe rate (overall and of one watched sector), detection and Brier skill per group."""
    out = df.groupBy(*group).agg(
        *report_columns(), brier(p, y).alias("_bs"), climatology_brier(y).alias("_bc"),
        F.sum(F.col("severe_30").cast("bigint")).alias("n_severe"),
        X.ratio(
            F.count_if((F.col("sector") == watched_sector) & (F.col("severe_30") == 1) & (F.col("action") == "SIZE_UP")),
            F.count_if((F.col("sector") == watched_sector) & (F.col("severe_30") == 1)),
        ).alias("tech_fsr"),
    )
    return out.withColumn("bss", skill(F.col("_bs"), F.col("_bc"))).drop("_bs", "_bc").withColumnsRenamed(
        {"false_safe_rate": "fsr", "adverse_detection_rate": "detection"}
    )
