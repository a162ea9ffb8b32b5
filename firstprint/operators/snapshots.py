"""Snapshot table: one row per symbol and street with accumulated features, labels and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firstprint.functions import columns as X
from firstprint.functions import vocab
from firstprint.operators import bars as B
from firstprint.operators import context as C
from firstprint.operators.ordering import exact_quantiles
from firstprint.session import materialise

STREET_FEATURES = vocab.DAILY_FEATURES + vocab.REGIME_FEATURES


def label_at_asof(labelled: DataFrame, asof: DataFrame) -> DataFrame:
    """Forward labels of the bar dated ``asof_date`` per (symbol, street)."""
    labels = [c for c in labelled.columns if c.startswith("forward_")]
    return asof.select("symbol", "street", "asof_date").join(
        labelled.select("symbol", F.to_date("ts").alias("asof_date"), *labels), ["symbol", "asof_date"], "left"
    )


def accumulate_streets(per_street: DataFrame, features=STREET_FEATURES) -> DataFrame:
    """Widens per-street features to ``{street}_{feature}`` and carries earlier streets forward.

    Later streets stay null on an earlier street's row; a skipped street contributes nothing.
    """
    rank = X.street_rank(F.col("street"))
    w = Window.partitionBy("symbol").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    df = per_street.withColumn("_rank", rank)
    carried = {}
    for street in vocab.STREETS:
        packed = F.when(F.col("street") == street, F.struct(*features))
        carried[f"_{street}"] = F.last(packed, ignorenulls=True).over(w)
    df = df.withColumns(carried)
    wide = {
        f"{street.lower()}_{f}": F.col(f"_{street}.{f}") for street in vocab.STREETS for f in features
    }
    return df.withColumns(wide).drop("_rank", *carried, *features)


def build_snapshots(bars: DataFrame, listings: DataFrame, index_bars: DataFrame, *, market: str,
                    sector_index, horizons=(7, 20), lengths: B.StreetLengths = B.StreetLengths(),
                    history_days: int | None = None, universe: DataFrame | None = None,
                    with_preflop: bool = True) -> DataFrame:
    """All symbols at once: sessions -> street features, context, labels, flags -> wide rows.

    ``sector_index`` maps a sector Column to an index symbol Column. One shuffle of the bars on
    ``symbol`` serves every window and aggregation here; only the listing-sized context lookups add more.
    Bars count up to ``history_days`` calendar days after listing; by default HISTORY_DAYS and the longest horizon.
    """
    if history_days is None:
        history_days = vocab.HISTORY_DAYS + max(horizons)
    calendar = C.index_calendar(index_bars)
    sessions = B.with_quality_flags(B.index_sessions(bars, listings, lengths, history_days))
    near = sessions.where(F.col("day_index") < lengths.total + max(horizons))
    labels = [f"forward_{kind}_{h}d" for h in horizons for kind in ("mdd", "mfr")]
    flags = ["bar_count_1d", "zero_volume_pct", "median_daily_volume"]
    asof_bar = F.struct("d", (-F.unix_micros("ts")).alias("_first_of_day"))
    per_street = B.daily_features(
        B.forward_extremes(near, horizons).where(F.col("street").isNotNull()),
        extra=(F.min("d").alias("win_start"), F.max("d").alias("asof_date"),
               F.max_by(F.struct(*labels, *flags), asof_bar).alias("_asof")),
    ).where(F.col("bars") >= 2)

    facts = listings
    if with_preflop:
        facts = C.preflop_features(listings, calendar, market, sector_index(F.col("sector")), universe)
    pre_cols = list(vocab.PREFLOP_FEATURES) if with_preflop else []
    facts = facts.select("symbol", "ipo_date", "sector", *pre_cols)
    per_street = per_street.join(facts, "symbol").withColumn("win_end", F.date_add("asof_date", 1))
    per_street = C.regime_features(per_street, calendar, market, sector_index(F.col("sector")))
    per_street = (
        per_street.withColumn("_market_ok", F.min("spy_n").over(Window.partitionBy("symbol")) > 0)
        .where("_market_ok")
        .select("symbol", "street", "asof_date", "ipo_date", "sector", *pre_cols, *STREET_FEATURES, "_asof.*")
    )
    wide = accumulate_streets(per_street)
    out = X.with_event_labels(wide) if 20 in horizons else wide
    street_cols = [f"{s.lower()}_{f}" for s in vocab.STREETS for f in STREET_FEATURES]
    derived = ["risk_severity", "adverse_20", "severe_30"] if 20 in horizons else []
    return out.select(
        "symbol", "street", "asof_date", "ipo_date", "sector", *pre_cols, *street_cols, *labels,
        "bar_count_1d", "zero_volume_pct", "median_daily_volume", *derived,
    )


def build_audit(listings: DataFrame, bars: DataFrame, snapshots: DataFrame,
                lengths: B.StreetLengths = B.StreetLengths()) -> DataFrame:
    """One row per listing: status, streets built, and why nothing was built.

    Why is asked only of listings without a snapshot: they are written out, so that their size is known and few of them
    are sent to the bars, and no other bar is shuffled or counted.
    """
    built = snapshots.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_snapshots"),
        *[F.bool_or(F.col("street") == s).alias(f"has_{s.lower()}") for s in vocab.STREETS],
    )
    unbuilt = materialise(listings.join(built, "symbol", "left_anti").select("symbol", "ipo_date"), "unbuilt")
    day = F.to_date("ts")
    seen = bars.join(unbuilt, "symbol").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_bars"),
        F.nullif(F.count_distinct(F.when(day >= F.col("ipo_date"), day)), F.lit(0)).alias("_days"),
    )
    n = F.coalesce(F.col("n_snapshots"), F.lit(0))
    error = (
        F.when(n > 0, F.lit(""))
        .when(F.col("_bars").isNull(), "No bar data")
        .when(F.col("_days").isNull(), "no_snapshots_built")
        .when(F.col("_days") < lengths.flop, "Not enough trading days to form FLOP window")
        .otherwise("No bars for this index")
    )
    return (
        listings.join(seen, "symbol", "left").join(built, "symbol", "left")
        .select(
            "symbol", "ipo_date", X.era_label(F.year("ipo_date")).alias("era"), "sector", "sic",
            F.when(n == 3, "success")
            .when((n > 0) | (error == "no_snapshots_built"), "partial").otherwise("failed").alias("status"),
            n.cast("bigint").alias("n_snapshots"),
            *[F.coalesce(F.col(f"has_{s.lower()}"), F.lit(False)).alias(f"has_{s.lower()}") for s in vocab.STREETS],
            error.alias("error"),
        )
    )


def audit_gates(audit: DataFrame, min_river_rate: float = 0.70, total_universe: int | None = None) -> DataFrame:
    """One row: counts, share of symbols reaching the last street, the same per era, failure reasons.

    With an ``elapsed_sec`` column the run time is extrapolated to ``total_universe`` symbols.
    """
    n = F.count(F.lit(1))
    river = F.count_if("has_river")
    cols = [
        n.alias("pilot_n"),
        F.count_if(F.col("status") == "success").alias("success_count"),
        river.alias("river_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"),
        X.ratio(river, n).alias("river_rate"),
        (X.ratio(river, n) >= min_river_rate).alias("river_gate_pass"),
    ]
    if "elapsed_sec" in audit.columns:
        mean = F.coalesce(F.avg("elapsed_sec"), F.lit(0.0))
        cols += [mean.alias("avg_sec_per_symbol"),
                 (mean * F.coalesce(F.lit(total_universe), n) / 3600).alias("estimated_full_run_hours")]
    for name, *_ in vocab.ERAS:
        here = F.col("era") == name
        key = name.replace("-", "_")
        cols += [F.count_if(here).alias(f"era_{key}_n"),
                 X.ratio(F.count_if(here & F.col("has_river")), F.count_if(here)).alias(f"era_{key}_river_rate")]
    return audit.agg(*cols)


def failure_reasons(audit: DataFrame) -> DataFrame:
    return (
        audit.where(F.col("error") != "")
        .groupBy(F.trim(F.split_part("error", F.lit(":"), F.lit(1))).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def drop_matching(df: DataFrame, prefixes=(), names=(), keep=()) -> DataFrame:
    """``df`` without the columns that start with one of ``prefixes`` or are in ``names``; those in ``keep`` stay.

    Running it again changes nothing, and columns that are not there are no error.
    """
    return df.drop(*[c for c in df.columns if (c.startswith(tuple(prefixes)) or c in names) and c not in keep])


def augment_with_metadata(snapshots: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds the metadata features (nulls filled) and the sector one-hots; safe to run again.

    One metadata row per symbol: the earliest filing. Columns of an earlier run go first, by pattern. The lead-day fill
    is the median over all snapshot rows, an exact percentile over day counts, whose distinct values the calendar bounds.
    """
    one_hots = [f"preflop_sector_{s}" for s in vocab.ONE_HOT_SECTORS]
    base = drop_matching(snapshots, vocab.GENERATED_PREFIXES, vocab.METADATA_FEATURES, vocab.CONTEXT_COLUMNS)
    features = F.struct(*vocab.METADATA_FEATURES)
    per_symbol = (
        metadata.groupBy("symbol").agg(F.min_by(features, "s1_filing_date").alias("_m")).select("symbol", "_m.*")
    )
    joined = base.join(per_symbol, "symbol", "left")
    median = joined.agg(F.coalesce(F.percentile("preflop_s1_lead_days", F.lit(0.5)), F.lit(0.0)).alias("_median"))
    fill = {"preflop_s1_lead_days": F.col("_median"), "preflop_exchange_nyse": F.lit(0.0),
            "preflop_exchange_nasdaq": F.lit(0.0), "preflop_s1a_count": F.lit(0.0),
            "preflop_days_since_last_amendment": F.lit(-1.0)}
    filled = (
        joined.join(F.broadcast(median))  # exactly one row
        .withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()}).drop("_median")
    )
    return filled.withColumns({
        name: (F.col("sector") == s).cast("double") for name, s in zip(one_hots, vocab.ONE_HOT_SECTORS)
    })


def backfill_context(snapshots: DataFrame, listings: DataFrame, index_bars: DataFrame, sector_index) -> DataFrame:
    """Recomputes the sector-heat and pre-listing sector-return columns and joins them back by symbol."""
    calendar = C.index_calendar(index_bars)
    fresh = C.with_sector_heat(listings)
    fresh = C.with_pre_listing_stats(fresh, calendar, sector_index(F.col("sector")), "preflop_sector")
    names = list(vocab.CONTEXT_COLUMNS)
    return (
        snapshots.drop(*names).join(fresh.select("symbol", *names), "symbol", "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in names})
    )


def null_report(df: DataFrame, columns, spread: bool = False) -> DataFrame:
    """(column_name, nulls, mean) of numeric columns from one pass; ``spread`` adds median, min and max.

    The exact medians of all columns come from one distributed order of their distinct values, so continuous columns of
    any size will do. A column without values has a null median.
    """
    columns = list(columns)

    def facts(c):
        more = {"min": F.min(c).cast("double"), "max": F.max(c).cast("double")} if spread else {}
        return {"nulls": F.count_if(F.col(c).isNull()), "mean": F.avg(c), **more}

    row = df.agg(*[F.struct(*[v.alias(n) for n, v in facts(c).items()]).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}.{n}") for n in facts(c)]) for c in columns])
    table = row.select(F.inline(rows))
    if not spread:
        return table
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])))
    medians = exact_quantiles(values, "value", [0.5], ["column_name"]).select("column_name", F.col("quantiles")[0].alias("median"))
    # one row per column
    return table.join(F.broadcast(medians), "column_name", "left").select("column_name", "nulls", "mean", "median", "min", "max")


def feature_columns(df: DataFrame, exclude=vocab.NON_FEATURES, drop=()) -> list[str]:
    """Names of the columns that are no key, label or flag and hold no null; one aggregation pass."""
    candidates = [c for c in df.columns if c not in exclude and c not in drop]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in candidates]).first()
    return [c for c in candidates if counts[c] == 0]
