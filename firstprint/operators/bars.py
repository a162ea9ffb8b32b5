"""Street windows, price features and forward labels over bar series.

A bar series holds one bar per symbol and time bucket, so a per-symbol window is bounded by the
calendar (a century of daily bars is 36,525 rows) whatever share of the raw prints the symbol has.
Duplicates are folded away by ``normalise_bars`` with map-side aggregation before any window runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstprint.functions import vocab


@dataclass(frozen=True)
class StreetLengths:
    flop: int = vocab.FLOP_DAYS
    turn: int = vocab.TURN_DAYS
    river: int = vocab.RIVER_DAYS

    def __post_init__(self):
        if self.flop < 1 or self.turn < 0 or self.river < 0:
            raise ValueError("street lengths must be flop >= 1, turn >= 0, river >= 0")

    @property
    def total(self) -> int:
        return self.flop + self.turn + self.river


def normalise_bars(raw: DataFrame, symbol: str | None = None, seq: str = "ingest_seq") -> DataFrame:
    """Canonical bars; of rows with equal (symbol, ts) the one with the highest ``seq`` stays.

    ``max_by`` combines map-side, so a symbol holding a third of the input never meets one task whole.
    """
    if "timestamp" not in raw.columns:
        raise ValueError(f"expected column 'timestamp', got {raw.columns}")
    df = raw.withColumnRenamed("timestamp", "ts")
    df = df.withColumn("symbol", F.upper(F.col("symbol").cast("string")) if "symbol" in df.columns else F.lit(symbol))
    types = {"open": "double", "high": "double", "low": "double", "close": "double",
             "volume": "bigint", "vwap": "double", "trade_count": "bigint"}
    kept = [c for c in types if c in df.columns]
    if seq not in df.columns:
        raise ValueError(f"expected ordering column '{seq}': without it the last duplicate is undefined")
    body = F.struct(*[F.col(c).cast(types[c]).alias(c) for c in kept])
    return (
        df.select("symbol", F.col("ts").cast("timestamp").alias("ts"), body.alias("bar"), F.col(seq).alias("seq"))
        .groupBy("symbol", "ts").agg(F.max_by("bar", "seq").alias("bar"))
        .select("symbol", "ts", "bar.*")
    )


def index_sessions(bars: DataFrame, listings: DataFrame, lengths: StreetLengths = StreetLengths(),
                   history_days: int | None = None) -> DataFrame:
    """Bars from the listing on, with ``day_index`` (0 = first session), ``n_days`` and ``street``.

    ``bars`` needs (symbol, ts, ...), ``listings`` (symbol, ipo_date). ``history_days`` bounds the
    calendar span kept after listing. Symbols with fewer sessions than the first street are dropped.
    """
    d = F.to_date("ts")
    span = (d >= F.col("ipo_date"))
    if history_days is not None:
        span = span & (d < F.date_add("ipo_date", history_days))
    series = Window.partitionBy("symbol")
    k = F.col("day_index")
    # hashed, as a merge join would sort all bars by symbol only for the windows to sort them again; a task holds its share of listings
    return (
        bars.join(listings.select("symbol", "ipo_date").hint("shuffle_hash"), "symbol")
        .where(span)
        .withColumn("d", d)
        .withColumn("day_index", F.dense_rank().over(series.orderBy("d")) - 1)
        .withColumn("n_days", F.max("day_index").over(series) + 1)
        .where(F.col("n_days") >= lengths.flop)
        .withColumn(
            "street",
            F.when(k < lengths.flop, "FLOP")
            .when(k < lengths.flop + lengths.turn, "TURN")
            .when(k < lengths.total, "RIVER"),
        )
    )


def street_windows(sessions: DataFrame) -> DataFrame:
    """(symbol, street, win_start, win_end, asof_date, sessions): half-open day ranges per street."""
    return (
        sessions.where(F.col("street").isNotNull())
        .groupBy("symbol", "street")
        .agg(F.min("d").alias("win_start"), F.max("d").alias("asof_date"), (F.max("day_index") - F.min("day_index") + 1).alias("sessions"))
        .withColumn("win_end", F.date_add("asof_date", 1))
    )


def in_half_open(ts: Column, start: Column, end: Column) -> Column:
    return (ts >= start) & (ts < end)


def with_bar_columns(bars: DataFrame, by=("symbol", "street"), order: str = "ts") -> DataFrame:
    """Log return, range, dollar volume, overnight gap and running drawdown inside each ``by`` series.

    The first bar of a series has no return and no gap: nothing leaks across street boundaries.
    """
    w = Window.partitionBy(*by).orderBy(order)
    prev = F.col("_prev_close")
    peak = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        bars.withColumns({"_prev_close": F.lag("close").over(w), "_peak": peak})
        .withColumns({
            "log_return": F.ln("close") - F.ln(prev),
            "range": F.try_divide(F.col("high") - F.col("low"), F.col("close")),
            "dollar_volume": F.col("close") * F.col("volume"),
            "overnight_gap": F.try_divide(F.col("open") - prev, prev),
            "drawdown": F.try_divide(F.col("low") - F.col("_peak"), F.col("_peak")),
        })
        .drop("_prev_close", "_peak")
    )


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def daily_features(bars: DataFrame, by=("symbol", "street"), order: str = "ts", extra=()) -> DataFrame:
    """The eleven daily-bar features per ``by`` series; all null for a series of one bar.

    ``extra`` aggregates ride along in the same pass.
    """
    dv = F.col("dollar_volume")
    first, last = F.min_by(F.struct("open", "volume"), order), F.max_by(F.struct("close", "volume"), order)
    agg = with_bar_columns(bars, by, order).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        _zero(F.stddev_samp("log_return")).alias("realized_vol"),
        _zero(F.avg("range")).alias("range_mean"),
        _zero(F.avg("dollar_volume")).alias("dollar_volume_mean"),
        _zero(F.avg(F.when(dv > 0, F.abs("log_return") / dv))).alias("amihud_illiquidity"),
        first.alias("_first"), last.alias("_last"),
        F.min("drawdown").alias("max_drawdown"),
        _zero(F.min("log_return")).alias("worst_day_return"),
        _zero(F.max("log_return")).alias("best_day_return"),
        _zero(F.avg("overnight_gap")).alias("overnight_gap_mean"),
        *extra,
    )
    added = agg.columns[len(agg.columns) - len(extra):] if extra else []
    enough = F.col("_n") >= 2
    cum = F.try_divide(F.col("_last.close") - F.col("_first.open"), F.col("_first.open"))
    vol0 = F.col("_first.volume")
    full = agg.withColumns({
        "cum_return": cum,
        "trend_strength": F.when(F.col("realized_vol") != 0, cum / F.col("realized_vol")).otherwise(0.0),
        "volume_decay_ratio": F.when(vol0 > 0, F.try_divide(F.col("_last.volume").cast("double"), vol0.cast("double"))).otherwise(1.0),
    })
    return full.select(
        *by, F.col("_n").alias("bars"), *added,
        *[F.when(enough, F.col(c)).alias(c) for c in vocab.DAILY_FEATURES],
    )


def legacy_daily_features(bars: DataFrame, by=("symbol", "street"), order: str = "ts") -> DataFrame:
    """The older nine daily features: no guards, so a missing statistic stays null."""
    agg = with_bar_columns(bars, by, order).groupBy(*by).agg(
        F.stddev_samp("log_return").alias("realized_vol"),
        F.avg("range").alias("range_mean"),
        F.avg("dollar_volume").alias("dollar_volume_mean"),
        F.avg(F.try_divide(F.abs("log_return"), F.col("dollar_volume"))).alias("amihud_illiquidity"),
        F.min_by("open", order).alias("_open"), F.max_by("close", order).alias("_close"),
        F.min("drawdown").alias("max_drawdown_river"),
        F.min("log_return").alias("worst_day_return"),
        F.max("log_return").alias("best_day_return"),
    )
    cum = F.try_divide(F.col("_close") - F.col("_open"), F.col("_open"))
    vol = F.col("realized_vol")
    return agg.select(
        *by, "realized_vol", "range_mean", "dollar_volume_mean", "amihud_illiquidity",
        cum.alias("river_cum_return"),
        F.when(vol == 0, F.lit(0.0)).otherwise(cum / vol).alias("trend_strength"),
        "max_drawdown_river", "worst_day_return", "best_day_return",
    )


def _flag_columns() -> dict[str, Column]:
    return {
        "bar_count_1d": F.count(F.lit(1)),
        "zero_volume_pct": F.avg((F.col("volume") == 0).cast("double")),
        "median_daily_volume": F.percentile("volume", F.lit(0.5)),
    }


def _flag_units(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "bar_count_1d": F.col("bar_count_1d").cast("double"),
        "zero_volume_pct": F.col("zero_volume_pct") * 100,
    })


def quality_flags(bars: DataFrame, by: str = "symbol") -> DataFrame:
    """Bar count, share of zero-volume bars in percent, median volume per symbol (calendar-bounded)."""
    return _flag_units(bars.groupBy(by).agg(*[c.alias(n) for n, c in _flag_columns().items()]))


def with_quality_flags(bars: DataFrame, by: str = "symbol") -> DataFrame:
    """The same flags on every bar, from the partitioning the other per-symbol windows already have."""
    w = Window.partitionBy(by)
    return _flag_units(bars.withColumns({n: c.over(w) for n, c in _flag_columns().items()}))


def forward_extremes(bars: DataFrame, horizons=(7, 20), order: str = "ts", by=("symbol",)) -> DataFrame:
    """Adds ``forward_mdd_{h}d`` and ``forward_mfr_{h}d``: worst drop from a running peak, best rise
    from a running trough, over the next h bars; null where fewer than h bars follow.

    A span of 2L bars is joined from two spans of L bars, so h bars take about log2(h) ``lead``
    steps. All steps share one partitioning and one sort and stay in generated code; no arrays.
    """
    w = Window.partitionBy(*by).orderBy(order)
    parts = ("hi", "lo", "dd", "up")

    def columns(length: int) -> dict[str, str]:
        return {p: f"_{p}{length}" for p in parts}

    def joined(left: dict[str, str], right: dict[str, str]) -> dict[str, Column]:
        a, b = {k: F.col(v) for k, v in left.items()}, {k: F.col(v) for k, v in right.items()}
        whole = b["hi"].isNotNull() & a["hi"].isNotNull()
        drop = F.try_divide(b["lo"] - a["hi"], a["hi"])
        rise = F.try_divide(b["hi"] - a["lo"], a["lo"])
        return {
            "hi": F.when(whole, F.greatest(a["hi"], b["hi"])),
            "lo": F.when(whole, F.least(a["lo"], b["lo"])),
            "dd": F.when(whole, F.least(a["dd"], b["dd"], drop)),
            "up": F.when(whole, F.greatest(a["up"], b["up"], rise)),
        }

    def shifted(df: DataFrame, length: int, by_rows: int) -> tuple[DataFrame, dict[str, str]]:
        names = {p: f"_s_{p}" for p in parts}
        return df.withColumns({names[p]: F.lead(c, by_rows).over(w) for p, c in columns(length).items()}), names

    hi, lo = F.col("high"), F.col("low")
    one = columns(1)
    df = bars.withColumns({
        one["hi"]: hi, one["lo"]: lo,
        one["dd"]: F.try_divide(lo - hi, hi), one["up"]: F.try_divide(hi - lo, lo),
    })
    have = 1
    while have * 2 <= max(horizons):
        df, right = shifted(df, have, have)
        merged = joined(columns(have), right)
        df = df.withColumns({columns(have * 2)[p]: c for p, c in merged.items()})
        have *= 2
    for h in horizons:
        powers = [1 << i for i in reversed(range(h.bit_length())) if h >> i & 1]
        acc = {p: f"_h{h}_{p}" for p in parts}
        df = df.withColumns({acc[p]: F.col(c) for p, c in columns(powers[0]).items()})
        done = powers[0]
        for size in powers[1:]:
            df, right = shifted(df, size, done)
            df = df.withColumns({acc[p]: c for p, c in joined(acc, right).items()})
            done += size
        df = df.withColumns({
            f"forward_mdd_{h}d": F.lead(acc["dd"], 1).over(w),
            f"forward_mfr_{h}d": F.lead(acc["up"], 1).over(w),
        })
    return df.drop(*[c for c in df.columns if c.startswith("_")])


# ---- intraday -------------------------------------------------------------------------------

def opening_day_features(bars: DataFrame, by=("symbol", "d")) -> DataFrame:
    """Opening-session features from 5-minute bars, market hours only, one row per ``by`` key."""
    from firstprint.functions import columns as X

    hours = bars.where(X.in_market_hours(F.col("ts")))
    w = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    ts, early = F.col("ts"), F.date_format("ts", "HH:mm:ss") < vocab.FIRST_HOUR_END
    peak = F.max("high").over(w)
    agg = (
        hours.withColumn("_dd", F.try_divide(F.col("low") - peak, peak))
        .groupBy(*by).agg(
            F.min_by("open", "ts").alias("o"), F.max_by("close", "ts").alias("c"),
            F.max_by(F.when(early, F.col("close")), F.when(early, ts)).alias("hour_close"),
            F.coalesce(F.sum(F.when(early, F.col("volume"))), F.lit(0)).alias("hour_vol"),
            F.sum("volume").alias("vol"), F.sum("trade_count").alias("trades"),
            F.avg("vwap").alias("vw"), F.min("ts").alias("t0"),
            F.max(F.struct(F.col("high"), (-F.unix_micros(ts)).alias("t"))).alias("top"),
            F.min("_dd").alias("intraday_mdd"),
        )
    )
    ref = F.coalesce(F.col("hour_close"), F.col("o"))
    return agg.select(
        *by,
        F.try_divide(ref - F.col("o"), F.col("o")).alias("first_hour_return"),
        X.ratio(F.col("c") - ref, ref).alias("rest_of_day_return"),
        X.ratio(F.col("hour_vol"), F.col("vol")).alias("volume_first_hour_pct"),
        F.try_divide(F.col("vol").cast("double"), F.col("trades").cast("double")).alias("avg_trade_size"),
        F.try_divide(F.col("c") - F.col("vw"), F.col("vw")).alias("close_vs_vwap"),
        ((-F.col("top.t") - F.unix_micros("t0")) / F.lit(60000000.0)).alias("time_to_high_minutes"),
        "intraday_mdd",
    )


def hourly_to_daily(bars: DataFrame, by=("symbol",)) -> DataFrame:
    """Day open, close, high, low and volume per ``by`` key and calendar day."""
    return bars.groupBy(*by, F.to_date("ts").alias("d")).agg(
        F.min_by("open", "ts").alias("day_open"), F.max_by("close", "ts").alias("day_close"),
        F.max("high").alias("day_high"), F.min("low").alias("day_low"), F.sum("volume").alias("day_volume"),
    )


def early_week_features(bars: DataFrame, by=("symbol",)) -> DataFrame:
    """Overnight-gap, volume-decay and volatility features from hourly bars per ``by`` series."""
    from firstprint.functions import columns as X

    hours = bars.where(X.in_market_hours(F.col("ts")))
    prev = F.lag("day_close").over(Window.partitionBy(*by).orderBy("d"))
    gap = (F.col("prev_close").isNotNull()) & (F.col("day_open") != F.col("prev_close"))
    filled = F.col("prev_close").between(F.col("day_low"), F.col("day_high")).cast("double")
    daily = hourly_to_daily(hours, by).withColumn("prev_close", prev).groupBy(*by).agg(
        F.coalesce(F.avg(F.try_divide(F.col("day_open") - F.col("prev_close"), F.col("prev_close"))), F.lit(0.0)).alias("overnight_gap_mean"),
        F.coalesce(F.avg(F.when(gap, filled)), F.lit(0.0)).alias("gap_fill_ratio"),
        F.when(
            F.count(F.lit(1)) >= 2,
            F.try_divide(F.max_by("day_volume", "d").cast("double"), F.min_by("day_volume", "d").cast("double")),
        ).otherwise(1.0).alias("volume_decay_ratio"),
    )
    series = with_bar_columns(hours, by).groupBy(*by).agg(
        F.coalesce(F.stddev_samp("log_return"), F.lit(0.0)).alias("hourly_realized_vol"),
        F.try_divide(F.max_by("close", "ts") - F.min_by("open", "ts"), F.min_by("open", "ts")).alias("turn_cum_return"),
        F.min("drawdown").alias("max_drawdown_turn"),
    )
    return daily.join(series, list(by))
