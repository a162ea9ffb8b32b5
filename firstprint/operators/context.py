"""Market context: index statistics over street windows and before listing, and sector heat.

A range join of listings against index bars would compare every listing with every bar. Instead
each index gets a dense day calendar, and a range is answered by looking up its two ends: plain
equi-joins on (index, day). The calendar is bounded by indices x days.

Volatility of a range is merged from two pieces by Chan's rule, never a difference of running sums.
At level k the sessions of an index are cut into blocks of 2^(k+1); each session knows mean and
squared deviations of the returns between itself and the middle of its block. Two ends lie on either
side of the middle of exactly one block, so what each knows at that level makes up the range.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstprint.session import materialise


MAX_BROADCAST_BYTES = 128 << 20  # of calendar; twenty years of a dozen indices are 45 MB


@dataclass(frozen=True)
class IndexCalendar:
    """Dense per-day state of every index, the first and last day it covers, its row count and levels of pieces."""

    days: DataFrame
    first: date
    last: date
    rows: int
    levels: int

    @property
    def small(self) -> bool:
        return self.rows * (120 + 2 * 40 * self.levels) <= MAX_BROADCAST_BYTES  # two lists of pieces of a day


def index_calendar(index_bars: DataFrame, lookback: int = 20) -> IndexCalendar:
    """Per index and calendar day: the state strictly before the day, and the next bar.

    ``pieces`` holds, per level, mean and squared deviations (m2) of the returns from a session to the middle of
    its block; ``after`` those of the session behind the next bar, where the returns of a range begin. A missing
    return counts as 0.

    The states (indices x sessions) are written once to the shared folder; six lookups read them.
    """
    w = Window.partitionBy("index_symbol").orderBy("d")
    tail, tail_returns = w.rowsBetween(-(lookback - 1), 0), w.rowsBetween(-(lookback - 2), 0)
    sessions = (
        index_bars.select("index_symbol", "d", "open", "close")
        .withColumn("lr", F.ln("close") - F.ln(F.lag("close").over(w)))
        .withColumns({
            "n": F.row_number().over(w),
            "tail_n": F.count(F.lit(1)).over(tail),
            "tail_open": F.first("open").over(tail),
            "tail_vol": F.coalesce(F.stddev_samp("lr").over(tail_returns), F.lit(0.0)),
            "_all": F.count(F.lit(1)).over(Window.partitionBy("index_symbol")),
        })
        .withColumns({"lr": F.coalesce("lr", F.lit(0.0)), "_at": F.col("n") - 1,
                      "_k": F.explode(F.sequence(F.lit(0), F.length(F.bin("_all")) - 1))})
        .withColumns({"_block": F.expr("shiftright(_at, _k + 1)"), "_half": F.expr("shiftright(_at, _k) & 1")})
        .withColumn("_out", F.when(F.col("_half") == 1, F.col("_at")).otherwise(-F.col("_at")))
    )
    outward = (Window.partitionBy("index_symbol", "_k", "_block", "_half").orderBy("_out")
               .rowsBetween(Window.unboundedPreceding, 0))
    piece = F.struct("_k", F.avg("lr").over(outward).alias("mean"),
                     (F.var_pop("lr").over(outward) * F.count("lr").over(outward)).alias("m2"))
    kept = ("d", "open", "close", "tail_n", "tail_open", "tail_vol")
    pieces = F.transform(F.array_sort(F.collect_list("_piece")), lambda x: F.struct(x["mean"].alias("mean"), x["m2"].alias("m2")))
    state = F.struct("n", "close", "tail_n", "tail_open", "tail_vol", "pieces")
    states = materialise(
        sessions.withColumn("_piece", piece)
        .groupBy("index_symbol", "n").agg(*[F.first(c).alias(c) for c in kept], pieces.alias("pieces"))
        .select("index_symbol", "d", state.alias("state"),
                F.struct("open", F.lead("pieces").over(w).alias("after")).alias("bar"))
        .withColumns({
            "_before": F.lag("state").over(w), "_prev": F.lag("d").over(w), "_next": F.lead("d").over(w),
        }),
        "calendar",
    )
    lo, hi, indices, levels = states.agg(F.min("d"), F.date_add(F.max("d"), 1), F.count_distinct("index_symbol"),
                                         F.max(F.size("state.pieces"))).first()
    # A bar answers for the days after the previous bar up to its own; the last one also for the rest.
    upto_bar = F.sequence(F.coalesce(F.date_add("_prev", 1), F.lit(lo)), F.col("d"))
    after_last = F.when(F.col("_next").isNull() & (F.col("d") < F.lit(hi)), F.sequence(F.date_add("d", 1), F.lit(hi)))
    spells = F.array(
        F.struct(upto_bar.alias("days"), F.col("_before").alias("before"), F.col("bar").alias("next")),
        F.struct(after_last.alias("days"), F.col("state").alias("before"), F.lit(None).alias("next")),
    )
    out = (
        states.select("index_symbol", F.inline(spells))
        .select("index_symbol", F.explode("days").alias("d"), "before", "next")
    )
    return IndexCalendar(out, lo, hi, indices * ((hi - lo).days + 1), levels)


def _lookup(df: DataFrame, calendar: IndexCalendar, index: Column, day: Column, name: str) -> DataFrame:
    """Left equi-join of ``df`` with the calendar row of (index, day clamped to the covered span).

    The calendar is broadcast while its row count allows; beyond that Spark shuffles both sides.
    """
    rows = calendar.days.select(
        F.col("index_symbol").alias("_ix"), F.col("d").alias("_day"), F.struct("before", "next").alias(name)
    )
    clamped = F.least(F.greatest(day, F.lit(calendar.first)), F.lit(calendar.last))
    side = F.broadcast(rows) if calendar.small else rows
    return df.join(side, (index == F.col("_ix")) & (clamped == F.col("_day")), "left").drop("_ix", "_day")


def with_index_stats(windows: DataFrame, calendar: IndexCalendar, index: Column, prefix: str,
                     start: str = "win_start", end: str = "win_end") -> DataFrame:
    """Adds ``{prefix}_n``, ``{prefix}_return`` and ``{prefix}_vol`` of the index over [start, end)."""
    df = _lookup(windows, calendar, index, F.col(start), "_s")
    df = _lookup(df, calendar, index, F.col(end), "_e")

    def before(side: str) -> Column:
        return F.coalesce(F.col(f"{side}.before.n"), F.lit(0))

    n = before("_e") - before("_s")
    # returns of the range: from the session behind its first one to its last one, counted from 0
    df = df.withColumns({"_l": before("_s") + 1, "_r": before("_e") - 1})
    df = df.withColumn("_k", F.when(n > 2, F.length(F.bin(F.col("_l").bitwiseXOR(F.col("_r")).cast("long"))) - 1))
    df = df.withColumn("_mid", F.expr("shiftleft(shiftright(_r, _k), _k)"))
    left, right = F.try_element_at("_s.next.after", F.col("_k") + 1), F.try_element_at("_e.before.pieces", F.col("_k") + 1)
    n1, n2 = (F.col("_mid") - F.col("_l")).cast("double"), (F.col("_r") - F.col("_mid") + 1).cast("double")
    apart = right["mean"] - left["mean"]
    var = (left["m2"] + right["m2"] + apart * apart * n1 * n2 / (n1 + n2)) / (n1 + n2 - 1)
    open_ = F.col("_s.next.open")
    return df.withColumns({
        f"{prefix}_n": n,
        f"{prefix}_return": F.when(n > 0, F.try_divide(F.col("_e.before.close") - open_, open_)),
        f"{prefix}_vol": F.when(n > 2, F.sqrt(var)).when(n > 0, F.lit(0.0)),
    }).drop("_s", "_e", "_l", "_r", "_k", "_mid")


def regime_features(windows: DataFrame, calendar: IndexCalendar, market: str, sector_index: Column) -> DataFrame:
    """(symbol, street, spy_n, spy_return, spy_vol, sector_return) for windows with a ``sector``.

    ``spy_n = 0`` marks an empty market window: callers drop the symbol. A missing sector index
    gives a sector return of 0.
    """
    df = with_index_stats(windows, calendar, F.lit(market), "spy")
    df = with_index_stats(df, calendar, sector_index, "_sec")
    return df.withColumn("sector_return", F.coalesce(F.col("_sec_return"), F.lit(0.0))).drop(
        "_sec_n", "_sec_return", "_sec_vol"
    )


def with_pre_listing_stats(listings: DataFrame, calendar: IndexCalendar, index: Column, prefix: str,
                           day: str = "ipo_date") -> DataFrame:
    """Adds return and volatility of the index over its last bars strictly before ``day``.

    The tail length is the calendar's ``lookback``; fewer than two bars give 0 and 0.
    """
    df = _lookup(listings, calendar, index, F.col(day), "_p")
    state = F.col("_p.before")
    enough = F.coalesce(state["tail_n"] >= 2, F.lit(False))
    ret = F.try_divide(state["close"] - state["tail_open"], state["tail_open"])
    return df.withColumns({
        f"{prefix}_return_20d": F.when(enough, ret).otherwise(0.0),
        f"{prefix}_vol_20d": F.when(enough, state["tail_vol"]).otherwise(0.0),
    }).drop("_p")


def with_sector_heat(listings: DataFrame, universe: DataFrame | None = None, days: int = 90,
                     name: str = "preflop_sector_ipo_heat_90d") -> DataFrame:
    """Listings of the same two-digit SIC in the ``days`` before, same day excluded.

    The universe is first counted per (SIC group, day), at most 100 groups x calendar days, and the
    range sum runs over those counts: no listing is paired with another, and a hot sector is only
    a hundred-year column of counts.
    """
    pool = (universe if universe is not None else listings).where(F.length("sic") >= 2)
    w = Window.partitionBy("sic2").orderBy("_dayno").rangeBetween(-days, -1)
    counts = pool.groupBy(F.substring("sic", 1, 2).alias("sic2"), F.col("ipo_date").alias("_day")).agg(
        F.count(F.lit(1)).alias("_listed")
    )
    if universe is not None:
        asked = listings.where(F.length("sic") >= 2).groupBy(
            F.substring("sic", 1, 2).alias("sic2"), F.col("ipo_date").alias("_day")
        ).agg(F.lit(0).cast("bigint").alias("_listed"))
        counts = counts.unionByName(asked).groupBy("sic2", "_day").agg(F.sum("_listed").alias("_listed"))
    heat = (
        counts.withColumn("_dayno", F.unix_date("_day"))
        .select("sic2", "_day", F.coalesce(F.sum("_listed").over(w), F.lit(0)).cast("double").alias(name))
    )
    keyed = listings.withColumn("_sic2", F.when(F.length("sic") >= 2, F.substring("sic", 1, 2)))
    return (
        keyed.join(heat, (F.col("_sic2") == F.col("sic2")) & (F.col("ipo_date") == F.col("_day")), "left")
        .withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))
        .drop("_sic2", "sic2", "_day")
    )


def preflop_features(listings: DataFrame, calendar: IndexCalendar, market: str, sector_index: Column,
                     universe: DataFrame | None = None) -> DataFrame:
    """The seven features known before the first session, one row per listing."""
    df = with_sector_heat(listings, universe)
    df = with_pre_listing_stats(df, calendar, F.lit(market), "preflop_spy")
    df = with_pre_listing_stats(df, calendar, sector_index, "preflop_sector")
    return df.withColumns({
        "preflop_filing_count": F.col("filing_count").cast("double"),
        "preflop_ipo_month": F.month("ipo_date").cast("double"),
        "preflop_ipo_day_of_week": F.weekday("ipo_date").cast("double"),
    }).drop("preflop_sector_vol_20d")


def needed_index_bars(index_bars: DataFrame, listings: DataFrame, market: str, sector_index: Column) -> DataFrame:
    """Bars of the market index and of the sector indices in use, from the first listing's year on."""
    facts = listings.select(sector_index.alias("index_symbol"), "ipo_date")
    needed = (
        facts.where(F.col("index_symbol").isNotNull()).select("index_symbol").distinct()
        .unionByName(facts.limit(1).select(F.lit(market).alias("index_symbol"))).distinct()
    )
    start = facts.agg(F.trunc(F.min("ipo_date"), "year").alias("_from"))
    return (
        index_bars.join(F.broadcast(needed), "index_symbol", "left_semi")  # at most one row per sector
        .join(F.broadcast(start), F.col("d") >= F.col("_from")).drop("_from")  # one row
    )
