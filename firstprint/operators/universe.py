"""Listing universe: grouping filings, resolving tickers, filters with audit, validation, reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstprint.functions import columns as X
from firstprint.functions import vocab


def filings_per_company(filings: DataFrame, seq: str | None = None) -> DataFrame:
    """One row per CIK: fields of its earliest filing, and the filing count.

    ``min_by`` combines map-side. Equal dates fall to the lowest ``seq`` when given, else to the
    lowest field values, so the pick does not depend on partitioning.
    """
    body = F.struct("company_name", "display_name", "sic", "state")
    tie = F.struct("file_date", seq) if seq else F.struct("file_date", *[F.coalesce(F.col(f"{c}"), F.lit("")).alias(c)
                                                                        for c in ("company_name", "display_name", "sic", "state")])
    return (
        filings.groupBy("cik").agg(
            F.min("file_date").alias("ipo_date"), F.min_by(body, tie).alias("_b"), F.count(F.lit(1)).alias("filing_count"))
        .select("cik", "ipo_date", "_b.*", "filing_count")
    )


def resolve_tickers(companies: DataFrame, tickers: DataFrame) -> DataFrame:
    """Symbol from the ticker file, else from the display name, else ``CIK:{cik}``, with its source."""
    mapped = tickers.select("cik", F.col("ticker").alias("_t"), F.col("name").alias("_n"), F.col("exchange").alias("_x"))
    has = F.coalesce(F.col("_t") != "", F.lit(False))
    shown = X.ticker_from_display(F.col("display_name"))
    return companies.join(mapped, "cik", "left").select(
        F.when(has, F.col("_t")).otherwise(F.coalesce(shown, F.concat(F.lit("CIK:"), F.col("cik")))).alias("symbol"),
        F.when(F.coalesce(F.col("company_name"), F.lit("")) != "", F.col("company_name"))
        .otherwise(F.coalesce("_n", F.lit(""))).alias("company_name"),
        "ipo_date", "cik", F.when(has, F.col("_x")).alias("exchange"), "sic", "state",
        F.when(has, "company_tickers").when(shown.isNotNull(), "display_name").otherwise("unknown").alias("ticker_source"),
        "filing_count",
    )


def _with_reasons(df: DataFrame, reasons) -> DataFrame:
    listed = df.withColumn("_reasons", X.reason_list(*reasons))
    return listed.withColumns({
        "excluded_reasons": F.concat_ws(",", "_reasons"), "included": F.size("_reasons") == 0,
    }).drop("_reasons")


def filter_filings_universe(universe: DataFrame) -> DataFrame:
    """All rows with their exclusion reasons, in order, and ``included``."""
    name = X.norm_text(F.col("company_name"))
    known = F.coalesce(F.col("exchange"), F.lit("")) != ""
    allowed = X.is_us_exchange(F.col("exchange"), vocab.FILING_EXCHANGES)
    return _with_reasons(universe, [
        F.when(X.contains_any(name, vocab.FILING_SPAC_TERMS), "spac_name"),
        F.when(known & ~allowed, "non_us_exchange")
        .when(~known & (F.col("ticker_source") == "unknown"), "no_ticker_or_exchange"),
        F.when(X.contains_any(name, vocab.FILING_NON_COMMON_TERMS), "non_common_by_name"),
        F.when(F.col("symbol").startswith("CIK:"), "no_ticker_resolved"),
        *X.ticker_shape_reasons(F.col("symbol")),
    ])


def dedupe_vendor(listings: DataFrame, seq: str = "seq") -> DataFrame:
    """Best-described record per (symbol, ipo_date); the first one wins ties."""
    filled = sum((F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0) for c in ("exchange_raw", "security_type_raw")), F.lit(0))
    body = [c for c in listings.columns if c not in ("symbol", "ipo_date", seq)]
    best = F.min_by(F.struct(*body), F.struct((-filled).alias("_score"), F.col(seq)))
    return listings.groupBy("symbol", "ipo_date").agg(best.alias("_b")).select("symbol", "ipo_date", "_b.*")


def filter_vendor_universe(listings: DataFrame, start: date, end: date, *, include_spacs: bool = False,
                           allow_non_us_exchanges: bool = False, allow_non_common: bool = False) -> DataFrame:
    reasons = [F.when((F.col("ipo_date") < F.lit(start)) | (F.col("ipo_date") > F.lit(end)), "outside_date_window")]
    if not include_spacs:
        reasons.append(F.when(X.is_spac(F.col("company_name"), vocab.VENDOR_SPAC_TERMS), "spac_name"))
    if not allow_non_us_exchanges:
        reasons.append(F.when(~X.is_us_exchange(F.col("exchange_raw")), "non_us_exchange_or_missing"))
    if not allow_non_common:
        reasons.append(F.when(~X.is_common_equity(F.col("security_type_raw")), "non_common_security_type"))
    return _with_reasons(listings, reasons)


def with_provenance(df: DataFrame, provider: str, endpoint: str, fetched_at: str, start: date, end: date,
                    filter_version: str = vocab.VENDOR_FILTER_VERSION) -> DataFrame:
    return df.withColumns({
        "source_provider": F.lit(provider), "source_endpoint": F.lit(endpoint),
        "source_fetched_at_utc": F.lit(fetched_at), "filter_version": F.lit(filter_version),
        "build_start_date": F.lit(start), "build_end_date": F.lit(end),
    })


# ---- bars against listings --------------------------------------------------------------------

def _bars_near_listing(universe: DataFrame, bars: DataFrame, before: int, after: int, inclusive_end: bool) -> DataFrame:
    """Count and first day of each listing's bars in [ipo - before, ipo + after].

    An equi-join on symbol carries the day range as a residual filter; the aggregate is keyed by the
    same symbol, so one shuffle serves both, and bars are reduced to (symbol, day) counts first.
    """
    days = bars.groupBy("symbol", F.to_date("ts").alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
    listed = universe.select("symbol", "ipo_date").distinct()
    upper = F.date_add("ipo_date", after)
    inside = (F.col("_d") >= F.date_sub("ipo_date", before)) & (F.col("_d") <= upper if inclusive_end else F.col("_d") < upper)
    return (
        days.join(listed, "symbol").where(inside)
        .groupBy("symbol", "ipo_date").agg(F.min("_d").alias("_first"), F.sum("_c").alias("_count"))
    )


def with_bars_available(universe: DataFrame, bars: DataFrame, days: int = 30, name: str = "bars_available") -> DataFrame:
    """Adds whether any bar falls in [ipo_date, ipo_date + days)."""
    near = _bars_near_listing(universe, bars, 0, days, False).drop("_first")
    return (
        universe.join(near, ["symbol", "ipo_date"], "left")
        .withColumn(name, F.coalesce(F.col("_count") > 0, F.lit(False))).drop("_count")
    )


def with_first_trade(universe: DataFrame, bars: DataFrame, limit: int = 0, order=("ipo_date", "symbol")) -> DataFrame:
    """First trade day, lag to listing and bar count around the listing date.

    With ``limit`` > 0 only the first rows in ``order`` are checked (the feature's own cap); the
    rest keep nulls.
    """
    near = _bars_near_listing(universe, bars, 3, 30, True)
    out = universe.join(near, ["symbol", "ipo_date"], "left")
    checked = F.lit(True)
    if limit > 0:
        from firstprint.operators.ordering import global_position

        out = global_position(out, list(order), None, "_pos")
        checked = F.col("_pos") < limit
    return out.withColumns({
        "has_daily_bars": F.when(checked, F.coalesce(F.col("_count") > 0, F.lit(False))),
        "first_trade_date": F.when(checked, F.col("_first")),
        "first_trade_days_from_ipo": F.when(checked, F.datediff("_first", "ipo_date")),
        "bar_count_30d": F.when(checked, F.coalesce(F.col("_count"), F.lit(0)).cast("bigint")),
    }).drop("_count", "_first", "_pos")


def coverage_by_era(universe: DataFrame, flag: str = "bars_available", eras=vocab.ERAS) -> DataFrame:
    return universe.groupBy(X.era_label(F.year("ipo_date"), eras).alias("era")).agg(
        F.count_if(flag).alias("n_available"), F.count(F.lit(1)).alias("n_listed"))


# ---- pre-listing metadata ----------------------------------------------------------------------

def amendments_per_company(amendments: DataFrame) -> DataFrame:
    return amendments.groupBy("cik").agg(F.count(F.lit(1)).alias("s1a_count"), F.max("file_date").alias("last_amendment_date"))


def first_bar_dates(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min(F.to_date("ts")).alias("first_bar_date"))


def preflop_metadata(universe: DataFrame, bars: DataFrame, amendments: DataFrame | None,
                     asof_listing: bool = False) -> DataFrame:
    """Lead days, exchange flags and amendment history per listing.

    Amendments after the listing count too, as a negative day difference; ``asof_listing`` keeps
    only those filed before the first bar. Without ``amendments`` the two columns stay null.
    """
    exchange = F.lower(F.coalesce("exchange", F.lit("")))
    base = universe.join(first_bar_dates(bars), "symbol", "left")
    if amendments is None:
        base = base.withColumns({"s1a_count": F.lit(None).cast("bigint"), "last_amendment_date": F.lit(None).cast("date")})
    else:
        known = amendments
        if asof_listing:
            known = amendments.join(base.select("cik", "first_bar_date"), "cik").where(
                F.col("file_date") < F.col("first_bar_date")).select("cik", "file_date")
        base = base.join(amendments_per_company(known), "cik", "left")
        base = base.withColumn("s1a_count", F.coalesce("s1a_count", F.lit(0)))
    return base.select(
        "symbol", F.col("ipo_date").alias("s1_filing_date"), "first_bar_date",
        F.datediff("first_bar_date", "ipo_date").cast("double").alias("preflop_s1_lead_days"),
        exchange.contains("nyse").cast("double").alias("preflop_exchange_nyse"),
        exchange.contains("nasdaq").cast("double").alias("preflop_exchange_nasdaq"),
        F.col("s1a_count").cast("double").alias("preflop_s1a_count"),
        F.datediff("first_bar_date", "last_amendment_date").cast("double").alias("preflop_days_since_last_amendment"),
    )


# ---- reports -------------------------------------------------------------------------------------

def reason_counts(audit: DataFrame) -> DataFrame:
    return (
        audit.where(~F.col("included")).select(F.explode(F.split("excluded_reasons", ",")).alias("reason"))
        .where(F.col("reason") != "").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    )


def reason_buckets(audit: DataFrame) -> DataFrame:
    return audit.where(~F.col("included")).groupBy("excluded_reasons").agg(F.count(F.lit(1)).alias("n"))


def listings_per_year(universe: DataFrame) -> DataFrame:
    return universe.groupBy(F.year("ipo_date").alias("yr")).agg(F.count(F.lit(1)).alias("n"))


def sector_counts(universe: DataFrame) -> DataFrame:
    return universe.groupBy(X.sic_sector(F.col("sic")).alias("sector")).agg(F.count(F.lit(1)).alias("n"))


def universe_summary(universe: DataFrame) -> DataFrame:
    return universe.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("symbol").alias("n_symbols"),
        F.min("ipo_date").alias("first_ipo"), F.max("ipo_date").alias("last_ipo"))


def stratified_sample(universe: DataFrame, seed: int = 42, eras=vocab.ERAS, key: str = "symbol") -> DataFrame:
    """Fixed-size sample per era without replacement, after dropping non-common tickers.

    Rows are ranked by a seeded hash, so the draw does not depend on partitioning. Each era keeps
    the rows under a hash bar chosen from a 4,096-slot histogram; only that small head is ranked.
    """
    from pyspark.sql import Window

    wanted = {name: size for name, _, _, size in eras}
    sizes = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
    h = F.xxhash64(F.col(key), F.lit(seed))
    rows = (
        universe.where(X.is_common_ticker(F.col(key)))
        .withColumns({"era": X.era_label(F.year("ipo_date"), eras), "_h": h})
        .where(F.col("era") != "unknown").withColumn("_slot", F.shiftright("_h", 52))
    )
    slots = rows.groupBy("era", "_slot").agg(F.count(F.lit(1)).alias("_c"))
    below = Window.partitionBy("era").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    open_slots = (
        slots.withColumn("_seen", F.coalesce(F.sum("_c").over(below), F.lit(0)))
        .where(F.col("_seen") < F.try_element_at(sizes, F.col("era"))).select("era", "_slot")
    )
    ranked = Window.partitionBy("era").orderBy("_h", key)
    return (
        rows.join(F.broadcast(open_slots), ["era", "_slot"], "left_semi")  # at most 4,096 rows per era
        .withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= F.try_element_at(sizes, F.col("era"))).drop("_h", "_slot", "_rank")
    )
