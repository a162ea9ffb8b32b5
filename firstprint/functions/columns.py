"""Scalar expressions. Every function takes and returns Columns, so they stay in codegen."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from firstprint.functions import vocab


def norm_text(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def first_non_blank(*cols: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def contains_any(text: Column, terms) -> Column:
    return reduce(or_, [text.contains(t) for t in terms])


def lenient_date(c: Column) -> Column:
    """Date of an ISO date or timestamp text (its own calendar day, no zone shift), else null."""
    text = F.trim(c)
    compact = F.when(text.rlike(r"^[0-9]{8}(T.*)?$"), F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd"))
    dashed = F.when(
        F.substring(text, 1, 10).rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"),
        F.try_to_date(F.substring(text, 1, 10), "yyyy-M-d"),
    )
    return F.coalesce(dashed, compact)


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def to_long(c: Column) -> Column:
    return c.try_cast("bigint")


def first_element(c: Column) -> Column:
    return F.try_element_at(c, F.lit(1))


def ticker_from_display(name: Column) -> Column:
    """First bracketed 1-5 capital letters that is not the word CIK."""
    found = F.regexp_extract_all(name, F.lit(vocab.TICKER_PATTERN), F.lit(1))
    return first_element(F.filter(found, lambda t: t != "CIK"))


def entity_name(display: Column) -> Column:
    return F.trim(F.split_part(display, F.lit("("), F.lit(1)))


def canonical_cik(c: Column) -> Column:
    return F.coalesce(F.nullif(F.ltrim(c, F.lit("0")), F.lit("")), F.lit("0"))


def is_spac(name: Column, terms=vocab.FILING_SPAC_TERMS) -> Column:
    return contains_any(norm_text(name), terms)


def is_us_exchange(exchange: Column, allowed=vocab.VENDOR_EXCHANGES) -> Column:
    return contains_any(norm_text(exchange), allowed)


def is_common_equity(kind: Column) -> Column:
    text = norm_text(kind)
    return (
        F.when(F.coalesce(kind, F.lit("")) == "", True)
        .when(contains_any(text, vocab.VENDOR_NON_COMMON_TERMS), False)
        .otherwise(contains_any(text, vocab.VENDOR_COMMON_TERMS))
    )


def ticker_shape_reasons(symbol: Column) -> list[Column]:
    """Null or a reason name for warrant, unit and preferred tickers."""
    upper = F.upper(symbol)
    long = F.length(upper) > 3
    return [
        F.when(long & upper.endswith("W"), "warrant_by_ticker"),
        F.when(long & upper.endswith("U"), "unit_by_ticker"),
        F.when(upper.contains("-"), "preferred_by_ticker"),
    ]


def is_common_ticker(symbol: Column) -> Column:
    long = F.length(symbol) > 3
    return ~(long & symbol.endswith("W")) & ~(long & symbol.endswith("U")) & ~symbol.contains("-")


def reason_list(*reasons: Column) -> Column:
    """Non-null reasons, in the order given."""
    return F.array_compact(F.array(*reasons))


def sic_sector(sic: Column) -> Column:
    """Sector of a SIC code by its first two digits; unknown when short or not numeric."""
    div = F.substring(sic, 1, 2).try_cast("int")
    usable = (F.length(sic) >= 2) & div.isNotNull()

    def at(*codes: int) -> Column:
        return div.isin(*codes)

    return (
        F.when(~F.coalesce(usable, F.lit(False)), "unknown")
        # ---- fixed values: SIC divisions ----
        .when(at(13), "oil_gas")
        .when(div.between(10, 14), "energy")
        .when(div.between(15, 17), "industrials")
        .when(at(28), "health_care")
        .when(at(35, 36, 38), "technology")
        .when(at(37), "industrials")
        .when(div.between(18, 39), "consumer_goods")
        .when(at(48), "technology")
        .when(at(49), "energy")
        .when(div.between(40, 47), "industrials")
        .when(div.between(50, 51), "consumer_goods")
        .when(div.between(52, 59), "consumer_services")
        .when(at(65), "real_estate")
        .when(div.between(60, 67), "financials")
        .when(at(73), "technology")
        .when(at(80), "health_care")
        .when(at(70, 72), "consumer_services")
        .when(div.between(68, 89), "industrials")
        .otherwise("unknown")
    )


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def sector_index(sector: Column, mapping: dict[str, str] = vocab.SECTOR_INDEX) -> Column:
    return F.try_element_at(literal_map(mapping), sector)


def era_label(year: Column, eras=vocab.ERAS) -> Column:
    out = None
    for name, lo, hi, *_ in eras:
        hit = year.between(lo, hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def street_timeframe(street: Column) -> Column:
    return F.try_element_at(literal_map(vocab.STREET_TIMEFRAME), street)


def street_rank(street: Column) -> Column:
    """0, 1, 2 for the three streets."""
    return F.array_position(F.array(*[F.lit(s) for s in vocab.STREETS]), street) - 1


def in_market_hours(ts: Column, open_=vocab.MARKET_OPEN, close=vocab.MARKET_CLOSE) -> Column:
    clock = F.date_format(ts, "HH:mm:ss")
    return (clock >= open_) & (clock < close)


def action_of(p: Column, fold_min: Column, small_bet_min: Column) -> Column:
    return F.when(p >= fold_min, "FOLD").when(p >= small_bet_min, "SMALL_BET").otherwise("SIZE_UP")


def crude_probability(pred: Column, scale: float = 0.25) -> Column:
    return F.least(F.greatest(pred / F.lit(scale), F.lit(0.0)), F.lit(1.0))


def min_false_safe_rate(p_severe: Column, c_sizeup: Column) -> Column:
    """Lowest false-safe rate any ranking could reach at this SIZE_UP share."""
    floor = F.try_divide(p_severe - (F.lit(1.0) - c_sizeup), p_severe)
    return F.when((p_severe <= 0) | (c_sizeup <= 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), floor))


def with_event_labels(df, mdd: str = "forward_mdd_20d", adverse_at: float = 0.20, severe_at: float = 0.30):
    """Severity and the two event flags; a null drawdown leaves all three null."""
    severity = -F.col(mdd)
    return df.withColumns({
        "risk_severity": severity,
        "adverse_20": (severity >= adverse_at).cast("int"),
        "severe_30": (severity >= severe_at).cast("int"),
    })


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    """num/den, or ``empty`` where den is 0 or null."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(empty))
