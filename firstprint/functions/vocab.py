"""Word lists, maps and constants that fix the results."""

# ---- fixed values: begin -------------------------------------------------
FILING_SPAC_TERMS = (
    "acquisition corp", "acquisition corporation", "blank check", "spac",
    "capital corp", "merger corp", "holdings acquisition",
)
FILING_NON_COMMON_TERMS = (
    " etf", " fund", " trust", " warrant", " unit", " rights",
    " preferred", " notes", " adr",
)
FILING_EXCHANGES = ("nasdaq", "nyse", "nyse american", "nyse arca")

VENDOR_SPAC_TERMS = ("acquisition corp", "acquisition corporation", "blank check", "spac")
VENDOR_NON_COMMON_TERMS = (
    "etf", "fund", "adr", "warrant", "unit", "rights", "preferred", "trust", "notes",
)
VENDOR_COMMON_TERMS = ("common", "ordinary", "class a", "class b", "common stock")
VENDOR_EXCHANGES = ("nasdaq", "new york stock exchange", "nyse", "nyse american")
VENDOR_FILTER_VERSION = "v1_intrinio_us_common_ex_spac"

TICKER_PATTERN = r"\(([A-Z]{1,5})\)"

MARKET_INDEX = "SPY"
SECTOR_INDEX = {
    "technology": "XLK",
    "health_care": "XLV",
    "financials": "XLF",
    "industrials": "XLI",
    "consumer_goods": "XLP",
    "consumer_services": "XLY",
    "energy": "XLE",
    "oil_gas": "XLE",
    "real_estate": "XLRE",
    "airlines": "XLI",
}
ONE_HOT_SECTORS = (
    "health_care", "technology", "industrials", "financials", "consumer_goods",
    "consumer_services", "energy", "oil_gas", "real_estate",
)

# name, first year, last year, sample size
ERAS = (("2010-2016", 2010, 2016, 30), ("2017-2021", 2017, 2021, 45), ("2022-2025", 2022, 2025, 45))

STREETS = ("FLOP", "TURN", "RIVER")
STREET_TIMEFRAME = {"PREFLOP": "none", "FLOP": "1d", "TURN": "1d", "RIVER": "1d"}
FLOP_DAYS, TURN_DAYS, RIVER_DAYS = 6, 15, 40

MARKET_OPEN, FIRST_HOUR_END, MARKET_CLOSE = "14:30:00", "15:30:00", "21:00:00"

DAILY_FEATURES = (
    "realized_vol", "range_mean", "dollar_volume_mean", "amihud_illiquidity", "cum_return",
    "trend_strength", "max_drawdown", "worst_day_return", "best_day_return",
    "volume_decay_ratio", "overnight_gap_mean",
)
REGIME_FEATURES = ("spy_return", "spy_vol", "sector_return")
PREFLOP_FEATURES = (
    "preflop_filing_count", "preflop_ipo_month", "preflop_ipo_day_of_week",
    "preflop_sector_ipo_heat_90d", "preflop_spy_return_20d", "preflop_spy_vol_20d",
    "preflop_sector_return_20d",
)
METADATA_FEATURES = (
    "preflop_s1_lead_days", "preflop_exchange_nyse", "preflop_exchange_nasdaq",
    "preflop_s1a_count", "preflop_days_since_last_amendment",
)
# columns of an earlier metadata run: dropped by prefix or name, but for the context columns
GENERATED_PREFIXES = ("preflop_s1", "preflop_exchange", "preflop_sector_")
CONTEXT_COLUMNS = ("preflop_sector_ipo_heat_90d", "preflop_sector_return_20d")

NON_FEATURES = (
    "symbol", "street", "asof_date", "ipo_date", "sector",
    "forward_mdd_7d", "forward_mfr_7d", "forward_mdd_20d", "forward_mfr_20d",
    "risk_severity", "adverse_20", "severe_30",
    "zero_volume_pct", "median_daily_volume", "bar_count_1d",
)
MIN_SEVERE_EVENTS = 50
HISTORY_DAYS = 130
# ---- fixed values: end ---------------------------------------------------
