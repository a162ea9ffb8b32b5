"""Fixed schemas and the bar-schema check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

BAR_REQUIRED = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
])

BAR_OPTIONAL = T.StructType([
    T.StructField("vwap", T.DoubleType()),
    T.StructField("trade_count", T.LongType()),
])

BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType())] + BAR_REQUIRED.fields + BAR_OPTIONAL.fields
)

BAR_TABLE_SCHEMA = T.StructType(BAR_SCHEMA.fields + [T.StructField("timeframe", T.StringType())])

# One landed page of the filing search.
FILING_PAGE_SCHEMA = T.StructType([
    T.StructField("hits", T.StructType([
        T.StructField("hits", T.ArrayType(T.StructType([
            T.StructField("_source", T.StructType([
                T.StructField("ciks", T.ArrayType(T.StringType())),
                T.StructField("file_date", T.StringType()),
                T.StructField("display_names", T.ArrayType(T.StringType())),
                T.StructField("form", T.StringType()),
                T.StructField("sics", T.ArrayType(T.StringType())),
                T.StructField("biz_states", T.ArrayType(T.StringType())),
            ])),
        ]))),
    ])),
])

# One landed ticker file: column names plus positional rows.
TICKER_FILE_SCHEMA = T.StructType([
    T.StructField("fields", T.ArrayType(T.StringType())),
    T.StructField("data", T.ArrayType(T.ArrayType(T.StringType()))),
])

_COMPANY_FIELDS = [
    "ticker", "symbol", "stock_symbol", "name", "legal_name", "company_name",
    "stock_exchange", "exchange", "primary_exchange", "stock_exchange_mic",
    "security_type", "issue_type", "stock_type", "security_class",
]
_LISTING_FIELDS = _COMPANY_FIELDS + [
    "id", "ipo_date", "listing_date", "priced_date", "first_trade_date", "status", "ipo_status",
    "offer_price", "price", "offer_price_low", "price_low", "offer_price_high", "price_high",
    "shares_offered", "share_count", "deal_size", "gross_proceeds",
]

VENDOR_RECORD_SCHEMA = T.StructType(
    [T.StructField("company", T.StructType([T.StructField(f, T.StringType()) for f in _COMPANY_FIELDS]))]
    + [T.StructField(f, T.StringType()) for f in _LISTING_FIELDS]
)

# One landed page of the vendor listing feed: the list sits in "ipos" or in "data".
VENDOR_PAGE_SCHEMA = T.StructType([
    T.StructField("ipos", T.ArrayType(VENDOR_RECORD_SCHEMA)),
    T.StructField("data", T.ArrayType(VENDOR_RECORD_SCHEMA)),
])


def validate_schema(df: DataFrame, expected: T.StructType, name: str) -> DataFrame:
    """ValueError for missing columns, TypeError for wrong types; extra columns pass."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in expected.fields if f.name not in actual]
    if missing:
        raise ValueError(f"{name}: missing required columns: {missing}")
    wrong = [
        f"{f.name}: expected {f.dataType.simpleString()}, got {actual[f.name].simpleString()}"
        for f in expected.fields if actual[f.name] != f.dataType
    ]
    if wrong:
        raise TypeError(f"{name}: wrong column types: " + "; ".join(wrong))
    return df


def validate_bars(df: DataFrame, timeframe: str) -> DataFrame:
    return validate_schema(df, BAR_REQUIRED, timeframe)
