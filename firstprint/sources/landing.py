"""Landed JSON pages to typed rows. Pages are read with fixed schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firstprint import schemas
from firstprint.functions import columns as X


def read_json_pages(spark: SparkSession, path: str, schema) -> DataFrame:
    """One row per landed page file (multi-line JSON documents)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def parse_pages(df: DataFrame, text: str, schema) -> DataFrame:
    """Pages held as a text column, other columns kept."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.from_json(F.col(text), schema).alias("_p")).select(*others, "_p.*")


def filings(pages: DataFrame) -> DataFrame:
    """Filing hits to (cik, company_name, display_name, file_date, form_type, sic, state).

    Hits without a CIK or with an unreadable date are dropped.
    """
    src = pages.select(F.explode("hits.hits").alias("h")).select("h._source.*")
    name = F.coalesce(X.first_element(F.col("display_names")), F.lit(""))
    return src.select(
        X.canonical_cik(X.first_element(F.col("ciks"))).alias("cik"),
        X.first_element(F.col("ciks")).alias("_raw"),
        X.entity_name(name).alias("company_name"),
        name.alias("display_name"),
        X.lenient_date(F.substring("file_date", 1, 10)).alias("file_date"),
        F.coalesce("form", F.lit("")).alias("form_type"),
        X.first_element(F.col("sics")).alias("sic"),
        X.first_element(F.col("biz_states")).alias("state"),
    ).where(F.col("_raw").isNotNull() & F.col("file_date").isNotNull()).drop("_raw")


def amendments(pages: DataFrame) -> DataFrame:
    """Amendment hits to (cik, file_date)."""
    return filings(pages).select("cik", "file_date")


def ticker_map(files: DataFrame) -> DataFrame:
    """Columnar ticker files to one row per CIK; the last row of a CIK wins, within and across files."""
    def at(field: str):
        return F.try_element_at("row", F.array_position("fields", field).cast("int"))

    rows = files.withColumn("_file", F.monotonically_increasing_id()).select(
        "_file", "fields", F.posexplode("data").alias("_row", "row"))
    body = F.struct(at("ticker").alias("ticker"), at("name").alias("name"), at("exchange").alias("exchange"))
    return (
        rows.select(at("cik").alias("cik"), body.alias("body"), F.struct("_file", "_row").alias("seq"))
        .groupBy("cik").agg(F.max_by("body", "seq").alias("body")).select("cik", "body.*")
    )


def vendor_records(pages: DataFrame, status: str = "status") -> DataFrame:
    """Vendor records: the list at ``ipos``, else at ``data``; the queried status rides along.

    ``seq`` orders the records; give pages a ``page_no`` to make it the landing order.
    """
    rows = F.coalesce("ipos", "data")
    query = F.col(status) if status in pages.columns else F.lit("")
    page = F.col("page_no") if "page_no" in pages.columns else F.monotonically_increasing_id()
    return pages.select(
        query.alias("_status"), page.alias("_page"), F.posexplode(rows).alias("_at", "r")
    ).select(F.struct("_page", "_at").alias("seq"), "r.*", F.col("_status").alias("_source_status_query"))


def vendor_listings(records: DataFrame) -> DataFrame:
    """Typed vendor listings; records without a symbol or a readable listing date are dropped."""
    def own(*names):
        return X.first_non_blank(*[F.col(n) for n in names])

    def company(*names):
        return F.coalesce(X.first_non_blank(*[F.col(f"company.{n}") for n in names]), own(*names))

    return records.select(
        *(["seq"] if "seq" in records.columns else []),
        F.trim(F.upper(company("ticker", "symbol", "stock_symbol"))).alias("symbol"),
        F.coalesce(F.trim(company("name", "legal_name", "company_name")), F.lit("")).alias("company_name"),
        X.lenient_date(own("ipo_date", "listing_date", "priced_date", "first_trade_date")).alias("ipo_date"),
        own("status", "ipo_status").alias("status"),
        company("stock_exchange", "exchange", "primary_exchange", "stock_exchange_mic").alias("exchange_raw"),
        company("security_type", "issue_type", "stock_type", "security_class").alias("security_type_raw"),
        X.to_double(own("offer_price", "price")).alias("offer_price"),
        X.to_double(own("offer_price_low", "price_low")).alias("offer_price_low"),
        X.to_double(own("offer_price_high", "price_high")).alias("offer_price_high"),
        X.to_long(own("shares_offered", "share_count")).alias("shares_offered"),
        X.to_double(own("deal_size", "gross_proceeds")).alias("deal_size"),
        F.col("id").alias("source_ipo_id"),
        F.col("_source_status_query").alias("source_status_query"),
    ).where(F.col("symbol").isNotNull() & F.col("ipo_date").isNotNull())


SCHEMAS = {
    "filings": schemas.FILING_PAGE_SCHEMA,
    "tickers": schemas.TICKER_FILE_SCHEMA,
    "vendor": schemas.VENDOR_PAGE_SCHEMA,
}
