"""Listing, bar, filing and score tables derived from the given parquet tables.

The given tables hold no market data, so suppliers play the listed companies, their shipments the
trades, orders the filings and scored rows, events the intraday prints. Everything is derived with
DataFrame operations; the volume of each table follows its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firstprint.functions import columns as X

MARKET = "MKT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_of(key: Column) -> Column:
    return F.concat(F.lit("S"), F.lpad(key.cast("string"), 10, "0"))


def fixture_index(sector: Column) -> Column:
    return F.concat(F.lit("IDX_"), sector)


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a print, and nothing that can be computed from them: this is what a shuffle of prints carries."""
    return table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("d"), F.col("l_quantity").alias("q"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
    )


def _priced(prints: DataFrame, exponent: Column, *keep: str) -> DataFrame:
    """Prints with ``k``, which orders those of a day, and the damped unit price ``px``."""
    unit = (F.col("l_extendedprice") / F.col("q")) / F.lit(1000.0)
    return prints.select(
        *keep, "l_suppkey", "d", "q", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("k"),
        (F.lit(100.0) * F.pow(unit, exponent)).alias("px"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per supplier and ship day: (symbol, ts, d, open, high, low, close, volume, vwap, trade_count).

    Nearly every print is the only one of its supplier and day, so combining before the shuffle would sort (and spill)
    all prints to save next to none. They are dealt by supplier and day as they are and rolled up where they arrive, in
    partitions of the shuffle's size; a supplier with a third of all line items is dealt by its days.
    """
    exponent = F.lit(0.02) + F.lit(0.01) * (F.col("l_suppkey") % 7)
    return (
        _priced(_prints(spark, sf_dir).repartition("l_suppkey", "d"), exponent)
        .groupBy("l_suppkey", "d")
        .agg(
            F.min_by("px", "k").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "k").alias("close"),
            F.sum("q").cast("bigint").alias("volume"),
            (F.sum(F.col("px") * F.col("q")) / F.sum("q")).alias("vwap"),
            F.count(F.lit(1)).alias("trade_count"),
        )
        .select(
            symbol_of(F.col("l_suppkey")).alias("symbol"),
            F.col("d").cast("timestamp").alias("ts"),
            "d", "open", "high", "low", "close", "volume", "vwap", "trade_count",
        )
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier: (symbol, company_name, ipo_date, cik, exchange, sic, sector, filing_count)."""
    key = F.col("s_suppkey")
    geo = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "r_name")
    )
    sic = (
        F.when(F.col("r_name") == "AFRICA", "4911").when(F.col("r_name") == "AMERICA", "7372")
        .when(F.col("r_name") == "ASIA", "3711").when(F.col("r_name") == "EUROPE", "2834").otherwise("6021")
    )
    return (
        table(spark, sf_dir, "supplier")
        .join(geo, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            symbol_of(key).alias("symbol"),
            F.col("s_name").alias("company_name"),
            F.make_date((1995 + key % 6).cast("int"), (1 + key % 12).cast("int"), F.lit(1)).alias("ipo_date"),
            key.cast("string").alias("cik"),
            F.when(key % 4 == 0, "NYSE").when(key % 4 == 1, "Nasdaq").when(key % 4 == 2, "OTC").alias("exchange"),
            sic.alias("sic"),
            X.sic_sector(sic).alias("sector"),
            (1 + key % 3).cast("bigint").alias("filing_count"),
        )
    )


MAX_SUPPLIERS_SENT = 1_000_000  # (key, sector) of one takes about 60 bytes in a task


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the market index and of one index per sector: (index_symbol, d, open, close).

    The first and last order number of each sector and day come from sums over numbers, hashed where the prints lie
    (sectors x days rows leave a task). Only the prints of those orders are then put in order: no print is shuffled or
    sorted for its supplier and day. Up to MAX_SUPPLIERS_SENT suppliers go to the tasks; beyond, Spark shuffles the join.
    """
    suppliers = listings(spark, sf_dir).select(F.col("cik").cast("bigint").alias("l_suppkey"), "sector")
    if table(spark, sf_dir, "supplier").count() <= MAX_SUPPLIERS_SENT:
        suppliers = F.broadcast(suppliers)
    # an order number that is null comes first, as in the order of k
    prints = (
        _prints(spark, sf_dir).join(suppliers, "l_suppkey")
        .withColumns({"index_symbol": fixture_index(F.col("sector")), "_order": F.coalesce("l_orderkey", F.lit(-(1 << 63)))})
    )
    ends = prints.groupBy("index_symbol", "d").agg(F.min("_order").alias("_lo"), F.max("_order").alias("_hi"))
    same = F.col("index_symbol").eqNullSafe(F.col("_ix")) & F.col("d").eqNullSafe(F.col("_day"))
    # one row per sector and day
    ends = F.broadcast(ends.withColumnsRenamed({"index_symbol": "_ix", "d": "_day"}))
    edge = prints.join(ends, same & ((F.col("_order") == F.col("_lo")) | (F.col("_order") == F.col("_hi"))))
    at = F.struct("k", "px")
    per_sector = (
        _priced(edge, F.lit(0.05), "index_symbol").groupBy("index_symbol", "d").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    )
    market = per_sector.groupBy(F.lit(MARKET).alias("index_symbol"), "d").agg(
        F.min("first").alias("first"), F.max("last").alias("last")
    )
    return per_sector.unionByName(market).select(
        "index_symbol", "d", F.col("first.px").alias("open"), F.col("last.px").alias("close")
    )


#: The test series have a bar every four or five days, so 61 sessions span most of a year: all bars count.
HISTORY_DAYS = 36_525


def _ticker(key: Column) -> Column:
    def letter(div: int) -> Column:
        return F.chr(65 + F.floor(key / div).cast("bigint") % 26)

    suffix = F.when(key % 13 == 0, "W").when(key % 13 == 1, "U").otherwise("")
    return F.concat(letter(1), letter(26), letter(676), suffix)


def _name_suffix(key: Column) -> Column:
    return F.when(key % 11 == 0, " Acquisition Corp").when(key % 11 == 1, " Fund").otherwise("")


def filing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, as raw filing fields; the customer key modulo the number of suppliers names the listing."""
    suppliers = listings(spark, sf_dir).select(F.col("cik").cast("bigint").alias("k"), "company_name", "sic")
    key = F.col("k")
    # one row: the number of suppliers
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n_suppliers"))
    orders = table(spark, sf_dir, "orders").join(F.broadcast(n)).withColumn("k", F.col("o_custkey") % F.col("n_suppliers"))
    display = F.concat(
        F.col("company_name"), _name_suffix(key),
        F.when(key % 5 != 0, F.concat(F.lit("  ("), _ticker(key), F.lit(")"))).otherwise(""),
        F.lit("  (CIK "), F.lpad(key.cast("string"), 10, "0"), F.lit(")"),
    )
    form = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "S-1")
        .when(F.col("o_orderpriority") == "2-HIGH", "F-1").otherwise("S-1/A")
    )
    return (
        orders.join(suppliers, "k")
        .select(
            "o_orderkey",
            F.lpad(key.cast("string"), 10, "0").alias("cik10"),
            F.when(F.col("o_orderkey") % 97 == 0, "not a date")
            .otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00"))).alias("file_date"),
            display.alias("display_name"),
            form.alias("form"),
            F.when(key % 9 != 0, F.col("sic")).alias("sic"),
            F.when(key % 2 == 0, "NY").alias("state"),
        )
    )


def filing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filings as landed JSON pages of up to 100 hits each: (page STRING)."""
    source = F.struct(
        F.when(F.col("o_orderkey") % 89 == 0, F.array().cast("array<string>")).otherwise(F.array("cik10")).alias("ciks"),
        "file_date",
        F.array("display_name").alias("display_names"),
        "form",
        F.when(F.col("sic").isNotNull(), F.array("sic")).alias("sics"),
        F.when(F.col("state").isNotNull(), F.array("state")).alias("biz_states"),
    )
    return (
        filing_facts(spark, sf_dir)
        .groupBy(F.floor(F.col("o_orderkey") / 100).alias("page_no"))
        .agg(F.collect_list(F.struct(source.alias("_source"))).alias("hits"))
        .select(F.to_json(F.struct(F.struct("hits").alias("hits"))).alias("page"))
    )


def ticker_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticker files in columnar JSON, up to 1,000 companies each: (file STRING)."""
    key = F.col("cik").cast("bigint")
    row = F.array(
        F.col("cik"), F.col("company_name"),
        F.when(key % 7 == 0, "").otherwise(_ticker(key)), F.col("exchange"),
    )
    return (
        listings(spark, sf_dir).where(key % 3 != 0)
        .groupBy(F.floor(key / 1000).alias("file_no"))
        .agg(F.collect_list(row).alias("data"))
        .select(F.to_json(F.struct(
            F.array(*[F.lit(f) for f in ("cik", "name", "ticker", "exchange")]).alias("fields"), "data",
        )).alias("file"))
    )


def vendor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor listing pages built from customers: (page_no, page STRING, status STRING)."""
    k = F.col("c_custkey")
    s = k.cast("string")
    day = F.concat(F.lit("19"), (90 + k % 10).cast("string"), F.lit("-0"), (1 + k % 9).cast("string"), F.lit("-15"))
    name = F.concat(F.col("c_name"), F.when(k % 17 == 0, " Blank Check").otherwise(""))
    exchange = (
        F.when(k % 6 == 0, "New York Stock Exchange").when(k % 6 == 1, "NASDAQ Global")
        .when(k % 6 == 2, "London").when(k % 6 == 3, "  ")
    )
    kind = F.when(k % 8 == 0, "Unit").when(k % 8 == 1, "Common Stock").when(k % 8 == 2, "Ordinary Shares").when(k % 8 == 3, "Bond")
    sym = F.concat(F.lit(" c"), (k % 40).cast("string"))
    record = F.struct(
        F.struct(F.when(k % 2 == 0, sym).alias("ticker"), F.when(k % 2 == 0, name).alias("name")).alias("company"),
        F.when(k % 19 != 0, sym).alias("symbol"),
        F.concat(F.lit(" "), name).alias("legal_name"),
        s.alias("id"),
        F.when(k % 3 == 0, F.concat(day, F.lit("T10:00:00Z"))).when(k % 23 == 1, "soon").alias("ipo_date"),
        F.when(k % 3 != 0, day).alias("priced_date"),
        F.lit("priced").alias("status"),
        exchange.alias("stock_exchange"),
        kind.alias("security_type"),
        F.when(k % 4 == 0, "n/a").otherwise((k % 50).cast("string")).alias("offer_price"),
        (k * 10).cast("string").alias("share_count"),
    )
    return (
        table(spark, sf_dir, "customer")
        .groupBy(F.floor(k / 100).alias("page_no"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), record.alias("r")))), lambda x: x["r"]).alias("rows"))
        .select(
            "page_no",
            F.when(F.col("page_no") % 2 == 0, F.to_json(F.struct(F.col("rows").alias("ipos"))))
            .otherwise(F.to_json(F.struct(F.col("rows").alias("data")))).alias("page"),
            F.lit("priced").alias("status"),
        )
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored row per order: (row_id, p_tail, sector, yr, adverse_20, severe_30)."""
    key = F.col("o_orderkey")
    p = ((key * 7919) % 1000).cast("double") / F.lit(1000.0)
    u = ((key * 104729 + 13) % 1000).cast("double") / F.lit(1000.0)
    return table(spark, sf_dir, "orders").select(
        key.alias("row_id"),
        p.alias("p_tail"),
        F.col("o_orderpriority").alias("sector"),
        F.year("o_orderdate").alias("yr"),
        F.to_date("o_orderdate").alias("asof_date"),
        (u < p).cast("int").alias("adverse_20"),
        (u < F.lit(0.6) * p * p).cast("int").alias("severe_30"),
    )


def intraday_bars(spark: SparkSession, sf_dir: str, minutes: int) -> DataFrame:
    """Event prints bucketed to ``minutes``: (symbol, ts, open, high, low, close, volume, vwap, trade_count)."""
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("t"),
        "event_id",
        (F.lit(50.0) + F.col("value") / 10).alias("px"),
    )
    return prints_to_bars(ev, minutes)


def prints_to_bars(prints: DataFrame, minutes: int) -> DataFrame:
    """Roll (symbol, t, event_id, px) prints up to bars; combines map-side."""
    width = minutes * 60
    key = F.struct("t", "event_id")
    return (
        prints.groupBy(
            "symbol", F.timestamp_seconds(F.floor(F.unix_timestamp("t") / width) * width).alias("ts")
        )
        .agg(
            F.min_by("px", key).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
            F.max_by("px", key).alias("close"), F.sum(1 + F.col("event_id") % 5).alias("volume"),
            F.avg("px").alias("vwap"), F.count(F.lit(1)).alias("trade_count"),
        )
    )
