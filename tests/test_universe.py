from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from firstprint.functions import columns as X
from firstprint.operators import snapshots as S
from firstprint.operators import universe as U
from firstprint.schemas import FILING_PAGE_SCHEMA, TICKER_FILE_SCHEMA
from firstprint.session import scratch_path
from firstprint.sources import bar_store as BS
from firstprint.sources import landing as L
from firstprint.sources import tables as TB


def one(spark, value, fn, type_="string"):
    return spark.createDataFrame([(value,)], f"v {type_}").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize("text,want", [
    ("2024-03-21", date(2024, 3, 21)), ("2024-03-21T23:30:00Z", date(2024, 3, 21)), (" 2024-03-21T23:30:00-05:00", date(2024, 3, 21)),
    ("2024-03-21 junk", date(2024, 3, 21)), ("20240321", date(2024, 3, 21)), ("soon", None), ("", None), (None, None), ("2024-13-01", None)])
def test_lenient_date(spark, text, want):
    assert one(spark, text, X.lenient_date) == want


@pytest.mark.parametrize("text,want", [
    ("Acme (ACME)  (CIK 0001)", "ACME"), ("Acme (CIK)  (AB)", "AB"), ("Acme (acme) (TOOLONG)", None), ("Acme", None)])
def test_ticker_from_display(spark, text, want):
    assert one(spark, text, X.ticker_from_display) == want


@pytest.mark.parametrize("sic,want", [
    ("1311", "oil_gas"), ("1000", "energy"), ("1600", "industrials"), ("2834", "health_care"), ("3571", "technology"), ("3711", "industrials"),
    ("2000", "consumer_goods"), ("4813", "technology"), ("4911", "energy"), ("4011", "industrials"), ("5045", "consumer_goods"),
    ("5812", "consumer_services"), ("6500", "real_estate"), ("6021", "financials"), ("7372", "technology"), ("8000", "health_care"),
    ("7011", "consumer_services"), ("8700", "industrials"), ("9100", "unknown"), ("0100", "unknown"), ("7", "unknown"), ("x1", "unknown"), (None, "unknown")])
def test_sic_sector(spark, sic, want):
    assert one(spark, sic, X.sic_sector) == want


def test_cik_and_casts(spark):
    assert one(spark, "0000320193", X.canonical_cik) == "320193"
    assert one(spark, "0000", X.canonical_cik) == "0"
    assert one(spark, "1.5", X.to_double) == 1.5 and one(spark, "n/a", X.to_double) is None
    assert one(spark, "12", X.to_long) == 12 and one(spark, "12.7", X.to_long) is None
    assert one(spark, "Common Stock", X.is_common_equity) and not one(spark, "Preferred Unit", X.is_common_equity)
    assert one(spark, None, X.is_common_equity) and not one(spark, "Bond", X.is_common_equity)


def test_filing_pages_from_json_files(spark):
    page = ('{"hits": {"hits": [{"_source": {"ciks": ["0000000012", "9"], "file_date": "2020-02-03T00:00:00", "display_names": ["Acme Inc  (ACME)  (CIK 0000000012)"], '
            '"form": "S-1", "sics": ["7372"], "biz_states": null}}, {"_source": {"ciks": [], "file_date": "2020-02-03"}}, {"_source": {"ciks": ["3"], "file_date": "bad"}}, '
            '{"_source": {"ciks": ["0000000012"], "file_date": "2020-01-03", "display_names": ["Acme Acquisition Corp  (CIK 0000000012)"], "form": "S-1"}}]}}')
    tickers = '{"fields": ["cik", "name", "ticker", "exchange"], "data": [[12, "Acme", "OLD", "NYSE"], [12, "Acme", "ACME", "OTC"], [13, "B", "", null]]}'
    a, b = scratch_path(spark, "pages"), scratch_path(spark, "tickers")
    spark.createDataFrame([(page,)], "v string").coalesce(1).write.text(a)
    spark.createDataFrame([(tickers,)], "v string").coalesce(1).write.text(b)
    filings = L.filings(L.read_json_pages(spark, a, FILING_PAGE_SCHEMA))
    assert filings.count() == 2
    resolved = U.resolve_tickers(U.filings_per_company(filings), L.ticker_map(L.read_json_pages(spark, b, TICKER_FILE_SCHEMA)))
    row = resolved.first()
    assert (row["symbol"], row["ipo_date"], row["filing_count"], row["exchange"], row["ticker_source"]) == ("ACME", date(2020, 1, 3), 2, "OTC", "company_tickers")
    audit = U.filter_filings_universe(resolved).first()
    assert audit["excluded_reasons"] == "spac_name,non_us_exchange" and not audit["included"]


def test_reason_order(spark):
    rows = [("CIK:5", "Some Fund Acquisition Corp", None, "unknown"), ("ABCDW", "Good Co", "NYSE", "company_tickers"),
            ("AB-U", "Good Co", None, "display_name"), ("ABC", "Good Co", "Nasdaq", "company_tickers")]
    df = spark.createDataFrame(rows, "symbol string, company_name string, exchange string, ticker_source string")
    got = {r["symbol"]: (r["excluded_reasons"], r["included"]) for r in U.filter_filings_universe(df).collect()}
    assert got == {"CIK:5": ("spac_name,no_ticker_or_exchange,non_common_by_name,no_ticker_resolved", False),
                   "ABCDW": ("warrant_by_ticker", False), "AB-U": ("unit_by_ticker,preferred_by_ticker", False), "ABC": ("", True)}


def test_metadata_asof_option_and_missing(spark):
    uni = spark.createDataFrame([("A", date(2020, 1, 1), "1", "NYSE"), ("B", date(2020, 1, 1), "2", None)], "symbol string, ipo_date date, cik string, exchange string")
    bars = spark.createDataFrame([("A", datetime(2020, 2, 1))], "symbol string, ts timestamp")
    am = spark.createDataFrame([("1", date(2020, 1, 20)), ("1", date(2020, 3, 1))], "cik string, file_date date")
    got = {r["symbol"]: r for r in U.preflop_metadata(uni, bars, am).collect()}
    assert (got["A"]["preflop_s1a_count"], got["A"]["preflop_days_since_last_amendment"], got["A"]["preflop_s1_lead_days"]) == (2.0, -29.0, 31.0)
    assert (got["B"]["preflop_s1a_count"], got["B"]["preflop_days_since_last_amendment"], got["B"]["preflop_s1_lead_days"]) == (0.0, None, None)
    asof = {r["symbol"]: r for r in U.preflop_metadata(uni, bars, am, asof_listing=True).collect()}
    assert (asof["A"]["preflop_s1a_count"], asof["A"]["preflop_days_since_last_amendment"]) == (1.0, 12.0)
    assert U.preflop_metadata(uni, bars, None).where(F.col("preflop_s1a_count").isNotNull()).count() == 0


def test_sample_is_exact_and_repeatable(spark):
    uni = spark.range(2000).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("symbol"),
                                   F.make_date((2008 + F.col("id") % 18).cast("int"), F.lit(5), F.lit(1)).alias("ipo_date"))
    a = U.stratified_sample(uni)
    counts = dict(a.groupBy("era").count().collect())
    assert counts == {"2010-2016": 30, "2017-2021": 45, "2022-2025": 45}
    b = U.stratified_sample(uni.repartition(5))
    assert sorted(a.select("symbol").collect()) == sorted(b.select("symbol").collect())
    assert sorted(U.stratified_sample(uni, seed=7).select("symbol").collect()) != sorted(a.select("symbol").collect())


def test_ingest_cache_and_refresh(spark):
    def bars(symbol, close):
        return spark.createDataFrame([(symbol, datetime(2020, 1, d), close, close, close, close, 10) for d in (1, 2)],
                                     "symbol string, ts timestamp, open double, high double, low double, close double, volume bigint")

    path = scratch_path(spark, "cache")
    assert [tuple(r) for r in TB.ingest_bars(bars("a", 1.0), path, "1d").collect()] == [("A", 2, False)]
    second = TB.ingest_bars(bars("A", 9.0).unionByName(bars("B", 2.0)), path, "1d")
    assert sorted(tuple(r) for r in second.collect()) == [("A", 2, True), ("B", 2, False)]
    assert TB.read_bars(spark, path, "1d").agg(F.max("close")).first()[0] == 2.0
    TB.ingest_bars(bars("A", 9.0), path, "1d", force_refresh=True)
    got = TB.read_bars(spark, path, "1d").groupBy("symbol").agg(F.max("close"), F.count(F.lit(1))).collect()
    assert sorted(tuple(r) for r in got) == [("A", 9.0, 2), ("B", 2.0, 2)]


def test_bar_store_refreshes_one_symbol(spark):
    """Other buckets keep their files, a refresh that dies leaves the old bars in force, copies do not pile up."""
    def bars(symbols, close):
        return spark.createDataFrame([(s, datetime(2020, 1, d), close, close, close, close, 10) for s in symbols for d in (1, 2)],
                                     "symbol string, ts timestamp, open double, high double, low double, close double, volume bigint")

    def closes(**kw):
        return {r[0]: (r[1], r[2]) for r in BS.read_store(spark, path, "1d", **kw).groupBy("symbol").agg(F.max("close"), F.count(F.lit(1))).collect()}

    def folders():
        return {(r["timeframe"], r["bucket"]): r["generation"] for r in BS.live_folders(spark, path).collect()}

    path, names = scratch_path(spark, "store"), [f"S{i}" for i in range(20)]
    assert BS.read_store(spark, path, "1d").count() == 0 and BS.live_folders(spark, path).count() == 0
    assert {tuple(r) for r in BS.ingest(bars(["s0", *names[1:]], 1.0), path, "1d", buckets=6).collect()} == {(n, 2, False) for n in names}
    BS.ingest(bars(["Q"], 5.0), path, "1h", buckets=6)
    before = folders()
    assert {tuple(r) for r in BS.ingest(bars(["S3"], 9.0), path, "1d").collect()} == {("S3", 2, True)} and folders() == before

    def dies(*a):
        raise OSError("lost")

    with pytest.raises(OSError):
        BS.ingest(bars(["S3"], 9.0), path, "1d", force_refresh=True, publish=dies)
    assert folders() == before and closes() == {n: (1.0, 2) for n in names}
    assert BS.stale_folders(spark, path).count() == 1
    assert [tuple(r) for r in BS.ingest(bars(["s3", None], 9.0), path, "1d", force_refresh=True).collect()] == [("S3", 2, False)]
    assert sum(folders()[k] != g for k, g in before.items()) == 1
    assert closes() == {n: (9.0 if n == "S3" else 1.0, 2) for n in names}
    assert closes(symbols=["s3", "S4", "none"]) == {"S3": (9.0, 2), "S4": (1.0, 2)} and closes(symbols=[]) == {}
    BS.ingest(bars(["New"], 4.0), path, "1d")
    assert BS.live_folders(spark, path).groupBy("timeframe", "bucket").count().where("count > 1").count() == 1
    assert BS.compact(spark, path, "1d", most=1) == 1 and BS.compact(spark, path, "1d", most=1) == 0
    state = folders()
    BS.ingest(bars([], 1.0), path, "1d", force_refresh=True)
    assert folders() == state and len(closes()) == 21 and closes()["NEW"] == (4.0, 2)
    assert BS.read_store(spark, path, "1h").count() == 2
    with pytest.raises(ValueError):
        BS.ingest(bars(["A"], 1.0).drop("close"), path, "1d")


def test_drop_matching_twice(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a_x int, a_keep int, b int, c int")
    once = S.drop_matching(df, ["a_"], ["b"], ["a_keep"])
    assert once.columns == ["a_keep", "c"] and S.drop_matching(once, ["a_"], ["b"], ["a_keep"]).columns == ["a_keep", "c"]


def test_spread_of_continuous_and_empty_columns(spark):
    rows = [(float(i) ** 2, None) for i in range(1001)] + [(None, None)]
    got = {r["column_name"]: r for r in S.null_report(spark.createDataFrame(rows, "v double, w double"), ["v", "w"], spread=True).collect()}
    assert (got["v"]["median"], got["v"]["min"], got["v"]["max"], got["v"]["nulls"]) == (250000.0, 0.0, 1e6, 1)
    assert got["w"]["median"] is None and got["w"]["nulls"] == 1002


def test_content_hash_ignores_layout_but_not_repeats(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    assert TB.content_hash(df).first() == TB.content_hash(df.repartition(7)).first()
    assert TB.content_hash(df.union(df).union(df)).first()[1] != TB.content_hash(df).first()[1]
