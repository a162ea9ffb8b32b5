"""Check queries: sources, projections, universe, bars, features, labels, snapshots, streaming."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from firstprint.functions import columns as X
from firstprint.functions import vocab
from firstprint.operators import bars as B
from firstprint.operators import context as C
from firstprint.operators import ordering as O
from firstprint.operators import snapshots as S
from firstprint.operators import universe as U
from firstprint.plans.oracle import SECTOR_CASE, compose, contains_any, era_case, rd
from firstprint.plans.registry import query, shared, tidy
from firstprint.session import scratch_path
from firstprint.sources import bar_store as BS
from firstprint.sources import fixtures as fx
from firstprint.sources import landing as L
from firstprint.sources import tables as TB
from firstprint.streaming import jobs as ST

# Eras of the fixture's listing years.
ERAS = (("1995-1996", 1995, 1996, 30), ("1997-1998", 1997, 1998, 30), ("1999-2000", 1999, 2000, 30))
BAR_DOUBLES = ("open", "high", "low", "close", "vwap")


def bars(spark, d):
    return shared(spark, d, "bars", lambda: fx.daily_bars(spark, d))


def index_bars(spark, d):
    return shared(spark, d, "index", lambda: fx.index_bars(spark, d))


def sessions(spark, d):
    return B.index_sessions(bars(spark, d), fx.listings(spark, d))


def in_streets(spark, d):
    return sessions(spark, d).where(F.col("street").isNotNull())


def calendar(spark, d):
    return C.index_calendar(index_bars(spark, d))


def filing_pages(spark, d):
    return L.parse_pages(fx.filing_pages(spark, d), "page", L.SCHEMAS["filings"])


def filings(spark, d):
    return L.filings(filing_pages(spark, d))


def ticker_map(spark, d):
    return L.ticker_map(L.parse_pages(fx.ticker_files(spark, d), "file", L.SCHEMAS["tickers"]))


def vendor(spark, d):
    return L.vendor_listings(L.vendor_records(L.parse_pages(fx.vendor_pages(spark, d), "page", L.SCHEMAS["vendor"])))


def universe(spark, d):
    f = filings(spark, d)
    both = f.where(F.col("form_type") == "S-1").unionByName(f.where(F.col("form_type") == "F-1"))
    return U.resolve_tickers(U.filings_per_company(both), ticker_map(spark, d))


def audit(spark, d):
    return U.filter_filings_universe(universe(spark, d))


def metadata(spark, d):
    am = filings(spark, d).where(F.col("form_type") == "S-1/A").select("cik", "file_date")
    return U.preflop_metadata(fx.listings(spark, d), bars(spark, d), am)


def build(spark, d, b=None, ix=None):
    return S.build_snapshots(
        bars(spark, d) if b is None else b, fx.listings(spark, d), index_bars(spark, d) if ix is None else ix,
        market=fx.MARKET, sector_index=fx.fixture_index, history_days=fx.HISTORY_DAYS)


def snapshots(spark, d):
    return shared(spark, d, "snapshots", lambda: build(spark, d))


def rounded(names, digits=8, prefix=""):
    return ", ".join(f"{rd(prefix + n, digits)} as {n}" for n in names)


# ---- sources and sinks ----------------------------------------------------------------------------

@query("s01_parquet_scan", "select l_orderkey, l_quantity from lineitem where l_shipdate >= timestamp '2000-06-01'")
def _(spark, d):
    li = fx.table(spark, d, "lineitem")
    return li.where(F.col("l_shipdate") >= F.lit("2000-06-01").cast("timestamp_ntz")).select("l_orderkey", "l_quantity")


_BARS_SQL = compose(f"select symbol, d, {rounded(BAR_DOUBLES)}, volume, trade_count from bars", "bars")


@query("s02_parquet_sink", _BARS_SQL)
def _(spark, d):
    path = scratch_path(spark, "dataset")
    TB.save_dataset(fx.daily_bars(spark, d), path)
    return tidy(spark.read.parquet(path).drop("ts"))


@query("s03_bars_layout", compose(f"select symbol, d, {rounded(BAR_DOUBLES)}, volume, trade_count, '1d' timeframe from bars", "bars"))
def _(spark, d):
    path = scratch_path(spark, "layout")
    TB.write_bars(bars(spark, d), path, "1d")
    TB.write_bars(fx.intraday_bars(spark, d, 60).withColumn("volume", F.col("volume").cast("bigint")), path, "1h")
    return tidy(TB.read_bars(spark, path, "1d").withColumn("d", F.to_date("ts")).drop("ts"))


@query("s04_csv_sink", compose("select symbol, company_name, ipo_date::varchar ipo_date, cik from aud where included", "aud"))
def _(spark, d):
    path = scratch_path(spark, "csv")
    TB.write_csv(audit(spark, d).where("included").select("symbol", "company_name", "ipo_date", "cik"), path)
    return spark.read.option("header", True).schema("symbol string, company_name string, ipo_date string, cik string").csv(path)


@query("s05_filings", compose("select cik, company_name, display_name, file_date, form_type, sic, state from fil", "fil"))
def _(spark, d):
    return filings(spark, d)


@query("s06_ticker_map", compose("select cik, ticker, name, exchange from tik", "tik"))
def _(spark, d):
    return ticker_map(spark, d)


@query("s07_vendor_records", "select c_custkey::varchar id, 'priced' status_query from customer")
def _(spark, d):
    recs = L.vendor_records(L.parse_pages(fx.vendor_pages(spark, d), "page", L.SCHEMAS["vendor"]))
    return recs.select("id", F.col("_source_status_query").alias("status_query"))


@query("s08_amendments", compose("select cik, file_date from fil where form_type='S-1/A'", "fil"))
def _(spark, d):
    return L.filings(filing_pages(spark, d)).where(F.col("form_type") == "S-1/A").select("cik", "file_date")


@query("s09_normalise_bars", compose(f"""
    select upper(symbol) symbol, ts, {rd('arg_max(px,event_id)')} as open, {rd('arg_max(px,event_id)')} as high,
           {rd('arg_max(px,event_id)')} as low, {rd('arg_max(px,event_id)')} as close, arg_max(event_id,event_id) as volume
    from (select symbol, time_bucket(interval 60 minute, ts)::timestamp ts, event_id, px from sevents) group by 1,2""", "sevents"))
def _(spark, d):
    ev = fx.table(spark, d, "events")
    hour = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) * 3600)
    px = F.lit(50.0) + F.col("value") / 10
    raw = ev.select(F.col("event_type").alias("symbol"), hour.alias("timestamp"), px.alias("open"), px.alias("high"),
                    px.alias("low"), px.alias("close"), F.col("event_id").cast("string").alias("volume"),
                    F.col("event_id").alias("ingest_seq"))
    return tidy(B.normalise_bars(raw).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("s11_incremental_ingest", compose("""
    select symbol, count(*) as rows, (right(symbol,1)::int%2=0) from_cache from bars group by 1""", "bars"))
def _(spark, d):
    path = scratch_path(spark, "ingest")
    every = bars(spark, d)
    TB.ingest_bars(every.where(F.right("symbol", F.lit(1)).cast("int") % 2 == 0), path, "1d")
    return TB.ingest_bars(every, path, "1d")


@query("s11_refresh_symbols", compose(f"""
    select symbol, count(*) as rows, {rd("sum(case when right(symbol,1)='3' then close*2 else close end)", 6)} closes from bars group by 1""", "bars"))
def _(spark, d):
    """Every bar stored in two steps; then the symbols that end in 3 are replaced, in their buckets only."""
    path = scratch_path(spark, "store")
    every, third = bars(spark, d), F.right("symbol", F.lit(1)) == "3"
    BS.ingest(every.where(third), path, "1d")
    BS.ingest(every, path, "1d")
    BS.ingest(every.where(third).withColumn("close", F.col("close") * 2), path, "1d", force_refresh=True)
    return tidy(BS.read_store(spark, path, "1d").groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("close").alias("closes")), 6)


@query("s12_resume", compose("select symbol from lst where right(symbol,1)::int%3<>0", "lst"))
def _(spark, d):
    path = scratch_path(spark, "processed")
    todo = fx.listings(spark, d).select("symbol")
    TB.mark_processed(todo.where(F.right("symbol", F.lit(1)).cast("int") % 3 == 0), path)
    return TB.unprocessed(todo, spark.read.parquet(path))


@query("s13_manifest", compose("select action, count(*) n from acted group by 1", "acted"))
def _(spark, d):
    from firstprint.operators import policy as P

    path = scratch_path(spark, "manifest")
    TB.write_manifest(P.action_counts(P.with_action(fx.scored(spark, d))), path)
    return spark.read.schema("action string, n bigint").json(path)


@query("s14_content_hash")
def _(spark, d):
    files = TB.file_hashes(spark, f"{d}/lineitem.parquet").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content_hash").alias("file_hash"))
    # one row
    return files.join(F.broadcast(TB.content_hash(fx.table(spark, d, "lineitem"))))


@query("s15_registry_head", compose("select symbol, ipo_date, sector from lst order by symbol limit 25", "lst"))
def _(spark, d):
    return fx.listings(spark, d).select("symbol", "ipo_date", "sector").orderBy("symbol").limit(25)


@query("s16_bars_available", compose("""
    select l.symbol, exists(select 1 from bars b where b.symbol=l.symbol and b.d>=l.ipo_date and b.d<l.ipo_date+interval 30 day) bars_available
    from lst l""", "bars", "lst"))
def _(spark, d):
    return U.with_bars_available(fx.listings(spark, d), bars(spark, d)).select("symbol", "bars_available")


@query("s17_first_trade", compose("""
    with o as (select *, row_number() over (order by ipo_date, symbol) rn from lst),
         g as (select o.symbol, o.ipo_date, rn, min(b.d) f, count(b.d) c from o left join bars b on b.symbol=o.symbol
               and b.d between o.ipo_date-interval 3 day and o.ipo_date+interval 30 day group by 1,2,3)
    select symbol, case when rn<=80 then c>0 end has_daily_bars, case when rn<=80 then f end first_trade_date,
           case when rn<=80 then (f-ipo_date)::int end first_trade_days_from_ipo, case when rn<=80 then c end bar_count_30d from g""", "bars", "lst"))
def _(spark, d):
    return U.with_first_trade(fx.listings(spark, d), bars(spark, d), 80).select(
        "symbol", "has_daily_bars", "first_trade_date", "first_trade_days_from_ipo", "bar_count_30d")


@query("s18_coverage_by_era", compose(f"""
    with a as (select {era_case('year(ipo_date)', ERAS)} era, exists(select 1 from bars b where b.symbol=l.symbol
               and b.d>=l.ipo_date and b.d<l.ipo_date+interval 30 day) ok from lst l)
    select era, count(*) filter (where ok) n_available, count(*) n_listed from a group by 1""", "bars", "lst"))
def _(spark, d):
    return U.coverage_by_era(U.with_bars_available(fx.listings(spark, d), bars(spark, d)), eras=ERAS)


@query("s19_provenance", compose(f"""
    select symbol, ipo_date, 'vendor' source_provider, 'landed' source_endpoint, '2026-01-01T00:00:00+00:00' source_fetched_at_utc,
           '{vocab.VENDOR_FILTER_VERSION}' filter_version, date '1990-01-01' build_start_date, date '1999-12-31' build_end_date from vded""", "vded"))
def _(spark, d):
    base = U.dedupe_vendor(vendor(spark, d)).select("symbol", "ipo_date")
    return U.with_provenance(base, "vendor", "landed", "2026-01-01T00:00:00+00:00", date(1990, 1, 1), date(1999, 12, 31))


# ---- scalar projections -----------------------------------------------------------------------------

def projection(name, table, sql, cols):
    """A query of expressions over one given table; ``cols`` builds them once a session exists."""
    @query(name, sql)
    def _(spark, d):
        return fx.table(spark, d, table).select(*[c.alias(n) for n, c in cols().items()])


projection("p01_norm_text", "documents", "select doc_id, lower(trim(coalesce(source,''))) src, length(lower(trim(text,' '))) n from documents", lambda: dict(
           doc_id=F.col("doc_id"), src=X.norm_text(F.col("source")), n=F.length(X.norm_text(F.col("text"))).cast("bigint")))


def _iso():
    return F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(
    F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 2, "pending")


projection("p02_lenient_date", "orders", "select o_orderkey, case when o_orderkey%4 in (0,1) then o_orderdate::date end d from orders", lambda: dict(
           o_orderkey=F.col("o_orderkey"), d=X.lenient_date(_iso())))


def _num():
    return F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))


projection("p03_safe_casts", "orders", f"select o_orderkey, case when o_orderkey%3<>0 then {rd('o_totalprice', 4)} end x, case when o_orderkey%3<>0 then o_custkey end n from orders", lambda: dict(
           o_orderkey=F.col("o_orderkey"), x=F.round(X.to_double(_num()), 4),
           n=X.to_long(F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_custkey").cast("string")))))
projection("p04_first_non_blank", "customer", "select c_custkey, coalesce(case when c_custkey%3=0 then c_mktsegment end, c_name) v from customer", lambda: dict(
           c_custkey=F.col("c_custkey"), v=X.first_non_blank(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise("  "), F.col("c_name"))))


@query("p05_company_field", compose("select source_ipo_id, symbol, company_name, exchange_raw from ven", "ven"))
def _(spark, d):
    return vendor(spark, d).select("source_ipo_id", "symbol", "company_name", "exchange_raw")


@query("p06_vendor_listings", compose(f"""select source_ipo_id, symbol, company_name, ipo_date, status, exchange_raw, security_type_raw,
    {rd('offer_price', 4)} offer_price, null::double offer_price_low, null::double offer_price_high, shares_offered,
    null::double deal_size, source_status_query from ven""", "ven"))
def _(spark, d):
    return tidy(vendor(spark, d).drop("seq"), 4)


@query("p07_ticker_from_display", compose(r"""select display_name, list_filter(regexp_extract_all(display_name,'\(([A-Z]{1,5})\)',1), lambda z: z<>'CIK')[1] ticker
    from (select distinct display_name from fil)""", "fil"))
def _(spark, d):
    return filings(spark, d).select("display_name").distinct().withColumn("ticker", X.ticker_from_display(F.col("display_name")))


@query("p08_entity_name", compose("select distinct display_name, trim(split_part(display_name,'(',1)) entity from fil", "fil"))
def _(spark, d):
    return filings(spark, d).select("display_name").distinct().withColumn("entity", X.entity_name(F.col("display_name")))


projection("p09_canonical_cik", "customer", "select c_custkey, c_custkey::varchar cik from customer", lambda: dict(
           c_custkey=F.col("c_custkey"), cik=X.canonical_cik(F.lpad(F.col("c_custkey").cast("string"), 10, "0"))))
projection("p10_first_element", "documents", "select doc_id, string_split(source,'-')[1] head, null::varchar missing from documents", lambda: dict(
           doc_id=F.col("doc_id"), head=X.first_element(F.split("source", "-")), missing=X.first_element(F.filter(F.split("source", "-"), lambda x: x == ""))))


@query("p11_spac_name", compose(f"select distinct company_name, {contains_any('lower(trim(company_name))', vocab.FILING_SPAC_TERMS)} spac from fil", "fil"))
def _(spark, d):
    return filings(spark, d).select("company_name").distinct().withColumn("spac", X.is_spac(F.col("company_name")))


_LOWER_EXCHANGE = "lower(coalesce(exchange_raw,''))"


@query("p12_us_exchange", compose(f"select source_ipo_id, {contains_any(_LOWER_EXCHANGE, vocab.VENDOR_EXCHANGES)} us from ven", "ven"))
def _(spark, d):
    return vendor(spark, d).select("source_ipo_id", X.is_us_exchange(F.col("exchange_raw")).alias("us"))


@query("p13_common_equity", compose(f"""select source_ipo_id, case when security_type_raw is null then true
    when {contains_any('lower(security_type_raw)', vocab.VENDOR_NON_COMMON_TERMS)} then false
    else {contains_any('lower(security_type_raw)', vocab.VENDOR_COMMON_TERMS)} end common from ven""", "ven"))
def _(spark, d):
    return vendor(spark, d).select("source_ipo_id", X.is_common_equity(F.col("security_type_raw")).alias("common"))


projection("p14_non_common_name", "documents", f"select doc_id, {contains_any('lower(trim(text))', vocab.FILING_NON_COMMON_TERMS)} hit from documents", lambda: dict(
           doc_id=F.col("doc_id"), hit=X.contains_any(X.norm_text(F.col("text")), vocab.FILING_NON_COMMON_TERMS)))


@query("p15_common_ticker", compose("""select symbol, cik from uni where not (length(symbol)>3 and (ends_with(symbol,'W') or ends_with(symbol,'U')))
    and not contains(symbol,'-')""", "uni"))
def _(spark, d):
    return universe(spark, d).where(X.is_common_ticker(F.col("symbol"))).select("symbol", "cik")


_AUD = "symbol, company_name, ipo_date, cik, exchange, sic, state, ticker_source, filing_count, excluded_reasons, included"


@query("p16_filing_filters", compose(f"select {_AUD} from aud", "aud"))
def _(spark, d):
    return audit(spark, d)


_VAUD = f"""with r as (select *, concat_ws(',',
      case when ipo_date<date '1991-01-01' or ipo_date>date '1998-12-31' then 'outside_date_window' end,
      case when {contains_any('lower(company_name)', vocab.VENDOR_SPAC_TERMS)} then 'spac_name' end,
      case when not {contains_any(_LOWER_EXCHANGE, vocab.VENDOR_EXCHANGES)} then 'non_us_exchange_or_missing' end,
      case when not (case when security_type_raw is null then true when {contains_any('lower(security_type_raw)', vocab.VENDOR_NON_COMMON_TERMS)} then false
           else {contains_any('lower(security_type_raw)', vocab.VENDOR_COMMON_TERMS)} end) then 'non_common_security_type' end) excluded_reasons from vded)"""


def vendor_audit(spark, d):
    return U.filter_vendor_universe(U.dedupe_vendor(vendor(spark, d)), date(1991, 1, 1), date(1998, 12, 31))


@query("p16_vendor_filters", compose(_VAUD + " select symbol, ipo_date, source_ipo_id, excluded_reasons, excluded_reasons='' included from r", "vded"))
def _(spark, d):
    return vendor_audit(spark, d).select("symbol", "ipo_date", "source_ipo_id", "excluded_reasons", "included")


projection("p17_sic_sector", "part", f"select p_partkey, {SECTOR_CASE.format(s='s')} sector from (select p_partkey, case when p_partkey%50=0 then 'x1' when p_partkey%51=0 then '7' else lpad(((p_partkey*37)%10000)::varchar,4,'0') end s from part)", lambda: dict(
           p_partkey=F.col("p_partkey"), sector=X.sic_sector(F.when(F.col("p_partkey") % 50 == 0, "x1").when(F.col("p_partkey") % 51 == 0, "7").otherwise(
               F.lpad(((F.col("p_partkey") * 37) % 10000).cast("string"), 4, "0")))))
_MAP = "case sector " + " ".join(f"when '{k}' then '{v}'" for k, v in vocab.SECTOR_INDEX.items()) + " end"


@query("p18_sector_index", compose(f"select symbol, {_MAP} proxy from lst", "lst"))
def _(spark, d):
    return fx.listings(spark, d).select("symbol", X.sector_index(F.col("sector")).alias("proxy"))


projection("p19_era", "orders", f"select o_orderkey, {era_case('(year(o_orderdate)+18)')} era from orders", lambda: dict(
           o_orderkey=F.col("o_orderkey"), era=X.era_label(F.year("o_orderdate") + 18)))
projection("p20_calendar", "orders", "select o_orderkey, month(o_orderdate)::double m, (isodow(o_orderdate)-1)::double wd from orders", lambda: dict(
           o_orderkey=F.col("o_orderkey"), m=F.month("o_orderdate").cast("double"), wd=F.weekday("o_orderdate").cast("double")))


@query("p21_exchange_flags", compose("select symbol, preflop_exchange_nyse, preflop_exchange_nasdaq from meta", "meta"))
def _(spark, d):
    return metadata(spark, d).select("symbol", "preflop_exchange_nyse", "preflop_exchange_nasdaq")


@query("p22_sector_one_hot", compose("select symbol, " + ", ".join(f"(sector='{s}')::int::double preflop_sector_{s}" for s in vocab.ONE_HOT_SECTORS) + " from lst", "lst"))
def _(spark, d):
    return fx.listings(spark, d).select("symbol", *[(F.col("sector") == s).cast("double").alias(f"preflop_sector_{s}") for s in vocab.ONE_HOT_SECTORS])


@query("p23_date_differences", compose("select symbol, preflop_s1_lead_days, preflop_days_since_last_amendment from meta", "meta"))
def _(spark, d):
    return metadata(spark, d).select("symbol", "preflop_s1_lead_days", "preflop_days_since_last_amendment")


_AUG = compose(f"""select s.symbol, s.street, coalesce(m.preflop_s1_lead_days,(select coalesce(quantile_cont(m2.preflop_s1_lead_days,0.5),0)
      from snap s2 left join meta m2 using (symbol))) preflop_s1_lead_days,
    coalesce(m.preflop_exchange_nyse,0) preflop_exchange_nyse, coalesce(m.preflop_exchange_nasdaq,0) preflop_exchange_nasdaq,
    coalesce(m.preflop_s1a_count,0) preflop_s1a_count, coalesce(m.preflop_days_since_last_amendment,-1) preflop_days_since_last_amendment,
    {', '.join(f"(s.sector='{x}')::int::double preflop_sector_{x}" for x in vocab.ONE_HOT_SECTORS)}
    from snap s left join meta m using (symbol)""", "snap", "meta")


def augmented(spark, d):
    return shared(spark, d, "augmented", lambda: S.augment_with_metadata(snapshots(spark, d), metadata(spark, d)))


@query("p24_null_fill", _AUG)
def _(spark, d):
    one_hots = [f"preflop_sector_{s}" for s in vocab.ONE_HOT_SECTORS]
    return augmented(spark, d).select("symbol", "street", *vocab.METADATA_FEATURES, *one_hots)


@query("p25_drop_generated", f"select *, false stale_left, true context_kept from ({_AUG})")
def _(spark, d):
    """Metadata columns over a table that has them already, wrong, with one that is no longer made: the table comes out right."""
    one_hots = [f"preflop_sector_{s}" for s in vocab.ONE_HOT_SECTORS]
    stale = augmented(spark, d).withColumns({c: F.lit(-9.0) for c in (*vocab.METADATA_FEATURES, *one_hots, "preflop_sector_retired")})
    fresh = S.augment_with_metadata(stale, metadata(spark, d))
    return fresh.select("symbol", "street", *vocab.METADATA_FEATURES, *one_hots, F.lit("preflop_sector_retired" in fresh.columns).alias("stale_left"),
                        F.lit(set(vocab.CONTEXT_COLUMNS) <= set(fresh.columns)).alias("context_kept"))


_FEATS = [*vocab.PREFLOP_FEATURES, *[f"{s.lower()}_{f}" for s in vocab.STREETS for f in S.STREET_FEATURES]]


@query("p26_null_counts", compose(" union all ".join(f"select '{c}' column_name, count(*) filter (where {c} is null) nulls from snap" for c in _FEATS), "snap"))
def _(spark, d):
    return S.null_report(snapshots(spark, d), _FEATS).drop("mean")


projection("p27_log1p", "orders", f"select o_orderkey, {rd('ln(1+o_totalprice)')} v from orders", lambda: dict(
           o_orderkey=F.col("o_orderkey"), v=F.round(F.log1p("o_totalprice"), 8)))


@query("p28_standardise", f"""with m as (select avg(l_quantity) a, stddev_pop(l_quantity) s, avg(l_extendedprice) b, stddev_pop(l_extendedprice) t from lineitem)
    select l_orderkey, l_linenumber, {rd('(l_quantity-a)/s', 6)} l_quantity, {rd('(l_extendedprice-b)/t', 6)} l_extendedprice from lineitem, m""")
def _(spark, d):
    from firstprint.operators.committee import standardised

    li = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return tidy(standardised(li, ["l_quantity", "l_extendedprice"]), 6)


@query("p29_action", compose("select row_id, action from acted", "acted"))
def _(spark, d):
    from firstprint.operators import policy as P

    return P.with_action(fx.scored(spark, d)).select("row_id", "action")


@query("p30_crude_probability", compose(f"select row_id, {rd('least(greatest((p_tail-0.5::double)/0.25::double,0),1)')} p from scored", "scored"))
def _(spark, d):
    return tidy(fx.scored(spark, d).select("row_id", X.crude_probability(F.col("p_tail") - 0.5).alias("p")))


@query("p31_event_labels", compose(f"""select symbol, d, {rd('-forward_mdd_20d')} risk_severity, (-forward_mdd_20d>=0.2::double)::int adverse_20,
    (-forward_mdd_20d>=0.3::double)::int severe_30 from lab""", "lab"))
def _(spark, d):
    return tidy(X.with_event_labels(B.forward_extremes(sessions(spark, d), (20,))).select("symbol", "d", "risk_severity", "adverse_20", "severe_30"))


@query("p32_min_fsr", compose(f"""with s as (select sector, avg(severe_30) p, avg(case when p_tail<0.3::double then 1.0::double else 0 end) c from scored group by 1)
    select sector, {rd('case when p<=0 or c<=0 then 0 else greatest(0,(p-(1-c))/p) end')} min_fsr,
           {rd('case when p<=0 then 0 else greatest(0,(p-(1-0.9::double))/p) end')} min_fsr_at_90 from s""", "scored"))
def _(spark, d):
    g = fx.scored(spark, d).groupBy("sector").agg(F.avg(F.col("severe_30").cast("double")).alias("p"), F.avg((F.col("p_tail") < 0.3).cast("double")).alias("c"))
    return tidy(g.select("sector", X.min_false_safe_rate(F.col("p"), F.col("c")).alias("min_fsr"),
                         X.min_false_safe_rate(F.col("p"), F.lit(0.9)).alias("min_fsr_at_90")))


projection("p33_year", "orders", "select o_orderkey, year(o_orderdate)::int yr from orders", lambda: dict(
           o_orderkey=F.col("o_orderkey"), yr=F.year("o_orderdate")))

_COLS = ("log_return", "rng", "dollar_volume", "overnight_gap", "drawdown")


@query("p34_bar_columns", compose(f"select symbol, street, d, {rounded(_COLS)} from barcols", "barcols"))
def _(spark, d):
    cols = B.with_bar_columns(in_streets(spark, d)).withColumnRenamed("range", "rng")
    return tidy(cols.select("symbol", "street", "d", *_COLS))


@query("p35_street_timeframe", compose("select symbol, street, '1d' timeframe from win", "win"))
def _(spark, d):
    return B.street_windows(sessions(spark, d)).select("symbol", "street", X.street_timeframe(F.col("street")).alias("timeframe"))


# ---- filters ------------------------------------------------------------------------------------------

@query("f01_window_filter", compose("select symbol, d, volume from ses where d>=ipo_date and d<ipo_date+interval 90 day", "ses"))
def _(spark, d):
    s = sessions(spark, d)
    return s.where(B.in_half_open(F.col("d"), F.col("ipo_date"), F.date_add("ipo_date", 90))).select("symbol", "d", "volume")


@query("f02_market_hours", """select event_id, ts::time < time '15:30:00' first_hour from events where ts::time >= time '14:30:00' and ts::time < time '21:00:00'""")
def _(spark, d):
    ev = fx.table(spark, d, "events")
    return ev.where(X.in_market_hours(F.col("ts"))).select("event_id", (F.date_format("ts", "HH:mm:ss") < vocab.FIRST_HOUR_END).alias("first_hour"))


@query("f03_labelled_river", compose(f"select symbol, asof_date, {rd('risk_severity')} risk_severity from river", "river"))
def _(spark, d):
    s = snapshots(spark, d)
    return tidy(s.where((F.col("street") == "RIVER") & F.col("risk_severity").isNotNull()).select("symbol", "asof_date", "risk_severity"))


FOLDS = ((1997, 1998), (1998, 1999), (1999, 2000), (2000, 2001))
_FOLD_VALUES = "(values " + ",".join(f"({i},{a},{b})" for i, (a, b) in enumerate(FOLDS)) + ") f(fold_id,train_end,test_year)"


@query("f04_fold_members", compose(f"""select row_id, fold_id, case when yr<=train_end then 'train' else 'test' end as role
    from scored join {_FOLD_VALUES} on yr<=train_end or yr=test_year""", "scored"))
def _(spark, d):
    from firstprint.plans.evaluation import fold_members

    return fold_members(fx.scored(spark, d), FOLDS).select("row_id", "fold_id", "role")


@query("f05_positive_dollar_volume", compose(f"""select symbol, {rd('avg(abs(log_return)/dollar_volume) filter (where dollar_volume>0)', 12)} amihud from barcols group by 1""", "barcols"))
def _(spark, d):
    dv = F.col("dollar_volume")
    b = B.with_bar_columns(in_streets(spark, d))
    return tidy(b.groupBy("symbol").agg(F.avg(F.when(dv > 0, F.abs("log_return") / dv)).alias("amihud")), 12)


@query("f06_date_window", compose("select symbol, ipo_date, not (ipo_date<date '1991-01-01' or ipo_date>date '1998-12-31') inside from vded", "vded"))
def _(spark, d):
    a = vendor_audit(spark, d)
    return a.select("symbol", "ipo_date", (~F.col("excluded_reasons").contains("outside_date_window")).alias("inside"))


# ---- windows ------------------------------------------------------------------------------------------

@query("w01_lag_in_street", compose(f"select symbol, street, d, {rounded(('log_return', 'overnight_gap'))} from barcols", "barcols"))
def _(spark, d):
    return tidy(B.with_bar_columns(in_streets(spark, d)).select("symbol", "street", "d", "log_return", "overnight_gap"))


@query("w02_running_drawdown", compose(f"select symbol, street, {rd('min(drawdown)')} max_drawdown from barcols group by 1,2", "barcols"))
def _(spark, d):
    return tidy(B.with_bar_columns(in_streets(spark, d)).groupBy("symbol", "street").agg(F.min("drawdown").alias("max_drawdown")))


@query("w03_street_windows", compose("select symbol, street, win_start, asof_date, win_end, sessions from win", "win"))
def _(spark, d):
    return B.street_windows(sessions(spark, d))


@query("w04_forward_mdd", compose(f"select symbol, d, {rounded(('forward_mdd_7d', 'forward_mdd_20d'))} from lab", "lab"))
def _(spark, d):
    return tidy(B.forward_extremes(sessions(spark, d)).select("symbol", "d", "forward_mdd_7d", "forward_mdd_20d"))


@query("w05_forward_mfr", compose(f"select symbol, d, {rounded(('forward_mfr_7d', 'forward_mfr_20d'))} from lab", "lab"))
def _(spark, d):
    return tidy(B.forward_extremes(sessions(spark, d)).select("symbol", "d", "forward_mfr_7d", "forward_mfr_20d"))


_CARRIED = [f"{s.lower()}_{f}" for s in vocab.STREETS for f in ("cum_return", "realized_vol")]


@query("w06_accumulated_features", compose(f"select symbol, street, {rounded(_CARRIED)} from snap", "snap"))
def _(spark, d):
    feats = B.daily_features(in_streets(spark, d)).where("bars >= 2")
    return tidy(S.accumulate_streets(feats.select("symbol", "street", "cum_return", "realized_vol"), ("cum_return", "realized_vol")))


@query("w07_temporal_blocks", compose("select row_id, (ntile(4) over (order by asof_date,row_id)-1)::int block from scored", "scored"))
def _(spark, d):
    return O.temporal_blocks(fx.scored(spark, d).select("row_id", "asof_date"), ["asof_date", "row_id"], 4).select("row_id", "block")


@query("w08_first_metadata_row", compose("select symbol, preflop_s1_lead_days, preflop_s1a_count from meta", "meta"))
def _(spark, d):
    m = metadata(spark, d)
    later = m.withColumns({"s1_filing_date": F.date_add("s1_filing_date", 5), "preflop_s1a_count": F.lit(-9.0)})
    keep = F.min_by(F.struct("preflop_s1_lead_days", "preflop_s1a_count"), "s1_filing_date").alias("m")
    return m.unionByName(later).groupBy("symbol").agg(keep).select("symbol", "m.*")


@query("w09_vendor_dedupe", compose("select symbol, ipo_date, source_ipo_id, exchange_raw, security_type_raw from vded", "vded"))
def _(spark, d):
    return U.dedupe_vendor(vendor(spark, d)).select("symbol", "ipo_date", "source_ipo_id", "exchange_raw", "security_type_raw")


_SPLIT = """select symbol, case when rn<floor(n*0.6::double) then 'train' when rn<floor(n*(0.6::double+0.2::double)) then 'val' else 'test' end split
    from (select symbol, row_number() over (order by min(asof_date), symbol)-1 rn, count(*) over () n from win group by symbol)"""


@query("w10_temporal_split", compose(_SPLIT, "win"))
def _(spark, d):
    return O.temporal_split(B.street_windows(sessions(spark, d))).select("symbol", "split").distinct()


@query("w11_rolled_labels", compose("""with r as (select row_id, adverse_20, row_number() over (order by asof_date,row_id)-1 rn, count(*) over () n from scored)
    select a.row_id, b.adverse_20 rolled from r a join r b on a.rn=(b.rn+5)%a.n""", "scored"))
def _(spark, d):
    return O.rolled(fx.scored(spark, d).select("row_id", "asof_date", "adverse_20"), ["asof_date", "row_id"], "adverse_20", 5).select("row_id", "rolled")


# ---- aggregations over bars, context and universe -------------------------------------------------------

@query("a01_daily_features", compose(f"select symbol, street, {', '.join(rd(f, 12 if f == 'amihud_illiquidity' else 6) + ' as ' + f for f in vocab.DAILY_FEATURES)} from feat", "feat"))
def _(spark, d):
    return tidy(B.daily_features(in_streets(spark, d)).where("bars >= 2").drop("bars"), 6, amihud_illiquidity=12)


def regime(spark, d):
    w = B.street_windows(sessions(spark, d)).join(fx.listings(spark, d).select("symbol", "sector"), "symbol")
    return C.regime_features(w, calendar(spark, d), fx.MARKET, fx.fixture_index(F.col("sector")))


_REG = compose(f"select symbol, street, {rounded(vocab.REGIME_FEATURES)} from reg", "reg")


@query("a02_regime_features", _REG)
def _(spark, d):
    return tidy(regime(spark, d).select("symbol", "street", *vocab.REGIME_FEATURES))


@query("j04_index_range_join", compose("""select w.symbol, w.street, count(i.d) n_bars from win w left join idx i on i.index_symbol='MKT' and i.d>=w.win_start and i.d<w.win_end group by 1,2""", "win", "idx"))
def _(spark, d):
    return regime(spark, d).select("symbol", "street", F.col("spy_n").cast("bigint").alias("n_bars"))


@query("a03_preflop_features", compose(f"select symbol, {rounded(vocab.PREFLOP_FEATURES)} from pre", "pre"))
def _(spark, d):
    p = C.preflop_features(fx.listings(spark, d), calendar(spark, d), fx.MARKET, fx.fixture_index(F.col("sector")))
    return tidy(p.select("symbol", *vocab.PREFLOP_FEATURES))


@query("a04_pre_listing_stats", compose(f"select symbol, {rounded(('preflop_spy_return_20d', 'preflop_spy_vol_20d'))} from pre", "pre"))
def _(spark, d):
    p = C.with_pre_listing_stats(fx.listings(spark, d), calendar(spark, d), F.lit(fx.MARKET), "preflop_spy")
    return tidy(p.select("symbol", "preflop_spy_return_20d", "preflop_spy_vol_20d"))


_HOURS5 = """h as (select *, ts::date d from intra5 where ts::time>=time '14:30:00' and ts::time<time '21:00:00'),
    x as (select *, (low-max(high) over w)/max(high) over w dd from h window w as (partition by symbol,d order by ts rows unbounded preceding)),
    g as (select symbol, d, arg_min(open,ts) o, arg_max(close,ts) c, arg_max(close,ts) filter (where ts::time<time '15:30:00') hc,
      coalesce(sum(volume) filter (where ts::time<time '15:30:00'),0) hv, sum(volume) v, sum(trade_count) t, avg(vwap) vw, min(ts) t0,
      arg_min(ts,(-high,ts)) top, min(dd) intraday_mdd from x group by 1,2)"""


@query("a05_opening_day_features", compose(f"""with {_HOURS5} select symbol, d, {rd('(coalesce(hc,o)-o)/o')} first_hour_return, {rd('(c-coalesce(hc,o))/coalesce(hc,o)')} rest_of_day_return,
    {rd('hv::double/v')} volume_first_hour_pct, {rd('v::double/t')} avg_trade_size, {rd('(c-vw)/vw')} close_vs_vwap,
    {rd('(epoch_us(top)-epoch_us(t0))/60000000.0::double')} time_to_high_minutes, {rd('intraday_mdd')} intraday_mdd from g""", "intra5"))
def _(spark, d):
    return tidy(B.opening_day_features(fx.intraday_bars(spark, d, 5).withColumn("d", F.to_date("ts"))))


@query("a06_hourly_to_daily", compose(f"""select symbol, ts::date d, {rd('arg_min(open,ts)')} day_open, {rd('arg_max(close,ts)')} day_close,
    {rd('max(high)')} day_high, {rd('min(low)')} day_low, sum(volume)::bigint day_volume from intra60 group by 1,2""", "intra60"))
def _(spark, d):
    return tidy(B.hourly_to_daily(fx.intraday_bars(spark, d, 60)))


_HOURS60 = """h as (select *, ts::date d, date_trunc('week', ts)::date as week from intra60 where ts::time>=time '14:30:00' and ts::time<time '21:00:00'),
    dy as (select symbol, week, d, arg_min(open,ts) o, arg_max(close,ts) c, max(high) hi, min(low) lo, sum(volume) v from h group by 1,2,3),
    dp as (select *, lag(c) over (partition by symbol,week order by d) pc from dy),
    g1 as (select symbol, week, coalesce(avg((o-pc)/pc),0) gap, coalesce(avg((lo<=pc and pc<=hi)::int) filter (where pc is not null and o<>pc),0) fill,
      case when count(*)>=2 then arg_max(v,d)::double/arg_min(v,d) else 1 end decay from dp group by 1,2),
    y as (select *, ln(close)-ln(lag(close) over w) lr, (low-max(high) over u)/max(high) over u dd from h
      window w as (partition by symbol,week order by ts), u as (partition by symbol,week order by ts rows unbounded preceding)),
    g2 as (select symbol, week, coalesce(stddev_samp(lr),0) vol, (arg_max(close,ts)-arg_min(open,ts))/arg_min(open,ts) cum, min(dd) mdd from y group by 1,2)"""


@query("a07_early_week_features", compose(f"""with {_HOURS60} select symbol, week, {rd('gap')} overnight_gap_mean, {rd('fill')} gap_fill_ratio, {rd('decay')} volume_decay_ratio,
    {rd('vol')} hourly_realized_vol, {rd('cum')} turn_cum_return, {rd('mdd')} max_drawdown_turn from g1 join g2 using (symbol, week)""", "intra60"))
def _(spark, d):
    hourly = fx.intraday_bars(spark, d, 60).withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    return tidy(B.early_week_features(hourly, ("symbol", "week")))


@query("a08_legacy_features", compose(f"""select symbol, street, {rd('stddev_samp(log_return)', 6)} realized_vol, {rd('avg(rng)', 6)} range_mean,
    {rd('avg(dollar_volume)', 4)} dollar_volume_mean, {rd('avg(abs(log_return)/dollar_volume)', 12)} amihud_illiquidity,
    {rd('(arg_max(close,d)-arg_min(open,d))/arg_min(open,d)', 6)} river_cum_return,
    {rd('case when stddev_samp(log_return)=0 then 0 else (arg_max(close,d)-arg_min(open,d))/arg_min(open,d)/stddev_samp(log_return) end', 6)} trend_strength,
    {rd('min(drawdown)', 6)} max_drawdown_river, {rd('min(log_return)', 6)} worst_day_return, {rd('max(log_return)', 6)} best_day_return
    from barcols group by 1,2""", "barcols"))
def _(spark, d):
    return tidy(B.legacy_daily_features(in_streets(spark, d)), 6, amihud_illiquidity=12, dollar_volume_mean=4)


@query("a09_quality_flags", compose("select symbol, bar_count_1d, zero_volume_pct, median_daily_volume from flags", "flags"))
def _(spark, d):
    return tidy(B.quality_flags(sessions(spark, d)))


@query("a10_filings_per_company", compose("""select c.cik, c.ipo_date, c.filing_count, any_value(f.company_name) company_name, any_value(f.sic) sic, any_value(f.state) state
    from (select cik, min(file_date) ipo_date, count(*) filing_count from fil group by 1) c join fil f on f.cik=c.cik and f.file_date=c.ipo_date group by 1,2,3""", "fil"))
def _(spark, d):
    return U.filings_per_company(filings(spark, d)).drop("display_name")


@query("a11_amendments_per_company", compose("select cik, count(*) s1a_count, max(file_date) last_amendment_date from fil where form_type='S-1/A' group by 1", "fil"))
def _(spark, d):
    return U.amendments_per_company(filings(spark, d).where(F.col("form_type") == "S-1/A"))


@query("a12_first_bar_dates", compose("select symbol, min(d) first_bar_date from bars group by 1", "bars"))
def _(spark, d):
    return U.first_bar_dates(bars(spark, d))


@query("a13_reason_counts", compose("select reason, count(*) n from (select unnest(string_split(excluded_reasons,',')) reason from aud where not included) group by 1", "aud"))
def _(spark, d):
    return U.reason_counts(audit(spark, d))


@query("a13_reason_buckets", compose("select excluded_reasons, count(*) n from aud where not included group by 1", "aud"))
def _(spark, d):
    return U.reason_buckets(audit(spark, d))


@query("a14_listings_per_year", compose("select year(ipo_date)::int yr, count(*) n from aud where included group by 1", "aud"))
def _(spark, d):
    return U.listings_per_year(audit(spark, d).where("included"))


@query("a14_sector_counts", compose("select sector, count(*) n from lst group by 1", "lst"))
def _(spark, d):
    return U.sector_counts(fx.listings(spark, d))


@query("a14_universe_summary", compose("select count(*) n_rows, count(distinct symbol) n_symbols, min(ipo_date) first_ipo, max(ipo_date) last_ipo from vded", "vded"))
def _(spark, d):
    return U.universe_summary(U.dedupe_vendor(vendor(spark, d)))


@query("a23_base_rates", compose(" union all ".join(
    f"select '{c}' as label, street, sum({c})::bigint n_pos, count({c}) n, {rd(f'sum({c})::double/count({c})')} rate from snap group by street having count({c})>0"
    for c in ("adverse_20", "severe_30")), "snap"))
def _(spark, d):
    from firstprint.operators.metrics import base_rates

    return tidy(base_rates(snapshots(spark, d)))


def build_audit(spark, d):
    return S.build_audit(fx.listings(spark, d), bars(spark, d), snapshots(spark, d))


_BAUD = """(select l.symbol, l.ipo_date, {era} era, l.sector, l.sic, case when coalesce(n,0)=3 then 'success'
     when coalesce(n,0)>0 or (b.symbol is not null and a.ndays is null) then 'partial' else 'failed' end status, coalesce(n,0) n_snapshots,
     coalesce(f,false) has_flop, coalesce(t,false) has_turn, coalesce(r,false) has_river,
     case when coalesce(n,0)>0 then '' when b.symbol is null then 'No bar data' when a.ndays is null then 'no_snapshots_built'
          when a.ndays<6 then 'Not enough trading days to form FLOP window' else 'No bars for this index' end error
   from lst l left join (select distinct symbol from bars) b using (symbol)
   left join (select bars.symbol, count(distinct d) ndays from bars join lst using (symbol) where d>=ipo_date group by 1) a on a.symbol=l.symbol
   left join (select symbol, count(*) n, bool_or(street='FLOP') f, bool_or(street='TURN') t, bool_or(street='RIVER') r from snap group by 1) s on s.symbol=l.symbol)""".format(era=era_case("year(l.ipo_date)"))


@query("a30_build_audit", compose(f"select * from {_BAUD}", "snap", "bars"))
def _(spark, d):
    return build_audit(spark, d)


@query("a29_audit_gates", compose(f"""select count(*) pilot_n, count(*) filter (where status='success') success_count, count(*) filter (where has_river) river_count,
    count(*) filter (where status='failed') failed_count, {rd('count(*) filter (where has_river)/count(*)::double')} river_rate,
    count(*) filter (where has_river)/count(*)::double>=0.7::double river_gate_pass, """ + ", ".join(
        f"count(*) filter (where era='{n}') era_{n.replace('-', '_')}_n, coalesce(count(*) filter (where era='{n}' and has_river)/nullif(count(*) filter (where era='{n}'),0)::double,0) era_{n.replace('-', '_')}_river_rate"
        for n, *_ in vocab.ERAS) + f" from {_BAUD}", "snap", "bars"))
def _(spark, d):
    return tidy(S.audit_gates(build_audit(spark, d)))


@query("a29_failure_reasons", compose(f"select trim(split_part(error,':',1)) reason, count(*) n from {_BAUD} where error<>'' group by 1", "snap", "bars"))
def _(spark, d):
    return S.failure_reasons(build_audit(spark, d))


@query("a32_new_column_report", compose(" union all ".join(
    f"select '{c}' column_name, count(*) filter (where {c} is null) nulls, {rd(f'avg({c})', 6)} as mean from meta" for c in vocab.METADATA_FEATURES), "meta"))
def _(spark, d):
    return tidy(S.null_report(metadata(spark, d), vocab.METADATA_FEATURES), 6)


@query("a32_new_column_spread", compose(" union all ".join(
    f"select '{c}' column_name, count(*) filter (where {c} is null) nulls, {rd(f'avg({c})', 6)} as mean, "
    f"{rd(f'quantile_cont({c},0.5)', 6)} as median, {rd(f'min({c})', 6)} as min, {rd(f'max({c})', 6)} as max from meta" for c in vocab.METADATA_FEATURES), "meta"))
def _(spark, d):
    return tidy(S.null_report(metadata(spark, d), vocab.METADATA_FEATURES, spread=True), 6)


@query("a33_split_integrity", compose(f"""select split, count(*) n_rows, count(distinct w.symbol) n_symbols, min(w.asof_date) first_asof, max(w.asof_date) last_asof,
    (select max(c) from (select symbol, count(distinct split) c from ({_SPLIT}) group by 1))::bigint max_splits_per_symbol
    from win w join ({_SPLIT}) s using (symbol) group by 1""", "win"))
def _(spark, d):
    s = O.temporal_split(B.street_windows(sessions(spark, d)))
    worst = s.groupBy("symbol").agg(F.count_distinct("split").alias("c")).agg(F.max("c").alias("max_splits_per_symbol"))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("symbol").alias("n_symbols"),
                                  F.min("asof_date").alias("first_asof"), F.max("asof_date").alias("last_asof")).join(F.broadcast(worst))  # one row


# ---- joins ------------------------------------------------------------------------------------------------

@query("j01_snapshots_metadata", compose("select s.symbol, s.street, m.preflop_s1_lead_days, m.preflop_s1a_count from snap s left join meta m using (symbol)", "snap", "meta"))
def _(spark, d):
    m = metadata(spark, d).select("symbol", "preflop_s1_lead_days", "preflop_s1a_count")
    return snapshots(spark, d).select("symbol", "street").join(m, "symbol", "left")


@query("j02_ticker_resolution", compose("select symbol, company_name, ipo_date, cik, exchange, sic, state, ticker_source, filing_count from uni", "uni"))
def _(spark, d):
    return universe(spark, d)


@query("j03_amendment_join", compose("select symbol, preflop_s1a_count, preflop_days_since_last_amendment from meta", "meta"))
def _(spark, d):
    return metadata(spark, d).select("symbol", "preflop_s1a_count", "preflop_days_since_last_amendment")


@query("j05_bars_in_streets", compose("select symbol, d, day_index, street from ses where street is not null", "ses"))
def _(spark, d):
    return in_streets(spark, d).select("symbol", "d", F.col("day_index").cast("bigint").alias("day_index"), "street")


_LABELS = ("forward_mdd_7d", "forward_mfr_7d", "forward_mdd_20d", "forward_mfr_20d")


@query("j06_label_at_asof", compose(f"select w.symbol, w.street, w.asof_date, {rounded(_LABELS)} from win w left join lab on lab.symbol=w.symbol and lab.d=w.asof_date", "win", "lab"))
def _(spark, d):
    s = sessions(spark, d)
    return tidy(S.label_at_asof(B.forward_extremes(s), B.street_windows(s)))


@query("j07_sector_heat", compose("select symbol, heat preflop_sector_ipo_heat_90d from heat", "heat"))
def _(spark, d):
    return C.with_sector_heat(fx.listings(spark, d)).select("symbol", "preflop_sector_ipo_heat_90d")


@query("j08_asof_tail", compose(f"select l.symbol, {rd('coalesce(s.ret,0)')} preflop_sector_return_20d, {rd('coalesce(s.vol,0)')} preflop_sector_vol_20d from lst l left join pre20 s on s.symbol=l.symbol and not s.mkt", "lst", "pre20"))
def _(spark, d):
    p = C.with_pre_listing_stats(fx.listings(spark, d), calendar(spark, d), fx.fixture_index(F.col("sector")), "preflop_sector")
    return tidy(p.select("symbol", "preflop_sector_return_20d", "preflop_sector_vol_20d"))


@query("j09_split_membership", compose(f"select w.symbol, w.street from win w where w.symbol in (select symbol from ({_SPLIT}) where split='train')", "win"))
def _(spark, d):
    w = B.street_windows(sessions(spark, d))
    train = O.temporal_split(w).where(F.col("split") == "train").select("symbol")
    return w.join(train, "symbol", "left_semi").select("symbol", "street")


@query("j10_skip_processed", compose("select cik from lst where cik not in (select cik from fil where form_type='F-1' and k%3=0)", "lst", "fil"))
def _(spark, d):
    done = filings(spark, d).where((F.col("form_type") == "F-1") & (F.col("cik").cast("bigint") % 3 == 0))
    return TB.unprocessed(fx.listings(spark, d).select("cik"), done.select("cik"), "cik")


@query("j14_symbol_map_default", compose("select l.symbol, coalesce(n,0)::double v from lst l left join (select cik, count(*) n from fil group by 1) f using (cik)", "lst", "fil"))
def _(spark, d):
    n = filings(spark, d).groupBy("cik").agg(F.count(F.lit(1)).cast("double").alias("v"))
    return fx.listings(spark, d).join(n, "cik", "left").select("symbol", F.coalesce("v", F.lit(0.0)).alias("v"))


# ---- sorts, samples, set operations -------------------------------------------------------------------------

@query("t01_sorted_universe", compose("select ipo_date, symbol, cik from uni order by 1,2,3", "uni"))
def _(spark, d):
    return universe(spark, d).select("ipo_date", "symbol", "cik").orderBy("ipo_date", "symbol", "cik")


@query("t02_head_symbols", compose("select symbol from lst order by symbol limit 7", "lst"))
def _(spark, d):
    return fx.listings(spark, d).select("symbol").orderBy("symbol").limit(7)


@query("t03_last_bars", compose("select symbol, d from (select symbol, d, row_number() over (partition by symbol order by d desc) rn from ses) where rn<=20", "ses"))
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy(F.desc("d"))
    return sessions(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("symbol", "d")


@query("t07_stratified_sample")
def _(spark, d):
    return U.stratified_sample(fx.listings(spark, d), eras=ERAS).select("symbol", "era", "ipo_date")


@query("u01_union_forms", compose("select cik, file_date, form_type from fil where form_type in ('S-1','F-1')", "fil"))
def _(spark, d):
    f = filings(spark, d).select("cik", "file_date", "form_type")
    return f.where(F.col("form_type") == "S-1").unionByName(f.where(F.col("form_type") == "F-1"))


@query("u02_train_val_concat", compose(f"select w.symbol, w.street, split from win w join ({_SPLIT}) using (symbol) where split<>'test'", "win"))
def _(spark, d):
    s = O.temporal_split(B.street_windows(sessions(spark, d))).select("symbol", "street", "split")
    return s.where(F.col("split") == "train").unionByName(s.where(F.col("split") == "val"))


@query("u03_disjoint_splits", compose(f"select count(*) n from (select symbol from ({_SPLIT}) where split='train' intersect select symbol from ({_SPLIT}) where split='test')", "win"))
def _(spark, d):
    s = O.temporal_split(B.street_windows(sessions(spark, d)))
    common = s.where(F.col("split") == "train").select("symbol").intersect(s.where(F.col("split") == "test").select("symbol"))
    return common.agg(F.count(F.lit(1)).alias("n"))


# ---- snapshot builds ------------------------------------------------------------------------------------------

_SNAP_KEYS = "symbol, street, asof_date, ipo_date, sector"
_SNAP_DOUBLES = [*_FEATS, *_LABELS, "bar_count_1d", "zero_volume_pct", "median_daily_volume", "risk_severity"]
_SNAP = compose(f"select {_SNAP_KEYS}, adverse_20, severe_30, " + ", ".join(
    f"{rd(c, 12 if 'amihud' in c else 6)} as {c}" for c in _SNAP_DOUBLES) + " from snap", "snap")
_AMIHUD = {f"{s.lower()}_amihud_illiquidity": 12 for s in vocab.STREETS}


@query("e15_build_snapshots", _SNAP)
def _(spark, d):
    return tidy(build(spark, d, fx.daily_bars(spark, d), fx.index_bars(spark, d)), 6, **_AMIHUD)


@query("e16_flatten_labels", compose(f"select symbol, street, {rd('risk_severity')} risk_severity, adverse_20, severe_30 from snap", "snap"))
def _(spark, d):
    flat = snapshots(spark, d).drop("risk_severity", "adverse_20", "severe_30")
    return tidy(X.with_event_labels(flat).select("symbol", "street", "risk_severity", "adverse_20", "severe_30"))


@query("e17_needed_index_bars", compose(f"""select index_symbol, d, {rounded(('open', 'close'))} from idx
    where (index_symbol='MKT' or index_symbol in (select 'IDX_'||sector from lst)) and d>=(select date_trunc('year',min(ipo_date)) from lst)""", "idx", "lst"))
def _(spark, d):
    return tidy(C.needed_index_bars(index_bars(spark, d), fx.listings(spark, d), fx.MARKET, fx.fixture_index(F.col("sector"))))


@query("e18_preflop_metadata", compose("select * from meta", "meta"))
def _(spark, d):
    return metadata(spark, d)


@query("e19_augmented_snapshots", _AUG)
def _(spark, d):
    once = S.augment_with_metadata(snapshots(spark, d), metadata(spark, d))
    twice = S.augment_with_metadata(once, metadata(spark, d))  # running again changes nothing
    return twice.select("symbol", "street", *vocab.METADATA_FEATURES, *[f"preflop_sector_{s}" for s in vocab.ONE_HOT_SECTORS])


@query("e20_backfill_context", compose(f"select symbol, street, {rounded(('preflop_sector_ipo_heat_90d', 'preflop_sector_return_20d'))} from snap", "snap"))
def _(spark, d):
    bare = snapshots(spark, d).drop("preflop_sector_ipo_heat_90d", "preflop_sector_return_20d")
    out = S.backfill_context(bare, fx.listings(spark, d), index_bars(spark, d), fx.fixture_index)
    return tidy(out.select("symbol", "street", "preflop_sector_ipo_heat_90d", "preflop_sector_return_20d"))


# ---- streaming --------------------------------------------------------------------------------------------------

@query("st1_stream_ingest_latest", compose(f"""select symbol, ts, {rounded(('open', 'high', 'low', 'close'))}, volume from intra60""", "intra60"))
def _(spark, d):
    landed, out = scratch_path(spark, "landed"), scratch_path(spark, "stream")
    hourly = fx.intraday_bars(spark, d, 60)
    stale = hourly.withColumns({"close": F.lit(-1.0), "volume": F.lit(-1).cast("bigint")})
    stale.repartition(2).write.parquet(landed)
    ST.ingest_latest(ST.bar_stream(spark, landed), out, scratch_path(spark, "ckpt")).awaitTermination()
    second = scratch_path(spark, "landed")
    hourly.repartition(2).write.parquet(second)
    ST.ingest_latest(ST.bar_stream(spark, second), out, scratch_path(spark, "ckpt")).awaitTermination()
    got = spark.read.parquet(out).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")
    return tidy(got)


@query("st2_stream_daily_rollup", compose(f"""select symbol, ts::date d, {rd('arg_min(open,ts)')} day_open, {rd('arg_max(close,ts)')} day_close,
    {rd('max(high)')} day_high, {rd('min(low)')} day_low, sum(volume)::bigint day_volume from intra60
    where ts::date + interval 1 day <= (select max(ts) from intra60) - interval 2 day group by 1,2""", "intra60"))
def _(spark, d):
    landed, out = scratch_path(spark, "landed"), scratch_path(spark, "rollup")
    fx.intraday_bars(spark, d, 60).repartition(2).write.parquet(landed)
    ST.run_to_table(ST.daily_rollup(ST.bar_stream(spark, landed)), out, scratch_path(spark, "ckpt"))
    return tidy(spark.read.parquet(out))
