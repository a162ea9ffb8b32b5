"""DuckDB SQL for the derived tables and for composing check queries.

The SQL states each result the direct way (range joins, pair joins, global windows), independent of
how the Spark jobs get there.
"""

from __future__ import annotations

from firstprint.functions import vocab
from firstprint.operators.policy import FOLD_GRID, SMALL_BET_GRID

STREETS = vocab.STREETS
_PX = "100*pow((l_extendedprice/l_quantity)/1000.0::double, {e})"
_KEY = "(l_orderkey,l_linenumber,l_partkey,l_extendedprice)"


def sym(expr: str) -> str:
    return f"'S'||lpad(({expr})::varchar,10,'0')"


def rd(expr: str, digits: int = 8) -> str:
    """Rounded, with no negative zero."""
    return f"(case when round({expr},{digits})=0 then 0::double else round({expr},{digits}) end)"


def contains_any(expr: str, terms) -> str:
    return "(" + " or ".join(f"contains({expr},'{t}')" for t in terms) + ")"


SECTOR_CASE = (
    "case when {s} is null or length({s})<2 or try_cast(substr({s},1,2) as int) is null then 'unknown' "
    "when try_cast(substr({s},1,2) as int)=13 then 'oil_gas' "
    "when try_cast(substr({s},1,2) as int) between 10 and 14 then 'energy' "
    "when try_cast(substr({s},1,2) as int) between 15 and 17 then 'industrials' "
    "when try_cast(substr({s},1,2) as int)=28 then 'health_care' "
    "when try_cast(substr({s},1,2) as int) in (35,36,38) then 'technology' "
    "when try_cast(substr({s},1,2) as int)=37 then 'industrials' "
    "when try_cast(substr({s},1,2) as int) between 18 and 39 then 'consumer_goods' "
    "when try_cast(substr({s},1,2) as int)=48 then 'technology' "
    "when try_cast(substr({s},1,2) as int)=49 then 'energy' "
    "when try_cast(substr({s},1,2) as int) between 40 and 47 then 'industrials' "
    "when try_cast(substr({s},1,2) as int) between 50 and 51 then 'consumer_goods' "
    "when try_cast(substr({s},1,2) as int) between 52 and 59 then 'consumer_services' "
    "when try_cast(substr({s},1,2) as int)=65 then 'real_estate' "
    "when try_cast(substr({s},1,2) as int) between 60 and 67 then 'financials' "
    "when try_cast(substr({s},1,2) as int)=73 then 'technology' "
    "when try_cast(substr({s},1,2) as int)=80 then 'health_care' "
    "when try_cast(substr({s},1,2) as int) in (70,72) then 'consumer_services' "
    "when try_cast(substr({s},1,2) as int) between 68 and 89 then 'industrials' else 'unknown' end"
)


def era_case(year: str, eras=vocab.ERAS) -> str:
    return "case " + " ".join(f"when {year} between {lo} and {hi} then '{n}'" for n, lo, hi, *_ in eras) + " else 'unknown' end"


_OHLC = "arg_min(px,k) as open, max(px) as high, min(px) as low, arg_max(px,k) as close"
_TICKER = ("chr((65+k%26)::int)||chr((65+(k//26)%26)::int)||chr((65+(k//676)%26)::int)"
           "||case when k%13=0 then 'W' when k%13=1 then 'U' else '' end")

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": ((), f"""
        with p as (select l_suppkey, l_shipdate::date d, l_quantity q, {_KEY} k,
                          {_PX.format(e='0.02::double+0.01::double*(l_suppkey%7)')} px from lineitem)
        select {sym('l_suppkey')} symbol, d, {_OHLC}, sum(q)::bigint volume,
               sum(px*q)/sum(q) vwap, count(*) trade_count from p group by l_suppkey, d"""),
    "lst": ((), f"""
        with s as (select s_suppkey k, s_name, case r_name when 'AFRICA' then '4911' when 'AMERICA' then '7372'
                     when 'ASIA' then '3711' when 'EUROPE' then '2834' else '6021' end sic
                   from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey)
        select {sym('k')} symbol, s_name company_name, make_date((1995+k%6)::int,(1+k%12)::int,1) ipo_date,
               k::varchar cik, case k%4 when 0 then 'NYSE' when 1 then 'Nasdaq' when 2 then 'OTC' end exchange,
               sic, {SECTOR_CASE.format(s='sic')} sector, (1+k%3)::bigint filing_count from s"""),
    "idx": (("lst",), f"""
        with p as (select l_suppkey, l_shipdate::date d, {_KEY} k, {_PX.format(e='0.05::double')} px from lineitem),
             q as (select 'IDX_'||sector index_symbol, d, k, px from p join lst on l_suppkey=cik::bigint
                   union all select 'MKT', d, k, px from p)
        select index_symbol, d, arg_min(px,k) as open, arg_max(px,k) as close from q group by 1,2"""),
    "ses": (("bars", "lst"), f"""
        with a as (select b.*, l.ipo_date, dense_rank() over (partition by b.symbol order by b.d)-1 day_index
                   from bars b join lst l using (symbol) where b.d>=l.ipo_date),
             n as (select *, max(day_index) over (partition by symbol)+1 n_days from a)
        select *, case when day_index<6 then 'FLOP' when day_index<21 then 'TURN' when day_index<61 then 'RIVER' end street
        from n where n_days>=6"""),
    "win": (("ses",), """
        select symbol, street, min(d) win_start, max(d) asof_date, (max(d)+interval 1 day)::date win_end,
               count(distinct d)::int sessions from ses where street is not null group by 1,2"""),
    "barcols": (("ses",), """
        select *, ln(close)-ln(lag(close) over w) log_return, (high-low)/close rng, close*volume dollar_volume,
               (open-lag(close) over w)/lag(close) over w overnight_gap,
               (low-max(high) over u)/max(high) over u drawdown
        from ses where street is not null
        window w as (partition by symbol,street order by d),
               u as (partition by symbol,street order by d rows unbounded preceding)"""),
    "feat": (("barcols",), """
        with g as (select symbol, street, count(*) n, coalesce(stddev_samp(log_return),0) realized_vol,
               coalesce(avg(rng),0) range_mean, coalesce(avg(dollar_volume),0) dollar_volume_mean,
               coalesce(avg(abs(log_return)/dollar_volume) filter (where dollar_volume>0),0) amihud_illiquidity,
               (arg_max(close,d)-arg_min(open,d))/arg_min(open,d) cum_return, min(drawdown) max_drawdown,
               coalesce(min(log_return),0) worst_day_return, coalesce(max(log_return),0) best_day_return,
               case when arg_min(volume,d)>0 then arg_max(volume,d)::double/arg_min(volume,d) else 1 end volume_decay_ratio,
               coalesce(avg(overnight_gap),0) overnight_gap_mean from barcols group by 1,2)
        select *, case when realized_vol<>0 then cum_return/realized_vol else 0 end trend_strength from g where n>=2"""),
    "lab": (("ses",), "".join(["""
        with r as (select symbol, d, high, low, row_number() over (partition by symbol order by d) rn from ses),
             pr as (select a.symbol, a.d, hi.rn-a.rn i, lo.rn-a.rn j, (lo.low-hi.high)/hi.high dn,
                           (lo.high-hi.low)/hi.low up
                    from r a join r hi on hi.symbol=a.symbol and hi.rn between a.rn+1 and a.rn+20
                             join r lo on lo.symbol=a.symbol and lo.rn between hi.rn and a.rn+20)
        select r.symbol, r.d, """, ", ".join(
            f"case when max(j) filter (where j<={h})={h} then min(dn) filter (where j<={h}) end forward_mdd_{h}d, "
            f"case when max(j) filter (where j<={h})={h} then max(up) filter (where j<={h}) end forward_mfr_{h}d" for h in (7, 20)),
        " from r left join pr using (symbol,d) group by 1,2"])),
    "reg": (("win", "lst", "idx"), """
        with x as (select w.symbol, w.street, i.index_symbol='MKT' mkt, i.d, i.open, i.close,
                          ln(i.close)-ln(lag(i.close) over (partition by w.symbol,w.street,i.index_symbol order by i.d)) lr
                   from win w join lst l using (symbol)
                   join idx i on i.index_symbol in ('MKT','IDX_'||l.sector) and i.d>=w.win_start and i.d<w.win_end),
             g as (select symbol, street, mkt, (arg_max(close,d)-arg_min(open,d))/arg_min(open,d) ret,
                          coalesce(stddev_samp(lr),0) vol from x group by 1,2,3)
        select w.symbol, w.street, m.ret spy_return, m.vol spy_vol, coalesce(s.ret,0) sector_return
        from win w left join g m on m.symbol=w.symbol and m.street=w.street and m.mkt
                   left join g s on s.symbol=w.symbol and s.street=w.street and not s.mkt"""),
    "heat": (("lst",), """
        select a.symbol, (select count(*) from lst o where substr(o.sic,1,2)=substr(a.sic,1,2) and o.ipo_date<a.ipo_date
                            and o.ipo_date>=a.ipo_date-interval 90 day)::double heat from lst a"""),
    "pre20": (("lst", "idx"), """
        with x as (select l.symbol, i.index_symbol='MKT' mkt, i.d, i.open, i.close,
                          row_number() over (partition by l.symbol,i.index_symbol order by i.d desc) rn
                   from lst l join idx i on i.index_symbol in ('MKT','IDX_'||l.sector) and i.d<l.ipo_date),
             y as (select *, ln(close)-ln(lag(close) over (partition by symbol,mkt order by d)) lr from x where rn<=20)
        select symbol, mkt, case when count(*)>=2 then (arg_max(close,d)-arg_min(open,d))/arg_min(open,d) else 0 end ret,
               case when count(*)>=2 then coalesce(stddev_samp(lr),0) else 0 end vol from y group by 1,2"""),
    "pre": (("lst", "heat", "pre20"), """
        select l.symbol, l.ipo_date, l.sector, l.filing_count::double preflop_filing_count,
               month(l.ipo_date)::double preflop_ipo_month, (isodow(l.ipo_date)-1)::double preflop_ipo_day_of_week,
               h.heat preflop_sector_ipo_heat_90d, coalesce(m.ret,0) preflop_spy_return_20d,
               coalesce(m.vol,0) preflop_spy_vol_20d, coalesce(s.ret,0) preflop_sector_return_20d
        from lst l join heat h using (symbol) left join pre20 m on m.symbol=l.symbol and m.mkt
             left join pre20 s on s.symbol=l.symbol and not s.mkt"""),
    "flags": (("ses",), """
        select symbol, count(*)::double bar_count_1d, 100*avg((volume=0)::int::double) zero_volume_pct,
               quantile_cont(volume,0.5)::double median_daily_volume from ses group by 1"""),
    "fil": (("lst",), f"""
        with o as (select orders.*, o_custkey%(select count(*) from supplier) k from orders),
             f as (select o_orderkey, k, company_name, sic sic0, o_orderdate, o_orderpriority
                   from o join lst on k=cik::bigint)
        select o_orderkey, k::varchar cik, company_name||case when k%11=0 then ' Acquisition Corp' when k%11=1 then ' Fund' else '' end company_name,
               company_name||case when k%11=0 then ' Acquisition Corp' when k%11=1 then ' Fund' else '' end
                 ||case when k%5<>0 then '  ('||{_TICKER}||')' else '' end||'  (CIK '||lpad(k::varchar,10,'0')||')' display_name,
               o_orderdate::date file_date,
               case o_orderpriority when '1-URGENT' then 'S-1' when '2-HIGH' then 'F-1' else 'S-1/A' end form_type,
               case when k%9<>0 then sic0 end sic, case when k%2=0 then 'NY' end state, k
        from f where o_orderkey%97<>0 and o_orderkey%89<>0"""),
    "tik": (("lst",), f"""
        with t as (select cik, cik::bigint k, company_name, exchange from lst)
        select cik, case when k%7=0 then '' else {_TICKER} end ticker, company_name as name, exchange from t where k%3<>0"""),
    "uni": (("fil", "tik"), """
        with c as (select cik, min(file_date) ipo_date, count(*) filing_count from fil where form_type in ('S-1','F-1') group by 1),
             e as (select c.cik, ipo_date, filing_count, any_value(f.company_name) company_name, any_value(f.display_name) display_name,
                          any_value(f.sic) sic, any_value(f.state) state
                   from c join fil f on f.cik=c.cik and f.file_date=c.ipo_date and f.form_type in ('S-1','F-1') group by 1,2,3),
             r as (select e.*, t.ticker, t.exchange x, t.name n,
                          list_filter(regexp_extract_all(display_name,'\\(([A-Z]{1,5})\\)',1), lambda z: z<>'CIK')[1] shown
                   from e left join tik t using (cik))
        select case when ticker<>'' then ticker else coalesce(shown,'CIK:'||cik) end symbol,
               case when company_name<>'' then company_name else coalesce(n,'') end company_name, ipo_date, cik,
               case when ticker<>'' then x end exchange, sic, state,
               case when ticker<>'' then 'company_tickers' when shown is not null then 'display_name' else 'unknown' end ticker_source,
               filing_count from r"""),
    "aud": (("uni",), f"""
        with n as (select *, lower(trim(coalesce(company_name,''))) nm, lower(trim(coalesce(exchange,''))) ex from uni),
             w as (select *, concat_ws(',',
               case when {contains_any('nm', vocab.FILING_SPAC_TERMS)} then 'spac_name' end,
               case when coalesce(exchange,'')<>'' and not {contains_any('ex', vocab.FILING_EXCHANGES)} then 'non_us_exchange'
                    when coalesce(exchange,'')='' and ticker_source='unknown' then 'no_ticker_or_exchange' end,
               case when {contains_any('nm', vocab.FILING_NON_COMMON_TERMS)} then 'non_common_by_name' end,
               case when starts_with(symbol,'CIK:') then 'no_ticker_resolved' end,
               case when length(symbol)>3 and ends_with(upper(symbol),'W') then 'warrant_by_ticker' end,
               case when length(symbol)>3 and ends_with(upper(symbol),'U') then 'unit_by_ticker' end,
               case when contains(symbol,'-') then 'preferred_by_ticker' end) excluded_reasons from n)
        select symbol, company_name, ipo_date, cik, exchange, sic, state, ticker_source, filing_count, excluded_reasons,
               excluded_reasons='' included from w"""),
    "ven": ((), """
        with c as (select c_custkey k, c_name, '19'||(90+c_custkey%10)||'-0'||(1+c_custkey%9)||'-15' ds,
                          c_name||case when c_custkey%17=0 then ' Blank Check' else '' end nm from customer),
             r as (select k, case when k%2=0 or k%19<>0 then 'C'||(k%40)::varchar end symbol, nm company_name,
               case when k%3<>0 then case when k%23=1 then null else ds::date end else ds::date end d0, ds::date dd,
               case k%6 when 0 then 'New York Stock Exchange' when 1 then 'NASDAQ Global' when 2 then 'London' end exchange_raw,
               case k%8 when 0 then 'Unit' when 1 then 'Common Stock' when 2 then 'Ordinary Shares' when 3 then 'Bond' end security_type_raw,
               case when k%4=0 then null else (k%50)::double end offer_price, k*10 shares_offered, k::varchar source_ipo_id,
               k%3<>0 and k%23=1 bad from c)
        select k, symbol, company_name, dd ipo_date, 'priced' status, exchange_raw, security_type_raw, offer_price,
               shares_offered::bigint shares_offered, source_ipo_id, 'priced' source_status_query
        from r where symbol is not null and not bad"""),
    "vded": (("ven",), """
        select * exclude (rk) from (select *, row_number() over (partition by symbol, ipo_date
            order by (exchange_raw is not null)::int+(security_type_raw is not null)::int desc, k) rk from ven) where rk=1"""),
    "meta": (("lst", "bars", "fil"), """
        with fb as (select symbol, min(d) first_bar_date from bars group by 1),
             am as (select cik, count(*) c, max(file_date) last_d from fil where form_type='S-1/A' group by 1)
        select l.symbol, l.ipo_date s1_filing_date, first_bar_date, (first_bar_date-l.ipo_date)::double preflop_s1_lead_days,
               contains(lower(coalesce(exchange,'')),'nyse')::int::double preflop_exchange_nyse,
               contains(lower(coalesce(exchange,'')),'nasdaq')::int::double preflop_exchange_nasdaq,
               coalesce(c,0)::double preflop_s1a_count, (first_bar_date-last_d)::double preflop_days_since_last_amendment
        from lst l left join fb using (symbol) left join am using (cik)"""),
    "scored": ((), """
        with s as (select o_orderkey row_id, ((o_orderkey*7919)%1000)/1000.0::double p_tail,
                          ((o_orderkey*104729+13)%1000)/1000.0::double u, o_orderpriority sector, year(o_orderdate)::int yr,
                          o_orderdate::date asof_date from orders)
        select row_id, p_tail, sector, yr, asof_date, (u<p_tail)::int adverse_20, (u<0.6::double*p_tail*p_tail)::int severe_30 from s"""),
    "acted": (("scored",), """
        select *, case when p_tail>=0.6::double then 'FOLD' when p_tail>=0.3::double then 'SMALL_BET' else 'SIZE_UP' end as action from scored"""),
    "sevents": ((), """select event_type symbol, ts, event_id, 50::double+value/10 px from events"""),
    **{f"intra{m}": (("sevents",), f"""
        select symbol, time_bucket(interval {m} minute, ts) ts, arg_min(px,(ts,event_id)) as open, max(px) high, min(px) low,
               arg_max(px,(ts,event_id)) as close, sum(1+event_id%5)::bigint volume, avg(px) vwap, count(*) trade_count
        from sevents group by 1,2""") for m in (5, 60)},
}

_STREET_FEATURES = vocab.DAILY_FEATURES + vocab.REGIME_FEATURES
_wide = ", ".join(
    f"case when r.rank>={i} then max(case when s.street='{st}' then s.{f} end) over (partition by r.symbol) end {st.lower()}_{f}"
    for i, st in enumerate(STREETS) for f in _STREET_FEATURES)
CTES["snap"] = (("feat", "reg", "win", "lab", "flags", "pre"), f"""
    with s as (select f.*, g.spy_return, g.spy_vol, g.sector_return from feat f join reg g using (symbol,street)
               where not exists (select 1 from reg e join feat ef using (symbol,street) where e.symbol=f.symbol and e.spy_return is null)),
         r as (select symbol, street, case street when 'FLOP' then 0 when 'TURN' then 1 else 2 end rank from s),
         w as (select r.symbol, r.street, {_wide} from r join s on s.symbol=r.symbol
               qualify row_number() over (partition by r.symbol, r.street)=1)
    select w.symbol, w.street, win.asof_date, pre.ipo_date, pre.sector, {', '.join('pre.' + c for c in vocab.PREFLOP_FEATURES)},
           w.* exclude (symbol, street), lab.* exclude (symbol, d), flags.* exclude (symbol),
           -forward_mdd_20d risk_severity, (-forward_mdd_20d>=0.2::double)::int adverse_20, (-forward_mdd_20d>=0.3::double)::int severe_30
    from w join win using (symbol,street) join pre using (symbol) join flags using (symbol)
    left join lab on lab.symbol=w.symbol and lab.d=win.asof_date""")
CTES["river"] = (("snap",), "select * from snap where street='RIVER' and risk_severity is not null")


def grid_values() -> str:
    rows, i = [], 0
    for f in FOLD_GRID:
        for s in SMALL_BET_GRID:
            if s < f:
                rows.append(f"({i},{f!r}::double,{s!r}::double)")
                i += 1
    return "(values (-1,0.6::double,0.3::double)," + ",".join(rows) + ") g(ord,fold_min,small_bet_min)"


def compose(body: str, *needs: str) -> str:
    """``body`` with the derived tables it needs, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        deps, _ = CTES[name]
        for d in deps:
            add(d)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    if not order:
        return body
    body = body.strip()
    tail = ",\n" + body[5:] if body.lower().startswith("with ") else "\n" + body
    return "with " + ",\n".join(f"{n} as materialized ({CTES[n][1]})" for n in order) + tail
