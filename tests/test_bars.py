from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from firstprint.operators import bars as B
from firstprint.schemas import validate_bars
from firstprint.sources import fixtures as fx


def five_bars(spark):
    rows = [("A", datetime(2026, 1, 5) + timedelta(days=i), float(h), float(lo))
            for i, (h, lo) in enumerate(zip([10, 12, 11, 9, 13], [9, 11, 8, 7, 12]))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, high double, low double")


def test_forward_extremes_golden(spark):
    out = [(r["forward_mdd_2d"], r["forward_mfr_2d"]) for r in
           B.forward_extremes(five_bars(spark), (2,)).orderBy("ts").collect()]
    assert [m for m, _ in out] == [pytest.approx(-1 / 3), pytest.approx(-4 / 11), pytest.approx(-2 / 9), None, None]
    assert [m for _, m in out] == [pytest.approx(3 / 8), pytest.approx(3 / 8), pytest.approx(6 / 7), None, None]


@pytest.mark.parametrize("h", [1, 3, 5, 7, 13])
def test_forward_extremes_against_brute_force(spark, sf, h):
    bars = fx.daily_bars(spark, sf)
    got = B.forward_extremes(bars, (h,)).select("symbol", "d", "high", "low", f"forward_mdd_{h}d", f"forward_mfr_{h}d").toPandas()
    for _, g in got.sort_values("d").groupby("symbol"):
        hi, lo = g["high"].tolist(), g["low"].tolist()
        for i, (mdd, mfr) in enumerate(zip(g[f"forward_mdd_{h}d"], g[f"forward_mfr_{h}d"])):
            if i + h >= len(g):
                assert mdd != mdd and mfr != mfr
                continue
            span = range(i + 1, i + h + 1)
            assert mdd == pytest.approx(min(lo[b] / hi[a] - 1 for a in span for b in span if a <= b))
            assert mfr == pytest.approx(max(hi[b] / lo[a] - 1 for a in span for b in span if a <= b))


def days(spark, n, start=date(2026, 1, 15)):
    rows = [("A", datetime.combine(start + timedelta(days=i), datetime.min.time()), 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, close double")


def listing(spark, start=date(2026, 1, 15)):
    return spark.createDataFrame([("A", start)], "symbol string, ipo_date date")


def test_street_windows_golden(spark):
    s = B.index_sessions(days(spark, 21), listing(spark), B.StreetLengths(1, 5, 15))
    got = {r["street"]: (r["win_start"], r["win_end"], r["sessions"]) for r in B.street_windows(s).collect()}
    assert got == {"FLOP": (date(2026, 1, 15), date(2026, 1, 16), 1), "TURN": (date(2026, 1, 16), date(2026, 1, 21), 5),
                   "RIVER": (date(2026, 1, 21), date(2026, 2, 5), 15)}


def test_short_series(spark):
    assert B.index_sessions(days(spark, 5), listing(spark)).count() == 0
    clipped = B.street_windows(B.index_sessions(days(spark, 8), listing(spark))).collect()
    assert {r["street"]: r["sessions"] for r in clipped} == {"FLOP": 6, "TURN": 2}
    with pytest.raises(ValueError):
        B.StreetLengths(0, 5, 5)


def test_normalise_bars(spark):
    rows = [("a", "2026-01-05 00:00:00", 1.0, 5, 1), ("A", "2026-01-05 00:00:00", 2.0, 6, 2), ("A", "2026-01-06 00:00:00", 3.0, 7, 3)]
    raw = spark.createDataFrame(rows, "symbol string, timestamp string, close float, volume int, ingest_seq int")
    for c in ("open", "high", "low"):
        raw = raw.withColumn(c, F.col("close"))
    out = B.normalise_bars(raw).orderBy("ts").collect()
    assert [(r["symbol"], r["close"], r["volume"]) for r in out] == [("A", 2.0, 6), ("A", 3.0, 7)]
    validate_bars(B.normalise_bars(raw), "1d")
    with pytest.raises(ValueError):
        B.normalise_bars(raw.withColumnRenamed("timestamp", "when"))


def test_schema_errors(spark):
    good = B.normalise_bars(fx.daily_bars(spark, "/root/testdata/sf0.001").withColumnsRenamed({"ts": "timestamp"}).withColumn("ingest_seq", F.lit(1)))
    assert validate_bars(good, "1d") is good
    with pytest.raises(ValueError, match="missing"):
        validate_bars(good.drop("close"), "1d")
    with pytest.raises(TypeError, match="volume"):
        validate_bars(good.withColumn("volume", F.col("volume").cast("double")), "1d")


def test_single_bar_street_has_null_features(spark):
    bar = spark.createDataFrame([("A", "FLOP", datetime(2026, 1, 5), 1.0, 2.0, 0.5, 1.5, 10)],
                                "symbol string, street string, ts timestamp, open double, high double, low double, close double, volume bigint")
    row = B.daily_features(bar).first()
    assert row["bars"] == 1 and row["realized_vol"] is None and row["max_drawdown"] is None


def test_feature_signs(spark, sf):
    s = B.index_sessions(fx.daily_bars(spark, sf), fx.listings(spark, sf)).where(F.col("street").isNotNull())
    bad = B.daily_features(s).where(
        (F.col("realized_vol") < 0) | (F.col("max_drawdown") > 0) | (F.col("amihud_illiquidity") < 0)
        | (F.col("worst_day_return") > F.col("best_day_return")) | (F.col("dollar_volume_mean") <= 0))
    assert bad.count() == 0
    five = B.opening_day_features(fx.intraday_bars(spark, sf, 5).withColumn("d", F.to_date("ts")))
    bad = five.where((F.col("intraday_mdd") > 0) | ~F.col("volume_first_hour_pct").between(0, 1) | ~F.col("time_to_high_minutes").between(0, 390))
    assert bad.count() == 0


def test_prints_are_shuffled_once_and_never_sorted_before(spark, sf, monkeypatch):
    plan = fx.daily_bars(spark, sf)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange hashpartitioning(l_suppkey")
    assert "Aggregate" in above and "Aggregate" not in below and "Sort" not in below
    sent = fx.index_bars(spark, sf)
    plan = sent._jdf.queryExecution().executedPlan().toString()
    # no print moves for the index: its first and last orders are found by numbers, hashed where the prints lie
    assert "Exchange hashpartitioning(l_suppkey" not in plan and "partial_min(_order" in plan
    assert all("HashAggregate" in line for line in plan.splitlines() if "partial_min(_order" in line)
    monkeypatch.setattr(fx, "MAX_SUPPLIERS_SENT", 0)
    assert {tuple(r) for r in sent.collect()} == {tuple(r) for r in fx.index_bars(spark, sf).collect()}


def test_index_bars_against_brute_force(spark, sf):
    li = fx.table(spark, sf, "lineitem").withColumn("d", F.to_date("l_shipdate")).toPandas()
    li["px"] = 100 * (li["l_extendedprice"] / li["l_quantity"] / 1000) ** 0.05
    sector = {int(r["cik"]): r["sector"] for r in fx.listings(spark, sf).collect()}
    li["sector"] = li["l_suppkey"].map(sector)
    li = li.sort_values(["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    want = {}
    for (s, d), g in li.groupby(["sector", "d"]):
        want[f"IDX_{s}", d] = (g["px"].iloc[0], g["px"].iloc[-1])
    for d, g in li.groupby("d"):
        want[fx.MARKET, d] = (g["px"].iloc[0], g["px"].iloc[-1])
    got = {(r["index_symbol"], r["d"]): (r["open"], r["close"]) for r in fx.index_bars(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_sessions_sort_the_bars_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many listings
    try:
        plan = B.index_sessions(days(spark, 21), listing(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning(symbol") == 2
