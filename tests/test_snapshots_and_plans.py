import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from firstprint.functions import vocab
from firstprint.operators import bars as B
from firstprint.operators import snapshots as S
from firstprint.plans import evaluation as E
from firstprint.plans.catalog_data import build, snapshots
from firstprint.session import scratch_path
from firstprint.sources import fixtures as fx
from firstprint.sources import tables as TB
from firstprint.streaming import jobs as ST
from tools.check import TABLES, rows_of

CHECKED = ["s05_filings", "s06_ticker_map", "s09_normalise_bars", "p16_filing_filters", "p16_vendor_filters", "p24_null_fill", "w04_forward_mdd",
           "w07_temporal_blocks", "w10_temporal_split", "a01_daily_features", "a05_opening_day_features", "a07_early_week_features",
           "a02_regime_features", "a03_preflop_features", "a04_pre_listing_stats", "j04_index_range_join", "a30_build_audit", "j08_asof_tail", "m02_knn", "m05_isotonic", "m06_binned", "e02_optimise_constrained", "e15_build_snapshots"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_sql_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored_bars(spark, sf):
    path = scratch_path(spark, "bars")
    TB.write_bars(fx.daily_bars(spark, sf), path, "1d")
    return TB.read_bars(spark, path, "1d")


def test_snapshot_plan_shuffles_bars_once_and_stays_in_the_jvm(spark, sf):
    bars = stored_bars(spark, sf)
    plan = plan_of(B.daily_features(B.forward_extremes(B.with_quality_flags(
        B.index_sessions(bars, fx.listings(spark, sf)))).where(F.col("street").isNotNull())))
    assert len(re.findall(r"Exchange hashpartitioning\(symbol", plan)) <= 1
    whole = plan_of(build(spark, sf, bars, fx.index_bars(spark, sf)))
    assert "Python" not in whole and "CartesianProduct" not in whole and "BroadcastNestedLoopJoin" not in whole


def test_snapshot_plan_without_automatic_broadcasts(spark, sf, monkeypatch):
    from firstprint.operators import context as C

    bars, listed, index = stored_bars(spark, sf), scratch_path(spark, "listings"), scratch_path(spark, "index")
    fx.listings(spark, sf).write.parquet(listed)
    fx.index_bars(spark, sf).write.parquet(index)

    def plan():
        return plan_of(S.build_snapshots(bars, spark.read.parquet(listed), spark.read.parquet(index), market=fx.MARKET,
                                         sector_index=fx.fixture_index))

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = plan()
        monkeypatch.setattr(C, "MAX_BROADCAST_BYTES", 10)
        large = plan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # bars, listing dates and listing facts: one exchange each, the bars' one serves every window
    assert len(re.findall(r"Exchange hashpartitioning\(symbol", small)) == 3
    assert "BroadcastHashJoin" in small and "BroadcastHashJoin" not in large and "NestedLoop" not in large


def test_bucketed_bars_need_no_shuffle(spark, sf):
    TB.write_bucketed_bars(fx.daily_bars(spark, sf).drop("d"), "bucketed_bars", 4)
    plan = plan_of(B.forward_extremes(spark.table("bucketed_bars")))
    spark.sql("drop table bucketed_bars")
    assert "Exchange" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(snapshots(spark, sf).where((F.col("street") == "RIVER") & F.col("risk_severity").isNotNull()).select("symbol"))
    assert "EqualTo(street,RIVER)" in plan and "IsNotNull(risk_severity)" in plan
    assert "river_cum_return" not in plan.split("ReadSchema")[-1]
    bars = stored_bars(spark, sf).where(F.col("symbol") == "S0000000003").select("close")
    scan = plan_of(bars)
    assert "PartitionFilters: [isnotnull(timeframe" in scan and "EqualTo(symbol,S0000000003)" in scan


def test_features_use_nothing_after_the_asof_day(spark, sf):
    full = snapshots(spark, sf).where(F.col("street") == "RIVER")
    cut = fx.daily_bars(spark, sf).join(full.select("symbol", "asof_date"), "symbol").where(F.to_date("ts") <= F.col("asof_date")).drop("asof_date")
    again = build(spark, sf, cut).where(F.col("street") == "RIVER")
    cols = [f"{s.lower()}_{f}" for s in vocab.STREETS for f in S.STREET_FEATURES]
    assert full.select("symbol", *cols).exceptAll(again.select("symbol", *cols)).count() == 0
    assert again.where(F.col("forward_mdd_20d").isNotNull()).count() == 0


def test_snapshot_counts_and_history_bound(spark, sf):
    snap = snapshots(spark, sf)
    assert len([c for c in snap.columns if c not in vocab.NON_FEATURES]) == 49
    assert S.augment_with_metadata(snap, fake_metadata(spark)).columns.__len__() == len(snap.columns) + 14
    short = S.build_snapshots(fx.daily_bars(spark, sf), fx.listings(spark, sf), fx.index_bars(spark, sf), market=fx.MARKET,
                              sector_index=fx.fixture_index, history_days=150)
    assert short.count() > 0 and short.agg(F.max(F.datediff("asof_date", "ipo_date"))).first()[0] < 150


def test_default_history_is_the_listing_window(spark):
    """A bar each day for 400 days: 130 days and the longest horizon count, unless told otherwise."""
    days = spark.range(400).select(F.lit("A").alias("symbol"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"), (F.lit(10.0) + F.col("id") % 7).alias("p"))
    bars = days.select("symbol", F.col("d").cast("timestamp").alias("ts"), "d", *[F.col("p").alias(c) for c in ("open", "high", "low", "close", "vwap")],
                       F.lit(5).cast("bigint").alias("volume"), F.lit(1).cast("bigint").alias("trade_count"))
    listed = spark.sql("select 'A' symbol, date'2020-01-01' ipo_date, 'technology' sector, '7372' sic, 'NYSE' exchange, '1' cik, 'A Co' company_name, 1L filing_count")
    index = days.select(F.lit(fx.MARKET).alias("index_symbol"), "d", F.col("p").alias("open"), F.col("p").alias("close"))
    index = index.unionByName(index.withColumn("index_symbol", fx.fixture_index(F.lit("technology"))))

    def count(**kw):
        return S.build_snapshots(bars, listed, index, market=fx.MARKET, sector_index=fx.fixture_index, with_preflop=False, **kw).agg(F.max("bar_count_1d")).first()[0]

    assert count() == 150 and count(horizons=(7,)) == 137 and count(history_days=1000) == 400


def fake_metadata(spark):
    cols = ", ".join(f"{c} double" for c in vocab.METADATA_FEATURES)
    return spark.createDataFrame([], f"symbol string, s1_filing_date date, {cols}")


def test_feature_columns_drop_nullable_ones(spark, sf):
    snap = snapshots(spark, sf)
    river = snap.where((F.col("street") == "RIVER") & F.col("risk_severity").isNotNull())
    assert len(S.feature_columns(river)) == 49
    flop = S.feature_columns(snap)
    assert "flop_cum_return" in flop and "river_cum_return" not in flop and "bar_count_1d" not in flop


def test_stream_rollup_equals_batch_on_closed_days(spark, sf):
    hourly = fx.intraday_bars(spark, sf, 60)
    landed, out = scratch_path(spark, "landed"), scratch_path(spark, "rollup")
    hourly.repartition(3).write.parquet(landed)
    ST.run_to_table(ST.daily_rollup(ST.bar_stream(spark, landed)), out, scratch_path(spark, "ckpt"))
    last = hourly.agg(F.max("ts")).first()[0]
    batch = B.hourly_to_daily(hourly).where(F.col("d").cast("timestamp") + F.expr("interval 1 day") <= F.lit(last) - F.expr("interval 2 days"))
    assert batch.count() > 0
    assert spark.read.parquet(out).exceptAll(batch).count() == 0 and batch.exceptAll(spark.read.parquet(out)).count() == 0


def test_stream_first_arrival_stays(spark, sf):
    hourly = fx.intraday_bars(spark, sf, 60)
    landed, out = scratch_path(spark, "landed"), scratch_path(spark, "first")
    hourly.unionByName(hourly).write.parquet(landed)
    ST.run_to_table(ST.first_arrivals(ST.bar_stream(spark, landed)), out, scratch_path(spark, "ckpt"))
    assert spark.read.parquet(out).count() == hourly.count()


def test_fold_evaluation_end_to_end(spark, sf):
    snap = snapshots(spark, "/root/testdata/sf0.01")
    plan = E.FoldPlan(folds=((1998, 1999), (1999, 2000)))
    features = ["river_realized_vol", "river_cum_return", "river_max_drawdown"]
    rows = E.evaluate_folds_detailed(snap, plan, features)
    river = snap.where((F.col("street") == "RIVER") & F.col("risk_severity").isNotNull())
    want = river.where(F.year("asof_date").isin(1999, 2000)).count()
    assert rows.count() == want
    assert rows.where(~F.col("p_tail").between(0, 1)).count() == 0
    metrics = E.fold_metrics(rows).collect()
    assert sorted(r["fold_id"] for r in metrics) == [0, 1]


def test_file_digests_and_spread_are_returned(spark, sf):
    import hashlib
    from pathlib import Path

    from __spark_entry__ import queries

    path = Path(sf) / "lineitem.parquet"
    files = [path] if path.is_file() else [p for p in path.rglob("*") if p.is_file()]
    got = {r["file"]: r["file_hash"] for r in queries()["s14_content_hash"](spark, sf).collect()}
    assert got == {p.name: hashlib.sha256(p.read_bytes()).hexdigest()[:16] for p in files}
    df = spark.createDataFrame([(1.0,), (4.0,), (None,), (9.0,), (2.0,)], "a double")
    from firstprint.operators.snapshots import null_report

    assert tuple(null_report(df, ["a"], spread=True).first()) == ("a", 1, 4.0, 3.0, 1.0, 9.0)


def test_manifest_has_hashes_and_action_counts(spark, sf):
    from __spark_entry__ import queries

    row = queries()["s13_run_manifest"](spark, sf).first()
    assert all(row[f"dataset_hash_{s}"] for s in ("train", "val", "test"))
    assert row["n_fold"] + row["n_small_bet"] + row["n_size_up"] == row["river_test"]


def test_audit_asks_the_bars_only_of_listings_without_snapshots(spark, tmp_path):
    from datetime import datetime, timedelta

    when = {"A": range(30), "C": range(-9, 0), "D": range(-2, 4), "E": range(7)}
    first = datetime(2020, 1, 10)
    rows = [(s, first + timedelta(days=i, hours=h)) for s, days in when.items() for i in days for h in (0, 1)]
    spark.createDataFrame(rows, "symbol string, ts timestamp").write.parquet(f"{tmp_path}/audited_bars")
    listings = spark.createDataFrame([(s, first.date(), "x", "1") for s in "ABCDE"], "symbol string, ipo_date date, sector string, sic string")
    snaps = spark.createDataFrame([("A", s) for s in vocab.STREETS], "symbol string, street string")
    out = S.build_audit(listings, spark.read.parquet(f"{tmp_path}/audited_bars"), snaps)
    assert {r["symbol"]: (r["status"], r["n_snapshots"], r["error"]) for r in out.collect()} == {
        "A": ("success", 3, ""), "B": ("failed", 0, "No bar data"), "C": ("partial", 0, "no_snapshots_built"),
        "D": ("failed", 0, "Not enough trading days to form FLOP window"), "E": ("failed", 0, "No bars for this index")}
    assert len(re.findall(r"Relation \[symbol#\d+,ts#\d+\]", out._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_a_file_above_a_split_is_digested_split_by_split(spark, tmp_path):
    import hashlib
    import random

    rng = random.Random(5)
    parts = {"ends": rng.randbytes(300_001) + b"\n", "open": rng.randbytes(300_001) + b"x", "lines": b"\r\n\n\xff\n" * 60_000,
             "few": b"a" * 200_000 + b"\n" + b"\0" * 150_000, "one": b"\n" * 70_000, "small": b"abc\n",
             "marked": b"\xef\xbb\xbf" + b"abc\n" * 30_000}
    for name, content in parts.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    read = []
    job = spark.sparkContext.runJob
    spark.sparkContext.runJob = lambda rdd, f, at: read.append(at) or job(rdd, f, at)
    try:
        got = {r["path"].rsplit("/", 1)[1]: r["content_hash"] for r in TB.file_hashes(spark, str(tmp_path)).collect()}
    finally:
        del spark.sparkContext.runJob
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {n: hashlib.sha256(c).hexdigest()[:16] for n, c in parts.items()}
    assert len(read) >= 5 + 5 + 5 + 6 + 2
