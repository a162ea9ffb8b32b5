import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import functions as F

from firstprint.operators import calibrate as K
from firstprint.operators import committee as CM
from firstprint.operators import ordering as O
from firstprint.operators import policy as P
from firstprint.plans import evaluation as E
from firstprint.session import materialise
from firstprint.sources import fixtures as fx


def scored(spark, sf):
    return fx.scored(spark, sf)


def test_running_totals_and_blocks(spark):
    df = spark.createDataFrame([(g, i, float((i * 37) % 11)) for g in (0, 1) for i in range(14)], "g int, i int, v double")
    got = O.running_totals(df, ["v", "i"], {"pos": F.lit(1), "sum_before": F.col("v")}, ["g"]).toPandas()
    for _, part in got.sort_values(["v", "i"]).groupby("g"):
        assert part["pos"].tolist() == list(range(14))
        assert part["sum_before"].tolist() == pytest.approx([0.0, *np.cumsum(part["v"])[:-1]])
    sizes = O.temporal_blocks(df, ["i"], 4, ["g"]).groupBy("g", "block").count().toPandas()
    assert sorted(sizes[sizes.g == 0]["count"], reverse=True) == [4, 4, 3, 3]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(np.round(v, 1))) for g, v in zip(rng.integers(0, 3, 400), rng.normal(size=400))]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    for r in O.exact_quantiles(df, "v", probs, ["g"]).collect():
        want = np.percentile([v for g, v in rows if g == r["g"]], [q * 100 for q in probs])
        assert r["quantiles"] == pytest.approx(want.tolist())


def test_temporal_split_matches_python(spark):
    df = spark.createDataFrame([(f"s{i:02d}", f"2020-01-{1 + i // 3:02d}") for i in range(17)], "symbol string, d string").withColumn("asof_date", F.to_date("d"))
    got = dict(O.temporal_split(df).select("symbol", "split").collect())
    n = 17
    names = [f"s{i:02d}" for i in range(n)]
    assert [got[s] for s in names] == ["train"] * int(n * 0.6) + ["val"] * (int(n * (0.6 + 0.2)) - int(n * 0.6)) + ["test"] * (n - int(n * (0.6 + 0.2)))


def test_rolled_labels(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(12)], "i int, y int")
    got = [r["rolled"] for r in O.rolled(df, ["i"], "y", 5).orderBy("i").collect()]
    assert got == np.roll([i % 3 for i in range(12)], 5).tolist()


def test_isotonic_equals_spark_ml(spark, sf):
    rows = scored(spark, sf).withColumns({"g": F.col("row_id") % 2, "noisy": F.col("p_tail") + (F.col("row_id") % 7) / 50})
    fitted = K.fit_apply("isotonic", rows.where("yr < 1998"), rows, "noisy", "adverse_20", "g").toPandas()
    for g in (0, 1):
        part = rows.where(F.col("g") == g).withColumn("label", F.col("adverse_20").cast("double"))
        model = IsotonicRegression(featuresCol="noisy", labelCol="label").fit(part.where("yr < 1998"))
        both = model.transform(part).select("row_id", "prediction").toPandas().merge(fitted, on="row_id")
        assert len(both) == part.count()
        assert np.abs(both["prediction"] - both["p"]).max() < 1e-12


def test_isotonic_on_hot_ties_and_single_level(spark):
    df = spark.createDataFrame([(0, 0.5, 1)] * 300 + [(0, 0.2, 0)] * 100 + [(1, 0.7, 1), (1, 0.7, 0)], "g int, s double, y int")
    ask = spark.createDataFrame([(0, 0.0), (0, 0.35), (0, 9.0), (1, 0.1)], "g int, s double")
    got = {(r["g"], r["s"]): r["p"] for r in K.fit_apply("isotonic", df, ask, "s", "y", "g").collect()}
    assert got == {(0, 0.0): 0.0, (0, 0.35): pytest.approx(0.5), (0, 9.0): 1.0, (1, 0.1): 0.5}


def test_platt_equals_spark_ml(spark, sf):
    rows = scored(spark, sf).withColumns({"g": F.lit(0), "label": F.col("adverse_20").cast("double")})
    got = K.fit_platt(rows, "p_tail", "adverse_20", "g").first()
    n = rows.count()
    lr = LogisticRegression(regParam=1 / n, elasticNetParam=0, standardization=False, tol=1e-12, maxIter=500)
    model = lr.fit(VectorAssembler(inputCols=["p_tail"], outputCol="features").transform(rows))
    assert got["slope"] == pytest.approx(model.coefficients[0], abs=1e-5)
    assert got["intercept"] == pytest.approx(model.intercept, abs=1e-5)


def test_platt_marks_what_did_not_converge(spark):
    df = spark.createDataFrame([(0, 0.1 * i, int(i % 3 == 0)) for i in range(30)] + [(1, 0.1 * i, 1) for i in range(9)], "g int, s double, y int")
    got = {r["g"]: r for r in K.fit_platt(df, "s", "y", "g").collect()}
    assert got[0]["converged"] and not got[1]["converged"]
    assert got[1]["slope"] == 0 and got[1]["intercept"] == pytest.approx(np.log(9.5 / 0.5))
    assert not K.fit_platt(df.where("g = 0"), "s", "y", "g", max_iter=1).first()["converged"]
    assert K.fit_platt(df.limit(0), "s", "y", "g").collect() == []


def test_challengers_below_the_event_gate_only_rank(spark, monkeypatch):
    rows = spark.range(80).select(F.col("id").cast("string").alias("row_id"), F.date_add(F.lit("2001-01-01").cast("date"), F.col("id").cast("int")).alias("asof_date"),
                                  ((F.col("id") * 37) % 80 / 80.0).alias("score"), ((F.col("id") * 37) % 80 > 40).cast("int").alias("adverse_20"),
                                  ((F.col("id") * 37) % 80 > 60).cast("int").alias("severe_30"))
    monkeypatch.setattr(E, "river_rows", lambda *a, **k: rows)
    monkeypatch.setattr(E, "oof_scores", lambda r, *a, **k: r.withColumn("fold_id", F.lit(0)))
    few = E.challengers(rows, ["x"]).collect()  # 19 severe events
    assert [r["name"] for r in few] == ["ranking"]
    failing = spark.createDataFrame([("ranking", False, 0.0, 0.5, None)], "name string, gate_passed boolean, false_safe_rate double, size_up_pct double, bss double")
    assert P.select_champion(failing).first() is None
    with pytest.raises(RuntimeError):
        P.require_champion(failing)


def test_binned_monotone_pass(spark):
    df = spark.createDataFrame([(0.5, 0.6, 0.1)], "a double, b double, c double")
    assert list(K._monotone_pass(df, ["a", "b", "c"], False).first()) == pytest.approx([0.5, 0.35, 0.35])
    assert list(K._monotone_pass(df, ["a", "b", "c"], True).first()) == pytest.approx([0.4, 0.4, 0.4], abs=0.02)


def test_ridge_and_neighbours_exact_with_hot_duplicates(spark):
    rng = np.random.default_rng(0)
    n, m, p = 600, 80, 5
    scale = np.array([1, 10, .1, 1, 1e5])
    x, t = rng.normal(size=(n, p)) * scale, rng.normal(size=(m, p)) * scale
    x[200:400] = x[0]  # a third of all rows share one point
    y = x[:, 0] + rng.normal(size=n)
    z, zt = (x - x.mean(0)) / x.std(0), (t - x.mean(0)) / x.std(0)
    train = spark.createDataFrame(pd.DataFrame({"fit": 0, "row_id": [f"r{i:04d}" for i in range(n)], "vec": x.tolist(), "y": y}))
    test = spark.createDataFrame(pd.DataFrame({"fit": 0, "row_id": [f"t{i:04d}" for i in range(m)], "vec": t.tolist()}))
    params = CM.fit_ridge(train, p)
    rows = CM.apply_ridge(test, params)
    got = rows.toPandas().sort_values("row_id")
    coef = np.linalg.solve(z.T @ z + 1000 * np.eye(p), z.T @ (y - y.mean()))
    assert np.abs(got["ridge"] - (zt @ coef + y.mean())).max() < 1e-9
    d = np.round(np.sqrt(((zt[:, None] - z[None]) ** 2).sum(2)), 10)
    want = y[np.argsort(d, 1, kind="stable")[:, :7]].mean(1)
    scaled, asked = CM.scale_rows(train, params), rows.select("fit", "row_id", "z")
    found = CM.nearest_targets(scaled, asked, 7).toPandas().sort_values("row_id")
    assert len(found) == m and np.abs(found["knn"].to_numpy() - want).max() < 1e-12
    kept = sorted(range(n), key=lambda i: (hashlib.md5(b"r%04d" % i).hexdigest(), i))[:150]
    few = CM.nearest_targets(scaled, asked, 7, fit_rows=150).toPandas().sort_values("row_id")
    kept.sort()
    want = y[kept][np.argsort(d[:, kept], 1, kind="stable")[:, :7]].mean(1)
    assert np.abs(few["knn"].to_numpy() - want).max() < 1e-12
    with pytest.raises(ValueError):
        CM.neighbour_rows(train, limit=1000)


def test_nearest_means_with_ties_offsets_and_blocks(monkeypatch):
    """One-hot rows (all at one distance), a large common offset and tiny blocks: as measured one by one."""
    monkeypatch.setattr(CM, "BLOCK", 500)
    rng = np.random.default_rng(2)
    for rows in (np.eye(60), rng.normal(size=(200, 9)) + 1e6, np.repeat(rng.normal(size=(5, 4)), 30, axis=0), rng.normal(size=(4, 3)) * 1e-9):
        y, asked = rng.normal(size=len(rows)), np.r_[rows[:7], rng.normal(size=(5, rows.shape[1]))]
        d = np.round(np.sqrt(((asked[:, None] - rows[None]) ** 2).sum(2)), 10)
        want = np.take(y, np.argsort(d, 1, kind="stable")[:, :7]).mean(1)
        assert CM.mean_of_nearest(asked, rows, y, 7, 10) == pytest.approx(want, abs=1e-12)


def test_draws_of_pieces_unite_to_the_draw_of_the_whole(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"fit": rng.integers(0, 3, 400), "row_id": [f"k{i}" for i in range(400)], "vec": rng.normal(size=(400, 2)).tolist(), "y": rng.normal(size=400)})
    pieces = spark.createDataFrame(frame)
    united = CM.neighbour_rows(pieces, {9: [0, 1, 2], 4: [0]}, most=40)
    whole = CM.neighbour_rows(pieces.withColumn("fit", F.lit(9).cast("bigint")), most=40)
    assert united.rows[united.members[9]] == pytest.approx(whole.rows[whole.members[9]])
    assert len(united.members[4]) == 40 and CM.neighbour_rows(pieces.limit(0)).members == {}


def test_committee_scores_rows_where_they_lie(spark):
    """No exchange, no join between the rows to be scored and their scores; other columns go along."""
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"fit": 0, "row_id": [f"k{i}" for i in range(80)], "vec": rng.normal(size=(80, 3)).tolist(), "y": rng.normal(size=80)})
    train = spark.createDataFrame(frame)
    asked = train.select("fit", "row_id", "vec", F.lit("x").alias("note")).unionByName(
        train.limit(3).select(F.lit(5).cast("bigint").alias("fit"), "row_id", "vec", F.lit("unknown").alias("note")))
    path = materialise(asked, "asked")
    got = CM.committee_scores(train, path, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "MapInArrow" in plan
    rows = got.toPandas()
    assert len(rows) == 80 and set(rows["note"]) == {"x"} and np.allclose(rows["score"], (rows["ridge"] + rows["knn"]) / 2)


def test_ridge_equals_spark_ml_and_masks_features(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) * [1, 5, 100] + [0, 2, 1e6]
    y = x @ [1.0, -0.2, 0.01] + rng.normal(size=200)
    train = spark.createDataFrame(pd.DataFrame({"fit": [0] * 200, "row_id": range(200), "vec": x.tolist(), "y": y}))
    both = train.unionByName(train.withColumn("fit", F.lit(1).cast("bigint")))
    params = CM.fit_ridge(both, 3, 50.0, {0: np.array([True] * 3), 1: np.array([True, False, True])})
    assert params[1].coef[1] == 0 and params[1].inv_sd[1] == 0
    z = (x - x.mean(0)) / x.std(0)
    frame = spark.createDataFrame(pd.DataFrame({"a": z[:, 0], "b": z[:, 1], "c": z[:, 2], "label": y}))
    model = LinearRegression(regParam=50.0 / 200 * y.std(), elasticNetParam=0, standardization=False, solver="normal").fit(
        VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(frame))
    assert params[0].coef == pytest.approx(model.coefficients.toArray(), abs=1e-8)


def test_threshold_search_against_brute_force(spark, sf):
    df = scored(spark, sf)
    pdf = df.toPandas()
    p, sev, adv = pdf["p_tail"].to_numpy(), pdf["severe_30"].to_numpy() == 1, pdf["adverse_20"].to_numpy() == 1

    def report(f, s):
        a = np.where(p >= f, 2, np.where(p >= s, 1, 0))
        return ((a == 2).mean(), (a == 1).mean(), (a == 0).mean(), (a[sev] == 0).mean(), (a[adv] == 2).mean())

    best, chosen = report(0.6, 0.3), (0.6, 0.3)
    for f in P.FOLD_GRID:
        for s in P.SMALL_BET_GRID:
            r = report(f, s)
            if s < f and r[3] <= 0.03 and r[2] >= 0.10 and r[1] >= 0.12 and r[0] <= 0.80 and r[2] > best[2]:
                best, chosen = r, (f, s)
    got = P.optimise_thresholds(df, constraints=E.STABILITY).first()
    assert (got["fold_min"], got["small_bet_min"]) == chosen
    assert [got[c] for c in P.REPORT] == pytest.approx(best)


def test_infeasible_default_is_returned_and_flagged(spark):
    df = spark.createDataFrame([(0.01, 1, 1)] * 10, "p_tail double, severe_30 int, adverse_20 int")
    got = P.optimise_thresholds(df).first()
    assert (got["fold_min"], got["small_bet_min"], got["feasible"]) == (0.6, 0.3, False)


def test_policy_toy(spark):
    df = P.with_action(spark.createDataFrame([(0.9, 1, 1), (0.6, 0, 1), (0.5, 1, 1), (0.3, 0, 0), (0.1, 1, 0), (0.0, 0, 0)],
                                             "p_tail double, severe_30 int, adverse_20 int"))
    r = P.coverage_report(df).first()
    assert [r[c] for c in ("n", *P.REPORT)] == [6, pytest.approx(1 / 3), pytest.approx(1 / 3), pytest.approx(1 / 3), pytest.approx(1 / 3), pytest.approx(2 / 3)]
    none = P.coverage_report(df.where("severe_30 = 0 and adverse_20 = 0")).first()
    assert none["false_safe_rate"] == 0 and none["adverse_detection_rate"] == 0


def test_min_false_safe_rate(spark):
    from firstprint.functions.columns import min_false_safe_rate

    df = spark.createDataFrame([(0.38, 0.5), (0.6, 0.5), (0.0, 0.5)], "p double, c double")
    assert [r[0] for r in df.select(min_false_safe_rate(F.col("p"), F.col("c"))).collect()] == [0.0, pytest.approx(1 / 6), 0.0]


def test_champion_order_and_failure(spark):
    df = spark.createDataFrame([("a", True, 0.02, 0.3, 0.2), ("b", True, 0.02, 0.3, None), ("c", True, 0.02, 0.4, 0.1), ("d", False, 0.0, 0.9, 0.9)],
                               "name string, gate_passed boolean, false_safe_rate double, size_up_pct double, bss double")
    assert P.require_champion(df) == "c"
    assert P.require_champion(df.where("name in ('a','b')")) == "a"
    with pytest.raises(RuntimeError):
        P.require_champion(df.where("name = 'd'"))


def test_permutations_keep_the_labels(spark, sf):
    rows = scored(spark, sf).select("row_id", "asof_date", "p_tail", "adverse_20")
    got = K.permuted_labels(rows, "adverse_20", ["asof_date", "row_id"], 3, 42).groupBy("rep").agg(
        F.count(F.lit(1)).alias("n"), F.sum("adverse_20").alias("s"), F.count_distinct("row_id").alias("u")).collect()
    n, s = rows.count(), rows.agg(F.sum("adverse_20")).first()[0]
    assert {(r["n"], r["s"], r["u"]) for r in got} == {(n, s, n)} and len(got) == 3


def test_resamples_have_full_size(spark, sf):
    rows = scored(spark, sf).select("row_id", "p_tail", "adverse_20")
    n = rows.count()
    got = K.resamples(rows, 4, 7, ["p_tail", "adverse_20"]).groupBy("rep").agg(F.sum("times").alias("n")).collect()
    assert sorted((r["rep"], r["n"]) for r in got) == [(i, n) for i in range(4)]


def test_bootstrap_brier_from_pools(spark, sf):
    """With one replicate the pool-sum score equals scoring every row."""
    rows = scored(spark, sf).select("row_id", "p_tail", "adverse_20")
    draws = K.resamples(rows, 1, 42, ["p_tail", "adverse_20"]).select(
        "rep", "p_tail", "adverse_20", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("x"))
    for method in ("isotonic", "binned"):
        pdf = K.fit_apply(method, draws, draws, "p_tail", "adverse_20", "rep").toPandas()
        y = pdf["adverse_20"]
        want = 1 - ((pdf["p"] - y) ** 2).mean() / (y.mean() * (1 - y.mean()))
        got = K.bootstrap_skills(rows, "p_tail", "adverse_20", ["row_id"], method, 1, 42).first()["bss"]
        assert got == pytest.approx(want)


def test_bootstrap_over_several_chunks(spark, monkeypatch):
    """Continuous scores in many chunks: each replicate equals a fit on its own draws, and few rows leave the tasks."""
    monkeypatch.setattr(K, "LEVELS", 64)
    monkeypatch.setattr(K, "FAN", 2)
    rng = np.random.default_rng(8)
    s = rng.random(1500)
    df = spark.createDataFrame(pd.DataFrame({"s": np.r_[s, s[:200]], "y": (rng.random(1700) < np.r_[s, s[:200]]).astype(int)})).repartition(5)
    draws = K.resamples(df, 6, 11, ["s", "y"]).toPandas()
    assert (draws.groupby("rep")["times"].sum() == 1700).all()
    want = {"isotonic": {}, "binned": {}}
    for rep, part in draws.groupby("rep"):
        one = spark.createDataFrame(part)
        for method in want:
            p = K.fit_apply(method, one, one, "s", "y", "rep", weight="times").toPandas()
            mean = (p["y"] * p["times"]).sum() / 1700
            want[method][rep] = 1 - ((p["p"] - p["y"]) ** 2 * p["times"]).sum() / 1700 / (mean * (1 - mean))
        break  # one replicate against the row-wise fit; the others by their pools below
    for method in want:
        got = {r["rep"]: r["bss"] for r in K.bootstrap_skills(df, "s", "y", [], method, 6, 11).collect()}
        assert len(got) == 6 and got[0] == pytest.approx(want[method][0])
    pools = K.bootstrap_pools(df, "s", "y", 6, 11).toPandas()
    for rep, part in draws.groupby("rep"):
        levels = part.assign(pos=part["y"] * part["times"]).groupby("s", as_index=False)[["times", "pos"]].sum()
        lo, hi, n, pos = K._pool(levels["s"], levels["s"], levels["times"], levels["pos"])
        mine = pools[pools["rep"] == rep].sort_values("lo")
        assert np.array_equal(mine[["lo", "hi", "n", "pos"]].to_numpy(), np.stack([lo, hi, n, pos], axis=1))
    assert len(pools) < len(draws) / 10


def test_bootstrap_shuffles_levels_once_whatever_the_replicates(spark):
    """The plan of the draws has no table of replicates in it: levels meet their chunk, nothing else is exchanged."""
    df = spark.createDataFrame([(i / 50, i % 2) for i in range(50)], "s double, y int")
    plan = K.dealt(df.withColumn("_c", F.lit(1).cast("bigint")), ["s"], 50, 1000, 1, "multinomial", summary=lambda *a: None,
                   schema="rep int")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Generate" not in plan


def test_isotonic_outlier_many_ranges_and_null_scores(spark, monkeypatch):
    """One far outlier and small blocks: no bin holds the rest; null and NaN scores get null; rows are neither lost nor doubled."""
    monkeypatch.setattr(K, "FAN", 2)
    rng = np.random.default_rng(3)
    s = np.r_[rng.random(3000), 1e12]
    y = (rng.random(3001) < np.minimum(s, 1)).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "s": s, "y": y})).repartition(7)
    pools = K.isotonic_pools(df, "s", "y", "g")
    order = np.argsort(s)
    lo, hi, n, pos = K._pool(s[order], s[order], np.ones(3001), y[order])
    got = pools.toPandas().sort_values("lo")
    assert np.array_equal(got[["lo", "hi", "n", "pos"]].to_numpy(), np.stack([lo, hi, n, pos], axis=1))
    ask = df.select("g", "s").unionByName(spark.createDataFrame([(0, None), (0, float("nan")), (0, float("-inf")), (0, float("inf")), (1, 0.5)], "g long, s double"))
    ask = ask.withColumns({c: F.lit(7) for c in ("_block", "_g", "_b", "_s", "lo", "x1")})  # columns of the caller stay
    segs = K.isotonic_segments(pools, "g")
    xs = np.sort(np.r_[lo, hi[hi > lo]])
    at = {v: p / m for v, m, p in zip(np.r_[lo, hi], np.r_[n, n], np.r_[pos, pos])}
    ps = np.array([at[v] for v in xs])
    want = np.interp(s, xs, ps)
    for block, limit in ((4, 64 << 20), (1000, 64 << 20), (4, 0)):
        monkeypatch.setattr(K, "BROADCAST_BYTES", limit)
        out = K.apply_isotonic(ask, segs, "s", "g", block=block).toPandas()
        assert len(out) == 3005 and set(out["g"]) == {0} and (out[["_block", "_g", "_b", "_s", "lo", "x1"]] == 7).all().all()
        seen = out[np.isfinite(out["s"].astype(float))]
        assert np.allclose(seen.sort_values("s")["p"], want[np.argsort(s)])
        assert out["p"].isna().sum() == 2 and {ps[0], ps[-1]} <= set(out["p"].dropna())


def test_pool_cascades_beyond_the_passes(monkeypatch):
    rng = np.random.default_rng(5)
    x, n = np.arange(400.0), rng.integers(1, 6, 400).astype(float)
    pos = np.minimum(n, rng.integers(0, 6, 400))
    full = K._pool(x, x, n, pos)
    monkeypatch.setattr(K, "PASSES", 1)
    assert all(np.array_equal(a, b) for a, b in zip(full, K._pool(x, x, n, pos)))
    assert (np.diff(full[3] / full[2]) > 0).all() and full[2].sum() == n.sum()


def test_replicates_are_the_operators_own_number(spark, sf):
    from __spark_entry__ import queries

    assert queries()["m12_bootstrap_interval"](spark, sf).first()["replicates"] == 1000


def test_weighted_levels_fit_like_repeated_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i % 2), float(s), int(rng.random() < s), int(w)) for i, (s, w) in enumerate(zip(rng.integers(0, 20, 120) / 20, rng.integers(1, 5, 120)))]
    few = spark.createDataFrame(rows, "g int, s double, y int, w int")
    many = few.select("g", "s", "y", F.explode(F.array_repeat(F.lit(1), F.col("w"))).alias("x"))
    for method in K.METHODS:
        a, b = (K.fit_apply(method, t, few, "s", "y", "g", weight=w).orderBy("g", "s", "y", "w").toPandas()["p"].to_numpy() for t, w in ((few, "w"), (many, None)))
        assert a == pytest.approx(b, abs=1e-9)


def test_dealt_draws_do_not_depend_on_chunks_being_several(spark, monkeypatch):
    """Counts of each level add up to the draws, with and without replacement, over several chunks; their means are right."""
    monkeypatch.setattr(K, "LEVELS", 4)
    levels = spark.createDataFrame([(float(i), 5 + i) for i in range(11)], "s double, _c long")
    n = sum(5 + i for i in range(11))
    for kind, total in (("multinomial", n), ("multivariate_hypergeometric", 40)):
        got = K.dealt(levels, ["s"], total, 400, 3, kind).toPandas()
        assert (got.groupby("rep")["times"].sum() == total).all() and got["rep"].nunique() == 400
        assert got.groupby("s")["times"].mean().to_numpy() == pytest.approx(np.array([5 + i for i in range(11)]) * total / n, rel=0.1)
        if kind != "multinomial":
            assert (got["times"] <= got["_c"]).all()


def test_shuffled_levels_hold_all_rows_and_events(spark, sf):
    rows = scored(spark, sf).select("row_id", "asof_date", "p_tail", "adverse_20")
    got = K.permuted_levels(rows, "p_tail", "adverse_20", ["asof_date", "row_id"], 100, 3, 42).groupBy("rep").agg(
        F.sum("times").alias("n"), F.sum(F.col("times") * F.col("adverse_20")).alias("s")).collect()
    n, s = rows.count(), rows.agg(F.sum("adverse_20")).first()[0]
    assert {(r["n"], r["s"]) for r in got} == {(n, s)} and len(got) == 100


def test_committee_queries_take_all_null_free_features(spark, sf, monkeypatch):
    from __spark_entry__ import queries
    from firstprint.plans.catalog_data import snapshots

    labelled = snapshots(spark, sf).where("street = 'RIVER' and risk_severity is not null")
    wide, early = (len(E.feature_columns(rows)) for rows in (labelled, labelled.where("year(asof_date) <= 1998")))
    assert min(wide, early) > 11
    given = {}

    def stop(name, at):
        def run(*a, **kw):
            given[name] = a[at] if len(a) > at else None
            raise InterruptedError
        return run

    for fn, at in (("committee_on_split", 2), ("oof_scores", 1), ("full_run", 1)):
        monkeypatch.setattr(E, fn, stop(fn, at))
    for name, fn, want in (("m03_committee", "committee_on_split", early), ("e14_river_baselines", "committee_on_split", early),
                           ("m07_oof_scores", "oof_scores", wide), ("s13_run_manifest", "full_run", None)):
        with pytest.raises(InterruptedError):
            queries()[name](spark, sf)
        assert given.pop(fn) == want


def test_committee_scores_every_row_on_all_features(spark, sf):
    from __spark_entry__ import queries

    rows = queries()["m03_committee"](spark, sf).toPandas()
    assert len(rows) and rows[["ridge", "knn", "score"]].notna().all().all()


def test_scoring_is_dealt_by_its_work_not_by_files(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("id as row_id", "array(sin(id), cos(3 * id)) as vec", "sin(id) + id % 7 as y",
                                        "date_add(date'2020-01-01', int(id)) as asof_date").coalesce(1)
    whole = {r["row_id"]: r["score"] for r in E.committee_on_split(rows, F.col("row_id") < 500, 2).collect()}
    oof = {(r["row_id"], r["fold_id"]): r["score"] for r in E.oof_scores(rows, 2).collect()}
    monkeypatch.setattr(CM, "ASKED_ROWS", 100)
    assert CM.dealt(rows).rdd.getNumPartitions() == 10 and CM.dealt(rows, 3).rdd.getNumPartitions() == 30
    out = E.committee_on_split(rows, F.col("row_id") < 500, 2)
    assert out.rdd.getNumPartitions() == 10
    assert {r["row_id"]: r["score"] for r in out.collect()} == pytest.approx(whole, abs=1e-12)
    assert {(r["row_id"], r["fold_id"]): r["score"] for r in E.oof_scores(rows, 2).collect()} == pytest.approx(oof, abs=1e-12)


def test_neighbour_blocks_stay_small():
    import tracemalloc

    rng = np.random.default_rng(7)
    rows, y = rng.normal(size=(16_384, 70)), rng.normal(size=16_384)
    tracemalloc.start()
    CM.mean_of_nearest(rng.normal(size=(2_000, 70)), rows, y, 7, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
