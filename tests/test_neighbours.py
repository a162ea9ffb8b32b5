"""Neighbours come from all training rows, whatever their number, and both ways of finding them agree."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from firstprint.operators import committee as CM
from firstprint.plans import evaluation as E


def brute(asked, rows, y, k):
    """Mean y of the k rows nearest to each asked one; ties to the earlier row."""
    out = []
    for a in asked:
        d = np.round(np.sqrt(((rows - a) ** 2).sum(1)), 10)
        out.append(y[np.argsort(d, kind="stable")[:k]].mean())
    return np.array(out)


def scaled(x, train):
    return (x - x[train].mean(0)) / x[train].std(0)


def many(n, seed=0):
    """row_id, asof_date, sector, labels and two features; a fifth of the points lie on one of ten places, so there are ties."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [1.0, 100.0]
    hot = rng.random(n) < 0.2
    x[hot] = x[:10][rng.integers(0, 10, hot.sum())]
    severe = (rng.random(n) < 0.2).astype(int)
    return pd.DataFrame({"row_id": [f"r{i:06d}" for i in range(n)], "asof_date": pd.Timestamp("1997-01-01") + pd.to_timedelta(np.arange(n) % 360, "D"),
                         "yr": 1997, "sector": "energy", "y": x[:, 0] + rng.normal(size=n), "adverse_20": np.maximum(severe, rng.integers(0, 2, n)),
                         "severe_30": severe, "vec": x.tolist()})


def small_tiles(monkeypatch):
    monkeypatch.setattr(CM, "MODEL_BYTES", 0)
    monkeypatch.setattr(CM, "TRAIN_TILE", 3_000)
    monkeypatch.setattr(CM, "ASKED_TILE", 60)


@pytest.mark.parametrize("k", [7, 3])
def test_nearest_targets_looks_at_every_training_row(spark, monkeypatch, k):
    data = many(20_000)
    z = np.stack(data["vec"])
    frame = data[["row_id", "y"]].assign(fit=0, z=z.tolist())
    train, test = spark.createDataFrame(frame), spark.createDataFrame(frame.iloc[::100].assign(y=0.0))
    want = brute(z[::100], z, data["y"].to_numpy(), k)
    got = CM.nearest_targets(train, test, k).toPandas().sort_values("row_id")
    assert got["knn"].to_numpy() == pytest.approx(want, abs=1e-12)
    small_tiles(monkeypatch)
    tiled = CM.nearest_targets(train, test.unionByName(test.limit(1).withColumn("fit", F.lit(3).cast("bigint"))), k).toPandas().sort_values("row_id")
    assert tiled["knn"].tolist() == got["knn"].tolist()


def test_committee_on_split_looks_at_every_training_row(spark, monkeypatch):
    data = many(18_000)
    held = np.arange(18_000) % 40 == 0
    z = scaled(np.stack(data["vec"]), ~held)
    rows = spark.createDataFrame(data.assign(held=held))
    want = brute(z[held], z[~held], data["y"].to_numpy()[~held], 7)
    got = E.committee_on_split(rows, ~F.col("held"), 2).where("held").toPandas().sort_values("row_id")
    assert got["knn"].to_numpy() == pytest.approx(want, abs=1e-9)
    small_tiles(monkeypatch)
    few = rows.where("held").withColumn("fit", F.lit(0).cast("bigint"))
    train = rows.where("not held").withColumn("fit", F.lit(0).cast("bigint"))
    tiled = CM.committee_scores(train, few, 2).toPandas().sort_values("row_id")
    for column in ("ridge", "knn", "score"):
        assert tiled[column].to_numpy() == pytest.approx(got[column].to_numpy(), abs=1e-12)


def test_oof_scores_look_at_every_earlier_row(spark):
    data = many(24_000)
    order = data.sort_values(["asof_date", "row_id"]).index.to_numpy()
    train, asked = np.sort(order[:18_000]), order[18_000::100]  # the last of four blocks, and all before it
    x = np.stack(data["vec"])
    z = (x - x[train].mean(0)) / x[train].std(0)
    want = dict(zip(data["row_id"].iloc[asked], brute(z[asked], z[train], data["y"].to_numpy()[train], 7)))
    scores = E.oof_scores(spark.createDataFrame(data), 2).where(F.col("fold_id") == 3)
    got = {r["row_id"]: r["knn"] for r in scores.where(F.col("row_id").isin(list(want))).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_folds_look_at_every_training_row(spark, monkeypatch):
    """Variants share pieces, fits take several of them, a masked feature counts for nothing."""
    data = many(18_200)
    data.loc[18_000:, "yr"] = 1998
    train = data["yr"].to_numpy() == 1997
    names = ["a", E.V1_COLS[0]]
    plan, variants = E.FoldPlan(folds=((1997, 1998),)), {"all": E.V1_COLS, "first": []}
    rows = spark.createDataFrame(data)

    def tested():
        out = E._scored_folds(rows, plan, names, variants).where(F.col("part") == "test").toPandas().sort_values(["variant", "row_id"])
        return {v: g["score"].to_numpy() for v, g in out.groupby("variant")}

    got = tested()
    x, y = np.stack(data["vec"]), data["y"].to_numpy()
    for name, used in (("all", [1, 1]), ("first", [1, 0])):
        z = scaled(x, train) * used
        coef = np.linalg.solve(z[train].T @ z[train] + 1000 * np.eye(2), z[train].T @ (y[train] - y[train].mean()))
        want = (z[~train] @ coef + y[train].mean() + brute(z[~train], z[train], y[train], 7)) / 2
        assert got[name] == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(CM, "MODEL_BYTES", 0)
    monkeypatch.setattr(CM, "TRAIN_TILE", 2_000)
    for name, score in tested().items():
        assert score == pytest.approx(got[name], abs=1e-12)


def test_rows_with_nan_have_no_neighbours_and_take_none_from_others(spark, monkeypatch):
    rng = np.random.default_rng(3)
    z, y = rng.normal(size=(50, 2)), rng.normal(size=50)
    asked = np.r_[z[:3], [[np.nan, 0.0]], z[3:5]]
    assert CM.mean_of_nearest(asked, z, y, 7, 10) == pytest.approx(np.r_[brute(z[:3], z, y, 7), np.nan, brute(z[3:5], z, y, 7)], nan_ok=True)
    train = spark.createDataFrame(pd.DataFrame({"fit": 0, "row_id": range(50), "z": z.tolist(), "y": y}))
    test = spark.createDataFrame(pd.DataFrame({"fit": 0, "row_id": range(6), "z": asked.tolist()}))
    sent = CM.nearest_targets(train, test).toPandas().sort_values("row_id")["knn"]
    small_tiles(monkeypatch)
    tiled = CM.nearest_targets(train, test).toPandas().sort_values("row_id")["knn"]
    assert np.isnan(sent.iloc[3]) and tiled.tolist() == pytest.approx(sent.tolist(), nan_ok=True)


def test_a_feature_constant_in_a_fit_counts_for_nothing(spark):
    """Its deviation from sums of products is rounding noise, which blew it up and differed from run to run."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4_000, 12))
    early = np.arange(4_000) < 1_001
    x[early, 1:] = np.arange(1, 12) / 7  # all but the first have one value each in piece 0
    train = spark.createDataFrame(pd.DataFrame({"fit": np.where(early, 0, 1), "row_id": range(4_000), "vec": x.tolist(), "y": x[:, 0]}))
    params = CM.fit_ridge(train, 12, parts={5: [0], 6: [0, 1]})
    assert params[5].inv_sd[0] == pytest.approx(1 / x[early, 0].std()) and not params[5].inv_sd[1:].any()
    assert params[6].inv_sd == pytest.approx(1 / x.std(0))
