"""Linear fits, boosted trees and ensembles against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as G
from tidemark.operators import linear as L


def test_moments_and_ridge_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (300, 3)).astype(float)
    y = x @ [1.0, -2.0, 0.0] + rng.normal(0, 0.5, 300) + 3
    rows = spark.createDataFrame([(*map(float, a), float(b), i) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(1.0, 1.0, None, None, 999)], "a double, b double, c double, y double, i int")
    whole, early, late = L.moments(rows, ["a", "b", "c"], "y", F.lit(True), F.col("i") < 240, F.col("i") >= 240)
    full = np.column_stack([np.ones(300), x])
    penalty = np.diag([0, 10.0, 10.0, 10.0])
    assert np.allclose(whole.ridge(10.0), np.linalg.solve(full.T @ full + penalty, full.T @ y))
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    sigma2 = ((y - full @ beta) ** 2).sum() / (300 - 4)
    assert np.allclose(whole.t_stats(), (beta / np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * sigma2))[1:])
    losses = [np.mean((y[240:] - full[240:] @ np.linalg.solve(full[:240].T @ full[:240] + np.diag([0, p, p, p]), full[:240].T @ y[:240])) ** 2) for p in L.LAMBDAS]
    chosen, loss = L.chosen_ridge(early, late)
    assert chosen == L.LAMBDAS[int(np.argmin(losses))] and np.isclose(loss, min(losses))


def test_points_are_gated_scaled_and_capped():
    got = L.points(np.array([0.5, -0.25, 0.4, 0.01]), np.array([3.0, -2.0, 0.5, 9.0]), np.array([100, 100, 100, 5]))
    assert got.tolist() == [5, -2, 0, 0]  # halves go to the even number; not significant; fired too seldom
    assert L.points(np.zeros(2), np.ones(2), np.full(2, 99)).tolist() == [0, 0]


@pytest.mark.parametrize("loss", ["squared", "huber", "quantile"])
def test_boosting_learns_and_is_repeatable(loss):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    x[rng.random((600, 4)) < 0.05] = np.nan
    y = np.where(np.nan_to_num(x[:, 0]) > 0, 2.0, -1.0) + np.nan_to_num(x[:, 1]) + rng.normal(0, 0.1, 600)
    params = G.Params(loss=loss, alpha=0.5 if loss == "quantile" else 1.0)
    model = G.fit(x[:400], y[:400], params, 7)
    assert np.corrcoef(model.predict(x[400:]), y[400:])[0, 1] > 0.8
    assert np.array_equal(model.predict(x), G.fit(x[:400], y[:400], params, 7).predict(x))
    assert model.gains(4)[:2].sum() > model.gains(4)[2:].sum()


def test_boosted_classifier():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=500) > 0).astype(float)
    model = G.fit(x[:350], y[:350], G.Params(loss="logistic", rate=0.2), 1)
    p = model.predict(x[350:])
    assert ((p > 0.5) == (y[350:] > 0)).mean() > 0.88 and p.min() >= 0 and p.max() <= 1
    one = G.fit(x, np.ones(500), G.Params(loss="logistic"))
    assert len(set(one.predict(x))) == 1 and one.predict(x)[0] > 0.99


def test_members_rank_against_their_own_training():
    assert G.reference_rank(np.array([1.0, 2.0, 2.0, 3.0]), np.array([0.0, 2.0, 2.5, 9.0])).tolist() == [0.0, 0.25, 0.75, 1.0]
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    score = G.ensemble(x[:200], x[:200, 0], x[200:], 2, G.Params(trees=20))
    assert 0 <= score.min() and score.max() <= 1 and np.corrcoef(score, x[200:, 0])[0, 1] > 0.9
    assert G.ensemble(x[:0], x[:0, 0], x, 2).tolist() == [0.0] * 300


def test_ensemble_scores_of_any_number_of_rows(spark):
    from tidemark.plans.q_models import ensemble_scores

    n, params = 200_002, G.Params(trees=2)  # more than one group held before
    rows = spark.range(n).select(
        (F.col("id") % 1000).alias("issuer"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 1000).cast("int")).alias("event_day"), (F.col("id") / 100).cast("int").alias("entry_idx"),
        F.when(F.col("id") % 11 > 0, F.col("id") * 7919 % 1009).cast("double").alias("a"), (F.col("id") % 13).alias("b"), F.when(F.col("id") % 17 > 0, F.col("id") * 7919 % 1009 + F.col("id") % 3).alias("y"),
    )
    got = ensemble_scores(rows, ["a", "b"], "y", members=2, params=params).toPandas().sort_values(["event_day", "issuer"])
    data = rows.toPandas().sort_values(["event_day", "issuer"])
    block = np.repeat(np.arange(5), [40_001, 40_001, 40_000, 40_000, 40_000])
    want = []
    for fold in range(1, 5):
        y, entry, new = data["y"].to_numpy(float), data["entry_idx"].to_numpy(), block == fold
        train = (block < fold) & ~np.isnan(y) & (entry + 68 < entry[new].min())
        x = data[["a", "b"]].to_numpy(float)
        want.append(G.ensemble(x[train], y[train], x[new], 2, params))
    assert got["fold"].tolist() == block[block > 0].tolist() and np.array_equal(got["score"], np.concatenate(want))
    assert ensemble_scores(rows.limit(0), ["a", "b"], "y").count() == 0 and ensemble_scores(rows.limit(3), ["a", "b"], "y").count() == 2
