from datetime import date

import numpy as np
import pytest

from tarnbeck.operators import model


def data(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(50, 20, n), rng.poisson(2, n).astype(float)], axis=1)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 60) / 15 + 0.5 * x[:, 1]))).astype(int)
    return x, y


def test_fit_against_numpy(spark):
    x, y = data()
    df = spark.createDataFrame([(float(a), float(b), 7.0, int(t)) for (a, b), t in zip(x, y)], "a double, b double, k double, churn_label int")
    got = model.fit_logistic(df, ("a", "b", "k"))
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0), np.zeros(len(x))])
    w = len(y) / (2 * np.where(y == 1, y.sum(), len(y) - y.sum()))
    beta = np.zeros(4)
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve(np.eye(4) + z.T @ (z * (w * p * (1 - p))[:, None]), beta + z.T @ (w * (p - y)))
    assert got.weights == pytest.approx(beta, abs=1e-8)
    assert model.LogisticModel.from_json(got.to_json()) == got
    scored = [r[0] for r in df.select(got.probability()).collect()]
    assert scored == pytest.approx(1 / (1 + np.exp(-z @ beta)))


def test_metrics_with_ties_against_numpy(spark):
    _, y = data()
    s = np.round(np.random.default_rng(3).random(len(y)), 1)
    got = model.ranking_metrics(spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, churn_label int")).head()
    ap = tp = seen = 0
    for v in sorted(set(s), reverse=True):
        at = s == v
        tp, seen = tp + y[at].sum(), seen + at.sum()
        ap += y[at].sum() / y.sum() * tp / seen
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert (got.average_precision, got.roc_auc, got.brier) == pytest.approx((ap, auc, np.mean((s - y) ** 2)))


def test_metrics_of_scores_that_lie_close_together(spark):
    rng = np.random.default_rng(5)
    s = np.concatenate([1 - rng.random(3000) * 1e-9, rng.random(200)])
    y = rng.integers(0, 2, len(s))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, churn_label int")
    got = model.ranking_metrics(df).head()
    order = np.argsort(-s)
    tp = np.cumsum(y[order])
    ap = (y[order] * tp / np.arange(1, len(s) + 1)).sum() / y.sum()
    auc = (s[y == 1][:, None] > s[y == 0]).mean()
    assert (got.average_precision, got.roc_auc) == pytest.approx((ap, auc), rel=1e-9)
    bins = model._in_bins(df.select(df.score.alias("s"))).groupBy("bin").count()
    assert bins.agg({"count": "max"}).head()[0] < 0.02 * len(s)


def test_split_days():
    days = [date(2025, m, 1) for m in (3, 1, 2)]
    assert model.split_days(days, 0.34) == ([date(2025, 1, 1)], [date(2025, 2, 1), date(2025, 3, 1)])
    assert [len(p) for p in model.split_days(days, 0.01)] == [2, 1]
    assert [len(p) for p in model.split_days(days, 0.99)] == [1, 2]
    for bad in (0, 1, -1):
        with pytest.raises(ValueError):
            model.split_days(days, bad)
    with pytest.raises(ValueError):
        model.split_days(days[:1], 0.5)


def test_one_class_is_an_error(spark):
    with pytest.raises(RuntimeError):
        model.fit_logistic(spark.createDataFrame([(1.0, 1)], "a double, churn_label int"), ("a",))
