"""Time split, balanced logistic regression, and its measures, as aggregations in Spark."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from datetime import date

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbeck.operators.features import FEATURES

#: Bins of the score whose totals are summed before scores are ranked inside them.
BINS = 1024


def split_days(days: list[date], fraction: float) -> tuple[list[date], list[date]]:
    """(train, validation): the last share of the distinct days validates, one at least on each side."""
    if not 0 < fraction < 1:
        raise ValueError("the validation fraction must lie between 0 and 1")
    days = sorted(set(days))
    if len(days) < 2:
        raise ValueError("a time split needs two days at least")
    k = min(max(1, math.ceil(len(days) * fraction)), len(days) - 1)
    return days[:-k], days[-k:]


def with_split(df: DataFrame, fraction: float) -> DataFrame:
    """df with column split, train or validation. Days are few; their list goes to the driver."""
    days = [r[0] for r in df.select("as_of_date").distinct().collect()]
    first = split_days(days, fraction)[1][0]
    return df.withColumn("split", F.when(F.col("as_of_date") >= F.lit(first), "validation").otherwise("train"))


def class_counts(df: DataFrame) -> tuple[int, int]:
    """(negatives, positives); RuntimeError unless both classes are there."""
    row = df.agg(F.count_if(F.col("churn_label") == 0), F.count_if(F.col("churn_label") == 1)).head()
    if not row[0] or not row[1]:
        raise RuntimeError("both classes are needed in each part of the split")
    return row[0], row[1]


@dataclass(frozen=True)
class LogisticModel:
    """Coefficients on standardised features; weights[0] is the intercept."""

    features: list[str]
    means: list[float]
    scales: list[float]
    weights: list[float]

    def logit(self) -> Column:
        out = F.lit(self.weights[0])
        for name, mean, scale, w in zip(self.features, self.means, self.scales, self.weights[1:], strict=True):
            out = out + (F.col(name).cast("double") - F.lit(mean)) / F.lit(scale) * F.lit(w)
        return out

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.logit()))

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> LogisticModel:
        return cls(**json.loads(text))


def fit_logistic(train: DataFrame, features: tuple[str, ...] = FEATURES, c: float = 1.0, rounds: int = 50, tolerance: float = 1e-10) -> LogisticModel:
    """L2-penalised (intercept included) logistic regression with balanced class weights, by
    iteratively reweighted least squares: a round is one aggregation of the gradient and the Hessian,
    and a solve of features + 1 unknowns on the driver. Scaling uses the population deviation of
    the training rows; a constant feature is scaled by 1."""
    negative, positive = class_counts(train)
    total = negative + positive
    stats = train.agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_pop(f).alias(f"s_{f}") for f in features)).head()
    means = [float(stats[f"m_{f}"]) for f in features]
    scales = [float(stats[f"s_{f}"]) or 1.0 for f in features]
    n = len(features) + 1
    weight = F.when(F.col("churn_label") == 1, total / (2.0 * positive)).otherwise(total / (2.0 * negative))
    x = [F.lit(1.0)] + [(F.col(f).cast("double") - F.lit(m)) / F.lit(s) for f, m, s in zip(features, means, scales, strict=True)]
    rows = train.select(*(v.alias(f"x{i}") for i, v in enumerate(x)), weight.alias("w"), F.col("churn_label").cast("double").alias("y")).persist()
    beta = np.zeros(n)
    try:
        for _ in range(rounds):
            now = F.lit(beta)  # an array is data to generated code, so that rounds share it; numbers would be part of it
            z = sum((F.col(f"x{i}") * now[i] for i in range(n)), F.lit(0.0))
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
            scored = rows.withColumns({"r": F.col("w") * (p - F.col("y")), "h": F.col("w") * p * (F.lit(1.0) - p)})
            cells = [F.sum(F.col("r") * F.col(f"x{i}")).alias(f"g{i}") for i in range(n)]
            cells += [F.sum(F.col("h") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(n) for j in range(i, n)]
            got = scored.agg(*cells).head()
            slope = beta + c * np.array([got[f"g{i}"] for i in range(n)])
            curve = np.eye(n) + c * np.array([[got[f"h{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
            step = np.linalg.solve(curve, slope)
            beta = beta - step
            if np.abs(step).max() < tolerance:
                break
    finally:
        rows.unpersist()
    return LogisticModel(list(features), means, scales, [float(b) for b in beta])


def _in_bins(steps: DataFrame) -> DataFrame:
    """steps with column bin, ascending in s. The cuts are quantiles of the distinct scores, so that
    a bin holds its share of them however close together they lie; they are BINS numbers at most."""
    shares = [i / BINS for i in range(1, BINS)]
    cuts = steps.agg(F.percentile_approx("s", shares, 16 * BINS)).head()[0] or []
    splits = [-math.inf, *sorted({0.5, *cuts}), math.inf]
    return Bucketizer(splits=splits, inputCol="s", outputCol="bin", handleInvalid="keep").transform(steps)


def ranking_metrics(scored: DataFrame, score: str = "score", label: str = "churn_label") -> DataFrame:
    """One row: average_precision, roc_auc, brier, over scores in [0, 1]; rows of one score are one step.

    Equal scores are summed first. Running totals need all higher scores: the distinct scores are cut
    into about BINS bins of equal size, whose totals are a small table; ranks are then taken inside bins."""
    steps = scored.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.col(label).cast("long")).alias("tp"), F.count("*").alias("n"),
        F.sum(F.pow(F.col(score) - F.col(label), 2)).alias("sq"),
    )
    steps = _in_bins(steps)
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    totals = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bins = steps.groupBy("bin").agg(F.sum("tp").alias("btp"), F.sum("n").alias("bn")).select(
        "bin", F.coalesce(F.sum("btp").over(above), F.lit(0)).alias("tp_above"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n_above"),
        F.sum("btp").over(totals).alias("positives"), F.sum("bn").over(totals).alias("rows"),
    )
    inside = Window.partitionBy("bin").orderBy(F.desc("s"))
    run = steps.join(F.broadcast(bins), "bin").withColumns(
        {"ctp": F.col("tp_above") + F.sum("tp").over(inside), "cn": F.col("n_above") + F.sum("n").over(inside)}
    )
    fp = F.col("n") - F.col("tp")
    return run.agg(
        F.sum(F.col("tp") / F.col("positives") * F.col("ctp") / F.col("cn")).alias("average_precision"),
        F.sum(fp * (F.col("ctp") - F.col("tp") / 2.0) / F.col("positives") / (F.col("rows") - F.col("positives"))).alias("roc_auc"),
        (F.sum("sq") / F.sum("n")).alias("brier"),
    )
