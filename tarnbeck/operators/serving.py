"""Scoring requests against the latest features: the service's rules as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.functions.expressions import identifier_hash, label_at
from tarnbeck.operators.model import LogisticModel

MOST_CHARS = 128


def score_requests(requests: DataFrame, latest: DataFrame, model: LogisticModel, feature_version: str | None = None) -> DataFrame:
    """requests (customer_id, ...) with status, churn_probability, churn_label, feature_version and
    customer_id_hash. status: 422 for an id that is null, blank or too long, 404 for a customer without
    features, 503 where the features' version isn't the model's, else 200. Ids are stripped of blanks;
    case counts. Only the columns that the model reads are taken from the features."""
    asked = requests.withColumn("customer_id", F.btrim("customer_id", F.lit(" \t\r\n\f\x0b")))
    bad = F.col("customer_id").isNull() | (F.length("customer_id") == 0) | (F.length("customer_id") > MOST_CHARS)
    known = latest.select("customer_id", *model.features, F.col("_feature_version").alias("feature_version"))
    joined = asked.join(known, "customer_id", "left")
    status = F.when(bad, 422).when(F.col("feature_version").isNull(), 404)
    if feature_version is not None:
        status = status.when(F.col("feature_version") != feature_version, 503)
    scored = joined.withColumn("status", status.otherwise(200))
    probability = F.when(F.col("status") == 200, model.probability())
    return scored.select(
        *asked.columns, "status", probability.alias("churn_probability"),
        F.when(F.col("status") == 200, label_at(probability)).alias("churn_label"), "feature_version",
        identifier_hash(F.col("customer_id")).alias("customer_id_hash"),
    )


def lookup(latest: DataFrame, customer_id: str) -> dict | None:
    """The features of one customer; the filter reaches the Parquet scan."""
    row = latest.filter(F.col("customer_id") == customer_id.strip()).head()
    return row.asDict() if row else None
