"""Training snapshots, and the latest features of each customer."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.operators.features import FEATURES

KEY = ["customer_id", "as_of_date"]


def within(df: DataFrame, first: date | str | None = None, last: date | str | None = None) -> DataFrame:
    """Rows from first to last as_of_date, both included; an open end is no limit."""
    if first:
        df = df.filter(F.col("as_of_date") >= F.to_date(F.lit(str(first))))
    if last:
        df = df.filter(F.col("as_of_date") <= F.to_date(F.lit(str(last))))
    return df


def training_rows(gold: DataFrame, labels: DataFrame, first: date | str | None = None, last: date | str | None = None) -> DataFrame:
    """Features with the label of the same customer and day; what has no partner is left out. Both
    sides are limited to the dates before they meet."""
    g, l = within(gold, first, last).alias("g"), within(labels, first, last).alias("l")
    return g.join(l, KEY).select(
        *KEY, *(F.col(f"g.{c}") for c in FEATURES), F.col("l.churn_label"), F.col("g._snapshot_id").alias("_feature_snapshot_id"),
        F.col("g._feature_version"), F.col("l._label_version"), F.col("l._label_horizon_days"),
    )


def bounds(df: DataFrame) -> DataFrame:
    """One row: row_count, first and last as_of_date, and the sorted feature versions."""
    return df.agg(
        F.count("*").alias("row_count"), F.min("as_of_date").alias("as_of_date_min"), F.max("as_of_date").alias("as_of_date_max"),
        F.sort_array(F.collect_set("_feature_version")).alias("feature_versions"),
    )


def latest_features(gold: DataFrame) -> DataFrame:
    """Each customer's last row: by day, then time of the run, then snapshot id, nulls last."""
    newest = F.struct("as_of_date", "_gold_ts", "_snapshot_id", "_gold_run_id")  # a null field comes before all values
    found = gold.groupBy("customer_id").agg(F.max_by(F.struct(*gold.columns), newest).alias("row"))
    return found.select("row.*")
