"""Churn labels: has a customer known at as_of no valid order in the days after?"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.functions.expressions import day, in_days_after
from tarnbeck.functions.lineage import VOID_STATUSES, label_version


def dataset_end(orders: DataFrame) -> date:
    end = orders.agg(F.max(F.to_date("order_purchase_ts"))).head()[0]
    if end is None:
        raise ValueError("silver orders are empty")
    return end


def check_observable(end: date, as_of: date | str, horizon: int) -> None:
    """RuntimeError if the horizon of as_of ends after the data do; ending with them is enough."""
    if date.fromisoformat(str(as_of)) + timedelta(days=horizon) > end:
        raise RuntimeError(f"labels at {as_of} need orders of {horizon} days after; the data end on {end}")


def labels_at(orders: DataFrame, as_of: date | str, horizon: int = 60) -> DataFrame:
    """(customer_id, as_of_date, churn_label) of customers with an order up to as_of, whatever its
    status. One aggregation by customer tells both who is known and who comes back."""
    on = F.to_date("order_purchase_ts")
    back = in_days_after(on, day(as_of), horizon) & ~F.col("order_status").isin(*VOID_STATUSES)
    seen = (
        orders.filter(on <= F.date_add(day(as_of), horizon))
        .groupBy("customer_id")
        .agg(F.bool_or(on <= day(as_of)).alias("known"), F.bool_or(F.coalesce(back, F.lit(False))).alias("back"))
    )
    label = F.when(F.col("back"), 0).otherwise(1)
    return seen.filter("known").select("customer_id", day(as_of).alias("as_of_date"), label.alias("churn_label"))


def labels_over(orders: DataFrame, days: Sequence[date | str], horizon: int = 60) -> DataFrame:
    """The same for several days in one aggregation: each order is listed under the days that it
    matters to."""
    on = F.to_date("order_purchase_ts")
    listed = F.array(*(day(d) for d in sorted({str(d) for d in days})))
    under = orders.select("customer_id", "order_status", on.alias("on")).withColumn(
        "as_of_date", F.explode(F.filter(listed, lambda d: F.date_add(d, horizon) >= F.col("on")))
    )
    back = in_days_after(F.col("on"), F.col("as_of_date"), horizon) & ~F.col("order_status").isin(*VOID_STATUSES)
    seen = under.groupBy("customer_id", "as_of_date").agg(
        F.bool_or(F.col("on") <= F.col("as_of_date")).alias("known"), F.bool_or(F.coalesce(back, F.lit(False))).alias("back")
    )
    return seen.filter("known").select("customer_id", "as_of_date", F.when(F.col("back"), 0).otherwise(1).alias("churn_label"))


def stamp(labels: DataFrame, horizon: int, run_id: str, run_ts: datetime) -> DataFrame:
    return labels.withColumns(
        {
            "_label_horizon_days": F.lit(horizon), "_label_version": F.lit(label_version(horizon)),
            "_labels_run_id": F.lit(run_id), "_labels_ts": F.lit(run_ts).cast("timestamp"),
        }
    )


def balance(labels: DataFrame) -> DataFrame:
    """One row: row_count, positive_rows, negative_rows."""
    return labels.agg(
        F.count("*").alias("row_count"), F.count_if(F.col("churn_label") == 1).alias("positive_rows"),
        F.count_if(F.col("churn_label") == 0).alias("negative_rows"),
    )
