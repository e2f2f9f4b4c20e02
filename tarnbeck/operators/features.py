"""Point-in-time customer features: what was known of a customer at the end of a day."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbeck.functions.expressions import day, in_trailing_days
from tarnbeck.functions.lineage import snapshot_id

FEATURES = ("recency_days", "orders_30d", "orders_90d", "lifetime_orders", "customer_tenure_days", "avg_days_between_orders")


def order_gaps(orders: DataFrame) -> DataFrame:
    """orders with order_day and gap_days, the days since the customer's order before (null for the
    first). Orders are ordered by time and id; a gap counts days of the calendar, not hours."""
    before = F.lag("order_purchase_ts").over(Window.partitionBy("customer_id").orderBy("order_purchase_ts", "order_id"))
    slim = orders.select("customer_id", "order_id", "order_purchase_ts")
    return slim.withColumns({"order_day": F.to_date("order_purchase_ts"), "gap_days": F.datediff(F.to_date("order_purchase_ts"), F.to_date(before))})


def _measures(as_of: Column) -> list[Column]:
    order, on = F.col("order_id"), F.col("order_day")
    return [
        F.datediff(F.max(as_of), F.max(on)).alias("recency_days"),
        F.count_distinct(F.when(in_trailing_days(on, as_of, 30), order)).alias("orders_30d"),
        F.count_distinct(F.when(in_trailing_days(on, as_of, 90), order)).alias("orders_90d"),
        F.count_distinct(order).alias("lifetime_orders"),
        F.datediff(F.max(as_of), F.min(on)).alias("customer_tenure_days"),
        F.coalesce(F.avg("gap_days").cast("double"), F.lit(0.0)).alias("avg_days_between_orders"),
    ]


def features_at(orders: DataFrame, as_of: date | str) -> DataFrame:
    """(customer_id, as_of_date, features) of customers with an order up to as_of. Later orders are
    filtered before anything else, at the scan if the table is Parquet. One window and one
    aggregation, both by customer, so orders are shuffled once."""
    known = orders.filter(F.to_date("order_purchase_ts") <= day(as_of))
    found = order_gaps(known).groupBy("customer_id").agg(*_measures(day(as_of)))
    return found.select("customer_id", day(as_of).alias("as_of_date"), *FEATURES)


def features_over(orders: DataFrame, days: Sequence[date | str]) -> DataFrame:
    """The same for several days at once: a gap depends on earlier orders only, so it is computed
    once; then each order is listed under the days that know it, a list no longer than `days`."""
    listed = F.array(*(day(d) for d in sorted({str(d) for d in days})))
    last = day(max(str(d) for d in days))
    known = order_gaps(orders.filter(F.to_date("order_purchase_ts") <= last))
    under = known.withColumn("as_of_date", F.explode(F.filter(listed, lambda d: d >= F.col("order_day"))))
    found = under.groupBy("customer_id", "as_of_date").agg(*_measures(F.col("as_of_date")))
    return found.select("customer_id", "as_of_date", *FEATURES)


def stamp(features: DataFrame, feature_version: str, run_id: str, run_ts: datetime, snapshot: str | None = None) -> DataFrame:
    """Add lineage; the snapshot id follows each row's day unless one is given."""
    per_day = F.substring(F.sha2(F.concat_ws("|", F.col("as_of_date").cast("string"), F.lit(feature_version)), 256), 1, 16)
    return features.withColumns(
        {
            "_snapshot_id": F.lit(snapshot) if snapshot else per_day, "_feature_version": F.lit(feature_version),
            "_gold_run_id": F.lit(run_id), "_gold_ts": F.lit(run_ts).cast("timestamp"),
        }
    )


def feature_snapshot(orders: DataFrame, as_of: date | str, feature_version: str, run_id: str, run_ts: datetime) -> DataFrame:
    return stamp(features_at(orders, as_of), feature_version, run_id, run_ts, snapshot_id(as_of, feature_version))
