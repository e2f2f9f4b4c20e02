"""The test tables' `orders` in the shapes that the stages read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The raw status of each status code of the test data.
RAW_STATUS = {"F": "delivered", "O": "shipment_pending", "P": "cancelled"}
LATER = ("order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date")


def _status():
    out = F.when(F.lit(False), F.lit(""))
    for code, name in RAW_STATUS.items():
        out = out.when(F.col("o_orderstatus") == code, name)
    return out


def clean_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, customer_id, order_purchase_ts, order_status), statuses canonical."""
    status = F.when(_status() == "cancelled", "canceled").when(_status() == "shipment_pending", "processing").otherwise(_status())
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderdate").cast("timestamp").alias("order_purchase_ts"), status.alias("order_status"),
    )


def raw_orders(orders: DataFrame) -> DataFrame:
    """The eight raw text columns, one row for each order."""
    return orders.select(
        F.concat(F.lit("O-"), F.col("o_orderkey")).alias("order_id"), F.concat(F.lit("C-"), F.col("o_custkey")).alias("customer_id"),
        _status().alias("order_status"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("order_purchase_timestamp"),
        *(F.lit(None).cast("string").alias(c) for c in LATER),
    )


def dirty_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze rows with every defect that silver handles, by the order's key: every tenth lands again
    a day later, and others lack a customer, a valid time or a known status, or are padded."""
    k = F.col("o_orderkey")
    lands = F.when(k % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("land", F.explode(lands))
    at = F.date_format(F.col("o_orderdate") + F.make_interval(days=F.col("land")), "yyyy-MM-dd HH:mm:ss")
    order, customer = F.concat(F.lit("O-"), k), F.concat(F.lit("C-"), F.col("o_custkey"))
    return rows.select(
        F.when(k % 7 == 0, F.concat(F.lit("  "), order, F.lit(" "))).otherwise(order).alias("order_id"),
        F.when(k % 97 != 0, customer).alias("customer_id"),
        F.when(k % 83 == 0, "lost").when(F.col("land") == 1, "Shipped").otherwise(_status()).alias("order_status"),
        F.when(k % 89 == 0, "not a time").otherwise(at).alias("order_purchase_timestamp"),
        F.concat(F.lit("run-"), F.col("land")).alias("run_id"),
        F.timestamp_seconds(F.col("land") * 86400).alias("ingest_ts"),
        F.lit("orders.parquet").alias("source_file"), F.lit("f0").alias("source_fingerprint"), F.lit("s0").alias("schema_hash"),
    )
