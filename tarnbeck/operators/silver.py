"""Bronze orders to silver: normalise, set rejects apart, keep the newest row of each order."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbeck.functions.expressions import order_status, plain, timestamp_or_null

#: Silver's name of each lineage column of bronze.
LINEAGE = {
    "run_id": "_bronze_run_id", "ingest_ts": "_bronze_ingest_ts", "source_file": "_bronze_source_file",
    "source_fingerprint": "_bronze_source_fingerprint", "schema_hash": "_bronze_schema_hash",
}
NEEDED = ("order_id", "customer_id", "order_purchase_ts", "order_status")


class SilverParts(NamedTuple):
    kept: DataFrame
    rejects: DataFrame
    duplicates: DataFrame


def normalise(bronze: DataFrame) -> DataFrame:
    return bronze.select(
        plain(F.col("order_id")).alias("order_id"),
        plain(F.col("customer_id")).alias("customer_id"),
        timestamp_or_null(F.col("order_purchase_timestamp")).alias("order_purchase_ts"),
        order_status(F.col("order_status")).alias("order_status"),
        *(F.col(old).alias(new) for old, new in LINEAGE.items()),
    )


def _newest_first(rows: DataFrame) -> DataFrame:
    """rows with __place, 1 for the newest of each order: by purchase, ingest, file, run, each
    descending with nulls last, and by what else tells rows apart."""
    order = [
        F.col(c).desc_nulls_last()
        for c in ("order_purchase_ts", "_bronze_ingest_ts", "_bronze_source_file", "_bronze_run_id", "customer_id", "order_status",
                  "_bronze_source_fingerprint", "_bronze_schema_hash", *(x for x in ("_silver_ts", "_silver_run_id") if x in rows.columns))
    ]
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy("order_id").orderBy(*order)))


def newest(rows: DataFrame) -> DataFrame:
    """The newest row of each order, of all that was ever seen of it."""
    return _newest_first(rows).filter("__place = 1").drop("__place")


def split_orders(bronze: DataFrame, allowed: list[str]) -> SilverParts:
    """Every row of bronze lands in one part. rejects have a null among the needed columns or a status
    that isn't allowed. Of the others, the newest row of each order is kept. Rejects are set
    apart first, so one never hides an older row that is valid."""
    rows = normalise(bronze)
    valid = F.col("order_status").isin(allowed)
    for name in NEEDED:
        valid = valid & F.col(name).isNotNull()
    valid = F.coalesce(valid, F.lit(False))
    ranked = _newest_first(rows.filter(valid))
    return SilverParts(
        ranked.filter("__place = 1").drop("__place"), rows.filter(~valid), ranked.filter("__place > 1").drop("__place")
    )


def stamp(kept: DataFrame, schema_version: str, run_id: str, run_ts: datetime) -> DataFrame:
    return kept.withColumns(
        {"_schema_version": F.lit(schema_version), "_silver_run_id": F.lit(run_id), "_silver_ts": F.lit(run_ts).cast("timestamp")}
    )
