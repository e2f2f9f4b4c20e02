from datetime import datetime

from tarnbeck.operators import silver
from tarnbeck.sources.contracts import Contract

ALLOWED = Contract.own("silver_orders").allowed["order_status"]
COLUMNS = (
    "order_id string, customer_id string, order_purchase_timestamp string, order_status string, run_id string, ingest_ts timestamp, "
    "source_file string, source_fingerprint string, schema_hash string"
)


def rows(*given):
    return [(o, c, t, s, run, datetime(2025, 1, day), "f", "fp", "h") for o, c, t, s, run, day in given]


def split(spark, *given):
    return silver.split_orders(spark.createDataFrame(rows(*given), COLUMNS), ALLOWED)


def test_newest_valid_row_wins(spark):
    parts = split(
        spark,
        ("ORD-1", "CUST-1", "2025-01-01 10:00:00", "created", "run-1", 1),
        (" ord-1 ", "cust-1", "2025-01-02 10:00:00", "SHIPMENT_PENDING", "run-2", 2),
        ("ord-2", None, "2025-01-02 10:00:00", "delivered", "run-2", 2),
    )
    assert [(r.order_id, r.customer_id, r.order_status, r._bronze_run_id) for r in parts.kept.collect()] == [("ord-1", "cust-1", "processing", "run-2")]
    assert parts.rejects.count() == 1 and parts.duplicates.count() == 1


def test_an_invalid_newer_row_hides_nothing(spark):
    parts = split(
        spark,
        ("o", "c", "2025-01-01 10:00:00", "created", "run-1", 1),
        ("o", "c", "2025-01-09 10:00:00", "no such status", "run-2", 2),
    )
    assert [r._bronze_run_id for r in parts.kept.collect()] == ["run-1"]


def test_every_row_lands_in_one_part(spark):
    bad_times = ["garbage", "", "2025-02-30 00:00:00", "2025-01-01", "2025-1-1 1:00:00", None]
    given = [(f"o{i}", "c", t, "created", "r", 1) for i, t in enumerate(bad_times)]
    given += [("", "", "2025-01-01 00:00:00", " Cancelled ", "r", 1), (None, "c", "2025-01-01 00:00:00", None, "r", 1)]
    parts = split(spark, *given)
    assert parts.rejects.count() == len(bad_times) + 1
    assert [(r.order_id, r.order_status) for r in parts.kept.collect()] == [("", "canceled")]
    assert sum(p.count() for p in parts) == len(given)


def test_empty(spark):
    assert [p.count() for p in silver.split_orders(spark.createDataFrame([], COLUMNS), ALLOWED)] == [0, 0, 0]
