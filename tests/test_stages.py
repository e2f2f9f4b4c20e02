import json
import os
import re
import threading
import urllib.error
import urllib.request

import pytest

from tarnbeck.plans import cli, service, stages
from tarnbeck.sources.files import read_json
from tarnbeck.sources.tables import VersionedTable

RAW = [
    ("A1", "CUST_0001", "2025-01-10 10:00:00"), ("B1", "CUST_0002", "2025-01-20 12:00:00"), ("C1", "CUST_0003", "2025-02-15 09:00:00"),
    ("A2", "CUST_0001", "2025-03-10 11:00:00"), ("C2", "CUST_0003", "2025-04-10 15:00:00"), ("A3", "CUST_0001", "2025-05-10 08:30:00"),
    ("Z1", "CUST_9999", "2025-06-15 00:00:00"),
]
DAYS = ["2025-01-31", "2025-02-28", "2025-03-31"]


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """All stages, through the command line, over seven orders and three days."""
    base = str(tmp_path_factory.mktemp("e2e"))
    schema = "order_id string, customer_id string, order_status string, order_purchase_timestamp string, " + ", ".join(
        f"{c} string" for c in ("order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date")
    )
    rows = [(o, c, "delivered", t, None, None, None, None) for o, c, t in RAW]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/raw")

    def run(stage, **flags):
        assert cli.main([stage, *(x for k, v in flags.items() for x in (f"--{k}", str(v)))]) == 0

    for run_id in ("b1", "b2"):
        run("bronze", input=f"{base}/raw", bronze_path=f"{base}/bronze", run_id=run_id)
    run("silver", bronze_path=f"{base}/bronze", silver_path=f"{base}/silver", run_id="s1")
    for d in DAYS:
        run("gold", silver_path=f"{base}/silver", gold_path=f"{base}/gold", as_of_date=d, run_id="g1", snapshot_metadata_path=f"{base}/meta/g.json")
        run("labels", silver_path=f"{base}/silver", labels_path=f"{base}/labels", as_of_date=d, run_id="l1", metadata_path=f"{base}/meta/l.json")
    run("snapshot", gold_path=f"{base}/gold", labels_path=f"{base}/labels", training_snapshot_path=f"{base}/snap", run_id="t1", metadata_path=f"{base}/meta/t.json")
    run(
        "train", training_snapshot_path=f"{base}/snap", out_model_path=f"{base}/model.json", out_model_meta=f"{base}/meta/m.json", run_id="m1",
        validation_fraction=0.34, evaluation_summary_path=f"{base}/summary.md", approved_model_version_path=f"{base}/approved.json",
        feature_schema_info_path=f"{base}/info.json", run_log_path=f"{base}/run.json",
    )
    run("latest", gold_path=f"{base}/gold", latest_features_path=f"{base}/latest", run_id="x1", manifest_path=f"{base}/meta/x.json")
    return base


def test_ingest_is_idempotent(spark, base):
    audit = stages.AppendLog(spark, f"{base}/bronze_audit").read(stages.AUDIT).orderBy("run_id").collect()
    assert [(r.status, r.row_count) for r in audit] == [("success", 7), ("skipped_already_ingested", 0)]
    assert stages.read_bronze(spark, f"{base}/bronze").count() == 7


def test_published_tables(spark, base):
    gold = stages.gold_table(spark, f"{base}/gold").read()
    assert gold.count() == 8
    row = gold.filter("customer_id = 'cust_0001' and as_of_date = '2025-03-31'").head()
    assert (row.recency_days, row.orders_30d, row.orders_90d, row.lifetime_orders, row.customer_tenure_days, row.avg_days_between_orders) == (21, 1, 2, 2, 80, 59.0)
    assert read_json(f"{base}/meta/t.json")["row_count"] == 8
    assert read_json(f"{base}/meta/l.json")["positive_rows"] + read_json(f"{base}/meta/l.json")["negative_rows"] == 3
    meta = read_json(f"{base}/meta/m.json")
    assert (meta["train_as_of_date_max"], meta["validation_as_of_date_min"]) == ("2025-01-31", "2025-02-28")
    assert 0 <= meta["metrics"]["roc_auc"] <= 1
    assert read_json(f"{base}/meta/x.json")["row_count"] == 3 == spark.read.parquet(f"{base}/latest").count()
    assert all(os.path.exists(f"{base}/{f}") for f in ("summary.md", "approved.json", "info.json", "run.json"))


def test_run_log(base):
    run = read_json(f"{base}/run.json")
    assert (len(run["tags"]), len(run["params"]), len(run["metrics"]), len(run["artifacts"])) == (9, 12, 5, 5)
    assert run["metrics"].keys() >= {"pr_auc", "roc_auc", "brier_score"} and run["tags"]["training_snapshot_schema_hash"] == read_json(f"{base}/meta/t.json")["payload_schema_hash"]


def test_reruns_change_nothing(spark, base):
    before = {r.customer_id: r.recency_days for r in stages.gold_table(spark, f"{base}/gold").read(["2025-01-31"]).collect()}
    stages.build_features(spark, f"{base}/silver", f"{base}/gold", "2025-01-31", "again")
    again = stages.gold_table(spark, f"{base}/gold").read(["2025-01-31"])
    assert {r.customer_id: r.recency_days for r in again.collect()} == before


def test_unobservable_labels_raise(spark, base):
    with pytest.raises(RuntimeError):
        stages.build_labels(spark, f"{base}/silver", f"{base}/labels", "2025-06-01", "late")


def test_quality_gate_blocks_and_reports_first(spark, base, tmp_path):
    suite = {"checks": [{"name": "none", "type": "in_set", "column": "order_status", "allowed": ["shipped"], "severity": "critical"}]}
    with pytest.raises(RuntimeError):
        stages.refine(spark, f"{base}/bronze", f"{tmp_path}/silver", "bad", suite=suite)
    assert read_json(f"{tmp_path}/silver_dq_reports/bad.json")["checks"][0]["bad_rows"] == 7
    assert spark.read.parquet(f"{tmp_path}/silver_quarantine/bad/dq_failed/none").count() == 7
    assert not VersionedTable(spark, f"{tmp_path}/silver", ["order_id"]).exists()


def test_wrong_raw_schema_is_refused(spark, tmp_path):
    spark.createDataFrame([("o", "c")], "order_id string, customer_id string").write.parquet(f"{tmp_path}/raw")
    with pytest.raises(ValueError):
        stages.ingest(spark, f"{tmp_path}/raw", f"{tmp_path}/bronze", "r")


def test_service(base, caplog):
    caplog.set_level("INFO")
    stores = service.Stores(f"{base}/latest", f"{base}/model.json", f"{base}/meta/m.json", f"{base}/approved.json")
    http = service.server(stores, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def call(path, body=None, key="dev-api-key"):
        asked = urllib.request.Request(f"http://127.0.0.1:{http.server_port}{path}", data=None if body is None else json.dumps(body).encode(), headers={"X-API-Key": key})
        try:
            with urllib.request.urlopen(asked) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("/health") == (200, {"status": "ok"})
        assert call("/ready")[0] == 200
        status, got = call("/v1/churn/predict", {"customer_id": " cust_0001 "})
        assert status == 200 and 0 <= got["churn_probability"] <= 1 and got["churn_label"] in (0, 1) and got["request_id"]
        assert call("/v1/churn/predict", {"customer_id": "cust_0001"}, key="wrong")[0] == 401
        assert call("/v1/churn/predict", {"customer_id": "   "})[1]["detail"] == "Invalid request payload."
        assert [call("/v1/churn/predict", b)[0] for b in ({}, [], {"customer_id": 3}, {"customer_id": "x" * 129})] == [422] * 4
        assert call("/v1/churn/predict", {"customer_id": "CUST_0001"})[0] == 404
        assert call("/metrics")[1]["predictions_total"] == 1
        assert call("/version")[1]["model_version"] == read_json(f"{base}/meta/m.json")["model_version"]
        assert call("/no")[0] == 404
        (scored,) = (json.loads(r.message) for r in caplog.records if "prediction_scored" in r.message)
        assert re.fullmatch(r"[0-9a-f]{12}", scored["customer_id_hash"]) and "cust_0001" not in json.dumps(scored)
    finally:
        http.shutdown()


def test_service_is_not_ready_without_its_files(tmp_path, base):
    stores = service.Stores(str(tmp_path / "no"), str(tmp_path / "no"), str(tmp_path / "no"))
    assert service.respond(stores, "GET", "/ready", {}, b"", "r")[0] == 503
    key = {"X-API-Key": "dev-api-key"}
    assert service.respond(stores, "POST", "/v1/churn/predict", key, b'{"customer_id": "a"}', "r")[0] == 503
    other = tmp_path / "approved.json"
    other.write_text('{"approved_model_version": "other"}')
    wrong = service.Stores(f"{base}/latest", f"{base}/model.json", f"{base}/meta/m.json", str(other))
    assert [service.respond(wrong, "GET", "/ready", {}, b"", "r")[0] for _ in range(2)] == [503, 503]
