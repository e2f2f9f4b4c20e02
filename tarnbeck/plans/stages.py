"""The stages from raw files to a trained model: I/O around the operators.

A stage logs started and then completed, skipped or failed; it checks what it made before it
publishes, and writes metadata after. Counts and checks share jobs, and what is checked is what is
published: results that are used twice are persisted."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnbeck.functions import lineage
from tarnbeck.operators import features, labels, model, quality, silver, snapshot
from tarnbeck.sources import files
from tarnbeck.sources.contracts import Contract, struct_of
from tarnbeck.sources.tables import AppendLog, VersionedTable

AUDIT: StructType = struct_of(
    [
        ("dataset", "string"), ("run_id", "string"), ("status", "string"), ("source_fingerprint", "string"), ("source_path", "string"),
        ("source_file_count", "int"), ("row_count", "long"), ("schema_hash", "string"), ("ingest_ts", "timestamp"), ("bronze_path", "string"),
        ("message", "string"),
    ],
    optional=["message"],
)
log = logging.getLogger("tarnbeck")


def now() -> datetime:
    return datetime.now(UTC)


@contextmanager
def _stage(name: str, run_id: str, **fields: Any) -> Iterator[dict]:
    """Log the stage; what is put into the yielded dict goes into its last event."""
    lineage.log_event(log, f"{name}_started", run_id, **fields)
    done: dict[str, Any] = {}
    try:
        yield done
    except Exception as e:
        lineage.log_event(log, f"{name}_failed", run_id, error=repr(e))
        raise
    lineage.log_event(log, f"{name}_{done.pop('status', 'completed')}", run_id, **done)


def bronze_schema(contract: Contract) -> StructType:
    extra = struct_of(
        [
            ("run_id", "string"), ("ingest_ts", "timestamp"), ("ingest_date", "date"), ("source_file", "string"),
            ("source_fingerprint", "string"), ("row_count", "long"), ("schema_hash", "string"),
        ]
    )
    return StructType([*contract.struct().fields, *extra.fields])


def stamp_bronze(raw: DataFrame, contract: Contract, run_id: str, run_ts: datetime, fingerprint: str, rows: int) -> DataFrame:
    at = F.lit(run_ts).cast("timestamp")
    return raw.withColumns(
        {
            "run_id": F.lit(run_id), "ingest_ts": at, "ingest_date": F.to_date(at), "source_file": F.input_file_name(),
            "source_fingerprint": F.lit(fingerprint), "row_count": F.lit(rows).cast("long"), "schema_hash": F.lit(contract.schema_hash),
        }
    )


def ingest(spark: SparkSession, source: str, bronze_path: str, run_id: str, audit_path: str | None = None, dataset: str = "orders") -> str:
    """Append raw Parquet to bronze once: "success", or "skipped_already_ingested" if a batch of the
    same fingerprint is in. The batch is stored under its fingerprint, then audited; a crash between
    the two is mended by running again."""
    contract = Contract.own("bronze_orders")
    audit = AppendLog(spark, audit_path or f"{bronze_path}_audit")
    with _stage("bronze_ingest", run_id, source=source) as done:
        raw = spark.read.parquet(source)
        contract.check_schema(raw.schema)
        paths = files.input_files(raw)
        fingerprint, run_ts = lineage.source_fingerprint(paths), now()
        same = (F.col("dataset") == dataset) & (F.col("source_fingerprint") == fingerprint) & (F.col("status") == "success")
        known = not audit.read(AUDIT).filter(same).isEmpty()
        rows = 0 if known else raw.count()
        if not known:
            stamped = stamp_bronze(raw.select(*contract.names), contract, run_id, run_ts, fingerprint, rows)
            AppendLog(spark, bronze_path).append(stamped, fingerprint, "ingest_date")
        status = "skipped_already_ingested" if known else "success"
        entry = (dataset, run_id, status, fingerprint, source, len(paths), rows, contract.schema_hash, run_ts, bronze_path, None)
        audit.append(spark.createDataFrame([entry], AUDIT), run_id)
        done.update(status="skipped" if known else "completed", row_count=rows, source_fingerprint=fingerprint)
    return status


def read_bronze(spark: SparkSession, bronze_path: str) -> DataFrame:
    return AppendLog(spark, bronze_path).read(bronze_schema(Contract.own("bronze_orders")))


def silver_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, ["order_id"])


def refine(
    spark: SparkSession, bronze_path: str, silver_path: str, run_id: str, contract: Contract | None = None,
    suite: dict | str | None = None, report_path: str | None = None, quarantine_path: str | None = None,
) -> dict[str, Any]:
    """Bronze to silver. A failed critical check raises RuntimeError; report and failed rows are
    written before that, and nothing is published."""
    contract = contract or Contract.own("silver_orders")
    aside = quarantine_path or f"{silver_path}_quarantine/{run_id}"
    with _stage("silver_refine", run_id) as done:
        parts = silver.split_orders(read_bronze(spark, bronze_path), contract.allowed["order_status"])
        files.quarantine(parts.rejects, f"{aside}/preclean_invalid")
        files.quarantine(parts.duplicates, f"{aside}/duplicate_rejects")
        kept = silver.stamp(parts.kept, contract.version, run_id, now()).select(*contract.names).persist()
        try:
            found = quality.run_suite(kept, suite or own_suite())
            facts = {"dataset": "orders", "layer": "silver", "version": contract.version}
            files.write_json(report_path or f"{silver_path}_dq_reports/{run_id}.json", facts | found.metrics)
            if not found.passed:
                files.write_failed(found.failed_frames, f"{aside}/dq_failed")
                raise RuntimeError(f"silver quality gate: {[c['name'] for c in found.metrics['checks'] if not c['passed']]}")
            silver_table(spark, silver_path).merge(kept, silver.newest)
        finally:
            kept.unpersist()
        done.update(row_count=found.metrics["row_count"])
    return found.metrics


def own_suite() -> dict:
    from importlib import resources

    import yaml

    return yaml.safe_load(resources.files("tarnbeck").joinpath("contracts/silver_orders_checks.yml").read_text("utf-8"))


def gold_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, ["customer_id", "as_of_date"], partition="as_of_date")


def build_features(
    spark: SparkSession, silver_path: str, gold_path: str, as_of: str, run_id: str, contract: Contract | None = None, metadata_path: str | None = None
) -> dict[str, Any]:
    contract = contract or Contract.own("gold_features")
    with _stage("gold_features", run_id, as_of_date=as_of) as done:
        made = features.feature_snapshot(silver_table(spark, silver_path).read(), as_of, contract.version, run_id, now()).persist()
        try:
            metrics = quality.assert_contract(made, contract)
            rows = made.count()
            gold_table(spark, gold_path).merge(made)
        finally:
            made.unpersist()
        facts = {
            "snapshot_id": lineage.snapshot_id(as_of, contract.version), "as_of_date": as_of, "feature_version": contract.version,
            "gold_run_id": run_id, "row_count": rows, "quality_metrics": metrics,
        }
        files.write_json(metadata_path, facts)
        done.update(row_count=rows)
    return facts


def build_labels(spark: SparkSession, silver_path: str, labels_path: str, as_of: str, run_id: str, horizon: int = 60, metadata_path: str | None = None) -> dict[str, Any]:
    contract = Contract.own("churn_labels")
    with _stage("labels", run_id, as_of_date=as_of) as done:
        orders = silver_table(spark, silver_path).read()
        end = labels.dataset_end(orders)
        labels.check_observable(end, as_of, horizon)
        made = labels.stamp(labels.labels_at(orders, as_of, horizon), horizon, run_id, now()).persist()
        try:
            metrics = quality.assert_contract(made, contract)
            counts = labels.balance(made).head().asDict()
            gold_table(spark, labels_path).merge(made)
        finally:
            made.unpersist()
        facts = {
            "as_of_date": as_of, "dataset_end_date": end, "label_horizon_days": horizon, "label_version": lineage.label_version(horizon),
            "labels_run_id": run_id, "quality_metrics": metrics,
        } | counts
        files.write_json(metadata_path, facts)
        done.update(counts)
    return facts


def build_training_snapshot(
    spark: SparkSession, gold_path: str, labels_path: str, snapshot_path: str, run_id: str, metadata_path: str | None = None,
    first: str | None = None, last: str | None = None,
) -> dict[str, Any]:
    contract = Contract.own("training_snapshot")
    with _stage("training_snapshot", run_id) as done:
        rows = snapshot.training_rows(gold_table(spark, gold_path).read(), gold_table(spark, labels_path).read(), first, last).persist()
        try:
            limits = snapshot.bounds(rows).head()
            if not limits["row_count"]:
                raise RuntimeError("no features have a label in these dates")
            metrics = quality.assert_contract(rows, contract)
            version, label, horizon = (quality.single_value(rows, c) for c in ("_feature_version", "_label_version", "_label_horizon_days"))
            payload = lineage.schema_digest(rows.schema)
            data_id = lineage.data_snapshot_id(limits["as_of_date_min"], limits["as_of_date_max"], version, label, horizon, payload)
            stamped = rows.withColumns(
                {"_data_snapshot_id": F.lit(data_id), "_training_run_id": F.lit(run_id), "_training_ts": F.lit(now()).cast("timestamp")}
            )
            VersionedTable(spark, snapshot_path, [*snapshot.KEY, "_data_snapshot_id"], partition="_data_snapshot_id").merge(stamped)
        finally:
            rows.unpersist()
        facts = {
            "data_snapshot_id": data_id, "row_count": limits["row_count"], "as_of_date_min": limits["as_of_date_min"],
            "as_of_date_max": limits["as_of_date_max"], "feature_version": version, "label_version": label,
            "payload_schema_hash": payload, "quality_metrics": metrics,
        }
        files.write_json(metadata_path, facts)
        done.update(row_count=facts["row_count"], data_snapshot_id=data_id)
    return facts


def train(
    spark: SparkSession, snapshot_path: str, model_path: str, meta_path: str, run_id: str, name: str = "churn", fraction: float = 0.2,
    seed: int = 42, contract: Contract | None = None, summary_path: str | None = None, approved_path: str | None = None,
    schema_info_path: str | None = None, data_snapshot: str | None = None, run_log_path: str | None = None,
    tracking_uri: str | None = None, experiment: str = "churn",
) -> dict[str, Any]:
    """Fit on the earlier days, measure on the later ones, and write the model with its lineage. A
    snapshot table with several data snapshots needs to be told which. seed only enters the version: the
    fit has no chance in it."""
    contract = contract or Contract.own("gold_features")
    with _stage("train", run_id) as done:
        table = VersionedTable(spark, snapshot_path, [*snapshot.KEY, "_data_snapshot_id"], partition="_data_snapshot_id")
        rows = model.with_split(table.read([data_snapshot] if data_snapshot else None), fraction).persist()
        try:
            data_id, version, label = (quality.single_value(rows, c) for c in ("_data_snapshot_id", "_feature_version", "_label_version"))
            if version != contract.version:
                raise RuntimeError(f"features have version {version}, the contract {contract.version}")
            sides = {s: rows.filter(F.col("split") == s) for s in ("train", "validation")}
            counts = {s: model.class_counts(df) for s, df in sides.items()}
            days = {r["split"]: r for r in rows.groupBy("split").agg(F.min("as_of_date").alias("lo"), F.max("as_of_date").alias("hi")).collect()}
            fitted = model.fit_logistic(sides["train"])
            found = model.ranking_metrics(sides["validation"].withColumn("score", fitted.probability())).head()
            payload = lineage.schema_digest(rows.drop("split", "_data_snapshot_id", "_training_run_id", "_training_ts").schema)
        finally:
            rows.unpersist()
        # Names of measures that dashboards match on.
        metrics = {"pr_auc": found["average_precision"], "roc_auc": found["roc_auc"], "brier_score": found["brier"]}
        model_version = lineage.model_version(name, data_id, version, label, fraction, seed)
        meta = {
            "model_name": name, "model_version": model_version, "approved_model_version": model_version, "algorithm": "logistic_regression",
            "feature_columns": list(features.FEATURES), "feature_version": version, "feature_contract_hash": contract.version, "label_version": label,
            "data_snapshot_id": data_id, "training_snapshot_path": snapshot_path, "training_snapshot_schema_hash": payload, "validation_fraction": fraction, "random_state": seed,
            "code_version": lineage.git_revision(), "run_id": run_id, "metrics": metrics,
        }
        for side, (negative, positive) in counts.items():
            meta |= {
                f"{side}_row_count": negative + positive, f"{side}_positive_rate": positive / (negative + positive),
                f"{side}_as_of_date_min": days[side]["lo"], f"{side}_as_of_date_max": days[side]["hi"],
            }
        files.write_text(model_path, fitted.to_json())
        files.write_json(meta_path, meta)
        files.write_json(approved_path, {k: meta[k] for k in ("approved_model_version", "model_name", "data_snapshot_id", "feature_version", "label_version")})
        files.write_json(schema_info_path, {k: meta[k] for k in ("feature_columns", "feature_version", "feature_contract_hash", "label_version", "data_snapshot_id")})
        outputs = [model_path, meta_path, summary_path, approved_path, schema_info_path]
        log_run(run_log_path, meta, metrics, [p for p in outputs if p], tracking_uri, experiment)
        lines = [f"# {name} {model_version}", "", *(f"- {k}: {v}" for k, v in (metrics | {k: meta[k] for k in sorted(meta) if "row_count" in k or "rate" in k}).items())]
        files.write_text(summary_path, "\n".join(lines) + "\n")
        done.update(metrics, model_version=model_version)
    return meta


#: What a run log says of a run: tags name what was made, params what it was made from.
_MADE = ("model_name", "algorithm", "model_version", "approved_model_version")
_BY = ("model_name", "algorithm", "validation_fraction", "random_state", "train_row_count", "validation_row_count", "feature_contract_hash")
_LINEAGE = ("data_snapshot_id", "feature_version", "label_version", "training_snapshot_schema_hash", "code_version")


def log_run(path: str | None, meta: dict, metrics: dict, artifacts: list[str], tracking_uri: str | None = None, experiment: str = "churn") -> dict:
    """One run as JSON: 9 tags, 12 parameters, 5 measures and the files made. With a tracking URI it goes
    to that server as well, if its client can be imported here."""
    known = meta | {"code_version": meta["code_version"] or "unknown"}
    rates = {k: meta[k] for k in ("train_positive_rate", "validation_positive_rate")}
    run = {
        "run_name": f"{meta['model_name']}-{meta['data_snapshot_id']}", "experiment": experiment, "metrics": metrics | rates, "artifacts": artifacts,
        "tags": {k: known[k] for k in (*_MADE, *_LINEAGE)}, "params": {k: known[k] for k in (*_BY, *_LINEAGE)},
    }
    files.write_json(path, run)
    if tracking_uri:
        try:
            import mlflow
        except ImportError as e:
            raise RuntimeError("a tracking URI needs the mlflow client, which isn't installed") from e
        mlflow.set_tracking_uri(tracking_uri)
        mlflow.set_experiment(experiment)
        with mlflow.start_run(run_name=run["run_name"]):
            mlflow.set_tags(run["tags"])
            mlflow.log_params(run["params"])
            mlflow.log_metrics(run["metrics"])
            for artifact in artifacts:
                mlflow.log_artifact(artifact, artifact_path="artifacts")
    return run


def export_latest(spark: SparkSession, gold_path: str, latest_path: str, run_id: str, manifest_path: str | None = None) -> dict[str, Any]:
    """Each customer's latest features as plain Parquet, checked against the contract but for who
    made them when."""
    contract = Contract.own("gold_features")
    with _stage("latest_features", run_id) as done:
        latest = snapshot.latest_features(gold_table(spark, gold_path).read().select(*contract.names)).persist()
        try:
            metrics = quality.assert_contract(latest, Contract.parse(_latest_spec(contract)), without=("_gold_run_id", "_gold_ts"))
            facts = snapshot.bounds(latest).head().asDict()
            latest.write.mode("overwrite").parquet(latest_path)
        finally:
            latest.unpersist()
        manifest = {
            "latest_features_path": latest_path, "row_count": facts["row_count"], "as_of_date_max": facts["as_of_date_max"],
            "feature_versions": facts["feature_versions"], "quality_metrics": metrics, "run_id": run_id,
        }
        files.write_json(manifest_path, manifest)
        done.update(row_count=facts["row_count"])
    return manifest


def _latest_spec(contract: Contract) -> dict:
    return {
        "name": "serving.latest_features", "version": 1, "key": ["customer_id"], "columns": contract.columns,
        "least": contract.least, "ordered": contract.ordered,
    }
