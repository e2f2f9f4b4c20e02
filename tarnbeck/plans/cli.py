"""python -m tarnbeck.plans.cli STAGE ...: one stage, one session, one process."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from tarnbeck.plans import stages
from tarnbeck.session import session
from tarnbeck.sources.contracts import Contract


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tarnbeck")
    sub = top.add_subparsers(dest="stage", required=True)

    def stage(name: str, *needed: str, **optional) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for flag in (*needed, "run_id"):
            p.add_argument(f"--{flag}", required=True)
        for flag, default in optional.items():
            p.add_argument(f"--{flag}", default=default, type=type(default) if default is not None else str)
        return p

    stage("bronze", "input", "bronze_path", audit_path=None, dataset="orders")
    stage("silver", "bronze_path", "silver_path", contract=None, expectations=None, dq_report_path=None, quarantine_path=None)
    stage("gold", "silver_path", "gold_path", "as_of_date", contract=None, snapshot_metadata_path=None)
    stage("labels", "silver_path", "labels_path", "as_of_date", label_horizon_days=60, metadata_path=None)
    stage("snapshot", "gold_path", "labels_path", "training_snapshot_path", metadata_path=None, as_of_start_date=None, as_of_end_date=None)
    stage(
        "train", "training_snapshot_path", "out_model_path", "out_model_meta", feature_contract=None, evaluation_summary_path=None,
        approved_model_version_path=None, feature_schema_info_path=None, model_name="churn", validation_fraction=0.2,
        random_state=42, data_snapshot_id=None, run_log_path=None, mlflow_tracking_uri=None, mlflow_experiment="churn",
    )
    stage("latest", "gold_path", "latest_features_path", manifest_path=None)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    spark = session(f"tarnbeck-{a.stage}")
    contract = lambda path: Contract.load(path) if path else None
    if a.stage == "bronze":
        out = {"status": stages.ingest(spark, a.input, a.bronze_path, a.run_id, a.audit_path, a.dataset)}
    elif a.stage == "silver":
        out = stages.refine(spark, a.bronze_path, a.silver_path, a.run_id, contract(a.contract), a.expectations, a.dq_report_path, a.quarantine_path)
    elif a.stage == "gold":
        out = stages.build_features(spark, a.silver_path, a.gold_path, a.as_of_date, a.run_id, contract(a.contract), a.snapshot_metadata_path)
    elif a.stage == "labels":
        out = stages.build_labels(spark, a.silver_path, a.labels_path, a.as_of_date, a.run_id, a.label_horizon_days, a.metadata_path)
    elif a.stage == "snapshot":
        out = stages.build_training_snapshot(
            spark, a.gold_path, a.labels_path, a.training_snapshot_path, a.run_id, a.metadata_path, a.as_of_start_date, a.as_of_end_date
        )
    elif a.stage == "train":
        out = stages.train(
            spark, a.training_snapshot_path, a.out_model_path, a.out_model_meta, a.run_id, a.model_name, a.validation_fraction, a.random_state,
            contract(a.feature_contract), a.evaluation_summary_path, a.approved_model_version_path, a.feature_schema_info_path,
            a.data_snapshot_id, a.run_log_path, a.mlflow_tracking_uri, a.mlflow_experiment,
        )
    else:
        out = stages.export_latest(spark, a.gold_path, a.latest_features_path, a.run_id, a.manifest_path)
    print(json.dumps(out, default=str, sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
