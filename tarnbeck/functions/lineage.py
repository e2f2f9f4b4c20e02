"""Version digests and stage events: what was built from what, by which rules."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import subprocess
from collections.abc import Iterable
from datetime import date
from typing import Any
from urllib.parse import unquote, urlparse

from pyspark.sql.types import StructType

#: Statuses of orders that don't keep a customer.
VOID_STATUSES = ("canceled", "unavailable")

# Wording that enters the digest of the label policy.
LABEL_POLICY = {
    "entity": "customer_daily_snapshot",
    "label_name": "churn_label",
    "positive_class": "no valid future order in horizon",
    "window": "(as_of_date, as_of_date + horizon]",
    "version": 1,
}


def _hex(material: bytes, length: int) -> str:
    return hashlib.sha256(material).hexdigest()[:length]


def canonical_json(value: Any) -> bytes:
    """JSON with sorted keys and no blanks, so equal values have equal bytes."""
    return json.dumps(value, sort_keys=True, separators=(",", ":")).encode()


def digest(value: Any, length: int = 16) -> str:
    return _hex(canonical_json(value), length)


def columns_digest(columns: Iterable[tuple[str, str]]) -> str:
    return _hex("|".join(f"{name}:{kind}" for name, kind in columns).encode(), 16)


def schema_digest(schema: StructType) -> str:
    """Digest of names and types alone: nullability flags follow a plan, not the data."""
    return columns_digest((f.name, f.dataType.simpleString()) for f in schema)


def source_fingerprint(files: Iterable[str]) -> str:
    """Digest of an ingest batch: path, size and modification time of local files, the bare name of
    all others. Contents aren't read."""
    seen = []
    for uri in sorted(files):
        url = urlparse(uri)
        local = unquote(url.path)
        if url.scheme in ("", "file") and os.path.exists(local):
            facts = os.stat(local)
            seen.append({"path": os.path.realpath(local), "size": facts.st_size, "mtime_ns": facts.st_mtime_ns})
        else:
            seen.append({"path": uri})
    return digest(seen)


def snapshot_id(as_of: date | str, feature_version: str) -> str:
    return _hex(f"{as_of}|{feature_version}".encode(), 16)


def label_version(horizon_days: int) -> str:
    return digest(
        LABEL_POLICY | {"label_horizon_days": horizon_days, "valid_future_order_invalid_statuses": sorted(VOID_STATUSES)}
    )


def data_snapshot_id(
    first: date | str, last: date | str, feature_version: str, labels: str, horizon_days: int | str, payload_schema: str
) -> str:
    """Digest of a training snapshot's bounds and rules; two of different rows can share it."""
    return digest(
        {
            "as_of_date_min": str(first), "as_of_date_max": str(last), "feature_version": feature_version,
            "label_version": labels, "label_horizon_days": str(horizon_days), "payload_schema_hash": payload_schema, "version": 1,
        }
    )


def model_version(name: str, data_snapshot: str, feature_version: str, labels: str, fraction: float, seed: int) -> str:
    return digest(
        {
            "model_name": name, "algorithm": "logistic_regression", "data_snapshot_id": data_snapshot,
            "feature_version": feature_version, "label_version": labels, "validation_fraction": fraction,
            "random_state": seed, "version": 2,
        }
    )


def short_hash(identifier: str) -> str:
    """What logs show of an identifier."""
    return _hex(identifier.encode(), 12)


def git_revision() -> str | None:
    try:
        done = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.strip() or None


def log_event(logger: logging.Logger, event: str, run_id: str, **fields: Any) -> None:
    """One line of JSON for each event of a stage."""
    logger.info(json.dumps({"event": event, "run_id": run_id} | fields, default=str, sort_keys=True))
