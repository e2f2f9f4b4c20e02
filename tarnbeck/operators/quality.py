"""Data quality: expectation suites and contract checks, each in as few jobs as it takes."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbeck.sources.contracts import Contract


@dataclass(frozen=True)
class SuiteResult:
    """passed: no critical check failed. failed_frames: the rows of all checks that failed, lazily."""

    passed: bool
    metrics: dict[str, Any]
    failed_frames: dict[str, DataFrame] = field(default_factory=dict)


def any_null(columns: list[str]) -> Column:
    if not columns:
        raise ValueError("a not_null check needs columns")
    return reduce(or_, (F.col(c).isNull() for c in columns))


def outside(column: str, allowed: list) -> Column:
    """Null is outside, too."""
    return F.col(column).isNull() | ~F.col(column).isin(allowed)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once; null is a key like any other."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def rows_of_repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once. Keys with a null are left out: nulls don't equal
    each other. Few keys repeat, so the join's other side is small."""
    return df.join(repeated_keys(df, keys).drop("n"), keys, "left_semi")


def unique_metrics(df: DataFrame, keys: list[str]) -> dict[str, int]:
    """duplicate_keys counts null keys, bad_rows doesn't; both in one job."""
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    got = repeated_keys(df, keys).agg(
        F.count("*").alias("duplicate_keys"), F.coalesce(F.sum(F.when(whole, F.col("n"))), F.lit(0)).alias("bad_rows")
    )
    return got.head().asDict()


def run_suite(df: DataFrame, suite: dict[str, Any] | str) -> SuiteResult:
    """A suite {checks: [{name, type, columns or column, allowed, severity}]}, or the path of its YAML.
    All row checks are one aggregation, each `unique` check is one more. severity is warning unless
    it says critical; an unknown type is a ValueError."""
    if isinstance(suite, str):
        with open(suite, encoding="utf-8") as f:
            suite = yaml.safe_load(f)
    checks = suite.get("checks", [])
    bad: dict[int, Column] = {}
    for i, check in enumerate(checks):
        if check["type"] == "not_null":
            bad[i] = any_null(check.get("columns") or [])
        elif check["type"] == "in_set":
            bad[i] = outside(check["column"], check["allowed"])
        elif check["type"] != "unique":
            raise ValueError(f"unknown type of check: {check['type']}")
    counts = df.agg(F.count("*").alias("rows"), *(F.count_if(c).alias(f"c{i}") for i, c in bad.items())).head()
    passed, details, failed = True, [], {}
    for i, check in enumerate(checks):
        keys = check.get("columns") or [check.get("column")]
        found = unique_metrics(df, keys) if check["type"] == "unique" else {"bad_rows": counts[f"c{i}"]}
        good = found.get("duplicate_keys", found["bad_rows"]) == 0
        severity = check.get("severity", "warning")
        details.append({"name": check["name"], "type": check["type"], "severity": severity, "passed": good} | found)
        if not good:
            failed[check["name"]] = rows_of_repeated_keys(df, keys) if check["type"] == "unique" else df.filter(bad[i])
            passed = passed and severity != "critical"
    return SuiteResult(passed, {"row_count": counts["rows"], "checks": details}, failed)


def contract_metrics(df: DataFrame, contract: Contract, without: tuple[str, ...] = ()) -> dict[str, int]:
    """Rows that break each of the contract's rules, and its key's duplicates: two jobs."""
    rules = contract.violations(without)
    found = df.agg(*(F.count_if(c).alias(name) for name, c in rules.items())).head().asDict()
    if contract.key:
        found["duplicate_keys"] = unique_metrics(df, contract.key)["duplicate_keys"]
    return found


def assert_contract(df: DataFrame, contract: Contract, without: tuple[str, ...] = ()) -> dict[str, int]:
    """The metrics, all 0; RuntimeError if any isn't."""
    found = contract_metrics(df, contract, without)
    if broken := {k: v for k, v in found.items() if v}:
        raise RuntimeError(f"{contract.name}: quality checks failed: {broken}")
    return found


def single_value(df: DataFrame, column: str) -> str:
    """The one value that a column has, as text; RuntimeError if it has none, several, or nulls."""
    row = df.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count_if(F.col(column).isNull()).alias("nulls")).head()
    if row["low"] is None or row["low"] != row["high"] or row["nulls"]:
        raise RuntimeError(f"{column} should have one value, but has {row['low']} to {row['high']} and {row['nulls']} nulls")
    return str(row["low"])
