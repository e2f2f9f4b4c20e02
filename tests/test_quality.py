import pytest

from tarnbeck.operators import quality
from tarnbeck.sources.contracts import Contract
from tarnbeck.sources.files import write_failed

ROWS = [("a", "x", 1), ("a", "y", 2), (None, "x", 3), (None, "z", 4), ("b", None, 5)]


def frame(spark):
    return spark.createDataFrame(ROWS, "k string, s string, n int")


def suite(*checks):
    return {"checks": list(checks)}


def test_unique_counts_null_keys_but_not_their_rows(spark):
    assert quality.unique_metrics(frame(spark), ["k"]) == {"duplicate_keys": 2, "bad_rows": 2}
    assert {r.n for r in quality.rows_of_repeated_keys(frame(spark), ["k"]).collect()} == {1, 2}


def test_suite(spark, tmp_path):
    found = quality.run_suite(
        frame(spark),
        suite(
            {"name": "k", "type": "not_null", "columns": ["k", "s"]}, {"name": "s", "type": "in_set", "column": "s", "allowed": ["x", "y"]},
            {"name": "u", "type": "unique", "columns": ["k"], "severity": "critical"}, {"name": "fine", "type": "not_null", "columns": ["n"], "severity": "critical"},
        ),
    )
    assert not found.passed and found.metrics["row_count"] == 5
    assert [c["bad_rows"] for c in found.metrics["checks"]] == [3, 2, 2, 0]
    assert set(found.failed_frames) == {"k", "s", "u"}
    paths = write_failed(found.failed_frames, str(tmp_path / "q"), most=1)
    assert [spark.read.parquet(p).count() for p in paths] == [1, 1, 1]


def test_warnings_do_not_block(spark):
    assert quality.run_suite(frame(spark), suite({"name": "k", "type": "not_null", "columns": ["k"]})).passed


def test_bad_suites(spark):
    with pytest.raises(ValueError):
        quality.run_suite(frame(spark), suite({"name": "k", "type": "not_null", "columns": []}))
    with pytest.raises(ValueError):
        quality.run_suite(frame(spark), suite({"name": "k", "type": "no such"}))


def test_schema_check(spark):
    bronze = Contract.own("bronze_orders")
    good = spark.createDataFrame([], bronze.struct())
    bronze.check_schema(good.withColumn("more", good.order_id).schema)
    with pytest.raises(ValueError, match="missing"):
        bronze.check_schema(good.drop("order_id").schema)
    with pytest.raises(ValueError, match="not string"):
        bronze.check_schema(good.withColumn("order_id", good.order_id.cast("int")).schema)


def test_contract_rules(spark):
    spec = {"name": "t", "version": 1, "key": ["a"], "columns": [["a", "int"], ["b", "int"], ["c", "int"]], "least": {"b": 0}, "ordered": [["b", "c"]], "allowed": {"c": [1, 2]}}
    df = spark.createDataFrame([(1, 1, 1), (1, -1, 2), (2, 2, 1), (3, None, 9)], "a int, b int, c int")
    assert quality.contract_metrics(df, Contract.parse(spec)) == {"null_rows": 1, "range_rows": 1, "order_rows": 1, "c_rows": 1, "duplicate_keys": 1}
    with pytest.raises(RuntimeError):
        quality.assert_contract(df, Contract.parse(spec))


def test_single_value(spark):
    assert quality.single_value(spark.createDataFrame([(7,), (7,)], "a int"), "a") == "7"
    for bad in ([(1,), (2,)], [(1,), (None,)], [(None,)]):
        with pytest.raises(RuntimeError):
            quality.single_value(spark.createDataFrame(bad, "a int"), "a")
