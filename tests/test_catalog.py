"""Every registered query that has SQL, against DuckDB on the same files."""

import math
from datetime import date, datetime

import duckdb
import pytest

from tarnbeck.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime):
        return v.date() if v.time() == datetime.min.time() else v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7)
    return v if isinstance(v, (str, int, date, type(None))) else round(float(v), 7)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(name, spark, duck, sf_dir):
    df = catalog.QUERIES[name](spark, sf_dir)
    ran = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, ran.fetchall())


def test_every_query_returns_rows(spark, sf_dir):
    for name in set(catalog.QUERIES) - set(catalog.ORACLE_SQL):
        assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_features_take_one_scan_and_filter_there(spark, sf_dir):
    plan = catalog.QUERIES["pit_features"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "LessThan(o_orderdate" in plan
