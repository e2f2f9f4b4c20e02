import pytest

from tarnbeck.llm import tables


@pytest.mark.parametrize("part", [1, 3, 65536])
def test_join_with_hot_keys(spark, monkeypatch, part):
    monkeypatch.setattr(tables, "HOT_PART", part)
    keys = [1] * 50 + [2] * 40 + list(range(3, 13)) + [None, 99]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int")
    counts = {k: keys.count(k) for k in set(keys) - {None, 99}}
    side = spark.createDataFrame([(k, n, None if k == 2 else str(k)) for k, n in counts.items()], "k long, n long, s string")
    got = tables.join_hot(rows, side, "k", "n", len(keys))
    assert sorted(got.columns) == ["i", "k", "s"]
    want = [(k, i, None if k == 2 else str(k)) for i, k in enumerate(keys) if k in counts]
    assert sorted(tuple(r) for r in got.select("k", "i", "s").collect()) == sorted(want, key=lambda r: r[:2])


def test_join_of_empty_tables(spark):
    rows, side = spark.createDataFrame([], "k long, i int"), spark.createDataFrame([], "k long, n long")
    assert tables.join_hot(rows, side, "k", "n", 0).collect() == []
