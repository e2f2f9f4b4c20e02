from datetime import date

import pytest
from pyspark.sql import functions as F

from tarnbeck.sources import tables
from tarnbeck.sources.tables import AppendLog, ConcurrentWrite, VersionedTable, upsert

SCHEMA = "k long, d date, v string"


def frame(spark, *rows):
    return spark.createDataFrame([(k, date(2025, 1, d), v) for k, d, v in rows], SCHEMA)


def content(df):
    return sorted((r.k, r.d.day, r.v) for r in df.collect())


@pytest.mark.parametrize("partition", [None, "d"])
def test_merge_replaces_inserts_and_keeps(spark, tmp_path, partition):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k", "d"], partition=partition, buckets=4)
    assert not table.exists()
    with pytest.raises(FileNotFoundError):
        table.read()
    table.merge(frame(spark, (1, 1, "a"), (2, 1, "b"), (3, 2, "c")))
    table.merge(frame(spark, (2, 1, "B"), (4, 3, "d")))
    want = [(1, 1, "a"), (2, 1, "B"), (3, 2, "c"), (4, 3, "d")]
    assert content(table.read()) == want
    table.merge(frame(spark, (2, 1, "B"), (4, 3, "d")))
    assert content(table.read()) == want
    table.merge(frame(spark))
    assert content(table.read()) == want


def test_only_touched_parts_are_rewritten(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k", "d"], partition="d")
    table.merge(frame(spark, (1, 1, "a"), (2, 2, "b")))
    before = table._manifest()["parts"]
    table.merge(frame(spark, (3, 2, "c")))
    after = table._manifest()["parts"]
    assert before["2025-01-01"] == after["2025-01-01"] and before["2025-01-02"] != after["2025-01-02"]
    assert content(table.read(["2025-01-02"])) == [(2, 2, "b"), (3, 2, "c")]


def test_source_keys_must_be_unique(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k", "d"])
    with pytest.raises(ValueError):
        table.merge(frame(spark, (1, 1, "a"), (1, 1, "b")))
    assert not table.exists()


def test_a_reader_keeps_its_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k", "d"])
    table.overwrite(frame(spark, (1, 1, "a")))
    old = table.read()
    table.overwrite(frame(spark, (1, 1, "z")))
    assert content(old) == [(1, 1, "a")] and content(table.read()) == [(1, 1, "z")]
    table.overwrite(frame(spark))
    assert content(table.read()) == []


def test_upsert_is_idempotent(spark):
    a, b = frame(spark, (1, 1, "a"), (2, 1, "b")), frame(spark, (2, 1, "B"))
    once = upsert(a, b, ["k", "d"])
    assert content(upsert(once, b, ["k", "d"])) == content(once) == [(1, 1, "a"), (2, 1, "B")]


def test_append_log_replaces_a_batch_that_is_written_again(spark, tmp_path):
    log = AppendLog(spark, str(tmp_path / "log"))
    schema = frame(spark).schema
    assert log.read(schema).count() == 0
    for batch, row in (("x", (1, 1, "a")), ("y", (2, 2, "b")), ("x", (1, 1, "a"))):
        log.append(frame(spark, row), batch, "d")
    assert content(log.read(schema)) == [(1, 1, "a"), (2, 2, "b")]


def test_choose_keeps_a_newer_row(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=2)
    newest = lambda rows: rows.groupBy("k").agg(F.max(F.struct("d", "v")).alias("m")).select("k", "m.d", "m.v")
    table.merge(frame(spark, (1, 9, "march"), (2, 1, "old")), newest)
    table.merge(frame(spark, (1, 2, "january"), (2, 5, "new"), (3, 1, "first")), newest)
    assert content(table.read()) == [(1, 9, "march"), (2, 5, "new"), (3, 1, "first")]


def test_a_writer_that_was_overtaken_publishes_nothing(spark, tmp_path):
    one, two = (VersionedTable(spark, str(tmp_path / "t"), ["k"]) for _ in range(2))
    one.overwrite(frame(spark, (1, 1, "a")))

    def meanwhile(rows):
        two.merge(frame(spark, (2, 2, "b")))
        return rows.dropDuplicates(["k"])

    with pytest.raises(ConcurrentWrite):
        one.merge(frame(spark, (3, 3, "c")), meanwhile)
    assert content(one.read()) == [(1, 1, "a"), (2, 2, "b")]


def test_dead_parts_go_and_buckets_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_BUCKET", 4)
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=1)
    table.merge(frame(spark, (1, 1, "a")))
    table.merge(frame(spark, *((i, 1, "b") for i in range(2, 40))))
    manifest = table._manifest()
    assert manifest["buckets"] == 10 and sum(manifest["rows"].values()) == 39 and len(content(table.read())) == 39
    assert len(table.remove_dead_parts(0)) == 2 and table.remove_dead_parts(0) == [] and len(content(table.read())) == 39
    again = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=1)
    again.merge(frame(spark, (5, 2, "c")))
    assert len(content(again.read())) == 39
