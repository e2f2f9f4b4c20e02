from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tarnbeck.operators import features, labels

SCHEMA = "customer_id string, order_id string, order_purchase_ts timestamp, order_status string"


def orders(spark, *given):
    return spark.createDataFrame([(c, o, datetime.fromisoformat(t), s[0] if s else "delivered") for c, o, t, *s in given], SCHEMA)


def as_dict(df):
    return {r.customer_id: tuple(r[c] for c in features.FEATURES) for r in df.collect()}


def test_two_customers(spark):
    got = as_dict(
        features.features_at(
            orders(spark, ("c1", "o1", "2025-01-10 10:00:00"), ("c1", "o2", "2025-03-10 10:00:00"), ("c2", "o3", "2025-03-20 10:00:00")),
            "2025-03-31",
        )
    )
    assert got == {"c1": (21, 1, 2, 2, 80, 59.0), "c2": (11, 1, 1, 1, 11, 0.0)}


RAW = [
    ("a", "1", "2025-01-10 10:00:00"), ("b", "2", "2025-01-20 12:00:00"), ("c", "3", "2025-02-15 09:00:00"), ("a", "4", "2025-03-10 11:00:00"),
    ("c", "5", "2025-04-10 15:00:00"), ("a", "6", "2025-05-10 08:30:00"), ("z", "7", "2025-06-15 00:00:00"),
]
GOLDEN = {
    ("2025-01-31", "a"): (21, 1, 1, 1, 21, 0.0, 0), ("2025-01-31", "b"): (11, 1, 1, 1, 11, 0.0, 1),
    ("2025-02-28", "a"): (49, 0, 1, 1, 49, 0.0, 0), ("2025-02-28", "b"): (39, 0, 1, 1, 39, 0.0, 1), ("2025-02-28", "c"): (13, 1, 1, 1, 13, 0.0, 0),
    ("2025-03-31", "a"): (21, 1, 2, 2, 80, 59.0, 0), ("2025-03-31", "b"): (70, 0, 1, 1, 70, 0.0, 1), ("2025-03-31", "c"): (44, 0, 1, 1, 44, 0.0, 0),
}
DAYS = ["2025-01-31", "2025-02-28", "2025-03-31"]


def test_golden_rows_one_day_at_a_time_and_at_once(spark):
    silver = orders(spark, *RAW)
    at_once = {(str(r.as_of_date), r.customer_id): tuple(r[c] for c in features.FEATURES) for r in features.features_over(silver, DAYS).collect()}
    marks = {(str(r.as_of_date), r.customer_id): r.churn_label for r in labels.labels_over(silver, DAYS).collect()}
    assert {k: (*v, marks[k]) for k, v in at_once.items()} == GOLDEN
    for d in DAYS:
        assert as_dict(features.features_at(silver, d)) == {c: v for (x, c), v in at_once.items() if x == d}
        assert {r.customer_id: r.churn_label for r in labels.labels_at(silver, d).collect()} == {c: v for (x, c), v in marks.items() if x == d}


def test_windows_include_both_ends(spark):
    got = as_dict(features.features_at(orders(spark, *[("c", t, f"{t} 23:59:59") for t in ("2025-01-01", "2025-01-30", "2025-01-02", "2024-11-02")]), "2025-01-30"))
    assert got["c"][1:4] == (3 - 0, 4, 4)
    got = as_dict(features.features_at(orders(spark, ("c", "1", "2024-12-31 00:00:00"), ("c", "2", "2024-11-01 00:00:00")), "2025-01-30"))
    assert got["c"][1:4] == (0, 1, 2)


def test_labels_window_and_void_statuses(spark):
    silver = orders(
        spark, ("a", "1", "2025-01-31 09:00:00"), ("a", "2", "2025-04-01 23:00:00"), ("b", "3", "2025-01-01 09:00:00", "canceled"),
        ("b", "4", "2025-02-01 09:00:00", "unavailable"), ("c", "5", "2025-01-31 00:00:00"), ("c", "6", "2025-04-02 00:00:00"),
    )
    assert {r.customer_id: r.churn_label for r in labels.labels_at(silver, "2025-01-31", 60).collect()} == {"a": 0, "b": 1, "c": 1}


def test_observability(spark):
    end = labels.dataset_end(orders(spark, ("a", "1", "2001-08-01 00:00:00")))
    labels.check_observable(end, "2001-06-02", 60)
    with pytest.raises(RuntimeError):
        labels.check_observable(end, "2001-06-03", 60)
    with pytest.raises(ValueError):
        labels.dataset_end(orders(spark).filter("false") if RAW is None else spark.createDataFrame([], SCHEMA))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 300), st.integers(0, 23)), min_size=1, max_size=25))
def test_features_against_plain_python_and_no_future_leak(spark, given_orders):
    as_of = date(2025, 6, 1)
    rows = [(c, f"o{i}", datetime.fromordinal(date(2024, 12, 1).toordinal() + d).replace(hour=h), "delivered") for i, (c, d, h) in enumerate(given_orders)]
    want = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r[2], r[1]) for r in rows if r[0] == c and r[2].date() <= as_of)
        if mine:
            days = [t.date() for t, _ in mine]
            gaps = [(b - a).days for a, b in zip(days, days[1:])]
            ago = [(as_of - d).days for d in days]
            want[c] = (min(ago), sum(a < 30 for a in ago), sum(a < 90 for a in ago), len(ago), max(ago), sum(gaps) / len(gaps) if gaps else 0.0)
    got = as_dict(features.features_at(spark.createDataFrame(rows, SCHEMA), as_of))
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == pytest.approx(want[c])
    past = [r for r in rows if r[2].date() <= as_of]
    if past:
        assert as_dict(features.features_at(spark.createDataFrame(past, SCHEMA), as_of)) == got
