import json
import os
import re

from hypothesis import given
from hypothesis import strategies as st

from tarnbeck.functions import lineage
from tarnbeck.sources.contracts import Contract

JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=8)


def test_known_digests():
    assert Contract.own("bronze_orders").schema_hash == "5b19fad943bf43b0"
    assert lineage.label_version(60) == "665a6db2556145dd"
    assert lineage.label_version(30) == "000b6797c271930e"
    assert [lineage.snapshot_id(d, "bb8bea144247e9d8") for d in ("2025-01-31", "2025-02-28", "2025-03-31")] == [
        "1ce043e48a827fbf", "f533e4156513ca75", "a9ef5878d371ed03",
    ]


def test_both_layouts_of_contracts(tmp_path):
    spec = {
        "contract_name": "shop.visits", "primary_key": ["visit"], "required_columns": ["visit", "seconds"],
        "columns": {"note": {"type": "string"}, "seconds": {"type": "int", "nullable": False, "min_value": 1}, "visit": {"type": "string", "nullable": False}},
        "allowed_values": {"note": ["x"]}, "quality_rules": {"ordering_rules": ["seconds <= seconds"]},
    }
    (tmp_path / "c.json").write_text(json.dumps(spec, indent=4))
    got = Contract.load(str(tmp_path / "c.json"))
    assert (got.name, got.key, got.columns) == ("shop.visits", ["visit"], [("visit", "string"), ("seconds", "int"), ("note", "string")])
    assert (got.least, got.ordered, got.optional, got.allowed) == ({"seconds": 1}, [("seconds", "seconds")], ["note"], {"note": ["x"]})
    assert got.version == lineage.digest(spec)


@given(st.dictionaries(st.text(), JSON))
def test_digest_is_stable_hex(value):
    assert re.fullmatch(r"[0-9a-f]{16}", lineage.digest(value))
    assert lineage.digest(value) == lineage.digest(dict(reversed(list(value.items()))))


def test_fingerprint_follows_file_and_ignores_order(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("x")
    b.write_text("y")
    uris = [a.as_uri(), b.as_uri()]
    before = lineage.source_fingerprint(uris)
    assert before == lineage.source_fingerprint(reversed(uris))
    a.write_text("longer")
    os.utime(a, ns=(1, 1))
    assert lineage.source_fingerprint(uris) != before
    assert lineage.source_fingerprint(["s3://x/y"]) == lineage.digest([{"path": "s3://x/y"}])
