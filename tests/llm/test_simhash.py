import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from tarnbeck.llm import components, simhash

SCHEMA = "doc_id long, text string, fp long, component_id string"


def naive(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        low = low.replace(blank, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet=st.sampled_from("aBÉé \t\n\x0b\x1c\xa0.x"), max_size=60))
def test_fingerprint_against_plain_python(text):
    assert simhash.fingerprint(text) == naive(text)


def test_fingerprint_of_many_shingles():
    text = " ".join(f"w{i % 700}" for i in range(2000))
    assert simhash.fingerprint(text) == naive(text)


def clusters(fps):
    fps = np.array(fps, np.uint64)
    mark = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    while True:
        new = np.where(near, mark[None, :], len(fps)).min(axis=1)
        if (new == mark).all():
            return mark
        mark = new


@pytest.mark.parametrize("hot", [1024, 2])
def test_links_against_all_pairs(spark, hot):
    rng = np.random.default_rng(hot)
    seeds = rng.integers(0, 2**64, 30, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds.tolist():
        for _ in range(rng.integers(0, 12)):
            bits = rng.choice(64, rng.integers(1, 5), replace=False)
            fps.add(int(s) ^ sum(1 << int(b) for b in bits))
    fps = sorted(fps)
    fps = sorted(int(x) for x in np.array(fps, np.uint64).view(np.int64))
    links = simhash.simhash_links(spark.createDataFrame([(f,) for f in fps], "fp long"), hot)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in links.collect())
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert [roots.get(f, f) for f in fps] == [fps[i] for i in clusters(np.array(fps).view(np.uint64))]


def test_every_row_and_odd_texts(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (3, base.upper()), (9, base), (9, base), (1, None), (2, ""), (4, " \t\n"), (None, base), (7, "x" * 200_000), (8, "a b")]
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, 0, "z") for i, t in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert {by_id[i].component_id for i in (3, 5, 9, None)} == {3}
    assert {by_id[i].component_id for i in (1, 2, 4)} == {1}
    assert by_id[1].fingerprint == "0" * 16 and by_id[5].fingerprint == f"{naive(base):016x}"
    assert by_id[7].component_id == 7 and by_id[8].component_id == 8


def test_a_long_text_in_pieces():
    text = " ".join(f"Word{i % 997}" for i in range(5000)) + "\n\n" + "x" * 300 + " y"
    whole = np.concatenate(list(simhash.shingle_hashes(text)))
    for most in (1, 64, 1000):
        parts = list(simhash.shingle_hashes(text, most=most))
        assert len(parts) > 10 and (np.concatenate(parts) == whole).all()
    assert simhash.fingerprint(text) == naive(text)


def test_rows_without_an_id_join_what_lies_between(spark, monkeypatch):
    """Two named texts four bits apart, and one without an id in the middle: one component."""
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.selectExpr("doc_id", "cast(case text when 'left' then 3 when 'right' then 12 else 0 end as bigint) as fp"))
    rows = [(4, "left", 0, "z"), (None, "between", 0, "z"), (9, "right", 0, "z")]
    assert {r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == {4}


def test_one_of_each_keeps_whole_rows(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base, 1, "a"), (3, base.upper(), 2, None), (3, base.upper(), 2, None), (None, base, 3, "c"), (None, "other text here", 4, "d"), (None, "other text here", 4, "d"), (8, None, 5, "e"), (7, "", 6, "f")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, k0 int, whole string"))
    assert got.columns == ["doc_id", "text", "k0", "whole"]
    assert sorted(got.collect(), key=str) == sorted([(3, base.upper(), 2, None), (None, "other text here", 4, "d"), (7, "", 6, "f")], key=str)
    assert simhash.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


def test_all_ids_null_and_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c", 0, "z")], SCHEMA)).collect()
    assert [(r.doc_id, r.component_id) for r in got] == [(None, None)]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1400)]
    edges = spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)}


def test_components_without_edges(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
