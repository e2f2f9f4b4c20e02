import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnbeck.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, found string, vec string"


def run(spark, vectors, **options):
    rows = [(i, v, "x", "y") for i, v in vectors]
    got = ann.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, **options).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def brute(vectors, k):
    good = {i: np.array(v, np.float32).astype(float) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if q % 20 == 0:
            near = sorted(((-(good[q] * good[i]).sum(), i) for i in good if i != q))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def ids(found):
    return {q: [i for i, _ in x] for q, x in found.items()}


def test_recall_and_scores_on_clusters_and_noise(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((40, 16))
    for data in (centres[rng.integers(0, 40, 3000)] + 0.2 * rng.standard_normal((3000, 16)), rng.standard_normal((3000, 16))):
        vectors = list(enumerate(data.tolist()))
        got, want = run(spark, vectors, k=10, block_rows=200), brute(vectors, 10)
        assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
        hit = sum(len(set(a) & set(b)) for a, b in zip(ids(got).values(), [ids(want)[q] for q in got]))
        assert hit >= 0.9 * sum(map(len, want.values()))
        exact = {q: dict(v) for q, v in brute(vectors, 3000).items()}
        assert all(s == pytest.approx(exact[q][i], abs=1e-9) for q, found in got.items() for i, s in found)


def test_ties_copies_and_a_hot_vector(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [1.0, 2.0, 3.0]) for i in range(200)] + [(i, rng.standard_normal(3).round(1).tolist()) for i in range(200, 500)]
    got, want = run(spark, vectors, block_rows=1000), brute(vectors, 20)
    assert ids(got) == ids(want)


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (20, None), (None, [1.0, 1.0]), (7, [2.0, 1.0]), (8, [1.0, 2.0, 3.0]), (7, [2.0, 1.0])]
    assert run(spark, vectors) == {0: [(7, 2.0), (7, 2.0)]}


def test_many_ties_at_the_edge_go_to_the_smallest_ids(spark):
    vectors = [(i, [1.0, float(i)]) for i in range(60)]
    for block_rows in (2048, 16):
        got = run(spark, [(0, [1.0, 0.0]), *vectors[1:]], block_rows=block_rows, recall=1.0)
        assert [i for i, _ in got[0]] == list(range(1, 21)) and {s for _, s in got[0]} == {1.0}


def test_rows_of_one_id_and_vectors_of_other_lengths(spark):
    vectors = [(0, [1.0, 0.0]), (7, [5.0, 1.0]), (7, [9.0, 1.0]), (20, [1.0, 0.0, 0.0]), (8, [3.0, 0.0, 1.0]), (9, [2.0])]
    assert run(spark, vectors) == {0: [(7, 9.0), (7, 5.0)], 20: [(8, 3.0)]}


def test_scores_of_doubles_are_theirs(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [0.1])], "vec_id long, embedding array<double>")
    assert [r.score for r in ann.nearest_neighbours(frame, F.col("vec_id") % 20 == 0).collect()] == [0.1]


def test_few_blocks_are_read_where_data_cluster(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((250, 24))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    data = np.repeat(centres, 40, axis=0) + 0.03 * rng.standard_normal((10_000, 24))
    vectors = list(enumerate(data.tolist()))
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    rows = ann.searchable(frame, F.col("vec_id") % 20 == 0, "vec_id", "embedding")
    index = ann.fit_index(ann.grouped(rows, 20), 24, 20, block_rows=100)
    assert index.blocks == 100 and index.looked_at < 0.2 and index.recall >= 0.95
    got, want = run(spark, vectors, block_rows=100), brute(vectors, 20)
    hit = sum(len(set(a) & set(ids(want)[q])) for q, a in ids(got).items())
    assert hit >= 0.95 * sum(map(len, want.values()))


def test_empty_single_and_no_queries(spark):
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0])]) == {}
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == {}


def test_hilbert_index_is_a_walk():
    side = 1 << 3
    cells = np.array([(a, b) for a in range(side) for b in range(side)])
    order = cells[np.argsort(ann.hilbert_index(cells, 3))]
    assert len(set(ann.hilbert_index(cells, 3).tolist())) == side * side
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = queries.op1_ann(spark, sf_dir)
    ran = con.execute(queries.ORACLE_SQL["op1_ann"])
    assert [d[0] for d in ran.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(ran.fetchall())
