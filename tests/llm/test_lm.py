import math
import re
from collections import Counter

import duckdb
import pytest

from tarnbeck.llm import lm, queries

SCHEMA = "doc_id long, text string, part int, run string"


def brute(texts, least=2, alpha=0.4):
    tokens = [re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (t or "").lower()) for t in texts]
    words = Counter(w for t in tokens for w in t)
    pairs = Counter(p for t in tokens for p in zip(t, t[1:]))
    total = sum(words.values())
    out = []
    for t in tokens:
        s = math.log(words[t[0]] / total) if t else 0.0
        for a, b in zip(t, t[1:]):
            n = pairs[a, b]
            s += math.log(n / words[a]) if n >= least else math.log(alpha * words[b] / total)
        out.append((len(t), s))
    return out


@pytest.mark.parametrize(("heavy", "size", "tokens"), [(65536, 24 << 20, 1 << 20), (50, 1 << 15, 1500), (1, 1 << 16, 900)])
def test_against_plain_python(spark, sf_dir, monkeypatch, heavy, size, tokens):
    monkeypatch.setattr(lm, "HEAVY", heavy)
    monkeypatch.setattr(lm, "RUN_TOKENS", tokens)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = dict(zip((r.doc_id for r in rows), brute([r.text for r in rows]), strict=True))
    got = lm.backoff_scores(docs, partition_bytes=size).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.tokens, r.log_score) == (want[r.doc_id][0], pytest.approx(want[r.doc_id][1], rel=1e-9))
        assert r.score == pytest.approx(r.log_score / r.tokens)


def test_odd_rows(spark):
    texts = ["a b a b", None, "", "...", "a", "a b a b", "long " * 60_000, "ÉTÉ été"]
    ids = [1, 2, 3, 4, None, 1, 5, 6]
    df = spark.createDataFrame([(i, t, 0, "r") for i, t in zip(ids, texts, strict=True)], SCHEMA)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.tokens, round(r.log_score, 6)) for r in lm.backoff_scores(df).collect())
    want = sorted((i is None, i or 0, n, round(s, 6)) for i, (n, s) in zip(ids, brute(texts), strict=True))
    assert got == want
    assert all(r.score is None for r in lm.backoff_scores(df).filter("tokens = 0").collect())
    assert lm.backoff_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    assert lm.backoff_scores(df.filter("doc_id in (2, 3)")).count() == 2


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = queries.op7_lm(spark, sf_dir)
    ran = con.execute(queries.ORACLE_SQL["op7_lm"])
    assert [d[0] for d in ran.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(ran.fetchall())
