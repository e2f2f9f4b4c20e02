import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnbeck.llm import mixing

SCHEMA = "doc_id long, text string, whole string, tokens string, lot int"


def corpus(n=300):
    rng = np.random.default_rng(0)
    kinds = {"a": "alpha apple amber anchor arrow", "b": "birch basil bread brick brush", "c": "cloud coral cedar candy crown"}
    out = []
    for i in range(n):
        kind = "abc"[min(2, int(rng.random() * 4))]
        words = rng.choice(kinds[kind].split() + ["shared", "words"], int(rng.integers(5, 40)))
        own = [f"{x:06x}" for x in rng.integers(0, 1 << 24, 10)]  # no two texts are near copies
        out.append((i, " ".join([*words, *own]), kind))
    return out


def frames(spark, rows, labelled=None):
    docs = spark.createDataFrame([(i, t, "w", "t", 1) for i, t, *_ in rows], SCHEMA)
    marks = [(i, k) for i, _, k in rows if i is None or i % 2 == 0] if labelled is None else labelled
    return docs, spark.createDataFrame(marks, "doc_id long, domain string")


def test_targets_are_met_and_posteriors_fit(spark):
    rows = corpus()
    docs, labelled = frames(spark, rows)
    targets = {"a": 0.2, "b": 0.3, "c": 0.5}
    out = mixing.mix_sources(docs, labelled, targets)
    assert out.columns == ["doc_id", "text", "whole", "lot", "tokens", "domain_posterior", "rate", "copies"]
    got = out.collect()
    total = sum(r.tokens for r in got)
    for d, share in targets.items():
        assert sum(r.rate * r.tokens * r.domain_posterior[d] for r in got) == pytest.approx(share * total, rel=1e-3)
    truth = {i: k for i, _, k in rows}
    assert np.mean([max(r.domain_posterior, key=r.domain_posterior.get) == truth[r.doc_id] for r in got]) > 0.95
    assert all(sum(r.domain_posterior.values()) == pytest.approx(1) and r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in got)
    assert {r.doc_id: r.tokens for r in got} == {i: len(t.split()) for i, t, _ in rows}


def test_rates_against_numpy(spark):
    rng = np.random.default_rng(4)
    post = rng.dirichlet([0.4, 0.4, 0.4], 60)
    tokens = rng.integers(1, 50, 60)
    goal = np.array([0.75, 0.2, 0.05]) * tokens.sum()
    mass = spark.createDataFrame([(int(t), [float(x) for x in p]) for t, p in zip(tokens, post, strict=True)], "tokens long, post array<double>")
    steps, left = mixing.fit_rates(mass, goal)
    assert left <= mixing.TOLERANCE
    rate = before = np.ones(60)
    for *g, momentum in steps:
        rate, before = np.maximum(0, rate + momentum * (rate - before) - post @ np.array(g)), rate
    assert (rate >= 0).all() and (rate * tokens) @ post == pytest.approx(goal, abs=2e-4 * tokens.sum())
    one = F.lit(1.0)
    replayed = mass.select(mixing.replay(F.col("post"), steps, one, one)["rate"]).collect()
    assert [r[0] for r in replayed] == pytest.approx(rate.tolist())


def test_posteriors_against_numpy(spark):
    rows = [*corpus(80), (900, None, "a"), (901, "", "a"), (902, "zzz", "a")]
    docs, labelled = frames(spark, rows)
    model = mixing.learn_domains(docs, labelled, "doc_id", "text", 4000)
    coded = docs.select("doc_id", mixing._codes(mixing._tokens(F.col("text"))).alias("codes")).collect()
    got = {r.doc_id: r for r in mixing.posteriors(docs.select("doc_id", "text"), "text", model).collect()}
    for r in coded:
        codes = np.array(r.codes, int)
        said = np.array([model.starts[k][codes // mixing.ENDS].sum() + model.ends[k][codes % mixing.ENDS].sum() for k in range(3)])
        logit = model.prior + np.where(said == 0, model.silent, np.clip(said, -mixing.MOST_EVIDENCE, mixing.MOST_EVIDENCE))
        share = np.exp(logit - logit.max())
        assert got[r.doc_id]["__post"] == pytest.approx((share / share.sum()).tolist(), rel=1e-3) and got[r.doc_id]["__tokens"] == len(codes)


def test_unreachable_targets_end(spark):
    docs, labelled = frames(spark, corpus(60))
    got = mixing.mix_sources(docs, labelled, {"nowhere": 1.0}).collect()
    assert all(r.rate >= 0 for r in got) and sum(r.rate * r.tokens for r in got) < 0.05 * sum(r.tokens for r in got)


def test_odd_rows(spark):
    rows = [*corpus(40), (100, None, "a"), (101, "", "b"), (None, "alpha apple", "a"), (102, "cloud " * 50_000, "c"), (3, "same id", "a"), (103, "É É", "b")]
    docs, labelled = frames(spark, rows)
    got = mixing.mix_sources(docs, labelled, {"a": 1, "b": 1, "c": 1}).collect()
    assert len(got) == len(rows) and [r.tokens for r in got if r.doc_id in (100, 101)] == [0, 0]
    assert mixing.mix_sources(docs.limit(0), labelled, {"a": 1}).count() == 0
    bare = mixing.mix_sources(docs, labelled.limit(0), {"a": 1}).collect()
    assert len(bare) == len(rows) and {r.rate for r in bare} == {1.0}


def test_no_python_on_the_main_path(spark):
    docs, labelled = frames(spark, corpus(30))
    plan = mixing.mix_sources(docs, labelled, {"a": 1, "b": 1})._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
