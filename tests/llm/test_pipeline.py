"""Each stage of the pipeline against a plain version over what it was given."""

import random

import pytest

import corpus_pipeline as cp
from tarnbeck.llm import simhash
from tarnbeck.llm.tables import stash

VOCABULARY = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "klmnpr"]
INSULTS = ["grobnak", "grobnatz", "snurvel"]


def words(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Planted cases among clean documents: toxic ones, copies, shared passages, leaks, odd rows."""
    rng = random.Random(0)
    base = str(tmp_path_factory.mktemp("corpus"))
    items = [(i, words(rng, 30)) for i in range(10)]
    docs, labels, kind = [], [], {}

    def add(what, text, toxic=0):
        i = len(docs)
        docs.append((i, text, "en", f"src{i % 3}", None if text is None else len(text)))
        labels.append((i, int(i % 5 > 0), toxic))
        kind[i] = what

    shared = words(rng, 60)
    original = words(rng, 300)
    add("original", original)
    for _ in range(120):
        add("clean", words(rng, rng.randrange(40, 200)))
        add("toxic", f"{words(rng, 20)} you {rng.choice(INSULTS)} {words(rng, 10)} {rng.choice(INSULTS)}", 1)
    for _ in range(5):
        add("copy", original)
        near = original.split()
        near[rng.randrange(300)] = "changed"
        add("near", " ".join(near))
        add("passage", f"{words(rng, 25)}\n{shared}\n{words(rng, 25)}")
        add("leak", f"{words(rng, 25)} {rng.choice(items)[1]} {words(rng, 25)}")
    for text in (None, "", " "):
        add("blank", text)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    after, now = {}, spark.read.parquet(f"{base}/documents.parquet")
    for name, stage in cp.STAGES:
        before, now = now, stash(stage(spark, now, base), name)
        after[name] = before, now
    return base, kind, after


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(corpus):
    for name, (_, out) in corpus[2].items():
        assert tuple(out.columns[:5]) == cp.COLUMNS and (len(out.columns) == 5) == (name != "mixing")


def test_toxic_documents_go(corpus):
    _, kind, after = corpus
    before, out = map(rows, after["toxicity"])
    gone = before.keys() - out.keys()
    assert all(kind[i] == "toxic" for i in gone) and len(gone) >= 0.95 * sum(k == "toxic" for k in kind.values())
    assert all(out[i] == before[i] for i in out)


def test_one_of_each_group_stays(corpus):
    before, out = map(rows, corpus[2]["near_duplicates"])
    prints = {i: simhash.fingerprint(r.text) for i, r in before.items()}
    root = {i: i for i in prints}
    while True:
        new = {i: min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2) for i in prints}
        if new == root:
            break
        root = new
    assert set(out) == set(root.values()) and all(out[i] == before[i] for i in out)


def test_repeated_passages_are_cut(corpus):
    _, kind, after = corpus
    before, out = map(rows, after["substrings"])
    assert before.keys() == out.keys()
    holders = sorted(i for i in before if kind[i] == "passage")
    shared = before[holders[0]].text.split("\n")[1]
    assert shared in out[holders[0]].text and all(shared not in out[i].text for i in holders[1:])
    assert all(out[i] == before[i] for i in out if kind[i] in ("clean", "original", "blank"))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.values())


def test_leaks_go(corpus, spark):
    base, kind, after = corpus
    before, out = map(rows, after["decontamination"])
    assert before.keys() - out.keys() == {i for i in before if any(
        r.text and before[i].text and r.text in before[i].text for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()
    )}
    assert {kind[i] for i in before.keys() - out.keys()} == {"leak"}


def test_mixing_keeps_all(corpus):
    before, out = map(rows, corpus[2]["mixing"])
    assert before.keys() == out.keys()
    assert all(r.rate >= 0 and r.copies >= 0 and r.p_good + r.p_rough == pytest.approx(1) for r in out.values())


def test_run_and_empty_table(spark, corpus, tmp_path):
    base, _, after = corpus
    assert set(rows(cp.run(spark, base))) == set(rows(after["mixing"][1]))
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{base}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_nameless_and_repeated_rows(spark, corpus, tmp_path):
    base = corpus[0]
    docs = spark.read.parquet(f"{base}/documents.parquet")
    extra = docs.filter("doc_id in (0, 1)")
    nameless = extra.selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars")
    docs.unionByName(extra).unionByName(nameless).unionByName(nameless).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{base}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    assert [sum(r.doc_id == i for r in got) for i in (0, 1, None)] == [1, 1, 0]
