import random
import re

import numpy as np
import pytest

from tarnbeck.llm import decontaminate as dc

DOCS = "doc_id long, text string, item_id string, start int"
ITEMS = "item_id long, text string, doc_id string"
VOCABULARY = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "klmnpr"]


def tokens(text):
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (text or "").lower())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def nearest(item, text):
    """Smallest word edit distance of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return min(row)


def planted(rng, items, n):
    out = []
    for k in range(n):
        words = rng.choice(items).split()
        for _ in range(int(len(words) * rng.choice([0, 0.05, 0.1, 0.15, 0.3]))):
            at = rng.randrange(len(words))
            change = rng.randrange(3)
            words[at : at + (change != 1)] = [] if change == 2 else [rng.choice(VOCABULARY)]
        host = [rng.choice(VOCABULARY) for _ in range(rng.randrange(0, 80))]
        cut = rng.randrange(len(host) + 1)
        out.append((k, " ".join(host[:cut] + words + host[cut:])))
    return out


def test_against_all_windows(spark):
    rng = random.Random(1)
    items = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(6, 60))) for _ in range(15)]
    docs = planted(rng, items, 120)
    want = {
        (d, i) for d, t in docs for i, item in enumerate(items)
        if nearest(tokens(item), tokens(t)) <= dc.allowed_edits(len(tokens(item)), 0.2)
    }
    found = dc.find_copies(
        spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS), spark.createDataFrame([(i, t, "y") for i, t in enumerate(items)], ITEMS)
    ).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got <= want and len(got) >= 0.99 * len(want)
    texts = dict(docs)
    for r in found:
        assert distance(tokens(items[r.item_id]), tokens(texts[r.doc_id][r.start : r.end])) == r.distance


def test_shards_find_the_same(spark):
    rng = random.Random(2)
    items = [" ".join(rng.choice(VOCABULARY) for _ in range(20)) for _ in range(10)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in planted(rng, items, 40)], DOCS)
    bench = spark.createDataFrame([(i, t, "y") for i, t in enumerate(items)], ITEMS)
    whole = {(r.doc_id, r.item_id, r.start, r.end) for r in dc.find_copies(docs, bench).collect()}
    assert whole and {(r.doc_id, r.item_id, r.start, r.end) for r in dc.find_copies(docs, bench, shard_bytes=400).collect()} == whole
    clean = dc.remove_contaminated(docs, bench, shard_bytes=400)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {d for d, *_ in whole}


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, f"É, {item.upper()}!"), (1, f"É, {item.upper()}!"), (None, item), (2, None), (3, ""), (4, "the " * 30_000), (5, item[: len(item) // 2]), (6, item + " " + item)]
    bench = [(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "too short", "x"), (None, item, "x"), (5, "the " * 40, "x")]
    df, items = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS), spark.createDataFrame(bench, ITEMS)
    got = sorted((r.doc_id or 0, r.item_id, r.start, r.end, r.distance) for r in dc.find_copies(df, items).collect() if r.item_id == 1)
    n = len(item)
    assert got == [(0, 1, 0, n, 0), (1, 1, 3, 3 + n, 0), (1, 1, 3, 3 + n, 0), (6, 1, 0, n, 0), (6, 1, n + 1, 2 * n + 1, 0)]
    assert {r.doc_id for r in dc.find_copies(df, items).collect() if r.item_id == 5} == {4}
    assert dc.find_copies(df.limit(0), items).count() == 0 and dc.find_copies(df, items.limit(0)).count() == 0
    assert dc.remove_contaminated(df, items).count() == 3 and dc.remove_contaminated(df, items.limit(0)).count() == len(docs)


def test_items_of_few_words(spark):
    bench = [(1, "alpha"), (2, "beta gamma"), (3, "delta epsilon zeta"), (4, "eta theta iota kappa"), (5, "one two three four five"), (6, "!?"), (7, "red green blue cyan pink")]
    texts = {
        10: "an alpha here", 11: "alphabet", 12: "beta, GAMMA", 13: "gamma beta", 14: "x delta epsilon zeta", 15: "delta epsilon", 16: "eta theta iota kappa",
        17: "eta theta iota lambda", 18: "one two nine four five", 19: "one two nine ten five", 20: "two three four five", 21: "beta", 22: "red green blue gray cyan pink so",
    }
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], DOCS)
    found = dc.find_copies(df, spark.createDataFrame([(i, t, "y") for i, t in bench], ITEMS)).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == {(10, 1, 0), (12, 2, 0), (14, 3, 0), (16, 4, 0), (18, 5, 1), (20, 5, 1), (22, 7, 1)}
    assert [(r.start, r.end) for r in found if r.doc_id == 10] == [(3, 8)]
    assert dc.allowed_edits(5, 0.2) == 1 and dc.allowed_edits(15, 0.2) == 3 and dc.allowed_edits(4, 0.2) == 0


@pytest.mark.parametrize(("size", "rate"), [(15, 0.2), (30, 0.2), (50, 0.1), (50, 0.2)])
def test_walks_meet_at_the_largest_distance(size, rate):
    rng, chance = random.Random(size), np.random.default_rng(size)
    met = 0
    for _ in range(60):
        a = chance.integers(1, 1 << 60, size).astype(np.uint64).tolist()
        b = list(a)
        for _ in range(int(rate * size)):
            at, change = rng.randrange(len(b)), rng.randrange(3)
            b[at : at + (change != 1)] = [] if change == 2 else [rng.getrandbits(60)]
        pad = np.array(a + b, np.uint64)
        keys = dc.walk_keys(pad, np.array([0, len(a)]), size, np.array([len(a), len(pad)]), dc.walks_for(0.99), 5)
        met += bool((keys[0] == keys[1]).any())
    assert met >= 58


@pytest.mark.parametrize("kind", ["head", "tail", "dropped head"])
def test_edits_that_stand_together(spark, kind):
    rng = random.Random(7)
    items = [[f"{rng.getrandbits(40):x}" for _ in range(n)] for n in (60, 71, 84, 107, 123, 160, 200, 250) for _ in range(5)]
    docs = []
    for d, item in enumerate(items):
        k = dc.allowed_edits(len(item), 0.2)
        new = [f"{rng.getrandbits(40):x}" for _ in range(k)]
        changed = {"head": new + item[k:], "tail": item[:-k] + new, "dropped head": item[k:]}[kind]
        host = [f"{rng.getrandbits(40):x}" for _ in range(80)]
        docs.append((d, " ".join(host[:40] + changed + host[40:]), "x", 1))
    bench = spark.createDataFrame([(i, " ".join(item), "y") for i, item in enumerate(items)], ITEMS)
    found = dc.find_copies(spark.createDataFrame(docs, DOCS), bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got <= {(d, d) for d in range(len(items))} and len(got) >= 0.97 * len(items)
    assert all(r.distance == nearest(items[r.item_id], docs[r.doc_id][1].split()) for r in found)
