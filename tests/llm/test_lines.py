import random

import numpy as np
import pyarrow as pa

from tarnbeck.llm import lines

SCHEMA = "doc_id long, text string, seen string, removed_starts string, whole int"


def run(spark, docs, **options):
    df = spark.createDataFrame([(i, t, "s", "r", 1) for i, t in docs], SCHEMA)
    out = lines.dedup_lines(df, **options)
    assert out.columns == ["doc_id", "text", "seen", "whole", "removed_starts", "removed_ends"]
    return out.collect()


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


VOCABULARY = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "klmnpr"]


def test_whole_lines_against_brute_force(spark):
    rng = random.Random(1)
    pool = [sentence(rng, VOCABULARY, rng.randrange(9, 30)) for _ in range(12)]
    docs = []
    for i in range(40):
        docs.append((i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else sentence(rng, VOCABULARY, 12) for _ in range(6))))
    seen, want = set(), {}
    for i, t in docs:
        kept = []
        for line in t.split("\n"):
            if line not in seen:
                kept.append(line)
            seen.add(line)
        want[i] = kept
    assert {r.doc_id: [x for x in r.text.split("\n") if x] for r in run(spark, docs)} == want


def test_offsets_rebuild_the_text(spark):
    rng = random.Random(2)
    passage = sentence(rng, VOCABULARY, 30) + " É " + sentence(rng, VOCABULARY, 30)
    docs = [(i, f"Été {sentence(rng, VOCABULARY, 15)} {passage if i % 2 else passage.upper()}, {sentence(rng, VOCABULARY, 15)}") for i in range(20)]
    texts = dict(docs)
    for r in run(spark, docs):
        original, at, out = texts[r.doc_id], 0, ""
        for s, e in zip(r.removed_starts, r.removed_ends, strict=True):
            out, at = out + original[at:s], e
        assert out + original[at:] == r.text
        gone = " ".join(original[s:e] for s, e in zip(r.removed_starts, r.removed_ends))
        assert (len(gone.split()) >= 40) == (r.doc_id > 0) and (r.doc_id > 0 or not gone)
        assert passage.split()[25] not in r.text.lower().split() or r.doc_id == 0 or passage.split()[25] in original.lower().replace(passage.lower(), "").split()


def test_unique_texts_and_short_repeats_are_left_alone(spark):
    rng = random.Random(3)
    docs = [(i, f"Yes, it is.\n{sentence(rng, VOCABULARY, 60)}\nAll rights reserved.") for i in range(30)]
    assert all(r.text == dict(docs)[r.doc_id] for r in run(spark, docs))


def test_odd_rows(spark):
    rng = random.Random(4)
    text = sentence(rng, VOCABULARY, 50)
    docs = [(2, text), (1, text), (1, text), (None, text), (3, None), (4, ""), (5, " \n "), (6, "word " * 5000), (7, text + "\n" + text)]
    got = run(spark, docs)
    assert len(got) == len(docs)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r.text)
    assert of[1] == [text, text] and of[2] == [""] and of[None] == [""] and of[3] == [None] and of[4] == [""] and of[5] == [" \n "]
    assert of[7] == [""] and 0 < len(of[6][0].split()) <= 48
    assert run(spark, []) == []


def test_units_cover_all_words_and_resync():
    rng = random.Random(5)
    passage = sentence(rng, VOCABULARY, 200)
    hashes = []
    for before in ("", "x y z " * 7, "q " * 31):
        ((_, _, words, starts, digest),) = lines.units(pa.array([before + passage]))
        assert starts[0] == 0 and (np.diff(starts) > 0).all() and (np.diff(np.append(starts, len(words.hash))) <= lines.MAX_UNIT).all()
        hashes.append(set(digest.tolist()))
    assert len(hashes[0] & hashes[1] & hashes[2]) >= 0.8 * len(hashes[0])


def test_parts_from_unrelated_documents_are_no_passage(spark):
    rng = random.Random(6)
    text = sentence(rng, VOCABULARY, 400)
    ((_, _, words, starts, _),) = lines.units(pa.array([text]))
    parts = [text.split()[a:b] for a, b in zip(starts, starts[1:], strict=False) if b - a < 8]
    docs = [(i, " ".join([sentence(rng, VOCABULARY, 20), *part, sentence(rng, VOCABULARY, 20)])) for i, part in enumerate(parts)]
    docs.append((len(docs), text))
    assert all(not r.removed_starts for r in run(spark, docs))


def test_short_lines_that_repeat(spark):
    rng = random.Random(8)
    short = [f"{sentence(rng, VOCABULARY, n)}" for n in (4, 5, 6, 7)]
    docs = [(i, "\n".join(x for s in short for x in (sentence(rng, VOCABULARY, 20), s))) for i in range(20)]
    for r in run(spark, docs):
        original = dict(docs)[r.doc_id].split("\n")
        assert [x for x in r.text.split("\n") if x] == (original if r.doc_id == 0 else original[::2])
