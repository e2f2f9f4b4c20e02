"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learnt: words and beginnings of words that occur in many more toxic texts than
others. Features are densities of its words, their nearness to the second person, capitals,
punctuation and obfuscation rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .boosting import fit_boosted, fit_isotonic
from .fitting import fold, labelled_sample
from .tables import stash
from .textbits import WORD_BYTES, HashSet, Texts, Words, find_words, hash_spans, text_runs

#: Second-person words of the four languages, and common English insults.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros"
INSULTS = "idiot moron stupid scum trash loser pathetic worthless disgusting clown dumb fool ugly filthy liar hate kill bitch bastard whore slut shit fuck crap pig rat vermin"

PREFIXES = (4, 5, 6, 7)
NEAR = 6
_UNLEET = np.arange(256, dtype=np.uint8)
for _digit, _letter in zip(b"013457", b"oieast", strict=True):
    _UNLEET[_digit] = _letter
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_ALPHA = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_MARK = np.array([b > 32 and b < 127 and not chr(b).isalnum() for b in range(256)])
FEATURES = 16
#: Rows of the sample are described with a lexicon learnt from the other parts.
PARTS = 5


def _plain_words(run: Texts) -> tuple[Texts, Words]:
    """Words of a lower-cased run, digits that stand for letters undone."""
    plain = Texts(_UNLEET[run.data], run.starts)
    return plain, find_words(plain, WORD_BYTES)


def stems(plain: Texts, words: Words) -> list[np.ndarray]:
    """Hashes of each word's beginnings and of the word; of a shorter word, its own again."""
    ends = [np.minimum(words.start + n, words.end) for n in PREFIXES]
    return [hash_spans(plain.data, words.start, e) for e in ends] + [words.hash]


def _hash_list(words: str) -> HashSet:
    return HashSet(np.concatenate([find_words(t).hash for _, _, t in text_runs(pa.array([words]))]))


class Lexicon:
    def __init__(self, table: np.ndarray, weight: np.ndarray) -> None:
        self.known, self.weight = HashSet(table), weight[np.argsort(table)]

    def weights(self, plain: Texts, words: Words) -> np.ndarray:
        """The largest weight of a word's stems, 0 if none is in the lexicon."""
        out = np.zeros(len(words.hash))
        for h in stems(plain, words):
            at = self.known.find(h)
            hit = at >= 0
            out[hit] = np.maximum(out[hit], self.weight[at[hit]])
        return out


def _per_row(flags: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=flags, minlength=n)


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """(texts, FEATURES); all zero for null and empty texts."""
    out = np.zeros((len(texts), FEATURES))
    second, insults = _hash_list(SECOND_PERSON), _hash_list(INSULTS)
    for lo, hi, raw in text_runs(texts, lower=False):
        n = hi - lo
        run = next(text_runs(texts.slice(lo, n), most=1 << 62))[2]
        plain, words = _plain_words(run)
        row = words.row
        count = np.maximum(np.diff(words.first), 1)
        weight = lexicon.weights(plain, words)
        hit = weight > 0
        person = second.find(words.hash) >= 0
        insult = insults.find(words.hash) >= 0
        place = np.flatnonzero(person)
        f = out[lo:hi]
        np.maximum.at(f[:, 0], row, weight)
        hits = _per_row(hit, row, n)
        f[:, 1], f[:, 2], f[:, 3] = hits, hits / count, _per_row(weight, row, n) / count
        if len(place):
            at = np.searchsorted(place, np.flatnonzero(hit))
            spot = np.flatnonzero(hit)
            for side in (np.maximum(at - 1, 0), np.minimum(at, len(place) - 1)):
                close = (np.abs(place[side] - spot) <= NEAR) & (row[place[side]] == row[spot])
                f[:, 4] = np.maximum(f[:, 4], np.bincount(row[spot], close, minlength=n) / np.maximum(hits, 1))
        f[:, 5] = _per_row(person, row, n) / count
        f[:, 6] = _per_row(insult, row, n) / count
        f[:, 7] = np.log1p(count * (np.diff(words.first) > 0))
        once = np.unique(row[hit].astype(np.uint64) << np.uint64(40) | words.hash[hit] >> np.uint64(24))
        f[:, 8] = np.bincount((once >> np.uint64(40)).astype(np.int64), minlength=n)
        size = np.maximum(np.diff(run.starts) - 1, 1)
        rows = np.repeat(np.arange(n), np.diff(raw.starts))
        letters = np.maximum(_per_row(_ALPHA[raw.data], rows, n), 1)
        f[:, 9] = _per_row(_UPPER[raw.data], rows, n) / letters
        rows = np.repeat(np.arange(n), np.diff(run.starts))
        f[:, 10] = _per_row(run.data == 33, rows, n) / size
        f[:, 11] = _per_row(run.data == 63, rows, n) / size
        f[:, 12] = _per_row(_MARK[run.data], rows, n) / size
        digits = np.concatenate(([0], np.cumsum(_DIGIT[run.data])))
        within = digits[words.end] - digits[words.start]
        mixed = (within > 0) & (within < words.end - words.start)
        f[:, 13] = _per_row(mixed, row, n) / count
        alpha, marks = _ALPHA[run.data], _MARK[run.data]
        inner = np.zeros(len(alpha), bool)
        inner[1:-1] = marks[1:-1] & alpha[:-2] & alpha[2:]
        f[:, 14] = _per_row(inner, rows, n) / count
        long = np.zeros(len(alpha), bool)
        long[2:] = alpha[2:] & (run.data[2:] == run.data[1:-1]) & (run.data[2:] == run.data[:-2])
        f[:, 15] = _per_row(long, rows, n) / count
    return out


def learn_lexicon(sample: DataFrame, least: int = 3, weight: float = 2.5, most: int = 200_000) -> list[Lexicon]:
    """Lexicons of the sample without each of its PARTS, and of the whole. A stem enters with at least
    so many toxic texts and such a log ratio of its rates. Counts are of texts, summed in Spark; the
    driver sees stems of at least so many toxic texts, the commonest `most` of them."""

    columns = [f"n{k}" for k in range(PARTS)]

    def run(batches: Iterator[pa.RecordBatch], only: HashSet | None = None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(1).to_numpy().astype(np.int64)
            for lo, _, texts in text_runs(batch.column(0)):
                plain, words = _plain_words(texts)
                found = []
                for h in stems(plain, words):
                    row = words.row
                    if only is not None:
                        keep = only.find(h) >= 0
                        h, row = h[keep], row[keep]
                    pairs = np.empty(len(h), [("h", np.uint64), ("row", np.int64)])
                    pairs["h"], pairs["row"] = h, row + lo
                    found.append(pairs)
                pairs = np.unique(np.concatenate(found))
                owner = part[pairs["row"]]
                stem, at = np.unique(pairs["h"], return_inverse=True)
                n = [pa.array(np.bincount(at[owner == k], minlength=len(stem))) for k in range(PARTS)]
                yield pa.RecordBatch.from_arrays([pa.array(stem.view(np.int64)), *n], names=["stem", *columns])

    def counted(y: int, only: HashSet | None) -> DataFrame:
        rows = sample.filter(F.col("y") == y).select("text", "part")
        schema = ", ".join(f"{c} long" for c in ("stem", *columns))
        return rows.mapInArrow(lambda b: run(b, only), schema).groupBy("stem").agg(*(F.sum(c).alias(c) for c in columns))

    texts = F.expr(" + ".join(columns))
    toxic = counted(1, None).filter(texts >= least).orderBy(texts.desc(), "stem").limit(most).toArrow()
    stem = toxic["stem"].to_numpy().view(np.uint64)
    order = np.argsort(stem)
    stem = stem[order]
    pos = np.stack([toxic[c].to_numpy()[order] for c in columns]).astype(float)
    clean = counted(0, HashSet(stem)).toArrow()
    neg = np.zeros_like(pos)
    at = np.searchsorted(stem, clean["stem"].to_numpy().view(np.uint64))
    for k, c in enumerate(columns):
        neg[k, at] = clean[c].to_numpy()
    totals = {(r["y"], r["part"]): r["count"] for r in sample.groupBy("y", "part").count().collect()}
    out = []
    for left_out in (*range(PARTS), None):
        parts = [k for k in range(PARTS) if k != left_out]
        p, q = pos[parts].sum(axis=0), neg[parts].sum(axis=0)
        n1, n0 = (sum(totals.get((y, k), 0) for k in parts) for y in (1, 0))
        w = np.log((p + 0.5) / (n1 + 1)) - np.log((q + 0.5) / (n0 + 1))
        keep = (p >= least) & (w >= weight)
        out.append(Lexicon(stem[keep], w[keep]))
    return out


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    folds: int = 4, held_fold: int = 2, threshold: float = 0.3, per_class: int = 8000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, and the columns in carry as they are.

    Fitted on about per_class labelled rows of each class at most, none of the held-out fold; each
    is described with a lexicon learnt from other rows, and scores are calibrated on trees that haven't
    seen the row.
    Null and empty texts have zero features and are scored like any. A null id is not held out and
    has no label. Without labels every score is 0.5, with labels of one class near that class. An
    empty docs table gives no rows; repeated rows each keep their row. Other columns are not read.
    """
    held = fold(F.col("doc_id"), folds) == held_fold
    picked = labelled_sample(docs, labels, label_col, held, per_class, id_col, text_col)
    sample = stash(picked.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(PARTS)).cast("int")), "toxic-sample")
    *partial, whole = learn_lexicon(sample)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(2).to_numpy()
            x = np.zeros((len(part), FEATURES))
            for k in range(PARTS):
                own = np.flatnonzero(part == k)
                x[own] = features(batch.column(3).take(pa.array(own)), partial[k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), FEATURES).cast(pa.list_(pa.float64()))],
                names=["doc_id", "y", "x"],
            )

    table = sample.select("doc_id", "y", "part", "text").mapInArrow(describe, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    y = table["y"].to_numpy().astype(float)
    x = np.array(table["x"].to_pylist(), float).reshape(len(y), FEATURES)
    quarter = np.random.default_rng(23).permutation(len(y)) % 4
    unseen = np.zeros(len(y))
    for q in range(4):
        unseen[quarter == q] = fit_boosted(x[quarter != q], y[quarter != q]).raw(x[quarter == q])
    model = fit_boosted(x, y)
    calibrated = fit_isotonic(unseen, y)

    inner = [f"__{i}" for i in range(len(carry))]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(i) for c, i in zip(carry, inner, strict=True))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = calibrated(model.raw(features(batch.column(1), whole)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), *batch.columns[2:]], names=["doc_id", "score", *inner])

    schema = StructType([rows.schema["doc_id"], StructField("score", DoubleType()), *(rows.schema[i] for i in inner)])
    scored = rows.mapInArrow(run, schema)
    kept = [F.col(i).alias(c) for c, i in zip(carry, inner, strict=True) if c != "doc_id"]
    return scored.select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), *kept,
    )
