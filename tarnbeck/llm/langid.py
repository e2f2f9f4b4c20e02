"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (hash slots by languages, and the languages' shares of all labelled
texts as prior) is one array shipped to the executors; a
batch of texts is scored by gathering its slots and summing them per text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import fold, sample_by_class
from .textbits import Kept, Texts, mix, text_runs

SLOTS = 1 << 15
ORDERS = 3
_tables = Kept()


def _is_letter() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _tables["letters"]


def grams(run: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, row of the text, texts that have a letter): n-grams of 1 to ORDERS characters; runs
    of what is no letter count as one blank."""
    points = np.frombuffer(run.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate(([0], np.cumsum((run.data & 0xC0) != 0x80)))[run.starts]
    letter = _is_letter()[points]
    row = np.repeat(np.arange(len(run)), np.diff(starts))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    symbol = np.where(letter, points, 32)[keep].astype(np.uint64)
    row = row[keep]
    has = np.zeros(len(run), bool)
    has[row[symbol != 32]] = True
    slots, rows = [], []
    h = np.zeros(len(symbol), np.uint64)
    for n in range(1, ORDERS + 1):
        if n > len(symbol):
            break
        h = (h[:-1] if n > 1 else h) * np.uint64(0x9E3779B97F4A7C15) + symbol[n - 1 :]
        whole = row[: len(h)] == row[n - 1 :]
        slots.append((mix(h[whole] + np.uint64(n)) % np.uint64(SLOTS)).astype(np.int32))
        rows.append(row[: len(h)][whole])
    if not slots:
        return np.empty(0, np.int32), np.empty(0, np.int64), has
    return np.concatenate(slots), np.concatenate(rows), has


def fit_counts(sample: DataFrame, langs: list[str]) -> np.ndarray:
    """(language, slot) counts over sample (text, lang), summed in Spark before the driver sees
    them: at most SLOTS rows for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), SLOTS), np.int64)
        place = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            own = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for lo, hi, texts in text_runs(batch.column(0)):
                slot, row, _ = grams(texts)
                total += np.bincount(own[lo:hi][row] * SLOTS + slot, minlength=total.size).reshape(total.shape)
        lang, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(total[lang, slot])],
            names=["lang", "slot", "n"],
        )

    counts = sample.select("text", "lang").mapInArrow(run, "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    out = np.zeros((len(langs), SLOTS))
    out[table["lang"].to_numpy(), table["slot"].to_numpy()] = table["n"].to_numpy()
    return out


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    folds: int = 5, held_fold: int = 0, per_lang: int = 6000, smoothing: float = 0.5,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs; score is the posterior of the
    language predicted, 0 for `und`.

    Learnt from about per_lang texts of each language at most, none of the held-out fold. A text
    that is null or has no letter is `und`, as is every text if nothing is labelled. Ties go to the
    language that sorts first. A null id is not held out and not learnt from. Repeated rows each
    keep their row; an empty table gives no rows. Columns other than the three are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held = fold(F.col("doc_id"), folds) == held_fold
    known = rows.filter(~held & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    prior = np.log(np.array([sizes[x] for x in langs], float) / max(1, sum(sizes.values())))
    counts = fit_counts(sample_by_class(known, "lang", "doc_id", per_lang), langs) + smoothing
    table = np.log(counts / counts.sum(axis=1, keepdims=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [], []
            for _, _, texts in text_runs(batch.column(1)):
                slot, row, has = grams(texts)
                if not len(langs):
                    pred += ["und"] * len(texts)
                    score += [0.0] * len(texts)
                    continue
                fit = np.stack([np.bincount(row, lang[slot], minlength=len(texts)) for lang in table], axis=1) + prior
                best = fit.argmax(axis=1)
                share = 1.0 / np.exp(np.maximum(fit - fit.max(axis=1, keepdims=True), -700.0)).sum(axis=1)
                pred += [langs[b] if ok else "und" for b, ok in zip(best, has, strict=True)]
                score += np.where(has, share, 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    out = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
