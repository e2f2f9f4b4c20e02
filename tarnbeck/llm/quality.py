"""Quality classifier: naive Bayes support vectors.

Features are indicators of three groups of n-grams: words (1 and 2, lower case), characters (3 bytes
each, lower case), and kinds of characters (1 to 4; letters count as one symbol, marks as themselves),
which carry over to words never seen, along with repeated words. Each is scaled by its class
log-count ratio; groups are brought to length 1 each, so that none drowns the others, and a linear
hinge-loss model is fitted by dual coordinate descent (Wang and Manning, 2012; Hsieh et al., 2008).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import fit_platt, fold, labelled_sample, squash
from .textbits import INK_BYTES, Texts, find_words, fold_case, mix, pair, text_runs

#: Slots of a group of features; feature numbers of group g lie from g * WIDTH.
WIDTH = 1 << 18
GROUPS = 3
KIND_ORDERS, WORD_ORDERS, CHARACTERS = 4, 2, 3


def _kind(b: int) -> int:
    c = chr(b)
    if b >= 128 or c.islower():
        return 1
    if c.isupper():
        return 2
    if c.isdigit():
        return 3
    if c in " \t":
        return 4
    if c in "\r\n":
        return 5
    return b if b > 32 else 6


KINDS = np.array([_kind(b) for b in range(256)], np.uint8)


def _runs(symbol: np.ndarray, row: np.ndarray, orders: int, salt: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, text) of the n-grams of 1 to orders symbols that lie in one text."""
    h = mix(symbol + np.uint64(salt))
    for n in range(1, orders + 1):
        if n > 1:
            h = pair(h[:-1], symbol[n - 1 :])
        whole = row[: len(h)] == row[n - 1 :]
        yield h[whole], row[: len(h)][whole]


def _kinds(run: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    kind = KINDS[run.data]
    head = np.ones(len(kind), bool)
    head[1:] = (kind[1:] != kind[:-1]) | (kind[1:] > 8)
    at = np.flatnonzero(head)
    symbol, row = kind[at].astype(np.uint64), run.row_of(at)
    real = at != run.starts[row + 1] - 1  # not the newline that ends a text
    yield from _runs(symbol[real], row[real], KIND_ORDERS, 1000)
    words = find_words(run, INK_BYTES)
    twice = words.row[1:][(words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])]
    yield np.full(len(twice), mix(np.array([7], np.uint64))[0]), twice


def _characters(run: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data = run.data.astype(np.uint64)
    code = data[: max(0, len(data) - CHARACTERS + 1)]
    for k in range(1, CHARACTERS):
        code = code * np.uint64(256) + data[k : k + len(code)]
    row = np.repeat(np.arange(len(run)), np.diff(run.starts))[: len(code)]
    inside = np.arange(len(code)) + CHARACTERS < run.starts[row + 1]
    yield mix(code[inside]), row[inside]


def indicators(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct feature numbers; none for null and empty texts."""
    for lo, hi, run in text_runs(texts, lower=False):
        low = fold_case(run)
        words = find_words(low)
        groups = _runs(words.hash, words.row, WORD_ORDERS, 2000), _characters(low), _kinds(run)
        coded = [
            np.unique(row * (GROUPS * WIDTH) + (h % np.uint64(WIDTH)).astype(np.int64) + g * WIDTH)
            for g, found in enumerate(groups) for h, row in found
        ]
        all_of = np.unique(np.concatenate(coded))
        yield from np.split(all_of % (GROUPS * WIDTH), np.searchsorted(all_of, np.arange(1, hi - lo) * (GROUPS * WIDTH)))


def group_scale(x: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """For each of a text's features, 1 over the length of its group in the scaled row."""
    size = np.sqrt(np.bincount(x // WIDTH, np.square(ratio[x]), minlength=GROUPS))
    return np.divide(1.0, size, out=np.zeros(GROUPS), where=size > 0)[x // WIDTH]


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # per feature, the log-count ratio included
    ratio: np.ndarray
    offset: float
    slope: float
    shift: float

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self._margin(x) for x in rows], np.float64)

    def _margin(self, x: np.ndarray) -> float:
        return float(self.weight[x] @ group_scale(x, self.ratio) + self.offset)

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return squash(self.slope * self.margins(rows) + self.shift)


def descend(
    rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, width: int, c: float, epochs: int, rng: np.random.Generator
) -> tuple[np.ndarray, float]:
    """Weights and offset that minimise half their square plus c times the summed hinge losses, by
    coordinate descent in the dual. Row i has values[i] at rows[i], 1 for the offset, and the sign
    of its class."""
    w, offset, dual = np.zeros(width), 0.0, np.zeros(len(rows))
    squares = [float(v @ v) + 1.0 for v in values]
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = sign[i] * (v @ w[x] + offset) - 1.0
            moved = min(max(dual[i] - slope / squares[i], 0.0), c)
            if moved != dual[i]:
                step = (moved - dual[i]) * sign[i]
                w[x] += step * v
                offset += step
                dual[i] = moved
    return w, offset


def fit(rows: list[np.ndarray], y: np.ndarray, c: float = 10.0, epochs: int = 12, seed: int = 3) -> Model:
    """y in {0, 1}. A fifth of the rows only calibrates the score. With rows of one class only, the
    score is that class's everywhere."""
    if not len(y) or y.min() == y.max():
        only = 0.5 if not len(y) else float(y[0])
        return Model(np.zeros(GROUPS * WIDTH), np.zeros(GROUPS * WIDTH), 0.0, 0.0, 35.0 * (2 * only - 1))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    learn, calibrate = order[len(y) // 5 :], order[: len(y) // 5]
    if y[learn].min() == y[learn].max():
        learn = order
    counts = np.ones((2, GROUPS * WIDTH))
    for i in learn:
        counts[y[i], rows[i]] += 1
    ratio = np.zeros(GROUPS * WIDTH)
    for g in range(GROUPS):  # each group is a bag of its own
        own = counts[:, g * WIDTH : (g + 1) * WIDTH]
        ratio[g * WIDTH : (g + 1) * WIDTH] = np.log(own[1] / own[1].sum()) - np.log(own[0] / own[0].sum())
    values = [ratio[rows[i]] * group_scale(rows[i], ratio) for i in learn]
    w, offset = descend([rows[i] for i in learn], values, np.where(y[learn] == 1, 1.0, -1.0), GROUPS * WIDTH, c, epochs, rng)
    model = Model(w * ratio, ratio, offset, 1.0, 0.0)
    part = calibrate if len(calibrate) and y[calibrate].min() < y[calibrate].max() else learn
    return Model(w * ratio, ratio, offset, *fit_platt(model.margins([rows[i] for i in part]), y[part]))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 5, held_fold: int = 0, threshold: float = 0.3, per_class: int = 4000,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Fitted on about per_class labelled rows of each class at most, none of the held-out fold. Null
    and empty texts have no features and the score of the model's offset. A null id is not held
    out and has no label. An empty docs table gives no rows; without labels every score is 0.5.
    Repeated rows each keep their row. Columns other than those named are not read.
    """
    held = fold(F.col("doc_id"), folds) == held_fold
    sample = labelled_sample(docs, labels, label_col, held, per_class, id_col, text_col)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.astype(np.int32) for x in indicators(batch.column(0))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["x", "y", "doc_id"]
            )

    table = sample.select("text", "y", "doc_id").mapInArrow(extract, "x array<int>, y int, doc_id long").toArrow()
    table = table.sort_by("doc_id")
    rows = [x.values.to_numpy().astype(np.int64) for x in table["x"]]
    model = fit(rows, table["y"].to_numpy().astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(list(indicators(batch.column(1)))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, score double"
    )
    return scored.select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
