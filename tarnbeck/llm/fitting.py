"""What the classifiers share: held-out rows and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def sample_by_class(rows: DataFrame, class_col: str, key_col: str, per_class: int, seed: int = 5) -> DataFrame:
    """About per_class rows of each class at most, picked by a hash of the key, so the sample is
    the same however the rows are dealt out. Classes are few: their counts go to the driver."""
    counts = rows.groupBy(class_col).count().collect()
    scale = 1 << 30
    lottery = F.pmod(F.xxhash64(key_col, F.lit(seed)), F.lit(scale))
    keep = F.lit(False)
    for r in counts:
        share = min(1.0, per_class / r["count"])
        keep = keep | ((F.col(class_col) == F.lit(r[class_col])) & (lottery < int(share * scale)))
    return rows.filter(keep)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, held_out: Column, per_class: int, id_col: str, text_col: str
) -> DataFrame:
    """(doc_id, text, y) of a bounded sample of labelled rows that are not held out. Labels other
    than 0 and 1 and null ids are no labels; of several labels of an id, 1 wins."""
    clean = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .filter("doc_id is not null and y in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .filter(~held_out)
    )
    picked = sample_by_class(clean, "y", "doc_id", per_class)  # at most about 2 * per_class ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(
        F.broadcast(picked), "doc_id"
    )


def squash(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def fit_platt(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins (Platt's targets), by Newton's method
    with a little ridge, so separable margins keep a finite slope."""
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta = np.zeros(2)
    design = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(rounds):
        p = squash(design @ theta)
        slope = design.T @ (p - goal) + 1e-3 * theta
        curve = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        theta -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])
