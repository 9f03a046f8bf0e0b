"""What the trained operators share: the split of labels, bounded samples, logistic calibration."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str) -> Column:
    """True where crc32 of the id's text leaves no rest by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def held_out_of(ids) -> np.ndarray:
    """The same of Python values."""
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0 for i in ids), bool, len(ids))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, per_class: int, max_bytes: int) -> tuple[list[tuple[int, bytes, int]], dict[int, int]]:
    """([(doc_id, text, 0 or 1)], training rows of each class).

    Training rows are those not held out, with a label of 0 or 1. Of each class
    the ``per_class`` first in hash order of the id are taken, without texts of
    over ``max_bytes``, so driver memory is bounded by both. Equal texts with
    equal labels count once.
    """
    train = labels.where(~held_out("doc_id") & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label_"))
    sizes = {r.label_: r.n for r in train.groupBy("label_").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = None
    for c in (0, 1):
        one = train.where(F.col("label_") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = one if ids is None else ids.unionByName(one)
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= max_bytes)
    rows = texts.join(F.broadcast(ids), "doc_id").collect()  # 2 * per_class ids
    seen = {(r.text, r.label_): r.doc_id for r in sorted(rows, key=lambda r: r.doc_id, reverse=True)}
    return sorted(((i, t.encode(), y) for (t, y), i in seen.items()), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[2])), sizes


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients, the constant last, by Newton's method."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + penalty * w
        hess = (a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        size = np.abs(step).max()
        w -= step * min(1.0, 5 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
