"""Repetition inside single documents by a log-likelihood ratio over hashed word sequences.

Every four-word sequence of a text is one feature: a hash bucket where it occurs for the first
time in its text, or a class by its number where it occurs again.  The trusted target are texts in
which nothing occurs again, the raw corpus is all texts.  A text's score is the mean over its
features of log(p_raw / p_target); whole texts, and all of them, are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.chunking import latest
from graphloom.llm.words import sequences, word_hashes
from graphloom.session import cut

BUCKETS = 4096  # hash buckets of first occurrences
CLASSES = 16  # second, third, ... occurrence; the last class holds all later ones


def features(text: str | None, n: int) -> tuple[np.ndarray, int]:
    """Feature of each sequence of a text, and the number of different sequences."""
    h = sequences(word_hashes(text), n)
    if not len(h):
        return np.zeros(0, np.int64), 0
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]]
    at = np.arange(len(s))
    rank = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.where(rank == 0, (s % np.uint64(BUCKETS)).astype(np.int64), BUCKETS + np.minimum(rank, CLASSES) - 1)
    return out, int(new.sum())


def feature_counts(docs: DataFrame, n: int) -> np.ndarray:
    """Counts of each feature: row 0 in all texts, row 1 in trusted ones.  At most 4112 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS + CLASSES), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                f, different = features(text, n)
                c = np.bincount(f, minlength=BUCKETS + CLASSES)
                counts[0] += c
                if different == len(f):
                    counts[1] += c
        used = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[0][used]), pa.array(counts[1][used])], names=["feature", "raw", "target"])

    total = np.zeros((2, BUCKETS + CLASSES), np.int64)
    rows = docs.select("content").mapInArrow(run, "feature int, raw long, target long").groupBy("feature").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    for r in rows.collect():
        total[:, r["feature"]] = r["raw"], r["target"]
    return total


def weights(counts: np.ndarray) -> np.ndarray:
    """log(p_raw / p_target) of each feature, with one added to every count."""
    p = (counts + 1) / (counts.sum(axis=1, keepdims=True) + counts.shape[1])
    return np.log(p[0] / p[1])


def least_score(w: np.ndarray, share: float) -> float:
    """No text whose repeated share is at least ``share`` scores below this."""
    again, first = w[BUCKETS:].min(), w[:BUCKETS].min()
    return float(min(share * again + (1 - share) * first, again)) - 1e-9


def repetition(summaries: DataFrame, min_share: float = 0.30, n: int = 4) -> DataFrame:
    """One row per id: n_sequences, repeated_share, score, repeated.

    ``summaries`` has id, content, last_updated; other columns are ignored.  A repeated id counts once,
    by its latest row.  ``repeated`` holds where the score reaches the deterministic threshold of
    ``min_share`` and the exact share confirms it.  Null, empty and short contents have share and score 0.
    """
    rows = summaries.select("id", "content", "last_updated").filter(F.col("id").isNotNull())
    docs = cut(latest(rows, "id", "last_updated", ["content"]).select("id", "content"))
    w = weights(feature_counts(docs, n))
    least = least_score(w, min_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, share, score = [], [], []
            for text in batch.column(1).to_pylist():
                f, different = features(text, n)
                size.append(len(f))
                share.append(1 - different / len(f) if len(f) else 0.0)
                score.append(float(w[f].mean()) if len(f) else 0.0)
            repeated = [bool(k) and b >= least and a >= min_share for k, a, b in zip(size, share, score)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(share, pa.float64()), pa.array(score, pa.float64()), pa.array(repeated, pa.bool_())], names=["id", "n_sequences", "repeated_share", "score", "repeated"])

    return docs.mapInArrow(run, "id string, n_sequences long, repeated_share double, score double, repeated boolean")
