"""Quality by ordinal cumulative-link regression on graded ratings.

With hashed text features x, weights w shared by all grades and thresholds
t1 < t2 < ..., P(grade > k) = 1 / (1 + exp(t_k - w x)).  That gives the expected
grade and the tail probability of the top grade, by which documents are selected.

Features are counts of lower-cased words, of their shapes (letters, digits and
each sign, runs taken together), of neighbouring shapes and of repeated words,
hashed to ``DIMENSIONS`` places, as square roots of their shares.  All words of
all texts are read.  The weights are fitted by full-batch Adam with a ridge on at
most ``TRAIN_EACH`` documents of each grade; grades are the values that the
ratings have, in order.

Null and empty texts have no features and are scored by the thresholds alone.
Without ratings of two grades every score is null and nothing is selected.
Repeated rows are each scored; an empty table gives an empty result; extra
columns pass through, but for those of the names that are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import sampled_ids, with_texts
from .shared import without
from .textvec import mixed, slices, word_hashes, words

DIMENSIONS, TRAIN_EACH, STEPS, RATE, RIDGE = 1 << 16, 2500, 200, 0.3, 2e-4

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 97
_SHAPE[48:58] = 48
_SHAPE[128:] = 97


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every feature occurrence."""
    low, starts, ends, at = words(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    if not len(row):
        return row, row
    h = word_hashes(low, starts, ends)
    shape = _SHAPE[low]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    place = np.cumsum(keep) - keep
    short = shape[keep]
    shapes = word_hashes(short, place[starts], place[ends - 1] + keep[ends - 1])
    near = row[1:] == row[:-1]
    pair = mixed(shapes[:-1] * np.uint64(3) + shapes[1:])[near]
    again = near & (h[1:] == h[:-1])
    parts = [(row, h), (row, shapes + np.uint64(1)), (row[1:][near], pair), (row[1:][again], np.full(again.sum(), 12345, np.uint64))]
    return np.concatenate([r for r, _ in parts]), (np.concatenate([x for _, x in parts]) & np.uint64(DIMENSIONS - 1)).astype(np.int64)


def sparse(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(first row, rows, places, values, number of rows) of a text column, slice by slice."""
    for at, data, offsets in slices(column):
        row, place = hashed(data, offsets)
        cell, n = np.unique(row * DIMENSIONS + place, return_counts=True)
        r = cell // DIMENSIONS
        total = np.bincount(row, minlength=len(offsets) - 1)
        yield at, r, cell % DIMENSIONS, np.sqrt(n / np.maximum(total, 1)[r]), len(offsets) - 1


@dataclass
class Ordinal:
    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, s: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k but the last."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - s[:, None], -50, 50)))

    def scores(self, column: pa.Array, least_grade: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected grade, probability of least_grade or more, and probability of the top grade of each row."""
        s = np.zeros(len(column))
        for at, r, place, value, n in sparse(column):
            s[at : at + n] = np.bincount(r, self.weights[place] * value, minlength=n)
        tail = self.tails(s)
        below = len(self.grades) - 1 if least_grade is None else sum(g < least_grade for g in self.grades)
        wanted = np.hstack([np.ones((len(s), 1)), tail, np.zeros((len(s), 1))])[:, below]
        return self.grades[0] + tail @ np.diff(self.grades), wanted, tail[:, -1]


def fitted(rows: np.ndarray, places: np.ndarray, values: np.ndarray, y: np.ndarray, grades: list[float]) -> Ordinal:
    """Weights and thresholds by Adam on the mean negative log-likelihood; grades count alike.

    Thresholds are the first one and the logs of the steps between them, which keeps them in order.
    """
    n, k = len(y), len(grades)
    share = np.array([n / k / max(1, (y == g).sum()) for g in range(k)])[y]
    share /= share.sum()
    w, first, steps = np.zeros(DIMENSIONS), -(k - 2) / 2.0, np.zeros(k - 2)
    m1, m2 = (np.zeros(DIMENSIONS + k - 1) for _ in range(2))
    for it in range(1, STEPS + 1):
        t = first + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
        s = np.bincount(rows, w[places] * values, minlength=n)
        tail = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(t - s[:, None], -50, 50))), np.zeros((n, 1))])
        over, under = tail[np.arange(n), y], tail[np.arange(n), y + 1]
        p = np.maximum(over - under, 1e-12)
        d_over, d_under = over * (1 - over), under * (1 - under)
        ds = -(d_over - d_under) / p * share
        gt = np.zeros(k - 1)
        np.add.at(gt, y[y > 0] - 1, (d_over / p * share)[y > 0])
        np.add.at(gt, y[y < k - 1], -(d_under / p * share)[y < k - 1])
        g = np.concatenate([np.bincount(places, ds[rows] * values, minlength=DIMENSIONS) + RIDGE * w, [gt.sum()], np.cumsum(gt[::-1])[::-1][1:] * np.exp(steps)])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = RATE * (1 - it / (STEPS + 1)) * (m1 / (1 - 0.9**it)) / (np.sqrt(m2 / (1 - 0.99**it)) + 1e-6)
        w, first, steps = w - step[:DIMENSIONS], first - step[DIMENSIONS], steps - step[DIMENSIONS + 1 :]
    return Ordinal(grades, w, first + np.concatenate([[0.0], np.cumsum(np.exp(steps))]))


def trained(docs: DataFrame, ratings: DataFrame) -> Ordinal | None:
    """A model from docs (doc_id, text) and ratings (doc_id, rating); None without two grades."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = [None] * batch.num_rows, [None] * batch.num_rows
            for at, r, place, value, n in sparse(batch.column(1)):
                cut = np.searchsorted(r, np.arange(n + 1))
                for i in range(n):
                    places[at + i] = place[cut[i] : cut[i + 1]].astype("<i4").tobytes()
                    values[at + i] = value[cut[i] : cut[i + 1]].astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "label", "places", "data"])

    sample = with_texts(docs, sampled_ids(ratings, F.col("rating").cast("double"), TRAIN_EACH)).select("doc_id", "text", "label")
    found = sorted((r["doc_id"], r["label"], bytes(r["places"]), bytes(r["data"])) for r in sample.mapInArrow(extract, "doc_id long, label double, places binary, data binary").collect())
    grades = sorted({r[1] for r in found})
    if len(grades) < 2:
        return None
    places = [np.frombuffer(r[2], "<i4") for r in found]
    rows = np.repeat(np.arange(len(found)), [len(p) for p in places])
    values = np.concatenate([np.frombuffer(r[3], "<f4") for r in found])
    return fitted(rows, np.concatenate(places).astype(np.int64), values, np.array([grades.index(r[1]) for r in found]), grades)


def graded(docs: DataFrame, model: Ordinal | None, least_grade: float | None = None, least_tail: float = 0.5) -> DataFrame:
    """docs with expected_grade, tail, top_tail and keep (tail >= least_tail), in the place of columns of these names.

    tail is the probability of least_grade or more (by default the highest grade), top_tail that of the highest grade.
    """
    docs = without(docs, "expected_grade", "tail", "top_tail", "keep")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    none = F.lit(None).cast("double")
    schema = docs.withColumns({"expected_grade": none, "tail": none, "top_tail": none, "keep": F.lit(None).cast("boolean")}).schema

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            n = batch.num_rows
            if model:
                expected, tail, top = model.scores(batch.column(at), least_grade)
                new = [pa.array(expected), pa.array(tail), pa.array(top), pa.array(tail >= least_tail)]
            else:
                new = [*[pa.nulls(n, pa.float64())] * 3, pa.array(np.zeros(n, bool))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "expected_grade", "tail", "top_tail", "keep"])

    return docs.mapInArrow(grade, schema)
