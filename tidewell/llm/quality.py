"""Quality by ordinal regression with cumulative links on graded ratings.

A text is the set of its hashed features with their shares: runs of four
bytes in which letters and digits stand for their kind, runs of three letters
as they are, and how much of its lines and words repeats.  All thresholds share
one weight vector: P(grade >= j) = sigmoid(w.x - t_j) with t_1 < t_2 < ...
The expected grade is the sum of these tail probabilities.

The model is fitted on a bounded sample of rated rows (``SAMPLE``, those with
the smallest hash of their id) in one task and has a fixed size; every text is
then scored whole where it lies, without a shuffle.

Null and empty texts have no features and get the scores of the thresholds
alone.  Ratings that are null or outside the grades are left out; without any
rating all weights are 0.  Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bounded, column_bytes, find_words, free, hash_words, mix, named

#: Rated rows that the model is fitted on, at most.
SAMPLE = 5_000
SLOTS = 1 << 16
#: Runs that a text seems to have more than it has: a few runs say little.
SHORT = 16
#: A document is selected if the tail probability of the wanted grade reaches this; low, to spare good documents.
KEEP = 0.2

_KIND = np.arange(256, dtype=np.uint64)
_KIND[97:123] = 97
_KIND[65:91] = 65
_KIND[48:58] = 48
_KIND[128:] = 128
_PLAIN = np.arange(256, dtype=np.uint64)
_PLAIN[65:91] += np.uint64(32)
_U = np.uint64


def _runs(codes: np.ndarray, k: int, family: int) -> np.ndarray:
    if len(codes) < k:
        return np.zeros(0, dtype=np.int32)
    h = np.zeros(len(codes) - k + 1, dtype=np.uint64)
    for j in range(k):
        h = (h << _U(8)) | codes[j : len(codes) - k + 1 + j]
    return (mix(h + _U(family << 40)) & _U(SLOTS - 1)).astype(np.int32)


def _level(family: int, share: float) -> int:
    return int(mix(np.array([family << 50 | int(10 * share)], dtype=np.uint64))[0] & _U(SLOTS - 1))


def features(data: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and shares of one text; each family of runs has shares that add up to 1, or less in a short text."""
    if not len(data):
        return np.zeros(0, dtype=np.int32), np.zeros(0)
    kinds, plain = _runs(_KIND[data], 4, 1), _runs(_PLAIN[data], 3, 2)
    lines = np.flatnonzero(data == 10)
    bounds = np.concatenate(([0], lines, [len(data)]))
    distinct_lines = len({data[a:b].tobytes().strip() for a, b in zip(bounds[:-1], bounds[1:], strict=True)})
    levels = [
        _level(3, len(np.unique(words)) / max(1, len(words))),
        _level(4, distinct_lines / (len(bounds) - 1)),
        _level(5, min(0.9, np.log10(1 + len(words)) / 6)),
    ]
    slots = np.concatenate((kinds, plain, levels)).astype(np.int32)
    shares = np.concatenate(
        (np.full(len(kinds), 1 / (len(kinds) + SHORT)), np.full(len(plain), 1 / (len(plain) + SHORT)), np.full(3, 0.1))
    )
    return slots, shares


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = column_bytes(column)
    starts, ends, first = find_words(data, offsets)
    hashes = hash_words(data, starts, ends)
    for i in range(len(column)):
        yield features(data[offsets[i] : offsets[i + 1]], hashes[first[i] : first[i + 1]])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(
    rows: np.ndarray, slots: np.ndarray, shares: np.ndarray, grades: np.ndarray, levels: int, steps: int = 300
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that fit the grades; one entry of rows/slots/shares per feature of a text.

    Adam on the likelihood; a threshold is the one before plus a positive step.
    """
    n = len(grades)
    weights, raw = np.zeros(SLOTS), np.zeros(levels - 1)
    if n:
        above = np.array([np.clip((grades >= j).mean(), 0.01, 0.99) for j in range(1, levels)])
        first = -np.log(above / (1 - above))
        raw = np.concatenate((first[:1], np.log(np.maximum(np.diff(first), 1e-2))))
    # A part of the entries at a time bounds what a step holds.
    parts = [slice(a, a + (1 << 20)) for a in range(0, len(rows), 1 << 20)]
    state = [np.zeros(SLOTS), np.zeros(SLOTS), np.zeros(levels - 1), np.zeros(levels - 1)]
    for step in range(1, (steps if n else 0) + 1):
        thresholds = np.concatenate((raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))))
        score = np.zeros(n)
        for part in parts:
            score += np.bincount(rows[part], weights=shares[part] * weights[slots[part]], minlength=n)
        tail = sigmoid(score[:, None] - thresholds[None, :])
        tails = np.hstack((np.ones((n, 1)), tail, np.zeros((n, 1))))
        at = np.arange(n)
        chance = np.maximum(tails[at, grades] - tails[at, grades + 1], 1e-12)
        slope = tails * (1 - tails)
        d_score = -(slope[at, grades] - slope[at, grades + 1]) / chance / n
        d_threshold = np.zeros(levels - 1)
        for j in range(1, levels):
            d_threshold[j - 1] = (slope[:, j] / chance * ((grades == j).astype(float) - (grades == j - 1))).sum() / n
        d_raw = np.concatenate(
            ([d_threshold.sum()], [d_threshold[j:].sum() * np.exp(raw[j]) for j in range(1, levels - 1)])
        )
        d_weights = 1e-7 * weights
        for part in parts:
            d_weights += np.bincount(slots[part], weights=shares[part] * d_score[rows[part]], minlength=SLOTS)
        for value, slope_of, m, v, rate in (
            (weights, d_weights, state[0], state[1], 0.5),
            (raw, d_raw, state[2], state[3], 0.05),
        ):
            m += 0.1 * (slope_of - m)
            v += 0.01 * (slope_of**2 - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    return weights, np.concatenate((raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))))


def fit(
    documents: DataFrame, ratings: DataFrame, levels: int = 2, sample: int = SAMPLE
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from documents (doc_id, text) and their ratings (id, grade from 0 to levels - 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, slots, shares, grades = [], [], [], []
        for batch in bounded(batches, "text"):
            grades += batch.column("grade").to_pylist()
            for s, v in _texts(batch.column("text")):
                used, back = np.unique(s, return_inverse=True)
                slots.append(used.astype(np.uint16))
                shares.append(np.bincount(back, weights=v).astype(np.float32))
                rows.append(np.full(len(used), len(rows), dtype=np.int32))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        weights, thresholds = fit_ordinal(
            join(rows, np.int32), join(slots, np.uint16), join(shares, np.float32), np.array(grades, dtype=np.int64), levels
        )
        yield pa.record_batch([pa.array([weights.tolist()]), pa.array([thresholds.tolist()])], ["w", "t"])

    valid = ratings.where(F.col("grade").between(0, levels - 1) & F.col("id").isNotNull())
    ordered = valid.withColumn("order", F.xxhash64("id")).orderBy("order", "id", "grade").limit(sample)
    # At most ``sample`` pairs of numbers.
    chosen = F.broadcast(ordered.select("id", F.col("grade").cast("long")))
    texts = named(documents, id="doc_id", text="text").join(chosen, "id").select("text", "grade").limit(sample)
    model = texts.repartition(1).mapInArrow(run, "w array<double>, t array<double>")
    row = model.first()
    if row is None:
        return np.zeros(SLOTS), np.arange(levels - 1, dtype=float)
    return np.array(row["w"]), np.array(row["t"])


def score(documents: DataFrame, weights: np.ndarray, thresholds: np.ndarray) -> DataFrame:
    """All columns plus expected_grade and tail (P(grade >= j) for each j from 1), the last two in any case."""
    small = weights.astype(np.float32)
    schema = documents.schema.names
    results = [free("expected_grade", schema), free("tail", schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            scores = np.array([float(v @ small[s]) for s, v in _texts(batch.column("text"))])
            tail = sigmoid(scores[:, None] - thresholds[None, :])
            yield pa.record_batch(
                [*batch.columns, pa.array(tail.sum(axis=1)), pa.array(tail.tolist(), pa.list_(pa.float64()))],
                [*schema, *results],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.mapInArrow(run, f"{kinds}, `{results[0]}` double, `{results[1]}` array<double>")


def rate(documents: DataFrame, ratings: DataFrame, levels: int = 2, wanted: int = 1, keep: float = KEEP) -> DataFrame:
    """Scores all documents by a model fitted on those that ratings (id, grade) name.

    Adds expected_grade, tail and, last, selected: tail probability of the wanted grade is at least ``keep``.  Where
    the documents have such a column, the name of ours ends in an underscore.
    """
    scored = score(documents, *fit(documents, ratings.select("id", "grade"), levels))
    chosen = F.element_at(scored.columns[-1], wanted) >= keep
    return scored.withColumn(free("selected", scored.columns), chosen)
