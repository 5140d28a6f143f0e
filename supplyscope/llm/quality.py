"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades come from ``labels``: 0 for low quality, 1 for good quality but toxic, 2 for good and clean.
The model has one weight for each hashed feature, shared by all grades, and an ascending threshold
below each grade but the lowest:

    P(grade >= k) = sigmoid(score - threshold_k),  score = sum of the weights of the text's features.

The expected grade is the sum of these probabilities over k; the last of them, the tail, is the
probability of the best grade.  Features are the presence of words (lower-cased A-Z, split at ASCII
white space and signs, 64-bit hash cut to ``BITS`` bits) and, hashed the same way, of the beginnings of words
(``BEGINNINGS`` bytes, so that rare inflected forms of one stem count together) and a bin for each of some shares
of the whole text: capitals, signs, digits, the bar, repeated words, bytes a word.

The model is fitted on at most ``MAX_LABELLED`` labelled documents, those of the smallest hashes of
their doc_id, with an absolute-value penalty in proportion to the chance deviation of a feature's slope,
so that chance words get no weight and a clear marker in ``MIN_DOCUMENTS`` documents does, however many
are fitted; words in fewer have none.  Scoring covers every
document and its whole text.

Defined results: a null or empty text has the features of no words; a doc_id with several labels has
the lowest of their grades; labels with a null rating are not used; without labels of two grades there
is nothing to learn: every score is 0 and every tail 1, so nothing is rejected.  Repeated rows score
alike.  An empty table gives an empty result.  Other columns pass through ``select_documents``; the
working columns are made under names that no column has.

Scale: one pass over the texts to score, no shuffle; only the features with a weight go to the workers (a few
hundred numbers), and the sample's doc_ids are a bounded table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.llm import textops as T

BITS = 20
#: Bound of the labelled documents that the model is fitted on.
MAX_LABELLED = 10_000
MIN_DOCUMENTS = 4
#: Labelled documents whose features are worked on together.
BLOCK_ROWS = 1000
#: Bytes of the word beginnings that are features beside the whole words.
BEGINNINGS = (4, 5, 6, 7, 8, 9, 10)
#: Steps with the penalty and, for the picked features alone, without.
ROUNDS = 200
MORE_ROUNDS = 600
RATE = 0.05
#: The penalty of a feature, in standard deviations of its slope at the start if it told nothing.
PENALTY = 1.3
SHRINK = 1e-4
#: Documents with at least this probability of the best grade are selected.
THRESHOLD = 0.5

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 capital, 2 sign, 3 digit, 4 bar
_CLASS[65:91] = 1
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), 123, 125, 126]] = 2
_CLASS[48:58] = 3
_CLASS[124] = 4
#: Upper ends of the bins of a share.
_BINS = np.array([0.0, 0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])


@dataclass
class Model:
    """The features with a weight, their weights, and ascending thresholds, the k-th below grade k + 1."""

    used: np.ndarray
    values: np.ndarray
    thresholds: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        """Weights by feature."""
        out = np.zeros(1 << BITS)
        out[self.used] = self.values
        return out


def _bin_features(shares: np.ndarray) -> np.ndarray:
    """Features (rows, shares) for binned shares (rows, shares)."""
    of = np.searchsorted(_BINS, shares, "left").astype(np.uint64)
    kind = np.arange(shares.shape[1], dtype=np.uint64)[None, :]
    return (T.mix((kind << np.uint64(8)) + of + np.uint64(1 << 40)) >> np.uint64(64 - BITS)).astype(np.int64)


def _keys(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Row and feature of hashes, in one number."""
    return (row << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Chunks of (row within the chunk, feature), sorted and distinct, and the chunk's row count."""
    for lo, hi in T.chunks(offsets):
        rows = hi - lo
        raw, at = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        word, row, beginnings = T.words_and_beginnings(raw, at, T.SIGNS, BEGINNINGS)
        keys = np.unique(_keys(row, word))
        size = np.maximum(np.diff(at), 1)
        count = np.bincount(row, minlength=rows)
        kinds = _CLASS[raw]
        shares = np.empty((rows, 4))
        for c in range(4):
            before = np.concatenate([np.zeros(1, np.int32), np.cumsum(kinds == c + 1, dtype=np.int32)])
            shares[:, c] = (before[at[1:]] - before[at[:-1]]) / size
        distinct = np.bincount(keys >> BITS, minlength=rows)
        repeated = 1 - distinct / np.maximum(count, 1)
        length = np.minimum(count / size, 1)
        bins = _bin_features(np.column_stack([shares, repeated, length]))
        own = ((np.arange(rows)[:, None] << BITS) | bins).ravel()
        parts = [np.unique(_keys(of, part)) for part, of in beginnings]
        keys = np.unique(np.concatenate([keys, own, *parts]))
        yield keys >> BITS, keys & ((1 << BITS) - 1), rows


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(rows: list[np.ndarray], grades: np.ndarray) -> Model:
    """The model of rows of features and their grades 0, 1, ..., by full-batch gradient steps (Adam)."""
    top = int(grades.max()) if len(grades) else 0
    if len(np.unique(grades)) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(max(top, 2), -np.inf))
    # Blocks of rows: what a step needs beside the features themselves is then one block's only.
    groups = [(i, rows[i:i + BLOCK_ROWS]) for i in range(0, len(rows), BLOCK_ROWS)]
    seen = np.zeros(1 << BITS, np.int64)
    for _, group in groups:
        seen += np.bincount(np.concatenate(group), minlength=1 << BITS)
    column = np.full(1 << BITS, -1, np.int32)
    used = np.flatnonzero(seen >= MIN_DOCUMENTS)
    column[used] = np.arange(len(used))
    blocks = []
    for i, group in groups:
        index = column[np.concatenate(group)]
        held = index >= 0
        row = np.repeat(np.arange(i, i + len(group), dtype=np.int32), [len(r) for r in group])
        blocks.append((row[held], index[held]))
    n = len(rows)
    weights = np.zeros(len(used))
    # Start at the thresholds that give the shares of the grades without any feature.
    below = np.clip(np.array([(grades < k).mean() for k in range(1, top + 1)]), 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(below / (1 - below)) + 1e-3 * np.arange(top))
    steps = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    # The slope of a feature of m documents has a deviation in proportion to the root of m.
    away = _sigmoid(np.concatenate([start, [np.inf]]))[grades] + _sigmoid(np.concatenate([[-np.inf], start]))[grades] - 1
    scale = away.std() * np.sqrt(seen[used]) / n
    # First with the penalty, which picks the features; then those alone, with a small square penalty.
    for penalty, shrink, rounds in ((PENALTY, 0.0, ROUNDS), (0.0, SHRINK, MORE_ROUNDS)):
        if shrink:
            blocks = [(row[picked], index[picked]) for row, index in blocks for picked in [weights[index] != 0]]
        first, second = (np.zeros(len(used) + top) for _ in range(2))
        free = weights != 0 if shrink else np.ones(len(used), bool)
        for t in range(1, rounds + 1):
            gaps = np.exp(steps[1:])
            thresholds = np.concatenate([steps[:1], steps[0] + np.cumsum(gaps)])
            score = np.zeros(n)
            for row, index in blocks:
                score += np.bincount(row, weights[index], n)
            upper = np.concatenate([thresholds, [np.inf]])[grades] - score
            lower = np.concatenate([[-np.inf], thresholds])[grades] - score
            a, b = _sigmoid(upper), _sigmoid(lower)
            p = np.maximum(a - b, 1e-12)
            by_score = -(a + b - 1) / n
            by_upper, by_lower = -a * (1 - a) / p / n, b * (1 - b) / p / n
            by_threshold = (np.bincount(grades, by_upper, top + 1)[:top] + np.bincount(grades, by_lower, top + 1)[1:])
            later = np.cumsum(by_threshold[::-1])[::-1]
            by_weight = shrink * weights
            for row, index in blocks:
                by_weight = by_weight + np.bincount(index, by_score[row], len(used))
            gradient = np.concatenate([by_weight, later[:1], later[1:] * gaps])
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient ** 2
            rate = RATE / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-9)
            step = rate * first / (1 - 0.9 ** t)
            weights = np.where(free, weights - step[:len(used)], 0)
            weights = np.sign(weights) * np.maximum(np.abs(weights) - penalty * scale * rate[:len(used)], 0)
            steps = steps - step[len(used):]
    return Model(used[weights != 0], weights[weights != 0], np.concatenate([steps[:1], steps[0] + np.cumsum(np.exp(steps[1:]))]))


def probabilities(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ... (rows, thresholds)."""
    weights = model.weights
    scores = [np.bincount(row, weights[index], n) for row, index, n in features(data, offsets)]
    score = np.concatenate(scores) if scores else np.zeros(0)
    return _sigmoid(score[:, None] - model.thresholds[None, :])


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 low quality, 1 good but toxic, 2 good and clean."""
    return (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
            .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.min(F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).otherwise(2)).alias("grade")))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Fit the model on at most ``most`` labelled documents."""
    T.ship(docs.sparkSession)
    graded = grades_of(labels)
    # Only labels of given documents: the sample is full as long as enough of those are labelled.
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = graded.join(given, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        for batch in batches:
            data, offsets = T.utf8(batch.column(2))
            found = []
            for row, index, n in features(data, offsets):
                found += np.split(index.astype(np.int32), np.searchsorted(row, np.arange(1, n)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([f.astype("<i4").tobytes() for f in found], pa.binary())],
                names=["doc_id", "grade", "features"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The sample has at most ``most`` rows of two numbers, small enough for Spark to broadcast it by its size.
    sample = (texts.join(chosen, "doc_id").select("doc_id", "grade", "text")
              .mapInArrow(featured, "doc_id long, grade int, features binary"))
    rows = sample.collect()
    # Equal keys have equal features, or their order makes no difference worth a copy of all.
    rows.sort(key=lambda r: (r["doc_id"], r["grade"], len(r["features"]), zlib.crc32(r["features"])))
    return fit([np.frombuffer(r["features"], "<i4") for r in rows], np.array([r["grade"] for r in rows], np.int64))


def score(docs: DataFrame, model: Model, text: str = "text", grade: str = "expected_grade",
          tail: str = "p_best") -> DataFrame:
    """All columns, the expected grade and the probability of the best grade."""
    T.ship(docs.sparkSession)

    def one(texts: pa.Array) -> pa.Array:
        T.forget()
        p = probabilities(model, *T.utf8(texts))
        return pa.StructArray.from_arrays([pa.array(p.sum(axis=1)), pa.array(p[:, -1])], names=["grade", "tail"])

    # Or a filter on the result would be pushed below, and each text scored twice.
    one = F.arrow_udf(one, "struct<grade:double,tail:double>").asNondeterministic()

    both = "_" * max(map(len, docs.columns)) + "_scored"  # a name that no column has
    scored = docs.withColumn(both, one(F.col(text).cast("string")))
    return scored.withColumns({grade: F.col(both)["grade"], tail: F.col(both)["tail"]}).drop(both)


def select_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                     most: int = MAX_LABELLED) -> DataFrame:
    """The documents whose probability of the best grade reaches the threshold, all columns as they are."""
    names = docs.columns
    mark = "_" * max(map(len, names))
    scored = score(docs, train(docs, labels, most), grade=f"{mark}_grade", tail=f"{mark}_tail")
    return scored.where(F.col(f"{mark}_tail") >= threshold).select(*[F.col(f"`{c}`") for c in names])
