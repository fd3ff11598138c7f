"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.decontaminate import APART
from foliant.llm.kernels import LOW_BYTES, LOWER, M1, column_bytes, eights, mixed, pieces, span_hashes, spans
from foliant.llm.shared import stored

#: Labelled rows that the classifier is fitted on at most (the least hashes of doc_id), and grades.
SAMPLE, GRADES = 12_000, 3
#: A word or a beginning of words is a feature if labelled toxic texts have it more often than others by so many standard errors, and at least so many of them.
SCORE, LEAST = 5.0, 4
#: Features at most: the words and beginnings of the highest scores.
FEATURES = 4096
#: Bytes of the beginnings of a word: inflected and compound words, each of them rare, share those of their stem.
BEGINNINGS = (4, 5, 6, 7, 8)
APART_BY = np.array(BEGINNINGS, dtype=np.uint64) * M1
#: Precision of the normal prior of each weight, against the sum over all labelled texts: it doesn't grow with their number.
PRIOR = 0.25
#: Texts of this expected severity or more are rejected.
REJECT = 0.5


@dataclass(frozen=True)
class Ordinal:
    """P(grade <= k) = 1 / (1 + exp(weights . x - thresholds[k])), one weight vector for all thresholds; x: log(1 + count) of each word or beginning of words."""

    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def over(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, given weights . x."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - x[:, None], -60, 60)))

    def linear(self, hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """weights . x of each row, from the hashes of all its words and their beginnings."""
        if not len(self.words) or not len(hashes):
            return np.zeros(rows)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        hit = self.words[at] == hashes
        pair, count = np.unique(row[hit] * len(self.words) + at[hit], return_counts=True)
        return np.bincount(pair // len(self.words), weights=np.log1p(count) * self.weights[pair % len(self.words)], minlength=rows)


def fit(words: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, grades: int = GRADES, steps: int = 400, rate: float = 0.1, decay: float = 1e-3) -> Ordinal:
    """words: the sorted hashes of the features; rows: which of them each labelled text has, and how often; toxic: 0 or 1.

    Labels say toxic or not; the grade of a toxic text is 1 plus how many of the middle quantiles (of toxic texts) its count
    of features exceeds. Without features every grade is 0.
    """
    if not len(words):
        return Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.full(grades - 1, 60.0))
    sizes = np.array([len(r[0]) for r in rows], dtype=np.int64)
    r = np.repeat(np.arange(len(rows)), sizes)
    f = np.concatenate([np.zeros(0, np.int64), *(r[0] for r in rows)])
    c = np.concatenate([np.zeros(0), *(r[1] for r in rows)])
    hits = np.bincount(r, weights=c, minlength=len(rows))
    cuts = np.quantile(hits[toxic == 1], np.arange(1, grades - 1) / (grades - 1))
    y = np.where(toxic == 1, 1 + (hits[:, None] > cuts).sum(axis=1), 0)
    x, n = np.log1p(c), len(words)
    # thresholds are the first one and the logs of the steps between them, so they keep their order
    theta = np.concatenate([np.zeros(n), [1.0], np.zeros(grades - 2)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        thresholds = np.cumsum(np.concatenate([theta[n : n + 1], np.exp(theta[n + 1 :])]))
        eta = np.bincount(r, weights=x * theta[f], minlength=len(rows))
        below = np.column_stack([np.zeros(len(rows)), 1 / (1 + np.exp(np.clip(eta[:, None] - thresholds, -60, 60))), np.ones(len(rows))])
        lo, hi = below[np.arange(len(rows)), y], below[np.arange(len(rows)), y + 1]
        prob = np.maximum(hi - lo, 1e-12)
        slope = below * (1 - below)  # of below by its threshold
        d_hi, d_lo = slope[np.arange(len(rows)), y + 1] / prob, slope[np.arange(len(rows)), y] / prob
        d_eta = (d_hi - d_lo) / len(rows)  # of the mean negative log likelihood
        d_thr = np.zeros(grades - 1)
        for k in range(grades - 1):
            d_thr[k] = (np.where(y == k + 1, d_lo, 0) - np.where(y == k, d_hi, 0)).sum() / len(rows)
        tail = np.cumsum(d_thr[::-1])[::-1]
        g = np.concatenate([np.bincount(f, weights=x * d_eta[r], minlength=n) + decay * theta[:n], [tail[0]], tail[1:] * np.exp(theta[n + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    thresholds = np.cumsum(np.concatenate([theta[n : n + 1], np.exp(theta[n + 1 :])]))
    return Ordinal(words, theta[:n], thresholds)


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, last row + 1, hashes of their words, each followed by those of its beginnings, and where each row's begin."""
    data, offsets = column_bytes(column)
    for a, b, part, at in pieces(data, offsets):
        low = LOWER[part]
        starts, ends, rows = spans(low, at, APART)
        first, sizes = eights(low)[starts], ends - starts
        hashes, there = np.empty((len(starts), 1 + len(BEGINNINGS)), np.uint64), np.ones((len(starts), 1 + len(BEGINNINGS)), bool)
        hashes[:, 0] = span_hashes(low, starts, ends)
        for k, n in enumerate(BEGINNINGS):
            hashes[:, k + 1] = mixed((first & LOW_BYTES[n]) ^ APART_BY[k])
            there[:, k + 1] = sizes >= n
        yield a, b, hashes[there], np.append(0, np.cumsum(there.sum(axis=1)))[rows]


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """toxic, text: at most ``sample`` labelled texts, those with the least hashes of doc_id; of rows with one id the least text, of several labels the highest."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    return stored(found.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text"), "labelled")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES) -> Ordinal:
    """Fits on at most ``sample`` labelled rows; labels: doc_id, toxic (null: no label).

    Words and their beginnings are counted and chosen by Spark; the driver gets the chosen ones (``most`` at most, by score) and, of
    each labelled text, which of them it has.
    """
    texts = labelled(docs, labels, sample)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for a, b, hashes, rows in _words(batch.column("text")):
                row = np.repeat(np.arange(a, b), np.diff(rows))
                order = np.lexsort((row, hashes))
                word, row = hashes[order], row[order]
                new = np.r_[True, (word[1:] != word[:-1]) | (row[1:] != row[:-1])] if len(word) else np.zeros(0, bool)
                words, which = np.unique(word[new], return_inverse=True)
                bad = np.bincount(which, weights=toxic[row[new]], minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(bad), pa.array(np.bincount(which, minlength=len(words)) - bad)], names=["word", "bad", "good"])

    totals = dict(texts.groupBy("toxic").count().collect())
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return fit(np.zeros(0, np.uint64), [], np.zeros(0))
    both = (F.col("bad") + F.col("good")) / (bad + good)
    z = (F.col("bad") / bad - F.col("good") / good) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-12)) * (1 / bad + 1 / good))
    words = texts.mapInArrow(counted, "word long, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    chosen = words.where((F.col("bad") >= LEAST) & (z >= SCORE)).orderBy(z.desc(), "word").limit(most).select("word").collect()
    features = np.sort(np.array([r[0] for r in chosen], dtype=np.int64).view(np.uint64))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, out = batch.column("toxic").to_pylist(), []
            for a, b, hashes, rows in _words(batch.column("text")):
                for i in range(a, b):
                    own = hashes[rows[i - a] : rows[i - a + 1]]
                    at, counts = np.unique(np.searchsorted(features, own[np.isin(own, features)]), return_counts=True)
                    out.append((toxic[i], at.astype("<i4").tobytes(), counts.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["toxic", "at", "counts"])

    if not len(features):
        return fit(features, [], np.zeros(0))
    rows = sorted(tuple(r) for r in texts.mapInArrow(held, "toxic int, at binary, counts binary").collect())  # an order that does not depend on the layout
    counts = [(np.frombuffer(r[1], "<i4").astype(np.int64), np.frombuffer(r[2], "<u4").astype(float)) for r in rows]
    return fit(features, counts, np.array([r[0] for r in rows], dtype=np.int64), decay=PRIOR / len(rows))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, reject: float = REJECT) -> DataFrame:
    """The rows of docs with severity (expected grade, 0 to 2), grade (the likeliest) and rejected added.

    docs: doc_id, text and any other columns; those named like an added one give way to it. A null or blank text has no features, like a text without any
    toxic word. Repeated rows get the same result; an empty table gives no rows; without usable labels nothing is rejected.
    """
    model = train(docs, labels, sample)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("severity", "grade", "rejected")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            severity, grade = [np.zeros(0)], [np.zeros(0, np.int32)]
            for a, b, hashes, rows in _words(batch.column("text")):
                over = model.over(model.linear(hashes, np.repeat(np.arange(b - a), np.diff(rows)), b - a))
                p = -np.diff(np.column_stack([np.ones(b - a), over, np.zeros(b - a)]), axis=1)
                severity.append(over.sum(axis=1))
                grade.append(p.argmax(axis=1).astype(np.int32))
            severity = np.concatenate(severity)
            added = [pa.array(severity), pa.array(np.concatenate(grade)), pa.array(severity >= reject)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "severity", "grade", "rejected"])

    from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("severity", DoubleType()), StructField("grade", IntegerType()), StructField("rejected", BooleanType())])
    return docs.mapInArrow(score, schema)
