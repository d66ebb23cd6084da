"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document.

A document is three bags of hashed features: words, byte n-grams of words with their boundaries, and shapes of words
together with the shape before (length, case, punctuation, and whether a word repeats one of the two before it). The
vectors of each bag are averaged, and a softmax over the mean of the bags gives the label. Vectors and softmax are
trained by stochastic gradient descent in numpy, on the driver, on a bounded sample of labelled rows.

Since the softmax is linear in the vectors, a trained model is one number per feature; tasks get only these, and a
document's score is a mean of table look-ups. Every text is scored whole.

Null texts count as empty; an empty text gets the score of the bias alone. Repeated rows are scored each. Without
labelled rows of both kinds every score is the share of label 1, or 0.5 without any. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import LOWER, SPACE, Hashes, chunks, mix, words
from .common import held_out, labelled_sample, python_tasks, table, with_text

#: Labelled rows of each label value that training takes at most.
SAMPLE = 4_000
BUCKETS = 1 << 17
WIDTH = 16
GRAMS = (2, 4)
THRESHOLD = 0.3
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


def features(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each bag, feature numbers and their rows, in order of rows."""
    mask = np.uint64(BUCKETS - 1)
    start, end, row = words(data, off)
    exact = Hashes(data).of(start, end)
    lower = Hashes(LOWER[data])
    out = [((lower.of(start, end) & mask).astype(np.int64), row)]
    # n-grams within a document, but not of white space alone or across two words
    n, grams, rows = len(data), [], []
    gap = np.concatenate([[0], np.cumsum(SPACE[data])])
    of_row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for k in GRAMS:
        at = np.arange(max(0, n - k + 1))
        inside = (gap[at + k] - gap[at] <= 1) & (of_row[at] == of_row[at + k - 1])
        at = at[inside]
        grams.append(((lower.of(at, at + k) + np.uint64(k)) & mask).astype(np.int64))
        rows.append(of_row[at])
    grams, rows = np.concatenate(grams), np.concatenate(rows)
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    out.append((grams[order], rows[order]))
    # shapes
    same = np.zeros((2, len(exact)), np.uint64)
    for k in (1, 2):
        same[k - 1, k:] = (exact[k:] == exact[:-k]) & (row[k:] == row[:-k])
    size = np.minimum(end - start, 255)
    caps = np.concatenate([[0], np.cumsum(UPPER[data])])
    marks = np.concatenate([[0], np.cumsum(~ALNUM[data])])
    caps, marks = caps[end] - caps[start], marks[end] - marks[start]
    shape = same[0] + 2 * same[1]
    shape = shape * np.uint64(8) + np.minimum(np.log2(np.maximum(size, 1)), 7).astype(np.uint64)
    shape = shape * np.uint64(4) + np.where(caps == 0, 0, np.where(caps == 1, 1, 2)).astype(np.uint64)
    shape = shape * np.uint64(5) + np.where(marks == size, 4, np.minimum(marks, 3)).astype(np.uint64)
    before = np.zeros_like(shape)
    before[1:] = np.where(row[1:] == row[:-1], shape[:-1] + np.uint64(1), 0)
    both = mix(shape * np.uint64(100_003) + before) & mask
    single = mix(shape + np.uint64(1 << 40)) & mask
    out.append((np.column_stack([single, both]).astype(np.int64).ravel(), np.repeat(row, 2)))
    return out


@dataclass
class Model:
    """One weight per feature, of all bags, and a bias."""

    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        logit = np.full(len(off) - 1, self.bias)
        for ids, row in features(data, off):
            count = np.bincount(row, minlength=len(logit))
            total = np.bincount(row, self.weights[ids], minlength=len(logit))
            logit += total / np.maximum(count, 1) / 3
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def bags(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of one document and their shares of the document's mean."""
    data = np.frombuffer(text.encode(), np.uint8)
    ids, share = [], []
    for found, _ in features(data, np.array([0, len(data)])):
        one, count = np.unique(found, return_counts=True)
        ids.append(one)
        share.append(count / max(1, len(found)) / 3)
    ids, place = np.unique(np.concatenate(ids), return_inverse=True)
    return ids.astype(np.int32), np.bincount(place, np.concatenate(share), minlength=len(ids)).astype(np.float32)


def train(rows: Iterable[tuple[str, int]], share: float | None = None, epochs: int = 6, rate: float = 0.5, seed: int = 5) -> Model:
    """Softmax over averaged vectors, by stochastic gradient descent with a falling rate. ``share`` of label 1 among all
    labelled rows corrects for a sample drawn by label."""
    examples = [(*bags(text), label) for text, label in rows]
    labels = np.array([x[2] for x in examples])
    if not len(labels) or labels.min() == labels.max():
        p = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-6, 1 - 1e-6))
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    step, steps = 0, epochs * len(examples)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            ids, weight, label = examples[i]
            now = rate * (1 - step / steps)
            step += 1
            rows_of = vectors[ids]
            mean = weight @ rows_of
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= now * np.outer(p, mean)
            bias -= 0.1 * now * p
            # each vector moves by its share; scaled up, because a share is small
            vectors[ids] = rows_of - (now * 20) * weight[:, None] * back
    weights = (vectors @ (out[1] - out[0])).astype(np.float64)
    b = float(bias[1] - bias[0])
    if share:
        drawn = labels.mean()
        b += float(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)))
    return Model(weights, b)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """Model of ``labels.quality``; only a bounded sample leaves the executors."""
    found = labels.filter(~held_out() & F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0]
    share = float(np.clip(found, 1e-6, 1 - 1e-6)) if found is not None else None
    sample = labelled_sample(docs, labels, "quality", rows).select("text", "label", "doc_id")
    drawn = sorted(((r["doc_id"], r["text"], r["label"]) for r in sample.toLocalIterator()), key=lambda r: r[:2])
    return train([(t, y) for _, t, y in drawn], share)


def score(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """doc_id, or the given columns, and score of each row of ``docs`` (doc_id, text and others)."""
    spark = docs.sparkSession
    python_tasks(spark)
    sent = spark.sparkContext.broadcast(model)
    columns = columns or ["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in chunks(batches):
            kept = [part.column(part.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sent.value.scores(data, off))], [*columns, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.mapInArrow(run, f"{kinds}, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_text(table(spark, sf_dir, "documents"))
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
