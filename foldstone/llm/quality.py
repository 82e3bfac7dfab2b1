"""Quality classifier (operator 4): learned vectors of hashed words and character n-grams, averaged over a document, softmax.

The output is linear in the averaged vectors, so once trained the difference of the two class logits is one number for
each bucket, and a document's score needs only their mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.llm.labelled import remainder, training_sample
from foldstone.llm.words import STEP, Words, slices

PARTS, HELD_OUT = 4, 2
SAMPLE_PER_CLASS = 1000
SAMPLE_CHARS = 20_000
BUCKETS = 1 << 18
DIMENSIONS = 16
EPOCHS, RATE = 6, 8.0
THRESHOLD = 0.7
GRAMS = (3, 4)  # bytes of a character n-gram, spaces included


def features(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets of all words, of whether each word is the one before it again (no other pairs are learned), then of character n-grams by size, and for each where every text's begin."""
    words = Words(column)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    hashes = words.hashes()
    parts = [((hashes * STEP) >> shift).astype(np.int32)]
    bounds = [words.first.astype(np.int64)]
    # Pairs of words have two vectors only: the second word is the first one again, or another.
    inner = np.ones(max(len(hashes) - 1, 0), bool)
    cuts = words.first[1:-1] - 1
    inner[cuts[(cuts >= 0) & (cuts < len(inner))]] = False
    parts.append((BUCKETS - 1 - (hashes[1:] == hashes[:-1]))[inner].astype(np.int32))
    bounds.append(np.concatenate([[0], np.cumsum(inner)])[np.minimum(words.first, len(inner))])
    data = words.data.astype(np.uint64)
    for n in GRAMS:
        size = max(0, len(data) - n + 1)
        code = np.full(size, n, np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | data[k : k + size]
        bucket = ((code * STEP) >> shift).astype(np.int32)
        inside = np.ones(size, bool)
        for k in range(1, n):  # n-grams that reach into the next text
            cut = words.offsets[1:-1] - k
            inside[cut[(cut >= 0) & (cut < size)]] = False
        counts = np.concatenate([[0], np.cumsum(inside)])
        parts.append(bucket[inside])
        bounds.append(counts[np.minimum(words.offsets, size)])
    return parts, bounds


def train(sample: list[tuple[str, int]], share: float) -> tuple[np.ndarray, float] | None:
    """(score of each bucket, offset): the difference of the logits of label 1 and 0, with the classes' real shares."""
    y = np.array([label for _, label in sample], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(7)
    # Vectors begin near zero, so features never seen in training carry next to nothing.
    vectors = (rng.standard_normal((BUCKETS, DIMENSIONS)) * 1e-3).astype(np.float32)
    output, bias = rng.standard_normal((2, DIMENSIONS)).astype(np.float32) / 4, np.zeros(2, np.float32)
    bags = []
    for text, _ in sample:
        parts, _ = features(pa.array([text], pa.large_string()))
        bags.append(np.unique(np.concatenate(parts), return_counts=True))
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for d in rng.permutation(len(y)).tolist():
            index, count = bags[d]
            if not len(index):
                continue
            part = (count / count.sum()).astype(np.float32)[:, None]
            mean = (vectors[index] * part).sum(0)
            logits = output @ mean + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[y[d]] -= 1
            error *= balance[d]
            step = output.T @ error
            output -= 0.05 * rate * np.outer(error, mean)
            bias -= 0.002 * rate * error
            vectors[index] -= rate * part * step
    ones = y.mean()
    prior = np.log(max(share, 1e-6) / max(1 - share, 1e-6))  # the loss counts both classes alike
    return (vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0] + prior * (0 < ones < 1))


def _scores(column: pa.Array, table: np.ndarray, offset: float) -> np.ndarray:
    total, count = np.zeros(len(column)), np.zeros(len(column))
    for bucket, bound in zip(*features(column)):
        sums = np.concatenate([[0], np.cumsum(table[bucket], dtype=np.float64)])
        total += sums[bound[1:]] - sums[bound[:-1]]
        count += np.diff(bound)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + offset, -40, 40)))


def quality(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_CHARS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Trained on a bounded sample of labelled documents (``per_class``, ``max_chars``) whose crc32 remainder is not the
    held-out one; scored on whole texts only. ``predicted`` is 1 from a score of 0.7. A null or empty text has the score of
    the offset alone. Without labels of both classes every score is the share of label 1 that was seen. Repeated rows are
    scored alike, an empty table gives an empty result, and other columns are ignored.
    """
    sample, share = training_sample(documents, labels, "quality", PARTS, HELD_OUT, per_class, max_chars)
    model = train(sample, share)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch.column("text"), *model), pa.float64())], ["doc_id", "score"])

    result = rows.mapInArrow(scored, "doc_id long, score double") if model else rows.select("doc_id", F.lit(float(share)).alias("score"))
    return result.select("doc_id", (remainder(PARTS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
