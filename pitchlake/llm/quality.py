"""A quality classifier on supervised subword embeddings.

Words, pairs of words, a mark for a word repeated at once, and the 3- and 5-byte grams of the text are hashed into
buckets with a learned vector each. The mean vector of a document goes through a softmax layer; vectors and layer are
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows. As mean and layer are linear,
a bucket's share in the score is one number, so scoring sums numbers from a table of fixed size over whole texts.

Texts that are null or empty score the share of label 1 in the sample; without labelled rows every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays
from .labelled import held_out, training_texts

BUCKETS = 1 << 17
GRAMS = (3, 5)
SAMPLE = 1500  # labelled documents of each label, at most
DIMENSIONS, EPOCHS, RATE = 8, 5, 0.5
SPREAD = 200  # the mean divides a vector's gradient by the number of features; up to this many, that is made good
THRESHOLD = 0.3
_REPEAT = np.uint64(0x5851F42D4C957F2D)


def features(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all features of the texts; the row of each is ascending within each kind of feature only."""
    words = arrays.words_of(part, arrays.SPACES)
    row = words.row_of_word()
    pairs = np.flatnonzero(arrays.whole_within(words, 2))
    pair_code = arrays.rolling(words.code, 2)[pairs]
    again = pairs[words.code[pairs] == words.code[pairs + 1]]
    kinds = [(row, words.code), (row[pairs], pair_code), (row[again], np.full(len(again), _REPEAT))]
    byte_row = np.repeat(np.arange(len(part)), np.diff(words.rows))
    for n in GRAMS:
        at, code = words.byte_grams(n)
        kinds.append((byte_row[at], code + np.uint64(n)))
    # the kind is part of the hash
    codes = np.concatenate([arrays.mix(code + np.uint64(i)) for i, (_, code) in enumerate(kinds)])
    return np.concatenate([r for r, _ in kinds]), (codes & np.uint64(BUCKETS - 1)).astype(np.int64)


def train(sample: list[tuple[str, int]], dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """(share of each bucket in the log-odds of label 1, log-odds of a text without features)."""
    if not sample:
        return np.zeros(BUCKETS, np.float32), 0.0
    share = np.clip(np.mean([y for _, y in sample]), 1e-3, 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (BUCKETS, dimensions)).astype(np.float32)
    layer = np.zeros((2, dimensions), np.float32)
    bags = []
    for text, y in sample:
        _, bucket = features(pa.array([text]))
        ids, counts = np.unique(bucket, return_counts=True)
        if len(ids):
            bags.append((ids.astype(np.int32), (counts / len(bucket)).astype(np.float32), y))
    # both labels weigh the same
    ones = max(sum(b[2] for b in bags), 1)
    weight = (len(bags) / (2 * max(len(bags) - ones, 1)), len(bags) / (2 * ones))
    steps, done = max(epochs * len(bags), 1), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, counts, y = bags[i]
            pace = rate * (1 - done / steps) * weight[y]
            hidden = counts @ vectors[ids]
            out = np.exp(layer @ hidden - np.max(layer @ hidden))
            error = out / out.sum()
            error[y] -= 1
            back = error @ layer
            layer -= pace * np.outer(error, hidden)
            vectors[ids] -= pace * np.outer(counts * min(len(ids), SPREAD), back).astype(np.float32)
            done += 1
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), prior


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, held_out, score, predicted) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(training_texts(docs, labels, "quality", sample)))
    out = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches):
        table, prior = model.value
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                row, bucket = features(part.column("text"))
                total = np.bincount(row, table[bucket], part.num_rows)
                n = np.bincount(row, minlength=part.num_rows)
                odds = np.where(n > 0, total / np.maximum(n, 1), prior)
                yield pa.record_batch([part.column("doc_id"), part.column("text_key"), part.column("held_out"),
                                       pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))))], schema=out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text")).withColumn("held_out", held_out())
    return rows.mapInArrow(run, "doc_id long, text_key long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
