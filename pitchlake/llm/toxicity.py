"""Toxic spans by a linear-chain conditional random field.

Tokens are words in lower case; a token is toxic or not. Labels exist for documents only, so tokens of the sample are
labelled from them: a token of a toxic document is toxic if its word, or the word's beginning, is by far commoner
in toxic documents than in clean ones. The chain scores a token by hashed features (word, beginnings of 4 and 5
bytes, ending, neighbouring words) and by the change of state; it is fitted by gradient steps on the exact
log-likelihood, from forward-backward marginals. A document's score is a logistic function of its largest marginal
and of the sum of its marginals; runs of toxic tokens are the offending spans.

With two states the forward and backward vectors are one odds ratio each, so documents of similar length are run
side by side as columns of an array. Whole texts are scored. Texts without words score the lowest value the model
gives; without labelled rows every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays
from .labelled import held_out, training_texts

SLOTS = 1 << 21
SAMPLE = 1500       # labelled documents of each label, at most
EPOCHS, RATE, BATCH = 3, 0.5, 128
EVIDENCE = np.log(20.0)  # token labels: at least so much commoner in toxic documents,
LEAST_DOCUMENTS = 3      # and there in so many places,
LEAST_SHARE = 0.02       # and in so many for each toxic document
SKETCH = 4               # documents with the same so many smallest word hashes count as copies; one of them is learnt from
THRESHOLD = 0.5
_LIMIT = 30.0


def token_features(words: arrays.Words) -> np.ndarray:
    """Slots of the features of every token, one row per feature: word, two beginnings, ending, word before, word after."""
    n, start, end = len(words.start), words.start, words.end
    row = words.row_of_word()
    before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if n:
        same = row[1:] == row[:-1]
        before[1:][same] = words.code[:-1][same]
        after[:-1][same] = words.code[1:][same]
    kinds = [words.code, words.span_code(start, np.minimum(start + 4, end)), words.span_code(start, np.minimum(start + 5, end)),
             words.span_code(np.maximum(end - 4, start), end), before, after]
    return np.stack([(arrays.mix(k + np.uint64(i + 1)) & np.uint64(SLOTS - 1)).astype(np.int32) for i, k in enumerate(kinds)])


def columns(first: np.ndarray) -> list[np.ndarray]:
    """Rows grouped by similar length: within a group none has under half the tokens of the longest."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    order, out = order[length[order] > 0], []
    while len(order):
        n = int(np.searchsorted(-length[order], -length[order[0]] / 2, side="left"))
        n = max(n, 1)
        out.append(order[:n])
        order = order[n:]
    return out


def marginals(score: np.ndarray, first: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token the probability of the toxic state, and the expected number of each change of state over all chains.

    `score` is the log-odds of a token by its own features; `change` the 2 x 2 weights of moving from state to state.
    """
    move = np.exp(change)
    odds = np.exp(np.clip(score, -_LIMIT, _LIMIT))
    prob, moves = np.zeros(len(score)), np.zeros((2, 2))
    for rows in columns(first):
        begin, length = first[rows], first[rows + 1] - first[rows]
        steps = int(length[0])
        live = np.searchsorted(-length, -np.arange(steps), side="left")  # columns longer than the step; lengths fall
        x = np.ones((steps, len(rows)))
        for t in range(steps):
            x[t, :live[t]] = odds[begin[:live[t]] + t]
        ahead = np.empty_like(x)  # toxic : clean of everything up to the token
        ahead[0] = x[0]
        for t in range(1, steps):
            r = ahead[t - 1]
            ahead[t] = x[t] * (move[0, 1] + move[1, 1] * r) / (move[0, 0] + move[1, 0] * r)
        behind = np.ones_like(x)  # of everything after the token
        for t in range(steps - 2, -1, -1):
            n = live[t + 1]
            r = x[t + 1, :n] * behind[t + 1, :n]
            behind[t, :n] = (move[1, 0] + move[1, 1] * r) / (move[0, 0] + move[0, 1] * r)
        both = ahead * behind
        p = both / (1 + both)
        at = np.concatenate([begin[:live[t]] + t for t in range(steps)])
        mask = np.arange(steps)[:, None] < length[None, :]
        prob[at] = p[mask]
        if steps > 1:
            pair, a, b = mask[1:], ahead[:-1], (x * behind)[1:]
            weight = np.stack([np.full_like(a, move[0, 0]), move[0, 1] * b, move[1, 0] * a, move[1, 1] * a * b])
            weight /= weight.sum(axis=0)
            moves += (weight * pair).sum(axis=(1, 2)).reshape(2, 2)
    return prob, moves


@dataclass
class Field:
    """A fitted chain and the logistic function on top of it."""

    weights: np.ndarray
    change: np.ndarray
    bias: float
    top: np.ndarray  # constant, largest marginal, log of 1 + sum of marginals

    def token_scores(self, words: arrays.Words) -> np.ndarray:
        total = np.full(len(words.start), self.bias)
        for slots in token_features(words):
            total += self.weights[slots]
        return total

    def tag(self, words: arrays.Words) -> tuple[np.ndarray, np.ndarray]:
        """(marginal of each token, score of each row)."""
        prob, _ = marginals(self.token_scores(words), words.first, self.change)
        z = document_evidence(prob, words.first) @ self.top
        return prob, 1 / (1 + np.exp(-np.clip(z, -_LIMIT, _LIMIT)))


def document_evidence(prob: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    largest = np.zeros(n)
    np.maximum.at(largest, row, prob)
    return np.stack([np.ones(n), largest, np.log1p(np.bincount(row, prob, n))], axis=1)


def label_tokens(slots: np.ndarray, row: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Token labels from document labels, by how much commoner a word or its beginning is in toxic documents.

    What is counted are the different pairs of neighbours of a word: a word that copies of one toxic text repeat has few.
    """
    marked, bad = np.zeros(slots.shape[1], dtype=bool), toxic[row]
    n_toxic, n_clean = toxic.sum(), (~toxic).sum()
    between = slots[4].astype(np.int64) * SLOTS + slots[5]
    for kind in slots[:3]:
        place = kind.astype(np.int64) * SLOTS * SLOTS + between
        (ids, in_toxic), (others, times) = (np.unique(np.unique(place[p]) // (SLOTS * SLOTS), return_counts=True) for p in (bad, ~bad))
        at = np.minimum(np.searchsorted(others, ids), max(len(others) - 1, 0))
        in_clean = np.where(others[at] == ids, times[at], 0) if len(others) else np.zeros(len(ids))
        strength = np.log((in_toxic + 0.1) / (n_toxic + 1)) - np.log((in_clean + 0.5) / (n_clean + 1))
        marked |= np.isin(kind, ids[(strength >= EVIDENCE) & (in_toxic >= max(LEAST_DOCUMENTS, LEAST_SHARE * n_toxic))])
    return marked & bad


def sample_tokens(sample: list[tuple[str, int]], at_once: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature slots, word offsets, toxic) of the sample, some texts at a time, with one of each group of copies.

    The rare words of a much copied toxic text aren't toxic, so copies with the same label count once.
    """
    kept, slots, counts, toxic = set(), [], [], []
    for k in range(0, len(sample), at_once):
        part = sample[k:k + at_once]
        words = arrays.words_of(pa.array([t for t, _ in part]), arrays.NON_ALNUM, fold=True)
        found = token_features(words)
        for (_, y), a, b in zip(part, words.first, words.first[1:]):
            sketch = (y, *np.unique(arrays.mix(words.code[a:b]))[:SKETCH].tolist())
            if sketch not in kept:
                kept.add(sketch)
                slots.append(found[:, a:b])
                counts.append(b - a)
                toxic.append(bool(y))
    return np.concatenate(slots, axis=1), np.concatenate([[0], np.cumsum(counts)]), np.array(toxic)


def fit(sample: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> Field:
    if not sample or len({y for _, y in sample}) < 2:
        return Field(np.zeros(SLOTS, np.float32), np.zeros((2, 2)), -_LIMIT, np.array([-_LIMIT if not any(y for _, y in sample) else _LIMIT, 0.0, 0.0]))
    slots, offsets, toxic = sample_tokens(sample)
    sizes_of = np.diff(offsets)
    row = np.repeat(np.arange(len(toxic)), sizes_of)
    label = label_tokens(slots, row, toxic)
    field = Field(np.zeros(SLOTS, np.float32), np.zeros((2, 2)), -3.0, np.zeros(3))
    squares, change_squares = np.full(SLOTS, 1e-3, np.float32), np.full((2, 2), 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        shuffled = rng.permutation(len(toxic))
        for k in range(0, len(shuffled), BATCH):
            rows = np.sort(shuffled[k:k + BATCH])
            sizes = sizes_of[rows]
            at = arrays.spread(offsets[rows], sizes)
            first = np.concatenate([[0], np.cumsum(sizes)])
            score = field.bias + sum(field.weights[s[at]] for s in slots)
            prob, moves = marginals(score, first, field.change)
            miss = prob - label[at]
            used, place = np.unique(slots[:, at], return_inverse=True)
            slope = np.bincount(place.ravel(), np.tile(miss, len(slots)))
            squares[used] += slope ** 2
            field.weights[used] -= rate * slope / np.sqrt(squares[used])
            y = label[at].astype(int)
            inner = np.ones(len(at), dtype=bool)
            inner[first[:-1][sizes > 0]] = False
            pairs = np.flatnonzero(inner)
            seen = np.bincount(y[pairs - 1] * 2 + y[pairs], minlength=4).reshape(2, 2)
            push = moves - seen
            change_squares += push ** 2
            field.change -= 0.1 * push / np.sqrt(change_squares)
    evidence = []
    for k in range(0, len(toxic), BATCH):
        first = offsets[k:k + BATCH + 1]
        score = field.bias + sum(field.weights[s[first[0]:first[-1]]] for s in slots)
        evidence.append(document_evidence(marginals(score, first - first[0], field.change)[0], first - first[0]))
    x, y = np.concatenate(evidence), toxic.astype(float)
    for _ in range(50):  # Newton steps of a lightly penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ field.top, -_LIMIT, _LIMIT)))
        slope = x.T @ (p - y) + 1e-2 * field.top
        field.top = field.top - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), slope)
    return field


def tag_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, spans: bool = True) -> DataFrame:
    """(doc_id, text_key, held_out, score, predicted, spans): spans are runs of toxic tokens as code points (start, stop) and their largest marginal."""
    model = docs.sparkSession.sparkContext.broadcast(fit(training_texts(docs, labels, "toxic", sample)))
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("marginal", pa.float64())]))
    out = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("spans", span)])

    def runs(words, prob):
        hot = np.flatnonzero(prob >= threshold)
        row = np.searchsorted(words.first, hot, side="right") - 1
        found: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
        if len(hot):
            whole = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])  # code points before each byte
            cut = np.flatnonzero((np.diff(hot) > 1) | (np.diff(row) > 0)) + 1
            for group in np.split(np.arange(len(hot)), cut):
                a, b, r = hot[group[0]], hot[group[-1]], row[group[0]]
                base = whole[words.rows[r]]
                found[r].append({"start": int(whole[words.start[a]] - base), "stop": int(whole[words.end[b]] - base), "marginal": float(prob[hot[group]].max())})
        return found

    def run(batches):
        for batch in batches:
            for part in arrays.slices(batch, "text", 4 * arrays.SLICE_BYTES):
                words = arrays.words_of(part.column("text"), arrays.NON_ALNUM, fold=True)
                prob, score = model.value.tag(words)
                found = runs(words, prob) if spans else [[]] * part.num_rows
                yield pa.record_batch([part.column("doc_id"), part.column("text_key"), part.column("held_out"), pa.array(score, pa.float64()),
                                       pa.array(found, span)], schema=out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text")).withColumn("held_out", held_out())
    return rows.mapInArrow(run, "doc_id long, text_key long, held_out boolean, score double, spans array<struct<start: int, stop: int, marginal: double>>").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
