"""Quality (8) and toxicity (10): held-out accuracy, exact marginals, awkward rows."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa

from pitchlake.llm import arrays, quality, toxicity

from . import fixtures as fx


def corpus(n=400):
    """Texts with labels: junk repeats one word, toxic ones hold a few words of their own."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        bad, foul = rng.random() < 0.3, rng.random() < 0.3
        words = fx.prose(rng, rng.randrange(20, 120)).split()
        if bad:
            words[5:15] = [rng.choice(words)] * 40
        if foul:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "grubby", "snarl"]) + rng.choice(["", "ish"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(foul)))
    return rows, labels


def awkward(spark, labels):
    """Labels with nulls, a repeated row, unknown documents and clashing columns."""
    return spark.createDataFrame([(*l, "x") for l in labels + [labels[0], (None, 1, 1), (99999, 1, 0), (5, None, None)]], "doc_id long, quality int, toxic int, label string")


def held(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


def check(got, truth, rows, threshold):
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and held(r.doc_id)) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    fold = [r for r in got if r.held_out and r.doc_id in truth]
    return sum(r.predicted == truth[r.doc_id] for r in fold) / len(fold)


def test_quality_of_the_held_out_fold(spark):
    rows, labels = corpus()
    rows += [(9000, None), (9001, ""), (9002, "word " * 20000), (None, "a b"), (0, rows[0][1])]
    got = quality.score_quality(fx.documents(spark, rows), awkward(spark, labels)).collect()
    assert check(got, {d: q for d, q, _ in labels}, rows, 0.3) >= 0.95


def test_toxicity_of_the_held_out_fold(spark):
    rows, labels = corpus()
    rows += [(9000, None), (9001, ""), (9002, "word " * 20000), (None, "a b"), (0, rows[0][1])]
    got = toxicity.tag_toxicity(fx.documents(spark, rows), awkward(spark, labels)).collect()
    assert check(got, {d: t for d, _, t in labels}, rows, 0.5) >= 0.95
    texts, by_id = dict(rows), {r.doc_id: r for r in got}
    tagged = [texts[d][s.start:s.stop] for d, _, t in labels if t for s in by_id[d].spans]
    assert sum(w.startswith(("vile", "grubby", "snarl")) for w in tagged) >= 0.9 * len(tagged) > 50
    assert by_id[9001].predicted == 0 and by_id[9000].spans == []


def test_no_labels_and_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = fx.documents(spark, [(1, "some words"), (2, None)])
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert {r.predicted for r in toxicity.tag_toxicity(docs, none).collect()} == {0}
    assert quality.score_quality(fx.documents(spark, []), none).collect() == []
    assert toxicity.tag_toxicity(fx.documents(spark, []), none).collect() == []


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    sizes = [3, 1, 0, 6, 2]
    first = np.concatenate([[0], np.cumsum(sizes)])
    score, change = rng.normal(size=first[-1]), rng.normal(size=(2, 2))
    prob, moves = toxicity.marginals(score, first, change)
    want, total = np.zeros(first[-1]), np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        paths = list(itertools.product([0, 1], repeat=b - a))
        weight = np.array([np.exp(sum(score[a + i] * y for i, y in enumerate(p)) + sum(change[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        weight /= weight.sum()
        for p, w in zip(paths, weight):
            want[a:b] += w * np.array(p)
            for x, y in zip(p, p[1:]):
                total[x, y] += w
    assert np.allclose(prob, want) and np.allclose(moves, total)


def test_words_equal_regular_expressions():
    rows = [t and fx.lower(t) for _, t in fx.texts()] + ["\x1c\x1d a\x0bb\x0cc\x85d", "äÖ-ü_9", "\x00"]
    for table, pattern in ((arrays.SPACES, fx.SPACED), (arrays.NON_ALNUM, fx.ALNUM)):
        words = arrays.words_of(pa.array(rows, pa.string()), table)
        data = bytes(words.data)
        got = [[data[a:b].decode() for a, b in zip(words.start[i:j], words.end[i:j])] for i, j in zip(words.first, words.first[1:])]
        assert got == [pattern.findall(t or "") for t in rows]
        names = {}
        for word, code in zip((w for g in got for w in g), words.code):
            assert names.setdefault(word, code) == code
        assert len(set(names.values())) == len(names)
    batch = pa.record_batch([pa.array(rows, pa.string())], ["text"])
    assert sum(p.num_rows for p in arrays.slices(batch, "text", 100)) == len(rows)
    assert list(arrays.sliding_min(np.array([5, 3, 4, 1, 7, 8, 9]), 3)) == [3, 1, 1, 1, 7]
