"""Small corpora with the awkward cases: nulls, empty and long texts, copies, repeated rows, columns with clashing names."""

import random
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VOCABULARY = [a + b for a in "ka lo mi ru te zü né".split() for b in "ban der fil gor hus".split()]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, text_key string, score string, size string"


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def changed(rng, text, times):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def texts(seed=1):
    """(doc_id, text) rows; doc_id is not sorted and may be null or repeated."""
    rng = random.Random(seed)
    base, passage = prose(rng, 150), prose(rng, 70)
    rows = [(10, base), (7, base), (30, base), (31, base + " "), (32, base.upper())]
    rows += [(100 + i, changed(rng, base, 1 + i % 6)) for i in range(40)]  # a family of near copies
    rows += [(200 + i, prose(rng, 40) + "\n" + passage + "\t" + prose(rng, 30 + i)) for i in range(4)]
    rows += [(300 + i, prose(rng, rng.randrange(1, 120))) for i in range(30)]
    rows += [(400, None), (401, ""), (402, "  \n"), (403, "one"), (404, "One"), (405, "two words"), (406, "a b c"), (407, "a  b\tc")]
    rows += [(500, prose(rng, 3000)), (501, "la " * 400), (502, "la " * 60), (503, prose(rng, 20) + " " + "y" * 5000)]
    rows += [(600, passage + " " + passage), (None, base), (None, None), (10, base), (7, passage), (601, "naïve ünï " * 30)]
    return rows


def documents(spark, rows, partitions=3):
    """The rows as documents, with extra columns whose names clash with those of operators."""
    full = [(d, t, "en", f"s{i % 4}" if i % 7 else None, None if t is None else len(t), i, "k", "x", "y") for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)
