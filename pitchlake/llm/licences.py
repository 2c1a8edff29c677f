"""License scans by diagonal voting.

All rolling word k-gram hashes of a document that occur in a template are joined with the places where templates hold
them. A hit votes for the diagonal document place - template place; votes are counted by (document, template, diagonal).
A base phrase stands where its diagonal has every k-gram of the phrase. For the notices, hits of neighbouring diagonals
are merged in document order while they go on in the template (inserted or missing words shift the diagonal by a few).
Each merged span is verified by itself: it must hold a share of the template's k-grams, and all of those that tell the
license from others (name, version). A span of the name and version alone may be enough for a short notice. Null texts
are empty; repeated rows are judged one by one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import arrays
from .tables import RowNumbers, documents_of, stored

K = 3
REACH = 6
SHARE = 0.5  # a replaced or missing word costs K k-grams; the shortest notices with a name of three words have six

# The phrases and labels that count as base.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening sentences of public licenses, lower case, without punctuation.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
}

#: By notice, in the same order: the words of it whose k-grams a span must hold.
TELLING = [
    ["the mit license"],
    ["any person obtaining", "associated documentation files"],
    ["apache license version 2"],
    ["in compliance with"],
    ["redistribution and use", "source and binary"],
    ["gnu general public", "license version 3"],
    ["gnu general public", "license version 2"],
    ["gnu lesser general"],
    ["gnu affero general"],
    ["source code form", "mozilla public license"],
    ["cc by nc"],
    ["cc by sa"],
    ["commons attribution 4"],
    ["permission to use", "or without fee"],
]


def telling_places(text: str, phrases: list[str]) -> list[int]:
    """Places in a notice of the k-grams of the phrases."""
    words = text.split()
    grams = [" ".join(words[i:i + K]) for i in range(len(words) - K + 1)]
    return sorted({grams.index(" ".join(p[i:i + K])) for p in map(str.split, phrases) for i in range(len(p) - K + 1)})


def templates() -> list[tuple[int, str, bool, int, list[int]]]:
    """(template, label, base, number of k-grams, places of telling ones) of all phrases and notices."""
    telling = [[]] * len(BASE) + TELLING
    return [(i, label, i < len(BASE), len(text.split()) - K + 1, telling_places(text, telling[i])) for i, (text, label) in enumerate([*BASE.items(), *NOTICES.items()])]


def template_places() -> list[tuple[int, int, int]]:
    """(k-gram hash, template, place)."""
    out = []
    for i, text in enumerate([*BASE, *NOTICES]):
        words = arrays.words_of(pa.array([text]), arrays.NON_ALNUM, fold=True)
        out += [(int(h), i, place) for place, h in enumerate(arrays.signed(arrays.rolling(words.code, K)))]
    return out


def grams(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, text_key, n_words, hits): per document the places of k-grams that some template holds."""
    known = np.unique(np.array([p[0] for p in template_places()], np.int64))
    slots = np.zeros(1 << 16, dtype=bool)
    slots[known & 0xFFFF] = True
    out = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()),
                     ("hits", pa.list_(pa.struct([("gram", pa.int64()), ("place", pa.int32())])))])

    def scan(batches):
        numbers = RowNumbers()
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                words = arrays.words_of(part.column("text"), arrays.NON_ALNUM, fold=True)
                gram = arrays.signed(arrays.rolling(words.code, K))
                at = np.flatnonzero(slots[gram & 0xFFFF])
                at = at[known[np.minimum(np.searchsorted(known, gram[at]), len(known) - 1)] == gram[at]]
                at = at[arrays.whole_within(words, K)[at]]
                row = np.searchsorted(words.first, at, side="right") - 1
                hits = pa.StructArray.from_arrays([pa.array(gram[at], pa.int64()), pa.array(at - words.first[row], pa.int32())], ["gram", "place"])
                offsets = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                yield pa.record_batch([pa.array(numbers.take(part.num_rows), pa.int64()), part.column("doc_id"), part.column("text_key"),
                                       pa.array(words.counts, pa.int64()), pa.ListArray.from_arrays(offsets, hits)], schema=out)

    rows = documents_of(docs).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(scan, "uid long, doc_id long, text_key long, n_words long, hits array<struct<gram: long, place: int>>")


def hits_in(found: DataFrame) -> DataFrame:
    """(uid, template, label, base, size, telling, diagonal, place, at): k-grams of a document with their places in templates."""
    spark = found.sparkSession
    places = spark.createDataFrame(template_places(), "gram long, template int, at int")
    kinds = spark.createDataFrame(templates(), "template int, label string, base boolean, size int, telling array<int>")
    hits = found.filter("size(hits) > 0").select("uid", F.explode("hits").alias("h")).select("uid", "h.gram", "h.place")
    hits = hits.join(F.broadcast(places), "gram").withColumn("diagonal", F.col("place") - F.col("at"))
    return hits.join(F.broadcast(kinds), "template")


def votes(hits: DataFrame) -> DataFrame:
    """(uid, label, diagonal): diagonals with every k-gram of a base phrase."""
    return hits.filter("base").groupBy("uid", "template", "label", "size", "diagonal").agg(F.count_distinct("at").alias("n")).filter("n = size")


def merged(hits: DataFrame, reach: int = REACH) -> DataFrame:
    """Hits of a notice that follow each other on neighbouring diagonals (steps of at most `reach`) as one span, with the share of its k-grams and whether all telling ones are there."""
    w = Window.partitionBy("uid", "template").orderBy("place", "at")
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(w)) > reach) | (F.col("at") <= F.lag("at").over(w))
    runs = hits.filter("not base").withColumn("new", F.coalesce(apart.cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("uid", "template", "label", "run").agg(
        F.collect_set("at").alias("ats"), F.first("size").alias("size"), F.first("telling").alias("telling"), F.min("place").alias("low"), F.max("place").alias("high")).select(
        "uid", "label", (F.size("ats") / F.col("size")).alias("share"), (F.size(F.array_except("telling", "ats")) == 0).alias("told"), "low", "high")


def scan_licenses(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    `spans` are the verified (label, first word, last word, share). Score: the largest share of a template found, 1 with a base phrase.
    """
    found = stored(grams(docs), "license_grams")
    hits = hits_in(found)
    base = votes(hits).groupBy("uid").agg(
        F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"),
        F.array_sort(F.collect_set("label")).alias("base_set"))
    spans = merged(hits).groupBy("uid").agg(
        F.collect_list(F.when((F.col("share") >= share) & F.col("told"), F.struct("label", F.col("low").alias("first"), (F.col("high") + K - 1).alias("last"), "share"))).alias("spans"),
        F.max("share").alias("best"))
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_distinct(F.concat(F.coalesce("base_set", none), F.coalesce(F.col("spans.label"), none))))
    return reduce(lambda a, b: a.join(b, "uid", "left"), [found.drop("hits"), base, spans]).select(
        "doc_id", "text_key", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.coalesce("base_set", none), ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "spans")
