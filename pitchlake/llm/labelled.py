"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FOLDS = 5


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fold that no classifier learns from: crc32 of doc_id as text, modulo 5, is 0. A null doc_id isn't in it."""
    text = F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")
    return F.coalesce(F.crc32(text.cast("binary")) % FOLDS == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> list[tuple[str, int]]:
    """(text, label) of at most `rows` documents of each label outside the held-out fold, by the smallest hash of doc_id.

    Null labels and texts are left out; of a doc_id with several labels the rounded mean counts; a doc_id that several
    documents share gives one of them.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).dropna()
             .filter(~held_out()).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    present = texts.select("doc_id").join(known, "doc_id").distinct()
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = present.filter("label = 0").orderBy(*order).limit(rows).unionByName(present.filter("label = 1").orderBy(*order).limit(rows))
    # at most 2 * rows pairs of numbers, whatever the size of the tables
    picked = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return [(r["text"], r["label"]) for r in sorted(picked.collect(), key=lambda r: r["doc_id"])]
