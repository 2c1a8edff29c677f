"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents are range-sorted by it: ranges of the key are
blocks of about equal size, sorted block by block, and the sums of the blocks are carried on, so no source is ever
sorted in one task. The prefix sum of word counts tells where the budget of the source cuts; a budget above the
source's size first repeats whole epochs. The cut may fall within a document, so budgets are met to the word.

Null texts have size 0; null sources are one source, sorted last; a null doc_id is a key as any other. Rows equal in
key, doc_id and size are interchangeable. Reruns agree, as the keys depend on doc_id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .tables import quoted

WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"
KEY_DIGITS = 3  # leading hex digits of the key that name a block: 4096 blocks a source


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(src, source_size, target) from (src, source, source_size), one row per source.

    Sources take the weights in turn, by code point, null last. Targets share `share` times all words by weight, none
    above `most` times its source. Filling sources in order of cap / weight, the common level is the largest of
    (what is left) / (weights left); a target is the level times the weight, or the cap.
    """
    everyone = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("weight", turn[(F.row_number().over(order) - 1) % len(weights)])
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(everyone) * share - before) / left)
    return s.select("src", "source_size", F.least("cap", F.max("level").over(everyone) * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
                carry: tuple[str, ...] = ("doc_id",), seed: str = "mix") -> DataFrame:
    """The `carry` columns with size, source_size, target and taken (words that the mix takes, repeats counted)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select(
        F.struct(*[F.col(quoted(c)) for c in carry]).alias("kept"), F.col("doc_id").cast("long").alias("doc"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")).alias("src"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(f"({WORD})")), F.lit(0)).cast("long").alias("size"),
        key.alias("key"), F.substring(key, 1, KEY_DIGITS).alias("block"))
    sums = rows.groupBy("src", "block").agg(F.sum("size").alias("block_size"), F.first("source").alias("source"))
    goal = targets(sums.groupBy("src").agg(F.first("source").alias("source"), F.sum("block_size").alias("source_size")), weights, share, most)
    blocks = sums.drop("source").withColumn("ahead", F.sum("block_size").over(Window.partitionBy("src").orderBy("block")) - F.col("block_size")).join(goal, "src")
    inside = Window.partitionBy("src", "block").orderBy("key", "doc", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(inside)).join(blocks, ["src", "block"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")) - (F.col("ahead") + F.col("upto") - F.col("size"))
    return placed.withColumn("epochs", epochs).select(
        "kept.*", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))).cast("long").alias("taken"))
