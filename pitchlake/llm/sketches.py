"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is its set of distinct word shingles (3 words unless told otherwise, hashed to 64 bits); equal sets are one
node. A sketch holds the `kept` smallest hashes of a set (64), or all of a smaller set. Of two sets with a similarity of
0.85 or more the sketches share at least half of the larger sketch: always, if the sets are no larger than their sketch;
else the shared part is at least Binomial(64, 0.85), which is below 32 for one pair in 10**10.

1. Inverted lists: one list of sets per retained value. Half of a sketch must be shared, so of each sketch the values of
   the longest lists, all but one of that half, need not be looked at: two sets in question still meet in the list of
   the rarest value that they share. Values that many documents have in common thus generate nothing, unless more than
   half of a sketch is made of them. A set that has not half of its sketch in lists of two or more is alone.
2. Overlaps: a list is not expanded into pairs. Its pivot is the set whose values have the longest lists in all, the
   centre of a family of copies, and the other members are held against it.
3. Union sketches: the smallest hashes of both sketches together are a sketch of the union, and the share of them that
   both sets have estimates the similarity. Pairs below one half are out; the rest is verified on the full sets.
4. Links among sets that are linked with the same pivot add nothing. Strays (not linked with a pivot) are held against
   the members of that pivot, in cells of bounded numbers of both: first by their sketches, which leaves the strays and
   members that share half a sketch with any; these are compared on their full sets.

Links carry over to components by alternating star contraction. Documents without words have the empty set and are
linked with nothing; fewer words than a shingle are one shingle. A null doc_id takes part and never names a component,
unless the whole component has none. Rows that repeat are copies; other columns of the table don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import arrays, jaccard
from .tables import documents_of, release, stored

SHINGLE, SIMILARITY = 3, 0.85
KEPT = 64
BLOCK = 2000             # strays or members of a cell
_HIGH = np.uint64(1 << 63)


def bottom(s: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """The smallest hashes of a sorted set, as longs in the same order."""
    return arrays.signed(s[:kept] ^ _HIGH)


def sketch_rows(docs: DataFrame, shingle: int = SHINGLE, kept: int = KEPT) -> DataFrame:
    """(doc_id, text_key, n_shingles, code, sketch) of each document."""
    out = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("code", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                sets = jaccard.shingle_sets(arrays.words_of(part.column("text"), arrays.SPACES, fold=True), shingle)
                yield pa.record_batch([part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
                                       pa.array([jaccard.set_code(s) for s in sets], pa.int64()), pa.array([bottom(s, kept) for s in sets], pa.list_(pa.int64()))], schema=out)

    return documents_of(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_key long, n_shingles long, code long, sketch array<long>")


def needed(held: Column) -> Column:
    """Values of a sketch of this size that a linked set's sketch must hold too."""
    return F.ceil(held / 2)


def generating(nodes: DataFrame) -> DataFrame:
    """(code, value, weight): of each set that may have partners the retained values whose lists are to be read; weight is the length of all its lists."""
    postings = nodes.select("code", F.size("sketch").alias("held"), F.explode("sketch").alias("value"))
    lists = postings.groupBy("value").agg(F.count("*").alias("length")).filter("length > 1")
    # a sketch, thus a list of at most `kept` values, comes together again
    sets = postings.join(lists, "value").groupBy("code").agg(
        F.first("held").alias("held"), F.sum("length").alias("weight"), F.array_sort(F.collect_list(F.struct("length", "value"))).alias("found"))
    first = (F.size("found") - needed(F.col("held")) + 1).cast("int")
    return sets.filter(first > 0).select("code", "weight", F.explode(F.slice("found", F.lit(1), first)).alias("f")).select("code", F.col("f.value").alias("value"), "weight")


def held_against_pivots(lists: DataFrame) -> DataFrame:
    """(pivot, code): each member of a list with the list's weightiest set. Rows of a list are read in order, from disk if need be."""
    order = Window.partitionBy("value").orderBy(F.desc("weight"), "code").rowsBetween(Window.unboundedPreceding, 0)
    return lists.withColumn("pivot", F.first("code").over(order)).filter("code != pivot").select("pivot", "code").distinct()


def estimated(pairs: DataFrame, nodes: DataFrame, kept: int = KEPT) -> DataFrame:
    """(pivot, code, near): whether the union sketch of both puts their similarity at one half or more."""
    one = nodes.select("code", F.col("sketch").alias("a"))
    other = nodes.select(F.col("code").alias("pivot"), F.col("sketch").alias("b"))
    union = F.slice(F.array_sort(F.array_union("a", "b")), 1, kept)
    both = F.size(F.array_intersect(F.array_intersect("a", "b"), "union"))
    return pairs.join(one, "code").join(other, "pivot").withColumn("union", union).select("pivot", "code", (both * 2 >= F.size("union")).alias("near"))


def with_partners(frame: pd.DataFrame) -> pd.DataFrame:
    """(pivot, code) of the strays and members of each cell that share half of the larger sketch with one of the other kind."""
    pivot, code = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for (name, _, _), cell in frame.groupby(["pivot", "block", "turn"]):
        cell, strays = jaccard.in_cell(cell)
        if not len(strays):
            continue
        sizes = np.array([len(x) for x in cell["sketch"]])
        near = 2 * jaccard.shared_counts(list(cell["sketch"]), strays) >= np.maximum(sizes[strays, None], sizes[None, :])
        code.append(cell["code"].to_numpy()[jaccard.partnered(near, strays)])
        pivot.append(np.full(len(code[-1]), name))
    return pd.DataFrame({"pivot": np.concatenate(pivot), "code": np.concatenate(code)})


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, kept: int = KEPT, block: int = BLOCK,
                    task_items: int = jaccard.TASK_ITEMS) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id (the least doc_id that links reach) and the document that stands for it (keeper, keeper_key)."""
    rows = stored(sketch_rows(docs, shingle, kept), "sketches")
    heads = jaccard.class_heads(rows)
    shapes = rows.filter("n_shingles > 0").groupBy("code").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    facts = stored(rows.drop("sketch"), "facts")
    classes = stored(heads, "classes")
    nodes = stored(shapes, "nodes")
    release(rows)
    pairs = stored(estimated(held_against_pivots(generating(nodes)), nodes, kept), "pairs")
    edges = jaccard.settled(docs, classes, nodes, pairs, with_partners, shingle, similarity, block // 2, task_items)
    release(pairs, nodes)
    return jaccard.grouped(facts, classes, jaccard.components(edges))
