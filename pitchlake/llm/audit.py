"""Filter interaction audit by Hart-Mas-Colell potentials.

Every document fails a subset of the filters. In the removal game of a part of the corpus the players are filters, and a
coalition is worth the documents that fail any of its members. One pass over the texts leaves a row of counts for each
(part, failed filters), at most 32 rows a part; from these come the worths of all 32 coalitions. The potential of a
coalition is (its worth + the potentials of the coalitions with one filter less) / its size; it is kept times size
factorial, which is an integer. The Shapley value of a filter is the potential of all filters minus that of the others.
What a filter removes at a step of an order is the worth of the filters up to it minus the worth of those before it.

A null text is empty; a null lang is the part ''. A text is repeated if a smaller doc_id, anywhere in the table, has it: a
null doc_id is neither smaller nor greater than another, and rows that repeat doc_id and text are judged alike and
counted each. Equal texts are recognised by SHA-256. A document is good or toxic if any row of labels for its doc_id says
so; one without label is neither. An empty table has no parts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from .tables import stored

FILTERS = "ABCDE"
COALITIONS = 1 << len(FILTERS)
WORD = r"[^\x20\x09-\x0D]+"


def failures(text: str = "text") -> Column:
    """A bit for each of the filters A to D that a text fails: short, repetitive, upper case, symbols."""
    words, distinct = F.size("words"), F.size(F.array_distinct("words"))
    upper = F.length(text) - F.length(F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (words < 200, distinct * 100 < words * 50, upper * 100 > F.length(text) * 3, F.col(text).rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, part, same, mask, n): rows by document, the hash of the text and its failures of A to D; n counts repeated rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("same"), failures().alias("mask"))
    return rows.groupBy("doc_id", "part", "same", "mask").agg(F.count("*").alias("n"))


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, and how many of them are good and toxic."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr("CAST(quality AS INT) = 1").alias("good"),
                          F.expr("CAST(toxic AS INT) = 1").alias("toxic")).filter("doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
    rows = fingerprints(docs).join(known, "doc_id", "left").fillna(False, ["good", "toxic"])
    # a text becomes one row for each part and label, however many copies it has; then copies meet in bounded groups
    key = ["part", "same", "mask", "good", "toxic"]
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    # repeated rows of the least doc_id are one row of `rows` per part and label, hence one struct at most per group
    texts = rows.groupBy(key).agg(F.min(named).alias("first"), F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    least = texts.groupBy("same").agg(F.min("first.doc_id").alias("least"))
    texts = texts.join(least, "same")
    alone = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    repeated = 1 << FILTERS.index("E")
    both = texts.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), alone.alias("n")), F.struct((F.col("mask") + repeated).alias("mask"), (F.col("n") - alone).alias("n")))).alias("x"))
    times = lambda c: F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0))
    return both.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), times("good").alias("good"), times("toxic").alias("toxic"))


def worths(rows: DataFrame) -> DataFrame:
    """(part, size, worth, good, toxic): per part arrays over all coalitions, the documents that fail any of a coalition's filters."""
    def over(column: str) -> Column:
        members = f"aggregate(cells, 0L, (sum, c) -> if((c.mask & s) != 0, sum + c.{column}, sum))"
        return F.expr(f"transform(sequence(0, {COALITIONS - 1}), s -> {members})").alias("worth" if column == "n" else column)
    # a part has a cell for each set of failed filters, 32 at most
    parts = rows.filter("n > 0").groupBy("part").agg(F.sum("n").alias("size"), F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.select("part", "size", over("n"), over("good"), over("toxic"))


def with_potentials(games: DataFrame) -> DataFrame:
    """Adds `potential`: for each coalition its potential times size factorial, by recursion over coalition sizes."""
    games = games.withColumn("potential", F.array_repeat(F.lit(0).cast("long"), COALITIONS))
    for size in range(1, len(FILTERS) + 1):
        less = " + ".join(f"if((s & {1 << i}) != 0, potential[s ^ {1 << i}], 0L)" for i in range(len(FILTERS)))
        games = games.withColumn("potential", F.expr(
            f"transform(sequence(0, {COALITIONS - 1}), s -> if(bit_count(s) = {size}, {factorial(size - 1)}L * worth[s] + {less}, potential[s]))"))
    return games


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    full = COALITIONS - 1
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = [(order, step) for order in permutations(FILTERS) for step in range(1, len(FILTERS) + 1)]
    orders = F.expr("array(" + ", ".join(
        f"named_struct('filter_order', '{''.join(order)}', 'step', {step}, 'own', {bit[order[step - 1]]}, 'upto', {sum(bit[f] for f in order[:step])})"
        for order, step in steps) + ")")
    rows = with_potentials(stored(worths(marked(docs, labels)), "worths")).select("*", F.explode(orders).alias("o")).select("*", "o.*")
    gain = lambda c: F.expr(f"{c}[upto] - {c}[upto ^ own]")
    times = factorial(len(FILTERS)) // factorial(len(FILTERS) - 1)
    return rows.select("part", "filter_order", F.col("step").cast("int").alias("step"), F.expr("size - worth[upto]").alias("kept"), gain("worth").alias("removed"),
                       F.expr("worth[own] - (worth[upto] - worth[upto ^ own])").alias("redundant"), F.expr(f"worth[{full}] - worth[{full} ^ own]").alias("unique_fails"),
                       gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"), F.expr(f"potential[{full}] - {times} * potential[{full} ^ own]").alias("shapley"))
