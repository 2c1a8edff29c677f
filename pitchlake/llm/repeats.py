"""Substring dedup by prefix-partitioned suffix trees.

The suffixes of a document are dealt out by a prefix of words that every occurrence of a repeat shares: the least
8-word gram (by hash) within the suffix's first `window` words. Consecutive suffixes mostly share it, so a run of them
travels as one piece of text, not as `window` words each. Groups whose runs all come from one document hold no repeat.
Equal runs collapse to the first document that has them; only where a group has different runs does a tree decide.

Groups are packed into tasks of bounded size. A task sorts the suffixes of its runs by doubling prefixes, up to the
depth of `window` words; suffixes that are equal so far are the leaves below one deep internal node. A suffix is a
repeat if its node has a leaf in a smaller doc_id. Groups with more runs than `group_runs` get a longer prefix, all
`window` words: such a group is a single node, and its least doc_id is an aggregate, without a tree.

Documents with a null doc_id or null text take no part, and keep all words. Rows that repeat a doc_id are the same
document: none of them is smaller. Shorter texts than a window have no window.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays
from .tables import documents_of, stored

WINDOW = 50
GRAM = 8
GROUP_RUNS = 2000
TASK_RUNS = 4000


def runs_of(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, prefix, content, start, n): runs of n windows from word `start` on that share their prefix."""
    out = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("prefix", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def run(batches):
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                words = arrays.words_of(part.column("text"), arrays.SPACES)
                at = np.flatnonzero(arrays.whole_within(words, window))
                least = arrays.sliding_min(arrays.rolling(words.code, gram), window - gram + 1)[at]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (np.diff(at) > 1) | (least[1:] != least[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(at)))
                begin = at[first]
                row = np.searchsorted(words.first, begin, side="right") - 1
                content = arrays.hash_spans(words.code, begin, begin + n + window - 1)
                yield pa.record_batch([part.column("doc_id").take(pa.array(row)), part.column("text_key").take(pa.array(row)),
                                       pa.array(arrays.signed(least[first])), pa.array(arrays.signed(content)),
                                       pa.array(begin - words.first[row], pa.int32()), pa.array(n, pa.int32())], schema=out)

    rows = documents_of(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, prefix long, content long, start int, n int")


def with_rows(docs: DataFrame, facts: DataFrame, columns: list[str], how: str) -> DataFrame:
    """(doc_id, text, facts): documents with the facts (array of structs) known about their (doc_id, text_key)."""
    # rows that repeat a document repeat its facts
    facts = facts.select("doc_id", "text_key", *columns).distinct()
    grouped = facts.groupBy(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).agg(F.collect_list(F.struct(*columns)).alias("facts"))
    rows = documents_of(docs)
    return rows.join(grouped, (rows["doc_id"] == grouped["__doc"]) & (F.xxhash64(rows["text"]) == grouped["__key"]), how).select("doc_id", "text", "facts")


def pieces_of(docs: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """(prefix, content, owner, n, piece): the words of the chosen runs as text."""
    out = pa.schema([("prefix", pa.int64()), ("content", pa.int64()), ("owner", pa.int64()), ("n", pa.int32()), ("piece", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                rows = []
                for doc, text, facts in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "facts"))):
                    words = text.encode().split()
                    rows += [(f["prefix"], f["content"], doc, f["n"], b" ".join(words[f["start"]:f["start"] + f["n"] + window - 1])) for f in facts]
                yield pa.record_batch([pa.array([r[i] for r in rows], out.field(i).type) for i in range(5)], schema=out)

    return (with_rows(docs, chosen, ["prefix", "content", "start", "n"], "inner")
            .mapInArrow(run, "prefix long, content long, owner long, n int, piece binary").dropDuplicates(["prefix", "content"]))


def deep_nodes(ids: np.ndarray, depth: int) -> np.ndarray:
    """The node at `depth` words above each suffix, by doubling prefixes; `ids` numbers the words, negative ones end a piece."""
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < depth:
        step = min(have, depth - have)
        ahead = np.append(rank[step:], np.full(min(step, len(rank)), -1))[:len(rank)]
        rank = np.unique((rank << np.int64(32)) | (ahead + 1), return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


def tree_repeats(frame: pd.DataFrame, window: int = WINDOW) -> pd.DataFrame:
    """(prefix, content, skip, n): the windows of each run that a smaller doc_id has too, as spans within the run."""
    numbers: dict[bytes, int] = {}
    ids, suffix, owner, source = [], [], [], []
    place = 0
    for i, (doc, n, piece) in enumerate(zip(frame["owner"], frame["n"], frame["piece"])):
        words = piece.split()
        ids.append(np.array([numbers.setdefault(w, len(numbers)) for w in words] + [-1 - i]))
        suffix.append(np.arange(place, place + n))
        owner.append(np.full(n, doc))
        source.append(np.full(n, i))
        place += len(words) + 1
    suffix, owner, source = np.concatenate(suffix), np.concatenate(owner), np.concatenate(source)
    node = deep_nodes(np.concatenate(ids), window)[suffix]
    least = np.full(node.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, owner)
    hit = np.flatnonzero(least[node] < owner)
    new = np.ones(len(hit), dtype=bool)
    new[1:] = (np.diff(suffix[hit]) > 1) | (np.diff(source[hit]) > 0)
    first = np.flatnonzero(new)
    run, begin = source[hit[first]], suffix[hit[first]]
    start_of = np.zeros(len(frame), dtype=np.int64)
    start_of[source[::-1]] = suffix[::-1]
    return pd.DataFrame({"prefix": frame["prefix"].to_numpy()[run], "content": frame["content"].to_numpy()[run],
                         "skip": (begin - start_of[run]).astype(np.int32), "n": np.diff(np.append(first, len(hit))).astype(np.int32)})


def whole_prefix_repeats(pieces: DataFrame, window: int) -> DataFrame:
    """The same for oversized groups: windows dealt by all their words."""
    out = pa.schema([("node", pa.int64()), ("prefix", pa.int64()), ("content", pa.int64()), ("owner", pa.int64()), ("skip", pa.int32())])

    def run(batches):
        for batch in batches:
            for part in arrays.slices(batch.set_column(4, "piece", batch.column("piece").cast(pa.string())), "piece"):
                words = arrays.words_of(part.column("piece"), arrays.SPACES)
                at = np.flatnonzero(arrays.whole_within(words, window))
                row = np.searchsorted(words.first, at, side="right") - 1
                node = arrays.rolling(words.code, window)[at]
                take = lambda c: part.column(c).take(pa.array(row))
                yield pa.record_batch([pa.array(arrays.signed(node)), take("prefix"), take("content"), take("owner"), pa.array(at - words.first[row], pa.int32())], schema=out)

    windows = stored(pieces.mapInArrow(run, "node long, prefix long, content long, owner long, skip int"), "whole_prefixes")
    nodes = windows.groupBy("node").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).filter("least < most").drop("most")
    return windows.join(nodes, "node").filter("least < owner").select("prefix", "content", "skip", F.lit(1).alias("n"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, group_runs: int = GROUP_RUNS, task_runs: int = TASK_RUNS) -> DataFrame:
    """(doc_id, text_key, start, n): n windows from word `start` on whose words also start in a smaller doc_id."""
    runs = stored(runs_of(docs, window), "runs")
    groups = runs.groupBy("prefix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("prefix")
    runs = stored(runs.join(groups, "prefix"), "shared_runs")
    first = F.min(F.struct("doc_id", "text_key", "start", "n")).alias("r")
    contents = runs.groupBy("prefix", "content").agg(first).select("prefix", "content", "r.*")
    sized = contents.groupBy("prefix").agg(F.count("*").alias("runs")).filter("runs > 1")
    contents = stored(contents.join(sized, "prefix", "left"), "run_contents")
    unsettled = contents.filter("runs > 1")
    pieces = stored(pieces_of(docs, unsettled.select("doc_id", "text_key", "prefix", "content", "start", "n"), window)
                    .join(sized, "prefix"), "run_pieces")
    tasks = max(1, -(-pieces.filter(F.col("runs") <= group_runs).count() // task_runs))
    trees = (pieces.filter(F.col("runs") <= group_runs).withColumn("task", F.pmod(F.xxhash64("prefix"), F.lit(tasks)))
             .groupBy("task").applyInPandas(lambda frame: tree_repeats(frame, window), "prefix long, content long, skip int, n int"))
    inner = trees.unionByName(whole_prefix_repeats(pieces.filter(F.col("runs") > group_runs).drop("runs"), window))
    owners = contents.select("prefix", "content", F.col("doc_id").alias("owner"))
    owned = runs.join(owners, ["prefix", "content"])
    copies = owned.filter("doc_id > owner").select("doc_id", "text_key", "start", "n")
    firsts = owned.filter("doc_id = owner").drop("n").join(inner, ["prefix", "content"]).select(
        "doc_id", "text_key", (F.col("start") + F.col("skip")).alias("start"), "n")
    return copies.unionByName(firsts)


def remove_repeats(docs: DataFrame, window: int = WINDOW, group_runs: int = GROUP_RUNS, task_runs: int = TASK_RUNS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept, the words that stay, joined by one space (UTF-8)."""
    found = stored(repeated_windows(docs, window, group_runs, task_runs), "repeated_windows")
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                rows = []
                for text, facts in zip(part.column("text").to_pylist(), part.column("facts").to_pylist()):
                    words = (text or "").encode().split()
                    kept = words
                    if facts:
                        gone = arrays.covered(len(words), [f["start"] for f in facts], [f["start"] + f["n"] + window - 1 for f in facts])
                        kept = list(compress(words, ~gone))
                    rows.append((len(words), len(words) - len(kept), b" ".join(kept)))
                yield pa.record_batch([part.column("doc_id")] + [pa.array([r[i] for r in rows], out.field(i + 1).type) for i in range(3)], schema=out)

    return with_rows(docs, found, ["start", "n"], "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
