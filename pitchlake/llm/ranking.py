"""Ranked lexical search, term at a time over short lists and document at a time over long ones.

`postings` stores the corpus as inverted segments: one row holds, for a few megabytes of text, its documents with their
lengths and for every term of the queries the ascending list of documents with the term and its occurrences. A segment is
complete for its documents, so no posting is shuffled. Counts over all segments give N, L and the df of each term.

A search goes through a segment once for each query. The lists of rare terms are added up first into accumulators, term
at a time; those are from then on one iterator among the long lists, with the greatest accumulator as its bound. The
iterators are ordered by bound. Those whose bounds together stay below the score of the query's current k-th document
cannot bring up a new document: candidates come from the others, document by document, and the lists in front are only
skipped into, the greatest bound first, dropping candidates that can't reach that score any more. The k best go on to the
next segment of the task as threshold. All of this is exact: bounds are the greatest contributions that occur.

Scores are 64-bit integers, as the weights are; see `score` below. Every task returns at most k rows a query, of which a
ranked window keeps the k best. Queries travel in blocks of bounded size, a broadcast and a pass over the index each.

A null text has no terms, and such documents don't count; queries without terms have no rows. Rows that repeat are
documents of their own; a null doc_id is ranked behind all others of equal score. Query rows equal in item_id and text are
one query. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import arrays
from .tables import documents_of, stored

BEST = 10
SEGMENT_BYTES = 4 << 20
BLOCK_ITEMS = 20_000     # queries of a broadcast
SHORT_SHARE = 64         # a list is short if it names at most one document in so many of its segment
NO_NAME = np.iinfo(np.int64).max

SEGMENT = "doc_id array<long>, n_terms array<int>, term array<long>, stop array<int>, row array<int>, tf array<int>"
FOUND = "item bigint, doc_id long, score long"


def terms_of(items: DataFrame) -> DataFrame:
    """(item_id, item, term, times): the terms of each query; `item` tells queries apart."""
    out = pa.schema([("item", pa.int64()), ("term", pa.int64()), ("times", pa.int64())])

    def cut(batches):
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                words = arrays.words_of(part.column("text"), arrays.NON_ALNUM, fold=True)
                names = np.asarray(part.column("item"))
                for name, a, b in zip(names, words.first, words.first[1:]):
                    term, times = np.unique(arrays.signed(words.code[a:b]), return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(term), name)), pa.array(term), pa.array(times, pa.int64())], schema=out)

    rows = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    rows = rows.withColumn("item", F.xxhash64(F.col("item_id").isNull(), F.col("item_id").cast("string"), F.col("text").isNull(), "text"))
    return rows.select("item_id", "item").join(rows.select("item", "text").mapInArrow(cut, "item long, term long, times long"), "item")


def term_bits(terms: DataFrame, bits: int) -> np.ndarray:
    """A bit for the low bits of every query term; its size does not depend on the queries."""
    slots = terms.select(F.col("term").bitwiseAND(bits - 1).alias("slot")).distinct().toArrow().column("slot")
    table = np.zeros(bits, dtype=bool)
    table[np.asarray(slots, dtype=np.int64)] = True
    return np.packbits(table)


def postings(docs: DataFrame, packed: np.ndarray, bits: int, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The segments of the index, not yet stored: documents with at least one term, and the lists of terms that queries may hold."""
    kept = docs.sparkSession.sparkContext.broadcast(packed)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    out = pa.schema([(n, pa.list_(k)) for n, k in zip(("doc_id", "n_terms", "term", "stop", "row", "tf"), kinds)])

    def run(batches):
        table = np.unpackbits(kept.value).astype(bool)
        for batch in batches:
            for part in arrays.slices(batch, "text", segment_bytes):
                words = arrays.words_of(part.column("text"), arrays.NON_ALNUM, fold=True)
                some = words.counts > 0
                ids = part.column("doc_id").fill_null(NO_NAME).to_numpy(zero_copy_only=False)[some]
                place = np.cumsum(some) - 1
                held = np.flatnonzero(table[(words.code & np.uint64(bits - 1)).astype(np.int64)])
                code, row = arrays.signed(words.code)[held], place[words.row_of_word()[held]]
                order = np.argsort(code, kind="stable")
                code, row = code[order], row[order]
                new = np.ones(len(code), dtype=bool)
                new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(new)
                tf = np.diff(np.append(first, len(code)))
                term, begin = np.unique(code[first], return_index=True)
                columns = (ids, words.counts[some], term, np.append(begin[1:], len(first))[:len(term)], row[first], tf)
                yield pa.record_batch([pa.array([c], pa.list_(k)) for c, k in zip(columns, kinds)], schema=out)

    return documents_of(docs).mapInArrow(run, SEGMENT)


class Segment:
    """A segment with the contribution of each posting for a weight of 1."""

    def __init__(self, batch: pa.RecordBatch, k: int, n: int, total: int):
        get = lambda c: np.asarray(batch.column(c)[k].values)
        self.doc_id, self.term, self.row = get("doc_id"), get("term"), get("row")
        self.stop = get("stop").astype(np.int64)
        self.begin = np.append(0, self.stop[:-1])[:len(self.stop)]
        tf = get("tf").astype(np.int64)
        share = 25 + (75 * get("n_terms").astype(np.int64) * n) // max(total, 1)
        self.part = (1_000_000_000 * tf) // (1000 * tf + 8 * share[self.row])
        self.most = np.maximum.reduceat(self.part, self.begin) if len(self.begin) else self.part

    def spots(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term among the segment's, -1 if it isn't there."""
        if not len(self.term):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.term, terms), len(self.term) - 1)
        return np.where(self.term[at] == terms, at, -1)


class Best:
    """The k best documents of a query so far: greatest scores, then least doc_id."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def bar(self) -> int:
        """A document that scores less can't be among the k best."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[:self.k]
        self.score, self.doc = score[order], doc[order]


def short_sums(segment: Segment, spots: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: the documents of short lists, ascending, with their summed contributions."""
    rows = np.concatenate([segment.row[segment.begin[s]:segment.stop[s]] for s in spots])
    parts = np.concatenate([segment.part[segment.begin[s]:segment.stop[s]] * w for s, w in zip(spots, weights)])
    docs, where = np.unique(rows, return_inverse=True)
    sums = np.zeros(len(docs), dtype=np.int64)
    np.add.at(sums, where, parts)
    return docs, sums


def search_segment(segment: Segment, spots: np.ndarray, weights: np.ndarray, best: Best, short: int) -> None:
    """Puts the segment's best documents for one query into `best`."""
    spots, weights = spots[spots >= 0], weights[spots >= 0]
    bounds = weights * segment.most[spots]
    if not len(spots) or int(bounds.sum()) < best.bar:
        return
    small = segment.stop[spots] - segment.begin[spots] <= short
    # iterators: (bound, documents, contributions), the accumulators being one of them
    lists = [(int(b), segment.row[segment.begin[s]:segment.stop[s]], segment.part[segment.begin[s]:segment.stop[s]], int(w))
             for s, w, b in zip(spots[~small], weights[~small], bounds[~small])]
    if small.any():
        docs, sums = short_sums(segment, spots[small], weights[small])
        lists.append((int(sums.max()), docs, sums, 1))
    lists.sort(key=lambda x: x[0])
    upto = np.cumsum([x[0] for x in lists])
    passive = int(np.searchsorted(upto, best.bar))  # lists whose bounds together stay below the bar
    active = lists[passive:]
    if not active:
        return
    candidates = active[0][1] if len(active) == 1 else np.unique(np.concatenate([x[1] for x in active]))
    score = np.zeros(len(candidates), dtype=np.int64)
    for place in range(len(lists) - 1, -1, -1):
        _, docs, parts, weight = lists[place]
        at = np.minimum(np.searchsorted(docs, candidates), len(docs) - 1)
        score += np.where(docs[at] == candidates, parts[at] * weight, 0)
        left = int(upto[place - 1]) if place else 0
        alive = score + left >= best.bar
        if not alive.all():
            candidates, score = candidates[alive], score[alive]
        if not len(candidates):
            return
    keep = score > 0
    best.add(score[keep], segment.doc_id[candidates[keep]])


def search(index: DataFrame, rows: list, n: int, total: int, k: int, short_share: int) -> DataFrame:
    """(item, doc_id, score): at most k documents of each task for each query of a block."""
    names = sorted({r["item"] for r in rows})
    number = {name: i for i, name in enumerate(names)}
    rows = sorted(rows, key=lambda r: (number[r["item"]], r["term"]))
    owner = np.array([number[r["item"]] for r in rows])
    query = index.sparkSession.sparkContext.broadcast((
        np.array(names, np.int64), np.array([r["term"] for r in rows], np.int64), np.array([r["weight"] for r in rows], np.int64),
        np.searchsorted(owner, np.arange(len(names) + 1))))
    out = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        names, terms, weights, cut = query.value
        found = [Best(k) for _ in names]
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch, i, n, total)
                spots, short = segment.spots(terms), len(segment.doc_id) // short_share
                for q, best in enumerate(found):
                    search_segment(segment, spots[cut[q]:cut[q + 1]], weights[cut[q]:cut[q + 1]], best, short)
        for begin in range(0, len(found), 1000):
            part = found[begin:begin + 1000]
            doc = np.concatenate([b.doc for b in part])
            yield pa.record_batch([pa.array(np.repeat(names[begin:begin + 1000], [len(b.doc) for b in part])), pa.array(doc, mask=doc == NO_NAME),
                                   pa.array(np.concatenate([b.score for b in part]))], schema=out)

    return index.select("doc_id", "n_terms", "term", "stop", "row", "tf").mapInArrow(run, FOUND)


def rank(docs: DataFrame, items: DataFrame, k: int = BEST, segment_bytes: int = SEGMENT_BYTES, short_share: int = SHORT_SHARE,
         block: int = BLOCK_ITEMS, bits: int = 1 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each query.

    A document's score is the sum over the query's terms, repeats included, of weight * ((10**9 tf) div (1000 tf + 8 m)),
    with m = 25 + (75 n N) div L and weight = floor(1000 ln((2 N + 2) / (2 df + 1))).
    """
    terms = stored(terms_of(items), "query_terms")
    index = stored(postings(docs, term_bits(terms, bits), bits, segment_bytes), "postings")
    n, total = index.agg(F.sum(F.size("doc_id")), F.sum(F.expr("aggregate(n_terms, 0L, (a, x) -> a + x)"))).first()
    n, total = n or 0, total or 0
    lists = index.select(F.explode(F.expr("transform(term, (t, i) -> struct(t AS term, stop[i] - if(i = 0, 0, stop[i - 1]) AS n))")).alias("x"))
    df = lists.select("x.*").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.log((F.lit(2.0) * n + 2) / (2 * F.col("df") + 1)) * 1000)
    weighted = stored(terms.select("item", "term", "times").join(df, "term").select("item", "term", (weight * F.col("times")).cast("long").alias("weight"))
                      .filter("weight > 0"), "query_weights")
    blocks = -(-weighted.select("item").distinct().count() // block)
    found = None
    for b in range(blocks):
        rows = weighted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()  # about `block` queries
        if rows:
            part = search(index, rows, n, total, k, short_share)
            found = part if found is None else found.unionByName(part)
    names = terms.select("item", "item_id").distinct()
    if found is None:
        return names.limit(0).select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")
