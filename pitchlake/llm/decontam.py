"""Benchmark decontamination by a distributed positional inverted index.

`build_index` stores the corpus as index segments: one row holds, for about a megabyte of text, its documents and for
every stored term the ascending list of its places. A segment is complete for its documents, so lists are intersected
inside a segment and no posting is ever shuffled. `find` takes the test windows in blocks of bounded size, each against
all segments: terms ordered from the rarest in the corpus, lists shifted by the term's offset and intersected.
With `slop` the shifted lists need only come near each other (proximity matches).

Terms that no test item holds can't be in a match; a bit table of fixed size over the test terms keeps them out of
the index, while they still count as places. Null texts have no words; items without words have no window; an item
with a null item_id marks words and has no name in the list of items. Rows that repeat are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays
from .tables import RowNumbers, documents_of, stored

WINDOW = 13
FILTER_BITS = 1 << 20
BLOCK_WINDOWS = 50_000

SEGMENT = ("segment long, row array<int>, doc_id array<long>, text_key array<long>, n_words array<int>, base array<long>, "
           "term array<long>, stop array<int>, place array<int>")
MATCH = "segment long, row int, item array<string>, start array<int>, length array<int>, distance array<int>"


def test_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, codes): the windows of each item, term hashes in order; shorter items are one window."""
    schema = "item string, codes array<long>"
    out = pa.schema([("item", pa.string()), ("codes", pa.list_(pa.int64()))])

    def cut(batches):
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                words = arrays.words_of(part.column("text"), arrays.NON_ALNUM, fold=True)
                code, names = arrays.signed(words.code), part.column("item").to_pylist()
                rows = [(name, code[p:min(p + window, b)]) for name, a, b in zip(names, words.first, words.first[1:])
                        for p in range(a, max(b - window + 1, min(a + 1, b)))]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], schema=out)

    items = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(cut, schema).distinct()


def term_filter(windows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for the low bits of every test term; its size does not depend on the test."""
    slots = windows.select(F.explode("codes").alias("c")).select(F.col("c").bitwiseAND(bits - 1).alias("slot")).distinct()
    table = np.zeros(bits, dtype=bool)
    table[np.asarray(slots.toArrow().column("slot"), dtype=np.int64)] = True
    return np.packbits(table)


def build_index(docs: DataFrame, packed: np.ndarray, bits: int = FILTER_BITS, gap: int = 64) -> DataFrame:
    """The segments of the index, not yet stored. Places of different documents lie at least `gap` apart."""
    kept = docs.sparkSession.sparkContext.broadcast(packed)
    out = pa.schema([("segment", pa.int64()), ("row", pa.list_(pa.int32())), ("doc_id", pa.list_(pa.int64())), ("text_key", pa.list_(pa.int64())),
                     ("n_words", pa.list_(pa.int32())), ("base", pa.list_(pa.int64())), ("term", pa.list_(pa.int64())),
                     ("stop", pa.list_(pa.int32())), ("place", pa.list_(pa.int32()))])

    def segments(batches: Iterator[pa.RecordBatch]):
        numbers, table = RowNumbers(), np.unpackbits(kept.value).astype(bool)
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                words = arrays.words_of(part.column("text"), arrays.NON_ALNUM, fold=True)
                base = words.first[:-1] + np.arange(part.num_rows) * gap
                held = np.flatnonzero(table[(words.code & np.uint64(bits - 1)).astype(np.int64)])
                code = arrays.signed(words.code)[held]
                order = np.argsort(code, kind="stable")
                term, first = np.unique(code[order], return_index=True)
                place = (held + words.row_of_word()[held] * gap)[order]
                one = lambda x, kind: pa.array([x], pa.list_(kind))
                yield pa.record_batch([
                    pa.array(numbers.take(1), pa.int64()), one(np.arange(part.num_rows), pa.int32()),
                    pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), one(np.asarray(part.column("text_key")), pa.int64()),
                    one(words.counts, pa.int32()), one(base, pa.int64()), one(term, pa.int64()),
                    one(np.append(first[1:], len(place)), pa.int32()), one(place, pa.int32())], schema=out)

    rows = documents_of(docs).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(segments, SEGMENT)


def by_rarity(windows: DataFrame, index: DataFrame) -> DataFrame:
    """Windows all of whose terms the index holds, with the offsets of their terms from the rarest to the commonest."""
    terms = windows.select(F.explode("codes").alias("term")).distinct()
    counts = index.select(F.explode(F.arrays_zip("term", "stop", F.expr("concat(array(0), slice(stop, 1, greatest(size(stop) - 1, 0)))").alias("begin"))).alias("t"))
    counts = counts.select(F.col("t.term").alias("term"), (F.col("t.stop") - F.col("t.begin")).alias("n")).groupBy("term").agg(F.sum("n").alias("n")).join(terms, "term")
    spread = windows.select("item", "codes", F.posexplode("codes").alias("offset", "term")).join(counts, "term")
    return (spread.groupBy("item", "codes").agg(F.expr("transform(array_sort(collect_list(struct(n, offset))), x -> x.offset)").alias("order"))
            .filter("size(order) = size(codes)"))


def _search(segment: dict, windows: list, slop: int) -> Iterator[tuple[int, int, int]]:
    """(window, start place, distance) of each match; distance is the largest shift of a term from its exact place."""
    term, stop, place = segment["term"], segment["stop"], segment["place"]
    begin = np.append(0, stop[:-1])
    for number, (at, order) in enumerate(windows):
        if at is None:
            continue
        rare = order[0]
        starts = place[begin[at[rare]]:stop[at[rare]]].astype(np.int64) - rare
        far = np.zeros(len(starts), dtype=np.int64)
        for offset in order[1:]:
            if not len(starts):
                break
            listed = place[begin[at[offset]]:stop[at[offset]]]
            wanted = starts + offset
            after = np.minimum(np.searchsorted(listed, wanted), len(listed) - 1)
            shift = np.minimum(np.abs(listed[after] - wanted), np.abs(listed[np.maximum(after - 1, 0)] - wanted))
            near = shift <= slop
            starts, far = starts[near], np.maximum(far[near], shift[near])
        for s, d in zip(starts, far):
            yield number, int(s), int(d)


def find(index: DataFrame, plan: DataFrame, slop: int = 0, block: int = BLOCK_WINDOWS) -> DataFrame | None:
    """Matches by document (MATCH), the windows of `plan` taken in blocks of at most `block`; None without windows."""
    context, passes, held = index.sparkSession.sparkContext, [], []
    out = pa.schema([("segment", pa.int64()), ("row", pa.int32()), ("item", pa.list_(pa.string())), ("start", pa.list_(pa.int32())),
                     ("length", pa.list_(pa.int32())), ("distance", pa.list_(pa.int32()))])

    def one_pass(rows):
        query = context.broadcast([(r["item"], np.array(r["codes"], np.int64), list(r["order"])) for r in rows])

        def search(batches):
            windows = query.value
            flat = np.concatenate([w[1] for w in windows])
            cuts = np.cumsum([len(w[1]) for w in windows])[:-1]
            for batch in batches:
                for k in range(batch.num_rows):
                    segment = {n: np.asarray(batch.column(n)[k].values) for n in ("term", "stop", "place", "base", "n_words")}
                    if not len(segment["term"]):
                        continue
                    spot = np.minimum(np.searchsorted(segment["term"], flat), len(segment["term"]) - 1)
                    there = [x.all() for x in np.split(segment["term"][spot] == flat, cuts)]
                    plan_here = [(at if ok else None, w[2]) for at, ok, w in zip(np.split(spot, cuts), there, windows)]
                    found: dict[int, list] = {}
                    for number, start, distance in _search(segment, plan_here, slop):
                        row = int(np.searchsorted(segment["base"], max(start, 0), side="right")) - 1
                        start -= int(segment["base"][row])
                        found.setdefault(row, []).append((windows[number][0], start, len(windows[number][1]), distance))
                    rows = sorted(found.items())
                    yield pa.record_batch([pa.array([batch.column("segment")[k].as_py()] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32())]
                                          + [pa.array([[x[i] for x in r[1]] for r in rows], out.field(i + 2).type) for i in range(4)], schema=out)

        return index.mapInArrow(search, MATCH)

    for row in plan.toLocalIterator():
        held.append(row)
        if len(held) == block:
            passes.append(one_pass(held))
            held = []
    if held:
        passes.append(one_pass(held))
    if not passes:
        return None
    matches = passes[0]
    for more in passes[1:]:
        matches = matches.unionByName(more)
    return matches


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, share: int = 20) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, items (sorted names) and contaminated.

    A word is hit inside any match; contaminated means hit words, and at least one in `share` of all words.
    """
    windows = stored(test_windows(items, window), "test_windows")
    index = stored(build_index(docs, term_filter(windows), gap=window + slop + 1), "index")
    rows = index.select("segment", F.explode(F.arrays_zip("row", "doc_id", "text_key", "n_words")).alias("r")).select("segment", "r.*")
    matches = find(index, by_rarity(windows, index), slop)
    if matches is None:
        hits = rows.limit(0).select("segment", "row", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    else:
        spans = "flatten(transform(sequence(0, size(start) - 1), i -> sequence(start[i], start[i] + length[i] - 1)))"
        hits = (matches.select("segment", "row", "item", F.expr(f"array_distinct({spans})").alias("hit"))
                .groupBy("segment", "row").agg(F.flatten(F.collect_list("hit")).alias("hit"), F.flatten(F.collect_list("item")).alias("item"))
                .select("segment", "row", F.size(F.array_distinct("hit")).cast("long").alias("n_hit"),
                        F.expr("array_sort(array_distinct(filter(item, x -> x is not null)))").alias("items")))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(hits, ["segment", "row"], "left").select(
        "doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))
