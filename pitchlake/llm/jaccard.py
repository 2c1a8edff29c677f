"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word shingles (3 words unless told otherwise, hashed to 64 bits). Two sets A, B of
similarity at least t = p / q (0.9 unless told otherwise) differ in at most (|A| + |B|) (q - p) / (q + p) elements. Sets
are sketched per size band: every element toggles one bit of one part of the sketch, so the Hamming distance of two
sketches of a band is at most the size of the symmetric difference. A part is carried as the XOR of the hashes of its
elements. A band has two parts more than two sets of it may differ in, hence two parts at least of linked sets are
equal: sets meet in buckets by (band, part, bits). A set with more filled parts than it may differ in meets all its
partners there. One with fewer (bands have spare parts, so few have) goes by (band, two empty parts) too, as one empty
part alone says little. A set joins further bands too when a partner of it, of at most |A| / t elements, may lie there.

Nodes of the join are distinct sets; copies within reach of a task are dropped before their buckets are made, others in
the bucket. Buckets are never stored: they are taken in `passes` passes by their hash, made anew from the texts in each,
and shuffled once. No bucket is expanded into pairs. Its least set is the pivot, and every member is held against the
pivot: first by whole sketches of 1,024 bits, whose Hamming distance must not exceed what linked sets may differ in, and
then, if it doesn't, on the full sets. Members linked with a pivot are connected already, so only its strays (members not
linked with it) can add a link: they are held against the pivot's members in cells of bounded numbers of both, again by
whole sketches first. The strays and members that come near any of the other kind are compared on their full sets: a
task counts shared elements as products of 0/1 matrices and returns the sets that the links connect, one row a set.
Components come from alternating star contraction. Tables are deleted as soon as the next step has read them.

Documents without words have the empty set and are linked with nothing; fewer words than a shingle are one shingle. A null
doc_id takes part and never names a component, unless the whole component has none. Rows that repeat are copies.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import arrays
from .tables import documents_of, release, stored, without

SHINGLE = 3
RATIO = 1.4  # upper size of a band over its lower size
SIMILARITY = 0.9
BLOCK = 1000              # members of one pivot that are compared at once
TASK_ITEMS = 1_000_000    # elements of the sets that a task gets, about
CELLS = 8_000_000        # entries of a matrix
BITS = 1024              # of a whole sketch
PASSES = 2               # parts in which the buckets are shuffled
SEEN = 200_000           # sets that a task remembers, to make the buckets of copies once
_PART = np.uint64(0xA0761D6478BD642F)


def bound(similarity: float) -> tuple[int, int]:
    """(m, n): sets are similar enough if m * |A xor B| <= n * (|A| + |B|); 19 and 1 for 0.9, which is 100 * |A and B| >= 90 * |A or B|."""
    t = Fraction(str(similarity))
    return t.denominator + t.numerator, t.denominator - t.numerator


def bands(largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper set sizes of all bands up to `largest`."""
    lows = [1]
    while lows[-1] <= largest:
        lows.append(max(lows[-1] + 1, int(lows[-1] * RATIO)))
    return np.array(lows[:-1]), np.array(lows[1:]) - 1


def shingle_sets(words: arrays.Words, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    grams = arrays.rolling(words.code, k)
    out = []
    for a, b in zip(words.first, words.first[1:]):
        if b - a >= k:
            out.append(np.unique(grams[a:b - k + 1]))
        else:
            out.append(arrays.rolling(words.code[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def set_code(s: np.ndarray) -> int:
    """Hash of a set: the scrambled sum of its scrambled elements, with its size."""
    total = np.sum(arrays.mix(s ^ _PART), dtype=np.uint64, keepdims=True) + np.array([len(s)], np.uint64) * _PART
    return int(arrays.signed(arrays.mix(total))[0])


def parts_of(high: int, apart: int) -> int:
    """Parts of a band: two more than sets of it may differ in, and as many as the largest sets are likely to leave empty."""
    empty = (apart + 2) * np.exp(-high / (apart + 2))
    return apart + 2 + int(empty + 3 * np.sqrt(empty))


def buckets(s: np.ndarray, band: int, parts: int, apart: int) -> np.ndarray:
    """The buckets of a set in a band: a part with its bits for every part that holds elements; every two empty parts, unless more than `apart` are filled."""
    spread = arrays.mix(s ^ _PART)
    part = ((spread >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    bits, filled = np.zeros(parts, dtype=np.uint64), np.zeros(parts, dtype=bool)
    np.bitwise_xor.at(bits, part, spread)
    filled[part] = True
    label = arrays.mix(np.arange(parts, dtype=np.uint64) + np.array([band << 40], dtype=np.uint64))
    one, two = np.triu_indices(int((~filled).sum()) if filled.sum() <= apart else 0, 1)
    empty = label[~filled]
    return np.concatenate([arrays.mix(bits[filled] ^ label[filled]), arrays.mix(empty[one] * np.uint64(3) ^ empty[two])])


def parity(s: np.ndarray) -> np.ndarray:
    """The whole sketch of a set: every element toggles one of its bits."""
    odd = np.bincount((arrays.mix(s ^ _PART) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def facts_of(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, n_shingles, code, sketch) of each document; the empty set has no sketch."""
    out = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("code", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                sets = shingle_sets(arrays.words_of(part.column("text"), arrays.SPACES, fold=True), shingle)
                yield pa.record_batch([part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
                                       pa.array([set_code(s) for s in sets], pa.int64()),
                                       pa.array([parity(s) if len(s) else None for s in sets], pa.list_(pa.int64()))], schema=out)

    return documents_of(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(
        run, "doc_id long, text_key long, n_shingles long, code long, sketch array<long>")


def sketched(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, passes: int = 1, turn: int = 0) -> DataFrame:
    """(code, buckets): the buckets of sets whose hash belongs to the pass; bands in which only equal sets are linked need none."""
    out = pa.schema([("code", pa.int64()), ("buckets", pa.list_(pa.int64()))])

    m, n = bound(similarity)
    t = Fraction(str(similarity))

    def most(size: int, high: int) -> int:
        """Elements in which a set may differ from a partner of a band."""
        return n * (size + min(high, size * t.denominator // t.numerator)) // m

    def run(batches):
        lows, highs = bands(1 << 40)
        seen: set[int] = set()
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                codes, rows = [], []
                for s in shingle_sets(arrays.words_of(part.column("text"), arrays.SPACES, fold=True), shingle):
                    code = set_code(s)
                    if not len(s) or code in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(code)
                    first, last = (int(np.searchsorted(lows, x, side="right")) - 1 for x in (len(s), len(s) * t.denominator // t.numerator))
                    apart = {b: 2 * n * int(highs[b]) // m for b in range(first, last + 1)}
                    mine = [buckets(s, b, parts_of(int(highs[b]), d), most(len(s), int(highs[b]))) for b, d in apart.items() if d]
                    if mine:
                        mine = np.concatenate(mine)
                        codes.append(code)
                        rows.append(arrays.signed(mine[mine % np.uint64(passes) == turn]))
                yield pa.record_batch([pa.array(codes, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], schema=out)

    return documents_of(docs).select("text").mapInArrow(run, "code long, buckets array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(code, n, items) of the sets of the documents named in `wanted` (doc, text_key), one row per set."""
    wanted = wanted.select(F.col("doc").alias("__doc"), F.col("text_key").alias("__key")).distinct()
    rows = documents_of(docs)
    rows = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["__doc"]) & (F.xxhash64(rows["text"]) == wanted["__key"]), "left_semi").select("text")
    out = pa.schema([("code", pa.int64()), ("n", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                sets = shingle_sets(arrays.words_of(part.column("text"), arrays.SPACES, fold=True), shingle)
                yield pa.record_batch([pa.array([set_code(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                                       pa.array([arrays.signed(s) for s in sets], pa.list_(pa.int64()))], schema=out)

    return rows.mapInArrow(run, "code long, n long, items array<long>").dropDuplicates(["code"])


def pivot_pairs(rows: DataFrame) -> DataFrame:
    """(pivot, code): each member of a bucket with the bucket's least set. Rows of a bucket are read in order, from disk if need be."""
    keys = rows.select("code", F.explode("buckets").alias("bucket"))
    order = Window.partitionBy("bucket").orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    return keys.withColumn("pivot", F.first("code").over(order)).filter("code != pivot").select("pivot", "code").distinct()


def screened(pairs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(pivot, code, near): false if the Hamming distance of the whole sketches alone shows that the sets aren't linked."""
    m, n = bound(similarity)
    others = nodes.select(F.col("code").alias("pivot"), F.col("n").alias("pivot_n"), F.col("sketch").alias("pivot_sketch"))
    apart = F.expr(" + ".join(f"bit_count(sketch[{i}] ^ pivot_sketch[{i}])" for i in range(BITS // 64)))
    both = pairs.join(nodes, "code").join(others, "pivot")
    return both.select("pivot", "code", (apart * m <= (F.col("n") + F.col("pivot_n")) * n).alias("near"))


def compared(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(pivot, code, n, linked): members against their pivots."""
    most, least = bound(similarity)
    others = sets.select(F.col("code").alias("pivot"), F.col("n").alias("pivot_n"), F.col("items").alias("pivot_items"))
    total = F.col("n") + F.col("pivot_n")
    apart = total - 2 * F.size(F.array_intersect("items", "pivot_items"))
    return pairs.join(sets, "code").join(others, "pivot").select("pivot", "code", "n", (apart * most <= total * least).alias("linked"))


def shared_counts(items: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Elements that each of the sets `rows` shares with each set, by matrix products of bounded size."""
    token, times = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(len(items)), [len(s) for s in items])
    shared = times[token] > 1
    place = np.cumsum(times > 1) - 1
    owner, token, width = owner[shared], place[token[shared]], int((times > 1).sum())
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    common = np.zeros((len(rows), len(items)), dtype=np.float32)
    step = max(1, CELLS // len(items))
    for begin in range(0, width, step):
        part = slice(*np.searchsorted(token, [begin, begin + step]))
        matrix = np.zeros((len(items), min(step, width - begin)), dtype=np.float32)
        matrix[owner[part], token[part] - begin] = 1
        common += matrix[rows] @ matrix.T
    return common


def connected(linked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each set the first of the sets that links connect it with; linked[i, j] says it of the sets rows[i] and j."""
    n = linked.shape[1]
    linked[np.arange(len(rows)), rows] = True
    label = np.arange(n)
    while True:
        least = np.where(linked, label[None, :], n).min(axis=1)
        new = label.copy()
        np.minimum.at(new, rows, least)
        new = np.minimum(new, np.where(linked, least[:, None], n).min(axis=0))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def in_cell(cell: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The sets of a cell, one row each, and which of them are strays."""
    cell = cell.sort_values("stray", ascending=False).drop_duplicates("code")
    return cell, np.flatnonzero(cell["stray"])


def among_members(frame: pd.DataFrame, similarity: float = SIMILARITY) -> pd.DataFrame:
    """(a, b): sets that links connect within each cell, a block of strays of a pivot and a block of its members."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    m, n = bound(similarity)
    for _, cell in frame.groupby(["pivot", "block", "turn"]):
        cell, strays = in_cell(cell)
        if not len(strays):
            continue
        sizes = cell["n"].to_numpy()
        total = sizes[strays, None] + sizes[None, :]
        label = connected((total - 2 * shared_counts(list(cell["items"]), strays)) * m <= total * n, strays)
        codes, rest = cell["code"].to_numpy(), np.flatnonzero(label != np.arange(len(label)))
        a.append(codes[label[rest]])
        b.append(codes[rest])
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def near_in_cells(frame: pd.DataFrame, similarity: float = SIMILARITY) -> pd.DataFrame:
    """(pivot, code) of the strays and members of each cell whose whole sketches come near enough to one of the other kind."""
    pivot, code = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    m, n = bound(similarity)
    for (name, _, _), cell in frame.groupby(["pivot", "block", "turn"]):
        cell, strays = in_cell(cell)
        if not len(strays):
            continue
        signs = 1 - 2 * np.unpackbits(np.stack(cell["sketch"]).view(np.uint8), axis=1).astype(np.float32)
        total = cell["n"].to_numpy()
        near = (BITS - signs[strays] @ signs.T) / 2 * m <= (total[strays, None] + total[None, :]) * n
        code.append(cell["code"].to_numpy()[partnered(near, strays)])
        pivot.append(np.full(len(code[-1]), name))
    return pd.DataFrame({"pivot": np.concatenate(pivot), "code": np.concatenate(code)})


def partnered(near: np.ndarray, strays: np.ndarray) -> np.ndarray:
    """Which sets of a cell are near another one; near[i, j] says it of the sets strays[i] and j."""
    near[np.arange(len(strays)), strays] = False
    some = near.any(axis=0)
    some[strays] |= near.any(axis=1)
    return some


def stray_cells(found: DataFrame, block: int, task_items: int) -> tuple[DataFrame, int]:
    """(pivot, block, turn, task, code, stray): strays of each pivot against its members, and the number of tasks to deal them to.

    A cell has about `block` strays and `block` members at most, and fewer if their sets (`n` elements) are large.
    """
    stray = F.when(~F.col("linked"), 1)
    per = found.groupBy("pivot").agg(F.count("*").alias("members"), F.sum("n").alias("items"), F.count(stray).alias("strays"),
                                     F.coalesce(F.sum(stray * F.col("n")), F.lit(0)).alias("stray_items")).filter("strays > 0 AND members > 1")
    parts = lambda count, items: F.greatest(F.ceil(F.col(count) / block), F.ceil(F.col(items) / task_items)).cast("int")
    per = stored(per.withColumns({"blocks": parts("members", "items"), "turns": parts("strays", "stray_items")}), "strays")
    tasks = max(1, -(-int(per.agg(F.sum(F.col("items") * F.col("turns") + F.col("stray_items") * F.col("blocks"))).first()[0] or 0) // task_items))
    rows = found.join(per.select("pivot", "blocks", "turns"), "pivot")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("code"), F.col(c)).cast("int")
    members = rows.select("pivot", own("blocks").alias("block"), each("turns").alias("turn"), "code", F.lit(False).alias("stray"))
    strays = rows.filter("NOT linked").select("pivot", each("blocks").alias("block"), own("turns").alias("turn"), "code", F.lit(True).alias("stray"))
    return members.unionByName(strays).withColumn("task", F.pmod(F.xxhash64("pivot", "block", "turn"), F.lit(tasks))), tasks


def links(found: DataFrame, sets: DataFrame, block: int = BLOCK, task_items: int = TASK_ITEMS, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): verified links between strays and members of a pivot, enough to connect what is linked, from (pivot, code, n, linked)."""
    cells, _ = stray_cells(found, block, task_items)
    return cells.join(sets, "code").groupBy("task").applyInPandas(lambda frame: among_members(frame, similarity), "a long, b long")


def sets_named(docs: DataFrame, classes: DataFrame, codes: DataFrame, shingle: int) -> DataFrame:
    """(code, n, items) of the full sets named in `codes`."""
    return sets_of(docs, classes.join(codes.distinct(), "code").select("doc", "text_key"), shingle)


def settled(docs: DataFrame, classes: DataFrame, nodes: DataFrame, pairs: DataFrame, partners, shingle: int, similarity: float,
            block: int = BLOCK, task_items: int = TASK_ITEMS) -> DataFrame:
    """(a, b): enough verified links to connect whatever is linked.

    `nodes` has code, n and sketch; `pairs` pivot, code and near (may be linked, by their sketches); `partners` names
    the sets of cells that are near each other by their sketches.
    """
    near = pairs.filter("near").select("pivot", "code")
    sets = stored(sets_named(docs, classes, near.select("code").union(near.select("pivot")), shingle), "shingle_sets")
    star = stored(compared(near, sets, similarity).filter("linked").select("pivot", "code", "linked"), "compared")
    members = pairs.join(star, ["pivot", "code"], "left").select("pivot", "code", F.coalesce("linked", F.lit(False)).alias("linked"))
    members = stored(members.join(nodes.select("code", F.size("sketch").cast("long").alias("n")), "code"), "members")
    cells, _ = stray_cells(members, 2 * block, task_items)
    met = stored(cells.join(nodes.select("code", "n", "sketch"), "code").groupBy("task").applyInPandas(partners, "pivot long, code long").distinct(), "met")
    more = stored(sets_named(docs, classes, met.join(sets, "code", "left_anti").select("code"), shingle), "more_sets")
    sets_met = sets.unionByName(more)
    found = stored(members.drop("n").join(met, ["pivot", "code"]).join(sets_met.select("code", "n"), "code"), "found")
    edges = links(found, sets_met, block, task_items, similarity).unionByName(star.select(F.col("pivot").alias("a"), F.col("code").alias("b")))
    edges = stored(edges.distinct(), "links")
    release(sets, more, star, members, met, found)
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, by alternating star contraction on stored edges."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    while True:
        # large star: every greater neighbour of a node points to the node's least neighbour
        turned = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = turned.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = turned.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours point to the least of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        last, edges = edges, stored(large.join(small, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(last)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def class_heads(facts: DataFrame) -> DataFrame:
    """(code, unnamed, doc, text_key): for each set but the empty one the document that stands for it, the one with the least doc_id."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc"), "text_key"))
    return facts.filter("n_shingles > 0").groupBy("code").agg(first.alias("m")).select("code", "m.*")


def grouped(facts: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id, and the document of the component that stands for it (keeper, keeper_key)."""
    joined = classes.join(roots, classes["code"] == roots["node"], "left").select("code", F.coalesce("root", "code").alias("root"), "unnamed", "doc", "text_key")
    heads = joined.groupBy("root").agg(F.min(F.struct("unnamed", "doc", "text_key")).alias("h"))
    named = joined.join(heads, "root").select("code", F.col("h.doc").alias("head"), F.col("h.text_key").alias("head_key"))
    out = facts.join(named, "code", "left")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", "text_key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("head")).alias("component_id"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("head")).alias("keeper"),
                      F.when(alone, F.col("text_key")).otherwise(F.col("head_key")).alias("keeper_key"))


def jaccard_join(docs: DataFrame, block: int = BLOCK, shingle: int = SHINGLE, similarity: float = SIMILARITY, passes: int = PASSES) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id, and the document of the component that stands for it (keeper, keeper_key)."""
    rows = stored(facts_of(docs, shingle), "sketched")
    facts, classes = stored(rows.drop("sketch"), "facts"), stored(class_heads(rows), "classes")
    nodes = stored(rows.filter("n_shingles > 0").groupBy("code").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    release(rows)
    parts = [stored(pivot_pairs(sketched(docs, shingle, similarity, passes, turn)), "pairs_of_pass") for turn in range(passes)]
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    pairs = stored(screened(pairs.distinct(), nodes, similarity), "pairs")
    release(*parts)
    edges = settled(docs, classes, nodes, pairs, lambda frame: near_in_cells(frame, similarity), shingle, similarity, block)
    release(pairs, nodes)
    return grouped(facts, classes, components(edges))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one document of each component, the one with the least doc_id; documents without words all stay."""
    found = stored(jaccard_join(docs, shingle=shingle, similarity=similarity), "components")
    lost = found.filter(~(F.col("doc_id").eqNullSafe(F.col("keeper")) & (F.col("text_key") == F.col("keeper_key"))))
    kept = without(docs, lost)
    again = found.filter("n_shingles > 0").groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key")
    if again.isEmpty():
        return kept
    # the same doc_id and text in several rows: one of them stays
    again = again.select(F.col("doc_id").alias("again_id"), F.col("text_key").alias("again_key"))
    repeated = kept.join(again, kept["doc_id"].cast("long").eqNullSafe(again["again_id"]) & (F.xxhash64(kept["text"]) == again["again_key"]), "left_semi")
    rest = without(kept, again.select(again["again_id"].alias("doc_id"), again["again_key"].alias("text_key")))
    return rest.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
