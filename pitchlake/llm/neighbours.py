"""Approximate nearest neighbours with a forest of random-projection trees.

Trees are fitted on a bounded sample (parameter `sample`, smallest hashes): a node splits its vectors at the median of
a random direction. Every vector is indexed: it is routed to one leaf of each tree. A query walks all trees through one
priority queue, nearest boundary first, and collects leaves until they hold the share `search` of all vectors as seen
in the sample, and k other vectors at least. Leaves and the queries that want them meet in Spark by (tree, leaf); large leaves and much wanted ones
are split into blocks. Distances are exact, in double precision on the original vectors, and the nearest of the leaf
candidates are kept, ties to the smaller vec_id.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those of another length
than the commonest (ties: the greater), nor rows without a vec_id. Rows that repeat vec_id and vector are one row.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .tables import stored

TREES = 6
SAMPLE = 20_000
LEAF = 400      # sample vectors of a leaf, at most; in small samples a 32nd of them
SEARCH = 1.5    # leaves of all trees overlap, so this is below that share of different vectors
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048


@dataclass
class Tree:
    """Inner nodes have a direction, a threshold and two children; leaves have children -1 and a share of the sample."""

    direction: np.ndarray
    threshold: np.ndarray
    children: np.ndarray
    share: np.ndarray
    unit: float     # the share of one vector

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector, level by level."""
        at = np.zeros(len(vectors), dtype=np.int64)
        moving = np.arange(len(vectors))
        while len(moving):
            moving = moving[self.children[at[moving], 0] >= 0]
            node = at[moving]
            right = np.einsum("ij,ij->i", vectors[moving], self.direction[node]) > self.threshold[node]
            at[moving] = self.children[node, right.astype(int)]
        return at


def grow(vectors: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    direction, threshold, children, share = [], [], [], []

    def add(rows: np.ndarray) -> int:
        node = len(share)
        direction.append(np.zeros(vectors.shape[1]))
        threshold.append(0.0)
        children.append([-1, -1])
        share.append(len(rows) / len(vectors))
        return node

    todo = [(add(np.arange(len(vectors))), np.arange(len(vectors)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf:
            continue
        way = rng.standard_normal(vectors.shape[1])
        way /= np.linalg.norm(way)
        along = vectors[rows] @ way
        cut = np.median(along)
        right = along > cut
        if not right.any():  # copies only, or a median that is the largest value
            cut = along.min()
            right = along > cut
            if not right.any():
                continue
        direction[node], threshold[node] = way, cut
        sides = rows[~right], rows[right]
        children[node] = [add(s) for s in sides]
        todo += zip(children[node], sides)
    return Tree(np.array(direction), np.array(threshold), np.array(children), np.array(share), 1 / len(vectors))


def walk(forest: list[Tree], vector: np.ndarray, search: float, least: float = 0.0) -> list[tuple[int, int]]:
    """Leaves as (tree, node) through one queue over all trees, nearest boundary first.

    They hold `search` of the sample, a vector counted once per tree, and those of some tree alone, which are different
    vectors, hold `least` of it.
    """
    margins = [t.direction @ vector - t.threshold for t in forest]
    queue = [(0.0, i, 0) for i in range(len(forest))]
    found, held = [], np.zeros(len(forest))
    while queue and (held.sum() < search or held.max() < least):
        far, tree, node = heapq.heappop(queue)
        t = forest[tree]
        while t.children[node, 0] >= 0:
            margin = margins[tree][node]
            heapq.heappush(queue, (max(far, abs(margin)), tree, int(t.children[node, int(margin <= 0)])))
            node = int(t.children[node, int(margin > 0)])
        found.append((tree, node))
        held[tree] += t.share[node]
    return found


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vec, row_key) of the vectors that take part, doubles of one length."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec")).filter(
        "vec_id IS NOT NULL AND vec IS NOT NULL AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vec, x -> x != 0)")
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).select("n")
    rows = rows.join(F.broadcast(length), F.size("vec") == F.col("n"), "left_semi")  # one row
    return rows.withColumn("row_key", F.xxhash64("vec_id", "vec")).dropDuplicates(["vec_id", "row_key"])


def fit_forest(rows: DataFrame, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, seed: int = 5) -> list[Tree]:
    picked = rows.select("vec", F.xxhash64("row_key", F.lit(seed)).alias("order")).orderBy("order").limit(sample).select("vec").toArrow()
    if not picked.num_rows:
        return []
    vectors = np.stack(picked.column("vec").combine_chunks().flatten().to_numpy().reshape(picked.num_rows, -1))
    rng = np.random.default_rng(seed)
    return [grow(vectors, max(min(leaf, len(vectors) // 32), 10), rng) for _ in range(trees)]


_INDEX = "tree int, leaf int, vec_id long, row_key long, vec array<double>"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def placed(rows: DataFrame, forest, route) -> DataFrame:
    """Rows with every (tree, leaf) that `route(forest, vectors)` gives: (row number, tree, leaf) arrays."""
    out = pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("vec_id", pa.int64()), ("row_key", pa.int64()), ("vec", pa.list_(pa.float64()))])

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK_QUERIES):
                batch = whole.slice(begin, BLOCK_QUERIES)
                row, tree, leaf = route(forest.value, _matrix(batch.column("vec")))
                for cut in range(0, len(row), 1 << 15):
                    part = slice(cut, cut + (1 << 15))
                    take = [batch.column(c).take(pa.array(row[part])) for c in ("vec_id", "row_key", "vec")]
                    yield pa.record_batch([pa.array(tree[part], pa.int32()), pa.array(leaf[part], pa.int32()), *take], schema=out)

    return rows.select("vec_id", "row_key", "vec").mapInArrow(run, _INDEX)


def to_leaves(forest: list[Tree], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(vectors)
    return np.tile(np.arange(n), len(forest)), np.repeat(np.arange(len(forest)), n), np.concatenate([t.leaves(vectors) for t in forest])


def nearest_in(index: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of a block of a leaf for each query; distances summed component by component, the same in every block."""
    empty = pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "row_key": [], "square": []})
    if not len(index) or not len(queries):
        return empty
    index = index.sort_values(["vec_id", "row_key"])
    vectors, ids, keys = np.stack(index["vec"]).T.copy(), index["vec_id"].to_numpy(), index["row_key"].to_numpy()
    out = []
    for begin in range(0, len(queries), 256):
        part = queries.iloc[begin:begin + 256]
        wanted = np.stack(part["vec"])
        square = np.zeros((len(part), len(ids)))
        for d in range(len(vectors)):
            square += (wanted[:, d, None] - vectors[None, d]) ** 2
        own = (part["vec_id"].to_numpy()[:, None] == ids) & (part["row_key"].to_numpy()[:, None] == keys)
        square[own] = np.inf
        best = np.argsort(square, axis=1, kind="stable")[:, :k]
        q = np.repeat(np.arange(len(part)), best.shape[1])
        found = pd.DataFrame({"query_id": part["vec_id"].to_numpy()[q], "query_key": part["row_key"].to_numpy()[q], "vec_id": ids[best.ravel()],
                              "row_key": keys[best.ravel()], "square": square[q, best.ravel()]})
        out.append(found[np.isfinite(found["square"])])
    return pd.concat(out)


def nearest(table: DataFrame, vector: str = "embedding", every: int = 100, k: int = 10, trees: int = TREES, sample: int = SAMPLE,
            leaf: int = LEAF, search: float = SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every` its k nearest rows found, by Euclidean distance."""
    rows = stored(usable(table, vector), "vectors")
    model = fit_forest(rows, trees, sample, leaf)
    if not model:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    forest = rows.sparkSession.sparkContext.broadcast(model)

    # a query's own row and k others are among the leaves that it wants, as far as the sample has so many
    least = (k + 1) * model[0].unit - 1e-9

    def to_walks(forest, vectors):
        found = [walk(forest, v, search, least) for v in vectors]
        flat = np.array([x for f in found for x in f]).reshape(-1, 2)
        return np.repeat(np.arange(len(found)), [len(f) for f in found]), flat[:, 0], flat[:, 1]

    index = stored(placed(rows, forest, to_leaves), "forest")
    visits = stored(placed(rows.filter(F.col("vec_id") % every == 0), forest, to_walks), "visits")
    # of copies of one vector in a leaf only the k + 1 of least vec_id can be among a query's k nearest
    same = Window.partitionBy("tree", "leaf", F.xxhash64("vec"), "vec").orderBy("vec_id", "row_key")
    index = stored(index.withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k + 1).drop("copy"), "forest_copies")
    size = index.groupBy("tree", "leaf").agg(F.count("*").alias("n")).join(visits.groupBy("tree", "leaf").agg(F.count("*").alias("q")), ["tree", "leaf"])
    size = size.select("tree", "leaf", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"), F.ceil(F.col("q") / BLOCK_QUERIES).cast("int").alias("turns"))
    size = stored(size, "leaf_blocks")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = index.join(size, ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("row_key"), "blocks").cast("int")).withColumn("turn", each("turns"))
    right = visits.join(size, ["tree", "leaf"]).withColumn("turn", F.pmod(F.xxhash64("row_key"), "turns").cast("int")).withColumn("block", each("blocks"))
    key = ["tree", "leaf", "block", "turn"]
    keep = [*key, "vec_id", "row_key", "vec"]
    found = left.select(keep).groupBy(key).cogroup(right.select(keep).groupBy(key)).applyInPandas(
        lambda a, b: nearest_in(a, b, k), "query_id long, query_key long, vec_id long, row_key long, square double")
    order = Window.partitionBy("query_id", "query_key").orderBy("square", "vec_id", "row_key")
    best = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", F.sqrt("square").alias("score"))
