"""Approximate nearest neighbours: a forest of random-projection trees, one shared priority queue, exact reranking.

Trees are fitted on a bounded sample: each node splits its sample at the median of a projection onto the
difference of two of its vectors. Every row of the table is then indexed by its leaf in each tree. A query
descends all trees at once: one priority queue holds the open branches of all trees by their margin, and leaves
are taken from it until they hold the share of the sample that recall needs. That share is calibrated on
the sample itself, against brute force there, so it adapts to how hard the vectors are. All rows in the
taken leaves are candidates, and exact distances in double precision rank them.

Rows and queries meet in cells: a cell is a leaf of one tree, cut into blocks of rows and of queries where it holds
more than a block of either, so no task holds more than a block of each and only rows of taken leaves are
compared. Each cell gives its k best a query, and a window merges those. Of equal vectors (copies may be a third
of the table) only the k + 1 least ids take part, which is all that any query can need, and equal queries are
searched once; so a vector that stands often makes no large leaf.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part. Ties
go to the smaller vec_id. Repeated rows count once; of different vectors under one vec_id the least counts. Other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, materialize

#: Vectors that fit the forest at most, trees, vectors of the sample in a leaf; queries and rows of a cell's blocks.
SAMPLE, TREES, LEAF, BLOCK, ROWS = 16_384, 4, 64, 1024, 4096
#: Parts that the copies of one vector are ranked in first.
SALTS = 32
#: Recall that calibration asks for on the sample, and its trial queries.
RECALL, TRIALS = 0.95, 200


@dataclass
class Tree:
    """Inner node i has normal[i], split[i] and children[i]; a child below 0 is the leaf -1 - child."""

    normal: np.ndarray
    split: np.ndarray
    children: np.ndarray
    sizes: np.ndarray  # of the leaves, as shares of the sample

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64) if len(self.split) else np.full(len(x), -1)
        while (at := np.flatnonzero(node >= 0)).size:
            side = (np.einsum("ij,ij->i", x[at], self.normal[node[at]]) > self.split[node[at]]).astype(np.int64)
            node[at] = self.children[node[at], side]
        return -1 - node


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    normals, splits, children, sizes = [], [], [], []

    def node(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            for _ in range(8):
                a, b = x[rng.choice(rows, 2, replace=False)]
                normal = a - b
                if not np.linalg.norm(normal):
                    normal = rng.standard_normal(x.shape[1])
                normal = normal / np.linalg.norm(normal)
                along = x[rows] @ normal
                split = float(np.median(along))
                right = along > split
                if 0 < right.sum() < len(rows):
                    i = len(splits)
                    normals.append(normal), splits.append(split), children.append([0, 0])
                    children[i] = [node(rows[~right]), node(rows[right])]
                    return i
        sizes.append(len(rows) / len(x))
        return -len(sizes)

    node(np.arange(len(x)))
    return Tree(np.array(normals).reshape(-1, x.shape[1]), np.array(splits), np.array(children, dtype=np.int64).reshape(-1, 2), np.array(sizes))


def search(forest: list[Tree], q: np.ndarray, share: float) -> list[tuple[int, int]]:
    """(tree, leaf) pairs in the order of the shared queue, until the leaves' sizes sum up to `share`."""
    project = [t.normal @ q - t.split for t in forest]
    queue = [(0.0, k, 0 if len(t.split) else -1) for k, t in enumerate(forest)]
    out, held = [], 0.0
    while queue and held < share:
        margin, k, i = heapq.heappop(queue)
        tree, p = forest[k], project[k]
        while i >= 0:
            far, near = (0, 1) if p[i] > 0 else (1, 0)
            heapq.heappush(queue, (max(margin, abs(float(p[i]))), k, int(tree.children[i, far])))
            i = int(tree.children[i, near])
        out.append((k, -1 - i))
        held += float(tree.sizes[-1 - i])
    return out


def mask(forest: list[Tree], taken: list[list[tuple[int, int]]]) -> list[np.ndarray]:
    """For each tree a (leaves, queries) table of what was taken."""
    out = [np.zeros((len(t.sizes), len(taken)), dtype=bool) for t in forest]
    for j, pairs in enumerate(taken):
        for k, leaf in pairs:
            out[k][leaf, j] = True
    return out


def calibrate(forest: list[Tree], x: np.ndarray, k: int, recall: float, trials: int, rng: np.random.Generator) -> float:
    """The least share, of doubling steps with halves between, at which sample queries find `recall` of their
    nearest in the sample; all leaves if none does."""
    q = x[rng.choice(len(x), min(trials, len(x)), replace=False)]
    d = ((q[:, None, :] - x[None]) ** 2).sum(axis=2) if len(x) * len(q) * x.shape[1] < 4e6 else (q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * q @ x.T
    nearest = np.argsort(d, axis=1)[:, 1 : k + 1]
    at = [t.leaves(x) for t in forest]
    share = 1 / 64
    while share < len(forest):
        seen = np.zeros((len(x), len(q)), dtype=bool)
        for m, leaves in zip(mask(forest, [search(forest, v, share) for v in q]), at, strict=True):
            seen |= m[leaves]
        if np.mean([seen[nearest[j], j].mean() for j in range(len(q))]) >= recall:
            return share
        share *= 2**0.5
    return float(len(forest)) + 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector (floats as such, other numbers as doubles) of rows that take part, a row for each vec_id."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    x = F.col("embedding") if kind == "float" else F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("x", lambda v: v != 0)
    return rows.where(F.coalesce(fine, F.lit(False))).groupBy("vec_id").agg(F.min("x").alias("x"))


def least_copies(rows: DataFrame, most: int) -> DataFrame:
    """rows without those whose vector stands under `most` smaller ids. Only vectors that stand so often are looked at;
    their copies are ranked in SALTS parts first."""
    named = rows.withColumn("print", F.xxhash64("x"))
    often = materialize(named.groupBy("print").agg(F.count("*").alias("n")).where(F.col("n") > most).select("print"), "forest-copies")
    if not often.limit(1).count():
        return rows
    few = named.join(often, "print", "left_semi")
    for group in (["x", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))], ["x"]):
        nth = F.row_number().over(Window.partitionBy(*group).orderBy("vec_id"))
        few = few.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
    return materialize(named.join(often, "print", "left_anti").unionByName(few).drop("print"), "forest-vectors")


def fit(rows: DataFrame, k: int, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, trials: int = TRIALS, seed: int = 5) -> tuple[list[Tree], float, int]:
    """Forest, share of leaves to take, and the vectors' length, from the `sample` rows whose id hashes lowest."""
    size = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not size:
        return [], 0.0, 0
    dim = size[0]["n"]
    found = rows.where(F.size("x") == dim).orderBy(F.xxhash64("vec_id", F.lit("forest")), "vec_id").limit(sample).select("x").toPandas()
    x = np.array(found["x"].tolist(), dtype=np.float64)
    rng = np.random.default_rng(seed)
    forest = [grow(x, leaf, rng) for _ in range(trees)]
    return forest, calibrate(forest, x, k, recall, trials, rng) if len(x) > k else float(trees) + 1, dim


def best_of(key: tuple, rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k nearest rows of a cell to each of its queries."""
    q_id, v_id = queries["query_id"].to_numpy(), rows["vec_id"].to_numpy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(q_id) and len(v_id):
        matrix = lambda t: t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
        q, x = matrix(queries), matrix(rows)
        rough = np.maximum((q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None] - 2 * (q @ x.T), 0)
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(v_id) > k else np.full(len(q_id), np.inf)
        slack = 1e-9 * ((q**2).sum(axis=1) + (x**2).sum(axis=1).max())
        for j in range(len(q_id)):  # exact distances of what rounding could still bring among the k best
            near = np.flatnonzero(rough[j] <= kth[j] * (1 + 1e-9) + slack[j])
            d = np.sqrt(((x[near] - q[j]) ** 2).sum(axis=1))
            best = np.lexsort((v_id[near], d))[:k]
            out.append((np.full(len(best), q_id[j]), v_id[near][best], d[best]))
    each = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)]
    return pa.table({"query_id": pa.array(each[0], pa.int64()), "vec_id": pa.array(each[1], pa.int64()), "score": pa.array(each[2], pa.float64())})


def in_blocks(side: DataFrame, own: str, key: str, own_size: int, sizes: DataFrame, other_size: int) -> DataFrame:
    """side, dealt into the blocks of its cells and repeated for each block of the other side.

    sizes: cell, rows, queries - a row a leaf, so its number is bounded by the forest's size.
    """
    others = "queries" if own == "rows" else "rows"
    blocks = lambda c, n: F.greatest(F.ceil(F.col(c) / n), F.lit(1)).cast("int")
    met = side.join(F.broadcast(sizes), "cell").withColumn(own, F.pmod(F.xxhash64(key), blocks(own, own_size)).cast("int"))
    return met.withColumn(others, F.explode(F.sequence(F.lit(0), blocks(others, other_size) - 1))).select("cell", "rows", "queries", key, "x")


def nearest(vectors: DataFrame, is_query: str | Column, k: int = 10, block: int = BLOCK, rows_block: int = ROWS, **settings) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other rows. is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    every = materialize(usable(vectors), "forest-vectors")
    few = least_copies(every, k + 1)
    forest, share, dim = fit(few, k, **settings)
    if not forest:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    trees, kind = spark.sparkContext.broadcast(forest), every.schema["x"].dataType.simpleString()

    def index(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for b in batches:
            x = np.array(b["x"], dtype=np.float64).reshape(-1, dim)
            yield b | {"cells": np.column_stack([t.leaves(x) + (n << 32) for n, t in enumerate(trees.value)]).tolist()}

    def take(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for b in batches:
            found = [search(trees.value, np.array(x, dtype=np.float64), share) for x in b["x"]]
            yield b | {"cells": [[leaf + (n << 32) for n, leaf in f] for f in found]}

    rows = materialize(map_columns(few.where(F.size("x") == dim), index, f"vec_id long, x {kind}, cells array<long>"), "forest-rows")
    asked = every.where(F.size("x") == dim).where(is_query)
    leaders = asked.groupBy("x").agg(F.min("vec_id").alias("query_id"))
    queries = materialize(map_columns(leaders, take, f"query_id long, x {kind}, cells array<long>"), "forest-queries")
    of_rows, of_queries = rows.withColumn("cell", F.explode("cells")), queries.withColumn("cell", F.explode("cells"))
    sizes = of_rows.groupBy("cell").agg(F.count("*").alias("rows")).join(of_queries.groupBy("cell").agg(F.count("*").alias("queries")), "cell")
    sizes = materialize(sizes, "forest-cells")
    cell = ["cell", "rows", "queries"]
    left = in_blocks(of_rows, "rows", "vec_id", rows_block, sizes, block).groupBy(*cell)
    right = in_blocks(of_queries, "queries", "query_id", block, sizes, rows_block).groupBy(*cell)
    found = left.cogroup(right).applyInArrow(lambda key, x, q: best_of(key, x, q, k + 1), "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.withColumn("before", F.lag("vec_id").over(order)).where("before is null or before <> vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1).select(F.col("query_id").alias("leader"), "vec_id", "score")
    named = asked.select(F.col("vec_id").alias("query_id"), "x").join(leaders.withColumnRenamed("query_id", "leader"), "x").select("query_id", "leader")
    met = named.join(ranked, "leader").where("vec_id <> query_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
