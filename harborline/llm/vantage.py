"""Nearest neighbours by inner product with one vantage-point tree per shard.

Vectors are dealt into shards by a hash of their id. In a shard every vector gets one more coordinate that gives all the same
length, so that the largest inner product is the least distance. A tree node holds a vantage point and, for each of its two
halves, the least and largest distance from it; by the triangle inequality a half is skipped if no vector in it can be nearer than
the k-th found so far. ``factor`` multiplies the bound: one restores the exact search, more skips more.

Queries are searched in blocks against each shard's tree and their nearest of all shards are merged. Products that decide are summed
pair by pair in double precision, so equal vectors have equal scores wherever they lie.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from harborline.llm.common import on_workers
from harborline.session import stored

SHARD_ROWS = 8192
QUERY_ROWS = 1024
LEAF_ROWS = 128
NEAREST = 20
QUERY_EVERY = 20
FACTOR = 1.2
# Products of matrices are only trusted up to this share of the vectors' lengths.
SLACK = 1e-9


@dataclass
class Node:
    low: int
    high: int  # the rows of this node
    vantage: np.ndarray | None = None
    bounds: tuple = ()  # of each child: least and largest distance from the vantage point
    children: tuple = ()


@dataclass
class Tree:
    ids: np.ndarray
    vectors: np.ndarray
    length: float
    root: Node


def build(ids: np.ndarray, vectors: np.ndarray) -> Tree:
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order].astype(float)
    length = float(np.sqrt((vectors**2).sum(1).max()))
    lifted = np.column_stack([vectors, np.sqrt(np.maximum(length**2 - (vectors**2).sum(1), 0))])
    rows = np.arange(len(ids))
    random = np.random.default_rng(len(ids))

    def split(low: int, high: int) -> Node:
        node = Node(low, high)
        if high - low <= LEAF_ROWS:
            return node
        part = lifted[rows[low:high]]
        # Of a few points, the one from which distances spread most.
        tried = part[random.integers(0, len(part), 8)]
        far = np.sqrt(np.maximum(((part[random.integers(0, len(part), 64)][:, None] - tried[None]) ** 2).sum(2), 0))
        node.vantage = tried[far.std(0).argmax()]
        distance = np.sqrt(((part - node.vantage) ** 2).sum(1))
        order = np.argsort(distance, kind="stable")
        rows[low:high] = rows[low:high][order]
        distance, middle = distance[order], (high - low) // 2
        node.bounds = ((distance[0], distance[middle - 1]), (distance[middle], distance[-1]))
        node.children = (split(low, low + middle), split(low + middle, high))
        return node

    root = split(0, len(ids))
    return Tree(ids[rows], vectors[rows].astype(np.float32), length, root)


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Per query the ids and scores of its ``k`` nearest of the tree, nearest first; -inf where there are fewer."""
    queries = queries.astype(float)
    vectors = tree.vectors.astype(float)
    square = (queries**2).sum(1)
    slack = SLACK * tree.length * np.sqrt(square)
    best = np.full((len(queries), k), -np.inf)
    best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def look(node: Node, rows: np.ndarray) -> None:
        near = queries[rows] @ vectors[node.low:node.high].T
        ids = tree.ids[node.low:node.high]
        near[query_ids[rows][:, None] == ids] = -np.inf
        least = best[rows, -1]
        if near.shape[1] > k:
            least = np.maximum(least, np.partition(near, -k, 1)[:, -k])
        which, column = np.nonzero(near >= (least - slack[rows])[:, None])
        exact = np.full(near.shape, -np.inf)
        exact[which, column] = np.einsum("ij,ij->i", queries[rows[which]], vectors[node.low + column])
        # One's own row, and what is not near enough, stays at -inf.
        exact[near == -np.inf] = -np.inf
        some = np.unique(which)
        found = np.concatenate([best[rows[some]], exact[some]], 1)
        found_ids = np.concatenate([best_ids[rows[some]], np.broadcast_to(ids, (len(some), len(ids)))], 1)
        found_ids = np.where(found == -np.inf, np.iinfo(np.int64).max, found_ids)
        order = np.lexsort((found_ids, -found), axis=1)[:, :k]
        best[rows[some]] = np.take_along_axis(found, order, 1)
        best_ids[rows[some]] = np.take_along_axis(found_ids, order, 1)

    def walk(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if not node.children:
            look(node, rows)
            return
        flat = node.vantage[:-1]
        distance = np.sqrt(np.maximum(tree.length**2 + square[rows] - 2 * (queries[rows] @ flat), 0))
        gaps = [np.maximum(np.maximum(distance - high, low - distance), 0) for low, high in node.bounds]
        first = gaps[1] < gaps[0]
        for side in (0, 1):
            nearer = first == bool(side)
            walk(node.children[side], rows[nearer])
            reach = np.sqrt(np.maximum(tree.length**2 + square[rows] - 2 * best[rows, -1], 0))
            other = nearer & (factor * gaps[1 - side] <= reach * (1 + SLACK) + SLACK)
            walk(node.children[1 - side], rows[other])

    walk(tree.root, np.arange(len(queries)))
    return best_ids, best


def usable(table: DataFrame) -> DataFrame:
    """vec_id, embedding and dimension of the vectors that take part: no null, zero or non-finite ones; repeated rows once."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return table.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & fine).distinct().withColumn("dimension", F.size("embedding"))


def build_index(vectors: DataFrame, shards: int) -> DataFrame:
    """One row per dimension and shard: dimension, shard, tree. Every vector is in one tree."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = build(rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()))
        return pd.DataFrame({"dimension": [key[0]], "shard": [key[1]], "tree": [pickle.dumps(tree)]})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dimension", "shard").applyInPandas(one, "dimension int, shard int, tree binary")


def nearest(table: DataFrame, k: int = NEAREST, every: int = QUERY_EVERY, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` vectors nearest to each vector whose id is divisible by ``every``.

    Ties go to the smaller vec_id. Only vectors of the same dimension are compared, and none with another of its own id.
    An empty table gives no rows.
    """
    on_workers(table.sparkSession)
    vectors = stored(usable(table), "vectors")
    shards = max(1, -(-vectors.count() // shard_rows))
    asked = vectors.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    index = stored(build_index(vectors, shards), "vantage-trees")
    trees = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    queries = asked.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def one(rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or tree.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        query_ids = rows["vec_id"].to_numpy()
        ids, scores = search(pickle.loads(tree["tree"].iat[0]), query_ids, np.stack(rows["embedding"].to_numpy()), k, factor)
        found = pd.DataFrame({"query_id": np.repeat(query_ids, k), "vec_id": ids.ravel(), "score": scores.ravel()})
        return found[found["score"] > -np.inf]

    keys = ["dimension", "shard", "block"]
    found = queries.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInPandas(one, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
