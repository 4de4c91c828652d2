"""Approximate nearest neighbours in a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is put into its leaf. A
query visits leaves best bin first: a priority queue holds tree nodes by the
distance of their centres, the nearest is opened next. How many leaves are
visited is calibrated: for a bounded set of queries the exact neighbours are
found by brute force, in blocks over all rows, and visits are widened until the
wanted share of these neighbours lies in visited leaves. A query whose leaves
hold too few other ids goes on in the same order.

Leaves are searched in blocks: a leaf with many vectors, or many visiting
queries, is dealt to as many tasks as keep a block within BLOCK_ROWS on either
side. Each block returns the best few of each query, whose merge is exact.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor those whose length is not the most frequent one
(the larger of equally frequent ones), nor rows without an id. Other columns, of
any name, are not looked at. Beyond MAX_LEAVES * LEAF_ROWS vectors leaves grow,
and with them the cost of a query. Equal rows are
candidates of their own; a query is no candidate of the rows with its id. Equal
scores go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bounds of what is sampled: rows that fit the tree, queries that calibrate.
SAMPLE_ROWS, CALIBRATION_QUERIES = 20_000, 200
LEAF_ROWS, MAX_LEAVES, BRANCH = 500, 4096, 8
BLOCK_ROWS = 8192
RECALL = 0.97
NEIGHBOURS = 5


@dataclass
class Tree:
    """centres[i], children[i] (empty for leaves) and leaf number of node i."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf_of: list[int] = field(default_factory=list)
    leaves: int = 0

    def add(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        self.leaf_of.append(-1)
        return len(self.centres) - 1


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = nearest_of(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def build(sample: np.ndarray, leaf_rows: int, branch: int = BRANCH, seed: int = 42) -> Tree:
    """A tree over unit vectors whose leaves hold about leaf_rows of the sample."""
    tree, rng = Tree(), np.random.default_rng(seed)
    root = tree.add(sample.mean(0) if len(sample) else np.zeros(sample.shape[1]))
    todo = [(root, sample)]
    while todo:
        node, x = todo.pop()
        k = min(branch, len(x) // max(leaf_rows, 1))
        own = nearest_of(x, centres := k_means(x, k, rng)) if k >= 2 else None
        parts = [] if own is None else [i for i in range(k) if (own == i).any()]
        if len(parts) < 2:
            tree.leaf_of[node], tree.leaves = tree.leaves, tree.leaves + 1
            continue
        for i in parts:
            child = tree.add(centres[i])
            tree.children[node].append(child)
            todo.append((child, x[own == i]))
    return tree


def leaves_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each unit vector, going down to the nearest child."""
    out, todo = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not tree.children[node]:
            out[rows] = tree.leaf_of[node]
            continue
        kids = tree.children[node]
        own = nearest_of(x[rows], np.array([tree.centres[c] for c in kids]))
        todo += [(c, rows[own == i]) for i, c in enumerate(kids) if (own == i).any()]
    return out


def visits(tree: Tree, query: np.ndarray, most: int, held: list[int] | None = None, least: int = 0) -> list[int]:
    """Leaves in the order of a best-bin-first search for a unit vector: `most`
    of them, and on until they hold `least` ids, by what each leaf holds."""
    queue, out, found = [(0.0, 0)], [], 0
    while queue and (len(out) < most or found < least):
        _, node = heapq.heappop(queue)
        kids = tree.children[node]
        if not kids:
            out.append(tree.leaf_of[node])
            found += held[out[-1]] if held else 0
            continue
        far = ((np.array([tree.centres[c] for c in kids]) - query) ** 2).sum(1)
        for d, c in zip(far.tolist(), kids, strict=True):
            heapq.heappush(queue, (d, c))
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best rows: places of queries, places of rows,
    scores. A product finds all rows that can be among them; their scores are
    then summed in one fixed order, so that equal vectors score equally."""
    q_norm, r_norm = np.sqrt((queries * queries).sum(1)), np.sqrt((rows * rows).sum(1))
    at_q, at_r, scores = [], [], []
    rough = (queries / q_norm[:, None]) @ (rows / r_norm[:, None]).T
    for i in range(len(queries)):
        s = np.where(ids == query_ids[i], -np.inf, rough[i])
        edge = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
        near = np.flatnonzero((s >= edge - 1e-9) & np.isfinite(s))
        exact = (rows[near] * queries[i]).sum(1) / (q_norm[i] * r_norm[near])
        order = np.lexsort((ids[near], -exact))[:k]
        at_q.append(np.full(len(order), i))
        at_r.append(near[order])
        scores.append(exact[order])
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(at_q, np.int64), join(at_r, np.int64), join(scores, np.float64)


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    usual = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return v.where(F.size("embedding") == (usual[0]["n"] if usual else 0))


def top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def calibrate(tree: Tree, index: DataFrame, asked: np.ndarray, asked_ids: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """Leaves to visit, and the recall that this gives on the queries asked,
    against brute force over the whole index."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, BLOCK_ROWS) for i in range(0, b.num_rows, BLOCK_ROWS)):
                ids, leaf = part.column(0).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)
                q, r, s = best(asked_ids, asked, ids, matrix(part.column(1)), k)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[r]), pa.array(s), pa.array(leaf[r])], names=["query_id", "vec_id", "score", "leaf"])

    truth = top(index.select("vec_id", "embedding", "leaf").mapInArrow(scan, "query_id long, vec_id long, score double, leaf long"), k).collect()
    order = [visits(tree, x, tree.leaves) for x in unit(asked)]
    place = np.array([order[t["query_id"]].index(t["leaf"]) for t in truth]) if truth else np.zeros(0)
    most = 1
    while most < tree.leaves and len(place) and (place < most).mean() < recall:
        most = min(tree.leaves, most + max(1, most // 4))
    return most, float((place < most).mean()) if len(place) else 1.0


def search(vectors: DataFrame, every: int = 50, k: int = NEIGHBOURS, recall: float = RECALL, seed: int = 42) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of each vector
    whose id is divisible by `every`, among all vectors but itself."""
    v = valid(vectors)
    n = v.count()
    spark = v.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    place = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30))
    drawn = v.where(place < int(min(1.0, SAMPLE_ROWS / n) * (1 << 30))).limit(2 * SAMPLE_ROWS).select("embedding").toPandas()
    sample = np.array(drawn["embedding"].tolist(), dtype=np.float64)
    if not len(sample):
        sample = np.array([v.first()["embedding"]])
    leaves = min(MAX_LEAVES, max(1, n // LEAF_ROWS))
    tree = build(unit(sample), max(1, len(sample) // leaves), seed=seed)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = leaves_of(tree, unit(matrix(b.column(1)))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf)], names=["vec_id", "embedding", "leaf"])

    index = cut(v.mapInArrow(put, "vec_id long, embedding array<double>, leaf long"))
    queries = index.where(F.pmod("vec_id", F.lit(every)) == 0)
    share = min(1.0, CALIBRATION_QUERIES / max(1, n // every))
    asked = queries.where(place < int(share * (1 << 30))).limit(2 * CALIBRATION_QUERIES).toPandas()
    if len(asked):
        most, _ = calibrate(tree, index, np.array(asked["embedding"].tolist(), dtype=np.float64), asked["vec_id"].to_numpy(), k, recall)
    else:
        most = tree.leaves
    most = max(most, min(2, tree.leaves))
    # At most MAX_LEAVES rows.
    counted = {r["leaf"]: r for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("vec_id").alias("ids")).collect()}
    held = [counted[leaf]["ids"] if leaf in counted else 0 for leaf in range(tree.leaves)]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in enumerate(unit(matrix(b.column(1)))) if b.num_rows else ():
                to = visits(tree, x, most, held, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), b.column(0)[i].as_py())), pa.array(to, pa.int64())], names=["query_id", "leaf"])

    visited = cut(queries.select("vec_id", "embedding").mapInArrow(visit, "query_id long, leaf long"))
    rows_in = {leaf: r["rows"] for leaf, r in counted.items()}
    # At most MAX_LEAVES rows.
    asked_of = {r["leaf"]: r["count"] for r in visited.groupBy("leaf").count().collect()}
    blocks = [(leaf, -(-rows_in.get(leaf, 0) // BLOCK_ROWS), -(-asked_of.get(leaf, 0) // BLOCK_ROWS)) for leaf in range(tree.leaves)]
    sizes = spark.createDataFrame([(a, max(1, b), max(1, c)) for a, b, c in blocks], "leaf long, row_blocks int, query_blocks int")
    small = F.broadcast(sizes)  # MAX_LEAVES rows
    own = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).distinct()
    q = visited.distinct().join(own, "query_id").join(small, "leaf")
    q = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)))
    r = index.join(small, "leaf").withColumn("rb", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("row_blocks")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))

    def block(qs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(rs):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        rows, ids, out = np.stack(rs["embedding"].to_numpy()), rs["vec_id"].to_numpy(), []
        for i in range(0, len(qs), 512):
            part = qs.iloc[i : i + 512]
            a, b, s = best(part["query_id"].to_numpy(), np.stack(part["query"].to_numpy()), ids, rows, k)
            out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[a], "vec_id": ids[b], "score": s}))
        return pd.concat(out)

    keys = ["leaf", "rb", "qb"]
    found = q.select(*keys, "query_id", "query").groupBy(*keys).cogroup(r.select(*keys, "vec_id", "embedding").groupBy(*keys)).applyInPandas(block, "query_id long, vec_id long, score double")
    return top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
