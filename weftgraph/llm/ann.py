"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a sample: a sixteenth of the vectors, but LEAST_SAMPLE at least and `sample` at most, those of the smallest
hash of their ids, brought to unit length. So leaves grow with the table up to that documented bound.
Every vector is put into the leaf that nearest centroids lead to. A query walks the tree through a priority queue of
nodes by the distance of their centroids and visits the leaves in the order in which they leave the queue. How many it
visits is calibrated: on queries from the sample, leaves are added until the recall against brute force over the
sample reaches `recall`. Leaves and their visitors meet in tasks of bounded size, so a hot leaf is split. Last, the results
of AUDIT queries are held against brute force over all vectors: below `least_recall`, visits double and the search runs again.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import append_columns, column, whole_groups
from weftgraph.llm.vectors import common_length, cosine, matrix, unit, usable
from weftgraph.session import materialize

SAMPLE, LEAST_SAMPLE, BRANCH, LEAF, PART_ROWS, AUDIT = 131_072, 8192, 8, 64, 4000, 128


class Tree:
    """Nodes as lists of child numbers and arrays of child centroids; a leaf has a number instead."""

    def __init__(self, x: np.ndarray, seed: int = 9) -> None:
        self.rng, self.centres, self.children, self.leaf, self.leaves = np.random.default_rng(seed), [], [], [], 0
        self._grow(x, 0)

    def _grow(self, x: np.ndarray, depth: int) -> int:
        at = len(self.leaf)
        self.centres.append(None)
        self.children.append([])
        self.leaf.append(-1)
        label = self._means(x) if len(x) > LEAF and depth < 20 else None
        if label is None:
            self.leaf[at] = self.leaves
            self.leaves += 1
            return at
        parts = [x[label == k] for k in np.unique(label)]
        self.centres[at] = np.array([p.mean(0) for p in parts])
        self.children[at] = [self._grow(p, depth + 1) for p in parts]
        return at

    def _means(self, x: np.ndarray) -> np.ndarray | None:
        c = x[self.rng.choice(len(x), BRANCH, replace=False)]
        for _ in range(10):
            label = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            c = np.array([x[label == k].mean(0) if (label == k).any() else c[k] for k in range(len(c))])
        return label if len(np.unique(label)) > 1 else None

    def assign(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[node]
            near = ((c * c).sum(1) - 2 * x[rows] @ c.T).argmin(1)
            todo += [(self.children[node][k], rows[near == k]) for k in np.unique(near)]
        return out

    def visit(self, q: np.ndarray, leaves: int) -> list[int]:
        queue, out = [(0.0, 0)], []
        while queue and len(out) < leaves:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            else:
                d = ((self.centres[node] - q) ** 2).sum(1)
                for k, child in enumerate(self.children[node]):
                    heapq.heappush(queue, (float(d[k]), child))
        return out

    def calibrate(self, x: np.ndarray, k: int, recall: float, queries: int = 300) -> int:
        """The fewest leaf visits, in steps of a twentieth of the leaves, that find this share of the k nearest of the sample."""
        leaf = self.assign(x)
        hits, total = np.zeros(self.leaves + 1), 0
        for i in range(min(queries, len(x))):
            score = x @ x[i]
            score[i] = -2
            place = {v: n for n, v in enumerate(self.visit(x[i], self.leaves))}
            for j in np.argsort(-score)[: min(k, len(x) - 1)]:
                hits[place[leaf[j]] + 1] += 1
                total += 1
        found = np.cumsum(hits) / max(1, total)
        step = max(1, self.leaves // 20)
        return next((n for n in range(step, self.leaves, step) if found[n] >= recall), self.leaves)


def search(vectors: DataFrame, is_query: str, k: int = 5, recall: float = 0.96, least_recall: float = 0.9, sample: int = SAMPLE, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that fulfils the SQL condition is_query.

    Nearest by cosine in double precision, ties to the smaller id; a query's own row is no candidate. Rows with a null id
    or an unusable vector (null, zero, null or non-finite components, or a length other than the most frequent) take no
    part. With fewer than k candidates all are returned. Rows that repeat an id are candidates, and queries, one by one: each such
    query has a ranking of its own, in which the others of its id may stand. No rows, no result.
    """
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.expr(f"coalesce({is_query}, false)").alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    dims = common_length(good, "v")
    good = materialize(good.where(F.size("v") == dims).withColumn("row", F.monotonically_increasing_id()), "vectors")
    spark = vectors.sparkSession
    x = good.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(max(LEAST_SAMPLE, min(sample, good.count() // 16))).select("v").toArrow().column("v")
    x = matrix(x)
    if not len(x):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = unit(x)
    tree = Tree(x)
    visits = tree.calibrate(x, k, recall)
    probe = good.where("asks").orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "row").limit(AUDIT).select("row", "v").toArrow()
    while True:
        found = _found(good, tree, visits, k)
        if visits >= tree.leaves or _recall(good, probe, found, k) >= least_recall:
            return found.select("query_id", "rank", "vec_id", "score")
        visits = min(2 * visits, tree.leaves)


def _recall(good: DataFrame, probe: pa.Table, found: DataFrame, k: int) -> float:
    """The share of the k nearest of the probes, by brute force over all vectors, that were found or others as near."""
    if not probe.num_rows:
        return 1.0
    shared = good.sparkSession.sparkContext.broadcast((probe.column("row").to_numpy(), matrix(probe.column("v"))))  # AUDIT vectors

    def best(batches):
        ids, v = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            score, other = unit(v) @ unit(matrix(column(b, "v"))).T, column(b, "row").to_numpy()
            score[ids[:, None] == other] = -3
            top = -np.sort(-score, axis=1)[:, :k]
            q, s = np.repeat(ids, top.shape[1]), top.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(q[s > -3]), pa.array(s[s > -3])], ["query", "true"])

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("true")))
    true = good.select("row", "v").mapInArrow(best, "query long, true double").withColumn("rank", rank).where(F.col("rank") <= k)
    last = true.groupBy("query").agg(F.min("true").alias("last"), F.count("*").alias("n"))
    hits = F.count_if(F.col("score") >= F.col("last") - 1e-9)
    shares = last.join(found.select("query", "score"), "query", "left").groupBy("query", "n").agg(F.least(hits, F.col("n")).alias("hits"))
    row = shares.agg(F.sum("hits"), F.sum("n")).first()
    return row[0] / row[1] if row[1] else 1.0


def _found(good: DataFrame, tree: Tree, visits: int, k: int) -> DataFrame:
    """The k nearest found with so many leaf visits, written down."""
    spark = good.sparkSession
    shared = spark.sparkContext.broadcast((tree, visits))  # at most 2 * sample centroids

    def place(b: pa.RecordBatch) -> list:
        t, n = shared.value
        u = unit(matrix(column(b, "v")))
        asks = column(b, "asks").to_pylist()
        return [t.assign(u).tolist(), [t.visit(q, n) if a else None for q, a in zip(u, asks)]]

    placed = materialize(append_columns(good, "leaf long, visits array<long>", place), "leaves")
    asked = placed.where("asks").select("row", "vec_id", "v", F.explode("visits").alias("leaf"))
    size = placed.groupBy("leaf").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    groups = asked.groupBy("leaf").agg(F.ceil(F.count("*") / PART_ROWS).alias("groups"))
    plan = size.join(groups, "leaf")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n))
    points = placed.select("row", "vec_id", "v", "leaf").join(plan, "leaf").withColumn("p", own("parts")).withColumn("g", every("groups"))
    askers = asked.join(plan, "leaf").withColumn("g", own("groups")).withColumn("p", every("parts"))
    cols = ["leaf", "p", "g"]
    rows = points.select(*cols, F.lit(0).alias("role"), "row", "vec_id", "v").unionByName(askers.select(*cols, F.lit(1).alias("role"), "row", "vec_id", "v"))

    def nearest(batches):
        for g in whole_groups(batches, cols):
            role, row, ids, v = g.column("role").to_numpy(), g.column("row").to_numpy(), g.column("vec_id").to_numpy(), matrix(g.column("v"))
            p, pid, own, q, qid, asks = v[role == 0], ids[role == 0], row[role == 0], v[role == 1], ids[role == 1], row[role == 1]
            if not len(p) or not len(q):
                continue
            out = ([], [], [], [])
            rough = unit(q) @ unit(p).T
            for r, a, name, one in zip(rough, asks, qid, q):
                r[own == a] = -3
                n = min(k, int((r > -3).sum()))
                if n:
                    near = np.flatnonzero(r >= np.partition(r, len(r) - n)[len(r) - n] - 1e-9)
                    near = near[r[near] > -3]
                    score = cosine(p[near], np.broadcast_to(one, (len(near), len(one))))
                    best = np.lexsort((pid[near], -score))[:k]
                    out[0].extend([a] * len(best))
                    out[1].extend([name] * len(best))
                    out[2].extend(pid[near][best].tolist())
                    out[3].extend(score[best].tolist())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.float64())], ["query", "query_id", "vec_id", "score"])

    near = rows.repartition(*cols).sortWithinPartitions(*cols, "role", "vec_id").mapInArrow(nearest, "query long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return materialize(near.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "query_id", "rank", "vec_id", "score"), "nearest")
