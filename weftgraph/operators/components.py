"""Connected components by alternating large-star and small-star rounds.

Before that, each task joins what its own edges connect, CHUNK edges at a time: a chain or a near-clique whose edges lie together falls to
a star at once. Edges lead from the larger to the smaller id. A round looks up, for an end of each edge, the smallest neighbour
of that end. The lookup is dealt by the end and a salt made of the edge's other end, so that the edges of a hub, such as the
smallest node of a large component, are spread over SALTS tasks (and AQE may split those). Labels never leave the
executors; the driver sees a row count and a checksum per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import materialize

SALTS, CHUNK = 8, 500_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges (a, b) and the smallest node that each reaches, by hooking roots and halving paths."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while len(u):
        x, y = root[u], root[v]
        live = x != y
        u, v, x, y = u[live], v[live], x[live], y[live]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return names, names[root]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def star(held):
        a, b = smallest_reachable(*(np.concatenate(c) for c in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= CHUNK:
            yield star(held)
            held, n = [], 0
    if n:
        yield star(held)


def _lowest(edges: DataFrame, end: str, other: str) -> DataFrame:
    """edges with m, the smallest neighbour that is smaller than the node in column `end`; null if it has none."""
    low = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    low = low.select("node", "m", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    salted = edges.withColumn("own", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    # no broadcast: planned by the size of what is on disk, the salted lookup would be many times that
    met = salted.join(low.hint("merge"), (F.col(end) == F.col("node")) & (F.col("own") == F.col("salt")), "left")
    return met.select("a", "b", "m")


def _round(edges: DataFrame) -> DataFrame:
    # large star: every larger neighbour of a node goes to the node's smallest neighbour, or to the node itself
    large = _lowest(edges, "b", "a").select("a", F.coalesce("m", "b").alias("b")).distinct()
    # small star: a node and its smaller neighbours go to the smallest of these
    low = _lowest(large, "a", "b").where("m is not null")
    moved = low.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    own = low.where("b <> m").select("a", F.col("m").alias("b"))
    return moved.unionByName(own).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the smallest reachable id.

    Null endpoints and self-loops are ignored, direction and repeats do not matter.
    """
    e = edges.select(F.col(u).alias("x"), F.col(v).alias("y")).where("x is not null and y is not null and x <> y")
    e = e.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    if dict(e.dtypes)["a"] == "bigint":
        e = e.mapInArrow(_contracted, "a long, b long")
    e = materialize(e.distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        e = materialize(_round(e), "stars", replaces=e)
        mark = tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
