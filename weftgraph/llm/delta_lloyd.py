"""Centroid clustering of integer vectors by delta Lloyd.

The table of a round holds each vector with its owner and the squared distance to it; the centroids, their exact sums and
counts are k rows of integers on the driver. A round reads that table once and writes the next:

1. A vector whose owner stayed where it was is compared with the changed centroids only: among the unchanged, its owner is still
   the nearest. A vector whose owner moved is compared with all.
2. A vector that changes hands adds its components to the new owner and takes them from the old. A task sums these
   signed transfers up, and writes at most a row for each centroid beside its vectors; no vector is shuffled.
3. The transfers bring the sums up to date; a centroid is the floor of sum / count, an empty one stays.

All of it is integer arithmetic: distances come from matrix products in doubles where every term is below 2**53, else in longs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import column, lean, small_batches
from weftgraph.session import materialize

#: Components whose distances are exact in doubles, and those whose distances over 64 components fit a long.
EXACT, LARGEST = 1 << 22, 1 << 27
STATE = "vec_id long, q binary, owner int, distance long, cluster int, n long, inertia long, moved array<long>"
NAMES = [c.split()[0] for c in STATE.split(", ")]


def quantised(v: Column, scale: int) -> Column:
    """Each component x as floor(scale * x), x as double."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _usable(v: Column, dims: int) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dims) & fine, F.lit(False))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to those of c, exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if most > EXACT or 4 * x.shape[1] * most**2 >= 1 << 53:
        return np.stack([((x - one) ** 2).sum(1) for one in c], axis=1) if len(c) else np.zeros((len(x), 0), np.int64)
    a, b = x.astype(np.float64), c.astype(np.float64)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


def reassigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, c: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the centroids of `changed` (a mask) moved to where c has them. An owner of -1 counts as moved."""
    owner, distance = owner.copy(), distance.copy()
    far = np.flatnonzero((owner < 0) | changed[owner])
    if len(far):
        d = distances(x[far], c)
        owner[far] = d.argmin(1)
        distance[far] = d[np.arange(len(far)), owner[far]]
        stay = np.ones(len(owner), bool)
        stay[far] = False
        near = np.flatnonzero(stay)
    else:
        near = np.arange(len(owner))
    which = np.flatnonzero(changed)
    if len(near) and len(which):
        d = distances(x[near], c[which])
        k = d.argmin(1)
        best = d[np.arange(len(near)), k]
        win = (best < distance[near]) | ((best == distance[near]) & (which[k] < owner[near]))
        owner[near[win]], distance[near[win]] = which[k[win]], best[win]
    return owner, distance


def _round(c: np.ndarray, changed: np.ndarray, dims: int):
    """Vectors with their new owners, and at the end of a task its transfers and sums of distances by centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(c)
        moved, n, inertia = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for b in batches:
            q, m = column(b, "q"), b.num_rows
            if not m:
                continue
            x = np.frombuffer(b"".join(q.to_pylist()), np.int32).reshape(m, dims).astype(np.int64)
            old = np.asarray(column(b, "owner")).astype(np.int64)
            owner, distance = reassigned(x, old, np.asarray(column(b, "distance")), c, changed)
            for j in np.flatnonzero(np.bincount(owner, minlength=k)):
                inertia[j] += distance[owner == j].sum()
            hand = np.flatnonzero(owner != old)
            for sign, of in ((1, owner[hand]), (-1, old[hand])):
                for j in np.unique(of[of >= 0]):
                    pick = hand[of == j]
                    moved[j] += sign * x[pick].sum(0)
                    n[j] += sign * len(pick)
            yield pa.RecordBatch.from_arrays([column(b, "vec_id"), q, pa.array(owner, pa.int32()), pa.array(distance), *(pa.nulls(m, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], NAMES)
        some = np.flatnonzero((moved != 0).any(1) | (n != 0) | (inertia != 0))
        m = len(some)
        sums = [pa.array(some, pa.int32()), pa.array(n[some]), pa.array(inertia[some]), pa.array(moved[some].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(m, t) for t in (pa.int64(), pa.binary(), pa.int32(), pa.int64())), *sums], NAMES)

    return run


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) for every vector that takes part.

    Vectors have exactly `dims` components, none null or non-finite; others give no row. A component x counts as floor(scale * x); one
    beyond 2**27 in size is an error, as its distances may exceed a long. Centroids start as the k vectors of smallest hex sha256 of
    `seed:id`, fewer if there are fewer; ties go by components, null ids come last and the rest of them by components.
    Rows that repeat an id or a vector count one by one; of equal centroids the first owns. Other columns are not read. No rows, no result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(_usable(F.col("v"), dims)).select("vec_id", quantised(F.col("v"), scale).alias("v"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    c = np.array([r["v"] for r in good.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()], np.int64).reshape(-1, dims)  # k rows
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not len(c):
        return spark.createDataFrame([], out)
    k = len(c)

    def packed(batches):
        for b in batches:
            x = np.asarray(column(b, "v").flatten(), np.int64)
            if len(x) and (x.max() > LARGEST or x.min() < -LARGEST):
                raise ArithmeticError(f"a component is beyond {LARGEST} in size")
            rows = x.astype(np.int32).reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([column(b, "vec_id"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(np.full(len(rows), -1, np.int32)), pa.array(np.zeros(len(rows), np.int64))], NAMES[:4])

    state = materialize(good.mapInArrow(packed, ", ".join(STATE.split(", ")[:4])), "vectors")
    sums, counts, changed = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.ones(k, bool)
    for step in range(rounds + 1):
        state = materialize(state.where("q is not null").select(NAMES[:4]).mapInArrow(lean(_round(c, changed, dims)), STATE), "assigned", replaces=state)
        told = state.where("q is null").select("cluster", "n", "inertia", F.posexplode("moved").alias("d", "x"))
        # a task has written k rows at most; summed up, k * dims numbers come to the driver
        told = told.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.sum("x").alias("x")).collect()
        inertia = np.zeros(k, np.int64)
        for r in told:
            sums[r["cluster"], r["d"]] += r["x"]
            inertia[r["cluster"]] = r["inertia"]
            if r["d"] == 0:
                counts[r["cluster"]] += r["n"]
        if step < rounds:
            new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], c)
            changed, c = (new != c).any(1), new
    total = int(inertia.sum())
    made = spark.createDataFrame([(j, int(inertia[j]), total, c[j].tolist()) for j in range(k)], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    owned = state.where("q is not null").select("vec_id", F.col("owner").alias("cluster"), "distance")
    return owned.join(F.broadcast(made), "cluster").select(*[x.split()[0] for x in out.split(", ")])  # k rows


def centroid_digest(c: Column) -> Column:
    return F.sha2(F.array_join(c.cast("array<string>"), ","), 256)
