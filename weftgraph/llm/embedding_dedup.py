"""Near-duplicates among embeddings by NN-descent.

0. Copies: rows of one label with equal vectors are one node with a weight, by a hash of 128 bits.
1. Start: vectors that share a label and the signs of random projections are compared, at most AHEAD apart in the order
   of one more projection. The number of signs grows with the label, so that a bucket keeps within that window; the
   number of tables grows with the signs, so that a pair at the threshold shares a bucket with a chance of 1 - MISS.
2. Descent: neighbours of a common neighbour are compared, and each list keeps its best, round by round until next to
   nothing new comes in. A list whose members all reach the threshold is saturated and doubles its length, again and again,
   up to MOST_LIST; what has no room then is left to step 3, which is exact. Lists only hold vectors within `slack` of the
   threshold: they fill in dense places, and pairs far from all others are left to the tables.
3. Threshold edges: components of all links met in 1 and 2, also of those that a list had no room for, are compared
   exactly, block by block, which counts every link of a dense group without a row for each pair.
4. Audit: for a bounded sample of vectors, links found are held against brute force over all rows; if the mean recall
   of a vector falls short, more tables are added and the descent goes on, and it is an error if it stays short.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import append_columns, block_pairs, column, whole_groups
from weftgraph.llm.vectors import common_length, cosine, matrix, unit, usable
from weftgraph.operators.components import connected_components
from weftgraph.session import materialize

AHEAD, LIST, MOST_LIST, AUDIT, MISS, MOST = 128, 8, 64, 512, 1e-4, 40
#: Ids lie below; numbers from here on stand for further vectors of an id.
SPARE = 1 << 62
#: A descent has settled when a round brings fewer than this share of new entries.
SETTLED = 0.001


def _needed(bits: int, threshold: float) -> int:
    """Tables after which a pair at the threshold has shared a bucket of so many signs, but for a chance of MISS."""
    agree = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if agree >= 1 else math.ceil(math.log(MISS) / math.log1p(-agree))


def _tables(seed: int, times: int, dims: int, threshold: float):
    def run(batches):
        planes = []
        for b in batches:
            if not b.num_rows:
                continue
            u, bits = unit(matrix(column(b, "v"))), column(b, "bits").to_numpy()
            need = np.array([times * _needed(k, threshold) for k in range(int(bits.max()) + 1)])[bits]
            for t in range(int(need.max())):
                if t == len(planes):
                    planes.append(np.random.default_rng([seed, t]).standard_normal((MOST + 1, dims)))
                pick = np.flatnonzero(need > t)
                p = u[pick] @ planes[t][: int(bits[pick].max()) + 1].T
                signs = ((p[:, 1:] > 0) & (np.arange(p.shape[1] - 1) < bits[pick, None])) @ (1 << np.arange(p.shape[1] - 1))
                rows = b.take(pa.array(pick))
                yield pa.RecordBatch.from_arrays([pa.array(signs.astype(np.int64) * (1 << 16) + t), column(rows, "label"), pa.array(p[:, 0]), column(rows, "vec_id"), column(rows, "v")], ["key", "label", "place", "vec_id", "v"])

    return run


def _kept(s: np.ndarray, ids: np.ndarray, floor: float, threshold: float):
    """Of the scores s of the first rows of ids with all of them (-1 where not compared): the best of each row as (u, v, score), and links that join what the threshold joins, as (u, v, NaN)."""
    near, hit = s >= threshold - 1e-9, s >= floor
    if s.shape[1] > LIST and hit.sum() > len(s) * LIST:
        best = np.zeros_like(hit)
        np.put_along_axis(best, np.argpartition(-s, LIST - 1, axis=1)[:, :LIST], True, axis=1)
        hit &= best
    a, b = np.nonzero(hit)
    c, d = np.nonzero(near)
    if len(c) > len(ids):
        both = np.zeros((len(ids), len(ids)), bool)
        both[: len(s)] = near
        both |= both.T
        d = np.arange(len(ids))
        while True:
            low = np.minimum(d, np.where(both, d, len(ids)).min(1))
            low = low[low]
            if (low == d).all():
                break
            d = low
        c = np.flatnonzero(d != np.arange(len(ids)))
        d = d[c]
    return np.concatenate([ids[a], ids[c]]), np.concatenate([ids[b], ids[d]]), np.concatenate([s[a, b], np.full(len(c), np.nan)])


def _neighbours(floor: float, threshold: float):
    """Pairs of rows of one key and label in one block of AHEAD rows, or in two that adjoin, in rows sorted by key, label and place."""

    def run(batches):
        rest = None
        for b in itertools.chain(batches, (None,)):
            if b is not None:
                new = column(b, "key").to_numpy(), column(b, "label").to_numpy(), column(b, "vec_id").to_numpy(), unit(matrix(column(b, "v")))
                if not b.num_rows:
                    continue
                rest = new if rest is None else tuple(np.concatenate(x) for x in zip(rest, new))
            if rest is None:
                continue
            key, label, ids, x = rest
            done, out = 0, []
            while done < len(ids) and (b is None or done + 2 * AHEAD <= len(ids)):
                one, two = slice(done, done + AHEAD), slice(done, done + 2 * AHEAD)
                s = x[one] @ x[two].T
                s[(key[one, None] != key[two]) | (label[one, None] != label[two])] = -1
                s[np.tril_indices(s.shape[0], 0, s.shape[1])] = -1
                if (s >= floor).any():
                    out.append(_kept(s, ids[two], floor, threshold))
                done += AHEAD
            rest = tuple(y[done:] for y in rest)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in zip(*out)], ["u", "v", "s"])

    return run


def _compare(floor: float, threshold: float):
    def run(batches):
        for g in whole_groups(batches, ["mid"]):
            ids, x = g.column("vec_id").to_numpy(), unit(matrix(g.column("v")))
            s = x @ x.T
            s[np.tril_indices(len(s))] = -1
            if (s >= floor).any():
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in _kept(s, ids, floor, threshold)], ["u", "v", "s"])

    return run


def _best(edges: DataFrame, threshold: float, length: int) -> DataFrame:
    """Directed lists (u, v, s) of the best `length`; while all entries of a list reach the threshold it may be twice as long, up to MOST_LIST."""
    both = edges.select("u", "v", "s").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "s")).where("u <> v")
    both = both.groupBy("u", "v").agg(F.max("s").alias("s"))
    w = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    ranked = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= MOST_LIST)
    near = F.count_if(F.col("s") >= threshold).over(Window.partitionBy("u"))
    doubled = F.lit(length) * F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(near / length, F.lit(0.5)))) + 1)  # the first length above the near ones
    return ranked.withColumn("room", F.greatest(doubled, F.lit(float(length)))).where(F.col("r") <= F.col("room")).select("u", "v", "s")


def _exact(threshold: float):
    def run(batches):
        for g in whole_groups(batches, ["component", "i", "j"]):
            ids, side, v = g.column("node").to_numpy(), g.column("side").to_numpy(), matrix(g.column("v"))
            weight = g.column("weight").to_numpy().astype(np.float64)
            u = unit(v)
            s = u @ u.T
            near = s >= threshold
            a, b = np.nonzero(np.abs(s - threshold) < 1e-9)
            if len(a):
                near[a, b] = cosine(v[a], v[b]) >= threshold
            near &= ids[:, None] != ids
            if side.min() != side.max():
                near &= side[:, None] != side
            label = np.arange(len(ids))
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            label = rank.copy()
            while True:
                low = np.minimum(label, np.where(near, label, len(ids)).min(1))
                low = np.minimum(low, low[order][low])
                if (low == label).all():
                    break
                label = low
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((near @ weight).astype(np.int64)), pa.array(near.sum(1)), pa.array(ids[order][label])], ["node", "n", "m", "root"])

    return run


def dedup(vectors: DataFrame, threshold: float = 0.98, slack: float = 0.01, recall: float = 0.99, rounds: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id long, embedding array, label int).

    Rows link when their labels are equal and their cosine, in double precision, reaches the threshold. A null id, a
    null label or an unusable vector (null, zero, null or non-finite components, a length other than the most
    frequent) links with nothing. Rows that repeat a vec_id with its vector and label count as one vector with itself. Rows that share an
    id share its result: the links of all its vectors, summed up, and one component. No rows, no result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.col("label").cast("long").alias("label"))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    dims = common_length(good, "v")
    members, nodes = _copies(good.where(F.size("v") == dims))
    points = nodes.select(F.col("node").alias("vec_id"), "v", "label")
    large = points.groupBy("label").count().where(F.col("count") > AHEAD)  # at most a row for each AHEAD vectors
    large = large.select("label", F.least(F.ceil(F.log2(F.col("count") * 2 / AHEAD)), F.lit(MOST)).cast("int").alias("bits"))
    signed = points.join(F.broadcast(large), "label", "left").select("vec_id", "v", "label", F.coalesce("bits", F.lit(0)).alias("bits"))
    floor, found, near, times = threshold - slack, None, None, 1
    probe = points.orderBy(F.xxhash64("vec_id", F.lit(17)), "vec_id").limit(AUDIT).toArrow()
    for attempt in range(rounds):
        dealt = signed.mapInArrow(_tables(31 + attempt, times, max(1, dims), threshold), "key long, label long, place double, vec_id long, v " + dict(rows.dtypes)["v"])
        met = dealt.repartition("key", "label").sortWithinPartitions("key", "label", "place", "vec_id").mapInArrow(_neighbours(floor, threshold), "u long, v long, s double")
        for step in itertools.count():  # lists only get better, so descents settle
            if step:
                lists = found.select(F.col("u").alias("mid"), F.col("v").alias("vec_id"))
                mids = lists.join(points.select("vec_id", "v"), "vec_id").repartition("mid").sortWithinPartitions("mid", "vec_id")
                met = mids.select("mid", "vec_id", "v").mapInArrow(_compare(floor, threshold), "u long, v long, s double")
            met = materialize(met, "met")
            link = met.where(F.isnan("s")).select("u", "v")
            near = link if near is None else near.unionByName(link)
            scored = met.where(~F.isnan("s"))
            old = found
            found = materialize(_best(scored if found is None else found.unionByName(scored), threshold, LIST), "lists")
            if step and found.join(old, ["u", "v"], "left_anti").count() <= SETTLED * found.count():
                break
        groups = connected_components(near)
        sized = groups.withColumn("bytes", F.lit(8 * max(1, dims)))
        tasks = block_pairs(sized, 2000, 32_000_000).join(nodes.select("node", "v", "weight"), "node")
        tasks = tasks.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
        tasks = tasks.select("component", "i", "j", "side", "node", "v", "weight")
        seen = materialize(tasks.mapInArrow(_exact(threshold), "node long, n long, m long, root long"), "links")
        links = seen.groupBy("node").agg(F.sum("n").alias("n_others"), F.sum("m").alias("n_links"))
        share = _recall(points, probe, links, threshold)
        if share >= recall:
            break
        times *= 2
    else:
        raise RuntimeError(f"recall {share:.4f} after {rounds} rounds, below {recall}")
    by_id = members.groupBy("vec_id").agg(F.min("node").alias("root"), F.max("node").alias("last")).where("root < last")
    shared = members.join(by_id, "vec_id").select("node", "root")
    roots = connected_components(seen.select("node", "root").unionByName(shared), "node", "root")
    known = members.join(links, "node", "left").join(roots, "node", "left").groupBy(F.col("vec_id").alias("id"))
    known = known.agg(F.sum(F.col("weight") - 1 + F.coalesce("n_others", F.lit(0))).alias("n_links"), F.min(F.coalesce("component", "node")).alias("component"))
    out = rows.join(known, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _copies(good: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, node, weight) for every id and vector and (node, v, label, weight) for every distinct vector of a label.

    node is the vector's smallest id; where several vectors have that, all but one get a number from SPARE on.
    """
    keyed = good.withColumn("g", F.xxhash64("label", "v")).withColumn("h", F.xxhash64(F.lit(7), "v", "label"))
    ids = materialize(keyed.select("vec_id", "g", "h").distinct(), "ids")
    same = ids.groupBy("g", "h").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    first = same.groupBy(F.col("least").alias("own")).agg(F.min(F.struct("g", "h")).alias("k")).select("own", F.col("k.g").alias("fg"), F.col("k.h").alias("fh"))
    named = same.join(first, F.col("least") == F.col("own"))
    node = F.when((F.col("g") == F.col("fg")) & (F.col("h") == F.col("fh")), F.col("least")).otherwise(F.monotonically_increasing_id() + SPARE)
    same = materialize(named.select("g", "h", node.alias("node"), "least", "weight"), "distinct")
    members = materialize(ids.join(same, ["g", "h"]).select("vec_id", "node", "weight"), "members")
    nodes = keyed.join(same.withColumnRenamed("least", "vec_id"), ["vec_id", "g", "h"]).dropDuplicates(["node"]).select("node", "v", "label", "weight")
    return members, materialize(nodes, "nodes")


def _recall(good: DataFrame, probe: pa.Table, links: DataFrame, threshold: float) -> float:
    """The mean, over audited vectors with links, of the share of a vector's links, counted by brute force over all rows, that were found."""
    if not probe.num_rows:
        return 1.0
    spark = good.sparkSession
    shared = spark.sparkContext.broadcast((probe.column("vec_id").to_numpy(), probe.column("label").to_numpy(), matrix(probe.column("v"))))  # AUDIT vectors

    def count(batches):
        ids, label, v = shared.value
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            x = unit(matrix(column(b, "v")))
            if len(x):
                near = (unit(v) @ x.T > threshold + 1e-9) & (label[:, None] == column(b, "label").to_numpy()) & (ids[:, None] != column(b, "vec_id").to_numpy())
                total += near.sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["vec_id", "n"])

    true = good.mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    part = F.least("n", F.coalesce("n_links", F.lit(0))) / F.col("n")
    row = true.where("n > 0").join(links, F.col("vec_id") == F.col("node"), "left").agg(F.avg(part).alias("share")).first()
    return 1.0 if row["share"] is None else row["share"]
