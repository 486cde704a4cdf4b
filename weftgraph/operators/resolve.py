"""Entity resolution: merging nodes by name, by identifier and by similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.session import materialize

PROTECTED = ["Gene", "ProteinMutation", "DNAMutation", "SNP"]  # fixed values
#: Rows of a part whose pairs are compared; types of nodes, a short closed list.
PART_ROWS, MOST_PIVOTS, MOST_TYPES = 2000, 2048, 100


def _known(mesh: Column) -> Column:
    return mesh.isNotNull() & ~mesh.isin("-", "")


def merge_names(nodes: DataFrame, order: str = "node_id") -> DataFrame:
    """(node_id, target): nodes of one name, ignoring case; protected types only among themselves. The first with an identifier is kept, else the first."""
    bucket = F.when(F.col("type").isin(PROTECTED), F.col("type")).otherwise(F.lit("*"))
    n = nodes.select("node_id", F.lower(F.trim("name")).alias("key"), bucket.alias("bucket"), F.struct((~_known(F.col("mesh"))).alias("bare"), F.col(order).alias("ord"), F.col("node_id").alias("id")).alias("rank"))
    best = n.groupBy("key", "bucket").agg(F.min("rank.id").alias("x"), F.min("rank").alias("best"))
    return n.join(best, ["key", "bucket"]).where("node_id <> best.id").select("node_id", F.col("best.id").alias("target"))


def merge_identifiers(nodes: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """(node_id, target): nodes of one identifier and type that are not merged yet; the longest name is kept, ties to the smaller id."""
    n = nodes.where(_known(F.col("mesh")))
    if merged is not None:
        n = n.join(merged.select("node_id"), "node_id", "left_anti")
    rank = F.struct((-F.length("name")).alias("len"), F.col("node_id").alias("id"))
    best = n.groupBy("mesh", "type").agg(F.min(rank).alias("best"))
    return n.join(best, ["mesh", "type"]).where("node_id <> best.id").select("node_id", F.col("best.id").alias("target"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similar_pairs(vectors: DataFrame, threshold: float, block: str, id_col: str = "node_id", vector: str = "embedding", part_rows: int = PART_ROWS, most_pivots: int = MOST_PIVOTS, watch: Observation | None = None) -> DataFrame:
    """(a, b, cosine) with a < b within a block (such as a type) and cosine above threshold, in double precision.

    A block of more than part_rows rows is dealt into parts around pivots, vectors of its own of smallest hash. Angles obey the triangle
    inequality: a vector can only have partners in parts whose pivot is within their radius and the threshold's angle of it, and it is sent
    to those alone. A pair of parts is a task and one matrix product; a part of more than part_rows rows is cut by a hash first, so no
    task holds a whole block. The largest blocks get pivots, most_pivots in all; the rest are cut by the hash alone. Null, empty and zero vectors and
    null blocks have no pairs; vectors of other lengths meet only their like. watch: gets `sent`, the rows that tasks receive in all.
    """
    kind, spark = dict(vectors.dtypes)[id_col], vectors.sparkSession
    v = vectors.select(F.col(block).cast("string").alias("block"), F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    v = v.where("block is not null and id is not null and x is not null and exists(x, e -> e <> 0) and forall(x, e -> e is not null)").withColumn("n", F.size("x"))
    sizes = v.groupBy("block", "n").agg(F.ceil(F.count("*") / part_rows).alias("parts")).where("parts > 1").orderBy(F.desc("parts"), "block", "n").limit(most_pivots)
    wanted, left = {}, most_pivots
    for r in sizes.collect():  # at most most_pivots rows
        wanted[r["block"], r["n"]] = min(r["parts"], left)
        left -= wanted[r["block"], r["n"]]
        if left <= 0:
            break
    pivots = {}
    if wanted:
        keys = spark.createDataFrame([(*k, int(m)) for k, m in wanted.items()], "block string, n int, m int")
        h = F.struct(F.xxhash64("id").alias("h"), "id", "x")
        chosen = v.join(F.broadcast(keys), ["block", "n"])  # at most most_pivots rows
        cut = F.pmod(F.xxhash64("id", F.lit(3)), F.col("m"))  # the smallest hash of each of m shares
        for r in chosen.groupBy("block", "n", cut.alias("k")).agg(F.min(h).alias("p")).collect():  # most_pivots rows
            pivots.setdefault((r["block"], r["n"]), []).append((r["k"], r["p"]["x"]))
        pivots = {k: _unit(np.array([x for _, x in sorted(p)])) for k, p in pivots.items()}
    shared = spark.sparkContext.broadcast(pivots)

    def angles(t, at):
        """Of rows of one block and length: their angles to its pivots, one of 0 where there is none."""
        p = shared.value.get((t.column("block")[at[0]].as_py(), t.column("n")[at[0]].as_py()))
        if p is None:
            return np.zeros((len(at), 1))
        x = _unit(np.array(t.column("x").take(pa.array(at)).to_pylist()))
        return np.arccos(np.clip(x @ p.T, -1, 1))

    def groups(b):
        seen: dict = {}
        for i, k in enumerate(zip(b.column("block").to_pylist(), b.column("n").to_pylist())):
            seen.setdefault(k, []).append(i)
        return seen.values()

    def nearest(batches):
        for b in batches:
            own, far = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for at in groups(b):
                d = angles(b, at)
                own[at], far[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(far)], [*b.schema.names, "own", "far"])

    if pivots:
        v = materialize(v.mapInArrow(nearest, f"block string, id {kind}, x array<double>, n int, own long, far double"), "nearest")
    else:
        v = v.withColumn("own", F.lit(0).cast("long")).withColumn("far", F.lit(0.0))
    parts = v.groupBy("block", "n", "own").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / part_rows).cast("long").alias("subs"))
    v = v.join(parts.select("block", "n", "own", "subs"), ["block", "n", "own"])
    mine = {}
    if pivots:  # a row for each pivot
        for r in parts.join(F.broadcast(keys.select("block", "n")), ["block", "n"]).collect():
            mine.setdefault((r["block"], r["n"]), {})[r["own"]] = (r["radius"], r["subs"])
    known, reach = spark.sparkContext.broadcast(mine), float(np.arccos(max(-1.0, min(1.0, threshold)))) + 1e-9

    def sent(batches):
        """Each row once for every part, and piece of it, that may hold a partner."""
        for b in batches:
            rows, to, piece = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            subs = b.column("subs").to_numpy()
            for at in groups(b):
                at = np.array(at)
                info = known.value.get((b.column("block")[int(at[0])].as_py(), b.column("n")[int(at[0])].as_py()))
                if info is None:
                    where = [(0, at, int(subs[at[0]]))]
                else:
                    d = angles(b, at)
                    where = [(k, at[d[:, k] <= radius + reach], pieces) for k, (radius, pieces) in info.items()]
                for k, who, pieces in where:
                    for p in range(pieces):
                        rows.append(who)
                        to.append(np.full(len(who), k))
                        piece.append(np.full(len(who), p))
            pick = np.concatenate(rows)
            out = b.take(pa.array(pick))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(to)), pa.array(np.concatenate(piece))], [*b.schema.names, "to", "piece"])

    # a row's own place is (own, cut); it meets the rows of (to, piece), and of the two places the smaller comes first
    v = v.select("block", "id", "x", "n", "own", "subs").mapInArrow(sent, f"block string, id {kind}, x array<double>, n int, own long, subs long, to long, piece long")
    here, there = F.struct("own", F.pmod(F.xxhash64("id"), F.col("subs")).alias("cut")), F.struct(F.col("to").alias("own"), F.col("piece").alias("cut"))
    v = v.select("block", "n", "id", "x", F.least(here, there).alias("i"), F.greatest(here, there).alias("j"), (here > there).alias("second"))
    if watch is not None:
        v = v.observe(watch, F.count("*").alias("sent"))

    def run(t: pa.Table) -> pa.Table:
        ids, second = np.array(t.column("id").to_pylist(), object), t.column("second").to_numpy()
        x = np.asarray(t.column("x").combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
        u = _unit(x)
        across = t.column("i")[0] != t.column("j")[0]
        rows, cols = (np.flatnonzero(~second), np.flatnonzero(second)) if across else (np.arange(len(ids)),) * 2
        a, b = np.nonzero(u[rows] @ u[cols].T > threshold - 1e-9)
        a, b = rows[a], cols[b]
        keep = np.array([ids[p] < ids[q] if not across else ids[p] != ids[q] for p, q in zip(a, b)], bool)
        a, b = a[keep], b[keep]
        cos = (x[a] * x[b]).sum(1) / (np.sqrt((x[a] * x[a]).sum(1)) * np.sqrt((x[b] * x[b]).sum(1)))
        hit = cos > threshold
        low = [min(ids[p], ids[q]) for p, q in zip(a[hit], b[hit])]
        high = [max(ids[p], ids[q]) for p, q in zip(a[hit], b[hit])]
        return pa.table({"a": pa.array(low, t.schema.field("id").type), "b": pa.array(high, t.schema.field("id").type), "cosine": cos[hit]})

    return v.groupBy("block", "n", "i", "j").applyInArrow(run, f"a {kind}, b {kind}, cosine double")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def compatible(a: Column, b: Column) -> Column:
    unknown = F.lower(a).isin("unknown") | F.lower(b).isin("unknown")
    return (a == b) | unknown | (a.isin(PROTECTED) & b.isin(PROTECTED))


def _block(kind: Column) -> Column:
    return F.when(kind.isin(PROTECTED), "protected").when(F.lower(kind) == "unknown", "unknown").otherwise(kind)


def merge_similar(nodes: DataFrame, vectors: DataFrame, threshold: float = 0.96, protected: float = 0.995) -> DataFrame:
    """(node_id, target) by similarity, greedily in node order, see greedy_merge."""
    n = nodes.join(vectors.select("node_id", "embedding"), "node_id").withColumn("block", _block(F.col("type")))
    # a node of unknown type may merge with any: it is put into every block, its own among them
    blocks = [r["block"] for r in n.select("block").distinct().limit(MOST_TYPES + 1).collect()]
    if len(blocks) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} types of nodes")
    everywhere = F.when(F.col("block") == "unknown", F.array(*map(F.lit, blocks))).otherwise(F.array("block")) if blocks else F.array("block")
    pairs = similar_pairs(n.withColumn("block", F.explode(everywhere)), threshold, "block").dropDuplicates(["a", "b"])
    kind = nodes.select("node_id", "type", "mesh")
    guarded = F.col("ta").isin(PROTECTED) | F.col("tb").isin(PROTECTED)
    p = pairs.join(kind.toDF("a", "ta", "ma"), "a").join(kind.toDF("b", "tb", "mb"), "b").where(compatible(F.col("ta"), F.col("tb")) & (~guarded | (F.col("cosine") > protected)))
    mesh = nodes.select("node_id", F.when(_known(F.col("mesh")), F.col("mesh")).alias("mesh"))
    return greedy_merge(p.select("a", "b"), mesh)


def greedy_merge(pairs: DataFrame, mesh: DataFrame) -> DataFrame:
    """(node_id, target): what merging nodes one by one, in the order of their ids, comes to. pairs (a, b), mesh (node_id, mesh; null if unknown).

    A node that is not merged yet takes those neighbours that are not: if they have several identifiers among them, only those of its
    own; of these the first with an identifier is kept, else the node itself. In rounds: a node's turn comes once no
    undecided node within two steps is smaller, so nodes that decide in one round touch no node in common. A path of
    ascending ids takes a round for each of its nodes; ids that are not ordered along the graph some log n.
    """
    near = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"))).where("x <> y").distinct()
    near = materialize(near, "near")
    ids = near.select(F.col("x").alias("node")).distinct().join(mesh.select(F.col("node_id").alias("node"), "mesh"), "node", "left")
    kind = dict(near.dtypes)["x"]
    state = materialize(ids.select("node", "mesh", F.lit(None).cast(kind).alias("target"), F.lit(False).alias("done")), "state")
    while not (open_ := state.where("target is null and not done").select("node")).isEmpty():
        # the smallest undecided node within one step of each node, then within two
        one = near.join(open_, F.col("y") == F.col("node")).groupBy("x").agg(F.min("y").alias("low"))
        one = one.unionByName(open_.select(F.col("node").alias("x"), F.col("node").alias("low"))).groupBy("x").agg(F.min("low").alias("low"))
        two = near.join(one.withColumnsRenamed({"x": "y"}), "y").groupBy("x").agg(F.min("low").alias("far"))
        turn = open_.join(two, F.col("node") == F.col("x")).where("far >= node").select(F.col("node").alias("x"))
        free = state.where("target is null").select(F.col("node").alias("y"), F.col("mesh").alias("my"))
        group = turn.join(near, "x").unionByName(turn.select("x", F.col("x").alias("y"))).join(free, "y")
        group = materialize(group.join(state.select(F.col("node").alias("x"), F.col("mesh").alias("mx")), "x"), "turns")
        same = F.col("my") == F.col("mx")
        known = F.min(F.when(F.col("my").isNotNull(), F.col("y")))
        sums = group.groupBy("x").agg((F.min("my") < F.max("my")).alias("several"), known.alias("first"), F.min(F.when(same, F.col("y"))).alias("own"))
        keep = F.when(F.coalesce("several", F.lit(False)), F.col("own")).otherwise(F.coalesce("first", "x"))
        made = group.join(sums.select("x", "several", keep.alias("keep")), "x").where(F.col("keep").isNotNull() & (~F.coalesce("several", F.lit(False)) | same) & (F.col("y") != F.col("keep")))
        new = made.select(F.col("y").alias("node"), F.col("keep").alias("made")).unionByName(turn.select(F.col("x").alias("node"), F.lit(None).cast(kind).alias("made")))
        new = new.groupBy("node").agg(F.max("made").alias("made"), F.lit(True).alias("seen"))
        turned = turn.select(F.col("x").alias("node"), F.lit(True).alias("turned"))
        state = materialize(state.join(new, "node", "left").join(turned, "node", "left").select("node", "mesh", F.coalesce("target", "made").alias("target"), (F.col("done") | F.coalesce("turned", F.lit(False))).alias("done")), "state", replaces=state)
    return state.where("target is not null").select(F.col("node").alias("node_id"), "target")


def follow(mapping: DataFrame) -> DataFrame:
    """(node_id, target) with chains followed to their ends by pointer doubling; a cycle, which has no end, is an error."""
    m = materialize(mapping, "mapping")
    todo = None
    while True:
        nxt = m.select(F.col("node_id").alias("t"), F.col("target").alias("t2"))
        open_ = m.join(nxt, F.col("target") == F.col("t"), "left_semi").count()
        if not open_:
            return m
        if open_ == todo:  # doubling leaves fewer open each time, but on a cycle
            raise ValueError("the mapping has a cycle")
        todo = open_
        m = materialize(m.join(nxt, F.col("target") == F.col("t"), "left").select("node_id", F.coalesce("t2", "target").alias("target")), "mapping", replaces=m)


def apply_mapping(nodes: DataFrame, evidence: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edge evidence with every id replaced by its target: articles are united, self-loops go, counts are for the caller to take anew."""
    m = mapping.select("node_id", "target")
    to = F.coalesce("target", "node_id")
    grown = nodes.join(m, "node_id", "left").select(to.alias("node_id"), F.explode("pmids").alias("p")).groupBy("node_id").agg(F.array_sort(F.collect_set("p")).alias("pmids"))
    kept = nodes.join(m, "node_id", "left_anti").drop("pmids", "num_articles").join(grown, "node_id").withColumn("num_articles", F.size("pmids").cast("long"))
    e = evidence
    for c in ("u", "v", "source_id"):
        e = e.join(m.toDF("x", "y"), F.col(c) == F.col("x"), "left").withColumn(c, F.coalesce("y", c)).drop("x", "y")
    return kept, e.withColumn("lo", F.least("u", "v")).withColumn("hi", F.greatest("u", "v")).drop("u", "v").withColumnsRenamed({"lo": "u", "hi": "v"}).where("u <> v")


def resolve(nodes: DataFrame, evidence: DataFrame, vectors: DataFrame | None = None, threshold: float = 0.96) -> tuple[DataFrame, DataFrame]:
    """Names, then identifiers, then similarity where there are vectors; what names and identifiers merge stays if there are none."""
    names = materialize(merge_names(nodes), "names")
    both = names.unionByName(merge_identifiers(nodes, names))
    if vectors is not None:
        rest = nodes.join(both.select("node_id"), "node_id", "left_anti")
        both = both.unionByName(merge_similar(rest, vectors, threshold))
    return apply_mapping(nodes, evidence, follow(both))


__all__ = ["apply_mapping", "compatible", "cosine", "dot", "follow", "greedy_merge", "merge_identifiers", "merge_names", "merge_similar", "resolve", "similar_pairs"]
