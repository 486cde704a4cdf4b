"""Neighbourhoods, paths of one and two hops, and shortest paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.relations import DIRECTIONAL, WEAK
from weftgraph.session import materialize

# Fixed values.
TARGET_TYPES = ["gene", "disease", "chemical", "variant", "pathway", "cellline"]
TYPE_FACTORS = {"gene": 1.2, "disease": 1.2, "chemical": 1.1, "variant": 1.1}


def both_ways(edges: DataFrame, *cols: str) -> DataFrame:
    """(src, dst, ...): each edge and its reverse."""
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), *cols).unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst"), *cols))


def neighbourhood(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Edges that touch an anchor (node_id)."""
    a = anchors.select("node_id").distinct()
    touched = both_ways(edges).join(a, F.col("src") == F.col("node_id"), "left_semi").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    return edges.join(touched, ["u", "v"], "left_semi")


def type_factor(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_FACTORS.items() for x in kv]), F.lower(kind)), F.lit(1.0))


def edge_score(weight: Column, largest: Column, confidence: Column, relations: Column, articles: Column, relevance: Column, factor: Column) -> Column:
    """0.3 of the relative weight, 0.4 of the calibrated confidence and 0.3 of the query's relevance, times the type factor."""
    strength = F.when(F.arrays_overlap(relations, F.array(*map(F.lit, DIRECTIONAL))), 1.1).when(F.arrays_overlap(relations, F.array(*map(F.lit, WEAK))), 0.9).otherwise(1.0)
    boost = F.least(F.lit(1.2), F.greatest(articles - 1, F.lit(0)) * 0.05 + 1.0)
    calibrated = F.least(F.lit(1.0), confidence * strength * boost)
    return (F.try_divide(weight, largest) * 0.3 + calibrated * 0.4 + relevance * 0.3) * factor


def start_nodes(nodes: DataFrame, edges: DataFrame, query: str | None = None, most: int = 50, relevance: str | None = None) -> DataFrame:
    """At most `most` nodes that have edges, by how they match the query and, with less weight, by degree."""
    from weftgraph.operators.prune import degrees

    n = nodes.join(degrees(edges), "node_id")
    if query:
        q, name = query.lower(), F.lower(F.trim("name"))
        words = F.filter(F.split(name, r"\s+"), lambda w: F.length(w) > 2)
        match = F.when((name != "") & F.contains(F.lit(q), name), 2.0).when(F.exists(words, lambda w: F.contains(F.lit(q), w)), 1.0).otherwise(0.0)
        priority = match + (F.coalesce(F.col(relevance), F.lit(0.0)) if relevance else F.lit(0.0)) + F.least(F.lit(0.1), F.col("degree") / 1000.0)
    else:
        priority = F.col("degree").cast("double")
    return n.withColumn("priority", priority).orderBy(F.desc("priority"), "node_id").limit(most)


def two_hop_paths(scored: DataFrame, starts: DataFrame, nodes: DataFrame | None = None, k: int = 20, types: list[str] = TARGET_TYPES) -> DataFrame:
    """(a, b, c, score): the k best paths of one hop (c null) and two hops from starts (node_id) over scored edges (u, v, score).

    A second hop does not go back; two hops score 0.8 of the weaker edge. With nodes, only targets of the given types count.
    """
    hop = both_ways(scored, "score")
    if nodes is not None:
        hop = hop.join(nodes.where(F.lower("type").isin(types)).select(F.col("node_id").alias("dst")), "dst", "left_semi")
    first = hop.join(starts.select("node_id").distinct(), F.col("src") == F.col("node_id"), "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("score").alias("s1"))
    one = first.select("a", "b", F.lit(None).cast(dict(scored.dtypes)["u"]).alias("c"), F.col("s1").alias("score"))
    two = first.join(hop, (F.col("b") == F.col("src")) & (F.col("dst") != F.col("a"))).select("a", "b", F.col("dst").alias("c"), (F.least("s1", "score") * 0.8).alias("score"))
    return one.unionByName(two).orderBy(F.desc("score"), "a", "b", F.col("c").asc_nulls_first()).limit(k)


def path_records(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """paths with names, the relation and first three articles of each hop, whether any relation is directional, and a line of text."""
    rel = edges.select("u", "v", F.explode("relations").alias("pmid", "rels")).select("u", "v", "pmid", F.explode("rels").alias("relation"))
    top = rel.groupBy("u", "v", "relation").count().groupBy("u", "v").agg(F.max_by("relation", F.struct("count", "relation")).alias("relation"), F.max(F.col("relation").isin(DIRECTIONAL)).alias("directional"))
    arts = rel.groupBy("u", "v").agg(F.slice(F.array_sort(F.collect_set("pmid")), 1, 3).alias("pmids")).join(top, ["u", "v"])
    name = nodes.select("node_id", "name")
    p = paths.withColumn("path", F.monotonically_increasing_id())
    hops = p.select("path", "score", F.posexplode(F.filter(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("c").alias("y"))), lambda h: h["y"].isNotNull())).alias("hop", "h")).select("path", "score", "hop", "h.*")
    hops = hops.join(arts, (F.least("x", "y") == F.col("u")) & (F.greatest("x", "y") == F.col("v")))
    hops = hops.join(name.select(F.col("node_id").alias("x"), F.col("name").alias("from")), "x").join(name.select(F.col("node_id").alias("y"), F.col("name").alias("to")), "y")
    out = hops.groupBy("path").agg(F.round(F.first("score"), 3).alias("score"), F.array_sort(F.collect_list(F.struct("hop", "from", "relation", "to", "pmids"))).alias("hops"), F.max("directional").alias("is_directional"))
    line = F.concat_ws("; ", F.transform("hops", lambda h: F.concat_ws("", h["from"], F.lit(" --["), h["relation"], F.lit("]--> "), h["to"], F.lit(" (PMID: "), F.concat_ws(", ", h["pmids"]), F.lit(")"))))
    return out.withColumn("text", line).drop("path").orderBy(F.desc("score"), "text")


def any_directional(records: DataFrame) -> DataFrame:
    """One row (is_directional): whether any of path_records has a directional hop; false without paths."""
    return records.agg(F.coalesce(F.max("is_directional"), F.lit(False)).alias("is_directional"))


def bridges(paths: DataFrame) -> DataFrame:
    """(node_id, role): middle nodes of two-hop paths are bridges, all others endpoints."""
    two = paths.where("c is not null")
    mid = two.select(F.col("b").alias("node_id")).distinct()
    rest = paths.select(F.explode(F.array("a", "b", "c")).alias("node_id")).where("node_id is not null").distinct().join(mid, "node_id", "left_anti")
    return mid.withColumn("role", F.lit("bridge")).unionByName(rest.withColumn("role", F.lit("endpoint")))


def edge_cost(weight: Column) -> Column:
    return F.lit(1.0) / F.greatest(F.coalesce(F.nullif(weight, F.lit(0.0)), F.lit(1.0)), F.lit(0.1))


def shortest_paths(edges: DataFrame, anchors: DataFrame, max_hops: int | None = None, cost: str = "cost") -> DataFrame:
    """(a, b, cost, path) for every pair a < b of anchors (node_id) that is connected, within max_hops if given; costs must not be negative.

    Waves run from all anchors at once; a row is (anchor, node, cost, hops, the node before it), without the path. What one wave betters goes on
    in the next. A wave's row stops as soon as it costs more than any pair of its anchor could still use: half of the anchor's dearest known
    pair, once all its pairs are known, as the wave from the other end covers the other half. Where two waves meet,
    at a node or over an edge, is a candidate for the pair, and its path is traced back over the nodes before. Of equally cheap paths that
    with fewer hops, then that of the smaller nodes met, is given.
    """
    step = materialize(both_ways(edges, F.col(cost).alias("step")).where("src <> dst").groupBy("src", "dst").agg(F.min("step").alias("step")), "ways")
    kind = dict(step.dtypes)["src"]
    start = materialize(anchors.select(F.col("node_id").alias("a")).where("a is not null").distinct(), "anchors")
    others = start.count() - 1
    mark = ["cost", "hops", "prev"]
    best = materialize(start.select("a", F.col("a").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast(kind).alias("prev")), "best")
    wave, round_ = best, 0
    while others > 0 and (max_hops is None or round_ < max_hops):
        round_ += 1
        reached = wave.join(step, F.col("node") == F.col("src")).select("a", F.col("dst").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("src").alias("prev"))
        if max_hops is None:
            # a pair's cost so far, where two waves stand on one node
            x, y = best.select("a", "node", F.col("cost").alias("cx")), best.select(F.col("a").alias("b"), F.col("node").alias("n2"), F.col("cost").alias("cy"))
            pairs = x.join(y, (F.col("node") == F.col("n2")) & (F.col("a") != F.col("b"))).groupBy("a", "b").agg(F.min(F.col("cx") + F.col("cy")).alias("c"))
            bound = pairs.groupBy(F.col("a").alias("ba")).agg(F.max("c").alias("most"), F.count("*").alias("n")).where(F.col("n") == others).drop("n")
            reached = reached.join(bound, F.col("a") == F.col("ba"), "left").where("most is null or 2 * cost <= most * (1 + 1e-9)").drop("ba", "most")
        new = reached.groupBy("a", "node").agg(F.min(F.struct(*mark)).alias("m")).select("a", "node", "m.*")
        old = best.select(F.col("a").alias("oa"), F.col("node").alias("on"), F.struct(*mark).alias("om"))
        wave = materialize(new.join(old, (F.col("a") == F.col("oa")) & (F.col("node") == F.col("on")), "left").where(F.col("om").isNull() | (F.struct(*mark) < F.col("om"))).drop("oa", "on", "om"), "wave")
        if wave.isEmpty():
            break
        best = materialize(best.unionByName(wave).groupBy("a", "node").agg(F.min(F.struct(*mark)).alias("m")).select("a", "node", "m.*"), "best")
    if max_hops is not None:  # waves did not stop half way
        met = best.join(start.withColumnRenamed("a", "b"), F.col("node") == F.col("b")).where("a < b").select("a", "b", "cost", F.col("node").alias("x"), F.col("node").alias("y"))
    else:
        x, y = best.select("a", F.col("node").alias("x"), F.col("cost").alias("cx"), F.col("hops").alias("hx")), best.select(F.col("a").alias("b"), F.col("node").alias("y"), F.col("cost").alias("cy"), F.col("hops").alias("hy"))
        over = x.join(step, F.col("x") == F.col("src")).join(y, F.col("dst") == F.col("y")).where("a < b").select("a", "b", (F.col("cx") + F.col("step") + F.col("cy")).alias("cost"), (F.col("hx") + F.col("hy") + 1).alias("hops"), "x", "y")
        at = x.join(y, F.col("x") == F.col("y")).where("a < b").select("a", "b", (F.col("cx") + F.col("cy")).alias("cost"), (F.col("hx") + F.col("hy")).alias("hops"), "x", "y")
        met = over.unionByName(at).groupBy("a", "b").agg(F.min(F.struct("cost", "hops", "x", "y")).alias("m")).select("a", "b", "m.cost", "m.x", "m.y")
    return _traced(materialize(met, "met"), best)


def _traced(met: DataFrame, best: DataFrame) -> DataFrame:
    """(a, b, cost, path): from x back to a and from y back to b, a step for all pairs in a round."""
    back = best.select(F.col("a").alias("of"), F.col("node").alias("on"), "prev")
    p = met.select("a", "b", "cost", "x", "y", F.array("x").alias("head"), F.when(F.col("x") != F.col("y"), F.array("y")).otherwise(F.array().cast(f"array<{dict(met.dtypes)['y']}>")).alias("tail"))
    while True:
        p = materialize(p, "traced")
        if p.where("x <> a or y <> b").isEmpty():
            return p.select("a", "b", "cost", F.concat("head", "tail").alias("path"))
        p = p.join(back.toDF("oa", "ox", "px"), (F.col("a") == F.col("oa")) & (F.col("x") == F.col("ox")), "left").join(back.toDF("ob", "oy", "py"), (F.col("b") == F.col("ob")) & (F.col("y") == F.col("oy")), "left")
        grow = lambda end, prev, to: F.when(F.col(end) != F.col(to), F.array(prev))
        none = F.array().cast(f"array<{dict(met.dtypes)['x']}>")
        p = p.select("a", "b", "cost", F.when(F.col("x") != F.col("a"), F.col("px")).otherwise(F.col("x")).alias("x"), F.when(F.col("y") != F.col("b"), F.col("py")).otherwise(F.col("y")).alias("y"), F.concat(F.coalesce(grow("x", "px", "a"), none), "head").alias("head"), F.concat("tail", F.coalesce(grow("y", "py", "b"), none)).alias("tail"))
