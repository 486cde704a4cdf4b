"""Cuts, top-k, degrees and visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(edges: DataFrame, low: float, high: float | None = None, on: str = "edge_width") -> DataFrame:
    keep = F.col(on) >= low
    return edges.where(keep if high is None else keep & (F.col(on) <= high))


def top_edges(edges: DataFrame, k: int, by: str = "edge_weight") -> DataFrame:
    return edges.orderBy(F.desc(by), "u", "v").limit(k) if k > 0 else edges


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("node_id"))


def degrees(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(node_id, degree[, weighted_degree])."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node_id"), *([F.col(weight).alias("w")] if weight else []))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"), *([F.sum("w").alias("weighted_degree")] if weight else []))


def drop_isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges).distinct(), "node_id", "left_semi")


def keep_edges_between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("node_id")
    return edges.join(n, F.col("u") == F.col("node_id"), "left_semi").join(n, F.col("v") == F.col("node_id"), "left_semi")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("u = v")


def min_degree(nodes: DataFrame, edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of at least this degree before any is removed, and the edges among them."""
    kept = nodes.join(degrees(edges).where(F.col("degree") >= least), "node_id", "left_semi")
    return kept, keep_edges_between(edges, kept)


def top_nodes(nodes: DataFrame, edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    best = degrees(edges).orderBy(F.desc("degree"), "node_id").limit(n)
    kept = nodes.join(best, "node_id", "left_semi")
    between = keep_edges_between(edges, kept)
    return drop_isolates(kept, between), between


def visible_types(nodes: DataFrame, edges: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    kept = nodes.where(F.col("type").isin(types))
    return kept, keep_edges_between(edges, kept)


def min_confidence(edges: DataFrame, confidence: Column, least: float) -> DataFrame:
    """Semantic edges below the confidence go; others stay."""
    return edges.where((F.col("type") != "semantic") | (confidence >= least))


def confident_graph(nodes: DataFrame, edges: DataFrame, confidence: Column, least: float) -> tuple[DataFrame, DataFrame]:
    """min_confidence, and without the nodes that lose all their edges by it; nodes that had none stay."""
    kept = min_confidence(edges, confidence, least)
    lost = endpoints(edges).distinct().join(endpoints(kept).distinct(), "node_id", "left_anti")
    return nodes.join(lost, "node_id", "left_anti"), kept


def shown_nodes(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, least_degree: int = 0) -> DataFrame:
    """Nodes of a page by its type boxes and its degree slider; communities (c0, c1, ...) are exempt from both."""
    n = nodes.join(degrees(edges), "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    fits = (F.col("type").isin(types) if types is not None else F.lit(True)) & (F.col("degree") >= least_degree)
    return n.where(fits | (F.col("node_id").rlike(r"^c\d+$"))).drop("degree")


def selection_statistics(nodes: DataFrame, edges: DataFrame, picked: DataFrame, picked_edges: DataFrame) -> DataFrame:
    """statistics of a selection: picked (node_id) and picked_edges (u, v). Community nodes do not count."""
    n = nodes.where(~F.col("node_id").rlike(r"^c\d+$")).join(picked.select("node_id").distinct(), "node_id", "left_semi")
    return statistics(n, edges.join(picked_edges.select("u", "v").distinct(), ["u", "v"], "left_semi"))


def article_statistics(node_rows: DataFrame, edge_rows: DataFrame, article: str = "article_seq") -> DataFrame:
    """statistics from rows (node_id, article) and (u, v, article): no row ever holds all articles of a node or edge."""
    nodes, edges = node_rows.select("node_id").distinct(), edge_rows.select("u", "v").distinct()
    arts = node_rows.select(article).unionByName(edge_rows.select(article)).distinct()
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(arts.agg(F.count("*").alias("articles")))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, and distinct articles of both."""
    arts = nodes.select(F.explode("pmids").alias("p")).unionByName(edges.select(F.explode(F.map_keys("relations")).alias("p")))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(arts.agg(F.countDistinct("p").alias("articles")))


def numeric_first(c: Column) -> list[Column]:
    """Order for ids: numbers by value, then all others as text."""
    n = c.try_cast("long")
    return [n.isNull(), n, c]


def node_link(kind: Column, mesh: Column) -> Column:
    """Where a node can be looked up; null for other types."""
    bare = F.regexp_replace(mesh, "^MESH:", "")
    return (
        F.when(kind == "Species", F.concat(F.lit("https://www.ncbi.nlm.nih.gov/Taxonomy/Browser/wwwtax.cgi?id="), mesh)).when(kind == "Gene", F.concat(F.lit("https://www.ncbi.nlm.nih.gov/gene/"), F.split_part(mesh, F.lit(";"), F.lit(1))))
        .when(kind.isin("Chemical", "Disease"), F.concat(F.lit("https://meshb.nlm.nih.gov/record/ui?ui="), bare))
    )
