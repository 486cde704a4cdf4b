"""Mentions to per-article nodes, and these to graph nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import standard_name
from weftgraph.schema import ANNOTATION_TYPES, COLORS, DEFAULT_COLOR, DEFAULT_SHAPE, SHAPES
from weftgraph.session import tasks


def known_types(mentions: DataFrame, types: list[str] = ANNOTATION_TYPES) -> DataFrame:
    return mentions.where(F.col("type").isin(types))


def is_identified(mesh: Column) -> Column:
    return mesh.isNotNull() & ~mesh.isin("-", "")


def node_ids(mesh: Column, kind: Column) -> Column:
    """An array of ids: `id_Type`, for a gene one for each of its `;`-separated ids."""
    return F.transform(F.when(kind == "Gene", F.split(mesh, ";")).otherwise(F.array(mesh)), lambda m: F.concat_ws("_", m, kind))


def settle_types(counts: DataFrame, by: list[str], name: str = "name", node: str = "node_id", count: str = "n", first: str = "first_seq") -> DataFrame:
    """Of rows that give one name several nodes, the most frequent; ties to the first mention."""
    w = Window.partitionBy(*by, name).orderBy(F.desc(count), F.asc(first), F.asc(node))
    return counts.withColumn("rk", F.row_number().over(w)).where("rk = 1").drop("rk")


def frequent_name(rows: DataFrame, by: list[str], name: str, order: str) -> DataFrame:
    """The most frequent name of each group, ties to the one seen first, then to the larger name."""
    c = rows.groupBy(*by, name).agg(F.count("*").alias("n"), F.min(order).alias("first_seq"))
    return c.groupBy(*by).agg(F.max_by(name, F.struct("n", -F.col("first_seq"), name)).alias(name), F.min("first_seq").alias("first_seq"))


def article_nodes(mentions: DataFrame, articles: DataFrame | None = None, mesh_only: bool = False) -> DataFrame:
    """(article_seq, pmid, node_id, node_ord, name, type, mesh, is_mesh)."""
    m = known_types(mentions)
    if articles is not None and "use_vocab" in articles.columns:
        m = m.join(articles.select("article_seq", "use_vocab"), "article_seq", "left")
    else:
        m = m.withColumn("use_vocab", F.lit(False))
    keep = F.col("name")
    m = m.withColumn("std", standard_name(keep)).withColumn("counted", F.when(F.col("use_vocab"), keep).otherwise(F.col("std")))
    ident = m.where(is_identified(F.col("mesh"))).withColumn("node_id", F.explode(node_ids(F.col("mesh"), F.col("type"))))
    by = ["article_seq", "node_id"]
    names = frequent_name(ident, by, "counted", "mention_seq")
    facts = ident.groupBy(*by).agg(F.min("pmid").alias("pmid"), F.min_by("type", "mention_seq").alias("type"), F.min_by("mesh", "mention_seq").alias("mesh"))
    nodes = facts.join(names, by).select("article_seq", "pmid", "node_id", F.lower("counted").alias("name"), "type", "mesh", F.lit(True).alias("is_mesh"), "first_seq")
    if not mesh_only:
        free = m.where(~is_identified(F.col("mesh"))).withColumn("node_id", F.concat_ws("_", "std", F.lower("type")))
        c = free.groupBy("article_seq", "std", "node_id").agg(F.count("*").alias("n"), F.min("mention_seq").alias("first_seq"), F.min("pmid").alias("pmid"), F.first("type").alias("type"))
        c = settle_types(c, ["article_seq"], "std")
        nodes = nodes.unionByName(c.select("article_seq", "pmid", "node_id", F.col("std").alias("name"), "type", F.lit("-").alias("mesh"), F.lit(False).alias("is_mesh"), "first_seq"))
    nodes = nodes.where("trim(pmid) <> '' and trim(name) <> '' and trim(type) <> ''")
    order = F.row_number().over(Window.partitionBy("article_seq").orderBy("is_mesh", "first_seq", "node_id")) - 1
    return nodes.withColumn("node_ord", order).drop("first_seq")


def graph_nodes(nodes: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """One row for each node: attributes of its first article, its articles, their number and their weighted number."""
    literal = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    g = nodes.groupBy("node_id").agg(*[F.min_by(c, "article_seq").alias(c) for c in ("name", "type", "mesh")], F.array_sort(F.collect_set("pmid")).alias("pmids"))
    g = g.withColumn("num_articles", F.size("pmids").cast("long"))
    g = g.withColumn("color", F.coalesce(F.try_element_at(literal(COLORS), F.col("type")), F.lit(DEFAULT_COLOR))).withColumn("shape", F.coalesce(F.try_element_at(literal(SHAPES), F.col("type")), F.lit(DEFAULT_SHAPE)))
    w = weighted_count(nodes.select("node_id", "pmid"), ["node_id"], weights).withColumnRenamed("weighted", "weighted_num_articles")
    return g.join(w, "node_id")


def weighted_count(rows: DataFrame, by: list[str], weights: DataFrame | None = None, pmid: str = "pmid", size: int | None = None) -> DataFrame:
    """by and `weighted`, the rounded sum of the weights of the group's distinct articles; 1 for one without a weight.

    With size, the number of rows, they are dealt into tasks by it, by article.
    """
    d = rows.select(*by, pmid)
    if size is not None:
        d = d.repartition(tasks(d, size), pmid)
        weights = weights if weights is None else weights.repartition(tasks(d, size), "pmid").hint("shuffle_hash")
    d = d.distinct()
    d = d.join(weights.select(F.col("pmid").alias(pmid), "weight"), pmid, "left") if weights is not None else d.withColumn("weight", F.lit(1.0))
    return d.groupBy(*by).agg(F.round(F.sum(F.coalesce("weight", F.lit(1.0))), 2).alias("weighted"))


def stable_id(prefix: str, *parts: Column, suffix: str = "") -> Column:
    return F.sha1(F.concat(F.lit(prefix + "_"), F.concat_ws("_", *parts), F.lit(suffix)))
