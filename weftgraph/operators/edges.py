"""Edges: co-mentions, annotated relations, and their aggregation over articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.mentions import weighted_count
from weftgraph.session import tasks

# Attributes of a mutation id.
MUTATION_PARTS = ["tmVar:", "HGVS:", "RS#:", "VariantGroup:", "CorrespondingGene:", "CorrespondingSpecies:", "CA#:"]


#: Nodes of a group in one block; a larger group is cut into blocks, and each pair of blocks is a task.
BLOCK = 1000
SALTS = 8


def pairs_within(rows: DataFrame, group: str, node: str, distinct: bool = True, block: int = BLOCK, most: int | None = None, size: int | None = None) -> DataFrame:
    """(group, u, v) with u < v for the nodes of each group; an equi-join on the group, and on pairs of blocks where it has more than `block` nodes.

    A group of n nodes has some n * n / 2 pairs; most leaves out groups of more nodes than that, if given. Null groups and nodes have no pairs.
    The rows are dealt into tasks by their number: size, or a count of rows.
    """
    n, dealt = rows.select(F.col(group).alias("g"), F.col(node).alias("n")).where("g is not null and n is not null"), tasks(rows, rows.count() if size is None else size)
    n = n.repartition(dealt, "g", "n").distinct() if distinct else n
    large = n.groupBy("g").count().where(F.col("count") > (block if most is None else min(block, most))).select(F.col("g").alias("lg"), F.col("count").alias("size"), F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    n = n.join(large, F.col("g") == F.col("lg"), "left")
    if most is not None:
        n = n.where(F.coalesce("size", F.lit(0)) <= most)
    own = F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int")
    # one block: 0 with 0; else its own block with itself and every other, smaller number first
    meets = F.when(F.coalesce("blocks", F.lit(1)) == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    n = n.select("g", "n", F.coalesce(F.when(F.col("blocks") > 1, own), F.lit(0)).alias("own"), F.explode(meets).alias("other"))
    a = n.where("own <= other").select("g", F.col("n").alias("x"), F.col("own").alias("i"), F.col("other").alias("j"))
    b = n.where("own >= other").select(F.col("g").alias("h"), F.col("n").alias("y"), F.col("other").alias("k"), F.col("own").alias("l"))
    a, b = a.repartition(dealt, "g", "i", "j"), b.repartition(dealt, "h", "k", "l").hint("shuffle_hash")
    met = a.join(b, (F.col("g") == F.col("h")) & (F.col("i") == F.col("k")) & (F.col("j") == F.col("l")) & ((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))) & (F.col("x") != F.col("y")))
    return met.select(F.col("g").alias(group), F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))


def pair_total(rows: DataFrame, group: str, node: str) -> int:
    """How many pairs pairs_within makes."""
    sizes = rows.where(F.col(group).isNotNull() & F.col(node).isNotNull()).select(group, node).distinct().groupBy(group).agg(F.count("*").alias("size"))
    return sizes.agg(F.sum(F.expr("size * (size - 1) div 2"))).first()[0] or 0


def pair_counts(rows: DataFrame, group: str, node: str, name: str = "num_relations") -> DataFrame:
    """(u, v, name): the groups that hold both, for nodes of which most pairs meet in few groups. Dealt into tasks by the number of pairs; a pair of many groups first lies in SALTS of them."""
    r = rows.select(F.col(group).alias("g"), F.col(node).alias("n")).where("g is not null and n is not null")
    sizes = r.groupBy("g", "n").count().groupBy("g").agg(F.count("*").alias("size"), F.sum("count").alias("rows"))
    total, all_, most = sizes.agg(F.sum(F.expr("size * (size - 1) div 2")), F.sum("rows"), F.max("rows")).first()
    n = tasks(rows, total or 0)
    if (most or 0) <= BLOCK:  # a group is a short array: no join
        sets = r.repartition(tasks(rows, max(total or 0, all_ or 0)), "g").groupBy("g").agg(F.array_sort(F.collect_set("n")).alias("set"))
        p = sets.select("g", "set", F.posexplode("set").alias("at", "u")).select("g", "u", F.explode(F.slice("set", F.col("at") + 2, F.size("set"))).alias("v"))
    else:
        p = pairs_within(rows, group, node).withColumnRenamed(group, "g")
    p = p.select("u", "v", F.pmod(F.xxhash64("g"), F.lit(SALTS)).alias("salt"))
    part = p.repartition(n, "u", "v", "salt").groupBy("u", "v", "salt").agg(F.count("*").alias("part"))
    return part.repartition(n, "u", "v").groupBy("u", "v").agg(F.sum("part").alias(name))


def comention_evidence(nodes: DataFrame) -> DataFrame:
    ids = nodes.select("article_seq", "pmid").distinct()
    none = F.lit(None).cast("string")
    return pairs_within(nodes, "article_seq", "node_id").join(ids, "article_seq").select("article_seq", "u", "v", "pmid", F.lit("co-mention").alias("relation"), none.alias("source_id"), none.cast("double").alias("confidence"), none.alias("evidence"))


def resolve_ids(relations: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """(article_seq, rel_seq, node_id): the article's node of a relation's id.

    By the node id up to its first `_`, later nodes first; else, for mutations, the first node with `;` in its id that
    has every attribute the relation's id names. An id that names no attribute matches no mutation. Rows are dealt into tasks
    by their number, three for each relation and node, as some attributes of each meet.
    """
    dealt = tasks(nodes, 3 * max(relations.count(), nodes.count()))
    n = nodes.where("is_mesh").withColumn("key", F.substring_index("node_id", "_", 1))
    plain = n.repartition(dealt, "article_seq", "key").groupBy("article_seq", "key").agg(F.max_by("node_id", "node_ord").alias("plain"))
    r = relations.select("article_seq", "rel_seq", F.col(id_col).alias("rid"))
    plain = plain.withColumnRenamed("article_seq", "art")
    direct = r.repartition(dealt, "article_seq", "rid").join(plain, (F.col("article_seq") == F.col("art")) & (F.col("rid") == F.col("key")), "left").select("article_seq", "rel_seq", "rid", "plain")
    # an inverted index of attributes: a variant fits if as many of its attributes are found as the relation's id names
    listed = lambda c: F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.nullif(F.regexp_extract(c, f"({p}[^;]+)", 1), F.lit("")).alias("val")) for k, p in enumerate(MUTATION_PARTS)]), lambda x: x["val"].isNotNull())
    has = n.where("contains(node_id, ';')").select(F.col("article_seq").alias("art"), "node_id", "node_ord", F.explode(listed(F.substring_index("node_id", "_", 1))).alias("x")).select("art", "node_id", "node_ord", "x.*")
    want = direct.where("plain is null").withColumn("want", listed(F.col("rid"))).select("article_seq", "rel_seq", F.size("want").alias("asked"), F.explode("want").alias("x")).select("article_seq", "rel_seq", "asked", F.col("x.k").alias("wk"), F.col("x.val").alias("wv"))
    want, has = want.repartition(dealt, "article_seq", "wk", "wv"), has.repartition(dealt, "art", "k", "val").distinct()
    found = want.join(has, (F.col("article_seq") == F.col("art")) & (F.col("wk") == F.col("k")) & (F.col("wv") == F.col("val")))
    found = found.repartition(dealt, "article_seq", "rel_seq").groupBy("article_seq", "rel_seq", "asked", "node_id", "node_ord").count().where("`count` = asked")
    matched = found.groupBy("article_seq", "rel_seq").agg(F.min_by("node_id", "node_ord").alias("node_id"))
    return direct.where("plain is not null").select("article_seq", "rel_seq", F.col("plain").alias("node_id")).unionByName(matched)


def relation_evidence(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Annotated relations between nodes of their own article; those with an unknown end are left out."""
    a = resolve_ids(relations, nodes, "id1").withColumnRenamed("node_id", "n1")
    b = resolve_ids(relations, nodes, "id2").withColumnRenamed("node_id", "n2")
    r = relations.select("article_seq", "rel_seq", "pmid", "relation_type").join(a, ["article_seq", "rel_seq"]).join(b, ["article_seq", "rel_seq"])
    none = F.lit(None).cast("string")
    return r.select("article_seq", F.least("n1", "n2").alias("u"), F.greatest("n1", "n2").alias("v"), "pmid", F.col("relation_type").alias("relation"), F.col("n1").alias("source_id"), none.cast("double").alias("confidence"), none.alias("evidence"))


def graph_edges(evidence: DataFrame, kind: str = "node", weights: DataFrame | None = None) -> DataFrame:
    """One row for each pair: relations, confidences and evidences by article, first source, and article counts."""
    last = evidence.groupBy("u", "v", "pmid", "relation").agg(F.max_by("confidence", "article_seq").alias("c"), F.max_by("evidence", "article_seq").alias("e"), F.min("article_seq").alias("first"), F.min_by("source_id", F.when(F.col("source_id").isNotNull(), F.col("article_seq"))).alias("s"))
    known = F.collect_list(F.when(F.col("c").isNotNull(), F.struct("relation", "c")))
    said = F.collect_list(F.when(F.col("e").isNotNull(), F.struct("relation", "e")))
    per = last.groupBy("u", "v", "pmid").agg(F.array_sort(F.collect_list("relation")).alias("rel"), F.map_from_entries(F.array_sort(known)).alias("conf"), F.map_from_entries(F.array_sort(said)).alias("evid"), F.min_by("s", F.when(F.col("s").isNotNull(), F.col("first"))).alias("s"), F.min("first").alias("first"))
    by_pmid = lambda c, cond=None: F.map_from_entries(F.array_sort(F.collect_list(F.struct("pmid", c) if cond is None else F.when(cond, F.struct("pmid", c)))))
    e = per.groupBy("u", "v").agg(by_pmid("rel").alias("relations"), F.collect_list(F.when(F.size("conf") > 0, F.struct("pmid", "conf"))).alias("cl"), F.collect_list(F.when(F.size("evid") > 0, F.struct("pmid", "evid"))).alias("el"), F.min_by("s", F.when(F.col("s").isNotNull(), F.col("first"))).alias("source_id"), F.count("*").alias("num_relations"))
    e = e.select("u", "v", F.lit("semantic" if kind == "semantic" else "node").alias("type"), "num_relations", "source_id", "relations", F.map_from_entries("cl").alias("confidences"), F.map_from_entries("el").alias("evidences"))
    w = weighted_count(evidence.select("u", "v", "pmid"), ["u", "v"], weights).withColumnRenamed("weighted", "weighted_num_relations")
    return e.join(w, ["u", "v"])


def edge_relations(evidence: DataFrame) -> DataFrame:
    """(u, v, relations, num_relations): each pair's sorted relations and its number of articles, without a row or map that holds all articles."""
    per = evidence.select("u", "v", "pmid", "relation").distinct()
    return per.groupBy("u", "v").agg(F.array_sort(F.collect_set("relation")).alias("relations"), F.count_distinct("pmid").alias("num_relations"))


def edge_rows(edges: DataFrame) -> DataFrame:
    """(u, v, pmid, relation, confidence, evidence): a row for each article and relation of an edge."""
    rows = edges.select("u", "v", "confidences", "evidences", F.explode("relations").alias("pmid", "rels")).select("*", F.explode("rels").alias("relation"))
    of = lambda m: F.try_element_at(F.try_element_at(m, F.col("pmid")), F.col("relation"))
    return rows.select("u", "v", "pmid", "relation", of(F.col("confidences")).alias("confidence"), of(F.col("evidences")).alias("evidence"))


def inspector_rows(edges: DataFrame) -> DataFrame:
    """edge_rows for display: confidences with two decimals, `N/A` where there is none or 0, and evidence or a note that there is none."""
    r = edge_rows(edges)
    return r.withColumn("confidence", F.coalesce(F.format_number(F.nullif("confidence", F.lit(0.0)), 2), F.lit("N/A"))).withColumn("evidence", F.coalesce(F.nullif("evidence", F.lit("")), F.lit("No evidence available")))


def article_edges(rows: DataFrame, article: str = "pmid") -> DataFrame:
    """(article, edges) from rows (u, v, article, relation): each article's edges with their sorted relations; grouped by article alone."""
    per = rows.groupBy(article, "u", "v").agg(F.array_sort(F.collect_set("relation")).alias("relations"))
    return per.groupBy(article).agg(F.array_sort(F.collect_list(F.struct(F.col("u").alias("source"), F.col("v").alias("target"), "relations"))).alias("edges"))


def edges_of_articles(edges: DataFrame) -> DataFrame:
    """(pmid, edges): each article's edges with their sorted relations."""
    rows = edges.select("u", "v", F.explode("relations").alias("pmid", "rels"))
    return rows.groupBy("pmid").agg(F.array_sort(F.collect_list(F.struct(F.col("u").alias("source"), F.col("v").alias("target"), F.array_sort("rels").alias("relations")))).alias("edges"))


def primary_relation(rows: DataFrame) -> DataFrame:
    """(u, v, relation, confidence): of (u, v, relation, confidence) rows the relation of highest mean confidence, ties by name.

    Without confidences another relation than co-mention counts 0.5; with none of these it is interacts_with at 0. Rows that are
    already dealt by u and v stay where they are.
    """
    c = rows.groupBy("u", "v", "relation").agg(F.avg("confidence").alias("m"))
    score = F.coalesce("m", F.when(F.col("relation") != "co-mention", F.lit(0.5)))
    best = c.withColumn("s", score).withColumn("known", F.col("m").isNotNull())
    w = Window.partitionBy("u", "v").orderBy(F.col("s").isNull(), F.desc("known"), F.desc("s"), F.asc("relation"))
    top = best.withColumn("k", F.row_number().over(w)).where("k = 1")
    return top.select("u", "v", F.when(F.col("s").isNull(), "interacts_with").otherwise(F.col("relation")).alias("relation"), F.coalesce("s", F.lit(0.0)).alias("confidence"))
