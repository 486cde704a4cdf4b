"""The fluent surface: from articles to a weighted, pruned and searchable graph. Everything is lazy but weights, communities, paths and writing."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import communities, edges, extract, mentions, paths, prune, resolve, search, weights
from weftgraph.session import materialize
from weftgraph.sinks import writers
from weftgraph.sources.tagged_text import Tables


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    articles: DataFrame
    article_nodes: DataFrame
    evidence: DataFrame
    method: str = "co-occurrence"
    membership: DataFrame | None = None
    pmid_weights: DataFrame | None = None

    @classmethod
    def from_articles(cls, tables: Tables, node_type: str = "all", edge_method: str = "co-occurrence", client=None, semantic_threshold: float = 0.5, provider: str = "") -> Graph:
        """node_type: all, mesh or relation (the last two leave free-text nodes out); edge_method: co-occurrence, relation or semantic."""
        n = mentions.article_nodes(tables.mentions, tables.articles, node_type in ("mesh", "relation"))
        if edge_method == "co-occurrence":
            e = edges.comention_evidence(n)
        elif edge_method == "relation":
            e = edges.relation_evidence(tables.relations, n)
        elif edge_method == "semantic":
            e = extract.semantic_evidence(extract.extract(tables.articles, n, client, provider), n, semantic_threshold, provider).drop("study_type")
        else:
            raise ValueError(f"unknown edge method {edge_method}")
        kind = "semantic" if edge_method == "semantic" else "node"
        return cls(mentions.graph_nodes(n), edges.graph_edges(e, kind), tables.articles, n, e, edge_method)

    def weighted(self, method: str = "freq", pmid_weights: DataFrame | None = None) -> Graph:
        n = mentions.graph_nodes(self.article_nodes, pmid_weights)
        e = edges.graph_edges(self.evidence, "semantic" if self.method == "semantic" else "node", pmid_weights)
        count = self.articles.agg(F.count("*").cast("double").alias("all_articles"))
        e = weights.add_npmi(e.crossJoin(F.broadcast(count)), n, F.col("all_articles")).drop("all_articles")  # one row
        # written once: every later step reads them, some several times
        n, e = materialize(n, "nodes"), materialize(weights.set_weights(e, method), "edges")
        return replace(self, nodes=n, edges=e, pmid_weights=pmid_weights)

    def _with_edges(self, e: DataFrame) -> Graph:
        return replace(self, edges=e, nodes=prune.drop_isolates(self.nodes, e))

    def cut(self, low: float, high: float | None = None, on: str = "edge_width") -> Graph:
        return self._with_edges(prune.cut(self.edges, low, high, on))

    def top_edges(self, k: int) -> Graph:
        return self._with_edges(prune.top_edges(self.edges, k))

    def min_degree(self, d: int) -> Graph:
        n, e = prune.min_degree(self.nodes, self.edges, d)
        return replace(self, nodes=n, edges=e)

    def top_nodes(self, k: int) -> Graph:
        n, e = prune.top_nodes(self.nodes, self.edges, k)
        return replace(self, nodes=n, edges=e)

    def communities(self) -> Graph:
        m = communities.louvain(self.edges)
        return replace(self, membership=m, nodes=self.nodes.drop("community").join(m, "node_id", "left"))

    def build(self, method: str = "freq", pmid_weights: DataFrame | None = None, cutoff: float = 0, community: bool = True, max_edges: int = 0) -> Graph:
        """Weights, cut, top edges, isolates, and communities, in this order."""
        g = self.weighted(method, pmid_weights).cut(cutoff).top_edges(max_edges)
        return g.communities() if community else g

    def rebuild(self, method: str = "freq", cutoff: float = 0, max_edges: int = 0, min_degree: int = 0, max_nodes: int = 0, edge_cap: int = 0, community: bool = False) -> Graph:
        """For display: cap of edges, cut (of npmi, scaled), degree filter, cap of nodes, communities. A cap of 0 leaves all in."""
        low = cutoff * weights.LARGEST if method == "npmi" else cutoff
        g = replace(self, edges=weights.set_weights(self.edges, method), nodes=self.nodes.withColumn("name", F.lower("name")))
        g = g.top_edges(min(x for x in (max_edges, edge_cap) if x > 0) if max_edges > 0 or edge_cap > 0 else 0).cut(low)
        g = g.min_degree(min_degree) if min_degree else g
        g = g.top_nodes(max_nodes) if max_nodes > 0 else g
        return g.communities() if community else g

    def statistics(self) -> DataFrame:
        return prune.statistics(self.nodes, self.edges)

    def search(self, query: str) -> DataFrame:
        """Edges for a query: shortest paths between its anchors, or their neighbourhood if there are none."""
        anchors = search.search(self.nodes, query)
        found = paths.shortest_paths(self.edges.withColumn("cost", paths.edge_cost(F.col("edge_weight"))), anchors)
        steps = found.select(F.explode(F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path")), lambda a, b: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")))).alias("s")).select("s.*").distinct()
        return paths.neighbourhood(self.edges, anchors) if found.isEmpty() else self.edges.join(steps, ["u", "v"], "left_semi")

    def paths(self, query: str | None = None, k: int = 20, relevance: DataFrame | None = None) -> DataFrame:
        """Scored paths of up to two hops from the nodes that match the query best.

        relevance: (node_id, score) of nodes that a vector search found for the query; others count 0.5 in a path. An edge's
        confidence is the mean of its extracted relations' confidences, 0.5 where it has none.
        """
        nodes = self.nodes
        if relevance is not None:
            nodes = nodes.join(relevance.groupBy("node_id").agg(F.max("score").alias("relevance")), "node_id", "left")
        starts = paths.start_nodes(nodes, self.edges, query, relevance=None if relevance is None else "relevance")
        fit = F.coalesce("relevance", F.lit(0.5)) if relevance is not None else F.lit(0.5)
        kind = nodes.select("node_id", "type", fit.alias("fit"))
        e = self.edges.join(kind.toDF("u", "tu", "fu"), "u").join(kind.toDF("v", "tv", "fv"), "v").crossJoin(F.broadcast(self.edges.agg(F.max("edge_weight").alias("largest"))))  # one row
        rel = F.array_distinct(F.flatten(F.map_values("relations")))
        said = F.flatten(F.transform(F.map_values("confidences"), F.map_values))
        sure = F.coalesce(F.try_divide(F.aggregate(said, F.lit(0.0), lambda s, x: s + x), F.size(said)), F.lit(0.5))
        score = paths.edge_score(F.col("edge_weight"), F.col("largest"), sure, rel, F.size("relations"), F.greatest("fu", "fv"), F.greatest(paths.type_factor(F.col("tu")), paths.type_factor(F.col("tv"))))
        return paths.two_hop_paths(materialize(e.withColumn("score", score).select("u", "v", "score"), "scored"), starts, nodes, k)

    def path_records(self, query: str | None = None, k: int = 20, relevance: DataFrame | None = None) -> DataFrame:
        return paths.path_records(self.paths(query, k, relevance), self.nodes, self.edges)

    def with_communities(self) -> DataFrame:
        """Nodes with their parents, and a node for each community; see communities()."""
        g = self if self.membership is not None else self.communities()
        return communities.with_communities(g.nodes.drop("community"), g.membership, g.edges)

    def resolve(self, vectors: DataFrame | None = None, threshold: float = 0.96) -> Graph:
        """Merged nodes; edges are aggregated anew from the evidence, and weights are to be set again."""
        n, e = resolve.resolve(self.nodes, self.evidence, vectors, threshold)
        return replace(self, nodes=n, evidence=e, edges=edges.graph_edges(e, "semantic" if self.method == "semantic" else "node"))

    def write(self, path: str, format: str = "parquet") -> None:
        if format == "parquet":
            writers.save_graph(self.nodes, self.edges, path)
        elif format == "json":
            writers.write_elements(self.nodes, self.edges, path)
        elif format in ("html", "xgmml"):
            (writers.write_html if format == "html" else writers.write_xgmml)(self.nodes, self.edges, path)
        else:
            raise ValueError(f"unknown format {format}")
