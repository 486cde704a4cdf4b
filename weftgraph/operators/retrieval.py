"""Ranked retrieval of documents and nodes."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import token_estimate
from weftgraph.operators import batching
from weftgraph.session import materialize

#: Names, with their automaton's overhead, that a task holds at once.
PART_BYTES = 16_000_000


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2sq(a, b))


def l2sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def similarity(distance: Column) -> Column:
    return F.lit(1.0) / (distance + 1.0)


def nearest(vectors: DataFrame, query: list[float], k: int, metric: str = "l2", vector: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """vectors with distance, the k nearest; one pass and a top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = (l2 if metric == "l2" else l2sq)(F.col(vector), q)
    return vectors.where(F.col(vector).isNotNull()).withColumn("distance", d).orderBy("distance", tie).limit(k)


def hybrid(vectors: DataFrame, query: list[float], k: int = 5, weight: str = "weight", preferred: DataFrame | None = None, id_col: str = "vec_id", boost: float = 1.5) -> DataFrame:
    """The k best by similarity x weight x boost if preferred, of the max(4k, 50) nearest."""
    pool = nearest(vectors, query, max(4 * k, 50), tie=id_col)
    liked = F.lit(1.0)
    if preferred is not None:
        pool = pool.join(preferred.select(F.col(id_col).alias("pid")).distinct(), F.col(id_col) == F.col("pid"), "left")
        liked = F.when(F.col("pid").isNotNull(), boost).otherwise(1.0)
    return pool.withColumn("score", similarity(F.col("distance")) * F.coalesce(F.col(weight), F.lit(1.0)) * liked).orderBy(F.desc("score"), id_col).limit(k)


def document_text(title: Column, abstract: Column) -> Column:
    return F.concat_ws("\n\n", title, abstract)


def documents(articles: DataFrame, weights: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Articles with an abstract as documents, by weight."""
    d = articles.where("coalesce(abstract, '') <> ''").withColumn("text", document_text(F.col("title"), F.col("abstract")))
    d = d.join(weights, "pmid", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))) if weights is not None else d.withColumn("weight", F.lit(1.0))
    d = d.orderBy(F.desc("weight"), "article_seq")
    return d.limit(limit) if limit else d


def context_lines(lines: DataFrame, by: str, line: str, most: int = 15, sep: str = "; ") -> DataFrame:
    """(by, context): up to `most` sorted distinct lines of each group as one string."""
    return lines.groupBy(by).agg(F.concat_ws(sep, F.slice(F.array_sort(F.collect_set(line)), 1, most)).alias("context"))


def document_context(docs: DataFrame, lines: DataFrame, most: int = 15) -> DataFrame:
    """(pmid, context) of docs (pmid, title, abstract, score) with the relations (pmid, source, relation, target) found in them.

    A context names the article and its relevance, title and abstract, and up to `most` sorted distinct relations.
    """
    line = F.concat(F.lit("- "), F.coalesce("source", F.lit("Unknown")), F.lit(" --["), F.coalesce("relation", F.lit("associated")), F.lit("]--> "), F.coalesce("target", F.lit("Unknown")))
    found = lines.groupBy("pmid").agg(F.slice(F.array_sort(F.collect_set(line)), 1, most).alias("found"))
    d = docs.join(found, "pmid", "left")
    head = F.concat(F.lit("PMID: "), "pmid", F.lit(" (Relevance: "), F.format_number("score", 2), F.lit(")"))
    parts = [head, F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))), F.concat(F.lit("Abstract: "), F.coalesce("abstract", F.lit(""))), F.when(F.size("found") > 0, F.concat(F.lit("Relations in this article:\n"), F.array_join("found", "\n")))]
    return d.select("pmid", "score", F.concat_ws("\n", *parts).alias("context"))


def joined_contexts(contexts: DataFrame, k: int = 5, sep: str = "\n---\n\n") -> str:
    """The contexts of the k best documents as one text; what is said if there are none."""
    best = contexts.orderBy(F.desc("score"), "pmid").limit(k).collect()  # k rows
    return sep.join(r["context"] for r in best) or "No relevant abstracts found."


def node_text(name: Column, kind: Column) -> Column:
    """What a node is indexed under."""
    return F.concat(name, F.lit(" ("), kind, F.lit(")"))


def nearest_nodes(index: DataFrame, query: list[float], k: int = 10, ignored: list[str] | None = None, allowed: list[str] | None = None) -> DataFrame:
    """(node_id, name, type, score): the k nodes (with embedding) nearest to the query, by 1 / (1 + distance); see valid_nodes."""
    n = nearest(valid_nodes(index, ignored, allowed), query, k, tie="node_id")
    return n.select("node_id", "name", "type", similarity(F.col("distance")).alias("score"))


def valid_nodes(nodes: DataFrame, ignored: list[str] | None = None, allowed: list[str] | None = None) -> DataFrame:
    """Nodes whose type, in lower case and `entity` if null, is not ignored, and is allowed where types are given."""
    kind = F.lower(F.coalesce("type", F.lit("entity")))
    n = nodes.where(~kind.isin(ignored)) if ignored else nodes
    return n.where(kind.isin(allowed)) if allowed else n


def document(docs: DataFrame, pmid: str) -> DataFrame:
    return docs.where(F.col("pmid") == pmid).limit(1)


def indexed_ids(docs: DataFrame) -> DataFrame:
    return docs.select("pmid").distinct()


def index_part(nodes: DataFrame, selection: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """The nodes to index: all; where `most` is given, of a graph with more nodes than that the selected ones (node_id)."""
    if selection is None or most is None or nodes.limit(most + 1).count() <= most:
        return nodes
    return nodes.join(selection.select("node_id").distinct(), "node_id", "left_semi")


def batches(docs: DataFrame, order: str, text: str = "text", tokens: int = 250_000, rows: int = 5000) -> DataFrame:
    """(order, n_tokens, batch): documents in order, in consecutive batches of at most this many tokens and rows, see batching."""
    return batching.batches(docs, order, token_estimate(F.col(text)), tokens, rows)


def name_index(nodes: DataFrame, order: str = "node_id") -> DataFrame:
    """(key, node_id): lower-case ids and names; of several nodes the last."""
    both = nodes.select(F.lower("node_id").alias("key"), "node_id", order).unionByName(nodes.select(F.lower("name").alias("key"), "node_id", order)) if order != "node_id" else nodes.select(F.explode(F.array(F.lower("node_id"), F.lower("name"))).alias("key"), "node_id")
    return both.where("key <> ''").groupBy("key").agg(F.max_by("node_id", order).alias("node_id"))


def nodes_in_query(nodes: DataFrame, query: str, hits: DataFrame | None = None, least: float = 0.6) -> DataFrame:
    """Ids of nodes whose name or id stands in the query, and of vector hits (node_id, score) above the threshold."""
    q = F.lit(query.lower())
    found = nodes.where((F.length("name") > 0) & (F.contains(q, F.lower("name")) | F.contains(q, F.lower("node_id")))).select("node_id")
    return (found.unionByName(hits.where(F.col("score") > least).select("node_id")) if hits is not None else found).distinct()


def names_in_texts(texts: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, node_id): nodes (node_id, name) whose name or id stands in a text, ignoring case; nodes_in_query for a table of texts.

    An Aho-Corasick automaton over all names reads each text once. Names are dealt into parts of some part_bytes by a hash, and
    texts are read once for each part, so what a task holds is bounded whatever the graph. Null and empty texts, names and ids have no hits; no text is cut.
    """
    keys = nodes.select("node_id", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower(F.col("node_id").cast("string"))))).alias("key")).where("key <> ''").distinct()
    keys = materialize(keys, "names")
    size = keys.agg(F.sum(F.octet_length("key") + 32)).first()[0] or 0
    parts = max(1, -(-2 * size // part_bytes))
    kind, own = dict(nodes.dtypes)["node_id"], texts.select(id_col, F.lower(text).alias("text")).where(f"text <> '' and `{id_col}` is not null")
    found = []
    for p in range(parts):
        mine = keys.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == p).groupBy("key").agg(F.array_sort(F.collect_set("node_id")).alias("ids"))
        rows = [(r["key"], r["ids"]) for r in mine.collect()]  # half of part_bytes on average
        if not rows:
            continue
        shared = texts.sparkSession.sparkContext.broadcast(rows)

        def run(batches, shared=shared):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for key, ids in shared.value:
                automaton.add_word(key, ids)
            automaton.make_automaton()
            for b in batches:
                docs, hits = [], []
                for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    mine = {i for _, ids in automaton.iter(t) for i in ids}
                    docs += [doc] * len(mine)
                    hits += mine
                yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field(0).type), pa.array(hits, arrow_kind)], [id_col, "node_id"])

        arrow_kind = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
        found.append(own.mapInArrow(run, f"`{id_col}` {dict(texts.dtypes)[id_col]}, node_id {kind}"))
    if not found:
        return texts.select(id_col).limit(0).join(nodes.select("node_id").limit(0), F.lit(True))
    return reduce(DataFrame.unionByName, found).distinct()


def select_nodes(selection: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node_id) of a selection (key): by element id, then node id, then name."""
    n = nodes.select("node_id", F.sha1(F.concat(F.lit("node_"), "node_id")).alias("element"), F.lower("name").alias("label"))
    tries = [selection.join(n, cond).select("key", "node_id", F.lit(k).alias("rank")) for k, cond in enumerate((F.col("key") == F.col("element"), F.col("key") == F.col("node_id"), F.lower("key") == F.col("label")))]
    all_hits = tries[0].unionByName(tries[1]).unionByName(tries[2])
    return all_hits.groupBy("key").agg(F.min_by("node_id", F.struct("rank", "node_id")).alias("node_id"))


def selected_documents(edges: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles of the edges with their edges; a missing title or abstract has a placeholder."""
    from weftgraph.operators.edges import edges_of_articles

    a = articles.select("pmid", "title", "abstract")
    return edges_of_articles(edges).join(a, "pmid", "left").select("pmid", F.coalesce(F.nullif("title", F.lit("")), F.lit("No title")).alias("title"), F.coalesce(F.nullif("abstract", F.lit("")), F.lit("No abstract")).alias("abstract"), "edges")


def row_rank(by: str, *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(*order))
