"""The driver's queries: each operator on proxy tables, with the same query for a second engine.

An article is an order, an entity a part's brand, a part or a supplier, a relation a return flag, a weight a function
of the order's price.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import relations as rel
from weftgraph.functions import text as tx
from weftgraph.operators import chatlog, communities, edges, mentions, paths, prune, resolve, retrieval, search, weights
from weftgraph.operators.components import connected_components
from weftgraph.session import materialize, numbered, shared_dir, table, tasks
from weftgraph.streaming import daily_pairs, event_stream, pairs_stream, read_pairs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# --- proxies -------------------------------------------------------------------------------------------------------

BRANDS = "brands AS (SELECT DISTINCT l_orderkey a, p_brand n FROM lineitem JOIN part ON l_partkey = p_partkey)"
PAIRS = f"{BRANDS}, pairs AS (SELECT x.n u, y.n v, x.a FROM brands x JOIN brands y ON x.a = y.a AND x.n < y.n), e AS (SELECT u, v, COUNT(DISTINCT a)::BIGINT c FROM pairs GROUP BY u, v)"
FREQ = f"{PAIRS}, w AS (SELECT u, v, c, ROUND(GREATEST(c * LEAST(20::DOUBLE / MAX(c) OVER (), 1::DOUBLE), 0::DOUBLE), 2) edge_weight FROM e)"
WEIGHTS = "wt AS (SELECT o_orderkey a, ROUND(o_totalprice / 100000, 2) weight FROM orders WHERE o_orderkey % 3 <> 0)"


def brands(spark: SparkSession, d: str) -> DataFrame:
    """(article_seq, node_id): the brands of each order."""
    li, p = table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "part").select("p_partkey", "p_brand")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("article_seq"), F.col("p_brand").alias("node_id")).repartition(tasks(li, li.count()), "article_seq", "node_id").distinct()


def written_brands(spark: SparkSession, d: str) -> DataFrame:
    return materialize(brands(spark, d), "brands")


def brand_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges.pairs_within(written_brands(spark, d), "article_seq", "node_id", distinct=False).groupBy("u", "v").agg(F.count("*").alias("num_relations"))


def weighted_edges_(spark: SparkSession, d: str) -> DataFrame:
    return weights.set_weights(brand_edges(spark, d), "freq", "num_relations")


def price_weights(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("pmid"), F.round(F.col("o_totalprice") / 100000, 2).alias("weight"))


# --- mentions and edges --------------------------------------------------------------------------------------------


@query(f"WITH {PAIRS} SELECT u, v, c AS num_relations FROM e")
def comention_edges(spark, d):
    return brand_edges(spark, d)


@query(f"WITH {FREQ} SELECT u, v, edge_weight, GREATEST(edge_weight, 1::DOUBLE) AS edge_width FROM w ORDER BY edge_weight DESC, u, v LIMIT 50")
def comention_freq_weight(spark, d):
    return prune.top_edges(weighted_edges_(spark, d), 50).select("u", "v", "edge_weight", "edge_width")


@query(f"""WITH {PAIRS}, deg AS (SELECT n, COUNT(*)::BIGINT c FROM brands GROUP BY n), t AS (SELECT COUNT(*)::DOUBLE n FROM orders),
r AS (SELECT e.u, e.v, x.c cx, y.c cy, e.c cxy, t.n FROM e JOIN deg x ON e.u = x.n JOIN deg y ON e.v = y.n, t)
SELECT u, v, ROUND(CASE WHEN cxy / n = 1 THEN 1 ELSE (LN(cx / n) + LN(cy / n)) / LN(cxy / n) - 1 END, 6) AS npmi FROM r""")
def comention_npmi(spark, d):
    deg = brands(spark, d).groupBy("node_id").agg(F.count("*").cast("double").alias("weighted_num_articles"))
    e = brand_edges(spark, d).withColumn("weighted_num_relations", F.col("num_relations").cast("double"))
    n = table(spark, d, "orders").agg(F.count("*").cast("double").alias("n"))
    return weights.add_npmi(e.crossJoin(F.broadcast(n)), deg, F.col("n")).select("u", "v", F.round("npmi", 6).alias("npmi"))


@query(f"WITH {BRANDS}, {WEIGHTS} SELECT n AS node_id, ROUND(SUM(COALESCE(weight, 1)), 2) AS weighted FROM brands LEFT JOIN wt USING (a) GROUP BY n")
def weighted_node_articles(spark, d):
    return mentions.weighted_count(brands(spark, d).withColumnRenamed("article_seq", "pmid"), ["node_id"], price_weights(spark, d))


@query(f"WITH {PAIRS}, {WEIGHTS} SELECT u, v, ROUND(SUM(COALESCE(weight, 1)), 2) AS weighted FROM (SELECT DISTINCT u, v, a FROM pairs) LEFT JOIN wt USING (a) GROUP BY u, v")
def weighted_edges(spark, d):
    b = written_brands(spark, d)
    p = edges.pairs_within(b, "article_seq", "node_id", distinct=False).withColumnRenamed("article_seq", "pmid")
    return mentions.weighted_count(p, ["u", "v"], price_weights(spark, d), size=edges.pair_total(b, "article_seq", "node_id"))


@query("SELECT o_orderkey, ROUND(LOG10(o_orderkey % 500 / GREATEST(2026 - YEAR(o_orderdate) + 1, 1)::DOUBLE + 1.1::DOUBLE) + 1, 3) AS weight FROM orders")
def citation_weight(spark, d):
    return table(spark, d, "orders").select("o_orderkey", weights.citation_weight(F.col("o_orderkey") % 500, F.date_format("o_orderdate", "yyyy-MM-dd"), 2026).alias("weight"))


@query("SELECT l_partkey::VARCHAR AS u, l_suppkey::VARCHAR AS v, STRING_AGG(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS relations, COUNT(DISTINCT l_orderkey)::BIGINT AS num_relations FROM lineitem GROUP BY 1, 2")
def relation_edges(spark, d):
    key = lambda c: F.col(c).cast("string")
    evidence = table(spark, d, "lineitem").select(key("l_partkey").alias("u"), key("l_suppkey").alias("v"), F.col("l_orderkey").alias("pmid"), F.col("l_returnflag").alias("relation"))
    return edges.edge_relations(evidence).select("u", "v", F.array_join("relations", ",").alias("relations"), "num_relations")


@query("""WITH m AS (SELECT l_suppkey u, l_partkey v, l_returnflag r, ROUND(AVG(l_discount), 6) c FROM lineitem GROUP BY 1, 2, 3), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY u, v ORDER BY c DESC, r) k FROM m)
SELECT u, v, r AS relation, c AS confidence FROM k WHERE k = 1""")
def primary_relation(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"), F.col("l_returnflag").alias("relation"), "l_discount")
    li = li.repartition(tasks(li, li.count()), "u", "v").groupBy("u", "v", "relation").agg(F.round(F.avg("l_discount"), 6).alias("confidence"))
    return edges.primary_relation(li)


@query(f"WITH {PAIRS} SELECT a AS pmid, STRING_AGG(u || '-' || v, ';' ORDER BY u, v) AS edges FROM pairs GROUP BY a")
def edges_by_article(spark, d):
    p = edges.pairs_within(written_brands(spark, d), "article_seq", "node_id", distinct=False)
    e = edges.article_edges(p.select(F.col("article_seq").alias("pmid"), "u", "v", F.lit("co-mention").alias("relation")))
    return e.select("pmid", F.concat_ws(";", F.transform("edges", lambda x: F.concat_ws("-", x["source"], x["target"]))).alias("edges"))


# --- pruning -------------------------------------------------------------------------------------------------------


@query(f"WITH {FREQ} SELECT u, v, edge_weight FROM w WHERE GREATEST(edge_weight, 1::DOUBLE) BETWEEN 10 AND 16")
def edge_cutoff_range(spark, d):
    return prune.cut(weighted_edges_(spark, d), 10, 16).select("u", "v", "edge_weight")


@query(f"WITH {FREQ} SELECT u, v, edge_weight FROM w ORDER BY edge_weight DESC, u, v LIMIT 100")
def edges_topk(spark, d):
    return prune.top_edges(weighted_edges_(spark, d), 100).select("u", "v", "edge_weight")


@query(f"WITH {FREQ}, k AS (SELECT * FROM w ORDER BY edge_weight DESC, u, v LIMIT 12) SELECT DISTINCT n AS node_id FROM brands WHERE n IN (SELECT u FROM k UNION SELECT v FROM k)")
def drop_isolates(spark, d):
    return prune.drop_isolates(brands(spark, d).select("node_id").distinct(), prune.top_edges(weighted_edges_(spark, d), 12))


@query(f"""WITH {FREQ}, k AS (SELECT * FROM w ORDER BY edge_weight DESC, u, v LIMIT 60), g AS (SELECT n, COUNT(*) c FROM (SELECT u n FROM k UNION ALL SELECT v FROM k) GROUP BY n HAVING COUNT(*) >= 5)
SELECT u, v FROM k WHERE u IN (SELECT n FROM g) AND v IN (SELECT n FROM g)""")
def min_degree(spark, d):
    e = prune.top_edges(weighted_edges_(spark, d), 60)
    return prune.min_degree(brands(spark, d).select("node_id").distinct(), e, 5)[1].select("u", "v")


@query(f"""WITH {FREQ}, k AS (SELECT * FROM w ORDER BY edge_weight DESC, u, v LIMIT 60), g AS (SELECT n FROM (SELECT u n FROM k UNION ALL SELECT v FROM k) GROUP BY n ORDER BY COUNT(*) DESC, n LIMIT 10),
b AS (SELECT u, v FROM k WHERE u IN (SELECT n FROM g) AND v IN (SELECT n FROM g)) SELECT u AS node_id FROM b UNION SELECT v FROM b""")
def node_topn_degree(spark, d):
    e = prune.top_edges(weighted_edges_(spark, d), 60)
    return prune.top_nodes(brands(spark, d).select("node_id").distinct(), e, 10)[0]


@query(f"WITH {PAIRS} SELECT (SELECT COUNT(DISTINCT n) FROM brands)::BIGINT AS nodes, (SELECT COUNT(*) FROM e)::BIGINT AS edges, (SELECT COUNT(DISTINCT a) FROM brands)::BIGINT AS articles")
def network_stats(spark, d):
    b = written_brands(spark, d)
    return prune.article_statistics(b, edges.pairs_within(b, "article_seq", "node_id", distinct=False))


@query("""WITH k AS (SELECT p_partkey n FROM part WHERE split_part(p_type, ' ', 1) IN ('ECONOMY', 'PROMO')), s AS (SELECT DISTINCT l_orderkey a, l_partkey n FROM lineitem)
SELECT x.n AS u, y.n AS v, COUNT(*)::BIGINT AS num_relations FROM s x JOIN s y ON x.a = y.a AND x.n < y.n WHERE x.n IN (SELECT n FROM k) AND y.n IN (SELECT n FROM k) GROUP BY 1, 2""")
def type_visibility(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("type"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_seq"), F.col("l_partkey").alias("node_id"))
    e = edges.pair_counts(rows, "article_seq", "node_id")
    return prune.visible_types(nodes, e, ["ECONOMY", "PROMO"])[1].select("u", "v", "num_relations")


@query("SELECT l_suppkey AS u, l_partkey AS v, CASE WHEN l_returnflag = 'A' THEN 'semantic' ELSE 'node' END AS type, l_orderkey FROM lineitem WHERE l_returnflag <> 'A' OR l_discount >= 0.05::DOUBLE")
def confidence_filter(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"), F.when(F.col("l_returnflag") == "A", "semantic").otherwise("node").alias("type"), "l_orderkey", "l_discount")
    return prune.min_confidence(e, F.col("l_discount"), 0.05).drop("l_discount")


@query("SELECT DISTINCT p_size::VARCHAR AS id, ROW_NUMBER() OVER (ORDER BY p_size)::BIGINT AS place FROM (SELECT DISTINCT p_size FROM part)")
def numeric_id_order(spark, d):
    ids = table(spark, d, "part").select(F.col("p_size").cast("string").alias("id")).distinct()
    return numbered(ids, *prune.numeric_first(F.col("id")), name="place").withColumn("place", F.col("place") + 1)


# --- graph ---------------------------------------------------------------------------------------------------------

STRONG = f"{FREQ}, k AS (SELECT u, v, edge_weight FROM w)"


def strong(spark: SparkSession, d: str) -> DataFrame:
    """The whole weighted graph, written once: its queries read it several times."""
    return materialize(weighted_edges_(spark, d).select("u", "v", "edge_weight"), "weighted")


@query(f"""WITH {STRONG}, s AS (SELECT u, v, edge_weight / MAX(edge_weight) OVER () * 0.3::DOUBLE + 0.5::DOUBLE * 0.4::DOUBLE + 0.15::DOUBLE s FROM k),
h AS (SELECT * FROM (SELECT u src, v dst, s FROM s UNION ALL SELECT v, u, s FROM s) WHERE RIGHT(dst, 1) IN ('1', '3', '4')), p AS (
SELECT src a, dst b, NULL c, s score FROM h UNION ALL SELECT x.src, x.dst, y.dst, LEAST(x.s, y.s) * 0.8::DOUBLE FROM h x JOIN h y ON x.dst = y.src AND y.dst <> x.src)
SELECT a, b, COALESCE(c, '') AS c, ROUND(score, 6) AS score FROM p ORDER BY p.score DESC, a, b, p.c NULLS FIRST LIMIT 20""")
def two_hop_paths(spark, d):
    e = strong(spark, d)
    e = e.crossJoin(F.broadcast(e.agg(F.max("edge_weight").alias("largest"))))  # one row
    s = paths.edge_score(F.col("edge_weight"), F.col("largest"), F.lit(0.5), F.array(F.lit("co-mention")), F.lit(1), F.lit(0.5), F.lit(1.0))
    ends = prune.endpoints(e).distinct()
    nodes = ends.withColumn("type", F.when(F.right("node_id", F.lit(1)).isin("1", "3"), "Gene").when(F.right("node_id", F.lit(1)) == "4", "Disease").otherwise("Species"))
    p = paths.two_hop_paths(e.withColumn("score", s), ends, nodes, 20)
    return p.select("a", "b", F.coalesce("c", F.lit("")).alias("c"), F.round("score", 6).alias("score"))


@query(f"WITH {STRONG} SELECT u, v, edge_weight FROM k WHERE u IN ('Brand#12', 'Brand#34') OR v IN ('Brand#12', 'Brand#34')")
def neighbourhood(spark, d):
    return paths.neighbourhood(strong(spark, d), spark.createDataFrame([("Brand#12",), ("Brand#34",)], "node_id string"))


#: Suppliers whose orders meet, and the paths between those of ten: an edge is dearer the fewer orders it has.
SUPPLIERS = "s AS (SELECT DISTINCT l_orderkey a, l_suppkey n FROM lineitem), k AS (SELECT x.n u, y.n v, 1::DOUBLE / GREATEST(COUNT(*)::DOUBLE, 0.1::DOUBLE) c FROM s x JOIN s y ON x.a = y.a AND x.n < y.n GROUP BY 1, 2), h AS (SELECT u, v, c FROM k UNION ALL SELECT v, u, c FROM k), g AS (SELECT s_suppkey n FROM supplier ORDER BY s_suppkey LIMIT 10)"
# one more hop in each round, from ten suppliers; more than 12 hops do not get cheaper at the tested sizes
HOPS = ", ".join(f"d{k + 1} AS MATERIALIZED (SELECT a, b, MIN(c) c FROM (SELECT * FROM d{k} UNION ALL SELECT d.a, h.v, d.c + h.c FROM d{k} d JOIN h ON d.b = h.u) GROUP BY a, b)" for k in range(12))


@query(f"""WITH {SUPPLIERS}, d0 AS (SELECT n a, n b, 0::DOUBLE c FROM g), {HOPS} SELECT a, b, ROUND(c, 6) AS cost FROM d12 WHERE a < b AND b IN (SELECT n FROM g)""")
def shortest_path_cost(spark, d):
    e = supplier_edges(spark, d).withColumn("cost", paths.edge_cost(F.col("edge_weight")))
    anchors = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id")).orderBy("node_id").limit(10)
    return paths.shortest_paths(e, anchors).select("a", "b", F.round("cost", 6).alias("cost"))


@query("""WITH RECURSIVE e AS (SELECT v.vec_id a, v.vec_id + 3 b FROM embeddings v), h AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(n, m) AS (SELECT a, a FROM h UNION SELECT h.b, r.m FROM r JOIN h ON r.n = h.a)
SELECT n AS node, MIN(m)::BIGINT AS component FROM r GROUP BY n""")
def components(spark, d):
    return connected_components(table(spark, d, "embeddings").select(F.col("vec_id").alias("u"), (F.col("vec_id") + 3).alias("v")))


NATIONS = """s AS (SELECT DISTINCT l_orderkey a, l_suppkey n FROM lineitem), p AS (SELECT x.n u, y.n v, COUNT(*)::DOUBLE w FROM s x JOIN s y ON x.a = y.a AND x.n < y.n GROUP BY 1, 2),
q AS (SELECT LEAST(a.s_nationkey, b.s_nationkey) c1, GREATEST(a.s_nationkey, b.s_nationkey) c2, w FROM p JOIN supplier a ON u = a.s_suppkey JOIN supplier b ON v = b.s_suppkey WHERE a.s_nationkey <> b.s_nationkey)"""


def supplier_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_seq"), F.col("l_suppkey").alias("node_id"))
    return edges.pair_counts(rows, "article_seq", "node_id", "edge_weight").withColumn("edge_weight", F.col("edge_weight").cast("double"))


@query(f"WITH {NATIONS} SELECT c1, c2, SUM(w) AS total, ROUND(GREATEST(0, LN(SUM(w)) * 5), 6) AS edge_weight FROM q GROUP BY c1, c2")
def community_edges(spark, d):
    m = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_nationkey").alias("community"))
    return communities.community_edges(supplier_edges(spark, d), m).select("c1", "c2", "total", F.round("edge_weight", 6).alias("edge_weight"))


@query(f"""WITH {NATIONS}, g AS (SELECT n, SUM(w) w FROM (SELECT u n, w FROM p UNION ALL SELECT v, w FROM p) GROUP BY n),
k AS (SELECT s_nationkey, s_suppkey, ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY COALESCE(w, 0) DESC, s_suppkey) k FROM supplier LEFT JOIN g ON n = s_suppkey) SELECT s_nationkey AS community, s_suppkey AS node_id FROM k WHERE k = 1""")
def community_representatives(spark, d):
    m = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_nationkey").alias("community"))
    return communities.representatives(m, supplier_edges(spark, d))


@query()
def louvain_membership(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_seq"), F.col("l_partkey").alias("node_id"))
    return communities.louvain(edges.pair_counts(rows, "article_seq", "node_id", "edge_weight"))


@query(f"WITH {PAIRS}, g AS (SELECT u n, c FROM e UNION ALL SELECT v, c FROM e) SELECT n AS node_id, COUNT(*)::BIGINT AS degree, SUM(c)::BIGINT AS weighted_degree FROM g GROUP BY n")
def degrees(spark, d):
    return prune.degrees(brand_edges(spark, d), "num_relations")


# --- names and ids -------------------------------------------------------------------------------------------------

STEM = """CASE WHEN regexp_extract(w, '[^ ]*$') = 'species' THEN w WHEN regexp_matches(w, 'ies$') AND NOT regexp_matches(w, '[ea]ies$') THEN LEFT(w, LENGTH(w) - 3) || 'y'
WHEN regexp_matches(w, 'es$') AND NOT regexp_matches(w, '[aeo]es$') THEN LEFT(w, LENGTH(w) - 1) WHEN regexp_matches(w, 's$') AND NOT regexp_matches(w, '[ius]s$') THEN LEFT(w, LENGTH(w) - 1) ELSE w END"""


@query(f"WITH t AS (SELECT DISTINCT UNNEST(string_split(text, ' ')) x FROM documents), s AS (SELECT x, LOWER(TRIM(x)) w FROM t) SELECT x AS word, {STEM} AS stem FROM s WHERE x <> ''")
def stem_tokens(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''").distinct()
    return w.select("word", tx.standard_name(F.col("word")).alias("stem"))


@query("""WITH c AS (SELECT l_orderkey o, l_shipdate::DATE::VARCHAR || l_returnflag AS name, COUNT(*) n, MIN(l_linenumber) f FROM lineitem GROUP BY 1, 2), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o ORDER BY n DESC, f, name DESC) k FROM c)
SELECT o AS l_orderkey, name FROM k WHERE k = 1""")
def name_mode(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.to_date("l_shipdate").cast("string"), "l_returnflag").alias("name"), "l_linenumber")
    return mentions.frequent_name(li, ["l_orderkey"], "name", "l_linenumber").select("l_orderkey", "name")


@query("""WITH c AS (SELECT p_name, p_type, COUNT(*) n, MIN(p_partkey) f FROM part GROUP BY 1, 2), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_name ORDER BY n DESC, f) k FROM c) SELECT p_name AS name, p_type AS node_id, n::BIGINT AS n FROM k WHERE k = 1""")
def type_conflict(spark, d):
    c = table(spark, d, "part").groupBy(F.col("p_name").alias("name"), F.col("p_type").alias("node_id")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_seq"))
    return mentions.settle_types(c, []).select("name", "node_id", "n")


@query("""WITH g AS (SELECT l_orderkey o, STRING_AGG(DISTINCT l_suppkey::VARCHAR, ';' ORDER BY l_suppkey::VARCHAR) ids FROM lineitem GROUP BY 1) SELECT o AS l_orderkey, UNNEST(CASE WHEN o % 2 = 0 THEN string_split(ids, ';') ELSE [ids] END) || CASE WHEN o % 2 = 0 THEN '_Gene' ELSE '_Disease' END AS node_id FROM g""")
def gene_id_explode(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat_ws(";", F.array_sort(F.collect_set(F.col("l_suppkey").cast("string")))).alias("ids"))
    return g.select("l_orderkey", F.explode(mentions.node_ids(F.col("ids"), F.when(F.col("l_orderkey") % 2 == 0, "Gene").otherwise("Disease"))).alias("node_id"))


@query(f"WITH {PAIRS} SELECT u, v, SHA1('node_' || u) AS u_id, SHA1('edge_' || u || '_' || v) AS edge_id, SHA1('node_' || u || '_comm') AS comm_id FROM e")
def stable_ids(spark, d):
    e = brand_edges(spark, d)
    return e.select("u", "v", mentions.stable_id("node", F.col("u")).alias("u_id"), mentions.stable_id("edge", F.col("u"), F.col("v")).alias("edge_id"), mentions.stable_id("node", F.col("u"), suffix="_comm").alias("comm_id"))


def part_nodes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 3 == 0, "Gene").when(F.col("p_partkey") % 3 == 1, "Disease").otherwise("Chemical")
    mesh = F.when(F.col("p_partkey") % 4 == 0, "-").otherwise(F.concat(F.lit("M"), (F.col("p_partkey") % 97).cast("string")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), kind.alias("type"), mesh.alias("mesh"))


PART_NODES = "n AS (SELECT p_partkey id, p_name nm, CASE p_partkey % 3 WHEN 0 THEN 'Gene' WHEN 1 THEN 'Disease' ELSE 'Chemical' END ty, CASE WHEN p_partkey % 4 = 0 THEN '-' ELSE 'M' || (p_partkey % 97) END ms FROM part)"
NAME_MERGE = f"{PART_NODES}, nm AS (SELECT id, FIRST_VALUE(id) OVER (PARTITION BY LOWER(TRIM(nm)), CASE WHEN ty = 'Gene' THEN ty ELSE '*' END ORDER BY ms = '-', id) t FROM n)"


@query(f"WITH {NAME_MERGE} SELECT id AS node_id, t AS target FROM nm WHERE id <> t")
def case_merge(spark, d):
    return resolve.merge_names(part_nodes(spark, d))


@query(f"WITH {NAME_MERGE}, r AS (SELECT n.* FROM n WHERE ms <> '-' AND id NOT IN (SELECT id FROM nm WHERE id <> t)), f AS (SELECT id, FIRST_VALUE(id) OVER (PARTITION BY ms, ty ORDER BY LENGTH(nm) DESC, id) t FROM r) SELECT id AS node_id, t AS target FROM f WHERE id <> t")
def id_merge(spark, d):
    n = part_nodes(spark, d)
    return resolve.merge_identifiers(n, resolve.merge_names(n))


@query("SELECT x.vec_id AS a, y.vec_id AS b, ROUND(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS cosine FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) > 0.3")
def cosine_pairs(spark, d):
    return resolve.similar_pairs(table(spark, d, "embeddings"), 0.3, "label", "vec_id").select("a", "b", F.round("cosine", 6).alias("cosine"))


# --- retrieval -----------------------------------------------------------------------------------------------------


def first_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


DISTANCE = "v AS (SELECT vec_id, label, list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) dist FROM embeddings)"


@query(f"WITH {DISTANCE} SELECT vec_id, ROUND(dist, 6) AS distance, ROUND(1 / (1 + dist), 6) AS similarity FROM v ORDER BY dist, vec_id LIMIT 10")
def vector_topk(spark, d):
    n = retrieval.nearest(table(spark, d, "embeddings"), first_vector(spark, d), 10)
    return n.select("vec_id", F.round("distance", 6).alias("distance"), F.round(retrieval.similarity(F.col("distance")), 6).alias("similarity"))


@query(f"WITH {DISTANCE}, p AS (SELECT * FROM v ORDER BY dist, vec_id LIMIT 50) SELECT vec_id, ROUND(1 / (1 + dist) * (1 + label / 10::DOUBLE) * CASE WHEN vec_id % 7 = 0 THEN 1.5 ELSE 1 END, 6) AS score FROM p ORDER BY 1 / (1 + dist) * (1 + label / 10::DOUBLE) * CASE WHEN vec_id % 7 = 0 THEN 1.5 ELSE 1 END DESC, vec_id LIMIT 8")
def hybrid_rank(spark, d):
    e = table(spark, d, "embeddings")
    h = retrieval.hybrid(e.withColumn("weight", F.col("label") / 10 + 1), first_vector(spark, d), 8, preferred=e.where("vec_id % 7 = 0"))
    return h.select("vec_id", F.round("score", 6).alias("score"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey o, p_brand || ' - ' || p_type x FROM lineitem JOIN part ON l_partkey = p_partkey), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o ORDER BY x) k FROM l) SELECT o AS l_orderkey, STRING_AGG(x, '; ' ORDER BY x) AS context FROM k WHERE k <= 4 GROUP BY o""")
def doc_context(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return retrieval.context_lines(li.select("l_orderkey", F.concat_ws(" - ", "p_brand", "p_type").alias("line")), "l_orderkey", "line", 4)


@query(r"SELECT doc_id, (FLOOR(LEN(LIST_FILTER(regexp_split_to_array(COALESCE(text, ''), '\s+'), lambda x: x <> '')) / 0.75::DOUBLE) + 1)::BIGINT AS n_tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("n_tokens"))


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY doc_id) k, (FLOOR(LEN(LIST_FILTER(regexp_split_to_array(COALESCE(text, ''), '\s+'), lambda x: x <> '')) / 0.75::DOUBLE) + 1)::BIGINT n FROM documents),
r(k, batch, used, c) AS (SELECT k, 0::BIGINT, n, 1 FROM d WHERE k = 1 UNION ALL SELECT d.k, CASE WHEN used + n > 20000 OR c >= 50 THEN batch + 1 ELSE batch END, CASE WHEN used + n > 20000 OR c >= 50 THEN n ELSE used + n END, CASE WHEN used + n > 20000 OR c >= 50 THEN 1 ELSE c + 1 END FROM r JOIN d ON d.k = r.k + 1)
SELECT doc_id, n AS n_tokens, batch FROM r JOIN d USING (k)""")
def token_batches(spark, d):
    return retrieval.batches(table(spark, d, "documents").select("doc_id", "text"), "doc_id", tokens=20_000, rows=50)


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[぀-ゟ゠-ヿ]') THEN 'Japanese' WHEN regexp_matches(text, '[가-힯]') THEN 'Korean' WHEN regexp_matches(text, '[一-鿿]') THEN 'Traditional Chinese' ELSE 'English' END AS language FROM documents")
def lang_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.language_of(F.col("text")).alias("language"))


CITING = "'see PMID: ' || (20000000 + doc_id) || ', [' || (30000000 + doc_id) || '], [12] and ' || LEFT(doc_id || '', 3) || ' ' || COALESCE(text, '')"


@query(rf"""WITH t AS (SELECT doc_id, {CITING} x FROM documents)
SELECT doc_id, array_to_string(list_filter([(30000000 + doc_id)::VARCHAR, '99', (20000000 + doc_id)::VARCHAR], lambda i: list_contains(list_concat(regexp_extract_all(x, '(?i)PMID[:\s]\s*(\d{{7,10}})', 1), regexp_extract_all(x, '\[(\d{{7,10}})\]', 1)), i)), ',') AS ids FROM t""")
def pmid_citations(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.expr(CITING).alias("x"))
    retrieved = F.array((F.col("doc_id") + 30000000).cast("string"), F.lit("99"), (F.col("doc_id") + 20000000).cast("string"))
    return t.select("doc_id", F.array_join(chatlog.sources(retrieved, tx.cited_ids(F.col("x"))), ",").alias("ids"))


@query("""SELECT doc_id, '<a href="https://pubmed.ncbi.nlm.nih.gov/' || (20000000 + doc_id) || '/">PMID: ' || (20000000 + doc_id) || '</a> <a href="x">[' || (10000000 + doc_id) || ']</a> [<a href="https://pubmed.ncbi.nlm.nih.gov/' || (30000000 + doc_id) || '/">' || (30000000 + doc_id) || '</a>] rs[' || (40000000 + doc_id) || ']' AS linked FROM documents""")
def id_links(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    x = F.concat(F.lit("PMID: "), F.col("doc_id") + 20000000, F.lit(' <a href="x">['), F.col("doc_id") + 10000000, F.lit("]</a> ["), F.col("doc_id") + 30000000, F.lit("] rs["), F.col("doc_id") + 40000000, F.lit("]"))
    return docs.select("doc_id", tx.link_ids(x).alias("linked"))


@query("WITH k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) k FROM conversations) SELECT conv_id, turn, role FROM k WHERE k <= 6")
def history_window(spark, d):
    return chatlog.history_window(table(spark, d, "conversations"), 3).select("conv_id", "turn", "role")


@query("WITH k AS (SELECT *, SUM(LENGTH(COALESCE(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) u FROM conversations) SELECT conv_id, turn, u::BIGINT AS used FROM k WHERE u <= 1800")
def memory_budget(spark, d):
    return chatlog.memory_budget(table(spark, d, "conversations")).select("conv_id", "turn", "used")


@query("SELECT conv_id, COUNT(*)::BIGINT AS messages, COUNT(*) FILTER (role = 'user')::BIGINT AS questions, COUNT(*) FILTER (role = 'assistant')::BIGINT AS answers FROM conversations GROUP BY conv_id")
def session_stats(spark, d):
    return chatlog.session_statistics(table(spark, d, "conversations"))


@query("""WITH g AS (SELECT DISTINCT p_name n, l_orderkey::VARCHAR o FROM part JOIN lineitem ON l_partkey = p_partkey), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY n ORDER BY o) k, COUNT(*) OVER (PARTITION BY n) c FROM g)
SELECT n AS name, STRING_AGG(o, ', ' ORDER BY o) || CASE WHEN MAX(c) > 3 THEN ' +' || (MAX(c) - 3) || ' more' ELSE '' END AS shown FROM k WHERE k <= 3 GROUP BY n""")
def entity_listing(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = li.groupBy(F.col("p_name").alias("name")).agg(F.collect_set(F.col("l_orderkey").cast("string")).alias("pmids")).withColumn("type", F.lit("Gene"))
    return chatlog.listing(n, "mrna").select("name", "shown")


@query("""WITH t AS (SELECT doc_id, text, LEFT(text, 250) h, INSTR(REVERSE(LEFT(text, 250)), ' .') i FROM documents)
SELECT doc_id, MD5(CASE WHEN LENGTH(text) <= 250 THEN text ELSE TRIM(CASE WHEN i = 0 OR LENGTH(h) - i - 1 < 125 THEN h ELSE LEFT(h, LENGTH(h) - i) END, ' ') END) AS short FROM t""")
def sentence_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.cut_at_sentence(F.col("text"), 250)).alias("short"))


@query("""WITH n AS (SELECT p_partkey id, p_name nm, split_part(p_type, ' ', 1) ty, p_size s FROM part), t AS (SELECT id FROM n WHERE LOWER(ty) = 'economy' ORDER BY s DESC, id LIMIT 20),
w AS (SELECT id FROM n WHERE len(list_filter(regexp_split_to_array(lower(nm), '[^a-z0-9]+'), lambda x: starts_with(x, 'ivory'))) > 0 OR contains(regexp_replace(lower(nm), '[^a-z0-9]', '', 'g'), 'ivory')),
y AS (SELECT id FROM n WHERE LOWER(ty) = 'promo' AND len(list_filter(regexp_split_to_array(lower(nm), '[^a-z0-9]+'), lambda x: starts_with(x, 'red'))) > 0)
SELECT id AS node_id, 0 AS term FROM t UNION ALL SELECT id, 1 FROM w UNION ALL SELECT id, 2 FROM y""")
def search_nodes(spark, d):
    n = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("type"), F.lit("").alias("mesh"), F.col("p_size").alias("num_articles"))
    return search.search(n, "@Economy, ivory, @Promo:red")


#: Confidences as texts of several kinds, made of lineitem.
SAID = "CASE l_linenumber % 6 WHEN 0 THEN (l_partkey % 101)::VARCHAR || '%' WHEN 1 THEN ' 0.' || (l_suppkey % 10)::VARCHAR WHEN 2 THEN '' WHEN 3 THEN (l_orderkey % 300)::VARCHAR WHEN 4 THEN 'high' ELSE '-' || (l_partkey % 3)::VARCHAR END"


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, {SAID} raw FROM lineitem), x AS (SELECT *, TRY_CAST(replace(trim(raw), '%', '') AS DOUBLE) c FROM v)
SELECT l_orderkey, l_linenumber, LEAST(GREATEST(CASE WHEN c IS NULL THEN 0.5::DOUBLE WHEN c > 1 AND c <= 100 THEN c / 100 ELSE c END, 0::DOUBLE), 1::DOUBLE) AS confidence FROM x""")
def confidence_norm(spark, d):
    said = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(SAID.replace("::VARCHAR", "::STRING")).alias("raw"))
    return said.select("l_orderkey", "l_linenumber", rel.confidence(F.col("raw")).alias("confidence"))


#: Relations as models write them: a stem by part, an ending by line, now and then in capitals or with blanks around.
STEMS, ENDINGS = ["inhibit", "activat", "interact", "bind", "upregulat", "treat", "associat", "press"], ["s", "e", "ion", " with", "ing", ""]
WORDS = ", ".join(f"'{w}'" for w in STEMS)
TAILS = ", ".join(f"'{w}'" for w in ENDINGS)
RELATION = f"CASE l_suppkey % 3 WHEN 0 THEN upper({{at}}([{WORDS}], l_partkey % 8 + 1) || {{at}}([{TAILS}], l_linenumber % 6 + 1)) ELSE ' ' || {{at}}([{WORDS}], l_partkey % 8 + 1) || {{at}}([{TAILS}], l_linenumber % 6 + 1) || '  ' END"
USUAL = ", ".join(f"('{k}', '{v}')" for k, v in rel.USUAL_FORM.items())


@query(f"""WITH u(k, v) AS (VALUES {USUAL}), w AS (SELECT {RELATION.format(at="list_extract")} raw FROM lineitem), n AS (SELECT raw, replace(trim(lower(raw), ' '), ' ', '_') s FROM w)
SELECT raw, COALESCE(v, s) AS name, COALESCE(v, s) IN ({", ".join(f"'{x}'" for x in rel.DIRECTIONAL)}) AS directional, COALESCE(v, s) IN ({", ".join(f"'{x}'" for x in rel.SYMMETRIC)}) AS symmetric, COUNT(*)::BIGINT AS n FROM n LEFT JOIN u ON k = s GROUP BY 1, 2, 3, 4""")
def relation_norm(spark, d):
    raw = F.expr(RELATION.format(at="element_at").replace("[", "array(").replace("]", ")")).alias("raw")
    words = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("int"), F.col("l_partkey").cast("int"), F.col("l_linenumber").cast("int")).select(raw).groupBy("raw").agg(F.count("*").alias("n"))
    return words.select("raw", rel.relation_name(F.col("raw")).alias("name"), rel.is_directional(F.col("raw")).alias("directional"), rel.is_symmetric(F.col("raw")).alias("symmetric"), "n")


#: Mutations: a variant of each line, named by its part and supplier; odd lines ask for both attributes, even ones for one.
VARIANT = "'tmVar:p' || l_partkey || ';RS#:' || (l_suppkey % 10) || '_L' || l_linenumber"
ASKED = "CASE WHEN l_linenumber % 2 = 0 THEN 'RS#:' || (l_suppkey % 10) || ';CA#:' ELSE 'tmVar:p' || l_partkey || ';RS#:' || (l_suppkey % 10) END"


@query(f"""WITH n AS (SELECT l_orderkey o, l_linenumber k, l_partkey p, l_suppkey % 10 r, {VARIANT} id FROM (SELECT l_orderkey, l_linenumber, MIN(l_partkey) l_partkey, MIN(l_suppkey) l_suppkey FROM lineitem GROUP BY 1, 2))
SELECT x.o AS article_seq, x.k AS rel_seq, CASE WHEN x.k % 2 = 0 THEN arg_min(y.id, y.k) ELSE arg_max(y.id, y.k) END AS node_id FROM n x JOIN n y ON x.o = y.o AND x.r = y.r AND (x.k % 2 = 0 OR x.p = y.p) GROUP BY x.o, x.k""")
def mutation_match(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    li = li.repartition(tasks(li, li.count()), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    li = materialize(li, "lines")  # counted and read twice
    nodes = li.select(F.col("l_orderkey").alias("article_seq"), F.expr(VARIANT).alias("node_id"), F.col("l_linenumber").alias("node_ord"), F.lit(True).alias("is_mesh"))
    asked = li.select(F.col("l_orderkey").alias("article_seq"), F.col("l_linenumber").alias("rel_seq"), F.expr(ASKED).alias("id1"))
    return edges.resolve_ids(asked, nodes, "id1")


@query("""WITH n AS (SELECT item_id, LOWER(text[1:14]) k FROM benchmark WHERE text IS NOT NULL) SELECT DISTINCT doc_id, item_id AS node_id FROM documents JOIN n ON k <> '' AND (contains(LOWER(text), k) OR contains(LOWER(text), item_id::VARCHAR))""")
def names_in_texts(spark, d):
    names = table(spark, d, "benchmark").where("text is not null").select(F.col("item_id").alias("node_id"), F.substring("text", 1, 14).alias("name"))
    return retrieval.names_in_texts(table(spark, d, "documents").select("doc_id", "text"), names)


@query("""SELECT DISTINCT p_brand AS brand, '("' || p_brand || '") NOT "Editorial" NOT "Letter" NOT "Published Erratum" NOT "Congress" NOT "News" NOT "Comment" NOT "Retraction of Publication"' AS query FROM part""")
def pubtype_query(spark, d):
    b = table(spark, d, "part").select(F.col("p_brand").alias("brand")).distinct()
    return b.select("brand", search.without_publication_types(F.concat(F.lit('"'), "brand", F.lit('"'))).alias("query"))


@query("""WITH s AS (SELECT user_id u, event_type q, MAX(ts) t FROM events GROUP BY 1, 2), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY u ORDER BY t DESC, q) k FROM s) SELECT u AS user_id, q AS event_type, k::BIGINT AS rank FROM k WHERE k <= 8""")
def recent_searches(spark, d):
    r = chatlog.recent_searches(table(spark, d, "events"), "user_id", "event_type", "ts")
    return r.select("user_id", "event_type", F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT DISTINCT ts::DATE AS day, user_id, event_type t FROM events) SELECT x.day::VARCHAR AS day, x.t AS t1, y.t AS t2, COUNT(*)::BIGINT AS users FROM s x JOIN s y ON x.day = y.day AND x.user_id = y.user_id AND x.t < y.t GROUP BY 1, 2, 3""")
def events_incremental(spark, d):
    return daily_pairs(table(spark, d, "events")).withColumn("day", F.col("day").cast("string"))


@query(ORACLE_SQL["events_incremental"])
def events_streamed(spark, d):
    """The events table as a stream of files, through state and batches, to the counts of events_incremental."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    files = materialize(table(spark, d, "events").select("ts", "user_id", "event_type"), "events")  # a folder, as streams read no single file
    run = pairs_stream(event_stream(spark, files._written, ", ".join(f"{c} {t}" for c, t in files.dtypes)), at).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return read_pairs(spark, at).withColumn("day", F.col("day").cast("string"))


@query("""WITH i AS (SELECT doc_id, UNNEST(string_split(array_to_string([doc_id::VARCHAR, lang, ' ' || (doc_id % 10)::VARCHAR, ''], ','), ',')) x FROM documents)
SELECT DISTINCT TRIM(x) AS pmid FROM i WHERE TRY_CAST(TRIM(x) AS BIGINT) IS NOT NULL""")
def id_list(spark, d):
    from weftgraph.sources.ids import parse_ids

    lines = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.concat(F.col("doc_id").cast("string"), F.lit(","), "lang", F.lit(", "), (F.col("doc_id") % 10).cast("string"), F.lit(",")).alias("value"))
    return parse_ids(lines).select("pmid")


@query("""SELECT s.s_suppkey::VARCHAR AS pmid, COALESCE(c.n, 0)::BIGINT AS citation_count FROM supplier s LEFT JOIN (SELECT l_suppkey k, COUNT(*) n FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 2 = 0 GROUP BY 1) c ON s.s_suppkey = c.k""")
def citation_counts(spark, d):
    from weftgraph.sources.ids import with_citations

    c = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_suppkey % 2 = 0").groupBy(F.col("l_suppkey").cast("string").alias("pmid")).agg(F.count("*").alias("citation_count"))
    return with_citations(table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("pmid")), c)

