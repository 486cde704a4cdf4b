"""Writers: tagged text, elements JSON, HTML, XGMML, RIS, CSV, collections and Parquet."""

from __future__ import annotations

import json
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators.edges import primary_relation, edge_rows
from weftgraph.operators.mentions import stable_id
from weftgraph.operators.prune import degrees
from weftgraph.operators.weights import shown_weight


def tagged_text(articles: DataFrame, mentions: DataFrame, relations: DataFrame, standard: bool = False) -> DataFrame:
    """(article_seq, value): each article as tagged text; with `standard`, identifier names replace surface texts."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    name = F.coalesce("identifier_name", "name") if standard else F.col("name")
    m = mentions.groupBy("article_seq").agg(F.array_sort(F.collect_list(F.struct("mention_seq", F.concat_ws("\t", blank(F.col("pmid")), F.col("start").cast("string"), F.col("end").cast("string"), blank(name), "type", F.coalesce("mesh", F.lit("-"))).alias("line")))).alias("m"))
    end = lambda k: F.coalesce(f"name{k}", f"id{k}") if standard else F.col(f"id{k}")
    r = relations.groupBy("article_seq").agg(F.array_sort(F.collect_list(F.struct("rel_seq", F.concat_ws("\t", blank(F.col("pmid")), "relation_type", end(1), end(2)).alias("line")))).alias("r"))
    a = articles.join(m, "article_seq", "left").join(r, "article_seq", "left")
    lines = lambda c: F.coalesce(F.transform(c, lambda x: x["line"]), F.array().cast("array<string>"))
    head = F.array(F.concat_ws("|", "pmid", F.lit("t"), blank(F.col("title"))), F.concat_ws("|", "pmid", F.lit("a"), blank(F.col("abstract"))))
    return a.select("article_seq", F.concat(F.concat_ws("\n", F.concat(head, lines("m"), lines("r"))), F.lit("\n")).alias("value"))


def write_tagged_text(articles: DataFrame, mentions: DataFrame, relations: DataFrame, path: str, vocabulary: bool = False) -> None:
    """Text files under path, in article order; a part file begins with the vocabulary header if asked for."""
    rows = tagged_text(articles, mentions, relations, vocabulary).repartitionByRange("article_seq").sortWithinPartitions("article_seq")
    if vocabulary:
        first = F.row_number().over(Window.partitionBy(F.spark_partition_id()).orderBy("article_seq")) == 1
        rows = rows.withColumn("value", F.when(first, F.concat(F.lit("##USE-MESH-VOCABULARY\n"), "value")).otherwise(F.col("value")))
    rows.select("value").write.text(path)


def node_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, element): nodes with an id as JSON, sized 25 to 65 by degree; of repeated ids one."""
    d = nodes.where("coalesce(node_id, '') <> ''").dropDuplicates(["node_id"]).join(degrees(edges), "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    d = d.crossJoin(F.broadcast(d.agg(F.min("degree").alias("low"), F.max("degree").alias("high"))))  # one row
    size = F.round(25 + 40 * F.coalesce(F.try_divide(F.col("degree") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)), 2)
    parent = F.col("community") if "community" in nodes.columns else F.lit(None).cast("string")
    data = F.struct(stable_id("node", F.col("node_id")).alias("id"), F.col("name").alias("label"), parent.alias("parent"), "color", "shape", F.col("type").alias("node_type"), "mesh", "pmids", F.size("pmids").alias("num_articles"), "degree", size.alias("size"))
    return d.select(F.col("node_id").alias("id"), F.to_json(F.struct(data.alias("data"))).alias("element"))


def edge_elements(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, element) of edges between known nodes; the source is the relation's first node where that is known."""
    e = edges.join(nodes.select(F.col("node_id").alias("u"), F.col("name").alias("nu")), "u").join(nodes.select(F.col("node_id").alias("v"), F.col("name").alias("nv")), "v")
    main = primary_relation(edge_rows(edges)).withColumnsRenamed({"relation": "primary", "confidence": "primary_confidence"})
    e = e.join(main, ["u", "v"], "left")
    swap = F.coalesce(F.col("source_id") != F.col("u"), F.lit(False))
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    data = F.struct(
        stable_id("edge", F.col("u"), F.col("v")).alias("id"), stable_id("node", pick("u", "v")).alias("source"), stable_id("node", pick("v", "u")).alias("target"), pick("nu", "nv").alias("source_name"), pick("nv", "nu").alias("target_name"),
        F.concat_ws(" ", pick("nu", "nv"), F.concat(F.lit("("), "primary", F.lit(")")), pick("nv", "nu")).alias("label"), "primary", F.round("primary_confidence", 3).alias("confidence"), shown_weight(F.col("edge_width")).alias("weight"), F.col("type").alias("edge_type"),
        F.array_sort(F.map_keys("relations")).alias("pmids"), "relations",
    )
    return e.select("u", "v", F.to_json(F.struct(data.alias("data"))).alias("element"))


def write_elements(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Element rows as text under path/nodes and path/edges, one JSON object a line."""
    node_elements(nodes, edges).select("element").write.text(f"{path}/nodes")
    edge_elements(edges, nodes).select("element").write.text(f"{path}/edges")


def _bounded(rows: DataFrame, most: int) -> list:
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} nodes or edges for one text; write_html and write_xgmml write any number")
    return found


def _script(element: str) -> str:
    return element.replace("</", "<\\/")


HTML_HEAD = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>Graph</title></head><body><div id="graph"></div><script>const elements = ['
#: Draws the elements as SVG: nodes around a circle in their order, edges as lines with their label as a tip.
HTML_END = """];
const made = (tag, at, text) => { const e = document.createElementNS("http://www.w3.org/2000/svg", tag); for (const k in at) e.setAttribute(k, at[k]); if (text) e.textContent = text; return e; };
const data = elements.map(e => e.data), nodes = data.filter(d => d.source === undefined), links = data.filter(d => d.source !== undefined);
const r = 80 + 9 * nodes.length, place = new Map(nodes.map((d, i) => [d.id, [r * Math.cos(2 * Math.PI * i / nodes.length), r * Math.sin(2 * Math.PI * i / nodes.length)]]));
const svg = made("svg", { viewBox: [-r - 160, -r - 60, 2 * r + 320, 2 * r + 120].join(" "), width: "100%" });
for (const d of links) { const a = place.get(d.source), b = place.get(d.target); if (a && b) svg.appendChild(made("line", { x1: a[0], y1: a[1], x2: b[0], y2: b[1], stroke: "#999", "stroke-width": Math.max(1, Number(d.weight) || 1) / 2 })).appendChild(made("title", {}, d.label)); }
for (const d of nodes) { const [x, y] = place.get(d.id); svg.appendChild(made("circle", { cx: x, cy: y, r: (d.size || 25) / 4, fill: d.color || "#888" })).appendChild(made("title", {}, d.node_type)); svg.appendChild(made("text", { x: x + (x < 0 ? -16 : 16), y: y + 3, "font-size": 10, "text-anchor": x < 0 ? "end" : "start" }, d.label)); }
document.getElementById("graph").appendChild(svg);
</script></body></html>"""


def html_page(nodes: DataFrame, edges: DataFrame, most: int = 3000) -> str:
    """A page that shows the graph; an error if it has more than `most` nodes or edges."""
    shown = node_elements(nodes, edges).orderBy("id"), edge_elements(edges, nodes).orderBy("u", "v")
    body = ",\n".join(_script(r["element"]) for df in shown for r in _bounded(df, most))
    return HTML_HEAD + body + HTML_END


def _attributes(row: dict) -> list[str]:
    lines = []
    for k, x in row.items():
        if x is not None:
            kind = "boolean" if isinstance(x, bool) else "integer" if isinstance(x, int) else "real" if isinstance(x, float) else "string"
            text = json.dumps(x, ensure_ascii=False, default=str) if isinstance(x, (list, dict)) else str(x)
            lines.append(f'    <att name={quoteattr(k)} type="{kind}" value={quoteattr(text)}/>')
    return lines


def _node_text(r: Row) -> str:
    return "\n".join([f'  <node id={quoteattr(r["node_id"])} label={quoteattr(r["name"] or "")}>', *_attributes(r.asDict(recursive=True)), "  </node>"])


def _edge_text(r: Row) -> str:
    return "\n".join([f'  <edge source={quoteattr(r["u"])} target={quoteattr(r["v"])} label={quoteattr(r["u"] + " - " + r["v"])}>', *_attributes(r.asDict(recursive=True)), "  </edge>"])


def _xgmml_head(title: str) -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<graph label={quoteattr(title)} directed="0" xmlns="http://www.cs.rpi.edu/XGMML">'


def xgmml(nodes: DataFrame, edges: DataFrame, most: int = 3000, title: str = "graph") -> str:
    """XGMML of the graph; an error if it has more than `most` nodes or edges."""
    body = [*map(_node_text, _bounded(nodes.orderBy("node_id"), most)), *map(_edge_text, _bounded(edges.orderBy("u", "v"), most))]
    return "\n".join([_xgmml_head(title), *body, "</graph>\n"])


ORDERED = "section int, a string, b string, value string"


def _write_ordered(body: DataFrame, head: str, end: str, path: str) -> None:
    """Text files under path that, joined in the order of their names, are head, body (ORDERED, sections 1 and 2) and end."""
    ends = body.sparkSession.createDataFrame([(0, "", "", head), (3, "", "", end)], ORDERED)
    rows = body.unionByName(ends).repartitionByRange("section", "a", "b").sortWithinPartitions("section", "a", "b")
    rows.select("value").write.text(path)


def write_html(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The page of a graph of any size, as text parts under path, to be joined in the order of their names."""
    shown = F.concat(F.replace("element", F.lit("</"), F.lit("<\\/")), F.lit(",")).alias("value")
    body = node_elements(nodes, edges).select(F.lit(1).alias("section"), F.col("id").alias("a"), F.lit("").alias("b"), shown)
    body = body.unionByName(edge_elements(edges, nodes).select(F.lit(2).alias("section"), F.col("u").alias("a"), F.col("v").alias("b"), shown))
    _write_ordered(body, HTML_HEAD, HTML_END, path)


def write_xgmml(nodes: DataFrame, edges: DataFrame, path: str, title: str = "graph") -> None:
    """XGMML of a graph of any size, as text parts under path, to be joined in the order of their names."""
    n = nodes.rdd.map(lambda r: (1, r["node_id"], "", _node_text(r)))
    e = edges.rdd.map(lambda r: (2, r["u"], r["v"], _edge_text(r)))
    _write_ordered(nodes.sparkSession.createDataFrame(n.union(e), ORDERED), _xgmml_head(title), "</graph>", path)


def ris(articles: DataFrame) -> DataFrame:
    """(pmid, value): bibliography records."""
    line = lambda tag, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{tag}  - "), c))
    authors = F.concat_ws("\n", F.transform(F.filter("authors", lambda a: F.trim(a) != ""), lambda a: F.concat(F.lit("AU  - "), F.trim(a))))
    pages = F.split("pages", r"\s*[-–—]\s*")
    cited = F.when(F.col("citation_count") > 0, F.concat(F.lit("Citations: "), F.col("citation_count").cast("string")))
    year = F.regexp_extract("date", r"(\d{4})", 1)
    fields = [F.lit("TY  - JOUR"), line("TI", F.col("title")), F.nullif(authors, F.lit("")), line("PY", year), line("JO", F.col("journal")), line("VL", F.col("volume")), line("IS", F.col("issue")), line("SP", F.get(pages, 0)), line("EP", F.get(pages, 1)), line("DO", F.col("doi")), line("AB", F.col("abstract")), line("N1", cited), line("AN", F.col("pmid")), F.lit("ER  - ")]
    return articles.select("pmid", F.concat(F.concat_ws("\n", *fields), F.lit("\n")).alias("value"))


def author_list(authors: Column) -> Column:
    """Names split at `;`, or at `,` where there is none."""
    return F.filter(F.transform(F.when(F.contains(authors, F.lit(";")), F.split(authors, ";")).otherwise(F.split(authors, ",")), lambda a: F.trim(a)), lambda a: a != "")


def enrich(articles: DataFrame, source: DataFrame, fields: list[str]) -> DataFrame:
    """articles with null and empty fields filled from source, by pmid."""
    s = source.select("pmid", *[F.col(f).alias(f"_{f}") for f in fields])
    j = articles.join(s, "pmid", "left")
    return j.select(*[F.coalesce(F.nullif(c, F.lit("")), f"_{c}").alias(c) if c in fields else F.col(c) for c in articles.columns])


def edge_evidence_csv(edges: DataFrame, articles: DataFrame, u: str, v: str) -> DataFrame:
    """(PMID, Title) of one edge's articles."""
    e = edges.where((F.col("u") == min(u, v)) & (F.col("v") == max(u, v))).select(F.explode(F.map_keys("relations")).alias("pmid"))
    return e.join(articles.select("pmid", "title").dropDuplicates(["pmid"]), "pmid", "left").select(F.col("pmid").alias("PMID"), F.col("title").alias("Title")).orderBy("PMID")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_collection(articles: DataFrame, mentions: DataFrame, relations: DataFrame, path: str) -> None:
    """One JSON object for each article, with its annotations and relations."""
    m = mentions.groupBy("article_seq").agg(F.array_sort(F.collect_list(F.struct("mention_seq", "pmid", "start", "end", "name", "identifier_name", "type", "mesh"))).alias("annotations"))
    r = relations.groupBy("article_seq").agg(F.array_sort(F.collect_list(F.struct("rel_seq", "pmid", "relation_type", "id1", "name1", "id2", "name2"))).alias("relations"))
    articles.join(m, "article_seq", "left").join(r, "article_seq", "left").write.json(path)


def read_collection(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from weftgraph.schema import ARTICLES, MENTIONS, RELATIONS

    inner = lambda s: ", ".join(f.strip().replace(" ", ":", 1) for f in s.removeprefix("article_seq long, ").split(", "))
    d = spark.read.schema(f"{ARTICLES}, annotations array<struct<{inner(MENTIONS)}>>, relations array<struct<{inner(RELATIONS)}>>").json(path)
    pick = lambda c: d.select("article_seq", F.explode(c).alias("x")).select("article_seq", "x.*")
    return d.drop("annotations", "relations"), pick("annotations"), pick("relations")
