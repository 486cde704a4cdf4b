"""Sources, cleaning, edges, weights and the fluent surface on small hand-made input."""

import dataclasses
import json
import math

import pytest
from pyspark.sql import functions as F

from weftgraph.engine import Graph
from weftgraph.functions import relations as rel
from weftgraph.functions import text as tx
from weftgraph.operators import communities, edges, extract, mentions, paths, resolve, search, weights
from weftgraph.operators.components import connected_components
from weftgraph.sinks import writers
from weftgraph.sources import ids
from weftgraph.sources.bioc_json import read_bioc
from weftgraph.sources.tagged_text import read_tagged_text

TEXT = """1|t|First title
1|a|An abstract | with a bar.
1\t0\t5\tTumors\tDisease\tMESH:D1
1\t6\t9\tTP53\tGene\t11;12
1\t10\t14\twidgets\tChemical\t-
1\t15\t19\twidgets\tSpecies\t-
1\t20\t24\twidget\tChemical\t
1\tAssociation\tMESH:D1\t11;x
1\tonly\tthree

2|t|Second
2|a|Text
2\t0\t5\ttumour\tDisease\tMESH:D1
2\t6\t9\tp.V600E\tProteinMutation\ttmVar:p|SUB|V|600|E;HGVS:p.V600E;CorrespondingGene:673
2\t6\t9\tunknown\tPlanet\tX
2\tCause\tMESH:D1\tHGVS:p.V600E
2\tCause\tMESH:D1\tnowhere
3|t|Last line is a title"""


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tagged") / "a.txt"
    path.write_text(TEXT)
    return read_tagged_text(spark, str(path))


def test_tagged_text(tables):
    a = tables.articles.orderBy("article_seq").collect()
    assert [(r.pmid, r.title, r.abstract) for r in a] == [("1", "First title", "An abstract | with a bar."), ("2", "Second", "Text"), ("3", "Last line is a title", "")]
    assert tables.mentions.count() == 8
    assert {(r.id1, r.id2) for r in tables.relations.collect()} == {("MESH:D1", "11"), ("MESH:D1", "HGVS:p.V600E"), ("MESH:D1", "nowhere")}


def test_article_nodes(tables):
    n = {(r.article_seq, r.node_id): r for r in mentions.article_nodes(tables.mentions, tables.articles).collect()}
    assert set(n) == {(0, "MESH:D1_Disease"), (0, "11_Gene"), (0, "12_Gene"), (0, "widget_chemical"), (1, "MESH:D1_Disease"), (1, "tmVar:p|SUB|V|600|E;HGVS:p.V600E;CorrespondingGene:673_ProteinMutation")}
    assert n[0, "MESH:D1_Disease"].name == "tumor" and n[0, "11_Gene"].mesh == "11;12"
    assert mentions.article_nodes(tables.mentions, tables.articles, mesh_only=True).where("not is_mesh").count() == 0


def test_edges_and_weights(tables):
    g = Graph.from_articles(tables).weighted()
    e = {(r.u, r.v): r for r in g.edges.collect()}
    assert len(e) == 6 + 1 and all(r.num_relations == 1 and r.edge_weight == 1 for r in e.values())
    r = Graph.from_articles(tables, edge_method="relation").edges.collect()
    assert len(r) == 2 and {x.source_id for x in r} == {"MESH:D1_Disease"}
    stats = g.statistics().first()
    assert (stats.nodes, stats.edges, stats.articles) == (5, 7, 2)
    assert g.build(community=False, max_edges=2).edges.count() == 2


def test_npmi(spark):
    rows = [(2.0, 2.0, 2.0, 2.0), (1.0, 4.0, 1.0, 8.0), (0.0, 1.0, 1.0, 4.0), (4.0, 4.0, 2.0, 8.0), (1.0, 1.0, 1.0, 8.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double, y double, xy double, n double").select(weights.npmi(*map(F.col, ("x", "y", "xy", "n")))).collect()]
    assert got[0] == 1 and got[1] == 0 and got[2] == 0 and got[4] == 0
    assert math.isclose(got[3], -1 + (math.log2(0.5) * 2) / math.log2(0.25))


def test_bioc(spark, tmp_path):
    note = lambda text, kind, ident, off, **more: {"infons": {"identifier": ident, "type": kind, **more}, "text": text, "locations": [{"offset": off, "length": len(text)}]}
    passages = [
        {"infons": {"type": "title", "journal": "J Test. 2020 Jan;12(3):4-9. doi: 10.1234/abc.", "year": "2020", "authors": "A B, C D"}, "text": "T", "annotations": [note("mouse", "Species", "10090", 5)]},
        {"infons": {"type": "abstract"}, "text": "one", "annotations": [note("V600E", "Variant", "rs1", 1, subtype="SNP"), note("x", "Chemical", "None", 0, name="ex")]},
        {"infons": {"type": "abstract"}, "text": "two", "annotations": []},
    ]
    relation = {"infons": {"type": "Association", "role1": {"identifier": "a", "name": "A"}, "role2": {"identifier": "b", "name": "B"}}}
    docs = [{"pmid": 7, "date": "2021-02-03T00:00:00Z", "passages": passages, "relations": [relation, {"infons": {"type": "Association"}}]}, {"pmid": 8, "passages": passages[:1], "relations": []}]
    (tmp_path / "b.json").write_text(json.dumps({"PubTator3": docs}))
    t = read_bioc(spark, str(tmp_path / "b.json"))
    (a,) = t.articles.collect()
    assert (a.pmid, a.date, a.journal, a.doi, a.volume, a.issue, a.pages, a.abstract, a.authors) == ("7", "2021-02-03", "J Test", "10.1234/abc", "12", "3", "4-9", "one two", ["A B", "C D"])
    assert {(m.name, m.type, m.mesh, m.identifier_name, m.start) for m in t.mentions.collect()} == {("mouse", "Species", "10090", "mouse", 5), ("V600E", "SNP", "rs1", None, 1), ("x", "Chemical", "-", "ex", 0)}
    assert t.relations.count() == 1


def test_text_rules(spark):
    words = {"species": "species", "studies": "study", "eies": "eie", "genes": "gene", "shoes": "shoe", "cells": "cell", "virus": "virus", "mouse species": "mouse species", "B Cells": "b cell"}
    df = spark.createDataFrame(list(words.items()), "a string, b string")
    assert [tuple(r) for r in df.where(tx.standard_name(F.col("a")) != F.col("b")).collect()] == []
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.cited_ids(F.lit("see PMID: 12345678, [23456789] and [123]"))) == ["12345678", "23456789"]
    assert one(tx.cut_at_sentence(F.lit("One two. Three four five six"), 14)) == "One two."
    assert one(tx.listing_kind(F.lit("List all miRNA"))) == "mirna" and one(tx.asks_for_earlier_answer(F.lit("translate the above")))
    assert one(rel.relation_name(F.lit("Inhibition"))) == "inhibits" and one(rel.confidence(F.lit("78%"))) == 0.78
    assert rel.effective_threshold(0.5, "google") == 0.25
    assert one(tx.suggested_questions(F.lit("Body. Q1: What is it? Q2: Why so? Q3: And how?"))) == ["What is it", "Why so", "And how"]


def test_ids(spark):
    lines = spark.createDataFrame([(0, "34205807, x, 34895069"), (1, ""), (2, "35883435,34205807")], "pos int, value string")
    assert [r.pmid for r in ids.parse_ids(lines).orderBy("pos").collect()] == ["34205807", "34895069", "35883435"]
    f = ids.fetch(spark.createDataFrame([("1",), ("2",)], "pmid string"), lambda p: [(x, "body " + x) for x in p])
    assert {(r.pmid, r.body) for r in f.collect()} == {("1", "body 1"), ("2", "body 2")}


def test_components_and_louvain(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (3, 9), (5, 6), (7, 7), (None, 1)], "u long, v long")
    assert {(r.node, r.component) for r in connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), (5, 5), (6, 5)}
    ring = [(a + x, a + y, 1.0) for a in ("p", "q") for x, y in (("1", "2"), ("2", "3"), ("1", "3"))] + [("p1", "q1", 0.1)]
    m = {r.node_id: r.community for r in communities.louvain(spark.createDataFrame(ring, "u string, v string, edge_weight double")).collect()}
    assert len(set(m.values())) == 2 and m["p1"] == m["p2"] == m["p3"] != m["q1"]


def test_paths(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("d", "e", 1.0)], "u string, v string, cost double")
    got = {(r.a, r.b): (r.cost, list(r.path)) for r in paths.shortest_paths(e, spark.createDataFrame([("a",), ("c",), ("e",)], "node_id string")).collect()}
    assert got == {("a", "c"): (2.0, ["a", "b", "c"])}
    two = paths.two_hop_paths(e.withColumnRenamed("cost", "score"), spark.createDataFrame([("a",)], "node_id string")).collect()
    assert [(r.a, r.b, r.c, r.score) for r in two][0] == ("a", "c", None, 5.0) and all(r.c != "a" for r in two)


def test_shortest_paths_of_many_hops(spark):
    e = [(f"n{k}", f"n{k + 1}", 1.0) for k in range(8)] + [("n0", "n8", 20.0), ("n8", "x", 1.0)]
    got = paths.shortest_paths(spark.createDataFrame(e, "u string, v string, cost double"), spark.createDataFrame([("n0",), ("n8",), ("x",)], "node_id string"))
    assert {(r.a, r.b): r.cost for r in got.collect()} == {("n0", "n8"): 8.0, ("n0", "x"): 9.0, ("n8", "x"): 1.0}


def test_resolution(spark):
    rows = [("1", "Aspirin", "Chemical", "-"), ("2", "aspirin", "Drug", "M1"), ("3", "TP53", "Gene", "7157"), ("4", "tp53", "Disease", "-"), ("5", "p53 protein", "Gene", "7157")]
    n = spark.createDataFrame(rows, "node_id string, name string, type string, mesh string").withColumn("pmids", F.array(F.col("node_id"))).withColumn("num_articles", F.lit(1))
    names = resolve.merge_names(n)
    assert {tuple(r) for r in names.collect()} == {("1", "2")}
    assert {tuple(r) for r in resolve.merge_identifiers(n, names).collect()} == {("3", "5")}
    ev = spark.createDataFrame([("1", "2"), ("1", "3"), ("2", "5")], "u string, v string").withColumn("source_id", F.lit("1"))
    kept, e = resolve.resolve(n, ev)
    assert {r.node_id for r in kept.collect()} == {"2", "4", "5"} and {(r.u, r.v) for r in e.collect()} == {("2", "5")}


def test_extraction(spark):
    assert len(extract.parse_response('```json\n[{"entity1_id": "a", "entity2_id": "b", "relation_type": "x", "confidence": "78%", "evidence": "broken')) == 1
    art = spark.createDataFrame([(0, "1", "t", "abs"), (1, "2", "t", "")], "article_seq long, pmid string, title string, abstract string")
    nodes = spark.createDataFrame([(s, n, n, "Gene", k) for s in (0, 1) for k, n in enumerate(("11_Gene", "12_Gene"))], "article_seq long, node_id string, name string, type string, node_ord int")
    reply = json.dumps([{"entity1_id": "11: a name", "entity2_id": "[12_Gene]", "relation_type": "inhibition", "confidence": 0.9}, {"entity1_id": "TP53", "entity2_id": "12_Gene", "relation_type": "x", "confidence": 1}])
    raw = extract.extract(art, nodes, lambda a, second: reply if second else "[]")
    (r,) = extract.semantic_evidence(raw, nodes).collect()
    assert (r.u, r.v, r.relation, r.source_id) == ("11_Gene", "12_Gene", "inhibits", "11_Gene")
    assert {x.outcome: x.articles for x in extract.outcomes(raw).collect()} == {"ok": 1, "skipped": 1}


def test_search():
    assert search.variants("T2DM") == ["diabetesmellitustype2", "t2dm", "type2diabetes", "type2diabetesmellitus"]
    assert search.quoted_or(["TP53", "'EGFR'", ""]) == '("TP53" OR "EGFR") AND @GENE'
    assert search.valid_boolean('"a" AND (b OR c)') and not search.valid_boolean('"a AND b') and not search.valid_boolean("a AND")


def test_sinks(spark, tables, tmp_path):
    g = Graph.from_articles(tables, edge_method="relation").weighted()
    rows = writers.edge_elements(g.edges, g.nodes).collect()
    assert len(rows) == 2 and all(json.loads(r.element)["data"]["weight"] >= 1 for r in rows)
    assert writers.xgmml(g.nodes, g.edges).count("<node ") == g.nodes.count()
    assert "<!DOCTYPE html>" in writers.html_page(g.nodes, g.edges)
    writers.save_graph(g.nodes, g.edges, str(tmp_path / "g"))
    assert writers.load_graph(spark, str(tmp_path / "g"))[0].count() == g.nodes.count()
    writers.write_tagged_text(tables.articles, tables.mentions, tables.relations, str(tmp_path / "t"))
    again = read_tagged_text(spark, str(tmp_path / "t"))
    assert again.mentions.count() == tables.mentions.count() and again.articles.count() == 3
    a = spark.createDataFrame([("1", "T", ["A B"], "2020-01-02", "J", "1", None, "3-9", "10.1/x", "abs", 4)], "pmid string, title string, authors array<string>, date string, journal string, volume string, issue string, pages string, doi string, abstract string, citation_count int")
    assert writers.ris(a).first().value.split("\n")[:5] == ["TY  - JOUR", "TI  - T", "AU  - A B", "PY  - 2020", "JO  - J"]
    assert edges.edge_rows(g.edges).count() == 2


def test_pages_above_the_bound_are_whole(spark, tables, tmp_path):
    g = Graph.from_articles(tables, node_type="all", edge_method="co-occurrence").weighted("freq")
    one = lambda df: spark.createDataFrame(df.limit(1).collect(), df.schema)
    pairs = spark.range(3200)
    nodes = one(g.nodes).drop("node_id").crossJoin(pairs.select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("node_id")))
    node = lambda c: F.concat(F.lit("n"), F.lpad(c.cast("string"), 5, "0"))
    links = one(g.edges).drop("u", "v").crossJoin(pairs.where("id > 0").select(node(F.col("id") - 1).alias("u"), node(F.col("id")).alias("v")))
    big = dataclasses.replace(g, nodes=nodes, edges=links)
    for kind, first, other in (("xgmml", "<node ", "<edge "), ("html", '"node_type"', '"edge_type"')):
        big.write(str(tmp_path / kind), kind)
        text = "".join(p.read_text() for p in sorted((tmp_path / kind).glob("part-*")))
        assert (text.count(first), text.count(other)) == (3200, 3199) and text.rindex(first) < text.index(other)
        assert text.startswith("<?xml" if kind == "xgmml" else "<!DOCTYPE") and text.endswith("</graph>\n" if kind == "xgmml" else "</html>\n")
    for make in (writers.xgmml, writers.html_page):
        with pytest.raises(ValueError):
            make(nodes, links)
