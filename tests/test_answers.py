"""Answers, histories, fetching, contexts and displays on small hand-made input."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftgraph.engine import Graph
from weftgraph.functions import relations as rel
from weftgraph.functions import text as tx
from weftgraph.operators import answer, chatlog, communities, edges, extract, mentions, paths, prune, resolve, retrieval, search
from weftgraph.session import delete, materialize, numbered, scratch
from weftgraph.sinks import writers
from weftgraph.sources import ids
from weftgraph.sources.bioc_json import identifier_names
from weftgraph.sources.tagged_text import read_tagged_text


def article(pmid, *genes):
    lines = [f"{pmid}|t|Title {pmid}", f"{pmid}|a|Abstract {pmid}"]
    return "\n".join([*lines, *(f"{pmid}\t0\t4\t{g}\tGene\t{k}" for g, k in genes)]) + "\n"


BODIES = [article("1234567", ("TP53", 7157), ("MDM2", 4193)), article("2345678", ("TP53", 7157), ("miR-21", 406991)), article("3456789", ("MDM2", 4193), ("TP53", 7157), ("EGFR", 1956))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("articles") / "a.txt"
    path.write_text("\n".join(BODIES))
    return read_tagged_text(spark, str(path))


@pytest.fixture(scope="module")
def graph(tables):
    return Graph.from_articles(tables).weighted()


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_tagged_text_in_small_blocks(spark, tmp_path):
    text = "stray|a|before any title\n" + "".join(article(str(1000000 + k), ("TP53", 7157), ("MDM2", 4193)) + "\r\n" for k in range(300))
    (tmp_path / "a.txt").write_text("##USE-MESH-VOCABULARY\n" + text)
    (tmp_path / "b.txt").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        t = read_tagged_text(spark, str(tmp_path))
        a = t.articles.orderBy("article_seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.article_seq, r.pmid, r.use_vocab) for r in a] == [(k, str(1000000 + k % 300), k < 300) for k in range(600)] and a[0].abstract == "Abstract 1000000"
    assert t.mentions.count() == 1200 and {r.mention_seq for r in t.mentions.select("mention_seq").distinct().collect()} == {0, 1}


@pytest.mark.skipif("WEFTGRAPH_FIXTURES" not in os.environ, reason="WEFTGRAPH_FIXTURES names no folder of tagged text files")
def test_expected_graphs(spark):
    """Articles, mentions and relations of a file to the nodes and edges of its graphs, as derived by hand."""
    expected = {(3, 31, 12): [(14, 47), (13, 41), 9], (3, 82, 39): [(29, 216), (29, 216), 24], (3, 12, 0): [(10, 15), (9, 13), 0], (1, 11, 1): [(7, 21), (5, 10), 0], (1, 37, 10): [(18, 153), (18, 153), 10], (1, 666, 10): [(125, 7750), (97, 4656), 10], (1, 40, 10): [(20, 190), (20, 190), 10], (1, 33, 1): [(9, 36), (8, 28), 1], (1, 33, 0): [(9, 36), (8, 28), 0]}
    seen = set()
    for path in sorted(Path(os.environ["WEFTGRAPH_FIXTURES"]).glob("*.pubtator")):
        t = read_tagged_text(spark, f"file://{path}")
        key = t.articles.count(), t.mentions.count(), t.relations.count()
        both = [Graph.from_articles(t, node_type=k) for k in ("all", "mesh")]
        assert [*((g.nodes.count(), g.edges.count()) for g in both), Graph.from_articles(t, edge_method="relation").edges.count()] == expected[key], path.name
        seen.add(key)
    assert seen == set(expected)


def test_numbers_and_scratch(spark):
    with scratch(spark):
        d = numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7), "x")
        kept = materialize(d, "kept")
        assert [r.x for r in kept.orderBy("number").collect()] == list(range(1000)) and numbered(spark.range(0), "id").count() == 0
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(kept._written).count()
    assert delete(spark, kept._written) is None


def test_texts(spark):
    answer_text = "<thinking_english>\nplan\n</thinking_english>\n## Layer 1: x\nTP53  regulates MDM2 [2345678].\n\n\n| a | b |\n**Claim:** none\n```mermaid\ngraph\n```\nMore PMID: 1234567 here.\n[Q1: what?]\nQ2: why [3456789]"
    assert one(spark, tx.compressed_answer(F.lit(answer_text))) == "TP53 regulates MDM2 [2345678].\n\nMore PMID: 1234567 here.\n[Cited PMIDs: 1234567, 2345678, 3456789]"
    assert one(spark, tx.compressed_answer(F.lit(None).cast("string"))) == ""
    long = one(spark, tx.compressed_answer(F.lit("One two three. " * 200 + "[2345678]")))
    assert long.endswith("three. [...]\n[Cited PMIDs: 2345678]") and len(long) < 1450
    assert one(spark, tx.memory_entry(F.lit("What " + "is " * 60), F.lit("- short\n* TP53 regulates MDM2 in cells.\n[Cited PMIDs: 1234567]"))).split("\n") == ["Q: " + ("What " + "is " * 60)[:120].rstrip() + "…", "A: TP53 regulates MDM2 in cells."]
    assert one(spark, tx.suggested_questions(F.lit("Body\n[Q1: What is it?]\n**Q2:** why so?\nQ3. WHAT IS IT\nQ4: a last (one)"))) == ["What is it", "why so", "a last (one)"]
    linked = one(spark, tx.link_ids(F.lit('PMID: 1234567, [2345678], rs[3456789], <a href="x">[4567890]</a>')))
    assert linked == '<a href="https://pubmed.ncbi.nlm.nih.gov/1234567/">PMID: 1234567</a>, [<a href="https://pubmed.ncbi.nlm.nih.gov/2345678/">2345678</a>], rs[3456789], <a href="x">[4567890]</a>'
    assert one(spark, tx.has_han(F.lit("基因"))) and not one(spark, tx.has_han(F.lit("gene"))) and one(spark, tx.is_mirna(F.lit(" miR-21")))
    assert one(spark, rel.clean_id(F.lit("[11: a name]"))) == "11" and one(spark, rel.is_symmetric(F.lit("binding"))) and one(spark, rel.relation_record(F.lit("Binding"))).asDict() == {"original": "Binding", "normalized": "binds_to", "display": "binds to", "is_directional": False, "is_symmetric": True}
    assert one(spark, rel.is_directional(F.lit("leads to"))) and len(rel.USUAL_FORM) == 36


def test_follow_ups(spark):
    assert one(spark, tx.follow_ups(F.lit("Body\n[Q1: What is it?]\n[Q2: Why so?]"))) == ["What is it", "Why so"]
    assert one(spark, tx.follow_ups(F.lit("Q10 is no marker"))) == tx.DEFAULT_QUESTIONS and one(spark, tx.follow_ups(F.lit("基因"), 2)) == tx.DEFAULT_QUESTIONS_HAN[:2]
    assert one(spark, tx.follow_ups(F.lit("Q1: ??"))) == [] and one(spark, tx.follow_ups(F.lit(""))) == [] and one(spark, tx.follow_ups(F.lit(None).cast("string"))) == []


def test_boolean_queries_of_models():
    clean, valid = search.clean_boolean, search.valid_boolean
    assert clean('Sure:\n```text\nQuery: "a" AND\n "b"\n```\nbye') == '"a" AND "b"' and clean('**Output:** `"foot drop"`') == "foot drop"
    assert clean('The query that I would use for this question is "COLORECTAL" or rather "lung AND @GENE_TP53" I think') == "lung AND @GENE_TP53"
    assert valid('"foot drop" AND "nerve"') and valid('"select" AND @GENE_TP53')
    for bad in ("", " ()", '"a" AND', "a @", "a @ ", "a AND (", "select x", "[a]", '"a'):
        assert not valid(bad), bad


def test_summaries(spark):
    told = []
    c = answer.Conversation(spark, None, None, lambda q: [], lambda m: told.append(m) or "short", system="be brief")
    rows = [(str(k), f"{k} " + "x" * 5000) for k in range(1, 5)] + [("0", None)]
    assert c.summarize(spark.createDataFrame(rows, "pmid string, abstract string"), "Sum up.") == "short"
    whole = "\n\n".join(t for _, t in rows[:4])
    assert told == [[{"role": "system", "content": "be brief"}, {"role": "user", "content": "Sum up.\n\n" + whole[: answer.SUMMARY_CHARS] + answer.CUT_NOTE}]]
    few = spark.createDataFrame([("2", "b"), ("1", "a")], "pmid string, abstract string")
    assert answer.joined_abstracts(few) == "a\n\nb" and answer.joined_abstracts(few, limit=4) == "a\n\nb" and answer.joined_abstracts(few, limit=3) == "a\n\n" + answer.CUT_NOTE
    assert answer.joined_abstracts(few.limit(0)) == "" and c.summarize(few.limit(0), "x") == ""


def test_histories(spark, tmp_path):
    turns = spark.createDataFrame([(1, 2 * k + i, role, f"{role} says number {k} in a long line.") for k in range(5) for i, role in enumerate(("user", "assistant"))] + [(2, 0, "user", "alone")], "conv_id long, turn long, role string, text string")
    kept, old = chatlog.compress_history(turns, 3)
    assert sorted((r.conv_id, r.turn) for r in kept.collect()) == [(1, k) for k in range(4, 10)] + [(2, 0)]
    assert [(r.turn, r.entry) for r in old.orderBy("turn").collect()] == [(2 * k, f"Q: user says number {k} in a long line.\nA: assistant says number {k} in a long line.") for k in (0, 1)]
    (m,) = chatlog.memory_text(old).collect()
    assert m.memory.startswith("### Long-term Conversation Memory") and m.memory.index("[Turn 1]") < m.memory.index("number 0") < m.memory.index("[Turn 2]")
    chatlog.save_history(turns, old, str(tmp_path / "h"))
    t, e = chatlog.load_history(spark, str(tmp_path / "h"))
    assert sorted(t.collect()) == sorted(turns.collect()) and sorted(e.collect()) == sorted(old.select("conv_id", "turn", "entry").collect())


def conversation(spark, tables, graph, client, **more):
    docs = tables.articles.select("pmid", "title", "abstract").withColumn("embedding", F.when(F.col("pmid") == "2345678", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))).withColumn("weight", F.lit(1.0))
    lines = edges.edge_rows(graph.edges).select("pmid", F.col("u").alias("source"), "relation", F.col("v").alias("target"))
    return answer.Conversation(spark, docs, lines, lambda q: [1.0, 0.0], client, graph, **more)


def test_answers_cite_what_was_retrieved(spark, tables, graph, tmp_path):
    asked = []

    def client(messages):
        asked.append(messages)
        return "TP53 matters [PMID:1234567], unlike [9999999]."

    c = conversation(spark, tables, graph, client, system="Answer from the context.")
    got = c.ask("Does TP53 bind MDM2?")
    assert got["success"] and got["sources"] == ["1234567"] and got["context_count"] == 3
    context = asked[0][-1]["content"]
    assert asked[0][0] == {"role": "system", "content": "Answer from the context."} and context.endswith("Does TP53 bind MDM2?") and "Relevance #1 (Impact Score: 1.00)] [Study Type: Human/General]\nTitle: Title 2345678" in context and "- 4193_Gene --[co-mention]--> 7157_Gene" in context and "tp53 --[co-mention]-->" in context
    c.ask("Does TP53 bind MDM2?", k=2)
    assert "PMID: 2345678 (Relevance: " in asked[1][-1]["content"] and [m["role"] for m in asked[1][1:]] == ["user", "assistant", "user"]
    c.ask("translate the above")
    assert asked[2][-1]["content"] == "translate the above"
    c.save(str(tmp_path / "c"))
    again = conversation(spark, tables, graph, client)
    again.load(str(tmp_path / "c"))
    assert again.turns == c.turns and again.statistics() == {"messages": 6, "questions": 3, "answers": 3, "documents": 3}


def test_answers_list_without_the_client(spark, tables, graph):
    def client(messages):
        raise RuntimeError("no answer")

    c = conversation(spark, tables, graph, client)
    got = c.ask("請列出所有 miRNA")
    assert got["success"] and "mir-21" in got["message"] and "tp53" not in got["message"] and got["sources"] == ["2345678"]
    failed = c.ask("Why?")
    assert not failed["success"] and failed["error"] == "no answer" and len(c.turns) == 2


def test_fetch_until_enough(spark):
    asked = []
    have = {str(1000000 + k): article(str(1000000 + k), ("TP53", 7157)) for k in range(0, 60, 2)}
    order = spark.createDataFrame([(str(1000000 + k), k) for k in range(60)], "pmid string, pos int")

    def client(pmids):
        return [(p, have[p]) for p in pmids if p in have]

    def read(bodies):
        asked.append(bodies.count())
        return ids.read_bodies(bodies)

    t = ids.fetch_enough(order, client, read, 20)
    a = t.articles.orderBy("article_seq").collect()
    assert [r.pmid for r in a] == [str(1000000 + k) for k in range(0, 40, 2)] and t.mentions.count() == 20 and len(asked) > 1 and asked[0] == 12
    assert ids.fetch_enough(order, client, ids.read_bodies, 100).articles.count() == 30 and ids.fetch_enough(order.limit(0), client, ids.read_bodies, 5).articles.count() == 0
    body = json.dumps({"PubTator3": [{"pmid": "7", "passages": [{"infons": {"type": "title"}, "text": "T", "annotations": []}, {"infons": {"type": "abstract"}, "text": "A", "annotations": []}], "relations": []}]})
    assert [r.pmid for r in ids.read_bodies(spark.createDataFrame([(body, 0)], "body string, place long"), "bioc").articles.collect()] == ["7"]


def test_search_clients(spark):
    pages = {1: [str(k) for k in range(100)], 2: ["5", "200", "201"]}
    found = ids.search_ids(spark, "q", lambda q, k: pages.get(k, []), 250).orderBy("pos").collect()
    assert len(found) == 102 and found[-1].pmid == "201"
    assert [r.pmid for r in ids.cited_first(spark, "q", lambda q: "# head\n\n12\tx\n13\ty\n12\tz", lambda q, k: [], 5).orderBy("pos").collect()] == ["12", "13"]

    def broken(q):
        raise OSError

    assert ids.cited_first(spark, "q", broken, lambda q, k: pages.get(k, []), 3).count() == 3
    up = lambda s, n=100: one(spark, ids.uploaded_text(F.lit(s), n))
    assert up("data:text/plain;base64,aMOpbGxv") == "héllo" and up("data:text/plain;base64,aOlsbG8=") == "héllo" and up("data:text/plain;base64,aGVsbG8=", 4) is None and up("hello") is None and up("data:text/plain;base64,a*b=") is None
    assert [(r.pmid, r.pos) for r in ids.dedupe_ids(spark.createDataFrame([(" 1", 3), ("1", 1), ("", 0)], "pmid string, pos int")).collect()] == [("1", 1)]


def test_boolean_queries():
    assert search.fallback_query("Which genes relate to osteoporosis and the TP53 gene?") == '"Which" AND "relate"'
    assert search.fallback_query("a OR b") == "a OR b" and search.fallback_query("基因") == ""
    assert search.boolean_query("TP53 cancer", '```\nquery: "TP53" AND "cancer"\n```') == '"TP53" AND "cancer"'
    assert search.boolean_query("TP53 cancer", '"TP53 AND') == '"TP53" AND "cancer"'


def test_visibility(spark, graph):
    n = spark.createDataFrame([("a", "Gene"), ("b", "Gene"), ("c", "Disease"), ("d", "Disease"), ("c0", "Gene")], "node_id string, type string").withColumn("pmids", F.array(F.col("node_id")))
    e = spark.createDataFrame([("a", "b", "semantic", 0.9), ("b", "c", "semantic", 0.1), ("a", "c", "node", None)], "u string, v string, type string, conf double")
    shown, kept = prune.confident_graph(n, e.where("type = 'semantic'"), F.col("conf"), 0.5)
    assert {r.node_id for r in shown.collect()} == {"a", "b", "d", "c0"} and kept.count() == 1
    assert {r.node_id for r in prune.shown_nodes(n, e, ["Gene"], 2).collect()} == {"a", "b", "c0"}
    r = prune.selection_statistics(n, e.withColumn("relations", F.create_map(F.lit("x"), F.array(F.lit("r")))), spark.createDataFrame([("a",), ("c0",), ("zz",)], "node_id string"), spark.createDataFrame([("a", "b")], "u string, v string")).first()
    assert (r.nodes, r.edges, r.articles) == (1, 1, 2)
    rows = edges.inspector_rows(graph.edges).collect()
    assert rows and all((x.confidence, x.evidence) == ("N/A", "No evidence available") for x in rows)
    assert prune.self_loops(spark.createDataFrame([("a", "a"), ("a", "b")], "u string, v string")).count() == 1
    link = prune.node_link(F.col("type"), F.col("mesh"))
    assert [x[0] for x in spark.createDataFrame([("Gene", "1;2"), ("Disease", "MESH:D1"), ("SNP", "x")], "type string, mesh string").select(link).collect()] == ["https://www.ncbi.nlm.nih.gov/gene/1", "https://meshb.nlm.nih.gov/record/ui?ui=D1", None]


def test_contexts_and_indexes(spark, graph):
    docs = spark.createDataFrame([("1", "T", None, 0.25), ("2", None, "A", 0.5)], "pmid string, title string, abstract string, score double")
    lines = spark.createDataFrame([("1", "a", "x", f"t{k:02d}") for k in range(20)] + [("1", "a", None, "t00")], "pmid string, source string, relation string, target string")
    text = retrieval.joined_contexts(retrieval.document_context(docs, lines))
    first, second = text.split("\n---\n\n")
    assert first == "PMID: 2 (Relevance: 0.50)\nTitle: \nAbstract: A" and second.count("- a --[") == 15 and "- a --[associated]--> t00" in second
    assert retrieval.joined_contexts(retrieval.document_context(docs.limit(0), lines)) == "No relevant abstracts found."
    n = spark.createDataFrame([("1", "p53", "Gene", [1.0, 0.0]), ("2", "mouse", "Species", [0.9, 0.0]), ("3", "x", "Gene", [0.0, 1.0])], "node_id string, name string, type string, embedding array<double>")
    assert [(r.node_id, round(r.score, 3)) for r in retrieval.nearest_nodes(n, [1.0, 0.0], 2, ignored=["species"]).collect()] == [("1", 1.0), ("3", 0.414)]
    assert [r[0] for r in n.select(retrieval.node_text(F.col("name"), F.col("type"))).collect()] == ["p53 (Gene)", "mouse (Species)", "x (Gene)"]
    assert {r.node_id for r in retrieval.valid_nodes(n, allowed=["gene"]).collect()} == {"1", "3"}
    assert retrieval.index_part(n, n.limit(1), 2).count() == 1 and retrieval.index_part(n, n.limit(1), 3).count() == 3
    assert {(r.key, r.node_id) for r in retrieval.name_index(n.where("node_id = '1'")).collect()} == {("1", "1"), ("p53", "1")}
    assert {r.node_id for r in retrieval.nodes_in_query(n, "Is p53 old?", spark.createDataFrame([("3", 0.7), ("2", 0.6)], "node_id string, score double")).collect()} == {"1", "3"}
    picked = spark.createDataFrame([("P53",), ("2",), ("nothing",)], "key string")
    assert {(r.key, r.node_id) for r in retrieval.select_nodes(picked, n).collect()} == {("P53", "1"), ("2", "2")}
    d = retrieval.selected_documents(graph.edges, docs.withColumn("pmid", F.lit("1234567"))).where("pmid = '1234567'").first()
    assert d.title in ("T", "No title") and d.edges[0].relations == ["co-mention"]
    a = spark.createDataFrame([(0, "1", "T", "A"), (1, "2", "T", ""), (2, "3", "U", "B")], "article_seq long, pmid string, title string, abstract string")
    got = retrieval.documents(a, spark.createDataFrame([("3", 2.0)], "pmid string, weight double")).collect()
    assert [(r.pmid, r.weight, r.text) for r in got] == [("3", 2.0, "U\n\nB"), ("1", 1.0, "T\n\nA")]
    assert retrieval.document(docs, "2").first().abstract == "A" and retrieval.indexed_ids(docs.union(docs)).count() == 2


def test_batches_run_on(spark):
    docs = spark.createDataFrame([(k, "word " * (k % 7 * 40)) for k in range(500)], "doc_id long, text string").repartition(9)
    got = retrieval.batches(docs, "doc_id", tokens=1000, rows=20).orderBy("doc_id").collect()
    batch = used = count = 0
    for k, r in enumerate(got):
        n = int(k % 7 * 40 / 0.75) + 1
        if count and (used + n > 1000 or count >= 20):
            batch, used, count = batch + 1, 0, 0
        used, count = used + n, count + 1
        assert (r.doc_id, r.n_tokens, r.batch) == (k, n, batch)


def test_similar_nodes_of_unknown_type(spark):
    rows = [("a", "x", "Disease", "D1", [1.0, 0.0]), ("b", "y", "unknown", "-", [1.0, 0.01]), ("c", "z", "Chemical", "-", [1.0, 0.0]), ("d", "w", "Gene", "-", [0.99, 0.02]), ("e", "v", "unknown", "-", [0.0, 1.0])]
    n = spark.createDataFrame(rows, "node_id string, name string, type string, mesh string, embedding array<double>")
    assert {tuple(r) for r in resolve.merge_similar(n.drop("embedding"), n.select("node_id", "embedding")).collect()} == {("b", "a")}
    assert resolve.merge_similar(n.drop("embedding").limit(0), n.select("node_id", "embedding")).count() == 0


def test_similar_pairs_in_parts(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(resolve, "PART_ROWS", 7)
    x = np.random.default_rng(2).standard_normal((60, 4))
    rows = [(k, [float(a) for a in v], k % 2) for k, v in enumerate(x)] + [(70, None, 0), (71, [0.0] * 4, 0), (72, [1.0], 0), (73, [1.0, None, 1.0, 1.0], 0), (74, [float(a) for a in x[0]], None)]
    got = {(r.a, r.b): r.cosine for r in resolve.similar_pairs(spark.createDataFrame(rows, "node_id long, embedding array<double>, label int"), 0.5, "label").collect()}
    want = {(a, b): c for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2 and (c := x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b])) > 0.5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_paths_with_relevance(spark, graph):
    scores = {(r.a, r.b): r.score for r in graph.paths("tp53").where("c is null").collect()}
    with_fit = {(r.a, r.b): r.score for r in graph.paths("tp53", relevance=spark.createDataFrame([("7157_Gene", 1.0)], "node_id string, score double")).where("c is null").collect()}
    assert with_fit["7157_Gene", "4193_Gene"] == pytest.approx(scores["7157_Gene", "4193_Gene"] + 0.5 * 0.3 * 1.2)
    records = graph.path_records("tp53").collect()
    assert any(r.text.startswith("tp53 --[co-mention]--> ") for r in records) and not records[0].is_directional
    roles = {r.node_id: r.role for r in paths.bridges(graph.paths("egfr")).collect()}
    assert roles["7157_Gene"] == "bridge" and "endpoint" in roles.values()
    starts = paths.start_nodes(graph.nodes, graph.edges, "Is EGFR known?", 2).collect()
    assert starts[0].node_id == "1956_Gene" and len(starts) == 2


def test_graph_surface(spark, graph, tables, tmp_path):
    assert {tuple(sorted((r.u, r.v))) for r in graph.search("EGFR, miR-21").collect()} == {("1956_Gene", "7157_Gene"), ("406991_Gene", "7157_Gene")}
    assert graph.search("EGFR").count() == 2
    assert graph.rebuild(min_degree=2).nodes.count() == 3 and graph.rebuild(max_edges=1).edges.count() == 1
    m = spark.createDataFrame([("7157_Gene", "c0"), ("4193_Gene", "c0"), ("1956_Gene", "c1")], "node_id string, community string")
    n = {r.node_id: r for r in communities.with_communities(graph.nodes, m, graph.edges).collect()}
    assert n["c0"].name == "tp53" and n["c1"].name == "egfr" and n["4193_Gene"].parent == "c0" and n["406991_Gene"].parent is None
    writers.write_collection(tables.articles, tables.mentions, tables.relations, str(tmp_path / "c"))
    a, men, r = writers.read_collection(spark, str(tmp_path / "c"))
    assert a.count() == 3 and men.count() == tables.mentions.count() and r.count() == 0
    csv = writers.edge_evidence_csv(graph.edges, tables.articles, "7157_Gene", "4193_Gene").collect()
    assert [(x.PMID, x.Title) for x in csv] == [("1234567", "Title 1234567"), ("3456789", "Title 3456789")]
    filled = writers.enrich(tables.articles.withColumn("title", F.lit("")), spark.createDataFrame([("1234567", "New")], "pmid string, title string"), ["title"])
    assert {x.pmid: x.title for x in filled.collect()} == {"1234567": "New", "2345678": None, "3456789": None}
    assert one(spark, writers.author_list(F.lit("A B; C, D"))) == ["A B", "C, D"] and one(spark, writers.author_list(F.lit("A B, C"))) == ["A B", "C"]
    men = spark.createDataFrame([(0, 0, "M1", "old"), (0, 1, "M1", "new"), (0, 2, "-", "no")], "article_seq long, mention_seq int, mesh string, identifier_name string")
    assert identifier_names(men).first().identifiers == {"M1": "new"}
    assert mentions.graph_nodes(graph.article_nodes).count() == 4


def test_extraction_reuses_and_gives_up(spark):
    import time

    art = spark.createDataFrame([(0, "1", "t", "abs"), (1, "2", "t", "abs"), (2, "3", "t", "slow")], "article_seq long, pmid string, title string, abstract string")
    nodes = spark.createDataFrame([(s, n, n, "Gene", k) for s in (0, 1, 2) for k, n in enumerate(("11_Gene", "12_Gene"))], "article_seq long, node_id string, name string, type string, node_ord int")
    reply = json.dumps([{"entity1_id": "11", "entity2_id": "12", "relation_type": "inhibition", "confidence": 0.9}])

    def client(a, second):
        if a["abstract"] == "slow":
            time.sleep(5)
        return reply

    raw = materialize(extract.extract(art, nodes, client, second_pass=False, seconds=0.5), "raw")
    assert {r.pmid: r.outcome for r in raw.collect()} == {"1": "ok", "2": "ok", "3": "failed"}

    def never(a, second):
        assert a["pmid"] == "3"
        return "[]"

    again = extract.extract(art.where("pmid <> '2'"), nodes, never, second_pass=False, known=raw)
    assert {(r.pmid, r.outcome, r.entity1_id) for r in again.collect()} == {("1", "ok", "11"), ("3", "none", None)}
