"""Operators that cut hot groups, follow waves or run over streams, against plain recomputation."""

import itertools
import json
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from weftgraph.operators import chatlog, edges, extract, paths, resolve, retrieval, search
from weftgraph.operators.components import connected_components, smallest_reachable
from weftgraph.sinks import writers
from weftgraph.sources import ids
from weftgraph.sources.json_objects import read_objects
from weftgraph.streaming import daily_pairs, event_stream, pairs_stream, read_pairs, windowed_counts


def test_pairs_of_a_hot_group(spark):
    r = random.Random(1)
    rows = [("hot", f"n{k}") for k in range(60)] + [(f"g{r.randrange(9)}", f"n{r.randrange(30)}") for _ in range(80)] + [(None, "n1"), ("g1", None), ("one", "n1"), ("hot", "n3")]
    members = defaultdict(set)
    for g, n in rows:
        if g is not None and n is not None:
            members[g].add(n)
    want = Counter((g, *p) for g, ns in members.items() for p in itertools.combinations(sorted(ns), 2))
    df = spark.createDataFrame(rows, "g string, n string")
    for block in (7, 59, 60, 1000):
        assert Counter(tuple(x) for x in edges.pairs_within(df, "g", "n", block=block).collect()) == want
    capped = edges.pairs_within(df, "g", "n", block=7, most=20).collect()
    assert {x[0] for x in capped} == {g for g, ns in members.items() if 1 < len(ns) <= 20}
    assert edges.pairs_within(df.limit(0), "g", "n").count() == 0


def test_a_hot_group_is_many_tasks(spark):
    n = spark.range(4000).select(F.lit("hot").alias("g"), "id")
    made = edges.pairs_within(n, "g", "id", block=250)
    keys = made._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in keys and made.count() == 4000 * 3999 // 2


def test_mutations_by_an_index_of_attributes(spark):
    nodes = [(1, "tmVar:a;HGVS:b;RS#:c_x", 1), (1, "tmVar:a;RS#:c_y", 0), (1, "HGVS:b;RS#:d", 2), (1, "MESH:D1", 3), (2, "tmVar:a;HGVS:b", 0), (2, "tmVar:a;HGVS:b", 5)]
    n = spark.createDataFrame([(*x, True) for x in nodes], "article_seq long, node_id string, node_ord int, is_mesh boolean")
    asked = [(1, 0, "tmVar:a"), (1, 1, "RS#:c;HGVS:b"), (1, 2, "RS#:d"), (1, 3, "RS#:zz"), (1, 4, "MESH:D1"), (1, 5, "nothing"), (2, 0, "HGVS:b;tmVar:a"), (2, 1, "RS#:c"), (3, 0, "tmVar:a"), (1, 6, "tmVar:a;HGVS:b;RS#:c"), (1, 7, "CA#:;HGVS:b")]
    got = edges.resolve_ids(spark.createDataFrame(asked, "article_seq long, rel_seq long, id1 string"), n, "id1").collect()
    assert {(r["article_seq"], r["rel_seq"]): r["node_id"] for r in got} == {
        (1, 0): "tmVar:a;RS#:c_y", (1, 1): "tmVar:a;HGVS:b;RS#:c_x", (1, 2): "HGVS:b;RS#:d", (1, 4): "MESH:D1", (2, 0): "tmVar:a;HGVS:b", (1, 6): "tmVar:a;HGVS:b;RS#:c_x", (1, 7): "tmVar:a;HGVS:b;RS#:c_x",
    }


@pytest.mark.parametrize("part_bytes", [200, 16_000_000])
def test_names_in_many_texts(spark, part_bytes):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 4)))
    nodes = [(f"id{k}", word().upper() if k % 7 else None) for k in range(40)] + [("x1", ""), ("x2", "aba"), ("x3", "ABA")]
    texts = [(k, " ".join(word() for _ in range(12)) + (" ID7." if k == 3 else "")) for k in range(30)] + [(90, None), (91, ""), (None, "aba"), (92, "x1X2 " * 3000)]
    want = {(d, i) for d, t in texts if d is not None and t for i, n in nodes for key in (i, n) if key and key.lower() in t.lower()}
    got = retrieval.names_in_texts(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(nodes, "node_id string, name string"), part_bytes=part_bytes)
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert retrieval.names_in_texts(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([], "node_id string, name string")).collect() == []


def test_extraction_is_counted_in_its_pass(spark):
    art = spark.createDataFrame([(k, str(k), f"T{k}", "text" if k != 3 else None) for k in range(6)], "article_seq long, pmid string, title string, abstract string")
    nodes = spark.createDataFrame([(k, n, n, "Gene", o) for k in range(6) for o, n in enumerate(("A_Gene", "B_Gene", "C_Gene"))], "article_seq long, node_id string, name string, type string, node_ord int")
    asked = spark.sparkContext.accumulator(0)

    def client(article, second):
        asked.add(1)
        k = int(article["pmid"])
        row = lambda a, b, c: f'{{"entity1_id": "{a}", "entity2_id": "{b}", "relation_type": "inhibits", "confidence": {c}}}'
        if k == 1:
            raise ValueError("no")
        return {0: f"[{row('A', 'B', 0.9)}, {row('A', 'C', 0.1)}, {row('A', 'Z', 0.9)}, {row('B', 'B', 0.9)}]", 2: "nothing here", 4: "[]", 5: f"[{row('C', 'B', 0.8)}]"}[k]

    raw = extract.extract(art, nodes, client, second_pass=False)
    watch = Observation("run")
    got = extract.semantic_evidence(raw, nodes, 0.5, watch=watch).collect()
    assert {(r["pmid"], r["u"], r["v"]) for r in got} == {("0", "A_Gene", "B_Gene"), ("5", "B_Gene", "C_Gene")}
    assert watch.get == {"attempted": 5, "skipped": 1, "failed": 1, "unparsed": 1, "empty": 1, "with_relations": 2, "unknown_ends": 1, "loops": 1, "below_threshold": 1, "kept": 2}
    assert tuple(watch.get) == extract.COUNTERS and asked.value == 5


# --- paths and components


@pytest.mark.parametrize("seed", range(5))
def test_shortest_paths_from_both_ends(spark, seed):
    r = random.Random(seed)
    n = 14
    rows = {tuple(sorted(r.sample(range(n), 2))): r.choice([0.5, 1.0, 2.5, 0.0]) for _ in range(r.choice([14, 30]))}
    rows |= {(100 + k, 101 + k): 1.0 for k in range(9)}
    cost = defaultdict(lambda: float("inf"), {(a, a): 0.0 for a in {x for e in rows for x in e}})
    for (a, b), c in rows.items():
        cost[a, b] = cost[b, a] = min(c, cost[a, b])
    step, names = dict(cost), sorted({x for e in rows for x in e})
    for k, a, b in itertools.product(names, names, names):
        cost[a, b] = min(cost[a, b], cost[a, k] + cost[k, b])
    anchors = [0, 1, 2, 3, 100, 109, 555]
    e = spark.createDataFrame([(a, b, c) for (a, b), c in rows.items()] + [(0, 0, 1.0)], "u long, v long, cost double")
    got = {(x["a"], x["b"]): x for x in paths.shortest_paths(e, spark.createDataFrame([(a,) for a in anchors], "node_id long")).collect()}
    assert got.keys() == {(a, b) for a in anchors for b in anchors if a < b and cost[a, b] < float("inf")}
    for (a, b), x in got.items():
        way = x["path"]
        assert abs(x["cost"] - cost[a, b]) < 1e-9 and way[0] == a and way[-1] == b and abs(sum(step[p] for p in zip(way, way[1:])) - x["cost"]) < 1e-9


def test_few_anchors_and_few_hops(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("c", "d", 1.0)], "u string, v string, cost double")
    two = spark.createDataFrame([("a",), ("c",), ("d",), (None,)], "node_id string")
    got = lambda **k: {(x["a"], x["b"]): (x["cost"], x["path"]) for x in paths.shortest_paths(e, two, **k).collect()}
    assert got() == {("a", "c"): (2.0, ["a", "b", "c"]), ("a", "d"): (3.0, ["a", "b", "c", "d"]), ("c", "d"): (1.0, ["c", "d"])}
    assert got(max_hops=1) == {("a", "c"): (5.0, ["a", "c"]), ("c", "d"): (1.0, ["c", "d"])}
    assert paths.shortest_paths(e, two.limit(1)).collect() == [] and paths.shortest_paths(e.limit(0), two).collect() == []


def test_components_after_contraction(spark):
    for seed in range(3):
        g = np.random.default_rng(seed)
        a, b = g.integers(0, 300, 220), g.integers(0, 300, 220)
        names, low = smallest_reachable(a, b)
        root = {x: x for x in names.tolist()}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            p, q = find(x), find(y)
            root[max(p, q)] = min(p, q)
        want = {x: find(x) for x in names.tolist()}
        assert dict(zip(names.tolist(), low.tolist())) == want
        e = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "u long, v long").repartition(5)
        got = {r["node"]: r["component"] for r in connected_components(e).collect()}
        assert got == {k: v for k, v in want.items() if any(x != y and k in (x, y) for x, y in zip(a.tolist(), b.tolist()))}


# --- streams


def test_stream_of_pairs(spark, tmp_path):
    r, day = random.Random(2), datetime(2024, 3, 1)
    batches = [[(day + timedelta(hours=12 * k, minutes=r.randrange(700)), r.randrange(5), r.choice("abcd")) for _ in range(40)] for k in range(5)]
    batches[1].append((None, 1, "a"))
    late = [(day, 77, "a"), (day + timedelta(minutes=1), 77, "b")]  # more than a day behind when they come
    kinds = "ts timestamp, user_id long, event_type string"
    for k, rows in enumerate([*batches, late]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = pairs_stream(event_stream(spark, str(tmp_path / "in"), kinds), str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
        if k == 2:
            part = {tuple(x) for x in read_pairs(spark, str(tmp_path / "out")).collect()}
            assert part == {tuple(x) for x in daily_pairs(spark.createDataFrame(sum(batches[:3], []), kinds).where("ts is not null")).collect()}
    whole = spark.createDataFrame(sum(batches, []), kinds).where("ts is not null")
    assert {tuple(x) for x in read_pairs(spark, str(tmp_path / "out")).collect()} == {tuple(x) for x in daily_pairs(whole).collect()}


def test_windowed_counts(spark, tmp_path):
    kinds = "ts timestamp, event_type string"
    day = datetime(2024, 3, 1)
    for rows in ([(day + timedelta(hours=h), "a") for h in (1, 2, 30)], [(day + timedelta(days=4), "b")], [(day + timedelta(hours=3), "a"), (day + timedelta(days=8), "b")]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = windowed_counts(event_stream(spark, str(tmp_path / "in"), kinds))
        out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(x["start"], x["event_type"]): x["n"] for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(day, "a"): 2, (day + timedelta(days=1), "a"): 1, (day + timedelta(days=4), "b"): 1}


def test_boolean_queries_keep_quoted_words():
    assert search.valid_boolean('"foot drop" AND "nerve"') and search.valid_boolean('"select a [group]" OR x') and search.valid_boolean("drop AND delete")
    assert not search.valid_boolean("SELECT x FROM y") and not search.valid_boolean('"a" ORDER BY b') and not search.valid_boolean("a [b]") and not search.valid_boolean('("a"')
    assert search.boolean_query("foot drop and nerves", '"foot drop" AND "nerve"') == '"foot drop" AND "nerve"'


@pytest.mark.parametrize("part_rows,most_pivots", [(2000, 2048), (20, 2048), (20, 3), (7, 1)])
def test_similar_pairs_by_pivots(spark, part_rows, most_pivots):
    g = np.random.default_rng(3)
    centre = g.standard_normal((6, 5))
    rows = [(k, f"t{k % 2}", (centre[g.integers(0, 6)] + 0.15 * g.standard_normal(5)).tolist()) for k in range(160)]
    rows += [(200 + k, "t0", rows[0][2]) for k in range(30)] + [(300, "t0", None), (301, "t0", []), (302, "t0", [0.0] * 5), (303, None, rows[0][2]), (304, "t0", [1.0, 2.0]), (305, "t0", [2.0, 4.0]), (306, "t1", [1.0, None, 0.0, 0.0, 0.0])]
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    good = [(i, t, v) for i, t, v in rows if t and v and None not in v and any(v)]
    want = {(a, b): cos(x, y) for (a, s, x), (b, t, y) in itertools.combinations(good, 2) if s == t and len(x) == len(y) and cos(x, y) > 0.95}
    df = spark.createDataFrame(rows, "node_id long, kind string, embedding array<double>")
    watch = Observation("sent")
    got = {(r["a"], r["b"]): r["cosine"] for r in resolve.similar_pairs(df, 0.95, "kind", part_rows=part_rows, most_pivots=most_pivots, watch=watch).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    if part_rows == 20 and most_pivots > 100:  # dealt by a hash alone, each of some 110 rows of a kind goes to 6 parts
        assert watch.get["sent"] < 0.75 * (len(good) - 2) * 5.5


@pytest.mark.parametrize("chunk,fan,indent", [(30, 2, None), (7, 3, 2), (1_000_000, 256, None)])
def test_objects_of_one_large_file(spark, tmp_path, chunk, fan, indent):
    r = random.Random(chunk)
    odd = ["}", "{", '"', "\\", '\\"', "é", "]", "\n", "a"]
    made = [[{"id": f"{f}-{k}", "text": "".join(r.choice(odd) for _ in range(r.randrange(60))), "more": [{"x": {}}] * r.randrange(3)} for k in range(n)] for f, n in enumerate((40, 0, 1, 25))]
    for f, docs in enumerate(made):
        (tmp_path / f"f{f}.json").write_text(json.dumps({"about": "}{", "PubTator3": docs}, ensure_ascii=f % 2 == 0, indent=indent) + "\n" * (f % 2), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        assert spark.read.text(str(tmp_path / "f0.json"), lineSep="}").rdd.getNumPartitions() > 5
        got = read_objects(spark, str(tmp_path), chunk=chunk, fan=fan).orderBy("number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [json.loads(x["text"]) for x in got] == [d for docs in made for d in docs] and [x["number"] for x in got] == list(range(66))


def test_any_directional(spark):
    rows = spark.createDataFrame([(True,), (False,)], "is_directional boolean")
    got = lambda df: paths.any_directional(df).collect()[0][0]
    assert got(rows) and not got(rows.where("not is_directional")) and not got(rows.limit(0))


def test_small_sources(spark, tmp_path):
    (tmp_path / "w.csv").write_text("12, 1.5\n 13 ,2\n14,none\n,3\n15\n")
    assert {(r["pmid"], r["weight"]) for r in ids.read_weights(spark, str(tmp_path / "w.csv")).collect()} == {("12", 1.5), ("13", 2.0)}
    lines = spark.createDataFrame([("# head",), ("  ",), ("77\tx",), (" 78 ",), (None,)], "line string")
    assert [r[0] for r in lines.select(ids.response_ids(F.col("line"))).collect()] == [None, None, "77", "78", None]
    a = spark.createDataFrame([(k, str(k)) for k in (3, 1, 2)], "article_seq long, pmid string")
    assert [r["pmid"] for r in ids.take_articles(a, 2).collect()] == ["1", "2"]
    seen = [[("Mouse", "Species"), ("Rat", "Species"), ("Mouse", "Species"), ("Dog", "Species")], [("Humans", "Species"), ("TP53", "Gene")], []]
    docs = spark.createDataFrame([(e,) for e in seen], "entities array<struct<name:string,type:string>>")
    assert [r[0] for r in docs.select(chatlog.study_type(F.col("entities"))).collect()] == ["animal/in vitro (Mouse, Rat)", None, None]


def test_node_sizes_span_the_degrees(spark):
    nodes = spark.createDataFrame([(k, k, "Gene", "c", "s", "-", ["1"]) for k in "abcd"], "node_id string, name string, type string, color string, shape string, mesh string, pmids array<string>")
    e = spark.createDataFrame([("a", "b"), ("a", "c")], "u string, v string")
    made = {r["id"]: json.loads(r["element"])["data"]["size"] for r in writers.node_elements(nodes, e).collect()}
    assert made == {"a": 65.0, "b": 45.0, "c": 45.0, "d": 25.0}
