"""Steps that deal rows into tasks by their number, and Louvain where nodes have many neighbours."""

import random
from collections import Counter

import numpy as np
import pytest
from test_parallel import local_louvain, modularity

from weftgraph import session
from weftgraph.operators import communities, edges, mentions
from weftgraph.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 20)


def test_pairs_are_dealt_by_their_number(spark, few):
    r = random.Random(4)
    rows = [(k // 5, r.randrange(9)) for k in range(600)] + [(None, 1), (3, None)]
    df = spark.createDataFrame(rows, "g long, n long")
    made = edges.pairs_within(df, "g", "n")
    assert made.rdd.getNumPartitions() >= len(rows) / 20
    want = Counter((u, v) for u, v in ((x["u"], x["v"]) for x in made.collect()))
    counts = edges.pair_counts(df, "g", "n")
    assert edges.pair_total(df, "g", "n") == sum(want.values())
    assert counts.rdd.getNumPartitions() >= sum(want.values()) / 20
    assert {(x["u"], x["v"]): x["num_relations"] for x in counts.collect()} == want
    assert edges.pair_counts(df.limit(0), "g", "n").collect() == []


@pytest.mark.parametrize("block", [4, 1000])
def test_pairs_of_small_groups_are_counted_without_a_join(spark, few, monkeypatch, block):
    monkeypatch.setattr(edges, "BLOCK", block)
    r = random.Random(8)
    rows = [(k // 6, f"n{r.randrange(9)}") for k in range(300)] + [(None, "n1"), (3, None), (900, "n1")]
    counts = edges.pair_counts(spark.createDataFrame(rows, "g long, n string"), "g", "n")
    groups = {}
    for g, n in rows:
        if g is not None and n is not None:
            groups.setdefault(g, set()).add(n)
    want = Counter((u, v) for x in groups.values() for u in x for v in x if u < v)
    assert {(x["u"], x["v"]): x["num_relations"] for x in counts.collect()} == want
    assert ("Join" in counts._jdf.queryExecution().optimizedPlan().toString()) == (block == 4)


def test_weights_are_dealt_by_article(spark, few):
    rows = spark.createDataFrame([(k % 3, k // 2) for k in range(400)] * 2, "n long, pmid long")
    weights = spark.createDataFrame([(k, k / 4) for k in range(0, 200, 2)], "pmid long, weight double")
    got = lambda **k: {tuple(x) for x in mentions.weighted_count(rows, ["n"], weights, **k).collect()}
    assert got(size=800) == got() and len(got()) == 3


def test_mutations_are_dealt_by_their_number(spark, few):
    made = catalogue.mutation_match(spark, SF)
    assert made.rdd.getNumPartitions() >= spark.read.parquet(f"{SF}/lineitem.parquet").count() / 20


def test_relations_are_dealt_by_their_number(spark, few):
    made = catalogue.primary_relation(spark, SF)
    assert made.rdd.getNumPartitions() >= spark.read.parquet(f"{SF}/lineitem.parquet").count() / 20


def test_louvain_of_nodes_with_many_neighbours(spark):
    r, n = random.Random(6), 240
    rows = [(u, v, 1.0) for u in range(n) for v in range(u + 1, n) if r.random() < (0.6 if u // 60 == v // 60 else 0.1)]
    assert 2 * len(rows) > communities.MANY * n
    got = {x["node_id"]: x["community"] for x in communities.louvain(spark.createDataFrame(rows, "u long, v long, edge_weight double")).collect()}
    u, v, w = (np.array(x) for x in zip(*rows))
    label = local_louvain(u, v, w, w.sum())
    assert modularity(rows, got) >= 0.99 * modularity(rows, dict(enumerate(label.tolist())))
