"""Rules that go row by row or node by node, held against their sequential form: communities, batches, greedy merging."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import batching, communities, resolve, scan
from weftgraph.operators.batching import Fill


# --- communities: one after the other, in one process


def local_louvain(u: np.ndarray, v: np.ndarray, w: np.ndarray, total: float, seed: int = 1) -> np.ndarray:
    """Labels of nodes 0..n-1 by modularity over edges (u, v, w); total is the weight of the whole graph's edges."""
    n = int(max(u.max(initial=-1), v.max(initial=-1))) + 1
    member = np.arange(n)
    if total <= 0:
        return member
    rng = np.random.default_rng(seed)
    loops = np.zeros(n)
    while True:
        near: list[dict[int, float]] = [{} for _ in range(n)]
        for a, b, x in zip(u.tolist(), v.tolist(), w.tolist()):
            near[a][b] = near[a].get(b, 0.0) + x
            near[b][a] = near[b].get(a, 0.0) + x
        strength = np.array([sum(d.values()) for d in near]) + 2 * loops
        label, mass, moved_ever = np.arange(n), strength.copy(), False
        for _ in range(100):
            moved = False
            for i in rng.permutation(n):
                links: dict[int, float] = {}
                for j, x in near[i].items():
                    links[label[j]] = links.get(label[j], 0.0) + x
                own = label[i]
                mass[own] -= strength[i]
                gain = lambda c: links.get(c, 0.0) - mass[c] * strength[i] / (2 * total)  # noqa: B023, E731
                best = max(sorted(links), key=gain, default=own)
                if gain(best) <= gain(own) + 1e-12:
                    best = own
                mass[best] += strength[i]
                if best != own:
                    label[i], moved, moved_ever = best, True, True
            if not moved:
                break
        if not moved_ever:
            return member
        _, label = np.unique(label, return_inverse=True)
        member, n = label[member], int(label.max()) + 1
        inner = np.bincount(label, loops, n)
        a, b = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        inner += np.bincount(a[a == b], w[a == b], n)
        loops = inner
        key, at = np.unique(a[a != b] * n + b[a != b], return_inverse=True)
        u, v, w = key // n, key % n, np.bincount(at, w[a != b], len(key)).astype(float)


def modularity(rows, label):
    total, inner, mass = sum(w for *_, w in rows), 0.0, {}
    for u, v, w in rows:
        inner += w * (label[u] == label[v])
        for x in (u, v):
            mass[label[x]] = mass.get(label[x], 0.0) + w
    return inner / total - sum((m / (2 * total)) ** 2 for m in mass.values())


def planted(seed, groups, size, inside, outside):
    r, n = random.Random(seed), groups * size
    return [(u, v, float(r.randint(1, 4))) for u in range(n) for v in range(u + 1, n) if r.random() < (inside if u // size == v // size else outside)]


@pytest.mark.parametrize("rows,share", [(planted(1, 8, 12, 0.5, 0.02), 0.99), (planted(2, 5, 30, 0.2, 0.02), 0.99), ([(u, (u + 1) % 60, 1.0) for u in range(60)], 0.99), (planted(3, 1, 60, 0.08, 0), 0.99)], ids=["planted", "loose", "ring", "random"])
def test_louvain_is_as_good_as_one_by_one(spark, rows, share):
    got = {r["node_id"]: r["community"] for r in communities.louvain(spark.createDataFrame(rows, "u long, v long, edge_weight double")).collect()}
    u, v, w = (np.array(x) for x in zip(*rows))
    label = local_louvain(u, v, w, w.sum())
    assert got.keys() == set(u.tolist()) | set(v.tolist())
    assert modularity(rows, got) >= share * modularity(rows, dict(enumerate(label.tolist())))
    sizes = {}
    for k, c in got.items():
        sizes.setdefault(c, []).append(k)
    order = sorted(sizes, key=lambda c: int(c[1:]))
    assert [f"c{k}" for k in range(len(order))] == order and order == sorted(order, key=lambda c: (-len(sizes[c]), min(sizes[c])))


def test_louvain_plans_no_group_in_python(spark):
    rows = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 2.0), ("y", "y", 1.0), ("q", "r", 0.0), ("r", "s", None)], "u string, v string, edge_weight double")
    made = communities.louvain(rows)
    assert {r["node_id"]: r["community"] for r in made.collect()} == {"a": "c0", "b": "c0", "c": "c0", "x": "c1", "y": "c1"}
    assert "Pandas" not in made._jdf.queryExecution().toString()
    assert communities.louvain(rows.where("u = 'x'")).collect() == [] and communities.louvain(rows.where("u = 'q'")).collect() == []


# --- batches


def plain_batches(sizes, most, rows):
    out, batch, used, count = [], 0, 0, 0
    for n in sizes:
        if count and (used + n > most or count >= rows):
            batch, used, count = batch + 1, 0, 0
        used, count = used + n, count + 1
        out.append(batch)
    return out


def test_fills_compose():
    for seed in range(300):
        g = np.random.default_rng(seed)
        most, rows = int(g.integers(1, 30)), int(g.integers(1, 9))
        sizes = g.integers(0, int(g.integers(2, 40)), int(g.integers(1, 40)))
        cuts = [0, *sorted(g.integers(0, len(sizes) + 1, 4).tolist()), len(sizes)]
        flows = [f.pack() if (f := Fill.of(sizes[a:b], most, rows)) else None for a, b in zip(cuts, cuts[1:])]
        whole = None
        for f in flows:
            whole = batching.then(whole, f, most, rows)
        state = one = np.zeros(3, np.int64).tobytes()
        for f in flows:
            state = batching.after(state, f, most, rows)
        assert state == batching.after(one, whole, most, rows) and np.frombuffer(state, np.int64)[2] == plain_batches(sizes, most, rows)[-1]


@pytest.mark.parametrize("chunk,fan,most,rows", [(3, 2, 50, 4), (7, 2, 20, 100), (batching.CHUNK, scan.FAN, 90, 5)])
def test_batches_run_over_blocks(spark, chunk, fan, most, rows):
    r = random.Random(chunk)
    sizes = [r.choice([0, 1, 5, 9, 30, 120]) for _ in range(200)]
    df = spark.createDataFrame([(f"{i:05d}", n) for i, n in enumerate(sizes)], "name string, n long").repartition(6)
    got = batching.batches(df, "name", F.col("n"), most, rows, chunk, fan).orderBy("name").collect()
    assert [x["batch"] for x in got] == plain_batches(sizes, most, rows) and [x["n_tokens"] for x in got] == sizes
    assert batching.batches(df.limit(0), "name", F.col("n"), most, rows).collect() == []


# --- greedy merging


def plain_merge(pairs, mesh):
    near, target = {}, {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    known = {k: m for k, m in mesh.items() if m is not None}
    for x in sorted(near):
        if x in target:
            continue
        group = sorted({x, *(y for y in near[x] if y not in target)})
        if len({known[y] for y in group if y in known}) > 1:
            group = [y for y in group if x in known and known.get(y) == known[x]]
        keep = next((y for y in group if y in known), x)
        target.update({y: keep for y in group if y != keep})
    return target


@pytest.mark.parametrize("seed", range(6))
def test_greedy_merge_is_the_sequential_rule(spark, seed):
    r = random.Random(seed)
    n = r.choice([12, 40])
    names = [f"{r.randrange(10**6):06d}" for _ in range(n)]
    pairs = sorted({tuple(sorted(r.sample(names, 2))) for _ in range(n * r.choice([1, 2]))})
    if seed == 5:  # a path in order: a round for each node
        pairs = list(zip(sorted(names), sorted(names)[1:]))[:9]
    mesh = {k: r.choice([None, "m1", "m2"]) if seed % 2 else r.choice([None, "m1"]) for k in names}
    made = resolve.greedy_merge(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(list(mesh.items()), "node_id string, mesh string"))
    assert {x["node_id"]: x["target"] for x in made.collect()} == plain_merge(pairs, mesh)


def test_chains_are_followed_and_cycles_told(spark):
    chain = [(k, k + 1) for k in range(37)] + [(100, 5)]
    got = {r["node_id"]: r["target"] for r in resolve.follow(spark.createDataFrame(chain, "node_id long, target long")).collect()}
    assert got == {k: 37 for k in [*range(37), 100]}
    with pytest.raises(ValueError, match="cycle"):
        resolve.follow(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node_id long, target long"))
