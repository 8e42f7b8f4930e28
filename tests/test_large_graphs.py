"""Graph steps beyond what a worker holds, and in arrays, against plain Python."""

import random
from collections import defaultdict, deque

import numpy as np
import pytest

from weirflow.operators import adjacency as A
from weirflow.operators import graph as G
from weirflow.plans import catalog


def random_pairs(seed, n, m):
    r = random.Random(seed)
    return sorted({(min(p), max(p)) for p in ((r.randrange(n) * 3 + 7, r.randrange(n) * 3 + 7) for _ in range(m)) if p[0] != p[1]})


def around(pairs):
    adj = defaultdict(set)
    for a, b in pairs:
        adj[a].add(b)
        adj[b].add(a)
    return adj


def brandes(adj, sources):
    out = dict.fromkeys(adj, 0.0)
    for s in sources:
        order, before, sigma, dist, queue = [], defaultdict(list), defaultdict(float, {s: 1.0}), {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            order.append(x)
            for y in adj[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    queue.append(y)
                if dist[y] == dist[x] + 1:
                    sigma[y] += sigma[x]
                    before[y].append(x)
        delta = defaultdict(float)
        for y in reversed(order):
            for x in before[y]:
                delta[x] += sigma[x] / sigma[y] * (1 + delta[y])
            if y != s:
                out[y] += delta[y]
    return out


@pytest.mark.parametrize("held,rows", [(10**6, 1), (0, 10**6), (0, 150)])
def test_betweenness_has_no_largest_graph(spark, held, rows):
    pairs = random_pairs(1, 14, 22) + [(1000 + i, 1001 + i) for i in range(5)]  # a second component, a path
    adj = around(pairs)
    n = len(adj)
    got = G.betweenness(spark.createDataFrame(pairs, "a long, b long"), sources=n, held=held, rows=rows).collect()
    assert {r.node: r.betweenness for r in got} == pytest.approx({x: v / ((n - 1) * (n - 2)) for x, v in brandes(adj, adj).items()})


def test_betweenness_samples_the_same_sources_either_way(spark):
    e = spark.createDataFrame(random_pairs(2, 20, 40), "a long, b long")
    one, other = ({r.node: r.betweenness for r in G.betweenness(e, sources=5, held=h).collect()} for h in (10**6, 0))
    assert one == pytest.approx(other) and any(one.values())


def test_more_edges_than_were_once_held(spark):
    n = 2_100_000  # leaves of one hub
    from pyspark.sql import functions as F

    hub = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = G.betweenness(hub, sources=3).where("betweenness > 0").collect()
    k = n + 1  # each sampled leaf sends its n - 1 shortest paths to other leaves over the hub
    assert [r.node for r in got] == [0] and got[0].betweenness == pytest.approx(k / (k - 2) / (k - 1) * (n - 1), rel=1e-9)


@pytest.mark.parametrize("held", [10**6, 0])
def test_core_numbers(spark, held):
    pairs = random_pairs(3, 30, 110) + [(1000 + i, 1001 + i) for i in range(4)]
    adj, core, k = {x: set(v) for x, v in around(pairs).items()}, {}, 0
    while adj:
        low = [x for x in adj if len(adj[x]) <= k]
        k += not low
        for x in low:
            core[x] = k
            for y in adj.pop(x):
                adj.get(y, set()).discard(x)
    assert {r.node: r.k_core for r in G.k_core(spark.createDataFrame(pairs, "a long, b long"), held=held).collect()} == core


def test_network_features_of_a_graph_too_large_to_hold(spark, monkeypatch):
    def rows():
        f = catalog.network_features(spark, "/root/testdata/sf0.001")
        return sorted((r.account_id, r.k_core, round(r.betweenness, 9), r.comm_score) for r in f.collect())

    held, whole = rows(), G.hold
    monkeypatch.setattr(G, "hold", lambda e: whole(e, 0))
    assert rows() == held and any(r[1] for r in held)
    assert catalog.QUERIES["iso_score"](spark, "/root/testdata/sf0.001").count() == len(held)


def first_levels(edges, seeds):
    """The definition: from each seed a node keeps the earliest arrival of its first level."""
    out, steps = {}, defaultdict(list)
    for u, v, t in edges:
        steps[u].append((v, t))
    for s in seeds & {x for u, v, _ in edges for x in (u, v)}:
        dist, front = {s: 0}, {s: -1}
        while front:
            after = {}
            for u, tu in front.items():
                for v, t in steps[u]:
                    if t >= tu and v not in dist:
                        after[v] = min(t, after.get(v, t))
            dist.update(dict.fromkeys(after, len(set(dist.values()))))
            front = after
        for v, d in dist.items():
            out[v] = min(d, out.get(v, d))
    return out


@pytest.mark.parametrize("held,rows", [(10**6, 1), (0, 10**6), (0, 60)])
def test_distance_to_the_nearest_of_many_seeds(spark, held, rows):
    r = random.Random(4)
    pairs = {(r.randrange(40) * 5, r.randrange(40) * 5): r.randrange(300) for _ in range(130)}
    edges = [(u, v, t) for (u, v), t in pairs.items() if u != v] + [(900 + i, 901 + i, i) for i in range(12)]
    seeds = {0, 5, 10, 900, 12345}
    got = G.time_respecting_distance(spark.createDataFrame(edges, "sender long, receiver long, t_first long"), spark.createDataFrame([(x,) for x in seeds], "account_id long"), tasks=2, held=held, rows=rows).collect()
    assert {x.node: x.time_resp_dist_to_seed for x in got} == first_levels(edges, seeds)


def test_distance_stores_no_row_per_seed_and_node(spark, monkeypatch):
    saved, whole, n = [], G.Scratch.save, 40

    def save(self, df, name):
        out = whole(self, df, name)
        saved.append(out.count())
        return out

    monkeypatch.setattr(G.Scratch, "save", save)
    e = spark.createDataFrame([(i, i + 1, i) for i in range(n)], "sender long, receiver long, t_first long")
    got = G.time_respecting_distance(e, spark.range(n).withColumnRenamed("id", "account_id")).collect()
    assert {r.node: r.time_resp_dist_to_seed for r in got} == {**dict.fromkeys(range(n), 0), n: 1}
    assert sum(saved) < 8 * n  # one seed's walk alone has up to n rows


def test_walks_by_small_pieces_give_the_same(monkeypatch):
    r = random.Random(5)
    for _ in range(60):
        n = r.randrange(4, 30)
        edges = [(u, v, t) for (u, v), t in {(r.randrange(n), r.randrange(n)): r.randrange(-3, 40) for _ in range(4 * n)}.items() if u != v]
        if not edges:
            continue
        edges.sort(key=lambda x: (x[0], x[2]))
        u, v, t = (np.array(x, np.int64) for x in zip(*edges, strict=True))
        span = int(t.max() - t.min()) + 2
        a = A.Adjacency(np.r_[0, np.bincount(u, minlength=n).cumsum()], v.astype(np.int32), u * span + t - t.min(), int(t.min()), span)
        seeds = sorted({r.randrange(n) for _ in range(3)})
        monkeypatch.setattr(A, "PIECE", r.choice([1, 3, 1 << 20]))
        got = A.nearest_levels(a, np.array(seeds), np.array(seeds))
        want = first_levels(edges + [(s, s, 10**6) for s in seeds], set(seeds))
        assert {x: int(d) for x, d in enumerate(got) if d < A.FAR} == want
