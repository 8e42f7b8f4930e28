"""Graph, stateful and calibration operators against plain Python, on random small graphs and on the test tables."""

import random
from collections import defaultdict, deque

import pytest

from weirflow.operators import graph as G
from weirflow.operators import motifs as M
from weirflow.operators import response as S
from weirflow.operators.boosting import Options, fit
from weirflow.operators.detect import stratified_folds
from weirflow.operators.ranks import counts_before, quantiles
from weirflow.schema import Params


def edges(seed, n=25, m=70, span=4000):
    r = random.Random(seed)
    out = []
    while len(out) < m:
        u, v = r.randrange(n), r.randrange(n)
        if u != v:
            out.append((len(out), u, v, r.randrange(5000, 90000), r.randrange(span)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "txn_id long, u long, v long, amount long, minute long")


def undirected(rows):
    return sorted({(min(u, v), max(u, v)) for _, u, v, _, _ in rows})


def neighbours(pairs):
    adj = defaultdict(set)
    for a, b in pairs:
        adj[a].add(b)
        adj[b].add(a)
    return adj


def test_k_core(spark):
    rows = edges(1)
    adj, core = {k: set(v) for k, v in neighbours(undirected(rows)).items()}, {}
    k = 0
    while adj:
        low = [x for x in adj if len(adj[x]) <= k]
        if not low:
            k += 1
            continue
        for x in low:
            core[x] = k
            for y in adj.pop(x):
                adj.get(y, set()).discard(x)
    assert {r.node: r.k_core for r in G.k_core(G.undirected(frame(spark, rows), "u", "v", "amount")).collect()} == core


def test_betweenness_from_all_sources(spark):
    pairs = undirected(edges(2, 14, 24))
    adj = neighbours(pairs)

    def shortest(s):
        dist, ways, q = {s: 0}, {s: 1}, deque([s])
        while q:
            x = q.popleft()
            for y in adj[x]:
                if y not in dist:
                    dist[y], ways[y] = dist[x] + 1, 0
                    q.append(y)
                if dist[y] == dist[x] + 1:
                    ways[y] += ways[x]
        return dist, ways

    far = {s: shortest(s) for s in adj}
    want = dict.fromkeys(adj, 0.0)
    for s in adj:
        for t in adj:
            if s != t and t in far[s][0]:
                for x in adj:
                    if x not in (s, t) and x in far[s][0] and t in far[x][0] and far[s][0][x] + far[x][0][t] == far[s][0][t]:
                        want[x] += far[s][1][x] * far[x][1][t] / far[s][1][t]
    n = len(adj)
    got = {r.node: r.betweenness for r in G.betweenness(spark.createDataFrame(pairs, "a long, b long"), sources=n).collect()}
    assert got == pytest.approx({x: v / ((n - 1) * (n - 2)) for x, v in want.items()})


def test_time_respecting_distance_has_no_limit(spark):
    chain = [(i, i + 1, i) for i in range(130)] + [(200, 5, 0), (5, 201, 1)]
    e = spark.createDataFrame(chain, "sender long, receiver long, t_first long")
    got = {r.node: r.time_resp_dist_to_seed for r in G.time_respecting_distance(e, spark.createDataFrame([(0,)], "account_id long")).collect()}
    # 5 is reached at minute 4, after the transfer from 5 to 201
    assert got == {i: i for i in range(131)}


def depth_by_loop(rows, gap):
    depth, seen, out = {}, {}, {}
    for i, u, v, _, t in sorted(rows, key=lambda x: (x[4], x[0])):
        reach = (depth.get(u, 0) if u in seen and t - seen[u] <= gap else 0) + 1
        if v not in seen or t - seen[v] > gap or reach > depth[v]:
            depth[v] = reach
        seen[v] = t
        out[i] = depth[v]
    return out


@pytest.mark.parametrize("largest", [10**6, 0])
@pytest.mark.parametrize("seed", [3, 4])
def test_chain_depth(spark, seed, largest):
    rows = edges(seed, 20, 120, 9000)
    rows += [(1000 + i, 50 + i, 51 + i, 9000, 100) for i in range(9)]  # one minute, ordered by id
    got = {r.txn_id: r.depth for r in M.depth_states(frame(spark, rows), largest=largest).collect()}
    assert got == depth_by_loop(rows, Params().chain_gap)


@pytest.mark.parametrize("length", [2, 3, 4])
def test_closed_walks(spark, length):
    rows = edges(5, 12, 60)
    step = defaultdict(set)
    for _, u, v, _, _ in rows:
        step[u].add(v)

    def walks(x, at, left):
        return int(at == x) if not left else sum(walks(x, y, left - 1) for y in step[at])

    want = {x: w for x in range(12) if (w := walks(x, x, length))}
    assert {r.node: r.walks for r in M.closed_walks(frame(spark, rows), length).collect()} == want


@pytest.mark.parametrize("block_on", ["sender", "receiver"])
def test_taint_replay(spark, block_on):
    r = random.Random(9)
    kinds = {i: ("mule" if i < 6 else "exit" if i < 8 else "other") for i in range(16)}
    mule, out = {i: int(k != "other") for i, k in kinds.items()}, {i: int(k == "exit") for i, k in kinds.items()}
    tx = []
    while len(tx) < 160:
        s, t = r.randrange(16), r.randrange(16)
        if s != t:
            tx.append((len(tx), r.randrange(2000), s, t, r.choice([700, 8000, 60000, 90000]), "P2P"))
    flags = {1: 900, 6: 1200}
    held, want = defaultdict(int), []
    for i, t, s, v, amt, _ in sorted(tx, key=lambda x: (x[1], x[0])):
        if amt >= 50_000 and not mule[s] and mule[v]:
            held[v] += amt
            want.append((i, "payout", amt))
        elif held[s] > 0:
            part = min(held[s], amt)
            held[s] -= part
            if flags.get(s if block_on == "sender" else v, 10**9) <= t:
                want.append((i, "blocked", part))
            elif out[v]:
                want.append((i, "cashed", part))
            elif mule[v]:
                held[v] += part
                want.append((i, "moved", part))
            else:
                want.append((i, "leaked", part))
    want += [(None, "still_in", x) for x in held.values() if x > 0]
    acc = spark.createDataFrame([(i, mule[i], out[i]) for i in kinds], "account_id long, is_mule int, is_exit int")
    flagged = spark.createDataFrame(list(flags.items()), "node long, flagged_minute long")
    got = S.taint_replay(spark.createDataFrame(tx, "txn_id long, minute long, sender long, receiver long, amount long, channel string"), acc, flagged, block_on=block_on)
    assert sorted(map(str, [(x.txn_id, x.outcome, x.moved) for x in got.collect()])) == sorted(map(str, want))
    assert S.replay_totals(got).first().unaccounted == 0


def test_calibration_equals_the_loop(spark):
    r = random.Random(11)
    p = Params(min_band=3, give_up=15)
    y = [int(r.random() < max(0.05, 1 - i / 60)) for i in range(120)]
    want, start = {}, 0
    for tier, need in zip(("freeze", "hold", "throttle"), p.tier_precision, strict=True):
        best = None
        for j in range(start + 1, len(y) + 1):
            if j - start < p.min_band:
                continue
            if sum(y[start:j]) / (j - start) >= need:
                best = j
            elif j - start > p.give_up:
                break
        want[tier] = (float(1000 - best + 1), start + 1, best) if best else (float("inf"), None, None)
        start = best or start
    scores = spark.createDataFrame([(i, float(1000 - i)) for i in range(120)], "account_id long, score double")
    acc = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "account_id long, is_mule int")
    assert {x.tier: (x.cut, x.first, x.last) for x in S.calibrate(scores, acc, p).collect()} == want


def test_flagged_at(spark):
    rows = [(1, 5, 0.5), (1, 9, 1.5), (1, 12, 2.0), (2, 3, 1.0), (3, 1, 9.0), (3, 0, 9.0)]
    got = S.flagged_at(spark.createDataFrame(rows, "node long, minute long, score double"), 1.0).collect()
    assert {r.node: r.flagged_minute for r in got} == {1: 9, 3: 0}


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_ranks_and_quantiles(spark, one_task):
    import numpy as np

    r = random.Random(13)
    v = [float(r.randrange(40)) for _ in range(301)]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "x double")
    assert {(c.value, c.n, c.before) for c in counts_before(df, "x", one_task=one_task).collect()} == {(x, v.count(x), sum(y < x for y in v)) for x in v}
    got = quantiles(df, {"a": ("x", 0.9), "b": ("x", 0.333)}, one_task=one_task).first()
    assert (got.a, got.b) == pytest.approx((np.quantile(v, 0.9), np.quantile(v, 0.333)))


def test_folds_are_stratified(spark):
    f = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "account_id long, is_mule int")
    n = defaultdict(int)
    for r in stratified_folds(f, 5, 0).join(f, "account_id").collect():
        n[r.is_mule, r.fold] += 1
    assert n == {**{(0, k): 36 for k in range(5)}, **{(1, k): 4 for k in range(5)}}


def test_boosted_trees_learn():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] * x[:, 1] > 0) & (x[:, 2] > -1)).astype(float)
    m = fit(x[:400], y[:400], Options(rounds=120))
    assert ((m.score(x[400:]) > 0.5) == (y[400:] == 1)).mean() > 0.88
    assert m.gains[3] < m.gains[:3].min()


def test_louvain_finds_planted_groups(spark):
    rows = [(10 * g + a, 10 * g + b, 10.0) for g in range(6) for a in range(8) for b in range(a)]
    rows += [(10 * g, 10 * ((g + 1) % 6), 1.0) for g in range(6)]
    got = {r.node: r.community for r in G.louvain(G.undirected(spark.createDataFrame(rows, "u long, v long, w double"))).collect()}
    assert len(got) == 48 and all(c == n // 10 * 10 for n, c in got.items())
