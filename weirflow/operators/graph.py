"""Graph operators on the pair-aggregated transfer graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.operators.adjacency import FAR, Adjacency, add_dependencies, adjacency, core_numbers, nearest_levels, numbered
from weirflow.operators.components import connected_components
from weirflow.operators.ranks import counts_before
from weirflow.schema import Params
from weirflow.storage import Scratch

#: Links that each worker may hold as arrays (12 bytes a link at most); a larger graph is walked by joins.
HELD_LINKS = 20_000_000
#: Rows (start, node) that a walk by joins keeps at a time; it takes its starts in as many turns as that needs.
ROWS_A_TURN = 50_000_000


def pair_edges(tx: DataFrame, p: Params = Params()) -> DataFrame:
    """sender, receiver, w, k, t_first, t_last of P2P pairs worth at least the floor."""
    g = tx.where("channel = 'P2P'").groupBy("sender", "receiver").agg(F.sum("amount").alias("w"), F.count("*").alias("k"), F.min("minute").alias("t_first"), F.max("minute").alias("t_last"))
    return g.where(F.col("w") >= p.pair_floor)


def undirected(e: DataFrame, u: str = "u", v: str = "v", w: str = "w") -> DataFrame:
    """a < b and summed weight; both directions add up."""
    return e.where(F.col(u) != F.col(v)).groupBy(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).agg(F.sum(w).alias("w"))


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.u", "x.v")


@dataclass(frozen=True)
class Undirected:
    """Stored edges (a, b), the numbers of their nodes, and the links as arrays in each worker, or None for those of too large a graph."""

    pairs: DataFrame
    numbers: DataFrame
    shared: Broadcast | None


def hold(e: DataFrame, held: int = HELD_LINKS) -> Undirected:
    """An undirected edge table (a, b), each pair once, made ready for several walks; ``shared.destroy()`` ends them."""
    s = Scratch(e.sparkSession, "graph")
    pairs = s.save(e.select("a", "b"), "edges")
    numbers = numbered(pairs, "a", "b", s)
    small = 2 * pairs.count() <= held
    return Undirected(pairs, numbers, e.sparkSession.sparkContext.broadcast(adjacency(_both_ways(pairs), numbers, s, "u", "v")) if small else None)


def k_core(e: DataFrame | Undirected, held: int = HELD_LINKS) -> DataFrame:
    """node, k_core of an undirected edge table (a, b): nodes of too low a degree are peeled until none is left.

    Up to ``held`` links one task peels them in arrays; beyond, each round is a job.
    """
    g = e if isinstance(e, Undirected) else hold(e.select("a", "b").distinct(), held)
    e, spark = g.pairs, g.pairs.sparkSession
    s = Scratch(spark, "k-core")
    left = g.pairs
    if g.shared is not None:
        shared = g.shared

        def run(it):
            import pandas as pd

            for _ in it:
                core = core_numbers(shared.value)
                yield pd.DataFrame({"i": range(len(core)), "k_core": core}).astype("int32")

        got = spark.range(1).coalesce(1).mapInPandas(run, "i int, k_core int")
        return s.save(g.numbers.join(got, "i").select("node", "k_core"), "core")
    parts, k = [], 1
    while not left.isEmpty():
        deg = s.save(left.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count(), "degrees")
        k = max(k, deg.agg(F.min("count")).first()[0] + 1)  # no node goes before the smallest degree is passed
        low = s.save(deg.where(F.col("count") < k).select("node"), "low")
        s.drop(deg)
        keep = left.join(low.withColumnRenamed("node", "a"), "a", "left_anti").join(low.withColumnRenamed("node", "b"), "b", "left_anti")
        after = s.save(keep, "edges")
        # nodes that vanish with their last edge have the same core number as those peeled
        gone = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(after.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_anti")
        parts.append(s.save(gone.withColumn("k_core", F.lit(k - 1)), "core"))
        s.drop(low, *([left] if left is not e else []))
        left = after
    out = e.select(F.col("a").alias("node"), F.lit(0).alias("k_core")).limit(0)
    for x in parts:
        out = out.unionByName(x)
    return out


def _turns(starts: DataFrame, nodes: int, s: Scratch, rows: int) -> list[DataFrame]:
    """The starts (node) in turns that keep at most ``rows`` rows (start, node), one start at least."""
    each = max(1, rows // max(nodes, 1))
    x = s.save(counts_before(starts, "node").select(F.col("value").alias("node"), F.floor(F.col("before") / each).alias("turn")), "turns")
    return [x.where(F.col("turn") == k).select("node") for k in range(-(-x.count() // each))]


def time_respecting_distance(e: DataFrame, seeds: DataFrame, tasks: int = 32, held: int = HELD_LINKS, rows: int = ROWS_A_TURN) -> DataFrame:
    """node, distance to the nearest seed along edges (sender, receiver, t_first) of non-decreasing first times.

    Breadth first from each seed; a node keeps the earliest arrival of its first level, so one seed's walk cannot stand
    for another's. Up to ``held`` edges tasks walk arrays and keep one seed's state at a time; beyond, levels are joined.
    """
    spark, s = e.sparkSession, Scratch(e.sparkSession, "bfs")
    edges = s.save(e.select("sender", "receiver", "t_first"), "edges")
    numbers = numbered(edges, "sender", "receiver", s)
    starts = s.save(numbers.join(seeds.select(F.col("account_id").alias("node")), "node", "left_semi"), "seeds")
    if edges.count() > held:
        got = _distance_by_joins(edges, starts, numbers.count(), s, rows)
    else:
        import numpy as np

        every = np.sort(np.array([r.i for r in starts.select("i").collect()], np.int64))  # no more than held links have ends
        shared = spark.sparkContext.broadcast((adjacency(edges, numbers, s, "sender", "receiver", "t_first"), every))

        def run(it):
            import pandas as pd

            mine = [pdf.i.to_numpy() for pdf in it]
            if sum(map(len, mine)):
                d = nearest_levels(shared.value[0], np.concatenate(mine).astype(np.int64), shared.value[1])
                at = np.flatnonzero(d < FAR)
                yield pd.DataFrame({"i": at, "d": d[at]}).astype("int32")

        near = starts.select("i").repartition(tasks, "i").mapInPandas(run, "i int, d int").groupBy("i").agg(F.min("d").alias("d"))
        got = numbers.join(near, "i")
    return got.groupBy("node").agg(F.min("d").cast("long").alias("time_resp_dist_to_seed"))


def _distance_by_joins(edges: DataFrame, starts: DataFrame, nodes: int, s: Scratch, rows: int) -> DataFrame:
    """node, d: the same walks by one join a level, the seeds in turns; a turn's rows go once its nearest distances are stored."""
    out = starts.select("node", F.lit(0).alias("d"))
    for turn in _turns(starts, nodes, s, rows):
        front = s.save(turn.select(F.col("node").alias("seed"), "node", F.lit(-1).cast("long").alias("t"), F.lit(0).alias("d")), "front")
        levels = [front]
        while not front.isEmpty():
            step = front.join(edges, F.col("node") == F.col("sender")).where("t_first >= t").groupBy("seed", F.col("receiver").alias("node")).agg(F.min("t_first").alias("t"))
            for x in levels:
                step = step.join(x.select("seed", "node"), ["seed", "node"], "left_anti")
            front = s.save(step.select("seed", "node", "t", F.lit(len(levels)).alias("d")), "front")
            levels.append(front)
        every = levels[0]
        for x in levels[1:]:
            every = every.unionByName(x)
        out = out.unionByName(s.save(every.groupBy("node").agg(F.min("d").alias("d")), "near"))
        s.drop(*levels)
    return out


def betweenness(e: DataFrame | Undirected, sources: int = 150, batches: int = 16, held: int = HELD_LINKS, rows: int = ROWS_A_TURN) -> DataFrame:
    """node, betweenness sampled from at most ``sources`` nodes (smallest hashes), sources in parallel.

    Up to ``held`` links tasks walk arrays; beyond, levels are joined, the sources in turns.
    """
    g = e if isinstance(e, Undirected) else hold(e, held)
    s, numbers = Scratch(g.pairs.sparkSession, "betweenness"), g.numbers
    n = numbers.count()
    k = min(sources, max(n, 1))
    picked = s.save(numbers.orderBy(F.xxhash64("node"), "node").limit(k), "sources")
    if g.shared is None:
        sums = _dependencies_by_joins(s.save(_both_ways(g.pairs), "links"), picked, n, s, rows)
    else:
        shared = g.shared

        def run(it):
            import numpy as np
            import pandas as pd

            total = np.zeros(shared.value.nodes)
            for pdf in it:
                add_dependencies(shared.value, pdf.i.tolist(), total)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"i": at, "part": total[at]}).astype({"i": "int32"})

        parts = s.save(picked.select("i").repartition(batches, "i").mapInPandas(run, "i int, part double"), "parts")
        sums = numbers.join(parts.groupBy("i").agg(F.sum("part").alias("p")), "i").select("node", "p")
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * n / k
    return numbers.select("node").join(sums, "node", "left").select("node", (F.coalesce("p", F.lit(0.0)) * scale).alias("betweenness"))


def _dependencies_by_joins(links: DataFrame, picked: DataFrame, nodes: int, s: Scratch, rows: int) -> DataFrame:
    """node, p: shares in the shortest paths from the picked nodes, by one join a level out and one back."""
    out, key = None, ["source", "node"]
    for turn in _turns(picked, nodes, s, rows):
        levels = [s.save(turn.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("sigma")), "level")]
        while not levels[-1].isEmpty():
            step = levels[-1].join(links, F.col("node") == F.col("u")).groupBy("source", F.col("v").alias("node")).agg(F.sum("sigma").alias("sigma"))
            for x in levels[-2:]:  # a link joins neighbouring levels
                step = step.join(x.select(*key), key, "left_anti")
            levels.append(s.save(step, "level"))
        beyond, shares = None, []
        for x in levels[-2:0:-1]:
            got = x.withColumn("p", F.lit(0.0))
            if beyond is not None:
                back = beyond.join(links, F.col("node") == F.col("u")).groupBy("source", F.col("v").alias("node")).agg(F.sum("x").alias("x"))
                got = x.join(back, key, "left").withColumn("p", F.col("sigma") * F.coalesce("x", F.lit(0.0)))
            beyond = s.save(got.select(*key, "p", ((1 + F.col("p")) / F.col("sigma")).alias("x")), "shares")
            shares.append(beyond)
        one = None
        for x in shares:
            one = x.select("node", "p") if one is None else one.unionByName(x.select("node", "p"))
        if one is not None:
            one = s.save(one.groupBy("node").agg(F.sum("p").alias("p")), "sums")
            out = one if out is None else out.unionByName(one)
        s.drop(*levels, *shares)
    if out is None:
        return picked.select("node", F.lit(0.0).alias("p"))
    return out.groupBy("node").agg(F.sum("p").alias("p"))


def louvain(e: DataFrame) -> DataFrame:
    """node, community (its smallest node): modularity moves and contraction, one task per connected component."""
    c = connected_components(e, "a", "b")
    x = e.join(c.withColumnRenamed("node", "a"), "a")

    def run(pdf):
        import pandas as pd

        adj: dict = {}
        for a, b, w in zip(pdf.a, pdf.b, pdf.w, strict=True):
            adj.setdefault(a, {})[b] = adj.setdefault(a, {}).get(b, 0) + float(w)
            adj.setdefault(b, {})[a] = adj.setdefault(b, {}).get(a, 0) + float(w)
        member = {v: v for v in adj}
        total = sum(sum(v.values()) for v in adj.values())
        while True:
            deg = {v: sum(n.values()) for v, n in adj.items()}
            com = {v: v for v in adj}
            tot, moved = dict(deg), False
            for _ in range(100):
                changed = False
                for v in sorted(adj):
                    own, gain = com[v], {}
                    tot[own] -= deg[v]
                    for y, w in adj[v].items():
                        if y != v:
                            gain[com[y]] = gain.get(com[y], 0.0) + w
                    best = max(sorted({own, *gain}), key=lambda q: (gain.get(q, 0.0) - tot[q] * deg[v] / total, q == own))
                    tot[best] += deg[v]
                    if best != own:
                        com[v], changed, moved = best, True, True
                if not changed:
                    break
            if not moved:
                break
            member = {v: com[m] for v, m in member.items()}
            small: dict = {}
            for v, n in adj.items():
                for y, w in n.items():
                    row = small.setdefault(com[v], {})
                    row[com[y]] = row.get(com[y], 0.0) + w
            adj = small
        first: dict = {}
        for v, m in member.items():
            first[m] = min(first.get(m, v), v)
        return pd.DataFrame({"node": list(member), "community": [first[m] for m in member.values()]}).astype("int64")

    return x.select("component", "a", "b", "w").groupBy("component").applyInPandas(run, "node long, community long")


def community_reciprocity(e: DataFrame, comm: DataFrame) -> DataFrame:
    """Per community: accounts and the share of its inner edges that are also paid back."""
    pairs = e.select("sender", "receiver")
    back = pairs.select(F.col("receiver").alias("sender"), F.col("sender").alias("receiver"), F.lit(1).alias("back"))
    x = pairs.join(back, ["sender", "receiver"], "left").join(comm.select(F.col("node").alias("sender"), F.col("community").alias("cu")), "sender").join(comm.select(F.col("node").alias("receiver"), F.col("community").alias("cv")), "receiver").where("cu = cv")
    r = x.groupBy(F.col("cu").alias("community")).agg(F.avg(F.coalesce("back", F.lit(0))).alias("comm_reciprocity"))
    return comm.groupBy("community").agg(F.count("*").alias("comm_size")).join(r, "community", "left").fillna(0.0)
