"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document
belongs to); the flow network has a node per pattern and per source:

    start -> pattern    capacity copies * size, one arc per repetition; the
                        k-th repetition of a word costs k - 1 (convex)
    pattern -> source   for each member source, no cost
    source -> end       capacity: the source's target

The cheapest flow is found on the driver over patterns and sources (refused
above ``max_patterns``), never over documents.  Each (pattern, source) flow is
then met by seeded documents: whole repetitions for all of them and a prefix in
seeded order for the rest, the last one in part, so what is taken equals the
flow.  Prefix sums are made over hash blocks; only the one block in which a
pattern's prefix ends is put in order.

Null texts have size 0 and take nothing; a null source is a source of its own,
last in order, and a null or empty array of sources is that source; repeated rows
count as documents of their own; an empty table gives an empty result.  Reruns
agree: order is a hash of seed and id.  ``keep`` columns whose names are the
operator's come back with ``_in`` added.
"""

from __future__ import annotations

from fractions import Fraction
from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.columns import carried
from weirflow.storage import Scratch, local_table


def targets(sizes: dict, weights: dict, budget: Fraction, cap: int = 2) -> dict:
    """Shares of ``budget`` by weight, none above ``cap`` times its source's size; the excess is reshared by weight."""
    out, open_, left = {}, [k for k in sizes if sizes[k] > 0], Fraction(min(budget, cap * sum(sizes.values())))
    out.update({k: Fraction(0) for k in sizes if not sizes[k] > 0})
    while open_:
        unit = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if unit * weights[k] > cap * sizes[k]]
        if not full:
            out.update({k: unit * weights[k] for k in open_})
            break
        for k in full:
            out[k] = Fraction(cap * sizes[k])
            left -= out[k]
        open_ = [k for k in open_ if k not in full]
    return out


def min_cost_flow(patterns: dict, quotas: dict, cap: int = 2) -> dict:
    """{(pattern, source): words}; patterns: size by frozenset of sources, quotas: words by source (integers).

    Successive shortest paths with the bottleneck's whole capacity at once.
    """
    graph: dict = {}

    def arc(u, v, room, cost):
        graph.setdefault(u, []).append([v, room, cost, len(graph.setdefault(v, []))])
        graph[v].append([u, 0, -cost, len(graph[u]) - 1])

    for p, size in patterns.items():
        for k in range(cap):
            arc("start", ("p", p), size, k)
        for q in p:
            arc(("p", p), ("s", q), cap * size, 0)
    for q, want in quotas.items():
        arc(("s", q), "end", want, 0)
    potential = dict.fromkeys(graph, 0)
    while "start" in graph:
        dist, back, heap, n = {"start": 0}, {}, [(0, 0, "start")], 0
        while heap:
            d, _, u = heappop(heap)
            if d > dist[u]:
                continue
            for i, (v, room, cost, _) in enumerate(graph[u]):
                nd = d + cost + potential[u] - potential[v]
                if room > 0 and nd < dist.get(v, nd + 1):
                    dist[v], back[v], n = nd, (u, i), n + 1
                    heappush(heap, (nd, n, v))
        if "end" not in dist:
            break
        for u in graph:
            potential[u] += dist.get(u, dist["end"])
        push, v = None, "end"
        while v != "start":
            u, i = back[v]
            push = graph[u][i][1] if push is None else min(push, graph[u][i][1])
            v = u
        v = "end"
        while v != "start":
            u, i = back[v]
            graph[u][i][1] -= push
            graph[v][graph[u][i][3]][1] += push
            v = u
    return {(u[1], a[0][1]): graph[a[0]][a[3]][1] for u in graph if u[0] == "p" for a in graph[u] if isinstance(a[0], tuple) and graph[a[0]][a[3]][1] > 0}


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text column, null counted as 0, without building the words.

    After other white space has become a space, a word begins at each change from space to anything else.
    """
    t = F.translate(F.concat(F.lit(" "), F.coalesce(text.cast("string"), F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_count(t, F.lit(" [^ ]")).cast("long")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), cap: int = 2, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    member_cols: list[str] | None = None, block_rows: int = 20_000, max_patterns: int = 100_000, keep: list[str] | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target, taken and ``keep`` columns.

    ``source_col`` is a string, or an array of the sources a document belongs to; its first in
    code-point order then is the one reported.  Sources weigh ``weights`` in turn, in code-point order, null last.
    """
    spark, s = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    inner, outer = carried(keep, ["doc_id", "size", "source_size", "target", "taken"])
    is_array = docs.schema[source_col].dataType.typeName() == "array"
    lone = F.array(F.lit(None).cast("string"))
    member = F.when(F.size(source_col) > 0, F.array_sort(F.array_distinct(source_col))).otherwise(lone) if is_array else F.array(F.col(source_col).cast("string"))
    seeded = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    sized = s.save(docs.select(F.col(id_col).alias("doc_id"), member.alias("_m"), word_count(F.col(text_col)).alias("size"), seeded.alias("_o"), *inner), "sizes")
    rows = sized.groupBy("_m").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns; merge sources or raise max_patterns")
    patterns = {tuple(r._m): r.size for r in rows}
    total_rows = sum(r.n for r in rows)
    names = sorted({q for p in patterns for q in p}, key=lambda q: (q is None, (q or "").encode("utf-32-be")))
    sizes = {q: sum(n for p, n in patterns.items() if q in p) for q in names}
    weigh = {q: weights[i % len(weights)] for i, q in enumerate(names)}
    goal = targets(sizes, weigh, share * sum(patterns.values()), cap)
    flow = min_cost_flow({p: n for p, n in patterns.items() if n}, {q: int(goal[q]) for q in names}, cap)
    # what each pattern gives in all
    given = dict.fromkeys(patterns, 0)
    for (p, _), x in flow.items():
        given[p] += x
    plan = []
    for p, n in patterns.items():
        whole, rest = divmod(given[p], n) if n else (0, 0)
        lead = p[0] if p else None
        plan.append((list(p), whole, rest, sizes.get(lead, 0), float(goal.get(lead, 0))))
    plan_df = local_table(spark, plan or [([None], 0, 0, 0, 0.0)], "p array<string>, whole long, rest long, source_size long, target double")
    planned = sized.withColumn("_k", F.to_json("_m", {"ignoreNullFields": "false"})).join(
        F.broadcast(plan_df.select(F.to_json("p", {"ignoreNullFields": "false"}).alias("_k"), "whole", "rest", "source_size", "target").dropDuplicates(["_k"])), "_k"  # bounded by max_patterns
    )
    digits = max(1, (max(1, total_rows // block_rows)).bit_length() // 4 + 1)
    planned = planned.withColumn("_b", F.substring("_o", 1, digits))
    blocks = planned.groupBy("_k", "_b").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    starts = F.coalesce(F.sum("words").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = s.save(blocks.withColumn("start", starts).where("start < rest and start + words >= rest").select(F.col("_k").alias("_ek"), F.col("_b").alias("_eb"), "start"), "ends")
    # per pattern the block in which its prefix ends; there is none where nothing is left over whole repetitions
    joined = planned.join(F.broadcast(ends), F.col("_k") == F.col("_ek"), "left")  # bounded by max_patterns
    inside = joined.where(F.col("_b") == F.col("_eb"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("_k", "_b").orderBy("_o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    partial = inside.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - before)))
    outside = joined.where("_eb is null or _b <> _eb").withColumn("part", F.when(F.col("_b") < F.col("_eb"), F.col("size")).otherwise(0))
    both = partial.unionByName(outside)
    return both.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"), *outer)
