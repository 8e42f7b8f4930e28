"""Motifs of the flow-through subgraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.components import connected_components
from weirflow.schema import Params
from weirflow.storage import Scratch


def degrees(e: DataFrame) -> DataFrame:
    o = e.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("lg_out_deg"), F.countDistinct("v").alias("lg_out_uniq"))
    i = e.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("lg_in_deg"), F.countDistinct("u").alias("lg_in_uniq"))
    return o.join(i, "node", "full_outer").fillna(0)


def star(e: DataFrame, p: Params = Params()) -> DataFrame:
    """Most distinct targets of a sender within the window from one of its transfers; 0 for a single transfer."""
    w = Window.partitionBy("u").orderBy("minute").rangeBetween(0, p.star_window)
    s = e.select("u", F.size(F.collect_set("v").over(w)).alias("n")).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("c"), F.max("n").alias("n"))
    return s.select("node", F.when(F.col("c") < 2, 0).otherwise(F.col("n")).cast("long").alias("motif_star_out"))


def closed_walks(e: DataFrame, length: int) -> DataFrame:
    """node, walks: closed walks of 2, 3 or 4 steps on distinct edges.

    Paths of up to half the length are aggregated to (start, end, count) before they meet, so hubs
    multiply counts and not rows.
    """
    a = e.select("u", "v").distinct()
    two = a.select("u", F.col("v").alias("m")).join(a.select(F.col("u").alias("m"), "v"), "m").groupBy("u", "v").agg(F.count("*").alias("n"))
    if length == 2:
        return two.where("u = v").select(F.col("u").alias("node"), F.col("n").alias("walks"))
    back = a.withColumn("k", F.lit(1)) if length == 3 else two.withColumnRenamed("n", "k")
    back = back.select(F.col("u").alias("v"), F.col("v").alias("u"), "k")
    return two.join(back, ["u", "v"]).groupBy(F.col("u").alias("node")).agg(F.sum(F.col("n") * F.col("k")).alias("walks"))


def smurf(e: DataFrame, p: Params = Params()) -> DataFrame:
    band = F.col("amount").between(*p.smurf)
    i = e.groupBy(F.col("v").alias("node")).agg(F.count_if(band).alias("motif_smurf_in"), F.count("*").alias("n"))
    o = e.groupBy(F.col("u").alias("node")).agg(F.count_if(band).alias("motif_smurf_out"))
    return i.join(o, "node", "full_outer").fillna(0).select("node", "motif_smurf_in", "motif_smurf_out", (F.col("motif_smurf_in") / F.greatest("n", F.lit(1))).alias("motif_smurf_share"))


def values(e: DataFrame) -> DataFrame:
    i = e.groupBy(F.col("v").alias("node")).agg(F.sum("amount").alias("lg_val_in"))
    return i.join(e.groupBy(F.col("u").alias("node")).agg(F.sum("amount").alias("lg_val_out")), "node", "full_outer").fillna(0)


def bursts(e: DataFrame, gap: int) -> DataFrame:
    """Edges with a ``part``: component of the graph, split where it is quiet for longer than the gap (no state crosses it)."""
    c = connected_components(e)
    x = e.join(c.withColumnRenamed("node", "u"), "u")
    new = (F.col("minute") - F.lag("minute").over(Window.partitionBy("component").orderBy("minute", "txn_id")) > gap).cast("int")
    x = x.withColumn("new", F.coalesce(new, F.lit(0)))
    return x.withColumn("part", F.sum("new").over(Window.partitionBy("component").orderBy("minute", "txn_id").rowsBetween(Window.unboundedPreceding, 0)))


def _depth_by_levels(e: DataFrame, gap: int) -> DataFrame:
    """txn_id, node, minute, depth without a task per component, in as many rounds as the longest chain has steps.

    A receiver's depth after an edge is the largest reach so far in its session (receipts no further apart than the
    gap), and an edge's reach is one more than its sender's depth at the sender's last receipt within the gap.  Neither
    sessions nor last receipts depend on depths, so depths grow from one to their fixpoint by one join a round.
    """
    s = Scratch(e.sparkSession, "depth")
    order = Window.partitionBy("node").orderBy("minute", "txn_id")
    new = F.coalesce((F.col("minute") - F.lag("minute").over(order) > gap).cast("int"), F.lit(0))
    got = e.select("txn_id", F.col("v").alias("node"), "u", "minute").withColumn("new", new).withColumn("session", F.sum("new").over(order))
    line = got.select("node", "minute", "txn_id", F.col("txn_id").alias("got")).unionByName(e.select(F.col("u").alias("node"), "minute", "txn_id", F.lit(None).cast("long").alias("got")))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("got").isNotNull(), F.struct("minute", "got")), True).over(upto)
    before = line.withColumn("last", last).where(F.col("got").isNull() & (F.col("minute") - F.col("last.minute") <= gap)).select("txn_id", F.col("last.got").alias("before"))
    events = s.save(got.select("txn_id", "node", "session", "minute").join(before, "txn_id", "left"), "events")
    running = Window.partitionBy("node", "session").orderBy("minute", "txn_id").rowsBetween(Window.unboundedPreceding, 0)
    state, total = s.save(events.withColumn("depth", F.lit(1).cast("long")), "state"), None
    while True:
        above = state.select(F.col("txn_id").alias("before"), F.col("depth").alias("up"))
        reach = state.drop("depth").join(above, "before", "left").withColumn("reach", F.coalesce(F.col("up") + 1, F.lit(1)))
        after = s.save(reach.withColumn("depth", F.max("reach").over(running)).select(*state.columns), "state")
        now = after.agg(F.sum("depth")).first()[0]
        s.drop(state)
        if now == total:
            return after.select("txn_id", "node", "minute", "depth")
        state, total = after, now


def depth_states(e: DataFrame, p: Params = Params(), largest: int = 200_000) -> DataFrame:
    """txn_id, node (receiver), minute, depth after each edge, in (minute, txn_id) order.

    One task per component and burst of up to ``largest`` edges; larger ones go level by level.
    """
    gap, s = p.chain_gap, Scratch(e.sparkSession, "depth-states")

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["minute", "txn_id"])
        depth, seen, out = {}, {}, []
        for i, u, v, t in zip(pdf.txn_id, pdf.u, pdf.v, pdf.minute, strict=True):
            reach = (depth.get(u, 0) if u in seen and t - seen[u] <= gap else 0) + 1
            if v not in seen or t - seen[v] > gap or reach > depth[v]:
                depth[v] = reach
            seen[v] = t
            out.append((i, v, t, depth[v]))
        return pd.DataFrame(out, columns=["txn_id", "node", "minute", "depth"])

    parts = s.save(bursts(e, gap).select("component", "part", "txn_id", "u", "v", "minute"), "bursts")
    big = s.save(parts.groupBy("component", "part").count().where(F.col("count") > largest).select("component", "part"), "big")
    small = parts.join(big, ["component", "part"], "left_anti").groupBy("component", "part").applyInPandas(run, "txn_id long, node long, minute long, depth long")
    return small if big.isEmpty() else small.unionByName(_depth_by_levels(parts.join(big, ["component", "part"], "left_semi"), gap))


def chain_depth(e: DataFrame, p: Params = Params()) -> DataFrame:
    return depth_states(e, p).groupBy("node").agg(F.max("depth").alias("motif_chain_depth"))


def motif_features(e: DataFrame, accounts: DataFrame, p: Params = Params()) -> DataFrame:
    out = accounts.select(F.col("account_id").alias("node"))
    for f in (degrees(e), star(e, p), chain_depth(e, p), *[closed_walks(e, n).withColumnRenamed("walks", f"motif_cycle{n}") for n in (2, 3, 4)], smurf(e, p), values(e)):
        out = out.join(f, "node", "left")
    return out.fillna(0).withColumnRenamed("node", "account_id")
