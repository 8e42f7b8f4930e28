"""Graded response: stream state, calibrated tiers and the replay of funds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.components import connected_components
from weirflow.operators.motifs import depth_states
from weirflow.schema import CONFOUNDERS, TIERS, Params


def running_state(e: DataFrame) -> DataFrame:
    """txn_id, node, minute, in_deg, in_val of the receiver after each edge, in (minute, txn_id) order."""
    w = Window.partitionBy("v").orderBy("minute", "txn_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("txn_id", F.col("v").alias("node"), "minute", F.count("*").over(w).alias("in_deg"), F.sum("amount").over(w).alias("in_val"))


def stream_history(e: DataFrame, p: Params = Params()) -> DataFrame:
    """Running state with the chain depth at each edge."""
    return running_state(e).join(depth_states(e, p).select("txn_id", "depth"), "txn_id")


def final_state(hist: DataFrame) -> DataFrame:
    """Per node the last depth (and the best), in_deg and in_val."""
    last = F.max_by(F.struct("depth", "in_deg", "in_val"), F.struct("minute", "txn_id"))
    return hist.groupBy("node").agg(last.alias("l"), F.max("depth").alias("best_depth")).select("node", "l.depth", "best_depth", "l.in_deg", "l.in_val")


def stream_scores(hist: DataFrame, devices: DataFrame, reference: DataFrame) -> DataFrame:
    """hist with ``score``; mean and deviation come from ``reference`` (fit it on a past window) and from ``devices``."""
    ref = reference.agg(*[x for c in ("depth", "in_deg") for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))], F.avg(F.log1p("in_val")).alias("m_val"), F.stddev_samp(F.log1p("in_val")).alias("s_val"))
    dev = devices.agg(F.avg("device_shared_by").alias("m_dev"), F.stddev_pop("device_shared_by").alias("s_dev"))
    x = hist.join(devices.withColumnRenamed("account_id", "node"), "node", "left").crossJoin(F.broadcast(ref)).crossJoin(F.broadcast(dev))  # one row each

    def z(v, n):
        return (v - F.col(f"m_{n}")) / (F.coalesce(f"s_{n}", F.lit(0.0)) + 1e-9)

    score = z(F.col("depth"), "depth") + 0.6 * z(F.log1p("in_val"), "val") + 0.4 * z(F.col("in_deg"), "in_deg") + 0.5 * z(F.coalesce("device_shared_by", F.lit(0)), "dev")
    return x.select(*hist.columns, score.alias("score"))


def running_peak(rows: DataFrame, node: str, value: str) -> DataFrame:
    """txn_id, node, minute, peak: the greatest value of the node up to that minute."""
    w = Window.partitionBy(node).orderBy("minute").rangeBetween(Window.unboundedPreceding, 0)
    return rows.select("txn_id", F.col(node).alias("node"), "minute", F.max(value).over(w).alias("peak"))


def flagged_at(scored: DataFrame, cut: float) -> DataFrame:
    """node, first minute at which its score exceeded the cut."""
    return scored.where(F.col("score") > cut).groupBy("node").agg(F.min("minute").alias("flagged_minute"))


def calibrate(scores: DataFrame, accounts: DataFrame, p: Params = Params()) -> DataFrame:
    """tier, cut, first, last (ranks): each tier's longest band from where the stronger one ended that keeps its precision.

    A band has ``min_band`` ranks at least; the search stops at the first failing band longer than ``give_up``.
    Cumulative hits come from blocks of ranks, so no task holds the ranking.  An impossible tier has the cut +inf.
    """
    spark = scores.sparkSession
    x = scores.join(accounts.select("account_id", "is_mule"), "account_id")
    # ranks by a range partitioning: rows per partition counted, then numbered within
    s = x.repartitionByRange(F.desc("score"), F.asc("account_id")).sortWithinPartitions(F.desc("score"), F.asc("account_id")).withColumn("_p", F.spark_partition_id())
    from weirflow.storage import Scratch

    s = Scratch(spark, "calibrate").save(s, "ranked")
    w = Window.partitionBy("_p").orderBy(F.desc("score"), F.asc("account_id"))
    local = s.withColumn("_i", F.row_number().over(w)).withColumn("_h", F.sum("is_mule").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = s.groupBy("_p").agg(F.count("*").alias("n"), F.sum("is_mule").alias("h"))
    before = parts.select(F.col("_p").alias("_q"), *[F.coalesce(F.sum(c).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"b_{c}") for c in ("n", "h")])
    ranked = local.join(F.broadcast(before), F.col("_p") == F.col("_q")).select((F.col("_i") + F.col("b_n")).alias("j"), (F.col("_h") + F.col("b_h")).alias("c"), "score").cache()  # one row per partition
    rows, start, base = [], 0, 0
    for tier, need in zip(TIERS, p.tier_precision, strict=True):
        span = F.col("j") - start
        band = ranked.where(span >= p.min_band).withColumn("ok", (F.col("c") - base) / span >= need)
        stop = band.where(~F.col("ok") & (span > p.give_up)).agg(F.min("j").alias("j")).first().j
        best = band.where("ok").where(F.col("j") < stop if stop is not None else F.lit(True)).orderBy(F.desc("j")).limit(1).collect()
        rows.append((tier, float(best[0].score) if best else float("inf"), start + 1 if best else None, best[0].j if best else None))
        if best:
            start, base = best[0].j, best[0].c
    ranked.unpersist()
    return spark.createDataFrame(rows, "tier string, cut double, first long, last long")


def assign(scores: DataFrame, cuts: DataFrame) -> DataFrame:
    """account_id, score, tier: the strongest tier whose cut the score exceeds (strictly), else none."""
    c = {r.tier: r.cut for r in cuts.collect()}  # three rows
    tier = F.lit("none")
    for t in reversed(TIERS):
        tier = F.when(F.col("score") > c.get(t, float("inf")), t).otherwise(tier)
    return scores.select("account_id", "score", tier.alias("tier"))


def tier_report(tiered: DataFrame, accounts: DataFrame) -> DataFrame:
    x = tiered.where(F.col("tier") != "none").join(accounts.select("account_id", "is_mule", "account_type"), "account_id")
    return x.groupBy("tier").agg(
        F.count("*").alias("accounts"), F.sum("is_mule").alias("mules"), F.round(F.avg("is_mule"), 3).alias("precision"), F.sum(1 - F.col("is_mule")).alias("innocent"), F.count_if(F.col("account_type").isin(*CONFOUNDERS)).alias("confounders")
    )


def taint_replay(tx: DataFrame, accounts: DataFrame, flagged: DataFrame, p: Params = Params(), block_on: str = "sender") -> DataFrame:
    """txn_id, outcome, moved: what each transfer does with tainted funds, in (minute, txn_id) order.

    Outcomes: payout, blocked, cashed (to an exit), leaked (to an ordinary account), moved (to a mule).
    Funds cross accounts, so the unit of work is a component of mule-touching transfers.
    """
    a = accounts.select("account_id", "is_mule", "is_exit")
    x = tx.join(a.select(F.col("account_id").alias("sender"), F.col("is_mule").alias("s_mule")), "sender", "left").join(a.select(F.col("account_id").alias("receiver"), F.col("is_mule").alias("r_mule"), F.col("is_exit").alias("r_exit")), "receiver", "left").fillna(0, ["s_mule", "r_mule", "r_exit"])
    x = x.join(flagged.select(F.col("node").alias("sender"), F.col("flagged_minute").alias("s_flag")), "sender", "left").join(flagged.select(F.col("node").alias("receiver"), F.col("flagged_minute").alias("r_flag")), "receiver", "left")
    # only mules hold taint: a transfer matters if a mule sends it or is paid out to; components join through mules alone
    x = x.where((F.col("s_mule") == 1) | ((F.col("r_mule") == 1) & (F.col("amount") >= p.payout)))
    comp = connected_components(x.where("s_mule = 1 and r_mule = 1").select(F.col("sender").alias("u"), F.col("receiver").alias("v")))
    x = x.withColumn("mule", F.when(F.col("s_mule") == 1, F.col("sender")).otherwise(F.col("receiver"))).join(comp.withColumnRenamed("node", "mule"), "mule", "left").withColumn("component", F.coalesce("component", "mule"))
    flag = "s_flag" if block_on == "sender" else "r_flag"

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["minute", "txn_id"])
        held, out = {}, []
        for i, t, s, r, amt, sm, rm, rx, f in zip(pdf.txn_id, pdf.minute, pdf.sender, pdf.receiver, pdf.amount, pdf.s_mule, pdf.r_mule, pdf.r_exit, pdf[flag], strict=True):
            if amt >= p.payout and not sm and rm:
                held[r] = held.get(r, 0) + amt
                out.append((i, r, "payout", amt))
            elif held.get(s, 0) > 0:
                part = min(held[s], amt)
                held[s] -= part
                if f == f and f is not None and f <= t:
                    out.append((i, s, "blocked", part))
                elif rx:
                    out.append((i, r, "cashed", part))
                elif rm:
                    held[r] = held.get(r, 0) + part
                    out.append((i, r, "moved", part))
                else:
                    out.append((i, r, "leaked", part))
        out += [(None, n, "still_in", v) for n, v in sorted(held.items()) if v > 0]
        return pd.DataFrame(out, columns=["txn_id", "node", "outcome", "moved"]).astype({"txn_id": "Int64", "node": "int64", "moved": "int64"})

    cols = ["component", "txn_id", "minute", "sender", "receiver", "amount", "s_mule", "r_mule", "r_exit", flag]
    return x.select(*cols).groupBy("component").applyInPandas(run, "txn_id long, node long, outcome string, moved long")


def replay_totals(replay: DataFrame) -> DataFrame:
    """One row: payout, blocked, cashed, leaked, still_in, unaccounted (0 if money is conserved)."""
    def total(k):
        return F.coalesce(F.sum(F.when(F.col("outcome") == k, F.col("moved"))), F.lit(0))

    names = ("payout", "blocked", "cashed", "leaked", "still_in")
    t = replay.agg(*[total(k).alias(k) for k in names])
    return t.withColumn("unaccounted", F.col("payout") - F.col("blocked") - F.col("cashed") - F.col("leaked") - F.col("still_in"))
