"""The flow-through subgraph: transfers forwarded soon, and the hops that end a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.operators.ledger import by_account, ledger, outflow
from weirflow.schema import Params
from weirflow.storage import Scratch

EDGE = ["txn_id", "u", "v", "amount", "minute"]


def large_transfers(tx: DataFrame, p: Params = Params()) -> DataFrame:
    """P2P transfers at or above the floor, with ``flow``: whether the receiver sends on ``flow_ratio`` within the window.

    The ledger leg carries the counterparty, so one window over one scan gives whole edges.
    """
    num, den = p.flow_ratio
    led = ledger(tx.where("channel = 'P2P'")).withColumn("moved", outflow(p.flow_window)).where((F.col("sgn") == 1) & (F.col("amount") >= p.flow_floor))
    return led.select("txn_id", F.col("other").alias("u"), F.col("acct").alias("v"), "amount", "minute", (den * F.col("moved") >= num * F.col("amount")).alias("flow"))


def flow_edges(tx: DataFrame, p: Params = Params()) -> DataFrame:
    return large_transfers(tx, p).where("flow").select(*EDGE)


def _terminal(large: DataFrame, p: Params) -> DataFrame:
    flow = large.where("flow")
    nodes = flow.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    cand = large.where("not flow").join(nodes.withColumnRenamed("node", "u"), "u", "left_semi").join(nodes.withColumnRenamed("node", "v"), "v", "left_anti")
    # credits into an account and its candidate transfers on one line: the last credit is a range-frame maximum
    none = F.lit(None).cast("long")
    marks = flow.select(F.col("v").alias("acct"), "minute", F.col("minute").alias("credit"), none.alias("txn_id"), none.alias("v"), none.alias("amount"))
    line = marks.unionByName(cand.select(F.col("u").alias("acct"), "minute", none.alias("credit"), "txn_id", "v", "amount"))
    hit = line.withColumn("last", F.max("credit").over(by_account(-p.flow_window, 0))).where("txn_id is not null and last is not null")
    return hit.select("txn_id", F.col("acct").alias("u"), "v", "amount", "minute")


def _stored(tx: DataFrame, p: Params) -> DataFrame:
    return Scratch(tx.sparkSession, "large").save(large_transfers(tx, p), "large")  # read four times below


def terminal_edges(tx: DataFrame, p: Params = Params()) -> DataFrame:
    """Onward transfers out of the graph within the window after a flow credit into their sender."""
    return _terminal(_stored(tx, p), p)


def laundering_edges(tx: DataFrame, p: Params = Params()) -> DataFrame:
    large = _stored(tx, p)
    return large.where("flow").select(*EDGE).withColumn("kind", F.lit("flow")).unionByName(_terminal(large, p).withColumn("kind", F.lit("terminal")))
