"""The two-legged ledger and its range-frame windows: one shuffle by account serves all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.schema import Params


def ledger(tx: DataFrame) -> DataFrame:
    """acct, other, minute, txn_id, sgn (+1 credit, -1 debit), amount, channel; one scan of the transfers."""
    legs = F.array(F.struct(F.col("receiver").alias("acct"), F.col("sender").alias("other"), F.lit(1).alias("sgn")), F.struct(F.col("sender").alias("acct"), F.col("receiver").alias("other"), F.lit(-1).alias("sgn")))
    return tx.select(F.explode(legs).alias("leg"), "minute", "txn_id", "amount", "channel").select("leg.acct", "leg.other", "minute", "txn_id", "leg.sgn", "amount", "channel")


def by_account(lo: int, hi: int):
    return Window.partitionBy("acct").orderBy("minute").rangeBetween(lo, hi)


def debit(c: Column) -> Column:
    return F.when(F.col("sgn") == -1, c)


def credit(c: Column) -> Column:
    return F.when(F.col("sgn") == 1, c)


def next_debit() -> Column:
    """Minute of the next debit at or after the row, as a running minimum from the end."""
    return F.min(debit(F.col("minute"))).over(Window.partitionBy("acct").orderBy(F.col("minute").desc()).rangeBetween(Window.unboundedPreceding, 0))


def outflow(window: int) -> Column:
    return F.coalesce(F.sum(debit(F.col("amount"))).over(by_account(0, window)), F.lit(0))


def windowed(led: DataFrame, p: Params) -> DataFrame:
    """The ledger with every frame's value: dwell and ratio (credits only), the burst around the row, the gap before it.

    All windows partition by account and so share one exchange; what a query does not use is pruned.
    """
    around = by_account(-p.burst, p.burst)
    order = Window.partitionBy("acct").orderBy("minute", "txn_id", "sgn")
    return led.select(
        "acct", "minute", "txn_id", "sgn", "amount", credit(next_debit() - F.col("minute")).alias("dwell"),
        credit(F.least(F.lit(1.5), outflow(p.passthru) / F.greatest("amount", F.lit(1)))).alias("ratio"),
        F.count("*").over(around).alias("c"), F.coalesce(F.sum(credit(F.col("amount"))).over(around), F.lit(0)).alias("iv"), F.coalesce(F.sum(debit(F.col("amount"))).over(around), F.lit(0)).alias("ov"),
        F.count(credit(F.lit(1))).over(around).alias("n_in"), F.count(debit(F.lit(1))).over(around).alias("n_out"), (F.col("minute") - F.lag("minute").over(order)).alias("gap"),
    )
