"""Counterparty, device and age features: one aggregation by pair of accounts, one by account."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counterparties(tx: DataFrame) -> DataFrame:
    """One row per account with a transfer: fan_in, in_n, fan_out, out_n, reciprocity, stranger_in_share, first_in.

    Transfers are summed by directed pair first; each pair then counts for both of its accounts, so an account
    with a large share of all transfers sends on one row per counterparty.
    """
    pair = tx.groupBy("sender", "receiver").agg(F.count("*").alias("k"), F.sum("amount").alias("total"), F.min_by("amount", F.struct("minute", "txn_id")).alias("first"), F.min("minute").alias("t"))
    inward = F.struct(F.col("receiver").alias("a"), F.col("sender").alias("b"), F.col("k").alias("i"), F.lit(0).cast("long").alias("o"), F.col("total").alias("total"), F.col("first").alias("first"), F.col("t").alias("t"))
    none = F.lit(None).cast("long")
    outward = F.struct(F.col("sender").alias("a"), F.col("receiver").alias("b"), F.lit(0).cast("long").alias("i"), F.col("k").alias("o"), none.alias("total"), none.alias("first"), none.alias("t"))
    both = pair.select(F.explode(F.array(inward, outward)).alias("x")).groupBy("x.a", "x.b").agg(*[F.sum(f"x.{c}").alias(c) for c in ("i", "o", "total", "first")], F.min("x.t").alias("t"))
    return both.groupBy(F.col("a").alias("account_id")).agg(
        F.count_if(F.col("i") > 0).alias("fan_in"), F.sum("i").alias("in_n"), F.count_if(F.col("o") > 0).alias("fan_out"), F.sum("o").alias("out_n"),
        F.avg(((F.col("i") > 0) & (F.col("o") > 0)).cast("int")).alias("reciprocity"), (F.sum("first") / F.sum("total")).alias("stranger_in_share"), F.min("t").alias("first_in"),
    )


def fans(tx: DataFrame) -> DataFrame:
    return counterparties(tx).select("account_id", "fan_in", "in_n", "fan_out", "out_n")


def reciprocity(tx: DataFrame) -> DataFrame:
    """Counterparties paid in both directions over all counterparties."""
    return counterparties(tx).select("account_id", "reciprocity")


def stranger_share(tx: DataFrame) -> DataFrame:
    """Share of inbound value that came with a counterparty's first transfer, of accounts with an inbound transfer."""
    return counterparties(tx).where("in_n > 0").select("account_id", "stranger_in_share")


def device_sharing(accounts: DataFrame) -> DataFrame:
    n = F.when(F.col("device_id").isNotNull(), F.count("*").over(Window.partitionBy("device_id"))).otherwise(0)
    return accounts.select("account_id", n.alias("device_shared_by"))


def _age(first: str) -> F.Column:
    return (-F.col("open_day").cast("long") * 1440 + F.coalesce(first, F.lit(0))).alias("age_min_at_first_txn")


def age_at_first(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    return accounts.join(counterparties(tx).select("account_id", "first_in"), "account_id", "left").select("account_id", _age("first_in"))


def relational(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """All counterparty, device and age features for every account."""
    got = accounts.join(counterparties(tx), "account_id", "left")
    out = got.select("account_id", "fan_in", "in_n", "fan_out", "out_n", "reciprocity", "stranger_in_share", _age("first_in"))
    return out.join(device_sharing(accounts), "account_id").fillna(0)
