"""Totals of a transfer table, and counts of who is caught by a point in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.operators.detect import top_k


def cash_out(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row: value and number of transfers whose receiver is an exit account."""
    exits = accounts.where("is_exit = 1").select(F.col("account_id").alias("receiver")).distinct()
    return tx.join(exits, "receiver", "left_semi").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("cash_out"), F.count("*").alias("transfers"))


def channel_totals(tx: DataFrame) -> DataFrame:
    """Per channel the number and value of transfers and the minutes of the first and last."""
    return tx.groupBy("channel").agg(F.count("*").alias("transfers"), F.sum("amount").alias("value"), F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"))


def time_span(tx: DataFrame) -> DataFrame:
    """One row: first and last minute and the number of transfers."""
    return tx.agg(F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"), F.count("*").alias("transfers"))


def caught(tx: DataFrame, ours: DataFrame, rules: DataFrame, flagged: DataFrame, accounts: DataFrame, minute: int, k: int) -> DataFrame:
    """One row: mules seen in a transfer up to ``minute``, and how many of them ours and the rules have caught by then.

    Caught by the rules is a rank of k or better; caught by ours is that rank and a flag raised by ``minute``.
    """
    past = tx.where(F.col("minute") <= minute)
    seen = past.select(F.explode(F.array("sender", "receiver")).alias("account_id")).distinct()
    mules = seen.join(accounts.where("is_mule = 1").select("account_id"), "account_id", "left_semi")
    early = flagged.where(F.col("flagged_minute") <= minute).select(F.col("node").alias("account_id"))
    best = top_k(ours, k).select("account_id").join(early, "account_id", "left_semi").withColumn("o", F.lit(1))
    named = top_k(rules, k).select("account_id").withColumn("r", F.lit(1))
    got = mules.join(best, "account_id", "left").join(named, "account_id", "left")
    return got.agg(F.count("*").alias("seen"), F.count("o").alias("caught_ours"), F.count("r").alias("caught_rules"))
