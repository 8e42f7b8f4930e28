"""Per-account behaviour over the ledger: one windowed ledger, one aggregation by account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions.scalars import minute_of_day, safe_ratio
from weirflow.operators.ledger import credit, debit, ledger, windowed
from weirflow.schema import Params

NEVER = 1e5


def measures(led: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per account of the ledger with all thirteen measures, ``credits`` and ``events``.

    The aggregation groups by the windows' own partitioning, so it shuffles nothing.
    """
    fast = (F.col("ratio") > 0.75) & (F.col("dwell") < 30)
    m = minute_of_day(F.col("minute"))
    g = windowed(led, p).groupBy("acct").agg(
        F.count(credit(F.lit(1))).alias("credits"), F.count("*").alias("events"),
        F.coalesce(F.min("dwell").cast("double"), F.lit(NEVER)).alias("min_dwell"), F.coalesce(F.percentile("dwell", 0.1), F.lit(NEVER)).alias("p10_dwell"),
        F.count_if(fast).alias("fast_flowthru_n"), F.median("ratio").alias("med_matched_passthru"),
        F.max_by(F.struct("iv", "n_in", "n_out", "ov"), F.struct("c", -F.col("minute"))).alias("b"),
        (F.stddev_pop("gap") / (F.avg("gap") + 1e-9)).alias("burstiness"), F.count("*").alias("n_txn"),
        F.coalesce(F.sum(credit(F.col("amount"))), F.lit(0)).alias("tot_in"), F.coalesce(F.sum(debit(F.col("amount"))), F.lit(0)).alias("tot_out"),
        F.avg(F.when((m < 360) | (m > 1320), 1.0).otherwise(0.0)).alias("night_share"),
    )
    peak = F.when(F.col("events") > 1, F.col("b"))
    return g.select(
        "acct", "credits", "events", "min_dwell", "p10_dwell", "fast_flowthru_n", "med_matched_passthru", peak["iv"].alias("peak_in_val"), peak["n_in"].alias("peak_in_n"), peak["n_out"].alias("peak_out_n"),
        F.when(peak.isNotNull(), safe_ratio(peak["ov"], peak["iv"])).alias("peak_window_passthru"), "burstiness", "n_txn", "tot_in", "tot_out", "night_share",
    )


def credit_features(led: DataFrame, p: Params) -> DataFrame:
    """Dwell and matched pass-through of accounts with a credit."""
    return measures(led, p).where("credits > 0").select("acct", "min_dwell", "p10_dwell", "fast_flowthru_n", "med_matched_passthru")


def peak_burst(led: DataFrame, p: Params) -> DataFrame:
    """The busiest +-burst window of accounts with two events or more, the earliest on ties."""
    return measures(led, p).where("events > 1").select("acct", "peak_in_val", "peak_in_n", "peak_out_n", "peak_window_passthru")


def burstiness(led: DataFrame, p: Params = Params()) -> DataFrame:
    return measures(led, p).where("burstiness is not null").select("acct", "burstiness")


def totals(led: DataFrame, p: Params = Params()) -> DataFrame:
    return measures(led, p).select("acct", "n_txn", "tot_in", "tot_out", "night_share")


def behaviour(tx: DataFrame, accounts: DataFrame, p: Params = Params()) -> DataFrame:
    """All thirteen measures for every account, defaults for accounts without events."""
    got = measures(ledger(tx), p).drop("credits", "events").withColumnRenamed("acct", "account_id")
    return accounts.select("account_id").join(got, "account_id", "left").fillna({"min_dwell": NEVER, "p10_dwell": NEVER}).fillna(0)
