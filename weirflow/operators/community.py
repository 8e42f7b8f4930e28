"""Community tables and scores over member features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.schema import COMMUNITY_WEIGHTS, Params


def community_table(features: DataFrame, comm: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per community (node, community) of admissible size."""
    x = features.join(comm.withColumnRenamed("node", "account_id"), "account_id")
    g = x.groupBy("community").agg(
        F.count("*").alias("size"), F.median("p10_dwell").alias("dwell"), F.avg("reciprocity").alias("recip"), F.max("device_shared_by").alias("device"), F.avg("fast_flowthru_n").alias("flowthru"),
        F.avg("med_matched_passthru").alias("passthru"), F.median("age_min_at_first_txn").alias("age"), F.sum("peak_in_val").alias("peak_val"),
    )
    return g.where(F.col("size").between(p.min_comm, p.max_comm))


def community_scores(table: DataFrame) -> DataFrame:
    """The table with ``score``; a column without spread counts 0."""
    stats = table.agg(*[f(c).alias(f"{n}_{c}") for c in COMMUNITY_WEIGHTS for f, n in ((F.avg, "m"), (F.stddev_samp, "s"))])
    x = table.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for c, w in COMMUNITY_WEIGHTS.items():
        sd = F.when(F.coalesce(F.col(f"s_{c}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"s_{c}"))
        score = score + w * (F.col(c) - F.col(f"m_{c}")) / sd
    return x.select(*table.columns, score.alias("score"))


def member_scores(accounts: DataFrame, comm: DataFrame, scored: DataFrame) -> DataFrame:
    """account_id, comm_score: its community's score, or one below the lowest; 0 for all if there is no community."""
    low = scored.agg((F.min("score") - 1).alias("low"))
    x = accounts.select("account_id").join(comm.withColumnRenamed("node", "account_id"), "account_id", "left").join(scored.select("community", "score"), "community", "left").crossJoin(F.broadcast(low))  # one row
    return x.select("account_id", F.coalesce("score", "low", F.lit(0.0)).alias("comm_score"))


def purity(accounts: DataFrame, comm: DataFrame) -> DataFrame:
    x = accounts.join(comm.withColumnRenamed("node", "account_id"), "account_id")
    return x.groupBy("community").agg(F.count("*").alias("n"), F.sum("is_mule").alias("mules"), F.avg("is_mule").alias("purity"))
