"""Exact ranks and quantiles of a whole column without a window over all rows.

Values are counted, the distinct ones range-partitioned in order, and counted
within partitions; the partitions' totals (one row each) give every value the
number of rows before it.  A table of few distinct values skips the partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.storage import Scratch

#: Distinct values that one task may put in order.
ONE_TASK = 200_000


def counts_before(df: DataFrame, col: str, sums: tuple[str, ...] = (), one_task: int = ONE_TASK) -> DataFrame:
    """value, n, before (rows with a smaller value) and the sums of the named columns by value; nulls are left out."""
    s = Scratch(df.sparkSession, "ranks")
    g = s.save(df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums]), "counts")
    upto = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    if g.count() <= one_task:
        return g.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    parts = s.save(g.repartitionByRange("value").withColumn("_p", F.spark_partition_id()), "parts")
    totals = parts.groupBy("_p").agg(F.sum("n").alias("t"))  # one row per partition
    base = totals.select(F.col("_p").alias("_q"), F.coalesce(F.sum("t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("_p").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("within", within).join(F.broadcast(base), F.col("_p") == F.col("_q")).withColumn("before", F.col("within") + F.col("base")).drop("_p", "_q", "within", "base")


def quantiles(df: DataFrame, at: dict[str, tuple[str, float]], one_task: int = ONE_TASK) -> DataFrame:
    """One row with a column per name: the exact quantile of a column, interpolated between neighbouring ranks; null without values."""
    out = None
    for name, (col, q) in at.items():
        c = counts_before(df, col, one_task=one_task)
        total = c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
        x = c.crossJoin(F.broadcast(total)).withColumn("k", F.lit(q) * (F.col("total") - 1))  # one row
        lo, hi = (F.max(F.when(F.col("before") <= f(F.col("k")), F.col("value").cast("double"))) for f in (F.floor, F.ceil))
        one = x.agg(lo.alias("lo"), hi.alias("hi"), F.max("k").alias("k")).select((F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("k") - F.floor("k"))).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out


def percentile_below(df: DataFrame, col: str, out: str, one_task: int = ONE_TASK) -> DataFrame:
    """Adds the share of rows strictly below."""
    n = df.agg(F.count("*").alias("_n"))
    below = counts_before(df, col, one_task=one_task).crossJoin(F.broadcast(n))  # one row
    return df.join(below.select(F.col("value").alias("_v"), (F.col("before") / F.col("_n")).alias(out)), F.col(col) == F.col("_v"), "left").drop("_v")
