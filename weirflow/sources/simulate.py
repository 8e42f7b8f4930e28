"""A seeded generator of transfers with ordinary, look-alike and mule accounts.

Ordinary traffic is expressed on ``spark.range`` with hash-seeded draws, so it
scales with executors and does not depend on partitioning; the few mule networks
are drawn on the driver.  ``scale`` multiplies the ordinary population only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.schema import ACCOUNTS, TRANSFERS

DAY = 1440
#: Share of ordinary accounts by kind (look-alikes included) and of mule typologies.
POPULATION = {"salaried": 3200, "gig": 1400, "student": 1100, "merchant": 400, "employer": 60, "small_shop": 140, "group_collector": 110, "gig_aggregator": 60, "informal_lender": 50}
TYPOLOGIES = {"fan_out_star": 0.40, "peel_chain": 0.25, "round_trip_cycle": 0.15, "smurfing": 0.20}


@dataclass(frozen=True)
class Config:
    seed: int = 42
    days: int = 45
    scale: float = 1.0
    networks: int = 14
    p2p_per_day: float = 0.5
    spend_per_day: float = 1.9
    cluster: int = 30
    payback: float = 0.55


def _u(seed: int, *cols) -> F.Column:
    """A uniform draw in [0, 1) from a hash: the same on every run and partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / float(1 << 30)


def ordinary_accounts(spark: SparkSession, cfg: Config) -> DataFrame:
    sizes = {k: max(1, int(n * cfg.scale)) for k, n in POPULATION.items()}
    total, at, kind = sum(sizes.values()), 0, None
    for k, n in sizes.items():
        at += n
        kind = F.when(F.col("id") < at, k) if kind is None else kind.when(F.col("id") < at, k)
    a = spark.range(total).select(F.col("id").alias("account_id"), kind.alias("account_type"), (-F.floor(_u(cfg.seed + 1, "id") * 2500)).cast("int").alias("open_day"))
    shared = _u(cfg.seed + 2, F.floor(F.col("account_id") / 3)) < 0.09
    return a.select("*", F.when(shared, F.floor(F.col("account_id") / 3) * 3).otherwise(F.col("account_id")).cast("long").alias("device_id"), F.lit(0).alias("is_mule"), F.lit(0).alias("is_exit"), F.lit(0).alias("label_exposed"), F.lit("").alias("mule_network_id"))


def ordinary_transfers(acc: DataFrame, cfg: Config, total: int) -> DataFrame:
    horizon = cfg.days * DAY
    person = acc.where(F.col("account_type").isin("salaried", "gig", "student"))
    merchants = int(POPULATION["merchant"] * cfg.scale) or 1
    first_merchant = sum(max(1, int(POPULATION[k] * cfg.scale)) for k in ("salaried", "gig", "student"))
    # spending: count by rounding a skewed draw, targets by inverse CDF of a heavy tail
    n = F.floor(-F.log(1 - _u(cfg.seed + 3, "account_id")) * cfg.spend_per_day * cfg.days).cast("int")
    spend = person.select("account_id", F.explode(F.when(n > 0, F.sequence(F.lit(1), n))).alias("i"))
    target = F.lit(first_merchant) + F.floor(F.pow(_u(cfg.seed + 4, "account_id", "i"), 2.4) * merchants).cast("long")
    minute = F.floor(_u(cfg.seed + 5, "account_id", "i") * cfg.days) * DAY + 420 + F.floor(_u(cfg.seed + 6, "account_id", "i") * 930)
    spend = spend.select(F.col("account_id").alias("sender"), target.alias("receiver"), F.floor(20 - F.log(1 - _u(cfg.seed + 7, "account_id", "i")) * 400).cast("long").alias("amount"), minute.cast("long").alias("minute"), F.lit("P2M").alias("channel"))
    # peers within a cluster, some outside, with paybacks
    m = F.floor(-F.log(1 - _u(cfg.seed + 8, "account_id")) * cfg.p2p_per_day * cfg.days).cast("int")
    pay = person.select("account_id", F.explode(F.when(m > 0, F.sequence(F.lit(1), m))).alias("i"))
    near = F.floor(F.col("account_id") / cfg.cluster) * cfg.cluster + F.floor(_u(cfg.seed + 9, "account_id", F.col("i") % 6) * cfg.cluster)
    far = F.floor(_u(cfg.seed + 10, "account_id", F.col("i") % 6) * total)
    peer = F.when(_u(cfg.seed + 11, "account_id", F.col("i") % 6) < 0.15, far).otherwise(F.least(near, F.lit(total - 1))).cast("long")
    amount = F.floor(30 - F.log(1 - _u(cfg.seed + 12, "account_id", "i")) * 1400).cast("long")
    pay = pay.select(F.col("account_id").alias("sender"), peer.alias("receiver"), amount.alias("amount"), F.floor(_u(cfg.seed + 13, "account_id", "i") * horizon).cast("long").alias("minute"), F.lit("P2P").alias("channel"), "i")
    late = 120 + F.floor(_u(cfg.seed + 15, "sender", "i") * 6 * DAY)
    back = pay.where(_u(cfg.seed + 14, "sender", "i") < cfg.payback).select(F.col("receiver").alias("sender"), F.col("sender").alias("receiver"), F.floor(F.col("amount") * (0.4 + 1.2 * _u(cfg.seed + 16, "sender", "i"))).cast("long").alias("amount"), (F.col("minute") + late).cast("long").alias("minute"), F.lit("P2P").alias("channel"))
    # merchants settle weekly with an employer; collectors and lenders forward what they gather on P2P rails
    employers = first_merchant + merchants
    settle = acc.where("account_type = 'merchant'").select("account_id", F.explode(F.sequence(F.lit(0), F.lit(cfg.days - 1), F.lit(7))).alias("d")).select(F.col("account_id").alias("sender"), (F.lit(employers) + F.col("account_id") % max(1, int(POPULATION["employer"] * cfg.scale))).cast("long").alias("receiver"), F.floor(5000 + 75_000 * _u(cfg.seed + 17, "account_id", "d")).cast("long").alias("amount"), (F.col("d") * DAY + 1200).cast("long").alias("minute"), F.lit("P2M").alias("channel"))
    hub = acc.where(F.col("account_type").isin("group_collector", "informal_lender", "small_shop", "gig_aggregator")).select("account_id", F.explode(F.sequence(F.lit(0), F.lit(cfg.days - 1), F.lit(2))).alias("d"), F.sequence(F.lit(1), F.lit(8)).alias("k"))
    gather = hub.select("account_id", "d", F.explode("k").alias("k")).select(F.floor(_u(cfg.seed + 18, "account_id", "d", "k") * first_merchant).cast("long").alias("sender"), F.col("account_id").alias("receiver"), F.floor(1000 + 9000 * _u(cfg.seed + 19, "account_id", "d", "k")).cast("long").alias("amount"), (F.col("d") * DAY + 600 + F.col("k") * 10).cast("long").alias("minute"), F.lit("P2P").alias("channel"))
    forward = hub.select(F.col("account_id").alias("sender"), F.floor(_u(cfg.seed + 20, "account_id", "d") * first_merchant).cast("long").alias("receiver"), F.lit(30_000).cast("long").alias("amount"), (F.col("d") * DAY + 700).cast("long").alias("minute"), F.lit("P2P").alias("channel"))
    out = spend.unionByName(pay.drop("i"))
    for x in (back, settle, gather, forward):
        out = out.unionByName(x)
    return out


def mule_networks(cfg: Config, first_id: int, ordinary: int):
    """(accounts, transfers) of the mule networks as plain rows; size depends on ``networks`` only."""
    rng = np.random.default_rng(cfg.seed)
    acc, tx, nid = [], [], first_id
    for k in range(cfg.networks):
        name, size = f"NET{k:02d}", int(rng.integers(8, 34))
        ids = list(range(nid, nid + size))
        nid += size
        exits = ids[-int(rng.integers(1, 3)) :]
        device = [ids[int(rng.integers(0, 3))] for _ in ids]
        for i, d in zip(ids, device, strict=True):
            acc.append((i, "cashout_point" if i in exits else "mule", int(-rng.integers(0, 60)), d, 1, int(i in exits), int(rng.random() < 0.15), name))
        typ = rng.choice(list(TYPOLOGIES), p=list(TYPOLOGIES.values()))
        for _ in range(int(rng.integers(6, 20))):
            t, amount, src = int(rng.integers(DAY, cfg.days * DAY)), int(rng.integers(50_000, 600_000)), ids[0]
            tx.append((int(rng.integers(0, ordinary)), src, amount, t, "P2P"))
            inner = ids[1 : -len(exits)]
            if typ == "fan_out_star":
                legs = int(rng.integers(5, 13))
                hops = [(src, m, amount // legs, 1 + int(rng.integers(0, 10))) for m in rng.choice(inner, min(legs, len(inner)), replace=False).tolist()]
            elif typ == "smurfing":
                hops = [(src, inner[int(rng.integers(0, len(inner)))], int(rng.integers(4000, 9500)), 1 + int(rng.integers(0, 14))) for _ in range(int(rng.integers(12, 40)))]
            else:
                ring = [src, *rng.choice(inner, min(int(rng.integers(3, 6)), len(inner)), replace=False).tolist()]
                ring += [src] if typ == "round_trip_cycle" else []
                hops, left = [], amount
                for i, (a, b) in enumerate(zip(ring, ring[1:], strict=False)):
                    left = int(left * rng.uniform(0.85, 0.97))
                    hops.append((a, b, left, 3 * (i + 1)))
            for a, b, amt, dt in hops:
                tx.append((a, b, amt, t + dt, "P2P"))
                tx.append((b, exits[int(rng.integers(0, len(exits)))], int(amt * rng.uniform(0.80, 0.95)), t + dt + max(1, int(rng.integers(25, 1500)) // 60), "P2P"))
    return acc, tx


def simulate(spark: SparkSession, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(transfers, accounts)."""
    acc = ordinary_accounts(spark, cfg)
    total = sum(max(1, int(n * cfg.scale)) for n in POPULATION.values())
    rows, moves = mule_networks(cfg, total, total)
    accounts = acc.unionByName(spark.createDataFrame(rows, ACCOUNTS))
    cols = "sender long, receiver long, amount long, minute long, channel string"
    tx = ordinary_transfers(acc, cfg, total).unionByName(spark.createDataFrame(moves, cols)).where(F.col("minute").between(0, cfg.days * DAY - 1) & (F.col("sender") != F.col("receiver")) & (F.col("amount") > 0))
    # ids from the row's content, no global numbering; transfers of equal content are told apart by their number among them
    content = ["sender", "receiver", "minute", "amount", "channel"]
    same = F.row_number().over(Window.partitionBy(*content).orderBy("channel"))
    tx = tx.withColumn("same", same).select(F.xxhash64(*content, "same").alias("txn_id"), *content)
    return tx.select(*[f.name for f in TRANSFERS]), accounts.select(*[f.name for f in ACCOUNTS])
