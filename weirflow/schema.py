"""Parameters and table schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Account kinds, the look-alike kinds among them, tiers by strength, and community weights.
KINDS = ("employer", "cashout_point", "merchant", "salaried", "gig", "student", "small_shop", "group_collector", "gig_aggregator", "informal_lender", "mule")
CONFOUNDERS = ("small_shop", "group_collector", "gig_aggregator", "informal_lender")
TIERS = ("freeze", "hold", "throttle")
COMMUNITY_WEIGHTS = {"dwell": -1.2, "recip": -1.0, "device": 1.0, "flowthru": 1.0, "passthru": 0.6, "age": -0.6, "peak_val": 0.4}


@dataclass(frozen=True)
class Params:
    burst: int = 60
    passthru: int = 180
    pair_floor: int = 1000
    flow_window: int = 15
    flow_ratio: tuple[int, int] = (8, 10)
    flow_floor: int = 5000
    min_comm: int = 4
    max_comm: int = 200
    star_window: int = 30
    chain_gap: int = 720
    smurf: tuple[int, int] = (4000, 10000)
    payout: int = 50_000
    tier_precision: tuple[float, float, float] = (0.90, 0.55, 0.20)
    min_band: int = 10
    give_up: int = 2000
    salt: str = "window-2026-02-14"
    k: int = 200


TRANSFERS = T.StructType([T.StructField(n, t) for n, t in (("txn_id", T.LongType()), ("minute", T.LongType()), ("sender", T.LongType()), ("receiver", T.LongType()), ("amount", T.LongType()), ("channel", T.StringType()))])
ACCOUNTS = T.StructType([T.StructField(n, t) for n, t in (("account_id", T.LongType()), ("account_type", T.StringType()), ("open_day", T.IntegerType()), ("device_id", T.LongType()), ("is_mule", T.IntegerType()), ("is_exit", T.IntegerType()), ("label_exposed", T.IntegerType()), ("mule_network_id", T.StringType()))])
EVIDENCE = T.ArrayType(T.StructType([T.StructField("code", T.StringType()), T.StructField("detail", T.StringType()), T.StructField("percentile", T.DoubleType())]))
