"""Sensitivity of the final score to the generator's settings: one row per configuration."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from weirflow.operators import detect as D
from weirflow.operators import flow as W
from weirflow.plans.catalog import features_of, final_of
from weirflow.schema import Params
from weirflow.sources.simulate import Config, simulate
from weirflow.storage import Scratch, released

ROW = "scale double, seed long, k long, accounts long, transfers long, mules long, base_rate double, precision_final double, lift_final double, precision_rules double, lift_rules double, networks_hit long, networks long"


def one_run(spark: SparkSession, cfg: Config, k: int = 200, p: Params = Params()) -> dict:
    """Generates, scores and evaluates one configuration; its scratch tables go with it."""
    with released(spark):
        s = Scratch(spark, "harness")
        tx, acc = (s.save(x, n) for x, n in zip(simulate(spark, cfg), ("transfers", "accounts"), strict=True))
        f, e = features_of(tx, acc), s.save(W.laundering_edges(tx, p), "edges")
        final, rules = s.save(final_of(e, acc, f, p), "final"), D.rules_baseline(f)
        best, plain, nets = D.precision_recall(final, acc, k).first(), D.precision_recall(rules, acc, k).first(), D.networks_hit(final, acc, k).first()
        n, base = acc.count(), best.base_rate or 0.0

        def lift(x):
            return float(x.precision_at_k or 0.0) / base if base else 0.0

        return {
            "scale": float(cfg.scale), "seed": cfg.seed, "k": k, "accounts": n, "transfers": tx.count(), "mules": best.mules, "base_rate": float(base), "precision_final": float(best.precision_at_k or 0.0), "lift_final": lift(best),
            "precision_rules": float(plain.precision_at_k or 0.0), "lift_rules": lift(plain), "networks_hit": nets.networks_hit, "networks": nets.networks,
        }


def sweep(spark: SparkSession, scales: Iterable[float], seeds: Iterable[int], k: int = 200, base: Config = Config(), p: Params = Params()) -> DataFrame:
    """Every scale with every seed."""
    rows = [one_run(spark, replace(base, scale=x, seed=y), k, p) for x in scales for y in seeds]
    return spark.createDataFrame(rows, ROW).orderBy("scale", "seed")


__all__ = ["one_run", "sweep"]
