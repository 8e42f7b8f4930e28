"""Command line: list queries, run one over a folder of tables, generate transfers, sweep settings."""

from __future__ import annotations

import argparse
from dataclasses import replace

from weirflow.plans import harness
from weirflow.plans.catalog import QUERIES
from weirflow.sources.simulate import Config, simulate
from weirflow.sources.tables import append_jsonl, write_json, write_stage


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weirflow", description=__doc__)
    todo = p.add_subparsers(dest="command", required=True)
    todo.add_parser("list", help="names of all queries")
    run = todo.add_parser("run", help="one query, written as Parquet or JSON")
    run.add_argument("query", choices=sorted(QUERIES), metavar="query")
    run.add_argument("--data", required=True, help="folder with the Parquet tables")
    run.add_argument("--out", required=True)
    run.add_argument("--json", action="store_true", help="JSON lines instead of Parquet")
    gen = todo.add_parser("simulate", help="transfers and accounts, written as Parquet")
    gen.add_argument("--out", required=True)
    gen.add_argument("--scale", type=float, default=Config.scale)
    gen.add_argument("--seed", type=int, default=Config.seed)
    gen.add_argument("--days", type=int, default=Config.days)
    gen.add_argument("--networks", type=int, default=Config.networks)
    many = todo.add_parser("sweep", help="one row per scale and seed, appended to JSON lines")
    many.add_argument("--out", required=True)
    many.add_argument("--scales", type=float, nargs="+", default=[1.0])
    many.add_argument("--seeds", type=int, nargs="+", default=[42])
    many.add_argument("--days", type=int, default=Config.days)
    many.add_argument("--networks", type=int, default=Config.networks)
    many.add_argument("-k", type=int, default=200)
    return p


def main(argv: list[str] | None = None, spark=None) -> None:
    a = parser().parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(QUERIES)))
        return
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("weirflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "run":
        (write_json if a.json else write_stage)(QUERIES[a.query](spark, a.data), a.out)
    elif a.command == "simulate":
        tx, acc = simulate(spark, replace(Config(), scale=a.scale, seed=a.seed, days=a.days, networks=a.networks))
        write_stage(tx, f"{a.out}/transfers.parquet")
        write_stage(acc, f"{a.out}/accounts.parquet")
    else:
        append_jsonl(harness.sweep(spark, a.scales, a.seeds, a.k, replace(Config(), days=a.days, networks=a.networks)), a.out)


if __name__ == "__main__":
    main()
