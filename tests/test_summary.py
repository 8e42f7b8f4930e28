"""Totals, counters, presentation helpers, harness and command line."""

import json

from pyspark.sql import functions as F

from weirflow import __main__ as cli
from weirflow.functions import scalars as X
from weirflow.operators import alerts as A
from weirflow.operators import response as S
from weirflow.operators import summary as T
from weirflow.plans import harness
from weirflow.sources.simulate import Config

TX = "txn_id long, minute long, sender long, receiver long, amount long, channel string"


def test_totals(spark):
    tx = spark.createDataFrame([(1, 5, 1, 2, 10, "P2P"), (2, 9, 2, 3, 7, "P2M"), (3, 7, 1, 3, 5, "P2P")], TX)
    acc = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "account_id long, is_exit int")
    assert tuple(T.cash_out(tx, acc).first()) == (12, 2)
    assert tuple(T.cash_out(tx.limit(0), acc).first()) == (0, 0)
    assert tuple(T.time_span(tx).first()) == (5, 9, 3) and tuple(T.time_span(tx.limit(0)).first()) == (None, None, 0)
    assert sorted(map(tuple, T.channel_totals(tx).collect())) == [("P2M", 1, 7, 9, 9), ("P2P", 2, 15, 5, 7)]


def test_caught_by_a_minute(spark):
    tx = spark.createDataFrame([(1, 5, 1, 2, 10, "P2P"), (2, 6, 3, 4, 7, "P2P"), (3, 50, 5, 6, 5, "P2P")], TX)
    acc = spark.createDataFrame([(i, int(i in (1, 3, 4, 5))) for i in range(1, 7)], "account_id long, is_mule int")
    ours = spark.createDataFrame([(1, 9.0), (5, 8.0), (2, 7.0), (3, 6.0), (4, 1.0)], "account_id long, score double")
    rules = spark.createDataFrame([(4, 9.0), (2, 8.0), (3, 7.0), (1, 6.0), (5, 5.0)], "account_id long, score double")
    flagged = spark.createDataFrame([(1, 4), (3, 20), (2, 1), (5, 1)], "node long, flagged_minute long")
    # seen by 10: mules 1, 3, 4; ours ranks 1, 5, 2, 3 but flags 3 too late; rules rank 4, 2, 3, 1
    assert tuple(T.caught(tx, ours, rules, flagged, acc, 10, 4).first()) == (3, 1, 3)
    assert tuple(T.caught(tx, ours, rules, flagged, acc, 60, 2).first()) == (4, 2, 1)


def test_running_peak_crosses_where_the_flag_is_raised(spark):
    rows = [(i, i % 4, (i * 7) % 50, float((i * 31) % 17)) for i in range(60)]
    df = spark.createDataFrame(rows, "txn_id long, node long, minute long, score double")
    got = {r.txn_id: r.peak for r in S.running_peak(df, "node", "score").collect()}
    assert got == {i: max(s for _, n2, m2, s in rows if n2 == n and m2 <= m) for i, n, m, _ in rows}
    first = {}
    for i, n, m, _ in rows:
        if got[i] > 12:
            first[n] = min(m, first.get(n, m))
    assert {r.node: r.flagged_minute for r in S.flagged_at(df, 12.0).collect()} == first


def test_tier_and_detail(spark):
    tiered = spark.createDataFrame([(1, 2.0, "hold"), (2, 3.0, "freeze"), (3, 2.5, "hold")], "account_id long, score double, tier string")
    acc = spark.createDataFrame([(1, 1, "mule"), (2, 0, "gig")], "account_id long, is_mule int, account_type string")
    assert [tuple(r) for r in A.tier_members(tiered, acc, "hold").collect()] == [(3, 2.5), (1, 2.0)]
    assert [tuple(r) for r in A.tier_members(tiered, acc, "hold", truth=True).collect()] == [(3, 2.5, None, None), (1, 2.0, 1, "mule")]
    alerts = spark.createDataFrame([("x", "hold", [("A", "a", 0.9), ("B", "b", 0.1)]), ("y", "freeze", [])], "account_ref string, risk_tier string, evidence array<struct<code string, detail string, percentile double>>")
    assert sorted(tuple(r)[2:] for r in A.alert_detail(alerts, "x").collect()) == [("A", "a", 0.9), ("B", "b", 0.1)]


def test_presentation(spark):
    df = spark.createDataFrame([(1234567, "NET1|NET12", "fan_out_star"), (999, "NET12", "x"), (-100000, "", "a_b"), (None, None, None)], "n long, nets string, code string")
    got = df.select(X.grouped_digits(F.col("n")), X.holds(F.col("nets"), "NET1"), X.spaced(F.col("code")), X.tail(F.col("code"), 4), X.log_width(F.col("n"))).collect()
    assert [r[0] for r in got] == ["12,34,567", "999", "-1,00,000", None]
    assert [r[1] for r in got] == [True, False, False, None]
    assert [r[2] for r in got] == ["fan out star", "x", "a b", None] and [r[3] for r in got] == ["star", "x", "a_b", None]
    assert [r[4] for r in got][:3] == [6.0, 3.0, 1.0]
    assert X.with_prefix(["lg_a", "b", "lg_c"], "lg_") == ["lg_a", "lg_c"]


def test_harness_and_command_line(spark, tmp_path, capsys):
    cfg = Config(scale=0.01, days=6, networks=2)
    row = harness.one_run(spark, cfg, k=20)
    assert set(row) == {c.split()[0] for c in harness.ROW.split(", ")} and row["networks"] == 2 and 0 <= row["precision_final"] <= 1
    assert abs(row["lift_final"] * row["base_rate"] - row["precision_final"]) < 1e-9
    cli.main(["sweep", "--scales", "0.01", "--days", "6", "--networks", "2", "-k", "20", "--out", str(tmp_path / "s")], spark)
    got = spark.read.json(str(tmp_path / "s")).first()
    assert got.transfers == row["transfers"] and got.precision_final == row["precision_final"]
    cli.main(["simulate", "--scale", "0.01", "--days", "2", "--networks", "1", "--out", str(tmp_path / "t")], spark)
    assert spark.read.parquet(str(tmp_path / "t/transfers.parquet")).count() > 0
    cli.main(["run", "time_span", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path / "q"), "--json"], spark)
    assert spark.read.json(str(tmp_path / "q")).first().transfers > 0
    cli.main(["list"])
    assert "time_span" in json.dumps(capsys.readouterr().out)
