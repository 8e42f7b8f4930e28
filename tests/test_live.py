"""The live path: confirmed edges, late rows, and state that ends."""

from datetime import datetime, timedelta

import pandas as pd

from weirflow.streaming.live import flow_edges_live

START = datetime(2024, 1, 1)
SCHEMA = "txn_id long, minute long, sender long, receiver long, amount long, channel string, ts timestamp"


def put(folder, name, rows):
    made = [(i, m, s, r, a, c, pd.Timestamp(START + timedelta(minutes=m), tz="UTC")) for i, m, s, r, a, c in rows]
    df = pd.DataFrame(made, columns=["txn_id", "minute", "sender", "receiver", "amount", "channel", "ts"])
    df["ts"] = df["ts"].astype("datetime64[us, UTC]")
    df.to_parquet(folder / name)


def run(spark, folder, tmp_path, name):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = flow_edges_live(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return sorted(tuple(r) for r in spark.table(name).collect()), q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_confirmed_edges_late_rows_and_expired_state(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "a.parquet", [(1, 100, 1, 2, 10_000, "P2P"), (2, 105, 2, 3, 5_000, "P2P"), (3, 100, 8, 9, 4_000, "P2P"), (4, 101, 9, 1, 4_000, "P2P"), (5, 100, 5, 6, 9_000, "P2P"), (6, 102, 6, 7, 9_000, "P2M")])
    put(folder, "b.parquet", [(7, 112, 2, 4, 3_000, "P2P")])  # 8,000 of 10,000 within 15 minutes: confirmed at 112
    put(folder, "c.parquet", [(8, 10_000, 20, 21, 6_000, "P2P")])  # moves the watermark on
    put(folder, "d.parquet", [(9, 108, 6, 7, 9_000, "P2P"), (10, 10_004, 21, 22, 5_000, "P2P")])  # the first is too late to confirm 5
    rows, held = run(spark, folder, tmp_path, "live_out")
    assert rows == [(1, 1, 2, 10_000, 100, 112), (8, 20, 21, 6_000, 10_000, 10_004)]
    assert held == 3  # accounts 20, 21, 22: those of the first files have ended
