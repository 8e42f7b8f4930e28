"""Live flow-through detection on a stream of transfers.

State per account holds recent credits that are not yet confirmed and recent
debits, both bounded by the window.  A credit is emitted as a flow edge when the
debits within its window reach the ratio, at the minute of the debit that
confirms it: nothing is dated before it can be known.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.schema import Params

OUT = "txn_id long, u long, v long, amount long, minute long, confirmed_minute long"


def flow_edges_live(stream: DataFrame, p: Params = Params()) -> DataFrame:
    """stream (txn_id, minute, sender, receiver, amount, channel, ts) to confirmed flow edges.

    Rows later than the watermark are dropped; an account's state ends two windows after its last row.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    legs = F.array(F.struct(F.col("receiver").alias("acct"), F.lit(1).alias("sgn")), F.struct(F.col("sender").alias("acct"), F.lit(-1).alias("sgn")))
    led = stream.withWatermark("ts", f"{p.flow_window} minutes").where("channel = 'P2P'").select(F.explode(legs).alias("l"), "txn_id", "minute", "sender", "amount", "ts").select("l.acct", "l.sgn", "txn_id", "minute", F.col("sender").alias("u"), "amount", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    num, den = p.flow_ratio

    def run(key, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        (acct,) = key
        now = state.getCurrentWatermarkMs()  # Spark drops by the watermark of the batch before, so the rest of late rows goes here
        held = json.loads(state.get[0]) if state.exists else {"credits": [], "debits": [], "ms": 0}
        rows = sorted((int(m), -int(s), int(i), int(u), int(a), int(ms)) for pdf in batches for m, s, i, u, a, ms in zip(pdf.minute, pdf.sgn, pdf.txn_id, pdf.u, pdf.amount, pdf.ms, strict=True) if ms >= now)
        out = []
        for m, s, i, u, a, _ in rows:
            if s < 0:
                if a >= p.flow_floor:
                    held["credits"].append([m, i, u, a])
            else:
                held["debits"].append([m, a])
        still = []
        for m, i, u, a in held["credits"]:
            moved = 0
            for t, x in sorted(held["debits"]):
                if m <= t <= m + p.flow_window:
                    moved += x
                    if den * moved >= num * a:
                        out.append((i, u, acct, a, m, t))
                        break
            else:
                still.append([m, i, u, a])
        latest = max([r[0] for r in rows], default=0)
        # two windows: rows may come as late as the watermark allows
        last = max([r[5] for r in rows], default=0)
        held = {"credits": [c for c in still if c[0] >= latest - 2 * p.flow_window], "debits": [d for d in held["debits"] if d[0] >= latest - 2 * p.flow_window], "ms": max(held["ms"], last)}
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(max(held["ms"] + 2 * p.flow_window * 60_000, now + 1))
        yield pd.DataFrame(out, columns=["txn_id", "u", "v", "amount", "minute", "confirmed_minute"]).astype("int64")

    return led.groupBy("acct").applyInPandasWithState(run, OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)
