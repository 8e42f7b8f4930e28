"""The generator: ids, ranges, and transfers of equal content."""

from weirflow.schema import ACCOUNTS, TRANSFERS
from weirflow.sources import simulate as S


def test_transfers_of_a_small_population(spark, monkeypatch):
    cfg = S.Config(scale=0.02, days=10, networks=2)
    whole = S.mule_networks

    def twice(*args):
        acc, tx = whole(*args)
        return acc, tx + tx[:5]

    monkeypatch.setattr(S, "mule_networks", twice)
    tx, acc = S.simulate(spark, cfg)
    assert tx.columns == [f.name for f in TRANSFERS] and acc.columns == [f.name for f in ACCOUNTS]
    rows, ids = tx.collect(), {r.account_id for r in acc.collect()}
    assert len({r.txn_id for r in rows}) == len(rows) > 500
    assert all(0 <= r.minute < 14400 and r.amount > 0 and r.sender != r.receiver for r in rows)
    assert all(r.receiver in ids and r.sender in ids for r in rows)
    contents = [(r.sender, r.receiver, r.minute, r.amount) for r in rows]
    assert len(set(contents)) < len(contents)  # the repeated transfers are still there
    assert sorted(map(str, rows)) == sorted(map(str, S.simulate(spark, cfg)[0].collect()))
