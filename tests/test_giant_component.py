"""Community scores where all accounts hang together in one component."""

from itertools import combinations

from weirflow.operators import community as C
from weirflow.plans import catalog
from weirflow.schema import Params


def test_a_giant_component_has_scored_communities(spark):
    n = 60  # groups of five accounts that all pay each other, each joined to the next by one small transfer
    edges = [(5 * k + a, 5 * k + b, 9000) for k in range(n) for a, b in combinations(range(5), 2)] + [(5 * k, 5 * ((k + 1) % n), 1) for k in range(n)]
    e = spark.createDataFrame(edges, "u long, v long, amount long")
    assert 5 * n > Params().max_comm
    f = spark.createDataFrame([(i, float(i % 7), 0.1 * (i % 3), i % 4, i // 5, 0.5, 100 + i, 1000 * (i // 5)) for i in range(5 * n)],
        "account_id long, p10_dwell double, reciprocity double, device_shared_by long, fast_flowthru_n long, med_matched_passthru double, age_min_at_first_txn long, peak_in_val long")
    comm = catalog.member_communities(e)
    table = C.community_table(f, comm)
    got = C.member_scores(f.select("account_id"), comm, C.community_scores(table)).collect()
    assert len(got) == 5 * n and len({r.comm_score for r in got}) > 10


def test_final_score_uses_louvain(spark, monkeypatch):
    seen = []
    whole = catalog.G.louvain
    monkeypatch.setattr(catalog.G, "louvain", lambda e: seen.append(1) or whole(e))
    assert catalog.QUERIES["final_score"](spark, "/root/testdata/sf0.001").count() > 0
    assert seen
