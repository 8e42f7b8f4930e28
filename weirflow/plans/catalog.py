"""Named queries and the SQL that gives the same rows.

Queries over derived transfers use a flow window of 120 minutes where the
15-minute default leaves too small a graph on the test tables.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.operators import alerts as A
from weirflow.operators import behaviour as B
from weirflow.operators import community as C
from weirflow.operators import detect as D
from weirflow.operators import flow as W
from weirflow.operators import graph as G
from weirflow.operators import motifs as M
from weirflow.operators import relational as R
from weirflow.operators import response as S
from weirflow.operators import summary as T
from weirflow.operators.components import connected_components
from weirflow.operators.ledger import ledger
from weirflow.operators.ranks import percentile_below
from weirflow.plans.sql import ACTIONS, BASIS, sql
from weirflow.schema import Params
from weirflow.sources.tables import accounts, transfers
from weirflow.storage import Scratch

WIDE = replace(Params(), flow_window=120)
K = 20
QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, oracle: str | None = None, **kw):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = sql(oracle, **kw)
        return f

    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def features_of(tx: DataFrame, acc: DataFrame) -> DataFrame:
    both = acc.join(B.behaviour(tx, acc), "account_id").join(R.relational(tx, acc), "account_id")
    return Scratch(tx.sparkSession, "features").save(both, "features")  # a stage table: later steps read it several times


def features(s, d) -> DataFrame:
    return features_of(transfers(s, d), accounts(s, d))


def graph(s, d, p=WIDE) -> DataFrame:
    return Scratch(s, "edges").save(W.laundering_edges(transfers(s, d), p), "edges")


def rules(s, d) -> DataFrame:
    return D.rules_baseline(features(s, d))


def parts(s, d, p=WIDE) -> DataFrame:
    return connected_components(graph(s, d, p)).withColumnRenamed("component", "community")


def groups(s, d) -> DataFrame:
    """Components at the default window, many and small: the communities of the queries that have SQL."""
    return parts(s, d, Params())


def member_communities(e: DataFrame) -> DataFrame:
    """Louvain communities of an edge table (u, v, amount), also inside one giant component."""
    return G.louvain(G.undirected(e, "u", "v", "amount"))


@query("flow_through_edges", 'SELECT txn_id, u, v, amount, "minute" FROM flow')
def _(s, d):
    return W.flow_edges(transfers(s, d), WIDE)


@query("flow_through_edges_15", 'SELECT txn_id, u, v, amount, "minute" FROM flow', window=15)
def _(s, d):
    return W.flow_edges(transfers(s, d))


@query("ledger_credit_debit", 'SELECT acct, "minute", txn_id, sgn, amount, channel FROM led')
def _(s, d):
    return ledger(transfers(s, d)).drop("other")


@query("dwell_min_p10", "SELECT acct, min_dwell, round(p10_dwell, 6) AS p10_dwell FROM credit")
def _(s, d):
    return rounded(B.credit_features(ledger(transfers(s, d)), Params()).select("acct", "min_dwell", "p10_dwell"), "p10_dwell")


@query("matched_passthru_median", "SELECT acct, round(med_matched_passthru, 6) AS med_matched_passthru FROM credit")
def _(s, d):
    return rounded(B.credit_features(ledger(transfers(s, d)), Params()).select("acct", "med_matched_passthru"), "med_matched_passthru")


@query("fast_flowthru_count", "SELECT acct, fast_flowthru_n FROM credit")
def _(s, d):
    return B.credit_features(ledger(transfers(s, d)), Params()).select("acct", "fast_flowthru_n")


@query("peak_burst_window", "SELECT acct, peak_in_val, peak_in_n, peak_out_n, round(peak_window_passthru, 6) AS peak_window_passthru FROM peak")
def _(s, d):
    return rounded(B.peak_burst(ledger(transfers(s, d)), Params()), "peak_window_passthru")


@query("burstiness", "SELECT acct, round(burstiness, 6) AS burstiness FROM burst")
def _(s, d):
    return rounded(B.burstiness(ledger(transfers(s, d))), "burstiness")


@query("night_share", "SELECT acct, round(night_share, 6) AS night_share FROM tot")
def _(s, d):
    return rounded(B.totals(ledger(transfers(s, d))).select("acct", "night_share"), "night_share")


@query("activity_totals", "SELECT acct, n_txn, tot_in, tot_out FROM tot")
def _(s, d):
    return B.totals(ledger(transfers(s, d))).drop("night_share")


@query("fan_in_out", "SELECT account_id, fan_in, in_n, fan_out, out_n FROM fans")
def _(s, d):
    return R.fans(transfers(s, d))


@query("reciprocity", "SELECT account_id, round(reciprocity, 6) AS reciprocity FROM recip")
def _(s, d):
    return rounded(R.reciprocity(transfers(s, d)), "reciprocity")


@query("stranger_in_share", "SELECT account_id, round(stranger_in_share, 6) AS stranger_in_share FROM strange")
def _(s, d):
    return rounded(R.stranger_share(transfers(s, d)), "stranger_in_share")


@query("device_shared_by", "SELECT account_id, device_shared_by FROM dev")
def _(s, d):
    return R.device_sharing(accounts(s, d))


@query("age_at_first_txn", "SELECT account_id, age_min_at_first_txn FROM age")
def _(s, d):
    return R.age_at_first(transfers(s, d), accounts(s, d))


@query("terminal_hop_edges", 'SELECT txn_id, u, v, amount, "minute" FROM term', window=15)
def _(s, d):
    return W.terminal_edges(transfers(s, d))


@query("laundering_edges", 'SELECT txn_id, u, v, amount, "minute", kind FROM lg')
def _(s, d):
    return graph(s, d)


@query("pair_edges_pruned", "SELECT sender, receiver, w, k, t_first, t_last FROM pairs")
def _(s, d):
    return G.pair_edges(transfers(s, d))


@query("lg_degrees", """SELECT node, coalesce(od, 0) AS lg_out_deg, coalesce(ou, 0) AS lg_out_uniq, coalesce(id, 0) AS lg_in_deg, coalesce(iu, 0) AS lg_in_uniq FROM (SELECT u AS node, count(*) AS od, count(DISTINCT v) AS ou FROM lg GROUP BY 1)
  FULL JOIN (SELECT v AS node, count(*) AS id, count(DISTINCT u) AS iu FROM lg GROUP BY 1) USING (node)""")
def _(s, d):
    return M.degrees(graph(s, d))


@query("star_fanout", """SELECT u AS node, CASE WHEN count(*) < 2 THEN 0 ELSE max(n) END AS motif_star_out FROM (SELECT u, count(DISTINCT v) OVER (PARTITION BY u ORDER BY "minute" RANGE BETWEEN CURRENT ROW AND 30 FOLLOWING) AS n FROM lg) GROUP BY u""")
def _(s, d):
    return M.star(graph(s, d), WIDE)


@query("closed_walks_2", "SELECT x.u AS node, count(*) AS walks FROM a x JOIN a y ON y.u = x.v AND y.v = x.u GROUP BY 1")
def _(s, d):
    return M.closed_walks(graph(s, d), 2)


@query("closed_walks_3", "SELECT x.u AS node, count(*) AS walks FROM a x JOIN a y ON y.u = x.v JOIN a z ON z.u = y.v AND z.v = x.u GROUP BY 1")
def _(s, d):
    return M.closed_walks(graph(s, d), 3)


@query("closed_walks_4", "SELECT x.u AS node, count(*) AS walks FROM a x JOIN a y ON y.u = x.v JOIN a z ON z.u = y.v JOIN a t ON t.u = z.v AND t.v = x.u GROUP BY 1")
def _(s, d):
    return M.closed_walks(graph(s, d), 4)


@query("smurf_band", """SELECT node, coalesce(si, 0) AS motif_smurf_in, coalesce(so, 0) AS motif_smurf_out, round(coalesce(CAST(si AS DOUBLE) / n, 0), 6) AS motif_smurf_share FROM (SELECT v AS node, count(*) AS n, count(*) FILTER (WHERE amount BETWEEN 4000 AND 10000) AS si FROM lg GROUP BY 1)
  FULL JOIN (SELECT u AS node, count(*) FILTER (WHERE amount BETWEEN 4000 AND 10000) AS so FROM lg GROUP BY 1) USING (node)""")
def _(s, d):
    return rounded(M.smurf(graph(s, d)), "motif_smurf_share")


@query("lg_value", "SELECT node, CAST(coalesce(i, 0) AS BIGINT) AS lg_val_in, CAST(coalesce(o, 0) AS BIGINT) AS lg_val_out FROM (SELECT v AS node, sum(amount) AS i FROM lg GROUP BY 1) FULL JOIN (SELECT u AS node, sum(amount) AS o FROM lg GROUP BY 1) USING (node)")
def _(s, d):
    return M.values(graph(s, d))


@query("connected_components", "SELECT node, community FROM comp")
def _(s, d):
    return parts(s, d)


@query("k_core")
def _(s, d):
    return G.k_core(G.undirected(graph(s, d), "u", "v", "amount"))


@query("time_resp_distance")
def _(s, d):
    return G.time_respecting_distance(G.pair_edges(transfers(s, d)), accounts(s, d).where("label_exposed = 1"))


@query("betweenness_sampled")
def _(s, d):
    return rounded(G.betweenness(G.undirected(graph(s, d), "u", "v", "amount")), "betweenness")


@query("communities")
def _(s, d):
    return G.louvain(G.undirected(graph(s, d), "u", "v", "amount"))


@query("community_reciprocity", """SELECT community, size AS comm_size, round(coalesce(r, 0), 6) AS comm_reciprocity FROM (SELECT community, count(*) AS size FROM comp GROUP BY 1) LEFT JOIN (SELECT p.community, avg(CASE WHEN b.sender IS NULL THEN 0.0 ELSE 1.0 END) AS r
  FROM (SELECT pairs.sender, pairs.receiver, x.community FROM pairs JOIN comp x ON x.node = pairs.sender JOIN comp y ON y.node = pairs.receiver AND y.community = x.community) p LEFT JOIN pairs b ON b.sender = p.receiver AND b.receiver = p.sender GROUP BY 1) USING (community)""", window=15)
def _(s, d):
    return rounded(G.community_reciprocity(G.pair_edges(transfers(s, d)), groups(s, d)), "comm_reciprocity")


@query("chain_depth")
def _(s, d):
    return M.chain_depth(graph(s, d), WIDE)


@query("stream_state_running", 'SELECT txn_id, v AS node, "minute", count(*) OVER w AS in_deg, CAST(sum(amount) OVER w AS BIGINT) AS in_val FROM lg WINDOW w AS (PARTITION BY v ORDER BY "minute", txn_id ROWS UNBOUNDED PRECEDING)')
def _(s, d):
    return S.running_state(graph(s, d))


def scored_history(s, d) -> DataFrame:
    hist = S.stream_history(graph(s, d), WIDE)
    # reference statistics from the first half of the horizon only
    half = hist.agg(F.percentile_approx("minute", 0.5).alias("m"))
    past = hist.crossJoin(F.broadcast(half)).where("minute <= m").drop("m")  # one row
    return S.stream_scores(hist, R.device_sharing(accounts(s, d)), S.final_state(past))


@query("stream_scores")
def _(s, d):
    return rounded(scored_history(s, d), "score")


@query("flagged_at")
def _(s, d):
    return S.flagged_at(scored_history(s, d), 1.0)


@query("community_table", "SELECT community, size, dwell, round(recip, 6) AS recip, device, round(flowthru, 6) AS flowthru, round(passthru, 6) AS passthru, age, peak_val FROM ctab", window=15)
def _(s, d):
    return rounded(C.community_table(features(s, d), groups(s, d)), "recip", "flowthru", "passthru")


_Z = " + ".join(f"({w}) * (x.{c} - (SELECT avg({c}) FROM ctab)) / coalesce(nullif((SELECT stddev_samp({c}) FROM ctab), 0), 1)" for c, w in C.COMMUNITY_WEIGHTS.items())


@query("community_score", f"SELECT x.community, round({_Z}, 6) AS score FROM ctab x", window=15)
def _(s, d):
    return rounded(C.community_scores(C.community_table(features(s, d), groups(s, d))).select("community", "score"), "score")


@query("community_score_louvain")
def _(s, d):
    return rounded(C.community_scores(C.community_table(features(s, d), member_communities(graph(s, d)))).select("community", "score"), "score")


@query("community_purity", "SELECT community, count(*) AS n, CAST(sum(is_mule) AS BIGINT) AS mules, round(avg(is_mule), 6) AS purity FROM comp JOIN acc ON account_id = node GROUP BY 1", window=15)
def _(s, d):
    return rounded(C.purity(accounts(s, d), groups(s, d)), "purity")


@query("rules_baseline", "SELECT account_id, CAST(score AS DOUBLE) AS score FROM rules")
def _(s, d):
    return rules(s, d)


@query("precision_recall_at_k", """SELECT round(avg(is_mule), 6) AS precision_at_k, round(CAST(sum(is_mule) AS DOUBLE) / greatest((SELECT sum(is_mule) FROM acc), 1), 6) AS recall_at_k, CAST(sum(is_mule) AS BIGINT) AS hits, CAST((SELECT sum(is_mule) FROM acc) AS BIGINT) AS mules,
  round((SELECT avg(is_mule) FROM acc), 6) AS base_rate FROM top""", k=K)
def _(s, d):
    return rounded(D.precision_recall(rules(s, d), accounts(s, d), K), "precision_at_k", "recall_at_k", "base_rate")


@query("networks_hit", "SELECT (SELECT count(DISTINCT x) FROM (SELECT unnest(string_split(mule_network_id, '|')) AS x FROM top) WHERE x <> '') AS networks_hit, (SELECT count(DISTINCT x) FROM (SELECT unnest(string_split(mule_network_id, '|')) AS x FROM acc) WHERE x <> '') AS networks", k=K)
def _(s, d):
    return D.networks_hit(rules(s, d), accounts(s, d), K)


_CONF = "account_type IN ('small_shop', 'group_collector', 'gig_aggregator', 'informal_lender')"


@query("confounder_share", f"SELECT round(avg(CASE WHEN {_CONF} THEN 1.0 ELSE 0.0 END), 6) AS confounder_share, count(*) FILTER (WHERE {_CONF}) AS confounders FROM top", k=K)
def _(s, d):
    return rounded(D.confounder_share(rules(s, d), accounts(s, d), K), "confounder_share")


@query("univariate_auc", """SELECT round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS auc_free FROM (SELECT (sum(CASE WHEN is_mule = 1 THEN r END) - p * (p + 1) / 2.0) / (p * (max(n) - p)) AS auc FROM (
  SELECT is_mule, sum(is_mule) OVER () AS p, count(*) OVER () AS n, rank() OVER (ORDER BY fan_in) + (count(*) OVER (PARTITION BY fan_in) - 1) / 2.0 AS r FROM feat) GROUP BY p)""")
def _(s, d):
    return rounded(D.auc(features(s, d).select("is_mule", F.col("fan_in").alias("value"))), "auc", "auc_free")


def network_features(s, d) -> DataFrame:
    """Features with motifs, the score of each account's community, and its place in the pair graph."""
    e, acc, f = graph(s, d), accounts(s, d), features(s, d)
    comm = Scratch(s, "communities").save(member_communities(e), "communities")  # read three times below
    scored = C.community_scores(C.community_table(f, comm))
    pairs = Scratch(s, "pairs").save(G.pair_edges(transfers(s, d)), "pairs")
    both = G.hold(G.undirected(pairs, "sender", "receiver", "w"))  # cores and centrality walk the same links
    mutual = G.community_reciprocity(pairs, comm).join(comm, "community").select(F.col("node").alias("account_id"), "comm_size", "comm_reciprocity")
    x = f.join(C.member_scores(acc, comm, scored), "account_id").join(M.motif_features(e, acc, WIDE), "account_id").join(mutual, "account_id", "left")
    for g in (G.k_core(both), G.betweenness(both)):
        x = x.join(g.withColumnRenamed("node", "account_id"), "account_id", "left")
    out = Scratch(s, "network").save(x.fillna(0), "features")
    if both.shared is not None:
        both.shared.destroy()
    return out


def final_of(e: DataFrame, acc: DataFrame, f: DataFrame, p: Params = WIDE) -> DataFrame:
    comm = Scratch(e.sparkSession, "communities").save(member_communities(e), "communities")  # read twice below
    scored = C.community_scores(C.community_table(f, comm))
    return D.final_score(C.member_scores(acc, comm, scored).join(M.motif_features(e, acc, p), "account_id"))


@query("final_score")
def _(s, d):
    return rounded(final_of(graph(s, d), accounts(s, d), features(s, d)), "score")


ISO = ["p10_dwell", "fast_flowthru_n", "med_matched_passthru", "reciprocity", "device_shared_by", "peak_window_passthru", "age_min_at_first_txn", "stranger_in_share", "fan_in", "fan_out", "burstiness", "comm_reciprocity", "betweenness"]
PRIOR = {"p10_dwell": -1.0, "fast_flowthru_n": 1.0, "device_shared_by": 1.0, "reciprocity": -1.0, "comm_reciprocity": -1.0, "age_min_at_first_txn": -1.0, "betweenness": 1.0}
ACTIVITY = ["n_txn", "tot_in", "tot_out", "in_n", "out_n"]
#: Labels, ids and groups are no features.
NOT_FEATURES = ("account_id", "account_type", "open_day", "device_id", "is_mule", "is_exit", "label_exposed", "mule_network_id")


@query("iso_score")
def _(s, d):
    return rounded(D.unsupervised_score(network_features(s, d), ISO, PRIOR), "score")


@query("gbm_oof")
def _(s, d):
    return D.gbm_out_of_fold(network_features(s, d), ISO)[0]


@query("gbm_importances")
def _(s, d):
    got = D.gbm_out_of_fold(features(s, d), ACTIVITY)[1]
    return s.createDataFrame(sorted(got.items()), "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(12)


@query("leaderboard")
def _(s, d):
    f = network_features(s, d)
    every = [c for c in f.columns if c not in NOT_FEATURES]
    scores = {
        "random": f.select("account_id", (F.pmod(F.xxhash64("account_id"), F.lit(1 << 20)) / (1 << 20)).alias("score")), "rules": D.rules_baseline(f), "unsupervised": D.unsupervised_score(f, ISO, PRIOR),
        "gbm_all": D.gbm_out_of_fold(f, every)[0], "gbm_curated": D.gbm_out_of_fold(f, ISO)[0], "gbm_activity": D.gbm_out_of_fold(f, ACTIVITY)[0],
        "community": f.select("account_id", F.col("comm_score").alias("score")), "final": D.final_score(f),
    }
    both = None
    for name, one in scores.items():
        one = one.select(F.lit(name).alias("detector"), "account_id", F.col("score").cast("double").alias("score"))
        both = one if both is None else both.unionByName(one)
    return D.leaderboard(Scratch(s, "scores").save(both, "scores"), accounts(s, d), K)


@query("motif_features")
def _(s, d):
    return M.motif_features(graph(s, d), accounts(s, d), WIDE)


def tiers(s, d) -> DataFrame:
    cuts = s.sql("SELECT * FROM VALUES ('freeze', 2D), ('hold', 1.2D), ('throttle', 0.5D) AS t(tier, cut)")  # within the range of scores on the test tables
    return S.assign(rules(s, d), cuts)


@query("calibrate_bands")
def _(s, d):
    return S.calibrate(rules(s, d), accounts(s, d))


@query("assign_tiers", "SELECT account_id, CAST(score AS DOUBLE) AS score, tier FROM tiered")
def _(s, d):
    return tiers(s, d)


@query("tier_report", f"""SELECT tier, count(*) AS accounts, CAST(sum(is_mule) AS BIGINT) AS mules, round(avg(is_mule), 3) AS "precision", CAST(sum(1 - is_mule) AS BIGINT) AS innocent, count(*) FILTER (WHERE {_CONF}) AS confounders FROM tiered WHERE tier <> 'none' GROUP BY tier""")
def _(s, d):
    return S.tier_report(tiers(s, d), accounts(s, d))


@query("taint_replay")
def _(s, d):
    return S.taint_replay(transfers(s, d), accounts(s, d), S.flagged_at(scored_history(s, d), 1.0))


@query("taint_totals")
def _(s, d):
    return S.replay_totals(QUERIES["taint_replay"](s, d))


@query("evidence_codes", "SELECT account_id, code, percentile FROM ev")
def _(s, d):
    return A.with_evidence(features(s, d)).select("account_id", F.explode("evidence").alias("e")).select("account_id", "e.code", "e.percentile")


@query("evidence_code_counts", "SELECT code, count(*) AS n FROM ev JOIN tiered USING (account_id) WHERE tier <> 'none' GROUP BY code")
def _(s, d):
    return A.evidence_counts(A.build_alerts(tiers(s, d), features(s, d)))


@query("alert_payload", f"""SELECT 'transfer-network-alert/0.1' AS "schema", 'acct_' || substr(sha256('{Params().salt}' || account_id), 1, 16) AS account_ref, tier AS risk_tier, round(p, 4) AS score_percentile, 'acct_' || substr(sha256('{Params().salt}' || 'net:'), 1, 16) AS network_ref,
  (SELECT count(*) FROM ev WHERE ev.account_id = act.account_id) AS n_evidence, CASE tier {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items())} END AS recommended_action, '{BASIS}' AS basis, false AS contains_pii
  FROM act WHERE tier <> 'none' AND account_id IN (SELECT account_id FROM ev)""")
def _(s, d):
    return A.build_alerts(tiers(s, d), features(s, d)).withColumn("n_evidence", F.size("evidence").cast("long")).drop("evidence", "network_size")


@query("score_percentile", "SELECT account_id, tier, round(p, 6) AS percentile FROM act")
def _(s, d):
    return rounded(percentile_below(tiers(s, d), "score", "percentile").select("account_id", "tier", "percentile"), "percentile")


@query("cash_out_value", "SELECT CAST(coalesce(sum(amount), 0) AS BIGINT) AS cash_out, count(*) AS transfers FROM tx WHERE receiver IN (SELECT account_id FROM acc WHERE is_exit = 1)")
def _(s, d):
    return T.cash_out(transfers(s, d), accounts(s, d))


@query("channel_totals", 'SELECT channel, count(*) AS transfers, CAST(sum(amount) AS BIGINT) AS value, min("minute") AS first_minute, max("minute") AS last_minute FROM tx GROUP BY channel')
def _(s, d):
    return T.channel_totals(transfers(s, d))


@query("time_span", 'SELECT min("minute") AS first_minute, max("minute") AS last_minute, count(*) AS transfers FROM tx')
def _(s, d):
    return T.time_span(transfers(s, d))


@query("running_peak", 'SELECT txn_id, v AS node, "minute", max(amount) OVER (PARTITION BY v ORDER BY "minute" RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM flow')
def _(s, d):
    return S.running_peak(W.flow_edges(transfers(s, d), WIDE), "v", "amount")


@query("running_peak_score")
def _(s, d):
    return rounded(S.running_peak(scored_history(s, d), "node", "score"), "peak")


@query("tier_members", "SELECT account_id, CAST(score AS DOUBLE) AS score, is_mule, account_type FROM tiered WHERE tier = 'freeze'")
def _(s, d):
    return A.tier_members(tiers(s, d), accounts(s, d), "freeze", truth=True)


@query("taint_replay_receiver")
def _(s, d):
    return S.taint_replay(transfers(s, d), accounts(s, d), S.flagged_at(scored_history(s, d), 1.0), block_on="receiver")


@query("caught_by_half_time")
def _(s, d):
    tx, scored = transfers(s, d), Scratch(s, "scored").save(scored_history(s, d), "history")  # read twice below
    half = tx.agg(((F.min("minute") + F.max("minute")) / 2).cast("long").alias("m")).first().m
    ours = scored.groupBy(F.col("node").alias("account_id")).agg(F.max("score").alias("score"))
    return T.caught(tx, ours, rules(s, d), S.flagged_at(scored, 1.0), accounts(s, d), half, K)
