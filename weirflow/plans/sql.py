"""The same definitions as SQL, composed from named common table expressions."""

from __future__ import annotations

from weirflow.operators.alerts import ACTIONS, BASIS
from weirflow.schema import KINDS, Params

P = Params()
KIND_LIST = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"

CTES = {
    "n": "SELECT count(DISTINCT user_id) AS n FROM events",
    "tx": """SELECT event_id AS txn_id, date_diff('minute', timestamp '2024-01-01', date_trunc('minute', ts)) AS "minute", user_id AS sender, (user_id * 31 + event_id * 7 + 1) % n AS receiver,
      CAST(round(value * 1000) AS BIGINT) AS amount, CASE WHEN event_type = 'signup' THEN 'P2M' ELSE 'P2P' END AS channel FROM events, n WHERE user_id <> (user_id * 31 + event_id * 7 + 1) % n""",
    "acc": f"""SELECT user_id AS account_id, ({KIND_LIST})[user_id % 11 + 1] AS account_type, CAST(-(user_id * 37 % 2500) AS INTEGER) AS open_day, user_id % greatest(1, n // 3) AS device_id,
      CAST(user_id % 11 IN (1, 10) AS INTEGER) AS is_mule, CAST(user_id % 11 = 1 AS INTEGER) AS is_exit, CAST(user_id % 11 IN (1, 10) AND user_id % 7 = 0 AS INTEGER) AS label_exposed,
      CASE WHEN user_id % 11 NOT IN (1, 10) THEN '' WHEN user_id % 4 = 0 THEN 'NET' || user_id % 5 || '|NET' || (user_id + 3) % 5 ELSE 'NET' || user_id % 5 END AS mule_network_id
      FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL), n""",
    "led": 'SELECT receiver AS acct, "minute", txn_id, 1 AS sgn, amount, channel FROM tx UNION ALL SELECT sender, "minute", txn_id, -1, amount, channel FROM tx',
    "p2p": "SELECT * FROM tx WHERE channel = 'P2P'",
    "b1": """SELECT *, min(CASE WHEN sgn = -1 THEN "minute" END) OVER (PARTITION BY acct ORDER BY "minute" RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt,
      coalesce(sum(CASE WHEN sgn = -1 THEN amount END) OVER (PARTITION BY acct ORDER BY "minute" RANGE BETWEEN CURRENT ROW AND 180 FOLLOWING), 0) AS outv FROM led""",
    "cr": 'SELECT acct, nxt - "minute" AS dwell, least(1.5, CAST(outv AS DOUBLE) / greatest(amount, 1)) AS ratio FROM b1 WHERE sgn = 1',
    "credit": """SELECT acct, coalesce(CAST(min(dwell) AS DOUBLE), 1e5) AS min_dwell, coalesce(quantile_cont(dwell, 0.1), 1e5) AS p10_dwell, count(*) FILTER (WHERE ratio > 0.75 AND dwell < 30) AS fast_flowthru_n,
      median(ratio) AS med_matched_passthru FROM cr GROUP BY acct""",
    "pk0": """SELECT acct, "minute", txn_id, sgn, count(*) OVER w AS c, coalesce(sum(CASE WHEN sgn = 1 THEN amount END) OVER w, 0) AS iv, coalesce(sum(CASE WHEN sgn = -1 THEN amount END) OVER w, 0) AS ov,
      count(CASE WHEN sgn = 1 THEN 1 END) OVER w AS n_in, count(CASE WHEN sgn = -1 THEN 1 END) OVER w AS n_out FROM led WINDOW w AS (PARTITION BY acct ORDER BY "minute" RANGE BETWEEN 60 PRECEDING AND 60 FOLLOWING)""",
    "peak": """SELECT acct, CAST(iv AS BIGINT) AS peak_in_val, n_in AS peak_in_n, n_out AS peak_out_n, CASE WHEN iv > 0 THEN CAST(ov AS DOUBLE) / iv ELSE 0 END AS peak_window_passthru FROM (
      SELECT *, row_number() OVER (PARTITION BY acct ORDER BY c DESC, "minute", txn_id, sgn) AS rn, count(*) OVER (PARTITION BY acct) AS ev FROM pk0) WHERE rn = 1 AND ev > 1""",
    "burst": """SELECT acct, stddev_pop(g) / (avg(g) + 1e-9) AS burstiness FROM (SELECT acct, "minute" - lag("minute") OVER (PARTITION BY acct ORDER BY "minute", txn_id, sgn) AS g FROM led) GROUP BY acct HAVING count(g) > 0""",
    "tot": """SELECT acct, count(*) AS n_txn, CAST(coalesce(sum(CASE WHEN sgn = 1 THEN amount END), 0) AS BIGINT) AS tot_in, CAST(coalesce(sum(CASE WHEN sgn = -1 THEN amount END), 0) AS BIGINT) AS tot_out,
      avg(CASE WHEN "minute" % 1440 < 360 OR "minute" % 1440 > 1320 THEN 1.0 ELSE 0.0 END) AS night_share FROM led GROUP BY acct""",
    "fi": "SELECT receiver AS account_id, count(DISTINCT sender) AS fan_in, count(*) AS in_n FROM tx GROUP BY 1",
    "fo": "SELECT sender AS account_id, count(DISTINCT receiver) AS fan_out, count(*) AS out_n FROM tx GROUP BY 1",
    "fans": "SELECT account_id, coalesce(fan_in, 0) AS fan_in, coalesce(in_n, 0) AS in_n, coalesce(fan_out, 0) AS fan_out, coalesce(out_n, 0) AS out_n FROM fi FULL JOIN fo USING (account_id)",
    "ed": "SELECT DISTINCT sender AS u, receiver AS v FROM tx",
    "recip": """SELECT a AS account_id, avg(m) AS reciprocity FROM (SELECT a, b, CASE WHEN count(*) = 2 THEN 1.0 ELSE 0.0 END AS m FROM (SELECT u AS a, v AS b FROM ed UNION ALL SELECT v, u FROM ed) GROUP BY a, b) GROUP BY a""",
    "strange": """SELECT receiver AS account_id, CAST(sum(CASE WHEN rn = 1 THEN amount ELSE 0 END) AS DOUBLE) / sum(amount) AS stranger_in_share FROM (
      SELECT receiver, amount, row_number() OVER (PARTITION BY receiver, sender ORDER BY "minute", txn_id) AS rn FROM tx) GROUP BY 1""",
    "dev": "SELECT account_id, count(*) OVER (PARTITION BY device_id) AS device_shared_by FROM acc",
    "age": 'SELECT account_id, -CAST(open_day AS BIGINT) * 1440 + coalesce(m, 0) AS age_min_at_first_txn FROM acc LEFT JOIN (SELECT receiver AS account_id, min("minute") AS m FROM tx GROUP BY 1) USING (account_id)',
    "feat": """SELECT acc.account_id, account_type, is_mule, mule_network_id, coalesce(p10_dwell, 1e5) AS p10_dwell, coalesce(fast_flowthru_n, 0) AS fast_flowthru_n, coalesce(med_matched_passthru, 0) AS med_matched_passthru,
      coalesce(peak_in_val, 0) AS peak_in_val, coalesce(fan_in, 0) AS fan_in, coalesce(reciprocity, 0) AS reciprocity, coalesce(stranger_in_share, 0) AS stranger_in_share, device_shared_by, age_min_at_first_txn
      FROM acc LEFT JOIN credit ON credit.acct = acc.account_id LEFT JOIN peak ON peak.acct = acc.account_id LEFT JOIN fans ON fans.account_id = acc.account_id LEFT JOIN recip ON recip.account_id = acc.account_id
      LEFT JOIN strange ON strange.account_id = acc.account_id JOIN dev ON dev.account_id = acc.account_id JOIN age ON age.account_id = acc.account_id""",
    "pairs": 'SELECT sender, receiver, CAST(sum(amount) AS BIGINT) AS w, count(*) AS k, min("minute") AS t_first, max("minute") AS t_last FROM p2p GROUP BY 1, 2 HAVING sum(amount) >= 1000',
    "a": "SELECT DISTINCT u, v FROM lg",
    "comp": "SELECT x AS node, min(r) AS community FROM reach GROUP BY x",
    "rules": """SELECT account_id, is_mule, account_type, mule_network_id, 2.0 * CAST(p10_dwell < 15 AS INTEGER) + 2.0 * CAST(med_matched_passthru > 0.75 AS INTEGER) + 1.5 * CAST(fan_in > (SELECT quantile_cont(fan_in, 0.9) FROM feat) AS INTEGER)
      + 1.5 * CAST(peak_in_val > (SELECT quantile_cont(peak_in_val, 0.95) FROM feat) AS INTEGER) + 1.0 * CAST(age_min_at_first_txn < 129600 AS INTEGER) + 1.0 * CAST(stranger_in_share > 0.8 AS INTEGER) AS score FROM feat""",
    "top": "SELECT * FROM rules ORDER BY score DESC, account_id LIMIT {k}",
    "tiered": "SELECT *, CASE WHEN score > 2 THEN 'freeze' WHEN score > 1.2 THEN 'hold' WHEN score > 0.5 THEN 'throttle' ELSE 'none' END AS tier FROM rules",
    "ctab": """SELECT community, count(*) AS size, median(p10_dwell) AS dwell, avg(reciprocity) AS recip, max(device_shared_by) AS device, avg(fast_flowthru_n) AS flowthru, avg(med_matched_passthru) AS passthru, CAST(median(age_min_at_first_txn) AS DOUBLE) AS age,
      CAST(sum(peak_in_val) AS BIGINT) AS peak_val FROM feat JOIN comp ON node = account_id GROUP BY community HAVING count(*) BETWEEN 4 AND 200""",
    "pct": """SELECT feat.*, (rank() OVER (ORDER BY p10_dwell) - 1) / CAST(count(*) OVER () AS DOUBLE) AS q1, (rank() OVER (ORDER BY fast_flowthru_n) - 1) / CAST(count(*) OVER () AS DOUBLE) AS q2, (rank() OVER (ORDER BY reciprocity) - 1) / CAST(count(*) OVER () AS DOUBLE) AS q3,
      (rank() OVER (ORDER BY device_shared_by) - 1) / CAST(count(*) OVER () AS DOUBLE) AS q4, (rank() OVER (ORDER BY age_min_at_first_txn) - 1) / CAST(count(*) OVER () AS DOUBLE) AS q5, (rank() OVER (ORDER BY stranger_in_share) - 1) / CAST(count(*) OVER () AS DOUBLE) AS q6 FROM feat""",
    "ev": """SELECT account_id, 'FAST_EMPTY' AS code, round(q1, 3) AS percentile FROM pct WHERE q1 < 0.03 UNION ALL SELECT account_id, 'FLOW_THROUGH', round(q2, 3) FROM pct WHERE q2 > 0.97 UNION ALL SELECT account_id, 'NO_RECIPROCITY', round(q3, 3) FROM pct WHERE q3 < 0.03
      UNION ALL SELECT account_id, 'DEVICE_REUSE', round(q4, 3) FROM pct WHERE q4 > 0.97 UNION ALL SELECT account_id, 'NEW_ACCOUNT', round(q5, 3) FROM pct WHERE q5 < 0.03 UNION ALL SELECT account_id, 'STRANGER_FUNDED', round(q6, 3) FROM pct WHERE q6 > 0.97""",
    "act": "SELECT *, (rank() OVER (ORDER BY score) - 1) / CAST(count(*) OVER () AS DOUBLE) AS p FROM tiered",
}


def flow_ctes(window: int) -> dict[str, str]:
    return {
        "flow": f"""SELECT p.txn_id, p.sender AS u, p.receiver AS v, p.amount, p."minute" FROM p2p p JOIN (SELECT txn_id, sgn, amount, sum(CASE WHEN sgn = -1 THEN amount ELSE 0 END) OVER (PARTITION BY acct ORDER BY "minute" RANGE BETWEEN CURRENT ROW AND {window} FOLLOWING) AS moved
          FROM led WHERE channel = 'P2P') f ON f.txn_id = p.txn_id AND f.sgn = 1 WHERE p.amount >= 5000 AND 10 * f.moved >= 8 * p.amount""",
        "nodes": "SELECT u AS x FROM flow UNION SELECT v FROM flow",
        "term": f"""SELECT p.txn_id, p.sender AS u, p.receiver AS v, p.amount, p."minute" FROM p2p p WHERE p.amount >= 5000 AND p.txn_id NOT IN (SELECT txn_id FROM flow) AND p.sender IN (SELECT x FROM nodes) AND p.receiver NOT IN (SELECT x FROM nodes)
          AND EXISTS (SELECT 1 FROM flow f WHERE f.v = p.sender AND f."minute" BETWEEN p."minute" - {window} AND p."minute")""",
        "lg": "SELECT *, 'flow' AS kind FROM flow UNION ALL SELECT *, 'terminal' AS kind FROM term",
        "reach": "SELECT u AS x, u AS r FROM lg UNION SELECT v, v FROM lg UNION SELECT e.y, reach.r FROM reach JOIN (SELECT u AS x, v AS y FROM lg UNION SELECT v, u FROM lg) e ON e.x = reach.x",
    }


def sql(final: str, window: int = 120, k: int = 20) -> str:
    """``final`` after the expressions it needs, directly or not, in order of definition."""
    import re

    every = {**{x: CTES[x] for x in ("n", "tx", "acc", "led", "p2p")}, **flow_ctes(window), **{x: v for x, v in CTES.items() if x not in ("n", "tx", "acc", "led", "p2p")}}
    need, todo = set(), [final]
    while todo:
        t = todo.pop()
        for x in every:
            if x not in need and re.search(rf"\b(FROM|JOIN|,)\s*\(?{x}\b", t):
                need.add(x)
                todo.append(every[x])
    body = ", ".join(f"{x} AS ({v.replace('{k}', str(k))})" for x, v in every.items() if x in need)
    return f"WITH RECURSIVE {body} {final}" if need else final


__all__ = ["ACTIONS", "BASIS", "sql"]
