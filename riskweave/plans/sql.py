"""Building blocks of the SQL statements the queries are checked against (DuckDB dialect).

Each block is a named common table expression; ``sql`` puts the blocks a statement
needs, in dependency order, in front of it. Blocks ending in ``_l`` work on all
transfers between the wallets of small cells, ``w_`` blocks on the trailing 24 hours; ``tx_h`` has the large transfers.
"""

from __future__ import annotations

import re

BLOCKS: dict[str, str] = {}


def block(name: str, text: str) -> None:
    BLOCKS[name] = text


def sql(statement: str, **local: str) -> str:
    """``statement`` after every block it mentions, directly or through other blocks; ``local`` adds blocks."""
    blocks = {**BLOCKS, **local}
    done: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        words = set(re.findall(r"[a-z_0-9]+", text))
        for name in blocks:
            if name in words and name not in done and name not in path:
                visit(blocks[name], (*path, name))
                done.append(name)

    visit(statement, ())
    if not done:
        return statement
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({blocks[n]})" for n in done) + "\n" + statement


def D(**cols: str) -> list[str]:
    """Double columns, six decimals."""
    return [f"round(CAST({e} AS DOUBLE), 6) + 0.0 AS {n}" for n, e in cols.items()]


def I(**cols: str) -> list[str]:  # noqa: E743
    """Whole-number columns."""
    return [f"CAST({e} AS BIGINT) AS {n}" for n, e in cols.items()]


def S(**cols: str) -> list[str]:
    """Columns taken as they are."""
    return [f"{e} AS {n}" for n, e in cols.items()]


def T(**cols: str) -> list[str]:
    """Time columns as microseconds."""
    return [f"epoch_us({e}) AS {n}" for n, e in cols.items()]


def select(*cols: list[str], tail: str, **local: str) -> str:
    return sql("SELECT " + ", ".join(c for part in cols for c in part) + " " + tail, **local)


block("tx_a", """
SELECT concat('tx_', event_id) AS transaction_id,
  concat('w', user_id * 1000 + event_id % 7) AS sender_wallet,
  concat('w', ((user_id * 7 + event_id) % u.n) * 1000 + CAST(floor(event_id / 7.0) AS BIGINT) % 7) AS receiver_wallet,
  round(value * 100, 0) AS amount, ts AS timestamp, round(value * (event_id % 5) * 0.01, 4) AS fee,
  event_type AS asset_type, CASE WHEN user_id % 10 = 0 THEN 'bitcoin' ELSE 'ethereum' END AS chain_id,
  CASE WHEN event_type = 'error' AND value >= 120 THEN 'illicit'
       WHEN event_type IN ('purchase', 'signup') THEN 'licit' END AS label,
  event_id AS ord
FROM events CROSS JOIN (SELECT count(DISTINCT user_id) AS n FROM events) u""")
block("tx_h", "SELECT * FROM tx_a WHERE amount >= 15000")
block("tx_l", """
SELECT t.* REPLACE (concat('v', CAST(floor(ord / 20.0) AS BIGINT) * 10 + user_id % 7) AS sender_wallet,
  concat('v', (CAST(floor(ord / 20.0) AS BIGINT) + CASE WHEN ord % 40 = 0 THEN 1 ELSE 0 END) * 10 + (user_id * 3 + ord) % 7) AS receiver_wallet)
FROM tx_a t JOIN (SELECT event_id, user_id FROM events) e ON e.event_id = t.ord""")
block("tx_w", "SELECT * FROM tx_a WHERE timestamp >= (SELECT max(timestamp) FROM tx_a) - INTERVAL 24 HOUR")

for s in ("a", "l", "w"):
    block(f"ed_{s}", f"""
SELECT sender_wallet AS src, receiver_wallet AS dst, sum(amount) AS amount, max(timestamp) AS timestamp,
  count(*) AS n_tx, arg_max(transaction_id, ord) AS transaction_id, arg_max(asset_type, ord) AS asset_type
FROM tx_{s} WHERE sender_wallet <> receiver_wallet GROUP BY 1, 2""")
    block(f"nd_{s}", f"SELECT src AS wallet FROM ed_{s} UNION SELECT dst FROM ed_{s}")
    block(f"nb_{s}", f"SELECT src AS wallet, dst AS nb FROM ed_{s} UNION SELECT dst, src FROM ed_{s}")
    block(f"nm_{s}", f"""
SELECT n.wallet, coalesce(i.d, 0) AS in_degree, coalesce(o.d, 0) AS out_degree, coalesce(i.a, 0.0) AS weighted_in,
  coalesce(o.a, 0.0) AS weighted_out, coalesce(i.a, 0.0) + coalesce(o.a, 0.0) AS total_volume,
  CASE WHEN coalesce(i.a, 0) + coalesce(o.a, 0) <> 0
       THEN (coalesce(i.a, 0) - coalesce(o.a, 0)) / (coalesce(i.a, 0) + coalesce(o.a, 0)) ELSE 0 END AS balance_ratio
FROM nd_{s} n LEFT JOIN (SELECT dst, count(*) d, sum(amount) a FROM ed_{s} GROUP BY 1) i ON i.dst = n.wallet
LEFT JOIN (SELECT src, count(*) d, sum(amount) a FROM ed_{s} GROUP BY 1) o ON o.src = n.wallet""")
    block(f"st_{s}", f"""
SELECT m.*, c.cp AS unique_counterparties, in_degree / (in_degree + out_degree + 1) AS fan_in_ratio,
  out_degree / (in_degree + out_degree + 1) AS fan_out_ratio,
  CASE WHEN max(in_degree * out_degree / (total_volume + 1)) OVER () > 0
       THEN in_degree * out_degree / (total_volume + 1) / max(in_degree * out_degree / (total_volume + 1)) OVER ()
       ELSE 0 END AS relay_pattern_score
FROM nm_{s} m JOIN (SELECT wallet, count(*) cp FROM nb_{s} GROUP BY 1) c USING (wallet)""")
    block(f"ro_{s}", f"""
SELECT sender_wallet AS wallet, timestamp, ord, amount AS sent, 0::DOUBLE AS received, amount FROM tx_{s}
UNION ALL SELECT receiver_wallet, timestamp, ord, 0::DOUBLE, amount, amount FROM tx_{s}""")
    block(f"pf_{s}", f"""
SELECT p.*, coalesce(m.in_degree, 0) AS in_degree, coalesce(m.out_degree, 0) AS out_degree, m.wallet IS NOT NULL AS in_graph,
  CASE WHEN total_in > 0 THEN total_out / total_in ELSE 0 END AS pass_through, greatest(total_in - total_out, 0) AS balance
FROM (SELECT wallet, sum(received) AS total_in, sum(sent) AS total_out, count(*) AS tx_count,
        count(*) FILTER (amount > 0 AND amount < 10000) AS n_below_10000,
        count(*) FILTER (amount > 0 AND amount < 3000) AS n_below_3000,
        count(*) FILTER (amount <> 0 AND amount % 100 = 0) AS n_round_100, avg(amount) AS avg_amount,
        min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM ro_{s} GROUP BY 1) p
LEFT JOIN nm_{s} m USING (wallet)""")
    # ego links a -> b between neighbours of w
    block(f"eg_{s}", f"""
SELECT x.wallet AS w, e.src AS a, e.dst AS b,
  EXISTS (SELECT 1 FROM ed_{s} q WHERE q.src = x.wallet AND q.dst = e.src) AS starts,
  EXISTS (SELECT 1 FROM ed_{s} q WHERE q.src = e.dst AND q.dst = x.wallet) AS ends
FROM nb_{s} x JOIN ed_{s} e ON e.src = x.nb JOIN nb_{s} y ON y.wallet = x.wallet AND y.nb = e.dst""")
    block(f"cy_{s}", f"""
SELECT n.wallet, coalesce(c2, 0) AS c2, coalesce(c3, 0) AS c3, coalesce(c4, 0) AS c4, coalesce(c5, 0) AS c5, coalesce(c6, 0) AS c6
FROM nd_{s} n
LEFT JOIN (SELECT p.src w, count(*) c2 FROM ed_{s} p JOIN ed_{s} q ON q.src = p.dst AND q.dst = p.src GROUP BY 1) t2 ON t2.w = n.wallet
LEFT JOIN (SELECT w, count(*) c3 FROM eg_{s} WHERE starts AND ends GROUP BY 1) t3 ON t3.w = n.wallet
LEFT JOIN (SELECT p.w, count(*) c4 FROM eg_{s} p JOIN eg_{s} q ON q.w = p.w AND q.a = p.b
           WHERE p.starts AND q.ends AND q.b <> p.a GROUP BY 1) t4 ON t4.w = n.wallet
LEFT JOIN (SELECT p.w, count(*) c5 FROM eg_{s} p JOIN eg_{s} m ON m.w = p.w AND m.a = p.b AND m.b <> p.a
           JOIN eg_{s} q ON q.w = p.w AND q.a = m.b
           WHERE p.starts AND q.ends AND q.b <> p.a AND q.b <> p.b GROUP BY 1) t5 ON t5.w = n.wallet
LEFT JOIN (SELECT p.w, count(*) c6 FROM eg_{s} p JOIN eg_{s} m ON m.w = p.w AND m.a = p.b AND m.b <> p.a
           JOIN eg_{s} k ON k.w = p.w AND k.a = m.b AND k.b <> p.a AND k.b <> p.b
           JOIN eg_{s} q ON q.w = p.w AND q.a = k.b
           WHERE p.starts AND q.ends AND q.b <> p.a AND q.b <> p.b AND q.b <> m.b GROUP BY 1) t6 ON t6.w = n.wallet""")
    block(f"pe_{s}", f"""
SELECT src AS wallet, count(*) AS peel_edges, count(*) FILTER (amount < pa) AS peel_drops
FROM (SELECT *, lag(amount) OVER (PARTITION BY src ORDER BY timestamp, dst) pa FROM ed_{s}) GROUP BY 1""")
    # connected components: the smallest wallet floods the graph
    block(f"cf_{s}", f"""
SELECT wallet, wallet AS lab, 0 AS k FROM nd_{s}
UNION ALL
SELECT n.wallet, min(least(f.lab, g.lab)), f.k + 1 FROM cf_{s} f JOIN nb_{s} n ON n.wallet = f.wallet
JOIN cf_{s} g ON g.wallet = n.nb WHERE f.k < 60 GROUP BY n.wallet, f.k""")
    block(f"cc_{s}", f"SELECT wallet, lab AS component FROM cf_{s} WHERE k = 60")

    block(f"rc_{s}", f"""
SELECT p.wallet, p.in_degree, p.out_degree,
  CASE WHEN n_below_10000 / tx_count > 0.7 AND n_below_10000 >= 3 THEN n_below_10000 / tx_count ELSE 0 END AS c1,
  CASE WHEN p.in_degree >= 10 THEN least(p.in_degree / 20, 1) ELSE 0 END AS c4,
  CASE WHEN n_round_100 / tx_count > 0.6 AND n_round_100 >= 3 THEN n_round_100 / tx_count ELSE 0 END AS c5,
  CASE WHEN avg_amount <> 0 AND balance / avg_amount < 0.1 THEN least(1 - balance / avg_amount, 1) ELSE 0 END AS c6,
  CASE WHEN c2 + c3 + c4 > 0 THEN least((c2 + c3 + c4) / 5, 1) ELSE 0 END AS c17,
  CASE WHEN p.in_degree >= 8 AND p.out_degree >= 8 THEN least((p.in_degree + p.out_degree) / 40, 1) ELSE 0 END AS c21,
  CASE WHEN p.in_degree >= 10
       THEN least(least(p.in_degree / 20, 1) + CASE WHEN total_in <> 0 AND total_out / total_in > 0.9 THEN 0.2 ELSE 0 END, 1) ELSE 0 END AS c22,
  CASE WHEN total_in <> 0 AND total_out / total_in > 0.9 THEN least(total_out / total_in, 1) ELSE 0 END AS c23,
  CASE WHEN c2 + c3 > 0 THEN least((c2 + c3) / 3, 1) ELSE 0 END AS c26,
  CASE WHEN n_below_3000 / tx_count > 0.7 AND n_below_3000 >= 3 THEN n_below_3000 / tx_count ELSE 0 END AS c35,
  CASE WHEN peel_edges >= 3 AND peel_drops / (peel_edges - 1) > 0.7 THEN peel_drops / (peel_edges - 1) ELSE 0 END AS c91,
  CASE WHEN p.out_degree >= 5 THEN least(p.out_degree / 30, 1) ELSE 0 END AS c92,
  CASE WHEN p.in_degree >= 5 THEN least(p.in_degree / 30, 1) ELSE 0 END AS c93,
  CASE WHEN floor(epoch((SELECT max(timestamp) FROM tx_{s}) - first_seen) / 86400) <= 7 AND total_in + total_out >= 1000
       THEN CASE WHEN total_in <> 0 AND total_out / total_in > 0.9 THEN 0.9 ELSE 0.6 END ELSE 0 END AS c94,
  CASE WHEN n_below_10000 / tx_count > 0.7 AND n_below_10000 >= 3 THEN n_below_10000 / tx_count ELSE 0 END AS c99,
  CASE WHEN p.in_degree >= 15 THEN least(p.in_degree / 20, 1) ELSE 0 END AS c100,
  CASE WHEN c2 + c3 + c4 + c5 + c6 > 0 THEN least((c2 + c3 + c4 + c5 + c6) / 5, 1) ELSE 0 END AS c105,
  CASE WHEN c2 + c3 + c4 + c5 > 0 AND total_in <> 0 AND total_out / total_in > 0.9
       THEN least(0.7 + 0.1 * (c2 + c3 + c4 + c5), 1) ELSE 0 END AS c183,
  CASE WHEN total_in <> 0 AND total_out / total_in > 0.9 THEN least(total_out / total_in, 1) ELSE 0 END AS c185
FROM pf_{s} p LEFT JOIN cy_{s} USING (wallet) LEFT JOIN pe_{s} USING (wallet)""")
    rules = [
        (1, "CashStructuring"), (4, "MuleDeposits"), (5, "RoundDollarDeposits"), (6, "RapidCashInWireOut"),
        (17, "LoanBackScheme"), (21, "NestedPersonalAccounts"), (22, "FunnelAccounts"), (23, "PassThroughAccounts"),
        (26, "MirrorTransfers"), (35, "ACHMicroSplitting"), (91, "PeelChain"), (92, "FanOutDispersal"),
        (93, "FanInAggregation"), (94, "LayeredHopsFreshWallets"), (99, "MicroSplittingThresholds"),
        (100, "ConsolidationAfterObfuscation"), (105, "CrossWalletChainLoops"),
        (183, "FraudRingSettlementTokenTransfers"), (185, "HumanTraffickingRemittanceLaundering"),
    ]
    # one row per fired rule and wallet
    block(f"rl_{s}", "\nUNION ALL ".join(
        f"SELECT wallet, {i} AS id, '{n}' AS name, CAST(c{i} AS DOUBLE) AS conf FROM rc_{s} WHERE c{i} > 0" for i, n in rules))
    block(f"rs_{s}", f"""
SELECT wallet, count(*) AS fired, max(conf) AS top_conf, avg(conf) AS mean_conf, string_agg(id, ',' ORDER BY id) AS ids,
  arg_min(name, (-conf, id)) AS top_name FROM rl_{s} GROUP BY 1""")
    # entity fallback with components as communities
    block(f"en_{s}", f"""
SELECT c.wallet, least(CASE WHEN z.n > 1 THEN coalesce(e.k, 0) / (z.n * (z.n - 1)) ELSE 0 END * z.n / 100.0, 1) AS entity_score
FROM cc_{s} c JOIN (SELECT component, count(*) n FROM cc_{s} GROUP BY 1) z USING (component)
LEFT JOIN (SELECT q.component, count(*) k FROM ed_{s} d JOIN cc_{s} q ON q.wallet = d.src GROUP BY 1) e USING (component)""")
    block(f"sc_{s}", f"""
SELECT *, CASE WHEN meta_score >= 0.9 THEN 'high' WHEN meta_score >= 0.75 THEN 'medium' WHEN meta_score <= 0.3 THEN 'low' ELSE 'medium-low' END AS risk_level
FROM (SELECT t.*, coalesce(r.fired, 0) AS fired, r.top_name, r.top_conf, coalesce(r.mean_conf, 0) AS mean_conf, r.ids,
  coalesce(e.entity_score, 0) AS entity_score,
  least(greatest(CAST(0.125 AS DOUBLE) * coalesce(e.entity_score, 0) + CAST(0.175 AS DOUBLE) * coalesce(r.top_conf, 0), 0), 1) AS meta_score
FROM tx_{s} t LEFT JOIN rs_{s} r ON r.wallet = t.sender_wallet LEFT JOIN en_{s} e ON e.wallet = t.sender_wallet)""")
    block(f"su_{s}", f"SELECT * FROM sc_{s} WHERE meta_score >= 0.75 OR risk_level <> 'low' OR label = 'illicit' OR (fired > 0 AND top_conf >= 0.15)")
