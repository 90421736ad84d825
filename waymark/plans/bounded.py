"""Queries of liquidity and of the bounded search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.pricing import PROTOCOL_BONUS
from waymark.model import FastLane, Heuristic, Search, Streaming
from waymark.operators import graph, heuristic, liquidity, progress, routes
from waymark.plans.paths import SHOWN
from waymark.plans.registry import query, walk
from waymark.sources import fixtures as fx
from waymark.streaming.store import written

#: floor(log2) of an integer: bit lengths of 63 powers of two.
LOG2 = "CAST(length(bin({x}))-1 AS BIGINT)"
BONUS = "CASE protocol " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PROTOCOL_BONUS.items()) + " ELSE 0 END"
LIQ = f""", redge AS (SELECT * FROM edge WHERE status='ready'),
ub AS (SELECT pool, token, CASE WHEN state='fresh' THEN amount END AS fresh FROM balance),
deg AS (SELECT t AS token, count(*) AS degree FROM (SELECT token_in t FROM redge UNION ALL SELECT token_out FROM redge) x GROUP BY t),
scores AS (SELECT d.token, coalesce(known_balances,0) AS known_balances, degree, coalesce(log_sum,0) AS log_sum FROM deg d LEFT JOIN
  (SELECT token, count(fresh) AS known_balances, CAST(sum(CASE WHEN fresh>0 THEN {LOG2.format(x="fresh")} END) AS BIGINT) AS log_sum FROM ub GROUP BY token) h ON h.token=d.token),
eb AS (SELECT e.pool, e.token_in, e.token_out, e.r_in, e.r_out, e.fee, e.protocol, i.fresh AS in_fresh, o.fresh AS out_fresh FROM redge e LEFT JOIN ub i ON i.pool=e.pool AND i.token=e.token_in LEFT JOIN ub o ON o.pool=e.pool AND o.token=e.token_out),
rank AS (SELECT *, CAST(row_number() OVER (PARTITION BY token_in, token_out ORDER BY CASE WHEN both_known THEN 0 ELSE 1 END, CASE WHEN both_known THEN {LOG2.format(x="least(in_fresh, out_fresh)")}*100+{BONUS} ELSE 0 END DESC,
  CASE WHEN both_known THEN out_fresh ELSE 0 END DESC, CASE WHEN both_known THEN in_fresh ELSE 0 END DESC, CASE WHEN both_known THEN 0 ELSE {BONUS} END DESC, coalesce(fee,9223372036854775807), pool) AS INTEGER) AS position
  FROM (SELECT *, in_fresh IS NOT NULL AND out_fresh IS NOT NULL AS both_known FROM eb) x)"""


def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.edges(spark, sf_dir, True)


@query(" SELECT pool, token, CASE WHEN state='fresh' THEN amount END AS fresh FROM balance")
def usable_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liquidity.usable(fx.balances(spark, sf_dir))


@query(""" SELECT state, count(*) AS balances FROM balance GROUP BY state""")
def balance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.balances(spark, sf_dir).groupBy("state").agg(F.count("*").alias("balances"))


def _targets(spark: SparkSession, sf_dir: str, all_edges: bool) -> DataFrame:
    registrations = fx.registrations(spark, sf_dir)
    return liquidity.targets(graph.build(graph.indexed(registrations)), registrations, all_edges)


TARGET = "CASE c.protocol WHEN 'balancer' THEN 'vault' WHEN 'custom' THEN 'unknown' ELSE 'holder' END AS source"
ALL_TARGETS = f", tgt AS (SELECT DISTINCT g.pool, token_in AS token, {TARGET} FROM gedge g JOIN classified c ON c.pool=g.pool)"


@query(ALL_TARGETS + " SELECT pool, token, source FROM tgt")
def liquidity_targets_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir, True)


@query(f""", shared AS (SELECT token_in, token_out FROM gedge GROUP BY 1, 2 HAVING count(DISTINCT pool)>=2)
  SELECT DISTINCT x.pool, token, {TARGET} FROM (SELECT pool, token_in AS token FROM gedge JOIN shared USING (token_in, token_out) UNION SELECT pool, token_out FROM gedge JOIN shared USING (token_in, token_out)) x JOIN classified c ON c.pool=x.pool""")
def liquidity_targets_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir, False)


@query(ALL_TARGETS + " SELECT token, string_agg(CAST(pool AS VARCHAR), ',' ORDER BY pool) AS holders FROM tgt WHERE source='holder' GROUP BY token")
def transfer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liquidity.transfer_sources(_targets(spark, sf_dir, True)).select("token", F.array_join(F.col("holders").cast("array<string>"), ",").alias("holders"))


@query(LIQ + " SELECT * FROM scores")
def connector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liquidity.connector_scores(ready(spark, sf_dir), fx.balances(spark, sf_dir))


@query(LIQ + " SELECT token, degree FROM deg WHERE degree>=6 AND token NOT IN (0, 24) ORDER BY degree DESC, token LIMIT 8")
def auto_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liquidity.auto_connectors(ready(spark, sf_dir), without=[0, 24])


@query(LIQ + " SELECT * FROM scores ORDER BY known_balances DESC, degree DESC, log_sum DESC, token LIMIT 8")
def central_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liquidity.central_connectors(liquidity.connector_scores(ready(spark, sf_dir), fx.balances(spark, sf_dir)), 8)


@query(LIQ + " SELECT pool, token_in, token_out, in_fresh, out_fresh, position FROM rank")
def edge_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liquidity.ranked_edges(ready(spark, sf_dir), fx.balances(spark, sf_dir)).select("pool", "token_in", "token_out", "in_fresh", "out_fresh", "position")


@query(LIQ + " SELECT pool, token_in, token_out, position, greatest(n-2, 0) AS deferred FROM (SELECT *, count(*) OVER (PARTITION BY token_in, token_out) AS n FROM rank) x WHERE position<=2")
def edge_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liquidity.shortlist(ready(spark, sf_dir), fx.balances(spark, sf_dir), 2).select("pool", "token_in", "token_out", "position", "deferred")


@query(LIQ + " SELECT token_out AS token, CASE WHEN count(*)=count(out_fresh) THEN max(out_fresh) END AS cap FROM eb WHERE pool%11<>0 AND pool%7<>0 OR token_out<3 GROUP BY token_out")
def target_balance_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liquidity.target_caps(ready(spark, sf_dir).where("pool % 11 <> 0 AND pool % 7 <> 0 OR token_out < 3"), fx.balances(spark, sf_dir))


@query(LIQ + " SELECT token_in, token_out, max(in_fresh) AS deepest, CAST(sum(in_fresh) AS BIGINT) AS total FROM eb GROUP BY token_in, token_out")
def branch_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liquidity.branch_scores(ready(spark, sf_dir), fx.balances(spark, sf_dir))


TRANSFERS = """, tr AS (SELECT seq, CAST(seq%25 AS BIGINT) AS token, CASE WHEN seq%4<>0 THEN pool_id END AS from_pool, CASE WHEN seq%3<>0 THEN pool_id+10000 END AS to_pool, k AS value, removed AND seq%50=0 AS removed FROM change),
sides AS (SELECT seq, token, from_pool AS pool, -value AS delta, removed FROM tr WHERE from_pool IS NOT NULL UNION ALL SELECT seq, token, to_pool, value, removed FROM tr WHERE to_pool IS NOT NULL),
net AS (SELECT pool, token, CAST(sum(delta) AS BIGINT) AS net, min(s) AS low, max(CAST(removed AS INTEGER)) AS undone FROM (SELECT *, sum(delta) OVER (PARTITION BY pool, token ORDER BY seq, delta ROWS UNBOUNDED PRECEDING) AS s FROM sides) x GROUP BY pool, token)"""


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.changes(spark, sf_dir).selectExpr("seq", "seq % 25 AS token", "CASE WHEN seq % 4 <> 0 THEN pool_id END AS from_pool", "CASE WHEN seq % 3 <> 0 THEN pool_id + 10000 END AS to_pool", "k AS value", "removed AND seq % 50 = 0 AS removed")


@query(TRANSFERS + """ SELECT b.pool, b.token, CASE WHEN net IS NULL THEN state WHEN state='fresh' AND undone=0 AND amount+low>=0 THEN 'fresh' ELSE 'stale' END AS state,
  CAST(CASE WHEN net IS NULL AND state='fresh' THEN amount WHEN state='fresh' AND undone=0 AND amount+low>=0 THEN amount+net END AS BIGINT) AS amount FROM balance b LEFT JOIN net n ON n.pool=b.pool AND n.token=b.token""")
def balance_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liquidity.apply_transfers(fx.balances(spark, sf_dir), transfers(spark, sf_dir))


@query(""", w AS (SELECT pool_id AS pool, CAST(seq%25 AS BIGINT) AS token, arg_max(k, seq) AS value FROM change GROUP BY 1, 2)
  SELECT b.pool, b.token, CASE WHEN value IS NOT NULL THEN 'fresh' ELSE state END AS state, coalesce(value, CASE WHEN state='fresh' THEN amount END) AS amount FROM balance b LEFT JOIN w ON w.pool=b.pool AND w.token=b.token""")
def storage_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liquidity.storage_updates(fx.balances(spark, sf_dir), fx.changes(spark, sf_dir).selectExpr("seq", "pool_id AS pool", "seq % 25 AS token", "k AS value"))


@query(ALL_TARGETS + " SELECT t.pool, t.token, CASE WHEN amount IS NULL THEN 'unknown' ELSE 'fresh' END AS state, amount FROM tgt t LEFT JOIN balance b ON b.pool=t.pool AND b.token=t.token AND b.pool%9<>0")
def refresh_from_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liquidity.refresh_from_snapshot(_targets(spark, sf_dir, True), fx.balances(spark, sf_dir).where("pool % 9 <> 0").selectExpr("pool", "token", "amount AS value"))


@query(ALL_TARGETS + """, aft AS (SELECT pool, token, CASE WHEN pool%8=0 THEN 'vault' ELSE source END AS source FROM tgt WHERE pool%5<>0)
  SELECT coalesce(a.pool, b.pool) AS pool, coalesce(a.token, b.token) AS token, CASE WHEN b.source IS NULL THEN 'added' WHEN a.source IS NULL THEN 'removed' WHEN a.source<>b.source THEN 'replaced' ELSE 'kept' END AS change
  FROM (SELECT * FROM tgt WHERE pool%6<>0) b FULL OUTER JOIN aft a ON a.pool=b.pool AND a.token=b.token""")
def reconcile_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _targets(spark, sf_dir, True)
    return liquidity.reconcile(t.where("pool % 6 <> 0"), t.where("pool % 5 <> 0").withColumn("source", F.expr("CASE WHEN pool % 8 = 0 THEN 'vault' ELSE source END")))


LANE = LIQ + """, hub AS (SELECT token FROM scores ORDER BY known_balances DESC, degree DESC, log_sum DESC, token LIMIT 8), top AS (SELECT * FROM rank WHERE position<=1), """


@query(LANE + walk("request", 2, edge="top") + " SELECT request_id, amount_in, amount_out, hops, path_key, CASE hops WHEN 1 THEN 'direct' ELSE 'connector' END AS lane FROM route WHERE hops=1 OR toks[2] IN (SELECT token FROM hub)", recursive=True)
def fast_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heuristic.fast_lane(fx.requests(spark, sf_dir), ready(spark, sf_dir), fx.balances(spark, sf_dir), FastLane()).select(*SHOWN, "lane")


@query(LANE + walk("request", 2, edge="top") + """, lane AS (SELECT * FROM route WHERE hops=1 OR toks[2] IN (SELECT token FROM hub))
SELECT request_id, 'fast_lane_only' AS finality, count(*) AS evaluated, count(amount_out) AS viable, count(*)-count(amount_out) AS failed, max(amount_out) AS best FROM lane GROUP BY request_id""", recursive=True)
def fast_lane_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that is asked for its fast lane only."""
    lane = written(heuristic.fast_lane(fx.requests(spark, sf_dir), ready(spark, sf_dir), fx.balances(spark, sf_dir), FastLane()))
    log = progress.quote_log(lane.limit(0), lane.limit(0), lane)
    return progress.report(log, Streaming(completion="fast_lane")).select("request_id", "finality", "evaluated", "viable", "failed", "best")


@query()
def stream_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress at every improvement and milestone over the real phases: fast lane, bounded search, all other paths."""
    (asked, members), edges, balances = routes.alike(fx.requests(spark, sf_dir)), ready(spark, sf_dir), fx.balances(spark, sf_dir)
    lane = written(heuristic.fast_lane(asked, edges, balances, FastLane()))
    first = written(heuristic.find(asked, edges, Search(max_hops=2, mode="heuristic", heuristic=Heuristic.balanced()), balances))
    every = routes.enumerate_priced(asked, edges, Search(max_hops=2))
    log = progress.looked_up_log(first, every, lane)
    return routes.handed_out(progress.progress(log).where("best_updated OR step > 0"), members).select("request_id", "seq", "step", "phase", "evaluated", "viable", "failed", "fraction_bps", "confidence_bps", "best", "best_updated")


FRONT = ", " + walk("request", 2, edge="redge")


def _front(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """All prefixes of one hop that don't close."""
    return routes.expand(routes.start(asked, Search()), edges, "constant_product", False, False).where("cur <> target")


PREFIX = ", pre AS (SELECT r.request_id, r.token_out AS target, e.token_out AS cur, e.pool, (r.amount_in*9970*e.r_out)//(e.r_in*10000+r.amount_in*9970) AS amount FROM request r JOIN redge e ON e.token_in=r.token_in WHERE e.token_out<>r.token_out)"


@query(LIQ + PREFIX + " SELECT request_id, cur, pool, amount FROM (SELECT *, row_number() OVER (PARTITION BY request_id, cur ORDER BY amount DESC, pool) AS n FROM pre) x WHERE n<=2")
def parallel_edge_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, members = routes.alike(fx.requests(spark, sf_dir))
    return routes.handed_out(heuristic.keep_best_edges(_front(asked, ready(spark, sf_dir)), 2), members).select("request_id", "cur", F.element_at("pools", 1).alias("pool"), "amount")


@query(LIQ + PREFIX + " SELECT request_id, cur, pool, amount FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY amount DESC, CAST(pool AS VARCHAR)) AS n FROM pre) x WHERE n<=16")
def beam_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, members = routes.alike(fx.requests(spark, sf_dir))
    return routes.handed_out(heuristic.beam(_front(asked, ready(spark, sf_dir)), 16), members).select("request_id", "cur", F.element_at("pools", 1).alias("pool"), "amount")


#: Prefixes of one and two hops; of parallel edges the one with the largest output.
TWO = """, one AS (SELECT request_id, target, cur, toks, pools, amount FROM (SELECT r.request_id, r.token_out AS target, e.token_out AS cur, [r.token_in, e.token_out] AS toks, [e.pool] AS pools, (r.amount_in*9970*e.r_out)//(e.r_in*10000+r.amount_in*9970) AS amount,
  row_number() OVER (PARTITION BY r.request_id, e.token_out ORDER BY (r.amount_in*9970*e.r_out)//(e.r_in*10000+r.amount_in*9970) DESC, e.pool) AS n FROM request r JOIN redge e ON e.token_in=r.token_in WHERE e.token_out<>r.token_out) x WHERE n=1),
two AS (SELECT request_id, target, cur, toks, pools, amount FROM (SELECT t.request_id, t.target, e.token_out AS cur, list_append(toks, e.token_out) AS toks, list_append(pools, e.pool) AS pools, (t.amount*9970*e.r_out)//(e.r_in*10000+t.amount*9970) AS amount,
  row_number() OVER (PARTITION BY t.request_id, t.pools, e.token_out ORDER BY (t.amount*9970*e.r_out)//(e.r_in*10000+t.amount*9970) DESC, e.pool) AS n FROM one t JOIN redge e ON e.token_in=t.cur
  WHERE NOT list_contains(toks, e.token_out) AND NOT list_contains(pools, e.pool) AND e.token_out<>t.target) x WHERE n=1),
lab AS (SELECT *, array_to_string(pools,'|') AS k FROM (SELECT * FROM one UNION ALL SELECT * FROM two) z)"""


@query(LIQ + TWO + """ SELECT request_id, cur, k AS path_key, amount FROM lab a WHERE NOT EXISTS (SELECT 1 FROM lab b WHERE b.request_id=a.request_id AND b.cur=a.cur AND b.k<>a.k AND b.amount>=a.amount
  AND list_has_all(a.toks, b.toks) AND list_has_all(a.pools, b.pools) AND (NOT (a.amount=b.amount AND len(a.toks)=len(b.toks) AND len(a.pools)=len(b.pools)) OR b.k<a.k))""")
def prefix_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    (asked, members), edges = routes.alike(fx.requests(spark, sf_dir)), ready(spark, sf_dir)
    grow = lambda front: heuristic.keep_best_edges(routes.expand(front, edges, "constant_product", False, False).where("cur <> target"), 1)
    one = grow(routes.start(asked, Search()))
    kept = heuristic.undominated(one.unionByName(grow(one))).select("request_id", "cur", F.array_join(F.col("pools").cast("array<string>"), "|").alias("path_key"), "amount")
    return routes.handed_out(kept, members)


@query(LIQ + PREFIX + """, cap AS (SELECT token_out AS token, CASE WHEN count(*)=count(out_fresh) THEN max(out_fresh) END AS cap FROM eb WHERE pool%11<>0 AND pool%7<>0 GROUP BY token_out),
inc AS (SELECT r.request_id, max((r.amount_in*9970*e.r_out)//(e.r_in*10000+r.amount_in*9970))*4 AS best FROM request r JOIN redge e ON e.token_in=r.token_in AND e.token_out=r.token_out GROUP BY r.request_id)
SELECT p.request_id, cur, pool, amount FROM pre p LEFT JOIN cap ON cap.token=p.target LEFT JOIN inc ON inc.request_id=p.request_id WHERE cap IS NULL OR best IS NULL OR cap>best""")
def upper_bound_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incumbents are made four times as good here, so that some prefixes fall."""
    edges, (asked, members) = ready(spark, sf_dir), routes.alike(fx.requests(spark, sf_dir))
    caps = liquidity.target_caps(edges.where("pool % 11 <> 0 AND pool % 7 <> 0"), fx.balances(spark, sf_dir))
    incumbent = routes.best(routes.enumerate_priced(asked, edges, Search(max_hops=1))).select("request_id", (F.col("amount_out") * 4).alias("amount_out"))
    return routes.handed_out(heuristic.capped(_front(asked, edges), caps, incumbent), members).select("request_id", "cur", F.element_at("pools", 1).alias("pool"), "amount")


@query(LIQ + """, g AS (SELECT r.request_id, k.token_in, k.token_out, pool, position, (r.amount_in*9970*r_out)//(r_in*10000+r.amount_in*9970) AS amount, CASE WHEN out_fresh IS NOT NULL THEN out_fresh//4 END AS held FROM request r JOIN rank k ON k.token_in=r.token_in AND k.token_out=r.token_out),
f AS (SELECT request_id, token_in, token_out, pool, position, amount AS best, false AS pruned FROM g WHERE position=1
  UNION ALL SELECT g.request_id, g.token_in, g.token_out, g.pool, g.position, CASE WHEN coalesce(held<=f.best, false) THEN f.best ELSE greatest(f.best, g.amount) END, coalesce(held<=f.best, false)
  FROM f JOIN g ON g.request_id=f.request_id AND g.position=f.position+1)
SELECT request_id, token_in, token_out, pool, pruned FROM f""", recursive=True)
def balance_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances are quartered here, so that some fall under the best output."""
    q = heuristic.quoted_groups(fx.requests(spark, sf_dir), ready(spark, sf_dir), fx.balances(spark, sf_dir))
    return heuristic.balance_pruned(q.withColumn("out_fresh", F.expr("out_fresh div 4")))


@query()
def beam_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole bounded search; its rankings have SQL of their own, the loop has none."""
    asked, members = routes.alike(fx.requests(spark, sf_dir))
    found = heuristic.search(asked, ready(spark, sf_dir), fx.balances(spark, sf_dir), Search(max_hops=3, mode="heuristic", heuristic=Heuristic.balanced()))
    return routes.handed_out(found, members).select(*SHOWN)


@query()
def beam_routes_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded search with shortlist, refinement pass and balance pruning."""
    quick = Heuristic(shortlist=Heuristic.latency_first().shortlist, balance_pruning=True)
    asked, members = routes.alike(fx.requests(spark, sf_dir))
    return routes.handed_out(heuristic.find(asked, ready(spark, sf_dir), Search(max_hops=3, mode="heuristic", heuristic=quick), fx.balances(spark, sf_dir)), members).select(*SHOWN)


@query()
def prune_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the bounded search over all requests left out, by reason."""
    quick, seen = Heuristic(shortlist=Heuristic.latency_first().shortlist, balance_pruning=True, upper_bound=True, dominance=True, fast_lane=Heuristic.latency_first().fast_lane), heuristic.Counters()
    written(heuristic.search(routes.alike(fx.requests(spark, sf_dir))[0], ready(spark, sf_dir), fx.balances(spark, sf_dir), Search(max_hops=2, mode="heuristic", heuristic=quick), counters=seen))
    return spark.createDataFrame(sorted(seen.values().items()), "counter string, n long")


@query(LIQ + """, br AS (SELECT token_in, token_out, count(*) AS edges, max(in_fresh) AS deepest, sum(in_fresh) AS total FROM eb GROUP BY token_in, token_out)
SELECT request_id, br.token_out, edges, CAST(row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN br.token_out=r.token_out THEN 0 WHEN deepest IS NOT NULL THEN 1 ELSE 2 END,
  CASE WHEN br.token_out<>r.token_out THEN coalesce(deepest,-1) ELSE 0 END DESC, CASE WHEN br.token_out<>r.token_out THEN coalesce(total,-1) ELSE 0 END DESC, CASE WHEN br.token_out IN (3,5,7) THEN 0 ELSE 1 END, degree DESC, br.token_out) AS INTEGER) AS place
FROM request r JOIN br ON br.token_in=r.token_in JOIN deg ON deg.token=br.token_out""")
def hop_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heuristic.sorted_groups(fx.requests(spark, sf_dir), ready(spark, sf_dir), fx.balances(spark, sf_dir), [3, 5, 7])


@query(LIQ + """, cl AS (SELECT token_in AS node, token_out AS target, max(out_fresh) AS most, bool_or(out_fresh IS NULL) AS open FROM eb GROUP BY 1, 2), hp AS (SELECT DISTINCT token_in, token_out FROM redge),
two AS (SELECT h.token_in AS node, c.target, max(most) AS most, bool_or(open) AS open FROM hp h JOIN cl c ON c.node=h.token_out AND h.token_out<>c.target GROUP BY 1, 2),
both_hops AS (SELECT node, target, max(most) AS most, bool_or(open) AS open FROM (SELECT * FROM cl UNION ALL SELECT * FROM two) x GROUP BY 1, 2)
SELECT node, target, CAST(1 AS INTEGER) AS remaining, CASE WHEN NOT open THEN most END AS cap FROM cl WHERE target IN (SELECT token_out FROM request) UNION ALL SELECT node, target, 2, CASE WHEN NOT open THEN most END FROM both_hops WHERE target IN (SELECT token_out FROM request)""")
def caps_by_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liquidity.caps_within(ready(spark, sf_dir), fx.balances(spark, sf_dir), fx.requests(spark, sf_dir).select(F.col("token_out").alias("target")), 2)


@query(LIQ + """, hop AS (SELECT DISTINCT token_in, token_out FROM redge), tg AS (SELECT DISTINCT token_out AS target FROM request),
rch AS (SELECT target AS node, target, 0 AS need FROM tg UNION SELECT h.token_in, r.target, need+1 FROM rch r JOIN hop h ON h.token_out=r.node WHERE need<2)
SELECT node, target, min(need) AS need FROM rch GROUP BY node, target""", recursive=True)
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.requests(spark, sf_dir).select(F.col("token_out").alias("target")).distinct()
    return heuristic.reach(ready(spark, sf_dir), t, 2)
