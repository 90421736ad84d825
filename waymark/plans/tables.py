"""Queries of versions, targets, raw logs, packed routes, batch prices and execution policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import binary
from waymark.model import Search
from waymark.operators import policies, rawlogs, routes, targets, versions
from waymark.plans.paths import BATCH, best_of_batch, top_of_batch
from waymark.plans.registry import query, walk
from waymark.plans.topology import YEARS
from waymark.sources import fixtures as fx
from waymark.sources.session import with_package
from waymark.streaming.store import written


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.yearly_pools(spark, sf_dir)
    side = lambda i, o, a, b: F.struct(F.col(i).alias("token_in"), F.col(o).alias("token_out"), F.col(a).alias("r_in"), F.col(b).alias("r_out"))
    edges = p.select("version", "pool", F.explode(F.array(side("t0", "t1", "r0", "r1"), side("t1", "t0", "r1", "r0"))).alias("e")).select("version", "pool", "e.*")
    return versions.history(edges)


def _pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair at the first, a middle and the last version."""
    return fx.pairs(spark, sf_dir).withColumn("at", F.explode(F.array(*(F.lit(v).cast("long") for v in (0, 3, 6))))).withColumn("request_id", F.col("at") * 100_000 + F.col("request_id"))


@query(YEARS + ", asked AS (SELECT v*100000+request_id AS request_id, token_in, token_out, amount_in FROM pair JOIN (SELECT unnest([0,3,6]) AS v) x ON true), " + walk("asked", 2, edge="ye", where="e.version=w.request_id//100000") + """
SELECT request_id, CAST(request_id//100000 AS BIGINT) AS at, amount_in, amount_out, hops, path_key FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY amount_out DESC, path_key) AS n FROM route WHERE amount_out IS NOT NULL) x WHERE n<=2""", recursive=True)
def routes_at_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best routes of each pair at three versions, in one plan over edges with intervals."""
    found = versions.enumerate_at(_pinned(spark, sf_dir), written(_history(spark, sf_dir)), Search(max_hops=2))
    return routes.ranked(found, 2).select("request_id", F.expr("request_id div 100000").alias("at"), "amount_in", "amount_out", "hops", "path_key")


@query(YEARS + """, n AS (SELECT version, pool, token_in, token_out, r_in, r_out, CASE WHEN lag(r_in) OVER w=r_in AND lag(r_out) OVER w=r_out AND lag(version) OVER w=version-1 THEN 0 ELSE 1 END AS fresh FROM ye WINDOW w AS (PARTITION BY pool, token_in, token_out ORDER BY version))
SELECT pool, token_in, token_out, r_in, r_out, min(version) AS since, max(version)+1 AS until FROM (SELECT *, sum(fresh) OVER (PARTITION BY pool, token_in, token_out ORDER BY version) AS run FROM n) x GROUP BY pool, token_in, token_out, r_in, r_out, run""")
def edge_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir)


#: Where a pool's tokens lie: venue 5 can't be read; venue 3 keeps them in a vault once it has traded over 40 units a side.
SOURCE = "CASE WHEN pool >= 50000 THEN 'unknown' WHEN pool >= 30000 AND pool < 40000 AND r0 > 40 THEN 'vault' ELSE 'erc20' END"
RECONCILED = YEARS + f""", side AS (SELECT version, pool, t0 AS token, {SOURCE} AS source, r0 AS amount FROM yp UNION ALL SELECT version, pool, t1, {SOURCE}, r1 FROM yp),
held AS (SELECT pool, token, source, CASE WHEN source='erc20' THEN pool WHEN source='vault' THEN 1 END AS holder, CASE WHEN amount%3=0 THEN 'stale' WHEN amount%3=1 THEN 'fresh' ELSE 'unknown' END AS state, CASE WHEN amount%3=1 THEN amount END AS amount FROM side WHERE version=0),
want AS (SELECT pool, token, source, CASE WHEN source='erc20' THEN pool WHEN source='vault' THEN 1 END AS holder FROM side WHERE version=(SELECT max(version) FROM yp)),
o AS (SELECT coalesce(h.pool,w.pool) AS pool, coalesce(h.token,w.token) AS token, h.source AS hs, h.state, h.amount, w.source AS ws, w.holder, coalesce(h.source=w.source AND h.holder IS NOT DISTINCT FROM w.holder, false) AS same FROM held h FULL JOIN want w ON w.pool=h.pool AND w.token=h.token)"""


def _targets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = written(fx.yearly_pools(spark, sf_dir))
    side = p.select("version", "pool", F.expr(SOURCE).alias("source"), F.explode(F.array(F.struct(F.col("t0").alias("token"), F.col("r0").alias("amount")), F.struct(F.col("t1").alias("token"), F.col("r1").alias("amount")))).alias("s")).select("version", "pool", "s.token", "source", F.expr("CASE WHEN source = 'erc20' THEN pool WHEN source = 'vault' THEN 1L END").alias("holder"), "s.amount")
    held = side.where("version = 0").selectExpr("pool", "token", "source", "holder", "CAST(NULL AS STRING) AS slot", "CASE amount % 3 WHEN 0 THEN 'stale' WHEN 1 THEN 'fresh' ELSE 'unknown' END AS state", "CASE WHEN amount % 3 = 1 THEN amount END AS amount")
    last = side.agg(F.max("version").alias("last"))
    return held, side.join(last).where("version = last").select("pool", "token", "source", "holder")


@query(RECONCILED + " SELECT pool, token, ws AS source, holder, CASE WHEN same THEN state ELSE 'unknown' END AS state, CASE WHEN same THEN amount END AS amount FROM o WHERE ws IS NOT NULL")
def target_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first year's targets, reconciled with what the last year's pools need."""
    return targets.reconcile(*_targets(spark, sf_dir))[0].drop("slot")


@query(RECONCILED + " SELECT count_if(ws IS NOT NULL AND NOT same)::BIGINT AS added, count_if(hs IS NOT NULL AND NOT same)::BIGINT AS removed, count_if(same AND state='fresh')::BIGINT AS preserved_fresh, count_if(ws='unknown')::BIGINT AS unknown FROM o")
def target_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.reconcile(*_targets(spark, sf_dir))[1]


WRITES = """, t AS (SELECT pool, token, state, CASE WHEN state='fresh' THEN amount END AS amount FROM balance),
wr AS (SELECT seq, pool_id AS pool, (pool_id//100)%100+CASE WHEN k%4=0 THEN 2 ELSE 0 END AS token, CASE WHEN removed THEN 'stale' ELSE 'set' END AS op, k AS amount FROM change),
l AS (SELECT pool, token, arg_max(op, seq) AS op, arg_max(amount, seq) AS amount FROM wr GROUP BY pool, token)"""


def _writes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    held = fx.balances(spark, sf_dir).selectExpr("pool", "token", "'erc20' AS source", "pool AS holder", "CAST(NULL AS STRING) AS slot", "state", "CASE WHEN state = 'fresh' THEN amount END AS amount")
    writes = fx.changes(spark, sf_dir).selectExpr("seq", "pool_id AS pool", "pool_id div 100 % 100 + IF(k % 4 = 0, 2, 0) AS token", "IF(removed, 'stale', 'set') AS op", "k AS amount")
    return targets.write(held, writes)


@query(WRITES + " SELECT t.pool, t.token, CASE WHEN op IS NULL THEN state WHEN op='set' THEN 'fresh' ELSE 'stale' END AS state, CASE WHEN op IS NULL THEN t.amount WHEN op='set' THEN l.amount END AS amount FROM t LEFT JOIN l ON l.pool=t.pool AND l.token=t.token")
def target_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances after a log of writes, of which the last of each target counts."""
    return _writes(spark, sf_dir)[0].select("pool", "token", "state", "amount")


@query(WRITES + " SELECT seq, pool, token, op, 'unknown_pool_token' AS error FROM wr WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.pool=wr.pool AND t.token=wr.token)")
def target_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _writes(spark, sf_dir)[1]


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log as raw logs: some have too few topics, another signature or short data, some values need more than 38 digits."""
    word = lambda e: f"concat('0x', lpad(lower(hex({e})), 64, '0'))"
    data = "concat('0x', IF(k % 11 = 0, lpad('f', 16, '0'), repeat('0', 16)), repeat('0', 16), lpad(lower(hex(k)), 16, '0'), lpad(lower(hex(seq)), 16, '0'))"
    topics = f"CASE kind WHEN 'signup' THEN array('{binary.TRANSFER}', {word('pool_id')}) WHEN 'error' THEN array({word('seq')}, {word('pool_id')}, {word('k')}) ELSE array('{binary.TRANSFER}', {word('pool_id')}, {word('pool_id + 1')}) END"
    return fx.changes(spark, sf_dir).selectExpr("seq", "concat('0x', lpad(hex(pool_id % 25), 40, '0')) AS address", f"{topics} AS topics", f"IF(kind = 'click' AND k % 5 = 0, substring({data}, 1, 40), {data}) AS data", "removed")


@query(""" SELECT seq, '0x'||lpad(lower(to_hex(pool_id%25)),40,'0') AS token, '0x'||lpad(lower(to_hex(pool_id)),40,'0') AS from_holder, '0x'||lpad(lower(to_hex(pool_id+1)),40,'0') AS to_holder,
  CASE WHEN k%11<>0 THEN CAST(CAST(k AS HUGEINT)*18446744073709551616+seq AS VARCHAR) END AS value, right(CASE WHEN k%11=0 THEN '000000000000000f' ELSE repeat('0',16) END||repeat('0',16)||lpad(lower(to_hex(k)),16,'0')||lpad(lower(to_hex(seq)),16,'0'),64) AS word
  FROM change WHERE kind NOT IN ('signup','error') AND NOT (kind='click' AND k%5=0)""")
def raw_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers decoded from raw logs: addresses from topics, exact 256-bit amounts."""
    return rawlogs.transfers(_logs(spark, sf_dir)).select("seq", "token", "from_holder", "to_holder", F.col("value").cast("string").alias("value"), "word")


@query(" SELECT CASE kind WHEN 'signup' THEN 'topics' WHEN 'error' THEN 'signature' ELSE 'data' END AS problem, count(*) AS logs FROM change WHERE kind IN ('signup','error') OR kind='click' AND k%5=0 GROUP BY 1")
def raw_log_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rawlogs.problems(_logs(spark, sf_dir))


@query(BATCH + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY amount_out DESC, path_key) AS n FROM route) x WHERE n=1),
h AS (SELECT request_id, target, i, pools[i] AS p, toks[i] AS a, toks[i+1] AS b FROM (SELECT *, unnest(range(1, CAST(hops AS BIGINT)+1)) AS i FROM best) y),
e AS (SELECT request_id, target, i, CASE p//10000 WHEN 1 THEN '01' WHEN 2 THEN '06' WHEN 3 THEN '05' WHEN 4 THEN '00' ELSE '04' END||lpad(lower(to_hex(CASE WHEN p//10000=3 THEN 1 ELSE p END)),40,'0')||lpad(lower(to_hex(a)),40,'0')||lpad(lower(to_hex(b)),40,'0')
  ||CASE p//10000 WHEN 3 THEN lpad(lower(to_hex(p)),64,'0') WHEN 2 THEN CASE WHEN a<b THEN '0001' ELSE '0100' END ELSE '' END AS x FROM h)
SELECT request_id, lpad(lower(to_hex(target)),40,'0')||string_agg(x,'' ORDER BY i) AS packed FROM e GROUP BY request_id, target""", recursive=True)
def packed_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's best route as packed bytes: tag, endpoint and tokens of each hop, a vault's pool id, a curve's coin positions."""
    extra = "CASE p div 10000 WHEN 3 THEN " + binary.padded("p", 32) + " WHEN 2 THEN IF(tokens[i] < tokens[i + 1], '0001', '0100') ELSE '' END"
    tag = "CASE p div 10000 WHEN 1 THEN 1 WHEN 2 THEN 6 WHEN 3 THEN 5 WHEN 4 THEN 0 ELSE 4 END"
    hops = f"transform(pools, (p, i) -> struct({tag} AS tag, IF(p div 10000 = 3, 1L, p) AS endpoint, tokens[i] AS token_in, tokens[i + 1] AS token_out, {extra} AS extra))"
    best = best_of_batch(spark, sf_dir).withColumn("steps", F.expr(hops))
    return best.select("request_id", F.expr(f"lower(hex({binary.packed_route('target', 'steps')}))").alias("packed"))


@query()
def stable_swap_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best route of each pair where all pools are stable-swap curves, priced by batches."""
    with_package(spark)
    return routes.best(routes.enumerate_priced(fx.pairs(spark, sf_dir), fx.edges(spark, sf_dir), Search(max_hops=2), "stable_swap")).select("request_id", "amount_in", "amount_out", "hops", "path_key")


@query(BATCH + """, r AS (SELECT request_id, amount_in, amount_out, path_key, n FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY amount_out DESC, path_key) AS n FROM route WHERE amount_out IS NOT NULL) x WHERE n<=2),
b AS (SELECT a.request_id, a.path_key, a.amount_out, CASE WHEN a.request_id%5=0 THEN a.request_id%3 END AS given, s.amount_out AS second FROM r a LEFT JOIN r s ON s.request_id=a.request_id AND s.n=2 WHERE a.n=1)
SELECT request_id, path_key, amount_out, CASE WHEN given IS NOT NULL THEN nullif(given,0) ELSE nullif(second,0) END AS minimum, CASE WHEN given=0 THEN 'zero' WHEN given IS NOT NULL THEN NULL WHEN second IS NULL THEN 'no_second_route' WHEN second=0 THEN 'zero' END AS error FROM b""", recursive=True)
def execution_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least output that each request's best route may be executed at: a given one, or the second route's."""
    return policies.execution_minimum(top_of_batch(spark, sf_dir, 2), F.expr("CASE WHEN request_id % 5 = 0 THEN request_id % 3 END"))


@query(BATCH + """, b AS (SELECT *, amount_out-CASE WHEN request_id%3=0 THEN 1 WHEN request_id%7=0 THEN 2 ELSE 0 END AS simulated FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY amount_out DESC, path_key) AS n FROM route WHERE amount_out IS NOT NULL) x WHERE n=1)
SELECT request_id, amount_out, simulated, simulated=amount_out OR simulated+1=amount_out AND pools[len(pools)]//10000=2 AS accepted, CASE WHEN amount_in>0 THEN amount_out*9950//amount_in END AS scaled, CASE WHEN amount_out>300 THEN amount_out-300 ELSE 0 END AS over FROM b""", recursive=True)
def stable_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated outputs beside quoted ones: one unit short is accepted on a final stable-swap hop only."""
    best = best_of_batch(spark, sf_dir).withColumn("simulated", F.expr("amount_out - CASE WHEN request_id % 3 = 0 THEN 1 WHEN request_id % 7 = 0 THEN 2 ELSE 0 END"))
    pools = fx.pools(spark, sf_dir).select(F.col("pool_id").alias("pool"), "protocol")
    out = policies.stable_rounding(best, pools)
    return out.select("request_id", "amount_out", "simulated", "accepted", F.expr(policies.scale_amount("amount_out", "9950", "amount_in")).alias("scaled"), F.expr(policies.sub_floor("amount_out", "300L")).alias("over"))


@query(""", g AS (SELECT pool, tokens, pool%37=0 AS configured FROM classified WHERE reason IS NULL)
SELECT pool, configured, list_contains(tokens,3) AND list_contains(tokens,7) AS serves, list_has_any(tokens,[1,2,3]) AS touches, CAST(row_number() OVER (ORDER BY configured DESC, list_contains(tokens,3) AND list_contains(tokens,7) DESC, pool) AS INTEGER) AS place FROM g ORDER BY place LIMIT 100""")
def startup_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred registrations that start first, and what they serve."""
    from waymark.operators import graph

    g = graph.indexed(fx.registrations(spark, sf_dir)).withColumn("configured", F.col("pool") % 37 == 0)
    first = policies.startup(g, (3, 7), 100)
    return first.select("pool", "configured", F.expr(policies.serves_pair("tokens", "3L", "7L")).alias("serves"), F.expr(policies.touches_any("tokens", "array(1L, 2L, 3L)")).alias("touches"), "place")


