"""Queries of path enumeration, pricing and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.model import Search
from waymark.operators import routes
from waymark.plans.registry import query, walk
from waymark.sources import fixtures as fx
from waymark.streaming.store import written

ONE = ", one AS (SELECT CAST(0 AS BIGINT) AS request_id, CAST(0 AS BIGINT) AS token_in, CAST(24 AS BIGINT) AS token_out, CAST(1000 AS BIGINT) AS amount_in), "
SHOWN = ["request_id", "amount_in", "amount_out", "hops", "path_key"]


def one(spark: SparkSession) -> DataFrame:
    return spark.range(1).selectExpr("id AS request_id", "0L AS token_in", "24L AS token_out", "1000L AS amount_in")


def _single(spark: SparkSession, sf_dir: str, hops: int, ready: bool = False, **more) -> DataFrame:
    return routes.enumerate_priced(one(spark), fx.edges(spark, sf_dir, ready), Search(max_hops=hops, **more))


BEST = " SELECT CAST(0 AS BIGINT) AS token_in, target AS token_out, amount_in, amount_out, hops, path_key FROM route ORDER BY amount_out DESC, path_key LIMIT 1"


@query(ONE + walk("one", 2, where="e.status='ready'") + BEST, recursive=True)
def best_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.best(_single(spark, sf_dir, 2, True)).selectExpr("0L AS token_in", "target AS token_out", "amount_in", "amount_out", "hops", "path_key")


@query(ONE + walk("one", 3) + BEST, recursive=True)
def best_route_3hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.best(_single(spark, sf_dir, 3)).selectExpr("0L AS token_in", "target AS token_out", "amount_in", "amount_out", "hops", "path_key")


@query(ONE + walk("one", 2) + " SELECT request_id, CAST(row_number() OVER (ORDER BY amount_out DESC, path_key) AS INTEGER) AS rank, amount_in, amount_out, hops, path_key FROM route", recursive=True)
def routes_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.ranked(_single(spark, sf_dir, 2)).select("rank", *SHOWN)


@query(ONE + walk("one", 3) + " SELECT hops, count(*) AS routes, CAST(sum(amount_out) AS BIGINT) AS total, max(amount_out) AS best FROM route GROUP BY hops", recursive=True)
def route_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single(spark, sf_dir, 3).groupBy("hops").agg(F.count("*").alias("routes"), F.sum("amount_out").alias("total"), F.max("amount_out").alias("best"))


@query(ONE + walk("one", 2) + """ SELECT request_id, path_key, CAST(i AS INTEGER) AS hop, pools[i] AS pool, toks[i] AS token_in, toks[i+1] AS token_out,
  CASE WHEN i=1 THEN amount_in ELSE amounts[i-1] END AS amount_in, amounts[i] AS amount_out FROM (SELECT *, unnest(range(1, hops+1)) AS i FROM route) x""", recursive=True)
def route_hop_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.trace(_single(spark, sf_dir, 2))


@query(ONE + walk("one", 2) + """, st AS (SELECT *, CASE WHEN i=1 THEN amount_in ELSE amounts[i-1] END AS a_in, amounts[i] AS a_out, pools[i] AS pool, toks[i] AS t_in, toks[i+1] AS t_out FROM (SELECT *, unnest(range(1, hops+1)) AS i FROM route) x),
tr AS (SELECT request_id, path_key, i, amount_in, amount_out, hops, t_in, t_out, CASE WHEN pool%23=0 AND i=2 THEN a_in+1 ELSE a_in END AS a_in, CASE WHEN pool%29=0 AND i=hops THEN a_out+1 ELSE a_out END AS a_out FROM st WHERE NOT (pool%31=0 AND i=2)),
lk AS (SELECT *, lag(a_out) OVER w AS before FROM tr WINDOW w AS (PARTITION BY request_id, path_key ORDER BY i))
SELECT request_id, path_key, CASE WHEN count(*)<>max(hops) THEN 'length' WHEN bool_or(a_in IS DISTINCT FROM coalesce(before, amount_in)) THEN 'amount_continuity' WHEN arg_max(a_out, i) IS DISTINCT FROM max(amount_out) THEN 'final_amount' END AS problem FROM lk GROUP BY request_id, path_key""", recursive=True)
def route_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of which some were spoilt: a second hop is missing, or has another amount, or the last amount is another."""
    found = _single(spark, sf_dir, 2)
    last = F.size(F.split("path_key", "[|]"))
    hops = routes.trace(found).where("NOT (pool % 31 = 0 AND hop = 2)").withColumn("amount_in", F.expr("amount_in + IF(pool % 23 = 0 AND hop = 2, 1, 0)"))
    hops = hops.withColumn("amount_out", F.col("amount_out") + F.when((F.col("pool") % 29 == 0) & (F.col("hop") == last), 1).otherwise(0))
    return routes.valid_traces(found, hops).select("request_id", "path_key", "problem")


@query(ONE + walk("one", 2, 2) + " SELECT request_id, amount_in, amount_out, hops, path_key FROM route", recursive=True)
def routes_min_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single(spark, sf_dir, 2, min_hops=2).select(*SHOWN)


@query(ONE + walk("one", 3, connectors="3,5,7") + " SELECT request_id, amount_in, amount_out, hops, path_key FROM route", recursive=True)
def routes_connector_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single(spark, sf_dir, 3, connectors=(3, 5, 7)).select(*SHOWN)


@query(ONE + walk("one", 2, connectors="NULL") + " SELECT request_id, amount_in, amount_out, hops, path_key FROM route", recursive=True)
def routes_no_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty list allows no connector: direct routes only."""
    return _single(spark, sf_dir, 2, connectors=()).select(*SHOWN)


@query(ONE + walk("one", 2) + " SELECT request_id, amount_in, amount_out, hops, path_key FROM route ORDER BY hops, path_key LIMIT 40", recursive=True)
def routes_max_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single(spark, sf_dir, 2, max_candidates=40).select(*SHOWN)


@query(", " + walk("request", 2) + " SELECT request_id, amount_in, amount_out, hops, path_key FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY hops, path_key) AS n FROM route) x WHERE n<=25", recursive=True)
def batch_max_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 candidates of each request; prefixes that they don't need aren't expanded."""
    asked, members = routes.alike(fx.requests(spark, sf_dir))
    return routes.handed_out(routes.enumerate_within(asked, fx.edges(spark, sf_dir), Search(max_hops=2, max_candidates=25)), members).select(*SHOWN)


@query(ONE + walk("one", 3) + " SELECT request_id, amount_in, amount_out, hops, path_key FROM route ORDER BY hops, path_key LIMIT 5000", recursive=True)
def routes_max_candidates_3hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single(spark, sf_dir, 3, max_candidates=5000).select(*SHOWN)


@query(", " + walk("request", 2) + """, seen AS (SELECT request_id, path_key FROM route WHERE hops=1 OR toks[2] IN (3,5,7)), n AS (SELECT request_id, count(*) AS n FROM seen GROUP BY request_id)
SELECT request_id, amount_in, amount_out, hops, path_key FROM (SELECT r.*, coalesce(n,0) AS n, row_number() OVER (PARTITION BY r.request_id ORDER BY hops, r.path_key) AS i FROM route r LEFT JOIN n USING (request_id)
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.request_id=r.request_id AND s.path_key=r.path_key)) x WHERE i<=100-n""", recursive=True)
def remainder_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second phase evaluates after a first one over connectors 3, 5 and 7, out of 100 candidates for both."""
    (asked, members), edges = routes.alike(fx.requests(spark, sf_dir)), fx.edges(spark, sf_dir)
    seen = routes.enumerate_priced(asked, edges, Search(max_hops=2, connectors=(3, 5, 7))).select("request_id", "path_key")
    return routes.handed_out(routes.enumerate_within(asked, edges, Search(max_hops=2, max_candidates=100), written(seen)), members).select(*SHOWN)


BATCH = ", " + walk("request", 2)


def batch(spark: SparkSession, sf_dir: str, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """The routes of what is asked, and the requests that ask it (see routes.alike)."""
    asked, members = routes.alike(fx.requests(spark, sf_dir))
    return routes.enumerate_priced(asked, fx.edges(spark, sf_dir), Search(max_hops=hops)), members


def best_of_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's best route."""
    found, members = batch(spark, sf_dir)
    return routes.handed_out(routes.best(found), members)


def top_of_batch(spark: SparkSession, sf_dir: str, top: int) -> DataFrame:
    """Each request's best routes with their ranks."""
    found, members = batch(spark, sf_dir)
    return routes.handed_out(routes.ranked(found, top), members)


@query(BATCH + " SELECT request_id, amount_in, amount_out, hops, path_key FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY amount_out DESC, path_key) AS n FROM route) x WHERE n=1", recursive=True)
def batch_best_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_of_batch(spark, sf_dir).select(*SHOWN)


@query(BATCH + " SELECT CAST(n AS INTEGER) AS rank, request_id, amount_in, amount_out, hops, path_key FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY amount_out DESC, path_key) AS n FROM route) x WHERE n<=3", recursive=True)
def batch_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_of_batch(spark, sf_dir, 3).select("rank", *SHOWN)


PAIRS = """, pairs AS (SELECT a.token*25+b.token AS request_id, a.token AS token_in, b.token AS token_out, CAST(1000 AS BIGINT) AS amount_in
  FROM (SELECT DISTINCT token_in AS token FROM edge) a JOIN (SELECT DISTINCT token_in AS token FROM edge) b ON a.token<>b.token), """


@query(PAIRS + walk("pairs", 2) + " SELECT request_id, amount_in, amount_out, hops, path_key FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY amount_out DESC, path_key) AS n FROM route) x WHERE n=1", recursive=True)
def all_pairs_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best route of each ordered pair of tokens, all answered by one plan."""
    edges = fx.edges(spark, sf_dir)
    t = edges.select("token_in").distinct()
    pairs = t.join(t.toDF("token_out"), F.col("token_in") != F.col("token_out")).selectExpr("token_in * 25 + token_out AS request_id", "token_in", "token_out", "1000L AS amount_in")
    return routes.best(routes.enumerate_priced(pairs, edges, Search(max_hops=2))).select(*SHOWN)


#: A hop fails where the pool's id is a multiple of 6: its rate is missing.
LINEAR = "CASE WHEN e.pool%6<>0 THEN w.amount*(100+e.pool%50)//(100+e.pool%37) END"


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.edges(spark, sf_dir).selectExpr("pool", "token_in", "token_out", "CASE WHEN pool % 6 <> 0 THEN 100 + pool % 50 END AS num", "CASE WHEN pool % 6 <> 0 THEN 100 + pool % 37 END AS den")


@query(", " + walk("request", 2, quote=LINEAR) + " SELECT request_id, failed_pool, count(*) AS paths FROM (SELECT request_id, pools[list_position(list_transform(amounts, lambda a: a IS NULL), true)] AS failed_pool FROM route WHERE amount_out IS NULL) x GROUP BY 1, 2", recursive=True)
def route_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many paths of each request fail at each pool."""
    asked, members = routes.alike(fx.requests(spark, sf_dir))
    failed = routes.failures(routes.enumerate_priced(asked, rated(spark, sf_dir), Search(max_hops=2), "linear"))
    return routes.handed_out(failed.groupBy("request_id", "failed_pool").agg(F.count("*").alias("paths")), members)


@query(", " + walk("request", 2, quote=LINEAR) + " SELECT request_id, max(amount_out) AS amount_out, count(*) AS candidates, count(*)-count(amount_out) AS failed FROM route GROUP BY request_id", recursive=True)
def linear_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, members = routes.alike(fx.requests(spark, sf_dir))
    r = routes.enumerate_priced(asked, rated(spark, sf_dir), Search(max_hops=2), "linear")
    return routes.handed_out(r.groupBy("request_id").agg(F.max("amount_out").alias("amount_out"), F.count("*").alias("candidates"), F.count_if(F.col("amount_out").isNull()).alias("failed")), members)


@query(ONE + walk("one", 2, quote="(w.amount*(10000-coalesce(e.fee,30))*e.r_out)//(e.r_in*10000+w.amount*(10000-coalesce(e.fee,30)))") + " SELECT request_id, amount_in, amount_out, hops, path_key FROM route", recursive=True)
def routes_pool_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.enumerate_priced(one(spark), fx.edges(spark, sf_dir), Search(max_hops=2), "pool_fee").select(*SHOWN)


ODD = """, odd AS (SELECT request_id, CASE WHEN request_id%7=0 THEN 99 ELSE token_in END AS token_in, CASE WHEN request_id%5=0 THEN token_in ELSE token_out END AS token_out, amount_in FROM request),
few AS (SELECT * FROM edge WHERE pool%3<>0 AND token_in<>9), """


@query(ODD + walk("odd", 1, edge="few", quote=LINEAR) + """, tokens AS (SELECT token_in t FROM few UNION SELECT token_out FROM few),
c AS (SELECT request_id, count(*) AS candidates, count(*)-count(amount_out) AS failed FROM route GROUP BY request_id)
SELECT o.request_id, CASE WHEN token_in NOT IN (SELECT t FROM tokens) OR token_out NOT IN (SELECT t FROM tokens) THEN 'token_not_found' WHEN coalesce(candidates,0)=0 THEN 'no_path'
  WHEN failed=candidates THEN 'no_viable_route' ELSE 'ok' END AS status, coalesce(candidates,0) AS candidates, coalesce(failed,0) AS failed FROM odd o LEFT JOIN c USING (request_id)""", recursive=True)
def no_path_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = fx.requests(spark, sf_dir).selectExpr("request_id", "CASE WHEN request_id % 7 = 0 THEN 99L ELSE token_in END AS token_in", "CASE WHEN request_id % 5 = 0 THEN token_in ELSE token_out END AS token_out", "amount_in")
    few = rated(spark, sf_dir).where("pool % 3 <> 0 AND token_in <> 9")
    return routes.statuses(odd, few, routes.enumerate_priced(odd, few, Search(max_hops=1), "linear"))


@query(", bases AS (SELECT DISTINCT token_in AS request_id, token_in, token_in AS token_out, CAST(100 AS BIGINT) AS amount_in FROM edge), " + walk("bases", 3, 2, cycles=True)
       + """ SELECT request_id, CAST(n AS INTEGER) AS rank, amount_in, amount_out, hops, path_key, CASE WHEN amount_out>amount_in THEN amount_out-amount_in END AS profit
  FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY amount_out DESC, path_key) AS n FROM route) x WHERE n<=10""", recursive=True)
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best cycles of two or three hops at each token."""
    edges = fx.edges(spark, sf_dir)
    bases = edges.select("token_in").distinct().selectExpr("token_in AS request_id", "token_in", "token_in AS token_out", "100L AS amount_in")
    found = routes.ranked(routes.enumerate_priced(bases, edges, Search.cycles(), cycles=True), 10)
    return found.select("rank", *SHOWN, F.expr("CASE WHEN amount_out > amount_in THEN amount_out - amount_in END AS profit"))


@query(", " + """p AS (SELECT p.pool_id AS path_id, 1000 AS amount_in, p.pool_id AS p1, t0, t1, venue*10000+least(t1,(t1+1)%25)*100+greatest(t1,(t1+1)%25)+pool_id%3 AS p2, (t1+1)%25 AS t2 FROM pool p),
a AS (SELECT p.*, CAST((1000*9970*e.r_out)//(e.r_in*10000+1000*9970) AS BIGINT) AS x FROM p JOIN edge e ON e.pool=p1 AND e.token_in=t0 AND e.token_out=t1)
SELECT path_id, CAST((x*9970*e.r_out)//(e.r_in*10000+x*9970) AS BIGINT) AS amount_out, CAST(CASE WHEN e.pool IS NULL THEN 2 END AS INTEGER) AS failed_hop
FROM a LEFT JOIN edge e ON e.pool=p2 AND e.token_in=t1 AND e.token_out=t2""")
def quote_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.pools(spark, sf_dir).withColumn("t2", F.expr("(t1 + 1) % 25"))
    p = p.withColumn("p2", F.expr("venue * 10000 + least(t1, t2) * 100 + greatest(t1, t2) + pool_id % 3"))
    hops = F.expr("array(struct(pool_id AS pool, t0 AS token_in, t1 AS token_out), struct(p2 AS pool, t1 AS token_in, t2 AS token_out))")
    return routes.quote_paths(p.select(F.col("pool_id").alias("path_id"), F.lit(1000).cast("long").alias("amount_in"), hops.alias("hops")), fx.edges(spark, sf_dir))


@query(BATCH + """, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY amount_out DESC, path_key) AS n FROM route)
SELECT a.request_id, a.amount_out, nullif((a.amount_out//10000)*(10000-50)+((a.amount_out%10000)*(10000-50))//10000, 0) AS min_out, b.amount_out AS second_best
FROM r a LEFT JOIN r b ON a.request_id=b.request_id AND b.n=2 WHERE a.n=1""", recursive=True)
def min_out_slippage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best output, its floor at 50 bps, and the second-best output, the default minimum of an executable swap."""
    from pyspark.sql.window import Window

    from waymark.functions.pricing import min_amount_out

    top = top_of_batch(spark, sf_dir, 2)
    w = Window.partitionBy("request_id").orderBy("rank")
    return top.withColumn("second_best", F.lead("amount_out").over(w)).where("rank = 1").select("request_id", "amount_out", F.expr(min_amount_out("amount_out", "50")).alias("min_out"), "second_best")


@query(BATCH + """, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY amount_out DESC, path_key) AS n FROM route)
SELECT request_id, CAST(n AS INTEGER) AS rank, path_key FROM r WHERE n<=20 AND len(list_filter(pools, lambda p: p//10000=5))=0""", recursive=True)
def executable_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the top 20 routes those whose hops all are of allowed venues, at their original ranks."""
    return top_of_batch(spark, sf_dir, 20).where("forall(pools, p -> p div 10000 <> 5)").select("request_id", "rank", "path_key")


@query(BATCH + """ SELECT request_id, CAST(n AS INTEGER) AS rank, CAST(amount_out AS VARCHAR) AS amount_out FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY amount_out DESC, path_key) AS n FROM route) x WHERE n<=2""", recursive=True)
def route_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wire form: amounts as decimal strings inside JSON, read back here."""
    r = routes.responses(top_of_batch(spark, sf_dir, 2))
    return r.select("request_id", "rank", F.get_json_object("body", "$.amount_out").alias("amount_out"))
