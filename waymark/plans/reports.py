"""Queries of analytics and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import pricing, scalars
from waymark.model import QuotePolicy
from waymark.operators import analytics, routes
from waymark.plans.paths import BATCH, batch
from waymark.plans.registry import query
from waymark.sources import fixtures as fx
from waymark.sources.session import with_package


@query(BATCH + """, b AS (SELECT request_id, max(amount_out) AS best FROM route GROUP BY request_id)
SELECT request_id, count(*) AS routes, CAST(count_if(gap<100) AS BIGINT) AS close, round(max(gap), 6) AS widest FROM (SELECT r.request_id, CASE WHEN best>0 THEN CAST(greatest(best-amount_out,0) AS DOUBLE)*10000.0/best ELSE 0.0 END AS gap FROM route r JOIN b USING (request_id)) x GROUP BY request_id""", recursive=True)
def gap_bps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each request's routes are under its best: how many are within 100 basis points, and the widest gap."""
    r, members = batch(spark, sf_dir)
    best = r.groupBy("request_id").agg(F.max("amount_out").alias("best"))
    gaps = r.join(best, "request_id").withColumn("gap", F.expr(pricing.gap_bps("best", "amount_out")))
    return routes.handed_out(gaps.groupBy("request_id").agg(F.count("*").alias("routes"), F.count_if(F.col("gap") < 100).alias("close"), F.round(F.max("gap"), 6).alias("widest")), members)


@query(""" SELECT kind, max(n) AS n, max(CASE WHEN i=((n-1)*50)//100+1 THEN k END) AS p50, max(CASE WHEN i=((n-1)*95)//100+1 THEN k END) AS p95, max(k) AS worst
  FROM (SELECT kind, k, row_number() OVER (PARTITION BY kind ORDER BY k) AS i, count(*) OVER (PARTITION BY kind) AS n FROM change) x GROUP BY kind""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.nearest_rank(fx.changes(spark, sf_dir), "kind", "k", [50, 95])


@query(" SELECT pool_id, protocol, CAST(turn AS INTEGER) AS turn FROM (SELECT pool_id, protocol, row_number() OVER (PARTITION BY protocol ORDER BY pool_id) AS turn FROM pool) x ORDER BY turn, protocol LIMIT 137")
def pool_cap_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.round_robin(fx.pools(spark, sf_dir), 137)


@query(" SELECT protocol, CAST(count_if(status='ready') AS BIGINT) AS ready, CAST(count_if(status='degraded') AS BIGINT) AS degraded, CAST(count_if(status='pending') AS BIGINT) AS pending FROM pool GROUP BY protocol")
def registry_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.pools(spark, sf_dir).groupBy("protocol").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ready", "degraded", "pending")])


@query(" SELECT pool_id, count(*) AS n FROM change GROUP BY pool_id ORDER BY n DESC, pool_id LIMIT 10")
def failure_top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_counts(fx.changes(spark, sf_dir), "pool_id", 10)


@query(" SELECT a.t AS token_in, b.t AS token_out, CAST(CASE WHEN a.t IN (0,3,7) AND b.t IN (0,3,7) THEN 1 ELSE 0 END AS INTEGER) AS hub FROM (SELECT CAST(n_nationkey AS BIGINT) t FROM nation) a JOIN (SELECT CAST(n_nationkey AS BIGINT) t FROM nation) b ON a.t<>b.t ORDER BY hub DESC, 1, 2 LIMIT 40")
def build_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"))
    return analytics.build_queries(t, [0, 3, 7], 40)


@query(" SELECT CAST(n_nationkey AS BIGINT) AS token, CAST(CASE WHEN lower(n_name)='nation_1' THEN 0 WHEN starts_with(lower(n_name),'nation_1') THEN 1 WHEN contains(lower(n_name),'nation_1') THEN 2 WHEN starts_with('0x'||n_nationkey,'nation_1') THEN 3 ELSE 4 END AS INTEGER) AS rank FROM nation WHERE contains(lower(n_name),'nation_1') OR contains('0x'||n_nationkey,'nation_1')")
def token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.table(spark, sf_dir, "nation").withColumn("rank", F.expr(scalars.token_match_rank("n_name", "concat('0x', n_nationkey)", "'NATION_1'")))
    return n.where("rank IS NOT NULL").select(F.col("n_nationkey").cast("long").alias("token"), "rank")


@query(""", w AS (SELECT unnest(['nation_1','NATION_2','x','nation_3']) AS wanted UNION ALL SELECT n_name FROM nation),
e AS (SELECT CAST(n_nationkey AS BIGINT) AS token, n_name AS symbol FROM nation UNION ALL SELECT CAST(100+n_nationkey AS BIGINT), upper(n_name) FROM nation WHERE n_nationkey%5=0)
SELECT wanted, count(token) AS n, CASE WHEN count(token)=1 THEN min(token) END AS token FROM (SELECT DISTINCT wanted FROM w) w LEFT JOIN e ON lower(wanted)=lower(symbol) GROUP BY wanted""")
def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.table(spark, sf_dir, "nation")
    entries = n.selectExpr("CAST(n_nationkey AS BIGINT) AS token", "n_name AS symbol").union(n.where("n_nationkey % 5 = 0").selectExpr("CAST(100 + n_nationkey AS BIGINT)", "upper(n_name)"))
    wanted = spark.createDataFrame([(x,) for x in ("nation_1", "NATION_2", "x", "nation_3")], "wanted string").union(n.select("n_name")).distinct()
    return analytics.lookup_symbol(entries, wanted)


@query(""", ev AS (SELECT seq, pool_id AS token, CASE k%4 WHEN 0 THEN 'queued' WHEN 1 THEN 'ready' WHEN 2 THEN 'empty' ELSE 'failed' END AS state, seq AS updated FROM change)
SELECT token, state, updated, state='ready' OR (state='empty' AND 10000-updated<4000) AS usable FROM (SELECT token, arg_max(state, seq) AS state, max(seq) AS updated FROM ev GROUP BY token) x""")
def coverage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = fx.changes(spark, sf_dir).selectExpr("seq", "pool_id AS token", "CASE k % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'ready' WHEN 2 THEN 'empty' ELSE 'failed' END AS state", "seq AS updated")
    return analytics.coverage(ev, 10_000, 4_000)


@query(" SELECT pool_id, arg_max(k, seq) AS k, max(seq) AS seq FROM change GROUP BY pool_id")
def latest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.latest(fx.changes(spark, sf_dir), "pool_id", "seq", "k")


@query(""" SELECT pool_id, r0, CASE WHEN r0>0 THEN round(greatest(CAST(r0 AS DOUBLE)-r1, 0.0)*10000/r0, 6) END AS loss, coalesce(greatest(CAST(r0 AS DOUBLE)-r1, 0.0)*10000/r0>=300, false) AS warning FROM pool""")
def value_loss_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = scalars.value_loss_bps("CAST(r0 AS DOUBLE)", "CAST(r1 AS DOUBLE)")
    return fx.pools(spark, sf_dir).selectExpr("pool_id", "r0", f"round({loss}, 6) AS loss", f"coalesce({loss} >= 300, false) AS warning")


@query(""" SELECT pool_id, protocol, CASE WHEN part='' THEN whole ELSE whole||'.'||part END AS shown, short, CASE WHEN fee>0 AND fee<=30 THEN r0+fee END AS deadline, greatest(r0-r1,0) AS age, CASE WHEN r0>0 THEN round(CAST(r1-r0 AS DOUBLE)*10000/r0, 6) END AS diff FROM (SELECT *, substr(d,1,length(d)-3) AS whole, regexp_replace(substr(d,length(d)-2), '0+$', '') AS part,
  substr(a,1,6)||'..'||substr(a,length(a)-3) AS short FROM (SELECT *, lpad(CAST(r0 AS VARCHAR), greatest(length(CAST(r0 AS VARCHAR)),4)::INTEGER, '0') AS d, '0x'||lpad(CAST(pool_id AS VARCHAR), 40, '0') AS a FROM pool) x) y""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.pools(spark, sf_dir).withColumn("a", F.expr("concat('0x', lpad(CAST(pool_id AS STRING), 40, '0'))"))
    return p.selectExpr("pool_id", "protocol", f"{scalars.format_units('r0', '3')} AS shown", f"{scalars.short_address('a')} AS short", f"{scalars.deadline('r0', 'fee', 30)} AS deadline", f"{scalars.snapshot_age('r0', 'r1')} AS age", f"round({scalars.signed_diff_bps('r0', 'r1')}, 6) AS diff")


@query(""" SELECT request_id, CASE WHEN hops>4 THEN 'hops' WHEN top_k>5 OR top_k<1 THEN 'top_k' WHEN timeout_ms>15000 THEN 'timeout' WHEN quality NOT IN ('fast','balanced','exhaustive') THEN 'quality' END AS error
  FROM (SELECT request_id, request_id%6+1 AS hops, request_id%7 AS top_k, request_id*400 AS timeout_ms, CASE request_id%4 WHEN 0 THEN 'fast' WHEN 1 THEN 'balanced' WHEN 2 THEN 'exhaustive' ELSE 'best' END AS quality FROM request) x""")
def request_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.requests(spark, sf_dir).selectExpr("request_id", "amount_in", "request_id % 6 + 1 AS hops", "request_id % 7 AS top_k", "request_id * 400 + 0 AS timeout_ms", "CASE request_id % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'balanced' WHEN 2 THEN 'exhaustive' ELSE 'best' END AS quality")
    return analytics.check_requests(r.withColumn("timeout_ms", F.greatest("timeout_ms", F.lit(1))), QuotePolicy()).select("request_id", "error")


@query(""" SELECT coalesce(o.pool_id, n.pool_id) AS pool_id, coalesce(n.r0, o.r1) AS price, n.r0 IS NULL AS stale FROM (SELECT * FROM pool WHERE pool_id%3<>0) o FULL OUTER JOIN (SELECT * FROM pool WHERE pool_id%2=0) n ON n.pool_id=o.pool_id""")
def price_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.pools(spark, sf_dir)
    return analytics.keep_previous(p.where("pool_id % 2 = 0").selectExpr("pool_id", "r0 AS price"), p.where("pool_id % 3 <> 0").selectExpr("pool_id", "r1 AS price"), "pool_id", "price")


@query(" SELECT pool_id, CASE WHEN r1>0 THEN CAST((CAST(r0 AS HUGEINT)*1000000000000*9970*r1)//(CAST(r0 AS HUGEINT)*10000+CAST(r0 AS HUGEINT)*1000000000000*9970) AS VARCHAR) END AS out FROM pool")
def wide_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.functions.wide import constant_product_wide

    with_package(spark)

    p = fx.pools(spark, sf_dir)
    return p.select("pool_id", constant_product_wide(F.expr("CAST(CAST(r0 AS DECIMAL(38, 0)) * 1000000000000 AS STRING)"), F.col("r0").cast("string"), F.col("r1").cast("string"), F.lit(30)).alias("out"))
