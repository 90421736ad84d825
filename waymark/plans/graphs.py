"""Queries of graph build, statistics and mutation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import graph
from waymark.plans.registry import query
from waymark.sources import fixtures as fx


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build(graph.indexed(fx.registrations(spark, sf_dir)))


@query(" SELECT pool, token_in, token_out FROM gedge")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(" SELECT pool, reason, CASE WHEN reason='too_few_tokens' THEN CAST(len(tokens) AS BIGINT) END AS count FROM classified WHERE reason IS NOT NULL")
def skipped_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.skipped(fx.registrations(spark, sf_dir))


@query(""" SELECT (SELECT count(*) FROM gedge) AS edges, (SELECT count(DISTINCT pool) FROM gedge) AS pools,
  (SELECT count(DISTINCT t) FROM (SELECT token_in t FROM gedge UNION ALL SELECT token_out FROM gedge) x) AS tokens""")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(_edges(spark, sf_dir))


@query(" SELECT reason, status, count(*) AS pools FROM classified GROUP BY reason, status")
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.classify(fx.registrations(spark, sf_dir)).groupBy("reason", "status").agg(F.count("*").alias("pools"))


@query(" SELECT t AS token, count(*) AS degree FROM (SELECT token_in t FROM gedge UNION ALL SELECT token_out FROM gedge) x GROUP BY t")
def token_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf_dir))


@query(" SELECT token_in AS token, count(DISTINCT pool) AS pools FROM gedge GROUP BY token_in")
def token_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.token_stats(_edges(spark, sf_dir))


@query(" SELECT token_in AS low, token_out AS high, string_agg(DISTINCT CAST(pool AS VARCHAR), ',' ORDER BY CAST(pool AS VARCHAR)) AS pools FROM gedge WHERE token_in<token_out GROUP BY token_in, token_out HAVING count(DISTINCT pool)>=2")
def parallel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pair_pools(_edges(spark, sf_dir), 2).select("low", "high", F.array_join(F.array_sort(F.col("pools").cast("array<string>")), ",").alias("pools"))


@query(""" SELECT pool, token FROM (SELECT a.pool, a.token_in AS token FROM gedge a JOIN (SELECT token_in, token_out FROM gedge GROUP BY 1, 2 HAVING count(DISTINCT pool)>=2) b USING (token_in, token_out)
  UNION SELECT a.pool, a.token_out FROM gedge a JOIN (SELECT token_in, token_out FROM gedge GROUP BY 1, 2 HAVING count(DISTINCT pool)>=2) b USING (token_in, token_out)) x""")
def tracked_tokens_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tracked_tokens(_edges(spark, sf_dir), True)


@query(" SELECT a.pool, a.token AS token_in, b.token AS token_out FROM m a JOIN m b ON a.pool=b.pool AND a.token<>b.token".replace(" SELECT", ", m AS (SELECT CAST(900000+r_regionkey AS BIGINT) AS pool, CAST(n_nationkey AS BIGINT) AS token FROM region JOIN nation ON n_regionkey=r_regionkey) SELECT", 1))
def multi_token_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.multi_pools(spark, sf_dir).groupBy("pool").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    return graph.build(m)


def _after(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The indexed pools, and the same after some pools went and some lost or changed tokens."""
    before = graph.indexed(fx.registrations(spark, sf_dir))
    moved = F.expr("CASE WHEN pool % 5 = 0 THEN array_sort(array_distinct(transform(tokens, t -> (t + 1) % 25))) ELSE tokens END")
    after = graph.indexed(fx.registrations(spark, sf_dir), include_degraded=True).where("pool % 7 <> 0").withColumn("tokens", moved)
    return before, after


AFTER = """, before AS (SELECT pool, tokens FROM classified WHERE reason IS NULL),
after AS (SELECT pool, CASE WHEN pool%5=0 THEN list_sort(list_distinct(list_transform(tokens, lambda t: (t+1)%25))) ELSE tokens END AS tokens FROM classified
  WHERE pool%7<>0 AND (reason IS NULL OR (reason='status' AND status='degraded' AND protocol<>'custom' AND (protocol IN ('curve','balancer') OR t1 IS NOT NULL) AND len(tokens)>=2))),
d AS (SELECT coalesce(b.pool, a.pool) AS pool, b.tokens AS b, a.tokens AS a FROM before b FULL OUTER JOIN after a ON a.pool=b.pool),
delta AS (SELECT pool, CASE WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'removed' WHEN a<>b THEN 'updated' ELSE 'unchanged' END AS change, b, a FROM d)"""


@query(AFTER + """ SELECT pool, change, CAST(CASE WHEN change<>'unchanged' AND b IS NOT NULL THEN len(b)*(len(b)-1) ELSE 0 END AS BIGINT) AS removed_edges,
  CAST(CASE WHEN change<>'unchanged' AND a IS NOT NULL THEN len(a)*(len(a)-1) ELSE 0 END AS BIGINT) AS added_edges FROM delta""")
def graph_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.diff(*_after(spark, sf_dir))


@query(AFTER + " SELECT CAST(max(CASE change WHEN 'unchanged' THEN 0 ELSE 1 END) AS INTEGER) AS revision_bump, CASE max(CASE change WHEN 'unchanged' THEN 0 ELSE 2 END) WHEN 2 THEN 'localized' ELSE 'unchanged' END AS impact FROM delta")
def graph_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact(graph.diff(*_after(spark, sf_dir)))


@query(AFTER + """, ae AS (SELECT pool, a AS token_in, b AS token_out FROM (SELECT pool, a, unnest(tokens) AS b FROM (SELECT pool, tokens, unnest(tokens) AS a FROM after) p) q WHERE a<>b),
changed AS (SELECT pool FROM delta WHERE change<>'unchanged'), both_e AS (SELECT * FROM gedge UNION SELECT * FROM ae),
near AS (SELECT DISTINCT e.pool FROM both_e e JOIN (SELECT DISTINCT token_in, token_out FROM both_e JOIN changed USING (pool)) p USING (token_in, token_out))
SELECT pool FROM (SELECT pool FROM changed UNION SELECT pool FROM near) x""")
def liquidity_affected_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _after(spark, sf_dir)
    changed = graph.diff(before, after).where("change <> 'unchanged'").select("pool")
    both = graph.build(before).union(graph.build(after)).distinct()
    return changed.union(graph.parallel_neighbours(both, changed)).distinct()


@query(" SELECT pool, token_in, token_out FROM gedge WHERE pool%3<>0")
def graph_remove_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return graph.remove_pools(edges, edges.where("pool % 3 = 0").select("pool").distinct())


@query(" SELECT DISTINCT t AS token FROM (SELECT token_in t FROM gedge UNION ALL SELECT token_out FROM gedge) x WHERE t NOT IN (SELECT token_in FROM gedge WHERE token_in<5 AND token_out<5 UNION SELECT token_out FROM gedge WHERE token_in<5 AND token_out<5)")
def graph_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return graph.orphans(graph.compacted_tokens(edges), edges.where("token_in < 5 AND token_out < 5"))
