"""Queries by name, with the SQL that another engine answers them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Common table expressions over the star-schema tables; see waymark.sources.fixtures for the same in DataFrames.
BASE = """
pool AS (SELECT venue*10000+t0*100+t1 AS pool_id, venue, t0, t1,
  CAST(sum(CASE WHEN sn<cn THEN q ELSE 0 END)+1 AS BIGINT) AS r0, CAST(sum(CASE WHEN sn>cn THEN q ELSE 0 END)+1 AS BIGINT) AS r1,
  CASE WHEN (venue*10000+t0*100+t1)%17=0 THEN 'pending' WHEN (venue*10000+t0*100+t1)%13=0 THEN 'degraded' ELSE 'ready' END AS status,
  CASE venue WHEN 1 THEN 'v3' WHEN 2 THEN 'curve' WHEN 3 THEN 'balancer' WHEN 4 THEN 'v2' ELSE 'custom' END AS protocol,
  CASE WHEN venue IN (1,4) THEN 5+((t0+t1)%4)*10 END AS fee
  FROM (SELECT CAST(s_nationkey AS BIGINT) sn, CAST(c_nationkey AS BIGINT) cn, CAST(substr(o_orderpriority,1,1) AS BIGINT) venue,
    CAST(least(s_nationkey,c_nationkey) AS BIGINT) t0, CAST(greatest(s_nationkey,c_nationkey) AS BIGINT) t1, CAST(floor(l_quantity) AS BIGINT) q
    FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey
    WHERE s_nationkey<>c_nationkey) x GROUP BY venue,t0,t1),
edge AS (SELECT pool_id AS pool, t0 AS token_in, t1 AS token_out, r0 AS r_in, r1 AS r_out, fee, protocol, status FROM pool
  UNION ALL SELECT pool_id, t1, t0, r1, r0, fee, protocol, status FROM pool),
registration AS (SELECT pool_id AS pool, protocol, status, t0, CASE WHEN pool_id%19=0 THEN NULL ELSE t1 END AS t1,
  CASE WHEN protocol IN ('curve','balancer') THEN CASE WHEN pool_id%23=0 THEN [t0,t0] ELSE [t1,t0,t1] END END AS coins, fee FROM pool),
classified AS (SELECT *, CASE WHEN status<>'ready' THEN 'status' WHEN protocol IN ('curve','balancer') AND coins IS NULL THEN 'missing_metadata'
    WHEN protocol NOT IN ('curve','balancer','custom') AND (t0 IS NULL OR t1 IS NULL) THEN 'missing_metadata' WHEN protocol='custom' THEN 'unsupported'
    WHEN len(tokens)<2 THEN 'too_few_tokens' END AS reason FROM (SELECT *, CASE WHEN protocol IN ('curve','balancer') THEN list_sort(list_distinct(coins))
    WHEN protocol='custom' THEN NULL ELSE list_sort([t0,t1]) END AS tokens FROM registration) y),
gedge AS (SELECT pool, a AS token_in, b AS token_out FROM (SELECT pool, a, unnest(tokens) AS b FROM (SELECT pool, tokens, unnest(tokens) AS a FROM classified WHERE reason IS NULL) p) q WHERE a<>b),
balance AS (SELECT pool_id AS pool, t0 AS token, CASE WHEN pool_id%7=0 OR pool_id%5=0 THEN 'unknown' WHEN pool_id%11=0 THEN 'stale' ELSE 'fresh' END AS state, r0 AS amount, protocol, fee FROM pool
  UNION ALL SELECT pool_id, t1, CASE WHEN pool_id%7=0 THEN 'unknown' WHEN pool_id%11=0 THEN 'stale' ELSE 'fresh' END, r1, protocol, fee FROM pool),
request AS (SELECT CAST(c_custkey AS BIGINT) request_id, CAST(c_nationkey AS BIGINT) token_in, CAST((c_nationkey+1+c_custkey%24)%25 AS BIGINT) token_out,
  CAST(1000+c_custkey%9000 AS BIGINT) amount_in FROM customer),
change AS (SELECT CAST(event_id AS BIGINT) seq, ts, event_type kind, CAST((1+user_id%5)*10000+((event_id*7)%24)*100+((event_id*7)%24)+1 AS BIGINT) pool_id,
  CAST(json_extract_string(props,'$.k') AS BIGINT) k, event_type='error' AS removed FROM events)"""


def walk(requests: str, max_hops: int, min_hops: int = 1, where: str = "true", edge: str = "edge", cycles: bool = False, quote: str = "(w.amount*9970*e.r_out)//(e.r_in*10000+w.amount*9970)", connectors: str = "") -> str:
    """Common table expressions walk and route: all simple paths of the requests, priced hop by hop."""
    visited = "NOT list_contains(toks, e.token_out)" + (" OR e.token_out=target" if cycles else "")
    allowed = f" AND (e.token_out=target OR e.token_out IN ({connectors}))" if connectors else ""
    return f"""
walk AS (SELECT request_id, {"token_in" if cycles else "token_out"} AS target, amount_in, token_in AS cur, amount_in AS amount, 0 AS hops, [token_in] AS toks, CAST([] AS BIGINT[]) AS pools, CAST([] AS BIGINT[]) AS amounts FROM {requests}
  UNION ALL SELECT request_id, target, amount_in, token_out, amt, hops+1, list_append(toks, token_out), list_append(pools, pool), list_append(amounts, amt) FROM
   (SELECT w.*, e.pool, e.token_out, {quote} AS amt FROM walk w JOIN {edge} e ON w.cur=e.token_in WHERE hops<{max_hops} AND (hops=0 OR cur<>target) AND ({visited}) AND NOT list_contains(pools, e.pool)
     AND (hops<{max_hops - 1} OR e.token_out=target){allowed} AND ({where})) z),
route AS (SELECT request_id, target, amount_in, amount AS amount_out, CAST(hops AS BIGINT) AS hops, toks, pools, amounts, array_to_string(pools,'|') AS path_key FROM walk WHERE cur=target AND hops>={min_hops})"""


def query(sql: str | None = None, recursive: bool = False, base: bool = True):
    """Registers a query under its function's name; sql follows the common table expressions."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{BASE}" if base else "") + sql
        return f

    return put
