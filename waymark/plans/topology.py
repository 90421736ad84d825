"""Queries of live topology: a feed of commits, each year's pools after the last year's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.model import Search
from waymark.operators import routes
from waymark.operators import topology as ops
from waymark.plans.registry import query, walk
from waymark.plans.streams import feed_of
from waymark.sources import fixtures as fx
from waymark.streaming import topology as live

#: Each year's pools, and requests by pair.
YEARS = """, trade AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(substr(o_orderpriority,1,1) AS BIGINT)*10000+least(s_nationkey,c_nationkey)*100+greatest(s_nationkey,c_nationkey) AS pool,
  CAST(least(s_nationkey,c_nationkey) AS BIGINT) AS t0, CAST(greatest(s_nationkey,c_nationkey) AS BIGINT) AS t1, s_nationkey<c_nationkey AS up, CAST(floor(l_quantity) AS BIGINT) AS q
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey WHERE s_nationkey<>c_nationkey),
yp AS (SELECT y-(SELECT CAST(min(year(o_orderdate)) AS BIGINT) FROM orders) AS version, CAST(pool AS BIGINT) AS pool, t0, t1, CAST(sum(CASE WHEN up THEN q ELSE 0 END)+1 AS BIGINT) AS r0, CAST(sum(CASE WHEN NOT up THEN q ELSE 0 END)+1 AS BIGINT) AS r1 FROM trade GROUP BY y, pool, t0, t1),
ye AS (SELECT version, pool, t0 AS token_in, t1 AS token_out, r0 AS r_in, r1 AS r_out FROM yp UNION ALL SELECT version, pool, t1, t0, r1, r0 FROM yp),
pair AS (SELECT DISTINCT token_in*1000+token_out AS request_id, token_in, token_out, CAST(1000 AS BIGINT) AS amount_in FROM request)"""

#: What changes from one version to the next, as counts of pools; a pool that was away comes back as another generation.
STEPS = """, step AS (SELECT v.version, count(*) AS pools, CAST(count_if(b.pool IS NULL) AS BIGINT) AS added, CAST(count_if(a.pool IS NULL) AS BIGINT) AS removed,
    CAST(count_if(a.pool IS NOT NULL AND b.pool IS NOT NULL) AS BIGINT) AS revised
  FROM (SELECT DISTINCT version FROM yp WHERE version>0) v JOIN (SELECT DISTINCT pool FROM yp) k ON true
  LEFT JOIN yp a ON a.version=v.version AND a.pool=k.pool LEFT JOIN yp b ON b.version=v.version-1 AND b.pool=k.pool
  WHERE (a.pool IS NOT NULL OR b.pool IS NOT NULL) AND (a.pool IS NULL OR b.pool IS NULL OR a.r0<>b.r0 OR a.r1<>b.r1) GROUP BY v.version)"""


def _followed(spark: SparkSession, sf_dir: str, max_hops: int) -> live.LiveTopology:
    rows = fx.commits(spark, sf_dir)
    feed, checkpoint = feed_of(spark, rows.where("version > 0").withColumn("seq", F.col("version")))
    run = live.LiveTopology(spark, fx.pairs(spark, sf_dir), Search(max_hops=max_hops))
    run.baseline(rows.where("version = 0"))
    run.run(feed.drop("seq"), checkpoint)
    return run


@query(YEARS + """, le AS (SELECT pool, token_in, token_out, r_in, r_out FROM ye WHERE version=(SELECT max(version) FROM ye)), """ + walk("pair", 2, edge="le") + """
SELECT request_id, count(*) AS paths, count(amount_out) AS viable, max(amount_out) AS amount_out, arg_min(path_key, (CASE WHEN amount_out IS NULL THEN 1 ELSE 0 END, -coalesce(amount_out,0), path_key)) AS path_key FROM route GROUP BY request_id""", recursive=True)
def live_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes after a feed that adds, removes and moves pools, against an enumeration over the last year's pools."""
    found = _followed(spark, sf_dir, 2).routes()
    rank = F.struct(F.col("amount_out").isNull(), -F.coalesce("amount_out", F.lit(0)), "path_key")
    return found.groupBy("request_id").agg(F.count("*").alias("paths"), F.count("amount_out").alias("viable"), F.max("amount_out").alias("amount_out"), F.min_by("path_key", rank).alias("path_key"))


@query(YEARS + STEPS + """, w1 AS (SELECT request_id, version, pool AS p1, CAST(NULL AS BIGINT) AS p2 FROM pair p JOIN ye e ON e.token_in=p.token_in AND e.token_out=p.token_out),
w2 AS (SELECT request_id, a.version, a.pool AS p1, b.pool AS p2 FROM pair p JOIN ye a ON a.token_in=p.token_in JOIN ye b ON b.version=a.version AND b.token_in=a.token_out AND b.token_out=p.token_out
  WHERE a.token_out<>p.token_out AND a.token_out<>p.token_in AND b.pool<>a.pool),
w AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2),
changed AS (SELECT a.version, a.pool FROM yp a JOIN yp b ON b.version=a.version-1 AND b.pool=a.pool WHERE a.r0<>b.r0 OR a.r1<>b.r1),
fate AS (SELECT coalesce(a.version, b.version+1) AS version, CAST(count_if(b.version IS NULL) AS BIGINT) AS opened, CAST(count_if(a.version IS NULL) AS BIGINT) AS retracted,
    CAST(count_if(a.version IS NOT NULL AND b.version IS NOT NULL AND (x.pool IS NOT NULL OR y.pool IS NOT NULL)) AS BIGINT) AS repriced,
    CAST(count_if(a.version IS NOT NULL AND b.version IS NOT NULL AND x.pool IS NULL AND y.pool IS NULL) AS BIGINT) AS kept
  FROM w a FULL JOIN w b ON b.version=a.version-1 AND b.request_id=a.request_id AND b.p1=a.p1 AND b.p2 IS NOT DISTINCT FROM a.p2
  LEFT JOIN changed x ON x.version=a.version AND x.pool=a.p1 LEFT JOIN changed y ON y.version=a.version AND y.pool=a.p2 GROUP BY 1)
SELECT s.version, CASE WHEN added+removed>0 THEN 'localized' ELSE 'unchanged' END AS impact, pools, added, removed, revised,
  CAST(sum(CASE WHEN added+removed>0 THEN 1 ELSE 0 END) OVER (ORDER BY s.version) AS BIGINT) AS graph_revision, opened, retracted, repriced, kept
FROM step s JOIN fate USING (version)""")
def topology_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each commit did to pools, to the graph's revision and to routes of up to two hops."""
    return _followed(spark, sf_dir, 2).reports().where("version > 0").select("version", "impact", "pools", "added", "removed", "revised", "graph_revision", "opened", "retracted", "repriced", "kept")


@query(YEARS + """, n AS (SELECT e.* FROM ye e WHERE version>0 AND NOT EXISTS (SELECT 1 FROM ye b WHERE b.version=e.version-1 AND b.pool=e.pool)),
a1 AS (SELECT version, request_id, CAST(n.pool AS VARCHAR) AS path_key FROM pair p JOIN n ON n.token_in=p.token_in AND n.token_out=p.token_out),
a2 AS (SELECT a.version, request_id, a.pool||'|'||b.pool AS path_key FROM pair p JOIN ye a ON a.token_in=p.token_in JOIN ye b ON b.version=a.version AND b.token_in=a.token_out AND b.token_out=p.token_out
  WHERE a.token_out<>p.token_out AND b.pool<>a.pool AND (EXISTS (SELECT 1 FROM n WHERE n.version=a.version AND n.pool=a.pool) OR EXISTS (SELECT 1 FROM n WHERE n.version=b.version AND n.pool=b.pool)))
SELECT version, request_id, path_key FROM a1 UNION ALL SELECT version, request_id, path_key FROM a2""")
def opened_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths that each year's new pools open, found from the new edges alone."""
    years, asked, out = fx.yearly_pools(spark, sf_dir), fx.pairs(spark, sf_dir), None
    years = live.written(years)
    for v in range(1, years.agg(F.max("version")).first()[0] + 1):  # a version a year
        after, before = (live.edges_of(years.where(F.col("version") == k)) for k in (v, v - 1))
        added = after.join(before, ops.EDGE, "left_anti").select(*ops.EDGE)
        found = ops.opened(asked, after, added, Search(max_hops=2)).select(F.lit(v).cast("long").alias("version"), "request_id", "path_key")
        out = found if out is None else out.unionByName(found)
    return out
