"""Queries of the sequenced event log, over a feed of orders, shipments and yearly commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.plans.registry import query
from waymark.plans.streams import feed_of
from waymark.sources import fixtures as fx
from waymark.streaming.eventlog import EventLog

#: The feed, each request's rows with those of all commits, and what each row means; written from the meaning of the states, over the whole log.
FOLD = """, asked AS (SELECT CAST(o_custkey AS BIGINT) AS request_id, CAST(o_orderkey AS BIGINT) AS key, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, CAST(year(o_orderdate) AS BIGINT) AS y, o_orderstatus,
    CAST(floor(o_totalprice) AS BIGINT) AS total, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)-1 AS BIGINT) AS nth FROM orders),
span AS (SELECT CAST(year(min(o_orderdate)) AS BIGINT) AS first, CAST(year(max(o_orderdate)) AS BIGINT) AS last FROM orders),
shipped AS (SELECT CAST(l_orderkey AS BIGINT) AS key, max(CAST(datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT)) AS shipped FROM lineitem GROUP BY 1),
commits AS (SELECT (CAST(datediff('day', DATE '1970-01-01', make_date(y,1,1)) AS BIGINT)*4)*100000000000 AS seq, y-first AS version FROM (SELECT first, unnest(range(first+1,last+1)) AS y FROM span) x),
own AS (SELECT (day*4+2)*100000000000+key AS seq, CASE WHEN nth=0 THEN 'subscribe' ELSE 'replace' END AS kind, request_id, NULL::BIGINT AS epoch, NULL::BIGINT AS version, NULL::BIGINT AS amount FROM asked
  UNION ALL SELECT (greatest(day,shipped)*4+3)*100000000000+key, CASE WHEN o_orderstatus='P' THEN 'failure' ELSE 'result' END, request_id, nth, y-first, CASE WHEN o_orderstatus<>'P' AND total%10<>0 THEN total END FROM asked JOIN shipped USING (key) JOIN span ON true
  UNION ALL SELECT ((max(day)+1)*4+1)*100000000000+request_id, 'cancel', request_id, NULL, NULL, NULL FROM asked JOIN customer ON c_custkey=request_id AND c_acctbal<0 GROUP BY request_id),
r0 AS (SELECT * FROM own UNION ALL SELECT c.seq, 'commit', s.request_id, NULL, c.version, NULL FROM commits c JOIN (SELECT DISTINCT request_id FROM own WHERE kind='subscribe') s ON true),
r1 AS (SELECT *, coalesce(last_value(CASE kind WHEN 'subscribe' THEN true WHEN 'cancel' THEN false END IGNORE NULLS) OVER b, false) AS alive, coalesce(last_value(CASE WHEN kind='commit' THEN version END IGNORE NULLS) OVER u, 0) AS cv FROM r0
  WINDOW b AS (PARTITION BY request_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY request_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
r2 AS (SELECT *, CAST(coalesce(sum(CASE WHEN kind='replace' AND alive THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY seq ROWS UNBOUNDED PRECEDING),0) AS BIGINT) AS ce FROM r1),
r3 AS (SELECT *, coalesce(alive AND kind IN ('result','failure') AND epoch=ce AND version=cv, false) AS ok FROM r2),
r4 AS (SELECT *, last_value(CASE WHEN ok AND kind='result' THEN {'v': version, 'a': amount} END IGNORE NULLS) OVER b AS held,
  last_value(CASE WHEN kind IN ('subscribe') OR alive AND kind IN ('replace','commit') THEN 'pending' WHEN ok AND kind='result' THEN 'ready' WHEN ok THEN 'failed' WHEN alive AND kind='cancel' THEN 'cancelled' END IGNORE NULLS) OVER b AS was,
  last_value(CASE WHEN ok AND kind='result' THEN {'v': version, 'a': amount} END IGNORE NULLS) OVER u AS now_held,
  last_value(CASE WHEN kind IN ('subscribe') OR alive AND kind IN ('replace','commit') THEN 'pending' WHEN ok AND kind='result' THEN 'ready' WHEN ok THEN 'failed' WHEN alive AND kind='cancel' THEN 'cancelled' END IGNORE NULLS) OVER u AS now
  FROM r3 WINDOW b AS (PARTITION BY request_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY request_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
r5 AS (SELECT *, held IS NOT NULL AND (was='ready' OR held.a IS NOT NULL) AS published FROM r4)"""


#: Rows of the feed a micro-batch: each batch passes the latest values of all requests on, whatever it brings, so there are few. Their windows are by request, so
#: a task's memory doesn't grow with a batch.
ROWS_A_BATCH = 6_000_000


def _logged(spark: SparkSession, sf_dir: str) -> EventLog:
    feed, checkpoint = feed_of(spark, fx.route_feed(spark, sf_dir), ROWS_A_BATCH)
    log = EventLog(spark)
    log.run(feed, checkpoint)
    return log


@query(FOLD + """, ev AS (SELECT seq, request_id, CASE WHEN kind='subscribe' THEN 'accepted' WHEN alive AND published AND kind IN ('commit','replace') THEN 'invalidated' WHEN alive AND kind='cancel' THEN 'cancelled'
    WHEN ok AND kind='result' THEN 'published' WHEN ok THEN 'failed' WHEN alive AND kind IN ('result','failure') THEN 'rejected' END AS event, kind, epoch, version, amount, cv, ce, held FROM r5),
al AS (SELECT seq, request_id, event, CASE WHEN event='invalidated' AND kind='commit' THEN 'state_advanced' WHEN event='invalidated' THEN 'request_changed' WHEN event='rejected' AND version<>cv THEN 'stale_version' WHEN event='rejected' THEN 'stale_epoch' END AS reason,
  CASE WHEN event IN ('published','rejected','failed') THEN epoch END AS epoch, CASE WHEN event IN ('published','rejected','failed') THEN version WHEN event='invalidated' THEN held.v END AS version, ce AS current_epoch, cv AS current_version,
  CASE WHEN event='published' THEN amount END AS amount, CASE WHEN event='published' THEN held.a END AS previous FROM ev WHERE event IS NOT NULL
  UNION ALL SELECT seq, NULL, 'commit_applied', NULL, NULL, version, NULL, version, NULL, NULL FROM commits)
SELECT CAST(row_number() OVER (ORDER BY seq, request_id NULLS FIRST)-1 AS BIGINT) AS number, * FROM al""")
def route_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with their numbers: one sequence over all batches, whatever the cuts between them."""
    return _logged(spark, sf_dir).events()


@query(FOLD + " SELECT request_id, ce AS epoch, now AS state, now_held.v AS version, now_held.a AS amount, moved AS seq FROM (SELECT *, last_value(CASE WHEN kind='subscribe' OR ok OR alive AND kind IN ('replace','commit','cancel') THEN seq END IGNORE NULLS) OVER (PARTITION BY request_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS moved, row_number() OVER (PARTITION BY request_id ORDER BY seq DESC) AS n FROM r5) x WHERE n=1")
def route_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of each standing request after the whole feed."""
    return _logged(spark, sf_dir).latest()
