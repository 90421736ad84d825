"""Queries of ledgers that streams keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.plans.registry import query
from waymark.plans.streams import feed_of
from waymark.plans.topology import YEARS
from waymark.sources import fixtures as fx
from waymark.sources.session import with_package
from waymark.streaming import states

TTL = 2 * 3600 * 1000

#: Rows of events a micro-batch: each batch opens and commits the state of all partitions, whatever it brings, so there are few.
EVENTS_A_BATCH = 6_000_000


@query(f""", s AS (SELECT CAST(event_id AS BIGINT) AS seq, CAST(epoch_ms(ts) AS BIGINT) AS ms, CAST(user_id AS BIGINT) AS token, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'discovering' WHEN 'purchase' THEN 'settled' WHEN 'error' THEN 'failed' ELSE 'graph' END AS kind,
  CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY seq) AS i FROM s),
f AS (SELECT 0 AS i, token, CAST(0 AS BIGINT) AS seq, '' AS kind, 'unknown' AS before, 'unknown' AS state, CAST(0 AS BIGINT) AS since, CAST(0 AS BIGINT) AS pools, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT token FROM s) t
  UNION ALL SELECT CAST(i AS INTEGER), token, seq, kind, state, CASE WHEN bad IS NOT NULL THEN state WHEN kind='graph' THEN CASE WHEN k>=50 AND state IN ('unknown','empty') THEN 'ready' ELSE state END
      WHEN kind='settled' THEN CASE WHEN k>=50 THEN 'ready' ELSE 'empty' END ELSE kind END, CASE WHEN bad IS NULL THEN ms ELSE since END, CASE WHEN bad IS NULL AND kind IN ('settled','graph') THEN k ELSE pools END, bad
    FROM (SELECT n.*, f.state, f.since, f.pools, CASE WHEN n.kind='discovering' AND f.state<>'queued' OR n.kind IN ('settled','failed') AND f.state NOT IN ('queued','discovering') OR n.kind='queued' AND f.state NOT IN ('unknown','ready','empty','failed') THEN 'transition'
      WHEN n.kind='queued' AND f.state='empty' AND n.ms-f.since<{TTL} THEN 'negative_is_fresh' END AS bad FROM f JOIN n ON n.token=f.token AND n.i=f.i+1) z)
SELECT seq, token, kind, before, state AS after, pools, error FROM f WHERE i>0""", recursive=True)
def coverage_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of every token through the coverage ledger, with the steps that are refused."""
    with_package(spark)
    kind = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'discovering' WHEN 'purchase' THEN 'settled' WHEN 'error' THEN 'failed' ELSE 'graph' END"
    e = fx.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    steps = e.selectExpr("CAST(event_id AS BIGINT) AS seq", "CAST(ts AS TIMESTAMP) AS at", "CAST(user_id AS BIGINT) AS token", f"{kind} AS kind", "k >= 50 AS present", "k AS pools")
    # Steps come in order of seq, not of time; as late as the whole log is long, none is dropped.
    span = steps.agg(F.coalesce(F.unix_seconds(F.max("at")) - F.unix_seconds(F.min("at")), F.lit(0))).first()[0]
    feed, checkpoint = feed_of(spark, steps, EVENTS_A_BATCH)
    out = f"{checkpoint}-out"
    with states.keyed_state(spark, 2 * spark.sparkContext.defaultParallelism):
        rows = states.coverage_stream(feed, TTL, f"{span + 2} seconds")
        rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(states.LEDGER).parquet(f"{out}/*").where("kind <> 'expired'")


@query(YEARS + """, d AS (SELECT coalesce(a.version, b.version+1) AS version, coalesce(a.pool, b.pool) AS pool FROM yp a FULL JOIN yp b ON b.version=a.version-1 AND b.pool=a.pool WHERE (a.pool IS NULL OR b.pool IS NULL) AND coalesce(a.version, b.version+1)<=(SELECT max(version) FROM yp)),
held AS (SELECT version, count(*) AS pools, count(*)*2 AS edges FROM yp GROUP BY version), t AS (SELECT version, count(DISTINCT token_in) AS tokens FROM ye GROUP BY version),
log AS (SELECT version*10 AS seq, version, CASE WHEN version=0 THEN 'baseline' ELSE 'applied' END AS verdict FROM held UNION ALL SELECT version*10+5, version, 'stale' FROM held WHERE version>0 UNION ALL SELECT version*10+6, version+3, 'gap' FROM held WHERE version>0)
SELECT CAST(row_number() OVER (ORDER BY seq)-1 AS BIGINT) AS step, log.version, verdict, CAST(0 AS BIGINT) AS wrong, pools, tokens, edges FROM log JOIN held h ON h.version=seq//10 JOIN t ON t.version=h.version""")
def count_index_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count index over yearly deltas, each of which comes a second time and once with a later version's number."""
    years = states.written(fx.yearly_pools(spark, sf_dir).select("version", "pool", F.array("t0", "t1").alias("tokens")))
    was = years.select((F.col("version") + 1).alias("version"), "pool", F.col("tokens").alias("before"))
    last = years.agg(F.max("version").alias("last"))
    delta = years.withColumnRenamed("tokens", "after").join(was, ["version", "pool"], "full_outer").where("version > 0").join(last).where("version <= last").drop("last")
    # Pools that stay are in the delta too, so that a version without any other still has one.
    at = delta.withColumn("seq", F.col("version") * 10)
    again, ahead = at.withColumn("seq", F.col("seq") + 5), at.withColumns({"seq": F.col("seq") + 6, "version": F.col("version") + 3})
    feed, checkpoint = feed_of(spark, at.unionByName(again).unionByName(ahead))
    index = states.CountIndex(spark)
    index.baseline(years.where("version = 0").select("pool", "tokens"))
    index.run(feed, checkpoint)
    return index.log()
