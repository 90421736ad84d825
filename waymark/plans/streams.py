"""Queries that run a stream to its end and return its final state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import routes
from waymark.plans.bounded import TRANSFERS
from waymark.plans.registry import query, walk
from waymark.sources import fixtures as fx
from waymark.sources.session import with_package
from waymark.streaming import live
from waymark.streaming.store import shared_folder, written


#: Rows that one file of a feed has at most, about; a batch of more rows has several files, written and read by as many tasks.
ROWS_A_FILE = 125_000


def feed_of(spark: SparkSession, df: DataFrame, rows: int = 500_000) -> tuple[DataFrame, str]:
    """df as a stream of batches of about `rows` rows (at least three) in order of seq, and a folder for its checkpoint.

    df is computed once. It is written again by ranges of seq, whose bounds cut the batches, so that a batch reads its own files only, not all of them.
    """
    df = written(df)
    n = df.count()
    batches = max(3, -(-n // rows))
    least, files = -(-n // batches) * 15 // 16, max(1, -(-n // (batches * ROWS_A_FILE)))
    folder = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    df = written(df.repartitionByRange(8 * batches, "seq").withColumn("_part", F.spark_partition_id()))
    cuts, got = [None], 0
    for part in df.where("seq IS NOT NULL").groupBy("_part").agg(F.max("seq").alias("high"), F.count("*").alias("n")).orderBy("_part").toLocalIterator():  # a row for eight of a batch
        got += part["n"]
        if got >= least:
            cuts, got = [*cuts, part["high"]], 0
    if got or len(cuts) == 1:
        cuts.append(None)
    for low, high in zip(cuts, cuts[1:]):  # one after another: the source takes files by their time
        own = F.lit(True) if low is None else F.col("seq") > low
        part = df.where(own if high is None else own & (F.col("seq") <= high)).drop("_part")
        # Each batch but the last has as many files as the source takes at a time; each of them has rows, as there are far more rows than files.
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.drop("_part").schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in"), f"{folder}/checkpoint"


NEW = """, mv AS (SELECT pool_id, CAST(sum(k) AS BIGINT) AS moved FROM change WHERE NOT removed GROUP BY pool_id),
np AS (SELECT p.pool_id, t0, t1, r0+coalesce(moved,0) AS r0, r1 FROM pool p LEFT JOIN mv USING (pool_id)),
nedge AS (SELECT pool_id AS pool, t0 AS token_in, t1 AS token_out, r0 AS r_in, r1 AS r_out FROM np UNION ALL SELECT pool_id, t1, t0, r1, r0 FROM np), """


@query(NEW + walk("request", 2, edge="nedge") + " SELECT request_id, amount_in, amount_out, path_key FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY amount_out DESC, path_key) AS n FROM route) x WHERE n=1", recursive=True)
def live_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions' best routes after the change feed has run through, refreshed batch by batch."""
    feed, checkpoint = feed_of(spark, fx.changes(spark, sf_dir))
    asked, members = routes.alike(fx.requests(spark, sf_dir))
    # Of a request's routes only sums leave a task, so there are few tasks.
    run = live.LiveRoutes(spark, asked.repartition(2 * spark.sparkContext.defaultParallelism, "request_id"))
    run.baseline(fx.pools(spark, sf_dir))
    run.run(feed, checkpoint)
    return routes.handed_out(run.best(), members).select("request_id", "amount_in", "amount_out", "path_key")


@query(TRANSFERS + """ SELECT b.pool, b.token, CASE WHEN state='fresh' AND undone=0 AND amount+low>=0 THEN 'fresh' ELSE 'stale' END AS state,
  CAST(CASE WHEN state='fresh' AND undone=0 AND amount+low>=0 THEN amount+net END AS BIGINT) AS amount FROM balance b JOIN net n ON n.pool=b.pool AND n.token=b.token""")
def balance_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful fold of transfers, in micro-batches, to its final state."""
    from waymark.plans.bounded import transfers

    with_package(spark)

    feed, checkpoint = feed_of(spark, transfers(spark, sf_dir))
    out = f"{checkpoint}-out"
    balances = fx.balances(spark, sf_dir)
    q = live.balance_stream(feed, balances).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(live.BALANCE_OUT).parquet(f"{out}/*").groupBy("pool", "token").agg(F.max_by(F.struct("state", "amount"), "seq").alias("s")).select("pool", "token", "s.state", "s.amount")


@query(""", e AS (SELECT seq, pool_id AS request_id, CASE WHEN k<5 THEN 'replace' WHEN k<20 THEN 'invalidate' WHEN k<45 THEN 'start' WHEN k<90 THEN 'result' ELSE 'failure' END AS kind FROM change)
SELECT request_id, CAST(count_if(kind='replace') AS BIGINT) AS epoch, CASE arg_max(kind, seq) WHEN 'replace' THEN 'pending' WHEN 'invalidate' THEN 'pending' WHEN 'start' THEN 'searching' WHEN 'result' THEN 'ready' ELSE 'failed' END AS state FROM e GROUP BY request_id""")
def subscription_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.changes(spark, sf_dir).selectExpr("seq", "pool_id AS request_id", "CASE WHEN k < 5 THEN 'replace' WHEN k < 20 THEN 'invalidate' WHEN k < 45 THEN 'start' WHEN k < 90 THEN 'result' ELSE 'failure' END AS kind")
    opened = e.select("request_id").distinct().selectExpr("-1L AS seq", "request_id", "'subscribe' AS kind")
    return live.subscription_states(e.unionByName(opened))


@query(""" SELECT seq, pool_id AS request_id, k%3 AS epoch, seq%2 AS version, 'rejected' AS verdict FROM change WHERE NOT (k%3=pool_id%3 AND seq%2=1) UNION ALL
SELECT seq, pool_id, k%3, seq%2, 'accepted' FROM change WHERE k%3=pool_id%3 AND seq%2=1""")
def result_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.changes(spark, sf_dir)
    results = c.selectExpr("seq", "pool_id AS request_id", "k % 3 AS epoch", "seq % 2 AS version")
    current = c.select("pool_id").distinct().selectExpr("pool_id AS request_id", "pool_id % 3 AS epoch", "1L AS version")
    ok, stale = live.accepted(results, current)
    return ok.withColumn("verdict", F.lit("accepted")).unionByName(stale.withColumn("verdict", F.lit("rejected"))).select("seq", "request_id", "epoch", "version", "verdict")
