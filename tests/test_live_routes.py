"""Live routes over random changes against full enumerations, and the batches of a feed."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from waymark.model import Search
from waymark.operators import routes
from waymark.plans.streams import feed_of
from waymark.streaming import live

POOLS = "pool_id long, t0 long, t1 long, r0 long, r1 long, fee long"
ASK = "request_id long, token_in long, token_out long, amount_in long"
KEY = ["request_id", "target", "amount_in", "tokens", "pools", "path_key", "amount_out"]


@pytest.mark.parametrize("hops", [2, 3])
def test_bests_are_those_of_a_full_enumeration_after_each_batch(spark, hops):
    rng = random.Random(hops)
    # Few amounts, so that there are ties; some requests are dead at first, and some reserves come to nothing.
    pools = spark.createDataFrame([(10 * i + a, *sorted(rng.sample(range(5), 2)), rng.choice([0, 200, 400]), rng.choice([200, 400]), 30) for i in range(7) for a in (1, 2)], POOLS)
    requests = spark.createDataFrame([(n, *rng.sample(range(6), 2), rng.choice([20, 50])) for n in range(24)], ASK)
    run, now, fell = live.LiveRoutes(spark, requests.repartition(3, "request_id"), hops), pools, 0
    run.baseline(pools)
    ids = [r[0] for r in pools.select("pool_id").collect()]
    for i in range(5 - hops):
        change = spark.createDataFrame([(p, rng.choice([-300, -50, 0, 90, 250]), rng.random() < 0.2) for p in rng.sample([*ids, 999], 3)], "pool_id long, k long, removed boolean")
        was = {r.request_id: r.amount_out for r in run.best().collect()}
        run.on_batch(change, i)
        run.on_batch(change, i)  # replayed
        now = live.merge_changes(now, change).localCheckpoint()
        want = routes.enumerate_priced(requests, live.edges_of(now), Search(max_hops=hops))
        got = run.best().select(*KEY).collect()
        assert sorted(got) == sorted(routes.best(want).select(*KEY).collect()), i
        assert {r[0] for r in run.best().select("version").distinct().collect()} == {i + 1}
        assert sorted(run.store.read("routes").select("request_id", "path_key").collect()) == sorted(want.select("request_id", "path_key").collect())
        fell += sum(r.amount_out < was.get(r.request_id, 0) for r in got)
    assert fell


def test_a_batch_writes_no_routes(spark, tmp_path):
    pools = spark.createDataFrame([(10 * i + a, a, a + 1, 500, 400 + i, 30) for i in range(30) for a in range(3)], POOLS)
    requests = spark.createDataFrame([(1, 0, 2, 50), (2, 3, 1, 60)], ASK)
    run = live.LiveRoutes(spark, requests, 2, live.Store(spark, f"file://{tmp_path}/store"))
    run.baseline(pools)
    run.on_batch(spark.createDataFrame([(11, 5000, False)], "pool_id long, k long, removed boolean"), 0)
    assert run.store.read("routes").count() > 1000
    written = {g.split("/")[-1]: spark.read.parquet(g).count() for g in glob.glob(f"{tmp_path}/store/0*/*")}
    assert written == {"best": 2, "pools": 90}


def batches(spark, feed, checkpoint):
    got = []
    feed.writeStream.foreachBatch(lambda df, i: got.append(df.agg(F.min("seq"), F.max("seq"), F.count("*")).first())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return got


@pytest.mark.parametrize("files", [1, 3])
def test_batches_follow_each_other_and_are_of_a_size(spark, monkeypatch, files):
    """Also where seq is beyond what a double tells apart: there a feed whose cuts are doubles lost its order and sizes."""
    monkeypatch.setattr("waymark.plans.streams.ROWS_A_FILE", -(-2500 // files))
    df = spark.range(10_000).select((F.lit(1 << 60) + F.col("id") * 7919 % 10_000).alias("seq"))
    got = batches(spark, *feed_of(spark, df, 2500))
    assert sum(n for *_, n in got) == 10_000 and len(got) in (4, 5)
    assert all(a[1] < b[0] for a, b in zip(got, got[1:]))
    assert max(n for *_, n in got) < 3500


def test_a_feed_of_little(spark):
    assert sum(n for *_, n in batches(spark, *feed_of(spark, spark.range(0).withColumnRenamed("id", "seq")))) == 0
    assert sum(n for *_, n in batches(spark, *feed_of(spark, spark.range(2).withColumnRenamed("id", "seq")))) == 2
