"""Requests that ask the same are searched once, and each gets the whole result; feeds read their input once."""

from pyspark.sql import functions as F

from waymark.model import Heuristic, Search
from waymark.operators import heuristic, incremental, routes
from waymark.plans.streams import feed_of
from waymark.streaming import live

ASK = "request_id long, token_in long, token_out long, amount_in long"
EDGES = [(i * 10 + k, a, b, 1000 + 37 * i + k, 900 + 11 * i + 5 * k, 30, "v2") for i, (a, b) in enumerate([(0, 1), (1, 2), (0, 2), (2, 1), (1, 0), (2, 0), (2, 3), (1, 3), (0, 3)]) for k in range(2)]


def tables(spark):
    edges = spark.createDataFrame(EDGES, "pool long, token_in long, token_out long, r_in long, r_out long, fee long, protocol string")
    asks = [(0, 3, 50), (0, 3, 60), (1, 3, 50), (None, 3, 50), (0, 3, None)]
    rows = [(n * 10 + i, *ask) for n in range(4) for i, ask in enumerate(asks) if n < 2 or i < 2]
    balances = edges.select("pool", F.col("token_in").alias("token"), F.lit("fresh").alias("state"), F.col("r_in").alias("amount"))
    return spark.createDataFrame(rows, ASK), edges, balances


def test_same_routes_from_fewer_requests(spark):
    requests, edges, _ = tables(spark)
    asked, members = routes.alike(requests)
    assert asked.count() == 5 and members.count() == requests.count() == 14
    assert sorted(r["times"] for r in asked.collect()) == [2, 2, 2, 4, 4]
    alone = routes.enumerate_priced(requests, edges, Search(max_hops=2))
    found = routes.enumerate_priced(asked, edges, Search(max_hops=2))
    assert found.count() < alone.count()
    key = ["request_id", "path_key", "amount_in", "amount_out", "hops"]
    assert sorted(map(str, routes.handed_out(found, members).select(*key).collect())) == sorted(map(str, alone.select(*key).collect()))
    trace = routes.trace(found).join(members.groupBy(F.col("asked").alias("request_id")).agg(F.count("*").alias("times")), "request_id")
    assert incremental.memo_stats(trace, F.col("times")).collect() == incremental.memo_stats(routes.trace(alone)).collect()


def test_asked_requests_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(routes, "REQUESTS_A_TASK", 3)
    requests = spark.range(120).selectExpr("id AS request_id", "id AS token_in", "7L AS token_out", "1L AS amount_in").coalesce(1)
    assert routes.alike(requests)[0].rdd.getNumPartitions() == 40


def test_counters_count_each_request(spark):
    requests, edges, balances = tables(spark)
    requests = requests.where("token_in IS NOT NULL AND amount_in IS NOT NULL")
    quick = Heuristic(shortlist=Heuristic.latency_first().shortlist, balance_pruning=True, min_degree=0)
    told = []
    for asked in (requests, routes.alike(requests)[0]):
        seen = heuristic.Counters()
        heuristic.search(asked, edges, balances, Search(max_hops=3, mode="heuristic", heuristic=quick), counters=seen).count()
        told.append(seen.values())
    assert told[0] == told[1]
    assert told[0]["shortlist_initial_edges"] > 0 and told[0]["fast_lane_routes"] > 0


def test_a_feed_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def once(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    df = spark.range(2000).withColumnRenamed("id", "seq").mapInPandas(once, "seq long")
    feed, _ = feed_of(spark, df, 300)
    assert seen.value == 2000
    assert feed.isStreaming


def test_live_routes_keep_all_prices(spark):
    pools = spark.createDataFrame([(1, 0, 1, 1000, 900, 30), (2, 1, 2, 1500, 1400, 30), (3, 0, 2, 800, 700, 30), (4, 0, 2, 810, 700, 30)], "pool_id long, t0 long, t1 long, r0 long, r1 long, fee long")
    requests = spark.createDataFrame([(1, 0, 2, 50), (2, 2, 0, 60)], ASK)
    run = live.LiveRoutes(spark, requests)
    run.baseline(pools)
    change = spark.createDataFrame([(3, 5000, False), (2, 40, False), (4, 10, True), (99, 5, False)], "pool_id long, k long, removed boolean")
    run.on_batch(change, 0)
    want = routes.enumerate_priced(requests, live.edges_of(live.merge_changes(pools, change)), Search(max_hops=2))
    key = ["request_id", "path_key", "amount_out"]
    assert sorted(run.store.read("routes").select(*key).collect()) == sorted(want.select(*key).collect())
    assert sorted(run.best().select(*key).collect()) == sorted(routes.best(want).select(*key).collect())


def test_copied_customers_get_the_rows_of_their_originals(spark, tmp_path):
    import duckdb

    from waymark import plans

    source, d = "/root/testdata/sf0.001", str(tmp_path)
    c = duckdb.connect()
    tables = "region nation customer supplier part orders lineitem events".split()
    for t in tables:
        # 9,000 on, a customer's request asks the same.
        more = f" UNION ALL SELECT * REPLACE (CAST(c_custkey + 9000 AS {{}}) AS c_custkey) FROM '{source}/{t}.parquet'" if t == "customer" else ""
        kind = c.execute(f"SELECT any_value(typeof(c_custkey)) FROM '{source}/customer.parquet'").fetchone()[0]
        c.execute(f"COPY (SELECT * FROM '{source}/{t}.parquet'{more.format(kind)}) TO '{d}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in WITH_SQL:
        got, want = plans.QUERIES[name](spark, d), c.sql(plans.ORACLE[name])
        columns = sorted(want.columns)
        assert sorted(map(str, (r.asDict() for r in got.select(*columns).collect()))) == sorted(map(str, want.select(*columns).fetchdf().astype(object).where(lambda f: f.notna(), None).to_dict("records"))), name
    for name in WITHOUT_SQL:
        rows = sorted(str({k: (v % 9000 if k == "request_id" else v) for k, v in r.asDict().items()}) for r in plans.QUERIES[name](spark, d).collect())
        assert rows and rows[::2] == rows[1::2], name


WITH_SQL = ["batch_top3", "execution_minimum", "quote_memo_stats", "initial_gate", "prefix_dominance", "upper_bound_prune", "refresh_affected", "remainder_budget"]
WITHOUT_SQL = ["beam_routes_refined", "stream_phases"]
