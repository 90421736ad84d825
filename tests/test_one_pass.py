"""Routes and the log of their search are made in one pass over what is asked."""

import pytest
from pyspark.sql import functions as F

from tests.test_alike import ASK, tables
from waymark.model import Search, Streaming, Threshold
from waymark.operators import heuristic, incremental, progress, routes


def counted(spark, df):
    """df that tells how many of its rows are read."""
    seen = spark.sparkContext.accumulator(0)

    def tell(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    return df.mapInPandas(tell, df.schema), seen


def test_paths_of_all_lengths_from_one_frontier(spark):
    requests, edges, _ = tables(spark)
    asked, seen = counted(spark, requests)
    got = routes.enumerate_priced(asked, edges, Search(max_hops=3)).select("request_id", "path_key", "hops", "amount_out").collect()
    assert seen.value == requests.count()
    want = []
    for h in (1, 2, 3):
        want += routes.enumerate_priced(requests, edges, Search(min_hops=h, max_hops=h)).select("request_id", "path_key", "hops", "amount_out").collect()
    assert {r["hops"] for r in got} == {1, 2, 3}
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_requests_that_lack_an_end_have_no_paths(spark):
    _, edges, _ = tables(spark)
    asks = spark.createDataFrame([(1, 0, None, 50), (2, None, 3, 50), (3, 3, 3, 50), (4, 99, 3, 50)], ASK)
    assert routes.enumerate_priced(asks, edges, Search(max_hops=3)).count() == 0
    assert routes.enumerate_priced(asks.where("request_id = 3"), edges, Search(max_hops=3), cycles=True).count() == 0  # no edge leads away from 3


def log_of(spark, quotes):
    return spark.createDataFrame(quotes, "request_id long, hops long, path_key string, amount_out long")


QUOTES = [(r, 1 + i % 2, f"p{i:02}", None if i % 5 == 4 else (i * 37 + r) % 50) for r in (1, 2) for i in range(12)] + [(3, 1, "x", None)]


def test_a_log_of_two_phases_from_one_table(spark):
    found = log_of(spark, QUOTES)
    first = F.expr("CASE WHEN path_key < 'p06' THEN true WHEN path_key < 'p09' THEN false END")
    key = ["request_id", "seq", "phase", "hops", "path_key", "amount_out"]
    got = progress.phased_log(found, first).select(*key).orderBy("request_id", "seq").collect()
    assert got == progress.quote_log(found.where(first), found).select(*key).orderBy("request_id", "seq").collect()
    assert [r["seq"] for r in got if r["request_id"] == 2] == list(range(1, 13))


@pytest.mark.parametrize(
    "config",
    [
        Streaming(stop=Threshold(9200, 3000)),
        Streaming(top_k=2, initial=Threshold(9100, 500, every=False)),
        Streaming(top_k=3, initial=Threshold(9100, 500, every=False), emit_all_viable=True),
        Streaming(top_k=3, initial=Threshold(confidence_bps=10_000)),
    ],
)
def test_events_read_the_log_once(spark, config):
    log, seen = counted(spark, log_of(spark, QUOTES))
    told = progress.emitted(progress.phased_log(log, F.col("path_key") < "p06"), config).collect()
    assert seen.value == len(QUOTES)
    assert {r["request_id"] for r in told} == {1, 2}  # the third has no viable quote
    if config.initial:
        for r in (1, 2):
            mine = sorted((e for e in told if e["request_id"] == r), key=lambda e: (e["seq"], e["event"]))
            head = [e for e in mine if e["event"] == "initial"]
            assert len(head) == 1 and mine[0] == head[0] and len(head[0]["top"]) <= config.top_k and head[0]["top"][0] == head[0]["path_key"]
            held = [q for q in progress.phased_log(log_of(spark, QUOTES), F.col("path_key") < "p06").where(f"request_id = {r}").collect() if q["seq"] <= head[0]["seq"] and q["amount_out"] is not None]
            best = sorted(held, key=lambda q: (-q["amount_out"], q["seq"]))[: config.top_k]
            assert head[0]["top"] == [q["path_key"] for q in best] and head[0]["amount_out"] == best[0]["amount_out"]
            assert all(e["seq"] > head[0]["seq"] for e in mine[1:])


def test_labels_without_pools_still_dominate(spark):
    rows = [(1, 7, 100, [0, 7], [5], []), (1, 7, 90, [0, 3, 7], [1, 2], [2]), (1, 7, 120, [0, 4, 7], [3, 4], [3]), (1, 7, 120, [0, 4, 7], [3, 6], [3]), (2, 7, 1, [0, 7], [5], [])]
    f = spark.createDataFrame(rows, "request_id long, cur long, amount long, tokens array<long>, pools array<long>, blocked array<long>")
    assert sorted((r["request_id"], r["pools"]) for r in heuristic.undominated(f).collect()) == [(1, [3, 4]), (1, [5]), (2, [5])]


def test_memo_stats_take_the_weights_of_routes(spark):
    requests, edges, _ = tables(spark)
    hops = routes.trace(routes.enumerate_priced(routes.alike(requests)[0], edges, Search(max_hops=2)), "times")
    alone = routes.trace(routes.enumerate_priced(requests, edges, Search(max_hops=2)))
    assert incremental.memo_stats(hops, F.col("times")).collect() == incremental.memo_stats(alone).collect()


def test_refresh_reads_the_routes_once(spark):
    requests, edges, _ = tables(spark)
    found = routes.enumerate_priced(routes.alike(requests)[0], edges, Search(max_hops=2))
    changed = spark.createDataFrame([(1,), (20,)], "pool long")
    moved = edges.withColumn("r_in", F.expr("IF(pool IN (1, 20), r_in + 500, r_in)"))
    rows, seen = counted(spark, found.select("request_id", "amount_in", "tokens", "pools", "path_key", "amount_out"))
    got = {r["request_id"]: r for r in incremental.refresh(rows, moved, changed, longest=2).collect()}
    assert seen.value == found.count()
    was, now = ({r["request_id"]: r for r in routes.best(f).collect()} for f in (found, routes.enumerate_priced(routes.alike(requests)[0], moved, Search(max_hops=2))))
    for i, r in was.items():
        assert (got[i]["previous"], got[i]["amount_out"], got[i]["path_key"]) == (r["amount_out"], now[i]["amount_out"], now[i]["path_key"])
    assert {r["request_id"]: r["repriced"] for r in got.values()} == {r["request_id"]: r["n"] for r in found.groupBy("request_id").agg(F.count_if(F.expr("arrays_overlap(pools, array(1L, 20L))")).alias("n")).collect()}
    assert any(r["repriced"] for r in got.values())


def test_earlier_phases_are_looked_up(spark):
    every = log_of(spark, QUOTES)
    lane = every.where("path_key IN ('p03', 'p04') AND request_id = 1")
    first = every.where("path_key IN ('p03', 'p07', 'p08') AND request_id < 3")
    rows, seen = counted(spark, every)
    key = ["request_id", "seq", "phase", "hops", "path_key", "amount_out"]
    got = progress.looked_up_log(first, rows, lane).select(*key).orderBy("request_id", "seq").collect()
    assert seen.value == len(QUOTES)
    assert got == progress.quote_log(first, every, lane).select(*key).orderBy("request_id", "seq").collect()
    assert {r["phase"] for r in got} == {"fast_lane", "heuristic", "exhaustive"}
