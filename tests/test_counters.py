"""What a bounded search leaves out, counted by hand on small graphs."""

from waymark.model import FastLane, Heuristic, Search, Shortlist
from waymark.operators import heuristic
from waymark.streaming.store import written

EDGE = "pool long, token_in long, token_out long, num long, den long, r_in long, r_out long, fee long, protocol string"
BALANCE = "pool long, token long, state string, amount long"
A, B, C = 1, 2, 3
OFF = FastLane(enabled=False)


def run(spark, edges, balances, hops, h, connectors=()):
    e = spark.createDataFrame([(p, i, o, n, d, 1000, 1000, 5, "v2") for p, i, o, n, d in edges], EDGE)
    b = spark.createDataFrame(balances, BALANCE)
    seen = heuristic.Counters()
    asked = spark.createDataFrame([(1, A, B, 100)], "request_id long, token_in long, token_out long, amount_in long")
    found = written(heuristic.search(asked, e, b, Search(max_hops=hops, mode="heuristic", heuristic=h, connectors=connectors), "linear", seen))
    return [r.amount_out for r in heuristic.routes.ranked(found).orderBy("rank").collect()], seen.values()


def test_edges_that_their_balance_rules_out(spark):
    edges = [(10, A, B, 2, 1), (11, A, B, 100, 1), (12, A, B, 100, 1), (13, A, B, 100, 1)]
    balances = [(10, B, "fresh", 1000), (10, A, "fresh", 1000), *[(p, t, "fresh", 50 if t == B else 1000) for p in (11, 12, 13) for t in (A, B)]]
    best, n = run(spark, edges, balances, 1, Heuristic(balance_pruning=True, upper_bound=False, dominance=False, fast_lane=OFF, parallel_edges=9))
    assert best[0] == 200 and n["pruned_edges"] == 3 and n["stale_or_unknown_skipped_for_pruning"] == 0
    assert (n["ordered_groups"], n["protocol_ranked_edges"], n["balance_reads"]) == (1, 4, 8)
    # Unknown balances never rule an edge out.
    _, n = run(spark, edges, balances[:2], 1, Heuristic(balance_pruning=True, upper_bound=False, dominance=False, fast_lane=OFF, parallel_edges=9))
    assert n["pruned_edges"] == 0 and n["stale_or_unknown_skipped_for_pruning"] == 3


def test_a_prefix_whose_target_cannot_pay(spark):
    edges = [(10, A, B, 5, 1), (11, A, C, 1, 1), (12, C, B, 10, 1)]
    h = Heuristic(fast_lane=OFF, dominance=False)
    best, n = run(spark, edges, [(12, B, "fresh", 400)], 2, h, (C,))
    assert best == [500] and (n["upper_bound_pruned_prefixes"], n["upper_bound_unknown_prefixes"]) == (1, 0)
    best, n = run(spark, edges, [(12, B, "stale", None)], 2, h, (C,))
    assert best == [1000, 500] and (n["upper_bound_pruned_prefixes"], n["upper_bound_unknown_prefixes"]) == (0, 1)


def test_shortlist_passes(spark):
    edges = [(10, A, B, 1, 1), (11, A, B, 2, 1), (12, A, B, 3, 1)]
    h = Heuristic(shortlist=Shortlist(enabled=True, initial=1, refinement=3), fast_lane=OFF, dominance=False, upper_bound=False)
    best, n = run(spark, edges, [], 1, h)
    assert best[0] == 300
    assert (n["shortlist_initial_edges"], n["shortlist_deferred_edges"], n["shortlist_refinement_edges"]) == (1, 2, 3)


def test_dominated_prefixes_and_merged_counters(spark):
    # Two ways to C over the same tokens; the weaker one is dominated by the other.
    edges = [(11, A, C, 2, 1), (12, A, C, 1, 1), (13, C, B, 1, 1)]
    h = Heuristic(fast_lane=OFF, upper_bound=False, parallel_edges=2)
    best, n = run(spark, edges, [], 2, h, (C,))
    assert best[0] == 200 and n["prefix_dominated_states"] == 1
    a, b = heuristic.Counters(), heuristic.Counters()
    for c in (a, b):
        written(c.on(spark.range(3), pruned_edges=heuristic.F.count("*")))
    a.merge(b)
    assert a.values()["pruned_edges"] == 6


def test_phases_of_a_progressive_search(spark):
    from waymark.model import Streaming
    from waymark.operators import progress

    row = lambda *r: spark.createDataFrame(list(r), "request_id long, hops long, path_key string, amount_out long")
    lane, first = row((1, 1, "a", 10), (1, 2, "b", None)), row((1, 1, "a", 10), (1, 2, "c", 30))
    every = row((1, 1, "a", 10), (1, 2, "b", None), (1, 2, "c", 30), (1, 2, "d", 40), (1, 1, "e", 5))
    log = progress.quote_log(first, every, lane)
    assert [(r.seq, r.phase, r.path_key) for r in log.orderBy("seq").collect()] == [(1, "fast_lane", "a"), (2, "fast_lane", "b"), (3, "heuristic", "c"), (4, "exhaustive", "e"), (5, "exhaustive", "d")]
    told = {c: progress.report(log, Streaming(completion=c)).first() for c in ("fast_lane", "heuristic", "exhaustive")}
    assert {c: (r.finality, r.evaluated, r.viable, r.best, r.improvements) for c, r in told.items()} == {
        "fast_lane": ("fast_lane_only", 2, 1, 10, 0), "heuristic": ("heuristic_only", 3, 2, 30, 0), "exhaustive": ("exhaustive", 5, 4, 40, 1),
    }
