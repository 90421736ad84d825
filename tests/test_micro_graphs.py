"""Golden micro-graphs: hand-made pools and rates with known routes."""

import pytest
from pyspark.sql import functions as F

from waymark.model import ConfigError, Heuristic, Search, Shortlist, Streaming, Threshold
from waymark.operators import graph, heuristic, incremental, liquidity, progress, routes

A, B, C, D, E = 1, 2, 3, 4, 5


def rates(spark, rows):
    """Both directions of (pool, token_in, token_out, num, den); the way back has no rate."""
    out = [r for r in rows] + [(p, b, a, None, None) for p, a, b, _, _ in rows]
    return spark.createDataFrame(out, "pool long, token_in long, token_out long, num long, den long")


def request(spark, a, b, amount=100):
    return spark.createDataFrame([(0, a, b, amount)], "request_id long, token_in long, token_out long, amount_in long")


def outputs(found):
    return sorted(((r["amount_out"], r["path_key"]) for r in found.collect() if r["amount_out"] is not None), reverse=True)


def test_build_skips_for_the_first_reason(spark):
    rows = [
        (10, "v2", "ready", A, B, None), (11, "v3", "ready", A, C, None), (12, "solidly", "ready", C, D, None), (13, "balancer", "ready", None, None, [A, B, C]), (14, "curve", "ready", None, None, [6, 7, 8]),
        (15, "v2", "pending", A, B, None), (16, "v2", "ready", A, None, None), (17, "custom", "ready", A, B, None), (18, "curve", "ready", None, None, [A, A]), (19, "v2", "degraded", A, B, None),
    ]
    p = spark.createDataFrame(rows, "pool long, protocol string, status string, t0 long, t1 long, coins array<long>")
    assert {(r["pool"], r["reason"], r["count"]) for r in graph.skipped(p).collect()} == {(15, "status", None), (16, "missing_metadata", None), (17, "unsupported", None), (18, "too_few_tokens", 1), (19, "status", None)}
    edges = graph.build(graph.indexed(p))
    assert edges.count() == 2 * 3 + 6 * 2
    assert graph.stats(edges).first().asDict() == {"edges": 18, "pools": 5, "tokens": 7}
    assert graph.indexed(p, include_degraded=True).count() == 6


def test_two_hops_beat_one(spark):
    e = rates(spark, [(10, A, B, 2, 1), (11, B, C, 2, 1), (12, A, C, 3, 1)])
    found = routes.enumerate_priced(request(spark, A, C), e, Search(), "linear")
    assert outputs(found) == [(400, "10|11"), (300, "12")]
    assert routes.best(found).first()["amount_out"] == 400
    assert [(r["hop"], r["amount_in"], r["amount_out"]) for r in routes.trace(found.where("hops = 2")).orderBy("hop").collect()] == [(1, 100, 200), (2, 200, 400)]
    assert routes.valid_traces(found).where("NOT ok").count() == 0


def test_connectors(spark):
    e = rates(spark, [(10, A, B, 1, 1), (11, B, C, 1, 1), (12, A, D, 10, 1), (13, D, C, 1, 1)])
    go = lambda s: outputs(routes.enumerate_priced(request(spark, A, C), e, s, "linear"))
    assert go(Search(max_hops=2, connectors=(B,))) == [(100, "10|11")]
    assert go(Search(max_hops=2, connectors=())) == []
    assert len(go(Search(max_hops=2))) == 2


def test_cycles(spark):
    e = rates(spark, [(10, A, B, 2, 1), (11, B, C, 2, 1), (12, C, A, 2, 1)])
    found = routes.enumerate_priced(request(spark, A, A, 10), e, Search.cycles(), "linear", cycles=True)
    assert outputs(found) == [(80, "10|11|12")]
    same = spark.createDataFrame([(10, A, B, 1, 1), (10, B, A, 1, 1)], e.schema)
    assert routes.enumerate_priced(request(spark, A, A), same, Search(2, 2), "linear", cycles=True).isEmpty()
    loops = spark.createDataFrame([(p, x, y, 1, 1) for p, t in ((20, B), (21, B), (22, C), (23, C)) for x, y in ((A, t), (t, A))], e.schema)
    assert routes.enumerate_priced(request(spark, A, A), loops, Search(4, 4), "linear", cycles=True).isEmpty()


def test_statuses_and_failures(spark):
    e = spark.createDataFrame([(10, A, B, None, None), (11, C, D, 1, 1)], "pool long, token_in long, token_out long, num long, den long")
    r = spark.createDataFrame([(0, A, B, 100), (1, A, C, 100), (2, A, 99, 100), (3, C, D, 100), (4, A, A, 100)], "request_id long, token_in long, token_out long, amount_in long")
    found = routes.enumerate_priced(r, e, Search(), "linear")
    got = {x["request_id"]: (x["status"], x["candidates"], x["failed"]) for x in routes.statuses(r, e, found).collect()}
    assert got == {0: ("no_viable_route", 1, 1), 1: ("no_path", 0, 0), 2: ("token_not_found", 0, 0), 3: ("ok", 1, 0), 4: ("no_path", 0, 0)}
    assert [tuple(x) for x in routes.failures(found).collect()] == [(0, "10", 10)]


def test_overflow_is_a_failure(spark):
    e = rates(spark, [(10, A, B, 2**62, 1)])
    found = routes.enumerate_priced(request(spark, A, B, 100), e, Search(max_hops=1), "linear")
    assert found.first()["amount_out"] is None


def balances(spark, rows):
    return spark.createDataFrame(rows, "pool long, token long, state string, amount long")


def test_balance_pruning_is_a_fold(spark):
    rows = [(0, A, B, 10, 1, 200, 1000, True), (0, A, B, 11, 2, 10_000, 50, True), (0, A, B, 12, 3, 10_000, 50, True), (0, A, B, 13, 4, 300, None, True), (0, A, B, 14, 5, 1, 250, True), (0, A, B, 15, 6, 1, 20, False)]
    q = spark.createDataFrame(rows, "request_id long, token_in long, token_out long, pool long, position int, amount long, out_fresh long, sure boolean")
    got = {r["pool"]: r["pruned"] for r in heuristic.balance_pruned(q).collect()}
    assert got == {10: False, 11: True, 12: True, 13: False, 14: True, 15: False}


def test_half_known_balances_do_not_rank(spark):
    e = spark.createDataFrame([(p, A, B, "v2", f) for p, f in ((10, 30), (11, 5), (12, 30), (13, 30))], "pool long, token_in long, token_out long, protocol string, fee long")
    b = balances(spark, [(10, B, "fresh", 10**9), (11, A, "fresh", 1), (12, A, "fresh", 8), (12, B, "fresh", 9), (13, A, "fresh", 8), (13, B, "fresh", 15)])
    order = [r["pool"] for r in liquidity.ranked_edges(e, b).orderBy("position").collect()]
    assert order == [13, 12, 11, 10]  # known ones by their balances; then fees, though 10 holds most of B


def test_traces_are_validated(spark):
    e = rates(spark, [(10, A, B, 2, 1), (11, B, C, 2, 1)])
    found = routes.enumerate_priced(request(spark, A, C), e, Search(), "linear")
    good = routes.trace(found)
    tell = lambda hops: routes.valid_traces(found, hops).first()["problem"]
    assert tell(good) is None
    assert tell(good.where("hop = 1")) == "length"
    assert tell(good.withColumn("amount_in", F.when(F.col("hop") == 2, 7).otherwise(F.col("amount_in")))) == "amount_continuity"
    assert tell(good.withColumn("amount_out", F.when(F.col("hop") == 2, 7).otherwise(F.col("amount_out")))) == "final_amount"
    assert tell(good.withColumn("token_in", F.lit(A).cast("long"))) == "hops"
    assert routes.valid_traces(found.withColumn("amount_in", F.lit(0).cast("long"))).first()["problem"] == "amount_in"


def test_upper_bound(spark):
    front = spark.createDataFrame([(0, B, C), (1, B, D), (2, B, E)], "request_id long, target long, cur long")
    caps = spark.createDataFrame([(B, 400)], "token long, cap long")
    best = spark.createDataFrame([(0, 500), (1, 300)], "request_id long, amount_out long")
    assert sorted(r["request_id"] for r in heuristic.capped(front, caps, best).collect()) == [1, 2]


def test_dominance_is_partial(spark):
    rows = [(0, 5, 300, [A, C, 5], [10, 11]), (0, 5, 200, [A, D, 5], [12, 13]), (0, 5, 150, [A, C, 9, 5], [10, 14, 11]), (0, 5, 150, [A, 5], [15])]
    f = spark.createDataFrame(rows, "request_id long, cur long, amount long, tokens array<long>, pools array<long>")
    assert sorted(r["amount"] for r in heuristic.undominated(f).collect()) == [150, 200, 300]


def test_bounded_search_finds_what_its_connectors_allow(spark):
    e = spark.createDataFrame([(p, a, b, 1000, o, 30, "v2") for p, x, y, o in ((10, A, B, 10_000), (11, B, C, 10_000), (12, A, C, 900), (13, A, D, 2000), (14, D, C, 2000)) for a, b in ((x, y), (y, x))], "pool long, token_in long, token_out long, r_in long, r_out long, fee long, protocol string")
    b = balances(spark, [(p, t, "fresh", 10_000) for p, ts in ((10, (A, B)), (11, (B, C)), (12, (A, C)), (13, (A, D)), (14, (D, C))) for t in ts])
    every = routes.best(routes.enumerate_priced(request(spark, A, C), e, Search())).first()["amount_out"]
    full = heuristic.search(request(spark, A, C), e, b, Search(connectors=(B, D), mode="heuristic"))
    assert routes.best(full).first()["amount_out"] == every
    none = heuristic.search(request(spark, A, C), e, b, Search(mode="heuristic", heuristic=Heuristic(min_degree=100, fast_lane=Heuristic().fast_lane.__class__(enabled=False))))
    assert [r["path_key"] for r in none.collect()] == ["12"]


def told(spark, first, every, config):
    cols = "request_id long, hops long, path_key string, amount_out long"
    log = progress.quote_log(spark.createDataFrame(first, cols), spark.createDataFrame(every, cols))
    rows = progress.emitted(log, config).orderBy("seq", "event").collect()
    return log, [(r["seq"], r["event"], r["path_key"], r["amount_out"], r["top"]) for r in rows]


def test_progress(spark):
    first, every = [(0, 1, "12", 300)], [(0, 1, "12", 300), (0, 2, "10|11", 400)]
    log, rows = told(spark, first, every, Streaming(top_k=3))
    got = [(r["step"], r["phase"], r["fraction_bps"], r["confidence_bps"], r["best"], r["best_updated"]) for r in progress.progress(log).orderBy("seq", "step").collect()]
    # The reference's run: 7000 with the first quote, 9000 at the end of the first phase, the fraction once the total is known.
    assert got == [
        (0, "heuristic", None, 7000, 300, True), (1, "heuristic", None, 9000, 300, False), (2, "exhaustive", 5000, 9500, 300, False),
        (0, "exhaustive", 10_000, 9999, 400, True), (3, "exhaustive", 10_000, 10_000, 400, False),
    ]
    assert rows == [(1, "best", "12", 300, None), (1, "route", "12", 300, None), (2, "best", "10|11", 400, None), (2, "route", "10|11", 400, None)]
    report = progress.report(log, Streaming()).first()
    assert (report["finality"], report["improvements"], report["heuristic_was_final"], report["evaluated"]) == ("exhaustive", 1, False, 2)
    assert [r["rank"] for r in progress.running_top(log, 3).orderBy("seq").collect()] == [1, 1]
    short = progress.report(log, Streaming(completion="heuristic")).first()
    assert (short["finality"], short["best"], short["evaluated"], short["heuristic_was_final"]) == ("heuristic_only", 300, 1, None)
    assert progress.report(log, Streaming(completion="fast_lane")).count() == 0  # this log has no fast lane; see test_counters for one that has
    _, stopped = told(spark, first, every, Streaming(stop=Threshold(confidence_bps=7000)))
    assert [r[3] for r in stopped] == [300, 300]
    at_phase_end = progress.report(log, Streaming(stop=Threshold(confidence_bps=9000))).first()
    assert (at_phase_end["finality"], at_phase_end["evaluated"]) == ("stop_policy_satisfied", 1)


def test_no_confidence_without_a_best(spark):
    cols = "request_id long, hops long, path_key string, amount_out long"
    nothing = spark.createDataFrame([(0, 1, "12", None), (0, 1, "13", None)], cols)
    log = progress.quote_log(nothing.limit(1), nothing)
    assert {r["confidence_bps"] for r in progress.progress(log).collect()} == {0}
    assert progress.report(log, Streaming(stop=Threshold(fraction_bps=1))).first()["finality"] == "exhaustive"
    # All in the first phase: 7000 until its end, and 9999 as soon as the total is known.
    every = spark.createDataFrame([(0, 1, "12", 5)], cols)
    got = [(r["step"], r["confidence_bps"]) for r in progress.progress(progress.quote_log(every, every)).orderBy("seq", "step").collect()]
    assert got == [(0, 7000), (1, 9000), (2, 9999), (3, 10_000)]


def test_first_results_wait_for_their_policy(spark):
    first = [(0, 1, "a", 100), (0, 1, "b", 300), (0, 1, "c", 200)]
    every = first + [(0, 2, "d", 250), (0, 2, "e", 400)]
    _, rows = told(spark, first, every, Streaming(top_k=2, initial=Threshold(confidence_bps=9000)))
    assert rows == [(3, "initial", "b", 300, ["b", "c"]), (4, "route", "d", 250, None), (5, "best", "e", 400, None), (5, "route", "e", 400, None)]
    # Released by the total's fraction of 6000, with what the first phase found.
    _, rows = told(spark, first, every, Streaming(top_k=2, initial=Threshold(fraction_bps=6000)))
    assert rows[0] == (3, "initial", "b", 300, ["b", "c"])
    # Never met: told at the end, and nothing besides.
    _, rows = told(spark, first, every, Streaming(top_k=2, completion="heuristic", initial=Threshold(fraction_bps=9000)))
    assert rows == [(3, "initial", "b", 300, ["b", "c"])]


def test_transfers(spark):
    b = balances(spark, [(10, A, "fresh", 100), (11, A, "fresh", 5), (12, A, "stale", None), (13, A, "unknown", None), (14, A, "fresh", 7)])
    t = spark.createDataFrame([(1, A, 10, 11, 20, False), (2, A, 12, 13, 1, False), (3, A, 14, None, 8, False), (4, A, 10, None, 1, True)], "seq long, token long, from_pool long, to_pool long, value long, removed boolean")
    got = {r["pool"]: (r["state"], r["amount"]) for r in liquidity.apply_transfers(b, t.where("seq < 4")).collect()}
    assert got == {10: ("fresh", 80), 11: ("fresh", 25), 12: ("stale", None), 13: ("stale", None), 14: ("stale", None)}
    got = {r["pool"]: r["state"] for r in liquidity.apply_transfers(b, t).collect()}
    assert got[10] == "stale"


def test_refresh_equals_a_full_search(spark):
    schema = "pool long, token_in long, token_out long, r_in long, r_out long"
    old = spark.createDataFrame([(p, a, b, 1000, o) for p, x, y, o in ((10, A, B, 3000), (11, A, B, 2000), (12, B, C, 2000), (13, A, C, 1500)) for a, b in ((x, y), (y, x))], schema)
    new = old.withColumn("r_out", F.when(F.col("pool") == 10, 500).otherwise(F.col("r_out")).cast("long"))
    found = routes.enumerate_priced(request(spark, A, C), old, Search())
    changed = spark.createDataFrame([(10,)], "pool long")
    got = incremental.refresh(found, new, changed).first()
    want = routes.best(routes.enumerate_priced(request(spark, A, C), new, Search())).first()
    assert (got["amount_out"], got["path_key"], got["status"], got["repriced"]) == (want["amount_out"], want["path_key"], "updated", 1)
    one = found.where("path_key = '11|12'")
    probed = incremental.refresh(one, old, changed, with_probes=True).first()
    assert (probed["path_key"], probed["status"]) == ("10|12", "updated")
    # Priced again to the same best: updated, as the source has it; nothing priced again: unchanged.
    same = incremental.refresh(found, old, changed).first()
    assert (same["status"], same["previous"] == same["amount_out"], same["repriced"]) == ("updated", True, 1)
    far = incremental.refresh(found, old, spark.createDataFrame([(99,)], "pool long")).first()
    assert (far["status"], far["repriced"]) == ("unchanged", 0)
    # A request without routes stays; a session with a reason isn't refreshed.
    asked = spark.createDataFrame([(0,), (7,)], "request_id long")
    got = {r["request_id"]: (r["status"], r["amount_out"], r["path_key"]) for r in incremental.refresh(found, new, changed, requests=asked).collect()}
    assert got[7] == ("unchanged", None, None) and got[0][0] == "updated"
    barred = incremental.refresh(found, new, changed, reasons=spark.createDataFrame([(0, "removed_logs")], "request_id long, reason string")).first()
    assert (barred["status"], barred["reason"], barred["amount_out"] == barred["previous"]) == ("recompute_required", "removed_logs", True)


def test_probes_over_changed_pools_are_those_of_all_that_touch_them(spark):
    e = spark.createDataFrame([(p, a, b) for p, x, y in ((10, A, B), (11, A, B), (12, B, C), (13, B, C), (14, B, C), (15, A, C)) for a, b in ((x, y), (y, x))], "pool long, token_in long, token_out long").withColumn("r_in", F.lit(1000).cast("long")).withColumn("r_out", F.lit(900).cast("long"))
    found = routes.enumerate_priced(request(spark, A, C), e, Search()).where("path_key IN ('10|12', '11|13', '15')")
    every = incremental.probes(found, e)
    for pool in (10, 13, 14, 15):
        want = {r["path_key"] for r in every.where(F.array_contains("pools", pool)).collect()}
        got = {r["path_key"] for r in incremental.probes(found, e, spark.createDataFrame([(pool,)], "pool long")).collect()}
        assert got == want


def test_configurations_are_checked():
    for bad in (lambda: Search(2, 1), lambda: Search(max_candidates=0), lambda: Search(mode="x"), lambda: Heuristic(beam_width=0), lambda: Shortlist(initial=3, refinement=1), lambda: Threshold(), lambda: Threshold(0), lambda: Streaming(top_k=0), lambda: Search.quality("x")):
        with pytest.raises(ConfigError):
            bad()
    assert Search.quality("fast")[1] == "fast_lane"
    quick, even = Heuristic.latency_first(), Heuristic.balanced()
    assert even == Heuristic() and even.target_first and even.dominance and even.fast_lane.enabled and even.upper_bound and not even.shortlist.enabled
    assert (quick.shortlist.enabled, quick.shortlist.initial, quick.shortlist.refinement) == (True, 1, 3)
    assert (quick.auto_connectors, quick.beam_width, quick.finalists) == (8, 64, 16)


def test_mutations_equal_a_rebuild(spark):
    """A deterministic script of updates; after each step the merged edges are those of a full build."""
    state, x = {}, 7
    for step in range(12):
        x = (x * 1103515245 + 12345) % 2**31
        pool, before = x % 5, dict(state)
        if step % 4 == 3:
            state.pop(pool, None)
        else:
            state[pool] = sorted({x % 7, (x // 7) % 7, (x // 49) % 7})
        b, a = (spark.createDataFrame([(k, v) for k, v in s.items() if len(v) > 1], "pool long, tokens array<long>") for s in (before, state))
        delta = graph.diff(b, a)
        moved = delta.where("change <> 'unchanged'").select("pool")
        merged = graph.remove_pools(graph.build(b), moved).unionByName(graph.build(a.join(moved, "pool", "left_semi")))
        want = {tuple(r) for r in graph.build(a).select("pool", "token_in", "token_out").collect()}
        assert {tuple(r) for r in merged.select("pool", "token_in", "token_out").collect()} == want
        total = delta.agg(F.sum("added_edges") - F.sum("removed_edges")).first()[0] or 0
        assert total == len(want) - graph.build(b).count()
