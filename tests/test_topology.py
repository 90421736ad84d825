"""Live topology: routes under commits equal those of a full enumeration; commits that cannot follow are refused."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.model import Search
from waymark.operators import routes, topology
from waymark.streaming import topology as live

POOLS = "pool long, generation long, revision long, t0 long, t1 long, r0 long, r1 long"


def pools(spark, rows):
    return spark.createDataFrame([(p, g, n, a, b, x, y) for p, (g, n, a, b, x, y) in sorted(rows.items())], POOLS)


def commit(spark, before, after, version, runtime="main", full=False):
    """The rows that lead from one state to the other."""
    gone = [(version, runtime, p, None, None, None, None, None, None, full) for p in before if p not in after]
    rows = [(version, runtime, p, *r, full) for p, r in after.items() if before.get(p) != r or full]
    return spark.createDataFrame(gone * (not full) + rows, live.COMMIT)


def by_request(df):
    return sorted((r.request_id, r.path_key, r.amount_out, tuple(r.tokens)) for r in df.collect())


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame([(1, 1, 2, 100), (2, 1, 4, 100), (3, 3, 2, 50), (4, 5, 5, 10)], "request_id long, token_in long, token_out long, amount_in long")


def mutate(rng, state):
    """Add, remove, retoken or revise pools; a pool that comes back is another generation."""
    state = dict(state)
    for _ in range(rng.randint(1, 4)):
        p, kind = rng.randint(1, 14), rng.choice("aurm")
        a, b = rng.sample(range(1, 6), 2)
        if p not in state and kind in "au":
            state[p] = (rng.randint(1, 9), 1, a, b, rng.randint(100, 900), rng.randint(100, 900))
        elif p in state and kind == "r":
            del state[p]
        elif p in state and kind == "u":
            g, n, *_rest = state[p]
            state[p] = (g, n + 1, a, b, *state[p][4:])
        elif p in state:
            g, n, x, y, *_rest = state[p]
            state[p] = (g, n + 1, x, y, rng.randint(100, 900), rng.randint(100, 900))
    return state


@pytest.mark.parametrize(("hops", "least", "connectors"), [(3, 1, None), (3, 2, (2, 3, 4))])
def test_a_script_of_commits_equals_full_enumeration(spark, requests, hops, least, connectors):
    rng, search = random.Random(hops + least), Search(min_hops=least, max_hops=hops, connectors=connectors)
    state = {p: (1, 1, 1 + p % 5, 1 + (p * 2 + 1) % 5, 300 + p, 500 - p) for p in range(1, 9) if 1 + p % 5 != 1 + (p * 2 + 1) % 5}
    run = live.LiveTopology(spark, requests, search)
    run.baseline(pools(spark, state))
    for version in range(1, 4):
        after = mutate(rng, state)
        run.on_batch(commit(spark, state, after, version), version)
        state = after
        want = routes.enumerate_priced(requests, live.edges_of(pools(spark, state)), search)
        assert by_request(run.routes(version)) == by_request(want), version
    reports = {r.version: r for r in run.reports().collect()}
    assert set(reports) == set(range(4)) and run.version() == 3
    n = run.routes().count()
    assert reports[3].kept + reports[3].repriced + reports[3].opened == n


def test_impacts_and_graph_revision(spark, requests):
    s0 = {1: (1, 1, 1, 2, 500, 500), 2: (1, 1, 2, 3, 500, 500)}
    run = live.LiveTopology(spark, requests, Search(max_hops=2))
    run.baseline(pools(spark, s0))
    s1 = s0 | {51: (1, 1, 1, 2, 900, 900)}  # added
    s2 = s1 | {51: (1, 2, 1, 2, 950, 900)}  # state only
    s3 = s2 | {51: (2, 1, 1, 2, 950, 900)}  # same tokens, another generation
    s4 = {k: v for k, v in s3.items() if k != 2} | {1: (1, 2, 1, 3, 500, 500)}  # removed, other tokens
    for v, (a, b) in enumerate([(s0, s1), (s1, s2), (s2, s3), (s3, s4)], 1):
        run.on_batch(commit(spark, a, b, v), v)
    got = {r.version: (r.impact, r.graph_revision, r.added, r.removed, r.updated, r.replaced, r.revised) for r in run.reports().collect()}
    assert got[1] == ("localized", 1, 1, 0, 0, 0, 0) and got[2] == ("unchanged", 1, 0, 0, 0, 0, 1)
    assert got[3] == ("identity_changed", 2, 0, 0, 0, 1, 0) and got[4] == ("localized", 3, 0, 1, 1, 0, 0)
    rows = {r.version: (r.kept, r.repriced, r.opened, r.retracted) for r in run.reports().collect()}
    assert rows[1][2] > 0 and rows[2][1:] == (rows[2][1], 0, 0) and rows[2][1] > 0 and rows[3][1:] == (0, 0, 0) and rows[4][3] > 0
    # Reconciliation: a whole newer snapshot, of which only the difference tells.
    run.reconcile(pools(spark, s4), 9, "main")
    assert {r.version: (r.impact, r.graph_revision) for r in run.reports().collect()}[9] == ("unchanged", 3)
    run.reconcile(pools(spark, s1), 12, "main")
    assert {r.version: (r.impact, r.graph_revision) for r in run.reports().collect()}[12] == ("full_reconciliation", 4)
    assert by_request(run.routes()) == by_request(routes.enumerate_priced(requests, live.edges_of(pools(spark, s1)), Search(max_hops=2)))
    assert topology.semantic_change(live.index(pools(spark, s1)), live.index(pools(spark, s2))).first()[0] is False
    assert topology.semantic_change(live.index(pools(spark, s2)), live.index(pools(spark, s3))).first()[0] is True


def test_commits_that_cannot_follow(spark, requests):
    s0 = {1: (1, 1, 1, 2, 500, 500)}
    s1 = s0 | {2: (1, 1, 1, 2, 700, 600)}
    run = live.LiveTopology(spark, requests, Search(max_hops=1))
    run.baseline(pools(spark, s0))
    with pytest.raises(live.ForeignRuntime):
        run.on_batch(commit(spark, s0, s1, 1, runtime="other"), 0)
    with pytest.raises(live.VersionGap):
        run.on_batch(commit(spark, s0, s1, 2), 0)
    assert run.version() == 0
    run.on_batch(commit(spark, s0, s1, 1), 0)
    run.on_batch(commit(spark, s0, s1, 1), 0)  # replayed
    assert run.version() == 1 and run.reports().count() == 2
    for version in (0, 1):
        with pytest.raises(live.StaleSnapshot):
            run.reconcile(pools(spark, s0), version, "main")
    with pytest.raises(live.ForeignRuntime):
        run.reconcile(pools(spark, s0), 5, "other")
    with pytest.raises(live.CommitError):
        run.routes(at=0)
    assert {r.path_key for r in run.routes(at=1).collect() if r.request_id == 1} == {"1", "2"}


def test_an_edge_that_opens_nothing(spark, requests):
    state = pools(spark, {1: (1, 1, 1, 2, 500, 500), 9: (1, 1, 7, 8, 5, 5)})
    edges = live.edges_of(state)
    assert topology.opened(requests, edges, edges.where("pool = 9").select(*topology.EDGE), Search(max_hops=3)).count() == 0
    assert topology.opened(requests, edges, edges.where(F.lit(False)).select(*topology.EDGE), Search(max_hops=3)).count() == 0
