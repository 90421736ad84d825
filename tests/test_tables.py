"""Versions, targets, raw logs, packed routes, batch prices, budgets and execution policies on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import binary, curves
from waymark.model import Search
from waymark.operators import policies, rawlogs, routes, targets, versions

WORD = lambda n: "0x" + format(n, "064x")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# Versions


def test_requests_of_several_versions_share_a_plan(spark):
    state = {0: [(1, 1, 2, 500, 500)], 1: [(1, 1, 2, 500, 500), (2, 1, 2, 900, 700)], 2: [(2, 1, 2, 900, 700), (3, 2, 3, 50, 60)], 3: [(1, 1, 2, 500, 500), (2, 1, 2, 900, 701)]}
    edges = spark.createDataFrame([(v, *e) for v, es in state.items() for e in es], "version long, pool long, token_in long, token_out long, r_in long, r_out long")
    past = versions.history(edges)
    assert rows(past.select("pool", "since", "until")) == [(1, 0, 2), (1, 3, 4), (2, 1, 3), (2, 3, 4), (3, 2, 3)]
    asked = spark.createDataFrame([(10 * v + t, 1, t, 100, v) for v in range(5) for t in (2, 3)], "request_id long, token_in long, token_out long, amount_in long, at long")
    got = versions.enumerate_at(asked, past, Search(max_hops=2))
    for v in state:
        one = routes.enumerate_priced(asked.where(F.col("at") == v).drop("at"), edges.where(F.col("version") == v).drop("version"), Search(max_hops=2))
        assert rows(got.where(F.col("at") == v).select("request_id", "path_key", "amount_out")) == rows(one.select("request_id", "path_key", "amount_out"))
    assert rows(versions.mismatched(asked, past)) == [(42, 4, "snapshot_mismatch"), (43, 4, "snapshot_mismatch")]
    # A route found at one version, quoted at the others.
    path = spark.createDataFrame([(v, 100, [1, 2, 3], [2, 3]) for v in range(5)], "at long, amount_in long, tokens array<long>, pools array<long>")
    quoted = {r.at: r.amount_out for r in versions.quote_at(path, past, 2).collect()}
    assert quoted[2] is not None and [quoted[v] for v in (0, 1, 3, 4)] == [None] * 4


# Targets

TARGET = "pool long, token long, source string, holder long, slot string, state string, amount long"


def test_reconciliation_keeps_what_is_the_same(spark):
    now = spark.createDataFrame([
        (1, 1, "erc20", 1, "s1", "fresh", 10), (1, 2, "erc20", 1, None, "stale", None), (2, 1, "erc20", 2, "s2", "fresh", 7), (2, 2, "vault", 9, None, "fresh", 5),
        (3, 1, "erc20", 3, None, "fresh", 4), (4, 1, "erc20", 4, None, "fresh", 3),
    ], TARGET)
    need = spark.createDataFrame([(1, 1, "erc20", 1), (1, 2, "erc20", 1), (2, 1, "erc20", 8), (2, 2, "erc20", 2), (5, 1, "unknown", None)], "pool long, token long, source string, holder long")
    table, report = targets.reconcile(now, need, spark.createDataFrame([(p,) for p in (1, 2, 3, 5)], "pool long"))
    assert rows(table) == [
        (1, 1, "erc20", 1, "s1", "fresh", 10), (1, 2, "erc20", 1, None, "stale", None), (2, 1, "erc20", 8, None, "unknown", None), (2, 2, "erc20", 2, None, "unknown", None),
        (4, 1, "erc20", 4, None, "fresh", 3), (5, 1, "unknown", None, None, "unknown", None),
    ]
    assert report.first().asDict() == {"added": 3, "removed": 3, "preserved_fresh": 1, "unknown": 1}


def test_writes_and_slots(spark):
    now = spark.createDataFrame([(1, 1, "erc20", 1, None, "unknown", None), (2, 1, "erc20", 1, "old", "fresh", 5), (3, 1, "vault", 1, None, "fresh", 6)], TARGET)
    writes = spark.createDataFrame([(1, 1, 1, "stale", None), (2, 1, 1, "set", 40), (3, 2, 1, "set", 1), (4, 2, 1, "stale", None), (5, 9, 1, "set", 1)], "seq long, pool long, token long, op string, amount long")
    table, errors = targets.write(now, writes)
    assert rows(table.select("pool", "state", "amount")) == [(1, "fresh", 40), (2, "stale", None), (3, "fresh", 6)]
    assert rows(errors) == [(5, 9, 1, "set", "unknown_pool_token")]
    table, counts = targets.discover(now, spark.createDataFrame([(1, 1, "old"), (7, 7, "x")], "token long, holder long, slot string"))
    assert rows(table.select("pool", "slot")) == [(1, "old"), (2, "old"), (3, None)] and rows(counts) == [(1, 1, 1), (7, 7, 0)]
    assert rows(targets.to_refresh(now, True).select("pool")) == [(1,)] and targets.to_refresh(now, False).count() == 3


# Raw logs


def test_raw_logs(spark):
    a, b = 0xA1 << 152, 2**160 - 1
    good = [binary.TRANSFER, WORD(a), WORD(b)]
    logs = spark.createDataFrame([
        (1, "0xAB", good, WORD(10**38 - 1), False), (2, "0xab", good, WORD(2**256 - 1) + "ff", True), (3, "0xab", [t.upper().replace("0X", "0x") for t in good], WORD(0)[2:], False),
        (4, "0xab", good[:2], WORD(1), False), (5, "0xab", [WORD(5), *good[1:]], WORD(1), False), (6, "0xab", good, "0x12", False), (7, "0xab", None, WORD(1), False),
        (8, "0xab", good, None, False), (9, "0xab", [*good[:2], "0xzz"], WORD(1), False), (10, "0xab", good, "0x" + "g" * 64, False), (11, "0xab", [*good, WORD(3)], WORD(2**64), False),
    ], "seq long, address string, topics array<string>, data string, removed boolean")
    got = {r.seq: r for r in rawlogs.transfers(logs).collect()}
    assert {s: r.value if r.value is None else int(r.value) for s, r in got.items()} == {1: 10**38 - 1, 2: None, 3: 0, 11: 2**64}
    assert (got[1].token, got[1].from_holder, got[1].to_holder) == ("0xab", "0x" + format(a, "040x"), "0x" + "f" * 40) and got[2].word == "f" * 64 and got[2].removed
    assert rows(rawlogs.problems(logs)) == [("data", 3), ("signature", 1), ("topics", 3)]


def test_packed_words_of_the_storage_decode(spark):
    from waymark.functions.scalars import high_112, low_112

    low, high = 123 + 2**100, 456 + 2**111
    w = spark.createDataFrame([(WORD(low | high << 112 | 7 << 224),)], "w string").selectExpr(f"{low_112('w')} AS low", f"{high_112('w')} AS high").first()
    assert (int(w.low), int(w.high)) == (low, high)


def test_packed_route_bytes(spark):
    hops = [{"tag": 0, "endpoint": 0x1111, "token_in": 1, "token_out": 2, "extra": ""}, {"tag": 6, "endpoint": 0x22, "token_in": 2, "token_out": 255, "extra": "0001"}]
    df = spark.createDataFrame([(255, hops)], "target long, hops array<struct<tag: int, endpoint: long, token_in: long, token_out: long, extra: string>>")
    got = df.select(F.expr(binary.packed_route("target", "hops")).alias("b")).first().b
    n = lambda v: v.to_bytes(20, "big")
    assert bytes(got) == n(255) + b"\x00" + n(0x1111) + n(1) + n(2) + b"\x06" + n(0x22) + n(2) + n(255) + b"\x00\x01"


# Batch prices


def plain_stable(x, y, a, amp, fee):
    ann, s = amp * 2, x + y
    d = s
    while True:
        p = d * d // (2 * x) * d // (2 * y)
        d, was = (ann * s + 2 * p) * d // ((ann - 1) * d + 3 * p), d
        if abs(d - was) <= 1:
            break
    new = x + a
    c, b = d * d // (2 * new) * d // (2 * ann), new + d // ann
    z = d
    while True:
        z, was = (z * z + c) // (2 * z + b - d), z
        if abs(z - was) <= 1:
            break
    got = y - z - 1
    return got - got * fee // 10_000


def test_stable_swap_prices_by_batch(spark):
    curves.register_batch("test_curve", curves.stable_swap(85))
    rng = random.Random(5)
    some = [(i, rng.randint(1, 10 ** rng.randint(1, 12)), rng.randint(1, 10**9), rng.randint(1, 10**9), rng.choice([None, 4, 30])) for i in range(300)]
    some += [(i, rng.randint(1, 2**18), rng.randint(1, 2**18), rng.randint(1, 2**18), rng.choice([None, 4])) for i in range(300, 600)]
    odd = [(600, None, 5, 5, 1), (601, 0, 5, 5, 1), (602, 5, 0, 5, 1), (603, 5, 5, None, 1), (604, -3, 5, 5, 1)]
    df = spark.createDataFrame(some + odd, "i long, amount long, r_in long, r_out long, fee long")
    got = {r.i: r.out for r in df.select("i", curves.quoted("test_curve").alias("out")).collect()}
    for i, a, x, y, fee in some:
        want = plain_stable(x, y, a, 85, 4 if fee is None else fee)
        assert got[i] == (want if want > 0 else None), (i, a, x, y)
    assert [got[i] for i in range(600, 605)] == [None] * 5


def test_paths_over_curves_price_hop_by_hop(spark):
    edges = spark.createDataFrame([(1, 1, 2, 100_000, 90_000, None), (2, 2, 3, 50_000, 70_000, 30), (3, 1, 3, 10, 10, None)], "pool long, token_in long, token_out long, r_in long, r_out long, fee long")
    asked = spark.createDataFrame([(1, 1, 3, 1000)], "request_id long, token_in long, token_out long, amount_in long")
    got = {r.path_key: r.amount_out for r in routes.enumerate_priced(asked, edges, Search(max_hops=2), "stable_swap").collect()}
    first = plain_stable(100_000, 90_000, 1000, 100, 4)
    assert got["1|2"] == plain_stable(50_000, 70_000, first, 100, 30) and got["3"] == plain_stable(10, 10, 1000, 100, 4)


# Budgets


@pytest.mark.parametrize("hops", [1, 2, 3])
@pytest.mark.parametrize("connectors", [None, (2, 3, 5)])
def test_budget_equals_the_cut_of_a_full_enumeration(spark, hops, connectors):
    rng = random.Random(hops)
    pools = [(p, *rng.sample(range(1, 7), 2)) for p in range(1, 40)] + [(100 + p, a, b) for p, toks in enumerate([(1, 2, 3), (2, 4, 6)]) for a in toks for b in toks if a < b]
    edges = spark.createDataFrame([(p, i, o, 500 + p, 900 - p) for p, a, b in pools for i, o in ((a, b), (b, a))], "pool long, token_in long, token_out long, r_in long, r_out long")
    asked = spark.createDataFrame([(10 * a + b, a, b, 100) for a in (1, 4) for b in (2, 6)] + [(99, 1, 77, 100)], "request_id long, token_in long, token_out long, amount_in long")
    full = sorted((r.request_id, r.hops, r.path_key, r.amount_out) for r in routes.enumerate_priced(asked, edges, Search(max_hops=hops, connectors=connectors)).collect())
    for most in (1, 7, 60):
        bound = Search(max_hops=hops, connectors=connectors, max_candidates=most)
        of = {q: [r for r in full if r[0] == q] for q in {r[0] for r in full}}
        want = sorted(r for rs in of.values() for r in rs[:most])
        assert sorted((r.request_id, r.hops, r.path_key, r.amount_out) for r in routes.enumerate_within(asked, edges, bound).collect()) == want
        seen = [r for rs in of.values() for i, r in enumerate(rs) if i % 3 == 0][: 2 * most]
        left = [r for q, rs in of.items() for r in [x for x in rs if x not in seen][: max(0, most - sum(s[0] == q for s in seen))]]
        known = spark.createDataFrame([(r[0], r[2]) for r in seen], "request_id long, path_key string")
        assert sorted((r.request_id, r.hops, r.path_key, r.amount_out) for r in routes.enumerate_within(asked, edges, bound, known).collect()) == sorted(left)


def test_prefixes_that_are_not_needed_are_cut(spark):
    front = spark.createDataFrame([(1, [p], 5) for p in range(10, 60)], "request_id long, pools array<long>, m long")
    left = spark.createDataFrame([(1, 12)], "request_id long, rest long")
    kept = routes.first_prefixes(front, left, F.col("m")).collect()
    assert sorted(r.pools[0] for r in kept) == [10, 11, 12]
    assert routes.first_prefixes(front, left.withColumn("rest", F.lit(0).cast("long")), F.col("m")).count() == 0


# Policies


def test_execution_minimum(spark):
    made = [
        (1, 1, 100, 50, [1, 2], "a"), (1, 2, 100, 40, [1, 3, 2], "b"), (2, 1, 100, 50, [1, 2], "a"), (3, 1, 100, 50, [1, 2], "a"), (3, 2, 90, 40, [1, 2], "b"),
        (4, 1, 100, 50, [1, 2], "a"), (4, 2, 100, 40, [1, 9], "b"), (5, 1, 100, 50, [1, 2], "a"), (5, 2, 100, 60, [1, 2], "b"), (6, 1, 100, 0, [1, 2], "a"), (6, 2, 100, 0, [1, 2], "b"),
    ]
    df = spark.createDataFrame(made, "request_id long, rank int, amount_in long, amount_out long, tokens array<long>, path_key string")
    got = {r.request_id: (r.minimum, r.error) for r in policies.execution_minimum(df).collect()}
    assert got == {1: (40, None), 2: (None, "no_second_route"), 3: (None, "amount_in"), 4: (None, "pair"), 5: (None, "order"), 6: (None, "zero")}
    given = {r.request_id: (r.minimum, r.error) for r in policies.execution_minimum(df, F.expr("CASE request_id WHEN 2 THEN 7L WHEN 3 THEN 0L END")).collect()}
    assert given[2] == (7, None) and given[3] == (None, "zero")


def test_small_predicates(spark):
    r = spark.range(1).selectExpr(
        f"{policies.scale_amount('7', '10', '3')} AS a", f"{policies.scale_amount('7', '10', '0')} AS b", f"{policies.scale_amount('9000000000000000000', '10', '100')} AS c", f"{policies.sub_floor('3', '5')} AS d", f"{policies.sub_floor('5', '3')} AS e",
        f"{policies.serves_pair('array(1, 2, 3)', '1', '3')} AS f", f"{policies.serves_pair('array(1, 2, 3)', '1', '4')} AS g", f"{policies.touches_any('array(1, 2)', 'array(2, 9)')} AS h",
    ).first()
    assert tuple(r) == (23, None, 900_000_000_000_000_000, 0, 2, True, False, True)
    some = spark.createDataFrame([(p, [p, p + 1], p == 9) for p in range(20)], "pool long, tokens array<long>, configured boolean")
    assert [x.pool for x in policies.startup(some, (4, 5), 4).orderBy("place").collect()] == [9, 4, 0, 1]
