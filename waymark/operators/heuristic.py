"""Bounded search: the first look over ranked edges, beams, dominance, caps, and re-ranked finalists."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.pricing import REGISTRY
from waymark.model import FastLane, Heuristic, Search
from waymark.operators import graph, liquidity, routes
from waymark.streaming.store import written


class Counters:
    """What a search leaves out and why, told by its own jobs while they write their tables; `values` adds up all levels and passes.

    A request that stands for several (`times`, see routes.alike) counts as often.

    ordered_groups, protocol_ranked_edges, balance_reads: groups of parallel edges, edges and balances in the ranking.
    shortlist_initial_edges, shortlist_deferred_edges, shortlist_refinement_edges: hops over the first ranked edges, edges that the first pass
    left for the second, and the second's hops. pruned_edges, stale_or_unknown_skipped_for_pruning: by balances. prefix_dominated_states.
    upper_bound_pruned_prefixes, upper_bound_unknown_prefixes: by what a target can pay. fast_lane_routes, fast_lane_quotes.
    """

    NAMES = (
        "ordered_groups", "protocol_ranked_edges", "balance_reads", "shortlist_initial_edges", "shortlist_deferred_edges", "shortlist_refinement_edges", "pruned_edges", "stale_or_unknown_skipped_for_pruning",
        "prefix_dominated_states", "upper_bound_pruned_prefixes", "upper_bound_unknown_prefixes", "fast_lane_routes", "fast_lane_quotes",
    )

    def __init__(self) -> None:
        self._seen: list[Observation] = []

    def on(self, df: DataFrame, **counts: Column) -> DataFrame:
        """df that tells the counts when it is written."""
        self._seen.append(Observation())
        return df.observe(self._seen[-1], *(c.cast("long").alias(k) for k, c in counts.items()))

    @staticmethod
    def count(df: DataFrame, of: Column | str = "true") -> Column:
        """How many rows of df meet a condition, each as often as its request is asked."""
        return F.sum(F.when(F.expr(of) if isinstance(of, str) else of, F.col("times") if "times" in df.columns else F.lit(1)))

    def values(self) -> dict[str, int]:
        """After the search; a table that never was written would make this wait."""
        out = dict.fromkeys(self.NAMES, 0)
        for seen in self._seen:
            try:
                told = seen.get
            except Py4JJavaError:  # a table that turned out empty while it was planned anew tells nothing
                told = {}
            for k, v in told.items():
                out[k] += v or 0
        return out

    def merge(self, other: "Counters") -> None:
        self._seen += other._seen


def fast_lane(requests: DataFrame, edges: DataFrame, balances: DataFrame, lane: FastLane, price: str = "constant_product") -> DataFrame:
    """Candidate routes of the first look: each pair's best direct edges, and two legs over the most central connectors.

    Columns of routes.enumerate_priced, and lane (direct or connector). The legs are one join on the connector.
    """
    top = liquidity.ranked_edges(edges, balances).where(F.col("position") <= max(lane.direct_edges, lane.leg_edges)).select("pool", "token_in", "token_out", "r_in", "r_out", "fee", "position")
    hubs = tuple(r["token"] for r in liquidity.central_connectors(liquidity.connector_scores(edges, balances), lane.max_connectors).select("token").collect())  # at most max_connectors
    direct = routes.enumerate_priced(requests, top.where(F.col("position") <= lane.direct_edges).drop("position"), Search(max_hops=1), price).withColumn("lane", F.lit("direct"))
    legs = top.where(F.col("position") <= lane.leg_edges).drop("position")
    via = routes.enumerate_priced(requests.drop("connectors"), legs, Search(min_hops=2, max_hops=2, connectors=hubs), price)
    return direct.unionByName(via.withColumn("lane", F.lit("connector")))


def keep_best_edges(grown: DataFrame, keep: int) -> DataFrame:
    """Of the prefixes that differ in their last pool only (a group of hops to one token), the `keep` with the largest outputs."""
    w = Window.partitionBy("request_id", F.slice("pools", 1, F.size("pools") - 1), "tokens").orderBy(F.desc("amount"), F.element_at("pools", -1))
    return grown.where("amount IS NOT NULL").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def beam(front: DataFrame, width: int) -> DataFrame:
    """The `width` prefixes of each request with the largest amounts."""
    w = Window.partitionBy("request_id").orderBy(F.desc("amount"), F.array_join(F.col("pools").cast("array<string>"), "|"))
    return front.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= width).drop("_n")


def future_blocked(front: DataFrame, edges: DataFrame) -> DataFrame:
    """front with blocked: the pools it has used that it would meet again at its token, toward a token that may follow."""
    near = edges.select("pool", F.col("token_in").alias("cur"), F.col("token_out").alias("next")).distinct()
    allowed = "next = target OR connectors IS NULL OR array_contains(connectors, next)"
    used = front.select("request_id", "cur", "target", "connectors", "tokens", "pools", F.explode("pools").alias("pool"))
    met = used.join(near, ["pool", "cur"]).where(f"NOT array_contains(tokens, next) AND ({allowed})").groupBy("request_id", "pools").agg(F.array_sort(F.collect_set("pool")).alias("blocked"))
    return front.join(met, ["request_id", "pools"], "left").withColumn("blocked", F.coalesce("blocked", F.expr("CAST(array() AS ARRAY<BIGINT>)")))


def undominated(front: DataFrame) -> DataFrame:
    """Prefixes that no other at the same token dominates: at least the amount with no more tokens visited and pools blocked.

    Pools are those of `blocked` (see future_blocked) where front has it, else all used ones. The order is partial; of equal
    labels the smaller path key stays. Labels meet only within a request and token, of which a bounded search has few.
    """
    held = "blocked" if "blocked" in front.columns else "pools"
    key = F.array_join(F.col("pools").cast("array<string>"), "|")
    label = front.select("request_id", "cur", "amount", "tokens", F.col(held).alias("held"), key.alias("_k"))
    a, b = front.withColumn("_k", key).withColumn("held", F.col(held)).alias("a"), label.alias("b")
    # What is cheap to see comes first: most pairs differ in length, in their second token or in their first pool.
    near = (F.size("b.tokens") <= F.size("a.tokens")) & (F.size("b.held") <= F.size("a.held"))
    near = near & F.coalesce(F.array_contains("a.tokens", F.get("b.tokens", F.lit(1))), F.lit(True)) & F.coalesce(F.array_contains("a.held", F.get("b.held", F.lit(0))), F.lit(True))
    subset = near & (F.size(F.array_except("b.tokens", "a.tokens")) == 0) & (F.size(F.array_except("b.held", "a.held")) == 0)
    same = (F.col("a.amount") == F.col("b.amount")) & (F.size("a.tokens") == F.size("b.tokens")) & (F.size("a.held") == F.size("b.held"))
    better = (F.col("b.amount") >= F.col("a.amount")) & subset & (~same | (F.col("b._k") < F.col("a._k")))
    on = (F.col("a.request_id") == F.col("b.request_id")) & (F.col("a.cur") == F.col("b.cur")) & (F.col("a._k") != F.col("b._k")) & better
    return a.join(b, on, "left_anti").drop("_k", "held")


def capped(front: DataFrame, caps: DataFrame, incumbent: DataFrame, counters: Counters | None = None) -> DataFrame:
    """Prefixes whose target can still pay out more than the best route so far; an unknown cap never prunes.

    caps: token and cap; or node, target and cap, of what is near enough to the prefix's token.
    """
    if "node" in caps.columns:
        t = front.join(caps.select(F.col("node").alias("cur"), "target", "cap"), ["cur", "target"], "left")
    else:
        t = front.join(caps.withColumnRenamed("token", "target"), "target", "left")
    t = t.join(incumbent.select("request_id", F.col("amount_out").alias("_best")), "request_id", "left")
    if counters is not None:
        t = counters.on(t, upper_bound_pruned_prefixes=counters.count(t, "cap <= _best"), upper_bound_unknown_prefixes=counters.count(t, "cap IS NULL AND _best IS NOT NULL"))
    out = t.where("cap IS NULL OR _best IS NULL OR cap > _best").drop("cap", "_best")
    return out if counters is None else written(out)


def balance_pruned(quotes: DataFrame) -> DataFrame:
    """quotes with pruned: edges of a group, in liquidity order, whose pool holds no more than the best output found before them.

    quotes has group columns request_id, token_in, token_out and position, amount, out_fresh, sure: whether the balance bounds the
    output, as the edge closes at the target or its pool has two tokens only; others are never pruned. A pruned edge isn't priced,
    so it does not raise the best; hence a fold over each group's sorted edges and not a running maximum. Groups are parallel
    edges of a pair.
    """
    quotes = quotes if "sure" in quotes.columns else quotes.withColumn("sure", F.lit(True))
    keys = [c for c in ("request_id", "times", "token_in", "token_out", "prefix") if c in quotes.columns]
    out = "CAST(array() AS ARRAY<STRUCT<pool: BIGINT, pruned: BOOLEAN>>)"
    cut = "coalesce(e.sure AND e.out_fresh <= s.best, false)"
    step = F.expr(f"""aggregate(edges, named_struct('best', CAST(NULL AS BIGINT), 'out', {out}),
      (s, e) -> named_struct('best', CASE WHEN {cut} THEN s.best ELSE greatest(s.best, e.amount) END, 'out', concat(s.out, array(named_struct('pool', e.pool, 'pruned', {cut})))))""")
    found = quotes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "pool", "amount", "out_fresh", "sure"))).alias("edges"))
    return found.select(*keys, F.explode(step["out"]).alias("e")).select(*keys, "e.pool", "e.pruned")


def with_connectors(requests: DataFrame, edges: DataFrame, h: Heuristic) -> DataFrame:
    """requests with connectors: the automatic ones without the request's own tokens."""
    hubs = [r["token"] for r in liquidity.auto_connectors(edges, h.auto_connectors + 2, h.min_degree).collect()]  # at most so many tokens
    every = F.array(*map(F.lit, hubs)).cast("array<bigint>")
    return requests.withColumn("connectors", F.slice(F.filter(every, lambda t: (t != F.col("token_in")) & (t != F.col("token_out"))), 1, h.auto_connectors) if h.auto_connectors else F.expr("CAST(array() AS ARRAY<BIGINT>)"))


def search(requests: DataFrame, edges: DataFrame, balances: DataFrame, bounds: Search, price: str = "constant_product", counters: Counters | None = None) -> DataFrame:
    """Finalists of the bounded search (columns of routes.enumerate_priced), at most `finalists` a request.

    With a shortlist there are two passes: over the first `initial` ranked edges of each pair, and over the first `refinement`;
    otherwise one over all. Each hop: join, leave out what can't reach the target in the hops that remain, prune parallel edges by
    balance, price, keep the best parallel edges, prune by what the target can pay out, drop dominated prefixes, cut to the
    beam. With target_first a hop's own closing routes already count against its other prefixes. Connectors are the given ones,
    else the automatic ones without the request's endpoints. counters is told what was left out.
    """
    h: Heuristic = bounds.heuristic
    if bounds.connectors is None and "connectors" not in requests.columns:
        requests = with_connectors(requests, edges, h)
    ranked = liquidity.ranked_edges(edges, balances)
    two = edges.groupBy("pool").agg(F.count_distinct("token_in").alias("_t")).select("pool", (F.col("_t") == 2).alias("two"))
    ranked = ranked.join(two, "pool").withColumn("of", F.count("*").over(Window.partitionBy("token_in", "token_out")))
    if counters is not None:
        ranked = counters.on(ranked, ordered_groups=F.count_if(F.col("position") == 1), protocol_ranked_edges=F.count("*"), balance_reads=2 * F.count("*"))
    ranked = written(ranked)
    done = []
    if h.fast_lane.enabled and bounds.min_hops <= 2:
        lane = fast_lane(requests, edges, balances, h.fast_lane, price).drop("lane")
        if counters is not None:
            lane = written(counters.on(lane, fast_lane_routes=counters.count(lane), fast_lane_quotes=counters.count(lane, "amount_out IS NOT NULL")))
        lane = lane.where((F.col("hops") >= bounds.min_hops) & (F.col("hops") <= bounds.max_hops) & F.col("amount_out").isNotNull())
        allowed = F.lit(None).cast("array<bigint>") if bounds.connectors is None else F.array(*map(F.lit, bounds.connectors)).cast("array<bigint>")
        asked = requests.select("request_id", (F.col("connectors") if "connectors" in requests.columns else allowed).alias("_c"))
        # The lane has connectors of its own; given ones hold for it too.
        if bounds.connectors is not None:
            lane = lane.join(asked, "request_id").where("hops = 1 OR array_contains(_c, tokens[1])").drop("_c")
        done.append(lane.drop("times"))
    limits = [h.shortlist.initial, h.shortlist.refinement] if h.shortlist.enabled else [None]
    for i, limit in enumerate(limits):
        kept = ranked if limit is None else ranked.where(F.col("position") <= limit)
        told = None
        if counters is not None and limit is not None:
            # A group's first edge stands for those of it that wait.
            later = F.sum(F.when(F.col("position") == 1, F.greatest(F.col("of") - limit, F.lit(0)) * (F.col("times") if "times" in requests.columns else F.lit(1))).otherwise(0))
            hops = counters.count(requests)
            told = {"shortlist_refinement_edges": hops} if i else {"shortlist_initial_edges": hops, "shortlist_deferred_edges": later}
        done.append(_pass(requests, kept, balances, bounds, price, counters, told))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return routes.ranked(out.dropDuplicates(["request_id", "path_key"]), h.finalists).drop("rank")


def _pass(requests: DataFrame, edges: DataFrame, balances: DataFrame, bounds: Search, price: str, counters: Counters | None = None, told: dict[str, Column] | None = None) -> DataFrame:
    """Routes of one pass over ranked edges (with position, of, out_fresh and two); told: what counters are told of each level's hops."""
    h = bounds.heuristic
    targets = requests.select(F.col("token_out").alias("target")).distinct()
    near = written(reach(edges, targets, bounds.max_hops - 1)) if bounds.max_hops > 1 else None
    caps = written(liquidity.caps_within(edges.drop("in_fresh", "out_fresh"), balances, targets, bounds.max_hops - 1)) if h.upper_bound and bounds.max_hops > 1 else None
    carry = ("position", "of", "out_fresh", "two")
    front, done, incumbent = routes.start(requests, bounds), [], None
    for hop in range(1, bounds.max_hops + 1):
        last, remaining = hop == bounds.max_hops, bounds.max_hops - hop
        grown = routes.expand(front, edges, price, last, False, carry)
        if not last:
            grown = grown.join(near.where(F.col("need") <= remaining).select(F.col("node").alias("cur"), "target"), ["cur", "target"], "left_semi")
        if counters is not None and h.balance_pruning:
            told = (told or {}) | {"stale_or_unknown_skipped_for_pruning": counters.count(grown, "out_fresh IS NULL")}
        if told:
            grown = counters.on(grown, **told)
        if h.balance_pruning or told:
            grown = written(grown)
        if h.balance_pruning:
            q = grown.select("request_id", *(c for c in ("times",) if c in grown.columns), F.expr("array_join(CAST(slice(pools, 1, size(pools) - 1) AS ARRAY<STRING>), '|')").alias("prefix"), F.col("cur").alias("token_out"), F.element_at("pools", -1).alias("pool"), "position", "amount", "out_fresh", F.expr("two OR cur = target").alias("sure"))
            cut = balance_pruned(q).where("pruned")
            if counters is not None:
                cut = counters.on(cut, pruned_edges=counters.count(cut))
            cut = cut.select("request_id", F.concat_ws("|", F.when(F.col("prefix") != "", F.col("prefix")), F.col("pool").cast("string")).alias("_k"), F.col("token_out").alias("cur"))
            grown = grown.withColumn("_k", F.array_join(F.col("pools").cast("array<string>"), "|")).join(cut, ["request_id", "_k", "cur"], "left_anti").drop("_k")
        grown = written(keep_best_edges(grown.drop(*carry), h.parallel_edges))  # bounded by beam x tokens a request
        closed = grown.where("cur = target")
        if hop >= bounds.min_hops:
            done.append(closed)
        if last:
            break
        front = grown.where("cur <> target")
        if hop >= bounds.min_hops:
            best = closed.select("request_id", "amount")
            now = best if incumbent is None else incumbent.unionByName(best)
        else:
            now = incumbent
        counts = now if h.target_first else incumbent
        if caps is not None and counts is not None:
            front = capped(front, caps.where(F.col("remaining") == remaining).drop("remaining"), counts.groupBy("request_id").agg(F.max("amount").alias("amount_out")), counters)
        incumbent = now
        if h.dominance:
            labels = future_blocked(front, edges)
            if counters is not None:
                labels = counters.on(labels, prefix_dominated_states=counters.count(labels))
            front = undominated(written(labels)).drop("blocked")
            if counters is not None:
                front = written(counters.on(front, prefix_dominated_states=-counters.count(front)))
        if h.beam_width is not None:
            front = beam(front, h.beam_width)
        front = written(front)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*routes.KEEP, "tokens", "pools", "amounts", F.col("amount").alias("amount_out"), F.size("pools").cast("long").alias("hops"), F.array_join(F.col("pools").cast("array<string>"), "|").alias("path_key"))


def find(requests: DataFrame, edges: DataFrame, bounds: Search, balances: DataFrame | None = None, price: str = "constant_product", cycles: bool = False) -> DataFrame:
    """Routes in the mode that the bounds name: exhaustive, or bounded (which needs balances, if only an empty table)."""
    if bounds.mode == "exhaustive" or cycles:
        return routes.enumerate_priced(requests, edges, bounds, price, cycles)
    if balances is None:
        balances = edges.select("pool", F.col("token_in").alias("token"), F.lit("unknown").alias("state"), F.lit(None).cast("long").alias("amount")).limit(0)
    return search(requests, edges, balances, bounds, price)


def sorted_groups(requests: DataFrame, edges: DataFrame, balances: DataFrame, connectors: list[int]) -> DataFrame:
    """request_id, token_out, edges, place: the first hop's groups of parallel edges in the order that a search tries them.

    The one that closes at the target comes first; then groups with known input balances by the largest and the sum, connectors
    before others, tokens of larger degree, and the token.
    """
    groups = edges.groupBy("token_in", "token_out").agg(F.count("*").alias("edges")).join(liquidity.branch_scores(edges, balances), ["token_in", "token_out"]).join(graph.degrees(edges).withColumnRenamed("token", "token_out"), "token_out")
    r = requests.select("request_id", "token_in", F.col("token_out").alias("target"))
    closes, known = F.expr("token_out = target"), F.expr("token_out <> target AND deepest IS NOT NULL")
    order = [closes.desc(), known.desc(), F.when(known, F.col("deepest")).desc(), F.when(known, F.col("total")).desc(), F.col("token_out").isin(connectors).desc(), F.desc("degree"), F.col("token_out")]
    return r.join(groups, "token_in").withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy(*order))).select("request_id", "token_out", "edges", "place")


def reach(edges: DataFrame, targets: DataFrame, max_hops: int) -> DataFrame:
    """node, target, need: the fewest hops from a node to a target, up to max_hops; a safe relaxation of simple-path reachability."""
    hops = edges.select(F.col("token_in").alias("node"), F.col("token_out").alias("next")).distinct()
    now = targets.select(F.col("target").alias("node"), "target", F.lit(0).alias("need"))
    every = now
    for i in range(1, max_hops + 1):
        now = hops.join(now.withColumnRenamed("node", "next"), "next").select("node", "target", F.lit(i).alias("need")).distinct()
        every = every.union(now)
    return every.groupBy("node", "target").agg(F.min("need").alias("need"))


def quoted_groups(requests: DataFrame, edges: DataFrame, balances: DataFrame, price: str = "constant_product") -> DataFrame:
    """The first hop's edges toward the target, priced, with their liquidity positions: the input of balance_pruned."""
    e = liquidity.ranked_edges(edges, balances)
    r = requests.select("request_id", F.col("token_in").alias("i"), F.col("token_out").alias("o"), F.col("amount_in"))
    return r.join(e, (F.col("i") == e["token_in"]) & (F.col("o") == e["token_out"])).select("request_id", "token_in", "token_out", "pool", "position", F.expr(REGISTRY[price]("amount_in")).alias("amount"), "out_fresh")
