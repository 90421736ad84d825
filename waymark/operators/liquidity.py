"""Balances beside the graph: usable amounts, scores, rankings, caps, and their maintenance by transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.pricing import fee_rank, log2_floor, protocol_bonus
from waymark.operators import graph

FRESH = "CASE WHEN state = 'fresh' THEN amount END"


def usable(balances: DataFrame) -> DataFrame:
    """pool, token, fresh: the amount where it is fresh, else null."""
    return balances.select("pool", "token", F.expr(FRESH).alias("fresh"))


def targets(edges: DataFrame, pools: DataFrame, all_edges: bool = False) -> DataFrame:
    """pool, token, source: what a liquidity index tracks; a Balancer pool's tokens lie in a vault, others with the pool itself."""
    held = graph.tracked_tokens(edges, parallel_only=not all_edges)
    return held.join(pools.select("pool", "protocol"), "pool").select("pool", "token", F.expr("CASE protocol WHEN 'balancer' THEN 'vault' WHEN 'custom' THEN 'unknown' ELSE 'holder' END").alias("source"))


def transfer_sources(targets: DataFrame) -> DataFrame:
    """token, holders: the pools whose transfers matter, by token, sorted."""
    return targets.where("source = 'holder'").groupBy("token").agg(F.array_sort(F.collect_set("pool")).alias("holders"))


def connector_scores(edges: DataFrame, balances: DataFrame) -> DataFrame:
    """token, known_balances, degree, log_sum over the distinct pools of each token."""
    held = usable(balances).groupBy("token").agg(F.count("fresh").alias("known_balances"), F.coalesce(F.sum(F.expr(log2_floor("fresh"))), F.lit(0)).alias("log_sum"))
    return graph.degrees(edges).join(held, "token", "left").select("token", F.coalesce("known_balances", F.lit(0)).alias("known_balances"), "degree", F.coalesce("log_sum", F.lit(0)).alias("log_sum"))


def central_connectors(scores: DataFrame, most: int, without: list[int] | None = None) -> DataFrame:
    """The first tokens by known balances, degree, log sum and token; a top-k, not a sort of all."""
    usable_tokens = scores if not without else scores.where(~F.col("token").isin(without))
    return usable_tokens.orderBy(F.desc("known_balances"), F.desc("degree"), F.desc("log_sum"), "token").limit(most)


def auto_connectors(edges: DataFrame, most: int = 8, least_degree: int = 6, without: list[int] | None = None) -> DataFrame:
    d = graph.degrees(edges).where(F.col("degree") >= least_degree)
    return (d if not without else d.where(~F.col("token").isin(without))).orderBy(F.desc("degree"), "token").limit(most)


def with_balances(edges: DataFrame, balances: DataFrame) -> DataFrame:
    """edges with in_fresh and out_fresh: the usable balances at either side of the pool."""
    b = usable(balances)
    out = edges.join(b.select("pool", F.col("token").alias("token_in"), F.col("fresh").alias("in_fresh")), ["pool", "token_in"], "left")
    return out.join(b.select("pool", F.col("token").alias("token_out"), F.col("fresh").alias("out_fresh")), ["pool", "token_out"], "left")


def edge_order() -> list:
    """Edges with both balances known first, by the score of the smaller balance and the protocol, then balances; all then by protocol, fee, pool."""
    known = "(in_fresh IS NOT NULL AND out_fresh IS NOT NULL)"
    score = f"({log2_floor('least(in_fresh, out_fresh)')}) * 100 + {protocol_bonus('protocol')}"
    both = lambda e: F.expr(f"CASE WHEN {known} THEN {e} END").desc()
    return [F.expr(f"NOT {known}"), both(score), both("out_fresh"), both("in_fresh"), F.expr(f"CASE WHEN {known} THEN 0 ELSE {protocol_bonus('protocol')} END").desc(), F.expr(fee_rank("fee")), F.col("pool")]


def ranked_edges(edges: DataFrame, balances: DataFrame) -> DataFrame:
    """edges with position: the place of each among the parallel edges of its directed pair."""
    w = Window.partitionBy("token_in", "token_out").orderBy(*edge_order())
    return with_balances(edges, balances).withColumn("position", F.row_number().over(w))


def shortlist(edges: DataFrame, balances: DataFrame, keep: int) -> DataFrame:
    """The first `keep` edges of each pair, and how many were deferred."""
    w = Window.partitionBy("token_in", "token_out")
    return ranked_edges(edges, balances).withColumn("deferred", F.greatest(F.count("*").over(w) - keep, F.lit(0))).where(F.col("position") <= keep)


def target_caps(edges: DataFrame, balances: DataFrame) -> DataFrame:
    """token, cap: the most that any last hop can pay out; null (unknown) if a balance isn't fresh."""
    e = with_balances(edges, balances)
    return e.groupBy(F.col("token_out").alias("token")).agg(F.when(F.count_if(F.col("out_fresh").isNull()) == 0, F.max("out_fresh")).alias("cap"))


def caps_within(edges: DataFrame, balances: DataFrame, targets: DataFrame, max_hops: int) -> DataFrame:
    """node, target, remaining, cap: the most that a route of at most `remaining` more hops from a node can pay out at a target.

    Only last hops that lie so near count; cap is null (unknown) if the balance of one of them isn't fresh. One join a hop over
    distinct pairs of tokens, for the targets (target) that are asked for.
    """
    e = with_balances(edges, balances)
    closing = e.join(targets.select("target").distinct(), F.col("token_out") == F.col("target")).groupBy(F.col("token_in").alias("node"), "target").agg(F.max("out_fresh").alias("most"), F.max(F.col("out_fresh").isNull()).alias("open"))
    steps = edges.select(F.col("token_in").alias("node"), F.col("token_out").alias("next")).distinct()
    now = closing
    out = now.withColumn("remaining", F.lit(1))
    for r in range(2, max_hops + 1):
        further = steps.join(now.withColumnRenamed("node", "next"), "next").where("next <> target").select("node", "target", "most", "open")
        now = closing.unionByName(further).groupBy("node", "target").agg(F.max("most").alias("most"), F.max("open").alias("open"))
        out = out.unionByName(now.withColumn("remaining", F.lit(r)))
    return out.select("node", "target", "remaining", F.when(~F.col("open"), F.col("most")).alias("cap"))


def branch_scores(edges: DataFrame, balances: DataFrame) -> DataFrame:
    """token_in, token_out, deepest, total: usable input balances of each group of parallel edges; null if none is known.

    A search ranks only groups that don't close at its target by them.
    """
    e = with_balances(edges, balances)
    return e.groupBy("token_in", "token_out").agg(F.max("in_fresh").alias("deepest"), F.sum("in_fresh").alias("total"))


def reconcile(before: DataFrame, after: DataFrame) -> DataFrame:
    """pool, token, change of two target tables; a changed source is a removal and an addition, a fresh balance survives."""
    b, a = before.select("pool", "token", F.col("source").alias("sb")), after.select("pool", "token", F.col("source").alias("sa"))
    change = F.expr("CASE WHEN sb IS NULL THEN 'added' WHEN sa IS NULL THEN 'removed' WHEN sa <> sb THEN 'replaced' ELSE 'kept' END")
    return b.join(a, ["pool", "token"], "full_outer").select("pool", "token", change.alias("change"))


def apply_transfers(balances: DataFrame, transfers: DataFrame) -> DataFrame:
    """balances after an ordered log (seq, token, from_pool, to_pool, value, removed).

    From a balance that is fresh, a holder's transfers add up; a removed (reorganised) log or an underflow makes it stale for good.
    A touched balance that isn't fresh, unknown ones too, becomes stale. Each log touches two balances; sums are taken per
    balance in log order.
    """
    sides = transfers.select("seq", "token", F.explode(F.array(F.struct(F.col("from_pool").alias("pool"), (-F.col("value")).alias("delta")), F.struct(F.col("to_pool").alias("pool"), F.col("value").alias("delta")))).alias("s"), "removed")
    sides = sides.select("seq", "token", "s.pool", "s.delta", "removed").where("pool IS NOT NULL")
    w = Window.partitionBy("pool", "token").orderBy("seq", "delta").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sides.withColumn("sum", F.sum("delta").over(w))
    net = running.groupBy("pool", "token").agg(F.sum("delta").alias("net"), F.min("sum").alias("low"), F.max(F.col("removed").cast("int")).alias("undone"))
    out = balances.join(net, ["pool", "token"], "left")
    ok = "state = 'fresh' AND undone = 0 AND amount + low >= 0"
    return out.select("pool", "token", F.expr(f"CASE WHEN net IS NULL THEN state WHEN {ok} THEN 'fresh' ELSE 'stale' END").alias("state"), F.expr(f"CASE WHEN net IS NULL AND state = 'fresh' THEN amount WHEN {ok} THEN amount + net END").alias("amount"))


def storage_updates(balances: DataFrame, writes: DataFrame) -> DataFrame:
    """balances after absolute writes (seq, pool, token, value): the last value wins and is fresh."""
    last = writes.groupBy("pool", "token").agg(F.max_by("value", "seq").alias("value"))
    return balances.join(last, ["pool", "token"], "left").select("pool", "token", F.when(F.col("value").isNotNull(), F.lit("fresh")).otherwise(F.col("state")).alias("state"), F.coalesce("value", F.expr(FRESH)).alias("amount"))


def refresh_from_snapshot(targets: DataFrame, snapshot: DataFrame) -> DataFrame:
    """pool, token, state, amount: what a snapshot (pool, token, value) holds; a missing slot is unknown."""
    return targets.join(snapshot, ["pool", "token"], "left").select("pool", "token", F.when(F.col("value").isNull(), "unknown").otherwise("fresh").alias("state"), F.col("value").alias("amount"))
