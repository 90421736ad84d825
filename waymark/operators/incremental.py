"""Incremental refresh: only what a change touches is priced again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators import topology


def affected(pools: DataFrame, logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pools that a log touches, and its counters (routed, unknown, removed). Removed logs are counted and skipped first."""
    known = logs.join(pools.select("pool", F.lit(True).alias("known")), "pool", "left")
    hit = known.where("NOT removed AND known").select("pool").distinct()
    counts = known.agg(F.count_if(~F.col("removed") & F.col("known").isNotNull()).alias("routed"), F.count_if(~F.col("removed") & F.col("known").isNull()).alias("unknown"), F.count_if(F.col("removed")).alias("removed"))
    return hit, counts


def index(found: DataFrame) -> DataFrame:
    """pool, request_id, path_key: which routes use a pool."""
    return found.select(F.explode("pools").alias("pool"), "request_id", "path_key")


def as_paths(found: DataFrame) -> DataFrame:
    """Routes as paths to price: path_id (request and path key), amount_in, hops."""
    hops = F.expr("transform(pools, (p, i) -> struct(p AS pool, tokens[i] AS token_in, tokens[i + 1] AS token_out))")
    return found.select(F.struct("request_id", "path_key").alias("path_id"), "amount_in", hops.alias("hops"))


def probes(found: DataFrame, edges: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """request_id, target, amount_in, tokens, pools, path_key: each route with one hop moved to a parallel pool that it doesn't use.

    Only paths that the routes don't hold already; a route gives as many probes as its hops have parallel pools. With `changed`
    (pool) only probes over one of these pools are made: a hop moves to a changed pool, or a route over a changed pool moves.
    """
    hop = found.select("request_id", "target", "amount_in", "tokens", "pools", F.posexplode("pools").alias("i", "old"))
    hop = hop.withColumn("token_in", F.expr("tokens[i]")).withColumn("token_out", F.expr("tokens[i + 1]"))
    other = edges.select("token_in", "token_out", F.col("pool").alias("new")).distinct()
    if changed is None:
        moved = hop.join(other, ["token_in", "token_out"])
    else:
        # Either the new pool has changed, or one of the route's other pools has.
        fresh = other.join(changed.select(F.col("pool").alias("new")), "new", "left_semi")
        held = index(found).join(changed.select("pool"), "pool", "left_semi").select("request_id", F.col("pool").alias("hit"), F.col("path_key").alias("k")).distinct()
        key = F.array_join(F.col("pools").cast("array<string>"), "|")
        stays = hop.withColumn("k", key).join(held, ["request_id", "k"]).where("old <> hit").drop("k", "hit").distinct()
        moved = hop.join(fresh, ["token_in", "token_out"]).unionByName(stays.join(other, ["token_in", "token_out"]), allowMissingColumns=True)
    moved = moved.where(~F.array_contains("pools", F.col("new")))
    moved = moved.withColumn("pools", F.expr("transform(pools, (p, j) -> CASE WHEN j = i THEN new ELSE p END)"))
    moved = moved.select("request_id", "target", "amount_in", "tokens", "pools", F.array_join(F.col("pools").cast("array<string>"), "|").alias("path_key")).dropDuplicates(["request_id", "path_key"])
    return moved.join(found.select("request_id", "path_key"), ["request_id", "path_key"], "left_anti")


def marked(rows: DataFrame, pools: DataFrame, longest: int) -> DataFrame:
    """rows (routes of at most `longest` pools) with _hit: whether they use one of pools (distinct).

    Each hop looks its pool up: no route is taken apart or shuffled to find those that are touched.
    """
    columns, hit = rows.columns, F.lit(False)
    for i in range(longest):
        rows = rows.join(pools.select(F.col("pool").alias(f"_p{i}")), F.get("pools", F.lit(i)) == F.col(f"_p{i}"), "left")
        hit = hit | F.col(f"_p{i}").isNotNull()
    return rows.withColumn("_hit", hit).select(*columns, "_hit")


def refresh(found: DataFrame, edges: DataFrame, changed: DataFrame, with_probes: bool = False, price: str = "constant_product", requests: DataFrame | None = None, reasons: DataFrame | None = None, longest: int | None = None) -> DataFrame:
    """request_id, previous, amount_out, path_key, repriced, status, reason of each request after some pools changed.

    Routes (and probes) over a changed pool are priced at the new edges; all others keep their outputs. status: unchanged if
    nothing was priced again and the best is the same, else updated; recompute_required where `reasons` (request_id, reason; see
    fallback) names one, and then nothing is priced and the previous best stays. Requests without a viable route, and those of
    `requests` without any route, have null outputs. One pass over the routes and one sum by request; where `longest`, the most pools that a
    route has, isn't told, one more pass finds it.
    """
    pools = changed.select("pool").distinct()
    if longest is None:
        longest = found.agg(F.max(F.size("pools"))).first()[0] or 0
    barred = reasons.where("reason IS NOT NULL").select("request_id", "reason") if reasons is not None else None
    rows = marked(found.select("request_id", "amount_in", "tokens", "pools", "path_key", F.col("amount_out").alias("old")), pools, longest)
    if barred is not None:
        rows = rows.join(barred.select("request_id", F.lit(True).alias("_barred")), "request_id", "left").withColumn("_hit", F.col("_hit") & F.col("_barred").isNull())
    # Routes that aren't priced again have no hops to look up; they stay in the same rows, so where routes are dealt by request nothing is shuffled.
    again = rows.select("request_id", "amount_in", "tokens", F.when(F.col("_hit"), F.col("pools")).alias("pools"), "path_key", "old", "_hit", F.lit(False).alias("probe"))
    if with_probes:
        live = found.join(barred, "request_id", "left_anti") if barred is not None else found
        again = again.unionByName(probes(live, edges, pools).select("request_id", "amount_in", "tokens", "pools", "path_key", F.lit(None).cast("long").alias("old"), F.lit(True).alias("_hit"), F.lit(True).alias("probe")))
    priced = topology.price_paths(again, edges, longest, price)
    every = priced.select("request_id", "path_key", "old", "probe", F.when(F.col("_hit"), F.col("amount_out")).otherwise(F.col("old")).alias("amount_out"), F.col("_hit").cast("int").alias("n"))
    rank = lambda c: F.struct(F.col(c).isNull(), -F.coalesce(c, F.lit(0)), "path_key")
    out = every.groupBy("request_id").agg(
        F.min_by(F.struct("amount_out", "path_key"), rank("amount_out")).alias("b"), F.min_by(F.struct(F.col("old").alias("amount_out"), "path_key"), F.when(~F.col("probe"), rank("old"))).alias("w"), F.sum("n").alias("repriced"),
    )
    if requests is not None:
        out = requests.select("request_id").distinct().join(out, "request_id", "left")
    if barred is not None:
        out = out.join(barred, "request_id", "left")
    else:
        out = out.withColumn("reason", F.lit(None).cast("string"))
    viable = lambda c: F.when(F.col(f"{c}.amount_out").isNotNull(), F.col(f"{c}.path_key"))
    same = F.col("w.amount_out").eqNullSafe(F.col("b.amount_out")) & viable("w").eqNullSafe(viable("b")) & (F.coalesce("repriced", F.lit(0)) == 0)
    status = F.when(F.col("reason").isNotNull(), "recompute_required").when(same, "unchanged").otherwise("updated")
    return out.select("request_id", F.col("w.amount_out").alias("previous"), F.col("b.amount_out").alias("amount_out"), viable("b").alias("path_key"), F.coalesce("repriced", F.lit(0)).cast("long").alias("repriced"), status.alias("status"), "reason")


#: Why a session must search again instead of refreshing; the first that holds is told.
FALLBACKS = ["removed_logs", "unknown_logs", "state_point_changed", "state_scope_changed", "topology_changed", "unknown_affected_pool", "degraded", "probe_budget_exceeded"]


def fallback(checks: DataFrame, budget: int = 256) -> DataFrame:
    """session, reason (null: refresh) from counters and flags of each session, in the order of FALLBACKS."""
    tests = ["removed > 0", "unknown > 0", "state_point_changed", "state_scope_changed", "topology_changed", "unknown_pools > 0", "degraded", f"probes > {budget}"]
    return checks.select("session", F.expr("CASE " + " ".join(f"WHEN {t} THEN '{r}'" for t, r in zip(tests, FALLBACKS, strict=True)) + " END").alias("reason"))


def apply_count_delta(state: DataFrame, delta: DataFrame) -> DataFrame:
    """token, pools after a delta (pool, before, after: token lists) on counts of pools by token; zero counts leave."""
    minus = delta.where("before IS NOT NULL").select(F.explode("before").alias("token"), F.lit(-1).cast("long").alias("pools"))
    plus = delta.where("after IS NOT NULL").select(F.explode("after").alias("token"), F.lit(1).cast("long").alias("pools"))
    return state.select("token", "pools").unionByName(minus).unionByName(plus).groupBy("token").agg(F.sum("pools").alias("pools")).where("pools <> 0")


def memo_stats(hops: DataFrame, times: Column | None = None) -> DataFrame:
    """requests, executed, hits, waits of a shared quote memo over hop keys (pool, token_in, token_out, amount_in).

    times: how many requests a row of hops stands for; by default one. Keys are summed first, so what is counted is a row a key.
    """
    keys = hops.groupBy("pool", "token_in", "token_out", "amount_in").agg(F.count("*").alias("n") if times is None else F.sum(times).alias("n"))
    # A key with a null isn't executed, as in a count of distinct keys.
    whole = F.expr("pool IS NOT NULL AND token_in IS NOT NULL AND token_out IS NOT NULL AND amount_in IS NOT NULL")
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("requests"), F.count_if(whole).alias("executed")).select("requests", "executed", (F.col("requests") - F.col("executed")).alias("hits"), F.lit(0).cast("long").alias("waits"))
