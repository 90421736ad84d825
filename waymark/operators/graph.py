"""Graph build and mutation: registrations become directed edges, parallel pools stay separate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def indexable(include_degraded: bool = False) -> str:
    return "status = 'ready'" + (" OR status = 'degraded'" if include_degraded else "")


def classify(registrations: DataFrame, include_degraded: bool = False) -> DataFrame:
    """registrations with tokens (sorted, distinct) and reason: null if indexed, else the first check that fails.

    Pools with coins use them; others need both t0 and t1. Protocol `custom` has no readable metadata.
    """
    listed = F.expr("CASE WHEN protocol IN ('curve', 'balancer') THEN coins WHEN protocol = 'custom' THEN NULL ELSE array(t0, t1) END")
    out = registrations.withColumn("tokens", F.array_sort(F.array_distinct(listed)))
    reason = f"""CASE WHEN NOT ({indexable(include_degraded)}) OR status IS NULL THEN 'status'
      WHEN protocol IN ('curve', 'balancer') AND coins IS NULL THEN 'missing_metadata'
      WHEN protocol NOT IN ('curve', 'balancer', 'custom') AND (t0 IS NULL OR t1 IS NULL) THEN 'missing_metadata'
      WHEN protocol = 'custom' THEN 'unsupported' WHEN size(tokens) < 2 THEN 'too_few_tokens' END"""
    return out.withColumn("reason", F.expr(reason))


def indexed(registrations: DataFrame, include_degraded: bool = False) -> DataFrame:
    """pool, tokens of the pools that belong in the graph."""
    return classify(registrations, include_degraded).where("reason IS NULL").select("pool", "tokens")


def skipped(registrations: DataFrame, include_degraded: bool = False) -> DataFrame:
    return classify(registrations, include_degraded).where("reason IS NOT NULL").select("pool", "reason", F.expr("CASE WHEN reason = 'too_few_tokens' THEN CAST(size(tokens) AS BIGINT) END").alias("count"))


def build(pools: DataFrame) -> DataFrame:
    """pool, token_in, token_out: all ordered pairs of a pool's tokens; a narrow expansion."""
    return pools.select("pool", F.explode("tokens").alias("token_in"), "tokens").select("pool", "token_in", F.explode("tokens").alias("token_out")).where("token_in <> token_out")


def stats(edges: DataFrame) -> DataFrame:
    """tokens, edges, pools of the whole graph."""
    ends = edges.select(F.explode(F.array("token_in", "token_out")).alias("t"))
    return edges.agg(F.count("*").alias("edges"), F.count_distinct("pool").alias("pools")).join(ends.agg(F.count_distinct("t").alias("tokens")))


def degrees(edges: DataFrame) -> DataFrame:
    """token, degree: in and out edges together, parallel ones counted."""
    return edges.select(F.explode(F.array("token_in", "token_out")).alias("token")).groupBy("token").agg(F.count("*").alias("degree"))


def token_stats(edges: DataFrame) -> DataFrame:
    """token, pools: how many pools hold each token."""
    return edges.groupBy(F.col("token_in").alias("token")).agg(F.count_distinct("pool").alias("pools"))


def pair_pools(edges: DataFrame, least: int = 1) -> DataFrame:
    """low, high, pools (sorted): pools by unordered pair, where at least `least` serve it."""
    out = edges.where("token_in < token_out").groupBy(F.col("token_in").alias("low"), F.col("token_out").alias("high")).agg(F.array_sort(F.collect_set("pool")).alias("pools"))
    return out.where(F.size("pools") >= least)


def parallel_neighbours(edges: DataFrame, pools: DataFrame) -> DataFrame:
    """pool: all pools that serve a pair which one of `pools` serves, themselves included."""
    pairs = edges.join(pools, "pool", "left_semi").select("token_in", "token_out").distinct()
    return edges.join(pairs, ["token_in", "token_out"], "left_semi").select("pool").distinct()


def tracked_tokens(edges: DataFrame, parallel_only: bool) -> DataFrame:
    """pool, token: the tokens of each pool; with parallel_only those of pairs that at least two pools serve."""
    if not parallel_only:
        return edges.select("pool", F.col("token_in").alias("token")).distinct()
    shared = edges.groupBy("token_in", "token_out").agg(F.count_distinct("pool").alias("n")).where("n >= 2").drop("n")
    return edges.join(shared, ["token_in", "token_out"], "left_semi").select("pool", F.explode(F.array("token_in", "token_out")).alias("token")).distinct()


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """pool, change (added, removed, updated, unchanged), removed_edges, added_edges for two tables of pool, tokens."""
    both = before.select("pool", F.col("tokens").alias("b")).join(after.select("pool", F.col("tokens").alias("a")), "pool", "full_outer")
    change = F.expr("CASE WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'removed' WHEN a <> b THEN 'updated' ELSE 'unchanged' END")
    pairs = lambda c: F.expr(f"CAST(coalesce(size({c}) * (size({c}) - 1), 0) AS BIGINT)")
    out = both.withColumn("change", change)
    moved = F.col("change") != "unchanged"
    return out.select("pool", "change", F.when(moved & F.col("b").isNotNull(), pairs("b")).otherwise(0).alias("removed_edges"), F.when(moved & F.col("a").isNotNull(), pairs("a")).otherwise(0).alias("added_edges"))


def remove_pools(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without the pools; tokens stay in their own table unless they are compacted."""
    return edges.join(gone, "pool", "left_anti")


def compacted_tokens(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("token_in").alias("token")).union(edges.select("token_out")).distinct()


def orphans(tokens: DataFrame, edges: DataFrame) -> DataFrame:
    """Tokens that no edge touches: what compacting removes."""
    return tokens.join(compacted_tokens(edges), "token", "left_anti")


#: How far a change reaches, least first.
IMPACT = ["unchanged", "identity_changed", "localized", "full_reconciliation"]


def impact(changes: DataFrame) -> DataFrame:
    """revision_bump, impact of one batch from its changes: topology changes bump the revision once, whatever their number."""
    rank = F.expr("CASE change WHEN 'unchanged' THEN 0 WHEN 'identity' THEN 1 WHEN 'updated' THEN 2 WHEN 'added' THEN 2 WHEN 'removed' THEN 2 ELSE 3 END")
    return changes.agg(F.coalesce(F.max(rank), F.lit(0)).alias("rank")).select((F.col("rank") >= 2).cast("int").alias("revision_bump"), F.element_at(F.array(*map(F.lit, IMPACT)), F.col("rank") + 1).alias("impact"))
