"""Benchmark and presentation analytics: percentiles, gaps, caps by protocol, searches, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.model import QuotePolicy


def nearest_rank(samples: DataFrame, group: str, value: str, percents: list[int]) -> DataFrame:
    """group, n, p<percent>..., worst: the value at sorted index ((n-1)*p) div 100.

    The place comes from counts of equal values, so a group is never sorted as a whole; samples of a group share few values or many.
    """
    by = samples.groupBy(group, value).agg(F.count("*").alias("c"))
    upto = by.withColumn("upto", F.sum("c").over(Window.partitionBy(group).orderBy(value))).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    picks = [F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * p / 100), F.col(value))).alias(f"p{p}") for p in percents]
    return upto.groupBy(group).agg(F.first("n").alias("n"), *picks, F.max(value).alias("worst"))


def round_robin(pools: DataFrame, most: int) -> DataFrame:
    """The first `most` pools taken from the protocols in turn, by pool within a protocol."""
    w = Window.partitionBy("protocol").orderBy("pool_id")
    return pools.withColumn("turn", F.row_number().over(w)).orderBy("turn", "protocol").limit(most).select("pool_id", "protocol", "turn")


def quotas(total: int, jobs: int) -> list[int]:
    """An even split, the remainder first."""
    return [total // jobs + (i < total % jobs) for i in range(jobs)]


def top_counts(rows: DataFrame, key: str, most: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(most)


def build_queries(tokens: DataFrame, connectors: list[int], most: int) -> DataFrame:
    """n, token_in, token_out: pairs from connectors first, then all pairs, each once, in token order. tokens is a configured list."""
    pairs = tokens.toDF("token_in").join(tokens.toDF("token_out"), F.col("token_in") != F.col("token_out"))
    hub = F.col("token_in").isin(connectors) & F.col("token_out").isin(connectors)
    return pairs.withColumn("hub", hub.cast("int")).orderBy(F.desc("hub"), "token_in", "token_out").limit(most).select("token_in", "token_out", "hub")


def keep_previous(new: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """Fresh values where there are, else those of before."""
    return old.select(key, F.col(value).alias("_old")).join(new.select(key, F.col(value).alias("_new")), key, "full_outer").select(key, F.coalesce("_new", "_old").alias(value), F.col("_new").isNull().alias("stale"))


def lookup_symbol(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, n, token (null unless exactly one entry has the symbol, whatever its case)."""
    hit = wanted.join(entries, F.lower("wanted") == F.lower("symbol"), "left")
    return hit.groupBy("wanted").agg(F.count("token").alias("n"), F.min("token").alias("token")).withColumn("token", F.when(F.col("n") == 1, F.col("token")))


def coverage(events: DataFrame, now: int, ttl: int) -> DataFrame:
    """token, state, updated, usable: the last state of each token's ledger (seq order); an empty one holds for ttl."""
    last = events.groupBy("token").agg(F.max_by(F.struct("state", "updated"), "seq").alias("s"))
    usable = F.expr(f"s.state = 'ready' OR (s.state = 'empty' AND {now} - s.updated < {ttl})")
    return last.select("token", "s.state", "s.updated", usable.alias("usable"))


def latest(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The value of the largest generation of each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def check_requests(requests: DataFrame, policy: QuotePolicy) -> DataFrame:
    """requests with error: the first cap that a request breaks, else null."""
    error = f"""CASE WHEN amount_in <= 0 THEN 'amount' WHEN hops < 1 OR hops > {policy.max_hops} THEN 'hops' WHEN top_k < 1 OR top_k > {policy.max_top_k} THEN 'top_k'
      WHEN timeout_ms < 1 OR timeout_ms > {policy.max_timeout_ms} THEN 'timeout' WHEN quality = 'exhaustive' AND NOT {str(policy.allow_exhaustive).lower()} THEN 'exhaustive' WHEN quality NOT IN ('fast', 'balanced', 'exhaustive') THEN 'quality' END"""
    return requests.withColumn("error", F.expr(error))
