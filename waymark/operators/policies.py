"""Small decisions over tables: what may be executed and at what minimum, which pools serve a request, which registrations start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def execution_minimum(ranked: DataFrame, given: Column | None = None) -> DataFrame:
    """request_id, path_key, amount_out, minimum, error of each request's best route.

    ranked: request_id, rank, amount_in, amount_out, tokens, path_key. The minimum is `given` (a column of ranked) where it isn't null, else the second
    route's output, which must start from the same amount, join the same tokens and give no more than the best. The first check that
    fails is told and no minimum: no_second_route, amount_in, pair, order, zero.
    """
    best, other = F.struct("path_key", "amount_in", "amount_out", "tokens", (given if given is not None else F.lit(None).cast("long")).alias("given")), F.struct("amount_in", "amount_out", "tokens")
    both = ranked.where("rank <= 2").groupBy("request_id").agg(F.max(F.when(F.col("rank") == 1, best)).alias("b"), F.max(F.when(F.col("rank") == 2, other)).alias("s")).where("b IS NOT NULL")
    ends = lambda c: f"struct(element_at({c}.tokens, 1) AS a, element_at({c}.tokens, -1) AS z)"
    error = f"""CASE WHEN b.given = 0 THEN 'zero' WHEN b.given IS NOT NULL THEN NULL WHEN s IS NULL THEN 'no_second_route' WHEN s.amount_in <> b.amount_in THEN 'amount_in'
      WHEN {ends("s")} <> {ends("b")} THEN 'pair' WHEN b.amount_out < s.amount_out THEN 'order' WHEN s.amount_out = 0 THEN 'zero' END"""
    out = both.withColumn("error", F.expr(error))
    return out.select("request_id", "b.path_key", "b.amount_out", F.when(F.col("error").isNull(), F.coalesce("b.given", "s.amount_out")).alias("minimum"), "error")


def stable_rounding(routes: DataFrame, pools: DataFrame) -> DataFrame:
    """routes (request_id, pools, amount_out, simulated) with `accepted`: equal, or one unit short where the last hop is a stable-swap pool."""
    last = routes.withColumn("_last", F.element_at("pools", -1)).join(pools.select(F.col("pool").alias("_last"), "protocol"), "_last", "left")
    return last.withColumn("accepted", F.expr("coalesce(simulated = amount_out OR simulated + 1 = amount_out AND protocol = 'curve', false)")).drop("_last", "protocol")


def scale_amount(amount: str, numerator: str, denominator: str) -> str:
    """floor(amount * numerator / denominator) over 38 digits; null for a zero denominator."""
    return f"CAST(CAST(try_multiply(CAST({amount} AS DECIMAL(38, 0)), CAST({numerator} AS DECIMAL(38, 0))) AS DECIMAL(38, 0)) div nullif(CAST({denominator} AS DECIMAL(38, 0)), 0) AS BIGINT)"


def sub_floor(a: str, b: str) -> str:
    return f"CASE WHEN {a} > {b} THEN {a} - {b} ELSE 0 END"


def serves_pair(tokens: str, a: str, b: str) -> str:
    """A registration's tokens hold both of a pair."""
    return f"(array_contains({tokens}, {a}) AND array_contains({tokens}, {b}))"


def touches_any(tokens: str, some: str) -> str:
    return f"arrays_overlap({tokens}, {some})"


def startup(registrations: DataFrame, pair: tuple[int, int], most: int) -> DataFrame:
    """The first `most` registrations (pool, tokens, configured) with their place: configured ones, then those of the pair in focus, then by pool.

    The cut is a limit in that order, so only `most` rows leave each task.
    """
    order = [F.col("configured").desc(), F.expr(serves_pair("tokens", f"{pair[0]}L", f"{pair[1]}L")).desc(), F.col("pool")]
    first = registrations.orderBy(*order).limit(most)  # a report of at most so many rows
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)))
