"""Queries pinned to versions: edges hold from one version to another, and each request joins those of its own version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.model import Search
from waymark.operators import routes, topology


def history(edges: DataFrame) -> DataFrame:
    """pool, token_in, token_out, what they are priced by, since, until: the edges of each version (`version`) as intervals [since, until).

    An edge that is the same in versions that follow each other is one row, so the table grows with changes, not with versions.
    """
    columns = [c for c in edges.columns if c not in ("version", *topology.EDGE)]
    of = Window.partitionBy(*topology.EDGE).orderBy("version")
    same = F.struct(*columns).eqNullSafe(F.lag(F.struct(*columns)).over(of)) & (F.col("version") == F.lag("version").over(of) + 1)
    runs = edges.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(of))
    return runs.groupBy(*topology.EDGE, "_run").agg(*(F.first(c).alias(c) for c in columns), F.min("version").alias("since"), (F.max("version") + 1).alias("until")).drop("_run")


def enumerate_at(requests: DataFrame, past: DataFrame, search: Search, price: str = "constant_product") -> DataFrame:
    """routes.enumerate_priced with `at`: all simple paths of each request over the edges that hold at its version (requests' `at`).

    Requests of any number of versions share one plan: each hop is an interval join.
    """
    return routes.enumerate_priced(requests, past, search, price)


def quote_at(paths: DataFrame, past: DataFrame, max_hops: int, price: str = "constant_product") -> DataFrame:
    """paths (at, amount_in, tokens, pools, ...) with amount_out at their version; null where a hop's edge doesn't hold then."""
    return topology.price_paths(paths, past, max_hops, price)


def mismatched(requests: DataFrame, past: DataFrame) -> DataFrame:
    """Requests (request_id, at) whose version no edge is known of: before the first or after the last."""
    span = past.agg(F.min("since").alias("first"), F.max("until").alias("end"))
    return requests.join(F.broadcast(span)).where("NOT coalesce(at >= first AND at < end, false)").select("request_id", "at", F.lit("snapshot_mismatch").alias("error"))
