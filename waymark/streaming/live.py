"""Continuous queries: a change feed drives merges, repricing and versioned results, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waymark.model import Search
from waymark.operators import routes, topology
from waymark.streaming.store import Store, written

ROUTE = ["request_id", "target", "amount_in", "tokens", "pools", "path_key", "amount_out"]


def merge_changes(pools: DataFrame, batch: DataFrame) -> DataFrame:
    """pools with r0 moved by the batch's kept logs (pool_id, k, removed); unknown pools and removed logs move nothing."""
    by = batch.where("NOT removed").groupBy("pool_id").agg(F.sum("k").alias("moved"))
    return pools.join(by, "pool_id", "left").withColumn("r0", F.col("r0") + F.coalesce("moved", F.lit(0))).drop("moved")


def edges_of(pools: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.col("t0").alias("i"), F.col("t1").alias("o"), F.col("r0").alias("a"), F.col("r1").alias("b")), F.struct(F.col("t1").alias("i"), F.col("t0").alias("o"), F.col("r1").alias("a"), F.col("r0").alias("b")))
    return pools.select(F.col("pool_id").alias("pool"), F.explode(both).alias("e"), "fee").select("pool", F.col("e.i").alias("token_in"), F.col("e.o").alias("token_out"), F.col("e.a").alias("r_in"), F.col("e.b").alias("r_out"), "fee")


class LiveRoutes:
    """Best routes of subscriptions (requests), kept up to date by a stream of changes.

    Each micro-batch: refuse a gap, merge the pools, price the standing bests again, search, and commit pools and bests as one generation.
    A best that gives as much as before, or more, is only beaten by a route over a touched pool, so these alone are priced; where a best has
    fallen, all routes of its request are. Paths are found once for all that ask for the same tokens. Routes are not written: they follow
    from a generation's pools (`routes`).
    A batch that is replayed after a failure finds its version committed and does nothing.
    """

    def __init__(self, spark: SparkSession, requests: DataFrame, max_hops: int = 2, store: Store | None = None) -> None:
        self.spark, self.requests, self.search, self.store = spark, requests, Search(max_hops=max_hops), store or Store(spark)
        self.store.views["routes"], self.paths = self.routes, None

    def _paths(self, edges: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """The requests' paths with the numbers of their hops. Changes move reserves, not edges, so the paths themselves are found once."""
        if self.paths is None:
            self.paths = written(routes.paths_between(self.requests, edges, self.search))
        return routes.with_hops(self.paths, edges, self.search, keep)

    def routes(self) -> DataFrame:
        """All routes at the prices of the last generation."""
        paths = written(self._paths(edges_of(self.store.read("pools"))))
        return routes.priced_over(self.requests, paths, self.search).select(*ROUTE)

    def baseline(self, pools: DataFrame) -> None:
        pools = written(pools)
        paths = written(self._paths(edges_of(pools)))
        found = routes.best_over(self.requests, paths, self.search)
        self.store.commit(0, {"pools": pools, "best": found.select(*ROUTE, F.lit(0).cast("long").alias("version"))})

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        if version <= self.store.version():
            return
        batch = batch.persist()
        pools, touched = written(merge_changes(self.store.read("pools"), batch)), written(batch.where("NOT removed").select(F.col("pool_id").alias("pool")).distinct())
        edges = edges_of(pools).join(touched.withColumn("touched", F.lit(True)), "pool", "left").withColumn("touched", F.coalesce("touched", F.lit(False)))
        was = self.store.read("best").withColumnRenamed("amount_out", "before").drop("version")
        standing = written(topology.price_paths(was, edges, self.search.max_hops).withColumn("fell", F.coalesce(F.col("amount_out") < F.col("before"), F.lit(True))))
        asked = self.requests.join(standing.select("request_id", "fell", F.expr("CASE WHEN NOT fell THEN amount_out END").alias("least")), "request_id", "left")
        paths = self._paths(edges, ("touched",))
        paths = written(paths.withColumn("met", F.greatest(F.lit(False), *[F.col(f"h{i}.touched") for i in range(self.search.max_hops)])))
        found = routes.best_over(asked, paths, self.search, F.col("met") | F.col("fell"))
        best = better(standing.where("NOT fell").select(*ROUTE), written(found.select(*ROUTE)))
        self.store.commit(version, {"pools": pools, "best": best.withColumn("version", F.lit(version).cast("long"))})
        batch.unpersist()

    def run(self, feed: DataFrame, checkpoint: str) -> None:
        """Process what the feed has, then stop."""
        q = feed.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()

    def best(self) -> DataFrame:
        return self.store.read("best")


def better(one: DataFrame, other: DataFrame) -> DataFrame:
    """The better of each request's viable routes in two tables that have one of it at most: by amount, then by path key."""
    side = lambda df, name: df.select("request_id", F.struct(*[c for c in df.columns if c != "request_id"]).alias(name))
    first = F.expr("b IS NULL OR a.amount_out > b.amount_out OR a.amount_out = b.amount_out AND a.path_key <= b.path_key")
    both = side(one, "a").join(side(other, "b"), "request_id", "full_outer")
    return both.select("request_id", F.when(F.col("a").isNotNull() & first, F.col("a")).otherwise(F.col("b")).alias("r")).select("request_id", "r.*")


def accepted(results: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results (request_id, epoch, version, ...) that match the subscriptions' current epoch and version, and those rejected as stale."""
    now = current.select("request_id", "epoch", "version")
    return results.join(now, ["request_id", "epoch", "version"], "left_semi"), results.join(now, ["request_id", "epoch", "version"], "left_anti")


def subscription_states(events: DataFrame) -> DataFrame:
    """request_id, epoch, state after control and result events (seq, request_id, kind).

    Each `replace` starts an epoch; within the last epoch the last event tells: subscribe, replace and invalidate lead to
    pending, start to searching, result to ready, failure to failed, cancel to cancelled (which only a replacement leaves).
    """
    at = F.struct("seq", "kind")
    last = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), at))
    seen = events.groupBy("request_id").agg(
        F.count_if(F.col("kind") == "replace").alias("epoch"), last("subscribe", "replace").alias("opened"), last("cancel").alias("cancelled"), last("invalidate", "start", "result", "failure").alias("moved")
    )
    state = F.expr("""CASE WHEN opened IS NULL THEN 'closed' WHEN cancelled > opened THEN 'cancelled' WHEN moved > opened THEN
      CASE moved.kind WHEN 'invalidate' THEN 'pending' WHEN 'start' THEN 'searching' WHEN 'result' THEN 'ready' ELSE 'failed' END ELSE 'pending' END""")
    return seen.select("request_id", "epoch", state.alias("state"))


BALANCE_OUT = "pool LONG, token LONG, state STRING, amount LONG, seq LONG"


def fold_balances(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One balance's transfers in order: a fresh amount moves; a removed log, an underflow or any touch of another state makes it stale for good."""
    rows = pd.concat(list(batches)).sort_values(["seq", "delta"])
    if state.exists:
        kind, amount = state.get
    else:
        first = rows.iloc[0]
        kind, amount = first["state"], (int(first["amount"]) if first["state"] == "fresh" else None)
    kind = "stale" if kind == "unknown" else kind
    for delta, removed in zip(rows["delta"], rows["removed"], strict=True):
        if kind == "fresh":
            if removed or amount + int(delta) < 0:
                kind, amount = "stale", None
            else:
                amount += int(delta)
    state.update((kind, amount))
    yield pd.DataFrame({"pool": [key[0]], "token": [key[1]], "state": [kind], "amount": pd.array([amount], "Int64"), "seq": [int(rows["seq"].max())]})


def balance_stream(transfers: DataFrame, balances: DataFrame) -> DataFrame:
    """A stream of pool, token, state, amount after each batch of transfers (seq, token, from_pool, to_pool, value, removed)."""
    sides = transfers.select("seq", "token", F.explode(F.array(F.struct(F.col("from_pool").alias("pool"), (-F.col("value")).alias("delta")), F.struct(F.col("to_pool").alias("pool"), F.col("value").alias("delta")))).alias("s"), "removed")
    sides = sides.select("seq", "token", "s.pool", "s.delta", "removed").where("pool IS NOT NULL").join(balances.select("pool", "token", "state", "amount"), ["pool", "token"])
    return sides.groupBy("pool", "token").applyInPandasWithState(fold_balances, BALANCE_OUT, "state STRING, amount LONG", "update", GroupStateTimeout.NoTimeout)
