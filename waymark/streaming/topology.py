"""Live routes under a feed of commits that add, remove and change pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.model import Search
from waymark.operators import routes, topology
from waymark.streaming.store import Store, written

#: A commit's row: its pool as it is from this version on; without tokens the pool is gone.
COMMIT = "version LONG, runtime STRING, pool LONG, generation LONG, revision LONG, t0 LONG, t1 LONG, r0 LONG, r1 LONG, full BOOLEAN"
POOL = ["pool", "generation", "revision", "t0", "t1", "r0", "r1"]
ROUTE = ["request_id", "target", "amount_in", "tokens", "pools", "path_key", "hops", "amount_out"]


class CommitError(RuntimeError):
    """A commit or snapshot that cannot follow what was applied before."""


class ForeignRuntime(CommitError):
    """From another runtime than the baseline."""


class VersionGap(CommitError):
    """Not the version after the last one."""


class StaleSnapshot(CommitError):
    """A snapshot that isn't newer than what was applied."""


def index(pools: DataFrame) -> DataFrame:
    return pools.select("pool", "generation", "revision", F.array_sort(F.array("t0", "t1")).alias("tokens"))


def edges_of(pools: DataFrame) -> DataFrame:
    side = lambda i, o, a, b: F.struct(F.col(i).alias("token_in"), F.col(o).alias("token_out"), F.col(a).alias("r_in"), F.col(b).alias("r_out"))
    return pools.select("pool", F.explode(F.array(side("t0", "t1", "r0", "r1"), side("t1", "t0", "r1", "r0"))).alias("e")).select("pool", "e.*")


class LiveTopology:
    """Routes of standing requests over a graph that commits change, one version after another.

    A version is one generation of the store: pools, routes and the commits' reports together, or nothing of it. A batch that is
    replayed finds its versions applied and skips them.
    """

    def __init__(self, spark: SparkSession, requests: DataFrame, search: Search, runtime: str = "main", store: Store | None = None) -> None:
        self.spark, self.requests, self.search, self.runtime, self.store = spark, requests, search, runtime, store or Store(spark)

    def baseline(self, pools: DataFrame) -> None:
        pools = written(pools.select(*POOL))
        found = routes.enumerate_priced(self.requests, edges_of(pools), self.search).select(*ROUTE)
        report = topology.commit_impact(topology.pool_deltas(index(pools).where("false"), index(pools).where("false")))
        none = {k: F.lit(0).cast("long").alias(k) for k in ("kept", "repriced", "opened", "retracted")}
        self.store.commit(0, {"pools": pools, "routes": found, "reports": report.select(F.lit(0).cast("long").alias("version"), "*", F.lit(0).cast("long").alias("graph_revision"), *none.values())})

    def version(self) -> int:
        return self.store.version()

    def _follows(self, version: int, runtime: str) -> None:
        if runtime != self.runtime:
            raise ForeignRuntime(f"{runtime} where {self.runtime} is followed")
        if version != self.version() + 1:
            raise VersionGap(f"version {version} after {self.version()}")

    def apply(self, rows: DataFrame, version: int, runtime: str, full: bool = False) -> None:
        """One commit. full: its rows are all pools, as after a loss of the feed; then version may be any newer one."""
        if full:
            if runtime != self.runtime:
                raise ForeignRuntime(f"{runtime} where {self.runtime} is followed")
            if version <= self.version():
                raise StaleSnapshot(f"version {version} where {self.version()} is applied")
        else:
            self._follows(version, runtime)
        before = self.store.read("pools")
        rows = rows.select(*POOL)
        after = rows if full else before.join(rows.select("pool"), "pool", "left_anti").select(*POOL).unionByName(rows)
        after = written(after.where("t0 IS NOT NULL AND t1 IS NOT NULL"))
        deltas = topology.pool_deltas(index(before), index(after))
        changes = written(topology.edge_changes(edges_of(before), edges_of(after)))
        found = self.store.read("routes")
        now = written(topology.advance(found, self.requests, changes, edges_of(after), self.search))
        fates = now.groupBy().agg(*(F.count_if(F.col("fate") == k).alias(k) for k in ("kept", "repriced", "opened")))
        known = self.store.read("reports")
        report = topology.commit_impact(deltas, full).join(fates).join(found.groupBy().agg(F.count("*").alias("was")))
        bump = known.agg(F.max("graph_revision").alias("last"))
        report = report.join(bump).select(F.lit(version).cast("long").alias("version"), *[c for c in known.columns if c not in ("version", "graph_revision", "kept", "repriced", "opened", "retracted")], (F.col("last") + F.col("revision_bump")).alias("graph_revision"), "kept", "repriced", "opened", (F.col("was") - F.col("kept") - F.col("repriced")).alias("retracted"))
        self.store.commit(version, {"pools": after, "routes": now.select(*ROUTE), "reports": known.unionByName(report)}, gap=full)

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        """All commits of a micro-batch, in order of their versions."""
        batch = written(batch)
        for r in batch.groupBy("version", "runtime").agg(F.bool_or("full").alias("full")).orderBy("version").collect():  # a row a commit
            if r["version"] > self.version():
                self.apply(batch.where(F.col("version") == r["version"]), r["version"], r["runtime"], bool(r["full"]))

    def reconcile(self, snapshot: DataFrame, version: int, runtime: str) -> None:
        """Take over a whole snapshot (POOL columns); an equal or older one is refused."""
        self.apply(snapshot, version, runtime, full=True)

    def run(self, feed: DataFrame, checkpoint: str) -> None:
        """Process what the feed has, then stop."""
        feed.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def routes(self, at: int | None = None) -> DataFrame:
        """The routes of the current version; `at` refuses another one, as a reader that is pinned to a version must."""
        if at is not None and at != self.version():
            raise CommitError(f"version {at} where {self.version()} is applied")
        return self.store.read("routes")

    def reports(self) -> DataFrame:
        return self.store.read("reports")
