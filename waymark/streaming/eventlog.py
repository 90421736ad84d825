"""A sequenced log of what happens to standing requests: accepted, invalidated, published and rejected, and the latest value of each.

Inputs are one ordered feed of commits, control rows and search results. A result carries the epoch of its request and the version of
the graph that it was searched on; it counts only while both are current. The fold is windows over each request's rows, with the state
that earlier batches left as their first row, so any cut of the feed into batches gives the same log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.streaming.store import Store, written

#: commit: version. subscribe, replace, cancel: request_id. result, failure: request_id, epoch, version, amount (null: no route).
FEED = "seq LONG, kind STRING, request_id LONG, epoch LONG, version LONG, amount LONG"
LATEST = "request_id LONG, epoch LONG, state STRING, version LONG, amount LONG, alive BOOLEAN, ready BOOLEAN, seq LONG"
EVENT = ["seq", "request_id", "event", "reason", "epoch", "version", "current_epoch", "current_version", "amount", "previous"]


def fold(latest: DataFrame, version: int, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events of a batch and the latest values after it.

    latest: LATEST (seq: of the row that moved the state last), version: that of the last commit before the batch. A commit meets each request that is known or comes up in the batch,
    as each of them is told that its result is history.
    """
    commits = batch.where("kind = 'commit'").select("seq", "kind", "version")
    own = batch.where("kind <> 'commit' AND request_id IS NOT NULL").select("seq", "kind", "request_id", "epoch", "version", "amount")
    known = latest.where("alive").select("request_id").union(own.where("kind = 'subscribe'").select("request_id")).distinct()
    told = known.join(F.broadcast(commits)).select("seq", "kind", "request_id", F.lit(None).cast("long").alias("epoch"), "version", F.lit(None).cast("long").alias("amount"))
    none = {c: F.lit(None).cast(t) for c, t in (("was_epoch", "long"), ("was_alive", "boolean"), ("was_ready", "boolean"), ("was_version", "long"), ("was_amount", "long"), ("was_state", "string"), ("was_seq", "long"))}
    rows = own.unionByName(told).withColumns(none)
    prior = latest.select(F.lit(-1).cast("long").alias("seq"), F.lit("prior").alias("kind"), "request_id", F.lit(None).cast("long").alias("epoch"), F.lit(version).cast("long").alias("version"), F.lit(None).cast("long").alias("amount"),
                          F.col("epoch").alias("was_epoch"), F.col("alive").alias("was_alive"), F.col("ready").alias("was_ready"), F.col("version").alias("was_version"), F.col("amount").alias("was_amount"), F.col("state").alias("was_state"), F.col("seq").alias("was_seq"))
    rows = rows.unionByName(prior)

    order = [F.col("seq"), F.col("kind"), F.col("epoch"), F.col("version"), F.col("amount")]
    # What holds at a row is its own value, or else the last before it: one frame for both.
    spec = Window.partitionBy("request_id").orderBy(*order)
    before = spec.rowsBetween(Window.unboundedPreceding, -1)
    control, at = F.expr("CASE kind WHEN 'prior' THEN was_alive WHEN 'subscribe' THEN true WHEN 'cancel' THEN false END"), F.expr("CASE WHEN kind IN ('prior', 'commit') THEN version END")
    rows = rows.withColumns({"alive_before": F.coalesce(F.last(control, True).over(before), F.lit(False)), "at_version": F.coalesce(at, F.last(at, True).over(before), F.lit(version))})
    rows = rows.withColumn("alive", F.coalesce(control, "alive_before"))
    # Replacements since the subscription began; a second subscribe of one that lives changes nothing.
    rows = rows.withColumn("opens", (F.col("kind") == "subscribe") & ~F.col("alive_before"))
    rows = rows.withColumn("reps", F.sum(F.expr("CASE WHEN kind = 'prior' THEN was_epoch WHEN kind = 'replace' AND alive_before THEN 1 ELSE 0 END")).over(spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    opened = F.when(F.col("opens"), F.col("reps"))
    rows = rows.withColumn("at_epoch", F.col("reps") - F.coalesce(opened, F.last(opened, True).over(before), F.lit(0)))
    done = F.col("kind").isin("result", "failure") & F.col("alive_before")
    ok = done & F.col("epoch").eqNullSafe(F.col("at_epoch")) & F.col("version").eqNullSafe(F.col("at_version"))
    rows = rows.withColumn("accepted", ok).withColumn("refused", done & ~ok)
    # The last accepted result of this subscription, and whether nothing has moved since.
    value = F.expr("CASE WHEN kind = 'prior' THEN struct(was_version AS version, was_amount AS amount) WHEN opens THEN struct(CAST(NULL AS BIGINT) AS version, CAST(NULL AS BIGINT) AS amount) WHEN kind = 'result' AND accepted THEN struct(version, amount) END")
    state = F.expr("""CASE WHEN kind = 'prior' THEN was_state WHEN opens OR kind = 'replace' AND alive_before OR kind = 'commit' AND alive_before THEN 'pending'
      WHEN accepted AND kind = 'result' THEN 'ready' WHEN accepted THEN 'failed' WHEN kind = 'cancel' AND alive_before THEN 'cancelled' END""")
    rows = rows.withColumn("value", value).withColumn("state", state)
    rows = rows.withColumn("moves", F.when(F.col("state").isNotNull(), F.coalesce("was_seq", "seq")))
    rows = rows.withColumns({"held": F.last("value", True).over(before), "was": F.last("state", True).over(before), "_moved": F.last("moves", True).over(before), "ends": F.lead(F.lit(True)).over(spec).isNull()})
    rows = rows.withColumns({"now_value": F.coalesce("value", "held"), "now": F.coalesce("state", "was"), "moved": F.coalesce("moves", "_moved")})
    # Events, their sampling for the order of numbers, and the latest values all read these rows: the windows run once a batch.
    rows = written(rows.select("seq", "kind", "request_id", "epoch", "version", "amount", "alive_before", "alive", "opens", "at_epoch", "at_version", "accepted", "refused", "held", "was", "now_value", "now", "moved", "ends"))
    published = F.col("held.version").isNotNull() & ((F.col("was") == "ready") | F.col("held.amount").isNotNull())
    event = (
        F.when(F.col("opens"), "accepted").when((F.col("kind") == "commit") & F.col("alive_before") & published, "invalidated").when((F.col("kind") == "replace") & F.col("alive_before") & published, "invalidated")
        .when((F.col("kind") == "cancel") & F.col("alive_before"), "cancelled").when(F.col("refused"), "rejected").when(F.col("accepted") & (F.col("kind") == "result"), "published").when(F.col("accepted"), "failed")
    )
    reason = F.expr("CASE WHEN event = 'invalidated' AND kind = 'commit' THEN 'state_advanced' WHEN event = 'invalidated' THEN 'request_changed' WHEN event = 'rejected' AND NOT version <=> at_version THEN 'stale_version' WHEN event = 'rejected' THEN 'stale_epoch' END")
    stamped = F.col("event").isin("published", "rejected", "failed")
    told = rows.withColumn("event", event).where("event IS NOT NULL").withColumn("reason", reason)
    events = told.select(
        "seq", "request_id", "event", "reason", F.when(stamped, F.col("epoch")).alias("epoch"), F.when(stamped, F.col("version")).when(F.col("event") == "invalidated", F.col("held.version")).alias("version"),
        F.col("at_epoch").alias("current_epoch"), F.col("at_version").alias("current_version"), F.when(F.col("event") == "published", F.col("amount")).alias("amount"), F.when(F.col("event") == "published", F.col("held.amount")).alias("previous"),
    )
    of_commits = commits.select("seq", F.lit(None).cast("long").alias("request_id"), F.lit("commit_applied").alias("event"), *[F.lit(None).cast(t).alias(c) for c, t in (("reason", "string"), ("epoch", "long"))], "version", F.lit(None).cast("long").alias("current_epoch"), F.col("version").alias("current_version"), *[F.lit(None).cast("long").alias(c) for c in ("amount", "previous")])
    final = rows.where("ends AND now IS NOT NULL")
    values = final.select("request_id", F.col("at_epoch").alias("epoch"), F.col("now").alias("state"), F.col("now_value.version").alias("version"), F.col("now_value.amount").alias("amount"), "alive", (F.col("now") == "ready").alias("ready"), F.col("moved").alias("seq"))
    return of_commits.unionByName(events).select(*EVENT), values


def numbered(rows: DataFrame, order: list[str], first: int, name: str = "number") -> DataFrame:
    """rows with one gapless sequence in `order` from `first` on: sorted over all tasks, counted by task, no task sees them all."""
    at = F.monotonically_increasing_id()
    placed = written(rows.orderBy(*order).withColumn("_at", at))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + first).drop("_at", "_part", "_start")


class EventLog:
    """The log and the latest values in a folder, batch by batch: each batch's events are a folder of their own, written whole.

    Numbers go on from batch to batch without gaps. A batch that is replayed writes the same folder and the same state again, or
    nothing if its state was committed, so readers never see an event twice.
    """

    def __init__(self, spark: SparkSession, store: Store | None = None) -> None:
        self.spark, self.store = spark, store or Store(spark)

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        done = self.store.version()
        if batch_id <= done:
            return
        if done < 0:
            latest, version, first = self.spark.createDataFrame([], LATEST), 0, 0
        else:
            latest, at = self.store.read("latest"), self.store.read("position").first()
            version, first = at["version"], at["next"]
        batch = written(batch.select(*[c.split(" ")[0] for c in FEED.split(", ")]))
        got = batch.where("kind = 'commit'").agg(F.count("*"), F.min("version"), F.max("version"), F.count_distinct("version")).first()
        if got[0] and not (got[1] == version + 1 and got[0] == got[3] == got[2] - version):
            raise RuntimeError(f"commits {got[1]} to {got[2]} after {version}")
        events, values = fold(latest, version, batch)
        ranked = numbered(events, ["seq", "request_id"], first)
        path = f"{self.store.folder}/events/batch={batch_id:09d}"
        ranked.write.mode("overwrite").parquet(path)
        count = self.spark.read.parquet(path).count()
        position = self.spark.createDataFrame([(got[2] if got[0] else version, first + count)], "version LONG, next LONG")
        self.store.commit(batch_id, {"latest": values, "position": position}, gap=True)

    def events(self) -> DataFrame:
        """number and EVENT columns, of committed batches only."""
        rows = self.spark.read.option("basePath", f"{self.store.folder}/events").parquet(f"{self.store.folder}/events")
        return rows.where(F.col("batch") <= self.store.version()).select("number", *EVENT)

    def latest(self) -> DataFrame:
        return self.store.read("latest").select("request_id", "epoch", "state", "version", "amount", "seq")

    def run(self, feed: DataFrame, checkpoint: str) -> None:
        feed.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
