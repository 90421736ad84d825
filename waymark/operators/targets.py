"""Tracked balances as a maintained table: reconciliation with what a graph needs, and keyed writes with error rows.

Targets: pool, token, source (erc20, vault, unknown), holder, slot (null: not discovered), state, amount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["pool", "token", "source", "holder", "slot", "state", "amount"]


def reconcile(current: DataFrame, desired: DataFrame, pools: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The targets after a change of the graph, and one row with added, removed, preserved_fresh and unknown.

    desired: pool, token, source, holder. pools: which pools are reconciled (all, if None); targets of others stay. A discovered slot
    survives where the holder is the same. A target whose source is the same keeps its balance; another source is a removal and an
    addition, and its balance is unknown.
    """
    rest = None
    if pools is not None:
        chosen = pools.select("pool").distinct()
        rest, current, desired = current.join(chosen, "pool", "left_anti").select(*COLUMNS), current.join(chosen, "pool", "left_semi"), desired.join(chosen, "pool", "left_semi")
    old = current.select("pool", "token", F.struct("source", "holder", "slot", "state", "amount").alias("o"))
    both = old.join(desired.select("pool", "token", F.struct("source", "holder").alias("d")), ["pool", "token"], "full_outer")
    slot = F.when((F.col("o.source") == "erc20") & (F.col("d.source") == "erc20") & F.col("o.holder").eqNullSafe(F.col("d.holder")), F.col("o.slot"))
    both = both.withColumn("slot", slot).withColumn("same", F.coalesce((F.col("o.source") == F.col("d.source")) & F.col("o.holder").eqNullSafe(F.col("d.holder")) & F.col("o.slot").eqNullSafe(F.col("slot")), F.lit(False)))
    there, wanted, same = F.col("o").isNotNull(), F.col("d").isNotNull(), F.col("same")
    report = both.agg(
        F.count_if(wanted & ~same).alias("added"), F.count_if(there & ~same).alias("removed"),
        F.count_if(same & (F.col("o.state") == "fresh")).alias("preserved_fresh"), F.count_if(wanted & (F.col("d.source") == "unknown")).alias("unknown"),
    )
    now = both.where("d IS NOT NULL").select("pool", "token", "d.source", "d.holder", "slot", F.when(same, F.col("o.state")).otherwise("unknown").alias("state"), F.when(same, F.col("o.amount")).alias("amount"))
    return (now if rest is None else now.unionByName(rest)), report


def write(targets: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """targets after writes (seq, pool, token, op, amount), and error rows of writes to what isn't tracked.

    op `set` makes a balance fresh at `amount`, `stale` makes it stale. The last write of a target wins, whatever others say.
    """
    keyed = writes.join(targets.select("pool", "token", F.lit(True).alias("known")), ["pool", "token"], "left")
    errors = keyed.where("known IS NULL").select("seq", "pool", "token", "op", F.lit("unknown_pool_token").alias("error"))
    last = keyed.where("known").groupBy("pool", "token").agg(F.max_by(F.struct("op", "amount"), "seq").alias("w"))
    met = targets.join(last, ["pool", "token"], "left")
    state = F.when(F.col("w").isNull(), F.col("state")).when(F.col("w.op") == "set", "fresh").otherwise("stale")
    amount = F.when(F.col("w").isNull(), F.col("amount")).when(F.col("w.op") == "set", F.col("w.amount"))
    return met.withColumns({"state": state, "amount": amount}).select(*COLUMNS), errors


def discover(targets: DataFrame, slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """targets with discovered slots (token, holder, slot), and token, holder, seeded: how many targets got a new slot by each."""
    found = slots.groupBy("token", "holder").agg(F.max("slot").alias("_slot"))
    met = targets.join(found, ["token", "holder"], "left").withColumn("_hit", F.col("_slot").isNotNull() & (F.col("source") == "erc20"))
    new = F.col("_hit") & ~F.col("slot").eqNullSafe(F.col("_slot"))
    counts = found.join(met.where(new).groupBy("token", "holder").agg(F.count("*").alias("n")), ["token", "holder"], "left").select("token", "holder", F.coalesce("n", F.lit(0)).alias("seeded"))
    return met.withColumn("slot", F.when(F.col("_hit"), F.col("_slot")).otherwise(F.col("slot"))).select(*COLUMNS), counts


def to_refresh(targets: DataFrame, stale_only: bool) -> DataFrame:
    """The targets that a refresh reads: all, or those that aren't fresh."""
    return targets.where("state <> 'fresh'") if stale_only else targets
