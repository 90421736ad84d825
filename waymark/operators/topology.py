"""Topology under routes: what a commit changes in the graph, and what that opens, closes and moves among simple paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.curves import quoted
from waymark.model import Search
from waymark.operators import graph

INDEX = ["generation", "revision", "tokens"]
EDGE = ["pool", "token_in", "token_out"]


def pool_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """pool, before, after, impact of each pool whose index entry (generation, revision, tokens) differs.

    unchanged: the revision only; identity_changed: another generation with the same tokens; localized: tokens came, went or changed.
    """
    side = lambda df, name: df.select("pool", F.struct(*INDEX).alias(name))
    both = side(before, "before").join(side(after, "after"), "pool", "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    impact = """CASE WHEN before IS NULL OR after IS NULL OR before.tokens <> after.tokens THEN 'localized'
      WHEN before.generation <> after.generation THEN 'identity_changed' ELSE 'unchanged' END"""
    return both.withColumn("impact", F.expr(impact))


def commit_impact(deltas: DataFrame, full: bool = False) -> DataFrame:
    """impact, revision_bump, pools, added, removed, updated, replaced, revised: one row for one commit.

    full: the commit made a reconciliation against a whole snapshot necessary; then any change of pools, tokens or generations is
    full_reconciliation.
    """
    rank = F.expr("CASE impact WHEN 'localized' THEN 2 WHEN 'identity_changed' THEN 1 ELSE 0 END")
    counts = {
        "pools": F.lit(True), "added": F.col("before").isNull(), "removed": F.col("after").isNull(), "updated": F.expr("before.tokens <> after.tokens"),
        "replaced": F.col("impact") == "identity_changed", "revised": F.col("impact") == "unchanged",
    }
    out = deltas.agg(F.coalesce(F.max(rank), F.lit(0)).alias("r"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()))
    name = F.when((F.col("r") > 0) & F.lit(full), F.lit(graph.IMPACT[3])).otherwise(F.element_at(F.array(*map(F.lit, graph.IMPACT)), F.col("r") + 1))
    return out.select(name.alias("impact"), (F.col("r") > 0).cast("int").alias("revision_bump"), *counts)


def semantic_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row, `changed`: whether pools, tokens or generations differ; revisions alone don't count."""
    return pool_deltas(before, after).agg(F.coalesce(F.bool_or(F.col("impact") != "unchanged"), F.lit(False)).alias("changed"))


def edge_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """pool, token_in, token_out, change (added, removed, moved): directed edges that differ; moved ones only in what they are priced by."""
    priced = [c for c in after.columns if c not in EDGE]
    old = before.select(*EDGE, F.struct(*priced).alias("b"))
    both = old.join(after.select(*EDGE, F.struct(*priced).alias("a")), EDGE, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(*EDGE, F.expr("CASE WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'removed' ELSE 'moved' END").alias("change"))


def opened(requests: DataFrame, after: DataFrame, added: DataFrame, search: Search) -> DataFrame:
    """request_id, target, amount_in, tokens, pools, path_key, hops: the simple paths over `after` that use an added edge.

    A path is found once, by its first added edge: that edge grows backward over edges that were there before, one hop for each place
    it can have, meets the requests at its source, and grows forward over all edges; the last hop has the target in its key. So the
    work follows the number of added edges, not that of routes. added: pool, token_in, token_out.
    """
    kept = after.join(added, EDGE, "left_anti").select(F.col("pool").alias("p"), F.col("token_in").alias("i"), F.col("token_out").alias("o"))
    edges = after.select(F.col("pool").alias("p"), F.col("token_in").alias("i"), F.col("token_out").alias("o"))
    connectors = F.lit(None).cast("array<bigint>") if search.connectors is None else F.array(*map(F.lit, search.connectors)).cast("array<bigint>")
    asked = requests.select("request_id", F.col("token_in").alias("source"), F.col("token_out").alias("target"), "amount_in", (F.col("connectors") if "connectors" in requests.columns and search.connectors is None else connectors).alias("connectors"))
    simple = ~F.array_contains("pools", F.col("p")) & ~F.array_contains("tokens", F.col("o"))
    back, done = added.select(F.array("token_in", "token_out").alias("tokens"), F.array("pool").alias("pools")), []
    for place in range(1, search.max_hops + 1):
        if place > 1:
            before = (F.col("o") == F.element_at("tokens", 1)) & ~F.array_contains("pools", F.col("p")) & ~F.array_contains("tokens", F.col("i"))
            back = back.join(kept, before).select(F.concat(F.array("i"), F.col("tokens")).alias("tokens"), F.concat(F.array("p"), F.col("pools")).alias("pools"))
        inner = F.expr("slice(tokens, 2, size(tokens) - 2)")
        last = F.element_at("tokens", -1)
        free = lambda col: F.col("connectors").isNull() | F.forall(col, lambda t: F.array_contains("connectors", t))
        on = F.element_at("tokens", 1) == F.col("source")
        if place == search.max_hops:
            on = on & (last == F.col("target"))
        front = back.join(asked, on).where(~F.array_contains(inner, F.col("target")) & free(inner))
        for hops in range(place, search.max_hops + 1):
            if hops > place:
                step = (F.col("cur") == F.col("i")) & simple
                step = step & ((F.col("o") == F.col("target")) if hops == search.max_hops else ((F.col("o") == F.col("target")) | F.col("connectors").isNull() | F.array_contains("connectors", F.col("o"))))
                # The token before this hop is an inner one from here on.
                front = front.withColumn("cur", last).where(F.col("cur") != F.col("target")).where(F.col("connectors").isNull() | F.array_contains("connectors", F.col("cur"))).join(edges, step)
                front = front.select("request_id", "target", "amount_in", "connectors", F.concat("tokens", F.array("o")).alias("tokens"), F.concat("pools", F.array("p")).alias("pools"))
            if hops >= search.min_hops:
                done.append(front.where(last == F.col("target")).select("request_id", "target", "amount_in", "tokens", "pools"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumns({"path_key": F.array_join(F.col("pools").cast("array<string>"), "|"), "hops": F.size("pools").cast("long")})


def advance(found: DataFrame, requests: DataFrame, changes: DataFrame, after: DataFrame, search: Search, price: str = "constant_product") -> DataFrame:
    """The routes over `after` from the routes before: request_id, target, amount_in, tokens, pools, path_key, hops, amount_out, fate.

    changes: edge_changes(). Routes over a removed edge go; routes over a moved edge are priced again (fate `repriced`); paths over an
    added edge come in (`opened`); all others stay as they are (`kept`). The rows are those of a full enumeration over `after`.
    """
    columns = ["request_id", "target", "amount_in", "tokens", "pools", "path_key", "hops"]
    steps = found.select("request_id", "path_key", F.explode(F.expr("transform(pools, (p, i) -> struct(p AS pool, tokens[i] AS token_in, tokens[i + 1] AS token_out))")).alias("s")).select("request_id", "path_key", "s.*")
    met = steps.join(changes.where("change <> 'added'"), EDGE).groupBy("request_id", "path_key").agg(F.bool_or(F.col("change") == "removed").alias("gone"))
    marked = found.join(met, ["request_id", "path_key"], "left")
    kept = marked.where("gone IS NULL").select(*columns, "amount_out", F.lit("kept").alias("fate"))
    moved = marked.where("NOT gone").select(*columns, F.lit("repriced").alias("fate"))
    new = opened(requests, after, changes.where("change = 'added'").select(*EDGE), search).select(*columns, F.lit("opened").alias("fate"))
    again = moved.unionByName(new)
    priced = price_paths(again, after, search.max_hops, price)
    return kept.unionByName(priced.select(*kept.columns))


def price_paths(paths: DataFrame, edges: DataFrame, max_hops: int, price: str = "constant_product") -> DataFrame:
    """paths with amount_out: hops are priced one after another, each by a join of its edge; a path stops where it is complete.

    Paths with a version (`at`) meet edges that hold at it ([since, until)).
    """
    now = paths.withColumn("amount", F.col("amount_in"))
    e = edges.withColumnsRenamed({c: f"_{c}" for c in EDGE})
    for i in range(max_hops):
        on = (F.expr(f"get(pools, {i})") == F.col("_pool")) & (F.expr(f"get(tokens, {i})") == F.col("_token_in")) & (F.expr(f"get(tokens, {i + 1})") == F.col("_token_out"))
        if "at" in paths.columns:
            on = on & (F.col("since") <= F.col("at")) & (F.col("at") < F.col("until"))
        now = now.join(e, on, "left").withColumn("amount", F.when(F.size("pools") <= i, F.col("amount")).when(F.col("_pool").isNotNull(), quoted(price))).select(*paths.columns, "amount")
    return now.withColumnRenamed("amount", "amount_out")


def generations(present: DataFrame, order: str = "version") -> DataFrame:
    """present (pool, version, ...) with generation and revision: a pool that was away for a version comes back as another generation;
    each version in which a pool is there counts as a revision."""
    of = Window.partitionBy("pool").orderBy(order)
    back = (F.col(order) - F.lag(order).over(of) > 1).cast("long")
    return present.withColumn("_back", F.coalesce(back, F.lit(0).cast("long"))).withColumn("generation", F.sum("_back").over(of)).withColumn("revision", F.row_number().over(of).cast("long")).drop("_back")

