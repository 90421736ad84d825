"""Pools, edges, balances, requests and changes derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.operators import topology

_kept: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keep(spark: SparkSession, sf_dir: str, name: str, df: DataFrame) -> DataFrame:
    """Cached and counted, so that Spark knows the size when it picks a join; recomputed where an executor is lost."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = df.cache()
        _kept[key].count()
    return _kept[key]


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pool_id, venue, t0, t1, r0, r1, status, protocol, fee: a pool for each venue and pair of nations that trade."""
    long = lambda c: F.col(c).cast("long")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.where("s_nationkey <> c_nationkey").select(
        long("s_nationkey").alias("sn"), long("c_nationkey").alias("cn"), F.substring("o_orderpriority", 1, 1).cast("long").alias("venue"),
        F.least(long("s_nationkey"), long("c_nationkey")).alias("t0"), F.greatest(long("s_nationkey"), long("c_nationkey")).alias("t1"), F.floor("l_quantity").cast("long").alias("q"),
    )
    found = rows.groupBy("venue", "t0", "t1").agg((F.sum(F.expr("CASE WHEN sn < cn THEN q ELSE 0 END")) + 1).alias("r0"), (F.sum(F.expr("CASE WHEN sn > cn THEN q ELSE 0 END")) + 1).alias("r1"))
    found = found.withColumn("pool_id", F.expr("venue * 10000 + t0 * 100 + t1"))
    found = found.withColumn("status", F.expr("CASE WHEN pool_id % 17 = 0 THEN 'pending' WHEN pool_id % 13 = 0 THEN 'degraded' ELSE 'ready' END"))
    found = found.withColumn("protocol", F.expr("CASE venue WHEN 1 THEN 'v3' WHEN 2 THEN 'curve' WHEN 3 THEN 'balancer' WHEN 4 THEN 'v2' ELSE 'custom' END"))
    found = found.withColumn("fee", F.expr("CASE WHEN venue IN (1, 4) THEN 5 + ((t0 + t1) % 4) * 10 END"))
    return _keep(spark, sf_dir, "pools", found.select("pool_id", "venue", "t0", "t1", "r0", "r1", "status", "protocol", "fee"))


def edges(spark: SparkSession, sf_dir: str, ready_only: bool = False) -> DataFrame:
    """pool, token_in, token_out, r_in, r_out, fee, protocol: both directions of each pool."""
    p = pools(spark, sf_dir)
    if ready_only:
        p = p.where("status = 'ready'")
    both = F.array(F.struct(F.col("t0").alias("i"), F.col("t1").alias("o"), F.col("r0").alias("ri"), F.col("r1").alias("ro")), F.struct(F.col("t1").alias("i"), F.col("t0").alias("o"), F.col("r1").alias("ri"), F.col("r0").alias("ro")))
    out = p.select(F.col("pool_id").alias("pool"), F.explode(both).alias("e"), "fee", "protocol")
    out = out.select("pool", F.col("e.i").alias("token_in"), F.col("e.o").alias("token_out"), F.col("e.ri").alias("r_in"), F.col("e.ro").alias("r_out"), "fee", "protocol")
    return _keep(spark, sf_dir, f"edges{ready_only}", out)


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pool, protocol, status, token0, token1, coins, fee: pools as registered; some lack metadata, some have too few tokens."""
    p = pools(spark, sf_dir)
    return p.select(
        F.col("pool_id").alias("pool"), "protocol", "status", "t0", F.expr("CASE WHEN pool_id % 19 = 0 THEN NULL ELSE t1 END").alias("t1"),
        F.expr("CASE WHEN protocol IN ('curve', 'balancer') THEN CASE WHEN pool_id % 23 = 0 THEN array(t0, t0) ELSE array(t1, t0, t1) END END").alias("coins"), "fee",
    )


def multi_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pool, token: one pool of all nations for each region."""
    return table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).select((F.lit(900000) + F.col("r_regionkey")).cast("long").alias("pool"), F.col("n_nationkey").cast("long").alias("token"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pool, token, state, amount, venue, protocol: two rows a pool; state by key, where some pools have one side known only."""
    both = F.array(F.struct(F.col("t0").alias("token"), F.col("r0").alias("amount")), F.struct(F.col("t1").alias("token"), F.col("r1").alias("amount")))
    state = F.expr("CASE WHEN pool_id % 7 = 0 OR pool_id % 5 = 0 AND b.token = t0 THEN 'unknown' WHEN pool_id % 11 = 0 THEN 'stale' ELSE 'fresh' END")
    out = pools(spark, sf_dir).withColumn("b", F.explode(both)).select(F.col("pool_id").alias("pool"), "b", state.alias("state"), "protocol", "fee")
    return out.select("pool", "b.token", "state", "b.amount", "protocol", "fee")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, token_in, token_out, amount_in: one of each customer."""
    c = table(spark, sf_dir, "customer")
    return c.selectExpr("CAST(c_custkey AS BIGINT) AS request_id", "CAST(c_nationkey AS BIGINT) AS token_in", "CAST((c_nationkey + 1 + c_custkey % 24) % 25 AS BIGINT) AS token_out", "CAST(1000 + c_custkey % 9000 AS BIGINT) AS amount_in")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, kind, pool_id, k, removed: a log of changes."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(event_id AS BIGINT) AS seq", "ts", "event_type AS kind", "CAST((1 + user_id % 5) * 10000 + ((event_id * 7) % 24) * 100 + ((event_id * 7) % 24) + 1 AS BIGINT) AS pool_id",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k", "event_type = 'error' AS removed",
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, token_in, token_out, amount_in: one request of 1,000 for each pair that any customer asks for."""
    return requests(spark, sf_dir).select("token_in", "token_out").distinct().selectExpr("token_in * 1000 + token_out AS request_id", "token_in", "token_out", "1000L AS amount_in")


def yearly_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """version, pool, t0, t1, r0, r1: the pools that traded in each year of orders; version 0 is the first year."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where("s_nationkey <> c_nationkey")
    low, high = "least(s_nationkey, c_nationkey)", "greatest(s_nationkey, c_nationkey)"
    rows = rows.selectExpr("CAST(year(o_orderdate) AS BIGINT) AS y", f"CAST(substr(o_orderpriority, 1, 1) * 10000 + {low} * 100 + {high} AS BIGINT) AS pool", f"CAST({low} AS BIGINT) AS t0", f"CAST({high} AS BIGINT) AS t1", "s_nationkey < c_nationkey AS up", "CAST(floor(l_quantity) AS BIGINT) AS q")
    found = rows.groupBy("y", "pool", "t0", "t1").agg((F.sum(F.expr("CASE WHEN up THEN q ELSE 0 END")) + 1).alias("r0"), (F.sum(F.expr("CASE WHEN NOT up THEN q ELSE 0 END")) + 1).alias("r1"))
    first = table(spark, sf_dir, "orders").agg(F.year(F.min("o_orderdate")).cast("long").alias("first"))
    return found.join(first).selectExpr("y - first AS version", "pool", "t0", "t1", "r0", "r1")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of commits (waymark.streaming.topology.COMMIT) that lead from each year's pools to the next year's; those of version 0 are the baseline."""
    at = topology.generations(yearly_pools(spark, sf_dir)).select("version", "pool", "generation", "revision", "t0", "t1", "r0", "r1")
    was = at.select((F.col("version") + 1).alias("version"), "pool", F.struct("generation", "t0", "t1", "r0", "r1").alias("was"))
    last = at.agg(F.max("version").alias("last"))
    both = at.join(was, ["version", "pool"], "full_outer").join(last).where("version <= last")
    changed = both.where(F.col("t0").isNull() | ~F.struct("generation", "t0", "t1", "r0", "r1").eqNullSafe(F.col("was")))
    return changed.select("version", F.lit("main").alias("runtime"), "pool", "generation", "revision", "t0", "t1", "r0", "r1", F.lit(False).alias("full"))


def route_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed for waymark.streaming.eventlog, from orders: a customer's first order subscribes, each later one replaces the request, its result
    arrives when the last item is shipped (stamped with the order's place among the customer's and the year it was asked in; `P` orders
    fail), and a commit comes with each year after the first. A customer in debt cancels a day after the last order."""
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("long")
    orders, of = table(spark, sf_dir, "orders"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    asked = orders.select(F.col("o_custkey").cast("long").alias("request_id"), F.col("o_orderkey").cast("long").alias("key"), day("o_orderdate").alias("day"), F.year("o_orderdate").cast("long").alias("y"), "o_orderstatus", F.floor(F.col("o_totalprice")).cast("long").alias("total"), (F.row_number().over(of) - 1).cast("long").alias("nth"))
    first = orders.agg(F.year(F.min("o_orderdate")).cast("long").alias("first"), F.year(F.max("o_orderdate")).cast("long").alias("last"))
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("key")).agg(F.max(day("l_shipdate")).alias("shipped"))
    place = lambda d, kind, key: (F.expr(d) * 4 + kind) * 100_000_000_000 + F.expr(key)
    none = F.lit(None).cast("long")
    control = asked.select(place("day", 2, "key").alias("seq"), F.when(F.col("nth") == 0, "subscribe").otherwise("replace").alias("kind"), "request_id", none.alias("epoch"), none.alias("version"), none.alias("amount"))
    results = asked.join(shipped, "key").join(F.broadcast(first)).select(place("greatest(day, shipped)", 3, "key").alias("seq"), F.when(F.col("o_orderstatus") == "P", "failure").otherwise("result").alias("kind"), "request_id", F.col("nth").alias("epoch"), (F.col("y") - F.col("first")).alias("version"), F.when((F.col("o_orderstatus") != "P") & (F.col("total") % 10 != 0), F.col("total")).alias("amount"))
    years = first.select(F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("y"), "first").select(F.datediff(F.make_date(F.col("y").cast("int"), F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date")).cast("long").alias("day"), (F.col("y") - F.col("first")).alias("version"))
    commit = years.select(place("day", 0, "0").alias("seq"), F.lit("commit").alias("kind"), none.alias("request_id"), none.alias("epoch"), "version", none.alias("amount"))
    debtors = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("long").alias("request_id"))
    leave = asked.groupBy("request_id").agg(F.max("day").alias("day")).join(debtors, "request_id").select(place("day + 1", 1, "request_id").alias("seq"), F.lit("cancel").alias("kind"), "request_id", none.alias("epoch"), none.alias("version"), none.alias("amount"))
    return control.unionByName(results).unionByName(commit).unionByName(leave)
