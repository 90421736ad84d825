"""Progressive search as an event log: what an observer sees quote by quote, derived by ordered windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.model import Streaming, Threshold

HEURISTIC_DONE, COMPLETE, FINAL = 9_000, 9_999, 10_000


def quote_log(heuristic: DataFrame, exhaustive: DataFrame, lane: DataFrame | None = None) -> DataFrame:
    """request_id, seq, phase, path_key, amount_out: the fast lane's quotes if given, the bounded search's, then those not yet evaluated.

    Both are ordered by hops and path key within their phase; a path that the first phase has evaluated isn't evaluated again.
    """
    cols, key = ["request_id", "hops", "path_key", "amount_out"], ["request_id", "path_key"]
    first = heuristic.select(*cols).withColumn("phase", F.lit("heuristic"))
    if lane is not None:
        looked = lane.select(*cols).dropDuplicates(key).withColumn("phase", F.lit("fast_lane"))
        first = looked.unionByName(first.join(looked.select(*key), key, "left_anti").select(*cols, "phase"))
    rest = exhaustive.select(*cols).join(first.select(*key), key, "left_anti").select(*cols).withColumn("phase", F.lit("exhaustive"))
    return _numbered(first.unionByName(rest))


def phased_log(found: DataFrame, first: Column) -> DataFrame:
    """quote_log where one table has the routes of both phases, each once, and `first` tells those of the first phase.

    The routes are neither made twice nor compared by path, and where they are dealt by request (see routes.alike) nothing is shuffled.
    """
    return _numbered(found.select("request_id", "hops", "path_key", "amount_out", F.when(first, "heuristic").otherwise("exhaustive").alias("phase")))


def looked_up_log(heuristic: DataFrame, exhaustive: DataFrame, lane: DataFrame) -> DataFrame:
    """quote_log where the earlier phases' routes are all among the exhaustive ones, with the same outputs, as over the same edges.

    The path keys of the earlier phases, of which a request has few, become a row a request, and each route looks its own up there. So
    no route is compared by path, and where the exhaustive ones are dealt by request (see routes.alike) none is shuffled.
    """
    of = lambda df, phase: df.select("request_id", "path_key", F.lit(phase).alias("phase"))
    keys = lambda phase: F.collect_set(F.when(F.col("phase") == phase, F.col("path_key")))
    early = of(lane, "fast_lane").unionByName(of(heuristic, "heuristic"))
    early = early.groupBy("request_id").agg(keys("fast_lane").alias("_lane"), keys("heuristic").alias("_first"))
    found = exhaustive.select("request_id", "hops", "path_key", "amount_out").join(early.hint("shuffle_hash"), "request_id", "left")
    phase = F.when(F.array_contains("_lane", F.col("path_key")), "fast_lane").when(F.array_contains("_first", F.col("path_key")), "heuristic").otherwise("exhaustive")
    return _numbered(found.select("request_id", "hops", "path_key", "amount_out", phase.alias("phase")))


def _numbered(log: DataFrame) -> DataFrame:
    w = Window.partitionBy("request_id").orderBy(F.expr("CASE phase WHEN 'fast_lane' THEN 0 WHEN 'heuristic' THEN 1 ELSE 2 END"), "hops", "path_key")
    return log.withColumn("seq", F.row_number().over(w))


def duplicates(heuristic: DataFrame, exhaustive: DataFrame) -> DataFrame:
    """request_id, duplicates: how many exhaustive candidates the first phase had evaluated."""
    seen = exhaustive.select("request_id", "path_key").join(heuristic.select("request_id", "path_key"), ["request_id", "path_key"], "left_semi")
    return seen.groupBy("request_id").agg(F.count("*").alias("duplicates"))


def confidence(best: Column, fraction: Column, complete: Column, heuristic_done: Column) -> Column:
    """Basis points: 0 until there is a best; 9999 once all are evaluated; 9000 and a tenth of the fraction once the total is known; 9000 after the first phase; 7000 in it."""
    share = F.least(F.lit(COMPLETE), F.lit(HEURISTIC_DONE) + F.floor(fraction / 10).cast("int"))
    return F.when(best.isNull(), 0).when(complete, COMPLETE).when(fraction.isNotNull(), share).when(heuristic_done, HEURISTIC_DONE).otherwise(7_000)


def progress(log: DataFrame) -> DataFrame:
    """What an observer is told: a row after each quote (step 0), and at the end of the first phase (1), once the number of candidates is known (2), at the end (3).

    request_id, seq, step, phase, path_key, amount_out, evaluated, viable, failed, fraction_bps (null in the first phase),
    confidence_bps, best, best_updated. The order is (seq, step); milestones have the seq of the last quote before them.
    """
    upto = Window.partitionBy("request_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("request_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("request_id")
    first, value = F.col("phase") != "exhaustive", F.col("amount_out")
    early = F.when(first, value)
    out = log.withColumns({
        "n": F.count("*").over(every), "nh": F.count_if(first).over(every), "v": F.count(value).over(every), "vh": F.count(early).over(every), "b": F.max(value).over(every), "bh": F.max(early).over(every),
        "evaluated": F.count("*").over(upto), "viable": F.count(value).over(upto), "best": F.max(value).over(upto), "held": F.max(value).over(before),
    })
    none, yes, no, known = F.lit(None).cast("int"), F.lit(True), F.lit(False), F.expr("nh * 10000 div n").cast("int")

    def told(step: int, seq: str, phase: Column, evaluated: str, viable: str, best: str, fraction: Column, conf: Column) -> Column:
        quote = step == 0
        return F.struct(
            F.col(seq).cast("int").alias("seq"), F.lit(step).alias("step"), phase.alias("phase"), (F.col("path_key") if quote else F.lit(None).cast("string")).alias("path_key"), (value if quote else F.lit(None).cast("long")).alias("amount_out"),
            F.col(evaluated).alias("evaluated"), F.col(viable).alias("viable"), (F.col(evaluated) - F.col(viable)).alias("failed"), fraction.alias("fraction_bps"), conf.cast("int").alias("confidence_bps"), F.col(best).alias("best"),
            (F.coalesce(value > F.coalesce("held", F.lit(-1)), no) if quote else no).alias("best_updated"),
        )

    share = F.when(~first, F.expr("evaluated * 10000 div n").cast("int"))
    quote = told(0, "seq", F.col("phase"), "evaluated", "viable", "best", share, confidence(F.col("best"), share, ~first & (F.col("evaluated") >= F.col("n")), no))
    done = told(1, "nh", F.lit("heuristic"), "nh", "vh", "bh", none, confidence(F.col("bh"), none, no, yes))
    total = told(2, "nh", F.lit("exhaustive"), "nh", "vh", "bh", known, confidence(F.col("bh"), known, F.col("nh") >= F.col("n"), yes))
    end = told(3, "n", F.lit("exhaustive"), "n", "v", "b", F.lit(FINAL), F.when(F.col("b").isNull(), 0).otherwise(FINAL))
    # Milestones hang on the last quote before them; where the first phase has none, on the first quote.
    last_first, last = F.col("seq") == F.greatest("nh", F.lit(1)), F.col("seq") == F.col("n")
    rows = F.filter(F.array(quote, F.when(last_first, done), F.when(last_first, total), F.when(last, end)), lambda r: r.isNotNull())
    return out.select("request_id", F.inline(rows))


def best_updates(log: DataFrame) -> DataFrame:
    return progress(log).where("best_updated").select("request_id", "seq", "phase", "path_key", "amount_out")


def entering(log: DataFrame, k: int) -> DataFrame:
    """Viable quotes with rank: their place among the best so far (earlier equal quotes stay ahead), or k + 1 where k are ahead."""
    before = Window.partitionBy("request_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    now = log.where("amount_out IS NOT NULL").withColumn("_x", F.col("amount_out"))
    ahead = F.lit(0)
    # A cascade: what the best so far displaces passes down, so each level keeps one of the k best before this quote.
    for i in range(k):
        held = F.max("_x").over(before)
        now = now.withColumn(f"_held{i}", held)
        ahead = ahead + F.coalesce((F.col(f"_held{i}") >= F.col("amount_out")).cast("int"), F.lit(0))
        now = now.withColumn("_x", F.least("_x", F.coalesce(f"_held{i}", F.lit(-1).cast("long"))))
    return now.select(*log.columns, (ahead + 1).alias("rank"))


def running_top(log: DataFrame, k: int) -> DataFrame:
    """Quotes that enter the best k so far, with the rank they enter at."""
    return entering(log, k).where(F.col("rank") <= k).select("request_id", "seq", "path_key", "amount_out", "rank")


def satisfied(t: Threshold) -> Column:
    """Whether a row of progress() meets a threshold: never before there is a best; a fraction that isn't known meets none."""
    neutral = F.lit(t.every)
    a = neutral if t.confidence_bps is None else F.col("confidence_bps") >= t.confidence_bps
    b = neutral if t.fraction_bps is None else F.coalesce(F.col("fraction_bps") >= t.fraction_bps, F.lit(False))
    return ((a & b) if t.every else (a | b)) & F.col("best").isNotNull()


def first_satisfied(events: DataFrame, t: Threshold) -> DataFrame:
    """request_id, at: the first (seq, step) that meets the threshold; null where none does."""
    return events.groupBy("request_id").agg(_first_satisfied(t).alias("at"))


def _first_satisfied(t: Threshold) -> Column:
    return F.min(F.when(satisfied(t), F.struct("seq", "step")))


def searched(log: DataFrame, config: Streaming) -> DataFrame:
    """The rows of progress() that the search comes to: of the first phases only where the completion asks no more, and up to the stop policy.

    fast_lane ends after the fast lane's quotes (of a log that has them), heuristic after the bounded search's.

    stopped: where the stop policy ended the search (a struct of seq and step), else null.
    """
    upto = {"fast_lane": "phase = 'fast_lane'", "heuristic": "phase <> 'exhaustive'", "exhaustive": "true"}
    events = progress(log.where(upto[config.completion]))
    if config.completion != "exhaustive":
        events = events.where("step < 2")
    if not config.stop:
        return events.withColumn("stopped", F.lit(None).cast("struct<seq: int, step: int>"))
    events = events.withColumn("stopped", _first_satisfied(config.stop).over(Window.partitionBy("request_id")))
    return events.where("stopped IS NULL OR struct(seq, step) <= stopped")


def emitted(log: DataFrame, config: Streaming) -> DataFrame:
    """request_id, seq, event, path_key, amount_out, top: what an observer gets.

    `best`: a better route. `route`: a viable one that enters the best top_k, or any if all are asked for. With an initial policy
    nothing is told before it is met; then `initial` brings the best and the top routes (path keys) found by then, once; where it is
    never met, at the end. The quote that releases the results isn't told again.
    """
    events, at = searched(log, config), F.lit(None).cast("int")
    if config.initial:
        every = Window.partitionBy("request_id")
        at = F.coalesce(F.min(F.when(satisfied(config.initial), F.col("seq"))).over(every), F.max("seq").over(every))
    quotes = events.withColumn("at", at).where("step = 0 AND amount_out IS NOT NULL")
    if not config.emit_all_viable:
        quotes = entering(quotes, config.top_k)
    enters = F.lit(True) if config.emit_all_viable else F.col("rank") <= config.top_k
    none = F.lit(None).cast("array<string>")

    def told(event: str, seq: Column, when: Column, top: Column = none) -> Column:
        return F.when(when, F.struct(seq.alias("seq"), F.lit(event).alias("event"), "path_key", "amount_out", top.alias("top")))

    free = F.col("at").isNull() | (F.col("seq") > F.col("at"))
    rows = [told("best", F.col("seq"), free & F.col("best_updated")), told("route", F.col("seq"), free & enters)]
    if config.initial:
        # The best route that was held tells of all: its row has the keys of the first top_k.
        held = Window.partitionBy("request_id").orderBy(free, F.desc("amount_out"), "seq")
        quotes = quotes.withColumn("n", F.when(~free, F.row_number().over(held)))
        every = Window.partitionBy("request_id")
        quotes = quotes.withColumn("t", F.array_sort(F.collect_list(F.when(F.col("n") <= config.top_k, F.struct("n", "path_key"))).over(every)))
        rows.append(told("initial", F.col("at"), F.col("n") == 1, F.col("t.path_key")))
    return quotes.select("request_id", F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))


FINALITY = {"exhaustive": "exhaustive", "heuristic": "heuristic_only", "fast_lane": "fast_lane_only"}


def report(log: DataFrame, config: Streaming) -> DataFrame:
    """request_id, finality, evaluated, viable, failed, best, improvements, heuristic_was_final (only if exhaustive).

    finality: stop_policy_satisfied, or what the completion names. improvements counts better routes after a first phase that had one.
    """
    events = searched(log, config)
    finality = F.when(F.max("stopped").isNotNull(), "stop_policy_satisfied").otherwise(FINALITY[config.completion])
    quote = F.col("step") == 0
    first = F.max(F.when(F.col("phase") != "exhaustive", F.col("amount_out")))
    out = events.groupBy("request_id").agg(
        finality.alias("finality"), F.count_if(quote).alias("evaluated"), F.count("amount_out").alias("viable"), F.max("amount_out").alias("best"),
        F.when(first.isNotNull(), F.count_if(F.col("best_updated") & (F.col("phase") == "exhaustive"))).otherwise(0).alias("improvements"), first.alias("_h"),
    )
    return out.select("request_id", "finality", "evaluated", "viable", (F.col("evaluated") - F.col("viable")).alias("failed"), "best", "improvements", F.when(F.col("finality") == "exhaustive", F.coalesce(F.col("_h") == F.col("best"), F.lit(False))).alias("heuristic_was_final"))
