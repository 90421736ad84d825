"""Coverage steps and the guarded count index."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from waymark.streaming import states
from waymark.streaming.store import shared_folder

HOUR = 3_600_000


@pytest.mark.parametrize(("state", "kind", "present", "want"), [
    ("unknown", "queued", None, ("queued", None)), ("queued", "discovering", None, ("discovering", None)), ("discovering", "settled", True, ("ready", None)),
    ("queued", "settled", False, ("empty", None)), ("discovering", "failed", None, ("failed", None)), ("failed", "queued", None, ("queued", None)),
    ("unknown", "settled", True, ("unknown", "transition")), ("ready", "discovering", None, ("ready", "transition")), ("queued", "queued", None, ("queued", "transition")),
    ("unknown", "graph", True, ("ready", None)), ("empty", "graph", True, ("ready", None)), ("failed", "graph", True, ("failed", None)), ("ready", "graph", False, ("ready", None)),
    ("queued", "configured", None, ("queued", None)), ("queued", "else", None, ("queued", "kind")), ("empty", "queued", None, ("empty", "negative_is_fresh")),
])
def test_steps(state, kind, present, want):
    assert states.step(state, 0, kind, bool(present), 10, 100) == want


def test_a_negative_goes_stale():
    assert states.step("empty", 0, "queued", False, 100, 100) == ("queued", None)


def test_stream_with_timers_over_batches(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(hours=h)
    batches = [
        [(1, at(0), 7, "queued", None, None), (2, at(0), 7, "settled", False, 0), (3, at(0), 8, "discovering", None, None)],
        [(4, at(1), 7, "queued", None, None), (5, at(1), 8, "queued", None, None)],  # 7's negative is fresh
        [(6, at(30), 8, "settled", True, 3)],  # moves the watermark past 7's timer
        [(7, at(31), 7, "queued", None, None), (8, at(31), 8, "graph", True, 4), (6, at(31), 8, "failed", None, None)],
    ]
    folder = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    for rows in batches:
        spark.createDataFrame(rows, states.STEP).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        steps = spark.readStream.schema(states.STEP).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        with states.keyed_state(spark):  # a run a batch: state and watermark go on from the checkpoint
            q = states.coverage_stream(steps, 6 * HOUR).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/check")
            q.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out/batch={i}")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(states.LEDGER).parquet(f"{folder}/out/*").collect()
    rows = sorted((r.seq, r.token, r.kind, r.before, r.after, r.error) for r in got)
    assert [r for r in rows if r[2] != "expired"] == sorted([
        (1, 7, "queued", "unknown", "queued", None), (2, 7, "settled", "queued", "empty", None), (3, 8, "discovering", "unknown", "unknown", "transition"),
        (4, 7, "queued", "empty", "empty", "negative_is_fresh"), (5, 8, "queued", "unknown", "queued", None), (6, 8, "settled", "queued", "ready", None),
        (7, 7, "queued", "empty", "queued", None), (8, 8, "graph", "ready", "ready", None), (6, 8, "failed", "ready", "ready", "late"),
    ])
    assert [(r.token, r.after) for r in got if r.kind == "expired"] == [(7, "empty")]


def test_stateful_conf_is_put_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    with pytest.raises(ValueError), states.keyed_state(spark):
        raise ValueError
    assert spark.conf.get(key) == was


POOLS, DELTA = "pool long, tokens array<long>", "pool long, before array<long>, after array<long>"


def stats(index, spark, *tokens):
    got = {r.token: (r.token_present, r.token_pools, r.tokens, r.pools, r.edges) for r in index.stats(spark.createDataFrame([(t,) for t in tokens], "token long")).collect()}
    return [got[t] for t in tokens]


def test_index_follows_contiguous_deltas(spark):
    a, b, c = 1, 2, 3
    index = states.CountIndex(spark)
    index.baseline(spark.createDataFrame([], POOLS), version=4)
    delta = lambda rows: spark.createDataFrame(rows, DELTA)
    first = delta([(0x10, None, [b, a]), (0x11, None, [b, c])])  # order of tokens doesn't matter
    assert index.apply(first, 5) == "applied"
    assert stats(index, spark, a, b, c, 9) == [(True, 1, 3, 2, 4), (True, 2, 3, 2, 4), (True, 1, 3, 2, 4), (False, 0, 3, 2, 4)]
    assert index.apply(first, 5) == "stale" and index.apply(first, 3) == "stale" and index.apply(first, 7) == "gap"
    assert index.apply(delta([(0x10, [a, b], None)]), 6) == "applied" and index.version() == 6
    assert stats(index, spark, a, b, c) == [(False, 0, 2, 1, 2), (True, 1, 2, 1, 2), (True, 1, 2, 1, 2)]
    # A wrong `before`, an unknown pool and a pool named twice refuse the whole delta.
    for rows in ([(0x11, [a, b], None), (0x12, None, [a, c])], [(0x13, [a, b], [a, c])], [(0x14, None, [a, b]), (0x14, None, [a, c])]):
        assert index.apply(delta(rows), 7) == "incoherent"
    assert index.version() == 6 and stats(index, spark, b)[0] == (True, 1, 2, 1, 2)
    assert index.apply(delta([(0x11, [c, b], [a, b, c, c])]), 7) == "applied"
    assert stats(index, spark, a, b) == [(True, 1, 3, 1, 6), (True, 1, 3, 1, 6)]
    log = index.log().orderBy("step").collect()
    assert [r.verdict for r in log] == ["baseline", "applied", "stale", "stale", "gap", "applied", *["incoherent"] * 3, "applied"]
    assert [r.wrong for r in log if r.verdict == "incoherent"] == [1, 1, 1]


def test_index_of_an_empty_delta(spark):
    index = states.CountIndex(spark)
    index.baseline(spark.createDataFrame([(1, [1, 2, 2])], POOLS))
    assert index.apply(spark.createDataFrame([], DELTA).where(F.lit(True)), 1) == "applied"
    assert stats(index, spark, 1) == [(True, 1, 2, 1, 2)]


def test_steps_of_tokens_that_start_over_in_time_are_kept(spark, tmp_path):
    import duckdb

    from waymark import plans

    source, d, c = "/root/testdata/sf0.001", str(tmp_path), duckdb.connect()
    # Copies have ids and users of their own, but the times of the first: by seq, time starts over with each.
    c.execute(f"COPY (SELECT * REPLACE (event_id + g * 100000 AS event_id, user_id + g * 1000 AS user_id) FROM range(4) x(g), '{source}/events.parquet') TO '{d}/events.parquet' (FORMAT parquet)")
    for t in "region nation customer supplier part orders lineitem".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{source}/{t}.parquet'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    want = c.sql(plans.ORACLE["coverage_steps"])
    columns = sorted(want.columns)
    got = plans.QUERIES["coverage_steps"](spark, d).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.select(*columns).fetchall()))


def test_state_in_given_partitions(spark):
    key = "spark.sql.shuffle.partitions"
    was = spark.conf.get(key)
    with states.keyed_state(spark, 3):
        assert spark.conf.get(key) == "3"
    assert spark.conf.get(key) == was
