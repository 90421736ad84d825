"""The event log: fences, invalidations, one sequence over batches, and replays."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.streaming.eventlog import FEED, LATEST, EventLog, fold, numbered


def feed(spark, rows):
    """rows: (kind, request, epoch, version, amount), in order."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], FEED)


def c(version):
    return ("commit", None, None, version, None)


def ask(request, kind="subscribe"):
    return (kind, request, None, None, None)


def result(request, epoch, version, amount=7, kind="result"):
    return (kind, request, epoch, version, amount)


def run(spark, rows, cuts=()):
    log, df = EventLog(spark), feed(spark, rows)
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        log.on_batch(df.where((F.col("seq") >= a) & (F.col("seq") < b)), i)
    return log


def told(log):
    return [(r.number, r.request_id, r.event, r.reason, r.amount, r.previous) for r in log.events().orderBy("number").collect()]


def test_a_result_counts_only_on_the_current_version_and_epoch(spark):
    rows = [ask(1), result(1, 0, 0, 70), c(1), result(1, 0, 0, 71), result(1, 0, 1, 72), ask(1, "replace"), result(1, 0, 1, 73), result(1, 1, 1, None), c(2), result(1, 1, 2, None, "failure"), c(3), ask(1, "cancel"), result(1, 1, 3, 9), c(4)]
    want = [
        (0, 1, "accepted", None, None, None), (1, 1, "published", None, 70, None), (2, None, "commit_applied", None, None, None), (3, 1, "invalidated", "state_advanced", None, None),
        (4, 1, "rejected", "stale_version", None, None), (5, 1, "published", None, 72, 70), (6, 1, "invalidated", "request_changed", None, None), (7, 1, "rejected", "stale_epoch", None, None),
        (8, 1, "published", None, None, 72), (9, None, "commit_applied", None, None, None), (10, 1, "invalidated", "state_advanced", None, None), (11, 1, "failed", None, None, None),
        (12, None, "commit_applied", None, None, None), (13, 1, "cancelled", None, None, None), (14, None, "commit_applied", None, None, None),
    ]
    for cuts in ((), (1, 2, 3, 5, 6, 8, 9, 12)):
        log = run(spark, rows, cuts)
        assert told(log) == want
        assert [tuple(r) for r in log.latest().collect()] == [(1, 1, "cancelled", 1, None, 11)]


def test_requests_do_not_disturb_each_other(spark):
    rows = [ask(1), ask(2), ask(2), result(1, 0, 0, 5), ("replace", 9, None, None, None), result(9, 0, 0, 5), ask(2, "cancel"), ask(2), result(2, 0, 0, 6), ask(2, "cancel")]
    log = run(spark, rows, (4,))
    assert [(r, e) for _, r, e, *_ in told(log)] == [(1, "accepted"), (2, "accepted"), (1, "published"), (2, "cancelled"), (2, "accepted"), (2, "published"), (2, "cancelled")]
    assert {r.request_id: r.state for r in log.latest().collect()} == {1: "ready", 2: "cancelled"}


def test_any_cut_gives_the_same_log(spark):
    rng, rows, version = random.Random(4), [], 0
    for _ in range(120):
        k = rng.random()
        if k < 0.1:
            version += 1
            rows.append(c(version))
        elif k < 0.55:
            rows.append(result(rng.randint(1, 5), rng.randint(0, 2), max(0, version - rng.randint(0, 1)), rng.choice([None, 5, 6]), rng.choice(["result", "result", "failure"])))
        else:
            rows.append(ask(rng.randint(1, 5), rng.choice(["subscribe", "replace", "replace", "cancel"])))
    one, many = run(spark, rows), run(spark, rows, (7, 30, 31, 80))
    assert told(one) == told(many) and sorted(map(tuple, one.latest().collect())) == sorted(map(tuple, many.latest().collect()))
    assert [t[0] for t in told(one)] == list(range(len(told(one))))


def test_a_replayed_batch_adds_nothing(spark):
    rows = [ask(1), result(1, 0, 0), c(1), result(1, 0, 1, 8)]
    log, df = EventLog(spark), feed(spark, rows)
    log.on_batch(df.where("seq < 2"), 0)
    before = told(log)
    log.on_batch(df.where("seq < 2"), 0)
    assert told(log) == before
    # Events written, state not committed: the events aren't seen, and the replay writes the same ones.
    commit, log.store.commit = log.store.commit, lambda *a, **b: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        log.on_batch(df.where("seq >= 2"), 1)
    assert told(log) == before
    log.store.commit = commit
    log.on_batch(df.where("seq >= 2"), 1)
    assert [t[0] for t in told(log)] == list(range(5))


def test_commits_that_leave_a_gap(spark):
    with pytest.raises(RuntimeError):
        run(spark, [ask(1), c(2)])
    with pytest.raises(RuntimeError):
        run(spark, [ask(1), c(1), c(1)])


def test_numbers_are_gapless_over_tasks(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(7)
    got = numbered(df, ["k"], 100).collect()
    assert sorted((r.k, r.number) for r in got) == [(i, 100 + i) for i in range(5000)]


def test_the_latest_values_come_from_the_windows_of_the_batch(spark):
    """No second sort of a batch's rows: each of them knows whether it is its request's last."""
    rows = feed(spark, [ask(1), ask(2), result(1, 0, 0, 5), c(1), ask(2, "cancel"), result(3, 0, 0, 5)])
    _, values = fold(spark.createDataFrame([], LATEST), 0, rows)
    assert "Window" not in values._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, values.select("request_id", "state", "alive", "seq").collect())) == [(1, "pending", True, 3), (2, "cancelled", False, 4)]
