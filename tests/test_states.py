"""Subscription states by mergeable aggregates: no group is gathered, and the folds in order give the same."""

import random

from waymark.streaming import live

AFTER = {"invalidate": "pending", "start": "searching", "result": "ready", "failure": "failed", "cancel": "cancelled"}


def fold(log):
    epoch, state = 0, "closed"
    for _, kind in sorted(log):
        epoch += kind == "replace"
        if kind in ("subscribe", "replace"):
            state = "pending"
        elif state not in ("cancelled", "closed"):
            state = AFTER.get(kind, state)
    return epoch, state


def test_states_without_gathering(spark):
    rng = random.Random(4)
    logs = {r: [(rng.randrange(12), rng.choice(["subscribe", "replace", "other", *AFTER])) for _ in range(rng.randrange(1, 9))] for r in range(600)}
    events = spark.createDataFrame([(s, r, k) for r, log in logs.items() for s, k in log], "seq long, request_id long, kind string")
    found = live.subscription_states(events)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    assert {r["request_id"]: (r["epoch"], r["state"]) for r in found.collect()} == {r: fold(log) for r, log in logs.items()}
