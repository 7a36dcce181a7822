"""Stateful runs over shuffled micro-batches, restarts and timers; the table function."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonorant.operators import runs
from sonorant.streaming import events, stateful

SCHEMA = "rec string, i bigint, active boolean, last bigint"


def recordings(seed, n=6):
    rng = random.Random(seed)
    return {f"r{k}": [rng.random() < 0.45 for _ in range(rng.choice([1, 7, 60]))] for k in range(n)}


def batch(spark, frames):
    rows = [(r, i, a) for r, x in frames.items() for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "rec string, i bigint, active boolean")
    return sorted(tuple(r) for r in runs.runs(df, "rec", F.col("active"), 2, max_gap=1, hold_open=True).collect())


def test_stream_equals_the_batch_rule_out_of_order_and_after_restarts(spark, tmp_path):
    frames = recordings(3)
    rows = [(r, i, a, None) for r, x in frames.items() for i, a in enumerate(x)] + [(r, None, None, len(x) - 1) for r, x in frames.items()]
    rows += rng_some(rows, 40)  # frames that come twice
    random.Random(1).shuffle(rows)
    src, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    cuts = np.linspace(0, len(rows), 5).astype(int)
    for a, b in zip(cuts, cuts[1:], strict=False):  # each call is a new query that goes on from the state of the last
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        got = events.over_new_files(spark, src, SCHEMA, lambda df: stateful.runs_of_stream(df, "rec", 1, 2), out, log)
    want = batch(spark, frames)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 5


def rng_some(rows, n):
    return random.Random(2).sample([r for r in rows if r[1] is not None], n)


class Memory:
    """State and timers as the processor sees them."""

    def __init__(self):
        self.value, self.items, self.timers = None, [], []

    get = lambda self: self.value
    update = lambda self, v: setattr(self, "value", v)


def test_a_recording_without_a_marker_ends_when_patience_does(spark):
    import pandas as pd

    p = stateful.RunsOfStream("rec", 1, 2, 1000)
    state, early = Memory(), Memory()
    early.get = lambda: iter(early.items)
    early.put = lambda v: setattr(early, "items", v)
    early.clear = lambda: setattr(early, "items", [])
    p.state, p.early = state, early

    class Handle:
        at = []
        listTimers = lambda self: iter(self.at)  # noqa: E731, N815
        deleteTimer = lambda self, t: self.at.remove(t)  # noqa: E731, N815
        registerTimer = lambda self, t: self.at.append(t)  # noqa: E731, N815

    class Clock:
        getCurrentProcessingTimeInMs = lambda self: 5  # noqa: E731, N815

    p.handle = Handle()
    rows = pd.DataFrame({"rec": "a", "i": [0, 1, 2, 6, 7], "active": [True, True, False, True, True], "last": [None] * 5})
    assert sum(len(o) for o in p.handleInputRows(("a",), iter([rows]), Clock())) == 0 and p.handle.at == [1005] and len(early.items) == 2
    done = list(p.handleExpiredTimer(("a",), Clock(), None))
    assert [tuple(r) for r in done[0].itertuples(index=False)] == [("a", 1, 0, 1), ("a", 2, 6, 7)]
    assert list(p.handleExpiredTimer(("a",), Clock(), None)) == [] or all(len(o) == 0 for o in p.handleExpiredTimer(("a",), Clock(), None))


@pytest.mark.parametrize("seed", [0, 9])
def test_table_function_equals_the_batch_rule(spark, seed):
    frames = recordings(seed)
    stateful.register(spark)
    rows = [(r, i, a) for r, x in frames.items() for i, a in enumerate(x)]
    random.Random(seed).shuffle(rows)
    spark.createDataFrame(rows, "recording string, i bigint, active boolean").createOrReplaceTempView("frames_of_test")
    got = spark.sql("SELECT * FROM segments(TABLE(frames_of_test) PARTITION BY (recording) ORDER BY (i), 1, 2)")
    assert sorted(tuple(r) for r in got.collect()) == batch(spark, frames)
