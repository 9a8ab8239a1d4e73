"""Stream operators over several micro-batches with rows out of order and rows that come too late."""

import datetime
import random
import types

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mosaiq.operators import jobs as jb
from mosaiq.streaming import streams

START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def batches(spark, tmp_path):
    """Runs a stream operator over lists of rows, a micro-batch each, and returns what it put out."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(parts, schema, operator):
        src, out = str(tmp_path / "in"), str(tmp_path / "out")
        for k, rows in enumerate(parts):
            at = lambda s: START + datetime.timedelta(seconds=s)
            made = spark.createDataFrame([tuple(at(v) if i == 1 else v for i, v in enumerate(r)) for r in rows], schema)
            made.coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(made.schema).parquet(src)
            query = operator(stream).writeStream.outputMode("append").foreachBatch(
                lambda b, i, k=k: b.write.mode("overwrite").parquet(f"{out}/b={1000 * k + i}")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            query.awaitTermination()
        return spark.read.parquet(out)

    return run


EVENTS = "job_id long, ts timestamp, seq long, state string"


def test_job_states_over_batches_in_the_order_of_events(spark, batches):
    rnd = random.Random(3)
    events = [(job, 60 * rnd.randrange(120), k, rnd.choice(["queued", "running", "running", "failed", "succeeded"])) for k, job in enumerate(list(range(12)) * 6)]
    # rows come up to five minutes out of order, in four batches; the last row lets all of them settle
    order = sorted(events, key=lambda e: e[1] + rnd.randrange(300))
    parts = [order[i : i + 18] for i in range(0, 72, 18)] + [[(99, 30 * 86400, 0, "succeeded")]]
    got = batches(parts, EVENTS, lambda s: streams.stream_job_state(s, 86400, "10 minutes")).where("job_id < 99").collect()
    rows = [(e[0], START + datetime.timedelta(seconds=e[1]), e[2], e[3]) for e in events]
    want = {r.job_id: (r.state, r.rejected_events) for r in jb.job_state(spark.createDataFrame(rows, EVENTS)).collect()}
    for job, (state, rejected) in want.items():
        mine = [r for r in got if r.job_id == job]
        assert sum(not r.accepted for r in mine) == rejected
        last = max((r for r in mine if r.accepted), key=lambda r: r.ts)
        assert last.state == (state if state in jb.TERMINAL else "stale")
        assert sum(r.state != "stale" for r in mine) == 6


def test_stale_jobs_wake_up_and_late_events_are_left_out(batches):
    parts = [
        [(1, 0, 1, "queued"), (2, 0, 1, "queued")], [(1, 100, 2, "running"), (3, 5000, 1, "queued")],
        [(2, 10, 2, "failed"), (1, 5100, 3, "succeeded"), (1, 5200, 4, "running")],  # job 2's row is more than ten minutes late
        [(9, 90_000, 1, "succeeded")],
    ]
    rows = batches(parts, EVENTS, lambda s: streams.stream_job_state(s, 1000, "10 minutes")).where("job_id < 9").collect()
    seen = {}
    for r in sorted(rows, key=lambda r: r.ts):
        seen.setdefault(r.job_id, []).append((int((r.ts - START).total_seconds()), r.state, r.accepted))
    assert seen[1] == [(0, "queued", True), (100, "running", True), (1100, "stale", True), (5100, "succeeded", True), (5200, "succeeded", False)]
    assert seen[2] == [(0, "queued", True), (1000, "stale", True)]
    assert seen[3] == [(5000, "queued", True), (6000, "stale", True)]


def test_dedupe_over_batches(batches):
    parts = [[(1, 0), (1, 30), (2, 40)], [(1, 3000), (3, 3100)], [(6, 80_000)], [(3, 90_000), (1, 90_100), (4, 100)], [(5, 200_000)], [(2, 50)]]
    got = batches(parts, "case_id long, ts timestamp", lambda s: streams.stream_dedupe(s, "case_id", "1 hour")).collect()
    seen = sorted((r.case_id, int((r.ts - START).total_seconds())) for r in got)
    # within the hour copies go, also those of other batches; once the watermark has passed it a case is new; late rows are left out
    assert seen in ([(1, first), (1, 90_100), (2, 40), (3, 3100), (3, 90_000), (5, 200_000), (6, 80_000)] for first in (0, 30))


class _Calls:
    """State and timers of one job in memory, with a count of calls."""

    def __init__(self):
        self.n, self.value, self.slots, self.timers = 0, None, {}, set()

    def __getattr__(self, name):
        def call(*args):
            self.n += 1
            return {
                "getValueState": lambda *_: self, "getMapState": lambda *_: self, "get": lambda: self.value, "exists": lambda: self.value is not None,
                "update": lambda v: setattr(self, "value", v), "getValue": self.slots.get, "containsKey": lambda k: k in self.slots,
                "updateValue": self.slots.__setitem__, "removeKey": self.slots.pop, "clear": self.slots.clear, "keys": lambda: list(self.slots),
                "iterator": lambda: list(self.slots.items()), "registerTimer": self.timers.add, "deleteTimer": self.timers.discard,
            }[name](*args)

        return call


@pytest.mark.parametrize("few", [1000, 3])
def test_a_job_costs_few_state_calls(few):
    state, work = _Calls(), streams.JobLifecycle(1000)
    work.FEW = few
    work.init(state)
    at = lambda s: pd.Timestamp(START) + pd.Timedelta(seconds=s)
    rows = [(at(10 * k), k, "failed" if k == 49 else "running") for k in random.Random(1).sample(range(50), 50)]
    list(work.handleInputRows((7,), iter([pd.DataFrame(rows[:20], columns=["ts", "seq", "state"]), pd.DataFrame(rows[20:], columns=["ts", "seq", "state"])]), None))
    seen, mark = [], lambda s: streams._millis(START) + 1000 * s
    for watermark in (200, 9999):
        while due := sorted(t for t in state.timers if t <= mark(watermark)):
            clock = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: mark(watermark), getExpiryTimeInMs=lambda: due[0])  # noqa: B023
            seen += list(work.handleExpiredTimer((7,), clock, clock))
            state.timers.discard(due[0])
    out = pd.concat(seen)
    assert list(out["ts"]) == [at(10 * k) for k in range(50)] and list(out["state"]) == ["running"] * 49 + ["failed"] and out["accepted"].all()
    assert len(seen) <= 4 and not state.slots and state.n < (130 if few > 50 else 230)


def test_jobs_of_a_bucket_cost_no_calls_of_their_own():
    at = lambda s: pd.Timestamp(START) + pd.Timedelta(seconds=s)
    rnd = random.Random(2)
    rows = [(job, job is None, at(rnd.randrange(5000)), k, rnd.choice(["running", "running", "failed"])) for k, job in enumerate([None, *range(1, 40)] * 5)]
    seen = {}
    for few in (10**6, 7):
        state, work = _Calls(), streams.JobLifecycle(1000)
        work.FEW = few
        work.init(state)
        frames = [pd.DataFrame(rows[a : a + 50], columns=["job_id", "nameless", "ts", "seq", "state"]) for a in (0, 50, 100, 150)]
        list(work.handleInputRows((3,), iter(frames), None))
        got, calls = [], state.n
        for watermark in (2000, 9999):
            mark = streams._millis(START) + 1000 * watermark
            while due := sorted(t for t in state.timers if t <= mark):
                clock = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: mark, getExpiryTimeInMs=lambda: due[0])  # noqa: B023
                got += list(work.handleExpiredTimer((3,), clock, clock))
                state.timers.discard(due[0])
        seen[few] = sorted(((-1 if pd.isna(r.job_id) else r.job_id, r.ts, r.state, r.accepted) for f in got for r in f.itertuples()), key=str)
        assert calls < 20 and not state.slots and (few == 7 or state.n < 50)
    assert seen[7] == seen[10**6] and sum(r[2] != "stale" or not r[3] for r in seen[7]) == 200
    for job in range(1, 40):
        silent, last, done = [], None, False
        for r in sorted((r for r in rows if r[0] == job), key=lambda r: (r[2], r[3])):
            if last is not None and r[2] - last > pd.Timedelta(seconds=1000) and not done:
                silent.append(last + pd.Timedelta(seconds=1000))
            done, last = done or r[4] == "failed", r[2]
        silent += [] if done else [last + pd.Timedelta(seconds=1000)]
        assert [r[1] for r in seen[7] if r[0] == job and r[2] == "stale"] == silent


def test_jobs_without_an_id_and_with_huge_ones(batches):
    huge = 2**60 + 1
    rows = [[(None, 0, 1, "running"), (huge, 0, 2, "running"), (huge + 1, 5, 3, "failed")], [(None, 9, 4, "succeeded"), (9, 90_000, 5, "failed")]]
    got = batches(rows, EVENTS, lambda s: streams.stream_job_state(s, 1000, "10 minutes")).collect()
    of = lambda job: sorted((int((r.ts - START).total_seconds()), r.state) for r in got if r.job_id == job)
    assert of(None) == [(0, "running"), (9, "succeeded")] and of(huge) == [(0, "running"), (1000, "stale")] and of(huge + 1) == [(5, "failed")]
