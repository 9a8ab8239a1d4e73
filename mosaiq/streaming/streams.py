"""Structured Streaming forms of the append logs, windows and job lifecycle."""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timedelta
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from mosaiq.operators.jobs import TERMINAL, feedback_cases
from mosaiq.sources.reports import parse_feedback


def stream_attempts(attempts: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Tumbling attempt counts per namespace and key; events later than two windows are dropped."""
    return (
        attempts.withWatermark("ts", f"{2 * window_seconds} seconds")
        .groupBy(F.window("ts", f"{window_seconds} seconds"), "namespace", "key_id")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            F.unix_timestamp("window.start").alias("window_start"), "namespace", "key_id", "count",
            (F.col("count") <= limit).alias("allowed"), F.greatest(F.lit(0), limit - F.col("count")).alias("remaining"),
        )
    )


STALE = "stale"
BUCKETS = 2048
"""Keys that jobs are dealt into."""
_TIME, _BY_TIME = itemgetter(0), itemgetter(0, 1, 2)

EPOCH = datetime(1970, 1, 1)  # event times are naive and in the session's zone, which is UTC


def _millis(at: datetime) -> int:
    return (at - EPOCH) // timedelta(milliseconds=1)


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class JobLifecycle(StatefulProcessor):
    """State of the jobs of a bucket in the order of event time: terminal states are final, silent jobs become stale after ``ttl``.

    A call to the state costs as much as hundreds of events, so many jobs share a key, and theirs is one value for all.
    Events wait in parts of a map, as they came, until the watermark passes them. A bucket has one timer, for the next event or the
    end of a job's silence; when it fires, all that the watermark has passed is settled in order. So events of several batches,
    late ones within the watermark included, are settled in order. Of a bucket with more than FEW events waiting only the
    times are in memory, one part, and FEW events with those of the same moment as their last.

    Rows are (job_id, nameless, ts, seq, state); without ``job_id`` all are of the job that is the key.
    """

    FEW, ROWS = 200_000, 10_000

    def __init__(self, ttl_seconds: int):
        self.ttl = 1000 * ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("jobs", StructType([StructField("known", BinaryType()), StructField("due", LongType()), StructField("parts", LongType()), StructField("events", LongType())]))
        self.waiting = handle.getMapState("waiting", StructType([StructField("part", LongType())]), StructType([StructField("events", BinaryType())]))

    def _leave(self, known: bytes, due: int | None, wake: int | None, parts: int, events: int) -> None:
        """Keeps the jobs, with their timer moved from ``due`` to ``wake``."""
        if wake != due and due is not None:
            self.handle.deleteTimer(due)
        if wake != due and wake is not None:
            self.handle.registerTimer(wake)
        self.job.update((known, wake, parts, events))

    def _part(self, k: int) -> list[tuple]:
        """Events of a part as (micros, seq, state, job), in the order of time."""
        return pickle.loads(self.waiting.getValue((k,))[0])

    def _put(self, k: int, events: list[tuple]) -> None:
        self.waiting.updateValue((k,), (pickle.dumps(events, pickle.HIGHEST_PROTOCOL),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, due, parts, events = self.job.get() or (b"", None, 0, 0)
        wake = due
        for frame in rows:
            jobs = [None if n else int(j) for j, n in zip(frame["job_id"], frame["nameless"])] if "job_id" in frame else [key[0]] * len(frame)
            new = sorted(zip(_micros(frame["ts"]), map(int, frame["seq"]), frame["state"], jobs), key=_BY_TIME)
            self._put(parts, new)
            first = _millis(frame["ts"].min())
            wake = first if wake is None else min(wake, first)
            parts, events = parts + 1, events + len(new)
        self._leave(bytes(known), due, wake, parts, events)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        known, due, parts, events = self.job.get()
        jobs, out, end = pickle.loads(known) if known else {}, [], 1000 * now + 999
        held = [self._part(k) for k in range(parts)] if events <= self.FEW else None
        if held:
            cuts = [end]
        else:
            times = np.sort(np.concatenate([np.array([e[0] for e in self._part(k)], np.int64) for k in range(parts)] or [np.zeros(0, np.int64)]))
            cuts = [*np.unique(times[times <= end][self.FEW - 1 :: self.FEW]).tolist(), end]
            del times
        low = None
        for cut in cuts:
            ready: list[tuple] = []
            for k in range(parts):
                part = held[k] if held else self._part(k)
                ready += part[0 if low is None else bisect_right(part, low, key=_TIME) : bisect_right(part, cut, key=_TIME)]
            low = cut
            for micros, _, new, job in sorted(ready, key=_BY_TIME):
                state, at = jobs.get(job, (None, None))
                silent = self._silent(state, at)
                if silent is not None and silent < micros // 1000:
                    state, at = STALE, 1000 * silent
                    out.append((job, at, state, True))
                accepted = state not in TERMINAL
                if accepted:
                    state, at = new, micros
                    jobs[job] = (state, at)
                out.append((job, micros, state, accepted))
                if len(out) >= self.ROWS:
                    yield self._frame(out)
                    out = []
        after = []
        for job, (state, at) in jobs.items():
            silent = self._silent(state, at)
            if silent is not None and silent <= now:
                jobs[job] = (STALE, 1000 * silent)
                out.append((job, 1000 * silent, STALE, True))
            elif silent is not None:
                after.append(silent)
        if out:
            yield self._frame(out)
        kept, events = 0, 0
        for k in range(parts):
            part = held[k] if held else self._part(k)
            left = part[bisect_right(part, end, key=_TIME) :]
            if left:
                after.append(left[0][0] // 1000)
                if kept != k or len(left) < len(part):
                    self._put(kept, left)
                kept, events = kept + 1, events + len(left)
        if kept:
            for k in range(kept, parts):
                self.waiting.removeKey((k,))
        elif parts:
            self.waiting.clear()
        self._leave(pickle.dumps(jobs, pickle.HIGHEST_PROTOCOL), due, min(after, default=None), kept, events)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        job, at, state, accepted = zip(*out)
        return pd.DataFrame({"job_id": pd.array(job, "Int64"), "ts": pd.to_datetime(np.array(at, "datetime64[us]")), "state": state, "accepted": accepted})

    def _silent(self, state: str | None, at: int | None) -> int | None:
        """When the job becomes stale unless an event comes."""
        return None if state is None or state in (*TERMINAL, STALE) else at // 1000 + self.ttl

    def close(self) -> None:
        pass


def stream_job_state(events: DataFrame, ttl_seconds: int, lateness: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Job events (job_id, ts, seq, state) -> (job_id, ts, state, accepted) with terminal states immutable.

    A row comes out when the watermark has passed its event. Needs the RocksDB state store provider. Jobs are dealt
    into ``buckets`` by the hash of their id.
    """
    job = F.col("job_id").cast("long")
    bucket = F.pmod(F.xxhash64(job), F.lit(buckets)).alias("bucket")
    # nulls would make numbers of a whole batch floating
    dealt = events.withWatermark("ts", lateness).select(bucket, F.coalesce(job, F.lit(0)).alias("job_id"), job.isNull().alias("nameless"), "ts", "seq", "state")
    return dealt.groupBy("bucket").transformWithStateInPandas(
        JobLifecycle(ttl_seconds), "job_id long, ts timestamp, state string, accepted boolean", "Append", "EventTime",
    )


def stream_feedback(spark: SparkSession, source: str, accepted: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Ingest feedback line files; valid cases and rejects go to separate tables."""
    lines = spark.readStream.schema("value string").text(source).withColumnRenamed("value", "line")
    cases = feedback_cases(parse_feedback(lines))

    def split(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("batch_id", F.lit(batch_id))
        batch.persist()
        # one folder per batch, overwritten on replay, keeps retries idempotent
        batch.where("reject_reason is null").write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
        batch.where("reject_reason is not null").write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
        batch.unpersist()

    return cases.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedupe(cases: DataFrame, key: str = "case_id", lateness: str = "1 day") -> DataFrame:
    """First row per key within the lateness bound."""
    return cases.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def stream_agreement(decisions: DataFrame, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Shadow agreement rate per time window of (ts, decision)."""
    same = F.count_if(F.col("decision") == "agreement")
    return (
        decisions.withWatermark("ts", lateness).groupBy(F.window("ts", window))
        .agg(F.count(F.lit(1)).alias("jobs"), same.alias("agreements"))
        .select(F.unix_timestamp("window.start").alias("window_start"), "jobs", "agreements", (F.col("agreements") / F.col("jobs")).alias("agreement_rate"))
    )
