"""Jobs as a stream (ST1 to ST6, ST8): an inbox of job events, current job state in batch and live, leases that expire, progress and retention."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from rollbook.functions.support import clamp_progress

EVENT = "job_id string, session_id string, action string, progress int, ts timestamp"
# States and the actions that lead to them.
STATUSES = ("pending", "processing", "completed", "failed", "cancelled")
LEADS_TO = {"enqueue": "pending", "start": "processing", "finish": "completed", "fail": "failed", "cancel": "cancelled"}
TTL, TTL_MS = "24 hours", 24 * 3_600_000


def events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Job events from JSON files as they arrive. With a checkpointed query each is processed at least once."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).json(path)


def job_states(jobs: DataFrame) -> DataFrame:
    """Each job's latest state, of all its events in time order (ties: in the order of LEADS_TO).

    enqueue, start, finish and fail set the state whatever it was; a cancellation counts only for a pending job. So the last event
    but cancellations decides, and a cancellation after it counts if it is an enqueue: one aggregation, no fold. Jobs that were
    only cancelled don't exist. Progress is the last one given, kept within 0 and 100, and 0 before any: events without one don't change it.
    """
    order = F.create_map(*[F.lit(x) for k, a in enumerate(LEADS_TO) for x in (a, k)])
    leads = F.create_map(*[F.lit(x) for p in LEADS_TO.items() for x in p])
    when = F.struct("ts", F.try_element_at(order, F.col("action")).alias("nth"), F.try_element_at(leads, F.col("action")).alias("status"))
    given = F.max_by(clamp_progress(F.col("progress")), F.when(F.col("progress").isNotNull(), F.struct("ts", F.try_element_at(order, F.col("action")), "progress")))
    work = F.col("action").isin([a for a in LEADS_TO if a != "cancel"])
    out = jobs.groupBy("job_id").agg(F.max("session_id").alias("session_id"), F.max(F.when(work, when)).alias("worked"), F.max(F.when(F.col("action") == "cancel", F.col("ts"))).alias("cancelled"), F.max("ts").alias("ts"), F.coalesce(given, F.lit(0)).alias("progress"))
    off = (F.col("worked.status") == "pending") & (F.col("cancelled") >= F.col("worked.ts"))
    out = out.filter("worked is not null")
    return out.select("job_id", "session_id", F.when(off, "cancelled").otherwise(F.col("worked.status")).alias("status"), "progress", "ts")


def next_state(status: str | None, action: str) -> str | None:
    """The state after one event; None: the job doesn't exist."""
    if action == "cancel":
        return "cancelled" if status == "pending" else status
    return LEADS_TO.get(action, status)


class Job(NamedTuple):
    """A job as it is kept: times in milliseconds; queued: when it was last offered; lease: until when its worker has it, 0 if none has."""

    session_id: str | None
    status: str
    progress: int
    at: int
    queued: int
    tries: int
    lease: int


JOB = "session_id string, status string, progress int, at long, queued long, tries int, lease long"
LIVE = "job_id string, session_id string, status string, progress int, at long, queued long, tries int, lease long"


def expired(job: Job, tries: int) -> Job:
    """A job whose worker's time is over: offered again from that moment, or failed if it has been tried so many times."""
    if job.tries >= tries:
        return job._replace(status="failed", at=job.lease, lease=0)
    return job._replace(status="pending", at=job.lease, queued=job.lease, lease=0)


def after(job: Job | None, session: str | None, action: str, progress: int | None, at: int, lease: int, tries: int, keep: int = TTL_MS) -> Job | None:
    """A job after an event. A lease that ended before it ends first, and what was to be forgotten is; any event of a job that is worked on renews its lease."""
    if job is not None and job.lease and at >= job.lease:
        job = expired(job, tries)
    if job is not None and not job.lease and at >= job.at + keep:
        job = None
    status = next_state(job.status if job else None, action)
    if status is None:
        return None
    old = job or Job(session, status, 0, at, at, 0, 0)
    return Job(
        session, status, old.progress if progress is None else min(100, max(0, progress)), at, at if action == "enqueue" else old.queued,
        0 if action == "enqueue" else old.tries + (action == "start"), at + lease if lease and status == "processing" else 0,
    )


class JobProcessor(StatefulProcessor):
    """Keeps one Job for each job_id. Its timer is the end of its lease or, without one, of its time to live."""

    def __init__(self, lease: int, tries: int, keep: int) -> None:
        self.lease, self.tries, self.keep = lease, tries, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", JOB)

    def _load(self) -> Job | None:
        return Job(*self.job.get()) if self.job.exists() else None

    def _store(self, key: tuple, job: Job) -> Iterator[pd.DataFrame]:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(job.lease or job.at + self.keep)
        self.job.update(tuple(job))
        yield pd.DataFrame([(*key, *job)], columns=["job_id", *Job._fields])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        job, order = self._load(), {a: k for k, a in enumerate(LEADS_TO)}
        events = pd.concat(list(rows))
        events["nth"] = events["action"].map(order)
        for r in events.sort_values(["at", "nth", "progress"], kind="stable", na_position="first").itertuples():
            job = after(job, r.session_id, r.action, None if pd.isna(r.progress) else int(r.progress), int(r.at), self.lease, self.tries, self.keep)
        if job is not None:
            yield from self._store(key, job)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job, now = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        if job is not None and job.lease and job.lease <= now:
            yield from self._store(key, expired(job, self.tries))
        elif job is not None and not job.lease and job.at + self.keep <= now:
            self.job.clear()

    def close(self) -> None:
        pass


def live_states(stream: DataFrame, lease_ms: int = 0, tries: int = 3, keep_ms: int = TTL_MS, late: str = "10 minutes") -> DataFrame:
    """Jobs as their events arrive: a row for each job that a batch changes (ST2 to ST6).

    A worker that starts a job has it for lease_ms (0: for ever) after each of the job's events; when that is over, by the events' own time, the job
    is offered again, and after so many tries it has failed. A job is forgotten keep_ms after its last event. Time is the watermark, so a replay
    gives the same. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    known = stream.filter(F.col("action").isin(list(LEADS_TO)) & F.col("ts").isNotNull()).withWatermark("ts", late)
    timed = known.select("job_id", "session_id", "action", "progress", F.unix_millis("ts").alias("at"), "ts")
    return timed.groupBy("job_id").transformWithStateInPandas(JobProcessor(lease_ms, tries, keep_ms), LIVE, "Update", "EventTime")


def job_board(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All jobs that a query of live_states keeps, read from its state: LIVE's columns, without stopping it."""
    state = spark.read.format("statestore").option("stateVarName", "job").load(checkpoint)
    return state.select(F.col("key.job_id").alias("job_id"), "value.*")


def next_jobs(board: DataFrame, n: int) -> DataFrame:
    """The n jobs that have been waiting longest, first come first (ST1)."""
    return board.filter("status = 'pending'").orderBy("queued", "job_id").limit(n)


def hourly(jobs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events by hour and action; rows later than the watermark are dropped once their hour is done."""
    return jobs.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "action", "n")


def distinct_events(jobs: DataFrame, keep: str = TTL) -> DataFrame:
    """Events once each, remembered for the jobs' time to live: at-least-once delivery made effectively once."""
    return jobs.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["job_id", "action", "ts"])


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to a Parquet log and ends; runs again from where it stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
