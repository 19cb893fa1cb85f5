"""Live job states against a plain fold: leases, retries, replay, forgetting, and the state read back."""

from __future__ import annotations

import json
import os
import random
from datetime import UTC, datetime, timedelta

import pytest

from rollbook.streaming import inbox

DAY, MINUTE = datetime(2024, 1, 1, tzinfo=UTC), 60_000


@pytest.fixture(scope="module")
def store(spark):
    """A session with the state store that timers need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def write(folder, batches) -> None:
    """A file for each batch of (job, action, progress, minute)."""
    folder.mkdir(exist_ok=True)
    for k, rows in enumerate(batches):
        lines = [json.dumps({"job_id": j, "session_id": "S", "action": a, "progress": p, "ts": (DAY + timedelta(minutes=m)).strftime("%Y-%m-%dT%H:%M:%SZ")}) for j, a, p, m in rows]
        (folder / f"{k:03d}.json").write_text("\n".join(lines))
        os.utime(folder / f"{k:03d}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # the source takes files in the order of their times


def run(spark, folder, check, **options) -> dict[str, list[tuple]]:
    """What the query said of each job, in order: status, progress, minute, tries, whether leased."""
    said: dict[str, list[tuple]] = {}

    def take(batch, _):
        for r in batch.collect():
            said.setdefault(r.job_id, []).append((r.status, r.progress, (r.at - int(DAY.timestamp() * 1000)) // MINUTE, r.tries, r.lease > 0))

    live = inbox.live_states(inbox.events(spark, str(folder), 1), late="0 seconds", **options)
    live.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(check)).trigger(availableNow=True).start().awaitTermination(300)
    return said


def folded(batches, lease: int, tries: int, until: int) -> dict[str, tuple]:
    """The last state of each job, event by event, then as the clock of the last event has it."""
    jobs: dict[str, inbox.Job] = {}
    for j, a, p, m in sorted((x for b in batches for x in b), key=lambda x: (x[3], list(inbox.LEADS_TO).index(x[1]))):
        job = inbox.after(jobs.get(j), "S", a, p, m * MINUTE, lease, tries)
        if job is not None:
            jobs[j] = job
    for j, job in jobs.items():
        if job.lease and job.lease <= until * MINUTE:
            jobs[j] = inbox.expired(job, tries)
    return {j: (x.status, x.progress, x.at // MINUTE, x.tries, x.lease > 0) for j, x in jobs.items()}


def test_a_lost_workers_job_is_offered_again(store, tmp_path):
    """`a` is started and never heard of again; `b` reports and finishes; `c` is started again in the batch in which its lease ends, and fails after this second try. z only moves time."""
    batches = [
        [("a", "enqueue", None, 0), ("b", "enqueue", None, 0), ("c", "enqueue", None, 0), ("a", "start", 10, 1), ("b", "start", None, 1), ("c", "start", 5, 1)],
        [("b", "start", 50, 9), ("z", "enqueue", None, 9)],
        [("z", "enqueue", None, 13)],
        [("b", "finish", 100, 15), ("c", "start", None, 16), ("z", "enqueue", None, 16)],
        [("z", "enqueue", None, 40)],
        [("z", "enqueue", None, 41)],
    ]
    write(tmp_path / "in", batches)
    said = run(store, tmp_path / "in", tmp_path / "check", lease_ms=10 * MINUTE, tries=2)
    assert said["a"] == [("processing", 10, 1, 1, True), ("pending", 10, 11, 1, False)]
    assert said["b"] == [("processing", 0, 1, 1, True), ("processing", 50, 9, 2, True), ("completed", 100, 15, 2, False)]
    assert said["c"] == [("processing", 5, 1, 1, True), ("processing", 5, 16, 2, True), ("failed", 5, 26, 2, False)]
    board = inbox.job_board(store, str(tmp_path / "check"))
    assert {r.job_id: (r.status, r.tries) for r in board.collect()} == {"a": ("pending", 1), "b": ("completed", 2), "c": ("failed", 2), "z": ("pending", 0)}
    assert [r.job_id for r in inbox.next_jobs(board, 2).collect()] == ["a", "z"] and [r.job_id for r in inbox.next_jobs(board, 1).collect()] == ["a"]


def test_replay_equals_the_fold(store, tmp_path):
    """Random events in time order, in batches: the last word on each job is the plain fold's, again after a second run on more files."""
    r = random.Random(3)
    minutes = sorted(r.sample(range(400), 90))
    rows = [(f"j{r.randint(0, 7)}", r.choice(list(inbox.LEADS_TO)), r.choice([None, 50, 500, -3]), m) for m in minutes]
    batches = [rows[i : i + 15] for i in range(0, 90, 15)]
    write(tmp_path / "in", batches[:4])
    said = run(store, tmp_path / "in", tmp_path / "check", lease_ms=30 * MINUTE, tries=2)
    write(tmp_path / "in", [*batches, [("clock", "enqueue", None, 1000)], [("clock", "enqueue", None, 1001)]])
    for j, more in run(store, tmp_path / "in", tmp_path / "check", lease_ms=30 * MINUTE, tries=2).items():
        said[j] = said.get(j, []) + more
    want = folded(batches, 30 * MINUTE, 2, 1000)
    assert {j: x[-1] for j, x in said.items() if j != "clock"} == want and len(want) == 8


def test_jobs_are_forgotten(store, tmp_path):
    """A day after its last event a job is gone, and an event that needs it starts from nothing."""
    batches = [[("a", "enqueue", None, 0), ("b", "enqueue", None, 700)], [("b", "enqueue", None, 1500)], [("a", "cancel", None, 1600), ("b", "cancel", None, 1600)]]
    write(tmp_path / "in", batches)
    said = run(store, tmp_path / "in", tmp_path / "check")
    assert said == {"a": [("pending", 0, 0, 0, False)], "b": [("pending", 0, 700, 0, False), ("pending", 0, 1500, 0, False), ("cancelled", 0, 1600, 0, False)]}
    assert [r.job_id for r in inbox.job_board(store, str(tmp_path / "check")).collect()] == ["b"]


def test_live_equals_batch_without_leases(store, tmp_path):
    """The same events through job_states: progress that isn't given stays, cancellations count for pending jobs only."""
    batches = [[("a", "enqueue", None, 0), ("b", "enqueue", 10, 0), ("d", "cancel", None, 0), ("g", "cancel", None, 0)], [("b", "start", None, 1), ("c", "start", 400, 1), ("e", "enqueue", -7, 1)], [("c", "finish", None, 2), ("e", "cancel", None, 2), ("c", "cancel", 3, 3), ("g", "enqueue", 1, 3)]]
    write(tmp_path / "in", batches)
    said = run(store, tmp_path / "in", tmp_path / "check")
    batch = {r.job_id: (r.status, r.progress) for r in inbox.job_states(store.read.schema(inbox.EVENT).json(str(tmp_path / "in"))).collect()}
    assert batch == {j: x[-1][:2] for j, x in said.items()} == {"a": ("pending", 0), "b": ("processing", 10), "c": ("completed", 3), "e": ("cancelled", 0), "g": ("pending", 1)}
