"""A queue of jobs as a stream with state: claims, retries behind a growing pause, poison, and stale claims taken over once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A claim not refreshed for so long may be taken over; the pause before a first retry, which doubles; retries before poison.
STALE_MS, PAUSE_MS, RETRIES = 15 * 60 * 1000, 30 * 1000, 3

EVENT = "job_id, doc_id, event_id, at, kind, worker"
CHANGES = "job_id long, doc_id long, seq long, event_id long, at_ms long, worker string, change string, status string, retries int, next_ms long"
_ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for n, t in (c.split() for c in CHANGES.split(", "))])
STATE = "doc_id long, status string, retries int, next_ms long, worker string, claimed_ms long, last_event long, seq long"


class Job(NamedTuple):
    doc_id: int | None
    status: str | None = None
    retries: int = 0
    next_ms: int | None = None
    worker: str | None = None
    claimed_ms: int | None = None
    last_event: int = -1
    seq: int = 0


def ripened(job: Job, now_ms: int) -> Job:
    """The job once a claim that was not refreshed by `now_ms` is stale; its worker holds it until another claims it."""
    late = job.status == "running" and now_ms >= job.claimed_ms + STALE_MS
    return job._replace(status="stale", seq=job.seq + 1) if late else job


def stepped(job: Job, kind: str, worker: str | None, at_ms: int) -> tuple[Job, str]:
    """The job after one event, and what the event did: nothing where it is refused."""
    held = job.status in ("running", "stale") and worker is not None and worker == job.worker
    if kind == "enqueue" and job.status is None:
        return job._replace(status="queued"), "queued"
    if kind == "claim" and worker is not None:
        if job.status == "queued" or (job.status == "retrying" and at_ms >= job.next_ms) or (job.status == "stale" and held):
            return job._replace(status="running", worker=worker, claimed_ms=at_ms, next_ms=None), "claimed"
        if job.status == "stale":
            return job._replace(status="running", worker=worker, claimed_ms=at_ms), "taken over"
    if kind == "touch" and held:
        return job._replace(status="running", claimed_ms=at_ms), "touched"
    if kind == "done" and held:
        return job._replace(status="done", worker=None, claimed_ms=None), "done"
    if kind == "fail" and held:
        if job.retries < RETRIES:
            return job._replace(status="retrying", worker=None, claimed_ms=None, retries=job.retries + 1, next_ms=at_ms + PAUSE_MS * 2**job.retries), "retrying"
        return job._replace(status="poisoned", worker=None, claimed_ms=None), "poisoned"
    if kind == "cancel" and job.status in ("queued", "retrying"):
        return job._replace(status="cancelled", next_ms=None), "cancelled"
    return job, "refused"


def _row(job_id: int, job: Job, event_id: int | None, at_ms: int, worker: str | None, change: str) -> tuple:
    return (job_id, job.doc_id, job.seq, event_id, at_ms, worker, change, job.status, job.retries, job.next_ms)


def _after(job_id: int, job: Job, event_id: int, at_ms: int, kind: str, worker: str | None) -> tuple[Job, list[tuple]]:
    """The job after one event that is no replay, and its rows."""
    rows, ripe = [], ripened(job, at_ms)
    if ripe is not job:
        rows.append(_row(job_id, ripe, None, job.claimed_ms + STALE_MS, job.worker, "stale"))
    job, change = stepped(ripe, kind, worker, at_ms)
    job = job._replace(last_event=event_id, seq=job.seq + 1)
    rows.append(_row(job_id, job, event_id, at_ms, worker, change))
    return job, rows


def advanced(job_id: int, job: Job | None, events: pd.DataFrame) -> tuple[Job, list[tuple]]:
    """The job after its events, in order of event_id; those up to the last one seen are replays and do nothing."""
    rows = []
    for e in events.sort_values("event_id").itertuples(index=False):
        job = job or Job(None if pd.isna(e.doc_id) else int(e.doc_id))
        if e.event_id <= job.last_event:
            continue
        job, more = _after(job_id, job, int(e.event_id), int(e.at_ms), e.kind, None if pd.isna(e.worker) else e.worker)
        rows += more
    return job, rows


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of events that come job by job, in order; a job may go on in the next batch."""
    job_id, job = None, None
    for batch in batches:
        rows = []
        for i, doc_id, event_id, at_ms, kind, worker in zip(*(batch.column(c).to_pylist() for c in ("job_id", "doc_id", "event_id", "at_ms", "kind", "worker"))):
            if job is None or i != job_id:
                job_id, job = i, Job(doc_id)
            if event_id > job.last_event:
                job, more = _after(i, job, event_id, at_ms, kind, worker)
                rows += more
        columns = zip(*rows) if rows else [()] * len(_ARROW)
        yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, _ARROW.types)], _ARROW)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in CHANGES.split(", ")])
    return out.astype({"doc_id": "Int64", "event_id": "Int64", "next_ms": "Int64", "worker": "object"})


def _known(events: DataFrame) -> DataFrame:
    """Events with what cannot be placed left out: no job, no number or no time."""
    return events.selectExpr(*EVENT.split(", "), "unix_millis(at) AS at_ms").filter("job_id is not null and event_id is not null and at is not null")


def history(events: DataFrame) -> DataFrame:
    """What each event of a table did to its job, one row an event, and one where a claim went stale before the next event.

    `events` has job_id, doc_id, event_id, at, kind and worker. Events of a job are taken by event_id, a repeated number counts
    once; events without job, number or time are left out; a job that was never queued refuses all. A task takes its jobs in turn
    and holds one job's state and a batch of events.
    """
    known = _known(events).select(*(F.col(c).cast("long") for c in ("job_id", "doc_id", "event_id", "at_ms")), "kind", "worker")
    return known.repartition("job_id").sortWithinPartitions("job_id", "event_id").mapInArrow(_in_turn, CHANGES)


def job_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """`history` as a stream. State is one row a job; a timer marks a claim stale when the watermark, `late` behind the newest
    event, passes its time, if no event did before. Events of a job have to come in order of event_id: what comes behind a later
    one is a replay, so a batch that is sent again changes nothing."""

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = Job(*state.get) if state.exists else None
        if state.hasTimedOut:
            ripe = ripened(job, state.getCurrentWatermarkMs())
            rows = [_row(int(key[0]), ripe, None, job.claimed_ms + STALE_MS, job.worker, "stale")] if ripe is not job else []
            job = ripe
        else:
            job, rows = advanced(int(key[0]), job, pd.concat(list(batches)))
        if job is not None:
            state.update(tuple(job))
            if job.status == "running":
                state.setTimeoutTimestamp(max(job.claimed_ms + STALE_MS, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield _frame(rows)

    timed = _known(events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late))
    return timed.groupBy("job_id").applyInPandasWithState(one, CHANGES, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def progress(changes: DataFrame) -> DataFrame:
    """Jobs of each document by where they stand, recounted from all changes rather than added up, so that repeated rows and
    batches change nothing. A job that was never queued is not counted."""
    last = changes.groupBy("job_id").agg(F.max_by(F.struct("doc_id", "status", "retries"), "seq").alias("x")).select("job_id", "x.*").filter("status is not null")
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return last.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_jobs"), n("done").alias("n_done"), n("poisoned").alias("n_poisoned"), n("cancelled").alias("n_cancelled"),
        n("running", "stale").alias("n_running"), n("queued", "retrying").alias("n_waiting"), F.sum("retries").alias("n_retries"))
