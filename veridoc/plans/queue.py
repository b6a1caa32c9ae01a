"""Queries of the job queue's log: what each event did, and progress by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read
from ..streaming import queue
from ..streaming.queue import PAUSE_MS, RETRIES, STALE_MS

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_KIND = """CASE WHEN event_id % 24 = 0 THEN 'enqueue' WHEN event_id % 24 = 1 THEN 'claim' WHEN user_id % 29 = 0 THEN 'cancel' WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN 'done'
 WHEN event_type IN ('error', 'purchase') THEN 'fail' WHEN event_type = 'view' AND user_id % 5 = 0 THEN 'touch' WHEN user_id % 31 = 0 THEN 'enqueue' ELSE 'claim' END"""
_WORKER = "CASE WHEN event_id % 41 = 0 THEN NULL WHEN user_id % 7 < 6 THEN 'w1' ELSE 'w2' END"

_LOG = f"""ev AS (SELECT CAST(floor(event_id / 24) AS BIGINT) AS job_id, CAST(floor(event_id / 240) AS BIGINT) AS doc_id, event_id, epoch_us(ts) // 1000 + (event_id % 24) * 240000 AS at_ms, {_KIND} AS kind, {_WORKER} AS worker FROM events),
nr AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY event_id) AS rn FROM ev)"""
_STALE = f"(p.status = 'running' AND e.at_ms >= p.claimed_ms + {STALE_MS})"
_HELD = "(p.status IN ('running', 'stale') AND coalesce(e.worker = p.worker, FALSE))"
_NOW = f"CASE WHEN {_STALE} THEN 'stale' ELSE p.status END"
_CHANGE = f"""CASE WHEN e.kind = 'enqueue' AND p.status IS NULL THEN 'queued'
 WHEN e.kind = 'claim' AND e.worker IS NOT NULL AND (p.status = 'queued' OR (p.status = 'retrying' AND e.at_ms >= p.next_ms) OR ({_NOW} = 'stale' AND {_HELD})) THEN 'claimed'
 WHEN e.kind = 'claim' AND e.worker IS NOT NULL AND {_NOW} = 'stale' THEN 'taken over' WHEN e.kind = 'touch' AND {_HELD} THEN 'touched' WHEN e.kind = 'done' AND {_HELD} THEN 'done'
 WHEN e.kind = 'fail' AND {_HELD} AND p.retries < {RETRIES} THEN 'retrying' WHEN e.kind = 'fail' AND {_HELD} THEN 'poisoned' WHEN e.kind = 'cancel' AND p.status IN ('queued', 'retrying') THEN 'cancelled' ELSE 'refused' END"""
_HISTORY = f"""{_LOG}, st AS (SELECT job_id, 0::BIGINT AS rn, NULL::VARCHAR AS status, 0 AS retries, NULL::BIGINT AS next_ms, NULL::VARCHAR AS worker, NULL::BIGINT AS claimed_ms, 0::BIGINT AS seq, NULL::VARCHAR AS change, FALSE AS went, NULL::BIGINT AS event_id, NULL::BIGINT AS at_ms, NULL::VARCHAR AS by_worker, NULL::BIGINT AS doc_id, NULL::BIGINT AS was_ms, NULL::VARCHAR AS was_worker FROM (SELECT DISTINCT job_id FROM nr)
 UNION ALL SELECT job_id, rn, CASE change WHEN 'refused' THEN now WHEN 'claimed' THEN 'running' WHEN 'taken over' THEN 'running' WHEN 'touched' THEN 'running' ELSE change END, retries + (change = 'retrying')::INT,
  CASE WHEN change = 'retrying' THEN at_ms + {PAUSE_MS} * (1 << retries) WHEN change IN ('claimed', 'cancelled') THEN NULL ELSE next_ms END, CASE WHEN change IN ('claimed', 'taken over') THEN by_worker WHEN change IN ('done', 'retrying', 'poisoned') THEN NULL ELSE worker END,
  CASE WHEN change IN ('claimed', 'taken over', 'touched') THEN at_ms WHEN change IN ('done', 'retrying', 'poisoned') THEN NULL ELSE claimed_ms END, seq + 1 + went::INT, change, went, event_id, at_ms, by_worker, doc_id, claimed_ms, worker
 FROM (SELECT e.job_id, e.rn, p.status, p.retries, p.next_ms, p.worker, p.claimed_ms, p.seq, {_CHANGE} AS change, coalesce({_STALE}, FALSE) AS went, {_NOW} AS now, e.event_id, e.at_ms, e.worker AS by_worker, e.doc_id FROM st p JOIN nr e ON e.job_id = p.job_id AND e.rn = p.rn + 1)),
hist AS (SELECT job_id, doc_id, seq, event_id, at_ms, by_worker AS worker, change, status, retries, next_ms FROM st WHERE rn > 0
 UNION ALL SELECT s.job_id, s.doc_id, s.seq - 1, NULL, s.was_ms + {STALE_MS}, s.was_worker, 'stale', 'stale', b.retries, b.next_ms FROM st s JOIN st b ON b.job_id = s.job_id AND b.rn = s.rn - 1 WHERE s.went)"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs of 24 consecutive events of the log, ten jobs a document, four minutes and more between two events of a job."""
    at = "timestamp_millis(unix_millis(CAST(ts AS timestamp)) + (event_id % 24) * 240000) AS at"
    return read(spark, sf, "events").selectExpr("CAST(floor(event_id / 24) AS bigint) AS job_id", "CAST(floor(event_id / 240) AS bigint) AS doc_id", "event_id", at, f"{_KIND} AS kind", f"{_WORKER} AS worker")


@query(f"WITH RECURSIVE {_HISTORY} SELECT * FROM hist")
def queue_history(spark, sf):
    """What each event of the log did to its job: claims, retries, poison, stale claims and who took them over."""
    return queue.history(_events(spark, sf))


@query(f"""WITH RECURSIVE {_HISTORY}, l AS (SELECT job_id, arg_max(doc_id, seq) AS doc_id, arg_max(status, seq) AS status, arg_max(retries, seq) AS retries FROM hist WHERE status IS NOT NULL GROUP BY job_id)
SELECT doc_id, count(*) AS n_jobs, count(*) FILTER (WHERE status = 'done') AS n_done, count(*) FILTER (WHERE status = 'poisoned') AS n_poisoned, count(*) FILTER (WHERE status = 'cancelled') AS n_cancelled, count(*) FILTER (WHERE status IN ('running', 'stale')) AS n_running,
 count(*) FILTER (WHERE status IN ('queued', 'retrying')) AS n_waiting, sum(retries) AS n_retries FROM l GROUP BY doc_id""")
def queue_progress(spark, sf):
    """Progress of each document's jobs, recounted from the log."""
    return queue.progress(queue.history(_events(spark, sf)))
