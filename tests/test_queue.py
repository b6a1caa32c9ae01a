"""The job queue: each rule, a stale claim taken over once, and a stream that replayed batches do not change."""

import datetime

import pytest

from veridoc.streaming import feeds, queue

SCHEMA = "job_id long, doc_id long, event_id long, at timestamp, kind string, worker string"
START = datetime.datetime(2024, 1, 1)


def events(spark, *rows, job=1, doc=7):
    """Rows of (minutes, kind, worker)."""
    made = [(job, doc, n, START + datetime.timedelta(minutes=m), kind, worker) for n, (m, kind, worker) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA)


def changes(spark, *rows):
    return [r["change"] for r in queue.history(events(spark, *rows)).orderBy("seq").collect()]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(0, "enqueue", None), (1, "claim", "a"), (2, "done", "a"), (3, "claim", "b")], ["queued", "claimed", "done", "refused"]),
        ([(0, "claim", "a"), (1, "enqueue", None), (2, "enqueue", None)], ["refused", "queued", "refused"]),
        ([(0, "enqueue", None), (1, "claim", "a"), (2, "claim", "b"), (3, "done", "b"), (4, "done", None)], ["queued", "claimed", "refused", "refused", "refused"]),
        ([(0, "enqueue", None), (1, "claim", None), (2, "cancel", None), (3, "claim", "a")], ["queued", "refused", "cancelled", "refused"]),
        ([(0, "enqueue", None), (1, "claim", "a"), (2, "cancel", None)], ["queued", "claimed", "refused"]),
        ([(0, "enqueue", None), (1, "claim", "a"), (2, "fail", "a"), (2.25, "claim", "b"), (2.5, "claim", "b"), (3, "fail", "b"), (3.9, "claim", "a"), (4, "claim", "a")],
         ["queued", "claimed", "retrying", "refused", "claimed", "retrying", "refused", "claimed"]),
        # stale is told once; of two that claim it one gets it, and the first holder has lost it
        ([(0, "enqueue", None), (1, "claim", "a"), (16, "claim", "b"), (17, "claim", "c"), (18, "done", "a"), (19, "done", "b")], ["queued", "claimed", "stale", "taken over", "refused", "refused", "done"]),
        ([(0, "enqueue", None), (1, "claim", "a"), (15, "touch", "a"), (29, "claim", "b"), (30, "claim", "b")], ["queued", "claimed", "touched", "refused", "stale", "taken over"]),
        ([(0, "enqueue", None), (1, "claim", "a"), (40, "cancel", None), (41, "done", "a")], ["queued", "claimed", "stale", "refused", "done"]),
        ([(0, "enqueue", None), (1, "claim", "a"), (40, "claim", "a"), (41, "other", "a"), (42, None, "a")], ["queued", "claimed", "stale", "claimed", "refused", "refused"]),
    ],
)
def test_what_events_do(spark, rows, want):
    assert changes(spark, *rows) == want


def test_a_job_is_poisoned_after_its_retries(spark):
    rows = [(0, "enqueue", None)] + [x for k in range(4) for x in [(10 * k + 1, "claim", "a"), (10 * k + 2, "fail", "a")]] + [(99, "claim", "a")]
    assert changes(spark, *rows) == ["queued"] + ["claimed", "retrying"] * 3 + ["claimed", "poisoned", "refused"]
    got = queue.progress(queue.history(events(spark, *rows))).collect()
    assert [tuple(r) for r in got] == [(7, 1, 0, 1, 0, 0, 0, 3)]


def test_repeated_and_incomplete_rows(spark):
    one = events(spark, (0, "enqueue", None), (1, "claim", "a"))
    bad = spark.createDataFrame([(None, 1, 1, START, "claim", "a"), (2, 1, None, START, "claim", "a"), (2, 1, 1, None, "claim", "a"), (3, None, 1, START, "claim", None)], SCHEMA)
    got = queue.history(one.union(one).union(bad).withColumn("extra", one["kind"])).orderBy("job_id", "seq").collect()
    assert [(r["job_id"], r["change"]) for r in got] == [(1, "queued"), (1, "claimed"), (3, "refused")]
    assert [tuple(r)[:2] for r in queue.progress(queue.history(one.union(bad))).collect()] == [(7, 1)]  # job 3 was never queued
    assert queue.history(spark.createDataFrame([], SCHEMA)).collect() == []


def streamed(spark, tmp_path, *batches):
    """The changes that the batches give, one trigger each; each may be sent more than once."""
    folder = tmp_path / "in"
    for n, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(str(folder))
        feed = feeds.table_feed(spark, str(folder), SCHEMA)
        feeds.write_batches(queue.job_stream(feed, "1 minute"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).drop("batch")


def test_a_stream_gives_the_tables_rows_and_replays_change_nothing(spark, tmp_path):
    parts = [events(spark, *[(m, *x) for m, x in rows], job=j, doc=j % 2) for j, rows in enumerate([
        [(0, ("enqueue", None)), (1, ("claim", "a")), (2, ("done", "a"))],
        [(0, ("enqueue", None)), (1, ("claim", "a")), (30, ("claim", "b")), (31, ("done", "b"))],
        [(0, ("enqueue", None)), (1, ("claim", "a")), (2, ("fail", "a")), (5, ("claim", "a")), (6, ("fail", "a"))],
    ])]
    every = parts[0].union(parts[1]).union(parts[2])
    first, second = every.filter("event_id < 2"), every.filter("event_id >= 2")
    got = streamed(spark, tmp_path, first, second, first, second)
    want = sorted(map(str, queue.history(every).collect()))
    assert sorted(map(str, got.collect())) == want
    assert sorted(queue.progress(got).collect()) == sorted(queue.progress(queue.history(every)).collect())


def test_a_timer_tells_a_stale_claim_without_an_event_of_its_job(spark, tmp_path):
    held = events(spark, (0, "enqueue", None), (1, "claim", "a"))
    clock = [events(spark, (m, "enqueue", None), job=m) for m in (60, 120)]
    after = spark.createDataFrame([(1, 7, 2, START + datetime.timedelta(minutes=130), "claim", "b"), (1, 7, 3, START + datetime.timedelta(minutes=131), "claim", "c")], SCHEMA)
    got = streamed(spark, tmp_path, held, *clock, after).filter("job_id = 1").orderBy("seq").collect()
    assert [r["change"] for r in got] == ["queued", "claimed", "stale", "taken over", "refused"]
    assert got[2]["at_ms"] == got[1]["at_ms"] + queue.STALE_MS


def test_jobs_are_taken_in_turn_over_batches(spark):
    kinds = ["enqueue", "claim", "touch", "fail", "claim", "claim", "done", "cancel"]
    every = [(j, j % 3, n, START + datetime.timedelta(minutes=5 * n + j % 7), kinds[(n * 5 + j) % 8] if n else "enqueue", [None, "a", "b", "a"][(n + j) % 4]) for j in range(40) for n in range(12)]
    rows = spark.createDataFrame(every, SCHEMA)
    known = rows.selectExpr("job_id", "doc_id", "event_id", "kind", "worker", "unix_millis(at) AS at_ms").toPandas()
    want = sorted(str(r) for j, own in known.groupby("job_id") for r in queue.advanced(int(j), None, own)[1])
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = queue.history(rows.union(rows))
        assert sorted(str(tuple(r)) for r in got.collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()  # no job is a call of its own
