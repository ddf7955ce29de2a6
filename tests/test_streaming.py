"""The monitor's streams give what a batch over the same events gives."""

from pyspark.sql import functions as F

from gridloom.operators.tasks import latest_status, status_counts
from gridloom.shared import fresh_path
from gridloom.streaming import monitor


def _events(spark):
    states = F.array(*[F.lit(s) for s in ("STARTED", "RUNNING", "COMPLETED", "FAILED", "ODD")])
    return spark.range(3000).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 37)).alias("task"),
        (F.col("id") * 613 % 1009).alias("t"),
        F.element_at(states, (F.col("id") % 5 + 1).cast("int")).alias("status"),
    )


def _stored(spark, files=6):
    path = fresh_path(spark, "test-events")
    _events(spark).repartition(files).write.parquet(path)
    return path


def test_latest_state_equals_batch(spark):
    stream = monitor.event_stream(spark, _stored(spark), files_per_poll=2)
    folded = monitor.stream_latest_state(stream, "task", ["t", "event_id"])
    batch = latest_status(_events(spark), "task", ["t", "event_id"])
    assert folded.count() == 38
    assert folded.select(*batch.columns).exceptAll(batch).count() == 0


def test_counts_of_every_poll_and_the_last(spark):
    polls = monitor.stream_status_counts(monitor.event_stream(spark, _stored(spark), files_per_poll=2))
    per_poll = [r.n for r in polls.groupBy("batch").agg(F.sum("n").alias("n")).orderBy("batch").collect()]
    assert len(per_poll) == 3 and per_poll == sorted(per_poll) and per_poll[-1] == 3000
    batch = status_counts(_events(spark))
    assert monitor.last_counts(polls).select(*batch.columns).exceptAll(batch).count() == 0


def test_second_drain_reads_only_new_files(spark):
    path, folder = fresh_path(spark, "test-events"), fresh_path(spark, "test-monitor")
    early, late = _events(spark).where("t < 800"), _events(spark).where("t >= 800 AND task <> 'hot'")

    def drain():
        stream = monitor.event_stream(spark, path)
        return monitor.stream_latest_state(stream, "task", ["t", "event_id"], f"{folder}/state")

    early.coalesce(1).write.parquet(path)
    drain()
    late.coalesce(1).write.mode("append").parquet(path)
    folded = drain()
    batch = latest_status(early.unionByName(late), "task", ["t", "event_id"])
    assert folded.count() == batch.count() and folded.select(*batch.columns).exceptAll(batch).count() == 0
    polls = spark.read.parquet(f"{folder}/state/polls")
    assert sorted(r.batch for r in polls.select("batch").distinct().collect()) == [0, 1]
    # The second poll read what was open after the first, and its own events.
    tasks = lambda df: {r.task for r in df.select("task").distinct().collect()}
    assert tasks(polls.where("batch = 1")) == tasks(late) | tasks(polls.where("batch = 0 AND NOT finished"))


def test_state_falls_with_completion_and_files_are_bounded_by_tasks(spark):
    path, folder = fresh_path(spark, "test-events"), fresh_path(spark, "test-monitor")
    schema = "event_id long, task string, t long, status string"
    open_rows, events, n = [], [], 0
    for poll in range(10):
        # Every poll starts two tasks and completes those of two polls before; one task reports in all of them.
        new = [(f"t{poll}{c}", "STARTED") for c in "ab"] + [(f"t{poll - 2}{c}", "COMPLETED" if c == "a" else "FAILED") for c in "ab" if poll > 1] + [("busy", "RUNNING")]
        rows = [(n + k, task, poll, status) for k, (task, status) in enumerate(new)]
        n, events = n + len(rows), events + rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        folded = monitor.stream_latest_state(monitor.event_stream(spark, path), "task", ["t", "event_id"], folder)
        batch = latest_status(spark.createDataFrame(events, schema), "task", ["t", "event_id"])
        assert folded.exceptAll(batch).count() == 0 and folded.count() == batch.count()
        polls = spark.read.parquet(f"{folder}/polls")
        last = polls.agg(F.max("batch")).first()[0]
        open_rows.append(polls.where(f"batch = {last} AND NOT finished").count())
        assert polls.where("NOT finished").select("batch").distinct().count() <= 2
        assert polls.count() <= 2 * batch.count() + 10 and len(polls.inputFiles()) <= batch.count() + 10
    assert open_rows == [3, 5, 5, 5, 5, 5, 5, 5, 5, 5]
    # A drain without news changes nothing, and a late event of a finished task does not bring it back.
    spark.createDataFrame([(n, "t0a", -1, "RUNNING")], schema).coalesce(1).write.mode("append").parquet(path)
    folded = monitor.stream_latest_state(monitor.event_stream(spark, path), "task", ["t", "event_id"], folder)
    assert folded.where("task = 't0a'").first().status == "COMPLETED" and folded.count() == 21
    assert monitor.stream_latest_state(monitor.event_stream(spark, path), "task", ["t", "event_id"], folder).exceptAll(folded).isEmpty()


def test_work_tables_can_be_cleared(spark, monkeypatch, tmp_path):
    from gridloom import shared

    monkeypatch.setattr(shared, "work_folder", lambda session: str(tmp_path / "app"))
    shared.materialise(spark.range(3).toDF("id"), "table")
    assert (tmp_path / "app").exists()
    shared.clear_work_tables(spark)
    shared.clear_work_tables(spark)
    assert not (tmp_path / "app").exists()


def test_counts_go_on_and_a_drain_without_news_adds_nothing(spark):
    path, folder = _stored(spark), fresh_path(spark, "test-monitor")
    first, second = [
        monitor.stream_status_counts(monitor.event_stream(spark, path), folder=folder).groupBy("batch").agg(F.sum("n")).collect()
        for _ in range(2)
    ]
    assert first == second and [tuple(r) for r in first] == [(0, 3000)]


def test_drain_report(spark):
    latest = spark.createDataFrame([("a", "COMPLETED"), ("b", "FAILED")], "task STRING, status STRING")
    assert tuple(monitor.drain_report(latest).first()) == (2, 0, True)
    more = latest.unionByName(spark.createDataFrame([("c", "STARTED")], "task STRING, status STRING"))
    assert tuple(monitor.drain_report(more).first()) == (3, 1, False)
