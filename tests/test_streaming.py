import pytest
from pyspark.sql import functions as F

from tapeloom.plans import bindings
from tapeloom.streaming import progress


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs a job over parquet parts, one a batch, and returns all rows it gave."""
    def run(parts, job, mode):
        folder = tmp_path / "in"
        for i, p in enumerate(parts):
            p.coalesce(1).write.mode("append").parquet(str(folder))
            del i
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        source = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        out = str(tmp_path / "out")
        q = job(source).writeStream.outputMode(mode).foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert q.exception() is None
        return spark.read.parquet(out).collect()

    return run


def events(spark, rows):
    return spark.createDataFrame(rows, "job_id string, sequence long, mechanism string, status string, percent double, at string").withColumn("ts", F.col("at").cast("timestamp")).drop("at")


def test_live_progress(spark, streamed):
    a = events(spark, [("j", 1, "m1", "running", 50.0, "2024-01-01 00:00:00"), ("j", 2, "m2", "running", 20.0, "2024-01-01 00:00:01")])
    b = events(spark, [("j", 1, "m1", "running", 10.0, "2024-01-01 00:00:00"), ("j", 3, "m1", "completed", None, "2024-01-01 00:00:03")])
    c = events(spark, [("j", 4, "m2", "failed", None, "2024-01-01 00:00:04")])
    d = events(spark, [("j", 3, "m1", "running", 5.0, "2024-01-01 00:00:03")])
    got = streamed([a, b, c, d], lambda s: progress.live_progress(s, {"m1": 1.0, "m2": 3.0}), "update")
    # The last event is delivered again after the end: nothing starts anew.
    assert sorted((r.batch, r.sequence, r.overall_percent) for r in got) == [(0, 2, 27.5), (1, 3, 40.0), (2, 4, 100.0), (3, 4, 100.0)]


def test_streamed_progress_is_rounded_once(spark, tmp_path):
    """0.746 / 15 is 0.0497: at three places 0.05, and that would make 0.1 at one."""
    import duckdb

    from tapeloom.plans.queries import QUERIES, SQL

    con = duckdb.connect()
    con.sql("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    con.sql("insert into events values (0, '2024-01-01 00:00:00', 1, 'click', 0.2486, '{}'), (6, '2024-01-01 00:00:01', 2, 'click', 12.5, '{}')")
    con.sql(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = sorted(tuple(r) for r in QUERIES["streamed_progress"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(SQL["streamed_progress"]).fetchall()) == [("job-1", 0, 0.0), ("job-2", 6, 5.0)]


def test_stalls_of_quiet_ended_and_resumed_jobs(spark, streamed):
    run = lambda job, n, at, p=1.0, status="running", m="m": (job, n, m, status, p, f"2024-01-01 {at}")
    a = events(spark, [run("quiet", 1, "00:00:00"), run("ended", 1, "00:00:00", status="completed"), run("same", 1, "00:00:00"), run("same", 2, "00:01:00"), run("half", 1, "00:00:00", m="x", status="completed"), run("half", 2, "00:00:01")])
    b = events(spark, [run("gap", 1, "00:00:30"), run("gap", 2, "00:03:00", 2.0), run("other", 1, "01:00:00")])
    c = events(spark, [run("other", 2, "01:00:10", 2.0), run("quiet", 2, "01:00:11", 2.0)])
    got = streamed([a, b, c], progress.stream_stalls, "append")
    # An event that repeats the state is no advance, and one mechanism's end does not stop the clock of the others.
    assert sorted({(r.job_id, r.sequence) for r in got}) == [("gap", 1), ("gap", 2), ("half", 2), ("quiet", 1), ("same", 1)]
    assert all(r.code == "E_STUCK" and r.stalled_sec >= 90 for r in got)
    assert [r.stalled_sec for r in got if (r.job_id, r.sequence) == ("gap", 1) and not r.open] == [150.0]
    whole = a.unionByName(b).unionByName(c)
    assert sorted((r.job_id, r.sequence) for r in progress.stalls(whole).collect()) == [("gap", 1), ("quiet", 1)]


def test_stalls_call_the_state_a_few_times_whatever_the_events():
    """Each call is a message to the JVM and back; there were two to three for every event."""
    import pandas as pd

    calls = []

    class State:
        def __init__(self):
            self.rows, self.map, self.value = [], {}, None

        def __getattribute__(self, name):
            if not name.startswith("_") and name not in ("rows", "map", "value"):
                calls.append(name)
            return object.__getattribute__(self, name)

        def appendList(self, rows):  # noqa: N802
            self.rows += rows

        def put(self, rows):
            self.rows = list(rows)

        def exists(self):
            return bool(self.rows or self.map or self.value)

        def get(self):
            return iter(self.rows) if self.value is None and self.rows else self.value or ()

        def iterator(self):
            return iter(self.map.items())

        def containsKey(self, k):  # noqa: N802
            return k in self.map

        def getValue(self, k):  # noqa: N802
            return self.map[k]

        def updateValue(self, k, v):  # noqa: N802
            self.map[k] = v

        def update(self, v):
            self.value = v

        def clear(self):
            self.rows, self.map, self.value = [], {}, None

    class Handle:
        def __init__(self):
            self.timers = []

        def getListState(self, *_):  # noqa: N802
            return State()

        getMapState = getValueState = getListState  # noqa: N815

        def registerTimer(self, ms):  # noqa: N802
            self.timers.append(ms)

    class Clock:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

    watch, handle = progress.StallWatch(90.0, 1e6), Handle()
    watch.init(handle)
    n = 1000
    us = [i * 60_000_000 + (i // 100) * 40_000_000 for i in range(n)]
    part = pd.DataFrame({"us": us, "sequence": range(n), "mechanism": [f"m{i % 2}" for i in range(n)], "status": "running", "percent": [float(i) for i in range(n)]})
    # Against the order, in two parts; the last two events are beyond the watermark at first.
    list(watch.handleInputRows(("j",), iter([part[::-1][:400], part[::-1][400:]]), None))
    got = [r for ms in (us[-3] // 1000, us[-1] // 1000) for d in watch.handleExpiredTimer(("j",), Clock(ms), None) for r in d.itertuples()]
    assert [(r.sequence, r.stalled_sec, r.open) for r in got] == [(100 * i - 1, 100.0, False) for i in range(1, 10)]
    assert watch.clock.value == (us[-1], n - 1, False, False) and watch.marks.map == {("m0",): ("running", n - 2.0), ("m1",): ("running", n - 1.0)}
    assert len(calls) < 30


def test_streamed_job_status(spark, streamed):
    def records(rows):
        return spark.createDataFrame(rows, "job_id string, status string, at string, seq long").withColumn("updated_at", F.col("at").cast("timestamp")).drop("at")

    a = records([("a", "running", "2024-01-01 00:00:00", 1), ("b", "running", "2024-01-01 00:00:00", 1), ("Bad id", "running", "2024-01-01 00:00:00", 1)])
    b = records([("a", "completed", "2024-01-01 00:00:05", 2), ("a", "running", "2024-01-01 00:00:01", 3), ("c", "running", "2024-01-01 00:10:00", 1)])
    c = records([("d", "failed", "2024-01-01 00:10:05", 1)])
    d = records([("b", "running", "2024-01-01 00:10:05", 2)])
    got = streamed([a, b, c, d], progress.stream_job_status, "append")
    by = {j: [r.status for r in sorted(got, key=lambda r: (r.batch, r.updated_ms)) if r.job_id == j] for j in ("a", "b", "c", "d", "Bad id")}
    assert by == {"a": ["running", "completed"], "b": ["running", "abandoned", "running"], "c": ["running"], "d": ["failed"], "Bad id": []}


def test_stream_breaker(spark, streamed):
    t = "local_vision_timeout"
    d = spark.createDataFrame([("a", 1, t), ("a", 2, t), ("a", 3, None), ("a", 4, t), ("a", 5, t), ("a", 6, t), ("a", 7, t)], "run_id string, attempt long, code string")
    got = streamed([d], progress.stream_breaker, "append")
    assert sorted((r.attempt, r.state) for r in got) == [(3, "closed"), (6, "open")]


def test_stream_breaker_over_batches_with_times(spark, streamed):
    t = "local_vision_timeout"
    make = lambda rows: spark.createDataFrame(rows, "run_id string, attempt long, code string, at string").withColumn("ts", F.col("at").cast("timestamp"))
    a, b = make([("a", 1, t, "2024-01-01"), ("a", 2, t, "2024-01-01")]), make([("a", 2, t, "2024-01-01"), ("a", 3, None, "2024-01-01"), ("a", 4, "local_vision_auth_rejected", "2024-01-01"), ("a", 5, None, "2024-01-01")])
    got = streamed([a, b], lambda s: progress.stream_breaker(s, time="ts"), "append")
    assert sorted((r.attempt, r.state) for r in got) == [(3, "closed"), (4, "open")]


def test_dedupe_and_windows_equal_the_batch(spark, streamed, sf_dir):
    w = bindings.warnings(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).drop("seq", "message")
    last = w.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp"))
    got = streamed([w, last, last], lambda s: progress.windowed_counts(s, delay="400 days"), "append")
    want = {(r.window_start, r.stage, r.code): r.occurrences for r in progress.windowed_counts(w).collect()}
    assert {(r.window_start, r.stage, r.code): r.occurrences for r in got} == want


def test_duplicates_are_dropped(spark, streamed):
    a = events(spark, [("j", 1, "m", "running", 1.0, "2024-01-01 00:00:00"), ("j", 2, "m", "running", 1.0, "2024-01-01 00:00:01")])
    got = streamed([a, a], progress.deduplicated, "append")
    assert sorted(r.sequence for r in got) == [1, 2]


def test_job_status(spark):
    rows = [("a", "running", "2024-01-01 00:00:00", 1), ("a", "completed", "2024-01-01 00:00:05", 2), ("b", "running", "2024-01-01 00:00:00", 1), ("c", "failed", "2024-01-01 00:09:00", 1), ("Bad id", "running", "2024-01-01 00:00:00", 1)]
    e = spark.createDataFrame(rows, "job_id string, status string, at string, seq long").withColumns({"updated_at": F.col("at").cast("timestamp"), "result": F.lit("r"), "error": F.lit("e")})
    got = {r.job_id: (r.status, r.result, r.error) for r in progress.job_status(e).collect()}
    assert got == {"a": ("completed", "r", None), "b": ("abandoned", None, None), "c": ("failed", None, "e")}
    assert [r.job_id for r in progress.bad_job_ids(e).collect()] == ["Bad id"]


@pytest.mark.parametrize("zone", ["America/New_York"])
def test_streamed_stalls_equal_the_batch_form(spark, streamed, zone):
    """In any session zone, with rows out of order and a batch boundary between every two rows."""
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        rows, n = [], 0
        for i in range(11):
            for job in ("a",):
                n += 1
                # Times go back and forth by up to 50 seconds; every fifth gap is long.
                at = 1_700_000_000 + i * 40 + 300 * (i // 5) + (50 if (i * 7 + n) % 3 == 0 else 0)
                rows.append((job, n, f"m{n % 2}", "completed" if i == 7 else "running", float(i // 2) if i % 4 else None, at))
        make = lambda some: spark.createDataFrame(some, "job_id string, sequence long, mechanism string, status string, percent double, at long").select("*", F.timestamp_seconds("at").alias("ts")).drop("at")
        end = [("z", 1, "m", "running", 0.0, 1_700_003_000), ("z", 2, "m", "running", 1.0, 1_700_003_001)]
        got = streamed([make([r]) for r in [*rows, *end]], lambda s: progress.stream_stalls(s, delay="2 minutes"), "append")
        want = progress.stalls(make(rows)).collect()
        assert len(want) >= 2
        assert sorted((r.job_id, r.sequence, r.stalled_sec) for r in got if not r.open) == sorted((r.job_id, r.sequence, r.stalled_sec) for r in want)
        # Silences that have not ended by the last batch are open; no job is told stuck without reason.
        last = progress.advances(make(rows)).groupBy("job_id").agg(F.max_by("sequence", F.struct("ts", "sequence")).alias("sequence")).collect()
        assert {tuple(r) for r in last} <= {(r.job_id, r.sequence) for r in got if r.open} <= {(r.job_id, r.sequence) for r in want} | {tuple(r) for r in last}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_drained_stalls_equal_the_batch_form_over_the_whole_table(spark, sf_dir):
    from tapeloom.plans import stream_queries

    e = stream_queries.events(spark, sf_dir)
    got = progress.drained(progress.stream_stalls(e, 3600.0, idle_sec=1e9), "append")
    whole = spark.read.parquet(f"{sf_dir}/events.parquet")
    mark = whole.agg(F.max("ts")).first()[0]
    batch = bindings.progress(spark, sf_dir).withColumn("sequence", F.col("seq"))
    later = batch.where(F.col("ts") <= F.lit(mark) - F.expr("INTERVAL 1 MINUTE"))
    key = lambda rows: sorted((r.job_id, r.sequence, round(r.stalled_sec, 3)) for r in rows)
    assert key(got.where("not open").collect()) == key(progress.stalls(later, 3600.0).collect())


def test_streams_continue_from_snapshots(spark, streamed, tmp_path):
    """A new stream that starts from a table says what the old one would have said."""
    rows = [("j", 1, "m1", "running", 50.0, "2024-01-01 00:00:00"), ("j", 2, "m2", "running", 20.0, "2024-01-01 00:00:01"), ("k", 7, "m1", "completed", None, "2024-01-01 00:00:02")]
    later = [("j", 2, "m2", "running", 99.0, "2024-01-01 00:00:01"), ("j", 3, "m1", "completed", None, "2024-01-01 00:00:03"), ("k", 8, "m2", "running", 40.0, "2024-01-01 00:00:04")]
    start = progress.progress_snapshot(events(spark, rows))
    got = streamed([events(spark, later)], lambda s: progress.live_progress(s, {"m1": 1.0, "m2": 3.0}, snapshot=start), "update")
    assert sorted((r.job_id, r.sequence, r.overall_percent) for r in got) == [("j", 3, 40.0), ("k", 8, 55.0)]


def test_breaker_and_status_continue_from_snapshots(spark, streamed):
    t = "local_vision_timeout"
    start = spark.createDataFrame([("a", 2, 2, False), ("b", 5, 3, True)], "run_id string, attempt long, failures int, opened boolean")
    d = spark.createDataFrame([("a", 2, t), ("a", 3, t), ("b", 6, None), ("c", 1, t), ("c", 2, None)], "run_id string, attempt long, code string")
    got = streamed([d], lambda s: progress.stream_breaker(s, snapshot=start), "append")
    assert sorted((r.run_id, r.attempt, r.state) for r in got) == [("a", 3, "open"), ("c", 2, "closed")]


def test_job_status_continues_and_ends_in_any_zone(spark, streamed):
    def records(rows):
        return spark.createDataFrame(rows, "job_id string, status string, ms long, seq long").select("job_id", "status", F.timestamp_millis("ms").alias("updated_at"), "seq")

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        base = 1_700_000_000_000
        start = records([("a", "running", base, 3), ("b", "completed", base, 9)])
        parts = [records([("a", "running", base + 30_000 * i, 3 + i)]) for i in range(1, 6)] + [records([("b", "running", base - 1, 8), ("c", "failed", base + 400_000, 1)]), records([("c", "running", base + 400_001, 2)])]
        got = streamed(parts, lambda s: progress.stream_job_status(s, snapshot=start), "append")
        # A job that says something every 30 seconds is abandoned only when it falls silent.
        assert [(r.job_id, r.status) for r in sorted(got, key=lambda r: (r.batch, r.job_id))] in ([("c", "failed"), ("a", "abandoned"), ("c", "running")], [("c", "failed"), ("c", "running"), ("a", "abandoned")])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
