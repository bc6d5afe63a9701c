"""Structured Streaming over progress events: live percent, stalls, jobs, counts, breakers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import TERMINAL, occurrences_of
from ..operators.timeline import DELIVERED, IMMEDIATE, TRANSPORT

STALL_SEC = 90.0
STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JOB_ID = r"^[a-z0-9][a-z0-9_-]{0,127}\z"


def _micros(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events without those delivered again, by job and sequence, within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "sequence"])


def windowed_counts(warnings: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Occurrences of each stage and code in tumbling windows; rows later than the watermark are dropped."""
    counted = warnings.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "stage", "code").agg(F.sum(occurrences_of(F.col("occurrences"))).alias("occurrences"))
    return counted.select(F.col("w.start").alias("window_start"), "stage", "code", "occurrences")


class Remembering(StatefulProcessor):
    """State of one key that ends: a timer forgets it when the watermark passes its last event by the idle time.

    ``alive`` holds the time of the last event and of the timer that waits for it, so a key
    has one such timer however many batches it is in.
    """

    idle_ms: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alive = handle.getValueState("alive", "ms long, timer long")

    def heard(self, ms: int, timerValues, wait: int | None = None) -> None:  # noqa: N803
        """Moves the timer to ``wait`` (the idle time) after the latest event."""
        last, timer = self.alive.get() if self.alive.exists() else (ms, None)
        last = max(last, ms)
        at = max(last + (self.idle_ms if wait is None else wait), timerValues.getCurrentWatermarkInMs() + 1)
        if timer != at:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
        self.alive.update((last, at))

    def close(self) -> None:
        pass


class OverallProgress(Remembering):
    """Last sequence of a job (a value) and each mechanism's percent and end (a map)."""

    def __init__(self, weights: dict[str, float], idle_sec: float, digits: int = 3):
        self.weights, self.idle_ms, self.digits = weights, int(idle_sec * 1000), digits

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "sequence long")
        self.mechanisms = handle.getMapState("mechanisms", "mechanism string", "percent double, ended boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        for r in initialState.itertuples():
            before = self.last.get()[0] if self.last.exists() else -1
            self.last.update((max(before, int(r.sequence)),))
            if r.mechanism in self.weights:
                self.mechanisms.updateValue((r.mechanism,), (float(r.percent), bool(r.ended)))
            self.heard(int(r.ms), timerValues)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else -1
        known = {k[0]: tuple(v) for k, v in self.mechanisms.iterator()} if self.mechanisms.exists() else {}
        changed = set()
        events = pd.concat(list(rows)).sort_values("sequence")
        for n, mechanism, status, percent in zip(events["sequence"], events["mechanism"], events["status"], events["percent"], strict=True):
            if n <= last:
                continue
            last = int(n)
            if mechanism in self.weights:
                ended = status in TERMINAL
                known[mechanism] = (100.0 if ended else 0.0 if pd.isna(percent) else round(min(100.0, max(0.0, float(percent))), 3), ended)
                changed.add(mechanism)
        for m in changed:
            self.mechanisms.updateValue((m,), known[m])
        self.last.update((last,))
        self.heard(int(events["ms"].max()), timerValues)
        overall = 100.0
        if not all(known.get(m, (0.0, False))[1] for m in self.weights):
            overall = round(sum(known.get(m, (0.0, False))[0] * w for m, w in self.weights.items()) / sum(self.weights.values()), self.digits)
        yield pd.DataFrame({"job_id": [key[0]], "sequence": [last], "overall_percent": [overall]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.alive, self.last, self.mechanisms):
            state.clear()
        return iter(())


def live_progress(events: DataFrame, weights: dict[str, float], idle_sec: float = 3600.0, delay: str = "10 minutes", snapshot: DataFrame | None = None, digits: int = 3) -> DataFrame:
    """The overall percent of each job after each batch; events at or before the last sequence seen are ignored.

    The percent has ``digits`` places; who rounds it again to fewer asks for many, since a
    number that is rounded at three places and then at one can end higher than it should.

    State of one job: the last sequence and its mechanisms' percents.  It is kept until
    the watermark passes the job's last event by ``idle_sec``, also after the end, so an
    event that is delivered again starts nothing anew.  A new stream continues from a
    ``snapshot`` (``job_id``, ``mechanism``, ``sequence``, ``percent``, ``ended``, ``ts``;
    see :func:`progress_snapshot`).  Needs the RocksDB state store, as :func:`drained` sets.
    """
    timed = events.where("ts is not null").withWatermark("ts", delay).select("job_id", "sequence", "mechanism", "status", F.col("percent").cast("double").alias("percent"), F.unix_millis("ts").alias("ms"), "ts")
    start = None if snapshot is None else snapshot.select("job_id", "mechanism", "sequence", "percent", "ended", F.unix_millis("ts").alias("ms")).groupBy("job_id")
    return timed.groupBy("job_id").transformWithStateInPandas(OverallProgress(weights, idle_sec, digits), "job_id string, sequence long, overall_percent double", "update", "eventTime", initialState=start)


def progress_snapshot(events: DataFrame) -> DataFrame:
    """What :func:`live_progress` knows of each job and mechanism after a table of events: a start for a new stream."""
    percent = F.when(F.col("status").isin(TERMINAL), 100.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.col("percent").cast("double"), F.lit(0.0)))), 3))
    latest = events.where("ts is not null").groupBy("job_id", "mechanism").agg(F.max_by(F.struct(percent.alias("percent"), F.coalesce(F.col("status").isin(TERMINAL), F.lit(False)).alias("ended")), "sequence").alias("x"), F.max("sequence").alias("sequence"), F.max("ts").alias("ts"))
    return latest.select("job_id", "mechanism", "sequence", "x.percent", "x.ended", "ts")


def advances(events: DataFrame) -> DataFrame:
    """Events that say something new of their mechanism: another status or percent than the event before."""
    own = Window.partitionBy("job_id", "mechanism").orderBy("ts", "sequence")
    before = F.lag(F.struct("status", "percent")).over(own)
    return events.withColumn("__before", before).where(F.col("__before").isNull() | ~F.struct("status", "percent").eqNullSafe(F.col("__before"))).drop("__before")


def stalls(events: DataFrame, stall_sec: float = STALL_SEC) -> DataFrame:
    """Batch form: times of ``stall_sec`` or more without an advance of a job before its next one, unless it had ended.

    An event that repeats its mechanism's state is no advance.
    """
    own = Window.partitionBy("job_id").orderBy("ts", "sequence")
    rows = advances(events).withColumn("next_ts", F.lead("ts").over(own)).withColumn("stalled_sec", (_micros("next_ts") - _micros("ts")) / 1e6)
    return rows.where((F.col("stalled_sec") >= stall_sec) & ~F.coalesce(F.col("status").isin(TERMINAL), F.lit(False))).select("job_id", "sequence", F.lit("E_STUCK").alias("code"), "stalled_sec")


STALLS = "job_id string, sequence long, code string, stalled_sec double, open boolean"


class StallWatch(StatefulProcessor):
    """Events of one job in event-time order, whatever the order of arrival, and its clock.

    State: the events that the watermark has not passed yet (a list, an entry for all that
    arrived together, since each entry is converted and sent by itself), the last word of
    each mechanism (a map), and the clock (time and sequence of the last advance, whether
    the job has ended, whether its stall has been told).  A call reads the map once and
    writes what changed.  Timers wake it when the watermark passes its next event, the end
    of its patience, or its idle time.
    """

    def __init__(self, stall_sec: float, idle_sec: float):
        self.stall, self.idle = int(stall_sec * 1_000_000), int(idle_sec * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us array<long>, sequence array<long>, mechanism array<string>, status array<string>, percent array<double>")
        self.marks = handle.getMapState("marks", "mechanism string", "status string, percent double")
        self.clock = handle.getValueState("clock", "us long, sequence long, ended boolean, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, new = None, []
        for part in rows:
            us = part["us"].astype("int64").tolist()
            percent = [None if p != p else p for p in part["percent"].astype("float64").tolist()]
            new.append((us, part["sequence"].astype("int64").tolist(), part["mechanism"].tolist(), part["status"].tolist(), percent))
            first = min(us) if first is None else min(first, min(us))
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        due, left = [], []
        for together in self.waiting.get():
            for r in zip(*together, strict=True):
                (due if r[0] <= mark else left).append(r)
        due.sort(key=lambda r: (r[0], r[1]))
        if due:
            self.waiting.put([tuple(list(c) for c in zip(*left, strict=True))]) if left else self.waiting.clear()
        clock = self.clock.get()
        at, sequence, ended, told = clock or (None, None, True, True)
        marks = {k[0]: tuple(v) for k, v in self.marks.iterator()} if due and clock else {}
        out, changed = [], set()
        for us, n, mechanism, status, percent in due:
            said = (status, percent)
            if marks.get(mechanism) == said:
                continue
            marks[mechanism] = said
            changed.add(mechanism)
            if not ended and us - at >= self.stall:
                out.append((sequence, (us - at) / 1e6, False))
            at, sequence, ended, told = us, n, status in TERMINAL, False
        if at is not None and not ended and not told and mark - at >= self.stall:
            out.append((sequence, (mark - at) / 1e6, True))
            told = True
        if at is not None and mark - at >= self.idle and not left:
            if clock:
                self.marks.clear()
                self.clock.clear()
        elif at is not None:
            for m in changed:
                self.marks.updateValue((m,), marks[m])
            self.clock.update((at, sequence, ended, told))
            # Patience of a running job, then of one that is not heard of again.
            wait = self.stall if not ended and not told else self.idle
            self.handle.registerTimer(max((at + wait) // 1000 + 1, mark // 1000 + 1))
        if left:
            self.handle.registerTimer(min(r[0] for r in left) // 1000 + 1)
        if out:
            yield pd.DataFrame({"job_id": [key[0]] * len(out), "sequence": [int(n) for n, *_ in out], "code": ["E_STUCK"] * len(out), "stalled_sec": [float(t) for _, t, _ in out], "open": [o for *_, o in out]})

    def close(self) -> None:
        pass


def stream_stalls(events: DataFrame, stall_sec: float = STALL_SEC, delay: str = "1 minute", idle_sec: float | None = None) -> DataFrame:
    """Streaming form of :func:`stalls`: rows that are not ``open`` are those of the batch form, for events that the watermark has passed.

    An ``open`` row comes before that, once, when the watermark shows a silence of
    ``stall_sec`` after an advance, with the time so far.  Events are judged in the order
    of ``ts`` and ``sequence`` whatever the order of arrival; later ones than the watermark
    allows are dropped, and those without a time are not judged.  Only the latest event's
    end stops a job's clock; a job that goes on afterwards is watched again.  A job is
    forgotten when the watermark passes its last advance by ``idle_sec`` (by default ten
    times ``stall_sec``), so a stall beyond that has its open row only.  The session's
    state store must be RocksDB (see :func:`drained`); its time zone does not matter.
    """
    timed = events.where("ts is not null").withWatermark("ts", delay).select("job_id", "sequence", "mechanism", "status", F.col("percent").cast("double").alias("percent"), F.unix_micros("ts").alias("us"), "ts")
    watch = StallWatch(stall_sec, 10 * stall_sec if idle_sec is None else idle_sec)
    return timed.groupBy("job_id").transformWithStateInPandas(watch, STALLS, "append", "eventTime")


class JobWatch(Remembering):
    """The latest record of a job and the status that was shown last."""

    def __init__(self, stall_sec: float):
        self.stall_ms = int(stall_sec * 1000)
        self.idle_ms = 10 * self.stall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.job = handle.getValueState("job", "ms long, seq long, shown string")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        for r in initialState.itertuples():
            self.job.update((int(r.ms), int(r.seq), r.status))
            self.heard(int(r.ms), timerValues, self.stall_ms if r.status == "running" else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms, seq, shown = self.job.get() if self.job.exists() else (-1, -1, "")
        records = pd.concat(list(rows)).sort_values(["ms", "seq"])
        last = records.iloc[-1]
        if (int(last["ms"]), int(last["seq"])) > (ms, seq):
            ms, seq, status = int(last["ms"]), int(last["seq"]), last["status"]
            self.job.update((ms, seq, status))
            self.heard(ms, timerValues, self.stall_ms if status == "running" else None)
            if status != shown:
                yield self._row(key, status, ms, seq)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms, seq, shown = self.job.get()
        if shown != "running":
            self.job.clear()
            self.alive.clear()
            return
        self.job.update((ms, seq, "abandoned"))
        self.alive.clear()
        self.heard(ms, timerValues)
        yield self._row(key, "abandoned", ms, seq)

    @staticmethod
    def _row(key, status: str, ms: int, seq: int) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "status": [status], "updated_ms": [ms], "seq": [seq]})


def stream_job_status(events: DataFrame, stall_sec: float = STALL_SEC, delay: str = "1 minute", snapshot: DataFrame | None = None) -> DataFrame:
    """Streaming form of :func:`job_status`: a row whenever a job's status changes, in the order of ``updated_at`` and ``seq``.

    A running job is abandoned once the watermark passes its last record by ``stall_sec``;
    a later record takes that back.  Records that come late do not count.  A job's state
    goes when it has been silent ten times as long.  Ids outside the domain are left out.
    A new stream continues from a ``snapshot`` of statuses (``job_id``, ``status``,
    ``updated_at``, ``seq``).  Needs the RocksDB state store, as :func:`drained` sets.
    """
    good = events.where(F.col("job_id").rlike(JOB_ID) & F.col("updated_at").isNotNull()).withWatermark("updated_at", delay)
    rows = lambda df: df.select("job_id", "status", F.unix_millis("updated_at").alias("ms"), F.col("seq").cast("long").alias("seq"), *(["updated_at"] if df is good else []))
    start = None if snapshot is None else rows(snapshot).groupBy("job_id")
    return rows(good).groupBy("job_id").transformWithStateInPandas(JobWatch(stall_sec), "job_id string, status string, updated_ms long, seq long", "append", "eventTime", initialState=start)


def job_status(events: DataFrame, now: str | None = None, stall_sec: float = STALL_SEC) -> DataFrame:
    """The latest record of each job: a completed one has a result only, a failed one an error only; a silent running one is abandoned.

    ``now`` defaults to the latest time of the table.  Ids outside the domain are left out
    (see :func:`bad_job_ids`).
    """
    good = events.where(F.col("job_id").rlike(JOB_ID))
    last = good.groupBy("job_id").agg(F.max_by(F.struct("status", "updated_at", "result", "error"), F.struct("updated_at", "seq")).alias("r")).select("job_id", "r.*")
    at = F.lit(now).cast("timestamp") if now else None
    if at is None:
        last = last.join(F.broadcast(good.agg(F.max("updated_at").alias("__now"))))
        at = F.col("__now")
    silent = (F.col("status") == "running") & (at.cast("double") - F.col("updated_at").cast("double") > stall_sec)
    return last.select("job_id", F.when(silent, "abandoned").otherwise(F.col("status")).alias("status"), "updated_at", F.when(F.col("status") == "completed", F.col("result")).alias("result"), F.when(F.col("status") == "failed", F.col("error")).alias("error"))


def bad_job_ids(events: DataFrame) -> DataFrame:
    return events.where(~F.coalesce(F.col("job_id").rlike(JOB_ID), F.lit(False)))


class Breaker(Remembering):
    """Last attempt, failures in a row and whether the breaker is open, of one run."""

    def __init__(self, limit: int, idle_sec: float):
        self.limit, self.idle_ms = limit, int(idle_sec * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.run = handle.getValueState("run", "attempt long, failures int, opened boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        for r in initialState.itertuples():
            self.run.update((int(r.attempt), int(r.failures), bool(r.opened)))
            self.heard(int(r.ms), timerValues)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, failures, opened = self.run.get() if self.run.exists() else (-1, 0, False)
        out = []
        attempts = pd.concat(list(rows)).sort_values("attempt")
        for n, code in zip(attempts["attempt"], attempts["code"], strict=True):
            if n <= last:
                continue
            last = int(n)
            if opened:
                continue
            code = None if pd.isna(code) else code
            failures += code in TRANSPORT
            if code in IMMEDIATE or (code in TRANSPORT and failures >= self.limit):
                opened = True
                out.append((key[0], last, "open", code))
            elif (code is None or code in DELIVERED) and failures:
                failures = 0
                out.append((key[0], last, "closed", code))
        self.run.update((last, int(failures), bool(opened)))
        self.heard(int(attempts["ms"].max()), timerValues)
        yield pd.DataFrame(out, columns=["run_id", "attempt", "state", "code"]).astype({"attempt": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.run.clear()
        self.alive.clear()
        return iter(())


def stream_breaker(attempts: DataFrame, limit: int = 3, time: str | None = None, idle_sec: float = 86_400.0, delay: str = "10 minutes", snapshot: DataFrame | None = None) -> DataFrame:
    """Transitions of each run's breaker: ``open`` once, and ``closed`` whenever a success clears failures before that.

    Attempts at or before the last one seen are ignored.  With a ``time`` column a run's
    state goes when the watermark passes its last attempt by ``idle_sec``; without one the
    time of arrival counts, so it goes with the first batch that comes that much later.  A new stream continues from
    a ``snapshot`` (``run_id``, ``attempt``, ``failures``, ``opened`` and the ``time``
    column).  Needs the RocksDB state store, as :func:`drained` sets.
    """
    if time is None:
        time = "__arrived"
        attempts = attempts.withColumn(time, F.current_timestamp())
        snapshot = None if snapshot is None else snapshot.withColumn(time, F.current_timestamp())
    rows = attempts.where(F.col(time).isNotNull()).withWatermark(time, delay).select("run_id", F.col("attempt").cast("long").alias("attempt"), "code", F.unix_millis(time).alias("ms"), time)
    start = None if snapshot is None else snapshot.select("run_id", F.col("attempt").cast("long").alias("attempt"), "failures", "opened", F.unix_millis(time).alias("ms")).groupBy("run_id")
    return rows.groupBy("run_id").transformWithStateInPandas(Breaker(limit, idle_sec), "run_id string, attempt long, state string, code string", "append", "eventTime", initialState=start)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, or a local one where the session runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tapeloom-stream-')}"
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """All rows that a stream gives for the input at hand, as a table with the number of their ``batch``.

    Each batch is written to a folder of its own, so one that is run again replaces itself.
    State is kept in RocksDB, which typed state needs.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    keep = lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/rows/batch={i}")
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{folder}/rows")
