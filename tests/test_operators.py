import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import folds, grounding, inference, store, timeline
from tapeloom.plans import documents
from tapeloom.sources import recordings


def test_schedule_examples():
    assert timeline.schedule([0, 1, 5], 20, 4, 10) == [0, 5, 15]
    assert timeline.schedule([0, 9, 18], 20, 4, 10) == [0, 9, 18]
    assert timeline.schedule([], 10, 4, 4) == [0, 4, 8]
    assert timeline.schedule([], 0, 4, 4) == []
    with pytest.raises(ValueError):
        timeline.schedule([1], 10, 1, 0.0001)
    with pytest.raises(ValueError):
        timeline.schedule([1], 10_000, 1, 0.001)


def test_schedule_sweep():
    rng = random.Random(20260728)
    for _ in range(300):
        duration, window, least = rng.uniform(0.5, 600), rng.uniform(0.5, 60), rng.uniform(0, 30)
        points = [rng.uniform(-5, duration + 5) for _ in range(rng.randrange(0, 30))]
        got = timeline.schedule(points, duration, least, window)
        assert got == sorted(set(got)) and all(0 <= p <= duration for p in got)
        if not points:
            assert all(b - a <= window + 0.0005 for a, b in zip(got, got[1:]))


def test_schedule_operator(spark):
    d = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 1.0), ("a", 5.0, 5.0), ("b", None, None)], "source_id string, start_sec double, end_sec double").withColumns({"duration_sec": F.lit(20.0), "min_interval_sec": F.lit(4.0), "max_static_window_sec": F.when(F.col("source_id") == "a", 10.0).otherwise(0.0)})
    got = [(r.source_id, r.timestamp_sec, r.problem is None) for r in timeline.candidate_schedule(d).orderBy("source_id", "candidate_index").collect()]
    assert got == [("a", 0.0, True), ("a", 5.0, True), ("a", 15.0, True), ("b", None, False)]


def test_keyframes(spark):
    low, high = "0" * 16, "f" * 16
    rows = [("s", 0, 0.0, low), ("s", 1, 1.0, low[:-1] + "1"), ("s", 2, 2.0, ""), ("s", 3, 3.0, low), ("s", 4, 4.0, high), ("s", 5, 5.0, low), ("s", 6, 6.0, high)]
    d = spark.createDataFrame(rows, "source_id string, candidate_index int, timestamp_sec double, phash string")
    got = timeline.select_keyframes(d, 10, 4).orderBy("frame_index").collect()
    assert [r.candidate_index for r in got] == [0, 2, 4, 5] and got[0].unexamined == 1
    sweep = {r.threshold: r.kept for r in timeline.threshold_sweep(d.where("phash <> ''"), (1, 10)).collect()}
    assert sweep == {1: 6, 10: 4}
    assert spark.range(1).select(timeline.hamming(F.lit("0f"), F.lit("00")).alias("h")).first().h == 4


def test_breaker(spark):
    t, m = "local_vision_timeout", "local_vision_malformed_response"
    runs = {"a": [None, None, t, t, t, *[t] * 75], "b": [t, t, None, t, t, t, None], "c": [t, t, m, t, t, t], "d": [m] * 20, "e": ["local_vision_auth_rejected", None]}
    d = spark.createDataFrame([(k, i + 1, c) for k, cs in runs.items() for i, c in enumerate(cs)], "run_id string, attempt long, code string")
    got = {r.run_id: r.n for r in timeline.breaker(d).where("not skipped").groupBy("run_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 5, "b": 6, "c": 6, "d": 20, "e": 1}
    assert {r.run_id: r.skipped for r in timeline.breaker_warnings(d).collect()} == {"a": 75, "b": 1, "e": 1}


def test_words_around_frames(spark):
    words = [("first", 0.0, 0.5, 1.0), (" second", 0.5, 1.5, 1.0), (" third", 1.5, 2.5, 1.0)]
    schema = "source_id string, seg_no int, start double, end double, text string, words array<struct<word:string,start:double,end:double,probability:double>>"
    s = spark.createDataFrame([("a", 0, 0.0, 2.5, "t", words), ("a", 1, 10.0, 12.0, "blank", [(" ", 0.0, 1.0, 1.0)])], schema)
    f = spark.createDataFrame([("a", 0, 1.6), ("a", 1, 6.0), ("a", 2, 99.0)], "source_id string, frame_index int, timestamp_sec double")
    placed = timeline.interleave(f, s)
    assert [(r.seg_no, r.place) for r in placed.orderBy("frame_index").collect()] == [(0, "inside"), (1, "before"), (None, "after_all")]
    assert [(r.seg_no, r.chunk, r.text) for r in timeline.spoken_chunks(s, placed).orderBy("seg_no", "chunk").collect()] == [(0, 0, "first second"), (0, 1, "third"), (1, 0, "blank")]
    shown = f.withColumns({"adds_information": F.lit(None).cast("boolean"), "relative_path": F.lit("frames/f.png"), "extracted_text": F.lit("x"), "grounding": F.struct(F.lit("weak").alias("level"))})
    w = spark.createDataFrame([("a", 1, "st", "c", "m", 2)], "source_id string, seq long, stage string, code string, message string, occurrences int")
    ls = spark.createDataFrame([("a", 0, 0, "https://x.org/(a)", "l[1]", "r")], "source_id string, line_no int, pos int, url string, label string, reason string")
    text = documents.render(spark.createDataFrame([("a", "T")], "source_id string, title string"), s, shown, w, ls).first().markdown
    order = ["# T", "Warning `c`", "[l\\[1\\]](https://x.org/%28a%29)", "## 00:00:00.000", "first second", "Frame at 00:00:01.600", "third", "Frame at 00:00:06.000", "## 00:00:10.000", "blank", "Frame at 00:01:39.000"]
    places = [text.index(o) for o in order]
    assert places == sorted(places)


def test_windows_against_a_plain_loop(spark):
    rng = random.Random(4)
    segs = [("s", i, a := rng.uniform(0, 900), a + rng.expovariate(1 / 20), rng.choice(["", " w" + "x" * rng.randrange(2000)])) for i in range(150)]
    frames = [("s", i, rng.uniform(-5, 950)) for i in range(60)]
    want = {}
    for _, i, t in frames:
        parts, n = [], 0
        for _, _, a, b, x in segs:
            if n > 4800:
                break
            if b >= t - 30 and a <= t + 30 and x.strip():
                parts.append(x.strip())
                n += len(x.strip())
        want[i] = " ".join(parts)
    s = spark.createDataFrame(segs, "source_id string, seg_no int, start double, end double, text string")
    f = spark.createDataFrame(frames, "source_id string, frame_index int, timestamp_sec double")
    assert {r.frame_index: r.window for r in timeline.transcript_windows(f, s).collect()} == want


def grade(spark, ocr="", own="", sure="none", interpreted=False, reads=False):
    c = grounding.grounding(F.lit(ocr), F.lit(own), F.lit(sure), F.lit(interpreted), F.lit(reads))
    g = spark.range(1).select(c.alias("g")).first().g
    return g.level, g.text_overlap


def test_grounding(spark):
    assert grade(spark, "alpha beta", "alpha beta") == ("corroborated", 1.0)
    assert grade(spark, "alpha beta", "gamma delta") == ("weak", 0.0)
    assert grade(spark, "", "one two three four five", "high") == ("self_report", None)
    assert grade(spark, "", "some heading", "medium") == ("weak", None)
    assert grade(spark, "text here") == ("weak", None)
    assert grade(spark, interpreted=True) == ("ungrounded", None)
    assert grade(spark, sure="high", interpreted=True) == ("weak", None)
    assert grade(spark, reads=True) == ("self_report", None)
    assert grade(spark) == ("corroborated", None)


def test_replies(spark):
    body = json.dumps({"visual_summary": " s ", "frame_kind": "Slide", "text_confidence": "sure", "adds_information": False, "reason": "x" * 500, "detected_elements": ["a", 1]})
    rows = [(1, body), (2, f"```json\n{body}\n```"), (3, f"Here: {body} and }}"), (4, "{}"), (5, "no"), (6, '{"adds_information": "false", "verbatim_text": "v"}'), (7, None), (8, "[1]")]
    got = {r.id: r for r in grounding.parse_replies(spark.createDataFrame(rows, "id long, reply string")).collect()}
    for i in (1, 2, 3):
        r = got[i]
        assert (r.reading.visual_summary, r.reading.frame_kind, r.reading.text_confidence, r.reading.detected_elements) == ("s", "slide", "none", ["a", "1"])
        assert (r.salience.adds_information, len(r.salience.reason), r.salience.reason_truncated) == (False, 400, True)
    assert all(got[i].reading is None and got[i].salience is None for i in (4, 5, 7, 8))
    assert got[6].reading.verbatim_text == "v" and got[6].salience is None
    assert grounding.balanced_object('a {"x": "}{\\""} b') == '{"x": "}{\\""}'


def test_scores(spark):
    rows = [(1, "a b c", "c b a x"), (2, "", "x"), (3, "", ""), (4, "a b", ""), (5, "a a b", "a b b"), (6, "x", "y")]
    d = spark.createDataFrame(rows, "case_id long, truth string, hypothesis string")
    got = {r.case_id: (r.precision, r.recall, round(r.f1, 4)) for r in folds.token_scores(d).collect()}
    assert got == {1: (0.75, 1.0, 0.8571), 2: (0.0, 1.0, 0.0), 3: (1.0, 1.0, 1.0), 4: (0.0, 0.0, 0.0), 5: (2 / 3, 2 / 3, 0.6667), 6: (0.0, 0.0, 0.0)}
    wer = {r.case_id: r.w for r in d.select("case_id", folds.word_error_rate(F.col("truth"), F.col("hypothesis")).alias("w")).collect()}
    assert wer == {1: 1.0, 2: 1.0, 3: 0.0, 4: 1.0, 5: pytest.approx(1 / 3), 6: 1.0}


def test_folded_warnings_fold_again(spark):
    w = spark.createDataFrame([("s", 1, "a", "c", "first", None), ("s", 2, "a", "c", "later", 3), ("s", 0, "b", "c", "x", 0)], "source_id string, seq long, stage string, code string, message string, occurrences int")
    one = folds.fold_warnings(w)
    assert [(r.stage, r.message, r.occurrences) for r in one.orderBy("seq").collect()] == [("b", "x", 1), ("a", "first", 4)]
    assert sorted(map(tuple, folds.fold_warnings(one).collect())) == sorted(map(tuple, one.collect()))


def test_progress(spark):
    rows = [("j", 1, "m1", "completed", None), ("j", 2, "m2", "running", 50.0), ("j", 3, "m3", "running", 25.0), ("k", 1, "m1", "failed", 1.0)]
    e = spark.createDataFrame(rows, "job_id string, sequence long, mechanism string, status string, percent double")
    w = spark.createDataFrame([(f"m{i}", float(i)) for i in range(1, 5)], "mechanism string, weight double")
    assert {r.job_id: r.overall_percent for r in folds.overall_progress(e, w).collect()} == {"j": 27.5, "k": 10.0}
    assert folds.overall_progress(e.where("job_id = 'k'"), w.where("mechanism = 'm1'")).first().overall_percent == 100.0
    ended = folds.progress_summary(e, w, True).where("job_id = 'k'").collect()
    assert {r.status for r in ended} == {"failed", "skipped_or_cached"} and {r.percent for r in ended} == {100.0}


def test_acceptance_of_nothing_fails(spark):
    s = spark.createDataFrame([("r", "text_recovery_accuracy", 0.9, 0.9), ("r", "vision_token_f1_mean", 0.9, 0.9), ("r", "hallucination_rate", 0.0, None)], "reader string, metric string, mean double, most double")
    r = folds.acceptance(s, ["reader"], 0.9, 0.8).first()
    assert (r.accuracy_ok, r.f1_ok, r.hallucination_ok, r.accepted) == (True, True, False, False)


def test_publish_again_changes_nothing(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "bundle_key string")
    none = spark.createDataFrame([], "bundle_key string, gen_no long, batch_id long, active string")
    once = store.publish(keys, none, 1)
    again = store.publish(keys, once, 1)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect())) and {r.active for r in again.collect()} == {"g1"}
    assert {r.active for r in store.publish(keys, once, 2).collect()} == {"g2"}


def test_retention_is_numeric(spark):
    g = spark.createDataFrame([("b", f"g{i}") for i in range(1, 12)], "bundle_key string, name string")
    active = spark.createDataFrame([("b", "g3")], "bundle_key string, active string")
    assert sorted(r.name for r in store.retention(g, active, 2).collect()) == sorted(f"g{i}" for i in range(1, 10) if i != 3)
    with pytest.raises(ValueError):
        store.retention(g, active, 0)


def test_inference_failures_are_rows(spark):
    def model(pdf):
        if (pdf["x"] == 3).any():
            raise RuntimeError("bad")
        return pd.DataFrame({"y": pdf["x"] * 2})

    got = {r.x: (r.y, r.failure) for r in inference.infer(spark.range(6).withColumnRenamed("id", "x"), model, "y long", 2).collect()}
    assert got == {i: (2 * i, None) if i != 3 else (None, "RuntimeError: bad") for i in range(6)}


def test_media_listing_and_logs(spark, tmp_path):
    for n in ("b.MP4", "a.mkv", "c.txt", "sub/d.webm"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    assert names(recordings.list_media(spark, str(tmp_path))) == ["a.mkv", "b.MP4", "d.webm"]
    assert names(recordings.list_media(spark, str(tmp_path), recursive=False, max_items=1)) == ["a.mkv"]
    lines = ['{"type": "progress", "sequence": 4, "percent": 5.5}', '{"code": "E_STUCK", "message": "m"}', "frame= 12", '{"broken', ""]
    got = recordings.parse_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.kind for r in got] == ["progress", "error", "noise", "noise", "noise"] and got[0].event.percent == 5.5 and got[1].event.code == "E_STUCK"


def test_transcripts_flatten(spark):
    doc = json.dumps({"language": "en", "segments": [{"start": 0, "end": 1.5, "text": "a", "words": [{"word": "a", "end": 1.5}]}, {"start": 2, "end": 3, "text": "b"}]})
    d = spark.createDataFrame([("s", doc), ("e", '{"segments": []}')], "source_id string, document string")
    got = sorted(((r.source_id, r.seg_no, r.text) for r in recordings.segments_of(d).collect()), key=str)
    assert got == [("e", None, None), ("s", 0, "a"), ("s", 1, "b")]


def test_schedule_of_an_odd_duration_stays_inside():
    got = timeline.schedule([3.0], 20.0005, 1, 7)
    assert got == [3.0, 10.0, 17.0] and timeline.schedule([9.0], 10.07, 1, 1.5)[-1] <= 10.07
    assert timeline.schedule([50.0], 60, 1, 20) == [0.0, 20.0, 40.0, 50.0]


def test_windows_with_endless_and_very_long_segments(spark):
    s = spark.createDataFrame([("a", 0, 0.0, float("inf"), "endless"), ("a", 1, 0.0, 1e6, "long"), ("a", 2, 95.0, 96.0, "near"), ("a", 3, None, 1.0, "none")], "source_id string, seg_no int, start double, end double, text string")
    f = spark.createDataFrame([("a", 0, 100.0), ("a", 1, 999_990.0), ("a", 2, 2e6), ("a", 3, float("nan"))], "source_id string, frame_index int, timestamp_sec double")
    got = {r.frame_index: r.window for r in timeline.transcript_windows(f, s).collect()}
    assert got == {0: "long near", 1: "long", 2: "", 3: ""}


def test_jobs_of_unknown_mechanisms_stay(spark):
    e = spark.createDataFrame([("a", "m1", 1, "running", 50.0), ("b", "zz", 1, "running", 50.0)], "job_id string, mechanism string, sequence long, status string, percent double")
    w = spark.createDataFrame([("m1", 1.0), ("m2", 1.0)], "mechanism string, weight double")
    assert {r.job_id: r.overall_percent for r in folds.overall_progress(e, w).collect()} == {"a": 25.0, "b": 0.0}
    ended = {r.job_id: r.ended for r in folds.summary_has_ended(folds.progress_summary(e, w, True)).collect()}
    assert ended == {"a": False, "b": True}


def test_replies_with_objects_inside_prose():
    assert grounding.balanced_object('say {"a": "}{"} done }') == '{"a": "}{"}'
    assert grounding.balanced_object("{" * 100_000) is None and grounding.balanced_object("none") is None and grounding.balanced_object('{"a": 1') is None


def test_stored_generations_are_published_once(spark, tmp_path):
    rows, pointers = str(tmp_path / "rows"), str(tmp_path / "pointers")
    assert store.pointers_of(spark, pointers).count() == 0
    d = spark.createDataFrame([("x", 1), ("y", 2)], "bundle_key string, n int")
    for i, part in ((0, d), (1, d.where("n = 1")), (1, d.where("n = 1"))):
        store.publish_batch(part, i, rows, pointers)
    assert {r.bundle_key: r.active for r in store.pointers_of(spark, pointers).collect()} == {"x": "g2", "y": "g1"}
    assert sorted((r.bundle_key, r.name) for r in spark.read.parquet(rows).collect()) == [("x", "g1"), ("x", "g2"), ("y", "g1")]


def test_a_broken_off_batch_is_invisible_and_pointers_are_folded(spark, tmp_path, monkeypatch):
    rows, pointers = str(tmp_path / "rows"), str(tmp_path / "pointers")
    make = lambda *keys: spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "bundle_key string, n int")
    now = lambda: {r.bundle_key: r.active for r in store.pointers_of(spark, pointers).collect()}
    store.publish_batch(make("a", "b"), 0, rows, pointers)
    with monkeypatch.context() as m:
        m.setattr(store, "_mark", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.publish_batch(make("a", "c"), 1, rows, pointers)
    assert now() == {"a": "g1", "b": "g1"}
    assert {(r.bundle_key, r.name) for r in store.published_rows(spark, rows, pointers).collect()} == {("a", "g1"), ("b", "g1")}
    store.publish_batch(make("a", "c"), 1, rows, pointers)
    # A batch writes the pointers of its own keys only.
    assert spark.read.parquet(f"{pointers}/log/batch-1").count() == 2
    assert now() == {"a": "g2", "b": "g1", "c": "g1"}
    store.compact_pointers(spark, pointers)
    assert now() == {"a": "g2", "b": "g1", "c": "g1"}
    assert sorted(p.name for p in (tmp_path / "pointers" / "commits").iterdir() if not p.name.startswith(".")) == ["snapshot-1"]
    for i in (0, 1):
        store.publish_batch(make("a", "b", "c"), i, rows, pointers)
    assert now() == {"a": "g2", "b": "g1", "c": "g1"}
    store.publish_batch(make("b"), 2, rows, pointers, compact_every=1)
    store.publish_batch(make("d"), 3, rows, pointers)
    assert now() == {"a": "g2", "b": "g2", "c": "g1", "d": "g1"}
    assert {(r.bundle_key, r.name) for r in store.published_rows(spark, rows, pointers).collect()} == {("a", "g2"), ("b", "g2"), ("c", "g1"), ("d", "g1")}
    with pytest.raises(ValueError):
        store.pointers_of(spark, pointers, before=2)


def test_descent_equals_a_walk(spark, tmp_path):
    """Names that sort around the separator, stops below stops, several roots, any number of ranges."""
    rng = random.Random(2)
    entries = {}
    for root in ("r", "s", None):
        for _ in range(160):
            parts = [rng.choice(["a", "a!", "a b", "b", "b.c", "_x", "a0"]) for _ in range(rng.randint(1, 5))]
            for i in range(1, len(parts) + 1):
                path = "/".join(parts[:i])
                if (root, path) not in entries:
                    entries[root, path] = (root, path, parts[i - 1], rng.random() < 0.05, i - 1, rng.choice(["absent"] * 8 + ["owned", "published", "foreign", "invalid"]), rng.random() < 0.05)
    def reason(e):
        _, _, name, link, depth, verdict, blind = e
        if blind and not link:
            return "unlistable"
        return "symlink" if link else "reserved" if name[0] in "_." else verdict if verdict in ("foreign", "invalid") else "too deep" if verdict == "absent" and depth >= 6 else "no marker" if verdict == "absent" else None
    stops = {k for k, e in entries.items() if reason(e) != "no marker"}
    want = {k: (reason(e), not any((k[0], "/".join(k[1].split("/")[:i])) in stops for i in range(1, k[1].count("/") + 1))) for k, e in entries.items()}
    d = spark.createDataFrame(list(entries.values()) + list(entries.values())[::3], "root string, path string, name string, is_link boolean, depth int, verdict string, unlistable boolean")
    for parts in (1, 7):
        got = {(r.root, r.path): (r.reason, r.considered) for r in store.considered(d, str(tmp_path / f"w{parts}"), parts).collect()}
        assert got == want
    assert store.considered(d.limit(0), str(tmp_path / "none")).count() == 0


def test_staging_is_listed_per_bundle(spark):
    g = spark.createDataFrame([("b", "g1", True, True)], "bundle_key string, name string, has_render boolean, has_self_contained boolean")
    bundles = spark.createDataFrame([("b", "x", "b", "g1", False), ("c", None, None, None, False)], "bundle_key string, marker string, identity string, active string, locked boolean")
    staging = spark.createDataFrame([("b", ".tmp-2"), ("b", ".tmp-1")], "bundle_key string, name string")
    assert {r.bundle_key: r.staging for r in store.survey(bundles, g, staging).collect()} == {"b": [".tmp-1", ".tmp-2"], "c": []}


def test_a_model_is_built_once_a_worker_and_batches_follow_bytes(spark, tmp_path):
    folder = str(tmp_path)

    def setup():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda part: pd.DataFrame({"rows": [len(part)] * len(part), "pid": [os.getpid()] * len(part)})

    d = spark.createDataFrame([(i, "x" * (3000 if i % 10 == 0 else 10), "clash") for i in range(200)], "id long, text string, Rows string").repartition(8)
    got = inference.infer(d, None, "rows int, pid long", batch_rows=7, batch_bytes=2000, setup=setup).collect()
    built = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    # Eight tasks, but no process has built its model twice.
    assert len(built) == len(set(built)) and {str(r.pid) for r in got} == set(built)
    assert len(got) == 200 and all(r.rows == 1 for r in got if len(r.text) == 3000) and max(r.rows for r in got) == 7
    with pytest.raises(ValueError):
        inference.infer(d, None, "rows int")


def test_parts_of_a_long_document_are_its_text(spark):
    """A source with very many blocks comes in parts over several ranges; null texts and sources without a row, too."""
    rows = [("a", 4, float(i), f"block {i} " + "x" * (i % 50)) for i in range(3000)] + [("b", 0, 0.0, "# B"), (None, 1, 0.0, "z"), ("c", 2, 0.0, None), ("c", 2, 1.0, "")]
    d = spark.createDataFrame(rows, "source_id string, section int, k0 double, text string")
    block = F.struct("section", "k0", *[F.lit(0.0).alias(f"k{i}") for i in (1, 2, 3)], "text").alias("block")
    blocks = d.select("source_id", block)
    parts = documents.parts_of(blocks, 5000)
    assert parts.where("source_id = 'a'").count() > 10
    assert parts.agg(F.max(F.length("markdown"))).first()[0] < 5100
    whole = {r.source_id: r.markdown for r in documents._assemble(blocks).collect()}
    assert {r.source_id: r.markdown for r in documents.joined_parts(parts).collect()} == whole


def test_links_are_redacted_with_their_reasons(spark):
    secret = "ghp_" + "aB3" * 12
    empty = lambda schema: spark.createDataFrame([], schema)
    found = spark.createDataFrame([("a", 0, 0, "https://x.org", "x", f"who {secret}", f"why {secret}")], "source_id string, line_no int, pos int, url string, label string, source string, reason string")
    blocks = documents.filtered_blocks(
        spark.createDataFrame([("a", "T")], "source_id string, title string"), empty("source_id string, seg_no int, start double, end double, text string, avg_logprob double, words array<struct<word:string,start:double,end:double,probability:double>>"),
        empty("source_id string, frame_index int, timestamp_sec double, relative_path string, extracted_text string, adds_information boolean, grounding struct<level:string>"), empty("source_id string, seq long, stage string, code string, message string, occurrences int"), found, reasons=True,
    )
    text = "".join(r.block.text for r in blocks.collect())
    assert "[x](https://x.org) (why \\[REDACTED:github-token\\])" in text and secret not in text


def test_malformed_transcripts_are_marked(spark):
    docs = {1: '{"segments": [{"start": 0, "end": 1, "text": "a"}]}', 2: "{", 3: "[]", 4: '{"segments": 5}', 5: '{"segments": [{"start": 0}]}', 6: "{}", 7: None, 8: '{"segments": []}', 9: "null"}
    d = spark.createDataFrame(list(docs.items()), "source_id int, document string")
    got = {r.source_id: (r.problem, r.text) for r in recordings.segments_of(d, problems=True).collect()}
    assert got == {1: (None, "a"), 2: ("not JSON", None), 3: ("not an object", None), 4: ("segments", None), 5: ("segment", None), 6: ("segments", None), 7: ("not JSON", None), 8: (None, None), 9: ("not an object", None)}
    assert "problem" not in recordings.segments_of(d).columns


def test_every_error_has_a_row(spark):
    d = spark.createDataFrame([("b", i, f"x{i}", "E" if i % 2 else None, "s") for i in range(1, 101)], "batch_id string, batch_index long, item string, code string, stage string")
    got = folds.error_rows(d).collect()
    assert sorted((r.error_no, r.batch_index) for r in got) == [(i + 1, 2 * i + 1) for i in range(50)]
    assert folds.error_rows(d, stop_at_first=True).count() == 1
