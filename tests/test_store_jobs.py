"""Ingest, ids in blocks, migrations, batch results and the circuit breaker."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from inkledger.sources import batches, ingest, migrations, store
from inkledger.streaming import breaker
from pyspark.sql import functions as F


def empty(spark, name):
    return spark.createDataFrame([], store.SCHEMAS[name])


# ---- ids -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_ids_are_gapless_in_order_and_never_meet_in_one_task(spark, n):
    rows = spark.createDataFrame([(k * 37 % 501, f"v{k}") for k in range(n)], "k long, v string").repartition(6)
    got = store.with_ids(rows, 40, "k", "v")
    assert [(r.id, r.k) for r in got.orderBy("id").collect()] == [(41 + i, k) for i, k in enumerate(sorted(k * 37 % 501 for k in range(n)))]
    assert "SinglePartition" not in store.with_ids(rows, 40, "k", "v").drop("id")._jdf.queryExecution().executedPlan().toString().split("Window")[0]


def test_corrections_number_on(spark):
    none = [empty(spark, k).drop("created_at") for k in ("samples", "ground_truths", "corrections")]
    told = [(f"h{k % 5}", "p", "w", f"o{k}", f"t{k % 2}", 0.5, "s") for k in range(20)]
    incoming = spark.createDataFrame(told, "image_hash string, image_path string, writer string, original string, corrected string, confidence double, source string")
    first = store.record_corrections(*none, incoming)
    again = store.record_corrections(*first, incoming)
    assert [t.count() for t in first] == [5, 10, 20] and [t.count() for t in again] == [5, 10, 40]
    for t, n in zip(again, (5, 10, 40)):
        assert sorted(r.id for r in t.select("id").collect()) == list(range(1, n + 1))


# ---- ingest --------------------------------------------------------------------------------------------------------------


def test_a_folder_is_taken_in_once(spark):
    rows = [("/d/b_page-7.png", b"two"), ("/d/a_page_3.jpg", b"one"), ("/d/c.png", b"one"), ("/d/scan 12 of 9.png", b"three"), ("/d/broken.png", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    hashes = files.select(F.sha2("content", 256).alias("image_hash"), "path").where("image_hash is not null")
    measures = hashes.select("image_hash", F.lit(300.0).alias("blur"), F.lit(0.2).alias("contrast"), F.lit(240.0).alias("mean"), F.lit(9.0).alias("deviation")).distinct().where(F.col("image_hash") != F.sha2(F.lit(b"three"), 256))
    samples, quality, added = ingest.ingest_directory(files, empty(spark, "samples"), empty(spark, "quality_assessments"), measures, student="s", category="bio")
    got = {r.image_path: (r.id, r.page_number, r.student, r.category) for r in samples.collect()}
    assert got == {"/d/a_page_3.jpg": (1, 3, "s", "bio"), "/d/b_page-7.png": (2, 7, "s", "bio"), "/d/scan 12 of 9.png": (3, 9, "s", "bio")}
    marks = {r.sample_id: r for r in quality.collect()}
    assert set(marks) == {1, 2} and marks[1].quality == "poor" or marks[1].issues
    again = ingest.ingest_directory(files, samples, quality, measures)
    assert again[0].count() == 3 and again[1].count() == 2 and again[2].count() == 0
    more = ingest.ingest_directory(spark.createDataFrame([("/e/x.png", b"four")], "path string, content binary"), samples, quality)
    assert [r.id for r in more[2].collect()] == [4]
    assert ingest.earliest(samples.unionByName(samples.withColumn("id", F.col("id") + 10)), "image_hash").count() == 3


def test_guided_ingest(spark):
    samples = spark.createDataFrame([(1, "/o/a.png", "ha"), (2, "/o/b.png", "hb")], "id long, image_path string, image_hash string")
    truths = spark.createDataFrame([(5, 1, "known", "manual")], "id long, sample_id long, text string, source string")
    rows = [("/n/1.png", "ha", "x"), ("/n/2.png", "hb", " said "), ("/n/3.png", "hb", "later"), ("/n/4.png", "hc", ""), ("/n/5.png", "hd", "new"), ("/n/6.png", None, "lost")]
    files = spark.createDataFrame(rows, "path string, image_hash string, answer string")
    all_samples, all_truths, counts = ingest.ingest_guided(files, samples, truths, "s")
    assert {r.outcome: r.n for r in counts.collect()} == {"annotated": 2, "skipped_existing_gt": 2, "skipped_user": 1, "newly_added": 2, "errors": 1}
    assert {(r.id, r.image_hash) for r in all_samples.collect()} == {(1, "ha"), (2, "hb"), (3, "hc"), (4, "hd")}
    assert sorted((r.id, r.sample_id, r.text, r.source) for r in all_truths.collect()) == [(5, 1, "known", "manual"), (6, 2, "said", "lab-grader"), (7, 4, "new", "lab-grader")]


def test_lines_with_their_images(spark):
    records = spark.createDataFrame([("a01-000u-00", "a01", "a01-000u", "A MOVE"), ("a01-000u-01", "a01", "a01-000u", "TO STOP"), ("b02-1-00", "b02", "b02-1", "gone")], "line_id string, writer string, form string, text string")
    images = spark.createDataFrame([("/i/a01/a01-000u/a01-000u-00.png", b"x"), ("/i/a01/a01-000u/a01-000u-01.png", b"y")], "path string, content binary")
    samples, truths, counts = ingest.ingest_lines(records, images, empty(spark, "samples"), empty(spark, "ground_truths"))
    assert [tuple(r) for r in counts.collect()] == [(2, 0, 1)]
    assert {(r.student, r.category) for r in samples.collect()} == {("iam-writer-a01", "iam")} and {r.text for r in truths.collect()} == {"A MOVE", "TO STOP"}
    assert [tuple(r) for r in ingest.ingest_lines(records, images, samples, truths)[2].collect()] == [(0, 2, 1)]


def test_strategies_and_faint_ink(spark):
    rows = [("good", [], False), ("good", [], True), ("fair", ["blurry"], False), ("fair", ["low_contrast"], True), ("fair", ["too_dark"], False), ("poor", ["blurry", "too_bright"], True), ("poor", ["skewed"], False)]
    df = spark.createDataFrame(rows, "t string, i array<string>, f boolean")
    got = [(r.p, list(r.w)) for r in df.select(ingest.recommended(F.col("t"), F.col("i"), F.col("f")).alias("p"), ingest.with_faint(F.col("i"), F.col("f")).alias("w")).collect()]
    assert got == [(None, []), ("contrast", ["faint_ink"]), ("sharpen", ["blurry"]), ("contrast", ["low_contrast"]), ("brighten", ["too_dark"]), ("full", ["blurry", "too_bright", "faint_ink"]), ("full", ["skewed"])]


# ---- migrations ----------------------------------------------------------------------------------------------------------


def test_migrations(spark, tmp_path):
    at = migrations.Store(spark, str(tmp_path / "store"))
    steps = migrations.steps(spark)
    assert at.manifest() == (0, {}) and at.migrate({k: steps[k] for k in (1, 2)}) == [1, 2]
    at.publish(3, {"runs": spark.createDataFrame([(1, "a")], "id long, label string")})
    assert at.migrate({k: v for k, v in steps.items() if k != 3} | {4: steps[5], 5: steps[6], 6: steps[3]}) == [4, 5, 6]
    run = at.tables()["runs"].head()
    assert (run.label, run.is_baseline, run.total_cost_usd, run.vocab_hints_off) == ("a", False, 0.0, False)
    assert "is_baseline" not in at.tables(3)["runs"].columns and at.migrate(steps) == []

    def broken(tables):
        return {"samples": tables["samples"].select(F.raise_error(F.lit("bad row")).alias("id")).unionAll(spark.range(1).select(F.raise_error(F.lit("bad row"))))}

    with pytest.raises(Exception, match="bad row"):
        at.migrate({7: broken})
    assert at.manifest()[0] == 6 and at.tables()["runs"].count() == 1
    with pytest.raises(ValueError, match="cannot follow"):
        at.publish(9, {})
    other = migrations.Store(spark, at.path)
    at.publish(7, {})
    with pytest.raises(ValueError):
        other.publish(7, {})


# ---- batch results -------------------------------------------------------------------------------------------------------


def test_batch_results(spark):
    def fine(key, text, tokens=3):
        return json.dumps({"custom_id": key, "response": {"status_code": 200, "body": {"choices": [{"message": {"content": text}}] if text is not None else [], "usage": {"prompt_tokens": tokens, "completion_tokens": 1}}}})

    bad = json.dumps({"custom_id": "b", "response": {"status_code": 429, "body": {"error": {"message": "slow down"}}}})
    odd = json.dumps({"custom_id": "c", "response": {"status_code": 500, "body": {}}})
    outputs = [fine("a", "old"), bad, odd, "", "{broken", "[1]", fine("a", "new", 7), fine("e", None)]
    errors = [json.dumps({"custom_id": "a", "error": {"message": "late"}}), json.dumps({"custom_id": "d", "error": {"message": "first"}}), json.dumps({"custom_id": "d", "error": {"message": "second"}}), json.dumps({"custom_id": "f", "error": {}}), "nonsense"]
    frame = lambda lines: spark.createDataFrame(list(enumerate(lines)), "at long, value string").repartition(3)
    got, damaged = batches.retrieve(frame(outputs), frame(errors))
    assert {r.custom_id: tuple(r)[1:] for r in got.collect()} == {
        "a": ("new", 7, 1, None), "b": ("", 0, 0, "slow down"), "c": ("", 0, 0, "Unknown error"), "d": ("", 0, 0, "first"), "e": ("", 3, 1, None), "f": ("", 0, 0, "Batch error"),
    }
    assert {tuple(r) for r in damaged.collect()} == {("output", 4, "{broken"), ("output", 5, "[1]"), ("error", 4, "nonsense")}
    asked = batches.requests(spark.createDataFrame([(1, "read this")], "k int, p string"), "k", "p", "m").head().value
    assert json.loads(asked) == {"custom_id": "1", "method": "POST", "url": "/v1/chat/completions", "body": {"model": "m", "max_tokens": 4096, "messages": [{"role": "user", "content": "read this"}]}}


# ---- circuit breaker -------------------------------------------------------------------------------------------------------

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
CALLS = "provider string, call_id long, ts timestamp, ok boolean"


class Breaker:
    """The rules once more, with a clock and a table of deadlines."""

    def __init__(self):
        self.failed, self.deadline = {}, {}

    def call(self, who, at, ok):
        if who in self.deadline:
            if at < self.deadline[who]:
                return False
            del self.deadline[who]
            self.failed[who] = 2
        if ok:
            self.failed[who] = 0
        else:
            self.failed[who] = self.failed.get(who, 0) + 1
            if self.failed[who] >= 3:
                self.deadline[who] = at + 60
        return True


def calls(seed, n=400):
    r = random.Random(seed)
    at, out = 0.0, []
    for k in range(n):
        at += r.choice([0, 0.5, 2, 9, 30])
        out.append((r.choice("abc"), k, START + timedelta(seconds=at), r.random() < 0.4))
    return out


def test_breaker_steps():
    state, seen = breaker.CLOSED, []
    for at, ok in ((0, False), (1, False), (2, True), (3, False), (4, False), (5, False), (64, True), (65, False), (66, True), (125, True), (126, False)):
        found, state = breaker.step(state, at * 1_000_000, ok)
        seen.append(found)
    assert seen == ["closed"] * 6 + ["open", "half_open", "open", "half_open", "closed"] and state == (1, -1)


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_the_rules(spark, seed):
    rows = calls(seed)
    got = {r.call_id: r.allowed for r in breaker.replay(spark.createDataFrame(rows, CALLS).repartition(5)).collect()}
    own = Breaker()
    want = {k: own.call(who, (ts - START).total_seconds(), ok) for who, k, ts, ok in rows}
    assert got == want and not all(want.values())


def test_stream_equals_replay(spark, tmp_path):
    """Calls within the allowed delay may come out of order; the stream decides them as the replay does."""
    rows = calls(3, 150)
    source, r = tmp_path / "in", random.Random(7)
    source.mkdir()
    end = rows[-1][2]
    waves = [rows[k : k + 30] for k in range(0, 150, 30)] + [[("z", 900 + k, end + timedelta(seconds=100_000 * (k + 1)), True)] for k in range(3)]
    for k, wave in enumerate(waves):
        mixed = wave[:]
        r.shuffle(mixed)
        (source / f"{k:03}.json").write_text("\n".join(json.dumps({"provider": p, "call_id": c, "ts": ts.strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "ok": ok}) for p, c, ts, ok in mixed))
    stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).json(str(source))
    out = breaker.stream(stream, "2000 seconds")
    query = out.writeStream.format("memory").queryName("breaker_calls").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    got = {r.call_id: (r.state, r.failures) for r in spark.table("breaker_calls").collect() if r.call_id < 900}
    want = {r.call_id: (r.state, r.failures) for r in breaker.replay(spark.createDataFrame(rows, CALLS)).collect()}
    assert got == want


def test_open_intervals(spark):
    rows = [("a", k, START + timedelta(seconds=k), False) for k in range(5)]
    got = breaker.intervals(breaker.replay(spark.createDataFrame(rows, CALLS))).collect()
    assert [((r.until - r.opened).total_seconds()) for r in got] == [60.0]
