"""Reports, text metrics, voting, correction, statistics and store on pinned cases and against DuckDB."""

import glob
import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkledger import catalogue, catalogue_runs  # noqa: F401  (registers its queries)
from inkledger.functions import misreading, numeric, pixels, text
from inkledger.operators import correction, similarity, stats, strategies, voting
from inkledger.plans import reports
from inkledger.sources import store
from inkledger.streaming import events

SF = "/root/testdata/sf0.001"


def value(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], list(cells)).select(column.alias("x")).head()["x"] if cells else spark.range(1).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize("hyp,ref,rate", [("hxllo", "hello", 0.2), ("", "", 0.0), ("x", "", math.inf), ("HELLO [?]", "hello", 0.0)])
def test_char_error(spark, hyp, ref, rate):
    assert value(spark, text.char_error(F.lit(hyp), F.lit(ref))["rate"]) == pytest.approx(rate)


def test_word_error_and_plain_error(spark):
    assert value(spark, text.word_error(F.lit("the dog sat"), F.lit("the cat sat"))["rate"]) == pytest.approx(1 / 3)
    assert value(spark, text.word_error(F.lit(""), F.lit("a b"))["rate"]) == 1.0
    assert value(spark, text.plain_error(F.lit("abc"), F.lit(""))) == 0.0
    assert value(spark, text.change_ratio(F.lit("hello"), F.lit("hella"))) == pytest.approx(0.2)


def test_markers_and_confidence(spark):
    assert value(spark, text.marker_rate(F.lit("[?] mitochondria [?] powerhouse cell"))) == pytest.approx(0.4)
    assert value(spark, text.uncertainty(F.lit("[?] ??? [unclear] [?alt: a/b]"))) == 3
    assert value(spark, text.single_confidence(F.lit("A"))) <= 0.45
    assert value(spark, text.single_confidence(F.lit("one two three four five six seven"))) == 0.7


def test_ngrams_short_and_empty(spark):
    assert value(spark, text.ngrams(text.tokens(F.lit("a b")))) == ["a b"]
    assert value(spark, text.ngrams(text.tokens(F.lit("")))) == []
    assert sorted(value(spark, text.ngrams(text.tokens(F.lit("a b c d"))))) == ["a b c", "b c d"]


def test_clean_up(spark):
    assert value(spark, text.strip_chatter(F.lit("Here is it:\nbody\nNote: hard"))) == "body"
    assert value(spark, text.strip_markdown(F.lit("# T\n**b** _i_ a_b_c"))) == "T\nb i a_b_c"
    assert value(spark, text.drop_repeated_lines(F.lit("a\nA\n\na\nb\n"))) == "a\nA\n\nb\n"
    assert value(spark, text.page_number(F.lit("scan_Page-12_v3.png"))) == 12 and value(spark, text.page_number(F.lit("none"))) == 0
    assert value(spark, text.hints(F.lit("Cell, cell, ab, Gene"))) == ["Cell", "Gene"]
    assert value(spark, text.inference_pieces(F.lit("One two. Three four. " + "x" * 15), 12)) == ["One two.", "Three four.", "xxxxxxxxxxxx", "xxx"]
    assert value(spark, text.normalise(text.nfc(F.lit("Café  [unclear]")))) == "café"


@pytest.mark.parametrize("words,want", [(["modern", "rnodern"], "modern"), (["apple", "orange"], None), (["cell", "ceII"], "cell"), (["a", "b", "c"], None)])
def test_resolve_characters(words, want):
    assert voting.resolve_characters(words) == want


def test_vote_words():
    assert voting.vote_words(["the cat sat", "the cat sat", "the dog sat"], [1.0, 1.0, 1.0])["text"] == "the cat sat"
    tie = voting.vote_words(["red sky", "big sky"], [1.0, 1.0])
    assert tie == {"text": "red [?alt: big] sky", "confidence": 0.5, "disagreements": ["'red' vs 'big' (no majority)"]}
    # a shorter replacement votes at every place of the stretch
    short = voting.vote_words(["a b c", "x", "a b c"], [1.0, 1.0, 0.1])
    assert short["confidence"] == 0.0 and short["disagreements"] == ["'x' vs 'a' (majority)", "'x' vs 'b' (majority)", "'x' vs 'c' (majority)"]
    three = voting.vote_words(["cat", "dog", "cow", "pig"], [1.0, 1.0, 1.0, 1.0])
    assert three["text"] == "cat [?alt: dog/cow]"
    longer = voting.vote_words(["a b", "a x y z", "a x y z"], [1.5, 1.0, 1.0])
    assert longer["text"] == "a x [?alt: y/z]"  # x, y and z weigh 2.0 each at the last place, b 1.5
    assert voting.vote_words(["one\ntwo\n", "one\ntwo"], [1.0, 1.0])["text"] == "one\ntwo"


def test_consensus_drops_the_odd_one(spark):
    good = "the quick brown fox jumps over the lazy dog"
    rows = [(1, p, t, 0.9, w) for p, t, w in (("a", good, 1.0), ("b", good, 1.0), ("c", "something else entirely here", 9.0))]
    got = voting.consensus(spark.createDataFrame(rows, "sample_id long, provider string, text string, confidence double, weight double")).head()
    assert got.text == good


READINGS = "sample_id long, provider string, text string, confidence double, weight double, error string"


def test_empty_readings_do_not_vote(spark):
    good = "the quick brown fox jumps over the lazy dog"
    rows = [(1, "a", good, None, 1.0, None), (1, "b", good, None, 1.0, None), (1, "c", "", None, 9.0, None), (2, "a", "", None, 1.0, None), (3, "a", "just this", None, 1.0, None), (3, "b", None, None, 1.0, None)]
    rows += [(4, p, t, 0.5, 1.0, None) for p, t in (("a", good), ("b", good), ("c", good), ("d", "nothing like it at all"))]
    rows += [(5, "a", "a modern text here", None, 1.0, None), (5, "b", "a rnodern text here", None, 1.0, None)]
    frame = spark.createDataFrame(rows, READINGS)
    got = {r.sample_id: r for r in voting.consensus(frame).collect()}
    assert got[1].text == good and got[1].confidence == 0.95 and got[1].strategy == "vote"
    assert (got[2].text, got[2].confidence, got[2].level) == ("", 0.0, "LOW")
    assert got[3].text == "just this" and got[3].strategy == "vote_partial" and got[3].confidence == 0.45
    assert got[4].text == good and got[4].disagreements == ["'d' excluded as outlier (agreement < 20% with all others)"]
    assert got[5].text == "a modern text here"
    habits = spark.createDataFrame([(5, {"rn\u2194m": "rn"})], "sample_id long, habits map<string,string>")
    assert {r.sample_id: r.text for r in voting.consensus(frame, habits).collect()}[5] == "a rnodern text here"


def test_strategies(spark):
    clear = "one two three four five six seven eight"
    rows = [(1, "gemini", "a b", 0.5, 1.0, None), (1, "openai", "a b", 0.6, 1.0, None), (1, "claude", "x", 0.9, 1.0, None), (2, "gemini", "q", 0.95, 1.0, None), (3, "openai", "z", 0.1, 1.0, "boom"), (3, "claude", "w", 0.2, 1.0, None), (4, "gemini", "a b c", 0.1, 1.0, None), (4, "openai", "d e f", None, 1.0, None), (5, "gemini", clear, None, 1.0, None), (5, "openai", clear + " nine", None, 1.0, None)]
    frame = spark.createDataFrame(rows, READINGS)
    got = {r.sample_id: r for r in strategies.cascade(frame).collect()}
    assert {k: r.strategy for k, r in got.items()} == {1: "cascade_openai_validated", 2: "cascade_best_effort_gemini", 3: "cascade_best_effort_claude", 4: "cascade_best_effort_openai", 5: "cascade_openai_validated"}
    assert got[1].confidence == 0.95 and got[4].confidence == 0.0 and got[5].confidence == 0.941
    assert {r.sample_id: r.strategy for r in strategies.cascade(frame, threshold=0.7).collect()}[5] == "cascade_gemini"
    assert {r.sample_id: r.text for r in strategies.best_of(frame, ["openai", "gemini"]).collect()} == {1: "a b", 2: "q", 3: "w", 4: "d e f", 5: clear + " nine"}
    rulings = spark.createDataFrame([(1, "not asked", None), (4, "a e [?]", "a e f"), (5, clear, "x [?] [?]")], "sample_id long, text string, final string")
    got = {r.sample_id: r for r in strategies.debate(frame, rulings).collect()}
    assert (got[1].text, got[1].strategy, got[1].confidence) == ("a b", "debate_agreed", 0.95)
    assert got[2].strategy == "debate_single_fallback" and (got[4].text, got[4].strategy, got[4].confidence) == ("a e f", "debate_ice_resolved", 0.1)
    assert (got[5].text, got[5].strategy, got[5].confidence) == (clear, "debate_resolved", 0.92)
    passes = spark.createDataFrame([(1, 0, "a [?]"), (1, 1, "a [?]"), (1, 2, "a b"), (1, 3, "late"), (2, 0, "kept [?]"), (2, 1, "  "), (3, 0, " "), (3, 1, "x")], "sample_id long, round int, text string")
    got = {r.sample_id: (r.text, r.strategy) for r in strategies.self_correct(passes, 3).collect()}
    assert got == {1: ("a b", "self_correct_2pass"), 2: ("kept [?]", "self_correct_1pass")}
    quality = spark.createDataFrame([(1, "good", 250.0, 0.7, False, 0), (4, "poor", 10.0, 0.1, True, 3), (5, "fair", 120.0, 0.5, False, 1)], "sample_id long, quality string, blur double, contrast double, faint boolean, issues int")
    got = {r.sample_id: r.strategy for r in strategies.smart_route(frame, quality, passes, ["gemini"]).collect()}
    assert got == {1: "best_of", 4: "vote", 5: "cascade_gemini"}


def test_benchmark_run_and_report(spark):
    rows = [(1, "claude", "the cell", None, 1.0, None), (1, "gemini", "the celt", None, 1.0, None), (2, "claude", "", None, 1.0, "timeout"), (2, "gemini", "a b", None, 1.0, None), (9, "claude", "no truth", None, 1.0, None)]
    truths = spark.createDataFrame([(1, "the cell"), (2, "a b")], "sample_id long, text string")
    outputs, metrics = strategies.run(spark.createDataFrame(rows, READINGS), truths, ["best_of"], ["gemini"])
    got = {(r.sample_id, r.provider, r.strategy): r for r in metrics.collect()}
    assert outputs.count() == 6 and len(got) == 5 and (2, "claude", "single") not in got
    assert got[1, "claude", "single"].cer == 0.0 and got[1, "gemini", "single"].cer == 0.125 and got[1, "claude+gemini", "best_of"].wer == 0.5
    results = outputs.join(metrics, ["run_id", "sample_id", "provider", "strategy"], "left").select("*", F.lit(1000).alias("input_tokens"), F.lit(500).alias("output_tokens"))
    runs = spark.createDataFrame([(1, "claude/x", None, None, False)], "id long, model_version string, iam_partition string, norm_flags string, vocab_hints_off boolean")
    shown = reports.generate_report(results, runs)
    assert shown.startswith("Benchmark Run #1") and "Partition:  n/a" in shown and len(shown.split("\n")) == 12
    line = next(x for x in shown.split("\n") if x.startswith("claude  "))
    assert line.split() == ["claude", "single", "0.00%", "---", "0.00%", "0.00%", "3,000", "$0.0210", "2", "1"]
    assert '"mean_cer":0.0625' in reports.generate_report(results, runs, form="json")
    assert "gemini,single,0.062500,0.250000,0.062500,0.250000,3000,0.000900,2,0" in reports.generate_report(results, runs, form="csv")
    assert reports.generate_report(results, runs.limit(0)) == "No benchmark runs found." and "No results" in reports.generate_report(results, runs, 7)


def test_correction():
    c = correction.Corrector()
    pinned = {
        "Mitochondra, ok": "Mitochondria, ok", "bell sell": "bell sell", "stem celll": "stem cell", "stm cell": "stem cell", "natural selecton": "natural selection", "Natural selecton is": "Natural selection is",
        "via natural selecton, species": "via natural selection, species", "pH is 7.4 and 37C": "pH is 7.4 and 37C", "ATP GOLG. GOLG": "ATP GOLG. GOLG", "the [?] is": "the [?] is", "": "",
    }
    assert {k: c.terms(k) for k in pinned} == pinned
    assert "amino acid" in c.terms("each amino acidd has")
    assert correction.Corrector("chemistry").terms("the periodc table") == "the periodic table" and correction.Corrector("none").terms("osmosi") == "osmosi"
    assert c.lookalikes("rnembrane") == ("membrane", [{"original": "rnembrane", "corrected": "membrane", "pair": "rn\u2194m"}])
    assert c.lookalikes("the celI (0smosis) CelI.")[0] == "the cell (0smosis) Cell."
    assert c.terms("the celI underwent") == "the celI underwent"
    assert correction.near("abc", "acb") and correction.near("abc", "abcd") and not correction.near("abc", "cab")


def test_corrector_evaluation(spark):
    rows = spark.createDataFrame([("mitochondra x", "mitochondria x"), ("plain", "plain")], "corrupted string, clean string")
    got = correction.evaluate(rows).head()
    assert got.n == 2 and got.cer_corrupted > 0 == got.cer_heuristic == got.cer_gated and (got.refused, got.skipped) == (0, 0)
    got = correction.evaluate(rows, model=lambda t: F.concat(t, F.lit(" and much more"))).head()
    assert (got.refused, got.skipped) == (1, 1) and got.cer_gated == 0 < got.cer_both


def test_synthesis(spark):
    clean = spark.createDataFrame([(k, f"The résumé of cell number {k} shows mitochondria, osmosis and more.") for k in range(200)] + [(900, ""), (901, "ab"), (902, None)], "k long, t string")
    got = {r.k: r for r in misreading.build_pairs(clean, "k", "t").collect()}
    assert got == {r.k: r for r in misreading.build_pairs(clean.repartition(5), "k", "t").collect()}
    assert all(r.corrupted != r.clean for k, r in got.items() if k < 200) and got[900].corrupted == "" and got[902].corrupted is None
    share = sum(text.distance(r.corrupted, r.clean) for k, r in got.items() if k < 200) / sum(len(r.clean) for k, r in got.items() if k < 200)
    assert 0.01 < share < 0.15
    other = {r.k: r.corrupted for r in misreading.build_pairs(clean, "k", "t", 7).collect()}
    assert sum(other[k] != got[k].corrupted for k in range(200)) > 150


def test_pixels(spark):
    blank, dark = [255] * 98 + [0] * 2, [10, 250] * 50
    rows = spark.createDataFrame([(1, blank, 10), (2, dark, 10), (3, [], 10)], "k int, p array<int>, w int")
    got = {r.k: r for r in rows.select("k", pixels.is_blank(F.col("p")).alias("blank"), pixels.quality(F.col("p"), F.col("w")).alias("q"), pixels.ink_runs(F.col("p")).alias("runs")).collect()}
    assert (got[1].blank, got[2].blank, got[3].blank) == (True, False, False)
    assert got[2].q.contrast == round(240 / 255, 3) and got[2].q["mean"] == 130.0 and got[1].q.blur < got[2].q.blur
    assert [tuple(r) for r in got[1].runs] == [(98, 2)] and len(got[2].runs) == 50 and got[3].runs == []
    plain = [[0] * 5 for _ in range(5)]
    plain[2][2] = 10
    q = pixels.measures(np.array(plain).ravel(), 5)
    inside = [[128] * 3 for _ in range(3)]
    inside[1][1], inside[0][1], inside[1][0], inside[1][2], inside[2][1] = 88, 138, 138, 138, 138
    flat = [0] * 16 + [x for row in inside for x in row]
    assert q["blur"] == round(float(np.var(flat)), 2)


def test_rules(spark):
    assert value(spark, numeric.byte_batches(F.array(*map(F.lit, (5, 5, 1, 20, 3))), 10)) == [0, 0, 1, 2, 3]
    assert value(spark, numeric.uncertain_strips(F.lit("a\nb [?]\nc\nd\ne\nf [ILLEGIBLE word]"))) == [0, 2]
    assert [value(spark, numeric.few_shot_limit(F.lit(x))) for x in ("0", "7", "-1", "x", None)] == [0, 7, 3, 3, 3]
    assert value(spark, numeric.vote_weight(F.lit("no such"), F.lit("gemini"))) == 1.2 and value(spark, numeric.vote_weight(F.lit("layout"), F.lit("claude"))) == 1.5
    plan = value(spark, numeric.enhancement(F.lit("good"), F.lit(True), F.array()))
    assert (plan.strategy, plan.contrast_factor, plan.sharpen, plan.cutoff) == ("adaptive", 2.0, False, 3)
    assert value(spark, numeric.strategy_cost(F.lit("debate"), F.lit(2), F.lit(1000), F.lit(500), F.lit(3.15), F.lit(15.6))) == 0.0164
    layout = numeric.Layout((0.1, 0.4), (0.6, 0.9), 0.2, 0.1, 0.05, 0.01, 2)
    boxes = value(spark, numeric.answer_regions(F.lit(1000), F.lit(500), 3, layout, 5))
    assert [tuple(b) for b in boxes] == [(1, 95, 70, 405, 110), (2, 95, 120, 405, 160), (3, 595, 70, 905, 110)]
    assert value(spark, text.read_confidence(F.lit("a [?] [illegible: 2]"))) == pytest.approx(0.85)
    assert value(spark, text.safe_name(F.lit("a b/é-1_"))) == "a_b_é-1_" and value(spark, text.strip_accents(F.lit("åçé"))) == "ace"
    assert value(spark, text.capital_like(F.lit("cell"), F.lit("Word"))) == "Cell" and value(spark, text.bare(F.lit("(ab1)"))).core == "ab"
    assert [value(spark, text.confidence_level(F.lit(x), F.lit(0.7))) for x in ("1 2 3 4 5 6", "ab", "page faint but five words", "[x")] == ["HIGH", "LOW", "LOW", "HIGH"]
    assert value(spark, text.single_confidence(F.lit("1 2 3 4 5 6"))) == 0.7


def test_bootstrapped_truth_takes_the_first_provider_on_ties(spark):
    rows = [(1, 1, "b", "the same text, ok", 0.9), (2, 1, "a", "the same text. ok", 0.9), (3, 2, "a", "x", 0.9), (4, 2, "b", "quite different", 0.9)]
    outputs = spark.createDataFrame([(*r, None) for r in rows], "id long, sample_id long, provider string, output_text string, confidence double, created_at timestamp")
    assert [(r.sample_id, r.text) for r in reports.bootstrap_truth(outputs, 0.1).collect()] == [(1, "the same text. ok")]


def test_ranks_and_signed_rank(spark):
    a = [.10, .12, .11, .13, .09, .14, .11, .10, .12, .13, .15, .16]
    b = [.06, .08, .07, .09, .05, .10, .07, .06, .08, .09, .11, .12]
    rows = [("x", p, q) for p, q in zip(a, b)] + [("same", p, p) for p in a]
    got = {r.g: r for r in stats.signed_rank(spark.createDataFrame(rows, "g string, a double, b double"), ["g"]).collect()}
    assert got["x"].n == 12 and got["x"].p_value < 0.05 and "same" not in got
    low = stats.bootstrap_mean(spark.createDataFrame(rows, "g string, a double, b double"), ["g"], "a", rounds=500).head()
    assert low.low <= sum(a) / 12 <= low.high
    with pytest.raises(ValueError):
        stats.bootstrap_mean(spark.range(1), [], "id", confidence=2)


def test_regression_with_pinned_baseline(spark):
    runs = spark.createDataFrame([(1, "v", 0.05), (2, "v", 0.06), (3, "v", 0.10)], "run_id long, provider string, mean double")
    assert [(r.run_id, r.previous) for r in reports.regressions(runs, "run_id", ["provider"], baseline=1).collect()] == [(3, 0.05)]
    assert [(r.run_id, r.previous) for r in reports.regressions(runs, "run_id", ["provider"]).collect()] == [(3, 0.06)]


def test_store(spark, tmp_path):
    store.bootstrap(spark, str(tmp_path))
    assert store.table(spark, str(tmp_path), "runs").count() == 0
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, store.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [tuple(r) for r in store.new_rows(new, old, "k").collect()] == [(3, "d")]
    with pytest.raises(ValueError):
        store.set_baseline(spark.createDataFrame([(1, False)], "id long, is_baseline boolean"), 9)
    lines = ["# comment", "", "a01-000u-00 ok 154 1 408 768 27 51 A MOVE IN", "a01-000u-01 err 154 1 4 7 2 5 X", "a01-001-00 ok 154 1 408 768 27 51 THE LONG|WAY", "short line"]
    got = store.parse_iam_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.writer, r.form, r.text) for r in got] == [("a01", "a01-000u", "A MOVE IN"), ("a01", "a01-001", "THE LONG WAY")]


def test_store_grows(spark, tmp_path):
    table = lambda k: spark.createDataFrame([], store.SCHEMAS[k]).drop("created_at")
    told = spark.createDataFrame([("h", "p.png", "w1", "as read", "as meant", 0.5, "labgrader")] * 2, "image_hash string, image_path string, writer string, original string, corrected string, confidence double, source string")
    first = store.record_corrections(table("samples"), table("ground_truths"), table("corrections"), told.limit(1))
    again = store.record_corrections(*first, told.limit(1))
    assert [t.count() for t in first] == [1, 1, 1] and [t.count() for t in again] == [1, 1, 2] and again[2].select("ground_truth_id").distinct().count() == 1
    with pytest.raises(ValueError):
        store.insert_samples(again[0], again[0])
    cache = spark.createDataFrame([("a", 1), ("b", 0)], "cache_key string, hit_count long")
    found, after = store.cache_get(cache, spark.createDataFrame([("a",), ("a",), ("z",)], "cache_key string"))
    assert [r.cache_key for r in found.collect()] == ["a"] and tuple(store.cache_stats(after).head()) == (2, 3)
    assert store.without_key(cache, "cache_key", "a").count() == 1
    (tmp_path / "one.json").write_text('{"writer_id": "w",\n "confusion_resolutions": {"rn\u2194m": "rn"}}')
    (tmp_path / "bad.json").write_text("{no")
    (tmp_path / "none.json").write_text('{"open_four": true}')
    assert [(r.writer_id, r.confusion_resolutions) for r in store.read_profiles(spark, str(tmp_path)).collect()] == [("w", {"rn\u2194m": "rn"})]
    (tmp_path / "words").write_text("Zebra\nab\ncell\ngene's\nmitosis\n")
    assert [r.word for r in store.read_words(spark, str(tmp_path / "words")).collect()] == ["cell", "mitosis"]
    lessons = spark.createDataFrame([("Model read 'a' but correct reading is 'b'",), ("other",)], "text string")
    assert store.lesson_patterns(lessons).head().n == 1
    results = spark.createDataFrame([(1, "x", 0.2, None), (2, "y", 0.0, None), (3, "z", 0.3, "e")], "sample_id long, output_text string, cer double, error string")
    truths = spark.createDataFrame([(1, 1, "old", "manual"), (2, 1, "new", "manual"), (3, 2, "t", "manual")], "id long, sample_id long, text string, source string")
    assert [tuple(r) for r in store.errors_for_lessons(results, truths).collect()] == [(1, "x", "new")]
    assert value(spark, store.model_versions(F.array(F.lit("a"), F.lit("b")), {"a": "m1"})) == "a/m1,b/unknown"
    parts = {r.p: r.n for r in spark.range(20_000).groupBy(store.split_of(F.col("id")).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert 850 < parts["val"] < 1150 and 850 < parts["test"] < 1150 and sum(parts.values()) == 20_000
    key = store.cache_key(F.lit("p"), F.lit("i" * 3000), F.lit("q"), F.lit("s"))
    assert value(spark, key) == hashlib.sha256(("p|" + "i" * 2000 + "|3000|q|s").encode()).hexdigest()
    more = store.add_lessons(spark.createDataFrame([("c", "known", "1")], "category string, text string, ts string"), spark.createDataFrame([("c", " known ", "2"), ("c", "fresh", "3"), ("c", " ", "4")], "category string, text string, ts string"))
    assert [r.text for r in more.collect()] == ["fresh"]


def test_many_profiles_are_dealt_out(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(40)], "k int, v array<double>")
    p = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(30)], "w int, centroid array<double>")
    want = sorted(map(tuple, similarity.nearest_profile(v, "k", "v", p, "w", 0.95).collect()))
    monkeypatch.setattr(similarity, "FEW", 40)
    assert sorted(map(tuple, similarity.nearest_profile(v, "k", "v", p, "w", 0.95).collect())) == want
    assert {x[1] is None for x in want} == {True, False}


def test_similar_texts_and_profiles(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y"), (4, "x y"), (5, ""), (6, "a b c d e g")]
    frame = spark.createDataFrame(rows, "k long, t string")
    assert sorted((r.a, r.b, r.score) for r in similarity.similar_texts(frame, "k", "t").collect()) == [(1, 2, 1.0), (3, 4, 1.0)]
    assert {(r.a, r.b) for r in similarity.similar_texts(frame, "k", "t", 0.5).collect()} == {(1, 2), (3, 4), (1, 6), (2, 6)}
    assert value(spark, numeric.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_stream_matches_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    query = events.windowed(spark.readStream.schema(rows.schema).parquet(f"{SF}/events.parquet*")).writeStream.outputMode("complete").format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path)).start()
    query.processAllAvailable()
    query.stop()
    streamed, batch = (sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in df.collect()) for df in (spark.table("windowed"), events.windowed(rows)))
    assert streamed == batch and len(batch) > 0


def test_registered_sql_agrees(spark):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name in ("run_report", "recommend", "compare_runs", "signed_rank", "single_confidence", "confidence_level", "line_dedupe", "within_one_edit", "answer_regions", "text_similarity_pairs", "identify_writer", "run_summary", "report_table", "flag_anomalies", "record_correction", "training_pairs", "ink_runs", "page_batches"):
        ours = catalogue.QUERIES[name](spark, SF)
        rows = con.execute(catalogue.ORACLE[name])
        names = [d[0] for d in rows.description]
        assert sorted(names) == sorted(ours.columns)
        assert sorted(map(str, rows.fetchall())) == sorted(str(tuple(r)) for r in ours.select(*names).collect()), name
