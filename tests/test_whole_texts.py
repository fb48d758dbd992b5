"""Queries on texts read whole texts: what a text holds late counts as what it holds early."""

from collections import Counter
from difflib import SequenceMatcher

import pytest

from inkledger import catalogue
from inkledger.functions import text
from inkledger.operators import stats, voting

SWAP = str.maketrans("aeo", "oca")
LATE = "xyz " * 60 + "banana the and bread rode home"
SHORT = "the cat and a dog"


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("late"))
    spark.createDataFrame([(1, LATE), (2, SHORT), (3, ""), (4, None)], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return {1: LATE, 2: SHORT, 3: ""}, lambda name: catalogue.QUERIES[name](spark, at).collect()


def test_distance():
    words = [f"w{k}" for k in range(45_000)]
    assert text.distance(words, words[1:] + ["x"]) == 2
    for a, b in (("", ""), ("", "ab"), ("kitten", "sitting"), ("aé世", "é世b"), ("abcd" * 40, "badc" * 37), (LATE, SHORT)):
        assert text.distance(a, b) == text.distance(b, a) == plain(a, b)


def test_error_rates_of_whole_texts(late):
    texts, run = late
    pairs = {k: (t.translate(SWAP), t) for k, t in texts.items()}
    chars, words = ({r.doc_id: (r.edits, r.ref_size, r.rate) for r in run(name) if r.doc_id != 4} for name in ("cer_pairs", "wer_pairs"))
    for k, (h, r) in pairs.items():
        for got, x, y in ((chars, h, r), (words, h.split(), r.split())):
            assert got[k] == (plain(x, y), len(y), pytest.approx(plain(x, y) / len(y) if y else 0.0))
    ratio = {k: plain(h, r) / max(len(r), 1) for k, (h, r) in pairs.items()}
    assert {r.doc_id: r.ratio for r in run("change_ratio_filter")} == {k: pytest.approx(x) for k, x in ratio.items() if x <= 0.25}
    want = {k: set(catalogue.TERM_LIST) & set(r.split()) for k, (_, r) in pairs.items()}
    assert {r.doc_id: r.total for r in run("domain_terms") if r.doc_id != 4} == {k: len(x) for k, x in want.items()}


def test_errors_and_votes_of_whole_texts(late):
    texts, run = late
    taxonomy = {r.doc_id: r for r in run("error_taxonomy")}
    lessons = Counter(r.doc_id for r in run("auto_lessons"))
    votes = {r.sample_id: r.text for r in run("consensus_vote")}
    for k, t in texts.items():
        steps = [x for x in SequenceMatcher(None, t, t.translate(SWAP)).get_opcodes() if x[0] != "equal"]
        r = taxonomy[k]
        assert r.confusion_pair + r.substitution + r.deletion == sum(j - i for _, i, j, _, _ in steps)
        assert lessons[k] == sum(x[0] != "equal" for x in SequenceMatcher(None, t.translate(SWAP).split(), t.split()).get_opcodes())
    assert len(votes[1].split()) >= len(LATE.split()) and voting.line_words(votes[1])[:60] == ["xyz"] * 60


def test_turns_and_corrections_of_whole_texts(spark, tmp_path):
    long = "same words " * 60
    spark.createDataFrame([(1, 0, long + "left"), (1, 1, long + "right")], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    late = long + "mitochondra rnembrane [?alt: p/q]"
    spark.createDataFrame([(1, late)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert [(r.pos, r.word_a, r.word_b) for r in run("word_diff")] == [(120, "left", "right")]
    assert run("agreement_ratio")[0].ratio == pytest.approx(SequenceMatcher(None, (long + "left").split(), (long + "right").split()).ratio())
    assert run("term_correction")[0].t.split()[-4:] == ["mitochondria", "rnembrane", "[?alt:", "p/q]"]
    assert run("lookalike_correction")[0].text.endswith("mitochondra membrane [?alt: p/q]") and run("lookalike_correction")[0].n == 2  # a word that begins with a digit stays
    assert run("alt_markers")[0].options == "[[p, q], [a, b], [c, d]]"


def test_bootstrap_takes_all_rounds(spark, tmp_path):
    rows = [(k, "view", k % 7, float(k * 37 % 501), "2024-01-01", '{"k": 1}') for k in range(0, 400, 4)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double, ts string, props string").write.parquet(f"{tmp_path}/events.parquet")
    values = catalogue._results(spark, str(tmp_path))
    of = lambda rounds: tuple(stats.bootstrap_mean(values, ["provider", "run_id"], "cer", rounds=rounds, seed=7).head())
    assert tuple(catalogue.QUERIES["bootstrap_interval"](spark, str(tmp_path)).head()) == of(10_000) != of(1000)
