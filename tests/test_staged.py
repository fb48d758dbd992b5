"""Strategies that ask in stages: who is asked, and what is answered, sample by sample."""

from difflib import SequenceMatcher

import pytest
from inkledger.operators import staged
from inkledger.operators.voting import line_words
from pyspark.sql import functions as F

LONG = "the quick brown fox jumps over the lazy dog near the river bank"
READINGS = {
    # sample: what gemini, openai and claude read; None: the call fails, absent: no row
    1: {"gemini": LONG, "openai": LONG, "claude": LONG},
    2: {"gemini": LONG, "openai": "another reading altogether of some page", "claude": "another reading altogether of some page"},
    3: {"gemini": None, "openai": LONG, "claude": LONG},
    4: {"gemini": None, "openai": None, "claude": None},
    5: {"gemini": "", "openai": LONG, "claude": LONG},
    6: {"gemini": "one", "openai": "two", "claude": "three"},
    7: {"openai": LONG},
    8: {"gemini": f"{LONG} [?] [?]", "openai": f"{LONG} [?] one", "claude": "[?] [?] [?] [?] [?]"},
}


class Counting:
    """A reader over READINGS that keeps who was asked about what."""

    def __init__(self, spark, readings=READINGS):
        self.spark, self.readings, self.calls = spark, readings, []

    def __call__(self, samples, provider, task):
        rows = samples.collect()
        self.calls.append((provider, task, sorted(r.sample_id for r in rows)))
        out = []
        for r in rows:
            own = self.readings[r.sample_id]
            if provider in own:
                text = own[provider]
                if task == "review":
                    text = r.prior.replace("[?]", "word", 1)
                if task == "resolve" and "prior" in samples.columns:
                    text = r.prior.replace("[?]", "word", 1)
                out.append((r.sample_id, text, "failed" if text is None else None))
        return self.spark.createDataFrame(out, "sample_id long, text string, error string")


@pytest.fixture
def samples(spark):
    return spark.createDataFrame([(k,) for k in READINGS], "sample_id long")


def agree(a, b):
    p, q = line_words(a), line_words(b)
    return SequenceMatcher(None, p, q).ratio() if p and q else float(not p and not q)


def single(spark, texts):
    from inkledger.functions import text

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.single_confidence(F.col("t")).alias("c"))
    return {r.t: r.c for r in df.collect()}


def plain_cascade(spark, threshold, order=("gemini", "openai", "claude")):
    alone = single(spark, {t for own in READINGS.values() for t in own.values() if t is not None})
    out = {}
    for k, own in READINGS.items():
        chain, asked = [], 0
        for p in order:
            asked += 1
            t = own.get(p)
            if t is None:
                continue
            if chain:
                a = agree(chain[-1][1], t)
                if a >= threshold:
                    out[k] = (t, round(min(0.95, a), 3), f"cascade_{p}_validated", asked)
                    break
            elif alone[t] >= threshold:
                out[k] = (t, round(alone[t], 3), f"cascade_{p}", asked)
                break
            chain.append((p, t))
        else:
            if not chain:
                out[k] = ("", 0.0, "cascade_failed", asked)
            else:
                c = agree(chain[-2][1], chain[-1][1]) if len(chain) > 1 else alone[chain[-1][1]]
                out[k] = (chain[-1][1], round(c, 3), f"cascade_best_effort_{chain[-1][0]}", asked)
    return out


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_cascade_equals_sample_by_sample(spark, samples, threshold):
    ask = Counting(spark)
    got = {r.sample_id: (r.text, r.confidence, r.strategy, r.asked) for r in staged.cascade(samples, ask, threshold=threshold).collect()}
    want = plain_cascade(spark, threshold)
    assert got == want
    # only samples that are still open were asked, each once
    for at, provider in enumerate(("gemini", "openai", "claude"), 1):
        assert [c[2] for c in ask.calls if c[0] == provider] == [sorted(k for k, v in want.items() if v[3] >= at)]


def test_results_may_be_used_twice_without_asking_again(spark, samples):
    ask = Counting(spark)
    out = staged.cascade(samples, ask)
    before = len(ask.calls)
    assert out.count() == out.count() == len(READINGS) and len(ask.calls) == before == 3


def test_an_empty_first_answer_needs_agreement_later(spark, samples):
    got = {r.sample_id: r for r in staged.cascade(samples, Counting(spark), threshold=0.7).collect()}
    assert got[5].strategy == "cascade_claude_validated" and got[5].asked == 3


def test_first_answer_asks_the_next_only_after_a_failure(spark, samples):
    ask = Counting(spark)
    got = {r.sample_id: (r.text, r.strategy, r.asked) for r in staged.first_answer(samples, ask, ["gemini", "openai"]).collect()}
    assert ask.calls == [("gemini", "read", [1, 2, 3, 4, 5, 6, 7, 8]), ("openai", "read", [3, 4, 7])]
    assert got[3] == (LONG, "best_of", 2) and got[4] == ("", "best_of_failed", 2) and got[5] == ("", "best_of", 1)


def test_debate_asks_the_resolver_about_differing_readings_only(spark, samples):
    ask = Counting(spark)
    got = {r.sample_id: (r.text, r.strategy, r.asked) for r in staged.debate(samples, ask, rounds=3).collect()}
    assert [c for c in ask.calls if c[1] == "resolve"] == [("claude", "resolve", [2, 5, 6, 8]), ("claude", "resolve", [8])]
    assert got[1] == (LONG, "debate_agreed", 2) and got[7] == (LONG, "debate_single_fallback", 2)
    assert got[2] == (READINGS[2]["claude"], "debate_resolved", 3)
    assert got[8] == ("word [?] [?] [?] [?]", "debate_ice_resolved", 4)
    assert got[4][:2] == ("", "debate_single_fallback")


def test_self_correction_stops_where_nothing_is_uncertain(spark, samples):
    ask = Counting(spark)
    got = {r.sample_id: (r.text, r.strategy, r.asked) for r in staged.self_correct(samples, ask, ["gemini"], 3).collect()}
    assert [c[2] for c in ask.calls if c[2]] == [[1, 2, 3, 4, 5, 6, 7, 8], [1, 2, 6, 8], [8]]
    assert got[8] == (f"{LONG} word word", "self_correct_2pass", 3) and got[3][1] == "self_correct_failed"


def test_vote_and_smart_and_unknown_names(spark, samples):
    providers = ["gemini", "openai", "claude"]
    voted = {r.sample_id: r for r in staged.read_with_consensus(samples, Counting(spark), providers, "vote").collect()}
    assert voted[1].text == LONG and voted[4].text == "" and voted[4].level == "LOW" and voted[7].strategy == "vote_partial"
    one = staged.read_with_consensus(samples, Counting(spark), ["openai"], "vote").collect()
    assert {r.strategy for r in one} == {"vote_single_fallback"}
    with pytest.raises(ValueError, match="Unknown strategy: quorum"):
        staged.read_with_consensus(samples, Counting(spark), providers, "quorum")
    with pytest.raises(ValueError, match="no providers"):
        staged.read_with_consensus(samples, Counting(spark), [], "vote")
    marks = [(k, "good" if k < 4 else "fair" if k < 8 else "poor", 250.0, 0.7, False, 0) for k in READINGS if k != 6]
    quality = spark.createDataFrame(marks, "sample_id long, quality string, blur double, contrast double, faint boolean, issues int")
    ask = Counting(spark)
    smart = {r.sample_id: r for r in staged.read_with_consensus(samples, ask, providers, "smart", preferred=["gemini"], quality=quality, marks=1).collect()}
    assert len(smart) == len(READINGS) and smart[1].strategy == "best_of" and smart[8].strategy == "vote" and smart[6].strategy.startswith("cascade")
    assert ask.calls[0] == ("gemini", "read", [1, 2, 3])
