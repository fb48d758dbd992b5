"""Sequence matching finds its runs once, and a sample's readings meet once."""

import difflib
import random

import pytest

from inkledger.functions import matching
from inkledger.operators import voting


def texts(seed: int, rounds: int):
    r = random.Random(seed)
    for _ in range(rounds):
        k, n = r.choice((2, 4, 30, 200)), r.choice((5, 40, 400, 1500))
        a = [r.randrange(k) for _ in range(r.randrange(n))]
        b = [x if r.random() < 0.9 else r.randrange(k) for x in a if r.random() < 0.95]
        yield a, b[len(b) // 2 :] + b[: len(b) // 2] if r.random() < 0.2 else b


@pytest.mark.parametrize("pairs, runs, few", [(matching.PAIRS, matching.RUNS, matching.FEW), (100, 50, 4), (7, 3, 1)])
def test_blocks_are_the_library_s_however_few_runs_are_held(monkeypatch, pairs, runs, few):
    for name, value in (("MANY", 0), ("PAIRS", pairs), ("RUNS", runs), ("FEW", few)):
        monkeypatch.setattr(matching, name, value)
    for a, b in texts(3, 60):
        assert matching.SequenceMatcher(a, b).get_opcodes() == difflib.SequenceMatcher(None, a, b).get_opcodes()


def test_runs_are_found_once_not_once_a_block(monkeypatch):
    """A search of the stretch left over for each block reads a text as often as it has blocks."""
    searches, passes = [], []
    search, runs = matching.SequenceMatcher.find_longest_match, matching.SequenceMatcher._runs
    monkeypatch.setattr(matching.SequenceMatcher, "find_longest_match", lambda self, *s: searches.append(s) or search(self, *s))
    monkeypatch.setattr(matching.SequenceMatcher, "_runs", staticmethod(lambda *s: passes.append(1) or runs(*s)))
    r = random.Random(7)
    a = [r.randrange(200) for _ in range(3000)]
    b = [x if x % 10 else x + 1 for x in a]
    got = matching.SequenceMatcher(a, b).get_matching_blocks()
    assert got == difflib.SequenceMatcher(None, a, b).get_matching_blocks() and len(got) > 100
    assert not searches and len(passes) <= 2


def test_readings_of_a_sample_meet_once(spark, monkeypatch):
    """One exchange and one Python stage; before, texts were joined with each other and went through three."""
    rows = [(1, p, t, None, w) for p, t, w in (("claude", "the cat sat", 1.0), ("gemini", "the dog sat", 1.2), ("openai", "the cat sat", 0.8))]
    out = voting.consensus(spark.createDataFrame(rows, "sample_id long, provider string, text string, confidence double, weight double"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("EvalPython") == 1
    assert out.head()["text"] == "the cat sat"
    made = []
    init = voting.SequenceMatcher.__init__
    monkeypatch.setattr(voting.SequenceMatcher, "__init__", lambda self, a, b: made.append(1) or init(self, a, b))
    names, read = ["a", "b", "c"], ["one two three four", "one two three five", "one two three six"]
    assert voting.vote_readings(names, read, [4.0, 2.0, 1.0])["text"] == "one two three four" and len(made) == 3  # not again for the vote along the first
