"""Similar texts meet by parts of their sets: against brute force, and without an exchange of single grams."""

import random

from inkledger.operators import similarity


def grams(text, n=3):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def near_copies(seed, groups=12):
    r, rows = random.Random(seed), [(900, ""), (901, None), (902, " \t"), (903, "One two"), (904, "one two"), (905, "One  TWO\n")]
    for g in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([2, 5, 30, 120, 400]))]
        for k in range(8):
            words = base[:]
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                words[r.randrange(len(words))] = f"x{r.randrange(9)}"
            rows.append((g * 8 + k, " ".join(words)))
    return rows


def test_pairs_equal_brute_force(spark):
    """Repeated keys with different texts are separate rows."""
    rows = near_copies(3) + [(1, "e f g h i j"), (2, "e f g h i j"), (1, "k l m n o p"), (3, "k l m n o p")]
    sets = [(k, grams(t)) for k, t in rows]
    for threshold in (0.85, 0.6, 1.0):
        want = sorted((min(a, b), max(a, b), round(len(x & y) / len(x | y), 4)) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if a != b and x and y and len(x & y) / len(x | y) >= threshold)
        got = similarity.similar_texts(spark.createDataFrame(rows, "k int, t string"), "k", "t", threshold)
        assert sorted(map(tuple, got.collect())) == want


def test_many_copies_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(similarity, "STRETCH", 3)
    rows = [(k, "a b c d") for k in range(8)] + [(20 + k, " ".join("abcdefghijklmnopqrstuvwxyz")) for k in range(4)] + [(30 + k, " ".join("abcdefghijklmnopqrstuvwxyz") + " end") for k in range(4)]
    got = [(r.a, r.b) for r in similarity.similar_texts(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()]
    groups = [range(8), [*range(20, 24), *range(30, 34)]]
    assert sorted(got) == [(a, b) for g in groups for a in g for b in g if a < b]


def test_grams_are_not_exchanged_one_by_one(spark):
    r = random.Random(5)
    rows = [(k, " ".join(f"w{r.randrange(10**6)}" for _ in range(3000))) for k in range(20)]
    store, gate = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def written():
        stages = store.stageList(None, False, False, gate.new_array(gate.jvm.double, 0), gate.jvm.java.util.ArrayList())
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    before = set(written())
    assert similarity.similar_texts(spark.createDataFrame(rows, "k long, t string"), "k", "t").count() == 0
    assert sum(n for k, n in written().items() if k not in before) < 20 * 3000 / 4


def test_classes_and_links(spark):
    rows = [(4, "a b c d e"), (2, "A b  c d\u00a0e"), (7, "a b c d f"), (9, "a b c d e"), (1, None)]
    frame = spark.createDataFrame(rows, "k long, t string")
    members, links = similarity.similar_classes(frame, "k", "t", 0.5)
    want = [(2, 2), (4, 2), (7, 7), (9, 2)]
    assert sorted(map(tuple, members.collect())) == sorted(map(tuple, similarity.text_classes(frame, "k", "t").collect())) == want
    assert list(map(tuple, links.collect())) == [(2, 7, 0.5)]
