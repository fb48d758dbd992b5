"""Edit distances of several pairs at once, within diagonals that their surplus elements leave."""

import random

from inkledger.functions import text


def pairs(seed: int, rounds: int):
    r = random.Random(seed)
    for _ in range(rounds):
        own = "abcdefghijklmnopqrstuvwxyzäöü中𝄞"[: r.choice((1, 2, 3, 5, 30))]
        a = [r.choice(own) for _ in range(r.choice((0, 1, 5, 70, 300)))]
        b = [x if r.random() < 0.8 else r.choice(own + "#") for x in a if r.random() < 0.95]
        b = b[len(b) // 2 :] + b[: len(b) // 2] if r.random() < 0.2 else b
        x, y = (a, b) if r.random() < 0.5 else (b, a)
        yield ("".join(x), "".join(y)) if r.random() < 0.5 else (x, y)


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_pairs_together_have_the_distances_of_each(monkeypatch):
    some = list(pairs(1, 120))
    want = [plain(a, b) for a, b in some]
    for narrow, together in ((text.NARROW, text.TOGETHER), (200, 500), (1 << 17, 1 << 17), (0, 1)):
        monkeypatch.setattr(text, "NARROW", narrow)
        monkeypatch.setattr(text, "TOGETHER", together)
        assert text.distances(some) == want
    assert [text.distance(a, b) for a, b in some] == want


def test_a_piece_takes_few_tables(spark, monkeypatch):
    """Before, each pair had a table of its own."""
    tables, together = [], text._together
    monkeypatch.setattr(text, "_together", lambda group: tables.append(len(group)) or together(group))
    r = random.Random(2)
    some = [("".join(r.choice("abcdefgh") for _ in range(400)),) for _ in range(100)]
    some = [(a, a.translate(str.maketrans("ae", "oc"))) for (a,) in some]
    assert text.distances(some) == [text.distance(a, b) for a, b in some] and sum(tables) == 100 and len(tables) <= 5


def test_texts_are_normalised_once(spark, tmp_path):
    from inkledger import catalogue

    spark.createDataFrame([(1, "A [?]  be [unclear]\tc ??? unable to Read e"), (2, "plain"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = catalogue.QUERIES["cer_pairs"](spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("unable to read,") <= 2  # one of each text; before, wherever it was named
    assert {r.doc_id: (r.edits, r.ref_size) for r in out.collect()} == {1: (plain("a bc [unclcor] c unoblc ta rcod c", "a be c e"), 8), 2: (1, 5), 3: (None, None)}
