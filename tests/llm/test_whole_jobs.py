"""Cases in which an operator once did less than its whole job."""

from collections import Counter

from inkledger.llm import jaccard_join, mixing


def test_op7_repeated_rows_are_taken_on_their_own(spark):
    rows = [(1, "ten words of one text in a group of copies", "a")] * 201 + [(1, "ten words of one text in a group of copies", "b")] * 60
    rows += [(None, "no id", None), (2, "", "a"), (3, None, "b"), *((10 + k, f"text {k} " * (k % 9 + 1), "abc"[k % 3]) for k in range(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.taken(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    taken, mixed, goal, size = Counter(), Counter(), {}, {}
    for r in got:
        taken[r.doc_id] += r.taken
        goal[r.source_size, r.target] = r.target
        size[r.doc_id] = r.size
    by = Counter()
    for r in mixing.mix(docs).collect():
        mixed[r.doc_id] += len(r.text.split())
        by[r.source] += len(r.text.split())
    assert mixed == +taken
    assert sum(by.values()) == sum(taken.values()) > 0
    assert all(abs(x - y) <= 10 for x, y in zip(sorted(by.values()), sorted(goal.values())))
    for columns in (docs.repartition(2), docs.repartition(7)):
        assert Counter((r.doc_id, r.source) for r in mixing.mixed_documents(columns).collect()) == Counter((r.doc_id, r.source) for r in mixing.mix(docs).collect())


def test_keep_one_leaves_one_row_of_each_group(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "uvwxyz"}
    near = {k: f"{t} tail" for k, t in text.items()}
    rows = [(None, text[k]) for k in "xxyy"]  # two groups without ids
    rows += [(7, text[k]) for k in "uuvv"]  # one id, two texts
    rows += [(None, text["w"]), (None, near["w"]), (8, text["z"]), (8, near["z"])]  # near copies that share an id or have none
    rows += [(None, ""), (None, ""), (9, None), (9, None), (3, near["u"]), (None, text["v"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.keep_one(docs).collect()
    of = {t: k for k in text for t in (text[k], near[k])}
    assert Counter(of[r.text] for r in got if r.text) == dict.fromkeys("uvwxyz", 1)
    assert {of[r.text]: r.doc_id for r in got if r.text} == {"u": 3, "v": 7, "w": None, "x": None, "y": None, "z": 8}
    assert Counter(r.doc_id for r in got if not r.text) == {None: 2, 9: 2}
