"""Interaction audit of filters: what every order of them removes, step by step, from one SQL CUBE.

Five failure flags are computed for each document; rows are counted by part and flags (at most 32 rows a part) before a
CUBE over part and flags sums those counts. A grouping-set row whose selected flags are all false counts the documents
that survive exactly that subset of filters, so the 64 grouping sets hold the survivors of all 32 subsets, by part and
over the whole table. A step of an order is a pair of subsets, before and after its filter: 80 pairs a part are joined
and serve the 600 steps of all 120 orders.

Filters: A under 200 words; B fewer than half of the words distinct; C more than 2 capitals A-Z in 100 code points; D any
of ``#$%&*|``; E the text of a smaller doc_id, anywhere in the table.

Defined cases: null text: empty (it fails A, and E after a smaller id's empty text). Null doc_id: never fails E and makes
no other row fail it, and has no labels. Rows of one doc_id and text are not duplicates of each other. Very long texts are
read whole. A null source and the empty one are one part. A document labelled more than once is good (toxic) if any label
says so; null labels say nothing. Empty table: no rows. Extra columns are not read, whatever their names.

Copies meet only as digests: one (digest, smallest id) row each that map tasks combine, joined back to narrow rows by a
join that Spark can split where one text holds many of them.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkledger.llm import common as c

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 2, r"[#$%&*|]"


def flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and the four flags that a text decides alone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split("body", r"[\x20\x09-\x0D]+"), "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("body"))
    rows = rows.select("doc_id", "part", "body", words.alias("words"))
    few = F.size("words") < LEAST_WORDS
    same = F.size(F.array_distinct("words")) * 100 < F.size("words") * DISTINCT_PERCENT
    capitals = F.regexp_count("body", F.lit("[A-Z]")).cast("long") * 100 > F.char_length("body").cast("long") * CAPITAL_PERCENT
    return rows.select("doc_id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), few.alias("A"), same.alias("B"), capitals.alias("C"), F.rlike("body", F.lit(MARKS)).alias("D"))


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, the five flags, good and toxic of every row."""
    rows = c.write_table(flags(docs), "audit-flags")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(firsts, "digest", "left").join(marks, "doc_id", "left")
    own = [F.coalesce(F.col(k), F.lit(False)).cast("long").alias(k) for k in ("good", "toxic")]
    return rows.select("part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"), *own)


def survivors(rows: DataFrame) -> DataFrame:
    """whole, part (null where whole), subset, kept, good, toxic: what passes every filter of each of the 32 subsets, zeros included.

    Bit i of ``subset`` stands for the i-th filter; ``whole`` rows are those over all parts.
    """
    few = rows.groupBy("part", *FILTERS).agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("g"), F.sum("toxic").alias("t"))
    selected = sum(((1 - F.grouping(k).cast("int")) * (1 << i) for i, k in enumerate(FILTERS)), F.lit(0))
    sums = [F.sum("n").alias("kept"), F.sum("g").alias("good"), F.sum("t").alias("toxic")]
    cube = few.cube("part", *FILTERS).agg(selected.alias("subset"), (F.grouping("part") == 1).alias("whole"), *sums)
    passing = cube.where(" and ".join(f"not coalesce({k}, false)" for k in FILTERS)).drop(*FILTERS)
    parts = few.select("part").distinct().select(F.lit(False).alias("whole"), "part")
    parts = parts.unionByName(few.limit(1).select(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("part")))
    grid = parts.withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(ALL)))).alias("w")
    p = passing.where("whole or part is not null").alias("p")
    found = grid.join(p, F.expr("w.whole = p.whole and w.part <=> p.part and w.subset = p.subset"), "left")
    return found.select("w.*", *(F.coalesce(F.col(f"p.{k}"), F.lit(0).cast("long")).alias(k) for k in ("kept", "good", "toxic")))


def _orders(spark) -> DataFrame:
    """The 600 steps of all orders: filter_order, step, the subset before it, and its filter's number."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            steps.append((name, step, before, i))
            before |= 1 << i
    return spark.createDataFrame(steps, "filter_order string, step int, before int, own int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """whole, part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part, order and step, and the same over all parts (``whole``, part null).
    """
    spark = docs.sparkSession
    grid = c.write_table(survivors(marked(docs, labels)), "audit-survivors")
    n = len(FILTERS)
    free = F.expr(f"filter(sequence(0, {n - 1}), i -> (subset & shiftleft(1, i)) = 0)")
    before = grid.select("*", F.explode(free).alias("own")).withColumn("upto", F.expr("subset | shiftleft(1, own)")).alias("b")
    after = grid.alias("a")
    pairs = before.join(after, F.expr("b.whole = a.whole and b.part <=> a.part and b.upto = a.subset"))
    pairs = pairs.select("b.whole", "b.part", F.col("b.subset").alias("before"), "b.own", F.col("a.kept").alias("kept"), *((F.col(f"b.{x}") - F.col(f"a.{x}")).alias(y) for x, y in (("kept", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))))
    own = Window.partitionBy("whole", "part", "own")
    fails = F.sum(F.when(F.col("before") == 0, F.col("removed"))).over(own)
    alone = F.sum(F.when(F.expr(f"before = ({ALL} ^ shiftleft(1, own))"), F.col("removed"))).over(own)
    shares = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.bit_count("before") + 1)
    pairs = pairs.withColumn("redundant", fails - F.col("removed")).withColumn("unique_fails", alone).withColumn("shapley", F.sum(shares * F.col("removed")).over(own))
    out = pairs.join(F.broadcast(_orders(spark)), ["before", "own"])  # 600 rows
    return out.select("whole", "part", "filter_order", "step", *(F.col(k).cast("long").alias(k) for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")))


_ORACLE_FLAGS = r"""
    d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
        regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fail, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM d LEFT JOIN l USING (doc_id))"""

#: Another way than the operator's: every document walks every order of the filters.
ORACLE = rf"""
  WITH RECURSIVE {_ORACLE_FLAGS},
  o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || y FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS y) WHERE NOT contains(filter_order, y) AND len(filter_order) < 5),
  s AS (SELECT filter_order, step::INTEGER AS step, instr('ABCDE', substr(filter_order, step::INT, 1))::INT AS own, list_transform(range(1, step), lambda i: instr('ABCDE', substr(filter_order, i::INT, 1))::INT) AS earlier
        FROM o, range(1, 6) r(step) WHERE len(filter_order) = 5),
  g AS (SELECT part, fail, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fail),
  e AS (SELECT part, filter_order, step, own, n, good, toxic, fail[own] AS fails, len(list_filter(earlier, lambda i: fail[i])) > 0 AS gone, len(list_filter(fail, lambda x: x)) AS failed FROM g, s),
  a AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost FROM e GROUP BY ALL)
  SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM a"""
