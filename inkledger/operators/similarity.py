"""Similar texts and nearest vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.functions import numeric
from inkledger.llm import common, jaccard_join


#: Numbers in all profiles that are broadcast together.
FEW = 1 << 21


#: Copies of one text in a row; the pairs of more are dealt out by stretches of as many.
STRETCH = 1 << 10
#: White space besides ASCII's.
BLANKS = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def similar_texts(df: DataFrame, key: str, body: str, threshold: float = 0.85, n: int = 3) -> DataFrame:
    """Pairs (a, b, score), a < b, whose n-gram sets have a Jaccard similarity of ``threshold`` or more.

    Sets meet as in ``llm.jaccard_join``: by the contents of hashed parts, so grams are never exchanged one by one, and only
    the sets of clusters are compared. Low thresholds need many parts a set.
    """
    sets, links = _sets_and_links(df, key, body, threshold, n)
    return _all_pairs(sets, links)


def _all_pairs(sets: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of keys: each with the copies of its own text, and with those of linked texts."""
    own = sets.where("n_shingles > 0").groupBy("hi", "lo").agg(F.collect_list("doc_id").alias("keys"))
    at = F.sequence(F.lit(1), F.greatest(F.size("keys"), F.lit(1)), F.lit(STRETCH))
    own = own.where(F.size("keys") > 0).select("lo", F.transform(at, lambda i: F.slice("keys", i, STRETCH)).alias("keys"))
    twice = own.where((F.size("keys") > 1) | (F.size(F.col("keys")[0]) > 1)).select(F.posexplode("keys").alias("i", "ka"), "keys")
    same = twice.select("i", "ka", F.posexplode("keys").alias("j", "kb")).where("i <= j").select("ka", "kb", (F.col("i") == F.col("j")).alias("one"), F.lit(1.0).alias("score"))
    left, right = (own.select(F.col("lo").alias(k), F.col("keys").alias(f"k{k}s")) for k in ("a", "b"))
    across = links.join(left, "a").join(right, "b").select(F.explode("kas").alias("ka"), "kbs", "score").select("ka", F.explode("kbs").alias("kb"), F.lit(False).alias("one"), "score")
    # so that the pairs of one large group do not fall to one task
    dealt = same.unionByName(across).repartition(F.xxhash64("ka"), F.xxhash64("kb"))
    each = dealt.select(F.explode("ka").alias("x"), "kb", "one", "score").select("x", F.explode("kb").alias("y"), "one", "score")
    return each.where(F.when(F.col("one"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


def similar_classes(df: DataFrame, key: str, body: str, threshold: float = 0.85, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members: key, class; links: a, b, score between classes): texts of equal n-gram sets are one class, named by its least key.

    The same links as ``similar_texts``, without writing every pair of copies out.
    """
    sets, links = _sets_and_links(df, key, body, threshold, n)
    of = _named(sets)
    left, right = (of.select(F.col("lo").alias(k), F.col("class").alias(f"class_{k}")) for k in ("a", "b"))
    between = links.join(left, "a").join(right, "b").select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"), "score")
    return _members(sets, key), between


def text_classes(df: DataFrame, key: str, body: str, n: int = 3) -> DataFrame:
    """The members of ``similar_classes`` alone, without looking for links."""
    return _members(jaccard_join.describe(_docs(df, key, body), n, *_ratio(0.85)), key)


def _named(sets: DataFrame) -> DataFrame:
    return sets.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("class"))


def _members(sets: DataFrame, key: str) -> DataFrame:
    return sets.where("n_shingles > 0").join(_named(sets), ["hi", "lo"]).select(F.col("doc_id").alias(key), "class")


def _docs(df: DataFrame, key: str, body: str) -> DataFrame:
    words = F.translate(F.lower(F.coalesce(F.col(body), F.lit(""))), BLANKS, " " * len(BLANKS))
    return df.select(F.col(key).alias("doc_id"), words.alias("text")).withColumn("ver", F.crc32("text"))


def _ratio(threshold: float) -> tuple[int, int]:
    """A little less than ``threshold``; the exact score decides."""
    return max(1, int((threshold - 1e-9) * 10_000)), 10_000


def _sets_and_links(df: DataFrame, key: str, body: str, threshold: float, n: int) -> tuple[DataFrame, DataFrame]:
    """(each row's set: doc_id, n_shingles, hi, lo; links between unequal sets: a, b by ``lo``, score)."""
    docs = common.write_table(_docs(df, key, body), "similarity-texts")  # read four times
    num, den = _ratio(threshold)
    sets = jaccard_join.describe(docs, n, num, den)
    links = jaccard_join.set_links(docs, sets, n, num, den)
    exact = F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))
    return sets, links.where(exact >= threshold).select("a", "b", F.round(exact, 4).alias("score"))


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, samples, centroid): element-wise mean, scaled to length one."""
    parts = vectors.select(group, F.posexplode(vector).alias("at", "x")).groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("samples"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"])
    return parts.groupBy(group).agg(F.max("samples").alias("samples"), numeric.unit(ordered).alias("centroid"))


def nearest_profile(vectors: DataFrame, key: str, vector: str, profiles: DataFrame, group: str, threshold: float = 0.85) -> DataFrame:
    """(key, group or null, score): the most similar profile of the same width, null below ``threshold``.

    Few profiles (at most ``FEW`` numbers in all, checked) go to every task; more are dealt out in blocks, and each
    vector meets every block, so that no task holds them all.
    """
    v = vectors.select(key, F.col(vector).alias("v"), F.size(vector).alias("width"))
    p = profiles.select(group, F.col("centroid").alias("c"), F.size("centroid").alias("width"))
    numbers = p.agg(F.coalesce(F.sum("width"), F.lit(0)).alias("n")).head()["n"]
    if numbers <= FEW:
        scored = v.join(F.broadcast(p), "width")
    else:
        blocks = -(-numbers // FEW)
        p = p.withColumn("block_", F.pmod(F.xxhash64(group), F.lit(blocks)))
        v = v.withColumn("block_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("part_", F.pmod(F.xxhash64(key), F.lit(blocks)))
        p = p.withColumn("part_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        scored = v.join(p, ["width", "block_", "part_"])
    scored = scored.select(key, group, numeric.cosine(F.col("v"), F.col("c")).alias("score"))
    # the least (-score, group) is the highest score, the first group on ties, whatever the groups' type
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("less"), F.col(group).alias("own"))).alias("best"))
    score = -F.col("best.less")
    return best.select(key, F.when(score >= threshold, F.col("best.own")).alias(group), score.alias("score"))
