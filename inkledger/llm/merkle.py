"""A Merkle manifest of a table of documents: leaves, subroots by source, one root, and proofs that are checked.

A row's leaf is the digest of its five fields; a source's leaves ascend by doc_id; every 16 consecutive nodes become
one while several remain. Trees are built with higher-order SQL functions: blocks of 4,096 leaves (three levels) are
ordered arrays that ``sequence``, ``transform``, ``slice`` and ``aggregate`` collapse, and the block roots are the leaves of the
next round, so a source of any size takes ceil(log16(n) / 3) rounds and no task holds more than a block. The subroots,
ordered by source, go through the same rounds. Proofs come back down: each block hands its nodes the siblings above
it, and round 0 folds every (tampered) leaf with its siblings up to a root.

``tampered`` changes rows on purpose, by lower-casing A-Z in the text of those whose id's crc32 is a multiple of five; a
proof of such a row must fail unless its text has no capitals.

Defined cases: null fields are ``-`` in a leaf, so a null and an empty text differ; a null source is a source and comes first;
a null doc_id comes first in its source and is never tampered. Rows equal in source and doc_id are ordered by their
leaves; equal rows are separate leaves. A lone leaf is its source's subroot, a lone subroot the root; the proof of a table of
one row is the digest of nothing. Very long texts are hashed whole. Empty table: no rows. Extra columns are not read, whatever their names.

Places inside a source come from one range exchange of narrow rows (ties are broken by a row's number, so that equal
rows split too) and counts by range; no window runs over a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.llm import common as c

FAN_BITS, LEVELS = 4, 3
BLOCK_BITS = FAN_BITS * LEVELS
#: Rows of a range when places are counted.
RANGE_ROWS = 1 << 18
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _field(value: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """source, doc_id, leaf, and bad: the leaf of the tampered row where that differs."""
    own = {k: F.col(k).cast("string") for k in ("doc_id", "source", "lang", "n_chars", "text")}
    leaf = lambda text: F.sha2(F.concat(*(_field(own[k]) for k in ("doc_id", "source", "lang", "n_chars")), _field(text)), 256)
    picked = F.crc32(own["doc_id"]) % 5 == 0
    bad = F.when(picked & F.rlike(own["text"], F.lit("[A-Z]")), leaf(F.translate(own["text"], CAPITALS, CAPITALS.lower())))
    return docs.select(own["source"].alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf(own["text"]).alias("leaf"), bad.alias("bad"))


def placed(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``df`` with ``pos``, a row's place from 0 in its group by ``order``, and the group's ``total``."""
    spark = df.sparkSession
    rows = c.write_table(df.withColumn("salt_", F.xxhash64(F.monotonically_increasing_id())), "merkle-rows")
    ranges = max(c.partitions(spark), -(-rows.count() // RANGE_ROWS))
    rows = c.write_table(rows.repartitionByRange(ranges, group, *order, "salt_").withColumn("range_", F.spark_partition_id()), "merkle-ranges")
    by = Window.partitionBy(group)
    counts = rows.groupBy(group, "range_").agg(F.count(F.lit(1)).alias("n_"))
    upto = F.coalesce(F.sum("n_").over(by.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(group).alias("group_"), F.col("range_").alias("at_"), upto.alias("upto_"), F.sum("n_").over(by).alias("total"))
    inside = F.row_number().over(Window.partitionBy(group, "range_").orderBy(*order, "salt_")) - 1
    rows = rows.withColumn("inside_", inside)
    found = rows.join(counts, F.col(group).eqNullSafe(F.col("group_")) & (F.col("range_") == F.col("at_")))
    return found.select(*df.columns, (F.col("inside_") + F.col("upto_")).cast("long").alias("pos"), F.col("total").cast("long").alias("total"))


def _height(total: str) -> Column:
    """Levels that a tree of so many leaves has above them."""
    at = F.when(F.col(total) <= 1, 0)
    for h in range(1, 15):
        at = at.when(F.col(total) <= 1 << (FAN_BITS * h), h)
    return at.otherwise(15)


#: One level up: runs of 16 nodes become their digests.
_COLLAPSED = "transform(sequence(0, (size(element_at(up, -1)) - 1) div 16), i -> sha2(array_join(slice(element_at(up, -1), i * 16 + 1, 16), ''), 256))"
#: All levels of a block from its leaves.
_LEVELS = f"if(k > 0, aggregate(sequence(1, k), array(nodes.node), (up, l) -> array_append(up, {_COLLAPSED})), array(nodes.node))"
#: The siblings (b: before, a: after) of the block's node i, level by level.
_INDEX = "shiftright(i, 4 * l)"
_OWN = f"transform(if(k > 0, sequence(0, k - 1), cast(array() as array<int>)), l -> named_struct('b', array_join(slice(levels[l], {_INDEX} - {_INDEX} % 16 + 1, {_INDEX} % 16), ''), 'a', array_join(slice(levels[l], {_INDEX} + 2, 15 - {_INDEX} % 16), '')))"
PATH = "array<struct<b:string,a:string>>"


def _round(nodes: DataFrame, at: int) -> DataFrame:
    """One round of trees: block rows with their nodes, levels and root, from (group_, pos, total, node, item)."""
    block = F.expr(f"shiftright(pos, {BLOCK_BITS})")
    rows = nodes.groupBy("group_", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "node", "item"))).alias("nodes"), F.max("total").alias("total"))
    rows = rows.withColumn("k", F.greatest(F.lit(0), F.least(F.lit(LEVELS), _height("total") - LEVELS * at)))
    rows = rows.select("group_", "block", "total", "k", F.expr("nodes.item").alias("items"), F.expr(_LEVELS).alias("levels"))
    rows = rows.withColumn("root", F.expr("element_at(element_at(levels, -1), 1)"))
    return c.write_table(rows, f"merkle-round-{at}")


def grow(nodes: DataFrame) -> list[DataFrame]:
    """The rounds of every group's tree, lowest first, from (group_, pos, total, node, item); the last has one block a group."""
    rounds = [_round(nodes, 0)]
    while not rounds[-1].where("block > 0").isEmpty():
        below = rounds[-1].select("group_", F.col("block").alias("pos"), "total", F.col("root").alias("node"), F.lit(None).cast("int").alias("item"))
        rounds.append(_round(below, len(rounds)))
    return rounds


def _under(rows: DataFrame, above: DataFrame) -> DataFrame:
    """Block rows with ``path``, the siblings above the block's root, from (group_, block, path)."""
    r, a = rows.alias("r"), above.alias("a")
    return r.join(a, F.expr("r.group_ <=> a.group_ and r.block = a.block")).select("r.*", "a.path")


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest round's blocks with ``path`` up to the root; ``above`` has (group_, path) over each group's own root."""
    above = above.select("group_", F.lit(0).cast("long").alias("block"), "path")
    for rows in reversed(rounds[1:]):
        nodes = F.expr(f"transform(sequence(0, size(levels[0]) - 1), i -> named_struct('at', cast(i as long), 'path', concat({_OWN}, path)))")
        above = _under(rows, above).select("group_", "block", F.inline(nodes)).select("group_", F.expr(f"shiftleft(block, {BLOCK_BITS}) + at").alias("block"), "path")
    return _under(rounds[0], above)


_PROOF = "sha2(array_join(transform(p, q -> concat(q.b, q.a)), ''), 256)"
_FOLD = "aggregate(p, coalesce(items[i].bad, levels[0][i]), (node, q) -> sha2(concat(q.b, node, q.a), 256))"
_ROWS = f"transform(sequence(0, size(items) - 1), i -> element_at(transform(array(concat({_OWN}, path)), p -> named_struct('doc_id', items[i].doc_id, 'leaf', levels[0][i], 'proof_sha256', {_PROOF}, 'folded_root', {_FOLD})), 1))"


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    rows = placed(leaves(docs), "source", "doc_id", "leaf")
    trees = grow(rows.select(F.col("source").alias("group_"), "pos", "total", F.col("leaf").alias("node"), F.struct("doc_id", "bad").alias("item")))
    subroots = trees[-1].select(F.col("group_").alias("source"), F.col("root").alias("subroot"), F.lit(0).alias("one"))
    order = placed(subroots, "one", "source")
    top = grow(order.select(F.col("one").alias("group_"), "pos", "total", F.col("subroot").alias("node"), F.struct("source").alias("item")))
    peak = top[-1].select("group_", F.expr(f"cast(array() as {PATH})").alias("path"))
    peak_row = top[-1].select("root").head()  # one digest, none for an empty table
    root = F.lit(peak_row["root"] if peak_row else None).cast("string").alias("root")
    each = F.expr(f"transform(sequence(0, size(items) - 1), i -> named_struct('source', items[i].source, 'subroot', levels[0][i], 'path', concat({_OWN}, path)))")
    sources = c.write_table(descend(top, peak).select(F.inline(each)), "merkle-sources").alias("s")
    blocks = descend(trees, sources.select(F.col("source").alias("group_"), "path")).alias("b")
    found = blocks.select(F.col("b.group_").alias("group_"), F.inline(F.expr(_ROWS))).alias("d").join(sources, F.expr("d.group_ <=> s.source")).select("d.*", "s.source", "s.subroot", root)
    return found.select("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _oracle(depth: int = 6) -> str:
    """SQL that builds the trees level by level, for sources and tables of sources of at most 16^depth nodes."""
    field = lambda x: f"coalesce(strlen({x})::VARCHAR || ':' || {x}, '-')"
    leaf = lambda t: "sha256(" + " || ".join(field(x) for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", t)) + ")"
    rounds = "list_reduce(list_prepend(xor(acc, byte), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda acc, byte: {rounds}), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"d AS (SELECT row_number() OVER () AS own, doc_id, source, {leaf('text')} AS leaf, CASE WHEN ({crc}) % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS bad FROM documents)",
        "a0 AS (SELECT own, doc_id, coalesce('s' || source, '') AS g, leaf, bad, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)",
        "n0 AS (SELECT g, pos, leaf AS h FROM a0)",
    ]

    def climb(n: str, key: str) -> None:
        for k in range(depth):
            parts.append(f"{n}{k + 1} AS (SELECT {key}, CASE WHEN any_value(n) = 1 THEN 0 ELSE pos // 16 END AS pos, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {n}{k}) GROUP BY {key}, pos // 16)")

    climb("n", "g")
    parts.append(f"m0 AS (SELECT 1 AS one, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, g, h FROM n{depth})")
    climb("m", "one")
    parts.append("p0 AS (SELECT own, a0.doc_id, a0.g, leaf, a0.pos, m0.pos AS top, m0.h AS subroot, '' AS proof, bad AS folded FROM a0 JOIN m0 ON a0.g = m0.g)")
    step = 0
    for n, place, key in [*((f"n{k}", f"(p.pos // {16**k})", "p.g = x.g AND ") for k in range(depth)), *((f"m{k}", f"(p.top // {16**k})", "") for k in range(depth))]:
        run = f"{key}x.pos // 16 = {place} // 16"
        before = f"coalesce((SELECT string_agg(x.h, '' ORDER BY x.pos) FROM {n} x WHERE {run} AND x.pos < {place}), '')"
        after = f"coalesce((SELECT string_agg(x.h, '' ORDER BY x.pos) FROM {n} x WHERE {run} AND x.pos > {place}), '')"
        several = f"(SELECT count(*) FROM {n} x WHERE {key}true) > 1"
        parts.append(f"q{step} AS (SELECT *, {before} AS b, {after} AS a, {several} AS more FROM p{step} p)")
        parts.append(f"p{step + 1} AS (SELECT * EXCLUDE (b, a, more) REPLACE (proof || b || a AS proof, CASE WHEN more THEN sha256(b || folded || a) ELSE folded END AS folded) FROM q{step})")
        step += 1
    return "WITH " + ",\n".join(parts) + f" SELECT doc_id, leaf, subroot, m.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = m.h AS verified FROM p{step}, m{depth} m"


ORACLE = _oracle(4)
