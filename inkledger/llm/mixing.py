"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. DataFrame functions only.

Sizes are words. Sources, by code point with null last, share ``budget`` times all words by weight; a source stops at
``cap`` times its size and the excess is shared out again by weight (water-filling: sources in order of cap over
weight; the first that its share does not fill sets the level). A source's documents fall into blocks by hash, ``BLOCKS`` of
them or more, so that a block has about ``BLOCK_ROWS`` rows at most; each pass over a source draws blocks in a permuted order, the last one document by document, so that a source
ends within half a document of its target.

Drawn blocks are tickets. The tree splits them among 2^depth output shards, more for larger inputs. Only counts pass
down the tree: at each node a half of the tickets goes left, and how many of each source is a multivariate-hypergeometric
draw (``quotas``). A source's tickets, in a permuted order, then fill the shards' quotas, exactly and disjointly. Inside a shard documents are shuffled by hash, in ``PARTS`` parts by the leading bits of their places, so
that no task holds a whole shard. Everything derives from hashes of ids: reruns agree.

Defined cases: null or empty text: size 0, never taken. A very long text is a document like others; a source ends
within half of it. A null source is a source. Empty table: empty result. Repeated rows are separate rows that are taken
or left on their own. Extra columns pass, whatever their names. The number of sources is taken to be bounded (they are
ordered and weighed as a list).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkledger.llm import common as c

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2
BLOCKS = 256
BLOCK_ROWS = 1 << 16
#: Depths of the tree, and the words that a shard should hold at most where depth allows.
DEPTH, DEEPEST, SHARD_WORDS = 4, 16, 1 << 22
#: The level whose nodes are dealt out over tasks.
SPREAD = 6
#: log2 of the parts of a shard that are sorted each in a task.
PART_BITS = 4
SEED = 20
#: The number of a row; repeated rows have their own.
ROW = "mixing_row__"
#: Rows of a table of blocks that is broadcast.
FEW = 1 << 20


def sized(docs: DataFrame, own: str | None = None) -> DataFrame:
    """Each row's size, hashes and number; ``own`` names a column that holds the number already."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), F.crc32(F.coalesce("text", F.lit(""))))
    row = F.col(f"`{own}`") if own else F.monotonically_increasing_id()
    tie = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if f.name != own and f.dataType.typeName() != "map"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), words.alias("size"), key.alias("key"), tie.alias("tie"), row.alias(ROW))


def targets(base: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """source, source_size, target of each source."""
    by = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int"))
    by = by.select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * cap).cast("double").alias("most"))
    level = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    everything = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("line", (F.sum("source_size").over(everything) * budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    by = by.withColumn("full", F.col("most") / F.col("weight") <= F.col("line"))
    line = F.first(F.when(~F.col("full"), F.col("line")), ignorenulls=True).over(everything)
    return by.withColumn("line", line).select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.col("line")).alias("target"))


def plan(docs: DataFrame, own: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with source_size, target and draws, the blocks with passes and what the last pass takes of them)."""
    base = c.write_table(sized(docs, own), "mixing-sizes")
    count = max(BLOCKS, 1 << max(0, (base.count() - 1) // BLOCK_ROWS).bit_length())
    base = base.withColumn("block", F.pmod("key", F.lit(count)))
    goal = c.write_table(targets(base), "mixing-targets")
    blocks = base.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    b, g = blocks.alias("b"), goal.alias("g")
    blocks = b.join(g, F.expr("b.source <=> g.source")).select("b.source", "b.block", "b.block_size", "g.source_size", "g.target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(SEED + 1), "source", "block"), "block")
    blocks = blocks.withColumn("passes", whole).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    blocks = blocks.withColumn("upto", F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.withColumn("room", F.col("rest") - (F.col("upto") - F.col("block_size")))
    drawn = F.when(F.col("upto") <= F.col("rest"), 2).when(F.col("room") > 0, 1).otherwise(0)
    blocks = c.write_table(blocks.withColumn("last", drawn), "mixing-blocks")
    d, b = base.alias("d"), blocks.alias("b")
    rows = d.join(b, F.expr("d.source <=> b.source and d.block = b.block")).select("d.*", "b.source_size", "b.target", "b.passes", "b.room", "b.last")
    inside = Window.partitionBy("source", "block").orderBy("key", "doc_id", "tie", ROW).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.sum("size").over(inside) - F.col("size") / 2
    cut = rows.where("last = 1").withColumn("more", (middle <= F.col("room")).cast("int"))
    uncut = rows.where("last <> 1").withColumn("more", (F.col("last") == 2).cast("int"))
    return cut.unionByName(uncut).withColumn("draws", F.when(F.col("size") > 0, F.col("passes") + F.col("more")).otherwise(F.lit(0)).cast("int")), blocks


def depth_for(rows: DataFrame) -> int:
    """Of a tree whose shards hold about ``SHARD_WORDS`` words."""
    words = rows.agg(F.sum("size")).head()[0] or 0
    return min(DEEPEST, max(DEPTH, int(BUDGET * words / SHARD_WORDS).bit_length()))


def _unit(*cells) -> F.Column:
    """A number strictly between 0 and 1 by hash."""
    return (F.shiftrightunsigned(F.xxhash64(*cells), 11) + 0.5) * 2.0**-53


def _let(value: F.Column, use) -> F.Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hypergeometric(unit: F.Column, total: F.Column, marked: F.Column, drawn: F.Column) -> F.Column:
    """How many of ``drawn`` out of ``total`` are among the ``marked``: the distribution inverted at ``unit``.

    Values are taken from the mode upwards, then downwards, each probability from the one beside it. Those further from the mode
    than 9 deviations and 24 weigh less than a double can tell.
    """
    others = total - marked - drawn
    deviation = F.sqrt(drawn * (marked / total) * ((total - marked) / total) * ((total - drawn) / F.greatest(total - 1, F.lit(1))))
    reach = F.ceil(deviation * 9) + 24
    mode = F.floor((drawn + 1) * ((marked + 1) / (total + 2)))
    least, most = F.greatest(F.lit(0), -others), F.least(drawn, marked)
    mode = F.greatest(least, F.least(most, mode)).cast("long")

    def walk(at: F.Column, share) -> F.Column:
        """``share`` is None: the weight of all values, that of the mode being 1. Else the value at which it is used up."""

        def step(a, x):
            rise = (marked - x + 1) * (drawn - x + 1) / (x * (others + x))
            fall = (x + 1) * (others + x + 1) / ((marked - x) * (drawn - x))
            w = F.when(x == at["mode"] - 1, F.lit(1.0)).otherwise(a["w"]) * F.when(x > at["mode"], rise).otherwise(fall)
            return _let(w, lambda w: F.struct(w.alias("w"), (a["left"] - w).alias("left"), x.alias("at")))

        begin = F.struct(F.lit(1.0).alias("w"), ((F.lit(0.0) if share is None else share) - 1.0).alias("left"), at["mode"].cast("double").alias("at"))
        used = F.aggregate(at["others"], begin, step if share is None else lambda a, x: F.when(a["left"] < 0, a).otherwise(step(a, x)))
        return -used["left"] if share is None else used["at"]

    values = F.concat(F.sequence(mode, F.least(most, mode + reach).cast("long")), F.sequence(mode, F.greatest(least, mode - reach).cast("long"), F.lit(-1).cast("long")))
    ends = F.struct(mode.cast("double").alias("mode"), F.array_remove(values, mode).cast("array<double>").alias("others"))
    value = _let(ends, lambda at: _let(walk(at, None) * unit, lambda share: walk(at, share)))
    return F.when((most <= least) | (total <= 0), F.greatest(most, F.lit(0))).otherwise(value).cast("long")


def quotas(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """shard, source, n: how many of a source's tickets each shard gets. ``counts`` has source and its tickets n.

    A node is one row with its counts by source; at each level half of its tickets go left (of an odd number, a hash gives the
    odd one), a hypergeometric draw from each source in turn.
    """
    part = F.struct("source", F.col("n").cast("long").alias("n"))
    tree = counts.agg(F.array_sort(F.collect_list(part)).alias("parts")).select(F.lit(0).alias("level"), F.lit(0).alias("node"), "parts")
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    goal = F.floor((F.col("total") + F.pmod(F.xxhash64(F.lit(SEED + 2), "level", "node"), F.lit(2))) / 2).cast("long")
    begin = F.struct(F.col("total").alias("rest"), goal.alias("goal"), F.array().cast("array<bigint>").alias("left"))

    def draw(a, p):
        taken_left = hypergeometric(_unit(F.lit(SEED + 3), F.col("level"), F.col("node"), p["source"]), a["rest"], p["n"], a["goal"])
        return _let(taken_left, lambda x: F.struct((a["rest"] - p["n"]).alias("rest"), (a["goal"] - x).alias("goal"), F.concat(a["left"], F.array(x)).alias("left")))

    drawn = F.aggregate("parts", begin, draw)["left"]
    left = F.zip_with("parts", "left", lambda p, x: F.struct(p["source"].alias("source"), x.alias("n")))
    right = F.zip_with("parts", "left", lambda p, x: F.struct(p["source"].alias("source"), (p["n"] - x).alias("n")))
    halves = F.inline(F.array(*(F.struct((F.col("level") + 1).alias("level"), (F.col("node") * 2 + side).alias("node"), parts.alias("parts")) for side, parts in enumerate((left, right)))))
    for level in range(depth):
        if level == SPREAD:
            tree = tree.repartition(c.partitions(counts.sparkSession), "node")
        tree = tree.withColumn("total", total).withColumn("left", drawn).select(halves)
    return tree.select(F.col("node").alias("shard"), F.inline("parts"))


def split(blocks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """source, block, draw, shard: every drawn block's tickets, permuted within their source, dealt out to the shards' quotas."""
    n = (F.col("passes") + F.when(F.col("last") > 0, 1).otherwise(0)).cast("long")
    drawn = blocks.select("source", "block", n.alias("n")).where("n > 0")
    by = F.xxhash64(F.lit(SEED + 4), "source", "block", "draw")
    permuted = Window.partitionBy("source").orderBy(by, "block", "draw")
    tickets = drawn.select("source", "block", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("draw")).withColumn("seat", F.row_number().over(permuted).cast("long"))
    shares = quotas(drawn.groupBy("source").agg(F.sum("n").alias("n")), depth).where("n > 0")
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    seats = shares.withColumn("upto", upto).select("source", "shard", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("seat"))
    t, s = tickets.alias("t"), seats.alias("s")
    return t.join(s, F.expr("t.source <=> s.source and t.seat = s.seat")).select("t.source", "t.block", "t.draw", "s.shard")


def dealt(docs: DataFrame, depth: int | None = None, own: str | None = None) -> DataFrame:
    """The rows of ``plan`` with ``tickets``: (draw, shard) of each of a row's draws, as the splitting tree deals them."""
    rows, blocks = plan(docs, own)
    hands = split(blocks, depth or depth_for(rows)).groupBy("source", "block").agg(F.collect_list(F.struct("draw", "shard")).alias("hand"))
    r, h = rows.alias("r"), hands.alias("h")
    h = F.broadcast(h) if blocks.count() <= FEW else h.hint("shuffle_hash")
    tickets = F.filter(F.coalesce("h.hand", F.array()), lambda t: t["draw"] <= F.col("r.draws"))
    return r.join(h, F.expr("r.source <=> h.source and r.block = h.block"), "left").select("r.*", tickets.alias("tickets"))


def taken(docs: DataFrame, depth: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row, counted from the tickets that ``mix`` hands out."""
    return dealt(docs, depth).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("tickets")).cast("long").alias("taken"))


def _drawn(docs: DataFrame, depth: int | None) -> DataFrame:
    """row (a struct), shard and at of each draw."""
    own = c.free_name(docs, ROW)
    numbered = c.write_table(docs.withColumn(own, F.monotonically_increasing_id()), "mixing-rows")
    draws = dealt(numbered, depth, own).select(F.col(ROW).alias("number"), "key", F.inline("tickets"))
    rows = numbered.select(F.col(own).alias("number"), F.struct(*(F.col(f"`{k}`") for k in docs.columns)).alias("row"))
    return rows.join(draws, "number").select("row", "shard", F.xxhash64(F.lit(SEED + 9), "key", "draw").alias("at"))


def mix(docs: DataFrame, depth: int | None = None) -> DataFrame:
    """The mixed rows: each row of ``docs`` as often as it is drawn, with its output ``shard_`` and place key ``at_`` (names longer by underscores where ``docs`` has them).

    Rows of a shard are shuffled by sorting on ``at_``.
    """
    return _drawn(docs, depth).select("row.*", F.col("shard").alias(c.free_name(docs, "shard_")), F.col("at").alias(c.free_name(docs, "at_")))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows of ``docs``, shuffled inside its output shards; parts of a shard hold ascending ranges of places."""
    drawn = _drawn(docs, None).withColumn("part", F.shiftright("at", 64 - PART_BITS))
    dealt_out = drawn.repartition(c.partitions(docs.sparkSession), "shard", "part")
    return dealt_out.sortWithinPartitions("shard", "at").select("row.*")
