"""Reading strategies over materialised readings: one row for each sample, provider and pass.

Readings have sample_id, provider, text, confidence, weight and error. Every strategy returns sample_id, text,
confidence, level and strategy. A provider that failed takes no part; one that read nothing only in a cascade.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.functions import numeric, text
from inkledger.operators import voting

#: The order in which a cascade asks, and bounds of the strategies.
CASCADE = ("gemini", "openai", "claude")
AGREED, RESOLVED = 0.95, 0.92
MOST_ROUNDS, MANY_MARKS = 3, 3


def _place(order: list[str] | tuple[str, ...]) -> Column:
    """Preferred providers first, then the others by name."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("provider"))
    return F.when(at == 0, len(order) + 1).otherwise(at)


def answered(readings: DataFrame, empty: bool = False) -> DataFrame:
    """Readings without an error; empty ones only if asked for."""
    fine = readings.where("error is null or error = ''").withColumn("text", F.coalesce("text", F.lit("")))
    return fine if empty else fine.where("text <> ''")


def _result(rows: DataFrame, reading: Column, confidence: Column, strategy: Column) -> DataFrame:
    out = rows.select("sample_id", reading.alias("text"), confidence.alias("raw_"), strategy.alias("strategy"))
    return out.select("sample_id", "text", F.round("raw_", 3).alias("confidence"), text.confidence_level(F.col("text"), F.col("raw_")).alias("level"), "strategy")


def best_of(readings: DataFrame, order: list[str]) -> DataFrame:
    """The first answer in order of preference."""
    n = F.row_number().over(Window.partitionBy("sample_id").orderBy(_place(order), "provider"))
    first = answered(readings).withColumn("n_", n).where("n_ = 1")
    return _result(first, F.col("text"), text.single_confidence(F.col("text")), F.lit("best_of"))


def cascade(readings: DataFrame, order: list[str] | tuple[str, ...] = CASCADE, threshold: float = 0.8) -> DataFrame:
    """The first answer if it is confident enough alone, else the first that agrees with the one before, else the last.

    An empty answer stays in the chain: the one after it may stand by agreement only.
    """
    by = Window.partitionBy("sample_id").orderBy(_place(order), "provider")
    rows = answered(readings, empty=True).select("sample_id", "provider", "text", F.row_number().over(by).alias("n"), F.lag("text").over(by).alias("before"))
    agree = F.when(F.col("n") > 1, voting.agreement(F.coalesce("before", F.lit("")), F.col("text")))
    rows = rows.withColumn("agree", agree).withColumn("alone", text.single_confidence(F.col("text")))
    good = F.when(F.col("n") == 1, F.col("alone") >= threshold).otherwise(F.col("agree") >= threshold)
    own = Window.partitionBy("sample_id")
    rows = rows.withColumn("stop", F.min(F.when(good, F.col("n"))).over(own)).withColumn("last", F.max("n").over(own))
    picked = rows.where("n = coalesce(stop, last)")
    measured = F.when(F.col("n") == 1, F.col("alone")).when(F.col("stop").isNotNull(), F.least(F.lit(AGREED), F.col("agree"))).otherwise(F.col("agree"))
    name = F.when(F.col("stop").isNull(), F.concat(F.lit("cascade_best_effort_"), "provider")).when(F.col("n") == 1, F.concat(F.lit("cascade_"), "provider")).otherwise(F.concat(F.lit("cascade_"), F.col("provider"), F.lit("_validated")))
    return _result(picked, F.col("text"), F.round(measured, 3), name)


def debate(readings: DataFrame, resolved: DataFrame, order: list[str] | tuple[str, ...] = CASCADE) -> DataFrame:
    """Two answers that agree word for word stand; otherwise a resolver's reading (``resolved``: sample_id, text, and final if a further pass was asked) does.

    A further pass counts only if it has fewer uncertain words.
    """
    by = Window.partitionBy("sample_id").orderBy(_place(order), "provider")
    two = answered(readings).withColumn("n", F.row_number().over(by)).where("n <= 2")
    two = two.groupBy("sample_id").agg(F.max(F.when(F.col("n") == 1, F.col("text"))).alias("a"), F.max(F.when(F.col("n") == 2, F.col("text"))).alias("b"))
    extra = F.col("final") if "final" in resolved.columns else F.lit(None).cast("string")
    rows = two.join(resolved.select("sample_id", F.col("text").alias("ruling"), extra.alias("final")), "sample_id", "left")
    rows = rows.withColumn("agree", F.when(F.col("b").isNotNull(), voting.agreement(F.col("a"), F.coalesce("b", F.lit("")))))
    rows = rows.withColumn("apart", F.size(voting.word_diff(F.col("a"), F.coalesce("b", F.col("a")))) > 0)
    better = F.coalesce((text.strip(F.col("final")) != "") & (text.uncertainty(F.col("ruling")) > 0) & (text.uncertainty(F.col("final")) < text.uncertainty(F.col("ruling"))), F.lit(False))
    alone = F.col("b").isNull()
    reading = F.when(alone | ~F.col("apart"), F.col("a")).when(better, F.col("final")).otherwise(F.coalesce("ruling", "a"))
    raised = F.least(F.lit(RESOLVED), F.col("agree") + F.least(F.lit(0.1), (1 - F.col("agree")) * 0.5))
    sure = F.when(alone, text.single_confidence(F.col("a"))).when(~F.col("apart"), F.least(F.lit(AGREED), F.col("agree"))).otherwise(raised)
    name = F.when(alone, "debate_single_fallback").when(~F.col("apart"), "debate_agreed").when(better, "debate_ice_resolved").otherwise("debate_resolved")
    return _result(rows, reading, sure, name)


def self_correct(passes: DataFrame, rounds: int = 1) -> DataFrame:
    """The first of at most three correction passes (``passes``: sample_id, round from 0, text) without uncertain words, else the last; a blank one gives way to the first reading."""
    rounds = min(max(1, rounds), MOST_ROUNDS)
    own = Window.partitionBy("sample_id")
    rows = passes.where(F.col("round") <= rounds).withColumn("initial", F.max(F.when(F.col("round") == 0, F.col("text"))).over(own)).where(text.strip(F.col("initial")) != "")
    clean = F.min(F.when((F.col("round") > 0) & (text.uncertainty(F.col("text")) == 0), F.col("round"))).over(own)
    rows = rows.withColumn("stop", F.coalesce(clean, F.max("round").over(own))).where("round = stop")
    reading = F.when(text.strip(F.col("text")) == "", F.col("initial")).otherwise(F.col("text"))
    return _result(rows, reading, text.single_confidence(reading), F.format_string("self_correct_%dpass", "round"))


def smart_route(readings: DataFrame, quality: DataFrame, passes: DataFrame, preferred: list[str]) -> DataFrame:
    """Easy pages by the best provider, middling ones by a cascade, hard ones by vote; many uncertain words in the former two go to correction passes.

    ``quality`` has sample_id, quality, blur, contrast, faint, issues (a count).
    """
    level = numeric.difficulty(F.col("quality"), F.col("blur"), F.col("contrast"), F.col("faint"), F.col("issues"))
    routed = readings.join(quality.select("sample_id", level.alias("route")), "sample_id")
    easy = best_of(routed.where("route = 'easy'"), preferred)
    middling = cascade(routed.where("route = 'medium'"), threshold=0.7)
    hard = voting.consensus(routed.where("route = 'hard'").where("error is null or error = ''")).drop("disagreements")
    light = easy.unionByName(middling).withColumn("many", text.uncertainty(F.col("text")) > MANY_MARKS)
    again = self_correct(passes.join(light.where("many").select("sample_id"), "sample_id", "left_semi")).withColumn("strategy", F.lit("smart→self_correct"))
    kept = light.join(again.select("sample_id"), "sample_id", "left_anti").drop("many")
    return kept.unionByName(again).unionByName(hard)


def run(readings: DataFrame, truths: DataFrame, strategies: list[str], preferred: list[str], run_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """A benchmark run over materialised readings of samples with ground truth (``truths``: sample_id, text): (outputs, metrics).

    Each provider's reading is an output of strategy ``single``; each strategy (vote, best_of, cascade) over two or more
    providers is one of a provider named after them all. Metrics are for outputs without an error.
    """
    known = readings.join(truths.select("sample_id"), "sample_id", "left_semi")
    columns = ("sample_id", "provider", "strategy", "output_text", "confidence", "error")
    outputs = known.select("sample_id", "provider", F.lit("single").alias("strategy"), F.col("text").alias("output_text"), "confidence", "error")
    names = F.array_join(F.array_sort(F.collect_set("provider")), "+")
    several = known.groupBy("sample_id").agg(names.alias("provider"), F.count_distinct("provider").alias("n")).where("n > 1").drop("n")
    makers = {"vote": lambda r: voting.consensus(r.where("error is null or error = ''")), "best_of": lambda r: best_of(r, preferred), "cascade": cascade}
    for name in strategies:
        made = makers[name](known).select("sample_id", F.col("text").alias("output_text"), "confidence").join(several, "sample_id")
        outputs = outputs.unionByName(made.select("sample_id", "provider", F.lit(name).alias("strategy"), "output_text", "confidence", F.lit(None).cast("string").alias("error")))
    marks = F.when(F.coalesce("output_text", F.lit("")) != "", text.marker_rate(F.col("output_text")))
    outputs = outputs.select(F.lit(run_id).cast("long").alias("run_id"), *columns, marks.alias("question_marker_rate"))
    fine = outputs.where("error is null or error = ''").join(truths.select("sample_id", F.col("text").alias("truth")), "sample_id")
    c, w = text.char_error(F.coalesce("output_text", F.lit("")), F.col("truth")), text.word_error(F.coalesce("output_text", F.lit("")), F.col("truth"))
    measured = fine.select("run_id", "sample_id", "provider", "strategy", c.alias("c"), w.alias("w"))
    metrics = measured.select("run_id", "sample_id", "provider", "strategy", F.col("c.rate").alias("cer"), F.col("w.rate").alias("wer"), F.col("c.edits").alias("char_edits"), F.col("w.edits").alias("word_edits"), F.col("c.ref_size").alias("ref_chars"), F.col("w.ref_size").alias("ref_words"))
    return outputs, metrics
