"""Evaluation reports: per-strategy aggregates, comparisons, regressions, recommendations, calibration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.operators.stats import guarded_corr

#: Thresholds of the reports.
CHANGED, REGRESSED = 0.005, 0.03
SCORE = {"error": 0.70, "cost": 0.15, "stability": 0.15}


def aggregate(results: DataFrame, keys: list[str], value: str, failed: Column) -> DataFrame:
    """Mean, median, sample deviation (0 for fewer than two), count and failures of each key; -1 without values."""
    v = F.col(value)
    return results.groupBy(*keys).agg(F.coalesce(F.avg(v), F.lit(-1.0)).alias("mean"), F.coalesce(F.median(v), F.lit(-1.0)).alias("median"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"), F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failures"))


def per_writer(results: DataFrame, writer: str, value: str) -> DataFrame:
    rows = results.where(F.col(writer).isNotNull() & (F.col(writer) != "") & F.col(value).isNotNull())
    return rows.groupBy(writer).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(F.lit(1)).alias("n"))


def compare(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Means of two runs by key: improved, worse, unchanged, new or removed."""
    both = old.select(*keys, F.col("mean").alias("before")).join(new.select(*keys, F.col("mean").alias("after")), keys, "full_outer")
    delta = F.col("after") - F.col("before")
    status = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "removed").when(delta < -CHANGED, "improved").when(delta > CHANGED, "worse").otherwise("unchanged")
    return both.select(*keys, "before", "after", delta.alias("delta"), status.alias("status"))


def regressions(runs: DataFrame, run: str, keys: list[str], baseline: int | None = None, threshold: float = REGRESSED) -> DataFrame:
    """Keys whose mean rose by more than ``threshold`` over the pinned baseline, or else over the run before."""
    if baseline is None:
        anchor = F.lag("mean").over(Window.partitionBy(*keys).orderBy(run))
        rows = runs.withColumn("previous", anchor)
    else:
        base = runs.where(F.col(run) == baseline).select(*keys, F.col("mean").alias("previous"))
        rows = runs.where(F.col(run) != baseline).join(base, keys)
    return rows.where(F.col("mean") - F.col("previous") > threshold).select(run, *keys, "mean", "previous", (F.col("mean") - F.col("previous")).alias("delta"))


def recommend(configs: DataFrame, keys: list[str]) -> DataFrame:
    """Rank configurations of (keys, run, error, cost) by normalised error, cost and stability over runs.

    Each measure is scaled to 0..1 among the configurations (0.5 where all are equal); an unknown deviation takes the median.
    """
    each = configs.groupBy(*keys).agg(F.avg("error").alias("error"), F.stddev_samp("error").alias("deviation"), F.avg("cost").alias("cost"), F.count(F.lit(1)).alias("runs"))
    bounds = each.agg(*[f(k).alias(f"{n}_{k}") for k in ("error", "cost") for n, f in (("low", F.min), ("high", F.max))], F.coalesce(F.median("deviation"), F.lit(0.0)).alias("middle"))
    filled = each.crossJoin(F.broadcast(bounds)).withColumn("deviation", F.coalesce("deviation", "middle"))  # one row
    spread = filled.agg(F.min("deviation").alias("low_deviation"), F.max("deviation").alias("high_deviation"))
    rows = filled.crossJoin(F.broadcast(spread))

    def scaled(k: str) -> Column:
        low, high = F.col(f"low_{k}"), F.col(f"high_{k}")
        return F.when(high - low < 1e-12, 0.5).otherwise((F.col(k) - low) / F.nullif(high - low, F.lit(0.0)))

    score = SCORE["error"] * (1 - scaled("error")) + SCORE["cost"] * (1 - scaled("cost")) + SCORE["stability"] * (1 - scaled("deviation"))
    rows = rows.select(*keys, "error", "cost", "deviation", "runs", F.round(score, 6).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *keys)))


def calibration(results: DataFrame, by: list[str], confidence: str, error: str) -> DataFrame:
    """Population correlation of confidence and error, 0 for fewer than three rows or no spread."""
    n = F.count(F.lit(1))
    return results.groupBy(*by).agg(F.when(n < 3, 0.0).otherwise(guarded_corr(confidence, error)).alias("corr"), n.alias("n"))


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence < 0.3, "0.0-0.3").when(confidence < 0.5, "0.3-0.5").when(confidence < 0.7, "0.5-0.7").when(confidence < 0.9, "0.7-0.9").otherwise("0.9-1.0")


def miscalibrated(results: DataFrame, by: list[str], order: list[str], sure: float = 0.7, wrong: float = 0.1, most: int = 5) -> DataFrame:
    """The first ``most`` outputs of each group that were sure and wrong, with ``found``, the number of all of them."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = results.where((F.col("confidence") > sure) & (F.col("error_rate") > wrong))
    rows = rows.withColumn("found", F.count(F.lit(1)).over(Window.partitionBy(*by))).withColumn("place", n)
    return rows.where(F.col("place") <= most)


def hardest(results: DataFrame, key: str, value: str, k: int = 3) -> DataFrame:
    """The ``k`` keys with the highest mean."""
    return results.groupBy(key).agg(F.avg(value).alias("mean")).orderBy(F.desc("mean"), key).limit(k)


def bootstrap_truth(outputs: DataFrame, most_error: float = 0.02, least_confidence: float = 0.85) -> DataFrame:
    """sample_id, text where all providers' latest texts agree and are confident: the longest, first provider on ties."""
    from inkledger.functions.text import char_error

    order = Window.partitionBy("sample_id", "provider").orderBy(F.desc("created_at"), F.desc("id"))
    last = outputs.withColumn("n_", F.row_number().over(order)).where("n_ = 1")
    a, b = last.alias("a"), last.alias("b")
    pair = a.join(b, (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.provider") < F.col("b.provider")))
    worst = pair.groupBy(F.col("a.sample_id").alias("sample_id")).agg(F.max(char_error(F.col("a.output_text"), F.col("b.output_text"))["rate"]).alias("worst"))
    best = last.groupBy("sample_id").agg(F.min("confidence").alias("sure"), F.min(F.struct((-F.char_length("output_text")).alias("n"), "provider", F.col("output_text"))).alias("best"))
    return best.join(worst, "sample_id").where((F.col("worst") <= most_error) & (F.col("sure") >= least_confidence)).select("sample_id", F.col("best.output_text").alias("text"))


def summary(results: DataFrame) -> DataFrame:
    """One row for each provider and strategy of a run's results: error rates, tokens, cost, failures.

    ``results`` has provider, strategy, cer, wer, input_tokens, output_tokens, question_marker_rate, error. Rates are -1 without values.
    """
    from inkledger.functions.numeric import cost

    def three(k: str) -> list[Column]:
        return [F.coalesce(F.avg(k), F.lit(-1.0)).alias(f"mean_{k}"), F.coalesce(F.median(k), F.lit(-1.0)).alias(f"median_{k}"), F.coalesce(F.stddev_samp(k), F.lit(0.0)).alias(f"stdev_{k}")]

    total = [F.sum(F.coalesce(k, F.lit(0))).alias(k) for k in ("input_tokens", "output_tokens")]
    marks = F.coalesce(F.avg("question_marker_rate"), F.lit(0.0)).alias("mean_marker_rate")
    out = results.groupBy("provider", "strategy").agg(*three("cer"), *three("wer"), *total, marks, F.count(F.lit(1)).alias("samples"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("failures"))
    money = cost(F.col("input_tokens"), F.col("output_tokens"), F.col("provider"))
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).withColumn("cost", money).drop("input_tokens", "output_tokens")


def _fixed(number: Column, digits: int) -> Column:
    """With so many digits; halves go by the number's binary value, as printf has it, where the JVM's formatter rounds its decimal form. A report has few lines."""

    @F.pandas_udf("string")
    def shown(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f"{x:.{digits}f}", na_action="ignore").astype(object)

    return shown(number)


def _percent(k: str, missing: str, least: float = 0.0, strict: bool = False) -> Column:
    shown = F.col(k) > least if strict else F.col(k) >= least
    return F.when(shown, F.concat(_fixed(F.col(k) * 100, 2), F.lit("%"))).otherwise(missing)


def report_table(lines: DataFrame) -> DataFrame:
    """(place, line): a fixed-width line for each row of ``summary``, best error first, those without one last."""
    place = F.row_number().over(Window.orderBy(F.when(F.col("mean_cer") >= 0, F.col("mean_cer")).otherwise(999.0), "provider", "strategy"))
    cells = [F.rpad("provider", 20, " "), F.rpad("strategy", 10, " "), F.lpad(_percent("mean_cer", "N/A"), 8, " "), F.lpad(_percent("stdev_cer", "---", strict=True), 6, " "), F.lpad(_percent("mean_wer", "N/A"), 8, " "), F.lpad(F.concat(_fixed(F.col("mean_marker_rate") * 100, 2), F.lit("%")), 11, " "), F.lpad(F.format_string("%,d", "total_tokens"), 10, " "), F.lpad(F.concat(F.lit("$"), _fixed(F.col("cost"), 4)), 8, " "), F.lpad(F.col("samples").cast("string"), 4, " "), F.lpad(F.col("failures").cast("string"), 4, " ")]
    return lines.select(place.alias("place"), F.concat_ws(" ", *cells).alias("line"))


def report_csv(lines: DataFrame) -> DataFrame:
    """One CSV line for each row of ``summary``; rates that are missing are empty."""
    rate = lambda k: F.when(F.col(k) >= 0, _fixed(F.col(k), 6)).otherwise("")
    quoted = lambda k: F.when(F.rlike(k, F.lit('[",\\r\\n]')), F.concat(F.lit('"'), F.replace(F.col(k), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(k))
    cells = [quoted("provider"), quoted("strategy"), *(rate(k) for k in ("mean_cer", "mean_wer", "median_cer", "median_wer")), F.col("total_tokens").cast("string"), _fixed(F.col("cost"), 6), F.col("samples").cast("string"), F.col("failures").cast("string")]
    return lines.select("provider", "strategy", F.concat_ws(",", *cells).alias("line"))


def report_json(lines: DataFrame) -> DataFrame:
    """One JSON object for each row of ``summary``; rates that are missing are null."""
    rate = lambda k: F.when(F.col(k) >= 0, F.round(k, 6)).alias(k)
    body = F.struct("provider", "strategy", *(rate(k) for k in ("mean_cer", "mean_wer", "median_cer", "median_wer")), "total_tokens", F.round("cost", 6).alias("cost"), "samples", "failures")
    return lines.select("provider", "strategy", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def generate_report(results: DataFrame, runs: DataFrame, run_id: int | None = None, form: str = "table") -> str:
    """A run's report as text, by default of the latest run; the lines are one for each provider and strategy."""
    run_id = runs.agg(F.max("id")).head()[0] if run_id is None else run_id
    if run_id is None:
        return "No benchmark runs found."
    lines = summary(results.where(F.col("run_id") == run_id))
    if form == "json":
        own = [r.json for r in report_json(lines).orderBy("provider", "strategy").collect()]
        return '{"run_id": %d, "results": [%s]}' % (run_id, ", ".join(own)) if own else f"No results found for run {run_id}."
    if form == "csv":
        own = [r.line for r in report_csv(lines).orderBy("provider", "strategy").collect()]
        head = "provider,strategy,mean_cer,mean_wer,median_cer,median_wer,total_tokens,cost_usd,samples,failures"
        return "\n".join([head, *own]) if own else f"No results found for run {run_id}."
    own = [r.line for r in report_table(lines).orderBy("place").collect()]
    if not own:
        return f"No results found for run {run_id}."
    about = runs.where(F.col("id") == run_id).head()
    head = [f"Benchmark Run #{run_id}", ""]
    if about:
        head += ["Provenance:", f"  Model:      {about.model_version or 'unknown'}", f"  Partition:  {about.iam_partition or 'n/a'}", f"  Norm flags: {about.norm_flags or 'unknown'}", f"  Vocab hints off: {'yes' if about.vocab_hints_off else 'no'}", ""]
    return "\n".join([*head, *own, ""])


def drill_down(sample_id: int, run_id: int, outputs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every output of one sample in one run with its error rates, by provider and strategy."""
    own = outputs.where((F.col("run_id") == run_id) & (F.col("sample_id") == sample_id))
    return own.join(metrics.select(F.col("provider_output_id").alias("id"), "cer", "wer"), "id", "left").orderBy("provider", "strategy", "id")


def hardest_filled(samples: DataFrame, results: DataFrame, k: int = 3) -> DataFrame:
    """``k`` samples: those with the highest mean error, then the others in order of id."""
    mean = results.where("cer is not null").groupBy("sample_id").agg(F.avg("cer").alias("mean"))
    return samples.join(mean, "sample_id", "left").orderBy(F.desc_nulls_last("mean"), "sample_id").limit(k)


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, the same ones for the same seed."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def noise(results: DataFrame, value: str) -> DataFrame:
    """deviation (population) and the least difference that two of them can show."""
    spread = F.coalesce(F.stddev_pop(value), F.lit(0.0))
    return results.agg(spread.alias("deviation"), (2 * spread).alias("least_difference"), F.count(value).alias("n"))


def projected_cost(outputs: DataFrame, run: str, reads: int, providers: list[str]) -> DataFrame:
    """Cost of ``reads`` more reads of each provider, at the mean tokens of the latest run (2000 and 500 without one)."""
    from inkledger.functions.numeric import cost

    last = outputs.where(F.col(run) == outputs.agg(F.max(run)).head()[0]) if not outputs.isEmpty() else outputs
    means = last.agg(F.coalesce(F.nullif(F.avg("input_tokens"), F.lit(0.0)), F.lit(2000.0)).alias("i"), F.coalesce(F.nullif(F.avg("output_tokens"), F.lit(0.0)), F.lit(500.0)).alias("o"))
    rows = means.select("*", F.explode(F.array(*map(F.lit, providers))).alias("provider"))
    return rows.select("provider", cost(F.floor(F.col("i") * reads), F.floor(F.col("o") * reads), F.col("provider")).alias("cost"))


def flag_anomalies(submissions: DataFrame, key: str, body: str, typed: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(key, others, typed_confidence): submissions similar to others (with the score of each), or typed (``typed``: key, confidence)."""
    from inkledger.operators.similarity import similar_texts

    pairs = similar_texts(submissions, key, body, threshold)
    both = pairs.select(F.col("a").alias(key), F.col("b").alias("other"), "score").unionAll(pairs.select(F.col("b").alias(key), F.col("a").alias("other"), "score"))
    near = both.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("other", "score"))).alias("others"))
    return near.join(typed.select(key, F.col("confidence").alias("typed_confidence")), key, "full_outer")


def anomalies_with_reasons(submissions: DataFrame, key: str, name: str, body: str, typed: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(key, name, reasons, similar, typed_confidence) of submissions that are like others or look typed; ``typed``: key, is_typed, confidence.

    ``similar`` holds (other, other_name, score), by other; the reasons state them in this order, then the typed text.
    """
    from inkledger.operators.similarity import similar_texts

    pairs = similar_texts(submissions, key, body, threshold)
    both = pairs.select(F.col("a").alias(key), F.col("b").alias("other"), "score").unionAll(pairs.select(F.col("b").alias(key), F.col("a").alias("other"), "score"))
    names = submissions.select(F.col(key).alias("other"), F.col(name).alias("other_name"))
    near = both.join(names, "other").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("other", "other_name", "score"))).alias("similar"))
    sure = typed.where("is_typed").select(key, F.col("confidence").alias("typed_confidence"))
    rows = near.join(sure, key, "full_outer").join(submissions.select(key, name), key)
    percent = lambda x: F.concat(F.round(x * 100, 0).cast("long").cast("string"), F.lit("%"))
    alike = F.transform(F.coalesce("similar", F.array()), lambda p: F.concat(F.lit("High text similarity ("), percent(p["score"]), F.lit(") with "), p["other_name"]))
    marks = F.when(F.col("typed_confidence").isNotNull(), F.array(F.concat(F.lit("Possible typed/printed text (confidence: "), percent(F.col("typed_confidence")), F.lit(")")))).otherwise(F.array())
    none = F.expr("filter(array(named_struct('other', cast(null as long), 'other_name', '', 'score', 0.0D)), x -> false)")
    return rows.select(key, name, F.concat(alike, marks).alias("reasons"), F.coalesce("similar", none).alias("similar"), "typed_confidence")
