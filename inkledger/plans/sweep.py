"""Five configurations over the same outputs, compared pair by pair, and a comparison of two runs as a report.

A sweep reads the outputs of one run once. Each configuration picks one error rate a sample: a provider alone, the best provider
by mean, a consensus strategy. All configurations of a sample meet in one exchange by sample; pairs are formed inside a
sample's row (ten at most), and the paired test needs only how often each absolute difference occurs with each sign.
Differences are rounded to 9 places, so that equal ones tie. No task gets a configuration's samples as a list, except for
the interval, which resamples counted differences.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkledger.operators.stats import normal_tail

#: What a sweep compares where nothing else is asked for: name to (providers, or none for all; strategy).
CONFIGURATIONS = {
    "claude": (("claude",), "single"), "gemini": (("gemini",), "single"), "openai": (("openai",), "single"), "vote": (None, "vote"), "cascade": (None, "cascade"),
}
PLACES, LEAST_PAIRS = 9, 6


def chosen(outputs: DataFrame, configurations=None) -> DataFrame:
    """(sample_id, configuration, error): the mean error of each sample under each configuration; errors that are null say nothing."""
    plan = CONFIGURATIONS if configurations is None else configurations
    tests = []
    for name, (providers, strategy) in sorted(plan.items()):
        own = F.col("strategy") == strategy
        tests.append(F.when(own & F.col("provider").isin(list(providers)) if providers else own, F.lit(name)))
    rows = outputs.where("error_rate is not null and not isnan(error_rate)").where(F.abs("error_rate") < float("inf"))
    rows = rows.select("sample_id", "error_rate", F.explode(F.array_compact(F.array(*tests))).alias("configuration"))
    return rows.groupBy("sample_id", "configuration").agg(F.avg("error_rate").alias("error"))


def differences(errors: DataFrame) -> DataFrame:
    """(a, b, difference, n): how often each rounded difference b - a of two configurations occurs over samples that have both."""
    bag = errors.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("configuration", "error"))).alias("own"))
    pairs = F.expr("flatten(transform(own, (x, i) -> transform(slice(own, i + 2, size(own)), y -> named_struct('a', x.configuration, 'b', y.configuration, 'd', y.error - x.error))))")
    rows = bag.select(F.explode(pairs).alias("p")).select("p.a", "p.b", F.round("p.d", PLACES).alias("difference"))
    return rows.groupBy("a", "b", "difference").agg(F.count(F.lit(1)).alias("n"))


def paired_tests(counted: DataFrame) -> DataFrame:
    """(a, b, n, mean, w, z, p, effect): signed ranks of each pair's differences, zeros left out, ties at their average rank.

    ``p`` by the normal approximation with the ties' correction; null below ``LEAST_PAIRS`` differences. Ranks are counted over distinct
    absolute differences, which a window orders within a pair of configurations.
    """
    apart = counted.groupBy("a", "b", F.abs("difference").alias("size")).agg(F.sum(F.when(F.col("difference") > 0, F.col("n")).otherwise(0)).alias("up"), F.sum("n").alias("t"))
    moved = apart.where("size > 0")
    before = F.coalesce(F.sum("t").over(Window.partitionBy("a", "b").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = moved.withColumn("rank", before + (F.col("t") + 1) / 2)
    sums = ranked.groupBy("a", "b").agg(F.sum(F.col("rank") * F.col("up")).alias("plus"), F.sum(F.col("rank") * (F.col("t") - F.col("up"))).alias("minus"), F.sum("t").alias("m"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    means = counted.groupBy("a", "b").agg(F.sum("n").alias("n"), (F.sum(F.col("difference") * F.col("n")) / F.sum("n")).alias("mean"))
    rows = means.join(sums, ["a", "b"], "left").na.fill(0, ["m", "ties"]).na.fill(0.0, ["plus", "minus"])
    m = F.col("m").cast("double")
    rows = rows.withColumn("w", F.least("plus", "minus"))
    spread = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48.0)
    rows = rows.withColumn("z", F.when((F.col("m") >= LEAST_PAIRS) & (spread > 0), (F.col("w") - m * (m + 1) / 4) / spread))
    effect = F.when(F.col("m") > 0, F.abs("z") / F.sqrt(m))
    return rows.select("a", "b", "n", "mean", "w", "z", F.when(F.col("z").isNotNull(), normal_tail(F.col("z"))).alias("p"), effect.alias("effect"))


def intervals(counted: DataFrame, rounds: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(a, b, low, high): a bootstrap interval of each pair's mean difference, from counts.

    A resample of n differences from a counted list is one multinomial draw of counts; a group holds the distinct
    differences of one pair. Every pair has its own stream.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("difference")
        n, values = rows["n"].to_numpy(), rows["difference"].to_numpy()
        a, b = rows["a"].iloc[0], rows["b"].iloc[0]
        draw = np.random.Generator(np.random.Philox(key=[seed, int(pd.util.hash_array(np.array([f"{a}/{b}"], object))[0])]))
        means, step = [], max(1, 4_000_000 // len(n))
        for at in range(0, rounds, step):
            means.append(draw.multinomial(int(n.sum()), n / n.sum(), min(step, rounds - at)) @ values / n.sum())
        low, high = np.quantile(np.concatenate(means), [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame({"a": [a], "b": [b], "low": [low], "high": [high]})

    return counted.groupBy("a", "b").applyInPandas(run, "a string, b string, low double, high double")


def run_sweep(outputs: DataFrame, configurations=None, rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """(a, b, n, mean, w, z, p, effect, low, high) of every pair of configurations that share samples."""
    counted = differences(chosen(outputs, configurations))
    return paired_tests(counted).join(intervals(counted, rounds, seed=seed), ["a", "b"])


def standings(outputs: DataFrame, configurations=None) -> DataFrame:
    """(configuration, samples, mean, median, rank) by mean error, the first name on ties."""
    rows = chosen(outputs, configurations).groupBy("configuration").agg(F.count(F.lit(1)).alias("samples"), F.avg("error").alias("mean"), F.median("error").alias("median"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("mean", "configuration")))  # one row a configuration


def compare_report(before: DataFrame, after: DataFrame, names: tuple[str, str] = ("before", "after"), notable: float = 0.005) -> DataFrame:
    """(line, text): two runs side by side, by provider and strategy, then the paired test over the samples that both have.

    Inputs have sample_id, provider, strategy, error_rate.
    """
    keys = ["provider", "strategy"]
    mean = lambda df, name: df.groupBy(*keys).agg(F.avg("error_rate").alias(name))
    both = mean(before, "x").join(mean(after, "y"), keys, "full_outer")
    moved = F.col("y") - F.col("x")
    verdict = F.when(F.col("x").isNull(), "new").when(F.col("y").isNull(), "removed").when(moved < -notable, "better").when(moved > notable, "worse").otherwise("same")
    percent = lambda c: F.when(c.isNull(), "-").otherwise(F.format_string("%.2f%%", c * 100))
    body = F.concat(F.rpad(F.concat_ws("/", *keys), 28, " "), F.lpad(percent(F.col("x")), 10, " "), F.lpad(percent(F.col("y")), 10, " "), F.lpad(F.when(moved.isNull(), "").otherwise(F.format_string("%+.2f%%", moved * 100)), 10, " "), F.lit("  "), verdict)
    order = F.row_number().over(Window.orderBy(*keys))  # one row a provider and strategy
    lines = both.select((order + 2).alias("line"), body.alias("text"))
    spark = before.sparkSession
    head = F.concat(F.rpad(F.lit("provider/strategy"), 28, " "), *(F.lpad(F.lit(k), 10, " ") for k in (*names, "change")))
    heads = spark.range(1).select(F.explode(F.array(F.struct(F.lit(1).alias("line"), head.alias("text")), F.struct(F.lit(2).alias("line"), F.lit("-" * 64).alias("text")))).alias("h")).select("h.*")
    errors = before.select("sample_id", F.lit("1").alias("configuration"), "error_rate").unionAll(after.select("sample_id", F.lit("2"), "error_rate"))
    errors = errors.where("error_rate is not null").groupBy("sample_id", "configuration").agg(F.avg("error_rate").alias("error"))
    test = paired_tests(differences(errors))
    said = F.format_string("paired samples: %d, mean change %+.4f, W %.1f, p %s", "n", "mean", "w", F.coalesce(F.format_string("%.4f", "p"), F.lit("- (too few)")))
    return heads.unionAll(lines).unionAll(test.select(F.lit(1 << 30), said)).orderBy("line")


def pairs_of(configurations=None) -> list[tuple[str, str]]:
    """The pairs that a sweep compares."""
    return list(combinations(sorted(CONFIGURATIONS if configurations is None else configurations), 2))
