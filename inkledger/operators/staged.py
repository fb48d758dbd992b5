"""Reading strategies that ask only where an answer is still needed.

A reader is ``ask(samples, provider, task)``: it gets the samples to ask about (``sample_id``, and for later tasks the texts
it should look at) and returns one row for each (``sample_id, text, error``, and ``confidence`` where the provider gives one).
``task`` is ``read``, ``resolve`` (``first``, ``second``: two readings that differ; ``final``: the resolver's own) or ``review`` (``prior``: the reading to
correct). Each round of asking is settled in the shared folder before anything looks at it, and the samples it
resolves leave by an anti join, so a sample is asked once a provider and round, and never again once it is resolved.

Every strategy returns sample_id, text, confidence, level, strategy and asked (the calls made for the sample, failed ones too).
A failed call (an error, or no row) takes no part; an empty answer is an answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions import numeric, text
from inkledger.operators import voting
from inkledger.operators.strategies import AGREED, CASCADE, MANY_MARKS, MOST_ROUNDS, RESOLVED
from inkledger.sources.settle import settled

Ask = Callable[[DataFrame, str, str], DataFrame]
STRATEGIES = ("vote", "best_of", "debate", "cascade", "smart", "self_correct")
#: Words that two readings must share in a smart route's cascade.
SMART_THRESHOLD = 0.7


def _nothing() -> Column:
    return F.lit(None).cast("string")


def _call(samples: DataFrame, ask: Ask, provider: str, task: str, name: str) -> DataFrame:
    """sample_id, reading, confidence, ok of every asked sample."""
    got = ask(samples, provider, task)
    conf = F.col("confidence") if "confidence" in got.columns else F.lit(None).cast("double")
    got = got.select("sample_id", F.col("text").alias("reading"), conf.cast("double").alias("confidence"), (F.coalesce(F.col("error"), F.lit("")) == "").alias("ok_"))
    rows = samples.select("sample_id").join(got, "sample_id", "left")
    ok = F.coalesce(F.col("ok_"), F.lit(False)) & F.col("reading").isNotNull()
    return settled(rows.select("sample_id", F.when(ok, F.col("reading")).alias("reading"), "confidence", ok.alias("ok")), name)


def _result(rows: DataFrame, reading: Column, confidence: Column, strategy: Column, asked: Column) -> DataFrame:
    out = rows.select("sample_id", reading.alias("text"), confidence.alias("raw_"), strategy.alias("strategy"), asked.cast("int").alias("asked"))
    return out.select("sample_id", "text", F.round("raw_", 3).alias("confidence"), text.confidence_level(F.col("text"), F.col("raw_")).alias("level"), "strategy", "asked")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def first_answer(samples: DataFrame, ask: Ask, providers: list[str]) -> DataFrame:
    """The first provider that answers, in order; one provider is asked for most samples."""
    pending, done = samples.select("sample_id"), []
    for tier, provider in enumerate(providers, 1):
        got = _call(pending, ask, provider, "read", f"best-of-{provider}")
        done.append(_result(got.where("ok"), F.col("reading"), text.single_confidence(F.col("reading")), F.lit("best_of"), F.lit(tier)))
        pending = pending.join(got.where("ok").select("sample_id"), "sample_id", "left_anti")
    return _union([*done, _result(pending, F.lit(""), F.lit(0.0), F.lit("best_of_failed"), F.lit(len(providers)))])


def cascade(samples: DataFrame, ask: Ask, providers: list[str] | tuple[str, ...] = CASCADE, threshold: float = 0.8) -> DataFrame:
    """Cheapest first: the first answer stands alone if it is confident enough, a later one if it agrees with the answer before.

    Samples that end without either keep their last answer, with its agreement with the one before as confidence.
    """
    state = samples.select("sample_id", _nothing().alias("last"), _nothing().alias("before"), _nothing().alias("by"), F.lit(0).alias("answers"), F.lit(0).alias("asked"))
    done = []
    for provider in providers:
        got = _call(state.select("sample_id"), ask, provider, "read", f"cascade-{provider}")
        rows = state.withColumn("asked", F.col("asked") + 1).join(got.select("sample_id", "reading", "ok"), "sample_id")
        agree = F.when(F.col("ok") & (F.col("answers") > 0), voting.agreement(F.coalesce("last", F.lit("")), F.coalesce("reading", F.lit(""))))
        alone = F.when(F.col("ok") & (F.col("answers") == 0), text.single_confidence(F.col("reading")))
        rows = settled(rows.withColumn("agree", agree).withColumn("alone", alone), f"cascade-state-{provider}")
        stops = F.coalesce(F.coalesce("agree", "alone") >= threshold, F.lit(False))
        stopped = rows.where(stops)
        sure = F.when(F.col("agree").isNotNull(), F.least(F.lit(AGREED), F.round("agree", 3))).otherwise(F.col("alone"))
        name = F.when(F.col("agree").isNotNull(), f"cascade_{provider}_validated").otherwise(f"cascade_{provider}")
        done.append(_result(stopped, F.col("reading"), sure, name, F.col("asked")))
        heard = lambda new, old: F.when(F.col("ok"), new).otherwise(old)
        state = rows.join(stopped.select("sample_id"), "sample_id", "left_anti").select(
            "sample_id", heard(F.col("reading"), F.col("last")).alias("last"), heard(F.col("last"), F.col("before")).alias("before"),
            heard(F.lit(provider), F.col("by")).alias("by"), (F.col("answers") + F.col("ok").cast("int")).alias("answers"), "asked",
        )
    apart = F.when(F.col("answers") >= 2, F.round(voting.agreement(F.coalesce("before", F.lit("")), F.coalesce("last", F.lit(""))), 3))
    left = settled(state.withColumn("apart", apart), "cascade-left")
    sure = F.when(F.col("answers") == 0, 0.0).when(F.col("answers") == 1, F.round(text.single_confidence(F.col("last")), 3)).otherwise(F.col("apart"))
    name = F.when(F.col("answers") == 0, "cascade_failed").otherwise(F.concat(F.lit("cascade_best_effort_"), "by"))
    return _union([*done, _result(left, F.coalesce("last", F.lit("")), sure, name, F.col("asked"))])


def vote(samples: DataFrame, ask: Ask, providers: list[str], weights: dict[str, float] | None = None, habits: DataFrame | None = None) -> DataFrame:
    """All providers are asked, and their answers voted on word by word; with one provider its answer stands."""
    if not providers:
        raise ValueError("no providers to ask")
    got = [_call(samples.select("sample_id"), ask, p, "read", f"vote-{p}").withColumn("provider", F.lit(p)).withColumn("weight", F.lit(float((weights or {}).get(p, 1.0)))) for p in providers]
    if len(providers) == 1:
        one = got[0].withColumn("reading", F.coalesce("reading", F.lit("")))
        return _result(one, F.col("reading"), F.when(F.col("ok"), text.single_confidence(F.col("reading"))).otherwise(0.0), F.lit("vote_single_fallback"), F.lit(1))
    readings = _union(got).where("ok").select("sample_id", "provider", F.col("reading").alias("text"), "confidence", "weight")
    voted = voting.consensus(readings, habits).select("sample_id", "text", "confidence", "level", "strategy")
    nothing = {"text": "", "confidence": 0.0, "level": "LOW", "strategy": "vote"}
    return samples.select("sample_id").join(voted, "sample_id", "left").na.fill(nothing).withColumn("asked", F.lit(len(providers)))


def debate(samples: DataFrame, ask: Ask, providers: list[str] | tuple[str, ...] = CASCADE, rounds: int = 2) -> DataFrame:
    """Two readings that agree word for word stand; only samples whose readings differ reach the resolver, the last provider.

    With three rounds, only rulings that still hold uncertain words are asked about once more; the answer counts if it has fewer.
    """
    if not providers:
        raise ValueError("no providers to ask")
    two, resolver = list(providers)[:2], list(providers)[-1]
    keys = samples.select("sample_id")
    rows = keys
    for place, provider in zip(("first", "second"), two):
        got = _call(keys, ask, provider, "read", f"debate-{place}")
        rows = rows.join(got.select("sample_id", F.col("reading").alias(place)), "sample_id")
    if len(two) == 1:
        rows = rows.withColumn("second", _nothing())
    both = F.col("first").isNotNull() & F.col("second").isNotNull()
    rows = rows.withColumn("agree", F.when(both, voting.agreement(F.coalesce("first", F.lit("")), F.coalesce("second", F.lit("")))))
    rows = rows.withColumn("apart", F.coalesce(both & (F.size(voting.word_diff(F.coalesce("first", F.lit("")), F.coalesce("second", F.lit("")))) > 0), F.lit(False)))
    rows = settled(rows, "debate-readings")
    calls = F.lit(len(two))
    single = F.coalesce("first", "second")
    quiet = rows.where(~F.col("apart"))
    sure = F.when(both, F.least(F.lit(AGREED), F.col("agree"))).when(single.isNull(), 0.0).otherwise(text.single_confidence(F.coalesce(single, F.lit(""))))
    done = [_result(quiet, F.coalesce(single, F.lit("")), sure, F.when(both, "debate_agreed").otherwise("debate_single_fallback"), calls)]
    open_ = rows.where("apart")
    ruled = _call(open_.select("sample_id", "first", "second"), ask, resolver, "resolve", "debate-ruling")
    open_ = settled(open_.join(ruled.select("sample_id", F.coalesce("reading", F.lit("")).alias("ruling"), F.col("ok").alias("ruled")), "sample_id"), "debate-ruled")
    unsure = (F.col("ruled")) & (text.uncertainty(F.col("ruling")) > 0) & F.lit(rounds >= 3)
    again = open_.where(unsure)
    extra = _call(again.select("sample_id", "first", "second", F.col("ruling").alias("prior")), ask, resolver, "resolve", "debate-final") if rounds >= 3 else None
    final = extra.select("sample_id", F.col("reading").alias("final")) if extra is not None else again.select("sample_id", _nothing().alias("final"))
    open_ = open_.join(final, "sample_id", "left")
    better = F.coalesce((text.strip(F.col("final")) != "") & (text.uncertainty(F.col("final")) < text.uncertainty(F.col("ruling"))), F.lit(False))
    reading = F.when(better, F.col("final")).when(F.col("ruled"), F.col("ruling")).otherwise(F.col("first"))
    raised = F.least(F.lit(RESOLVED), F.col("agree") + F.least(F.lit(0.1), (1 - F.col("agree")) * 0.5))
    done.append(_result(open_, reading, raised, F.when(better, "debate_ice_resolved").otherwise("debate_resolved"), calls + 1 + unsure.cast("int")))
    return _union(done)


def self_correct(samples: DataFrame, ask: Ask, providers: list[str], rounds: int = 1) -> DataFrame:
    """One provider reads and reviews its own reading; only readings that still hold uncertain words are reviewed again."""
    rounds, provider = min(max(1, rounds), MOST_ROUNDS), providers[0]
    first = _call(samples.select("sample_id"), ask, provider, "read", "self-read").select("sample_id", F.coalesce("reading", F.lit("")).alias("initial"))
    empty = first.where(text.strip(F.col("initial")) == "")
    done = [_result(empty, F.col("initial"), F.lit(0.0), F.lit("self_correct_failed"), F.lit(1))]
    pending = first.join(empty.select("sample_id"), "sample_id", "left_anti").withColumn("prior", F.col("initial"))
    for at in range(1, rounds + 1):
        got = _call(pending.select("sample_id", "prior"), ask, provider, "review", f"self-review-{at}")
        rows = pending.join(got.select("sample_id", "reading", "ok"), "sample_id")
        rows = settled(rows.withColumn("prior", F.when(F.col("ok"), F.col("reading")).otherwise(F.col("prior"))), f"self-state-{at}")
        clean = (text.uncertainty(F.col("prior")) == 0) if at < rounds else F.lit(True)
        ready = rows.where(clean)
        reading = F.when(text.strip(F.col("prior")) == "", F.col("initial")).otherwise(F.col("prior"))
        done.append(_result(ready, reading, text.single_confidence(reading), F.lit(f"self_correct_{at}pass"), F.lit(1 + at)))
        pending = rows.join(ready.select("sample_id"), "sample_id", "left_anti").select("sample_id", "initial", "prior")
    return _union(done)


def smart(samples: DataFrame, ask: Ask, providers: list[str], preferred: list[str], quality: DataFrame, marks: int = MANY_MARKS, **how) -> DataFrame:
    """Easy pages: one provider; middling ones: a cascade; hard ones: a vote. Light readings of more than ``marks`` uncertain words are corrected.

    ``quality`` has sample_id, quality, blur, contrast, faint, issues (a count); a sample that it lacks is middling.
    """
    level = numeric.difficulty(F.col("quality"), F.col("blur"), F.col("contrast"), F.col("faint"), F.col("issues"))
    routed = samples.select("sample_id").join(quality.select("sample_id", level.alias("route")), "sample_id", "left").na.fill({"route": "medium"})
    light = settled(first_answer(routed.where("route = 'easy'"), ask, preferred).unionByName(cascade(routed.where("route = 'medium'"), ask, providers, SMART_THRESHOLD)), "smart-light")
    many = light.where(text.uncertainty(F.col("text")) > marks)
    again = self_correct(many, ask, preferred)
    before = many.select("sample_id", F.col("asked").alias("earlier"))
    again = again.join(before, "sample_id").withColumn("asked", F.col("asked") + F.col("earlier")).withColumn("strategy", F.lit("smart→self_correct")).drop("earlier")
    kept = light.join(many.select("sample_id"), "sample_id", "left_anti")
    return kept.unionByName(again).unionByName(vote(routed.where("route = 'hard'"), ask, providers, **how))


def read_with_consensus(samples: DataFrame, ask: Ask, providers: list[str], strategy: str = "vote", *, preferred: list[str] | None = None, threshold: float = 0.8, rounds: int | None = None, quality: DataFrame | None = None, weights: dict[str, float] | None = None, habits: DataFrame | None = None, marks: int = MANY_MARKS) -> DataFrame:
    """Readings of all ``samples`` by a named strategy; a smart route without quality marks is a vote."""
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown strategy: {strategy}. Use: {', '.join(STRATEGIES)}")
    if not providers:
        raise ValueError("no providers to ask")
    best = preferred or list(providers)
    if strategy == "best_of":
        return first_answer(samples, ask, best)
    if strategy == "cascade":
        return cascade(samples, ask, [p for p in CASCADE if p in providers] or list(providers), threshold)
    if strategy == "debate":
        return debate(samples, ask, list(providers), 2 if rounds is None else rounds)
    if strategy == "self_correct":
        return self_correct(samples, ask, best, 1 if rounds is None else rounds)
    if strategy == "smart" and quality is not None:
        return smart(samples, ask, list(providers), best, quality, marks, weights=weights, habits=habits)
    return vote(samples, ask, list(providers), weights, habits)
