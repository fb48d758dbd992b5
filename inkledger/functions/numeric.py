"""Numbers as Spark columns: cost, vectors, image quality rules, regions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: USD for a million tokens in and out.
RATES = {"claude": (3.00, 15.00), "gemini": (0.15, 0.60), "openai": (2.00, 8.00)}
#: Pages up to, dpi, jpeg quality, longest side.
TIERS = ((15, 200, 85, 1568), (30, 150, 80, 1568), (50, 120, 75, 1280), (999, 100, 70, 1024))
#: Voting weights by content type.
WEIGHTS = {
    "handwriting": {"gemini": 1.5, "claude": 1.0, "openai": 0.7},
    "cursive": {"gemini": 1.5, "claude": 1.0, "openai": 0.7},
    "structured": {"gemini": 1.5, "claude": 1.0, "openai": 0.8},
    "printed": {"gemini": 1.5, "claude": 1.0, "openai": 0.8},
    "layout": {"claude": 1.5, "gemini": 1.0, "openai": 0.8},
    "scientific": {"claude": 1.5, "gemini": 1.0, "openai": 0.8},
    "default": {"gemini": 1.2, "claude": 1.0, "openai": 0.8},
}


def cost(tokens_in: Column, tokens_out: Column, provider: Column) -> Column:
    """Of a provider, or the mean over the parts of ``a+b``; unknown ones cost nothing."""
    rate = F.create_map(*[F.lit(x) for k, v in RATES.items() for x in (k, list(v))])
    parts = F.split(provider, r"\+")
    # the mean of the rates, then one sum: halves of the last shown digit fall as they do for that sum
    mean = lambda k: F.aggregate(F.transform(parts, lambda p: F.coalesce(F.try_element_at(F.try_element_at(rate, p), F.lit(k)), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x) / F.size(parts)
    return (tokens_in * mean(1) + tokens_out * mean(2)) / 1e6


def strategy_cost(strategy: Column, n: Column, tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Cost of one page: rates are sums over the strategy's providers; calls other than votes share them."""
    calls = F.when(strategy == "best_of", 1.0).when(strategy == "debate", 3.0).when(strategy == "cascade", 1.5).otherwise(n.cast("double"))
    whole = (tokens_in * rate_in + tokens_out * rate_out) / 1e6
    return F.round(F.when(strategy == "vote", whole).otherwise(whole * calls / n), 4)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """Divided by its length; a zero vector stays."""
    size = norm(v)
    return F.transform(v, lambda x: F.when(size == 0, x.cast("double")).otherwise(x.cast("double") / F.nullif(size, F.lit(0.0))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def page_tier(pages: Column) -> Column:
    """struct(dpi, quality, side) for a document of so many pages."""
    out = None
    for upto, dpi, quality, side in TIERS:
        value = F.struct(F.lit(dpi).alias("dpi"), F.lit(quality).alias("quality"), F.lit(side).alias("side"))
        out = F.when(pages <= upto, value) if out is None else out.when(pages <= upto, value)
    return out.otherwise(value)


def quality_issues(blur: Column, contrast: Column, mean: Column, skew: Column) -> Column:
    return F.array_compact(F.array(F.when(blur < 100, "blurry"), F.when(contrast < 0.4, "low_contrast"), F.when(mean < 100, "too_dark"), F.when(mean > 220, "too_bright"), F.when(F.abs(skew) >= 1.5, "skewed")))


def quality_tier(blur: Column, contrast: Column, mean: Column, skew: Column) -> Column:
    n = F.size(quality_issues(blur, contrast, mean, skew))
    return F.when(n == 0, "good").when((n == 1) & (blur >= 50) & (contrast >= 0.25), "fair").otherwise("poor")


def faint(mean: Column, contrast: Column) -> Column:
    return (mean > 180) & (contrast < 0.5)


def difficulty(quality: Column, blur: Column, contrast: Column, is_faint: Column, issues: Column) -> Column:
    easy = (quality == "good") & (blur >= 200) & (contrast >= 0.6)
    hard = (quality == "poor") | is_faint | (issues >= 2) | (blur < 80) | (contrast < 0.3)
    return F.when(easy, "easy").when(hard, "hard").otherwise("medium")


@dataclass(frozen=True)
class Layout:
    """Geometry of a two-column answer sheet, as fractions of the page's width and height."""

    left: tuple[float, float]
    right: tuple[float, float]
    first_line: float
    spacing: float
    above: float
    below: float
    rows: int = 25


def answer_regions(width: Column, height: Column, n: int, layout: Layout, padding: int = 0) -> Column:
    """array of struct(number, left, top, right, bottom): a box around each answer's underline, padded and clamped to the page."""

    def box(k: Column) -> Column:
        first = k <= layout.rows
        low, high = (F.when(first, F.lit(a)).otherwise(F.lit(b)) for a, b in zip(layout.left, layout.right))
        line = F.lit(layout.first_line) + F.when(first, k - 1).otherwise(k - 1 - layout.rows) * F.lit(layout.spacing)
        cut = lambda size, share: (size * share).cast("long")
        left, right = cut(width, low) - padding, cut(width, high) + padding
        top, bottom = cut(height, line - layout.above) - padding, cut(height, line + layout.below) + padding
        none = F.lit(0).cast("long")
        return F.struct(k.alias("number"), F.greatest(left, none).alias("left"), F.greatest(top, none).alias("top"), F.least(right, width.cast("long")).alias("right"), F.least(bottom, height.cast("long")).alias("bottom"))

    return F.transform(F.sequence(F.lit(1), F.lit(n)), box)


def vote_weight(content: Column, provider: Column) -> Column:
    """A provider's weight for a type of content, by default 1 and for unknown types those of ``default``."""
    table = F.create_map(*[F.lit(x) for kind, own in WEIGHTS.items() for p, w in own.items() for x in (f"{kind}/{p}", w)])
    kinds = F.array(*map(F.lit, WEIGHTS))
    kind = F.when(F.array_contains(kinds, content), content).otherwise(F.lit("default"))
    return F.coalesce(F.try_element_at(table, F.concat(kind, F.lit("/"), provider)), F.lit(1.0))


def few_shot_limit(setting: Column, default: int = 3) -> Column:
    """The setting as a whole number from 0 on, else the default."""
    number = F.when(F.rlike(setting, F.lit(r"^\s*\+?\d+\s*$")), F.trim(setting).try_cast("int"))
    return F.coalesce(number, F.lit(default))


def enhancement(quality: Column, is_faint: Column, issues: Column) -> Column:
    """struct(strategy, denoise, sharpen, sharpen_factor, contrast, contrast_factor, cutoff, brighten) for a page's faults."""
    has = lambda k: F.array_contains(issues, k)

    def plan(denoise=False, sharpen=1.0, contrast=1.0, cutoff=2, brighten=False, strategy="adaptive") -> Column:
        factor = contrast if isinstance(contrast, Column) else F.lit(contrast)
        return F.struct(F.lit(strategy).alias("strategy"), F.lit(denoise).alias("denoise"), F.lit(sharpen > 1).alias("sharpen"), F.lit(sharpen).alias("sharpen_factor"), (factor > 1).alias("contrast"), factor.alias("contrast_factor"), F.lit(cutoff).alias("cutoff"), F.lit(brighten).alias("brighten"))

    out = F.when(is_faint | has("faint_ink"), plan(contrast=2.0, cutoff=3, brighten=True))
    out = out.when(quality == "good", plan(strategy="llm"))
    out = out.when(has("blurry") & ~has("low_contrast"), plan(denoise=True, sharpen=2.5))
    out = out.when(has("low_contrast") & ~has("blurry"), plan(contrast=1.5))
    out = out.when(has("too_dark"), plan(contrast=1.3, brighten=True)).when(has("too_bright"), plan(contrast=1.5, cutoff=3))
    return out.otherwise(plan(denoise=True, sharpen=2.0, contrast=F.when(quality == "fair", 1.5).otherwise(2.0), brighten=True))


def uncertain_strips(text: Column, most: int = 3) -> Column:
    """Which of up to ``most`` strips of a page hold lines with uncertain words, ascending."""
    lines = F.split(text, "\n")
    strips = F.least(F.lit(most), F.size(lines))
    unsure = F.transform(lines, lambda x, i: F.when(F.contains(x, F.lit("[?]")) | F.contains(x, F.lit("???")) | F.rlike(x, F.lit(r"(?i)\[illegible[^\]]*\]")), F.least(F.floor(i / (F.size(lines) / strips)), strips - 1).cast("int")))
    return F.array_sort(F.array_distinct(F.array_compact(unsure)))


def byte_batches(sizes: Column, most: int) -> Column:
    """The batch number of each of an ordered list of sizes: a new batch begins where the sum would pass ``most``."""
    start = F.struct(F.array().cast("array<int>").alias("numbers"), F.lit(0).cast("long").alias("held"), F.lit(0).alias("batch"))

    def step(acc: Column, size: Column) -> Column:
        full = (acc["held"] > 0) & (acc["held"] + size > most)
        batch = acc["batch"] + full.cast("int")
        return F.struct(F.array_append(acc["numbers"], batch).alias("numbers"), F.when(full, size).otherwise(acc["held"] + size).cast("long").alias("held"), batch.alias("batch"))

    return F.aggregate(sizes, start, step, lambda acc: acc["numbers"])
