"""Whole ingest of image files: samples, quality marks and truths for what is new, in one plan.

``files`` has path and content (bytes), or path and image_hash, and for guided ingest an answer. A file whose hash is known, or comes
earlier by path among the files, is no new sample. Ids come in blocks by range (``store.with_ids``), so concurrent tasks
number their rows without meeting.

Names are matched by content hash; nothing about a path but its page number is kept as meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.functions import numeric, text
from inkledger.sources import store
from inkledger.sources.settle import settled

#: Outcomes that guided ingest counts.
OUTCOMES = ("annotated", "skipped_existing_gt", "skipped_user", "newly_added", "errors")


def hashed(files: DataFrame) -> DataFrame:
    """Files with ``image_hash``; rows without content or hash have none."""
    return files if "image_hash" in files.columns else files.withColumn("image_hash", F.sha2("content", 256))


def _fresh(files: DataFrame, samples: DataFrame) -> DataFrame:
    """The first file, by path, of each hash that no sample has; one row a hash, combined before the exchange."""
    first = files.where("image_hash is not null").groupBy("image_hash").agg(F.min("path").alias("path"))
    return first.join(samples.select("image_hash"), "image_hash", "left_anti")


def _page(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return text.page_number(F.regexp_replace(name, r"\.[^.]*$", ""))


def new_samples(files: DataFrame, samples: DataFrame, student: str = "", category: str = "", source_dir: str = "") -> DataFrame:
    """The samples that ``files`` add, numbered on from those there are, ascending by path."""
    rows = _fresh(hashed(files), samples).select(
        F.col("path").alias("image_path"), "image_hash", F.lit(student).alias("student"), F.lit(category).alias("category"),
        F.lit(source_dir).alias("source_dir"), F.lit("").alias("notes"), _page(F.col("path")).cast("int").alias("page_number"),
    )
    return store.with_ids(rows, store.top_id(samples), "image_path", "image_hash")


def quality_marks(fresh: DataFrame, measures: DataFrame, quality: DataFrame) -> DataFrame:
    """Quality rows of new samples from ``measures`` (image_hash, blur, contrast, mean, deviation), numbered on.

    Samples without measures get none: a file that cannot be judged is still a sample.
    """
    m = fresh.select(F.col("id").alias("sample_id"), "image_hash").join(measures, "image_hash")
    b, c, mean = F.col("blur"), F.col("contrast"), F.col("mean")
    flat = F.lit(0.0)
    faint = numeric.faint(mean, c)
    issues = numeric.quality_issues(b, c, mean, flat)
    rows = m.select(
        "sample_id", b.alias("blur_score"), c.alias("contrast_score"), mean.alias("brightness_mean"), F.col("deviation").alias("brightness_std"),
        numeric.quality_tier(b, c, mean, flat).alias("quality"), with_faint(issues, faint).alias("issues"), faint.alias("faint_ink"),
    )
    return store.with_ids(rows, store.top_id(quality), "sample_id")


def with_faint(issues: Column, faint: Column) -> Column:
    """The issues, and ``faint_ink`` where the ink is faint and low contrast is not among them."""
    return F.when(faint & ~F.array_contains(issues, "low_contrast"), F.array_append(issues, F.lit("faint_ink"))).otherwise(issues)


def recommended(tier: Column, issues: Column, faint: Column) -> Column:
    """How to enhance a page before reading: sharpen, contrast, brighten, full, or null where it is good and not faint."""
    light = F.array_contains(issues, "too_dark") | F.array_contains(issues, "too_bright")
    own = F.array_remove(issues, "faint_ink")
    alone = F.size(own) == 1
    plan = F.when(alone & F.array_contains(own, "blurry"), "sharpen").when(alone & F.array_contains(own, "low_contrast"), "contrast").when(light & alone, "brighten").otherwise("full")
    return F.when(tier != "good", plan).when(faint, "contrast")


def ingest_directory(files: DataFrame, samples: DataFrame, quality: DataFrame, measures: DataFrame | None = None, **about: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all samples, all quality marks, the samples added) after the files are taken in; taking them in again adds nothing."""
    fresh = settled(new_samples(files, samples, **about), "new-samples")
    marked = store.append(quality, quality_marks(fresh, measures, quality)) if measures is not None else quality
    return store.append(samples, fresh), marked, fresh


def ingest_guided(files: DataFrame, samples: DataFrame, truths: DataFrame, student: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all samples, all truths, counts: outcome, n) of files with an ``answer`` each; a blank answer leaves its sample without a truth.

    A file whose sample has a truth, from before or from an earlier file of the same content in this run, is skipped. A file
    without content or hash is an error. A new sample counts as newly added and as annotated or skipped.
    """
    files = settled(hashed(files).select("path", "image_hash", F.trim(F.coalesce("answer", F.lit(""))).alias("answer")), "guided-files")
    fresh = settled(new_samples(files, samples, student, "lab"), "guided-samples")
    everything = store.append(samples, fresh)
    known = everything.select("image_hash", F.col("id").alias("sample_id"))
    had = truths.select("sample_id").distinct().withColumn("had", F.lit(True))
    rows = files.where("image_hash is not null").join(known, "image_hash").join(had, "sample_id", "left")
    # the first answered file of a sample annotates it; later ones find its truth
    answered = rows.where("answer <> ''").groupBy("sample_id").agg(F.min("path").alias("first_"))
    rows = rows.join(answered, "sample_id", "left")
    outcome = F.when(F.col("had"), "skipped_existing_gt").when(F.col("path") == F.col("first_"), "annotated").when(F.col("path") > F.col("first_"), "skipped_existing_gt").otherwise("skipped_user")
    rows = settled(rows.select("sample_id", "path", "answer", outcome.alias("outcome")), "guided-outcomes")
    said = rows.where("outcome = 'annotated'").select("sample_id", F.col("answer").alias("text"), F.lit("lab-grader").alias("source"), F.lit(student).alias("author"))
    counted = rows.select("outcome").unionAll(fresh.select(F.lit("newly_added"))).unionAll(files.where("image_hash is null").select(F.lit("errors")))
    counts = counted.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return everything, store.append(truths, store.with_ids(said, store.top_id(truths), "sample_id")), counts


def ingest_lines(records: DataFrame, images: DataFrame, samples: DataFrame, truths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all samples, all truths, counts: ingested, skipped_dup, skipped_missing) of handwriting lines with their images.

    ``records`` has line_id, writer, form, text; ``images`` path and content. A line's image is ``writer/form/line.png``.
    """
    tail = F.concat_ws("/", "writer", "form", F.concat("line_id", F.lit(".png")))
    wanted = records.select("writer", "text", tail.alias("tail"))
    three = F.concat_ws("/", F.slice(F.split("path", "/"), -3, 3))
    found = hashed(images).select("path", "image_hash", three.alias("tail"))
    rows = settled(wanted.join(found, "tail", "left"), "line-images")
    there = rows.where("image_hash is not null")
    fresh = there.groupBy("image_hash").agg(F.min(F.struct("path", "writer", "text")).alias("one")).join(samples.select("image_hash"), "image_hash", "left_anti")
    fresh = fresh.select("image_hash", F.col("one.path").alias("image_path"), F.concat(F.lit("iam-writer-"), "one.writer").alias("student"), F.lit("iam").alias("category"), F.col("one.text").alias("line_"))
    fresh = settled(store.with_ids(fresh, store.top_id(samples), "image_path", "image_hash"), "line-samples")
    said = fresh.select(F.col("id").alias("sample_id"), F.col("line_").alias("text"), F.lit("iam_ascii").alias("source"))
    missing, added, lines = rows.where("image_hash is null").agg(F.count(F.lit(1)).alias("m")), fresh.agg(F.count(F.lit(1)).alias("a")), there.agg(F.count(F.lit(1)).alias("l"))
    one = lambda df, name: df.select(F.lit(1).alias("k"), F.col(name))
    counts = one(added, "a").join(one(lines, "l"), "k").join(one(missing, "m"), "k").select(F.col("a").alias("ingested"), (F.col("l") - F.col("a")).alias("skipped_dup"), F.col("m").alias("skipped_missing"))
    return store.append(samples, fresh.drop("line_")), store.append(truths, store.with_ids(said, store.top_id(truths), "sample_id")), counts


def earliest(table: DataFrame, key: str) -> DataFrame:
    """The row of least id of each key: what stays where two runs took in the same file at once."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("id"))
    return table.withColumn("n_", n).where("n_ = 1").drop("n_")
