"""The evaluation store as Parquet tables: schemas, appends, upserts, eviction, text sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkledger.sources.settle import settled

SCHEMAS = {
    "samples": "id long, image_path string, image_hash string, student string, category string, source_dir string, notes string, page_number int, created_at timestamp",
    "ground_truths": "id long, sample_id long, text string, source string, author string, created_at timestamp",
    "quality_assessments": "id long, sample_id long, blur_score double, contrast_score double, brightness_mean double, brightness_std double, quality string, issues array<string>, faint_ink boolean, assessed_at timestamp",
    "runs": "id long, label string, providers array<string>, strategies array<string>, domain string, started_at timestamp, finished_at timestamp, sample_count int, notes string, model_version string, iam_partition string, norm_flags string, vocab_hints_off boolean, is_baseline boolean",
    "provider_outputs": "id long, run_id long, sample_id long, provider string, strategy string, output_text string, confidence double, latency_ms long, input_tokens long, output_tokens long, error string, created_at timestamp, question_marker_rate double",
    "eval_metrics": "id long, provider_output_id long, ground_truth_id long, cer double, wer double, char_edits long, word_edits long, ref_chars long, ref_words long, computed_at timestamp",
    "corrections": "id long, sample_id long, ground_truth_id long, original_text string, confidence double, source string, created_at timestamp",
}


def bootstrap(spark: SparkSession, path: str) -> None:
    """Create the tables that are missing."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}")


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def latest(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The last row of each key; give a total order."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")


def new_rows(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is neither there yet nor earlier among the incoming."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows replace those of their key."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def set_baseline(runs: DataFrame, run_id: int) -> DataFrame:
    if runs.where(F.col("id") == run_id).isEmpty():
        raise ValueError(f"no run {run_id}")
    return runs.withColumn("is_baseline", F.col("id") == run_id)


def finish_run(runs: DataFrame, run_id: int, samples: int, at: Column) -> DataFrame:
    own = F.col("id") == run_id
    return runs.withColumns({"finished_at": F.when(own, at).otherwise(F.col("finished_at")), "sample_count": F.when(own, F.lit(samples)).otherwise(F.col("sample_count"))})


def cache_key(provider: Column, image: Column, prompt: Column, system: Column) -> Column:
    ends = F.concat(F.substring(image, 1, 1000), F.substr(image, F.greatest(F.char_length(image) - 999, F.lit(1))))
    return F.sha2(F.concat_ws("|", provider, ends, F.char_length(image).cast("string"), prompt, system), 256)


def cache_put(cache: DataFrame, incoming: DataFrame, most: int = 10_000) -> DataFrame:
    """Replace by key, then keep the newest ``most``; empty results are not stored."""
    rows = upsert(cache, incoming.where("result <> ''"), "cache_key")
    return rows.orderBy(F.desc("created_at"), "cache_key").limit(most)


def recent_lessons(lessons: DataFrame, most: int = 15) -> DataFrame:
    """The newest ``most`` lessons of each category, newest first."""
    n = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("ts"), F.desc("text")))
    return lessons.withColumn("n", n).where(F.col("n") <= most)


def add_lessons(lessons: DataFrame, incoming: DataFrame, window: int = 15) -> DataFrame:
    """Incoming lessons whose trimmed text is not among the category's last ``window``."""
    known = recent_lessons(lessons, window).select("category", F.trim("text").alias("text"))
    fresh = incoming.withColumn("text", F.trim("text")).where("text <> ''")
    return fresh.join(known, ["category", "text"], "left_anti")


def read_lessons(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text string, category string, ts string").option("mode", "DROPMALFORMED").json(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, content hash, page number and bytes of image files."""
    from inkledger.functions.text import page_number

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,tiff,tif,bmp,webp}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("image_hash"), page_number(F.element_at(F.split("path", "/"), -1)).alias("page_number"), "content")


def parse_iam_lines(lines: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """line_id, writer, form, text of handwriting-line records (column ``value``); damaged and failed lines go."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.select(F.trim("value").alias("v"), f.alias("f")).where("v <> '' and not startswith(v, '#')").where((F.size("f") >= 9) & (F.get("f", F.lit(1)) != "err"))
    ids = F.split(F.get("f", F.lit(0)), "-")
    rows = rows.select(F.get("f", F.lit(0)).alias("line_id"), ids.alias("p"), F.trim(F.translate(F.array_join(F.slice("f", 9, F.size("f")), " "), "|", " ")).alias("text")).where(F.size("p") >= 3)
    rows = rows.select("line_id", F.get("p", F.lit(0)).alias("writer"), F.concat_ws("-", F.get("p", F.lit(0)), F.get("p", F.lit(1))).alias("form"), "text")
    return rows if forms is None else rows.join(forms.select("form").distinct(), "form", "left_semi").select("line_id", "writer", "form", "text")


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("form")).where("form <> ''").distinct()


def top_id(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.max("id"), F.lit(0))).head()[0]


def with_ids(new: DataFrame, top: int, *order: str) -> DataFrame:
    """``new`` with ids from ``top`` + 1 on, gapless and ascending by ``order``.

    Rows go to ranges of the order; each range gets a block of ids as long as its count, after the blocks before it. No
    task sorts more than a range, and only the ranges' counts are added up. The ranges are settled first, so that a lost
    executor cannot deal rows out anew between counting and numbering.
    """
    parts = max(1, int(new.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = settled(new.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("range_", F.spark_partition_id()).withColumn("place_", place), "ids")
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    blocks = ranges.groupBy("range_").agg(F.count(F.lit(1)).alias("n_")).select("range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("from_"))
    return ranges.join(F.broadcast(blocks), "range_").withColumn("id", F.lit(top + 1) + F.col("from_") + F.col("place_")).drop("range_", "place_", "from_")


def record_corrections(samples: DataFrame, truths: DataFrame, corrections: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after ``incoming`` (image_hash, image_path, writer, original, corrected, confidence, source): a sample for each new hash, a truth for each new text of a sample, and always a correction."""
    def numbered(new: DataFrame, old: DataFrame, *order: str) -> DataFrame:
        return with_ids(new, top_id(old), *order)

    first = incoming.groupBy("image_hash").agg(F.min_by("image_path", "image_path").alias("image_path"), F.min("writer").alias("student"))
    samples = samples.unionByName(numbered(first.join(samples.select("image_hash"), "image_hash", "left_anti"), samples, "image_hash"), allowMissingColumns=True)
    placed = incoming.join(samples.select("image_hash", F.col("id").alias("sample_id")), "image_hash")
    fresh = placed.groupBy("sample_id", F.col("corrected").alias("text")).agg(F.min("source").alias("source"))
    fresh = fresh.join(truths.select("sample_id", "text"), ["sample_id", "text"], "left_anti")
    truths = truths.unionByName(numbered(fresh, truths, "sample_id", "text"), allowMissingColumns=True)
    last = truths.groupBy("sample_id", "text").agg(F.max("id").alias("ground_truth_id"))
    said = placed.join(last, (placed["sample_id"] == last["sample_id"]) & (placed["corrected"] == last["text"])).select(placed["sample_id"], "ground_truth_id", F.col("original").alias("original_text"), "confidence", "source")
    corrections = corrections.unionByName(numbered(said, corrections, "sample_id", "ground_truth_id", "original_text"), allowMissingColumns=True)
    return samples, truths, corrections


def append(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows added at the end: truths, outputs, metrics, runs and lessons grow by whole rows."""
    return table.unionByName(incoming, allowMissingColumns=True)


def insert_samples(samples: DataFrame, incoming: DataFrame) -> DataFrame:
    """Appended samples; a hash that is there already, or comes twice, is an error."""
    twice = samples.select("image_hash").unionAll(incoming.select("image_hash")).groupBy("image_hash").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"a sample with hash {twice.head()['image_hash']} is there already")
    return append(samples, incoming)


def without_key(table: DataFrame, column: str, value) -> DataFrame:
    """The table after one key's rows are cleared."""
    return table.where(~F.col(column).eqNullSafe(F.lit(value)))


def baseline(runs: DataFrame) -> DataFrame:
    """The pinned run, if any."""
    return runs.where("is_baseline").agg(F.max("id").alias("id")).where("id is not null")


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max("id").alias("id")).where("id is not null")


def list_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("id"))


def lookup(table: DataFrame, column: str, value) -> DataFrame:
    """The row of a key, or none; the filter reaches the scan."""
    return table.where(F.col(column) == F.lit(value)).limit(1)


def cache_get(cache: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the results of the asked keys, the cache with their hits counted)."""
    asked = keys.groupBy("cache_key").agg(F.count(F.lit(1)).alias("asked_"))
    found = cache.join(asked.select("cache_key"), "cache_key", "left_semi")
    after = cache.join(asked, "cache_key", "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)) + F.coalesce("asked_", F.lit(0))).drop("asked_")
    return found, after


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hits"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Writer profiles from JSON files; damaged files and those without a writer are skipped."""
    habits = "writer_id string, crosses_sevens boolean, open_four boolean, a_style string, connects_letters boolean, zero_vs_oh string, confusion_resolutions map<string,string>"
    return spark.read.schema(habits).option("multiLine", "true").option("pathGlobFilter", "*.json").option("mode", "DROPMALFORMED").json(path).where("writer_id is not null")


def read_words(spark: SparkSession, path: str, most: int = 5000) -> DataFrame:
    """The first ``most`` plain lower-case words of 3 to 12 letters of a word list, one a line."""
    words = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).withColumn("word", F.trim("value"))
    return words.where(F.rlike("word", F.lit("^[a-z]{3,12}$"))).orderBy("at").limit(most).select("word")


def training_pairs(outputs: DataFrame, truths: DataFrame, providers: list[str] | None = None, strategies: list[str] | None = None, least: int = 10) -> DataFrame:
    """Distinct (corrupted, clean) pairs of outputs without an error and every truth of their sample; equal and short texts go."""
    rows = outputs.where("error is null")
    for column, wanted in (("provider", providers), ("strategy", strategies)):
        rows = rows.where(F.col(column).isin(wanted)) if wanted else rows
    rows = rows.select("sample_id", F.col("output_text").alias("corrupted")).where(F.char_length("corrupted") >= least)
    good = truths.select("sample_id", F.col("text").alias("clean")).where(F.char_length("clean") >= least)
    return rows.join(good, "sample_id").where("corrupted <> clean").select("corrupted", "clean").distinct()


def lesson_patterns(lessons: DataFrame) -> DataFrame:
    """How many lessons state a misreading with its correction."""
    return lessons.agg(F.count_if(F.rlike("text", F.lit(r"Model read '[^']+' but correct reading is '[^']+'"))).alias("n"))


def errors_for_lessons(results: DataFrame, truths: DataFrame, least: float = 0.0) -> DataFrame:
    """(sample_id, output_text, truth): outputs without an error and above ``least`` whose latest truth a person gave."""
    last = latest(truths, "sample_id", F.desc("id")).where(F.col("source").isin("manual", "corrected_output"))
    fit = results.where("error is null or error = ''").where(F.col("cer") > least)
    return fit.join(last.select("sample_id", F.col("text").alias("truth")), "sample_id").select("sample_id", "output_text", "truth")


def split_of(key: Column, seed: int = 42, validation: float = 0.05, test: float = 0.05) -> Column:
    """train, val or test by a hash of the key and seed: the same for every run, without an exchange."""
    share = F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / 2**32
    return F.when(share < validation, "val").when(share < validation + test, "test").otherwise("train")


def model_versions(providers: Column, models: dict[str, str]) -> Column:
    """``provider/model`` of each provider, joined by commas."""
    names = F.create_map(*[F.lit(x) for pair in models.items() for x in pair])
    return F.array_join(F.transform(providers, lambda p: F.concat(p, F.lit("/"), F.coalesce(F.try_element_at(names, p), F.lit("unknown")))), ",")


def token_sums(usage: Column) -> Column:
    """input and output tokens over a map of provider to struct(input, output)."""
    values = F.map_values(usage)
    add = lambda k: F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[k], F.lit(0)))
    return F.struct(add("input").alias("input"), add("output").alias("output"))


def token_confidence(logprobs: Column) -> Column:
    """Mean probability of the tokens, 0 without any."""
    return F.when(F.size(logprobs) > 0, F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + F.exp(x)) / F.size(logprobs)).otherwise(0.0)


def ingest_outcomes(files: DataFrame, samples: DataFrame, truths: DataFrame) -> DataFrame:
    """files (path, image_hash, answer) with their outcome: skipped_existing_gt, skipped_dup, skipped_user (a known image without an answer), annotated or newly_added."""
    known = samples.select("image_hash", F.col("id").alias("sample_id"))
    done = truths.select("sample_id").distinct().withColumn("has_truth", F.lit(True))
    n = F.row_number().over(Window.partitionBy("image_hash").orderBy("path"))
    rows = files.withColumn("n", n).join(known, "image_hash", "left").join(done, "sample_id", "left")
    empty = F.trim(F.coalesce("answer", F.lit(""))) == ""
    outcome = F.when(F.col("has_truth"), "skipped_existing_gt").when(F.col("n") > 1, "skipped_dup").when(F.col("sample_id").isNotNull() & empty, "skipped_user").when(empty, "newly_added").otherwise("annotated")
    return rows.select("path", "image_hash", outcome.alias("outcome"))
