"""Registered queries of whole jobs on the standard tables: ingest, batch results, circuit breaker, sweeps, degradations."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkledger.catalogue import _spread, _t, query
from inkledger.catalogue_pages import WIDTH
from inkledger.catalogue_runs import RUNS, _runs
from inkledger.functions import degrade, raster
from inkledger.plans import reports, sweep
from inkledger.sources import batches, ingest, store
from inkledger.streaming import breaker

_FILES = "(SELECT 'lab/' || lpad(doc_id::VARCHAR, 9, '0') || '_page' || doc_id % 40 || '.png' AS path, sha256(text) AS image_hash, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE lang END AS answer, doc_id FROM documents)"


def _files(spark, sf_dir):
    d, n = _t(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.concat(F.lit("lab/"), F.lpad(n.cast("string"), 9, "0"), F.lit("_page"), (n % 40).cast("string"), F.lit(".png"))
    return d.select("doc_id", path.alias("path"), F.sha2("text", 256).alias("image_hash"), F.when(n % 4 == 0, " ").otherwise(F.col("lang")).alias("answer"))


def _known(spark, sf_dir):
    """Samples that are there before: the contents of labelled documents of good quality, numbered by their least document."""
    files = _files(spark, sf_dir).join(_t(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return files.groupBy("image_hash").agg(F.min("doc_id").alias("id")).select("id", "image_hash")


@query(f"""WITH f AS {_FILES}, k AS (SELECT image_hash, min(doc_id) AS id FROM f WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY image_hash),
n AS (SELECT min(path) AS path, image_hash FROM f WHERE image_hash NOT IN (SELECT image_hash FROM k) GROUP BY image_hash)
SELECT path AS image_path, image_hash, regexp_extract(path, '_page(\\d+)', 1)::INTEGER AS page_number, (SELECT coalesce(max(id), 0) FROM k) + row_number() OVER (ORDER BY path) AS id FROM n""")
def ingest_directory(spark, sf_dir):
    """The samples that a folder of files adds to those known, with their ids."""
    samples = _known(spark, sf_dir).withColumn("image_path", F.lit("before"))
    fresh = ingest.ingest_directory(_files(spark, sf_dir), samples, spark.createDataFrame([], store.SCHEMAS["quality_assessments"]))[2]
    return fresh.select("image_path", "image_hash", "page_number", "id")


@query(f"""WITH f AS {_FILES}, k AS (SELECT image_hash, min(doc_id) AS id FROM f WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY image_hash),
t AS (SELECT DISTINCT image_hash FROM f WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
a AS (SELECT image_hash, min(path) AS first FROM f WHERE trim(answer) <> '' GROUP BY image_hash),
o AS (SELECT CASE WHEN image_hash IN (SELECT image_hash FROM t) AND image_hash IN (SELECT image_hash FROM k) THEN 'skipped_existing_gt' WHEN path = first THEN 'annotated' WHEN path > first THEN 'skipped_existing_gt' ELSE 'skipped_user' END AS outcome FROM f LEFT JOIN a USING (image_hash)
  UNION ALL SELECT 'newly_added' FROM (SELECT DISTINCT image_hash FROM f WHERE image_hash NOT IN (SELECT image_hash FROM k)))
SELECT outcome, count(*) AS n FROM o GROUP BY outcome""")
def ingest_guided(spark, sf_dir):
    """Outcomes of guided ingest; truths are there for known samples whose content a toxic document has."""
    files, samples = _files(spark, sf_dir), _known(spark, sf_dir).withColumn("image_path", F.lit("before"))
    toxic = files.join(_t(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("image_hash").distinct()
    truths = samples.join(toxic, "image_hash").select("id", F.col("id").alias("sample_id"), F.lit("known").alias("text"), F.lit("manual").alias("source"))
    return ingest.ingest_guided(files, samples, truths)[2]


@query("""WITH o AS (SELECT conv_id, turn, conv_id * 100 + turn AS place, 'c' || conv_id AS custom_id, turn % 5 <> 0 AS fine, text FROM conversations WHERE role <> 'system'),
e AS (SELECT conv_id * 100 + turn AS place, 'c' || (conv_id + CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 1000000 END) AS custom_id, text FROM conversations WHERE role = 'system'),
a AS (SELECT custom_id, 0 AS file, -place AS turn, CASE WHEN fine THEN text ELSE '' END AS text, CASE WHEN fine THEN length(text) ELSE 0 END AS input_tokens, CASE WHEN fine THEN turn ELSE 0 END AS output_tokens, CASE WHEN NOT fine THEN 'slow down ' || turn END AS error FROM o
  UNION ALL SELECT custom_id, 1, place, '', 0, 0, text FROM e)
SELECT custom_id, md5(text) AS text_md5, input_tokens::BIGINT AS input_tokens, output_tokens::BIGINT AS output_tokens, error FROM a QUALIFY row_number() OVER (PARTITION BY custom_id ORDER BY file, turn) = 1""")
def batch_results(spark, sf_dir):
    """Both result files are written as lines first: turns of users and assistants are outputs, those of the system errors."""
    c, at = _t(spark, sf_dir, "conversations"), (F.col("conv_id") * 100 + F.col("turn")).alias("at")
    fine = F.col("turn") % 5 != 0
    said = F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message")))
    used = F.struct(F.char_length("text").cast("long").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"))
    failed = F.struct(F.concat(F.lit("slow down "), F.col("turn").cast("string")).alias("message"))
    body = F.struct(F.when(fine, said).alias("choices"), F.when(fine, used).alias("usage"), F.when(~fine, failed).alias("error"))
    response = F.struct(F.when(fine, 200).otherwise(429).alias("status_code"), body.alias("body"))
    key = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    outputs = c.where("role <> 'system'").select(at, F.to_json(F.struct(key.alias("custom_id"), response.alias("response"))).alias("value"))
    other = F.concat(F.lit("c"), (F.col("conv_id") + F.when(F.col("conv_id") % 2 == 0, 0).otherwise(1_000_000)).cast("string"))
    errors = c.where("role = 'system'").select(at, F.to_json(F.struct(other.alias("custom_id"), F.struct(F.col("text").alias("message")).alias("error"))).alias("value"))
    got, _ = batches.retrieve(outputs, errors)
    return got.select("custom_id", F.md5("text").alias("text_md5"), "input_tokens", "output_tokens", "error")


@query("""WITH RECURSIVE c AS (SELECT event_type AS provider, event_id AS call_id, epoch_us(ts) // 60 AS at, (event_id * 7 + user_id) % 5 = 0 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 60, event_id) AS i FROM events),
s AS (SELECT provider, 0::BIGINT AS i, NULL::BIGINT AS call_id, '' AS state, 0 AS failures, -1::BIGINT AS until FROM (SELECT DISTINCT provider FROM c)
 UNION ALL SELECT c.provider, c.i, c.call_id, CASE WHEN s.until < 0 THEN 'closed' WHEN c.at < s.until THEN 'open' ELSE 'half_open' END,
  CASE WHEN s.until >= 0 AND c.at < s.until THEN s.failures WHEN c.ok THEN 0 WHEN s.until >= 0 THEN 3 ELSE s.failures + 1 END,
  CASE WHEN s.until >= 0 AND c.at < s.until THEN s.until WHEN c.ok THEN -1 WHEN s.until >= 0 OR s.failures >= 2 THEN c.at + 60000000 ELSE -1 END
  FROM s JOIN c ON c.provider = s.provider AND c.i = s.i + 1)
SELECT provider, call_id, state, failures::INTEGER AS failures FROM s WHERE i > 0""")
def breaker_replay(spark, sf_dir):
    """Events as calls, sixty times as fast; four fifths fail."""
    e = _t(spark, sf_dir, "events")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60).cast("long")
    ok = (F.col("event_id") * 7 + F.col("user_id")) % 5 == 0
    out = breaker.replay(e.select(F.col("event_type").alias("provider"), F.col("event_id").alias("call_id"), F.timestamp_micros(at).alias("ts"), ok.alias("ok")))
    return out.select("provider", "call_id", "state", "failures")


@query(f"""WITH o AS (SELECT sample_id, CASE WHEN strategy = 'single' AND provider IN ('claude', 'gemini', 'openai') THEN provider WHEN strategy IN ('vote', 'cascade') THEN strategy END AS c, cer FROM {RUNS} WHERE cer IS NOT NULL),
m AS (SELECT sample_id, c, avg(cer) AS e FROM o WHERE c IS NOT NULL GROUP BY ALL),
d AS (SELECT x.c AS a, y.c AS b, round(y.e - x.e, 9) AS d FROM m x JOIN m y ON x.sample_id = y.sample_id AND x.c < y.c),
r AS (SELECT a, b, d, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0),
w AS (SELECT a, b, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w FROM r GROUP BY a, b)
SELECT a, b, count(*) AS n, round(avg(d), 6) AS mean, round(any_value(w), 1)::DOUBLE AS w FROM d JOIN w USING (a, b) GROUP BY a, b""")
def sweep_pairs(spark, sf_dir):
    outputs = _runs(spark, sf_dir).select("sample_id", "provider", "strategy", F.col("cer").alias("error_rate"))
    out = sweep.paired_tests(sweep.differences(sweep.chosen(outputs)))
    return out.select("a", "b", "n", F.round("mean", 6).alias("mean"), F.round("w", 1).cast("double").alias("w"))


@query()  # resampling has no SQL; tests hold the interval's width and that it repeats
def sweep_intervals(spark, sf_dir):
    outputs = _runs(spark, sf_dir).select("sample_id", "provider", "strategy", F.col("cer").alias("error_rate"))
    return sweep.run_sweep(outputs)


@query()  # noise and bends have no SQL; tests compare every kernel with a plain version
def page_variants(spark, sf_dir):
    """The digest of each page under each degradation."""
    rows = degrade.variants(_spread(_t(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", WIDTH)
    return rows.select("doc_id", "kind", F.crc32("pixels").alias("pixels_crc32"))


@query()  # typed text from pixels and set similarity together; tests hold the reasons
def anomaly_reasons(spark, sf_dir):
    """Submissions like others, or typed by their own page."""
    d = _spread(_t(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("writer "), "doc_id").alias("name")))
    typed = d.select("doc_id", raster.styled(F.col("text"), WIDTH).alias("j")).select("doc_id", "j.is_typed", "j.confidence")
    return reports.anomalies_with_reasons(d, "doc_id", "name", "text", typed).select("doc_id", "name", "reasons")
