"""Registered queries over the standard tables, each beside its DuckDB SQL.

The store's tables are stood in for by the standard ones: provider outputs and metrics by ``events`` (provider =
event type, sample = user, run = event_id % 4, error rate = value / 500), samples by ``documents``, quality marks by
``labels``, versioned ground truth by ``conversations``, writer vectors by ``embeddings``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkledger.functions import numeric, text
from inkledger.operators import correction, similarity, stats, voting
from inkledger.plans import reports
from inkledger.sources import store
from inkledger.streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores where the files alone would keep few of them busy; for work that costs far more than moving its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 4 * cores else df.repartition(2 * cores)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("provider"), F.col("user_id").alias("sample_id"), (F.col("event_id") % 4).alias("run_id"), (F.col("value") / 500).alias("cer"), "ts", F.get_json_object("props", "$.k").cast("long").alias("tokens"))


RESULTS = "(SELECT event_id, event_type AS provider, user_id AS sample_id, event_id % 4 AS run_id, value / 500 AS cer, ts, json_extract_string(props, '$.k')::BIGINT AS tokens FROM events)"
MEANS = f"(SELECT run_id, provider, round(avg(cer), 9) AS mean FROM {RESULTS} GROUP BY ALL)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_t(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("text").alias("ref"), F.translate("text", "aeo", "oca").alias("hyp"))


PAIRS = "(SELECT doc_id, text AS ref, translate(text, 'aeo', 'oca') AS hyp FROM documents)"


def norm_sql(x: str) -> str:
    out = f"lower({x})"
    for marker in text.MARKERS:
        out = f"regexp_replace({out}, '{marker}', '', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


MARKED = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' [?]' WHEN doc_id % 7 = 0 THEN text || ' [illegible: 3] ???' ELSE text END AS t FROM documents)"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" [?]"))).when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" [illegible: 3] ???"))).otherwise(F.col("text"))
    return d.select("doc_id", t.alias("t"))


# ---- reports ---------------------------------------------------------------------------------------------------


@query(f"SELECT provider, round(avg(cer), 6) AS mean, round(median(cer), 6) AS median, round(coalesce(stddev_samp(cer), 0), 6) AS stdev, count(*) AS n, count_if(provider = 'error') AS failures FROM {RESULTS} GROUP BY provider")
def run_report(spark, sf_dir):
    out = reports.aggregate(_results(spark, sf_dir), ["provider"], "cer", F.col("provider") == "error")
    return out.select("provider", *[F.round(k, 6).alias(k) for k in ("mean", "median", "stdev")], "n", "failures")


@query("SELECT source AS writer, round(avg(quality), 6) AS mean, min(quality) AS least, max(quality) AS most, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE source <> '' GROUP BY source")
def per_writer_report(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("writer")).join(_t(spark, sf_dir, "labels"), "doc_id")
    return reports.per_writer(rows, "writer", "quality").withColumn("mean", F.round("mean", 6))


@query("SELECT quality, round(avg(m), 6) AS mean, count(*) AS samples FROM (SELECT doc_id, quality, avg(n_chars) AS m FROM documents JOIN labels USING (doc_id) GROUP BY ALL) GROUP BY quality")
def quality_tiers(spark, sf_dir):
    each = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").groupBy("doc_id", "quality").agg(F.avg("n_chars").alias("m"))
    return each.groupBy("quality").agg(F.round(F.avg("m"), 6).alias("mean"), F.count(F.lit(1)).alias("samples"))


@query(f"SELECT run_id, round(CASE WHEN count(*) < 3 OR stddev_pop(tokens / 100.0) * stddev_pop(cer) = 0 THEN 0 ELSE covar_pop(tokens / 100.0, cer) / (stddev_pop(tokens / 100.0) * stddev_pop(cer)) END, 6) AS corr, count(*) AS n FROM {RESULTS} GROUP BY run_id")
def calibration_corr(spark, sf_dir):
    rows = _results(spark, sf_dir).withColumn("confidence", F.col("tokens") / 100.0)
    return reports.calibration(rows, ["run_id"], "confidence", "cer").withColumn("corr", F.round("corr", 6))


@query(f"SELECT CASE WHEN c < 0.3 THEN '0.0-0.3' WHEN c < 0.5 THEN '0.3-0.5' WHEN c < 0.7 THEN '0.5-0.7' WHEN c < 0.9 THEN '0.7-0.9' ELSE '0.9-1.0' END AS bucket, round(avg(cer), 6) AS mean, count(*) AS n FROM (SELECT *, (event_id % 100) / 100.0 AS c FROM {RESULTS}) GROUP BY 1")
def calibration_buckets(spark, sf_dir):
    rows = _results(spark, sf_dir).withColumn("bucket", reports.confidence_bucket((F.col("event_id") % 100) / 100.0))
    return rows.groupBy("bucket").agg(F.round(F.avg("cer"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def _means(spark, sf_dir) -> DataFrame:
    return _results(spark, sf_dir).groupBy("run_id", "provider").agg(F.round(F.avg("cer"), 9).alias("mean"))


@query(f"SELECT provider, before, after, round(after - before, 9) AS delta, CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'removed' WHEN after - before < -0.005 THEN 'improved' WHEN after - before > 0.005 THEN 'worse' ELSE 'unchanged' END AS status FROM (SELECT provider, mean AS before FROM {MEANS} WHERE run_id = 0 AND provider <> 'view') FULL JOIN (SELECT provider, mean AS after FROM {MEANS} WHERE run_id = 1 AND provider <> 'error') USING (provider)")
def compare_runs(spark, sf_dir):
    m = _means(spark, sf_dir)
    out = reports.compare(m.where("run_id = 0 and provider <> 'view'"), m.where("run_id = 1 and provider <> 'error'"), ["provider"])
    return out.withColumn("delta", F.round("delta", 9))


@query(f"SELECT * FROM (SELECT run_id, provider, mean, lag(mean) OVER (PARTITION BY provider ORDER BY run_id) AS previous, round(mean - lag(mean) OVER (PARTITION BY provider ORDER BY run_id), 9) AS delta FROM {MEANS}) WHERE delta > 0.001")
def regressions_previous(spark, sf_dir):
    return reports.regressions(_means(spark, sf_dir), "run_id", ["provider"], threshold=0.001).withColumn("delta", F.round("delta", 9))


@query(f"SELECT m.run_id, m.provider, m.mean, b.mean AS previous, round(m.mean - b.mean, 9) AS delta FROM {MEANS} m JOIN {MEANS} b ON b.run_id = 0 AND m.run_id <> 0 AND m.provider = b.provider WHERE m.mean - b.mean > 0.001")
def regressions_baseline(spark, sf_dir):
    return reports.regressions(_means(spark, sf_dir), "run_id", ["provider"], baseline=0, threshold=0.001).withColumn("delta", F.round("delta", 9))


@query(f"""
WITH r AS (SELECT run_id, provider, round(avg(cer), 9) AS error, round(avg(tokens), 9) AS cost FROM {RESULTS} GROUP BY ALL),
e AS (SELECT provider, avg(error) AS error, avg(cost) AS cost, stddev_samp(error) AS d, count(*) AS runs FROM r GROUP BY provider),
f AS (SELECT provider, error, cost, coalesce(d, (SELECT median(d) FROM e)) AS deviation, runs FROM e),
s AS (SELECT provider, error, cost, deviation, runs,
  0.70 * (1 - (error - min(error) OVER ()) / (max(error) OVER () - min(error) OVER ())) + 0.15 * (1 - (cost - min(cost) OVER ()) / (max(cost) OVER () - min(cost) OVER ())) + 0.15 * (1 - (deviation - min(deviation) OVER ()) / (max(deviation) OVER () - min(deviation) OVER ())) AS s FROM f)
SELECT provider, round(error, 6) AS error, round(cost, 6) AS cost, round(deviation, 6) AS deviation, runs, round(s, 6) AS score, row_number() OVER (ORDER BY round(s, 6) DESC, provider)::INTEGER AS rank FROM s""")
def recommend(spark, sf_dir):
    each = _results(spark, sf_dir).groupBy("run_id", "provider").agg(F.round(F.avg("cer"), 9).alias("error"), F.round(F.avg("tokens"), 9).alias("cost"))
    out = reports.recommend(each, ["provider"])
    return out.withColumns({k: F.round(k, 6) for k in ("error", "cost", "deviation")})


@query(f"SELECT sample_id, round(avg(cer), 9) AS mean FROM {RESULTS} GROUP BY sample_id ORDER BY avg(cer) DESC, sample_id LIMIT 3")
def hardest_samples(spark, sf_dir):
    return reports.hardest(_results(spark, sf_dir), "sample_id", "cer", 3).withColumn("mean", F.round("mean", 9))


PAIRED = f"(SELECT provider, sample_id, avg(cer) FILTER (run_id = 0) AS a, avg(cer) FILTER (run_id = 1) AS b FROM {RESULTS} GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL)"


def _paired(spark, sf_dir) -> DataFrame:
    r = _results(spark, sf_dir).groupBy("provider", "sample_id").agg(*[F.avg(F.when(F.col("run_id") == k, F.col("cer"))).alias(n) for k, n in ((0, "a"), (1, "b"))])
    return r.where("a is not null and b is not null").withColumns({k: F.round(k, 6) for k in ("a", "b")})


@query(f"SELECT provider, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b FROM {PAIRED} GROUP BY provider")
def paired_runs(spark, sf_dir):
    r = _results(spark, sf_dir).groupBy("provider", "sample_id").agg(*[F.avg(F.when(F.col("run_id") == k, F.col("cer"))).alias(n) for k, n in ((0, "a"), (1, "b"))]).where("a is not null and b is not null")
    return r.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"))


@query(f"""
WITH d AS (SELECT provider, round(round(a, 6) - round(b, 6), 12) AS d FROM {PAIRED} WHERE round(round(a, 6) - round(b, 6), 12) <> 0),
r AS (SELECT provider, d, rank() OVER (PARTITION BY provider ORDER BY abs(d)) + (count(*) OVER (PARTITION BY provider, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY provider, abs(d)) AS t FROM d),
s AS (SELECT provider, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, sum((t * t - 1) / 48.0) AS tie FROM r GROUP BY provider)
SELECT provider, n, w_plus::DOUBLE AS w_plus, w_minus::DOUBLE AS w_minus, round((g + CASE WHEN g < 0 THEN 0.5 WHEN g > 0 THEN -0.5 ELSE 0 END) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tie), 6) AS z
FROM (SELECT *, least(w_plus, w_minus) - n * (n + 1) / 4.0 AS g FROM s)""")
def signed_rank(spark, sf_dir):
    out = stats.signed_rank(_paired(spark, sf_dir), ["provider"])
    return out.select("provider", "n", "w_plus", "w_minus", F.round("z", 6).alias("z"))


@query()
def signed_rank_p(spark, sf_dir):
    return stats.signed_rank(_paired(spark, sf_dir), ["provider"])


@query()
def bootstrap_interval(spark, sf_dir):
    return stats.bootstrap_mean(_results(spark, sf_dir), ["provider", "run_id"], "cer", seed=7)


# ---- joins, windows, sets ----------------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def with_truth(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def without_truth(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS has_truth FROM documents d")
def truth_flag(spark, sf_dir):
    marks = _t(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("t")).dropDuplicates(["doc_id"])
    return _t(spark, sf_dir, "documents").select("doc_id").join(marks, "doc_id", "left").select("doc_id", F.coalesce("t", F.lit(False)).alias("has_truth"))


@query("SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def run_results(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("SELECT conv_id, turn, text FROM conversations c WHERE turn = (SELECT max(turn) FROM conversations x WHERE x.conv_id = c.conv_id)")
def latest_truth(spark, sf_dir):
    return store.latest(_t(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", F.desc("turn"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_provider(spark, sf_dir):
    return store.latest(_t(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("SELECT source, doc_id, n FROM (SELECT source, d.doc_id, row_number() OVER (PARTITION BY source ORDER BY coalesce(quality, -1) DESC, d.doc_id)::INTEGER AS n FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE n <= 3")
def exemplars(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.coalesce("quality", F.lit(-1)).desc(), "doc_id"))
    return rows.withColumn("n", n).where("n <= 3").select("source", "doc_id", "n")


@query("SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def content_hash_dedupe(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT doc_id, w FROM documents, range(1, 4) r(w) WHERE doc_id % 2 = 0 OR w = 1")
def replicate_pairs(spark, sf_dir):
    times = F.when(F.col("doc_id") % 2 == 0, 3).otherwise(1)
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long"))).alias("w"))


@query("SELECT event_id AS cache_key, ts FROM events ORDER BY ts DESC, event_id LIMIT 100")
def cache_evict(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("event_id").alias("cache_key"), F.col("ts").alias("created_at"), F.lit("x").alias("result"))
    return store.cache_put(rows.limit(0), rows, 100).select("cache_key", F.col("created_at").alias("ts"))


@query("SELECT role AS category, text, n FROM (SELECT role, text, row_number() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn DESC, text DESC)::INTEGER AS n FROM conversations) WHERE n <= 15")
def lessons_recent(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select(F.col("role").alias("category"), "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("ts"))
    return store.recent_lessons(rows).select("category", "text", "n")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels")
def upsert_quality(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").select("doc_id", "quality")
    return store.upsert(rows, rows.where("doc_id % 5 = 0").withColumn("quality", (1 - F.col("quality")).cast("int")), "doc_id")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_windowed(spark, sf_dir):
    out = stream.windowed(_t(spark, sf_dir, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, event_id, event_type, (SELECT count(*) FROM events x WHERE x.user_id = e.user_id AND (x.ts, x.event_id) <= (e.ts, e.event_id)) AS place FROM events e")
def occurrence_number(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", n.alias("place"))


# ---- text ------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {norm_sql('nfc_normalize(t)')} AS t FROM {MARKED}")
def normalize_text(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", text.normalise(text.nfc(F.col("t"))).alias("t"))


@query()  # DuckDB's edit distance is quadratic in whole texts; tests compare with a plain version
def cer_pairs(spark, sf_dir):
    h, r = (text.normalise(F.col(k)).alias(k) for k in ("hyp", "ref"))
    e = text.normal_char_error(F.col("hyp"), F.col("ref"))
    return _pairs(spark, sf_dir).select("doc_id", h, r).select("doc_id", e["edits"].alias("edits"), e["ref_size"].alias("ref_size"), F.round(e["rate"], 9).alias("rate"))


@query()
def wer_pairs(spark, sf_dir):
    h, r = (text.tokens(text.normalise(F.col(k))).alias(k) for k in ("hyp", "ref"))
    e = text.token_error(F.col("hyp"), F.col("ref"))
    return _pairs(spark, sf_dir).select("doc_id", h, r).select("doc_id", e["edits"].alias("edits"), e["ref_size"].alias("ref_size"), F.round(e["rate"], 9).alias("rate"))


@query()  # as cer_pairs
def change_ratio_filter(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("doc_id", text.change_ratio(F.col("hyp"), F.col("ref"), once=True).alias("ratio"))
    return rows.where("ratio <= 0.25").withColumn("ratio", F.round("ratio", 9))


@query(f"SELECT doc_id, round(CASE WHEN len(k) = 0 THEN 0 ELSE len(list_filter(k, lambda w: w = '[?]')) / len(k) END, 9) AS rate FROM (SELECT doc_id, {tokens_sql('t')} AS k FROM {MARKED})")
def marker_rate(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", F.round(text.marker_rate(F.col("t")), 9).alias("rate"))


@query(rf"SELECT doc_id, len(regexp_extract_all(t, '(?i)\[\?\]|\?\?\?|\[illegible[^\]]*\]|\[unclear\]|unable to read'))::INTEGER AS marks FROM {MARKED}")
def uncertainty_count(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", text.uncertainty(F.col("t")).alias("marks"))


CONFIDENCE = rf"""(SELECT doc_id, t, n, m, a, CASE WHEN trim(t, e' \t\r\n') = '' THEN 0 ELSE round(least(0.7, greatest(0, CASE WHEN a THEN least(c, 0.45) ELSE c END)), 3) END AS confidence FROM (
  SELECT *, 0.7::DOUBLE - 1.5::DOUBLE * m / greatest(n, 1) - CASE WHEN n < 3 THEN 0.15 ELSE 0 END - CASE WHEN n <= 5 AND m = 0 THEN 0.1 ELSE 0 END - CASE WHEN n > 5 AND len(list_distinct(list_transform(k, lambda w: lower(w)))) / n < 0.15 THEN 0.2 ELSE 0 END AS c FROM (
    SELECT doc_id, t, {tokens_sql('t')} AS k, len({tokens_sql('t')}) AS n, len(regexp_extract_all(t, '(?i)\[\?\]|\?\?\?|\[illegible[^\]]*\]|\[unclear\]|unable to read')) AS m, regexp_matches(trim(t, e' \t\r\n'), '^\p{{L}}{{1,2}}$') AS a FROM {MARKED})))"""


@query(f"SELECT doc_id, confidence::DOUBLE AS confidence FROM {CONFIDENCE}")
def single_confidence(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", text.single_confidence(F.col("t")).alias("confidence"))


@query(f"SELECT doc_id, CASE WHEN confidence < 0.5 OR m >= 3 OR (n < 5 AND NOT starts_with(trim(t, e' \t\r\n'), '[')) OR a OR m / greatest(n, 1) > 0.1 OR contains(lower(t), '[illegible') OR contains(lower(t), 'page faint') THEN 'LOW' ELSE 'HIGH' END AS level FROM {CONFIDENCE}")
def confidence_level(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", text.confidence_level(F.col("t"), text.single_confidence(F.col("t"))).alias("level"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(t, '^(?:(?i:Here is|The transcribed|The handwritten|I can see|The text reads|Transcription:|Below is|The following|The image shows|I''ll transcribe)[^\n]*\n){1,3}', ''), '(?:\n(?i:Note:|Please note|Some words|I was unable|Disclaimer|The handwriting|I hope|Let me know|If you need|Overall)[^\n]*){1,3}$', '') AS t FROM (SELECT doc_id, 'Here is the text:' || chr(10) || text || chr(10) || 'Note: done' AS t FROM documents)")
def postprocess_strip(spark, sf_dir):
    t = F.concat(F.lit("Here is the text:\n"), "text", F.lit("\nNote: done"))
    return _t(spark, sf_dir, "documents").select("doc_id", text.strip_chatter(t).alias("t"))


@query()
def markdown_strip(spark, sf_dir):
    t = F.concat(F.lit("# Title\n**bold** and _slanted_\n"), "text")
    return _t(spark, sf_dir, "documents").select("doc_id", text.strip_markdown(t).alias("t"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
b AS (SELECT *, lower(trim(line, e' \t\r\f\x0B')) AS bare FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, bare ORDER BY i) AS k FROM b)
SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM n WHERE bare = '' OR k <= 2 GROUP BY doc_id""")
def line_dedupe(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.drop_repeated_lines(F.col("text")).alias("t"))


@query(r"SELECT doc_id, list_transform(regexp_extract_all(t, '\[\?alt:\s*([^\]]*)\]', 1), lambda m: list_transform(string_split(m, '/'), lambda x: trim(x)))::VARCHAR AS options FROM (SELECT doc_id, text || ' [?alt: a/ b] x [?alt: c/d]' AS t FROM documents)")
def alt_markers(spark, sf_dir):
    t = F.concat("text", F.lit(" [?alt: a/ b] x [?alt: c/d]"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.transform(text.alternatives(t), lambda x: x["options"]).cast("string").alias("options"))


@query(r"SELECT page_id, coalesce(nullif(regexp_extract(url, '(?i)page[_-]?(\d+)', 1), ''), regexp_extract_all(url, '(\d+)', 1)[-1], '0')::BIGINT AS page FROM pages")
def page_number_extract(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.page_number(F.col("url")).alias("page"))


TERM_LIST = ["the", "and", "der", "que", "les"]


@query(f"SELECT doc_id, round(CASE WHEN len(w) = 0 THEN -1 ELSE len(list_intersect(w, h)) / len(w) END, 9) AS accuracy, len(w)::INTEGER AS total FROM (SELECT doc_id, list_intersect({TERM_LIST}, {tokens_sql('r')}) AS w, {tokens_sql('h')} AS h FROM (SELECT doc_id, {norm_sql('hyp')} AS h, {norm_sql('ref')} AS r FROM {PAIRS}))")
def domain_terms(spark, sf_dir):
    a = text.term_accuracy(F.col("hyp"), F.col("ref"), TERM_LIST, [])
    return _pairs(spark, sf_dir).select("doc_id", F.round(a["accuracy"], 9).alias("accuracy"), a["total"].alias("total"))


@query("SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey WHERE damerau_levenshtein(a.c_name, b.c_name) <= 1")
def within_one_edit(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    keys = rows.withColumn("key", F.explode(text.deletions(F.col("c_name"))))
    a, b = (keys.select(*(F.col(k).alias(f"{k}_{side}" if k in ("c_custkey", "c_name") else k) for k in keys.columns)) for side in "ab")
    near = a.join(b, ["c_nationkey", "c_mktsegment", "key"]).where("c_custkey_a < c_custkey_b").select("c_custkey_a", "c_name_a", "c_custkey_b", "c_name_b").distinct()
    return near.where(text.one_edit(F.col("c_name_a"), F.col("c_name_b"))).select(F.col("c_custkey_a").alias("a"), F.col("c_custkey_b").alias("b"))


@query()
def term_correction(spark, sf_dir):
    t = F.concat(F.lit("The mitochondra and natural enzymne "), "text")
    return _spread(_t(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", correction.correct_terms(t).alias("t"))


@query()
def lookalike_correction(spark, sf_dir):
    t = F.concat(F.lit("the rnembrane and 0smosis "), "text")
    return _spread(_t(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", correction.correct_lookalikes(t).alias("c")).select("doc_id", "c.text", F.size("c.corrections").alias("n"))


@query(r"""
WITH k AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS t FROM documents),
g AS (SELECT doc_id, CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS g FROM k),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id)
SELECT a, b, round(c / (na + nb - c), 4) AS score FROM p WHERE c / (na + nb - c) >= 0.85""")
def text_similarity_pairs(spark, sf_dir):
    return similarity.similar_texts(_spread(_t(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


# ---- vectors, votes, routing -------------------------------------------------------------------------------------

CENTROIDS = "(SELECT label, list(x ORDER BY place) AS m FROM (SELECT label, place, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY ALL) GROUP BY label)"


@query(f"SELECT label, place::INTEGER AS place, round(x, 5) AS x FROM (SELECT label, unnest(list_transform(m, lambda x: x / sqrt(list_inner_product(m, m)))) AS x, generate_subscripts(m, 1) AS place FROM {CENTROIDS})")
def writer_centroids(spark, sf_dir):
    c = similarity.centroids(_t(spark, sf_dir, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("place", "x")).select("label", (F.col("place") + 1).alias("place"), F.round("x", 5).alias("x"))


@query(f"SELECT vec_id, arg_max(l, s) AS label, round(max(s), 5) AS score FROM (SELECT vec_id, c.label AS l, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), m) AS s FROM embeddings, {CENTROIDS} c) GROUP BY vec_id")
def identify_writer(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    out = similarity.nearest_profile(e, "vec_id", "embedding", similarity.centroids(e, "label", "embedding"), "label", -1.0)
    return out.withColumn("score", F.round("score", 5))


@query(f"SELECT * FROM (SELECT sample_id, provider AS word, sum(tokens)::DOUBLE AS weight FROM {RESULTS} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY weight DESC, word) = 1")
def vote_tally(spark, sf_dir):
    t = _results(spark, sf_dir).groupBy("sample_id", F.col("provider").alias("word")).agg(F.sum("tokens").cast("double").alias("weight"))
    return store.latest(t, "sample_id", F.desc("weight"), F.col("word"))


@query(r"""SELECT event_type || '+claude' AS provider, event_id, round((k * CASE event_type WHEN 'view' THEN 0 ELSE 0 END + k * 3.0 / 1e6 + 10 * 15.0 / 1e6) / 2, 9) AS cost FROM (SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events)""")
def composite_cost(spark, sf_dir):
    r = _results(spark, sf_dir).withColumn("provider", F.concat("provider", F.lit("+claude")))
    return r.select("provider", "event_id", F.round(numeric.cost(F.col("tokens"), F.lit(10), F.col("provider")), 9).alias("cost"))


@query("SELECT p_partkey, CASE WHEN p_size <= 15 THEN 200 WHEN p_size <= 30 THEN 150 WHEN p_size <= 50 THEN 120 ELSE 100 END AS dpi FROM part")
def adaptive_dpi(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", numeric.page_tier(F.col("p_size"))["dpi"].alias("dpi"))


@query("SELECT l_orderkey, l_linenumber, q, CASE WHEN q = 'good' AND b >= 200 AND c >= 0.6 THEN 'easy' WHEN q = 'poor' OR b < 80 OR c < 0.3 THEN 'hard' ELSE 'medium' END AS route FROM (SELECT *, CASE WHEN n = 0 THEN 'good' WHEN n = 1 AND b >= 50 AND c >= 0.25 THEN 'fair' ELSE 'poor' END AS q FROM (SELECT *, (b < 100)::INT + (c < 0.4)::INT AS n FROM (SELECT l_orderkey, l_linenumber, l_quantity * 6 AS b, l_discount * 10 AS c FROM lineitem)))")
def smart_route(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 6).alias("b"), (F.col("l_discount") * 10).alias("c"))
    q = numeric.quality_tier(F.col("b"), F.col("c"), F.lit(150), F.lit(0.0))
    issues = F.size(numeric.quality_issues(F.col("b"), F.col("c"), F.lit(150), F.lit(0.0)))
    route = numeric.difficulty(q, F.col("b"), F.col("c"), F.lit(False), issues)
    return rows.select("l_orderkey", "l_linenumber", q.alias("q"), route.alias("route"))


SHEET = numeric.Layout(left=(0.05, 0.46), right=(0.53, 0.95), first_line=0.125, spacing=0.034, above=0.027, below=0.005)


@query("""SELECT p_partkey, k::INTEGER AS number,
  greatest(0, trunc(w * CASE WHEN k <= 25 THEN 0.05::DOUBLE ELSE 0.53::DOUBLE END)::BIGINT - 4) AS "left", greatest(0, trunc(h * (y - 0.027::DOUBLE))::BIGINT - 4) AS top,
  least(w, trunc(w * CASE WHEN k <= 25 THEN 0.46::DOUBLE ELSE 0.95::DOUBLE END)::BIGINT + 4) AS "right", least(h, trunc(h * (y + 0.005::DOUBLE))::BIGINT + 4) AS bottom
FROM (SELECT p_partkey, k, (p_size * 40)::BIGINT AS w, (p_size * 60)::BIGINT AS h, 0.125::DOUBLE + (k - CASE WHEN k <= 25 THEN 1 ELSE 26 END) * 0.034::DOUBLE AS y FROM part, range(1, 51) r(k))""")
def answer_regions(spark, sf_dir):
    boxes = numeric.answer_regions(F.col("p_size") * 40, F.col("p_size") * 60, 50, SHEET, 4)
    return _t(spark, sf_dir, "part").select("p_partkey", F.explode(boxes).alias("b")).select("p_partkey", "b.*")


def _turns(spark, sf_dir) -> DataFrame:
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return _t(spark, sf_dir, "conversations").withColumn("after", nxt).where("after is not null").select("conv_id", "turn", F.col("text").alias("a"), F.col("after").alias("b"))


@query()
def agreement_ratio(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(voting.agreement(F.col("a"), F.col("b")), 9).alias("ratio"))


@query()
def word_diff(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.explode(voting.word_diff(F.col("a"), F.col("b"))).alias("d")).select("conv_id", "turn", "d.*")


@query()
def error_taxonomy(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", voting.error_taxonomy(F.col("hyp"), F.col("ref")).alias("e")).select("doc_id", "e.*")


@query()
def auto_lessons(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", F.explode(voting.lessons_from(F.col("hyp"), F.col("ref"))).alias("lesson"))


@query()
def consensus_vote(spark, sf_dir):
    p, none = _pairs(spark, sf_dir), F.lit(None).cast("double")
    each = [F.struct(F.lit(name).alias("provider"), t.alias("text"), none.alias("confidence"), F.lit(w).alias("weight")) for name, t, w in (("claude", F.col("ref"), 1.0), ("gemini", F.translate("ref", "a", "o"), 1.2), ("openai", F.col("hyp"), 0.8))]
    return voting.consensus(p.select(F.col("doc_id").alias("sample_id"), F.inline(F.array(*each)))).drop("disagreements")


@query(r"SELECT 'a' || lpad((doc_id % 90)::VARCHAR, 2, '0') || '-001u-00-' || doc_id AS line_id, 'a' || lpad((doc_id % 90)::VARCHAR, 2, '0') AS writer, 'a' || lpad((doc_id % 90)::VARCHAR, 2, '0') || '-001u' AS form, 'MOVE IT ' || doc_id AS text FROM documents WHERE doc_id % 5 <> 0")
def parse_iam_lines(spark, sf_dir):
    form = F.concat(F.lit("a"), F.lpad((F.col("doc_id") % 90).cast("string"), 2, "0"), F.lit("-001u-00-"), F.col("doc_id"))
    line = F.concat(form, F.when(F.col("doc_id") % 5 == 0, " err").otherwise(" ok"), F.lit(" 154 1 408 768 27 51 MOVE|IT|"), F.col("doc_id"))
    return store.parse_iam_lines(_t(spark, sf_dir, "documents").select(line.alias("value")))
