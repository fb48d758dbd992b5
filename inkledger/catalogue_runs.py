"""Queries on benchmark runs, the evaluation store, strategies and synthetic data, each beside its DuckDB SQL.

``events`` stand in for outputs with their metrics, ``conversations`` for readings and corrections, ``documents`` for
files and submissions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkledger.catalogue import RESULTS, _results, _spread, _t, query
from inkledger.functions import misreading, numeric, pixels, prompts, text
from inkledger.operators import correction, similarity, strategies
from inkledger.plans import reports
from inkledger.sources import store

RUNS = """(SELECT event_id AS id, event_id % 4 AS run_id, user_id AS sample_id,
  CASE event_type WHEN 'view' THEN 'claude' WHEN 'click' THEN 'gemini' WHEN 'purchase' THEN 'openai' WHEN 'signup' THEN 'claude+gemini' ELSE 'local' END AS provider,
  CASE event_id % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'vote' ELSE 'cascade' END AS strategy,
  CASE WHEN event_type <> 'error' THEN value / 500 END AS cer, CASE WHEN event_type <> 'error' THEN value / 400 END AS wer,
  json_extract_string(props, '$.k')::BIGINT AS input_tokens, event_id % 50 AS output_tokens, (event_id % 7) / 100.0::DOUBLE AS question_marker_rate,
  CASE WHEN event_type = 'error' AND event_id % 5 < 2 THEN 'timeout' END AS error FROM events)"""


def _runs(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    provider = F.when(kind == "view", "claude").when(kind == "click", "gemini").when(kind == "purchase", "openai").when(kind == "signup", "claude+gemini").otherwise("local")
    strategy = F.when(F.col("event_id") % 3 == 0, "single").when(F.col("event_id") % 3 == 1, "vote").otherwise("cascade")
    fine = kind != "error"
    return _t(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (F.col("event_id") % 4).alias("run_id"), F.col("user_id").alias("sample_id"), provider.alias("provider"), strategy.alias("strategy"),
        F.when(fine, F.col("value") / 500).alias("cer"), F.when(fine, F.col("value") / 400).alias("wer"), F.get_json_object("props", "$.k").cast("long").alias("input_tokens"),
        (F.col("event_id") % 50).alias("output_tokens"), ((F.col("event_id") % 7) / 100).alias("question_marker_rate"), F.when(~fine & (F.col("event_id") % 5 < 2), "timeout").alias("error"),
    )


SUMMARY = f"""(SELECT *, (i * ri + o * ro) / 1e6 AS cost FROM (SELECT provider, strategy,
  coalesce(avg(cer), -1) AS mean_cer, coalesce(median(cer), -1) AS median_cer, coalesce(stddev_samp(cer), 0) AS stdev_cer, coalesce(avg(wer), -1) AS mean_wer, coalesce(median(wer), -1) AS median_wer, coalesce(stddev_samp(wer), 0) AS stdev_wer,
  avg(question_marker_rate) AS mean_marker_rate, count(*) AS samples, count(*) FILTER (error <> '') AS failures, sum(input_tokens)::BIGINT AS i, sum(output_tokens)::BIGINT AS o, (sum(input_tokens) + sum(output_tokens))::BIGINT AS total_tokens,
  CASE provider WHEN 'claude' THEN 3.0 WHEN 'gemini' THEN 0.15 WHEN 'openai' THEN 2.0 WHEN 'claude+gemini' THEN 1.575 ELSE 0 END::DOUBLE AS ri, CASE provider WHEN 'claude' THEN 15.0 WHEN 'gemini' THEN 0.6 WHEN 'openai' THEN 8.0 WHEN 'claude+gemini' THEN 7.8 ELSE 0 END::DOUBLE AS ro
  FROM {RUNS} WHERE run_id = 3 GROUP BY ALL))"""
RATES = ("mean_cer", "median_cer", "stdev_cer", "mean_wer", "median_wer", "stdev_wer", "mean_marker_rate", "cost")


def _summary(spark, sf_dir) -> DataFrame:
    return reports.summary(_runs(spark, sf_dir).where("run_id = 3"))


@query(f"SELECT provider, strategy, {', '.join(f'round({k}, 6) AS {k}' for k in RATES)}, total_tokens, samples, failures FROM {SUMMARY}")
def run_summary(spark, sf_dir):
    return _summary(spark, sf_dir).select("provider", "strategy", *(F.round(k, 6).alias(k) for k in RATES), "total_tokens", "samples", "failures")


@query(f"""SELECT row_number() OVER (ORDER BY CASE WHEN mean_cer >= 0 THEN mean_cer ELSE 999 END, provider, strategy)::INTEGER AS place,
  concat_ws(' ', rpad(provider, 20, ' '), rpad(strategy, 10, ' '), lpad(CASE WHEN mean_cer >= 0 THEN printf('%.2f%%', mean_cer * 100) ELSE 'N/A' END, 8, ' '), lpad(CASE WHEN stdev_cer > 0 THEN printf('%.2f%%', stdev_cer * 100) ELSE '---' END, 6, ' '), lpad(CASE WHEN mean_wer >= 0 THEN printf('%.2f%%', mean_wer * 100) ELSE 'N/A' END, 8, ' '), lpad(printf('%.2f%%', mean_marker_rate * 100), 11, ' '), lpad(format('{{:,}}', total_tokens), 10, ' '), lpad(printf('$%.4f', cost), 8, ' '), lpad(samples::VARCHAR, 4, ' '), lpad(failures::VARCHAR, 4, ' ')) AS line FROM {SUMMARY}""")
def report_table(spark, sf_dir):
    return reports.report_table(_summary(spark, sf_dir))


def _csv_rate(k: str) -> str:
    return f"CASE WHEN {k} >= 0 THEN printf('%.6f', {k}) ELSE '' END"


@query(f"SELECT provider, strategy, concat_ws(',', provider, strategy, {', '.join(map(_csv_rate, ('mean_cer', 'mean_wer', 'median_cer', 'median_wer')))}, total_tokens, printf('%.6f', cost), samples, failures) AS line FROM {SUMMARY}")
def report_csv(spark, sf_dir):
    return reports.report_csv(_summary(spark, sf_dir))


@query()
def report_json(spark, sf_dir):
    return reports.report_json(_summary(spark, sf_dir))


@query(f"SELECT id, provider, strategy, error, cer, wer FROM (SELECT o.id, o.provider, o.strategy, o.error, m.cer, m.wer FROM {RUNS} o LEFT JOIN (SELECT id, cer, wer FROM {RUNS} WHERE error IS NULL) m USING (id) WHERE o.run_id = 3 AND o.sample_id = (SELECT max(sample_id) FROM {RUNS} WHERE run_id = 3))")
def sample_drill_down(spark, sf_dir):
    r = _runs(spark, sf_dir)
    top = r.where("run_id = 3").agg(F.max("sample_id")).head()[0]
    metrics = r.where("error is null").select(F.col("id").alias("provider_output_id"), "cer", "wer")
    return reports.drill_down(top, 3, r.drop("cer", "wer"), metrics).select("id", "provider", "strategy", "error", "cer", "wer")


RUN_TABLE = f"(SELECT run_id AS id, count(*) AS sample_count, run_id = 1 AS is_baseline FROM {RUNS} GROUP BY run_id)"


def _run_table(spark, sf_dir) -> DataFrame:
    return _runs(spark, sf_dir).groupBy(F.col("run_id").alias("id")).agg(F.count(F.lit(1)).alias("sample_count")).withColumn("is_baseline", F.col("id") == 1)


@query(f"SELECT id, sample_count, is_baseline FROM {RUN_TABLE} ORDER BY id DESC")
def list_runs(spark, sf_dir):
    return store.list_runs(_run_table(spark, sf_dir))


@query(f"SELECT (SELECT max(id) FROM {RUN_TABLE}) AS latest, (SELECT max(id) FROM {RUN_TABLE} WHERE is_baseline) AS pinned")
def latest_and_baseline(spark, sf_dir):
    runs = _run_table(spark, sf_dir)
    return store.latest_run(runs).select(F.col("id").alias("latest")).crossJoin(F.broadcast(store.baseline(runs).select(F.col("id").alias("pinned"))))  # one row


@query("SELECT * FROM documents WHERE doc_id = 17")
def point_lookup(spark, sf_dir):
    return store.lookup(_t(spark, sf_dir, "documents"), "doc_id", 17)


@query(f"SELECT round(coalesce(stddev_pop(cer), 0), 9) AS deviation, round(2 * coalesce(stddev_pop(cer), 0), 9) AS least_difference, count(cer) AS n FROM (SELECT cer FROM {RUNS} ORDER BY md5(id::VARCHAR || '|7'), id LIMIT 200)")
def calibrate(spark, sf_dir):
    out = reports.noise(reports.sampled(_runs(spark, sf_dir), "id", 200, 7), "cer")
    return out.withColumns({k: F.round(k, 9) for k in ("deviation", "least_difference")})


@query(f"SELECT strategy, round(avg(cer), 9) AS mean_cer, round(avg(wer), 9) AS mean_wer, count(*) AS n FROM {RUNS} GROUP BY strategy")
def compare_strategies(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("strategy").agg(F.round(F.avg("cer"), 9).alias("mean_cer"), F.round(F.avg("wer"), 9).alias("mean_wer"), F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS entries, coalesce(sum(hit_count), 0)::BIGINT AS hits FROM (SELECT user_id, count(*) AS hit_count FROM events GROUP BY user_id)")
def cache_stats(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select(F.col("user_id").alias("cache_key"))
    cache = events.distinct().withColumn("hit_count", F.lit(0).cast("long"))
    return store.cache_stats(store.cache_get(cache, events)[1])


@query(f"SELECT sample_id, sum(input_tokens)::BIGINT AS input, sum(output_tokens)::BIGINT AS output FROM (SELECT sample_id, provider, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens FROM {RUNS} GROUP BY ALL) GROUP BY sample_id")
def token_totals(spark, sf_dir):
    each = _runs(spark, sf_dir).groupBy("sample_id", "provider").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    usage = F.map_from_entries(F.collect_list(F.struct("provider", F.struct(F.col("i").alias("input"), F.col("o").alias("output")))))
    return each.groupBy("sample_id").agg(usage.alias("usage")).select("sample_id", store.token_sums(F.col("usage")).alias("t")).select("sample_id", "t.*")


@query(f"SELECT run_id, count(DISTINCT sample_id) AS samples, count(DISTINCT provider) AS providers FROM {RUNS} GROUP BY run_id")
def distinct_counts(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("run_id").agg(F.count_distinct("sample_id").alias("samples"), F.count_distinct("provider").alias("providers"))


@query("SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: exp(-abs(x::DOUBLE)))), 9) AS confidence FROM embeddings")
def token_confidence(spark, sf_dir):
    probabilities = F.transform("embedding", lambda x: -F.abs(x.cast("double")))
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.round(store.token_confidence(probabilities), 9).alias("confidence"))


@query(f"SELECT s.sample_id, round(m, 9) AS mean FROM (SELECT DISTINCT user_id + 0 AS sample_id FROM events UNION SELECT 1000000 + range AS sample_id FROM range(5)) s LEFT JOIN (SELECT sample_id, avg(cer) AS m FROM {RUNS} WHERE cer > 0.9 GROUP BY sample_id) USING (sample_id) ORDER BY m DESC NULLS LAST, sample_id LIMIT 40")
def hardest_filled(spark, sf_dir):
    r = _runs(spark, sf_dir)
    samples = r.select("sample_id").distinct().unionAll(spark.range(1_000_000, 1_000_005).toDF("sample_id"))
    return reports.hardest_filled(samples, r.where("cer > 0.9"), 40).withColumn("mean", F.round("mean", 9))


@query(f"SELECT provider, round((floor(i * 100) * ri + floor(o * 100) * ro) / 1e6, 9) AS cost FROM (SELECT avg(input_tokens) AS i, avg(output_tokens) AS o FROM {RUNS} WHERE run_id = 3), (VALUES ('claude', 3.0::DOUBLE, 15.0::DOUBLE), ('gemini', 0.15::DOUBLE, 0.6::DOUBLE), ('openai', 2.0::DOUBLE, 8.0::DOUBLE)) p(provider, ri, ro)")
def cost_projection(spark, sf_dir):
    return reports.projected_cost(_runs(spark, sf_dir), "run_id", 100, ["claude", "gemini", "openai"]).withColumn("cost", F.round("cost", 9))


@query(r"""
WITH k AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS t FROM documents),
g AS (SELECT doc_id, CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS g FROM k),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
s AS (SELECT a AS doc_id, count(*) AS others, max(round(c / (na + nb - c), 4)) AS most FROM p WHERE c / (na + nb - c) >= 0.85 GROUP BY a),
t AS (SELECT doc_id, 0.5 + quality / 4.0::DOUBLE AS typed FROM labels WHERE toxic = 1)
SELECT doc_id, coalesce(others, 0)::INTEGER AS others, most, typed FROM s FULL JOIN t USING (doc_id)""")
def flag_anomalies(spark, sf_dir):
    typed = _t(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", (0.5 + F.col("quality") / 4).alias("confidence"))
    out = reports.flag_anomalies(_t(spark, sf_dir, "documents"), "doc_id", "text", typed)
    return out.select("doc_id", F.when(F.col("others").isNull(), 0).otherwise(F.size("others")).alias("others"), F.array_max(F.transform("others", lambda x: x["score"])).alias("most"), F.col("typed_confidence").alias("typed"))


@query("SELECT 'h' || conv_id % 40 AS image_hash, count(DISTINCT turn % 3) AS truths, count(*) AS corrections FROM conversations GROUP BY ALL")
def record_correction(spark, sf_dir):
    none = [spark.createDataFrame([], store.SCHEMAS[k]).drop("created_at") for k in ("samples", "ground_truths", "corrections")]
    incoming = _t(spark, sf_dir, "conversations").select(F.concat(F.lit("h"), F.col("conv_id") % 40).alias("image_hash"), F.lit("p").alias("image_path"), F.col("role").alias("writer"), F.col("text").alias("original"), F.concat(F.lit("reading "), F.col("turn") % 3).alias("corrected"), F.lit(1.0).alias("confidence"), F.lit("labgrader").alias("source"))
    samples, truths, corrections = store.record_corrections(*none, incoming)
    n = truths.groupBy("sample_id").agg(F.count(F.lit(1)).alias("truths"))
    m = corrections.groupBy("sample_id").agg(F.count(F.lit(1)).alias("corrections"))
    return samples.select("image_hash", F.col("id").alias("sample_id")).join(n, "sample_id").join(m, "sample_id").drop("sample_id")


@query("""SELECT DISTINCT o.text AS corrupted, t.text AS clean FROM conversations o JOIN conversations t USING (conv_id)
WHERE o.role = 'user' AND t.role = 'assistant' AND length(o.text) >= 10 AND length(t.text) >= 10 AND o.text <> t.text""")
def training_pairs(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    outputs = c.where("role = 'user'").select(F.col("conv_id").alias("sample_id"), F.col("text").alias("output_text"), F.lit(None).cast("string").alias("error"), F.lit("x").alias("provider"), F.lit("single").alias("strategy"))
    return store.training_pairs(outputs, c.where("role = 'assistant'").select(F.col("conv_id").alias("sample_id"), "text"), ["x"], ["single"])


@query()
def corrupted_pairs(spark, sf_dir):
    return misreading.build_pairs(_t(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def corrector_evaluation(spark, sf_dir):
    return correction.evaluate(misreading.build_pairs(_t(spark, sf_dir, "conversations").withColumn("key", F.concat_ws("-", "conv_id", "turn")), "key", "text", 9999))


@query("SELECT doc_id, CASE WHEN s < 0.05 THEN 'val' WHEN s < 0.1 THEN 'test' ELSE 'train' END AS part FROM (SELECT doc_id, ('0x' || substring(md5(doc_id::VARCHAR || '|42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS s FROM documents)")
def split_pairs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", store.split_of(F.col("doc_id")).alias("part"))


IMAGES = "(SELECT p_partkey, list_transform(range(64), lambda i: (255 - (i * p_size * 7 + p_partkey) % (1 + p_partkey % 200))::INTEGER) AS pixels FROM part)"


def _images(spark, sf_dir) -> DataFrame:
    shade = lambda i: (255 - (i * F.col("p_size") * 7 + F.col("p_partkey")) % (1 + F.col("p_partkey") % 200)).cast("int")
    return _t(spark, sf_dir, "part").select("p_partkey", F.transform(F.sequence(F.lit(0), F.lit(63)), shade).alias("pixels"))


@query(f"SELECT p_partkey, len(list_filter(pixels, lambda x: x >= 245)) / 64 >= 0.97 AS blank FROM {IMAGES}")
def blank_pages(spark, sf_dir):
    return _images(spark, sf_dir).select("p_partkey", pixels.is_blank(F.col("pixels")).alias("blank"))


@query(f"SELECT p_partkey, round_even(list_avg(pixels), 1) AS mean, round((list_sort(pixels)[61] - list_sort(pixels)[4]) / 255, 3) AS contrast, len(list_filter(pixels, lambda x: x >= 245)) / 64 AS white FROM {IMAGES}")
def image_quality(spark, sf_dir):
    q = pixels.quality(F.col("pixels"), F.lit(8))
    return _images(spark, sf_dir).select("p_partkey", q.alias("q")).select("p_partkey", "q.mean", "q.contrast", "q.white")


@query(f"""WITH p AS (SELECT p_partkey, unnest(pixels) < 128 AS dark, generate_subscripts(pixels, 1) - 1 AS i FROM {IMAGES}),
g AS (SELECT *, i - row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS island FROM p WHERE dark)
SELECT p_partkey, min(i)::INTEGER AS start, count(*)::INTEGER AS length FROM g GROUP BY p_partkey, island""")
def ink_runs(spark, sf_dir):
    return _images(spark, sf_dir).select("p_partkey", F.inline(pixels.ink_runs(F.col("pixels"))))


FAULTS = "(SELECT *, CASE WHEN len(issues) = 0 THEN 'good' WHEN len(issues) = 1 AND b >= 50 AND c >= 0.25 THEN 'fair' ELSE 'poor' END AS q FROM (SELECT *, list_filter([CASE WHEN b < 100 THEN 'blurry' END, CASE WHEN c < 0.4 THEN 'low_contrast' END, CASE WHEN m < 100 THEN 'too_dark' END, CASE WHEN m > 220 THEN 'too_bright' END], lambda x: x IS NOT NULL) AS issues FROM (SELECT l_orderkey, l_linenumber, l_quantity * 6 AS b, l_discount * 10 AS c, l_quantity * 5 AS m FROM lineitem)))"


@query(f"""SELECT l_orderkey, l_linenumber, q, CASE WHEN m > 180 AND c < 0.5 THEN 2.0 WHEN q = 'good' THEN 1.0 WHEN list_contains(issues, 'blurry') AND NOT list_contains(issues, 'low_contrast') THEN 1.0
 WHEN list_contains(issues, 'low_contrast') AND NOT list_contains(issues, 'blurry') THEN 1.5 WHEN list_contains(issues, 'too_dark') THEN 1.3 WHEN list_contains(issues, 'too_bright') THEN 1.5 WHEN q = 'fair' THEN 1.5 ELSE 2.0 END::DOUBLE AS contrast_factor FROM {FAULTS}""")
def enhancement_rules(spark, sf_dir):
    b, c, m, flat = F.col("l_quantity") * 6, F.col("l_discount") * 10, F.col("l_quantity") * 5, F.lit(0.0)
    q = numeric.quality_tier(b, c, m, flat)
    plan = numeric.enhancement(q, numeric.faint(m, c), numeric.quality_issues(b, c, m, flat))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"), plan["contrast_factor"].alias("contrast_factor"))


@query("""WITH RECURSIVE o AS (SELECT l_orderkey, (l_quantity * 100)::BIGINT AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS i FROM lineitem),
b AS (SELECT l_orderkey, i, s AS held, 0 AS batch FROM o WHERE i = 1 UNION ALL
 SELECT o.l_orderkey, o.i, CASE WHEN b.held > 0 AND b.held + o.s > 6000 THEN o.s ELSE b.held + o.s END, b.batch + (b.held > 0 AND b.held + o.s > 6000)::INT FROM b JOIN o ON o.l_orderkey = b.l_orderkey AND o.i = b.i + 1)
SELECT l_orderkey, max(batch)::INTEGER + 1 AS batches, count(*) AS pages FROM b GROUP BY l_orderkey""")
def page_batches(spark, sf_dir):
    page = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    pages = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(page)).alias("p"))
    sizes = F.transform("p", lambda x: F.round(x["l_quantity"] * 100).cast("long"))
    return pages.select("l_orderkey", (F.array_max(numeric.byte_batches(sizes, 6000)) + 1).alias("batches"), F.size("p").cast("long").alias("pages"))


@query(r"SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(range(len(l)), lambda i: CASE WHEN contains(l[i + 1], '[?]') OR contains(l[i + 1], '???') OR regexp_matches(l[i + 1], '(?i)\[illegible[^\]]*\]') THEN least(floor(i / (len(l) / least(3, len(l)))), least(3, len(l)) - 1)::INTEGER END), lambda x: x IS NOT NULL)))::VARCHAR AS strips FROM (SELECT doc_id, string_split(text || ' [?]' || chr(10) || 'end', chr(10)) AS l FROM documents)")
def uncertain_strips(spark, sf_dir):
    t = F.concat("text", F.lit(" [?]\nend"))
    return _t(spark, sf_dir, "documents").select("doc_id", numeric.uncertain_strips(t).cast("string").alias("strips"))


@query("SELECT count(*) AS n FROM conversations WHERE role = 'user'")
def lesson_patterns(spark, sf_dir):
    said = F.when(F.col("role") == "user", F.concat(F.lit("Model read 'a' but correct reading is 'b': "), "text")).otherwise(F.col("text"))
    return store.lesson_patterns(_t(spark, sf_dir, "conversations").select(said.alias("text")))


@query(r"WITH w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), 1) AS i FROM conversations), b AS (SELECT w || ' ' || lead(w) OVER (PARTITION BY conv_id, turn ORDER BY i) AS pair FROM w) SELECT pair, count(*) AS n FROM b WHERE pair IS NOT NULL GROUP BY pair")
def adjacent_pairs(spark, sf_dir):
    words = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.tokens(F.col("text"))).alias("i", "w"))
    after = F.lead("w").over(Window.partitionBy("conv_id", "turn").orderBy("i"))
    return words.select(F.concat("w", F.lit(" "), after).alias("pair")).where("pair is not null").groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT d.doc_id::VARCHAR AS path, md5(text) AS image_hash, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS answer, doc_id FROM documents d),
s AS (SELECT DISTINCT image_hash FROM f JOIN labels USING (doc_id) WHERE quality = 1), t AS (SELECT DISTINCT image_hash FROM f JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 1)
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN image_hash IN (FROM t) THEN 'skipped_existing_gt' WHEN row_number() OVER (PARTITION BY image_hash ORDER BY path) > 1 THEN 'skipped_dup' WHEN image_hash IN (FROM s) AND trim(answer) = '' THEN 'skipped_user' WHEN trim(answer) = '' THEN 'newly_added' ELSE 'annotated' END AS outcome FROM f) GROUP BY outcome""")
def ingest_outcomes(spark, sf_dir):
    d, marks = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    files = d.select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("image_hash"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source")).alias("answer"))
    hashed = d.join(marks.where("quality = 1"), "doc_id").groupBy(F.md5("text").alias("image_hash")).agg(F.min("doc_id").alias("id"), F.max("toxic").alias("toxic"))
    out = store.ingest_outcomes(files, hashed.select("id", "image_hash"), hashed.where("toxic = 1").select(F.col("id").alias("sample_id")))
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s.event_type AS content, p.provider, CASE s.event_type || '/' || p.provider WHEN 'printed/gemini' THEN 1.5 WHEN 'printed/openai' THEN 0.8 WHEN 'layout/claude' THEN 1.5 WHEN 'layout/openai' THEN 0.8 ELSE CASE WHEN p.provider = 'gemini' AND s.event_type NOT IN ('printed', 'layout') THEN 1.2 WHEN p.provider = 'openai' THEN 0.8 ELSE 1.0 END END::DOUBLE AS weight FROM (SELECT DISTINCT CASE event_type WHEN 'view' THEN 'printed' WHEN 'click' THEN 'layout' ELSE event_type END AS event_type FROM events) s, (VALUES ('gemini'), ('claude'), ('openai'), ('other')) p(provider)")
def vote_weights(spark, sf_dir):
    kinds = _t(spark, sf_dir, "events").select(F.when(F.col("event_type") == "view", "printed").when(F.col("event_type") == "click", "layout").otherwise(F.col("event_type")).alias("content")).distinct()
    rows = kinds.select("content", F.explode(F.array(*map(F.lit, ("gemini", "claude", "openai", "other")))).alias("provider"))
    return rows.select("content", "provider", numeric.vote_weight(F.col("content"), F.col("provider")).alias("weight"))


@query("SELECT source AS writer, string_agg(doc_id::VARCHAR, ',' ORDER BY quality DESC, doc_id) AS blocks FROM (SELECT source, doc_id, coalesce(quality, -1) AS quality, row_number() OVER (PARTITION BY source ORDER BY coalesce(quality, -1) DESC, doc_id) AS n FROM documents LEFT JOIN labels USING (doc_id)) WHERE n <= 3 GROUP BY source HAVING count(*) >= 2")
def exemplar_blocks(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    order = Window.partitionBy("source").orderBy(F.coalesce("quality", F.lit(-1)).desc(), "doc_id")
    best = rows.withColumn("n", F.row_number().over(order)).where("n <= 3").groupBy(F.col("source").alias("writer")).agg(F.array_sort(F.collect_list(F.struct("n", "doc_id"))).alias("b"))
    return best.where(F.size("b") >= 2).select("writer", F.array_join(F.transform("b", lambda x: x["doc_id"].cast("string")), ",").alias("blocks"))


# ---- strategies over the turns of a conversation, one provider for each role ---------------------------------------


def _readings(spark, sf_dir) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").where("role in ('user', 'assistant', 'system')")
    provider = F.when(F.col("role") == "user", "gemini").when(F.col("role") == "assistant", "openai").otherwise("claude")
    last = store.latest(c.withColumn("provider", provider), ["conv_id", "provider"], F.desc("turn"))
    return last.select(F.col("conv_id").alias("sample_id"), "provider", "text", F.lit(None).cast("double").alias("confidence"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("error"))


@query()
def cascade_read(spark, sf_dir):
    return strategies.cascade(_readings(spark, sf_dir))


@query()
def debate_read(spark, sf_dir):
    r = _readings(spark, sf_dir)
    return strategies.debate(r, r.groupBy("sample_id").agg(F.max("text").alias("text")))


@query()
def self_correct_read(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    return strategies.self_correct(c.select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("round"), "text"), 3)


@query()
def smart_route_read(spark, sf_dir):
    r = _readings(spark, sf_dir)
    q = r.select("sample_id").distinct().select("sample_id", F.when(F.col("sample_id") % 3 == 0, "good").when(F.col("sample_id") % 3 == 1, "fair").otherwise("poor").alias("quality"), F.lit(250.0).alias("blur"), F.lit(0.7).alias("contrast"), F.lit(False).alias("faint"), (F.col("sample_id") % 3).cast("int").alias("issues"))
    passes = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("round"), "text")
    return strategies.smart_route(r, q, passes, ["gemini"])


@query()
def benchmark_run(spark, sf_dir):
    r = _readings(spark, sf_dir)
    outputs, metrics = strategies.run(r, r.where("provider = 'gemini'").select("sample_id", "text"), ["vote", "best_of", "cascade"], ["gemini", "openai"])
    return outputs.drop("output_text").join(metrics, ["run_id", "sample_id", "provider", "strategy"], "left")


# ---- prompts ----------------------------------------------------------------------------------------------------------

_SHORT, _READING = prompts.compact_table([("0/O", "digits stand among digits"), ("rn/m", "read the whole word")]), "=== READING PROTOCOL ===\n1. Map layout first"


def _sql_section(column: str, header: str) -> tuple[str, str, str]:
    at = f"instr({column}, '{header}')"
    rest = f"substr({column}, {at} + {len(header)})"
    return at, rest, f"instr({rest}, chr(10) || '===')"


def _sql_replaced(column: str, header: str, instead: str) -> str:
    at, rest, end = _sql_section(column, header)
    instead = instead.replace("'", "''")
    return f"CASE WHEN {at} > 0 THEN substr({column}, 1, {at} - 1) || '{instead}' || CASE WHEN {end} > 0 THEN substr({rest}, {end}) ELSE '' END ELSE {column} END"


def _sql_last(column: str, header: str) -> str:
    at, rest, end = _sql_section(column, header)
    return f"CASE WHEN {at} > 0 AND {end} > 0 THEN substr({column}, 1, {at} - 1) || substr({rest}, {end}) || chr(10) || chr(10) || '{header}' || substr({rest}, 1, {end} - 1) ELSE {column} END"


@query(f"""WITH a AS (SELECT conv_id, turn, text, CASE conv_id % 3 WHEN 0 THEN 'gemini' WHEN 1 THEN 'openai' ELSE 'claude' END AS provider,
  text || chr(10) || '{prompts.FIDELITY_HEADER} ===' || chr(10) || role || chr(10) || '{prompts.READING_HEADER}' || chr(10) || text || chr(10) || CASE WHEN turn % 2 = 0 THEN '{prompts.TABLE_HEADER}' || chr(10) || role ELSE '' END AS system FROM conversations),
b AS (SELECT *, {_sql_replaced("system", prompts.TABLE_HEADER, _SHORT)} AS short FROM a), c AS (SELECT *, {_sql_replaced("short", prompts.READING_HEADER, _READING)} AS compact FROM b)
SELECT conv_id, turn, provider, CASE provider WHEN 'gemini' THEN short WHEN 'openai' THEN {_sql_last("compact", prompts.FIDELITY_HEADER)} ELSE system END AS system, CASE WHEN provider = 'openai' THEN '{prompts.LITERAL_TASK}' ELSE '' END || text AS prompt FROM c""")
def provider_prompts(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    provider = F.when(F.col("conv_id") % 3 == 0, "gemini").when(F.col("conv_id") % 3 == 1, "openai").otherwise("claude")
    table = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(prompts.TABLE_HEADER + "\n"), "role")).otherwise(F.lit(""))
    system = F.concat("text", F.lit(f"\n{prompts.FIDELITY_HEADER} ===\n"), "role", F.lit(f"\n{prompts.READING_HEADER}\n"), "text", F.lit("\n"), table)
    rows = c.select("conv_id", "turn", provider.alias("provider"), system.alias("system"), "text")
    own = F.col("provider")
    return rows.select("conv_id", "turn", "provider", prompts.adapt_system(F.col("system"), own, _SHORT, _READING).alias("system"), prompts.adapt_user(F.col("text"), own).alias("prompt"))


@query("""WITH s AS (SELECT doc_id, source, '/in.d/' || source || CASE doc_id % 6 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.tar.webp' WHEN 3 THEN '' WHEN 4 THEN '.gif' ELSE '.pdf' END AS path,
  CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' 7 ' WHEN 2 THEN '-1' WHEN 3 THEN lang ELSE '0' END AS setting, CASE doc_id % 4 WHEN 0 THEN 'claude' WHEN 1 THEN 'gemini' WHEN 2 THEN 'openai' END AS provider FROM documents)
SELECT doc_id, CASE WHEN try_cast(trim(setting) AS BIGINT) >= 0 THEN try_cast(trim(setting) AS BIGINT) ELSE 3 END AS k, coalesce(provider IN ('claude', 'gemini'), false) AS shown,
  coalesce(map {'jpg': 'image/jpeg', 'jpeg': 'image/jpeg', 'png': 'image/png', 'gif': 'image/gif', 'webp': 'image/webp'}[lower(regexp_extract(path, '[^/.][^/]*\\.([^./]*)$', 1))], 'image/jpeg') AS media FROM s""")
def example_settings(spark, sf_dir):
    n = F.col("doc_id")
    ends = F.when(n % 6 == 0, ".JPG").when(n % 6 == 1, ".png").when(n % 6 == 2, ".tar.webp").when(n % 6 == 3, "").when(n % 6 == 4, ".gif").otherwise(".pdf")
    setting = F.when(n % 5 == 1, " 7 ").when(n % 5 == 2, "-1").when(n % 5 == 3, F.col("lang")).when(n % 5 == 4, "0")
    provider = F.when(n % 4 == 0, "claude").when(n % 4 == 1, "gemini").when(n % 4 == 2, "openai")
    path = F.concat(F.lit("/in.d/"), "source", ends)
    return _t(spark, sf_dir, "documents").select("doc_id", prompts.example_count(setting).alias("k"), prompts.shows_examples(provider).alias("shown"), prompts.media_type(path).alias("media"))


@query(f"SELECT run_id, event_id, place, found, confidence, error_rate FROM (SELECT run_id, event_id, (event_id % 100) / 100.0::DOUBLE AS confidence, round(cer, 9) AS error_rate, count(*) OVER (PARTITION BY run_id) AS found, row_number() OVER (PARTITION BY run_id ORDER BY event_id)::INTEGER AS place FROM {RESULTS} WHERE (event_id % 100) / 100.0 > 0.7 AND cer > 0.1) WHERE place <= 5")
def miscalibrated_outputs(spark, sf_dir):
    sure = (F.col("event_id") % 100) / F.lit(100.0)
    r = _results(spark, sf_dir).select("run_id", "event_id", sure.alias("confidence"), F.col("cer").alias("error_rate"))
    out = reports.miscalibrated(r, ["run_id"], ["event_id"])
    return out.select("run_id", "event_id", "place", "found", "confidence", F.round("error_rate", 9).alias("error_rate"))


@query(f"""WITH w AS (SELECT vec_id, 'writer ' || label AS writer, embedding FROM embeddings WHERE vec_id % 3 <> 0), c AS (SELECT writer, list(x ORDER BY place) AS m FROM (SELECT writer, place, avg(x::DOUBLE) AS x FROM (SELECT writer, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM w) GROUP BY ALL) GROUP BY writer),
s AS (SELECT vec_id, writer, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), m) AS s FROM embeddings, c)
SELECT vec_id, CASE WHEN max(s) >= 0.85 THEN arg_max(writer, s) END AS writer, round(max(s), 5) AS score FROM s GROUP BY vec_id""")
def identify_enrolled_writer(spark, sf_dir):
    """Writers named by strings, enrolled from two thirds of the vectors, and the production threshold."""
    e = _t(spark, sf_dir, "embeddings").withColumn("writer", F.concat(F.lit("writer "), "label"))
    profiles = similarity.centroids(e.where(F.col("vec_id") % 3 != 0), "writer", "embedding")
    out = similarity.nearest_profile(e, "vec_id", "embedding", profiles, "writer")
    return out.select("vec_id", "writer", F.round("score", 5).alias("score"))


@query(r"""
WITH k AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS t FROM documents),
g AS (SELECT doc_id, CASE WHEN len(t) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] END AS g FROM k)
SELECT doc_id, min(doc_id) OVER (PARTITION BY g) AS class FROM g WHERE g IS NOT NULL""")
def similar_text_classes(spark, sf_dir):
    return similarity.text_classes(_spread(_t(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")
