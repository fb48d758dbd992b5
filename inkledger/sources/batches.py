"""Results of batch requests from their two JSONL files.

An output line holds a response (status, body); an error line an error. A request with an output takes it, whatever the error
file says; of several outputs the last line stands, of several errors the first. Lines that are not JSON objects are kept
apart, so that nothing is lost in silence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESPONSE = "custom_id string, response struct<status_code:int, body:struct<choices:array<struct<message:struct<content:string>>>, usage:struct<prompt_tokens:long, completion_tokens:long>, error:struct<message:string>>>, error struct<message:string>"


def _parsed(lines: DataFrame) -> DataFrame:
    """(at, value, r) of lines (at, value); r is null for a damaged line."""
    rows = lines.select("at", F.trim("value").alias("value")).where("value <> ''")
    whole = F.try_parse_json("value").isNotNull() & F.startswith("value", F.lit("{"))
    return rows.select("at", "value", F.when(whole, F.from_json("value", RESPONSE)).alias("r"))


def retrieve(outputs: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(custom_id, text, input_tokens, output_tokens, error of each request; the damaged lines: file, at, value).

    Both inputs have ``at`` (a line's place in its file) and ``value``.
    """
    out, err = _parsed(outputs), _parsed(errors)
    damaged = out.where("r is null").select(F.lit("output").alias("file"), "at", "value").unionAll(err.where("r is null").select(F.lit("error"), "at", "value"))
    body = F.col("r.response.body")
    fine = F.coalesce(F.col("r.response.status_code") == 200, F.lit(False))
    said = F.coalesce(F.get(body["choices"], F.lit(0))["message"]["content"], F.lit(""))
    tokens = lambda k: F.when(fine, F.coalesce(body["usage"][k], F.lit(0))).otherwise(F.lit(0)).cast("long")
    got = out.where("r is not null").select(
        F.coalesce("r.custom_id", F.lit("")).alias("custom_id"), F.lit(0).alias("file"), (-F.col("at")).alias("turn"), F.when(fine, said).otherwise("").alias("text"),
        tokens("prompt_tokens").alias("input_tokens"), tokens("completion_tokens").alias("output_tokens"), F.when(~fine, F.coalesce(body["error"]["message"], F.lit("Unknown error"))).alias("error"),
    )
    none = F.lit(0).cast("long")
    failed = err.where("r is not null").select(
        F.coalesce("r.custom_id", F.lit("")).alias("custom_id"), F.lit(1).alias("file"), F.col("at").alias("turn"), F.lit("").alias("text"),
        none.alias("input_tokens"), none.alias("output_tokens"), F.coalesce("r.error.message", F.lit("Batch error")).alias("error"),
    )
    n = F.row_number().over(Window.partitionBy("custom_id").orderBy("file", "turn"))
    first = got.unionByName(failed).withColumn("n_", n).where("n_ = 1")
    return first.select("custom_id", "text", "input_tokens", "output_tokens", "error"), damaged


def requests(rows: DataFrame, key: str, prompt: str, model: str, most: int = 4096) -> DataFrame:
    """One JSON line (``value``) for each row's request."""
    message = F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.lit(most).alias("max_tokens"), F.array(message).alias("messages"))
    line = F.struct(F.col(key).cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))
    return rows.select(F.to_json(line).alias("value"))
