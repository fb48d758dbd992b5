"""Prompt sections and example settings on pinned cases and against DuckDB."""

import glob
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkledger import catalogue, catalogue_runs  # noqa: F401  (registers its queries)
from inkledger.functions import prompts

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize("prompt,want", [("a\n=== T ===\nold\n=== N ===\nz", "a\nNEW\n=== N ===\nz"), ("a\n=== T ===\nold", "a\nNEW"), ("none", "none"), ("", ""), (None, None)])
def test_replace_section(spark, prompt, want):
    assert one(spark, prompts.replace_section(F.lit(prompt).cast("string"), "=== T ===", "NEW")) == want


@pytest.mark.parametrize("prompt,want", [("a\n=== T\nold\n=== N\nz", "a\n\n=== N\nz\n\n=== T\nold"), ("a\n=== T\nold", "a\n=== T\nold"), ("none", "none")])
def test_section_last(spark, prompt, want):
    assert one(spark, prompts.section_last(F.lit(prompt), "=== T")) == want


@pytest.mark.parametrize("setting,k", [(None, 3), ("5", 5), (" 2 ", 2), ("0", 0), ("-1", 3), ("many", 3), ("1.5", 3), ("", 3)])
def test_example_count(spark, setting, k):
    assert one(spark, prompts.example_count(F.lit(setting).cast("string"))) == k


@pytest.mark.parametrize("path,kind", [("/a/b.JPEG", "image/jpeg"), ("b.tar.webp", "image/webp"), ("/a.png/b", "image/jpeg"), (".png", "image/jpeg"), ("x.bmp", "image/jpeg"), ("c.gif", "image/gif")])
def test_media_type(spark, path, kind):
    assert one(spark, prompts.media_type(F.lit(path))) == kind


def test_provider_forms(spark):
    system, table = "=== CHARACTER DISAMBIGUATION ===\nlong", prompts.compact_table([("0/O", "by context")])
    got = [one(spark, prompts.adapt_system(F.lit(system), F.lit(p), table, "R")) for p in ("gemini", "openai", "claude")]
    assert got == [table, table, system]
    assert one(spark, prompts.adapt_user(F.lit("p"), F.lit("openai"))) == prompts.LITERAL_TASK + "p"
    assert [one(spark, prompts.shows_examples(F.lit(p).cast("string"))) for p in ("gemini", "openai", None)] == [True, False, False]


@pytest.mark.parametrize("name", ["provider_prompts", "example_settings"])
def test_same_as_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    got, want = catalogue.QUERIES[name](spark, SF), db.sql(catalogue.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(want.columns).collect())) == Counter(want.fetchall())
