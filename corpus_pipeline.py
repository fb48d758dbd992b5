"""A corpus pipeline of five stages over ``documents``; each stage works on all rows its predecessor kept.

toxicity drops documents predicted toxic; jaccard keeps one document of each group of near-duplicates (five-word
shingles, similarity 0.8 or more); suffix_dedup cuts repeated stretches of 100 bytes from the texts; mixing repeats
or leaves documents so that sources meet their target weights; sentencepiece codes the mixed texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.llm import common, jaccard_join, mixing, pieces, suffix_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.fit(docs, common.read(spark, sf_dir, "labels")))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, 5, 80, 100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup_texts(docs)
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))) if "n_chars" in cut.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", keep_one_of_near),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Hashes and model scores decide rows here that SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.write_table(docs, f"pipeline-{name}")
    return docs
