"""One registered query for each training-data operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.llm import common as c
from inkledger.llm import context_mixing, filter_audit, fingerprint, jaccard_join, merkle, mixing, pieces, rans, sharding, suffix_dedup, suffix_tree, topk, toxicity


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = c.new_path(spark, "tokens")
    rans.write_tokens(c.read(spark, sf_dir, "documents"), path, _vocabulary("byte_bpe_50k.json"))
    return rans.read_tokens(spark, path)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(c.read(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(c.read(spark, sf_dir, "documents"), 4, 85, 100).drop("ver")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(c.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, c.read(spark, sf_dir, "labels")))


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.dedup(c.read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(c.read(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(c.read(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(c.read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(c.read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(c.read(spark, sf_dir, "documents"), c.read(spark, sf_dir, "labels")).where("not whole").drop("whole")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(c.read(spark, sf_dir, "documents")).drop("source")


def op13_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(c.read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_rans, op2_suffix_dedup, op3_jaccard_join, op4_top_k, op5_toxicity, op6_suffix_tree, op7_mixing, op8_sentencepiece, op9_fingerprint, op10_sharding, op11_filter_audit, op12_merkle, op13_context_mixing)}

ORACLE = {
    "op4_top_k": """
        WITH v AS (
          SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.own, q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score
          FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.own <> v.own)
        SELECT query_id, rank, vec_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5""",
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_merkle": merkle.ORACLE,
}
