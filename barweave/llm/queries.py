"""The registered queries of this subpackage: thin digests over the operators' own outputs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import host_rules, line_dedup, merge_replay, neighbours, packing, quality_fm, repair_store, repeats, simhash, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _word_ids() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(_documents(spark, sf_dir)).drop("host_rate")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find_repeats(_documents(spark, sf_dir).select("doc_id", "text"), span=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir), shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is left of each text."""
    return line_dedup.dedup_lines(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    machine = quality_fm.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    return quality_fm.score(docs, machine, 0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_repair_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_store.read_store(repair_store.write_store(_documents(spark, sf_dir), _word_ids(), end=2))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), _word_ids(), end=1, length=2048, keep_ids=False).drop("ids")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_replay.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_host_rules, op2_token_counts, op3_repeats, op4_simhash, op5_line_dedup, op6_quality, op7_repair_store, op8_packing, op9_merge_replay, op10_neighbours, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_host_rules": host_rules.ORACLE}
