"""The registered queries of this package, with production parameters, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab import ship
from barlab.llm import ann, centroids, embed_dedup, hard_negatives, langid, licenses, line_dedup, mixing, packing, secret_scan, simhash, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link(_table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), lambda vec_id: F.pmod(vec_id, F.lit(20)) == 0)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = lambda vec_id, own: F.when(vec_id % 7 == 0, (own + 1) % 10).otherwise(own)
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, label)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_secret_scan,
        op3_best_fit_packing,
        op4_language_id,
        op5_license_scan,
        op6_token_files,
        op7_embedding_near_dedup,
        op8_toxicity,
        op9_nearest_neighbours,
        op10_source_mixing,
        op11_centroid_clustering,
        op12_line_dedup,
        op13_hard_negatives,
        pipeline,
    )
}
ORACLE_SQL = {
    "op2_secret_scan": secret_scan.ORACLE_SQL,
    "op5_license_scan": licenses.ORACLE_SQL,
    "op10_source_mixing": mixing.ORACLE_SQL,
    "op11_centroid_clustering": centroids.ORACLE_SQL,
    "op12_line_dedup": line_dedup.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
