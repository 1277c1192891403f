"""Registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, centroids, chat, langid, licenses, lines, media, mixing, packing, secretscan, simhash, topk, windows

#: The vocabularies of the packing and alignment queries.
VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50).drop("query_row")


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path(VOCABULARY), capacity=2048)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, radius=2)
    return found.select("doc_id", simhash.hex_print(F.col("f0")).alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(_table(spark, sf_dir, "documents"), path_a=public_tokenizers.path(BYTE_VOCABULARY), path_b=public_tokenizers.path(PIECE_VOCABULARY))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, dimensions=64, scale=1024)


def op13_least_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return windows.pack(_table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path(BYTE_VOCABULARY), window=1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_top_k,
        op2_perspective_rotation,
        op3_best_fit_packing,
        op4_language_id,
        op5_secret_scan,
        op6_source_mixing,
        op7_simhash_near_dedup,
        op8_line_dedup,
        op9_media_columns,
        op10_license_scan,
        op11_tokenizer_alignment,
        op12_centroid_clustering,
        op13_least_squares_packing,
    )
}

#: DuckDB SQL over the same tables, where SQL can say what the operator does.
ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": topk.TOP_K_SQL,
    "op2_perspective_rotation": chat.ROTATE_SQL,
    "op6_source_mixing": mixing.mix_sql(),
    "op12_centroid_clustering": centroids.cluster_sql(),
}
