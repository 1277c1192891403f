"""From raw documents to packed training sequences.

Five stages, each one operator of ``barloom.llm``: language identification,
line dedup, SimHash near-dedup, mixing to target weights, best-fit packing. A
stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of ``documents``. Between stages the
documents are written as Parquet, so a lost executor costs one stage's tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import langid, lines, mixing, packing, simhash
from barloom.llm._common import stored, workspace

#: Five-word shingles, their Jaccard similarity, and the bit planes that find candidates.
SHINGLE_WORDS, SIMILARITY, PLANES = 5, 0.8, 256
VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose n-grams no learned language
    knows well enough; gives a language to those that have none. A table without
    labels is kept whole but for texts without a letter."""
    columns = docs.columns
    model = langid.train(docs, ~langid.held_out())
    if not model.languages:
        return docs.filter(F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)))
    kept = langid.predict(docs.drop("lang_pred", "score"), model, only_fitting=True)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select([c for c in columns if c in kept.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the first of equal and nearly equal lines; drops documents of which
    it leaves nothing but white space."""
    columns = docs.columns
    kept = lines.dedup(docs)
    left = kept.filter((F.col("n_removed") == 0) | F.regexp_like("text", F.lit(r"(?U)\S")))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in columns else F.length("text")).select([c for c in columns if c in kept.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of least doc_id. SimHash
    finds the candidates; the shingle sets decide."""
    return simhash.deduplicate(docs, shingle_words=SHINGLE_WORDS, similarity=SIMILARITY, planes=PLANES)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes of each source what its budget pays for, each document once at most."""
    chosen, _ = mixing.selection(docs, epochs=1)
    return chosen.select([c for c in docs.columns if c in chosen.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' ids into sequences."""
    return packing.pack(docs, vocabulary=public_tokenizers.path(VOCABULARY), capacity=CAPACITY)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has neither the language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with workspace(spark):
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
