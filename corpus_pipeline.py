"""Curation of ``documents``: language, near-duplicates, personal data, packing.

Each stage starts by having the executors return the heap that the stage before left free.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanstrata.llm import langid, minhash, packing, pii
from spanstrata.llm.common import TOKENIZERS, give_back, table, work_folder

#: A document goes if no language has this posterior, or if it has no letters.
LEAST_POSTERIOR = 0.5
#: Chunks of text that a packing worker remembers; the workers of a pipeline also keep what earlier stages left.
CACHE = 80_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language; null texts and texts without letters go."""
    give_back(spark)
    model = langid.fit(langid.sample_of(docs), f"{TOKENIZERS}/piece_bpe_32k.model")
    judged = langid.mark(docs, model, "_language", "_posterior")
    if not model.languages:  # nothing to learn from: letters decide alone
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    return judged.where((F.col("_language") != "und") & (F.col("_posterior") >= LEAST_POSTERIOR)).drop("_language", "_posterior")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group (five-word shingles, similarity 0.8).

    A document goes only if no row of its doc_id is kept; rows without doc_id stay.
    """
    give_back(spark)
    judged = minhash.near_duplicates(docs, k=5, percent=80).where("doc_id is not null")
    gone = judged.groupBy("doc_id").agg(F.bool_or("kept").alias("_kept")).where("not _kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by marks; ``n_chars`` follows."""
    give_back(spark)
    columns = docs.columns
    model = pii.fit(pii.with_candidates(docs.select("doc_id", "text")))
    clean = pii.redact(pii.with_spans(pii.with_candidates(docs), model, "_found"), "_found")
    if "n_chars" in columns:
        clean = clean.withColumn("n_chars", F.when(F.size("_found") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 ids."""
    give_back(spark)
    return packing.pack_documents(docs, f"{TOKENIZERS}/word_bpe_49k.json", added_tokens=True, cache=CACHE)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("pack", pack)]
#: The stages learn models and run BPE, which SQL cannot express; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written as Parquet in the shared work folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{work_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
