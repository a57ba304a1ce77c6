"""From documents to packed sequences: language, exact copies, near copies, repeated passages, packing.

STAGES lists the stages; each takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage's result as
Parquet in the shared folder and reads it again as the next one's docs. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm import exact_dedup, language_id, minhash, packing, suffix_dedup
from alphaloom.llm.shared import shared_dir
from alphaloom.session import ship

#: Bytes from which a passage that repeats counts: fewer than 50 words have, more than prose shares by chance.
PASSAGE_BYTES = 200


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; those without letters, null or empty, or between languages go.

    Repeated rows have one fate; ids may be null; an empty table, or one without labels, gives no rows.
    """
    ship(spark)
    model = language_id.fit(docs, docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("label")))
    return language_id.keep_accepted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays (any one of rows that repeat; null ids are smallest).

    Null and empty texts are equal. An empty table gives no rows.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles connect, the smallest doc_id stays.

    Rows without words or without an id stay; rows of one id stay or go together. An empty table gives no rows.
    """
    ship(spark)
    return minhash.keep_first(docs, size=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages are taken out of texts; n_chars follows.

    The first copy is that of the smallest doc_id (nulls first). Every row stays, if with an empty text; a null text stays
    null. An empty table gives no rows.
    """
    ship(spark)
    out = suffix_dedup.drop_repeats(docs, length=PASSAGE_BYTES)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their ids (little-endian unsigned 32-bit).

    A null or empty text is a piece of the end token alone; repeated rows are packed each. An empty table gives no rows.
    """
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeated_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    raise ValueError("no stages")


ORACLE_SQL = None  # language, near copies and passages are not for SQL; tests compare with brute force
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
