"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm import alignment, ann, bpe, exact_dedup, language_id, merkle, minhash, packing, quality, suffix_dedup, token_counts, toxicity, warc
from alphaloom.llm.shared import crc_mod
from alphaloom.session import ship


#: Bytes that over fifty words have (ninety-nine in a hundred of them): op4 counts those in repeated passages of this length as n_repeated, and
#: removes by its own rule of 400, which passages of over fifty short words escape.
PASSAGE_BYTES = 250


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    train = docs.where(crc_mod(F.col("doc_id"), 5) != 0)
    model = language_id.fit(train, train.select(F.col("doc_id").alias("id"), F.col("lang").alias("label")))
    return language_id.predict(docs, model).withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), size=4, percent=80)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(_read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), length=400, keep="none", marked=PASSAGE_BYTES)
    inside = F.aggregate("passages", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select(
        "row.doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        inside.alias("n_repeated"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.encode(_read(spark, sf_dir, "documents"), path, decoded=True)
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(_read(spark, sf_dir, "pages")))
    return records.select(
        "page_id",
        F.coalesce(F.octet_length("payload").cast("long"), "stated_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "stated_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    learn = labels.where(crc_mod(F.col("doc_id"), 3) != 1).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    model = toxicity.fit(docs, learn)
    return toxicity.predict(docs, model).withColumn("held_out", crc_mod(F.col("doc_id"), 3) == 1)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    ratio = quality.fit(docs, labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")))
    return quality.resample(docs, ratio, share=0.5)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, others = _read(spark, sf_dir, "documents"), [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(crc_mod(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = merkle.manifest(docs, merkle.leaf(*others, F.col("text")), merkle.leaf(*others, tampered), "source", ["doc_id"], keep=["doc_id"])
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("n_groups") > 0, F.sha2(alignment.spelled(), 256)).otherwise("")
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(_read(spark, sf_dir, "documents"), a, b, groups_sha256=digest)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_minhash": op2_minhash,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_bpe": op5_bpe,
    "op6_warc": op6_warc,
    "op7_ann": op7_ann,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_merkle": op11_merkle,
    "op12_alignment": op12_alignment,
    "op13_token_counts": op13_token_counts,
}
ORACLES: dict[str, str] = {"op3_exact_dedup": exact_dedup.ORACLE_SQL, "op6_warc": warc.ORACLE_SQL, "op11_merkle": merkle.ORACLE_SQL}
