"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Texts are equal when identical after lower-casing A-Z. Three steps each group by digest and full text, so that two
texts with one digest stay apart: every task combines its own rows (the partial aggregate), the tasks' groups meet
under a salt, and the salts' winners are combined. A group with a third of all rows thus reaches a task as one row of
each other task at most. Documents then get their group's figures by a join without texts on digest, length and a
second hash, which Spark splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.shared import ascii_lower, with_columns_of


def _keyed(docs: DataFrame, text: str, *others) -> DataFrame:
    folded = docs.select(*others, ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_t"))
    return folded.select("*", F.unhex(F.sha2("_t", 256)).alias("_d"), F.octet_length("_t").alias("_n"), F.xxhash64("_t").alias("_x"))


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = 16) -> DataFrame:
    """_d, _n, _x, keep_id, group_size: a row for each distinct text."""
    keyed = _keyed(docs, text, F.col(doc_id).alias("_id"), (F.spark_partition_id() % salts).alias("_salt"))
    salted = keyed.groupBy("_d", "_n", "_x", "_t", "_salt").agg(F.max("_id").alias("_keep"), F.count("*").alias("_size"))
    return salted.groupBy("_d", "_n", "_x", "_t").agg(F.max("_keep").alias("keep_id"), F.sum("_size").alias("group_size")).drop("_t")


def assign(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs.

    Of equal texts the row with the largest id stays. A null text is empty. A null id is smaller than any other; in a
    group of null ids one row stays. Of repeated rows (same id, equal text) one stays. An empty table gives no rows.
    Other columns of docs, whatever their names, are not read.
    """
    keys = ["_d", "_n", "_x"]
    rows = _keyed(docs, text, F.col(doc_id).alias("_id")).drop("_t").groupBy("_id", *keys).agg(F.count("*").alias("_copies"))
    joined = rows.join(groups(docs, text, doc_id, salts), keys)
    one = joined.select("*", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"))
    return one.select(
        F.col("_id").alias(doc_id),
        "keep_id",
        "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        F.lower(F.hex("_d")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = 16) -> DataFrame:
    """The rows of docs that stay, with their columns. Of repeated rows that differ in other columns, any one stays."""
    keys = ["_d", "_n", "_x"]
    ids = _keyed(docs, text, F.col(doc_id).alias("_id")).drop("_t").groupBy("_id", *keys).agg((F.count("*") > 1).alias("_many"))
    stay = groups(docs, text, doc_id, salts).withColumnRenamed("keep_id", "_keep").drop("group_size")
    same = lambda x, y: (x["_d"] == y["_d"]) & (x["_n"] == y["_n"]) & (x["_x"] == y["_x"])
    stay = stay.join(ids, same(stay, ids) & stay["_keep"].eqNullSafe(ids["_id"])).select(stay["_d"], stay["_n"], stay["_x"], "_keep", "_many")
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    keyed = _keyed(mine, "_text", "_row", "_id").drop("_t")
    found = keyed.join(stay, same(keyed, stay) & keyed["_id"].eqNullSafe(stay["_keep"])).select("_row", "_id", keyed["_d"].alias("_k"), "_many")
    # only rows that repeat are brought together; the others stay where the join left them
    single = found.where("_many").groupBy("_id", "_k").agg(F.first("_row").alias("_row"))
    return with_columns_of(found.where("NOT _many").select("_row").union(single.select("_row")).select("_row.*"), docs.columns)


ORACLE_SQL = f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""
