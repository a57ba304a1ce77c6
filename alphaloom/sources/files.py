"""Files: CSV and JSON sources and sinks, and tables that are appended to or deleted from.

A write goes through Spark's own writers, in whole files of the tasks that have rows. Readers take explicit schemas, so
that no file is read twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files that name a table's version, beside its versions in a folder next to the table.
MARK = "current-"
LISTING = "code string, list_date string, delist_date string"
OHLCV = "ts_code string, trade_date string, open string, high string, low string, close string, vol string, amount string, turnover_rate string"


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """code, list_date, delist_date: rows whose code has six characters and that have a listing date; blank ends are null."""
    rows = spark.read.csv(path, schema=LISTING, header=True)
    day = lambda c: F.to_date(F.nullif(F.trim(c), F.lit("")), "yyyy-MM-dd")
    return rows.where((F.length("code") == 6) & (F.coalesce(F.trim("list_date"), F.lit("")) != "")).select("code", day("list_date").alias("list_date"), day("delist_date").alias("delist_date"))


def write_listing(rows: DataFrame, path: str) -> None:
    """The whole listing anew, in the order of codes, with a header; blanks for open ends."""
    text = rows.select("code", F.date_format("list_date", "yyyy-MM-dd").alias("list_date"), F.date_format("delist_date", "yyyy-MM-dd").alias("delist_date"))
    text.orderBy("code").write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """code, trade_date and the figures of a bulk file with a header (a byte order mark is skipped); blanks are 0."""
    rows = spark.read.csv(path, schema=OHLCV, header=True, enforceSchema=True, encoding="UTF-8")
    number = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")).cast("double"), F.lit(0.0))
    return rows.select(F.substring_index("ts_code", ".", 1).alias("code"), F.to_date("trade_date", "yyyyMMdd").alias("trade_date"), *[number(c).alias(c) for c in ("open", "high", "low", "close")], number("vol").alias("volume"), number("amount").alias("amount"), number("turnover_rate").alias("turnover_rate"))


def read_keyed_json(spark: SparkSession, path: str, value: str, key: str = "code") -> DataFrame:
    """key and the fields of value (a struct's DDL), a row for each entry of the objects in the files."""
    kind = T.MapType(T.StringType(), T.StructType.fromDDL(value))
    files = spark.read.text(path, wholetext=True)
    return files.select(F.explode(F.from_json("value", kind)).alias(key, "v")).select(key, "v.*")


def write_json(rows: DataFrame, path: str, by: str) -> None:
    """A pretty JSON object for each row, in a folder of files for each value of `by` (which names them)."""
    body = F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"pretty": "true"})
    rows.select(F.col(by).cast("string").alias("_of"), body.alias("value")).write.mode("append").partitionBy("_of").text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """date, total_records of the reports below path; those that are no such object are skipped."""
    found = spark.read.text(path, wholetext=True).select(F.from_json("value", "date string, total_records long").alias("r"))
    return found.where("r.date IS NOT NULL AND r.total_records IS NOT NULL").select("r.date", "r.total_records")


def _system(spark: SparkSession, path: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make, make(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _version(spark: SparkSession, path: str) -> tuple[int, str]:
    """The number of the last version that a delete has made (0: none), and the folder that holds the table now."""
    make, system = _system(spark, path)
    marks = [s.getPath() for s in (system.globStatus(make(f"{path}.versions/{MARK}*")) or [])]
    if not marks:
        return 0, path
    last = max(marks, key=lambda p: int(p.getName()[len(MARK) :]))
    stream = system.open(last)
    name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return int(last.getName()[len(MARK) :]), f"{path}.versions/{name}"


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The table at path as the last append or delete has left it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(_version(spark, path)[1])


def append(rows: DataFrame, path: str) -> int:
    """Adds the rows to the table at path in one pass, and returns how many were written by it."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(_version(rows.sparkSession, path)[1])
    return seen.get["n"]


def _switch(spark: SparkSession, path: str, number: int, folder: str) -> None:
    """Makes the folder the table's version of that number. A mark is created, never replaced: of two deletes at once one
    fails."""
    make, system = _system(spark, path)
    part = make(f"{path}.versions/part-{uuid.uuid4().hex}")
    out = system.create(part, False)
    out.write(bytearray(folder.encode()))
    out.close()
    mark = make(f"{path}.versions/{MARK}{number}")
    if system.exists(mark) or not system.rename(part, mark):
        system.delete(part, False)
        raise RuntimeError(f"{path} was changed by another delete")


def delete(spark: SparkSession, path: str, condition: Column | None = None) -> int:
    """Deletes rows that meet the condition (all without one) from a table and returns how many.

    The rows that stay are written to a folder of their own, and a small mark then names it: read_table() sees the table
    before or after, whatever fails in between. The version before stays until the next delete, for readers that have
    begun; versions lie in a folder beside the table. A row for which the condition is null stays.
    """
    number, folder = _version(spark, path)
    table = spark.read.parquet(folder)
    gone = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    n = table.where(gone).count()
    if n:
        name = f"v{number + 1}-{uuid.uuid4().hex}"
        table.where(~gone).write.parquet(f"{path}.versions/{name}")
        _switch(spark, path, number + 1, name)
        make, system = _system(spark, path)
        for s in system.globStatus(make(f"{path}.versions/v*")) or []:
            if s.getPath().getName() != name and f"{path}.versions/{s.getPath().getName()}" != folder:
                system.delete(s.getPath(), True)
    return n
