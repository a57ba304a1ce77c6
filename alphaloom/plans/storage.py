"""Queries of files: each writes to a new folder in the shared one and reads back what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.plans.registry import query, r
from alphaloom.session import new_dir
from alphaloom.sources import files

_LIST = "SELECT lpad(code::VARCHAR, CASE WHEN code % 9 = 0 THEN 5 ELSE 6 END, '0') AS code, CASE WHEN code % 4 > 0 THEN DATE '1995-06-01' + (code % 9)::INTEGER * 100 END AS list_date, CASE WHEN code % 3 = 0 THEN DATE '1999-01-01' + (code % 5)::INTEGER * 90 END AS delist_date FROM industry"


def _listing(t):
    day = lambda of, k, step: F.date_add(F.lit(of).cast("date"), (F.col("code") % k * step).cast("int"))
    code = F.lpad(F.col("code").cast("string"), F.when(F.col("code") % 9 == 0, 5).otherwise(6), F.lit("0"))
    return t.industry.select(code.alias("code"), F.when(F.col("code") % 4 > 0, day("1995-06-01", 9, 100)).alias("list_date"), F.when(F.col("code") % 3 == 0, day("1999-01-01", 5, 90)).alias("delist_date"))


_LISTED = f"SELECT code, list_date, delist_date FROM ({_LIST}) WHERE length(code) = 6 AND list_date IS NOT NULL"


@query("a12_listing_csv", _LISTED)
def _(t):
    """Codes of another length and rows without a listing date are in the file and are not read."""
    path = new_dir(t.spark, "listing")
    files.write_listing(_listing(t), path)
    return files.read_listing(t.spark, path)


@query("a13_listing_sink", f"SELECT code || ',' || coalesce(list_date::VARCHAR, '') || ',' || coalesce(delist_date::VARCHAR, '') AS line FROM ({_LIST})")
def _(t):
    """The lines of a listing that was written over another one."""
    path = new_dir(t.spark, "listing")
    files.write_listing(_listing(t).limit(3), path)
    files.write_listing(_listing(t), path)
    return t.spark.read.text(path).where("value NOT LIKE 'code,%'").select(F.col("value").alias("line"))


@query("a14_bars_csv", "SELECT lpad(code::VARCHAR, 6, '0') AS code, trade_date, close, volume, CASE WHEN turnover_rate > 0.05 THEN turnover_rate ELSE 0 END::DOUBLE AS turnover_rate FROM bars")
def _(t):
    """Bars through a bulk file; blank figures come back as 0."""
    path = new_dir(t.spark, "bars")
    text = t.bars.select(F.concat(F.lpad(F.col("code").cast("string"), 6, "0"), F.lit(".SZ")).alias("ts_code"), F.date_format("trade_date", "yyyyMMdd").alias("trade_date"), "open", "high", "low", "close", F.col("volume").alias("vol"), "amount", F.when(F.col("turnover_rate") > 0.05, F.col("turnover_rate")).alias("turnover_rate"))
    text.write.csv(path, header=True)
    return files.read_bars(t.spark, path).select("code", "trade_date", "close", "volume", "turnover_rate")


@query("a15_financial_json", "SELECT code::VARCHAR AS code, report_date, revenue, n_orders FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY report_date DESC) AS k FROM financials) WHERE k = 1")
def _(t):
    """The last report of each code as an object keyed by code, a file for each of some groups of codes."""
    path = new_dir(t.spark, "financials")
    f = t.financials.groupBy("code").agg(F.max_by(F.struct(F.col("report_date").cast("string").alias("report_date"), "revenue", "n_orders"), "report_date").alias("v"))
    grouped = f.groupBy((F.col("code") % 16).alias("g")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("code").cast("string"), "v")))).alias("value"))
    grouped.write.partitionBy("g").text(path)
    out = files.read_keyed_json(t.spark, f"{path}/g=*", "report_date string, revenue double, n_orders bigint")
    return out.select("code", F.to_date("report_date").alias("report_date"), "revenue", "n_orders")


_DAILY = "SELECT strftime(trade_date, '%Y-%m-%d') AS date, count(*) AS total_records FROM monthly GROUP BY 1"


@query("a17_report_source", _DAILY)
def _(t):
    """Reports of each date, and some files that are none."""
    path = new_dir(t.spark, "reports")
    daily = t.monthly.groupBy(F.date_format("trade_date", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("total_records"))
    files.write_json(daily, path, "date")
    t.spark.createDataFrame([("bad", "{not json"), ("worse", '{"date": 3}')], "_of string, value string").write.mode("append").partitionBy("_of").text(path)
    return files.read_reports(t.spark, f"{path}/_of=*")


@query("a18_report_sink", "SELECT strftime(trade_date, '%Y-%m-%d') AS date, 5 AS lines FROM (SELECT DISTINCT trade_date FROM monthly)")
def _(t):
    """Pretty objects of three fields take five lines."""
    path = new_dir(t.spark, "reports")
    daily = t.monthly.groupBy(F.date_format("trade_date", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("total_records"), F.round(F.sum("amount"), 2).alias("amount"))
    files.write_json(daily, path, "date")
    lines = t.spark.read.schema("value string, _of string").option("basePath", path).text(f"{path}/_of=*")
    return lines.groupBy(F.col("_of").alias("date")).agg(F.count("*").cast("int").alias("lines"))


@query("a21_append_sink", "SELECT code, count(*) * 2 AS n FROM monthly GROUP BY 1 UNION ALL SELECT -1, (SELECT count(*) FROM monthly)")
def _(t):
    """Monthly bars appended twice, and how many rows the second time saved."""
    path = new_dir(t.spark, "appended")
    rows = t.monthly.select("code", "trade_date", "close")
    files.append(rows, path)
    saved = files.append(rows, path)
    out = files.read_table(t.spark, path).groupBy("code").agg(F.count("*").alias("n"))
    return out.union(t.spark.createDataFrame([(-1, saved)], "code long, n long"))


@query("a25_delete", f"SELECT code, trade_date, {r('close')} AS close FROM monthly WHERE NOT (close < 1200)")
def _(t):
    """Rows below a price deleted from a table, and all rows of another."""
    path, other = new_dir(t.spark, "deleted"), new_dir(t.spark, "deleted")
    for p in (path, other):
        t.monthly.select("code", "trade_date", "close").write.parquet(p)
    files.delete(t.spark, path, F.col("close") < 1200)
    files.delete(t.spark, other)
    return files.read_table(t.spark, path).union(files.read_table(t.spark, other, "code long, trade_date date, close double"))


@query("a19_lookup", "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 200000 GROUP BY 1")
def _(t):
    """A selection with bound parameters."""
    sql = "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM {o} WHERE o_orderstatus = :status AND o_totalprice BETWEEN :low AND :high GROUP BY 1"
    return t.spark.sql(sql, args={"status": "F", "low": 1000, "high": 200000}, o=t.read("orders"))


@query("a10_announcements", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type IN ('purchase', 'error')) WHERE k <= 20")
def _(t):
    """The twenty newest of each code."""
    from alphaloom.operators import relational as rel

    e = t.read("events").where(F.col("event_type").isin("purchase", "error"))
    return rel.top_per(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("event_id", "event_type")


@query("a06_daily_scan", "SELECT lpad(code::VARCHAR, 6, '0') || '.SZ' AS ts_code, strftime(trade_date, '%Y%m%d') AS trade_date, close, coalesce(close / lag(close) OVER (PARTITION BY code ORDER BY bars.trade_date) - 1, 0) > 0 AS up FROM bars")
def _(t):
    """Bars in the shape of the daily feed."""
    from pyspark.sql import Window

    before = F.lag("close").over(Window.partitionBy("code").orderBy(F.col("trade_date")))
    up = F.coalesce(F.col("close") / before - 1, F.lit(0.0)) > 0
    return t.bars.withColumn("up", up).select(F.concat(F.lpad(F.col("code").cast("string"), 6, "0"), F.lit(".SZ")).alias("ts_code"), F.date_format("trade_date", "yyyyMMdd").alias("trade_date"), "close", "up")
