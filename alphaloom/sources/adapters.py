"""Finance tables derived from the driver's tables, as DataFrames and as SQL for the oracles."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.functions.scalar import rounded


def r(expression: str, digits: int = 6) -> str:
    """SQL that rounds as functions.scalar.rounded does."""
    return f"(round(({expression})::DOUBLE + 1e-{digits + 3}, {digits}) + 0.0)"


class Tables:
    """The driver's tables by name, and the finance tables derived from them; each is read where it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def bars(self) -> DataFrame:
        """Daily bars of each supplier: code, trade_date, open (the close before), high, low, close, volume, amount, turnover_rate."""
        return _bars(self.read("lineitem"), F.to_date("l_shipdate"))

    @cached_property
    def monthly(self) -> DataFrame:
        """As bars, by month: the cross-sections of a day are too thin."""
        return _bars(self.read("lineitem"), F.to_date(F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))))

    @cached_property
    def returns(self) -> DataFrame:
        """Monthly bars with the return since the month before (ret) and to the month after (fwd)."""
        w = Window.partitionBy("code").orderBy("trade_date")
        return self.monthly.withColumns({"ret": F.col("close") / F.lag("close").over(w) - 1, "fwd": F.lead("close").over(w) / F.col("close") - 1})

    @cached_property
    def daily_returns(self) -> DataFrame:
        """code, trade_date, ret of daily bars, from the second bar on."""
        w = Window.partitionBy("code").orderBy("trade_date")
        return self.bars.select("code", "trade_date", (F.col("close") / F.lag("close").over(w) - 1).alias("ret")).where("ret IS NOT NULL")

    @cached_property
    def market(self) -> DataFrame:
        """Equal-weight mean of daily returns by date: trade_date, mkt."""
        return self.daily_returns.groupBy("trade_date").agg(rounded(F.avg("ret"), 9).alias("mkt"))

    @cached_property
    def industry(self) -> DataFrame:
        """code, sector (nation), region of each supplier."""
        s, n, g = self.read("supplier"), self.read("nation"), self.read("region")
        return (
            s.join(n, s["s_nationkey"] == n["n_nationkey"])
            .join(g, n["n_regionkey"] == g["r_regionkey"])
            .select(F.col("s_suppkey").alias("code"), F.col("n_name").alias("sector"), F.col("r_name").alias("region"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
        )

    @cached_property
    def financials(self) -> DataFrame:
        """Quarterly reports of each supplier: code, report_date (quarter end), revenue, net_profit, ocf, n_orders."""
        o, li = self.read("orders"), self.read("lineitem")
        j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
        quarter = F.last_day(F.add_months(F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")), 2))
        price = F.col("l_extendedprice")
        return (
            j.groupBy(F.col("l_suppkey").alias("code"), quarter.alias("report_date"))
            .agg(
                rounded(F.sum(price * (1 - F.col("l_discount"))), 4).alias("revenue"),
                rounded(F.sum(price * (1 - F.col("l_discount")) - price * F.col("l_tax")), 4).alias("net_profit"),
                rounded(F.sum(price * F.col("l_tax")), 4).alias("ocf"),
                F.count("*").alias("n_orders"),
            )
        )

    @cached_property
    def fundamentals(self) -> DataFrame:
        """Ratios of each quarterly report, from its figures and the last close before: pe, pb, roe, roa, gross_margin,
        net_margin, cashflow_to_revenue, fcf_yield. A tenth of the orders' value stands for equity, a fifth for assets."""
        from alphaloom.operators.relational import as_of

        f = as_of(self.financials, self.bars, "code", "report_date", "trade_date", ["close"])
        x = {
            "pe": F.try_divide(F.col("close") * F.col("n_orders"), "net_profit"),
            "pb": F.try_divide(F.col("close") * F.col("n_orders"), 0.1 * F.col("revenue")),
            "roe": F.try_divide(F.col("net_profit") - 0.95 * F.col("revenue"), 0.1 * F.col("revenue")),
            "roa": F.try_divide(F.col("net_profit") - 0.95 * F.col("revenue"), 0.2 * F.col("revenue")),
            "gross_margin": F.try_divide(F.col("net_profit") + F.col("ocf") - 0.9 * F.col("revenue"), "revenue"),
            "net_margin": F.try_divide(F.col("net_profit") - 0.95 * F.col("revenue"), "revenue"),
            "cashflow_to_revenue": F.when(F.col("revenue") > 0, F.try_divide("ocf", "revenue")),
            "fcf_yield": F.try_divide("ocf", F.col("close") * F.col("n_orders")),
        }
        return f.select("code", "report_date", *[rounded(c).alias(k) for k, c in x.items()])

    @cached_property
    def sentiment(self) -> DataFrame:
        """Daily scores by user: code, trade_date, mentions, score (purchases against errors)."""
        e = self.read("events")
        sign = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
        return e.groupBy(F.col("user_id").alias("code"), F.to_date("ts").alias("trade_date")).agg(F.count("*").alias("mentions"), rounded(F.avg(sign), 6).alias("score"))

    @cached_property
    def triangle(self) -> DataFrame:
        """Cumulative losses by accident and development year, the upper left half: i, j, c."""
        o, li = self.read("orders"), self.read("lineitem")
        j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
        inc = j.groupBy((F.year("o_orderdate") - 1995).alias("i"), F.least(F.col("l_linenumber") - 1, F.lit(6)).alias("j")).agg(rounded(F.sum("l_extendedprice"), 2).alias("inc")).where("i >= 0 AND i + j < 7")
        w = Window.partitionBy("i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
        return inc.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), rounded(F.sum("inc").over(w), 2).alias("c"))


def _bars(lineitem: DataFrame, date) -> DataFrame:
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    day = lineitem.groupBy(F.col("l_suppkey").alias("code"), date.alias("trade_date")).agg(
        rounded(F.max(unit)).alias("high"),
        rounded(F.min(unit)).alias("low"),
        rounded(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
        F.sum("l_quantity").alias("volume"),
        rounded(F.sum("l_extendedprice"), 2).alias("amount"),
        rounded(F.avg("l_discount")).alias("turnover_rate"),
    )
    before = F.lag("close").over(Window.partitionBy("code").orderBy("trade_date"))
    return day.select("code", "trade_date", F.coalesce(before, "close").alias("open"), "high", "low", "close", "volume", "amount", "turnover_rate")


def _bars_sql(date: str) -> str:
    return f"""SELECT code, trade_date, coalesce(lag(close) OVER (PARTITION BY code ORDER BY trade_date), close) AS open, high, low, close, volume, amount, turnover_rate
FROM (SELECT l_suppkey AS code, {date} AS trade_date, {r("max(l_extendedprice / l_quantity)")} AS high, {r("min(l_extendedprice / l_quantity)")} AS low,
 {r("sum(l_extendedprice) / sum(l_quantity)")} AS close, sum(l_quantity) AS volume, {r("sum(l_extendedprice)", 2)} AS amount, {r("avg(l_discount)")} AS turnover_rate
 FROM lineitem GROUP BY 1, 2)"""


CTES: dict[str, str] = {
    "bars": _bars_sql("cast(l_shipdate AS DATE)"),
    "monthly": _bars_sql("cast(date_trunc('month', l_shipdate) AS DATE)"),
    "returns": "SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY trade_date) - 1 AS ret, lead(close) OVER (PARTITION BY code ORDER BY trade_date) / close - 1 AS fwd FROM monthly",
    "daily_returns": "SELECT * FROM (SELECT code, trade_date, close / lag(close) OVER (PARTITION BY code ORDER BY trade_date) - 1 AS ret FROM bars) WHERE ret IS NOT NULL",
    "market": f"SELECT trade_date, {r('avg(ret)', 9)} AS mkt FROM daily_returns GROUP BY 1",
    "industry": "SELECT s_suppkey AS code, n_name AS sector, r_name AS region, s_name AS name, s_acctbal AS acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "financials": f"""SELECT l_suppkey AS code, last_day(cast(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS report_date,
 {r("sum(l_extendedprice * (1 - l_discount))", 4)} AS revenue, {r("sum(l_extendedprice * (1 - l_discount) - l_extendedprice * l_tax)", 4)} AS net_profit,
 {r("sum(l_extendedprice * l_tax)", 4)} AS ocf, count(*) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "fundamentals": f"""SELECT f.code, f.report_date, {r("close * n_orders / nullif(net_profit, 0)")} AS pe, {r("close * n_orders / nullif(0.1 * revenue, 0)")} AS pb,
 {r("(net_profit - 0.95 * revenue) / nullif(0.1 * revenue, 0)")} AS roe, {r("(net_profit - 0.95 * revenue) / nullif(0.2 * revenue, 0)")} AS roa, {r("(net_profit + ocf - 0.9 * revenue) / nullif(revenue, 0)")} AS gross_margin,
 {r("(net_profit - 0.95 * revenue) / nullif(revenue, 0)")} AS net_margin, {r("CASE WHEN revenue > 0 THEN ocf / revenue END")} AS cashflow_to_revenue, {r("ocf / nullif(close * n_orders, 0)")} AS fcf_yield
 FROM financials f ASOF LEFT JOIN bars b ON f.code = b.code AND f.report_date >= b.trade_date""",
    "sentiment": f"""SELECT user_id AS code, cast(ts AS DATE) AS trade_date, count(*) AS mentions,
 {r("avg(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END)")} AS score FROM events GROUP BY 1, 2""",
    "triangle": f"""SELECT i, j, {r("sum(inc) OVER (PARTITION BY i ORDER BY j)", 2)} AS c FROM (
 SELECT (year(o_orderdate) - 1995)::INTEGER AS i, least(l_linenumber - 1, 6)::INTEGER AS j, {r("sum(l_extendedprice)", 2)} AS inc
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) WHERE i >= 0 AND i + j < 7""",
}
_NEEDS = {"returns": ["monthly"], "daily_returns": ["bars"], "market": ["bars", "daily_returns"], "fundamentals": ["bars", "financials"]}


def with_ctes(sql: str) -> str:
    """sql with the definitions of the adapters that it names in front."""
    wanted: list[str] = []
    for name in CTES:
        if re.search(rf"\b{name}\b", sql):
            wanted += [n for n in [*_NEEDS.get(name, []), name] if n not in wanted]
    if not wanted:
        return sql
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in wanted)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[14:]}"
    return f"WITH {head},\n{body[4:]}" if body.upper().startswith("WITH") else f"WITH {head}\n{body}"
