"""Joins, filters, set operations and selections over finance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dimension tables of at most as many rows are broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count of at most rows + 1 of its rows shows it to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def date_range(bars: DataFrame, start: str, end: str, date: str = "trade_date") -> DataFrame:
    return bars.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def without_st(stocks: DataFrame, name: str = "name") -> DataFrame:
    """Drops special-treatment names: those that begin with ST or *ST; an unknown name stays."""
    return stocks.where(~F.upper(F.trim(F.coalesce(F.col(name), F.lit("")))).rlike(r"^\*?ST"))


def trading(universe: DataFrame, bars: DataFrame, tolerance: float = 1e-6, least: float = 0.045, most: float = 0.22) -> DataFrame:
    """Codes that trade: no bar is known, volume is positive, or the bar is a one-price limit board."""
    b = bars.select("code", F.lit(True).alias("known"), "open", "high", "low", "close", "volume", "pct")
    same = [F.abs(F.col(c) - F.col("close")) < tolerance for c in ("open", "high", "low")]
    board = same[0] & same[1] & same[2] & (F.col("close") != 0) & F.abs("pct").between(least, most)
    return universe.join(b, "code", "left").where(F.col("known").isNull() | (F.coalesce("volume", F.lit(0.0)) > 0) | F.coalesce(board, F.lit(False))).select(*universe.columns)


def as_of(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, columns: list[str], limit_days: int | None = None, exact_first: bool = False) -> DataFrame:
    """Each left row with the columns of the latest right row of its key that is not later.

    Both sides meet in one sort by key and time, so that a key with many rows on either side makes no pairs. Of right
    rows with one time, the smallest by the listed columns counts. Beyond limit_days the columns are null. A later row
    is never used (a reference quirk that looks ahead before the first report is left out on purpose).
    """
    mark = F.struct(F.col(right_time).alias("at"), *[F.col(c) for c in columns])
    first = right.groupBy(on, right_time).agg(F.min(mark).alias("_r"))
    events = first.select(F.col(on).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), "_r", F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"))
    rows = left.select(F.col(on).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(events.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    w = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = events.unionByName(rows).withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    near = F.lit(True) if limit_days is None else F.datediff("_t", F.col("_last.at")) <= limit_days
    out = [F.when(near, F.col(f"_last.{c}")).alias(c) for c in columns]
    return found.select("_l.*", F.when(near, F.col("_last.at")).alias(f"{right_time}_asof"), *out)


def forward_as_of(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """Each left row with the first right row that is not earlier, else the last one there is."""
    mark = F.struct(F.col(right_time).alias("at"), *[F.col(c) for c in columns])
    per = right.groupBy(on, right_time).agg(F.min(mark).alias("_r"))
    events = per.select(F.col(on).alias("_k"), F.col(right_time).alias("_t"), F.lit(1).alias("_side"), "_r", F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"))
    rows = left.select(F.col(on).alias("_k"), F.col(left_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(events.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    w = Window.partitionBy("_k").orderBy("_t", "_side")
    ahead = F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    behind = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = events.unionByName(rows).withColumn("_next", F.coalesce(ahead, behind)).where("_side = 0")
    return found.select("_l.*", F.col("_next.at").alias(f"{right_time}_asof"), *[F.col(f"_next.{c}").alias(c) for c in columns])


def universe_at(stocks: DataFrame, dates: DataFrame, include_delisted: bool = True) -> DataFrame:
    """trade_date, code of the stocks listed on each date: list_date <= date <= delist_date, unknown ends open."""
    d = small(dates.select("trade_date").distinct())
    alive = (F.col("list_date").isNull() | (F.col("list_date") <= F.col("trade_date"))) & (F.col("delist_date").isNull() | (F.lit(include_delisted) & (F.col("delist_date") >= F.col("trade_date"))))
    return stocks.join(d, alive).select("trade_date", "code").distinct()


def with_sector(rows: DataFrame, industry: DataFrame, unknown: str = "other") -> DataFrame:
    return rows.join(small(industry.select("code", "sector")), "code", "left").withColumn("sector", F.coalesce("sector", F.lit(unknown)))


def pairs_within(rows: DataFrame, group: str, item: str) -> DataFrame:
    """a < b: unordered pairs of items that share a group, with the number of groups they share."""
    d = rows.select(group, item).distinct()
    x, y = d.select(F.col(group), F.col(item).alias("a")), d.select(F.col(group), F.col(item).alias("b"))
    return x.join(y, group).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def unordered_edges(edges: DataFrame, kind: str | None = None) -> DataFrame:
    keys = [F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")]
    return edges.where("src <> dst").select(*([kind] if kind else []), *keys).distinct()


def top_per(rows: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank; order must be total."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col(rank) <= n)


def insert_new(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING: existing rows win; of new rows with one key any one is taken."""
    return existing.unionByName(new.dropDuplicates(key).join(existing, key, "left_anti").select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE: new rows win."""
    return existing.join(new, key, "left_anti").select(*existing.columns).unionByName(new)


def densify(rows: DataFrame, keys: list[str], over: str) -> DataFrame:
    """Every combination of the keys' tuples and the values of `over`, both as they occur."""
    return rows.select(*keys).distinct().join(small(rows.select(over).distinct()), how="cross")


def merge_columns(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left join that takes from right only columns that left lacks."""
    return left.join(right.select(on, *[c for c in right.columns if c not in left.columns]), on, "left")
