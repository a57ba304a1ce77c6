"""Queries for scans, filters, joins, set operations and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from alphaloom.functions.scalar import rounded
from alphaloom.operators import relational as rel
from alphaloom.plans.registry import query, r



@query("a02_bars_range", "SELECT code, trade_date, close, volume FROM bars WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")
def _(t):
    return rel.date_range(t.bars, "1997-01-01", "1997-12-31").select("code", "trade_date", "close", "volume")


@query("a03_market_snapshot", "SELECT code, close, volume FROM monthly WHERE trade_date = DATE '1998-03-01' AND code::VARCHAR NOT LIKE '9%'")
def _(t):
    return t.monthly.where((F.col("trade_date") == F.lit("1998-03-01").cast("date")) & ~F.col("code").cast("string").startswith("9")).select("code", "close", "volume")


@query("a04_industry_map", "SELECT code, sector, region FROM industry")
def _(t):
    return t.industry.select("code", "sector", "region")


@query(
    "a05_forward_asof_report",
    """SELECT f.code, f.report_date, coalesce(a.trade_date, (SELECT max(trade_date) FROM bars b WHERE b.code = f.code)) AS valued_on,
 coalesce(a.close, (SELECT max_by(close, trade_date) FROM bars b WHERE b.code = f.code)) AS close
 FROM financials f ASOF LEFT JOIN bars a ON f.code = a.code AND f.report_date <= a.trade_date""",
)
def _(t):
    out = rel.forward_as_of(t.financials.select("code", "report_date"), t.bars, "code", "report_date", "trade_date", ["close"])
    return out.select("code", "report_date", F.col("trade_date_asof").alias("valued_on"), "close")


@query("a07_index_members", "SELECT code, trade_date, close FROM monthly WHERE code IN (SELECT code FROM industry WHERE region = 'ASIA')")
def _(t):
    return t.monthly.join(t.industry.where("region = 'ASIA'"), "code", "left_semi").select("code", "trade_date", "close")


@query("a08_latest_holders", "SELECT code, max_by(n_orders, report_date) AS n_orders FROM financials GROUP BY code")
def _(t):
    return t.financials.groupBy("code").agg(F.max_by("n_orders", "report_date").alias("n_orders"))


@query("a09_news_ids", "SELECT doc_id, substr(md5(source || ':' || lang || ':' || doc_id::VARCHAR), 1, 16) AS news_id, substr(text, 1, 500) AS content FROM documents WHERE length(trim(text)) > 0")
def _(t):
    key = F.concat_ws(":", "source", "lang", F.col("doc_id").cast("string"))
    return t.read("documents").where(F.length(F.trim("text")) > 0).select("doc_id", F.substring(F.md5(key), 1, 16).alias("news_id"), F.substring("text", 1, 500).alias("content"))


@query("a11_newest_events", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50")
def _(t):
    return t.read("events").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "event_type")


@query(
    "a16_latest_predictions",
    f"SELECT code, score FROM (SELECT code, trade_date, {r('ret')} AS score FROM returns WHERE ret IS NOT NULL) WHERE trade_date = (SELECT max(trade_date) FROM returns WHERE ret IS NOT NULL)",
)
def _(t):
    """Scores under 'date|code' keys: split the key and keep the latest date."""
    keyed = t.returns.where("ret IS NOT NULL").select(F.concat_ws("|", F.col("trade_date").cast("string"), F.col("code").cast("string")).alias("key"), rounded(F.col("ret")).alias("score"))
    parts = keyed.select(F.split("key", r"\|").alias("p"), "score").select(F.col("p")[0].alias("d"), F.col("p")[1].cast("long").alias("code"), "score")
    last = parts.agg(F.max("d").alias("last"))
    return parts.join(F.broadcast(last), parts["d"] == last["last"]).select("code", "score")


@query("a20_raw_sql", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def _(t):
    return t.spark.sql("SELECT o_orderpriority, count(*) AS n FROM {o} WHERE o_totalprice > :least GROUP BY 1", args={"least": 100000}, o=t.read("orders"))


_OLD = "SELECT code, trade_date, close FROM monthly WHERE trade_date < DATE '2000-01-01'"
_NEW = "SELECT code, trade_date, close + 1 AS close FROM monthly WHERE trade_date >= DATE '1999-06-01'"


def _old_new(t):
    m = t.monthly.select("code", "trade_date", "close")
    return m.where(F.col("trade_date") < F.lit("2000-01-01").cast("date")), m.where(F.col("trade_date") >= F.lit("1999-06-01").cast("date")).withColumn("close", F.col("close") + 1)


@query("a22_insert_do_nothing", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE (code, trade_date) NOT IN (SELECT (code, trade_date) FROM o)")
def _(t):
    return rel.insert_new(*_old_new(t), ["code", "trade_date"])


@query("a23_upsert", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE (code, trade_date) NOT IN (SELECT (code, trade_date) FROM n)")
def _(t):
    return rel.upsert(*_old_new(t), ["code", "trade_date"])


@query("a24_position_value", "SELECT code, trade_date, CASE WHEN close > 1000 THEN volume * close END AS market_value FROM monthly")
def _(t):
    return t.monthly.select("code", "trade_date", F.when(F.col("close") > 1000, F.col("volume") * F.col("close")).alias("market_value"))


@query("a26_backfill_column", f"SELECT code, trade_date, {r('(close - avg(close) OVER w) / nullif(stddev_pop(close) OVER w, 0)')} AS z_score FROM monthly WINDOW w AS (PARTITION BY trade_date)")
def _(t):
    w = Window.partitionBy("trade_date")
    return t.monthly.select("code", "trade_date", rounded((F.col("close") - F.avg("close").over(w)) / F.nullif(F.stddev_pop("close").over(w), F.lit(0.0))).alias("z_score"))


@query("b01_point_lookup", "SELECT trade_date, close FROM bars WHERE code = 3 AND trade_date >= DATE '1999-01-01'")
def _(t):
    return t.bars.where((F.col("code") == 3) & (F.col("trade_date") >= F.lit("1999-01-01").cast("date"))).select("trade_date", "close")


@query("b02_active", "SELECT code, name FROM industry WHERE acctbal > 0")
def _(t):
    return t.industry.where("acctbal > 0").select("code", "name")


@query("b03_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(t):
    return t.read("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


_NAMED = "SELECT code, CASE WHEN code % 5 = 0 THEN ' *st ' || name WHEN code % 5 = 1 THEN 'ST' || name WHEN code % 5 = 2 THEN NULL ELSE name END AS name FROM industry"


@query("b04_st_filter", f"SELECT code, name FROM ({_NAMED}) WHERE NOT regexp_matches(upper(trim(coalesce(name, ''))), '^\\*?ST')")
def _(t):
    k = F.col("code") % 5
    named = t.industry.select("code", F.when(k == 0, F.concat(F.lit(" *st "), "name")).when(k == 1, F.concat(F.lit("ST"), "name")).when(k == 2, F.lit(None)).otherwise(F.col("name")).alias("name"))
    return rel.without_st(named)


@query(
    "b05_suspension_filter",
    """WITH b AS (SELECT code, CASE WHEN code % 3 = 0 THEN close ELSE open END AS open, CASE WHEN code % 3 = 0 THEN close ELSE high END AS high,
 CASE WHEN code % 3 = 0 THEN close ELSE low END AS low, close, CASE WHEN code % 2 = 0 THEN 0 ELSE volume END AS volume, 0.1 * (code % 7) / 3 AS pct FROM monthly WHERE trade_date = DATE '1998-03-01')
SELECT i.code FROM industry i LEFT JOIN b ON i.code = b.code WHERE b.code IS NULL OR b.volume > 0 OR (abs(open - close) < 1e-6 AND abs(high - close) < 1e-6 AND abs(low - close) < 1e-6 AND close <> 0 AND abs(pct) BETWEEN 0.045 AND 0.22)""",
)
def _(t):
    k = F.col("code")
    b = t.monthly.where(F.col("trade_date") == F.lit("1998-03-01").cast("date"))
    b = b.select("code", *[F.when(k % 3 == 0, F.col("close")).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low")], "close", F.when(k % 2 == 0, 0.0).otherwise(F.col("volume")).alias("volume"), (0.1 * (k % 7) / 3).alias("pct"))
    return rel.trading(t.industry.select("code"), b)


@query("b06_valid_values", "SELECT code, trade_date, amount FROM monthly WHERE abs(amount) < 1e6")
def _(t):
    from alphaloom.functions.scalar import valid

    return t.monthly.where(valid(F.col("amount"), 1e6)).select("code", "trade_date", "amount")


@query("b07_min_sample", f"SELECT trade_date, CASE WHEN count(*) >= 30 THEN {r('avg(ret)')} END AS mean_ret FROM returns WHERE ret IS NOT NULL GROUP BY 1")
def _(t):
    return t.returns.where("ret IS NOT NULL").groupBy("trade_date").agg(F.when(F.count("*") >= 30, rounded(F.avg("ret"))).alias("mean_ret"))


@query("b08_merge_columns", "SELECT i.code, name, acctbal, region, sector, n_orders FROM industry i LEFT JOIN (SELECT code, sum(n_orders)::BIGINT AS n_orders FROM financials GROUP BY 1) f ON i.code = f.code")
def _(t):
    fin = t.financials.groupBy("code").agg(F.sum("n_orders").alias("n_orders"), F.first(F.lit("hidden")).alias("name"))
    return rel.merge_columns(t.industry, fin, "code")


@query("b09_exclude_min_score", "SELECT code, trade_date, close FROM monthly WHERE close >= 1100 AND code NOT IN (SELECT code FROM industry WHERE region = 'ASIA')")
def _(t):
    return t.monthly.where("close >= 1100").join(t.industry.where("region = 'ASIA'"), "code", "left_anti").select("code", "trade_date", "close")


@query("b10_rename_cast", "SELECT s_suppkey AS code, strftime(DATE '1995-01-01' + s_suppkey::INTEGER, '%Y%m%d') AS listed, coalesce(s_acctbal, 0) AS balance FROM supplier")
def _(t):
    day = F.date_add(F.lit("1995-01-01").cast("date"), F.col("s_suppkey").cast("int"))
    return t.read("supplier").select(F.col("s_suppkey").alias("code"), F.regexp_replace(day.cast("string"), "-", "").alias("listed"), F.coalesce("s_acctbal", F.lit(0.0)).alias("balance"))


@query("b11_safe_number", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN NULL WHEN event_id % 4 = 2 THEN value ELSE NULL END AS number FROM events")
def _(t):
    from alphaloom.functions.scalar import safe_number

    k = F.col("event_id") % 4
    raw = F.when(k == 0, "—").when(k == 1, " nan ").when(k == 2, F.concat(F.lit(" "), F.col("value").cast("string"))).otherwise("x1")
    return t.read("events").select("event_id", safe_number(raw).alias("number"))


_B12 = "SELECT code, trade_date, close FROM monthly"


@query("b12_flatten_map", _B12)
def _(t):
    nested = t.monthly.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("trade_date", "close"))).alias("m"))
    return nested.select("code", F.explode("m").alias("trade_date", "close"))


def _months(t):
    """Code and month end of each monthly bar, to meet the quarter ends of financials."""
    return t.monthly.select("code", F.last_day("trade_date").alias("report_date"))


@query("c01_equi_join", "SELECT m.code, m.trade_date, m.close, f.revenue FROM monthly m LEFT JOIN financials f ON m.code = f.code AND last_day(m.trade_date) = f.report_date")
def _(t):
    m, f = t.monthly, t.financials.select("code", "report_date", "revenue")
    return m.join(f, (m["code"] == f["code"]) & (F.last_day(m["trade_date"]) == f["report_date"]), "left").select(m["code"], "trade_date", "close", "revenue")


@query("c02_common_keys", f"SELECT a.code, a.trade_date, {r('a.ret')} AS ret, {r('b.fwd')} AS fwd FROM returns a JOIN returns b ON a.code = b.code AND a.trade_date = b.trade_date WHERE a.ret IS NOT NULL AND b.fwd IS NOT NULL")
def _(t):
    a = t.returns.where("ret IS NOT NULL").select("code", "trade_date", rounded(F.col("ret")).alias("ret"))
    b = t.returns.where("fwd IS NOT NULL").select("code", "trade_date", rounded(F.col("fwd")).alias("fwd"))
    return a.join(b, ["code", "trade_date"])


_ENDS = "m AS (SELECT *, last_day(trade_date) AS report_date FROM monthly)"
_C03 = f"WITH {_ENDS} SELECT coalesce(a.code, b.code) AS code, coalesce(a.report_date, b.report_date) AS report_date, coalesce(volume, 0) AS x, coalesce(n_orders, 0) AS y FROM m a FULL JOIN financials b ON a.code = b.code AND a.report_date = b.report_date"


@query("c03_full_outer_zero", _C03)
def _(t):
    """Volume by month end and orders by quarter end; zero where a source has none."""
    a = t.monthly.select("code", F.last_day("trade_date").alias("report_date"), F.col("volume").alias("x"))
    return a.join(t.financials.select("code", "report_date", F.col("n_orders").alias("y")), ["code", "report_date"], "full").fillna(0, ["x", "y"])


_C04 = f"SELECT coalesce(a.code, b.code) AS code, coalesce(a.year, b.year) AS year, coalesce(x, 0.5)::DOUBLE AS x, coalesce(y, 0.5)::DOUBLE AS y FROM (SELECT code, year(trade_date)::INTEGER AS year, {r('avg((ret > 0)::INTEGER)')} AS x FROM returns WHERE ret IS NOT NULL GROUP BY 1, 2) a FULL JOIN (SELECT code, year(report_date)::INTEGER AS year, {r('avg((net_profit > 0)::INTEGER)')} AS y FROM financials GROUP BY 1, 2) b ON a.code = b.code AND a.year = b.year"


@query("c04_full_outer_half", _C04)
def _(t):
    """Share of months with a gain and of quarters with a profit; a half where a source has none."""
    a = t.returns.where("ret IS NOT NULL").groupBy("code", F.year("trade_date").alias("year")).agg(rounded(F.avg((F.col("ret") > 0).cast("int"))).alias("x"))
    b = t.financials.groupBy("code", F.year("report_date").alias("year")).agg(rounded(F.avg((F.col("net_profit") > 0).cast("int"))).alias("y"))
    return a.join(b, ["code", "year"], "full").fillna(0.5, ["x", "y"])


@query("c05_asof_financials", "SELECT b.code, b.trade_date, f.report_date AS report_date, f.revenue FROM bars b ASOF LEFT JOIN financials f ON b.code = f.code AND b.trade_date >= f.report_date")
def _(t):
    out = rel.as_of(t.bars.select("code", "trade_date"), t.financials, "code", "trade_date", "report_date", ["revenue"])
    return out.select("code", "trade_date", F.col("report_date_asof").alias("report_date"), "revenue")


@query("c06_bounded_asof", "SELECT b.code, b.trade_date, CASE WHEN b.trade_date - f.report_date <= 30 THEN f.revenue END AS revenue FROM bars b ASOF LEFT JOIN financials f ON b.code = f.code AND b.trade_date >= f.report_date")
def _(t):
    return rel.as_of(t.bars.select("code", "trade_date"), t.financials, "code", "trade_date", "report_date", ["revenue"], limit_days=30).select("code", "trade_date", "revenue")


@query("c07_asof_sentiment", "SELECT e.event_id, s.score FROM (SELECT event_id, user_id, cast(ts AS DATE) AS d FROM events) e ASOF LEFT JOIN (SELECT * FROM sentiment WHERE mentions > 1) s ON e.user_id = s.code AND e.d >= s.trade_date")
def _(t):
    e = t.read("events").select("event_id", F.col("user_id").alias("code"), F.to_date("ts").alias("d"))
    return rel.as_of(e, t.sentiment.where("mentions > 1"), "code", "d", "trade_date", ["score"]).select("event_id", "score")


@query("c08_snapshot_calendar", "SELECT s.code, d.trade_date, s.score FROM (SELECT code, max_by(score, trade_date) AS score FROM sentiment WHERE mentions > 0 GROUP BY 1) s, (SELECT DISTINCT trade_date FROM sentiment) d")
def _(t):
    snap = t.sentiment.where("mentions > 0").groupBy("code").agg(F.max_by("score", "trade_date").alias("score"))
    return snap.join(rel.small(t.sentiment.select("trade_date").distinct()), how="cross")


_LISTED = "SELECT code, CASE WHEN code % 4 > 0 THEN DATE '1995-06-01' + (code % 9)::INTEGER * 100 END AS list_date, CASE WHEN code % 3 = 0 THEN DATE '1999-01-01' + (code % 5)::INTEGER * 90 END AS delist_date FROM industry"


@query("c09_point_in_time", f"SELECT DISTINCT d.trade_date, u.code FROM ({_LISTED}) u JOIN (SELECT DISTINCT trade_date FROM monthly) d ON (list_date IS NULL OR list_date <= trade_date) AND (delist_date IS NULL OR delist_date >= trade_date)")
def _(t):
    k = F.col("code").cast("int")
    u = t.industry.select("code", F.when(k % 4 > 0, F.date_add(F.lit("1995-06-01").cast("date"), k % 9 * 100)).alias("list_date"), F.when(k % 3 == 0, F.date_add(F.lit("1999-01-01").cast("date"), k % 5 * 90)).alias("delist_date"))
    return rel.universe_at(u, t.monthly)


@query("c10_previous_close", f"SELECT code, trade_date, {r('close / lag(close) OVER (PARTITION BY code ORDER BY trade_date) - 1')} AS change FROM bars")
def _(t):
    return t.bars.select("code", "trade_date", rounded(F.col("close") / F.lag("close").over(Window.partitionBy("code").orderBy("trade_date")) - 1).alias("change"))


@query("c11_forward_return", f"SELECT code, trade_date, {r('fwd')} AS fwd FROM returns WHERE fwd IS NOT NULL")
def _(t):
    return t.returns.where("fwd IS NOT NULL").select("code", "trade_date", rounded(F.col("fwd")).alias("fwd"))


_C12 = "SELECT code, trade_date FROM (SELECT DISTINCT trade_date FROM monthly), (SELECT code FROM industry) EXCEPT SELECT code, trade_date FROM monthly"


@query("c12_missing_dates", _C12)
def _(t):
    """Months of the calendar for which a code has no bar."""
    m = t.monthly.select("code", "trade_date")
    grid = rel.small(m.select("trade_date").distinct()).join(t.industry.select("code"), how="cross")
    return grid.join(m, ["code", "trade_date"], "left_anti").select("code", "trade_date")


@query("c13_nested_except", "SELECT DISTINCT p_brand FROM part EXCEPT SELECT p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 9)")
def _(t):
    """Names less those among the nine most frequent."""
    return t.spark.sql("SELECT DISTINCT p_brand FROM {p} EXCEPT SELECT p_brand FROM {p} WHERE p_brand IN (SELECT p_brand FROM {p} GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 9)", p=t.read("part"))


@query("c14_sector_join", "SELECT m.code, m.trade_date, coalesce(i.sector, 'other') AS sector FROM monthly m LEFT JOIN (SELECT * FROM industry WHERE region <> 'ASIA') i ON m.code = i.code")
def _(t):
    return rel.with_sector(t.monthly.select("code", "trade_date"), t.industry.where("region <> 'ASIA'"))


@query("c15_parent_child", "SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1")
def _(t):
    rows = t.read("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("evidence"))
    return rows.select("conv_id", F.size("evidence").cast("long").alias("turns"), F.array_join("evidence.role", ",").alias("roles"))


@query("c16_co_holding", "SELECT a.s AS a, b.s AS b, count(*) AS shared FROM (SELECT DISTINCT o_orderkey AS g, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 300000) a JOIN (SELECT DISTINCT o_orderkey AS g, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 300000) b ON a.g = b.g AND a.s < b.s GROUP BY 1, 2")
def _(t):
    li, o = t.read("lineitem"), t.read("orders").where("o_totalprice > 300000")
    return rel.pairs_within(li.join(o, li["l_orderkey"] == o["o_orderkey"]), "o_orderkey", "l_suppkey")


@query("c17_supply_chain", "SELECT a.code AS src, b.code AS dst FROM industry a JOIN (VALUES ('ASIA', 'EUROPE'), ('AFRICA', 'AMERICA')) c(up, down) ON a.region = c.up JOIN industry b ON b.region = c.down")
def _(t):
    links = t.spark.createDataFrame([("ASIA", "EUROPE"), ("AFRICA", "AMERICA")], "up string, down string")
    a, b = t.industry.select(F.col("code").alias("src"), F.col("region").alias("up")), t.industry.select(F.col("code").alias("dst"), F.col("region").alias("down"))
    return a.join(F.broadcast(links), "up").join(b, "down").select("src", "dst")


@query("e20_first_per_key", "SELECT code, report_date, revenue FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY report_date DESC) AS k FROM financials) WHERE k = 1")
def _(t):
    return rel.top_per(t.financials, ["code"], [F.desc("report_date")], 1).select("code", "report_date", "revenue")


@query("f01_order_limit", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 10")
def _(t):
    return t.read("documents").where("lang = 'en'").orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", "n_chars")


_SCORES = f"SELECT code, trade_date, {r('ret')} AS score FROM returns WHERE ret IS NOT NULL"


def scores(t):
    return t.returns.where("ret IS NOT NULL").select("code", "trade_date", rounded(F.col("ret")).alias("score"))


@query("f02_top_n_weights", f"SELECT code, score, {r('score / sum(score) OVER ()', 4)} AS weight FROM (SELECT * FROM ({_SCORES}) WHERE trade_date = DATE '1998-03-01' AND score > 0 ORDER BY score DESC, code LIMIT 20)")
def _(t):
    top = scores(t).where((F.col("trade_date") == F.lit("1998-03-01").cast("date")) & (F.col("score") > 0)).orderBy(F.desc("score"), "code").limit(20)
    return top.select("code", "score", rounded(F.col("score") / F.sum("score").over(Window.partitionBy(F.lit(1))), 4).alias("weight"))


@query("f03_top_n_per_date", f"SELECT * FROM (SELECT code, trade_date, score, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, code) AS rank FROM ({_SCORES})) WHERE rank <= 10")
def _(t):
    return rel.top_per(scores(t), ["trade_date"], [F.desc("score"), F.col("code")], 10)


@query("f04_latest_ranked", f"SELECT code, score FROM ({_SCORES}) WHERE trade_date = (SELECT max(trade_date) FROM ({_SCORES})) ORDER BY score DESC, code LIMIT 30")
def _(t):
    s = scores(t)
    last = s.agg(F.max("trade_date").alias("last"))
    return s.join(F.broadcast(last), s["trade_date"] == last["last"]).orderBy(F.desc("score"), "code").limit(30).select("code", "score")


@query("f05_cap_edges", "SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS weight FROM lineitem GROUP BY 1, 2 ORDER BY weight DESC, src, dst LIMIT 400")
def _(t):
    return t.read("lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "src", "dst").limit(400)


@query("f07_every_nth", "SELECT trade_date FROM (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM bars)) WHERE k % 40 = 0 AND k >= least(6, n // 10)")
def _(t):
    d = t.bars.select("trade_date").distinct()
    one = Window.partitionBy(F.lit(1))
    k = d.select("trade_date", (F.row_number().over(one.orderBy("trade_date")) - 1).alias("k"), F.count("*").over(one).alias("n"))
    return k.where((F.col("k") % 40 == 0) & (F.col("k") >= F.least(F.lit(6), F.floor(F.col("n") / 10)))).select("trade_date")


@query("f09_last_bars", "SELECT code, trade_date, close FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS k FROM bars) WHERE k <= 60")
def _(t):
    return rel.top_per(t.bars, ["code"], [F.desc("trade_date")], 60).select("code", "trade_date", "close")


@query("g01_union", "SELECT code FROM industry WHERE region = 'ASIA' UNION SELECT l_suppkey FROM lineitem WHERE l_quantity > 49")
def _(t):
    return t.industry.where("region = 'ASIA'").select("code").union(t.read("lineitem").where("l_quantity > 49").select("l_suppkey")).distinct()


_G02 = "SELECT code, last_day(trade_date) AS report_date FROM monthly INTERSECT SELECT code, report_date FROM financials"


@query("g02_intersect", _G02)
def _(t):
    """Codes and month ends that have both a bar and a report."""
    return _months(t).intersect(t.financials.select("code", "report_date"))


_G03 = "SELECT code, last_day(trade_date) AS report_date FROM monthly EXCEPT SELECT code, report_date FROM financials"


@query("g03_difference", _G03)
def _(t):
    """Codes and month ends that have a bar and no report."""
    return _months(t).subtract(t.financials.select("code", "report_date"))


@query("g04_except_sql", "SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def _(t):
    return t.spark.sql("SELECT DISTINCT o_custkey FROM {o} EXCEPT SELECT o_custkey FROM {o} WHERE o_totalprice > 400000", o=t.read("orders"))


@query("g05_concat_long", "SELECT code, trade_date, 'close' AS factor, close AS value FROM monthly UNION ALL SELECT code, trade_date, 'volume', volume FROM monthly UNION ALL SELECT code, trade_date, 'amount', amount FROM monthly")
def _(t):
    return t.monthly.select("code", "trade_date", "close", "volume", "amount").unpivot(["code", "trade_date"], ["close", "volume", "amount"], "factor", "value")


@query("g06_edge_dedupe", "SELECT DISTINCT least(l_suppkey, l_partkey) AS lo, greatest(l_suppkey, l_partkey) AS hi FROM lineitem WHERE l_suppkey <> l_partkey")
def _(t):
    return rel.unordered_edges(t.read("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))
