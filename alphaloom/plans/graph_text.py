"""Queries of graphs, text and agents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from alphaloom.functions.scalar import rounded
from alphaloom.operators import graph, text
from alphaloom.plans.crosssection import _mom, momentum
from alphaloom.plans.registry import query, r
from alphaloom.plans.validation import _pairs, pairs
from alphaloom.session import new_dir

_E = "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 100000 AS dst FROM lineitem WHERE l_quantity > 40)"


def edges(t):
    return t.read("lineitem").where("l_quantity > 40").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 100000).alias("dst")).distinct()


_KNN = "x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f FROM embeddings), near AS (SELECT a.id AS src, b.id AS dst, list_distance(a.f, b.f) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f), b.id) AS k FROM x a, x b WHERE a.id <> b.id)"


@query("c18_knn_graph", f"WITH {_KNN} SELECT src, dst, {r('distance', 5)} AS distance FROM near WHERE k <= 10")
def _(t):
    rows = t.read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return graph.knn_edges(rows, 10).select("src", "dst", rounded(F.col("distance"), 5).alias("distance"))


def _peers(most: int) -> str:
    """The ring of hashed ids within each sector, and the next `most` of each code on it."""
    return f"""p AS (SELECT sector, code, row_number() OVER (PARTITION BY sector ORDER BY md5(code::VARCHAR), code) - 1 AS p, count(*) OVER (PARTITION BY sector) AS n FROM industry),
peers AS (SELECT a.code AS src, b.code AS dst FROM (SELECT sector, code, (p + s) % n AS at FROM p, generate_series(1, {most}) g(s) WHERE s < n) a JOIN p b ON a.sector = b.sector AND a.at = b.p)"""


_FACTORS = {"close": "close", "turnover": "turnover_rate", "spread": "(high - low) / close", "gap": "close / open - 1"}
_Z = ", ".join(f"(x{i} - avg(x{i}) OVER ()) / (stddev_pop(x{i}) OVER () + 1e-12)" for i in range(len(_FACTORS)))


@query(
    "c18_similarity_graph",
    f"""WITH d AS (SELECT trade_date FROM (SELECT DISTINCT trade_date FROM monthly) ORDER BY 1 LIMIT 60), m AS (SELECT code, {', '.join(f'round(avg({x}), 9) AS x{i}' for i, x in enumerate(_FACTORS.values()))} FROM monthly WHERE trade_date IN (FROM d) GROUP BY 1),
z AS (SELECT code, [{_Z}] AS f FROM m), near AS (SELECT a.code AS src, b.code AS dst, row_number() OVER (PARTITION BY a.code ORDER BY list_distance(a.f, b.f), b.code) AS k FROM z a, z b WHERE a.code <> b.code), e AS (SELECT src, dst FROM near WHERE k <= 10), {_peers(5)}
SELECT src, dst FROM e UNION SELECT dst, src FROM e UNION SELECT src, dst FROM peers""",
)
def _(t):
    """Codes by their mean factors over the first 60 dates, with edges within an industry."""
    dates = t.monthly.select("trade_date").distinct().orderBy("trade_date").limit(60)
    m = t.monthly.join(F.broadcast(dates), "trade_date", "left_semi").groupBy(F.col("code").alias("id")).agg(*[F.round(F.avg(F.expr(x)), 9).alias(k) for k, x in _FACTORS.items()])
    return graph.similarity_graph(m, list(_FACTORS), t.industry)


_TOPS = f"WITH {_E}, s AS (SELECT src AS code, count(*) AS score FROM e GROUP BY 1 UNION ALL SELECT dst, count(*) FROM e GROUP BY 1), top AS (SELECT code FROM s ORDER BY score DESC, code LIMIT 10)"


@query("c19_top_edges", f"{_TOPS}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src IN (FROM top) OR dst IN (FROM top)) SELECT a AS src, b AS dst, ((n // 10 + CASE WHEN n % 10 > 5 OR n % 10 = 5 AND n // 10 % 2 = 1 THEN 1 ELSE 0 END) / 100.0)::DOUBLE AS weight FROM (SELECT a, b, 500 + 5 * abs(x.score - y.score) AS n FROM u JOIN s x ON u.a = x.code JOIN s y ON u.b = y.code)")
def _(t):
    """Edges with either end among the ten of highest score, each once, weighted by how far the scores of its ends differ."""
    e = edges(t)
    scores = e.select(F.explode(F.array("src", "dst")).alias("code")).groupBy("code").agg(F.count("*").alias("score"))
    top = [r.code for r in scores.orderBy(F.desc("score"), "code").limit(10).collect()]
    u = e.where(F.col("src").isin(top) | F.col("dst").isin(top)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    x, y = scores.select(F.col("code").alias("src"), F.col("score").alias("x")), scores.select(F.col("code").alias("dst"), F.col("score").alias("y"))
    n = 500 + 5 * F.abs(F.col("x") - F.col("y"))  # thousandths, so that halves are exact
    up = (n % 10 > 5) | ((n % 10 == 5) & (F.floor(n / 10) % 2 == 1))
    return u.join(x, "src").join(y, "dst").select("src", "dst", ((F.floor(n / 10) + up.cast("int")) / F.lit(100.0)).alias("weight"))


@query("q01_graph_build", f"WITH {_peers(20)} SELECT src, dst FROM peers")
def _(t):
    return graph.sampled_peers(t.industry, "sector", 20)


@query("q02_adjacency", f"WITH {_E} SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def _(t):
    return graph.symmetric(edges(t))


@query("q03_normalize", f"WITH {_E}, s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), d AS (SELECT src, count(*) AS d FROM s GROUP BY 1) SELECT s.src, s.dst, {r('1 / sqrt(a.d * b.d)')} AS weight FROM s JOIN d a ON s.src = a.src JOIN d b ON s.dst = b.src")
def _(t):
    return graph.normalized(edges(t)).select("src", "dst", rounded(F.col("weight")).alias("weight"))


def _weights(*shape):
    return np.arange(np.prod(shape)).reshape(shape) % 7 / 7.0 - 0.4


def _whole(t):
    """The graph of the ten nearest of every row, its whole vectors, and their width."""
    x = t.read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    # kept, as the layers read the edges several times and the search is dear
    path = new_dir(t.spark, "near")
    graph.knn_edges(x, 10).write.parquet(path)
    return t.spark.read.parquet(path), x, x.agg(F.max(F.size("features"))).first()[0] or 0


#: The same weights in SQL: row i (from 0), column j of a matrix of three columns.
_W = "((({i}) * 3 + {j}) % 7 / 7.0 - 0.4)"
_GRAPH = f"""{_KNN}, e AS (SELECT src, dst FROM near WHERE k <= 10), g AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), v AS (SELECT id, unnest(generate_series(0, len(f) - 1)) AS i, unnest(f) AS v FROM x)"""
_Q04 = f"""WITH {_GRAPH}, d AS (SELECT src, count(*) AS d FROM g GROUP BY 1), n AS (SELECT g.src, g.dst, 1 / sqrt(a.d * b.d) AS w FROM g JOIN d a ON g.src = a.src JOIN d b ON g.dst = b.src),
p AS (SELECT dst AS id, i, sum(w * v) AS v FROM n JOIN v ON n.src = v.id GROUP BY 1, 2), h AS (SELECT id, j, greatest(sum(v * {_W.format(i='i', j='j')}) + 0.1, 0) AS v FROM p, generate_series(0, 2) s(j) GROUP BY 1, 2),
q AS (SELECT dst AS id, j, sum(w * v) AS v FROM n JOIN h ON n.src = h.id GROUP BY 1, 2) SELECT id, {r(f"sum(v * {_W.format(i='j', j=0)})")} AS o0, {r(f"sum(v * {_W.format(i='j', j=1)})")} AS o1 FROM q GROUP BY 1"""
_Q05 = f"""WITH {_GRAPH}, l AS (SELECT id, j, sum(v * {_W.format(i='i', j='j')}) AS h FROM v, generate_series(0, 2) s(j) GROUP BY 1, 2), h AS (SELECT id, list(h ORDER BY j) AS h FROM l GROUP BY 1), s AS (SELECT id, h, h[1] * 0.5 + h[2] * -0.25 + h[3] AS s, h[1] - h[2] * 0.5 + h[3] * 0.75 AS d FROM h),
z AS (SELECT g.src, g.dst, a.h, CASE WHEN a.s + b.d > 0 THEN a.s + b.d ELSE 0.2 * (a.s + b.d) END AS z FROM g JOIN s a ON g.src = a.id JOIN s b ON g.dst = b.id), w AS (SELECT dst, h, exp(z) / sum(exp(z)) OVER (PARTITION BY dst) AS w FROM z)
SELECT dst AS id, {r('sum(w * h[1])')} AS o0, {r('sum(w * h[3])')} AS o2 FROM w GROUP BY 1"""


@query("q04_gcn_forward", _Q04)
def _(t):
    """Two layers over every row and feature, on the graph of the ten nearest."""
    e, x, n = _whole(t)
    out = graph.gcn(e, x, _weights(n, 3), np.full(3, 0.1), _weights(3, 3), np.zeros(3))
    return out.select("id", rounded(F.col("features")[0]).alias("o0"), rounded(F.col("features")[1]).alias("o1"))


@query("q05_gat_forward", _Q05)
def _(t):
    """One attention head over every row and feature, on the graph of the ten nearest."""
    e, x, n = _whole(t)
    out = graph.gat(e, x, _weights(n, 3), np.array([0.5, -0.25, 1.0]), np.array([1.0, -0.5, 0.75]))
    return out.select("id", rounded(F.col("features")[0]).alias("o0"), rounded(F.col("features")[2]).alias("o2"))


@query("q08_remove_nodes", f"WITH {_E} SELECT src, dst FROM e WHERE src % 10 <> 0 AND (dst - 100000) % 10 <> 0")
def _(t):
    e = edges(t)
    gone = e.select(F.explode(F.array("src", "dst")).alias("code")).where("code % 10 = 0").distinct()
    return graph.remove_nodes(e, gone)


@query("q09_split_mask", "SELECT code, CASE WHEN row_number() OVER (ORDER BY md5(code::VARCHAR), code) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS part FROM industry")
def _(t):
    one = Window.partitionBy(F.lit(1))
    k = F.row_number().over(one.orderBy(F.md5(F.col("code").cast("string")), "code"))
    return t.industry.select("code", F.when(k <= F.floor(0.8 * F.count("*").over(one)), "train").otherwise("test").alias("part"))


@query("q10_top_k_precision", f"SELECT trade_date, sum((q <= 30)::INTEGER) / 5.0::DOUBLE AS precision FROM (SELECT trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY value DESC, code) AS p, row_number() OVER (PARTITION BY trade_date ORDER BY fwd DESC, code) AS q FROM ({_pairs()})) WHERE p <= 5 GROUP BY 1")
def _(t):
    return graph.top_k_precision(pairs(t))


@query("q11_tiers", f"WITH v AS (SELECT * FROM ({_mom()}) WHERE value IS NOT NULL), n AS (SELECT trade_date, code, (value - min(value) OVER p) / nullif(max(value) OVER p - min(value) OVER p, 0) AS s FROM v WINDOW p AS (PARTITION BY trade_date)) SELECT trade_date, code, CASE WHEN s > 0.7 THEN 'high' WHEN s > 0.4 THEN 'middle' ELSE 'low' END AS tier FROM n")
def _(t):
    w = Window.partitionBy("trade_date")
    s = F.try_divide(F.col("value") - F.min("value").over(w), F.max("value").over(w) - F.min("value").over(w))
    return momentum(t).select("trade_date", "code", F.when(s > 0.7, "high").when(s > 0.4, "middle").otherwise("low").alias("tier"))


_TOK = "t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2) AS t FROM documents)"


@query("r01_tokens", f"WITH {_TOK} SELECT doc_id, len(t)::BIGINT AS n, coalesce(t[1], '') AS first FROM t")
def _(t):
    return t.read("documents").select("doc_id", text.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first"))


@query("r02_inverted_index", f"WITH {_TOK} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY 1")
def _(t):
    return text.postings(t.read("documents")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("n"))


_QUERIES = [("a", "license version the the"), ("b", "worthless idiot"), ("c", "und nicht die")]


@query(
    "r03_tfidf_search",
    f"""WITH {_TOK}, p AS (SELECT doc_id, term, count(*) AS n, max(len(t)) AS l FROM (SELECT doc_id, t, unnest(t) AS term FROM t) GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT query, unnest(string_split(txt, ' ')) AS term FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _QUERIES)}) v(query, txt)), k AS (SELECT query, term, count(*) AS times FROM q GROUP BY 1, 2),
s AS (SELECT query, doc_id, {r('round(sum(times * n / l * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1)), 9)', 5)} AS score, round(sum(times * n / l * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1)), 9) AS raw FROM k JOIN p ON k.term = p.term JOIN d ON k.term = d.term GROUP BY 1, 2)
SELECT query, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY raw DESC, doc_id) AS rank FROM s) WHERE rank <= 5""",
)
def _(t):
    docs = t.read("documents")
    asked = t.spark.createDataFrame(_QUERIES, "query string, text string")
    return text.search(text.postings(docs), docs.count(), asked, 5).select("query", "doc_id", rounded(F.col("score"), 5).alias("score"), "rank")


@query("r04_context", "SELECT conv_id, string_agg('[' || role || '] ' || substr(text, 1, 500), chr(10) ORDER BY turn, role, text) AS context FROM conversations GROUP BY 1")
def _(t):
    line = F.concat(F.lit("["), "role", F.lit("] "), F.substring("text", 1, 500))
    g = t.read("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("l"))
    return g.select("conv_id", F.array_join("l.line", "\n").alias("context"))


@query("r07_composite_score", f"WITH w AS (SELECT * FROM (VALUES ('user', 0.25), ('assistant', 0.30), ('system', 0.20)) v(role, weight)), s AS (SELECT conv_id, role, avg(length(text)) AS s FROM conversations GROUP BY 1, 2) SELECT conv_id, {r('sum(s * weight) / sum(weight)')} AS score FROM s JOIN w ON s.role = w.role GROUP BY 1")
def _(t):
    w = t.spark.createDataFrame([("user", 0.25), ("assistant", 0.30), ("system", 0.20)], "role string, weight double")
    s = t.read("conversations").groupBy("conv_id", "role").agg(F.avg(F.length("text")).alias("s")).join(F.broadcast(w), "role")
    return s.groupBy("conv_id").agg(rounded(F.sum(F.col("s") * F.col("weight")) / F.sum("weight")).alias("score"))


@query("r08_agent_outputs", "SELECT event_id, greatest(least(value / 100, 1), -1) AS signal, greatest(least(abs(value) / 50, 1), 0) AS confidence FROM events")
def _(t):
    """Signals and confidences parsed from stored JSON answers and clamped to their ranges."""
    answer = F.to_json(F.struct((F.col("value") / 100).alias("signal"), (F.abs("value") / 50).alias("confidence")))
    p = t.read("events").select("event_id", F.from_json(answer, "signal double, confidence double").alias("a"))
    return p.select("event_id", F.greatest(F.least("a.signal", F.lit(1.0)), F.lit(-1.0)).alias("signal"), F.greatest(F.least("a.confidence", F.lit(1.0)), F.lit(0.0)).alias("confidence"))


@query("r09_market_tool", "SELECT code, max(trade_date) AS last, arg_max(close, trade_date) AS close, count(*) AS bars FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS k FROM bars) WHERE k <= 60 GROUP BY 1")
def _(t):
    k = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("trade_date")))
    return t.bars.withColumn("k", k).where("k <= 60").groupBy("code").agg(F.max("trade_date").alias("last"), F.max_by("close", "trade_date").alias("close"), F.count("*").alias("bars"))


@query("s06_tumbling_window", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return t.read("events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("s06_session_window", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def _(t):
    w = F.session_window(F.col("ts").cast("timestamp"), "6 hours")
    return t.read("events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("s04_incremental_dates", "SELECT DISTINCT trade_date FROM bars WHERE trade_date > (SELECT max(trade_date) FROM bars WHERE trade_date < DATE '2001-06-01')")
def _(t):
    """Dates past the high-water mark of what is stored."""
    mark = t.bars.where(F.col("trade_date") < F.lit("2001-06-01").cast("date")).agg(F.max("trade_date").alias("mark"))
    return t.bars.select("trade_date").distinct().join(F.broadcast(mark), F.col("trade_date") > F.col("mark")).select("trade_date")
