"""Queries of models: weights as tables, attention heads, gradients and training of the graph network."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from alphaloom.functions.scalar import rounded
from alphaloom.operators import graph
from alphaloom.operators import graph_training as training
from alphaloom.plans.graph_text import _GRAPH, _KNN, _peers, _weights, _whole
from alphaloom.plans.inference import _HORIZONS, _PRICES, _W1, _ZS
from alphaloom.plans.registry import query, r
from alphaloom.session import new_dir
from alphaloom.sources.models import read_model, write_model

HEADS, WIDTH = 4, 3


def _stored(t, columns: dict[str, tuple[int, int, str]]) -> tuple[str, dict[str, tuple[int, int]]]:
    """A model table in the shared folder; columns: rows, columns and the expression of an entry (i, j) by name."""
    parts = [t.spark.range(n * m).select(F.lit(name).alias("name"), F.expr(f"int(id div {m})").alias("i"), F.expr(f"int(id % {m})").alias("j")).withColumn("w", F.expr(e)) for name, (n, m, e) in columns.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    path = new_dir(t.spark, "model")
    write_model(rows.coalesce(1), path)
    return path, {name: (n, m) for name, (n, m, _) in columns.items()}


@query("a27_model_scores", f"WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(generate_series(0, len(embedding) - 1)) AS i FROM embeddings) SELECT vec_id, {r('sum(x * (i % 7 / 7.0 - 0.4))')} AS score FROM v GROUP BY 1")
def _(t):
    """Scores of every row by a linear model that is read from its table of weights."""
    x = t.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    n = x.agg(F.max(F.size("features"))).first()[0] or 0
    path, shapes = _stored(t, {"w": (n, 1, "i % 7 / 7.0D - 0.4D")})
    w = read_model(t.spark, path, shapes)["w"]
    out = graph.dense(x.withColumnRenamed("vec_id", "id"), w, np.zeros(1))
    return out.select(F.col("id").alias("vec_id"), rounded(F.col("features")[0]).alias("score"))


_HEAD = "(((i) * 3 + j + k * 5) % 7 / 7.0 - 0.4)"


@query(
    "q05_gat_heads",
    f"""WITH {_GRAPH}, l AS (SELECT id, k, j, sum(v * {_HEAD}) AS h FROM v, generate_series(0, {WIDTH - 1}) s(j), generate_series(0, {HEADS - 1}) t(k) GROUP BY 1, 2, 3),
h AS (SELECT id, k, list(h ORDER BY j) AS h, sum(h * ((j + k) % 5 / 5.0 - 0.3)) AS a, sum(h * ((j * 2 + k) % 5 / 5.0 - 0.2)) AS b FROM l GROUP BY 1, 2),
z AS (SELECT g.src, y.k, y.h, CASE WHEN x.a + y.b > 0 THEN x.a + y.b ELSE 0.2 * (x.a + y.b) END AS z FROM g JOIN h x ON g.src = x.id JOIN h y ON g.dst = y.id AND x.k = y.k),
m AS (SELECT src AS id, k, [{', '.join(f'sum(exp(z) * h[{c + 1}]) / sum(exp(z))' for c in range(WIDTH))}] AS h FROM z GROUP BY 1, 2),
o AS (SELECT h.id, h.k, coalesce(m.h, h.h) AS h FROM h LEFT JOIN m ON h.id = m.id AND h.k = m.k),
f AS (SELECT id, k * {WIDTH} + c AS i, h[c + 1] AS v FROM o, generate_series(0, {WIDTH - 1}) s(c))
SELECT id, {r('sum(v * (i * 3 % 7 / 7.0 - 0.4))')} AS score FROM f GROUP BY 1""",
)
def _(t):
    """Four attention heads and an output matrix, read from a table of weights, over every row and feature."""
    e, x, n = _whole(t)
    columns = {f"w{k}": (n, WIDTH, f"(i * 3 + j + {k * 5}) % 7 / 7.0D - 0.4D") for k in range(HEADS)}
    columns |= {f"left{k}": (WIDTH, 1, f"(i + {k}) % 5 / 5.0D - 0.3D") for k in range(HEADS)} | {f"right{k}": (WIDTH, 1, f"(i * 2 + {k}) % 5 / 5.0D - 0.2D") for k in range(HEADS)}
    m = read_model(t.spark, *_stored(t, columns | {"out": (HEADS * WIDTH, 1, "i * 3 % 7 / 7.0D - 0.4D")}))
    out = graph.gat_heads(e, x, [(m[f"w{k}"], m[f"left{k}"].ravel(), m[f"right{k}"].ravel()) for k in range(HEADS)], m["out"])
    return out.select("id", rounded(F.col("features")[0]).alias("score"))


_MARGIN = 0.02


def _problem(t):
    """The graph within industries for each month, and nodes (month, code): momentum of three horizons, next month's return
    as label; the first six tenths of the months to train on, the others to validate."""
    w, by = Window.partitionBy("code").orderBy("trade_date"), Window.partitionBy("trade_date")
    x = t.monthly.select("trade_date", "code", *[F.round(F.col("close") / F.lag("close", n).over(w) - 1, 9).alias(f"x{i}") for i, n in enumerate(_HORIZONS)], F.round(F.lead("close").over(w) / F.col("close") - 1, 9).alias("label"))
    x = x.dropna(subset=[f"x{i}" for i in range(3)])
    sd = lambda i: F.stddev_pop(f"x{i}").over(by)
    z = F.array(*[(F.col(f"x{i}") - F.avg(f"x{i}").over(by)) / F.when(sd(i) == 0, 1.0).otherwise(sd(i)) for i in range(3)])
    months = x.select("trade_date").distinct()
    months = months.select("trade_date", F.when(F.percent_rank().over(Window.partitionBy(F.lit(1)).orderBy("trade_date")) < 0.6, "train").otherwise("valid").alias("part"))
    rings = graph.rings(t.industry, "sector", 20)
    if graph.share_codes(rings):
        nodes = x.select("trade_date", "code", z.alias("features"), "label").join(months, "trade_date")
        both, here = graph.symmetric(graph.sampled_peers(t.industry, "sector", 20)), nodes.select("trade_date", "code")
        dated = both.join(here.withColumnRenamed("code", "src"), "src").join(here.withColumnRenamed("code", "dst"), ["trade_date", "dst"])
        node = lambda c: F.struct("trade_date", F.col(c).alias("code"))
        return training.Problem(dated.select(node("src").alias("src"), node("dst").alias("dst")), nodes.select(node("code").alias("id"), "features", "label", F.col("trade_date").alias("grp"), "part"), 3)
    # a code without an industry counts in a month's mean, and has no place
    placed = x.join(rings, "code", "left").select("trade_date", "code", "label", "ring", "at", "turn", z.alias("features")).where("ring IS NOT NULL")
    nodes = placed.join(F.broadcast(months), "trade_date")
    return training.RingProblem(nodes.select(F.col("code").alias("id"), "ring", "at", "turn", "features", "label", F.col("trade_date").alias("grp"), "part"), 3)


@query(
    "q07_graph_gradient",
    f"""WITH y AS (SELECT trade_date, code, {_PRICES}, round(lead(close) OVER (PARTITION BY code ORDER BY trade_date) / close - 1, 9) AS label FROM monthly), n AS (SELECT * FROM y WHERE x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL), z AS (SELECT trade_date, code, label, {_ZS} FROM n), {_peers(20)},
s AS (SELECT src, dst FROM peers UNION SELECT dst, src FROM peers), e AS (SELECT a.trade_date, src, dst FROM s JOIN z a ON a.code = src JOIN z b ON b.code = dst AND a.trade_date = b.trade_date), d AS (SELECT trade_date, src, count(*)::DOUBLE AS d FROM e GROUP BY 1, 2),
w AS (SELECT e.trade_date, e.src, e.dst, 1 / sqrt(a.d * b.d) AS w FROM e JOIN d a ON e.trade_date = a.trade_date AND e.src = a.src JOIN d b ON e.trade_date = b.trade_date AND e.dst = b.src),
v AS (SELECT trade_date, code, i, CASE i WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END AS v FROM z, generate_series(0, 2) g(i)), q AS (SELECT w.trade_date, dst AS code, i, sum(w * v) AS v FROM w JOIN v ON v.trade_date = w.trade_date AND v.code = src GROUP BY 1, 2, 3),
h AS (SELECT trade_date, code, j, sum(v * {_W1}) + 0.1 AS z FROM q, generate_series(0, 2) g(j) GROUP BY 1, 2, 3), u AS (SELECT trade_date, code, sum(greatest(z, 0) * (j % 7 / 7.0 - 0.4)) AS u FROM h GROUP BY 1, 2),
c AS (SELECT w.trade_date, dst AS code, sum(w * u) AS s FROM w JOIN u ON u.trade_date = w.trade_date AND u.code = src GROUP BY 1, 2),
m AS (SELECT trade_date, percent_rank() OVER (ORDER BY trade_date) AS q FROM (SELECT DISTINCT trade_date FROM z)),
t AS (SELECT c.trade_date, c.code, s, label FROM c JOIN z ON c.trade_date = z.trade_date AND c.code = z.code JOIN m ON m.trade_date = c.trade_date WHERE label IS NOT NULL AND q < 0.6),
k AS (SELECT a.trade_date, a.code AS a, b.code AS b, {_MARGIN} - (a.s - b.s) AS short FROM t a JOIN t b ON a.trade_date = b.trade_date AND a.label > b.label),
f AS (SELECT trade_date, count(*)::DOUBLE AS pairs, sum(greatest(short, 0)) / count(*) AS loss FROM k GROUP BY 1), x AS (SELECT *, count(*) OVER () AS groups FROM f),
o AS (SELECT trade_date, a AS code, -1.0 AS x FROM k WHERE short > 0 UNION ALL SELECT trade_date, b, 1.0 FROM k WHERE short > 0), g AS (SELECT o.trade_date, code, sum(x) / max(pairs * groups) AS x FROM o JOIN x ON o.trade_date = x.trade_date GROUP BY 1, 2),
b AS (SELECT w.trade_date, w.src AS code, sum(w * x) AS g FROM w JOIN g ON g.trade_date = w.trade_date AND g.code = w.dst GROUP BY 1, 2),
rr AS (SELECT 'w1' AS name, i::INTEGER AS i, j::INTEGER AS j, {r('sum(v * CASE WHEN h.z > 0 THEN g * (j % 7 / 7.0 - 0.4) ELSE 0 END)', 8)} AS gradient FROM q JOIN h ON q.trade_date = h.trade_date AND q.code = h.code JOIN b ON b.trade_date = q.trade_date AND b.code = q.code GROUP BY ALL
UNION ALL SELECT 'b1', 0, j::INTEGER, {r('sum(CASE WHEN h.z > 0 THEN g * (j % 7 / 7.0 - 0.4) ELSE 0 END)', 8)} FROM h JOIN b ON b.trade_date = h.trade_date AND b.code = h.code GROUP BY ALL
UNION ALL SELECT 'w2', 0, j::INTEGER, {r('sum(greatest(h.z, 0) * g)', 8)} FROM h JOIN b ON b.trade_date = h.trade_date AND b.code = h.code GROUP BY ALL),
nm AS (SELECT 'w1' AS name, i::INTEGER AS i, j::INTEGER AS j FROM generate_series(0, 2) a(i), generate_series(0, 2) b(j) UNION ALL SELECT name, 0, j FROM (VALUES ('b1'), ('w2')) v(name), generate_series(0, 2) b(j))
SELECT name, i, j, coalesce(gradient, 0.0) AS gradient FROM nm LEFT JOIN rr USING (name, i, j) UNION ALL SELECT 'b2', 0, 0, 0.0::DOUBLE UNION ALL SELECT 'loss', 0, 0, {r('avg(loss)', 8)} FROM f""",
)
def _(t):
    """The loss and its gradient by every weight, for a network of given weights over all training months."""
    net = training.Network(_weights(3, 3), np.full(3, 0.1), _weights(3), np.zeros(1))
    problem = _problem(t)
    losses, gradient = problem.loss_and_gradient(net, _MARGIN)
    problem.close()
    rows = gradient.rows() + [("loss", 0, 0, losses.get("train"))]
    return t.spark.createDataFrame(rows, "name string, i int, j int, w double").select("name", "i", "j", rounded(F.col("w"), 8).alias("gradient"))


@query("q07_graph_training", None)
def _(t):
    """Losses by epoch of a network trained on the months before, validated on the later ones; `kept` marks the epoch whose
    weights stay. Eight epochs at most, a fixed number."""
    problem = _problem(t)
    _, history = training.fit(problem, training.Network.start(3, 8), epochs=8, patience=4, margin=_MARGIN, adam=training.Adam(rate=0.05))
    problem.close()
    best = min(history, key=lambda h: h[2])[0] if history else 0
    return t.spark.createDataFrame([(*h, h[0] == best) for h in history], "epoch int, train_loss double, valid_loss double, kept boolean")
