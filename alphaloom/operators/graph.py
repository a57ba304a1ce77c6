"""Graphs as edge tables: construction, normalisation, dense layers on joined features, and measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(x: np.ndarray, ids: np.ndarray, y: np.ndarray, own: np.ndarray, k: int, held: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """own, id, distance: of each row of y the k nearest rows of x, by distance and id; rows of its own id do not count.

    A product of matrices bounds all distances, to within a bound of its rounding; those that can be among the k are taken
    again from differences. Some `held` distances are in memory at a time.
    """
    middle, far = x.mean(0), 8 * (x.shape[1] + 8) * np.finfo(float).eps
    cx, cy = x - middle, y - middle
    nx, ny, met = (cx * cx).sum(1), (cy * cy).sum(1), np.isin(own, ids)
    out = []
    for i in range(0, len(y), max(1, held // len(x))):
        of = slice(i, i + max(1, held // len(x)))
        d = cy[of] @ cx.T
        d *= -2
        d += nx
        d += ny[of, None]
        same, where = np.nonzero(own[of, None] == ids) if met[of].any() else ((), ())
        d[same, where] = np.inf
        # the k-th of the least ones of columns dealt into groups is no less than the k-th of all
        groups = max(1, len(x) // max(4 * k, 256))
        whole = len(x) // groups * groups
        least = np.concatenate([d[:, :whole].reshape(len(d), groups, -1).min(1), d[:, whole:]], axis=1)
        last = np.partition(least, k - 1, axis=1)[:, k - 1] if least.shape[1] > k else np.full(len(d), np.inf)
        row, at = np.divmod(np.flatnonzero(~(d > (last + 2 * far * (nx.max() + ny[of]))[:, None])), len(x))
        row += i
        exact = np.concatenate([np.sqrt(((x[at[j : j + 65_536]] - y[row[j : j + 65_536]]) ** 2).sum(1)) for j in range(0, len(at), 65_536)] or [np.zeros(0)])
        kept = (own[row] != ids[at]) & (exact < np.inf)
        row, at, exact = row[kept], at[kept], exact[kept]
        order = np.lexsort((ids[at], exact, row))
        row, at, exact = row[order], at[order], exact[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((own[row[first]], ids[at[first]], exact[first]))
    return tuple(np.concatenate(c) for c in zip(*out))


def knn_edges(rows: DataFrame, k: int = 10, block: int = 32_768) -> DataFrame:
    """src, dst, distance: the k nearest of each row (id, features array), by Euclid, ties to the smaller id.

    Rows meet in blocks: each block of queries is compared with each block of rows, some queries at a time, and keeps
    its k best, which are merged by rank. Few rows make up to eight blocks, so that every core has its share.
    """
    n = rows.count()
    blocks = max(1, -(-n // block), min(8, -(-n // 1024)))
    keyed = rows.select("id", F.col("features").cast("array<double>").alias("features"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    data = keyed.select("id", "features", "b", other.alias("q"))
    asked = keyed.select(F.col("id").alias("own"), F.col("features").alias("asked"), F.col("b").alias("of"), other.alias("at"))

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(left) and len(right):
            x, y = np.stack(left.features), np.stack(right.asked)
            # a row that is not finite is at no finite distance
            u, v = np.isfinite(x).all(1), np.isfinite(y).all(1)
            if u.any() and v.any():
                found = nearest(x[u], left.id.to_numpy()[u], y[v], right.own.to_numpy()[v], k)
        return pd.DataFrame(dict(zip(("src", "dst", "distance"), found)))

    found = data.groupBy("b", "q").cogroup(asked.groupBy("at", "of")).applyInPandas(near, "src long, dst long, distance double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
    return found.withColumn("k", rank).where(F.col("k") <= k).drop("k")


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """id, features: the named columns, each less its mean and over its population deviation."""
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[(F.stddev_pop(c) + 1e-12).alias(f"s_{c}") for c in columns]).first()
    return rows.select("id", F.array(*[(F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"]) for c in columns]).alias("features"))


def similarity_graph(rows: DataFrame, columns: list[str], groups: DataFrame, k: int = 10, peers: int = 5) -> DataFrame:
    """src, dst: of each row (id and columns) the k nearest in standardised columns, made symmetric, and up to `peers`
    others of its group (groups: code, sector), each edge once."""
    near = knn_edges(standardised(rows, columns), k).select("src", "dst")
    return symmetric(near).union(sampled_peers(groups, "sector", peers)).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()


def normalized(edges: DataFrame, loops: bool = False) -> DataFrame:
    """src, dst, weight of D^-1/2 A D^-1/2 over symmetric edges."""
    both = symmetric(edges)
    if loops:
        nodes = both.select("src").distinct()
        both = both.union(nodes.select("src", F.col("src").alias("dst")))
    degree = both.groupBy("src").agg(F.count("*").cast("double").alias("d"))
    a = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    return a.select("src", "dst", (1 / F.sqrt(F.col("d") * F.col("e"))).alias("weight"))


def sampled_peers(rows: DataFrame, group: str, most: int = 20) -> DataFrame:
    """src, dst: in each group all pairs if it has at most most + 1 members, else `most` peers each.

    Peers are the next ones in the order of hashed ids, round the circle: repeatable, and with `most` the reference's own
    number of drawn peers, which keeps the edges of a large group in proportion to its members.
    """
    w = Window.partitionBy(group)
    placed = rows.select(group, "code").distinct().withColumns({"p": F.row_number().over(w.orderBy(F.md5(F.col("code").cast("string")), "code")) - 1, "n": F.count("*").over(w)})
    steps = placed.withColumn("step", F.explode(F.when(F.col("n") > 1, F.sequence(F.lit(1), F.least(F.col("n") - 1, F.lit(most)).cast("int"))).otherwise(F.array().cast("array<int>"))))
    a = steps.select(group, F.col("code").alias("src"), F.pmod(F.col("p") + F.col("step"), F.col("n")).alias("at"))
    b = placed.select(F.col(group).alias("_g"), F.col("code").alias("dst"), F.col("p").alias("q"))
    return a.join(b, (F.col(group) == F.col("_g")) & (F.col("at") == F.col("q"))).select("src", "dst")


def rings(rows: DataFrame, group: str, most: int = 20) -> DataFrame:
    """code, ring, at, turn: the graph of symmetric(sampled_peers(...)) as places, for along_rings; a code has one group.

    Two codes of a ring are linked if their places are at most 2 * most apart: places are even in a large group, which is
    closed after `turn`, and follow one another in a group so small that all its members are linked (turn 0).
    """
    w = Window.partitionBy(group)
    p, n = F.row_number().over(w.orderBy(F.md5(F.col("code").cast("string")), "code")).cast("long") - 1, F.count("*").over(w)
    large = F.col("n") > 2 * most + 1
    placed = rows.where(F.col(group).isNotNull()).select(group, "code").distinct().withColumns({"p": p, "n": n})
    return placed.select("code", F.col(group).alias("ring"), F.when(large, 2 * F.col("p")).otherwise(F.col("p")).alias("at"), F.when(large, 2 * F.col("n")).otherwise(F.lit(0)).alias("turn"))


def share_codes(rings: DataFrame) -> bool:
    """Whether a code lies on more than one ring."""
    return not rings.groupBy("code").count().where("count > 1").isEmpty()


def along_rings(nodes: DataFrame, columns: list[str], within: str, most: int = 20) -> DataFrame:
    """nodes (with ring, at, turn) whose columns are summed over each node's neighbours that have the same `within`.

    Neighbours lie within a range of places, so that windows take the sums and no edge becomes a row; the first and last
    places of a closed ring are shown at either end.
    """
    at, turn = F.col("at"), F.col("turn")
    places = F.when(turn == 0, F.array(at)).when(at < 2 * most, F.array(at, at + turn)).when(at >= turn - 2 * most, F.array(at, at - turn)).otherwise(F.array(at))
    w = Window.partitionBy(within, "ring").orderBy("_place")
    sums = {c: sum(F.coalesce(F.sum(c).over(f), F.lit(0.0)) for f in (w.rangeBetween(-2 * most, -1), w.rangeBetween(1, 2 * most))) for c in columns}
    return nodes.withColumn("_place", F.explode(places)).withColumns(sums).where("_place = at").drop("_place")


def linked(nodes: DataFrame, within: str, most: int = 20) -> DataFrame:
    """nodes with neighbours, and `scale`, the root of the inverse of their number: D^-1/2."""
    return along_rings(nodes.withColumn("scale", F.lit(1.0)), ["scale"], within, most).where("scale > 0").withColumn("scale", 1 / F.sqrt("scale"))


def normalized_along(nodes: DataFrame, columns: list[str], within: str, most: int = 20) -> DataFrame:
    """The columns of linked nodes times D^-1/2 A D^-1/2."""
    out = along_rings(nodes.withColumns({c: F.col(c) * F.col("scale") for c in columns}), columns, within, most)
    return out.withColumns({c: F.col(c) * F.col("scale") for c in columns})


def propagate(weights: DataFrame, features: DataFrame, size: int) -> DataFrame:
    """id, features: for each dst the weighted sum of the features of its sources."""
    j = weights.join(features.select(F.col("id").alias("src"), F.posexplode("features").alias("i", "x")), "src")
    s = j.groupBy("dst", "i").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    filled = s.groupBy(F.col("dst").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    return filled.select("id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0))).alias("features"))


def dense(features: DataFrame, w: np.ndarray, b: np.ndarray, relu: bool = False) -> DataFrame:
    """features times w plus b; w is a model's matrix, of fixed size."""
    columns = [F.lit([float(v) for v in w[:, k]]) for k in range(w.shape[1])]
    dot = [F.aggregate(F.zip_with("features", c, lambda x, y: x * y), F.lit(float(b[k])), lambda a, v: a + v) for k, c in enumerate(columns)]
    return features.select("id", F.array(*[F.greatest(d, F.lit(0.0)) if relu else d for d in dot]).alias("features"))


def gcn(edges: DataFrame, features: DataFrame, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray) -> DataFrame:
    """Two layers: Â relu(Â X W1 + b1) W2 + b2."""
    a = normalized(edges)
    hidden = dense(propagate(a, features, w1.shape[0]), w1, b1, relu=True)
    return dense(propagate(a, hidden, w2.shape[0]), w2, b2)


def gcn_along(nodes: DataFrame, columns: list[str], within: str, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float, most: int = 20) -> DataFrame:
    """linked nodes and their score: gcn over rings, of one output, so that the second layer sends one number a node."""
    mixed = normalized_along(nodes, columns, within, most)
    hidden = [F.greatest(sum(float(v) * F.col(c) for v, c in zip(w1[:, k], columns)) + float(b1[k]), F.lit(0.0)) for k in range(w1.shape[1])]
    sent = mixed.withColumn("score", sum(float(v) * h for v, h in zip(w2, hidden)))
    return normalized_along(sent, ["score"], within, most).withColumn("score", F.col("score") + b2)


def gat(edges: DataFrame, features: DataFrame, w: np.ndarray, a_src: np.ndarray, a_dst: np.ndarray, slope: float = 0.2) -> DataFrame:
    """One attention head: softmax over neighbours of leaky a_src·h + a_dst·h; an isolated node keeps its own h."""
    h = dense(features, w, np.zeros(w.shape[1]))
    score = lambda v: F.aggregate(F.zip_with("features", F.lit([float(x) for x in v]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = h.select("id", "features", score(a_src).alias("s"), score(a_dst).alias("d"))
    e = symmetric(edges).join(scored.select(F.col("id").alias("src"), "s"), "src").join(scored.select(F.col("id").alias("dst"), "d"), "dst")
    z = F.col("s") + F.col("d")
    e = e.withColumn("z", F.when(z > 0, z).otherwise(slope * z))
    by = Window.partitionBy("dst")
    e = e.withColumn("x", F.exp(F.col("z") - F.max("z").over(by)))
    weights = e.select("src", "dst", (F.col("x") / F.sum("x").over(by)).alias("weight"))
    out = propagate(weights, h, w.shape[1])
    return h.join(out.withColumnRenamed("features", "mixed"), "id", "left").select("id", F.coalesce("mixed", "features").alias("features"))


def gat_heads(edges: DataFrame, features: DataFrame, heads: list[tuple[np.ndarray, np.ndarray, np.ndarray]], out: np.ndarray, slope: float = 0.2) -> DataFrame:
    """Several attention heads side by side, then the matrix `out`: id, features.

    heads: a matrix and two vectors for each, of a model's fixed size. Node i gives its neighbour j the weight of
    exp(leaky(left·h_i + right·h_j)) among its neighbours' weights, per head; a node without neighbours keeps its own h.
    Heads are exploded, so that all go through one join of the edges and one grouping by node and head.
    """
    width, count = heads[0][0].shape[1], len(heads)

    @F.pandas_udf("array<struct<head:int,h:array<double>,left:double,right:double>>")
    def by_head(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(heads[0][0])))
        parts = [(m @ w, (m @ w) @ a, (m @ w) @ b) for w, a, b in heads]
        return pd.Series([[{"head": k, "h": h[i], "left": float(a[i]), "right": float(b[i])} for k, (h, a, b) in enumerate(parts)] for i in range(len(m))])

    h = features.select("id", F.explode(by_head(F.col("features").cast("array<double>"))).alias("x")).select("id", "x.*")
    met = symmetric(edges).join(h.select(F.col("id").alias("dst"), F.col("h"), F.col("head"), "right"), "dst").join(h.select(F.col("id").alias("src"), "head", "left"), ["src", "head"])
    z = F.col("left") + F.col("right")
    met = met.select("src", "head", "h", F.when(z > 0, z).otherwise(slope * z).alias("z"))
    # the highest score of a node first, so that no exponential is too large
    top = met.groupBy("src", "head").agg(F.max("z").alias("top"))
    e = met.join(top, ["src", "head"]).withColumn("e", F.exp(F.col("z") - F.col("top")))
    mixed = e.groupBy(F.col("src").alias("id"), "head").agg(F.array(*[F.sum(F.col("e") * F.col("h")[k]) / F.sum("e") for k in range(width)]).alias("mixed"))
    own = h.select("id", "head", "h").join(mixed, ["id", "head"], "left").select("id", "head", F.coalesce("mixed", "h").alias("h"))
    side = own.groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("head", "h"))), lambda v: v["h"])).alias("features"))
    return dense(side.where(F.size("features") == width * count), out, np.zeros(out.shape[1]))


def top_k_precision(rows: DataFrame, k: int = 5, true_k: int = 30, date: str = "trade_date") -> DataFrame:
    w = Window.partitionBy(date)
    r = rows.select(date, F.row_number().over(w.orderBy(F.desc("value"), "code")).alias("p"), F.row_number().over(w.orderBy(F.desc("fwd"), "code")).alias("q"))
    return r.where(F.col("p") <= k).groupBy(date).agg((F.sum((F.col("q") <= true_k).cast("int")) / F.lit(float(k))).alias("precision"))


def remove_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges whose endpoints both stay."""
    g = gone.select("code")
    return edges.join(g, edges["src"] == g["code"], "left_anti").join(g, edges["dst"] == g["code"], "left_anti")
