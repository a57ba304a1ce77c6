"""Training of a two-layer graph network by reverse-mode gradients over the edge table.

Scores are Â relu(Â X W1 + b1) w2 + b2 with a symmetric Â as an edge table. Â X never changes, and the second layer has
one output, so that only one number a node travels along the edges: u = relu(...) w2 on the way there and the gradient of
the scores on the way back, both through the same table, which stays partitioned by its source, or, on rings of neighbours,
by windows over the nodes. Gradients of the small matrices are summed by partition first; the driver holds weights and
losses only, and steps by Adam.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.operators.graph import linked, normalized, normalized_along, propagate


@dataclass(frozen=True)
class Network:
    """Weights by name: w1 (features by hidden), b1, w2 (hidden), b2 (one)."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @staticmethod
    def start(features: int, hidden: int, seed: int = 42) -> "Network":
        """Uniform weights within the root of six over the sum of a matrix's sides."""
        r = np.random.default_rng(seed)
        draw = lambda *shape: r.uniform(-1, 1, shape) * np.sqrt(6 / (shape[0] + (shape[1] if len(shape) > 1 else 1)))
        return Network(draw(features, hidden), np.zeros(hidden), draw(hidden), np.zeros(1))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.w1, self.b1, self.w2, self.b2)])

    def shaped(self, flat: np.ndarray) -> "Network":
        """Another vector of as many numbers as weights of these shapes."""
        parts = np.split(flat, np.cumsum([x.size for x in (self.w1, self.b1, self.w2)]))
        return replace(self, **{k: p.reshape(getattr(self, k).shape) for k, p in zip(("w1", "b1", "w2", "b2"), parts)})

    def rows(self) -> list[tuple[str, int, int, float]]:
        """name, i, j, w: as a table of weights has them."""
        return [(k, i, j, float(w)) for k in ("w1", "b1", "w2", "b2") for i, line in enumerate(np.atleast_2d(getattr(self, k))) for j, w in enumerate(line)]


def _hidden(net: Network):
    """What a node with propagated features sends to its neighbours."""

    @F.pandas_udf("double")
    def hidden(p: pd.Series) -> pd.Series:
        x = np.stack(p.to_numpy()) if len(p) else np.zeros((0, len(net.w1)))
        return pd.Series(np.maximum(x @ net.w1 + net.b1, 0) @ net.w2)

    return hidden


@dataclass
class Adam:
    """Steps of Adam with decoupled moments; decay adds that share of the weights to their gradient."""

    rate: float = 0.005
    decay: float = 1e-4
    first: float = 0.9
    second: float = 0.999
    steps: int = 0
    m: np.ndarray = field(default_factory=lambda: np.zeros(1))
    v: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        g = gradient + self.decay * weights
        self.steps += 1
        self.m, self.v = self.first * self.m + (1 - self.first) * g, self.second * self.v + (1 - self.second) * g * g
        return weights - self.rate * (self.m / (1 - self.first**self.steps)) / (np.sqrt(self.v / (1 - self.second**self.steps)) + 1e-8)


def hinge(s: np.ndarray, y: np.ndarray, margin: float) -> tuple[np.ndarray, float, int]:
    """Of the sum of max(0, margin - (s_i - s_j)) over pairs with y_i > y_j: the gradient by s, the sum, and the pairs.

    Labels are halved again and again, and pairs across each cut are counted by bisection in the order of scores: n log² n
    steps, none for a pair.
    """
    n, known = len(s), ~np.isnan(y)
    if not known.all():
        g = np.zeros(n)
        g[known], loss, pairs = hinge(s[known], y[known], margin)
        return g, loss, pairs
    level, g, loss = np.unique(y, return_inverse=True)[1], np.zeros(n), 0.0
    sizes = np.bincount(level)
    pairs = int((np.cumsum(sizes) - sizes) @ sizes)
    if not pairs:
        return g, 0.0, 0
    scores, which, times = np.unique(s, return_inverse=True, return_counts=True)
    ends, last = np.concatenate([[0], np.cumsum(times)]), len(scores) - 1
    # the first score that is open below each score, and the first that is no more open above it, to the last bit
    low, high = np.searchsorted(scores, scores - margin, "right"), np.searchsorted(scores, scores + margin)
    for first, is_open in ((low, lambda k: margin - (scores - scores[k]) > 0), (high, lambda k: ~(margin - (scores[k] - scores) > 0))):
        while (back := (first > 0) & is_open(np.maximum(first - 1, 0))).any():
            first -= back
        while (on := (first <= last) & ~is_open(np.minimum(first, last))).any():
            first += on
    low, high = ends[low][which], ends[high][which]
    place, order = np.empty(n, np.int64), np.argsort(s, kind="stable")
    place[order] = np.arange(n)
    centre = float(s.mean())
    sorted_s, wide = s[order] - centre, n + 1
    for k in range(int(len(sizes) - 1).bit_length()):
        block = level >> k
        keys = np.sort(block * wide + place)
        total = np.concatenate([[0.0], np.cumsum(sorted_s[keys % wide])])
        i, j = np.flatnonzero(block & 1), np.flatnonzero(~block & 1)
        start, end = np.searchsorted(keys, (block[i] - 1) * wide + low[i]), np.searchsorted(keys, block[i] * wide)
        g[i] -= end - start
        loss += float(((margin - (s[i] - centre)) * (end - start) + total[end] - total[start]).sum())
        g[j] += np.searchsorted(keys, (block[j] + 1) * wide + high[j]) - np.searchsorted(keys, (block[j] + 1) * wide)
    return g, loss, pairs


class Problem:
    """The tables that every step reads, kept until close(): edges by source, and nodes with their propagated features.

    edges: src, dst (of an undirected graph, either way); nodes: id, features, label, grp (rows that are ranked against
    one another, as a date's), part ("train", "valid" or another). Nodes without an edge or a label take no part in the
    loss.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame, size: int) -> None:
        a = normalized(edges)
        self.edges = a.repartition("src").persist()
        mixed = propagate(a, nodes.select("id", "features"), size)
        self.nodes = mixed.withColumnRenamed("features", "p").join(nodes.select("id", "label", "grp", "part"), "id").repartition("id").persist()
        self._count_groups()

    def _count_groups(self) -> None:
        known = self.nodes.where("label IS NOT NULL").groupBy("part", "grp").agg((F.min("label") < F.max("label")).alias("ranked")).where("ranked")
        self.groups = {r.part: r.n for r in known.groupBy("part").agg(F.count("*").alias("n")).collect()}

    def close(self) -> None:
        self.edges.unpersist()
        self.nodes.unpersist()

    def _along(self, values: DataFrame) -> DataFrame:
        """id, x: the weighted sums of the values (id, x) of each node's neighbours."""
        met = self.edges.join(values, self.edges["src"] == values["id"]).select("dst", (F.col("weight") * F.col("x")).alias("x"))
        return met.groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("x"))

    def scores(self, net: Network) -> DataFrame:
        """id, score."""
        return self._along(self.nodes.select("id", _hidden(net)("p").alias("x"))).select("id", (F.col("x") + float(net.b2[0])).alias("score"))

    def graded(self, net: Network, margin: float) -> DataFrame:
        """id, part, x (the gradient of the part's mean loss by the score), loss (the group's share, in one row of it).

        A group's loss is the mean of max(0, margin - (score_i - score_j)) over its pairs with label_i > label_j, and a
        part's the mean over its groups. A task holds one group's scores.
        """
        rows = self.nodes.where("label IS NOT NULL").select("id", "label", "grp", "part").join(self.scores(net), "id")
        return self._graded(rows, ["id"], margin)

    def _graded(self, rows: DataFrame, keep: list[str], margin: float) -> DataFrame:
        groups = dict(self.groups)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            part = pdf.part.iloc[0]
            g, loss, pairs = hinge(pdf.score.to_numpy(), pdf.label.to_numpy(float), margin)
            scale = 1 / (pairs * groups[part]) if pairs else 0.0
            return pdf[keep].assign(part=part, x=g * scale, loss=[loss * scale] + [0.0] * (len(g) - 1))

        kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]
        return rows.groupBy("part", "grp").applyInPandas(run, ", ".join(kinds) + ", part string, x double, loss double")

    def loss_and_gradient(self, net: Network, margin: float = 0.02) -> tuple[dict[str, float], Network]:
        """Mean losses by part, and the gradient of the train part's."""
        graded = self.graded(net, margin).persist()
        sums = {r.part: r for r in graded.groupBy("part").agg(F.sum("loss").alias("loss"), F.sum("x").alias("x")).collect()}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(net.flat().size)
            for b in batches:
                if len(b):
                    p, g = np.stack(b.p.to_numpy()), b.x.to_numpy()
                    z = p @ net.w1 + net.b1
                    d = (z > 0) * g[:, None] * net.w2
                    total += np.concatenate([(p.T @ d).ravel(), d.sum(0), np.maximum(z, 0).T @ g, [0.0]])
            yield pd.DataFrame({"k": np.arange(len(total)), "x": total})

        flat = np.zeros(net.flat().size)
        for r in self._back(graded.where("part = 'train'")).mapInPandas(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
            flat[r.k] = r.x
        flat[-1] = sums["train"].x if "train" in sums else 0.0
        graded.unpersist()
        return {k: r.loss for k, r in sums.items()}, net.shaped(flat)

    def _back(self, graded: DataFrame) -> DataFrame:
        """p, x: propagated features, and the gradient by what each node sends along the edges."""
        return self.nodes.select("id", "p").join(self._along(graded.select("id", "x")), "id").select("p", "x")


class RingProblem(Problem):
    """A Problem on rings of neighbours (graph.rings): nodes: id, ring, at, turn, features, label, grp, part.

    Nodes are kept by group, in whose task windows along the rings take all sums; no edge becomes a row.
    """

    def __init__(self, nodes: DataFrame, size: int, most: int = 20) -> None:
        self.most, self.names = most, [f"p{i}" for i in range(size)]
        wide = nodes.repartition("grp").select("id", "grp", "ring", "at", "turn", "label", "part", *[F.col("features")[i].alias(c) for i, c in enumerate(self.names)])
        self.nodes = normalized_along(linked(wide, "grp", most), self.names, "grp", most).persist()
        self._count_groups()

    def close(self) -> None:
        self.nodes.unpersist()

    def scores(self, net: Network) -> DataFrame:
        """The nodes and their score."""
        sent = self.nodes.withColumn("score", _hidden(net)(F.array(*self.names)))
        return normalized_along(sent, ["score"], "grp", self.most).withColumn("score", F.col("score") + float(net.b2[0]))

    def graded(self, net: Network, margin: float) -> DataFrame:
        """As a Problem's, with rows for nodes without a label too, which pass on the gradient of others."""
        return self._graded(self.scores(net), ["id", "grp", "ring", "at", "turn", "scale", *self.names], margin)

    def _back(self, graded: DataFrame) -> DataFrame:
        return normalized_along(graded, ["x"], "grp", self.most).select(F.array(*self.names).alias("p"), "x")


def fit(problem: Problem, net: Network, epochs: int = 100, patience: int = 20, margin: float = 0.02, adam: Adam | None = None) -> tuple[Network, list[tuple[int, float, float]]]:
    """The weights of the lowest validation loss, and epoch, train and validation loss of each epoch.

    An epoch is one step over all training groups. Training ends when `patience` epochs in a row have not lowered the
    validation loss by 1e-6; where no group is for validation, the train loss serves.
    """
    adam, best, kept, waited, history = adam or Adam(), float("inf"), net, 0, []
    for epoch in range(1, epochs + 1):
        losses, gradient = problem.loss_and_gradient(net, margin)
        train = losses.get("train", 0.0)
        valid = losses.get("valid", train)
        history.append((epoch, train, valid))
        if valid < best - 1e-6:
            best, kept, waited = valid, net, 0
        else:
            waited += 1
            if waited >= patience:
                break
        net = net.shaped(adam.step(net.flat(), gradient.flat()))
    return kept, history
