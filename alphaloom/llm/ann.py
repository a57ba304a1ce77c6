"""Approximate nearest neighbours by collision counting.

Vectors are projected on m random directions, each of which makes a sorted array. A query opens a window around its own
projection in every array and counts, for each vector, the arrays in which it lies inside; vectors with enough collisions
are verified by their distance. Virtual rehashing widens all windows step by step, with no second index, until the k
nearest verified vectors lie within the radius that the windows stand for: a vector within it misses the threshold in
about one case of 3,000.

1. Rows go to the nearest of some centres (a bounded sample of rows), and each centre's to blocks of bounded size.
2. A query searches one block of its own centre by virtual rehashing. Its k-th distance bounds what is left to find.
3. At that radius it visits those centres only in whose span of projections its windows reach the threshold, as no
   vector of the others can. There it opens its windows once.

Each row is moved once for the first search. For the second it is moved once for every `BLOCK_QUERIES` queries that visit
its centre: in proportion to rows where vectors lie in groups, and with rows times queries only where no radius parts
them, as then every distance counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm.sample import lowest_share
from alphaloom.llm.shared import Scratch, cut

PROJECTIONS, SHARE, WIDTH, GROWTH = 64, 0.66, 2.719, 1.2
NEED = math.ceil(SHARE * PROJECTIONS)
#: Rows of a block, queries that meet a block at once, and centres of each length of vectors.
BLOCK_ROWS, BLOCK_QUERIES, CENTRES = 4_096, 4_096, 1_024


def directions(dims: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, PROJECTIONS))


class Index:
    """Sorted projections of a block of vectors, and each vector's rank in every one."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors, self.directions = ids, vectors, directions(vectors.shape[1])
        projected = (vectors @ self.directions).T
        order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, order, axis=1)
        self.kind = np.uint16 if len(ids) < 1 << 16 else np.uint32
        self.ranks = np.empty(projected.shape, self.kind)
        np.put_along_axis(self.ranks, order, np.arange(len(ids), dtype=self.kind)[None], axis=1)
        self.start = max(0.05 * float(projected.std()) * math.sqrt(2), 1e-12)

    def windows(self, at: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First rank and number of ranks of each query's window in each array. at: projections of the queries."""
        half = WIDTH * radius[:, None] / 2
        low = np.stack([np.searchsorted(s, at[:, i] - half[:, 0], "left") for i, s in enumerate(self.sorted)], 1)
        high = np.stack([np.searchsorted(s, at[:, i] + half[:, 0], "right") for i, s in enumerate(self.sorted)], 1)
        return low, high - low

    def collisions(self, low: np.ndarray, number: np.ndarray) -> np.ndarray:
        """How many arrays hold each vector inside one query's windows."""
        inside = (self.ranks - low.astype(self.kind)[:, None]) < number.astype(self.kind)[:, None]
        return inside.sum(0, dtype=np.int16)

    def nearest(self, rows: np.ndarray, distance: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k smallest distances, ties to the smaller id; an id that repeats counts once."""
        out, taken = [], set()
        for j in np.lexsort((self.ids[rows], distance)):
            i = int(self.ids[rows[j]])
            if i not in taken:
                taken.add(i)
                out.append((float(distance[j]), i))
                if len(out) == k:
                    break
        return out

    def distances(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.vectors[rows] - query) ** 2).sum(1))

    def search(self, own: int, query: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k nearest found by virtual rehashing; the vector with the query's own id takes no part."""
        at, seen = (query @ self.directions)[None], self.ids == own
        others = len(np.unique(self.ids[~seen]))
        rows, distance, radius = np.zeros(0, np.int64), np.zeros(0), self.start
        while True:
            low, number = self.windows(at, np.array([radius]))
            fresh = np.flatnonzero((self.collisions(low[0], number[0]) >= NEED) & ~seen)
            seen[fresh] = True
            rows, distance = np.concatenate([rows, fresh]), np.concatenate([distance, self.distances(fresh, query)])
            if len(np.unique(self.ids[rows[distance <= radius]])) >= min(k, others) or bool((number == len(self.ids)).all()):
                return self.nearest(rows, distance, k)
            radius *= GROWTH

    def within(self, own: np.ndarray, queries: np.ndarray, radius: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
        """For each query the k nearest found no further than its radius, in windows opened once."""
        low, number = self.windows(queries @ self.directions, radius)
        for q in range(len(own)):
            rows = np.flatnonzero((self.collisions(low[q], number[q]) >= NEED) & (self.ids != own[q]))
            distance = self.distances(rows, queries[q])
            fit = distance <= radius[q]
            yield int(own[q]), self.nearest(rows[fit], distance[fit], k)


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = values.flatten() if hasattr(values, "flatten") else values.chunk(0).flatten()
    return np.asarray(values, np.float64).reshape(rows, -1)


def usable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, vector and dims of rows with an id and a vector that is not null, empty, zero, or with a null or non-finite
    component. Vectors of floats stay so; others become doubles."""
    kind = rows.schema[embedding].dataType.simpleString()
    v = rows.select(F.col(vec_id).try_cast("long").alias("id"), F.col(embedding).cast(kind if kind == "array<float>" else "array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & fine & F.exists("vector", lambda x: x != 0)).withColumn("dims", F.size("vector"))


def _centres(data: DataFrame, block_rows: int) -> dict[int, np.ndarray]:
    """For each length of vectors the centres: rows of the smallest hashed ids, one for each block, CENTRES at most."""
    out = {}
    for r in data.groupBy("dims").agg(F.count("*").alias("n")).collect():
        wanted = min(CENTRES, -(-r.n // block_rows))
        few = data.where((F.col("dims") == r.dims) & lowest_share(F.xxhash64("id"), F.lit(min(1.0, 4.0 * (wanted + 4) / r.n))))
        found = few.orderBy(F.xxhash64("id"), "id", "vector").limit(wanted).collect() or data.where(F.col("dims") == r.dims).limit(1).collect()
        out[r.dims] = np.array([x.vector for x in found], np.float64)
    return out


def _by_dims(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dims, places in the batch and vectors, for each length in it."""
    dims = b.column("dims").to_numpy()
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), at, _matrix(b.column("vector").take(pa.array(at)), len(at))


def _assigned(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """rows with `centre`, the nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.zeros(b.num_rows, np.int32)
            for d, at, x in _by_dims(b):
                c = centres[d]
                near[at] = np.argmin((c * c).sum(1)[None] - 2 * x @ c.T, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near)], names=[*b.schema.names, "centre"])

    return rows.where(F.col("dims").isin([*centres])).mapInArrow(run, rows.schema.simpleString()[7:-1] + ", centre int") if centres else rows.withColumn("centre", F.lit(0)).limit(0)


def _spans(data: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the centres with rows, and the least and largest projection of their rows in every direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            centre = b.column("centre").to_numpy()
            for d, at, x in _by_dims(b):
                p = x @ directions(d)
                for c in np.unique(centre[at]):
                    own = p[centre[at] == c]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(PROJECTIONS, v, np.int32)) for v in (d, c)] + [pa.array(np.arange(PROJECTIONS, dtype=np.int32)), pa.array(own.min(0)), pa.array(own.max(0))], names=["dims", "centre", "i", "low", "high"])

    found = data.mapInArrow(run, "dims int, centre int, i int, low double, high double").groupBy("dims", "centre", "i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dims", "centre", "i").collect()
    out = {}
    for d in {r.dims for r in found}:
        own = [r for r in found if r.dims == d]
        out[d] = tuple(np.array([r[k] for r in own]).reshape(-1, PROJECTIONS) for k in ("centre", "low", "high"))
        out[d] = (out[d][0][:, 0], *out[d][1:])
    return out


def _visits(asked: DataFrame, spans: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """asked (with `radius`), a row for each centre in which a vector could reach the threshold, as `centre`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            radius = b.column("radius").to_numpy()
            for d, at, x in _by_dims(b):
                centre, low, high = spans[d]
                p, half = x @ directions(d), WIDTH * radius[at] / 2
                for j, i in enumerate(at):
                    reached = ((low <= p[j] + half[j]) & (high >= p[j] - half[j])).sum(1) >= NEED
                    to = pa.array(centre[reached].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([c.take(pa.array(np.full(len(to), i))) for c in b.columns] + [to], names=[*b.schema.names, "centre"])

    return asked.where(F.col("dims").isin([*spans])).mapInArrow(run, asked.schema.simpleString()[7:-1] + ", centre int")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance in double precision): the k nearest of each query.

    queries has the columns of rows. All rows but those with the query's own id are candidates; ties go to the smaller
    id. Vectors that are null, empty or zero, or have null or non-finite components, take no part, and neither do
    vectors without an id; only vectors with as many components are compared. Of rows with the same id the nearest
    counts; of queries with the same id the smallest vector is asked. Fewer than k candidates give as many rows, an
    empty table none. Other columns are not read.
    """
    tables = Scratch(rows.sparkSession)
    given = usable(rows, vec_id, embedding)
    centres = _centres(given, block_rows)
    data = tables.keep(_assigned(given, centres))
    asked = tables.keep(_assigned(usable(queries, vec_id, embedding).groupBy("id", "dims").agg(F.min("vector").alias("vector")), centres).withColumnRenamed("centre", "home"))
    sizes = data.groupBy("dims", "centre").agg(F.count("*").alias("rows"))
    # of fixed size: so many rows as there are centres
    sizes = sizes.select("dims", "centre", F.ceil(F.col("rows") / block_rows).cast("int").alias("parts"))

    def dealt(visiting: DataFrame) -> DataFrame:
        """sizes with `slices`: how many groups the queries that visit a centre make."""
        number = visiting.groupBy("dims", "centre").agg(F.count("*").alias("q"))
        return F.broadcast(sizes.join(number, ["dims", "centre"]).select("dims", "centre", "parts", F.ceil(F.col("q") / block_queries).cast("int").alias("slices")))

    def met(visiting: DataFrame, one_part: bool, search) -> DataFrame:
        plan = dealt(visiting)
        place = ["dims", "centre", "part", "slice"]
        part, piece = F.pmod(F.xxhash64("id", "vector"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("slices")).cast("int")
        mine = data.join(plan, ["dims", "centre"]).select("id", "vector", "dims", "centre", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        theirs = visiting.join(plan, ["dims", "centre"])
        if one_part:
            theirs = theirs.withColumn("part", part)
        else:
            theirs = theirs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            theirs = theirs.where((F.col("centre") != F.col("home")) | (F.col("part") != part))
        theirs = theirs.withColumn("slice", piece).drop("parts", "slices")
        # a task for each group of vectors that meet, as searching takes long for its bytes
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return mine.repartition(tasks, *place).groupBy(*place).cogroup(theirs.repartition(tasks, *place).groupBy(*place)).applyInArrow(search, "query_id long, vec_id long, score double")

    def result(found: Iterator[tuple[int, list[tuple[float, int]]]]) -> pa.Table:
        out = [(own, i, d) for own, near in found for d, i in near]
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    def at_home(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return result(iter(()))
        index = Index(left["id"].to_numpy(), _matrix(left["vector"], left.num_rows))
        return result((int(own), index.search(own, x, k)) for own, x in zip(right["id"].to_numpy(), _matrix(right["vector"], right.num_rows)))

    def elsewhere(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return result(iter(()))
        index = Index(left["id"].to_numpy(), _matrix(left["vector"], left.num_rows))
        return result(index.within(right["id"].to_numpy(), _matrix(right["vector"], right.num_rows), right["radius"].to_numpy(), k))

    first = tables.keep(met(asked.withColumn("centre", F.col("home")), True, at_home))
    bound = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("radius"))
    # an id asked with vectors of two lengths has no common bound
    single = asked.groupBy("id").agg(F.count("*").alias("lengths"))
    bounded = asked.join(bound, asked["id"] == bound["query_id"], "left").join(single, "id").select("id", "dims", "vector", "home", F.when(F.col("lengths") > 1, float("inf")).otherwise(F.coalesce("radius", F.lit(float("inf")))).alias("radius"))
    visiting = tables.keep(_visits(bounded, _spans(data)))
    second = met(visiting, False, elsewhere)
    every = first.union(second).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    out = cut(every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    tables.drop()
    return out
