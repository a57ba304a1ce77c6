"""A graph with several kinds of edges over one set of nodes.

Pairs within a group (holdings of a fund, codes of a concept) grow with the square of its members, and many come from more
than one group. Codes are dealt into blocks, whose memberships are written once to the shared folder; each two blocks meet
in one task, which reads both and marks the pairs of codes that share a group, so that every pair leaves its task once and
none is shuffled. Where `largest` is given, members of a larger group are linked with the next `most` on a ring of hashed
codes, as large industries are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.operators.graph import sampled_peers
from alphaloom.session import passing_dir, read_under

#: Codes of a block at most, memberships of a block that are read at a time, pairs made or given out at a time, and pairs of
#: a group from which on it is marked by itself.
BLOCK, ROWS, PAIRS, MANY = 8192, 1 << 19, 1 << 18, 1 << 12


def _runs(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group's rows begin, and how many there are."""
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return first, np.diff(first, append=len(groups))


def _mark(met: np.ndarray, g: np.ndarray, at: np.ndarray, h: np.ndarray, to: np.ndarray) -> None:
    """Marks [code, other] for members `at` of groups g and `to` of groups h, where these are the same; both are sorted."""
    (first, m), (second, n) = _runs(g), _runs(h)
    place = np.searchsorted(h[second], g[first])
    hit = np.flatnonzero(h[second][np.minimum(place, len(second) - 1)] == g[first])
    first, m, second, n = first[hit], m[hit], second[place[hit]], n[place[hit]]
    large = m * n > MANY
    for i, k, j, c in zip(*(x[large] for x in (first, m, second, n))):
        met[np.ix_(at[i : i + k], to[j : j + c])] = True
    first, m, second, n = (x[~large] for x in (first, m, second, n))
    # a row for each member, with the rows of its group on the other side
    own = np.arange(m.sum()) + np.repeat(first - (np.cumsum(m) - m), m)
    second, n = np.repeat(second, m), np.repeat(n, m)
    ends, lo = np.cumsum(n), 0
    while lo < len(own):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        size = n[lo:hi]
        other = np.arange(size.sum()) + np.repeat(second[lo:hi] - (np.cumsum(size) - size), size)
        met[np.repeat(at[own[lo:hi]], size), to[other]] = True
        lo = hi


def _members(table: pa.Table, codes: pa.Array, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups in order, and the places of their members among a block's codes, each once."""
    at = pc.index_in(table.column("code").combine_chunks(), codes).to_numpy(zero_copy_only=False)
    if (groups[1:] < groups[:-1]).any():
        order = np.lexsort((at, groups))
        groups, at = groups[order], at[order]
    keep = np.concatenate([[True], (groups[1:] != groups[:-1]) | (at[1:] != at[:-1])])
    return groups[keep], at[keep]


def _numbers(columns: list[pa.Array]) -> list[np.ndarray]:
    """Groups as numbers that are equal where they are."""
    if pa.types.is_integer(columns[0].type):
        return [c.to_numpy(zero_copy_only=False) for c in columns]
    ids = pa.chunked_array(columns).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.split(ids, np.cumsum([len(c) for c in columns])[:-1])


def pairs_in_groups(rows: DataFrame, group: str, block: int = BLOCK, largest: int | None = None, most: int = 20) -> DataFrame:
    """src < dst: pairs of codes that share a group, each once (rows: group, code)."""
    d = rows.select(F.col(group).alias("g"), "code").where("g IS NOT NULL AND code IS NOT NULL")
    if largest is None:
        return _pairs(d, block)
    d = d.distinct()
    sized = d.join(d.groupBy("g").agg(F.count("*").alias("m")), "g")
    ring = sampled_peers(sized.where(F.col("m") > largest), "g", most)
    return _pairs(sized.where(F.col("m") <= largest).select("g", "code"), block).union(ring.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))).distinct()


def _pairs(d: DataFrame, block: int) -> DataFrame:
    """As pairs_in_groups, of rows g, code. Blocks are narrower where codes are few, so that there are some tens of tasks;
    their memberships are dealt into parts by group, which a task reads one after the other."""
    codes = d.groupBy("code").agg(F.count("*").alias("n")).persist(StorageLevel.DISK_ONLY)
    count, rows = codes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-count // block), min(10, count // 64))
    parts = max(1, -(-rows // (blocks * ROWS)))
    own, path = F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int").alias("own"), passing_dir(d.sparkSession, "members")
    codes.select("code", own).repartition(min(blocks, 64), "own").write.partitionBy("own").parquet(f"{path}/codes")
    codes.unpersist()
    dealt = d.select("g", "code", own, F.pmod(F.xxhash64("g"), F.lit(parts)).cast("int").alias("part")).repartition(min(blocks * parts, 4096), "own", "part")
    dealt.sortWithinPartitions("own", "part", "g", "code").write.partitionBy("own", "part").parquet(f"{path}/members")
    kind = d.schema["code"].dataType.simpleString()

    def task(p: int, q: int) -> Iterator[pa.RecordBatch]:
        sides = [p] if p == q else [p, q]
        tables = [read_under(f"{path}/codes/own={i}", ["code"]) for i in sides]
        if any(t is None for t in tables):
            return
        found = [t.column("code").combine_chunks() for t in tables]
        found = [c.take(pc.array_sort_indices(c)) for c in found]
        met = np.zeros((len(found[0]), len(found[-1])), bool)
        for part in range(parts):
            held = [read_under(f"{path}/members/own={i}/part={part}", ["g", "code"]) for i in sides]
            if any(t is None or t.num_rows == 0 for t in held):
                continue
            groups = _numbers([t.column("g").combine_chunks() for t in held])
            members = [_members(t, c, g) for t, c, g in zip(held, found, groups)]
            _mark(met, *members[0], *members[-1])
        every = found[0] if p == q else pa.concat_arrays(found)
        rank = np.empty(len(every), np.int64)
        rank[pc.array_sort_indices(every).to_numpy()] = np.arange(len(every))
        shift = 0 if p == q else len(found[0])
        ends, lo = np.cumsum(np.count_nonzero(met, axis=1)), 0
        while lo < len(met) and (lo == 0 or ends[lo - 1] < ends[-1]):
            # few batches where pairs are few
            first, lo = lo, max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            i, j = np.nonzero(met[first:lo])
            i, j = i + first, j + shift
            if p == q:
                i, j = i[i < j], j[i < j]
            swap = rank[i] > rank[j]
            yield pa.RecordBatch.from_arrays([every.take(pa.array(np.where(swap, j, i))), every.take(pa.array(np.where(swap, i, j)))], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                q = (isqrt(8 * k + 1) - 1) // 2
                yield from task(k - q * (q + 1) // 2, q)

    tasks = blocks * (blocks + 1) // 2
    return d.sparkSession.range(0, tasks, 1, min(tasks, 1 << 16)).mapInArrow(run, f"src {kind}, dst {kind}")


def once(edges: DataFrame) -> DataFrame:
    """Each pair of two codes once: of both directions the smaller source stays."""
    first = F.row_number().over(Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst")).orderBy("src"))
    return edges.where("src <> dst").distinct().withColumn("k", first).where("k = 1").select("src", "dst")


def supplied(industry: DataFrame, supply: DataFrame) -> DataFrame:
    """src, dst: from every code of an upstream sector to every one of a downstream one, each pair once.

    Where a code has one sector, the sectors tell whether a pair comes in both directions, so that pairs leave the task
    that makes them and are not shuffled; sources are dealt over tasks.
    """
    links = supply.select("up", "down").distinct()
    back = links.select(F.col("up").alias("down"), F.col("down").alias("up"), F.lit(True).alias("both"))
    up = industry.select(F.col("code").alias("src"), F.col("sector").alias("up"))
    down = industry.select(F.col("code").alias("dst"), F.col("sector").alias("down"))
    if not industry.groupBy("code").count().where("count > 1").isEmpty():
        return once(up.join(links, "up").join(down, "down").select("src", "dst"))
    parts = max(8, min(64, industry.count() // 4096))
    dealt = up.join(links.join(back, ["up", "down"], "left"), "up").withColumn("part", F.pmod(F.xxhash64("src"), F.lit(parts)).cast("int"))
    shown = down.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(shown, ["down", "part"]).where("src <> dst AND (both IS NULL OR src < dst)").select("src", "dst")


def build(nodes: DataFrame, industry: DataFrame | None = None, supply: DataFrame | None = None, holdings: DataFrame | None = None, concepts: DataFrame | None = None, peers: int = 20, largest: int | None = None) -> DataFrame:
    """kind, src, dst: the edges of every kind, each pair once a kind, over the given nodes (code).

    supply_chain: from every code of an upstream sector to every one of a downstream sector (industry: code, sector;
    supply: up, down); same_industry: all pairs of a sector of at most peers + 1 codes, else `peers` for each code;
    co_holding (holdings: fund, code) and concept (concepts: concept, code): all pairs of a group.
    """
    here = nodes.select("code").distinct()
    known = lambda df: df.join(here, "code", "left_semi")
    parts = []
    if industry is not None:
        i = known(industry.select("code", "sector").where("sector IS NOT NULL").distinct())
        if supply is not None:
            parts.append(supplied(i, supply).select(F.lit("supply_chain").alias("kind"), "src", "dst"))
        parts.append(once(sampled_peers(i, "sector", peers)).select(F.lit("same_industry").alias("kind"), "src", "dst"))
    for rows, group, kind in ((holdings, "fund", "co_holding"), (concepts, "concept", "concept")):
        if rows is not None:
            parts.append(pairs_in_groups(known(rows), group, largest=largest).select(F.lit(kind).alias("kind"), "src", "dst"))
    if not parts:
        return here.select(F.lit("none").alias("kind"), F.col("code").alias("src"), F.col("code").alias("dst")).limit(0)
    return reduce(DataFrame.union, parts)


def adjacency(edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """src, dst, kinds: both directions of the edges of the chosen kinds (all by default), with the kinds of each pair."""
    e = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    both = e.select("kind", "src", "dst").union(e.select("kind", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.groupBy("src", "dst").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
