"""Merkle manifest of a dataset: a tree of digests for each group of rows, and one over the groups.

1. Spark hashes each row to a leaf, so that no text is shuffled.
2. Leaves are ranked within their group: a range partitioning by group and order, the rows' places in the partitions, and
   running sums of the partitions' counts.
3. The ranks deal leaves into aligned blocks of FANOUT**height, a row each. A block is a contiguous numpy matrix of 64
   hex bytes a node: reshaped by the fanout, its rows are hashed level by level to the block's root. Roots are the nodes
   of the next round, until a group has one; the groups' roots make the last tree in the same way.
4. From the top down, each block gives its nodes their way to the root: the siblings to their left and right at each
   level, by index arithmetic. A leaf's proof is the siblings in its own block and its block's way.

No task holds more than a block, and what is not a leaf is a FANOUT**height-th of the rows above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm.shared import Scratch, cut

FANOUT, HEIGHT = 3, 6
_HEX = np.array([ord(f"{b:02x}"[k]) for b in range(256) for k in (0, 1)], np.uint8).reshape(256, 2)


def field(value: Column) -> Column:
    """A hyphen for null, else the number of UTF-8 bytes, a colon and the value (integers in decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row as hex text."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def hashed(runs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hex digests (rows of 64 bytes) of the first `sizes` nodes of each row of runs."""
    raw, width = np.ascontiguousarray(runs).tobytes(), runs.shape[1]
    made = [hashlib.sha256(raw[i * width : i * width + 64 * n]).digest() for i, n in enumerate(sizes.tolist())]
    return _HEX[np.frombuffer(b"".join(made), np.uint8)].reshape(-1, 64)


def run_matrix(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes reshaped by the fanout, a row for each run (the last filled up), and the nodes of each run."""
    n = len(nodes)
    rows = -(-n // FANOUT)
    padded = np.zeros((rows * FANOUT, 64), np.uint8)
    padded[:n] = nodes
    return padded.reshape(rows, FANOUT * 64), np.minimum(FANOUT, n - FANOUT * np.arange(rows))


def levels(leaves: np.ndarray, height: int | None) -> list[np.ndarray]:
    """The nodes of each level, leaves first: `height` levels above them, or (None) as many as leave one node."""
    out = [leaves]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        out.append(hashed(*run_matrix(out[-1])))
    return out


def siblings(tree: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level below the root: each leaf's run in that level (as a row of nodes), its own place there, and how
    many nodes the run has."""
    out, place = [], np.arange(len(tree[0]))
    for nodes in tree[:-1]:
        runs, sizes = run_matrix(nodes)
        row = place // FANOUT
        out.append((runs[row], place % FANOUT, sizes[row]))
        place = row
    return out


def folded(leaves: np.ndarray, ways: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The roots that leaves give with the siblings of `ways`."""
    node = leaves
    for runs, own, sizes in ways:
        runs = runs.reshape(len(node), FANOUT, 64).copy()
        runs[np.arange(len(node)), own] = node
        node = hashed(runs.reshape(len(node), -1), sizes)
    return node


def others(ways: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> list[bytes]:
    """Each leaf's siblings, level by level and left to right, as one text."""
    parts: list[list[bytes]] = [[] for _ in range(n)]
    for runs, own, sizes in ways:
        raw, width = np.ascontiguousarray(runs).tobytes(), runs.shape[1]
        for i, (k, m) in enumerate(zip(own.tolist(), sizes.tolist())):
            at = i * width
            parts[i].append(raw[at : at + 64 * k] + raw[at + 64 * (k + 1) : at + 64 * m])
    return [b"".join(p) for p in parts]


def _hex(column: pa.Array) -> np.ndarray:
    """Rows of 64 hex bytes from a list of 32-byte values."""
    return _HEX[np.frombuffer(b"".join(column.to_pylist()), np.uint8)].reshape(-1, 64)


def ranked(rows: DataFrame, group: str, order: list[str], tables: Scratch) -> DataFrame:
    """rows with pos (from 0) in their group by `order`, and total (rows of the group). No group is held in one task."""
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = tables.keep(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    counts = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # a group has a row for each partition that it reaches
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = tables.keep(counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_base"), F.sum("_n").over(whole).alias("total")))
    met = placed.join(bases, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_at") + F.col("_base")).alias("pos"), "total")


def _blocks(nodes: DataFrame, carried: list[str], height: int) -> DataFrame:
    """A row for each block: grp, block, total, nodes (array of pos, digest and what is carried, in order)."""
    size = FANOUT**height
    item = F.struct("pos", "digest", *carried)
    return nodes.groupBy("grp", F.floor(F.col("pos") / size).alias("block"), "total").agg(F.sort_array(F.collect_list(item)).alias("nodes"))


def _height(total: int, height: int) -> int | None:
    """Levels of a block above its nodes: a group of one block ends at its root."""
    return height if total > FANOUT**height else None


def _parents(blocks: DataFrame, height: int) -> DataFrame:
    """The roots of blocks as nodes of the next round: grp, pos, total, digest."""
    size = FANOUT**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column(2).to_pylist()
            roots = [levels(_hex(x.values.field("digest")), _height(n, height))[-1].tobytes().decode() for x, n in zip(b.column(3), total)]
            totals = pa.array([-(-n // size) for n in total], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), totals, pa.array([bytes.fromhex(r) for r in roots], pa.binary())], names=["grp", "pos", "total", "digest"])

    kind = blocks.schema["grp"].dataType.simpleString()
    return blocks.select("grp", "block", "total", F.transform("nodes", lambda x: F.struct(x["digest"].alias("digest"))).alias("nodes")).mapInArrow(run, f"grp {kind}, pos long, total long, digest binary")


def _ways(blocks: DataFrame, ways: DataFrame, height: int) -> DataFrame:
    """grp, pos, left, right (arrays: hex siblings of each level up to the top): a row for each node of the blocks.

    ways: grp, block, left, right of the blocks themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                nodes = b.column("nodes")[i].values
                found = siblings(levels(_hex(nodes.field("digest")), _height(b.column("total")[i].as_py(), height)))
                n = len(nodes)
                sides: list[list[list[bytes]]] = [[[] for _ in range(n)] for _ in range(2)]
                for runs, own, sizes in found:
                    for k in range(n):
                        raw, at = runs[k].tobytes(), int(own[k]) * 64
                        sides[0][k].append(raw[:at])
                        sides[1][k].append(raw[at + 64 : 64 * int(sizes[k])])
                up = [b.column(c)[i].as_py() for c in ("left", "right")]
                yield pa.RecordBatch.from_arrays(
                    [b.column("grp").take(pa.array([i] * n)), nodes.field("pos")] + [pa.array([x + u for x in s], pa.list_(pa.binary())) for s, u in zip(sides, up)],
                    names=["grp", "pos", "left", "right"],
                )

    met = _with_ways(blocks, ways)
    kind = blocks.schema["grp"].dataType.simpleString()
    return met.mapInArrow(run, f"grp {kind}, pos long, left array<binary>, right array<binary>")


def _with_ways(blocks: DataFrame, ways: DataFrame) -> DataFrame:
    up = ways.select(F.col("grp").alias("_g"), F.col("block").alias("_b"), *[c for c in ways.columns if c not in ("grp", "block")])
    return blocks.join(up, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).drop("_g", "_b")


class _Tree:
    """The rounds of one forest: blocks of each, as tables, and the groups' roots (grp, digest)."""

    def __init__(self, nodes: DataFrame, carried: list[str], height: int, tables: Scratch) -> None:
        self.tables, self.height, self.rounds = tables, height, []
        while True:
            self.rounds.append(tables.keep(_blocks(nodes, carried, height)))
            nodes, carried = tables.keep(_parents(self.rounds[-1], height)), []
            if nodes.where("total > 1").isEmpty():
                break
        self.roots = nodes.select("grp", "digest")

    def ways(self, top: DataFrame) -> DataFrame:
        """The ways of the lowest blocks (grp, block, left, right), given those of the groups (grp, left, right)."""
        ways = top.withColumn("block", F.lit(0).cast("long"))
        for blocks in reversed(self.rounds[1:]):
            ways = self.tables.keep(_ways(blocks, ways, self.height).withColumnRenamed("pos", "block"))
        return ways


def manifest(rows: DataFrame, digest: Column, tampered: Column, group: str, order: list[str], keep: list[str] | None = None, height: int = HEIGHT) -> DataFrame:
    """leaf, subroot, root, proof (siblings' hex text), folded_root, verified, and the columns to keep: a row for each.

    digest: a row's leaf as hex text; tampered: the leaf to verify instead. The rows of a group (a column) ascend by
    `order` (nulls first), then by their leaves. While a level has several nodes, every FANOUT consecutive ones (the last
    run: fewer, even one) become the digest of their hex texts side by side; what remains is the group's subroot. The
    subroots, ordered by group (null first, else by UTF-8 bytes), make the root likewise. proof: a leaf's siblings, level
    by level up to the root, left to right; folded_root: what the tampered leaf gives with them.

    Null is a group of its own. Rows that repeat are as many leaves, whatever their order. An empty table gives no rows.
    keep: columns of rows to pass on, by default all; their names may be any but those of the results, and their types
    such as can be ordered. Only they and digests are shuffled.
    """
    tables = Scratch(rows.sparkSession)
    try:
        named = lambda c: F.col(f"`{c}`")
        row = F.struct(*[named(c) for c in keep or rows.columns]).alias("row")
        keys = [named(c).alias(f"_o{k}") for k, c in enumerate(order)]
        own = tables.keep(rows.select(named(group).alias("grp"), *keys, F.unhex(digest).alias("digest"), F.unhex(tampered).alias("other"), row, F.monotonically_increasing_id().alias("_uid")))
        leaves = ranked(own, "grp", [f"_o{k}" for k in range(len(order))] + ["digest", "_uid"], tables)
        trees = _Tree(leaves, ["other", "row"], height, tables)
        # the order of groups: ranked as rows of one group
        tops = ranked(trees.roots.select(F.col("grp").alias("key"), "digest", F.lit(0).alias("grp")), "grp", ["key"], tables)
        tops = tables.keep(tops)
        over = _Tree(tops, ["key"], height, tables)
        none = F.array().cast("array<binary>")
        start = over.roots.select("grp", none.alias("left"), none.alias("right"))
        spread = _ways(over.rounds[0], over.ways(start), height)
        subroots = tops.select("pos", F.col("key").alias("grp"), F.lower(F.hex("digest")).alias("subroot"))
        top = tables.keep(subroots.join(spread.select("pos", "left", "right"), "pos").drop("pos"))
        ways = trees.ways(top.select("grp", "left", "right"))
        ways = ways.join(top.select(F.col("grp").alias("_t"), "subroot"), F.col("grp").eqNullSafe(F.col("_t"))).drop("_t")
        root = over.roots.select(F.lower(F.hex("digest")).alias("root")).head()
        met = _with_ways(trees.rounds[0], ways).withColumn("root", F.lit(root["root"] if root else None))
        return cut(_proved(met, height))
    finally:
        tables.drop()


def _proved(blocks: DataFrame, height: int) -> DataFrame:
    """The leaves of blocks that know their way, with what their proofs give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                nodes = b.column("nodes")[i].values
                n, left, right = len(nodes), b.column("left")[i].as_py(), b.column("right")[i].as_py()
                leaves, other = _hex(nodes.field("digest")), _hex(nodes.field("other"))
                own = siblings(levels(leaves, _height(b.column("total")[i].as_py(), height)))
                above = b"".join(x + y for x, y in zip(left, right))
                node = folded(other, own)
                for x, y in zip(left, right):  # the same siblings for all leaves of the block
                    run_ = np.frombuffer(x + bytes(64) + y, np.uint8)
                    runs = np.tile(run_, (n, 1))
                    runs[:, len(x) : len(x) + 64] = node
                    node = hashed(runs, np.full(n, len(run_) // 64))
                text = lambda m: pa.array([r.tobytes().decode() for r in m], pa.string())
                once = [b.column(c).take(pa.array([i] * n)) for c in ("subroot", "root")]
                proofs = pa.array([(p + above).decode() for p in others(own, n)], pa.string())
                yield pa.RecordBatch.from_arrays([nodes.field("row"), text(leaves), *once, proofs, text(node)], names=["row", "leaf", "subroot", "root", "proof", "folded_root"])

    kind = blocks.schema["nodes"].dataType.elementType["row"].dataType.simpleString()
    out = blocks.mapInArrow(run, f"row {kind}, leaf string, subroot string, root string, proof string, folded_root string")
    return out.select("leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "row.*")


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


#: op11's rows: levels of nodes by recursion (a within a source, b over sources), and each leaf's node and proof along them
#: (f, then t); a row is tampered with where the CRC of its id, folded bit by bit, is even.
ORACLE_SQL = f"""WITH RECURSIVE k AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, d: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295) % 2 AS odd FROM documents),
h AS (SELECT doc_id, source, {_field_sql('doc_id')} || {_field_sql('source')} || {_field_sql('lang')} || {_field_sql('n_chars')} AS head, text, CASE WHEN odd = 0 THEN replace(text, chr(10), '') ELSE text END AS bad FROM k),
l AS (SELECT doc_id, source, sha256(head || {_field_sql('text')}) AS leaf, sha256(head || {_field_sql('bad')}) AS other FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM l),
a AS (SELECT g, 0 AS lvl, pos, leaf AS h, n FROM r UNION ALL SELECT g, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM a WHERE n > 1 GROUP BY g, lvl, pos // 3),
f AS (SELECT g, pos AS own, 0 AS lvl, pos, other AS node, '' AS proof, n FROM r
 UNION ALL SELECT f.g, own, f.lvl + 1, f.pos // 3, sha256(string_agg(CASE WHEN a.pos = f.pos THEN node ELSE a.h END, '' ORDER BY a.pos)), proof || coalesce(string_agg(CASE WHEN a.pos <> f.pos THEN a.h END, '' ORDER BY a.pos), ''), (f.n + 2) // 3
 FROM f JOIN a ON a.g = f.g AND a.lvl = f.lvl AND a.pos // 3 = f.pos // 3 WHERE f.n > 1 GROUP BY f.g, own, f.lvl, f.pos, node, proof, f.n),
s AS (SELECT g AS pos, h, (SELECT count(DISTINCT g) FROM r) AS n FROM a WHERE n = 1),
b AS (SELECT 0 AS lvl, pos, h, n FROM s UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM b WHERE n > 1 GROUP BY lvl, pos // 3),
t AS (SELECT g, own, 0 AS lvl, g AS pos, node, proof, (SELECT count(DISTINCT g) FROM r) AS n FROM f WHERE f.n = 1
 UNION ALL SELECT t.g, own, t.lvl + 1, t.pos // 3, sha256(string_agg(CASE WHEN b.pos = t.pos THEN node ELSE b.h END, '' ORDER BY b.pos)), proof || coalesce(string_agg(CASE WHEN b.pos <> t.pos THEN b.h END, '' ORDER BY b.pos), ''), (t.n + 2) // 3
 FROM t JOIN b ON b.lvl = t.lvl AND b.pos // 3 = t.pos // 3 WHERE t.n > 1 GROUP BY t.g, own, t.lvl, t.pos, node, proof, t.n),
o AS (SELECT h AS root FROM b WHERE n = 1)
SELECT doc_id, leaf, s.h AS subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM r JOIN t ON t.g = r.g AND t.own = r.pos AND t.n = 1 JOIN s ON s.pos = r.g, o"""
