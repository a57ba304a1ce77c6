"""Near-duplicate detection: SetSketch registers, banded; a likelihood estimate; then a check of the full sets.

A document's set holds its distinct word shingles as 64-bit hashes. Register i of a set is floor(1 - log_b of the least
of its elements' i-th exponential hash values), between 0 and q + 1: a minimum on an exponentially spaced, truncated
scale. Registers of a union are the larger of the parts', and those of similar sets are mostly equal.

1. Sets that are equal (by a 128-bit cryptographic digest and size) become one vertex, whatever their number.
2. The registers of each band make a key. Vertices that share a key are candidates: each with the smallest of the key
   first, which for a group of n takes n pairs. Linked vertices become components.
   A pair is tested on its full sets when the likelihood of its equal, smaller and larger registers puts the estimate
   within `slack` of the threshold; at the defaults a pair of similarity 0.8 falls below it about once in a million.
3. Then only keys whose vertices still lie in different components matter. Their members are dealt into blocks, and
   every two blocks of a key meet in one task, which compares the full sets of members of different components, all
   pairs of them at once, and returns links that join components: fewer than members, however many pairs there are.
   Pairs within a component need no test, as a further link would not change any result.

The driver sees counts only; what grows with the documents is joined, aggregated and kept in the shared folder.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.shared import cut, mix, spans, utf8, with_columns_of, words

BASE, SCALE, TOP = 1.001, 20.0, (1 << 16) - 1
BANDS, ROWS = 30, 5
#: Members of a key that are compared with one another at once.
MEMBERS = 1024
_BLOCK = 1 << 14


@lru_cache(maxsize=4)
def _seeds(registers: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 63, (registers, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(offsets: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows one after another, and how many each row has.

    A row with fewer words than `size` has its whole sequence as one shingle, a row without words none.
    """
    h, counts = words(offsets, data)
    rows = len(counts)
    ends = np.cumsum(counts)
    made, owner = [], []
    if len(h) >= size:
        s = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
        row = np.repeat(np.arange(rows), counts)
        whole = np.arange(len(s)) + size <= ends[row[: len(s)]]
        made.append(s[whole])
        owner.append(row[: len(s)][whole])
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        s = h[ends[i] - counts[i] : ends[i]]
        x = np.uint64(counts[i])
        with np.errstate(over="ignore"):
            for v in s:
                x = mix(np.array([x * np.uint64(0xC2B2AE3D27D4EB4F) + v]))[0]
        made.append(np.array([x], np.uint64))
        owner.append(np.array([i]))
    if not made:
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    values, owner = np.concatenate(made), np.concatenate(owner)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[new], owner[new]
    return values, np.bincount(owner, minlength=rows).astype(np.int64)


def registers(values: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """A row of n registers for each set that is not empty; sets lie one after another in values."""
    least = np.full((n, len(counts)), np.iinfo(np.uint64).max, np.uint64)
    ends = np.cumsum(counts)
    seeds = _seeds(n)
    buffer = np.empty(_BLOCK, np.uint64)
    for lo in range(0, len(values), _BLOCK):
        x = values[lo : lo + _BLOCK]
        first = int(np.searchsorted(ends, lo, "right"))
        last = int(np.searchsorted(ends, lo + len(x), "left"))
        at = np.maximum(ends[first : last + 1] - counts[first : last + 1] - lo, 0)
        out = buffer[: len(x)]
        for i in range(n):
            np.multiply(x, seeds[i, 0], out=out)
            np.add(out, seeds[i, 1], out=out)
            np.bitwise_xor(out, out >> np.uint64(32), out=out)
            np.multiply(out, seeds[i, 0], out=out)
            part = np.minimum.reduceat(out, at)
            np.minimum(least[i, first : last + 1], part, out=least[i, first : last + 1])
    # The least of exponential values with rate SCALE belongs to the least uniform one.
    u = (least.astype(np.float64) + 1.0) / 2.0**64
    h = -np.log1p(-np.minimum(u, 1 - 1e-16)) / SCALE
    return np.clip(np.floor(1.0 - np.log(h) / math.log(BASE)), 0, TOP).astype(np.uint16).T


def _sets(docs: DataFrame, text: Column, doc_id: Column, size: int, n: int, full: bool) -> DataFrame:
    """id, n, digest; with full the set itself (binary), else its registers (binary, those of a band side by side)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data, _ = utf8(b.column(1))
            for i, j in spans(offsets):
                o = offsets[i : j + 1] - offsets[i]
                values, counts = shingles(o, data[offsets[i] : offsets[j]], size)
                at = np.concatenate([[0], np.cumsum(counts)])
                raw = values.astype("<u8").tobytes()
                own = [raw[at[k] * 8 : at[k + 1] * 8] for k in range(j - i)]
                digest = [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in own]
                out = [b.column(0).slice(i, j - i), pa.array(counts), pa.array(digest, pa.binary())]
                if full:
                    out.append(pa.array(own, pa.binary()))
                else:
                    filled = np.flatnonzero(counts)
                    r = registers(values, counts[filled], n)
                    regs = [None] * (j - i)
                    for k, f in enumerate(filled):
                        regs[f] = r[k].astype("<u2").tobytes()
                    out.append(pa.array(regs, pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=["id", "n", "digest", "items" if full else "regs"])

    return docs.select(doc_id.try_cast("long").alias("id"), text.cast("string").alias("text")).mapInArrow(run, "id long, n long, digest binary, " + ("items binary" if full else "regs binary"))


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity under which each pair of register rows is likeliest, given the sizes of the sets."""
    larger, smaller = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    equal = a.shape[1] - larger - smaller
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        x, y = p(u - v * j), p(v - u * j)
        return larger * np.log(np.maximum(x, 1e-12)) + smaller * np.log(np.maximum(y, 1e-12)) + equal * np.log(np.maximum(1 - x - y, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(24):
        step = golden * (hi - lo)
        left = likelihood(hi - step) > likelihood(lo + step)
        lo, hi = np.where(left, lo, hi - step), np.where(left, lo + step, hi)
    return (lo + hi) / 2


def _likely(pairs: DataFrame, threshold: float, slack: float) -> DataFrame:
    """Of pairs with sizes and registers on either side, those whose estimate comes near the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                b = batch.slice(i, 2048)
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(b.num_rows, -1) for k in ("regs_a", "regs_b"))
                n, m = (b.column(k).to_numpy().astype(float) for k in ("n_a", "n_b"))
                keep = estimate(x, y, n, m) >= threshold - slack
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, threshold_percent: int) -> DataFrame:
    """Of pairs with full sets on either side, those with 100 * intersection >= threshold_percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("items_a"), b.column("items_b")):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= threshold_percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, label (the smallest id reachable) for each id in edges (a, b): labels spread along edges and are shortcut."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        heard = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("heard"))
        near = labels.join(heard, labels["id"] == heard["a"]).select("id", F.col("label").alias("old"), F.least("label", "heard").alias("near"))
        target = labels.select(F.col("id").alias("t"), F.col("label").alias("far"))
        # the label of one's label is never larger
        new = cut(near.join(target, near["near"] == target["t"]).select("id", "old", F.least("near", "far").alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels


def _full_sets(docs: DataFrame, needed: DataFrame, text: Column, doc_id: Column, size: int) -> DataFrame:
    """id, items of the documents with the needed ids (a column `need`), from their texts anew."""
    own = docs.select(doc_id.try_cast("long").alias("_id"), text.cast("string").alias("_text")).join(needed.distinct(), F.col("_id") == F.col("need"), "left_semi")
    return _sets(own, F.col("_text"), F.col("_id"), size, BANDS * ROWS, full=True).where("n > 0").select("id", "items").distinct()


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, text: Column, doc_id: Column, size: int, percent: int, slack: float) -> DataFrame:
    """Of candidate pairs (a, b) those that are linked, kept in the shared folder."""
    side = lambda df, columns, end: df.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
    known = pairs.join(side(sketches, ["n", "regs"], "a"), "a").join(side(sketches, ["n", "regs"], "b"), "b")
    fitting = known.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    likely = cut(_likely(fitting, percent / 100, slack))
    full = cut(_full_sets(docs, likely.select(F.col("a").alias("need")).union(likely.select("b")), text, doc_id, size))
    return cut(_linked(likely.join(side(full, ["items"], "a"), "a").join(side(full, ["items"], "b"), "b"), percent).distinct())


def joining_links(ids: list[int], labels: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different labels, as many as join what the links connect; no pair is left untested.

    Shingles of one member only count in no intersection; the others make a matrix whose product with itself has the
    intersections of all pairs, some thousand shingles at a time.
    """
    m = len(ids)
    lengths = np.array([len(x) for x in sets], np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), lengths)
    _, code, n = np.unique(values, return_inverse=True, return_counts=True)
    shared = n[code] > 1
    column, owner = (np.cumsum(n > 1) - 1)[code[shared]], owner[shared]
    both = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, 4096):
        x, y = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((m, min(4096, width - lo)), np.float32)
        part[owner[x:y], column[x:y] - lo] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    linked = 100 * both >= percent * (lengths[:, None] + lengths[None, :] - both)
    parent = {x: x for x in labels}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        a, b = find(labels[i]), find(labels[j])
        if a != b:
            parent[a] = b
            out.append((ids[i], ids[j]))
    return out


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members (key, id, label) of one key that have different labels."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = dealt.select("key", "id", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("key", "id", "label", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    place = ["key", "lo", "hi"]

    def flush(held: list[tuple]) -> list[tuple[int, int]]:
        if len({h[1] for h in held}) < 2:
            return []
        return joining_links([h[0] for h in held], [h[1] for h in held], [np.frombuffer(h[2], "<u8") for h in held], percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            found: list[tuple[int, int]] = []
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256).to_pydict()
                for k, lo, hi, x, label, items in zip(*(part[c] for c in [*place, "id", "label", "items"])):
                    if (k, lo, hi) != last:
                        found += flush(held)
                        held, last = [], (k, lo, hi)
                    held.append((x, label, items))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])
        if found := flush(held):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    rows = met.join(sets, "id").select(*place, "id", "label", "items")
    return rows.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", slack: float = 0.16) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs.

    Words are what stands between ASCII white space, with A-Z lower-cased; a set holds the distinct shingles of `size`
    words, or the whole sequence if it is shorter. Rows are linked when 100 * intersection >= percent * union, and
    component_id is the smallest id that links reach, one's own included; kept: doc_id is component_id.

    A null or empty text, or one without words, has an empty set and is linked with nothing. Rows that share an id are
    one document, whose links are those of either. A row without an id is linked with nothing, keeps a null
    component_id and is kept. Copies are linked without being paired. No other column is read. Ids are integers, or texts
    of digits; other ids count as none.

    Links rest on 64-bit hashes of words and shingles, none of them linear: two sets of a million shingles in all share one
    by chance in about one of eighteen million pairs of sets.
    """
    t, i = F.col(text), F.col(doc_id)
    sketches = cut(_sets(docs, t, i, size, BANDS * ROWS, full=False))
    usable = sketches.where("id IS NOT NULL AND n > 0")
    first = usable.groupBy("digest", "n").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    # Every copy of a set is an edge to the first; only firsts are compared.
    copies = usable.select("id", "digest", "n").join(first.where("copies > 1"), ["digest", "n"]).where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    heads = cut(usable.join(first.select("digest", "n", F.col("first").alias("id")), ["digest", "n", "id"]).dropDuplicates(["digest", "n", "id"]).select("id", "n", "regs"))
    band = lambda k: F.xxhash64(F.lit(k), F.substring("regs", 2 * ROWS * k + 1, 2 * ROWS))
    bands = heads.select("id", F.explode(F.array(*[band(k) for k in range(BANDS)])).alias("key"))
    shared = bands.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").drop("z")
    shared = cut(bands.join(shared, "key"))
    stars = shared.where("a < id").select("a", F.col("id").alias("b")).distinct()
    edges = _verified(stars, heads, docs, t, i, size, percent, slack)
    labels = components(edges)
    named = shared.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    open_keys = named.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("m")).where("l < h AND m > 2").select("key")
    left = cut(named.join(open_keys, "key"))
    sets = cut(_full_sets(docs, left.select(F.col("id").alias("need")), t, i, size))
    more = cut(_across(left, sets, percent))
    labels = components(edges.union(more).union(copies))
    rows = sketches.select("id", "n")
    out = rows.join(labels, "id", "left").select("id", "n", F.coalesce("label", "id").alias("component_id"))
    return out.select(
        F.col("id").cast(docs.schema[doc_id].dataType).alias(doc_id),
        F.col("n").alias("n_shingles"),
        F.col("component_id").cast(docs.schema[doc_id].dataType).alias("component_id"),
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, one document of each group, with their columns; those that go are taken away by id.

    Rows without words or without an id stay. Rows that share an id are one document and stay or go together. An empty
    table gives no rows.
    """
    gone = near_duplicates(docs, size, percent, text, doc_id).where("NOT kept").select(F.col(doc_id).alias("_gone")).distinct()
    return with_columns_of(docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti"), docs.columns)
