"""Repeated passages by longest-previous-factor arrays over suffix order.

A string of `length` bytes that starts at two places is to be found wherever they are, so that suffixes must meet across
tasks without one task holding the corpus:

1. Every such string has an anchor, its least hashed k-gram. Neighbouring strings share theirs, so that a document is
   dealt into territories, each the bytes of all its strings with one anchor. Equal strings have equal anchors at equal
   offsets; a territory whose anchor occurs once in the corpus holds no repeat.
2. Equal territories (by the anchor's hash and 64 bits of the whole's blake2b digest) are counted as one, with the first of them.
3. Where an anchor has different territories, their bytes are fetched and brought together by anchor. A task sorts the
   suffixes of a bounded number of bytes by rank doubling. In suffix order the previous and next entries of smaller text
   position give each string its longest previous factor, and those of larger position its longest next factor.
4. An anchor with over `crowd` different territories is dealt again: their strings are parted by their distance from the
   anchor, and each part goes with the bytes that all its strings have in common. Parts that share these bytes meet, are
   compared as territories are (steps 2 and 3), and are parted again where they still crowd. A part of one string is
   equal to all that it meets, so that this ends after the logarithm of `length`.
5. Territories lead back to their occurrences, and their runs of repeated strings to the spans of each document.

What lies between the steps is written to the shared folder and dropped when the spans are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.shared import POWERS, Scratch, cut, digest64, mix, prefix_sums, spans, utf8, with_columns_of

SORTED_BYTES = 1 << 19
#: Parts into which the strings of a crowded anchor are dealt at a time.
PARTS = 8


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from minima of blocks read either way."""
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    forth = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(x) - width + 1], forth[width - 1 : len(x)])


def territories(offsets: np.ndarray, data: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """row, anchor's place, first and last string's start (places in the row), hash of the anchor and of the territory."""
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    if len(data) >= length:
        c = prefix_sums(data)
        _, down = POWERS(len(data) + 1)
        grams = mix((c[gram:] - c[:-gram]) * down[: len(data) - gram + 1])
        for row in np.flatnonzero(np.diff(offsets) >= length):
            lo, hi = int(offsets[row]), int(offsets[row + 1])
            g = grams[lo : hi - gram + 1]
            # equal hashes: the leftmost; the upper half of the hash decides, the place fills the lower
            place = _sliding_minimum((g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64), length - gram + 1) & np.uint64(0xFFFFFFFF)
            change = np.flatnonzero(place[1:] != place[:-1]) + 1
            first = np.concatenate([[0], change])
            last = np.concatenate([change - 1, [len(place) - 1]])
            anchor = place[first].astype(np.int64)
            s, e = lo + first, lo + last + length
            raw = data[lo:hi].tobytes()
            whole = np.array([digest64(raw[x - lo : y - lo], z) for x, y, z in zip(s.tolist(), e.tolist(), (anchor - first).tolist())], np.int64).view(np.uint64)
            for k, x in enumerate((np.full(len(first), row), anchor, first, last, g[anchor], whole)):
                out[k].append(x)
    kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds)]


def suffix_ranks(data: np.ndarray, length: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """By doubling, the ranks of the strings of 8, 16, ... bytes at every place, and those of `length` bytes.

    Strings that would pass the end are filled up with zero bytes; their ranks are not to be used.
    """
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    n, key = len(data), np.zeros(len(data), np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n]
    levels, size = [], 8

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
        return rank

    def at(rank: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[: max(0, n - by)] = rank[by:]
        return out

    rank = ranked(key)
    levels.append((size, rank))
    while size * 2 <= length:
        rank = ranked(rank.astype(np.int64) * (n + 1) + at(rank, size))
        size *= 2
        levels.append((size, rank))
    return levels, rank if size == length else ranked(rank.astype(np.int64) * (n + 1) + at(rank, length - size))


def common_prefix(levels: list[tuple[int, np.ndarray]], data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Bytes that the strings at places a and b have in common, `length` at most."""
    n = len(data)
    found = np.zeros(len(a), np.int64)
    for size, rank in [*reversed(levels)]:
        for _ in range(2 if size == levels[-1][0] else 1):
            x, y = a + found, b + found
            inside = (found + size <= length) & (x < n) & (y < n)
            same = inside.copy()
            same[inside] = rank[x[inside]] == rank[y[inside]]
            found[same] += size
    for _ in range(7):
        x, y = a + found, b + found
        inside = (found < length) & (x < n) & (y < n)
        same = inside.copy()
        same[inside] = data[x[inside]] == data[y[inside]]
        found[same] += 1
    return found


def nearest_smaller(position: np.ndarray) -> np.ndarray:
    """For each entry the nearest one before it of smaller position, or -1: entries jump along the jumps of others."""
    found = np.arange(len(position)) - 1
    open_ = np.flatnonzero(found >= 0)
    while len(open_):
        open_ = open_[position[found[open_]] > position[open_]]
        found[open_] = found[found[open_]]
        open_ = open_[found[open_] >= 0]
    return found


def longest_factors(levels: list[tuple[int, np.ndarray]], data: np.ndarray, suffixes: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factor of each entry of the suffix order, `length` at most: the common prefix with the nearest
    entries, on either side, of smaller text position. With negated positions, the longest next factor."""
    best = np.zeros(len(suffixes), np.int64)
    before = nearest_smaller(position)
    after = len(position) - 1 - nearest_smaller(position[::-1])[::-1]
    for near, there in ((before, before >= 0), (after, after < len(position))):
        i = np.flatnonzero(there)
        best[i] = np.maximum(best[i], common_prefix(levels, data, suffixes[i], suffixes[near[i]], length))
    return best


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _worth_sorting(pieces: list[bytes], length: int) -> list[tuple[int, int]]:
    """For each piece the first and last string whose hash occurs again among all pieces, or (0, -1) if there is none.

    Unequal hashes prove that strings differ, so that no repeated string is left out.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    c = prefix_sums(data)
    _, down = POWERS(len(data) + 1)
    hashes = (c[length:] - c[:-length]) * down[: len(data) - length + 1]
    count = sizes - length + 1
    begin, ends = np.cumsum(sizes) - sizes, np.cumsum(count)
    start = np.repeat(begin - (ends - count), count) + np.arange(int(ends[-1]))
    own = mix(hashes[start])
    order = np.argsort(own)
    same = np.diff(own[order]) == 0
    again = np.zeros(len(own), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    found = np.flatnonzero(again)
    lo, hi = np.searchsorted(found, ends - count), np.searchsorted(found, ends)
    return [(int(found[x] - e + n), int(found[y - 1] - e + n)) if y > x else (0, -1) for x, y, e, n in zip(lo, hi, ends, count)]


def repeated_in(pieces: list[bytes], order: np.ndarray, length: int, keep: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each piece the runs of its strings that start elsewhere too (keep="none"), or earlier ("first").

    order: the text order of the pieces. Only those parts of the pieces are sorted that hold strings with equal hashes.
    """
    worth = _worth_sorting(pieces, length)
    chosen = [k for k, (x, y) in enumerate(worth) if y >= x]
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    out = [none] * len(pieces)
    if chosen:
        rank = np.empty(len(pieces), np.int64)
        rank[order] = np.arange(len(pieces))
        parts = [pieces[k][worth[k][0] : worth[k][1] + length] for k in chosen]
        for k, (a, b) in zip(chosen, _repeated_in(parts, np.argsort(rank[chosen]), length, keep)):
            out[k] = (a + worth[k][0], b + worth[k][0])
    return out


def _repeated_in(pieces: list[bytes], order: np.ndarray, length: int, keep: str) -> list[tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    levels, rank = suffix_ranks(data, length)
    begin = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    ends = np.cumsum(count)
    owner = np.repeat(np.arange(len(pieces)), count)
    start = np.arange(int(ends[-1])) - (ends - count)[owner]
    place = np.empty(len(pieces), np.int64)
    place[order] = np.arange(len(pieces))
    position = place[owner] * (int(sizes.max()) + 1) + start
    suffixes = begin[owner] + start
    by = np.lexsort((position, rank[suffixes]))
    factor = longest_factors(levels, data, suffixes[by], position[by], length)
    if keep == "none":
        factor = np.maximum(factor, longest_factors(levels, data, suffixes[by], -position[by], length))
    flags = np.empty(len(by), bool)
    flags[by] = factor >= length
    return [_runs(flags[ends[k] - count[k] : ends[k]]) for k in range(len(pieces))]


def _sorted_groups(rows: DataFrame, length: int, keep: str) -> DataFrame:
    """From pieces of territories (key, anchor, whole, at, id, version, first, piece), those of a key side by side:
    anchor, whole, firsts, lasts, where places count from the start of the territory."""

    def flush(held: dict[tuple, dict]) -> pa.RecordBatch:
        own = list(held.values())
        order = np.array(sorted(range(len(own)), key=lambda i: (own[i]["id"] is not None, own[i]["id"] or 0, own[i]["version"], own[i]["first"])))
        runs = repeated_in([h["piece"] for h in own], order, length, keep)
        return pa.RecordBatch.from_arrays(
            [pa.array([h[k] for h in own], pa.int64()) for k in ("anchor", "whole")] + [pa.array([(r[k] + h["at"]).tolist() for h, r in zip(own, runs)], pa.list_(pa.int64())) for k in (0, 1)],
            names=["anchor", "whole", "firsts", "lasts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = {}, 0, None
        for b in batches:
            for i in range(0, b.num_rows, 512):
                for h in b.slice(i, 512).to_pylist():
                    if size >= SORTED_BYTES and h["key"] != last:
                        yield flush(held)
                        held, size = {}, 0
                    # documents that repeat bring their territories again
                    held[h["anchor"], h["whole"], h["at"]] = h
                    size, last = size + len(h["piece"]), h["key"]
        if held:
            yield flush(held)

    # a fixed number of tasks: sorting takes long for its bytes, so that small partitions must not be joined up
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "anchor", "whole", "at", "id", "version", "first", "piece").repartition(tasks, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "anchor long, whole long, firsts array<long>, lasts array<long>").where(F.size("firsts") > 0)


def parts_of(shift: np.ndarray, sizes: np.ndarray, width: int, length: int) -> tuple[np.ndarray, ...]:
    """Each piece's strings, parted by their distance from the anchor, `width` distances a part: piece, number of the
    part, first and last string, and first and last byte (exclusive) of what all strings of the part have in common.

    shift: the distance of each piece's first string; sizes: bytes of the pieces.
    """
    n = sizes - length + 1
    low, high = (shift - n + 1) // width, shift // width
    count = high - low + 1
    piece = np.repeat(np.arange(len(n)), count)
    part = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + low[piece]
    first = np.maximum(0, shift[piece] - (part + 1) * width + 1)
    last = np.minimum(n[piece] - 1, shift[piece] - part * width)
    start = shift[piece] - part * width
    return piece, part, first, last, start, start - width + 1 + length


def _parted(rows: DataFrame, width: int, length: int) -> DataFrame:
    """Pieces, parted: as they are, with the key of the bytes in common and the hash of their own (`same`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                held = b.slice(i, 512)
                raw = held.column("piece").to_pylist()
                sizes = np.array([len(x) for x in raw], np.int64)
                data = np.frombuffer(b"".join(raw), np.uint8)
                begin = np.cumsum(sizes) - sizes
                shift, key, at, start = (held.column(k).to_numpy() for k in ("shift", "key", "at", "first"))
                piece, part, first, last, lo, hi = parts_of(shift, sizes, width, length)
                hashed = lambda x, y, *keys: np.array([digest64(data[p:q].tobytes(), *more) for p, q, *more in zip(x, y, *(k.tolist() for k in keys))], np.int64)
                s, e, x, y = begin[piece] + first, begin[piece] + last + length, begin[piece] + lo, begin[piece] + hi
                common = hashed(x, y, part + (1 << 20), key[piece] & 0x7FFFFFFFFFFFFFFF)
                same = hashed(s, e, shift[piece] - first + (1 << 20))
                took = pa.array(piece)
                yield pa.RecordBatch.from_arrays(
                    [held.column(k).take(took) for k in ("anchor", "whole", "id", "version")]
                    + [pa.array(z) for z in (start[piece] + first, at[piece] + first, shift[piece] - first, common, same)]
                    + [pa.array([data[p:q].tobytes() for p, q in zip(s, e)], pa.binary())],
                    names=["anchor", "whole", "id", "version", "first", "at", "shift", "key", "same", "piece"],
                )

    return rows.mapInArrow(run, "anchor long, whole long, id long, version long, first long, at long, shift long, key long, same long, piece binary")


def _dealt_again(rows: DataFrame, length: int, width: int, keep: str, crowd: int, tables: Scratch) -> list[DataFrame]:
    """Runs (anchor, whole, firsts, lasts) of the pieces of crowded anchors."""
    out, place = [], F.struct(F.col("id").isNotNull().alias("named"), "id", "version", "first")
    while width > 1 and not rows.isEmpty():
        width = -(-width // PARTS)
        parts = tables.keep(_parted(rows, width, length))
        groups = tables.keep(parts.groupBy("key", "same").agg(F.count("*").alias("copies"), F.min(place).alias("least")))
        kinds = tables.keep(groups.groupBy("key").agg(F.count("*").alias("kinds")))
        groups = tables.keep(groups.join(kinds, "key").where("copies > 1 OR kinds > 1"))
        members = tables.keep(parts.join(groups, ["key", "same"]))
        every = F.col("copies") > 1
        if keep == "first":
            every = every & (place != F.col("least"))
        last = F.col("at") + F.octet_length("piece") - length
        out.append(members.where(every).select("anchor", "whole", F.array("at").alias("firsts"), F.array(last).alias("lasts")))
        heads = members.where((place == F.col("least")) & (F.col("kinds") > 1))
        out.append(_sorted_groups(heads.where(F.col("kinds") <= crowd), length, keep))
        rows = heads.where(F.col("kinds") > crowd)
    return out


def _keyed(docs: DataFrame, text: Column, doc_id: Column, *others: Column) -> DataFrame:
    t = F.coalesce(text.cast("string"), F.lit(""))
    return docs.select(*others, doc_id.try_cast("long").alias("id"), t.alias("text")).withColumn("version", F.xxhash64("text"))


def repeated_spans(docs: DataFrame, length: int = 400, keep: str = "none", text: str = "text", doc_id: str = "doc_id", crowd: int = 1024) -> DataFrame:
    """id, version (a hash of the text), starts, ends: byte spans to remove, for documents that have any.

    The spans of a document may overlap; each is a run of strings of `length` bytes that also start elsewhere
    (keep="none"), or earlier in the order of id, version and place (keep="first", which leaves the first copy).
    """
    gram = max(8, length // 6)
    keyed = _keyed(docs, F.col(text), F.col(doc_id))
    tables = Scratch(docs.sparkSession)
    try:
        return _repeated_spans(keyed, length, gram, keep, crowd, tables)
    finally:
        tables.drop()


def _repeated_spans(keyed: DataFrame, length: int, gram: int, keep: str, crowd: int, tables: Scratch) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data, _ = utf8(b.column(1))
            for i, j in spans(offsets):
                row, place, first, last, anchor, whole = territories(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], length, gram)
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(2).take(at), pa.array(first), pa.array((last - first).astype(np.int32)), pa.array((place - first).astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64))],
                    names=["id", "version", "first", "more", "shift", "anchor", "whole"],
                )

    found = keyed.select("id", "text", "version").mapInArrow(run, "id long, version long, first long, more int, shift int, anchor long, whole long")
    # Tables between the steps: joins then deal both sides anew, and Spark can split an anchor with many occurrences.
    every = tables.keep(found, "every")
    repeated = tables.keep(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    found = tables.keep(every.join(repeated, "anchor"))
    tables.drop("every")
    place = F.struct(F.col("id").isNotNull().alias("named"), "id", "version", "first")
    distinct = tables.keep(found.groupBy("anchor", "whole").agg(F.count("*").alias("copies"), F.min(place).alias("head"), F.first("more").alias("more"), F.first("shift").alias("shift")))
    sizes = tables.keep(distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    various = distinct.join(sizes, "anchor").select("anchor", "whole", "kinds", "shift", "more", "head.*")
    wanted = various.groupBy("id", "version").agg(F.collect_list(F.struct("anchor", "whole", "kinds", "shift", "more", "first")).alias("wanted"))
    bytes_of = keyed.select(F.col("id").alias("_id"), F.col("version").alias("_version"), "text")
    same = lambda x: F.col("_id").eqNullSafe(x["id"]) & (F.col("_version") == x["version"])
    fetched = wanted.join(bytes_of, same(wanted)).select("id", "version", F.col("text").cast("binary").alias("raw"), F.explode("wanted").alias("w"))
    piece = F.substring("raw", F.col("w.first").cast("int") + 1, F.col("w.more") + length).alias("piece")
    pieces = tables.keep(fetched.select("id", "version", "w.anchor", "w.whole", "w.kinds", "w.first", F.col("w.shift").cast("long").alias("shift"), F.col("w.anchor").alias("key"), F.lit(0).cast("long").alias("at"), piece))
    crowded = pieces.where(F.col("kinds") > crowd).dropDuplicates(["anchor", "whole"])
    runs = _sorted_groups(pieces.where(F.col("kinds") <= crowd), length, keep)
    for more in _dealt_again(crowded, length, length - gram + 1, keep, crowd, tables):
        runs = runs.union(more)
    # one row for each territory: no more runs than it has strings
    runs = tables.keep(runs).groupBy("anchor", "whole").agg(F.flatten(F.collect_list("firsts")).alias("firsts"), F.flatten(F.collect_list("lasts")).alias("lasts"))
    known = tables.keep(distinct.join(runs, ["anchor", "whole"], "left").where("copies > 1 OR firsts IS NOT NULL").select("anchor", "whole", "copies", "head", "firsts", "lasts"))
    occurrences = found.join(known, ["anchor", "whole"])
    all_ = F.col("copies") > 1
    if keep == "first":
        all_ = all_ & (place != F.col("head"))
    starts = F.when(all_, F.array("first")).otherwise(F.transform("firsts", lambda x: x + F.col("first")))
    ends = F.when(all_, F.array(F.col("first") + F.col("more") + length)).otherwise(F.transform("lasts", lambda x: x + F.col("first") + length))
    # one row for each document: no more spans than it has bytes
    listed = occurrences.select("id", "version", starts.alias("s"), ends.alias("e")).where(F.size("s") > 0)
    return cut(listed.groupBy("id", "version").agg(F.flatten(F.collect_list("s")).alias("starts"), F.flatten(F.collect_list("e")).alias("ends")))


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Spans in order, joined where they touch."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _within(docs: DataFrame, found: DataFrame, length: int, text: str, doc_id: str, crowd: int) -> DataFrame:
    """As repeated_spans(docs, length), given the spans of a lesser length: a repeated string of `length` bytes lies in
    such a span wherever it starts, so that only spans of as many bytes are searched, as texts of their own."""
    tables = Scratch(docs.sparkSession)
    try:
        known = found.select(F.col("id").alias("_i"), F.col("version").alias("_v"), "starts", "ends")
        keyed = _keyed(docs, F.col(text), F.col(doc_id))
        met = keyed.join(known, F.col("id").eqNullSafe(F.col("_i")) & (F.col("version") == F.col("_v"))).select("id", "version", "text", "starts", "ends")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                offsets, data, _ = utf8(b.column("text"))
                for i, (s, e) in enumerate(zip(b.column("starts").to_pylist(), b.column("ends").to_pylist())):
                    long = [(x, y) for x, y in merged(s, e) if y - x >= length]
                    own = [data[offsets[i] + x : offsets[i] + y].tobytes() for x, y in long]
                    at = pa.array([i] * len(long), pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("version").take(at), pa.array([x for x, _ in long], pa.int64()), pa.array(own, pa.binary())], names=["id", "version", "start", "piece"])

        pieces = tables.keep(met.mapInArrow(run, "id long, version long, start long, piece binary").withColumn("place", F.xxhash64("id", "version", "start")))
        again = repeated_spans(pieces.select("place", "piece"), length, "none", "piece", "place", crowd)
        names = pieces.select("place", "id", "version", "start").distinct()
        moved = lambda c: F.transform(c, lambda x: x + F.col("start")).alias(c)
        own = again.select(F.col("id").alias("place"), "starts", "ends").join(names, "place").select("id", "version", moved("starts"), moved("ends"))
        return cut(own.groupBy("id", "version").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")]))
    finally:
        tables.drop()


def remove_repeats(docs: DataFrame, length: int = 400, keep: str = "none", text: str = "text", doc_id: str = "doc_id", whole_characters: bool = False, crowd: int = 1024, marked: int | None = None) -> DataFrame:
    """The rows of docs with all their columns as a struct `row`, and n_bytes, spans (start, end in bytes) and kept (binary).

    A null text is empty; texts shorter than `length` bytes lose nothing. Matches never cross documents. Ids are
    integers and may be null or repeat; rows with the same id and text are as many documents for keep="none" and
    one for keep="first". whole_characters: a character goes only with all its bytes, so that what is kept is UTF-8.
    marked: another length, whose repeated strings (by the same `keep`) are given as `passages` and not removed; where it
    is the lesser one, the search for `length` covers these passages only. An empty table gives no rows.
    """
    every = {"marked": repeated_spans(docs, marked, keep, text, doc_id, crowd)} if marked else {}
    nested = bool(marked) and marked <= length and keep == "none"
    every["starts"] = _within(docs, every["marked"], length, text, doc_id, crowd) if nested else repeated_spans(docs, length, keep, text, doc_id, crowd)
    named = {k: x.select(F.col("id").alias(f"_i_{k}"), F.col("version").alias(f"_v_{k}"), F.struct("starts", "ends").alias(f"_{k}")) for k, x in every.items()}
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    mine = docs.select(whole).select("row", F.col("row").getField(text).alias("t"), F.col("row").getField(doc_id).alias("i"))
    joined = _keyed(mine, F.col("t"), F.col("i"), F.col("row"))
    for k, found in named.items():
        joined = joined.join(found, F.col("id").eqNullSafe(F.col(f"_i_{k}")) & (F.col("version") == F.col(f"_v_{k}")), "left")
    spans_of = [F.col("_starts.starts").alias("starts"), F.col("_starts.ends").alias("ends")]
    others = [F.col("_marked.starts").alias("s2"), F.col("_marked.ends").alias("e2")] if marked else []
    joined = joined.select("row", "text", *spans_of, *others)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data, _ = utf8(b.column("text"))
            n, cuts, kept = np.diff(offsets), [], []
            for i, (s, e) in enumerate(zip(b.column("starts").to_pylist(), b.column("ends").to_pylist())):
                own = data[offsets[i] : offsets[i + 1]]
                here = merged(s or [], e or [])
                if whole_characters:
                    inner = (own & 0xC0) == 0x80
                    fit = []
                    for x, y in here:
                        while x < y and inner[x]:
                            x += 1
                        while y > x and y < len(own) and inner[y]:
                            y -= 1
                        fit += [(x, y)] * (x < y)
                    here = fit
                edges = [0, *[z for xy in here for z in xy], len(own)]
                kept.append(b"".join(own[edges[k] : edges[k + 1]].tobytes() for k in range(0, len(edges), 2)))
                cuts.append([{"start": x, "end": y} for x, y in here])
            out = [b.column("row"), pa.array(n), pa.array(cuts, span), pa.array(kept, pa.binary())]
            if marked:
                out.append(pa.array([[{"start": x, "end": y} for x, y in merged(s or [], e or [])] for s, e in zip(b.column("s2").to_pylist(), b.column("e2").to_pylist())], span))
            yield pa.RecordBatch.from_arrays(out, names=["row", "n_bytes", "spans", "kept", "passages"][: len(out)])

    row = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(run, f"row {row}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary" + (", passages array<struct<start:long,end:long>>" if marked else ""))


def drop_repeats(docs: DataFrame, length: int = 400, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs, in which the first copy of each repeated passage stays and later ones are taken out of the text.

    Every row stays, if with an empty text; a null text stays null. Rows with the same id and text are one document and
    keep the same text; equal texts under other ids keep theirs in the one of smallest id (nulls first). An empty table
    gives no rows. Only whole characters go.
    """
    out = remove_repeats(docs, length, "first", text, doc_id, whole_characters=True)
    kept = F.when(F.col("row").getField(text).isNull(), F.lit(None).cast("string")).otherwise(F.col("kept").cast("string"))
    return with_columns_of(out.select(*[kept.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]), docs.columns)
