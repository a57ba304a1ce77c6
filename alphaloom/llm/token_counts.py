"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a chunk lie one after another in one array of symbols, with their bounds. In every round each
sequence looks for its lowest-ranked pair and merges it at all places where it stands, all sequences at once; those
without a pair to merge leave. What remains of a sequence is counted, and no ids are written. A worker keeps the counts of
pre-tokens it has met, within a bound; nothing is shuffled.

A sequence is cut beforehand where two bytes meet that stand side by side in no token: no merge can cross such a place,
so that long sequences fall apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm import pretokens
from alphaloom.llm.bpe import Ranks, ranks
from alphaloom.llm.shared import mix, spans, utf8

#: Pre-tokens whose counts a worker keeps; when there are more, it starts afresh.
KEPT = 1_000_000
_NONE = np.int32((1 << 31) - 1)


class Merges:
    """The merges of a tokenizer as an open-addressed table: rank of a pair of symbols, or _NONE."""

    def __init__(self, r: Ranks) -> None:
        self.ranks = r
        pairs = np.array(list(r.merges), np.uint64)
        bits = int(4 * len(pairs)).bit_length()
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.full(1 << bits, _NONE, np.int32)
        left, values, self.probes = pairs, np.array(list(r.merges.values()), np.int32), 0
        while len(left):
            at = (mix(left) + np.uint64(self.probes)) & self.mask
            free = self.keys[at] == np.iinfo(np.uint64).max
            _, first = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[at[chosen]], self.values[at[chosen]] = left[chosen], values[chosen]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, values, self.probes = left[rest], values[rest], self.probes + 1
        flat = r.flat[: int(r.lengths.sum())]
        inner = np.ones(len(flat), bool)
        inner[r.places[r.lengths > 0]] = False
        self.meet = np.zeros((256, 256), bool)
        second = np.flatnonzero(inner)
        self.meet[flat[second - 1], flat[second]] = True

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint64) << np.uint64(20) | b.astype(np.uint64)
        at = mix(key)
        found = np.full(len(key), _NONE, np.int32)
        for k in range(self.probes):
            place = (at + np.uint64(k)) & self.mask
            hit = self.keys[place] == key
            found[hit] = self.values[place[hit]]
        return found


def merged(data: np.ndarray, lengths: np.ndarray, m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that sequences of bytes end with, one after another, and how many each has."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    counts = surviving(data, lengths, m, found)
    if not found:
        return np.zeros(0, np.int64), counts
    at, ids = (np.concatenate(x) for x in zip(*found))
    return ids[np.argsort(at)], counts


def utf8_of(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of pre-tokens (ranges of code points) one after another, and how many each has."""
    n = end - begin
    if len(n) == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    chosen = codes[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    data = np.frombuffer(chosen.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    # bytes of a code point: one, and one more from each of these on
    size = 1 + (chosen >= 0x80).astype(np.int64) + (chosen >= 0x800) + (chosen >= 0x10000)
    return data, np.add.reduceat(size, np.cumsum(n) - n)


def surviving(data: np.ndarray, lengths: np.ndarray, m: Merges, found: list | None = None) -> np.ndarray:
    """How many symbols each sequence of bytes ends with; sequences lie one after another in data. found: takes the places
    and ids of the symbols, as sequences end.

    The lowest rank of a sequence is merged at all its places, from left to right where they overlap; a merge makes no
    pair of a lower rank, as a token's parts are older than the token.
    """
    out = np.zeros(len(lengths), np.int64)
    if len(data) == 0:
        return out
    owner = np.repeat(np.arange(len(lengths)), lengths)
    symbol = m.ranks.single[data].astype(np.int64)
    start = np.ones(len(data), bool)
    start[1:] = (owner[1:] != owner[:-1]) | ~m.meet[data[:-1], data[1:]]
    rank = np.full(len(data), _NONE, np.int32)  # of the pair that begins at a place
    origin = np.arange(len(data)) if found is not None else None
    inside = np.flatnonzero(~start[1:])
    rank[inside] = m(symbol[inside], symbol[inside + 1])
    while True:
        begin = np.flatnonzero(start)
        least = np.minimum.reduceat(rank, begin)
        sizes = np.diff(np.append(begin, len(rank)))
        done = least == _NONE
        if done.any():
            np.add.at(out, owner[begin[done]], sizes[done])
            open_ = np.repeat(~done, sizes)
            if found is not None:
                found.append((origin[~open_], symbol[~open_]))
                origin = origin[open_]
            symbol, start, rank, owner = symbol[open_], start[open_], rank[open_], owner[open_]
            least, sizes = least[~done], sizes[~done]
            if len(symbol) == 0:
                return out
        hit = rank == np.repeat(least, sizes)
        at = np.flatnonzero(hit)
        # of places side by side (a sign three times or more) every second merges
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | start[at[1:]]
        run = np.flatnonzero(fresh)
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        symbol[at] = rank[at]
        stays = np.ones(len(symbol), bool)
        stays[at + 1] = False
        place = (np.cumsum(stays) - 1)[at]
        symbol, start, rank, owner = symbol[stays], start[stays], rank[stays], owner[stays]
        origin = origin[stays] if found is not None else None
        mark = np.zeros(len(symbol), bool)
        mark[place] = True
        mark[place[place > 0] - 1] = True
        changed = np.flatnonzero(mark)
        last = np.append(start[1:], True)
        rank[changed] = _NONE
        changed = changed[~last[changed]]
        rank[changed] = m(symbol[changed], symbol[changed + 1])


class Counter:
    """Counts the tokens of texts, keeping the counts of the pre-tokens met so far, which 128-bit hashes recognise."""

    def __init__(self, path: str, kept: int = KEPT) -> None:
        self.merges, self.kept = Merges(ranks(path)), kept
        self._clear()

    def _clear(self) -> None:
        self.known, self.two, self.n = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. Texts are cut at the model's added tokens, which count one each, as the library does."""
        r = self.merges.ranks
        cuts = [r.cut(t) if any(c.search(t) for c in r.cuts) else [t] for t in texts]
        parts = np.array([len(x) for x in cuts])
        plain = self._ordinary([p for x in cuts for p in x[::2]])
        first = np.cumsum((parts + 1) // 2) - (parts + 1) // 2
        return np.add.reduceat(plain, first) + parts // 2 if len(texts) else np.zeros(0, np.int64)

    def _ordinary(self, texts: list[str]) -> np.ndarray:
        codes, begin, end, each = pretokens.split(texts)
        if len(begin) == 0:
            return np.zeros(len(texts), np.int64)
        one, two = pretokens.keys(codes, begin, end)
        code, distinct = pd.factorize(one)
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        if len(self.known) + len(distinct) > self.kept:
            self._clear()
        place, found = self._find(distinct)
        if (two[first][code] != two).any() or (self.two[place[found]] != two[first[found]]).any():
            counts = self._fresh(codes, begin, end)  # two pre-tokens share a first hash: each is counted by itself
        else:
            if not found.all():
                new = first[~found]
                known = np.concatenate([self.known, one[new]])
                order = np.argsort(known, kind="stable")
                self.known, self.two = known[order], np.concatenate([self.two, two[new]])[order]
                self.n = np.concatenate([self.n, self._fresh(codes, begin[new], end[new])])[order]
                place, _ = self._find(distinct)
            counts = self.n[place][code]
        return np.diff(np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(each)])])

    def _find(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.known, distinct)
        found = place < len(self.known)
        found[found] = self.known[place[found]] == distinct[found]
        return place, found

    def _fresh(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return surviving(*utf8_of(codes, begin, end), self.merges)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8), n_tokens, over_limit (n_tokens > limit): a row for each row of docs.

    path: a byte-level BPE model of the tokenizers library (.json), at whose added tokens texts are cut as that library
    does by default, or a rank file; every executor can read it at that place. Whole texts are counted, without tokens
    added before or after. A null text is empty: no bytes and no tokens. Ids may be null or repeat, and are passed on; no
    other column is read. An empty table gives no rows. A pre-token of many thousand letters takes a round for each rank
    that it uses, over its remaining symbols.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data, _ = utf8(b.column(1))
            for i, j in spans(offsets):
                texts = [data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in range(i, j)]
                n = counter(path).count(texts)
                out = [b.column(0).slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(n), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays(out, names=[doc_id, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.col(text).cast("string")).mapInArrow(run, f"`{doc_id}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
