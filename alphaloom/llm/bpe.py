"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are split into pre-tokens, and what is encoded is the vocabulary of distinct ones. An inverted index leads from
each token pair, named by the rank of its merge, to the positions where it stands in the vocabulary. Merges are applied
in rank order, each at all its positions, and only the neighbours of a merged pair enter the index anew. Documents are
then written from the encoded vocabulary. A worker keeps the vocabulary that it has encoded, within a bound, for the
batches to come; nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm import pretokens
from alphaloom.llm.shared import spans, utf8

#: Pre-tokens that a worker keeps encoded; when there are more, it starts afresh.
KEPT = 1_000_000


def _characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _model(path: str) -> tuple[dict[bytes, int], dict[int, int], list[dict[str, int]]]:
    """Tokens and merges of a tokenizers file, without its added tokens, and these in the order in which they are matched."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    of, special = _characters(), {t["content"] for t in whole["added_tokens"]}
    plain = lambda t: bytes(of[c] for c in t)
    vocabulary = whole["model"]["vocab"]
    merges, least = {}, -1
    for m in whole["model"]["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        new = vocabulary[a + b]
        if new < least:
            raise ValueError("the order of merges is not the order of ids")
        least = new
        merges[vocabulary[a] << 20 | vocabulary[b]] = new
    if any(t.get(k) for t in whole["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that look at their neighbours are not supported")
    added = [{t["content"]: t["id"] for t in whole["added_tokens"] if t["content"] and bool(t.get("normalized")) == late} for late in (False, True)]
    return {plain(t): i for t, i in vocabulary.items() if t not in special}, merges, [a for a in added if a]


class Ranks:
    """The tokens of a file and the merges that they allow, named by the id of the merged token.

    In a rank file two tokens merge if their bytes together are a token; a tokenizers file lists its merges. Its added
    tokens take part in no merge: texts are cut at them first, at the leftmost and there at the longest.
    """

    def __init__(self, path: str) -> None:
        listed, added = None, []
        if path.endswith(".json"):
            self.tokens, listed, added = _model(path)
        else:
            with open(path, "rb") as lines:
                self.tokens = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.added = {t: i for a in added for t, i in a.items()}
        self.cuts = [re.compile("(" + "|".join(map(re.escape, sorted(a, key=len, reverse=True))) + ")") for a in added]
        self.size = max([*self.tokens.values(), *self.added.values()]) + 1
        self.bytes = [b""] * self.size
        for token, rank in self.tokens.items():
            self.bytes[rank] = token
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.single = np.array([self.tokens[bytes([i])] for i in range(256)], np.int32)
        self.merges: dict[int, int] = {} if listed is None else listed
        for token, rank in self.tokens.items() if listed is None else ():
            for cut in range(1, len(token)):
                a, b = self.tokens.get(token[:cut]), self.tokens.get(token[cut:])
                if a is not None and b is not None:
                    self.merges[a << 20 | b] = rank
        self.first = np.full((256, 256), -1, np.int32)  # ranks of pairs of single bytes
        for i in range(256):
            for j in range(256):
                self.first[i, j] = self.merges.get(int(self.single[i]) << 20 | int(self.single[j]), -1)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.places = np.cumsum(self.lengths) - self.lengths

    def cut(self, text: str) -> list[str]:
        """Ordinary text (which may be empty) and added tokens by turns, the first and last ordinary."""
        out = [text]
        for c in self.cuts:
            out = [x for i, y in enumerate(out) for x in ([y] if i % 2 else c.split(y))]
        return out


@lru_cache(maxsize=4)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def encode_alone(word: bytes, r: Ranks) -> list[int]:
    """One pre-token: the leftmost pair of lowest rank merges, until none is left."""
    ids = [int(r.single[b]) for b in word]
    while len(ids) > 1:
        found = [(m, i) for i in range(len(ids) - 1) if (m := r.merges.get(ids[i] << 20 | ids[i + 1])) is not None]
        if not found:
            break
        rank, i = min(found)
        ids[i : i + 2] = [rank]
    return ids


def replay(words: list[bytes], r: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and how many each word has."""
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    if len(data) == 0:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    last = np.zeros(len(data), bool)
    last[ends[lengths > 0] - 1] = True
    pair = np.full(len(data), -1, np.int32)
    pair[:-1] = r.first[data[:-1], data[1:]]
    pair[last] = -1
    at = np.flatnonzero(pair >= 0)
    order = np.argsort(pair[at], kind="stable")
    at, found = at[order], pair[at][order]
    cuts = np.flatnonzero(np.diff(found, prepend=-1))
    index: dict[int, list[int]] = {int(found[c]): p.tolist() for c, p in zip(cuts, np.split(at, cuts[1:]))} if len(cuts) else {}
    heap = list(index)
    heapq.heapify(heap)
    symbol = r.single[data].tolist()
    following = (np.arange(1, len(data) + 1)).tolist()
    for i in np.flatnonzero(last).tolist():
        following[i] = -1
    previous = np.arange(-1, len(data) - 1)
    previous[1:][last[:-1]] = -1
    previous = previous.tolist()
    merges, starts, odd = r.merges.get, (ends - lengths).tolist(), set()
    while heap:
        rank = heapq.heappop(heap)
        for i in sorted(index.pop(rank)):
            a = symbol[i]
            if a < 0:
                continue
            j = following[i]
            if j < 0 or merges(a << 20 | symbol[j]) != rank:
                continue
            k = following[j]
            symbol[i], symbol[j], following[i] = rank, -1, k
            if k >= 0:
                previous[k] = i
                new = merges(rank << 20 | symbol[k])
                if new is not None:
                    if new in index:
                        index[new].append(i)
                    else:
                        index[new] = [i]
                        heapq.heappush(heap, new)
                    if new < rank:
                        odd.add(bisect_right(starts, i) - 1)
            h = previous[i]
            if h >= 0:
                new = merges(symbol[h] << 20 | rank)
                if new is not None:
                    if new in index:
                        index[new].append(h)
                    else:
                        index[new] = [h]
                        heapq.heappush(heap, new)
                    if new < rank:
                        odd.add(bisect_right(starts, h) - 1)
    ids = np.array(symbol, np.int32)
    alive = ids >= 0
    counts = np.add.reduceat(alive, np.minimum(ends - lengths, len(data) - 1)).astype(np.int64)
    counts[lengths == 0] = 0
    ids = ids[alive]
    if odd:  # a lower rank arose while a higher one was applied: such words are encoded alone
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for w in odd:
            parts[w] = np.array(encode_alone(words[w], r), np.int32)
        counts = np.array([len(p) for p in parts], np.int64)
        ids = np.concatenate(parts)
    return ids, counts


class Encoder:
    """Encodes texts, keeping the vocabulary met so far. Pre-tokens are recognised by a 128-bit hash."""

    def __init__(self, path: str, kept: int = KEPT) -> None:
        self.ranks, self.kept = ranks(path), kept
        self._clear()

    def _clear(self) -> None:
        self.one = self.two = np.zeros(0, np.uint64)
        self.at, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def encode(self, texts: list[str], special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has; without special, added tokens are plain text."""
        r = self.ranks
        if not special or not any(c.search(t) for c in r.cuts for t in texts):
            return self._ordinary(texts)
        pieces = [r.cut(t) for t in texts]
        ids, counts = self._ordinary([p for x in pieces for p in x[::2]])
        parts = np.array([len(x[::2]) for x in pieces])
        last = np.cumsum(parts) - 1
        ends, between = np.cumsum(counts), np.ones(len(counts), bool)
        between[last] = False
        ids = np.insert(ids, ends[between], [r.added[p] for x in pieces for p in x[1::2]])
        return ids, np.diff(ends[last], prepend=0) + parts - 1

    def _ordinary(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, begin, end, tokens = pretokens.split(texts)
        if len(begin) == 0:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        one, two = pretokens.keys(codes, begin, end)
        code, distinct = pd.factorize(one)
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        if len(self.one) + len(distinct) > self.kept:
            self._clear()
        if (two[first][code] != two).any():  # two pre-tokens share a first hash: keep them apart
            return self._plain(texts)
        place = np.searchsorted(self.one, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.one)
        known[inside] = self.one[place[inside]] == distinct[inside]
        if (self.two[place[known]] != two[first[known]]).any():
            return self._plain(texts)
        if not known.all():
            new = first[~known]
            kept = np.repeat(begin[new] - (np.cumsum(end[new] - begin[new]) - (end[new] - begin[new])), end[new] - begin[new]) + np.arange(int((end[new] - begin[new]).sum()))
            flat = codes[kept].tobytes().decode("utf-32-le", "surrogatepass")
            cuts = np.cumsum(end[new] - begin[new]).tolist()
            words = [flat[i:j].encode("utf-8", "surrogatepass") for i, j in zip([0, *cuts[:-1]], cuts)]
            ids, counts = replay(words, self.ranks)
            at = len(self.ids) + np.cumsum(counts) - counts
            self.ids = np.concatenate([self.ids, ids])
            both = np.concatenate([self.one, one[new]])
            order = np.argsort(both, kind="stable")
            self.one, self.two = both[order], np.concatenate([self.two, two[new]])[order]
            self.at, self.count = np.concatenate([self.at, at])[order], np.concatenate([self.count, counts.astype(np.int32)])[order]
            place = np.searchsorted(self.one, distinct)
        counts, at = self.count[place][code].astype(np.int64), self.at[place][code]
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(at - (ends - counts), counts) + np.arange(int(ends[-1]))]
        total = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(tokens)])]
        return ids, np.diff(total)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for t in texts:
            codes, begin, end, _ = pretokens.split([t])
            words = [codes[i:j].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass") for i, j in zip(begin, end)]
            out.append(replay(words, self.ranks)[0])
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def decode(ids: np.ndarray, r: Ranks) -> np.ndarray:
    """The bytes of the ids."""
    lengths = r.lengths[ids]
    ends = np.cumsum(lengths)
    if len(ids) == 0:
        return np.zeros(0, np.uint8)
    return r.flat[np.repeat(r.places[ids] - (ends - lengths), lengths) + np.arange(int(ends[-1]))]


def encoded(column: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows of a text column: first row, end, all ids one after another, and how many each row has."""
    offsets, data, _ = utf8(column)
    for i, j in spans(offsets):
        texts = [data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in range(i, j)]
        yield i, j, *encoder(path).encode(texts)


def binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column of the little-endian values, as many for each row as counts says."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * values.dtype.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", decoded: bool = False) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), and with `decoded` bytes (what the ids decode to).

    A row for each row of docs. A null or empty text has no ids. A rank file's special tokens are ordinary text; texts
    are cut at the added tokens of a tokenizers file, as that library does by default. Ids of documents may be null or
    repeat, and are passed on; no other column is read. An empty table gives no rows. path: a rank file, or a byte-level
    BPE model of the tokenizers library (.json), that every executor can read at that place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path)
        for b in batches:
            for i, j, ids, counts in encoded(b.column(1), path):
                out = [b.column(0).slice(i, j - i), binary(ids.astype("<u4"), counts)]
                if decoded:
                    ends = np.cumsum(r.lengths[ids])
                    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
                    out.append(binary(decode(ids, r), np.diff(bounds)))
                yield pa.RecordBatch.from_arrays(out, names=[doc_id, "ids", "bytes"][: len(out)])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.col(text).cast("string")).mapInArrow(run, f"`{doc_id}` {kind}, ids binary" + ", bytes binary" * decoded)


def decode_ids(rows: DataFrame, path: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, bytes (binary): ids (as encode() gives them) decoded; null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path)
        for b in batches:
            out = [decode(np.frombuffer(x.as_py() or b"", "<u4").astype(np.int64), r).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[doc_id, "bytes"])

    kind = rows.schema[doc_id].dataType.simpleString()
    return rows.select(doc_id, F.col(ids)).mapInArrow(run, f"`{doc_id}` {kind}, bytes binary")
