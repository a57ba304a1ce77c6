"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids stand for one another.

Python tokenises a chunk's distinct words, at whose ends both tokenizers end a token, and gives their ids, the byte offsets
where tokens of each shape of word end, and documents as numbers of words. What follows is Spark's: array_intersect of the
two end arrays has the places where both end a token; a sort of ends and such places brings each place beside the tokens
that end there, which tells how many of either lie before; sequence, transform and zip_with cut a word's ids into groups
there and pair the ids of a group, once a chunk, and documents put the links of their words together.
Pairs are counted by document with a partial aggregate, and documents look up their pairs' counts: the
commonest pairs, a fixed number, from a broadcast, the others by a join on the pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alphaloom.llm import bpe, pretokens
from alphaloom.llm.shared import Scratch, cut, spans, utf8
from alphaloom.llm.token_counts import Merges, merged, utf8_of

#: Words that a worker keeps encoded from chunk to chunk, and characters of the longest word.
KEPT, LONGEST = 220_000, 256
#: Bytes of text whose distinct words are aligned together.
CHUNK = 3 << 20
#: White space and a space behind it.
_LOOSE = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
#: A word of letters with punctuation at its end, and a letter before punctuation.
_TAIL = regex.compile(r"(\p{L}+)([!-/:-@\[-^`{-~]+)")
_INNER = regex.compile(r"\p{L}[!-/:-@\[-^`{-~]")
#: Pairs that are broadcast with their counts: the commonest. All others are joined.
COMMON = 1 << 16
_MASK = (1 << 32) - 1


class Pair:
    """Encodes texts by two tokenizers, word by word: a word begins at a space that follows another character than white
    space, and goes with that space; punctuation after a word's letters is a part of its own.

    There the first tokenizer, whose pre-tokens start with a space but never end in one after a solid character, begins a
    pre-token, and no piece of the second has a space after another sign, so that no merge of either crosses it; a model
    with such a piece is an error. Nor do pre-tokens or pieces go from a letter to ASCII punctuation: words are parted
    there, unless a piece of the model does. Words are kept with their ids, within a bound.
    """

    def __init__(self, path_a: str, path_b: str, kept: int = KEPT) -> None:
        self.first, self.second, self.kept = Merges(bpe.ranks(path_a)), sentencepiece.SentencePieceProcessor(model_file=path_b), kept
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path_b} has pieces with a space after another sign: words can't be told apart")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = (self.first.ranks.lengths, np.array([len(b) for b in self.bytes], np.int64))
        self.flat, self.starts = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(self.lengths[1]) - self.lengths[1]
        self.space = self.second.piece_to_id("▁")
        self.parts = not any(_INNER.search(p) for i, p in enumerate(pieces) if not (self.second.is_byte(i) or self.second.is_control(i) or self.second.is_unknown(i)))
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        self.ids, self.ends, self.fine = [np.zeros(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2, np.zeros(0, bool)
        self.shapes: dict[tuple[int, bytes], int] = {}
        self.shape, self.seen, self.next = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _thin(self) -> None:
        """Forgets words that came in one call only, or all where the others are many."""
        stays = self.seen > 1
        sizes = [np.diff(e) for e in self.ends]
        if 4 * stays.sum() > 3 * self.kept or sum(int(n[stays].sum()) for n in sizes) > 8 * self.kept:
            self._clear()
            return
        new = np.cumsum(stays) - 1
        self.place = {w: int(new[k]) for w, k in self.place.items() if k <= _MASK and stays[k]}
        self.tails = {w: int(new[k]) for w, k in self.tails.items() if stays[k]}
        self.ids = [x[np.repeat(stays, n)] for x, n in zip(self.ids, sizes)]
        self.ends = [np.concatenate([[0], np.cumsum(n[stays])]) for n in sizes]
        self.fine, self.shape, self.seen = self.fine[stays], self.shape[stays], np.zeros(int(stays.sum()), np.int64)
        used = set(self.shape.tolist())
        self.shapes = {k: i for k, i in self.shapes.items() if i in used}

    @staticmethod
    def words(text: str) -> list[str]:
        """The words of a space and the text, each without its first space."""
        parts = text.split(" ")
        if not text.startswith(" ") and not any(x in text for x in _LOOSE):
            return parts
        out = [parts[0]]
        for p in parts[1:]:
            if out[-1] == "" or out[-1][-1].isspace():
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    def _meet(self, words: list[str]) -> None:
        """Learns new words; one of letters and punctuation as its two parts, if no piece has a letter before punctuation."""
        ends = [_TAIL.fullmatch(w) if self.parts and len(w) <= LONGEST else None for w in words]
        heads = dict.fromkeys(m[1] if m else w for w, m in zip(words, ends))
        tails = dict.fromkeys(m[2] for m in ends if m)
        if new := [w for w in heads if w not in self.place]:
            self._learn(new)
        if new := [w for w in tails if w not in self.tails]:
            self._learn(new, "a")
        for w, m in zip(words, ends):
            if m:
                self.place[w] = self.place[m[1]] | (self.tails[m[2]] + 1) << 32

    def _learn(self, words: list[str], after: str = "") -> None:
        """Tokens of words, or of what follows `after` in a word."""
        codes, begin, end, each = pretokens.split(words if after else [" " + w for w in words])
        ids, n = merged(*utf8_of(codes, begin, end), self.first)
        n = np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(each)])])
        skip = len(self.second.encode(after)) if after else 0
        found = [[self.space] if w == "" else i[skip:] for w, i in zip(words, self.second.encode([after + w for w in words], num_threads=1))]
        (self.tails if after else self.place).update(zip(words, range(len(self.fine), len(self.fine) + len(words))))
        m = np.fromiter(map(len, found), np.int64, len(found))
        both = ((ids, n), (np.fromiter(chain.from_iterable(found), np.int64, int(m.sum())), m))
        self.fine = np.concatenate([self.fine, self._spelled([w.encode() if after else b" " + w.encode() for w in words], *both[1])])
        self.shape = np.concatenate([self.shape, self._shapes(both)])
        self.seen = np.concatenate([self.seen, np.zeros(len(words), np.int64)])
        for k, (ids, n) in enumerate(both):
            self.ids[k] = np.concatenate([self.ids[k], ids.astype(np.int32)])
            self.ends[k] = np.concatenate([self.ends[k], self.ends[k][-1] + np.cumsum(n)])

    def _spelled(self, texts: list[bytes], ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which texts the second tokenizer's ids spell."""
        want, size = np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))
        have = np.add.reduceat(self.lengths[1][ids], np.cumsum(n) - n) if len(n) else n
        fine = size == have
        ids, want = ids[np.repeat(fine, n)], want[np.repeat(fine, size)]
        length = self.lengths[1][ids]
        at = np.cumsum(length)
        same = self.flat[np.repeat(self.starts[ids] - (at - length), length) + np.arange(len(want))] == want
        fine[np.repeat(np.flatnonzero(fine), size[fine])[~same]] = False
        return fine

    def _shapes(self, both: tuple) -> np.ndarray:
        """A number for each word: the same for words whose tokens have the same lengths."""
        (one, first), (two, second) = [(length[ids].astype(np.uint16).tobytes(), (2 * np.cumsum(n)).tolist()) for (ids, n), length in zip(both, self.lengths)]
        out, i, j = [], 0, 0
        for k, m in zip(first, second):
            key = (k - i, one[i:k] + two[j:m])
            shape = self.shapes.get(key)
            if shape is None:
                shape = self.shapes[key] = self.next
                self.next += 1
            out.append(shape)
            i, j = k, m
        return np.array(out, np.int64)

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The places of the words (and parts) of all texts one after another, how many each text has, and words to forget
        after use."""
        if max(len(self.fine), len(self.place)) > self.kept or len(self.ids[0]) + len(self.ids[1]) > 16 * self.kept:
            self._thin()
        offsets, codes, each, long = np.concatenate([[0], np.cumsum([len(t) for t in texts])]), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], set()
        for i, j in spans(offsets):
            words = [self.words(t) for t in texts[i:j]]
            counts = np.fromiter(map(len, words), np.int64, len(words))
            flat = list(chain.from_iterable(words))
            found = np.fromiter(map(self.place.get, flat, repeat(-1)), np.int64, len(flat))
            missing = np.flatnonzero(found < 0)
            if len(missing):
                words = [flat[k] for k in missing.tolist()]
                new = list(dict.fromkeys(words))
                self._meet(new)
                long.update(w for w in new if len(w) > LONGEST)
                found[missing] = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
            tail = (found >> 32) - 1
            both = np.stack([found & _MASK, tail], 1).ravel()
            codes.append(both[both >= 0].astype(np.int32))
            each.append(counts + per_row((tail >= 0).astype(np.int64), counts))
        return np.concatenate(codes), np.concatenate(each), list(long)

    def forget(self, words: list[str]) -> None:
        for w in words:
            del self.place[w]

    def _ranges(self, side: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places one after another, and how many each has."""
        ids, ends = self.ids[side], self.ends[side]
        n = ends[places + 1] - ends[places]
        to = np.cumsum(n)
        return ids[np.repeat(ends[places] - (to - n), n) + np.arange(int(n.sum()))], n

    def encode(self, texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each tokenizer the ids of all texts one after another, and how many each text has; and which texts the second
        spells with a space in front."""
        code, each, long = self.coded(texts)
        out = []
        for side in range(2):
            ids, n = self._ranges(side, code)
            out.append((ids, per_row(n, each)))
        self.forget(long)
        return out, per_row((~self.fine[code]).astype(np.int64), each) == 0

    def dictionary(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, list, np.ndarray]:
        """The distinct words of texts, and texts as numbers of words.

        numbers: of all texts' words; each: how many a text has; totals: rows of both tokenizers' tokens of a text, zero
        with no words where the second tokenizer does not spell it; words: ids and counts by tokenizer; shapes: ends of
        tokens and counts by tokenizer, of each distinct shape; shape: of each word.
        """
        code, each, long = self.coded(texts)
        fine = (per_row((~self.fine[code]).astype(np.int64), each) == 0) & np.fromiter(map(bool, texts), bool, len(texts))
        code, each = code[np.repeat(fine, each)], np.where(fine, each, 0)
        here = np.zeros(len(self.fine), bool)
        here[code] = True
        distinct = np.flatnonzero(here)
        self.seen[distinct] += 1
        totals = np.stack([per_row((e[1:] - e[:-1])[code], each) for e in self.ends])
        words = [self._ranges(side, distinct) for side in range(2)]
        _, of, shape = np.unique(self.shape[distinct], return_index=True, return_inverse=True)
        shapes = []
        for side in range(2):
            ids, n = self._ranges(side, distinct[of])
            shapes.append((_ends(self.lengths[side][ids], n), n))
        self.forget(long)
        return (np.cumsum(here) - 1)[code], each, totals, words, shapes, shape


def per_row(values: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Sums of so many values for each row."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(each)])])


@lru_cache(maxsize=2)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _ends(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Within each row, the running sums of lengths."""
    ends = np.cumsum(lengths)
    before = np.concatenate([[0], ends])[np.cumsum(counts) - counts]
    return ends - np.repeat(before, counts)


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def tokens(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each chunk of documents: docs (uid, id, n_a, n_b, words: numbers of its words from 0), words (a and b: ids,
    shape: a number from 0) and shapes (a_ends and b_ends: where the bytes of a word's tokens end).

    Words are the distinct ones of the chunk, and both tokenizers end a token where a word ends. path_a: a byte-level model
    of the tokenizers library, or a rank file, given a space and the text; path_b: a sentencepiece model that adds the
    space itself. Special tokens are not added, and their strings are plain text. A document whose text is null or empty, or
    whose tokens do not spell a space and the text, has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data, _ = utf8(b.column(2))
            for i, j in spans(offsets, CHUNK):
                texts = [data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in range(i, j)]
                numbers, each, totals, words, shapes, shape = pair_of(path_a, path_b).dictionary(texts)
                ints = lambda x: pa.array(x, pa.int32())
                found = (
                    ("uid", "id", "n_a", "n_b", "words"), [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *map(pa.array, totals), _lists(ints(numbers), each)],
                    ("a", "b", "shape"), [*[_lists(ints(x), n) for x, n in words], ints(shape)],
                    ("a_ends", "b_ends"), [_lists(ints(x), n) for x, n in shapes],
                )
                columns = [pa.StructArray.from_arrays(values, names) for names, values in zip(found[::2], found[1::2])]
                yield pa.RecordBatch.from_arrays([_lists(c, np.array([len(c)])) for c in columns], names=["docs", "words", "shapes"])

    kind, ints = docs.schema[doc_id].dataType, T.ArrayType(T.IntegerType(), False)
    many = lambda **fields: T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]), False)
    schema = T.StructType([
        T.StructField("docs", many(uid=T.LongType(), id=kind, n_a=T.LongType(), n_b=T.LongType(), words=ints)),
        T.StructField("words", many(a=ints, b=ints, shape=T.IntegerType())),
        T.StructField("shapes", many(a_ends=ints, b_ends=ints)),
    ])
    return docs.select(F.monotonically_increasing_id().alias("uid"), doc_id, F.col(text).cast("string")).mapInArrow(run, schema)


def _let(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """body(value), with value read or computed once: a lambda that names a column reads it anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cuts(a_ends: Column, b_ends: Column) -> Column:
    """For each place where both tokenizers end a token, how many tokens of the first (upper half of a long) and of the
    second (lower half) end up to it. A group lies between two cuts."""
    both = F.array_intersect(a_ends, b_ends)
    key = lambda e, i: F.shiftleft(e.cast("long"), 32).bitwiseOR(i.cast("long"))
    # in order: a place, then the first tokenizer's token that ends there, then the second's
    marked = F.sort_array(F.concat(F.transform(both, lambda e: key(e, F.lit(0))), F.transform(a_ends, lambda e, i: key(e, i + 1)), F.transform(b_ends, lambda e, i: key(e, i + 1 + (1 << 30)))))
    number = lambda x: x.bitwiseAND((1 << 30) - 1)
    at_place = lambda m: F.transform(m, lambda x, k: F.when(x.bitwiseAND(_MASK) == 0, F.shiftleft(number(F.get(m, k + 1)), 32).bitwiseOR(number(F.get(m, k + 2)))))
    return F.array_compact(_let(marked, at_place))


def _by_group(at: Column, body: Callable[..., Column], last: Column | None = None) -> Column:
    """body(the cut before, the cut after) of each group, and `last` after them all."""
    return F.zip_with(F.concat(F.array(F.lit(0).cast("long")), at), at, lambda x, y: F.when(y.isNotNull(), body(x, y)).otherwise(last))


def _first(x: Column) -> Column:
    return F.shiftright(x, 32).cast("int")


def _second(x: Column) -> Column:
    return x.bitwiseAND(_MASK).cast("int")


def _part(ids: Column, first: Column, end: Column) -> Column:
    return F.transform(F.sequence(first, end - 1), lambda i: F.get(ids, i))


def pair(a: Column, b: Column) -> Column:
    """Two ids as one number."""
    return F.shiftleft(a.cast("long"), 20).bitwiseOR(b.cast("long"))


def shape_of(a_ends: Column, b_ends: Column) -> Column:
    """plain: every group has one token of either, as in most words, n of them; full: otherwise, at: the cuts, pairs: which
    tokens of the first (upper half of a long) and of the second (lower half) share a group."""

    def of(x: Column, y: Column) -> Column:
        row = lambda p: F.transform(F.sequence(_second(x), _second(y) - 1), lambda q: F.shiftleft(p.cast("long"), 32).bitwiseOR(q.cast("long")))
        return F.flatten(F.transform(F.sequence(_first(x), _first(y) - 1), row))

    none = F.array().cast("array<bigint>")
    full = lambda at: F.struct(at.alias("at"), F.flatten(_by_group(at, of, none)).alias("pairs"))
    plain = a_ends == b_ends
    return F.struct(plain.alias("plain"), F.size(a_ends).alias("n"), F.when(~plain, _let(cuts(a_ends, b_ends), full)).alias("full"))


def links(a: Column, b: Column, shape: Column) -> Column:
    """The pairs of ids that share a group, an occurrence each; shape: shape_of() the tokens."""
    return F.when(shape["plain"], F.zip_with(a, b, pair)).otherwise(F.transform(shape["full"]["pairs"], lambda x: pair(F.get(a, _first(x)), F.get(b, _second(x)))))


def text_of(a: Column, b: Column, shape: Column) -> Column:
    """Groups as text: ids of a side with commas, sides with a bar, groups with semicolons."""

    def text(ids: Column, first: Column, end: Column) -> Column:
        return F.when(end - first == 1, F.get(ids, first).cast("string")).otherwise(F.array_join(_part(ids, first, end), ","))

    one = F.zip_with(a, b, lambda p, q: F.concat(p.cast("string"), F.lit("|"), q.cast("string")))
    many = _by_group(shape["full"]["at"], lambda x, y: F.concat(text(a, _first(x), _first(y)), F.lit("|"), text(b, _second(x), _second(y))))
    return F.array_join(F.when(shape["plain"], one).otherwise(many), ";")


def spelled() -> Column:
    """A document's groups as text_of() gives them."""
    return F.col("spelled")


def groups() -> Column:
    """The ids of each group as (a, b)."""
    side = lambda g, k: F.split(F.get(F.split(g, r"\|"), F.lit(k)), ",").cast("array<int>")
    return F.when(F.col("n_groups") == 0, F.array().cast("array<struct<a: array<int>, b: array<int>>>")).otherwise(F.transform(F.split("spelled", ";"), lambda g: F.struct(side(g, 0).alias("a"), side(g, 1).alias("b"))))


def aligned(chunks: DataFrame) -> DataFrame:
    """uid, _id, n_a, n_b, n_groups, links, spelled: a row for each document of tokens().

    Places where both tokenizers end a token depend on the lengths of a word's tokens only and are found once a shape, links
    and text once a word of the chunk; documents put those of their words together.
    """
    found = F.transform("shapes", lambda s: shape_of(s["a_ends"], s["b_ends"]))
    known = _let(found, lambda all_: F.transform("words", lambda w: _let(F.get(all_, w["shape"]), lambda x: F.struct(links(w["a"], w["b"], x).alias("links"), text_of(w["a"], w["b"], x).alias("text"), F.when(x["plain"], x["n"]).otherwise(F.size(x["full"]["at"])).alias("n")))))

    def of(words: Column, d: Column) -> Column:
        mine = F.transform(d["words"], lambda k: F.get(words, k))
        return _let(mine, lambda m: F.struct(d["uid"].alias("uid"), d["id"].alias("_id"), d["n_a"].alias("n_a"), d["n_b"].alias("n_b"), F.aggregate(m["n"], F.lit(0).cast("long"), lambda s, n: s + n).alias("n_groups"), F.flatten(m["links"]).alias("links"), F.array_join(m["text"], ";").alias("spelled")))

    return chunks.select(F.inline(_let(known, lambda words: F.transform("docs", lambda d: of(words, d)))))


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, n (documents that hold it in `links`) and best: no other pair of its first id is in more documents.

    A first id has no more pairs than the second tokenizer has ids, which bounds a window's rows.
    """
    counts = table.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 20)))
    return counts.select("pair", "n", (F.col("n") == most).cast("long").alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id", common: int = COMMON, **kept: Column) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum: a row for each row of docs; and the kept columns.

    Byte offsets where tokens of both tokenizers end cut a document into groups; a link is an occurrence of a token of
    either in one group. A pair's count is the number of documents (rows) that hold it linked. count_sum adds up the
    counts of a document's links, and n_best is how many of them have the highest count of their first id, ties
    included. kept: columns made of spelled and n_groups, as groups() and spelled() are, of a_ids and b_ids, or of cuts (how
    many tokens of either a group has, halves of a long); by default `groups`.

    A text that is null or empty, or that the tokens of either do not spell with a space in front (a sign that stands for
    the space, as U+2581), has no tokens: zeros and no groups. Ids of documents may be null or repeat, each row being a
    document; no other column is read, and their names may be any. An empty table gives no rows. A document's links are
    held in one row: a long text needs as many numbers as it has links.
    """
    tables = Scratch(docs.sparkSession)
    try:
        rows = aligned(tokens(docs, path_a, path_b, text, doc_id))
        parts = groups()
        for name, column in (("a_ids", F.flatten(parts["a"])), ("b_ids", F.flatten(parts["b"])), ("cuts", F.transform(parts, lambda g: F.shiftleft(F.size(g["a"]).cast("long"), 32).bitwiseOR(F.size(g["b"]).cast("long"))))):
            rows = rows.withColumn(name, column)
        kept = kept or {"groups": groups()}
        own = rows.select("uid", "_id", "n_a", "n_b", "n_groups", "links", *[c.alias(k) for k, c in kept.items()])
        table = tables.keep(own, "documents")
        counts = tables.keep(pair_counts(table), "counts")
        # the commonest are a fixed number of rows, whatever the size of the corpus
        often = tables.keep(counts.orderBy(F.desc("n"), "pair").limit(common), "common")
        linked = table.select("uid", F.explode("links").alias("pair"))
        total = [F.sum("n").alias("count_sum"), F.sum("best").alias("n_best")]
        scored = linked.join(F.broadcast(often), "pair").groupBy("uid").agg(*total)
        rare = tables.keep(counts.join(F.broadcast(often.select("pair")), "pair", "left_anti"), "rare")
        if not rare.isEmpty():
            others = linked.join(F.broadcast(often.select("pair")), "pair", "left_anti")
            scored = scored.union(others.join(rare, "pair").groupBy("uid").agg(*total))
        scored = scored.groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("count_sum", "n_best")])
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
        out = table.withColumn("n_links", F.size("links").cast("long")).drop("links").join(scored, "uid", "left")
        return cut(out.select(F.col("_id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), *kept))
    finally:
        tables.drop()
