"""What several operators of this subpackage need: checkpoints, Arrow text columns, vectorised hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.session import new_dir, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that the vectorised operators handle at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 20


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


class Scratch:
    """Tables of one operator in the shared folder, as Parquet; drop() removes them when they have served.

    Shuffle files of the query that makes a table go as soon as it is written.
    """

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base, self.made = spark, new_dir(spark, "scratch"), 0

    def keep(self, df: DataFrame, name: str | None = None) -> DataFrame:
        self.made += 1
        path, before = f"{self.base}/{name or self.made}", self.spark.conf.get(self.CLEAN, "false")
        self.spark.conf.set(self.CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(self.CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str | None = None) -> None:
        """Removes the table of that name, or all."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does the same, faster, where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(column: Column, by: int) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % by


def with_columns_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of df in their order: what a pipeline stage passes on."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets (one more than rows), bytes and validity of a string column; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    valid = ~np.asarray(column.is_null())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8), valid
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]], valid


def spans(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes together, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as asked."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWERS = Powers(0x9E3779B97F4A7C15)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """c, so that (c[e] - c[s]) * inverse power s hashes data[s:e].

    Linear modulo 2**64: only where equal hashes are compared further, as some long strings share theirs by construction.
    """
    up, _ = POWERS(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=c[1:])
    return c


#: Bytes of a word that two lanes hold; longer ones are hashed by blake2b.
SHORT = 16
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def digest64(piece: bytes, *more: int) -> int:
    """A signed 64-bit part of the blake2b digest of the piece, keyed by further integers."""
    return int.from_bytes(hashlib.blake2b(piece, digest_size=8, person=b"".join(m.to_bytes(8, "little") for m in more)).digest(), "little", signed=True)


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z lower-cased, split at ASCII white space) and the number of words in each row.

    Words of up to 16 bytes are two 8-byte lanes, mixed one into the other with the length; longer ones are hashed by
    blake2b. Neither is linear in the bytes, so that no pattern of letters makes words of one hash.
    """
    n, rows = len(data), len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    solid = ~IS_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    folded = np.zeros(n + SHORT, np.uint8)
    folded[:n] = _FOLD[data]
    lanes = np.ndarray((n + 8,), "<u8", folded, 0, (1,))
    size = ends - starts
    hashes = mix((lanes[starts] & _KEEP[np.minimum(size, 8)]) + np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)
    two = np.flatnonzero((size > 8) & (size <= SHORT))
    hashes[two] += lanes[starts[two] + 8] & _KEEP[size[two] - 8]
    hashes = mix(hashes)
    for k in np.flatnonzero(size > SHORT).tolist():
        hashes[k] = digest64(folded[starts[k] : ends[k]].tobytes()) & 0xFFFFFFFFFFFFFFFF
    return hashes, np.diff(np.searchsorted(starts, offsets))
