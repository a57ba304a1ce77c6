"""Packing by power-of-two decomposition.

A document's ids and an end id are cut into pieces whose lengths are powers of two, the longest first: as many whole
sequences as fit, then the binary digits of the rest. Each piece is a sequence of its own, in the bucket of its length,
so that no sequence crosses documents and none is padded; a trainer draws batches from one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.bpe import binary, encoded


def lengths(total: int, size: int) -> list[int]:
    """Powers of two, none over size, that add up to total, longest first."""
    out = [size] * (total // size)
    rest = total % size
    while rest:
        out.append(1 << rest.bit_length() - 1)
        rest -= out[-1]
    return out


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, length, ids (binary: little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, bucket.

    A row for each piece; size is a power of two. start: the document's ids before the piece; doc_tokens: its ids with
    the end id; offset: always 0; bucket: the logarithm of the length. A null or empty text is the end id alone. Ids of
    documents may be null or repeat, each row being a document; no other column is read. sequence_id is unique, and
    counts up within a partition of docs.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        for b in batches:
            for i, j, ids, counts in encoded(b.column(1), path):
                ends = np.cumsum(counts + 1)
                whole = np.full(int(ends[-1]), end_id, np.uint32)
                inside = np.ones(len(whole), bool)
                inside[ends - 1] = False
                whole[inside] = ids
                each = [lengths(int(n) + 1, size) for n in counts]
                n = np.concatenate(each).astype(np.int64)
                row = np.repeat(np.arange(j - i), [len(x) for x in each])
                before = np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i).take(pa.array(row)),
                        pa.array(before - (ends - counts - 1)[row]),
                        pa.array(n),
                        binary(whole, n),
                        pa.array((counts + 1)[row]),
                        pa.array(sequence + np.arange(len(n))),
                        pa.array(np.zeros(len(n), np.int64)),
                        pa.array(np.log2(n).astype(np.int32)),
                    ],
                    names=[doc_id, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket"],
                )
                sequence += len(n)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.col(text).cast("string")).mapInArrow(run, f"`{doc_id}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket int")
