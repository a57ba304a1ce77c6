"""Quality selection by importance resampling.

Words and pairs of neighbouring words are hashed into buckets. The shares of the buckets among texts labelled good
(target) and among all texts (raw) make two generative models; a document's log weight is the sum of the log ratios of
its buckets. Adding Gumbel noise to the weights and taking the k largest samples k documents without replacement in
proportion to their weights. Noise comes from a hash of the id, so that a run can be repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.shared import cut, mix, spans, utf8, words

BUCKETS = 10_000


def buckets(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of all rows, and the row of each."""
    h, counts = words(offsets, data)
    row = np.repeat(np.arange(len(counts)), counts)
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[row[:-1] == row[1:]] if len(h) > 1 else h[:0]
    return (np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([row, row[:-1][row[:-1] == row[1:]]])


def raw_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Bucket counts over all documents: a fixed number of them, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            offsets, data, _ = utf8(b.column(0))
            for i, j in spans(offsets):
                total += np.bincount(buckets(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])[0], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)], names=["bucket", "n"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(run, "bucket long, n long").where("n > 0").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS)
    for r in counted:
        out[r.bucket] = r.n
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", smoothing: float = 1.0) -> np.ndarray:
    """Log ratio of target to raw for each bucket. labels: id, label; texts of ids labelled 1 are the target.

    Either side covers all its texts. Null and empty texts count nothing, repeated rows each time, repeated labels once;
    without a target all ratios come from smoothing alone. Labels grow with the documents, so that the two meet by a
    sorted join at every size, in which Spark can split an id of many rows.
    """
    good = labels.where("label = 1 AND id IS NOT NULL").select(F.col("id").alias("_good")).distinct()
    target = raw_counts(docs.join(good.hint("merge"), docs[doc_id] == good["_good"], "left_semi"), text) + smoothing
    raw = raw_counts(docs, text) + smoothing
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratio: np.ndarray, text: str = "text", doc_id: str = "doc_id", seed: int = 1) -> DataFrame:
    """doc_id, log_weight, noisy (log_weight plus Gumbel noise): a row for each row of docs; no words give weight 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data, _ = utf8(b.column(1))
            out = []
            for i, j in spans(offsets):
                bucket, row = buckets(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
                out.append(np.bincount(row, ratio[bucket], j - i))
            weight = np.concatenate(out) if out else np.zeros(0)
            u = (mix(b.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)).astype(np.float64) + 0.5) / 2.0**64
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weight), pa.array(weight - np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16))))], names=[doc_id, "log_weight", "noisy"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.col(text).cast("string"), F.xxhash64(F.lit(seed), doc_id).alias("noise")).mapInArrow(run, f"`{doc_id}` {kind}, log_weight double, noisy double")


def largest(rows: DataFrame, column: str, k: int, bins: int = 4096) -> tuple[float, int]:
    """(value, more): the k-th largest value of the column, and how many rows with just that value belong to the top k.

    Histograms of a fixed number of bins narrow the range down until it holds one value; no row is collected.
    """
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    while lo < hi:
        width = (hi - lo) / bins
        if lo + width <= lo:  # neighbours in double precision: either lo or hi
            top = rows.where(F.col(column) >= hi).count()
            if top >= k:
                lo = hi
            else:
                hi = rows.where(F.col(column) < hi).agg(F.max(column)).first()[0]
                lo = max(lo, rows.where(F.col(column) <= hi).agg(F.max(column)).first()[0])
            continue
        inside = rows.where((F.col(column) >= lo) & (F.col(column) <= hi))
        above = rows.where(F.col(column) > hi).count()
        cell = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1))
        for r in sorted(inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("z")).collect(), key=lambda r: -r.cell):
            if above + r.n >= k:
                lo, hi = r.a, r.z
                break
            above += r.n
    return lo, k - rows.where(F.col(column) > lo).count()


def resample(docs: DataFrame, ratio: np.ndarray, share: float = 0.5, text: str = "text", doc_id: str = "doc_id", seed: int = 1) -> DataFrame:
    """doc_id, log_weight, noisy, selected: a row for each row of docs; share of them, rounded up, are selected.

    Rows with equal noisy weights at the edge are taken by smaller id (nulls first); repeated rows there count as one,
    so that as many more may be selected. Null and empty texts have weight 0. An empty table gives no rows.
    """
    rows = cut(weigh(docs, ratio, text, doc_id, seed))
    n = rows.count()
    k = min(n, math.ceil(n * share - 1e-9))
    if k <= 0:
        return rows.withColumn("selected", F.lit(False))
    edge, more = largest(rows, "noisy", k)
    ties = rows.where(F.col("noisy") == edge).count()
    selected = F.col("noisy") > edge
    if ties <= more:
        selected = F.col("noisy") >= edge
    else:
        last = rows.where(F.col("noisy") == edge).orderBy(F.col(doc_id).asc_nulls_first()).limit(more).agg(F.max(doc_id)).first()[0]
        selected = selected | (F.col("noisy") == edge) & (F.col(doc_id).isNull() | (F.lit(last) >= F.col(doc_id)))
    return rows.withColumn("selected", F.coalesce(selected, F.lit(False)))
