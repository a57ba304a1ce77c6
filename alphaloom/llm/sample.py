"""Bounded samples of labelled rows, to fit classifiers on. Only models come from them; scoring covers all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lowest_share(hashed: Column, share: Column) -> Column:
    """Whether a 64-bit hash is among the lowest `share` of all hashes."""
    return F.shiftrightunsigned(hashed, 11).cast("double") <= share * float(1 << 53)


def labelled(docs: DataFrame, labels: DataFrame, per_label: int, text: str = "text", doc_id: str = "doc_id", total_bytes: int = 1 << 25) -> list[tuple[object, str]]:
    """At most per_label (label, text) pairs of each label, in a fixed order: the rows whose hashed ids are smallest.

    labels: columns id and label, neither null; labels are classes, of which there are few. Rows without a text, or with
    an empty one, are not counted. An id that repeats counts once, with the smallest text. Texts are whole, however
    long; a label's sample ends where its texts would pass total_bytes, after one text at least. So what reaches the
    driver is bounded for each label. Only ids are broadcast: a few times per_label for each label.
    """
    known = labels.select("id", "label").where("id IS NOT NULL AND label IS NOT NULL")
    sizes = {r.label: r.total for r in known.groupBy("label").agg(F.count("*").alias("total")).collect()}
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where(F.octet_length("text") > 0)
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    factor, out, missing = 4.0, {}, list(sizes)
    while missing:
        # so few ids need joining; where too many of them lack a text, more are taken
        share = F.lit(0.0)
        for label in missing:
            share = F.when(F.col("label") == label, F.lit(min(1.0, factor * per_label / sizes[label]))).otherwise(share)
        candidates = known.where(lowest_share(F.xxhash64("id"), share)).distinct()
        found = texts.join(F.broadcast(candidates), "id").groupBy("label", "id").agg(F.min("text").alias("text"))
        ranked = found.withColumns({"rank": F.row_number().over(order), "bytes": F.sum(F.octet_length("text")).over(order), "n": F.count("*").over(Window.partitionBy("label"))})
        rows = ranked.where((F.col("rank") <= per_label) & ((F.col("bytes") <= total_bytes) | (F.col("rank") == 1))).select("label", "rank", "text", "n").collect()
        ends = {r.label: r.n for r in rows}
        for label in list(missing):
            if ends.get(label, 0) >= per_label or factor * per_label >= sizes[label]:
                out[label] = sorted((r["rank"], r.text) for r in rows if r.label == label)
                missing.remove(label)
        factor *= 8
    return [(label, text) for label in sorted(out, key=str) for _, text in out[label]]
