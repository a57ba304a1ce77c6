"""Tokens, an inverted index and TF-IDF search, and sentiment by a lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-case words of at least `least` characters, in order, repeats included."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.filter(words, lambda w: F.length(w) >= least)


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring characters within runs of word characters, for scripts without blanks."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """term, doc_id, n, length: how often each term occurs in each document."""
    t = docs.select(doc_id, tokens(F.col(text)).alias("t"))
    e = t.select(doc_id, F.size("t").cast("long").alias("length"), F.explode("t").alias("term"))
    return e.groupBy("term", doc_id).agg(F.count("*").alias("n"), F.max("length").alias("length"))


def search(index: DataFrame, documents: Column | int, queries: DataFrame, k: int = 5, doc_id: str = "doc_id") -> DataFrame:
    """query, doc_id, score, rank by tf * idf, idf = ln((N + 1) / (df + 1)) + 1; a word that a query repeats counts
    as often. queries: query, text. Only postings of asked words are scored; df comes from the whole index."""
    asked = queries.select("query", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    relevant = index.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    df = relevant.groupBy("term").agg(F.count("*").alias("df"))
    n = documents if isinstance(documents, Column) else F.lit(documents)
    hits = relevant.join(df, "term").join(asked, "term")
    idf = F.log((n + 1) / (F.col("df") + 1)) + 1
    scored = hits.groupBy("query", doc_id).agg(F.round(F.sum(F.col("times") * F.col("n") / F.col("length") * idf), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), doc_id)).cast("long")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


#: Lexicon for the driver's English prose; callers pass their own.
POSITIVE, NEGATIVE, NEGATIONS = ["the", "with", "for"], ["and", "of"], ["not", "no"]


def _count(text: Column, words: list[str]) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\b(" + "|".join(words) + r")\b"), F.lit(1)))


def sentiment(text: Column, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE, negations: list[str] = NEGATIONS, window: int = 5) -> Column:
    """(positive - negative) / both, two digits; a negation within `window` characters before a word flips it."""
    t = F.lower(text)
    flipped = r"\b(" + "|".join(negations) + r")\b.{0," + str(window) + r"}?\b"
    f_pos = F.size(F.regexp_extract_all(t, F.lit(flipped + "(" + "|".join(positive) + r")\b"), F.lit(2)))
    f_neg = F.size(F.regexp_extract_all(t, F.lit(flipped + "(" + "|".join(negative) + r")\b"), F.lit(2)))
    p, n = _count(t, positive), _count(t, negative)
    up, down = p - f_pos + f_neg, n - f_neg + f_pos
    return F.bround(F.coalesce(F.try_divide((up - down).cast("double"), (up + down).cast("double")), F.lit(0.0)), 2)
