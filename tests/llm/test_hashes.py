"""Texts made so that sums of powers modulo 2**64 can't tell them apart, and ids that are not integers."""

import public_tokenizers
import pytest

from alphaloom.llm import ann, bpe, minhash, suffix_dedup, warc

PAIR = str.maketrans("ab", "ba")


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_near_words(spark, n):
    word = thue_morse(n)
    docs = spark.createDataFrame([(1, word), (2, word.translate(PAIR)), (3, word)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, size=4).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("crowd", [1, 1024])
def test_suffix_words(spark, crowd):
    word = thue_morse(1500)
    rows = [(1, "x" * 40 + word), (2, "x" * 40 + word.translate(PAIR)), (3, word[200:700])]
    from tests.llm.test_llm import brute_spans

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = dict(zip((1, 2, 3), brute_spans([t.encode() for _, t in rows], 120, "none")))
    assert {r.row.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix_dedup.remove_repeats(docs, 120, "none", crowd=crowd).collect()} == want


def test_pretokens():
    e = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    word = thue_morse(2048)
    other = word.translate(PAIR)
    ids, counts = e.encode([word, other, word])
    assert bpe.decode(ids, e.ranks).tobytes().decode() == word + other + word and counts[0] == counts[2]


def test_textual_ids(spark):
    docs = spark.createDataFrame([("doc-a", "one two three four five"), ("7", "one two three four five"), ("8", "one two three four five")], "doc_id string, text string")
    rows = minhash.near_duplicates(docs).collect()
    assert sorted((str(r.component_id), r.kept) for r in rows) == [("7", False), ("7", True), ("None", True)]
    assert sorted(r.doc_id for r in minhash.keep_first(docs).collect()) == ["7", "doc-a"]
    assert suffix_dedup.drop_repeats(docs, 16).count() == 3
    vectors = spark.createDataFrame([("v", [1.0, 2.0]), ("100", [1.0, 2.0]), ("2", [1.0, 3.0])], "vec_id string, embedding array<double>")
    assert [r.vec_id for r in ann.nearest(vectors, vectors.where("vec_id = '100'"), k=3).collect()] == [2]
    pages = spark.createDataFrame([("p", "u", "<p>" * 60), ("1", "u", "<p>" * 60), ("2", "u", "<p>" * 60)], "page_id string, url string, html string")
    assert sorted(r.record_type for r in warc.read(warc.write(pages)).collect()) == ["response", "response", "revisit"]


def test_search_within_passages(spark):
    """Two lengths at once give the same spans as each alone, multi-byte characters and repeated rows included."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(3)
    passages = ["".join(r.choice("aé b") for _ in range(n)) for n in (90, 130, 130, 400)]
    rows = [(i, "".join(r.choice("xyzü ") for _ in range(40)) + r.choice(passages)[r.randint(0, 20) :] + "".join(r.choice("xyz") for _ in range(30)) + r.choice(passages)) for i in range(40)]
    rows += [(None, rows[3][1]), (5, rows[5][1]), (50, None), (51, ""), (52, "w" * 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    as_rows = lambda df, c: sorted((str(x.i), str([tuple(s) for s in x[c]])) for x in df.select(F.col("row.doc_id").alias("i"), c).collect())
    both = suffix_dedup.remove_repeats(docs, 120, marked=60)
    assert as_rows(both, "spans") == as_rows(suffix_dedup.remove_repeats(docs, 120), "spans")
    assert as_rows(both, "passages") == as_rows(suffix_dedup.remove_repeats(docs, 60), "spans")
    assert sum(s != "[]" for _, s in as_rows(both, "spans")) > 20
    assert suffix_dedup.remove_repeats(docs.limit(0), 120, marked=60).count() == 0
