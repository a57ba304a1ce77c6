"""Token counts and alignments against the libraries and brute force, on any text and awkward rows."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from alphaloom.llm import alignment, bpe, queries, token_counts

MODEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"
DEFAULT, PLAIN, SECOND = Tokenizer.from_file(MODEL), Tokenizer.from_file(MODEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
PLAIN.encode_special_tokens = True
ANY = st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from("aab  \n\t'▁é<|>"), max_size=80) | st.sampled_from(["a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<s>", "<0x41>", " a  b ", "aaaaaaaaa" * 30])
ODD = [(None, "a b"), (7, None), (7, ""), (8, " "), (8, "  "), (9, "a▁b"), (10, "x" * 30_000), (11, "日本語 emoji 😀 é́\x00"), (12, "word " * 40_000), (13, "a<|endoftext|> b <s>"), (14, "".join(random.Random(1).choice("qjzxe") for _ in range(5_000))), (15, "   lead and trail   "), (15, "   lead and trail   "), (16, "\n a\n  \n")]
SCHEMA = "doc_id long, text string, uid string, groups string, n_bytes string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*x, "u", "g", "n") for x in ODD], SCHEMA).repartition(3)


@settings(max_examples=60, deadline=None)
@given(st.lists(ANY, min_size=1, max_size=12))
def test_counts_of_any_text(rows):
    assert token_counts.counter(MODEL).count(rows).tolist() == [len(e.ids) for e in DEFAULT.encode_batch(rows, add_special_tokens=False)]


def test_counts_start_afresh():
    c = token_counts.Counter(MODEL, kept=50)
    rows = ["".join(random.Random(i).choice("abc de") for _ in range(60)) for i in range(200)]
    got = [n for i in range(0, 200, 10) for n in c.count(rows[i : i + 10]).tolist()]
    assert got == [len(e.ids) for e in DEFAULT.encode_batch(rows, add_special_tokens=False)] and len(c.known) < 400


def test_surviving_is_the_replay():
    m = token_counts.counter(MODEL).merges
    words = [("aab" * 7 + "é" * 5).encode(), b"", b"x", b"====" * 33, "日本".encode() * 9, bytes(range(256))]
    want = [len(bpe.encode_alone(w, m.ranks)) for w in words]
    assert token_counts.surviving(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]), m).tolist() == want


@pytest.mark.parametrize("source", ["odd", "table"])
def test_counts(spark, odd, source):
    docs = odd if source == "odd" else spark.read.parquet(f"{SMALL}/documents.parquet")
    out = token_counts.count_tokens(docs, MODEL) if source == "odd" else queries.op13_token_counts(spark, SMALL)
    want = [(r.doc_id, len((r.text or "").encode()), len(DEFAULT.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(str((*w, w[2] > 1024)) for w in want)
    assert token_counts.count_tokens(docs.limit(0), MODEL).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(ANY, min_size=1, max_size=12))
def test_words_of_any_text(rows):
    both = alignment.pair_of(MODEL, PIECES)
    (first, second), fine = both.encode(rows)
    for (ids, counts), own in ((first, [PLAIN.encode(" " + t, add_special_tokens=False).ids for t in rows]), (second, [SECOND.encode(t) for t in rows])):
        ends = np.cumsum(counts)
        for t, ok, e, n, want in zip(rows, fine, ends, counts, own):
            if ok and t:
                assert ids[e - n : e].tolist() == want
    for t, ok in zip(rows, fine):
        assert t == "" or ok == (b"".join(both.bytes[k] for k in SECOND.encode(t)) == (" " + t).encode())


def test_words_start_afresh():
    both = alignment.Pair(MODEL, PIECES, kept=40)
    rows = [" ".join("".join(random.Random(i * 7 + k).choice("abcü") for _ in range(4)) for k in range(15)) + "z" * (300 * (i % 9 == 0)) for i in range(60)]
    got = [both.encode(rows[i : i + 5])[0] for i in range(0, 60, 5)]
    assert [i for (_, (ids, _)) in got for i in ids.tolist()] == [i for t in rows for i in SECOND.encode(t)] and len(both.place) < 200


def brute(rows):
    spell = (bpe.ranks(MODEL).bytes, alignment.pair_of(MODEL, PIECES).bytes)
    docs, count = [], collections.Counter()
    for i, text in rows:
        ids = (PLAIN.encode(" " + text, add_special_tokens=False).ids, SECOND.encode(text)) if text else ([], [])
        if any(b"".join(s[k] for k in x) != (" " + text).encode() for s, x in zip(spell, ids) if text):
            ids = ([], [])
        ends = [np.cumsum([len(s[k]) for k in x]).astype(int) for s, x in zip(spell, ids)]
        cuts = np.intersect1d(*ends)
        at = [np.searchsorted(e, cuts, "right").tolist() for e in ends]
        groups = [(ids[0][a:b], ids[1][c:d]) for a, b, c, d in zip([0, *at[0]], at[0], [0, *at[1]], at[1])]
        docs.append((i, len(ids[0]), len(ids[1]), groups))
        count.update({(x, y) for a, b in groups for x in a for y in b})
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for i, n, m, groups in docs:
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, n, m, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if n else ""))
    return sorted(map(str, out))


@pytest.mark.parametrize("common", [0, 3, 1 << 16])
def test_alignment(spark, odd, common):
    digest = F.when(F.size("cuts") > 0, F.sha2(alignment.spelled(), 256)).otherwise("")
    got = alignment.align(odd, MODEL, PIECES, common=common, groups_sha256=digest)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(ODD)


def test_alignment_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(str(tuple(r)) for r in queries.op12_alignment(spark, SMALL).collect()) == brute(docs)


def test_alignment_gives_groups(spark, odd):
    rows = alignment.align(odd, MODEL, PIECES).where("doc_id = 15").collect()
    assert len(rows) == 2 and [list(g.a) for g in rows[0].groups] and sum(len(g.b) for g in rows[0].groups) == rows[0].n_b
    assert alignment.align(odd.limit(0), MODEL, PIECES).count() == 0


def test_alignment_takes_a_word_once(spark):
    rows = spark.createDataFrame([(i, "some words, words some.") for i in range(50)], "doc_id long, text string").coalesce(1)
    (chunk,) = alignment.tokens(rows, MODEL, PIECES).collect()
    assert len(chunk.docs) == 50 and all(len(d.words) == 6 for d in chunk.docs) and len(chunk.words) == 4


def test_words_that_come_again_stay():
    both = alignment.Pair(MODEL, PIECES, kept=60)
    often = ["again,", "often", "word.", "dogs'", "don't"]
    for i in range(30):
        texts = [" ".join([*often, *("".join(random.Random(i * 50 + k).choice("abcü") for _ in range(5)) for k in range(20))])]
        numbers, each, totals, words, *_ = both.dictionary(texts)
        (a, n), (b, m) = words
        ids = [np.split(x, np.cumsum(c)[:-1]) for x, c in ((a, n), (b, m))]
        for side, want in enumerate((PLAIN.encode(" " + texts[0], add_special_tokens=False).ids, SECOND.encode(texts[0]))):
            assert np.concatenate([ids[side][k] for k in numbers]).tolist() == want and totals[side].tolist() == [len(want)]
    assert "often" in both.place and len(both.fine) < 130
