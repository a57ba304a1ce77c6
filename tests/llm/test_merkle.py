"""Manifests against a tree built row by row, at several block heights."""

import hashlib
import random
import zlib
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from alphaloom.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, grp string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """The root, and each leaf's levels of (siblings to the left, to the right)."""
    ways, level, groups = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        above, merged = [], []
        for i in range(0, len(level), 3):
            run = level[i : i + 3]
            for k in range(len(run)):
                for leaf in groups[i + k]:
                    ways[leaf].append((run[:k], run[k + 1 :]))
            above.append(h(*run))
            merged.append([x for g in groups[i : i + 3] for x in g])
        level, groups = above, merged
    return level[0], ways


def brute(rows):
    leaf = lambda r, text: h(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))
    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {s: tree([leaf(r, r.text) for r in sources[s]]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for r, way in zip(sources[s], trees[s][1]):
            bad = r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            node = leaf(r, r.text.replace("\n", "") if bad else r.text)
            for left, right in way + top:
                node = h(*left, node, *right)
            proof = h(*[x for left, right in way + top for x in left + right])
            out.append((str(r.doc_id), leaf(r, r.text), trees[s][0], root, proof, node, node == root))
    return sorted(out)


def run(docs, height=merkle.HEIGHT):
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = merkle.manifest(docs, merkle.leaf(*others, F.col("text")), merkle.leaf(*others, tampered), "source", ["doc_id"], height=height)
    assert set(docs.columns) < set(out.columns)
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("p"), "folded_root", "verified")
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest(spark, height):
    r = random.Random(2)
    rows = [(i, "line\n" * r.randint(0, 3) + "é" * r.randint(0, 5), "en", r.choice(["hot"] * 6 + ["a", "b", "é", "Z", "zz", None]), i, "x", "y") for i in range(300)]
    rows += [(1000 + k, "one\ntwo", None, f"s{k}", None, None, None) for k in range(11)]
    rows += [(None, None, None, None, None, None, None), (None, "", None, "hot", 0, None, None), (5, "a\n", "en", "hot", 1, None, None), (5, "b\n", "en", "hot", 1, None, None), (6, "w\n" * 200_000, "en", "a", 1, None, None)]
    rows += [(7, "same\n", "en", "hot", 1, "x", "y")] * 4
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert run(docs, height) == brute(docs.collect())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_few_rows(spark, n):
    docs = spark.createDataFrame([(i, "a\n", "en", "s", 1, "x", "y") for i in range(n)], SCHEMA)
    rows = docs.collect()
    assert run(docs) == (brute(rows) if n else [])


def test_query(spark):
    got = sorted(tuple(map(str, r)) for r in queries.op11_merkle(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(tuple(map(str, r)) for r in brute(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()))


def test_sql():
    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    rows = [SimpleNamespace(**dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r))) for r in c.sql("SELECT doc_id, source, lang, n_chars, text FROM documents").fetchall()]
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = c.sql(merkle.ORACLE_SQL).select(*names).fetchall()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows)
