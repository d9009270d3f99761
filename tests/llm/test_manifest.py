"""Merkle manifests against a tree built in memory."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from evenkeel.llm import merkle

DDL = "doc_id long, source string, lang string, n_chars long, text string, key int, row string, digest string, path string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree(leaves, fan):
    """The root, and of each leaf its siblings (before, after) by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, a in enumerate(at):
            run = a - a % fan
            paths[i].append(("".join(level[run:a]), "".join(level[a + 1:run + fan])))
        at = [a // fan for a in at]
        level = [h(*level[i:i + fan]) for i in range(0, len(level), fan)]
    return level[0], paths


def brute(rows, fan):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    subs, out = [], []
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        sub, paths = tree([leaf_of(r) for r in own], fan)
        subs.append((sub, own, paths))
    root, tops = tree([s for s, _, _ in subs], fan)
    for (sub, own, paths), top in zip(subs, tops):
        out += [(r[0], leaf_of(r), sub, root, h(*(b + a for b, a in p + top))) for r, p in zip(own, paths)]
    return out


def check(spark, rows, every, fan):
    docs = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], DDL).repartition(5)
    found = merkle.manifest(docs, "doc_id", "lang", merkle.leaf(FIELDS), every=every, fan=fan)
    proofs = found.proofs().select(
        "row.id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof"), merkle.fold(F.col("leaf"), F.col("path")).alias("folded"),
        merkle.fold(F.sha2(F.lit("other"), 256), F.col("path")).alias("forged")).collect()
    assert sorted((tuple(r[:5]) for r in proofs), key=str) == sorted(brute(rows, fan), key=str)
    assert all(r["folded"] == r["root"] != r["forged"] for r in proofs)
    assert [r["digest"] for r in found.root.collect()] == [proofs[0]["root"]]


@pytest.mark.parametrize("every, fan", [(1, 2), (2, 3), (4, 8)])
def test_trees(spark, every, fan):
    """Keys of one row, of full and of broken runs; a hot key; reused, repeated and null ids; null keys and fields; a very long text."""
    rng = random.Random(every)
    rows = [(i, rng.choice(["web", None, ""]), rng.choice(["en", "en", "en", "de", None, "été", "", "z"]), rng.choice([i, None]), rng.choice([None, "", "a b", "ü" * 50_000])) for i in range(150)]
    rows += [(1, "web", "solo", 3, "alone"), (7, "s", "en", 1, "one"), (7, "s", "en", 1, "two"), (7, "s", "en", 1, "two"), (None, "s", "en", 1, "n"), (-5, "s", "en", 1, "minus")]
    check(spark, rows, every, fan)


def test_lone_trees(spark):
    check(spark, [(1, "s", "en", 1, "x")], 4, 8)
    check(spark, [(i, "s", lang, 1, "x") for i, lang in enumerate(["a", "b", None])], 4, 8)
    check(spark, [(i, "s", None, 1, "x") for i in range(9)], 4, 8)


def test_empty(spark):
    docs = spark.createDataFrame([], DDL)
    found = merkle.manifest(docs, "doc_id", "lang", merkle.leaf(FIELDS))
    assert found.proofs().count() == 0 and found.root.count() == 0


def test_query_detects_changes(spark, tmp_path):
    """Only rows whose text changes by lower-casing fail, by any file layout."""
    from evenkeel.llm.queries import QUERIES

    rows = [(i, "web", "en" if i % 3 else "de", i, f"Text {i}" if i % 2 else f"text {i} É") for i in range(40)] + [(None, "web", "en", 1, "ABC"), (41, "web", "en", 1, None)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    import zlib
    for r in QUERIES["op11_merkle"](spark, str(tmp_path)).collect():
        text = next(x[4] for x in rows if x[0] == r["doc_id"])
        changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None and text.startswith("T")
        assert r["verified"] == (not changed) == (r["folded_root"] == r["root"])
