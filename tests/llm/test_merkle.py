"""The Merkle manifest against hashes in plain Python: deep trees, many languages, ties, nulls."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from apexframe.llm import merkle
from apexframe.llm.merkle import merkle_proofs

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(leaves, at, fold):
    """(top of the leaves, what ``fold`` in place ``at`` comes to, siblings in order)."""
    siblings = []
    while len(leaves) > 1:
        run = leaves[at // 8 * 8 : at // 8 * 8 + 8]
        siblings += run[: at % 8] + run[at % 8 + 1 :]
        fold = h(*run[: at % 8], fold, *run[at % 8 + 1 :])
        leaves, at = [h(*leaves[i : i + 8]) for i in range(0, len(leaves), 8)], at // 8
    return leaves[0], fold, siblings


def plain(rows):
    leaf = {r: h(*map(field, r)) for r in rows}
    trees = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf[r])):
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subroots = [climb([leaf[r] for r in trees[x]], 0, "")[0] for x in order]
    out = []
    for k, x in enumerate(order):
        leaves = [leaf[r] for r in trees[x]]
        for i, r in enumerate(trees[x]):
            tried = leaf[r]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                tried = h(*map(field, (*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))))
            _, fold, below = climb(leaves, i, tried)
            root, fold, above = climb(subroots, k, fold)
            out.append((r[0], leaf[r], subroots[k], root, h(*below, *above), fold, fold == root))
    return sorted(out, key=str)


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.withColumn("tree", F.lit("mine")).withColumn("n", F.lit(1)).withColumn("run", F.lit(2)).withColumn("level", F.lit(3))
    return sorted((tuple(r) for r in merkle_proofs(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0).collect()), key=str)


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_proofs_against_plain_hashes(spark, monkeypatch, block):
    """Trees of one to 700 leaves and 20 languages, so that both trees have several levels, with nodes copied for blocks of leaves."""
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", block)
    rng, rows = random.Random(1), []
    for k in range(20):
        for _ in range([700, 65, 64, 9, 8, 1, 2, 1][k] if k < 8 else rng.randrange(1, 12)):
            rows.append((len(rows) * 7 % 5003, rng.choice(["a", "é", None]), None if k == 3 else "zz" if k == 5 else f"l{k}" if k % 2 else f"Ü{k}", len(rows), rng.choice(["Abc", "x", "É Ü", "", "two  Words"])))
    assert found(spark, rows) == plain(rows)


def test_edges(spark):
    """Nulls everywhere, empty and long texts, equal ids, a row alone, an empty table."""
    rows = [(None, None, None, None, None), (3, "s", None, 0, ""), (3, "s", None, 1, "B"), (3, "S", "", 2, "b" * 300_000 + "C"), (4, None, "de", None, "A"), (5, "s", "de", 2, None)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[4:5]) == plain(rows[4:5])
    assert found(spark, []) == []


def test_equal_rows_get_places_of_their_own(spark):
    got = found(spark, [(6, "s", "en", 1, "Same")] * 10)
    assert len(got) == 10 and len({r[1] for r in got}) == 1 and len({r[3] for r in got}) == 1 and len({r[4] for r in got}) == 2
