"""SimHash components against all pairs, with the fingerprint in plain Python."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from apexframe.llm import common
from apexframe.llm.queries import QUERIES
from apexframe.llm.simhash import fingerprint, fingerprint_links, simhash_components

DATA = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """prints: fingerprint -> smallest document; returns fingerprint -> smallest reachable document, over all pairs."""
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    names = sorted(prints)
    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for f, d in prints.items():
        least[find(f)] = min(d, least.get(find(f), d))
    return {f: least[find(f)] for f in names}


def test_fingerprint_is_that_of_the_definition():
    rng = random.Random(2)
    words = ["a", "B", "Ünï", "\x1c", "\x85x", "ﬁ", "naïve", "X y", "😀", "-", "\x00"]
    for _ in range(200):
        text = "".join(rng.choice(words) + rng.choice([" ", "\t", "\n\n", " \x0b", "\x0c", "\r"]) for _ in range(rng.randrange(12)))
        assert fingerprint(text) == plain_fingerprint(text), text
    long = " ".join(str(rng.randrange(50)) for _ in range(70_000))
    assert fingerprint(long) == plain_fingerprint(long)


def test_query_against_all_pairs(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    least = {}
    for i, f in sorted(prints.items()):
        least.setdefault(f, i)
    found = plain_components(least)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op11_simhash"](spark, DATA).collect()}
    assert got == {i: (f"{f:016x}", found[f]) for i, f in prints.items()}


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_links_connect_what_is_near(spark, monkeypatch, most):
    """Chains, dense balls and strangers, the highest bit included."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rng, prints = random.Random(3), {}
    for _ in range(12):
        at = rng.getrandbits(64)
        prints[at] = rng.randrange(10**6)
        for _ in range(rng.randrange(8)):
            at ^= 1 << rng.randrange(60, 64) | 1 << rng.randrange(64)
            prints[at] = rng.randrange(10**6)
    prints |= {1 << k: 10 + k for k in range(64)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    links = fingerprint_links(spark.createDataFrame([(signed(f),) for f in prints], "fp long"))
    assert all(0 < ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in links.collect())
    root = {r.node: r.root for r in common.connected_components(links).collect()}
    expected, got = plain_components(prints), {}
    for f in prints:
        got.setdefault(root.get(signed(f), signed(f)), set()).add(f)
    groups = {}
    for f, d in expected.items():
        groups.setdefault(d, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_edges(spark):
    rows = [(5, None), (3, ""), (4, " \t\n"), (7, "one"), (8, "ONE"), (8, "ONE"), (9, "one two"), (None, "lonely words stand here"), (11, "ß " * 90_000), (10, "ß " * 90_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("mine")).withColumn("root", F.lit(1)).withColumn("variant", F.lit(0))
    out = simhash_components(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    got = sorted(((r.doc_id or -1), r.component_id) for r in out.collect())
    assert got == [(-1, None), (3, 3), (4, 3), (5, 3), (7, 7), (8, 7), (8, 7), (9, 9), (10, 10), (11, 10)]
    assert simhash_components(docs.where("false")).count() == 0
