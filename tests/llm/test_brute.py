"""Operators against brute force: tokens against their library, suffix arrays and substrings, near duplicates, SQL twins."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from apexframe.llm.induced import DEPTH, long_prefix, packed, suffix_array
from apexframe.llm.common import distinct_texts
from apexframe.llm.near_dup import document_frequencies, near_classes, shingles
from apexframe.llm.queries import ORACLES, QUERIES
from apexframe.llm.substring_dedup import dedup_substrings
from apexframe.llm.tokens import PrefixCounter
from apexframe.llm.words import WordHashes, words_of
from twins import DATA, rows, twin


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql_twin(spark, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(twin(ORACLES[name]))


def test_every_prefix_counts_as_the_library_does():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    counter, library, rng = PrefixCounter(path), Tokenizer.from_file(path), random.Random(1)
    alphabet = [*"ab cdth'elrvsmTHE0129 \n\t\r\x1c\x85\xa0²½Ⅷ٣éß漢😀_-.,!<|>", "<|endoftext|>", "'ll", "  ", "ing", " the"]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        table = counter.table(text)
        for k in range(len(text) + 1):
            assert table.at(k) == len(library.encode(text[:k], add_special_tokens=False).ids), (text, k)
        cut = table.truncate(3)
        assert table.at(cut) <= 3


def test_suffix_array_is_in_order():
    rng = random.Random(3)
    for _ in range(80):
        s = np.array([rng.randrange(rng.choice([2, 3, 200])) for _ in range(rng.randrange(1, 300))] + [0], np.uint16)
        words = packed(s)
        sa = suffix_array(s, words)
        key = [tuple(s[i : i + DEPTH].tolist()) for i in range(len(s))]
        ordered = [k + (0,) * (DEPTH - len(k)) for k in (key[i] for i in sa)]
        assert sorted(sa.tolist()) == list(range(len(s))) and ordered == sorted(ordered)
        shared = long_prefix(sa, words, 10)
        pad = lambda k: (k + (0,) * DEPTH)[:10]
        assert all(shared[b] == (pad(key[a]) == pad(key[b])) for a, b in zip(sa[:-1], sa[1:], strict=True))


def test_substrings_against_all_windows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first, texts = {}, {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            first.setdefault(texts[i][k : k + 50], i)
    for r in dedup_substrings(docs).collect():
        data = texts[r.doc_id]
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < r.doc_id:
                gone[k : k + 50] = True
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        assert (r.n_removed, r.kept_sha256) == (int(gone.sum()), hashlib.sha256(kept).hexdigest())


def _documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def _shingle_sets(texts):
    hashes = WordHashes()
    return {t: shingles(hashes.of(words_of(t))) for t in texts}


def test_document_frequencies_are_near_the_exact_ones(spark):
    docs = _documents(spark)
    sets = _shingle_sets({r.text or "" for r in docs.collect()})
    exact, kinds = {}, {}
    for x, _ in sets.values():
        if len(x):
            kinds.setdefault(int(x[0]), []).append(x)
    for group in kinds.values():
        for x in group:
            for h in x.tolist():
                exact[h] = exact.get(h, 0) + 1 / len(group)
    found = document_frequencies(distinct_texts(docs, "doc_id", "text")[0])
    names = np.array(sorted(exact), np.uint64)
    right = np.maximum([exact[h] for h in names.tolist()], 1)
    assert np.median(np.abs(found.of(names) - right)) < 0.3 and np.quantile(np.abs(found.of(names) / right - 1), 0.99) < 1.1
    assert abs(found.texts / len(kinds) - 1) < 0.05


def test_near_classes_against_all_pairs(spark):
    docs = _documents(spark)
    texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
    distinct = {t for _, t in texts}
    df = document_frequencies(distinct_texts(docs, "doc_id", "text")[0])
    w = {t: dict(zip(x.tolist(), df.weights(x, tf).astype(float).tolist(), strict=True)) for t, (x, tf) in _shingle_sets(distinct).items()}
    total = {t: sum(v.values()) for t, v in w.items()}
    root = {t: t for t in distinct}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    posting = {}
    for t in distinct:
        near = {u for h in w[t] for u in posting.get(h, ())}
        for u in near:
            shared = sum(min(v, w[u][h]) for h, v in w[t].items() if h in w[u])
            if shared >= 0.8 * (total[t] + total[u] - shared) - 1e-6:
                root[find(t)] = find(u)
        for h in w[t]:
            posting.setdefault(h, []).append(t)
    least = {}
    for i, t in texts:
        least.setdefault(find(t), i)
    expected = {i: least[find(t)] for i, t in texts}
    assert {r.doc_id: r.class_id for r in near_classes(docs).collect()} == expected


def test_recall_of_planted_copies_by_plain_similarity(spark):
    """Pairs whose plain Jaccard similarity is 0.8 or more, one pair alone or hundreds of copies of one text, are found; strangers aren't."""
    rng, vocabulary = random.Random(5), [f"word{i}" for i in range(3000)]
    rows, groups = [], []
    for size in [2] * 150 + [20] * 10 + [600]:
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(150, 400))]
        ids = []
        for k in range(size):
            text = list(base)
            for _ in range(0 if k == 0 else rng.randrange(1, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            ids.append(len(rows))
            rows.append((len(rows), " ".join(text)))
        groups.append(ids)
    rows += [(len(rows) + i, " ".join(rng.choice(vocabulary) for _ in range(200))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_classes(docs).collect()}
    sets = {i: set(shingles(WordHashes().of(words_of(t)))[0].tolist()) for i, t in rows}
    pairs = [(a, b) for ids in groups for a, b in zip(ids, ids[1:], strict=False) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 500 and sum(found[a] == found[b] for a, b in pairs) >= 0.98 * len(pairs)
    group_of = {i: g for g, ids in enumerate(groups) for i in ids}
    assert all(group_of.get(i, i) == group_of.get(c, c) for i, c in found.items())
