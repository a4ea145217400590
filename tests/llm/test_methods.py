"""Operators against plain computations of their method: mixing, sharding, consensus, merge index, lookups, quality and the pipeline."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from apexframe.llm import common
from apexframe.llm.common import connected_components, key_filter, lookup, passing, stored
from apexframe.llm.exact_dedup import MergeIndex, exact_dedup
from apexframe.llm.html_extract import Page, extract_pages
from apexframe.llm.mixing import find_exponent, mix_sources
from apexframe.llm.quality import fit_quality, score_documents
from apexframe.llm.sharding import cut_groups, settle, shard_documents

DATA = "/root/testdata/sf0.01"


# ---- common

@pytest.mark.parametrize("most", [0, 1 << 20])
def test_lookup_is_a_left_join_whether_broadcast_or_in_parts(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else "hot" if i % 3 else f"k{i}") for i in range(300)], "id long, k string")
    table = stored(rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most")).where("k != 'k3'"), "t")
    got = {r.id: r.most for r in lookup(rows, table, "k", "n", ["id"]).collect()}
    plain = {r.id: r.most for r in rows.join(table, "k", "left").select("id", "most").collect()}
    assert got == plain and len(got) == 300


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {n: n for e in edges for n in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root[n] for e in edges for n in e if e[0] != e[1]}
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame(edges, "a long, b long"), most_rounds=1)


# ---- op2

@pytest.mark.parametrize("memtables", [1, 5])
def test_merge_index_levels(spark, tmp_path, memtables):
    rng = random.Random(1)
    rows = [(f"d{rng.randrange(60)}", i) for i in range(200)]
    index = MergeIndex(spark, str(tmp_path))
    for k in range(memtables):
        index.flush(spark.createDataFrame(rows[k::memtables], "digest string, id long"))
    assert [r.level for r in index.runs] == {1: [0], 5: [2, 0]}[memtables]
    best, n = {}, Counter(d for d, _ in rows)
    for d, i in rows:
        best[d] = min(best.get(d, i), i)
    asked = spark.createDataFrame([("d1",), ("d2",), ("none",)], "digest string")
    assert {(r.digest, r.keep_id, r.n) for r in index.find(asked).collect()} == {(d, best[d], n[d]) for d in ("d1", "d2") if d in best}
    index.compact()
    assert {(r.digest, r.keep_id, r.n) for r in index.current().collect()} == {(d, best[d], n[d]) for d in best}
    # The merged filter rules out what no run has.
    assert passing(index.current(), "digest", index._filter(index.runs[0])).count() == len(best)


def test_memtables_do_not_change_the_result(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert sorted(map(tuple, exact_dedup(docs, memtables=1).collect())) == sorted(map(tuple, exact_dedup(docs, memtables=3).collect()))


# ---- op6

@pytest.mark.parametrize(("kind", "value"), [("even", 0.5), ("entropy", 0.9), ("entropy", 0.2), ("repeats", 3.0), ("repeats", 1.2)])
def test_exponent_meets_the_target(spark, kind, value):
    tokens = [10_000, 900, 700, 250, 40, 0]
    p = np.array([t / sum(tokens) for t in tokens if t])
    got = find_exponent(spark.createDataFrame([(float(t), t / sum(tokens)) for t in tokens], "tokens double, p double"), **{kind: value})

    def entropy(a):
        q = p**a / (p**a).sum()
        return -(q * np.log(q)).sum() / math.log(len(p))

    # Plain bisection.
    target = entropy(1) + value * (1 - entropy(1)) if kind == "even" else value
    holds = (lambda a: (p.max() / p.min()) ** (1 - a) > value) if kind == "repeats" else (lambda a: entropy(a) >= target)
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    expected = 1.0 if holds(1.0) else low
    assert got == pytest.approx(expected, abs=1e-6) and (kind != "even" or 0 < got < 1)


def test_blocks_hold_the_weights_and_the_permutation_of_a_plain_replay(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), "big" if i % 3 else ("small" if i % 2 else None)) for i in range(900)]
    rows += [(10_000 + i, "", "empty") for i in range(50)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), even=0.5, block_tokens=1000).collect()
    tokens = {i: len(t.split()) for i, t, _ in rows}
    weight = {r.source: r.weight for r in got}
    assert sum(weight.values()) == pytest.approx(1) and weight["empty"] == 0 and all(r.n_tokens == tokens[r.doc_id] for r in got)
    # Replay: of each source, the epochs one after another; a document's place is the sum of the tokens before it in block order.
    for source in ("big", "small", None):
        mine = [r for r in got if r.source == source and r.n_tokens]
        share = Counter()
        for r in mine:
            share[r.block] += r.n_tokens
        full = sorted(share)[:-1]
        assert all(abs(share[b] - 1000 * weight[source]) <= 60 for b in full)
        first = Counter(r.doc_id for r in mine if r.epoch == 0)
        assert set(first) == {i for i, t, s in rows if s == source and tokens[i]} and set(first.values()) == {1}
    assert len({r.block for r in got if r.source == "empty"}) > 3 and Counter(r.doc_id for r in got if r.source == "empty") == Counter(i for i, _, s in rows if s == "empty")
    slots = {}
    for r in got:
        slots.setdefault(r.block, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# ---- op1

def test_settling_is_as_good_as_the_best_packing():
    rng = random.Random(7)
    for _ in range(40):
        shards = rng.randrange(2, 4)
        groups = [(rng.randrange(shards), rng.randrange(2, 5)) for _ in range(rng.randrange(1, 7))]
        rows = sum(n for _, n in groups) + 6
        sizes = [rows // shards + (s < rows % shards) for s in range(shards)]
        goes = settle(Counter(groups), room := list(sizes))
        whole = sum(k for moves in goes.values() for _, k in moves)
        best = max(sum(s >= 0 for s in deal) for deal in itertools.product(range(-1, shards), repeat=len(groups)) if all(sum(g[1] for g, s in zip(groups, deal, strict=True) if s == t) <= sizes[t] for t in range(shards)))
        assert min(room) >= 0 and whole >= best - 1
        assert whole == len(groups) or best < len(groups) or whole >= best - 1


def test_no_group_is_cut_that_fits(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    linked = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 150).cast("string")).alias("text"))
    for d, shards in ((docs, 24), (linked, 6), (linked, 7)):
        got = shard_documents(d, shards).join(d.select("doc_id", "text").where("length(text) > 0"), "doc_id")
        found = cut_groups(got, F.col("text")).first()
        # Six shards of whole groups leave no cut; seven of 85 or 86 rows can't all be filled with fours.
        assert found.groups > 0 and found.cut <= (6 if shards == 7 else 0)


# ---- op10

def test_host_consensus_against_a_plain_vote(spark):
    body = lambda i: f"<h1>Story {i}</h1><p>" + f"words of story {i} " * 12 + "</p>"
    page = lambda i: f"<body><div class='top-{i}'><a href='/'>home</a></div><div class='content c{i}'>{body(i)}</div><div class='comment-box'><p>nice</p></div></body>"
    rows = [(i, f"http://h/{i}", page(i)) for i in range(12)]
    # One page with comments longer than its story: its host's pages agree that the box is not the article.
    rows.append((50, "http://h/50", f"<body><div class='content c7'>{body(50)}</div><div class='comment-box'><p>{'much was said here ' * 300}</p></div></body>"))
    # A host whose wrapper sounds like boilerplate, on every page.
    rows += [(100 + i, f"http://g/{i}", f"<body><div class='comment-free-story'>{body(i)}</div><div class='share-box'>share</div></body>") for i in range(4)]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = lambda i: f"Story {i} " + " ".join([f"words of story {i}"] * 12)
    assert all(got[i] == text(i) for i in range(12)) and got[50] == text(50) and all(got[100 + i] == text(i) for i in range(4))
    votes = Counter()
    for i in range(12):
        p = Page(page(i))
        best, covers = p.best()
        votes[p.nodes[best].path] += round(covers * 1000)
    assert len(votes) == 1  # numbers in names don't part the paths


def test_hard_pages(spark):
    rows = [
        (1, "u", "<div class='content wrap'>" * 100_000 + "deep"), (2, "u", "<p>" + "word " * 2_000_000), (3, "u", "<a href=\"" + "x'" * 100_000), (4, "u", "<div class='ad-box'>x" * 50_000),
        (5, "u", '<article><p class="ad"><b><i><u><em>buy<p>real text one<p>two</article>'), (6, "u", "<div class=\"comment-free-story\"><p>story</p></div>"), (7, "u", "</div></p></b>" * 1000 + "end"), (8, "u", "<li><ul>" * 20_000 + "z"),
    ]
    got = {r.page_id: r for r in extract_pages(spark.createDataFrame([(i, f"http://{i}/", h) for i, _, h in rows], "page_id long, url string, html string")).collect()}
    assert (got[1].text, got[2].n_chars, got[5].text, got[6].text, got[7].text, got[8].text) == ("deep", 5 * 2_000_000 - 1, "real text one two", "story", "end", "z")
    assert len(got) == 8


# ---- op9 and the pipeline

def test_a_labelled_id_on_many_rows_is_one_training_row(spark):
    docs = spark.range(100_000).select((F.col("id") % 5 + F.when(F.col("id") < 40, F.col("id") * 5).otherwise(0)).alias("doc_id"), F.concat(F.lit("text of row "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(10).alias("n_chars"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = fit_quality(docs, labels, rounds=1)
    assert score_documents(docs.limit(50), model).where("score between 0 and 1").count() == 50


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = fit_quality(docs, labels.where(train))
    rows = score_documents(docs.join(labels.where(~train), "doc_id", "left_semi"), model).join(labels, "doc_id").collect()
    share = lambda rows: sum(r.rejected for r in rows) / len(rows)
    assert share([r for r in rows if r.toxic]) > 0.85 and share([r for r in rows if not r.quality]) > 0.95 and share([r for r in rows if r.quality and not r.toxic]) < 0.02


def test_pipeline_stages_decide_as_their_operators_do(spark):
    """Each stage on its own input: who goes is what the operator's query says, everybody else stays unchanged."""
    from apexframe.llm.decontaminate import contamination
    from apexframe.llm.near_dup import near_classes

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    labels, benchmark = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("labels", "benchmark"))
    kept = stored(corpus_pipeline.quality(spark, docs, DATA), "q")
    assert ids(kept) == ids(score_documents(docs, fit_quality(docs, labels)).where("not rejected"))
    once = stored(corpus_pipeline.near_dedup(spark, kept, DATA), "n")
    assert ids(once) == ids(near_classes(kept).where("kept")) and once.exceptAll(kept).isEmpty()
    clean = stored(corpus_pipeline.decontamination(spark, once, DATA), "c")
    assert ids(clean) == ids(contamination(once, benchmark).where("not contaminated")) and clean.exceptAll(once).isEmpty()
    mixed = stored(corpus_pipeline.mixing(spark, clean, DATA), "m")
    assert Counter(ids(mixed)) == Counter(ids(mix_sources(clean, even=0.5))) and mixed.distinct().exceptAll(clean).isEmpty()
    sharded = corpus_pipeline.sharding(spark, mixed, DATA).collect()
    sizes = Counter(r.shard for r in sharded)
    assert Counter(r.doc_id for r in sharded) == Counter(ids(mixed)) and max(sizes.values()) - min(sizes.values()) <= 1


def test_stages_pass_clashing_names_through(spark):
    d = spark.createDataFrame([(1, "one two three", "a", "en", 3, 9)], "doc_id long, text string, source string, lang string, n_chars long, x long")
    names = ["uid", "__uid", "row", "key", "id", "n", "stays", "class_id", "n_hit", "copies", "n_words", "cuts", "body", "a.b", "__part", "__maybe", "read"]
    d = d.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    benchmark = spark.createDataFrame([(1, "no such text")], "item_id long, text string")
    from apexframe.llm.decontaminate import drop_contaminated
    from apexframe.llm.mixing import mixed_documents
    from apexframe.llm.near_dup import keep_one_of_each

    for out in (keep_one_of_each(d), drop_contaminated(d, benchmark), mixed_documents(d, even=0.5)):
        assert out.columns == d.columns and tuple(out.first()) == tuple(d.first())
    assert key_filter(d, "doc_id").count() == 1
