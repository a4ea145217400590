"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: each operator has a defined result."""

import hashlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from apexframe.llm import substring_dedup
from apexframe.llm.decontaminate import contamination, drop_contaminated
from apexframe.llm.exact_dedup import exact_dedup
from apexframe.llm.html_extract import extract_pages
from apexframe.llm.mixing import mix_sources, mixed_documents
from apexframe.llm.near_dup import keep_one_of_each, near_classes
from apexframe.llm.quality import fit_quality, keep_good, score_documents
from apexframe.llm.sharding import shard_documents
from apexframe.llm.substring_dedup import dedup_substrings
from apexframe.llm.tokens import count_tokens
from apexframe.llm.warc import warc_round_trip

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with the names that operators use inside or return.
CLASH = ["uid", "digest", "shard", "label", "kept", "id", "h", "key", "items", "score", "epoch", "hits", "__n"]
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 60),
    (2, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 60),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "", "en", "b", 0),
    (None, "a null id has this text and some more words to count", "en", "b", 5),
    (7, LONG, "de", None, len(LONG)),
    (8, "Übergrößen äöü ñandú 漢字 😀", "de", "c", 20),
    (9, "... !!! ???", "en", "c", 11),
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 60),
    (11, "one two", "en", "a", 7),
    (12, LONG, "de", None, len(LONG)),
]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, DOCS)
    return d.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH)))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), (4, "one two"), (None, "ñandú 漢字")], "item_id long, text string")


def test_sharding(docs, empty):
    got = shard_documents(docs, 5).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(5)]
    assert len(got) == 12 and max(sizes) - min(sizes) <= 1
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    none = next(r for r in got if r.doc_id == 3)
    assert (none.size, none.text_crc32, none.grown_shard) == (8, 0, None)
    assert shard_documents(empty).count() == 0


def test_linked_documents_share_a_shard(spark):
    d = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 150).cast("string")).alias("text"))
    got = shard_documents(d, 6).withColumn("g", F.col("doc_id") % 150).groupBy("g").agg(F.count_distinct("shard").alias("k"))
    # The hard case: every document is linked and no shard has room to spare.
    assert got.where("k > 1").count() == 0


def test_hot_group_fills_whole_shards(spark):
    d = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    got = shard_documents(d, 9)
    assert got.groupBy("shard").count().select(F.max("count") - F.min("count")).first()[0] <= 1
    assert got.where(F.col("doc_id") % 3 == 0).select("shard").distinct().count() <= 6


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(docs, empty, keep):
    got = {(r.doc_id, r.digest): r for r in exact_dedup(docs, keep=keep).collect()}
    best = 2 if keep == "largest" else 1
    sha = hashlib.sha256(ROWS[1][1].lower().encode()).hexdigest()
    assert got[1, sha].keep_id == best and got[1, sha].group_size == 3 and got[best, sha].kept
    blank = hashlib.sha256(b"").hexdigest()
    assert {i: r.keep_id for (i, s), r in got.items() if s == blank} == dict.fromkeys((3, 4, 5), 5 if keep == "largest" else 3)
    assert next(r for (i, _), r in got.items() if i is None).keep_id is None
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_verifies_bytes(docs):
    weak = exact_dedup(docs, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1))
    full = exact_dedup(docs)
    names = ["doc_id", "keep_id", "group_size", "kept"]
    assert sorted(map(str, weak.select(*names).collect())) == sorted(map(str, full.select(*names).collect()))


def test_token_counts(docs, empty):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in count_tokens(docs, path).collect()}
    assert got[3].n_tokens == got[4].n_tokens == 0 and got[3].n_bytes == 0 and got[7].over_limit
    both = count_tokens(docs, path, prefixes=True).where("doc_id = 8").first()
    assert both.n_tokens == got[8].n_tokens and both.tokens_before[0] == 0
    assert count_tokens(empty, path).count() == 0


def test_contamination(docs, empty, benchmark):
    got = {r.doc_id: r for r in contamination(docs, benchmark).collect()}
    assert (got[11].n_words, got[11].n_hit, got[11].n_items, got[11].contaminated) == (2, 2, 2, True)
    assert got[11]["items"] == ["1", "4"] and got[11].items_sha256 == hashlib.sha256(b"1,4").hexdigest()
    assert got[8].n_hit == 2 and got[8]["items"] == ["null"]
    assert got[3].n_words == 0 and not got[3].contaminated and got[1].n_hit == 0
    kept = drop_contaminated(docs, benchmark)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in ROWS if r[0] not in (8, 11)) and kept.columns == docs.columns
    assert contamination(empty, benchmark).count() == 0 and contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_warc(spark):
    big = "x" * 1500
    rows = [(1, "http://h/\r\nEvil: 1", big), (2, None, big), (3, "u", None), (4, "u", "small"), (5, "u", "small"), (6, "u", "é" * 700), (7, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = {r.page_id: r for r in warc_round_trip(pages).collect()}
    assert len(got) == 7 and got[7].record_type == "response" and (got[1].record_type, got[1].refers_to) == ("revisit", 7) and got[2].refers_to == 7
    assert got[4].record_type == got[5].record_type == "response" and got[3].payload_bytes == 0 and got[6].payload_bytes == 1400
    assert got[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and got[1].payload_bytes == 1500
    assert warc_round_trip(pages.limit(0)).count() == 0


def test_mixing(docs, empty):
    got = mix_sources(docs, repeats=2.0)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r[0] for r in ROWS}
    again = mixed_documents(docs, repeats=2.0)
    assert again.columns == docs.columns and again.count() >= len(ROWS)
    assert mix_sources(empty, even=0.5).count() == 0 and mixed_documents(empty, even=0.5).count() == 0


def test_mixing_meets_the_repetition_limit(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") < 3200, "big").when(F.col("id") < 3900, "mid").otherwise("low").alias("source"))
    per = {r.source: r for r in mix_sources(d, repeats=2.0).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("k")).collect()}
    assert per["big"].n == 3200 and per["low"].n == pytest.approx(200, abs=2)
    slots = mix_sources(d, repeats=2.0, block_tokens=1000).groupBy("block").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert all(r.n == r.m + 1 for r in slots)


def test_substrings(docs, empty):
    got = {}
    for r in dedup_substrings(docs).collect():
        got.setdefault(r.doc_id, r)
    assert got[12].n_removed == got[12].n_bytes and got[12].n_spans == 1 and got[7].n_removed == 0
    # Document 2 differs from 1 in its first four capitals only.
    n = len(ROWS[0][1])
    assert got[1].n_removed == 0 and got[2].n_removed == n - 5 and got[2].kept_sha256 == hashlib.sha256(b"ALPHA").hexdigest()
    assert got[3].n_bytes == 0 and got[None].n_removed == 0 and dedup_substrings(empty).count() == 0


def test_substrings_of_crowded_anchors_spread_over_buckets(spark):
    line = "this line of forty-odd bytes is in all of them"
    passage = "a passage that every document has, longer than one window of fifty bytes by far"
    own = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    docs = spark.createDataFrame([(i, f"{own(i)} {line} {own(-i)} {passage} {own(i * i + 7)}") for i in range(1, 400)], "doc_id long, text string")
    rows = lambda crowd: sorted(dedup_substrings(docs, crowd=crowd).collect())
    assert rows(20) == rows(1 << 40)
    # One chunk: after the cut no bucket has most of a crowded anchor's windows.
    body = [r.text.encode() for r in docs.orderBy("doc_id").collect()]
    sizes = np.array([len(b) for b in body], np.int64)
    row = SimpleNamespace(ids=np.arange(len(body)).tobytes(), sizes=sizes.tobytes(), uids=b"", body=substring_dedup._squeeze(b"".join(body)))
    h, shared, count = substring_dedup.Chunk(row).anchors()
    crowded = h[count > 20]
    before = np.array([len(i) for _, i in substring_dedup._by_bucket(substring_dedup.Chunk(row).repeated(h[shared], crowded[:0])[1], 64)])
    after = np.array([len(i) for _, i in substring_dedup._by_bucket(substring_dedup.Chunk(row).repeated(h[shared], crowded)[1], 64)])
    assert len(crowded) and before.max() > 0.2 * before.sum() and after.max() < 0.05 * after.sum()


def test_near_duplicates(docs, empty):
    got = {}
    for r in near_classes(docs).collect():
        got.setdefault(r.doc_id, r)
    assert got[2].class_id == got[1].class_id == 1 and got[1].class_size == 3 and got[12].class_id == 7 and not got[12].kept
    assert got[11].class_size == 1 and got[9].class_size == 1
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 7, 8, 9, 11, None]))
    assert near_classes(empty).count() == 0 and keep_one_of_each(empty).count() == 0


def test_quality(docs, empty, labels):
    model = fit_quality(docs, labels)
    got = score_documents(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got)
    unlabelled = fit_quality(docs, labels.limit(0))
    assert score_documents(docs, unlabelled).where("rejected").count() == 0
    assert score_documents(empty, fit_quality(empty, labels)).count() == 0


def test_toxic_documents_are_rejected_whatever_their_quality(spark):
    fill = ["lorem", "ipsum", "dolor", "sit", "amet", "magna", "aliqua", "erat"]
    text = lambda i: " ".join(fill[(i * 7 + k * k) % 8] + fill[(i + k) % 8] for k in range(20)) + (" Vilest word" if i % 5 == 0 else " kind word")
    docs = spark.createDataFrame([(i, text(i), "en", "s", 200) for i in range(600)], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    model = fit_quality(docs, labels)
    got = {r.doc_id: r for r in score_documents(docs, model).collect()}
    unseen = range(300, 600)
    assert all(got[i].rejected == (i % 5 == 0) and (got[i].toxic_score > 0.5) == (i % 5 == 0) for i in unseen)
    assert {r.doc_id for r in keep_good(docs, model).collect()} == {i for i in got if i % 5}
    assert score_documents(docs, fit_quality(docs, labels.drop("toxic"))).where("rejected or toxic_score > 0").count() == 0


def test_extraction(spark):
    rows = [
        (1, "http://h/a", "<body><nav>menu</nav><article><h1>T &amp; U</h1><p>one<p>two <b>bo</b>ld<br>x</p><script>no</script></article><footer>foot"),
        (2, "http://h/b", None), (3, None, "plain text only"), (4, "http://h/c", "<div class='comments'>said</div><article>kept <!-- no --> text</article>"), (5, "nonsense", "<<<>>> &lt;a&gt; <p"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("winner", F.lit("clash"))
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    assert got[1].text == "T & U one two bold x" and got[4].text == "kept text" and got[2].text == "" and got[3].text == "plain text only"
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == 5
    assert extract_pages(pages.limit(0)).count() == 0


def test_extraction_keeps_articles_in_wrappers_with_marked_names(spark):
    body = "<h1>Title</h1><p>" + "plain words of the article " * 20 + "</p>"
    text = "Title " + ("plain words of the article " * 20).strip()
    rows = [
        (1, "http://a/1", f"<body><div class='layout has-sidebar'><article>{body}</article><div class='sidebar'>aside</div></div></body>"),
        (2, "http://b/1", f"<body><div class='wrapper header-fixed'><div class='post comments-open'>{body}<div class='ad'>buy</div></div></div></body>"),
        (3, "http://c/1", f"<body><div class='comments-area'>{body}</div><article>short article</article></body>"),
        (4, "http://d/1", f"<body><div class='ad'>{body}</div></body>"),
        (5, "http://e/1", f"<body><div id='header'><main>{body}</main></div><div class='share-box'>share this</div></body>"),
    ]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: text, 2: text, 3: "short article", 4: "", 5: text}


def test_extraction_keeps_what_stands_beside_a_large_child(spark):
    large = "<div class='body'><p>" + "most of the text " * 20 + "</p></div>"
    inner = ("most of the text " * 20).strip()
    rows = [(i, f"http://h/{i}", f"<body><div><a href='/'>all pages</a></div><article><h1>Head</h1><p>lead</p>{large}<p>end</p></article></body>") for i in range(3)]
    rows += [(10 + i, f"http://g/{i}", f"<body><div class='menu'>menu</div><div class='page'>{large}</div></body>") for i in range(3)]
    # Pages unlike the others of their host keep all of their own text.
    rows += [(20, "http://g/20", f"<body><div class='page'><h1>Head</h1>{large}<p>{'an end of some length ' * 5}</p></div></body>")]
    rows += [(21, "http://g/21", f"<body><div class='page'><div class='body'>little</div><p>{'an end of some length ' * 5}</p></div></body>")]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    end = ("an end of some length " * 5).strip()
    assert all(got[i] == f"Head lead {inner} end" for i in range(3)) and all(got[10 + i] == inner for i in range(3))
    assert got[20] == f"Head {inner} {end}" and got[21] == f"little {end}"


def test_pipeline_stages_keep_the_columns(spark, docs, empty, labels, benchmark, tmp_path):
    d = spark.createDataFrame(ROWS, DOCS)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == d.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert np.isfinite(len(corpus_pipeline.STAGES))
