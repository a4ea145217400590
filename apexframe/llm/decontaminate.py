"""Benchmark decontamination by a prefix-filtered join of documents with benchmark windows, all in tables.

A window is 13 consecutive words of an item (a shorter item is one window). To contain
a window exactly, a text must contain every shingle of it, so one necessary shingle is
enough to find it: the rarest. Four steps:

1. the benchmark becomes a table of distinct windows, each with its shingles; a bitmap of bounded size holds the
   shingles' hashes, and one pass over the documents counts those that stand in it, which orders them by rarity;
2. the index has one row for each window: its rarest shingle, and where in the window it stands;
3. a second pass sends, for every place of a document with an indexed shingle (by a bitmap again), the words
   around it; these rows join the index on the shingle in Spark. The place bounds where the window must begin and end,
   and then all its words are compared;
4. hits are summed by text: distinct word positions, and distinct items.

Nothing of the benchmark but the two bitmaps passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexframe.llm.common import BROADCAST_ROWS, FILTER_BITS, HOT_KEYS, ROW_BITS, lookup, packed_rows, spread, stored
from apexframe.llm.words import WordHashes, words_of

SHINGLE = 3
#: Words as :func:`words_of` cuts them, for counting without lower-casing.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Distinct shingles that a task counts before it sends the counts on.
COUNTED = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _key(text: Column) -> Column:
    """128 bits that equal texts share (null counts as empty); cheaper than a digest that resists attack."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles at every position of an array of word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(k))
    for j in range(k):
        h = (h ^ words[j : j + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Which of FILTER_BITS residues the column ``h`` has; 8 MiB at most, whatever the table."""
    bit = F.pmod(F.col("h"), F.lit(FILTER_BITS))
    rows = hashes.select(F.floor(bit / ROW_BITS).cast("int").alias("row"), (bit % ROW_BITS).cast("int").alias("pos")).groupBy("row").agg(F.bitmap_construct_agg("pos").alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r.row * (ROW_BITS // 8) : (r.row + 1) * (ROW_BITS // 8)] = np.frombuffer(r.bits, np.uint8)
    return out


def _may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of hashes that the bitmap holds, or seems to."""
    bit = h & np.uint64(FILTER_BITS - 1)
    return np.flatnonzero((bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, text): the windows of every item, as words joined by spaces; distinct. A null item reads as "null"."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for item, text in zip(pdf["item"], pdf["text"], strict=True):
                words = [w.decode("utf-8", "surrogatepass") for w in words_of(text)]
                size = min(window, len(words))
                out += [(item, " ".join(words[i : i + size])) for i in range(len(words) - size + 1 if words else 0)]
            yield pd.DataFrame(out, columns=["item", "text"])

    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))
    return rows.mapInPandas(cut, "item string, text string").distinct()


def _window_shingles(windows: DataFrame) -> DataFrame:
    """(text, size, k, place, h): all shingles of the distinct windows; windows of fewer words than a shingle are one."""

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                words = hashes.of(text.encode("utf-8", "surrogatepass").split())
                k = min(SHINGLE, len(words))
                out += [(text, len(words), k, i, h) for i, h in enumerate(shingle_hashes(words, k).view(np.int64).tolist())]
            yield pd.DataFrame(out, columns=["text", "size", "k", "place", "h"])

    return windows.select("text").distinct().mapInPandas(shingle, "text string, size int, k int, place int, h long")


def shingle_counts(docs: DataFrame, shingles: DataFrame, lengths: list[int]) -> DataFrame:
    """(h, n): how often shingles that the bitmap of ``shingles`` holds stand in all documents; summed in each task first."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(shingles))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, found, size = WordHashes(), [], 0

        def told() -> pd.DataFrame:
            h, n = np.unique(np.concatenate(found), return_counts=True)
            return pd.DataFrame({"h": h.view(np.int64), "n": n})

        for pdf in batches:
            for text in pdf["text"]:
                words = hashes.of(words_of(text))
                for k in lengths:
                    h = shingle_hashes(words, k)
                    h = h[_may_hold(bits.value, h)]
                    if len(h):
                        found.append(h)
                        size += len(h)
            if size >= COUNTED:
                yield told()
                found, size = [], 0
        if found:
            yield told()

    return docs.select("text").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def window_index(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, list[int]]:
    """(index, shingle lengths): each distinct window (text, size) under its rarest shingle: h, place, and n, how often that stands in the documents."""
    shingles = stored(_window_shingles(windows), "window-shingles")
    lengths = sorted(r.k for r in shingles.select("k").distinct().collect())  # 1 to SHINGLE
    counts = stored(shingle_counts(docs, shingles, lengths), "shingle-counts")
    ranked = shingles.join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.groupBy("text", "size", "k").agg(F.min(F.struct("n", "place", "h")).alias("r"))
    return stored(rarest.select("text", "size", "k", "r.*"), "window-index"), lengths


def window_hits(docs: DataFrame, index: DataFrame, lengths: list[int], window: int) -> DataFrame:
    """(key, text, start, size, copies): every occurrence of an indexed window in each distinct text of (key, text) rows, and the text's rows."""
    live = index.where("n > 0")
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(live))
    reach = window - SHINGLE

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            out = []
            for a, b, text in zip(pdf["a"], pdf["b"], pdf["text"], strict=True):
                words = words_of(text)
                numbers = hashes.of(words)
                for k in lengths:
                    h = shingle_hashes(numbers, k)
                    places = _may_hold(bits.value, h)
                    for i, x in zip(places.tolist(), h[places].view(np.int64).tolist(), strict=True):
                        begin = max(0, i - reach) if k == SHINGLE else i
                        around = b" ".join(words[begin : i + k + (reach if k == SHINGLE else 0)])
                        out.append((a, b, x, i, begin, around.decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["a", "b", "h", "at", "begin", "around"])

    sent = docs.select("key.a", "key.b", "text").mapInPandas(probe, "a long, b long, h long, at long, begin long, around string")
    # Copies of a text send equal rows, which are combined before the shuffle.
    sent = sent.groupBy("a", "b", "h", "at", "begin", "around").agg(F.count(F.lit(1)).alias("copies"))
    if live.count() <= BROADCAST_ROWS:
        met = sent.join(F.broadcast(live), "h")
    else:
        # Shingles with over a HOT_KEYS-th of all occurrences meet the index in parts.
        most = max(100_000, (live.select("h", "n").distinct().agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
        parts = F.greatest(F.lit(1), F.ceil(F.col("n") / most)).cast("int")
        hot = live.where(F.col("n") > most).select("h", parts.alias("parts")).distinct()
        sent = sent.join(F.broadcast(hot), "h", "left").withColumn("part", F.pmod(F.xxhash64("a", "at"), F.coalesce("parts", F.lit(1))).cast("int"))
        met = sent.join(live.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))), ["h", "part"])
    start = F.col("at") - F.col("place")
    words = F.slice(F.split("around", " "), (start - F.col("begin") + 1).cast("int"), F.col("size"))
    fits = (start >= F.col("begin")) & (F.size(words) == F.col("size"))
    met = met.where(start >= F.col("begin")).where(fits & (F.array_join(words, " ") == F.col("text")))
    return stored(met.select(F.struct("a", "b").alias("key"), "text", start.alias("start"), "size", "copies"), "window-hits")


def judged_texts(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int) -> DataFrame:
    """(key, n_hit, items, copies) of the texts of (key, text) rows in which a benchmark window occurs."""
    windows = stored(benchmark_windows(benchmark, item_col, item_text_col, window), "benchmark-windows")
    index, lengths = window_index(docs, windows)
    hits = window_hits(docs, index, lengths, window)
    places = hits.select("key", "copies", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("word"))
    covered = places.groupBy("key", "word").agg(F.max("copies").alias("copies")).groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"), F.max("copies").alias("copies"))
    owned = hits.select("key", "text").distinct().join(windows, "text").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return stored(covered.join(owned, "key"), "judged-texts")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: float = 0.05) -> DataFrame:
    """How much of each document's words lie in occurrences of benchmark windows.

    Returns id, n_words, n_hit, n_items, items_sha256 (of the sorted, comma-joined item
    ids), items (the ids), contaminated (n_hit > 0 and n_hit >= share * n_words).

    Edge cases: a null or empty text has no words and isn't contaminated; items without
    words have no window; equal windows of several items count for each of them; an item
    listed twice counts once; a null item id reads as "null"; repeated documents are
    judged each by itself; an empty benchmark contaminates nothing. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = spread(rows).withColumn("key", _key(F.col("text")))
    judged = judged_texts(rows, benchmark, item_col, item_text_col, window)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(words_of(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(n, pa.int64())], names=["id", "key", "n_words"])

    sized = rows.mapInArrow(counted, "id long, key struct<a: long, b: long>, n_words long")
    found = lookup(sized, judged, "key", "copies", ["id"])
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    found = found.select("id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), items.alias("items"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (max(1, round(1 / share)) * F.col("n_hit") >= F.col("n_words"))).withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: float = 0.05) -> DataFrame:
    """``docs`` without the contaminated ones, all columns as they are.

    Edge cases: as in :func:`contamination`; null and empty texts stay, equal texts stay or go together, repeated rows stay
    repeated, and columns of any name, dots included, pass through.
    """
    column = F.col(f"`{text_col}`")
    judged = judged_texts(spread(docs.select(column.alias("text"))).withColumn("key", _key(F.col("text"))), benchmark, item_col, item_text_col, window)
    found = lookup(packed_rows(docs, key=_key(column)), judged.select("key", "n_hit", "copies"), "key", "copies", ["row"])
    # Words are counted only where there are hits.
    words = F.regexp_count(F.col("row").getField(text_col), F.lit(WORDS))
    return found.where(F.col("n_hit").isNull() | (max(1, round(1 / share)) * F.col("n_hit") < words)).select("row.*")
