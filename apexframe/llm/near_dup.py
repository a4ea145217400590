"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Equal texts collapse to one (a combined aggregate on digests).
2. Document frequencies of five-word shingles are counted over all distinct texts in
   tables of fixed size, so they can be broadcast at any input size (:class:`Frequencies`).
3. Each text is a set of shingles weighted by TF-IDF. Improved consistent weighted
   sampling (Ioffe 2010) draws 64 samples; two texts agree in a sample with the probability of
   their weighted Jaccard similarity. 16 bands of 4 samples are the keys of buckets.
4. Within a bucket, texts whose samples agree well enough are chained (a forest, never all pairs).
   The chains' connected components are families.
5. Each family's texts meet once, in blocks of bounded size, and weighted Jaccard
   similarity is computed exactly; links of at least the threshold join. A family
   larger than a block is verified for every pair of its blocks.
6. Connected components of the verified links are the classes.

A shingle that thousands of near copies share has a high document frequency *because* they are copies;
by plain TF-IDF it would weigh little, what an edit changed would weigh a lot, and large groups would fall apart. So
frequencies count kinds of text, not copies: texts with the same smallest shingle hash are of one kind (copies mostly
are, others hardly ever), and each text of a kind counts as one over the kind's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.llm.common import connected_components, distinct_texts, flagged, key_filter, lookup, packed_rows, spread, stored, text_key
from apexframe.llm.words import WordHashes, words_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Slots of a table of document frequencies (4 bytes each), and tables.
DF_SLOTS = 1 << 20
DF_TABLES = 3
#: Samples that must agree for two texts to be of one family: 3.6 standard deviations below the threshold.
AGREE = 40
#: Text bytes in a block of a family, and rows of a bucket that are compared at once.
BLOCK_BYTES = 12 << 20
BUCKET_ROWS = 4096
_SLOT_BITS = 14
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the sampling by slot: r ~ Gamma(2, 1), beta ~ U(0, 1), ln c with c ~ Gamma(2, 1); and a multiplier for each sample."""
    rng = np.random.Generator(np.random.PCG64(20240611))
    n = 1 << _SLOT_BITS
    r = -np.log(rng.random(n) * rng.random(n) + 1e-300)
    c = -np.log(rng.random(n) * rng.random(n) + 1e-300)
    multipliers = (rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    return r.astype(np.float32), rng.random(n).astype(np.float32), np.log(c).astype(np.float32), multipliers


_R, _BETA, _LNC, _MULTIPLIERS = _tables()


def _avalanche(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes in order, how often each occurs); texts of fewer words are one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(size, len(words))
    h = np.full(len(words) - k + 1, np.uint64(k))
    for j in range(k):
        h = h * _MIX + words[j : len(words) - k + 1 + j]
    return np.unique(_avalanche(h), return_counts=True)


class Frequencies:
    """Document frequencies of shingles over all texts, in tables of fixed size.

    A shingle's slot of a table sums it with others; what the others bring on average is subtracted, and the middle of the
    tables is taken. A frequency is 1 at least.
    """

    def __init__(self, tables: np.ndarray, texts: float):
        size = tables.shape[1]
        noise = (tables.sum(1, keepdims=True) - tables) / (size - 1)
        self.tables = np.maximum(tables - noise, 1).astype(np.float32)
        self.texts = max(2.0, texts)

    @staticmethod
    def slots(x: np.ndarray, table: int) -> np.ndarray:
        return ((x >> np.uint64(4 + 20 * table)) & np.uint64(DF_SLOTS - 1)).astype(np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        a, b, c = (t[self.slots(x, i)] for i, t in enumerate(self.tables))
        return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))

    def weights(self, x: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """TF-IDF: (1 + ln tf) (1 + ln((1 + N) / (1 + df)))."""
        return ((1 + np.log(tf)) * (1 + np.log((1 + self.texts) / (1 + np.minimum(self.of(x), self.texts))))).astype(np.float32)


def sample(x: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Consistent weighted samples, (texts, SAMPLES) of 32-bit names; texts are the runs from ``starts``, none empty."""
    out = np.empty((len(starts), SAMPLES), np.uint32)
    x32 = (x >> np.uint64(16)).astype(np.uint32)
    name = (x ^ (x >> np.uint64(32))).astype(np.uint32)
    lnw = np.log(w)
    for k in range(SAMPLES):
        slot = (x32 * _MULTIPLIERS[k]) >> np.uint32(32 - _SLOT_BITS)
        r, beta = _R[slot], _BETA[slot]
        t = np.floor(lnw / r + beta)
        ln_a = _LNC[slot] - r * (t - beta + np.float32(1))
        order = ln_a.view(np.uint32)
        order = order ^ (((order.view(np.int32) >> 31).view(np.uint32)) | np.uint32(0x80000000))
        key = (order.astype(np.uint64) << np.uint64(32)) | (name ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x85EBCA6B)))
        out[:, k] = np.minimum.reduceat(key, starts).astype(np.uint32)
    return out


def _hashed(hashes: WordHashes, texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for text in texts:
        yield shingles(hashes.of(words_of(text)))


def _summed(texts: DataFrame, tables: int, add: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """``add(sums, shingles)`` over all texts into (tables, DF_SLOTS) numbers; each task sends its sums in packed ranges, the result is 4 MiB a table."""
    parts = 256

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, sums = WordHashes(), np.zeros((tables, DF_SLOTS), np.float32)
        for pdf in batches:
            for x, _ in _hashed(hashes, pdf["text"]):
                if len(x):
                    add(sums, x)
        rows = [(t * parts + i, p.tobytes()) for t in range(tables) for i, p in enumerate(sums[t].reshape(parts, -1)) if p.any()]
        yield pd.DataFrame(rows, columns=["part", "sums"])

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(DF_SLOTS // parts, np.float64)
        for b in pdf["sums"]:
            total += np.frombuffer(b, np.float32)
        return pd.DataFrame({"part": [key[0]], "sums": [total.astype(np.float32).tobytes()]})

    counted = texts.select("text").mapInPandas(count, "part int, sums binary")
    merged = counted.groupBy("part").applyInPandas(merge, "part int, sums binary").collect()
    out = np.zeros((tables, parts, DF_SLOTS // parts), np.float32)
    for r in merged:
        out[r.part // parts, r.part % parts] = np.frombuffer(r.sums, np.float32)
    return out.reshape(tables, DF_SLOTS)


def kind_sizes(texts: DataFrame) -> np.ndarray:
    """How many texts have their smallest shingle hash in each slot."""

    def add(sums: np.ndarray, x: np.ndarray) -> None:
        sums[0, Frequencies.slots(x[:1], 1)] += 1  # shingles are in order

    return _summed(texts, 1, add)[0]


def document_frequencies(texts: DataFrame) -> Frequencies:
    """Frequencies over all texts, each counted as one over the size of its kind."""
    sizes = kind_sizes(texts)
    mean = sizes.sum() / DF_SLOTS
    # Texts of other kinds in the slot don't make a kind: their usual number is subtracted.
    share = texts.sparkSession.sparkContext.broadcast((1 / np.maximum(sizes - mean - 3 * np.sqrt(mean), 1)).astype(np.float32))

    def add(sums: np.ndarray, x: np.ndarray) -> None:
        own = share.value[Frequencies.slots(x[:1], 1)]
        for t in range(DF_TABLES):
            np.add.at(sums[t], Frequencies.slots(x, t), own[0])

    return Frequencies(_summed(texts, DF_TABLES, add), float((sizes * share.value).sum()))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows of equal keys as whole pandas frames, from batches that are sorted by the keys: many groups in one frame."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        pdf = batch.to_pandas()
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), bool)
        for k in keys:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if last == 0 and (not held or all(pdf[k].iloc[0] == held[-1][k].iloc[-1] for k in keys)):
            held.append(pdf)
            continue
        yield pd.concat([*held, pdf.iloc[:last]], ignore_index=True) if held else pdf.iloc[:last].reset_index(drop=True)
        held = [pdf.iloc[last:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _chain(members: np.ndarray, similar: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Edges of a forest that spans the graph of ``similar``: each text is compared only with those not reached yet."""
    left = members
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = similar(x, left)
            for y in left[near].tolist():
                yield x, y
                queue.append(y)
            left = left[~near]


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Family edges of buckets: rows sorted by (band, key, part); see step 4."""
    for pdf in _runs(batches, ["band", "key", "part"]):
        band, key, part = (pdf[c].to_numpy() for c in ("band", "key", "part"))
        starts = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        ends = np.r_[starts[1:], len(pdf)]
        a, b = [], []
        uids, sigs = pdf["uid"].to_numpy(), pdf["sig"].to_numpy()
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s < 2:
                continue
            m = np.frombuffer(b"".join(sigs[s:e]), np.uint8).reshape(e - s, SAMPLES)
            for x, y in _chain(np.arange(e - s), lambda x, left, m=m: (m[left] == m[x]).sum(1) >= AGREE):
                a.append(uids[s + x])
                b.append(uids[s + y])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def weighted_jaccard_links(texts: list[str], df: Frequencies, threshold: float, hashes: WordHashes | None = None) -> list[tuple[int, int]]:
    """A forest over the texts whose exact weighted Jaccard similarity is at least ``threshold``."""
    hashes = WordHashes() if hashes is None else hashes
    found = list(_hashed(hashes, texts))
    lengths = np.array([len(x) for x, _ in found])
    w = [df.weights(x, tf).astype(np.float64) for x, tf in found]
    total = np.array([v.sum() for v in w])
    if len(texts) == 2:
        if not min(lengths) or min(total) < 0.99 * threshold * max(total):
            return []
        (x, _), (y, _) = found
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        shared = np.minimum(w[0][i], w[1][j]).sum()
        return [(0, 1)] if shared > 0 and shared >= threshold * (total[0] + total[1] - shared) - 1e-9 else []
    # Postings: by shingle, the texts that have it.
    names, ids = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    owner, weight = np.repeat(np.arange(len(texts)), lengths), np.concatenate(w)
    begin = np.r_[0, np.cumsum(lengths)]
    state = {"alive": len(texts) + 1}

    def similar(x: int, left: np.ndarray) -> np.ndarray:
        if len(left) <= state["alive"] // 2 or "ptr" not in state:  # postings of the texts not reached yet
            keep = np.isin(owner, left)
            order = np.argsort(ids[keep], kind="stable")
            state.update(alive=len(left), owner=owner[keep][order], weight=weight[keep][order], ptr=np.searchsorted(ids[keep][order], np.arange(len(names) + 1)))
        own, ptr = ids[begin[x] : begin[x + 1]], state["ptr"]
        size = ptr[own + 1] - ptr[own]
        at = np.repeat(ptr[own] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        both = np.minimum(np.repeat(w[x], size), state["weight"][at])
        shared = np.bincount(state["owner"][at], both, minlength=len(texts))[left]
        return (shared > 0) & (shared >= threshold * (total[x] + total[left] - shared) - 1e-9)

    return list(_chain(np.flatnonzero(lengths), similar))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(classes, rows): (uid, root) of distinct texts that are near another, and (uid, id) of all rows; see :func:`near_classes`."""
    spark = docs.sparkSession
    texts, members = distinct_texts(docs, id_col, text_col)
    texts = spread(texts)
    shared = spark.sparkContext.broadcast(document_frequencies(texts))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = shared.value
        hashes = WordHashes()
        for batch in batches:
            uids, keys, sigs = [], [], []
            held, held_uids, size = [], [], 0

            def flush():
                starts = np.r_[0, np.cumsum([len(x) for x, _ in held])[:-1]].astype(np.int64)
                s = sample(np.concatenate([x for x, _ in held]), np.concatenate([w for _, w in held]), starts)
                bands = np.zeros((len(held), BANDS), np.uint64)
                for j in range(ROWS):
                    bands = bands * _MIX + s[:, j::ROWS]
                uids.extend(held_uids)
                keys.extend(_avalanche(bands).view(np.int64).tolist())
                sigs.extend(row.tobytes() for row in (s & 0xFF).astype(np.uint8))

            for uid, text in zip(batch.column("uid"), batch.column("text"), strict=True):
                x, tf = shingles(hashes.of(words_of(text.as_py())))
                if not len(x):
                    continue
                held.append((x, df.weights(x, tf)))
                held_uids.append(uid.as_py())
                size += len(x)
                if size >= 40_000:
                    flush()
                    held, held_uids, size = [], [], 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["uid", "keys", "sig"])

    signed = stored(texts.select("uid", "text").mapInArrow(sign, "uid binary, keys array<long>, sig binary"), "signatures")

    # Buckets with one text only stay out of the way of the signatures.
    rows = signed.select("uid", "sig", F.posexplode("keys").alias("band", "key"))
    sizes = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes, ["band", "key"])
    # A bucket of more than BUCKET_ROWS is dealt into blocks, and every pair of blocks meets: exact, in bounded memory.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(BUCKET_ROWS // 2))).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    pair = F.when(F.col("blocks") <= 2, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, F.col("own")) * F.col("blocks") + F.greatest(j, F.col("own"))))
    rows = rows.select("band", "key", F.explode(pair).alias("part"), "uid", "sig").repartition("band", "key", "part").sortWithinPartitions("band", "key", "part", "uid")
    chained = rows.mapInArrow(_bucket_edges, "a binary, b binary").distinct()
    families = stored(connected_components(chained), "families")

    # Verification: a family's texts meet once (or once for each pair of its blocks).
    hit = flagged(texts, "uid", key_filter(families.select(F.col("node").alias("uid")), "uid"), "maybe").where("maybe")
    gathered = hit.select("uid", "text").join(families.withColumnRenamed("node", "uid"), "uid")
    lengths = families.join(texts.select(F.col("uid").alias("node"), F.octet_length("text").alias("bytes")), "node").groupBy("root").agg(F.sum("bytes").alias("bytes"))
    lengths = lengths.select("root", F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(BLOCK_BYTES // 2))).cast("int").alias("blocks")).where("blocks > 2")
    lengths = stored(lengths.withColumn("n", F.lit(1)), "large-families")
    gathered = lookup(gathered, lengths, "root", "n", ["uid"]).withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    gathered = gathered.select("root", F.explode(pair).alias("part"), "uid", "text").repartition("root", "part").sortWithinPartitions("root", "part", "uid")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = shared.value
        hashes = WordHashes()
        for pdf in _runs(batches, ["root", "part"]):
            root, part = pdf["root"].to_numpy(), pdf["part"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (part[1:] != part[:-1])])
            a, b = [], []
            for s, e in zip(starts.tolist(), np.r_[starts[1:], len(pdf)].tolist(), strict=True):
                if e - s > 1:
                    uids = pdf["uid"].to_numpy()[s:e]
                    for x, y in weighted_jaccard_links(pdf["text"].iloc[s:e].tolist(), df, threshold, hashes):
                        a.append(uids[x])
                        b.append(uids[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    links = gathered.mapInArrow(verify, "a binary, b binary")
    return stored(connected_components(links).withColumnRenamed("node", "uid"), "classes"), members


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """Classes of near-duplicate documents: id, class_id (the smallest id of the class), class_size, kept.

    Similarity is weighted Jaccard over five-word shingles (see the module); classes are
    connected components of links of at least ``threshold``, and equal texts are always together.

    Edge cases: texts of one to four words are one shingle; texts without words (null,
    empty, only marks) are linked by equality alone; a null id is never a class_id
    while the class has another; rows that repeat an id with an equal text share the class and
    the mark; an empty table gives an empty result; other columns are ignored.
    """
    classes, members = near_duplicates(docs, id_col, text_col, threshold)
    grouped = _grouped(classes, members)
    found = lookup(members, grouped.select("uid", "class_id", "class_size", "n"), "uid", "n", ["id"])
    class_id = F.when(F.col("class_size").isNull(), F.col("id")).otherwise(F.col("class_id"))
    return found.select(F.col("id").alias(id_col), class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.col("id").eqNullSafe(class_id).alias("kept"))


def _grouped(classes: DataFrame, members: DataFrame) -> DataFrame:
    """(uid, n, class_id, class_size, stays) of the texts that share a class or have copies: rows of the text, and the class's first id, size and the text it has.

    Rows are combined by text before anything joins, so a text of any number of copies is one row.
    """
    by_text = members.groupBy("uid").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    by_text = by_text.join(classes, "uid", "left").where("root is not null or n > 1").withColumn("root", F.coalesce("root", "uid"))
    by_text = stored(by_text, "class-texts")
    best = by_text.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "uid")).alias("best"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("texts"))
    best = stored(best.select("root", F.col("best.id").alias("class_id"), F.col("best.uid").alias("stays"), "class_size", "texts"), "class-sizes")
    return stored(lookup(by_text.select("uid", "n", "root"), best, "root", "texts", ["uid"]).drop("root"), "grouped-texts")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, all columns as they are; the smallest id stays.

    Edge cases: as in :func:`near_classes`. A null id stays only where its class has no other; of rows that repeat the id and
    the text that stay, one does; columns of any name, dots included, pass through.
    """
    classes, members = near_duplicates(docs, id_col, text_col, threshold)
    grouped = _grouped(classes, members).select("uid", "n", "stays", "class_id")
    rows = packed_rows(docs, uid=text_key(F.col(f"`{text_col}`")), id=F.col(f"`{id_col}`").cast("long"))
    found = lookup(rows, grouped, "uid", "n", ["id"])
    alone = found.where("stays is null").select("row.*")
    chosen = found.where((F.col("uid") == F.col("stays")) & F.col("id").eqNullSafe(F.col("class_id")))
    # Rows that repeat a chosen id and text: any of them, combined before the shuffle.
    return alone.unionByName(chosen.groupBy("uid").agg(F.first("row").alias("row")).select("row.*"))
