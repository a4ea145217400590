"""SimHash near duplicates: links at small Hamming distance by meeting in the middle.

1. A fingerprint has a bit for each of 64 places: set if over half of the text's three-word shingles have it in their hash.
2. Documents of one fingerprint are one row of a combined aggregate, whatever their number.
3. Every distinct fingerprint sends out all its variants within half the radius: itself and each one-bit flip, 65 rows of 16 bytes. Two
   fingerprints within the radius share a variant, and a variant is shared by 65 fingerprints at most, so no group of the shuffle grows.
4. Fingerprints that collide on a variant are chained in order; pairs are deduplicated and verified by their distance. Any two that collide are within
   the radius, so the chain links all that the pairs would.
5. Connected components of the links; a component's id is the smallest document in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexframe.llm.common import connected_components, lookup, spread, stored

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 2
#: Shingles whose bits are summed at once.
BLOCK = 1 << 16

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text; zero without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []  # bytes split at \\x20 and \\x09-\\x0D alone
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans, digest = zip(starts, ends[size - 1 :], strict=False), xxhash.xxh64_intdigest
    total, ones = len(words) - size + 1, np.zeros(BITS, np.int64)
    while chunk := [digest(joined[s:e], SEED) for (s, e), _ in zip(spans, range(BLOCK), strict=False)]:
        ones += np.unpackbits(np.array(chunk, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])


def variants(fp: Column) -> Column:
    """All 64-bit words within one bit of ``fp``."""
    return F.array(fp, *(fp.bitwiseXOR(F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long")) for k in range(BITS)))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all at RADIUS or fewer differing bits."""
    sent = prints.select("fp", F.explode(variants(F.col("fp"))).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))  # 65 rows at most
    met = sent.select(before.alias("a"), F.col("fp").alias("b")).where("a is not null").distinct()
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, fingerprint (16 lower-case hex digits) and component_id, the smallest id that links reach, the document's own included.

    Edge cases: null and empty texts and texts without words have fingerprint zero and are linked by it like any other; one or two words are one
    shingle; a null id is a component_id only where its component has no other; repeated rows are rows like any other; an empty table gives
    an empty result; other columns are ignored.
    """
    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    rows = stored(rows.mapInArrow(_fingerprints, "id long, fp long"), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    roots = connected_components(fingerprint_links(prints)).withColumnRenamed("node", "fp")
    known = stored(prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "fingerprint-roots")
    least = stored(known.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("prints")), "least-documents")
    table = stored(lookup(known.select("fp", "n", "root"), least, "root", "prints", ["fp"], whole=True).drop("root"), "components")
    found = lookup(rows, table, "fp", "n", ["id"], whole=True)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
