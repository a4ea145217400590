"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair tokens.

A text is cut into pieces by the vocabulary's pattern. Within a piece the encoding of
a prefix is the encoding of a shorter prefix plus one last token, and which token that is
follows from one rule: two neighbouring tokens stand in an encoding exactly if merging
their joined bytes gives these two tokens again. So one pass over a piece gives
the last token and the exact count at each byte. Pieces recur, so each worker keeps the
tables of the pieces it has seen, up to a bound. Over a text the counts at piece ends are
prefix sums; any prefix, truncation or budget is then answered from the table and at
most two pieces at the cut.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces and token pairs that a worker remembers before it starts afresh.
CACHE_PIECES = 700_000
CACHE_PAIRS = 300_000
CACHE_PIECE_CHARS = 64

# Fixed value: the cut pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same over ASCII, for the faster engine.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
# Unicode white space, stated so that no engine's own notion of it matters.
SPACE = "\t-\r \x85\xa0  -     　"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: a byte stands for itself if printable, else for 256 + its rank."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts of a byte-level BPE vocabulary file (JSON of the ``tokenizers`` library), special strings as in its default."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.tokens = {raw(s) for s in spec["model"]["vocab"] if all(c in alphabet for c in s)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.parts = {a + b: (a, b, rank) for (a, b), rank in sorted(self.ranks.items(), key=lambda x: -x[1])}
        self.prefixes = {t[:n]: False for t in self.tokens for n in range(1, len(t))} | dict.fromkeys(self.tokens, True)
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.cut = regex.compile(PATTERN.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]").replace(f"[^[{SPACE}]", f"[^{SPACE}"))
        self.cut_ascii = re.compile(ASCII_PATTERN)
        self.totals: dict[str, int] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})

    def merge(self, data: bytes) -> list[bytes]:
        """Plain merging: the definition that the pair rule is tested with."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at one edge of a token while it is merged, each with the rank at which it is merged on."""
        known = self.edges[side].get(token)
        if known is None:
            known, part, until = [], token, 1 << 30
            while part:
                known.append((part, until))
                made = self.parts.get(part)
                part, until = (made[side], made[2]) if made else (b"", 0)
            known.reverse()
            self.edges[side][token] = known
        return known

    def _stands(self, left: bytes, right: bytes) -> bool:
        """Whether merging left + right never merges across their border.

        The parts at the border grow in the order of their ranks; a merge across happens when its
        rank comes before the next growth on both sides (of equal ranks the leftmost goes first).
        """
        a, b, ranks = self._edge(left, 1), self._edge(right, 0), self.ranks
        i = j = 0
        while True:
            (x, next_x), (y, next_y) = a[i], b[j]
            across = ranks.get((x, y))
            if across is not None and across < next_x and across <= next_y:
                return False
            if next_x == next_y == 1 << 30:
                return True
            if next_x <= next_y:
                i += 1
            else:
                j += 1

    def may_follow(self, left: bytes, right: bytes) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._stands(left, right)
        return known

    def piece_counts(self, piece: bytes) -> list[int]:
        """Tokens of every byte prefix of a piece; entry i is for the first i bytes."""
        starts, pairs, n = self.prefixes, self.pairs, len(piece)
        counts, last = [0] * (n + 1), [b""] * (n + 1)
        for start in range(n):
            before, so_far = last[start], counts[start] + 1
            for end in range(start + 1, n + 1):
                token = piece[start:end]
                whole = starts.get(token)
                if whole is None:
                    break
                if whole and not last[end]:
                    if start:
                        ok = pairs.get((before, token))
                        if ok is None:
                            ok = self.may_follow(before, token)
                        if not ok:
                            continue
                    counts[end], last[end] = so_far, token
        return counts

    def piece_total(self, piece: str) -> int:
        n = self.totals.get(piece)
        if n is None:
            data = piece.encode()
            n = 1 if data in self.tokens else self.piece_counts(data)[-1]
            if len(piece) <= CACHE_PIECE_CHARS:
                if len(self.totals) >= CACHE_PIECES:
                    self.totals.clear()
                self.totals[piece] = n
        return n

    def _plain_pieces(self, text: str) -> list[str]:
        return (self.cut_ascii if text.isascii() else self.cut).findall(text)

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """(piece, is a special token) from left to right; the pieces joined are the text."""
        if self.special is None or not self.special.search(text):
            return [(p, False) for p in self._plain_pieces(text)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(p, False) for p in self._plain_pieces(text[at : m.start()])] + [(m[0], True)]
            at = m.end()
        return out + [(p, False) for p in self._plain_pieces(text[at:])]

    def total(self, text: str) -> int:
        """Tokens of the whole text: the last entry of its prefix table."""
        if self.special is not None and self.special.search(text):
            return sum(1 if special else self.piece_total(p) for p, special in self.pieces(text))
        get, n = self.totals.get, 0
        found = list(map(get, pieces := self._plain_pieces(text)))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self.piece_total(pieces[i])
        n = sum(found)
        return n

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class PrefixTable:
    """The exact count of every prefix of one text (in characters), without encoding it again."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.starts, self.before, at, n = [], [], 0, 0
        for piece, special in counter.pieces(text):
            self.starts.append(at)
            self.before.append(n)
            at += len(piece)
            n += 1 if special else counter.piece_total(piece)
        self.total = n

    def at(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters."""
        if chars >= len(self.text):
            return self.total
        if chars <= 0:
            return 0
        # A cut changes the piece it falls into, and the one before where that is white space or joins up.
        k = max(0, bisect_right(self.starts, chars - 1) - 2)
        tail = self.text[self.starts[k] : chars]
        return self.before[k] + sum(1 if special else self.counter.piece_total(p) for p, special in self.counter.pieces(tail))

    def truncate(self, budget: int) -> int:
        """The longest prefix, in characters, of at most ``budget`` tokens that ends with a piece, or within one by less than a piece."""
        if self.total <= budget:
            return len(self.text)
        k = max(0, bisect_right(self.before, budget) - 1)
        upper = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
        return next((c for c in range(upper, max(0, self.starts[k] - 1), -1) if self.at(c) <= budget), 0)


@lru_cache(maxsize=2)
def counter_for(path: str) -> PrefixCounter:
    """One counter for each worker process and vocabulary."""
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, prefixes: bool = False) -> DataFrame:
    """Exact counts of whole texts: id, n_bytes, n_tokens, over_limit; with ``prefixes`` also the table at piece ends.

    ``vocabulary`` is the path of the vocabulary file on every machine. ``prefixes`` adds
    piece_starts and tokens_before (arrays): before the piece that starts at a character, so many tokens.

    Edge cases: a null or empty text has no tokens; null and repeated ids are kept as
    they are; special strings inside a text count as one token (the library's default);
    an empty table gives an empty result; other columns are ignored.
    """
    fields = [pa.field("id", pa.int64()), pa.field("n_bytes", pa.int64()), pa.field("n_tokens", pa.int64())]
    schema = "id long, n_bytes long, n_tokens long"
    if prefixes:
        fields += [pa.field("piece_starts", pa.list_(pa.int32())), pa.field("tokens_before", pa.list_(pa.int32()))]
        schema += ", piece_starts array<int>, tokens_before array<int>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(vocabulary)
        for batch in batches:
            ids, sizes, totals, starts, before = batch.column(0), [], [], [], []
            for scalar in batch.column(1):
                text = scalar.as_py()
                sizes.append(len(text.encode()))
                if prefixes:
                    t = counter.table(text)
                    totals.append(t.total)
                    starts.append(t.starts)
                    before.append(t.before)
                else:
                    totals.append(counter.total(text))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), *([pa.array(starts, pa.list_(pa.int32())), pa.array(before, pa.list_(pa.int32()))] if prefixes else [])], schema=pa.schema(fields))

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.mapInArrow(count, schema)
    out = [F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")]
    return counted.select(*out, *(["piece_starts", "tokens_before"] if prefixes else []))
