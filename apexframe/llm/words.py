"""Words of a text as the corpus operators cut them: lower-cased A-Z, digits, letters and all beyond ASCII."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes of words keep their (lower-cased) value, every other ASCII byte becomes a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Words whose hashes a worker remembers before it starts afresh.
CACHE_WORDS = 500_000


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WordHashes(dict):
    """Stable 64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
