"""Lexical features of texts: lower-cased words without punctuation around them, and their first letters."""

from __future__ import annotations

_EDGE = b".,;:!?*$#%&\"'()[]{}<>|/\\-_=+~`^@"
PREFIXES = (4, 5, 6)
#: Entries of a worker's cache of word -> features.
CACHE = 100_000
#: Caches that outlive a task of a worker.
KEPT: dict = {}


def word_features(word: bytes) -> tuple[bytes, ...]:
    """The word, and its prefixes of 4 to 6 letters (with a star)."""
    word = word.strip(_EDGE)
    if word.isascii():
        word = word.lower()
        return (word, *(word[:k] + b"*" for k in PREFIXES if len(word) > k)) if word else ()
    text = word.decode(errors="replace").lower()
    return (text.encode(), *(text[:k].encode() + b"*" for k in PREFIXES if len(text) > k))


class Cache(dict):
    """word -> make(word) of the last `most` to 2 * `most` words seen: when full, its words become the old generation, from which those
    that are met again return. So frequent words stay and its size is bounded. A cache lives as long as its task, unless it is put into
    KEPT; another operator's task in the same worker empties that."""

    def __init__(self, make, most: int = CACHE, kept: bool = False):
        super().__init__()
        if not kept:
            KEPT.clear()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
        self[word] = out
        return out
