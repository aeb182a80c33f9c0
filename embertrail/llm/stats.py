"""Statistics of a whole text, from its UTF-8 bytes."""

from __future__ import annotations

import numpy as np

#: Fixed values of the base rules: symbol characters and the words of a window.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("log_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "unique_share", "upper_share", "digit_share", "mark_share", "bang_per_word", "line_words", "non_ascii_share")

_SPACE = np.array([9, 10, 11, 12, 13, 32])
_SYMBOLS = np.frombuffer(SYMBOLS, np.uint8)
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _windows(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of 8 ids, by doubling."""
    h, have = ids.astype(np.uint64), 1
    for mix in _MIX:
        h = (h[:-have] * mix) ^ ((h[have:] + np.uint64(0x632BE59BD9B4E019)) * _MIX[0])
        h ^= h >> np.uint64(29)
        have *= 2
    assert have == size
    return h


def repeated_words(ids: np.ndarray, size: int = WINDOW) -> int:
    """Words in windows of `size` words that occur twice or more, each word once."""
    if len(ids) <= size:
        return 0
    h = _windows(ids, size)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    a, b = order[1:][same], order[:-1][same]
    view = np.lib.stride_tricks.sliding_window_view(ids, size)
    if not (view[a] == view[b]).all():  # two windows share a hash: count the windows themselves
        _, group, n = np.unique(view, axis=0, return_inverse=True, return_counts=True)
        at = np.flatnonzero(n[group.ravel()] > 1)
    else:
        at = np.concatenate([a, b])
    edge = np.zeros(len(ids) + 1, np.int32)
    at = np.unique(at)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_stats(raw: bytes | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts and the ratios, in the orders of COUNTS and RATIOS; all 0 for null, empty and blank texts."""
    words = raw.split() if raw else []
    if not words:
        return (0,) * len(COUNTS), (0.0,) * len(RATIOS)
    n = len(words)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = len(raw) - int(by[0x80:0xC0].sum())
    word_chars = chars - int(by[_SPACE].sum())
    symbols = int(by[_SYMBOLS].sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()] if b"\n" in raw else [raw]
    dup_lines = len(lines) - len(set(lines))
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeats = repeated_words(ids) if len(known) < n else 0
    upper, lower, digits = int(by[65:91].sum()), int(by[97:123].sum()), int(by[48:58].sum())
    marks = int(by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum())
    ratios = (float(np.log1p(n)), word_chars / n, symbols / n, dup_lines / len(lines), repeats / n, len(known) / n, upper / max(1, upper + lower), digits / word_chars,
              marks / word_chars, int(by[33]) / n, n / len(lines), int(by[0xC0:].sum()) / word_chars)
    return (n, word_chars, symbols, dup_lines, repeats), ratios
