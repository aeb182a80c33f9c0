"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document; each flaw shows in the votes of several. Votes are counted by
pattern over the whole corpus (at most 3^labellers patterns, whatever its size). Expectation-maximisation on the pattern counts then
estimates how often each labeller votes bad on good documents and on each kind of bad ones. Bad documents have different flaws, so the bad
class is a mixture with one kind a labeller, and the start treats all labellers alike: right with HIT, wrong with MISS. Priors are a few
pseudo-votes (PSEUDO), so the counts decide; kinds that nobody needs die out. The posterior of a pattern is the label of its documents, and
one vote does not decide it. A hashed linear scorer is trained on at most about `sample` different texts with these soft labels and scores
every whole text.

Defined cases: null and empty texts get the votes of an empty text and the scorer's intercept; repeated rows score alike; null ids stay;
an empty table gives an empty result. No human label is read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, sampled, spread, table
from .features import Cache
from .stats import RATIOS, text_stats

SAMPLE, BITS = 6000, 14
HIT, MISS, PSEUDO, STEPS = 0.7, 0.3, 5.0, 200
#: labeller -> statistic, bad outside these values, good between those. Every flaw moves several of the statistics.
LABELLERS = {
    "symbols": ("symbols_per_word", (0.0, 0.2), (0.0, 0.02)),
    "marks": ("mark_share", (0.0, 0.1), (0.0, 0.06)),
    "repeats": ("repeat_share", (0.0, 0.3), (0.0, 0.05)),
    "variety": ("unique_share", (0.3, 1.0), (0.45, 1.0)),
    "echo": ("echo_share", (0.0, 0.2), (0.0, 0.05)),
    "capitals": ("upper_share", (0.0, 0.3), (0.0, 0.1)),
    "exclaims": ("bang_per_word", (0.0, 0.2), (0.0, 0.02)),
    "rhythm": ("words_per_stop", (1.5, 60.0), (4.0, 30.0)),
    "lines": ("dup_line_share", (0.0, 0.25), (0.0, 0.05)),
    "length": ("log_words", (1.3, 99.0), (4.1, 99.0)),
}
STATS = (*RATIOS, "echo_share", "words_per_stop")
_RULES = tuple((STATS.index(name), *bad, *good) for name, bad, good in LABELLERS.values())


def statistics(raw: bytes | None) -> tuple[float, ...]:
    """The ratios of a text, the share of words that equal the one before, and words by sentence end."""
    ratios = text_stats(raw)[1]
    words = raw.split() if raw else []
    if not words:
        return (*ratios, 0.0, 0.0)
    echo = sum(map(eq, words, islice(words, 1, None))) / max(1, len(words) - 1)
    stops = sum(raw.count(mark + space) for mark in (b".", b"!", b"?") for space in (b" ", b"\n")) + raw.endswith((b".", b"!", b"?"))
    return (*ratios, echo, len(words) / max(1, stops))


def votes(stats: tuple[float, ...]) -> int:
    """The votes as a base-3 number, 0 nothing, 1 bad, 2 good by labeller."""
    code = 0
    for i, low, high, least, most in _RULES:
        x = stats[i]
        code = code * 3 + (2 if least <= x <= most else 0 if low <= x <= high else 1)
    return code


def posteriors(codes: np.ndarray, n: np.ndarray, labellers: int, steps: int = STEPS, one_kind: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM on pattern counts: P(good | pattern); P(bad vote | class, labeller votes) by class, the good one first, then the kinds of bad
    ones; P(class). Votes of nothing say nothing. one_kind: bad documents are all alike, and each labeller may see their flaw."""
    v = np.stack([codes // 3**i % 3 for i in range(labellers)][::-1], 1) if len(codes) else np.zeros((0, labellers), int)
    bad, good, n = (v == 1).astype(float), (v == 2).astype(float), n.astype(float)
    kinds = 1 if one_kind else labellers
    start = np.full((1 + kinds, labellers), MISS)
    start[1 + np.arange(kinds), np.arange(kinds)] = HIT
    start[1:] = HIT if one_kind else start[1:]
    rate, share = start.copy(), np.concatenate([[0.5], np.full(kinds, 0.5 / kinds)])
    for _ in range(steps):
        log = np.log(share) + bad @ np.log(rate.T) + good @ np.log(1 - rate.T)
        own = np.exp(log - log.max(1, keepdims=True))
        own /= own.sum(1, keepdims=True)
        held = own * n[:, None]
        share = (held.sum(0) + 1) / (n.sum() + len(share))
        said_bad, said_good = held.T @ bad + PSEUDO * start, held.T @ good + PSEUDO * (1 - start)
        rate = said_bad / (said_bad + said_good)
    return own[:, 0], rate, share


#: ASCII letters and digits by their class; other characters stand for themselves.
_CLASS = bytes(65 if 65 <= b < 91 else 97 if 97 <= b < 123 else 48 if 48 <= b < 58 else b for b in range(256))
_RUN = re.compile(r"(.)\1+", re.S)


def _hashed(word: bytes) -> tuple[int, int]:
    """Buckets of the lower-cased word and of its shape (letter cases, digits and marks, runs shortened)."""
    text = word.decode(errors="replace")
    classes = word.translate(_CLASS).decode() if word.isascii() else "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in text)
    return zlib.crc32(text.lower().encode()) >> (32 - BITS), zlib.crc32(b"\0" + _RUN.sub(r"\1", classes)[:8].encode()) >> (32 - BITS)


def vector(raw: bytes | None, ratios: tuple[float, ...], cache: Cache) -> tuple[np.ndarray, np.ndarray]:
    """Bucket indices and weights: log counts of words and shapes, to length 1, then the statistics in steps of a tenth."""
    words = raw.split() if raw else []
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    at, n = np.unique(np.fromiter((i for w in words for i in cache[w]), np.int32, 2 * len(words)), return_counts=True)
    x = np.log1p(n).astype(np.float32)
    steps = [zlib.crc32(f"\1{name} {int(r * 10)}".encode()) >> (32 - BITS) for name, r in zip(RATIOS, ratios, strict=False)]
    return np.concatenate([at, np.array(steps, np.int32)]), np.concatenate([x / np.sqrt((x * x).sum()), np.full(len(steps), 0.3, np.float32)])


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weights: np.ndarray, steps: int = 200, rate: float = 0.1, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels of rows with weights, full-batch Adam; the intercept comes last."""
    d = 1 << BITS
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]) if rows else np.zeros(0, int)
    at = np.concatenate([np.zeros(0, np.int32), *(r[0] for r in rows)]).astype(np.int64)
    x = np.concatenate([np.zeros(0, np.float32), *(r[1] for r in rows)]).astype(np.float64)
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, (steps if rows else 0) + 1):
        s = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[at] * x, len(rows)) + w[d], -40, 40)))
        r = (s - y) * weights / weights.sum()
        g = np.concatenate([np.bincount(at, r[owner] * x, d), [r.sum()]]) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def label(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, text (binary), pattern: the labellers' votes of each document."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([votes(statistics(t)) for t in b.column(1).to_pylist()], pa.int32())], ["doc_id", "pattern"])

    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(vote, f"doc_id {kind}, pattern int")


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text -> doc_id, pattern, label_posterior, score, predicted."""
    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = label(docs).groupBy("pattern").count().orderBy("pattern").collect()  # at most 3^labellers rows
    codes, n = np.array([r[0] for r in counts], np.int64), np.array([r[1] for r in counts])
    p, _, _ = posteriors(codes, n, len(LABELLERS))
    known = {int(c): float(x) for c, x in zip(codes, p, strict=True)}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: Cache = Cache(_hashed)
        for b in batches:
            texts = b.column(0).to_pylist()
            stats = [statistics(t) for t in texts]
            rows = [vector(t, s, cache) for t, s in zip(texts, stats, strict=True)]
            y = [known[votes(s)] for s in stats]
            yield pa.RecordBatch.from_arrays([pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array(y, pa.float64()), b.column(1)], ["at", "x", "y", "repeats"])

    some = sampled(docs.select(F.col("text").cast("binary").alias("text")), sample, "text")
    got = sorted(zip(*(c.to_pylist() for c in some.mapInArrow(gather, "at binary, x binary, y double, repeats long").toArrow().columns), strict=True))
    w = fit_linear([(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32)) for a, x, _, _ in got], np.array([r[2] for r in got]), np.array([r[3] for r in got], float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: Cache = Cache(_hashed)
        for b in batches:
            texts = b.column(1).to_pylist()
            stats = [statistics(t) for t in texts]
            pattern = [votes(s) for s in stats]
            raw = np.array([float(w[at] @ x) for at, x in (vector(t, s, cache) for t, s in zip(texts, stats, strict=True))]) + w[-1]
            s = 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pattern, pa.int32()), pa.array([known.get(c, 0.5) for c in pattern], pa.float64()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names)

    names = ["doc_id", "pattern", "label_posterior", "score", "predicted"]
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(score, f"doc_id {kind}, pattern int, label_posterior double, score double, predicted int")


def op2_weak_labels(spark, sf_dir: str) -> DataFrame:
    return classify(spread(table(spark, sf_dir, "documents")))
