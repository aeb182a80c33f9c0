"""Toxicity by non-negative positive-unlabelled learning.

Positives are texts confirmed toxic, the rest of the corpus is unlabelled. A numpy linear classifier on lexical features is trained with
the class-prior-corrected risk  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))  and logistic loss; where the
bracket turns negative, its gradient is turned round, as in the published algorithm. Labels of held-out rows are never read. A feature's
value is the log of its count over the root of the text's number of distinct words, so words that are only more frequent in toxic texts
count too, and long texts do not turn toxic by length.

Features are counted in Spark over all confirmed positives and, as far as these or the sample have them often enough, over all documents
that are not held out. Those that are clearly more frequent
among positives than overall become the vocabulary, and those that are clearly rarer; weights may take either sign. The fit reads a bounded
sample (at most about POSITIVES confirmed and UNLABELLED other texts, chosen by a hash of the text; equal texts are one row with a weight),
of which only the features' indices and values come to the driver. Scoring is one pass over whole texts.

Defined cases: null and empty texts have no features and get the intercept's score; with no positives every score is 0; null labels are
not used; a null id is held out; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialise, ready, release, sampled, spread, table
from .features import Cache, word_features

#: The bounds of the training sample, and the size of the model: twice as many features at most, the most frequent ones of either set.
POSITIVES, UNLABELLED, VOCABULARY = 4000, 12_000, 1 << 16
#: A feature must be in so many positives and stand out by so many standard errors, or be in so many documents and be rarer among positives
#: by so many; the weights decide on the rest.
LEAST_POSITIVES, LEAST_Z, LEAST_DOCUMENTS, LEAST_BELOW = 3, 2.0, 20, 3.0
#: A feature that positives lack must be in so many texts of the sample to be counted at all; rarer ones cannot stand out.
LEAST_SAMPLED = 5
#: Ids that every task may hold: 8 MB.
BROADCAST_IDS = 1_000_000
#: The scale of feature values, which are small.
SCALE = 5.0


class Model:
    def __init__(self, vocabulary: dict[bytes, int], weights: np.ndarray, bias: float):
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias

    def indices(self) -> Cache:
        return Cache(lambda w: tuple(i for f in word_features(w) if (i := self.vocabulary.get(f)) is not None))

    def scorer(self):
        cache, weights, bias = self.indices(), self.weights, self.bias

        def score(raw: bytes | None) -> float:
            at, x = vector(raw, cache)
            g = bias + float(weights[at] @ x)
            return float(1 / (1 + np.exp(-min(40.0, max(-40.0, g)))))

        return score


def vector(raw: bytes | None, cache: Cache) -> tuple[np.ndarray, np.ndarray]:
    """The feature indices of a text, in order, and their values."""
    words = Counter(raw.split()) if raw else {}
    found: dict[int, int] = {}
    for w, n in words.items():
        for i in cache[w]:
            found[i] = found.get(i, 0) + n
    at = sorted(found)
    return np.array(at, np.int32), np.log1p(np.array([found[i] for i in at], np.float32)) * np.float32(SCALE / max(1, len(words)) ** 0.5)


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, d: int, prior: float, steps: int = 500, rate: float = 0.05, decay: float = 1e-4, values: list[np.ndarray] | None = None, weights: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk. rows: the feature indices of each text; values: the features' values, else 1; weights of rows, else 1."""
    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate([*rows, np.array([], np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    x = np.ones(len(flat)) if values is None else np.concatenate([*values, np.zeros(0)])
    each = np.ones(len(rows)) if weights is None else weights
    share_p, share_u = (each * of / max(1, (each * of).sum()) for of in (positive, ~positive))
    theta, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    theta[d] = -1.0
    for step in range(1, steps + 1):
        g = np.bincount(owner, theta[flat] * x, len(rows)) + theta[d]
        s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
        minus = ((share_u - prior * share_p) * np.logaddexp(0, g)).sum()
        d_plus, d_minus = -prior * share_p * (1 - s), (share_u - prior * share_p) * s
        pull = d_plus + d_minus if minus >= 0 else -d_minus
        grad = np.concatenate([np.bincount(flat, pull[owner] * x, d), [pull.sum()]])
        grad[:d] += decay * theta[:d]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:d], float(theta[d])


def feature_counts(texts: DataFrame, only: dict[bytes, int] | None = None) -> DataFrame:
    """text (binary) -> f, n: in how many rows each feature occurs. only: these features, by number; their number comes as f."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[bytes, int] = {} if only is None else only
        if only is None:
            cache: Cache = Cache(lambda w: tuple(ids.setdefault(f, len(ids)) for f in word_features(w)), 50_000)
        else:
            cache = Model(only, np.zeros(0), 0.0).indices()
        n = np.zeros(0, np.int64)
        seen: list[np.ndarray] = []

        def add() -> None:
            nonlocal n
            more = np.bincount(np.concatenate([np.zeros(0, np.int64), *seen]), minlength=max(len(ids), len(n)))
            more[: len(n)] += n
            n = more
            seen.clear()

        def part() -> pa.RecordBatch:
            add()
            at = np.flatnonzero(n)
            names = pa.array(list(ids), pa.binary()).take(pa.array(at)) if only is None else pa.array(at, pa.int32())
            return pa.RecordBatch.from_arrays([names, pa.array(n[at], pa.int64())], ["f", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.append(np.unique(np.fromiter(chain.from_iterable(map(cache.__getitem__, set(text.split()) if text else ())), np.int64)))
            add()
            if only is None and len(ids) > 200_000:  # part of the counts; Spark adds them up
                yield part()
                ids.clear(), cache.clear(), cache.old.clear()
                n = np.zeros(0, np.int64)
        yield part()

    kind = "binary" if only is None else "int"
    return texts.mapInArrow(count, f"f {kind}, n long").groupBy("f").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    ready(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_known, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not n_toxic:
        return Model({}, np.zeros(0), -40.0)
    prior = min(0.9, n_toxic / n_known)
    some = docs.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("text").cast("binary").alias("text"))
    toxic = known.where("toxic = 1").select("doc_id")
    if n_toxic <= BROADCAST_IDS:  # beyond, the planner filters the texts by a Bloom filter of the ids before it shuffles them
        toxic = F.broadcast(toxic)
    confirmed = materialise(some.join(toxic, "doc_id", "left_semi").select("text"), "toxicity-positives")
    n_p, n_u = confirmed.count(), some.count()
    unlabelled = materialise(sampled(some.select("text"), UNLABELLED, "text"), "toxicity-unlabelled")
    # what may stand out either way: features of the positives, and those that a sample of the corpus knows
    p = materialise(feature_counts(confirmed).where(F.col("n") >= LEAST_POSITIVES).withColumnRenamed("n", "p"), "toxicity-counts")
    s = feature_counts(unlabelled.select("text")).where(F.col("n") >= LEAST_SAMPLED).orderBy(F.col("n").desc(), "f").limit(VOCABULARY)
    may = [(bytes(r["f"]), r["p"] or 0) for r in p.orderBy(F.col("p").desc(), "f").limit(VOCABULARY).join(s, "f", "full").select("f", "p").orderBy("f").collect()]
    # their counts over the whole corpus
    n = np.zeros(len(may))
    for r in feature_counts(some.select("text"), {f: i for i, (f, _) in enumerate(may)}).collect():  # at most 2 * VOCABULARY rows
        n[r["f"]] = r["n"]
    count_p = np.array([c for _, c in may], float)
    rate_p, rate_u = count_p / max(1, n_p), (n + 0.5) / max(1, n_u)  # positives are documents, too
    z = (rate_p - rate_u) / np.sqrt(np.maximum(rate_p, 1 / max(1, n_p)) / max(1, n_p) + rate_u / max(1, n_u))
    chosen = np.flatnonzero(((count_p >= LEAST_POSITIVES) & (z >= LEAST_Z)) | ((n >= LEAST_DOCUMENTS) & (z <= -LEAST_BELOW)))
    vocabulary = {may[k][0]: i for i, k in enumerate(chosen)}
    model = Model(vocabulary, np.zeros(len(vocabulary)), 0.0)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = model.indices()
        for b in batches:
            rows = [vector(t, cache) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([at.tobytes() for at, _ in rows], pa.binary()), pa.array([x.tobytes() for _, x in rows], pa.binary()), b.column(1), b.column(2)], ["at", "x", "repeats", "positive"])

    parts = [sampled(confirmed, POSITIVES, "text").withColumn("positive", F.lit(True)), unlabelled.withColumn("positive", F.lit(False))]
    rows = parts[0].unionAll(parts[1]).mapInArrow(index, "at binary, x binary, repeats long, positive boolean").toArrow()
    release(confirmed, unlabelled, p)
    got = sorted(zip(*(rows.column(c).to_pylist() for c in ("positive", "at", "x", "repeats")), strict=True))  # rows arrive in any order
    read = lambda i, kind: [np.frombuffer(r[i], kind) for r in got]
    weights, bias = fit_nnpu(read(1, np.int32), np.array([r[0] for r in got], bool), len(vocabulary), prior, values=read(2, np.float32), weights=np.array([r[3] for r in got], float))
    used = [f for f, i in vocabulary.items() if weights[i]]
    return Model({f: i for i, f in enumerate(used)}, weights[[vocabulary[f] for f in used]], bias)


def score_column(model: Model, text: Column) -> Column:
    """The score of each text, as a column: rows keep all they have."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for b in batches:
            yield pd.Series([one(t) for t in b], dtype=float)

    return score(F.coalesce(text, F.lit("")).cast("binary"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
