"""Quality rules: base rules, then gradient-boosted trees over document statistics.

The trees are fitted on the driver from at most about `sample` labelled documents (only their statistics are gathered, a few floats
each), with monotonic constraints: symbols, doubled lines, repeats, exclamation marks and capitals may only lower the score. Scoring is
one pass over the whole texts in Arrow batches; no shuffle.

Defined cases: null, empty and blank texts have counts of 0 and fail the base rules; a null id stays; repeated rows are judged alike;
with no labels, or labels of one class, the trees say that class's rate for all; null labels are not used; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_keys, held_out, ready, sampled, spread, table
from .gbt import Trees, fit
from .stats import COUNTS, RATIOS, text_stats

SAMPLE = 16_000
#: +1, -1 or 0 by ratio: the direction in which the quality score may move.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "bang_per_word": -1, "upper_share": -1, "unique_share": 0}
LEAST_WORDS, MOST_REPEATS = 20, 30


def labelled(docs: DataFrame, labels: DataFrame, column: str, sample: int) -> DataFrame:
    """doc_id, text, y of at most about `sample` labelled rows that are not held out; rows that repeat id and text are one."""
    ids = labels.where(F.col(column).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    chosen = bounded_keys(ids, "doc_id", sample)  # bounded, so it is broadcast
    return sampled(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), sample, "doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.array(text_stats(t)[1]).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column(1)], ["x", "y"])

    ready(docs.sparkSession)
    rows = labelled(docs, labels, "quality", sample).select(F.col("text").cast("binary"), "y").mapInArrow(gather, "x binary, y int").toArrow()
    x = np.frombuffer(b"".join(rows.column(0).to_pylist()), np.float64).reshape(-1, len(RATIOS))
    y = rows.column(1).to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # rows arrive in any order
    return fit(x[order], y[order], np.array([MONOTONE.get(r, 0) for r in RATIOS]))


def judge(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, text -> doc_id, the counts, base_failed, score, kept."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [text_stats(t) for t in b.column(1).to_pylist()]
            if not stats:
                continue
            counts = np.array([s[0] for s in stats], np.int64)
            n, repeats = counts[:, 0], counts[:, 4]
            failed = (n < LEAST_WORDS) | (100 * repeats > MOST_REPEATS * n)
            p = trees.score(np.array([s[1] for s in stats]))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (*counts.T.copy(), failed, p, ~failed & (p >= 0.5)))], names)

    names = ["doc_id", *COUNTS, "base_failed", "score", "kept"]
    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(score, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
