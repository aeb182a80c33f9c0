"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time 0..1, given as knots (time, weight) joined by straight lines. A source's
target (in words) is spread over time in proportion to its schedule: cumulative demand D(t) = target * integral(0..t) / integral(0..1).
Documents of a source stand in a fixed pseudo-random order; the word at which a copy of a document starts is looked up in the inverse
of D, which gives the copy's training position. The mix is the copies sorted by position.

Prefix sums are taken in two levels (hash bucket within source, then rows within bucket), so a source with most of all rows is
spread over many tasks. Everything is native Spark.

Defined cases: null text has size 0; a null source is a source of its own, last in order; documents of size 0 take 0 words; repeated
rows are separate documents; an empty table gives an empty result; null ids are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

#: Schedules by rank of the source modulo 3: early, constant and late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
WEIGHTS = (3, 1, 2)
SHARE, MOST_PASSES = 1.5, 2
#: Rows of a bucket aimed at.
BUCKET_ROWS = 512
#: `arrange` knows each source's words by ranges of the digest, this many for all sources together (and one a source at least).
RANGES = 1 << 16


def position(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the cumulative integral of a piecewise-linear schedule reaches `share` (0..1) of its total."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False)]
    total, done, out = sum(areas), 0.0, None
    for ((t0, w0), (t1, w1)), area in zip(zip(schedule, schedule[1:], strict=False), areas, strict=True):
        a, slope = share * total - done, (w1 - w0) / (t1 - t0)
        # w0 x + slope x^2 / 2 = a, in the form that is stable for a slope near 0
        x = F.lit(2.0) * a / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2.0 * slope) * a, F.lit(0.0)))) if area > 0 else F.lit(0.0)
        here = F.least(F.lit(t0) + x, F.lit(t1))
        out = here if out is None else F.when(share * total <= done, out).otherwise(here)
        done += area
    return out


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size) -> the same with rank, weight and target. One row per source.

    Targets fill up like water: all get level * weight, but no more than `most` times their size; the level is found in closed form
    from prefix sums over the sources sorted by most * size / weight."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    up = Window.orderBy((F.lit(most) * F.col("source_size")).cast("double") / F.col("weight"), "rank")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = F.lit(most) * F.col("source_size")
    level = (F.lit(share) * F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum(cap).over(before), F.lit(0)).cast("double")) / F.sum("weight").over(after).cast("double")
    full = ranked.withColumn("full", cap.cast("double") <= level * F.col("weight").cast("double"))
    left = F.lit(share) * F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum(F.when(F.col("full"), cap)).over(everything), F.lit(0)).cast("double")
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything).cast("double")
    return full.withColumn("target", F.when(F.col("full"), cap.cast("double")).otherwise(left * F.col("weight").cast("double") / open_weight)).drop("full")


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (doc_id, text, source, ...) -> row (a struct of the keep columns, whatever their names), size, source_size, target, taken,
    passes (position, words of each copy), position of the first."""
    base = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.coalesce("source", F.lit("")).alias("_src"), F.col("source").isNull().alias("_null"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_h"), F.xxhash64("text").alias("_t"))
    if "text" not in keep:  # small rows are kept, so that texts are read once; whole documents are read again instead
        base = materialise(base, "mixing")
    n = docs.count()
    # buckets are ranges of the digest, so that bucket order is digest order
    bits = min(48, max(4, (n // BUCKET_ROWS).bit_length()))
    base = base.withColumn("_b", F.shiftright(F.conv(F.substring("_h", 1, 12), 16, 10).cast("long"), 48 - bits))
    # a null source is a key of its own: two plain columns, so that windows and joins have the same keys and share one shuffle
    own = ["_src", "_null"]
    sums = materialise(base.groupBy(*own, "_b").agg(F.sum("size").alias("_s")), "mixing-sums")
    source = F.when(~F.col("_null"), F.col("_src"))
    per_source = targets(sums.groupBy(*own).agg(F.sum("_s").alias("source_size")).withColumn("source", source)).select(*own, "source_size", "target", "rank")
    before = Window.partitionBy(*own).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*own, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base")).join(per_source, own)
    inside = Window.partitionBy(*own, "_b").orderBy("_h", "size", "_t").rowsBetween(Window.unboundedPreceding, -1)
    out = base.withColumn("_c", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, [*own, "_b"])
    at = F.col("_base") + F.col("_c")
    limit = F.floor(F.col("target"))
    took = [F.greatest(F.least(limit - (at + F.lit(i) * F.col("source_size")), F.col("size")), F.lit(0)) for i in range(MOST_PASSES)]
    when = []
    for i in range(MOST_PASSES):
        begun = F.when(F.col("target") > 0, F.least((at + F.lit(i) * F.col("source_size")).cast("double") / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
        p = position(begun, SCHEDULES[0])
        for r, s in enumerate(SCHEDULES[1:], 1):
            p = F.when(F.col("rank") % len(SCHEDULES) == r, position(begun, s)).otherwise(p)
        when.append(p)
    return out.select(F.col("_row").alias("row"), "size", "source_size", "target", sum(took[1:], took[0]).alias("taken"), when[0].alias("position"),
                      F.array(*[F.struct(w.alias("position"), t.alias("words")) for w, t in zip(when, took, strict=True)]).alias("passes"))


def _spot() -> Column:
    """A document's fixed pseudo-random place in its source, as 48 bits: by its id, then its text, so that only equal rows tie."""
    digest = F.md5(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha1(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def arrange(docs: DataFrame, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """docs (doc_id, text, source, ...) -> the same columns, each document as often as the mix takes it, range-sorted by position.

    The same curriculum as `mix` for whole documents. One pass over the texts counts words by source and range of the digest (at most
    RANGES rows, or one a source). The cumulative demand is exact at the ends of a range and goes straight between them, so a document's
    start follows from its own digest: the texts take no part in a window or a sized join, and move once, copies and all, straight to
    their range of positions. A copy is taken if it starts before its source's target; documents without words are not taken."""
    own = ["_src", "_null"]
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"), F.coalesce("source", F.lit("")).alias("_src"), F.col("source").isNull().alias("_null"), _spot().alias("_spot"))
    size = F.coalesce(F.regexp_count("_text", F.lit(WORD)), F.lit(0)).cast("long")
    finest = 12  # bits of the ranges as they are counted first
    sums = materialise(keyed.groupBy(*own, F.shiftright("_spot", 48 - finest).alias("_b")).agg(F.sum(size).alias("_s")), "arrange-sums")
    per_source = targets(sums.groupBy(*own).agg(F.sum("_s").alias("source_size")).withColumn("source", F.when(~F.col("_null"), F.col("_src"))), share=share, most=most)
    per_source = materialise(per_source.select(*own, "source_size", "target", "rank"), "arrange-sources")
    bits = min(finest, max(0, (RANGES // max(1, per_source.count())).bit_length() - 1))
    ranges = sums.groupBy(*own, F.shiftright("_b", finest - bits).alias("_b")).agg(F.sum("_s").alias("_s"))
    before = Window.partitionBy(*own).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).join(per_source, own)
    ranges = materialise(ranges, "arrange-ranges")
    if ranges.count() <= RANGES:  # bounded, so every task may have them; many more sources meet their documents in a join
        ranges = F.broadcast(ranges)
    width = float(1 << (48 - bits))
    held = keyed.where(F.col("_text").rlike(WORD)).drop("_text").withColumn("_b", F.shiftright("_spot", 48 - bits)).join(ranges, [*own, "_b"])
    within = F.col("_spot").bitwiseAND(F.lit((1 << (48 - bits)) - 1)).cast("double") / F.lit(width)
    start = F.col("_base").cast("double") + within * F.col("_s").cast("double")
    begun = [start + F.lit(float(i)) * F.col("source_size").cast("double") for i in range(most)]
    when = []
    for b in begun:
        done = F.least(b / F.col("target"), F.lit(1.0))
        p = position(done, SCHEDULES[0])
        for r, s in enumerate(SCHEDULES[1:], 1):
            p = F.when(F.col("rank") % len(SCHEDULES) == r, position(done, s)).otherwise(p)
        when.append(F.when(b < F.col("target"), p))
    places = F.array_compact(F.array(*when))
    return held.select("_row", F.explode(places).alias("_at"), "_spot").orderBy("_at", "_spot").select("_row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mix(table(spark, sf_dir, "documents")).select("row.doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


#: The same by plain windows.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM r),
l AS (SELECT *, (1.5e0 * CAST(SUM(source_size) OVER () AS DOUBLE) - CAST(COALESCE(SUM(2 * source_size) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
  / CAST(SUM(weight) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
f AS (SELECT *, CAST(2 * source_size AS DOUBLE) <= level * CAST(weight AS DOUBLE) AS is_full FROM l),
t AS (SELECT source, source_size, rk, CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE) ELSE
  (1.5e0 * CAST(SUM(source_size) OVER () AS DOUBLE) - CAST(COALESCE(SUM(CASE WHEN is_full THEN 2 * source_size END) OVER (), 0) AS DOUBLE)) * CAST(weight AS DOUBLE)
  / CAST(SUM(CASE WHEN NOT is_full THEN weight END) OVER () AS DOUBLE) END AS target FROM f),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.rk,
  CAST(COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begun
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN target > 0 THEN LEAST(CAST(begun AS DOUBLE) / target, 1e0) ELSE 0e0 END AS a FROM c)
SELECT doc_id, size, source_size, target,
  CAST(GREATEST(LEAST(CAST(floor(target) AS BIGINT) - begun, size), 0) + GREATEST(LEAST(CAST(floor(target) AS BIGINT) - (begun + source_size), size), 0) AS BIGINT) AS taken,
  CASE rk % 3 WHEN 1 THEN LEAST(2e0 * a / (1e0 + sqrt(GREATEST(1e0 + 0e0 * a, 0e0))), 1e0)
    WHEN 2 THEN LEAST(2e0 * a / (0.5e0 + sqrt(GREATEST(0.25e0 + 2e0 * a, 0e0))), 1e0)
    ELSE LEAST(2e0 * a / (1.5e0 + sqrt(GREATEST(2.25e0 + -2e0 * a, 0e0))), 1e0) END AS position
FROM p
"""
