"""Blocks joined to flight telemetry: as-of join, interpolation, deltas, running sums, islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEP_COLUMNS = ("step_id", "ms", "northing_m", "easting_m", "altitude_m", "yaw_deg", "pitch_deg", "dem_m")


def as_of(blocks: DataFrame, steps: DataFrame, flight: str = "flight_id") -> DataFrame:
    """Each block with the latest step at or before it (before_*) and that step's successor (after_*); nulls where there is none.

    Steps and blocks of a flight are merged by time in one sorted window, so the join is one shuffle and one sort."""
    cols = [c for c in STEP_COLUMNS if c in steps.columns]
    own = Window.partitionBy(flight).orderBy("step_id")
    packed = steps.select(flight, F.col("ms").alias("_ms"), F.struct(*[F.col(c) for c in cols], *[F.lead(c).over(own).alias(f"next_{c}") for c in cols]).alias("_s"))
    both = packed.select(flight, "_ms", F.lit(0).alias("_k"), "_s", F.lit(None).cast(blocks.select(F.struct("*")).schema[0].dataType).alias("_b")).unionByName(
        blocks.select(flight, F.col("ms").alias("_ms"), F.lit(1).alias("_k"), F.lit(None).cast(packed.schema["_s"].dataType).alias("_s"), F.struct("*").alias("_b")))
    w = Window.partitionBy(flight).orderBy("_ms", "_k", F.col("_s.step_id")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_s", F.last("_s", ignorenulls=True).over(w)).where("_k = 1")
    return found.select("_b.*", *[F.col(f"_s.{c}").alias(f"before_{c}") for c in cols], *[F.col(f"_s.next_{c}").alias(f"after_{c}") for c in cols])


def interpolate(joined: DataFrame) -> DataFrame:
    """Linear between the steps around a block; a missing side gives way to the other; the closest step is the earlier one up to half way."""
    span = F.col("after_ms") - F.col("before_ms")
    weight = F.when(span > 0, (F.col("ms") - F.col("before_ms")).cast("double") / span)
    out = joined.withColumn("weight", weight)
    for c in ("northing_m", "easting_m", "altitude_m", "yaw_deg", "pitch_deg"):
        a, b = F.col(f"before_{c}"), F.col(f"after_{c}")
        out = out.withColumn(c, F.when(a.isNotNull() & b.isNotNull() & F.col("weight").isNotNull(), a + (b - a) * F.col("weight")).otherwise(F.coalesce(a, b)))
    return out.withColumn("closest_step_id", F.when(F.col("after_step_id").isNull() | (F.coalesce("weight", F.lit(0.0)) <= 0.5), F.col("before_step_id")).otherwise(F.col("after_step_id")))


def deltas(blocks: DataFrame, flight: str = "flight_id", fps: float = 30.0) -> DataFrame:
    """time_ms since the block before (a frame's length for the first, or when time does not go on), lineal_m moved, and its running sum."""
    w = Window.partitionBy(flight).orderBy("block_id")
    ms = F.col("ms") - F.lag("ms").over(w)
    d_n, d_e = F.col("northing_m") - F.lag("northing_m").over(w), F.col("easting_m") - F.lag("easting_m").over(w)
    out = blocks.withColumn("time_ms", F.when(ms > 0, ms).otherwise(F.lit(int(1000 / fps)).cast("long"))).withColumn("lineal_m", F.coalesce(F.sqrt(d_n * d_n + d_e * d_e), F.lit(0.0)))
    return out.withColumn("sum_lineal_m", F.sum("lineal_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def bursts(blocks: DataFrame, flight: str = "flight_id", gap: int = 8) -> DataFrame:
    """Runs of blocks with significant objects; more than `gap` blocks without one end a run."""
    hot = blocks.where("num_sig > 0")
    w = Window.partitionBy(flight).orderBy("block_id")
    begins = F.coalesce((F.col("block_id") - F.lag("block_id").over(w) > gap + 1).cast("int"), F.lit(1))
    runs = hot.withColumn("burst", F.sum(begins).over(w))
    return runs.groupBy(flight, "burst").agg(F.min("block_id").alias("min_block"), F.max("block_id").alias("max_block"), F.count("*").alias("n_blocks"), F.max("num_sig").alias("most_sig"))


def nearest_block(blocks: DataFrame, ms: int, flight: str = "flight_id") -> DataFrame:
    """The block closest to a time in each flight; the earlier one of two."""
    return blocks.groupBy(flight).agg(F.min_by("block_id", F.struct(F.abs(F.col("ms") - ms), F.col("block_id"))).alias("block_id"))


def display_sample(blocks: DataFrame, flight: str = "flight_id", every: int = 100) -> DataFrame:
    """Every 100th block, the first and the last two of each flight."""
    last = blocks.groupBy(flight).agg(F.min("block_id").alias("_a"), F.max("block_id").alias("_z"))
    return blocks.join(last, flight).where((F.col("block_id") % every == 0) | (F.col("block_id") == F.col("_a")) | (F.col("block_id") >= F.col("_z") - 1)).drop("_a", "_z")
