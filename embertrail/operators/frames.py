"""Frames, run ranges, spans and detections: guards, selections and fixes around the main pipeline."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embertrail.functions import geo
from embertrail.functions.rect import Rect

#: Lower ends of the density shades in percent.
SHADES = (0, 3, 6, 9, 12, 15)
#: The thermal camera's field of view and aspect.
THERMAL_FOV_DEG, THERMAL_ASPECT = 45.0, 1.25


def in_ranges(frames: DataFrame, ranges: list[tuple[int, int]], column: str = "ms") -> DataFrame:
    """Frames in any of the run's ranges, both ends included. A handful of literal ranges: the filter reaches the scan."""
    parts = [F.col(column).between(a, b) for a, b in ranges]
    return frames.where(reduce(lambda x, y: x | y, parts) if parts else F.lit(False))


def can_locate(down_deg: Column, distance_down_m: Column) -> Column:
    """Whether a frame is worth placing: the camera looks down enough and stands high enough."""
    return F.coalesce((down_deg >= geo.MIN_DOWN_DEG) & (distance_down_m >= geo.MIN_DISTANCE_DOWN_M), F.lit(False))


def guarded(blocks: DataFrame, features: DataFrame, ok: Column) -> DataFrame:
    """All blocks; features only for those where ok holds."""
    return blocks.join(features, (blocks["block_id"] == features["f_block_id"]) & ok, "left")


def progress(current: Column, last: Column, elapsed_s: Column) -> tuple[Column, Column]:
    """Percent done, and seconds left (null below 1 %)."""
    share = F.try_divide(current.cast("double"), last)
    return F.coalesce(F.least(F.lit(100), (share * 100).cast("int")), F.lit(0)), F.when(share > 0.01, elapsed_s / share - elapsed_s)


def excluded_detection(box: Rect, left: int, top: int, width: int, height: int) -> Column:
    """Whether a detection touches the excluded corner of the image."""
    corner = Rect(F.lit(left), F.lit(top), F.lit(width - left), F.lit(height - top))
    return box.overlap_area(corner) > 0


def shade(percent: Column) -> Column:
    """0 to 5 by density; below 0 the darkest, as everything outside the table."""
    out = F.lit(len(SHADES) - 1)
    for i, low in reversed(list(enumerate(SHADES[:-1]))):
        out = F.when((percent >= low) & (percent < SHADES[i + 1]), F.lit(i)).otherwise(out)
    return out


def optical_crop(width: Column, height: Column, optical_fov_deg: Column) -> Rect:
    """The part of an optical image that the thermal camera sees: centred, of thermal aspect, within both field-of-view limits."""
    scale = F.lit(math.tan(math.radians(THERMAL_FOV_DEG / 2))) / F.tan(F.radians(optical_fov_deg / 2))
    by_height = height * scale * THERMAL_ASPECT <= width * scale
    w = F.when(by_height, height * scale * THERMAL_ASPECT).otherwise(width * scale)
    h = F.when(by_height, height * scale).otherwise(width * scale / THERMAL_ASPECT)
    whole = scale >= 1
    w = F.when(whole, width).otherwise(F.greatest(F.bround(w).cast("int"), F.lit(1)))
    h = F.when(whole, height).otherwise(F.greatest(F.bround(h).cast("int"), F.lit(1)))
    return Rect(((width - w) / 2).cast("int"), ((height - h) / 2).cast("int"), w, h)


def body_ray(px: Column, py: Column, roll: Column, pitch: Column, yaw: Column) -> geo.Vector:
    """The ray of a doubled pixel for triangulation: K^-1 with a negated horizontal focal length on a 1280 x 1024 image, then the inverse of
    Rz(yaw) Ry(90 + pitch) Rx(roll)."""
    fx, fy = -9.1 * 1280 / 7.68, 9.1 * 1024 / 6.144
    u, v = (px + 640.0) / 2, (py + 512.0) / 2
    x, y, z = (u - 640.0) / fx, (v - 512.0) / fy, F.lit(1.0)
    r, p, w = F.radians(roll), F.radians(pitch + 90), F.radians(yaw)
    # the transpose: first -yaw about z, then -pitch about y, then -roll about x
    x, y = x * F.cos(w) + y * F.sin(w), -x * F.sin(w) + y * F.cos(w)
    x, z = x * F.cos(p) - z * F.sin(p), x * F.sin(p) + z * F.cos(p)
    return x, y * F.cos(r) + z * F.sin(r), -y * F.sin(r) + z * F.cos(r)


def los_confidence(hits: DataFrame, key: str) -> DataFrame:
    """Rows (key, offset 0 / 1 / 2, hit_e, hit_n, hit_up) for a pixel and its neighbours right and below -> confidence of each key; 0 if a neighbour has no hit."""
    at = lambda k, c: F.max(F.when(F.col("offset") == k, F.col(c)))
    wide = hits.groupBy(key).agg(*[at(k, f"hit_{c}").alias(f"{c}{k}") for k in range(3) for c in ("e", "n", "up")])
    return wide.select(key, shift_confidence().alias("confidence"))


def shift_confidence() -> Column:
    """The same of a row with the three hits as e0, n0, up0, e1 and so on."""
    shift = lambda k: F.sqrt(sum(((F.col(f"{c}{k}") - F.col(f"{c}0")) * (F.col(f"{c}{k}") - F.col(f"{c}0")) for c in ("n", "up")), (F.col(f"e{k}") - F.col("e0")) * (F.col(f"e{k}") - F.col("e0"))))
    return F.coalesce(geo.confidence((shift(1) + shift(2)) / 2), F.lit(0.0))


def altitude_fix(errors: DataFrame, least_gain_m: float = 0.1) -> DataFrame:
    """Rows (span, fix_m, sum_err) of trial altitudes -> the best per span: trials from high to low, each taken only if it lowers the sum
    found so far by at least 0.1 m. The fold runs over one span's trials, 181 at most."""
    trials = F.reverse(F.array_sort(F.collect_list(F.struct("fix_m", "sum_err"))))
    start = F.struct(F.lit(0.0).alias("fix_m"), F.lit(float("inf")).alias("sum_err"))
    better = lambda best, t: F.when(best["sum_err"] - t["sum_err"] >= least_gain_m, F.struct(t["fix_m"].cast("double").alias("fix_m"), t["sum_err"].cast("double").alias("sum_err"))).otherwise(best)
    return errors.groupBy("span").agg(trials.alias("t")).select("span", F.aggregate("t", start, better).alias("b")).select("span", F.col("b.fix_m").alias("fix_m"), F.col("b.sum_err").alias("sum_err"))


def fixed_steps(steps: DataFrame, spans: DataFrame) -> DataFrame:
    """Steps with the altitude fix of the span they lie in; spans without a fix leave theirs alone."""
    live = spans.where(F.col("best_fix_alt_m") != 0).select("flight_id", "min_step_id", "max_step_id", "best_fix_alt_m")
    live = live.withColumnRenamed("flight_id", "_f")
    on = (steps["flight_id"] == live["_f"]) & steps["step_id"].between(live["min_step_id"], live["max_step_id"])
    return steps.join(live, on, "left").drop("_f", "min_step_id", "max_step_id")


def first_run(spans: DataFrame, order: str, match: Column, flight: str = "flight_id") -> DataFrame:
    """The first unbroken run of matching rows in each flight: its ends."""
    w = Window.partitionBy(flight).orderBy(order)
    marked = spans.withColumn("_m", F.coalesce(match, F.lit(False))).withColumn("_new", (F.col("_m") & ~F.coalesce(F.lag("_m").over(w), F.lit(False))).cast("int"))
    first = marked.withColumn("_run", F.sum("_new").over(w)).where(F.col("_m") & (F.col("_run") == 1))
    return first.groupBy(flight).agg(F.min(order).alias("first"), F.max(order).alias("last"))


def mean_of_ends(first: Column, last: Column) -> Column:
    """Mean of two values; a missing one gives way to the other."""
    return F.coalesce((first + last) / 2, first, last)


def union_features(*lists: DataFrame, key: str = "feature_id") -> DataFrame:
    """All features of several lists; an id that occurs twice is an error when the result is read."""
    both = reduce(DataFrame.unionByName, lists)
    twice = F.count("*").over(Window.partitionBy(key)) > 1
    return both.withColumn("_ok", F.when(twice, F.raise_error(F.lit("a feature id occurs twice")).cast("boolean")).otherwise(True)).where("_ok").drop("_ok")
