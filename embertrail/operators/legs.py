"""Where the drone was: features joined to their blocks, ranges and lineals of objects, and what happens at a leg's end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embertrail.config import Config
from embertrail.functions import geo, text
from embertrail.operators.frames import mean_of_ends
from embertrail.operators.objects import is_real
from embertrail.operators.spatial import ground


def with_drone(features: DataFrame, drone: DataFrame) -> DataFrame:
    """Features with the step of their block: drone (leg_id, block_id, step_id, drone_n, drone_e, lineal_m); null where a block has none."""
    return features.join(drone, ["leg_id", "block_id"], "left")


def ranges(features: DataFrame, drone: DataFrame) -> DataFrame:
    """feature_id, range_m: distance on the ground from the drone to each feature; null without a place."""
    return with_drone(features, drone).select("feature_id", geo.distance(F.col("northing_m"), F.col("easting_m"), F.col("drone_n"), F.col("drone_e")).alias("range_m"))


def object_ranges(features: DataFrame, locations: DataFrame, drone: DataFrame) -> DataFrame:
    """object_id, avg_range_m (whole metres), avg_lineal_m: means over the blocks of the first and of the last real feature, of the distance
    from the drone to the object and of the drone's way so far; where one is missing the other stands."""
    at = with_drone(features, drone)
    step = F.struct("drone_n", "drone_e", "lineal_m")
    ends = at.groupBy("object_id").agg(F.min_by(step, "feature_id").alias("a"), F.max_by(step, F.when(is_real(), F.col("feature_id"))).alias("b"))
    joined = ends.join(locations, "object_id")
    far = lambda x: geo.distance(F.col("loc_n"), F.col("loc_e"), F.col(f"{x}.drone_n"), F.col(f"{x}.drone_e"))
    return joined.select("object_id", mean_of_ends(far("a"), far("b")).cast("int").alias("avg_range_m"), mean_of_ends(F.col("a.lineal_m"), F.col("b.lineal_m")).alias("avg_lineal_m"))


def cut_by_range(objects: DataFrame, cfg: Config) -> DataFrame:
    """At a leg's end: a significant object that is farther than the limit on average is not significant after all."""
    return objects.withColumn("significant", F.col("significant") & ~F.coalesce(F.col("avg_range_m") > cfg.object_max_range_m, F.lit(False)))


def first_step(features: DataFrame, drone: DataFrame) -> DataFrame:
    """One row: the least step at which any object was first seen."""
    return with_drone(features, drone).groupBy("object_id").agg(F.min_by("step_id", "feature_id").alias("step_id")).agg(F.min("step_id").alias("first_step_id"))


def block_features(features: DataFrame) -> DataFrame:
    """Least and greatest feature id of each block of a leg, and how many it has."""
    return features.groupBy("leg_id", "block_id").agg(F.min("feature_id").alias("min_feature_id"), F.max("feature_id").alias("max_feature_id"), F.count("*").alias("n_features"))


def central_feature(features: DataFrame) -> DataFrame:
    """The feature at half of each object's count, in order of id. An object's ids are in one group, as the order is its own."""
    w = Window.partitionBy("object_id")
    turn = F.row_number().over(w.orderBy("feature_id")) - 1
    return features.select("object_id", "feature_id", turn.alias("_i"), F.count("*").over(w).alias("_n")).where("_i = _n div 2").select("object_id", F.col("feature_id").alias("central_feature_id"))


def in_draw_scope(first: Column, last: Column, upto: Column, save_mode: str) -> Column:
    """Whether a feature is drawn: its block lies in the scope and not after the block shown; unreal ones only if all are kept."""
    seen = (F.col("block_id") >= first) & (F.col("block_id") <= F.least(last, upto))
    return seen if save_mode == "All" else seen & is_real()


def buckets(objects: DataFrame) -> DataFrame:
    """Height in half metres and size in steps of 100 cm2, both cut down."""
    return objects.withColumns({"height_bucket": (F.col("height") * 2).cast("int") / 2, "size_bucket": (F.col("size_cm2") / 100).cast("int") * 100})


def id_by_name(objects: DataFrame, name: str) -> DataFrame:
    """One row: the least id of the objects with a name, null if there is none."""
    return objects.where(F.col("name") == name).agg(F.min("object_id").alias("object_id"))


def by_line_of_sight(algorithm: Column) -> Column:
    """Whether a height was found along the line of sight."""
    return F.coalesce(algorithm.startswith("LOS"), F.lit(False))


def saves_video(wanted: Column, fps: Column, width: Column, height: Column) -> Column:
    """Whether an annotated video is written: asked for, with a frame rate and a size."""
    return F.coalesce(wanted & (fps > 0.1) & (width > 0) & (height > 0), F.lit(False))


def taken_at(start: Column, ms: Column) -> Column:
    """A frame's time of day: the video's start and the milliseconds into it."""
    return F.timestamp_micros(F.unix_micros(start) + ms.cast("long") * 1000)


def pivoted_matrix(objects: DataFrame, sizes: list[str], heights: list[str]) -> DataFrame:
    """Significant objects with a known height: a row for each height class and one for all (null), a column for each size class, the row's
    total, and how many of them have a category."""
    known = objects.where(F.col("significant") & F.col("height_class").isin(heights))
    return known.rollup("height_class").agg(*[F.count_if(F.col("size_class") == s).alias(f"n_{s.lower()}") for s in sizes], F.count("*").alias("n_all"), F.count_if(F.col("category") != "").alias("n_categorised"))


def object_details(objects: DataFrame, drone: DataFrame, sections: DataFrame, cfg: Config) -> DataFrame:
    """Report rows of significant objects: name, seconds into the video, size, heat, place, and the file of the image that first showed
    each: its first block's step, and the section (step_id, image_file_name) of that step. Empty where there is none."""
    steps = drone.select("leg_id", F.col("block_id").alias("first_block"), "step_id")
    found = objects.where("significant").join(steps, ["leg_id", "first_block"], "left").join(sections.select("step_id", "image_file_name"), "step_id", "left")
    return found.select(
        "object_id", "name", F.round(F.col("first_block") / F.lit(cfg.fps), 3).alias("seen_s"), "size_cm2", "max_hot", "avg_heat", "max_heat", F.when(F.col("max_heat_px") > 0, F.col("max_heat_px")).alias("num_max_heat"),
        text.location(F.round(F.round("loc_n", 6)), F.round(F.round("loc_e", 6))).alias("location"), F.coalesce("image_file_name", F.lit("")).alias("image_file_name"))


def triangulation_residual(rays: DataFrame, points: DataFrame) -> DataFrame:
    """object_id, residual: the root of the summed fourth powers of the distances between an object's rays (c_e, c_n, c_a, d_e, d_n, d_a) and
    its point (east, north, up). One row an object is joined back; rays never meet in a task."""
    near = rays.join(points.select("object_id", "east", "north", "up"), "object_id")
    v = [F.col(p) - F.col(f"c_{c}") for c, p in (("e", "east"), ("n", "north"), ("a", "up"))]
    d = [F.col(f"d_{c}") for c in "ena"]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    away = dot(v, v) - F.try_divide(dot(v, d) * dot(v, d), dot(d, d))
    return near.groupBy("object_id").agg(F.sqrt(F.sum(away * away)).alias("residual"))


def swathe(drone: DataFrame, half_m: int) -> DataFrame:
    """leg_id, n_cell, e_cell: each square metre of ground within half_m of the drone's cell at any step, once a leg. Standing still adds
    nothing, as cells are made distinct before they are spread."""
    over = drone.select("leg_id", F.floor("drone_n").alias("n"), F.floor("drone_e").alias("e")).where("n is not null and e is not null").distinct()
    around = F.sequence(F.lit(-half_m), F.lit(half_m))
    rows = over.withColumn("n_cell", F.explode(F.transform(around, lambda x: x + F.col("n")))).drop("n").distinct()
    return rows.withColumn("e_cell", F.explode(F.transform(around, lambda x: x + F.col("e")))).drop("e").distinct()


def key_results(objects: DataFrame, seen: DataFrame) -> DataFrame:
    """leg_id, animals, swathe_km2, density: significant objects to the square kilometre of ground seen; 0 where none was seen."""
    area = seen.groupBy("leg_id").agg((F.count("*") / 1e6).alias("swathe_km2"))
    found = objects.groupBy("leg_id").agg(F.count_if("significant").alias("animals")).join(area, "leg_id", "left")
    return found.select("leg_id", "animals", F.coalesce("swathe_km2", F.lit(0.0)).alias("swathe_km2"), F.coalesce(F.try_divide("animals", "swathe_km2"), F.lit(0.0)).alias("density"))


def elevation_bars(objects: DataFrame, ranges: DataFrame, dem: DataFrame) -> DataFrame:
    """A bar for each significant object: from its least to its greatest height over the ground at its place, along the drone's way, as wide
    as its place is uncertain. Null where the grid ends."""
    at = ground(objects.where("significant").join(ranges.select("object_id", "avg_lineal_m"), "object_id", "left"), dem, "loc_n", "loc_e")
    up = lambda c: F.col("elev_m") + F.col(c)
    return at.select("object_id", up("min_height").alias("bottom"), up("height").alias("middle"), up("max_height").alias("top"), (F.col("avg_lineal_m") - F.col("loc_err")).alias("from_m"), (F.col("avg_lineal_m") + F.col("loc_err")).alias("to_m"))
