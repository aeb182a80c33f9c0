"""Features placed along the line of sight: guards, three casts, height over the ground, and how sure the place is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrail.functions import geo
from embertrail.operators.frames import los_confidence, shift_confidence
from embertrail.operators.spatial import caster, ground, held_grid, raycast

#: What stands for the way a height was found.
FOUND, NOT_FOUND = "LOS", "NoResult"


def can_see() -> Column:
    """The camera looks down far enough and the drone is high enough."""
    return F.coalesce((F.lit(90) - F.col("camera_to_vertical_deg") >= geo.MIN_DOWN_DEG) & (F.col("distance_down_m") >= geo.MIN_DISTANCE_DOWN_M) & F.col("drone_n").isNotNull() & F.col("drone_e").isNotNull(), F.lit(False))


def _direction(offset: Column) -> geo.Vector:
    """(east, up, north) of the ray through the middle of a feature's box (0), a pixel to the right (1) or below (2)."""
    x = F.col("box_x") + F.col("box_w") / 2.0 + (offset == 1).cast("int")
    y = F.col("box_y") + F.col("box_h") / 2.0 + (offset == 2).cast("int")
    return geo.to_world(geo.camera_ray(x, y), (F.lit(90) - F.col("camera_to_vertical_deg")).cast("double"), F.col("yaw_deg").cast("double"))


def rays(features: DataFrame) -> DataFrame:
    """Three rays for each feature that can be seen (_ray: 4 * feature_id + 0, 1, 2): through the middle of its box, and a pixel to the right
    and below."""
    middle = features.where(can_see()).withColumn("_offset", F.explode(F.sequence(F.lit(0), F.lit(2))))
    e, up, n = _direction(F.col("_offset"))
    return middle.select((F.col("feature_id") * 4 + F.col("_offset")).alias("_ray"), F.col("drone_n").alias("north"), F.col("drone_e").alias("east"), F.col("altitude_m").alias("altitude"), n.alias("d_n"), up.alias("d_up"), e.alias("d_e"))


def line_of_sight(features: DataFrame, dem: DataFrame) -> DataFrame:
    """Features (feature_id, box, drone_n, drone_e, altitude_m, yaw_deg, camera_to_vertical_deg, distance_down_m) with northing_m, easting_m,
    height_m, height_algorithm and confidence, all set anew. Without a view all are null but confidence, which is 0; a ray that meets no
    ground is `NoResult`. Height is the hit over the ground's cell there, null where the grid has none. Over a grid that a task can hold,
    the three rays of a feature are cast in its row and nothing is moved."""
    new = ("northing_m", "easting_m", "height_m", "height_algorithm", "confidence")
    own = [c for c in features.columns if c not in new]
    if (grid := held_grid(dem)) is not None:
        cast = caster(dem, grid)
        place = [F.when(can_see(), F.col(c)).cast("double") for c in ("drone_n", "drone_e", "altitude_m")]
        hits = features.select(*own, can_see().alias("_seen"), *[cast(*place, n, up, e).alias(f"_h{k}") for k in range(3) for e, up, n in [_direction(F.lit(k))]])
        wide = hits.select(*own, "_seen", F.col("_h0.ground").alias("_ground"), *[F.col(f"_h{k}.hit_{c}").alias(f"{c}{k}") for k in range(3) for c in ("e", "n", "up")])
        way = F.when(F.col("_seen"), F.when(F.col("n0").isNotNull(), FOUND).otherwise(NOT_FOUND))
        return wide.select(*own, F.col("n0").alias("northing_m"), F.col("e0").alias("easting_m"), (F.col("up0") - F.col("_ground")).alias("height_m"), way.alias("height_algorithm"), shift_confidence().alias("confidence"))
    hits = raycast(rays(features), dem, "_ray").select(F.expr("_ray div 4").alias("feature_id"), (F.col("_ray") % 4).alias("offset"), "hit_n", "hit_e", "hit_up")
    placed = ground(hits.where("offset = 0").select("feature_id", "hit_n", "hit_e", "hit_up"), dem, "hit_n", "hit_e")
    out = features.drop(*new).join(placed, "feature_id", "left").join(los_confidence(hits, "feature_id"), "feature_id", "left")
    way = F.when(can_see(), F.when(F.col("hit_n").isNotNull(), FOUND).otherwise(NOT_FOUND))
    return out.select(*own, F.col("hit_n").alias("northing_m"), F.col("hit_e").alias("easting_m"), (F.col("hit_up") - F.col("elev_m")).alias("height_m"), way.alias("height_algorithm"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
