"""Schemas of the stored tables. Missing values are null; sentinels exist only at the import and export edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def _schema(fields: str) -> T.StructType:
    """`name type, ...`; needs no running session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(", "))])


FRAME = _schema("flight_id long, frame_id int, ms int, height int, width int, data binary")
PIXEL = _schema("flight_id long, block_id int, y int, x int, heat int")
STEP = _schema("flight_id long, step_id int, sum_time_ms long, leg_id int, northing_m double, easting_m double, altitude_m double, yaw_deg double, pitch_deg double, roll_deg double, dem_m double, dsm_m double, sum_lineal_m double, camera_to_vertical_deg double, fixed_distance_down_m double, image_area_m2 double")
BLOCK = _schema("flight_id long, block_id int, flight_step_id int, leg_id int, input_frame_id int, input_frame_ms int, min_feature_id int, max_feature_id int")
FEATURE = _schema("feature_id long, is_tracked boolean, significant boolean, object_id long, block_id int, type string, northing_m double, easting_m double, height_m double, height_algorithm string, box_x int, box_y int, box_w int, box_h int, min_heat int, max_heat int, num_hot int, sum_hot int, num_max_heat int, leg_id int, range_m double")
OBJECT = _schema("object_id long, name string, leg_id int, significant boolean, attributes string, num_real_features int, num_significant_blocks int, max_num_hot int, max_sum_hot int, size_cm2 long, size_class string, height_m double, height_err_m double, height_class string, northing_m double, easting_m double, location_err_m double, avg_range_m int, avg_lineal_m double, run_from_block int, run_to_block int")
SPAN = _schema("process_span_id int, name string, num_significant_objects int, best_fix_alt_m double, best_sum_locn_err_m double, best_sum_height_err_m double, org_sum_locn_err_m double, org_sum_height_err_m double, min_step_id int, max_step_id int, min_block_id int, max_block_id int")
CATEGORY = _schema("object_name string, category string, include boolean, notes string")
DEM = _schema("n_cell int, e_cell int, elev_m double")
DETECTION = _schema("block_id int, left int, top int, width int, height int, label string, confidence double")

#: What a missing number and a missing height are on disk.
UNKNOWN, UNKNOWN_HEIGHT = -999.0, -2.0


def from_sentinel(c: Column, sentinel: float = UNKNOWN) -> Column:
    return F.when(c != sentinel, c)


def to_sentinel(c: Column, sentinel: float = UNKNOWN) -> Column:
    return F.coalesce(c, F.lit(sentinel).cast("double"))


def parse_settings(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns in schema order -> typed columns; blank is null, bad numbers are null, booleans are the word true."""
    out = []
    for text, field in zip(df.columns, schema.fields, strict=True):
        c = F.nullif(F.trim(F.col(text)), F.lit(""))
        out.append((F.lower(c) == "true" if isinstance(field.dataType, T.BooleanType) else c.try_cast(field.dataType)).alias(field.name))
    return df.select(out)


def to_settings(df: DataFrame) -> DataFrame:
    """Typed columns -> text, the inverse of parse_settings."""
    return df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
