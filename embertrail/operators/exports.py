"""Animals, waypoints and their CSV, JSON and KML forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrail.functions import geo
from embertrail.operators.annotations import annotate
from embertrail.operators.objects import length_cm

ORIGIN = (-36.85, 174.76)
#: Fixed values of a waypoint: altitude, speed, tilt, wait.
ALTITUDE_M, SPEED, TILT, WAIT_S = 100, 5, 90, 2
HEADER = ("LATITUDE", "LONGITUDE", "ALTITUDEAGL", "SPEED", "PICTURE", "WP", "CAMERATILT", "UAVYAW", "WAITTIME")


def animals(objects: DataFrame, categories: DataFrame) -> DataFrame:
    """Significant objects with place, size, height and category; missing heights and errors are -2."""
    lat, lon = geo.to_lat_lon(F.col("loc_n"), F.col("loc_e"), *ORIGIN)
    known = annotate(objects.where("significant"), categories)
    gone = lambda c: F.coalesce(F.round(c, 4), F.lit(-2.0)).alias(c)
    return known.select("object_id", "name", F.round(lat, 7).alias("latitude"), F.round(lon, 7).alias("longitude"), gone("loc_err"), gone("height"), gone("height_err"), "size_cm2", "size_class", "height_class", "max_heat", F.coalesce("category", F.lit("")).alias("category"))


def camera_down(vertical_deg: Column) -> Column:
    return F.bround(F.lit(90) - vertical_deg).cast("int")


def spine_m(spine_px: Column, area_m2: Column, cfg) -> Column:
    return length_cm(spine_px, area_m2, cfg) / 100


def waypoints(animals_: DataFrame, selected: bool = False) -> DataFrame:
    """One waypoint per animal with a place, numbered by object id; selected: those with a category other than Ignore."""
    rows = animals_.where(F.col("latitude").isNotNull())
    if selected:
        rows = rows.where(~F.col("category").isin("", "Ignore"))
    return rows.select("object_id", "latitude", "longitude", F.lit(ALTITUDE_M).alias("altitude"), F.lit(SPEED).alias("speed"), F.lit(True).alias("picture"), F.lit(TILT).alias("tilt"), F.lit(WAIT_S).alias("wait"))


def csv_lines(points: DataFrame, full: bool = True) -> DataFrame:
    """object_id, line. The order of lines is that of object_id."""
    short = [F.col("latitude").cast("string"), F.col("longitude").cast("string"), F.col("altitude").cast("string"), F.col("speed").cast("string")]
    more = [F.when(F.col("picture"), "TRUE").otherwise("FALSE"), F.lit(""), F.coalesce(F.col("tilt").cast("string"), F.lit("")), F.lit(""), F.coalesce(F.col("wait").cast("string"), F.lit(""))]
    return points.select("object_id", F.concat_ws(",", *short, *(more if full else [])).alias("line"))


def json_segments(points: DataFrame) -> DataFrame:
    """object_id, segment: one JSON object per waypoint, nulls dropped."""
    point = F.struct("latitude", "longitude", F.col("altitude"), F.lit("AGL").alias("altitudeType"))
    parameters = F.struct("speed", F.lit("AGL").alias("altitudeType"))
    return points.select("object_id", F.to_json(F.struct(F.lit("Waypoint").alias("type"), point.alias("point"), parameters.alias("parameters"))).alias("segment"))


def json_route(points: DataFrame, name: str = "Interest Points") -> DataFrame:
    """One row: the whole route as one JSON text (a route is one flight's waypoints)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("object_id", "segment"))), lambda s: s["segment"])
    return json_segments(points).agg(F.concat(F.lit(f'{{"route":{{"name":"{name}","segments":['), F.array_join(parts, ","), F.lit("]}}")).alias("json"))


def kml_placemarks(points: DataFrame) -> DataFrame:
    mark = F.concat(F.lit("    <Placemark>\n      <name>WP Point</name>\n      <styleUrl>#defaultStyle</styleUrl>\n      <Point>\n        <coordinates>"), F.concat_ws(",", F.col("longitude").cast("string"), F.col("latitude").cast("string"), F.lit("0")), F.lit("</coordinates>\n      </Point>\n    </Placemark>\n"))
    return points.select("object_id", mark.alias("placemark"))


def kml(points: DataFrame, name: str = "Waypoints") -> DataFrame:
    """One row: a KML document. A single waypoint is written twice, for importers that want two."""
    marks = F.transform(F.array_sort(F.collect_list(F.struct("object_id", "placemark"))), lambda s: s["placemark"])
    twice = F.when(F.size(marks) == 1, F.array_repeat(F.array_join(marks, ""), 2)).otherwise(marks)
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n  <Document>\n    <name>{name}</name>\n    <Style id="defaultStyle"><IconStyle><scale>1.1</scale></IconStyle></Style>\n'
    return kml_placemarks(points).agg(F.concat(F.lit(head), F.array_join(twice, ""), F.lit("  </Document>\n</kml>\n")).alias("kml"))


def csv_text(points: DataFrame) -> DataFrame:
    """The lines of a CSV file in order, its header first."""
    head = points.sparkSession.createDataFrame([(None, ",".join(HEADER))], "object_id long, line string")
    return head.unionByName(csv_lines(points)).orderBy(F.col("object_id").asc_nulls_first()).select("line")


def export_all(animals_: DataFrame, folder: str) -> list[str]:
    """Writes all waypoints and the selected ones, each as CSV, JSON and KML text, to folders of their own; returns these."""
    out = []
    for what, selected in (("all", False), ("selected", True)):
        points = waypoints(animals_, selected)
        for kind, text in (("csv", csv_text(points).coalesce(1)), ("json", json_route(points)), ("kml", kml(points))):
            out.append(f"{folder.rstrip('/')}/{what}-{kind}")
            text.write.mode("overwrite").text(out[-1])
    return out
