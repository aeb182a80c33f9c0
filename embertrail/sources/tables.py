"""Readers and writers of the engine's tables. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embertrail import schema
from embertrail.config import Config

SCHEMAS = {"frame": schema.FRAME, "pixel": schema.PIXEL, "flight_step": schema.STEP, "block": schema.BLOCK, "feature": schema.FEATURE, "object": schema.OBJECT, "span": schema.SPAN, "object_category": schema.CATEGORY, "dem": schema.DEM, "detection": schema.DETECTION}


def read(spark: SparkSession, path: str, name: str, kind: str = "parquet") -> DataFrame:
    """A stored table; trailing columns that older files lack are null."""
    reader = spark.read.schema(SCHEMAS[name])
    return reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)


def read_settings_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A spreadsheet export with one row per item: text cells, blank for missing. Rows with a blank first cell are not items."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in SCHEMAS[name].fields])
    rows = spark.read.schema(text).option("header", True).csv(path)
    first = SCHEMAS[name].fields[0].name
    return schema.parse_settings(rows.where(F.trim(F.coalesce(F.col(first), F.lit(""))) != ""), SCHEMAS[name])


def read_frames(spark: SparkSession, path: str, steps: DataFrame | None = None) -> DataFrame:
    """Image files as rows (path, modificationTime, length, content); with steps, joined to the step whose file_name they have."""
    files = spark.read.format("binaryFile").load(path).withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    return files if steps is None else files.join(steps, "file_name")


def with_optical(frames: DataFrame, optical: DataFrame) -> DataFrame:
    """Frames with their optical companion, null where there is none."""
    return frames.join(optical.select("flight_id", "frame_id", F.col("data").alias("optical")), ["flight_id", "frame_id"], "left")


def read_config(spark: SparkSession, path: str) -> Config:
    """Stored settings over the defaults."""
    rows = spark.read.schema("name string, value string").option("header", True).csv(path)
    return Config.from_rows([(r["name"], r["value"]) for r in rows.collect()]).clamped()  # one row per parameter


def read_settings(spark: SparkSession, path: str) -> Config:
    """Settings from a JSON object of parameter names and values; names that are no parameters are left out."""
    row = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path).first()  # one object
    return Config.from_rows([(k, v) for k, v in (row.asDict() if row else {}).items() if v is not None]).clamped()


def write_config(spark: SparkSession, cfg: Config, path: str) -> None:
    spark.createDataFrame(cfg.rows(), "name string, value string").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def relink(features: DataFrame, objects: DataFrame) -> DataFrame:
    """Stored features to stored objects after loading: features of objects that were not stored are left out; last real feature set."""
    kept = features.join(objects.select("object_id"), "object_id")
    last = kept.groupBy("object_id").agg(F.max(F.when(F.col("type") == "Real", F.col("feature_id"))).alias("last_real_feature_id"))
    return kept.join(last, "object_id")


def savable(df: DataFrame, mode: str, flag: str = "significant") -> DataFrame:
    """What a save mode keeps: None, Significant or All."""
    if mode not in ("None", "Significant", "All"):
        raise ValueError(f"unknown save mode {mode}")
    return df.where(F.lit(mode == "All") if mode != "Significant" else F.col(flag))


def write(df: DataFrame, path: str, kind: str = "parquet", partition: str | None = None) -> None:
    out = df.write.mode("overwrite")
    (out.partitionBy(partition) if partition else out).format(kind).save(path)
