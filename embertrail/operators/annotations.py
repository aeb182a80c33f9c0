"""User annotations on object names: lookup, summary, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embertrail.functions.text import name_key


def lookup(categories: DataFrame) -> DataFrame:
    """key, category, include, notes: one annotation for each name without regard to case and outer blanks; the least spelling wins."""
    w = Window.partitionBy(name_key(F.col("object_name"))).orderBy("object_name")
    return categories.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(name_key(F.col("object_name")).alias("key"), "category", "include", "notes")


def annotate(objects: DataFrame, categories: DataFrame, name: str = "name") -> DataFrame:
    found = lookup(categories)
    return objects.join(found, name_key(F.col(name)) == found["key"], "left").drop("key")


def summary(categories: DataFrame) -> DataFrame:
    """category, n: annotations that are included, by category; null for those left out. Blank categories are no annotations."""
    return categories.where(F.trim("category") != "").groupBy(F.when(F.col("include"), F.col("category")).alias("category")).agg(F.count("*").alias("n"))


def summary_text(categories: DataFrame) -> DataFrame:
    """One row: total, excluded, and `category n, ...` in order of category."""
    by = summary(categories)
    parts = F.array_sort(F.collect_list(F.when(F.col("category").isNotNull(), F.concat_ws(" ", "category", F.col("n").cast("string")))))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("category").isNull(), F.col("n"))), F.lit(0)).alias("excluded"), F.array_join(parts, ", ").alias("text"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Annotations after a change: new ones win, a blank category deletes, names match without regard to case and outer blanks."""
    a, b = lookup(old).alias("a"), lookup(new).alias("b")
    both = a.join(b, F.col("a.key") == F.col("b.key"), "full_outer")
    pick = lambda c: F.when(F.col("b.key").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return both.select(F.coalesce("a.key", "b.key").alias("key"), pick("category"), pick("include"), pick("notes")).where(F.trim("category") != "")
