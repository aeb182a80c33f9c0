"""Features to objects: aggregates over an object's features, scores and classes.

Grouping is by object with partial aggregation. The location error needs the centroid first: the centroids (one row an object) are joined
back to the features, so no object's features are gathered in one row or window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrail.config import Config
from embertrail.functions import classes, score


def is_real() -> Column:
    return F.col("type") == "Real"


def size_cm2(area_m2: Column, hot: Column, cfg: Config) -> Column:
    """Ground area of the hot pixels in whole cm2."""
    return (area_m2 * hot * F.lit(1e4) / F.lit(float(cfg.image_width * cfg.image_height))).cast("long")


def length_cm(pixels: Column, area_m2: Column, cfg: Config) -> Column:
    """A length in pixels as cm on the ground, 1 at least."""
    return F.greatest(pixels * F.sqrt(area_m2 * F.lit(1e4) / F.lit(float(cfg.image_width * cfg.image_height))), F.lit(1.0))


def steady_mean(x: Column) -> Column:
    """Mean that no order of rows changes: decimals of 12 places add exactly, so a mean on a cell's edge stays in its cell. Plain where a value
    is not finite or beyond 1e12."""
    far, held = F.count_if(~(F.abs(x) < 1e12)), F.when(F.abs(x) < 1e12, x).cast("decimal(25,12)")
    return F.when(far == 0, F.try_divide(F.sum(held).cast("double"), F.count(x))).otherwise(F.avg(x))


def locations(features: DataFrame) -> DataFrame:
    """object_id, loc_n, loc_e, loc_err: centroid and mean distance to it.

    The centroid leaves out features of height 0, the distance sum does not, and both are divided by the centroid's count. One feature
    alone is its own location, real or not."""
    counted = is_real() & F.col("northing_m").isNotNull() & (F.col("height_m").isNull() | (F.col("height_m") != 0))
    centres = features.groupBy("object_id").agg(
        F.count("*").alias("n_features"), F.count_if(counted).alias("n_loc"),
        steady_mean(F.when(counted, F.col("northing_m"))).alias("c_n"), steady_mean(F.when(counted, F.col("easting_m"))).alias("c_e"),
        F.max("northing_m").alias("only_n"), F.max("easting_m").alias("only_e"))
    near = features.where(is_real() & F.col("northing_m").isNotNull()).select("object_id", "northing_m", "easting_m").join(centres.select("object_id", "c_n", "c_e"), "object_id")
    d_n, d_e = F.col("northing_m") - F.col("c_n"), F.col("easting_m") - F.col("c_e")
    spread = near.groupBy("object_id").agg(F.sum(F.sqrt(d_n * d_n + d_e * d_e)).alias("sum_d"))
    alone = F.col("n_features") == 1
    out = centres.join(spread, "object_id", "left")
    return out.select(
        "object_id", F.when(alone, F.col("only_n")).otherwise(F.col("c_n")).alias("loc_n"), F.when(alone, F.col("only_e")).otherwise(F.col("c_e")).alias("loc_e"),
        F.when(alone, F.when(F.col("only_n").isNotNull(), 0.0)).otherwise(F.try_divide("sum_d", "n_loc")).alias("loc_err"))


def summarise(features: DataFrame, cfg: Config | None = None, with_location: bool = True) -> DataFrame:
    """One row per object: counts, maxima, height, heat, size, score, classes, and location. Where features tell how their height was found
    (height_algorithm), the mean height is that of heights along the line of sight."""
    cfg = cfg or Config()
    real = lambda c: F.when(is_real(), F.col(c))
    sighted = F.col("height_algorithm").startswith("LOS") if "height_algorithm" in features.columns else F.lit(True)
    spare = F.lit(0) if "num_max_heat" not in features.columns else real("num_max_heat")
    out = features.groupBy("object_id").agg(
        F.max("leg_id").alias("leg_id"), F.count("*").alias("n_features"), F.count_if(is_real()).alias("n_real"),
        F.min("block_id").alias("first_block"), F.max(real("block_id")).alias("last_real_block"), F.max("block_id").alias("last_block"),
        F.max(real("num_hot")).alias("max_hot"), F.max(real("sum_hot")).alias("max_sum_hot"), F.coalesce(F.max(spare), F.lit(0)).alias("max_heat_px"),
        F.max(real("box_w")).alias("max_w"), F.max(real("box_h")).alias("max_h"),
        F.avg(F.when(is_real() & sighted, F.col("height_m"))).alias("height"), F.min(real("height_m")).alias("min_height"), F.max(real("height_m")).alias("max_height"),
        F.min(real("max_heat")).alias("min_heat"), F.max(real("max_heat")).alias("max_heat"),
        F.avg(F.when(is_real() & (F.col("num_hot") > 0), F.col("sum_hot") / F.col("num_hot"))).cast("int").alias("avg_heat"),
        F.max(F.when(is_real(), size_cm2(F.col("image_area_m2"), F.col("num_hot"), cfg))).alias("size_cm2"))
    out = out.withColumn("height_err", F.greatest(F.abs(F.col("max_height") - F.col("height")), F.abs(F.col("min_height") - F.col("height"))))
    out = out.withColumn("density", score.density(F.col("max_hot"), F.col("max_w"), F.col("max_h"))).withColumn("units", score.duration_units(F.col("n_real"), cfg))
    out = out.withColumn("significant", score.significant(F.col("max_hot"), F.col("max_heat_px"), F.col("density"), F.col("units"), F.col("height"), cfg))
    out = out.withColumn("attributes", score.attributes(F.col("significant"), F.col("max_hot"), F.col("max_heat_px"), F.col("units"), F.col("height"), cfg))
    out = out.withColumn("size_class", classes.size_class(F.col("size_cm2"))).withColumn("height_class", classes.height_class(F.col("height"), F.col("height_err"), cfg.abandon_height_err_m))
    return out.join(locations(features), "object_id") if with_location else out


def significant_blocks(features: DataFrame, cfg: Config | None = None) -> DataFrame:
    """object_id, num_significant_blocks: at how many of its real features an object, as it was known by then, was significant. An object may
    cease to be: its box grows and its density falls. Running values need an object's features in order; objects without any count 0."""
    from pyspark.sql import Window

    cfg = cfg or Config()
    so_far = Window.partitionBy("object_id").orderBy("feature_id").rowsBetween(Window.unboundedPreceding, 0)
    real = lambda c: F.when(is_real(), F.col(c))
    spare = F.lit(0) if "num_max_heat" not in features.columns else F.coalesce(F.max(real("num_max_heat")).over(so_far), F.lit(0))
    hot, w, h = (F.max(real(c)).over(so_far) for c in ("num_hot", "box_w", "box_h"))
    units = score.duration_units(F.count(real("feature_id")).over(so_far), cfg)
    at = features.select("object_id", (is_real() & score.significant(hot, spare, score.density(hot, w, h), units, F.avg(real("height_m")).over(so_far), cfg)).alias("_sig"))
    return at.groupBy("object_id").agg(F.count_if("_sig").alias("num_significant_blocks"))


def ever_significant() -> Column:
    """Whether an object with its num_significant_blocks and units was significant at any block and seen for the least duration."""
    return F.coalesce((F.col("num_significant_blocks") > 0) & (F.col("units") >= 1), F.lit(False))


def derived(objects: DataFrame) -> DataFrame:
    """Centre block: halfway between the first and the last real one, rounded up."""
    return objects.withColumn("centre_block", F.expr("(first_block + last_real_block + 1) div 2"))


def list_summary(objects: DataFrame) -> DataFrame:
    """One row over all objects; nulls do not count."""
    cols = {"loc_err": "loc_err", "height": "height", "height_err": "height_err", "size_cm2": "size", "avg_heat": "heat"}
    aggs = [F.count("*").alias("n_objects")]
    for c, name in cols.items():
        aggs += [F.round(f(c).cast("double"), 4).alias(f"{k}_{name}") for k, f in (("min", F.min), ("max", F.max), ("sum", F.sum))]
    return objects.agg(*aggs, F.round(F.avg("height"), 4).alias("avg_height"))


def histogram(objects: DataFrame, bin_: Column, dense: bool = True, lowest: int | None = 0) -> DataFrame:
    """bin, n; dense from the lowest bin (or the least that occurs, if None) to the highest. Bins below are dropped."""
    counts = objects.select(bin_.cast("long").alias("bin")).where(F.col("bin").isNotNull()).where(F.lit(True) if lowest is None else F.col("bin") >= lowest).groupBy("bin").agg(F.count("*").alias("n"))
    if not dense:
        return counts
    ends = counts.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).where("b is not null")
    low = F.col("a") if lowest is None else F.lit(lowest).cast("long")
    return ends.select(F.explode(F.sequence(low, F.col("b"))).alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_counts(spark, objects: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Significant objects in each class; classes without any count 0."""
    dim = spark.createDataFrame(list(enumerate(names)), "idx int, name string")
    counts = objects.where("significant").groupBy(column).agg(F.count("*").alias("n"))
    return dim.join(counts, dim["name"] == counts[column], "left").select("idx", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def matrix(objects: DataFrame) -> DataFrame:
    """Significant objects by height class and size class with all totals; null is the total."""
    return objects.where("significant").cube("height_class", "size_class").agg(F.count("*").alias("n"))


def by_leg(objects: DataFrame, column: str) -> DataFrame:
    """Count, mean and maximum of a column over significant objects by leg, and over all (null)."""
    return objects.where(F.col("significant")).rollup("leg_id").agg(F.count("*").alias("n"), F.round(F.avg(column), 6).alias("mean"), F.round(F.max(column), 6).alias("most"))


#: Ids in a bucket of the count of unnamed objects.
NAME_BUCKET = 4096


def names(objects: DataFrame) -> DataFrame:
    """Significant objects in a leg are named by leg and turn, such as C5; all others #n, in order of id.

    Turns are row numbers in each leg. The others have no group, so they are counted in two levels: by bucket of ids, and within a bucket;
    only the buckets' counts meet in one task."""
    from pyspark.sql import Window

    from embertrail.functions.text import id_letters

    named = F.coalesce(F.col("significant") & (F.col("leg_id") > 0), F.lit(False))
    marked = objects.withColumn("_named", named).withColumn("_bucket", F.when(named, F.col("leg_id")).otherwise(F.floor(F.col("object_id") / NAME_BUCKET)).cast("long"))
    turn = F.row_number().over(Window.partitionBy("_named", "_bucket").orderBy("object_id"))
    counts = marked.where(~F.col("_named")).groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.lit(False).alias("_named"), "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = marked.withColumn("_turn", turn).join(starts, ["_named", "_bucket"], "left")
    name = F.when(F.col("_named"), F.concat(id_letters(F.col("leg_id")), F.col("_turn").cast("string"))).otherwise(F.concat(F.lit("#"), (F.col("_start") + F.col("_turn")).cast("string")))
    return out.withColumn("name", name).select(*objects.columns, "name")


def in_run_scope(from_ms: Column, to_ms: Column, first_ms: Column, last_ms: Column, images: bool = False) -> Column:
    """At least half of the object's time lies in the run's range; for images, touching it is enough."""
    both = F.least(to_ms, last_ms) - F.greatest(from_ms, first_ms)
    part = (both > 0) & (F.try_divide(both.cast("double"), to_ms - from_ms) >= 0.5)
    return F.coalesce((both == 0) | part if images else part, F.lit(False))


def first_last(features: DataFrame) -> DataFrame:
    """First, last and last real feature of each object, by feature id."""
    return features.groupBy("object_id").agg(F.min("feature_id").alias("first_feature"), F.max("feature_id").alias("last_feature"), F.max(F.when(is_real(), F.col("feature_id"))).alias("last_real_feature"),
                                             F.max_by("block_id", "feature_id").alias("last_block"), F.min_by("block_id", "feature_id").alias("first_block"))


def fill_forward(features: DataFrame) -> DataFrame:
    """Real features with a missing height take the last known one of their object."""
    from pyspark.sql import Window

    w = Window.partitionBy("object_id").orderBy("feature_id").rowsBetween(Window.unboundedPreceding, 0)
    return features.where(is_real()).withColumn("height_filled", F.last("height_m", ignorenulls=True).over(w))


def expected_box(features: DataFrame) -> DataFrame:
    """Where each object is expected in the block after its last feature."""
    f = features.groupBy("object_id").agg(
        *[F.min_by(f"box_{c}", "feature_id").alias(f"first_{c}") for c in "xy"], *[F.max_by(f"box_{c}", "feature_id").alias(f"last_{c}") for c in "xywh"],
        F.max_by("type", "feature_id").alias("last_type"), F.min_by("block_id", "feature_id").alias("b0"), F.max_by("block_id", "feature_id").alias("b1"),
        F.max(F.when(is_real(), F.col("box_w"))).alias("max_w"), F.max(F.when(is_real(), F.col("box_h"))).alias("max_h"))
    moves = F.col("b1") - F.col("b0")
    many = moves >= 1
    step = lambda c, size, most: (F.col(f"last_{c}") + (F.col(f"last_{c}") - F.col(f"first_{c}")).cast("double") / moves - (F.coalesce(F.col(most), F.lit(0)) - F.col(size)) / F.lit(2.0)).cast("int")
    x = F.when(many, step("x", "last_w", "max_w")).otherwise(F.col("last_x"))
    y = F.when(many, step("y", "last_h", "max_h")).otherwise(F.col("last_y"))
    w = F.when(many, F.coalesce("max_w", F.lit(0))).otherwise(F.col("last_w"))
    h = F.when(many, F.coalesce("max_h", F.lit(0)) * 2).otherwise(F.col("last_h"))
    grow = F.when(F.col("last_type") == "Real", 5).otherwise(0)
    return f.select("object_id", (x - grow).cast("long").alias("exp_x"), (y - grow).cast("long").alias("exp_y"), (w + 2 * grow).cast("long").alias("exp_w"), (h + 2 * grow).cast("long").alias("exp_h"))
