"""Queries over the drone's way, ranges and the end of legs, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from embertrail.functions import classes
from embertrail.functions.text import describe_objects
from embertrail.operators import annotations, legs, objects as ob
from embertrail.plans.q_objects import CAT, CFG, HISTORY, NAMED, _hist_sql, features, objs, sql
from embertrail.sources.fixtures import ctes, table, view

NEAR = replace(CFG, object_max_range_m=60.0)
RANGES = """placed as materialized (select f.*, drone_n, drone_e, lineal_m, step_id from v_feature f left join v_drone d on d.leg_id = f.leg_id and d.block_id = f.block_id),
ends as (select object_id, arg_min(drone_n, feature_id) as an, arg_min(drone_e, feature_id) as ae, arg_min(lineal_m, feature_id) as al, arg_max(drone_n, feature_id) filter (type = 'Real') as bn, arg_max(drone_e, feature_id) filter (type = 'Real') as be, arg_max(lineal_m, feature_id) filter (type = 'Real') as bl from placed group by object_id),
far as (select object_id, loc_n, loc_e, al, bl, sqrt((loc_n - an) * (loc_n - an) + (loc_e - ae) * (loc_e - ae)) as ra, sqrt((loc_n - bn) * (loc_n - bn) + (loc_e - be) * (loc_e - be)) as rb from ends join loc using (object_id)),
rng as (select object_id, cast(trunc(coalesce((ra + rb) / 2, ra, rb)) as int) as avg_range_m, coalesce((al + bl) / 2, al, bl) as avg_lineal_m from far)"""
HEIGHTS = [h for h in classes.HEIGHT_NAMES if h != "?"]


def _drone(s, d):
    return view(s, d, "v_drone")


def _ranges(s, d):
    return legs.object_ranges(features(s, d), ob.locations(features(s, d)), _drone(s, d))


def _ranged(s, d):
    return objs(s, d).join(_ranges(s, d), "object_id")


def _cut(s, d):
    o = _ranged(s, d)
    return legs.cut_by_range(o, NEAR).groupBy("leg_id").agg(F.count_if("significant").alias("left"), F.count_if(F.col("avg_range_m") > 60).alias("far"))


def _histogram(s, d):
    return ob.histogram(_ranged(s, d).where("significant"), F.col("avg_range_m"))


def _pivot(s, d):
    o = annotations.annotate(objs(s, d, False).withColumn("name", F.concat(F.lit("P"), F.col("object_id").cast("string"))), view(s, d, "v_category"))
    return legs.pivoted_matrix(o.withColumn("category", F.coalesce("category", F.lit(""))), classes.SIZE_NAMES, HEIGHTS)


def _los(s, d):
    f = features(s, d).withColumn("height_algorithm", F.when(F.col("block_id") % 3 == 0, "LOS 0.5").when(F.col("block_id") % 3 == 1, "NoResult"))
    counts = f.where(ob.is_real() & legs.by_line_of_sight(F.col("height_algorithm"))).groupBy("object_id").agg(F.count("height_m").alias("n"))
    return ob.summarise(f, CFG, False).select("object_id", F.round("height", 6).alias("height")).join(counts, "object_id")


def _video(s, d):
    p = table(s, d, "part")
    return p.groupBy(legs.saves_video(F.col("p_partkey") % 2 == 0, (F.col("p_size") - 3) / 10.0, F.col("p_size") % 7, F.col("p_size") % 5).alias("saves")).agg(F.count("*").alias("n"))


def _times(s, d):
    o = table(s, d, "orders")
    t = legs.taken_at(F.to_timestamp(F.lit("2024-01-01 00:00:00")), F.col("o_orderkey") % 100000)
    return o.groupBy(F.date_format(t, "HH:mm").alias("minute")).agg(F.count("*").alias("n"))


def _scope(s, d):
    f = features(s, d)
    return f.groupBy("leg_id").agg(*[F.count_if(legs.in_draw_scope(F.lit(3), F.lit(20), F.lit(12), mode)).alias(f"n_{mode.lower()}") for mode in ("Significant", "All")])


def _named(s, d):
    return legs.id_by_name(ob.names(objs(s, d, False)), "#7")


def _ever(s, d):
    return objs(s, d, False).join(ob.significant_blocks(features(s, d), CFG), "object_id").withColumn("ever", ob.ever_significant())


def _described(s, d):
    return _ever(s, d).groupBy("leg_id").agg(F.count_if("ever").alias("n")).select("leg_id", describe_objects(F.col("n")).alias("objects"))


def _details(s, d):
    drone = _drone(s, d)
    sections = drone.where("step_id % 3 <> 0").select("step_id", F.concat(F.lit("IMG_"), F.col("step_id").cast("string"), F.lit(".JPG")).alias("image_file_name"))
    return legs.object_details(ob.names(objs(s, d)).withColumn("max_heat_px", F.col("max_hot") % 7), drone, sections, CFG)


def _residual(s, d):
    rays = view(s, d, "v_ray")
    points = rays.groupBy("object_id").agg((F.max("tx") + 1).alias("east"), F.max("ty").alias("north"), F.max("tz").alias("up"))
    return legs.triangulation_residual(rays, points).select("object_id", F.round("residual", 4).alias("residual"))


def _bars(s, d):
    bars = legs.elevation_bars(objs(s, d), _ranges(s, d), view(s, d, "v_dem"))
    return bars.select("object_id", *[F.round(c, 4).alias(c) for c in bars.columns[1:]])


def _key_results(s, d):
    got = legs.key_results(objs(s, d, False), legs.swathe(_drone(s, d), 5))
    return got.select("leg_id", "animals", F.round("swathe_km2", 6).alias("swathe_km2"), F.round("density", 4).alias("density"))


PIVOT = ", ".join(f"count(case when size_class = '{x}' then 1 end) as n_{x.lower()}" for x in classes.SIZE_NAMES)

QUERIES = {
    "object_ranges": (_ranges, sql("select * from rng", "v_feature", "v_drone", more=RANGES)),
    "feature_drone_range": (lambda s, d: legs.ranges(features(s, d), _drone(s, d)).select("feature_id", F.round("range_m", 6).alias("range_m")), sql("select feature_id, round(sqrt((northing_m - drone_n) * (northing_m - drone_n) + (easting_m - drone_e) * (easting_m - drone_e)), 6) as range_m from placed", "v_feature", "v_drone", more=RANGES)),
    "range_cut": (_cut, sql("select leg_id, count(case when significant and not coalesce(avg_range_m > 60, false) then 1 end) as left, count(case when avg_range_m > 60 then 1 end) as far from obj join rng using (object_id) group by leg_id", "v_feature", "v_drone", more=RANGES).replace("as left,", 'as "left",')),
    "histogram_range": (_histogram, _hist_sql("avg_range_m", views=("v_feature", "v_drone"), more=RANGES + ",\n", rows="obj join rng using (object_id)")),
    "first_step": (lambda s, d: legs.first_step(features(s, d), _drone(s, d)), sql("select min(step_id) as first_step_id from (select object_id, arg_min(step_id, feature_id) as step_id from placed group by object_id)", "v_feature", "v_drone", more=RANGES)),
    "block_features": (lambda s, d: legs.block_features(features(s, d)), sql("select leg_id, block_id, min(feature_id) as min_feature_id, max(feature_id) as max_feature_id, count(*) as n_features from v_feature group by 1, 2", "v_feature", obj=False)),
    "central_features": (lambda s, d: legs.central_feature(features(s, d)), sql("select object_id, feature_id as central_feature_id from (select object_id, feature_id, row_number() over (partition by object_id order by feature_id) - 1 as i, count(*) over (partition by object_id) as n from v_feature) where i = n // 2", "v_feature", obj=False)),
    "size_height_buckets": (lambda s, d: legs.buckets(objs(s, d, False)).groupBy("height_bucket", "size_bucket").agg(F.count("*").alias("n")), sql("select cast(trunc(height * 2) as int) / 2 as height_bucket, cast(trunc(size_cm2 / 100) as int) * 100 as size_bucket, count(*) as n from obj group by 1, 2", "v_feature")),
    "object_by_name": (_named, "select * from (" + sql("select min(object_id) as object_id from obj where (select count(*) from obj o where not coalesce(o.significant and o.leg_id > 0, false) and o.object_id <= obj.object_id) = 7 and not coalesce(significant and leg_id > 0, false)", "v_feature") + ")"),
    "pivoted_matrix": (_pivot, sql(f"select height_class, {PIVOT}, count(*) as n_all, count(case when coalesce(category, '') <> '' then 1 end) as n_categorised from obj left join cat on cat.key = 'P' || cast(object_id as varchar) where significant and height_class <> '?' group by rollup(height_class)", "v_feature", "v_category", more=CAT)),
    "los_heights": (_los, sql("select object_id, round(avg(height_m), 6) as height, count(height_m) as n from v_feature where type = 'Real' and block_id % 3 = 0 group by object_id", "v_feature", obj=False)),
    "video_gate": (_video, "select p_partkey % 2 = 0 and (p_size - 3) / 1e1 > 0.1e0 and p_size % 7 > 0 and p_size % 5 > 0 as saves, count(*) as n from part group by 1"),
    "frame_times": (_times, "select strftime(timestamp '2024-01-01' + to_milliseconds(o_orderkey % 100000), '%H:%M') as minute, count(*) as n from orders group by 1"),
    "significant_blocks": (lambda s, d: ob.significant_blocks(features(s, d), CFG), sql("select object_id, num_significant_blocks from hist", "v_feature", more=HISTORY)),
    "described_objects": (_described, sql("select leg_id, case when count(case when ever then 1 end) > 0 then count(case when ever then 1 end) || ' Objects' else '' end as objects from (select leg_id, num_significant_blocks > 0 and units >= 1 as ever from obj join hist using (object_id)) group by leg_id", "v_feature", more=HISTORY)),
    "object_details": (_details, sql("select object_id, name, round(first_block / 30e0, 3) as seen_s, size_cm2, max_hot, avg_heat, max_heat, nullif(max_hot % 7, 0) as num_max_heat, cast(cast(round(round(loc_n, 6)) as bigint) as varchar) || ',' || cast(cast(round(round(loc_e, 6)) as bigint) as varchar) as location, case when step_id % 3 <> 0 then 'IMG_' || step_id || '.JPG' else '' end as image_file_name from named left join v_drone d on d.leg_id = named.leg_id and d.block_id = named.first_block where significant", "v_feature", "v_drone", more=NAMED)),
    "triangulation_residual": (_residual, f"""with {ctes('v_ray')}, pts as (select object_id as o, max(tx) + 1 as e, max(ty) as n, max(tz) as u from v_ray group by object_id),
dist as (select object_id, (e - c_e) * (e - c_e) + (n - c_n) * (n - c_n) + (u - c_a) * (u - c_a) - power((e - c_e) * d_e + (n - c_n) * d_n + (u - c_a) * d_a, 2) / nullif(d_e * d_e + d_n * d_n + d_a * d_a, 0) as away from v_ray join pts on o = object_id)
select object_id, round(sqrt(sum(away * away)), 4) as residual from dist group by object_id"""),
    "elevation_bars": (_bars, sql("select object_id, round(elev_m + min_height, 4) as bottom, round(elev_m + height, 4) as middle, round(elev_m + max_height, 4) as top, round(avg_lineal_m - loc_err, 4) as from_m, round(avg_lineal_m + loc_err, 4) as to_m from obj left join rng using (object_id) left join v_dem on n_cell = floor(obj.loc_n) and e_cell = floor(obj.loc_e) where significant", "v_feature", "v_drone", "v_dem", more=RANGES)),
    "key_results_density": (_key_results, sql("select leg_id, animals, round(m2 / 1e6, 6) as swathe_km2, round(animals / (m2 / 1e6), 4) as density from (select leg_id, count(case when significant then 1 end) as animals from obj group by leg_id) join (select leg_id, count(*) as m2 from seen group by leg_id) using (leg_id)", "v_feature", "v_drone", more="seen as (select distinct leg_id, floor(drone_n) + a as n, floor(drone_e) + b as e from v_drone, (select unnest(generate_series(-5, 5)) as a), (select unnest(generate_series(-5, 5)) as b))")),
    "draw_scope": (_scope, sql("select leg_id, count(case when block_id between 3 and 12 and type = 'Real' then 1 end) as n_significant, count(case when block_id between 3 and 12 then 1 end) as n_all from v_feature group by leg_id", "v_feature", obj=False)),
}
