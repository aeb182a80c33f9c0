"""Queries over frames, ranges, spans and detections, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from embertrail.functions.rect import Rect
from embertrail.operators import frames as fr
from embertrail.plans.q_objects import features, objs, sql
from embertrail.sources.fixtures import ctes, table, view

T = math.tan(math.radians(22.5))


def _ranges(s, d):
    return fr.in_ranges(view(s, d, "v_block"), [(0, 500_000_000), (1_000_000_000, 1_500_000_000)]).groupBy("flight_id").agg(F.count("*").alias("n"), F.min("ms").alias("first"), F.max("ms").alias("last"))


def _progress(s, d):
    o = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000).alias("c"))
    percent, left = fr.progress(F.col("c"), F.lit(900), F.col("c") / 10.0)
    return o.groupBy(percent.alias("percent")).agg(F.count("*").alias("n"), F.round(F.sum(left), 3).alias("seconds_left"))


def _guard(s, d):
    b = table(s, d, "orders").select(F.col("o_orderkey").alias("block_id"), (F.col("o_orderkey") % 90).alias("down"), (F.col("o_orderkey") % 40).alias("high"))
    f = table(s, d, "lineitem").select(F.col("l_orderkey").alias("f_block_id"), F.col("l_quantity").alias("q"))
    return fr.guarded(b, f, fr.can_locate(b["down"].cast("double"), b["high"].cast("double"))).agg(F.countDistinct("block_id").alias("blocks"), F.count("f_block_id").alias("features"))


def _excluded(s, d):
    return features(s, d).groupBy(fr.excluded_detection(Rect.of(), 480, 400, 640, 512).alias("excluded")).agg(F.count("*").alias("n"))


def _shades(s, d):
    return table(s, d, "part").groupBy(fr.shade((F.col("p_size") - 2).cast("double")).alias("shade")).agg(F.count("*").alias("n"))


def _crop(s, d):
    p = table(s, d, "part").select("p_partkey", (F.lit(600) + F.col("p_partkey") % 1400).cast("int").alias("w"), (F.lit(400) + F.col("p_partkey") % 900).cast("int").alias("h"), (F.lit(40) + F.col("p_size")).cast("double").alias("fov"))
    c = fr.optical_crop(F.col("w"), F.col("h"), F.col("fov"))
    return p.select("p_partkey", c.x.alias("x"), c.y.alias("y"), c.w.alias("crop_w"), c.h.alias("crop_h"))


CROP = f"""select p_partkey, cast(trunc((w - cw) / 2e0) as int) as x, cast(trunc((h - ch) / 2e0) as int) as y, cw as crop_w, ch as crop_h from (select *, cast(case when s >= 1 then w else greatest(round_even(case when bh then h * s * 1.25e0 else w * s end, 0), 1) end as int) as cw,
  cast(case when s >= 1 then h else greatest(round_even(case when bh then h * s else w * s / 1.25e0 end, 0), 1) end as int) as ch from (select *, h * s * 1.25e0 <= w * s as bh from (select p_partkey, 600 + p_partkey % 1400 as w, 400 + p_partkey % 900 as h, {T!r} / tan(radians((40 + p_size) / 2e0)) as s from part)))"""


def _body(s, d):
    f = features(s, d)
    x, y, z = fr.body_ray(F.col("box_x") + 0.0, F.col("box_y") + 0.0, (F.col("object_id") % 7).cast("double"), (-(F.col("object_id") % 50)).cast("double"), (F.col("object_id") % 360).cast("double"))
    return f.select("feature_id", *[(F.round(c, 6) + 0.0).alias(n) for c, n in ((x, "d_x"), (y, "d_y"), (z, "d_z"))])


BODY = """m as (select feature_id, ((box_x + 640e0) / 2 - 640) / (-9.1e0 * 1280 / 7.68e0) as x, ((box_y + 512e0) / 2 - 512) / (9.1e0 * 1024 / 6.144e0) as y, 1e0 as z, radians(cast(object_id % 7 as double)) as r, radians(90e0 - object_id % 50) as p, radians(cast(object_id % 360 as double)) as w from v_feature),
k as (select *, cos(w) * cos(p) as a11, sin(w) * cos(p) as a21, -sin(p) as a31, cos(w) * sin(p) * sin(r) - sin(w) * cos(r) as a12, sin(w) * sin(p) * sin(r) + cos(w) * cos(r) as a22, cos(p) * sin(r) as a32,
  cos(w) * sin(p) * cos(r) + sin(w) * sin(r) as a13, sin(w) * sin(p) * cos(r) - cos(w) * sin(r) as a23, cos(p) * cos(r) as a33 from m)"""


def _confidence(s, d):
    f = features(s, d).where("num_hot >= 8").select("object_id", "feature_id", "box_x", "box_y")
    hits = f.select("feature_id", F.explode(F.array(*[F.struct(F.lit(k).alias("offset"), (F.col("box_x") * 1.5 + k).alias("hit_e"), (F.col("box_y") + k * F.col("box_x") / 10.0).alias("hit_n"), F.lit(5.0).alias("hit_up")) for k in range(3)])).alias("h")).select("feature_id", "h.*")
    return fr.los_confidence(hits, "feature_id").select("feature_id", F.round("confidence", 6).alias("confidence"))


def _fixes(s, d):
    o = objs(s, d).where("significant and leg_id > 0")
    trials = o.select(F.col("leg_id").alias("span"), "loc_err", F.explode(F.sequence(F.lit(-90), F.lit(90))).alias("fix_m"))
    err = trials.groupBy("span", "fix_m").agg(F.round(F.sum(F.abs(F.col("loc_err") + (F.col("fix_m") - F.col("span")) * 0.3)), 4).alias("sum_err"))
    return fr.altitude_fix(err).select("span", "fix_m", F.round("sum_err", 4).alias("sum_err"))


def _fixed(s, d):
    spans = s.range(0, 60).select(F.col("id").alias("flight_id"), F.lit(3).alias("min_step_id"), F.lit(9).alias("max_step_id"), (F.col("id") % 4).cast("double").alias("best_fix_alt_m"))
    return fr.fixed_steps(view(s, d, "v_step"), spans).select("flight_id", "step_id", (F.col("altitude_m") + F.coalesce("best_fix_alt_m", F.lit(0.0))).alias("altitude_m"))


def _run(s, d):
    return fr.first_run(view(s, d, "v_block"), "block_id", F.col("value") > 30)


def _ends(s, d):
    f = features(s, d)
    a = f.groupBy("object_id").agg(F.min_by("northing_m", "feature_id").alias("a"), F.max_by("height_m", "feature_id").alias("b"))
    return a.select("object_id", F.round(fr.mean_of_ends(F.col("a"), F.col("b")), 6).alias("mean"))


def _union(s, d):
    f = features(s, d)
    return fr.union_features(f.where("type = 'Real'"), f.where("type = 'Unreal'")).groupBy("type").agg(F.count("*").alias("n"))


FIXES = sql("select span, fix as fix_m, round(best, 4) as sum_err from r where k = -91", "v_feature", more="""e as materialized (select leg_id as span, k, round(sum(abs(loc_err + (k - leg_id) * 0.3e0)), 4) as s from (select leg_id, loc_err from obj where significant and leg_id > 0), (select unnest(generate_series(-90, 90)) as k) group by leg_id, k),
r as (select distinct span, cast(90 as bigint) as k, 0e0 as fix, cast('inf' as double) as best from e
  union all select r.span, r.k - 1, case when r.best - e.s >= 0.1e0 then cast(e.k as double) else r.fix end, case when r.best - e.s >= 0.1e0 then e.s else r.best end from r join e on e.span = r.span and e.k = r.k)""").replace("with ", "with recursive ", 1)

QUERIES = {
    "run_ranges": (_ranges, f"with {ctes('v_block')} select flight_id, count(*) as n, min(ms) as first, max(ms) as last from v_block where ms between 0 and 500000000 or ms between 1000000000 and 1500000000 group by flight_id"),
    "progress": (_progress, "select percent, count(*) as n, round(sum(case when sh > 0.01 then c / 10e0 / sh - c / 10e0 end), 3) as seconds_left from (select *, least(100, cast(trunc(sh * 100) as int)) as percent from (select o_orderkey % 1000 as c, (o_orderkey % 1000) / 900e0 as sh from orders)) group by percent"),
    "frame_guard": (_guard, "select count(distinct o_orderkey) as blocks, count(l_orderkey) as features from orders left join lineitem on l_orderkey = o_orderkey and o_orderkey % 90 >= 15 and o_orderkey % 40 >= 10"),
    "excluded_detections": (_excluded, sql("select box_x + box_w > 480 and box_y + box_h > 400 and box_x < 640 and box_y < 512 as excluded, count(*) as n from v_feature group by 1", "v_feature", obj=False)),
    "density_shades": (_shades, "select case when p >= 0 and p < 3 then 0 when p >= 3 and p < 6 then 1 when p >= 6 and p < 9 then 2 when p >= 9 and p < 12 then 3 when p >= 12 and p < 15 then 4 else 5 end as shade, count(*) as n from (select p_size - 2 as p from part) group by 1"),
    "optical_crops": (_crop, CROP),
    "body_rays": (_body, sql("select feature_id, round(a11 * x + a21 * y + a31 * z, 6) + 0e0 as d_x, round(a12 * x + a22 * y + a32 * z, 6) + 0e0 as d_y, round(a13 * x + a23 * y + a33 * z, 6) + 0e0 as d_z from k", "v_feature", obj=False, more=BODY)),
    "los_confidence": (_confidence, sql("select feature_id, round(1 / (1 + (sqrt(1 + box_x / 10e0 * box_x / 10e0) + sqrt(4 + box_x / 5e0 * box_x / 5e0)) / 2), 6) as confidence from v_feature where num_hot >= 8", "v_feature", obj=False)),
    "altitude_fixes": (_fixes, FIXES),
    "fixed_steps": (_fixed, f"with {ctes('v_step')} select flight_id, step_id, altitude_m + case when flight_id < 60 and step_id between 3 and 9 then flight_id % 4 else 0 end as altitude_m from v_step"),
    "first_matching_run": (_run, f"with {ctes('v_block')}, m as (select *, value > 30 as k from v_block), n as (select *, case when k and not coalesce(lag(k) over (partition by flight_id order by block_id), false) then 1 else 0 end as b from m), r as (select *, sum(b) over (partition by flight_id order by block_id) as run from n) select flight_id, min(block_id) as first, max(block_id) as last from r where k and run = 1 group by flight_id"),
    "mean_of_ends": (_ends, sql("select object_id, round(coalesce((a + b) / 2, a, b), 6) as mean from (select object_id, arg_min(northing_m, feature_id) as a, arg_max_null(height_m, feature_id) as b from v_feature group by object_id)", "v_feature", obj=False)),
    "feature_union": (_union, sql("select type, count(*) as n from v_feature group by type", "v_feature", obj=False)),
}
