"""Queries over features and objects, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from embertrail.config import Config
from embertrail.functions import classes, geo, rect, text
from embertrail.operators import annotations, exports, objects as ob, spatial
from embertrail.sources import tables
from embertrail.sources.fixtures import ctes, table, view

CFG = Config()
R = "case when type = 'Real' then {} end"


def _r(c: str) -> str:
    return R.format(c)


OBJ = f"""
base as (select object_id, max(leg_id) as leg_id, count(*) as n_features, count({_r('1')}) as n_real, min(block_id) as first_block, max({_r('block_id')}) as last_real_block, max(block_id) as last_block,
  max({_r('num_hot')}) as max_hot, max({_r('sum_hot')}) as max_sum_hot, max({_r('box_w')}) as max_w, max({_r('box_h')}) as max_h,
  avg({_r('height_m')}) as height, min({_r('height_m')}) as min_height, max({_r('height_m')}) as max_height, min({_r('max_heat')}) as min_heat, max({_r('max_heat')}) as max_heat,
  cast(trunc(avg(case when type = 'Real' and num_hot > 0 then sum_hot / cast(num_hot as double) end)) as int) as avg_heat,
  max({_r('cast(trunc(image_area_m2 * num_hot * 1e4 / 327680e0) as bigint)')}) as size_cm2 from v_feature group by object_id),
err as (select *, greatest(abs(max_height - height), abs(min_height - height)) as height_err, coalesce(max_hot / nullif(max_w * max_h * 0.785e0, 0), 0) as density, n_real * 1000e0 / 30e0 / 500e0 as units from base),
cen as (select object_id, count(*) as nf, count(case when type = 'Real' and (height_m is null or height_m <> 0) then 1 end) as n_loc, avg(case when type = 'Real' and (height_m is null or height_m <> 0) then northing_m end) as c_n,
  avg(case when type = 'Real' and (height_m is null or height_m <> 0) then easting_m end) as c_e, max(northing_m) as o_n, max(easting_m) as o_e from v_feature group by object_id),
dis as (select f.object_id, sum(sqrt((northing_m - c_n) * (northing_m - c_n) + (easting_m - c_e) * (easting_m - c_e))) as sd from v_feature f join cen on cen.object_id = f.object_id where type = 'Real' group by f.object_id),
loc as (select cen.object_id, case when nf = 1 then o_n else c_n end as loc_n, case when nf = 1 then o_e else c_e end as loc_e, case when nf = 1 then 0e0 else sd / nullif(n_loc, 0) end as loc_err from cen left join dis on dis.object_id = cen.object_id),
obj as (select err.*, loc.loc_n, loc.loc_e, loc.loc_err, coalesce(max_hot <= 1000 and max_hot > 2 and density >= 0.1 and units >= 1 and (coalesce(height, -2) > 2 or max_hot > 4), false) as significant,
  {classes.size_sql('size_cm2')} as size_class, {classes.height_sql('height', 'height_err')} as height_class from err join loc on loc.object_id = err.object_id)"""
NAMED = """
named as (select obj.*, case when significant and leg_id > 0 then chr(cast(64 + leg_id as int)) || cast(row_number() over (partition by significant and leg_id > 0, case when significant and leg_id > 0 then leg_id end order by object_id) as varchar)
  else '#' || cast(row_number() over (partition by coalesce(significant and leg_id > 0, false), case when significant and leg_id > 0 then leg_id end order by object_id) as varchar) end as name from obj)"""
HISTORY = """
run as (select object_id, type, max(case when type = 'Real' then num_hot end) over w as mh, max(case when type = 'Real' then box_w end) over w as mw, max(case when type = 'Real' then box_h end) over w as mb,
  count(case when type = 'Real' then 1 end) over w as n, avg(case when type = 'Real' then height_m end) over w as h from v_feature window w as (partition by object_id order by feature_id rows between unbounded preceding and current row)),
hist as (select object_id, count(case when type = 'Real' and mh <= 1000 and mh > 2 and coalesce(mh / nullif(mw * mb * 0.785e0, 0), 0) >= 0.1 and n * 1000e0 / 30e0 / 500e0 >= 1 and (coalesce(h, -2) > 2 or mh > 4) then 1 end) as num_significant_blocks from run group by object_id)"""
CAT = "cat as (select * from (select upper(trim(object_name)) as key, category, include, notes, row_number() over (partition by upper(trim(object_name)) order by object_name) as r from v_category) where r = 1)"


def sql(body: str, *views: str, obj: bool = True, more: str = "") -> str:
    parts = [ctes(*views)] if views else []
    if obj:
        parts += [OBJ.strip()] if "v_feature" in views else [ctes("v_feature"), OBJ.strip()]
    return "with " + ",\n".join([*parts, *([more.strip()] if more else [])]) + "\n" + body


def features(spark, d):
    return view(spark, d, "v_feature")


def objs(spark, d, where: bool = True):
    return ob.summarise(features(spark, d), CFG, where)


def _significance(spark, d):
    o = objs(spark, d, False)
    return o.groupBy("size_class", "height_class").agg(F.count("*").alias("n_objects"), F.count_if("significant").alias("n_significant"))


def _summary(spark, d):
    c = ["object_id", "leg_id", "n_features", "n_real", "max_hot", "max_sum_hot", "max_w", "max_h", "min_heat", "max_heat", "avg_heat", "size_cm2", "size_class", "height_class", "significant"]
    return objs(spark, d).select(*c, *[F.round(x, 6).alias(x) for x in ("height", "height_err", "density", "units", "loc_n", "loc_e", "loc_err")])


def _run_results(spark, d):
    f, o = features(spark, d), objs(spark, d, False)
    a = f.agg(F.countDistinct("block_id").alias("n_blocks"), F.count("*").alias("n_features"), F.count_if(F.col("num_hot") >= CFG.feature_min_pixels).alias("n_sig_features"), F.sum("num_hot").alias("sum_hot"))
    b = o.agg(F.count("*").alias("n_objects"), F.count_if("significant").alias("n_sig_objects"))
    return a.join(F.broadcast(b))  # one row each


def _ever(spark, d):
    o = objs(spark, d, False).join(ob.significant_blocks(features(spark, d), CFG), "object_id")
    return o.agg(F.count_if(ob.ever_significant()).alias("ever"), F.sum("n_real").alias("real_features"))


def _grid(spark, d):
    o = ob.names(objs(spark, d)).where(F.col("significant") & F.col("size_class").isin("M", "L", "XL", "XXL") & (F.col("height_class") != "?"))
    g = annotations.annotate(o, view(spark, d, "v_category"))
    return g.select("object_id", "name", "size_class", "height_class", F.col("first_block").alias("seen_from"), (F.col("last_real_block") - F.col("first_block")).alias("seen_for"), text.location(F.round(F.round("loc_n", 6)), F.round(F.round("loc_e", 6))).alias("location"),
                    F.round(F.col("loc_err") * 100, 2).alias("loc_err_cm"), (F.col("loc_err") <= CFG.good_location_err_m).alias("good_location"), F.coalesce("category", F.lit("")).alias("category"))


def _animals(spark, d):
    return exports.animals(ob.names(objs(spark, d)).withColumn("name", F.concat(F.lit("P"), F.col("object_id").cast("string"))), view(spark, d, "v_category"))


ANIMALS = """ani as (select object_id, 'P' || cast(object_id as varchar) as name, round(-36.85e0 + loc_n / (pi() * 6378137e0 / 180), 7) as latitude, round(174.76e0 + loc_e / (pi() * 6378137e0 / 180 * cos(radians(-36.85e0))), 7) as longitude,
  coalesce(round(loc_err, 4), -2) as loc_err, coalesce(round(height, 4), -2) as height, coalesce(round(height_err, 4), -2) as height_err, size_cm2, size_class, height_class, max_heat, coalesce(category, '') as category
  from obj left join cat on cat.key = upper('P' || cast(object_id as varchar)) where significant)"""
ANI = dict(more=CAT + ",\n" + ANIMALS)
POINT = "select object_id, latitude, longitude, 100 as altitude, 5 as speed, true as picture, 90 as tilt, 2 as wait from ani where latitude is not null"


def _rounded(s, d, form):
    """Waypoints in whole 1/1024 degrees: the text of these is the same in both engines."""
    p = exports.waypoints(_animals(s, d))
    return form(p.withColumns({c: F.floor(F.col(c) * 1024) / 1024 for c in ("latitude", "longitude")}))


SHORT = "select object_id, floor(latitude * 1024) / 1024 as latitude, floor(longitude * 1024) / 1024 as longitude from ani where latitude is not null"


def _hist(column, lowest=0, bin_=None):
    return lambda s, d: ob.histogram(objs(s, d).where("significant"), bin_() if bin_ else F.col(column), lowest=lowest)


def _heat(s, d):
    """Heat above the least of the list."""
    o = objs(s, d)
    low = o.agg(F.min("avg_heat").alias("_low"))
    return ob.histogram(o.where("significant").join(F.broadcast(low)), F.col("avg_heat") - F.col("_low"))  # one row


def _hist_sql(bin_: str, low: str = "0", views: tuple[str, ...] = ("v_feature",), more: str = "", rows: str = "obj") -> str:
    return sql(f"""select g.bin, cast(coalesce(n, 0) as bigint) as n from (select unnest(generate_series(cast({low} as bigint), b)) as bin from (select min(bin) as a, max(bin) as b from h) where b is not null) g left join (select bin, count(*) as n from h group by bin) c on c.bin = g.bin""",
               *views, more=f"{more}h as (select * from (select cast({bin_} as bigint) as bin from {rows} where significant) where bin is not null {'and bin >= 0' if low == '0' else ''})")


def _leg(column):
    return lambda s, d: ob.by_leg(objs(s, d), column)


def _leg_sql(column):
    return sql(f"select leg_id, count(*) as n, round(avg({column}), 6) as mean, round(max({column}), 6) as most from obj where significant group by rollup(leg_id)", "v_feature")


def _counts(column, names):
    return lambda s, d: ob.class_counts(s, objs(s, d, False), column, names)


def _counts_sql(column, names):
    dim = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    return sql(f"select idx, dim.name, cast(coalesce(n, 0) as bigint) as n from (values {dim}) as dim(idx, name) left join (select {column} as c, count(*) as n from obj where significant group by 1) x on x.c = dim.name", "v_feature")


def _range_m(s, d):
    f = features(s, d)
    return f.select("feature_id", F.round(geo.distance(F.col("northing_m"), F.col("easting_m"), F.lit(50.0), F.lit(50.0)), 6).alias("range_m"))


def _detail(s, d):
    f, o = features(s, d), ob.locations(features(s, d))
    j = f.join(o, "object_id")
    return j.select("object_id", "feature_id", (F.col("box_x") + F.expr("box_w div 2")).alias("centre_x"), (F.col("box_y") + F.expr("box_h div 2")).alias("centre_y"), (F.round(F.col("northing_m") - F.col("loc_n"), 6) + 0.0).alias("d_n"), (F.round(F.col("easting_m") - F.col("loc_e"), 6) + 0.0).alias("d_e"))


def _detected(s, d):
    o = objs(s, d, False)
    return o.select("object_id", (F.col("first_block") * 1000).alias("first_ms"), (F.col("last_real_block") * 1000).alias("last_ms"), F.greatest((F.col("last_real_block") - F.col("first_block")) * 1000, F.lit(0)).alias("duration_ms"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), F.col("significant").alias("is_significant"))


def _estimates(s, d):
    m = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 120).cast("double").alias("m"), (F.col("o_orderkey") % 3).alias("k"))
    per = lambda a, b, c: F.when(F.col("k") == 0, a).when(F.col("k") == 1, b).otherwise(c)
    return m.groupBy("k").agg(F.sum((F.col("m") * per(2.5, 1.8, 1.2)).cast("int")).alias("objects"), F.round(F.sum(F.greatest(F.col("m") * per(0.8, 0.4, 0.2), F.lit(0.5))), 4).alias("minutes"))


def _expected(s, d):
    return ob.expected_box(features(s, d))


def _upsert(s, d):
    c = view(s, d, "v_category")
    new = c.where(F.col("notes") == "Brand#11").select(F.lower("object_name").alias("object_name"), F.when(F.length("category") % 2 == 0, F.lit("")).otherwise(F.lit("Goat")).alias("category"), "include", "notes")
    return annotations.upsert(c, new)


def _in_scope(s, d):
    o = objs(s, d, False)
    return o.where(F.col("significant") & ob.in_run_scope(F.col("first_block") * 1000, F.col("last_real_block") * 1000, F.lit(5000), F.lit(20000))).select("object_id", "first_block", "last_real_block")


def _colours(s, d):
    f = features(s, d)
    stepped = F.least(F.floor((F.col("max_heat") - 200) / F.greatest(F.lit(int((255 - 200) / 8)), F.lit(1))), F.lit(7)).cast("int")
    return f.groupBy(stepped.alias("colour")).agg(F.count("*").alias("n"))


def _save(mode):
    """An object is kept if it was significant at any block."""
    kept = lambda s, d: objs(s, d, False).join(ob.significant_blocks(features(s, d), CFG), "object_id").withColumn("kept", F.col("num_significant_blocks") > 0)
    return lambda s, d: tables.savable(kept(s, d), mode, "kept").groupBy("leg_id").agg(F.count("*").alias("n"))


def _relink(s, d):
    return tables.relink(features(s, d), objs(s, d, False).where("significant")).groupBy("object_id").agg(F.count("*").alias("n"), F.max("last_real_feature_id").alias("last_real"))


def _spans(s, d):
    o = objs(s, d).where("significant and leg_id > 0")
    return o.groupBy(F.col("leg_id").alias("span_leg")).agg(F.min("first_block").alias("min_block"), F.max("last_block").alias("max_block"), F.count("*").alias("n_sig"), F.round(F.sum("loc_err"), 4).alias("sum_loc_err"), F.round(F.sum("height_err"), 4).alias("sum_height_err"),
                                                            F.round(F.avg("loc_err"), 6).alias("avg_loc_err"), (F.max("last_block") - F.min("first_block") + 1).alias("n_blocks"))


def _in_range(s, d):
    o = objs(s, d, False)
    spans = s.range(1, 8).select(F.col("id").alias("span_leg"), F.lit(1).alias("min_block"), (F.col("id") * 4 + 12).alias("max_block"))
    return spatial.objects_in_range(o, spans).groupBy("span_leg").agg(F.count("*").alias("n"), F.min("object_id").alias("least"), F.max("object_id").alias("most"))


def _path(s, d):
    f = features(s, d)
    one = f.where("type = 'Real'").select(F.lit("feature").alias("series"), F.col("northing_m").alias("n"), F.col("easting_m").alias("e"))
    two = ob.locations(f).select(F.lit("object").alias("series"), F.col("loc_n").alias("n"), F.col("loc_e").alias("e"))
    return one.unionByName(two).groupBy("series").agg(F.count("*").alias("points"), F.count("n").alias("known"), F.round(F.sum("n"), 3).alias("sum_n"), F.round(F.sum("e"), 3).alias("sum_e"))


def _percentile(s, d):
    from pyspark.sql import Window

    f = features(s, d).select("leg_id", "sum_hot", "feature_id")
    w = Window.partitionBy("leg_id").orderBy("sum_hot", "feature_id")
    n = f.groupBy("leg_id").agg(F.count("*").alias("n"))
    r = f.withColumn("r", F.row_number().over(w) - 1).join(n, "leg_id")
    return r.groupBy("leg_id").agg(F.max(F.when(F.col("r") == (F.col("n") * 0.02).cast("int"), F.col("sum_hot"))).alias("low"), F.max(F.when(F.col("r") == (F.col("n") * 0.98).cast("int"), F.col("sum_hot"))).alias("high"))


def _brightest(s, d):
    f = features(s, d).where("type = 'Real'")
    return f.groupBy("object_id").agg(F.max_by("feature_id", F.struct("sum_hot", (-F.col("feature_id")).alias("k"))).alias("image_feature"), F.max("sum_hot").alias("sum_hot"))


def _consumed(s, d):
    f = features(s, d).where("type = 'Real'").select("block_id", "object_id", "feature_id", "box_x", "box_y", "box_w", "box_h")
    g = f.select((F.col("block_id") - 1).alias("block_id"), "object_id", *[F.col(f"box_{c}").alias(f"b_{c}") for c in "xywh"])
    u = rect.Rect.of().union(rect.Rect(*(F.col(f"b_{c}") for c in "xywh")), extra=1)
    return f.join(g, ["object_id", "block_id"]).select("object_id", "feature_id", u.x.alias("x"), u.y.alias("y"), u.w.alias("w"), u.h.alias("h"))


SUMMARY_COLS = "object_id, leg_id, n_features, n_real, max_hot, max_sum_hot, max_w, max_h, min_heat, max_heat, avg_heat, size_cm2, size_class, height_class, significant, " + ", ".join(f"round({c}, 6) as {c}" for c in ("height", "height_err", "density", "units", "loc_n", "loc_e", "loc_err"))
LIST = ", ".join(f"round(cast({f}({c}) as double), 4) as {f}_{n}" for c, n in (("loc_err", "loc_err"), ("height", "height"), ("height_err", "height_err"), ("size_cm2", "size"), ("avg_heat", "heat")) for f in ("min", "max", "sum"))
EXP = """x as (select object_id, arg_min(box_x, feature_id) as fx, arg_min(box_y, feature_id) as fy, arg_max(box_x, feature_id) as lx, arg_max(box_y, feature_id) as ly, arg_max(box_w, feature_id) as lw, arg_max(box_h, feature_id) as lh, arg_max(type, feature_id) as lt,
  arg_max(block_id, feature_id) - arg_min(block_id, feature_id) as mv, coalesce(max(case when type = 'Real' then box_w end), 0) as mw, coalesce(max(case when type = 'Real' then box_h end), 0) as mh from v_feature group by object_id)"""

QUERIES = {
    "significance_by_class": (_significance, sql("select size_class, height_class, count(*) as n_objects, count(case when significant then 1 end) as n_significant from obj group by 1, 2", "v_feature")),
    "object_summary": (_summary, sql(f"select {SUMMARY_COLS} from obj", "v_feature")),
    "object_list_summary": (lambda s, d: ob.list_summary(objs(s, d)), sql(f"select count(*) as n_objects, {LIST}, round(avg(height), 4) as avg_height from obj", "v_feature")),
    "object_location_error": (lambda s, d: ob.locations(features(s, d)).select("object_id", *[F.round(c, 6).alias(c) for c in ("loc_n", "loc_e", "loc_err")]), sql("select object_id, round(loc_n, 6) as loc_n, round(loc_e, 6) as loc_e, round(loc_err, 6) as loc_err from loc", "v_feature")),
    "object_attributes": (lambda s, d: objs(s, d, False).groupBy("attributes").agg(F.count("*").alias("n")),
        sql("""select attributes, count(*) as n from (select trim(case when significant then 'Sig' else '' end || ' ' || case when max_hot <= 1000 and max_hot > 8 then 'P3' when max_hot <= 1000 and max_hot > 4 then 'P2' when max_hot <= 1000 and max_hot > 2 then 'P1' else 'p' end || ' '
  || case when units >= 4 then 'T3' when units >= 2 then 'T2' when units >= 1 then 'T1' else 't' end || ' ' || case when coalesce(height, -2) > 4 then 'E3' when coalesce(height, -2) > 2 then 'E2' when coalesce(height, -2) >= 0 then 'E1' else 'e' end) as attributes from obj) group by 1""", "v_feature")),
    "object_derived": (lambda s, d: ob.derived(objs(s, d, False)).select("object_id", "first_block", "centre_block", "last_real_block", "last_block"), sql("select object_id, first_block, (first_block + last_real_block + 1) // 2 as centre_block, last_real_block, last_block from obj", "v_feature")),
    "run_results": (_run_results, sql("select (select count(distinct block_id) from v_feature) as n_blocks, (select count(*) from v_feature) as n_features, (select count(*) from v_feature where num_hot >= 8) as n_sig_features, (select cast(sum(num_hot) as bigint) from v_feature) as sum_hot, count(*) as n_objects, count(case when significant then 1 end) as n_sig_objects from obj", "v_feature")),
    "ever_significant": (_ever, sql("select count(case when num_significant_blocks > 0 and units >= 1 then 1 end) as ever, cast(sum(n_real) as bigint) as real_features from obj join hist using (object_id)", "v_feature", more=HISTORY)),
    "histogram_height": (_hist("height", bin_=lambda: F.bround(F.col("height"))), _hist_sql("round_even(height, 0)")),
    "histogram_size": (_hist("size_cm2", bin_=lambda: (F.col("size_cm2") / 1000).cast("long") + 1), _hist_sql("trunc(size_cm2 / 1000e0) + 1")),
    "histogram_heat": (_heat, _hist_sql("avg_heat - (select min(avg_heat) from obj)")),
    "class_counts_size": (_counts("size_class", classes.SIZE_NAMES), _counts_sql("size_class", classes.SIZE_NAMES)),
    "class_counts_height": (_counts("height_class", classes.HEIGHT_NAMES), _counts_sql("height_class", classes.HEIGHT_NAMES)),
    "size_height_matrix": (lambda s, d: ob.matrix(objs(s, d, False)), sql("select height_class, size_class, count(*) as n from obj where significant group by cube(height_class, size_class)", "v_feature")),
    "leg_location_rollup": (_leg("loc_err"), _leg_sql("loc_err")),
    "leg_height_rollup": (_leg("height_err"), _leg_sql("height_err")),
    "object_grid": (_grid, sql("""select object_id, name, size_class, height_class, first_block as seen_from, last_real_block - first_block as seen_for, cast(cast(round(round(loc_n, 6)) as bigint) as varchar) || ',' || cast(cast(round(round(loc_e, 6)) as bigint) as varchar) as location, round(loc_err * 100, 2) as loc_err_cm, loc_err <= 5 as good_location, coalesce(category, '') as category
  from named left join cat on cat.key = upper(trim(name)) where significant and size_class in ('M', 'L', 'XL', 'XXL') and height_class <> '?'""", "v_feature", "v_category", more=NAMED + ",\n" + CAT)),
    "object_names": (lambda s, d: ob.names(objs(s, d, False)).select("object_id", "name"), sql("select object_id, name from named", "v_feature", more=NAMED)),
    "annotation_summary": (lambda s, d: annotations.summary(view(s, d, "v_category")), sql("select case when include then category end as category, count(*) as n from v_category where trim(category) <> '' group by 1", "v_category", obj=False)),
    "annotation_text": (lambda s, d: annotations.summary_text(view(s, d, "v_category")), sql("select cast(sum(n) as bigint) as total, cast(coalesce(sum(case when c is null then n end), 0) as bigint) as excluded, string_agg(c || ' ' || cast(n as varchar), ', ' order by c || ' ' || cast(n as varchar)) as text from (select case when include then category end as c, count(*) as n from v_category where trim(category) <> '' group by 1)", "v_category", obj=False)),
    "annotation_upsert": (_upsert, sql("""select coalesce(a.key, b.key) as key, case when b.key is not null then b.category else a.category end as category, case when b.key is not null then b.include else a.include end as include, case when b.key is not null then b.notes else a.notes end as notes
  from cat a full join (select key, case when length(category) % 2 = 0 then '' else 'Goat' end as category, include, notes from cat where notes = 'Brand#11') b on a.key = b.key where trim(case when b.key is not null then b.category else a.category end) <> ''""", "v_category", obj=False, more=CAT)),
    "animals": (_animals, sql("select * from ani", "v_feature", "v_category", **ANI)),
    "waypoints_all": (lambda s, d: exports.waypoints(_animals(s, d)), sql(POINT, "v_feature", "v_category", **ANI)),
    "waypoints_selected": (lambda s, d: exports.waypoints(_animals(s, d), True), sql(POINT + " and category not in ('', 'Ignore')", "v_feature", "v_category", **ANI)),
    "waypoints_csv": (lambda s, d: _rounded(s, d, exports.csv_lines), sql("select object_id, cast(latitude as varchar) || ',' || cast(longitude as varchar) || ',100,5,TRUE,,90,,2' as line from (" + SHORT + ")", "v_feature", "v_category", **ANI)),
    "waypoints_json": (lambda s, d: _rounded(s, d, exports.json_segments), sql("""select object_id, '{"type":"Waypoint","point":{"latitude":' || cast(latitude as varchar) || ',"longitude":' || cast(longitude as varchar) || ',"altitude":100,"altitudeType":"AGL"},"parameters":{"speed":5,"altitudeType":"AGL"}}' as segment from (""" + SHORT + ")", "v_feature", "v_category", **ANI)),
    "waypoints_kml": (lambda s, d: _rounded(s, d, exports.kml_placemarks), sql("""select object_id, '    <Placemark>' || chr(10) || '      <name>WP Point</name>' || chr(10) || '      <styleUrl>#defaultStyle</styleUrl>' || chr(10) || '      <Point>' || chr(10) || '        <coordinates>' || cast(longitude as varchar) || ',' || cast(latitude as varchar) || ',0</coordinates>' || chr(10) || '      </Point>' || chr(10) || '    </Placemark>' || chr(10) as placemark from (""" + SHORT + ")", "v_feature", "v_category", **ANI)),
    "feature_range": (_range_m, sql("select feature_id, round(sqrt((northing_m - 50) * (northing_m - 50) + (easting_m - 50) * (easting_m - 50)), 6) as range_m from v_feature", "v_feature", obj=False)),
    "feature_detail": (_detail, sql("select f.object_id, feature_id, box_x + box_w // 2 as centre_x, box_y + box_h // 2 as centre_y, round(northing_m - loc_n, 6) + 0e0 as d_n, round(easting_m - loc_e, 6) + 0e0 as d_e from v_feature f join loc on loc.object_id = f.object_id", "v_feature")),
    "feature_first_last": (lambda s, d: ob.first_last(features(s, d)), sql(f"select object_id, min(feature_id) as first_feature, max(feature_id) as last_feature, max({_r('feature_id')}) as last_real_feature, arg_max(block_id, feature_id) as last_block, arg_min(block_id, feature_id) as first_block from v_feature group by object_id", "v_feature", obj=False)),
    "feature_locf": (lambda s, d: ob.fill_forward(features(s, d)).select("object_id", "feature_id", "height_m", "height_filled"), sql("select object_id, feature_id, height_m, last_value(height_m ignore nulls) over (partition by object_id order by feature_id rows between unbounded preceding and current row) as height_filled from v_feature where type = 'Real'", "v_feature", obj=False)),
    "brightest_image": (_brightest, sql("select object_id, arg_min(feature_id, struct_pack(a := -sum_hot, b := feature_id)) as image_feature, max(sum_hot) as sum_hot from v_feature where type = 'Real' group by object_id", "v_feature", obj=False)),
    "consumed_boxes": (_consumed, sql("select a.object_id, a.feature_id, least(a.box_x, b.box_x) as x, least(a.box_y, b.box_y) as y, greatest(a.box_x + a.box_w, b.box_x + b.box_w) - least(a.box_x, b.box_x) + 1 as w, greatest(a.box_y + a.box_h, b.box_y + b.box_h) - least(a.box_y, b.box_y) + 1 as h from v_feature a join v_feature b on a.object_id = b.object_id and b.block_id = a.block_id + 1 where a.type = 'Real' and b.type = 'Real'", "v_feature", obj=False)),
    "expected_box": (_expected, sql("""select object_id, cast(ex - g as bigint) as exp_x, cast(ey - g as bigint) as exp_y, cast(ew + 2 * g as bigint) as exp_w, cast(eh + 2 * g as bigint) as exp_h from (select object_id, case when lt = 'Real' then 5 else 0 end as g,
  case when mv >= 1 then cast(trunc(lx + cast(lx - fx as double) / mv - (mw - lw) / 2e0) as bigint) else lx end as ex, case when mv >= 1 then cast(trunc(ly + cast(ly - fy as double) / mv - (mh - lh) / 2e0) as bigint) else ly end as ey, case when mv >= 1 then mw else lw end as ew, case when mv >= 1 then 2 * mh else lh end as eh from x)""", "v_feature", obj=False, more=EXP)),
    "detected_objects": (_detected, sql("select object_id, first_block * 1000 as first_ms, last_real_block * 1000 as last_ms, greatest((last_real_block - first_block) * 1000, 0) as duration_ms, 0e0 as latitude, 0e0 as longitude, significant as is_significant from obj", "v_feature")),
    "preview_estimates": (_estimates, "select k, cast(sum(cast(trunc(m * case k when 0 then 2.5e0 when 1 then 1.8e0 else 1.2e0 end) as int)) as bigint) as objects, round(sum(greatest(m * case k when 0 then 0.8e0 when 1 then 0.4e0 else 0.2e0 end, 0.5e0)), 4) as minutes from (select cast(o_orderkey % 120 as double) as m, o_orderkey % 3 as k from orders) group by k"),
    "objects_in_scope": (_in_scope, sql("select object_id, first_block, last_real_block from obj where significant and least(last_real_block * 1000, 20000) - greatest(first_block * 1000, 5000) > 0 and (least(last_real_block * 1000, 20000) - greatest(first_block * 1000, 5000)) / cast(last_real_block * 1000 - first_block * 1000 as double) >= 0.5", "v_feature")),
    "objects_by_leg": (lambda s, d: objs(s, d, False).where("significant and leg_id = 3").select("object_id", "leg_id", "size_class"), sql("select object_id, leg_id, size_class from obj where significant and leg_id = 3", "v_feature")),
    "colour_ramp": (_colours, sql("select cast(least(floor((max_heat - 200) / 6e0), 7) as int) as colour, count(*) as n from v_feature group by 1", "v_feature", obj=False)),
    "save_significant": (_save("Significant"), sql("select leg_id, count(*) as n from obj join hist using (object_id) where num_significant_blocks > 0 group by leg_id", "v_feature", more=HISTORY)),
    "relinked_features": (_relink, sql(f"select f.object_id, count(*) as n, max(case when type = 'Real' then feature_id end) as last_real from v_feature f join obj on obj.object_id = f.object_id where significant group by f.object_id", "v_feature")),
    "leg_spans": (_spans, sql("select leg_id as span_leg, min(first_block) as min_block, max(last_block) as max_block, count(*) as n_sig, round(sum(loc_err), 4) as sum_loc_err, round(sum(height_err), 4) as sum_height_err, round(avg(loc_err), 6) as avg_loc_err, max(last_block) - min(first_block) + 1 as n_blocks from obj where significant and leg_id > 0 group by leg_id", "v_feature")),
    "step_range_objects": (_in_range, sql("select g as span_leg, count(*) as n, min(object_id) as least, max(object_id) as most from obj join (select unnest(generate_series(1, 7)) as g) on leg_id = g and first_block >= 1 and last_real_block <= g * 4 + 12 group by g", "v_feature")),
    "path_points": (_path, sql("select 'feature' as series, count(*) as points, count(northing_m) as known, round(sum(northing_m), 3) as sum_n, round(sum(easting_m), 3) as sum_e from v_feature where type = 'Real' union all select 'object', count(*), count(loc_n), round(sum(loc_n), 3), round(sum(loc_e), 3) from loc", "v_feature")),
    "percentile_window": (_percentile, sql("select leg_id, max(case when r = cast(trunc(n * 0.02e0) as bigint) then sum_hot end) as low, max(case when r = cast(trunc(n * 0.98e0) as bigint) then sum_hot end) as high from (select leg_id, sum_hot, row_number() over (partition by leg_id order by sum_hot, feature_id) - 1 as r, count(*) over (partition by leg_id) as n from v_feature) group by leg_id", "v_feature", obj=False)),
}
