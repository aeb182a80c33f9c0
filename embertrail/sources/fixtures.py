"""The engine's logical tables, derived from the driver's tables by SQL that runs unchanged in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_feature": """
select l_partkey as object_id, l_partkey % 8 as leg_id,
  l_partkey * 1000000 + row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_returnflag) as feature_id,
  row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_returnflag) as block_id,
  case when l_returnflag = 'R' then 'Unreal' else 'Real' end as type,
  (l_orderkey * 31) % 600 as box_x, (l_suppkey * 17) % 480 as box_y,
  3 + l_orderkey % 30 as box_w, 3 + l_suppkey % 20 as box_h,
  cast(l_quantity as int) as num_hot, cast(l_quantity as int) * (1 + l_linenumber) as sum_hot,
  200 + l_orderkey % 56 as max_heat,
  (l_orderkey % 1000) / 1e1 as northing_m, (l_suppkey % 1000) / 1e1 as easting_m,
  case when l_linenumber = 7 then null else cast((l_linenumber % 4) + (l_partkey % 16) as double) end as height_m,
  100 + (l_partkey % 50) * 100 as image_area_m2
from lineitem""",
    "v_pixel": """
select block_id, y, x, max(heat) as heat from (
  select cast(floor(l_orderkey / 1e3) as int) as block_id,
    (l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 100 as y,
    (l_partkey * 31 + l_suppkey * 17) % 200 as x,
    cast(l_quantity as int) * 5 as heat
  from lineitem) t
group by block_id, y, x""",
    "v_step": """
select user_id as flight_id, row_number() over (partition by user_id order by ts) as step_id,
  cast(floor(unix_micros(cast(ts as timestamp)) / 1e3) as bigint) - 1704067200000 as ms,
  (event_id * 37 % 2000) / 1e1 as northing_m, (event_id * 53 % 2000) / 1e1 as easting_m,
  60 + (event_id % 200) / 1e1 as altitude_m,
  case when event_id % 11 = 0 then null else (event_id * 7 % 360) / 1e0 end as yaw_deg,
  -((event_id % 60) / 1e0) as pitch_deg, 10 + (event_id % 25) / 5e0 as dem_m
from events where event_type in ('view', 'signup')""",
    "v_block": """
select user_id as flight_id, row_number() over (partition by user_id order by ts) as block_id,
  cast(floor(unix_micros(cast(ts as timestamp)) / 1e3) as bigint) - 1704067200000 as ms, value,
  case when value > 6e1 then 1 else 0 end as num_sig
from events where event_type not in ('view', 'signup')""",
    "v_category": """
select concat(case when p_partkey % 3 = 0 then ' p' else 'P' end, cast(p_partkey as string)) as object_name,
  case when p_size % 4 = 0 then '' else p_type end as category,
  p_size % 5 <> 0 as include, p_brand as notes
from part where p_partkey % 2 = 0""",
    "v_dem": """
select a.event_id as n_cell, b.event_id as e_cell, 5 + ((a.event_id * 7 + b.event_id * 13) % 25) / 5e0 as elev_m
from events a cross join events b where a.event_id < 200 and b.event_id < 200""",
}
#: Where the drone is in each block of a leg: the block's step.
VIEWS["v_drone"] = f"""
select distinct leg_id, block_id, block_id + leg_id * 1000 as step_id, leg_id * 9e0 + block_id * 2e0 as drone_n, 90e0 - block_id * 3e0 as drone_e, block_id * 35e-1 as lineal_m
from ({VIEWS["v_feature"]}) v_feature"""
VIEWS["v_ray"] = f"""
select object_id, feature_id, easting_m as c_e, northing_m as c_n, 60 + block_id / 1e1 as c_a,
  cast(object_id % 90 as double) as tx, cast(object_id % 70 as double) as ty, cast(object_id % 5 as double) as tz,
  object_id % 90 - easting_m as d_e, object_id % 70 - northing_m as d_n, object_id % 5 - (60 + block_id / 1e1) as d_a
from ({VIEWS["v_feature"]}) v_feature where type = 'Real'"""

TABLES = {"v_feature": "lineitem", "v_pixel": "lineitem", "v_ray": "lineitem", "v_drone": "lineitem", "v_step": "events", "v_block": "events", "v_dem": "events", "v_category": "part"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table as a DataFrame."""
    if name == "v_dem":  # 200 cells for each row: no join of a table with itself
        rows = table(spark, sf_dir, "events").where("event_id < 200").selectExpr("event_id as n_cell", "explode(sequence(0L, 199L)) as e_cell")
        return rows.selectExpr("n_cell", "e_cell", "5 + ((n_cell * 7 + e_cell * 13) % 25) / 5e0 as elev_m")
    source = TABLES[name]
    return spark.sql(VIEWS[name].replace(f"from {source}", "from {source}"), source=table(spark, sf_dir, source))


def ctes(*names: str) -> str:
    """The same as a list of common table expressions for DuckDB."""
    return ",\n".join(f"{n} as materialized ({VIEWS[n].replace('unix_micros(', 'epoch_us(')})" for n in names)
