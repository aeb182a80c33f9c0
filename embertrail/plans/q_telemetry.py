"""Queries over blocks and flight telemetry, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from embertrail.operators import telemetry as te
from embertrail.sources.fixtures import ctes, view

ASOF = f"""with {ctes('v_step', 'v_block')},
st as (select *, {', '.join(f'lead({c}) over (partition by flight_id order by step_id) as n_{c}' for c in ('step_id', 'ms', 'northing_m', 'easting_m', 'altitude_m', 'yaw_deg', 'pitch_deg'))} from v_step),
j as (select b.flight_id, b.block_id, b.ms, s.step_id as before_step_id, s.n_step_id as after_step_id, s.ms as before_ms, s.n_ms as after_ms,
  {', '.join(f's.{c} as b_{c}, s.n_{c} as a_{c}' for c in ('northing_m', 'easting_m', 'altitude_m', 'yaw_deg', 'pitch_deg'))},
  case when s.n_ms > s.ms then cast(b.ms - s.ms as double) / (s.n_ms - s.ms) end as w from v_block b asof left join st s on b.flight_id = s.flight_id and b.ms >= s.ms)
"""
MIX = ", ".join(f"round(case when b_{c} is not null and a_{c} is not null and w is not null then b_{c} + (a_{c} - b_{c}) * w else coalesce(b_{c}, a_{c}) end, 6) + 0e0 as {c}" for c in ("northing_m", "easting_m", "altitude_m", "yaw_deg", "pitch_deg"))
PLACED = f"p as (select flight_id, block_id, ms, {MIX.replace('round(case', '(case').replace('end, 6)', 'end)')} from j)"
DELTA = f"""d as (select *, case when ms - lag(ms) over w > 0 then ms - lag(ms) over w else 33 end as time_ms,
  coalesce(sqrt((northing_m - lag(northing_m) over w) * (northing_m - lag(northing_m) over w) + (easting_m - lag(easting_m) over w) * (easting_m - lag(easting_m) over w)), 0) as lineal_m from p window w as (partition by flight_id order by block_id))"""


def _joined(s, d):
    return te.as_of(view(s, d, "v_block"), view(s, d, "v_step"))


def _placed(s, d):
    return te.interpolate(_joined(s, d))


def _deltas(s, d):
    return te.deltas(_placed(s, d)).select("flight_id", "block_id", "time_ms", F.round("lineal_m", 5).alias("lineal_m"))


QUERIES = {
    "block_asof_step": (lambda s, d: _joined(s, d).select("flight_id", "block_id", "ms", "before_step_id", "after_step_id"), ASOF + "select flight_id, block_id, ms, before_step_id, after_step_id from j"),
    "block_interpolated": (lambda s, d: _placed(s, d).select("flight_id", "block_id", "closest_step_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("northing_m", "easting_m", "altitude_m", "yaw_deg", "pitch_deg")]),
        ASOF + f"select flight_id, block_id, case when after_step_id is null or coalesce(w, 0) <= 0.5 then before_step_id else after_step_id end as closest_step_id, {MIX} from j"),
    "block_deltas": (_deltas, ASOF + f", {PLACED}, {DELTA} select flight_id, block_id, time_ms, round(lineal_m, 5) as lineal_m from d"),
    "block_running_lineal": (lambda s, d: te.deltas(_placed(s, d)).select("flight_id", "block_id", F.round("sum_lineal_m", 4).alias("sum_lineal_m")), ASOF + f", {PLACED}, {DELTA} select flight_id, block_id, round(sum(lineal_m) over (partition by flight_id order by block_id rows between unbounded preceding and current row), 4) as sum_lineal_m from d"),
    "significance_bursts": (lambda s, d: te.bursts(view(s, d, "v_block")), f"""with {ctes('v_block')}, h as (select *, case when block_id - lag(block_id) over (partition by flight_id order by block_id) <= 9 then 0 else 1 end as b from v_block where num_sig > 0),
r as (select *, cast(sum(b) over (partition by flight_id order by block_id) as bigint) as burst from h) select flight_id, burst, min(block_id) as min_block, max(block_id) as max_block, count(*) as n_blocks, max(num_sig) as most_sig from r group by flight_id, burst"""),
    "nearest_block": (lambda s, d: te.nearest_block(view(s, d, "v_block"), 1_000_000_000), f"with {ctes('v_block')} select flight_id, arg_min(block_id, struct_pack(a := abs(ms - 1000000000), b := block_id)) as block_id from v_block group by flight_id"),
    "display_sample": (lambda s, d: te.display_sample(view(s, d, "v_block")).select("flight_id", "block_id"), f"with {ctes('v_block')} select flight_id, block_id from (select *, min(block_id) over (partition by flight_id) as a, max(block_id) over (partition by flight_id) as z from v_block) where block_id % 100 = 0 or block_id = a or block_id >= z - 1"),
}
