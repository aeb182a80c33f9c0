"""Parameters, schemas, geometry, kernels and exports on hand-made cases."""

import json
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from embertrail import schema
from embertrail.config import Config
from embertrail.functions import classes, geo, rect, score, text
from embertrail.operators import annotations, clusters, exports, objects, pixels, spatial, telemetry
from embertrail.sources import tables

CFG = Config()


@pytest.mark.parametrize("seed", range(5))
def test_config_round_trip(seed):
    r = random.Random(seed)
    cfg = replace(CFG, heat_threshold=r.randint(50, 254), radiometric_low=r.randint(4000, 4999), object_min_pixels=r.randint(1, 999), yolo_confidence=round(r.uniform(0.1, 0.9), 3), exclude_corner=r.random() < 0.5, exclude_width=round(r.random(), 2), save_objects="All")
    assert Config.from_rows(cfg.rows()) == cfg
    assert Config.from_rows([("heat_threshold", ""), ("gone", "1")]) == CFG


def test_config_clamps_and_cameras():
    c = replace(CFG, heat_threshold=300, object_min_pixels=0, object_max_pixels=1, yolo_confidence=0.95, radiometric_low=1).clamped()
    assert (c.heat_threshold, c.object_min_pixels, c.object_max_pixels, c.yolo_confidence, c.radiometric_low) == (255, 1, 10, 0.1, 4000)
    assert CFG.for_camera("H20N").heat_threshold == 180 and CFG.for_camera("?").heat_threshold == 200
    assert replace(CFG, exclude_width=0.25, exclude_height=30).exclusion_edges(640, 512) == (480, 482) and CFG.exclusion_edges(640, 512) is None


@pytest.mark.parametrize("name", ["feature", "block", "span", "object_category", "detection", "dem"])
def test_settings_round_trip(spark, name):
    s, r = tables.SCHEMAS[name], random.Random(name)
    make = {"long": lambda: r.randint(1, 9999), "int": lambda: r.randint(0, 999), "double": lambda: round(r.uniform(-1000, 1000), 2), "string": lambda: r.choice(["Real", "LOS", "x y"]), "boolean": lambda: r.random() < 0.5}
    rows = [tuple(None if r.random() < 0.2 else make[f.dataType.simpleString().replace("bigint", "long")]() for f in s.fields) for _ in range(20)]
    df = spark.createDataFrame(rows, s)
    back = schema.parse_settings(schema.to_settings(df), s)
    same = lambda d: sorted(str([False if v is None and f.dataType.simpleString() == "boolean" and False else v for v, f in zip(row, s.fields, strict=True)]) for row in d.collect())
    assert same(back) == same(df)


def test_tables_read_write_and_sentinels(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 5.0), (1, 3, None)], "n_cell int, e_cell int, elev_m double")
    tables.write(rows, str(tmp_path / "dem"))
    assert tables.read(spark, str(tmp_path / "dem"), "dem").count() == 2
    (tmp_path / "c.csv").write_text("object_name,category,include,notes\nA1,Goat,TRUE,x\n , , , \n")
    got = tables.read_settings_csv(spark, str(tmp_path / "c.csv"), "object_category").collect()
    assert [(r["object_name"], r["include"]) for r in got] == [("A1", True)]
    tables.write_config(spark, replace(CFG, heat_threshold=99), str(tmp_path / "cfg"))
    assert tables.read_config(spark, str(tmp_path / "cfg")).heat_threshold == 99
    out = rows.select(schema.to_sentinel(F.col("elev_m")).alias("x")).select("x", schema.from_sentinel(F.col("x")).alias("y")).collect()
    assert [(r["x"], r["y"]) for r in out] == [(5.0, 5.0), (-999.0, None)]
    with pytest.raises(ValueError):
        tables.savable(rows, "Some")


@pytest.mark.parametrize("h,err,want", [(2.0, 0.0, "G"), (2.005, 0.0, "6f+"), (2.01, 0.0, "6f+"), (5.0, 0.0, "1f"), (17.01, 0.0, "6f+"), (3.0, 5.1, "?"), (None, None, "?"), (-5.0, 0.0, "?"), (-1.0, 0.0, "G")])
def test_height_classes(spark, h, err, want):
    got = spark.createDataFrame([(h, err)], "h double, e double").select(classes.height_class(F.col("h"), F.col("e"))).first()[0]
    assert got == want


@pytest.mark.parametrize("cm2,want", [(0, "XXS"), (100, "XXS"), (101, "XS"), (500, "XS"), (20001, "XXL"), (-3, "XXS")])
def test_size_classes(spark, cm2, want):
    assert spark.createDataFrame([(cm2,)], "c long").select(classes.size_class(F.col("c"))).first()[0] == want


def test_class_index_and_text(spark):
    row = spark.range(1).select(classes.class_index(F.lit("xl"), classes.SIZE_NAMES), classes.class_index(F.lit("?!"), classes.SIZE_NAMES), text.id_letters(F.lit(3)), text.id_letters(F.lit(27)), text.duration(F.lit(75.9)), text.location(F.lit(1.4), F.lit(-2.6)), text.input_kind(F.lit("a\\b.MP4\\"))).first()
    assert list(row) == [5, -1, "C", "AA", "1m15s", "1,-3", "video"]


def test_scores(spark):
    one = spark.range(1)
    sig = lambda hot, n, h, cfg=CFG, d=0.5: one.select(score.significant(F.lit(hot), F.lit(0), F.lit(d), score.duration_units(F.lit(n), cfg), F.lit(h).cast("double"), cfg)).first()[0]
    assert sig(10, 20, None) and not sig(2, 20, 9.0) and not sig(10, 10, 9.0) and not sig(1001, 20, 9.0) and not sig(10, 20, 9.0, d=0.05)
    assert sig(3, 20, 2.5) and not sig(3, 20, 2.0) and sig(3, 1, None, replace(CFG, input_is_images=True))
    assert one.select(score.density(F.lit(10), F.lit(0), F.lit(5))).first()[0] == 0.0
    assert one.select(score.attributes(F.lit(True), F.lit(10), F.lit(0), F.lit(2.5), F.lit(3.0), CFG)).first()[0] == "Sig P3 T2 E2"


def test_rectangles(spark):
    r = rect.Rect(*(F.lit(v) for v in (0, 0, 10, 10)))
    s = rect.Rect(*(F.lit(v) for v in (8, 8, 4, 4)))
    row = spark.range(1).select(r.overlap_area(s), r.matches(s, 5), r.contains(s), r.contains(rect.Rect(*(F.lit(v) for v in (2, 2, 8, 8)))), r.spine(), *r.union(s, 1), *s.inflate(5), *s.inside(10, 10)).first()
    assert list(row) == [4, True, False, True, pytest.approx(math.sqrt(200)), 0, 0, 13, 13, 3, 3, 14, 14, 6, 6, 4, 4]


def test_camera_straight_down_and_east(spark):
    centre = (F.lit(geo.CENTRE_X), F.lit(geo.CENTRE_Y))
    e, u, n = geo.to_world(geo.camera_ray(*centre), F.lit(90.0), F.lit(123.0))
    hit = geo.flat_hit(F.lit(5.0), F.lit(7.0), F.lit(60.0), (e, u, n), F.lit(0.0))
    a, b = spark.range(1).select(*hit).first()
    assert abs(a - 5) < 1e-9 and abs(b - 7) < 1e-9
    e, u, n = spark.range(1).select(*geo.to_world(geo.camera_ray(*centre), F.lit(45.0), F.lit(90.0))).first()
    assert e == pytest.approx(math.sqrt(0.5)) and u == pytest.approx(-math.sqrt(0.5)) and abs(n) < 1e-9
    up = geo.flat_hit(F.lit(0.0), F.lit(0.0), F.lit(60.0), (F.lit(0.0), F.lit(0.1), F.lit(1.0)), F.lit(0.0))
    assert list(spark.range(1).select(*up).first()) == [None, None]


def test_raycast_against_a_march(spark):
    rng = random.Random(1)
    dem = {(n, e): 5 + ((n * 7 + e * 13) % 25) / 5 for n in range(120) for e in range(120)}
    rays = [(i, rng.uniform(20, 100), rng.uniform(20, 100), rng.uniform(20, 60), rng.uniform(-0.5, 0.5), rng.uniform(-0.95, -0.3), rng.uniform(-0.5, 0.5)) for i in range(60)]
    want = {}
    for i, n, e, a, dn, du, de in rays:
        for k in range(1000):
            g = dem.get((math.floor(n + dn * k), math.floor(e + de * k)))
            if g is not None and a + du * k <= g:
                want[i] = k
                break
    d = spark.createDataFrame([(n, e, v) for (n, e), v in dem.items()], "n_cell int, e_cell int, elev_m double")
    r = spark.createDataFrame(rays, "id long, north double, east double, altitude double, d_n double, d_up double, d_e double")
    assert {x["id"]: x["step"] for x in spatial.raycast(r, d, "id").collect()} == want
    back = {x["id"]: x["hit_up"] for x in spatial.raycast(r, d, "id", interpolate=True).collect()}
    assert set(back) == set(want)


def test_triangulation_of_exact_and_parallel_rays(spark):
    rays = [(1, 0.0, 0.0, 60.0, 10.0, 20.0, -58.0), (1, 30.0, 5.0, 61.0, -20.0, 15.0, -59.0), (2, 0.0, 0.0, 9.0, 1.0, 0.0, 0.0), (2, 0.0, 5.0, 9.0, 1.0, 0.0, 0.0)]
    got = {r["object_id"]: r for r in spatial.triangulate(spark.createDataFrame(rays, "object_id long, c_e double, c_n double, c_a double, d_e double, d_n double, d_a double")).collect()}
    assert [got[1][c] for c in ("east", "north", "up")] == [pytest.approx(v) for v in (10, 20, 2)] and got[2]["east"] is None


def frame(points, w=40, h=40, heat=255):
    out = np.zeros((h, w), np.int32)
    for y, x in points:
        out[y, x] = heat
    return out


def test_comb_cases():
    one = pixels.comb_scan(frame([(5, 5)]), CFG)
    assert [(f["box_x"], f["box_y"], f["box_w"], f["box_h"], f["num_hot"], f["significant"]) for f in one] == [(5, 5, 3, 1, 1, False)]
    plus = [(y, 10) for y in range(7, 14)] + [(10, x) for x in range(7, 14)]
    got = pixels.comb_scan(frame(plus), CFG)
    assert len(got) == 1 and got[0]["num_hot"] >= 12
    cfg = replace(CFG, exclude_width=10, exclude_height=10)
    assert pixels.comb_scan(frame([(35, 35), (36, 36)]), cfg) == []
    assert pixels.comb_scan(frame([]), CFG) == [] and len(pixels.comb_scan(frame([(39, 39), (0, 39)]), CFG)) == 2


def test_components_and_containment():
    y, x = np.array([0, 1, 5, 5]), np.array([0, 1, 5, 7])
    assert pixels.components(y, x).tolist() == [0, 0, 1, 2]
    assert pixels.merge_contained([(0, 0, 10, 10), (2, 2, 3, 3), (9, 9, 12, 12)]) == [0, 0, 2]


def test_threshold_ring_with_a_dot(spark):
    ring = [(0, y, x, 250) for y in range(7) for x in range(7) if y in (0, 6) or x in (0, 6)] + [(0, 3, 3, 255)]
    p = spark.createDataFrame(ring, "block_id long, y long, x long, heat int")
    assert pixels.threshold_clusters(p, CFG, merge=False).select("cluster").distinct().count() == 2
    f = pixels.cluster_features(pixels.threshold_clusters(p, CFG), CFG).collect()
    assert len(f) == 1 and f[0]["num_hot"] == 25 and f[0]["num_max_heat"] == 1 and f[0]["sum_hot"] == 24 * 50 + 55


def test_frames_blur_enhance(spark):
    data = frame([(5, 5), (5, 6)]).astype(np.uint8)
    df = spark.createDataFrame([(1, 7, 0, 40, 40, bytearray(data.tobytes()))], schema.FRAME)
    assert [(r["block_id"], r["num_hot"]) for r in pixels.frame_features(df, CFG).collect()] == [(7, 2)]
    assert pixels.blur3(np.full((4, 4), 9, np.uint8)).tolist() == np.full((4, 4), 9).tolist()
    assert pixels.enhance(np.arange(100, dtype=np.uint8).reshape(10, 10)).max() == 255


def test_interpolation_cases(spark):
    steps = spark.createDataFrame([(1, 1, 100, 0.0, 0.0, 10.0, None, 0.0, 1.0), (1, 2, 200, 10.0, 20.0, 20.0, 90.0, 5.0, 1.0)], "flight_id long, step_id long, ms long, northing_m double, easting_m double, altitude_m double, yaw_deg double, pitch_deg double, dem_m double")
    blocks = spark.createDataFrame([(1, 1, 50), (1, 2, 100), (1, 3, 150), (1, 4, 175), (1, 5, 900)], "flight_id long, block_id long, ms long")
    got = {r["block_id"]: r for r in telemetry.interpolate(telemetry.as_of(blocks, steps)).collect()}
    assert got[1]["before_step_id"] is None and got[1]["northing_m"] is None
    assert got[2]["northing_m"] == 0.0 and got[3]["northing_m"] == 5.0 and got[3]["yaw_deg"] == 90.0
    assert [got[i]["closest_step_id"] for i in (2, 3, 4, 5)] == [1, 1, 2, 2] and got[5]["easting_m"] == 20.0


def test_bursts_break_after_eight_quiet_blocks(spark):
    rows = [(1, b, int(b in (1, 10, 20))) for b in range(1, 25)]
    got = telemetry.bursts(spark.createDataFrame(rows, "flight_id long, block_id long, num_sig int")).orderBy("burst").collect()
    assert [(r["min_block"], r["max_block"]) for r in got] == [(1, 10), (20, 20)]


def test_annotations(spark):
    old = spark.createDataFrame([(" a1", "Goat", True, ""), ("A1", "Pig", True, ""), ("B2", "Deer", False, ""), ("C3", "", True, "")], "object_name string, category string, include boolean, notes string")
    new = spark.createDataFrame([("b2 ", "", True, ""), ("d4", "Cow", True, "")], old.schema)
    assert {r["key"]: r["category"] for r in annotations.upsert(old, new).collect()} == {"A1": "Goat", "D4": "Cow"}
    assert list(annotations.summary_text(old).first()) == [3, 1, "Goat 1, Pig 1"]


def test_exports_as_text(spark):
    points = exports.waypoints(spark.createDataFrame([(1, -36.5, 174.5, "Goat"), (2, None, 1.0, "Goat"), (3, -36.25, 174.0, "Ignore")], "object_id long, latitude double, longitude double, category string"))
    assert [r["line"] for r in exports.csv_lines(points).orderBy("object_id").collect()] == ["-36.5,174.5,100,5,TRUE,,90,,2", "-36.25,174.0,100,5,TRUE,,90,,2"]
    route = json.loads(exports.json_route(points).first()[0])
    assert [s["point"]["latitude"] for s in route["route"]["segments"]] == [-36.5, -36.25]
    assert exports.kml(points).first()[0].count("<Placemark>") == 2
    one = points.where("object_id = 1")
    assert exports.kml(one).first()[0].count("<Placemark>") == 2 and [r[1] for r in exports.csv_lines(one, full=False).collect()] == ["-36.5,174.5,100,5"]


def test_scope_and_views(spark):
    df = spark.createDataFrame([(0, 100), (90, 110), (100, 100), (200, 300)], "a long, b long")
    inside = [r[0] for r in df.select(objects.in_run_scope(F.col("a"), F.col("b"), F.lit(50), F.lit(150))).collect()]
    assert inside == [True, True, False, False]
    f = spark.createDataFrame([(1, 1, 0, 5, 9, 9), (1, 2, 10, 10, 9, 9), (1, 3, 11, 30, 9, 9), (1, 4, 12, 12, 9, 9)], "object_id long, feature_id long, box_x long, box_y long, box_w long, box_h long")
    assert [r["feature_id"] for r in spatial.distinct_views(f).orderBy("feature_id").collect()] == [2, 4]


def test_silhouette_against_plain_loops(spark):
    rng = np.random.default_rng(0)
    v, lab = rng.normal(size=(40, 3)), [0] * 15 + [1] * 24 + [2]
    pts = spark.createDataFrame([(i, [float(x) for x in v[i]], lab[i]) for i in range(40)], "k long, v array<double>, l int")
    got = {r["k"]: r["silhouette"] for r in clusters.silhouette(pts, "k", "v", "l").collect()}
    for i in range(40):
        d = {c: [np.linalg.norm(v[i] - v[j]) for j in range(40) if lab[j] == c and j != i] for c in (0, 1, 2)}
        a = np.mean(d[lab[i]]) if d[lab[i]] else 0.0
        b = min(np.mean(x) for c, x in d.items() if c != lab[i])
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_silhouette_copies_no_points(spark, monkeypatch):
    """Far off the origin, with copies and a cluster of copies: as by plain loops over several blocks and parts; blocks meet without being
    spread (no Generate) or dealt by pair."""
    monkeypatch.setattr(clusters, "RIGHT_BYTES", 1000)
    rng = np.random.default_rng(1)
    v, lab = rng.normal(size=(90, 4)) + 1000.0, [0] * 30 + [1] * 50 + [2] * 10
    v[40:45], v[5], v[80:] = v[39], v[50], v[80]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], lab[i]) for i in range(90)], "k long, v array<double>, l int")
    done = clusters.silhouette(df, "k", "v", "l", 20)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    got = {r["k"]: r["silhouette"] for r in done.collect()}
    for i in range(90):
        d = {c: np.mean([np.linalg.norm(v[i] - v[j]) for j in range(90) if lab[j] == c and j != i]) for c in (0, 1, 2)}
        a, b = d[lab[i]], min(x for c, x in d.items() if c != lab[i])
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def test_choose_k_and_adjust(spark):
    pts = [(float(x + dx), float(x + dy)) for x in (0, 50, 100) for dx in range(3) for dy in range(3)]
    k, done = clusters.choose_k(spark.createDataFrame(pts, "x double, y double"), ["x", "y"], 5)
    assert k == 3 and done.select("cluster").distinct().count() == 3
    rows = [(1, 1, 1, 0.0, 0.0, 1.0), (1, 2, 1, 1.0, 5.0, 2.0), (1, 3, 1, 90.0, 6.0, 3.0), (1, 4, 2, 88.0, 0.0, 2.0)]
    out = {r["feature"]: r["cluster"] for r in clusters.adjust(spark.createDataFrame(rows, "leg_id long, feature long, cluster long, x double, y double, time double"), CFG, 0.5).collect()}
    assert out == {1: 1, 2: 1, 3: 2, 4: 2}


def test_overlap_counts_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(b), i, int(x), int(y), int(w), int(h)) for i, (b, x, y, w, h) in enumerate(zip(*(rng.integers(lo, hi, 600) for lo, hi in ((1, 4), (-20, 140), (-70, 140), (1, 30), (1, 70)))))]
    rows += [(b, 1000 + i, x, y, w, h) for i, (b, _, x, y, w, h) in enumerate(rows[:200])] + [(9, 1, 0, 0, 5, 5), (9, 2, 5, 0, 5, 5), (8, 1, 0, 0, 5, None)]
    for perc in (5, 60):
        want = {}
        for i, (b, _, x, y, w, h) in enumerate(rows[:-1]):
            for c, _, x2, y2, w2, h2 in rows[i + 1 : -1]:
                both = max(min(x + w, x2 + w2) - max(x, x2), 0) * max(min(y + h, y2 + h2) - max(y, y2), 0)
                if b == c and both and both * 100 >= min(w * h, w2 * h2) * perc:
                    n, area = want.get(b, (0, 0))
                    want[b] = n + 1, area + both
        df = spark.createDataFrame(rows, "block_id int, feature_id long, box_x long, box_y long, box_w long, box_h long")
        assert {r["block_id"]: (r["n"], r["area"]) for r in spatial.overlap_counts(df, perc).collect()} == want


def test_overlap_counts_of_many_copies(spark):
    """A million copies each of two boxes: 2 * 10^12 pairs are counted, not made."""
    df = spark.range(2000000).selectExpr("1 as block_id", "id as feature_id", "id % 2 as box_x", "3L as box_y", "4L as box_w", "5L as box_h")
    m = 1000000
    assert [tuple(r) for r in spatial.overlap_counts(df, 5).collect()] == [(1, m * (m - 1) + m * m, m * (m - 1) * 20 + m * m * 15)]


def test_rays_over_a_held_grid_are_not_moved(spark, monkeypatch):
    """As by joining steps to the grid, holes and edges included, without an exchange; a grid too large to hold, or with a cell twice, is joined."""
    from embertrail.operators import sight

    rng = np.random.default_rng(5)
    dem = spark.createDataFrame([(n, e, 5 + ((n * 7 + e * 13) % 25) / 5) for n in range(-3, 60) for e in range(60) if (n + e) % 7], "n_cell int, e_cell int, elev_m double")
    rows = [(i, 9 * i % 600, 11 * i % 480, 20, 20, float(rng.uniform(-9, 70)), float(rng.uniform(-9, 70)), float(rng.uniform(8, 80)), i * 7 % 360, i * 3 % 90, i % 40) for i in range(400)]
    f = spark.createDataFrame(rows, "feature_id long, box_x int, box_y int, box_w int, box_h int, drone_n double, drone_e double, altitude_m double, yaw_deg int, camera_to_vertical_deg int, distance_down_m int")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    held, cast = sight.line_of_sight(f, dem), spatial.raycast(sight.rays(f), dem, "_ray")
    assert "Exchange" not in plan(held) and "Exchange" not in plan(cast) and plan(cast).count("ArrowEvalPython") == 1
    monkeypatch.setattr(spatial, "HELD_CELLS", 100)
    joined, steps = sight.line_of_sight(f, dem), spatial.raycast(sight.rays(f), dem, "_ray")
    assert "Exchange" in plan(joined)
    tell = lambda df, c: {r[0]: tuple(round(x, 9) if isinstance(x, float) else x for x in r[1:]) for r in df.select(*c).collect()}
    c = ["feature_id", "height_algorithm", "northing_m", "easting_m", "height_m", "confidence"]
    got = tell(held, c)
    assert got == tell(joined, c) and sum(v[0] == "LOS" for v in got.values()) > 50 and sum(v[0] == "NoResult" for v in got.values()) > 20
    c = ["_ray", "step", "hit_n", "hit_e", "hit_up"]
    assert tell(cast, c) == tell(steps, c)
    monkeypatch.undo()
    assert spatial.held_grid(dem.union(dem.limit(1))) is None and spatial.held_grid(dem.limit(0)) is None


def test_adjust_against_the_plain_loop():
    """Many orphans and clusters: the same rows join the same clusters as by looking at all centres each time, in a time the plain loop
    needs for a small part of them."""
    import time as clock

    def plain(x, y, t, cluster, loose):
        stats = {}

        def add(r, c):
            s = stats.setdefault(c, [0, 0.0, 0.0, -np.inf, -np.inf])
            s[:] = s[0] + 1, s[1] + x[r], s[2] + y[r], max(s[3], y[r]), max(s[4], t[r])

        for r in sorted(set(range(len(x))) - set(loose)):
            add(r, cluster[r])
        out, moved = [], True
        while loose and moved:
            moved, rest = False, []
            for r in loose:
                c = min(stats, key=lambda c: ((x[r] - stats[c][1] / stats[c][0]) ** 2 + (y[r] - stats[c][2] / stats[c][0]) ** 2, c))
                n, sx, _, top, late = stats[c]
                if abs(y[r] - top) <= 24.5 and y[r] - top >= -0.5 and abs(x[r] - sx / n) <= 10 and t[r] - late <= 5:
                    out.append((r, c))
                    add(r, c)
                    moved = True
                else:
                    rest.append(r)
            loose = rest
        return out

    def case(n, k, seed):
        rng = np.random.default_rng(seed)
        x, y, t = rng.integers(0, 15, n).astype(float), rng.integers(0, 100, n) / 2 + rng.integers(0, 2, n) * 40, rng.integers(0, 30, n).astype(float)
        return x, y, t, rng.integers(0, k, n), [int(r) for r in rng.permutation(np.arange(k, n))[: n * 3 // 4]]

    moved = 0
    for seed in range(20):
        x, y, t, c, loose = case(300, 12, seed)
        want = plain(x, y, t, c, loose)
        moved += len(want)
        assert clusters._joined(x, y, t, c, np.array(loose), CFG, 0.5) == [(r, int(k)) for r, k in want]
    assert moved > 100
    x, y, t, c, loose = case(12000, 1000, 1)
    began = clock.time()
    clusters._joined(x, y, t, c, np.array(loose), CFG, 0.5)
    assert clock.time() - began < 8  # the plain loop looks at 9 million centres each time round, at about a microsecond each


def test_mean_places_do_not_depend_on_the_order_of_rows(spark):
    """A mean of 40 stays in cell 40 in any order: plain sums of these tenths come out below."""
    for v in ([72.1, 63.8, 52.2, 3.9, 38.8, 9.2], sorted([72.1, 63.8, 52.2, 3.9, 38.8, 9.2])):
        f = spark.createDataFrame([(1, i, "Real", x, x, 2.0) for i, x in enumerate(v)], "object_id long, feature_id long, type string, northing_m double, easting_m double, height_m double").coalesce(1)
        assert list(objects.locations(f).select("loc_n", "loc_e").first()) == [40.0, 40.0]
    odd = spark.createDataFrame([(1, 1, "Real", math.inf, 1.0, 2.0), (1, 2, "Real", 1.0, None, 2.0)], "object_id long, feature_id long, type string, northing_m double, easting_m double, height_m double")
    assert list(objects.locations(odd).select("loc_n", "loc_e").first()) == [math.inf, 1.0]


def test_no_rows_break_what_always_holds(spark):
    """Features hold their pixels, time runs forward, weights lie in 0..1, and no step joined as before lies after."""
    from embertrail.plans import q_space, q_telemetry
    from embertrail.operators import telemetry as te

    sf = "/root/testdata/sf0.001"
    t = q_space._tracked(spark, sf).where("kind = 'Real' and object_no is not null")
    assert t.groupBy("leg_id", "block_id", "object_no").count().where("count > 1").count() == 0
    assert q_space._features(spark, sf).where("num_hot > box_w * box_h").count() == 0
    assert te.deltas(q_telemetry._placed(spark, sf)).where("time_ms <= 0").count() == 0
    assert q_telemetry._placed(spark, sf).where("weight < 0 or weight > 1").count() == 0
    assert q_telemetry._joined(spark, sf).where("before_ms > ms").count() == 0


def test_rays_past_the_edge_or_a_hole_of_the_grid(spark):
    """A ray that is below the lowest ground over no cell goes on, and hits where a cell comes."""
    from embertrail.operators import spatial

    rays = spark.createDataFrame([(1, -20.0, 0.5, 10.0, 0.8, -0.6, 0.0), (2, 0.5, 0.5, 10.0, 0.0, -1.0, 0.0)], "k long, north double, east double, altitude double, d_n double, d_up double, d_e double")
    dem = spark.createDataFrame([(n, 0, 5.0) for n in range(0, 30)], "n_cell int, e_cell int, elev_m double")
    got = {r["k"]: r["step"] for r in spatial.raycast(rays, dem, "k").collect()}
    assert got == {1: 25, 2: 5}


def test_significant_blocks_counts_only_while_significant(spark):
    """Dense and long enough from the second feature on; at the fourth the box grows and the object is significant no more."""
    cfg = replace(CFG, fps=4.0, object_min_pixels=2, object_min_hot_density=0.5)
    boxes = [(4, 4), (4, 4), (4, 4), (40, 40)]
    rows = [(1, i, "Real", 12, w, h, 3.0) for i, (w, h) in enumerate(boxes)] + [(1, 9, "Unreal", 0, 4, 4, None), (2, 20, "Unreal", 50, 4, 4, 3.0)]
    got = objects.significant_blocks(spark.createDataFrame(rows, "object_id long, feature_id long, type string, num_hot int, box_w int, box_h int, height_m double"), cfg)
    assert {r["object_id"]: r["num_significant_blocks"] for r in got.collect()} == {1: 2, 2: 0}
    ever = got.withColumn("units", F.lit(1.0)).withColumn("ever", objects.ever_significant())
    assert {r["object_id"]: r["ever"] for r in ever.collect()} == {1: True, 2: False}


def test_stored_objects(spark, tmp_path):
    rows = spark.createDataFrame([(7, "C1")], "object_id long, name string").select(*[F.col(f.name) if f.name in ("object_id", "name") else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.OBJECT.fields])
    tables.write(rows, str(tmp_path / "o"))
    got = tables.read(spark, str(tmp_path / "o"), "object")
    assert got.schema == schema.OBJECT and got.first()["name"] == "C1"


def test_swathe_and_density(spark):
    from embertrail.operators import legs

    drone = spark.createDataFrame([(1, 0.5, 0.5), (1, 0.6, 0.7), (1, 0.5, 1.5), (2, None, 3.0)], "leg_id int, drone_n double, drone_e double")
    seen = legs.swathe(drone, 1)
    assert seen.count() == 12 and seen.where("leg_id = 2").count() == 0
    objs = spark.createDataFrame([(1, True), (1, True), (1, False), (2, True)], "leg_id int, significant boolean")
    assert {r["leg_id"]: (r["animals"], r["density"]) for r in legs.key_results(objs, seen).collect()} == {1: (2, pytest.approx(2 / 12e-6)), 2: (1, 0.0)}


def test_line_of_sight_over_level_ground(spark):
    """Straight down the middle of the image is below the drone: the step after 50.5 m is half a metre deep, and the refined distance runs on
    by as much, so the hit is a metre below ground. Without a view nothing is set; off the grid there is no result."""
    from embertrail.operators import sight

    dem = spark.range(0, 40).selectExpr("cast(id as int) as n_cell").crossJoin(spark.range(0, 40).selectExpr("cast(id as int) as e_cell")).withColumn("elev_m", F.lit(10.0))
    rows = [(1, 310, 246, 20, 20, 20.0, 20.0, 60.5, 0.0, 0.0, 50.0), (2, 310, 246, 20, 20, 20.0, 20.0, 60.0, 0.0, 80.0, 50.0), (3, 310, 246, 20, 20, 20.0, 20.0, 60.0, 0.0, 0.0, 5.0),
            (4, 310, 246, 20, 20, 900.0, 20.0, 60.0, 0.0, 0.0, 50.0), (5, 310, 246, 20, 20, None, 20.0, 60.0, 0.0, 0.0, 50.0)]
    f = spark.createDataFrame(rows, "feature_id long, box_x int, box_y int, box_w int, box_h int, drone_n double, drone_e double, altitude_m double, yaw_deg double, camera_to_vertical_deg double, distance_down_m double")
    got = {r["feature_id"]: r for r in sight.line_of_sight(f, dem).collect()}
    assert [got[i]["height_algorithm"] for i in range(1, 6)] == ["LOS", None, None, "NoResult", None]
    assert (got[1]["northing_m"], got[1]["easting_m"], got[1]["height_m"]) == pytest.approx((20.0, 20.0, -1.0), abs=1e-6) and 0.9 < got[1]["confidence"] < 1
    assert got[4]["confidence"] == 0.0 and got[4]["northing_m"] is None
