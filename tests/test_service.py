import numpy as np
import pytest
from pyspark.sql import functions as F

from embertrail import schema
from embertrail.config import Config
from embertrail.operators import frames as fr
from embertrail.service import Engine, InvalidInput, in_leg


def film(spark, n=12):
    rows = []
    for b in range(1, n + 1):
        grey = np.zeros((60, 80), np.uint8)
        grey[10 + 2 * b : 14 + 2 * b, 20:24] = 250
        rows.append((1, b, b * 33, 60, 80, bytearray(grey.tobytes())))
    return spark.createDataFrame(rows, schema.FRAME)


@pytest.mark.parametrize("algorithm", ["Comb", "Threshold"])
def test_film_to_one_object(spark, algorithm):
    seen = []
    engine = Engine(Config(), algorithm, [lambda event, detail: seen.append(event)])
    tracked, objs = engine.process(film(spark))
    got = objs.orderBy("n_real").collect()
    assert got[-1]["n_real"] == 12 and got[-1]["max_hot"] >= 16 and seen == ["run_start"]
    assert tracked.where("kind = 'Real'").count() >= 12 and in_leg(objs, 1).count() == len(got) and in_leg(objs, 2).count() == 0


def test_legs_select_blocks(spark):
    legs = spark.createDataFrame([(1, b, 1 if b <= 6 else 0) for b in range(1, 13)], "flight_id long, block_id int, leg_id int")
    _, objs = Engine().process(film(spark), legs)
    assert objs.agg(F.max("last_block")).first()[0] <= 6


def test_bad_options(spark):
    with pytest.raises(InvalidInput):
        Engine(algorithm="Guess")
    with pytest.raises(InvalidInput):
        Engine().process(None)
    seen = []
    with pytest.raises(InvalidInput):
        Engine(algorithm="Yolo", hooks=[lambda e, d: seen.append(e)]).process(film(spark, 1))
    assert seen == ["run_start", "error"]


def test_preview():
    assert Engine(algorithm="Comb").preview(10) == (18, 4.0) and Engine(algorithm="Threshold").preview(1) == (1, 0.5)


def test_union_of_features_with_a_doubled_id(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "feature_id long, t string")
    assert fr.union_features(a.where("feature_id = 1"), a.where("feature_id = 2")).count() == 2
    with pytest.raises(Exception, match="twice"):
        fr.union_features(a, a).collect()


def test_altitude_fix_needs_a_gain(spark):
    rows = [(1, 2, 5.0), (1, 1, 4.95), (1, 0, 4.0), (1, -1, 4.0)]
    got = fr.altitude_fix(spark.createDataFrame(rows, "span long, fix_m int, sum_err double")).first()
    assert (got["fix_m"], got["sum_err"]) == (0.0, 4.0)


def test_run_tells_all_events_and_keeps_features_outside_legs(spark, tmp_path):
    seen = []
    legs = spark.createDataFrame([(1, b, 1 if b <= 6 else 0) for b in range(1, 11)], "flight_id long, block_id int, leg_id int")
    engine = Engine(Config(object_min_duration_ms=100), "Comb", [lambda event, detail: seen.append((event, detail))])
    tracked, objs = engine.run(film(spark), str(tmp_path), legs, [(0, 10_000)])
    assert [e for e, _ in seen] == ["run_start", "interval_start", "leg_start", "block", "leg_end", "interval_end", "run_end"]
    assert dict(seen)["block"] == 6 and dict(seen)["leg_end"] == (objs.count(), objs.where("significant").count())
    outside = tracked.where("leg_id = 0")
    assert outside.where("object_no is not null").count() == 0 and {r[0] for r in outside.select("block_id").distinct().collect()} == set(range(7, 13))
    assert in_leg(objs, 1, significant=True).count() == objs.where("significant").count() == 1


def test_all_exports_are_written(spark, tmp_path):
    from embertrail.operators import exports

    rows = [(1, -36.8, 174.7, "Goat"), (2, -36.9, 174.8, ""), (3, None, None, "Goat")]
    folders = exports.export_all(spark.createDataFrame(rows, "object_id long, latitude double, longitude double, category string"), str(tmp_path))
    text = ["\n".join(r[0] for r in spark.read.text(f).collect()) for f in folders]
    assert len(folders) == 6 and text[0].startswith("LATITUDE,LONGITUDE,") and text[0].count("\n") == 2 and text[3].count("\n") == 1
    assert text[1].count("Waypoint") == 2 and text[2].count("<Placemark>") == 2 and text[5].count("<Placemark>") == 2  # a single one twice


def test_settings_from_json(spark, tmp_path):
    from embertrail.sources import tables

    (tmp_path / "s.json").write_text('{\n"heat_threshold": 210, "unknown": 1}')
    assert tables.read_settings(spark, str(tmp_path / "s.json")).heat_threshold == 210


def test_describe():
    from embertrail.service import describe

    assert describe(Config(), None) == "Process: None\r\n"
    lines = describe(Config(heat_threshold=210), "Yolo", "Fast", True, "All").split("\r\n")
    assert lines == ["Process: Yolo", "Speed: Fast", "Heat threshold: 210", "Confidence: 0.1, IoU: 0.25", "Save annotated video.", "Save all objects.", ""]
    assert "Confidence" not in describe(Config(), "Comb")
