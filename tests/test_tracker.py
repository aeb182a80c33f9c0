"""The tracker on hand-made flights, and stream against batch."""

import pandas as pd
import pytest

from embertrail.config import Config
from embertrail.operators import tracker
from embertrail.streaming.tracker_stream import track_stream

CFG = Config()


def feature(block, n, x, y, w=10, h=10, hot=20):
    return {"flight_id": 1, "leg_id": 1, "block_id": block, "n": n, "box_x": x, "box_y": y, "box_w": w, "box_h": h, "num_hot": hot, "sum_hot": hot * 5, "significant": hot >= 8}


def run(rows, cfg=CFG):
    return tracker.run_blocks(pd.DataFrame(rows), cfg)


def test_steady_drift_is_one_object():
    out = run([feature(b, 1, 100, 50 + 5 * b) for b in range(1, 21)])
    assert out["object_no"].nunique() == 1 and (out["kind"] == "Real").all() and len(out) == 20


def test_gap_is_bridged_by_unreal_features_only():
    out = run([feature(b, 1, 100, 50 + 5 * b) for b in range(1, 21) if not 8 <= b <= 10])
    assert (out[out.block_id.between(8, 10)]["kind"] == "Unreal").all()
    assert out["object_no"].nunique() == 2  # an object that ends unreal and has many real ones is not met again
    short = [feature(b, 1, 100, 50 + 5 * b) for b in range(1, 21) if b != 8]
    assert run(short)["object_no"].nunique() == 2 and run(short, Config(reacquire_unreal=True))["object_no"].nunique() == 1


def test_persistence_ends():
    out = run([feature(1, 1, 100, 100), *[feature(b, 1, 400, 300) for b in range(1, 12)]])
    unreal = out[(out.kind == "Unreal")]
    assert unreal.block_id.max() == 6 and len(unreal) == 5


def test_split_is_consumed():
    out = run([feature(1, 1, 100, 100, 30, 10), feature(2, 1, 100, 100, 12, 10), feature(2, 2, 118, 100, 12, 10)])
    two = out[out.block_id == 2]
    assert list(two["kind"]) == ["Real", "Consumed"]
    assert list(two.iloc[0][["box_x", "box_w", "box_h", "num_hot"]]) == [100, 31, 11, 40]


def test_oversized_is_refused_and_small_not_started():
    out = run([feature(1, 1, 100, 100), feature(2, 1, 95, 100, 101, 10), feature(1, 2, 300, 300, hot=3)])
    assert out[out.block_id == 1]["object_no"].isna().tolist() == [False, True]
    assert out[(out.block_id == 2) & (out.kind == "Real")]["object_no"].iloc[0] == 2


def test_young_objects_look_lower():
    out = run([feature(1, 1, 100, 100), feature(2, 1, 100, 132)])
    assert out["object_no"].nunique() == 1


def test_a_feature_has_one_owner():
    import random

    r = random.Random(0)
    out = run([feature(b, n, r.randint(0, 300), r.randint(0, 300), r.randint(5, 40), r.randint(5, 40)) for b in range(1, 40) for n in range(1, 12)])
    real = out[(out.kind == "Real") & out.object_no.notna()]
    assert not real.duplicated(["block_id", "object_no"]).any()
    assert len(out[out.kind != "Unreal"]) == 39 * 11


@pytest.fixture(scope="module")
def rows():
    import random

    r = random.Random(5)
    return [feature(b, n, 40 * n + b % 7, 20 * n + 4 * b + r.randint(-2, 2)) | {"flight_id": f} for f in (1, 2) for b in range(1, 25) for n in range(1, 5) if r.random() > 0.15]


def test_batch_groups_by_flight_and_leg(spark, rows):
    df = spark.createDataFrame(pd.DataFrame(rows))
    got = tracker.track(df, CFG).toPandas()
    for f in (1, 2):
        want = run([x for x in rows if x["flight_id"] == f])
        mine = got[got.flight_id == f].sort_values(["block_id", "n"])
        assert mine["object_no"].astype("Int64").tolist() == want.sort_values(["block_id", "n"])["object_no"].tolist()


def test_stream_gives_the_batch_result(spark, rows, tmp_path):
    df = pd.DataFrame(rows)
    src = tmp_path / "in"
    schema = spark.createDataFrame(df).schema
    for i, (a, b) in enumerate(((1, 8), (9, 16), (17, 24))):
        spark.createDataFrame(df[df.block_id.between(a, b)], schema).coalesce(1).write.parquet(str(src / f"p{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    q = track_stream(stream, CFG).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("tracked").toPandas()
    want = pd.concat([run([x for x in rows if x["flight_id"] == f]).assign(flight_id=f) for f in (1, 2)])
    key = ["flight_id", "block_id", "n"]
    a, b = (x.sort_values(key)[[*key, "object_no", "kind", "box_y"]].astype(str).values.tolist() for x in (got.astype({"object_no": "Int64"}), want))
    assert a == b


def test_state_survives_json():
    import json

    s = tracker.State()
    tracker.step(s, tracker.features_of(pd.DataFrame([feature(1, 1, 5, 5)])), 1, CFG)
    assert tracker.State.load(json.loads(json.dumps(s.dump()))).dump() == s.dump()
