"""Tracking features over blocks into objects: one ordered state machine, used by batch, streaming and tests alike.

State is per flight and leg. In each block, objects last seen in the block before first claim the features their expected box overlaps,
in order of id; objects with at most two real features then look lower in the image; unclaimed tracked features start objects; objects
without a feature persist for some blocks with unreal ones."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from embertrail.config import Config
from embertrail.functions.runtime import ready

Box = tuple[int, int, int, int]


@dataclass
class Tracked:
    object_id: int
    first_block: int
    first_box: Box
    last_block: int
    last_box: Box
    last_type: str = "Real"
    last_real_block: int = 0
    n_real: int = 0
    n_features: int = 0
    max_hot: int = 0
    max_sum_hot: int = 0
    max_heat_px: int = 0
    max_w: int = 0
    max_h: int = 0
    last_oversized: bool = False
    tracked: bool = True


@dataclass
class State:
    next_id: int = 1
    live: list[Tracked] = field(default_factory=list)

    def dump(self) -> dict:
        return {"next_id": self.next_id, "live": [asdict(o) for o in self.live]}

    @classmethod
    def load(cls, data: dict) -> State:
        tup = lambda o: o | {"first_box": tuple(o["first_box"]), "last_box": tuple(o["last_box"])}
        return cls(data["next_id"], [Tracked(**tup(o)) for o in data["live"]])


def expected_box(o: Tracked) -> Box:
    """One average stride on from the last box, with the largest size seen and double height; 5 pixels more around a real last feature."""
    x, y, w, h = o.last_box
    moves = o.last_block - o.first_block
    if moves >= 1:
        x, y, w, h = (int(x + (x - o.first_box[0]) / moves - (o.max_w - w) / 2), int(y + (y - o.first_box[1]) / moves - (o.max_h - h) / 2), o.max_w, o.max_h * 2)
    grow = 5 if o.last_type == "Real" else 0
    return x - grow, y - grow, w + 2 * grow, h + 2 * grow


def overlaps(a: Box, b: Box, perc: int) -> bool:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = 100 * max(0, w) * max(0, h)
    return (a[2] * a[3] > 0 and both >= perc * a[2] * a[3]) or (b[2] * b[3] > 0 and both >= perc * b[2] * b[3])


def _vaguely(o: Tracked, cfg: Config) -> bool:
    return (cfg.object_min_pixels <= 0 or o.max_hot >= cfg.object_min_pixels) and (cfg.object_max_pixels <= 0 or o.max_hot <= cfg.object_max_pixels)


def _oversized(box: Box, cfg: Config) -> bool:
    return box[2] > cfg.feature_max_size or box[3] > cfg.feature_max_size


def _claim(o: Tracked, f: dict, block: int, cfg: Config) -> bool:
    """Gives a real feature to an object, or refuses. A second one in a block is consumed by the first."""
    if o.n_features and (_oversized(f["box"], cfg) or o.last_oversized):
        return False
    o.max_hot, o.max_sum_hot, o.max_heat_px = max(o.max_hot, f["num_hot"]), max(o.max_sum_hot, f["sum_hot"]), max(o.max_heat_px, f.get("num_max_heat", 0))
    if o.n_real == 0 or o.last_real_block < block:
        if o.n_features == 0:
            o.first_block, o.first_box = block, f["box"]
        o.last_block, o.last_real_block, o.last_box, o.last_type = block, block, f["box"], "Real"
        o.n_real, o.n_features = o.n_real + 1, o.n_features + 1
        f["object_id"], f["kind"] = o.object_id, "Real"
        o.holder = f
    else:
        a, b = o.last_box, f["box"]
        x, y = min(a[0], b[0]), min(a[1], b[1])
        o.last_box = (x, y, max(a[0] + a[2], b[0] + b[2]) - x + 1, max(a[1] + a[3], b[1] + b[3]) - y + 1)
        if o.last_block == o.first_block:
            o.first_box = o.last_box
        f["object_id"], f["kind"] = None, "Consumed"
        o.holder["box"] = o.last_box
        o.holder["num_hot"] += f["num_hot"]
        o.holder["sum_hot"] += f["sum_hot"]
    o.max_w, o.max_h = max(o.max_w, o.last_box[2]), max(o.max_h, o.last_box[3])
    o.last_oversized = _oversized(o.last_box, cfg)
    return True


def step(state: State, features: list[dict], block: int, cfg: Config) -> list[dict]:
    """Takes one block's features (dicts with box, num_hot, sum_hot, tracked; in order of discovery) and returns them with object_id and
    kind, unreal ones after. Objects that can never be met again leave the state."""
    scope = [o for o in state.live if o.last_block == block - 1 and _vaguely(o, cfg)]
    free = [f | {"object_id": None, "kind": "Real"} for f in features]
    unmatched = []
    for o in scope:
        took = False
        if o.last_type == "Real" or cfg.reacquire_unreal:
            where = expected_box(o)
            for f in free:
                if f["object_id"] is None and f["kind"] == "Real" and overlaps(f["box"], where, cfg.feature_min_overlap_perc):
                    took |= _claim(o, f, block, cfg)
        if not took:
            unmatched.append(o)
    for o in unmatched:
        if o.n_real <= 2:
            x, y, w, h = expected_box(o)
            for f in free:
                if f["object_id"] is None and f["kind"] == "Real" and overlaps(f["box"], (x, y + cfg.search_higher_pixels, w, h), cfg.feature_min_overlap_perc):
                    _claim(o, f, block, cfg)
    out = list(free)
    for o in scope:
        if o.tracked and o.last_real_block < block:
            o.tracked = not cfg.input_is_images and o.last_block - o.last_real_block < cfg.object_max_unreal_blocks
            if o.tracked:
                box = expected_box(o)
                o.last_block, o.last_box, o.last_type, o.n_features = block, box, "Unreal", o.n_features + 1
                o.last_oversized = _oversized(box, cfg)
                out.append({"box": box, "num_hot": 0, "sum_hot": 0, "num_max_heat": 0, "tracked": False, "object_id": o.object_id, "kind": "Unreal"})
    for f in free:
        if f["tracked"] and f["object_id"] is None and f["kind"] == "Real":
            o = Tracked(state.next_id, block, f["box"], block, f["box"])
            state.next_id += 1
            _claim(o, f, block, cfg)
            state.live.append(o)
    state.live = [o for o in state.live if o.last_block >= block]
    return out


COLUMNS = "block_id long, n long, object_no long, kind string, box_x long, box_y long, box_w long, box_h long, num_hot long, sum_hot long"


def rows_of(block: int, done: list[dict]) -> list[dict]:
    return [{"block_id": block, "n": i + 1, "object_no": f["object_id"], "kind": f["kind"], **{f"box_{c}": v for c, v in zip("xywh", f["box"], strict=True)}, "num_hot": f["num_hot"], "sum_hot": f["sum_hot"]} for i, f in enumerate(done)]


def features_of(pdf: pd.DataFrame) -> list[dict]:
    return [{"box": (int(r.box_x), int(r.box_y), int(r.box_w), int(r.box_h)), "num_hot": int(r.num_hot), "sum_hot": int(r.sum_hot), "num_max_heat": int(getattr(r, "num_max_heat", 0)), "tracked": bool(r.significant)} for r in pdf.sort_values("n", kind="stable").itertuples()]


def run_blocks(pdf: pd.DataFrame, cfg: Config, state: State | None = None, blocks: range | None = None) -> pd.DataFrame:
    """All blocks of one flight and leg in order; blocks without features count, as objects persist through them."""
    state, rows = state or State(), []
    by = {int(b): g for b, g in pdf.groupby("block_id")}
    for block in blocks or (range(min(by), max(by) + 1) if by else ()):
        rows += rows_of(block, step(state, features_of(by[block]) if block in by else [], block, cfg))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")]).astype({"object_no": "Int64"})


def track(features: DataFrame, cfg: Config, keys: tuple[str, ...] = ("flight_id", "leg_id")) -> DataFrame:
    """Features (keys, block_id, n, box_*, num_hot, sum_hot, significant) -> the same blocks with object numbers. One group is one leg: the
    order of its blocks is the algorithm's own, legs run side by side. Columns not needed for tracking are pruned before the shuffle."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = run_blocks(pdf, cfg)
        for i, (k, v) in enumerate(zip(keys, key, strict=True)):
            out.insert(i, k, v)
        return out

    ready(features.sparkSession)
    need = [*keys, "block_id", "n", "box_x", "box_y", "box_w", "box_h", "num_hot", "sum_hot", "significant"]
    kinds = ", ".join(f"{k} {features.schema[k].dataType.simpleString()}" for k in keys)
    return features.select(*need, *(["num_max_heat"] if "num_max_heat" in features.columns else [])).groupBy(*keys).applyInPandas(run, f"{kinds}, {COLUMNS}")
