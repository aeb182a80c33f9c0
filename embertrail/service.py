"""The public face: options in, results out, with progress and hooks; one strategy per detection algorithm."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrail.config import Config
from embertrail.functions import score
from embertrail.operators import objects, pixels, tracker

EVENTS = ("run_start", "interval_start", "leg_start", "block", "leg_end", "interval_end", "run_end", "error")
#: Fixed values of the preview: objects and minutes for a minute of video, by algorithm.
PREVIEW = {"Yolo": (2.5, 0.8), "Comb": (1.8, 0.4), "Threshold": (1.2, 0.2)}
LEAST_MINUTES = 0.5


class InvalidInput(ValueError):
    """Options that cannot be run."""


def comb(frames: DataFrame, cfg: Config) -> DataFrame:
    return pixels.frame_features(frames, cfg)


def threshold(frames: DataFrame, cfg: Config) -> DataFrame:
    """Frames to pixels to clusters. Pixels of a frame come out hot only."""
    import pandas as pd

    from embertrail.functions.runtime import ready

    def spell(batches):
        import numpy as np

        for pdf in batches:
            for r in pdf.itertuples():
                grey = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)
                y, x = np.nonzero(grey > cfg.heat_threshold)
                yield pd.DataFrame({"flight_id": r.flight_id, "block_id": r.frame_id, "y": y, "x": x, "heat": grey[y, x].astype(int)})

    ready(frames.sparkSession)
    keys = ("flight_id", "block_id")
    hot = frames.mapInPandas(spell, "flight_id long, block_id int, y int, x int, heat int")
    return pixels.cluster_features(pixels.threshold_clusters(hot, cfg, keys=keys), cfg, keys).withColumnRenamed("cluster", "n")


def yolo(frames: DataFrame, cfg: Config) -> DataFrame:
    raise InvalidInput("no detector model is configured: pass detections as features instead")


STRATEGIES: dict[str, Callable[[DataFrame, Config], DataFrame]] = {"Comb": comb, "Threshold": threshold, "Yolo": yolo}


def objects_of(tracked: DataFrame, cfg: Config) -> DataFrame:
    """Tracked features to objects: blocks, counts, largest sizes and significance."""
    real = F.col("kind") == "Real"
    objs = tracked.where("object_no is not null").groupBy("flight_id", "leg_id", "object_no").agg(F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block"), F.count_if(real).alias("n_real"), F.max(F.when(real, F.col("num_hot"))).alias("max_hot"), F.max(F.when(real, F.col("box_w"))).alias("max_w"), F.max(F.when(real, F.col("box_h"))).alias("max_h"))
    dense, units = score.density(F.col("max_hot"), F.col("max_w"), F.col("max_h")), score.duration_units(F.col("n_real"), cfg)
    return objs.withColumn("significant", score.significant(F.col("max_hot"), F.lit(0), dense, units, F.lit(None).cast("double"), cfg))


@dataclass
class Engine:
    """process(): frames to tracked features and objects. Hooks are called on the driver with (event, detail)."""

    config: Config = field(default_factory=Config)
    algorithm: str = "Comb"
    hooks: list[Callable[[str, object], None]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.algorithm not in STRATEGIES:
            raise InvalidInput(f"unknown algorithm {self.algorithm}")
        self.config = self.config.clamped()

    def tell(self, event: str, detail: object = None) -> None:
        assert event in EVENTS
        for hook in self.hooks:
            hook(event, detail)

    def process(self, frames: DataFrame, legs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """frames (flight_id, frame_id, height, width, data); legs (flight_id, block_id, leg_id), one leg if None -> tracked features and
        objects (flight, leg, object number, blocks, counts, significance). Features outside legs are kept, without an object and with leg
        0. Plans only: nothing runs until a result is read."""
        if frames is None:
            raise InvalidInput("no frames")
        self.tell("run_start")
        try:
            return self._plans(frames, legs)
        except Exception as e:
            self.tell("error", e)
            raise

    def _plans(self, frames: DataFrame, legs: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        found = STRATEGIES[self.algorithm](frames, self.config)
        placed = found.withColumn("leg_id", F.lit(1)) if legs is None else found.join(legs, ["flight_id", "block_id"], "left").withColumn("leg_id", F.greatest(F.coalesce("leg_id", F.lit(0)), F.lit(0)))
        tracked = tracker.track(placed.where("leg_id > 0"), self.config)
        if legs is not None:
            outside = placed.where("leg_id = 0").withColumns({"object_no": F.lit(None), "kind": F.lit("Real")})
            tracked = tracked.unionByName(outside.select([F.col(f.name).cast(f.dataType) for f in tracked.schema]))
        return tracked, objects_of(tracked, self.config)

    def run(self, frames: DataFrame, folder: str, legs: DataFrame | None = None, ranges: list[tuple[int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
        """Processes and writes each range of milliseconds (everything, if None) under a folder, and tells all events as they come about:
        a leg's with its counts, when its range is written. Returns what was written."""
        if frames is None:
            raise InvalidInput("no frames")
        self.tell("run_start")
        spark, written = frames.sparkSession, []
        try:
            for i, ends in enumerate(ranges or [None]):
                self.tell("interval_start", ends)
                part = frames if ends is None else frames.where(F.col("ms").between(*ends))
                paths = [f"{folder.rstrip('/')}/interval={i}/{what}" for what in ("features", "objects")]
                tracked, _ = self._plans(part, legs)
                tracked.write.mode("overwrite").parquet(paths[0])
                done = spark.read.parquet(paths[0])
                objects_of(done, self.config).write.mode("overwrite").parquet(paths[1])
                written.append(paths)
                found = spark.read.parquet(paths[1]).groupBy("flight_id", "leg_id").agg(F.count("*").alias("objects"), F.count_if("significant").alias("significant"))
                blocks = done.groupBy("flight_id", "leg_id").agg(F.countDistinct("block_id").alias("blocks")).where("leg_id > 0")
                for leg in blocks.join(found, ["flight_id", "leg_id"], "left").orderBy("flight_id", "leg_id").collect():  # one row a leg
                    self.tell("leg_start", (leg["flight_id"], leg["leg_id"]))
                    self.tell("block", leg["blocks"])
                    self.tell("leg_end", (leg["objects"] or 0, leg["significant"] or 0))
                self.tell("interval_end", ends)
        except Exception as e:
            self.tell("error", e)
            raise
        self.tell("run_end")
        return spark.read.parquet(*[p[0] for p in written]), spark.read.parquet(*[p[1] for p in written])

    def preview(self, minutes: float) -> tuple[int, float]:
        """Objects and minutes to expect for so many minutes of video."""
        many, slow = PREVIEW[self.algorithm]
        return int(minutes * many), max(minutes * slow, LEAST_MINUTES)


def describe(cfg: Config, algorithm: str | None, speed: str = "Max", video: bool = False, save_mode: str = "None") -> str:
    """What a run does, a line for each setting that matters to it."""
    lines = [f"Process: {algorithm}"]
    if algorithm is not None:
        lines += [f"Speed: {speed}", f"Heat threshold: {cfg.heat_threshold}"]
        lines += [f"Confidence: {cfg.yolo_confidence}, IoU: {cfg.yolo_iou}"] if algorithm == "Yolo" else []
        lines += ["Save annotated video."] if video else []
        lines += {"Significant": ["Save significant objects."], "All": ["Save all objects."]}.get(save_mode, [])
    return "".join(f"{line}\r\n" for line in lines)


def in_leg(objs: DataFrame, leg: int, significant: bool = False) -> DataFrame:
    rows = objs.where(F.col("leg_id") == leg)
    return rows.where("significant") if significant else rows


summarise = objects.summarise
