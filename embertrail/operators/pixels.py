"""Hot pixels and features from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrail.config import Config
from embertrail.functions.runtime import ready


def hot_pixels(pixels: DataFrame, threshold: int) -> DataFrame:
    return pixels.where(F.col("heat") > threshold)


def outside_exclusion(pixels: DataFrame, cfg: Config, width: int, height: int) -> DataFrame:
    """Drops pixels in the excluded bottom-right corner; they must be in it by both axes."""
    edges = cfg.exclusion_edges(width, height)
    return pixels if edges is None else pixels.where(~((F.col("x") >= edges[0]) & (F.col("y") >= edges[1])))


def radiometric(raw, cfg: Config):
    """Raw sensor values windowed to grey 0..255."""
    return (F.least(F.greatest((raw - cfg.radiometric_low) / F.lit(float(cfg.radiometric_high - cfg.radiometric_low)), F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def components(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """8-connected components of distinct pixels: a label for each, numbered by first pixel in row order."""
    parent = np.arange(len(y))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    at = {p: i for i, p in enumerate(zip(y.tolist(), x.tolist(), strict=True))}
    for (py, px), i in at.items():
        for dy, dx in ((0, -1), (-1, -1), (-1, 0), (-1, 1)):
            j = at.get((py + dy, px + dx))
            if j is not None:
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(len(y))], dtype=np.int64)
    return np.unique(roots, return_inverse=True)[1] if len(y) else roots


def merge_contained(boxes: list[tuple[int, int, int, int]]) -> list[int]:
    """For each cluster (left, top, right, bottom; inclusive), the cluster that takes it in: in turn, one takes all whose box lies in its own."""
    owner = [-1] * len(boxes)
    for i, a in enumerate(boxes):
        if owner[i] >= 0:
            continue
        owner[i] = i
        for j, b in enumerate(boxes):
            if owner[j] < 0 and a[0] <= b[0] and a[1] <= b[1] and a[2] >= b[2] and a[3] >= b[3]:
                owner[j] = i
    return owner


def threshold_clusters(pixels: DataFrame, cfg: Config, merge: bool = True, keys: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """Hot pixels of each frame -> keys, y, x, heat, cluster (1 = most pixels; ties by first pixel). One frame is one group: its size is bounded by the sensor."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], kind="stable").reset_index(drop=True)
        label = components(pdf["y"].to_numpy(), pdf["x"].to_numpy())
        if merge:
            g = pdf.groupby(label)
            owner = np.array(merge_contained(list(zip(g["x"].min(), g["y"].min(), g["x"].max(), g["y"].max(), strict=True))))
            label = owner[label]
        sizes = pd.Series(label).groupby(label).size()
        rank = {c: i + 1 for i, c in enumerate(sorted(sizes.index, key=lambda c: (-sizes[c], c)))}
        return pdf.assign(cluster=[rank[c] for c in label])

    ready(pixels.sparkSession)
    fields = ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in (*keys, "y", "x", "heat"))
    return pixels.select(*keys, "y", "x", "heat").groupBy(*keys).applyInPandas(run, f"{fields}, cluster long")


def cluster_features(clustered: DataFrame, cfg: Config, keys: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """Clusters -> boxes, counts and heat."""
    out = clustered.groupBy(*keys, "cluster").agg(
        F.min("x").alias("box_x"), F.min("y").alias("box_y"), (F.max("x") - F.min("x") + 1).alias("box_w"), (F.max("y") - F.min("y") + 1).alias("box_h"),
        F.count("*").alias("num_hot"), F.sum(F.greatest(F.col("heat") - cfg.heat_threshold, F.lit(0))).alias("sum_hot"), F.min("heat").alias("min_heat"), F.max("heat").alias("max_heat"), F.count_if(F.col("heat") == 255).alias("num_max_heat"))
    return out.withColumn("significant", F.col("num_hot") >= cfg.feature_min_pixels)


def comb_scan(heat: np.ndarray, cfg: Config) -> list[dict]:
    """Features of one frame by top-down row scans.

    A scan starts at the first unsearched hot pixel, three wide. On each row the left edge first moves left over hot pixels; every cold
    pixel that leads the row moves it right for the next; a hot pixel at the right edge widens the row at once, a cold one narrows the
    next. A row without hot pixels or a box over the size limit ends it. Pixels may belong to several features."""
    height, width = heat.shape
    hot = heat > cfg.heat_threshold
    edges = cfg.exclusion_edges(width, height)
    open_ = np.ones_like(hot)
    if edges:
        open_[edges[1] :, edges[0] :] = False
    searched = np.zeros_like(hot)
    out = []
    for y0, x0 in zip(*np.nonzero(hot & open_), strict=True):
        if searched[y0, x0]:
            continue
        searched[y0, x0] = True
        low, high = int(x0), int(x0) + 3  # columns searched: low .. high - 1
        left, right, bottom = int(x0), int(x0) + 2, int(y0)
        pixels: list[tuple[int, int, int]] = []
        box = (left, int(y0), right - left + 1, 1)
        for y in range(int(y0), height):
            found = 0
            while low > 0 and low < width and hot[y, low]:
                low -= 1
            x = low
            while x < high and x < width:
                searched[y, x] = True
                if not open_[y, x]:
                    x += 1
                    continue
                is_hot = bool(hot[y, x])
                if is_hot:
                    found += 1
                    pixels.append((y, x, int(heat[y, x])))
                    left, right = min(left, x), max(right, x)
                if x == low and not is_hot:
                    low += 1
                if x == high - 1:
                    high += 1 if is_hot else -1
                x += 1
            if not found:
                break
            bottom = y
            box = (left, int(y0), right - left + 1, bottom - int(y0) + 1)
            if box[2] > cfg.feature_max_size or box[3] > cfg.feature_max_size:
                break
        values = [p[2] for p in pixels]
        out.append({"box_x": box[0], "box_y": box[1], "box_w": box[2], "box_h": box[3], "num_hot": len(pixels), "sum_hot": sum(max(0, v - cfg.heat_threshold) for v in values), "min_heat": min(values, default=0), "max_heat": max(values, default=0), "num_max_heat": values.count(255), "significant": len(pixels) >= cfg.feature_min_pixels})
    return out


FEATURE = "box_x int, box_y int, box_w int, box_h int, num_hot int, sum_hot int, min_heat int, max_heat int, num_max_heat int, significant boolean"


def comb_features(pixels: DataFrame, cfg: Config, width: int, height: int) -> DataFrame:
    """block_id, y, x, heat -> features of each frame, numbered in the order found."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frame = np.zeros((height, width), np.int32)
        frame[pdf["y"], pdf["x"]] = pdf["heat"]
        rows = comb_scan(frame, cfg)
        return pd.DataFrame([{"block_id": int(pdf["block_id"].iloc[0]), "n": i + 1, **r} for i, r in enumerate(rows)], columns=["block_id", "n", *[f.split()[0] for f in FEATURE.split(", ")]])

    ready(pixels.sparkSession)
    return pixels.select("block_id", "y", "x", "heat").groupBy("block_id").applyInPandas(run, f"block_id {pixels.schema['block_id'].dataType.simpleString()}, n int, {FEATURE}")


def frame_features(frames: DataFrame, cfg: Config) -> DataFrame:
    """Whole frames (flight_id, frame_id, height, width, data) -> comb features; one pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                grey = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width).astype(np.int32)
                rows += [{"flight_id": r.flight_id, "block_id": r.frame_id, "n": i + 1, **f} for i, f in enumerate(comb_scan(grey, cfg))]
            yield pd.DataFrame(rows, columns=["flight_id", "block_id", "n", *[f.split()[0] for f in FEATURE.split(", ")]])

    ready(frames.sparkSession)
    return frames.mapInPandas(run, f"flight_id long, block_id int, n int, {FEATURE}")


def blur3(grey: np.ndarray) -> np.ndarray:
    """3 x 3 Gaussian blur with mirrored edges, for regenerating features."""
    p = np.pad(grey.astype(np.int32), 1, mode="reflect")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    return ((rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:] + 8) >> 4).astype(np.uint8)


def enhance(grey: np.ndarray, low: float = 0.02, high: float = 0.98) -> np.ndarray:
    """Stretches the window between two percentiles (the sorted value at trunc(n p)) to 0..255."""
    values = np.sort(grey, axis=None)
    a, b = (int(values[min(len(values) - 1, int(len(values) * p))]) for p in (low, high))
    return (np.clip((grey.astype(float) - a) / max(1, b - a), 0, 1) * 255).astype(np.uint8)


def pixels_in_box(pixels: DataFrame, features: DataFrame) -> DataFrame:
    """Hot pixels inside stored feature boxes: an equality join on the frame, then the box."""
    p = pixels.select("block_id", "y", "x", "heat")
    inside = (F.col("x") >= F.col("box_x")) & (F.col("x") < F.col("box_x") + F.col("box_w")) & (F.col("y") >= F.col("box_y")) & (F.col("y") < F.col("box_y") + F.col("box_h"))
    return p.join(features, "block_id").where(inside)
