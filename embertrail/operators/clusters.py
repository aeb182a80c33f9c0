"""Clusters of points: drift correction, silhouette, choice of k, shrinking and reassignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embertrail.config import Config
from embertrail.functions.runtime import ready

#: Rows whose distances to a block are held at once; they stay in a core's cache.
ROWS_AT_ONCE = 64
#: Bytes of vectors of the others that a task of the silhouette meets, and the most parts of its own points.
RIGHT_BYTES, MOST_LEFT = 64 << 20, 512


def drift_corrected(y: Column, time: Column, per_slice: float) -> Column:
    return y - time * F.lit(per_slice)


def _distance_sums(a: np.ndarray, b: np.ndarray, first: np.ndarray, same: np.ndarray | None) -> np.ndarray:
    """For each row of a the sums of its distances to the runs of rows of b that begin at `first`, without the pairs that `same` tells. Squared
    distances come from one product; those so small that it would lose digits are computed anew."""
    middle = b.mean(0)
    one, two = a - middle, b - middle
    own, other = (one * one).sum(1), (two * two).sum(1)
    left, right = np.column_stack([one, own, np.ones(len(a))]), np.vstack([-2.0 * two.T, np.ones(len(b)), other])
    small, out = 1e-4 * (own + other.max()), np.empty((len(a), len(first)))
    for at in range(0, len(a), ROWS_AT_ONCE):
        to = min(at + ROWS_AT_ONCE, len(a))
        d = left[at:to] @ right
        for i in np.flatnonzero(d.min(1) < small[at:to]):
            j = np.flatnonzero(d[i] < small[at + i])
            d[i, j] = ((a[at + i] - b[j]) ** 2).sum(1)
        if same is not None:
            d[same[at:to]] = 0.0
        out[at:to] = np.add.reduceat(np.sqrt(d, out=d), first, axis=1)
    return out


def silhouette(points: DataFrame, key: str, vec: str, label: str, block_rows: int = 2048) -> DataFrame:
    """Euclidean silhouette of each point: (b - a) / max(a, b), with a = 0 for a cluster of one and null for one cluster alone. Points
    without a vector take no part.

    Every pair's distance is needed, so points are packed into blocks of about `block_rows`, and each task reads its block and one part of
    all others (a Cartesian product, which keeps no copies on disk), of about RIGHT_BYTES; it leaves a sum for each of its points, label
    and part."""
    ready(points.sparkSession)
    total, dim = points.agg(F.count("*"), F.coalesce(F.max(F.size(vec)), F.lit(1))).first()
    blocks = max(1, -(-total // block_rows), min(16, -(-total // 64)))
    parts = max(1, -(-total * dim * 8 // RIGHT_BYTES))
    numbers = F.col(vec) if points.schema[vec].dataType.simpleString() == "array<float>" else F.col(vec).cast("array<double>")
    own = points.where(F.col(vec).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"), F.struct(F.col(key).alias("k"), numbers.alias("v"), F.col(label).cast("long").alias("l")).alias("p"))
    packed = own.groupBy("b").agg(F.collect_list("p").alias("p"))
    others = own.where("p.l is not null").groupBy("b").agg(F.collect_list("p").alias("p2")).withColumnRenamed("b", "b2")
    pairs = packed.repartition(min(blocks, MOST_LEFT)).crossJoin(others.repartition(min(parts, blocks)).hint("shuffle_replicate_nl"))

    def block(p: pa.StructArray) -> tuple[pa.Array, np.ndarray, pa.Array]:
        return p.field("k"), p.field("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(p), -1), p.field("l")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[int, tuple] = {}  # of each own block: keys, vectors, labels, and by label of the others sums and numbers
        for batch in batches:
            b, p, b2, p2 = (batch.column(c) for c in ("b", "p", "b2", "p2"))
            for i in range(len(batch)):
                if (at := b[i].as_py()) not in left:
                    left[at] = (*block(p[i].values), {})
                k, v, _, found = left[at]
                k2, v2, l2 = block(p2[i].values)
                l2 = l2.to_numpy()
                order = np.argsort(l2, kind="stable")
                names, first, n = np.unique(l2[order], return_index=True, return_counts=True)
                same, lost = None, 0
                if at == b2[i].as_py():  # equal keys are in blocks of one number
                    same = np.equal.outer(k.to_numpy(zero_copy_only=False), k2.to_numpy(zero_copy_only=False)[order])
                    lost = np.add.reduceat(same.astype(np.int64), first, axis=1)
                s, n = _distance_sums(v, v2[order], first, same), n[None, :] - lost + np.zeros((len(v), 1), np.int64)
                for j, name in enumerate(names.tolist()):
                    was = found.get(name, (0.0, 0))
                    found[name] = (was[0] + s[:, j], was[1] + n[:, j])
        for k, _, l, found in left.values():
            for name, (s, n) in found.items():
                yield pa.RecordBatch.from_arrays([k, l, pa.array(np.full(len(k), name)), pa.array(s), pa.array(n)], names=["k", "l", "l2", "s", "n"])

    kind = points.schema[key].dataType.simpleString()
    met = pairs.mapInArrow(sums, f"k {kind}, l long, l2 long, s double, n long").where("n > 0").groupBy("k", "l", "l2").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    mean = F.col("s") / F.col("n")
    ab = met.groupBy("k", "l").agg(F.coalesce(F.max(F.when(F.col("l") == F.col("l2"), mean)), F.lit(0.0)).alias("a"), F.min(F.when(F.col("l") != F.col("l2"), mean)).alias("b"))
    return ab.select(F.col("k").alias(key), F.col("l").cast(points.schema[label].dataType).alias(label), F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")).alias("silhouette"))


def choose_k(points: DataFrame, columns: list[str], most: int, seed: int = 1) -> tuple[int, DataFrame]:
    """The k from 2 to `most` with the highest mean silhouette, the least of equals, and its clusters (column cluster). Each k is one
    distributed fit; only one number per k comes to the driver."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=columns, outputCol="_f").transform(points.withColumn("_k", F.monotonically_increasing_id())).persist()
    best: tuple[float, int, DataFrame] | None = None
    for k in range(2, max(2, most) + 1):
        done = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="cluster").fit(data).transform(data)
        score = silhouette(done.withColumn("_v", vector_to_array("_f")), "_k", "_v", "cluster").agg(F.avg("silhouette")).first()[0] or -1.0
        if best is None or score > best[0]:
            best = (score, k, done.drop("_f", "_k"))
    return best[1], best[2]


def good_next(cfg: Config, per_slice: float, dx: Column, dy: Column, dt: Column) -> Column:
    """Whether one feature can follow another: close, not backwards, later, and not too late."""
    return (F.abs(dy) <= cfg.yolo_max_y_delta - per_slice) & (dy >= -per_slice) & (F.abs(dx) <= cfg.yolo_max_x_delta) & (dt > 0) & (dt <= cfg.yolo_max_time_gap)


def valid_members(points: DataFrame, cfg: Config, per_slice: float) -> DataFrame:
    """Adds valid: the first of its cluster in time, or a good follower of the one before, valid or not."""
    w = Window.partitionBy("cluster").orderBy("time", "feature")
    d = lambda c: F.col(c) - F.lag(c).over(w)
    return points.withColumn("valid", F.coalesce(good_next(cfg, per_slice, d("x"), d("y"), d("time")), F.lit(True)))


def orphans(points: DataFrame, kept: DataFrame) -> DataFrame:
    return points.join(kept.select("feature"), "feature", "left_anti")


def _joined(x: np.ndarray, y: np.ndarray, time: np.ndarray, cluster: np.ndarray, loose: np.ndarray, cfg: Config, per_slice: float) -> list[tuple[int, int]]:
    """(row, cluster) of the loose rows that join a cluster, in order. A row looks at every centre once; from then on only at the centres
    that have moved since it looked last, and at all again where its nearest is one of them."""
    inside = np.ones(len(x), bool)
    inside[loose] = False
    ids, at = np.unique(cluster[inside], return_inverse=True)
    n, sx, sy = np.bincount(at), np.bincount(at, x[inside]), np.bincount(at, y[inside])
    top, late = np.full(len(ids), -np.inf), np.full(len(ids), -np.inf)
    np.maximum.at(top, at, y[inside])
    np.maximum.at(late, at, time[inside])
    cx, cy = sx / n, sy / n

    def nearest(r: int, some: np.ndarray | slice) -> tuple[float, int]:
        dx, dy = cx[some] - x[r], cy[some] - y[r]
        d = dx * dx + dy * dy
        i = int(np.argmin(d))
        if d[i] != d[i]:  # not a number: never the nearest
            d = np.where(np.isnan(d), np.inf, d)
            i = int(np.argmin(d))
        return float(d[i]), i

    rest = [[int(r), 0.0, -1, 0] for r in loose]  # row, distance and number of the nearest, centres moved when it looked
    moves, out, moved = [], [], True
    while rest and moved:
        moved, left = False, []
        for one in rest:
            r, d, c, seen = one
            if c < 0:
                d, c = nearest(r, slice(None))
            elif seen < len(moves):
                some = np.unique(moves[seen:])
                if c in some:
                    d, c = nearest(r, slice(None))
                else:
                    e, i = nearest(r, some)
                    d, c = min((d, c), (e, int(some[i])))
            else:  # nothing moved: as before
                left.append(one)
                continue
            up = y[r] - top[c]
            if abs(up) <= cfg.yolo_max_y_delta - per_slice and up >= -per_slice and abs(x[r] - cx[c]) <= cfg.yolo_max_x_delta and time[r] - late[c] <= cfg.yolo_max_time_gap:
                out.append((r, int(ids[c])))
                n[c], sx[c], sy[c] = n[c] + 1, sx[c] + x[r], sy[c] + y[r]
                cx[c], cy[c], top[c], late[c] = sx[c] / n[c], sy[c] / n[c], max(top[c], y[r]), max(late[c], time[r])
                moves.append(c)
                moved = True
            else:
                one[1:] = d, c, len(moves)
                left.append(one)
        rest = left
    return out


def adjust(points: DataFrame, cfg: Config, per_slice: float, leg: str = "leg_id") -> DataFrame:
    """Shrinks each cluster of a leg to its valid members, then lets orphans join the cluster with the nearest centre if it is within
    limits, until no one moves. Sequential by nature (each join moves a centre), so it runs per leg."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cluster", "time", "feature"], kind="stable")
        x, y, time = (pdf[c].to_numpy(float) for c in ("x", "y", "time"))
        cluster, feature = pdf["cluster"].to_numpy(), pdf["feature"].to_numpy()
        dx, dy, dt = (np.diff(v, prepend=np.nan) for v in (x, y, time))
        fine = (np.abs(dy) <= cfg.yolo_max_y_delta - per_slice) & (dy >= -per_slice) & (np.abs(dx) <= cfg.yolo_max_x_delta) & (dt > 0) & (dt <= cfg.yolo_max_time_gap)
        fine |= np.r_[True, cluster[1:] != cluster[:-1]]
        loose = np.flatnonzero(~fine)
        joined = _joined(x, y, time, cluster, loose[np.argsort(feature[loose], kind="stable")], cfg, per_slice)
        rows, to = np.array([r for r, _ in joined], int), np.array([c for _, c in joined], cluster.dtype)
        return pd.concat([pdf[fine], pdf.iloc[rows].assign(cluster=to)], ignore_index=True)

    ready(points.sparkSession)
    return points.groupBy(leg).applyInPandas(run, points.schema)


def violations(points: DataFrame, cfg: Config) -> DataFrame:
    """cluster, feature, problem: members out of order, too far apart, or twice."""
    w = Window.partitionBy("cluster").orderBy("time", "feature")
    lag = lambda c: F.lag(c).over(w)
    checks = F.array(
        F.when(F.col("time") == lag("time"), "same time"), F.when(F.col("time") - lag("time") > cfg.yolo_max_time_gap, "time gap"),
        F.when(F.abs(F.col("y") - lag("y")) > cfg.yolo_max_y_delta, "y gap"), F.when(F.count("*").over(Window.partitionBy("feature")) > 1, "twice"))
    return points.withColumn("problem", F.array_compact(checks)).select("cluster", "feature", F.explode("problem").alias("problem"))
