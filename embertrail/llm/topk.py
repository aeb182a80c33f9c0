"""Exact top-k inner-product search by distributed histogram selection.

Vectors become integers and are packed into blocks of numpy rows. Every query block meets every candidate block once in each pass (an
equality join on the query block's number, spread over salts), and the scores are a matrix product:

1. coarse pass: each task counts, per query, the candidates in wide score bins; summed, they show the bin that holds the k-th score;
2. fine passes: the same inside that bin with bins of width / BINS, until a bin is one score wide: the k-th score is known exactly;
3. last pass: only candidates at or above it come out, each task's best k by (score desc, id asc); a window breaks ties by id.

A task only sends bins from the top until they hold k candidates: the global k-th is no lower than a local one, so nothing below counts.

Defined cases: a vector that is null, empty, or holds a null or non-finite component takes no part, nor does a null id; vectors meet
only vectors of the same length; a query with fewer than k candidates gets all; rows with the same id as the query are its own and
never candidates; a repeated candidate row counts as often as it occurs; no rows give no rows; query rows with one
id are one query (its least vector). Products are exact: float64 where
length * max^2 < 2^53, Python integers beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ready, table

QUERY_BLOCK, CANDIDATE_BLOCK, BINS = 512, 2048, 512
_BLOCK = "block long, dim int, ids binary, vecs binary"


def quantise(vectors: DataFrame, key: str, vec: str, scale: int) -> DataFrame:
    """key, vec -> id, v: floor(scale * x) for each component x, as double; unusable rows go."""
    x = F.transform(F.col(vec), lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    usable = F.col(key).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(True))
    return vectors.where(usable).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda e: F.floor(F.lit(scale) * e)).alias("v"))


def _pack(rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 32
        held: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal n
            ids, vecs = held.pop(dim)
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(vecs).tobytes()], pa.binary())], ["block", "dim", "ids", "vecs"])

        for b in batches:
            ids, col = b.column(0).to_numpy(), b.column(1)
            dims, flat = np.diff(col.offsets.to_numpy()), col.flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(dims)[:-1]])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for lo in range(0, len(at), rows):
                    part = at[lo : lo + rows]
                    own = held.setdefault(int(dim), ([], []))
                    own[0].append(ids[part])
                    own[1].append(flat[starts[part][:, None] + np.arange(dim)].ravel())
                    if sum(map(len, own[0])) >= rows:
                        yield block(int(dim))
        for dim in list(held):
            yield block(dim)

    return pack


def _scores(q: bytes, c: bytes, dim: int) -> np.ndarray:
    a, b = (np.frombuffer(x, np.int64).reshape(-1, dim) for x in (q, c))
    most = lambda x: max(abs(int(x.min())), abs(int(x.max())))
    if dim * most(a) * most(b) < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.array(a.astype(object) @ b.T.astype(object), dtype=np.int64)


def _pairs(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for r in b.to_pylist():
            yield np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["c_ids"], np.int64), _scores(r["q_vecs"], r["c_vecs"], r["dim"]), r


def _histogram(k: int):
    """Rows of (qid, low, width, bin, n): counts of candidates by bin, from the top until they hold k."""

    def count(batches):
        for q_ids, c_ids, s, r in _pairs(batches):
            low, width = (np.frombuffer(r[x], np.int64) for x in ("low", "width"))
            bins = (s - low[:, None]) // width[:, None]
            out: tuple[list, ...] = ([], [], [])
            for i in range(len(q_ids)):
                x = bins[i][(c_ids != q_ids[i]) & (bins[i] >= 0)]
                if not len(x):
                    continue
                n = np.bincount(np.minimum(x, BINS))  # above the range: one bin more
                at = np.flatnonzero(n)[::-1]
                at = at[: int(np.searchsorted(np.cumsum(n[at]), k)) + 1]
                out[0].append(np.full(len(at), q_ids[i])), out[1].append(at), out[2].append(n[at])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["qid", "bin", "n"])

    return count


def _above(k: int):
    def best(batches):
        for q_ids, c_ids, s, r in _pairs(batches):
            kth = np.frombuffer(r["low"], np.int64)
            out: tuple[list, ...] = ([], [], [])
            for i in range(len(q_ids)):
                at = np.flatnonzero((s[i] >= kth[i]) & (c_ids != q_ids[i]))
                at = at[np.lexsort((c_ids[at], -s[i][at]))[:k]]
                out[0].append(np.full(len(at), q_ids[i])), out[1].append(c_ids[at]), out[2].append(s[i][at])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["query_id", "vec_id", "score"])

    return best


def _bounds(range_of: DataFrame):
    """(block, dim, ids, vecs, ranges: array of (qid, low, width)) -> the same with low and width in the order of ids."""

    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary()), ("low", pa.binary()), ("width", pa.binary())])

    def lay(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                known = {x["qid"]: (x["low"], x["width"]) for x in r["ranges"]}
                low, width = (np.array([known.get(int(q), (1 << 62, 1))[i] for q in ids], np.int64).tobytes() for i in (0, 1))
                yield pa.RecordBatch.from_pylist([{"block": r["block"], "dim": r["dim"], "ids": r["ids"], "vecs": r["vecs"], "low": low, "width": width}], schema)

    return range_of.mapInArrow(lay, f"{_BLOCK}, low binary, width binary")


def search(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Both (id, v: array<long>) -> query_id, rank, vec_id, score: each query's k best candidates."""
    spark = candidates.sparkSession
    ready(spark)
    c = materialise(candidates.mapInArrow(_pack(CANDIDATE_BLOCK), _BLOCK), "topk-candidates")
    queries = materialise(queries.groupBy("id").agg(F.min("v").alias("v")), "topk-query-rows")
    n_queries = queries.count()
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    q = materialise(queries.repartition(blocks, "id").mapInArrow(_pack(QUERY_BLOCK), _BLOCK), "topk-queries")
    numbered = q.select("block").distinct().withColumn("qb", F.row_number().over(Window.orderBy("block")) - 1)
    q = materialise(q.join(numbered, "block").select(F.col("qb").cast("long").alias("block"), "dim", "ids", "vecs"), "topk-query-blocks")
    n_blocks = q.count()
    if not n_blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    salts = max(1, -(-2 * spark.sparkContext.defaultParallelism // n_blocks))
    spread = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("qb")
    left = c.select(F.col("ids").alias("c_ids"), F.col("vecs").alias("c_vecs"), F.col("dim").alias("c_dim"), F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), spread)

    def met(with_ranges: DataFrame) -> DataFrame:
        right = with_ranges.select(F.col("block").alias("qb"), "dim", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), "low", "width", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        pairs = left.join(right, ["qb", "salt"]).where(F.col("dim") == F.col("c_dim"))
        return pairs.select("dim", "q_ids", "q_vecs", "c_ids", "c_vecs", "low", "width")

    # no score lies outside +-dim * max * max; sizes of integers are known from the rows
    def peak(df):
        return df.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("m"), F.max(F.size("v")).alias("d")).first()

    a, b = peak(candidates), peak(queries)
    if a["m"] is None or b["m"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bound = a["m"] * b["m"] * min(a["d"], b["d"]) + 1
    width = max(1, -(-2 * bound // BINS))
    every = queries.select(F.col("id").alias("qid"), F.lit(-bound).alias("low"), F.lit(width).cast("long").alias("width")).distinct()
    member = _members(q)
    member = materialise(member, "topk-members")
    at = every
    while True:
        laid = _bounds(q.join(member.join(at, "qid").groupBy("block").agg(F.collect_list(F.struct("qid", "low", "width")).alias("ranges")), "block"))
        if width == 0:
            break
        counts = met(laid).mapInArrow(_histogram(k), "qid long, bin long, n long").groupBy("qid", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("qid").orderBy(F.col("bin").desc())
        held = counts.withColumn("upto", F.sum("n").over(down)).where(F.col("upto") - F.col("n") < k)
        # the lowest bin that is needed holds the k-th score; with fewer than k candidates it holds the last one
        found = held.groupBy("qid").agg(F.min("bin").alias("bin"))
        finer = 1 if width == 1 else max(1, -(-width // BINS))
        at = materialise(at.join(found, "qid").select("qid", (F.col("low") + F.col("bin") * F.col("width")).alias("low"), F.lit(finer).cast("long").alias("width")), "topk-ranges")
        width = 0 if width == 1 else finer
    best = met(laid).mapInArrow(_above(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _members(q: DataFrame) -> DataFrame:
    def ids(batches):
        for b in batches:
            for r in b.to_pylist():
                x = np.unique(np.frombuffer(r["ids"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), r["block"])), pa.array(x)], ["block", "qid"])

    return q.mapInArrow(ids, "block long, qid long")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    v = quantise(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return search(v, v.where(F.col("id") % 50 == 0), 5)


ORACLE = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([a.q[i] * b.q[i] for i in range(1, len(a.q) + 1)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 5
"""
