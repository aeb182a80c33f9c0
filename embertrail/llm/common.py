"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_RUNS: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that arrives in fewer partitions than there are cores (one small file, say) is dealt out, so that work on whole texts runs
    side by side. Larger tables are read as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 4) else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's spark.checkpoint.dir. Only where it is unset (tests, one machine) a local one is made."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir"):
        return found
    if not (found := sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="embertrail-"))
        found = sc.getCheckpointDir()
    return found


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _sweep(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by now
        _delete(spark, folder)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it again: lineage is cut and survives lost executors, and the planner sees real
    sizes. All folders of a run lie under its application id and go when the driver ends; `release` drops one earlier."""
    spark = df.sparkSession
    run = f"{shared_dir(spark).rstrip('/')}/embertrail/{spark.sparkContext.applicationId}"
    if run not in _RUNS:
        _RUNS.add(run)
        atexit.register(_sweep, spark, run)
    path = f"{run}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what `materialise` wrote for tables that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_written", None):
            _delete(df.sparkSession, path)


def ready(spark: SparkSession) -> None:
    """For operators with Python workers: Arrow batches end at 2 MB, so that very long texts do not add up in a worker or in the
    executor's buffers, which are twice a batch and more; workers give freed memory back to the system, as they live on from task to task;
    and they find this package where it is not installed."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    spark.sparkContext.environment.update(ARROW_DEFAULT_MEMORY_POOL="system", MALLOC_ARENA_MAX="2", MALLOC_TRIM_THRESHOLD_="131072")
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def held_out(doc_id: Column) -> Column:
    """The rows no label may be learnt from: crc32 of the id as text, modulo 5, is 0. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def bounded_keys(keys: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows at most of a table with one row a key, chosen by a hash of the key: reruns agree, and the choice is spread over all the data."""
    n = keys.count()
    if n <= most:
        return keys
    return keys.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * most / n))


def sampled(rows: DataFrame, most: int, *columns: str) -> DataFrame:
    """About `most` of the different rows at most, with `repeats`: how often each occurs. Rows are chosen by a hash of the given columns and
    equal ones are one, so neither null ids nor an id on many rows can pass the bound; reruns agree."""
    keyed = rows.select(*columns, F.xxhash64(*columns, F.lit("sample")).alias("_k"))
    n = keyed.agg(F.approx_count_distinct("_k", 0.02)).first()[0]
    share = min(1.0, most / max(1, n))
    some = keyed if share == 1.0 else keyed.where(F.pmod("_k", F.lit(1 << 30)) < int((1 << 30) * share))
    return some.groupBy("_k").agg(*[F.any_value(c).alias(c) for c in columns], F.count("*").alias("repeats")).drop("_k")
