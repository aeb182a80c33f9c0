"""A training corpus from raw documents: toxic texts go, near-duplicates go, personal data is masked, sources are mixed to their target
weights, and what remains is packed into sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrail.llm import mixing, near_dedup, packing, pii, toxicity
from embertrail.llm.common import materialise, ready, release, spread, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more. Null and empty texts stay; repeated rows are judged alike."""
    ready(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(model, F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group. Rows without an id get one from their content while they are compared (a
    negative one); of rows that repeat both id and text one stays. Empty texts are no duplicates of each other."""
    key = F.coalesce(F.col("doc_id").cast("long"), -F.abs(F.xxhash64("text", *[c for c in docs.columns if c != "text"]) % (1 << 62)) - 1)
    keyed = docs.withColumn("_dedup_key", key)
    found = materialise(near_dedup.near_duplicates(keyed.select(F.col("_dedup_key").alias("doc_id"), "text")), "pipeline-dedup")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_dedup_key")).distinct()
    left = keyed.join(gone, "_dedup_key", "left_anti")
    again = materialise(found.where("kept").groupBy(F.col("doc_id").alias("_dedup_key")).count().where("count > 1").select("_dedup_key"), "pipeline-repeats")
    if not again.isEmpty():
        repeated = left.join(again, "_dedup_key", "left_semi").withColumn("_text_key", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).dropDuplicates(["_dedup_key", "_text_key"])
        left = left.join(again, "_dedup_key", "left_anti").unionByName(repeated.drop("_text_key"))
    return left.select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span by its kind in brackets; n_chars, where there is one, follows the text."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of training positions. A copy that starts before its source's target is in;
    documents without words are not taken; equal rows are taken each."""
    return mixing.arrange(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack(packing.tokenise(docs, words=200_000)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The learnt toxicity score has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            out = materialise(out, f"pipeline-{name}")
            release(docs)
        docs = out
    return docs
