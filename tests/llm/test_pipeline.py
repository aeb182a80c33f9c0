import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as cp  # noqa: E402

from embertrail.llm import near_dedup  # noqa: E402
from embertrail.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"] and cp.ORACLE_SQL is None


def test_each_stage_on_the_last_ones_output(spark):
    docs = table(spark, SF, "documents")
    kept = cp.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    one = cp.drop_near_duplicates(spark, kept, SF)
    groups = near_dedup.near_duplicates(kept)
    assert sorted(r[0] for r in one.select("doc_id").collect()) == sorted(r[0] for r in groups.select("component_id").distinct().collect())
    masked = cp.mask_personal_data(spark, one, SF)
    assert masked.columns == docs.columns and masked.count() == one.count()
    assert masked.where(F.regexp_like("text", F.lit(r"[\w.]@[\w-]+\.[a-z]"))).count() == 0 and masked.where(F.col("n_chars") != F.length("text")).count() == 0
    mixed = cp.mix_sources(spark, masked, SF)
    words = lambda d: d.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    assert mixed.columns == docs.columns and 0.9 < words(mixed) / (1.5 * words(masked)) < 1.1
    packed = cp.pack_sequences(spark, mixed, SF)
    assert packed.where("piece = 0").count() == mixed.count()


def test_odd_rows_through_all_stages(spark):
    t = " ".join(f"word{i}" for i in range(40))
    rows = [(1, t, "en", "a", 5), (1, t, "en", "a", 5), (None, t, "en", None, None), (None, "mail me a@b.co now", None, "a", 1), (2, None, "en", "b", 0), (3, "", "en", "b", 0), (4, "q " * 9000, "en", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("size", F.lit(2)).withColumn("position", F.lit(0))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        if name == "near_dedup":
            assert sum(r["text"] == t for r in docs.collect()) == 1 and docs.where("text is null or text = ''").count() == 2
    assert cp.pack_sequences(spark, docs, SF).count() > 0
    empty = docs.where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
