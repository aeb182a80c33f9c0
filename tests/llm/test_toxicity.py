import zlib

import numpy as np
from pyspark.sql import functions as F

from embertrail.llm import toxicity
from embertrail.llm.common import table


def test_nnpu_finds_positives_in_unlabelled():
    rng = np.random.default_rng(0)
    rows, positive, truth = [], [], []
    for _ in range(3000):
        toxic = rng.random() < 0.2
        rows.append(np.array(sorted({int(i) for i in rng.integers(10, 40, 5)} | ({int(rng.integers(0, 10))} if toxic else set()))))
        truth.append(toxic)
        positive.append(toxic and rng.random() < 0.3)
    w, b = toxicity.fit_nnpu(rows, np.array(positive), 40, 0.15)
    said = np.array([w[r].sum() + b > 0 for r in rows])
    assert (said == np.array(truth)).mean() > 0.97


def test_plain_loss_is_worse():
    """Most toxic texts are among the unlabelled: taking these for clean loses them, the corrected risk does not."""
    rng = np.random.default_rng(1)
    rows, positive, truth = [], [], []
    for _ in range(3000):
        toxic = rng.random() < 0.2
        rows.append(np.array(sorted({int(i) for i in rng.integers(10, 40, 5)} | ({int(rng.integers(0, 10))} if toxic else set()))))
        truth.append(toxic)
        positive.append(toxic and rng.random() < 0.3)
    truth, positive = np.array(truth), np.array(positive)
    x = np.zeros((3000, 41))
    for i, r in enumerate(rows):
        x[i, r] = 1
    x[:, 40] = 1
    w = np.zeros(41)
    for _ in range(2000):
        w -= 1.0 * x.T @ (1 / (1 + np.exp(-x @ w)) - positive) / 3000
    plain = (x @ w > 0)[truth].mean()
    v, b = toxicity.fit_nnpu(rows, positive, 40, 0.15)
    corrected = np.array([v[r].sum() + b > 0 for r in rows])[truth].mean()
    assert (v < 0).any() and corrected > 0.95 and plain < corrected - 0.3


def test_held_out_rows_and_labels_are_not_read(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = toxicity.held_out(F.col("doc_id"))
    changed = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, changed)
    assert a.vocabulary == b.vocabulary and np.allclose(a.weights, b.weights) and a.bias == b.bias
    got = [r[0] for r in docs.select("doc_id").where(held).collect()]
    assert got == [i for i in (r[0] for r in docs.select("doc_id").collect()) if zlib.crc32(str(i).encode()) % 5 == 0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity_rows = __import__("embertrail.llm.queries", fromlist=["queries"]).queries()["op4_toxicity"](spark, sf)
    j = toxicity_rows.where("held_out").join(table(spark, sf, "labels"), "doc_id").select("toxic", "predicted").collect()
    said = [r for r in j if r["predicted"] == 1]
    assert sum(r["toxic"] for r in said) / len(said) > 0.85
    assert sum(r["toxic"] for r in said) / sum(r["toxic"] for r in j) > 0.6
    assert out.count() == table(spark, sf, "documents").count()


def test_every_language_is_learnt(spark):
    """In German and Spanish no single feature is precise; frequencies of several are."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.train(docs, labels)
    held = docs.where(toxicity.held_out(F.col("doc_id"))).join(labels.where("toxic is not null"), "doc_id")
    rows = held.select("lang", "toxic", (toxicity.score_column(model, F.col("text")) >= 0.5).alias("said")).collect()
    for lang in ("en", "de", "fr", "es"):
        own = [r for r in rows if r["lang"] == lang]
        found, all_, wrong, clean = (sum(r["toxic"] == t and (r["said"] or not s) for r in own) for t, s in ((1, True), (1, False), (0, True), (0, False)))
        print(lang, f"{found} of {all_} toxic found, {wrong} false alarms among {clean}")
        assert found >= 0.8 * all_ and wrong <= 0.03 * clean


def test_features_are_counted_over_all_documents(spark, monkeypatch):
    """A word in few positives, fewer than the sample has, is still learnt."""
    docs = spark.createDataFrame([(i, f"{'vile' if i % 100 < 2 else 'idiot'} you" if i % 2 == 0 else "a calm text") for i in range(1, 3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(1, 3000)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "POSITIVES", 40)
    monkeypatch.setattr(toxicity, "LEAST_POSITIVES", 10)
    seen = []
    monkeypatch.setattr(toxicity, "fit_nnpu", lambda rows, positive, d, prior, **k: (seen.append(d), (np.ones(d), 0.0))[1])
    model = toxicity.train(docs, labels)
    assert b"vile" in model.vocabulary and seen == [len(model.vocabulary)]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, "you idiot" if i % 3 == 0 else "a calm text") for i in range(1, 800)] + [(900, None), (901, ""), (None, "idiot"), (3, "you idiot")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1 if i % 3 == 0 else 0) for i in range(1, 700)] + [(700, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.score_column(model, F.col("text")).alias("s")).collect()}
    assert out[3] > 0.5 > out[4] and out[900] == out[901] < 0.5 and out[None] > 0.5
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r[0] for r in docs.select(toxicity.score_column(none, F.col("text"))).collect()} < {x / 1e15 for x in range(9)} | {float(1 / (1 + np.exp(40.0)))}
    empty = docs.where("false")
    assert empty.select(toxicity.score_column(toxicity.train(empty, labels), F.col("text"))).count() == 0
