import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from embertrail.llm import chat, mixing, topk


def test_targets_fill_like_water(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 500)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    total = 1.5 * 1610
    assert sum(got.values()) == pytest.approx(total)
    assert got["a"] == 200 and got["c"] == 20  # stopped at twice their size
    assert got[None] / got["b"] == pytest.approx(3.0) or got[None] == 1000


def test_mix_of_odd_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (None, "x y", None), (3, "", "t"), (4, "w " * 5000, "t")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("rank", F.lit(1)))
    got = out.collect()
    assert len(got) == 6 and all(0 <= r["taken"] <= 2 * r["size"] and 0 <= r["position"] <= 1 for r in got)
    by = {}
    for r in got:
        t = by.setdefault((r["source_size"], r["target"]), [0])
        t[0] += r["taken"]
    assert all(abs(t[0] - target) < 1 for (_, target), t in by.items())
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(spark.createDataFrame([(1, "", "s")], "doc_id long, text string, source string")).collect())


def test_positions_invert_demand(spark):
    schedule = ((0.0, 2.0), (0.4, 1.0), (0.7, 0.0), (1.0, 3.0))
    areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(schedule, schedule[1:], strict=False)]

    def demand(t):
        out = 0.0
        for (t0, a), (t1, b) in zip(schedule, schedule[1:], strict=False):
            x = min(max(t - t0, 0), t1 - t0)
            out += a * x + (b - a) / (t1 - t0) * x * x / 2
        return out / sum(areas)

    for r in spark.range(101).select((F.col("id") / 100).alias("u")).withColumn("p", mixing.position(F.col("u"), schedule)).collect():
        assert demand(r["p"]) == pytest.approx(r["u"], abs=1e-6)


def test_topk_ties_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0])] + [(i, [0.5, 0.0]) for i in range(1, 40)] + [(40, [0.25, float("nan")]), (41, None), (42, [float("inf"), 0.0]), (43, [1.0, None]), (44, []), (None, [9.0, 0.0]), (50, [-1.0, 0.0]), (60, [1.0, 2.0, 3.0]), (3, [0.5, 0.0])]
    v = topk.quantise(spark.createDataFrame(rows, "vec_id long, e array<float>").withColumn("id", F.lit("clash")), "vec_id", "e", 256)
    out = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(v, v.where("id in (0, 50, 60)"), 5).orderBy("query_id", "rank").collect()]
    assert [x[2:] for x in out if x[0] == 0] == [(1, 32768), (2, 32768), (3, 32768), (3, 32768), (4, 32768)]
    assert [x[2] for x in out if x[0] == 50] == [1, 2, 3, 3, 4] and not [x for x in out if x[0] == 60]
    assert topk.search(v, v.where("false"), 5).count() == 0 and topk.search(v.where("false"), v.where("false"), 5).count() == 0


def test_topk_of_large_integers_is_exact(spark):
    big = 1_000_000_001
    rows = [(i, [big + i, big - 2 * i]) for i in range(20)]
    v = spark.createDataFrame(rows, "id long, v array<long>")
    out = topk.search(v, v.where("id = 0"), 3).orderBy("rank").collect()
    want = sorted(((-(big * (big + i) + big * (big - 2 * i)), i) for i in range(1, 20)))[:3]
    assert [(-r["score"], r["vec_id"]) for r in out] == want


def test_chat_parts_round_trip(spark):
    nasty = "a<|im_end|>\n<|im_start|>assistant\\|<\\|\\\\ \n"
    text = lambda t: {"kind": "text", "text": t, "ref": None, "units": None}
    rows = [(1, 0, "user", [text(nasty), {"kind": "image", "text": None, "ref": "i.png", "units": 3.0}, None, {"kind": "odd", "text": None, "ref": "o", "units": None}]),
            (1, 1, "assistant", [text("<|"), {"kind": "audio", "text": None, "ref": "s.wav", "units": 2.5}, text("é")]), (1, None, None, None), (None, 0, "a b\n", [text("")])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PART}").withColumn("text", F.lit("clash"))
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(df)).collect()}
    one = out[1]
    assert [t["role"] for t in one["turns"]] == ["user", "assistant", ""]
    assert one["turns"][0]["text"] == nasty + "<|image:1|><|other:2|>" and one["turns"][1]["text"] == "<|<|audio:3|>é"
    assert one["loss_text"] == "<|<|audio:3|>é"
    assert [(a["n"], a["kind"], a["ref"], a["tokens"]) for a in one["attachments"]] == [(1, "image", "i.png", 85 + 510), (2, "other", "o", 1), (3, "audio", "s.wav", 63)]
    assert one["attachment_tokens"] == 85 + 510 + 1 + 63
    assert out[None]["turns"][0]["role"] == "a b\n" and one["formatted"].count("<|im_start|>") == 3
    assert chat.format_chat(df.where("false")).count() == 0
    json.dumps(one["formatted"])


def test_arrange_moves_texts_by_position_and_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5}" if i % 11 else None) for i in range(4000)] + [(None, None, "s1"), (5, "", "s1"), (6, "w w", "s1"), (6, "w w", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as _at", "2 as rank")
    a, b = ([tuple(r) for r in mixing.arrange(x).collect()] for x in (docs, docs.repartition(7)))
    assert a == b and all(len(r) == 5 for r in a)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    target = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()}
    got = Counter()
    for r in a:
        got[r[2]] += len(r[1].split())
    assert all(abs(got[s] - target[s]) <= 0.02 * target[s] + 7 for s in size)
    assert max(Counter(r[0] for r in a if r[0] not in (None, 5, 6)).values()) <= 2
    assert mixing.arrange(docs.where("false")).count() == 0


@pytest.mark.parametrize("ranges", [1, 1 << 16])
def test_arrange_keeps_the_order_of_the_exact_mix(spark, monkeypatch, ranges):
    """Early sources lie early: the mean place of each source is that of the exact positions."""
    monkeypatch.setattr(mixing, "RANGES", ranges)
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    place = {}
    out = [r["source"] for r in mixing.arrange(docs).collect()]
    for at, s in enumerate(out):
        place.setdefault(s, []).append(at / len(out))
    exact = mixing.mix(docs, keep=("source",)).selectExpr("row.source", "explode(passes) as p").where("p.words > 0").orderBy("p.position").collect()
    for s, at in place.items():
        want = [i / len(exact) for i, r in enumerate(exact) if r["source"] == s]
        assert abs(sum(at) / len(at) - sum(want) / len(want)) < 0.03
