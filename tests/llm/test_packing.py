import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from embertrail.llm import packing


def fewest(sizes, cap):
    """Fewest bins by exhaustive search."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= cap and bins[b] not in bins[:b]:
                bins[b] += sizes[i]
                go(i + 1, bins)
                bins[b] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_bound_and_best_fit_around_the_optimum(sizes):
    sizes = sorted(sizes, reverse=True)
    x = np.array(sizes, np.int64)
    n, c = np.unique(x, return_counts=True)
    bins, offsets, fills = packing.best_fit(x, 20)
    assert packing.lower_bound(n, c, 20) <= fewest(sizes, 20) <= len(fills)
    assert (fills <= 20).all()
    for b in range(len(fills)):
        own = sorted((offsets[i], x[i]) for i in np.flatnonzero(bins == b))
        assert [o for o, _ in own] == list(np.cumsum([0, *[s for _, s in own]])[:-1])


def test_bound_beats_the_sum():
    assert packing.lower_bound(np.array([11]), np.array([4]), 20) == 4


def check(spark, rows, cap=64, part_rows=100):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece0")
    out = packing.pack(packing.tokenise(docs, capacity=cap), cap, part_rows).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(str(i), k, at, len(ids[at : at + cap]), zlib.crc32(ids[at : at + cap].tobytes())) for k, at in enumerate(range(0, len(ids), cap))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in seqs.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and sum(x for _, x in own) <= cap
    sizes, n = np.unique([r["length"] for r in out], return_counts=True)
    return len(seqs), packing.lower_bound(sizes, n, cap)


def test_round_trip_and_exchange(spark):
    rows = [(i, " ".join(["the cat"] * (i * 7 % 45))) for i in range(300)] + [(None, "x"), (None, "x"), (5, "the cat"), (400, None), (401, ""), (402, "é ß <|endoftext|> 日本 It's 12"), (403, "long " * 5000)]
    used, least = check(spark, rows)
    assert used <= 1.02 * least + 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.tokenise(docs)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_words_alone_give_the_ids_of_the_text(text):
    from tokenizers import Tokenizer

    text = text.encode(errors="ignore").decode()
    ids = packing.word_ids(packing.tokenizer_path())
    t = Tokenizer.from_file(packing.tokenizer_path())
    assert b"".join(ids[w] for w in text.encode().split()) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
