import random

import numpy as np
import pytest

from embertrail.llm import near_dedup as nd
from embertrail.llm.components import components


def brute(rows):
    """Components by comparing every pair of full shingle sets."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, i = [], 0
    passage = [word() for _ in range(70)]
    for _ in range(25):
        base = [word() for _ in range(r.randint(30, 160))]
        for _ in range(r.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 4, 6])):
                w[r.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    for k in range(60):  # a passage that many share, at all proportions
        rows.append((i, " ".join([*passage, *[word() for _ in range(k)]])))
        i += 1
    return rows


def test_same_components_as_brute_force(spark):
    rows = [*corpus(), (900, None), (901, ""), (902, "two words"), (903, "TWO words"), (904, " \n"), (905, "two"), (906, "w " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as n", "'x' as keys", "true as kept")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    t = " ".join(f"word{i}" for i in range(30))
    rows = [(5, t), (5, t), (None, t), (7, t), (None, "alone " * 3), (8, "other " + t)]
    out = sorted(str((r["doc_id"], r["component_id"], r["kept"])) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == sorted(map(str, [(5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (None, None, True), (None, 5, False)]))


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exact_rest_misses_nothing(spark):
    """The prefix join alone, over all documents as single components, holds every link."""
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = docs.selectExpr("doc_id as node", "doc_id as c")
    sets = nd.sets_of(docs, nodes.select("node"))
    links = {tuple(sorted((r["a"], r["b"]))) for r in nd.verified(nd.prefix_pairs(nodes, sets), sets).collect()}
    s = {i: set(nd.shingles(t.encode(), nd.word_hashes()).tolist()) for i, t in rows}
    want = {(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])}
    assert links == want


def test_keys_are_minwise():
    rng = np.random.default_rng(0)
    same = total = 0
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:80], rng.integers(0, 1 << 63, 20, dtype=np.uint64)]))
        same += (nd.keys(a) == nd.keys(b)).sum()
        total += 2 * nd.TABLES
    j = 80 / 120
    assert abs(same / total - j**nd.ROWS) < 0.05


@pytest.mark.parametrize("local", [0, 1000])
def test_components_of_chains_and_stars(spark, local):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 200), (200, 250)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3), local).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 200: 200, 250: 200, 300: 200}
