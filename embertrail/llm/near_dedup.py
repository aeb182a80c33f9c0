"""Near-duplicate groups by MinHash with tensored banding.

A document's set are its distinct five-word shingles as 64-bit digests. Two collections of TABLES keys each are made from ROWS minhashes
a key; table (i, j) is keyed by the pair (A_i, B_j), so TABLES^2 tables of 2 * ROWS rows need only 2 * TABLES * ROWS minhashes. Two
documents of similarity s share a table unless all A or all B differ: at 0.75 that is about 1 in 10,000, at 0.8 about 1 in 75,000.

Candidates never come out as all pairs of a bucket:

0. documents with equal sets are one node, the least id among them;
1. keys A_i and B_j that nobody shares are dropped before pairs of them are formed (nothing is lost: such a pair is nobody else's);
2. each bucket ties its members to one pivot. A node first checks the pivot it shares most buckets with, on the full sets; pivots that
   are then still in other components are all checked;
3. where a bucket still holds several components, its nodes first check a few other pivots;
4. exact rest: every node of a bucket that is still mixed goes through an exact prefix-filter join (two sets at 0.75 share one of their
   rarest quarter of shingles), checking pairs in different components only. No cap on buckets or partners. So a link is lost only where
   its documents share no table; `exact=True` sends all nodes through the join and loses none.

Links within a component that are not needed to tie it together are not listed; the result is the component of every document.

Defined cases: null, empty and blank texts have empty sets and link with nothing; a text of fewer than five words is one shingle; equal
sets link; a row with a null id joins the component of an equal set, else has none (null) and is kept; rows that repeat an id are one
node and have the same result; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ready, release, spread, table
from .components import components
from .features import Cache

WORDS, PERCENT = 5, 75
TABLES, ROWS = 12, 2
#: Rounds with other pivots, and pivots a node checks in each. They save work; what they miss the exact rest finds.
PIVOTS, TRIES = 2, 3
_RNG = np.random.default_rng(7)
_XOR, _ODD = _RNG.integers(0, 1 << 63, 2 * TABLES * ROWS, dtype=np.uint64), _RNG.integers(0, 1 << 63, 2 * TABLES * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def word_hashes() -> Cache:
    return Cache(xxhash.xxh3_64_intdigest, 50_000)


def shingles(raw: bytes | None, cache: Cache) -> np.ndarray:
    """The set of a text: sorted distinct digests. bytes.lower() changes A-Z only."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mixed(out * np.uint64(31) + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def keys(s: np.ndarray) -> np.ndarray:
    """The 2 * TABLES keys of a set."""
    least = np.array([((s ^ x) * o).min() for x, o in zip(_XOR, _ODD, strict=True)], np.uint64).reshape(2 * TABLES, ROWS)
    out = np.arange(2 * TABLES, dtype=np.uint64)
    for r in range(ROWS):
        out = _mixed(out * np.uint64(31) + least[:, r])
    return out.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n, k1, k2 (a digest of the set), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_hashes()
        for b in batches:
            n, k1, k2, own = [], [], [], []
            for raw in b.column(1).to_pylist():
                s = shingles(raw, cache)
                n.append(len(s))
                k1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(_mixed(s ^ _M2).sum(dtype=np.uint64).view(np.int64)))
                own.append(keys(s).tolist() if len(s) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["doc_id", "n", "k1", "k2", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n long, k1 long, k2 long, keys array<long>")


def bitmap(ids: DataFrame, slot: Column, slots: int) -> bytes:
    """A bitmap of the slots that rows have, put together by Spark in rows of 4 KB."""
    at = slot + 1  # Spark's bitmaps count from 1
    rows = ids.select(at.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    out = bytearray((slots >> 15) + 1 << 12)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : (r["bucket"] - 1) * 4096 + len(r["bits"])] = r["bits"]
    return bytes(out)


def _slot(column: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(slots))


def _slots(n: int) -> int:
    """Bits for n ids: eight each, up to 16 MB. A fuller bitmap lets more rows pass, which later joins drop; none is lost."""
    return 1 << min(27, max(16, (8 * n).bit_length()))


def _marked(bits: bytes, slot: np.ndarray) -> np.ndarray:
    wanted = np.frombuffer(bits, np.uint8)
    return np.flatnonzero(wanted[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)


def _rough(s: np.ndarray) -> np.ndarray:
    """16 bits of each digest, sorted: a quarter of the set's bytes."""
    return np.sort((s >> np.uint64(48)).astype("<u2"))


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """node, s, rough (binary): the full sets of the documents whose ids are listed, and of a few more that the bitmap lets pass."""
    slots = _slots(ids.count())
    bits = bitmap(ids, _slot("node", slots), slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_hashes()
        for b in batches:
            at = _marked(bits, b.column(2).to_numpy())
            for lo in range(0, len(at), 256):
                some = pa.array(at[lo : lo + 256])
                sets = [shingles(t, cache) for t in b.column(1).take(some).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(some), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([_rough(s).tobytes() for s in sets], pa.binary())], ["node", "s", "rough"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary"))
    rows = rows.withColumn("slot", _slot("node", slots))
    return materialise(rows.mapInArrow(run, "node long, s binary, rough binary"), "dedup-sets")


def _near(sets: DataFrame, ids: DataFrame, column: str, what: str) -> DataFrame:
    """The sets of the ids, and a few more: a bitmap keeps the others from being shuffled. They are dealt by the join, even where the
    planner would broadcast its other side: else two Python workers run in one task, and both live on beside each other."""
    ids = ids.select(column).distinct()
    slots = _slots(ids.count())
    bits = bitmap(ids, _slot(column, slots), slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = pa.array(_marked(bits, b.column(2).to_numpy()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], [column, "x"])

    return sets.select("node", what, _slot("node", slots).alias("slot")).mapInArrow(run, f"{column} long, x binary").hint("merge")


def _alike(s: np.ndarray, t: np.ndarray) -> bool:
    """Sets without repeats that are similar enough."""
    both = len(s) + len(t)
    same = 0 if 100 * min(len(s), len(t)) < PERCENT * max(len(s), len(t)) else both - len(np.union1d(s, t))
    return 100 * same >= PERCENT * (both - same) > 0


def _told(raw: bytes) -> np.ndarray:
    """Equal 16-bit parts told apart by their turn, so that two sets have at least as many in common as their digests have."""
    v = np.frombuffer(raw, "<u2")
    return v.astype(np.int64) << 32 | (np.arange(len(v)) - np.searchsorted(v, v))


def _checked(pairs: DataFrame, sets: DataFrame, what: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _told if what == "rough" else lambda x: np.frombuffer(x, np.uint64)
        for batch in batches:
            keep = [_alike(read(x), read(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    b = pairs.join(_near(sets, pairs, "b", what).withColumnRenamed("x", "y"), "b")
    return materialise(b.join(_near(sets, pairs, "a", what), "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "dedup-links")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough, written. Rough sets go first: a quarter of the bytes, and what they reject
    the full sets would reject, too."""
    pairs = materialise(pairs, "dedup-pairs")
    some = _checked(pairs, sets, "rough")
    out = _checked(some, sets, "s")
    release(pairs, some)
    return out


def _labelled(rows: DataFrame, column: str, known: DataFrame, name: str) -> DataFrame:
    """rows with the component of a column's node, the node itself where it has no link."""
    return rows.join(known.select(F.col("node").alias(column), F.col("component").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))


def _close(n: Column, m: Column) -> Column:
    """Two sets of these sizes can be similar enough."""
    return (100 * n >= PERCENT * m) & (100 * m >= PERCENT * n)


def _open(tabled: DataFrame, known: DataFrame) -> DataFrame:
    """tabled (bucket, node, n) -> the same with the node's component c, only for buckets that hold several components."""
    labelled = _labelled(tabled.select("bucket", "node", "n"), "node", known, "c")
    mixed = labelled.groupBy("bucket").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("bucket")
    return materialise(labelled.join(mixed, "bucket", "left_semi"), "dedup-mixed")


def prefix_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """nodes (node, c) -> pairs in different components that share one of their rarest shingles: all pairs that may reach the similarity.

    Shingles of one component only are counted per document but not kept: they come first in its order of rarity and tie it to nobody."""

    def spell(bits: bytes | None, slots: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for node, c, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    s = np.frombuffer(raw, np.int64)
                    n = len(s)
                    s = s if bits is None else s[_marked(bits, s & (slots - 1))]
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(s), x)) for x in (node, c, n)), pa.array(s)], ["node", "c", "n", "shingle"])

        return own.mapInArrow(run, "node long, c long, n long, shingle long")

    own = sets.join(nodes.select("node", "c"), "node").select("node", "c", "s")
    often = spell(None, 0).groupBy("shingle").agg(F.count("*").alias("f"), F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("shingle", "f")
    often = materialise(often, "dedup-often")
    slots = _slots(often.count())
    shared = spell(bitmap(often, F.pmod("shingle", F.lit(slots)), slots), slots).join(often, "shingle")
    # a document's own shingles by rarity: its group is one document
    mine = Window.partitionBy("node")
    ranked = shared.withColumn("r", F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("f", "shingle")))
    first = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).select("shingle", "node", "c", "n", (F.col("n") - F.col("r")).alias("after"))
    first = materialise(first, "dedup-prefix")
    other = first.select("shingle", F.col("node").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("after").alias("after_b"))
    # what is shared from here on, and so at all where this is the first shared shingle, is bounded by what is left of either
    enough = (100 + PERCENT) * (1 + F.least("after", "after_b")) >= PERCENT * (F.col("n") + F.col("nb"))
    met = first.join(other, "shingle").where((F.col("node") < F.col("b")) & (F.col("c") != F.col("cb")) & _close(F.col("n"), F.col("nb")) & enough)
    return met.select(F.col("node").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id, kept. exact: the prefix join goes over all sets, not only those that share a table
    with another component, so that no link is lost by chance."""
    ready(docs.sparkSession)
    rows = materialise(sketches(docs), "dedup-sketches")
    full = rows.where("n > 0")
    nodes = full.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node"), F.any_value("keys").alias("keys"))
    nodes = materialise(nodes.where(F.col("node").isNotNull()), "dedup-nodes")
    # 1. keys that two nodes share at least
    spread = nodes.select("node", "n", F.posexplode("keys").alias("i", "key"))
    shared = spread.groupBy("i", "key").agg(F.count("*").alias("m")).where("m > 1").select("i", "key")
    held = spread.join(shared, ["i", "key"], "left_semi").groupBy("node", "n").agg(F.collect_list(F.struct("i", "key")).alias("ks"))  # 2 * TABLES at most
    one, two = F.filter("ks", lambda k: k["i"] < TABLES), F.filter("ks", lambda k: k["i"] >= TABLES)
    tabled = held.select("node", "n", F.explode(one).alias("x"), two.alias("two")).select("node", "n", "x", F.explode("two").alias("y")).select("node", "n", F.xxhash64("x.i", "y.i", "x.key", "y.key").alias("bucket"))
    tabled = materialise(tabled, "dedup-tables")
    # 2. one pivot a bucket: the least by a hash of the node, so that buckets agree on it
    pivots = tabled.groupBy("bucket").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n")).alias("p")).where("m > 1").select("bucket", F.col("p.node").alias("a"), F.col("p.n").alias("na"))
    met = materialise(tabled.join(pivots, "bucket"), "dedup-met")
    star = met.where((F.col("a") != F.col("node")) & _close(F.col("n"), F.col("na"))).groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("hits"))
    star = materialise(star, "dedup-star")
    sets = sets_of(docs, (nodes if exact else met).select("node").distinct())
    release(tabled)
    best = star.groupBy("b").agg(F.max(F.struct("hits", (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b")
    links = verified(best, sets)
    known = components(links)
    rest = _labelled(_labelled(star.select("a", "b"), "a", known, "ca"), "b", known, "cb").where("ca <> cb").select("a", "b").join(best, ["a", "b"], "left_anti")
    links = links.unionAll(verified(rest, sets))
    known = components(links)
    # 3. buckets that still hold several components: other pivots first, then the exact rest
    seen, open_ = star.select("a", "b"), met
    for salt in range(1, 1 + PIVOTS):
        open_, before = _open(open_, known), open_
        release(before)
        pivot = open_.groupBy("bucket").agg(F.min_by(F.struct("node", "c", "n"), F.xxhash64("node", F.lit(salt))).alias("p"))
        fits = (F.col("p.c") != F.col("c")) & _close(F.col("n"), F.col("p.n"))
        tries = open_.join(pivot, "bucket").where(fits).groupBy("node", F.col("p.node").alias("other")).agg(F.count("*").alias("hits"))
        turn = F.row_number().over(Window.partitionBy("node").orderBy(F.col("hits").desc(), "other"))
        tried = tries.withColumn("turn", turn).where(F.col("turn") <= TRIES).select(F.col("other").alias("a"), F.col("node").alias("b"))
        tried = materialise(tried.join(seen, ["a", "b"], "left_anti"), "dedup-tried")
        seen = seen.unionAll(tried)
        links = links.unionAll(verified(tried, sets))
        known, before = components(links), known
        release(before)
    if exact:
        mixed = _labelled(nodes.select("node"), "node", known, "c")
    else:
        mixed = _open(open_, known).select("node", "c").distinct()
    mixed = materialise(mixed, "dedup-open")
    if not mixed.isEmpty():
        seen = seen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        late = verified(prefix_pairs(mixed, sets).join(seen, ["a", "b"], "left_anti"), sets)
        if not late.isEmpty():
            known = components(links.unionAll(late))
    release(sets, open_, star, mixed)
    by_set = _labelled(nodes.select("k1", "k2", "n", "node"), "node", known, "component_id").select("k1", "k2", "n", "component_id")
    out = rows.drop("keys").join(by_set, ["k1", "k2", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] for i in range(1, len(ws) - 3)] END) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS same FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * same >= 75 * (x.n_shingles + y.n_shingles - same)),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT n.doc_id, n.n_shingles, g.component_id, n.doc_id = g.component_id AS kept FROM n JOIN (SELECT doc_id, MIN(root) AS component_id FROM r GROUP BY doc_id) g ON g.doc_id = n.doc_id
"""
