"""Best-fit packing with certified bounds.

Texts become token ids; documents longer than a sequence are cut into full pieces and a rest. Pieces are dealt into parts of bounded
size by hash, each part is packed best-fit decreasing, and a lower bound from dual feasible functions says how few sequences its pieces
need at least. Where a part used more than its bound, its sequences with gaps are opened; the parts with gaps exchange these documents
(they are dealt anew over fewer parts) and are packed again. It stops when the total meets the bound of the whole table, no part has a
gap left to trade, or a round brings nothing.

Only (row, lengths) rows are shuffled, never texts or ids. Word pieces are tokenised once per worker and cached: the tokenizer splits at
white space first, so a text's ids are those of its words in turn.

Defined cases: null and empty texts are the end id alone; repeated rows are packed once each; null ids are allowed; an empty table
gives an empty result; the special tokens' own strings in a text are read as the tokenizer file says (as those tokens).
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ready, spread, table
from .features import KEPT, Cache

CAPACITY, END = 4096, 1
#: Pieces in a part, and rounds of exchange.
PART_ROWS, ROUNDS = 20_000, 4


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: How the tokenizer file parts a lower-cased word, for words of printable ASCII and of Latin letters with accents.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff\u0100-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff\u0100-\u017f]+")
_PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
#: Byte-level vocabularies write a byte as the character of its number where that is visible, the others as those from 256 on, in turn.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
#: Words that a worker keeps the ids of.
KEPT_WORDS = 400_000


def word_ids(path: str, words: int = KEPT_WORDS) -> Cache:
    """word (bytes) -> its ids as little-endian unsigned 32-bit integers. A worker keeps its cache from task to task. Words of printable
    ASCII and accented Latin letters go to the tokenizer's model by pieces, which are cached too; all others, and special tokens, take the tokenizer's whole way."""
    if (path, words) not in KEPT:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        model = whole.model
        pieces = Cache(lambda p: np.array([t.id for t in model.tokenize(p.encode().decode("latin-1").translate(_LETTERS))], "<u4").tobytes(), words // 4, kept=True)

        def make(w: bytes) -> bytes:
            text = w.decode(errors="replace")
            if _PLAIN.fullmatch(text) and "<|" not in text:
                return b"".join([pieces[p] for p in _PIECES.findall(text.lower())])
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

        KEPT[path, words] = Cache(make, words, kept=True)
    return KEPT[path, words]


def lower_bound(lengths: np.ndarray, n: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins for n[i] items of lengths[i]. Two families of dual feasible functions, each giving ceil(sum f(x)):
    identity with thresholds (items over capacity - k count as a whole bin, those under k as nothing), and rounding down to
    multiples of 1/m after scaling by (m + 1)."""
    if not len(lengths):
        return 0
    best = -(-int((lengths * n).sum()) // capacity)
    for k in np.unique(lengths[lengths <= capacity // 2]):
        f = np.where(lengths > capacity - k, capacity, np.where(lengths < k, 0, lengths))
        best = max(best, -(-int((f * n).sum()) // capacity))
    for m in range(1, 33):
        whole = (lengths * (m + 1)) % capacity == 0
        f = np.where(whole, lengths * m, (lengths * (m + 1)) // capacity * capacity)  # in units of capacity * m
        best = max(best, -(-int((f * n).sum()) // (capacity * m)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the bins' fills. Open bins stand in stacks by what is left in them."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    stacks: dict[int, list[int]] = {}
    rests: list[int] = []  # sorted: the sizes of gaps that some bin has
    for i in order.tolist():
        x = int(lengths[i])
        at = bisect_left(rests, x)
        if at < len(rests):
            rest = rests[at]
            b = stacks[rest].pop()
            if not stacks[rest]:
                del stacks[rest]
                rests.pop(at)
        else:
            b, rest = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += x
        if rest := rest - x:
            if rest not in stacks:
                rests.insert(bisect_left(rests, rest), rest)
            stacks.setdefault(rest, []).append(b)
    return bins, offsets, np.array(fills, np.int64)


def tokenise(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep: tuple[str, ...] = ("doc_id",), words: int = KEPT_WORDS) -> DataFrame:
    """keep columns and text -> one row per piece: keep columns, piece, start, length, ids_crc32."""
    path = path or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_ids(path, words)
        for b in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(len(keep)).to_pylist()):
                ids = b"".join([cache[w] for w in text.split()] if text else []) + np.uint32(END).tobytes()
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    owner.append(i), piece.append(k), start.append(at // 4), length.append(len(own) // 4), crc.append(zlib.crc32(own))
            kept = [b.column(j).take(pa.array(owner, pa.int64())) for j in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names)

    names = [*keep, "piece", "start", "length", "ids_crc32"]
    ready(docs.sparkSession)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").cast("binary")).mapInArrow(cut, f"{kinds}, piece int, start long, length long, ids_crc32 long")


def _pack_parts(pieces: DataFrame, parts: int, round_: int, capacity: int) -> DataFrame:
    """Deals pieces over parts by hash and packs each; adds part, bin, offset, fill, part_bins, part_bound."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_key", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, fills = best_fit(lengths, capacity)
        sizes, n = np.unique(lengths, return_counts=True)
        return pdf.assign(_bin=bins, _offset=offsets, _fill=fills[bins], _bins=len(fills), _bound=lower_bound(sizes, n, capacity))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64("_key", "piece", F.lit(round_)), F.lit(parts)))
    return dealt.groupBy("_part").applyInPandas(pack, f"{fields}, _part long, _bin long, _offset long, _fill long, _bins long, _bound long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Pieces (with length) -> the same with sequence_id and offset."""
    spark = pieces.sparkSession
    ready(spark)
    own = pieces.columns
    # a key that spreads repeated rows too
    pieces = materialise(pieces.withColumn("_key", F.xxhash64(*own, F.spark_partition_id(), F.monotonically_increasing_id())), "packing-pieces")
    sizes = pieces.groupBy("length").count().toPandas()  # at most `capacity` rows
    bound = lower_bound(sizes["length"].to_numpy(np.int64), sizes["count"].to_numpy(np.int64), capacity)
    left, done, closed = pieces, None, 0
    n = int(sizes["count"].sum())
    for r in range(rounds):
        parts = max(1, -(-n // part_rows))
        packed = materialise(_pack_parts(left, parts, r, capacity), f"packing-{r}")
        # full sequences stay, and so do parts at their bound unless they are alone with a rest to trade
        last = r == rounds - 1 or parts == 1
        gap = (F.col("_bins") > F.col("_bound")) | (F.lit(parts > 1) & (F.col("_fill") * 2 < capacity))
        stay = F.lit(True) if last else (F.col("_fill") == capacity) | ~gap
        numbered = packed.where(stay).select(*own, (F.lit(r << 56) + F.col("_part") * F.lit(1 << 24) + F.col("_bin")).alias("sequence_id"), F.col("_offset").alias("offset"))
        done = numbered if done is None else done.unionAll(numbered)
        if last:
            break
        closed += packed.where(stay).groupBy("_part", "_bin").count().count()
        left = packed.where(~stay).select(*own, "_key")
        opened = packed.where(~stay)
        n, bins = opened.count(), opened.groupBy("_part", "_bin").count().count()
        if n == 0:
            break
        if closed + bins <= bound:  # the bound of all is met: keep what is there
            rest = opened.select(*own, (F.lit(r << 56) + F.col("_part") * F.lit(1 << 24) + F.col("_bin")).alias("sequence_id"), F.col("_offset").alias("offset"))
            done = done.unionAll(rest)
            break
    return done


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(tokenise(spread(table(spark, sf_dir, "documents")))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
