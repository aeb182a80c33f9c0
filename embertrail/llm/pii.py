"""Personal data by bootstrapped contextual extraction.

Base rules find e-mail addresses, IP addresses, card and phone numbers by form; they are seeds. Two more kinds have seeds of strict form,
which are no spans by themselves: account numbers whose check digits hold, and secrets, long runs of mixed letters and digits. Looser forms
of every kind give candidates. A pattern is what stands beside a mention: the word before it, the two words before it, the word after it,
or one on each side; words of marks only, such as '=', count as words. Spark counts how often patterns meet instances, and how often a
pattern's words occur at all; then the pattern-instance graph is scored in rounds: a pattern's confidence is the summed score of the
instances in it over all occurrences of its words, a candidate's score the noisy-or of its patterns. Patterns with enough different seeds
and high confidence add the mentions of their kind that stand in them; base spans stay as they are.

Texts are only read in Arrow passes; what is shuffled are mentions and counts. With no candidate anywhere there is nothing to find and
the graph is skipped.

Defined cases: null and empty texts have no spans; equal texts get equal spans; null ids stay; an empty table gives an empty result;
positions are code points, ends exclusive; where added spans touch, the longest stays.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, ready, release, spread, table
from .features import Cache

KINDS = ("email", "ip", "card", "phone")
#: All kinds, in the order of equal starts.
ALL = (*KINDS, "account", "secret")
Span = tuple[str, int, int]
# The base forms. A start inside a run of digits can only match where the run's own start does.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Looser forms, by kind: form, and the numbers of digits allowed (None: any).
LOOSE = {
    "email": (re.compile(r"(?<!\S)[^\s@,;<>()\[\]\"']+(?:@|[\[(]at[\])])[^\s@,;<>()\[\]\"']{2,}|(?<!\S)[\w.+-]+ (?:\(at\)|\[at\]) [\w.-]{2,}"), None),
    "ip": (re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,6}:[0-9A-Fa-f]{1,4}(?![\w:])"), None),
    "card": (re.compile(r"(?<![\w+.-])[0-9]{4}(?:[ .-]?[0-9]{4}){2,3}(?:[ .-]?[0-9]{1,4})?(?![\w-])"), (12, 19)),
    "phone": (re.compile(r"(?<![\w+.-])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){1,4}(?![\w-])"), (7, 15)),
    "account": (re.compile(r"(?<![\w-])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[A-Z]{1,3}[ -]?[0-9]{6,12}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"), (6, 34)),
    "secret": (re.compile(r"(?<![\w+/=.@-])[A-Za-z0-9_+/-]{8,}={0,2}(?![\w+/=@-])"), (2, 10_000)),
}
#: Letters and digits of a seed of kind secret, and how many different ones.
LONG_SECRET, VARIED = 24, 8
SEEDS, ALPHA, CONFIDENT, ROUNDS, SLOTS = 3, 1.0, 0.5, 3, 1 << 22
_EDGE = ".,;:!?*$#%&\"'()[]{}<>|/\\-_=+~`^@"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """The base rules' spans by start, then kind."""
    out: list[Span] = []
    if not text:
        return out
    end, at = 0, text.find("@")
    while at >= 0:
        low = at  # the run of local characters before the @, after the last match
        while low > end and (text[low - 1].isascii() and (text[low - 1].isalnum() or text[low - 1] in "._%+-")):
            low -= 1
        if low < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", low, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(m[0].count, "0123456789")) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _iban(raw: str) -> bool:
    """The check digits of an account number hold."""
    s = raw.replace(" ", "")
    return 15 <= len(s) <= 34 and s[:2].isalpha() and s[2:4].isdigit() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def is_seed(kind: str, raw: str) -> bool:
    """A mention of a further kind whose form alone is strict enough to learn patterns from."""
    if kind == "account":
        return _iban(raw)
    return kind == "secret" and len(raw) >= LONG_SECRET and len(set(raw)) >= VARIED


class _Taken:
    """Whether a span touches one of a list, by the list's order of starts."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted((s, e) for _, s, e in spans)
        self.ends = list(accumulate((e for _, e in self.spans), max))

    def touches(self, start: int, end: int) -> bool:
        at = bisect_left(self.spans, (end,))
        return at > 0 and self.ends[at - 1] > start


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Spans of looser forms, and of the further kinds, that touch no base span."""
    out: list[Span] = []
    taken = _Taken(base)
    digits = _DIGIT.search(text) is not None
    for kind, (form, allowed) in LOOSE.items():
        if not (("@" in text or "at)" in text or "at]" in text) if kind == "email" else digits):
            continue
        for m in form.finditer(text):
            n = sum(map(m[0].count, "0123456789"))
            if kind == "secret" and not any(c.isalpha() for c in m[0]):
                continue
            if (allowed is None or allowed[0] <= n <= allowed[1]) and not taken.touches(m.start(), m.end()):
                out.append((kind, m.start(), m.end()))
    return out


def _plain(word: str) -> str:
    return word.lower().strip(_EDGE) or word


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:7], "little") + 1


_MASK = (1 << 62) - 1


def _keys(two, one, after):
    """Keys of the patterns of words, for numbers or arrays: the word before, two words before, the word after, one on each side."""
    return ((one * 3 + 1) & _MASK, (two * 1_000_003 + one * 31 + 7) & _MASK, (after * 5 + 2) & _MASK, (one * 998_244_353 + after * 17 + 3) & _MASK)


def _before(text: str, at: int) -> tuple[str, int]:
    """The word that ends at or before a position, and its start; marks that touch the position are skipped."""
    first = True
    while at > 0:
        end = at
        while end > 0 and text[end - 1].isspace():
            end -= 1
        start = end
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        word = text[start:end]
        if word and not (first and end == at and not word.strip(_EDGE)):
            return word, start
        first, at = False, start
    return "", 0


def _after(text: str, at: int) -> str:
    """The word that begins after a position; the rest of the word at the position is skipped if it is marks only."""
    end = at
    while end < len(text) and not text[end].isspace():
        end += 1
    if text[at:end].strip(_EDGE):
        return text[at:end]
    while end < len(text) and text[end].isspace():
        end += 1
    start = end
    while end < len(text) and not text[end].isspace():
        end += 1
    return text[start:end]


def contexts(text: str, start: int, stop: int) -> list[int]:
    """Keys of the patterns that a mention stands in."""
    one, at = _before(text, start)
    two = _before(text, at)[0] if one and at else ""
    after = _after(text, stop)
    h = [_hash(_plain(w)) if w else 0 for w in (two, one, after)]
    there = (one, two, after, one and after)
    return [k for k, w in zip(_keys(*h), there, strict=True) if w]


def mentions(docs: DataFrame) -> DataFrame:
    """text -> one row per mention and pattern: text_key, kind, start, stop, known (a base span), seed, ident, pattern."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for text, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                base = base_spans(text)
                for known, spans in ((True, base), (False, candidates(text, base))):
                    for kind, s, e in spans:
                        ident = "".join(c for c in text[s:e].lower() if c.isalnum() or c in "@.")
                        seed = known or is_seed(kind, text[s:e])
                        rows += [(key, kind, s, e, known, seed, ident, p) for p in contexts(text, s, e)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.int64()), strict=True)], names)

    names = ["text_key", "kind", "start", "stop", "known", "seed", "ident", "pattern"]
    return docs.select("text", text_key(F.col("text")).alias("text_key")).mapInArrow(find, "text_key string, kind string, start long, stop long, known boolean, seed boolean, ident string, pattern long")


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def pattern_totals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern -> how often its words stand in the corpus. A bitmap of fixed size says which words may matter; a join then keeps the right ones."""
    slots = np.zeros(SLOTS, bool)
    slots[patterns.select((F.col("pattern") % SLOTS).alias("slot")).distinct().toArrow().column(0).to_numpy()] = True  # SLOTS rows at most
    bits = np.packbits(slots).tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        cache: Cache = Cache(lambda w: _hash(_plain(w)))
        n: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                words = text.split() if text else []
                h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
                keys = (_keys(h, h, h)[0], _keys(h[:-1], h[1:], h[1:])[1], _keys(h, h, h)[2], _keys(h[:-2], h[:-2], h[2:])[3])
                found = np.concatenate([k[wanted[k & np.uint64(SLOTS - 1)]] for k in keys])
                n.update(found.tolist())
                if len(n) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["pattern", "n"])
                    n.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["pattern", "n"])

    return docs.select("text").mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("total")).join(patterns.select("pattern").distinct(), "pattern")


def discover(docs: DataFrame) -> DataFrame | None:
    """text_key -> extra spans (array of kind, start, stop) found by confident patterns; None if there are none."""
    ready(docs.sparkSession)
    found = materialise(mentions(docs), "pii-mentions")
    loose = found.where(~F.col("known"))
    if loose.isEmpty():
        return None
    support = found.where("seed").groupBy("kind", "pattern").agg(F.countDistinct("ident").alias("seeds")).where(F.col("seeds") >= SEEDS)
    # only patterns that a candidate stands in can find one
    support = materialise(support.join(loose.select("kind", "pattern").distinct(), ["kind", "pattern"]), "pii-support")
    if support.isEmpty():
        return None
    edges = found.join(support.select("kind", "pattern"), ["kind", "pattern"], "left_semi").groupBy("kind", "ident", "pattern").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    totals = pattern_totals(docs, support)
    edges = materialise(edges.join(totals, "pattern", "left"), "pii-edges")
    scores = edges.groupBy("kind", "ident").agg(F.max("seed").cast("double").alias("score"))
    for _ in range(ROUNDS):
        meets = edges.join(scores, ["kind", "ident"])
        # words joined to a mention are not counted as words: there are at least as many occurrences as mentions
        confidence = meets.groupBy("kind", "pattern").agg((F.sum(F.col("n") * F.col("score")) / (F.greatest(F.coalesce(F.max("total"), F.lit(0)), F.sum("n")) + ALPHA)).alias("confidence"))
        confidence = materialise(confidence, "pii-patterns")
        doubt = F.exp(F.sum(F.log(F.lit(1.0) - F.least("confidence", F.lit(0.999))) * F.least("n", F.lit(3))))
        scores = materialise(edges.join(confidence, ["kind", "pattern"]).groupBy("kind", "ident").agg(F.when(F.max("seed"), F.lit(1.0)).otherwise(F.lit(1.0) - doubt).alias("score")), "pii-scores")
    release(support, edges)
    good = confidence.where(F.col("confidence") >= CONFIDENT).select("kind", "pattern")
    extra = loose.join(good, ["kind", "pattern"]).groupBy("text_key").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("extra"))
    extra = materialise(extra, "pii-extra")
    release(found, confidence, scores)
    return None if extra.isEmpty() else extra


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def with_extra(docs: DataFrame) -> DataFrame:
    """docs with a column _extra: the spans that the patterns add to each row's text."""
    extra = discover(docs)
    if extra is None:
        return docs.withColumn("_extra", F.lit(None).cast(SPANS))
    keyed = docs.withColumn("_text_key", text_key(F.col("text")))
    return keyed.join(extra.withColumnRenamed("text_key", "_text_key").withColumnRenamed("extra", "_extra"), "_text_key", "left").drop("_text_key")


def all_spans(base: list[Span], extra) -> list[Span]:
    """Base spans and those extra ones that touch no other, by start, kind, end."""
    out = list(base)
    for x in sorted(extra if extra is not None else (), key=lambda x: (-(x["stop"] - x["start"]), x["start"], ALL.index(x["kind"]))):
        if not any(s < x["stop"] and x["start"] < e for _, s, e in out):
            out.append((x["kind"], int(x["start"]), int(x["stop"])))
    return sorted(out, key=lambda s: (s[1], ALL.index(s[0]), s[2]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, counts and digest of the base spans, all spans, and how many of these the patterns added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text, extra in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                base = base_spans(text)
                n = Counter(k for k, _, _ in base)
                spans = all_spans(base, extra)
                for c, x in zip(cols, (*(n[k] for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base)), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:6]), pa.array(cols[6], pa.int64())], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_extra(docs.select("doc_id", "text")).select("doc_id", "text", "_extra")
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; the other columns as they are."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series, extra: pd.Series) -> pd.Series:
        out = []
        for text, more in zip(texts, extra, strict=True):
            if text:
                parts, at = [], 0
                for k, s, e in all_spans(base_spans(text), more):
                    if e > at:
                        parts += [text[at : max(s, at)], f"[{k.upper()}]" if s >= at else ""]
                        at = e
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    columns = docs.columns
    return with_extra(docs).withColumn("text", mask("text", "_extra")).select(*columns)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return find(spread(table(spark, sf_dir, "documents")))
