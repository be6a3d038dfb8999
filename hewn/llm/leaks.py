"""Evaluation texts leaking into training text (problem 9).

Items are short, documents long, so the question is containment. Documents are
cut into windows of bounded size, windows are partitioned by their number of
shingles, and each partition gets as many MinHash bands (of one row) as its
upper size bound and the fewest shingles that a passage shares at the threshold
need, so that a containment is missed with a bounded probability. Band values
of windows and passages are joined; candidates are verified on the exact
shingle runs. Two bitmaps of fixed size, of the passages' shingles and of their band
values, spare documents without either the join.
"""

from __future__ import annotations

import functools
import html
import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hewn.session import bounded_batches, cut

#: Words in a run, share of an item's words in runs, shingles of an item segment and of half a window, miss probability of the bands.
RUN, SHARE, SEGMENT, HALF, MISS = 6, 0.4, 24, 32, 1e-5
SIZES = (8, 16, 32, 64)
#: Bits of a bitmap, as a power of two: four megabytes each. A full bitmap lets more through and loses nothing.
BITS = 25
_PRIME = np.uint64(0x9E3779B97F4A7C15)

_WORD = re.compile(r"\w+")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\([nrt])|\\(.)")
_LINE_MARK = re.compile(r"^[\s>*|#/+-]*\d{1,3}[.):][ \t]", re.M)
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
#: The first sentence of a question (Java and Python regex).
OPENING = r"\A\s*(\S[^.?!]*[.?!])\s+(?=\S)"
_OPENING = re.compile(OPENING)


def words(text: str) -> list[str]:
    """The words of a text, alike under letter case, punctuation, spacing, Unicode form, escaping and marks at line starts."""
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " " if m[2] else m[3], text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = _LINE_MARK.sub(" ", text)
    return _WORD.findall(text.lower() if text.isascii() else text.casefold())


@functools.lru_cache(maxsize=1 << 19)
def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def shingles(text: str) -> np.ndarray:
    """Hashes of all runs of RUN words of a text, in order."""
    ids = np.fromiter(map(_word_hash, words(text)), np.uint64)
    n = len(ids) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(RUN):
        h = (h ^ (ids[k : k + n] + np.uint64(k + 1))) * _PRIME
        h ^= h >> np.uint64(29)
    return h


def fewest(size: int, share: float = SHARE) -> int:
    """Fewest shingles that cover ``share`` of a passage of ``size`` words."""
    return max(1, math.ceil(math.ceil(share * size - 1e-9) / RUN))


def bands_for(upper: int, segment: int = SEGMENT, shared: int = 2) -> int:
    """Bands that a window of up to ``upper`` shingles needs, so that ``shared`` shingles of a passage, each alone in a segment of ``segment``, are all missed with probability MISS at most."""
    jaccard = 1 / (upper + segment - 1)
    return math.ceil(math.log(MISS) / (shared * math.log(1 - jaccard)))


#: One factor per band; no window ever needs more bands.
_FACTORS = np.random.default_rng(17).integers(1, 2**63, bands_for(SIZES[-1], SEGMENT, 1), dtype=np.uint64) | np.uint64(1)


def _permuted(h: np.ndarray, i) -> np.ndarray:
    x = h * _FACTORS[i]
    return (x ^ (x >> np.uint64(32))) * _FACTORS[i]


def _key(low: np.ndarray, i) -> np.ndarray:
    """The join key of a band's value."""
    x = (low ^ np.asarray(i, np.uint64)) * _PRIME
    return x ^ (x >> np.uint64(31))


def segments(h: np.ndarray) -> list[np.ndarray]:
    return [np.unique(h[lo : lo + SEGMENT]) for lo in range(0, max(1, len(h) - SEGMENT // 2), SEGMENT // 2)]


def needs(h: np.ndarray, size: int, share: float = SHARE) -> list[int]:
    """Bands that windows of each size class need for a passage of ``size`` words."""
    return [max(bands_for(u, len(x), fewest(size, share)) for x in segments(h)) for u in SIZES]


def passage_keys(h: np.ndarray, size: int, share: float = SHARE) -> np.ndarray:
    """The keys of a passage: of each of its segments, as many bands as the largest windows need."""
    out = []
    for x in segments(h):
        i = np.arange(bands_for(SIZES[-1], len(x), fewest(size, share)))
        out.append(_key(_permuted(x[None, :], i[:, None]).min(1), i))
    return np.unique(np.concatenate(out))


def window_keys(h: np.ndarray, ends: np.ndarray, bands: list[int], known=None) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of the windows of documents whose shingles lie end to end in ``h``, up to ``ends``; only keys in the bitmap ``known``, if there is one."""
    starts = np.concatenate([[0], ends[:-1]])
    lows, docs, sizes, last = [], [], [], []
    for d in np.flatnonzero(ends > starts):
        s = np.arange(starts[d], ends[d], HALF)
        lows.append(s)
        docs.append(np.full(len(s), d))
        sizes.append(np.diff(np.append(s, ends[d])))
        last.append(np.arange(len(s)) == len(s) - 1)
    if not lows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lows, docs, sizes, last = map(np.concatenate, (lows, docs, sizes, last))
    size = sizes + np.where(last, 0, np.append(sizes[1:], 0))
    need = np.array(bands)[np.minimum(np.searchsorted(SIZES, size), len(SIZES) - 1)]
    found = []
    for i in range(max(bands)):
        live = need > i
        if not live.any():
            break
        low = np.minimum.reduceat(_permuted(h, i), lows)
        low = np.where(last, low, np.minimum(low, np.append(low[1:], low[-1:])))[live]
        key, here = _key(low, i), docs[live]
        if known is not None:
            hit = has(known, key)
            key, here = key[hit], here[hit]
        found.append((here, key))
    return tuple(np.concatenate(x) for x in zip(*found))


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - BITS)
    return h >> shift, (h * _PRIME) >> shift


def bitmap(h: np.ndarray) -> np.ndarray:
    """A bitmap with two bits of each hash."""
    bits = np.zeros(1 << BITS, bool)
    for at in _places(h):
        bits[at] = True
    return np.packbits(bits, bitorder="little")


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes are in a bitmap, but for a few that only seem to be."""
    a, b = ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 for at in _places(h))
    return (a & b).astype(bool)


def coverage(at: np.ndarray, h: np.ndarray, passage: np.ndarray, size: int) -> float:
    """Share of a passage's words in runs of RUN words or more that a document holds in the passage's order; ``h`` are shingles of the document and ``at`` their places, ascending."""
    places: dict[int, list[int]] = {}
    for p, x in enumerate(passage.tolist()):
        places.setdefault(x, []).append(p)
    runs: list[list[int]] = []
    open_: dict[int, list[int]] = {}
    for k in np.flatnonzero(np.isin(h, passage)).tolist():
        d = int(at[k])
        for p in places[int(h[k])]:
            r = open_.get(d - p)
            if r and r[0] + r[2] - RUN + 1 == d:
                r[2] += 1
            else:
                r = open_[d - p] = [d, p, RUN]
                runs.append(r)
    runs.sort()
    best: list[int] = []
    for k, (d, p, n) in enumerate(runs):
        gain = n
        for j in range(k):
            e, q, m = runs[j]
            if q < p and e < d:
                gain = max(gain, best[j] + min(n, p + n - max(p, q + m)))
        best.append(gain)
    return max(best, default=0) / size


def passages(items: DataFrame, share: float = SHARE) -> DataFrame:
    """(pid, item_id, size, h, need, keys) of the questions and answers of six words or more.

    First sentences that at least three questions and one in fifty begin with
    are left out; of those there are at most fifty. An item that is listed twice counts once.
    """
    rows = items.select(F.col("item_id").cast("long"), F.col("question").cast("string"), F.col("gold.answer_text").cast("string").alias("answer")).distinct()
    first = rows.select(F.regexp_extract("question", OPENING, 1).alias("first"))
    counts = first.groupBy("first").agg(F.count("*").alias("c")).crossJoin(rows.agg(F.count("*").alias("n")))
    openings = {r[0] for r in counts.filter("first <> '' and c >= greatest(3, n / 50)").select("first").collect()}
    texts = rows.select("item_id", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("question").alias("text")), F.struct(F.lit(1).alias("part"), F.col("answer").alias("text")))).alias("x")).select("item_id", "x.part", "x.text").filter("text is not null")
    texts = texts.select(F.xxhash64("item_id", "part", "text").alias("pid"), "item_id", "part", "text")

    def run(batches):
        for b in batches:
            out = []
            for pid, item, part, text in zip(*b.to_pydict().values()):
                m = _OPENING.match(text) if part == 0 else None
                if m and m[1] in openings:
                    text = text[m.end() :]
                h = shingles(text)
                if len(h):
                    size = len(h) + RUN - 1
                    out.append((pid, item, size, h.view(np.int64), needs(h, size, share), passage_keys(h, size, share).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, types)], names=["pid", "item_id", "size", "h", "need", "keys"])

    types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return texts.mapInArrow(run, "pid long, item_id long, size int, h array<long>, need array<int>, keys array<long>")


def _bitmaps(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the passages' shingles and keys: one pair of fixed size from each task, joined on the driver one after another."""

    def run(batches):
        both = [np.zeros(1 << (BITS - 3), np.uint8) for _ in range(2)]
        for b in batches:
            for bits, column in zip(both, b.columns):
                bits |= bitmap(column.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in both], names=["a", "b"])

    both = [np.zeros(1 << (BITS - 3), np.uint8) for _ in range(2)]
    for r in found.select("h", "keys").coalesce(16).mapInArrow(run, "a binary, b binary").toLocalIterator():
        for bits, x in zip(both, r):
            bits |= np.frombuffer(x, np.uint8)
    return both[0], both[1]


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, coverage) of each document that holds at least ``share`` of an item's question or answer in runs of six words.

    One narrow pass over the whole texts keeps the shingles and band values that
    the bitmaps know; band values are joined with the passages', and each candidate is verified. Null, empty and blank texts,
    items without text and passages under six words give no row; every copy of
    a document gives its rows; an item or document that is listed twice counts once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null and length(text) > 0")
    known = cut(passages(items, share))
    bands = list(known.agg(*[F.max(F.col("need")[k]) for k in range(len(SIZES))]).first())
    if bands[0] is None:
        return spark.createDataFrame([], "doc_id long, item_id long, coverage double")
    bits = spark.sparkContext.broadcast(_bitmaps(known))
    types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def scan(batches):
        own, band_bits = bits.value
        for b in batches:
            at, kept, ends, n = [], [], [], 0
            for text in b.column(1):
                h = shingles(text.as_py())
                where = np.flatnonzero(has(own, h))
                at.append(where.astype(np.int32))
                kept.append(h[where])
                n += len(where)
                ends.append(n)
            doc, key = window_keys(np.concatenate(kept), np.array(ends), bands, band_bits) if n else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            rows = []
            ids = b.column(0)
            for d in np.unique(doc):
                rows.append((ids[int(d)].as_py(), at[d], kept[d].view(np.int64), np.unique(key[doc == d]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, types)], names=["doc_id", "at", "h", "keys"])

    seen = cut(src.mapInArrow(scan, "doc_id long, at array<int>, h array<long>, keys array<long>"))
    met = seen.select("doc_id", F.explode("keys").alias("key")).join(known.select("pid", F.explode("keys").alias("key")), "key").select("doc_id", "pid").distinct()
    both = met.join(known.select("pid", "item_id", "size", F.col("h").alias("passage")), "pid").join(seen.select("doc_id", "at", "h"), "doc_id").select("doc_id", "item_id", "size", "passage", "at", "h")

    def verify(batches):
        for b in batches:
            rows = []
            numbers = lambda c, k: c[k].values.to_numpy(zero_copy_only=False)
            for k in range(b.num_rows):
                size = b.column(2)[k].as_py()
                c = coverage(numbers(b.column(4), k), numbers(b.column(5), k), numbers(b.column(3), k), size)
                if c >= share - 1e-9:
                    rows.append((b.column(0)[k].as_py(), b.column(1)[k].as_py(), c))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "coverage"])

    return both.mapInArrow(verify, "doc_id long, item_id long, coverage double").groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"))
