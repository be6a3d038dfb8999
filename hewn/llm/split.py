"""Splitting oversized items at natural boundaries (problem 4).

Atomic segments (members, else paragraphs, else lines, else runs of
characters) are merged pairwise: a heap holds every adjacent pair by the
strength of the boundary between them, and the weakest boundary goes first as
long as the merged piece with its overlap stays under the limit.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hewn.llm import code
from hewn.session import bounded_batches

LIMIT = 4000
OVERLAP = 200

#: Strength of the boundary before a segment, by what begins there.
CHARACTER, LINE, STATEMENT, PARAGRAPH, MEMBER = 0, 1, 2, 3, 4

_LINE_END = re.compile(r"\r\n|\r|\n")


def members(text: str, lang: str | None, kind: str | None) -> list[code.Member]:
    """Methods if ``kind`` is class, else the outermost functions and classes that begin a line; ``text`` with \\n line ends."""
    if not lang or not text:
        return []
    masked = code.mask(text, lang)
    found = code.functions(text, masked, lang)
    if (kind or "").strip().lower() != "class":
        found += code.classes(masked, lang)
    return code.outermost(found)


def member_lines(content: str | None, lang: str | None, kind: str | None) -> list[int]:
    """Zero-based lines at which the members after the first begin, with what stands directly above them."""
    if not content:
        return []
    text = code.unify(content)
    out, at, n = [], 0, 0
    for m in members(text, lang, kind):
        n += text.count("\n", at, m.start)
        at = m.start
        out.append(n)
    return out[1:]


def _segments(content: str, lang: str | None, kind: str | None, room: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary before) of atomic segments, none longer than ``room`` code points."""
    at, lines = 0, []
    for m in _LINE_END.finditer(content):
        lines.append((at, m.end()))
        at = m.end()
    if at < len(content):
        lines.append((at, len(content)))
    starts = set(member_lines(content, lang, kind))
    masked = code.mask(code.unify(content), lang).split("\n") if lang else None
    out, blank = [], False
    for i, (a, b) in enumerate(lines):
        line = content[a:b]
        flush = bool(line[:1].strip()) and not (masked and i < len(masked) and masked[i][:1] in (code.STRING, ")", "}", "]"))
        strength = MEMBER if i in starts else PARAGRAPH if blank else STATEMENT if flush else LINE
        blank = not line.strip()
        for k in range(a, b, room):
            out.append((k, min(b, k + room), strength if k == a else CHARACTER))
    return out


def split_item(content: str | None, lang: str | None, kind: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, own start) of the pieces of ``content`` in code points.

    No piece is longer than ``limit``; a piece starts up to ``overlap`` code points
    before its own start, at a line if one begins there. Content within the
    limit is one piece; null and empty content give none. An overlap that leaves
    a piece no room of its own is an error.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if not content:
        return []
    if len(content) <= limit:
        return [(0, len(content), 0)]
    seg = _segments(content, lang, kind, limit - overlap)
    n = len(seg)
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    start, end, alive = [s[0] for s in seg], [s[1] for s in seg], [True] * n
    heap = [(seg[i][2], end[i] - start[i - 1], i) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        strength, size, i = heapq.heappop(heap)
        if not alive[i] or i == 0:
            continue
        p = prev[i]
        now = end[i] - start[p]
        if now + (overlap if start[p] else 0) > limit:
            continue
        if now != size:  # grown since; look again in its new place
            heapq.heappush(heap, (strength, now, i))
            continue
        end[p], alive[i], nxt[p] = end[i], False, nxt[i]
        if nxt[i] < n:
            prev[nxt[i]] = p
    out = []
    for i in range(n):
        if alive[i]:
            a = start[i]
            if a and overlap:
                lo = max(0, a - overlap)
                first = _LINE_END.search(content, lo, a)
                a = first.end() if lo and first and first.end() < a else lo
            out.append((a, end[i], start[i]))
    return out


def _source(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("row_id").cast("long"), F.col("start_line").cast("int"), "kind", "rel_path", "language", "content")


def boundaries(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(row_id, line_no) of each natural boundary between members in chunks longer than ``limit``; null content gives none."""
    bounded_batches(chunks.sparkSession)

    def run(batches):
        for b in batches:
            rows, lines = [], []
            for row, first, kind, path, language, content in zip(*b.to_pydict().values()):
                for n in member_lines(content, code.family(path, language), kind):
                    rows.append(row)
                    lines.append((first or 0) + n)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(lines, pa.int32())], names=["row_id", "line_no"])

    return _source(chunks).filter(F.length("content") > limit).mapInArrow(run, "row_id long, line_no int")


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces (row_id, piece, start_line, end_line, own_start, start_at, end_at, piece_text) of every chunk, in one narrow pass.

    Chunks within the limit come out whole as piece 0. Consecutive pieces
    overlap by up to ``overlap`` code points (``own_start`` is where the piece's
    own part begins). Null and empty content give no piece.
    """
    bounded_batches(chunks.sparkSession)
    names = ["row_id", "piece", "start_line", "end_line", "own_start", "start_at", "end_at", "piece_text"]
    types = [pa.int64(), *[pa.int32()] * 6, pa.string()]

    def run(batches):
        for b in batches:
            rows = []
            for row, first, kind, path, language, content in zip(*b.to_pydict().values()):
                at = n = 0
                for k, (a, e, own) in enumerate(split_item(content, code.family(path, language), kind, limit, overlap)):
                    n += len(_LINE_END.findall(content, at, a)) if a >= at else -len(_LINE_END.findall(content, a, at))
                    at = a
                    inner = len(_LINE_END.findall(content, a, e)) - (content[e - 1] in "\r\n")
                    rows.append((row, k, (first or 0) + n, (first or 0) + n + inner, own, a, e, content[a:e]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)], names=names)

    schema = "row_id long, piece int, start_line int, end_line int, own_start int, start_at int, end_at int, piece_text string"
    return _source(chunks).mapInArrow(run, schema)
