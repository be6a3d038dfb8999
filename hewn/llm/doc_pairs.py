"""Functions paired with their documentation (problem 5)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hewn.llm import code
from hewn.session import bounded_batches, cut

# Words that add nothing to a name, and openings of placeholders, tags and pragmas.
FILLERS = frozenset("the a an this that function functions method methods to of for and is it helper routine procedure class does do in".split())
PLACEHOLDER = re.compile(r"(?:todo|tbd|fixme|xxx|n/a|docs? to be added|write docs|no description|placeholder)\b", re.I)
TAG = re.compile(r"\s*(?:[@:\\]\w+|\{@\w+|noqa\b|eslint|pylint|type:\s*ignore|ts-|tslint|prettier-|nolint|pragma\b|#?region\b|go:\w+|coverage:|istanbul\b|mypy:|flake8)", re.I)

#: A name and its version, as build banners give them.
BANNER = re.compile(r"[\w./@-]+\s+v?\d+(?:\.\d+)+\S*\Z")

_WORD = re.compile(r"[^\W_]+")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿฀-๿຀-໿က-႟ក-៿豈-﫿]")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")
_MARKER = re.compile(r"^\s*(?:/\*+!?|\*+/|//+!?|#+!?|\*(?!/))\s?|\s*\*+/\s*$")
_DOC_ATTRIBUTE = re.compile(r'^\s*#!?\[\s*doc\s*=\s*r?#*"|"#*\s*\]\s*$')
_LITERAL = re.compile(r"^[rRuU]{0,2}(\"\"\"|'''|\"|')|(\"\"\"|'''|\"|')$")
_CODE_LINE = re.compile(
    r"[;{}]\s*$|^[)\]}]|^\s*(?:return|raise|throw|import|from|assert|break|continue|pass|print|panic|use|let|const|var)\b[^.]*$"
    r"|^\s*(?:if|for|while|elif|else|try|except|with|def|class|switch|catch|match|fn|func)\b.*[:({]\s*$"
    r"|^\s*[\w.\[\]\"']+\s*(?:[-+*/|&:]?=)\s*\S|^\s*[\w.!:]+\(.*\)\s*,?$"
)


def clean(raw: str) -> str:
    """The text of a comment or literal without its markers."""
    if raw[:1] in "\"'rRuU" and _LITERAL.match(raw):
        return _LITERAL.sub("", raw).strip()
    if raw.startswith("#[") or raw.startswith("#!["):
        return _DOC_ATTRIBUTE.sub("", raw).strip()
    return "\n".join(_MARKER.sub("", _MARKER.sub("", x)).rstrip() for x in raw.split("\n")).strip()


def commented_out(text: str) -> bool:
    """Whether every line of a comment's text is a line of code."""
    lines = [x for x in text.split("\n") if x.strip()]
    return bool(lines) and all(_CODE_LINE.search(x) for x in lines)


def trivial(text: str, name: str) -> bool:
    """Whether documentation says nothing: blank, placeholder, rules and marks, tags, or the name's own words and fillers. Its length alone decides nothing."""
    text = text.strip()
    if not text or BANNER.match(text) or PLACEHOLDER.match(text.lstrip("([{-*=~#_ ")):
        return True
    body = " ".join(x for x in text.split("\n") if x.strip() and not TAG.match(x))
    if _UNSPACED.search(body):
        return False
    own = {w.lower() for w in _CAMEL.findall(name)} | {name.lower()} | {w.lower() for w in _WORD.findall(name)}
    return all(w in own or w in FILLERS for w in (x.lower() for x in _WORD.findall(body)))


def documented(content: str, lang: str, docstring: str | None, with_code: bool = True) -> list[tuple]:
    """(name, description, code) of every documented function in ``content``, and with null as description of the function that opens it if that has no documentation."""
    text = code.unify(content)
    masked = code.mask(text, lang)
    found = code.functions(text, masked, lang)
    out = []
    single = None
    if found and docstring and docstring.strip():
        outer = code.outermost(found)
        if len(outer) == 1:
            rest = masked[: outer[0].start] + masked[outer[0].end :]
            if not rest.replace(code.COMMENT, "").strip(" \t\n\r;\f"):
                single = outer[0]
    for m in found:
        docs = []
        if m is single:
            docs.append(docstring)
        if m.literal:
            docs.append(clean(text[m.literal[0] : m.literal[1]]))
        if m.above:
            joined = "\n".join(clean(text[a:b]) for a, b in m.above)
            if not commented_out(joined):
                docs.append(joined)
        best = next((d.strip() for d in docs if not trivial(d, m.name)), None)
        if best is not None or not masked[: m.start].strip(" \t"):
            out.append((m.name, best, text[m.sig : m.end].rstrip() if with_code else None))
    return out


def _notes(chunks: DataFrame) -> DataFrame:
    """(row_id, note) of the chunk rows with a comment chunk of their file on the lines directly above; of several such comments the last ingested. No content but the comments' is shuffled."""
    c = chunks.select(F.col("row_id").cast("long"), F.col("file_id").cast("long"), F.col("start_line").cast("int"), F.lower("kind").alias("kind"), "content", "ingested_at")
    after = F.col("start_line") + F.size(F.split(F.rtrim("content", F.lit("\r\n")), "\r\n|\r|\n"))
    comments = (
        c.filter("kind = 'comment' and content is not null and file_id is not null")
        .groupBy(F.col("file_id").alias("f"), after.alias("line"))
        .agg(F.max_by("content", F.struct("ingested_at", "row_id")).alias("note"))
    )
    rest = c.filter("kind is null or kind <> 'comment'").select("row_id", "file_id", "start_line").distinct()
    return rest.join(comments, (F.col("file_id") == F.col("f")) & (F.col("start_line") == F.col("line"))).select("row_id", "note")


def pairs(chunks: DataFrame, with_code: bool = True) -> DataFrame:
    """One row (row_id, func_name, description, code) per function or method with non-trivial documentation.

    Every copy of a chunk row counts. Null or empty content, unknown languages
    and functions without documentation give no row. Documentation is the
    chunk's ``docstring`` (if the chunk is one single function), the literal
    that opens the body, comments directly above, or a comment chunk of the
    same file that ends on the line before (of several the last ingested;
    ``ingested_at`` may be missing). Only undocumented functions that open their
    chunk are joined with comments. Contents are read in one narrow pass whose names are
    kept; with code they are read once more instead, so that no code is written. Extra columns are not read.
    """
    bounded_batches(chunks.sparkSession)
    if "ingested_at" not in chunks.columns:
        chunks = chunks.withColumn("ingested_at", F.lit(None).cast("timestamp"))
    src = chunks.filter("kind is null or lower(kind) <> 'comment'").filter("length(content) > 0").select(F.col("row_id").cast("long"), "rel_path", "language", "content", "docstring")
    names = ["row_id", "func_name", "description", "code"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            rows = []
            for row, path, language, content, doc in zip(*b.to_pydict().values()):
                lang = code.family(path, language)
                if lang:
                    rows += [(row, *x) for x in documented(content, lang, doc, with_code)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, types)], names=names)

    @F.pandas_udf("string")
    def said(name, note):
        import pandas as pd

        texts = [clean_block(t) for t in note]
        return pd.Series([None if trivial(t, n) or commented_out(t) else t for n, t in zip(name, texts)], dtype=object)

    scanned = src.mapInArrow(run, "row_id long, func_name string, description string, code string")
    if not with_code:
        scanned = cut(scanned)
    inside = scanned.filter("description is not null")
    opening = scanned.filter("description is null").drop("description")
    above = opening.join(_notes(chunks), "row_id").select("row_id", "func_name", said("func_name", "note").alias("description"), "code").filter("description is not null")
    return inside.unionByName(above)


def clean_block(content: str) -> str:
    """The text of a chunk that is a comment."""
    return "\n".join(clean(x) for x in re.split(r"(?<=\*/)\n", code.unify(content).strip()))
