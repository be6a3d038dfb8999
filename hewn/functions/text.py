"""Text and code features as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers and patterns.
ENTRYPOINT = (
    r"def\s+main\s*\(|function\s+main\s*\(|func\s+main\s*\(|int\s+main\s*\(|fn\s+main\s*\(|public\s+static\s+void\s+main\s*\("
    r"|argparse\.ArgumentParser|click\.|typer\.|commander\.|yargs\.|cobra\.|clap\.|app\.listen\s*\(|uvicorn\.run\s*\(|flask\.Flask\s*\("
    r"|FastAPI\s*\(|http\.ListenAndServe\s*\(|actix_web::\w+"
)
EXAMPLE_MARKERS = ["# example", "# usage", "# demo", "example:", "usage:", "demo:", 'if __name__ == "__main__":', ">>> "]
GENERATED_MARKERS = [
    "auto-generated", "autogenerated", "automatically generated", "do not edit", "do not modify", "generated by", "this file is generated",
    "code generated by", "machine generated", "computer generated",
]
INTEGRATION = ["integration", "e2e", "end2end", "functional", "database", "db", "api", "http", "server", "docker", "container", "selenium", "playwright"]
COMMENT_MARKS = ["#", "//", "/*", "*/", "<!--", "-->", "'''", '"""']
TYPE_WEIGHT = {"class": 0.9, "function": 0.7, "import": 0.9, "docstring": 0.5, "comment": 0.2}


def approx_tokens(text: Column, chars: float = 4.0) -> Column:
    """max(1, floor(length / chars)); null text counts 1."""
    return F.greatest(F.lit(1), F.floor(F.coalesce(F.length(text), F.lit(0)) / F.lit(chars))).cast("long")


def chunk_tokens() -> Column:
    """``full_tokens`` where positive, else a quarter of the content's length, rounded up."""
    by_length = F.ceil(F.coalesce(F.length("content"), F.lit(0)) / F.lit(4.0))
    return F.when(F.col("full_tokens") > 0, F.col("full_tokens")).otherwise(by_length).cast("long")


#: DuckDB's form of chunk_tokens().
CHUNK_TOKENS_SQL = "CAST(CASE WHEN full_tokens > 0 THEN full_tokens ELSE ceil(coalesce(length(content), 0) / 4.0) END AS BIGINT)"


def scan_tokens(size: Column, lines: Column) -> Column:
    """max(size // 4, int(size / 3.2), 10 lines)."""
    return F.greatest(F.floor(size / 4), F.floor(size / F.lit(3.2)), lines * 10).cast("long")


def any_of(text: Column, needles: list[str]) -> Column:
    """Whether the text contains one of the strings."""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def generated_score(text: Column) -> Column:
    """.4 per marker in the first ten lines, .2 if under 30 % of lines differ, .3 if over 10 % exceed 200 characters, .1 without comments; at most 1."""
    head = F.slice(F.transform(lines(text), lambda x: F.trim(x)), 1, 51)
    top = F.lower(F.array_join(F.slice(head, 1, 10), "\n"))
    score = F.lit(0.0)
    for m in GENERATED_MARKERS:
        score = score + F.when(F.contains(top, F.lit(m)), 0.4).otherwise(0.0)
    n = F.size(head)
    score = score + F.when(F.size(F.array_distinct(head)) < n * 0.3, 0.2).otherwise(0.0)
    score = score + F.when(F.size(F.filter(head, lambda x: F.length(x) > 200)) > n * 0.1, 0.3).otherwise(0.0)
    score = score + F.when(~any_of(F.array_join(head, "\n"), COMMENT_MARKS) & (n > 10), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def doc_density(content: Column, docstring: Column) -> Column:
    """(docstring + comment-line characters) / characters, at most 1; 0 for empty content."""
    notes = F.filter(lines(content), lambda x: F.trim(x).rlike(r"^(#|//|/\*|\*)"))
    size = F.aggregate(notes, F.lit(0).cast("long"), lambda a, x: a + F.length(F.trim(x)))
    n = F.length(content)
    return F.when(n > 0, F.least(F.lit(1.0), (F.coalesce(F.length(docstring), F.lit(0)) + size) / n)).otherwise(0.0)


def chunk_importance(content: Column, kind: Column) -> Column:
    """Weight by kind, times factors for exported, main, test and dense code; at most 1."""
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_WEIGHT.items() for x in kv]), kind), F.lit(0.5))
    low = F.lower(content)
    factor = (
        F.when(any_of(low, ["public", "export", "pub"]), 1.2).otherwise(1.0)
        * F.when(any_of(low, ["main", "init"]), 1.3).otherwise(1.0)
        * F.when(any_of(low, ["test", "example", "demo", "mock"]), 0.7).otherwise(1.0)
        * F.when(F.regexp_count(content, F.lit(r"[{}()\[\]]")) > 10, 1.1).otherwise(1.0)
    )
    return F.least(F.lit(1.0), base * factor)


def deterministic_id(path: Column, start: Column, end: Column, kind: Column, content: Column) -> Column:
    """First eight hex digits of SHA-256 over path|start|end|kind|first 100 characters; nulls are left out."""
    return F.substring(F.sha2(F.concat_ws("|", path, start.cast("string"), end.cast("string"), kind, F.substring(content, 1, 100)), 256), 1, 8)


def word_windows(words: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of ``size`` words with stride ``size - overlap``; none for no words."""
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(stride))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.slice(words, i + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def line_blocks(text: Column, size: int = 20) -> Column:
    """Blocks of ``size`` lines."""
    return F.transform(word_windows(lines(text), size, 0), lambda b: F.array_join(b, "\n"))


def truncated(text: Column, budget: int, chars: int = 4) -> Column:
    """The text cut at ``budget`` tokens, backed off to the last blank line if that keeps over 80 %."""
    cut = F.substring(text, 1, budget * chars)
    back = F.length(cut) - F.locate("\n\n", F.reverse(cut)) - 1
    return F.when(F.length(text) <= budget * chars, text).when(
        (F.locate("\n\n", F.reverse(cut)) > 0) & (back > 0.8 * budget * chars), F.substring(cut, F.lit(1), back)
    ).otherwise(cut)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def human_bytes(n: Column) -> Column:
    """1023 B, 1.5 KiB, 2.0 MiB, ..."""
    out, size = F.concat(n.cast("string"), F.lit(" B")), 1.0
    for unit in ("KiB", "MiB", "GiB"):
        size *= 1024
        out = F.when(n >= size, F.concat(F.format_number(n / size, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-|-$", "")
