"""Pack sinks: JSON, Markdown, plain text, HTML, CSV and JSON-lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(c: Column) -> Column:
    """Text safe inside HTML or XML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def section(path: Column, content: Column, form: str) -> Column:
    """One file of a pack as json, markdown, plain, html or xml. Null content is empty."""
    body = F.coalesce(content, F.lit(""))
    if form == "json":
        return F.to_json(F.struct(path.alias("path"), body.alias("content")))
    if form == "markdown":
        return F.concat(F.lit("## "), path, F.lit("\n\n```\n"), body, F.lit("\n```\n"))
    if form == "html":
        return F.concat(F.lit("<section><h2>"), escaped(path), F.lit("</h2><pre>"), escaped(body), F.lit("</pre></section>"))
    if form == "xml":
        return F.concat(F.lit('<document path="'), escaped(path), F.lit('">'), escaped(body), F.lit("</document>"))
    if form == "plain":
        return F.concat(F.lit("=" * 16 + "\n"), path, F.lit("\n" + "=" * 16 + "\n"), body, F.lit("\n"))
    raise ValueError(f"unknown form {form}")


def write_pack(rows: DataFrame, folder: str, form: str = "markdown") -> None:
    """Writes (pack_id, position, path, content) as text files, one folder per pack, sections in order; nothing is gathered."""
    out = rows.select("pack_id", "position", section(F.col("path"), F.col("content"), form).alias("value"))
    out.repartitionByRange("pack_id", "position").sortWithinPartitions("pack_id", "position").select("pack_id", "value").write.mode("overwrite").partitionBy("pack_id").text(folder)


def export(rows: DataFrame, folder: str, form: str) -> None:
    """Writes a result table as csv, json (lines) or parquet."""
    w = rows.write.mode("overwrite")
    {"csv": lambda: w.option("header", True).csv(folder), "json": lambda: w.json(folder), "parquet": lambda: w.parquet(folder)}[form]()
