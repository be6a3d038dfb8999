"""File sources: repositories, JSON-lines metrics, annotations, question sets, diffs and result folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "variant string, question_id string, question string, question_type string, difficulty string, domain string"
ANNOTATIONS = "annotations array<struct<annotator_id:string,file_path:string,relevance_score:int,confidence_score:int,reasoning:string,annotation_timestamp:string,task_batch:string,repository:string>>"
RESULTS = "system string, budget int, seed int, repo_name string, question_id string, qa_score double, tokens_used int, latency_ms double, memory_mb double, selection_hash string, timestamp string, features map<string,string>, errors array<string>"


def repository(spark: SparkSession, root: str, most_bytes: int = 1 << 20) -> DataFrame:
    """(path, size, modified, content) of the text files under a folder; larger and compiled files are left out before they are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = raw.filter((F.col("length") <= most_bytes) & ~F.lower("path").rlike(r"\.(pyc|o|exe|dll|so|dylib)$"))
    return kept.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"))


def metrics(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """JSON lines with a variant, a question id and a finite ``metric``; other lines are dropped."""
    df = spark.read.schema(f"{METRICS}, `{metric}` double").option("mode", "DROPMALFORMED").json(path)
    return df.filter(F.col("variant").isNotNull() & F.col("question_id").isNotNull() & F.col(metric).isNotNull() & ~F.isnan(metric) & (F.abs(F.col(metric)) != float("inf")))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row per annotation of a JSON document; rows without an annotator, file or score are dropped."""
    rows = spark.read.schema(ANNOTATIONS).option("multiLine", True).json(path).select(F.explode("annotations").alias("a")).select("a.*")
    return rows.dropna(subset=["annotator_id", "file_path", "relevance_score"])


def results(spark: SparkSession, pattern: str) -> DataFrame:
    """Result files of a glob as one table, with the file each row came from."""
    return spark.read.schema(RESULTS).json(pattern).withColumn("source_file", F.input_file_name())


def diffs(patches: DataFrame) -> DataFrame:
    """(patch_id, file_path, change_type, additions, deletions, diff) of each file in unified diffs (patch_id, patch). Null patches give no rows."""
    parts = patches.filter("patch is not null").select("patch_id", F.explode(F.split("patch", r"(?m)^diff --git ")).alias("diff")).filter("diff <> ''")
    d = F.col("diff")
    lines = F.split(d, "\n")
    plus = F.size(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++")))
    minus = F.size(F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---")))
    kind = F.when(d.rlike(r"(?m)^new file"), "added").when(d.rlike(r"(?m)^deleted file"), "deleted").when(d.rlike(r"(?m)^rename from"), "renamed").otherwise("modified")
    return parts.select("patch_id", F.regexp_extract(d, r"^a/\S+ b/(\S+)", 1).alias("file_path"), kind.alias("change_type"), plus.alias("additions"), minus.alias("deletions"), "diff")


def relevant_diffs(rows: DataFrame, scores: DataFrame, least: float, most_chars: int = 100_000, most_lines: int = 1000) -> DataFrame:
    """Diffs of files whose score reaches ``least`` (no score counts 0), within a size and cut to a number of lines."""
    kept = rows.filter(F.length("diff") <= most_chars).join(scores, "file_path", "left").filter(F.coalesce("score", F.lit(0.0)) >= least)
    return kept.withColumn("diff", F.array_join(F.slice(F.split("diff", "\n"), 1, most_lines), "\n"))


def numstat(rows: DataFrame, line: str) -> DataFrame:
    """Adds added, deleted and path from lines of a history listing (added, deleted, path, tab-separated). Binary files ("-") count no lines; other lines are dropped."""
    parts = F.split(line, "\t")
    number = lambda k: F.coalesce(F.try_to_number(F.get(parts, F.lit(k)), F.lit("9999999999999")).cast("long"), F.lit(0).cast("long"))
    return rows.filter(F.col(line).rlike(r"^(\d+|-)\t(\d+|-)\t")).withColumn("added", number(0)).withColumn("deleted", number(1)).withColumn("path", F.get(parts, F.lit(2)))


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit, author, at, path, added, deleted) from a landed ``git log --numstat --format=%x1e%H%x1f%an%x1f%at`` listing, one record per commit."""
    raw = spark.read.option("lineSep", "\x1e").text(path).filter("value <> ''")
    head = F.split(F.element_at(F.split("value", "\n"), 1), "\x1f")
    lines = raw.select(head[0].alias("commit"), head[1].alias("author"), head[2].cast("long").alias("at"), F.explode(F.split("value", "\n")).alias("line"))
    return numstat(lines, "line").select("commit", "author", "at", "path", "added", "deleted")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path) of a landed ``git ls-files -z`` listing; empty names are dropped."""
    return spark.read.option("lineSep", "\0").text(path).filter("value <> ''").select(F.col("value").alias("path"))


def config(text: str) -> dict:
    """Settings from JSON, native or in the nested form with input, output, include and ignore, which is recognised and converted; missing values keep their defaults."""
    import json

    raw = json.loads(text) if text and text.strip() else {}
    out = {"include": [], "exclude": [], "max_bytes": 50 << 20, "output": "pack", "form": "markdown", "budget": 128_000}
    if any(isinstance(raw.get(k), dict) for k in ("output", "ignore", "input")):
        out |= {"include": raw.get("include", []), "exclude": raw.get("ignore", {}).get("customPatterns", [])}
        nested = {"max_bytes": raw.get("input", {}).get("maxFileSize"), "output": raw.get("output", {}).get("filePath"), "form": raw.get("output", {}).get("style")}
        return out | {k: v for k, v in nested.items() if v is not None}
    return out | {k: raw[k] for k in out if raw.get(k) is not None}
