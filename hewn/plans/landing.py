"""Sources and sinks end to end: tables are written to the shared folder in a file format and read back through the readers (survey groups A5, A7, A11, A14, A17, A19, B15, B16)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hewn.plans.registry import query
from hewn.session import ensure_checkpoint_dir
from hewn.sources import files as sources
from hewn.sources import sinks
from hewn.sources.tables import table


def folder(spark) -> str:
    """A new folder in the shared one."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/landing-{uuid.uuid4().hex}"


@query("SELECT variant_id AS variant, count(*) AS n, round(avg(coverage_score), 6) AS mean FROM selection_results WHERE variant_id IS NOT NULL AND coverage_score IS NOT NULL AND isfinite(coverage_score) GROUP BY 1")
def a5_metric_lines(spark, d):
    """Coverage of the runs by way of JSON lines, among which some are broken; lines without a finite metric are dropped."""
    s = table(spark, d, "selection_results")
    good = s.select(F.to_json(F.struct(F.col("variant_id").alias("variant"), F.col("run_id").cast("string").alias("question_id"), F.col("coverage_score").alias("qa_score"))).alias("value"))
    at = folder(spark)
    good.unionByName(s.select(F.lit("{not json").alias("value"))).write.text(at)
    return sources.metrics(spark, at, "qa_score").groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg("qa_score"), 6).alias("mean"))


@query("SELECT lower(gold.annotator_id) AS annotator, count(*) AS n FROM qa_items WHERE gold.annotator_id IS NOT NULL AND gold.confidence_score IS NOT NULL AND repo_id IS NOT NULL GROUP BY 1")
def a7_annotations(spark, d):
    """Ratings of the questions by way of sixteen annotation documents; annotations that lack a field are dropped."""
    q = table(spark, d, "qa_items")
    a = F.collect_list(F.struct(F.lower("gold.annotator_id").alias("annotator_id"), F.col("repo_id").alias("file_path"), F.floor(F.col("gold.confidence_score") * 5).cast("int").alias("relevance_score")))
    at = folder(spark)
    q.groupBy((F.col("item_id") % 16).alias("doc")).agg(a.alias("annotations")).write.partitionBy("doc").json(at)
    return sources.annotations(spark, f"{at}/doc=*").groupBy(F.col("annotator_id").alias("annotator")).agg(F.count("*").alias("n"))


_DIFF_SQL = """l AS (SELECT row_id, rel_path, start_line, string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM chunks WHERE content IS NOT NULL AND regexp_matches(rel_path, '^\\S+$')),
x AS (SELECT row_id AS patch_id, rel_path AS file_path, CASE WHEN start_line = 1 THEN 'added' ELSE 'modified' END AS change_type, len(list_filter(ls[1:3], lambda y: NOT starts_with(y, '++'))) AS additions, len(list_filter(ls[4:5], lambda y: NOT starts_with(y, '--'))) AS deletions FROM l)"""


def _diffs(spark, d):
    c = table(spark, d, "chunks").filter("content is not null").filter(F.col("rel_path").rlike(r"\A\S+\z"))
    ls = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")
    marked = lambda lo, n, sign: F.transform(F.slice(ls, lo, n), lambda x: F.concat(F.lit(sign), x))
    head = F.concat(F.lit("diff --git a/"), "rel_path", F.lit(" b/"), "rel_path", F.when(F.col("start_line") == 1, "\nnew file mode 100644").otherwise(""), F.lit("\n--- a/"), "rel_path", F.lit("\n+++ b/"), "rel_path", F.lit("\n@@ -1 +1 @@\n"))
    patch = F.concat(head, F.array_join(F.concat(marked(1, 3, "+"), marked(4, 2, "-")), "\n"))
    return sources.diffs(c.select(F.col("row_id").alias("patch_id"), patch.alias("patch")))


@query(f"WITH {_DIFF_SQL} SELECT * FROM x")
def a11_diffs(spark, d):
    """Unified diffs, one per chunk with a path without blanks, made from its first lines and parsed back."""
    return _diffs(spark, d).select("patch_id", "file_path", "change_type", F.col("additions").cast("long").alias("additions"), F.col("deletions").cast("long").alias("deletions"))


@query(f"WITH {_DIFF_SQL}, s AS (SELECT rel_path AS file_path, max(coalesce(centrality_score, 0)) AS score FROM chunks GROUP BY 1) SELECT patch_id, round(score, 6) AS score FROM x JOIN s USING (file_path) WHERE score >= 0.5")
def b16_relevant_diffs(spark, d):
    """Diffs within the size limit (B15), of files whose score reaches one half."""
    scores = table(spark, d, "chunks").groupBy(F.col("rel_path").alias("file_path")).agg(F.max(F.coalesce("centrality_score", F.lit(0.0))).alias("score"))
    return sources.relevant_diffs(_diffs(spark, d), scores, 0.5).select("patch_id", F.round("score", 6).alias("score"))


@query("SELECT variant_id AS system, count(*) AS rows, count(DISTINCT variant_id) AS files, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM selection_results GROUP BY 1")
def a14_collected_results(spark, d):
    """Result files of all variants, one folder each, collected by a glob into one table that knows where its rows come from."""
    at = folder(spark)
    r = table(spark, d, "selection_results").select(F.col("variant_id").alias("system"), F.col("variant_id").alias("part"), "repo_name", F.col("total_tokens").cast("int").alias("tokens_used"))
    r.write.partitionBy("part").json(at)
    got = sources.results(spark, f"{at}/part=*/*.json")
    return got.groupBy("system").agg(F.count("*").alias("rows"), F.countDistinct(F.regexp_extract("source_file", "part=([^/]*)/", 1)).alias("files"), F.sum("tokens_used").alias("tokens"))


@query("SELECT repo_name, CAST(sum(length(rel_path) + length(coalesce(content, '')) + 15) AS BIGINT) AS chars FROM chunks WHERE rel_path IS NOT NULL AND regexp_matches(repo_name, '^[A-Za-z][A-Za-z0-9_-]*$') GROUP BY 1")
def a17_written_packs(spark, d):
    """Packs of all chunks of a repository as Markdown files, by their length in characters."""
    at = folder(spark)
    c = table(spark, d, "chunks").filter("rel_path is not null").filter(F.col("repo_name").rlike(r"\A[A-Za-z][A-Za-z0-9_-]*\z"))
    sinks.write_pack(c.select(F.col("repo_name").alias("pack_id"), F.col("row_id").alias("position"), F.col("rel_path").alias("path"), "content"), at, "markdown")
    return spark.read.text(at, wholetext=True).groupBy(F.col("pack_id").alias("repo_name")).agg(F.sum(F.length("value")).alias("chars"))


@query("SELECT f AS form, count(*) AS rows, CAST(sum(run_id) AS BIGINT) AS ids, CAST(sum(iterations) AS BIGINT) AS iterations FROM selection_results, (VALUES ('csv'), ('json'), ('parquet')) t(f) GROUP BY 1")
def a19_exports(spark, d):
    """Runs exported in every form and read back."""
    s = table(spark, d, "selection_results").select("run_id", "variant_id", "iterations", "coverage_score")
    out = None
    for form in ("csv", "json", "parquet"):
        at = folder(spark)
        sinks.export(s, at, form)
        back = spark.read.schema(s.schema).option("header", True).format(form).load(at)
        one = back.agg(F.lit(form).alias("form"), F.count("*").alias("rows"), F.sum("run_id").alias("ids"), F.sum("iterations").alias("iterations"))
        out = one if out is None else out.unionByName(one)
    return out
