"""Neighbour, cluster-quality, canonical-form, routing and synthetic queries (survey groups A15, B9, B24, C14, D24, D33, G4, H25, H26, H31, M4, O17)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hewn.functions import paths, text
from hewn.operators.neighbours import nearest
from hewn.plans.registry import query
from hewn.plans.scan import FILES_SQL, files
from hewn.sources.tables import table

TOK = text.CHUNK_TOKENS_SQL


@query("""
WITH q AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM q GROUP BY 1),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, sum(a.x * b.x) AS dot FROM q a JOIN q b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1, 2),
r AS (SELECT a, b, round(dot / x.n / y.n, 6) AS sim FROM s JOIN n x ON x.vec_id = a JOIN n y ON y.vec_id = b)
SELECT a AS vec_id, b AS other, sim, place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS place FROM r) WHERE place <= 5""")
def c14_knn_exact(spark, d, block: int = 4096):
    """The five nearest of every twentieth vector among all vectors; :func:`c14_knn_whole` has as many as the survey asks for."""
    return _nearest(spark, d, 5, block)


@query("""
WITH q AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM q GROUP BY 1),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, sum(a.x * b.x) AS dot FROM q a JOIN q b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1, 2),
r AS (SELECT a, b, round(dot / x.n / y.n, 6) AS sim FROM s JOIN n x ON x.vec_id = a JOIN n y ON y.vec_id = b), k AS (SELECT greatest(5, least(50, floor(sqrt(count(*))))) AS k FROM embeddings)
SELECT a AS vec_id, b AS other, sim, place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS place FROM r), k WHERE place <= k""")
def c14_knn_whole(spark, d, block: int = 4096):
    """The k nearest of every twentieth vector among all vectors, k being the root of the row count, at least 5 and at most 50."""
    return _nearest(spark, d, max(5, min(50, math.isqrt(table(spark, d, "embeddings").count()))), block)


def _nearest(spark, d, k: int, block: int):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return nearest(v.filter("id % 20 = 0"), v, k, block).withColumnRenamed("id", "vec_id")


@query("""
WITH p AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM p GROUP BY 1, 2),
s AS (SELECT p.label, vec_id, sum(power(x - c, 2)) AS d2 FROM p JOIN c USING (label, i) GROUP BY 1, 2)
SELECT label, count(*) AS size, round(sum(d2), 6) AS inertia, round(sqrt(max(d2)), 6) AS radius, round(count(*) / (1 + sqrt(max(d2))), 6) AS density FROM s GROUP BY 1""")
def d24_cluster_quality(spark, d):
    v = table(spark, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    c = v.groupBy("label", "i").agg(F.avg("x").alias("c"))
    s = v.join(c, ["label", "i"]).groupBy("label", "vec_id").agg(F.sum(F.pow(F.col("x") - F.col("c"), F.lit(2))).alias("d2"))
    r = F.sqrt(F.max("d2"))
    return s.groupBy("label").agg(F.count("*").alias("size"), F.round(F.sum("d2"), 6).alias("inertia"), F.round(r, 6).alias("radius"), F.round(F.count("*") / (1 + r), 6).alias("density"))


@query("""SELECT row_id, '{"end_line":' || end_line || ',"id":"' || id || '","start_line":' || start_line || '}' AS canonical FROM chunks WHERE id IS NOT NULL AND end_line IS NOT NULL""")
def h25_canonical_json(spark, d):
    c = table(spark, d, "chunks").filter("id is not null and end_line is not null")
    return c.select("row_id", F.to_json(F.struct("end_line", "id", "start_line")).alias("canonical"))


@query("""SELECT file_id, CASE WHEN lines_added >= 1048576 THEN format('{:.1f} MiB', lines_added / 1048576.0) WHEN lines_added >= 1024 THEN format('{:.1f} KiB', lines_added / 1024.0) ELSE lines_added || ' B' END AS human
FROM (SELECT file_id, max(lines_added) AS lines_added FROM git_files WHERE lines_added < 1000000000 GROUP BY 1)""")
def h31_human_bytes(spark, d):
    g = table(spark, d, "git_files").filter("lines_added < 1000000000").groupBy("file_id").agg(F.max("lines_added").alias("n"))
    return g.select("file_id", text.human_bytes(F.col("n")).alias("human"))


@query("""
WITH s AS (SELECT lower(regexp_extract(rel_path, '\\.([A-Za-z0-9]+)$', 1)) AS ext, repo_name, count(DISTINCT file_id) AS n FROM chunks GROUP BY 1, 2)
SELECT repo_name, ext, CASE WHEN n < 5 AND ext = 'py' THEN 'coverage' WHEN n < 5 THEN 'keyword' WHEN ext IN ('py', 'ts', 'js') THEN 'centrality' ELSE 'diverse' END AS algorithm FROM s""")
def m4_rule_routing(spark, d):
    ext = F.lower(F.regexp_extract("rel_path", r"\.([A-Za-z0-9]+)$", 1))
    s = table(spark, d, "chunks").groupBy("repo_name", ext.alias("ext")).agg(F.countDistinct("file_id").alias("n"))
    small = F.col("n") < 5
    return s.select("repo_name", "ext", F.when(small & (F.col("ext") == "py"), "coverage").when(small, "keyword").when(F.col("ext").isin("py", "ts", "js"), "centrality").otherwise("diverse").alias("algorithm"))


@query("""
WITH t AS (SELECT row_id, lower(kind) IN ('class', 'main', 'function') AS truth, coalesce(complexity_score, 0) >= 5 AS said FROM chunks WHERE kind IS NOT NULL),
c AS (SELECT count(*) FILTER (WHERE truth AND said) AS tp, count(*) FILTER (WHERE said) AS said, count(*) FILTER (WHERE truth) AS truth FROM t)
SELECT tp, round(tp * 1.0 / nullif(said, 0), 6)::DOUBLE AS precision, round(tp * 1.0 / nullif(truth, 0), 6)::DOUBLE AS recall, round(2.0 * tp / nullif(said + truth, 0), 6)::DOUBLE AS f1 FROM c""")
def o17_metrics(spark, d):
    t = table(spark, d, "chunks").filter("kind is not null").select(F.lower("kind").isin("class", "main", "function").alias("truth"), (F.coalesce("complexity_score", F.lit(0.0)) >= 5).alias("said"))
    c = t.agg(F.count_if(F.col("truth") & F.col("said")).alias("tp"), F.count_if("said").alias("said"), F.count_if("truth").alias("truth"))
    return c.select("tp", F.round(F.try_divide("tp", "said"), 6).alias("precision"), F.round(F.try_divide("tp", "truth"), 6).alias("recall"), F.round(F.try_divide(2.0 * F.col("tp"), F.col("said") + F.col("truth")), 6).alias("f1"))


@query(f"""WITH f AS ({FILES_SQL}) SELECT CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' END AS language,
 count(*) AS files, count(*) FILTER (WHERE regexp_matches(regexp_extract(lower(path), '([^/]*)$', 1), '^test_.*|.*_test\\.[^.]+$')) AS tests, count(*) FILTER (WHERE regexp_matches(lower(path), 'example|demo|sample|tutorial')) AS examples FROM f GROUP BY 1""")
def b9_languages(spark, d):
    name, p = paths.file_name(F.col("path")), F.lower("path")
    return files(spark, d).groupBy(paths.language(F.col("path")).alias("language")).agg(
        F.count("*").alias("files"), F.count_if(name.rlike(r"^test_.*|.*_test\.[^.]+$")).alias("tests"), F.count_if(p.rlike(paths.EXAMPLE_PATH)).alias("examples")
    )


@query("""SELECT CASE WHEN regexp_matches(lower(text), 'http|browser|render') THEN 'web' WHEN regexp_matches(lower(text), 'train|model|tensor') THEN 'ml' WHEN regexp_matches(lower(text), 'kernel|memory|lock') THEN 'systems' ELSE 'general' END AS domain,
 count(*) AS docs, round(avg(length(text)), 6) AS mean_length FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def b24_domain(spark, d):
    t = F.lower("text")
    dom = F.when(t.rlike("http|browser|render"), "web").when(t.rlike("train|model|tensor"), "ml").when(t.rlike("kernel|memory|lock"), "systems").otherwise("general")
    return table(spark, d, "documents").filter("text is not null").groupBy(dom.alias("domain")).agg(F.count("*").alias("docs"), F.round(F.avg(F.length("text")), 6).alias("mean_length"))


@query("""SELECT CASE doc_kind WHEN 'readme' THEN 4 WHEN 'handbook' THEN 3 WHEN 'design_note' THEN 3 WHEN 'changelog' THEN 2 ELSE 1 END AS tier, count(*) AS docs, round(avg(coalesce(length(text), 0)), 6) AS mean_length FROM documents GROUP BY 1""")
def d33_document_tiers(spark, d):
    k = F.col("doc_kind")
    tier = F.when(k == "readme", 4).when(k.isin("handbook", "design_note"), 3).when(k == "changelog", 2).otherwise(1)
    return table(spark, d, "documents").groupBy(tier.alias("tier")).agg(F.count("*").alias("docs"), F.round(F.avg(F.coalesce(F.length("text"), F.lit(0))), 6).alias("mean_length"))


@query("""SELECT item_id, len(list_intersect(list_distinct(string_split_regex(lower(question), '[^a-z0-9_]+')), list_distinct(string_split_regex(lower(gold.answer_text), '[^a-z0-9_]+')))) AS common FROM qa_items WHERE question IS NOT NULL AND gold.answer_text IS NOT NULL""")
def g4_common_terms(spark, d):
    words = lambda c: F.split(F.lower(c), "[^a-z0-9_]+")
    q = table(spark, d, "qa_items").filter("question is not null and gold.answer_text is not null")
    return q.select("item_id", F.size(F.array_intersect(words("question"), words("gold.answer_text"))).cast("long").alias("common"))


@query("""
WITH g AS (SELECT file_id, min(path) AS path, max(change_count) AS n, max(lines_added + lines_deleted) AS changed FROM git_files GROUP BY 1), t AS (SELECT max(n) AS n FROM g)
SELECT file_id, round(CAST(0.30 * least(1, changed / 500.0) + 0.25 * CASE WHEN regexp_matches(lower(path), 'test|spec') THEN 0.5 WHEN regexp_matches(lower(path), 'doc') THEN 0.3 ELSE 1.0 END + 0.20 * g.n * 1.0 / t.n AS DOUBLE), 6) AS relevance FROM g, t""")
def h26_change_relevance(spark, d):
    g = table(spark, d, "git_files").groupBy("file_id").agg(F.min("path").alias("path"), F.max("change_count").alias("n"), F.max(F.col("lines_added") + F.col("lines_deleted")).alias("changed"))
    p = F.lower("path")
    role = F.when(p.rlike("test|spec"), 0.5).when(p.rlike("doc"), 0.3).otherwise(1.0)
    score = 0.30 * F.least(F.lit(1.0), F.col("changed") / 500.0) + 0.25 * role + 0.20 * F.col("n") / F.col("top")
    return g.crossJoin(g.agg(F.max("n").alias("top"))).select("file_id", F.round(score, 6).alias("relevance"))


_EDGE_U = "((CAST('0x' || substr(md5(id || ':11'), 1, 7) AS BIGINT) + 1) / 268435458.0)"


@query(f"""WITH n AS (SELECT count(DISTINCT file_id) AS n FROM chunks), i AS (SELECT unnest(range(3 * (SELECT n FROM n))) AS id), u AS (SELECT id, {_EDGE_U} AS u, n FROM i, n),
e AS (SELECT id % n AS src, CAST(floor(u * u * u * n) AS BIGINT) AS far, u, n FROM u) SELECT DISTINCT 'power_law' AS form, src, far AS dst FROM e WHERE src <> far
UNION SELECT 'clustered', src, CAST(src // 20 * 20 + floor(u * 20) AS BIGINT) AS dst FROM e WHERE src <> CAST(src // 20 * 20 + floor(u * 20) AS BIGINT) AND CAST(src // 20 * 20 + floor(u * 20) AS BIGINT) < n""")
def a15_synthetic_graph(spark, d):
    """Seeded dependency graphs as large as the files table, made where they are used: one with a skewed in-degree, one in clusters of twenty."""
    n = table(spark, d, "chunks").select("file_id").distinct().count()
    u = (F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(":11"))), 1, 7), 16, 10).cast("long") + 1) / 268435458.0
    e = spark.range(3 * n).select((F.col("id") % max(1, n)).alias("src"), u.alias("u"))
    far = e.select(F.lit("power_law").alias("form"), "src", F.floor(F.col("u") * F.col("u") * F.col("u") * n).cast("long").alias("dst"))
    near = e.select(F.lit("clustered").alias("form"), "src", (F.floor(F.col("src") / 20) * 20 + F.floor(F.col("u") * 20)).cast("long").alias("dst")).filter(F.col("dst") < n)
    return far.unionByName(near).filter("src <> dst").distinct()
