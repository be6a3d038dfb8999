"""Further queries: curation, quotas, scoring, baselines, paired tests, gates (survey groups B, D to J, L, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hewn.functions import paths, text
from hewn.operators import budget, stats
from hewn.operators.prefix import position, prefix_sum
from hewn.plans.analysis import _tf
from hewn.plans.registry import query
from hewn.plans.relational import _paired
from hewn.plans.scan import FILES_SQL, files
from hewn.sources.tables import table

TOK = text.CHUNK_TOKENS_SQL


@query(f"""WITH f AS ({FILES_SQL}) SELECT repo_name, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(lines) AS BIGINT) AS loc,
 count(*) >= 5 AND sum(lines) >= 200 AND bool_or(regexp_matches(lower(path), '(^|/)tests?/')) AS accepted FROM f GROUP BY 1""")
def b17_curation(spark, d):
    ok = (F.count("*") >= 5) & (F.sum("lines") >= 200) & F.bool_or(F.lower("path").rlike("(^|/)tests?/"))
    return files(spark, d).groupBy("repo_name").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("lines").alias("loc"), ok.alias("accepted"))


@query("""SELECT CASE WHEN regexp_matches(lower(question), 'which|why') THEN 'focused' ELSE 'full' END AS slice, count(*) AS n, round(avg(gold.confidence_score), 6) AS confidence FROM qa_items WHERE question IS NOT NULL GROUP BY 1""")
def b18_slices(spark, d):
    s = F.when(F.lower("question").rlike("which|why"), "focused").otherwise("full")
    return table(spark, d, "qa_items").filter("question is not null").groupBy(s.alias("slice")).agg(F.count("*").alias("n"), F.round(F.avg("gold.confidence_score"), 6).alias("confidence"))


@query(f"""WITH f AS ({FILES_SQL}), e AS (SELECT repo_name, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext, count(*) AS n, max(len(string_split(path, '/'))) AS depth FROM f GROUP BY 1, 2)
SELECT repo_name, CAST(sum(n) AS BIGINT) AS files, count(*) AS extensions, CAST(max(depth) AS BIGINT) AS depth, round(0.4 * least(1, sum(n) / 1000) + 0.3 * least(1, max(depth) / 10) + 0.3 * least(1, count(*) / 10), 6)::DOUBLE AS complexity,
 CASE WHEN sum(n) < 10 THEN 'small' WHEN sum(n) < 100 THEN 'medium' ELSE 'large' END AS bucket FROM e GROUP BY 1""")
def d30_context_features(spark, d):
    e = files(spark, d).groupBy("repo_name", paths.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"), F.max(F.size(F.split("path", "/"))).alias("dp"))
    n, one = F.sum("n"), F.lit(1.0)
    mix = 0.4 * F.least(one, n / 1000) + 0.3 * F.least(one, F.max("dp") / 10) + 0.3 * F.least(one, F.count("*") / 10)
    return e.groupBy("repo_name").agg(n.alias("files"), F.count("*").alias("extensions"), F.max("dp").cast("long").alias("depth"), F.round(mix, 6).alias("complexity"), F.when(n < 10, "small").when(n < 100, "medium").otherwise("large").alias("bucket"))


@query("""SELECT lower(gold.annotator_id) AS annotator, count(*) AS n, round(avg(gold.confidence_score), 6) AS mean, round(stddev_pop(gold.confidence_score), 6) AS std, round(corr(gold.confidence_score, length(question)), 6) AS by_length
FROM qa_items WHERE gold.confidence_score IS NOT NULL GROUP BY 1 HAVING count(*) >= 5""")
def d20_rater_bias(spark, d):
    q = table(spark, d, "qa_items").filter("gold.confidence_score is not null").select(F.lower("gold.annotator_id").alias("annotator"), F.col("gold.confidence_score").alias("c"), F.length("question").alias("n"))
    return q.groupBy("annotator").agg(F.count("*").alias("k"), F.round(F.avg("c"), 6).alias("mean"), F.round(F.stddev_pop("c"), 6).alias("std"), F.round(F.corr("c", "n"), 6).alias("by_length")).filter("k >= 5").withColumnRenamed("k", "n")


@query(f"""
WITH c AS (SELECT repo_name, row_id, CASE WHEN lower(kind) IN ('main', 'class') THEN 'core' WHEN lower(kind) = 'import' THEN 'config' ELSE 'general' END AS category, {TOK} AS tokens, coalesce(centrality_score, 0) AS s FROM chunks),
q AS (SELECT *, CASE category WHEN 'core' THEN 800 WHEN 'config' THEN 200 ELSE 1000 END AS quota, sum(tokens) OVER (PARTITION BY repo_name, category ORDER BY s DESC, row_id ROWS UNBOUNDED PRECEDING) AS cum FROM c)
SELECT repo_name, category, count(*) AS taken, CAST(sum(tokens) AS BIGINT) AS tokens FROM q WHERE cum <= quota GROUP BY 1, 2""")
def e4_quota_fill(spark, d):
    """Each category of a repository fills its own share of the budget, up to the first row that does not fit."""
    k = F.lower("kind")
    cat = F.when(k.isin("main", "class"), "core").when(k == "import", "config").otherwise("general")
    c = table(spark, d, "chunks").select("repo_name", "row_id", cat.alias("category"), text.chunk_tokens().alias("tokens"), F.coalesce("centrality_score", F.lit(0.0)).alias("s"))
    run = prefix_sum(c, ["repo_name", "category"], [F.desc("s"), F.col("row_id")], "tokens")
    quota = F.when(F.col("category") == "core", 800).when(F.col("category") == "config", 200).otherwise(1000)
    return run.filter(F.col("cum") <= quota).groupBy("repo_name", "category").agg(F.count("*").alias("taken"), F.sum("tokens").alias("tokens"))


@query("""WITH r AS (SELECT repo_name, coalesce(centrality_score, 0) AS s, row_number() OVER (PARTITION BY repo_name ORDER BY coalesce(centrality_score, 0) DESC, row_id) AS rn, count(*) OVER (PARTITION BY repo_name) AS n FROM chunks)
SELECT repo_name, round(s, 9) AS quartile FROM r WHERE rn = n // 4 + 1""")
def e17_quartile(spark, d):
    c = table(spark, d, "chunks").select("repo_name", "row_id", F.coalesce("centrality_score", F.lit(0.0)).alias("s"))
    r = position(c, ["repo_name"], [F.desc("s"), F.col("row_id")])
    n = r.groupBy("repo_name").agg(F.count("*").alias("n"))
    return r.join(n, "repo_name").filter(F.col("rank") == F.floor(F.col("n") / 4) + 1).select("repo_name", F.round("s", 9).alias("quartile"))


@query("SELECT row_id, row_number() OVER (ORDER BY rel_path, start_line, id, row_id) AS place FROM chunks")
def f3_deterministic_order(spark, d):
    c = table(spark, d, "chunks").select("row_id", "rel_path", "start_line", "id", F.lit(0).alias("g"))
    return position(c, ["g"], [F.col("rel_path"), F.col("start_line"), F.col("id"), F.col("row_id")], "place").select("row_id", "place")


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS term FROM documents WHERE text IS NOT NULL)
SELECT term, count(*) AS df FROM t WHERE length(term) >= 3 GROUP BY 1 ORDER BY df DESC, term LIMIT 500""")
def f9_vocabulary_cap(spark, d):
    """The vocabulary's size is the feature's own limit."""
    return _tf(spark, d).groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(500)


@query(f"""WITH f AS ({FILES_SQL}) SELECT file_id, CAST(floor(size / CASE WHEN path LIKE '%.py' THEN 3.5 WHEN path LIKE '%.js' OR path LIKE '%.ts' THEN 3.2 WHEN path LIKE '%.java' THEN 3.8 ELSE 3.6 END * CASE WHEN regexp_matches(path, '_test\\.') THEN 1.1 ELSE 1.0 END) AS BIGINT) AS tokens FROM f""")
def h5_language_tokens(spark, d):
    p = F.col("path")
    per = F.when(p.endswith(".py"), 3.5).when(p.endswith(".js") | p.endswith(".ts"), 3.2).when(p.endswith(".java"), 3.8).otherwise(3.6)
    return files(spark, d).select("file_id", F.floor(F.col("size") / per * F.when(p.rlike(r"_test\."), 1.1).otherwise(1.0)).alias("tokens"))


@query("""SELECT row_id, len(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS terms, len(list_distinct(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda x: length(x) >= 2))) AS distinct_terms FROM chunks WHERE content IS NOT NULL""")
def h17_code_terms(spark, d):
    t = F.filter(F.split(F.lower("content"), "[^a-z0-9]+"), lambda x: F.length(x) >= 2)
    return table(spark, d, "chunks").filter("content is not null").select("row_id", F.size(t).cast("long").alias("terms"), F.size(F.array_distinct(t)).cast("long").alias("distinct_terms"))


@query("""SELECT row_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(content, '\"\"\"[\\s\\S]*?\"\"\"|/\\*[\\s\\S]*?\\*/', ' ', 'g'), '(#|//)[^\\n]*', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ')) AS body FROM chunks WHERE content IS NOT NULL""")
def h18_preprocess(spark, d):
    t = F.regexp_replace("content", r'"""[\s\S]*?"""|/\*[\s\S]*?\*/', " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(#|//)[^\n]*", " "), r"[ \t\r\n]+", " ")
    return table(spark, d, "chunks").filter("content is not null").select("row_id", F.lower(F.trim(t)).alias("body"))


@query("""SELECT item_id, CASE WHEN gold.regex_pattern IS NULL THEN NULL ELSE regexp_matches(gold.answer_text, gold.regex_pattern) END AS matched FROM qa_items WHERE gold.answer_text IS NOT NULL""")
def h27_regex_score(spark, d):
    q = table(spark, d, "qa_items").filter("gold.answer_text is not null")
    return q.select("item_id", F.regexp_like(F.col("gold.answer_text"), F.col("gold.regex_pattern")).alias("matched"))


@query("""SELECT run_id, round((0.6 * coverage_score + 0.4 * diversity_score) / 1.0, 6) AS composite FROM selection_results WHERE coverage_score BETWEEN 0 AND 1 AND diversity_score BETWEEN 0 AND 1""")
def h28_composite(spark, d):
    s = table(spark, d, "selection_results").filter("coverage_score between 0 and 1 and diversity_score between 0 and 1")
    return s.select("run_id", F.round(0.6 * F.col("coverage_score") + 0.4 * F.col("diversity_score"), 6).alias("composite"))


@query("""WITH c AS (SELECT doc_id, text, substr(text, 1, 400) AS head FROM documents WHERE text IS NOT NULL), b AS (SELECT *, CASE WHEN strpos(reverse(head), chr(10) || chr(10)) > 0 THEN length(head) - strpos(reverse(head), chr(10) || chr(10)) - 1 ELSE -1 END AS back FROM c)
SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN back > 320 THEN substr(head, 1, back) ELSE head END AS kept FROM b""")
def h29_truncate(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.truncated(F.col("text"), 100).alias("kept"))


@query(f"""WITH f AS ({FILES_SQL}) SELECT file_id, trim(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM f""")
def h31_slug(spark, d):
    return files(spark, d).select("file_id", text.slug(F.col("path")).alias("slug"))


@query(f"""WITH s AS (SELECT repo_name, row_id, {TOK} AS tokens, CASE lower(kind) WHEN 'docstring' THEN 10 WHEN 'comment' THEN 8 WHEN 'module_header' THEN 6 ELSE 0 END AS score FROM chunks)
SELECT repo_name, row_id FROM (SELECT *, sum(tokens) OVER (PARTITION BY repo_name ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING) AS cum FROM s WHERE score > 0) WHERE cum <= 500""")
def j11_documentation_only(spark, d):
    k = F.lower("kind")
    s = table(spark, d, "chunks").select("repo_name", "row_id", text.chunk_tokens().alias("tokens"), F.when(k == "docstring", 10).when(k == "comment", 8).when(k == "module_header", 6).alias("score")).filter("score is not null")
    return budget.break_in_order(s, "repo_name", [F.desc("score"), F.col("row_id")], "tokens", 500).select("repo_name", "row_id")


@query("""
WITH u AS (SELECT run_id, coverage_score / greatest(total_tokens, 1) * 1000 AS utility, budget_utilization FROM selection_results WHERE coverage_score BETWEEN 0 AND 1 AND total_tokens IS NOT NULL)
SELECT run_id, CASE WHEN utility < 0.05 THEN 'low_utility' ELSE 'over_used' END AS reason FROM u WHERE utility < 0.05 OR budget_utilization > 0.99""")
def j22_demotion_candidates(spark, d):
    s = table(spark, d, "selection_results").filter("coverage_score between 0 and 1 and total_tokens is not null")
    u = F.col("coverage_score") / F.greatest("total_tokens", F.lit(1)) * 1000
    return s.withColumn("u", u).filter((F.col("u") < 0.05) | (F.col("budget_utilization") > 0.99)).select("run_id", F.when(F.col("u") < 0.05, "low_utility").otherwise("over_used").alias("reason"))


_DIFF = """WITH m AS (SELECT pack_id, avg(total_tokens) FILTER (WHERE variant_id = 'v0c_bm25_baseline') AS a, avg(total_tokens) FILTER (WHERE variant_id = 'coverage_enhanced') AS b FROM selection_results GROUP BY 1),
x AS (SELECT pack_id, b - a AS x FROM m WHERE a IS NOT NULL AND b IS NOT NULL)"""


@query(_DIFF + """, r AS (SELECT x, rank() OVER (ORDER BY abs(x)) + (count(*) OVER (PARTITION BY abs(x)) - 1) / 2.0 AS rk FROM x WHERE x <> 0)
SELECT (SELECT count(*) FROM x) AS n, round((SELECT avg(x) / (stddev_samp(x) / sqrt(count(*))) FROM x), 6) AS t, round((SELECT avg(x) / stddev_samp(x) FROM x), 6) AS dz, round(sum(CASE WHEN x > 0 THEN rk ELSE 0 END), 6)::DOUBLE AS w_plus, round(sum(CASE WHEN x < 0 THEN rk ELSE 0 END), 6)::DOUBLE AS w_minus FROM r""")
def l6_paired_tests(spark, d):
    """Paired t, dz and the Wilcoxon rank sums; average ranks come from prefix sums over the distinct sizes."""
    x = _paired(spark, d).select((F.col("b") - F.col("a")).alias("x"))
    v = x.filter("x <> 0").groupBy(F.abs("x").alias("v")).agg(F.count("*").alias("c"), F.count_if(F.col("x") > 0).alias("p"))
    r = prefix_sum(v.withColumn("g", F.lit(0)), ["g"], [F.col("v")], "c", "upto").withColumn("rk", F.col("upto") - (F.col("c") - 1) / 2)
    w = r.agg(F.sum(F.col("rk") * F.col("p")).alias("wp"), F.sum(F.col("rk") * (F.col("c") - F.col("p"))).alias("wm"))
    t = x.agg(F.count("*").alias("n"), (F.avg("x") / (F.stddev_samp("x") / F.sqrt(F.count("*")))).alias("t"), (F.avg("x") / F.stddev_samp("x")).alias("dz"))
    return t.crossJoin(w).select("n", F.round("t", 6).alias("t"), F.round("dz", 6).alias("dz"), F.round("wp", 6).alias("w_plus"), F.round("wm", 6).alias("w_minus"))


@query(_DIFF + """, s AS (SELECT avg(x) AS m, stddev_samp(x) AS sd, count(*) AS n FROM x)
SELECT round(sum(power((x - m) / sd, 2)), 6) AS q, round(greatest(0, (sum(power((x - m) / sd, 2)) - (max(n) - 1)) / sum(power((x - m) / sd, 2))), 6) AS i2, count(*) FILTER (WHERE x > 0) AS positive, count(*) FILTER (WHERE x < 0) AS negative FROM x, s""")
def l10_heterogeneity(spark, d):
    x = _paired(spark, d).select((F.col("b") - F.col("a")).alias("x"))
    z = F.pow((F.col("x") - F.col("m")) / F.col("sd"), F.lit(2))
    j = x.crossJoin(x.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"), F.count("*").alias("n")))
    return j.agg(F.round(F.sum(z), 6).alias("q"), F.round(F.greatest(F.lit(0.0), (F.sum(z) - (F.max("n") - 1)) / F.sum(z)), 6).alias("i2"), F.count_if(F.col("x") > 0).alias("positive"), F.count_if(F.col("x") < 0).alias("negative"))


@query("""SELECT variant_id, round(stddev_samp(coverage_score) / avg(coverage_score), 6) AS cv, CASE WHEN stddev_samp(coverage_score) / avg(coverage_score) < 0.1 THEN 'high' WHEN stddev_samp(coverage_score) / avg(coverage_score) < 0.2 THEN 'good' WHEN stddev_samp(coverage_score) / avg(coverage_score) < 0.3 THEN 'moderate' ELSE 'low' END AS reliability
FROM selection_results WHERE coverage_score BETWEEN 0 AND 1 GROUP BY 1""")
def l11_run_reliability(spark, d):
    cv = F.stddev_samp("coverage_score") / F.avg("coverage_score")
    return table(spark, d, "selection_results").filter("coverage_score between 0 and 1").groupBy("variant_id").agg(F.round(cv, 6).alias("cv"), F.when(cv < 0.1, "high").when(cv < 0.2, "good").when(cv < 0.3, "moderate").otherwise("low").alias("reliability"))


@query("""
WITH p AS (SELECT o_orderpriority AS family, o_custkey % 40 AS k, ((min(o_orderkey) * 7919) % 1000 + 1) / 5000.0 AS p FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, k) AS rk, count(*) OVER (PARTITION BY family) AS n FROM p),
a AS (SELECT family, k, least(1, min(p * n / rk) OVER (PARTITION BY family ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
SELECT family, count(*) AS tests, count(*) FILTER (WHERE q <= 0.05) AS significant, CASE WHEN bool_and(q <= 0.05) THEN 'promote' WHEN bool_or(q <= 0.05) THEN 'review' ELSE 'block' END AS decision FROM a GROUP BY 1""")
def l12_fdr_families(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("family"), (F.col("o_custkey") % 40).alias("k")).agg((((F.min("o_orderkey") * 7919) % 1000 + 1) / 5000.0).alias("p"))
    q = stats.adjusted(o, ["family"], "p", "k")
    hit = F.col("p_adj") <= 0.05
    return q.groupBy("family").agg(F.count("*").alias("tests"), F.count_if(hit).alias("significant"), F.when(F.bool_and(hit), "promote").when(F.bool_or(hit), "review").otherwise("block").alias("decision"))


@query("""
WITH s AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1)
SELECT a.event_type AS left_system, b.event_type AS right_system, round((b.m - a.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS d FROM s a JOIN s b ON a.event_type < b.event_type""")
def l16_pairwise_systems(spark, d):
    """Every pair of systems from one aggregate row each."""
    s = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    a, b = s.alias("a"), s.alias("b")
    pooled = F.sqrt(((F.col("a.n") - 1) * F.col("a.v") + (F.col("b.n") - 1) * F.col("b.v")) / (F.col("a.n") + F.col("b.n") - 2))
    return a.join(b, F.col("a.event_type") < F.col("b.event_type")).select(F.col("a.event_type").alias("left_system"), F.col("b.event_type").alias("right_system"), F.round((F.col("b.m") - F.col("a.m")) / pooled, 6).alias("d"))


@query("""
WITH r AS (SELECT run_id, total_tokens AS used, token_budget AS budget, allow_overage FROM selection_results JOIN baseline_configs USING (config_id) WHERE total_tokens IS NOT NULL)
SELECT run_id, 'overflow' AS oracle, used - budget AS by_tokens FROM r WHERE used > budget * (1 + CASE WHEN allow_overage IS NULL OR isnan(allow_overage) THEN 0 ELSE allow_overage END)
UNION ALL SELECT run_id, 'underflow', used - budget FROM r WHERE used < budget * 0.995""")
def o1_budget_oracle(spark, d):
    c = table(spark, d, "baseline_configs").select("config_id", "token_budget", F.when(F.col("allow_overage").isNull() | F.isnan("allow_overage"), 0.0).otherwise(F.col("allow_overage")).alias("over"))
    r = table(spark, d, "selection_results").filter("total_tokens is not null").join(c, "config_id").withColumn("by_tokens", F.col("total_tokens") - F.col("token_budget"))
    hit = F.when(F.col("total_tokens") > F.col("token_budget") * (1 + F.col("over")), "overflow").when(F.col("total_tokens") < F.col("token_budget") * F.lit(0.995), "underflow")
    return r.select("run_id", hit.alias("oracle"), "by_tokens").filter("oracle is not null")


@query("""SELECT pack_id, count(DISTINCT config_id) AS configs, count(DISTINCT token_budget) AS budgets, count(DISTINCT token_budget) <= 1 AS parity FROM selection_results JOIN baseline_configs USING (config_id) GROUP BY 1""")
def o5_parity(spark, d):
    j = table(spark, d, "selection_results").join(table(spark, d, "baseline_configs").select("config_id", "token_budget"), "config_id")
    return j.groupBy("pack_id").agg(F.countDistinct("config_id").alias("configs"), F.countDistinct("token_budget").alias("budgets"), (F.countDistinct("token_budget") <= 1).alias("parity"))


@query("""SELECT c.variant_id, s.seed, lower(q.difficulty) AS difficulty, count(*) AS cells FROM (SELECT DISTINCT variant_id FROM baseline_configs) c, (SELECT DISTINCT random_seed AS seed FROM baseline_configs) s, qa_items q GROUP BY ALL""")
def o6_evaluation_matrix(spark, d):
    """Cells of the variant x seed grid per stratum; questions are counted once, not crossed with the grid."""
    b = table(spark, d, "baseline_configs")
    grid = b.agg(F.collect_set("variant_id").alias("vs"), F.collect_set("random_seed").alias("ss")).select(F.explode("vs").alias("variant_id"), "ss").select("variant_id", F.explode("ss").alias("seed"))
    q = table(spark, d, "qa_items").groupBy(F.lower("difficulty").alias("difficulty")).agg(F.count("*").alias("cells"))
    packed = q.agg(F.collect_list(F.struct("difficulty", "cells")).alias("rows"))
    return grid.crossJoin(packed).select("variant_id", "seed", F.explode("rows").alias("r")).select("variant_id", "seed", "r.difficulty", "r.cells")


@query("""
WITH m AS (SELECT variant_id, avg(coverage_score) AS c, stddev_samp(coverage_score) AS s, count(*) AS n FROM selection_results WHERE coverage_score BETWEEN 0 AND 1 GROUP BY 1),
k AS (SELECT variant_id, c, round(0.4 * least(1, s / c) + 0.3 * CASE WHEN n < 20 THEN 1 ELSE 0 END + 0.3 * greatest(0, 0.7 - c), 6)::DOUBLE AS risk FROM m)
SELECT variant_id, risk, CASE WHEN c >= 0.6 AND risk < 0.3 THEN 'PROMOTE' WHEN risk < 0.5 THEN 'REFINE' ELSE 'MANUAL' END AS decision FROM k""")
def o8_decision(spark, d):
    m = table(spark, d, "selection_results").filter("coverage_score between 0 and 1").groupBy("variant_id").agg(F.avg("coverage_score").alias("c"), F.stddev_samp("coverage_score").alias("s"), F.count("*").alias("n"))
    risk = F.round(0.4 * F.least(F.lit(1.0), F.col("s") / F.col("c")) + 0.3 * F.when(F.col("n") < 20, 1).otherwise(0) + 0.3 * F.greatest(F.lit(0.0), 0.7 - F.col("c")), 6)
    k = m.select("variant_id", "c", risk.alias("risk"))
    return k.select("variant_id", "risk", F.when((F.col("c") >= 0.6) & (F.col("risk") < 0.3), "PROMOTE").when(F.col("risk") < 0.5, "REFINE").otherwise("MANUAL").alias("decision"))

