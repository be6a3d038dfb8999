"""Joins, aggregations, windows, sorts and set operations (survey groups C to G)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hewn.functions import text
from hewn.operators import budget, stats
from hewn.operators.prefix import position
from hewn.plans.registry import query
from hewn.sources.tables import table

TOK = text.CHUNK_TOKENS_SQL


# ---- joins


@query("""
WITH e AS (SELECT c.file_id AS src, unnest(c.dependencies).target AS target FROM chunks c), n AS (SELECT id, min(file_id) AS dst FROM chunks WHERE id IS NOT NULL GROUP BY 1)
SELECT DISTINCT src, dst FROM e JOIN n ON e.target = n.id WHERE src <> dst""")
def c4_dependency_edges(spark, d):
    c = table(spark, d, "chunks")
    e = c.select(F.col("file_id").alias("src"), F.explode("dependencies").alias("x")).select("src", F.col("x.target").alias("id"))
    n = c.filter("id is not null").groupBy("id").agg(F.min("file_id").alias("dst"))
    return e.join(n, "id").filter("src <> dst").select("src", "dst").distinct()


@query("""
WITH m AS (SELECT pack_id, variant_id, avg(total_tokens) AS tokens FROM selection_results WHERE total_tokens IS NOT NULL GROUP BY 1, 2)
SELECT a.pack_id, round(a.tokens, 6) AS control, round(b.tokens, 6) AS treatment, round(b.tokens - a.tokens, 6) AS diff FROM m a JOIN m b USING (pack_id) WHERE a.variant_id = 'v0c_bm25_baseline' AND b.variant_id = 'coverage_enhanced'""")
def c7_paired_variants(spark, d):
    return _paired(spark, d).select("pack_id", F.round("a", 6).alias("control"), F.round("b", 6).alias("treatment"), F.round(F.col("b") - F.col("a"), 6).alias("diff"))


def _paired(spark, d):
    m = table(spark, d, "selection_results").filter("total_tokens is not null").filter(F.col("variant_id").isin("v0c_bm25_baseline", "coverage_enhanced"))
    one = lambda v: F.avg(F.when(F.col("variant_id") == v, F.col("total_tokens")))
    return m.groupBy("pack_id").agg(one("v0c_bm25_baseline").alias("a"), one("coverage_enhanced").alias("b")).filter("a is not null and b is not null")


@query("""
WITH s AS (SELECT pack_id, variant_id, unnest(map_entries(selection_scores)) AS e FROM (SELECT pack_id, variant_id, arg_max(selection_scores, run_id) AS selection_scores FROM selection_results GROUP BY ALL)),
r AS (SELECT pack_id, variant_id, e.key AS item, e.value > 0.5 AS yes FROM s WHERE e.value IS NOT NULL AND NOT isnan(e.value))
SELECT a.variant_id AS left_variant, b.variant_id AS right_variant, count(*) AS items, round(avg(CASE WHEN a.yes = b.yes THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS agreement
FROM r a JOIN r b ON a.pack_id = b.pack_id AND a.item = b.item AND a.variant_id < b.variant_id GROUP BY 1, 2""")
def c12_pairwise_agreement(spark, d):
    r = _ratings(spark, d).withColumn("yes", F.col("value") > 0.5)
    a, b = r.alias("a"), r.alias("b")
    j = a.join(b, (F.col("a.pack_id") == F.col("b.pack_id")) & (F.col("a.item") == F.col("b.item")) & (F.col("a.variant_id") < F.col("b.variant_id")))
    agree = F.avg((F.col("a.yes") == F.col("b.yes")).cast("double"))
    return j.groupBy(F.col("a.variant_id").alias("left_variant"), F.col("b.variant_id").alias("right_variant")).agg(F.count("*").alias("items"), F.round(agree, 6).alias("agreement"))


def _ratings(spark, d):
    """(pack_id, variant_id, item, value): valid scores of the latest run of each variant."""
    s = table(spark, d, "selection_results").groupBy("pack_id", "variant_id").agg(F.max_by("selection_scores", "run_id").alias("scores"))
    return s.select("pack_id", "variant_id", F.explode("scores").alias("item", "value")).filter("value is not null and not isnan(value)")


@query("""
WITH g AS (SELECT DISTINCT pack_id FROM selection_results), v AS (SELECT DISTINCT variant_id FROM selection_results)
SELECT pack_id, variant_id FROM (SELECT * FROM g, v) EXCEPT SELECT pack_id, variant_id FROM selection_results""")
def c17_missing_grid(spark, d):
    s = table(spark, d, "selection_results").select("pack_id", "variant_id").distinct()
    # variants are the few systems under test
    want = s.agg(F.collect_set("variant_id").alias("vs")).crossJoin(s.select("pack_id").distinct()).select("pack_id", F.explode("vs").alias("variant_id"))
    return want.join(s, ["pack_id", "variant_id"], "left_anti")


@query("""
WITH w AS (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(question), '[^a-z0-9_]+'), lambda x: length(x) > 0))) AS word FROM qa_items WHERE question IS NOT NULL),
n AS (SELECT item_id, count(*) AS c FROM w GROUP BY 1), s AS (SELECT a.item_id AS left_item, b.item_id AS right_item, count(*) AS k FROM w a JOIN w b ON a.word = b.word AND a.item_id < b.item_id GROUP BY 1, 2)
SELECT left_item, right_item, round(k * 1.0 / (x.c + y.c - k), 6)::DOUBLE AS jaccard FROM s JOIN n x ON x.item_id = left_item JOIN n y ON y.item_id = right_item WHERE k * 1.0 / (x.c + y.c - k) >= 0.7""")
def c19_similar_questions(spark, d):
    """Pairs of questions with a word Jaccard of .7 or more; prefix filtering keeps frequent words from joining everything with everything."""
    words = F.array_distinct(F.filter(F.split(F.lower("question"), "[^a-z0-9_]+"), lambda x: F.length(x) > 0))
    q = table(spark, d, "qa_items").filter("question is not null").select("item_id", words.alias("words"))
    w = q.select("item_id", F.size("words").alias("c"), F.explode("words").alias("word"))
    df = w.groupBy("word").agg(F.count("*").alias("df"))
    order = Window.partitionBy("item_id").orderBy("df", "word")
    pre = w.join(df, "word").withColumn("i", F.row_number().over(order)).filter(F.col("i") <= F.col("c") - F.ceil(F.col("c") * 0.7) + 1).select("item_id", "word")
    pairs = pre.alias("a").join(pre.alias("b"), (F.col("a.word") == F.col("b.word")) & (F.col("a.item_id") < F.col("b.item_id"))).select(F.col("a.item_id").alias("left_item"), F.col("b.item_id").alias("right_item")).distinct()
    l, r = q.select(F.col("item_id").alias("left_item"), F.col("words").alias("x")), q.select(F.col("item_id").alias("right_item"), F.col("words").alias("y"))
    k = F.size(F.array_intersect("x", "y"))
    return pairs.join(l, "left_item").join(r, "right_item").select("left_item", "right_item", F.round(k / (F.size("x") + F.size("y") - k), 6).alias("jaccard")).filter("jaccard >= 0.7")


# ---- aggregations


@query("""SELECT lower(kind) AS kind, count(*) FILTER (WHERE m.mode = 'full') AS full_n, count(*) FILTER (WHERE m.mode = 'signature') AS signature_n, count(*) AS n
FROM (SELECT unnest(map_entries(chunk_modes)).key AS id, unnest(map_entries(chunk_modes)).value AS mode FROM selection_results) m JOIN (SELECT id, min(kind) AS kind FROM chunks GROUP BY 1) c ON m.id = c.id GROUP BY 1""")
def d7_mode_breakdown(spark, d):
    m = table(spark, d, "selection_results").select(F.explode("chunk_modes").alias("id", "mode"))
    c = table(spark, d, "chunks").groupBy("id").agg(F.min("kind").alias("kind"))
    return m.join(c, "id").groupBy(F.lower("kind").alias("kind")).agg(F.count_if(F.col("mode") == "full").alias("full_n"), F.count_if(F.col("mode") == "signature").alias("signature_n"), F.count("*").alias("n"))


_ENTROPY = """
WITH c AS (SELECT repo_name, lower(kind) AS k, count(*) AS n FROM chunks GROUP BY 1, 2), t AS (SELECT repo_name, sum(n) AS total, count(*) AS classes FROM c GROUP BY 1)
SELECT repo_name, round(abs(sum(n / total * log2(n / total))), 6) AS entropy, round(CASE WHEN max(classes) > 1 THEN abs(sum(n / total * log2(n / total))) / log2(least(max(classes), 6)) ELSE 0 END, 6) AS diversity,
 round(max(n / total), 6) AS top_share FROM c JOIN t USING (repo_name) GROUP BY 1"""


@query(_ENTROPY)
def d9_class_diversity(spark, d):
    c = table(spark, d, "chunks").groupBy("repo_name", F.lower("kind").alias("k")).agg(F.count("*").alias("n"))
    t = c.groupBy("repo_name").agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    p = F.col("n") / F.col("total")
    h = F.abs(F.sum(p * F.log2(p)))
    return c.join(t, "repo_name").groupBy("repo_name").agg(
        F.round(h, 6).alias("entropy"), F.round(F.when(F.max("classes") > 1, h / F.log2(F.least(F.max("classes"), F.lit(6)))).otherwise(0.0), 6).alias("diversity"), F.round(F.max(p), 6).alias("top_share")
    )


@query("""SELECT lower(difficulty) AS difficulty, lower(category) AS category, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM qa_items GROUP BY 1, 2""")
def d11_distribution(spark, d):
    g = table(spark, d, "qa_items").groupBy(F.lower("difficulty").alias("difficulty"), F.lower("category").alias("category")).agg(F.count("*").alias("n"))
    return g.crossJoin(g.agg(F.sum("n").alias("t"))).select("difficulty", "category", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("""
WITH s AS (SELECT lower(difficulty) AS k, count(*) * 1.0 / (SELECT count(*) FROM qa_items) AS p FROM qa_items GROUP BY 1), t(k, q) AS (VALUES ('easy', 0.2), ('medium', 0.5), ('hard', 0.3))
SELECT round(greatest(0, 1 - sum(abs(coalesce(p, 0) - q))), 6)::DOUBLE AS balance FROM t LEFT JOIN s USING (k)""")
def d12_difficulty_balance(spark, d):
    q = table(spark, d, "qa_items")
    s = q.groupBy(F.lower("difficulty").alias("k")).agg(F.count("*").alias("n")).crossJoin(q.agg(F.count("*").alias("t")))
    t = spark.createDataFrame([("easy", 0.2), ("medium", 0.5), ("hard", 0.3)], "k string, q double")
    gap = F.sum(F.abs(F.coalesce(F.col("n") / F.col("t"), F.lit(0.0)) - F.col("q")))
    return t.join(s, "k", "left").agg(F.round(F.greatest(F.lit(0.0), 1 - gap), 6).alias("balance"))


@query("""
SELECT repo_id, round(avg(CASE WHEN question IS NOT NULL AND category IS NOT NULL AND difficulty IS NOT NULL AND gold.answer_text IS NOT NULL THEN 1.0 ELSE 0 END), 6)::DOUBLE AS completeness,
 round(CASE WHEN avg(length(question)) > 0 THEN greatest(0, 1 - stddev_pop(length(question)) / avg(length(question))) ELSE 0 END, 6)::DOUBLE AS consistency FROM qa_items GROUP BY 1""")
def d13_completeness(spark, d):
    full = F.col("question").isNotNull() & F.col("category").isNotNull() & F.col("difficulty").isNotNull() & F.col("gold.answer_text").isNotNull()
    n = F.length("question")
    even = F.when(F.avg(n) > 0, F.greatest(F.lit(0.0), 1 - F.stddev_pop(n) / F.avg(n))).otherwise(0.0)
    return table(spark, d, "qa_items").groupBy("repo_id").agg(F.round(F.avg(full.cast("double")), 6).alias("completeness"), F.round(even, 6).alias("consistency"))


@query("""
SELECT variant_id, count(*) AS runs, round(avg(coverage_score), 6) AS mean, round(stddev_pop(coverage_score), 6) AS std, round(median(coverage_score), 6) AS median, round(quantile_cont(coverage_score, 0.25), 6) AS p25,
 round(quantile_cont(coverage_score, 0.75), 6) AS p75, round(sum(coverage_score) / sum(total_tokens) * 1e5, 6) AS per_100k FROM selection_results WHERE coverage_score IS NOT NULL AND NOT isnan(coverage_score) AND total_tokens > 0 GROUP BY 1""")
def d17_system_score(spark, d):
    s = table(spark, d, "selection_results").filter("coverage_score is not null and not isnan(coverage_score) and total_tokens > 0")
    x = "coverage_score"
    g = s.groupBy("variant_id").agg(F.count("*").alias("runs"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"), F.round(F.sum(x) / F.sum("total_tokens") * 1e5, 6).alias("per_100k"))
    p = stats.percentiles(s, "variant_id", x, {"median": 0.5, "p25": 0.25, "p75": 0.75})
    return g.join(p, "variant_id").select("variant_id", "runs", "mean", "std", *[F.round(c, 6).alias(c) for c in ("median", "p25", "p75")], "per_100k")


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def d18_latency_percentiles(spark, d):
    e = table(spark, d, "events")
    p = stats.percentiles(e, "event_type", "value", {"p50": 0.5, "p95": 0.95})
    g = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return g.join(p, "event_type").select("event_type", "n", "mean", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("""
WITH v AS (SELECT user_id, event_type, count(*) AS c, min(event_id) AS first FROM events GROUP BY 1, 2)
SELECT user_id, arg_max(event_type, c * 1000000000 - first) AS winner, round(max(c) / sum(c), 6)::DOUBLE AS agreement FROM v GROUP BY 1""")
def d19_consensus(spark, d):
    v = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"), F.min("event_id").alias("first"))
    return v.groupBy("user_id").agg(F.max_by("event_type", F.struct(F.col("c"), -F.col("first"))).alias("winner"), F.round(F.max("c") / F.sum("c"), 6).alias("agreement"))


@query("""SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, row_id DESC) AS rn FROM chunks) WHERE rn > 1""")
def d21_repeated_chunks(spark, d):
    """Rows of a chunk other than its latest; found by a join with each id's latest row, so that a hot id needs no sort in one task."""
    c = table(spark, d, "chunks").select("row_id", "id", "ingested_at")
    last = c.groupBy("id").agg(F.max_by("row_id", F.struct("ingested_at", "row_id")).alias("keep"))
    return c.join(last, F.col("row_id") == F.col("keep"), "left_anti").select("row_id")


@query("""SELECT variant_id, round(avg(iterations), 6) AS mean, round(median(iterations), 6) AS median, round(stddev_samp(iterations), 6) AS std, CAST(min(iterations) AS BIGINT) AS low, CAST(max(iterations) AS BIGINT) AS high FROM selection_results GROUP BY 1""")
def d23_variant_statistics(spark, d):
    x, s = "iterations", table(spark, d, "selection_results")
    g = s.groupBy("variant_id").agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"), F.min(x).cast("long").alias("low"), F.max(x).cast("long").alias("high"))
    return g.join(stats.percentiles(s, "variant_id", x, {"median": 0.5}), "variant_id").select("variant_id", "mean", F.round("median", 6).alias("median"), "std", "low", "high")


@query("""
WITH b AS (SELECT CASE WHEN variant_id LIKE 'v0%' THEN 'baseline' ELSE 'advanced' END AS class, coverage_score AS x FROM selection_results WHERE coverage_score BETWEEN 0 AND 1)
SELECT class, round(avg(x), 6) AS mean, round((avg(x) / (SELECT avg(x) FROM b WHERE class = 'baseline') - 1) * 100, 6) AS over_baseline FROM b GROUP BY 1""")
def d31_class_improvement(spark, d):
    b = table(spark, d, "selection_results").filter("coverage_score between 0 and 1").groupBy(F.when(F.col("variant_id").startswith("v0"), "baseline").otherwise("advanced").alias("class")).agg(F.avg("coverage_score").alias("m"))
    return b.crossJoin(b.filter("class = 'baseline'").select(F.col("m").alias("base"))).select("class", F.round("m", 6).alias("mean"), F.round((F.col("m") / F.col("base") - 1) * 100, 6).alias("over_baseline"))


# ---- windows

@query(f"""
WITH RECURSIVE r AS (SELECT repo_name, row_id, {TOK} AS tokens, row_number() OVER (PARTITION BY repo_name ORDER BY coalesce(centrality_score, 0) DESC, row_id) AS rn FROM chunks),
w AS (SELECT repo_name, row_id, tokens, rn, tokens <= 2000 AS took, CASE WHEN tokens <= 2000 THEN tokens ELSE 0 END AS used FROM r WHERE rn = 1
 UNION ALL SELECT r.repo_name, r.row_id, r.tokens, r.rn, w.used + r.tokens <= 2000, CASE WHEN w.used + r.tokens <= 2000 THEN w.used + r.tokens ELSE w.used END FROM w JOIN r ON r.repo_name = w.repo_name AND r.rn = w.rn + 1)
SELECT repo_name, row_id, tokens, used AS cum_tokens FROM w WHERE took""")
def e1_greedy_skip(spark, d):
    return budget.skip_greedy(_ranked_chunks(spark, d), "repo_name", "rank", "tokens", 2000).select("repo_name", "row_id", "tokens", "cum_tokens")


def _ranked_chunks(spark, d):
    c = table(spark, d, "chunks").select("repo_name", "row_id", text.chunk_tokens().alias("tokens"), F.coalesce("centrality_score", F.lit(0.0)).alias("score"))
    return position(c, ["repo_name"], [F.desc("score"), F.col("row_id")])


@query(f"""
SELECT repo_name, row_id, CAST(cum AS BIGINT) AS cum_tokens FROM (SELECT repo_name, row_id, sum({TOK}) OVER (PARTITION BY repo_name ORDER BY coalesce(centrality_score, 0) DESC, row_id ROWS UNBOUNDED PRECEDING) AS cum FROM chunks) WHERE cum <= 2000""")
def e2_greedy_break(spark, d):
    c = table(spark, d, "chunks").select("repo_name", "row_id", text.chunk_tokens().alias("tokens"), F.coalesce("centrality_score", F.lit(0.0)).alias("score"))
    return budget.break_in_order(c, "repo_name", [F.desc("score"), F.col("row_id")], "tokens", 2000).select("repo_name", "row_id", F.col("cum_tokens").cast("long").alias("cum_tokens"))


@query(f"""
WITH RECURSIVE r AS (SELECT repo_name, row_id, {TOK} AS f, CAST(greatest(1, {TOK} // 10) AS BIGINT) AS s, row_number() OVER (PARTITION BY repo_name ORDER BY coalesce(centrality_score, 0) DESC, row_id) AS rn FROM chunks),
w AS (SELECT repo_name, row_id, rn, CASE WHEN f <= 2000 THEN f WHEN s <= 2000 THEN s ELSE 0 END AS took, CASE WHEN f <= 2000 THEN 'full' WHEN s <= 2000 THEN 'signature' END AS mode, CASE WHEN f <= 2000 THEN f WHEN s <= 2000 THEN s ELSE 0 END AS used FROM r WHERE rn = 1
 UNION ALL SELECT r.repo_name, r.row_id, r.rn, CASE WHEN used + f <= 2000 THEN f WHEN used + s <= 2000 THEN s ELSE 0 END, CASE WHEN used + f <= 2000 THEN 'full' WHEN used + s <= 2000 THEN 'signature' END,
  used + CASE WHEN used + f <= 2000 THEN f WHEN used + s <= 2000 THEN s ELSE 0 END FROM w JOIN r ON r.repo_name = w.repo_name AND r.rn = w.rn + 1)
SELECT repo_name, row_id AS id, mode, CAST(took AS BIGINT) AS tokens FROM w WHERE mode IS NOT NULL""")
def e3_signature_fallback(spark, d):
    c = _ranked_chunks(spark, d).select("repo_name", F.col("row_id").alias("id"), "rank", F.col("tokens").alias("full_tokens"), F.greatest(F.lit(1), F.floor(F.col("tokens") / 10)).cast("long").alias("signature_tokens"))
    return budget.two_mode_greedy(c, "repo_name", "rank", 2000)


@query("""
WITH s AS (SELECT coalesce(centrality_score, 0) AS x FROM chunks), n AS (SELECT greatest(1, least(count(*), CAST(floor(count(*) * 0.2) AS BIGINT))) AS k FROM s)
SELECT round(min(x), 9) AS threshold FROM (SELECT x, row_number() OVER (ORDER BY x DESC) AS rn FROM s), n WHERE rn <= k""")
def e5_importance_threshold(spark, d):
    s = position(table(spark, d, "chunks").select("row_id", F.lit(0).alias("g"), F.coalesce("centrality_score", F.lit(0.0)).alias("x")), ["g"], [F.desc("x"), F.col("row_id")])
    n = s.agg(F.greatest(F.lit(1), F.least(F.count("*"), F.floor(F.count("*") * F.lit(0.2)))).alias("k"))
    return s.crossJoin(n).filter(F.col("rank") <= F.col("k")).agg(F.round(F.min("x"), 9).alias("threshold"))


@query("""
WITH l AS (SELECT user_id, event_id, event_type, lag(event_type, 1) OVER w AS p1, lag(event_type, 2) OVER w AS p2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS oscillations FROM l WHERE event_type = p2 AND event_type <> p1 GROUP BY 1""")
def e6_oscillation(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_type", F.lag("event_type", 1).over(w).alias("p1"), F.lag("event_type", 2).over(w).alias("p2"))
    return e.filter("event_type = p2 and event_type <> p1").groupBy("user_id").agg(F.count("*").alias("oscillations"))


@query("""
WITH l AS (SELECT user_id, event_id, ts, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS changed FROM events)
SELECT user_id, event_id, round(least(1.0, 0.2 * sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)), 6)::DOUBLE AS risk FROM l""")
def e7_oscillation_risk(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") != F.lag("event_type").over(w), 1).otherwise(0).alias("changed"))
    return e.select("user_id", "event_id", F.round(F.least(F.lit(1.0), 0.2 * F.sum("changed").over(w.rowsBetween(-4, 0))), 6).alias("risk"))


@query("""
SELECT user_id, count(*) FILTER (WHERE value > prev) AS rises FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY 1""")
def e8_monotone(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "value", F.lag("value").over(w).alias("prev")).groupBy("user_id").agg(F.count_if(F.col("value") > F.col("prev")).alias("rises"))


@query("""
WITH m AS (SELECT file_id, change_count * 1.0 AS x FROM (SELECT file_id, max(change_count) AS change_count FROM git_files GROUP BY 1))
SELECT file_id, round(x / (SELECT max(x) FROM m), 6)::DOUBLE AS by_max, round((x - (SELECT min(x) FROM m)) / ((SELECT max(x) FROM m) - (SELECT min(x) FROM m)), 6)::DOUBLE AS min_max FROM m""")
def e12_normalisation(spark, d):
    m = table(spark, d, "git_files").groupBy("file_id").agg(F.max("change_count").cast("double").alias("x"))
    return m.crossJoin(m.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))).select("file_id", F.round(F.col("x") / F.col("hi"), 6).alias("by_max"), F.round((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("min_max"))


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
p AS (SELECT event_type, (rn + 1) // 2 AS k, max(CASE WHEN rn % 2 = 1 THEN value END) AS odd, max(CASE WHEN rn % 2 = 0 THEN value END) AS even FROM r GROUP BY 1, 2)
SELECT event_type, round(corr(odd, even), 6) AS r, round(2 * corr(odd, even) / (1 + corr(odd, even)), 6) AS reliability FROM p WHERE odd IS NOT NULL AND even IS NOT NULL GROUP BY 1""")
def e13_split_half(spark, d):
    r = position(table(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], [F.col("event_id")], "rn")
    half = lambda k: F.max(F.when(F.col("rn") % 2 == k, F.col("value")))
    p = r.groupBy("event_type", F.floor((F.col("rn") + 1) / 2).alias("k")).agg(half(1).alias("odd"), half(0).alias("even")).filter("odd is not null and even is not null")
    c = F.corr("odd", "even")
    return p.groupBy("event_type").agg(F.round(c, 6).alias("r"), F.round(2 * c / (1 + c), 6).alias("reliability"))


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT event_type, round(regr_slope(value, i), 9) AS slope, CASE WHEN abs(corr(value, i)) < 0.3 THEN 'volatile' WHEN regr_slope(value, i) > 0.01 THEN 'improving' WHEN regr_slope(value, i) < -0.01 THEN 'declining' ELSE 'stable' END AS trend FROM r GROUP BY 1 HAVING count(*) >= 3""")
def e14_trend(spark, d):
    r = position(table(spark, d, "events").select("event_type", "ts", "event_id", "value"), ["event_type"], [F.col("ts"), F.col("event_id")], "rn").withColumn("i", F.col("rn") - 1)
    s, c = F.regr_slope("value", "i"), F.corr("value", "i")
    trend = F.when(F.abs(c) < 0.3, "volatile").when(s > 0.01, "improving").when(s < -0.01, "declining").otherwise("stable")
    return r.groupBy("event_type").agg(F.round(s, 9).alias("slope"), trend.alias("trend"), F.count("*").alias("n")).filter("n >= 3").drop("n")


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 99 PRECEDING), 8) AS recent FROM events""")
def e15_recent_average(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 8).alias("recent"))


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(value * CASE WHEN back = n THEN power(0.9, n - 1) ELSE 0.1 * power(0.9, back - 1) END), 6) AS ema FROM r GROUP BY 1""")
def e16_ema(spark, d):
    """0.1 r + 0.9 previous, started at the first value, in its closed form: one weighted sum per user."""
    r = position(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], [F.desc("ts"), F.desc("event_id")], "back")
    n = r.groupBy("user_id").agg(F.max("back").alias("n"))
    weight = F.when(F.col("back") == F.col("n"), F.pow(F.lit(0.9), F.col("n") - 1)).otherwise(0.1 * F.pow(F.lit(0.9), F.col("back") - 1))
    return r.join(n, "user_id").groupBy("user_id").agg(F.round(F.sum(F.col("value") * weight), 6).alias("ema"))


# ---- sorts and sets

@query("SELECT row_id, round(coalesce(centrality_score, 0), 9) AS score FROM chunks ORDER BY coalesce(centrality_score, 0) DESC, row_id LIMIT 25")
def f2_top_k(spark, d):
    """A top-k report."""
    return table(spark, d, "chunks").select("row_id", F.round(F.coalesce("centrality_score", F.lit(0.0)), 9).alias("score"), F.coalesce("centrality_score", F.lit(0.0)).alias("s")).orderBy(F.desc("s"), "row_id").limit(25).drop("s")


@query("""
WITH s AS (SELECT file_id, max(change_count) AS n, max(snapshot_at) AS t FROM git_files GROUP BY 1), m AS (SELECT max(snapshot_at) AS now FROM git_files)
SELECT file_id, round(n * (1 + greatest(0, 1 - epoch(now - t) / 86400.0 / 180)), 3)::DOUBLE AS change_score FROM s, m""")
def f5_change_score(spark, d):
    s = table(spark, d, "git_files").groupBy("file_id").agg(F.max("change_count").alias("n"), F.max("snapshot_at").alias("t"))
    days = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("t").cast("timestamp"))) / 1e6 / 86400.0
    return s.crossJoin(s.agg(F.max("t").alias("now"))).select("file_id", F.round(F.col("n") * (1 + F.greatest(F.lit(0.0), 1 - days / 180)), 3).alias("change_score"))


@query("""
WITH m AS (SELECT pack_id, avg(total_tokens) FILTER (WHERE variant_id = 'v0c_bm25_baseline') AS a, avg(total_tokens) FILTER (WHERE variant_id = 'coverage_enhanced') AS b FROM selection_results GROUP BY 1)
SELECT pack_id, round(b - a, 6) AS diff FROM m WHERE a IS NOT NULL AND b IS NOT NULL ORDER BY abs(b - a) DESC, pack_id LIMIT 5""")
def f7_top_contributors(spark, d):
    """A top-five report."""
    return _paired(spark, d).orderBy(F.desc(F.abs(F.col("b") - F.col("a"))), "pack_id").limit(5).select("pack_id", F.round(F.col("b") - F.col("a"), 6).alias("diff"))


@query("""
WITH m AS (SELECT variant_id, avg((coverage_score + diversity_score) / 2) AS x FROM selection_results WHERE coverage_score BETWEEN 0 AND 1 AND diversity_score BETWEEN 0 AND 1 GROUP BY 1)
SELECT variant_id, round(x, 6) AS efficiency, row_number() OVER (ORDER BY x DESC, variant_id) AS place FROM m""")
def f8_efficiency_ranking(spark, d):
    m = table(spark, d, "selection_results").filter("coverage_score between 0 and 1 and diversity_score between 0 and 1").groupBy("variant_id").agg(F.avg((F.col("coverage_score") + F.col("diversity_score")) / 2).alias("x"))
    return m.select("variant_id", F.round("x", 6).alias("efficiency"), F.row_number().over(Window.orderBy(F.desc("x"), "variant_id")).cast("long").alias("place"))


@query("""
WITH u AS (SELECT doc_id, 0 AS src FROM documents WHERE doc_kind = 'readme' UNION ALL SELECT doc_id, 1 FROM documents WHERE text IS NOT NULL)
SELECT doc_id, min(src) AS src FROM u GROUP BY 1""")
def g1_union_distinct_ordered(spark, d):
    docs = table(spark, d, "documents")
    u = docs.filter("doc_kind = 'readme'").select("doc_id", F.lit(0).alias("src")).unionByName(docs.filter("text is not null").select("doc_id", F.lit(1).alias("src")))
    return u.groupBy("doc_id").agg(F.min("src").alias("src"))


@query("""
SELECT DISTINCT pack_id FROM selection_results WHERE variant_id = 'v0c_bm25_baseline' INTERSECT SELECT pack_id FROM selection_results WHERE variant_id = 'coverage_enhanced'""")
def g3_common_packs(spark, d):
    s = table(spark, d, "selection_results")
    return s.filter("variant_id = 'v0c_bm25_baseline'").select("pack_id").intersect(s.filter("variant_id = 'coverage_enhanced'").select("pack_id"))


@query("""SELECT content_sha FROM code_embeddings WHERE content_sha IS NOT NULL EXCEPT SELECT content_sha FROM embedding_cache""")
def g5_uncached(spark, d):
    return table(spark, d, "code_embeddings").filter("content_sha is not null").select("content_sha").distinct().join(table(spark, d, "embedding_cache").select("content_sha"), "content_sha", "left_anti")


@query("""
WITH want AS (SELECT repo_name, unnest(['class', 'function', 'test', 'main', 'import', 'comment']) AS kind FROM (SELECT DISTINCT repo_name FROM chunks))
SELECT repo_name, kind FROM want EXCEPT SELECT repo_name, lower(kind) FROM chunks""")
def g6_coverage_gaps(spark, d):
    c = table(spark, d, "chunks").select("repo_name", F.lower("kind").alias("kind")).distinct()
    want = c.select("repo_name").distinct().select("repo_name", F.explode(F.array(*[F.lit(x) for x in ("class", "function", "test", "main", "import", "comment")])).alias("kind"))
    return want.join(c, (want.repo_name.eqNullSafe(c.repo_name)) & (want.kind == c.kind), "left_anti")


