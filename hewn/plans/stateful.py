"""Stateful behaviour in batch form, pack output, and extras on the event tables (survey groups A16-A18, M, P)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hewn.functions import text
from hewn.operators.prefix import position
from hewn.plans.registry import query
from hewn.plans.relational import e2_greedy_break
from hewn.sources import sinks
from hewn.sources.tables import table

TOK = text.CHUNK_TOKENS_SQL


@query("""
SELECT user_id, event_id, coalesce(ts < max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 1 HOUR, false) AS banned FROM events""")
def m1_ban_list(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("event_type") == "error", F.col("ts"))).over(w)
    return table(spark, d, "events").select("user_id", "event_id", F.coalesce(F.col("ts") < last + F.expr("INTERVAL 1 HOUR"), F.lit(False)).alias("banned"))


@query("""
WITH r AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
SELECT user_id, string_agg(event_type, ',' ORDER BY back DESC) AS history FROM r WHERE back <= 10 GROUP BY 1""")
def m2_event_history(spark, d):
    """The last ten modes of every user; ten are the history's length."""
    r = position(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], "back").filter("back <= 10")
    return r.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("b"), "event_type"))), lambda s: s["event_type"]), ",").alias("history"))


@query("""
WITH r AS (SELECT event_type AS arm, value / (SELECT max(value) FROM events) AS reward FROM events WHERE value IS NOT NULL)
SELECT arm, count(*) AS trials, round(1 + sum(CASE WHEN reward > 0.5 THEN reward ELSE 0 END), 6) AS alpha, round(1 + sum(CASE WHEN reward > 0.5 THEN 0 ELSE 1 - reward END), 6) AS beta FROM r GROUP BY 1""")
def m3_bandit_posterior(spark, d):
    """The arms' Beta posteriors after all rewards; updates add up, so their order does not matter."""
    e = table(spark, d, "events").filter("value is not null")
    r = e.crossJoin(e.agg(F.max("value").alias("m"))).select(F.col("event_type").alias("arm"), (F.col("value") / F.col("m")).alias("r"))
    win = F.col("r") > 0.5
    return r.groupBy("arm").agg(F.count("*").alias("trials"), F.round(1 + F.sum(F.when(win, F.col("r")).otherwise(0.0)), 6).alias("alpha"), F.round(1 + F.sum(F.when(win, 0.0).otherwise(1 - F.col("r"))), 6).alias("beta"))


_ARM_U = "((CAST('0x' || substr(md5(arm || ':{s}'), 1, 7) AS BIGINT) + 1) / 268435457.0)"


@query(f"""
WITH r AS (SELECT event_type AS arm, value / (SELECT max(value) FROM events) AS reward FROM events WHERE value IS NOT NULL),
p AS (SELECT arm, count(*) AS trials, round(1 + sum(CASE WHEN reward > 0.5 THEN reward ELSE 0 END), 6) AS a, round(1 + sum(CASE WHEN reward > 0.5 THEN 0 ELSE 1 - reward END), 6) AS b, avg(reward) AS context FROM r GROUP BY 1)
SELECT arm, round(a / (a + b) + sqrt(-2 * ln({_ARM_U.format(s=1)})) * cos(2 * pi() * {_ARM_U.format(s=2)}) * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) + 0.3 * context + 0.1 / sqrt(trials + 1), 6) AS score FROM p""")
def m3_bandit_choice(spark, d):
    """One seeded Thompson draw per arm (mean plus scaled normal deviate), a context term (the arm's mean reward, .3) and an exploration bonus."""
    e = table(spark, d, "events").filter("value is not null")
    context = e.crossJoin(e.agg(F.max("value").alias("m"))).groupBy(F.col("event_type").alias("arm")).agg(F.avg(F.col("value") / F.col("m")).alias("context"))
    p = m3_bandit_posterior(spark, d).join(context, "arm")
    n = F.col("alpha") + F.col("beta")
    mean, var = F.col("alpha") / n, F.col("alpha") * F.col("beta") / (n * n * (n + 1))
    u = lambda s: (F.conv(F.substring(F.md5(F.concat("arm", F.lit(f":{s}"))), 1, 7), 16, 10).cast("long") + 1) / 268435457.0
    z = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(2))
    return p.select("arm", F.round(mean + z * F.sqrt(var) + 0.3 * F.col("context") + 0.1 / F.sqrt(F.col("trials") + 1), 6).alias("score"))


@query(f"""
WITH s AS (SELECT repo_name, row_id, sum({TOK}) OVER (PARTITION BY repo_name ORDER BY coalesce(centrality_score, 0) DESC, row_id ROWS UNBOUNDED PRECEDING) AS cum FROM chunks),
p AS (SELECT s.repo_name, s.row_id, c.content FROM s JOIN chunks c USING (row_id) WHERE cum <= 2000)
SELECT repo_name, count(*) AS sections, sha256(string_agg(sha256(coalesce(content, '')), '' ORDER BY row_id)) AS manifest FROM p GROUP BY 1""")
def a16_pack_manifest(spark, d):
    """The manifest of each pack: a hash over its sections' hashes; a pack has at most as many sections as its budget has tokens, and empty ones."""
    p = e2_greedy_break(spark, d).select("row_id").join(table(spark, d, "chunks").select("row_id", "repo_name", "content"), "row_id")
    own = p.select("repo_name", F.struct("row_id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("h")).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["h"]), "")
    return own.groupBy("repo_name").agg(F.count("*").alias("sections"), F.sha2(joined, 256).alias("manifest"))


@query("""
SELECT row_id, '<section><h2>' || replace(replace(replace(replace(rel_path, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</h2><pre>' ||
 replace(replace(replace(replace(coalesce(content, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</pre></section>' AS html, '## ' || rel_path || chr(10) || chr(10) || '```' || chr(10) || coalesce(content, '') || chr(10) || '```' || chr(10) AS markdown FROM chunks""")
def a18_sections(spark, d):
    p, c = F.col("rel_path"), F.col("content")
    return table(spark, d, "chunks").select("row_id", sinks.section(p, c, "html").alias("html"), sinks.section(p, c, "markdown").alias("markdown"))


@query("""SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g1, CAST(grouping(l_linestatus) AS BIGINT) AS g2, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def x_rollup_revenue(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(
        F.grouping("l_returnflag").cast("long").alias("g1"), F.grouping("l_linestatus").cast("long").alias("g2"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")
    )


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def x_tumbling_events(spark, d):
    return table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"
    )


@query("""
WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def x_session_events(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
