"""Queries over the plug-in registries, caches and schedules (survey groups M6, M7, N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hewn import plugins
from hewn.functions import text
from hewn.operators.prefix import position, prefix_sum
from hewn.plans.registry import ORACLE_SQL, QUERIES, query
from hewn.sources.tables import table

TOK = text.CHUNK_TOKENS_SQL


@query("""SELECT doc_id, unnest(['chars4', 'chars38', 'words13', 'lines10']) AS tokenizer, unnest([CAST(greatest(1, floor(coalesce(length(text), 0) / 4.0)) AS BIGINT), CAST(greatest(1, floor(coalesce(length(text), 0) / 3.8)) AS BIGINT),
 CAST(floor(len(string_split_regex(trim(coalesce(text, '')), '[ \\t\\r\\n]+')) * 1.3) AS BIGINT), CAST(len(string_split(coalesce(text, ''), chr(10))) * 10 AS BIGINT)]) AS tokens FROM documents""")
def n1_tokenizers(spark, d):
    """Every registered token counter over the documents."""
    each = F.array(*[F.struct(F.lit(k).alias("tokenizer"), f(F.col("text")).alias("tokens")) for k, f in plugins.TOKENIZERS.items()])
    return table(spark, d, "documents").select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.tokenizer", "x.tokens")


_ITEMS = f"i AS (SELECT repo_name, row_id, {TOK} AS tokens, coalesce(centrality_score, 0) AS score, ingested_at, kind FROM chunks)"
_ORDERS = {"score": "score DESC", "smallest": "tokens", "recent": "ingested_at DESC", "hash": "md5(row_id || ':42')"}


def _items(spark, d):
    return table(spark, d, "chunks").select("repo_name", "row_id", text.chunk_tokens().alias("tokens"), F.coalesce("centrality_score", F.lit(0.0)).alias("score"), "ingested_at", "kind")


@query(f"WITH {_ITEMS} SELECT selector, repo_name, count(*) AS chunks, CAST(sum(tokens) AS BIGINT) AS tokens FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS selector, repo_name, tokens, sum(tokens) OVER (PARTITION BY repo_name ORDER BY {o}, row_id ROWS UNBOUNDED PRECEDING) AS cum FROM i" for k, o in _ORDERS.items()) + ") WHERE cum <= 2000 GROUP BY 1, 2")
def n2_baselines(spark, d):
    """Every registered selector by the same template, within 2,000 tokens per repository."""
    out = None
    for name in plugins.SELECTORS:
        one = plugins.select(_items(spark, d), name, 2000).groupBy("repo_name").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens")).select(F.lit(name).alias("selector"), "repo_name", "chunks", "tokens")
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH a AS (" + " UNION ALL ".join(f"SELECT '{v}' AS variant, repo_name, tokens FROM ({ORACLE_SQL[q]})" for v, q in plugins.VARIANTS.items()) + ") SELECT variant, repo_name, count(*) AS chunks, CAST(sum(tokens) AS BIGINT) AS tokens FROM a GROUP BY 1, 2")
def n3_variants(spark, d):
    """Every variant by dispatch to its strategy; strategies that several variants share run once."""
    done = {q: QUERIES[q](spark, d).groupBy("repo_name").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens")) for q in dict.fromkeys(plugins.VARIANTS.values())}
    out = None
    for q, df in done.items():
        names = F.array(*[F.lit(v) for v, x in plugins.VARIANTS.items() if x == q])
        one = df.select(F.explode(names).alias("variant"), "repo_name", "chunks", "tokens")
        out = one if out is None else out.unionByName(one)
    return out


@query(" UNION ALL ".join(f"SELECT '{k}' AS provider, count(*) AS vectors FROM ({ORACLE_SQL[q]})" for k, q in plugins.PROVIDERS.items()))
def n4_providers(spark, d):
    """How many chunks each registered provider has a vector for."""
    out = None
    for name, q in plugins.PROVIDERS.items():
        one = QUERIES[q](spark, d).agg(F.lit(name).alias("provider"), F.count("*").alias("vectors"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH v AS (SELECT 'budget' AS oracle, count(*) AS n FROM ({ORACLE_SQL['o1_budget_oracle']}) UNION ALL SELECT 'packs', CAST(sum(violations) AS BIGINT) FROM ({ORACLE_SQL['o1_pack_oracles']}) UNION ALL SELECT 'selection', count(*) FROM ({ORACLE_SQL['o2_selection_oracle']}) WHERE failed <> '')
SELECT oracle, coalesce(n, 0) AS violations, CASE WHEN n IS NULL THEN 'SKIP' WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM v""")
def n5_oracles(spark, d):
    """The status of every registered oracle: PASS, FAIL, or SKIP where there is nothing to check."""
    out = None
    for name, q in plugins.ORACLES.items():
        df = QUERIES[q](spark, d)
        n = F.sum("violations") if "violations" in df.columns else F.count_if(F.col("failed") != "") if "failed" in df.columns else F.count("*")
        one = df.agg(F.lit(name).alias("oracle"), n.cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.select("oracle", F.coalesce("n", F.lit(0)).alias("violations"), F.when(F.col("n").isNull(), "SKIP").when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("status"))


_ESC = lambda c: f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"""WITH c AS (SELECT coalesce(rel_path, '') AS p, coalesce(content, '') AS b FROM chunks WHERE rel_path IS NOT NULL) SELECT form, count(*) AS sections, CAST(sum(n) AS BIGINT) AS chars FROM (
SELECT 'markdown' AS form, length(p) + length(b) + 14 AS n FROM c UNION ALL SELECT 'plain', length(p) + length(b) + 36 FROM c UNION ALL SELECT 'html', length({_ESC('p')}) + length({_ESC('b')}) + 39 FROM c UNION ALL SELECT 'xml', length({_ESC('p')}) + length({_ESC('b')}) + 29 FROM c) GROUP BY 1""")
def n6_formatters(spark, d):
    """Sections and characters of all chunks by the registered text formatters."""
    c = table(spark, d, "chunks").filter("rel_path is not null")
    each = F.array(*[F.struct(F.lit(k).alias("form"), F.length(f(F.col("rel_path"), F.col("content"))).alias("n")) for k, f in plugins.FORMATTERS.items() if k != "json"])
    return c.select(F.explode(each).alias("x")).groupBy("x.form").agg(F.count("*").alias("sections"), F.sum("x.n").alias("chars"))


@query(f"WITH {_ITEMS} SELECT repo_name, row_id, CAST(cum AS BIGINT) AS cum_tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY repo_name ORDER BY tokens DESC, row_id ROWS UNBOUNDED PRECEDING) AS cum FROM i WHERE lower(kind) IN ('class', 'function') AND tokens < 500) WHERE cum <= 2000")
def n8_callables(spark, d):
    """A selection with the caller's own filter and key, given as Columns."""
    keep = lambda: F.lower("kind").isin("class", "function") & (F.col("tokens") < 500)
    return plugins.select(_items(spark, d), "score", 2000, keep, lambda: [F.desc("tokens"), F.col("row_id")]).select("repo_name", "row_id", F.col("cum_tokens").cast("long").alias("cum_tokens"))


@query("SELECT * FROM (VALUES ('centrality', true), ('demotion', true), ('patch', true), ('quotas', true), ('router', false)) f(flag, enabled)")
def n9_flags(spark, d):
    """The flags as they are without any variable set."""
    f = plugins.Flags.from_env({})
    return spark.createDataFrame([(k, v) for k, v in vars(f).items()], "flag string, enabled boolean")


@query("""WITH r AS (SELECT model_name, vec_id, row_number() OVER (PARTITION BY model_name ORDER BY last_accessed DESC NULLS LAST, vec_id) AS rn FROM embedding_cache)
SELECT model_name, count(*) FILTER (WHERE rn <= 100) AS kept, count(*) FILTER (WHERE rn > 100) AS evicted FROM r GROUP BY 1""")
def m6_lru_cache(spark, d):
    """What a cache of 100 entries per model keeps and evicts, by last access."""
    c = table(spark, d, "embedding_cache").select("model_name", "vec_id", "last_accessed")
    r = position(c, ["model_name"], [F.col("last_accessed").desc_nulls_last(), F.col("vec_id")], "rn")
    return r.groupBy("model_name").agg(F.count_if(F.col("rn") <= 100).alias("kept"), F.count_if(F.col("rn") > 100).alias("evicted"))


@query("""WITH s AS (SELECT pack_id, run_id, coalesce(iterations, 0) AS cost, sum(coalesce(iterations, 0)) OVER (PARTITION BY pack_id ORDER BY created_at, run_id ROWS UNBOUNDED PRECEDING) AS cum FROM selection_results), b AS (SELECT pack_id, run_id, cost, cum, 0.8 * sum(cost) OVER (PARTITION BY pack_id) AS lim FROM s)
SELECT run_id, CASE WHEN cum - cost >= lim THEN 'skipped' WHEN cum - cost > 0.7 * lim THEN 'degraded' ELSE 'full' END AS phase_mode FROM b""")
def m7_phase_schedule(spark, d):
    """Runs of a pack as phases of a schedule with four fifths of their total cost: past seven tenths a phase runs degraded, past the end not at all. Costs are iterations, so the schedule is the same every time."""
    s = table(spark, d, "selection_results").select("pack_id", "run_id", "created_at", F.coalesce("iterations", F.lit(0)).cast("long").alias("cost"))
    total = s.groupBy(F.col("pack_id").alias("p")).agg((0.8 * F.sum("cost")).alias("lim"))
    r = prefix_sum(s, ["pack_id"], [F.col("created_at"), F.col("run_id")], "cost").join(total, F.col("pack_id").eqNullSafe(F.col("p")))
    before = F.col("cum") - F.col("cost")
    return r.select("run_id", F.when(before >= F.col("lim"), "skipped").when(before > 0.7 * F.col("lim"), "degraded").otherwise("full").alias("phase_mode"))
