"""Queries on sources, filters and scalar features (survey groups A, B and H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hewn.functions import paths, text
from hewn.plans.registry import query
from hewn.sources.tables import table

TOK = text.CHUNK_TOKENS_SQL
FILES_SQL = f"""
SELECT file_id, min(rel_path) AS path, min(repo_name) AS repo_name, CAST(sum(strlen(coalesce(content, ''))) AS BIGINT) AS size,
       CAST(max(end_line) AS BIGINT) AS lines, CAST(sum({TOK}) AS BIGINT) AS tokens, count(*) AS chunks
FROM chunks GROUP BY file_id"""


def files(spark, d):
    """One row per file of the chunks table."""
    return (
        table(spark, d, "chunks")
        .groupBy("file_id")
        .agg(
            F.min("rel_path").alias("path"), F.min("repo_name").alias("repo_name"), F.sum(F.octet_length(F.coalesce("content", F.lit("")))).alias("size"),
            F.max("end_line").cast("long").alias("lines"), F.sum(text.chunk_tokens()).alias("tokens"), F.count("*").alias("chunks"),
        )
    )


@query(f"""
WITH f AS ({FILES_SQL})
SELECT file_id, path, size, lines, len(string_split(path, '/')) AS depth,
       CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript'
            WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' END AS language,
       regexp_matches(regexp_extract(lower(path), '([^/]*)$', 1), 'readme|architecture|design') AS is_readme,
       regexp_matches(regexp_extract(lower(path), '([^/]*)$', 1), '^test_.*|.*_test\\.[^.]+$|.*\\.test\\.[^.]+$|.*\\.spec\\.[^.]+$|.*_spec\\.[^.]+$') AS is_test,
       regexp_matches(regexp_extract(lower(path), '([^/]*)$', 1), 'config|settings|options|\\.env|dockerfile|makefile|\\.(json|ya?ml|toml|ini|cfg)$') AS is_config,
       regexp_matches(lower(path), '(^|/)(doc|docs|documentation|manual|guide|tutorial)/|\\.(md|rst|txt)$') AS is_docs
FROM f WHERE size <= 1048576""")
def a1_scan(spark, d):
    f = files(spark, d).filter("size <= 1048576")
    name, low = paths.file_name(F.col("path")), F.lower("path")
    return f.select(
        "file_id", "path", "size", "lines", F.size(F.split("path", "/")).cast("long").alias("depth"), paths.language(F.col("path")).alias("language"),
        name.rlike(paths.README_NAME).alias("is_readme"), name.rlike(paths.TEST_NAME).alias("is_test"),
        name.rlike(r"config|settings|options|\.env|dockerfile|makefile|\.(json|ya?ml|toml|ini|cfg)$").alias("is_config"), low.rlike(paths.DOC_PART).alias("is_docs"),
    )


@query(f"""
WITH f AS ({FILES_SQL})
SELECT file_id, CASE WHEN regexp_matches(path, '(^|/)(build|dist|vendor|node_modules)/') THEN 'ignored' WHEN size > 20000 THEN 'too_large' ELSE 'ok' END AS reason,
       NOT regexp_matches(path, '(^|/)(build|dist|vendor|node_modules)/') AND size <= 20000 AS include FROM f""")
def a3_collect(spark, d):
    drop = paths.ignored(F.col("path"), ["build/", "dist/", "vendor/", "node_modules/"])
    reason = F.when(drop, "ignored").when(F.col("size") > 20000, "too_large").otherwise("ok")
    return files(spark, d).select("file_id", reason.alias("reason"), (reason == "ok").alias("include"))


@query("""
SELECT item_id, array_to_string(list_filter([
  CASE WHEN NOT regexp_matches(coalesce(qid, ''), '^[A-Za-z0-9_-]+$') THEN 'qid' END,
  CASE WHEN coalesce(length(question), 0) NOT BETWEEN 10 AND 500 THEN 'question' END,
  CASE WHEN pack_budget IS NULL OR pack_budget NOT BETWEEN 1000 AND 200000 THEN 'budget' END,
  CASE WHEN lower(difficulty) IS NULL OR lower(difficulty) NOT IN ('easy', 'medium', 'hard') THEN 'difficulty' END,
  CASE WHEN gold.answer_text IS NULL AND gold.regex_pattern IS NULL THEN 'gold' END], lambda x: x IS NOT NULL), ',') AS issues FROM qa_items""")
def a6_qa_schema(spark, d):
    q = table(spark, d, "qa_items")
    rules = [
        (~F.coalesce("qid", F.lit("")).rlike("^[A-Za-z0-9_-]+$"), "qid"),
        (~F.coalesce(F.length("question"), F.lit(0)).between(10, 500), "question"),
        (F.col("pack_budget").isNull() | ~F.col("pack_budget").between(1000, 200000), "budget"),
        (F.col("difficulty").isNull() | ~F.lower("difficulty").isin("easy", "medium", "hard"), "difficulty"),
        (F.col("gold.answer_text").isNull() & F.col("gold.regex_pattern").isNull(), "gold"),
    ]
    return q.select("item_id", F.array_join(F.array(*[F.when(c, F.lit(n)) for c, n in rules]), ",").alias("issues"))


@query("""
SELECT e.model_name, e.model_version, count(*) AS asked, count(c.content_sha) AS hits, count(*) - count(c.content_sha) AS misses
FROM code_embeddings e LEFT JOIN embedding_cache c ON e.content_sha = c.content_sha AND e.model_name = c.model_name AND e.model_version = c.model_version GROUP BY ALL""")
def a8_cache_hits(spark, d):
    e = table(spark, d, "code_embeddings").select("content_sha", "model_name", "model_version")
    c = table(spark, d, "embedding_cache").select("content_sha", "model_name", "model_version", F.lit(1).alias("hit"))
    j = e.join(c, ["content_sha", "model_name", "model_version"], "left")
    return j.groupBy("model_name", "model_version").agg(F.count("*").alias("asked"), F.count("hit").alias("hits"), (F.count("*") - F.count("hit")).alias("misses"))


@query("""
SELECT doc_id, source, CAST(floor(len(string_split_regex(trim(text), '[ \\t\\r\\n]+')) * 1.3) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL AND length(trim(text)) > 0""")
def a21_corpus(spark, d):
    docs = table(spark, d, "documents").filter("text is not null and length(trim(text)) > 0")
    return docs.select("doc_id", "source", F.floor(F.size(F.split(F.trim("text"), r"[ \t\r\n]+")) * F.lit(1.3)).alias("tokens"))


@query(f"""
WITH f AS ({FILES_SQL})
SELECT file_id, path FROM f WHERE regexp_matches(path, '^(?:[^/]+/)*[^/]*\\.(py|go)$') AND NOT regexp_matches(path, '^(vendor|build|dist)/.*$') AND NOT regexp_matches(path, '^(?:[^/]+/)*[^/]*_test\\.[^/]*$')""")
def b2_pattern_filter(spark, d):
    keep = paths.included(F.col("path"), F.col("size"), ["*.py", "*.go"], ["vendor/**", "build/**", "dist/**", "*_test.*"])
    return files(spark, d).filter(keep).select("file_id", "path")


@query(f"""
WITH f AS ({FILES_SQL})
SELECT file_id, regexp_matches(path, '(^|/)(tests|docs)/') OR regexp_matches(path, '(^|/)[^/]*\\.java(/|$)') AS ignored FROM f""")
def b4_ignore_rules(spark, d):
    return files(spark, d).select("file_id", paths.ignored(F.col("path"), ["# comment", "tests/", "docs/", "*.java", "!keep"]).alias("ignored"))


@query(f"""
WITH f AS ({FILES_SQL})
SELECT file_id, path = 'core/index.py' AS exact, path LIKE '%.rs' AS suffix, regexp_matches(path, '^src/(?:[^/]+/)*[^/]*\\.ts$') AS glob, regexp_matches(path, '[0-9]+') AS regex, false AS broken FROM f""")
def b5_match_modes(spark, d):
    p = F.col("path")
    return files(spark, d).select(
        "file_id", paths.matches(p, "core/index.py", "EXACT").alias("exact"), paths.matches(p, ".rs", "SUFFIX").alias("suffix"), paths.matches(p, "src/**/*.ts", "GLOB").alias("glob"),
        paths.matches(p, "[0-9]+", "REGEX").alias("regex"), paths.matches(p, "[", "REGEX").alias("broken"),
    )


@query("""
SELECT doc_id, contains(text, chr(0)) OR length(regexp_replace(substr(text, 1, 8192), '[\\x20-\\x7E\\t\\n\\r]', '', 'g')) > 0.25 * greatest(1, length(substr(text, 1, 8192))) AS looks_binary
FROM documents WHERE text IS NOT NULL""")
def b7_binary_sniff(spark, d):
    head = F.substring("text", 1, 8192)
    odd = F.length(F.regexp_replace(head, r"[\x20-\x7E\t\n\r]", ""))
    nul = F.locate("\x00", F.col("text")) > 0
    return table(spark, d, "documents").filter("text is not null").select("doc_id", (nul | (odd > 0.25 * F.greatest(F.lit(1), F.length(head)))).alias("looks_binary"))


_MARKERS = " + ".join(f"CASE WHEN contains(top, '{m}') THEN 0.4 ELSE 0 END" for m in text.GENERATED_MARKERS)


@query(f"""
WITH a AS (SELECT row_id, list_transform(string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10))[1:51], lambda x: trim(x, ' ')) AS head FROM chunks WHERE content IS NOT NULL),
b AS (SELECT row_id, head, lower(array_to_string(head[1:10], chr(10))) AS top, array_to_string(head, chr(10)) AS body, len(head) AS n FROM a)
SELECT row_id, round(least(1.0, {_MARKERS} + CASE WHEN len(list_distinct(head)) < n * 0.3 THEN 0.2 ELSE 0 END
  + CASE WHEN len(list_filter(head, lambda x: length(x) > 200)) > n * 0.1 THEN 0.3 ELSE 0 END
  + CASE WHEN NOT (contains(body, '#') OR contains(body, '//') OR contains(body, '/*') OR contains(body, '*/') OR contains(body, '<!--') OR contains(body, '-->') OR contains(body, '''''''') OR contains(body, '\"\"\"')) AND n > 10 THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS score FROM b""")
def b8_generated_score(spark, d):
    return table(spark, d, "chunks").filter("content is not null").select("row_id", F.round(text.generated_score(F.col("content")), 6).alias("score"))


@query(f"""
WITH f AS ({FILES_SQL}), g AS (SELECT CASE WHEN regexp_matches(regexp_extract(lower(path), '([^/]*)$', 1), '\\.(json|ya?ml|toml|ini|cfg|conf)$|^(requirements\\.txt|setup\\.py|makefile|dockerfile)$') THEN 'config'
  WHEN regexp_matches(lower(path), '(^|/)(main|__main__|app|server|index)\\.py$|(^|/)(main|index|app|server)\\.js$|(^|/)(index|main)\\.ts$|(^|/)main\\.(go|rs)$|(^|/)(lib|mod)\\.rs$') THEN 'entry'
  WHEN regexp_matches(lower(path), '(^|/)(examples?|demos?|samples?|tutorials?|tests?|specs?|benchmarks?)/') THEN 'examples' ELSE 'general' END AS category, size FROM f)
SELECT category, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM g GROUP BY 1""")
def b13_categories(spark, d):
    return files(spark, d).groupBy(paths.category(F.col("path")).alias("category")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("""
SELECT b.config_id, count(*) AS kept FROM chunks c JOIN baseline_configs b ON coalesce(c.doc_density, 0) >= b.min_doc_density AND coalesce(c.complexity_score, 0) <= b.max_complexity GROUP BY 1""")
def b14_prefilter(spark, d):
    c = table(spark, d, "chunks").select(F.coalesce("doc_density", F.lit(0.0)).alias("dd"), F.coalesce("complexity_score", F.lit(0.0)).alias("cx"))
    b = table(spark, d, "baseline_configs")
    # configurations are few distinct limits: rows are counted once per limit pair instead of once per configuration
    limits = b.select("min_doc_density", "max_complexity").distinct()
    kept = c.join(limits, (F.col("dd") >= F.col("min_doc_density")) & (F.col("cx") <= F.col("max_complexity")))
    return kept.groupBy("min_doc_density", "max_complexity").agg(F.count("*").alias("kept")).join(b, ["min_doc_density", "max_complexity"]).select("config_id", "kept")


@query(f"""
WITH f AS ({FILES_SQL})
SELECT file_id, CASE WHEN regexp_matches(lower(path), 'test|spec') THEN 'test' WHEN regexp_matches(lower(path), 'doc|readme') THEN 'doc' WHEN regexp_matches(lower(path), 'config|\\.(json|ya?ml|toml)$') THEN 'config'
  WHEN regexp_matches(lower(path), 'build|makefile|dockerfile') THEN 'build' WHEN regexp_matches(lower(path), 'asset|static|public') THEN 'assets' ELSE 'core_logic' END AS role,
  regexp_matches(lower(path), '\\.env|secret|key|credential') AS secret_path FROM f""")
def b19_semantic_role(spark, d):
    p = F.lower("path")
    role = (
        F.when(p.rlike("test|spec"), "test").when(p.rlike("doc|readme"), "doc").when(p.rlike(r"config|\.(json|ya?ml|toml)$"), "config")
        .when(p.rlike("build|makefile|dockerfile"), "build").when(p.rlike("asset|static|public"), "assets").otherwise("core_logic")
    )
    return files(spark, d).select("file_id", role.alias("role"), p.rlike(r"\.env|secret|key|credential").alias("secret_path"))


@query("""
WITH s AS (SELECT file_id, max(change_count) AS n FROM git_files GROUP BY 1), m AS (SELECT max(n) AS top FROM s)
SELECT CASE WHEN n * 1.0 / top >= 0.7 THEN 'high' WHEN n * 1.0 / top >= 0.4 THEN 'medium' WHEN n * 1.0 / top >= 0.2 THEN 'low' ELSE 'minimal' END AS tier, count(*) AS files FROM s, m GROUP BY 1""")
def b20_relevance_tier(spark, d):
    s = table(spark, d, "git_files").groupBy("file_id").agg(F.max("change_count").alias("n"))
    r = F.col("n") / F.col("top")
    tier = F.when(r >= 0.7, "high").when(r >= 0.4, "medium").when(r >= 0.2, "low").otherwise("minimal")
    return s.crossJoin(s.agg(F.max("n").alias("top"))).groupBy(tier.alias("tier")).agg(F.count("*").alias("files"))


@query("""
SELECT CASE WHEN contains(upper(content), 'MIT') THEN 'MIT' WHEN contains(upper(content), 'APACHE') THEN 'Apache' WHEN contains(upper(content), 'BSD') THEN 'BSD' WHEN contains(upper(content), 'GPL') THEN 'GPL' ELSE 'Other' END AS license, count(*) AS chunks
FROM chunks WHERE lower(kind) IN ('module_header', 'comment') GROUP BY 1""")
def b23_license(spark, d):
    up = F.upper("content")
    lic = F.when(F.contains(up, F.lit("MIT")), "MIT").when(F.contains(up, F.lit("APACHE")), "Apache").when(F.contains(up, F.lit("BSD")), "BSD").when(F.contains(up, F.lit("GPL")), "GPL").otherwise("Other")
    return table(spark, d, "chunks").filter(F.lower("kind").isin("module_header", "comment")).groupBy(lic.alias("license")).agg(F.count("*").alias("chunks"))


@query(f"SELECT row_id, {TOK} AS tokens FROM chunks WHERE {TOK} >= 50")
def b25_min_tokens(spark, d):
    return table(spark, d, "chunks").select("row_id", text.chunk_tokens().alias("tokens")).filter("tokens >= 50")


@query(f"""
WITH f AS ({FILES_SQL})
SELECT lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(size) // 4 AS BIGINT) AS tokens FROM f GROUP BY 1""")
def b26_analyzer(spark, d):
    return files(spark, d).groupBy(paths.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.floor(F.sum("size") / 4).alias("tokens"))


@query("""
SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x, ' '), '#'))) AS headings,
 len(regexp_extract_all(text, '\\[[^\\]]+\\]\\([^)]+\\)')) AS links, CAST(len(regexp_extract_all(text, '```')) // 2 AS BIGINT) AS code_blocks,
 round(100.0 * len(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x, ' '), '#'))) / len(string_split(text, chr(10))), 6) AS heading_density FROM documents WHERE text IS NOT NULL""")
def h2_document_analysis(spark, d):
    ls = F.split("text", "\n")
    heads = F.size(F.filter(ls, lambda x: F.ltrim(x).startswith("#"))).cast("long")
    return table(spark, d, "documents").filter("text is not null").select(
        "doc_id", heads.alias("headings"), F.regexp_count("text", F.lit(r"\[[^\]]+\]\([^)]+\)")).cast("long").alias("links"),
        F.floor(F.regexp_count("text", F.lit("```")) / 2).alias("code_blocks"), F.round(100.0 * heads / F.size(ls), 6).alias("heading_density"),
    )


@query("""
SELECT row_id, list_sort(list_distinct(list_filter(regexp_extract_all(content, '(?m)^(?:from|import|use)\\s+([A-Za-z_][A-Za-z0-9_.:]*)', 1), lambda x: x <> ''))) AS imports FROM chunks WHERE lower(kind) = 'import' AND content IS NOT NULL""")
def h1_imports(spark, d):
    found = F.regexp_extract_all("content", F.lit(r"(?m)^(?:from|import|use)\s+([A-Za-z_][A-Za-z0-9_.:]*)"), F.lit(1))
    return table(spark, d, "chunks").filter("lower(kind) = 'import' and content is not null").select("row_id", F.array_sort(F.array_distinct(found)).alias("imports"))


@query("""
SELECT row_id, list_filter(string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '^\\s*(async def|def|class|function|export|func|fn|pub fn|public|private)\\s'))[1:10] AS signatures FROM chunks WHERE content IS NOT NULL""")
def h3_signatures(spark, d):
    sig = F.slice(F.filter(text.lines(F.col("content")), lambda x: x.rlike(r"^\s*(async def|def|class|function|export|func|fn|pub fn|public|private)\s")), 1, 10)
    return table(spark, d, "chunks").filter("content is not null").select("row_id", sig.alias("signatures"))


@query(f"WITH f AS ({FILES_SQL}) SELECT file_id, CAST(greatest(floor(size / 4), floor(size / 3.2), lines * 10) AS BIGINT) AS tokens FROM f")
def h4_scan_tokens(spark, d):
    return files(spark, d).select("file_id", text.scan_tokens(F.col("size"), F.col("lines")).alias("tokens"))


@query("SELECT doc_id, CAST(greatest(1, floor(coalesce(length(text), 0) / 4.0)) AS BIGINT) AS t4, CAST(greatest(1, floor(coalesce(length(text), 0) / 3.8)) AS BIGINT) AS t38 FROM documents")
def h6_approx_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", text.approx_tokens(F.col("text")).alias("t4"), text.approx_tokens(F.col("text"), 3.8).alias("t38"))


@query("""
WITH g AS (SELECT file_id, max(CASE WHEN last_modified > 1e14 THEN last_modified / 1e6 WHEN last_modified > 1e11 THEN last_modified / 1e3 WHEN last_modified > 0 THEN last_modified END) AS t FROM git_files GROUP BY 1),
m AS (SELECT max(t) AS now FROM g)
SELECT file_id, CAST(CASE WHEN t IS NULL THEN 0.1 WHEN (now - t) / 86400 < 1 THEN 1.0 WHEN (now - t) / 86400 < 7 THEN 0.7 WHEN (now - t) / 86400 < 30 THEN 0.4 ELSE 0.1 END AS DOUBLE) AS churn FROM g, m""")
def h8_churn(spark, d):
    t = F.col("last_modified")
    seconds = F.when(t > 1e14, t / 1e6).when(t > 1e11, t / 1e3).when(t > 0, t)
    g = table(spark, d, "git_files").groupBy("file_id").agg(F.max(seconds).alias("t"))
    age = (F.col("now") - F.col("t")) / 86400
    return g.crossJoin(g.agg(F.max("t").alias("now"))).select("file_id", F.when(F.col("t").isNull(), 0.1).when(age < 1, 1.0).when(age < 7, 0.7).when(age < 30, 0.4).otherwise(0.1).alias("churn"))


@query("""
WITH w AS (SELECT doc_id, string_split_regex(trim(text), '[ \\t\\r\\n]+') AS words FROM documents WHERE text IS NOT NULL AND length(trim(text)) > 0)
SELECT doc_id, CAST(i / 80 AS BIGINT) AS pos, array_to_string(words[i + 1:i + 100], ' ') AS piece FROM (SELECT doc_id, words, unnest(range(0, len(words), 80)) AS i FROM w)""")
def h19_word_windows(spark, d):
    words = F.split(F.trim("text"), r"[ \t\r\n]+")
    docs = table(spark, d, "documents").filter("text is not null and length(trim(text)) > 0")
    return docs.select("doc_id", F.posexplode(text.word_windows(words, 100, 20)).alias("pos", "w")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_join("w", " ").alias("piece"))


@query("""
WITH l AS (SELECT row_id, string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM chunks WHERE content IS NOT NULL)
SELECT row_id, CAST(i / 20 AS BIGINT) AS block, array_to_string(ls[i + 1:i + 20], chr(10)) AS body FROM (SELECT row_id, ls, unnest(range(0, len(ls), 20)) AS i FROM l)""")
def h20_line_blocks(spark, d):
    c = table(spark, d, "chunks").filter("content is not null")
    return c.select("row_id", F.posexplode(text.line_blocks(F.col("content"))).alias("block", "body")).withColumn("block", F.col("block").cast("long"))


@query("""
SELECT row_id, round(CAST(least(1.0, CASE lower(kind) WHEN 'class' THEN 0.9 WHEN 'function' THEN 0.7 WHEN 'import' THEN 0.9 WHEN 'docstring' THEN 0.5 WHEN 'comment' THEN 0.2 ELSE 0.5 END
 * CASE WHEN contains(lower(content), 'export') OR contains(lower(content), 'pub') THEN 1.2 ELSE 1 END * CASE WHEN contains(lower(content), 'main') OR contains(lower(content), 'init') THEN 1.3 ELSE 1 END
 * CASE WHEN regexp_matches(lower(content), 'test|example|demo|mock') THEN 0.7 ELSE 1 END * CASE WHEN len(regexp_extract_all(content, '[{}()\\[\\]]')) > 10 THEN 1.1 ELSE 1 END) AS DOUBLE), 6) AS importance FROM chunks WHERE content IS NOT NULL""")
def h21_chunk_importance(spark, d):
    c = table(spark, d, "chunks").filter("content is not null")
    return c.select("row_id", F.round(text.chunk_importance(F.col("content"), F.lower("kind")), 6).alias("importance"))


@query("""
WITH l AS (SELECT row_id, content, docstring, list_filter(list_transform(string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '^(#|//|/\\*|\\*)')) AS notes FROM chunks WHERE content IS NOT NULL)
SELECT row_id, round(CASE WHEN length(content) > 0 THEN least(1.0, (coalesce(length(docstring), 0) + coalesce(list_sum(list_transform(notes, lambda x: length(x))), 0)) / length(content)) ELSE 0 END::DOUBLE, 6) AS density FROM l""")
def h22_doc_density(spark, d):
    c = table(spark, d, "chunks").filter("content is not null")
    return c.select("row_id", F.round(text.doc_density(F.col("content"), F.col("docstring")), 6).alias("density"))


@query("SELECT row_id, substr(sha256(concat_ws('|', rel_path, CAST(start_line AS VARCHAR), CAST(end_line AS VARCHAR), kind, substr(content, 1, 100))), 1, 8) AS det_id FROM chunks")
def h23_deterministic_id(spark, d):
    return table(spark, d, "chunks").select("row_id", text.deterministic_id(*[F.col(c) for c in ("rel_path", "start_line", "end_line", "kind", "content")]).alias("det_id"))


@query("""
SELECT item_id, round(len(list_filter(gold.key_concepts, lambda c: contains(lower(gold.answer_text), lower(c)))) / len(gold.key_concepts), 6) AS found,
 round(len(list_filter(gold.key_concepts, lambda c: contains(lower(gold.answer_text), lower(c)))) / len(gold.key_concepts) * CASE lower(difficulty) WHEN 'easy' THEN 1.0 WHEN 'medium' THEN 0.9 ELSE 0.8 END, 6)::DOUBLE AS weighted
FROM qa_items WHERE len(gold.key_concepts) > 0 AND gold.answer_text IS NOT NULL""")
def h30_concept_coverage(spark, d):
    low = F.lower("gold.answer_text")
    hit = F.size(F.filter("gold.key_concepts", lambda c: F.contains(low, F.lower(c)))) / F.size("gold.key_concepts")
    weight = F.when(F.lower("difficulty") == "easy", 1.0).when(F.lower("difficulty") == "medium", 0.9).otherwise(0.8)
    q = table(spark, d, "qa_items").filter("size(gold.key_concepts) > 0 and gold.answer_text is not null")
    return q.select("item_id", F.round(hit, 6).alias("found"), F.round(hit * weight, 6).alias("weighted"))


@query("""
WITH b AS (SELECT r.run_id, r.total_tokens AS used, c.token_budget AS budget FROM selection_results r JOIN baseline_configs c USING (config_id))
SELECT run_id, array_to_string(list_filter([CASE WHEN used IS NULL THEN 'unknown' END, CASE WHEN used > budget THEN 'overflow' END, CASE WHEN used < budget * 0.995 THEN 'underflow' END,
  CASE WHEN abs(used - budget) > budget * 0.05 THEN 'parity' END], lambda x: x IS NOT NULL), ',') AS violations FROM b""")
def h32_budget_checks(spark, d):
    j = table(spark, d, "selection_results").join(table(spark, d, "baseline_configs").select("config_id", "token_budget"), "config_id")
    used, budget = F.col("total_tokens"), F.col("token_budget")
    rules = [(used.isNull(), "unknown"), (used > budget, "overflow"), (used < budget * 0.995, "underflow"), (F.abs(used - budget) > budget * 0.05, "parity")]
    return j.select("run_id", F.array_join(F.array(*[F.when(c, F.lit(n)) for c, n in rules]), ",").alias("violations"))
