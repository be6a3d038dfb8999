"""File and chunk scores with all their components (survey groups B6, B11, B12, B14, B18, B24, H3, H9-H15, H17, H27, H31, H33)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hewn.functions import paths, text
from hewn.operators import graph
from hewn.plans.analysis import EDGES_SQL, _graph, _rank_sql
from hewn.plans.registry import ORACLE_SQL, query
from hewn.plans.scan import FILES_SQL, files, h8_churn
from hewn.sources.tables import table

TOK = text.CHUNK_TOKENS_SQL
NAME_SQL = "regexp_extract(lower(path), '([^/]*)$', 1)"


def _sum(parts) -> F.Column:
    """The sum of (condition, value) pairs; null conditions count as false."""
    out = F.lit(0.0)
    for c, v in parts:
        out = out + F.when(c, v).otherwise(0.0)
    return out


def _sum_sql(parts) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {v} ELSE 0 END" for c, v in parts)


# ---- filter decision

# Rules on the path, the first that matches counts: regex, reason, confidence.
PATH_RULES = [
    (r"(^|/)\.(git|svn|hg)/", "vcs_file", 0.95), (r"(^|/)\.(idea|vscode|vs)/", "ide_file", 0.95), (r"(^|/)(node_modules|vendor|pods|site-packages|bower_components)/", "package_manager", 0.95),
    (r"(^|/)(venv|\.venv|env)/", "virtual_env", 0.95), (r"(^|/)(__pycache__|\.cache|\.pytest_cache|\.mypy_cache|\.tox)/", "config_cache", 0.95),
    (r"(^|/)(build|dist|out|target|bin|obj|coverage|htmlcov)/", "build_artifact", 0.95), (r"\.log(\.[0-9]+)?$", "log_file", 0.9), (r"(^|/)docs?/.*\.(png|jpe?g|gif|svg|ico|pdf|webp)$", "documentation_asset", 0.9),
    (r"\.(exe|dll|so|dylib|o|a|class|jar|pyc|png|jpe?g|gif|ico|pdf|zip|gz|tar|woff2?|ttf|mp[34])$", "binary_extension", 0.95),
]
TEMPORARY = r"\.(tmp|temp|bak|swp|orig)$|~$"
SOURCE = r"\.(py|js|jsx|ts|tsx|java|go|rs|c|cc|cpp|h|hpp)$"
CRITICAL = r"^(readme(\.\w+)?|license|makefile|dockerfile|package\.json|pyproject\.toml|requirements\.txt|cargo\.toml|go\.mod)$"
MOST = 50_000

_DECISION_SQL = f"""WITH f AS ({FILES_SQL}), c AS (SELECT file_id, arg_min(row_id, struct_pack(a := start_line, b := row_id)) AS row_id, bool_or(contains(coalesce(content, ''), chr(0))) AS nul FROM chunks GROUP BY 1),
g AS ({{b8}}), x AS (SELECT f.file_id, size, lower(path) AS low, {NAME_SQL} AS name, nul, coalesce(g.score, 0) AS made FROM f JOIN c USING (file_id) LEFT JOIN g ON g.row_id = c.row_id)
SELECT file_id, r.include, r.reason, r.confidence FROM (SELECT file_id, CASE """
_DECISION_SQL += " ".join(f"WHEN regexp_matches(low, '{p}') THEN {{{{'include': false, 'reason': '{r}', 'confidence': {c}::DOUBLE}}}}" for p, r, c in PATH_RULES[:6])
_DECISION_SQL += f""" WHEN size = 0 THEN {{{{'include': false, 'reason': 'temporary_file', 'confidence': 0.8::DOUBLE}}}} WHEN regexp_matches(name, '{CRITICAL}') AND size <= {5 * MOST} THEN {{{{'include': true, 'reason': 'included', 'confidence': 1.0::DOUBLE}}}} """
_DECISION_SQL += " ".join(f"WHEN regexp_matches(low, '{p}') THEN {{{{'include': false, 'reason': '{r}', 'confidence': {c}::DOUBLE}}}}" for p, r, c in PATH_RULES[6:])
_DECISION_SQL += f""" WHEN size > {MOST} AND regexp_matches(low, '{SOURCE}') THEN {{{{'include': false, 'reason': 'too_large', 'confidence': 0.7::DOUBLE}}}} WHEN size > {MOST} THEN {{{{'include': false, 'reason': 'too_large', 'confidence': 0.9::DOUBLE}}}}
 WHEN regexp_matches(low, '{paths.GENERATED_NAME}') THEN {{{{'include': false, 'reason': 'generated_file', 'confidence': 0.8::DOUBLE}}}} WHEN regexp_matches(low, '{TEMPORARY}') THEN {{{{'include': false, 'reason': 'temporary_file', 'confidence': 0.9::DOUBLE}}}}
 WHEN nul THEN {{{{'include': false, 'reason': 'binary_content', 'confidence': 0.85::DOUBLE}}}} WHEN made > 0.7 THEN {{{{'include': false, 'reason': 'generated_file', 'confidence': made::DOUBLE}}}}
 WHEN regexp_matches(low, '{SOURCE}') THEN {{{{'include': true, 'reason': 'included', 'confidence': 0.9::DOUBLE}}}} ELSE {{{{'include': true, 'reason': 'included', 'confidence': 0.6::DOUBLE}}}} END AS r FROM x)"""


@query(_DECISION_SQL.replace("{{", "{").replace("}}", "}").replace("{b8}", ORACLE_SQL["b8_generated_score"]))
def b6_filter_decision(spark, d):
    """(file_id, include, reason, confidence): the first of the path, size and content rules that holds. Content is judged on the file's first chunk, NUL on all."""
    c = table(spark, d, "chunks").groupBy("file_id").agg(
        F.min_by(F.coalesce("content", F.lit("")), F.struct("start_line", "row_id")).alias("first"), F.min_by(F.col("content").isNull(), F.struct("start_line", "row_id")).alias("blank"),
        F.bool_or(F.locate("\x00", F.coalesce("content", F.lit(""))) > 0).alias("nul"),
    )
    x = files(spark, d).join(c, "file_id").withColumn("low", F.lower("path")).withColumn("made", F.when(F.col("blank"), 0.0).otherwise(F.round(text.generated_score(F.col("first")), 6)))
    low, size, made = F.col("low"), F.col("size"), F.col("made")
    name = paths.file_name(F.col("path"))
    by_path = [(low.rlike(p), False, r, F.lit(c)) for p, r, c in PATH_RULES]
    rules = [
        *by_path[:6], (size == 0, False, "temporary_file", F.lit(0.8)), (name.rlike(CRITICAL) & (size <= 5 * MOST), True, "included", F.lit(1.0)), *by_path[6:],
        ((size > MOST) & low.rlike(SOURCE), False, "too_large", F.lit(0.7)), (size > MOST, False, "too_large", F.lit(0.9)), (low.rlike(paths.GENERATED_NAME), False, "generated_file", F.lit(0.8)),
        (low.rlike(TEMPORARY), False, "temporary_file", F.lit(0.9)), (F.col("nul"), False, "binary_content", F.lit(0.85)), (made > 0.7, False, "generated_file", made),
        (low.rlike(SOURCE), True, "included", F.lit(0.9)), (F.lit(True), True, "included", F.lit(0.6)),
    ]
    decision = F.coalesce(*[F.when(c, F.struct(F.lit(i).alias("include"), F.lit(r).alias("reason"), k.cast("double").alias("confidence"))) for c, i, r, k in rules])
    return x.select("file_id", decision.alias("r")).select("file_id", "r.include", "r.reason", "r.confidence")


def _any_sql(column: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")"


@query(f"""SELECT row_id, regexp_matches(content, '{text.ENTRYPOINT}') AS entrypoint, {_any_sql('lower(content)', text.EXAMPLE_MARKERS)} OR regexp_matches(lower(coalesce(rel_path, '')), '{paths.EXAMPLE_PATH}') AS examples,
 regexp_matches(lower(coalesce(rel_path, '')), 'test|spec') AND ({_any_sql('lower(rel_path)', text.INTEGRATION)} OR {_any_sql('lower(content)', text.INTEGRATION)}) AS integration_test FROM chunks WHERE content IS NOT NULL""")
def b11_entrypoints(spark, d):
    """Entry points by all patterns, and the flags of examples and integration tests (B12) by path and content."""
    low, path = F.lower("content"), F.lower(F.coalesce("rel_path", F.lit("")))
    example = text.any_of(low, text.EXAMPLE_MARKERS) | path.rlike(paths.EXAMPLE_PATH)
    integration = path.rlike("test|spec") & (text.any_of(path, text.INTEGRATION) | text.any_of(low, text.INTEGRATION))
    return table(spark, d, "chunks").filter("content is not null").select("row_id", F.col("content").rlike(text.ENTRYPOINT).alias("entrypoint"), example.alias("examples"), integration.alias("integration_test"))


# Manifest and entry names, must-include pattern and factors of a chunk's priority.
MANIFEST, ENTRY, MUST = r"package\.json|requirements\.txt|go\.mod|cargo\.toml|pyproject\.toml", r"main\.|index\.|__init__|app\.", r"(^|/)core/"
KIND_FACTOR = {"main": 3.0, "class": 2.0, "function": 1.5, "import": 0.5, "test": 0.8, "docstring": 1.2}
PRIORITY_SQL = (
    "round(CAST(CASE lower(kind) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in KIND_FACTOR.items()) + " ELSE 1.0 END"
    f" * CASE WHEN regexp_matches(lower(coalesce(rel_path, '')), '{MANIFEST}') THEN 2.0 WHEN regexp_matches(lower(coalesce(rel_path, '')), '{ENTRY}') THEN 1.5 ELSE 1 END"
    f" * CASE WHEN regexp_matches(lower(coalesce(rel_path, '')), '{MUST}') THEN 5.0 ELSE 1 END * (1 + 0.5 * coalesce(doc_density, 0)) * CASE WHEN complexity_score > 5 THEN 1 - least(0.5, (complexity_score - 5) / 10) ELSE 1 END AS DOUBLE), 6)"
)


def priority():
    """A chunk's priority: factors of its kind, path, must-include pattern, documentation and complexity."""
    path, cx = F.lower(F.coalesce("rel_path", F.lit(""))), F.col("complexity_score")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_FACTOR.items() for x in kv]), F.lower("kind")), F.lit(1.0))
    place = F.when(path.rlike(MANIFEST), 2.0).when(path.rlike(ENTRY), 1.5).otherwise(1.0) * F.when(path.rlike(MUST), 5.0).otherwise(1.0)
    return F.round(kind * place * (1 + 0.5 * F.coalesce("doc_density", F.lit(0.0))) * F.when(cx > 5, 1 - F.least(F.lit(0.5), (cx - 5) / 10)).otherwise(1.0), 6)


@query(f"SELECT row_id, {PRIORITY_SQL} AS priority FROM chunks")
def h13_chunk_priority(spark, d):
    return table(spark, d, "chunks").select("row_id", priority().alias("priority"))


@query(f"""SELECT row_id, substr(sha256(concat_ws('|', rel_path, CAST(start_line AS VARCHAR), CAST(end_line AS VARCHAR), kind, substr(content, 1, 100))), 1, 8) AS det_id, {PRIORITY_SQL} AS priority
FROM chunks c, (SELECT min_doc_density, max_complexity FROM baseline_configs WHERE config_id = 16) b WHERE coalesce(doc_density, 0) >= min_doc_density AND coalesce(complexity_score, 0) <= max_complexity""")
def b14_preprocessed(spark, d):
    """The chunks that one configuration lets through, with deterministic id and priority."""
    b = F.broadcast(table(spark, d, "baseline_configs").filter("config_id = 16").select("min_doc_density", "max_complexity"))
    kept = table(spark, d, "chunks").join(b, (F.coalesce("doc_density", F.lit(0.0)) >= F.col("min_doc_density")) & (F.coalesce("complexity_score", F.lit(0.0)) <= F.col("max_complexity")))
    return kept.select("row_id", text.deterministic_id(*[F.col(c) for c in ("rel_path", "start_line", "end_line", "kind", "content")]).alias("det_id"), priority().alias("priority"))


@query("""WITH q AS (SELECT item_id, regexp_matches(lower(question), 'rollback|migration') AS focused, CAST('0x' || substr(md5(CAST(item_id AS VARCHAR)), 1, 1) AS INT) % 2 = 0 AS half, gold.confidence_score AS c FROM qa_items WHERE question IS NOT NULL),
r AS (SELECT avg(CASE WHEN focused THEN 1.0 ELSE 0 END) AS share FROM q)
SELECT CASE WHEN CASE WHEN least(share, 1 - share) < 0.1 THEN half ELSE focused END THEN 'focused' ELSE 'full' END AS slice, count(*) AS n, round(avg(c), 6) AS confidence, bool_or(least(share, 1 - share) < 0.1) AS fallback FROM q, r GROUP BY 1""")
def b18_slices_fallback(spark, d):
    """Focused and full questions by keyword; where a slice has under a tenth of the rows, halves by hash instead."""
    q = table(spark, d, "qa_items").filter("question is not null").select(
        F.lower("question").rlike("rollback|migration").alias("focused"), (F.conv(F.substring(F.md5(F.col("item_id").cast("string")), 1, 1), 16, 10).cast("int") % 2 == 0).alias("half"), F.col("gold.confidence_score").alias("c")
    )
    few = F.least(F.col("share"), 1 - F.col("share")) < 0.1
    s = q.crossJoin(q.agg(F.avg(F.col("focused").cast("double")).alias("share")))
    name = F.when(F.when(few, F.col("half")).otherwise(F.col("focused")), "focused").otherwise("full")
    return s.groupBy(name.alias("slice")).agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("confidence"), F.bool_or(few).alias("fallback"))


# Bonuses of a repository's quality.
QUALITY = [
    (r"(^|/)readme(\.\w+)?$", 0.1), (r"(^|/)(docs|documentation)/", 0.1), (r"(^|/)(tests?|spec|__tests__)/|(^|/)test_[^/]*\.py$|_test\.py$|\.(test|spec)\.js$", 0.15),
    (r"(^|/)(\.github/workflows/|\.gitlab-ci\.yml$|\.travis\.yml$|jenkinsfile$)", 0.1), (r"(^|/)(requirements\.txt|setup\.py|pyproject\.toml|package\.json|go\.mod|cargo\.toml|pom\.xml|build\.gradle)$", 0.1),
]
MATURE = [r"(^|/)\.gitignore$", r"(^|/)\.editorconfig$", r"(^|/)license$", r"(^|/)changelog\.md$"]


@query(f"""WITH f AS (SELECT repo_name, lower(path) AS p FROM git_files) SELECT repo_name, round(least(1.0, 0.5 + {" + ".join(f"CASE WHEN bool_or(regexp_matches(p, '{r}')) THEN {v} ELSE 0 END" for r, v in QUALITY)}
 + least(0.05, 0.025 * ({" + ".join(f"CASE WHEN bool_or(regexp_matches(p, '{r}')) THEN 1 ELSE 0 END" for r in MATURE)})))::DOUBLE, 6) AS quality FROM f GROUP BY 1""")
def b24_quality(spark, d):
    """The quality of a repository: one half and bonuses for documentation, tests, pipelines, packaging and a mature set-up, at most 1."""
    has = lambda r: F.bool_or(F.lower("path").rlike(r))
    mature = sum((F.when(has(r), 1).otherwise(0) for r in MATURE), F.lit(0))
    score = F.lit(0.5) + _sum((has(r), v) for r, v in QUALITY) + F.least(F.lit(0.05), 0.025 * mature)
    return table(spark, d, "git_files").groupBy("repo_name").agg(F.round(F.least(F.lit(1.0), score), 6).alias("quality"))


# ---- signatures, terms, answers, trees

_LINES = "string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10))"
SIGNATURES = {"by_regex": (r"^\s*(?:(?:async\s+)?def|class)\s+\w+|^(?:export\s+)?(?:async\s+)?function\s+\w+|^func\s+|^(?:pub\s+)?fn\s+\w+", 10), "by_prefix": (r"^\s*(def |class |function |func |fn |pub fn |public |private |protected )", 50), "by_brace": (r"^[A-Za-z].*[({]\s*$", 50)}


@query("SELECT row_id, " + ", ".join(f"array_to_string(list_filter({_LINES}, lambda x: regexp_matches(x, '{p}'))[1:{n}], chr(10)) AS {k}" for k, (p, n) in SIGNATURES.items()) + " FROM chunks WHERE content IS NOT NULL")
def h3_signature_variants(spark, d):
    """Signature lines by declaration pattern (at most ten), by line prefix and by opening bracket (at most fifty each)."""
    ls = text.lines(F.col("content"))
    one = lambda p, n: F.array_join(F.slice(F.filter(ls, lambda x: x.rlike(p)), 1, n), "\n")
    return table(spark, d, "chunks").filter("content is not null").select("row_id", *[one(p, n).alias(k) for k, (p, n) in SIGNATURES.items()])


@query("""WITH t AS (SELECT row_id, list_concat(list_concat(flatten(list_transform(regexp_extract_all(lower(content), '[a-z_][a-z0-9_]*'), lambda x: list_filter(string_split(x, '_'), lambda y: length(y) >= 2))),
 flatten(list_transform(regexp_extract_all(lower(content), '(?m)(?:#|//)([^\\n]*)', 1), lambda x: list_filter(string_split_regex(x, '[^a-z0-9]+'), lambda y: length(y) >= 2)))),
 flatten(list_transform(regexp_extract_all(lower(content), '"([^"\\n]*)"', 1), lambda x: list_filter(string_split_regex(x, '[^a-z0-9]+'), lambda y: length(y) >= 2)))) AS terms FROM chunks WHERE content IS NOT NULL)
SELECT row_id, len(terms) AS terms, len(list_distinct(terms)) AS distinct_terms, md5(array_to_string(list_sort(terms), ' ')) AS digest FROM t""")
def h17_code_tokens(spark, d):
    """Terms of a chunk: parts of identifiers, and once more the words of comments and of strings."""
    low = F.lower("content")
    words = lambda x, sep: F.filter(F.split(x, sep), lambda y: F.length(y) >= 2)
    several = lambda p, group, sep: F.flatten(F.transform(F.regexp_extract_all(low, F.lit(p), F.lit(group)), lambda x: words(x, sep)))
    terms = F.concat(several("[a-z_][a-z0-9_]*", 0, "_"), several(r"(?m)(?:#|//)([^\n]*)", 1, "[^a-z0-9]+"), several(r'"([^"\n]*)"', 1, "[^a-z0-9]+"))
    t = table(spark, d, "chunks").filter("content is not null").select("row_id", terms.alias("t"))
    return t.select("row_id", F.size("t").cast("long").alias("terms"), F.size(F.array_distinct("t")).cast("long").alias("distinct_terms"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


@query("""SELECT item_id, round(CASE WHEN len(gold.key_concepts) > 0 THEN len(list_filter(gold.key_concepts, lambda c: contains(lower(gold.answer_text), lower(c)))) / len(gold.key_concepts) ELSE 0 END, 6)::DOUBLE AS exact,
 round((CASE WHEN regexp_matches(gold.answer_text, '[0-9]+') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(gold.answer_text, '[a-z]+_[a-z]+') THEN 1 ELSE 0 END + CASE WHEN coalesce(regexp_matches(gold.answer_text, gold.regex_pattern), false) THEN 1 ELSE 0 END) / 3.0, 6)::DOUBLE AS by_regex FROM qa_items WHERE gold.answer_text IS NOT NULL""")
def h27_scorers(spark, d):
    """Share of the expected strings that an answer holds, and share of three patterns (figures, identifiers, the item's own) that it matches."""
    a = F.col("gold.answer_text")
    exact = F.when(F.size("gold.key_concepts") > 0, F.size(F.filter("gold.key_concepts", lambda c: F.contains(F.lower(a), F.lower(c)))) / F.size("gold.key_concepts")).otherwise(0.0)
    by = _sum([(a.rlike("[0-9]+"), 1.0), (a.rlike("[a-z]+_[a-z]+"), 1.0), (F.regexp_like(a, F.col("gold.regex_pattern")), 1.0)]) / 3.0
    return table(spark, d, "qa_items").filter("gold.answer_text is not null").select("item_id", F.round(exact, 6).alias("exact"), F.round(by, 6).alias("by_regex"))


@query(f"""WITH f AS ({FILES_SQL}), p AS (SELECT repo_name, string_split(path, '/') AS parts FROM f), n AS (SELECT repo_name, parts, unnest(range(1, len(parts) + 1)) AS k FROM p)
SELECT DISTINCT repo_name, array_to_string(parts[1:k], '/') AS node, repeat('  ', CAST(k - 1 AS INT)) || parts[k] || CASE WHEN k < len(parts) THEN '/' ELSE '' END AS line FROM n""")
def h31_tree(spark, d):
    """The directory tree of each repository, one indented line per node; sorted by node the lines are the tree."""
    p = files(spark, d).select("repo_name", F.split("path", "/").alias("parts"))
    n = p.select("repo_name", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("k"))
    line = F.concat(F.expr("repeat('  ', k - 1)"), F.element_at("parts", F.col("k")), F.when(F.col("k") < F.size("parts"), "/").otherwise(""))
    return n.select("repo_name", F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/").alias("node"), line.alias("line")).distinct()


# ---- file scores

# Extensions of templates, paired delimiters and single marks in the first 2 KiB, name and path rules.
TEMPLATE_EXT = r"\.(njk|nunjucks|hbs|handlebars|j2|jinja2?|twig|liquid|mustache|ejs|erb|rhtml|haml|pug|jade|dust|eta|svelte|vue|tsx|jsx)$"
DELIMITERS = [("{{", "}}"), ("{%", "%}"), ("<%", "%>"), ("<#", "#>"), ("${", "}"), ("@{", "}"), ("[[", "]]")]
MARKS = ["ng-", "v-", "data-bind", "handlebars", "jinja"]
PATH_BOOSTS = [(r"^[^/]+$", 2.0), (r"(^|/)(docs?|documentation)/", 1.5), (r"^[^/]+/[^/]+$", 1.2), (r"(^|/)(guides?|tutorials?|examples)/", 1.3), (r"(^|/)(api|reference|manual)/", 1.1)]

_DOC_SQL = f"""f AS ({FILES_SQL}), c AS (SELECT file_id, arg_min(substr(coalesce(content, ''), 1, 2048), struct_pack(a := start_line, b := row_id)) AS top, CAST(sum(len(list_filter(string_split(coalesce(content, ''), chr(10)), lambda x: regexp_matches(x, '^#{{1,6}} ')))) AS BIGINT) AS headings,
 CAST(sum(len(regexp_extract_all(coalesce(content, ''), '\\[[^\\]]+\\]\\([^)]+\\)'))) AS BIGINT) AS links, CAST(sum(len(regexp_extract_all(coalesce(content, ''), '```')) // 2) AS BIGINT) AS blocks, CAST(sum(len(regexp_extract_all(lower(coalesce(content, '')), 'table of contents|## contents'))) AS BIGINT) AS toc,
 CAST(sum(len(string_split(coalesce(content, ''), chr(10)))) AS BIGINT) AS n_lines FROM chunks GROUP BY 1)"""


def documents_of_files(spark, d):
    """Files with the first 2 KiB of their text and the counts of headings, links, code blocks and contents lists in all of it."""
    t = F.coalesce("content", F.lit(""))
    ls = F.split(t, "\n")
    c = table(spark, d, "chunks").groupBy("file_id").agg(
        F.min_by(F.substring(t, 1, 2048), F.struct("start_line", "row_id")).alias("top"), F.sum(F.size(F.filter(ls, lambda x: x.rlike("^#{1,6} ")))).alias("headings"),
        F.sum(F.regexp_count(t, F.lit(r"\[[^\]]+\]\([^)]+\)"))).alias("links"), F.sum(F.floor(F.regexp_count(t, F.lit("```")) / 2)).alias("blocks"), F.sum(F.regexp_count(F.lower(t), F.lit("table of contents|## contents"))).alias("toc"), F.sum(F.size(ls)).alias("n_lines"),
    )
    return files(spark, d).join(c, "file_id")


_PAIRS_SQL = " OR ".join(f"(contains(top, '{a}') AND contains(top, '{b}'))" for a, b in DELIMITERS)
TEMPLATE_SQL = f"CASE WHEN regexp_matches(lower(path), '{TEMPLATE_EXT}') THEN 1.5 WHEN regexp_matches(lower(path), '\\.(html?|xml)$') AND ({_PAIRS_SQL} OR {_any_sql('lower(top)', MARKS)}) THEN 1.2 ELSE 0 END"


def template_boost():
    paired = F.lit(False)
    for a, b in DELIMITERS:
        paired = paired | (F.contains("top", F.lit(a)) & F.contains("top", F.lit(b)))
    p = F.lower("path")
    return F.when(p.rlike(TEMPLATE_EXT), 1.5).when(p.rlike(r"\.(html?|xml)$") & (paired | text.any_of(F.lower("top"), MARKS)), 1.2).otherwise(0.0)


@query(f"WITH {_DOC_SQL} SELECT file_id, {TEMPLATE_SQL}::DOUBLE AS boost, ({_PAIRS_SQL}) AS delimiters FROM f JOIN c USING (file_id)")
def h12_template(spark, d):
    """The boost of templates by extension, or by delimiters and marks in the first 2 KiB of markup; and whether there are paired delimiters at all."""
    paired = F.lit(False)
    for a, b in DELIMITERS:
        paired = paired | (F.contains("top", F.lit(a)) & F.contains("top", F.lit(b)))
    return documents_of_files(spark, d).select("file_id", template_boost().alias("boost"), paired.alias("delimiters"))


README, DOCS = r"readme|architecture|design", r"(^|/)(doc|docs|documentation|manual|guide|tutorial)/|\.(md|rst|txt)$"
DOC_SCORE_SQL = f"""least(4.0, CASE WHEN regexp_matches(lower(path), '{DOCS}') THEN 1.0 ELSE 0 END + CASE WHEN regexp_matches({NAME_SQL}, '{README}') THEN 2.0 ELSE 0 END + {TEMPLATE_SQL} + CASE WHEN regexp_matches(lower(path), 'layout|template|_includes|component') THEN 0.5 ELSE 0 END
 + least(headings / 10.0, 0.5) + CASE WHEN toc > 0 THEN 0.3 ELSE 0 END + least(links / 20.0, 0.3) + least(blocks / 10.0, 0.2))"""


def doc_score():
    """Capped sum of the rules on documentation: kind of file, template, layout and structure."""
    p, cap = F.lower("path"), lambda c, n, most: F.least(F.col(c) / n, F.lit(most))
    rules = _sum([(p.rlike(DOCS), 1.0), (paths.file_name(F.col("path")).rlike(README), 2.0), (p.rlike("layout|template|_includes|component"), 0.5), (F.col("toc") > 0, 0.3)])
    return F.least(F.lit(4.0), rules + template_boost() + cap("headings", 10.0, 0.5) + cap("links", 20.0, 0.3) + cap("blocks", 10.0, 0.2))


BOOST_SQL = f"""(CASE WHEN regexp_matches({NAME_SQL}, '{README}') THEN 2.0 ELSE 0 END + CASE WHEN regexp_matches(lower(path), '{DOCS}') THEN 1.0 ELSE 0 END + CASE WHEN 100.0 * headings / greatest(n_lines, 1) > 2 THEN 0.5 ELSE 0 END
 + CASE WHEN regexp_matches({NAME_SQL}, '{paths.CONFIG_NAME}') THEN 0.3 ELSE 0 END + CASE WHEN len(string_split(path, '/')) <= 2 THEN 0.2 ELSE 0 END)"""


def priority_boost():
    name = paths.file_name(F.col("path"))
    return _sum([(name.rlike(README), 2.0), (F.lower("path").rlike(DOCS), 1.0), (100.0 * F.col("headings") / F.greatest("n_lines", F.lit(1)) > 2, 0.5), (name.rlike(paths.CONFIG_NAME), 0.3), (paths.depth(F.col("path")) <= 2, 0.2)])


@query(f"WITH {_DOC_SQL} SELECT file_id, round({BOOST_SQL}::DOUBLE, 6) AS boost FROM f JOIN c USING (file_id)")
def h9_priority_boost(spark, d):
    return documents_of_files(spark, d).select("file_id", F.round(priority_boost(), 6).alias("boost"))


TEST = paths.TEST_NAME
_STEM = "regexp_replace(regexp_extract(lower(path), '([^/]*?)(\\.[^/.]*)?$', 1), '^test_|_test$|\\.test$|\\.spec$', '')"
_HEURISTIC_SQL = f"""WITH {EDGES_SQL}, {_DOC_SQL}, ch AS ({ORACLE_SQL["h8_churn"]}), i AS (SELECT dst AS file_id, count(*) AS n FROM e0 GROUP BY 1), o AS (SELECT src AS file_id, count(*) AS n FROM e0 GROUP BY 1),
s AS (SELECT file_id, regexp_matches({NAME_SQL}, '{TEST}') AS is_test, {_STEM} AS stem FROM f), ts AS (SELECT stem, count(*) AS tests FROM s WHERE is_test GROUP BY 1), t AS (SELECT count(*) AS total FROM f),
x AS (SELECT f.file_id, {DOC_SCORE_SQL} AS doc, CASE WHEN regexp_matches({NAME_SQL}, '{README}') THEN 3.0 + CASE WHEN len(string_split(path, '/')) <= 2 THEN 1.0 ELSE 0 END + CASE WHEN regexp_matches(lower(path), 'architecture|design|adr') THEN 0.5 ELSE 0 END ELSE 0 END AS readme,
 (2 * coalesce(i.n, 0) + coalesce(o.n, 0)) * 1.0 / total AS degree, CASE WHEN len(string_split(path, '/')) <= 1 THEN 1.0 WHEN len(string_split(path, '/')) <= 2 THEN 0.8 WHEN len(string_split(path, '/')) <= 3 THEN 0.6 ELSE 2.0 / len(string_split(path, '/')) END AS path_score,
 CASE WHEN is_test THEN 0.3 ELSE least(1.0, 0.2 * coalesce(tests, 0)) END AS test_link, coalesce(churn, 0.1) AS churn, {BOOST_SQL} AS boost
 FROM f JOIN c USING (file_id) JOIN s USING (file_id) LEFT JOIN ts ON ts.stem = s.stem LEFT JOIN i ON i.file_id = f.file_id LEFT JOIN o ON o.file_id = f.file_id LEFT JOIN ch ON ch.file_id = f.file_id, t)"""


def heuristics(spark, d):
    """Every component of a file's heuristic score; no pair of files is looked at: tests meet code by stem."""
    f = documents_of_files(spark, d)
    n, e = _graph(spark, d)
    name, p, dp = paths.file_name(F.col("path")), F.lower("path"), paths.depth(F.col("path"))
    stem = F.regexp_replace(F.regexp_extract(p, r"([^/]*?)(\.[^/.]*)?$", 1), r"^test_|_test$|\.test$|\.spec$", "")
    f = f.withColumn("is_test", name.rlike(TEST)).withColumn("stem", stem)
    tests = f.filter("is_test").groupBy("stem").agg(F.count("*").alias("tests"))
    i, o = e.groupBy(F.col("dst").alias("file_id")).agg(F.count("*").alias("i")), e.groupBy(F.col("src").alias("file_id")).agg(F.count("*").alias("o"))
    j = f.join(tests, "stem", "left").join(i, "file_id", "left").join(o, "file_id", "left").join(h8_churn(spark, d), "file_id", "left").crossJoin(f.agg(F.count("*").alias("total")))
    readme = F.when(name.rlike(README), 3.0 + _sum([(dp <= 2, 1.0), (p.rlike("architecture|design|adr"), 0.5)])).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.select(
        "file_id", "path", "tokens", "repo_name", doc_score().alias("doc"), readme.alias("readme"), ((2 * zero("i") + zero("o")) / F.col("total")).alias("degree"), paths.path_score(dp).alias("path_score"),
        F.when(F.col("is_test"), 0.3).otherwise(F.least(F.lit(1.0), 0.2 * zero("tests"))).alias("test_link"), F.coalesce("churn", F.lit(0.1)).alias("churn"), priority_boost().alias("boost"),
    )


TOTAL_SQL = "0.3 * doc + 0.25 * readme + 0.15 * degree + 0.1 * path_score + 0.1 * test_link + 0.1 * churn + boost"


def total():
    """The weighted sum of the components and the boost."""
    c = F.col
    return 0.3 * c("doc") + 0.25 * c("readme") + 0.15 * c("degree") + 0.1 * c("path_score") + 0.1 * c("test_link") + 0.1 * c("churn") + c("boost")


@query(_HEURISTIC_SQL + f" SELECT file_id, round(({TOTAL_SQL})::DOUBLE, 6) AS score FROM x")
def h10_heuristic_score(spark, d):
    return heuristics(spark, d).select("file_id", F.round(total(), 6).alias("score"))


@query(_HEURISTIC_SQL + " SELECT file_id, round(doc::DOUBLE, 6) AS doc, round(readme::DOUBLE, 6) AS readme, round(path_score::DOUBLE, 6) AS path_score, round(test_link::DOUBLE, 6) AS test_link FROM x")
def h11_part_scores(spark, d):
    return heuristics(spark, d).select("file_id", *[F.round(c, 6).alias(c) for c in ("doc", "readme", "path_score", "test_link")])


@query(_HEURISTIC_SQL + f""", h AS (SELECT file_id, {TOTAL_SQL} AS h FROM x), pr AS ({_rank_sql("SELECT src, dst FROM e0")})
SELECT h.file_id, round((0.85 * h + 0.15 * rank * (SELECT max(h) FROM h) / (SELECT max(rank) FROM pr))::DOUBLE, 5) AS score FROM h JOIN pr ON pr.node = h.file_id""")
def j9_centrality_blend(spark, d):
    """Heuristic score and PageRank blended: (1 - w) h + w r max(h) / max(r), w = .15."""
    h = heuristics(spark, d).select("file_id", total().alias("h"))
    n, e = _graph(spark, d)
    r = graph.pagerank(n, e).select(F.col("node").alias("file_id"), F.round("rank", 9).alias("rank"))
    top = h.agg(F.max("h").alias("mh")).crossJoin(r.agg(F.max("rank").alias("mr")))
    return h.join(r, "file_id").crossJoin(top).select("file_id", F.round(graph.blend(F.col("h"), F.col("rank") * F.col("mh") / F.col("mr")), 5).alias("score"))


@query(f"""WITH m AS (SELECT row_id, repo_name, file_id, lower(coalesce(kind, 'none')) AS kind, {TOK} AS t, coalesce(centrality_score, 0) AS rel, coalesce(doc_density, 0) AS qual FROM chunks),
f AS (SELECT file_id, count(*) AS n FROM m GROUP BY 1), k AS (SELECT repo_name, kind, count(*) AS n FROM m GROUP BY 1, 2), r AS (SELECT repo_name, count(*) AS n FROM m GROUP BY 1),
u AS (SELECT row_id, 0.7 / f.n + 0.3 * (1 - k.n * 1.0 / r.n) + 0.3 * rel + 0.2 * qual AS u, t FROM m JOIN f USING (file_id) JOIN k ON k.repo_name = m.repo_name AND k.kind = m.kind JOIN r ON r.repo_name = m.repo_name)
SELECT row_id, 'full' AS mode, round(u::DOUBLE / greatest(t, 1), 9) AS utility FROM u UNION ALL SELECT row_id, 'signature', round(0.6 * u::DOUBLE / greatest(t // 10, 1), 9) FROM u""")
def h14_utility_per_cost(spark, d):
    """Utility per token of each chunk in both modes: coverage (its share of its file), diversity (how rare its kind is), relevance and quality."""
    m = table(spark, d, "chunks").select("row_id", "repo_name", "file_id", F.lower(F.coalesce("kind", F.lit("none"))).alias("kind"), text.chunk_tokens().alias("t"), F.coalesce("centrality_score", F.lit(0.0)).alias("rel"), F.coalesce("doc_density", F.lit(0.0)).alias("qual"))
    f, k, r = m.groupBy("file_id").agg(F.count("*").alias("nf")), m.groupBy("repo_name", "kind").agg(F.count("*").alias("nk")), m.groupBy("repo_name").agg(F.count("*").alias("nr"))
    u = 0.7 / F.col("nf") + 0.3 * (1 - F.col("nk") / F.col("nr")) + 0.3 * F.col("rel") + 0.2 * F.col("qual")
    j = m.join(f, "file_id").join(k, ["repo_name", "kind"]).join(r, "repo_name").withColumn("u", u)
    modes = F.array(
        F.struct(F.lit("full").alias("mode"), (F.col("u") / F.greatest("t", F.lit(1))).alias("v")), F.struct(F.lit("signature").alias("mode"), (0.6 * F.col("u") / F.greatest(F.floor(F.col("t") / 10), F.lit(1))).alias("v"))
    )
    return j.select("row_id", F.explode(modes).alias("x")).select("row_id", "x.mode", F.round("x.v", 9).alias("utility"))


_TEXT_SQL = f"""WITH {EDGES_SQL}, {_DOC_SQL}, i AS (SELECT dst AS file_id, count(*) AS n FROM e0 GROUP BY 1), o AS (SELECT src AS file_id, count(*) AS n FROM e0 GROUP BY 1), pr AS ({_rank_sql("SELECT src, dst FROM e0")}),
top AS (SELECT file_id FROM i ORDER BY n DESC, file_id LIMIT 10), hub AS (SELECT file_id FROM o ORDER BY n DESC, file_id LIMIT 10),
p AS (SELECT f.file_id, f.path, f.repo_name, f.size, f.lines, greatest(CASE WHEN regexp_matches({NAME_SQL}, '^readme(\\.\\w+)?$') THEN 3.0 WHEN regexp_matches({NAME_SQL}, 'readme|read_me|read-me') THEN 2.8 ELSE 0 END, CASE WHEN regexp_matches({NAME_SQL}, 'architecture|design|adr|decision') THEN 2.2 ELSE 0 END) AS name,
 {" * ".join(f"CASE WHEN regexp_matches(lower(path), '{r}') THEN {v} ELSE 1 END" for r, v in PATH_BOOSTS)} AS place,
 least(2.0, 0.4 * CASE WHEN headings = 0 THEN 0 WHEN headings < 3 THEN headings / 3.0 WHEN headings <= 10 THEN 1 ELSE greatest(0.2, 1 - (headings - 10) * 0.05) END + 0.3 * least(toc * 0.5, 1.0) + 0.2 * CASE WHEN links = 0 THEN 0 WHEN links < 5 THEN links / 5.0 WHEN links <= 20 THEN 1 ELSE greatest(0.3, 1 - (links - 20) * 0.02) END + 0.1 * least(blocks / 5.0, 1.0)) AS structure,
 least(3.0, least(ln(coalesce(i.n, 0) + 1) * 0.5, 2.0) + least(100 * rank, 1.0) + CASE WHEN top.file_id IS NOT NULL THEN 1.0 ELSE 0 END + CASE WHEN hub.file_id IS NOT NULL THEN 0.5 ELSE 0 END) AS link
 FROM f JOIN c USING (file_id) LEFT JOIN i ON i.file_id = f.file_id JOIN pr ON pr.node = f.file_id LEFT JOIN top ON top.file_id = f.file_id LEFT JOIN hub ON hub.file_id = f.file_id),
z AS (SELECT *, (0.4 * name + 0.2 * place + 0.2 * structure + 0.2 * link) * CASE WHEN regexp_matches({NAME_SQL}, '{README}') THEN 1.5 ELSE 1 END * CASE WHEN NOT contains(path, '/') THEN 1.2 ELSE 1 END AS pri FROM p)"""


def text_priorities(spark, d):
    """(file_id, repo_name, path, size, lines, priority): name, place, structure and links weighed .4, .2, .2, .2, with factors for READMEs and the root."""
    n, e = _graph(spark, d)
    i, o = e.groupBy(F.col("dst").alias("file_id")).agg(F.count("*").alias("i")), e.groupBy(F.col("src").alias("file_id")).agg(F.count("*").alias("o"))
    ten = lambda df, c, flag: df.orderBy(F.desc(c), "file_id").limit(10).select("file_id", F.lit(True).alias(flag))
    r = graph.pagerank(n, e).select(F.col("node").alias("file_id"), F.round("rank", 9).alias("rank"))
    j = documents_of_files(spark, d).join(i, "file_id", "left").join(r, "file_id").join(ten(i, "i", "top10"), "file_id", "left").join(ten(o, "o", "hub10"), "file_id", "left")
    base, p, h, k = paths.file_name(F.col("path")), F.lower("path"), F.col("headings"), F.col("links")
    name = F.greatest(F.when(base.rlike(r"^readme(\.\w+)?$"), 3.0).when(base.rlike("readme|read_me|read-me"), 2.8).otherwise(0.0), F.when(base.rlike("architecture|design|adr|decision"), 2.2).otherwise(0.0))
    place = F.lit(1.0)
    for rule, v in PATH_BOOSTS:
        place = place * F.when(p.rlike(rule), v).otherwise(1.0)
    head = F.when(h == 0, 0.0).when(h < 3, h / 3.0).when(h <= 10, 1.0).otherwise(F.greatest(F.lit(0.2), 1 - (h - 10) * 0.05))
    refer = F.when(k == 0, 0.0).when(k < 5, k / 5.0).when(k <= 20, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - (k - 20) * 0.02))
    structure = F.least(F.lit(2.0), 0.4 * head + 0.3 * F.least(F.col("toc") * 0.5, F.lit(1.0)) + 0.2 * refer + 0.1 * F.least(F.col("blocks") / 5.0, F.lit(1.0)))
    link = F.least(F.lit(3.0), F.least(F.log(F.coalesce("i", F.lit(0)) + 1) * 0.5, F.lit(2.0)) + F.least(100 * F.col("rank"), F.lit(1.0)) + _sum([(F.col("top10"), 1.0), (F.col("hub10"), 0.5)]))
    pri = (0.4 * name + 0.2 * place + 0.2 * structure + 0.2 * link) * F.when(base.rlike(README), 1.5).otherwise(1.0) * F.when(~F.contains("path", F.lit("/")), 1.2).otherwise(1.0)
    return j.select("file_id", "repo_name", "path", "size", "lines", pri.alias("priority"))


@query(_TEXT_SQL + " SELECT file_id, round(pri::DOUBLE, 5) AS priority, CASE WHEN pri >= 4 THEN 'critical' WHEN pri >= 3 THEN 'high' WHEN pri >= 2 THEN 'medium' WHEN pri >= 1 THEN 'low' ELSE 'minimal' END AS tier FROM z")
def h15_text_priority(spark, d):
    q = F.col("priority")
    tier = F.when(q >= 4, "critical").when(q >= 3, "high").when(q >= 2, "medium").when(q >= 1, "low").otherwise("minimal")
    return text_priorities(spark, d).select("file_id", F.round(q, 5).alias("priority"), tier.alias("tier"))


# Names by importance.
NAMES = [(r"^(main|index|app|server|client|core|base|utils|common)$", 1.0), (r"config|setup|init|manager|handler|service", 0.7), (r"test|spec|mock|temp|cache", 0.3), (r"backup|old|deprecated|legacy", 0.1)]
KINDS = [(SOURCE, 1.0), (r"\.(json|ya?ml|toml|ini|cfg)$", 0.8), (r"\.(md|rst|txt)$", 0.6), (r"\.(csv|xml|sql)$", 0.4)]
SIZES = [(10, 0.2), (50, 0.8), (200, 1.0), (500, 0.7), (1000, 0.4)]


@query(f"""WITH {EDGES_SQL}, f AS ({FILES_SQL}), i AS (SELECT dst AS file_id, count(*) AS n FROM e0 GROUP BY 1), x AS (SELECT file_id, regexp_extract(lower(path), '([^/]*?)(\\.[^/.]*)?$', 1) AS stem, lower(path) AS low, lines FROM f)
SELECT x.file_id, round((0.3 * CASE {" ".join(f"WHEN regexp_matches(stem, '{r}') THEN {v}" for r, v in NAMES)} ELSE 0.5 END + 0.2 * CASE {" ".join(f"WHEN lines < {n} THEN {v}" for n, v in SIZES)} ELSE 0.2 END
 + 0.25 * CASE {" ".join(f"WHEN regexp_matches(low, '{r}') THEN {v}" for r, v in KINDS)} ELSE 0.2 END + 0.25 * least(1.0, coalesce(n, 0) / 10.0))::DOUBLE, 6) AS score FROM x LEFT JOIN i USING (file_id)""")
def h33_file_score(spark, d):
    """Importance by name, size, type and number of dependants."""
    _, e = _graph(spark, d)
    i = e.groupBy(F.col("dst").alias("file_id")).agg(F.count("*").alias("n"))
    stem, low = F.regexp_extract(F.lower("path"), r"([^/]*?)(\.[^/.]*)?$", 1), F.lower("path")
    pick = lambda pairs, rest: F.coalesce(*[F.when(c, F.lit(v)) for c, v in pairs], F.lit(rest))
    score = (
        0.3 * pick([(stem.rlike(r), v) for r, v in NAMES], 0.5) + 0.2 * pick([(F.col("lines") < n, v) for n, v in SIZES], 0.2) + 0.25 * pick([(low.rlike(r), v) for r, v in KINDS], 0.2)
        + 0.25 * F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / 10.0)
    )
    return files(spark, d).join(i, "file_id", "left").select("file_id", F.round(score, 6).alias("score"))
