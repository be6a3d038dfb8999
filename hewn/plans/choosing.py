"""Queries that look at a pack's own selection: gaps, inclusion rules, patches, and checks of whole packs (survey groups B21, C8-C10, D8, D26-D28, G2, I7, O1, O3, O4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hewn.functions import paths, text
from hewn.operators import budget
from hewn.operators.prefix import position, prefix_sum
from hewn.plans.analysis import EDGES_SQL
from hewn.plans.registry import query
from hewn.plans.relational import c4_dependency_edges
from hewn.plans.scan import FILES_SQL, files
from hewn.sources.tables import table

TOK = text.CHUNK_TOKENS_SQL

#: (run_id, file_id) of the files that a run selects, from the keys of its ``chunk_modes``.
SELECTED_SQL = """selected AS (SELECT DISTINCT run_id, file_id FROM (SELECT run_id, unnest(map_keys(chunk_modes)) AS id FROM selection_results) s
 JOIN (SELECT id, min(file_id) AS file_id FROM chunks WHERE id IS NOT NULL GROUP BY 1) c USING (id))"""


def selected_files(spark, d):
    s = table(spark, d, "selection_results").select("run_id", F.explode(F.map_keys("chunk_modes")).alias("id"))
    c = table(spark, d, "chunks").filter("id is not null").groupBy("id").agg(F.min("file_id").alias("file_id"))
    return s.join(c, "id").select("run_id", "file_id").distinct()


@query(f"""WITH {EDGES_SQL}, {SELECTED_SQL}, need AS (SELECT DISTINCT run_id, dst AS file_id FROM selected JOIN e0 ON e0.src = selected.file_id)
SELECT run_id, file_id FROM need EXCEPT SELECT run_id, file_id FROM selected""")
def c8_missing_dependencies(spark, d):
    """Files that a run's selected files depend on and that the run doesn't select."""
    s = selected_files(spark, d)
    need = s.join(c4_dependency_edges(spark, d), F.col("file_id") == F.col("src")).select("run_id", F.col("dst").alias("file_id")).distinct()
    return need.join(s, ["run_id", "file_id"], "left_anti")


FLAG_SQL = """CASE WHEN regexp_matches(lower(path), '(^|/)(main|__main__|app|server|index)\\.py$|(^|/)(main|index|app|server)\\.js$|(^|/)(index|main)\\.ts$|(^|/)main\\.(go|rs)$|(^|/)(lib|mod)\\.rs$') THEN 'entry'
 WHEN regexp_matches(lower(path), '(^|/)(package\\.json|requirements\\.txt|cargo\\.toml|go\\.mod|pyproject\\.toml|setup\\.py|pom\\.xml)$|config|settings') THEN 'config'
 WHEN regexp_matches(lower(path), 'makefile|dockerfile|docker-compose|\\.github|\\.gitlab-ci|jenkins|webpack|rollup|vite\\.config|build') THEN 'build' END"""
CONFIG_FILE = r"(^|/)(package\.json|requirements\.txt|cargo\.toml|go\.mod|pyproject\.toml|setup\.py|pom\.xml)$|config|settings"
BUILD_FILE = r"makefile|dockerfile|docker-compose|\.github|\.gitlab-ci|jenkins|webpack|rollup|vite\.config|build"


def _flag():
    p = F.lower("path")
    return F.when(p.rlike(paths.ENTRY_NAME), "entry").when(p.rlike(CONFIG_FILE), "config").when(p.rlike(BUILD_FILE), "build")


@query(f"""WITH {SELECTED_SQL}, f AS ({FILES_SQL}), flagged AS (SELECT repo_name, file_id, {FLAG_SQL} AS flag FROM f)
SELECT r.run_id, g.file_id, g.flag FROM selection_results r JOIN flagged g USING (repo_name) WHERE flag IS NOT NULL AND NOT EXISTS (SELECT 1 FROM selected s WHERE s.run_id = r.run_id AND s.file_id = g.file_id)""")
def c9_missing_entry(spark, d):
    """Entry points, configuration and build files of a run's repository that the run doesn't select."""
    flagged = files(spark, d).select("repo_name", "file_id", _flag().alias("flag")).filter("flag is not null")
    return table(spark, d, "selection_results").select("run_id", "repo_name").join(flagged, "repo_name").join(selected_files(spark, d), ["run_id", "file_id"], "left_anti").select("run_id", "file_id", "flag")


@query(f"""WITH {EDGES_SQL}, {SELECTED_SQL} SELECT r.run_id, count(DISTINCT c.file_id) AS critical FROM selection_results r JOIN chunks c USING (repo_name)
WHERE EXISTS (SELECT 1 FROM selected s JOIN e0 ON e0.src = s.file_id WHERE s.run_id = r.run_id AND e0.dst = c.file_id) GROUP BY 1""")
def c10_critical_dependencies(spark, d):
    """How many files of a run's repository some selected file depends on."""
    need = selected_files(spark, d).join(c4_dependency_edges(spark, d), F.col("file_id") == F.col("src")).select("run_id", F.col("dst").alias("file_id")).distinct()
    own = table(spark, d, "selection_results").select("run_id", "repo_name").join(table(spark, d, "chunks").select("repo_name", "file_id").distinct(), "repo_name").select("run_id", "file_id")
    return own.join(need, ["run_id", "file_id"], "left_semi").groupBy("run_id").agg(F.count("*").alias("critical"))


STEM_SQL = "regexp_extract(lower(path), '([^/]*?)(\\.[^/.]*)?$', 1)"
STEM = r"([^/]*?)(\.[^/.]*)?$"
TYPES = r"types?\b|schema|interface|\.d\.ts$|model"
_RULES_SQL = f"""WITH {EDGES_SQL}, {SELECTED_SQL}, f AS ({FILES_SQL}), p AS (SELECT *, lower(path) AS low, {STEM_SQL} AS stem, regexp_replace(path, '[^/]*$', '') AS dir FROM f),
x AS (SELECT file_id, bool_or(regexp_matches(coalesce(content, ''), '(?m)^(export|pub|public|def [a-z]|func [A-Z])')) AS exports FROM chunks GROUP BY 1),
u AS (SELECT r.run_id, p.* FROM selection_results r JOIN p USING (repo_name) WHERE NOT EXISTS (SELECT 1 FROM selected s WHERE s.run_id = r.run_id AND s.file_id = p.file_id)),
dep AS (SELECT DISTINCT run_id, dst AS file_id FROM selected JOIN e0 ON e0.src = selected.file_id), mods AS (SELECT DISTINCT run_id, dir FROM selected JOIN p USING (file_id)),
code AS (SELECT DISTINCT run_id, stem FROM selected JOIN p USING (file_id) WHERE NOT regexp_matches(stem, '^test_|_test$')),
t AS (SELECT u.run_id, u.file_id, list_filter([CASE WHEN regexp_matches(low, '(^|/)(main|__main__|app|server|index)\\.py$|(^|/)(main|index|app|server)\\.js$|(^|/)(index|main)\\.ts$|(^|/)main\\.(go|rs)$|(^|/)(lib|mod)\\.rs$') THEN 'entry_point' END,
 CASE WHEN dep.file_id IS NOT NULL THEN 'critical_dependency' END, CASE WHEN regexp_matches(low, '(package\\.json|requirements\\.txt|cargo\\.toml|go\\.mod|pyproject\\.toml|setup\\.py|pom\\.xml)[^/]*$') THEN 'config_required' END,
 CASE WHEN regexp_matches(u.stem, '^test_|_test$') AND code.stem IS NOT NULL THEN 'test_coverage' END, CASE WHEN mods.dir IS NOT NULL AND exports THEN 'api_completeness' END,
 CASE WHEN regexp_matches(low, 'makefile|dockerfile|docker-compose|\\.github|\\.gitlab-ci|jenkins|webpack|rollup|vite\\.config') THEN 'build_system' END,
 CASE WHEN regexp_matches(low, 'readme|architecture|design|(^|/)docs?/|\\.(md|rst)$') THEN 'documentation_core' END, CASE WHEN regexp_matches(low, 'types?\\b|schema|interface|\\.d\\.ts$|model') THEN 'type_definitions' END], lambda y: y IS NOT NULL) AS rules
 FROM u LEFT JOIN x USING (file_id) LEFT JOIN dep ON dep.run_id = u.run_id AND dep.file_id = u.file_id LEFT JOIN mods ON mods.run_id = u.run_id AND mods.dir = u.dir
 LEFT JOIN code ON code.run_id = u.run_id AND code.stem = regexp_replace(u.stem, '^test_|_test$', ''))"""


def inclusion_rules(spark, d):
    """(run_id, file_id, rules) of every file of a run's repository that the run doesn't select, with the inclusion rules that hold for it."""
    s = selected_files(spark, d)
    p = files(spark, d).withColumn("low", F.lower("path")).withColumn("stem", F.regexp_extract("low", STEM, 1)).withColumn("dir", F.regexp_replace("path", "[^/]*$", ""))
    x = table(spark, d, "chunks").groupBy("file_id").agg(F.bool_or(F.coalesce("content", F.lit("")).rlike(r"(?m)^(export|pub|public|def [a-z]|func [A-Z])")).alias("exports"))
    mine = s.join(p.select("file_id", "dir", "stem"), "file_id")
    hit = F.lit(True)
    dep = s.join(c4_dependency_edges(spark, d), F.col("file_id") == F.col("src")).select("run_id", F.col("dst").alias("file_id")).distinct().withColumn("needed", hit)
    mods = mine.select("run_id", "dir").distinct().withColumn("module", hit)
    code = mine.filter(~F.col("stem").rlike("^test_|_test$")).select("run_id", F.col("stem").alias("tested")).distinct().withColumn("covers", hit)
    u = table(spark, d, "selection_results").select("run_id", "repo_name").join(p, "repo_name").join(s, ["run_id", "file_id"], "left_anti").withColumn("tested", F.regexp_replace("stem", "^test_|_test$", ""))
    j = u.join(x, "file_id", "left").join(dep, ["run_id", "file_id"], "left").join(mods, ["run_id", "dir"], "left").join(code, ["run_id", "tested"], "left")
    low = F.col("low")
    rules = [
        (low.rlike(paths.ENTRY_NAME), "entry_point"), (F.col("needed"), "critical_dependency"), (low.rlike(r"(package\.json|requirements\.txt|cargo\.toml|go\.mod|pyproject\.toml|setup\.py|pom\.xml)[^/]*$"), "config_required"),
        (F.col("stem").rlike("^test_|_test$") & F.col("covers"), "test_coverage"), (F.col("module") & F.col("exports"), "api_completeness"),
        (low.rlike(r"makefile|dockerfile|docker-compose|\.github|\.gitlab-ci|jenkins|webpack|rollup|vite\.config"), "build_system"),
        (low.rlike(r"readme|architecture|design|(^|/)docs?/|\.(md|rst)$"), "documentation_core"), (low.rlike(TYPES), "type_definitions"),
    ]
    return j.select("run_id", "file_id", "size", "tokens", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules])).alias("rules"))


@query(_RULES_SQL + " SELECT run_id, file_id, array_to_string(rules, ',') AS rules FROM t WHERE len(rules) > 0")
def b21_inclusion_rules(spark, d):
    """The eight inclusion rules for each file that a run doesn't select; files with no rule are left out."""
    return inclusion_rules(spark, d).filter(F.size("rules") > 0).select("run_id", "file_id", F.array_join("rules", ",").alias("rules"))


#: Weight of a rule in the patch pass.
RULE_WEIGHT = {
    "critical_dependency": 3.0, "entry_point": 2.5, "config_required": 2.0, "api_completeness": 1.8, "build_system": 1.5, "type_definitions": 1.3, "test_coverage": 1.2, "documentation_core": 1.0,
}
_WEIGHT_SQL = "CASE x " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RULE_WEIGHT.items()) + " END"


@query(f"""
WITH RECURSIVE {EDGES_SQL}, fs AS (SELECT repo_name, file_id, sum({TOK}) AS tokens, max(coalesce(centrality_score, 0)) AS score FROM chunks GROUP BY 1, 2),
r AS (SELECT repo_name, file_id, CAST(tokens AS BIGINT) AS tokens, row_number() OVER (PARTITION BY repo_name ORDER BY score DESC, file_id) AS rn FROM fs),
w AS (SELECT repo_name, file_id, rn, tokens, tokens <= 6000 AS took, CASE WHEN tokens <= 6000 THEN tokens ELSE 0 END AS used FROM r WHERE rn = 1
 UNION ALL SELECT r.repo_name, r.file_id, r.rn, r.tokens, used + r.tokens <= 6000, CASE WHEN used + r.tokens <= 6000 THEN used + r.tokens ELSE used END FROM w JOIN r ON r.repo_name = w.repo_name AND r.rn = w.rn + 1),
one AS (SELECT repo_name, file_id, tokens FROM w WHERE took), need AS (SELECT dst AS file_id, count(*) AS users FROM one JOIN e0 ON e0.src = one.file_id GROUP BY 1),
c AS (SELECT r.repo_name, r.file_id, r.tokens, row_number() OVER (PARTITION BY r.repo_name ORDER BY users DESC, r.file_id) AS rn FROM r JOIN need USING (file_id) WHERE r.file_id NOT IN (SELECT file_id FROM one)),
v AS (SELECT repo_name, file_id, rn, tokens, tokens <= 2000 AS took, CASE WHEN tokens <= 2000 THEN tokens ELSE 0 END AS used FROM c WHERE rn = 1
 UNION ALL SELECT c.repo_name, c.file_id, c.rn, c.tokens, used + c.tokens <= 2000, CASE WHEN used + c.tokens <= 2000 THEN used + c.tokens ELSE used END FROM v JOIN c ON c.repo_name = v.repo_name AND c.rn = v.rn + 1)
SELECT repo_name, file_id, tokens, 'speculate' AS pass FROM one UNION ALL SELECT repo_name, file_id, tokens, 'patch' FROM v WHERE took""")
def i7_two_pass(spark, d):
    """Three quarters of the budget (8,000) for files by score; the rest for files that the chosen ones depend on and that were not chosen, the most used first."""
    c = table(spark, d, "chunks")
    f = c.groupBy("repo_name", "file_id").agg(F.sum(text.chunk_tokens()).alias("tokens"), F.max(F.coalesce("centrality_score", F.lit(0.0))).alias("score"))
    first = budget.skip_greedy(position(f, ["repo_name"], [F.desc("score"), F.col("file_id")]), "repo_name", "rank", "tokens", 6000).select("repo_name", "file_id", "tokens", F.lit("speculate").alias("pass"))
    need = first.select(F.col("file_id").alias("src")).join(c4_dependency_edges(spark, d), "src").groupBy(F.col("dst").alias("file_id")).agg(F.count("*").alias("users"))
    left = f.join(need, "file_id").join(first.select("file_id"), "file_id", "left_anti")
    ranked = position(left.select("repo_name", "file_id", "tokens", "users"), ["repo_name"], [F.desc("users"), F.col("file_id")])
    return first.unionByName(budget.skip_greedy(ranked, "repo_name", "rank", "tokens", 2000).select("repo_name", "file_id", "tokens", F.lit("patch").alias("pass")))


@query(_RULES_SQL + f""", k AS (SELECT run_id, file_id, list_sum(list_transform(rules, lambda x: {_WEIGHT_SQL})) AS priority FROM t WHERE len(rules) > 0),
tk AS (SELECT k.run_id, k.file_id, priority, CAST(f.tokens AS BIGINT) AS tokens FROM k JOIN f USING (file_id)),
o AS (SELECT *, sum(tokens) OVER (PARTITION BY run_id ORDER BY round(priority, 6) DESC, file_id ROWS UNBOUNDED PRECEDING) AS cum FROM tk),
passes AS (SELECT run_id, file_id, 'speculate' AS pass FROM selected UNION ALL SELECT run_id, file_id, 'patch' FROM o WHERE cum <= 4000)
SELECT run_id, pass, count(*) AS files FROM passes GROUP BY 1, 2""")
def g2_concatenated_passes(spark, d):
    """A run's selection and, after it, its patch: unselected files by the weight of their rules, up to the first that doesn't fit 4,000 tokens."""
    w = F.create_map(*[F.lit(x) for kv in RULE_WEIGHT.items() for x in kv])
    k = inclusion_rules(spark, d).filter(F.size("rules") > 0).withColumn("priority", F.round(F.aggregate("rules", F.lit(0.0), lambda a, r: a + F.element_at(w, r)), 6))
    patch = prefix_sum(k.select("run_id", "file_id", "tokens", "priority"), ["run_id"], [F.desc("priority"), F.col("file_id")], "tokens").filter("cum <= 4000").select("run_id", "file_id", F.lit("patch").alias("pass"))
    return selected_files(spark, d).withColumn("pass", F.lit("speculate")).unionByName(patch).groupBy("run_id", "pass").agg(F.count("*").alias("files"))


# ---- statistics of a selection

@query(f"""WITH {SELECTED_SQL}, f AS ({FILES_SQL}), j AS (SELECT run_id, f.*, coalesce(nullif(lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)), ''), 'none') AS ext FROM selected JOIN f USING (file_id)),
l AS (SELECT run_id, string_agg(ext || ':' || n, ',' ORDER BY ext) AS languages FROM (SELECT run_id, ext, count(*) AS n FROM j GROUP BY 1, 2) GROUP BY 1)
SELECT run_id, count(*) AS files, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(len(string_split(path, '/'))), 6) AS depth, count(*) FILTER (WHERE regexp_matches(lower(path), 'readme|(^|/)docs?/|\\.md$')) AS docs,
 count(*) FILTER (WHERE regexp_matches(lower(path), '(^|/)test_|_test\\.|(^|/)tests?/')) AS tests, count(*) FILTER (WHERE regexp_matches(lower(path), 'config|settings')) AS configs, any_value(languages) AS languages FROM j JOIN l USING (run_id) GROUP BY 1""")
def d8_selection_statistics(spark, d):
    """Per run: files, tokens, mean depth, flags and the language map (at most one entry per extension) of its selection."""
    f = files(spark, d)
    ext = F.coalesce(F.nullif(paths.extension(F.col("path")), F.lit("")), F.lit("none"))
    j = selected_files(spark, d).join(f, "file_id").withColumn("ext", ext)
    n = j.groupBy("run_id", "ext").agg(F.count("*").alias("n"))
    languages = n.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "ext", "n"))), ",").alias("languages"))
    p = F.lower("path")
    return j.groupBy("run_id").agg(
        F.count("*").alias("files"), F.sum("tokens").alias("tokens"), F.round(F.avg(F.size(F.split("path", "/"))), 6).alias("depth"), F.count_if(p.rlike(r"readme|(^|/)docs?/|\.md$")).alias("docs"),
        F.count_if(p.rlike(r"(^|/)test_|_test\.|(^|/)tests?/")).alias("tests"), F.count_if(p.rlike("config|settings")).alias("configs"),
    ).join(languages, "run_id")


# Weight of a class of files in content recall.
CLASS_WEIGHT = {"entry": 3.0, "config": 2.5, "examples": 2.0, "docs": 1.8, "general": 2.2}
_CLASS_SQL = """CASE WHEN regexp_matches(lower(path), '\\.(md|rst|txt)$|(^|/)docs?/') THEN 'docs' WHEN regexp_matches(regexp_extract(lower(path), '([^/]*)$', 1), '\\.(json|ya?ml|toml|ini|cfg|conf)$|^(requirements\\.txt|setup\\.py|makefile|dockerfile)$') THEN 'config'
 WHEN regexp_matches(lower(path), '(^|/)(main|__main__|app|server|index)\\.py$|(^|/)(main|index|app|server)\\.js$|(^|/)(index|main)\\.ts$|(^|/)main\\.(go|rs)$|(^|/)(lib|mod)\\.rs$') THEN 'entry'
 WHEN regexp_matches(lower(path), '(^|/)(examples?|demos?|samples?|tutorials?|tests?|specs?|benchmarks?)/') THEN 'examples' ELSE 'general' END"""


@query(f"""WITH {SELECTED_SQL}, f AS ({FILES_SQL}), g AS (SELECT repo_name, file_id, {_CLASS_SQL} AS class FROM f), a AS (SELECT r.run_id, g.file_id, class FROM selection_results r JOIN g USING (repo_name)),
c AS (SELECT a.run_id, class, count(s.file_id) * 1.0 / count(*) AS recall FROM a LEFT JOIN selected s ON s.run_id = a.run_id AND s.file_id = a.file_id GROUP BY 1, 2)
SELECT run_id, round(sum(recall * w) / sum(w), 6)::DOUBLE AS weighted, count(*) AS classes FROM c JOIN (VALUES ('entry', 3.0), ('config', 2.5), ('examples', 2.0), ('docs', 1.8), ('general', 2.2)) t(class, w) USING (class) GROUP BY 1""")
def d28_content_recall(spark, d):
    """Per run: the weighted mean over classes of files of the share that the run selects; classes without files don't count."""
    cat = F.when(F.lower("path").rlike(r"\.(md|rst|txt)$|(^|/)docs?/"), "docs").otherwise(paths.category(F.col("path")))
    g = files(spark, d).select("repo_name", "file_id", cat.alias("class"))
    a = table(spark, d, "selection_results").select("run_id", "repo_name").join(g, "repo_name").join(selected_files(spark, d).withColumn("hit", F.lit(1)), ["run_id", "file_id"], "left")
    c = a.groupBy("run_id", "class").agg((F.count("hit") / F.count("*")).alias("recall"))
    w = F.element_at(F.create_map(*[F.lit(x) for kv in CLASS_WEIGHT.items() for x in kv]), F.col("class"))
    return c.groupBy("run_id").agg(F.round(F.sum(F.col("recall") * w) / F.sum(w), 6).alias("weighted"), F.count("*").alias("classes"))


@query(f"""WITH {SELECTED_SQL}, f AS ({FILES_SQL}), g AS (SELECT file_id, max(change_count) AS n FROM git_files GROUP BY 1), truth AS (SELECT f.repo_name, f.file_id FROM f JOIN g USING (file_id) WHERE n >= 3),
o AS (SELECT s.run_id, s.file_id, f.tokens, f.path, row_number() OVER (PARTITION BY s.run_id ORDER BY f.tokens DESC, s.file_id) AS rn, t.file_id IS NOT NULL AS hit, sum(f.tokens) OVER (PARTITION BY s.run_id ORDER BY f.tokens DESC, s.file_id ROWS UNBOUNDED PRECEDING) AS cum
 FROM selected s JOIN f USING (file_id) LEFT JOIN truth t ON t.file_id = s.file_id),
n AS (SELECT r.run_id, count(t.file_id) AS wanted FROM selection_results r LEFT JOIN truth t USING (repo_name) GROUP BY 1)
SELECT run_id, round(CASE WHEN max(rn) >= 10 THEN count(*) FILTER (WHERE hit AND rn <= 10) / 10.0 ELSE 0 END, 6)::DOUBLE AS p10, round(CASE WHEN max(rn) >= 20 THEN count(*) FILTER (WHERE hit AND rn <= 20) / 20.0 ELSE 0 END, 6)::DOUBLE AS p20,
 round(CASE WHEN max(wanted) > 0 THEN count(*) FILTER (WHERE hit AND cum <= 8000) * 1.0 / max(wanted) ELSE 1 END, 6)::DOUBLE AS recall_at_budget, round(CASE WHEN max(wanted) > 0 THEN count(*) FILTER (WHERE hit) * 1.0 / max(wanted) ELSE 1 END, 6)::DOUBLE AS recall,
 round(count(DISTINCT lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))) * 1.0 / count(*), 6)::DOUBLE AS ext_diversity FROM o JOIN n USING (run_id) GROUP BY 1""")
def d27_retrieval_metrics(spark, d):
    """Per run, against the often changed files of its repository: precision at 10 and 20 (0 for fewer files), recall within 8,000 tokens and overall (1 where nothing is wanted), and extensions per file."""
    f = files(spark, d)
    g = table(spark, d, "git_files").groupBy("file_id").agg(F.max("change_count").alias("n")).filter("n >= 3")
    truth = f.join(g, "file_id").select("repo_name", "file_id")
    s = selected_files(spark, d).join(f.select("file_id", "tokens", "path"), "file_id").join(truth.select("file_id").withColumn("hit", F.lit(True)), "file_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    o = position(prefix_sum(s, ["run_id"], [F.desc("tokens"), F.col("file_id")], "tokens"), ["run_id"], [F.desc("tokens"), F.col("file_id")], "rn")
    n = table(spark, d, "selection_results").select("run_id", "repo_name").join(truth, "repo_name", "left").groupBy("run_id").agg(F.count("file_id").alias("wanted"))
    hit, rn, wanted = F.col("hit"), F.col("rn"), F.max("wanted")
    at = lambda k: F.round(F.when(F.max("rn") >= k, F.count_if(hit & (rn <= k)) / float(k)).otherwise(0.0), 6).alias(f"p{k}")
    recall = lambda c, name: F.round(F.when(wanted > 0, F.count_if(c) / wanted).otherwise(1.0), 6).alias(name)
    return o.join(n, "run_id").groupBy("run_id").agg(at(10), at(20), recall(hit & (F.col("cum") <= 8000), "recall_at_budget"), recall(hit, "recall"), F.round(F.countDistinct(paths.extension(F.col("path"))) / F.count("*"), 6).alias("ext_diversity"))
