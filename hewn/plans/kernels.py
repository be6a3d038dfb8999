"""Subset selection over real chunks: two-mode facility location, coverage, stable demotion, quotas, ladders and baselines (survey group J)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hewn.functions import text
from hewn.operators import budget, select
from hewn.operators.prefix import position, prefix_sum, prefix_sums
from hewn.plans.registry import query
from hewn.plans.scoring import _HEURISTIC_SQL, PRIORITY_SQL, TOTAL_SQL, heuristics, priority, total
from hewn.session import cut
from hewn.sources.tables import table

TOK = text.CHUNK_TOKENS_SQL
SIG_SQL = f"greatest(1, least({TOK}, CASE WHEN signature_tokens > 0 THEN signature_tokens ELSE {TOK} // 10 END))"


def signature_tokens():
    t = text.chunk_tokens()
    return F.greatest(F.lit(1), F.least(t, F.when(F.col("signature_tokens") > 0, F.col("signature_tokens")).otherwise(F.floor(t / 10)))).cast("long")


# ---- candidates

FEATURES_SQL = f"""[{TOK} / 1000.0, coalesce(complexity_score, 0) / 10.0, coalesce(doc_density, 0), CASE WHEN lower(kind) = 'function' THEN 1 ELSE 0 END, CASE WHEN lower(kind) = 'class' THEN 1 ELSE 0 END,
 CASE WHEN lower(kind) = 'import' THEN 1 ELSE 0 END, CASE WHEN test_links > 0 THEN 1 ELSE 0 END, coalesce(len(dependencies), 0) / 10.0]::DOUBLE[]"""
CANDIDATES_SQL = f"""c0 AS (SELECT repo_name AS grp, row_id AS id, file_id, rel_path || ':' || lpad(CAST(start_line AS VARCHAR), 9, '0') AS key, {TOK} AS full_tokens, CAST({SIG_SQL} AS BIGINT) AS sig_tokens, coalesce(centrality_score, 0) AS weight, {FEATURES_SQL} AS f FROM chunks WHERE repo_name IS NOT NULL),
cen AS (SELECT file_id, [{", ".join(f"avg(f[{i}])" for i in range(1, 9))}] AS p1 FROM c0 GROUP BY 1)"""
# unit vectors of the most used model, one per chunk
VECTORS_SQL = """v AS (SELECT chunk_id, arg_min(u, vec_id) AS u FROM (SELECT chunk_id, vec_id, list_transform(e, lambda x: x / n) AS u FROM (SELECT chunk_id, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n
 FROM (SELECT chunk_id, vec_id, embedding::DOUBLE[] AS e FROM code_embeddings WHERE model_name = 'hill-mini' AND model_version = '1.2' AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)) WHERE n > 0) GROUP BY 1)"""


def features():
    k, d = F.lower("kind"), lambda c: F.coalesce(F.when(c, 1.0), F.lit(0.0))
    return F.array(
        text.chunk_tokens() / 1000.0, F.coalesce("complexity_score", F.lit(0.0)) / 10.0, F.coalesce("doc_density", F.lit(0.0)), d(k == "function"), d(k == "class"), d(k == "import"), d(F.col("test_links") > 0), F.greatest(F.size(F.coalesce("dependencies", F.array().cast("array<struct<target:string,type:string,strength:double>>"))), F.lit(0)) / 10.0,
    )


def mean_vector(df, by: str, column: str, name: str):
    """The mean of an array column per key; one number per dimension is shuffled."""
    m = df.select(by, F.posexplode(column).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("m"))
    return m.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(name))


def candidates(spark, d):
    """Chunks with tokens in both forms, weight, features and the centroid of their file."""
    c = table(spark, d, "chunks").filter("repo_name is not null")
    key = F.concat("rel_path", F.lit(":"), F.lpad(F.col("start_line").cast("string"), 9, "0"))
    c = c.select(F.col("repo_name").alias("grp"), F.col("row_id").alias("id"), F.col("id").alias("chunk_id"), "file_id", key.alias("key"), text.chunk_tokens().alias("full_tokens"), signature_tokens().alias("signature_tokens"), F.coalesce("centrality_score", F.lit(0.0)).alias("weight"), features().alias("feature"))
    return c.join(mean_vector(c, "file_id", "feature", "p1"), "file_id")


def unit_vectors(spark, d):
    """(chunk_id, u): the first valid vector of the most used model for each chunk, at length one."""
    e = table(spark, d, "code_embeddings").filter("model_name = 'hill-mini' and model_version = '1.2' and size(embedding) = 64").select("chunk_id", "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    e = e.filter(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).withColumn("n", F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))).filter("n > 0")
    return e.groupBy("chunk_id").agg(F.min_by("e", "vec_id").alias("e")).select("chunk_id", "e").withColumn("n", F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))).select("chunk_id", F.transform("e", lambda x: x / F.col("n")).alias("u"))


# ---- two-mode facility location

COS_SQL = "CASE WHEN list_dot_product({0}, {0}) > 0 AND list_dot_product({1}, {1}) > 0 THEN list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0})) / sqrt(list_dot_product({1}, {1})) ELSE 0 END"


def greedy_sql(k: int, limit: int, places: tuple[str, ...] = ("p1",), coverage: float = 0.7) -> str:
    """Unrolled steps over ``c`` (grp, id, key, full_tokens, sig_tokens, weight, f, places...)."""
    near = " + ".join(f"CASE WHEN count(s.id) = 0 THEN 1 ELSE min(list_distance(any_c.{p}, s.{p})) END" for p in places)
    parts = ["s0 AS (SELECT grp, id, key, 0 AS step, '' AS mode, CAST(0 AS BIGINT) AS tokens, 0.0::DOUBLE AS score, f, " + ", ".join(places) + " FROM c WHERE false)"]
    for i in range(1, k + 1):
        cols = ", ".join(f"any_value(any_c.{p}) AS {p}" for p in places)
        parts.append(
            f"""g{i} AS (SELECT any_c.grp, any_c.id, any_value(any_c.key) AS key, any_value(any_c.f) AS f, {cols}, any_value(full_tokens) AS full_tokens, any_value(sig_tokens) AS sig_tokens, coalesce(sum(s.tokens), 0) AS used,
 ({coverage} * ({near}) / {len(places)} + {round(1 - coverage, 6)} * (1 - coalesce(greatest(0, max({COS_SQL.format('any_c.f', 's.f')})), 0))) * any_value(weight) AS gain
 FROM c any_c LEFT JOIN s{i - 1} s ON s.grp = any_c.grp WHERE NOT EXISTS (SELECT 1 FROM s{i - 1} t WHERE t.id = any_c.id) GROUP BY any_c.grp, any_c.id),
m{i} AS (SELECT *, 'full' AS mode, 0 AS mno, full_tokens AS tokens FROM g{i} UNION ALL SELECT *, 'signature', 1, sig_tokens FROM g{i}),
s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT grp, id, key, {i}, mode, tokens, score, f, {", ".join(places)} FROM (SELECT *, round(gain / greatest(tokens, 1), 9) AS score FROM m{i} WHERE used + tokens <= {limit}) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, key NULLS FIRST, id, mno) = 1)"""
        )
    return ", ".join(parts)


PICKS, LIMIT = 6, 1500
_J3 = f"WITH {CANDIDATES_SQL}, c AS (SELECT c0.*, p1 FROM c0 JOIN cen USING (file_id)), {greedy_sql(PICKS, LIMIT)}"


def _j3(spark, d):
    return select.two_mode_diverse(candidates(spark, d).withColumn("places", F.array("p1")), PICKS, LIMIT)


@query(_J3 + f" SELECT grp AS repo_name, id, step, mode, tokens, round(score, 7) AS score FROM s{PICKS}")
def j3_facility_two_mode(spark, d):
    """Packs of six chunks per repository by facility location and MMR over both forms, within 1,500 tokens."""
    return _j3(spark, d).select(F.col("grp").alias("repo_name"), "id", "step", "mode", "tokens", F.round("score", 7).alias("score"))


# clusters: the vectors nearest to the mean vector of a kind of chunks
_CLUSTERS = f"""{VECTORS_SQL}, vk AS (SELECT v.chunk_id, u, k.kind FROM v JOIN (SELECT id, min(lower(kind)) AS kind FROM chunks WHERE kind IS NOT NULL GROUP BY 1) k ON k.id = v.chunk_id),
km AS (SELECT kind, [{", ".join(f"avg(u[{i}])" for i in range(1, 65))}] AS m FROM vk GROUP BY 1), near AS (SELECT v.chunk_id, arg_min(kind, struct_pack(a := round(list_distance(u, m), 9), b := kind)) AS cluster FROM v, km GROUP BY 1),
cm AS (SELECT cluster, [{", ".join(f"avg(u[{i}])" for i in range(1, 65))}] AS p2, count(*) AS members FROM v JOIN near USING (chunk_id) GROUP BY 1)"""


def clusters(spark, d):
    """(chunk_id, cluster, u): each vector with the nearest of the kinds' mean vectors; kinds are few, so their means are broadcast as one row."""
    v = unit_vectors(spark, d)
    k = table(spark, d, "chunks").filter("kind is not null").groupBy(F.col("id").alias("chunk_id")).agg(F.min(F.lower("kind")).alias("kind"))
    means = mean_vector(v.join(k, "chunk_id"), "kind", "u", "m").agg(F.collect_list(F.struct("kind", "m")).alias("all"))
    best = F.array_min(F.transform("all", lambda s: F.struct(F.round(select.distance(F.col("u"), s["m"]), 9).alias("a"), s["kind"].alias("b"))))
    return v.crossJoin(F.broadcast(means)).select("chunk_id", best["b"].alias("cluster"), "u")


_J4 = f"""WITH {CANDIDATES_SQL}, {_CLUSTERS}, c AS (SELECT c0.grp, c0.id, c0.key, c0.full_tokens, c0.sig_tokens, c0.weight, c0.f, p1, p2 FROM c0 JOIN cen USING (file_id) JOIN chunks h ON h.row_id = c0.id JOIN near ON near.chunk_id = h.id JOIN cm USING (cluster)), {greedy_sql(PICKS, LIMIT, ("p1", "p2"))}"""


@query(_J4 + f" SELECT grp AS repo_name, id, step, mode, tokens, round(score, 7) AS score FROM s{PICKS}")
def j4_coverage(spark, d):
    """As j3 over chunks with vectors, with the centroids of their clusters beside those of their files."""
    k = clusters(spark, d)
    c = candidates(spark, d).join(k.drop("u"), "chunk_id").join(mean_vector(k, "cluster", "u", "p2"), "cluster")
    return select.two_mode_diverse(c.withColumn("places", F.array("p1", "p2")), PICKS, LIMIT).select(F.col("grp").alias("repo_name"), "id", "step", "mode", "tokens", F.round("score", 7).alias("score"))


@query(_J3 + f""", b AS (SELECT grp, avg(score) AS m FROM s{PICKS} GROUP BY 1), a AS (SELECT s.grp, s.id, CASE WHEN mode = 'full' AND s.score < m THEN 'signature' ELSE mode END AS mode, CASE WHEN mode = 'full' AND s.score < m THEN sig_tokens ELSE s.tokens END AS tokens, s.tokens AS old FROM s{PICKS} s JOIN b USING (grp) JOIN c ON c.id = s.id),
room AS (SELECT grp, {LIMIT} - sum(tokens) AS room FROM a GROUP BY 1), o AS (SELECT c.grp, c.id, full_tokens, sum(full_tokens) OVER (PARTITION BY c.grp ORDER BY round(weight / greatest(full_tokens, 1), 9) DESC, c.id ROWS UNBOUNDED PRECEDING) AS cum FROM c WHERE NOT EXISTS (SELECT 1 FROM s{PICKS} t WHERE t.id = c.id))
SELECT grp AS repo_name, id, mode, tokens, CASE WHEN tokens < old THEN 'demoted' ELSE 'kept' END AS state FROM a UNION ALL SELECT o.grp, o.id, 'full', full_tokens, 'added' FROM o JOIN room USING (grp) WHERE cum <= room""")
def j5_stable_demotion(spark, d):
    """The selection of j3; full chunks below the pack's mean score are demoted once, and the freed room goes to chunks outside the pack by weight per token. A demoted chunk is never taken up again."""
    c = candidates(spark, d).withColumn("places", F.array("p1"))
    s = select.two_mode_diverse(c, PICKS, LIMIT)
    low = (F.col("mode") == "full") & (F.col("score") < F.col("m"))
    a = s.join(s.groupBy(F.col("grp").alias("g")).agg(F.avg("score").alias("m")), F.col("grp") == F.col("g")).join(c.select("id", "signature_tokens"), "id")
    a = a.select("grp", "id", F.when(low, "signature").otherwise(F.col("mode")).alias("mode"), F.when(low, F.col("signature_tokens")).otherwise(F.col("tokens")).alias("tokens"), F.when(low & (F.col("signature_tokens") < F.col("tokens")), "demoted").otherwise("kept").alias("state"))
    room = a.groupBy(F.col("grp").alias("g")).agg((F.lit(LIMIT) - F.sum("tokens")).alias("room"))
    rest = c.join(s.select("id"), "id", "left_anti").select("grp", "id", "full_tokens", F.round(F.col("weight") / F.greatest("full_tokens", F.lit(1)), 9).alias("density"))
    o = prefix_sum(rest, ["grp"], [F.desc("density"), F.col("id")], "full_tokens").join(room, F.col("grp") == F.col("g")).filter("cum <= room")
    return a.unionByName(o.select("grp", "id", F.lit("full").alias("mode"), F.col("full_tokens").alias("tokens"), F.lit("added").alias("state"))).withColumnRenamed("grp", "repo_name")


@query(_J3 + f" SELECT variant, grp AS repo_name, count(*) AS chunks, CAST(sum(tokens) AS BIGINT) AS tokens FROM s{PICKS}, (VALUES ('objective'), ('summary')) t(variant) GROUP BY 1, 2")
def j7_objective_and_summary(spark, d):
    """Both variants choose as j3 does."""
    g = _j3(spark, d).groupBy(F.col("grp").alias("repo_name")).agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))
    return g.select(F.explode(F.array(F.lit("objective"), F.lit("summary"))).alias("variant"), "repo_name", "chunks", "tokens")


# ---- sparse MMR and facility location over vectors

def vector_greedy_sql(k: int, kind: str, limit: int | None, trade: float = 0.7) -> str:
    s = "coalesce(greatest(0, max(list_dot_product(p.u, s.u))), 0)"
    mmr = f"{trade} * any_value(quality) - {round(1 - trade, 6)} * {s}"
    gain = f"CASE WHEN {s} > 0.8 THEN ({mmr}) * 0.5 ELSE {mmr} END" if kind == "mmr" else f"({trade} * any_value(quality) + {round(1 - trade, 6)} * (1 - {s})) / any_value(p.tokens)"
    fits = f"WHERE used + tokens <= {limit}" if limit else ""
    parts = ["s0 AS (SELECT grp, id, 0 AS step, 0.0::DOUBLE AS gain, tokens, u FROM p WHERE false)"]
    for i in range(1, k + 1):
        parts.append(
            f"""g{i} AS (SELECT p.grp, p.id, any_value(p.tokens) AS tokens, any_value(p.u) AS u, coalesce(sum(s.tokens), 0) AS used, {gain} AS gain FROM p LEFT JOIN s{i - 1} s ON s.grp = p.grp WHERE NOT EXISTS (SELECT 1 FROM s{i - 1} t WHERE t.id = p.id) GROUP BY p.grp, p.id),
s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT grp, id, {i}, gain, tokens, u FROM (SELECT * FROM g{i} {fits}) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(gain, 9) DESC, id) = 1)"""
        )
    return ", ".join(parts)


_POOL = f"WITH {VECTORS_SQL}, p AS (SELECT repo_name AS grp, row_id AS id, {PRIORITY_SQL} AS quality, greatest(1, {TOK}) AS tokens, u FROM chunks JOIN v ON v.chunk_id = chunks.id WHERE repo_name IS NOT NULL), "


def _pool(spark, d):
    c = table(spark, d, "chunks").filter("repo_name is not null").select(F.col("repo_name").alias("grp"), F.col("row_id").alias("id"), F.col("id").alias("chunk_id"), priority().alias("quality"), text.chunk_tokens().alias("tokens"))
    return c.join(unit_vectors(spark, d).withColumnRenamed("u", "vec"), "chunk_id")


@query(_POOL + vector_greedy_sql(PICKS, "mmr", None) + f" SELECT grp AS repo_name, id, step, round(gain, 6) AS gain FROM s{PICKS}")
def j1_mmr(spark, d):
    """Six chunks per repository by maximal marginal relevance: the chunk's priority against its largest cosine to a chosen one."""
    return select.greedy_diverse(_pool(spark, d), PICKS, "mmr").select(F.col("grp").alias("repo_name"), "id", "step", F.round("gain", 6).alias("gain"))


@query(_POOL + vector_greedy_sql(PICKS, "facility", LIMIT) + f" SELECT grp AS repo_name, id, step, round(gain, 6) AS gain FROM s{PICKS}")
def j2_facility(spark, d):
    """Six chunks per repository by priority and distance per token, within 1,500 tokens."""
    return select.greedy_diverse(_pool(spark, d), PICKS, "facility", budget=LIMIT).select(F.col("grp").alias("repo_name"), "id", "step", F.round("gain", 6).alias("gain"))


# ---- quotas

# Least and most share of the budget, and multiplier, of a category.
QUOTAS = {"config": (0.15, 0.30, 2.0), "entry": (0.02, 0.07, 1.8), "examples": (0.01, 0.03, 0.5), "general": (0.60, 0.80, 1.0)}
BUDGET = 40_000
_QUOTA = "(VALUES " + ", ".join(f"('{k}', {a}, {b}, {m})" for k, (a, b, m) in QUOTAS.items()) + ") q(category, low, high, times)"
_CATEGORY = """CASE WHEN regexp_matches(regexp_extract(lower(path), '([^/]*)$', 1), '\\.(json|ya?ml|toml|ini|cfg|conf)$|^(requirements\\.txt|setup\\.py|makefile|dockerfile)$') THEN 'config'
 WHEN regexp_matches(lower(path), '(^|/)(main|__main__|app|server|index)\\.py$|(^|/)(main|index|app|server)\\.js$|(^|/)(index|main)\\.ts$|(^|/)main\\.(go|rs)$|(^|/)(lib|mod)\\.rs$') THEN 'entry'
 WHEN regexp_matches(lower(path), '(^|/)(examples?|demos?|samples?|tutorials?|tests?|specs?|benchmarks?)/') THEN 'examples' ELSE 'general' END"""


@query(_HEURISTIC_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""", w AS (SELECT file_id, path, greatest(1, f.tokens) AS tokens, round(({TOTAL_SQL})::DOUBLE, 6) AS score, {_CATEGORY} AS category FROM x JOIN f USING (file_id)),
dm AS (SELECT category, round(sum(score / tokens * times) * any_value(times) * ln(count(*) + 1), 6) AS demand, any_value(low) AS low, any_value(high) AS high FROM w JOIN {_QUOTA} USING (category) GROUP BY 1),
al AS (SELECT category, CAST(floor({BUDGET} * low) AS BIGINT) + greatest(0, least(CAST(floor(({BUDGET} - (SELECT sum(floor({BUDGET} * low)) FROM dm)) * demand / (SELECT sum(demand) FROM dm)) AS BIGINT), CAST(floor({BUDGET} * high) AS BIGINT) - CAST(floor({BUDGET} * low) AS BIGINT))) AS share FROM dm),
th AS (SELECT category, min(score) AS least FROM (SELECT category, score, row_number() OVER (PARTITION BY category ORDER BY score DESC, file_id) AS rn, count(*) OVER (PARTITION BY category) AS n FROM w) WHERE rn <= greatest(1, n // 5) GROUP BY 1),
r AS (SELECT w.category, file_id, w.tokens, CASE WHEN score >= least THEN CAST(floor(share * 1.05) AS BIGINT) ELSE share END AS lim, row_number() OVER (PARTITION BY w.category ORDER BY round(score / w.tokens, 9) DESC, file_id) AS rn FROM w JOIN al USING (category) JOIN th USING (category)),
z AS (SELECT category, file_id, rn, tokens, tokens <= lim AS took, CASE WHEN tokens <= lim THEN tokens ELSE 0 END AS used FROM r WHERE rn = 1
 UNION ALL SELECT r.category, r.file_id, r.rn, r.tokens, used + r.tokens <= lim, CASE WHEN used + r.tokens <= lim THEN used + r.tokens ELSE used END FROM z JOIN r ON r.category = z.category AND r.rn = z.rn + 1)
SELECT category, file_id, CAST(tokens AS BIGINT) AS tokens FROM z WHERE took""")
def j8_quota_density(spark, d):
    """Files by score per token within the budget of their category: its least share, and of the rest a part by demand up to its most; the best fifth of a category may exceed it by a twentieth."""
    from hewn.functions import paths

    w = heuristics(spark, d).select("file_id", F.greatest(F.lit(1), "tokens").alias("tokens"), F.round(total(), 6).alias("score"), paths.category(F.col("path")).alias("category"))
    q = F.broadcast(spark.createDataFrame([(k, *v) for k, v in QUOTAS.items()], "category string, low double, high double, times double"))
    dm = w.join(q, "category").groupBy("category").agg(F.round(F.sum(F.col("score") / F.col("tokens") * F.col("times")) * F.first("times") * F.log(F.count("*") + 1), 6).alias("demand"), F.first("low").alias("low"), F.first("high").alias("high"))
    low, high = F.floor(BUDGET * F.col("low")), F.floor(BUDGET * F.col("high"))
    al = dm.crossJoin(dm.agg(F.sum(low).alias("taken"), F.sum("demand").alias("all"))).select("category", (low + F.greatest(F.lit(0), F.least(F.floor((BUDGET - F.col("taken")) * F.col("demand") / F.col("all")), high - low))).alias("share"))
    ranked = position(w, ["category"], [F.desc("score"), F.col("file_id")], "rn")
    th = ranked.join(w.groupBy("category").agg(F.count("*").alias("n")), "category").filter(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") / 5))).groupBy("category").agg(F.min("score").alias("least"))
    r = w.join(F.broadcast(al), "category").join(F.broadcast(th), "category").select("category", "file_id", "tokens", F.when(F.col("score") >= F.col("least"), F.floor(F.col("share") * 1.05)).otherwise(F.col("share")).cast("long").alias("lim"), F.round(F.col("score") / F.col("tokens"), 9).alias("density"))
    return budget.skip_greedy(position(r, ["category"], [F.desc("density"), F.col("file_id")]), "category", "rank", "tokens", "lim").select("category", "file_id", "tokens")


# ---- ladders

_IMPORTANT = f"fs AS (SELECT repo_name, file_id, CAST(sum({TOK}) AS BIGINT) AS tokens, max(coalesce(centrality_score, 0)) AS score FROM chunks WHERE repo_name IS NOT NULL GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE {_IMPORTANT}, r AS (SELECT repo_name, file_id, tokens AS t, greatest(1, tokens // 10) AS s, row_number() OVER (PARTITION BY repo_name ORDER BY score DESC, file_id) AS rn FROM fs),
w AS (SELECT repo_name, CAST(0 AS BIGINT) AS file_id, CAST(0 AS BIGINT) AS rn, CAST(6000 AS BIGINT) AS room, '' AS mode, CAST(0 AS BIGINT) AS tokens FROM r WHERE rn = 1
 UNION ALL SELECT r.repo_name, r.file_id, r.rn, room - CASE WHEN t <= room THEN t WHEN t <= 4 * room THEN room ELSE least(s, room) END, CASE WHEN t <= room THEN 'full' WHEN t <= 4 * room THEN 'chunk' ELSE 'signature' END, CASE WHEN t <= room THEN t WHEN t <= 4 * room THEN room ELSE least(s, room) END
 FROM w JOIN r ON r.repo_name = w.repo_name AND r.rn = w.rn + 1 WHERE room > 0)
SELECT repo_name, file_id AS id, mode, tokens FROM w WHERE rn > 0""")
def j10_demotion(spark, d):
    """Files by importance: in full while they fit, cut to chunks that fill what is left if they are at most four times as large, else as signatures, until 6,000 tokens are used."""
    f = table(spark, d, "chunks").filter("repo_name is not null").groupBy("repo_name", F.col("file_id").alias("id")).agg(F.sum(text.chunk_tokens()).alias("full_tokens"), F.max(F.coalesce("centrality_score", F.lit(0.0))).alias("score"))
    f = position(f, ["repo_name"], [F.desc("score"), F.col("id")]).withColumn("sig", F.greatest(F.lit(1), F.floor(F.col("full_tokens") / 10)).cast("long")).withColumn("least_tokens", F.lit(1).cast("long"))
    ladder = [
        ("chunk", "case when full_tokens <= 4 * remaining and remaining > 0 then remaining end", lambda row, left: left if left > 0 and row["full_tokens"] <= 4 * left else None),
        ("signature", "case when remaining > 0 then least(sig, remaining) end", lambda row, left: min(row["sig"], left) if left > 0 else None),
    ]
    return budget.ladder_greedy(f, "repo_name", "rank", 6000, ladder).filter("tokens > 0 or mode = 'full'")


_HEAD = "string_split(content, chr(10))"


@query(f"""WITH RECURSIVE a AS (SELECT repo_name, row_id, CAST(floor(1.1 * {TOK}) AS BIGINT) AS t, CASE WHEN len({_HEAD}) > 30 THEN CAST(ceil((list_sum(list_transform(list_concat({_HEAD}[1:20], {_HEAD}[-10:]), lambda x: length(x) + 1)) + 12) / 4.0) AS BIGINT) END AS su,
 CASE WHEN length(signature) > 0 THEN CAST(ceil(length(signature) / 4.0) AS BIGINT) + 2 END AS si, coalesce(centrality_score, 0) AS c FROM chunks WHERE repo_name IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY c DESC, row_id) AS rn FROM a),
w AS (SELECT repo_name, CAST(0 AS BIGINT) AS row_id, CAST(0 AS BIGINT) AS rn, CAST(1900 AS BIGINT) AS room, '' AS mode, CAST(0 AS BIGINT) AS tokens FROM r WHERE rn = 1
 UNION ALL SELECT r.repo_name, r.row_id, r.rn, room - coalesce(CASE WHEN t <= room THEN t WHEN su <= room THEN su WHEN si <= room THEN si WHEN 8 <= room THEN 8 END, 0), CASE WHEN t <= room THEN 'full' WHEN su <= room THEN 'summary' WHEN si <= room THEN 'signature' WHEN 8 <= room THEN 'stub' END, CASE WHEN t <= room THEN t WHEN su <= room THEN su WHEN si <= room THEN si WHEN 8 <= room THEN 8 END
 FROM w JOIN r ON r.repo_name = w.repo_name AND r.rn = w.rn + 1)
SELECT repo_name, row_id AS id, mode, tokens FROM w WHERE rn > 0 AND mode IS NOT NULL""")
def j18_finalize(spark, d):
    """Estimated selection made exact: with real counts (estimate and a tenth) within 95 % of 2,000 tokens, a chunk in full, else head and tail, else its signature, else a stub, else dropped."""
    ls = F.split("content", "\n")
    parts = F.concat(F.slice(ls, 1, 20), F.slice(ls, F.greatest(F.size(ls) - 9, F.lit(1)), F.lit(10)))
    su = F.when(F.size(ls) > 30, F.ceil((F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x) + 1) + 12) / 4.0).cast("long"))
    si = F.when(F.length("signature") > 0, F.ceil(F.length("signature") / 4.0).cast("long") + 2)
    c = table(spark, d, "chunks").filter("repo_name is not null").select("repo_name", F.col("row_id").alias("id"), F.floor(text.chunk_tokens() * 1.1).cast("long").alias("full_tokens"), su.alias("su"), si.alias("si"), F.coalesce("centrality_score", F.lit(0.0)).alias("c"))
    c = position(c, ["repo_name"], [F.desc("c"), F.col("id")]).withColumn("least_tokens", F.least("full_tokens", "su", "si", F.lit(8)).cast("long"))
    number = lambda x: None if x is None or x != x else int(x)
    ladder = [("summary", "su", lambda row, _: number(row["su"])), ("signature", "si", lambda row, _: number(row["si"])), ("stub", "8", lambda row, _: 8)]
    return budget.ladder_greedy(c, "repo_name", "rank", 1900, ladder)


# Rank of a kind of documents.
KIND_RANK = {"readme": 4, "design_note": 3, "handbook": 3, "changelog": 2}


@query(f"""WITH RECURSIVE a AS (SELECT repo_name, doc_id, doc_kind, greatest(1, coalesce(length(text), 0) // 4) AS t, CASE doc_kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in KIND_RANK.items())} END AS rank FROM documents WHERE repo_name IS NOT NULL AND doc_kind IN ('readme', 'design_note', 'handbook', 'changelog')),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY t, doc_id) AS rn FROM a WHERE doc_kind = 'readme'),
w AS (SELECT repo_name, doc_id, rn, t, t <= 3000 AS took, CASE WHEN t <= 3000 THEN t ELSE 0 END AS used FROM r WHERE rn = 1 UNION ALL SELECT r.repo_name, r.doc_id, r.rn, r.t, used + r.t <= 3000, CASE WHEN used + r.t <= 3000 THEN used + r.t ELSE used END FROM w JOIN r ON r.repo_name = w.repo_name AND r.rn = w.rn + 1),
u AS (SELECT repo_name, sum(t) AS used FROM w WHERE took GROUP BY 1),
o AS (SELECT a.repo_name, doc_id, t, coalesce(used, 0) + sum(t) OVER (PARTITION BY a.repo_name ORDER BY rank DESC, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM a LEFT JOIN u USING (repo_name) WHERE doc_kind <> 'readme')
SELECT repo_name, doc_id, CAST(t AS BIGINT) AS tokens FROM w WHERE took UNION ALL SELECT repo_name, doc_id, CAST(t AS BIGINT) FROM o WHERE cum <= 3000""")
def j19_priority_documents(spark, d):
    """Fifteen hundredths of 20,000 tokens for a repository's documents: READMEs that fit first, then the others by rank up to the first that doesn't fit."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv]), F.col("doc_kind"))
    a = table(spark, d, "documents").filter("repo_name is not null").filter(F.col("doc_kind").isin(*KIND_RANK)).select("repo_name", "doc_id", "doc_kind", F.greatest(F.lit(1), F.floor(F.coalesce(F.length("text"), F.lit(0)) / 4)).cast("long").alias("tokens"), rank.alias("kind_rank"))
    first = budget.skip_greedy(position(a.filter("doc_kind = 'readme'").select("repo_name", "doc_id", "tokens"), ["repo_name"], [F.col("tokens"), F.col("doc_id")]), "repo_name", "rank", "tokens", 3000).select("repo_name", "doc_id", "tokens")
    used = first.groupBy(F.col("repo_name").alias("r")).agg(F.sum("tokens").alias("used"))
    rest = prefix_sum(a.filter("doc_kind <> 'readme'"), ["repo_name"], [F.desc("kind_rank"), F.col("doc_id")], "tokens").join(used, F.col("repo_name") == F.col("r"), "left").filter(F.col("cum") + F.coalesce("used", F.lit(0)) <= 3000)
    return first.unionByName(rest.select("repo_name", "doc_id", "tokens"))


# ---- baselines by terms and vectors

_TERMS = f"""t AS (SELECT row_id, unnest(string_split_regex(lower(content), '[^a-z0-9]+')) AS term FROM chunks WHERE content IS NOT NULL), tf AS (SELECT row_id, term, count(*) AS tf FROM t WHERE length(term) >= 3 GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), l AS (SELECT row_id, sum(tf) AS len FROM tf GROUP BY 1), n AS (SELECT count(*) AS n, avg(len) AS al FROM l)"""
_BM25 = "ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))"
_KIND_BOOST = "CASE lower(kind) WHEN 'main' THEN 1.5 WHEN 'class' THEN 1.2 WHEN 'function' THEN 1.1 ELSE 1.0 END"


def _chunk_terms(spark, d):
    c = table(spark, d, "chunks").filter("content is not null")
    tf = c.select("row_id", F.explode(F.split(F.lower("content"), "[^a-z0-9]+")).alias("term")).filter("length(term) >= 3").groupBy("row_id", "term").agg(F.count("*").alias("tf"))
    size = tf.groupBy("row_id").agg(F.sum("tf").alias("len"))
    return tf, tf.groupBy("term").agg(F.count("*").alias("df")), size, size.agg(F.count("*").alias("n"), F.avg("len").alias("al"))


def _bm25(spark, d):
    tf, df, size, n = _chunk_terms(spark, d)
    w = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("al")))
    s = tf.join(df, "term").join(size, "row_id").crossJoin(F.broadcast(n)).groupBy("row_id").agg(F.sum(w).alias("s"))
    k = F.lower("kind")
    boost = F.when(k == "main", 1.5).when(k == "class", 1.2).when(k == "function", 1.1).otherwise(1.0)
    c = table(spark, d, "chunks").select("repo_name", "row_id", text.chunk_tokens().alias("tokens"), boost.alias("boost"))
    return c.join(s, "row_id").select("repo_name", "row_id", "tokens", F.round(F.col("s") * F.col("boost"), 4).alias("score"))


def _within(scores, limit: int):
    return budget.break_in_order(scores, "repo_name", [F.desc("score"), F.col("row_id")], "tokens", limit).select("repo_name", "row_id", "score")


_WITHIN = "SELECT repo_name, row_id, score FROM (SELECT *, sum(tokens) OVER (PARTITION BY repo_name ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING) AS cum FROM sc) WHERE cum <= 1500"
_BM25_SCORES = f"{_TERMS}, sc AS (SELECT repo_name, row_id, {TOK} AS tokens, round((s * {_KIND_BOOST})::DOUBLE, 4) AS score FROM chunks JOIN (SELECT row_id, sum({_BM25}) AS s FROM tf JOIN df USING (term) JOIN l USING (row_id), n GROUP BY 1) q USING (row_id))"


@query(f"WITH {_BM25_SCORES} {_WITHIN}")
def j13_bm25_baseline(spark, d):
    """Chunks by BM25 against the query of all terms, times a factor of their kind, within 1,500 tokens per repository."""
    return _within(_bm25(spark, d), 1500)


_TOP = "q AS (SELECT term FROM df, n WHERE df BETWEEN 0.01 * n AND 0.3 * n ORDER BY round(ln(n * 1.0 / df) * df, 6) DESC, term LIMIT 50)"
_TFIDF_SCORES = f"{_TERMS}, {_TOP}, sc AS (SELECT repo_name, row_id, {TOK} AS tokens, round(s::DOUBLE, 6) AS score FROM chunks JOIN (SELECT row_id, sum(tf * 1.0 / len * ln(n * 1.0 / df)) AS s FROM tf JOIN q USING (term) JOIN df USING (term) JOIN l USING (row_id), n GROUP BY 1) z USING (row_id))"


def _tfidf(spark, d):
    tf, df, size, n = _chunk_terms(spark, d)
    j = df.crossJoin(F.broadcast(n))
    q = j.filter("df between 0.01 * n and 0.3 * n").orderBy(F.desc(F.round(F.log(F.col("n") / F.col("df")) * F.col("df"), 6)), "term").limit(50).select("term", F.log(F.col("n") / F.col("df")).alias("idf"))
    s = tf.join(F.broadcast(q), "term").join(size, "row_id").groupBy("row_id").agg(F.round(F.sum(F.col("tf") / F.col("len") * F.col("idf")), 6).alias("score"))
    return table(spark, d, "chunks").select("repo_name", "row_id", text.chunk_tokens().alias("tokens")).join(s, "row_id").select("repo_name", "row_id", "tokens", "score")


@query(f"WITH {_TFIDF_SCORES} {_WITHIN}")
def j16_tfidf_baseline(spark, d):
    """Chunks by TF-IDF against a query of the fifty heaviest terms, within 1,500 tokens per repository."""
    return _within(_tfidf(spark, d), 1500)


@query(f"""WITH {VECTORS_SQL}, p AS (SELECT repo_name, row_id, {TOK} AS tokens, u FROM chunks JOIN v ON v.chunk_id = chunks.id WHERE repo_name IS NOT NULL), m AS (SELECT repo_name, [{", ".join(f"avg(u[{i}])" for i in range(1, 65))}] AS m FROM p GROUP BY 1),
sc AS (SELECT repo_name, row_id, tokens, round(list_dot_product(u, m) / sqrt(list_dot_product(m, m)) / sqrt(list_dot_product(u, u)), 6) AS score FROM p JOIN m USING (repo_name)) {_WITHIN}""")
def j17_semantic_baseline(spark, d):
    """Chunks by cosine to the mean vector of their repository, within 1,500 tokens."""
    p = _pool(spark, d).select(F.col("grp").alias("repo_name"), F.col("id").alias("row_id"), "tokens", "vec")
    s = p.join(mean_vector(p, "repo_name", "vec", "m"), "repo_name").select("repo_name", "row_id", "tokens", F.round(text.cosine(F.col("vec"), F.col("m")), 6).alias("score"))
    return _within(s, 1500)


@query(f"""WITH {_TERMS}, {_TOP}, b AS (SELECT repo_name, row_id, score FROM (WITH {_BM25_SCORES} SELECT * FROM sc)), f AS (SELECT repo_name, row_id, score FROM (WITH {_TFIDF_SCORES} SELECT * FROM sc)),
a AS (SELECT 'bm25' AS retriever, * FROM b UNION ALL SELECT 'tfidf', * FROM f UNION ALL SELECT 'random', repo_name, row_id, CAST('0x' || substr(md5(row_id || ':42'), 1, 8) AS BIGINT)::DOUBLE FROM chunks UNION ALL SELECT 'oracle', repo_name, row_id, coalesce(centrality_score, 0) FROM chunks)
SELECT retriever, repo_name, row_id, row_number() OVER (PARTITION BY retriever, repo_name ORDER BY score DESC, row_id) AS place FROM a QUALIFY place <= 5""")
def j20_retrievers(spark, d):
    """The five best chunks of every repository by BM25, TF-IDF, a hash and the true score."""
    c = table(spark, d, "chunks")
    h = F.conv(F.substring(F.md5(F.concat(F.col("row_id").cast("string"), F.lit(":42"))), 1, 8), 16, 10).cast("double")
    of = lambda df, name: df.select(F.lit(name).alias("retriever"), "repo_name", "row_id", "score")
    a = of(_bm25(spark, d), "bm25").unionByName(of(_tfidf(spark, d), "tfidf")).unionByName(of(c.withColumn("score", h), "random")).unionByName(of(c.withColumn("score", F.coalesce("centrality_score", F.lit(0.0))), "oracle"))
    return position(a, ["retriever", "repo_name"], [F.desc("score"), F.col("row_id")], "place").filter("place <= 5").drop("score")


# ---- reallocation

@query(f"""WITH r AS (SELECT run_id, repo_name, greatest(0, token_budget - total_tokens) AS freed, chunk_modes FROM selection_results JOIN baseline_configs USING (config_id) WHERE total_tokens IS NOT NULL),
c AS (SELECT repo_name, row_id, id, lower(coalesce(kind, 'none')) AS kind, {TOK} AS tokens, round(coalesce(centrality_score, 0) / greatest({TOK}, 1), 9) AS density FROM chunks),
o AS (SELECT r.run_id, freed, c.row_id, c.kind, c.tokens, c.density FROM r JOIN c USING (repo_name) WHERE freed > 0 AND NOT coalesce(list_contains(map_keys(chunk_modes), c.id), false)),
g AS (SELECT run_id, 'greedy_utility' AS strategy, tokens, sum(tokens) OVER (PARTITION BY run_id ORDER BY density DESC, row_id ROWS UNBOUNDED PRECEDING) AS cum, freed AS lim FROM o),
b AS (SELECT run_id, 'balanced' AS strategy, tokens, sum(tokens) OVER (PARTITION BY run_id, kind ORDER BY density DESC, row_id ROWS UNBOUNDED PRECEDING) AS cum, freed // (SELECT count(DISTINCT lower(coalesce(kind, 'none'))) FROM chunks) AS lim FROM o)
SELECT run_id, strategy, count(*) AS added, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT * FROM g UNION ALL SELECT * FROM b) WHERE cum <= lim GROUP BY 1, 2""")
def j21_reallocation(spark, d):
    """What a run's unused budget would add from the chunks that it left out: all of it by score per token, or in equal parts to each kind; coverage-gap and diversity strategies go by score as well."""
    b = table(spark, d, "baseline_configs").select("config_id", "token_budget")
    r = table(spark, d, "selection_results").filter("total_tokens is not null").join(F.broadcast(b), "config_id").select("run_id", "repo_name", F.greatest(F.lit(0), F.col("token_budget") - F.col("total_tokens")).alias("freed"), "chunk_modes").filter("freed > 0")
    t = text.chunk_tokens()
    c = table(spark, d, "chunks").select("repo_name", "row_id", "id", F.lower(F.coalesce("kind", F.lit("none"))).alias("kind"), t.alias("tokens"), F.round(F.coalesce("centrality_score", F.lit(0.0)) / F.greatest(t, F.lit(1)), 9).alias("density"))
    c = cut(c)
    taken = r.select("run_id", "repo_name", "freed", F.explode(F.map_keys("chunk_modes")).alias("id"))
    r = r.select("run_id", "repo_name", "freed")
    k = F.broadcast(c.agg(F.countDistinct("kind").alias("k")))
    part = lambda df: df.crossJoin(k).withColumn("freed", F.floor(F.col("freed") / F.col("k"))).drop("k")
    g = _added(c, r, taken, ["repo_name"]).withColumn("strategy", F.lit("greedy_utility"))
    e = _added(c, part(r).join(c.select("repo_name", "kind").distinct(), "repo_name"), part(taken), ["repo_name", "kind"]).withColumn("strategy", F.lit("balanced"))
    return g.unionByName(e).groupBy("run_id", "strategy").agg(F.sum("added").alias("added"), F.sum("tokens").alias("tokens"))


def _added(c, runs, taken, groups: list[str]):
    """(run_id, added, tokens) for each run and group: the chunks of ``c`` by density that the run hasn't taken, as long as their sum is at most ``freed``.

    No run meets all chunks of its repository. The sum ``cum`` of all chunks so far, less that of the run's own
    (``mine``), never falls along the order; after the last own chunk at which it is within ``freed``,
    only ``cum`` grows. The end is therefore the last chunk with ``cum`` at most ``freed + mine``, and chunks and
    such limits are sorted together.
    """
    c = c.filter("repo_name is not null")
    n = cut(prefix_sum(c, groups, [F.desc("density"), F.col("row_id")], "tokens"))
    so_far = Window.partitionBy("run_id", *groups).orderBy(F.desc("density"), "row_id").rowsBetween(Window.unboundedPreceding, 0)
    own = taken.join(n, ["repo_name", "id"]).withColumn("mine", F.sum("tokens").over(so_far)).filter("cum - mine <= freed").groupBy("run_id", *groups).agg(F.count("*").alias("k"), F.max("mine").alias("mine"))
    asked = runs.join(own, ["run_id", *groups], "left").fillna(0, ["k", "mine"])
    chunks = n.select(*groups, F.col("cum").alias("at"), F.lit(1).cast("long").alias("one"), "tokens")
    both = chunks.unionByName(asked.select(*groups, (F.col("freed") + F.col("mine")).alias("at"), "run_id", "k", "mine"), allowMissingColumns=True)
    # of equal sums chunks come first
    ends = prefix_sums(both, groups, [F.col("at"), F.col("run_id").asc_nulls_first()], {"n": "one", "sum": "tokens"}).filter("run_id is not null")
    return ends.select("run_id", (F.col("n") - F.col("k")).alias("added"), (F.col("sum") - F.col("mine")).alias("tokens")).filter("added > 0")
