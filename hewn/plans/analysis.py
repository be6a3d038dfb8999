"""Graph, selection, vector, statistics and gate queries (survey groups D14-D15, F4, I to O)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hewn.functions import text
from hewn.operators import budget, graph, select, stats
from hewn.operators.prefix import position
from hewn.plans.registry import query
from hewn.plans.relational import _paired, _ratings, c4_dependency_edges
from hewn.session import cut, spread
from hewn.sources.tables import table

TOK = text.CHUNK_TOKENS_SQL

EDGES_SQL = """e0 AS (SELECT DISTINCT src, dst FROM (SELECT file_id AS src, unnest(dependencies).target AS target FROM chunks) x JOIN (SELECT id, min(file_id) AS dst FROM chunks WHERE id IS NOT NULL GROUP BY 1) n ON x.target = n.id WHERE src <> dst),
nodes AS (SELECT DISTINCT file_id AS node FROM chunks)"""


def _graph(spark, d):
    return table(spark, d, "chunks").select(F.col("file_id").alias("node")).distinct(), c4_dependency_edges(spark, d)


def _rank_sql(edges: str, steps: int = 10, base: str = "0.15 / (SELECT count(*) FROM nodes)", more: str = "", first: str = "1.0 / (SELECT count(*) FROM nodes)", lost: bool = False, last: str = "SELECT node, round(CAST(r AS DOUBLE), 9) AS rank FROM {r}") -> str:
    parts = [f"WITH {EDGES_SQL}, e AS ({edges}), o AS (SELECT src, count(*) AS n FROM e GROUP BY 1){more}, r0 AS (SELECT node, {first} AS r FROM nodes)"]
    for i in range(steps):
        spread = f" + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM o)) / (SELECT count(*) FROM nodes)" if lost else ""
        parts.append(
            f"r{i + 1} AS (SELECT node, ({base}) + 0.85 * coalesce(g, 0){spread} AS r FROM nodes LEFT JOIN (SELECT e.dst AS d, sum(r{i}.r / o.n) AS g FROM e JOIN r{i} ON r{i}.node = e.src JOIN o ON o.src = e.src GROUP BY 1) x ON x.d = nodes.node)"
        )
    return ", ".join(parts) + " " + last.format(r=f"r{steps}")


@query(_rank_sql("SELECT src, dst FROM e0"))
def i1_pagerank(spark, d):
    n, e = _graph(spark, d)
    return graph.pagerank(n, e).select("node", F.round("rank", 9).alias("rank"))


@query(_rank_sql("SELECT dst AS src, src AS dst FROM e0"))
def i2_pagerank_reverse(spark, d):
    n, e = _graph(spark, d)
    return graph.pagerank(n, graph.reversed_edges(e)).select("node", F.round("rank", 9).alias("rank"))


@query(_rank_sql("SELECT src, dst FROM e0", steps=20, lost=True, last="SELECT node, round(CAST(r / (SELECT max(r) FROM {r}) AS DOUBLE), 7) AS rank FROM {r}"))
def i3_pagerank_dangling(spark, d):
    n, e = _graph(spark, d)
    r = graph.pagerank(n, e, dangling=True, steps=20)
    return r.crossJoin(r.agg(F.max("rank").alias("m"))).select("node", F.round(F.col("rank") / F.col("m"), 7).alias("rank"))


_SEED = """, s AS (SELECT DISTINCT file_id AS node FROM chunks WHERE lower(kind) = 'main'),
w AS (SELECT node, max(w) AS w FROM (SELECT node, 1.0 AS w FROM s UNION ALL SELECT dst, 0.5 FROM e0 WHERE src IN (SELECT node FROM s) UNION ALL SELECT src, 0.5 FROM e0 WHERE dst IN (SELECT node FROM s)) GROUP BY 1),
t0 AS (SELECT nodes.node, 0.5 / (SELECT count(*) FROM nodes) + 0.5 * coalesce(w.w, 0) / (SELECT sum(w) FROM w) AS sh FROM nodes LEFT JOIN w ON w.node = nodes.node), tele AS (SELECT node AS tn, sh / (SELECT sum(sh) FROM t0) AS sh FROM t0)"""


@query(_rank_sql("SELECT src, dst FROM e0", base="0.15 * (SELECT sh FROM tele WHERE tn = nodes.node)", more=_SEED))
def i4_personalised(spark, d):
    n, e = _graph(spark, d)
    seeds = table(spark, d, "chunks").filter("lower(kind) = 'main'").select(F.col("file_id").alias("node"))
    return graph.pagerank(n, e, teleport=graph.teleport_to(n, e, seeds)).select("node", F.round("rank", 9).alias("rank"))


_MAIN = ", s AS (SELECT DISTINCT file_id AS node FROM chunks WHERE lower(kind) = 'main')"
_SHARE = "CASE WHEN nodes.node IN (SELECT node FROM s) THEN 1.0 / (SELECT count(*) FROM s) ELSE 0 END"


@query(_rank_sql("SELECT src, dst FROM e0", base=f"0.15 * {_SHARE}", more=_MAIN, first=_SHARE))
def i5_seeded(spark, d):
    n, e = _graph(spark, d)
    s = table(spark, d, "chunks").filter("lower(kind) = 'main'").select(F.col("file_id").alias("node")).distinct()
    share = s.crossJoin(s.agg(F.count("*").alias("t"))).select("node", (1.0 / F.col("t")).alias("share"))
    return graph.pagerank(n, e, teleport=share, start=share.withColumnRenamed("share", "rank")).select("node", F.round("rank", 9).alias("rank"))


_ADDED = ", added AS (SELECT DISTINCT src, dst FROM (SELECT file_id AS src, unnest(list_filter(dependencies, lambda x: x.type = 'inheritance')).target AS target FROM chunks) x JOIN (SELECT id, min(file_id) AS dst FROM chunks GROUP BY 1) n ON x.target = n.id WHERE src <> dst)"
_SWEEPS = ", o2 AS (SELECT src, count(*) AS n FROM e0 GROUP BY 1), touched AS (SELECT src AS node FROM added UNION SELECT dst FROM added), affected AS (SELECT node FROM touched UNION SELECT dst FROM e0 WHERE src IN (SELECT node FROM touched)), q0 AS (SELECT node, r FROM r10)" + "".join(
    f", q{i + 1} AS (SELECT q{i}.node, CASE WHEN q{i}.node IN (SELECT node FROM affected) THEN 0.15 / (SELECT count(*) FROM nodes) + 0.85 * coalesce(g, 0) ELSE q{i}.r END AS r FROM q{i} LEFT JOIN (SELECT e0.dst AS d, sum(p.r / o2.n) AS g FROM e0 JOIN q{i} p ON p.node = e0.src JOIN o2 ON o2.src = e0.src GROUP BY 1) x ON x.d = q{i}.node)"
    for i in range(5)
)


@query(_rank_sql("SELECT src, dst FROM e0 EXCEPT SELECT src, dst FROM added", more="", last=_SWEEPS + " SELECT node, round(CAST(r AS DOUBLE), 9) AS rank FROM q5").replace(", e AS (", _ADDED + ", e AS (", 1).replace(" , o2", ", o2", 1))
def i6_incremental(spark, d):
    """The graph without its import edges, then with them added: only their ends and successors are computed again."""
    n, e = _graph(spark, d)
    c = table(spark, d, "chunks")
    x = c.select(F.col("file_id").alias("src"), F.explode("dependencies").alias("x")).filter("x.type = 'inheritance'").select("src", F.col("x.target").alias("id"))
    added = x.join(c.groupBy("id").agg(F.min("file_id").alias("dst")), "id").filter("src <> dst").select("src", "dst").distinct()
    before = e.join(added, ["src", "dst"], "left_anti")
    old = graph.pagerank(n, before)
    touched = added.select(F.col("src").alias("node")).unionByName(added.select(F.col("dst").alias("node"))).distinct()
    return graph.incremental_pagerank(n, graph.apply_delta(before, added, added.limit(0)), old, touched).select("node", F.round("rank", 9).alias("rank"))


_SHUFFLED = "SELECT a.src, b.dst FROM (SELECT src, row_number() OVER (ORDER BY md5(src || '-' || dst || ':7'), src, dst) AS i FROM e0) a JOIN (SELECT dst, row_number() OVER (ORDER BY md5(src || '-' || dst || ':8'), src, dst) AS i FROM e0) b USING (i)"


@query(_rank_sql(f"SELECT DISTINCT src, dst FROM ({_SHUFFLED})"))
def i8_shuffle_control(spark, d):
    n, e = _graph(spark, d)
    return graph.pagerank(n, graph.shuffled(e, 7)).select("node", F.round("rank", 9).alias("rank"))


@query("""WITH """ + EDGES_SQL + """ SELECT node, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, round((2 * coalesce(i.n, 0) + coalesce(o.n, 0)) * 1.0 / (SELECT count(*) FROM nodes), 9)::DOUBLE AS score
FROM nodes LEFT JOIN (SELECT dst, count(*) AS n FROM e0 GROUP BY 1) i ON i.dst = node LEFT JOIN (SELECT src, count(*) AS n FROM e0 GROUP BY 1) o ON o.src = node""")
def d6_degree_score(spark, d):
    n, e = _graph(spark, d)
    i, o = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i")), e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"))
    j = n.join(i, "node", "left").join(o, "node", "left").fillna(0, ["i", "o"]).crossJoin(n.agg(F.count("*").alias("n")))
    return j.select("node", F.col("i").alias("in_degree"), F.col("o").alias("out_degree"), F.round((2 * F.col("i") + F.col("o")) / F.col("n"), 9).alias("score"))


@query(f"""WITH {EDGES_SQL}, i AS (SELECT dst AS node, count(*) AS n FROM e0 GROUP BY 1) SELECT node, n AS in_degree FROM i ORDER BY n DESC, node LIMIT 10""")
def f4_authorities(spark, d):
    """A top-ten report."""
    _, e = _graph(spark, d)
    return e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree")).orderBy(F.desc("in_degree"), "node").limit(10)


@query(f"""WITH {EDGES_SQL} SELECT e.src, e.dst, count(*) AS shared FROM e0 e JOIN e0 p ON p.src = e.src JOIN e0 q ON q.src = e.dst AND q.dst = p.dst GROUP BY 1, 2 HAVING count(*) >= 1""")
def g7_link_clusters(spark, d):
    """Linked files that share targets. Each link is looked at from its end with fewer targets, so a hub's targets are never paired with each other."""
    _, e = _graph(spark, d)
    n = e.groupBy("src").agg(F.count("*").alias("n"))
    m = e.join(n, "src").join(n.select(F.col("src").alias("dst"), F.col("n").alias("k")), "dst")
    small = F.col("n") <= F.col("k")
    sides = m.select("src", "dst", F.when(small, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(small, F.col("dst")).otherwise(F.col("src")).alias("y"))
    seen = sides.join(e.select(F.col("src").alias("x"), F.col("dst").alias("c")), "x")
    both = seen.join(e.select(F.col("src").alias("y"), F.col("dst").alias("c")), ["y", "c"])
    return both.groupBy("src", "dst").agg(F.count("*").alias("shared"))


# ---- terms

TERMS_SQL = """t AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS term FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE length(term) >= 3 GROUP BY 1, 2), n AS (SELECT count(DISTINCT doc_id) AS n FROM tf), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""


def _tf(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    t = docs.select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z0-9_]+")).alias("term")).filter(F.length("term") >= 3)
    return t.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query(f"WITH {TERMS_SQL} SELECT term, df, round(ln(n * 1.0 / df), 6) AS idf FROM df, n WHERE df >= 2 AND df <= 0.95 * n")
def d2_document_frequency(spark, d):
    tf = _tf(spark, d)
    n = tf.agg(F.countDistinct("doc_id").alias("n"))
    return tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(n).filter("df >= 2 and df <= 0.95 * n").select("term", "df", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))


@query(f"""WITH {TERMS_SQL}, l AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1), w AS (SELECT doc_id, term, tf / len * ln(n * 1.0 / df) AS w FROM tf JOIN l USING (doc_id) JOIN df USING (term), n)
SELECT doc_id, round(sum(w * w), 9) AS norm2, count(*) AS terms FROM w GROUP BY 1""")
def d3_tfidf(spark, d):
    tf = _tf(spark, d)
    size = tf.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    w = F.col("tf") / F.col("len") * F.log(F.col("n") / F.col("df"))
    return tf.join(size, "doc_id").join(df, "term").crossJoin(size.agg(F.count("*").alias("n"))).groupBy("doc_id").agg(F.round(F.sum(w * w), 9).alias("norm2"), F.count("*").alias("terms"))


@query(f"WITH {TERMS_SQL} SELECT term, df FROM df, n WHERE df BETWEEN 0.05 * n AND 0.5 * n ORDER BY ln(n * 1.0 / df) DESC, term LIMIT 50")
def f6_query_terms(spark, d):
    """A top-fifty report."""
    tf = _tf(spark, d)
    n = tf.agg(F.countDistinct("doc_id").alias("n"))
    return tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(n).filter("df between 0.05 * n and 0.5 * n").orderBy("df", "term").limit(50).select("term", "df")


@query(f"""WITH {TERMS_SQL}, l AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1), a AS (SELECT avg(len) AS al FROM l),
q AS (SELECT DISTINCT item_id, unnest(string_split_regex(lower(question), '[^a-z0-9_]+')) AS term FROM qa_items WHERE question IS NOT NULL),
s AS (SELECT item_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))) AS s FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l USING (doc_id), a, n GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, s, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 6) DESC, doc_id) AS place FROM s)
SELECT item_id, doc_id, round(CAST(s AS DOUBLE), 6) AS score, place FROM r WHERE place <= 10""")
def h16_bm25(spark, d, most_terms: int = 1_000_000):
    """BM25 of every question against every document that shares a term; ten best documents per question (a top-k report).

    Lengths come from the rows themselves; only terms that some question has are counted. Up to
    ``most_terms`` different terms are broadcast, more are joined.
    """
    docs = spread(table(spark, d, "documents").filter("text is not null").select("doc_id", "text"))
    words = docs.select("doc_id", F.filter(F.split(F.lower("text"), "[^a-z0-9_]+"), lambda x: F.length(x) >= 3).alias("words")).select("doc_id", "words", F.size("words").cast("long").alias("len"))
    q = table(spark, d, "qa_items").filter("question is not null").select("item_id", F.explode(F.array_distinct(F.split(F.lower("question"), "[^a-z0-9_]+"))).alias("term")).filter(F.length("term") >= 3)
    terms = cut(q.select("term").distinct())
    terms = F.broadcast(terms) if terms.count() <= most_terms else terms
    tf = cut(words.select("doc_id", "len", F.explode("words").alias("term")).join(terms, "term").groupBy("term", "doc_id", "len").agg(F.count("*").alias("tf")))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    all_ = words.filter("len > 0").agg(F.avg("len").alias("al"), F.count("*").alias("n"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    w = tf.join(df, "term").crossJoin(F.broadcast(all_)).select("term", "doc_id", (idf * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("len") / F.col("al")))).alias("w"))
    s = q.join(w, "term").groupBy("item_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return s.withColumn("place", place.cast("long")).filter("place <= 10")


# ---- selection


@query(f"""
WITH RECURSIVE r AS (SELECT repo_name, row_id, lower(coalesce(kind, 'none')) AS kind, {TOK} AS tokens, row_number() OVER (PARTITION BY repo_name ORDER BY coalesce(centrality_score, 0) / greatest({TOK}, 1) DESC, row_id) AS rn FROM chunks),
w AS (SELECT repo_name, row_id, rn, kind, tokens, tokens <= 400 AS took, CASE WHEN tokens <= 400 THEN tokens ELSE 0 END AS used, MAP([kind], [CASE WHEN tokens <= 400 THEN tokens ELSE 0 END]) AS spent FROM r WHERE rn = 1
 UNION ALL SELECT r.repo_name, r.row_id, r.rn, r.kind, r.tokens, used + r.tokens <= 2000 AND coalesce(spent[r.kind], 0) + r.tokens <= 400,
  CASE WHEN used + r.tokens <= 2000 AND coalesce(spent[r.kind], 0) + r.tokens <= 400 THEN used + r.tokens ELSE used END,
  CASE WHEN used + r.tokens <= 2000 AND coalesce(spent[r.kind], 0) + r.tokens <= 400 THEN map_concat(spent, MAP([r.kind], [coalesce(spent[r.kind], 0) + r.tokens])) ELSE spent END FROM w JOIN r ON r.repo_name = w.repo_name AND r.rn = w.rn + 1)
SELECT repo_name, row_id AS id, kind, tokens FROM w WHERE took""")
def j6_density_class_cap(spark, d):
    c = table(spark, d, "chunks").select("repo_name", F.col("row_id").alias("id"), F.lower(F.coalesce("kind", F.lit("none"))).alias("kind"), text.chunk_tokens().alias("tokens"), F.coalesce("centrality_score", F.lit(0.0)).alias("score"))
    ranked = position(select.density(c), ["repo_name"], [F.desc("density"), F.col("id")])
    return budget.capped_greedy(ranked.select("repo_name", "id", "kind", "tokens", "rank"), "repo_name", "kind", "rank", 2000, 0.2)


@query(f"""WITH f AS (SELECT repo_name, file_id, CAST(sum({TOK}) AS BIGINT) AS tokens FROM chunks GROUP BY 1, 2)
SELECT repo_name, file_id, tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY repo_name ORDER BY tokens, file_id ROWS UNBOUNDED PRECEDING) AS cum FROM f) WHERE cum <= 4000""")
def j12_concat_by_file(spark, d):
    f = table(spark, d, "chunks").groupBy("repo_name", "file_id").agg(F.sum(text.chunk_tokens()).alias("tokens"))
    return budget.break_in_order(f, "repo_name", [F.col("tokens"), F.col("file_id")], "tokens", 4000).select("repo_name", "file_id", "tokens")


@query(f"""SELECT repo_name, row_id FROM (SELECT repo_name, row_id, sum({TOK}) OVER (PARTITION BY repo_name ORDER BY md5(concat(CAST(row_id AS VARCHAR), ':42')), row_id ROWS UNBOUNDED PRECEDING) AS cum FROM chunks) WHERE cum <= 2000""")
def j14_hash_random(spark, d):
    c = table(spark, d, "chunks").select("repo_name", "row_id", text.chunk_tokens().alias("tokens"), F.md5(F.concat(F.col("row_id").cast("string"), F.lit(":42"))).alias("h"))
    return budget.break_in_order(c, "repo_name", [F.col("h"), F.col("row_id")], "tokens", 2000).select("repo_name", "row_id")


@query(f"""SELECT repo_name, row_id FROM (SELECT repo_name, row_id, sum({TOK}) OVER (PARTITION BY repo_name ORDER BY ingested_at DESC, row_id ROWS UNBOUNDED PRECEDING) AS cum FROM chunks) WHERE cum <= 2000""")
def j15_recency(spark, d):
    c = table(spark, d, "chunks").select("repo_name", "row_id", "ingested_at", text.chunk_tokens().alias("tokens"))
    return budget.break_in_order(c, "repo_name", [F.desc("ingested_at"), F.col("row_id")], "tokens", 2000).select("repo_name", "row_id")


# ---- vectors

@query("""
WITH p AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM p GROUP BY 1, 2)
SELECT vec_id, round(sum(x * c) / sqrt(sum(x * x)) / sqrt(sum(c * c)), 6) AS cosine FROM p JOIN c USING (label, i) GROUP BY 1""")
def h24_cosine_to_centroid(spark, d):
    v = table(spark, d, "embeddings")
    c = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    c = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("centroid"))  # one number per dimension
    return v.join(c, "label").select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("centroid")), 6).alias("cosine"))


@query("""
WITH p AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM p GROUP BY 1, 2),
s AS (SELECT p.vec_id, c.label, sqrt(sum((x - c) * (x - c))) AS dist FROM p JOIN c USING (i) GROUP BY 1, 2)
SELECT vec_id, round(round(min(dist), 9), 6) AS dist, arg_min(label, round(dist, 9) * 1000 + label * 1e-9) AS nearest FROM s GROUP BY 1""")
def c15_nearest_centroid(spark, d):
    """Each vector against all centroids, of which there is one per label; labels are the few classes."""
    v = table(spark, d, "embeddings")
    c = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    c = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("centroid"))
    every = c.agg(F.collect_list(F.struct("label", "centroid")).alias("all"))
    dist = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda u, w: F.pow(u.cast("double") - w, F.lit(2))), F.lit(0.0), lambda s, t: s + t))
    best = F.array_min(F.transform("all", lambda s: F.struct(F.round(dist(F.col("embedding"), s["centroid"]), 9).alias("d"), s["label"].alias("l"))))
    return v.crossJoin(every).select("vec_id", best.alias("b")).select("vec_id", F.round("b.d", 6).alias("dist"), F.col("b.l").alias("nearest"))


@query()
def k2_kmeans(spark, d, starts: int = 10, task_rows: int = 100_000):
    """k-means of the vectors of each label with k = floor(sqrt(n)), 2 to 50, as the best of ``starts`` seeded starts; labels of more than ``task_rows`` rows are clustered across tasks."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("x"))
    big = {r["label"]: r["n"] for r in v.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > task_rows).collect()}

    def run(pdf):
        pdf = pdf.sort_values("vec_id")
        x = np.stack(pdf["x"].to_numpy())
        pdf["cluster"] = stats.kmeans(x, max(2, min(50, math.isqrt(len(x)))), starts) if len(x) > 1 else 0
        return pdf[["label", "vec_id", "cluster"]]

    small = v
    for label in big:
        small = small.filter(~F.col("label").eqNullSafe(F.lit(label)))
    out = small.groupBy("label").applyInPandas(run, f"label {dict(v.dtypes)['label']}, vec_id long, cluster int")
    for label, n in big.items():
        mine = v.filter(F.col("label").eqNullSafe(F.lit(label))).select("label", "vec_id", array_to_vector("x").alias("features"))
        models = [KMeans(k=max(2, min(50, math.isqrt(n))), seed=s, maxIter=300).fit(mine) for s in range(1, starts + 1)]
        best = min(models, key=lambda m: m.summary.trainingCost)
        out = out.unionByName(best.transform(mine).select("label", "vec_id", F.col("prediction").alias("cluster")))
    return out


# ---- statistics

@query("""
WITH p AS (SELECT n_name AS family, row_number() OVER (ORDER BY n_nationkey) AS k, ((n_nationkey * 37) % 100 + 1) / 1000.0 AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p, family) AS rk, count(*) OVER () AS n FROM p)
SELECT family, round(least(1, min(p * n / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 9)::DOUBLE AS bh,
 round(least(1, min(p * n / rk * (SELECT sum(1.0 / i) FROM range(1, 26) t(i))) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 9)::DOUBLE AS by_, round(least(1, p * n), 9)::DOUBLE AS bonferroni FROM r""")
def e9_corrections(spark, d):
    p = table(spark, d, "nation").select(F.col("n_name").alias("family"), F.lit(0).alias("g"), (((F.col("n_nationkey") * 37) % 100 + 1) / 1000.0).alias("p"))
    out = stats.adjusted(p, ["g"], "p", "family", "bh").withColumnRenamed("p_adj", "bh")
    out = stats.adjusted(out, ["g"], "p", "family", "by").withColumnRenamed("p_adj", "by_")
    out = stats.adjusted(out, ["g"], "p", "family", "bonferroni").withColumnRenamed("p_adj", "bonferroni")
    return out.select("family", F.round("bh", 9).alias("bh"), F.round("by_", 9).alias("by_"), F.round("bonferroni", 9).alias("bonferroni"))


@query("""
WITH a AS (SELECT count(*) FILTER (WHERE l_returnflag = 'A') AS n0, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS m0, var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS v0,
 count(*) FILTER (WHERE l_returnflag = 'R') AS n1, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS m1, var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS v1 FROM lineitem),
d AS (SELECT *, (m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) AS d FROM a)
SELECT n0, n1, round(d, 9) AS cohens_d, round(d * (1 - 3.0 / (4 * (n0 + n1) - 9)), 9) AS hedges_g, round((m1 - m0) / sqrt(v0), 9) AS glass_delta, round((m1 - m0) / sqrt(v0 / n0 + v1 / n1), 6) AS welch_t,
 round((v0 / n0 + v1 / n1) * (v0 / n0 + v1 / n1) / ((v0 / n0) * (v0 / n0) / (n0 - 1) + (v1 / n1) * (v1 / n1) / (n1 - 1)), 3) AS welch_df, CASE WHEN abs(d) < 0.1 THEN 'negligible' WHEN abs(d) < 0.2 THEN 'very_small' ELSE 'more' END AS band FROM d""")
def l7_effect_sizes(spark, d):
    x = table(spark, d, "lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    e = stats.effect_sizes(x, "l_extendedprice", F.col("l_returnflag") == "R")
    return e.select("n0", "n1", F.round("cohens_d", 9).alias("cohens_d"), F.round("hedges_g", 9).alias("hedges_g"), F.round("glass_delta", 9).alias("glass_delta"), F.round("welch_t", 6).alias("welch_t"), F.round("welch_df", 3).alias("welch_df"), "band")


@query("""
WITH v AS (SELECT l_quantity AS v, count(*) FILTER (WHERE l_returnflag = 'R') AS t, count(*) FILTER (WHERE l_returnflag = 'A') AS c FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1),
r AS (SELECT *, sum(c) OVER (ORDER BY v) - c AS below FROM v)
SELECT CAST(sum(c) AS BIGINT) AS n0, CAST(sum(t) AS BIGINT) AS n1, round(CAST((2 * sum(t * below) + sum(t * c) - sum(t) * sum(c)) AS DOUBLE) / (sum(t) * sum(c)), 9) AS delta FROM r""")
def l8_cliffs_delta(spark, d):
    x = table(spark, d, "lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    return stats.cliffs_delta(x, "l_quantity", F.col("l_returnflag") == "R").withColumn("delta", F.round("delta", 9))


@query()
def l2_bootstrap_bca(spark, d):
    return stats.bootstrap_bca(_paired(spark, d).select((F.col("b") - F.col("a")).alias("diff")), "diff")


@query("""
WITH m AS (SELECT pack_id, avg(total_tokens) FILTER (WHERE variant_id = 'v0c_bm25_baseline') AS a, avg(total_tokens) FILTER (WHERE variant_id = 'coverage_enhanced') AS b FROM selection_results GROUP BY 1),
x AS (SELECT pack_id, b - a AS x FROM m WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT pack_id, round(((SELECT sum(x) FROM x) - x) / ((SELECT count(*) FROM x) - 1), 6) AS without FROM x""")
def l4_jackknife(spark, d):
    x = _paired(spark, d).select("pack_id", (F.col("b") - F.col("a")).alias("x"))
    return x.crossJoin(x.agg(F.sum("x").alias("s"), F.count("*").alias("n"))).select("pack_id", F.round((F.col("s") - F.col("x")) / (F.col("n") - 1), 6).alias("without"))


@query("""
WITH s AS (SELECT pack_id, variant_id, unnest(map_entries(selection_scores)) AS e FROM (SELECT pack_id, variant_id, arg_max(selection_scores, run_id) AS selection_scores FROM selection_results GROUP BY ALL)),
r AS (SELECT pack_id, variant_id, e.key AS item, least(4, greatest(0, CAST(floor(4 * e.value / m) AS INT))) AS bin FROM (SELECT *, max(e.value) OVER (PARTITION BY pack_id, variant_id) AS m FROM s WHERE e.value IS NOT NULL AND NOT isnan(e.value) AND e.value > 0)),
p AS (SELECT a.bin AS a, b.bin AS b FROM r a JOIN r b ON a.pack_id = b.pack_id AND a.item = b.item AND a.variant_id = 'v0c_bm25_baseline' AND b.variant_id = 'coverage_enhanced'),
o AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS po FROM p), ra AS (SELECT a, count(*) AS c FROM p GROUP BY 1), rb AS (SELECT b, count(*) AS c FROM p GROUP BY 1),
e AS (SELECT sum(ra.c * rb.c) AS e FROM ra JOIN rb ON ra.a = rb.b)
SELECT n, round(po, 9)::DOUBLE AS observed, round(e / (n * n), 9)::DOUBLE AS expected, round((po - e / (n * n)) / (1 - e / (n * n)), 9)::DOUBLE AS kappa FROM o, e""")
def d14_kappa(spark, d):
    return stats.kappa(_bins(spark, d)).select("n", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])


def _bins(spark, d):
    r = _ratings(spark, d).filter("value > 0")
    top = r.groupBy("pack_id", "variant_id").agg(F.max("value").alias("m"))
    b = r.join(top, ["pack_id", "variant_id"]).select("pack_id", "variant_id", "item", F.least(F.lit(4), F.greatest(F.lit(0), F.floor(4 * F.col("value") / F.col("m")).cast("int"))).alias("bin"))
    x, y = b.filter("variant_id = 'v0c_bm25_baseline'"), b.filter("variant_id = 'coverage_enhanced'")
    return x.select("pack_id", "item", F.col("bin").alias("a")).join(y.select("pack_id", "item", F.col("bin").alias("b")), ["pack_id", "item"]).select("a", "b")


@query("""
WITH g AS (SELECT user_id AS item, event_type AS category, count(*) AS c FROM events GROUP BY 1, 2), i AS (SELECT item, sum(c) AS n, sum(c * c) AS sq FROM g GROUP BY 1 HAVING sum(c) > 1),
cat AS (SELECT category, sum(c) AS t FROM g WHERE item IN (SELECT item FROM i) GROUP BY 1), pe AS (SELECT sum(power(t / (SELECT sum(t) FROM cat), 2)) AS pe FROM cat)
SELECT count(*) AS items, round(avg((sq - n) / (n * (n - 1))), 9) AS agreement, round(max(pe), 9) AS expected, round((avg((sq - n) / (n * (n - 1))) - max(pe)) / (1 - max(pe)), 9) AS kappa FROM i, pe""")
def d15_fleiss(spark, d):
    f = stats.fleiss(table(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("category")))
    return f.select("items", *[F.round(c, 9).alias(c) for c in ("agreement", "expected", "kappa")])


# ---- gates

@query("""
WITH m AS (SELECT variant_id, avg(CASE WHEN coverage_score BETWEEN 0 AND 1 THEN coverage_score END) AS coverage, avg(CASE WHEN diversity_score BETWEEN 0 AND 1 THEN diversity_score END) AS diversity,
  avg(CASE WHEN budget_utilization <= 1.05 THEN 1.0 ELSE 0 END) AS within FROM selection_results GROUP BY 1),
g AS (SELECT variant_id, unnest([coverage, diversity, within]) AS value, unnest(['coverage', 'diversity', 'within']) AS metric FROM m), t(metric, threshold, weight, critical) AS (VALUES ('coverage', 0.5, 0.4, false), ('diversity', 0.5, 0.2, false), ('within', 0.8, 0.4, true))
SELECT variant_id, round(sum(CASE WHEN coalesce(value, 0) >= threshold THEN weight ELSE weight * (1 - least(1, abs(coalesce(value, 0) - threshold) / threshold)) END) / sum(weight), 6)::DOUBLE AS score,
 CASE WHEN bool_and(coalesce(value, 0) >= threshold) THEN 'PROMOTE' WHEN bool_and(coalesce(value, 0) >= threshold OR NOT critical) THEN 'MANUAL_REVIEW' ELSE 'BLOCK' END AS decision FROM g JOIN t USING (metric) GROUP BY 1""")
def o7_gates(spark, d):
    s = table(spark, d, "selection_results")
    ok = lambda c: F.avg(F.when(F.col(c).between(0, 1), F.col(c)))
    m = s.groupBy("variant_id").agg(ok("coverage_score").alias("coverage"), ok("diversity_score").alias("diversity"), F.avg(F.when(F.col("budget_utilization") <= 1.05, 1.0).otherwise(0.0)).alias("within"))
    g = m.select("variant_id", F.explode(F.create_map(*[x for c in ("coverage", "diversity", "within") for x in (F.lit(c), F.col(c))])).alias("metric", "value"))
    t = spark.createDataFrame([("coverage", 0.5, 0.4, False), ("diversity", 0.5, 0.2, False), ("within", 0.8, 0.4, True)], "metric string, threshold double, weight double, critical boolean")
    v = F.coalesce("value", F.lit(0.0))
    passed = v >= F.col("threshold")
    near = F.col("weight") * (1 - F.least(F.lit(1.0), F.abs(v - F.col("threshold")) / F.col("threshold")))
    score = F.sum(F.when(passed, F.col("weight")).otherwise(near)) / F.sum("weight")
    decision = F.when(F.bool_and(passed), "PROMOTE").when(F.bool_and(passed | ~F.col("critical")), "MANUAL_REVIEW").otherwise("BLOCK")
    return g.join(t, "metric").groupBy("variant_id").agg(F.round(score, 6).alias("score"), decision.alias("decision"))


@query("""
SELECT run_id, array_to_string(list_filter([CASE WHEN total_tokens IS NULL OR total_tokens < 0 THEN 'tokens' END, CASE WHEN coverage_score IS NULL OR isnan(coverage_score) OR coverage_score NOT BETWEEN 0 AND 1 THEN 'coverage' END,
 CASE WHEN diversity_score IS NULL OR isnan(diversity_score) OR diversity_score NOT BETWEEN 0 AND 1 THEN 'diversity' END, CASE WHEN cardinality(chunk_modes) = 0 THEN 'empty' END], lambda x: x IS NOT NULL), ',') AS failed FROM selection_results""")
def o2_selection_oracle(spark, d):
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | ~F.col(c).between(0, 1)
    rules = [(F.col("total_tokens").isNull() | (F.col("total_tokens") < 0), "tokens"), (bad("coverage_score"), "coverage"), (bad("diversity_score"), "diversity"), (F.size("chunk_modes") == 0, "empty")]
    return table(spark, d, "selection_results").select("run_id", F.array_join(F.array(*[F.when(c, F.lit(n)) for c, n in rules]), ",").alias("failed"))


@query("""
SELECT item_id, unnest(list_filter([CASE WHEN question IS NULL OR length(trim(question)) < 10 THEN 'short_question' END, CASE WHEN gold.answer_text IS NULL THEN 'no_answer' END,
 CASE WHEN category IS NULL THEN 'no_category' END, CASE WHEN gold.confidence_score IS NULL OR gold.confidence_score < 0.7 THEN 'low_confidence' END], lambda x: x IS NOT NULL)) AS issue FROM qa_items""")
def o9_dataset_issues(spark, d):
    rules = [
        (F.col("question").isNull() | (F.length(F.trim("question")) < 10), "short_question"), (F.col("gold.answer_text").isNull(), "no_answer"), (F.col("category").isNull(), "no_category"),
        (F.col("gold.confidence_score").isNull() | (F.col("gold.confidence_score") < 0.7), "low_confidence"),
    ]
    return table(spark, d, "qa_items").select("item_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))).alias("issue"))


@query("""
WITH q AS (SELECT item_id, lower(difficulty) AS k, row_number() OVER (PARTITION BY lower(difficulty) ORDER BY md5(CAST(item_id AS VARCHAR))) AS rn FROM qa_items), t(k, n) AS (VALUES ('easy', 20), ('medium', 50), ('hard', 30))
SELECT item_id, q.k AS difficulty FROM q JOIN t ON q.k = t.k WHERE rn <= n""")
def o10_balanced_sample(spark, d):
    """A sample of 100 questions in the target shares; the draw per stratum is by hash."""
    q = table(spark, d, "qa_items").select("item_id", F.lower("difficulty").alias("difficulty"), F.md5(F.col("item_id").cast("string")).alias("h"))
    r = position(q, ["difficulty"], [F.col("h"), F.col("item_id")])
    t = spark.createDataFrame([("easy", 20), ("medium", 50), ("hard", 30)], "difficulty string, n int")
    return r.join(t, "difficulty").filter("rank <= n").select("item_id", "difficulty")


@query("""SELECT CAST(count(*) AS BIGINT) AS n, count(DISTINCT row_id) AS ids, CAST(sum(start_line) AS BIGINT) AS lines FROM chunks""")
def o15_checksum(spark, d):
    return table(spark, d, "chunks").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("ids"), F.sum("start_line").alias("lines"))


@query("""SELECT variant_id, date_trunc('month', created_at)::TIMESTAMP AS month, count(*) AS runs, CAST(sum(iterations) AS BIGINT) AS iterations FROM selection_results GROUP BY 1, 2""")
def o16_timeline(spark, d):
    month = F.date_trunc("month", F.col("created_at").cast("timestamp")).cast("timestamp_ntz")
    return table(spark, d, "selection_results").groupBy("variant_id", month.alias("month")).agg(F.count("*").alias("runs"), F.sum("iterations").alias("iterations"))
