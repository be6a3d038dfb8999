"""Imports, links and tests resolved to files, similarity and cluster queries, chunking, repository profiles (survey groups A4, A10, C, D1, D4, D5, D22, D26, D29, D32, G5, K, N7)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hewn.functions import paths, text
from hewn.operators.neighbours import densest, within
from hewn.plans.analysis import EDGES_SQL, _graph
from hewn.plans.kernels import _CLUSTERS, VECTORS_SQL, clusters, mean_vector, unit_vectors
from hewn.plans.registry import query
from hewn.plans.scan import FILES_SQL, files
from hewn.session import cut
from hewn.sources.tables import table

TOK = text.CHUNK_TOKENS_SQL
IMPORT = r"(?m)^\s*(?:from\s+([A-Za-z_][A-Za-z0-9_.]*)\s+import|import\s+([A-Za-z_][A-Za-z0-9_.]*)|use\s+([A-Za-z_][A-Za-z0-9_:]*))"
_FOUND = f"""list_distinct(list_concat(list_concat(regexp_extract_all(content, '{IMPORT}', 1), regexp_extract_all(content, '{IMPORT}', 2)), regexp_extract_all(content, '{IMPORT}', 3)))"""
IMPORTS_SQL = f"imports AS (SELECT DISTINCT file_id AS src, unnest(list_filter({_FOUND}, lambda x: x <> '')) AS import FROM chunks WHERE lower(kind) = 'import' AND content IS NOT NULL)"


def imports(spark, d):
    """(src, import): the dotted names that a file's import chunks name."""
    one = lambda k: F.regexp_extract_all("content", F.lit(IMPORT), F.lit(k))
    c = table(spark, d, "chunks").filter("lower(kind) = 'import' and content is not null")
    return c.select(F.col("file_id").alias("src"), F.explode(F.filter(F.array_distinct(F.concat(one(1), one(2), one(3))), lambda x: x != "")).alias("import")).distinct()


# ---- imports

_LAST = "list_extract(string_split_regex(import, '[.:]+'), -1)"


@query(f"""WITH {IMPORTS_SQL}, f AS ({FILES_SQL}), i AS (SELECT src, import, lower({_LAST}) AS last, lower(regexp_replace(import, '[.:]+', '/', 'g')) AS joined FROM imports),
m AS (SELECT src, import, f.file_id AS dst FROM i JOIN f ON (contains(lower(f.path), last) OR contains(lower(f.path), joined)) AND f.file_id <> src)
SELECT src, import, dst FROM m QUALIFY row_number() OVER (PARTITION BY src, import ORDER BY dst) <= 5""")
def c1_import_resolution(spark, d):
    """Imports resolved to the first five files whose path holds the last part or the joined path, as a substring.

    Substrings need no scan of all pairs: a needle of three letters or more shares its first trigram with
    the path, and different names are looked up once for all their importers. Shorter needles meet the
    paths' pairs of letters or letters.
    """
    return _first_five(imports(spark, d), files(spark, d))


def _grams(s, n: int):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: s.substr(i, F.lit(n))))


def _needles(names):
    """The columns of ``names`` with each different needle of its ``import``: the last part and the joined path, in lower case."""
    last = F.lower(F.element_at(F.split("import", "[.:]+"), -1))
    both = F.array_distinct(F.array(last, F.lower(F.regexp_replace("import", "[.:]+", "/"))))
    return names.select("*", F.explode(both).alias("needle")).filter("needle <> ''")


def _hits(needles, f):
    """(needle, dst): files whose lower-case path contains a needle.

    Of a needle's trigrams the one in the fewest paths is looked up, a shorter needle as a whole. Letters that
    no needle is looked up by stay out of the join, by 65,536 places of their hashes.
    """
    needles = needles.select("needle").distinct()
    low = F.col("low")
    paths_ = cut(f.select(F.col("file_id").alias("dst"), F.lower("path").alias("low")))
    p = paths_.select("dst", "low", F.explode(F.array_distinct(F.concat(_grams(low, 1), _grams(low, 2), _grams(low, 3)))).alias("gram"))
    of = needles.select("needle", F.explode(_grams(F.col("needle"), 3)).alias("gram"))
    keyed = of.join(p.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    keyed = cut(keyed)
    place = F.pmod(F.xxhash64("gram"), F.lit(65_536))
    p = p.withColumn("place", place).join(F.broadcast(keyed.select(place.alias("place")).distinct()), "place", "left_semi").drop("place")
    return keyed.join(p, "gram").filter(F.contains("low", F.col("needle"))).select("needle", "dst")


def _substring_matches(names, f):
    """(import, dst): files whose lower-case path contains the last part or the joined path of a name."""
    needles = _needles(names.select("import"))
    return needles.join(_hits(needles, f), "needle").select("import", "dst").distinct()


def _first_five(found, f, k: int = 5):
    names = found.select("import").distinct()
    hits = _substring_matches(names, f)
    # k + 1 first files of a name serve all its importers, one of which may be the importer itself
    first = hits.withColumn("n", F.row_number().over(Window.partitionBy("import").orderBy("dst"))).filter(F.col("n") <= k + 1).drop("n")
    rank = Window.partitionBy("src", "import").orderBy("dst")
    return found.join(first, "import").filter("src <> dst").withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= k).select("src", "import", "dst")


@query(f"""WITH {IMPORTS_SQL}, f AS ({FILES_SQL}) SELECT DISTINCT src, f.file_id AS dst FROM imports JOIN f ON f.file_id <> src AND (contains(lower(f.path), lower({_LAST})) OR contains(lower(f.path), lower(regexp_replace(import, '[.:]+', '/', 'g'))))""")
def c2_import_matches(spark, d):
    """Every pair of a file and a file that one of its imports matches by substring. The pairs grow as the square of the table."""
    return _matched_pairs(imports(spark, d), files(spark, d))


#: Pairs that a task of the join and a part of a needle should make, files in a row, and the most parts of a needle.
_TASK_PAIRS, _PART_PAIRS, _ROW_FILES, _PARTS = 50_000_000, 16_000_000, 4096, 64


def _matched_pairs(found, f):
    """(src, dst) once for each file and other file that one of its needles hits; no pair is written or shuffled.

    Files that the same needles hit are one row with their list. A pair comes from the first needle that
    both sides share, so the list is left out where an earlier needle of the source hits those files too.
    """
    spark = found.sparkSession
    needles = cut(_needles(found).select("src", "needle").distinct())
    hits = cut(_hits(needles, f))
    ids = cut(hits.select("needle").distinct().withColumn("id", F.monotonically_increasing_id()))
    mine = needles.join(ids, "needle").groupBy("src").agg(F.array_sort(F.collect_list("id")).alias("mine"))
    mine = cut(mine.select("src", F.posexplode("mine").alias("k", "id"), "mine").select("src", "id", F.slice("mine", F.lit(1), F.col("k")).alias("before")))
    like = cut(hits.join(ids, "needle").groupBy("dst").agg(F.array_sort(F.collect_list("id")).alias("all")))
    rows = like.groupBy("all").agg(F.ceil(F.count("*") / _ROW_FILES).alias("rows"))
    files_ = like.join(rows, "all").groupBy("all", F.pmod(F.xxhash64("dst"), "rows").alias("row")).agg(F.array_sort(F.collect_list("dst")).alias("dsts"))
    files_ = cut(files_.select("dsts", F.posexplode("all").alias("k", "id"), "all").select("id", F.slice("all", F.lit(1), F.col("k")).alias("earlier"), "dsts"))
    n = mine.groupBy("id").agg(F.count("*").alias("srcs")).join(files_.groupBy("id").agg(F.sum(F.size("dsts")).alias("files")), "id").withColumn("pairs", F.col("srcs") * F.col("files"))
    n = cut(n.select("id", "pairs", F.least(F.ceil(F.col("pairs") / _PART_PAIRS), F.lit(_PARTS)).alias("parts")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, (n.agg(F.sum("pairs")).first()[0] or 0) // _TASK_PAIRS))
    n = n.drop("pairs")
    left = mine.join(n, "id").withColumn("part", F.pmod(F.xxhash64("src"), "parts")).drop("parts").repartition(tasks, "id", "part")
    right = files_.join(n, "id").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts").repartition(tasks, "id", "part")
    both = left.join(right, ["id", "part"]).filter(~F.arrays_overlap("before", "earlier"))
    return both.select("src", F.explode("dsts").alias("dst")).filter("src <> dst")


_PATH = "regexp_replace(lower(path), '^\\./', '')"


@query(f"""WITH {IMPORTS_SQL}, f AS ({FILES_SQL}), p AS (SELECT {_PATH} AS low, min(file_id) AS dst FROM f GROUP BY 1), own AS (SELECT file_id AS src, {_PATH} AS low, regexp_replace({_PATH}, '/?[^/]*$', '') AS dir, regexp_extract(lower(path), '\\.([a-z]+)$', 1) AS ext FROM f),
i AS (SELECT src, import, lower(regexp_replace(import, '[.:]+', '/', 'g')) AS m, dir, ext FROM imports JOIN own USING (src)),
k AS (SELECT src, import, unnest(CASE WHEN ext = 'py' THEN [{{'o': 1, 'c': m || '.py'}}, {{'o': 2, 'c': m || '/__init__.py'}}, {{'o': 3, 'c': dir || '/' || m || '.py'}}, {{'o': 4, 'c': dir || '/' || m || '/__init__.py'}}]
 WHEN ext IN ('js', 'ts', 'jsx', 'tsx') THEN [{{'o': 1, 'c': dir || '/' || m || '.js'}}, {{'o': 2, 'c': dir || '/' || m || '.ts'}}, {{'o': 3, 'c': dir || '/' || m || '.jsx'}}, {{'o': 4, 'c': dir || '/' || m || '.tsx'}}, {{'o': 5, 'c': dir || '/' || m || '/index.js'}}, {{'o': 6, 'c': dir || '/' || m || '/index.ts'}}] ELSE [] END) AS x FROM i),
e AS (SELECT src, import, arg_min(dst, x.o) AS dst, 'exact' AS how FROM k JOIN p ON p.low = x.c WHERE dst <> src GROUP BY 1, 2),
st AS (SELECT regexp_extract(low, '([^/]*?)(\\.[^/.]*)?$', 1) AS stem, min(dst) AS dst FROM p GROUP BY 1),
s AS (SELECT i.src, i.import, st.dst, 'stem' AS how FROM i JOIN st ON st.stem = regexp_extract(m, '([^/]*)$', 1) WHERE st.dst <> i.src AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = i.src AND e.import = i.import))
SELECT * FROM e UNION ALL SELECT * FROM s""")
def c3_typed_resolution(spark, d):
    """Imports by the rules of their language: exact candidate paths in order, else the first file with that stem."""
    f = files(spark, d)
    low = F.regexp_replace(F.lower("path"), r"^\./", "")
    p = f.groupBy(low.alias("low")).agg(F.min("file_id").alias("dst"))
    own = f.select(F.col("file_id").alias("src"), F.regexp_replace(low, r"/?[^/]*$", "").alias("dir"), F.regexp_extract(F.lower("path"), r"\.([a-z]+)$", 1).alias("ext"))
    i = imports(spark, d).join(own, "src").withColumn("m", F.lower(F.regexp_replace("import", "[.:]+", "/")))
    near = F.concat("dir", F.lit("/"), "m")
    python = F.array(*[F.concat(a, F.lit(b)) for a in (F.col("m"), near) for b in (".py", "/__init__.py")])
    js = F.array(*[F.concat(near, F.lit(b)) for b in (".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts")])
    k = i.select("src", "import", F.posexplode(F.when(F.col("ext") == "py", python).when(F.col("ext").isin("js", "ts", "jsx", "tsx"), js)).alias("o", "low"))
    e = k.join(p, "low").filter("dst <> src").groupBy("src", "import").agg(F.min_by("dst", "o").alias("dst")).withColumn("how", F.lit("exact"))
    stems = p.groupBy(F.regexp_extract("low", r"([^/]*?)(\.[^/.]*)?$", 1).alias("stem")).agg(F.min("dst").alias("dst"))
    s = i.withColumn("stem", F.regexp_extract("m", r"([^/]*)$", 1)).join(stems, "stem").filter("dst <> src").join(e.select("src", "import"), ["src", "import"], "left_anti")
    return e.unionByName(s.select("src", "import", "dst", F.lit("stem").alias("how")))


_LINK = r"\[[^\]]*\]\(([^)\s]+)\)"


@query(f"""WITH l AS (SELECT doc_id, doc_kind, repo_name, unnest(regexp_extract_all(text, '\\[[^\\]]*\\]\\(([^)\\s]+)\\)', 1)) AS url FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, repo_name, url, regexp_replace(regexp_replace(regexp_replace(url, '[#?].*$', ''), '%20', ' ', 'g'), '^(\\./|/)', '') AS target FROM l WHERE NOT regexp_matches(url, '^(https?|ftp)://|^mailto:|^#')),
g AS (SELECT repo_name, path, min(file_id) AS file_id FROM git_files GROUP BY 1, 2), c AS (SELECT k.doc_id, count(*) AS links, count(g.file_id) AS resolved FROM k LEFT JOIN g ON g.repo_name = k.repo_name AND g.path = k.target WHERE target <> '' GROUP BY 1)
SELECT * FROM c""")
def c5_link_resolution(spark, d):
    """Relative Markdown links of each document, and how many lead to a file of its repository; fragments, queries and outside addresses are left out."""
    l = table(spark, d, "documents").filter("text is not null").select("doc_id", "repo_name", F.explode(F.regexp_extract_all("text", F.lit(_LINK), F.lit(1))).alias("url"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"[#?].*$", ""), "%20", " "), r"^(\./|/)", "")
    k = l.filter(~F.col("url").rlike(r"^(https?|ftp)://|^mailto:|^#")).select("doc_id", "repo_name", clean.alias("target")).filter("target <> ''")
    g = table(spark, d, "git_files").groupBy("repo_name", F.col("path").alias("target")).agg(F.min("file_id").alias("file_id"))
    return k.join(g, ["repo_name", "target"], "left").groupBy("doc_id").agg(F.count("*").alias("links"), F.count("file_id").alias("resolved"))


@query(f"""WITH f AS ({FILES_SQL}), s AS (SELECT file_id, repo_name, regexp_extract(lower(path), '([^/]*?)(\\.[^/.]*)?$', 1) AS stem, regexp_matches(lower(path), '(^|/)test_|_test\\.|\\.test\\.|\\.spec\\.|(^|/)tests?/') AS is_test FROM f),
t AS (SELECT file_id AS test, repo_name, regexp_replace(stem, '^test_|_test$|\\.test$|\\.spec$', '', 'g') AS stem FROM s WHERE is_test)
SELECT t.test, count(s.file_id) AS code FROM t LEFT JOIN s ON s.repo_name = t.repo_name AND NOT s.is_test AND length(s.stem) >= 3 AND length(t.stem) >= 3 AND (contains(s.stem, t.stem) OR contains(t.stem, s.stem)) GROUP BY 1""")
def c6_test_links(spark, d):
    """How many code files of its repository a test belongs to: one stem holds the other (of three letters or more). Stems that hold each other share a trigram of the shorter one's start."""
    low = F.lower("path")
    s = files(spark, d).select("file_id", "repo_name", F.regexp_extract(low, r"([^/]*?)(\.[^/.]*)?$", 1).alias("stem"), low.rlike(r"(^|/)test_|_test\.|\.test\.|\.spec\.|(^|/)tests?/").alias("is_test"))
    t = s.filter("is_test").select(F.col("file_id").alias("test"), "repo_name", F.regexp_replace("stem", r"^test_|_test$|\.test$|\.spec$", "").alias("t"))
    code = s.filter("not is_test and length(stem) >= 3").select("file_id", "repo_name", F.col("stem").alias("c"))
    head = lambda x: F.array(F.substring(x, 1, 3))
    a = t.filter("length(t) >= 3").withColumn("g", F.explode(_grams(F.col("t"), 3))).join(code.withColumn("g", F.explode(head("c"))), ["repo_name", "g"]).filter(F.contains("t", F.col("c")))
    b = t.filter("length(t) >= 3").withColumn("g", F.explode(head("t"))).join(code.withColumn("g", F.explode(_grams(F.col("c"), 3))), ["repo_name", "g"]).filter(F.contains("c", F.col("t")))
    hits = a.select("test", "file_id").unionByName(b.select("test", "file_id")).distinct()
    return t.select("test").join(hits, "test", "left").groupBy("test").agg(F.count("file_id").alias("code"))


@query(f"""WITH {IMPORTS_SQL}, f AS ({FILES_SQL}), st AS (SELECT DISTINCT regexp_extract(lower(path), '([^/]*?)(\\.[^/.]*)?$', 1) AS stem, file_id FROM f), i AS (SELECT DISTINCT src, lower({_LAST}) AS name FROM imports),
m AS (SELECT src, name, file_id AS dst, CASE WHEN stem = name THEN 1 WHEN contains(stem, name) THEN 2 ELSE 3 END AS how FROM i JOIN st ON length(stem) >= 3 AND length(name) >= 3 AND (contains(stem, name) OR contains(name, stem)) AND file_id <> src)
SELECT src, name, arg_min(dst, how * 1000000000000 + dst) AS dst, CAST(min(how) AS BIGINT) AS how FROM m GROUP BY 1, 2""")
def c20_stem_lookup(spark, d):
    """The file for the last part of an import: an equal stem, else one that holds it, else one that it holds; of several the first."""
    st = files(spark, d).select(F.col("file_id").alias("dst"), F.regexp_extract(F.lower("path"), r"([^/]*?)(\.[^/.]*)?$", 1).alias("stem")).filter("length(stem) >= 3")
    i = imports(spark, d).select("src", F.lower(F.element_at(F.split("import", "[.:]+"), -1)).alias("name")).distinct().filter("length(name) >= 3")
    names = i.select("name").distinct()
    head = lambda x: F.substring(x, 1, 3)
    a = names.withColumn("g", head("name")).join(st.withColumn("g", F.explode(_grams(F.col("stem"), 3))), "g").filter(F.contains("stem", F.col("name")))
    b = names.withColumn("g", F.explode(_grams(F.col("name"), 3))).join(st.withColumn("g", head("stem")), "g").filter(F.contains("name", F.col("stem")))
    hits = a.select("name", "dst", "stem").unionByName(b.select("name", "dst", "stem")).distinct()
    how = F.when(F.col("stem") == F.col("name"), 1).when(F.contains("stem", F.col("name")), 2).otherwise(3)
    ranked = hits.select("name", "dst", how.cast("long").alias("how"))
    return i.join(ranked, "name").filter("src <> dst").groupBy("src", "name").agg(F.min_by("dst", F.struct("how", "dst")).alias("dst"), F.min("how").alias("how"))


# ---- similarity, clusters

@query(f"""WITH {VECTORS_SQL}, p AS (SELECT repo_name, row_id, u FROM chunks JOIN v ON v.chunk_id = chunks.id WHERE repo_name IS NOT NULL), n AS (SELECT repo_name, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 1)
SELECT repo_name, n, round((SELECT avg(list_dot_product(a.u, b.u)) FROM p a JOIN p b ON a.row_id < b.row_id AND a.repo_name = n.repo_name AND b.repo_name = n.repo_name), 6) AS mean_similarity FROM n""")
def c13_mean_similarity(spark, d):
    """The mean cosine over all pairs of a repository's chunks, from the length of the sum of their unit vectors: (|sum|^2 - n) / (n (n - 1)); no pair is made."""
    c = table(spark, d, "chunks").filter("repo_name is not null").select("repo_name", "row_id", F.col("id").alias("chunk_id")).join(unit_vectors(spark, d), "chunk_id")
    m = c.select("repo_name", F.posexplode("u").alias("i", "x")).groupBy("repo_name", "i").agg(F.sum("x").alias("s")).groupBy("repo_name").agg(F.sum(F.pow("s", F.lit(2))).alias("l2"))
    n = c.groupBy("repo_name").agg(F.count("*").alias("n"), F.sum(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)).alias("own")).filter("n > 1")
    return n.join(m, "repo_name").select("repo_name", "n", F.round((F.col("l2") - F.col("own")) / (F.col("n") * (F.col("n") - 1)), 6).alias("mean_similarity"))


@query(f"WITH {_CLUSTERS} SELECT near.chunk_id, cluster, members FROM near JOIN cm USING (cluster)")
def c18_cluster_membership(spark, d):
    """The cluster of each chunk with a vector, and how many members it has."""
    k = clusters(spark, d)
    return k.join(k.groupBy("cluster").agg(F.count("*").alias("members")), "cluster").select("chunk_id", "cluster", "members")


@query(f"""WITH {VECTORS_SQL}, p AS (SELECT file_id, u FROM (SELECT id, min(file_id) AS file_id FROM chunks WHERE id IS NOT NULL GROUP BY 1) c JOIN v ON v.chunk_id = c.id), m AS (SELECT file_id, count(*) AS n, [{", ".join(f"avg(u[{i}])" for i in range(1, 65))}] AS m FROM p GROUP BY 1)
SELECT file_id, n, list_transform(m, lambda x: round(x, 6)) AS centroid FROM m""")
def d4_file_centroids(spark, d):
    """The mean vector of each file."""
    c = table(spark, d, "chunks").filter("id is not null").groupBy(F.col("id").alias("chunk_id")).agg(F.min("file_id").alias("file_id"))
    p = c.join(unit_vectors(spark, d), "chunk_id")
    return mean_vector(p, "file_id", "u", "m").join(p.groupBy("file_id").agg(F.count("*").alias("n")), "file_id").select("file_id", "n", F.transform("m", lambda x: F.round(x, 6)).alias("centroid"))


@query(f"""WITH {_CLUSTERS}, f AS (SELECT cluster, c.file_id FROM near JOIN (SELECT id, min(file_id) AS file_id FROM chunks WHERE id IS NOT NULL GROUP BY 1) c ON c.id = near.chunk_id GROUP BY 1, 2), n AS (SELECT cluster, count(*) AS n FROM f GROUP BY 1)
SELECT a.cluster AS left_cluster, b.cluster AS right_cluster, count(*) AS common, round(count(*) * 1.0 / least(any_value(x.n), any_value(y.n)), 6)::DOUBLE AS overlap, count(*) > 0.3 * least(any_value(x.n), any_value(y.n)) AS merged
FROM f a JOIN f b ON a.file_id = b.file_id AND a.cluster < b.cluster JOIN n x ON x.cluster = a.cluster JOIN n y ON y.cluster = b.cluster GROUP BY 1, 2""")
def g5_cluster_overlap(spark, d):
    """Clusters that share files, with the share of the smaller one's files; they merge above three tenths. A file lies in at most as many clusters as there are kinds."""
    own = table(spark, d, "chunks").filter("id is not null").groupBy(F.col("id").alias("chunk_id")).agg(F.min("file_id").alias("file_id"))
    f = clusters(spark, d).join(own, "chunk_id").select("cluster", "file_id").distinct()
    n = f.groupBy("cluster").agg(F.count("*").alias("n"))
    a, b = f.select("file_id", F.col("cluster").alias("left_cluster")), f.select("file_id", F.col("cluster").alias("right_cluster"))
    j = a.join(b, "file_id").filter("left_cluster < right_cluster").groupBy("left_cluster", "right_cluster").agg(F.count("*").alias("common"))
    j = j.join(n.select(F.col("cluster").alias("left_cluster"), F.col("n").alias("x")), "left_cluster").join(n.select(F.col("cluster").alias("right_cluster"), F.col("n").alias("y")), "right_cluster")
    small = F.least("x", "y")
    return j.select("left_cluster", "right_cluster", "common", F.round(F.col("common") / small, 6).alias("overlap"), (F.col("common") > 0.3 * small).alias("merged"))


@query()
def k3_kmeans_global(spark, d):
    """k-means over all vectors of the most used model, k = root of their number, at most 100; seeded."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = unit_vectors(spark, d).select("chunk_id", array_to_vector("u").alias("features"))
    n = v.count()
    if n < 2:
        return v.select("chunk_id", F.lit(0).alias("cluster"))
    return KMeans(k=max(2, min(100, math.isqrt(n))), seed=1, maxIter=100).fit(v).transform(v).select("chunk_id", F.col("prediction").alias("cluster"))


_TAIL = f"""{_CLUSTERS}, cs AS (SELECT v.chunk_id, u, cluster, list_dot_product(u, p2) / sqrt(list_dot_product(p2, p2)) AS cover FROM v JOIN near USING (chunk_id) JOIN cm USING (cluster)), tail AS (SELECT chunk_id, u FROM cs WHERE round(cover, 6) < 0.5),
k AS (SELECT CAST(greatest(1, floor(sqrt((SELECT count(*) FROM v)) / 2)) AS BIGINT) AS k),
dens AS (SELECT chunk_id, round(1 / (1 + avg(1 - s)), 6) AS density FROM (SELECT t.chunk_id, round(list_dot_product(t.u, v.u), 6) AS s FROM tail t JOIN v ON v.chunk_id <> t.chunk_id QUALIFY row_number() OVER (PARTITION BY t.chunk_id ORDER BY round(list_dot_product(t.u, v.u), 6) DESC, v.chunk_id) <= 10) GROUP BY 1),
med AS (SELECT chunk_id AS medoid, density FROM dens QUALIFY row_number() OVER (ORDER BY density DESC, chunk_id) <= (SELECT k FROM k))"""


def _tail(k, least: float = 0.5):
    """Vectors of the clustered ``k`` whose cosine to their cluster's mean is under ``least``."""
    j = k.join(mean_vector(k, "cluster", "u", "p2"), "cluster")
    return j.withColumn("cover", F.round(text.cosine(F.col("u"), F.col("p2")), 6)).filter(F.col("cover") < least).select("chunk_id", "u")


def medoids(every, near: int = 10, tail=None):
    """(medoid, density, u) of the clustered vectors ``every``: the densest tail vectors, by the mean distance to their ten nearest; half the root of the number of vectors. Tail vectors are the stated queries against all."""
    v, t = every.select("chunk_id", "u"), cut(_tail(every)) if tail is None else tail
    k = max(1, int(math.sqrt(v.count()) / 2))
    vec = lambda df: df.select(F.col("chunk_id").alias("id"), F.col("u").alias("vec"))
    return densest(vec(t), vec(v), near, k).withColumnRenamed("id", "chunk_id").join(t, "chunk_id").select(F.col("chunk_id").alias("medoid"), "density", "u")


@query(f"WITH {_TAIL}, mem AS (SELECT medoid, count(*) AS members FROM med JOIN v m ON m.chunk_id = medoid JOIN v ON list_dot_product(m.u, v.u) >= 0.2 GROUP BY 1) SELECT medoid, density, members FROM med JOIN mem USING (medoid)")
def k4_medoids(spark, d):
    """Medoids of the vectors that their clusters cover badly, with the number of vectors within cosine distance .8. They are half the root of the number of vectors, so they are broadcast."""
    return _medoid_members(cut(clusters(spark, d)))


def _medoid_members(k, tail=None):
    m = cut(medoids(k, tail=tail))
    mem = within(m.select(F.col("medoid").alias("id"), F.col("u").alias("vec")), k.select(F.col("u").alias("vec")), 0.2)
    return m.join(mem, F.col("medoid") == F.col("id")).select("medoid", "density", "members")


@query(f"""WITH {_TAIL}, n AS (SELECT (SELECT count(*) FROM tail) >= 0.1 * (SELECT count(*) FROM v) AS mixed)
SELECT 'kmeans' AS source, cluster AS name, members FROM cm UNION ALL SELECT 'medoid', medoid, count(*) FROM med JOIN v m ON m.chunk_id = medoid JOIN v ON list_dot_product(m.u, v.u) >= 0.2, n WHERE mixed GROUP BY 2""")
def k5_mixed_centroids(spark, d):
    """Cluster means, and medoids beside them where a tenth of the vectors or more is in the tail."""
    k = cut(clusters(spark, d))
    means = k.groupBy(F.col("cluster").alias("name")).agg(F.count("*").alias("members")).select(F.lit("kmeans").alias("source"), "name", "members")
    t = cut(_tail(k))
    if t.count() < 0.1 * k.count() or k.isEmpty():
        return means
    return means.unionByName(_medoid_members(k, t).select(F.lit("medoid").alias("source"), F.col("medoid").alias("name"), "members"))


@query(f"""WITH {VECTORS_SQL}, c AS (SELECT id, min(repo_name) AS repo_name FROM chunks WHERE id IS NOT NULL GROUP BY 1), p AS (SELECT chunk_id, repo_name, u FROM v JOIN c ON c.id = v.chunk_id WHERE repo_name IS NOT NULL), r AS (SELECT repo_name, arg_min(u, chunk_id) AS q FROM p GROUP BY 1)
SELECT chunk_id, round(CASE WHEN list_dot_product(u, q) >= 0.7 THEN 1 ELSE list_dot_product(u, q) END, 6)::DOUBLE AS score FROM p JOIN r USING (repo_name)""")
def k6_semantic_score(spark, d):
    """Similarity of each chunk to the first of its repository: 1 from cosine .7 on, else the cosine."""
    c = table(spark, d, "chunks").filter("id is not null").groupBy(F.col("id").alias("chunk_id")).agg(F.min("repo_name").alias("repo_name")).filter("repo_name is not null")
    p = unit_vectors(spark, d).join(c, "chunk_id")
    r = p.groupBy("repo_name").agg(F.min_by("u", "chunk_id").alias("q"))
    s = F.aggregate(F.zip_with("u", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return p.join(r, "repo_name").select("chunk_id", F.round(F.when(s >= 0.7, 1.0).otherwise(s), 6).alias("score"))


@query("""WITH w AS (SELECT row_id, unnest(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS term FROM chunks WHERE content IS NOT NULL), h AS (SELECT row_id, CAST('0x' || substr(md5(term), 1, 2) AS INT) % 32 AS i, CASE WHEN CAST('0x' || substr(md5(term), 3, 1) AS INT) % 2 = 0 THEN 1 ELSE -1 END AS s FROM w),
x AS (SELECT row_id, i, sum(s) AS x FROM h GROUP BY 1, 2) SELECT row_id, count(*) AS dims, round(sqrt(sum(x * x)), 6)::DOUBLE AS norm, round(max(CASE WHEN i = 0 THEN x ELSE 0 END) / nullif(sqrt(sum(x * x)), 0), 6)::DOUBLE AS first FROM x WHERE x <> 0 GROUP BY 1""")
def k1_hashed_vectors(spark, d):
    """Vectors of 32 signed term counts, for chunks without a model: the provider that needs none. Given as number of dimensions in use, length and first value."""
    t = table(spark, d, "chunks").filter("content is not null").select("row_id", F.explode(F.filter(F.split(F.lower("content"), "[^a-z0-9]+"), lambda x: F.length(x) >= 2)).alias("term"))
    m = F.md5("term")
    number = lambda a, n: F.conv(F.substring(m, a, n), 16, 10).cast("int")
    x = t.groupBy("row_id", (number(1, 2) % 32).alias("i")).agg(F.sum(F.when(number(3, 1) % 2 == 0, 1).otherwise(-1)).alias("x")).filter("x <> 0")
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")))
    return x.groupBy("row_id").agg(F.count("*").alias("dims"), F.round(norm, 6).alias("norm"), F.round(F.max(F.when(F.col("i") == 0, F.col("x")).otherwise(0)) / norm, 6).alias("first"))


# ---- chunking

START = r"^(?:export\s+)?(?:async\s+)?(?:def|class|function|func|fn|pub fn|struct|impl|interface|enum|type)\s+([A-Za-z_][A-Za-z0-9_]*)"


@query(f"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE doc_kind IN ('source_file', 'readme', 'handbook') AND length(text) > 0),
s AS (SELECT doc_id, ls, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '{START}')) AS pos FROM l), b AS (SELECT doc_id, ls, CASE WHEN len(pos) = 0 OR pos[1] > 1 THEN list_prepend(1, pos) ELSE pos END AS pos FROM s),
e AS (SELECT doc_id, ls, pos, unnest(range(1, len(pos) + 1)) AS k FROM b)
SELECT doc_id, CAST(k - 1 AS BIGINT) AS chunk_no, CAST(pos[k] AS BIGINT) AS start_line, CAST(coalesce(pos[k + 1] - 1, len(ls)) AS BIGINT) AS end_line, CASE WHEN regexp_matches(ls[pos[k]], '{START}') THEN CASE WHEN regexp_matches(ls[pos[k]], '^(export\\s+)?(class|struct|impl|interface|enum|type)\\s') THEN 'class' ELSE 'function' END ELSE 'module_header' END AS kind,
 regexp_extract(ls[pos[k]], '{START}', 1) AS name FROM e""")
def n7_chunker(spark, d):
    """Documents cut into chunks at the lines where a function or class begins: the chunker as a table function, in the JVM, one row per chunk (also the chunk source A4)."""
    docs = table(spark, d, "documents").filter(F.col("doc_kind").isin("source_file", "readme", "handbook")).filter("length(text) > 0")
    ls = text.lines(F.col("text"))
    l = docs.select("doc_id", ls.alias("ls"))
    at = F.filter(F.sequence(F.lit(1), F.size("ls")), lambda i: F.element_at("ls", i).rlike(START))
    b = l.withColumn("at", at).withColumn("at", F.when((F.size("at") == 0) | (F.try_element_at("at", F.lit(1)) > 1), F.concat(F.array(F.lit(1)), "at")).otherwise(F.col("at")))
    e = b.select("doc_id", "ls", "at", F.posexplode("at").alias("k", "start"))
    line = F.element_at("ls", F.col("start"))
    kind = F.when(line.rlike(START), F.when(line.rlike(r"^(export\s+)?(class|struct|impl|interface|enum|type)\s"), "class").otherwise("function")).otherwise("module_header")
    end = F.coalesce(F.try_element_at("at", F.col("k") + 2) - 1, F.size("ls"))
    return e.select("doc_id", F.col("k").cast("long").alias("chunk_no"), F.col("start").cast("long").alias("start_line"), end.cast("long").alias("end_line"), kind.alias("kind"), F.regexp_extract(line, START, 1).alias("name"))


# ---- histories, profiles, quality

@query("""WITH log AS (SELECT file_id, path, 'author-' || (row_id % 7) AS author, snapshot_at, change_count, coalesce(lines_added, 0) || chr(9) || coalesce(lines_deleted, 0) || chr(9) || path AS line FROM git_files)
SELECT file_id, count(*) AS snapshots, max(snapshot_at) AS last_seen, count(DISTINCT author) AS authors, CAST(sum(CAST(string_split(line, chr(9))[1] AS BIGINT)) AS BIGINT) AS added, CAST(sum(CAST(string_split(line, chr(9))[2] AS BIGINT)) AS BIGINT) AS deleted FROM log GROUP BY 1""")
def d1_change_frequency(spark, d):
    """Per file: snapshots, last one, authors, and lines added and deleted, parsed from lines such as a history listing gives (A10); the listing is made from the snapshots, with author names by row."""
    from hewn.sources.files import numstat

    zero = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    g = table(spark, d, "git_files").select("file_id", "snapshot_at", F.concat(F.lit("author-"), (F.col("row_id") % 7).cast("string")).alias("author"), F.concat_ws("\t", zero("lines_added"), zero("lines_deleted"), F.coalesce("path", F.lit(""))).alias("line"))
    n = numstat(g, "line")
    return n.groupBy("file_id").agg(F.count("*").alias("snapshots"), F.max("snapshot_at").alias("last_seen"), F.countDistinct("author").alias("authors"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


@query(f"""WITH {EDGES_SQL}, o AS (SELECT src AS node, count(*) AS n FROM e0 GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n FROM e0 GROUP BY 1), k AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM e0) AS edges),
iso AS (SELECT count(*) AS isolated FROM nodes WHERE node NOT IN (SELECT node FROM o) AND node NOT IN (SELECT node FROM i))
SELECT nodes, edges, (SELECT max(n) FROM o) AS max_out, (SELECT max(n) FROM i) AS max_in, round(edges * 1.0 / nodes, 6)::DOUBLE AS avg_degree, round(edges * 1.0 / (nodes * (nodes - 1)), 9)::DOUBLE AS density, isolated, CAST(greatest(1, (nodes - isolated) // 3) + isolated AS BIGINT) AS components FROM k, iso""")
def d5_graph_stats(spark, d):
    """Nodes, edges, degrees, density, isolated nodes and the estimate of components: a third of the linked nodes, at least one, and the isolated ones."""
    n, e = _graph(spark, d)
    o, i = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o")), e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    j = n.join(o, "node", "left").join(i, "node", "left")
    a = j.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("o"), F.lit(0)).alias("edges"), F.max("o").alias("max_out"), F.max("i").alias("max_in"), F.count_if(F.col("o").isNull() & F.col("i").isNull()).alias("isolated"))
    nodes, edges = F.col("nodes"), F.col("edges")
    return a.select("nodes", "edges", "max_out", "max_in", F.round(edges / nodes, 6).alias("avg_degree"), F.round(edges / (nodes * (nodes - 1)), 9).alias("density"), "isolated", (F.greatest(F.lit(1), F.floor((nodes - F.col("isolated")) / 3)) + F.col("isolated")).cast("long").alias("components"))


@query("""WITH q AS (SELECT count(*) AS n, count(*) FILTER (WHERE total_tokens IS NULL) AS missing, count(*) - count(DISTINCT (pack_id, variant_id, config_id)) AS dups, count(*) FILTER (WHERE coverage_score BETWEEN 0 AND 1) AS ok, count(*) FILTER (WHERE coverage_score < 0 OR coverage_score > 1) AS out_of_range FROM selection_results)
SELECT n, missing, dups, out_of_range, round(0.4 * greatest(0, 100 - 5 * missing) + 0.3 * greatest(0, 100 - 10 * dups) + 0.3 * 100.0 * ok / n, 1)::DOUBLE AS score FROM q""")
def d22_data_quality(spark, d):
    """The quality score of the runs: missing values, repeated runs and values in range weigh .4, .3, .3."""
    s = table(spark, d, "selection_results")
    q = s.agg(F.count("*").alias("n"), F.count_if(F.col("total_tokens").isNull()).alias("missing"), (F.count("*") - F.countDistinct(F.struct("pack_id", "variant_id", "config_id"))).alias("dups"), F.count_if(F.col("coverage_score").between(0, 1)).alias("ok"), F.count_if((F.col("coverage_score") < 0) | (F.col("coverage_score") > 1)).alias("out_of_range"))
    score = 0.4 * F.greatest(F.lit(0), 100 - 5 * F.col("missing")) + 0.3 * F.greatest(F.lit(0), 100 - 10 * F.col("dups")) + 0.3 * 100.0 * F.col("ok") / F.col("n")
    return q.select("n", "missing", "dups", "out_of_range", F.round(score, 1).alias("score"))


@query(f"""WITH m AS (SELECT pack_id, run_id, variant_id, created_at, unnest(map_entries(chunk_modes)) AS e FROM selection_results), c AS (SELECT id, max({TOK}) AS full_t FROM chunks WHERE id IS NOT NULL GROUP BY 1),
l AS (SELECT pack_id, e.key AS id, e.value AS mode, variant_id, lag(e.value) OVER w AS p1, lag(e.value, 2) OVER w AS p2 FROM m WINDOW w AS (PARTITION BY pack_id, e.key ORDER BY created_at, run_id)),
d AS (SELECT l.*, full_t, p1 = 'full' AND mode <> 'full' AS demoted, mode = p2 AND mode <> p1 AS swing FROM l LEFT JOIN c USING (id))
SELECT variant_id, count(*) AS events, count(*) FILTER (WHERE demoted) AS demotions, count(*) FILTER (WHERE swing) AS oscillations, round(avg(CASE WHEN demoted THEN full_t - full_t // 10 END), 6)::DOUBLE AS mean_freed,
 CASE WHEN count(*) FILTER (WHERE swing) > 2 THEN 'high' WHEN count(*) FILTER (WHERE swing) > 0 THEN 'medium' ELSE 'low' END AS risk FROM d GROUP BY CUBE (variant_id)""")
def d26_demotion_analytics(spark, d):
    """Per variant and overall: modes of a pack's chunks over time, demotions from full, mean tokens freed, swings back to the mode before the last, and the risk that these show."""
    m = table(spark, d, "selection_results").select("pack_id", "run_id", "variant_id", "created_at", F.explode("chunk_modes").alias("id", "mode"))
    c = table(spark, d, "chunks").filter("id is not null").groupBy("id").agg(F.max(text.chunk_tokens()).alias("full_t"))
    w = Window.partitionBy("pack_id", "id").orderBy("created_at", "run_id")
    l = m.select("id", "mode", "variant_id", F.lag("mode").over(w).alias("p1"), F.lag("mode", 2).over(w).alias("p2")).join(c, "id", "left")
    demoted, swing = (F.col("p1") == "full") & (F.col("mode") != "full"), (F.col("mode") == F.col("p2")) & (F.col("mode") != F.col("p1"))
    n = F.count_if(swing)
    return l.cube("variant_id").agg(
        F.count("*").alias("events"), F.count_if(demoted).alias("demotions"), n.alias("oscillations"), F.round(F.avg(F.when(demoted, F.col("full_t") - F.floor(F.col("full_t") / 10))), 6).alias("mean_freed"), F.when(n > 2, "high").when(n > 0, "medium").otherwise("low").alias("risk"),
    )


@query(f"""WITH f AS ({FILES_SQL}), e AS (SELECT repo_name, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext, count(*) AS n, sum(lines) AS loc, sum(tokens) AS tokens FROM f GROUP BY 1, 2),
l AS (SELECT repo_name, bool_or(contains(upper(content), 'MIT')) AS mit, bool_or(contains(upper(content), 'APACHE')) AS apache, bool_or(contains(upper(content), 'GPL')) AS gpl, bool_or(regexp_matches(lower(content), 'http|browser|render')) AS web, bool_or(regexp_matches(lower(content), 'tensor|train')) AS ml FROM chunks WHERE content IS NOT NULL GROUP BY 1)
SELECT repo_name, arg_max(ext, struct_pack(a := e.loc, b := ext)) AS main_language, CAST(sum(n) AS BIGINT) AS files, CAST(sum(e.loc) AS BIGINT) AS loc, CAST(sum(tokens) AS BIGINT) AS tokens, any_value(CASE WHEN mit THEN 'MIT' WHEN apache THEN 'Apache' WHEN gpl THEN 'GPL' ELSE 'Other' END) AS license, any_value(CASE WHEN ml THEN 'ml' WHEN web THEN 'web' ELSE 'general' END) AS domain
FROM e LEFT JOIN l USING (repo_name) GROUP BY 1""")
def d29_repository_profile(spark, d):
    """Main language by lines, files, lines, tokens, license and domain of each repository."""
    e = files(spark, d).groupBy("repo_name", paths.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"), F.sum("lines").alias("loc"), F.sum("tokens").alias("tokens"))
    up, low = F.upper("content"), F.lower("content")
    has = lambda c, s: F.bool_or(F.contains(c, F.lit(s)))
    l = table(spark, d, "chunks").filter("content is not null").groupBy("repo_name").agg(has(up, "MIT").alias("mit"), has(up, "APACHE").alias("apache"), has(up, "GPL").alias("gpl"), F.bool_or(low.rlike("http|browser|render")).alias("web"), F.bool_or(low.rlike("tensor|train")).alias("ml"))
    g = e.groupBy("repo_name").agg(F.max_by("ext", F.struct("loc", "ext")).alias("main_language"), F.sum("n").alias("files"), F.sum("loc").alias("loc"), F.sum("tokens").alias("tokens"))
    return g.join(l, "repo_name", "left").select("repo_name", "main_language", "files", "loc", "tokens", F.when(F.col("mit"), "MIT").when(F.col("apache"), "Apache").when(F.col("gpl"), "GPL").otherwise("Other").alias("license"), F.when(F.col("ml"), "ml").when(F.col("web"), "web").otherwise("general").alias("domain"))


@query("""WITH s AS (SELECT variant_id, pack_id % 2 = 0 AS half, avg(coverage_score) AS m, count(*) AS n FROM selection_results WHERE coverage_score BETWEEN 0 AND 1 GROUP BY 1, 2), b AS (SELECT half, avg(m) AS base FROM s GROUP BY 1),
e AS (SELECT variant_id, half, m - base AS effect FROM s JOIN b USING (half)), j AS (SELECT coalesce(x.variant_id, y.variant_id) AS variant_id, x.effect AS a, y.effect AS b FROM (SELECT * FROM e WHERE half) x FULL JOIN (SELECT * FROM e WHERE NOT half) y USING (variant_id)),
k AS (SELECT count(*) FILTER (WHERE a > 0 AND b > 0) AS both_n, count(*) FILTER (WHERE a > 0 OR b > 0) AS any_n, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n, corr(a, b) AS r FROM j)
SELECT both_n, any_n, round(CASE WHEN any_n > 0 THEN both_n * 1.0 / any_n ELSE 1 END, 6)::DOUBLE AS jaccard, round(CASE WHEN n >= 3 THEN r END, 6)::DOUBLE AS correlation, CASE WHEN any_n = 0 OR both_n * 1.0 / any_n >= 0.8 THEN 'high' WHEN both_n * 1.0 / any_n >= 0.5 THEN 'moderate' ELSE 'low' END AS agreement FROM k""")
def d32_slice_consistency(spark, d):
    """Whether two slices of the packs promote the same variants: Jaccard of the promoted sets, correlation of the effects from three variants on, and a band."""
    s = table(spark, d, "selection_results").filter("coverage_score between 0 and 1").groupBy("variant_id", (F.col("pack_id") % 2 == 0).alias("half")).agg(F.avg("coverage_score").alias("m"))
    e = s.join(s.groupBy("half").agg(F.avg("m").alias("base")), "half").select("variant_id", "half", (F.col("m") - F.col("base")).alias("effect"))
    x, y = e.filter("half").select("variant_id", F.col("effect").alias("a")), e.filter("not half").select("variant_id", F.col("effect").alias("b"))
    j = x.join(y, "variant_id", "full")
    up = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    k = j.agg(F.count_if(up("a") & up("b")).alias("both_n"), F.count_if(up("a") | up("b")).alias("any_n"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n"), F.corr("a", "b").alias("r"))
    share = F.when(F.col("any_n") > 0, F.col("both_n") / F.col("any_n")).otherwise(1.0)
    return k.select("both_n", "any_n", F.round(share, 6).alias("jaccard"), F.round(F.when(F.col("n") >= 3, F.col("r")), 6).alias("correlation"), F.when(share >= 0.8, "high").when(share >= 0.5, "moderate").otherwise("low").alias("agreement"))

