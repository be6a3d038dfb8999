"""Core operators on small fixtures: brute force, edge cases, invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hewn.functions import paths, text
from hewn.operators import budget, graph, select, stats
from hewn.operators.prefix import position, prefix_sum


@pytest.mark.parametrize(
    "pattern,path,want",
    [
        ("*.py", "a/b/c.py", True), ("*.py", "a/b/c.pyc", False), ("src/**/*.ts", "src/x.ts", True), ("src/**/*.ts", "src/a/b/x.ts", True), ("src/*.ts", "src/a/x.ts", False),
        ("docs/", "docs/a.md", True), ("node_modules/**", "node_modules/a/b", True), ("node_modules/**", "x/node_modules/a", False), ("a?.js", "ab.js", True), ("a?.js", "a/b.js", False),
    ],
)
def test_glob(spark, pattern, path, want):
    row = spark.createDataFrame([(path,)], "p string").select(paths.matches(F.col("p"), pattern, "GLOB").alias("m")).first()
    assert row.m is want


def test_path_edges(spark):
    df = spark.createDataFrame([(None, 1), ("", 1), ("a/B.PY", 1), ("x.py", 99)], "p string, n int")
    got = df.select(paths.included(F.col("p"), F.col("n"), ["*.py", "*.PY"], [], 50).alias("i"), paths.language(F.col("p")).alias("l")).collect()
    assert [(r.i, r.l) for r in got] == [(False, None), (False, None), (True, "python"), (False, "python")]
    assert df.select(paths.matches(F.col("p"), "(", "REGEX").alias("m")).first().m is False


def test_text_edges(spark):
    df = spark.createDataFrame([(None,), ("",), ("a b c d e",), ("x" * 100 + "\n\n" + "y" * 30,)], "t string")
    r = df.select(
        text.approx_tokens(F.col("t")).alias("n"), F.size(text.word_windows(F.split("t", " "), 3, 1)).alias("w"), text.truncated(F.col("t"), 30).alias("cut"), text.generated_score(F.col("t")).alias("g")
    ).collect()
    assert [x.n for x in r] == [1, 1, 2, 33] and r[2].w == 3 and r[0].cut is None and r[3].cut == "x" * 100 and r[2].cut == "a b c d e"
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(x[0], 6) for x in d.select(text.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]
    assert [x[0] for x in spark.createDataFrame([(5,), (1536,), (5 << 20,)], "n long").select(text.human_bytes(F.col("n"))).collect()] == ["5 B", "1.5 KiB", "5.0 MiB"]


def test_prefix_sum_with_a_hot_group(spark):
    rows = [("hot", i, i % 5) for i in range(300)] + [(None, i, 1) for i in range(20)] + [("b", 1, None)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    got = {(r.g, r.o): r["cum"] for r in prefix_sum(df, ["g"], [F.col("o")], "v").collect()}
    run = {}
    for g, o, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        run[g] = run.get(g, 0) + (v or 0)
        assert got[g, o] == run[g]
    assert max(r["rank"] for r in position(df, ["g"], [F.col("o")]).filter("g = 'hot'").collect()) == 300
    assert prefix_sum(df.limit(0), ["g"], [F.col("o")], "v").count() == 0


def skip(rows, limit):
    out, used = [], {}
    for g, rank, t in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if t is not None and 0 <= t and used.get(g, 0) + t <= limit:
            used[g] = used.get(g, 0) + t
            out.append((g, rank, used[g]))
    return set(out)


@pytest.mark.parametrize("fold_rows", [10, 10_000])
def test_skip_greedy(spark, fold_rows):
    rng = np.random.default_rng(2)
    rows = [("a", i, int(t)) for i, t in enumerate(rng.integers(1, 90, 150))] + [("b", 0, 60), ("b", 1, 50), ("b", 2, 30), ("b", 3, 10), (None, 1, 5), ("c", 1, None), ("c", 2, 101), ("c", 3, 0)]
    df = spark.createDataFrame(rows, "g string, rank long, tokens long")
    got = {(r.g, r["rank"], r.cum_tokens) for r in budget.skip_greedy(df, "g", "rank", "tokens", 100, fold_rows).collect()}
    assert got == skip(rows, 100)
    assert {("b", 0, 60), ("b", 2, 90), ("b", 3, 100)} <= got
    brk = {(r.g, r["rank"]) for r in budget.break_greedy(df.filter("g = 'b'"), "g", "rank", "tokens", 100).collect()}
    assert brk == {("b", 0)}
    assert budget.skip_greedy(df.limit(0), "g", "rank", "tokens", 100).count() == 0


@pytest.mark.parametrize("fold_rows", [25, 1000])
def test_greedy_in_rounds_equals_plain_loops(spark, fold_rows):
    import random

    rnd = random.Random(5)
    rows = [(rnd.choice("abbb"), i, rnd.choice("xyz"), rnd.randint(1, 60)) for i in range(80)]
    df = spark.createDataFrame([(g, i, k, t, t, max(1, t // 5), i) for g, i, k, t in rows], "g string, id long, kind string, tokens long, full_tokens long, signature_tokens long, rank long")
    used, by, want = {}, {}, set()
    for g, i, k, t in rows:
        if used.get(g, 0) + t <= 400 and by.get((g, k), 0) + t <= 160:
            used[g], by[g, k] = used.get(g, 0) + t, by.get((g, k), 0) + t
            want.add((g, i, k, t))
    got = {(r.g, r.id, r.kind, r.tokens) for r in budget.capped_greedy(df, "g", "kind", "rank", 400, 0.4, fold_rows).collect()}
    assert got == want
    used, want = {}, set()
    for g, i, _, t in rows:
        for mode, n in (("full", t), ("signature", max(1, t // 5))):
            if used.get(g, 0) + n <= 400:
                used[g] = used.get(g, 0) + n
                want.add((g, i, mode, n))
                break
    got = {(r.g, r.id, r["mode"], r.tokens) for r in budget.two_mode_greedy(df, "g", "rank", 400, fold_rows).collect()}
    assert got == want
    limits = df.withColumn("lim", (100 + df.id % 3 * 50).cast("long"))
    used, want = {}, set()
    for g, i, _, t in rows:
        if used.get(g, 0) + t <= 100 + i % 3 * 50:
            used[g] = used.get(g, 0) + t
            want.add((g, i, used[g]))
    got = {(r.g, r.id, r.cum_tokens) for r in budget.skip_greedy(limits, "g", "rank", "tokens", "lim", fold_rows).collect()}
    assert got == want


def test_two_mode(spark):
    df = spark.createDataFrame([("a", 1, 1, 60, 6), ("a", 2, 2, 50, 5), ("a", 3, 3, 36, 4), ("a", 4, 4, 30, 29)], "g string, id long, rank long, full_tokens long, signature_tokens long")
    got = [(r.id, r["mode"], r.tokens) for r in budget.two_mode_greedy(df, "g", "rank", 100).orderBy("id").collect()]
    assert got == [(1, "full", 60), (2, "signature", 5), (3, "signature", 4) if 65 + 36 > 100 else (3, "full", 36), (4, "full", 30)]


def ref_pagerank(nodes, edges, steps, damping=0.85):
    out = {}
    for s, t in edges:
        out.setdefault(s, set()).add(t)
    r = {n: 1 / len(nodes) for n in nodes}
    for _ in range(steps):
        new = {n: (1 - damping) / len(nodes) for n in nodes}
        for s, ts in out.items():
            for t in ts:
                new[t] += damping * r[s] / len(ts)
        r = new
    return r


def test_pagerank_fixture(spark):
    nodes, edges = list(range(6)), [(0, 1), (1, 0), (0, 2), (2, 3), (3, 2), (1, 4), (0, 1)]
    n, e = spark.createDataFrame([(i,) for i in nodes], "node long"), spark.createDataFrame([*edges, (None, 1), (9, 1)], "src long, dst long")
    got = {r.node: r["rank"] for r in graph.pagerank(n, e, steps=7).collect()}
    want = ref_pagerank(nodes, set(edges), 7)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    full = {r.node: r["rank"] for r in graph.pagerank(n, e, steps=7, dangling=True).collect()}
    assert math.isclose(sum(full.values()), 1, abs_tol=1e-9)
    assert graph.pagerank(n.limit(0), e).count() == 0
    s = graph.shuffled(graph.clean_edges(e), 3).collect()
    assert sorted(r.src for r in s) == sorted(r.src for r in graph.clean_edges(e).collect())


def ref_mmr(rows, k, trade=0.7):
    chosen, left, s = [], dict(rows), {i: 0.0 for i in rows}
    while left and len(chosen) < k:
        def gain(i):
            g = trade * left[i][0] - (1 - trade) * s[i]
            return g * 0.5 if s[i] > 0.8 else g
        best = max(sorted(left), key=lambda i: (round(gain(i), 12), -i))
        chosen.append(best)
        v = left.pop(best)[1]
        for i in left:
            a, b = np.array(left[i][1]), np.array(v)
            n = np.linalg.norm(a) * np.linalg.norm(b)
            s[i] = max(s[i], float(a @ b / n) if n else 0.0)
    return chosen


def test_mmr_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = {i: (float(q), [float(v) for v in rng.normal(size=4)]) for i, q in enumerate(rng.uniform(size=30))}
    rows[30] = (0.9, [0.0] * 4)
    df = spark.createDataFrame([("g", i, q, 10, v) for i, (q, v) in rows.items()] + [("h", 99, None, None, None)], "grp string, id long, quality double, tokens long, vec array<double>")
    out = select.greedy_diverse(df, 6).collect()
    assert [r.id for r in sorted((r for r in out if r.grp == "g"), key=lambda r: r.step)] == ref_mmr(rows, 6)
    assert [r.id for r in out if r.grp == "h"] == [99]
    fit = select.greedy_diverse(df, 9, "facility", budget=35).groupBy("grp").count().collect()
    assert {r.grp: r["count"] for r in fit} == {"g": 3, "h": 1}
    assert select.greedy_diverse(df.limit(0), 3).count() == 0


def test_corrections(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.02), ("f", "c", 0.03), ("f", "d", 0.2), ("f", "e", None)], "fam string, k string, p double")
    r = {x.k: x.p_adj for x in stats.adjusted(df, ["fam"], "p", "k").collect()}
    assert {k: round(v, 6) for k, v in r.items()} == {"a": 0.04, "b": 0.04, "c": 0.04, "d": 0.2}
    b = {x.k: round(x.p_adj, 6) for x in stats.adjusted(df, ["fam"], "p", "k", "bonferroni").collect()}
    assert b == {"a": 0.04, "b": 0.08, "c": 0.12, "d": 0.8}


def test_cliff_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 9, 40), rng.integers(2, 11, 30)
    df = spark.createDataFrame([(float(v), False) for v in x] + [(float(v), True) for v in y] + [(None, True)], "v double, t boolean")
    want = np.sign(y[:, None] - x[None, :]).mean()
    assert math.isclose(stats.cliffs_delta(df, "v", F.col("t")).first().delta, want, abs_tol=1e-12)


def test_agreement(spark):
    same = spark.createDataFrame([(i % 5, i % 5) for i in range(20)] + [(None, 1)], "a int, b int")
    assert stats.kappa(same).first().kappa == 1 and stats.kappa(same, "quadratic").first().kappa == 1
    mixed = spark.createDataFrame([(0, 0), (1, 1), (0, 1), (1, 0)], "a int, b int")
    assert abs(stats.kappa(mixed).first().kappa) < 1e-12
    r = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (2, "y"), (3, "z")], "item int, category string")
    assert stats.fleiss(r).first().kappa == 1


def test_distributions_and_bootstrap(spark):
    assert math.isclose(stats.norm_cdf(1.959964), 0.975, abs_tol=1e-6) and math.isclose(stats.norm_ppf(0.975), 1.959964, abs_tol=1e-5)
    assert math.isclose(stats.t_sf(2.0, 10), 0.036694, abs_tol=1e-5) and 0.79 < stats.power(0.5, 64) < 0.82
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(1, 1, 200)] + [(None,), (float("nan"),)], "x double")
    r = stats.bootstrap_bca(df, "x", 500).first()
    again = stats.bootstrap_bca(df.repartition(7), "x", 500).first()
    assert r.n == 200 and r.low < r["mean"] < r.high and r.p_value < 0.01 and math.isclose(r.low, again.low, abs_tol=1e-9)
    assert stats.bootstrap_bca(df.limit(0), "x", 50).count() == 0


def test_knn_has_as_many_neighbours_as_the_root_of_the_rows(spark, tmp_path):
    from hewn.plans import closing

    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=8)], 0) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = closing.c14_knn_whole(spark, str(tmp_path)).groupBy("vec_id").agg(F.max("place").alias("k"), F.count("*").alias("n")).collect()
    assert {(r.vec_id, r.k, r.n) for r in got} == {(i, 10, 10) for i in range(0, 120, 20)}


def test_bootstrap_has_ten_thousand_rounds():
    import inspect

    assert inspect.signature(stats.bootstrap_bca).parameters["rounds"].default == 10_000


def test_kmeans_by_label_is_the_best_of_ten_starts(spark, tmp_path):
    from hewn.plans import analysis

    rng = np.random.default_rng(4)
    x = {(label, i): rng.normal(size=4) + 9 * (i % 5) for label in (1, 2) for i in range(60)}
    rows = [(100 * label + i, [float(u) for u in v], label) for (label, i), v in x.items()] + [(999, [1.0] * 4, 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    one = np.stack([v for (label, _), v in x.items() if label == 1])
    inertia = lambda c: sum(((one[c == j] - one[c == j].mean(0)) ** 2).sum() for j in np.unique(c))
    for task_rows in (1000, 50):
        got = analysis.k2_kmeans(spark, str(tmp_path), task_rows=task_rows).toPandas()
        assert len(got) == 121 and got.groupby("label")["cluster"].nunique().to_dict() == {1: 7, 2: 7, 3: 1}
        mine = got[got.label == 1].sort_values("vec_id")["cluster"].to_numpy()
        if task_rows == 1000:
            assert inertia(mine) <= min(inertia(stats.kmeans(one.astype(np.float32).astype(float), 7, 1)), 1e9) + 1e-6
