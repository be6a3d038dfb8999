"""Sources, plug-ins, neighbours, percentiles and two-mode selection on small fixtures, with nulls, ties and empty tables."""

import json
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hewn import plugins
from hewn.operators import graph, neighbours, select, stats
from hewn.plans import kernels, linking
from hewn.plans.catalog import ORACLE_SQL
from hewn.plans.linking import _first_five, _substring_matches, c2_import_matches
from hewn.session import ensure_checkpoint_dir, setting
from hewn.sources import files


def test_git_log_and_manifest(spark, tmp_path):
    log = "\x1eaaa\x1fAnn\x1f100\n\n3\t1\tsrc/a.py\n-\t-\timg.png\n\x1ebbb\x1fBo\x1f200\n\n5\t0\tsrc/a.py\nno numbers here\n"
    (tmp_path / "log.txt").write_text(log)
    got = sorted(tuple(r) for r in files.git_log(spark, str(tmp_path / "log.txt")).collect())
    assert got == [("aaa", "Ann", 100, "img.png", 0, 0), ("aaa", "Ann", 100, "src/a.py", 3, 1), ("bbb", "Bo", 200, "src/a.py", 5, 0)]
    (tmp_path / "ls.txt").write_bytes(b"a.py\0dir/b c.py\0")
    assert sorted(r.path for r in files.manifest(spark, str(tmp_path / "ls.txt")).collect()) == ["a.py", "dir/b c.py"]


def test_config_native_and_nested():
    assert files.config("")["budget"] == 128_000
    assert files.config(json.dumps({"budget": 5, "include": ["*.py"]})) | {} == files.config("{}") | {"budget": 5, "include": ["*.py"]}
    nested = files.config(json.dumps({"output": {"filePath": "x.xml", "style": "xml"}, "ignore": {"customPatterns": ["*.log"]}, "input": {"maxFileSize": 9}, "include": ["src/**"]}))
    assert (nested["output"], nested["form"], nested["exclude"], nested["max_bytes"], nested["include"]) == ("x.xml", "xml", ["*.log"], 9, ["src/**"])


def test_flags_and_selectors(spark):
    assert plugins.Flags.from_env({"HEWN_ROUTER": "on", "HEWN_PATCH": "0"}) == plugins.Flags(router=True, patch=False)
    items = spark.createDataFrame([("r", i, 10, float(i), None) for i in range(5)] + [(None, 9, 10, 1.0, None)], "repo_name string, row_id long, tokens long, score double, ingested_at timestamp")
    got = {(r.repo_name, r.row_id) for r in plugins.select(items, "score", 20).collect()}
    assert got == {("r", 4), ("r", 3), (None, 9)}
    kept = plugins.select(items, "score", 20, keep=lambda: F.col("row_id") < 3, key=lambda: [F.col("row_id")]).collect()
    assert {r.row_id for r in kept} == {0, 1}
    assert plugins.select(items.limit(0), "hash", 20).count() == 0


@pytest.mark.parametrize("block", [4, 4096])
def test_neighbours_equal_brute_force(spark, block):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    x[7] = x[3]
    rows = [(i, [float(v) for v in x[i]]) for i in range(60)] + [(98, None), (99, [0.0] * 5)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {}
    for r in neighbours.nearest(df.filter("id % 10 = 3"), df, 4, block).collect():
        got.setdefault(r.id, []).append((r.place, r.other))
    u = np.vstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(5)])
    ids = [*range(60), 99]
    for i in range(3, 60, 10):
        s = np.round(u @ u[i], 6)
        want = [ids[k] for k in sorted((k for k in range(61) if ids[k] != i), key=lambda k: (-s[k], ids[k]))[:4]]
        assert [o for _, o in sorted(got[i])] == want
    assert neighbours.nearest(df.limit(0), df, 4).count() == 0 and neighbours.nearest(df, df.limit(0), 4).count() == 0


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rng.integers(0, 20, 101)] + [("b", 2.5), (None, 1.0), (None, 3.0), ("c", None)]
    got = {r.g: r for r in stats.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"m": 0.5, "p95": 0.95, "low": 0.0, "high": 1.0}).collect()}
    a = [v for g, v in rows if g == "a"]
    assert np.allclose([got["a"].m, got["a"].p95, got["a"].low, got["a"].high], np.quantile(a, [0.5, 0.95, 0, 1]))
    assert got["b"].m == 2.5 and got[None].m == 2.0 and "c" not in got


def test_two_mode_diverse_equals_plain_greedy(spark):
    rng = np.random.default_rng(2)
    n = 24
    f, c, w = rng.uniform(0, 1, (n, 3)), rng.uniform(0, 1, (n, 2)), rng.uniform(0.1, 1, n)
    full, sig = rng.integers(20, 60, n), rng.integers(5, 20, n)
    rows = [("g", i, f"k{i:02d}", int(full[i]), int(sig[i]), float(w[i]), [float(v) for v in f[i]], [[float(v) for v in c[i]]]) for i in range(n)]
    kind = "grp string, id long, key string, full_tokens long, signature_tokens long, weight double, feature array<double>, places array<array<double>>"
    got = [(r.id, r["mode"]) for r in select.two_mode_diverse(spark.createDataFrame(rows, kind), 5, 60).orderBy("step").collect()]
    chosen, used = [], 0
    for _ in range(5):
        best = None
        for i in range(n):
            if any(i == j for j, _ in chosen):
                continue
            cover = min((np.linalg.norm(c[i] - c[j]) for j, _ in chosen), default=1.0)
            s = max((f[i] @ f[j] / np.linalg.norm(f[i]) / np.linalg.norm(f[j]) for j, _ in chosen), default=0.0)
            for m, t in (("full", full[i]), ("signature", sig[i])):
                if used + t <= 60:
                    key = (-round((0.7 * cover + 0.3 * (1 - s)) * w[i] / t, 9), i)
                    if best is None or key < best[0]:
                        best = (key, i, m, t)
        if best is None:
            break
        chosen.append((best[1], best[2]))
        used += best[3]
    assert got == chosen
    assert select.two_mode_diverse(spark.createDataFrame([], kind), 5, 60).count() == 0


def test_substring_matches_equal_all_pairs(spark):
    names = ["core.index", "a", "os", "pkg::mod", "x.y.zz", "index"]
    files_ = [(1, "core/index.py"), (2, "src/os.py"), (3, "pkg/mod/a.rs"), (4, "Y/zz.PY"), (5, None), (6, "b")]
    got = {(r["import"], r.dst) for r in _substring_matches(spark.createDataFrame([(x,) for x in names], "import string"), spark.createDataFrame(files_, "file_id long, path string")).collect()}
    want = set()
    for x in names:
        parts = x.replace("::", ".").split(".")
        for i, p in files_:
            if p and (parts[-1].lower() in p.lower() or "/".join(parts).lower() in p.lower()):
                want.add((x, i))
    assert got == want
    found = spark.createDataFrame([(1, "index"), (9, "index")], "src long, `import` string")
    assert {(r.src, r.dst) for r in _first_five(found, spark.createDataFrame(files_, "file_id long, path string")).collect()} == {(9, 1)}


def test_pagerank_edges_and_settings(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (None,)], "node long")
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (None, 1), (1, 9)], "src long, dst long")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    r = {x.node: x["rank"] for x in graph.pagerank(nodes, edges, steps=3).collect()}
    assert set(r) == {1, 2, 3} and abs(r[3] - 0.05) < 1e-9 and abs(r[1] - r[2]) < 1e-9
    assert graph.pagerank(nodes.limit(0), edges).count() == 0
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
    with setting(spark, "hewn.test", "1"):
        assert spark.conf.get("hewn.test") == "1"
    assert spark.conf.get("hewn.test", None) is None
    ensure_checkpoint_dir(spark)


def _size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


def test_reallocation_keeps_no_pairs_of_runs_and_chunks(spark, tmp_path):
    """300 runs over 2,000 chunks of a repository: equal to the SQL, and what is written on the way is far from 600,000 rows."""
    rng = np.random.default_rng(4)
    chunks = [(i, f"c{i % 1990}" if i % 50 else None, ("r", "s", None)[0 if i < 2000 else i % 3], ("A", "b", None)[i % 3], "x" * int(rng.integers(0, 90)), 0, float(rng.integers(0, 5)) / 4 if i % 7 else None) for i in range(2060)]
    modes = lambda: {f"c{int(j)}": "full" for j in rng.integers(0, 2100, 12)}
    runs = [(i, 1 + i % 3, ("r", "r", "s", None)[i % 4 if i > 280 else 0], int(rng.integers(0, 900)) if i % 40 else None, modes() if i % 30 else None) for i in range(300)]
    tables = {
        "chunks": (chunks, "row_id long, id string, repo_name string, kind string, content string, full_tokens int, centrality_score double"),
        "selection_results": (runs, "run_id long, config_id int, repo_name string, total_tokens long, chunk_modes map<string,string>"),
        "baseline_configs": ([(1, 0), (2, 1000), (3, 60000)], "config_id int, token_budget int"),
    }
    duck = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = _size(folder)
    got = sorted(tuple(r[c] for c in ("run_id", "strategy", "added", "tokens")) for r in kernels.j21_reallocation(spark, str(tmp_path)).collect())
    assert got == sorted(duck.execute(ORACLE_SQL["j21_reallocation"]).fetchall()) and len(got) > 300
    assert _size(folder) - before < 1_500_000


def test_import_matches_are_not_shuffled_as_pairs(spark, tmp_path):
    """240 files that import two names each, over 720 paths that mostly hold both: equal to the SQL, and fewer rows are shuffled than there are pairs."""
    words = ["core", "index", "a", "os", "zz"]
    path = lambda i: None if i == 5 else f"Src/{words[i % 5]}/{words[i % 4]}_{i}.py"
    rows = [(3 * i + k, i, path(i), "Import" if k < 2 and i % 3 == 0 else "function", f"import {words[(i + k) % 4]}\nfrom src.{words[i % 5]} import x" if i != 9 else None) for i in range(720) for k in range(3)]
    spark.createDataFrame(rows, "row_id long, file_id long, rel_path string, kind string, content string").withColumn("repo_name", F.lit("r")).withColumn("end_line", F.lit(1)).withColumn("full_tokens", F.lit(1)).write.parquet(str(tmp_path / "chunks.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view chunks as select * from '{tmp_path}/chunks.parquet/*.parquet'")
    want = sorted(duck.execute(ORACLE_SQL["c2_import_matches"]).fetchall())
    jvm = spark._jvm
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(jvm.double, 0)

    def ran():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}

    before = set(ran())
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"), setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):  # as with large tables
        got = sorted(tuple(r[c] for c in ("src", "dst")) for r in c2_import_matches(spark, str(tmp_path)).collect())
    assert got == want and len(want) > 80_000
    assert sum(n for i, n in ran().items() if i not in before) < len(want) / 2


def _unit_rows(n: int, seed: int):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(8, 12))[rng.integers(0, 8, n)] + rng.normal(size=(n, 12)) * 0.9
    x[5:9] = x[4]  # the same vector five times
    x[20:40] = x[300:320] + rng.normal(size=(20, 12)) * 0.01
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("asked", "k", "block"), [(900, 15, 32_768), (900, 15, 200), (900, 600, 400), (40, 15, 32_768)])
def test_densest_equals_brute_force(spark, asked, k, block):
    """Also where nearly all or only few of the queries are wanted, and over several blocks of them."""
    x = _unit_rows(1000, 6)
    df = spark.createDataFrame([(f"v{i:04d}", [float(v) for v in u]) for i, u in enumerate(x)], "id string, vec array<double>")
    sims = np.round(x[:asked] @ x.T, 6)
    sims[np.arange(asked), np.arange(asked)] = -9
    dens = np.round(1 / (1 + (1 - np.sort(sims, 1)[:, -10:]).mean(1)), 6)
    want = [(f"v{i:04d}", dens[i]) for i in sorted(range(asked), key=lambda i: (-dens[i], i))[:k]]
    got = [tuple(r) for r in neighbours.densest(df.filter(f"id < 'v{asked:04d}'"), df, 10, k, block).orderBy(F.desc("density"), "id").collect()]
    assert got == want
    members = {r.id: r.members for r in neighbours.within(df.limit(7), df, 0.2).collect()}
    assert members == {f"v{i:04d}": int((x @ x[i] >= 0.2).sum()) for i in range(7)}
    assert neighbours.densest(df.limit(0), df, 10, k).count() == 0 and neighbours.within(df.limit(0), df, 0.2).count() == 0


def test_mixed_centroids_make_the_tail_once(spark, monkeypatch):
    """Tail vectors are found once for their share and the medoids; without enough of them no medoid is made."""
    d, calls, tail = "/root/testdata/sf0.001", [], linking._tail
    monkeypatch.setattr(linking, "_tail", lambda k, *a: calls.append(1) or tail(k, *a))
    assert {r.source for r in linking.k5_mixed_centroids(spark, d).collect()} == {"kmeans", "medoid"} and len(calls) == 1
    monkeypatch.setattr(linking, "_tail", lambda k: tail(k).limit(1))
    monkeypatch.setattr(linking, "_medoid_members", None)
    assert {r.source for r in linking.k5_mixed_centroids(spark, d).collect()} == {"kmeans"}
