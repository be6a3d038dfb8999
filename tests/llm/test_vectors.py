"""Similar vectors against brute force, with hot contents, dirt and empty tables."""

import os

import numpy as np
import pytest

from hewn.llm import vectors

E = "vec_id long, chunk_id string, content_sha string, embedding array<float>, model_name string, model_version string, extra string"
C = "vec_id long, content_sha string, model_name string, model_version string, embedding_dimension int, embedding_data binary, extra string"


def data(seed=0, groups=12, each=40, dim=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim))
    x = (centers[:, None, :] + 0.5 * rng.normal(size=(groups, each, dim))).reshape(-1, dim)
    near = x[:60] + 0.05 * rng.normal(size=(60, dim))
    return np.concatenate([x, near]) * rng.uniform(0.2, 5, size=(len(x) + 60, 1))


def brute(x, sha, least=0.96):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= least and sha[i] != sha[j]}


def rows(x, sha, model="m", ver="1"):
    return [(i, f"c{i}", sha[i], [float(v) for v in x[i]], model, ver, "x") for i in range(len(x))]


def test_pairs_equal_brute_force(spark):
    x = data()
    sha = [f"s{i}" for i in range(len(x))]
    half = len(x) // 2
    emb = spark.createDataFrame(rows(x, sha)[:half], E)
    cache = spark.createDataFrame([(i, sha[i], "m", "1", 16, x[i].astype("<f4" if i % 2 else "<f8").tobytes(), "y") for i in range(half, len(x))], C)
    got = {(r.a_vec, r.b_vec) for r in vectors.similar_pairs(emb, cache).collect()}
    want = brute(x, sha)
    assert len(got & want) >= 0.98 * len(want) and got <= want and len(want) >= 40


def test_hot_content_meets_others_but_not_itself(spark):
    x = data(1)
    many = np.repeat(x[:1], 120, axis=0) + 0.001
    all_ = np.concatenate([x, many])
    sha = [f"s{i}" for i in range(len(x))] + ["hot"] * 120
    emb, none = spark.createDataFrame(rows(all_, sha), E), spark.createDataFrame([], C)
    got = {(r.a_vec, r.b_vec) for r in vectors.similar_pairs(emb, none, hot_rows=10).collect()}
    want = brute(all_, sha)
    assert len(got & want) >= 0.98 * len(want) and got <= want
    assert not any(a >= len(x) and b >= len(x) for a, b in got)


def test_models_do_not_mix_and_dirt_is_left_out(spark):
    v = [1.0] * 16
    bad = [(10, "c", "a", None, "m", "1", "x"), (11, "c", "b", [0.0] * 16, "m", "1", "x"), (12, "c", "d", [float("nan")] * 16, "m", "1", "x"), (13, "c", "e", v, None, "1", "x")]
    good = [(1, "c", "p", v, "m", "1", "x"), (2, "c", "q", v, "m", "2", "x"), (3, "c", "p", v, "m", "1", "x"), (4, "c", None, v, "m", "1", "x"), (5, "c", None, v, "m", "1", "x")]
    got = vectors.similar_pairs(spark.createDataFrame(bad + good, E), spark.createDataFrame([], C)).collect()
    assert {(r.a_vec, r.b_vec) for r in got} == {(1, 4), (1, 5), (3, 4), (3, 5), (4, 5)}
    short = spark.createDataFrame([(1, "s", "hill-mini", "1.2", 64, b"123", "x"), (2, "s", "hill-mini", "1.2", 64, np.ones(64, "<f4").tobytes(), "x"), (3, "s", "hill-mini", "1.2", 64, np.zeros(64, "<f8").tobytes(), "x")], C)
    assert [r.vec_id for r in vectors.valid_vectors(spark.createDataFrame([], E), short).collect()] == [2]


def test_empty(spark):
    e, c = spark.createDataFrame([], E), spark.createDataFrame([], C)
    assert vectors.similar_pairs(e, c).count() == 0
    assert vectors.most_similar(e, c).count() == 0


def test_most_similar_recall(spark):
    x = data(3, groups=20, each=60)
    emb = spark.createDataFrame(rows(x, [str(i) for i in range(len(x))]), E)
    got = vectors.most_similar(emb, spark.createDataFrame([], C), k=10, every=20, rerank=128).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hit = sum(r.other_vec in set(np.argsort(-s[r.vec_id])[:10]) for r in got)
    asked = len(range(0, len(x), 20))
    assert len(got) == 10 * asked and hit >= 0.9 * len(got)
    assert {r["rank"] for r in got} == set(range(1, 11))


TABLES = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_most_similar_recall_on_the_table(spark):
    from hewn.sources.tables import table

    emb, cache = table(spark, TABLES, "code_embeddings"), table(spark, TABLES, "embedding_cache")
    got: dict = {}
    for r in vectors.most_similar(emb, cache).collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.similarity, r.other_vec))
    by: dict = {}
    for r in vectors.valid_vectors(emb, cache).collect():
        by.setdefault(r.space, []).append((r.vec_id, np.frombuffer(r.vec, "<f4")))
    hit = asked = 0
    for rows_ in by.values():
        ids, x = np.array([i for i, _ in rows_]), np.stack([v for _, v in rows_]).astype(np.float64)
        q = np.flatnonzero(ids % 20 == 0)
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -2
        tenth = -np.sort(-s, 1)[:, 9]
        for i, t in zip(ids[q], tenth):
            mine = sorted(got[i])
            assert [r for r, _, _ in mine] == list(range(1, 11)) and i not in {o for _, _, o in mine}
            hit += sum(v >= t - 1e-6 for _, v, _ in mine)
            asked += 10
    assert hit >= 0.95 * asked


def test_units_do_not_change_the_result(spark):
    x = data(4, groups=3, each=60)
    emb, none = spark.createDataFrame(rows(x, [str(i) for i in range(len(x))]), E), spark.createDataFrame([], C)
    one = vectors.most_similar(emb, none, every=5).collect()
    assert sorted(one) == sorted(vectors.most_similar(emb, none, every=5, unit_rows=17, unit_queries=3).collect()) and len(one) == 10 * 48


@pytest.mark.parametrize("n,depth", [(10, 1), (1024, 1), (60_000, 2), (3_000_000, 3)])
def test_depth_follows_size(n, depth):
    assert vectors.depth_of(n) == depth


def test_pairs_just_above_the_least_cosine_are_found_at_three_codes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "depth_of", lambda n: 3)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 64))[rng.integers(0, 40, 6000)] + 0.5 * rng.normal(size=(6000, 64))
    u = x[:600] / np.linalg.norm(x[:600], axis=1, keepdims=True)
    e = rng.normal(size=u.shape)
    e -= (e * u).sum(1, keepdims=True) * u
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    all_ = np.concatenate([x, 0.962 * u + np.sqrt(1 - 0.962**2) * e])
    emb = spark.createDataFrame(rows(all_, [f"s{i}" for i in range(len(all_))]), E)
    got = {(r.a_vec, r.b_vec) for r in vectors.similar_pairs(emb, spark.createDataFrame([], C)).collect()}
    assert len(got & {(i, len(x) + i) for i in range(600)}) >= 0.94 * 600


def test_all_cells_are_looked_into_whatever_the_size(spark, monkeypatch):
    """Scattered rows, of which many near ones lie in far cells: the neighbours are those of a scan of all codes, above and below SAMPLE rows alike."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 16))
    emb, none = spark.createDataFrame(rows(x, [str(i) for i in range(len(x))]), E), spark.createDataFrame([], C)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    whole = {(int(i), int(j)) for i in range(0, len(x), 100) for j in np.argsort(-s[i])[:10]}
    below = {(r.vec_id, r.other_vec) for r in vectors.most_similar(emb, none, every=100).collect()}
    monkeypatch.setattr(vectors, "SAMPLE", 1000)
    assert {(r.vec_id, r.other_vec) for r in vectors.most_similar(emb, none, every=100).collect()} == below
    # with all rows ranked again nothing is left out
    assert {(r.vec_id, r.other_vec) for r in vectors.most_similar(emb, none, every=100, rerank=2000).collect()} == whole
