"""Varied subset, packing and rank walk."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hewn.llm import diverse, packing, rank_walk

E = "vec_id long, chunk_id string, content_sha string, embedding array<float>, model_name string, model_version string, kind string"
C = "row_id long, id string, kind string, ingested_at timestamp, vec_id long"


def test_lazy_equals_plain_greedy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mass = rng.uniform(0.5, 2, 120)
    sim = np.maximum(x @ x.T, 0)
    best, want = np.zeros(120), []
    for _ in range(15):
        gain = (mass[:, None] * np.maximum(sim - best[:, None], 0)).sum(0)
        gain[want] = -1
        want.append(int(gain.argmax()))
        best = np.maximum(best, sim[:, want[-1]])
    chosen, gains, by = diverse.lazy_greedy(x, mass, 15)
    assert chosen == want and all(a >= b - 1e-4 for a, b in zip(gains, gains[1:])) and set(by) <= set(range(15))


def test_similarities_row_by_row_choose_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mass = rng.uniform(0.5, 2, 150)
    whole = diverse.lazy_greedy(x, mass, 40)
    monkeypatch.setattr(diverse, "FINAL_ROWS", 50)
    rows = diverse.lazy_greedy(x, mass, 40)
    assert whole[0] == rows[0] and np.allclose(whole[1], rows[1], atol=1e-3)


def test_large_subset(spark, monkeypatch):
    monkeypatch.setattr(diverse, "FINAL_ROWS", 100)
    monkeypatch.setattr(diverse, "PART_ROWS", 80)
    rng = np.random.default_rng(7)
    rows = [(i, f"c{i}", f"s{i}", [float(v) for v in rng.normal(size=6)], "m", "1", "x") for i in range(1500)]
    out = diverse.choose(spark.createDataFrame(rows, E), spark.createDataFrame([], C), 300).toPandas()
    assert len(out) == 300 and out.chunk_id.is_unique


def test_choice_covers_small_groups(spark, monkeypatch):
    monkeypatch.setattr(diverse, "FINAL_ROWS", 60)
    monkeypatch.setattr(diverse, "PART_ROWS", 80)
    rng = np.random.default_rng(1)
    centers = np.eye(8)
    rows, kinds = [], []
    sizes = [300, 5, 5, 5, 5, 5, 5, 5]
    for g, n in enumerate(sizes):
        for _ in range(n):
            i = len(rows)
            rows.append((i, f"c{i}", f"s{i}", [float(v) for v in centers[g] + 0.05 * rng.normal(size=8)], "m", "1", "clash"))
            kinds.append((i, f"c{i}", f"k{g}", None, i))
    rows += [(900, "c0", "s", [1.0] * 8, "m", "2", "x"), (901, None, "s", [1.0] * 8, "m", "2", "x"), (902, "c5", "s", None, "m", "1", "x")]
    out = diverse.choose(spark.createDataFrame(rows, E), spark.createDataFrame(kinds, C), 12).toPandas()
    assert len(out) == 12 and out.chunk_id.is_unique and sorted(out["rank"]) == list(range(1, 13))
    assert set(f"k{g}" for g in range(8)) <= set(out.kind) and (out.kind == "k0").sum() <= 5
    assert 0 <= out.diversity_score.iloc[0] <= 1
    few = diverse.choose(spark.createDataFrame(rows[:3], E), spark.createDataFrame([], C), 12)
    assert few.count() == 3
    assert diverse.choose(spark.createDataFrame([], E), spark.createDataFrame([], C), 12).count() == 0
    with pytest.raises(ValueError):
        diverse.choose(spark.createDataFrame(rows, E), spark.createDataFrame(kinds, C), 0)


def test_fill_is_valid_and_tight():
    rng = np.random.default_rng(3)
    for cap in (10, 100, 1000):
        s = rng.integers(0, cap + 1, 500)
        p = packing.fill(s, cap)
        totals = np.bincount(p, weights=s)
        assert totals.max() <= cap and (p >= 0).all()
        large = np.bincount(p, weights=s * 3 > cap)
        assert large.max() <= 2 and len(totals) <= 1.15 * np.ceil(s.sum() / cap) + 1
    assert packing.fill(np.array([6, 5, 4, 3, 2]), 10).tolist() == [0, 1, 0, 1, 1]


I = "row_id long, tokens long, part string, size long"


def test_pack_every_item_once(spark):
    items = [(i, i % 37, "x", 1) for i in range(400)] + [(1000, 95, "x", 1), (1001, None, "x", 1), (1002, -5, "x", 1), (7, 3, "x", 1), (None, 2, "x", 1)]
    out = packing.pack(spark.createDataFrame(items, I), 40, shard_rows=100).toPandas()
    assert out.groupby("pack_id").tokens.sum().max() <= 40
    assert (out.groupby("pack_id").tokens.sum() == out.groupby("pack_id").total_tokens.first()).all()
    assert sorted(out[out.row_id == 1000].tokens) == [15, 40, 40] and out.tokens.sum() == sum(max(t or 0, 0) for _, t, _, _ in items)
    assert len(out) == len(items) + 2 and (out.row_id == 7).sum() == 2
    assert packing.pack(spark.createDataFrame([], I), 40).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame(items, I), 0)


def test_token_counts(spark):
    rows = spark.createDataFrame([(1, 5, "abcdefgh"), (2, 0, "abcdefghi"), (3, -1, None), (4, None, "")], "row_id long, full_tokens int, content string")
    assert {r.row_id: r.tokens for r in packing.token_counts(rows).collect()} == {1: 5, 2: 3, 3: 0, 4: 0}


def dense_walk(ranks, damping=0.85, steps=400):
    n, s = ranks.shape
    m = np.zeros((n, n))
    for k in range(s):
        for i in range(n):
            up = np.flatnonzero(ranks[:, k] > ranks[i, k])
            if len(up):
                m[i, up] += 1 / s / len(up)
            else:
                m[i, i] += 1 / s
    pi = np.full(n, 1 / n)
    for _ in range(steps):
        pi = (1 - damping) / n + damping * pi @ m
    return pi


def test_walk_equals_dense_chain():
    rng = np.random.default_rng(5)
    for _ in range(10):
        r = rng.integers(0, 6, size=(25, 3))
        assert np.allclose(rank_walk.walk(r, steps=400), dense_walk(r), atol=1e-9)


L = "grp int, item string, score string, value double, rank long, share double"


def test_ranking_ignores_scale_and_both_ways_agree(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in (1, 2):
        for i in range(40):
            rows += [(g, f"i{i}", s, float(v), 0, 0.0) for s, v in zip("abc", (rng.integers(0, 9), rng.lognormal(8), rng.normal()))]
    rows += [(1, "i0", "a", None, 0, 0.0), (1, "i41", "a", float("nan"), 0, 0.0), (1, "i42", "b", 1e300, 0, 0.0), (3, "solo", "a", 1.0, 0, 0.0), (2, "i3", "a", -1.0, 0, 0.0)]
    df = spark.createDataFrame(rows, L)
    one = rank_walk.rank_walk(df).toPandas().set_index(["grp", "item"])
    scaled = spark.createDataFrame([(g, i, s, v * 1e6 if s == "c" and v is not None else v, 0, 0.0) for g, i, s, v, _, _ in rows], L)
    assert (rank_walk.rank_walk(scaled).toPandas().set_index(["grp", "item"])["rank"].sort_index() == one["rank"].sort_index()).all()
    wide = rank_walk.rank_walk(df.filter("grp = 1"), steps=3, task_rows=5).toPandas().set_index(["grp", "item"])
    short = rank_walk.rank_walk(df.filter("grp = 1"), steps=3).toPandas().set_index(["grp", "item"])
    both = wide.join(short, rsuffix="_s")
    assert len(both) == 42 and np.allclose(both.share, both.share_s, atol=1e-9) and (both["rank"] == both.rank_s).all()
    # several large groups at once, a null one and small ones beside them
    named = df.withColumn("grp", F.when(F.col("grp") != 2, F.col("grp")))
    many = rank_walk.rank_walk(named, steps=3, task_rows=5).toPandas()
    plain = rank_walk.rank_walk(named, steps=3).toPandas()
    assert many.sort_values(["grp", "item"])["rank"].tolist() == plain.sort_values(["grp", "item"])["rank"].tolist() and len(many) == 83
    assert one.loc[(3, "solo"), "rank"] == 1 and np.allclose(one.share.groupby(level=0).sum(), 1)
    assert rank_walk.rank_walk(df.limit(0)).count() == 0


def test_file_and_run_ranks(spark):
    t, day = datetime(2024, 1, 1), timedelta(days=1)
    g = spark.createDataFrame(
        [(1, 1, 5, 1.7e9, 3, t), (2, 1, 9, 1.7e9, 3, t + day), (3, 2, 1, 1.6e12, 1, t), (4, 3, None, 0.0, None, t), (5, None, 1, 1.0, 1, t)],
        "row_id long, file_id long, change_count int, last_modified double, author_count int, snapshot_at timestamp",
    )
    got = {r.file_id: r["rank"] for r in rank_walk.file_ranks(g).collect()}
    assert got == {1: 1, 2: 2, 3: 3}
    s = spark.createDataFrame(
        [(1, 1, 1, "v", {"a": 1.0, "b": 2.0}, t), (2, 1, 1, "v", {"a": 3.0, "b": 2.0}, t + day), (3, 1, 2, "w", {"a": 1.0, "b": None}, t), (4, 2, 1, "v", None, t)],
        "run_id long, pack_id long, config_id int, variant_id string, selection_scores map<string,double>, created_at timestamp",
    )
    assert {(r.pack_id, r.chunk_id): r["rank"] for r in rank_walk.run_ranks(s).collect()} == {(1, "a"): 1, (1, "b"): 2}


@pytest.mark.parametrize("wide", [False, True])
def test_close_shares_of_large_groups_are_no_ties(spark, wide):
    shares = [(1, "a", 1e-7), (1, "b", 1e-7 * (1 + 1e-6)), (1, "c", 1e-7 * (1 + 1e-15)), (1, "d", 0.2), (1, "e", 0.3)]
    got = {r.item: r["rank"] for r in rank_walk._ranked(spark.createDataFrame(shares, "grp int, item string, share double"), wide).collect()}
    assert got == {"e": 1, "d": 2, "b": 3, "a": 4, "c": 5}


def test_walk_does_not_stop_early_in_large_groups():
    rng = np.random.default_rng(8)
    n = 50_000
    r = np.stack([rng.permutation(n) + 1 for _ in range(3)], 1)
    assert np.abs(rank_walk.walk(r) - rank_walk.walk(r, steps=400)).max() * n < 1e-6


def test_large_group_is_walked_to_the_end(spark, monkeypatch):
    """All steps, values that go on over several blocks, a score without values, and size estimates that don't multiply from step to step on the driver."""
    digits, cut = [], rank_walk.cut

    def watched(df, **options):
        out = cut(df, **options)
        digits.append(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return out

    rng = np.random.default_rng(9)
    rows = [(g, f"i{i}", s, float(v), 0, 0.0) for g in (1, None) for i in range(60) for s, v in zip("abc", (rng.integers(0, 2), rng.integers(-1, 9), rng.normal()))]
    rows += [(1, f"i{i}", s, v, 0, 0.0) for i in range(50, 70) for s, v in (("d", None), ("e", float(i)))] + [(1, "i80", "a", None, 0, 0.0), (2, "solo", "a", 1.0, 0, 0.0)]
    df = spark.createDataFrame(rows, L)
    plain = rank_walk.rank_walk(df).toPandas().sort_values(["grp", "item"])
    monkeypatch.setattr(rank_walk, "cut", watched)
    wide = rank_walk.rank_walk(df, task_rows=11).toPandas().sort_values(["grp", "item"])
    assert len(wide) == 132 and wide["rank"].tolist() == plain["rank"].tolist() and np.allclose(wide.share, plain.share, atol=1e-12)
    assert len(digits) > rank_walk.STEPS and max(digits) < 10_000
