"""Statistics of paired and unpaired samples, from aggregates; the normal and t distributions without scipy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hewn.operators.prefix import prefix_sum


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    """Inverse of the normal distribution by bisection."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if norm_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t by numerical integration of its density."""
    if df <= 0 or not math.isfinite(t):
        return float("nan") if math.isnan(t) else 0.0
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    # substitute t = sqrt(df) tan(u): the tail becomes a finite integral of cos(u)^(df-1)
    a = math.atan(abs(t) / math.sqrt(df))
    u = np.linspace(a, math.pi / 2, 4001)
    tail = float(np.trapezoid(np.cos(u) ** (df - 1), u)) * c * math.sqrt(df)
    return tail if t >= 0 else 1 - tail


def adjusted(df: DataFrame, family: list[str], p: str, key: str, method: str = "bh") -> DataFrame:
    """Adds ``p_adj``: Benjamini-Hochberg (bh), Benjamini-Yekutieli (by) or Bonferroni; ``key`` breaks ties. Null p-values keep null and do not count."""
    known = df.filter(F.col(p).isNotNull())
    fam = Window.partitionBy(*family)
    n = F.count("*").over(fam)
    if method == "bonferroni":
        return known.withColumn("p_adj", F.least(F.lit(1.0), F.col(p) * n))
    rank = F.row_number().over(fam.orderBy(p, key))
    raw = F.col(p) * n / rank
    if method == "by":
        raw = raw * F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    step = known.withColumn("__raw", raw).withColumn("__rank", rank)
    back = fam.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    return step.withColumn("p_adj", F.least(F.lit(1.0), F.min("__raw").over(back))).drop("__raw", "__rank")


def magnitude(d: Column) -> Column:
    """Band of an effect size."""
    a = F.abs(d)
    return F.when(a < 0.1, "negligible").when(a < 0.2, "very_small").when(a < 0.5, "small").when(a < 0.8, "medium").when(a < 1.2, "large").otherwise("very_large")


def effect_sizes(df: DataFrame, value: str, is_treatment: Column) -> DataFrame:
    """One row: Cohen d, Hedges g, Glass delta, Welch t and its degrees of freedom, from one aggregation. Null values are left out."""
    x, y = F.when(~is_treatment, F.col(value)), F.when(is_treatment, F.col(value))
    a = df.agg(F.count(x).alias("n0"), F.avg(x).alias("m0"), F.var_samp(x).alias("v0"), F.count(y).alias("n1"), F.avg(y).alias("m1"), F.var_samp(y).alias("v1"))
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2))
    d = (F.col("m1") - F.col("m0")) / pooled
    s0, s1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    return a.select(
        "n0", "n1", d.alias("cohens_d"), (d * (1 - 3 / (4 * (F.col("n0") + F.col("n1")) - 9))).alias("hedges_g"), ((F.col("m1") - F.col("m0")) / F.sqrt("v0")).alias("glass_delta"),
        ((F.col("m1") - F.col("m0")) / F.sqrt(s0 + s1)).alias("welch_t"), ((s0 + s1) * (s0 + s1) / (s0 * s0 / (F.col("n0") - 1) + s1 * s1 / (F.col("n1") - 1))).alias("welch_df"), magnitude(d).alias("band"),
    )


def cliffs_delta(df: DataFrame, value: str, is_treatment: Column) -> DataFrame:
    """One row: Cliff's delta from average ranks, by distributed prefix sums over distinct values instead of all pairs."""
    v = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(is_treatment).alias("t"), F.count_if(~is_treatment).alias("c"))
    low = prefix_sum(v.withColumn("g", F.lit(0)), ["g"], [F.col("v")], "c", "upto")
    # control values below count for the treatment, those above against it
    n = low.agg(F.sum("t").alias("n1"), F.sum("c").alias("n0"), F.sum(F.col("t") * (F.col("upto") - F.col("c"))).alias("wins"), F.sum(F.col("t") * F.col("c")).alias("ties"))
    pairs = F.col("n1").cast("double") * F.col("n0")
    return n.select("n0", "n1", ((2 * F.col("wins") + F.col("ties") - pairs) / pairs).alias("delta"))


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """One row per group with the linearly interpolated percentiles of ``shares`` (name: share), from counts per value and distributed prefix sums; no group's values are gathered. Null values are left out."""
    v = df.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    run = prefix_sum(v, [group], [F.col("__v")], "__c", "__upto")
    n = v.groupBy(F.col(group).alias("__g")).agg(F.sum("__c").alias("__n"))
    run = run.join(n, F.col(group).eqNullSafe(F.col("__g")))
    at = lambda q, k: F.min(F.when(F.col("__upto") > F.least(F.floor((F.col("__n") - 1) * q) + k, F.col("__n") - 1), F.col("__v")))
    part = lambda q: (F.max("__n") - 1) * q - F.floor((F.max("__n") - 1) * q)
    return run.groupBy(group).agg(*[(at(q, 0) + (at(q, 1) - at(q, 0)) * part(q)).alias(name) for name, q in shares.items()])


def kmeans(x: np.ndarray, k: int, starts: int = 10, rounds: int = 300, seed: int = 1) -> np.ndarray:
    """Clusters of the rows of ``x``: the start of least inertia among ``starts`` seeded k-means++ starts."""
    best, least = np.zeros(len(x), np.int32), np.inf
    for start in range(starts):
        rng = np.random.default_rng([seed, start])
        c = x[rng.integers(len(x))][None]
        near = ((x - c[0]) ** 2).sum(1)
        while len(c) < min(k, len(x)) and near.sum() > 0:
            c = np.concatenate([c, x[rng.choice(len(x), p=near / near.sum())][None]])
            near = np.minimum(near, ((x - c[-1]) ** 2).sum(1))
        own = None
        for _ in range(rounds):
            d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
            now = d.argmin(1)
            if own is not None and (now == own).all():
                break
            own = now
            for j in np.unique(own):
                c[j] = x[own == j].mean(0)
        inertia = ((x - c[own]) ** 2).sum()
        if inertia < least:
            best, least = own.astype(np.int32), inertia
    return best


def bootstrap_bca(diffs: DataFrame, value: str, rounds: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """One row: mean difference, BCa interval and two-sided sign p-value by the Poisson bootstrap.

    Each row draws its Poisson weight for every replicate from its own hash, so
    replicates are the same however rows are partitioned; a task keeps only
    ``rounds`` sums. The jackknife uses the closed form of the mean.
    """
    src = diffs.select(F.col(value).cast("double").alias("x")).filter("x is not null and not isnan(x)").groupBy("x").agg(F.count("*").alias("c"))

    def run(batches):
        total, weight = np.zeros(rounds), np.zeros(rounds)
        for pdf in batches:
            for x, c in zip(pdf["x"], pdf["c"]):
                rng = np.random.default_rng([seed, int(np.float64(x).view(np.uint64))])
                w = rng.poisson(float(c), rounds)
                total += w * x
                weight += w
        yield pd.DataFrame({"b": np.arange(rounds), "t": total, "w": weight})

    boots = src.mapInPandas(run, "b int, t double, w double").groupBy("b").agg((F.sum("t") / F.sum("w")).alias("m"))
    one = src.agg(F.sum("c").alias("n"), F.sum(F.col("x") * F.col("c")).alias("s")).withColumn("mean", F.col("s") / F.col("n"))
    dev = src.crossJoin(one).withColumn("u", (F.col("x") - F.col("mean")) / (F.col("n") - 1))
    acc = dev.agg(F.sum(F.col("c") * F.pow("u", F.lit(3))).alias("k3"), F.sum(F.col("c") * F.pow("u", F.lit(2))).alias("k2"), F.first("n").alias("n"), F.first("mean").alias("mean"))
    row = acc.crossJoin(boots.agg(F.sort_array(F.collect_list("m")).alias("ms")))  # ``rounds`` numbers

    def finish(batches):
        for pdf in batches:
            out = []
            for k3, k2, n, mean, ms in pdf[["k3", "k2", "n", "mean", "ms"]].itertuples(index=False):
                ms = np.array([m for m in ms if m is not None and np.isfinite(m)])
                if not n or not len(ms):
                    continue
                z0 = norm_ppf(min(0.9999, max(1e-4, float(np.mean(ms < mean) + np.mean(ms == mean) / 2))))
                a = (k3 / (6 * k2**1.5)) if k2 and k2 > 0 else 0.0
                lim = []
                for q in ((1 - level) / 2, (1 + level) / 2):
                    z = z0 + norm_ppf(q)
                    lim.append(float(np.quantile(ms, min(0.9999, max(1e-4, norm_cdf(z0 + z / (1 - a * z)))))))
                p = 2 * min(float(np.mean(ms <= 0)), float(np.mean(ms >= 0)))
                out.append((int(n), float(mean), lim[0], lim[1], min(1.0, p)))
            yield pd.DataFrame(out, columns=["n", "mean", "low", "high", "p_value"])

    return row.mapInPandas(finish, "n long, mean double, low double, high double, p_value double")


def kappa(pairs: DataFrame, weights: str = "none", levels: int = 5) -> DataFrame:
    """One row (n, observed, expected, kappa, low, high) from (a, b) rating bins 0..levels-1; weights none, linear or quadratic. Null ratings are left out."""
    g = pairs.filter("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("c"))
    gap = F.abs(F.col("a") - F.col("b")) / F.lit(float(max(1, levels - 1)))
    w = {"none": (F.col("a") == F.col("b")).cast("double"), "linear": 1 - gap, "quadratic": 1 - gap * gap}[weights]
    n = g.agg(F.sum("c").alias("n"), F.sum(F.col("c") * w).alias("o"))
    ra, rb = g.groupBy("a").agg(F.sum("c").alias("ca")), g.groupBy("b").agg(F.sum("c").alias("cb"))
    e = ra.crossJoin(rb).agg(F.sum(F.col("ca").cast("double") * F.col("cb") * w).alias("e"))  # levels x levels
    po, pe = F.col("o") / F.col("n"), F.col("e") / (F.col("n") * F.col("n").cast("double"))
    k = F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0)
    half = 1.96 * F.sqrt(F.abs(k * (1 - k)) / F.col("n"))
    return n.crossJoin(e).select("n", po.alias("observed"), pe.alias("expected"), k.alias("kappa"), (k - half).alias("low"), (k + half).alias("high"))


def fleiss(ratings: DataFrame) -> DataFrame:
    """One row (items, agreement, expected, kappa) from (item, category); items with a single rating are left out."""
    g = ratings.filter("category is not null").groupBy("item", "category").agg(F.count("*").alias("c"))
    i = g.groupBy("item").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq")).filter("n > 1")
    p = i.agg(F.count("*").alias("items"), F.avg((F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("p"))
    cat = g.join(i.select("item"), "item", "left_semi").groupBy("category").agg(F.sum("c").alias("t"))
    pe = cat.crossJoin(cat.agg(F.sum("t").alias("all"))).agg(F.sum(F.pow(F.col("t") / F.col("all"), F.lit(2))).alias("pe"))
    return p.crossJoin(pe).select("items", F.col("p").alias("agreement"), F.col("pe").alias("expected"), F.when(F.col("pe") < 1, (F.col("p") - F.col("pe")) / (1 - F.col("pe"))).otherwise(1.0).alias("kappa"))


def power(effect: float, n: int, alpha: float = 0.05) -> float:
    """Power of a two-sided two-sample test, by the normal approximation."""
    z = abs(effect) * math.sqrt(n / 2)
    c = norm_ppf(1 - alpha / 2)
    return norm_cdf(z - c) + norm_cdf(-z - c)
