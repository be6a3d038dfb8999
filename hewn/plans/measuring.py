"""Agreement, tests with p-values, resampling, checks of packs and experiments (survey groups D16, L, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hewn.functions import text
from hewn.operators.prefix import position, prefix_sum
from hewn.plans.extended import _DIFF
from hewn.plans.registry import query
from hewn.plans.relational import _paired, _ratings
from hewn.sources.tables import table

TOK = text.CHUNK_TOKENS_SQL

# The polynomial of the normal distribution's tail (error under 1e-7).
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
ROOT = 2.5066282746310002


def normal_cdf(x):
    """The normal distribution as a Column."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(TAIL):
        poly = (poly + c) * t
    tail = F.exp(-x * x / 2) / ROOT * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_sql(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    poly = "0.0"
    for c in reversed(TAIL):
        poly = f"(({poly} + {c}) * {t})"
    tail = f"(exp(-({x}) * ({x}) / 2) / {ROOT} * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


def t_as_normal(t, df):
    """A t value as a normal one (Wallace)."""
    return F.signum(t) * F.sqrt(df * F.log(1 + t * t / df)) * (8.0 * df + 1) / (8.0 * df + 3)


def t_sql(t: str, df: str) -> str:
    return f"(sign({t}) * sqrt({df} * ln(1 + ({t}) * ({t}) / {df})) * (8.0 * {df} + 1) / (8.0 * {df} + 3))"


# ---- agreement

_BINS = """s AS (SELECT pack_id, variant_id, unnest(map_entries(selection_scores)) AS e FROM (SELECT pack_id, variant_id, arg_max(selection_scores, run_id) AS selection_scores FROM selection_results GROUP BY ALL)),
r AS (SELECT pack_id, e.key AS item, least(4, greatest(0, CAST(floor(4 * e.value / m) AS INT))) AS bin FROM (SELECT *, max(e.value) OVER (PARTITION BY pack_id, variant_id) AS m FROM s WHERE e.value IS NOT NULL AND NOT isnan(e.value) AND e.value > 0))"""


@query(f"""WITH {_BINS}, u AS (SELECT pack_id, item, bin, count(*) AS c FROM r GROUP BY 1, 2, 3), m AS (SELECT pack_id, item, sum(c) AS m FROM u GROUP BY 1, 2 HAVING sum(c) > 1),
o AS (SELECT a.bin AS a, b.bin AS b, sum(a.c * (b.c - CASE WHEN a.bin = b.bin THEN 1 ELSE 0 END) / (m - 1)) AS o FROM u a JOIN u b USING (pack_id, item) JOIN m USING (pack_id, item) GROUP BY 1, 2),
n AS (SELECT a AS bin, sum(o) AS n FROM o GROUP BY 1), g AS (SELECT x.bin AS a, y.bin AS b, power(sum(z.n) - (any_value(x.n) + any_value(y.n)) / 2, 2) AS d FROM n x, n y, n z WHERE z.bin BETWEEN least(x.bin, y.bin) AND greatest(x.bin, y.bin) GROUP BY 1, 2),
t AS (SELECT sum(n) AS t FROM n)
SELECT round(any_value(t), 6)::DOUBLE AS ratings, round(sum(coalesce(o.o, 0) * g.d), 3)::DOUBLE AS observed, round(1 - (any_value(t) - 1) * sum(coalesce(o.o, 0) * g.d) / sum(x.n * y.n * g.d), 6)::DOUBLE AS alpha FROM g JOIN n x ON x.bin = g.a JOIN n y ON y.bin = g.b LEFT JOIN o ON o.a = g.a AND o.b = g.b, t""")
def d16_krippendorff(spark, d):
    """Ordinal alpha of the variants' ratings, in five bins, from the coincidence of bins within a unit; a unit has at most five bins, so no ratings are paired."""
    r = _ratings(spark, d).filter("value > 0")
    top = r.groupBy("pack_id", "variant_id").agg(F.max("value").alias("m"))
    b = r.join(top, ["pack_id", "variant_id"]).select("pack_id", "item", F.least(F.lit(4), F.greatest(F.lit(0), F.floor(4 * F.col("value") / F.col("m")).cast("int"))).alias("bin"))
    u = b.groupBy("pack_id", "item", "bin").agg(F.count("*").alias("c"))
    units = u.groupBy("pack_id", "item").agg(F.collect_list(F.struct("bin", "c")).alias("bins"), F.sum("c").alias("m")).filter("m > 1")
    pairs = units.select("m", F.explode("bins").alias("x"), "bins").select("m", "x", F.explode("bins").alias("y"))
    same = F.when(F.col("x.bin") == F.col("y.bin"), 1).otherwise(0)
    o = pairs.groupBy(F.col("x.bin").alias("a"), F.col("y.bin").alias("b")).agg(F.sum(F.col("x.c") * (F.col("y.c") - same) / (F.col("m") - 1)).alias("o"))
    n = o.groupBy(F.col("a").alias("bin")).agg(F.sum("o").alias("n"))
    # five rows from here on
    every = n.agg(F.collect_list(F.struct("bin", "n")).alias("all"), F.sum("n").alias("t"))
    g = every.select("all", "t", F.explode("all").alias("x")).select("all", "t", "x", F.explode("all").alias("y"))
    lo, hi = F.least("x.bin", "y.bin"), F.greatest("x.bin", "y.bin")
    between = F.aggregate(F.filter("all", lambda z: (z["bin"] >= lo) & (z["bin"] <= hi)), F.lit(0.0), lambda s, z: s + z["n"])
    j = g.withColumn("d", F.pow(between - (F.col("x.n") + F.col("y.n")) / 2, F.lit(2))).join(o, (F.col("a") == F.col("x.bin")) & (F.col("b") == F.col("y.bin")), "left")
    seen = F.sum(F.coalesce("o", F.lit(0.0)) * F.col("d"))
    return j.agg(F.round(F.first("t"), 6).alias("ratings"), F.round(seen, 3).alias("observed"), F.round(1 - (F.first("t") - 1) * seen / F.sum(F.col("x.n") * F.col("y.n") * F.col("d")), 6).alias("alpha"))


# ---- tests

@query(_DIFF + f""", r AS (SELECT x, rank() OVER (ORDER BY abs(x)) + (count(*) OVER (PARTITION BY abs(x)) - 1) / 2.0 AS rk FROM x WHERE x <> 0), a AS (SELECT count(*) AS n, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t FROM x),
w AS (SELECT sum(CASE WHEN x > 0 THEN rk ELSE 0 END) AS wp, count(*) AS m FROM r), z AS (SELECT n, m, t, {t_sql('t', '(n - 1.0)')} AS zt, (wp - m * (m + 1) / 4.0) / sqrt(m * (m + 1) * (2.0 * m + 1) / 24) AS zw FROM a, w)
SELECT n, round(t, 5) AS t, round(2 * (1 - {normal_sql('abs(zt)')}), 6) AS p_t, CASE WHEN m >= 6 THEN round(2 * (1 - {normal_sql('abs(zw)')}), 6) END AS p_wilcoxon FROM z""")
def l6_paired_p_values(spark, d):
    """p-values of the paired t test and, from six differences on, of Wilcoxon's, by normal approximation."""
    x = _paired(spark, d).select((F.col("b") - F.col("a")).alias("x"))
    v = x.filter("x <> 0").groupBy(F.abs("x").alias("v")).agg(F.count("*").alias("c"), F.count_if(F.col("x") > 0).alias("p"))
    r = prefix_sum(v.withColumn("g", F.lit(0)), ["g"], [F.col("v")], "c", "upto").withColumn("rk", F.col("upto") - (F.col("c") - 1) / 2)
    w = r.agg(F.sum(F.col("rk") * F.col("p")).alias("wp"), F.sum("c").alias("m"))
    a = x.agg(F.count("*").alias("n"), (F.avg("x") / (F.stddev_samp("x") / F.sqrt(F.count("*")))).alias("t")).crossJoin(w)
    m = F.col("m")
    zt, zw = t_as_normal(F.col("t"), F.col("n") - 1), (F.col("wp") - m * (m + 1) / 4) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24)
    p = lambda z: F.round(2 * (1 - normal_cdf(F.abs(z))), 6)
    return a.select("n", F.round("t", 5).alias("t"), p(zt).alias("p_t"), F.when(m >= 6, p(zw)).alias("p_wilcoxon"))


@query(_DIFF + f""", a AS (SELECT count(*) FILTER (WHERE x > 0) AS up, count(*) FILTER (WHERE x < 0) AS down FROM x) SELECT up, down, round(least(1, 2 * (1 - {normal_sql('greatest(0, (abs(up - down) - 1.0) / sqrt(greatest(1, up + down)))')})), 6) AS p FROM a""")
def l10_sign_test(spark, d):
    """The sign test of the differences, by the normal approximation with a continuity correction."""
    x = _paired(spark, d).select((F.col("b") - F.col("a")).alias("x")).agg(F.count_if(F.col("x") > 0).alias("up"), F.count_if(F.col("x") < 0).alias("down"))
    z = F.greatest(F.lit(0.0), (F.abs(F.col("up") - F.col("down")) - 1.0) / F.sqrt(F.greatest(F.lit(1), F.col("up") + F.col("down"))))
    return x.select("up", "down", F.round(F.least(F.lit(1.0), 2 * (1 - normal_cdf(z))), 6).alias("p"))


@query(f"""WITH n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderstatus)), e AS (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.2])::DOUBLE AS effect)
SELECT effect, n, round({normal_sql('(effect * sqrt(n / 2.0) - 1.959963985)')} + {normal_sql('(-effect * sqrt(n / 2.0) - 1.959963985)')}, 6) AS power FROM e, n""")
def l13_power(spark, d):
    """Power of a two-sided two-sample test at five effects, for the smallest group of orders."""
    n = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("c")).agg(F.min("c").alias("n"))
    e = n.select(F.explode(F.array(*[F.lit(x) for x in (0.01, 0.02, 0.05, 0.1, 0.2)])).alias("effect"), "n")
    z = F.col("effect") * F.sqrt(F.col("n") / 2)
    return e.select("effect", "n", F.round(normal_cdf(z - 1.959963985) + normal_cdf(-z - 1.959963985), 6).alias("power"))


@query("""WITH v AS (SELECT event_type AS g, value AS x FROM events WHERE value IS NOT NULL), m AS (SELECT g, count(*) AS n, avg(x) AS m, var_samp(x) AS v, skewness(x) AS sk FROM v GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS k, sum((n - 1) * v) / (sum(n) - count(*)) AS pooled, sum((n - 1) * ln(v)) AS lv, sum(1.0 / (n - 1)) AS inv FROM m),
z AS (SELECT g, abs(x - m) AS z FROM v JOIN m USING (g)), zm AS (SELECT g, count(*) AS n, avg(z) AS zg, var_pop(z) * count(*) AS ss FROM z GROUP BY 1), za AS (SELECT avg(z) AS za FROM z)
SELECT CAST(n AS BIGINT) AS n, k AS groups, round(((n - k) * ln(pooled) - lv) / (1 + (inv - 1.0 / (n - k)) / (3.0 * (k - 1))), 5)::DOUBLE AS bartlett, round((SELECT sum(zm.n * power(zg - za, 2)) / (count(*) - 1) / (sum(ss) / (sum(zm.n) - count(*))) FROM zm, za), 5)::DOUBLE AS levene FROM t""")
def l14_equal_variances(spark, d):
    """Bartlett's and Levene's statistics of the event types, from one aggregate row per group."""
    v = table(spark, d, "events").filter("value is not null").select(F.col("event_type").alias("g"), F.col("value").alias("x"))
    m = v.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    n1 = F.col("n") - 1
    t = m.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(n1 * F.col("v")).alias("ss"), F.sum(n1 * F.log("v")).alias("lv"), F.sum(1.0 / n1).alias("inv"))
    zm = v.join(F.broadcast(m.select("g", "m")), "g").withColumn("z", F.abs(F.col("x") - F.col("m"))).groupBy("g").agg(F.count("*").alias("zn"), F.sum("z").alias("s"), F.var_pop("z").alias("vp"))
    zt = zm.agg(F.sum("s").alias("zs"), F.sum("zn").alias("za"))
    lev = zm.crossJoin(zt).agg((F.sum(F.col("zn") * F.pow(F.col("s") / F.col("zn") - F.col("zs") / F.col("za"), F.lit(2))) / (F.count("*") - 1) / (F.sum(F.col("vp") * F.col("zn")) / (F.first("za") - F.count("*")))).alias("levene"))
    free = F.col("n") - F.col("k")
    bart = (free * F.log(F.col("ss") / free) - F.col("lv")) / (1 + (F.col("inv") - 1.0 / free) / (3.0 * (F.col("k") - 1)))
    return t.crossJoin(lev).select("n", F.col("k").alias("groups"), F.round(bart, 5).alias("bartlett"), F.round("levene", 5).alias("levene"))


@query(f"""WITH v AS (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL), m AS (SELECT event_type, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd FROM v GROUP BY 1),
c AS (SELECT event_type, any_value(n) AS n, sum(power((x - mean) / sd, 3)) / any_value(n) AS sk, sum(power((x - mean) / sd, 4)) / any_value(n) AS ku, count(*) FILTER (WHERE x >= mean) AS up, count(*) FILTER (WHERE x < mean) AS down FROM v JOIN m USING (event_type) GROUP BY 1),
f AS (SELECT event_type, 1 + count(*) FILTER (WHERE a <> b) AS runs FROM (SELECT event_type, x >= mean AS a, lag(x >= mean) OVER (PARTITION BY event_type ORDER BY i) AS b FROM v JOIN m USING (event_type)) GROUP BY 1)
SELECT event_type, n, round(sk, 5) AS skew, round(ku, 5) AS kurtosis, round(n / 6.0 * (sk * sk + power(ku - 3, 2) / 4), 3) AS jarque_bera, runs, round((runs - (2.0 * up * down / n + 1)) / sqrt(2.0 * up * down * (2.0 * up * down - n) / (1.0 * n * n * (n - 1))), 5) AS runs_z FROM c JOIN f USING (event_type)""")
def l14_normality(spark, d):
    """Skewness, kurtosis and Jarque-Bera of each group, and the runs test about its mean. Runs are counted where neighbours in a range-partitioned order change sides."""
    v = table(spark, d, "events").filter("value is not null").select("event_type", "ts", "event_id", F.col("value").alias("x"))
    m = v.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    j = v.join(F.broadcast(m), "event_type").withColumn("high", F.col("x") >= F.col("mean"))
    z = (F.col("x") - F.col("mean")) / F.col("sd")
    c = j.groupBy("event_type").agg(F.first("n").alias("n"), (F.sum(F.pow(z, F.lit(3))) / F.first("n")).alias("sk"), (F.sum(F.pow(z, F.lit(4))) / F.first("n")).alias("ku"), F.count_if("high").alias("up"), F.count_if(~F.col("high")).alias("down"))
    at = position(j.select("event_type", "ts", "event_id", "high"), ["event_type"], [F.col("ts"), F.col("event_id")], "i").select("event_type", "i", "high")
    before = at.select("event_type", (F.col("i") + 1).alias("i"), F.col("high").alias("was"))
    f = at.join(before, ["event_type", "i"]).groupBy("event_type").agg((1 + F.count_if(F.col("high") != F.col("was"))).alias("runs"))
    n, two = F.col("n"), 2.0 * F.col("up") * F.col("down")
    return c.join(f, "event_type").select(
        "event_type", "n", F.round("sk", 5).alias("skew"), F.round("ku", 5).alias("kurtosis"), F.round(n / 6.0 * (F.col("sk") * F.col("sk") + F.pow(F.col("ku") - 3, F.lit(2)) / 4), 3).alias("jarque_bera"), "runs",
        F.round((F.col("runs") - (two / n + 1)) / F.sqrt(two * (two - n) / (1.0 * n * n * (n - 1))), 5).alias("runs_z"),
    )


@query(f"""WITH a AS (SELECT count(*) FILTER (WHERE l_returnflag = 'A') AS n0, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS m0, var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS v0, count(*) FILTER (WHERE l_returnflag = 'R') AS n1, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS m1, var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS v1 FROM lineitem),
e AS (SELECT (m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) AS d, sqrt(v0 / n0 + v1 / n1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) AS se FROM a)
SELECT round(d, 6) AS effect, round(d - 1.959963985 * se, 6) AS low, round(d + 1.959963985 * se, 6) AS high, round({normal_sql('(d / se)')}, 6) AS p_positive, round({normal_sql('((d - 0.2) / se)')}, 6) AS p_target FROM e""")
def l15_bayesian(spark, d):
    """Posterior of the difference of two means under flat priors, by normal approximation: effect, 95 % interval, probabilities of more than 0 and more than .2."""
    x = table(spark, d, "lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    of = lambda g: F.when(F.col("l_returnflag") == g, F.col("l_extendedprice"))
    a = x.agg(F.count(of("A")).alias("n0"), F.avg(of("A")).alias("m0"), F.var_samp(of("A")).alias("v0"), F.count(of("R")).alias("n1"), F.avg(of("R")).alias("m1"), F.var_samp(of("R")).alias("v1"))
    sd = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2))
    e = a.select(((F.col("m1") - F.col("m0")) / sd).alias("d"), (F.sqrt(F.col("v0") / F.col("n0") + F.col("v1") / F.col("n1")) / sd).alias("se"))
    c, s = F.col("d"), F.col("se")
    return e.select(F.round(c, 6).alias("effect"), F.round(c - 1.959963985 * s, 6).alias("low"), F.round(c + 1.959963985 * s, 6).alias("high"), F.round(normal_cdf(c / s), 6).alias("p_positive"), F.round(normal_cdf((c - 0.2) / s), 6).alias("p_target"))


@query(f"""WITH s AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1), j AS (SELECT a.event_type AS left_system, b.event_type AS right_system, (b.m - a.m) / sqrt(a.v / a.n + b.v / b.n) AS t,
 power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)) AS df FROM s a JOIN s b ON a.event_type < b.event_type), p AS (SELECT *, 2 * (1 - {normal_sql('abs(' + t_sql('t', 'df') + ')')}) AS p FROM j)
SELECT left_system, right_system, round(t, 6) AS t, round(p, 6) AS p, round(least(1, p * (SELECT count(*) FROM p)), 6) AS p_adjusted FROM p""")
def l16_pairwise_tests(spark, d):
    """Welch's test of every pair of systems, corrected by the number of pairs, from one aggregate row a system."""
    s = table(spark, d, "events").filter("value is not null").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    a, b = s.alias("a"), s.alias("b")
    x, y = F.col("a.v") / F.col("a.n"), F.col("b.v") / F.col("b.n")
    two = F.lit(2)
    j = a.join(b, F.col("a.event_type") < F.col("b.event_type")).select(F.col("a.event_type").alias("left_system"), F.col("b.event_type").alias("right_system"), ((F.col("b.m") - F.col("a.m")) / F.sqrt(x + y)).alias("t"), (F.pow(x + y, two) / (F.pow(x, two) / (F.col("a.n") - 1) + F.pow(y, two) / (F.col("b.n") - 1))).alias("df"))
    p = j.withColumn("p", 2 * (1 - normal_cdf(F.abs(t_as_normal(F.col("t"), F.col("df"))))))
    return p.crossJoin(p.agg(F.count("*").alias("k"))).select("left_system", "right_system", F.round("t", 6).alias("t"), F.round("p", 6).alias("p"), F.round(F.least(F.lit(1.0), F.col("p") * F.col("k")), 6).alias("p_adjusted"))


@query(f"""WITH {_BINS.replace('SELECT pack_id, e.key AS item', 'SELECT pack_id, variant_id, e.key AS item')}, p AS (SELECT a.bin AS a, b.bin AS b FROM r a JOIN r b ON a.pack_id = b.pack_id AND a.item = b.item AND a.variant_id = 'v0c_bm25_baseline' AND b.variant_id = 'coverage_enhanced'),
o AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS po FROM p), e AS (SELECT sum(x.c * y.c) AS e FROM (SELECT a AS v, count(*) AS c FROM p GROUP BY 1) x JOIN (SELECT b AS v, count(*) AS c FROM p GROUP BY 1) y USING (v)), k AS (SELECT n, (po - e / (n * n)) / (1 - e / (n * n)) AS k FROM o, e)
SELECT n, round(k, 6)::DOUBLE AS kappa, round(k - 1.96 * sqrt(abs(k * (1 - k)) / n), 6)::DOUBLE AS low, round(k + 1.96 * sqrt(abs(k * (1 - k)) / n), 6)::DOUBLE AS high, round(k / sqrt((1 - k * k) / n), 5)::DOUBLE AS z FROM k""")
def l17_kappa_interval(spark, d):
    """Interval and z of the agreement of two variants."""
    from hewn.operators import stats
    from hewn.plans.analysis import _bins

    k = F.col("kappa")
    return stats.kappa(_bins(spark, d)).select("n", F.round(k, 6).alias("kappa"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round(k / F.sqrt((1 - k * k) / F.col("n")), 5).alias("z"))


# The Poisson distribution of mean one.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
REPLICATES = 200


@query(_DIFF + f""", b AS (SELECT unnest(range({REPLICATES})) AS b), u AS (SELECT b, x, CAST('0x' || substr(md5(pack_id || ':' || b), 1, 7) AS BIGINT) / 268435456.0 AS u FROM x, b), w AS (SELECT b, x, {" + ".join(f"CASE WHEN u >= {p} THEN 1 ELSE 0 END" for p in POISSON)} AS w FROM u),
reps AS (SELECT b, sum(w * x) * 1.0 / sum(w) AS m FROM w GROUP BY 1 HAVING sum(w) > 0), o AS (SELECT *, row_number() OVER (ORDER BY m, b) AS rn, count(*) OVER () AS n FROM reps)
SELECT any_value(n) AS replicates, round(max(CASE WHEN rn = greatest(1, CAST(floor(0.025 * n) AS BIGINT)) THEN m END), 4)::DOUBLE AS low, round(max(CASE WHEN rn = CAST(ceil(0.975 * n) AS BIGINT) THEN m END), 4)::DOUBLE AS high, round(least(1, 2 * least(avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN m >= 0 THEN 1.0 ELSE 0 END))), 6)::DOUBLE AS p FROM o""")
def l1_paired_bootstrap(spark, d):
    """Interval and two-sided p-value (L3) of the mean paired difference from Poisson weights by hash, so that the replicates are the same everywhere; l2_bootstrap_bca has ten thousand."""
    x = _paired(spark, d).select("pack_id", (F.col("b") - F.col("a")).alias("x"))
    e = x.select("pack_id", "x", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))).alias("b"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("pack_id").cast("string"), F.col("b").cast("string"))), 1, 7), 16, 10).cast("long") / 268435456.0
    w = sum((F.when(F.col("u") >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    m = e.withColumn("u", u).withColumn("w", w).groupBy("b").agg((F.sum(F.col("w") * F.col("x")) / F.nullif(F.sum("w"), F.lit(0))).alias("m")).filter("m is not null")
    o = m.agg(F.sort_array(F.collect_list("m")).alias("ms"), F.count("*").alias("n"), F.avg((F.col("m") <= 0).cast("double")).alias("a"), F.avg((F.col("m") >= 0).cast("double")).alias("c"))  # one number a replicate
    at = lambda k: F.round(F.element_at("ms", k.cast("int")), 4)
    return o.select(F.col("n").alias("replicates"), at(F.greatest(F.lit(1), F.floor(0.025 * F.col("n")))).alias("low"), at(F.ceil(0.975 * F.col("n"))).alias("high"), F.round(F.least(F.lit(1.0), 2 * F.least("a", "c")), 6).alias("p"))


# ---- checks of packs

@query("""WITH m AS (SELECT run_id, pack_id, variant_id, config_id, unnest(map_entries(chunk_modes)) AS e FROM selection_results), ids AS (SELECT DISTINCT id FROM chunks WHERE id IS NOT NULL),
s AS (SELECT pack_id, variant_id, config_id, run_id, md5(array_to_string(list_sort(list_transform(map_entries(chunk_modes), lambda x: x.key || '=' || coalesce(x.value, ''))), ',')) AS h FROM selection_results)
SELECT 'anchors' AS oracle, count(*) AS checked, count(*) FILTER (WHERE e.key NOT IN (SELECT id FROM ids)) AS violations FROM m
UNION ALL SELECT 'sections', count(*), count(*) FILTER (WHERE coalesce(e.value, '') NOT IN ('full', 'signature', 'summary')) FROM m
UNION ALL SELECT 'determinism', count(*), CAST(coalesce(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END), 0) AS BIGINT) FROM (SELECT pack_id, variant_id, config_id, count(DISTINCT h) AS k FROM s GROUP BY 1, 2, 3)""")
def o1_pack_oracles(spark, d):
    """Anchors resolve to chunks, sections have a known mode, and repeated runs of a configuration choose the same."""
    s = table(spark, d, "selection_results")
    m = s.select(F.explode("chunk_modes").alias("key", "mode"))
    ids = table(spark, d, "chunks").filter("id is not null").select(F.col("id").alias("key")).distinct().withColumn("hit", F.lit(1))
    anchors = m.join(ids, "key", "left").agg(F.lit("anchors").alias("oracle"), F.count("*").alias("checked"), F.count_if(F.col("hit").isNull()).alias("violations"))
    sections = m.agg(F.lit("sections").alias("oracle"), F.count("*").alias("checked"), F.count_if(~F.coalesce("mode", F.lit("")).isin("full", "signature", "summary")).alias("violations"))
    h = F.md5(F.array_join(F.array_sort(F.transform(F.map_entries("chunk_modes"), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit(""))))), ","))
    same = s.groupBy("pack_id", "variant_id", "config_id").agg(F.countDistinct(h).alias("k")).agg(F.lit("determinism").alias("oracle"), F.count("*").alias("checked"), F.count_if(F.col("k") > 1).alias("violations"))
    return anchors.unionByName(sections).unionByName(same)


def _select_sql(source: str, limit: int = 2000, score: str = "s") -> str:
    return f"(SELECT repo_name, row_id FROM (SELECT repo_name, row_id, sum(t) OVER (PARTITION BY repo_name ORDER BY {score} DESC, row_id ROWS UNBOUNDED PRECEDING) AS cum FROM {source}) WHERE cum <= {limit})"


_BASE = f"b AS (SELECT repo_name, row_id, {TOK} AS t, coalesce(centrality_score, 0) AS s FROM chunks WHERE repo_name IS NOT NULL), base AS {_select_sql('b')}"
_CHANGED = {
    "added_last": "(SELECT * FROM b UNION ALL SELECT repo_name, max(row_id) + 1000000000, 10, -1.0 FROM b GROUP BY 1)",
    "scaled": "(SELECT repo_name, row_id, t, s * 2 AS s FROM b)",
    "unchosen_removed": "(SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.row_id = b.row_id))",
    "unchosen_repeated": "(SELECT * FROM b UNION ALL SELECT b.repo_name, b.row_id + 1000000000, b.t, b.s - 2 FROM b JOIN last l ON l.row_id = b.row_id)",
    "reordered": "(SELECT * FROM b ORDER BY md5(CAST(row_id AS VARCHAR)))",
}


@query(f"WITH {_BASE}, last AS (SELECT repo_name, arg_min(row_id, struct_pack(a := s, b := -row_id)) AS row_id FROM b WHERE row_id NOT IN (SELECT row_id FROM base) GROUP BY 1), larger AS {_select_sql('b', 4000)}, " + ", ".join(f"x_{k} AS {_select_sql(v)}" for k, v in _CHANGED.items()) + " "
       + " UNION ALL ".join(f"SELECT '{k}' AS relation, (SELECT count(*) FROM (SELECT row_id FROM base WHERE row_id NOT IN (SELECT row_id FROM x_{k}))) AS lost, (SELECT count(*) FROM (SELECT row_id FROM x_{k} WHERE row_id NOT IN (SELECT row_id FROM base))) AS gained" for k in _CHANGED)
       + " UNION ALL SELECT 'larger_budget', (SELECT count(*) FROM base WHERE row_id NOT IN (SELECT row_id FROM larger)), (SELECT count(*) FROM larger WHERE row_id NOT IN (SELECT row_id FROM base))")
def o3_metamorphic(spark, d):
    """Six relations that a selection must keep: what it loses and gains when a worst chunk is added, scores are scaled, a chunk outside it is removed or repeated below, rows come in another order, or the budget grows."""
    from hewn.operators import budget

    b = table(spark, d, "chunks").filter("repo_name is not null").select("repo_name", "row_id", text.chunk_tokens().alias("t"), F.coalesce("centrality_score", F.lit(0.0)).alias("s"))

    def chosen(df, limit=2000):
        r = position(df, ["repo_name"], [F.desc("s"), F.col("row_id")])
        return budget.break_greedy(r, "repo_name", "rank", "t", limit).select("row_id")

    base = chosen(b)
    last = b.join(base, "row_id", "left_anti").groupBy("repo_name").agg(F.min_by("row_id", F.struct(F.col("s"), -F.col("row_id"))).alias("row_id")).select("row_id")
    worst = b.groupBy("repo_name").agg((F.max("row_id") + 1_000_000_000).alias("row_id")).select("repo_name", "row_id", F.lit(10).cast("long").alias("t"), F.lit(-1.0).alias("s"))
    again = b.join(last, "row_id", "left_semi").select("repo_name", (F.col("row_id") + 1_000_000_000).alias("row_id"), "t", (F.col("s") - 2).alias("s"))
    changed = {
        "added_last": b.unionByName(worst), "scaled": b.withColumn("s", F.col("s") * 2), "unchosen_removed": b.join(last, "row_id", "left_anti"), "unchosen_repeated": b.unionByName(again), "reordered": b.repartition(F.md5(F.col("row_id").cast("string"))),
    }
    out = None
    for name, x in [*((k, chosen(v)) for k, v in changed.items()), ("larger_budget", chosen(b, 4000))]:
        both = base.withColumn("a", F.lit(1)).join(x.withColumn("b", F.lit(1)), "row_id", "full")
        row = both.agg(F.lit(name).alias("relation"), F.count_if(F.col("b").isNull()).alias("lost"), F.count_if(F.col("a").isNull()).alias("gained"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH p AS (SELECT repo_name, row_id, id, rel_path, start_line, end_line, t FROM (SELECT *, {TOK} AS t, sum({TOK}) OVER (PARTITION BY repo_name ORDER BY coalesce(centrality_score, 0) DESC, row_id ROWS UNBOUNDED PRECEDING) AS cum FROM chunks) WHERE cum <= 2000)
SELECT repo_name, count(*) AS sections, CAST(sum(t) AS BIGINT) AS tokens, count(*) - count(DISTINCT id) AS repeated_ids, count(*) FILTER (WHERE end_line < start_line) AS bad_lines, sum(t) <= 2000 AS within, count(*) FILTER (WHERE rel_path IS NULL OR rel_path = '') AS no_path FROM p GROUP BY 1""")
def o4_pack_invariants(spark, d):
    """Invariants of each pack: token sum, ids once, line ranges, paths."""
    from hewn.plans.relational import e2_greedy_break

    p = e2_greedy_break(spark, d).select("row_id").join(table(spark, d, "chunks").select("repo_name", "row_id", "id", "rel_path", "start_line", "end_line", text.chunk_tokens().alias("t")), "row_id")
    return p.groupBy("repo_name").agg(
        F.count("*").alias("sections"), F.sum("t").alias("tokens"), (F.count("*") - F.countDistinct("id")).alias("repeated_ids"), F.count_if(F.col("end_line") < F.col("start_line")).alias("bad_lines"), (F.sum("t") <= 2000).alias("within"),
        F.count_if(F.col("rel_path").isNull() | (F.col("rel_path") == "")).alias("no_path"),
    )


@query("""WITH q AS (SELECT item_id, coalesce(lower(difficulty), 'none') AS k, md5(CAST(item_id AS VARCHAR)) AS h FROM qa_items), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY h, item_id) AS rn FROM q), t(k, w) AS (VALUES ('easy', 0.4), ('medium', 0.5), ('hard', 0.1)),
a AS (SELECT item_id, h FROM r JOIN t USING (k) WHERE rn <= floor(150 * w)), rest AS (SELECT item_id, h, row_number() OVER (ORDER BY h, item_id) AS rn FROM q WHERE item_id NOT IN (SELECT item_id FROM a)),
u AS (SELECT item_id, h, false AS topped_up FROM a UNION ALL SELECT item_id, h, true FROM rest WHERE rn <= 150 - (SELECT count(*) FROM a)) SELECT item_id, topped_up, row_number() OVER (ORDER BY md5(h), item_id) AS place FROM u""")
def o11_task_balance(spark, d):
    """150 annotation tasks: the floor of each difficulty's share, topped up by hash where a stratum is short, in shuffled order."""
    q = table(spark, d, "qa_items").select("item_id", F.coalesce(F.lower("difficulty"), F.lit("none")).alias("k"), F.md5(F.col("item_id").cast("string")).alias("h"))
    t = spark.createDataFrame([("easy", 0.4), ("medium", 0.5), ("hard", 0.1)], "k string, w double")
    a = position(q, ["k"], [F.col("h"), F.col("item_id")], "rn").join(F.broadcast(t), "k").filter(F.col("rn") <= F.floor(150 * F.col("w"))).select("item_id", "h", F.lit(False).alias("topped_up"))
    rest = position(q.join(a.select("item_id"), "item_id", "left_anti").withColumn("g", F.lit(0)), ["g"], [F.col("h"), F.col("item_id")], "rn")
    more = rest.crossJoin(a.agg((150 - F.count("*")).alias("open"))).filter("rn <= open").select("item_id", "h", F.lit(True).alias("topped_up"))
    return position(a.unionByName(more).withColumn("g", F.lit(0)).withColumn("o", F.md5("h")), ["g"], [F.col("o"), F.col("item_id")], "place").select("item_id", "topped_up", "place")


@query("""WITH s AS (SELECT pack_id, variant_id, unnest(map_entries(selection_scores)) AS e FROM (SELECT pack_id, variant_id, arg_max(selection_scores, run_id) AS selection_scores FROM selection_results GROUP BY ALL)), r AS (SELECT pack_id, variant_id, e.key AS item, e.value AS v FROM s WHERE e.value IS NOT NULL AND NOT isnan(e.value)),
j AS (SELECT a.item, CAST('0x' || substr(md5(a.pack_id || ':' || a.item), 1, 1) AS INT) % 2 = 0 AS flip, CASE WHEN a.v > b.v THEN 'control' WHEN b.v > a.v THEN 'treatment' ELSE 'tie' END AS winner FROM r a JOIN r b USING (pack_id, item) WHERE a.variant_id = 'v0c_bm25_baseline' AND b.variant_id = 'coverage_enhanced')
SELECT winner, count(*) AS items, count(*) FILTER (WHERE (winner = 'control') <> flip) AS shown_first, round(count(*) * 1.0 / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM j GROUP BY 1""")
def o13_blind_comparison(spark, d):
    """Which of two variants scores a chunk higher, with the side on which a blind judge would see it drawn by hash."""
    r = _ratings(spark, d)
    side = lambda v, n: r.filter(F.col("variant_id") == v).select("pack_id", "item", F.col("value").alias(n))
    j = side("v0c_bm25_baseline", "x").join(side("coverage_enhanced", "y"), ["pack_id", "item"])
    flip = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("pack_id").cast("string"), "item")), 1, 1), 16, 10).cast("int") % 2 == 0
    w = j.select(F.when(F.col("x") > F.col("y"), "control").when(F.col("y") > F.col("x"), "treatment").otherwise("tie").alias("winner"), flip.alias("flip"))
    g = w.groupBy("winner").agg(F.count("*").alias("items"), F.count_if((F.col("winner") == "control") != F.col("flip")).alias("shown_first"))
    return g.crossJoin(g.agg(F.sum("items").alias("t"))).select("winner", "items", "shown_first", F.round(F.col("items") / F.col("t"), 6).alias("share"))


@query("""WITH m AS (SELECT variant_id, avg(coverage_score) AS c, stddev_samp(coverage_score) AS s, count(*) AS n, avg(CASE WHEN budget_utilization > 1.05 THEN 1.0 ELSE 0 END) AS over FROM selection_results WHERE coverage_score BETWEEN 0 AND 1 GROUP BY 1),
k AS (SELECT variant_id, round(least(1, 0.4 * least(1, s / c) + 0.3 * least(1, over * 5) + 0.2 * greatest(0, (20 - n) / 20.0) + 0.1 * greatest(0, (0.6 - c) / 0.6)), 6)::DOUBLE AS risk FROM m) SELECT variant_id, risk, CASE WHEN risk < 0.3 THEN 'low' WHEN risk < 0.6 THEN 'medium' WHEN risk < 0.8 THEN 'high' ELSE 'critical' END AS level FROM k""")
def o14_risk_levels(spark, d):
    """Risk of promoting a variant from spread, overruns, few runs and low coverage (.4, .3, .2, .1), and its level."""
    m = table(spark, d, "selection_results").filter("coverage_score between 0 and 1").groupBy("variant_id").agg(F.avg("coverage_score").alias("c"), F.stddev_samp("coverage_score").alias("s"), F.count("*").alias("n"), F.avg(F.when(F.col("budget_utilization") > 1.05, 1.0).otherwise(0.0)).alias("over"))
    one, zero = F.lit(1.0), F.lit(0.0)
    risk = F.least(one, 0.4 * F.least(one, F.col("s") / F.col("c")) + 0.3 * F.least(one, F.col("over") * 5) + 0.2 * F.greatest(zero, (20 - F.col("n")) / 20.0) + 0.1 * F.greatest(zero, (0.6 - F.col("c")) / 0.6))
    r = F.col("risk")
    return m.select("variant_id", F.round(risk, 6).alias("risk")).withColumn("level", F.when(r < 0.3, "low").when(r < 0.6, "medium").when(r < 0.8, "high").otherwise("critical"))


@query("""WITH r AS (SELECT pack_id, variant_id, arg_max(struct_pack(t := total_tokens, i := iterations, c := config_id), run_id) AS r FROM selection_results GROUP BY 1, 2), a AS (SELECT pack_id, r FROM r WHERE variant_id = 'v0c_bm25_baseline'), b AS (SELECT pack_id, r FROM r WHERE variant_id = 'coverage_enhanced')
SELECT coalesce(a.pack_id, b.pack_id) AS pack_id, CASE WHEN a.pack_id IS NULL THEN 'only_right' WHEN b.pack_id IS NULL THEN 'only_left' ELSE array_to_string(list_filter([CASE WHEN a.r.t IS DISTINCT FROM b.r.t THEN 'tokens' END, CASE WHEN a.r.i IS DISTINCT FROM b.r.i THEN 'iterations' END, CASE WHEN a.r.c IS DISTINCT FROM b.r.c THEN 'config' END], lambda x: x IS NOT NULL), ',') END AS difference FROM a FULL JOIN b USING (pack_id)""")
def o15_experiment_diff(spark, d):
    """Two experiments compared by key: what differs in each pack, or which side lacks it; nulls equal nulls."""
    r = table(spark, d, "selection_results").groupBy("pack_id", "variant_id").agg(F.max_by(F.struct(F.col("total_tokens").alias("t"), F.col("iterations").alias("i"), F.col("config_id").alias("c")), "run_id").alias("r"))
    a, b = (r.filter(F.col("variant_id") == v).select("pack_id", F.col("r").alias(n), F.lit(1).alias(f"has_{n}")) for v, n in (("v0c_bm25_baseline", "x"), ("coverage_enhanced", "y")))
    j = a.join(b, "pack_id", "full")
    other = lambda k: ~F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    parts = F.array_join(F.array(F.when(other("t"), "tokens"), F.when(other("i"), "iterations"), F.when(other("c"), "config")), ",")
    return j.select("pack_id", F.when(F.col("has_x").isNull(), "only_right").when(F.col("has_y").isNull(), "only_left").otherwise(parts).alias("difference"))


@query("""WITH b AS (SELECT variant_id, least(9, CAST(floor(coverage_score * 10) AS INT)) AS coverage_bucket, least(9, CAST(floor(budget_utilization * 10) AS INT)) AS use_bucket FROM selection_results WHERE coverage_score BETWEEN 0 AND 1 AND budget_utilization BETWEEN 0 AND 10)
SELECT 'heat' AS chart, NULL::VARCHAR AS variant_id, coverage_bucket AS x, use_bucket AS y, count(*) AS n FROM b GROUP BY 3, 4 UNION ALL SELECT 'breakdown', variant_id, coverage_bucket, NULL, count(*) FROM b GROUP BY 2, 3""")
def o16_charts(spark, d):
    """Rows of a heat map (coverage by use of the budget, in tenths) and of a breakdown by variant."""
    s = table(spark, d, "selection_results").filter("coverage_score between 0 and 1 and budget_utilization between 0 and 10")
    ten = lambda c: F.least(F.lit(9), F.floor(F.col(c) * 10).cast("int"))
    b = s.select("variant_id", ten("coverage_score").alias("x"), ten("budget_utilization").alias("y"))
    heat = b.groupBy("x", "y").agg(F.count("*").alias("n")).select(F.lit("heat").alias("chart"), F.lit(None).cast("string").alias("variant_id"), "x", "y", "n")
    return heat.unionByName(b.groupBy("variant_id", "x").agg(F.count("*").alias("n")).select(F.lit("breakdown").alias("chart"), "variant_id", "x", F.lit(None).cast("int").alias("y"), "n"))
