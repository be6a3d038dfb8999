"""Diversity-aware greedy selection, exact over all candidates.

Every step is one pass over the rows: the running similarity to what has been
chosen is a column, the best row of each group comes from one aggregation with
map-side combine, and no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hewn.functions.text import cosine
from hewn.session import cut


def greedy_diverse(items: DataFrame, k: int, kind: str = "mmr", budget: int | None = None, trade: float = 0.7) -> DataFrame:
    """(grp, id, step, gain) of up to ``k`` rows per group from (grp, id, quality, tokens, vec).

    mmr: ``trade * quality - (1 - trade) * s``, halved where s > 0.8; facility:
    ``(trade * quality + (1 - trade) * (1 - s)) / tokens``; s is the largest cosine to
    a chosen row. With ``budget`` only rows that still fit compete. Ties go to
    the lower id. Null vectors have similarity 0, null quality counts 0.
    """
    pool = items.select("grp", "id", F.coalesce("quality", F.lit(0.0)).alias("quality"), F.greatest(F.coalesce("tokens", F.lit(1)), F.lit(1)).cast("long").alias("tokens"), "vec")
    pool = cut(pool.withColumn("s", F.lit(0.0)).withColumn("used", F.lit(0).cast("long")))
    s = F.col("s")
    mmr = trade * F.col("quality") - (1 - trade) * s
    gain = F.when(s > 0.8, mmr * 0.5).otherwise(mmr) if kind == "mmr" else (trade * F.col("quality") + (1 - trade) * (1 - s)) / F.col("tokens")
    out = None
    for step in range(1, k + 1):
        fits = pool.filter(F.col("used") + F.col("tokens") <= budget) if budget is not None else pool
        best = cut(
            fits.withColumn("gain", gain).groupBy("grp").agg(F.max_by(F.struct("id", "vec", "tokens", "gain"), F.struct(F.round("gain", 9), -F.col("id"))).alias("b"))
        )
        if best.isEmpty():
            break
        made = best.select("grp", F.col("b.id").alias("id"), F.lit(step).alias("step"), F.col("b.gain").alias("gain"))
        out = made if out is None else out.unionByName(made)
        chosen = best.select(F.col("grp").alias("g"), F.col("b.id").alias("cid"), F.col("b.vec").alias("cvec"), F.col("b.tokens").alias("ctok"))
        near = F.when(F.col("vec").isNull() | F.col("cvec").isNull(), 0.0).otherwise(cosine(F.col("vec"), F.col("cvec")))
        pool = pool.join(chosen, F.col("grp").eqNullSafe(F.col("g"))).filter("id != cid")
        pool = pool.select("grp", "id", "quality", "tokens", "vec", F.greatest(s, near).alias("s"), (F.col("used") + F.col("ctok")).alias("used"))
        if step % 4 == 0:
            pool = cut(pool, looped=True)
    return out if out is not None else items.sparkSession.createDataFrame([], "grp string, id long, step int, gain double")


def distance(a, b):
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, t: s + t))


def two_mode_diverse(items: DataFrame, k: int, budget: int, coverage: float = 0.7) -> DataFrame:
    """(grp, id, step, mode, tokens, score) of up to ``k`` rows per group, each in full or as its signature.

    Needs (grp, id, key, full_tokens, signature_tokens, weight, feature, places): ``feature`` is
    the row's vector, ``places`` its centroids (one or more arrays, of its file, its cluster), ``key`` breaks ties. The score is
    ``(coverage * c + (1 - coverage) * (1 - s)) * weight / tokens``: s is the largest
    cosine to a chosen row, c the mean over the centroids of the least distance to those of chosen rows; both are 1
    at first. Of equal scores the full form goes first, then the lower key.
    """
    n = F.size("places")
    pool = items.select("grp", "id", "key", "full_tokens", "signature_tokens", "weight", "feature", "places")
    pool = cut(pool.withColumn("s", F.lit(0.0)).withColumn("near", F.transform("places", lambda x: F.lit(1.0))).withColumn("used", F.lit(0).cast("long")))
    gain = (coverage * F.aggregate("near", F.lit(0.0), lambda a, x: a + x) / n + (1 - coverage) * (1 - F.col("s"))) * F.col("weight")
    out = None
    for step in range(1, k + 1):
        form = lambda m: F.when(F.col("used") + F.col(f"{m}_tokens") <= budget, F.round(gain / F.greatest(f"{m}_tokens", F.lit(1)), 9))
        full, sig = form("full"), form("signature")
        as_sig = full.isNull() | (sig > full)
        best_form = F.struct(F.when(as_sig, "signature").otherwise("full").alias("mode"), F.when(as_sig, F.col("signature_tokens")).otherwise(F.col("full_tokens")).alias("tokens"), F.greatest(full, sig).alias("score"))
        fits = pool.withColumn("form", best_form).filter("form.score is not null")
        best = cut(fits.groupBy("grp").agg(F.min_by(F.struct("id", "feature", "places", "form"), F.struct(-F.col("form.score"), F.col("key"), F.col("id"))).alias("b")))
        if best.isEmpty():
            break
        made = best.select("grp", "b.id", F.lit(step).alias("step"), "b.form.mode", F.col("b.form.tokens").cast("long").alias("tokens"), "b.form.score")
        out = made if out is None else out.unionByName(made)
        chosen = best.select(F.col("grp").alias("g"), F.col("b.id").alias("cid"), F.col("b.feature").alias("cf"), F.col("b.places").alias("cp"), F.col("b.form.tokens").alias("ct"))
        pool = pool.join(chosen, F.col("grp").eqNullSafe(F.col("g"))).filter("id != cid")
        far = F.zip_with(F.col("places"), F.col("cp"), distance)
        near = far if step == 1 else F.zip_with("near", far, lambda x, y: F.least(x, y))
        pool = pool.select("grp", "id", "key", "full_tokens", "signature_tokens", "weight", "feature", "places", F.greatest("s", cosine(F.col("feature"), F.col("cf"))).alias("s"), near.alias("near"), (F.col("used") + F.col("ct")).alias("used"))
        if step % 4 == 0:
            pool = cut(pool, looped=True)
    return out if out is not None else items.sparkSession.createDataFrame([], "grp string, id long, step int, mode string, tokens long, score double")


def density(items: DataFrame) -> DataFrame:
    """Adds ``density``: score per token, at least one token."""
    return items.withColumn("density", F.col("score") / F.greatest(F.col("tokens"), F.lit(1)))
