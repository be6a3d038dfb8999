"""Link analysis over edge tables (src, dst): PageRank in its several forms, and control graphs.

Each step is one join of the edges with the current ranks and one aggregation
with map-side combine; lineage is cut every few steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hewn.session import cut, kept

CUT_EVERY = 5


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges without null ends."""
    return edges.select("src", "dst").filter("src is not null and dst is not null").distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def pagerank(
    nodes: DataFrame, edges: DataFrame, damping: float = 0.85, steps: int = 10, teleport: DataFrame | None = None, start: DataFrame | None = None, dangling: bool = False
) -> DataFrame:
    """(node, rank) after ``steps`` steps.

    Without ``teleport`` (node, share) every node restarts alike; without
    ``start`` (node, rank) all begin alike. Mass of nodes without outgoing edges
    is lost, as in the plain form, unless ``dangling`` spreads it. Edges to
    unknown nodes are left out; an empty node table gives no rows.
    """
    nodes = cut(nodes.select("node").filter("node is not null").distinct())
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("rank", F.lit(0.0))
    e = clean_edges(edges)
    e = e.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # every node's outgoing edges and restart share lie in one partition by node, in which all steps find them:
    # a step shuffles one number per node and partition of the edges, and neither edges nor ranks
    base = nodes.withColumn("base", F.lit((1 - damping) / n))
    if teleport is not None:
        base = nodes.join(teleport, "node", "left").select("node", ((1 - damping) * F.coalesce("share", F.lit(0.0))).alias("base"))
    first = nodes.withColumn("first", F.lit(1.0 / n)) if start is None else nodes.join(start, "node", "left").select("node", F.coalesce("rank", F.lit(0.0)).alias("first"))
    base = kept(base.join(first, "node").repartition(parts, "node"))
    heavy = e.groupBy("src").agg((1.0 / F.count("*")).alias("w"))
    e = kept(e.join(heavy, "src").repartition(parts, "src"))
    rank = base.select("node", F.col("first").alias("rank"))
    outs = e.select(F.col("src").alias("node")).distinct() if dangling else None
    for step in range(steps):
        got = e.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        new = F.col("base") + damping * F.coalesce("got", F.lit(0.0))
        if dangling:
            lost = rank.join(outs, "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)))
            new = new + damping * F.col("lost") / n
            rank = base.join(got, "node", "left").crossJoin(F.broadcast(lost.toDF("lost"))).select("node", new.alias("rank"))
        else:
            rank = base.join(got, "node", "left").select("node", new.alias("rank"))
        if (step + 1) % CUT_EVERY == 0 or step + 1 == steps or dangling:
            rank = cut(rank, looped=True)
    base.unpersist()
    e.unpersist()
    return rank


def teleport_to(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, weight: float = 0.5, alpha: float = 0.5) -> DataFrame:
    """(node, share): (1-alpha)/N for all, ``alpha`` shared by seeds (weight 1) and their neighbours (``weight``), normalised."""
    n = nodes.count()
    s = seeds.select("node").distinct()
    both = edges.select("src", "dst").unionByName(reversed_edges(edges).select("src", "dst"))
    near = both.join(s.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"), F.lit(weight).alias("w"))
    w = s.withColumn("w", F.lit(1.0)).unionByName(near).groupBy("node").agg(F.max("w").alias("w"))
    total = w.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0] or 1.0
    raw = nodes.join(w, "node", "left").select("node", ((1 - alpha) / n + alpha * F.coalesce("w", F.lit(0.0)) / total).alias("share"))
    return raw.crossJoin(raw.agg(F.sum("share").alias("t"))).select("node", (F.col("share") / F.col("t")).alias("share"))


def apply_delta(edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges after a change: removed ones out, added ones in, each once."""
    return clean_edges(edges).join(removed, ["src", "dst"], "left_anti").unionByName(clean_edges(added)).distinct()


def incremental_pagerank(nodes: DataFrame, edges: DataFrame, old: DataFrame, touched: DataFrame, damping: float = 0.85, sweeps: int = 5) -> DataFrame:
    """Ranks after a change, re-computed for the touched nodes and their direct successors only, in a few sweeps."""
    n = nodes.count()
    e = clean_edges(edges)
    e = cut(e.join(e.groupBy("src").agg((1.0 / F.count("*")).alias("w")), "src"))
    succ = e.join(touched.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"))
    affected = cut(touched.select("node").unionByName(succ).distinct().join(nodes, "node", "left_semi"))
    inward = cut(e.join(affected.select(F.col("node").alias("dst")), "dst", "left_semi"))
    rank = cut(nodes.join(old, "node", "left").withColumn("rank", F.coalesce("rank", F.lit(1.0 / n))))
    for _ in range(sweeps):
        got = inward.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        new = affected.join(got, "node", "left").select("node", ((1 - damping) / n + damping * F.coalesce("got", F.lit(0.0))).alias("new"))
        rank = cut(rank.join(new, "node", "left").select("node", F.coalesce("new", "rank").alias("rank")), looped=True)
    return rank


def shuffled(edges: DataFrame, seed: int) -> DataFrame:
    """A control graph: each edge keeps its source and gets the target of the edge at its place in another hash order; degrees stay alike."""
    from hewn.operators.prefix import position

    key = lambda s: F.md5(F.concat(F.col("src").cast("string"), F.lit("-"), F.col("dst").cast("string"), F.lit(f":{s}")))
    one = lambda s: position(edges.select("src", "dst", F.lit(0).alias("g"), key(s).alias("k")), ["g"], [F.col("k"), F.col("src"), F.col("dst")], "i")
    return one(seed).select("i", "src").join(one(seed + 1).select("i", "dst"), "i").select("src", "dst")


def blend(score: Column, rank: Column, weight: float = 0.15) -> Column:
    return (1 - weight) * score + weight * rank
