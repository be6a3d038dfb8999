"""Prefix sums and ranks that do not need one task per group.

Rows are range-partitioned by (group, order); each range sums on its own and
the ranges' totals, a few rows per group, give the offsets. A group that holds
a third of all rows spreads over a third of the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hewn.session import cut


def prefix_sum(df: DataFrame, groups: list[str], order: list[Column], value: str, name: str = "cum") -> DataFrame:
    """Adds the running sum of ``value`` within each group, in ``order`` (which must have no ties). Null groups form a group; null values count as 0."""
    return prefix_sums(df, groups, order, {name: value})


def prefix_sums(df: DataFrame, groups: list[str], order: list[Column], values: dict[str, str]) -> DataFrame:
    """As :func:`prefix_sum` for several columns at once, given by the names of their sums."""
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(parts, *[F.col(g) for g in groups], *order).withColumn("__pid", F.spark_partition_id()))
    v = {n: F.coalesce(F.col(c), F.lit(0)) for n, c in values.items()}
    own = Window.partitionBy("__pid", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    keys = [f"__g{i}" for i in range(len(groups))]
    before = Window.partitionBy(*keys).orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*[F.col(g).alias(k) for g, k in zip(groups, keys)], F.col("__pid").alias("__q")).agg(*[F.sum(x).alias(f"__t{i}") for i, x in enumerate(v.values())])
    offsets = totals.select(*keys, "__q", *[F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).alias(f"__o{i}") for i in range(len(v))])
    on = F.col("__pid") == F.col("__q")
    for g, k in zip(groups, keys):
        on = on & F.col(g).eqNullSafe(F.col(k))
    out = placed.withColumns({f"__s{i}": F.sum(x).over(own) for i, x in enumerate(v.values())}).join(offsets, on)
    sums = {n: F.col(f"__s{i}") + F.col(f"__o{i}") for i, n in enumerate(v)}
    return out.withColumns(sums).drop("__pid", "__q", *[f"__{x}{i}" for i in range(len(v)) for x in "so"], *keys)


def position(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the 1-based position of each row within its group."""
    return prefix_sum(df.withColumn("__one", F.lit(1).cast("long")), groups, order, "__one", name).drop("__one")
