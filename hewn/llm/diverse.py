"""Choosing a varied subset (problem 1).

Lazy greedy maximisation of a weighted facility-location objective in rounds:
hash partitions of bounded size nominate candidates, each of which carries the
weight of the rows it stands for; rounds repeat while candidates are too many
for one task, and a final greedy pass selects the subset.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hewn.llm.vectors import valid_vectors
from hewn.session import cut

#: Rows of a nominating partition, and candidates of the final pass.
PART_ROWS, FINAL_ROWS = 2_048, 4_096


def lazy_greedy(x: np.ndarray, mass: np.ndarray, k: int) -> tuple[list[int], list[float], np.ndarray]:
    """Chosen rows, their gains, and the chosen row that stands for each row, under f(S) = sum_i mass_i max_{j in S} max(0, x_i x_j). Similarities of more than FINAL_ROWS rows are computed row by row as they are asked for."""
    n = len(x)
    best, by = np.zeros(n, np.float32), np.full(n, -1)
    weight = mass.astype(np.float32)
    if n <= FINAL_ROWS:
        whole = np.maximum(x @ x.T, 0)
        row, first = whole.__getitem__, whole @ weight
    else:
        row = lambda i: np.maximum(x @ x[i], 0)
        first = np.concatenate([np.maximum(x[lo : lo + 1024] @ x.T, 0) @ weight for lo in range(0, n, 1024)])
    heap = [(-g, i) for i, g in enumerate(first.tolist())]
    heapq.heapify(heap)
    fresh = np.zeros(n, np.int64)
    chosen, gains = [], []
    while heap and len(chosen) < min(k, n):
        gain, i = heapq.heappop(heap)
        if fresh[i] < len(chosen):
            now = float(weight @ np.maximum(row(i) - best, 0))
            fresh[i] = len(chosen)
            heapq.heappush(heap, (-now, i))
            continue
        s = row(i)
        better = (s > best) | (by < 0)
        by[better] = len(chosen)
        best = np.maximum(best, s)
        chosen.append(i)
        gains.append(-gain)
    return chosen, gains, by


def _placed(raw: list[bytes], spaces: list[str], offsets: dict[str, tuple[int, int]], width: int) -> np.ndarray:
    """Vectors of all models side by side, so that vectors of different models have no similarity."""
    x = np.zeros((len(raw), width), np.float32)
    for i, (b, s) in enumerate(zip(raw, spaces)):
        o, n = offsets[s]
        x[i, o : o + n] = np.frombuffer(b, "<f4")
    return x


def choose(embeddings: DataFrame, chunks: DataFrame, size: int = 500) -> DataFrame:
    """(chunk_id, kind, rank, gain, diversity_score): ``size`` chunks that cover the variety of the valid vectors.

    A chunk counts once, with its vector of the most frequent model. A row
    weighs one over the root of its kind's count, so that large kinds do not
    take most places; rows without a chunk or kind form a kind of their own.
    Ties go to the lower ``vec_id``. ``diversity_score`` is one minus the mean
    similarity of the chosen pairs. Fewer valid vectors than ``size`` are all
    chosen; an empty table gives no rows. A task holds at most FINAL_ROWS or four
    times ``size`` rows, so the memory of the final pass follows the asked size alone.
    """
    if size < 1:
        raise ValueError("size must be positive")
    spark = embeddings.sparkSession
    none = spark.createDataFrame([], "vec_id long, content_sha string, embedding_dimension int, embedding_data binary, model_name string, model_version string")
    valid = valid_vectors(embeddings.select("vec_id", "content_sha", "embedding", "model_name", "model_version"), none).drop("sha")
    vectors = valid.join(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce("chunk_id", F.concat(F.lit("vec:"), F.col("vec_id").cast("string"))).alias("chunk_id")), "vec_id")
    vectors = cut(vectors)
    sizes = {r["space"]: r["n"] for r in vectors.groupBy("space").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "chunk_id string, kind string, rank int, gain double, diversity_score double")
    offsets, width = {}, 0
    for s in sorted(sizes):
        n = int(s.rsplit("\x1f", 1)[1])
        offsets[s], width = (width, n), width + n
    order = F.lit(0)
    for s, n in sizes.items():
        order = F.when(F.col("space") == s, F.lit(n)).otherwise(order)
    one = vectors.groupBy("chunk_id").agg(F.max_by(F.struct("vec_id", "space", "vec"), F.struct(order, -F.col("vec_id"))).alias("v")).select("chunk_id", "v.*")
    kinds = chunks.filter("id is not null").groupBy(F.col("id").alias("chunk_id")).agg(F.max_by(F.lower(F.trim("kind")), F.struct("ingested_at", "row_id")).alias("kind"))
    rows = cut(one.join(kinds, "chunk_id", "left").withColumn("kind", F.coalesce("kind", F.lit("none"))))
    share = rows.groupBy("kind").agg((1 / F.sqrt(F.count("*"))).alias("mass"))
    pool = rows.join(share, "kind").select("chunk_id", "kind", "vec_id", "space", "vec", "mass")
    schema = "chunk_id string, kind string, vec_id long, space string, vec binary, mass double"

    def nominate(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        x = _placed(group["vec"].to_pylist(), group["space"].to_pylist(), offsets, width)
        mass = group["mass"].to_numpy()
        chosen, _, by = lazy_greedy(x, mass, size)
        carried = np.bincount(by, weights=mass, minlength=len(chosen))
        out = group.select(["chunk_id", "kind", "vec_id", "space", "vec"]).take(pa.array(chosen))
        return out.append_column("mass", pa.array(carried))

    def final(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        x = _placed(group["vec"].to_pylist(), group["space"].to_pylist(), offsets, width)
        chosen, gains, _ = lazy_greedy(x, group["mass"].to_numpy(), size)
        m = len(chosen)
        s = np.maximum(x[chosen] @ x[chosen].T, 0)
        score = 1.0 - (float(s.sum()) - float(np.trace(s))) / (m * (m - 1)) if m > 1 else 1.0
        out = group.select(["chunk_id", "kind"]).take(pa.array(chosen))
        return (
            out.append_column("rank", pa.array(range(1, m + 1), pa.int32())).append_column("gain", pa.array(gains, pa.float64())).append_column("diversity_score", pa.array([score] * m))
        )

    n, level = sum(r["count"] for r in rows.groupBy().count().collect()), 0
    while n > max(FINAL_ROWS, 4 * size):
        parts = -(-n // max(PART_ROWS, 4 * size))
        pool = cut(pool.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(level)), F.lit(parts))).groupBy("part").applyInArrow(_by_columns(nominate), schema))
        n, level = pool.count(), level + 1
    return pool.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(_by_columns(final), "chunk_id string, kind string, rank int, gain double, diversity_score double")


def _by_columns(f):
    return lambda table: f(table.combine_chunks())
