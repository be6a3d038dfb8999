"""Filling fixed-capacity packs with items (problem 6).

Large-item matching: items above a third of the capacity go at most two to a
pack, each with the largest partner that fits; smaller items then fill the
remaining gaps, best fit first.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one task packs; a shard leaves at most a few packs part-filled.
SHARD_ROWS = 100_000
#: Code points per token where ``full_tokens`` is unusable.
CHARS_PER_TOKEN = 4


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The pack of each item, for sizes of at most ``capacity``; ties go by position."""
    n = len(sizes)
    pack = np.full(n, -1, np.int64)
    order = np.argsort(-sizes, kind="stable")
    large = order[sizes[order] * 3 > capacity].tolist()
    small = order[sizes[order] * 3 <= capacity].tolist()
    packs = 0
    gaps: list[tuple[int, int]] = []
    # largest first; partners wait in ascending order of size
    waiting = [(int(sizes[i]), -k, i) for k, i in enumerate(large)]
    waiting.sort()
    while waiting:
        size, _, i = waiting.pop()
        pack[i] = packs
        room = capacity - size
        at = bisect_left(waiting, (room + 1,))
        if at:
            other, _, j = waiting.pop(at - 1)
            pack[j] = packs
            room -= other
        gaps.append((room, packs))
        packs += 1
    gaps.sort()
    for i in small:
        size = int(sizes[i])
        at = bisect_left(gaps, (size,))
        if at < len(gaps):
            room, p = gaps.pop(at)
        else:
            room, p = capacity, packs
            packs += 1
        pack[i] = p
        insort(gaps, (room - size, p))
    return pack


def token_counts(chunks: DataFrame, chars_per_token: int = CHARS_PER_TOKEN) -> DataFrame:
    """(row_id, tokens): ``full_tokens`` where it is positive, else by the content's length, 0 for null content."""
    by_length = F.ceil(F.coalesce(F.length("content"), F.lit(0)) / F.lit(chars_per_token))
    return chunks.select(F.col("row_id").cast("long"), F.when(F.col("full_tokens") > 0, F.col("full_tokens")).otherwise(by_length).cast("long").alias("tokens"))


def pack(items: DataFrame, capacity: int, id_col: str = "row_id", size_col: str = "tokens", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(pack_id, id, part, tokens, total_tokens): every item in exactly one pack of at most ``capacity``.

    An item larger than the capacity is cut into parts, all but the last as
    large as a pack. Null and negative sizes count as 0. Ids shared by several
    rows are packed row by row. Items are dealt to shards of about
    ``shard_rows`` rows by hash, so hot keys do not matter, and only ids and
    sizes are shuffled. An empty table gives no packs.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    src = items.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long").alias("size"))
    shards = max(1, -(-src.count() // shard_rows))
    whole = F.expr(f"greatest(ceil(size / {capacity}), 1)")
    parts = (
        src.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), whole.cast("long") - 1)))
        .withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("part") * capacity))
        .withColumn("shard", F.pmod(F.xxhash64("id", "part"), F.lit(shards)).cast("int"))
    )
    kind = dict(src.dtypes)["id"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "part", "size"], kind="stable")
        p = fill(pdf["size"].to_numpy(), capacity)
        return pd.DataFrame(
            {"pack_id": p * shards + key[0], "id": pdf["id"], "part": pdf["part"].astype("int32"), "tokens": pdf["size"], "total_tokens": np.bincount(p, weights=pdf["size"]).astype(np.int64)[p]}
        )

    return parts.groupBy("shard").applyInPandas(run, f"pack_id long, id {kind}, part int, tokens long, total_tokens long").withColumnRenamed("id", id_col)


def pack_chunks(chunks: DataFrame, configs: DataFrame, config_id: int) -> DataFrame:
    """Packs of the ``token_budget`` of one baseline configuration; see :func:`pack`."""
    row = configs.filter(F.col("config_id") == config_id).select("token_budget").first()
    if row is None or not row[0]:
        raise ValueError(f"no token budget in configuration {config_id}")
    return pack(token_counts(chunks), int(row[0]))
