"""One ranking from several differently-scaled scores (problem 7).

A Markov chain walks over the items: it picks one of the scores and jumps to an
item ranked strictly higher on it, each alike; with the rest of the damping it
jumps anywhere. The stationary share of an item is its merit. One step needs
only prefix sums over each score's order, never the scores' sizes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hewn.session import cut, discard, kept

DAMPING, STEPS = 0.85, 40
#: Most (item, score) rows of a group that one task walks; larger groups are walked in parts and blocks of about so many rows, by the same steps.
TASK_ROWS = 500_000
#: Scores beyond this size are taken for faults.
ABSURD = 1e12


def walk(ranks: np.ndarray, damping: float = DAMPING, steps: int = STEPS) -> np.ndarray:
    """Stationary shares of n items from dense ranks (n, scores), a higher rank being better and 0 meaning no score."""
    n, scores = ranks.shape
    pi = np.full(n, 1.0 / n)
    counts = [np.bincount(ranks[:, s]) for s in range(scores)]
    higher = [n - np.cumsum(c) for c in counts]
    for _ in range(steps):
        new = np.zeros(n)
        for s in range(scores):
            r = ranks[:, s]
            h = higher[s][r]
            mass = np.bincount(r, weights=np.where(h > 0, pi / np.maximum(h, 1), 0.0), minlength=len(counts[s]))
            below = np.concatenate([[0.0], np.cumsum(mass)[:-1]])
            new += below[r] + np.where(h == 0, pi, 0.0)
        pi = (1 - damping) / n + damping * new / scores
    return pi


def rank_walk(long: DataFrame, damping: float = DAMPING, steps: int = STEPS, task_rows: int = TASK_ROWS) -> DataFrame:
    """(grp, item, share, rank) from rows (grp, item, score, value), higher values being better.

    Ties on a score share a rank. Null, NaN and absurd values and missing rows
    count as ranked below all others on that score. A repeated (item, score)
    counts once, with its highest value. Equal shares go by item. A group with
    one item gets rank 1; an empty table gives no rows.
    """
    v = F.col("value").cast("double")
    sound = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < ABSURD), v)
    src = long.select("grp", "item", "score", sound.alias("value")).filter("item is not null and score is not null").groupBy("grp", "item", "score").agg(F.max("value").alias("value"))
    src = cut(src)
    kinds = dict(src.dtypes)
    schema = f"grp {kinds['grp']}, item {kinds['item']}, share double"
    # at most one row per ``task_rows`` rows
    big = cut(src.groupBy(F.col("grp").alias("g")).agg(F.count("*").alias("c")).filter(F.col("c") > task_rows))
    wide = not big.isEmpty()
    same = F.col("grp").eqNullSafe(F.col("g"))
    small = src.join(F.broadcast(big), same, "left_anti") if wide else src

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items, i = np.unique(pdf["item"].to_numpy(), return_inverse=True)
        names, s = np.unique(pdf["score"].to_numpy(), return_inverse=True)
        ranks = np.zeros((len(items), len(names)), np.int64)
        for k in range(len(names)):
            at = np.flatnonzero((s == k) & pdf["value"].notna().to_numpy())
            if len(at):
                ranks[i[at], k] = np.unique(pdf["value"].to_numpy()[at], return_inverse=True)[1] + 1
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "item": items, "share": walk(ranks, damping, steps)})

    out = small.groupBy("grp").applyInPandas(run, schema)
    if wide:
        sizes = src.join(F.broadcast(big), same).groupBy("g").agg(F.first("c").alias("c"), F.countDistinct("item").alias("n"), F.countDistinct("score").alias("m"))
        sizes = cut(sizes.withColumn("gi", F.row_number().over(Window.orderBy("g"))))
        out = out.unionByName(_wide(src, sizes, damping, steps, task_rows))
    return _ranked(out, wide)


def _ranked(shares: DataFrame, wide: bool) -> DataFrame:
    """Ranks by share; where a group may be large, by a range-partitioned sort with offsets instead of one task per group."""
    rounded = F.round(F.log("share"), 12)  # twelve digits of the share, whatever the size of the group
    if not wide:
        w = Window.partitionBy("grp").orderBy(F.desc(rounded), "item")
        return shares.withColumn("rank", F.row_number().over(w).cast("long"))
    spark = shares.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(shares.repartitionByRange(parts, "grp", rounded.desc(), "item").withColumn("pid", F.spark_partition_id()))
    own = Window.partitionBy("pid", "grp").orderBy(F.desc(rounded), "item")
    before = Window.partitionBy("grp").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("grp", "pid").agg(F.count("*").alias("c")).withColumn("o", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    joined = placed.withColumn("r", F.row_number().over(own)).withColumnRenamed("grp", "g").withColumnRenamed("pid", "q")
    joined = joined.join(offsets, F.col("g").eqNullSafe(F.col("grp")) & (F.col("q") == F.col("pid")))
    return joined.select("grp", "item", "share", (F.col("r") + F.col("o")).cast("long").alias("rank"))


def _wide(src: DataFrame, big: DataFrame, damping: float, steps: int, task_rows: int) -> DataFrame:
    """The walk over all groups too large for a task at once.

    Items are dealt to parts, and every score's values, sorted, to blocks, of about ``task_rows``
    rows each. A step sends the shares from parts to blocks and the sums over
    lower values back, one array per part and block, so rows are neither sorted nor joined again. The
    driver sees a few numbers per block. Items without a value on a score
    are in no block of it; they are below all that have one. ``big`` has each group (g), its number (gi), rows (c), items (n) and scores (m).
    """
    spark = src.sparkSession
    groups = {r["gi"]: (r["n"], r["m"]) for r in big.select("gi", "n", "m").collect()}
    dealt = src.join(F.broadcast(big), F.col("grp").eqNullSafe(F.col("g"))).withColumn("p", F.pmod(F.xxhash64("item"), F.ceil(F.col("c") / task_rows)).cast("int"))
    # a negative zero equals zero
    placed = cut(dealt.select("gi", "grp", "p", "item", "score", (F.col("value") + F.lit(0.0)).alias("value"), (F.dense_rank().over(Window.partitionBy("gi", "p").orderBy("item")) - 1).alias("idx")))
    order = ["gi", "score", "value", "p", "idx"]
    count = max(2, -(-big.agg(F.sum("c")).first()[0] // task_rows))
    sorted_ = placed.filter("value is not null").select(*order).repartitionByRange(count, *order).sortWithinPartitions(*order)
    kind = dict(placed.dtypes)["score"]
    blocks = cut(sorted_.mapInArrow(_blocks, f"gi int, score {kind}, b long, first double, last double, ns_first long, ns_last long, rows long, ps array<int>, ns array<int>, idx binary, run binary"))
    chains = _chains(blocks.select("gi", "score", "b", "first", "last", "ns_first", "ns_last", "rows").collect())
    at = {b: (k["total"], k["before"], k["tail"]) for _, _, chain in chains for b, k in chain}
    empty = {g: m - sum(gi == g for gi, _, _ in chains) for g, (_, m) in groups.items()}
    parts = placed.groupBy("gi", "p").agg((F.max("idx") + 1).alias("size")).select("gi", "p", F.lit(None).cast("long").alias("b"), "size", F.lit(None).cast("binary").alias("at"))
    links = kept(parts.unionByName(blocks.select("gi", "b", "ps", "ns", "idx", "run").mapInArrow(_links, "gi int, p int, b long, size int, at binary")).repartition("gi", "p"))
    fixed = kept(blocks.select("gi", "b", "ns", "run").repartition("gi", "b"))

    def shares(gi: int, left: pa.Table, right: pa.Table, offsets: dict | None) -> tuple[np.ndarray, list]:
        """The shares of a part's items, and its links (block, places of its items)."""
        n, m = groups[gi]
        rows = sorted(((b, np.frombuffer(x, np.int32)) for b, x in zip(left["b"].to_pylist(), left["at"].to_pylist()) if b is not None), key=lambda r: r[0])
        size = max(x for x in left["size"].to_pylist() if x is not None)
        if offsets is None:
            return np.full(size, 1.0 / n), rows
        came = dict(zip(right["b"].to_pylist(), right["data"].to_pylist()))
        gained = np.zeros(size)
        for b, where in rows:
            # the lowest bit tells whether the value is the block's first
            gained += np.bincount(where >> 1, np.frombuffer(came.pop(b), np.float64) + np.array(offsets[b])[where & 1], size)
        for own in came.values():
            gained += empty[gi] * np.frombuffer(own, np.float64)
        return (1 - damping) / n + damping * gained / m, rows

    def send(offsets: dict | None):
        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            gi, p = key[0].as_py(), key[1].as_py()
            pi, rows = shares(gi, left, right, offsets)
            out = [(b, pi[where >> 1].tobytes()) for b, where in rows] + ([(-1 - p, pi.tobytes())] if empty[gi] else [])
            return pa.table({"gi": pa.array([gi] * len(out), pa.int32()), "p": pa.array([p] * len(out), pa.int32()), "b": pa.array([b for b, _ in out], pa.int64()), "data": pa.array([x for _, x in out], pa.binary())})

        return run

    def sums(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        gi, b = key[0].as_py(), key[1].as_py()
        came = sorted(zip(right["p"].to_pylist(), right["data"].to_pylist()))
        totals = [None, None, None]
        if left.num_rows:
            run = np.frombuffer(left["run"][0].as_py(), np.int32)
            pi = np.frombuffer(b"".join(x for _, x in came), np.float64)
            total, before, tail = at[b]
            higher = total - before - np.cumsum(np.bincount(run))
            higher[-1] -= tail
            mass = np.where(higher > 0, np.bincount(run, pi) / np.maximum(higher, 1), 0.0)
            below = np.concatenate([[0.0], np.cumsum(mass)])
            back = below[run] + np.where(higher[run] == 0, pi, 0.0)
            ends = np.cumsum(left["ns"][0].as_py())
            came = [(p, x.tobytes()) for (p, _), x in zip(came, np.split(back, ends[:-1]))]
            totals = [pi.sum(), below[-1], mass[-1]]
            came.append((None, None))
        k = len(came)
        sent, whole, high = ([None] * (k - 1) + [x] for x in totals)
        return pa.table(
            {
                "gi": pa.array([gi] * k, pa.int32()), "p": pa.array([p for p, _ in came], pa.int32()), "b": pa.array([b] * k, pa.int64()), "data": pa.array([x for _, x in came], pa.binary()),
                "sent": pa.array(sent, pa.float64()), "whole": pa.array(whole, pa.float64()), "high": pa.array(high, pa.float64()),
            }
        )

    returned = "gi int, p int, b long, data binary, sent double, whole double, high double"
    back, offsets = spark.createDataFrame([], returned), None
    for _ in range(steps):
        sent = links.groupBy("gi", "p").cogroup(back.filter("data is not null").groupBy("gi", "p")).applyInArrow(send(offsets), "gi int, p int, b long, data binary")
        last, back = back, cut(fixed.groupBy("gi", "b").cogroup(sent.groupBy("gi", "b")).applyInArrow(sums, returned), looped=True)
        totals = {r["b"]: (r["sent"], r["whole"], r["high"]) for r in back.filter("data is null").select("b", "sent", "whole", "high").collect()}
        offsets = _offsets(chains, totals, groups)
        if _:
            discard(last)
    items = placed.select("gi", "p", "idx", "grp", "item").distinct()

    def final(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        pi, _ = shares(key[0].as_py(), left, right, offsets)
        return pa.table({"gi": pa.array([key[0].as_py()], pa.int32()), "p": pa.array([key[1].as_py()], pa.int32()), "pi": pa.array([pi.tobytes()], pa.binary())})

    pi = links.groupBy("gi", "p").cogroup(back.filter("data is not null").groupBy("gi", "p")).applyInArrow(final, "gi int, p int, pi binary")

    def pick(batches):
        for b in batches:
            data = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float64)
            ends = np.cumsum([len(x) // 8 for x in b.column(2).to_pylist()])
            for k, (lo, hi) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
                for at_ in range(0, hi - lo, 65_536):
                    part = data[lo + at_ : min(hi, lo + at_ + 65_536)]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, b.column(0)[k].as_py(), np.int32)), pa.array(np.full(n, b.column(1)[k].as_py(), np.int32)), pa.array(np.arange(at_, at_ + n, dtype=np.int32)), pa.array(part)],
                        names=["gi", "p", "idx", "share"],
                    )

    out = cut(items.join(pi.mapInArrow(pick, "gi int, p int, idx int, share double"), ["gi", "p", "idx"]).select("grp", "item", "share"), looped=True)
    if steps:
        discard(back)
    links.unpersist()
    fixed.unpersist()
    return out


def _blocks(batches):
    """One row per block, the rows of one group and score in a sorted partition: its rows by part and place (``ps``, ``ns``, ``idx``), each with its value's place among the block's values (``run``)."""
    whole = [b for b in batches if b.num_rows]
    if not whole:
        return
    t = pa.Table.from_batches(whole).combine_chunks()
    gi, value, p, idx = (t[c].to_numpy() for c in ("gi", "value", "p", "idx"))
    score = t["score"].combine_chunks()
    other = (gi[1:] != gi[:-1]) | pc.not_equal(score.slice(1), score.slice(0, len(score) - 1)).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.flatnonzero(other) + 1, [len(gi)]])
    pid = TaskContext.get().partitionId()
    for seq, (lo, hi) in enumerate(zip(starts[:-1], starts[1:])):
        v = value[lo:hi]
        run = np.concatenate([[0], np.cumsum(v[1:] != v[:-1])]).astype(np.int32)
        by = np.lexsort((idx[lo:hi], p[lo:hi]))
        ps, ns = np.unique(p[lo:hi], return_counts=True)
        n = np.bincount(run)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([gi[lo]], pa.int32()), score.slice(lo, 1), pa.array([(pid << 32) + seq], pa.int64()), pa.array([v[0]]), pa.array([v[-1]]), pa.array([n[0]], pa.int64()), pa.array([n[-1]], pa.int64()),
                pa.array([hi - lo], pa.int64()), pa.array([ps.astype(np.int32)], pa.list_(pa.int32())), pa.array([ns.astype(np.int32)], pa.list_(pa.int32())),
                pa.array([idx[lo:hi][by].astype(np.int32).tobytes()], pa.binary()), pa.array([run[by].tobytes()], pa.binary()),
            ],
            names=["gi", "score", "b", "first", "last", "ns_first", "ns_last", "rows", "ps", "ns", "idx", "run"],
        )


def _links(batches):
    """A block's rows by part: each row's place in the part, and in the lowest bit whether its value is the block's first."""
    for batch in batches:
        for gi, b, ps, ns, idx, run in zip(*(c.to_pylist() for c in batch.columns)):
            where = (np.frombuffer(idx, np.int32) << 1) | (np.frombuffer(run, np.int32) == 0)
            k = len(ps)
            data = [x.astype(np.int32).tobytes() for x in np.split(where, np.cumsum(ns)[:-1])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([gi] * k, pa.int32()), pa.array(ps, pa.int32()), pa.array([b] * k, pa.int64()), pa.array([None] * k, pa.int32()), pa.array(data, pa.binary())], names=["gi", "p", "b", "size", "at"]
            )


def _chains(rows: list) -> list[tuple[int, int, list]]:
    """(group, rows, blocks in order) per group and score. A block has the score's rows, those before it, those of its last value behind it, whether its first value began before it and whether it has one value."""
    by: dict = {}
    for r in sorted(rows, key=lambda r: r["b"]):
        by.setdefault((r["gi"], r["score"]), []).append(r)
    out = []
    for (gi, _), chain in by.items():
        total, before, blocks = sum(r["rows"] for r in chain), 0, []
        for k, r in enumerate(chain):
            blocks.append((r["b"], {"total": total, "before": before, "tail": 0, "goes_on": k > 0 and chain[k - 1]["last"] == r["first"], "single": r["first"] == r["last"]}))
            before += r["rows"]
        for k in range(len(chain) - 2, -1, -1):
            if blocks[k + 1][1]["goes_on"]:
                blocks[k][1]["tail"] = chain[k + 1]["ns_first"] + (blocks[k + 1][1]["tail"] if blocks[k + 1][1]["single"] else 0)
        out.append((gi, total, blocks))
    return out


def _offsets(chains: list, totals: dict, groups: dict) -> dict[int, tuple[float, float]]:
    """What a block's sums lack: for rows of other values than its first, and for rows of its first value."""
    out = {}
    for gi, rows, chain in chains:
        # items without a value are below all others
        whole = (1 - sum(totals[b][0] for b, _ in chain)) / rows if rows < groups[gi][0] else 0.0
        at_last = 0.0
        for b, k in chain:
            first = at_last if k["goes_on"] else whole
            out[b] = (whole, first)
            at_last = first if k["single"] else whole + totals[b][1] - totals[b][2]
            whole += totals[b][1]
    return out


def file_ranks(git_files: DataFrame, **options) -> DataFrame:
    """(file_id, rank, share): the latest snapshot of every file by change_count, author_count and last_modified.

    ``last_modified`` in milli- or microseconds is brought to seconds; null and 0
    are no value.
    """
    t = F.col("last_modified")
    latest = git_files.filter("file_id is not null").groupBy("file_id").agg(
        F.max_by(F.struct("change_count", "author_count", "last_modified"), F.struct("snapshot_at", "row_id")).alias("s")
    )
    flat = latest.select("file_id", "s.*")
    seconds = F.when((t > 0) & (t < 1e11), t).when((t >= 1e11) & (t < 1e14), t / 1e3).when(t >= 1e14, t / 1e6)
    scores = F.create_map(F.lit("change_count"), F.col("change_count").cast("double"), F.lit("author_count"), F.col("author_count").cast("double"), F.lit("last_modified"), seconds)
    long = flat.select(F.lit(0).alias("grp"), F.col("file_id").alias("item"), F.explode(scores).alias("score", "value"))
    return rank_walk(long, **options).select(F.col("item").alias("file_id"), "rank", "share")


def run_ranks(selection_results: DataFrame, **options) -> DataFrame:
    """(pack_id, chunk_id, rank, share) from the ``selection_scores`` of all runs over the same candidates; of a variant's repeated runs the latest counts."""
    runs = selection_results.filter("pack_id is not null").groupBy("pack_id", "variant_id", "config_id").agg(F.max_by("selection_scores", F.struct("created_at", "run_id")).alias("scores"))
    name = F.concat_ws("/", "variant_id", F.col("config_id").cast("string"))
    long = runs.select(F.col("pack_id").alias("grp"), name.alias("score"), F.explode("scores").alias("item", "value"))
    return rank_walk(long, **options).select(F.col("grp").alias("pack_id"), F.col("item").alias("chunk_id"), "rank", "share")
