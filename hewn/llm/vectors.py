"""Most similar vectors for every vector, by additive quantisation (problem 2).

Each (model, version) has its own full-dimensional residual codebooks, fitted
on a bounded sample of its rows. Every valid vector is encoded by beam search;
the beam's first codes are its cell and, for a query, the cells to look into.
Pairs in a cell are scored from the codes with each row's stored code error,
and what remains is ranked again with the exact vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hewn.session import bounded_batches, cut

#: Most rows per (model, version) that codebooks are fitted on; every row is encoded.
SAMPLE = 8_192
CODEBOOKS, WORDS = 20, 64
#: Rows a cell should hold on average; it sets how many codes make up a cell.
CELL_ROWS = 16
#: Fewest cells that a row looks into; :func:`probes_of` has the number by depth.
PROBES = 8
#: Rows of one content beyond which the content is met as one.
HOT_ROWS = 64

# Dimensions of the models whose vectors may be cut short.
DIMENSION = {"hill-mini": 64, "cairn-base": 32}


def valid_vectors(embeddings: DataFrame, cache: DataFrame) -> DataFrame:
    """(vec_id, space, sha, vec) of the valid vectors of both tables, as unit vectors.

    ``space`` is model, version and length. Invalid are null vectors or models, values
    that are null or not finite, all-zero vectors, lengths other than the
    model's, and blobs of another length than 4 or 8 bytes per value.
    """
    bounded_batches(embeddings.sparkSession)
    dims = F.create_map(*[F.lit(x) for kv in DIMENSION.items() for x in kv])
    size = F.col("embedding_dimension")
    space = F.concat_ws("\x1f", "model_name", "model_version").alias("space")
    lists = embeddings.filter("vec_id is not null and embedding is not null and model_name is not null").select(
        F.col("vec_id").cast("long"), space, F.col("content_sha").alias("sha"), F.coalesce(dims[F.col("model_name")], F.size("embedding")).alias("n"),
        F.col("embedding").cast("array<double>").alias("list"), F.lit(None).cast("binary").alias("blob"),
    )
    blobs = cache.filter("vec_id is not null and embedding_data is not null and model_name is not null").select(
        F.col("vec_id").cast("long"), space, F.col("content_sha").alias("sha"), F.coalesce(size, dims[F.col("model_name")]).alias("n"),
        F.lit(None).cast("array<double>").alias("list"), F.col("embedding_data").alias("blob"),
    )

    def run(batches):
        for b in batches:
            ids, spaces, shas, out = [], [], [], []
            for i, s, h, n, values, blob in zip(*(c for c in b.columns)):
                n = n.as_py()
                if blob.is_valid:
                    raw = blob.as_py()
                    kind = {4: "<f4", 8: "<f8"}.get(len(raw) // n if n and len(raw) % n == 0 else 0)
                    v = np.frombuffer(raw, kind).astype(np.float64) if kind else None
                else:
                    v = values.values.to_numpy(zero_copy_only=False).astype(np.float64) if len(values) == n else None
                if v is None or not np.isfinite(v).all() or not v.any():
                    continue
                top = np.abs(v).max()
                v = v / top
                ids.append(i.as_py())
                spaces.append(f"{s.as_py()}\x1f{n}")
                shas.append(h.as_py())
                out.append((v / np.sqrt(v @ v)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(spaces, pa.string()), pa.array(shas, pa.string()), pa.array(out, pa.binary())], names=["vec_id", "space", "sha", "vec"]
            )

    return lists.unionByName(blobs).mapInArrow(run, "vec_id long, space string, sha string, vec binary")


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    words = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        a = (-2 * x @ words.T + (words**2).sum(1)).argmin(1)
        n = np.bincount(a, minlength=k)
        order = np.argsort(a, kind="stable")
        full = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[full])[:-1]]), axis=0)
        words[full] = sums / n[full, None]
        empty = np.flatnonzero(n == 0)
        words[empty] = x[rng.choice(len(x), len(empty))]
    return words.astype(np.float32)


def fit(sample: np.ndarray, books: int = CODEBOOKS, words: int = WORDS, seed: int = 11) -> np.ndarray:
    """Residual codebooks (books, words, dimension) of a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    rest, out = sample.astype(np.float32).copy(), []
    for _ in range(books):
        c = kmeans(rest, words, rng)
        rest -= c[(-2 * rest @ c.T + (c**2).sum(1)).argmin(1)]
        out.append(c)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int, depth: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) found by beam search, and the ``probes`` best prefixes (n, probes) of ``depth`` codes as cell numbers, -1 where there are fewer."""
    m, k, d = books.shape
    codes_all = np.zeros((len(x), m), np.uint8)
    cells_all = np.full((len(x), probes), -1, np.int64)
    norms = (books**2).sum(2)
    for lo in range(0, len(x), 1024):
        q = x[lo : lo + 1024]
        n = len(q)
        codes, rest, err = np.zeros((n, 1, 0), np.uint8), q[:, None, :], (q**2).sum(1)[:, None]
        for j in range(m):
            b = rest.shape[1]
            wide = max(beam, probes) if j < depth else beam
            e = (err[:, :, None] - 2 * (rest.reshape(-1, d) @ books[j].T).reshape(n, b, k) + norms[j]).reshape(n, -1)
            keep = min(wide, e.shape[1])
            idx = np.argpartition(e, keep - 1, 1)[:, :keep] if keep < e.shape[1] else np.tile(np.arange(keep), (n, 1))
            low = np.take_along_axis(e, idx, 1)
            o = low.argsort(1, kind="stable")
            idx, err = np.take_along_axis(idx, o, 1), np.take_along_axis(low, o, 1)
            p, c = idx // k, idx % k
            codes = np.concatenate([np.take_along_axis(codes, p[:, :, None], 1), c[:, :, None].astype(np.uint8)], 2)
            if j + 1 < m:
                rest = np.take_along_axis(rest, p[:, :, None], 1) - books[j][c]
            if j + 1 == depth:
                key = (codes.astype(np.int64) * (k ** np.arange(depth, dtype=np.int64))).sum(2)[:, :probes]
                cells_all[lo : lo + n, : key.shape[1]] = key
                codes, rest, err = codes[:, :beam], rest[:, :beam], err[:, :beam]
        codes_all[lo : lo + n] = codes[:, 0]
    return codes_all, cells_all


def depth_of(n: int, words: int = WORDS, rows: int = CELL_ROWS) -> int:
    """How many codes make up a cell, so that a cell holds about ``rows`` rows."""
    d = 1
    while n > rows * words**d and d < 6:
        d += 1
    return d


def probes_of(depth: int, least: int = PROBES) -> int:
    """How many cells a row looks into: four times as many for each further code of a cell, so that similar rows meet as often at every depth."""
    return max(least, 2 * 4 ** (depth - 1))


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    x = books[0][codes[:, 0]].copy()
    for j in range(1, len(books)):
        x += books[j][codes[:, j]]
    return x


def reach_of(sample: np.ndarray, books: np.ndarray, least: float, beam: int = 6, seed: int = 13) -> float:
    """How far codes may set a pair of cosine ``least`` apart, as a multiple of the root of both squared code errors.

    It is the largest value over noisy twins of the sample at that cosine. By the triangle
    inequality it never exceeds the root of two.
    """
    rng = np.random.default_rng(seed)
    e = rng.normal(size=sample.shape)
    e -= (e * sample).sum(1, keepdims=True) * sample
    e /= np.maximum(np.sqrt((e**2).sum(1, keepdims=True)), 1e-12)
    twins = (least * sample + np.sqrt(1 - least**2) * e).astype(np.float32)
    x, y = (decoded(encode(v, books, beam, 1, 1)[0], books) for v in (sample, twins))
    error = np.sqrt(((sample - x) ** 2).sum(1) + ((twins - y) ** 2).sum(1))
    apart = np.sqrt(((x - y) ** 2).sum(1)) - np.sqrt(2 - 2 * least)
    return float(min(np.sqrt(2), max(0.0, (apart / np.maximum(error, 1e-6)).max())))


def codebooks(vectors: DataFrame, books: int = CODEBOOKS, words: int = WORDS, sample: int = SAMPLE, reach: dict | None = None, least: float = 0.96) -> dict:
    """{space: (codebooks, rows)}, fitted on at most ``sample`` rows of each space, chosen by hash; spaces are the few models in use. ``reach`` is filled by space with :func:`reach_of` for ``least``."""
    counts = {r["space"]: r["n"] for r in vectors.groupBy("space").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for s, n in counts.items():
        share = F.when(F.col("space") == s, F.lit(min(1.0, sample / n))).otherwise(share)
    rows = vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20)).select("space", "vec")
    by: dict[str, list] = {}
    for r in rows.toLocalIterator():
        by.setdefault(r["space"], []).append(np.frombuffer(r["vec"], "<f4"))
    out = {s: (fit(np.stack(by[s]), books, words) if by.get(s) else None, n) for s, n in counts.items()}
    if reach is not None:
        reach.update({s: reach_of(np.stack(by[s]), b, least) for s, (b, _) in out.items() if b is not None})
    return out


def encoded(vectors: DataFrame, books: dict, probes: int = 0, beam: int = 6) -> DataFrame:
    """(vec_id, space_no, prefix, last, prefixes, masks, codes, error), for all rows, and the third column as it is.

    ``prefix`` and ``last`` are the row's cell: all codes but the last, and the last. The
    cells to look into (``probes``, or as many as the depth asks for) are given by
    prefix, with a mask of their last codes. ``error`` is the distance of the codes' vector.
    """
    spark = vectors.sparkSession
    known = spark.sparkContext.broadcast({s: (i, b, depth_of(n)) for i, (s, (b, n)) in enumerate(sorted(books.items())) if b is not None})
    carried = vectors.schema[2]

    def run(batches):
        table = known.value
        for b in batches:
            space = np.array(b.column(1).to_pylist(), dtype=object)
            size = b.num_rows
            no, prefix, last, error = np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros(size, np.float32)
            codes, seen, bits = [None] * size, [], []
            raw = b.column(3).to_pylist()
            for s in set(space):
                i, c, depth = table[s]
                at = np.flatnonzero(space == s)
                x = np.stack([np.frombuffer(raw[k], "<f4") for k in at])
                code, cells = encode(x, c, beam, depth, probes or probes_of(depth))
                high = c.shape[1] ** (depth - 1)
                no[at], prefix[at], last[at] = i, cells[:, 0] % high, cells[:, 0] // high
                error[at] = np.sqrt(((x - decoded(code, c)) ** 2).sum(1))
                for row, k in enumerate(at):
                    codes[k] = code[row].tobytes()
                row, probe = np.nonzero(cells >= 0)
                seen.append((at[row] << 32) | (cells[row, probe] % high))
                bits.append(np.uint64(1) << (cells[row, probe] // high).astype(np.uint64))
            groups, inv = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.int64), return_inverse=True)
            masks = np.zeros(len(groups), np.uint64)
            np.bitwise_or.at(masks, inv, np.concatenate(bits) if bits else np.zeros(0, np.uint64))
            ends = pa.array(np.searchsorted(groups >> 32, np.arange(size + 1)).astype(np.int32))
            prefixes = (groups & 0xFFFFFFFF).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(no), b.column(2), pa.array(prefix), pa.array(last), pa.ListArray.from_arrays(ends, pa.array(prefixes)),
                    pa.ListArray.from_arrays(ends, pa.array(masks.view(np.int64))), pa.array(codes, pa.binary()), pa.array(error),
                ],
                names=["vec_id", "space_no", carried.name, "prefix", "last", "prefixes", "masks", "codes", "error"],
            )

    return vectors.mapInArrow(run, f"vec_id long, space_no int, {carried.name} {carried.dataType.simpleString()}, prefix int, last int, prefixes array<int>, masks array<long>, codes binary, error float")


def similar_pairs(embeddings: DataFrame, cache: DataFrame, least: float = 0.96, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a_vec, b_vec, similarity), a_vec < b_vec: valid vectors of one model and version, of different content, with a cosine of ``least`` or more.

    Rows meet in cells; a row looks into :func:`probes_of` cells. Hot cells are split
    by the join's skew handling. A content with more than ``hot_rows`` rows never
    meets itself: such contents meet each other as contents first. Pairs whose
    codes are further apart than a pair of cosine ``least`` can be, given both code errors and the
    space's measured :func:`reach_of`, are dropped before the exact
    step. Null shas count as different content. Empty tables give no rows.
    """
    key = F.xxhash64(F.coalesce("sha", F.concat(F.lit("row:"), F.col("vec_id").cast("string")))).alias("key")
    vectors = cut(valid_vectors(embeddings, cache).select("vec_id", "space", key, "vec"))
    reach: dict[str, float] = {}
    books = codebooks(vectors, reach=reach, least=least)
    rows = cut(encoded(vectors, books))
    spark = vectors.sparkSession
    tables = spark.sparkContext.broadcast([(b, reach[s]) if b is not None else None for s, (b, _) in sorted(books.items())])
    met = _met(rows, rows)
    hot = cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows).select("key"))
    if not hot.isEmpty():
        much, rest = rows.join(hot, "key", "left_semi"), rows.join(hot, "key", "left_anti")
        met = _met(rest, rest).unionByName(_met(much, rest)).unionByName(_met(rest, much)).unionByName(_met_by_content(much))

    def score(batches):
        for b in batches:
            no, x, y, ex, ey = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 5, 6))
            keep = np.zeros(b.num_rows, bool)
            for s in np.unique(no):
                at = np.flatnonzero(no == s)
                book, far = tables.value[s]
                (p, i), (q, j) = (_by_row(b.column(c), ids, at, book) for c, ids in ((3, x), (4, y)))
                apart = np.sqrt(((p[i] - q[j]) ** 2).sum(1))
                keep[at] = apart <= np.sqrt(2 - 2 * least) + far * np.sqrt(ex[at] ** 2 + ey[at] ** 2) + 1e-4
            lo, hi = np.minimum(x, y)[keep], np.maximum(x, y)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["a_vec", "b_vec"])

    near = met.mapInArrow(score, "a_vec long, b_vec long").distinct()
    ends = vectors.select("vec_id", "vec")
    both = near.join(ends.select(F.col("vec_id").alias("a_vec"), F.col("vec").alias("a")), "a_vec").join(ends.select(F.col("vec_id").alias("b_vec"), F.col("vec").alias("b")), "b_vec")
    return both.withColumn("similarity", _cosine("a", "b")).filter(F.col("similarity") >= least).select("a_vec", "b_vec", "similarity")


def _by_row(codes: pa.Array, ids: np.ndarray, at: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decoded vectors of the different rows among ``ids[at]``, and which of them each is."""
    _, first, inv = np.unique(ids[at], return_index=True, return_inverse=True)
    raw = b"".join(codes.take(pa.array(at[first])).to_pylist())
    return decoded(np.frombuffer(raw, np.uint8).reshape(-1, len(book)), book), inv


def _looking(rows: DataFrame) -> DataFrame:
    """(space_no, prefix, mask, a_key, a, a_codes, a_error): each row at all prefixes it looks into."""
    return rows.select(
        "space_no", F.inline(F.arrays_zip("prefixes", "masks")), F.col("key").alias("a_key"), F.col("vec_id").alias("a"), F.col("codes").alias("a_codes"), F.col("error").alias("a_error")
    ).withColumnsRenamed({"prefixes": "prefix", "masks": "mask"})


def _there(rows: DataFrame) -> DataFrame:
    """(space_no, prefix, last, b_key, b, b_codes, b_error): each row in its own cell."""
    return rows.select("space_no", "prefix", "last", F.col("key").alias("b_key"), F.col("vec_id").alias("b"), F.col("codes").alias("b_codes"), F.col("error").alias("b_error"))


MET = ["space_no", "a", "b", "a_codes", "b_codes", "a_error", "b_error"]


def _met(looking: DataFrame, there: DataFrame) -> DataFrame:
    return _looking(looking).join(_there(there), ["space_no", "prefix"]).filter("(shiftright(mask, last) & 1L) = 1 and a_key != b_key").select(*MET)


def _met_by_content(rows: DataFrame) -> DataFrame:
    """As :func:`_met`, for contents with very many rows: contents that share a cell first, then their rows."""
    a = _looking(rows).withColumn("last", F.expr(f"explode(filter(sequence(0, {WORDS - 1}), i -> (shiftright(mask, i) & 1L) = 1))"))
    b = _there(rows)
    on = ["space_no", "prefix", "last"]
    pairs = a.select(*on, "a_key").distinct().join(b.select(*on, "b_key").distinct(), on).filter("a_key != b_key")
    return pairs.join(a, [*on, "a_key"]).join(b, [*on, "b_key"]).select(*MET)


def _cosine(a: str, b: str):
    @F.pandas_udf("double")
    def f(x, y):
        import pandas as pd

        out = np.zeros(len(x))
        size = x.str.len().to_numpy()
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            u, v = (np.frombuffer(b"".join(c.iloc[at]), "<f4").reshape(len(at), -1).astype(np.float64) for c in (x, y))
            out[at] = (u * v).sum(1)
        return pd.Series(out)

    return f(a, b)


#: Codebooks for ranking neighbours, and rows that are ranked again with the exact vectors.
RANKING_BOOKS, RERANK = 40, 40
#: Most rows, and about as many queries, that one task scores against each other.
UNIT_ROWS, UNIT_QUERIES = 65_536, 16_384


def coded(vectors: DataFrame, books: dict, every: int, beam: int = 2) -> DataFrame:
    """(vec_id, space_no, cell, codes, norm, cells, half): the codes of all rows, the length of the codes' vector, and the row's cell, its first code.

    Query rows (``vec_id`` divisible by ``every``) also have all cells,
    nearest first, and their vector in half precision.
    """
    spark = vectors.sparkSession
    known = spark.sparkContext.broadcast({s: (i, b) for i, (s, (b, _)) in enumerate(sorted(books.items())) if b is not None})

    def run(batches):
        table = known.value
        for b in batches:
            ids, space, raw, size = b.column(0).to_numpy(), np.array(b.column(1).to_pylist(), dtype=object), b.column(2).to_pylist(), b.num_rows
            no, cell, norm = np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros(size, np.float32)
            codes, cells, half = [None] * size, [None] * size, [None] * size
            for s in set(space):
                i, c = table[s]
                at = np.flatnonzero(space == s)
                x = np.stack([np.frombuffer(raw[k], "<f4") for k in at])
                code, _ = encode(x, c, beam, 1, 1)
                no[at], cell[at], norm[at] = i, code[:, 0], np.sqrt((decoded(code, c) ** 2).sum(1))
                for row, k in enumerate(at):
                    codes[k] = code[row].tobytes()
                asks = np.flatnonzero(ids[at] % every == 0)
                near = ((c[0] ** 2).sum(1) - 2 * x[asks] @ c[0].T).argsort(1, kind="stable")
                for row, k in enumerate(asks):
                    cells[at[k]], half[at[k]] = near[row].astype(np.int32), x[k].astype("<f2").tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(no), pa.array(cell), pa.array(codes, pa.binary()), pa.array(norm), pa.array(cells, pa.list_(pa.int32())), pa.array(half, pa.binary())],
                names=["vec_id", "space_no", "cell", "codes", "norm", "cells", "half"],
            )

    return vectors.select("vec_id", "space", "vec").mapInArrow(run, "vec_id long, space_no int, cell int, codes binary, norm float, cells array<int>, half binary")


def best_by_tables(q: np.ndarray, qid: np.ndarray, bar: np.ndarray, codes: np.ndarray, ids: np.ndarray, norms: np.ndarray, books: np.ndarray, keep: int, step: int = 256, rows: int = 2_048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, other, score) of the up to ``keep`` rows of each query that score ``bar`` or more, by lookup tables over the codes and the stored norms; a row isn't its own neighbour."""
    m, words, d = books.shape
    out = [], [], []
    inverse = (1 / np.maximum(norms, 1e-12)).astype(np.float32)[:, None]
    for lo in range(0, len(q), step):
        block, own, least = q[lo : lo + step], qid[lo : lo + step], bar[lo : lo + step].astype(np.float32)
        n = len(block)
        # one table per codebook: the product of each word with each query of the block
        tables = (books.reshape(-1, d) @ block.T).reshape(m, words, n)
        top_s, top_i = np.full((n, keep), -9, np.float32), np.zeros((n, keep), np.int64)
        for at in range(0, len(ids), rows):
            code, part = codes[at : at + rows], ids[at : at + rows]
            score = tables[0][code[:, 0]]
            for j in range(1, m):
                score += tables[j][code[:, j]]
            score *= inverse[at : at + rows]
            score[part[:, None] == own] = -9
            # only queries for which a row of the part reaches the bar or their worst of the best so far
            hit = np.flatnonzero(score.max(0) >= least)
            if not len(hit):
                continue
            score, part = np.concatenate([top_s[hit], score[:, hit].T], 1), np.concatenate([top_i[hit], np.broadcast_to(part, (len(hit), len(part)))], 1)
            pick = np.argpartition(-score, keep - 1, 1)[:, :keep]
            top_s[hit], top_i[hit] = np.take_along_axis(score, pick, 1), np.take_along_axis(part, pick, 1)
            least[hit] = np.maximum(least[hit], top_s[hit].min(1))
        k, c = np.nonzero((top_s >= bar[lo : lo + step, None]) & (top_s > -9))
        for x, y in zip(out, (own[k], top_i[k, c], top_s[k, c])):
            x.append(y)
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.float32)))


def most_similar(embeddings: DataFrame, cache: DataFrame, k: int = 10, every: int = 20, rerank: int = RERANK, unit_rows: int = UNIT_ROWS, unit_queries: int = UNIT_QUERIES) -> DataFrame:
    """(vec_id, rank, other_vec, similarity): the ``k`` most similar vectors of each query row (``vec_id`` divisible by ``every``).

    Rows lie in the cell of their first code; a query looks into all of the
    64 cells, whatever the number of rows, first into the two that are nearest to it, then, for rows that
    score no less than its ``rerank``-th best so far, into the others. Rows are
    scored by lookup tables over their codes and their stored norms; the best ``rerank`` of each
    query are ranked with the exact vectors. A cell's rows and its queries are
    dealt to as many tasks as their counts ask for, so a hot cell is never gathered. Neighbours
    with ``rerank`` better scores by code are
    missed: the recall is that of a test against brute force. Ties
    go to the lower ``vec_id``. A space with one valid vector gives no rows.
    """
    vectors = cut(valid_vectors(embeddings, cache).select("vec_id", "space", "vec"))
    books = codebooks(vectors, RANKING_BOOKS)
    rows = cut(coded(vectors, books, every))
    words = vectors.sparkSession.sparkContext.broadcast([b for _, (b, _) in sorted(books.items())])
    asked = rows.filter("half is not null").select(F.col("vec_id").alias("q"), "space_no", "cells", "half")
    first = cut(_scored(rows, asked.withColumn("cells", F.slice("cells", 1, 2)).withColumn("bar", F.lit(-8.0).cast("float")), words, rerank, unit_rows, unit_queries))
    bars = _top(first, rerank).groupBy("q").agg(F.when(F.count("*") >= rerank, F.min("score")).otherwise(F.lit(-8.0)).cast("float").alias("bar"))
    rest = asked.withColumn("cells", F.slice("cells", 3, WORDS)).join(bars, "q", "left").withColumn("bar", F.coalesce("bar", F.lit(-8.0).cast("float")))
    top = _top(first.unionByName(_scored(rows, rest, words, rerank, unit_rows, unit_queries)), rerank).select("q", "other")
    near = top.join(vectors.select(F.col("vec_id").alias("other"), F.col("vec").alias("y")), "other")
    exact = near.join(vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("q"), F.col("vec").alias("x")), "q").withColumn("similarity", _cosine("x", "y"))
    rank = Window.partitionBy("q").orderBy(F.desc("similarity"), "other")
    return (
        exact.select("q", "other", "similarity").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
        .select(F.col("q").alias("vec_id"), "rank", F.col("other").alias("other_vec"), "similarity")
    )


def _top(near: DataFrame, keep: int) -> DataFrame:
    best = Window.partitionBy("q").orderBy(F.desc("score"), "other")
    return near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= keep).drop("r")


def _scored(rows: DataFrame, asked: DataFrame, words, keep: int, unit_rows: int, unit_queries: int) -> DataFrame:
    """(q, other, score) of the best ``keep`` rows of every query in every unit: a cell's share of rows against its share of queries."""
    on = ["space_no", "cell"]
    looking = asked.select("q", "space_no", F.explode("cells").alias("cell"), "half", "bar")
    parts = lambda df, n, name: df.groupBy(*on).agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    # at most 64 cells a model, so the table of their parts is small
    deal = F.broadcast(parts(rows, unit_rows, "nr").join(parts(asked.select("space_no", F.explode("cells").alias("cell")), unit_queries, "nq"), on))
    there = rows.join(deal, on).select(*on, F.pmod(F.xxhash64("vec_id"), "nr").cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("p"), "vec_id", "codes", "norm")
    here = looking.join(deal, on).select(F.col("space_no").alias("s_"), F.col("cell").alias("c_"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("r_"), F.pmod(F.xxhash64("q", F.lit(3)), "nq").cast("int").alias("p_"), "q", "half", "bar")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        book = words.value[key[0].as_py()] if left.num_rows and right.num_rows else None
        if book is None:
            q, other, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        else:
            codes = np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8).reshape(left.num_rows, -1)
            vec = np.frombuffer(b"".join(right["half"].to_pylist()), "<f2").astype(np.float32).reshape(right.num_rows, -1)
            q, other, score = best_by_tables(vec, right["q"].to_numpy(), right["bar"].to_numpy(), codes, left["vec_id"].to_numpy(), left["norm"].to_numpy(), book, keep)
        return pa.table({"q": q, "other": other, "score": score})

    return there.groupBy(*on, "r", "p").cogroup(here.groupBy("s_", "c_", "r_", "p_")).applyInArrow(run, "q long, other long, score float")
