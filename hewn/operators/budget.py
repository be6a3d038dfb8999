"""Budgeted selection in rank order: skip, break, two-mode and quota greedy.

Break semantics is a prefix sum. Skip semantics depends on every earlier
decision; it is resolved in rounds, each of which takes the longest prefix that
fits and drops what no longer can, until so little is left that tasks may fold
it. No group is gathered before, however large it is.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hewn.operators.prefix import prefix_sum
from hewn.session import cut

#: Rows that may be folded in tasks; more rows are first reduced by rounds of prefix sums.
FOLD_ROWS = 200_000


def break_greedy(items: DataFrame, group: str, rank: str, tokens: str, budget: int) -> DataFrame:
    """Rows before the first that does not fit, with ``cum_tokens``. ``rank`` must be unique within a group; null tokens count as 0."""
    return prefix_sum(items, [group], [F.col(rank)], tokens, "cum_tokens").filter(F.col("cum_tokens") <= budget)


def break_in_order(items: DataFrame, group: str, order: list, tokens: str, budget: int) -> DataFrame:
    """As :func:`break_greedy`, for rows in an order without ties instead of ranks: one range shuffle in all."""
    return prefix_sum(items, [group], order, tokens, "cum_tokens").filter(F.col("cum_tokens") <= budget)


def _fold(pool: DataFrame, group: str, rank: str, step: Callable, start: Callable, schema, names: list[str]) -> DataFrame:
    """A sequential state machine over the rows of each group in rank order; ``step(state, i, columns) -> (state, row or None)``. Only for pools of at most FOLD_ROWS rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rank, kind="stable")
        columns = {c: pdf[c].tolist() for c in pdf.columns}
        state, out = start(columns), []
        for i in range(len(pdf)):
            state, made = step(state, i, columns)
            if made is not None:
                out.append(made)
        return pd.DataFrame(out, columns=names)

    return pool.groupBy(group).applyInPandas(run, schema)


def skip_greedy(items: DataFrame, group: str, rank: str, tokens: str, budget, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Rows taken when each is taken iff it still fits, with ``cum_tokens`` as of its turn. Null and negative tokens are never taken.

    ``budget`` is a number, or the name of a column with each row's own limit.
    """
    limit = F.col(budget) if isinstance(budget, str) else F.lit(budget)
    pool = items.withColumn("__limit", limit).filter((F.col(tokens) >= 0) & (F.col(tokens) <= F.col("__limit"))).withColumn("__used", F.lit(0).cast("long"))
    done = None
    now = F.col("__used") + F.col("__cum")
    while pool.count() > fold_rows:
        run = cut(prefix_sum(pool, [group], [F.col(rank)], tokens, "__cum"))
        split = run.groupBy(F.col(group).alias("__g")).agg(F.min(F.when(now > F.col("__limit"), F.col(rank))).alias("__first"))
        both = run.join(split, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
        ahead = F.col("__first").isNull() | (F.col(rank) < F.col("__first"))
        part = both.filter(ahead)
        sums = part.groupBy(F.col(group).alias("__g")).agg(F.max(now).alias("__now"))
        part = part.withColumn("cum_tokens", now).drop("__used", "__cum", "__first", "__limit")
        done = part if done is None else done.unionByName(part)
        rest = both.filter(~ahead).join(sums, F.col(group).eqNullSafe(F.col("__g")), "left").withColumn("__used", F.coalesce("__now", "__used"))
        pool = cut(rest.filter((F.col(rank) > F.col("__first")) & (F.col(tokens) <= F.col("__limit") - F.col("__used"))).drop("__cum", "__now", "__g", "__first"))
    schema = T.StructType([*items.schema.fields, T.StructField("cum_tokens", T.LongType())])
    names, kept = [f.name for f in schema.fields], items.columns

    def step(used, i, c):
        t = c[tokens][i]
        if used + t <= c["__limit"][i]:
            return used + int(t), [*(c[n][i] for n in kept), used + int(t)]
        return used, None

    folded = _fold(pool, group, rank, step, lambda c: int(c["__used"][0]), schema, names)
    return folded if done is None else done.unionByName(folded)


def ladder_greedy(items: DataFrame, group: str, rank: str, budget: int, ladder: list[tuple[str, str, Callable]], fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(group, id, mode, tokens): each row in full if that fits, else by the first step of ``ladder`` that does, else not at all.

    Needs columns id, full_tokens and ``least_tokens`` (the fewest that any form
    takes), without nulls. A step is (mode, SQL expression over the row's
    columns and ``remaining``, the same as a function of the row and
    remaining); null means that the step is not open. In rounds, the longest
    prefix that fits in full is taken and the row behind it resolved.
    """
    kinds = dict(items.dtypes)
    pool = items.filter(F.col("least_tokens") <= budget).withColumn("__used", F.lit(0).cast("long"))
    made = None
    now = F.col("__used") + F.col("__cum")
    out = [F.col(group), F.col("id")]
    while pool.count() > fold_rows:
        run = cut(prefix_sum(pool, [group], [F.col(rank)], "full_tokens", "__cum"))
        split = run.groupBy(F.col(group).alias("__g")).agg(F.min(F.when(now > budget, F.col(rank))).alias("__first"))
        both = run.join(split, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
        ahead = both.filter(F.col("__first").isNull() | (F.col(rank) < F.col("__first")))
        # what is left when the row behind the prefix comes
        behind = both.filter(F.col(rank) == F.col("__first")).withColumn("remaining", F.lit(budget) - now + F.col("full_tokens"))
        forms = F.coalesce(*[F.when(F.expr(e) <= F.col("remaining"), F.struct(F.lit(m).alias("mode"), F.expr(e).cast("long").alias("tokens"))) for m, e, _ in ladder])
        behind = cut(behind.withColumn("form", forms))
        part = ahead.select(*out, F.lit("full").alias("mode"), F.col("full_tokens").cast("long").alias("tokens")).unionByName(behind.filter("form is not null").select(*out, "form.mode", "form.tokens"))
        made = part if made is None else made.unionByName(part)
        left = behind.select(F.col(group).alias("__g"), (F.lit(budget) - F.col("remaining") + F.coalesce("form.tokens", F.lit(0))).cast("long").alias("__now"))
        rest = both.filter(F.col(rank) > F.col("__first")).join(left, F.col(group).eqNullSafe(F.col("__g")))
        pool = cut(rest.filter(F.col("least_tokens") <= budget - F.col("__now")).withColumn("__used", F.col("__now")).drop("__cum", "__now", "__g", "__first"))

    def step(used, i, c):
        row = {k: v[i] for k, v in c.items()}
        for mode, tokens in (("full", row["full_tokens"]), *((m, f(row, budget - used)) for m, _, f in ladder)):
            if tokens is not None and used + tokens <= budget:
                return used + tokens, [row[group], row["id"], mode, tokens]
        return used, None

    schema = f"{group} {kinds[group]}, id {kinds['id']}, mode string, tokens long"
    folded = _fold(pool, group, rank, step, lambda c: int(c["__used"][0]), schema, [group, "id", "mode", "tokens"])
    return folded if made is None else made.unionByName(folded)


def two_mode_greedy(items: DataFrame, group: str, rank: str, budget: int, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(group, id, mode, tokens): a row in full if that fits, else as its signature, else not at all. Needs columns id, full_tokens, signature_tokens, without nulls."""
    pool = items.withColumn("least_tokens", F.least("full_tokens", "signature_tokens"))
    return ladder_greedy(pool, group, rank, budget, [("signature", "signature_tokens", lambda row, _: row["signature_tokens"])], fold_rows)


def capped_greedy(items: DataFrame, group: str, kind: str, rank: str, budget: int, share: float, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(group, id, kind, tokens): skip-greedy where no kind may take more than ``share`` of the budget; needs columns id and tokens."""
    cap = share * budget
    out = [group, "id", kind, "tokens"]
    kinds = dict(items.dtypes)
    pool = items.filter(F.col("tokens").between(0, cap)).withColumn("__used", F.lit(0).cast("long")).withColumn("__own", F.lit(0).cast("long"))
    done = None
    while pool.count() > fold_rows:
        run = cut(prefix_sum(prefix_sum(pool, [group], [F.col(rank)], "tokens", "__cum"), [group, kind], [F.col(rank)], "tokens", "__kcum"))
        over = (F.col("__used") + F.col("__cum") > budget) | (F.col("__own") + F.col("__kcum") > cap)
        split = run.groupBy(F.col(group).alias("__g")).agg(F.min(F.when(over, F.col(rank))).alias("__first"))
        both = run.join(split, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
        part = cut(both.filter(F.col("__first").isNull() | (F.col(rank) < F.col("__first"))))
        done = part.select(*out) if done is None else done.unionByName(part.select(*out))
        total = part.groupBy(F.col(group).alias("__g")).agg(F.sum("tokens").alias("__t"))
        own = part.groupBy(F.col(group).alias("__h"), F.col(kind).alias("__k")).agg(F.sum("tokens").alias("__o"))
        rest = both.filter(F.col(rank) > F.col("__first")).join(total, F.col(group).eqNullSafe(F.col("__g")), "left").join(own, F.col(group).eqNullSafe(F.col("__h")) & F.col(kind).eqNullSafe(F.col("__k")), "left")
        rest = rest.withColumn("__used", F.col("__used") + F.coalesce("__t", F.lit(0))).withColumn("__own", F.col("__own") + F.coalesce("__o", F.lit(0)))
        pool = cut(rest.filter((F.col("tokens") <= budget - F.col("__used")) & (F.col("tokens") <= cap - F.col("__own"))).drop("__cum", "__kcum", "__first", "__g", "__t", "__h", "__k", "__o"))

    def step(state, i, c):
        used, by = state
        t, k = c["tokens"][i], c[kind][i]
        own = by.get(k, c["__own"][i])
        if used + t <= budget and own + t <= cap:
            return (used + t, {**by, k: own + t}), [c[n][i] for n in out]
        return state, None

    folded = _fold(pool, group, rank, step, lambda c: (int(c["__used"][0]), {}), ", ".join(f"{n} {kinds[n]}" for n in out), out)
    return folded if done is None else done.unionByName(folded)
