"""Mixing sources to target weights by fitting word budgets.

Sources get weights and share all words; a source takes whole copies of its documents
as far as its target goes, and a chosen part of them once more for the rest of the
budget.  That part is chosen by length: documents are counted by exact size, the count
of each size is scaled to the budget, and what remains is met by dynamic programming
over the sizes left (bounded knapsack, in parts of doubling counts).  Which documents of a size are taken is seeded.
Only counts by source and size are gathered, a source's in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, copies_of, numbered, prepare, ranked, row_key, saved

SEED = 7
CYCLE = 3
MOST = 3
#: Words that the dynamic programme covers; larger sizes meet the rest of a budget before.
SPAN = 1 << 16


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, span: int = SPAN) -> np.ndarray:
    """How many documents of each size to take, of `counts`, for a sum as near to `budget` as is found.

    Sums above come from fitting what is left out.  Where both are as near, the lower.
    """
    below = fit_below(sizes, counts, budget, span)
    whole, gap = int((sizes * counts).sum()), budget - int((sizes * below).sum())
    if not gap:
        return below
    above = counts - fit_below(sizes, counts, whole - budget, span)
    return above if int((sizes * above).sum()) - budget < gap else below


def fit_below(sizes: np.ndarray, counts: np.ndarray, budget: int, span: int = SPAN) -> np.ndarray:
    """How many documents of each size to take, of `counts`, for a sum at or just below `budget`.

    Sizes are distinct and positive, budget at most the sum of all.  Three starts are
    tried until one is met exactly, and the nearest is taken: even shares of each size
    rounded down; shares rounded to the nearest with what is over carried to the next
    smaller size, for sources where few large documents hold most words; and none.
    """
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    whole = sum(int(s) * int(n) for s, n in zip(sizes, counts))
    if not whole:
        return np.zeros(len(counts), np.int64)
    down = np.argsort(-sizes)
    even = np.array([int(n) * budget // whole for n in counts], np.int64)
    carried, due, spent = np.zeros(len(counts), np.int64), 0, 0
    for k in down:
        due += int(sizes[k]) * int(counts[k]) * budget
        want = (due - spent * whole) / (int(sizes[k]) * whole)
        carried[k] = min(int(counts[k]), max(0, round(want)))
        spent += int(carried[k]) * int(sizes[k])
    best, gap = None, None
    for start in (even, carried, np.zeros(len(counts), np.int64)):
        missing = budget - sum(int(s) * int(t) for s, t in zip(sizes, start))
        if missing < 0:
            continue
        taken, missing = _finish(sizes, counts, start, missing, down, span)
        if gap is None or missing < gap:
            best, gap = taken, missing
        if not gap:
            break
    return best


def _finish(sizes: np.ndarray, counts: np.ndarray, start: np.ndarray, missing: int, down: np.ndarray, span: int) -> tuple[np.ndarray, int]:
    """`start` with more taken to meet what is missing, and what then is missing.

    The largest sizes go until at most `span` words (or less than any size) are
    missing, then comes the best subset sum of what is left.
    """
    taken = start.copy()
    for reserve in (span, 0):
        for k in down:
            if missing <= span:
                break
            more = min(int(counts[k] - taken[k]), max(0, missing - reserve) // int(sizes[k]))
            taken[k] += more
            missing -= more * int(sizes[k])
    if not 0 < missing <= span:
        return taken, missing
    reach, by, items = np.zeros(missing + 1, bool), np.full(missing + 1, -1, np.int64), []
    reach[0] = True
    for k in down:
        left, size, part = int(counts[k] - taken[k]), int(sizes[k]), 1
        while left and part * size <= missing and not reach[missing]:
            part = min(part, left)
            step = part * size
            new = np.flatnonzero(reach[:-step] & ~reach[step:]) + step
            reach[new], by[new] = True, len(items)
            items.append((k, part, step))
            left -= part
            part *= 2
        if reach[missing]:
            break
    at = int(np.flatnonzero(reach)[-1])
    missing -= at
    while at:
        k, part, step = items[by[at]]
        taken[k] += part
        at -= step
    return taken, missing


def _plan(histogram: pd.DataFrame) -> pd.DataFrame:
    """Of one source (source, size, n, source_size, target): copies of all and how many once more, by size."""
    source_size, target = int(histogram["source_size"].iloc[0]), float(histogram["target"].iloc[0])
    whole = min(MOST, int(target // source_size)) if source_size else 0
    rest = min(source_size, round(target - whole * source_size)) if whole < MOST else 0
    sizes = histogram["size"].to_numpy(np.int64)
    extra, some = np.zeros(len(sizes), np.int64), sizes > 0
    if rest > 0:
        extra[some] = fit_budget(sizes[some], histogram["n"].to_numpy(np.int64)[some], rest)
    return histogram[["source", "size", "source_size", "target"]].assign(whole=whole, extra=extra)


def targets(totals: DataFrame) -> DataFrame:
    """`totals` (source, source_size) with `target`: shares by weight, none above MOST times its source.

    Weights go 1, 2, 3 and again, by code point, null last.  What a source cannot take
    is shared by weight among the others until none is above.  The driver sees sums.
    """
    placed = numbered(totals, [F.col("source").asc_nulls_last()], "_nth")
    totals = saved(placed.select("source", "source_size", (F.col("_nth") % CYCLE + 1).alias("weight")))
    everything = totals.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    while True:
        full = F.lit(MOST) * F.col("source_size") < F.lit(level) * F.col("weight")
        at = totals.agg(
            F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("source_size"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weights")
        ).first()
        if at["n"] == before or not at["weights"]:
            break
        before, level = at["n"], (everything - MOST * (at["held"] or 0)) / at["weights"]
    target = F.least(F.lit(float(MOST)) * F.col("source_size"), F.lit(float(level)) * F.col("weight"))
    return totals.select("source", "source_size", target.cast("double").alias("target"))


def sized(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """`keys` and `source` with `size`, the words of the whole text (null: 0), and `draw`, a seeded hash."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*keys, "source", size.alias("size"), F.xxhash64(F.lit(SEED), *keys, "source", text).alias("draw"))


def mix(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`sized` rows with source_size, target, `copies` (0 to MOST) and taken = copies * size.

    A row of size 0 takes no words; it is copied as often as all rows of its source
    are.  Rows equal in everything may differ in copies; which of them has more is
    of no consequence.  An empty table gives no rows.
    """
    prepare(rows.sparkSession)
    rows = saved(rows)
    histogram = saved(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(totals).withColumnRenamed("source", "_source")
    named = histogram.join(goal, histogram["source"].eqNullSafe(goal["_source"])).drop("_source")
    plan = named.groupBy("source").applyInPandas(
        _plan, "source string, size long, source_size long, target double, whole long, extra long"
    )
    plan = saved(plan).select(F.col("source").alias("_source"), F.col("size").alias("_size"), "source_size", "target", "whole", "extra")
    drawn = ranked(rows, ["source", "size"], ["draw", *keys], "_place")
    copies = F.col("whole") + F.when(F.col("_place") < F.col("extra"), 1).otherwise(0)
    joined = drawn.join(plan, drawn["source"].eqNullSafe(plan["_source"]) & (drawn["size"] == plan["_size"]))
    return joined.select(*rows.columns, "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for each row of `docs` (doc_id, text, source).

    Null and empty texts have size 0, a null source is a source; texts may have any
    length, rows may repeat and an empty table gives no rows.  Of documents of one source
    and size a seeded draw decides, then the id.  Other columns are not read, whatever
    their names.
    """
    return mix(sized(docs, ["doc_id"]), ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "source")


def apply_mix(docs: DataFrame) -> DataFrame:
    """`docs` as the mix takes them: a row for each copy, none for documents it leaves out.

    Nulls, ties, repeated rows and empty tables are as in `mixed`; columns may have any
    names beside.
    """
    rows = docs.select("text", "source", row_key(docs).alias("key"))
    taken = mix(sized(rows, ["key"]), ["key"])
    return copies_of(docs, taken.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").cast("long").alias("copies")))
