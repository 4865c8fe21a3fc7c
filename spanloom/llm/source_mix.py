"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact size in each source.  A source whose target is
worth several whole rounds takes every document so often; what is left of its
budget is fitted with documents that are taken once more: an even share of
every size first, then a bounded knapsack over the counts that are left, filled
by dynamic programming until the budget is met to the word.  Which documents of
a size are chosen follows a seeded hash, so reruns agree.

Only counts travel: sums per source, one row per (source, size) and one per
hash range of it.  No group of documents is gathered, and ranks are computed
only inside the one hash range of a (source, size) that is taken in part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from spanloom.llm.common import kept
from spanloom.operators.blocks import Run, running

#: Weights of the sources in code point order, repeated.
WEIGHTS = (1, 2, 3)
#: A document is taken so often at most, and a target stops at this times its source's size.
MOST = 3
#: Rows of a (source, size) in one hash range, about.
RANGE_ROWS = 10_000
SEED = 13


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size)`` with the words of the whole text counted; null text: 0.

    ``source`` is a key that is never null: ``s`` and the source, or ``t`` for null, which so comes last.
    """
    words = F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("source"), F.coalesce(words, F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size)`` of distinct sources with ``weight`` and ``target``.

    Weights follow the code points of the sources (keys of :func:`sized`).  Shares above
    ``most`` times a source are cut there and the excess is shared by weight again,
    until none is above; each round is one aggregate of a few sums.
    """
    numbered = running(sizes, [], ["source"], {"place": Run("row_number")})
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = kept(numbered.select("source", "source_size", pick.alias("weight"), (F.col("source_size") * most).cast("double").alias("limit")), "mix-weights")
    whole = rows.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, 0
    while True:  # a share only grows, so a capped source stays capped
        above = F.col("weight") * F.lit(share) > F.col("limit")
        row = rows.agg(F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, F.col("source_size") * most)).alias("cut"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        if share and row["n"] == capped:
            break
        capped = row["n"]
        if not row["w"]:
            break
        share = (whole - (row["cut"] or 0)) / row["w"]
        if not share:
            break
    return rows.withColumn("target", F.least(F.col("weight") * F.lit(share), F.col("limit"))).drop("limit")


def fit(sizes: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many of ``counts`` documents of each size to take so that their words come nearest to ``budget``.

    ``sizes`` are distinct and positive.  The even share of each size comes first,
    rounded down; larger sizes then take one more while they fit, as long as the
    gap stays above twice the largest size.  The rest is a bounded knapsack: every
    sum up to the gap and one document beyond keeps the copies that first reached
    it, and the walk back from the nearest sum reads the choice off.  Of two sums
    equally near the smaller one wins.
    """
    order = np.argsort(-sizes)
    size, free = sizes[order].astype(np.int64), counts[order].astype(np.int64)
    taken = np.minimum(free, np.floor(free * min(1.0, max(0.0, budget) / max(1, int((size * free).sum())))).astype(np.int64))
    gap = budget - int((size * taken).sum())
    for i, s in enumerate(size.tolist()):
        if gap <= 2 * int(size[0]):
            break
        if taken[i] < free[i] and gap - s >= 0:
            taken[i] += 1
            gap -= s
    gap = max(0.0, gap)
    left = free - taken
    usable = np.flatnonzero(left > 0)
    if len(usable):
        top = math.ceil(gap) + int(size[usable].max())
        by, copies = np.full(top + 1, -1, np.int32), np.zeros(top + 1, np.int32)
        reached = np.zeros(top + 1, bool)
        reached[0] = True
        goal = math.ceil(gap - 0.5)  # no sum is nearer
        for i in usable.tolist():
            s, room, batch = int(size[i]), min(int(left[i]), top // int(size[i])), 1
            done = 0
            while done < room and not reached[goal]:
                step = min(batch, room - done)
                new = np.zeros_like(reached)
                new[s * step :] = reached[: top + 1 - s * step]
                new &= ~reached
                # a sum first reached here came from one reached before this step
                by[new], copies[new] = i, step
                reached |= new
                done, batch = done + step, batch * 2
            if reached[goal]:
                break
        sums = np.flatnonzero(reached)
        at = int(sums[np.argmin(np.abs(sums - gap))])
        while at:
            i, k = int(by[at]), int(copies[at])
            taken[i] += k
            at -= int(size[i]) * k
    out = np.empty_like(taken)
    out[order] = taken
    return out


def quotas(counts: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """``(source, size, rounds, more)``: how often all documents of a size are taken, and how many of them once more.

    ``counts`` has ``(source, size, docs)``; one group is the distinct sizes of one source.
    """
    rows = counts.join(goals, "source").select("source", "size", "docs", "source_size", "target")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        whole, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        rounds = min(most, int(target // whole)) if whole else 0
        live = (group["size"] > 0).to_numpy()
        size, docs, budget = group["size"].to_numpy()[live], group["docs"].to_numpy()[live], target - rounds * whole
        best = np.zeros(len(size), np.int64)
        if rounds < most and len(size):
            best = fit(size, docs, budget)
            miss = abs(int((size * best).sum()) - budget)
            if miss > 0.5 and rounds + 1 < most:  # a document larger than the gap: others more than once
                other = fit(size, docs * (most - rounds), budget)
                best = other if abs(int((size * other).sum()) - budget) < miss else best
        each, more = np.full(len(group), rounds, np.int32), np.zeros(len(group), np.int64)
        each[live] += (best // docs).astype(np.int32)
        more[live] = best % docs
        return pd.DataFrame({"source": group["source"], "size": group["size"], "rounds": each, "more": more})

    return rows.groupBy("source").applyInPandas(one, "source string, size long, rounds int, more long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Words that a mix of the sources takes from each document.

    One row per row of ``docs``: ``doc_id, size, source_size, target, taken``.
    Documents are taken whole, each at most three times.  Empty and null texts have
    size 0 and are taken with 0 words; a source of such texts only has target 0.
    Equal rows may differ in ``taken`` among themselves, never in their number. An
    empty table gives an empty one; further columns of ``docs`` are not read.
    """
    rows = kept(sized(docs, id_col, text_col, source_col), "mix-sizes")
    counts = kept(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "mix-counts")
    goals = kept(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))), "mix-targets")
    plan = kept(quotas(counts, goals), "mix-quotas")

    # each (source, size) in hash ranges of about RANGE_ROWS rows
    full = plan.join(counts, ["source", "size"]).join(goals, "source").select("source", "size", "rounds", "more", "source_size", "target", F.ceil(F.col("docs") / RANGE_ROWS).alias("ranges"))
    dealt = rows.join(full, ["source", "size"]).withColumn("h", F.xxhash64(F.lit(SEED), "doc_id", "source", "size"))
    dealt = kept(dealt.withColumn("part", F.pmod(F.shiftrightunsigned("h", 32), F.col("ranges"))).drop("ranges"), "mix-dealt")
    ranges = dealt.filter("more > 0").groupBy("source", "size", "part", "more").agg(F.count(F.lit(1)).alias("docs"))
    before = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    need = F.col("more") - F.coalesce(F.sum("docs").over(before), F.lit(0))
    cut = kept(ranges.select("source", "size", "part", F.least("docs", need).alias("need"), "docs").filter("need > 0"), "mix-ranges")

    joined = dealt.join(cut, ["source", "size", "part"], "left")
    inside = Window.partitionBy("source", "size", "part").orderBy("h", F.col("doc_id").asc_nulls_last())
    partly = F.col("need") < F.col("docs")
    told = joined.filter(~F.coalesce(partly, F.lit(False))).withColumn("once", F.when(F.col("need").isNotNull(), 1).otherwise(0))
    ranked = joined.filter(partly).withColumn("once", F.when(F.row_number().over(inside) <= F.col("need"), 1).otherwise(0))
    return told.unionByName(ranked).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("rounds") + F.col("once"))).alias("taken"))
