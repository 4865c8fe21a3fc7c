"""Ordered computations that survive a hot key.

A window over ``partitionBy(key).orderBy(ts)`` puts a whole key into one task.
When a single key can hold a third of the data that task never ends.  Here a
key is cut into *blocks*: consecutive ranges of its order.  Windows run inside
``(key, block)``, one summary row per block is scanned over the (few) blocks of
the key, and the carry is joined back on ``(key, block)``.

The cut points are ordinary data values, sampled once and then fixed, so the
block of a row is a pure function of the row: re-evaluating a lost partition
or the same plan twice gives the same blocks.  Only the *positions of the cuts*
come from a sample; every row is processed.
"""

from __future__ import annotations

import math
import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A key with fewer rows than this is never cut.
BLOCK_ROWS = int(os.environ.get("SPANLOOM_BLOCK_ROWS", 1_000_000))
#: Upper bound of cut points over all keys together; bounds what is broadcast
#: (64 Ki cut points of two longs each, about one MiB).
MAX_CUTS = 1 << 16
_SAMPLES_PER_CUT = 16
BLOCK = "_block"


@dataclass(frozen=True)
class Blocks:
    """Cut points per key; ``table is None`` means that no key needs cutting."""

    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    table: DataFrame | None = None

    @property
    def split(self) -> bool:
        return self.table is not None

    def renamed(self, *keys: str) -> "Blocks":
        """The same cuts for frames that name the key columns differently."""
        if self.table is None:
            return self
        return Blocks(keys, self.order, self.table.withColumnsRenamed(dict(zip(self.keys, keys))))

    def assign(self, df: DataFrame, *order: str) -> DataFrame:
        """Add the block number of each row, from its key and order columns.

        ``order`` may name fewer columns than the cuts were planned on; rows
        that are equal in those columns then share a block.
        """
        if self.table is None:
            return df.withColumn(BLOCK, F.lit(0))
        position = F.struct(*[F.col(c).alias(n) for c, n in zip(order, self.order)])

        def prefix(cut: Column) -> Column:
            return F.struct(*[cut[n].alias(n) for n in self.order[: len(order)]])

        # The cuts are held in groups, so a lookup compares 2 * sqrt(cuts) values.
        cuts = F.broadcast(self.table)  # at most MAX_CUTS cut points
        joined = df.join(cuts, list(self.keys), "left") if self.keys else df.crossJoin(cuts)
        group = F.size(F.filter("_heads", lambda h: prefix(h) <= position))
        inner = F.size(F.filter(F.get(F.col("_groups"), F.col("_group") - 1), lambda c: prefix(c) <= position))
        width = F.col("_width")
        return (
            joined.withColumn("_group", F.when(F.col("_heads").isNull(), F.lit(0)).otherwise(group))
            .withColumn(
                BLOCK,
                F.when(F.col("_group") == 0, F.lit(0)).otherwise((F.col("_group") - 1) * width + inner).cast("int"),
            )
            .drop("_heads", "_groups", "_width", "_group")
        )


NO_BLOCKS = Blocks()


def plan_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    rows: int | None = None,
    block_rows: int = BLOCK_ROWS,
    max_cuts: int = MAX_CUTS,
) -> Blocks:
    """Choose cut points so that no block holds much more than ``block_rows``.

    ``rows`` is the row count or an upper bound of it, when it is known.
    Keys below ``block_rows`` stay whole.  The driver receives the chosen cuts
    only: never more than ``max_cuts``.
    """
    keys, order = tuple(keys), tuple(order)
    total = df.count() if rows is None else rows
    if total <= block_rows:
        return NO_BLOCKS
    wanted = min(max_cuts, math.ceil(total / block_rows))
    fraction = min(1.0, _SAMPLES_PER_CUT * wanted / total)
    rows_per_cut = max(block_rows, math.ceil(total / max_cuts))
    step = max(1, round(rows_per_cut * fraction))
    sampled = df.select(*keys, F.struct(*order).alias("_at")).sample(fraction, seed=7)
    # the sample holds about 16 rows per cut in all, whatever the size of df
    cuts = (
        sampled.groupBy(*keys)
        .agg(F.array_sort(F.collect_list("_at")).alias("_at"))
        .withColumn(
            "_cuts",
            F.array_distinct(F.filter("_at", lambda _x, i: (i % F.lit(step)) == F.lit(step - 1))),
        )
        .filter(F.size("_cuts") > 0)
        .select(*keys, "_cuts")
    )
    found = cuts.collect()
    if not found:
        return NO_BLOCKS
    spark = df.sparkSession
    schema = cuts.schema
    width = max(2, math.isqrt(max(len(r["_cuts"]) for r in found)) + 1)
    local = spark.createDataFrame([tuple(r) for r in found], schema)
    count = F.size("_cuts")
    groups = F.transform(
        F.sequence(F.lit(0), F.floor((count - 1) / width).cast("int")),
        lambda g: F.slice(F.col("_cuts"), g * width + 1, F.lit(width)),
    )
    table = (
        local.withColumn("_groups", groups)
        .withColumn("_heads", F.transform("_groups", lambda g: F.get(g, F.lit(0))))
        .withColumn("_width", F.lit(width))
        .drop("_cuts")
    )
    return Blocks(keys, order, table)


@dataclass(frozen=True)
class Run:
    """One ordered column: ``kind`` over ``value``.

    Kinds: ``sum`` and ``last`` include the current row; ``max_before`` and
    ``last_before`` look at earlier rows only (``last*`` skip nulls);
    ``row_number``, ``lag`` and ``lead`` are as in SQL.
    """

    kind: str
    value: Column | None = None


def _direct(run: Run, window) -> Column:
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    if run.kind == "sum":
        return F.sum(run.value).over(upto)
    if run.kind == "row_number":
        return F.row_number().over(window).cast("long")
    if run.kind == "max_before":
        return F.max(run.value).over(before)
    if run.kind == "last":
        return F.last(run.value, ignorenulls=True).over(upto)
    if run.kind == "last_before":
        return F.last(run.value, ignorenulls=True).over(before)
    if run.kind == "lag":
        return F.lag(run.value).over(window)
    if run.kind == "lead":
        return F.lead(run.value).over(window)
    raise ValueError(run.kind)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    runs: dict[str, Run],
    blocks: Blocks | None = None,
    block_order: Sequence[str] | None = None,
) -> DataFrame:
    """Add ordered columns to ``df``, keyed by ``keys`` and sorted by ``order``.

    ``order`` must be a total order inside a key.  With ``blocks`` that split
    nothing this is one shuffle and one sort; otherwise windows run per block.
    Without ``blocks`` the rows are counted first and cut if a key may be large.
    """
    keys, order = list(keys), list(order)
    if blocks is None:
        blocks = plan_blocks(df, keys, block_order or order)
    if not blocks.split:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({name: _direct(run, window) for name, run in runs.items()})

    rows = blocks.assign(df, *(block_order or order))
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    at = F.struct(*order)
    within, summary, carry, result = {}, [], {}, {}
    # one total per block, scanned in block order: a key has few blocks
    across = Window.partitionBy(*keys).orderBy(BLOCK)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    for name, run in runs.items():
        own, tot, car = f"_own_{name}", f"_tot_{name}", f"_car_{name}"
        within[own] = _direct(run, inside)
        if run.kind == "sum":
            summary.append(F.sum(run.value).alias(tot))
            carry[car] = F.sum(tot).over(earlier)
            result[name] = F.coalesce(F.col(own) + F.col(car), F.col(own), F.col(car))
        elif run.kind == "row_number":
            summary.append(F.count(F.lit(1)).alias(tot))
            carry[car] = F.sum(tot).over(earlier)
            result[name] = F.col(own) + F.coalesce(F.col(car), F.lit(0))
        elif run.kind == "max_before":
            summary.append(F.max(run.value).alias(tot))
            carry[car] = F.max(tot).over(earlier)
            result[name] = F.greatest(own, car)
        elif run.kind in ("last", "last_before"):
            summary.append(F.max_by(run.value, F.when(run.value.isNotNull(), at)).alias(tot))
            carry[car] = F.last(tot, ignorenulls=True).over(earlier)
            result[name] = F.coalesce(own, car)
        else:
            edge = f"_edge_{name}"
            pick, step = (F.max_by, F.lag) if run.kind == "lag" else (F.min_by, F.lead)
            # wrapped, so that a null neighbour value stays a value
            summary.append(pick(F.struct(run.value.alias("v")), at).alias(tot))
            carry[car] = step(tot).over(across)
            within[edge] = step(F.lit(True)).over(inside).isNull()
            result[name] = F.when(F.col(edge), F.col(car)["v"]).otherwise(F.col(own))
    carries = rows.groupBy(*keys, BLOCK).agg(*summary).withColumns(carry)
    carries = carries.select(*keys, BLOCK, *carry)
    # rows with a null key share block 0, have no carry, and must not be lost
    joined = rows.withColumns(within).join(carries, [*keys, BLOCK], "left")
    return joined.select(*[F.col(c) for c in df.columns], *[e.alias(n) for n, e in result.items()])
